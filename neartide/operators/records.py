"""Filters, best records, samples and tables of reads and alignments."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from neartide.functions.sequence import flip_strand, portable_hash, reverse_complement, uniform


# ---- alignments


def long_good_mapped(paf: DataFrame, length: int = 5000, share: float = 0.5, quality: int = 30) -> DataFrame:
    return paf.where((F.col("query_length") >= length) & (F.col("num_matching_bases") / F.col("query_length") >= share) & (F.col("mapping_quality") >= quality))


def region_overlap(paf: DataFrame, chromosome: str, start: int, end: int) -> DataFrame:
    return paf.where((F.col("target_name") == chromosome) & (F.col("target_start") < end) & (F.col("target_end") > start))


def region_containment(paf: DataFrame, chromosome: str, start: int, end: int, suffix: str = "_MATERNAL") -> DataFrame:
    return paf.where((F.col("target_name") == chromosome + suffix) & (F.col("target_start") > start) & (F.col("target_end") < end))


def good_overlaps(paf: DataFrame, matches: int = 50, share: float = 0.1) -> DataFrame:
    return paf.where((F.col("num_matching_bases") >= matches) & (F.col("num_matching_bases") / F.col("alignment_block_length") >= share))


def best_per_key(rows: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """The row with the largest value for each key, the first among equals."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(value.desc(), order))).where("_n = 1").drop("_n")


def identity() -> Column:
    return (F.col("query_alignment_length") - F.col("mismatch")) / F.col("query_length")


def reject_statistics(bam: DataFrame, least: float = 0.5) -> DataFrame:
    """Reads, rejected reads (best identity below ``least``), their share, and rejected reads with several alignments."""
    best = bam.groupBy("query_name").agg(F.max(identity()).alias("identity"), F.count(F.lit(1)).alias("n"))
    low = F.col("identity") < least
    return best.agg(
        F.count(F.lit(1)).alias("reads"), F.count_if(low).alias("rejected"), F.try_divide(F.count_if(low), F.count(F.lit(1))).alias("reject_share"), F.count_if(low & (F.col("n") > 1)).alias("rejected_multiple")
    )


def metadata(reads: DataFrame, info: DataFrame, strict: bool = False) -> DataFrame:
    """Both orientations of each read with its coordinates; the reverse row has the other strand.

    ``reads`` is (read_id, read_name, read_orientation); reads without
    coordinates are left out, or with ``strict`` an error.
    """
    if strict:
        found = reads.join(info, "read_name", "left")
        check = F.when(F.col("reference_start").isNull(), F.raise_error(F.concat(F.lit("no coordinates for read "), "read_name"))).otherwise(F.col("reference_start"))
        found = found.withColumn("reference_start", check)
    else:
        found = reads.join(info, "read_name")
    return found.withColumn("reference_strand", F.when(F.col("read_orientation") == "-", flip_strand(F.col("reference_strand"))).otherwise(F.col("reference_strand")))


def repeated_names(reads: DataFrame, name: str = "read_name") -> DataFrame:
    return reads.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_distinct(reads: DataFrame, name: str = "read_name") -> DataFrame:
    """``reads``, or an error when they are read if a name is there twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(name))
    return reads.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated read "), F.col(name))).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def region_slice(sequences: DataFrame, chromosome: str, start: int, end: int, strict: bool = False) -> DataFrame:
    """The stretch [start, end) of a named sequence in upper case, named chromosome_start_end; with ``strict`` a name that is not there is an error."""
    if strict and sequences.where(F.col("name") == chromosome).isEmpty():
        raise ValueError(f"no sequence named {chromosome!r}")
    return sequences.where(F.col("name") == chromosome).select(F.lit(f"{chromosome}_{start}_{end}").alias("name"), F.translate(F.substring("sequence", start + 1, end - start), string.ascii_lowercase, string.ascii_uppercase).alias("sequence"))


def rows_by_names(rows: DataFrame, names: DataFrame, name: str = "read_name") -> DataFrame:
    """All rows of each name of ``names(name, place)``, in order of place: a name that is listed twice has its rows twice."""
    listed = names.select(F.col("name").alias(name), F.col("place").alias("_place"))
    return rows.join(listed, name).orderBy("_place", *[c for c in rows.columns if c == "read_id"]).drop("_place")


def with_taxon(features: DataFrame, reads: DataFrame, accessions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``features(read_id, ...)`` with each read's species: ``reads(read_id, read_name)``, ``accessions(name, accession)``, ``taxonomy(tax_id, taxonomy)``; null where one is unknown."""
    from neartide.functions.sequence import species

    known = taxonomy.select(F.col("tax_id").alias("accession"), species(F.col("taxonomy")).alias("species"))
    named = reads.join(accessions.select(F.col("name").alias("read_name"), "accession"), "read_name", "left").join(known, "accession", "left")
    return features.join(named.select("read_id", "species"), "read_id", "left")


# ---- samples


def exact_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the largest hash of ``key``: a uniform sample of exact size that does not depend on order."""
    return rows.orderBy(portable_hash(F.col(key), seed).desc(), key).limit(n)


def perfect_reads(genome: DataFrame, read_length: int, depth: float, seed: int) -> DataFrame:
    """Error-free reads of ``genome(name, sequence)``: uniform starts, either strand, repeats of a start and strand once.

    (genome, start_pos, strand, sequence); as many draws as the depth asks for.
    """
    sized = genome.withColumn("g", F.length("sequence")).where(F.col("g") > read_length)
    draws = sized.withColumn("n", F.bround(F.col("g") * depth / read_length).cast("long")).where("n > 0")
    each = draws.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    key = F.concat_ws(":", "name", "i")
    placed = each.select(
        F.col("name").alias("genome"), F.floor(uniform(key, f"{seed}.start") * (F.col("g") - read_length)).cast("long").alias("start_pos"),
        F.when(uniform(key, f"{seed}.strand") < 0.5, "+").otherwise("-").alias("strand"),
    ).distinct()
    cut = placed.join(sized.select(F.col("name").alias("genome"), F.col("sequence").alias("whole")), "genome")
    piece = F.expr(f"substring(whole, cast(start_pos as int) + 1, {read_length})")
    return cut.select("genome", "start_pos", "strand", F.when(F.col("strand") == "+", piece).otherwise(reverse_complement(piece)).alias("sequence"))


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """The product of parameter lists, one row for each combination."""
    import itertools

    names = list(values)
    return spark.createDataFrame([tuple(str(x) for x in row) for row in itertools.product(*values.values())], ", ".join(f"{n} string" for n in names))


# ---- run logs

# fixed values: lines that the time command writes
_TIME = {"mrss": r"Maximum resident set size \(kbytes\): (\d+)", "clock": r"Elapsed \(wall clock\) time \(h:mm:ss or m:ss\): ([\d:.]+)", "system": r"System time \(seconds\): ([\d.]+)", "user": r"User time \(seconds\): ([\d.]+)"}


def parse_time_logs(logs: DataFrame) -> DataFrame:
    """(path, mrss, clock_time, cpu_time) of run logs (path, text); seconds, null where a line is missing."""
    got = {k: F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for k, p in _TIME.items()}
    parts = F.reverse(F.split(got["clock"], ":"))
    clock = F.get(parts, F.lit(0)).cast("double") + 60 * F.coalesce(F.get(parts, F.lit(1)).cast("double"), F.lit(0.0)) + 3600 * F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(0.0))
    return logs.select("path", got["mrss"].cast("long").alias("mrss"), clock.alias("clock_time"), (got["system"].cast("double") + got["user"].cast("double")).alias("cpu_time"))
