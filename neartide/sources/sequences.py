"""Readers of sequence files.  gzip is recognised by suffix; such a file is one partition, so rows are dealt out after reading."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FASTA_SUFFIXES = (".fasta", ".fa", ".fna", ".fasta.gz", ".fa.gz", ".fna.gz")
FASTQ_SUFFIXES = (".fastq", ".fq", ".fastq.gz", ".fq.gz")


def file_kind(path: str) -> str:
    """fasta or fastq by the path's suffix; anything else is an error."""
    for kind, suffixes in (("fasta", FASTA_SUFFIXES), ("fastq", FASTQ_SUFFIXES)):
        if path.lower().endswith(suffixes):
            return kind
    raise ValueError(f"neither FASTA nor FASTQ: {path!r}")


def read_fasta(spark: SparkSession, paths: str | list[str], upper: bool = True, partitions: int | None = None) -> DataFrame:
    """(name, sequence): the name ends at the first white space, lines are joined, records without a name are left out."""
    # a record begins with > after a line feed; > within a header or sequence separates nothing, and the file's first > stands alone
    records = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", r"\A\s*>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"\A([^\s]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"\A[^\n]*\n?", ""), r"\s+", "")
    rows = records.select(head.alias("name"), (F.upper(body) if upper else body).alias("sequence")).where("name <> ''")
    return rows.repartition(partitions) if partitions else rows


def read_fastq(spark: SparkSession, paths: str | list[str], offset: int = 33) -> DataFrame:
    """(name, sequence, quality): records of four lines; blank lines are dropped first, an incomplete last record is left out.

    A file is read by one task, line after line; files are read in parallel.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        last = None
        for batch in batches:
            rows = []
            for path, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if path != last:
                    held, last = [], path
                line = line.rstrip("\r\n")
                if not line.strip():
                    continue
                held.append(line)
                if len(held) == 4:
                    name = held[0][1:].split()
                    rows.append((name[0] if name else "", held[1], [ord(c) - offset for c in held[3]]))
                    held = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.string(), pa.list_(pa.int16())])], names=["name", "sequence", "quality"])

    # records are counted by lines, so the lines of a file that was cut into several blocks come together in order
    ordered = lines.withColumn("n", F.monotonically_increasing_id()).repartition("f").sortWithinPartitions("f", "b", "n").select("f", "b", "value")
    return ordered.mapInArrow(run, "name string, sequence string, quality array<smallint>")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of a FASTA or FASTQ file, by suffix."""
    return read_fasta(spark, path) if file_kind(path) == "fasta" else read_fastq(spark, path).select("name", "sequence")


def concatenated(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of two or more files of one kind."""
    if len(paths) < 2:
        raise ValueError("at least two files")
    kinds = {file_kind(p) for p in paths}
    if len(kinds) > 1:
        raise ValueError("files of different kinds")
    return read_fasta(spark, paths) if kinds == {"fasta"} else read_fastq(spark, paths)


def fastq_names(spark: SparkSession, path: str) -> DataFrame:
    return read_fastq(spark, path).select("name")


def read_maf(spark: SparkSession, paths: str | list[str], read_suffix: str = "", sequences: DataFrame | None = None) -> DataFrame:
    """Simulated reads from MAF blocks of a ``ref`` row and a read row: name, length, strand, reference start and end.

    Blocks of more than two rows, or whose read does not start at 0, are an
    error.  With ``sequences(name, sequence)`` only reads that it names are
    taken, and a read's length is that of its sequence.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(paths).withColumn("rows", F.filter(F.split("value", "\n"), lambda r: r.startswith("s ")))
    blocks = blocks.where(F.size("rows") > 0)
    ok = F.when(F.size("rows") != 2, F.raise_error(F.lit("a block must have two rows")).cast("boolean")).otherwise(F.lit(True))
    cells = lambda i: F.split(F.trim(F.get("rows", F.lit(i))), r"\s+")
    two = blocks.where(ok).select(cells(0).alias("r"), cells(1).alias("q"))
    zero = F.when(F.get("q", F.lit(2)).cast("long") != 0, F.raise_error(F.lit("a read must start at 0")).cast("boolean")).otherwise(F.lit(True))
    at = lambda c, i: F.get(c, F.lit(i))
    name = at("q", 1)
    if read_suffix:
        name = F.concat(F.regexp_replace(name, r"/0$", ""), F.lit(read_suffix))
    found = two.where(zero).select(
        name.alias("read_name"), at("q", 5).cast("long").alias("read_length"), at("q", 4).alias("reference_strand"),
        at("r", 2).cast("long").alias("reference_start"), (at("r", 2).cast("long") + at("r", 3).cast("long")).alias("reference_end"),
    )
    if sequences is None:
        return found
    lengths = sequences.select(F.col("name").alias("read_name"), F.length("sequence").cast("long").alias("read_length"))
    return found.drop("read_length").join(lengths, "read_name").select("read_name", "read_length", "reference_strand", "reference_start", "reference_end")


def perfect_read_info(sequences: DataFrame) -> DataFrame:
    """Coordinates of error-free reads from their names: the start stands before the first underscore, the strand is +."""
    start = F.substring_index("name", "_", 1).cast("long")
    return sequences.select(F.col("name").alias("read_name"), F.length("sequence").cast("long").alias("read_length"), F.lit("+").alias("reference_strand"), start.alias("reference_start"), (start + F.length("sequence")).alias("reference_end"))


def kmer_vocabulary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(kmer): the sequences of a FASTA file and their reverse complements, each once."""
    from neartide.operators.encode import closed_vocabulary

    return closed_vocabulary(read_fasta(spark, paths).select(F.col("sequence").alias("kmer")))


def write_fasta(sequences: DataFrame, path: str, compressed: bool = True) -> None:
    """Writes (name, sequence) as FASTA text files in the folder ``path``."""
    writer = sequences.select(F.format_string(">%s\n%s", "name", "sequence").alias("value")).write
    (writer.option("compression", "gzip") if compressed else writer).text(path)


def read_error_model(spark: SparkSession, path: str) -> DataFrame:
    """(acc, kind, state, p) of a simulator's error model: accuracy, IP, EP or TP, state, probabilities."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("c"))
    return rows.select(F.get("c", F.lit(0)).cast("int").alias("acc"), F.get("c", F.lit(1)).alias("kind"), F.get("c", F.lit(2)).cast("int").alias("state"), F.transform(F.slice("c", 4, 1 << 20), lambda x: x.cast("double")).alias("p"))
