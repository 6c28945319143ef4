"""Readers of overlap and alignment tables, and writers of the engine's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAF = "query_name string, query_length long, query_start long, query_end long, strand string, target_name string, target_length long, target_start long, target_end long, num_matching_bases long, alignment_block_length long, mapping_quality int"
READ_INFO = "read_name string, read_length long, reference_chromosome string, reference_strand string, reference_start long, reference_end long"


def _lines(spark: SparkSession, paths, separator: str) -> DataFrame:
    """(c, line_no): the fields of each line that is not blank, and its place: file, block of the file, line of the block."""
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    # ids rise within a block, and structs compare field by field; Spark reads blocks in any order
    return rows.where(F.trim("value") != "").select(F.split("value", separator).alias("c"), F.struct("f", "b", "n").alias("line_no"))


def _at(i: int, kind: str = "string") -> Column:
    return F.get("c", F.lit(i)).cast(kind)


def read_paf(spark: SparkSession, paths) -> DataFrame:
    """PAF: twelve typed columns, what follows them as optional_fields, and line_no."""
    fields = [f.split() for f in PAF.split(", ")]
    rows = _lines(spark, paths, "\t").where(F.size("c") >= len(fields))
    return rows.select(*[_at(i, kind).alias(name) for i, (name, kind) in enumerate(fields)], F.slice("c", 13, 1 << 20).alias("optional_fields"), "line_no")


def read_mhap(spark: SparkSession, paths) -> DataFrame:
    rows = _lines(spark, paths, " ").where(F.size("c") > 10)
    return rows.select(_at(0).alias("name1"), _at(1).alias("name2"), _at(2, "double").alias("error"), _at(3, "double").alias("shared"), _at(4).alias("flag1"), _at(8).alias("flag2"), "line_no")


def read_wtdbg2(spark: SparkSession, paths) -> DataFrame:
    rows = _lines(spark, paths, "\t").where(F.size("c") > 12)
    return rows.select(_at(0).alias("name1"), _at(1).alias("strand1"), _at(5).alias("name2"), _at(6).alias("strand2"), _at(10, "long").alias("matches"), _at(11, "long").alias("length"), "line_no")


def read_mecat2(spark: SparkSession, paths) -> DataFrame:
    rows = _lines(spark, paths, "\t").where(F.size("c") > 10)
    return rows.select(_at(0, "long").alias("id1"), _at(1, "long").alias("id2"), _at(2, "double").alias("identity"), _at(4).alias("flag1"), _at(8).alias("flag2"), "line_no")


def read_ranked_names(spark: SparkSession, paths) -> DataFrame:
    """Lines of exactly five fields; the header's rank is no number, which leaves it out."""
    rows = _lines(spark, paths, "\t").where(F.size("c") == 5)
    return rows.select(_at(0).alias("name1"), _at(1).alias("strand1"), _at(2).alias("name2"), _at(3).alias("strand2"), F.get("c", F.lit(4)).try_cast("int").alias("rank"), "line_no").where("rank is not null")


def read_ranked_ids(spark: SparkSession, paths) -> DataFrame:
    rows = _lines(spark, paths, "\t").where(F.size("c") == 4)
    number = lambda i: F.get("c", F.lit(i)).try_cast("long")
    return rows.select(number(0).alias("id1"), number(1).alias("id2"), number(3).cast("int").alias("rank"), "line_no").where("id1 is not null and id2 is not null and rank is not null")


def read_name_pairs(spark: SparkSession, paths) -> DataFrame:
    """name1, name2 and whether both are on the same strand (1)."""
    return _lines(spark, paths, "\t").where(F.size("c") >= 3).select(_at(0).alias("name1"), _at(1).alias("name2"), (_at(2) == "1").alias("same_strand"))


def read_table(spark: SparkSession, paths, schema: str | None = None) -> DataFrame:
    """A TSV file with a header."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return reader.schema(schema).option("mode", "FAILFAST").csv(paths) if schema else reader.csv(paths)


def write_table(df: DataFrame, path: str, compressed: bool = True) -> None:
    df.write.option("sep", "\t").option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def write_top_overlaps(top: DataFrame, strands: DataFrame, path: str) -> None:
    """read_a, strand_a, read_b, strand_b, overlap_size; ``strands`` is (read_id, line_no, strand), a read's first line counts."""
    first = strands.groupBy("read_id").agg(F.min_by("strand", "line_no").alias("strand"))
    a = first.select(F.col("read_id").alias("read_a"), F.col("strand").alias("strand_a"))
    b = first.select(F.col("read_id").alias("read_b"), F.col("strand").alias("strand_b"))
    named = top.select(F.col("read_id").alias("read_a"), F.col("neighbor_id").alias("read_b"), "overlap_size").join(a, "read_a").join(b, "read_b")
    write_table(named.select("read_a", "strand_a", "read_b", "strand_b", "overlap_size"), path)


def accessions(spark: SparkSession, paths, pattern: str = r"(GC[AF]_\d+\.\d+)") -> DataFrame:
    """(name, accession): each record's name with the accession in its file's path, prefixed by where it comes from."""
    from neartide.functions.sequence import accession_prefix

    lines = spark.read.text(paths).where(F.col("value").startswith(">"))
    rows = lines.select(F.regexp_extract("value", r"\A>([^\s]*)", 1).alias("name"), F.regexp_extract("_metadata.file_path", pattern, 1).alias("a"))
    return rows.where("name <> ''").select("name", accession_prefix(F.col("a")).alias("accession"))


def time_logs(spark: SparkSession, paths) -> DataFrame:
    """(path, mrss, clock_time, cpu_time) of run logs, one file each."""
    from neartide.operators.records import parse_time_logs

    rows = spark.read.text(paths, wholetext=True)
    return parse_time_logs(rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


STAGES = "tfidf double, dimension_reduction double, nearest_neighbors double"


def stage_times(spark: SparkSession, paths) -> DataFrame:
    """(path, tfidf_time, dimension_reduction_time, get_neighbors_time) of JSON files of stage times, null where one is absent."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", STAGES).alias("s"))
    return rows.select("path", F.col("s.tfidf").alias("tfidf_time"), F.col("s.dimension_reduction").alias("dimension_reduction_time"), F.col("s.nearest_neighbors").alias("get_neighbors_time"))


def time_table(logs: DataFrame, stages: DataFrame) -> DataFrame:
    """Run logs beside the stage times of files of the same name but for the last suffix, with what the path says of the run.

    A path ends in thread/sample/region/platform/encode/method; folders that are
    not there are null.
    """
    key = lambda c: F.regexp_replace(c, r"\.[^./]*\Z", "")
    both = logs.withColumn("k", key("path")).join(stages.select(key("path").alias("k"), "tfidf_time", "dimension_reduction_time", "get_neighbors_time"), "k", "left")
    part = F.split("k", "/")
    names = ("thread", "sample", "region", "platform", "encode", "method")
    of = [F.try_element_at(part, F.lit(i - len(names))).alias(n) for i, n in enumerate(names)]
    return both.select("path", *of, "mrss", "clock_time", "cpu_time", "tfidf_time", "dimension_reduction_time", "get_neighbors_time")


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """A graph as two Parquet tables, edges and nodes, with all their columns."""
    edges.write.parquet(f"{path}/edges")
    nodes.write.parquet(f"{path}/nodes")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written."""
    rows.write.option("ignoreNullFields", False).json(path)


def write_with_attributes(df: DataFrame, path: str, **attributes: str) -> None:
    """A table whose columns' metadata carries ``attributes``; Parquet keeps them."""
    first = df.columns[0]
    df.withMetadata(first, {**df.schema[first].metadata, "attributes": attributes}).write.parquet(path)


def attributes(df: DataFrame) -> dict[str, str]:
    return dict(df.schema[df.columns[0]].metadata.get("attributes", {})) if df.columns else {}
