"""Neighbours from other tools' overlaps.

Every importer filters records, turns them into a pair of oriented ids and a
value, mirrors the pair onto siblings and the other read, and ranks.  Where the
value of a repeated pair is the last one's, ``line_no`` gives the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from neartide.functions.sequence import sibling


def name_index(metadata: DataFrame) -> DataFrame:
    """(name, id): the forward row of each read."""
    return metadata.where("read_orientation = '+'").select(F.col("read_name").alias("name"), F.col("read_id").alias("id"))


def with_ids(records: DataFrame, index: DataFrame, a: str, b: str) -> DataFrame:
    """Adds i and j, the forward ids of two names; records with an unknown name drop out."""
    x, y = index.select(F.col("name").alias(a), F.col("id").alias("i")), index.select(F.col("name").alias(b), F.col("id").alias("j"))
    return records.join(x, a).join(y, b)


def turned(read_id: Column, reverse: Column) -> Column:
    return F.when(reverse, sibling(read_id)).otherwise(read_id)


def mirrored(pairs: DataFrame, siblings: bool = True, symmetric: bool = True) -> DataFrame:
    """(i, j) also as (j, i) and for the siblings of both."""
    i, j = F.col("i"), F.col("j")
    ways = [(i, j)]
    if symmetric:
        ways.append((j, i))
    if siblings:
        ways += [(sibling(a), sibling(b)) for a, b in list(ways)]
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    each = F.explode(F.array(*[F.struct(a.cast("long").alias("read_id"), b.cast("long").alias("neighbor_id"), F.lit(n).alias("way")) for n, (a, b) in enumerate(ways)]))
    return pairs.select(each.alias("p"), *rest).select("p.read_id", "p.neighbor_id", "p.way", *rest)


def ranked(pairs: DataFrame, k: int, combine: str, ascending: bool = False) -> DataFrame:
    """Combines repeated pairs by sum or by the last line, and keeps the k best of each read."""
    if combine == "sum":
        value = F.sum("value")
    elif combine == "last":
        value = F.max_by("value", F.struct("line_no", "way"))
    else:
        raise ValueError(combine)
    total = pairs.groupBy("read_id", "neighbor_id").agg(value.alias("value"))
    best = F.asc("value") if ascending else F.desc("value")
    number = total.withColumn("rank", F.row_number().over(Window.partitionBy("read_id").orderBy(best, "neighbor_id")))
    return number.where(F.col("rank") <= k).select("read_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "value")


def paf(records: DataFrame, index: DataFrame, k: int, min_length: int = 0) -> DataFrame:
    """PAF by name: summed block lengths; the query is turned on strand -."""
    some = with_ids(records.where(F.col("alignment_block_length") >= min_length), index, "query_name", "target_name")
    pairs = some.select(turned(F.col("i"), F.col("strand") == "-").alias("i"), "j", F.col("alignment_block_length").alias("value"))
    return ranked(mirrored(pairs), k, "sum")


def paf_by_id(records: DataFrame, k: int) -> DataFrame:
    """PAF whose names are read numbers."""
    i, j = F.col("query_name").cast("long") * 2, F.col("target_name").cast("long") * 2
    pairs = records.select(turned(i, F.col("strand") == "-").alias("i"), j.alias("j"), F.col("alignment_block_length").alias("value"))
    return ranked(mirrored(pairs), k, "sum")


def mhap(records: DataFrame, index: DataFrame, k: int, max_error: float = 0.3) -> DataFrame:
    """MHAP: name1, name2, error, shared, flag1, flag2, line_no; the last shared count of a pair holds."""
    some = with_ids(records.where(F.col("error") < max_error), index, "name1", "name2")
    pairs = some.select(turned(F.col("i"), F.col("flag1") == "1").alias("i"), turned(F.col("j"), F.col("flag2") == "1").alias("j"), F.col("shared").alias("value"), "line_no")
    return ranked(mirrored(pairs), k, "last")


def wtdbg2(records: DataFrame, index: DataFrame, k: int, min_matches: int = 150, min_share: float = 0.3) -> DataFrame:
    """wtdbg2: name1, strand1, name2, strand2, matches, length; summed lengths."""
    some = with_ids(records.where((F.col("matches") >= min_matches) & (F.col("matches") / F.col("length") >= min_share)), index, "name1", "name2")
    pairs = some.select(turned(F.col("i"), F.col("strand1") == "-").alias("i"), turned(F.col("j"), F.col("strand2") == "-").alias("j"), F.col("length").alias("value"))
    return ranked(mirrored(pairs), k, "sum")


def mecat2(records: DataFrame, k: int, min_identity: float = 75, base: int = 0) -> DataFrame:
    """MECAT2 m4: id1, id2, identity, flag1, flag2, line_no; ``base`` is the number of the first read."""
    some = records.where(F.col("identity") > min_identity)
    i, j = (F.col("id1") - base) * 2, (F.col("id2") - base) * 2
    pairs = some.select(turned(i, F.col("flag1") == "1").alias("i"), turned(j, F.col("flag2") == "1").alias("j"), F.col("identity").alias("value"), "line_no")
    return ranked(mirrored(pairs), k, "last")


def ranked_names(records: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Ranked overlaps by name: name1, strand1, name2, strand2, rank, line_no; one way only, lowest rank first."""
    some = with_ids(records, index, "name1", "name2")
    pairs = some.select(turned(F.col("i"), F.col("strand1") == "-").alias("i"), turned(F.col("j"), F.col("strand2") == "-").alias("j"), F.col("rank").alias("value"), "line_no")
    return ranked(mirrored(pairs, siblings=False, symmetric=False), k, "last", ascending=True)


def ranked_ids(records: DataFrame, k: int) -> DataFrame:
    """Ranked overlaps by oriented id: id1, id2, rank, line_no; both ways and for the siblings."""
    pairs = records.select(F.col("id1").alias("i"), F.col("id2").alias("j"), F.col("rank").alias("value"), "line_no")
    return ranked(mirrored(pairs), k, "last", ascending=True)


def remapped(neighbors: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Rewrites ids from one metadata table's numbering to another's, by name and orientation."""
    ids = old.select("read_name", "read_orientation", F.col("read_id").alias("was")).join(new.select("read_name", "read_orientation", F.col("read_id").alias("now")), ["read_name", "read_orientation"]).select("was", "now")
    a, b = ids.select(F.col("was").alias("read_id"), F.col("now").alias("i")), ids.select(F.col("was").alias("neighbor_id"), F.col("now").alias("j"))
    return neighbors.join(a, "read_id").join(b, "neighbor_id").select(F.col("i").alias("read_id"), "rank", F.col("j").alias("neighbor_id"))


def imported(tool: str, spark, paths, index: DataFrame, k: int, **options) -> DataFrame:
    """The neighbours in the file of a tool: paf, mhap, wtdbg2, mecat2, ranked_names or ranked_ids; others are a ValueError."""
    from neartide.sources import overlaps

    by_name = {"paf": (overlaps.read_paf, paf), "mhap": (overlaps.read_mhap, mhap), "wtdbg2": (overlaps.read_wtdbg2, wtdbg2), "ranked_names": (overlaps.read_ranked_names, ranked_names)}
    by_id = {"mecat2": (overlaps.read_mecat2, mecat2), "ranked_ids": (overlaps.read_ranked_ids, ranked_ids)}
    if tool in by_name:
        read, build = by_name[tool]
        return build(read(spark, paths), index, k, **options)
    if tool in by_id:
        read, build = by_id[tool]
        return build(read(spark, paths), k, **options)
    raise ValueError(f"unknown tool {tool!r}; one of {', '.join([*by_name, *by_id])}")
