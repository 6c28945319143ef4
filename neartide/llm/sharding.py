"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots.  Bytes are summed per slot,
and a versioned slot-to-shard map says where each slot lives.  Rebalancing
edits the map; it never rehashes a record, so only the slots that an edit names
move.  The map and the totals per slot have as many rows as there are slots, a
constant, whatever the size of the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from neartide.plans.storage import materialize

SLOTS = 8192


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and a number of every row.

    A null text has no bytes (size 8, checksum 0).  Rows without doc_id are
    spread over the slots by their text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), crc)), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.monotonically_increasing_id().alias("row"),
    )


def spread(rows: DataFrame, weight: np.ndarray, shards: int) -> DataFrame:
    """``rows`` with those of hot slots hashed into all slots one by one.

    A slot is hot if it has more than a sixteenth of a shard's bytes, as where
    one doc_id has a third of all rows; a map alone could not even that out.
    """
    slots = len(weight)
    hot = np.flatnonzero(weight * shards * 16 > weight.sum())  # fewer than shards * 16
    if not len(hot):
        return rows
    anew = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(slots)).cast("int")
    return rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(hot.tolist()), anew).otherwise(F.col("virtual_slot")))


def slot_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int, shards: int) -> np.ndarray:
    """Version 1: slots dealt out in turn."""
    return np.arange(slots) % shards


def rebalanced(shard_of: np.ndarray, weight: np.ndarray, shards: int, max_edits: int = 20_000) -> np.ndarray:
    """An edit of the map: moves a slot, or swaps two, between the fullest and the emptiest shard until no such edit evens them out."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=weight, minlength=shards)
    for _ in range(max_edits):
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        give = np.flatnonzero((shard_of == full) & (weight > 0))
        take = np.flatnonzero((shard_of == empty) & (weight > 0))
        if not len(give):
            break
        moved = weight[give][:, None] - np.concatenate([[0.0], weight[take]])[None, :]
        left = np.abs(gap - 2 * moved)
        left[(moved <= 0) | (moved >= gap)] = np.inf
        i, j = np.unravel_index(left.argmin(), left.shape)
        if not left[i, j] < gap:
            break
        shard_of[give[i]] = empty
        if j:
            shard_of[take[j - 1]] = full
        load[full] -= moved[i, j]
        load[empty] += moved[i, j]
    return shard_of


def grown(shard_of: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """An edit that adds shard number ``shards``: slots move only into it, from the fullest shards, until it holds its share."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=weight, minlength=shards + 1).astype(float)
    share = weight.sum() / (shards + 1)
    for slot in np.argsort(-weight, kind="stable"):
        home = shard_of[slot]
        if home < shards and load[home] - weight[slot] >= share * 0.999 and load[shards] + weight[slot] <= share:
            shard_of[slot] = shards
            load[home] -= weight[slot]
            load[shards] += weight[slot]
    return shard_of


def map_table(spark: SparkSession, versions: list[np.ndarray]) -> DataFrame:
    """The stored map: version, virtual_slot, shard; versions count from 1."""
    rows = [(v, s, int(x)) for v, shard_of in enumerate(versions, 1) for s, x in enumerate(shard_of)]
    return materialize(spark.createDataFrame(rows, "version int, virtual_slot int, shard int"), "slotmap")


def _collected(rows: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    weight, count = np.zeros(slots), np.zeros(slots, np.int64)
    for r in slot_totals(rows).collect():  # at most one row per slot
        weight[r["virtual_slot"]], count[r["virtual_slot"]] = r["bytes"], r["rows"]
    return weight, count


def assign(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Every row of ``docs`` with its shard and its place there, by bytes.

    Returns doc_id, size, text_crc32, law, shard, slot (place in the shard, from
    0 without gaps), grown_shard (null), virtual_slot and map_version.  Null ids
    and texts, ties and repeated rows get places of their own, also where one
    doc_id has most rows; a very long text is one row of its size; an empty
    table gives no rows; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = materialize(measured(docs, slots), "slots")
    rows = spread(rows, _collected(rows, slots)[0], shards)
    weight, count = _collected(rows, slots)
    versions = [first_map(slots, shards)]
    versions.append(rebalanced(versions[0], weight, shards))
    stored = map_table(spark, versions)
    current = versions[-1]
    before = np.zeros(slots, np.int64)
    for shard in range(shards):
        own = np.flatnonzero(current == shard)
        before[own] = np.cumsum(count[own]) - count[own]
    places = spark.createDataFrame([(s, int(b)) for s, b in enumerate(before)], "virtual_slot int, before long")
    where = F.broadcast(stored.where(F.col("version") == len(versions)).join(places, "virtual_slot"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "row")
    return (
        rows.withColumn("n", F.row_number().over(order) - 1)
        .join(where, "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
        )
    )
