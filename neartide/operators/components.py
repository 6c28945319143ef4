"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartide.plans.storage import materialize

SMALL = 1 << 17  # edges that one task ends at once; more go in rounds


def _star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """A star in place of the edges: every node, least ones too, beside the least node of its piece."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["u", "v"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of each batch by stars."""
    for batch in batches:
        yield _star(*(np.asarray(batch.column(i)) for i in (0, 1)))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of all batches by stars."""
    found = [[np.asarray(batch.column(i)) for i in (0, 1)] for batch in batches if batch.num_rows]
    if found:
        star = _star(*(np.concatenate(c) for c in zip(*found)))
        yield pa.RecordBatch.from_arrays(star.columns, names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 64, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the least node id reached.

    Each batch's edges become stars; of these no more than ``small`` are joined
    by one task.  More alternate the large-star and small-star rewrites until
    all are stars, so a path of any length takes a logarithmic number of
    rounds, each written to the shared folder.  Self-loops and repeated edges
    do no harm; null ends are ignored.  Nodes only in self-loops are kept.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    stars = materialize(edges.mapInArrow(_contracted, "u long, v long"), "edges")
    if stars.count() <= small:
        return materialize(stars.coalesce(1).mapInArrow(_whole, "node long, component long"), "components")
    loops = stars.where("u = v").select(F.col("u").alias("node")).distinct()
    state = stars.where("u <> v")
    seen = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        state = materialize(small, "edges")
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now["n"]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = leaves.unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
