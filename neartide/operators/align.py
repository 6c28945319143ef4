"""Semiglobal alignment of weighted token sequences, and of the pairs of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 1_000_000_000


def align(x: list, y: list, wx: list, wy: list, max_cells: int = MAX_CELLS) -> tuple[int, list[int], list[int]]:
    """(score, places in x, places in y); -1 is a gap.

    Equal tokens score the larger of their weights, unequal ones lose it, a
    skipped token loses its own weight, and both ends are free.  The best end is
    in the last column or else the last row; paths prefer the diagonal, then a
    gap in y, then one in x.  Pairs over ``max_cells`` are not aligned.
    """
    n, m = len(x), len(y)
    if not n or not m or n * m > max_cells:
        return 0, [], []
    a, b = np.asarray(wx, np.int64), np.asarray(wy, np.int64)
    same = np.array([[p == q for q in y] for p in x]).reshape(n, m) if n * m < 4096 else np.asarray(x, object)[:, None] == np.asarray(y, object)[None, :]
    gain = np.maximum(a[:, None], b[None, :]) * np.where(same, 1, -1)
    table = np.zeros((n + 1, m + 1), np.int64)
    for i in range(1, n + 1):
        row, above = table[i], table[i - 1]
        best = np.maximum(above[:-1] + gain[i - 1], above[1:] - a[i - 1])
        left = 0
        for j in range(1, m + 1):
            left = max(int(best[j - 1]), left - int(b[j - 1]))
            row[j] = left
    i, j = int(table[:, m].argmax()), m
    if table[n].max() > table[i, m]:
        i, j = n, int(table[n].argmax())
    score = int(table[i, j])
    if score <= 0:
        return 0, [], []
    first, second = [], []
    while i > 0 and j > 0:
        here = table[i, j]
        if here == table[i - 1, j - 1] + gain[i - 1, j - 1]:
            i, j = i - 1, j - 1
            first.append(i), second.append(j)
        elif here == table[i - 1, j] - a[i - 1]:
            i -= 1
            first.append(i), second.append(-1)
        else:
            j -= 1
            first.append(-1), second.append(j)
    return score, first[::-1], second[::-1]


def align_pairs(pairs: DataFrame, sequences: DataFrame, done: DataFrame | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """Aligns (u, v) pairs of ``sequences(read_id, elements, weights)``; pairs of ``done`` are left out."""
    if done is not None:
        pairs = pairs.join(done.select("u", "v"), ["u", "v"], "left_anti")
    x = sequences.select(F.col("read_id").alias("u"), F.col("elements").alias("x"), F.col("weights").alias("wx"))
    y = sequences.select(F.col("read_id").alias("v"), F.col("elements").alias("y"), F.col("weights").alias("wy"))
    schema = "u long, v long, score long, idx1 array<int>, idx2 array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, v, *align(p, q, wp, wq, max_cells)) for u, v, p, wp, q, wq in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["u", "v", "score", "idx1", "idx2"])

    joined = pairs.select("u", "v").join(x, "u").join(y, "v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "x", "wx", "y", "wy")
    return joined.mapInArrow(run, schema)
