"""Dimension reduction of sparse features (read_id, feature_id, weight) and dense vectors (read_id, vector)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from neartide.functions.sequence import HASH_RANGE, portable_hash


def hashed_projection(features: DataFrame, dims: int, density: float, seed: int) -> DataFrame:
    """(read_id, dim, value): sparse random projection whose matrix is never stored.

    A cell (feature, dim) is non-zero if its hash is in the lowest ``density``;
    the hash's last bit is its sign, and the scale is sqrt(1 / density / dims).
    """
    used = features.select("feature_id").distinct()
    cells = used.select("feature_id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim")).withColumn("h", portable_hash(F.concat_ws(":", "feature_id", "dim"), seed))
    cells = cells.where(F.col("h") <= int(density * HASH_RANGE)).select("feature_id", "dim", F.when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    scale = math.sqrt(1.0 / density / dims)
    return features.join(cells, "feature_id").groupBy("read_id", "dim").agg((F.sum(F.col("weight") * F.col("sign")) * scale).alias("value"))


def sign_projection(features: DataFrame, dims: int, seed: int) -> DataFrame:
    """(read_id, dim, value): signed sums under hashed +-1 hyperplanes; the sign of value is the SimHash bit."""
    used = features.select("feature_id").distinct()
    cells = used.select("feature_id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"))
    cells = cells.withColumn("sign", F.when(portable_hash(F.concat_ws(":", "feature_id", "dim"), seed) % 2 == 0, 1.0).otherwise(-1.0))
    return features.join(cells, "feature_id").groupBy("read_id", "dim").agg(F.sum(F.col("weight") * F.col("sign")).alias("value"))


def _applied(vectors: DataFrame, change, column: str = "vector") -> DataFrame:
    """Applies ``change`` to the matrix of each batch's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.ascontiguousarray(change(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)), np.float64)
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["read_id", "vector"])

    return vectors.select(F.col("read_id").cast("long").alias("read_id"), F.col(column).cast("array<double>").alias("vector")).mapInArrow(run, "read_id long, vector array<double>")


def gaussian_projection(vectors: DataFrame, in_dims: int, dims: int, seed: int = 2094) -> DataFrame:
    """One seeded Gaussian matrix for all rows, variance 1 / dims."""
    matrix = np.random.default_rng(seed).standard_normal((in_dims, dims)) / math.sqrt(dims)
    return _applied(vectors, lambda x: x @ matrix)


def gram(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross products of the columns: one small matrix for each partition is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(s.size + g.size + 1), pa.int32()), pa.array(np.concatenate([[n], s, g.ravel()]))], names=["i", "x"])

    cells = vectors.select(F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    if not cells:
        return 0, np.zeros(0), np.zeros((0, 0))
    flat = np.array([c["x"] for c in cells])
    dim = int((math.isqrt(4 * len(flat) - 3) - 1) // 2)
    return int(flat[0]), flat[1 : 1 + dim], flat[1 + dim :].reshape(dim, dim)


def pca(vectors: DataFrame, dims: int) -> DataFrame:
    """Principal components of the centred vectors; each component's largest loading is positive."""
    n, total, cross = gram(vectors)
    if not n:
        return _applied(vectors, lambda x: x[:, :dims])
    mean = total / n
    _, axes = np.linalg.eigh(cross / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dims]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return _applied(vectors, lambda x: (x - mean) @ axes)


def truncated_svd(vectors: DataFrame, dims: int) -> DataFrame:
    """Projections on the leading right singular vectors, without centring."""
    n, _, cross = gram(vectors)
    if not n:
        return _applied(vectors, lambda x: x[:, :dims])
    _, axes = np.linalg.eigh(cross)
    axes = axes[:, ::-1][:, :dims]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return _applied(vectors, lambda x: x @ axes)


def spectral_embedding(vectors: DataFrame, dims: int, weighted: bool = True) -> DataFrame:
    """Spectral embedding of the cosine graph, matrix free.

    Rows are scaled to length one; the degree of a row is its summed similarity
    less its own.  With Z the rows divided by the root of their degrees, the
    eigenvectors of Z Zt follow from those of the small Zt Z.  Rows of no
    positive degree get zeros.
    """
    unit = _applied(vectors, lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12))
    n, total, _ = gram(unit)
    if not n:
        return unit

    def scaled(x: np.ndarray) -> np.ndarray:
        degree = x @ total - 1
        return np.where(degree[:, None] > 1e-9, x / np.sqrt(np.maximum(degree, 1e-9))[:, None], 0.0)

    z = _applied(unit, scaled)
    _, _, cross = gram(z)
    value, axes = np.linalg.eigh(cross)
    pick = np.argsort(-value)[:dims]
    pick = pick[value[pick] > 1e-12]
    axes = axes[:, pick] * np.sign(axes[:, pick][np.abs(axes[:, pick]).argmax(0), np.arange(len(pick))])
    # left vectors are Z axes / sqrt(value); weighting multiplies by sqrt(value) again
    return _applied(z, lambda x: x @ axes if weighted else x @ axes / np.sqrt(value[pick]))


def bipartite_map(vectors: DataFrame, dims: int) -> DataFrame:
    """Bipartite spectral map of non-negative rows: both sides scaled by their sums, rows of length one."""
    n, total, _ = gram(vectors)
    if not n:
        return vectors

    def checked(x: np.ndarray) -> np.ndarray:
        if (x < 0).any():
            raise ValueError("bipartite_map needs non-negative values")
        return x

    side = _applied(vectors, lambda x: np.concatenate([checked(x) * 0, x / np.maximum(x.sum(1, keepdims=True), 1e-12)], 1)[:, x.shape[1] :])
    _, weight, _ = gram(side)
    scale = 1 / np.sqrt(np.maximum(weight, 1e-12))
    _, _, cross = gram(_applied(vectors, lambda x: x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1e-12)) * scale))
    value, axes = np.linalg.eigh(cross)
    axes = axes[:, np.argsort(-value)[:dims]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    loads = axes * scale[:, None]

    def out(x: np.ndarray) -> np.ndarray:
        u = x / np.maximum(x.sum(1, keepdims=True), 1e-12) @ loads
        return u / np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-12)

    return _applied(vectors, out)


def feature_subsample(features: DataFrame, multiple: int, seed: int) -> DataFrame:
    """Keeps the largest multiple of ``multiple`` features, those with the least hash."""
    used = features.select("feature_id").distinct()
    keep = used.count() // multiple * multiple
    chosen = used.orderBy(portable_hash(F.col("feature_id"), seed), "feature_id").limit(keep)
    return features.join(chosen, "feature_id", "left_semi")


def near_equal_parts(rows: DataFrame, parts: int, order: list[str]) -> DataFrame:
    """Numbers rows 1..parts in order; the first parts take the remainder.

    Ranges of the order are counted first, so that no task sees all rows.
    """
    n = rows.count()
    each, more = divmod(n, parts)
    number = dense_number(rows, order)
    return number.withColumn(
        "part", F.when(F.col("number") < more * (each + 1), F.col("number") / F.lit(each + 1)).otherwise(more + (F.col("number") - more * (each + 1)) / F.lit(max(1, each))).cast("int") + 1
    ).drop("number")


def dense_number(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``number``: 0, 1, 2 ... in ``order``, by sorted ranges and their sizes."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id())
    ranged = ranged.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(*order)) - 1)
    sizes = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # one row a partition
    return ranged.join(F.broadcast(before), "p").withColumn("number", F.col("before") + F.col("i")).drop("p", "i", "before")
