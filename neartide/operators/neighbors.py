"""Nearest neighbours: (read_id, rank, neighbor_id, score), ranks from 1, ties to the smaller neighbor_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from neartide.functions.sequence import portable_hash, rounded, sibling, uniform
from neartide.plans.storage import materialize


def top_k(scored: DataFrame, k: int, ascending: bool = False, score: str = "score") -> DataFrame:
    """The k best neighbours of each read."""
    best = F.col(score).asc() if ascending else F.col(score).desc()
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("read_id").orderBy(best, "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("read_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", score)


# ---- sparse, through the inverted index

METRICS = ("cosine", "euclidean", "jaccard", "generalized_jaccard")


def _rows_of(weights: DataFrame) -> DataFrame:
    """One row for each read: the hashes of its features and their weights."""
    cells = F.sort_array(F.collect_list(F.struct(F.xxhash64("feature_id").alias("f"), F.col("weight").cast("double").alias("w"))))
    rows = weights.groupBy(F.col("read_id").cast("long").alias("read_id")).agg(cells.alias("c"))
    return rows.select("read_id", F.transform("c", lambda x: x["f"]).alias("f"), F.transform("c", lambda x: x["w"]).alias("w"))


class _Held:
    """Queries by feature, and the best neighbours that each has met; values are scores, of similarities the negative."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, features: np.ndarray, weights: np.ndarray, k: int, metric: str, include_self: bool, digits: int):
        self.metric, self.include_self, self.digits = metric, include_self, digits
        owner = np.repeat(np.arange(len(names), dtype=np.int32), counts)
        by = np.argsort(features, kind="stable")
        self.names, self.owner, self.weight = names, owner[by], weights[by]
        self.keys, first = np.unique(features[by], return_index=True)
        self.first = np.append(first, len(by))
        self.total = np.bincount(owner, weights=self._own(weights), minlength=len(names))
        self.value, self.near = np.full((len(names), k), np.inf), np.full((len(names), k), _NOBODY)
        self.least = weights.min() if len(weights) and weights.max() < 1 / _TINY else 0.0
        self.block, self.rounds = None, 0

    def _own(self, weights: np.ndarray) -> np.ndarray:
        return weights * weights if self.metric in ("cosine", "euclidean") else weights

    def _common(self, x: np.ndarray | float, y: np.ndarray) -> np.ndarray:
        if self.metric == "buckets":
            return np.bitwise_count(np.asarray(x).astype(np.int64) & y.astype(np.int64)).astype(np.float64)
        return x * y if self.metric in ("cosine", "euclidean") else np.minimum(x, y)

    def meet(self, names: np.ndarray, counts: np.ndarray, features: np.ndarray, weights: np.ndarray) -> None:
        """The reads ``names`` of the reference pass by."""
        if not len(self.keys) or not len(features):
            return
        who = np.repeat(np.arange(len(names)), counts)
        total = np.bincount(who, weights=self._own(weights), minlength=len(names))
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == features)
        at, who, weights = at[hit], who[hit], weights[hit]
        reach = self.first[at + 1] - self.first[at]
        ends = np.searchsorted(who, np.arange(len(names)), side="right")
        if self.metric == "cosine" and len(reach) and reach.mean() > 64 and self.least > _TINY and weights.min() > _TINY and weights.max() < 1 / _TINY:
            return self._by_product(names, total, at, who, weights, ends)
        passed = np.append(0, np.cumsum(reach))[ends]
        # so many reads at once that their meetings stay few; one read alone may have any number
        i = 0
        while i < len(names):
            begin = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(passed, (passed[i - 1] if i else 0) + _MEETINGS, side="right")))
            own = slice(begin, ends[j - 1])
            if ends[j - 1] > begin:
                many = reach[own].mean() > 64
                (self._one_by_one if many else self._together)(names, total, at[own], who[own], weights[own], reach[own])
            i = j

    def _together(self, names, total, at, who, weights, reach) -> None:
        which = np.repeat(np.arange(len(at)), reach)
        place = np.arange(len(which)) + np.repeat(self.first[at] - np.append(0, np.cumsum(reach)[:-1]), reach)
        key = self.owner[place].astype(np.int64) * len(names) + who[which]
        # the order of equal keys matters to sums of floats only
        order = np.argsort(key, kind=None if self.metric == "buckets" else "stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        shared = np.add.reduceat(self._common(weights[which], self.weight[place])[order], start)
        q, n = np.divmod(key[start], len(names))
        self._keep(q, names[n], shared, total[n])

    def _one_by_one(self, names, total, at, who, weights, reach) -> None:
        cuts = np.flatnonzero(np.append(True, who[1:] != who[:-1])).tolist() + [len(who)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            shared, met = np.zeros(len(self.names)), np.zeros(len(self.names), bool)
            for i in range(a, b):
                own = slice(self.first[at[i]], self.first[at[i] + 1])
                q = self.owner[own]
                shared[q] += self._common(weights[i], self.weight[own])
                met[q] = True
            q = np.flatnonzero(met)
            self._keep(q, np.full(len(q), names[who[a]]), shared[q], np.full(len(q), total[who[a]]))

    def _by_product(self, names, total, at, who, weights, ends) -> None:
        """Cosines where all weights are above zero: the features that a twentieth of the queries have are a block, by which the reads are multiplied; only what may be among the best is looked at."""
        n_queries = len(self.names)
        if self.block is None:
            held = np.diff(self.first)
            top = np.argsort(-held, kind="stable")[: max(1, _BLOCK // n_queries)]
            top = top[held[top] * 20 >= n_queries]  # a rarer one costs more as a column than its few meetings do
            self.row = np.full(len(self.keys), -1)
            self.row[top] = np.arange(len(top))
            self.block = np.zeros((len(top), n_queries))
            row = np.repeat(self.row, held)
            np.add.at(self.block.reshape(-1), row[row >= 0] * n_queries + self.owner[row >= 0], self.weight[row >= 0])
        root, length = np.sqrt(self.total), np.sqrt(total)
        i = 0
        while i < len(names):
            # the first reads are among the best of all
            j = min(len(names), i + max(1, min(_PRODUCT // n_queries, 8 << min(self.rounds, 20))))
            self.rounds += 1
            own = slice(ends[i - 1] if i else 0, ends[j - 1])
            feature, read, weight = at[own], who[own] - i, weights[own]
            row = self.row[feature]
            x = np.zeros((j - i, len(self.block)))
            np.add.at(x.reshape(-1), read[row >= 0] * len(self.block) + row[row >= 0], weight[row >= 0])
            shared = x @ self.block
            feature, read, weight = feature[row < 0], read[row < 0], weight[row < 0]
            reach = self.first[feature + 1] - self.first[feature]
            passed = np.cumsum(reach)
            a = 0
            while a < len(feature):
                b = max(a + 1, int(np.searchsorted(passed, (passed[a - 1] if a else 0) + _MEETINGS, side="right")))
                which = np.repeat(np.arange(a, b), reach[a:b])
                place = np.arange(len(which)) + np.repeat(self.first[feature[a:b]] - (passed[a:b] - reach[a:b]) + (passed[a - 1] if a else 0), reach[a:b])
                np.add.at(shared.reshape(-1), read[which] * n_queries + self.owner[place], weight[which] * self.weight[place])
                a = b
            # a score is rounded, so what is a little worse than the last may be as good
            bound = np.maximum((-self.value[:, -1] - 2 * 10.0**-self.digits) * root, 0.0)
            r, q = np.nonzero((shared >= length[i:j, None] * bound[None, :]) & (shared > 0))
            self._keep(q, names[i + r], shared[r, q], total[i + r])
            i = j

    def _keep(self, q: np.ndarray, near: np.ndarray, shared: np.ndarray, total: np.ndarray) -> None:
        if not self.include_self:
            others = self.names[q] != near
            q, near, shared, total = q[others], near[others], shared[others], total[others]
        own = self.total[q]
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.metric == "cosine":
                value = -shared / (np.sqrt(own) * np.sqrt(total))
            elif self.metric == "euclidean":
                value = np.sqrt(np.maximum(own + total - 2 * shared, 0.0))
            elif self.metric == "buckets":
                value = np.where(shared > 0, -shared, np.inf)
            else:
                value = -shared / (own + total - shared)
        value = np.where(np.isnan(value), _UNKNOWN, np.round(value, self.digits) + 0.0)
        worst, last = self.value[q, -1], self.near[q, -1]
        better = np.flatnonzero((value < worst) | ((value == worst) & (near < last) & (value < np.inf)))
        if not len(better):
            return
        rows, back = np.unique(q[better], return_inverse=True)
        k = self.value.shape[1]
        row = np.concatenate([np.repeat(np.arange(len(rows)), k), back])
        value = np.concatenate([self.value[rows].ravel(), value[better]])
        near = np.concatenate([self.near[rows].ravel(), near[better]])
        order = np.lexsort((near, value, row))
        row = row[order]
        pick = order[np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row] < k].reshape(len(rows), k)
        self.value[rows], self.near[rows] = value[pick], near[pick]

    def found(self) -> Iterator[pa.RecordBatch]:
        """(read_id, rank, neighbor_id, score) of every query."""
        for i in range(0, len(self.names), 1 << 16):
            value, near = self.value[i : i + (1 << 16)], self.near[i : i + (1 << 16)]
            q, r = np.nonzero(value < np.inf)
            value = value[q, r]
            score = np.where(value == _UNKNOWN, np.nan, (value if self.metric == "euclidean" else -value) + 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(self.names[i + q]), pa.array((r + 1).astype(np.int32)), pa.array(near[q, r]), pa.array(score)], names=["read_id", "rank", "neighbor_id", "score"])


_NOBODY = np.iinfo(np.int64).max
_UNKNOWN = 1e300  # stands for a score that is no number, after all others
_MEETINGS = 1 << 20
_BLOCK = 1 << 23  # numbers of the block of a lane's frequent features
_PRODUCT = 1 << 21  # products of reads and queries at once
_TINY = 1e-100  # products of weights above it are above zero
_PACK = 1 << 17  # features of the reads that travel as one row
LANE = 3 << 20  # features of the queries that one task holds
ROUND = 150 << 20  # features of the reference that are on their way at once, once for each task


def _lane_of(names: np.ndarray, lanes: int) -> np.ndarray:
    x = names.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(lanes)).astype(np.int64)


def _packs(side: int, lanes: int, wanted: range):
    """Rows of reads (read_id, f, w) as few rows of bytes: queries go to their own lane, the reference to each of ``wanted``."""

    def rows(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        names, counts, features, weights = (np.concatenate(x) for x in zip(*parts))
        lane = _lane_of(names, lanes)
        for to in wanted:
            own = slice(None) if side else lane == to
            every = slice(None) if side else np.repeat(own, counts)
            cells = (names[own], counts[own], features[every], weights[every])
            if len(cells[0]):
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([side], pa.int8()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], names=["lane", "side", "names", "counts", "f", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                f, w = some.column(1), some.column(2)
                parts.append((np.array(some.column(0)), np.asarray(f.value_lengths()).astype(np.int32), np.array(f.flatten()), np.array(w.flatten())))
                n += len(parts[-1][2])
                if n > _PACK:
                    yield from rows(parts)
                    parts, n = [], 0
        if parts:
            yield from rows(parts)

    return run


def _streamed(rows: DataFrame, other: DataFrame, k: int, metric: str, include_self: bool, digits: int, block: int | None = None) -> DataFrame:
    """(read_id, rank, neighbor_id, score): tasks hold a lane of ``rows`` each, and all of ``other`` streams past every lane; both are written tables of (read_id, f, w).

    A lane has LANE features or ``block`` reads at most, as hashes deal them.
    Lanes are worked on in rounds, so that no more than ROUND features of the
    reference, or one lane's, are on their way at once.
    """
    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("f").cast("long")), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    (reads, asked), (_, held) = size(rows), size(other)
    lanes = max(min(cores, -(-asked // 4096)), -(-asked // LANE), -(-reads // block) if block else 1, 1)
    step = max(1, min(lanes, ROUND // max(1, held)))
    schema = "lane int, side byte, names binary, counts binary, f binary, w binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, queries = None, [], None
        for batch in batches:
            for to, side, *cells in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if to != key:
                    if queries is not None:
                        yield from queries.found()
                    key, parts, queries = to, [], None
                cells = tuple(np.frombuffer(x, t) for x, t in zip(cells, (np.int64, np.int32, np.int64, np.float64)))
                if not side:
                    parts.append(cells)
                    continue
                if queries is None and parts:
                    queries = _Held(*(np.concatenate(x) for x in zip(*parts)), k, metric, include_self, digits)
                    parts = []
                if queries is not None:
                    queries.meet(*cells)
        if queries is not None:
            yield from queries.found()

    found = None
    for first in range(0, lanes, step):
        wanted = range(first, min(lanes, first + step))
        dealt = rows.select("read_id", "f", "w").mapInArrow(_packs(0, lanes, wanted), schema).unionByName(other.select("read_id", "f", "w").mapInArrow(_packs(1, lanes, wanted), schema))
        one = dealt.repartition(8 * len(wanted), "lane").sortWithinPartitions("lane", "side").mapInArrow(run, "read_id long, rank int, neighbor_id long, score double")
        if step < lanes:
            one = materialize(one, "neighbours")
        found = one if found is None else found.unionByName(one)
    return found


def sparse_topk(weights: DataFrame, k: int, metric: str = "cosine", reference: DataFrame | None = None, include_self: bool = False, digits: int = 6, block: int | None = None) -> DataFrame:
    """Exact neighbours among reads that share a feature, by one of METRICS.

    ``weights`` is (read_id, feature_id, weight).  Tasks hold the queries as
    inverted indexes with their best neighbours so far, ``block`` reads at most if given, and the
    reference streams past: no pair becomes a row before it is among the best.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    if metric == "jaccard":
        weights = weights.withColumn("weight", F.lit(1.0))
        reference = reference if reference is None else reference.withColumn("weight", F.lit(1.0))
    rows = materialize(_rows_of(weights), "sparse")
    other = rows if reference is None else materialize(_rows_of(reference), "sparse")
    return _streamed(rows, other, k, metric, include_self, digits, block)


# ---- dense, in blocks


def dense_topk(vectors: DataFrame, k: int, metric: str = "cosine", reference: DataFrame | None = None, include_self: bool = False, digits: int = 6, block: int = 16_384) -> DataFrame:
    """Exact neighbours of dense vectors (read_id, vector): blocks of the reference are held, the queries stream past each."""
    return top_k(_dense(vectors, k, metric, reference, include_self, digits, block), k, ascending=metric == "euclidean")


def dense_within(vectors: DataFrame, limit: float, metric: str = "cosine", digits: int = 6, block: int = 16_384) -> DataFrame:
    """(read_id, neighbor_id, score) of all pairs whose score is above ``limit``, or for euclidean below; the block kernel drops all others."""
    return _dense(vectors, None, metric, None, False, digits, block, limit)


def _dense(vectors: DataFrame, k: int | None, metric: str, reference: DataFrame | None, include_self: bool, digits: int, block: int, limit: float = 0.0) -> DataFrame:
    other = vectors if reference is None else reference
    # small tables are cut too, so that several tasks have a block
    n, cores = other.count(), other.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(cores, n // 512))
    held = other.select(F.pmod(F.xxhash64("read_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).cast("byte").alias("side"), F.col("read_id").cast("long"), F.col("vector").cast("array<double>"))
    asked = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).cast("byte").alias("side"), F.col("read_id").cast("long"), F.col("vector").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ids, ref = None, [], [], None
        for batch in batches:
            number, side = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            change = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if i == j:
                    continue
                if number[i] != key:
                    key, parts, ids, ref = number[i], [], [], None
                x = np.asarray(batch.column(3).slice(i, j - i).flatten()).reshape(j - i, -1)
                name = np.asarray(batch.column(2).slice(i, j - i))
                if side[i] == 0:
                    parts.append(x.copy()), ids.append(name.copy())
                    continue
                if not parts:
                    continue
                if ref is None:
                    ref, names = np.concatenate(parts), np.concatenate(ids)
                    order = np.argsort(names, kind="stable")
                    ref, names = ref[order], names[order]
                    norms = (ref * ref).sum(1)
                for a in range(0, len(x), 256):
                    part = x[a : a + 256]
                    inner = part @ ref.T
                    if metric == "cosine":
                        scale = np.sqrt((part * part).sum(1))[:, None] * np.sqrt(norms)[None, :]
                        score = -np.divide(inner, scale, out=np.zeros_like(inner), where=scale > 0)
                    elif metric == "inner":
                        score = -inner
                    elif metric == "euclidean":
                        score = np.sqrt(np.maximum((part * part).sum(1)[:, None] + norms[None, :] - 2 * inner, 0))
                    else:
                        raise ValueError(f"unknown metric {metric!r}")
                    score = np.round(score, digits) + 0.0
                    if not include_self:
                        score[name[a : a + 256][:, None] == names[None, :]] = np.inf
                    if k is None:
                        keep = np.isfinite(score) & (score < (limit if metric == "euclidean" else -limit))
                        best, value = np.broadcast_to(np.arange(len(names))[None, :], score.shape), score
                    else:
                        best, value = _least(score, k)
                        keep = np.isfinite(value)
                    q = np.broadcast_to(name[a : a + 256][:, None], best.shape)[keep]
                    out = value[keep] if metric == "euclidean" else -value[keep] + 0.0
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(names[best[keep]]), pa.array(out)], names=["read_id", "neighbor_id", "score"])

    return held.unionByName(asked).repartition("block").sortWithinPartitions("block", "side").mapInArrow(run, "read_id long, neighbor_id long, score double")


def _least(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of the k least scores of each row, the first among equals, and the scores."""
    if 4 * k >= score.shape[1]:
        best = np.argsort(score, axis=1, kind="stable")[:, :k]
        return best, np.take_along_axis(score, best, 1)
    edge = np.partition(score, k - 1, axis=1)[:, k - 1 : k]
    # everything below the k-th least, and of those that tie with it the first
    below = score < edge
    tied = (score == edge) & (np.cumsum(score == edge, axis=1) <= k - below.sum(1, keepdims=True))
    best = np.nonzero(below | tied)[1].reshape(len(score), k)
    return best, np.take_along_axis(score, best, 1)


# ---- merging and sketches


def sibling_merge(neighbors: DataFrame, k: int) -> DataFrame:
    """Joins each read's list with its sibling's mapped back; a read's own distance for a neighbour goes first.

    ``neighbors`` has read_id, neighbor_id, distance.
    """
    own = neighbors.select("read_id", "neighbor_id", "distance", F.lit(0).alias("prio"))
    other = neighbors.select(sibling(F.col("read_id")).alias("read_id"), sibling(F.col("neighbor_id")).alias("neighbor_id"), "distance", F.lit(1).alias("prio"))
    merged = own.unionByName(other).groupBy("read_id", "neighbor_id").agg(F.min(F.struct("prio", "distance")).alias("d"))
    return top_k(merged.select("read_id", "neighbor_id", F.col("d.distance").alias("distance")), k, ascending=True, score="distance")


def simhash_bits(features: DataFrame, words64: int, seed: int) -> DataFrame:
    """(read_id, sketch): for each of 64 * words64 hyperplanes the sign of the sum of +-weight, as 32-bit pieces.

    A feature's signs are the bits of its hash, so the table of signs is never stored.
    """
    pieces = words64 * 2
    signs = features.select("read_id", F.col("weight").cast("double").alias("w"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), portable_hash(F.col("feature_id"), f"{seed}.{p}").alias("h")) for p in range(pieces)])).alias("s"))
    sums = signs.groupBy("read_id", F.col("s.p").alias("p")).agg(*[F.sum(F.when(F.col("s.h").bitwiseAND(F.lit(1 << b)) != 0, F.col("w")).otherwise(-F.col("w"))).alias(f"b{b}") for b in range(32)])
    piece = sum((F.when(F.col(f"b{b}") > 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(32)), F.lit(0).cast("long"))
    packed = sums.select("read_id", "p", piece.alias("bits"))
    return packed.groupBy("read_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "bits"))), lambda x: x["bits"]).alias("sketch"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_topk(sketches: DataFrame, k: int, reference: DataFrame | None = None, block: int = 16_384) -> DataFrame:
    """Exact neighbours by differing bits, in blocks."""
    other = sketches if reference is None else reference
    n, cores = other.count(), other.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(cores, n // 2048))
    held = other.select(F.pmod(F.xxhash64("read_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).cast("byte").alias("side"), F.col("read_id").cast("long"), "sketch")
    asked = sketches.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).cast("byte").alias("side"), F.col("read_id").cast("long"), "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ids, ref = None, [], [], None
        for batch in batches:
            number, side = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            change = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if i == j:
                    continue
                if number[i] != key:
                    key, parts, ids, ref = number[i], [], [], None
                x = np.asarray(batch.column(3).slice(i, j - i).flatten()).reshape(j - i, -1)
                name = np.asarray(batch.column(2).slice(i, j - i))
                if side[i] == 0:
                    parts.append(x.copy()), ids.append(name.copy())
                    continue
                if not parts:
                    continue
                if ref is None:
                    ref, names = np.concatenate(parts), np.concatenate(ids)
                    order = np.argsort(names, kind="stable")
                    ref, names = ref[order], names[order]
                for a in range(0, len(x), 64):
                    apart = np.zeros((len(x[a : a + 64]), len(ref)), np.int64)
                    for p in range(ref.shape[1]):
                        apart += np.bitwise_count(x[a : a + 64, p][:, None] ^ ref[:, p][None, :])
                    apart[name[a : a + 64][:, None] == names[None, :]] = 1 << 30
                    best, value = _least(apart, k)
                    keep = value < 1 << 30
                    q = np.broadcast_to(name[a : a + 64][:, None], best.shape)[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(names[best[keep]]), pa.array(value[keep])], names=["read_id", "neighbor_id", "distance"])

    found = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "side").mapInArrow(run, "read_id long, neighbor_id long, distance long")
    return top_k(found, k, ascending=True, score="distance")


# ---- locality-sensitive buckets


def lowhash(features: DataFrame, repeats: int, count: int, seed: int, weighted: bool = False) -> DataFrame:
    """(read_id, repeat, feature_id): in each repeat a read keeps the ``count`` features with the least hash.

    ``weighted`` draws consistently by weight (practical consistent weighted
    sampling) from uniforms that hashes give.
    """
    keys = ["feature_id", "weight"] if weighted else ["feature_id"]

    def numbers(repeat: Column) -> Column:
        key = F.concat_ws(":", F.lit(str(seed)), repeat, F.col("feature_id"))
        return F.struct(*[uniform(key, s).alias(s) for s in ("u1", "u2", "beta", "x")]) if weighted else portable_hash(key)

    def value(u: Column) -> Column:
        gamma = -F.log(u["u1"] * u["u2"])
        y = F.exp(gamma * (F.floor(F.log(F.col("weight")) / gamma + u["beta"]) - u["beta"]))
        return rounded(-F.log(u["x"]) / (y / u["u1"]), 9)

    # hashes depend on the feature and its weight alone: they are drawn once, not for each read
    drawn = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), numbers)
    draws = features.select(*keys).distinct().withColumn("values", F.transform(drawn, value) if weighted else drawn).select("values", *[F.col(c).alias(f"_{c}") for c in keys])
    met = features.select("read_id", *keys).join(draws, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    each = met.groupBy("read_id").agg(F.collect_list(F.struct("values", "feature_id")).alias("cells")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    least = F.slice(F.sort_array(F.transform("cells", lambda x: F.struct(x["values"][F.col("repeat")].alias("value"), x["feature_id"].alias("feature_id")))), 1, count)
    return each.select("read_id", "repeat", F.explode(least).alias("c")).select("read_id", "repeat", "c.feature_id")


def bucket_neighbors(buckets: DataFrame, k: int, min_bucket: int = 2, max_bucket: int | None = None, min_cooccurrence: int = 1, reference: DataFrame | None = None) -> DataFrame:
    """Neighbours by how many buckets two reads share; buckets outside the given sizes are left out, a bucket that a read names twice counts once."""
    keys = ["feature_id", "part"]

    def packed(own: DataFrame) -> DataFrame:
        # the repeats of a feature are the bits of one weight, up to 32
        bit = F.expr("shiftleft(1L, cast(pmod(repeat, 32) as int))")
        return materialize(own.groupBy("read_id", "feature_id", F.floor(F.col("repeat") / 32).alias("part")).agg(F.bit_or(bit).alias("weight"), F.count(F.lit(1)).alias("n")), "bits")

    left = packed(buckets)
    right = left if reference is None else packed(reference)
    every = left if reference is None else left.unionByName(right)
    used, twice = every.agg(F.bit_or("weight"), F.max(F.col("n") > F.bit_count("weight"))).first()
    used = [r for r in range(32) if (used or 0) >> r & 1]
    if twice:  # a read that names a bucket twice is two of its size
        named = buckets if reference is None else buckets.unionByName(reference)
        every = named.select("feature_id", F.floor(F.col("repeat") / 32).alias("part"), F.expr("shiftleft(1L, cast(pmod(repeat, 32) as int))").alias("weight"))
    size = every.groupBy(*keys).agg(F.lit(0).alias("s"), *[F.count(F.when(F.col("weight").bitwiseAND(F.lit(1 << r)) != 0, 1)).alias(f"s{r}") for r in used])
    good = lambda s: s >= min_bucket if max_bucket is None else s.between(min_bucket, max_bucket)
    fine = size.select(*keys, sum((F.when(good(F.col(f"s{r}")), F.lit(1 << r)).otherwise(F.lit(0)) for r in used), F.lit(0).cast("long")).alias("fine")).where("fine <> 0")

    def rows(own: DataFrame) -> DataFrame:
        bits = own.join(fine, keys).withColumn("weight", F.col("weight").bitwiseAND(F.col("fine"))).where("weight <> 0")
        return materialize(_rows_of(bits.select("read_id", F.struct("feature_id", "part").alias("feature_id"), "weight")), "buckets")

    own = rows(left)
    found = _streamed(own, own if reference is None else rows(right), k, "buckets", reference is not None, 0)
    return found.where(F.col("score") >= min_cooccurrence).select("read_id", "rank", "neighbor_id", F.col("score").cast("long").alias("score"))


def lsh_topk(vectors: DataFrame, k: int, tables: int = 24, bucket_length: float = 0.6, distance: float = 2.0, seed: int = 11, metric: str = "euclidean", reference: DataFrame | None = None) -> DataFrame:
    """Approximate neighbours from bucketed random projections, by euclidean distance or by cosine, for which vectors are scaled to length one first.

    Those that share a bucket in some table and are nearer than ``distance``
    are scored in blocks; no pair becomes a row before it is among the best.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")

    def prepared(rows: DataFrame) -> DataFrame:
        v = F.col("vector").cast("array<double>")
        if metric == "cosine":
            length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
            rows = rows.where(length > 0)
            v = F.transform(v, lambda x: x / length)
        return rows.select("read_id", array_to_vector(v).alias("v"))

    data = prepared(vectors)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=bucket_length, seed=seed).fit(data)
    place = F.array(*[vector_to_array(F.col("h")[i])[0] for i in range(tables)])
    hashed = lambda rows: model.transform(rows).select("read_id", vector_to_array("v").alias("v"), place.alias("h"))
    asked, other = hashed(data), hashed(data if reference is None else prepared(reference))
    alone = reference is None  # tasks cannot hold a table
    n, cores = other.count(), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // 16_384), min(cores, n // 512))
    held = other.select(F.pmod(F.xxhash64("read_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).cast("byte").alias("side"), F.col("read_id").cast("long").alias("read_id"), "v", "h")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).cast("byte").alias("side"), F.col("read_id").cast("long").alias("read_id"), "v", "h")

    def meet(ref, x) -> Iterator[pa.RecordBatch]:
        (near, y, buckets), (name, q, own) = ref, x
        norms = (y * y).sum(1)
        step = max(1, (1 << 21) // len(near))
        for i in range(0, len(name), step):
            met = np.zeros((len(own[i : i + step]), len(near)), bool)
            for t in range(tables):
                met |= own[i : i + step, t, None] == buckets[t][None, :]
            if alone:
                met &= name[i : i + step, None] != near[None, :]
            part = q[i : i + step]
            apart = np.sqrt(np.maximum((part * part).sum(1)[:, None] + norms[None, :] - 2 * part @ y.T, 0))
            apart[~met | (apart >= distance)] = np.inf
            score = apart if metric == "euclidean" else 1 - apart * apart / 2
            best, value = _least(np.where(np.isfinite(apart), (1 if metric == "euclidean" else -1) * np.round(score, 6), np.inf) + 0.0, k)
            keep = np.isfinite(value)
            out = value[keep] if metric == "euclidean" else -value[keep] + 0.0
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(name[i : i + step, None], best.shape)[keep]), pa.array(near[best[keep]]), pa.array(out)], names=["read_id", "neighbor_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ref = None, [], None
        for batch in batches:
            number, side = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            change = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if i == j:
                    continue
                if number[i] != key:
                    key, parts, ref = number[i], [], None
                x, h = (np.array(batch.column(c).slice(i, j - i).flatten()).reshape(j - i, -1) for c in (3, 4))
                some = (np.array(batch.column(2).slice(i, j - i)), x, h)
                if side[i] == 0:
                    parts.append(some)
                    continue
                if ref is None and parts:
                    names, y, buckets = (np.concatenate(c) for c in zip(*parts))
                    order = np.argsort(names, kind="stable")
                    ref = names[order], y[order], buckets[order].T.copy()
                if ref is not None:
                    yield from meet(ref, some)

    dealt = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "side")
    return top_k(dealt.mapInArrow(run, "read_id long, neighbor_id long, score double"), k, ascending=metric == "euclidean")


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((centre * centre).sum(1)[None, :] - 2 * x @ centre.T).argmin(1)
        for c in range(len(centre)):
            if (own == c).any():
                centre[c] = x[own == c].mean(0)
    return centre


def pq_topk(vectors: DataFrame, k: int, pieces: int = 16, codes: int = 64, lists: int = 1, probes: int = 1, sample: int = 4096, rerank: int = 8, seed: int = 455_390) -> DataFrame:
    """Product quantisation: codebooks from a bounded sample, codes for every row, asymmetric distances by look-up.

    With ``lists`` > 1 rows are dealt to the nearest of that many coarse
    centres, and a query asks only its ``probes`` nearest lists.  The
    ``rerank * k`` best are scored exactly.  Vectors are scaled to length one.
    """
    rows = vectors.select(F.col("read_id").cast("long").alias("read_id"), F.col("vector").cast("array<double>").alias("vector"))
    some = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("read_id"), "read_id").limit(sample).collect()])
    if not len(some):
        return top_k(rows.select("read_id", F.col("read_id").alias("neighbor_id"), F.lit(0.0).alias("score")), k)
    some /= np.maximum(np.sqrt((some * some).sum(1, keepdims=True)), 1e-12)
    coarse = _kmeans(some, lists, seed)
    pieces = next(p for p in range(min(pieces, some.shape[1]), 0, -1) if some.shape[1] % p == 0)
    width = some.shape[1] // pieces
    books = np.stack([_kmeans(some[:, p * width : (p + 1) * width], codes, seed + p) for p in range(pieces)])

    def listed(probe: int, side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
                order = np.argsort((coarse * coarse).sum(1)[None, :] - 2 * x @ coarse.T, axis=1, kind="stable")[:, :probe]
                ids = np.repeat(np.asarray(batch.column(0)), order.shape[1])
                flat = np.repeat(x, order.shape[1], axis=0)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), pa.array(np.full(len(ids), side, np.int8)), pa.array(ids), values], names=["list", "side", "read_id", "vector"])

        return run

    schema = "list int, side byte, read_id long, vector array<double>"
    # the queries of a list are dealt to several tasks, each of which holds the list
    lanes = max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // len(coarse)))
    held = rows.mapInArrow(listed(1, 0), schema).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    asked = rows.mapInArrow(listed(min(probes, len(coarse)), 1), schema).withColumn("lane", F.pmod(F.xxhash64("read_id"), F.lit(lanes)).cast("int"))
    dealt = held.unionByName(asked).select("list", "side", "read_id", "vector", "lane")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ids, ref = None, [], [], None
        for batch in batches:
            number, side = np.asarray(batch.column(0)).astype(np.int64) * lanes + np.asarray(batch.column(4)), np.asarray(batch.column(1))
            change = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if i == j:
                    continue
                if number[i] != key:
                    key, parts, ids, ref = number[i], [], [], None
                x = np.asarray(batch.column(3).slice(i, j - i).flatten()).reshape(j - i, -1)
                name = np.asarray(batch.column(2).slice(i, j - i))
                if side[i] == 0:
                    parts.append(x.copy()), ids.append(name.copy())
                    continue
                if not parts:
                    continue
                if ref is None:
                    ref, names = np.concatenate(parts), np.concatenate(ids)
                    order = np.argsort(names, kind="stable")
                    ref, names = ref[order], names[order]
                    split = ref.reshape(len(ref), pieces, width)
                    code = np.stack([((books[p] ** 2).sum(1)[None, :] - 2 * split[:, p] @ books[p].T).argmin(1) for p in range(pieces)], 1)
                    # the sum of a query's look-ups is its product with what the codes stand for
                    coded = np.concatenate([books[p][code[:, p]] for p in range(pieces)], 1).astype(np.float32)
                step = max(1, (1 << 22) // len(ref))
                for a in range(0, len(x), step):
                    guess = x[a : a + step].astype(np.float32) @ coded.T
                    guess[name[a : a + step, None] == names[None, :]] = -np.inf
                    some = np.argpartition(-guess, min(rerank * k, len(ref) - 1), axis=1)[:, : rerank * k]
                    for q, own, best, value in zip(x[a : a + step], name[a : a + step].tolist(), some, np.take_along_axis(guess, some, 1)):
                        best = np.sort(best[np.isfinite(value)])
                        exact = np.round(1 - (ref[best] * q).sum(1), 6) + 0.0
                        pick = np.argsort(exact, kind="stable")[:k]
                        if len(pick):
                            yield pa.RecordBatch.from_arrays([pa.array([own] * len(pick), pa.int64()), pa.array(names[best[pick]]), pa.array(exact[pick])], names=["read_id", "neighbor_id", "score"])

    found = dealt.repartition("list", "lane").sortWithinPartitions("list", "lane", "side").mapInArrow(search, "read_id long, neighbor_id long, score double")
    return top_k(found, k, ascending=True)


def rp_forest_candidates(vectors: DataFrame, trees: int = 10, leaf: int = 50, sample: int = 8192, seed: int = 71) -> DataFrame:
    """(read_id, repeat, feature_id): the leaf of each vector in each random-projection tree, split at medians of a bounded sample."""
    rows = vectors.select(F.col("read_id").cast("long").alias("read_id"), F.col("vector").cast("array<double>").alias("vector"))
    n = rows.count()
    some = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("read_id"), "read_id").limit(sample).collect()])
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    rng = np.random.default_rng(seed)
    plane = rng.standard_normal((trees, depth, some.shape[1] if len(some) else 1))
    cuts: list[list[np.ndarray]] = []
    for t in range(trees):
        own, levels = np.zeros(len(some), np.int64), []
        for d in range(depth):
            value = some @ plane[t, d]
            cut = np.array([np.median(value[own == c]) if (own == c).any() else 0.0 for c in range(1 << d)])
            levels.append(cut)
            own = own * 2 + (value > cut[own])
        cuts.append(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            for t in range(trees):
                own = np.zeros(len(x), np.int64)
                for d in range(depth):
                    own = own * 2 + (x @ plane[t, d] > cuts[t][d][own])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array(own)], names=["read_id", "repeat", "feature_id"])

    return rows.mapInArrow(run, "read_id long, repeat int, feature_id long")


def scored_pairs(pairs: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", reference: DataFrame | None = None) -> DataFrame:
    """Scores candidate pairs (read_id, neighbor_id) by cosine or euclidean distance and keeps the k best."""
    v = vectors.select("read_id", F.col("vector").cast("array<double>").alias("va"))
    w = (vectors if reference is None else reference).select(F.col("read_id").alias("neighbor_id"), F.col("vector").cast("array<double>").alias("vb"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = pairs.join(v, "read_id").join(w, "neighbor_id")
    if metric == "euclidean":
        score = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    elif metric == "cosine":
        score = dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return top_k(both.select("read_id", "neighbor_id", rounded(score).alias("score")), k, ascending=metric == "euclidean")


def rp_forest_topk(vectors: DataFrame, k: int, trees: int = 32, leaf: int = 100, seed: int = 71, metric: str = "cosine", reference: DataFrame | None = None) -> DataFrame:
    """The k best of those that share a leaf with a read, in the same table or in ``reference``, whose ids are then its own."""
    if reference is None:
        leaves = rp_forest_candidates(vectors, trees, leaf, seed=seed)
        other = leaves
    else:
        both = vectors.select("read_id", "vector", F.lit(0).alias("side")).unionByName(reference.select("read_id", "vector", F.lit(1).alias("side")))
        named = both.select((F.col("read_id") * 2 + F.col("side")).alias("read_id"), "vector")
        found = rp_forest_candidates(named, trees, leaf, seed=seed)
        of = lambda side: found.where(F.pmod("read_id", F.lit(2)) == side).withColumn("read_id", F.shiftright("read_id", 1))
        leaves, other = of(0), of(1)
    found = None
    for first in range(0, trees, TREES):
        one = leaves.where(F.col("repeat").between(first, first + TREES - 1))
        two = None if reference is None else other.where(F.col("repeat").between(first, first + TREES - 1))
        best = materialize(_within_leaves(one, vectors, k, metric, two, reference), "leaves")
        found = best if found is None else found.unionByName(best)
    return top_k(found.distinct(), k, ascending=metric == "euclidean")


TREES = 8  # trees whose leaves are on their way at once


def _within_leaves(leaves: DataFrame, vectors: DataFrame, k: int, metric: str, other: DataFrame | None, reference: DataFrame | None) -> DataFrame:
    """(read_id, neighbor_id, score): for each read the k best of each of its leaves, so that no pair becomes a row before."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    side = lambda x, rows, n: x.join(rows.select("read_id", "vector"), "read_id").select("repeat", "feature_id", F.lit(n).cast("byte").alias("side"), F.col("read_id").cast("long").alias("read_id"), "vector")
    alone = reference is None  # tasks cannot hold a table
    dealt = side(leaves, vectors, 0)
    if not alone:
        dealt = dealt.unionByName(side(other, reference, 1))

    def leaf(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        sides, names, x = (np.concatenate(c) for c in zip(*parts))
        mine, theirs = (sides == 0), (sides == (0 if alone else 1))
        order = np.argsort(names[theirs], kind="stable")
        near, y, asked, x = names[theirs][order], x[theirs][order], names[mine], x[mine]
        if not len(near):
            return
        b = (y * y).sum(1)
        step = max(1, (1 << 20) // len(near))
        for i in range(0, len(x), step):
            q = x[i : i + step]
            if metric == "cosine":
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = -((q @ y.T) / np.sqrt((q * q).sum(1)[:, None] * b[None, :]))
            else:
                score = np.zeros((len(q), len(y)))
                for c in range(q.shape[1]):
                    score += (q[:, c, None] - y[None, :, c]) ** 2
                score = np.sqrt(score)
            score = np.round(score, 6) + 0.0
            score[np.isnan(score)] = _UNKNOWN
            if alone:
                score[asked[i : i + step, None] == near[None, :]] = np.inf
            best, value = _least(score, k)
            keep = value < np.inf
            out = np.where(value == _UNKNOWN, np.nan, value if metric == "euclidean" else -value + 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asked[i : i + step, None], best.shape)[keep]), pa.array(near[best[keep]]), pa.array(out[keep])], names=["read_id", "neighbor_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, own, sides, names = (np.asarray(batch.column(i)) for i in range(4))
            x = np.asarray(batch.column(4).flatten()).astype(np.float64).reshape(batch.num_rows, -1)
            change = np.flatnonzero((tree[1:] != tree[:-1]) | (own[1:] != own[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if (tree[i], own[i]) != key:
                    if parts:
                        yield from leaf(parts)
                    key, parts = (tree[i], own[i]), []
                parts.append((sides[i:j].copy(), names[i:j].copy(), x[i:j]))
        if parts:
            yield from leaf(parts)

    return dealt.repartition("repeat", "feature_id").sortWithinPartitions("repeat", "feature_id").mapInArrow(run, "read_id long, neighbor_id long, score double")


def nn_descent(vectors: DataFrame, k: int, rounds: int = 3, trees: int = 6, leaf: int = 30, seed: int = 683_985, metric: str = "cosine", width: int | None = None) -> DataFrame:
    """Neighbours of neighbours, starting from a forest's leaves; each round joins the lists both ways and keeps the ``width`` best, three times k unless given; the k best of the last count."""
    wanted, k = k, max(k, width or 3 * k)
    graph = materialize(rp_forest_topk(vectors, k, trees, leaf, seed, metric), "nnd")
    for _ in range(rounds):
        ways = graph.select("read_id", "neighbor_id").unionByName(graph.select(F.col("neighbor_id").alias("read_id"), F.col("read_id").alias("neighbor_id"))).distinct()
        # a popular read passes on at most 3k of those that list it
        ways = ways.withColumn("n", F.row_number().over(Window.partitionBy("read_id").orderBy(F.xxhash64("read_id", "neighbor_id")))).where(F.col("n") <= 3 * k).drop("n")
        hops = ways.join(graph.select(F.col("read_id").alias("neighbor_id"), F.col("neighbor_id").alias("far")), "neighbor_id").select("read_id", F.col("far").alias("neighbor_id"))
        pairs = hops.unionByName(graph.select("read_id", "neighbor_id")).where("read_id <> neighbor_id").distinct()
        graph = materialize(scored_pairs(pairs, vectors, k, metric), "nnd")
    return graph.where(F.col("rank") <= wanted)


def graph_search(queries: DataFrame, reference: DataFrame, k: int, rounds: int = 2, trees: int = 6, leaf: int = 30, seed: int = 683_985, metric: str = "cosine") -> DataFrame:
    """Neighbours of ``queries`` in ``reference``: those that share a forest's leaf, then rounds of their neighbours in the reference's own graph."""
    graph = nn_descent(reference, k, rounds, trees, leaf, seed, metric).select(F.col("read_id").alias("neighbor_id"), F.col("neighbor_id").alias("far"))
    found = materialize(rp_forest_topk(queries, k, trees, leaf, seed, metric, reference), "search")
    for _ in range(rounds):
        near = found.select("read_id", "neighbor_id")
        hops = near.join(graph, "neighbor_id").select("read_id", F.col("far").alias("neighbor_id"))
        found = materialize(scored_pairs(near.unionByName(hops).distinct(), queries, k, metric, reference), "search")
    return found
