"""Nearest neighbours by inner product with a hash-prefix forest.

A tree gives every vector a string of 64 random-hyperplane bits and keeps the
strings sorted.  A query descends each tree to the range with its longest
common prefix; then all trees ascend together, a bit at a time, until their
ranges hold enough candidates.  Norms are levelled by one more coordinate, so
that the angle between hashes orders inner products.  The best candidates' least
score then decides which vectors are left to look at: all those whose norm still
allows as much are scored too, so that none of the nearest is lost, whatever the
norms, the mean or the length of the vectors.

Distinct vectors are indexed, whole, in shards of bounded size; each shard holds
its forest and the queries stream past it in blocks.  Copies of a vector are one
entry with its least ids, one more of them than can be asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from neartide.llm import words
from neartide.plans.storage import materialize

TREES = 96
SHARD = 8192  # vectors of one forest
SHARE = 0.5  # entries that the trees' ranges hold together when the ascent ends, of the shard's vectors
LEAST = 4096  # but at least this many
QUERIES = 512  # of a block
SEED = 20_240_601


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, share: float = SHARE, least: int = LEAST, seed: int = SEED):
        self.x = vectors
        n, dim = vectors.shape
        norm2 = (vectors * vectors).sum(1)
        self.reach = float(np.sqrt(norm2.max())) if n else 1.0
        self.falling = np.argsort(-norm2, kind="stable")  # entries from the largest norm to the least
        self.norm = np.sqrt(norm2[self.falling])
        self.slack = max(1e-5, 2.0**-23 * (dim + 2))  # of single precision, as a share of the norms' product
        self.enough = max(share * n, least)
        self.plane = np.random.default_rng(seed).standard_normal((dim + 1, trees * 64)).astype(np.float32)
        self.x32 = vectors.astype(np.float32)
        keys = self._strings(np.concatenate([vectors, np.sqrt(np.maximum(self.reach**2 - norm2, 0))[:, None]], 1))
        self.order = np.argsort(keys, axis=0, kind="stable").T.copy().astype(np.int32)
        self.keys = np.sort(keys, axis=0).T.copy()

    def _strings(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), 1024):
            bits = np.packbits(x[i : i + 1024].astype(np.float32) @ self.plane > 0, axis=1)
            out.append(np.ascontiguousarray(bits).view(">u8").astype(np.uint64))
        return np.concatenate(out) if out else np.empty((0, self.plane.shape[1] // 64), np.uint64)

    def _ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each tree's range of the strings that share the query's first ``depth`` bits: arrays (trees, queries)."""
        free = np.where(depth >= 64, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(depth, 63).astype(np.uint64))
        low = np.stack([np.searchsorted(k, s & ~free) for k, s in zip(self.keys, strings.T)])
        high = np.stack([np.searchsorted(k, s | free, "right") for k, s in zip(self.keys, strings.T)])
        return low, high

    def search(self, queries: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query its ``top`` best entries, and any that tie with the last, with exact scores."""
        scale = np.sqrt((queries * queries).sum(1))
        strings = self._strings(np.concatenate([queries * (self.reach / scale)[:, None], np.zeros((len(queries), 1))], 1))
        # ranges only widen on the way up, so the depth at which they hold enough is found by halving
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), 65, np.int64)
        while (high - low > 1).any():
            middle = (low + high) // 2
            a, b = self._ranges(strings, middle)
            enough = (b - a).sum(0) >= self.enough
            low, high = np.where(enough, middle, low), np.where(enough, high, middle)
        first, last = self._ranges(strings, low)
        least = np.full(len(queries), -np.inf)
        for i, q in enumerate(queries):
            met = np.zeros(len(self.x), bool)
            for order, a, b in zip(self.order, first[:, i].tolist(), last[:, i].tolist()):
                met[order[a:b]] = True
            found = np.flatnonzero(met)
            if len(found) > top:
                near = self.x32[found] @ q.astype(np.float32)
                # single precision only rules out what cannot be among the best
                least[i] = np.partition(near, -top)[-top] - 2 * self.slack * self.reach * scale[i]
        # an entry of less norm than least / scale cannot score as much
        count = np.searchsorted(-self.norm, -least / scale * (1 - np.sign(least) * 1e-9), "right")
        near = self.x32[self.falling[: count.max(initial=0)]] @ queries.astype(np.float32).T
        for i, q in enumerate(queries):
            found = np.sort(self.falling[: count[i]][near[: count[i], i] >= least[i]])
            score = np.add.accumulate(self.x[found] * q, axis=1)[:, -1]  # component by component, as SQL adds them up
            if len(found) > top:
                best = score >= np.partition(score, -top)[-top]
                found, score = found[best], score[best]
            yield found, score


_ROWS = "dim int, shard int, side byte, id long, ids array<long>, vector array<double>"


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector has finite components, not all zero."""
    v = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id is not null and vector is not null").where((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, column: str = "embedding", trees: int = TREES, share: float = SHARE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose vec_id is divisible by ``every``.

    Scores are added up component by component, in double precision.  Null,
    zero, null-holding and non-finite vectors and rows without vec_id take
    no part; vectors of different lengths are never compared.  Rows that repeat
    a query's vec_id are the query's own.  Ties go to the smaller vec_id; an
    empty table gives no rows; other columns are not read.
    """
    rows = materialize(usable(vectors, column), "vectors")
    # a vector's least ids are all that can be among its nearest, one of them may be the query itself
    ranked = rows.dropDuplicates(["vec_id", "vector"]).withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= top + 1)
    distinct = materialize(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    shards = max(1, -(-distinct.count() // shard))
    index = distinct.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("byte").alias("side"), F.lit(None).cast("long").alias("id"), "ids", "vector")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    asked = asked.select(F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).cast("byte").alias("side"), F.col("vec_id").alias("id"), F.lit(None).cast("array<long>").alias("ids"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, names, forest = None, [], [], None
        for batch in batches:
            dim, number, side = (np.asarray(batch.column(i)) for i in range(3))
            change = np.flatnonzero((dim[1:] != dim[:-1]) | (number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if i == j:
                    continue
                if (dim[i], number[i]) != key:
                    key, parts, names, forest = (dim[i], number[i]), [], [], None
                x = batch.column(5).slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim[i]))
                if side[i] == 0:
                    parts.append(x.copy())
                    names.extend(batch.column(4).slice(i, j - i).to_pylist())
                    continue
                if forest is None:
                    forest = Forest(np.concatenate(parts) if parts else np.empty((0, int(dim[i]))), trees, share)
                ids = np.asarray(batch.column(3).slice(i, j - i))
                for a in range(0, len(ids) if names else 0, QUERIES):
                    out: list[tuple] = []
                    for own, (found, score) in zip(ids[a : a + QUERIES].tolist(), forest.search(x[a : a + QUERIES], top + 1)):
                        every_id = [(-s, k) for f, s in zip(found.tolist(), score.tolist()) for k in names[f] if k != own]
                        every_id.sort()
                        out += [(own, k, -s) for s, k in every_id[:top]]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.float64()])], names=["query_id", "vec_id", "score"])

    found = index.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "side").mapInArrow(words.trimmed(run), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
