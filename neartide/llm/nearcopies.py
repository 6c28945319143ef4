"""Near copies by an exact join of shingle sets.

A text is the set of hashes of its runs of ``WIDTH`` words in lower case.  Texts
with the same set are one node.  Two sets whose Jaccard similarity is at least
0.8 share one of the first ``size // 5 + 1`` hashes of each, in any order that
is the same for all sets; the order here begins with hashes that a bounded
sample did not find common, so that few nodes share a first hash.

Nodes meet first by SimHash: tiles (``simhash.links``) join the fingerprints of
the shingles, and each link is compared whole.  What they leave meets by first
hashes: every pair that shares one is compared whole, unless links found before
have joined it or its sizes, its places in the order, its parities or its
counts of hashes rule the similarity out.  Nothing is left to chance but equal
64-bit hashes of different shingles or sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartide.llm import simhash, words
from neartide.operators.components import connected_components
from neartide.plans.storage import materialize, numbered

WIDTH = 5
SAMPLE = 5_000  # rows from which common hashes are known
COMMON = 3  # nodes of the sample that make a hash common
HOT = 1 << 16  # common hashes that are told apart; any number leaves the join exact
STARS = 2  # rounds after the tiles that link nodes to one other each, so that a large class needs no pairs
_STEP = words.mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one of none has no hash."""
    buf, begins = words.joined(texts)
    buf = words.lowered(buf)
    starts, ends = words.spans(buf)
    hashed = words.hashes(buf, starts, ends)
    runs = max(0, len(starts) - WIDTH + 1)
    total = np.full(runs, WIDTH, np.uint64)
    for j in range(WIDTH if runs else 0):
        total += hashed[j : j + runs] * _STEP[j]
    total = words.mix(total)
    at = np.searchsorted(starts, begins).tolist()
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= WIDTH:
            out.append(np.unique(total[a : b - WIDTH + 1]))
        elif b > a:
            out.append(words.mix((hashed[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _node(keys: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(keys.tobytes()) - (1 << 63)


def _simhash(keys: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    ones = np.unpackbits(keys.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(keys), bitorder="little").view("<i8")[0])


def _sketch(keys: np.ndarray) -> bytes:
    """How many hashes begin with each 9 bits; nothing where a count does not fit a byte."""
    counts = np.bincount((keys >> np.uint64(55)).astype(np.int64), minlength=512)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _parities(keys: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of hashes begin with each 9 bits.  Two sets' bits differ in no more places than the sets do."""
    return np.packbits((np.bincount((keys >> np.uint64(55)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).view(np.int64)


def _odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, keys) as node and the eight words of its parities."""
    for batch in batches:
        found = np.array([_parities(np.frombuffer(k, np.uint64)) for k in batch.column(1).to_pylist()], np.int64).reshape(-1, 8)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i].copy()) for i in range(8))], names=["node", *ODD])


ODD = [f"odd{i}" for i in range(8)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in words.blocks(batches, 1 << 20):
        found = shingles(texts)
        arrays = [pa.array(map(_node, found), pa.int64()), pa.array(map(_sketch, found), pa.binary()), pa.array([k.tobytes() for k in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["node", "sketch", "keys"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, _row, first) as one row (key, _row, pos) per key; copies of a node seen by the task are left out."""
    seen: set[int] = set()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows, keys = [], []
            for node, row, first in zip(*(c.to_pylist() for c in part.columns)):
                if node not in seen:
                    rows.append(row)
                    keys.append(np.frombuffer(first, np.int64))
                    seen.add(node)
            if len(seen) > 1 << 17:
                seen.clear()
            if rows:
                n = list(map(len, keys))
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(rows, np.int64), n)), pa.array(pos)], names=["key", "_row", "pos"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes that at least COMMON of the task's nodes have, rarest first."""
    sets: dict[int, np.ndarray] = {}
    for _, texts in words.blocks(batches, 1 << 20):
        sets.update((_node(k), k) for k in shingles(texts))
    if sets:
        keys, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        keys, n = keys[n >= COMMON], n[n >= COMMON]
        yield pa.RecordBatch.from_arrays([pa.array(keys[np.argsort(n, kind="stable")][-HOT:].view(np.int64))], names=["key"])


def _common(rows: DataFrame, sample: int) -> np.ndarray:
    """The hashes that are common in about ``sample`` rows, which one task reads, rarest first."""
    share = int(min(1.0, sample / max(1, rows.count())) * 1_000_000)
    some = rows.where(F.pmod(F.xxhash64("_row"), F.lit(1_000_000)) < share).select("_row", "text")
    found = some.repartition(1).mapInArrow(words.trimmed(_counted), "key long").collect()
    return np.array([r["key"] for r in found], np.int64).view(np.uint64)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key, in the first column, some other row has; rows come in order of it."""
    held, before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = np.asarray(batch.column(0))
        same = key[1:] == key[:-1]
        left = np.concatenate([[before], same])
        keep = left[:-1] | same
        held, before = batch.slice(batch.num_rows - 1), bool(left[-1])
        if keep.any():
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep))
    if before:
        yield held


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """key and (node, size, pos, print, label and what follows) of its distinct nodes where they differ in label; rows come in order of key, size and node."""
    key, parts = None, []

    def whole() -> Iterator[tuple[np.ndarray, ...]]:
        columns = [np.concatenate(c) for c in zip(*parts)]
        if (columns[4] != columns[4][0]).any():
            new = np.concatenate([[True], columns[0][1:] != columns[0][:-1]])
            yield (key, *(c[new] for c in columns))

    for batch in batches:
        k, *columns = (np.asarray(c) for c in batch.columns)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            if parts and k[i] != key:
                yield from whole()
                parts = []
            key = k[i]
            parts.append([c[i:j] for c in columns])
    if parts:
        yield from whole()


def _may(size: np.ndarray, pos: np.ndarray, i: int, j: slice | np.ndarray) -> np.ndarray:
    """Whether the sizes allow the similarity of i with j, and what follows this key in both sets does, if it is their first in common."""
    a, b = int(size[i]), size[j].astype(np.int64)
    return (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (9 * np.minimum(a - int(pos[i]), b - pos[j]) >= 4 * (a + b))


def _even(size: np.ndarray, odd: list[np.ndarray], i: int, j: np.ndarray) -> np.ndarray:
    """Of ``j`` those whose parities allow the similarity with i: sets that alike differ in no more than a ninth of both."""
    apart = np.zeros(len(j), np.int64)
    for c in odd:
        apart += np.bitwise_count((c[j] ^ c[i]).view(np.uint64))
    return j[9 * apart <= int(size[i]) + size[j].astype(np.int64)]


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each list that may be similar to another one; of very long lists, all."""
    for key, node, size, pos, prints, _ in _lists(batches):
        keep = np.full(len(node), len(node) > 4096)
        for i in range(0 if keep[0] else len(node) - 1):
            near = np.flatnonzero(_may(size, pos, i, slice(i + 1, None))) + i + 1
            keep[near] = True
            keep[i] |= len(near) > 0
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), key)), *(pa.array(c[keep]) for c in (node, size, pos, prints))], names=["key", "node", "size", "pos", "print"])


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, bits): in each list, each node beside the lead of the nodes of other labels than its own, and how many bits of their SimHash differ.

    The lead of some nodes is the one whose SimHash is nearest to the majority
    of theirs.  Nodes of the label that most of a list have go by the lead of
    the others, the others by the lead of that label.
    """
    for _, node, size, pos, prints, label, *odd in _lists(batches):
        labels, index, n = np.unique(label, return_inverse=True, return_counts=True)
        most = index == n.argmax()
        for own, others in ((most, ~most), (~most, most)):
            lead = np.flatnonzero(others)
            bits = np.unpackbits(prints[lead].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            middle = np.packbits(2 * bits > len(lead), bitorder="little").view(np.uint64)[0]
            lead = int(lead[np.lexsort((node[lead], np.bitwise_count(prints[lead].view(np.uint64) ^ middle)))[0]])
            found = _even(size, odd, lead, np.flatnonzero(own & _may(size, pos, lead, slice(None))))
            if len(found):
                apart = np.bitwise_count(prints[found].view(np.uint64) ^ prints[lead].view(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(np.full(len(found), node[lead])), pa.array(apart)], names=["a", "b", "bits"])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair of a list that may be similar and differs in label."""
    out, n = [], 0
    for _, node, size, pos, _, label, *odd in _lists(batches):
        for i in range(len(node) - 1):
            j = _even(size, odd, i, np.flatnonzero((label[i + 1 :] != label[i]) & _may(size, pos, i, slice(i + 1, None))) + i + 1)
            if len(j):
                out.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
                n += len(j)
            if n > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b"])
                out, n = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that counts of hashes by their first bits (x, y) do not rule out."""
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if x and y:
                p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                keep[i] = 9 * int(np.minimum(p, q).sum()) >= 4 * (int(p.sum()) + int(q.sum()))
        if keep.any():
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            keep[i] = 9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q))  # both / (p + q - both) >= 4 / 5
        if keep.any():
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, as edges (u, v)."""

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        one, two = (sets.select(F.col("node").alias(n), F.col(column).alias(k)) for n, k in (("a", "x"), ("b", "y")))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    left = materialize(beside(pairs, "sketch").mapInArrow(words.trimmed(_bounded), "a long, b long"), "near-pairs")
    return materialize(beside(left, "keys").mapInArrow(words.trimmed(_near), "u long, v long"), "near-links")


def _tiled(signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash brings together: those of one fingerprint, and of fingerprints that a tile links."""
    prints = materialize(signed.groupBy("print").agg(F.min("node").alias("lead")), "near-prints")
    found = materialize(simhash.links(prints.select(F.col("print").alias("fp"))), "near-tiles").distinct()
    one, two = (prints.select(F.col("print").alias(p), F.col("lead").alias(n)) for p, n in (("u", "a"), ("v", "b")))
    same = signed.join(prints, "print").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return materialize(found.join(one, "u").join(two, "v").select("a", "b").unionByName(same).where("a <> b").distinct(), "near-tiled")


def representatives(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class of rows joined by links of similarity at least 0.8.

    The one with the least doc_id stays; a row without doc_id only where its
    class has no other; among equals the one with the least hash of its text's
    shingles.  Rows that share a doc_id but not a class all stay.  Texts
    without words, and null ones, are one class; an empty table gives no rows.
    """
    name = words.unused(docs.columns, "_row")
    whole = numbered(docs, name)
    rows = whole.select(F.col(f"`{name}`").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = _common(rows, sample)
    order = np.argsort(common)
    known, rank = common[order], order + 1

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in words.blocks(batches, 1 << 20):
            found = shingles(texts)
            first = []
            for keys in found:
                if len(known) and len(keys):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    keys = keys[np.argsort(np.where(known[at] == keys, rank[at], 0), kind="stable")]
                first.append(keys[: len(keys) // 5 + 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(_node, found), pa.int64()), pa.array(map(len, found), pa.int32()), pa.array(map(_simhash, found), pa.int64()), pa.array(first, pa.binary())], names=["_row", "node", "size", "print", "first"]
            )

    signed = materialize(rows.select("_row", "text").mapInArrow(words.trimmed(sign), "_row long, node long, size int, print long, first binary"), "near-signs")
    ids = rows.select("_row", "doc_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "_row")).alias("best")
    nodes = materialize(signed.select("_row", "node").join(ids, "_row").groupBy("node").agg(best), "near-nodes")
    tiled = _tiled(signed.select("node", "print"))
    postings = signed.select("node", "_row", "first").mapInArrow(words.trimmed(_postings), "key long, _row long, pos int")
    repeated = materialize(postings.repartition("key").sortWithinPartitions("key").mapInArrow(words.trimmed(_repeated), "key long, _row long, pos int"), "near-repeated")
    members = repeated.join(signed.select("_row", "node", "size", "print"), "_row").select("key", "node", "size", "pos", "print", F.col("node").alias("label"))
    shared = materialize(members.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(words.trimmed(_hopeful), "key long, node long, size int, pos int, print long"), "near-shared")
    met = shared.select("node").distinct().join(nodes, "node").select(F.col("best._row").alias("_row"))
    sets = materialize(rows.select("_row", "text").join(met, "_row").mapInArrow(words.trimmed(_sets), "node long, sketch binary, keys binary"), "near-sets")

    parities = sets.select("node", "keys").mapInArrow(words.trimmed(_odd), "node long, " + ", ".join(f"{c} long" for c in ODD))
    shared = materialize(shared.join(parities, "node").select("key", "node", "size", "pos", "print", *ODD), "near-marked")

    found = None
    for step in range(STARS + 2):
        if step == 0:
            pairs = tiled
        else:
            label = shared.withColumn("label", F.col("node")) if found is None else shared.join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
            lists = label.select("key", "node", "size", "pos", "print", "label", *ODD).repartition("key").sortWithinPartitions("key", "size", "node")
            if step <= STARS:
                each = lists.mapInArrow(words.trimmed(_starred), "a long, b long, bits int")
                pairs = each.groupBy("a").agg(F.min(F.struct("bits", F.xxhash64("a", "b", F.lit(step)).alias("h"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
            else:
                pairs = lists.mapInArrow(words.trimmed(_crossed), "a long, b long").distinct()
            pairs = materialize(pairs, "near-met")
        # a step without pairs or links costs no joins, and no plans of the driver
        if pairs.isEmpty() or (new := _linked(pairs, sets)).isEmpty():
            continue
        if found is not None:
            new = new.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
        found = connected_components(new)

    named = nodes.withColumn("class", F.col("node")) if found is None else nodes.join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    classes = named.groupBy("class").agg(F.min("best").alias("best"))
    return whole.join(classes.select(F.col("best._row").alias(name)), name, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
