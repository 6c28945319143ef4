"""SimHash near-duplicates by exact comparison in tiles.

Fingerprints are cut into ``parts`` equal pieces of bits.  A tile holds the
fingerprints whose pieces have given bit counts.  Two fingerprints within
``radius`` bits have bit counts whose differences, summed over the pieces, are
at most ``radius``; all other pairs of tiles are skipped unseen.  The pairs of
tiles that remain are compared whole, by exclusive-or and bit counts.  Copies
are one fingerprint, so only distinct fingerprints are compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartide.llm import words
from neartide.operators.components import connected_components
from neartide.plans.storage import materialize, numbered

RADIUS = 3
PARTS = 4
HOME = 8192  # fingerprints of one tile that are held at once


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it; 0 for no words."""
    found = (text or b"").translate(words.LOWER_TABLE).split()
    n = len(found) - width + 1
    if not found:
        return 0
    plain = b" ".join(found)
    if n < 1:
        return xxhash.xxh64_intdigest(plain, seed)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[:n].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(plain[s:e], seed) for s, e in zip(begins, ends)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashed[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, width, seed) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(words.trimmed(run), "doc_id long, fp long")


def _offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    return [o for o in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, o)) <= radius]


def _signature(fp: np.ndarray, parts: int) -> np.ndarray:
    width = 64 // parts
    bits = fp.view(np.uint64)
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((bits >> np.uint64(width * p)) & mask) for p in range(parts)], 1).astype(np.int64)


class _Tile:
    """The fingerprints of one home tile, and the links found so far as labels that only fall."""

    def __init__(self, home: np.ndarray, radius: int):
        self.home, self.radius = home, radius
        self.label = np.arange(len(home))
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []

    def _link(self, i: np.ndarray, j: np.ndarray, others: np.ndarray, reached: np.ndarray) -> np.ndarray:
        """Home i is near others j, whose least labels so far are ``reached``: emits an edge for each fall of a label; returns the new labels of others."""
        least = reached.copy()
        while True:
            np.minimum.at(least, j, self.label[i])
            label = self.label.copy()
            np.minimum.at(label, i, least[j])
            fell = np.flatnonzero(label != self.label)
            if not len(fell):
                break
            self.u.append(self.home[fell])
            self.v.append(self.home[label[fell]])
            self.label = label
        met = np.flatnonzero(least != reached)
        self.u.append(others[met])
        self.v.append(self.home[least[met]])
        return least

    def compare(self, others: np.ndarray, own: bool = False, a: int = 128, b: int = 1024) -> None:
        mine, theirs = self.home.view(np.uint64), others.view(np.uint64)
        for j in range(0, len(theirs), b):
            right = theirs[j : j + b]
            reached = np.full(len(right), len(mine))
            for i in range(0, min(len(mine), j + b) if own else len(mine), a):
                near = np.bitwise_count(mine[i : i + a, None] ^ right[None, :]) <= self.radius
                if near.any():
                    x, y = np.nonzero(near)
                    if own:
                        apart = x + i < y + j
                        x, y = x[apart], y[apart]
                    if len(x):
                        reached = self._link(x + i, y, others[j : j + b], reached)

    def edges(self) -> pa.RecordBatch | None:
        if not self.u:
            return None
        u, v = np.concatenate(self.u), np.concatenate(self.v)
        self.u, self.v = [], []
        apart = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], names=["u", "v"])


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, home: int = HOME) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints joined by steps of at most ``radius`` bits.

    ``distinct`` has one row per fingerprint, column fp.  Tiles larger than
    ``home`` are cut into blocks; a block is held in memory, everything that it
    meets streams past it.
    """
    width, ahead = 64 // parts, [o for o in _offsets(parts, radius) if o > (0,) * parts]
    scale = np.array([(width + 1) ** (parts - 1 - p) for p in range(parts)], np.int64)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((_signature(fp, parts) @ scale).astype(np.int32))], names=["fp", "tile"])

    marked = distinct.select("fp").mapInArrow(words.trimmed(tiled), "fp long, tile int")
    # at most (64 / parts + 1) ** parts rows, 83,521 for four parts, however many fingerprints there are
    cuts = {r["tile"]: -(-r["n"] // home) for r in marked.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            sig = _signature(fp, parts)
            own = sig @ scale
            cut = np.array([cuts[t] for t in own.tolist()], np.int64)
            block = (words.mix(fp.view(np.uint64).copy()) % cut.astype(np.uint64)).astype(np.int64)
            tiles, blocks, sides, values = [own], [block], [np.zeros(len(fp), np.int8)], [fp]

            def visit(rows: np.ndarray, tile: np.ndarray, first: np.ndarray) -> None:
                count = np.array([cuts.get(t, 0) for t in tile.tolist()], np.int64) - first
                count = np.maximum(count, 0)
                which = np.repeat(np.arange(len(rows)), count)
                step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                tiles.append(tile[which])
                blocks.append(first[which] + step)
                sides.append(np.ones(len(which), np.int8))
                values.append(fp[rows[which]])

            split = np.flatnonzero(cut > 1)
            if len(split):
                visit(split, own[split], block[split] + 1)
            for o in ahead:
                to = sig + np.array(o)
                rows = np.flatnonzero(((to >= 0) & (to <= width)).all(1))
                visit(rows, to[rows] @ scale, np.zeros(len(rows), np.int64))
            arrays = [np.concatenate(x) for x in (tiles, blocks, sides, values)]
            for i in range(0, len(arrays[0]), 1 << 17):
                part = [x[i : i + (1 << 17)] for x in arrays]
                yield pa.RecordBatch.from_arrays([pa.array(part[0].astype(np.int32)), pa.array(part[1].astype(np.int32)), pa.array(part[2]), pa.array(part[3])], names=["tile", "block", "side", "fp"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tile = None, [], None
        for batch in batches:
            t, b, s, fp = (np.asarray(batch.column(i)) for i in range(4))
            change = np.flatnonzero((t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), len(t)]):
                if i == j:
                    continue
                if (t[i], b[i]) != key:
                    if held and tile is None:
                        tile = _Tile(np.concatenate(held), radius)
                        tile.compare(tile.home, own=True)
                    if tile is not None and (out := tile.edges()):
                        yield out
                    key, held, tile = (t[i], b[i]), [], None
                if s[i] == 0:
                    held.append(fp[i:j])
                    continue
                if tile is None:
                    tile = _Tile(np.concatenate(held) if held else np.empty(0, np.int64), radius)
                    tile.compare(tile.home, own=True)
                if len(tile.home):
                    tile.compare(np.ascontiguousarray(fp[i:j]))
                    if len(tile.u) > 64 and (out := tile.edges()):
                        yield out
        if held and tile is None:
            tile = _Tile(np.concatenate(held), radius)
            tile.compare(tile.home, own=True)
        if tile is not None and (out := tile.edges()):
            yield out

    return (
        distinct.select("fp").mapInArrow(words.trimmed(dealt), "tile int, block int, side byte, fp long")
        .repartition("tile", "block").sortWithinPartitions("tile", "block", "side")
        .mapInArrow(words.trimmed(met), "u long, v long")
    )


def classes(docs: DataFrame, radius: int = RADIUS, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies) of every row of ``docs``.

    component_id is the least doc_id that links of at most ``radius`` bits
    reach; copies counts the rows with the same fingerprint.  Null and wordless
    texts have fingerprint zero and are linked like any other; a null doc_id
    keeps its row and is never the least unless its class has no other.
    Very long texts are hashed whole; repeated rows are kept; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, width, seed), "prints")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "distinct")
    found = connected_components(materialize(links(least, radius), "links"))
    joined = least.join(found, least.fp == found.node, "left").withColumn("root", F.coalesce("component", "fp"))
    roots = joined.where("component is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(roots, "root", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, the one with the least doc_id.

    Classes are of rows, whatever their doc_id: rows that share one but not a
    class all stay.  A row without doc_id stays only where its class has no
    other; among equals the first row stays.  Null, empty and wordless texts are
    one class; an empty table gives no rows; columns of any name stay.
    """
    name = words.unused(docs.columns, "row")
    whole = numbered(docs, name)
    rows = whole.select(F.col(f"`{name}`").alias("row"), F.col("doc_id").cast("long").alias("own"))
    found = classes(whole.select(F.col(f"`{name}`").alias("doc_id"), "text"), radius).select(F.col("doc_id").alias("row"), "component_id")
    best = rows.join(found, "row").groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "row")).alias("best"))
    return whole.join(best.select(F.col("best.row").alias(name)), name, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
