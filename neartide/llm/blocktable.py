"""Documents as a table of blocks, and an exchange of sorted hashes between blocks.

A block holds some megabytes of text.  What blocks must learn of each other is
sent as packed messages, one per block and hash range, so that rows, sorting and
serialisation cost next to nothing beside the hashes themselves.  The answers
are sent back the same way and met with the block's text by one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartide.llm import words
from neartide.plans.storage import materialize

BLOCK_BYTES = 8 << 20
ENTRIES = 1 << 19  # hashes of one range, about

SCHEMA = "blk long, slice int, ids binary, nulls binary, lengths binary, payload binary, size long"


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """64-bit integers as compressed byte planes; of the differences if they rise."""
    values = np.ascontiguousarray(values).view(np.uint64)
    if rising:
        values = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data, rising: bool = False) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def block_table(docs: DataFrame, limit: int = BLOCK_BYTES, slices: int = 1, tag: str = "blocks") -> DataFrame:
    """Writes ``docs(doc_id, text)`` as rows of SCHEMA; the documents of a block are in order of doc_id, nulls last.

    A document is never cut, so a block is larger than ``limit`` only by its last document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, press = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        for seq, (ids, texts) in enumerate(words.blocks(batches, limit)):
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            data, _ = words.joined([texts[i] for i in order])
            row = [
                (part << 32) | seq, (part + seq) % slices, pack(np.array([ids[i] or 0 for i in order], np.int64)), bytes(ids[i] is None for i in order),
                pack(np.array([len(texts[i] or b"") for i in order], np.int64)), press.compress(data.tobytes()), len(data),
            ]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(narrow.mapInArrow(words.trimmed(run), SCHEMA), tag)


class Block:
    """One row of a block table, opened."""

    def __init__(self, row: dict):
        self.blk = row["blk"]
        self.ids = unpack(row["ids"]).view(np.int64)
        self.null = np.frombuffer(row["nulls"], bool)
        self.lengths = unpack(row["lengths"]).view(np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(row["payload"])
        self.buf = np.frombuffer(self.data, np.uint8)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths + 1)])

    def text(self, i: int) -> bytes:
        return self.data[self.begins[i] : self.begins[i] + self.lengths[i]]

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, mask=self.null)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def range_bits(table: DataFrame, bytes_per_entry: float, entries: int = ENTRIES) -> int:
    """How many leading bits of a hash name its range, so that a range has about ``entries`` hashes."""
    total = table.agg(F.sum("size")).first()[0] or 0
    return max(5, int(np.ceil(np.log2(max(1.0, total / bytes_per_entry / entries)))))


def cuts_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each hash range begins in the rising ``keys``, one more at the end."""
    return np.concatenate([np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(keys)]])


def sent(table: DataFrame, bits: int, keyed: Callable[[Block], tuple[np.ndarray, ...]]) -> DataFrame:
    """Messages (bucket, blk, keys, values): ``keyed`` gives a block's rising distinct hashes and one or more 64-bit values of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row)
            keys, *values = keyed(block)
            cuts = cuts_of(keys, bits)
            full = np.flatnonzero(np.diff(cuts))
            packed = [(int(b), pack(keys[cuts[b] : cuts[b + 1]], True), pack(np.concatenate([v[cuts[b] : cuts[b + 1]].view(np.uint64) for v in values]))) for b in full]
            if packed:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in packed], pa.int32()), pa.array([block.blk] * len(packed), pa.int64()), pa.array([p[1] for p in packed], pa.binary()), pa.array([p[2] for p in packed], pa.binary())],
                    names=["bucket", "blk", "keys", "values"],
                )

    return table.select([f.split()[0] for f in SCHEMA.split(", ")]).mapInArrow(words.trimmed(run), "bucket int, blk long, keys binary, values binary")


def gathered(messages: DataFrame, reduce: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs ``reduce(bucket, keys, values, blks, bounds)`` on all messages of each range; values has a row for each value; message i is bounds[i]:bounds[i + 1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            keys, values = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held], axis=1)
            bounds = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])])
            yield from reduce(bucket, keys, values, np.array([h[0] for h in held]), bounds)

        for row in rows_of(batches):
            if row["bucket"] != bucket:
                if held:
                    yield from done()
                bucket, held = row["bucket"], []
            keys = unpack(row["keys"], True)
            held.append((row["blk"], keys, unpack(row["values"]).reshape(-1, len(keys))))
        if held:
            yield from done()

    return messages.repartition("bucket").sortWithinPartitions("bucket", "blk").mapInArrow(words.trimmed(run), schema)


def answered(table: DataFrame, answers: DataFrame, finish: Callable[[Block, list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Meets each block with its ``answers(blk, bucket, a, b)`` and runs ``finish(block, answers)``."""
    named = [f.split() for f in SCHEMA.split(", ")]
    left = table.select("blk", F.lit(1).cast("byte").alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), *[n for n, _ in named[1:]])
    right = answers.select("blk", F.lit(0).cast("byte").alias("kind"), "bucket", "a", "b", *[F.lit(None).cast(t).alias(n) for n, t in named[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, held = None, []
        for row in rows_of(batches):
            if row["blk"] != blk:
                blk, held = row["blk"], []
            if row["kind"] == 0:
                held.append({k: row[k] for k in ("bucket", "a", "b")})
            else:
                yield from finish(Block(row), held)
                held = []

    return left.unionByName(right).repartition("blk").sortWithinPartitions("blk", "kind", "bucket").mapInArrow(words.trimmed(run), schema)
