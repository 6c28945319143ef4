"""Vectorised words and word hashes over the bytes of many documents at once.

Every function here works on one block of documents joined by a line feed, so
that the cost in Python is per block, not per document or word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes that separate words of class [^\x20\x09-\x0D]+
SPACES = b"\t\n\x0b\x0c\r "

_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = _LOWER.tobytes()
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xBF58476D1CE4E5B9)
_K3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= _K2
    x ^= x >> np.uint64(27)
    x *= _K3
    x ^= x >> np.uint64(31)
    return x


def spans(buf: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of word bytes."""
    inside = np.zeros(len(buf) + 2, bool)
    np.take(is_word, buf, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    lengths = ends - starts
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", buffer=padded, strides=(1,))
    out = mix((lengths.astype(np.uint64) + np.uint64(seed)) * _K1 + _K3)
    left, at, which = lengths, starts, None
    while len(at):
        lane = lanes[at] & _MASK[np.minimum(left, 8)]
        if which is None:
            out = mix((out ^ lane) * _K1)
        else:
            out[which] = mix((out[which] ^ lane) * _K1)
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        left, at = left[more] - 8, at[more] + 8
    return out


def blocks(batches: Iterable[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[tuple[list, list]]:
    """(ids, texts as bytes or None) of consecutive documents, up to about ``limit`` bytes of text."""
    ids: list = []
    texts: list = []
    total = 0
    for batch in batches:
        for part in parts(batch, 1, limit):
            for k, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()):
                ids.append(k)
                texts.append(text)
                total += len(text or b"") + 1
                if total >= limit:
                    yield ids, texts
                    ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; what it freed goes back to the machine when its task ends, as Spark keeps its workers for other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def parts(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with up to about ``limit`` bytes in a string or binary column; a longer value is a slice of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes + 1) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts[:-1], cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores in front of it until no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one buffer with a line feed after each, and where each starts (one more at the end)."""
    data = b"\n".join(t or b"" for t in texts) + b"\n"
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=begins[1:])
    return np.frombuffer(data, np.uint8), begins


def lowered(buf: np.ndarray) -> np.ndarray:
    return np.take(_LOWER, buf)
