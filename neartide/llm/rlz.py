"""Substring duplicates by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller doc_id.  The
corpus is cut into blocks, and each block is indexed by the hashes of all its
runs of ``width`` words, with the least doc_id that each starts in and the place
there.  All blocks' indexes are merged range by range, so a document is parsed
against every indexed block at once, and each run is answered with one source:
the least document and its first place there.

The parse goes greedily from left to right.  Where the run of ``width`` words at
a position has a source, a factor begins; it goes on while the next run's source
is the next place of the same document, and so is a copy of that stretch of the
source, word by word.  A position without a source is a literal word.  A factor's
end cuts through up to ``width`` - 1 runs: these are checked against the index as
well, and a factor that begins among them is marked as one at a boundary, so that
a copy pieced together from several sources loses nothing.  Words of factors are
duplicates.

Runs are compared by a 64-bit hash; two of W distinct ones share one with
chance W * W / 2 ** 65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartide.llm import words
from neartide.llm.blocktable import Block, answered, block_table, cuts_of, gathered, pack, range_bits, sent, unpack
from neartide.plans.storage import materialize

WIDTH = 13


class _Index:
    """A block's words, its windows in order of their hashes, and the groups of equal windows."""

    def __init__(self, block: Block, width: int):
        self.starts, self.ends = words.spans(block.buf)
        self.doc = np.searchsorted(block.begins, self.starts, "right") - 1
        n = max(0, len(self.starts) - width + 1)
        total = np.zeros(n, np.uint64)
        if n:
            hashed = words.hashes(block.buf, self.starts, self.ends)
            for j in range(width):
                total += hashed[j : j + n] * (words.mix(np.array([j + 1], np.uint64))[0] | np.uint64(1))
        whole = self.doc[:n] == self.doc[width - 1 :][:n] if n else np.zeros(0, bool)
        at = np.flatnonzero(whole & ~block.null[self.doc[:n]])
        keys = words.mix(total[at])
        order = np.argsort(keys, kind="stable")  # equal windows stay in order of doc_id
        self.at, keys = at[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.keys = keys[first]
        origin = self.at[first]
        self.least = block.ids[self.doc[origin]]
        self.base = np.searchsorted(self.starts, block.begins)  # a document's first word
        self.place = origin - self.base[self.doc[origin]]


def _earlier(bucket: int, keys: np.ndarray, values: np.ndarray, blks: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each block, which of its runs start in an earlier document of another block, in which, and where."""
    ids, place = values.view(np.int64)
    order = np.lexsort((place, ids, keys))
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first = np.empty(len(keys), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = np.flatnonzero(ids[first] < ids)
    cuts = np.searchsorted(hit, bounds)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        mine = [hit[cuts[i] : cuts[i + 1]] for i in full]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blks[full], pa.int64()), pa.array([bucket] * len(full), pa.int32()),
                pa.array([pack((m - bounds[i]).astype(np.uint64), True) for i, m in zip(full, mine)], pa.binary()), pa.array([pack(np.concatenate([ids[first[m]], place[first[m]]])) for m in mine], pa.binary()),
            ],
            names=["blk", "bucket", "a", "b"],
        )


def _factors(at: np.ndarray, source: np.ndarray, place: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(first word, words, source, place there, whether it begins inside the factor before) of each factor, from the runs that have a source, in order of their words."""
    follows = np.zeros(len(at), bool)  # whether a run goes on where the one before it was copied from
    follows[1:] = (at[1:] == at[:-1] + 1) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1) & (doc[at[1:]] == doc[at[:-1]])
    heads = np.flatnonzero(~follows)
    length = np.diff(np.append(heads, len(at))) + width - 1
    first = at[heads]
    inside = np.zeros(len(heads), bool)
    inside[1:] = first[1:] < first[:-1] + length[:-1]
    return first, length, source[heads], place[heads], inside


def parse(docs: DataFrame, width: int = WIDTH, with_text: bool = False, with_factors: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, n_factors, and if asked kept_text and factors.

    A word is removed if a window of ``width`` words that covers it also starts
    in a document with a smaller doc_id.  kept_sha256 is of the kept words
    joined by one space.  factors are structs (start, length, source,
    source_start, boundary) in words: words start .. start + length - 1 are those
    of document source from source_start on; boundary factors begin inside the
    one before.  Very long texts are parsed whole.
    Rows that share a doc_id are no reference to each other; a row without
    doc_id is neither reference nor parsed and keeps all words; a null or empty
    text has no words; an empty table gives no rows; other columns are not read.
    """
    table = block_table(docs, tag="rlz")
    bits = range_bits(table, 6.0)

    def keyed(block: Block) -> tuple[np.ndarray, np.ndarray]:
        index = _Index(block, width)
        return index.keys, index.least, index.place

    answers = materialize(gathered(sent(table, bits, keyed), _earlier, "blk long, bucket int, a binary, b binary"), "rlz-answers")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long"
    schema += ", kept_text string" * with_text + ", factors array<struct<start: long, length: long, source: long, source_start: long, boundary: boolean>>" * with_factors

    def finish(block: Block, held: list[dict]) -> Iterator[pa.RecordBatch]:
        index = _Index(block, width)
        source, place = index.least.copy(), index.place.copy()
        cuts = cuts_of(index.keys, bits)
        for h in held:
            which = cuts[h["bucket"]] + unpack(h["a"], True).view(np.int64)
            source[which], place[which] = unpack(h["b"]).view(np.int64).reshape(2, -1)
        origin = source[index.group]
        copied = origin < block.ids[index.doc[index.at]]
        at, origin, place = index.at[copied], origin[copied], place[index.group[copied]]
        order = np.argsort(at)
        at, origin, place = at[order], origin[order], place[order]
        first, length, origin, place, inside = _factors(at, origin, place, index.doc, width)
        n = len(index.starts)
        change = np.zeros(n + 1, np.int32)
        change[at] += 1
        change[at + width] -= 1
        gone = np.cumsum(change)[:n] > 0
        docs_n = len(block.ids)
        count = np.bincount(index.doc, minlength=docs_n)
        lost = np.bincount(index.doc[gone], minlength=docs_n)
        base = np.concatenate([[0], np.cumsum(count)])
        owner = index.doc[first]
        digests, texts = [], []
        for i in range(docs_n):
            kept = block.text(i).split()
            if lost[i]:
                kept = list(compress(kept, (~gone[base[i] : base[i + 1]]).tolist()))
            plain = b" ".join(kept)
            digests.append(hashlib.sha256(plain).hexdigest())
            if with_text:
                texts.append(plain.decode())
        arrays = [block.id_array(), pa.array(count), pa.array(lost), pa.array(digests, pa.string()), pa.array(np.bincount(owner, minlength=docs_n))]
        if with_text:
            arrays.append(pa.array(texts, pa.string()))
        if with_factors:
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=docs_n))]).astype(np.int32)
            parts = [pa.array(first - base[owner]), pa.array(length), pa.array(origin), pa.array(place), pa.array(inside)]
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=["start", "length", "source", "source_start", "boundary"])))
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"] + ["kept_text"] * with_text + ["factors"] * with_factors)

    return answered(table, answers, finish, schema)
