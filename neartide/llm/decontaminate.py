"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments.  A segment holds the postings of one stretch
of training documents, term by term: the positions at which each benchmark term
stands.  Terms that no benchmark item has can match nothing and are not stored.
A query is a window of item words.  Its candidates are the postings of its
rarest term in the corpus, shifted to where the window would begin; they are
intersected with the shifted postings of the other terms, rarest first, until
exact phrases are left.  Proximity matches ask only that the rarest few terms
stand within some words of each other.

The benchmark is collected in blocks of bounded size; one larger than a block
takes one pass over the documents for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartide.llm import words
from neartide.llm.blocktable import pack, rows_of, unpack
from neartide.plans.storage import materialize

WINDOW = 10
SLOP = 12
NEAR_TERMS = 4
QUERY_BYTES = 32 << 20

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = True
_ALNUM[97:123] = True
_ALNUM[128:] = True

_SHIFT = np.uint64(40)
_SEGMENT = "seg long, ids binary, nulls binary, n_words binary, terms binary, counts binary, positions binary"


class _Windows:
    """The distinct windows of some items, as term numbers."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        texts = [t for _, t in items]
        buf, begins = words.joined(texts)
        buf = words.lowered(buf)
        starts, ends = words.spans(buf, _ALNUM)
        keys = words.hashes(buf, starts, ends)
        self.terms, term = np.unique(keys, return_inverse=True)
        doc = np.searchsorted(begins, starts, "right") - 1
        cuts = np.searchsorted(doc, np.arange(len(items) + 1))
        found: dict[tuple, set] = {}
        for i, (name, _) in enumerate(items):
            own = term[cuts[i] : cuts[i + 1]].tolist()
            for j in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(tuple(own[j : j + width]), set()).add(name)
        self.names = [sorted(x) for x in found.values()]
        self.length = np.array([len(x) for x in found], np.int64)
        self.term = np.array([list(x) + [-1] * (width - len(x)) for x in found], np.int64).reshape(-1, width)

    def by_rarity(self, frequency: np.ndarray) -> None:
        """Orders each window's terms from the rarest; windows with a term that the corpus lacks go."""
        count = np.where(self.term >= 0, frequency[self.term], np.iinfo(np.int64).max)
        some = (count > 0).all(1)
        self.names = [n for n, s in zip(self.names, some) if s]
        self.length, self.term, count = self.length[some], self.term[some], count[some]
        self.offset = np.argsort(count, axis=1, kind="stable")
        self.term = np.take_along_axis(self.term, self.offset, 1)


class _Segment:
    """The postings of one segment: term << 40 | position, rising.  Documents are one position apart."""

    def __init__(self, n_words: np.ndarray, postings: np.ndarray):
        self.n_words, self.postings = n_words, postings
        self.begins = np.concatenate([[0], np.cumsum(n_words + 1)])

    @classmethod
    def stored(cls, row: dict) -> "_Segment":
        return cls(unpack(row["n_words"]).view(np.int64), unpack(row["positions"], True))

    @classmethod
    def of(cls, texts: list[bytes | None], terms: np.ndarray) -> "_Segment":
        """The postings of the rising term hashes ``terms`` in some texts."""
        buf, begins = words.joined(texts)
        buf = words.lowered(buf)
        starts, ends = words.spans(buf, _ALNUM)
        doc = np.searchsorted(begins, starts, "right") - 1
        keys = words.hashes(buf, starts, ends)
        if len(terms):
            at = np.minimum(np.searchsorted(terms, keys), len(terms) - 1)
            hit = np.flatnonzero(terms[at] == keys)
        else:
            at = hit = np.empty(0, np.int64)
        return cls(np.bincount(doc, minlength=len(texts)).astype(np.int64), np.sort((at[hit].astype(np.uint64) << _SHIFT) | (hit + doc[hit]).astype(np.uint64)))

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """The terms that stand here and how often."""
        return np.unique(self.postings >> _SHIFT, return_counts=True)

    def slices(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = term.astype(np.uint64) << _SHIFT
        return np.searchsorted(self.postings, low), np.searchsorted(self.postings, low + (np.uint64(1) << _SHIFT))

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        if not len(self.postings):
            return np.zeros(len(term), bool)
        key = (term.astype(np.uint64) << _SHIFT) | position.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return self.postings[at] == key

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        first = (term.astype(np.uint64) << _SHIFT) | low.astype(np.uint64)
        last = (term.astype(np.uint64) << _SHIFT) | high.astype(np.uint64)
        return np.searchsorted(self.postings, first) < np.searchsorted(self.postings, last, "right")

    def candidates(self, windows: _Windows, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its rarest term), some millions at a time."""
        low, high = self.slices(windows.term[:, 0])
        size = high - low
        full = np.flatnonzero(size)
        part = np.cumsum(size[full]) // most
        for p in np.unique(part):
            which = full[part == p]
            window = np.repeat(which, size[which])
            step = np.arange(len(window)) - np.repeat(np.cumsum(size[which]) - size[which], size[which])
            yield window, (self.postings[low[window] + step] & ((np.uint64(1) << _SHIFT) - np.uint64(1))).astype(np.int64)

    def phrases(self, windows: _Windows, window: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates at which the whole window stands, and where it begins."""
        begin = position - windows.offset[window, 0]
        keep = begin >= 0
        window, begin = window[keep], begin[keep]
        for r in range(1, windows.term.shape[1]):
            deep = windows.length[window] > r
            ok = ~deep
            ok[deep] = self.has(windows.term[window[deep], r], begin[deep] + windows.offset[window[deep], r])
            window, begin = window[ok], begin[ok]
        return window, begin

    def near(self, windows: _Windows, window: np.ndarray, position: np.ndarray, slop: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates around which the window's next rarest terms stand in the same document, at most ``slop`` words away."""
        doc = np.searchsorted(self.begins, position, "right") - 1
        for r in range(1, min(terms, windows.term.shape[1])):
            low = np.maximum(position - slop, self.begins[doc])
            high = np.minimum(position + slop, self.begins[doc + 1] - 1)
            ok = (windows.length[window] <= r) | self.within(np.maximum(windows.term[window, r], 0), low, high)
            window, position, doc = window[ok], position[ok], doc[ok]
        return window, doc


def build_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The positional index of ``docs(doc_id, text)`` for the rising term hashes ``terms``, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (ids, texts) in enumerate(words.blocks(batches, 4 << 20)):
            segment = _Segment.of(texts, terms)
            present, counts = segment.terms()
            row = [
                (part << 32) | seq, pack(np.array([k or 0 for k in ids], np.int64)), bytes(k is None for k in ids), pack(segment.n_words),
                pack(present, True), pack(counts.astype(np.int64)), pack(segment.postings, True),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(row)], names=[f.split()[0] for f in _SEGMENT.split(", ")])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(narrow.mapInArrow(words.trimmed(run), _SEGMENT), "segments")


def term_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often the corpus has each term; at most as many rows as the block of items has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for row in rows_of(batches):
            total[unpack(row["terms"], True).astype(np.int64)] += unpack(row["counts"]).view(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    return _collected(index.select("terms", "counts").mapInArrow(words.trimmed(run), _FREQUENCY), n_terms)


_FREQUENCY = "term long, n long"


def _collected(counts: DataFrame, n_terms: int) -> np.ndarray:
    """The sums of (term, n) as an array."""
    found = np.zeros(n_terms, np.int64)
    for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect():
        found[r["term"]] = r["n"]
    return found


_HITS = "seg long, ord int, doc_id long, n_words long, hits binary, items array<string>, near array<string>"


def _matches(docs: DataFrame, items: list[tuple[str, bytes]], width: int, slop: int, near_terms: int) -> DataFrame:
    windows = _Windows(items, width)
    index = build_index(docs, windows.terms)
    windows.by_rarity(term_frequencies(index, len(windows.terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            segment = _Segment.stored(row)
            ids, null = unpack(row["ids"]).view(np.int64), np.frombuffer(row["nulls"], bool)
            n = len(ids)
            change = np.zeros(segment.begins[-1] + 2, np.int64)
            exact: list[set] = [set() for _ in range(n)]
            near: list[set] = [set() for _ in range(n)]
            for window, position in segment.candidates(windows):
                w, begin = segment.phrases(windows, window, position)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + windows.length[w], -1)
                for d, x in set(zip((np.searchsorted(segment.begins, begin, "right") - 1).tolist(), w.tolist())):
                    exact[d].update(windows.names[x])
                w, doc = segment.near(windows, window, position, slop, near_terms)
                for code in np.unique(doc * len(windows.names) + w).tolist():
                    near[code // len(windows.names)].update(windows.names[code % len(windows.names)])
            hit = np.flatnonzero(np.cumsum(change) > 0)
            cuts = np.searchsorted(hit, segment.begins)
            packed = [pack((hit[cuts[d] : cuts[d + 1]] - segment.begins[d]).astype(np.uint64), True) if cuts[d + 1] > cuts[d] else None for d in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["seg"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, mask=null), pa.array(segment.n_words),
                    pa.array(packed, pa.binary()), pa.array([sorted(x) for x in exact], pa.list_(pa.string())), pa.array([sorted(x) for x in near], pa.list_(pa.string())),
                ],
                names=[f.split()[0] for f in _HITS.split(", ")],
            )

    return index.mapInArrow(words.trimmed(run), _HITS)


_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result for each (seg, ord); the passes' rows of a document follow each other."""

    def row_of(group: list[dict]) -> tuple:
        hits = [unpack(g["hits"], True) for g in group if g["hits"] is not None]
        n_hit = len(np.unique(np.concatenate(hits))) if hits else 0
        items = sorted(set().union(*(g["items"] for g in group)))
        near = set().union(*(g["near"] for g in group))
        return group[0]["doc_id"], group[0]["n_words"], n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, len(near)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in _RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    group: list[dict] = []
    rows: list[tuple] = []
    for row in rows_of(batches):
        if group and (row["seg"], row["ord"]) != (group[0]["seg"], group[0]["ord"]):
            rows.append(row_of(group))
            group = []
        group.append(row)
        if len(rows) >= 4096:
            yield out(rows)
            rows = []
    if group:
        rows.append(row_of(group))
    if rows:
        yield out(rows)


def _items(benchmark: DataFrame, query_bytes: int) -> tuple[DataFrame, int]:
    """(name, text) of the items that have text, and in how many blocks of about ``query_bytes`` they are collected."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text")).where("text is not null")
    return items, max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes))


def _block(items: DataFrame, passes: int, p: int) -> list[tuple[str, bytes]]:
    return [(r["name"], r["text"].encode()) for r in items.where(F.pmod(F.xxhash64("name", "text"), F.lit(passes)) == p).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP, near_terms: int = NEAR_TERMS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_hit counts the words inside any exact occurrence of a window of ``width``
    item words; n_near counts the items of which some window's ``near_terms``
    rarest terms stand within ``slop`` words of the rarest.  Null texts have no
    words; an item without words matches nothing; an item without item_id goes
    by the empty name; repeated rows each get a row; empty tables give no rows
    or no hits; other columns are not read.
    """
    items, passes = _items(benchmark, query_bytes)
    found = None
    for p in range(passes):
        one = _matches(docs, _block(items, passes, p), width, slop, near_terms)
        found = one if found is None else found.unionByName(one)
    if passes > 1:
        found = found.repartition("seg").sortWithinPartitions("seg", "ord")
    return found.mapInArrow(words.trimmed(_digest), _RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The rows of ``docs`` that have no window of any item, each searched where it stands, whatever its doc_id.

    The index is made a segment at a time, first for how often the corpus has
    each term, then for the phrases, and not stored: no row is written or
    shuffled.  Null, empty and wordless texts stay; very long texts are searched
    whole; repeated rows go or stay alike; an empty table stays empty; all
    columns of any name stay.
    """
    at = docs.columns.index("text")
    items, passes = _items(benchmark, query_bytes)
    left = docs
    for p in range(passes):
        windows = _Windows(_block(items, passes, p), width)
        terms = windows.terms

        def count(batches: Iterator[pa.RecordBatch], terms: np.ndarray = terms) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(terms), np.int64)
            for batch in batches:
                for part in words.parts(batch, 0):
                    some, n = _Segment.of(part.column(0).cast(pa.large_binary()).to_pylist(), terms).terms()
                    total[some.astype(np.int64)] += n
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

        def search(batches: Iterator[pa.RecordBatch], windows: _Windows = windows, terms: np.ndarray = terms) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in words.parts(batch, at):
                    segment = _Segment.of(part.column(at).cast(pa.large_binary()).to_pylist(), terms)
                    keep = np.ones(part.num_rows, bool)
                    for window, position in segment.candidates(windows):
                        _, begin = segment.phrases(windows, window, position)
                        keep[np.searchsorted(segment.begins, begin, "right") - 1] = False
                    yield part if keep.all() else part.filter(pa.array(keep))

        text = docs.select(F.col("text").cast("string").alias("text"))
        windows.by_rarity(_collected(text.mapInArrow(words.trimmed(count), _FREQUENCY), len(terms)))
        left = left.mapInArrow(words.trimmed(search), docs.schema)
    return left
