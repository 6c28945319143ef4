"""From sequences to sparse features."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neartide.functions.sequence import HASH_RANGE, portable_hash, reverse_complement


def oriented(records: DataFrame, record_id: str = "record_id", name: str = "name", sequence: str = "sequence") -> DataFrame:
    """Each record in both orientations: read_id 2 * id forward, 2 * id + 1 reverse complemented."""
    both = F.array(
        F.struct(F.lit(0).alias("o"), F.lit("+").alias("read_orientation"), F.col(sequence).alias("sequence")),
        F.struct(F.lit(1).alias("o"), F.lit("-").alias("read_orientation"), reverse_complement(F.col(sequence)).alias("sequence")),
    )
    return records.select(F.col(record_id).alias("rid"), F.col(name).alias("read_name"), F.explode(both).alias("s")).select(
        (F.col("rid") * 2 + F.col("s.o")).cast("long").alias("read_id"), "read_name", "s.read_orientation", "s.sequence"
    )


def kmers(reads: DataFrame, k: int, step: int = 1) -> DataFrame:
    """(read_id, pos, kmer) of all runs of k characters, pos from 0; none where the sequence is shorter.

    A Python generator, since taking substrings of a long string in the JVM
    costs its length each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(seq or "") - k + 1
                for first in range(0, n, 1 << 16):
                    at = range(first, min(n, first + (1 << 16)), step)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rid] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([seq[i : i + k] for i in at], pa.string())], names=["read_id", "pos", "kmer"]
                    )

    return reads.select("read_id", "sequence").mapInArrow(run, "read_id long, pos long, kmer string")


STRETCH = 1 << 16  # places of a sequence that are worked on at once


def _stretches(seq: str, k: int) -> Iterator[str]:
    """Parts of a sequence that together have each of its runs of k characters once."""
    for first in range(0, len(seq) - k + 1, STRETCH):
        yield seq[first : first + STRETCH + k - 1]


def feature_counts(tokens: DataFrame, feature: str) -> DataFrame:
    return tokens.groupBy("read_id", F.col(feature).alias("feature_id")).agg(F.count(F.lit(1)).alias("cnt"))


def with_multiplicity(features: DataFrame, least: int) -> DataFrame:
    """Keeps features whose total count is at least ``least``."""
    common = features.groupBy("feature_id").agg(F.sum("cnt").alias("total")).where(F.col("total") >= least).select("feature_id")
    return features.join(common, "feature_id", "left_semi")


def with_document_frequency(features: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Keeps features that at least ``least`` (and at most ``most``) reads have."""
    rule = F.col("df") >= least if most is None else F.col("df").between(least, most)
    common = features.groupBy("feature_id").agg(F.count_distinct("read_id").alias("df")).where(rule).select("feature_id")
    return features.join(common, "feature_id", "left_semi")


def hashed_kmers(reads: DataFrame, k: int, fraction: float, seed: int, min_multiplicity: int = 1) -> DataFrame:
    """Counts of the k-mers whose hash is in the lowest ``fraction``; the hash is the feature's id.

    Hashed, kept and counted a stretch of a read at a time, so that only kept
    features become rows.
    """
    start, limit = f"{seed}:".encode(), int(fraction * HASH_RANGE)
    top = (((limit << 4) | 15) + 1).to_bytes(9, "big")[1:] if limit < HASH_RANGE - 1 else b"\xff" * 9  # digests of hashes up to the limit are below this

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for batch in batches:
            for rid, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in _stretches(seq or "", k):
                    plain = piece.isascii()
                    text = piece.encode() if plain else piece
                    n = len(text) - k + 1
                    digests = (md5(start + (text[i : i + k] if plain else text[i : i + k].encode())).digest() for i in range(n))
                    count = Counter(int.from_bytes(d[:8], "big") >> 4 for d in digests if d < top)
                    if count:
                        yield pa.RecordBatch.from_arrays([pa.array([rid] * len(count), pa.int64()), pa.array(count.keys(), pa.int64()), pa.array(count.values(), pa.int64())], names=["read_id", "feature_id", "cnt"])

    parts = reads.select(F.col("read_id").cast("long").alias("read_id"), "sequence").mapInArrow(run, "read_id long, feature_id long, cnt long")
    counts = parts.groupBy("read_id", "feature_id").agg(F.sum("cnt").alias("cnt"))
    return with_multiplicity(counts, min_multiplicity) if min_multiplicity > 1 else counts


def vocabulary(reads: DataFrame, k: int, fraction: float, seed: int, min_multiplicity: int = 1) -> DataFrame:
    """(kmer, cnt): k-mers that occur often enough, each kept by its hash with probability ``fraction``."""
    counts = kmers(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_multiplicity)
    return counts.where(portable_hash(F.col("kmer"), seed) <= int(fraction * HASH_RANGE))


def closed_vocabulary(vocab: DataFrame) -> DataFrame:
    return vocab.select("kmer").unionByName(vocab.select(reverse_complement(F.col("kmer")).alias("kmer"))).distinct()


def spectrum(counts: DataFrame, most: int = 10) -> DataFrame:
    """How many k-mers occur 1, 2, ... ``most`` times."""
    return counts.where(F.col("cnt") <= most).groupBy(F.col("cnt").alias("multiplicity")).agg(F.count(F.lit(1)).alias("n_kmers"))


def count_matrix(reads: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """(read_id, kmer, cnt) against a vocabulary; unknown k-mers drop out."""
    return kmers(reads, k).join(vocab.select("kmer"), "kmer").groupBy("read_id", "kmer").agg(F.count(F.lit(1)).alias("cnt"))


def token_lists(reads: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """(read_id, tokens): the known k-mers of a read in order."""
    found = kmers(reads, k).join(vocab.select("kmer"), "kmer")
    return found.groupBy("read_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kmer"))), lambda t: t["kmer"]).alias("tokens"))


def window_minima(hashed: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each w consecutive hashes stands, the leftmost among equals."""
    return sliding_window_view(hashed, w).argmin(1) + np.arange(len(hashed) - w + 1)


def minimizers(reads: DataFrame, k: int, w: int, seed: int, every_window: bool = False) -> DataFrame:
    """(read_id, kmer, cnt) of the least-hash k-mer of each window of w k-mers, the leftmost among equals.

    A minimizer counts once while it stays the minimum; with ``every_window`` it
    counts for each window.  Reads with fewer than w k-mers have none.  A window
    never leaves its read, so a read is done by one task, a stretch at a time
    with the minimum before it kept, and nothing is shuffled but counts.
    """
    start = f"{seed}:".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for batch in batches:
            for rid, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                was, base = -1, 0
                for piece in _stretches(seq or "", k + w - 1):
                    n = len(piece) - k + 1
                    if n >= w:
                        hashed = np.array([int.from_bytes(md5(start + piece[i : i + k].encode()).digest()[:8], "big") >> 4 for i in range(n)], np.int64)
                        at = window_minima(hashed, w)
                        if not every_window:
                            new = np.ones(len(at), bool)
                            new[1:] = at[1:] != at[:-1]
                            new[0] = at[0] + base != was
                            was, at = int(at[-1]) + base, at[new]
                        count = Counter(piece[i : i + k] for i in at.tolist())
                        if count:
                            yield pa.RecordBatch.from_arrays([pa.array([rid] * len(count), pa.int64()), pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["read_id", "kmer", "cnt"])
                    base += STRETCH

    return reads.select(F.col("read_id").cast("long").alias("read_id"), "sequence").mapInArrow(run, "read_id long, kmer string, cnt long").groupBy("read_id", "kmer").agg(F.sum("cnt").alias("cnt"))


def words(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(read_id, feature_id, cnt) of the lower-case words of letters of ``docs(doc_id, text)``."""
    text = F.col("text") if text is None else text
    tokens = docs.select(F.col("doc_id").alias("read_id"), F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    return feature_counts(tokens, "w")
