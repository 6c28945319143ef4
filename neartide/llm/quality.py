"""Quality by hierarchical empirical Bayes.

A document classifier gives each text a log odds of good quality.  Texts also
come from somewhere: a host, and a path on it.  Each level's rate of good
documents is a beta posterior whose prior is the level above: path, host, all.
How strongly a level is drawn to the one above is estimated from how much its
groups differ beyond chance, so sparse sites take the global rate and large
sites their own.  A document's posterior joins its own evidence with the
expected rate of its path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from neartide.llm import words
from neartide.plans.storage import materialize

SAMPLE = 20_000  # labelled documents that the classifier is fitted to
REJECT = 0.5

# classes of bytes: lower case, upper case, digit, white space, beyond ASCII, sentence marks, other signs
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4
_CLASS[list(words.SPACES)] = 3
_CLASS[list(b".,;:'\"-")] = 5

FEATURES = ("upper", "digit", "space", "foreign", "mark", "sign", "distinct", "length", "word", "lines", "signed")


def measure(text: bytes | None) -> list[float]:
    """The classifier's features of a whole text."""
    text = text or b""
    n = max(1, len(text))
    share = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7) / n
    found = text.split()
    count = max(1, len(found))
    lines = text.split(b"\n")
    signed = sum(w[-1:] in b"#$%&*!|=<>" for w in found) / count
    return [*share[1:7].tolist(), len(set(found)) / count, min(np.log1p(len(found)) / 10, 2.0), min(n / count / 20, 3.0), len(set(lines)) / max(1, len(lines)), signed]


_SCHEMA = "doc_id long, host string, path string, x binary"


def places(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of a document: ``source`` up to a slash, and what follows, or ``lang`` where nothing does."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    under = F.regexp_extract(source, "^(?:[a-z]+://)?[^/]*/([^/?#]*)", 1)
    return F.regexp_extract(source, "^(?:[a-z]+://)?([^/]*)", 1), F.when(under != "", under).otherwise(F.coalesce(F.col("lang").cast("string"), F.lit("")))


def measured(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, x) of every row; x holds the features as single floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.parts(batch, 3):
                x = [_features(t) for t in part.column(3).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "host", "path", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(words.trimmed(run), _SCHEMA)


def _features(text: bytes | None) -> np.ndarray:
    return np.array(measure(text), np.float32)


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], 1)


class Classifier:
    """Logistic regression on standardised features and their squares; gives log odds against even ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, passes: int = 25, penalty: float = 1.0):
        width = len(FEATURES)
        if not len(y):
            x = np.zeros((1, width))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.weight = np.zeros(1 + 2 * width)
        if len(y) and 0 < y.sum() < len(y):
            z = _design(x, self.mean, self.scale)
            balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
            for _ in range(passes):
                p = 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))
                slope = z.T @ (balance * (y - p)) - penalty * self.weight
                curve = (z * (balance * p * (1 - p))[:, None]).T @ z + penalty * np.eye(z.shape[1])
                self.weight += np.linalg.solve(curve, slope)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_design(x, self.mean, self.scale) @ self.weight, -12, 12)

    def rounded(self, x: np.ndarray) -> np.ndarray:
        """The evidence to six places, so that it does not depend on which rows it is worked out with."""
        return np.round(self.evidence(x), 6)


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fits the classifier to the ``sample`` labelled documents with the least hash of doc_id."""
    truth = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # a hash keeps about half more than are wanted, so that no task has to send the driver a sample of its own
    share = int(min(1.0, 1.5 * sample / max(1, truth.count())) * 1_000_000)
    truth = truth.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share)
    some = rows.join(truth, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("x", "quality").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in some], np.float64).reshape(-1, len(FEATURES))
    return Classifier(x, np.array([r["quality"] for r in some], np.float64))


def _strength(groups: DataFrame) -> tuple[int, int, float]:
    """Documents and good ones, in millionths, of all groups, and the weight of the prior, from the spread of the groups' rates (method of moments)."""
    # good is a sum of probabilities in millionths, so that it does not depend on the order of rows
    r = groups.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("k")).first()
    if not r["n"]:
        return 0, 0, 1.0
    mean = min(max(r["good"] / 1e6 / r["n"], 1e-3), 1 - 1e-3)
    spread = groups.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.lit(1e6) / F.col("n") - F.lit(mean), 2)).alias("v"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    room = r["n"] - spread["n2"] / r["n"]
    between = max((spread["v"] - (r["k"] - 1) * mean * (1 - mean)) / room, 1e-6) if room > 0 else 1e-6
    return r["n"], r["good"], float(np.clip(mean * (1 - mean) / between - 1, 1.0, 1e4))


def _own(evidence: Column) -> Column:
    """What a document adds to its groups' good ones, in millionths."""
    return F.round(1e6 / (1 + F.exp(-evidence))).cast("long")


class Sites:
    """The classifier, and the counts of every path and host that posteriors are made of."""

    def __init__(self, docs: DataFrame, labels: DataFrame, host: Column, path: Column):
        rows = materialize(measured(docs, host, path), "quality")
        self.model = model = fit(rows, labels)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array([np.frombuffer(v, np.float32) for v in batch.column(3).to_pylist()], np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.rounded(x))], names=["doc_id", "host", "path", "evidence"])

        self.weighed = materialize(rows.mapInArrow(words.trimmed(weigh), "doc_id long, host string, path string, evidence double"), "evidence")
        paths = materialize(self.weighed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(_own(F.col("evidence"))).alias("good")), "paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        self.total, self.good, self.host_pull = _strength(hosts)
        self.path_pull = _strength(paths)[2]
        of_host = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
        sums = paths.join(of_host, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "good", "host_n", "host_good")
        self.sums = materialize(sums, "sites")  # written, so that its size is known before anything is joined with it

    def judged(self, rows: DataFrame, host: str, path: str, evidence: str) -> tuple[DataFrame, Column, Column, Column]:
        """``rows`` beside their groups' sums under names of their own, and the columns host rate, path rate and posterior."""
        named = {c: words.unused(rows.columns, "site_" + c) for c in self.sums.columns}
        sums = self.sums.select([F.col(c).alias(n) for c, n in named.items()])
        joined = rows.join(sums, rows[host].eqNullSafe(sums[named["h"]]) & rows[path].eqNullSafe(sums[named["p"]]), "left")
        own = _own(F.col(evidence))
        # a document's own evidence is left out of the rates that it is joined with
        mean = (F.lit(self.good) - own) / 1e6 / F.lit(max(1, self.total - 1)) if self.total > 1 else F.lit(0.5)
        host_rate = ((F.col(named["host_good"]) - own) / 1e6 + F.lit(self.host_pull) * mean) / (F.col(named["host_n"]) - 1 + F.lit(self.host_pull))
        path_rate = ((F.col(named["good"]) - own) / 1e6 + F.lit(self.path_pull) * host_rate) / (F.col(named["n"]) - 1 + F.lit(self.path_pull))
        clipped = F.least(F.greatest(path_rate, F.lit(1e-4)), F.lit(1 - 1e-4))
        posterior = F.round(1 / (1 + F.exp(-(F.col(evidence) + F.log(clipped / (1 - clipped))))), 6)
        return joined, host_rate, path_rate, posterior


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, reject: float = REJECT) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, path, evidence, host_rate, path_rate, posterior, keep.

    The host is ``source`` up to a slash, the path what follows, or ``lang``
    where there is none; both can be given.  Evidence is the classifier's log
    odds at even rates.  Labels only fit the classifier: rates come from the
    classifier's verdict on every other document of the path, host and corpus.
    Null host or path is a group of its own; a null, empty or wordless text is
    judged by features that are all nothing; very long texts are read whole;
    repeated rows and tied ids each count and get a row; labels that repeat a
    doc_id count as good if any does; an empty table gives no rows; other
    columns are not read.
    """
    own_host, own_path = places(docs)
    sites = Sites(docs, labels, own_host if host is None else host, own_path if path is None else path)
    joined, host_rate, path_rate, posterior = sites.judged(sites.weighed, "host", "path", "evidence")
    found = joined.select("doc_id", "host", "path", "evidence", F.round(host_rate, 6).alias("host_rate"), F.round(path_rate, 6).alias("path_rate"), posterior.alias("posterior"))
    return found.withColumn("keep", F.col("posterior") >= reject)


def kept(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, each judged as ``judge`` does, whatever its doc_id, where it stands.

    The evidence is worked out once more beside the whole row, so that only the
    table of sites, whose size Spark checks before it broadcasts it, meets the
    texts.  Nulls, empty and long texts, ties and repeated rows are judged as in
    ``judge``; an empty table stays empty; columns of any name stay.
    """
    host, path = places(docs)
    sites = Sites(docs, labels, host, path)
    model, at = sites.model, docs.columns.index("text")
    names = [words.unused(docs.columns, n) for n in ("host", "path", "evidence")]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.parts(batch, at):
                x = np.array([_features(t) for t in part.column(at).cast(pa.large_binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.rounded(x))], names=[*part.schema.names, names[2]])

    placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], host.alias(names[0]), path.alias(names[1]))
    schema = StructType([*placed.schema.fields, StructField(names[2], DoubleType())])
    joined, _, _, posterior = sites.judged(placed.mapInArrow(words.trimmed(weigh), schema), *names)
    return joined.where(posterior >= reject).select([F.col(f"`{c}`") for c in docs.columns])
