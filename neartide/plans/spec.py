"""Method strings and the pipelines that they name.

<search>_<metric>_<reducer>_<n>d_<weight>, or <search>_<metric>_None_<weight>.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

SEARCHES = ("Exact", "NNDescent", "HNSW", "PQ", "IVFPQ", "SimHash", "MinHash", "RPForest", "LSH")
METRICS = ("cosine", "euclidean", "jaccard", "generalizedjaccard", "hamming")
REDUCERS = ("None", "SRP", "mpSRP", "GRP", "PCA", "SVD", "Spectral", "scBiMap", "SimHash", "Isomap")
WEIGHTS = ("count", "binary", "TF", "IDF", "TFIDF")


@dataclass(frozen=True)
class PipelineSpec:
    search: str
    metric: str
    weight: str
    reducer: str | None = None
    dims: int | None = None
    search_options: dict = field(default_factory=dict)
    reducer_options: dict = field(default_factory=dict)


def parse(method: str, search_options: dict | None = None, reducer_options: dict | None = None) -> PipelineSpec:
    """Reads a method string; anything else is a ValueError.  Options go into the spec whatever its length."""
    parts = method.split("_")
    if len(parts) == 5 and parts[3].endswith("d") and parts[3][:-1].isdigit():
        search, metric, reducer, dims, weight = parts
        size: int | None = int(dims[:-1])
    elif len(parts) == 4 and parts[2] == "None":
        (search, metric, reducer, weight), size = parts, None
    else:
        raise ValueError(f"not a method: {method!r}")
    for value, known, what in ((search, SEARCHES, "search"), (metric, METRICS, "metric"), (reducer, REDUCERS, "reducer"), (weight, WEIGHTS, "weight")):
        if value not in known:
            raise ValueError(f"unknown {what} {value!r} in {method!r}")
    defaults: dict = {"MinHash": {"count": 20, "repeats": 100, "max_bucket": 20, "seed": 458}}.get(search, {})
    return PipelineSpec(search, metric, weight, None if reducer == "None" else reducer, size, {**defaults, **(search_options or {})}, dict(reducer_options or {}))


def overridden(spec: PipelineSpec, text: str) -> PipelineSpec:
    """Updates the options from a JSON object {"search": {...}, "reducer": {...}}; density_base_auto multiplies 1 / sqrt(features) later."""
    given = json.loads(text)
    return replace(spec, search_options={**spec.search_options, **given.get("search", {})}, reducer_options={**spec.reducer_options, **given.get("reducer", {})})


def density(options: dict, n_features: int) -> float:
    auto = 1 / n_features**0.5
    return float(options["density_base_auto"]) * auto if "density_base_auto" in options else float(options.get("density", auto))


def grid(**values: list) -> list[dict]:
    """Every combination of the given parameter lists."""
    return [dict(zip(values, row)) for row in itertools.product(*values.values())]


def reduced(spec: PipelineSpec, weights: DataFrame) -> DataFrame:
    """(read_id, vector): the weights reduced as the method says; a read without any non-zero dimension has zeros."""
    from pyspark.sql import functions as F

    from neartide.operators import neighbors, reduce, sparse_reduce

    dims, options = spec.dims, spec.reducer_options
    whole = {"PCA": sparse_reduce.sparse_pca, "SVD": sparse_reduce.sparse_svd, "Spectral": sparse_reduce.sparse_spectral, "scBiMap": sparse_reduce.sparse_bipartite_map}
    if spec.reducer in whole:
        return whole[spec.reducer](weights, dims)
    if spec.reducer == "GRP":
        return sparse_reduce.gaussian_sketch(weights, dims, options.get("seed", 2094))
    if spec.reducer == "Isomap":
        near = neighbors.sparse_topk(weights, options.get("neighbors", 15), "euclidean").withColumnRenamed("score", "distance")
        found = sparse_reduce.isomap(near, dims, options.get("landmarks", 64))
    else:
        if spec.reducer == "SimHash":
            if dims % 8:
                raise ValueError("SimHash needs a number of dimensions that 8 divides")
            cells = reduce.sign_projection(weights, dims, options.get("seed", 20_141_025)).withColumn("value", F.when(F.col("value") > 0, 1.0).otherwise(0.0))
        else:
            n_features = weights.select("feature_id").distinct().count()
            cells = reduce.hashed_projection(weights, dims, density(options, n_features), options.get("seed", 521_022))
        by_dim = cells.groupBy("read_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
        found = by_dim.select("read_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))
    return sparse_reduce.completed(found, weights, dims)


#: The metrics of each search on reduced vectors.
DENSE = {"Exact": ("cosine", "euclidean"), "RPForest": ("cosine", "euclidean"), "NNDescent": ("cosine", "euclidean"), "HNSW": ("cosine", "euclidean"), "LSH": ("cosine", "euclidean"), "PQ": ("cosine",), "IVFPQ": ("cosine",)}


def _stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of features as one: ids of the first doubled, of the second doubled and one more."""
    from pyspark.sql import functions as F

    rest = [c for c in a.columns if c != "read_id"]
    return a.select((F.col("read_id") * 2).alias("read_id"), *rest).unionByName(b.select((F.col("read_id") * 2 + 1).alias("read_id"), *rest))


def _side(rows: DataFrame, side: int) -> DataFrame:
    from pyspark.sql import functions as F

    return rows.where(F.pmod("read_id", F.lit(2)) == side).withColumn("read_id", F.shiftright("read_id", 1))


def run(spec: PipelineSpec, features: DataFrame, k: int, reference: DataFrame | None = None) -> DataFrame:
    """Weights, reduces and searches sparse features (read_id, feature_id, cnt) as ``spec`` says.

    With ``reference`` both tables are weighted and reduced together, and the
    neighbours of ``features`` are sought in it.  The search's options go to the
    search; a metric or reducer that a search has no use for is a ValueError.
    """
    from neartide.operators import neighbors, weighting

    def no_more(*allowed: str) -> None:
        unknown = set(spec.search_options) - set(allowed)
        if unknown:
            raise ValueError(f"{spec.search} has no option {', '.join(sorted(unknown))}")

    options = spec.search_options
    both = reference is not None
    weights = weighting.weighted(_stacked(features, reference) if both else features, spec.weight.lower())
    if spec.search in ("MinHash", "SimHash"):
        want = ("jaccard", "generalizedjaccard") if spec.search == "MinHash" else ("hamming", "cosine")
        if spec.reducer is not None or spec.metric not in want:
            raise ValueError(f"{spec.search} takes no reducer and one of the metrics {', '.join(want)}")
    if spec.search == "MinHash":
        no_more("repeats", "count", "seed", "max_bucket", "min_bucket", "min_cooccurrence")
        buckets = neighbors.lowhash(weights, options["repeats"], options["count"], options["seed"], weighted=spec.metric == "generalizedjaccard")
        rest = {n: options[n] for n in ("max_bucket", "min_bucket", "min_cooccurrence") if n in options}
        return neighbors.bucket_neighbors(_side(buckets, 0) if both else buckets, k, reference=_side(buckets, 1) if both else None, **rest)
    if spec.search == "SimHash":
        no_more("words", "seed")
        bits = neighbors.simhash_bits(weights, options.get("words", 4), options.get("seed", 20_141_025))
        return neighbors.hamming_topk(_side(bits, 0) if both else bits, k, reference=_side(bits, 1) if both else None)
    if spec.reducer is None:
        metric = {"generalizedjaccard": "generalized_jaccard"}.get(spec.metric, spec.metric)
        no_more()
        # ids of two tables are their own, so that none of a reference is a read itself
        return neighbors.sparse_topk(_side(weights, 0) if both else weights, k, metric, reference=_side(weights, 1) if both else None, include_self=both)
    if spec.metric not in DENSE[spec.search]:
        raise ValueError(f"{spec.search} on reduced vectors takes one of the metrics {', '.join(DENSE[spec.search])}")
    dense = reduced(spec, weights)
    queries, other = (_side(dense, 0), _side(dense, 1)) if both else (dense, None)
    if spec.search == "Exact":
        no_more()
        return neighbors.dense_topk(queries, k, spec.metric, reference=other, include_self=both)
    if spec.search == "RPForest":
        return neighbors.rp_forest_topk(queries, k, metric=spec.metric, reference=other, **options)
    if spec.search == "LSH":
        return neighbors.lsh_topk(queries, k, metric=spec.metric, reference=other, **options)
    if spec.search in ("NNDescent", "HNSW"):
        if both:
            return neighbors.graph_search(queries, other, k, metric=spec.metric, **options)
        return neighbors.nn_descent(queries, k, metric=spec.metric, **options)
    if both:
        raise ValueError(f"{spec.search} has no two-table form")
    return neighbors.pq_topk(queries, k, **({"lists": 64, "probes": 8} if spec.search == "IVFPQ" else {}) | options)


def run_all(specs: dict[str, PipelineSpec], features: DataFrame, k: int, reference: DataFrame | None = None) -> DataFrame:
    """The neighbours by each of several specs, with its name in column config."""
    from functools import reduce as folded

    from pyspark.sql import functions as F

    found = [run(s, features, k, reference) for s in specs.values()]
    # searches name their measure score or distance
    alike = [f.select(F.lit(name).alias("config"), "read_id", "rank", "neighbor_id", F.col(f.columns[-1]).cast("double").alias("value")) for name, f in zip(specs, found)]
    return folded(DataFrame.unionByName, alike)
