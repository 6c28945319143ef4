"""Golden cases and properties of the engine's own operators."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from neartide.functions import sequence as S
from neartide.operators import align, encode, evaluate, graphs, importers, intervals, neighbors, records, reduce, weighting
from neartide.operators.components import connected_components
from neartide.plans import spec


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sequence_functions(spark):
    df = spark.createDataFrame([("AATC",), ("CCANT",)], "s string")
    assert [r[0] for r in df.select(S.reverse_complement(F.col("s"))).collect()] == ["GATT", "ANTGG"]
    ids = spark.range(4).select(S.sibling(F.col("id")).alias("a"), S.forward_id(F.col("id")).alias("b"), S.is_forward(F.col("id")).alias("c"))
    assert [tuple(r) for r in ids.collect()] == [(1, 0, True), (0, 0, False), (3, 2, True), (2, 2, False)]
    taxa = spark.createDataFrame([("d__B;s__Escherichia coli",), ("s__x;s__A b",), ("g__A;s__",)], "t string")
    assert [r[0] for r in taxa.select(S.species(F.col("t"))).collect()] == ["Escherichia coli", "A b", None]


def test_kmers_and_orientation(spark):
    recs = spark.createDataFrame([(0, "a", "ACGT"), (1, "b", "AC"), (2, "c", None)], "record_id long, name string, sequence string")
    both = encode.oriented(recs)
    assert (1, "a", "-", "ACGT") in rows(both.where("sequence is not null"))
    assert rows(encode.kmers(both.where("read_orientation = '+'"), 3)) == [(0, 0, "ACG"), (0, 1, "CGT")]


def test_minimizers_follow_positions(spark):
    at = encode.window_minima(np.array([5, 3, 3, 9, 1, 7, 8, 2]), 3).tolist()
    assert at == [1, 1, 4, 4, 4, 7] and list(dict.fromkeys(at)) == [1, 4, 7]
    # stretch by stretch as in one piece, and against windows told one by one
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(encode.STRETCH + 500))
    reads = spark.createDataFrame([(0, text), (1, "ACG"), (2, None)], "read_id long, sequence string")
    hashed = [int(hashlib.md5(f"7:{text[i : i + 6]}".encode()).hexdigest()[:15], 16) for i in range(len(text) - 5)]
    minima = [min(range(i, i + 9), key=lambda j: (hashed[j], j)) for i in range(len(hashed) - 8)]
    changes = [m for i, m in enumerate(minima) if i == 0 or m != minima[i - 1]]
    for every, places in ((True, minima), (False, changes)):
        got = {r.kmer: r.cnt for r in encode.minimizers(reads, 6, 9, 7, every).collect()}
        assert got == Counter(text[i : i + 6] for i in places)


def test_weights(spark):
    feats = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "a", 1), (1, "c", 3), (2, "a", 4)], "read_id long, feature_id string, cnt int")
    got = lambda m: {(r[0], r[1]): round(r[2] + 0.0, 6) for r in weighting.weighted(feats, m).collect()}
    assert got("tf") == {(0, "a"): 0.666667, (0, "b"): 0.333333, (1, "a"): 0.25, (1, "c"): 0.75, (2, "a"): 1.0}
    assert got("idf")[(0, "b")] == got("idf")[(1, "c")] == 1.098612 and abs(got("idf")[(2, "a")]) == 0
    assert got("tfidf")[(0, "b")] == 0.366204 and got("tfidf")[(1, "c")] == 0.823959
    with pytest.raises(ValueError):
        weighting.weighted(feats, "None")
    jac = neighbors.sparse_topk(weighting.weighted(feats, "count").where("read_id < 2"), 3, "generalized_jaccard")
    assert rows(jac) == [(0, 1, 1, 0.166667), (1, 1, 0, 0.166667)]


def test_sibling_merge(spark):
    lists = spark.createDataFrame([(0, 0, 0.0), (0, 2, 0.1), (0, 6, 0.4), (1, 1, 0.0), (1, 3, 0.2), (1, 8, 0.15)], "read_id long, neighbor_id long, distance double")
    got = neighbors.sibling_merge(lists, 3).orderBy("read_id", "rank").collect()
    assert [r.neighbor_id for r in got] == [0, 2, 9, 1, 8, 3] and got[5].distance == 0.2


def test_blocks_do_not_change_neighbours(spark):
    x = np.random.default_rng(0).standard_normal((300, 8))
    frame = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "read_id long, vector array<double>")
    for metric in ("cosine", "euclidean", "inner"):
        assert rows(neighbors.dense_topk(frame, 5, metric)) == rows(neighbors.dense_topk(frame, 5, metric, block=70))
    exact = {(r.read_id, r.neighbor_id) for r in neighbors.dense_topk(frame, 10).collect()}
    for found, least in ((neighbors.rp_forest_topk(frame, 10, trees=10), 0.6), (neighbors.nn_descent(frame, 10, rounds=2), 0.9), (neighbors.pq_topk(frame, 10, pieces=4), 0.9), (neighbors.pq_topk(frame, 10, pieces=4, lists=4, probes=3), 0.75)):
        assert len({(r.read_id, r.neighbor_id) for r in found.collect()} & exact) / len(exact) >= least
    sparse = spark.createDataFrame([(i, int(f), float(1 + f % 3)) for i in range(90) for f in np.random.default_rng(i).integers(0, 40, 6)], "read_id long, feature_id long, weight double").dropDuplicates(["read_id", "feature_id"])
    assert rows(neighbors.sparse_topk(sparse, 4)) == rows(neighbors.sparse_topk(sparse, 4, block=20))


def test_intervals(spark):
    ivl = spark.createDataFrame([(0, "c+", 0, 100), (2, "c+", 50, 150), (4, "c+", 60, 90), (6, "c+", 100, 200), (8, "d+", 0, 100), (10, "d+", 10, 20), (12, "d+", 5, 5)], "read_id long, grp string, start_pos long, end_pos long")
    want = [(0, 2, 50, 50, 0, 50, 2), (0, 4, 30, 60, 0, 10, 0), (2, 4, 30, 10, 2, 60, 2), (2, 6, 50, 50, 2, 50, 6), (8, 10, 10, 10, 8, 80, 8)]
    for width in (1, 7, 64, 1000):
        assert [r[:7] for r in rows(intervals.overlap_edges(ivl, width))] == want
        assert rows(intervals.contained(ivl, width)) == [(10, 8)]
    top = intervals.top_overlaps(ivl, 64, 1)
    assert {(r.read_id, r.neighbor_id) for r in top.collect()} == {(0, 2), (2, 0), (4, 0), (6, 2), (8, 10), (10, 8)}


def test_scores_above_the_kth(spark):
    df = spark.createDataFrame([(100, i, s) for i, s in ((2, 9.0), (4, 7.0), (6, 7.0), (8, 3.0), (101, 99.0), (100, 99.0))], "read_id long, neighbor_id long, score double")
    got = {k: sorted(r.neighbor_id for r in graphs.above_kth_score(df, k).collect()) for k in (1, 2, 3, 4)}
    assert got == {1: [], 2: [2], 3: [2], 4: [2, 4, 6]}


def test_components_and_n50(spark):
    for sizes, n50, continuity in (([6, 3, 2, 1], 6, 1.0), ([4, 4, 1, 1], 4, 0.8)):
        frame = spark.createDataFrame([(s,) for s in sizes], "size long")
        r = graphs.n50(frame).first()
        assert (r.n50, r.continuity, r.nodes, r.components) == (n50, continuity, sum(sizes), len(sizes))
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (700, 700), (None, 3)], "u long, v long").repartition(5)
    got = {r.node: r.component for r in connected_components(path).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 700: 700}
    assert connected_components(path.limit(0)).count() == 0


def test_evaluation(spark):
    overlaps = spark.createDataFrame([(r, v) for r, vs in ((1, [0, 0, 5]), (2, [5, 0, 0]), (3, [9, 9, 9])) for v in vs], "rank int, overlap_size int")
    got = [(r["rank"], round(r.precision, 4), round(r.mean_overlap, 4)) for r in evaluate.prefix_metrics(overlaps).orderBy("rank").collect()]
    assert got == [(1, 0.3333, 1.6667), (2, 0.3333, 1.6667)]
    pairs = spark.createDataFrame([(1, "A", "A"), (2, "A", "B"), (3, "B", "B"), (4, "B", "B"), (5, "C", "A")], "read_id int, truth string, predicted string")
    scores = {r["class"]: (r.tp, r.fp, r.fn, r.precision) for r in evaluate.class_scores(pairs).collect()}
    assert scores == {"A": (1, 1, 1, 0.5), "B": (2, 1, 0, 2 / 3), "C": (0, 0, 1, None)}


def test_alignment(spark):
    one = [1] * 5
    assert align.align([2, 3, 4, 5, 6], [1, 2, 3, 4, 5], one, one) == (4, [0, 1, 2, 3], [1, 2, 3, 4])
    assert align.align([1, 2], [3, 4], [1, 1], [1, 1]) == (0, [], []) and align.align([], [1], [], [1]) == (0, [], [])
    assert align.align([1, 2, 9, 3], [1, 2, 3], [2, 2, 1, 3], [2, 2, 3]) == (6, [0, 1, 2, 3], [0, 1, -1, 2])
    assert align.align([1, 2], [1, 2], [1, 1], [1, 1], max_cells=3) == (0, [], [])
    seqs = spark.createDataFrame([(0, [1, 2, 3], [1, 1, 1]), (1, [2, 3], [1, 1])], "read_id long, elements array<long>, weights array<long>")
    pairs = spark.createDataFrame([(0, 1)], "u long, v long")
    assert [(r.score, r.idx1, r.idx2) for r in align.align_pairs(pairs, seqs).collect()] == [(2, [1, 2], [0, 1])]
    assert align.align_pairs(pairs, seqs, done=pairs).count() == 0


def test_records_and_errors(spark):
    reads = spark.createDataFrame([("a",), ("a",)], "read_name string")
    with pytest.raises(Exception, match="repeated read"):
        records.require_distinct(reads).collect()
    both = spark.createDataFrame([(0, "a", "+"), (1, "a", "-"), (2, "b", "+")], "read_id long, read_name string, read_orientation string")
    info = spark.createDataFrame([("a", "c", "-", 5)], "read_name string, reference_chromosome string, reference_strand string, reference_start long")
    assert [r.reference_strand for r in records.metadata(both, info).orderBy("read_id").collect()] == ["-", "+"]
    with pytest.raises(Exception, match="no coordinates"):
        records.metadata(both, info, strict=True).collect()
    last = spark.createDataFrame([(0, 2, 5, 1, 0), (0, 2, 3, 2, 0)], "i long, j long, value int, line_no long, way int")
    assert importers.ranked(importers.mirrored(last.drop("way")), 3, "last").where("read_id = 0").first().value == 3


def test_reductions(spark):
    x = np.abs(np.random.default_rng(3).standard_normal((80, 6))) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1])
    frame = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "read_id long, vector array<double>").repartition(3)
    take = lambda df: np.array([r.vector for r in df.orderBy("read_id").collect()])
    centred = x - x.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(take(reduce.pca(frame, 2))), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(take(reduce.truncated_svd(frame, 2))), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    z = unit / np.sqrt(unit @ unit.sum(0) - 1)[:, None]
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(take(reduce.spectral_embedding(frame, 2))), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    mapped = take(reduce.bipartite_map(frame, 3))
    assert mapped.shape == (80, 3) and np.allclose(np.linalg.norm(mapped, axis=1), 1)
    with pytest.raises(Exception, match="non-negative"):
        reduce.bipartite_map(spark.createDataFrame([(0, [1.0, -1.0])], frame.schema), 1).collect()
    same = take(reduce.gaussian_projection(frame, 6, 4))
    assert np.allclose(same, take(reduce.gaussian_projection(frame.repartition(1), 6, 4)))
    parts = {r.part: r["count"] for r in reduce.near_equal_parts(frame.select("read_id"), 7, ["read_id"]).groupBy("part").count().collect()}
    assert parts == {i: 12 if i <= 3 else 11 for i in range(1, 8)}


def test_method_strings(spark):
    got = spec.parse("Exact_cosine_SRP_128d_TFIDF", {"a": 1})
    assert (got.search, got.metric, got.reducer, got.dims, got.weight, got.search_options) == ("Exact", "cosine", "SRP", 128, "TFIDF", {"a": 1})
    assert spec.parse("Exact_jaccard_None_count").reducer is None and spec.parse("MinHash_jaccard_None_count").search_options["repeats"] == 100
    for bad in ("Exact_cosine", "Exact_cosine_SRP_128_TFIDF", "Other_cosine_None_TF", "Exact_cosine_None_None"):
        with pytest.raises(ValueError):
            spec.parse(bad)
    assert spec.overridden(got, '{"search": {"k": 3}, "reducer": {"density_base_auto": 2}}').reducer_options == {"density_base_auto": 2}
    assert spec.density({"density_base_auto": 2}, 100) == pytest.approx(0.2) and len(spec.grid(a=[1, 2], b=[3, 4, 5])) == 6
    feats = spark.createDataFrame([(i, f, 1 + (i + f) % 3) for i in range(30) for f in range(i % 5, 12, 2)], "read_id long, feature_id long, cnt int")
    for method in ("Exact_cosine_None_TF", "Exact_euclidean_SRP_8d_IDF", "SimHash_hamming_None_count", "MinHash_jaccard_None_count", "Exact_cosine_PCA_4d_TFIDF"):
        options = {"repeats": 5, "count": 2, "seed": 1} if method.startswith("MinHash") else None
        assert spec.run(spec.parse(method, options), feats, 3).count() > 0


def test_samples(spark):
    frame = spark.range(1000).withColumnRenamed("id", "k")
    one = rows(records.exact_sample(frame, "k", 50, 1))
    assert len(one) == 50 and one == rows(records.exact_sample(frame.repartition(7), "k", 50, 1)) and one != rows(records.exact_sample(frame, "k", 50, 2))
    genome = spark.createDataFrame([("g", "ACGT" * 300), ("short", "AC")], "name string, sequence string")
    got = records.perfect_reads(genome, 50, 3.0, 1).collect()
    assert 0 < len(got) <= 72 and all(len(r.sequence) == 50 and 0 <= r.start_pos < 1150 for r in got) and {r.strand for r in got} == {"+", "-"}


def test_sparse_queries_are_held_in_lanes_and_worked_on_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cells = {(int(r), int(f)): float(rng.integers(1, 4)) for r, f in zip(rng.integers(0, 120, 900), np.minimum(rng.integers(0, 60, 900), rng.integers(0, 60, 900)))}
    frame = spark.createDataFrame([(r, f, w) for (r, f), w in cells.items()], "read_id long, feature_id long, weight double")
    sets = {r: {f: w for (x, f), w in cells.items() if x == r} for r, _ in cells}
    for lane, most in ((1 << 20, 1 << 30), (100, 500)):
        monkeypatch.setattr(neighbors, "LANE", lane)
        monkeypatch.setattr(neighbors, "ROUND", most)
        for metric in neighbors.METRICS:
            for meetings in (7, 1 << 20):
                monkeypatch.setattr(neighbors, "_MEETINGS", meetings)
                got = neighbors.sparse_topk(frame, 3, metric)
                assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and "Window" not in got._jdf.queryExecution().toString()
                want = []
                for a, x in sets.items():
                    found = []
                    for b, y in sets.items():
                        if a != b and (both := x.keys() & y.keys()):
                            if metric in ("cosine", "euclidean"):
                                s, ta, tb = sum(x[f] * y[f] for f in both), sum(v * v for v in x.values()), sum(v * v for v in y.values())
                                score = s / (ta**0.5 * tb**0.5) if metric == "cosine" else max(ta + tb - 2 * s, 0) ** 0.5
                            else:
                                one = metric == "jaccard"
                                s = sum(1 if one else min(x[f], y[f]) for f in both)
                                score = s / ((len(x) + len(y) if one else sum(x.values()) + sum(y.values())) - s)
                            found.append((round(score if metric == "euclidean" else -score, 6), b))
                    want += [(a, k + 1, b, abs(v)) for k, (v, b) in enumerate(sorted(found)[:3])]
                assert sorted((r.read_id, r["rank"], r.neighbor_id, round(r.score, 5)) for r in got.collect()) == sorted((a, k, b, round(v, 5)) for a, k, b, v in want)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bucketed_projections_meet_in_blocks(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    x = rng.standard_normal((150, 8))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "read_id long, vector array<double>")
    got = neighbors.lsh_topk(frame, 4, tables=3, bucket_length=0.4, distance=2.5)
    assert "Join" not in _plan(got)
    data = frame.select("read_id", array_to_vector("vector").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=3, bucketLength=0.4, seed=11).fit(data)
    pairs = model.approxSimilarityJoin(data, data, 2.5, "score").where("datasetA.read_id <> datasetB.read_id").select(F.col("datasetA.read_id").alias("a"), F.col("datasetB.read_id").alias("b"), F.round("score", 6).alias("s"))
    lists = {}
    for a, b, s in pairs.collect():
        lists.setdefault(a, []).append((s, b))
    assert sorted((r.read_id, r["rank"], r.neighbor_id, r.score) for r in got.collect()) == sorted((a, k + 1, b, s) for a, v in lists.items() for k, (s, b) in enumerate(sorted(v)[:4]))


def test_forest_scores_within_leaves(spark):
    x = np.random.default_rng(9).standard_normal((300, 8))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "read_id long, vector array<double>")
    leaves = neighbors.rp_forest_candidates(frame, 10, 20)
    own = {}
    for r in leaves.collect():
        own.setdefault((r.repeat, r.feature_id), []).append(r.read_id)
    assert neighbors._within_leaves(leaves, frame, 2, "cosine", None, None).count() <= 2 * 10 * 300  # and not a row for each pair of a leaf
    met = {(a, b) for v in own.values() for a in v for b in v if a != b}
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    want = {a: [b for _, b in sorted((round(-float(unit[a] @ unit[b]), 6), b) for c, b in met if c == a)[:5]] for a in range(300)}
    got = {}
    for r in neighbors.rp_forest_topk(frame, 5, 10, 20).orderBy("read_id", "rank").collect():
        got.setdefault(r.read_id, []).append(r.neighbor_id)
    assert got == {a: v for a, v in want.items() if v}


def test_one_list_of_codes_is_asked_by_several_tasks(spark):
    x = np.random.default_rng(10).standard_normal((600, 8))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "read_id long, vector array<double>")
    got = neighbors.pq_topk(frame, 5, pieces=4, codes=16, rerank=120)  # all are scored exactly
    assert "hashpartitioning(list" in _plan(got) and "lane" in _plan(got)
    want = neighbors.dense_topk(frame, 5)
    assert [r.neighbor_id for r in got.orderBy("read_id", "rank").collect()] == [r.neighbor_id for r in want.orderBy("read_id", "rank").collect()]


def test_intervals_meet_in_bins(spark):
    rng = random.Random(12)
    one = [(i, rng.choice("ab"), (s := rng.randint(-300, 900)), s + rng.choice([0, 5, 60, 700])) for i in range(150)]
    two = one + [(rng.randrange(150), rng.choice("ab"), (s := rng.randint(0, 900)), s + rng.randint(1, 300)) for _ in range(40)] + [(None, "a", 0, 900), (7, None, 0, 900)]
    for given in (one, two):
        frame = spark.createDataFrame(given, "read_id long, grp string, start_pos long, end_pos long")
        live = [x for x in given if x[2] < x[3] and None not in x]
        inside, size = {}, Counter()
        for r, g, s, e in live:
            for r2, g2, s2, e2 in live:
                if g == g2 and r != r2:
                    if s2 < s and e < e2:
                        inside.setdefault(r, set()).add(r2)
                    if s < e2 and s2 < e:
                        size[r, r2] += min(e, e2) - max(s, s2)
        got = intervals.contained(frame, 100)
        assert "Join" not in _plan(got)
        assert sorted(map(tuple, got.collect())) == sorted((r, min(p)) for r, p in inside.items() if len(p) == 1)
        want = []
        for r in {a for a, _ in size}:
            best = sorted((-n, b) for (a, b), n in size.items() if a == r and n > 20)[:3]
            want += [(r, b, -n, k + 1) for k, (n, b) in enumerate(best)]
        got = intervals.top_overlaps(frame, 100, 3, 20)
        assert given is two or "Join" not in _plan(got)
        assert sorted((r.read_id, r.neighbor_id, r.overlap_size, r["rank"]) for r in got.collect()) == sorted(want)


def test_shared_buckets_are_counted_without_pairs(spark):
    rng = random.Random(4)
    own = sorted({(rng.randrange(60), rng.randrange(40), rng.randrange(6)) for _ in range(1500)})
    frame = spark.createDataFrame(own, "read_id long, repeat int, feature_id long")
    size = Counter(x[1:] for x in own)
    sets = {r: {x[1:] for x in own if x[0] == r and 2 <= size[x[1:]] <= 6} for r in range(60)}
    want = []
    for a in sets:
        best = sorted((-n, b) for b in sets if a != b and (n := len(sets[a] & sets[b])) >= 2)[:4]
        want += [(a, k + 1, b, -n) for k, (n, b) in enumerate(best)]
    got = neighbors.bucket_neighbors(frame, 4, 2, 6, 2)
    assert "Join" not in _plan(got)
    assert got.dtypes == [("read_id", "bigint"), ("rank", "int"), ("neighbor_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_components_of_few_edges_take_few_jobs(spark):
    """Small graphs end in one task; larger ones in rounds, with the same classes."""
    rng = random.Random(8)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 700)] + [(900, 900), (None, 3), (5, 5)]
    frame = spark.createDataFrame(rows, "u long, v long").repartition(7)
    spark.sparkContext.setJobGroup("few", "few")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {r.node: r.component for r in connected_components(frame, small=0).collect()}
    least = {}
    for u, v in (r for r in rows if r[0] is not None):
        a, b = least.setdefault(u, {u}), least.setdefault(v, {v})
        if a is not b:
            a |= b
            least.update((k, a) for k in b)
    assert got == {k: min(c) for k, c in least.items()}
    assert jobs <= 6


def test_class_counters_are_few_and_score_as_all_pairs(spark):
    """kprecision's truth: the best of each label and what is asked stand for all pairs."""
    rng = random.Random(4)
    labels = [(i, rng.choice([0, 1, 1, 1, 1, None])) for i in rng.sample(range(400), 300)] + [(7, 0), (7, 1), (7, 1), (None, 1)]
    rows = spark.createDataFrame(labels, "read_id long, label int")
    knn = spark.createDataFrame([(r, n, rng.choice(labels)[0] or 0) for r, _ in labels if r is not None for n in range(1, 8)], "read_id long, rank int, neighbor_id long")
    truth = {}
    for u, p in set(labels):
        for v, q in set(labels):
            if None not in (u, v, p) and p == q and u // 2 != v // 2:
                key = u - u % 2, v - v % 2
                truth[key] = max(truth.get(key, 0), (min(u, v) * 7 + max(u, v) * 13) % 10 + 1)
    every = spark.createDataFrame([(*k, o) for k, o in truth.items()], "read_id long, neighbor_id long, overlap_size long")
    for k in (1, 6):
        asked = knn.where(F.col("rank") <= k).select(S.forward_id(F.col("read_id")).alias("read_id"), S.forward_id(F.col("neighbor_id")).alias("neighbor_id"))
        few = evaluate.class_counters(rows, asked, k, lambda u, v: (u * 7 + v * 13) % 10 + 1, lambda u, v: (u * 7 + v * 13) % 10 + 1, blocks=3).cache()
        assert evaluate.truth_statistics(knn, few, k).collect() == evaluate.truth_statistics(knn, every, k).collect()
        assert few.count() <= 2 * k * len(labels) + asked.count()
    assert evaluate.class_counters(rows.limit(0), asked, 6, lambda u, v: u + v, lambda u, v: u + v).count() == 0


def test_overlap_edges_of_equal_intervals_come_from_classes(spark, monkeypatch):
    rng = random.Random(11)
    spans = [(rng.choice("ab"), s, s + rng.randint(1, 120)) for s in rng.sample(range(-300, 300), 12)]
    spans += [("a", 10, 60), ("a", 10, 90), ("b", 10, 60), ("a", 40, 90), ("a", 5, 5), ("a", 9, 2)]
    given = [(r, *spans[i]) for i in range(len(spans)) for r in rng.sample(range(200), rng.randint(1, 9))]  # reads may have several
    given += given[:20] + [(None, "a", 0, 400), (7, None, 0, 400), (7, "a", None, 400), (8, "a", 0, None)]
    want = []
    for x, g, s, e in given:
        for y, h, a, b in given:
            if None not in (x, y, g, s, e, a, b) and x < y and g == h and s < b and a < e and s < e and a < b:
                want.append((x, y, min(e, b) - max(s, a), abs(s - a), y if a < s else x, abs(e - b), y if b > e else x, True))
    table = spark.createDataFrame(given, "read_id long, grp string, start_pos long, end_pos long")
    for members in (1024, 3):  # a class in one row, and in several
        monkeypatch.setattr(intervals, "_MEMBERS", members)
        assert rows(intervals.overlap_edges(table, 50)) == sorted(want)
    monkeypatch.undo()
    copies = spark.range(3000).selectExpr("id AS read_id", "'a' AS grp", "10L * (id % 3) AS start_pos", "100L AS end_pos")
    left = intervals.overlap_edges(copies, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(ps" in left and intervals._class_pairs(intervals._classes(copies), 50).count() == 6


def test_overlap_counters_of_single_intervals_are_not_summed(spark, capsys):
    rng = random.Random(6)
    single = [(k, rng.choice("ab"), s, s + rng.randint(-5, 90)) for k in range(60) for s in [rng.randrange(400)]] + [(None, "a", 0, 400), (77, None, 0, 400)]
    several = [(k, rng.choice("ab"), s, s + rng.randint(-5, 90)) for k in range(50, 70) for s in rng.sample(range(400), 2)]
    for given in (single, single + several):
        want = Counter()
        for r, g, s, e in given:
            for q, h, a, b in given:
                if None not in (r, q, g) and r != q and g == h and s < b and a < e and s < e and a < b:
                    want[r, q] += min(e, b) - max(s, a)
        got = intervals.overlap_counters(spark.createDataFrame(given, "read_id long, grp string, start_pos long, end_pos long"), 50)
        assert rows(got) == sorted((*k, n) for k, n in want.items())
        if given is single:
            got.explain()
            assert "HashAggregate" not in capsys.readouterr().out


def test_overlap_counters_of_equal_intervals_come_from_classes(spark, monkeypatch):
    rng = random.Random(12)
    spans = [("a", 10, 60), ("a", 10, 90), ("b", 10, 60), ("a", 40, 190), ("a", 5, 5), ("a", -70, 12)]
    given = [(r, *rng.choice(spans)) for r in range(80)] + [(r, *x) for r in range(75, 85) for x in spans[:2]]
    want = Counter()
    for x, g, s, e in given:
        for y, h, a, b in given:
            if x != y and g == h and s < b and a < e and s < e and a < b:
                want[x, y] += min(e, b) - max(s, a)
    table = spark.createDataFrame(given, "read_id long, grp string, start_pos long, end_pos long")
    for members in (1024, 3):
        monkeypatch.setattr(intervals, "_MEMBERS", members)
        assert rows(intervals.overlap_counters(table, 50)) == sorted((*k, n) for k, n in want.items())
    copies = spark.range(300).selectExpr("id AS read_id", "'a' AS grp", "10L * (id % 3) AS start_pos", "100L AS end_pos")
    monkeypatch.undo()
    got = intervals.overlap_counters(copies, 50)
    assert got.count() == 300 * 299 and "Generate explode(ps" in got._jdf.queryExecution().optimizedPlan().toString()


def test_lowhash_draws_a_feature_once_for_all_reads(spark):
    rows = [(r, f"f{(r * i) % 23}", 1.0 + (r + i) % 3) for r in range(40) for i in range(1, 6)]
    features = spark.createDataFrame(rows, "read_id long, feature_id string, weight double").distinct()
    for weighted in (False, True):
        drawn = neighbors.lowhash(features, 3, 2, 7, weighted=weighted)
        hashed = [line for line in drawn._jdf.queryExecution().optimizedPlan().toString().splitlines() if "md5" in line]
        assert hashed and not any("read_id" in line for line in hashed)
        assert drawn.groupBy("read_id", "repeat").count().where("count > 2").count() == 0


def test_buckets_count_repeated_names_and_many_repeats(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    named = [(r, t, rng.randrange(8)) for r in range(30) for t in (0, 1, 31, 32, 40) for _ in range(2)]
    size = Counter((t, f) for _, t, f in named)
    own = {r: {(t, f) for q, t, f in named if q == r and 2 <= size[t, f] <= 9} for r in range(30)}
    wanted = []
    for r in own:
        near = sorted((-len(own[r] & own[q]), q) for q in own if q != r and own[r] & own[q])[:4]
        wanted += [(r, i + 1, q, -s) for i, (s, q) in enumerate(near)]
    buckets = spark.createDataFrame(named, "read_id long, repeat int, feature_id long")
    got = neighbors.bucket_neighbors(buckets, 4, 2, 9).collect()
    assert any(len(set(x)) < 2 for x in zip(named[::2], named[1::2])) and sorted(map(tuple, got)) == sorted(wanted)


def test_cosines_by_product_are_those_of_single_meetings(monkeypatch):
    rng = np.random.default_rng(8)
    cells = [np.unique((60 * rng.random(25) ** 2).astype(np.int64)) for _ in range(150)] * 2  # copies tie
    names, counts, features = np.arange(300), np.array([len(c) for c in cells], np.int32), np.concatenate(cells)
    weights = 0.5 + features % 7
    dense = np.zeros((300, 60))
    dense[np.repeat(names, counts), features] = weights
    score = np.round(dense @ dense.T / np.sqrt((dense**2).sum(1)[:, None] * (dense**2).sum(1)[None, :]), 6)
    np.fill_diagonal(score, -1)
    calls = []
    monkeypatch.setattr(neighbors._Held, "_by_product", lambda self, *a, old=neighbors._Held._by_product: calls.append(1) or old(self, *a))
    for block, meetings in ((1 << 23, 1 << 20), (300 * 2, 500)):  # all features in the block, or two and the others in small steps
        monkeypatch.setattr(neighbors, "_BLOCK", block)
        monkeypatch.setattr(neighbors, "_MEETINGS", meetings)
        held = neighbors._Held(names, counts, features, weights, 5, "cosine", False, 6)
        held.meet(names, counts, features, weights)
        assert calls and (held.near == np.lexsort((np.broadcast_to(names, score.shape), -score), axis=1)[:, :5]).all()
        assert np.abs(-held.value - np.take_along_axis(score, held.near, 1)).max() < 2e-6
