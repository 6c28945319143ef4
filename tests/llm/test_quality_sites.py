"""Posteriors against a plain computation, null hosts as groups, and kept rows against judged ones."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from neartide.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, evidence double, site_n int"


def made(spark, null_hosts=0):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for k in range(400):
        good = rng.random() < (0.9 if k % 5 else 0.2)
        text = ". ".join(" ".join(word() for _ in range(9)) for _ in range(6)) if good else " ".join(word() + rng.choice(["###", "$$$", "!!"]) for _ in range(50))
        rows.append((k, text, "en", None if k < null_hosts else f"h{k % 5 if k % 97 else k}.org/p{k % 3}", 0.5, 1))
    rows += [(500, None, None, None, None, None), (501, "", "en", "", 0.0, 0), (7, rows[7][1], "en", "h2.org/p1", 0.0, 0), (None, rows[8][1], "en", "h3.org/p2", 0.0, 0), (502, "word " * 30_000, "en", "h1.org/p1", 0.0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labels = spark.createDataFrame([(k, int("###" not in (rows[k][1]) and "$$$" not in rows[k][1]), 0) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_posteriors_leave_a_document_out_of_its_own_rates(spark):
    rows, docs, labels = made(spark)
    got = quality.judge(docs, labels).collect()
    own = {id(r): round(1e6 / (1 + np.exp(-r.evidence))) for r in got}
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[r.host].append(own[id(r)])
        paths[r.host, r.path].append(own[id(r)])

    def pull(groups):
        n, good = np.array([len(g) for g in groups]), np.array([sum(g) for g in groups]) / 1e6
        mean = min(max(good.sum() / n.sum(), 1e-3), 1 - 1e-3)
        room = n.sum() - (n * n).sum() / n.sum()
        between = max(((n * (good / n - mean) ** 2).sum() - (len(n) - 1) * mean * (1 - mean)) / room, 1e-6)
        return float(np.clip(mean * (1 - mean) / between - 1, 1.0, 1e4))

    host_pull, path_pull = pull(list(hosts.values())), pull(list(paths.values()))
    total = sum(own.values()) / 1e6
    for r in got:
        mine = own[id(r)] / 1e6
        mean = (total - mine) / (len(got) - 1)
        h, p = hosts[r.host], paths[r.host, r.path]
        host_rate = (sum(h) / 1e6 - mine + host_pull * mean) / (len(h) - 1 + host_pull)
        rate = min(max((sum(p) / 1e6 - mine + path_pull * host_rate) / (len(p) - 1 + path_pull), 1e-4), 1 - 1e-4)
        posterior = 1 / (1 + np.exp(-(r.evidence + np.log(rate / (1 - rate)))))
        assert abs(r.host_rate - host_rate) < 1e-5 and abs(r.posterior - posterior) < 1e-4 and r.keep == (r.posterior >= 0.5)


def test_null_hosts_are_a_group(spark):
    rows, docs, labels = made(spark, null_hosts=60)
    got = quality.judge(docs, labels, host=F.when(F.col("doc_id") >= 60, F.col("lang"))).collect()
    # doc_id 7 is there twice
    null = [r for r in got if r.host is None and r.doc_id is not None and r.doc_id < 60]
    assert len(null) == 61 and all(r.posterior is not None and r.host_rate is not None for r in got)
    assert any(r.keep for r in null) and any(not r.keep for r in null)


def test_kept_rows_are_those_judged_good(spark):
    rows, docs, labels = made(spark)
    judged = Counter(r.doc_id for r in quality.judge(docs, labels).collect() if r.keep)
    kept = quality.kept(docs, labels)
    found = kept.collect()
    assert kept.schema == docs.schema and Counter(r.doc_id for r in found) == judged
    texts = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in texts for r in found)
    assert quality.kept(docs.limit(0), labels).count() == 0 and quality.kept(docs, labels.limit(0)).count() >= 0
