"""Factors are copies of their sources, place by place."""

import random

from neartide.llm import rlz

SCHEMA = "doc_id long, text string"


def checked(spark, rows, parts=4):
    text = {k: (t or "").split() for k, t in rows}
    found = rlz.parse(spark.createDataFrame(rows, SCHEMA).repartition(parts), with_factors=True).collect()
    for r in found:
        for f in r.factors:
            own, source = text[r.doc_id], text[f.source]
            assert f.source < r.doc_id and f.length >= 13
            assert own[f.start : f.start + f.length] == source[f.source_start : f.source_start + f.length]
    return {r.doc_id: r for r in found}


def test_a_factor_does_not_join_places_that_are_apart_in_its_source(spark):
    w = [f"w{i}" for i in range(14)]
    found = checked(spark, [(1, " ".join(w[:13] + ["zz"] + w[1:])), (2, " ".join(w))])
    assert [(f.start, f.length, f.source_start, f.boundary) for f in found[2].factors] == [(0, 13, 0, False), (1, 13, 14, True)]
    assert found[2].n_removed == 14 and found[1].n_removed == 0


def test_factors_occur_in_their_sources(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for k in range(40)]
    for k in range(40, 120):  # pieced together from stretches of others
        own = []
        for _ in range(rng.randint(1, 5)):
            other = rows[rng.randrange(len(rows))][1].split()
            at = rng.randint(0, max(0, len(other) - 1))
            own += other[at : at + rng.randint(5, 60)]
        rows.append((k, " ".join(own)))
    found = checked(spark, rows)
    assert sum(f.boundary for r in found.values() for f in r.factors) > 20 and sum(r.n_factors for r in found.values()) > 100


def test_blocks_answer_each_other(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"u{i}" for i in range(400)]
    rows = [(k, " ".join(base[(a := rng.randint(0, 300)) : a + rng.randint(10, 100)])) for k in range(200)]
    found = checked(spark, rows, parts=40)
    assert sum(r.n_removed for r in found.values()) > 1000
