"""The forest loses no neighbour on uneven norms, a common mean or many dimensions."""

import numpy as np
import pytest

from neartide.llm.forest import SHARD, Forest


def vectors(kind, n=SHARD):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, 768 if kind == "dimensions" else 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    if kind.startswith("norms"):
        x *= rng.lognormal(0, float(kind[5:]), (n, 1))
    elif kind == "mean":
        x += np.full(64, 0.25)
    elif kind == "negative":  # every inner product is below zero for some queries
        x = np.abs(x) * np.where(np.arange(n) % 50 == 0, -1, 1)[:, None]
    return x.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("kind", ["unit", "norms0.3", "norms0.6", "norms1.0", "mean", "dimensions", "negative"])
def test_recall(kind, top=20):
    x = vectors(kind)
    asked = x[:: len(x) // 50]
    hits = 0
    for q, (found, score) in zip(asked, Forest(x).search(asked, top)):
        full = np.add.accumulate(x * q, axis=1)[:, -1]
        hits += np.isin(np.argsort(-full, kind="stable")[:top], found).sum()
        assert (full[found] == score).all()
    assert hits / (top * len(asked)) >= 0.9


def test_queries_with_sql_agree_with_it(spark):
    import os

    import pytest

    duckdb, data = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables are not here")
    from neartide.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got, want = QUERIES[name](spark, data), con.execute(sql)
        columns = sorted(got.columns)
        order = [[d[0] for d in want.description].index(c) for c in columns]
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall()), name
