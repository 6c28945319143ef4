"""The skip-chain field against brute force over all labellings, and over long documents."""

import itertools
import random

import numpy as np

from neartide.llm import pii

K = len(pii.LABELS)


def brute(node, a, b, pair):
    total = np.zeros(node.shape)
    for labels in itertools.product(range(K), repeat=len(node)):
        p = np.exp(sum(node[i, x] for i, x in enumerate(labels)) + sum(m[labels[i], labels[j]] for i, j, m in zip(a, b, pair)))
        for i, x in enumerate(labels):
            total[i, x] += p
    return total / total.sum(1, keepdims=True)


def test_marginals_are_exact_on_trees_and_near_on_loops():
    rng = np.random.default_rng(3)
    for seed in range(12):
        n = 6
        node = rng.normal(0, 1, (n, K))
        edges = [(i, int(rng.integers(0, i))) for i in range(1, n)]
        loop = seed % 2
        if loop:
            edges.append((0, 5))
        a, b = np.array(edges).T
        pair = rng.normal(0, 0.3 if loop else 1.0, (len(edges), K, K))
        got = pii.propagate(node, a, b, pair, np.zeros(len(edges), np.int64), tolerance=1e-9)
        assert np.abs(got - brute(node, a, b, pair)).max() < (0.03 if loop else 1e-6)


def test_documents_settle_on_their_own():
    rng = np.random.default_rng(5)
    node, pair = rng.normal(0, 1, (8, K)), rng.normal(0, 0.5, (6, K, K))
    a, b, owner = np.array([0, 1, 2, 4, 5, 6]), np.array([1, 2, 3, 5, 6, 7]), np.array([0, 0, 0, 1, 1, 1])
    both = pii.propagate(node, a, b, pair, owner)
    one = pii.propagate(node[:4], a[:3], b[:3], pair[:3], owner[:3])
    assert np.array_equal(both[:4], one)


def test_weights_are_fitted_together():
    rng = np.random.default_rng(1)
    n = 4000
    y = rng.integers(0, 2, n) * 3
    x = np.stack([np.where(rng.random(n) < 0.8, y, 0), rng.integers(10, 14, n)], 1)
    agree = np.where(rng.random(n) < 0.9, y, 3 - y)
    none = np.full(n, -1)

    def loss(f):
        score = f.unary[x].sum(1) + f.pairs["skip"][:, agree].T
        return -np.log(pii._softmax(score)[np.arange(n), y]).mean()

    joint = pii.fitted(x, y, {"chain": [none, none], "skip": [agree], "like": [none]})
    alone = pii.fitted(x, y, {"chain": [none, none], "skip": [none], "like": [none]})
    skip = joint.pairs["skip"]
    assert loss(joint) < 0.8 * loss(alone) and skip[3, 3] == skip[0, 0] > 1.5 and skip[0, 3] == 0
    assert not alone.pairs["skip"].any()


def test_a_thousand_repeats_are_labelled_alike(spark):
    rng = random.Random(6)
    card = "4785380592391139"
    some = [(k, f"reach me at user{k}@mail.example.org or +1 (706) 555-31{k % 90 + 10} card {card} ip 10.0.0.{k % 250}") for k in range(300)]
    words = ["paid", "then", "later", "on", "the", "day"]
    far = f"card {card} was charged. " + " ".join(f"{' '.join(rng.choice(words) for _ in range(30))} {card} 12 units" for _ in range(1000))
    docs = spark.createDataFrame([*some, (900, far), (901, None), (902, ""), (903, "9" * 200_000), (904, "x@" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[900].n_card == 1 and got[900].n_added == 1000
    assert got[901].n_added == got[902].n_added == 0 and len(got) == 305
