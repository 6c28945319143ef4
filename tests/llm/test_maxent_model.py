"""The language model's scores against sums over its weights told token by token."""

import random
from collections import Counter

import numpy as np

from neartide.llm import maxent, words


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return words.hashes(data, np.array([0]), np.array([len(data)]))


def test_scores_are_those_of_a_distribution(spark, monkeypatch):
    monkeypatch.setattr(maxent, "TASK_BYTES", 1 << 12)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(1500)]
    rows = [(k, " ".join(vocabulary[min(1499, int(rng.expovariate(0.004)))] for _ in range(rng.randint(0, 60)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = {}
    monkeypatch.setattr(maxent, "learned", lambda d, s, old=maxent.learned: kept.setdefault(0, old(d, s)))
    got = {r.doc_id: r.score for r in maxent.score(docs).collect()}
    model = kept[0][3]
    count = Counter(w for k, t in rows if not maxent.held_out(k) for w in [*t.split(), None])

    def parts(word):
        key = np.array([maxent.END_KEY]) if word is None else hashed(word)
        last = 0 if word is None else ord(word[-1]) | (ord(word[-2]) << 8 if len(word) > 1 else 0)
        ending = 0 if word is None else int(words.mix(np.array([last], np.uint64))[0] % np.uint64(maxent.ENDINGS))
        return int(model.ranks(key)[0]), key, ending, int(maxent._cell(key)[0])

    def context_row(word):
        rank, key, ending, _ = parts(word)
        own = model.others // maxent.ENDINGS
        return rank if rank < maxent.KNOWN else maxent.KNOWN + ending * own + int(words.mix(key ^ np.uint64(0x27D4EB2F))[0] % np.uint64(own))

    def log10(word, before):
        none = maxent.KNOWN + model.others
        one = context_row(before[-1]) if len(before) > 0 else none
        two = context_row(before[-2]) if len(before) > 1 else none
        rank, _, ending, cell = parts(word)
        of_class = maxent._log_softmax(model.weight, model.features(np.array([one]), np.array([two])), model.bias)[0]
        if rank < maxent.SINGLES:
            return of_class[rank] / np.log(10)
        of_cell = maxent._log_softmax(model.cell_weight, model.cell_features(np.array([ending]), np.array([one]), np.array([two])), model.cell_bias[[ending]])[0]
        place = ending * maxent.CELLS + cell
        return (of_class[maxent.SINGLES + ending] + of_cell[cell]) / np.log(10) + np.log10((count[word] + 0.5) / (model.place_tokens[place] + 0.5 * (model.place_types[place] + 1)))

    for k, text in rows[:25]:
        own = [*text.split(), None]
        assert abs(got[k] - sum(log10(w, own[:i]) for i, w in enumerate(own))) < 1e-3, k
    # the seen tokens and one unseen in each cell share all of the probability
    before = rows[0][1].split()[:2]
    total = sum(10 ** log10(w, before) for w in count)
    none = maxent.KNOWN + model.others
    rows_of = [context_row(w) for w in before] or [none, none]
    one, two = np.array(rows_of[-1:]), np.array(rows_of[-2:-1] or [none])
    of_class = np.exp(maxent._log_softmax(model.weight, model.features(one, two), model.bias)[0])
    for ending in range(maxent.ENDINGS):
        of_cell = np.exp(maxent._log_softmax(model.cell_weight, model.cell_features(np.array([ending]), one, two), model.cell_bias[[ending]])[0])
        for cell in range(maxent.CELLS):
            place = ending * maxent.CELLS + cell
            total += of_class[maxent.SINGLES + ending] * of_cell[cell] * 0.5 / (model.place_tokens[place] + 0.5 * (model.place_types[place] + 1))
    singles = of_class[min(maxent.SINGLES, len(model.known)) : maxent.SINGLES].sum()
    assert abs(total + singles - 1) < 1e-3


def test_probabilities_are_products_where_floats_hold_them():
    rng = np.random.default_rng(4)
    features = rng.integers(0, 40, (300, 3))
    for scale, products in ((1.0, True), (40.0, False)):
        weight, bias = (rng.normal(size=s).astype(np.float32) * scale for s in ((40, 7), (5, 7)))
        kind, times = rng.integers(0, 5, 300), rng.integers(1, 9, 300)
        softmax = maxent._Softmax(weight, bias, 3)
        assert softmax.products == products
        plain = maxent._log_softmax(weight, features, bias[kind])
        assert np.allclose(softmax.rows(features, times, kind), np.exp(plain) * times[:, None], atol=1e-4)
        row, column = rng.integers(0, 300, 900), rng.integers(0, 7, 900)
        assert np.allclose(softmax.log_chosen(features, row, column, kind), plain[row, column], atol=1e-3)
        assert np.allclose(softmax.all, np.exp(maxent._log_softmax(np.zeros_like(weight), np.zeros((5, 1), int), bias)), atol=1e-6)


def test_rows_add_up_whether_a_feature_has_one_or_several():
    rng = np.random.default_rng(5)
    features, p = np.stack([np.sort(rng.integers(0, 9, 500)), rng.integers(0, 900, 500), rng.integers(0, 60, 500)], 1), rng.random((500, 6), np.float32)
    wanted = np.zeros((900, 6), np.float32)
    for f in range(3):
        np.add.at(wanted, features[:, f], p)
    for add in (maxent._add, maxent._add_wide):
        got = np.zeros((900, 6), np.float32)
        add(got, features, p)
        assert np.allclose(got, wanted, atol=1e-3)


def test_first_update_needs_no_probabilities_of_contexts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * i) % 97}" for i in range(200))) for k in range(60)], "doc_id long, text string")
    table, _, counts, model = maxent.learned(docs, 1)
    model.weight[:], model.cell_weight[:] = 0, 0
    flat = maxent._gradient(table, model, 1)
    model.weight[-1], model.cell_weight[-1] = 1e-9, 1e-9  # no longer nothing
    plain = maxent._gradient(table, model, 1)
    for a, b in zip(flat, plain):
        assert a.sum() > 0 and np.allclose(a, b, rtol=1e-4, atol=1e-3)
