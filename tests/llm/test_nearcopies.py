"""The pipeline's near-dedup stage against brute force over sets of 5-word shingles."""

import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from neartide.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA).repartition(5)


def shingled(text):
    own = (text or "").lower().split()
    return {" ".join(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else ({" ".join(own)} if own else set())


def brute(texts):
    """The class of each text."""
    sets = [shingled(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                gone, stays = root[i], root[j]
                root = [stays if r == gone else r for r in root]
    return root


def planted(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(800)]
    line = " ".join(rng.choice(words) for _ in range(12))
    texts = [None, "", " \n", "One two", "one TWO", "one two three four five"]
    for k in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        if k % 3 == 0:
            own += line.split()
        texts.append(" ".join(own))
        for edits in range(1, 6):
            other = list(own)
            for at in rng.sample(range(len(own)), edits):
                other[at] = rng.choice(words)
            texts.append(" ".join(other[: len(other) - rng.randint(0, 4)]).title())
    base = [rng.choice(words) for _ in range(120)]  # a large class, some of it beyond reach of its middle
    for _ in range(80):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.randint(0, 3)):
            own[at] = rng.choice(words)
        texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def test_planted_edits_go_whatever_their_fingerprints(spark):
    texts = planted()
    least = defaultdict(lambda: 1 << 60)
    for k, c in enumerate(brute(texts)):
        least[c] = min(least[c], k)
    assert 60 < len(least) < len(texts) - 100
    docs = frame(spark, list(enumerate(texts)))
    for sample in (nearcopies.SAMPLE, 0):
        stay = nearcopies.representatives(docs, sample)
        assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(least.values())
    staged = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in staged.collect()) == sorted(least.values())
    assert nearcopies.representatives(docs.limit(0)).count() == 0


def test_tiles_bring_copies_together_and_parities_keep_every_similar_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, 100).astype(np.uint64)]
    for gone in range(1, 60):  # some are similar, most of the others are not
        sets.append(np.concatenate([sets[0][gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)]))
    size = np.array(list(map(len, sets)), np.int32)
    odd = list(np.array([nearcopies._parities(s) for s in sets]).T.copy())
    for i in range(len(sets)):
        kept = set(nearcopies._even(size, odd, i, np.arange(len(sets))).tolist())
        similar = {j for j, s in enumerate(sets) if 9 * len(np.intersect1d(s, sets[i])) >= 4 * (len(s) + len(sets[i]))}
        assert similar <= kept and len(kept) < 50
    seen, linked = [], nearcopies._linked
    monkeypatch.setattr(nearcopies, "_linked", lambda pairs, sets: seen.append((pairs.count(), (found := linked(pairs, sets)).count())) or found)
    texts = planted()
    left = nearcopies.representatives(frame(spark, list(enumerate(texts)))).count()
    assert left == len(set(brute(texts)))
    assert seen[0][1] > 0  # the tiles' links come first
    assert seen[-1][0] < 400  # of 80 near copies not all pairs are left to compare
