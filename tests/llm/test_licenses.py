"""The licence scan on notices that families share words with, on wrapped ones, and stretch by stretch against brute force."""

import random

import numpy as np

from neartide.llm import licenses, words


def families(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(docs, model).collect()}


def test_families_that_share_words_are_told_apart(spark):
    model = licenses.Model()
    texts = [
        "This program is under the GNU Affero General Public License, version 3.",
        "This is free and unencumbered software released into the public domain.",
        "Released under the ISC License.", "Licensed under the Eclipse Public License.", "Distributed under the Boost Software License, Version 1.0.",
        "This work is licensed under the GNU General Public License, version 3.", "This library is licensed under the GNU Lesser General Public License, version 3.",
    ]
    assert [r.families for _, r in sorted(families(spark, model, texts).items())] == ["AGPL", "Unlicense", "ISC", "EPL", "Boost", "GPL", "LGPL"]


def test_a_wrapped_grant_is_one_notice_and_one_line_can_hold_two(spark):
    model = licenses.Model()
    grant = licenses.TEMPLATES["MIT"][2].split()
    wrapped = "\n".join(" ".join(grant[i : i + 9]) for i in range(0, len(grant), 9))
    prose = "the river ran past the mill and the old road went up the hill to where the sheep were kept in winter by the farmer and his sons "
    one_line = prose * 3 + "Released under the MIT License. " + prose * 3 + "All rights reserved. " + prose
    got = families(spark, model, ["Heading words here\n\n" + wrapped + "\n\nmore words", one_line, prose * 20])
    lines = len(wrapped.split("\n"))
    family, where, _ = got[0].spans.split(":")
    first, last = map(int, where.split("-"))
    assert got[0].n_paragraphs == 3 and family == "MIT" and got[0].n_licensed == 1 and first <= 3 and last >= 2 + lines - 2
    assert got[1].families == "MIT,Proprietary" and not got[2].licensed


def test_prose_of_the_corpus_calibrates_the_class_for_anything_else(spark):
    rng = random.Random(1)
    plain = ["public", "license", "the", "work", "under", "software", "free", "copy", "river", "road", "mill", "notice"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(plain) for _ in range(80))) for k in range(400)] + [(1000, None), (1001, "")], "doc_id long, text string")
    model = licenses.fit(docs, 200)
    fresh = " ".join(rng.choice(plain) for _ in range(4000))
    scanned = licenses._Scan(*words.joined([fresh.encode()]))
    assert model.notices(scanned) == [] and model.held_out_accuracy > 0.7


def test_stretches_hold_the_grams_of_their_words():
    rng = np.random.default_rng(2)
    text = "\n".join(" ".join(f"w{rng.integers(40)}" for _ in range(rng.integers(0, 30))) if rng.random() < 0.8 else "" for _ in range(60))
    scan = licenses._Scan(*words.joined([text.encode()]))
    keys, first, size = licenses._grams(scan.hashed, scan.paragraph)
    which, stretch = scan.members(first, size)
    covered = np.zeros(len(scan.hashed), bool)
    for n in range(int(scan.first[-1])):
        begin, end = scan.span(n)
        assert 0 < end - begin <= licenses.STRETCH and len(set(scan.paragraph[begin:end])) == 1
        covered[begin:end] = True
        assert set(keys[which[stretch == n]]) == set(licenses._of_words(scan.hashed[begin:end]))
    assert covered.all()
