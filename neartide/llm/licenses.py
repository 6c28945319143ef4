"""Licence notices by a trained paragraph classifier.

A paragraph is a block of lines between lines without words.  It is read in
stretches of at most ``STRETCH`` words, each beginning half a stretch after the
one before.  A stretch is a set of word pairs and triples.  Multinomial logistic
regression over those that occur in the templates gives each licence family a
probability, with a class for anything else; a temperature fitted on held-out
examples, among them held-out prose, calibrates it.  A predicted family stands
only if one of its templates shares enough pairs and triples with the stretch;
these are then taken out and the rest is classified again, so that a stretch can
have several families.

Examples are made from the templates: stretches of them, with words lost and
others around them.  The class for anything else is fitted to the same words out
of order, to sentences that talk of law or files without granting anything and,
where there is a corpus, to stretches of a bounded sample of its documents that
no template matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartide.llm import words

STRETCH = 24  # words
HALF = STRETCH // 2
PROSE = 2_000  # stretches of the corpus that the class for anything else is fitted to

# fixed values: the wording of common licence notices
TEMPLATES = {
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "Boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under CC BY 4.0.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

# fixed values: sentences near the subject that grant nothing
OTHERS = [
    "The terms of the agreement are subject to the law of the state.",
    "He was in compliance with the rules of the public library.",
    "The software is free of errors and the files are included in all copies of the disk.",
    "A driving license is issued by the public office without charge.",
    "The rights of the author are discussed in the second version of the work.",
    "You can find the source of the river along with this map.",
    "The following conditions were met at the time of the purchase.",
    "Any person may obtain a copy of the book at the library.",
    "This program is on the general list of public works.",
    "The notice above the door was included in the form.",
    "Seats are reserved for all rights holders of the festival.",
    "In the common room the creative work of the class is shown.",
]

UNKNOWN = "unknown"
SURE = 0.5
SHARED = 0.5  # of the pairs and triples of the paragraph or the template, whichever has fewer

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = True
_ALNUM[97:123] = True
_ALNUM[128:] = True

_M = [words.mix(np.array([k], np.uint64))[0] | np.uint64(1) for k in (11, 12, 13)]


def _grams(hashed: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the pairs and triples of words within a block, their first words, and how many words they have."""
    n = len(hashed)
    keys, first, sizes = [], [], []
    for size in (2, 3):
        m = max(0, n - size + 1)
        total = np.full(m, size, np.uint64)
        for j in range(size):
            total += hashed[j : j + m] * _M[j]
        same = np.flatnonzero(block[:m] == block[size - 1 :][:m]) if m else np.empty(0, np.int64)
        keys.append(words.mix(total[same]))
        first.append(same)
        sizes.append(np.full(len(same), size))
    return np.concatenate(keys), np.concatenate(first), np.concatenate(sizes)


class _Scan:
    """The words of some text: their hashes, lines and paragraphs; the stretches of each paragraph are numbered on."""

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        buf = words.lowered(data)
        starts, ends = words.spans(buf, _ALNUM)
        self.hashed = words.hashes(buf, starts, ends)
        self.breaks = np.flatnonzero(data == 10)
        self.line = np.searchsorted(self.breaks, starts)
        self.doc = np.searchsorted(begins, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (self.line[1:] > self.line[:-1] + 1) | (self.doc[1:] != self.doc[:-1])
        self.paragraph = np.cumsum(new) - 1
        self.heads = np.flatnonzero(new)
        count = np.diff(np.append(self.heads, len(starts)))
        self.stretches = np.maximum(1, -(-(count - HALF) // HALF))
        self.first = np.concatenate([[0], np.cumsum(self.stretches)])  # the number of a paragraph's first stretch
        self.ends = np.append(self.heads[1:], len(starts))

    def members(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram, stretch) of the grams with the given first words and sizes."""
        paragraph = self.paragraph[first]
        k, rest = np.divmod(first - self.heads[paragraph], HALF)
        own = np.flatnonzero(k < self.stretches[paragraph])
        before = np.flatnonzero((k > 0) & (rest + HALF + size <= STRETCH))
        return np.concatenate([own, before]), np.concatenate([(self.first[paragraph] + k)[own], (self.first[paragraph] + k - 1)[before]])

    def span(self, stretch: int) -> tuple[int, int]:
        p = int(np.searchsorted(self.first, stretch, "right")) - 1
        begin = int(self.heads[p]) + HALF * (stretch - int(self.first[p]))
        return begin, min(begin + STRETCH, int(self.ends[p]))


def _of_text(text: str) -> np.ndarray:
    data = np.frombuffer(text.replace("\n", " ").encode() + b"\n", np.uint8)
    return np.unique(_of_words(_Scan(data, np.array([0, len(data)])).hashed))


def _of_words(hashed: np.ndarray) -> np.ndarray:
    return _grams(hashed, np.zeros(len(hashed), np.int8))[0]


class Model:
    def __init__(self, prose: list[str] = (), seed: int = 7, each: int = 160, passes: int = 300):
        rng = np.random.default_rng(seed)
        self.families = [*TEMPLATES, UNKNOWN]
        self.templates = [(f, _of_text(t)) for f, ts in enumerate(TEMPLATES.values()) for t in ts]
        self.grams = np.unique(np.concatenate([g for _, g in self.templates]))
        self.of_family = [np.unique(np.concatenate([g for f, g in self.templates if f == k])) for k in range(len(TEMPLATES))]
        filler = " ".join(OTHERS).split()
        texts, truth = [], []
        for f, family in enumerate(TEMPLATES.values()):
            for k in range(each):
                own = family[k % len(family)].split()
                if k >= len(family):
                    size = min(STRETCH, max(min(3, len(own)), int(len(own) * rng.uniform(0.6, 1.0))))
                    at = rng.integers(0, len(own) - size + 1)
                    own = [w for w in own[at : at + size] if rng.random() > 0.06]
                    around = [filler[i] for i in rng.integers(0, len(filler), 6)]
                    own = around[: rng.integers(0, 4)] + own + around[3 : 3 + rng.integers(0, 4)]
                texts.append(" ".join(own)), truth.append(f)
        every = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
        for k in range(each * 4):
            if k % 2:
                own = [every[i] for i in rng.integers(0, len(every), rng.integers(4, 24))]
            else:
                own = OTHERS[k % len(OTHERS)].split()
                own = own[: rng.integers(4, len(own) + 1)]
            texts.append(" ".join(own)), truth.append(len(self.families) - 1)
        for text in prose:
            own = _of_text(text)
            if not any(self.confirmed(f, own) for f in range(len(TEMPLATES))):
                texts.append(text), truth.append(len(self.families) - 1)
        # sparse rows: the known grams of each example, one after the other
        found = [self._ids(_of_text(t)) for t in texts]
        truth = np.array(truth)
        held = np.arange(len(texts)) % 5 == 4
        width = len(self.families)
        self.weight = np.zeros((len(self.grams) + 1, width), np.float32)  # the last row is of no gram
        self.bias = np.zeros(width, np.float32)
        self.bias[-1] = 1.0  # nothing known of a stretch: anything else
        pick = np.flatnonzero(~held)
        gram = np.concatenate([found[i] for i in pick])
        row = np.repeat(np.arange(len(pick)), [len(found[i]) for i in pick])
        order = np.argsort(gram, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
        ids, by_gram, target = gram[order][heads], row[order], np.eye(width, dtype=np.float32)[truth[pick]]
        seen = np.diff(np.append(heads, len(gram)))[:, None] + 2.0
        for _ in range(passes):
            error = target - _softmax(self._logits(gram, row, len(pick)))
            self.weight[ids] += 0.5 * (np.add.reduceat(error[by_gram], heads, axis=0) - 0.02 * self.weight[ids]) / seen
        aside = np.flatnonzero(held)
        logits = self._logits(np.concatenate([found[i] for i in aside]), np.repeat(np.arange(len(aside)), [len(found[i]) for i in aside]), len(aside))
        grid = np.exp(np.linspace(-1.5, 1.5, 31))
        loss = [-np.log(_softmax(logits / t)[np.arange(len(aside)), truth[aside]] + 1e-9).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        self.held_out_accuracy = float((logits.argmax(1) == truth[aside]).mean())

    def _logits(self, gram: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Of the examples whose known grams are ``gram``, in order of their numbers ``row``."""
        out = np.tile(self.bias, (n, 1))
        if len(row):
            heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[heads]] += np.add.reduceat(self.weight[gram], heads, axis=0)
        return out

    def _ids(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        return at[self.grams[at] == keys]

    def confirmed(self, family: int, own: np.ndarray) -> bool:
        return any(f == family and len(np.intersect1d(own, t, assume_unique=True)) >= SHARED * min(len(own), len(t)) for f, t in self.templates)

    def notices(self, scan: _Scan) -> list[tuple[int, int, int, int, float]]:
        """(document, family, first line, last line, probability) of each stretch's families."""
        keys, first, size = _grams(scan.hashed, scan.paragraph)
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == keys)
        which, stretch = scan.members(first[hit], size[hit])
        pairs = np.unique((stretch << 24) | at[hit[which]])
        stretches, gram = pairs >> 24, pairs & ((1 << 24) - 1)
        found: list[tuple[int, int, int, int, float]] = []
        numbers, row = np.unique(stretches, return_inverse=True)
        while len(numbers):
            p = _softmax(self._logits(gram, row, len(numbers)) / self.temperature)
            best = p.argmax(1)
            some = np.flatnonzero((best < len(self.families) - 1) & (p[np.arange(len(p)), best] >= SURE))
            keep = np.zeros(len(gram), bool)
            for i in some.tolist():
                begin, end = scan.span(int(numbers[i]))
                grams, where, words_of = _grams(scan.hashed[begin:end], np.zeros(end - begin, np.int8))
                mine = np.isin(grams, self.of_family[best[i]])
                if self.confirmed(int(best[i]), np.unique(grams)):
                    a, b = (begin + x for x in _extent(where[mine], words_of[mine]))
                    found.append((int(scan.doc[begin]), int(best[i]), int(scan.line[a]), int(scan.line[b]), float(p[i, best[i]])))
                    left = np.arange(*np.searchsorted(row, [i, i + 1]))
                    keep[left] = ~np.isin(self.grams[gram[left]], self.of_family[best[i]])  # what another family may still have
            kept, gram = row[keep], gram[keep]
            used, row = np.unique(kept, return_inverse=True)
            numbers = numbers[used]
        return found


def _extent(first: np.ndarray, size: np.ndarray) -> tuple[int, int]:
    """The first and last word of what grams cover, without runs of less than half the words of the longest."""
    covered = np.zeros(int((first + size).max()) + 2, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + size, -1)
    inside = np.concatenate([[False], np.cumsum(covered) > 0])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[0::2], edges[1::2]
    long = np.flatnonzero(2 * (ends - begins) >= (ends - begins).max())
    return int(begins[long[0]]), int(ends[long[-1]]) - 1


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, stretches: int = PROSE) -> Model:
    """A model whose class for anything else is fitted to ``docs`` too: one stretch of each of about ``stretches`` documents, chosen by hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick, texts = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = (text or "").split()
                at = (h >> 20) % max(1, len(own) - STRETCH + 1)
                pick.append(h), texts.append(" ".join(w[:64] for w in own[at : at + STRETCH]))
            yield pa.RecordBatch.from_arrays([pa.array(pick, pa.int64()), pa.array(texts, pa.string())], names=["pick", "text"])

    hashed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.octet_length("text")).alias("pick"), F.col("text").cast("string").alias("text"))
    share = int(min(1.0, 1.5 * stretches / max(1, docs.count())) * 1_000_000)
    some = hashed.where(F.pmod("pick", F.lit(1_000_000)) < share).mapInArrow(words.trimmed(cut), "pick long, text string")
    return Model([r["text"] for r in some.orderBy("pick", "text").limit(stretches).collect()])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_licensed, families, spans, licensed.

    n_paragraphs counts the blocks of lines that have words, n_licensed those
    notices that ``spans`` lists: family:first line-last line:least probability,
    lines from 0, in order of lines and families; neighbouring stretches of one
    family are one notice.  A null, empty or wordless text has no paragraph; very
    long texts are read whole; of families that tie the first in order of names
    stands; repeated rows each get a row; an empty table gives no rows; other
    columns are not read.
    """
    model = model or fit(docs)
    schema = "doc_id long, n_paragraphs long, n_licensed long, families string, spans string, licensed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in words.blocks(batches, 4 << 20):
            data, begins = words.joined(texts)
            found = _Scan(data, begins)
            first = np.searchsorted(found.breaks, begins)  # a document's first line; its own line feeds are breaks too
            count = np.bincount(found.doc[found.heads], minlength=len(ids)) if len(found.heads) else np.zeros(len(ids), np.int64)
            rows: list[list] = [[] for _ in ids]
            for d, family, a, b, p in model.notices(found) if len(found.hashed) else []:
                rows[d].append((a - int(first[d]), family, b - int(first[d]), p))
            families, spans, n = [], [], []
            for own in rows:
                merged: list[list] = []
                last: dict[int, list] = {}
                for a, family, b, p in sorted(own):
                    if family in last and a <= last[family][2] + 1:
                        last[family][2], last[family][3] = max(b, last[family][2]), min(p, last[family][3])
                    else:
                        last[family] = [family, a, b, p]
                        merged.append(last[family])
                families.append(",".join(sorted({model.families[m[0]] for m in merged})))
                spans.append(",".join(f"{model.families[f]}:{a}-{b}:{p:.3f}" for f, a, b, p in merged))
                n.append(len(merged))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(count), pa.array(n, pa.int64()), pa.array(families, pa.string()), pa.array(spans, pa.string()), pa.array([x > 0 for x in n])],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(words.trimmed(run), schema)
