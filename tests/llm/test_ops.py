"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from neartide.llm import decontaminate, forest, licenses, maxent, packing, pii, quality, rlz, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot int"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, "en", f"src{i % 3}", None if t is None else len(t), 1, 1) for i, (k, t) in enumerate(rows)], SCHEMA)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    line = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(0, 120)))
        if k % 4 == 0:
            text += "\n" + line
        if k % 7 == 3 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((k * 3 + 1, text))
    return rows


EDGES = [(1001, None), (1002, ""), (1003, " \n\t "), (1004, "one"), (1005, "One TWO"), (None, "a null id has text"), (None, None), (1006, "x" * 3000), (1007, "same words here again"), (1007, "same words here again"), (1008, "long " * 20_000)]


@pytest.fixture(scope="module")
def rows():
    return corpus() + EDGES


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_op1_base_and_field(spark, docs, rows, empty):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("a.b@1234567890-+ ( ).%@@..") for _ in range(rng.randint(1, 40)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m[0])
            if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
                want.append((m.start(), 2, m.end()))
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(text) == sorted(want), text
    card = "4785380592391139"
    some = [(k, f"reach me at user{k}@mail.example.org or +1 (706) 555-31{k % 90 + 10} card {card} ip 10.0.0.{k % 250}") for k in range(200)]
    # the pattern fails where another number follows the card; the field finds it again by its repeat
    some.append((900, f"paid with {card} today. then {card} 12 was charged. plain 12 words"))
    found = pii.find(table(spark, some + rows)).collect()
    assert len(found) == len(some) + len(rows)
    by = {r.doc_id: r for r in found}
    assert by[900].n_card == 1 and by[900].n_added == 1 and "card:39:55" in by[900].spans
    assert by[1001].spans == "" and by[1001].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[3].n_email == by[3].n_phone == by[3].n_card == by[3].n_ip == 1 and by[3].n_added == 0
    masked = pii.mask(table(spark, some[:2] + [(7, None)]))
    assert masked.columns == docs.columns and all("@" not in (r.text or "") for r in masked.collect())
    assert pii.find(empty).count() == 0 and pii.mask(empty).count() == 0
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 100_000) == []


def test_op2_removes_what_starts_earlier(docs, rows, empty):
    first, words = {}, []
    for k, text in rows:
        own = split(text)
        words.append(own)
        for i in range(len(own) - 12):
            if k is not None:
                key = tuple(own[i : i + 13])
                first[key] = min(first.get(key, 1 << 60), k)
    want = Counter()
    for (k, _), own in zip(rows, words):
        gone = [False] * len(own)
        for i in range(len(own) - 12):
            if k is not None and first[tuple(own[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        want[(k, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    found = rlz.parse(docs, with_text=True, with_factors=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in found) == want
    for r in found:
        assert len(r.factors) == r.n_factors and all(f.length >= 13 and f.source < r.doc_id for f in r.factors)
        assert len({w for f in r.factors for w in range(f.start, f.start + f.length)}) == r.n_removed
    assert sum(r.n_removed for r in found) > 100 and rlz.parse(empty).count() == 0


def test_op3_packs_all_pieces(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for k, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(k, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    found = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(r.length for r in found) // 2048) and packing.pack_documents(empty).count() == 0


def test_op3_words_are_encoded_as_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(packing.vocabulary_path()), packing.encoder(packing.vocabulary_path())
    rng = random.Random(3)
    letters = "aZbÉéßöÜñ 09'.,!-_|<>&\n\t  ́ǅİıſK\x85\x1c\x00ªµº½中文🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [f"ab{chr(c)}cd {chr(c)}{chr(c)} x{chr(c)}" for c in range(0x20, 0x250)] + ["it's we'll <|endoftext|> a<|startoftext|>b don't 're"]
    for text in texts:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0], text


@pytest.mark.parametrize("seed", range(6))
def test_op3_search_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(9)]
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= 20:
                bins[b] += sizes[i]
                place(i + 1, bins)
                bins[b] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    counts = np.bincount(sizes, minlength=21)
    solution, bound = packing.solve(counts, 20)
    assert bound <= best == sum(n for _, n in solution) and all(sum(f) <= 20 for f, _ in solution)
    packed = Counter()
    for f, n in solution:
        for x in f:
            packed[x] += n
    assert packed == Counter(sizes)


def brute_classes(rows):
    prints = []
    for _, text in rows:
        own = split(lower(text))
        shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else ([" ".join(own)] if own else [])
        hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), k)
    return [(k, f"{prints[i]:016x}", least.get(root(i))) for i, (k, _) in enumerate(rows)]


def test_op4_classes(docs, rows, empty):
    want = brute_classes(rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()) == Counter(want)
    stay = simhash.representatives(docs)
    ids = [r.doc_id for r in stay.collect()]
    assert stay.columns == docs.columns and sorted(k for k in ids if k is not None) == sorted({c for k, _, c in want if k is not None}) and ids.count(None) == 1
    assert simhash.classes(empty).count() == 0 and simhash.representatives(empty).count() == 0


def test_op4_tiles_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    chain = [base[0]]
    for i in range(300):  # a chain of steps of three bits
        chain.append(chain[-1] ^ np.uint64(int(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))))
    near = [b ^ np.uint64(1 << int(rng.integers(64))) for b in base for _ in range(5)]
    prints = np.unique(np.array([*base, *chain, *near], np.uint64))
    parent = np.arange(len(prints))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= 3):
            parent[parent == parent[i]] = parent[j]
    want = {frozenset(prints[parent == p].view(np.int64).tolist()) for p in set(parent.tolist()) if (parent == p).sum() > 1}
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long").repartition(3)
    for parts, home in ((4, 8192), (2, 16), (1, 50)):
        groups = defaultdict(set)
        from neartide.operators.components import connected_components

        for r in connected_components(simhash.links(frame, parts=parts, home=home)).collect():
            groups[r.component].add(r.node)
        assert {frozenset(g) for g in groups.values()} == want


def test_op5_hits(spark, docs, rows, empty):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: re.findall(pattern, lower(t))
    texts = [words(t) for _, t in rows]
    long = [w for w in texts if len(w) > 40]
    items = [(1, " ".join(long[0][5:30])), (2, "One two"), (3, None), (4, "  ..."), (5, " ".join(long[1][:9])), (10, " ".join(long[2][3:13])), (11, " ".join(long[0][8:20])), (1, "again words"), (None, "null id has"), (12, "never seen phrase at all")]
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, doc_id int")
    windows = defaultdict(set)
    for k, t in items:
        own = words(t)
        for i in range(max(1, len(own) - 9) if own else 0):
            windows[tuple(own[i : i + 10])].add("" if k is None else str(k))
    want = Counter()
    for (k, _), own in zip(rows, texts):
        hit, found = [False] * len(own), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                key = tuple(own[i : i + size])
                if key in windows:
                    hit[i : i + size] = [True] * size
                    found |= windows[key]
        want[(k, len(own), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))] += 1
    for size in (1 << 25, 200):  # one pass, and several
        got = decontaminate.contamination(docs, bench, query_bytes=size).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
        assert all(r.n_near >= r.n_items for r in got)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and not set(r.doc_id for r in clean.collect() if r.doc_id) & {w[0] for w in want if w[5]}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_op5_proximity(spark):
    docs = table(spark, [(1, "zebra one two quagga three four okapi five"), (2, "zebra " + "word " * 40 + "quagga okapi")])
    bench = spark.createDataFrame([(7, "zebra quagga okapi")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (0, 1), 2: (0, 0)}


def test_op6_notices(spark, docs, rows, empty):
    model = licenses.Model()
    some = [(9001, "Some prose of the day.\nReleased under the MIT License.\nmore prose here"), (9002, "Licensed under CC BY-NC 4.0."), (9003, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved."), (9004, "the public library of the state has a license plate\nall rights of way")]
    found = {r.doc_id: r for r in licenses.scan(table(spark, some + rows), model).collect()}
    assert [found[k].families for k in (9001, 9002, 9003, 9004)] == ["MIT", "CC-BY-NC", "GPL,Proprietary", ""]
    assert found[9001].spans.startswith("MIT:1-1:") and found[9001].n_paragraphs == 1 and found[1001].n_paragraphs == 0 and not found[1008].licensed
    assert sum(r.licensed for r in found.values()) == 3 and model.held_out_accuracy > 0.7
    assert licenses.scan(empty, model).count() == 0
    assert licenses.scan(docs, model).count() == len(rows)


def test_op7_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(v) for v in np.float32(row)], 0) for i, row in enumerate(x)]
    rows += [(2000 + i, rows[40][1], 0) for i in range(60)]  # copies of a query
    rows += [(3000, None, 0), (3020, [0.0] * 16, 0), (3040, [float("nan")] * 16, 0), (3060, [None] + [1.0] * 15, 0), (None, rows[3][1], 0), (3080, [1.0, 2.0], 0), (3081, [2.0, 1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    good = [(k, v) for k, v, _ in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 16]
    ids, full = np.array([k for k, _ in good]), np.array([v for _, v in good], np.float64)
    got = defaultdict(list)
    for r in forest.nearest(vectors, shard=400).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = np.add.accumulate(full * full[ids == q][0], axis=1)[:, -1]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = sorted(got.pop(q))
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(s == score[ids == k][0] for _, k, s in own)
        assert [(-s, k) for _, k, s in own] == sorted((-s, k) for _, k, s in own)
        hits, total = hits + len(set(best) & {k for _, k, _ in own}), total + 20
    assert hits / total > 0.95 and {k: [x[1] for x in v] for k, v in got.items()} == {3080: [3081]}
    assert forest.nearest(vectors.limit(0)).count() == 0


def test_op8_places(spark, docs, rows, empty):
    got = sharding.assign(docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and {r.law for r in got} == {"bytes"}
    many = sharding.assign(table(spark, [(k, "w" * (k * 37 % 900)) for k in range(3000)]), 7).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sums = [r.s for r in many]
    assert len(sums) == 7 and max(sums) - min(sums) <= 8 and sharding.assign(empty).count() == 0
    hot = sharding.assign(table(spark, [(7 if k % 3 else k, "w" * (k % 50)) for k in range(3000)]), 5).collect()
    sums, places = Counter(), defaultdict(list)
    for r in hot:
        sums[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert max(sums.values()) - min(sums.values()) <= 58 and all(sorted(p) == list(range(len(p))) for p in places.values())
    weight = np.random.default_rng(1).integers(1, 100, 512).astype(float)
    old = sharding.rebalanced(sharding.first_map(512, 8), weight, 8)
    new = sharding.grown(old, weight, 8)
    assert set(new[new != old]) == {8} and np.bincount(new, weights=weight).max() < 1.1 * weight.sum() / 9


def test_op9_counts_and_scores(spark, docs, rows, empty):
    own = [(k, [*split(lower(t)), None]) for k, t in rows]
    out = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 1
    count = Counter(w for k, ws in own for w in ws if not out(k))
    n, v = sum(count.values()), len(count)
    want = Counter((k, out(k), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for k, ws in own)
    got = maxent.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got) and maxent.score(empty).count() == 0


def test_op9_learns_context(spark):
    rng = random.Random(8)
    rows = []
    for k in range(300):
        left, right = rng.choice([("red", "apple"), ("blue", "sky"), ("green", "leaf")])
        rows.append((k, " ".join(f"{left} {right}" for _ in range(40))))
    got = [r for r in maxent.score(table(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)  # both are negative


def test_op10_rejects_junk_and_shrinks(spark, docs, rows, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    some, truth = [], []
    for k in range(600):
        good = k % 4 != 0
        text = ". ".join(" ".join(word() for _ in range(9)) for _ in range(6)) if good else " ".join(word() + rng.choice(["###", "$$$", "!!"]) for _ in range(50))
        some.append((k, text, "en", f"http://h{k % 5}.org/p{k % 2}", 0))
        if k % 2 == 0:
            truth.append((k, int(good), 0))
    frame = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, keep int")
    labels = spark.createDataFrame([*truth, (None, 1, 0), (5, None, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(frame, labels).collect()
    assert all(r.keep == (r.doc_id % 4 != 0) for r in got) and {r.host for r in got} == {f"h{i}.org" for i in range(5)} and {r.path for r in got} == {"p0", "p1"}
    assert quality.kept(frame, labels).columns == frame.columns
    # a site with one document takes the rate of all; one with many takes its own
    sites = [(4 * k, some[4 * k][1], "en", "bad", 0) for k in range(120)] + [(1, some[1][1], "en", "lone", 0)] + [(4 * (k % 140) + 1, some[4 * (k % 140) + 1][1], "en", "good", 0) for k in range(300)] + [(4 * k + 2, some[4 * k + 2][1], "en", "good", 0) for k in range(100)]
    rates = {r.host: r.host_rate for r in quality.judge(spark.createDataFrame(sites, frame.schema), labels.where("quality is not null")).collect()}
    assert rates["bad"] < rates["lone"] < 1 and rates["good"] > 0.5 > rates["bad"]
    assert quality.judge(docs, labels).count() == len(rows) and quality.judge(empty, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).count() == len(rows)


def test_pipeline_on_its_own_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(15)
    rows = [(k, text(60) + ".", "en", f"src{k % 3}", 0) for k in range(200)]
    junk = [(300 + k, " ".join(rng.choice(words).upper() + "!!" for _ in range(60)), "en", "src0", 0) for k in range(60)]
    copies = [(400 + k, rows[k][1], "en", "src1", 0) for k in range(10)]
    leaks = [(500 + k, text(30) + " " + item + " " + text(30), "en", "src2", 0) for k in range(5)]
    private = (600, text(20) + " mail me at someone@example.org " + text(20), "en", "src1", 0)
    spark.createDataFrame([*rows, *junk, *copies, *leaks, private], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 200, 2)] + [(300 + k, 0, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), {k for k, *_ in rows} | {600}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == want and "[EMAIL]" in left[600] and "@" not in left[600] and left[5] == rows[5][1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    counts = np.bincount([r.length for r in packed], minlength=2049)
    n = len({r.sequence_id for r in packed})
    assert {r.doc_id for r in packed} == want and packing.lower_bound(counts, 2048) <= n <= min(packing.lower_bound(counts, 2048) + 1, sum(k for _, k in packing.best_fit(counts, 2048)))
