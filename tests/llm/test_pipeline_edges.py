"""The pipeline on null ids and texts, empty and very long texts, repeated ids and rows, clashing columns and an empty table."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, evidence double, row int, label int"


def written(spark, folder, rows):
    docs = spark.createDataFrame([(k, t, "en", s, None if t is None else len(t), "h", 0.5, 1, 2) for k, t, s in rows], SCHEMA)
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return docs


def test_rows_of_every_kind(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(50), f"src{k % 3}") for k in range(60)]
    leak = text(10) + " alpha beta gamma delta epsilon zeta eta theta iota kappa " + text(10)
    rows += [(None, text(40), "src1"), (None, leak, None), (7, text(45), "src1"), (7, leak, "src1"), (8, rows[8][1], "src2"), (None, rows[9][1], "src0")]
    rows += [(70, None, "src0"), (71, "", "src0"), (72, " \n", None), (73, " ".join(text(1) for _ in range(30_000)), "src0"), (74, "x" * 100_000, "src0")]
    docs = written(spark, tmp_path, rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        seen[name] = docs.collect()
    after = [(r.doc_id, r.text) for r in seen["near_dedup"]]
    # two texts under one id stay, copies go whatever their ids, a null id goes before no other
    assert sum(k == 7 for k, _ in after) == 3 and sum(k == 8 for k, _ in after) == 1 and sum(t == rows[9][1] for _, t in after) == 1 and (9, rows[9][1]) in after
    assert sum(not (t or "").strip() for _, t in after) == 1 and sum(k is None for k, _ in after) >= 1
    clean = [r.text or "" for r in seen["decontamination"]]
    assert not any("alpha beta" in t for t in clean) and sum(r.doc_id == 7 for r in seen["decontamination"]) == 2
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and sum(r.doc_id == 73 for r in packed) > 10


def test_an_empty_table(spark, tmp_path):
    written(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
