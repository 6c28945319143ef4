"""The pipeline's filters decide by row: null and shared doc_ids neither save a row nor cost one."""

import random
from collections import Counter

import corpus_pipeline


def test_null_and_shared_doc_ids(spark, tmp_path):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(15)
    junk = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(60))
    good = [(k, text(60) + ".") for k in range(200)]
    labelled_junk = [(1000 + k, junk()) for k in range(60)]
    null_good = [(None, text(60) + ".") for _ in range(20)]
    shared_good = [(7777, text(60) + ".") for _ in range(4)]  # one id, different texts, one of the rows to go at each filter
    null_bad = [(None, junk()), (None, good[3][1]), (None, null_good[0][1]), (None, text(30) + " " + item + " " + text(30))]
    shared_bad = [(7777, junk()), (7777, good[5][1]), (7777, text(30) + " " + item + " " + text(30))]
    rows = good + labelled_junk + null_good + shared_good + null_bad + shared_bad
    rng.shuffle(rows)
    spark.createDataFrame([(k, t, "en", f"src{i % 3}", 0) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 200, 2)] + [(1000 + k, 0, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(good + null_good + shared_good)
