"""Readers of FASTA with odd headers, BAM, stage times and lines in file order; writers; operators on them."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from neartide.functions import sequence as S
from neartide.operators import graphs, importers, records
from neartide.plans import spec
from neartide.sources import bam, overlaps, sequences


def test_a_sign_within_a_header_separates_nothing(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">r1 mutation A->B here\nAC\nGT\n>r2 >odd\r\nGG\r\n>r3\n")
    assert sorted(map(tuple, sequences.read_fasta(spark, str(path)).collect())) == [("r1", "ACGT"), ("r2", "GG"), ("r3", "")]


def test_lines_go_by_their_place_in_the_file(spark, tmp_path):
    path = tmp_path / "ranked.tsv"
    lines = ["a\tb\tc\td"] + [f"0\t2\tx\t{r}" for r in range(1, 4000)]
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = overlaps.read_ranked_ids(spark, str(path))
        assert rows.rdd.getNumPartitions() > 3 and [r["rank"] for r in rows.orderBy("line_no").collect()] == list(range(1, 4000))
        last = importers.ranked_ids(rows, 1).where("read_id = 0").first()
        assert last.neighbor_id == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def record(name, ref, pos, flag, cigar, length, tags=b"", quality=60):
    codes = [(n << 4) | "MIDNSHP=X".index(c) for n, c in cigar]
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, quality, 0, len(codes), flag, length, -1, -1, 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(codes)}I", *codes) + b"\x11" * ((length + 1) // 2) + b"\xff" * length + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 2)
    for name in ("chr1", "chr2"):
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", 10_000)
    data += record("r1", 0, 100, 0, [(5, "S"), (50, "M"), (2, "D"), (3, "I"), (40, "M")], 98, b"XZZhello\0" + b"XBBc" + struct.pack("<i", 3) + b"\1\2\3" + b"NMC\7")
    data += record("r2", 1, 9, 16, [(4, "H"), (30, "=")], 30, b"ASi" + struct.pack("<i", 9), 3)
    data += record("r1", 1, 500, 256 | 16, [(10, "M")], 10)
    data += record("r3", -1, -1, 4, [], 12)
    (tmp_path / "x.bam").write_bytes(gzip.compress(data[:120]) + gzip.compress(data[120:]))  # two blocks
    rows = bam.read_bam(spark, str(tmp_path / "x.bam"))
    got = [tuple(r) for r in rows.orderBy("segment_id").collect()]
    assert got == [
        (0, "chr1", 100, 192, "+", 7, "r1", 5, 98, 93, 60, False), (1, "chr2", 9, 39, "-", 0, "r2", 0, 30, 30, 3, False),
        (2, "chr2", 500, 510, "-", 0, "r1", 0, 10, 10, 60, True), (3, None, -1, -1, "+", 0, "r3", 0, 12, 0, 60, False),
    ]
    assert [r.segment_id for r in bam.in_region(rows, "chr2", 30, 501).orderBy("segment_id").collect()] == [1, 2]
    index = spark.createDataFrame([("r1", 0), ("r2", 2)], "name string, id long")
    assert sorted(map(tuple, bam.intervals(rows, index).collect())) == [(0, "chr1+", 100, 192), (2, "chr2-", 9, 39)]
    with pytest.raises(ValueError, match="BAM"):
        list(bam.segments(gzip.compress(b"no")))


def test_stage_times_and_the_time_table(spark, tmp_path):
    folder = tmp_path / "t4" / "s" / "r" / "p" / "e"
    folder.mkdir(parents=True)
    (folder / "m.log").write_text("\tUser time (seconds): 2.5\n\tSystem time (seconds): 0.5\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.5\n\tMaximum resident set size (kbytes): 77\n")
    (folder / "m.json").write_text(json.dumps({"tfidf": 1.5, "nearest_neighbors": 2}))
    got = overlaps.time_table(overlaps.time_logs(spark, str(folder / "m.log")), overlaps.stage_times(spark, str(folder / "m.json"))).first()
    assert (got.thread, got.method, got.mrss, got.clock_time, got.cpu_time) == ("t4", "m", 77, 62.5, 3.0)
    assert (got.tfidf_time, got.dimension_reduction_time, got.get_neighbors_time) == (1.5, None, 2.0)


def test_names_and_vocabularies(spark, tmp_path):
    (tmp_path / "p.fa").write_text(">120_x\nACGTA\n>7_y\nAC\n")
    info = sequences.perfect_read_info(sequences.read_fasta(spark, str(tmp_path / "p.fa")))
    assert sorted(map(tuple, info.collect())) == [("120_x", 5, "+", 120, 125), ("7_y", 2, "+", 7, 9)]
    assert sorted(r.kmer for r in sequences.kmer_vocabulary(spark, str(tmp_path / "p.fa")).collect()) == ["AC", "ACGTA", "GT", "TACGT"]
    ids = spark.createDataFrame([("QSQV01000067.1", "S12_5"), ("AB", "x")], "a string, b string")
    assert sorted(map(tuple, ids.select(S.taxon_code(F.col("a")), S.source_record(F.col("b"))).collect()), key=str) == [("AB", None), ("QSQV01", 11)]
    reads = spark.createDataFrame([(0, "c1"), (2, "c2")], "read_id long, read_name string")
    feats = spark.createDataFrame([(0, 5, 1), (2, 6, 1)], "read_id long, feature_id long, cnt int")
    accession = spark.createDataFrame([("c1", "GB_1")], "name string, accession string")
    taxonomy = spark.createDataFrame([("GB_1", "d__B;s__Some thing")], "tax_id string, taxonomy string")
    assert {(r.read_id, r.species) for r in records.with_taxon(feats, reads, accession, taxonomy).collect()} == {(0, "Some thing"), (2, None)}
    names = spark.createDataFrame([("c2", 0), ("c1", 1), ("c2", 2)], "name string, place int")
    assert [r.read_id for r in records.rows_by_names(reads, names).collect()] == [2, 0, 2]
    with pytest.raises(ValueError):
        records.region_slice(spark.createDataFrame([("a", "ACGT")], "name string, sequence string"), "b", 0, 2, strict=True)


def test_writers_and_dispatch(spark, tmp_path):
    edges, nodes = spark.createDataFrame([(0, 2, 5)], "u long, v long, overlap_size long"), spark.createDataFrame([(0,), (2,)], "node long")
    overlaps.write_graph(edges, nodes, str(tmp_path / "g"))
    back = overlaps.read_graph(spark, str(tmp_path / "g"))
    assert back[0].collect() == edges.collect() and back[1].count() == 2
    overlaps.write_json(spark.createDataFrame([(1, None)], "a int, b int"), str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))) == {"a": 1, "b": None}
    overlaps.write_with_attributes(edges, str(tmp_path / "a"), made="today")
    assert overlaps.attributes(spark.read.parquet(str(tmp_path / "a"))) == {"made": "today"}
    (tmp_path / "x.mecat").write_text("0\t1\t80.0\tx\t0\t.\t.\t.\t1\t.\t.\n")
    index = spark.createDataFrame([("a", 0)], "name string, id long")
    assert importers.imported("mecat2", spark, str(tmp_path / "x.mecat"), index, 3).count() > 0
    with pytest.raises(ValueError):
        importers.imported("other", spark, "x", index, 3)


def test_overlap_statistics(spark):
    found = spark.createDataFrame([(0, 2), (2, 4), (6, 8), (0, 8)], "u long, v long")
    truth = spark.createDataFrame([(0, 2, False), (2, 4, True), (6, 8, False), (4, 6, False)], "u long, v long, redundant boolean")
    r = graphs.overlap_statistics(found, truth).first()
    assert (r.precision, r.nr_precision, r.recall, r.nr_recall) == (0.75, 0.5, 0.75, pytest.approx(2 / 3))
    assert (r.singleton_count, r.component_sizes, r.N50) == (4, 2, 3)


def feats(spark, seed, n=60):
    import random

    rng = random.Random(seed)
    rows = [(i, (i % 6) * 30 + rng.randrange(30), rng.randint(1, 3)) for i in range(n) for _ in range(12)]
    return spark.createDataFrame(rows, "read_id long, feature_id long, cnt int").groupBy("read_id", "feature_id").agg(F.sum("cnt").alias("cnt"))


def test_method_strings_honour_metric_options_and_reference(spark):
    data, other = feats(spark, 1), feats(spark, 2, 45)
    for metric in ("cosine", "euclidean"):
        exact = {(r.read_id, r.neighbor_id): r.score for r in spec.run(spec.parse(f"Exact_{metric}_SRP_16d_TFIDF"), data, 8).collect()}
        for search in ("RPForest", "NNDescent", "LSH"):
            options = {"distance": 100.0} if search == "LSH" else {"leaf": 20}
            got = spec.run(spec.parse(f"{search}_{metric}_SRP_16d_TFIDF", options), data, 8).collect()
            assert all(abs(r.score - exact[r.read_id, r.neighbor_id]) < 1e-5 for r in got if (r.read_id, r.neighbor_id) in exact)
            assert sum((r.read_id, r.neighbor_id) in exact for r in got) > 0.7 * len(exact)
    for method, options in (("Exact_cosine_SRP_16d_TFIDF", {}), ("Exact_euclidean_SRP_16d_TFIDF", {}), ("RPForest_cosine_SRP_16d_TFIDF", {"leaf": 20}), ("HNSW_euclidean_SRP_16d_TFIDF", {"leaf": 20}), ("LSH_cosine_SRP_16d_TFIDF", {}), ("MinHash_jaccard_None_count", {}), ("SimHash_hamming_None_count", {}), ("Exact_jaccard_None_count", {})):
        got = spec.run(spec.parse(method, options), data, 5, reference=other).collect()
        assert got and max(r.neighbor_id for r in got) < 45 and max(r.read_id for r in got) > 45, method
    plain = {(r.read_id, r.neighbor_id) for r in spec.run(spec.parse("Exact_cosine_SRP_16d_TFIDF"), data, 5, reference=other).collect()}
    for search in ("RPForest", "HNSW", "LSH"):
        near = {(r.read_id, r.neighbor_id) for r in spec.run(spec.parse(f"{search}_cosine_SRP_16d_TFIDF"), data, 5, reference=other).collect()}
        assert len(plain & near) > 0.7 * len(plain), search
    for bad, options in (("SimHash_hamming_SRP_16d_count", {}), ("PQ_euclidean_SRP_16d_count", {}), ("Exact_hamming_SRP_16d_count", {}), ("Exact_cosine_SRP_16d_count", {"no": 1})):
        with pytest.raises((ValueError, TypeError)):
            spec.run(spec.parse(bad, options), data, 3)
    both = spec.run_all({"a": spec.parse("Exact_cosine_None_count"), "b": spec.parse("Exact_euclidean_SRP_16d_count")}, data, 3)
    assert {r.config for r in both.select("config").distinct().collect()} == {"a", "b"}
