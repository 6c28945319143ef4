import gzip

import pytest

from neartide.operators import importers
from neartide.sources import overlaps, sequences



@pytest.mark.parametrize("suffix", ["fasta", "fasta.gz"])
def test_fasta(spark, tmp_path, suffix):
    path = tmp_path / f"x.{suffix}"
    opened = gzip.open(path, "wt") if suffix.endswith("gz") else open(path, "w")
    with opened as f:
        f.write(">a first\nacg\nTN\n>b\nGG\n>c\n")
    rows = sequences.read_fasta(spark, str(path)).collect()
    assert sorted((r.name, r.sequence) for r in rows) == [("a", "ACGTN"), ("b", "GG"), ("c", "")]


def test_fastq_and_kinds(spark, tmp_path):
    path = tmp_path / "x.fastq"
    path.write_text("@r1 x\nACGT\n+\nII!#\n\n@r2\nGG\n+\n@I\n@r3\nA\n")
    rows = {r.name: r for r in sequences.read_fastq(spark, str(path)).collect()}
    assert set(rows) == {"r1", "r2"} and rows["r1"].quality == [40, 40, 0, 2] and rows["r2"].sequence == "GG"
    assert sorted(r.name for r in sequences.fastq_names(spark, str(path)).collect()) == ["r1", "r2"]
    with pytest.raises(ValueError):
        sequences.file_kind("x.bam")
    with pytest.raises(ValueError):
        sequences.concatenated(spark, ["x.fasta", "y.fastq"])


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "GG")], "name string, sequence string")
    sequences.write_fasta(df, str(tmp_path / "out"))
    assert sorted(map(tuple, sequences.read_fasta(spark, str(tmp_path / "out")).collect())) == [("a", "ACGT"), ("b", "GG")]


def test_maf_and_error_model(spark, tmp_path):
    path = tmp_path / "x.maf"
    path.write_text("a\ns ref 100 5 + 1000 ACGTA\ns S1_1 0 6 - 6 ACGGTA\n\na\ns ref 7 2 + 1000 AC\ns S1_2 0 2 + 2 AC\n\n")
    rows = sorted(map(tuple, sequences.read_maf(spark, str(path)).collect()))
    assert rows == [("S1_1", 6, "-", 100, 105), ("S1_2", 2, "+", 7, 9)]
    model = tmp_path / "m.model"
    model.write_text("70 IP 1 0.5\n70 EP 1 0.1 0.2 0.3 0.4\n")
    assert [(r.acc, r.kind, r.state, r.p) for r in sequences.read_error_model(spark, str(model)).orderBy("kind").collect()] == [(70, "EP", 1, [0.1, 0.2, 0.3, 0.4]), (70, "IP", 1, [0.5])]
    path.write_text("a\ns ref 1 5 + 9 A\ns r 3 6 - 6 A\n\n")
    with pytest.raises(Exception, match="start at 0"):
        sequences.read_maf(spark, str(path)).collect()


def test_overlap_tables(spark, tmp_path):
    paf = tmp_path / "x.paf"
    paf.write_text("a\t500\t0\t100\t+\tb\t600\t5\t105\t80\t100\t60\ttp:A:P\n\na\t500\t0\t50\t+\tb\t600\t5\t55\t40\t50\t60\na\t500\t0\t70\t-\tc\t600\t5\t75\t60\t70\t60\nb\t500\t0\t60\t-\tc\t600\t5\t65\t60\t60\t60\n")
    rows = overlaps.read_paf(spark, str(paf))
    assert rows.count() == 4 and rows.where("size(optional_fields) = 1").count() == 1
    index = spark.createDataFrame([("a", 0), ("b", 2), ("c", 4)], "name string, id long")
    found = {(r.read_id, r["rank"]): (r.neighbor_id, r.value) for r in importers.paf(rows, index, 5).collect()}
    want = {0: [(2, 150), (5, 70)], 1: [(3, 150), (4, 70)], 2: [(0, 150), (5, 60)], 3: [(1, 150), (4, 60)], 4: [(1, 70), (3, 60)], 5: [(0, 70), (2, 60)]}
    assert found == {(i, n): x for i, xs in want.items() for n, x in enumerate(xs, 1)}
    path = tmp_path / "x.txt"
    path.write_text("n1 n2 0.1 40 0 1 2 3 1 5 6\nshort line\n")
    assert [tuple(r)[:6] for r in overlaps.read_mhap(spark, str(path)).collect()] == [("n1", "n2", 0.1, 40.0, "0", "1")]
    path.write_text("\t".join(["a", "+", *"234", "b", "-", *"789", "200", "300", "x"]) + "\n")
    assert [tuple(r)[:6] for r in overlaps.read_wtdbg2(spark, str(path)).collect()] == [("a", "+", "b", "-", 200, 300)]
    path.write_text("1\t2\t88.5\t0\t1\t0\t0\t0\t0\t9\t9\n")
    assert [tuple(r)[:5] for r in overlaps.read_mecat2(spark, str(path)).collect()] == [(1, 2, 88.5, "1", "0")]
    path.write_text("name1\tstrand1\tname2\tstrand2\trank\na\t+\tb\t-\t1\nbad\tline\n")
    assert [tuple(r)[:5] for r in overlaps.read_ranked_names(spark, str(path)).collect()] == [("a", "+", "b", "-", 1)]
    path.write_text("a\tb\tc\td\n0\t3\tx\t2\n")
    assert [tuple(r)[:3] for r in overlaps.read_ranked_ids(spark, str(path)).collect()] == [(0, 3, 2)]
    path.write_text("a\tb\t1\na\tc\t0\n")
    assert [tuple(r) for r in overlaps.read_name_pairs(spark, str(path)).collect()] == [("a", "b", True), ("a", "c", False)]


def test_tables_logs_and_accessions(spark, tmp_path):
    df = spark.createDataFrame([("a", 5, "c", "+", 1, 6)], overlaps.READ_INFO)
    overlaps.write_table(df, str(tmp_path / "t"))
    assert overlaps.read_table(spark, str(tmp_path / "t"), overlaps.READ_INFO).collect() == df.collect()
    (tmp_path / "log").write_text("\tUser time (seconds): 2.5\n\tSystem time (seconds): 0.5\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03\n\tMaximum resident set size (kbytes): 77\n")
    assert [tuple(r)[1:] for r in overlaps.time_logs(spark, str(tmp_path / "log")).collect()] == [(77, 3723.0, 3.0)]
    (tmp_path / "GCA_12.1_x.fna").write_text(">n1 a\nAC\n")
    (tmp_path / "GCF_7.2_x.fna").write_text(">n2\nAC\n")
    assert sorted(map(tuple, overlaps.accessions(spark, str(tmp_path / "*.fna")).collect())) == [("n1", "GB_GCA_12.1"), ("n2", "RS_GCF_7.2")]
    top = spark.createDataFrame([(1, 2, 9)], "read_id int, neighbor_id int, overlap_size int")
    strands = spark.createDataFrame([(1, 0, "+"), (1, 1, "-"), (2, 0, "-")], "read_id int, line_no int, strand string")
    overlaps.write_top_overlaps(top, strands, str(tmp_path / "o"))
    assert [tuple(r) for r in overlaps.read_table(spark, str(tmp_path / "o")).collect()] == [("1", "+", "2", "-", "9")]
