import pytest
from pyspark.sql import functions as F

from heldout.plans.storage import scratch_path
from heldout.sources import manifest as MF
from heldout.sources import matrix as MX
from heldout.sources import sinks as SK


@pytest.fixture
def matrix(spark, tmp_path):
    p = tmp_path / "beta.tsv"
    p.write_text("probe_id\tTCGA-A\tTCGA-B\tTCGA-C\ncg1\t0.1\t0.2\tNA\ncg2\t0.5\t0.9\t0.4\ncg3\t0.3\t0.3\t0.3\n")
    return str(p)


def test_matrix_orientation(spark, matrix):
    m = MX.scan_matrix_tsv(spark, matrix)
    assert {r["feature"]: r["x"] for r in m.collect()} == {"cg1": [0.1, 0.2, None], "cg2": [0.5, 0.9, 0.4], "cg3": [0.3, 0.3, 0.3]}
    assert [r["sample"] for r in MX.scan_header_only(spark, matrix).orderBy("pos").collect()] == ["TCGA-A", "TCGA-B", "TCGA-C"]
    assert MX.matrix_violations(m, 3).count() == 0


def test_matrix_column_selection(spark, matrix):
    m = MX.scan_matrix_tsv(spark, matrix, keep=[2, 0])
    assert {r["feature"]: r["x"] for r in m.collect()}["cg2"] == [0.4, 0.5]


def test_topk_drops_missing_and_constant(spark, matrix):
    top = MX.scan_matrix_topk(MX.scan_matrix_tsv(spark, matrix), 5, 0.05).collect()
    assert [r["feature"] for r in top] == ["cg2"]
    counts = MX.matrix_counts(MX.scan_matrix_tsv(spark, matrix), 0.05).first().asDict()
    assert (counts["seen"], counts["dropped_missing"], counts["dropped_constant"], counts["out_of_range"]) == (3, 1, 1, 0)


def test_matrix_violations(spark, tmp_path):
    p = tmp_path / "bad.tsv"
    p.write_text("probe_id\tA\tB\ncg1\t0.1\t0.2\ncg1\t0.1\t0.2\ncg2\t1.5\t0.2\ncg3\t0.5\n")
    found = {r["feature"]: r["violation"] for r in MX.matrix_violations(MX.scan_matrix_tsv(spark, str(p)), 2).collect()}
    assert found == {"cg1": "duplicate", "cg2": "out_of_range", "cg3": "column_count"}


def test_bom_and_gene_sets(spark, tmp_path):
    t = tmp_path / "dim.tsv"
    t.write_bytes("﻿a\tb\n1\tNA\n2\tx\n".encode())
    assert [tuple(r) for r in MX.scan_tsv_table(spark, str(t), "a int, b string").orderBy("a").collect()] == [(1, None), (2, "x")]
    s = tmp_path / "sets.csv"
    s.write_text("pos, g1,g2,\nneg,g3\n")
    sets = MX.scan_gene_sets(spark, str(s))
    assert {tuple(r) for r in sets.collect()} == {("pos", "g1"), ("pos", "g2"), ("neg", "g3")}
    assert MX.gene_set_violations(sets).count() == 0


def test_digest_check(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("hello")
    files = MF.file_digests(spark, str(tmp_path / "d"))
    rows = [("f.txt", 5, "5d41402abc4b2a76b9719d911017c592"), ("g.txt", 1, "x")]
    got = {r["filename"]: r["status"] for r in MF.digest_check(files, spark.createDataFrame(rows, "filename string, size long, md5 string")).collect()}
    assert got == {"f.txt": "ok", "g.txt": "missing"}


def test_absent_sidecar_keeps_schema(spark):
    empty = MX.scan_sidecar_json(spark, scratch_path(spark, "nothing"))
    assert empty.count() == 0 and "engineering_only" in empty.columns


def test_ledger_and_resume(spark):
    path = scratch_path(spark, "ledger")
    entry = spark.createDataFrame([("r1", "m", "g", 3, 0.5)], "run_id string, model string, grp string, n long, mae double").withColumn("evaluated_at", F.current_timestamp())
    assert SK.recorded_evaluation(entry, path, lambda: None) == 0
    assert SK.sink_ledger_append(entry.withColumn("status", F.lit("finished")), path) == 2
    with pytest.raises(RuntimeError):
        SK.recorded_evaluation(entry, path, lambda: (_ for _ in ()).throw(RuntimeError()))
    assert SK.read_ledger(spark, path).filter("status = 'started'").count() == 2
    folds = scratch_path(spark, "folds")
    run = lambda f: spark.createDataFrame([(f,)], "v string")
    assert SK.sink_fold_resumable(spark, folds, ["a", "b"], run) == ["a", "b"]
    assert SK.sink_fold_resumable(spark, folds, ["a", "b", "c"], run) == ["c"]


def test_sample_files_union(spark, tmp_path):
    for s, text in (("s1", "cg1\t0.1\nrs9\t0.5\ncg2\tNA\n"), ("s2", "cg2\t0.7\n")):
        (tmp_path / f"{s}.txt").write_text(text)
    man = spark.createDataFrame([("s1", "P1"), ("s2", "P2")], "file_key string, sample string")
    got = {(r["sample"], r["feature"]): r["value"] for r in MX.scan_sample_files(spark, str(tmp_path), man, r"([^/]+)\.txt$").collect()}
    assert got == {("P1", "cg1"): 0.1, ("P1", "cg2"): None, ("P2", "cg2"): 0.7}


def test_digests_in_blocks_equal_whole_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        (tmp_path / "d" / f"f{k}").write_bytes(bytes([k]) * (10 + 9_000_000 * k))
    whole, blocks = (sorted(map(tuple, MF.file_digests(spark, str(tmp_path / "d"), limit).collect())) for limit in (1 << 30, 0))
    assert whole == blocks and len(whole) == 3


def test_separator_is_literal(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("id|A|B\ncg1|0.5|NA\n")
    assert [tuple(r) for r in MX.scan_matrix_tsv(spark, str(p), "|").collect()] == [("cg1", [0.5, None])]
    assert [r["sample"] for r in MX.scan_header_only(spark, str(p), "|").collect()] == ["A", "B"]


def test_text_in_a_cell_and_other_headers_are_errors(spark, tmp_path):
    (tmp_path / "bad.tsv").write_text("id\tA\ncg1\tabc\n")
    with pytest.raises(Exception, match="not a number in a matrix cell: abc"):
        MX.scan_matrix_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.tsv").write_text("id\tA\tB\ncg1\t0.1\t0.2\n")
    (tmp_path / "two" / "b.tsv").write_text("id\tB\tA\ncg2\t0.1\t0.2\n")
    with pytest.raises(Exception, match="different headers"):
        MX.scan_matrix_tsv(spark, str(tmp_path / "two")).collect()


def test_provenance_hash_covers_values(spark):
    def record(rows):
        m = spark.createDataFrame(rows, "feature string, x array<double>")
        return SK.provenance_record(m, m.select("feature"), "t").first()

    base = record([("a", [0.1, None]), ("b", [0.2, 0.3])])
    assert record([("b", [0.2, 0.3]), ("a", [0.1, None])]) == base
    for other in ([("a", [0.1, 0.0]), ("b", [0.2, 0.3])], [("a", [0.1, None]), ("b", [0.2, 0.4])], [("a", [0.2, 0.3]), ("b", [0.1, None])]):
        assert record(other)["sha256"] != base["sha256"] and record(other)["allowlist_sha256"] == base["allowlist_sha256"]
