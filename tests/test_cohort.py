import pytest
from pyspark.sql import functions as F

from heldout.functions import scalars as S
from heldout.operators import cohort as C
from heldout.operators import features as X
from heldout.operators.ranking import bracket_interpolate, limit_per_group, select_ids_ordered

META = "patient_id string, sample_id string, cancer_type string"


def inputs(spark, meta=None, labels=None, types=None, quality=None, purity=None):
    base_meta = [("TCGA-AB-1234", "TCGA-AB-1234-01A", "BRCA")]
    base_label = [("TCGA-AB-1234-01", "4", "3", "2", "9")]
    mk = spark.createDataFrame
    return (
        mk(base_meta if meta is None else meta, META),
        mk(base_label if labels is None else labels, "sample string, loh string, lst string, tai string, total string"),
        mk([("TCGA-AB-1234", "BRCA")] if types is None else types, "sample string, cancer_type string"),
        mk([("HumanMethylation450", "TCGA-AB-1234-01A-11D", "False", "0.0")] if quality is None else quality,
           "platform string, aliquot string, do_not_use string, pathology_excluded string"),
        mk([] if purity is None else purity, "sample string, purity string, ploidy string"),
    )


ONE = ("TCGA-AB-1234", "TCGA-AB-1234-01A", "BRCA")
CASES = [
    ({"labels": [("TCGA-AB-1234-02", "4", "3", "2", "9")]}, "missing_or_ambiguous_label"),
    ({"labels": [("TCGA-AB-1234-01", "4", "3", "2", "9")] * 2}, "missing_or_ambiguous_label"),
    ({"labels": [("TCGA-AB-1234-01", "4", "3", "2", "12")]}, "part_sum_mismatch"),
    ({"labels": [("TCGA-AB-1234-01", "4", "x", "2", "9")]}, "invalid_label"),
    ({"types": [("TCGA-AB-1234", "OV")]}, "conflicting_group"),
    ({"quality": []}, "missing_quality_annotation"),
    ({"quality": [("HumanMethylation450", "TCGA-AB-1234-01A-11D", "True", "0.0")]}, "quality_excluded"),
    ({"meta": [ONE, ONE]}, "ambiguous_primary_specimens"),
    ({"meta": [("not-a-patient", "not-a-patient", "BRCA")]}, "invalid_barcode"),
    ({"meta": [("TCGA-AB-9999", "TCGA-AB-1234-01A", "BRCA")]}, "patient_metadata_mismatch"),
    ({"meta": [("TCGA-AB-1234", "TCGA-AB-1234-01A", "UNRESOLVED")]}, "missing_group"),
]


def test_kept_row(spark):
    kept, audit = C.audited_join(*inputs(spark))
    row = kept.first()
    assert (row["loh"], row["lst"], row["tai"], row["total"], row["partition"]) == (4.0, 3.0, 2.0, 9.0, "development")
    assert audit.first()["status"] == "included"


@pytest.mark.parametrize("change,reason", CASES)
def test_rejected(spark, change, reason):
    kept, audit = C.audited_join(*inputs(spark, **change))
    assert kept.count() == 0
    assert {r["reason"] for r in audit.collect()} == {reason}


def test_normal_sample_does_not_hide_the_primary(spark):
    meta = [ONE, ("TCGA-AB-1234", "TCGA-AB-1234-11A", "BRCA")]
    kept, audit = C.audited_join(*inputs(spark, meta=meta))
    assert kept.count() == 1
    assert {r["reason"] for r in audit.collect()} == {"unique_match", "not_primary_tumor"}


def test_no_types_is_fine(spark):
    assert C.audited_join(*inputs(spark, types=[]))[0].count() == 1


SEG = "sample string, chromosome string, arm string, seg_start long, seg_end long, log2r double"


def test_segments(spark):
    seg = spark.createDataFrame([("s", "1", "p", 0, 10_000_000, 0.4), ("s", "1", "p", 10_000_000, 40_000_000, 0.0)], SEG)
    row = X.segment_features(seg).first()
    assert row["altered_fraction"] == 0.25 and row["transitions"] == 1
    arms = spark.createDataFrame([("s", "1", "p", 0, 10_000_000, 0.4), ("s", "1", "q", 10_000_000, 40_000_000, 0.0)], SEG)
    assert X.segment_features(arms).first()["transitions"] == 0
    bad = spark.createDataFrame([("s", "1", "p", 0, 20, 0.4), ("s", "1", "p", 10, 30, 0.0), ("s", "X", "p", 0, 5, 0.1)], SEG)
    assert {r["violation"] for r in X.check_segments(bad).collect()} == {"overlap", "chromosome"}
    with pytest.raises(ValueError):
        X.segment_features(seg, threshold=0)


def test_limit_per_group_keeps_all_rows_of_a_unit(spark):
    df = spark.createDataFrame(list(enumerate([("a", "A"), ("a", "A"), ("b", "A"), ("c", "B"), ("c", "B"), ("d", "B")])), "i int, p struct<patient:string,type:string>")
    df = df.select("i", "p.patient", "p.type")
    assert sorted(r["i"] for r in limit_per_group(df, 1, "patient", "type").collect()) == [0, 1, 3, 4]


def test_select_ids_ordered(spark):
    df = spark.createDataFrame([(f"S{i:03d}",) for i in range(1, 601)], "id string")
    found, gone = select_ids_ordered(df, ["S003", "S999", "S001", "S003"])
    assert [r["id"] for r in found.collect()] == ["S003", "S001"] and [r["id"] for r in gone.collect()] == ["S999"]


def test_pairs_are_within_group_balanced_and_bounded(spark):
    df = spark.createDataFrame([(i, "AB"[i % 2], float(i % 7)) for i in range(40)], "id int, grp string, actual double")
    got = C.within_group_pairs(df, 3).toPandas()
    y, g = {i: float(i % 7) for i in range(40)}, {i: i % 2 for i in range(40)}
    assert all(g[a] == g[b] and a != b and y[a] != y[b] for a, b in zip(got["i"], got["j"]))
    assert all((y[a] > y[b]) == bool(o) for a, b, o in zip(got["i"], got["j"], got["outcome"]))
    assert len(got) <= 3 * 40 and 0.3 < got["outcome"].mean() < 0.7
    small = df.filter("id < 8")
    want = {frozenset(p) for p in [(a, b) for a in range(8) for b in range(a) if (a - b) % 2 == 0 and a % 7 != b % 7]}
    all_pairs = C.within_group_pairs(small, 3).collect()
    assert {frozenset((r["i"], r["j"])) for r in all_pairs} == want


def test_bracket_matches_numpy(spark):
    import numpy as np

    knots = spark.createDataFrame([(0.0, 0.1), (1.0, 0.4), (3.0, 0.9)], "score double, percentile double")
    xs = [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0]
    got = bracket_interpolate(spark.createDataFrame([(x,) for x in xs], "x double"), knots, "x", "q").toPandas()
    assert np.allclose(got.sort_values("x")["q"], np.interp(xs, [0, 1, 3], [0.1, 0.4, 0.9]))


def test_interval_lookup(spark):
    seg = spark.createDataFrame([("s", 0, 10), ("s", 10, 25), ("s", 40, 41)], "sample string, seg_start long, seg_end long")
    pts = spark.createDataFrame([("s", x) for x in (0, 9, 9, 10, 24, 25, 40, 41)], "sample string, x long")
    assert C.interval_lookup(pts, seg, ["sample"], "x", 7).count() == 8
    got = {r["x"]: r["seg_start"] for r in C.interval_lookup(pts, seg, ["sample"], "x", 7).collect()}
    assert got == {0: 0, 9: 0, 10: 10, 24: 10, 25: None, 40: 40, 41: None}


def test_empty_inputs_keep_the_schema(spark):
    empty = spark.createDataFrame([], "id long, grp string, actual double, pred double, covariate double")
    from heldout.operators.metrics import metrics_panel, null_panel

    assert metrics_panel(empty, ["grp"]).count() == 0
    row = null_panel(empty).first()
    assert row["n"] == 0 and row["mae_model"] is None


def test_unit_interval_and_transforms(spark):
    df = spark.createDataFrame([("0.5",), ("NA",), (" nan ",), ("1.5",), ("x",), ("Infinity",)], "t string")
    value, valid = S.unit_interval("t")
    got = [(r[0], r[1]) for r in df.select(value, valid).collect()]
    assert got == [(0.5, True), (None, True), (None, True), (None, False), (None, False), (None, False)]
    clip = spark.range(1).select(S.clip_floor(F.lit(None).cast("double")).alias("a"), S.clip_floor(F.lit(-1.0)).alias("b")).first()
    assert clip["a"] is None and clip["b"] == 0.0
