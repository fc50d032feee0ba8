import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heldout.operators import calibration as K
from heldout.operators import checks as C
from heldout.operators import gene_sets as G
from heldout.operators import metrics as M
from heldout.operators import reports as P
from heldout.operators import resampling as R


def preds(spark, n=90, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "grp": np.array(list("ABC"))[np.arange(n) % 3], "actual": np.round(rng.gamma(3, 5, n), 1)})
    pdf["pred"] = np.round(0.7 * pdf["actual"] + rng.normal(size=n) * 3 + 1, 1)
    pdf["covariate"] = np.round(rng.random(n), 2)
    return pdf, spark.createDataFrame(pdf)


def test_degenerate_groups_give_null_not_errors(spark):
    rows = [(1, "one", 3.0, 4.0), (2, "flat", 1.0, 5.0), (3, "flat", 2.0, 5.0), (4, "flat", 3.0, 5.0), (5, "gone", None, 1.0)]
    got = {r["grp"]: r for r in M.metrics_panel(spark.createDataFrame(rows, "id int, grp string, actual double, pred double")).collect()}
    assert set(got) == {"one", "flat"}
    assert got["one"]["n"] == 1 and got["one"]["pearson"] is None and got["one"]["r2"] is None
    assert got["flat"]["calibration_slope"] is None and got["flat"]["mae"] == 3.0


def test_panel_against_numpy(spark):
    pdf, df = preds(spark)
    got = {r["grp"]: r for r in M.metrics_panel(df).collect()}
    for g, s in pdf.groupby("grp"):
        assert got[g]["spearman"] == pytest.approx(s["actual"].rank().corr(s["pred"].rank()))
        slope, icpt = np.polyfit(s["pred"], s["actual"], 1)
        assert got[g]["calibration_slope"] == pytest.approx(slope) and got[g]["calibration_intercept"] == pytest.approx(icpt)


def test_auc_guards(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, False), (0.35, True), (0.8, True)], "s double, e boolean")
    assert M.auc_rank(df, [], "s", F.col("e")).first()["auc"] == 0.75
    assert M.auc_rank(df, [], "s", F.col("e"), min_class=3).first()["auc"] is None


def test_permutation_of_constant_score(spark):
    _, df = preds(spark)
    row = R.permutation_test_spearman(df.withColumn("pred", F.lit(1.0)), 5).first()
    assert (row["observed_rho"], row["p_value"], row["n_perm"]) == (0.0, 1.0, 0)


def test_permutation_keeps_group_values(spark):
    pdf, df = preds(spark)
    got = R.permute(df, ["grp"], "actual", "s", 1).toPandas()
    for g, s in got.groupby("grp"):
        assert sorted(s["s"]) == sorted(pdf.loc[pdf.grp == g, "actual"])
    assert (got["s"] != got["actual"]).any()


def test_bootstrap_draws_as_many_as_rows(spark):
    _, df = preds(spark)
    w = R.drawn(df, 4, ["grp"], ["actual"], 3).groupBy("b", "grp").agg(F.sum("w").alias("w")).toPandas()
    assert len(w) == 12 and (w["w"] == 30).all()


def test_sum_abs_deviation_brute_force(spark):
    pdf, df = preds(spark)
    pts = [("A", 1, 0.0), ("A", 2, 7.5), ("B", 1, 13.3), ("C", 1, 99.0)]
    got = K.sum_abs_deviation(df, spark.createDataFrame(pts, "grp string, k int, c double"), "grp", "actual", ["c"], 2).collect()
    for r in got:
        assert r["_all_c"] == pytest.approx(np.abs(pdf.loc[pdf.grp == r["grp"], "actual"] - r["c"]).sum())


def test_draws_only_send_the_first_rows(spark):
    """Few labelled rows per group and replicate leave a task; groups too large for one take a limited window, not a sort of the whole."""
    _, df = preds(spark)
    rows = df.withColumn("r", F.col("pred") - F.col("actual"))
    assert R.first_rows(rows, 4, "grp", 5, ["r"], 1).groupBy("b", "grp").count().agg(F.max("count"), F.count("count")).first()[:] == (5, 12)
    spark.conf.set("spark.heldout.hotRows", "20")
    try:
        plan = K.labelled_draws(rows, (3, 5), 4, 1)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.heldout.hotRows")
    assert "WindowGroupLimit" in plan


def group_table(spark, noise):
    rng = np.random.default_rng(1)
    x, z = rng.random(20), rng.normal(size=20)
    pdf = pd.DataFrame({"grp": [f"T{i}" for i in range(20)], "x": x, "z": z, "offset": 2.5 * x + rng.normal(size=20) * noise})
    return pdf, spark.createDataFrame(pdf)


def test_calibrator_against_least_squares(spark):
    pdf, df = group_table(spark, 0.05)
    got = K.group_offset_calibrator(df, ["x", "z"]).toPandas().set_index("grp")
    for i, g in enumerate(pdf["grp"]):
        rest = pdf.drop(index=i)
        beta = np.linalg.lstsq(np.column_stack([np.ones(19), rest["x"], rest["z"]]), rest["offset"], rcond=None)[0]
        assert got.loc[g, "predicted"] == pytest.approx(beta @ [1, pdf.x[i], pdf.z[i]])


def test_calibrator_positive_and_negative_control(spark):
    good = K.group_offset_summary(K.group_offset_calibrator(group_table(spark, 0.05)[1], ["x"])).first()
    noise = K.group_offset_summary(K.group_offset_calibrator(group_table(spark, 5.0)[1], ["x"])).first()
    assert good["loto_r2"] > 0.8 and noise["loto_r2"] < 0.2


def test_ols_nested(spark):
    pdf, df = group_table(spark, 0.5)
    got = K.ols_nested(df, "offset", [["x"], ["x", "z"]]).toPandas()
    for cols, r in zip((["x"], ["x", "z"]), got.itertuples()):
        a = np.column_stack([np.ones(20), pdf[cols]])
        res = pdf["offset"] - a @ np.linalg.lstsq(a, pdf["offset"], rcond=None)[0]
        assert r.r2 == pytest.approx(1 - (res**2).sum() / ((pdf["offset"] - pdf["offset"].mean()) ** 2).sum())
    assert np.isnan(got["p_vs_first"][0]) and 0 < got["p_vs_first"][1] < 1
    assert K._f_tail(4.0, 1, 10) == pytest.approx(0.07339, abs=1e-4)  # published F table value


def test_ssgsea_hand_value(spark):
    long = spark.createDataFrame([(1, "a", 4.0), (1, "b", 3.0), (1, "c", 2.0), (1, "d", 1.0)], "id int, feature string, value double")
    sets = spark.createDataFrame([("s", "a"), ("s", "c")], "set_name string, feature string")
    w = np.array([4.0, 2.0]) ** 0.25
    steps_in, steps_out = np.cumsum([w[0], 0, w[1], 0]) / w.sum(), np.cumsum([0, 1, 0, 1]) / 2
    assert G.ssgsea(long, sets).first()["score"] == pytest.approx((steps_in - steps_out).sum())


def test_gene_ids(spark):
    ens = spark.createDataFrame([("ENSG01.2",), ("ENSG02",)], "raw_id string")
    assert {(r["id_type"], r["gene_id"]) for r in G.resolve_gene_ids(ens).collect()} == {("ensembl", "ENSG01"), ("ensembl", "ENSG02")}
    assert G.resolve_gene_ids(spark.createDataFrame([("7157",), ("TP53",)], "raw_id string")).first()["id_type"] == "symbol"


def test_identity_r2_degenerate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0)], "grp string, v double")
    assert M.group_identity_r2(df, ["v"]).first()["group_r2"] is None


@pytest.mark.parametrize(
    "record,override,want",
    [
        ([(False, "abc")], False, ("verified", True)),
        ([(True, "abc")], False, ("engineering_fixture", False)),
        ([(False, None)], False, ("no_allowlist_hash", False)),
        ([], False, ("absent", False)),
        ([(True, "abc")], True, ("engineering_fixture", True)),
    ],
)
def test_provenance(spark, record, override, want):
    row = C.provenance_class(spark.createDataFrame(record, "engineering_only boolean, allowlist_sha256 string"), override).first()
    assert (row["provenance"], row["allowed"]) == want


def test_partition_gate(spark):
    ok = [("BRCA", "development"), ("GBM", "locked"), ("LGG", "locked")]
    bad = [("GBM", "development"), ("BRCA", "locked"), ("X", None), ("X", ""), ("X", "held_out")]
    mk = lambda rows: spark.createDataFrame(rows, "grp string, partition string")
    assert C.check_partition_agreement(mk(ok), ["GBM", "LGG"]).count() == 0
    found = {r["violation"] for r in C.check_partition_agreement(mk(bad), ["GBM", "LGG"]).collect()}
    assert found == {"listed_but_open", "locked_but_not_listed", "blank", "unknown_label"}
    with pytest.raises(C.GateError):
        C.enforce(C.check_partition_agreement(mk(bad), ["GBM", "LGG"]), "partition")
    with pytest.raises(C.GateError):
        C.require_columns(mk(ok), ["grp", "missing"])


def test_locked_guard(spark):
    scored = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    meta = spark.createDataFrame([(1, "development"), (2, "locked")], "id int, partition string")
    assert {r["violation"] for r in C.locked_scoring_guard(scored, meta, False).collect()} == {"unknown_sample", "locked_without_opt_in"}
    assert {r["violation"] for r in C.locked_scoring_guard(scored, meta, True).collect()} == {"unknown_sample"}
    assert C.locked_scoring_guard(scored, None, True).first()["violation"] == "opt_in_without_metadata"


def test_fold_gate_accepts_complete_folds(spark):
    exp = spark.createDataFrame([("a",), ("b",)], "fold string")
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "fold string, id int")
    m = spark.createDataFrame([("a", 2, "x"), ("b", 1, "x")], "fold string, n int, protocol string")
    assert C.fold_completeness(exp, p, m, exp).count() == 0


def test_wilcoxon_known_value(spark):
    d = [0.5, -0.1, 0.8, 0.9, 1.2, -0.3, 1.1, 0.7, 0.2, 0.6]
    row = P.wilcoxon_signed_rank(spark.createDataFrame([(v,) for v in d], "d double"), "d").first()
    ranks = pd.Series(np.abs(d)).rank()
    assert row["w_plus"] == ranks[np.array(d) > 0].sum() and 0 < row["p_normal"] < 0.05


def test_gene_ids_ignore_blanks_and_check_forms(spark):
    rows = G.resolve_gene_ids(spark.createDataFrame([("A|1",), ("",), (None,), ("?|2",), ("B|1",)], "raw_id string"))
    assert {(r["raw_id"], r["id_type"], r["gene_id"], r["valid"]) for r in rows.collect()} == {
        ("A|1", "compound", "1", True), ("", "compound", "", False), (None, "compound", None, False), ("?|2", "compound", "2", True), ("B|1", "compound", "1", True)
    }
    assert [tuple(r) for r in G.gene_id_duplicates(rows).collect()] == [("1", 2)]


def test_small_p_values_keep_their_digits(spark):
    import math

    from heldout.functions.scalars import pnorm_two_sided

    for r in spark.createDataFrame([(z / 4,) for z in range(0, 80)], "z double").withColumn("p", pnorm_two_sided(F.col("z"))).collect():
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)), rel=1e-6)


def test_first_value_has_an_order(spark):
    scores = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "key string, o int, s string")
    master = spark.createDataFrame([("k", 3, "z", None), ("k", 1, None, 5), ("k", 2, "y", 6)], "key string, seq int, v string, w int").repartition(3)
    from heldout.operators.cohort import first_per_key_merge

    assert tuple(first_per_key_merge(scores, master, "key", ["o"], ["v", "w"], ["seq"]).first()) == ("k", 1, "a", "y", 5)


def test_wide_panel_has_intervals_and_pooled_columns(spark):
    rng = np.random.default_rng(4)
    y = np.round(rng.normal(size=60), 1)
    rows = [(k, "AB"[k % 2], float(y[k]), float(np.round(y[k] + rng.normal(), 1))) for k in range(60)] + [(100 + k, "tiny", float(k), 1.0 - k) for k in range(4)]
    rows += [(200 + k, None, float(k), float(k % 3)) for k in range(7)] + [(300, "A", None, 1.0)]
    df = spark.createDataFrame(rows, "id long, grp string, actual double, pred double")
    got = {(r["scope"], r["grp"]): r for r in M.group_panel_wide(df, b=40, seed=3).collect()}
    assert set(got) == {("group", "A"), ("group", "B"), ("group", "tiny"), ("group", None), ("pooled", "POOLED")}
    limits = ["pearson_lo", "pearson_hi", "spearman_lo", "spearman_hi"]
    for keys, scope in ((["grp"], "group"), ([], "pooled")):
        for r in R.bootstrap_pairs_ci(df, 40, keys, 3).collect():
            own = got[scope, r["grp"] if keys else "POOLED"]
            assert [own[c] for c in limits] == [pytest.approx(r[c]) for c in limits] and own["pearson_lo"] < own["pearson"] < own["pearson_hi"]
    assert all(got["group", "tiny"][c] is None for c in limits) and got["group", "tiny"]["n"] == 4
    pooled, within = got["pooled", "POOLED"], M.within_group_metrics(df).first()
    assert (pooled["boot_b"], pooled["boot_seed"]) == (40, 3)
    assert [pooled[c] for c in ("within_pearson", "within_spearman")] == [pytest.approx(within[c]) for c in ("within_pearson", "within_spearman")]
    share = {r["quantity"]: r["group_r2"] for r in M.group_identity_r2(df.dropna(subset=["actual", "pred"]), ["pred", "actual"]).collect()}
    assert (pooled["group_r2_pred"], pooled["group_r2_actual"]) == (pytest.approx(share["pred"]), pytest.approx(share["actual"]))
    assert all(got["group", "A"][c] is None for c in M.POOLED_ONLY)
