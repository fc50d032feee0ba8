import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heldout.operators import features as X
from heldout.operators import model as M
from heldout.operators.ranking import apply_isotonic, isotonic_weighted, within_group_percentile

K = 6
GRID = {"alphas": (0.5, 1.0), "steps": 4}


def cohort(seed=1, n=120, holes=0.0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, K))
    g = np.array(list("ABCD"))[np.arange(n) % 4]
    y = 30 * x[:, 0] - 15 * x[:, 1] + rng.normal(size=n) + 2.0 * (np.arange(n) % 4)
    x[rng.random((n, K)) < holes] = np.nan
    return x, y, g


def frame(spark, x, y, g):
    rows = [(i, str(gg), float(yy), [None if np.isnan(v) else float(v) for v in xx]) for i, (xx, yy, gg) in enumerate(zip(x, y, g))]
    return spark.createDataFrame(rows, "id long, grp string, y double, x array<double>")


def test_grid_is_optimal_and_matches_spark_lasso(spark):
    """Coefficients from summed products satisfy the optimality conditions on the rows; the lasso equals Spark ML's."""
    x, y, g = cohort()
    rows = frame(spark, x, y, g)
    models = M.fit_sets(rows, M.exclusion_sets(rows), K, missing=False, **GRID).filter("inner_group IS NULL AND outer_group = 'A'").toPandas()
    train = g != "A"
    mean, sd = x[train].mean(0), x[train].std(0, ddof=1)
    z, yt = (x[train] - mean) / sd, y[train]
    for m in models.to_dict("records"):
        beta = np.zeros(K)
        beta[list(m["pos"])] = np.array(m["beta"]) * sd[list(m["pos"])]
        grad = z.T @ (yt - yt.mean() - z @ beta) / len(yt) - m["lambda"] * (1 - m["alpha"]) / yt.std() * beta
        l1 = m["lambda"] * m["alpha"]
        assert np.allclose(grad[beta != 0], l1 * np.sign(beta[beta != 0]), atol=1e-5)
        assert (np.abs(grad[beta == 0]) <= l1 + 1e-5).all()
        assert m["intercept"] + (beta / sd) @ mean == pytest.approx(yt.mean())
        if m["alpha"] == 1.0 and m["step"] == 2:
            fit = M.elastic_net_fit(frame(spark, z, yt, g[train]), 1.0, float(m["lambda"]))
            assert np.allclose(beta, fit.coefficients.toArray(), atol=1e-4)


def test_imputed_fold_equals_direct(spark):
    """Medians, means and coefficients of an inner fold equal those computed from its rows alone."""
    x, y, g = cohort(holes=0.1)
    rows = frame(spark, x, y, g)
    models = M.fit_sets(rows, M.exclusion_sets(rows), K, alphas=(1.0,), steps=4, max_missing=1.0).filter("set_id = 'A|B'").toPandas()
    train = ~np.isin(g, ["A", "B"])
    med = np.nanmedian(x[train], axis=0)
    xi = np.where(np.isnan(x), med, x)
    m = models.sort_values("step").iloc[-1]
    assert np.allclose(m["fill"], med[list(m["pos"])])
    assert np.allclose(m["mean"], xi[train].mean(0)[list(m["pos"])])
    assert np.allclose(m["sd"], xi[train].std(0, ddof=1)[list(m["pos"])])
    z = frame(spark, (xi[train] - xi[train].mean(0)) / xi[train].std(0, ddof=1), y[train], g[train])
    fit = M.elastic_net_fit(z, 1.0, float(m["lambda"]))
    beta = np.zeros(K)
    beta[list(m["pos"])] = m["beta"]
    assert np.allclose(beta * xi[train].std(0, ddof=1), fit.coefficients.toArray(), atol=1e-4)


def test_held_out_rows_cannot_leak(spark):
    """Garbled rows of the left-out group leave its models unchanged."""
    x, y, g = cohort()
    a = M.fit_sets(frame(spark, x, y, g), M.exclusion_sets(frame(spark, x, y, g)), K, missing=False, **GRID)
    x2, y2 = x.copy(), y.copy()
    x2[g == "A"] = 0.9 + 0.05 * np.random.default_rng(9).random((int((g == "A").sum()), K))
    y2[g == "A"] = 1e3
    b = M.fit_sets(frame(spark, x2, y2, g), M.exclusion_sets(frame(spark, x, y, g)), K, missing=False, **GRID)
    keys = ["set_id", "alpha", "step"]
    pa, pb = (d.filter("outer_group = 'A'").toPandas().sort_values(keys).reset_index(drop=True) for d in (a, b))
    assert len(pa) == 4 * 2 * 4
    for u, v in zip(pa.itertuples(), pb.itertuples()):
        # sums are total less excluded, so equality holds to rounding of the totals
        assert list(u.pos) == list(v.pos)
        assert np.allclose(u.beta, v.beta, rtol=1e-5, atol=1e-6)
        assert np.isclose(u.intercept, v.intercept, rtol=1e-5, atol=1e-6)


def test_nested_run_predicts_and_scores_rows_alike(spark):
    x, y, g = cohort()
    rows = frame(spark, x, y, g)
    run = M.logo_nested(rows, K, missing=False, **GRID)
    pred = run["predictions"].toPandas().sort_values("id")
    assert np.corrcoef(pred["actual"], pred["pred"])[0, 1] > 0.9
    one = M.score(rows.filter("id = 7"), run["final"], K, left_out=True).first()["pred"]
    assert one == pytest.approx(pred.loc[pred.id == 7, "pred"].item())
    null = pred.groupby("grp")["null_pred"].first()
    assert null["A"] == pytest.approx(y[g != "A"].mean())
    tuning = run["tuning"].toPandas()
    brute = tuning.sort_values(["loss", "alpha", "step"]).groupby("outer_group").first()
    got = run["selected"].toPandas().set_index("outer_group")
    assert (brute["lambda"] == got["lambda"]).all()
    assert (M.select_1se(run["tuning"]).toPandas().set_index("outer_group")["lambda"] >= 0).all()


def test_inner_loss_is_the_mae_of_the_left_out_group(spark):
    x, y, g = cohort(holes=0.05)
    rows = frame(spark, x, y, g)
    models = M.fit_sets(rows, M.exclusion_sets(rows), K, alphas=(1.0,), steps=3, max_missing=1.0)
    losses = M.inner_losses(rows, models, K).filter("outer_group = 'A' AND inner_group = 'B' AND step = 2").first()
    m = models.filter("set_id = 'A|B' AND step = 2").first()
    beta, fill = np.zeros(K), np.zeros(K)
    beta[list(m["pos"])], fill[list(m["pos"])] = m["beta"], m["fill"]
    xi = np.where(np.isnan(x), fill, x)
    assert losses["mae"] == pytest.approx(np.abs(m["intercept"] + xi[g == "B"] @ beta - y[g == "B"]).mean())


def test_noise_has_no_skill(spark):
    rng = np.random.default_rng(5)
    x, _, g = cohort()
    y = rng.normal(size=len(g))
    pred = M.logo_nested(frame(spark, x, y, g), K, missing=False, **GRID)["predictions"].toPandas()
    assert abs(pred[["actual", "pred"]].corr().iloc[0, 1]) < 0.4 or pred["pred"].nunique() <= 4


def test_freeze_keeps_a_holdout_in_every_group(spark):
    x, y, g = cohort()
    run = M.freeze_model(frame(spark, x, y, g), K, missing=False, **GRID)
    roles = run["partitions"].toPandas().groupby(["grp", "role"]).size().unstack()
    assert (roles["calibration"] == 6).all() and roles.to_numpy().sum() == len(g)
    assert run["model"].first()["n_train"] == 96
    assert run["conformal"].first()["status"] in ("finite", "infinite")


def test_group_weights_equal_replication(spark):
    """Weighting groups equally equals fitting on groups of equal size."""
    x, y, g = cohort(n=80)
    big = g == "A"
    xr, yr, gr = np.vstack([x, x[big], x[big]]), np.concatenate([y, y[big], y[big]]), np.concatenate([g, g[big], g[big]])
    opts = {"alphas": (1.0,), "steps": 3, "missing": False}
    a, b = frame(spark, x, y, g), frame(spark, xr, yr, gr)
    pick = lambda rows, w: M.fit_sets(rows, M.single_sets(rows), K, weights=w, **opts).filter("inner_group IS NULL AND step = 2").first()
    # unweighted standardisation differs between the two, so compare predictions at a tiny penalty
    u, v = pick(a, "sample"), pick(b, "group")
    assert np.allclose(u["beta"], v["beta"], rtol=0.02)


def test_pairwise_ranker(spark):
    x, y, g = cohort(n=80)
    z = frame(spark, (x - x.mean(0)) / x.std(0), y, g)
    fit = M.pairwise_rank_fit(z, 3, lambdas=(0.01,))
    assert len(fit["model"]) == K and fit["scores"].count() == 80
    scores = M.pairwise_predict(fit["model"], z).toPandas()
    ranks = scores.groupby("grp")[["y", "relative_score"]].rank().assign(grp=scores["grp"])
    assert ranks.groupby("grp").corr().iloc[0::2, 1].min() > 0.8


def test_meta_association_matches_rows(spark):
    x, y, g = cohort(n=60)
    rng = np.random.default_rng(2)
    x[rng.random(x.shape) < 0.1] = np.nan
    long = [(i, str(g[i]), f"f{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(60) for j in range(K)]
    df = spark.createDataFrame(long, "id long, grp string, feature string, value double")
    s = X.centred_label(spark.createDataFrame([(i, str(g[i]), float(y[i])) for i in range(60)], "id long, grp string, y double"))
    med = X.feature_medians(df)
    stats = X.imputed_stats(X.group_stats(df.join(s.select("id", "yc"), "id")), med)
    got = X.meta_association(stats, X.label_squares(s)).toPandas().sort_values("feature")
    xi = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    w = 15 - 3
    z = np.array([[np.arctanh(np.corrcoef(xi[g == h, j], y[g == h])[0, 1]) for h in "ABCD"] for j in range(K)])
    assert np.allclose(got["z_meta"], (w * z).sum(1) / np.sqrt(4 * w))
    assert np.allclose(got["consistency"], np.abs(np.sign(z).sum(1)) / 4)
    within = sum(((xi[g == h] - xi[g == h].mean(0)) ** 2).sum(0) for h in "ABCD")
    assert np.allclose(got["lineage"], 1 - within / ((xi - xi.mean(0)) ** 2).sum(0))
    var = X.within_group_variance(stats).toPandas().sort_values("feature")["score"]
    assert np.allclose(var, within / 56)


def test_isotonic_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x, w = np.round(np.sort(rng.random(30)), 2), rng.random(30) + 0.1
    y = x + rng.normal(size=30) * 0.4
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": w}))
    got = apply_isotonic(isotonic_weighted(df, "x", "y", "w"), df, "x", "fit").toPandas().sort_values("x")
    pooled = pd.DataFrame({"x": x, "yw": y * w, "w": w}).groupby("x").sum()
    v, ww = (pooled["yw"] / pooled["w"]).to_numpy(), pooled["w"].to_numpy()
    n = len(v)
    mean = lambda a, b: np.average(v[a : b + 1], weights=ww[a : b + 1])
    want = {xx: max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i, xx in enumerate(pooled.index)}
    assert np.allclose(got["fit"], got["x"].map(want))


def test_percentile_hand_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0)], "grp string, actual double")
    got = sorted(r["q"] for r in within_group_percentile(df, ["grp"], "actual", "q").collect())
    assert got == [0.125, 0.5, 0.5, 0.875]


def test_constant_label_path_is_fixed(spark):
    flat = spark.createDataFrame([("f", 0.0)], "feature string, xy double")
    got = X.lambda_path(flat.withColumn("n", F.lit(10)), F.col("n"), 0.5)
    assert [r["lambda"] for r in got.orderBy("step").collect()] == [1.0, 0.1, 0.01]


def test_features_with_holes_in_training_take_no_part(spark):
    x, y, g = cohort()
    x[:, 0] = np.where(np.random.default_rng(2).random(len(x)) < 0.6, np.nan, 3 * y + 0.1 * x[:, 0])
    rows = frame(spark, x, y, g)
    models = M.fit_sets(rows, M.exclusion_sets(rows), K, alphas=(1.0,), steps=3).select("pos").collect()
    assert models and not any(0 in m["pos"] for m in models)


def test_bad_runs_are_errors(spark):
    x, y, g = cohort()
    rows = frame(spark, x, y, g)
    with pytest.raises(ValueError, match="unknown ranker"):
        M.logo_nested(rows, K, rank="lineage")
    with pytest.raises(ValueError, match="three groups"):
        M.logo_nested(rows.filter("grp IN ('A', 'B')"), K)


def test_screened_folds_equal_the_whole_product(spark, monkeypatch):
    """Only kept features are multiplied, in tiles; coefficients and positions are those of the whole product."""
    x, y, g = cohort()
    wide = np.column_stack([x * 3, np.random.default_rng(8).normal(size=(len(x), 25)) * 0.01])
    wide[::9, 1] = np.nan
    rows = frame(spark, wide, y, g)
    opts = {"alphas": (0.5,), "steps": 3, "top": 4, "max_missing": 0.5}
    sets = M.exclusion_sets(rows)
    seen = []
    real = M.group_products

    def spied(rows, group="grp", features=None):
        seen.append(features)
        return real(rows, group, features)

    def models():
        found = M.fit_sets(rows, sets, wide.shape[1], **opts).orderBy("set_id", "alpha", "step").collect()
        return [(m["set_id"], m["step"], m["pos"], np.round(m["beta"], 9).tolist(), np.round(m["fill"], 9).tolist()) for m in found]

    monkeypatch.setattr(M, "group_products", spied)
    screened = models()
    monkeypatch.setattr(M, "TASK_BYTES", 4000)
    assert models() == screened
    monkeypatch.setattr(M, "screen", lambda *a: list(range(wide.shape[1])))
    assert models() == screened
    assert seen[0] == seen[1] < 12 and seen[2] == wide.shape[1] and {p for m in screened for p in m[2]} <= set(range(K))


@pytest.mark.parametrize("limit", ["1000000", "10"])
def test_medians_of_all_sets(spark, limit):
    x, y, g = cohort()
    rng = np.random.default_rng(3)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 2] = np.round(x[:, 2])
    rows = frame(spark, x, y, g)
    sets = M.exclusion_sets(rows)
    spark.conf.set("spark.heldout.hotRows", limit)
    try:
        got = {r["set_id"]: r["v"] for r in M.fold_medians(rows, sets, x.shape[1]).collect()}
    finally:
        spark.conf.unset("spark.heldout.hotRows")
    for s in sets.collect():
        assert np.allclose(got[s["set_id"]], np.nanmedian(x[~np.isin(g, s["excluded"])], axis=0))


def test_wide_rows(spark):
    """More features than a whole product could hold: 20,000, of which each fold keeps 30."""
    rng = np.random.default_rng(6)
    n, k = 60, 20_000
    g = np.array(list("ABC"))[np.arange(n) % 3]
    x = rng.normal(size=(n, k)) * 0.1
    x[:, 100:120] *= 20
    y = x[:, 100:110].sum(1) + rng.normal(size=n)
    models = M.fit_sets(frame(spark, x, y, g), M.exclusion_sets(frame(spark, x[:, :2], y, g)), k, alphas=(1.0,), steps=4, top=30, missing=False).collect()
    assert len(models) == 9 * 4
    for m in models:
        train = ~np.isin(g, [m["outer_group"], m["inner_group"]])
        assert set(m["pos"]) <= set(np.argsort(-x[train].var(axis=0))[:30].tolist())
    assert {p for m in models for p in m["pos"]} >= set(range(100, 110))


def test_few_groups_are_tuned_on_dealt_rows(spark):
    x, y, g = cohort(n=60)
    rows = frame(spark, x, y, np.where(g < "C", "A", "B"))
    folds = M.tuning_folds(rows).groupBy("grp").count().collect()
    assert sorted((r["grp"], r["count"]) for r in folds) == [("rows1", 20), ("rows2", 20), ("rows3", 20)]
    kept = frame(spark, x, y, g)
    assert M.tuning_folds(kept) is kept
    run = M.freeze_model(rows, K, alphas=(1.0,), steps=3, missing=False)
    assert run["model"].count() == 1 and {r["inner_folds"] for r in run["tuning"].collect()} == {3}
    assert {r["grp"] for r in run["partitions"].select("grp").distinct().collect()} == {"A", "B"}
    with pytest.raises(ValueError, match="nine rows"):
        M.tuning_folds(rows.limit(8))
    with pytest.raises(ValueError, match="three groups"):
        M.freeze_model(rows, K, rank="within_group")
