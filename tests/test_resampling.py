"""Bootstraps by multiplicities, permutations by arrays, and fits of all folds at once, against plain NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from heldout.functions.scalars import DRAW_RANGE, mixed, mixed_array
from heldout.operators import calibration as K
from heldout.operators import fold_fits as FF
from heldout.operators import model as M
from heldout.operators import resampling as R
from heldout.plans import skew


def preds(n=90, groups="ABC", seed=0):
    rng = np.random.default_rng(seed)
    y = np.round(rng.normal(size=n), 1)
    return pd.DataFrame({"id": np.arange(n), "grp": [groups[k % len(groups)] for k in range(n)], "actual": y, "pred": np.round(y + rng.normal(size=n), 1)})


def test_both_forms_of_the_hash(spark):
    x = np.concatenate([np.arange(2000), np.random.default_rng(0).integers(0, 1 << 32, 2000), [DRAW_RANGE - 1, DRAW_RANGE, DRAW_RANGE + 1, (1 << 32) - 1]])
    df = spark.createDataFrame([(int(v),) for v in x], "x long").withColumn("h", mixed("x"))
    assert [r["h"] for r in df.collect()] == mixed_array(x.astype(np.int64)).tolist()
    # Draws of one stratum are uniform and those of neighbouring replicates unrelated.
    w = np.concatenate([R.multiplicities(77, 0, 50, np.full(200, 50), range(k, k + 200)) for k in range(1, 2001, 200)])
    assert w.sum(axis=1).tolist() == [50] * 2000
    assert abs(w.var() - 0.98) < 0.03 and np.abs(w.mean(axis=0) - 1).max() < 0.12
    assert np.abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.02


def test_slice_tree():
    sizes = [40, 40, 7]
    whole = R.slice_draws(5, sizes, range(1, 2001))
    assert (whole.sum(axis=1) == 87).all()
    assert np.allclose(whole.mean(axis=0), sizes, atol=0.5) and np.allclose(whole.var(axis=0), [s * (1 - s / 87) for s in sizes], rtol=0.15)
    # A task that has later replicates finds the same numbers.
    assert (R.slice_draws(5, sizes, range(257, 700)) == whole[256:699]).all()
    assert (R.slice_draws(6, sizes, range(1, 2001)) != whole).any()


def copies(pdf, b, strata, seed, monkey_slice):
    """Multiplicity of every row per replicate, from the definition."""
    import hashlib

    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    w = np.zeros((b, len(pdf)), int)
    groups = pdf.groupby(strata).indices if strata else {"all": np.arange(len(pdf))}
    for name, rows in groups.items():
        key = int(md5(f"{seed}s:{name}")[:8], 16) % DRAW_RANGE
        order = sorted(rows, key=lambda r: (md5(f"{seed}:{pdf.id[r]}"), pdf.id[r]))
        sizes = [min(monkey_slice, len(rows) - k) for k in range(0, len(rows), monkey_slice)]
        draws = R.slice_draws(key, sizes, range(1, b + 1))
        for rep in range(b):
            for part, size in enumerate(sizes):
                start = int(mixed_array(np.array([key + part + rep + 1]))[0])
                for turn in range(draws[rep, part]):
                    w[rep, order[part * monkey_slice + (int(mixed_array(np.array([start + turn]))[0]) * size >> 31)]] += 1
    return w


@pytest.mark.parametrize("size", [1 << 16, 8])
def test_resampled_sums(spark, monkeypatch, size):
    monkeypatch.setattr(R, "SLICE", size)
    monkeypatch.setattr(R, "BLOCK", 4)
    pdf = preds()
    df = spark.createDataFrame(pdf)
    w = copies(pdf, 10, "grp", 3, size)
    found = R.resampled_sums(df, 10, ["grp"], {"n": F.lit(1.0), "s": F.col("actual")}, 3).toPandas()
    assert len(found) == 30
    for r in found.itertuples():
        own = (pdf.grp == r.grp).to_numpy()
        assert r.n == own.sum() and r.s == pytest.approx((w[r.b - 1] * pdf.actual * own).sum())
    rows = R.drawn(df, 10, ["grp"], ["actual"], 3).groupBy("b", "grp").agg(F.sum(F.col("w") * F.col("actual")).alias("s"), F.sum("w").alias("n")).toPandas()
    both = found.merge(rows, on=["b", "grp"])
    assert len(both) == 30 and np.allclose(both.s_x, both.s_y) and (both.n_x == both.n_y).all()


@pytest.mark.parametrize("size", [1 << 16, 8])
def test_bootstraps_are_the_same_at_every_size(spark, monkeypatch, size):
    monkeypatch.setattr(R, "SLICE", size)
    df = spark.createDataFrame(preds())
    makes = [
        lambda: R.bootstrap_pairs_ci(df, 40, ["grp"], 3), lambda: R.bootstrap_auc_by_class(df, "pred", F.col("actual") > 0.3, 40, 3),
        lambda: R.bootstrap_stratified(df, df.withColumn("pred", F.col("pred") / 2), 40, 3), lambda: R.bootstrap_cluster(df, ["actual", "pred"], 40, 3),
        lambda: R.permutation_test_mae(df, 40, 3), lambda: R.permutation_test_spearman(df, 40, 3), lambda: K.fewshot_offset(df, (3, 7), 20, 3),
    ]
    below = [m().toPandas() for m in makes]
    spark.conf.set(skew.HOT_ROWS, "20")
    try:
        above = [m().toPandas() for m in makes]
    finally:
        spark.conf.unset(skew.HOT_ROWS)
    for a, b in zip(below, above):
        by = [c for c in ("grp", "k") if c in a.columns]
        a, b = (x.sort_values(by).reset_index(drop=True) if by else x for x in (a, b))
        pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False, rtol=1e-9)


def test_bootstrap_statistics(spark):
    pdf = preds(60)
    w = copies(pdf, 30, "grp", 3, 1 << 16)
    stats = []
    for rep in w:
        g = (pdf.grp == "A").to_numpy()
        d = pdf[g].loc[np.repeat(pdf.index[g], rep[g])]
        stats.append((np.corrcoef(d.actual, d.pred)[0, 1], d[["actual", "pred"]].rank().corr().iloc[0, 1]))
    lo = np.quantile(np.array(stats), 0.025, axis=0)
    r = {x["grp"]: x for x in R.bootstrap_pairs_ci(spark.createDataFrame(pdf), 30, ["grp"], 3).collect()}["A"]
    assert (r["pearson_lo"], r["spearman_lo"], r["n_ok"]) == (pytest.approx(lo[0]), pytest.approx(lo[1]), 30)


def test_bootstrap_of_awkward_groups(spark):
    rows = [(k, "flat", 1.0, float(k)) for k in range(8)] + [(100 + k, "small", float(k), 1.0) for k in range(3)] + [(200 + k, None, float(k % 3), float(k)) for k in range(9)]
    df = spark.createDataFrame([*rows, (300, "flat", None, 1.0)], "id long, grp string, actual double, pred double")
    got = {r["grp"]: r for r in R.bootstrap_pairs_ci(df, 20, ["grp"], 1).collect()}
    assert set(got) == {"flat", None} and got["flat"]["n_ok"] == 0 and got["flat"]["pearson_lo"] is None and got[None]["n_ok"] > 15
    assert R.bootstrap_pairs_ci(df.filter("id < 0"), 20, ["grp"], 1).count() == 0
    assert R.bootstrap_auc_by_class(df, "pred", F.col("actual") > 99, 20, 1).first()["n_ok"] == 0


def test_ranges_of_a_group_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 16)
    rng = np.random.default_rng(2)
    rows = [(k, "flat", 1.0, float(k)) for k in range(45)] + [(100 + k, None, float(k % 3), float(k % 2)) for k in range(50)]
    rows += [(200 + k, "tie", float(rng.normal()), float(k < 3)) for k in range(60)] + [(300 + k, "small", float(k), float(-k % 5)) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, grp string, actual double, pred double")
    makes = [lambda: R.bootstrap_pairs_ci(df, 30, ["grp"], 3), lambda: R.bootstrap_pairs_ci(df, 30, [], 3)]
    below = [{r["grp"] if "grp" in r else "all": r for r in m().collect()} for m in makes]
    spark.conf.set(skew.HOT_ROWS, "20")
    # Draws as rows would be rows times replicates in a shuffle.
    monkeypatch.setattr(R, "drawn", None)
    try:
        above = [{r["grp"] if "grp" in r else "all": r for r in m().collect()} for m in makes]
    finally:
        spark.conf.unset(skew.HOT_ROWS)
    assert set(above[0]) == {"flat", None, "tie", "small"} and above[0]["flat"]["n_ok"] == 0 and above[0]["flat"]["spearman_hi"] is None
    for a, b in zip(below, above):
        assert set(a) == set(b)
        for g in a:
            assert list(a[g]) == [pytest.approx(x, rel=1e-9, abs=1e-12) if isinstance(x, float) else x for x in b[g]]


@pytest.mark.parametrize("kind", ["distinct", "tied", "one_tie", "flat"])
def test_replicates_that_share_words(monkeypatch, kind):
    monkeypatch.setattr(R, "WORDS_AT_ONCE", 64)
    rng = np.random.default_rng(1)
    n = 333
    y = {"distinct": rng.normal(size=n), "tied": np.round(rng.normal(size=n), 1), "one_tie": (np.arange(n) < 12) * 1.0, "flat": np.zeros(n)}[kind]
    p = np.round(y + rng.normal(size=n), 1)
    w = np.stack([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(11)]).astype(np.uint8)
    w[3] = 0
    w[3, :2] = 200, n - 200  # rows drawn far more often than any other
    got = R._Words(*_cells_of(y, p)).spearman(w[:8])
    got = np.r_[got, R._Words(*_cells_of(y, p)).spearman(w[8:])]
    ranks = [pd.DataFrame({"y": np.repeat(y, k), "p": np.repeat(p, k)}).rank() for k in w]
    want = np.array([r.corr().iloc[0, 1] if r.y.std() > 0 and r.p.std() > 0 else np.nan for r in ranks])
    assert np.allclose(got, want, rtol=1e-10, atol=1e-12, equal_nan=True)
    # Bytes and whole numbers give the same statistics.
    for a, b in zip(R._pair_statistic({"y": y, "p": p})(w), R._pair_statistic({"y": y, "p": p})(w.astype(np.int32))):
        assert np.allclose(a, b, rtol=1e-10, atol=1e-12, equal_nan=True)


def _cells_of(y, p):
    by_y, by_p = R._Cells(y), R._Cells(p)
    cell = np.empty(len(y), np.int64)
    cell[by_y.order] = by_y.of_ordered
    return by_y, by_p, cell[by_p.order]


def test_permutation_sums(spark):
    pdf = preds(30)
    got = R.permuted_sums(spark.createDataFrame(pdf), 6, "grp", "actual", "pred", [("same", lambda v, o: v), ("xy", lambda v, o: v * o)], 3).toPandas()
    assert len(got) == 6 and np.allclose(got["same"], pdf.actual.sum()) and got["xy"].nunique() == 6


# --- fits of all folds ------------------------------------------------------------------------------------


def test_fold_logistic(spark):
    rng = np.random.default_rng(1)
    n = 400
    x, g = rng.normal(size=(n, 2)) * [1, 50] + [0, 300], np.array(list("ABCD"))[rng.integers(0, 4, n)]
    e, w = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(float), rng.random(n) + 0.2
    df = spark.createDataFrame([(str(a), float(b), float(c), float(d), float(f)) for a, (b, c), d, f in zip(g, x, e, w)], "grp string, u double, v double, e double, w double")
    fits = FF.fold_logistic(df, ["u", "v"], "e", "w")
    assert set(fits) == {*"ABCD", None}
    for fold, b in fits.items():
        own = np.ones(n, bool) if fold is None else g != fold
        mu = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
        d = np.column_stack([np.ones(n), x])
        assert np.abs(((w * (e - mu))[own, None] * d[own]).sum(0) / (1, 1, 300)).max() < 1e-6
    lr = LogisticRegression(weightCol="w", labelCol="e", regParam=0.0, tol=1e-12, maxIter=200)
    model = lr.fit(df.filter("grp <> 'B'").select(array_to_vector(F.array("u", "v")).alias("features"), "e", "w"))
    assert np.allclose(fits["B"], [model.intercept, *model.coefficients], atol=1e-4)
    separated = FF.fold_logistic(df.withColumn("e", (F.col("u") > 0).cast("double")), ["u"], "e", "w", passes=8)
    assert all(np.isfinite(b).all() and b[1] > 5 for b in separated.values())


def isotonic(x, y, w):
    """Min-max formula over the distinct x with weight."""
    t = pd.DataFrame({"x": x, "s": y * w, "w": w})[np.asarray(w) > 0].groupby("x").sum()
    v, ww = (t.s / t.w).to_numpy(), t.w.to_numpy()
    mean = lambda a, b: np.average(v[a : b + 1], weights=ww[a : b + 1])
    n = len(v)
    return t.index.to_numpy(), np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


@pytest.mark.parametrize("merged", [16, 2])
def test_fold_isotonic(spark, monkeypatch, merged):
    monkeypatch.setattr(FF, "MERGED", merged)
    monkeypatch.setattr(FF, "SLICE_CELLS", 20)
    rng = np.random.default_rng(4)
    n = 200
    x, g = np.round(rng.random(n) * 3, 1), np.array(list("ABC"))[rng.integers(0, 3, n)]
    y, w = x + rng.normal(size=n), np.where(rng.random(n) < 0.1, 0.0, rng.random(n))
    x[g == "C"] += 10  # slices without rows of a fold's group
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "grp": g, "x": x, "y": y, "w": w})).repartition(5)
    knots = FF.fold_isotonic(df, "x", "y", "w").toPandas()
    for fold in ("A", "B", "C", None):
        own = np.ones(n, bool) if fold is None else g != fold
        at, fit = isotonic(x[own], y[own], w[own])
        k = knots[knots.fold.isna() if fold is None else knots.fold == fold].sort_values(["x", "y"])
        assert np.allclose(np.interp(at, k.x, k.y), fit)
    placed = FF.interpolate(df, FF.fold_isotonic(df, "x", "y", "w"), "x", "fit", "grp").toPandas()
    for fold, rows in placed.groupby("grp"):
        at, fit = isotonic(x[g != fold], y[g != fold], w[g != fold])
        assert np.allclose(rows.fit, np.interp(rows.x, at, fit))


def test_interpolate_of_awkward_rows(spark, hot):
    knots = spark.createDataFrame([("A", 0.0, 1.0), ("A", 2.0, 3.0), ("B", 5.0, 7.0)], "fold string, x double, y double")
    rows = spark.createDataFrame([("A", None), ("A", -1.0), ("A", 0.0), ("A", 1.0), ("A", 2.0), ("A", 9.0), ("B", 1.0), ("B", 8.0), ("C", 1.0), ("A", 1.0)] * 5, "grp string, v double")
    got = sorted(FF.interpolate(rows, knots, "v", "out", "grp").collect(), key=str)
    want = {("A", None): None, ("A", -1.0): 1.0, ("A", 0.0): 1.0, ("A", 1.0): 2.0, ("A", 2.0): 3.0, ("A", 9.0): 3.0, ("B", 1.0): 7.0, ("B", 8.0): 7.0, ("C", 1.0): None}
    assert len(got) == 50 and all(r["out"] == want[r["grp"], r["v"]] for r in got)


def test_pair_fits_are_optimal(spark):
    rng = np.random.default_rng(3)
    n, k = 120, 5
    g = np.array(list("ABC"))[np.arange(n) % 3]
    x = rng.normal(size=(n, k))
    y = x @ [2, -1, 0, 0, 0.5] + rng.normal(size=n) * 2 + 20 * (g == "B")
    rows = spark.createDataFrame([(i, str(a), float(b), v.tolist()) for i, (a, b, v) in enumerate(zip(g, y, x))], "id long, grp string, y double, x array<double>")
    fit = M.pairwise_rank_fit(rows, 3, alphas=(0.1, 1.0), steps=4, seed=5)
    tuning = fit["tuning"].toPandas()
    assert len(tuning) == 8 and tuning.macro_pair_error.min() == pytest.approx(tuning.loc[(tuning.alpha == fit["alpha"]) & (tuning["lambda"] == fit["lambda"]), "macro_pair_error"].iloc[0])
    pairs = M.pair_differences(rows, fit["pairs"]).toPandas()
    d, o, pg = np.array(pairs.x.tolist()), pairs.outcome.to_numpy(), pairs.grp.to_numpy()
    folds = ["A", "B", "C", None]
    scales = FF.fold_scales(rows, folds)
    assert np.allclose(scales[1], x[g != "B"].std(axis=0, ddof=1)) and np.allclose(scales[3], x.std(axis=0, ddof=1))
    fits = FF.PairFits(M.pair_differences(rows, fit["pairs"]), folds, scales)
    fold, lam, alpha = np.repeat(np.arange(4), 2), np.tile([0.05, 0.002], 4), 0.5
    b = fits.solve(fold, lam * alpha, lam * (1 - alpha))
    for m in range(8):
        own = pg != folds[fold[m]] if folds[fold[m]] else np.ones(len(pg), bool)
        w = np.array([1 / (pg == h).sum() for h in pg]) * own
        w /= w.sum()
        ds = d / scales[fold[m]]
        grad = ((w * (1 / (1 + np.exp(-ds @ b[m])) - o))[:, None] * ds).sum(0) + lam[m] * (1 - alpha) * b[m]
        on = b[m] != 0
        assert np.allclose(grad[on], -lam[m] * alpha * np.sign(b[m][on]), atol=2e-6) and (np.abs(grad[~on]) <= lam[m] * alpha + 2e-6).all()
    errors = fits.pair_errors(b, fold)
    for m in range(6):
        own = pg == folds[fold[m]]
        assert errors[m] == pytest.approx(np.mean(((d[own] / scales[fold[m]]) @ b[m] > 0) != (o[own] == 1)))
    assert np.isnan(errors[6:]).all()
    # The library's fit of one fold.
    frame = M.pair_differences(rows, fit["pairs"]).filter("grp <> 'A'")
    sizes = frame.groupBy("grp").agg((1 / F.count(F.lit(1))).alias("w"))
    lr = LogisticRegression(labelCol="outcome", weightCol="w", fitIntercept=False, standardization=False, elasticNetParam=0.5, regParam=0.05, tol=1e-12, maxIter=500)
    model = lr.fit(frame.join(sizes, "grp").select(array_to_vector("x").alias("features"), "outcome", "w"))
    plain = FF.PairFits(M.pair_differences(rows, fit["pairs"]), folds, np.ones((4, k)))
    assert np.allclose(plain.solve(np.array([0]), np.array([0.025]), np.array([0.025]))[0], model.coefficients.toArray(), atol=1e-4)
    scored = M.pairwise_predict(fit["model"], rows, fit["knots"]).toPandas()
    assert scored.percentile.between(0, 1).all() and np.allclose(scored.sort_values("id").relative_score, x @ fit["model"])
