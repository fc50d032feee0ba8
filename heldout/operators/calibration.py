"""Level calibration of a transferred score: few labelled rows, shrinkage, group covariates, percentile maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heldout.functions.scalars import finite, offset_stratum
from heldout.operators.fold_fits import fold_isotonic, fold_logistic, interpolate
from heldout.operators.metrics import pairs
from heldout.operators.ranking import group_weights, within_group_percentile
from heldout.operators.resampling import first_rows
from heldout.operators.cohort import logo_prior_join
from heldout.plans.skew import Profile, attach, cumulate, null_safe_join, profile, quantiles, spread
from heldout.plans.storage import materialise


def sum_abs_deviation(
    rows: DataFrame, points: DataFrame, group: str, value: str, at: Sequence[str], bound: int, shape: Profile | None = None
) -> DataFrame:
    """Add ``_all_<c>`` for each column c of ``at``: the sum of |value - c| over all rows of the point's group.

    Rows and points are ordered together once and the running count and sum give the answer at every point, so the
    cost does not grow with rows times points. ``bound`` is the most points one group can have.
    """
    keys = [c for c in points.columns if c not in at and c != group]
    shape = shape or profile(rows, [group])
    cells = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n_all"), F.sum(value).alias("_s_all"))
    long = points.select(group, *keys, F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_x")) for c in at])).alias("_p"))
    both = cells.select(group, F.col(value).alias("_x"), "_n", "_s").unionByName(
        long.select(group, *keys, "_p._x", "_p._c", F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_s")), allowMissingColumns=True
    )
    order = [F.col("_x").asc(), F.col("_c").asc_nulls_first(), *[F.col(k).asc() for k in keys]]
    like = Profile(shape.groups, shape.largest + bound * len(at), shape.rows + shape.groups * bound * len(at))
    placed = cumulate(both, [group], order, ["_n", "_s"], like).filter("_c IS NOT NULL")
    j = attach(placed, totals, [group], shape.groups)
    x, n, s = F.col("_x"), F.col("_n_before"), F.col("_s_before")
    total = x * n - s + (F.col("_s_all") - s) - x * (F.col("_n_all") - n)
    wide = j.groupBy(group, *keys).agg(*[F.max(F.when(F.col("_c") == c, total)).alias(f"_all_{c}") for c in at])
    return null_safe_join(points, wide, [group, *keys])


def labelled_draws(df: DataFrame, ks: Sequence[int], b: int, seed: int, group: str = "grp", unit: str = "id") -> DataFrame:
    """The k labelled rows of every (group, k, replicate): the first k in the replicate's hash order."""
    shots = first_rows(df, b, group, max(ks), ["r", "actual"], seed, unit)
    wide = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("_turn"))
    return shots.select(group, "b", "r", "actual", F.explode(wide).alias("k"))


def fewshot_draws(
    df: DataFrame, ks: Sequence[int], b: int, seed: int = 0, min_eval: int = 10, group: str = "grp", priors: DataFrame | None = None, unit: str = "id"
) -> DataFrame:
    """One row per (group, k, replicate): errors on the rows not drawn, uncorrected and under each correction.

    With ``priors`` (one row per group: mu0, w_<k>...) the shrunk corrections are evaluated as well; see
    ``shrinkage_draws``.
    """
    known = pairs(df, "actual", "pred")
    shape = profile(known, [group])
    # residuals are read by several stages below: keep the narrow table instead of repeating the joins behind it
    rows = materialise(spread(known.select(group, unit, (F.col("pred") - F.col("actual")).alias("r"), "actual"), shape))
    whole = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("offset"), F.avg("actual").alias("mean_actual"), F.sum(F.abs("r")).alias("_abs_r")
    )
    groups = shape.groups
    base = attach(rows, whole, [group], groups)
    flat = base.groupBy(group).agg(
        F.sum(F.abs(F.col("r") - F.col("offset"))).alias("_abs_o"), F.sum(F.abs(F.col("actual") - F.col("mean_actual"))).alias("_abs_m")
    )
    whole = null_safe_join(whole, flat, [group])
    shots = labelled_draws(rows, ks, b, seed, group, unit)
    shots = materialise(attach(shots, whole, [group], groups).filter(F.col("n") - F.col("k") >= min_eval))
    keys = [group, "k", "b"]
    est = shots.groupBy(*keys).agg(F.avg("r").alias("c_raw"), F.avg("actual").alias("y_raw"))
    if priors is not None:
        est = attach(est, priors, [group], groups)
        k = F.col("k")

        def weight(t2, s2):
            return F.coalesce(F.try_divide(F.col(t2), F.col(t2) + F.col(s2) / k), F.lit(0.0))

        est = est.withColumn("w", weight("tau2", "sigma2")).withColumn("w_u", weight("tau2_raw", "sigma2")).withColumn("w_y", weight("tau2_y", "sigma2_y"))
        est = est.select(
            *keys, "c_raw", "y_raw", "w", "w_u", "w_y",
            (F.col("w") * F.col("c_raw") + (1 - F.col("w")) * F.col("mu0")).alias("c_shrunk"),
            (F.col("w_u") * F.col("c_raw") + (1 - F.col("w_u")) * F.col("mu0")).alias("c_shrunk_raw_tau"),
            (F.col("w_y") * F.col("y_raw") + (1 - F.col("w_y")) * F.col("mu0_y")).alias("y_shrunk"),
        )
    est = materialise(est)  # one row per group, k and replicate
    constants = [("r", c) for c in est.columns if c.startswith("c_")] + [("actual", c) for c in est.columns if c.startswith("y_")]
    own = null_safe_join(shots, est, keys).groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("offset").alias("offset"),
        F.max("_abs_r").alias("_abs_r"), F.max("_abs_o").alias("_abs_o"), F.max("_abs_m").alias("_abs_m"),
        F.sum(F.abs("r")).alias("_own_r"), F.sum(F.abs(F.col("r") - F.col("offset"))).alias("_own_o"),
        F.sum(F.abs(F.col("actual") - F.col("mean_actual"))).alias("_own_m"), F.sum("r").alias("_own_sum"),
        *[F.sum(F.abs(F.col(v) - F.col(c))).alias(f"_own_{c}") for v, c in constants],
    )
    out = est
    for value in ("r", "actual"):
        at = [c for v, c in constants if v == value]
        sums = sum_abs_deviation(rows, est.select(*keys, *at), group, value, at, len(ks) * b, shape).drop(*at)
        out = null_safe_join(out, sums, keys)
    j = null_safe_join(out, own, keys)
    left = F.col("n") - F.col("k")
    errors = [((F.col(f"_all_{c}") - F.col(f"_own_{c}")) / left).alias(f"mae_{c}") for _, c in constants]
    extra = ["w", "w_u", "w_y"] if priors is not None else []
    return j.select(
        *keys, "n", left.alias("n_eval"), "offset", *extra,
        ((F.col("_abs_r") - F.col("_own_r")) / left).alias("mae_uncorrected"),
        ((F.col("_abs_o") - F.col("_own_o")) / left).alias("mae_oracle"),
        ((F.col("_abs_m") - F.col("_own_m")) / left).alias("mae_null_oracle"),
        ((F.col("n") * F.col("offset") - F.col("_own_sum")) / left).alias("offset_eval"),
        *errors,
        F.abs(F.col("c_raw") - F.col("offset")).alias("offset_error"),
        *([F.abs(F.col("c_shrunk") - F.col("offset")).alias("offset_error_shrunk")] if priors is not None else []),
    )


def fewshot_offset(df: DataFrame, ks: Sequence[int], b: int, seed: int = 0, min_eval: int = 10, group: str = "grp") -> DataFrame:
    """Mean over replicates per (group, k): MAE uncorrected, few-shot, oracle, and the two label-only nulls."""
    d = fewshot_draws(df, ks, b, seed, min_eval, group)
    return d.groupBy(group, "k").agg(
        F.max("n").alias("n"), F.max("n_eval").alias("n_eval"),
        F.avg("mae_uncorrected").alias("model_uncorrected"), F.avg("mae_c_raw").alias("model_fewshot"),
        F.stddev_samp("mae_c_raw").alias("model_fewshot_sd"), F.avg("mae_oracle").alias("model_oracle"),
        F.avg("mae_y_raw").alias("null_fewshot"), F.avg("mae_null_oracle").alias("null_oracle"),
        F.avg("offset_error").alias("offset_error"), F.stddev_samp("offset_error").alias("offset_error_sd"),
    )


def fewshot_macro(per_group: DataFrame) -> DataFrame:
    """Mean over groups by k, and in how many groups the correction helps or beats the label-only null."""
    cols = ("model_uncorrected", "model_fewshot", "model_oracle", "null_fewshot", "null_oracle", "offset_error", "offset_error_sd")
    return per_group.groupBy("k").agg(
        F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(c) for c in cols],
        F.count_if(F.col("model_fewshot") < F.col("model_uncorrected")).alias("n_helped"),
        F.count_if(F.col("model_fewshot") < F.col("null_fewshot")).alias("n_beats_null"),
    )


def calibration_curve(df: DataFrame, ks: Sequence[int], b: int, seed: int = 0, min_n: int = 20, group: str = "grp") -> DataFrame:
    """MAE against the number of labelled rows used for the intercept; k = 0 is the raw error."""
    rows = pairs(df, "actual", "pred")
    raw = rows.groupBy(group).agg(
        F.lit(0).alias("k"), F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("mae"), F.lit(None).cast("double").alias("mae_sd"),
        F.count(F.lit(1)).alias("n_eval"),
    ).filter(F.col("n_eval") >= min_n)
    shots = fewshot_offset(rows, ks, b, seed, 1, group).filter(F.col("n") >= min_n)
    return raw.unionByName(shots.select(group, "k", F.col("model_fewshot").alias("mae"), F.col("model_fewshot_sd").alias("mae_sd"), "n_eval"))


def shrinkage_priors(df: DataFrame, group: str = "grp") -> DataFrame:
    """Leave-one-group-out prior of the offset and of the label level: mean, within variance, between variance.

    The between variance is reduced by the mean sampling variance and floored at 0.
    """
    rows = pairs(df, "actual", "pred").withColumn("r", F.col("pred") - F.col("actual"))
    stats = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("rbar"), F.var_samp("r").alias("s2"), F.avg("actual").alias("ybar"), F.var_samp("actual").alias("s2y")
    )
    stats = stats.withColumn("sv", F.col("s2") / F.col("n")).withColumn("svy", F.col("s2y") / F.col("n"))
    p = logo_prior_join(stats, ["rbar", "s2", "sv", "ybar", "s2y", "svy"], group)
    return p.select(
        group, "n_others", F.col("rbar_mean").alias("mu0"), F.col("s2_mean").alias("sigma2"), F.col("rbar_var").alias("tau2_raw"),
        F.greatest(F.lit(0.0), F.col("rbar_var") - F.col("sv_mean")).alias("tau2"),
        F.col("ybar_mean").alias("mu0_y"), F.col("s2y_mean").alias("sigma2_y"), F.col("ybar_var").alias("tau2_y_raw"),
        F.greatest(F.lit(0.0), F.col("ybar_var") - F.col("svy_mean")).alias("tau2_y"),
    )


def eb_shrinkage_draws(df: DataFrame, ks: Sequence[int], b: int, seed: int = 0, min_eval: int = 10, group: str = "grp") -> DataFrame:
    """The few-shot draws with empirical-Bayes shrinkage towards the other groups' prior."""
    return fewshot_draws(df, ks, b, seed, min_eval, group, shrinkage_priors(df, group))


#: Errors that differ by less are equal.
TIE = 1e-9


def eb_shrinkage_by_group(draws: DataFrame, group: str = "grp") -> DataFrame:
    """Mean over replicates of the six estimators, offset errors and win shares, with the offset stratum.

    Errors often tie exactly (a mean absolute error is flat between neighbouring rows); a win is a difference beyond rounding, ``TIE``.
    """
    less = lambda a, c: F.avg((F.col(a) < F.col(c) - TIE).cast("double"))
    return draws.groupBy(group, "k").agg(
        F.max("n").alias("n"), F.max("w").alias("w"), F.max("w_u").alias("w_raw_tau"), F.max("w_y").alias("w_y"), F.max("offset").alias("offset"),
        F.avg("offset_eval").alias("offset_eval"),
        F.avg("mae_uncorrected").alias("m1"), F.avg("mae_c_raw").alias("m2"), F.avg("mae_c_shrunk").alias("m3"),
        F.avg("mae_c_shrunk_raw_tau").alias("m3_raw_tau"), F.avg("mae_oracle").alias("m4"), F.avg("mae_y_raw").alias("m5"), F.avg("mae_y_shrunk").alias("m6"),
        F.avg("offset_error").alias("err_unshrunk"), F.avg("offset_error_shrunk").alias("err_shrunk"),
        less("mae_c_shrunk", "mae_uncorrected").alias("share_m3_lt_m1"), less("mae_c_shrunk", "mae_c_raw").alias("share_m3_lt_m2"),
        less("mae_c_shrunk", "mae_y_raw").alias("share_m3_lt_m5"), less("mae_c_shrunk", "mae_y_shrunk").alias("share_m3_lt_m6"),
    ).withColumn("offset_stratum", offset_stratum("offset"))


def eb_shrinkage_macro(by_group: DataFrame, keys: Sequence[str] = ("k",)) -> DataFrame:
    """Equal weight per group: mean of each estimator, groups helped and the share of the oracle's gain recovered."""
    m = ("m1", "m2", "m3", "m3_raw_tau", "m4", "m5", "m6")
    return by_group.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(c) for c in m], F.avg("w").alias("mean_w"),
        F.avg("err_shrunk").alias("err_shrunk"), F.avg("err_unshrunk").alias("err_unshrunk"),
        F.count_if(F.col("m3") < F.col("m1")).alias("n_helped"), F.count_if(F.col("m2") < F.col("m1")).alias("n_helped_unshrunk"),
        F.count_if(F.col("m3") < F.col("m5")).alias("n_beats_flat_null"), F.count_if(F.col("m3") < F.col("m6")).alias("n_beats_shrunk_null"),
        F.try_divide(F.avg("m1") - F.avg("m3"), F.avg("m1") - F.avg("m4")).alias("oracle_gain"),
        F.try_divide(F.avg("m1") - F.avg("m2"), F.avg("m1") - F.avg("m4")).alias("oracle_gain_unshrunk"),
    )


# Quantiles reported for the distribution over draws.
DRAW_QUANTILES = {"q05": 0.05, "q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90, "q95": 0.95}


def eb_draw_distribution(draws: DataFrame, group: str = "grp") -> DataFrame:
    """Quantiles over replicates of the gain against no correction and against the unshrunk one, per group and pooled."""
    deltas = F.array(
        F.struct(F.lit("m1_minus_m3").alias("delta"), (F.col("mae_uncorrected") - F.col("mae_c_shrunk")).alias("v")),
        F.struct(F.lit("m2_minus_m3").alias("delta"), (F.col("mae_c_raw") - F.col("mae_c_shrunk")).alias("v")),
    )
    scoped = draws.select(F.explode(F.array(F.col(group), F.lit("ALL"))).alias(group), "k", F.explode(deltas).alias("_d"))
    rows = scoped.select(group, "k", "_d.delta", "_d.v")
    counts = rows.groupBy(group, "k", "delta").agg(F.count(F.lit(1)).alias("n_draws"))
    return null_safe_join(counts, quantiles(rows, [group, "k", "delta"], "v", DRAW_QUANTILES), [group, "k", "delta"])


# --- offsets from label-free group covariates -------------------------------------------------------------


def _f_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution by numerical integration of the beta density."""
    if not np.isfinite(f) or f <= 0:
        return 1.0
    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)
    # substitute t = x*u^(1/a) to take out the endpoint singularity at 0
    u = (np.arange(20000) + 0.5) / 20000
    t = x * u ** (1 / a)
    body = np.mean((1 - t) ** (b - 1)) * x**a / a
    return float(min(1.0, body * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))))


def _design(xs: Sequence[str]) -> Column:
    return F.array(F.lit(1.0), *[F.col(x).cast("double") for x in xs])


def ols_nested(groups: DataFrame, y: str, models: Sequence[Sequence[str]]) -> DataFrame:
    """R2, adjusted R2 and F test against the first model for a few least-squares models over the groups.

    Spark sums the normal equations; only those few numbers per model are solved in the task.
    """
    known = groups.withColumn("_y", F.col(y).cast("double"))
    parts = None
    for i, xs in enumerate(models):
        p = len(xs) + 1
        d = known.withColumn("_d", _design(xs))
        sums = d.agg(
            F.count("_y").alias("n"),
            F.array(*[F.sum(F.get("_d", F.lit(a)) * F.get("_d", F.lit(c))) for a in range(p) for c in range(p)]).alias("a"),
            F.array(*[F.sum(F.get("_d", F.lit(a)) * F.col("_y")) for a in range(p)]).alias("b"),
            F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.sum("_y").alias("sy"),
        ).select(F.lit(i).alias("model"), F.lit(f"{y} ~ {' + '.join(xs)}").alias("formula"), "*")
        parts = sums if parts is None else parts.unionByName(sums)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.sort_values("model").itertuples():
            p = len(r.b)
            beta = np.linalg.lstsq(np.asarray(r.a).reshape(p, p), np.asarray(r.b), rcond=None)[0]
            sst, sse = r.yy - r.sy**2 / r.n, max(r.yy - float(beta @ np.asarray(r.b)), 0.0)
            out.append([r.formula, r.n, p, 1 - sse / sst, 1 - (sse / (r.n - p)) / (sst / (r.n - 1)), sse, None])
        for row in out[1:]:
            d1, d2 = row[2] - out[0][2], row[1] - row[2]
            row[6] = _f_tail((out[0][5] - row[5]) / d1 / (row[5] / d2), d1, d2) if row[5] > 0 else 0.0
        return pd.DataFrame([r[:5] + r[6:] for r in out], columns=["formula", "n", "df", "r2", "adj_r2", "p_vs_first"])

    fits = parts.groupBy(F.lit(1).alias("_one")).applyInPandas(solve, "formula string, n long, df int, r2 double, adj_r2 double, p_vs_first double")
    return fits.withColumn("p_vs_first", finite("p_vs_first"))


def group_offset_calibrator(groups: DataFrame, covariates: Sequence[str], offset: str = "offset", group: str = "grp") -> DataFrame:
    """Predict each group's offset from label-free covariates by a line fitted on all other groups.

    The normal equations of the other groups are the total less the own terms. An unsolvable fit gives shift 0.
    Covariates are centred first, which changes no prediction.
    """
    p = len(covariates) + 1
    centred = groups.withColumn("_one", F.lit(1)).join(
        F.broadcast(groups.agg(*[F.avg(c).alias(f"_c_{c}") for c in covariates]).withColumn("_one", F.lit(1))), "_one"
    )
    d = centred.select(
        F.col(group), F.col(offset).alias("_y"),
        F.array(F.lit(1.0), *[F.col(c) - F.col(f"_c_{c}") for c in covariates]).alias("_d"),
    )
    cells = [F.get("_d", F.lit(i)) * F.get("_d", F.lit(j)) for i in range(p) for j in range(p)]
    moments = [F.get("_d", F.lit(i)) * F.col("_y") for i in range(p)]
    total = d.agg(
        F.array(*[F.sum(c) for c in cells]).alias("_A"), F.array(*[F.sum(m) for m in moments]).alias("_B"),
        F.sum("_y").alias("_y_all"), F.count("_y").alias("_n_all"),
    ).withColumn("_one", F.lit(1))
    j = d.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    rest = j.select(
        group, "_y", "_d",
        F.zip_with("_A", F.array(*cells), lambda t, o: t - o).alias("a"),
        F.zip_with("_B", F.array(*moments), lambda t, o: t - o).alias("b"),
        (F.col("_y_all") / F.col("_n_all")).alias("_naive"),
    )

    def solve(batches):
        for pdf in batches:
            pred = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.a).reshape(p, p), np.asarray(r.b)
                ok = np.linalg.matrix_rank(a) == p
                pred.append(float(np.asarray(r[2]) @ np.linalg.solve(a, b)) if ok else 0.0)
            yield pd.DataFrame({group: pdf[group], "offset": pdf["_y"], "predicted": pred, "naive": pdf["_naive"]})

    return rest.mapInPandas(solve, f"{group} string, offset double, predicted double, naive double")


def group_offset_summary(loto: DataFrame) -> DataFrame:
    """Leave-one-group-out MAE and R2 of the predicted offsets against always using the mean offset."""
    err = F.col("offset") - F.col("predicted")
    return loto.agg(
        F.count(F.lit(1)).alias("groups"), F.avg(F.abs(err)).alias("loto_mae"), F.avg(F.abs(F.col("offset") - F.col("naive"))).alias("naive_mae"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop("offset") * F.count(F.lit(1)))).alias("loto_r2"),
    )


# --- percentile maps --------------------------------------------------------------------------------------


def _clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def percentile_rows(df: DataFrame, group: str = "grp") -> DataFrame:
    """Rows with the true within-group percentile and equal-group weights."""
    return group_weights(within_group_percentile(pairs(df, "actual", "pred"), [group], "actual", "q_true"), group=group)


def percentile_map_linear(df: DataFrame, group: str = "grp") -> DataFrame:
    """Percentile predicted from the score by a weighted line fitted on the other groups.

    With equal weight per group the weighted sums are sums of group means, so each fit is a total less one group.
    """
    rows = percentile_rows(df, group)
    x, q = F.col("pred"), F.col("q_true")
    means = rows.groupBy(group).agg(F.avg(x).alias("x"), F.avg(q).alias("q"), F.avg(x * x).alias("xx"), F.avg(x * q).alias("xq"))
    total = means.agg(F.count(F.lit(1)).alias("_g"), *[F.sum(c).alias(f"_{c}") for c in ("x", "q", "xx", "xq")]).withColumn("_one", F.lit(1))
    j = means.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    m = F.col("_g") - 1
    e = {c: (F.col(f"_{c}") - F.col(c)) / m for c in ("x", "q", "xx", "xq")}
    slope = F.try_divide(e["xq"] - e["x"] * e["q"], e["xx"] - e["x"] * e["x"])
    lines = j.select(group, slope.alias("slope"), (e["q"] - slope * e["x"]).alias("intercept"))
    out = attach(rows, lines, [group], profile(rows, [group]).groups)
    return out.select(*df.columns, "q_true", "slope", "intercept", _clip01(F.col("intercept") + F.col("slope") * x).alias("q_hat"))


def percentile_map_isotonic(df: DataFrame, group: str = "grp") -> DataFrame:
    """The same with a monotone map: the weighted isotonic fits of all left-out groups from one pooling of the cells."""
    rows = materialise(percentile_rows(df, group))
    knots = fold_isotonic(rows, "pred", "q_true", "weight", group)
    return interpolate(rows, knots, "pred", "_q", group).select(*df.columns, "q_true", _clip01(F.col("_q")).alias("q_hat"))


def percentile_map_logistic(df: DataFrame, top: float = 0.75, group: str = "grp") -> DataFrame:
    """Probability of the top quartile from weighted logistic fits on the other groups, all fitted together."""
    rows = materialise(percentile_rows(df, group)).withColumn("event", (F.col("q_true") > top).cast("double"))
    fits = fold_logistic(rows, ["pred"], "event", "weight", group)
    lines = [(fold, float(b[0]), float(b[1])) for fold, b in fits.items() if fold is not None]
    table = df.sparkSession.createDataFrame(lines, f"{group} string, _a double, _b double")
    out = attach(rows, table, [group], len(lines))
    return out.select(*df.columns, "q_true", "event", (1 / (1 + F.exp(-(F.col("_a") + F.col("_b") * F.col("pred"))))).alias("p_hat"))
