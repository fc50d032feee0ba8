"""Evaluation metrics over a predictions table (group, actual, pred).

Rows whose actual or prediction is NULL take no part. Groups that are too small or constant keep their row and
get NULL statistics. Everything that is a function of sums is one map-side combined aggregation; rank
statistics go through ``plans.skew``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.functions.scalars import clip_floor, safe_corr, safe_slope
from heldout.operators.resampling import bootstrap_pairs_ci
from heldout.plans.storage import materialise
from heldout.plans.skew import Profile, attach, group_attach, midranks, min_rank, null_safe_join, profile, quantiles, value_cells

POOLED = "POOLED"
MACRO = "MACRO"


def pairs(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where all of ``cols`` are known."""
    return df.dropna(subset=list(cols))


def _error(actual: str = "actual", pred: str = "pred") -> Column:
    return F.col(pred) - F.col(actual)


def _agg(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, out: str, least: int = 3) -> DataFrame:
    """Spearman correlation per key (NULL below ``least`` rows or without variation)."""
    known = pairs(df, a, b).select(*keys, a, b)
    ranked = midranks(known, keys, {"_ra": a, "_rb": b})
    rho = F.when(F.count(F.lit(1)) >= least, safe_corr("_ra", "_rb"))
    return _agg(ranked, keys, [rho.alias(out)])


def metric_columns(actual: str = "actual", pred: str = "pred") -> list[Column]:
    """The sum-based part of the metric panel as aggregate columns."""
    err, n = _error(actual, pred), F.count(F.lit(1))
    variable = (n > 2) & (F.stddev_samp(actual) > 0) & (F.stddev_samp(pred) > 0)
    slope = safe_slope(actual, pred)
    sst = F.var_pop(actual) * n
    return [
        n.alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when((n > 1) & (sst > 0), 1 - F.try_divide(F.sum(err * err), sst)).alias("r2"),
        F.when(variable, safe_corr(actual, pred)).alias("pearson"),
        F.when(variable, F.avg(actual) - slope * F.avg(pred)).alias("calibration_intercept"),
        F.when(variable, slope).alias("calibration_slope"),
        F.avg(err).alias("bias"),
    ]


def metrics_panel(df: DataFrame, keys: Sequence[str] = ("grp",), actual: str = "actual", pred: str = "pred") -> DataFrame:
    """n, MAE, RMSE, R2 against the own mean, Pearson, Spearman, calibration line and bias per key.

    Ranks and sums come from one pass over the ranked rows.
    """
    known = pairs(df, actual, pred).select(*keys, actual, pred)
    ranked = midranks(known, keys, {"_ra": actual, "_rp": pred})
    rho = F.when(F.count(F.lit(1)) > 2, safe_corr("_ra", "_rp")).alias("spearman")
    return _agg(ranked, keys, [*metric_columns(actual, pred), rho])


def group_mean_null(df: DataFrame, group: str = "grp", actual: str = "actual", out: str = "null_pred") -> DataFrame:
    """Attach each row's own group mean of the label: the oracle comparator."""
    return group_attach(df, [group], [F.avg(actual).alias(out)])


def null_panel(
    df: DataFrame, keys: Sequence[str] = (), group: str = "grp", training_mean: Column | None = None
) -> DataFrame:
    """Model MAE against the group-mean null and the training-mean null; skill = 1 - ratio, NULL if no error to beat."""
    rows = group_mean_null(pairs(df, "actual", "pred"), group)
    train = training_mean if training_mean is not None else F.lit(None).cast("double")
    panel = _agg(
        rows,
        keys,
        [
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(_error())).alias("mae_model"),
            F.avg(F.abs(F.col("actual") - F.col("null_pred"))).alias("mae_group_null"),
            F.avg(F.abs(F.col("actual") - train)).alias("mae_train_null"),
        ],
    )

    def skill(null):
        return F.when(F.col(null) > 0, 1 - F.try_divide(F.col("mae_model"), F.col(null)))

    return panel.withColumn("skill_group", skill("mae_group_null")).withColumn("skill_train", skill("mae_train_null"))


def centred(df: DataFrame, group: str = "grp", cols: Sequence[str] = ("actual", "pred")) -> DataFrame:
    """Subtract the group mean from each of ``cols`` (added as ``<c>_c``)."""
    rows = group_attach(df, [group], [F.avg(c).alias(f"_m_{c}") for c in cols], profile(df, [group]))
    return rows.select(*df.columns, *[(F.col(c) - F.col(f"_m_{c}")).alias(f"{c}_c") for c in cols])


def within_group_metrics(df: DataFrame, keys: Sequence[str] = (), group: str = "grp") -> DataFrame:
    """Agreement after removing group means from both sides: Pearson, Spearman, MAE; NULL for n < 3."""
    known = pairs(df, "actual", "pred")
    ranked = midranks(centred(known, group), keys, {"_ra": "actual_c", "_rp": "pred_c"}, profile(known, keys))
    n = F.count(F.lit(1))
    return _agg(
        ranked,
        keys,
        [
            n.alias("n"),
            F.when(n >= 3, safe_corr("actual_c", "pred_c")).alias("within_pearson"),
            F.when(n >= 3, safe_corr("_ra", "_rp")).alias("within_spearman"),
            F.when(n >= 3, F.avg(F.abs(F.col("actual_c") - F.col("pred_c")))).alias("within_mae"),
        ],
    )


def group_identity_r2(df: DataFrame, values: Sequence[str], group: str = "grp", keys: Sequence[str] = ()) -> DataFrame:
    """Share of each value's variance that group identity explains: 1 - SSW/SST, one row per value.

    Two-level sums, centred per group, so no row is touched twice.
    """
    long = df.select(*keys, group, F.explode(F.array(*[
        F.struct(F.lit(v).alias("quantity"), F.col(v).cast("double").alias("value")) for v in values
    ])).alias("_q")).select(*keys, group, "_q.quantity", "_q.value").filter("value IS NOT NULL")
    by_group = long.groupBy(*keys, "quantity", group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count(F.lit(1))).alias("ssw")
    )
    n, ssw = F.sum("n"), F.sum("ssw")
    mean = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean
    usable = (n >= 3) & (F.count(F.lit(1)) >= 2) & (ssw + between > 0)
    return by_group.groupBy(*keys, "quantity").agg(
        n.alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.when(usable, F.try_divide(between, ssw + between)).alias("group_r2"),
    )


def confound_legs(df: DataFrame, group: str = "grp", covariate: str = "covariate") -> DataFrame:
    """Spearman of prediction and label with a covariate, macro over groups and pooled."""
    known = pairs(df, "actual", "pred", covariate)
    legs = None
    for name, c in (("pred", "pred"), ("label", "actual")):
        macro = spearman(known, [group], c, covariate, "rho").agg(F.avg("rho").alias(f"{name}_within"))
        pooled = spearman(known, [], c, covariate, f"{name}_pooled")
        for part in (macro, pooled):
            part = part.withColumn("_one", F.lit(1))
            legs = part if legs is None else legs.join(F.broadcast(part), "_one")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups")).withColumn("_one", F.lit(1))
    return size.join(F.broadcast(legs), "_one").drop("_one")


def covariate_strata(df: DataFrame, covariate: str = "covariate", strata: int = 3) -> DataFrame:
    """Add ``stratum``: quantile bins of the covariate, right-closed with the lowest value included.

    Break points are one broadcast row. Empty result when there are fewer than 3 rows per stratum or fewer
    than 3 distinct breaks.
    """
    known = pairs(df, "actual", "pred", covariate)
    probs = {f"_q{i}": i / strata for i in range(strata + 1)}
    size = known.agg(F.count(F.lit(1)).alias("_n"))
    breaks = quantiles(known, [], covariate, probs).select(F.array_distinct(F.array(*probs)).alias("_breaks"))
    one = breaks.withColumn("_one", F.lit(1)).join(F.broadcast(size.withColumn("_one", F.lit(1))), "_one")
    rows = known.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")
    rows = rows.filter((F.col("_n") >= 3 * strata) & (F.size("_breaks") >= 3))
    below = F.size(F.filter("_breaks", lambda b: b < F.col(covariate)))
    return rows.withColumn("stratum", F.greatest(below, F.lit(1))).drop("_breaks", "_n")


def stratified_metrics(
    df: DataFrame, group: str = "grp", covariate: str = "covariate", strata: int = 3
) -> DataFrame:
    """Null panel and within-group agreement inside each covariate stratum (group means are the stratum's own)."""
    rows = materialise(covariate_strata(df, covariate, strata))
    cell = rows.withColumn("_cell", F.concat_ws("|", F.col("stratum").cast("string"), F.col(group)))
    panel = null_panel(cell, ["stratum"], "_cell").drop("mae_train_null", "skill_train")
    within = within_group_metrics(cell, ["stratum"], "_cell").drop("n", "within_mae")
    span = rows.groupBy("stratum").agg(F.min(covariate).alias("cov_min"), F.max(covariate).alias("cov_max"))
    middle = quantiles(rows, ["stratum"], covariate, {"cov_median": 0.5})
    return reduce(lambda a, b: null_safe_join(a, b, ["stratum"]), [panel, within, span, middle])


def matched_band_metrics(
    df: DataFrame, low: float = 0.5, high: float = 0.8, group: str = "grp", covariate: str = "covariate"
) -> DataFrame:
    """The same comparison on one covariate band; no row below 10 kept samples."""
    band = pairs(df, "actual", "pred").filter(F.col(covariate).between(low, high))
    panel = null_panel(band, (), group).drop("mae_train_null", "skill_train").withColumn("_one", F.lit(1))
    within = within_group_metrics(band, (), group).drop("n", "within_mae").withColumn("_one", F.lit(1))
    return panel.join(F.broadcast(within), "_one").drop("_one").filter("n >= 10")


def with_pooled(df: DataFrame, group: str = "grp", label: str = POOLED) -> DataFrame:
    """Every row twice: under its own group and under ``label``. Lets one aggregation give both."""
    own = F.col(group)
    return df.withColumn(group, F.explode(F.array(own, F.lit(label))))


#: Columns of the wide panel that mean nothing inside one group.
POOLED_ONLY = ["within_pearson", "within_spearman", "group_r2_pred", "group_r2_actual"]


def group_panel_wide(df: DataFrame, group: str = "grp", b: int = 10_000, seed: int = 0) -> DataFrame:
    """The wide evaluation panel per group and pooled; the null is always each row's own group mean.

    Intervals of Pearson and Spearman are from ``b`` row bootstraps of the group, and of all rows for the pooled row (NULL below 5 rows). The
    pooled row also has the agreement within groups and what group identity explains of predictions and labels, NULL elsewhere.
    """
    known = pairs(df, "actual", "pred").select(group, "id", "actual", "pred")
    rows = group_mean_null(known, group)
    rows = rows.withColumn("abs_err", F.abs(_error())).withColumn(
        "null_err", F.abs(F.col("actual") - F.col("null_pred"))
    )
    n, sdy = F.count(F.lit(1)), F.stddev_samp("actual")
    parts = []
    for scope, keys in (("group", [group]), ("pooled", [])):
        ranked = midranks(rows, keys, {"_ra": "actual", "_rp": "pred"}, profile(known, keys))
        panel = _agg(
            ranked,
            keys,
            [
                *metric_columns(),
                F.when(n > 2, safe_corr("_ra", "_rp")).alias("spearman"),
                F.avg("actual").alias("actual_mean"),
                sdy.alias("actual_sd"),
                F.min("actual").alias("actual_min"),
                F.max("actual").alias("actual_max"),
                F.avg("pred").alias("pred_mean"),
                F.stddev_samp("pred").alias("pred_sd"),
                F.min("pred").alias("pred_min"),
                F.max("pred").alias("pred_max"),
                F.when(sdy > 0, F.try_divide(F.stddev_samp("pred"), sdy)).alias("range_compression"),
                F.avg("null_err").alias("mae_group_null"),
            ],
        )
        middle = quantiles(rows, keys, "abs_err", {"median_abs_error": 0.5}, profile(known, keys))
        if keys:
            panel = null_safe_join(panel, middle, keys)
        else:
            panel = panel.withColumn(group, F.lit(POOLED)).join(F.broadcast(middle.withColumn(group, F.lit(POOLED))), group)
        ci = bootstrap_pairs_ci(known, b, keys, seed).drop("n_ok")
        if keys:
            panel = null_safe_join(panel, ci, keys, "left").select("*", *[F.lit(None).cast("double").alias(c) for c in POOLED_ONLY])
        else:
            within = within_group_metrics(known, (), group).select("within_pearson", "within_spearman")
            share = group_identity_r2(known, ["pred", "actual"], group).agg(*[
                F.max(F.when(F.col("quantity") == v, F.col("group_r2"))).alias(f"group_r2_{v}") for v in ("pred", "actual")
            ])
            for one in (ci, within, share):
                panel = panel.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")
        parts.append(panel.withColumn("scope", F.lit(scope)))
    both = parts[0].unionByName(parts[1]).withColumn("boot_b", F.lit(b)).withColumn("boot_seed", F.lit(seed))
    return both.withColumn(
        "skill_group", F.when(F.col("mae_group_null") > 0, 1 - F.try_divide("mae", "mae_group_null"))
    )


def per_group_report(
    df: DataFrame, group: str = "grp", flag: Column | None = None, floor: float = 0.0
) -> DataFrame:
    """The headline table: clipped predictions, one row per group plus POOLED and MACRO (mean of the groups)."""
    flag = flag if flag is not None else F.lit(False)
    known = pairs(df, "actual", "pred")
    rows = known.withColumn("pred", clip_floor("pred", floor)).withColumn("_flag", flag)

    def report(keys):
        ranked = midranks(rows, keys, {"_ra": "actual", "_rp": "pred"}, profile(known, keys))
        n = F.count(F.lit(1))
        return _agg(
            ranked,
            keys,
            [
                n.alias("n"),
                F.avg("actual").alias("actual_mean"),
                F.avg("pred").alias("pred_mean"),
                F.when(n > 2, safe_corr("actual", "pred")).alias("pearson"),
                F.when(n > 2, safe_corr("_ra", "_rp")).alias("spearman"),
                F.avg(F.abs(_error())).alias("mae"),
                F.sqrt(F.avg(_error() * _error())).alias("rmse"),
                F.avg(_error()).alias("bias"),
                F.count_if("_flag").alias("n_flagged"),
                (F.count_if("_flag") * 100.0 / n).alias("abstention_pct"),
            ],
        )

    groups, pooled = report([group]), report([]).withColumn(group, F.lit(POOLED))
    averaged = ["actual_mean", "pred_mean", "pearson", "spearman", "mae", "rmse", "bias", "abstention_pct"]
    macro = groups.agg(
        F.sum("n").alias("n"), F.sum("n_flagged").alias("n_flagged"), *[F.avg(c).alias(c) for c in averaged]
    ).withColumn(group, F.lit(MACRO))
    return groups.unionByName(pooled).unionByName(macro)


def score_run_summary(df: DataFrame, group: str = "grp") -> DataFrame:
    """One row for a run: macro r and rho, pooled MAE, mean |bias|, group R2 of prediction and truth, groups with r > 0."""
    rows = pairs(df, "actual", "pred").withColumn("pred", clip_floor("pred"))
    per = metrics_panel(rows, [group])
    macro = per.agg(
        F.avg("pearson").alias("macro_r"),
        F.avg("spearman").alias("macro_rho"),
        (F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("pooled_mae"),
        F.avg(F.abs("bias")).alias("mean_abs_bias"),
        F.count_if(F.col("pearson") > 0).alias("n_pos_r"),
        F.count(F.lit(1)).alias("groups"),
    ).withColumn("_one", F.lit(1))
    r2 = group_identity_r2(rows, ["pred", "actual"], group).agg(
        F.max(F.when(F.col("quantity") == "pred", F.col("group_r2"))).alias("r2_group_pred"),
        F.max(F.when(F.col("quantity") == "actual", F.col("group_r2"))).alias("r2_group_truth"),
    )
    return macro.join(F.broadcast(r2.withColumn("_one", F.lit(1))), "_one").drop("_one")


def macro_relative_mae(df: DataFrame, truth: str, pred: str, group: str = "grp") -> DataFrame:
    """Mean over groups of each group's MAE."""
    per = pairs(df, truth, pred).groupBy(group).agg(F.avg(F.abs(F.col(truth) - F.col(pred))).alias("loss"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.avg("loss").alias("macro_mae"))


def macro_one_minus_spearman(df: DataFrame, truth: str, pred: str, group: str = "grp") -> DataFrame:
    """Mean over usable groups of 1 - Spearman."""
    per = spearman(df, [group], truth, pred, "rho").filter("rho IS NOT NULL")
    return per.agg(F.count(F.lit(1)).alias("groups"), F.avg(1 - F.col("rho")).alias("macro_loss"))


def auc_rank(
    df: DataFrame, keys: Sequence[str], score: str, event: Column, min_class: int = 1, out: str = "auc",
    like: Profile | None = None,
) -> DataFrame:
    """Mann-Whitney AUC with midranks from counted score values; NULL when a class has fewer than ``min_class`` rows."""
    known = df.withColumn("_event", event.cast("int")).dropna(subset=[score, "_event"])
    cells = value_cells(known, keys, score, {"pos": F.col("_event")}, like=like or profile(df, keys))
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    n1, n = F.sum("pos"), F.sum("n")
    n0 = n - n1
    u = F.sum(F.col("pos") * rank) - n1 * (n1 + 1) / F.lit(2.0)
    enough = (n1 >= min_class) & (n0 >= min_class)
    return _agg(
        cells,
        keys,
        [n1.alias("n_pos"), n0.alias("n_neg"), F.when(enough, F.try_divide(u, n1.cast("double") * n0)).alias(out)],
    )


def roc_points(df: DataFrame, score: str, event: Column, keys: Sequence[str] = ()) -> DataFrame:
    """ROC steps: one point per distinct score from high to low, and the leading (0, 0) with a NULL score."""
    known = df.withColumn("_event", event.cast("int")).dropna(subset=[score, "_event"])
    like = profile(df, keys)
    cells = value_cells(known, keys, score, {"pos": F.col("_event")}, descending=True, like=like)
    sized = group_attach(cells, keys, [F.sum("n").alias("_n"), F.sum("pos").alias("_pos")], like)
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("n_before") + F.col("n") - tp
    points = sized.select(
        *keys,
        F.col(score).alias("score"),
        F.try_divide(tp, F.col("_pos")).alias("tpr"),
        F.try_divide(fp, F.col("_n") - F.col("_pos")).alias("fpr"),
    )
    origin = known.groupBy(*keys).agg(F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")) if keys else known.agg(
        F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    )
    return points.unionByName(origin.withColumn("score", F.lit(None).cast("double")))


def roc_three_framings(df: DataFrame, cut: float, group: str = "grp") -> DataFrame:
    """AUC of the score at an absolute cut, of group identity alone, and of the centred score for the top quartile in group."""
    known = pairs(df, "actual", "pred")
    shape, whole = profile(known, [group]), profile(known, [])
    rows = known.withColumn("pred", clip_floor("pred"))
    tops = quantiles(rows, [group], "actual", {"_q75": 0.75}, shape)
    rows = attach(group_attach(rows, [group], [F.avg("pred").alias("_mean")], shape), tops, [group], shape.groups)
    rows = rows.withColumn("_centred", F.col("pred") - F.col("_mean"))
    high, top = F.col("actual") >= cut, F.col("actual") > F.col("_q75")
    framings = [
        ("absolute_cut", "pred", high),
        ("group_mean_only", "_mean", high),
        ("top_quartile_in_group", "_centred", top),
    ]
    out = None
    for name, score, event in framings:
        row = auc_rank(rows, [], score, event, like=whole).withColumn("framing", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def threshold_table(df: DataFrame, cut: float, near: float, group: str = "grp") -> DataFrame:
    """Crossing counts and rates at one cut for every group and pooled, with the rank AUC."""
    rows = with_pooled(pairs(df, "actual", "pred"), group)
    pos, hat = F.col("actual") >= cut, F.col("pred") >= cut
    tp, fp = F.count_if(pos & hat), F.count_if(~pos & hat)
    fn, tn = F.count_if(pos & ~hat), F.count_if(~pos & ~hat)
    table = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(tp, tp + fp).alias("ppv"),
        F.try_divide(tn, tn + fn).alias("npv"),
        F.count_if(F.abs(F.col("actual") - cut) <= near).alias("n_actual_near"),
        F.count_if(F.abs(F.col("pred") - cut) <= near).alias("n_pred_near"),
    )
    return null_safe_join(table, auc_rank(rows, [group], "pred", pos).select(group, "auc"), [group], "left")


def reliability_bins(df: DataFrame, q_hat: str, truth: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins of a predicted percentile, right-closed with 0 in the first; n and both means."""
    known = pairs(df, q_hat, truth).filter(F.col(q_hat).between(0, 1))
    edges = [F.when(F.col(q_hat) <= i / bins, i) for i in range(1, bins + 1)]
    return (
        known.withColumn("bin", F.coalesce(*edges))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(q_hat).alias("mean_q_hat"), F.avg(truth).alias("mean_q_true"))
    )


def brier(df: DataFrame, prob: str, event: Column, keys: Sequence[str] = (), null: float = 0.25) -> DataFrame:
    """Mean squared distance of a probability from the event, and of a constant probability."""
    e = event.cast("double")
    return _agg(
        df,
        keys,
        [
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col(prob) - e) * (F.col(prob) - e)).alias("brier"),
            F.avg((F.lit(null) - e) * (F.lit(null) - e)).alias("brier_null"),
        ],
    )


# The placement statistics, their orientation and the value they are ranked on.
PLACEMENT = (
    ("pearson", "higher"),
    ("spearman", "higher"),
    ("mae", "lower"),
    ("bias", "lower"),
    ("calibration_slope", "lower"),
)


def _oriented(panel: DataFrame, group: str) -> DataFrame:
    """Long (statistic, direction, value, goodness): the ranked value is signed so that larger is better."""
    def ranked(stat):
        c = F.col(stat)
        return F.abs(c) if stat == "bias" else F.abs(c - 1) if stat == "calibration_slope" else c

    cells = [
        F.struct(
            F.lit(s).alias("statistic"),
            F.lit(d).alias("direction"),
            F.col(s).alias("value"),
            ranked(s).alias("ranked_value"),
            (ranked(s) if d == "higher" else -ranked(s)).alias("goodness"),
        )
        for s, d in PLACEMENT
    ]
    return panel.select(group, F.explode(F.array(*cells)).alias("_c")).select(group, "_c.*")


def placement_percentile(panel: DataFrame, targets: Sequence[str], group: str = "grp") -> DataFrame:
    """Where each target group falls among the source groups, for five statistics.

    Both sides are counted as sorted values of one long table (no target-by-source pairs): the share of sources
    a target matches or beats is a running count, the rank is the min-tie rank in the combined set.
    """
    long = _oriented(panel, group).withColumn("is_target", F.col(group).isin(*targets))
    source = long.filter(~F.col("is_target"))
    wanted = {"source_min": 0.0, "source_q25": 0.25, "source_median": 0.5, "source_q75": 0.75, "source_max": 1.0}
    spread = quantiles(source, ["statistic"], "ranked_value", wanted)
    moments = source.groupBy("statistic").agg(
        F.count("ranked_value").alias("n_source"),
        F.avg("ranked_value").alias("source_mean"),
        F.stddev_samp("ranked_value").alias("source_sd"),
    )
    cells = value_cells(
        long, ["statistic"], "goodness", {"sources": (~F.col("is_target")).cast("long")}
    ).withColumn("beaten", F.col("sources_before") + F.col("sources"))
    placed = min_rank(long, ["statistic"], "goodness", "rank_of_combined", descending=True).filter("is_target")
    placed = placed.join(cells.select("statistic", "goodness", "beaten"), ["statistic", "goodness"], "left")
    out = placed.join(spread, "statistic").join(moments, "statistic")
    return out.select(
        "statistic", group, "direction", "value", "ranked_value", "n_source",
        *wanted, "source_mean", "source_sd",
        (F.try_divide("beaten", "n_source") * 100.0).alias("percentile_in_source"),
        "rank_of_combined",
        F.col("ranked_value").between(F.col("source_min"), F.col("source_max")).alias("inside_source_range"),
    )


def outcome_rule(panel: DataFrame, source: DataFrame, bias_quantile: float = 0.9) -> DataFrame:
    """One of three outcomes from the targets' panel (spearman, spearman_lo, skill_group, bias, calibration_slope)."""
    cuts = quantiles(source.withColumn("_ab", F.abs("bias")), [], "_ab", {"bias_cut": bias_quantile})
    slopes = source.agg(F.min("calibration_slope").alias("slope_lo"), F.max("calibration_slope").alias("slope_hi"))
    one = cuts.withColumn("_one", F.lit(1)).join(F.broadcast(slopes.withColumn("_one", F.lit(1))), "_one")
    rows = panel.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    rank_ok = F.coalesce((F.col("spearman") > 0) & (F.col("spearman_lo") > 0), F.lit(False))
    level_ok = F.coalesce(
        (F.col("skill_group") > 0)
        & (F.abs("bias") <= F.col("bias_cut"))
        & F.col("calibration_slope").between(F.col("slope_lo"), F.col("slope_hi")),
        F.lit(False),
    )
    verdict = rows.agg(F.bool_and(rank_ok).alias("rank_transfers"), F.bool_and(level_ok).alias("level_transfers"))
    return verdict.withColumn(
        "outcome",
        F.when(F.col("rank_transfers") & F.col("level_transfers"), "both")
        .when(F.col("rank_transfers"), "rank_only")
        .otherwise("neither"),
    )


def ood_summary(df: DataFrame, reportable: Column, group: str = "grp") -> DataFrame:
    """Per group and pooled, for all / reportable / flagged rows: counts, five-number OOD summary and metrics."""
    flag = F.coalesce(reportable, F.lit(False))
    subset = F.array(F.lit("all"), F.when(flag, "reportable").otherwise("flagged"))
    rows = with_pooled(df, group).withColumn("_ok", flag).withColumn("subset", F.explode(subset))
    keys = [group, "subset"]
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("_ok").alias("n_reportable"),
        F.count_if(~F.col("_ok")).alias("n_flagged"),
    )
    five = {"ood_min": 0.0, "ood_q25": 0.25, "ood_median": 0.5, "ood_q75": 0.75, "ood_max": 1.0}
    spread = quantiles(rows, keys, "ood_score", five)
    metrics = metrics_panel(rows, keys).select(
        *keys, "n", "pearson", "spearman", "mae", "rmse", "bias", "calibration_slope"
    )
    return null_safe_join(null_safe_join(counts, spread, keys, "left"), metrics, keys, "left")


def covariate_residual_corr(df: DataFrame, group: str = "grp", covariate: str = "covariate") -> DataFrame:
    """Spearman of the residual with a covariate, per group and pooled; NULL for n < 5."""
    known = pairs(df, "actual", "pred", covariate).select(group, _error().alias("residual"), covariate)
    rows = with_pooled(known, group)
    ranked = midranks(rows, [group], {"_r": "residual", "_c": covariate})
    n = F.count(F.lit(1))
    return ranked.groupBy(group).agg(n.alias("n"), F.when(n >= 5, safe_corr("_r", "_c")).alias("spearman"))


def skill_difference_macro(df: DataFrame, group: str = "grp") -> DataFrame:
    """Mean over groups of MAE(null) - MAE(model): a difference in label units, not a ratio."""
    rows = group_mean_null(pairs(df, "actual", "pred"), group)
    per = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(_error())).alias("mae"),
        F.avg(F.abs(F.col("actual") - F.col("null_pred"))).alias("mae_null"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg(F.col("mae_null") - F.col("mae")).alias("skill_difference"),
        (F.sum(F.col("n") * F.col("mae_null")) / F.sum("n")).alias("weighted_null_mae"),
    )


def domain_shift_per_group(df: DataFrame, cut: float, group: str = "grp") -> DataFrame:
    """Ranking (offset-free) against level per group: rho, AUC, bias, MAE raw / after own offset / null."""
    rows = group_attach(
        pairs(df, "actual", "pred"), [group], [F.avg(_error()).alias("_bias"), F.avg("actual").alias("_mean")]
    )
    err = _error()
    level = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("actual").alias("mean_actual"),
        F.avg("pred").alias("mean_pred"),
        F.avg(err).alias("bias"),
        F.avg(F.abs(err)).alias("mae_raw"),
        F.avg(F.abs(err - F.col("_bias"))).alias("mae_own_offset"),
        F.avg(F.abs(F.col("actual") - F.col("_mean"))).alias("mae_null"),
    )
    rho = spearman(rows, [group], "actual", "pred", "spearman")
    auc = auc_rank(rows, [group], "pred", F.col("actual") >= cut).select(group, "auc")
    return null_safe_join(null_safe_join(level, rho, [group], "left"), auc, [group], "left")


def run_summary(df: DataFrame, cut: float, group: str = "grp", least: int = 20) -> DataFrame:
    """Macro MAE and null MAE, pooled MAE and rho, median group rho (n >= least), pooled AUC: one row."""
    # Six passes read these columns: written once, so that the joins behind them do not run and broadcast six times.
    df = materialise(df.select(group, "actual", "pred"))
    per = domain_shift_per_group(df, cut, group)
    macro = per.agg(
        F.avg("mae_raw").alias("macro_mae"),
        F.avg("mae_null").alias("macro_null_mae"),
        (F.sum(F.col("n") * F.col("mae_raw")) / F.sum("n")).alias("pooled_mae"),
        F.percentile(F.when(F.col("n") >= least, F.col("spearman")), F.lit(0.5)).alias("median_group_rho"),
    )
    rho = spearman(df, [], "actual", "pred", "pooled_rho")
    auc = auc_rank(df, [], "pred", F.col("actual") >= cut, out="pooled_auc").select("pooled_auc")
    out = macro.withColumn("_one", F.lit(1))
    for part in (rho, auc):
        out = out.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def between_group_spread(df: DataFrame, group: str = "grp") -> DataFrame:
    """Spread of the group means, predicted against true."""
    means = pairs(df, "actual", "pred").groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("p"), F.avg("actual").alias("y")
    )
    return means.agg(
        F.stddev_samp("p").alias("sd_pred_means"),
        F.stddev_samp("y").alias("sd_true_means"),
        F.try_divide(F.stddev_samp("p"), F.stddev_samp("y")).alias("compression"),
        (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("grand_pred"),
        (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("grand_true"),
    )


def calibration_slope_per_group(df: DataFrame, q_hat: str, truth: str, group: str = "grp") -> DataFrame:
    """Line of truth on prediction per group, MACRO (mean of the groups) and POOLED; NULL if the prediction is constant."""
    rows = with_pooled(pairs(df, q_hat, truth), group)
    ok = F.stddev_samp(q_hat) >= 1e-12
    slope = safe_slope(truth, q_hat)
    lines = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(ok, slope).alias("slope"),
        F.when(ok, F.avg(truth) - slope * F.avg(q_hat)).alias("intercept"),
    )
    macro = lines.filter(F.col(group) != POOLED).agg(
        F.sum("n").alias("n"), F.avg("slope").alias("slope"), F.avg("intercept").alias("intercept")
    )
    return lines.unionByName(macro.withColumn(group, F.lit(MACRO)))


def negative_prediction_counts(df: DataFrame, group: str = "grp") -> DataFrame:
    """Negatives per group and how clipping them to zero moves Spearman."""
    rows = pairs(df, "actual", "pred").withColumn("clipped", clip_floor("pred"))
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") < 0).alias("n_negative"))
    raw = spearman(rows, [group], "actual", "pred", "rho_raw")
    clipped = spearman(rows, [group], "actual", "clipped", "rho_clipped")
    both = null_safe_join(null_safe_join(counts, raw, [group]), clipped, [group])
    return both.withColumn("rho_shift", F.col("rho_clipped") - F.col("rho_raw"))


def covariate_tertile_skill(df: DataFrame, group: str = "grp", covariate: str = "covariate") -> DataFrame:
    """Skill by covariate tertile before and after taking out each group's offset."""
    rows = group_attach(pairs(df, "actual", "pred", covariate), [group], [F.avg(_error()).alias("_offset")])
    corrected = rows.withColumn("pred", F.col("pred") - F.col("_offset"))
    before = stratified_metrics(rows.drop("_offset"), group, covariate).select("stratum", F.col("skill_group").alias("skill_raw"))
    after = stratified_metrics(corrected.drop("_offset"), group, covariate).select("stratum", F.col("skill_group").alias("skill_offset_removed"))
    return before.join(after, "stratum")
