"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.catalog.base import (
    pred_view, pred_view_b, parts_view, q_corr, q_midrank, q_slope, query, r, rounded, with_views,
)
from heldout.operators import metrics as M
from heldout.plans.skew import quantiles

PANEL = ["mae", "rmse", "r2", "pearson", "spearman", "calibration_intercept", "calibration_slope", "bias"]
CUT = 42.0 / 2


def _r(cols, digits=6):
    return ", ".join(f"{r(c, digits)} AS {c}" for c in cols)


@query("metrics_panel", f"{with_views('v_metrics')} SELECT grp, n, {_r(PANEL)} FROM v_metrics")
def metrics_panel(spark, sf):
    return rounded(M.metrics_panel(pred_view(spark, sf), ["grp"]))


@query(
    "metrics_panel_pooled",
    f"""{with_views('v_pred')} SELECT count(*) AS n, {r('avg(abs(actual - pred))')} AS mae,
    {r('sqrt(avg((pred - actual) * (pred - actual)))')} AS rmse,
    {r('1 - sum((pred - actual) * (pred - actual)) / (var_pop(actual) * count(*))')} AS r2,
    {r(q_corr('actual', 'pred'))} AS pearson, {r(q_corr('ra', 'rp'))} AS spearman,
    {r('avg(actual) - ' + q_slope('actual', 'pred') + ' * avg(pred)')} AS calibration_intercept,
    {r(q_slope('actual', 'pred'))} AS calibration_slope, {r('avg(pred - actual)')} AS bias
    FROM (SELECT *, {q_midrank('', 'actual')} AS ra, {q_midrank('', 'pred')} AS rp FROM v_pred)""",
)
def metrics_panel_pooled(spark, sf):
    return rounded(M.metrics_panel(pred_view(spark, sf), []))


@query(
    "group_mean_null",
    f"""{with_views('v_pred')} SELECT id, grp, {r('avg(actual) OVER (PARTITION BY grp)')} AS null_pred FROM v_pred""",
)
def group_mean_null(spark, sf):
    return rounded(M.group_mean_null(pred_view(spark, sf)).select("id", "grp", "null_pred"))


NULLS = """SELECT *, avg(actual) OVER (PARTITION BY grp) AS m, (SELECT avg(actual) FROM v_pred) AS t FROM v_pred"""


@query(
    "null_panel",
    f"""{with_views('v_pred')} SELECT n, {_r(['mae_model', 'mae_group_null', 'mae_train_null'])},
    {r('1 - mae_model / nullif(mae_group_null, 0)')} AS skill_group,
    {r('1 - mae_model / nullif(mae_train_null, 0)')} AS skill_train
    FROM (SELECT count(*) AS n, avg(abs(actual - pred)) AS mae_model, avg(abs(actual - m)) AS mae_group_null,
          avg(abs(actual - 25.5)) AS mae_train_null FROM ({NULLS}))""",
)
def null_panel(spark, sf):
    return rounded(M.null_panel(pred_view(spark, sf), training_mean=F.lit(25.5)))


CENTRED = """SELECT *, actual - avg(actual) OVER (PARTITION BY grp) AS yc, pred - avg(pred) OVER (PARTITION BY grp) AS pc
             FROM v_pred"""


@query(
    "within_group_metrics",
    f"""{with_views('v_pred')} SELECT count(*) AS n, {r(q_corr('yc', 'pc'))} AS within_pearson,
    {r(q_corr('ra', 'rp'), 4)} AS within_spearman, {r('avg(abs(yc - pc))')} AS within_mae
    FROM (SELECT *, {q_midrank('', 'yc')} AS ra, {q_midrank('', 'pc')} AS rp FROM ({CENTRED}))""",
)
def within_group_metrics(spark, sf):
    out = M.within_group_metrics(pred_view(spark, sf))
    return rounded(out.withColumn("within_spearman", F.round("within_spearman", 4)))


def _r2_sql(name):
    return f"""SELECT '{name}' AS quantity, count(*) AS n, count(DISTINCT grp) AS groups,
    {r('1 - sum((x - m) * (x - m)) / sum((x - a) * (x - a))')} AS group_r2 FROM (SELECT grp, {name} AS x,
    avg({name}) OVER (PARTITION BY grp) AS m, avg({name}) OVER () AS a FROM v_pred)"""


@query(
    "group_identity_r2",
    f"{with_views('v_pred')} " + " UNION ALL ".join(_r2_sql(c) for c in ("actual", "pred", "covariate")),
)
def group_identity_r2(spark, sf):
    return rounded(M.group_identity_r2(pred_view(spark, sf), ["actual", "pred", "covariate"]))


@query(
    "confound_legs",
    f"""{with_views('v_pred')}, g AS (SELECT *, {q_midrank('grp', 'actual')} AS ga, {q_midrank('grp', 'pred')} AS gp,
    {q_midrank('grp', 'covariate')} AS gc, {q_midrank('', 'actual')} AS pa, {q_midrank('', 'pred')} AS pp,
    {q_midrank('', 'covariate')} AS pc FROM v_pred)
    SELECT n, groups, {_r(['pred_within', 'pred_pooled', 'label_within', 'label_pooled'])} FROM
    (SELECT count(*) AS n, count(DISTINCT grp) AS groups, {q_corr('pp', 'pc')} AS pred_pooled,
     {q_corr('pa', 'pc')} AS label_pooled FROM g),
    (SELECT avg(a) AS pred_within, avg(b) AS label_within FROM
     (SELECT {q_corr('gp', 'gc')} AS a, {q_corr('ga', 'gc')} AS b FROM g GROUP BY grp))""",
)
def confound_legs(spark, sf):
    return rounded(M.confound_legs(pred_view(spark, sf)))


STRATA = """q AS (SELECT quantile_cont(covariate, 0.0) q0, quantile_cont(covariate, 1.0 / 3) q1,
    quantile_cont(covariate, 2.0 / 3) q2, quantile_cont(covariate, 1.0) q3 FROM v_pred),
    s AS (SELECT v_pred.*, CASE WHEN covariate <= q1 THEN 1 WHEN covariate <= q2 THEN 2 ELSE 3 END AS stratum
          FROM v_pred, q),
    c AS (SELECT *, avg(actual) OVER (PARTITION BY stratum, grp) AS m, avg(pred) OVER (PARTITION BY stratum, grp) AS mp FROM s),
    d AS (SELECT *, actual - m AS yc, pred - mp AS pc FROM c),
    k AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY yc) AS ra, rank() OVER (PARTITION BY stratum ORDER BY pc) AS rp FROM d)"""


@query(
    "stratified_metrics",
    f"""{with_views('v_pred')}, {STRATA} SELECT CAST(stratum AS INTEGER) AS stratum, count(*) AS n,
    {r('avg(abs(actual - pred))')} AS mae_model, {r('avg(abs(actual - m))')} AS mae_group_null,
    {r('1 - avg(abs(actual - pred)) / avg(abs(actual - m))')} AS skill_group,
    {r(q_corr('yc', 'pc'))} AS within_pearson, {r(q_corr('ra', 'rp'), 4)} AS within_spearman,
    min(covariate) AS cov_min, max(covariate) AS cov_max, {r('quantile_cont(covariate, 0.5)')} AS cov_median
    FROM k GROUP BY stratum""",
)
def stratified_metrics(spark, sf):
    out = M.stratified_metrics(pred_view(spark, sf))
    return rounded(out.withColumn("within_spearman", F.round("within_spearman", 4)))


@query(
    "matched_band_metrics",
    f"""{with_views('v_pred')}, b AS (SELECT * FROM v_pred WHERE covariate BETWEEN 0.5 AND 0.8),
    c AS (SELECT *, actual - avg(actual) OVER (PARTITION BY grp) AS yc, pred - avg(pred) OVER (PARTITION BY grp) AS pc FROM b)
    SELECT count(*) AS n, {r('avg(abs(actual - pred))')} AS mae_model, {r('avg(abs(yc))')} AS mae_group_null,
    {r('1 - avg(abs(actual - pred)) / avg(abs(yc))')} AS skill_group, {r(q_corr('yc', 'pc'))} AS within_pearson,
    {r(q_corr('ra', 'rp'), 4)} AS within_spearman
    FROM (SELECT *, rank() OVER (ORDER BY yc) AS ra, rank() OVER (ORDER BY pc) AS rp FROM c)""",
)
def matched_band_metrics(spark, sf):
    out = M.matched_band_metrics(pred_view(spark, sf))
    return rounded(out.withColumn("within_spearman", F.round("within_spearman", 4)))


WIDE_MID = ["actual_mean", "actual_sd", "actual_min", "actual_max", "pred_mean", "pred_sd", "pred_min", "pred_max",
            "range_compression", "mae_group_null", "median_abs_error"]


def _wide(scope, part, label):
    group = f"GROUP BY {part}" if part else ""
    return f"""SELECT '{scope}' AS scope, {label} AS grp, count(*) AS n, avg(abs(actual - pred)) AS mae,
    sqrt(avg((pred - actual) * (pred - actual))) AS rmse,
    1 - sum((pred - actual) * (pred - actual)) / nullif(var_pop(actual) * count(*), 0) AS r2,
    {q_corr('actual', 'pred')} AS pearson, {q_corr('ra', 'rp')} AS spearman,
    avg(actual) - {q_slope('actual', 'pred')} * avg(pred) AS calibration_intercept,
    {q_slope('actual', 'pred')} AS calibration_slope, avg(pred - actual) AS bias,
    avg(actual) AS actual_mean, stddev_samp(actual) AS actual_sd, min(actual) AS actual_min, max(actual) AS actual_max,
    avg(pred) AS pred_mean, stddev_samp(pred) AS pred_sd, min(pred) AS pred_min, max(pred) AS pred_max,
    stddev_samp(pred) / nullif(stddev_samp(actual), 0) AS range_compression, avg(abs(actual - m)) AS mae_group_null,
    quantile_cont(abs(pred - actual), 0.5) AS median_abs_error
    FROM (SELECT *, {q_midrank(part, 'actual')} AS ra, {q_midrank(part, 'pred')} AS rp FROM
          (SELECT *, avg(actual) OVER (PARTITION BY grp) AS m FROM v_pred)) {group}"""


REPORT = ["actual_mean", "pred_mean", "pearson", "spearman", "mae", "rmse", "bias", "abstention_pct"]


def _report(part, label):
    group = f"GROUP BY {part}" if part else ""
    return f"""SELECT {label} AS grp, count(*) AS n, avg(actual) AS actual_mean, avg(p) AS pred_mean,
    {q_corr('actual', 'p')} AS pearson, {q_corr('ra', 'rp')} AS spearman, avg(abs(actual - p)) AS mae,
    sqrt(avg((p - actual) * (p - actual))) AS rmse, avg(p - actual) AS bias,
    count(*) FILTER (ood_score > 0.9) AS n_flagged, count(*) FILTER (ood_score > 0.9) * 100.0 / count(*) AS abstention_pct
    FROM (SELECT *, {q_midrank(part, 'actual')} AS ra, {q_midrank(part, 'p')} AS rp FROM
          (SELECT *, greatest(pred, 0) AS p FROM v_pred)) {group}"""


@query(
    "per_group_report",
    f"""{with_views('v_pred')}, g AS ({_report('grp', 'grp')}) SELECT grp, n, n_flagged, {_r(REPORT)} FROM
    (SELECT * FROM g UNION ALL {_report('', "'POOLED'")} UNION ALL
     SELECT 'MACRO', CAST(sum(n) AS BIGINT), avg(actual_mean), avg(pred_mean), avg(pearson), avg(spearman), avg(mae),
     avg(rmse), avg(bias), CAST(sum(n_flagged) AS BIGINT), avg(abstention_pct) FROM g)""",
)
def per_group_report(spark, sf):
    return rounded(M.per_group_report(pred_view(spark, sf), flag=F.col("ood_score") > 0.9))


def _summary_sql(view):
    return f"""SELECT avg({q_corr('actual', 'p')}) AS x FROM {view}"""


def summary_cte(view: str) -> str:
    return f"""p AS (SELECT *, greatest(pred, 0) AS c FROM {view}),
    k AS (SELECT *, {q_midrank('grp', 'actual')} AS ra, {q_midrank('grp', 'c')} AS rp,
          avg(actual) OVER (PARTITION BY grp) AS my, avg(c) OVER (PARTITION BY grp) AS mc FROM p),
    g AS (SELECT grp, count(*) AS n, {q_corr('actual', 'c')} AS r, {q_corr('ra', 'rp')} AS rho,
          avg(abs(actual - c)) AS mae, avg(c - actual) AS bias FROM k GROUP BY grp),
    summary AS (SELECT * FROM (SELECT avg(r) AS macro_r, avg(rho) AS macro_rho, sum(mae * n) / sum(n) AS pooled_mae,
          avg(abs(bias)) AS mean_abs_bias, count(*) FILTER (r > 0) AS n_pos_r, count(*) AS groups FROM g),
         (SELECT 1 - sum((c - mc) * (c - mc)) / (var_pop(c) * count(*)) AS r2_group_pred,
                 1 - sum((actual - my) * (actual - my)) / (var_pop(actual) * count(*)) AS r2_group_truth FROM k))"""


@query(
    "score_run_summary",
    f"""{with_views('v_pred')}, {summary_cte('v_pred')} SELECT n_pos_r, groups,
    {_r(['macro_r', 'macro_rho', 'pooled_mae', 'mean_abs_bias', 'r2_group_pred', 'r2_group_truth'])} FROM summary""",
)
def score_run_summary(spark, sf):
    return rounded(M.score_run_summary(pred_view(spark, sf)))


@query(
    "macro_relative_mae",
    f"""{with_views('v_pred')} SELECT count(*) AS groups, {r('avg(l)')} AS macro_mae FROM
    (SELECT avg(abs(yc - pc)) AS l FROM ({CENTRED}) GROUP BY grp)""",
)
def macro_relative_mae(spark, sf):
    rows = M.centred(pred_view(spark, sf))
    return rounded(M.macro_relative_mae(rows, "actual_c", "pred_c"))


@query(
    "macro_one_minus_spearman",
    f"""{with_views('v_metrics')} SELECT count(*) AS groups, {r('avg(1 - spearman)')} AS macro_loss FROM v_metrics""",
)
def macro_one_minus_spearman(spark, sf):
    return rounded(M.macro_one_minus_spearman(pred_view(spark, sf), "actual", "pred"))


def auc_sql(view, score, event, part="", min_class=1):
    by = f"{part}, " if part else ""
    group = f"GROUP BY {part}" if part else ""
    return f"""SELECT {by}count(*) FILTER (e) AS n_pos, count(*) FILTER (NOT e) AS n_neg,
    CASE WHEN count(*) FILTER (e) >= {min_class} AND count(*) FILTER (NOT e) >= {min_class} THEN
    (sum(rk) FILTER (e) - count(*) FILTER (e) * (count(*) FILTER (e) + 1) / 2.0)
    / (count(*) FILTER (e) * count(*) FILTER (NOT e)) END AS auc
    FROM (SELECT *, {event} AS e, {q_midrank(part, score)} AS rk FROM {view}) {group}"""


@query(
    "auc_rank",
    f"{with_views('v_pred')} SELECT grp, n_pos, n_neg, {r('auc')} AS auc FROM "
    f"({auc_sql('v_pred', 'pred', f'actual >= {CUT}', 'grp', 5)})",
)
def auc_rank(spark, sf):
    return rounded(M.auc_rank(pred_view(spark, sf), ["grp"], "pred", F.col("actual") >= CUT, min_class=5))


@query(
    "roc_points",
    f"""{with_views('v_pred')}, c AS (SELECT pred AS score, count(*) AS n, count(*) FILTER (actual >= {CUT}) AS pos
    FROM v_pred GROUP BY pred), t AS (SELECT sum(n) AS n, sum(pos) AS pos FROM c)
    SELECT {r('score')} AS score, {r('tp / t.pos')} AS tpr, {r('fp / (t.n - t.pos)')} AS fpr FROM
    (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n - pos) OVER (ORDER BY score DESC) AS fp FROM c), t
    UNION ALL SELECT NULL, 0.0, 0.0""",
)
def roc_points(spark, sf):
    return rounded(M.roc_points(pred_view(spark, sf), "pred", F.col("actual") >= CUT))


@query(
    "roc_three_framings",
    f"""{with_views('v_pred')}, p AS (SELECT *, greatest(pred, 0) AS c FROM v_pred),
    m AS (SELECT *, round(avg(c) OVER (PARTITION BY grp), 9) AS gm, c - avg(c) OVER (PARTITION BY grp) AS cc,
          quantile_cont(actual, 0.75) OVER (PARTITION BY grp) AS q75 FROM p)
    SELECT 'absolute_cut' AS framing, n_pos, n_neg, {r('auc', 5)} AS auc FROM ({auc_sql('m', 'c', f'actual >= {CUT}')})
    UNION ALL SELECT 'group_mean_only', n_pos, n_neg, {r('auc', 5)} FROM ({auc_sql('m', 'gm', f'actual >= {CUT}')})
    UNION ALL SELECT 'top_quartile_in_group', n_pos, n_neg, {r('auc', 5)} FROM ({auc_sql('m', 'cc', 'actual > q75')})""",
)
def roc_three_framings(spark, sf):
    return rounded(M.roc_three_framings(pred_view(spark, sf), CUT), 5)


TWICE = "SELECT * FROM v_pred UNION ALL SELECT * REPLACE ('POOLED' AS grp) FROM v_pred"


@query(
    "threshold_table",
    f"""{with_views('v_pred')}, w AS ({TWICE}), a AS ({auc_sql('w', 'pred', f'actual >= {CUT}', 'grp')}),
    k AS (SELECT grp, count(*) AS n, count(*) FILTER (actual >= {CUT} AND pred >= {CUT}) AS tp,
      count(*) FILTER (actual < {CUT} AND pred >= {CUT}) AS fp, count(*) FILTER (actual >= {CUT} AND pred < {CUT}) AS fn,
      count(*) FILTER (actual < {CUT} AND pred < {CUT}) AS tn, count(*) FILTER (abs(actual - {CUT}) <= 5) AS n_actual_near,
      count(*) FILTER (abs(pred - {CUT}) <= 5) AS n_pred_near FROM w GROUP BY grp)
    SELECT k.*, {r('tp / nullif(tp + fn, 0)')} AS sensitivity, {r('tn / nullif(tn + fp, 0)')} AS specificity,
    {r('tp / nullif(tp + fp, 0)')} AS ppv, {r('tn / nullif(tn + fn, 0)')} AS npv, {r('auc')} AS auc
    FROM k JOIN a ON k.grp = a.grp""",
)
def threshold_table(spark, sf):
    return rounded(M.threshold_table(pred_view(spark, sf), CUT, 5.0))


@query(
    "reliability_bins",
    f"""{with_views('v_pred')}, q AS (SELECT least(greatest(pred / 50, 0), 1) AS q_hat,
    ({q_midrank('grp', 'actual')} - 0.5) / count(*) OVER (PARTITION BY grp) AS q_true FROM v_pred)
    SELECT CAST(CASE {' '.join(f'WHEN q_hat <= {i / 10} THEN {i}' for i in range(1, 11))} END AS INTEGER) AS bin,
    count(*) AS n, {r('avg(q_hat)')} AS mean_q_hat, {r('avg(q_true)')} AS mean_q_true FROM q GROUP BY 1""",
)
def reliability_bins(spark, sf):
    from heldout.operators.ranking import within_group_percentile

    rows = within_group_percentile(pred_view(spark, sf), ["grp"], "actual", "q_true")
    rows = rows.withColumn("q_hat", F.least(F.greatest(F.col("pred") / 50, F.lit(0.0)), F.lit(1.0)))
    return rounded(M.reliability_bins(rows, "q_hat", "q_true"))


@query(
    "brier",
    f"""{with_views('v_pred')}, b AS (SELECT grp, least(greatest(pred / 50, 0), 1) AS p,
    CASE WHEN actual >= {CUT} THEN 1.0 ELSE 0.0 END AS e FROM v_pred)
    SELECT grp, count(*) AS n, {r('avg((p - e) * (p - e))')} AS brier, {r('avg((0.25 - e) * (0.25 - e))')} AS brier_null
    FROM b GROUP BY grp""",
)
def brier(spark, sf):
    rows = pred_view(spark, sf).withColumn("p", F.least(F.greatest(F.col("pred") / 50, F.lit(0.0)), F.lit(1.0)))
    return rounded(M.brier(rows, "p", F.col("actual") >= CUT, ["grp"]))


def _placement_sql(stat, ranked, direction):
    good = ranked if direction == "higher" else f"-({ranked})"
    return f"""SELECT grp, '{stat}' AS statistic, '{direction}' AS direction, {stat} AS value, {ranked} AS ranked_value,
    {good} AS goodness, grp IN ('NATION_3', 'NATION_7') AS target FROM v_metrics"""


PLACE = " UNION ALL ".join(
    _placement_sql(s, e, d)
    for s, e, d in (
        ("pearson", "pearson", "higher"), ("spearman", "spearman", "higher"), ("mae", "mae", "lower"),
        ("bias", "abs(bias)", "lower"), ("calibration_slope", "abs(calibration_slope - 1)", "lower"),
    )
)


@query(
    "placement_percentile",
    f"""{with_views('v_metrics')}, l AS ({PLACE}),
    k AS (SELECT *, rank() OVER (PARTITION BY statistic ORDER BY goodness DESC) AS rank_of_combined FROM l),
    s AS (SELECT statistic, count(*) AS n_source, min(ranked_value) AS source_min, quantile_cont(ranked_value, 0.25) AS source_q25,
     quantile_cont(ranked_value, 0.5) AS source_median, quantile_cont(ranked_value, 0.75) AS source_q75,
     max(ranked_value) AS source_max, avg(ranked_value) AS source_mean, stddev_samp(ranked_value) AS source_sd
     FROM l WHERE NOT target GROUP BY statistic)
    SELECT k.statistic, k.grp, direction, {_r(['value', 'ranked_value'])}, n_source,
    {_r(['source_min', 'source_q25', 'source_median', 'source_q75', 'source_max', 'source_mean', 'source_sd'])},
    {r('100.0 * (SELECT count(*) FROM l WHERE NOT l.target AND l.statistic = k.statistic AND l.goodness <= k.goodness) / n_source')}
      AS percentile_in_source,
    rank_of_combined, ranked_value BETWEEN source_min AND source_max AS inside_source_range
    FROM k JOIN s ON k.statistic = s.statistic WHERE target""",
)
def placement_percentile(spark, sf):
    panel = M.metrics_panel(pred_view(spark, sf), ["grp"])
    return rounded(M.placement_percentile(panel, ["NATION_3", "NATION_7"]))


@query(
    "placement_cross",
    f"""{with_views('v_metrics')} SELECT t.grp, count(*) AS n_source, count(*) FILTER (s.mae >= t.mae) AS beaten
    FROM v_metrics t JOIN v_metrics s ON t.grp IN ('NATION_3', 'NATION_7') AND s.grp NOT IN ('NATION_3', 'NATION_7') GROUP BY t.grp""",
)
def placement_cross(spark, sf):
    """How many source groups each target matches or beats on MAE, by running counts instead of pairs."""
    panel = M.metrics_panel(pred_view(spark, sf), ["grp"])
    placed = M.placement_percentile(panel, ["NATION_3", "NATION_7"]).filter("statistic = 'mae'")
    return placed.select("grp", "n_source", F.round(F.col("percentile_in_source") * F.col("n_source") / 100).cast("long").alias("beaten"))


@query(
    "weighted_null_mae",
    f"""{with_views('v_pred')} SELECT {r('sum(n * nm) / sum(n)')} AS weighted_null_mae FROM (SELECT count(*) AS n, avg(abs(actual - m)) AS nm FROM ({NULLS}) GROUP BY grp)""",
)
def weighted_null_mae(spark, sf):
    return rounded(M.skill_difference_macro(pred_view(spark, sf)).select("weighted_null_mae"))


@query(
    "outcome_rule",
    f"""{with_views('v_metrics')}, n AS (SELECT grp, avg(abs(actual - m)) AS null_mae FROM
     (SELECT grp, actual, avg(actual) OVER (PARTITION BY grp) AS m FROM v_pred) GROUP BY grp),
    t AS (SELECT v.*, 1 - mae / null_mae AS skill, tanh(atanh(spearman) - 1.959963984540054 / sqrt(n - 3)) AS lo
          FROM v_metrics v JOIN n ON v.grp = n.grp),
    s AS (SELECT quantile_cont(abs(bias), 0.9) AS cut, min(calibration_slope) AS a, max(calibration_slope) AS b
          FROM t WHERE grp NOT IN ('NATION_3', 'NATION_7')),
    o AS (SELECT bool_and(spearman > 0 AND lo > 0) AS rank_transfers,
          bool_and(skill > 0 AND abs(bias) <= cut AND calibration_slope BETWEEN a AND b) AS level_transfers
          FROM t, s WHERE grp IN ('NATION_3', 'NATION_7'))
    SELECT *, CASE WHEN rank_transfers AND level_transfers THEN 'both' WHEN rank_transfers THEN 'rank_only'
    ELSE 'neither' END AS outcome FROM o""",
)
def outcome_rule(spark, sf):
    from heldout.functions.scalars import fisher_ci

    df = pred_view(spark, sf)
    panel = M.metrics_panel(df, ["grp"]).join(M.null_panel(df, ["grp"]).select("grp", "skill_group"), "grp")
    panel = panel.withColumn("spearman_lo", fisher_ci("spearman", "n")[0])
    target = F.col("grp").isin("NATION_3", "NATION_7")
    return M.outcome_rule(panel.filter(target), panel.filter(~target))


@query(
    "ood_summary",
    f"""{with_views('v_pred')}, w AS ({TWICE}), s AS (SELECT *, 'all' AS subset FROM w UNION ALL
     SELECT *, CASE WHEN ood_score <= 0.8 THEN 'reportable' ELSE 'flagged' END FROM w),
    k AS (SELECT *, {q_midrank('grp, subset', 'actual')} AS ra, {q_midrank('grp, subset', 'pred')} AS rp FROM s)
    SELECT grp, subset, count(*) AS n_rows, count(*) FILTER (ood_score <= 0.8) AS n_reportable,
    count(*) FILTER (ood_score > 0.8) AS n_flagged, {r('min(ood_score)')} AS ood_min,
    {r('quantile_cont(ood_score, 0.25)')} AS ood_q25, {r('quantile_cont(ood_score, 0.5)')} AS ood_median,
    {r('quantile_cont(ood_score, 0.75)')} AS ood_q75, {r('max(ood_score)')} AS ood_max, count(*) AS n,
    {r(q_corr('actual', 'pred'))} AS pearson, {r(q_corr('ra', 'rp'))} AS spearman, {r('avg(abs(actual - pred))')} AS mae,
    {r('sqrt(avg((actual - pred) * (actual - pred)))')} AS rmse, {r('avg(pred - actual)')} AS bias,
    {r(q_slope('actual', 'pred'))} AS calibration_slope FROM k GROUP BY grp, subset""",
)
def ood_summary(spark, sf):
    return rounded(M.ood_summary(pred_view(spark, sf), F.col("ood_score") <= 0.8))


@query(
    "covariate_residual_corr",
    f"""{with_views('v_pred')}, w AS (SELECT *, pred - actual AS e FROM ({TWICE})),
    k AS (SELECT *, {q_midrank('grp', 'e')} AS a, {q_midrank('grp', 'covariate')} AS b FROM w)
    SELECT grp, count(*) AS n, CASE WHEN count(*) >= 5 THEN {r(q_corr('a', 'b'))} END AS spearman FROM k GROUP BY grp""",
)
def covariate_residual_corr(spark, sf):
    return rounded(M.covariate_residual_corr(pred_view(spark, sf)))


@query(
    "skill_difference_macro",
    f"""{with_views('v_pred')} SELECT count(*) AS groups, {r('avg(nm - mm)')} AS skill_difference,
    {r('sum(n * nm) / sum(n)')} AS weighted_null_mae FROM (SELECT grp, count(*) AS n, avg(abs(actual - m)) AS nm,
    avg(abs(actual - pred)) AS mm FROM ({NULLS}) GROUP BY grp)""",
)
def skill_difference_macro(spark, sf):
    return rounded(M.skill_difference_macro(pred_view(spark, sf)))


SHIFT = f"""h AS (SELECT *, avg(actual) OVER (PARTITION BY grp) AS m, avg(pred - actual) OVER (PARTITION BY grp) AS b,
    {q_midrank('grp', 'actual')} AS ra, {q_midrank('grp', 'pred')} AS rp FROM v_pred),
    shift AS (SELECT h.grp, count(*) AS n, avg(actual) AS mean_actual, avg(pred) AS mean_pred, avg(pred - actual) AS bias,
    avg(abs(pred - actual)) AS mae_raw, avg(abs(pred - actual - b)) AS mae_own_offset, avg(abs(actual - m)) AS mae_null,
    {q_corr('ra', 'rp')} AS spearman, any_value(a.auc) AS auc FROM h JOIN
    ({auc_sql('v_pred', 'pred', f'actual >= {CUT}', 'grp')}) a ON h.grp = a.grp GROUP BY h.grp)"""


@query(
    "domain_shift_per_group",
    f"""{with_views('v_pred')}, {SHIFT} SELECT grp, n,
    {_r(['mean_actual', 'mean_pred', 'bias', 'mae_raw', 'mae_own_offset', 'mae_null', 'spearman', 'auc'])} FROM shift""",
)
def domain_shift_per_group(spark, sf):
    return rounded(M.domain_shift_per_group(pred_view(spark, sf), CUT))


@query(
    "run_summary",
    f"""{with_views('v_pred')}, {SHIFT} SELECT {r('avg(mae_raw)')} AS macro_mae, {r('avg(mae_null)')} AS macro_null_mae,
    {r('sum(n * mae_raw) / sum(n)')} AS pooled_mae, {r('quantile_cont(spearman, 0.5) FILTER (n >= 20)')} AS median_group_rho,
    (SELECT {r(q_corr('a', 'b'))} FROM (SELECT {q_midrank('', 'actual')} AS a, {q_midrank('', 'pred')} AS b FROM v_pred)) AS pooled_rho,
    (SELECT {r('auc')} FROM ({auc_sql('v_pred', 'pred', f'actual >= {CUT}')})) AS pooled_auc FROM shift""",
)
def run_summary(spark, sf):
    return rounded(M.run_summary(pred_view(spark, sf), CUT))


@query(
    "between_group_spread",
    f"""{with_views('v_pred')}, m AS (SELECT count(*) AS n, avg(pred) AS p, avg(actual) AS y FROM v_pred GROUP BY grp)
    SELECT {r('stddev_samp(p)')} AS sd_pred_means, {r('stddev_samp(y)')} AS sd_true_means,
    {r('stddev_samp(p) / stddev_samp(y)')} AS compression, {r('sum(n * p) / sum(n)')} AS grand_pred,
    {r('sum(n * y) / sum(n)')} AS grand_true FROM m""",
)
def between_group_spread(spark, sf):
    return rounded(M.between_group_spread(pred_view(spark, sf)))


@query(
    "calibration_slope_per_group",
    f"""{with_views('v_pred')}, w AS ({TWICE}), l AS (SELECT grp, count(*) AS n, {q_slope('actual', 'pred')} AS slope,
    avg(actual) - {q_slope('actual', 'pred')} * avg(pred) AS intercept FROM w GROUP BY grp)
    SELECT grp, n, {_r(['slope', 'intercept'])} FROM l UNION ALL
    SELECT 'MACRO', CAST(sum(n) AS BIGINT), {r('avg(slope)')}, {r('avg(intercept)')} FROM l WHERE grp <> 'POOLED'""",
)
def calibration_slope_per_group(spark, sf):
    return rounded(M.calibration_slope_per_group(pred_view(spark, sf), "pred", "actual"))


@query(
    "negative_prediction_counts",
    f"""{with_views('v_pred')}, p AS (SELECT *, greatest(pred, 0) AS c FROM v_pred),
    k AS (SELECT *, {q_midrank('grp', 'actual')} AS ra, {q_midrank('grp', 'pred')} AS rp, {q_midrank('grp', 'c')} AS rc FROM p)
    SELECT grp, count(*) AS n, count(*) FILTER (pred < 0) AS n_negative, {r(q_corr('ra', 'rp'))} AS rho_raw,
    {r(q_corr('ra', 'rc'))} AS rho_clipped, {r(q_corr('ra', 'rc') + ' - ' + q_corr('ra', 'rp'))} AS rho_shift
    FROM k GROUP BY grp""",
)
def negative_prediction_counts(spark, sf):
    return rounded(M.negative_prediction_counts(pred_view(spark, sf)))


@query(
    "offset_removed_skill",
    f"""{with_views('v_pred')}, {STRATA}, o AS (SELECT *, avg(pred - actual) OVER (PARTITION BY grp) AS b FROM d)
    SELECT CAST(stratum AS INTEGER) AS stratum, {r('1 - avg(abs(actual - pred)) / avg(abs(actual - m))')} AS skill_raw,
    {r('1 - avg(abs(actual - (pred - b))) / avg(abs(actual - m))')} AS skill_offset_removed FROM o GROUP BY stratum""",
)
def offset_removed_skill(spark, sf):
    return rounded(M.covariate_tertile_skill(pred_view(spark, sf)))


@query(
    "excess_group_r2",
    f"""{with_views('v_pred', 'v_pred_b')}, m AS (SELECT a.grp, a.actual, a.pred AS pa, b.pred AS pb
    FROM v_pred a JOIN v_pred_b b ON a.id = b.id),
    w AS (SELECT *, avg(actual) OVER (PARTITION BY grp) AS gy, avg(pa) OVER (PARTITION BY grp) AS ga,
          avg(pb) OVER (PARTITION BY grp) AS gb FROM m),
    s AS (SELECT 1 - sum((actual - gy) * (actual - gy)) / (var_pop(actual) * count(*)) AS t,
          1 - sum((pa - ga) * (pa - ga)) / (var_pop(pa) * count(*)) AS a,
          1 - sum((pb - gb) * (pb - gb)) / (var_pop(pb) * count(*)) AS b FROM w)
    SELECT {r('t')} AS r2_truth, {r('a')} AS r2_a, {r('b')} AS r2_b, {r('a - t')} AS excess_a, {r('b - t')} AS excess_b,
    {r('(a - b) / nullif(a - t, 0)', 4)} AS excess_removed FROM s""",
)
def excess_group_r2(spark, sf):
    from heldout.operators.reports import excess_group_r2 as op

    out = op(pred_view(spark, sf), pred_view_b(spark, sf))
    return rounded(out.withColumn("excess_removed", F.round("excess_removed", 4)))
