"""Comparison, component and group-level report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.catalog.base import (
    LOCKED, long_view, orders_view, parts_view, pred_view, pred_view_b, q_corr, q_midrank, q_slope, query, r, rounded,
    segments_view, table, with_views,
)
from heldout.catalog.metrics import CUT, summary_cte, _r
from heldout.operators import reports as P
from heldout.operators.metrics import metrics_panel, score_run_summary

BOTH = with_views("v_pred", "v_pred_b")
PARTS = with_views("v_parts")


def _panel_b():
    return f"""mb AS (SELECT grp, {q_corr('actual', 'pred')} AS pearson, {q_corr('ra', 'rp')} AS spearman,
    avg(abs(actual - pred)) AS mae, avg(pred - actual) AS bias FROM
    (SELECT *, {q_midrank('grp', 'actual')} AS ra, {q_midrank('grp', 'pred')} AS rp FROM v_pred_b) GROUP BY grp)"""


MERGED = f"""{with_views('v_metrics', 'v_pred_b')}, {_panel_b()}, both_runs AS (SELECT a.grp, a.n, a.pearson AS pearson_a,
    a.spearman AS spearman_a, a.mae AS mae_a, a.bias AS bias_a, b.pearson AS pearson_b, b.spearman AS spearman_b,
    b.mae AS mae_b, b.bias AS bias_b FROM v_metrics a JOIN mb b ON a.grp = b.grp)"""


@query(
    "paired_run_merge",
    f"""{MERGED} SELECT grp, n, {_r([f'{c}_{s}' for s in 'ab' for c in ('pearson', 'spearman', 'mae', 'bias')])},
    {r('pearson_b - pearson_a')} AS d_pearson, {r('spearman_b - spearman_a')} AS d_spearman, {r('mae_b - mae_a')} AS d_mae,
    {r('abs(bias_b) - abs(bias_a)')} AS d_abs_bias FROM both_runs""",
)
def paired_run_merge(spark, sf):
    return rounded(P.paired_run_merge(pred_view(spark, sf), pred_view_b(spark, sf)))


# Thresholds of the demonstration score card.
THRESHOLDS = [
    ("macro_r", "min", 0.90), ("r2_group_pred", "max", 0.05), ("mean_abs_bias", "max", 9.0),
    ("pooled_mae", "max", 8.0), ("n_pos_r", "min", 20.0),
]


def _card_sql():
    rows = ", ".join(f"('{c}', '{rule}', CAST({t} AS DOUBLE))" for c, rule, t in THRESHOLDS)
    values = " UNION ALL ".join(f"SELECT '{c}' AS criterion, CAST({c} AS DOUBLE) AS value FROM summary" for c, _, _ in THRESHOLDS)
    return f"""card AS (SELECT t.criterion, rule, threshold, value,
    CASE WHEN rule = 'min' THEN value >= threshold ELSE value <= threshold END AS pass
    FROM (VALUES {rows}) t(criterion, rule, threshold) JOIN ({values}) v ON t.criterion = v.criterion)"""


def _thresholds(spark):
    return spark.createDataFrame(THRESHOLDS, "criterion string, rule string, threshold double")


@query(
    "gate_scorecard",
    f"""{with_views('v_pred_b')}, {summary_cte('v_pred_b')}, {_card_sql()}
    SELECT criterion, rule, threshold, {r('value')} AS value, pass FROM card""",
)
def gate_scorecard(spark, sf):
    return rounded(P.gate_scorecard(score_run_summary(pred_view_b(spark, sf)), _thresholds(spark)))


@query(
    "gate_verdict",
    f"""{BOTH}, {summary_cte('v_pred_b')}, {_card_sql()},
    {summary_cte('v_pred').replace('p AS', 'p1 AS').replace('FROM p)', 'FROM p1)').replace('k AS (', 'k1 AS (').replace('FROM k ', 'FROM k1 ').replace('FROM k)', 'FROM k1)').replace('g AS (', 'g1 AS (').replace('FROM g)', 'FROM g1)').replace('summary AS (', 'summary_a AS (')},
    v AS (SELECT bool_and(pass) AS all_pass, count(*) FILTER (pass) AS n_pass FROM card),
    t AS (SELECT all_pass, n_pass, all_pass AND abs(b.macro_r - a.macro_r) <= 0.01 AND abs(b.r2_group_pred - a.r2_group_pred) <= 0.01 AS tie
          FROM v, summary b, summary_a a)
    SELECT *, CASE WHEN all_pass AND NOT tie THEN 'candidate' ELSE 'incumbent' END AS "primary" FROM t""",
)
def gate_verdict(spark, sf):
    a, b = score_run_summary(pred_view(spark, sf)), score_run_summary(pred_view_b(spark, sf))
    return P.gate_verdict(P.gate_scorecard(b, _thresholds(spark)), a, b)


COMP = ["mean_part1", "mean_part2", "mean_part3", "sd_part1", "sd_part2", "sd_part3", "mean_total", "sd_total",
        "mean_pred", "sd_pred", "offset", "mae", "share_part1", "share_part2", "share_part3"]
COMP_SQL = """comp AS (SELECT grp, count(*) AS n, avg(part1) AS mean_part1, avg(part2) AS mean_part2, avg(part3) AS mean_part3,
    stddev_samp(part1) AS sd_part1, stddev_samp(part2) AS sd_part2, stddev_samp(part3) AS sd_part3,
    avg(actual) AS mean_total, stddev_samp(actual) AS sd_total, avg(c) AS mean_pred, stddev_samp(c) AS sd_pred,
    avg(c - actual) AS "offset", avg(abs(c - actual)) AS mae, avg(part1) / avg(actual) AS share_part1,
    avg(part2) / avg(actual) AS share_part2, avg(part3) / avg(actual) AS share_part3, avg(covariate) AS mean_covariate,
    count(covariate) AS n_covariate, avg(covariate2) AS mean_covariate2
    FROM (SELECT *, greatest(pred, 0) AS c FROM v_parts) GROUP BY grp)"""


def _rq(cols):
    return ", ".join(f'{r(chr(34) + c + chr(34))} AS "{c}"' for c in cols)


@query("component_summary", f"{PARTS}, {COMP_SQL} SELECT grp, n, {_rq(COMP)} FROM comp")
def component_summary(spark, sf):
    return rounded(P.component_summary(parts_view(spark, sf)))


@query(
    "identity_check",
    f"""{PARTS} SELECT count(*) AS n, count(*) FILTER (abs(actual - part1 - part2 - part3) > 1e-8) AS n_mismatch,
    max(abs(actual - part1 - part2 - part3)) <= 1e-8 AS identity_holds FROM v_parts""",
)
def identity_check(spark, sf):
    return P.identity_check(parts_view(spark, sf))


SHARES = ["var_total", "share_part1", "share_part2", "share_part3", "var_frac_part1", "var_frac_part2", "var_frac_part3"]


def _share_sql(view, scope, group=""):
    parts = ", ".join(f"covar_samp(part{i}, actual) / nullif(var_samp(actual), 0) AS share_part{i}" for i in (1, 2, 3))
    fracs = ", ".join(f"var_samp(part{i}) / nullif(var_samp(actual), 0) AS var_frac_part{i}" for i in (1, 2, 3))
    return f"SELECT {scope} AS scope, var_samp(actual) AS var_total, {parts}, {fracs} FROM {view} {group}"


@query(
    "variance_shares",
    f"""{PARTS}, flat AS (SELECT {', '.join(f'{c} - avg({c}) OVER (PARTITION BY grp) AS {c}' for c in ('part1', 'part2', 'part3', 'actual'))}
    FROM v_parts), per AS ({_share_sql('v_parts', 'grp', 'GROUP BY grp')})
    SELECT scope, {_r(SHARES)} FROM (SELECT * FROM per UNION ALL {_share_sql('v_parts', "'pooled'")}
    UNION ALL {_share_sql('flat', "'within_group'")}
    UNION ALL SELECT 'macro', {', '.join(f'avg({c})' for c in SHARES)} FROM per)""",
)
def variance_shares(spark, sf):
    return rounded(P.variance_shares(parts_view(spark, sf)))


TARGETS = ("part1", "part2", "part3", "actual")
CORR_SQL = f"""base AS (SELECT grp AS scope, part1, part2, part3, actual, greatest(pred, 0) AS c FROM v_parts),
    flat AS (SELECT 'within_group' AS scope, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY scope) AS {c}' for c in (*TARGETS, 'c'))} FROM base),
    every AS (SELECT * FROM base UNION ALL SELECT * REPLACE ('pooled' AS scope) FROM base UNION ALL SELECT * FROM flat),
    rk AS (SELECT *, {q_midrank('scope', 'c')} AS rc, {', '.join(f"{q_midrank('scope', t)} AS r_{t}" for t in TARGETS)} FROM every),
    wide AS (SELECT scope, count(*) AS n, {', '.join(f"{q_corr('c', t)} AS pearson_{t}, {q_corr('rc', 'r_' + t)} AS spearman_{t}" for t in TARGETS)}
    FROM rk GROUP BY scope)"""
CORR_COLS = [f"{k}_{t}" for k in ("pearson", "spearman") for t in TARGETS]


@query("component_correlation", f"{PARTS}, {CORR_SQL} SELECT scope, n, {_r(CORR_COLS, 4)} FROM wide")
def component_correlation(spark, sf):
    return rounded(P.component_correlation(parts_view(spark, sf)), 4)


@query(
    "split_stat_name",
    f"""{PARTS}, {CORR_SQL}, l AS (UNPIVOT (SELECT * FROM wide WHERE scope NOT IN ('pooled', 'within_group')) ON {', '.join(CORR_COLS)}
    INTO NAME name VALUE value) SELECT split_part(name, '_', 1) AS statistic, split_part(name, '_', 2) AS target,
    {r('avg(value)')} AS macro_mean, count(value) AS groups FROM l GROUP BY name""",
)
def split_stat_name(spark, sf):
    return rounded(P.component_correlation_macro(P.component_correlation(parts_view(spark, sf))))


def q_p(z):
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / ({x} * 0.3275911 + 1.0))"
    return (f"(((((1.061405429 * {t} + -1.453152027) * {t} + 1.421413741) * {t} + -0.284496736) * {t} + 0.254829592) * {t}"
            f" * exp(-{x} * {x}))")


def q_corr_p(r_: str, n: str) -> str:
    """The t law with n - 2 degrees of freedom by its finite series."""
    c2 = f"(1 - {r_} * {r_})"
    even = (f"abs({r_}) * list_sum(list_transform(range(({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)"
            f" + k * ln({c2}))))")
    odd = (f"2 / pi() * (asin(abs({r_})) + abs({r_}) * coalesce(list_sum(list_transform(range(({n} - 3) // 2), lambda k: exp(lgamma(k + 1.0::DOUBLE)"
           f" + lgamma(1.5::DOUBLE) - lgamma(k + 1.5::DOUBLE) + (k + 0.5::DOUBLE) * ln({c2})))), 0))")
    return f"CASE WHEN {n} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"


@query(
    "between_within_corr",
    f"""{with_views('v_pred')}, f AS (SELECT actual - avg(actual) OVER (PARTITION BY grp) AS x, pred - avg(pred) OVER (PARTITION BY grp) AS y FROM v_pred),
    m AS (SELECT avg(actual) AS x, avg(pred) AS y FROM v_pred GROUP BY grp),
    l AS (SELECT 'pooled' AS level, count(*) AS n, {q_corr('actual', 'pred')} AS r FROM v_pred
          UNION ALL SELECT 'within', count(*), {q_corr('x', 'y')} FROM f UNION ALL SELECT 'between', count(*), {q_corr('x', 'y')} FROM m)
    SELECT level, n, {r('r')} AS r, {r(q_p('(atanh(r) * sqrt(n - 3))'))} AS p_normal, {r(q_corr_p('r', 'n'))} AS p_value FROM l""",
)
def between_within_corr(spark, sf):
    return rounded(P.between_within_corr(pred_view(spark, sf), "actual", "pred"))


@query(
    "partial_corr",
    f"""{PARTS}, {COMP_SQL}, c AS (SELECT count(*) AS n, {q_corr('"offset"', 'share_part2')} AS xy,
    {q_corr('"offset"', 'mean_total')} AS xz, {q_corr('share_part2', 'mean_total')} AS yz FROM comp)
    SELECT n, {r('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))', 5)} AS partial_r FROM c""",
)
def partial_corr(spark, sf):
    return rounded(P.partial_corr(P.component_summary(parts_view(spark, sf)), "offset", "share_part2", "mean_total"), 5)


@query(
    "fisher_ci",
    f"""{with_views('v_metrics')} SELECT grp, {r('tanh(atanh(pearson) - 1.959963984540054 / sqrt(n - 3))')} AS lo,
    {r('tanh(atanh(pearson) + 1.959963984540054 / sqrt(n - 3))')} AS hi FROM v_metrics""",
)
def fisher_ci(spark, sf):
    from heldout.functions.scalars import fisher_ci as op

    lo, hi = op("pearson", "n")
    return rounded(metrics_panel(pred_view(spark, sf), ["grp"]).select("grp", lo.alias("lo"), hi.alias("hi")))


@query(
    "wilcoxon_signed_rank",
    f"""{MERGED.replace('WITH ', 'WITH RECURSIVE ', 1)}, d AS (SELECT mae_b - mae_a AS d FROM both_runs WHERE mae_b <> mae_a),
    law(i, shares) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT i + 1, list_transform(range(1, len(shares) + i + 2), lambda s:
      (coalesce(shares[s], 0) + CASE WHEN s > i + 1 THEN shares[s - i - 1] ELSE 0 END) / 2) FROM law WHERE i < (SELECT count(*) FROM d)),
    k AS (SELECT d, {q_midrank('', 'abs(d)')} AS rk FROM d),
    w AS (SELECT count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0.0) AS w_plus FROM k),
    t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM d GROUP BY abs(d))),
    z AS (SELECT n, w_plus, (w_plus - n * (n + 1) / 4.0 - sign(w_plus - n * (n + 1) / 4.0) * 0.5)
          / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM w, t)
    SELECT n, w_plus, {r('z')} AS z_normal, {r(q_p('z'))} AS p_normal,
    {r("least(1.0, 2 * list_sum(shares[1:least(w_plus, n * (n + 1) / 2 - w_plus)::INT + 1]))")} AS p_value FROM z JOIN law ON i = n""",
)
def wilcoxon_signed_rank(spark, sf):
    merged = P.paired_run_merge(pred_view(spark, sf), pred_view_b(spark, sf))
    return rounded(P.wilcoxon_signed_rank(merged, "d_mae"))


@query(
    "group_covariates",
    f"""{with_views('v_pred')} SELECT grp, count(*) AS n, {r('avg(pred)')} AS mean_pred, {r('coalesce(stddev_samp(pred), 0)')} AS sd_pred,
    {r('avg(covariate)')} AS mean_covariate, {r('coalesce(stddev_samp(covariate), 0)')} AS sd_covariate,
    {r('avg(ood_score)')} AS mean_ood FROM v_pred GROUP BY grp""",
)
def group_covariates(spark, sf):
    return rounded(P.group_covariates(pred_view(spark, sf)))


OFF = ["offset", "mae", "mean_total", "mean_pred", "mean_part1", "mean_part2", "mean_part3", "share_part1", "share_part2",
       "share_part3", "mean_covariate", "mean_covariate2"]


@query("offset_by_group", f"{PARTS}, {COMP_SQL} SELECT grp, n, n_covariate, {_rq(OFF)} FROM comp")
def offset_by_group(spark, sf):
    return rounded(P.offset_by_group(parts_view(spark, sf)))


TERMS = ("mean_part1", "mean_part2", "mean_part3", "mean_total", "share_part1", "share_part2", "share_part3")


def _terms_sql():
    return " UNION ALL ".join(
        f"SELECT '{k}~{t}' AS term, {e} AS y, round({t}, 9) AS x FROM comp"
        for k, e in (("offset", 'round("offset", 9)'), ("abs_offset", 'round(abs("offset"), 9)'))
        for t in TERMS
    )


@query(
    "offset_correlations",
    f"""{PARTS}, {COMP_SQL}, l AS ({_terms_sql()}), k AS (SELECT *, {q_midrank('term', 'x')} AS rx, {q_midrank('term', 'y')} AS ry FROM l),
    c AS (SELECT term, count(*) AS n_groups, {q_corr('x', 'y')} AS pearson, {q_corr('rx', 'ry')} AS spearman FROM k GROUP BY term)
    SELECT term, n_groups, {r('pearson', 5)} AS pearson, {r('spearman', 5)} AS spearman,
    {r('tanh(atanh(pearson) - 1.959963984540054 / sqrt(n_groups - 3))', 5)} AS fisher_lo,
    {r('tanh(atanh(pearson) + 1.959963984540054 / sqrt(n_groups - 3))', 5)} AS fisher_hi,
    {r(q_p('(atanh(pearson) * sqrt(n_groups - 3))'), 5)} AS p_normal,
    {r(q_corr_p('pearson', 'n_groups'), 5)} AS p_value FROM c""",
)
def offset_correlations(spark, sf):
    groups = rounded(P.component_summary(parts_view(spark, sf)), 9)
    return rounded(P.offset_correlations(groups, TERMS), 5)


@query(
    "published_value_check",
    f"""{with_views('v_metrics')}, s AS (SELECT 'macro_r' AS name, avg(pearson) AS value FROM v_metrics
      UNION ALL SELECT 'macro_mae', avg(mae) FROM v_metrics)
    SELECT e.name, {r('value')} AS value, expected, coalesce(abs(value - expected) <= 0.05, false) AS agrees
    FROM (VALUES ('macro_r', CAST(0.98 AS DOUBLE)), ('macro_mae', CAST(1.0 AS DOUBLE)), ('not_there', CAST(0.0 AS DOUBLE))) e(name, expected)
    LEFT JOIN s ON e.name = s.name""",
)
def published_value_check(spark, sf):
    panel = metrics_panel(pred_view(spark, sf), ["grp"])
    long = panel.agg(F.avg("pearson").alias("macro_r"), F.avg("mae").alias("macro_mae")).unpivot(
        [], ["macro_r", "macro_mae"], "name", "value"
    )
    expected = spark.createDataFrame([("macro_r", 0.98), ("macro_mae", 1.0), ("not_there", 0.0)], "name string, expected double")
    return rounded(P.published_value_check(long, expected, 0.05))


@query(
    "recompute_integrity",
    f"""{with_views('v_metrics')}, s AS (SELECT grp, CASE WHEN grp = 'NATION_5' THEN mae + 1 ELSE mae END AS mae, bias FROM v_metrics WHERE grp <> 'NATION_9')
    SELECT 'mae' AS metric, count(*) AS n, count(*) FILTER (s.mae IS NULL OR abs(v.mae - s.mae) > 1e-10) AS n_mismatch,
    {r('max(abs(v.mae - s.mae))')} AS max_delta FROM v_metrics v LEFT JOIN s ON v.grp = s.grp
    UNION ALL SELECT 'bias', count(*), count(*) FILTER (s.bias IS NULL OR abs(v.bias - s.bias) > 1e-10), {r('max(abs(v.bias - s.bias))')}
    FROM v_metrics v LEFT JOIN s ON v.grp = s.grp""",
)
def recompute_integrity(spark, sf):
    panel = metrics_panel(pred_view(spark, sf), ["grp"]).select("grp", "mae", "bias")
    stored = panel.filter("grp <> 'NATION_9'").withColumn(
        "mae", F.when(F.col("grp") == "NATION_5", F.col("mae") + 1).otherwise(F.col("mae"))
    )
    return rounded(P.recompute_integrity(panel, stored, ["grp"], ["mae", "bias"], 1e-10))


@query(
    "generalization_gradient",
    f"""{with_views('v_long', 'v_samples')}, c AS (SELECT grp, feature, avg(value) AS m FROM v_long GROUP BY grp, feature),
    t AS (SELECT feature, sum(m) AS s, count(*) AS g FROM c GROUP BY feature),
    d AS (SELECT grp, sqrt(sum(pow(m - (s - m) / (g - 1), 2))) AS distance FROM c JOIN t USING (feature) GROUP BY grp),
    p AS (SELECT grp, avg(abs(y - 0.45)) AS mae FROM v_samples GROUP BY grp)
    SELECT count(*) AS groups, {r(q_slope('mae', 'distance'))} AS slope, {r(q_corr('mae', 'distance'))} AS r,
    {r('avg(distance)')} AS mean_distance FROM d JOIN p USING (grp)""",
)
def generalization_gradient(spark, sf):
    from heldout.catalog.base import samples_view

    centroids = long_view(spark, sf).groupBy("grp", "feature").agg(F.avg("value").alias("m"))
    panel = samples_view(spark, sf).groupBy("grp").agg(F.avg(F.abs(F.col("y") - 0.45)).alias("mae"))
    return rounded(P.generalization_gradient(centroids, panel))


@query(
    "group_order_by_median",
    f"{with_views('v_pred')} SELECT grp, {r('quantile_cont(pred, 0.5)')} AS median FROM v_pred GROUP BY grp ORDER BY 2, 1",
)
def group_order_by_median(spark, sf):
    return rounded(P.group_order_by_median(pred_view(spark, sf), "pred"))


@query(
    "histogram_density",
    f"""{with_views('v_pred')}, h AS (SELECT CAST(least(floor((pred - -10) / CAST({50 / 60!r} AS DOUBLE)), 59) AS INTEGER) AS bin, count(*) AS n FROM v_pred
    WHERE pred BETWEEN -10 AND 40 GROUP BY 1) SELECT bin, n, {r(f'n / ((SELECT sum(n) FROM h) * CAST({50 / 60!r} AS DOUBLE))')} AS density FROM h""",
)
def histogram_density(spark, sf):
    return rounded(P.histogram(pred_view(spark, sf), "pred", 60, -10, 40))


@query(
    "hexbin_counts",
    f"""{with_views('v_pred')} SELECT CAST(floor(actual / 2.5) AS BIGINT) AS bx, CAST(floor(pred / 2.5) AS BIGINT) AS "by", count(*) AS n
    FROM v_pred GROUP BY 1, 2""",
)
def hexbin_counts(spark, sf):
    return P.square_bin_counts(pred_view(spark, sf), "actual", "pred", 2.5)


@query("inventory_counts", f"{with_views('v_pred')} SELECT grp, count(*) AS n FROM v_pred GROUP BY grp")
def inventory_counts(spark, sf):
    return pred_view(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query(
    "component_long",
    f"""{PARTS} SELECT id, component, {r('value', 9)} AS value, CAST(substr(component, 5) AS INTEGER) AS component_order
    FROM (UNPIVOT (SELECT id, part1, part2, part3 FROM v_parts) ON part1, part2, part3 INTO NAME component VALUE value)""",
)
def component_long(spark, sf):
    return rounded(P.component_long(parts_view(spark, sf)), 9)


@query("sample_projection_distinct", f"{with_views('v_pred')} SELECT DISTINCT owner, grp FROM v_pred ORDER BY owner, grp")
def sample_projection_distinct(spark, sf):
    return P.sample_projection_distinct(pred_view(spark, sf), ["owner", "grp"])
