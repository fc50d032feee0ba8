"""Permutation, bootstrap, few-shot and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.catalog.base import (
    ORACLES, QUERIES, long_view, orders_view, pred_view, pred_view_b, parts_view, q_corr, q_midrank, q_slope, query, r, rounded, table, with_views,
)
from heldout.catalog.metrics import CENTRED, CUT, PANEL, WIDE_MID, _r, _r2_sql, _wide
from heldout.catalog.ranking import q_key, q_num
from heldout.catalog.reports import COMP_SQL, MERGED
from heldout.functions.scalars import DRAW_RANGE, MIX_STEPS
from heldout.operators import calibration as K
from heldout.operators import gene_sets as G
from heldout.operators import metrics as M
from heldout.operators import reports as P
from heldout.operators import resampling as R

V = with_views("v_pred")
# The counts of the source material: permutations of errors and of ranks, bootstraps of rows, of classes, of groups, few-shot and shrinkage draws.
PERM_MAE, PERM_RHO, BOOT, BOOT_AUC, BOOT_CLUSTER, FEW_DRAWS, EB_DRAWS = 1000, 500, 10_000, 2000, 1000, 200, 1000
#: Replicates of the queries named ``_first20``: the same code as the whole count, which is too long for SQL in one process.
FIRST = 20


def q_mixed(x: str) -> str:
    for factor, shift in MIX_STEPS:
        x = f"list_transform([(({x}) + 1) * {factor} % {DRAW_RANGE}], lambda z: xor(z, z >> {shift}))[1]"
    return x


def q_stratum(seed: int, strata: str = "'all'") -> str:
    return f"{q_num(f'{seed}s', strata)} % {DRAW_RANGE}"


def perm_sql(seed: int, b: int, value: str = "actual", carry: str = "pred", view: str = "v_pred") -> str:
    return f"""base AS (SELECT grp, {carry} AS c, {value} AS v, row_number() OVER (PARTITION BY grp ORDER BY {q_key(f'{seed}a', 'id')}, id) AS rn FROM {view}),
    starts AS (SELECT grp, b, {q_mixed('k + b')} AS h FROM (SELECT DISTINCT grp, {q_stratum(seed, 'grp')} AS k FROM {view}), range(1, {b + 1}) t(b)),
    keyed AS (SELECT b, grp, v, rn AS u, {q_mixed('h + rn')} AS h FROM base JOIN starts USING (grp)),
    donor AS (SELECT b, grp, v, row_number() OVER (PARTITION BY b, grp ORDER BY h, u) AS rn FROM keyed),
    perm AS (SELECT d.b, d.grp, d.v, base.c FROM donor d JOIN base ON d.grp = base.grp AND d.rn = base.rn)"""


@query(
    "permute_within_group",
    f"""{V}, a AS (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY {q_key('7a', 'id')}, id) AS rn FROM v_pred),
    b AS (SELECT grp, actual, row_number() OVER (PARTITION BY grp ORDER BY {q_key('7b', 'id')}, id) AS rn FROM v_pred)
    SELECT a.id, a.grp, {r('b.actual', 9)} AS shuffled FROM a JOIN b ON a.grp = b.grp AND a.rn = b.rn""",
)
def permute_within_group(spark, sf):
    return rounded(R.permute(pred_view(spark, sf), ["grp"], "actual", "shuffled", 7).select("id", "grp", "shuffled"), 9)


@query(
    "null_control_labels",
    f"""{V}, a AS (SELECT id, row_number() OVER (ORDER BY {q_key('3a', 'id')}, id) AS rn FROM v_pred),
    b AS (SELECT actual, row_number() OVER (ORDER BY {q_key('3b', 'id')}, id) AS rn FROM v_pred)
    SELECT a.id, {r('b.actual', 9)} AS actual FROM a JOIN b ON a.rn = b.rn""",
)
def null_control_labels(spark, sf):
    from heldout.operators.model import null_control_labels as op

    return rounded(op(pred_view(spark, sf), "global", 3, "actual").select("id", "actual"), 9)


@query(
    "permutation_test_mae",
    f"""{V}, {perm_sql(31, PERM_MAE)}, n AS (SELECT b, avg(abs(v - c)) AS m FROM perm GROUP BY b),
    o AS (SELECT count(*) AS n, avg(abs(actual - pred)) AS obs FROM v_pred)
    SELECT any_value(o.n) AS n, {r('any_value(obs)')} AS observed_mae, {r('quantile_cont(m, 0.5)')} AS null_median,
    {r('quantile_cont(m, 0.05)')} AS null_q05, {r('(1 + count(*) FILTER (m <= obs)) / (count(*) + 1)')} AS p_value, count(*) AS n_perm FROM n, o""",
)
def permutation_test_mae(spark, sf):
    return rounded(R.permutation_test_mae(pred_view(spark, sf), PERM_MAE, 31))


RANKED = f"ranked AS (SELECT id, grp, {q_midrank('', 'actual')} AS ra, {q_midrank('', 'covariate')} AS rp FROM v_pred)"


@query(
    "permutation_test_spearman",
    f"""{V}, {RANKED}, {perm_sql(32, PERM_RHO, 'ra', 'rp', 'ranked')}, n AS (SELECT b, {q_corr('v', 'c')} AS m FROM perm GROUP BY b),
    o AS (SELECT count(*) AS n, {q_corr('ra', 'rp')} AS obs FROM ranked)
    SELECT any_value(o.n) AS n, {r('any_value(obs)')} AS observed_rho, {r('quantile_cont(m, 0.5)')} AS null_median,
    {r('quantile_cont(m, 0.025)')} AS null_q025, {r('quantile_cont(m, 0.975)')} AS null_q975,
    {r('(1 + count(*) FILTER (abs(m) >= abs(obs))) / (count(*) + 1)')} AS p_value, count(*) AS n_perm FROM n, o""",
)
def permutation_test_spearman(spark, sf):
    df = pred_view(spark, sf).withColumn("pred", F.col("covariate"))
    return rounded(R.permutation_test_spearman(df, PERM_RHO, 32))


@query(
    "shuffled_score_control",
    f"""{V}, a AS (SELECT id, grp, pred, row_number() OVER (PARTITION BY grp ORDER BY {q_key('8a', 'id')}, id) AS rn FROM v_pred),
    b AS (SELECT grp, actual, row_number() OVER (PARTITION BY grp ORDER BY {q_key('8b', 'id')}, id) AS rn FROM v_pred),
    s AS (SELECT pred, b.actual FROM a JOIN b ON a.grp = b.grp AND a.rn = b.rn)
    SELECT count(*) AS n, {r(q_corr('x', 'y'))} AS control_rho FROM (SELECT {q_midrank('', 'pred')} AS x, {q_midrank('', 'actual')} AS y FROM s)""",
)
def shuffled_score_control(spark, sf):
    return rounded(R.shuffled_score_control(pred_view(spark, sf), 8))


def drawn_sql(seed: int, view: str, strata: str, cols: str, b: int, unit: str = "id") -> str:
    """CTEs ending in ``drawn`` with one row per drawn copy (strata of one slice)."""
    part = f"PARTITION BY {strata}" if strata else ""
    keys = ["b"] + ([strata] if strata else [])
    s = f"{strata}, " if strata else ""
    on = " AND ".join([*([f"r.{strata} = p.{strata}"] if strata else []), "r.rn = p.pick"])
    return f"""numbered AS (SELECT {s}{cols}, row_number() OVER ({part} ORDER BY {q_key(seed, unit)}, {unit}) - 1 AS rn, count(*) OVER ({part}) AS n FROM {view}),
    starts AS (SELECT {', '.join(keys)}, n, {q_mixed('k + b')} AS h FROM (SELECT DISTINCT {s}n, {q_stratum(seed, strata or "'all'")} AS k FROM numbered), range(1, {b + 1}) t(b)),
    picks AS (SELECT {', '.join(keys)}, ({q_mixed('h + turn')} * n) >> 31 AS pick FROM (SELECT *, unnest(range(n)) AS turn FROM starts)),
    drawn AS (SELECT {', '.join('p.' + k for k in keys)}, {', '.join('r.' + c.strip() for c in cols.split(','))} FROM picks p JOIN numbered r ON {on})"""


def pairs_sql(b: int) -> str:
    return f"""{V}, {drawn_sql(41, 'v_pred', 'grp', 'actual, pred', b)}, k AS (SELECT *, {q_midrank('b, grp', 'actual')} AS ra, {q_midrank('b, grp', 'pred')} AS rp FROM drawn),
    s AS (SELECT b, grp, {q_corr('actual', 'pred')} AS pearson, {q_corr('ra', 'rp')} AS spearman FROM k GROUP BY b, grp)
    SELECT grp, {r('quantile_cont(pearson, 0.025)')} AS pearson_lo, {r('quantile_cont(pearson, 0.975)')} AS pearson_hi,
    {r('quantile_cont(spearman, 0.025)')} AS spearman_lo, {r('quantile_cont(spearman, 0.975)')} AS spearman_hi, count(pearson) AS n_ok FROM s GROUP BY grp"""


@query("bootstrap_pairs_ci")
def bootstrap_pairs_ci(spark, sf, b=BOOT):
    return rounded(R.bootstrap_pairs_ci(pred_view(spark, sf), b, ["grp"], 41))


@query("bootstrap_pairs_ci_first20", pairs_sql(FIRST))
def bootstrap_pairs_ci_first20(spark, sf):
    return bootstrap_pairs_ci(spark, sf, FIRST)


def counted_ci_sql(name: str, seed: int, strata: str, b: int) -> str:
    """CTEs ending in ``name``: the limits of ``pairs_sql`` by the stratum's number k, from copies counted per row, which holds ten thousand replicates."""
    part = f"PARTITION BY {strata}" if strata else ""
    cov = lambda x, y: f"sum(w * ({x} - m_{x}) * ({y} - m_{y}))"
    corr = ", ".join(f"{cov(x, y)} / nullif(sqrt({cov(x, x)} * {cov(y, y)}), 0) AS {c}" for c, x, y in (("pearson", "actual", "pred"), ("spearman", "ra", "rp")))
    rank = "2 * sum(w) OVER {0} - sum(w) OVER ({0} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    return f"""{name}_n AS (SELECT {q_stratum(seed, strata or "'all'")} AS k, actual, pred, row_number() OVER ({part} ORDER BY {q_key(seed, 'id')}, id) - 1 AS rn,
      count(*) OVER ({part}) AS n, dense_rank() OVER ({part} ORDER BY actual) AS cy, dense_rank() OVER ({part} ORDER BY pred) AS cp FROM v_pred),
    {name}_s AS (SELECT b, k, n, {q_mixed('k + b')} AS h FROM (SELECT DISTINCT k, n FROM {name}_n WHERE n >= 5), range(1, {b + 1}) t(b)),
    {name}_p AS (SELECT b, k, ({q_mixed('h + turn')} * n) >> 31 AS rn FROM (SELECT *, unnest(range(n)) AS turn FROM {name}_s)),
    {name}_w AS (SELECT b, k, rn, count(*) AS w FROM {name}_p GROUP BY ALL),
    {name}_d AS (SELECT (b << 32) | k AS bk, CAST(w AS INTEGER) AS w, CAST(cy AS INTEGER) AS cy, CAST(cp AS INTEGER) AS cp, actual, pred
      FROM {name}_w JOIN {name}_n USING (k, rn)),
    {name}_k AS (SELECT bk, w, actual, pred, CAST({rank.format('by_y')} AS DOUBLE) AS ra, CAST({rank.format('by_p')} AS DOUBLE) AS rp FROM {name}_d
      WINDOW by_y AS (PARTITION BY bk ORDER BY cy), by_p AS (PARTITION BY bk ORDER BY cp)),
    {name}_m AS (SELECT bk, sum(w) AS n, {', '.join(f'sum(w * {v}) / sum(w) AS m_{v}' for v in ('actual', 'pred', 'ra', 'rp'))} FROM {name}_k GROUP BY bk),
    {name}_c AS (SELECT bk & {DRAW_RANGE} AS k, {corr} FROM {name}_k JOIN {name}_m USING (bk) GROUP BY bk),
    {name} AS (SELECT k, {', '.join(f'quantile_cont({c}, {q}) AS {c}_{side}' for c in ('pearson', 'spearman') for side, q in (('lo', 0.025), ('hi', 0.975)))}
      FROM {name}_c GROUP BY k)"""


def panel_sql(b: int) -> str:
    ci, own = ["pearson_lo", "pearson_hi", "spearman_lo", "spearman_hi"], ["within_pearson", "group_r2_pred", "group_r2_actual"]
    return f"""{V}, {counted_ci_sql('ci_g', 41, 'grp', b)}, {counted_ci_sql('ci_a', 41, '', b)},
    own AS (SELECT {q_corr('yc', 'pc')} AS within_pearson, {q_corr('ra', 'rp')} AS within_spearman,
      (SELECT group_r2 FROM ({_r2_sql('pred')})) AS group_r2_pred, (SELECT group_r2 FROM ({_r2_sql('actual')})) AS group_r2_actual
      FROM (SELECT *, {q_midrank('', 'yc')} AS ra, {q_midrank('', 'pc')} AS rp FROM ({CENTRED})))
    SELECT scope, grp, n, {_r(PANEL + WIDE_MID)}, {r('1 - mae / nullif(mae_group_null, 0)')} AS skill_group, {_r(ci)},
    CAST({b} AS INTEGER) AS boot_b, CAST(41 AS INTEGER) AS boot_seed, {_r(own)}, {r('within_spearman', 4)} AS within_spearman
    FROM (SELECT * FROM ({_wide('group', 'grp', 'grp')}) w LEFT JOIN ci_g ON {q_stratum(41, 'w.grp')} = ci_g.k
      UNION ALL SELECT * FROM ({_wide('pooled', '', "'POOLED'")}) LEFT JOIN ci_a ON true) LEFT JOIN own ON scope = 'pooled'"""


@query("group_panel_wide", panel_sql(BOOT))
def group_panel_wide(spark, sf, b=BOOT):
    out = M.group_panel_wide(pred_view(spark, sf), b=b, seed=41)
    return rounded(out.withColumn("within_spearman", F.round("within_spearman", 4)))


@query("group_panel_wide_first20", panel_sql(FIRST))
def group_panel_wide_first20(spark, sf):
    return group_panel_wide(spark, sf, FIRST)


def _r2(v):
    return f"1 - sum(({v} - m_{v}) * ({v} - m_{v})) / (var_pop({v}) * count(*)) AS r2_{v}"


def stratified_sql(b: int) -> str:
    return f"""{with_views('v_pred', 'v_pred_b')}, m AS (SELECT a.id, a.grp, a.actual, a.pred AS pred_a, b.pred AS pred_b FROM v_pred a JOIN v_pred_b b ON a.id = b.id),
    {drawn_sql(42, 'm', 'grp', 'actual, pred_a, pred_b', b)},
    g AS (SELECT *, {', '.join(f'avg({v}) OVER (PARTITION BY b, grp) AS m_{v}' for v in ('actual', 'pred_a', 'pred_b'))} FROM drawn),
    s AS (SELECT b, {', '.join(_r2(v) for v in ('actual', 'pred_a', 'pred_b'))} FROM g GROUP BY b),
    d AS (SELECT *, r2_pred_a - r2_pred_b AS diff, (r2_pred_a - r2_pred_b) / nullif(r2_pred_a - r2_actual, 0) AS removed FROM s)
    SELECT {', '.join(f"{r(f'quantile_cont({c}, {p})', 5)} AS {c}_{n}" for c in ('r2_pred_a', 'r2_pred_b', 'diff', 'removed') for p, n in ((0.025, 'lo'), (0.975, 'hi')))},
    count(*) AS n_ok, {r('2 * least(count(*) FILTER (diff <= 0) / count(*), count(*) FILTER (diff >= 0) / count(*))', 5)} AS p_diff FROM d"""


@query("bootstrap_stratified")
def bootstrap_stratified(spark, sf, b=BOOT):
    return rounded(R.bootstrap_stratified(pred_view(spark, sf), pred_view_b(spark, sf), b, 42), 5)


@query("bootstrap_stratified_first20", stratified_sql(FIRST))
def bootstrap_stratified_first20(spark, sf):
    return bootstrap_stratified(spark, sf, FIRST)


@query(
    "bootstrap_auc_by_class",
    f"""{V}, c AS (SELECT *, CAST(actual >= {CUT} AS INTEGER) AS cls FROM v_pred), {drawn_sql(43, 'c', 'cls', 'pred', BOOT_AUC)},
    k AS (SELECT *, {q_midrank('b', 'pred')} AS rk FROM drawn),
    s AS (SELECT b, (sum(rk) FILTER (cls = 1) - count(*) FILTER (cls = 1) * (count(*) FILTER (cls = 1) + 1) / 2.0)
      / (count(*) FILTER (cls = 1) * count(*) FILTER (cls = 0)) AS auc FROM k GROUP BY b)
    SELECT {r('quantile_cont(auc, 0.025)')} AS auc_lo, {r('quantile_cont(auc, 0.975)')} AS auc_hi, count(auc) AS n_ok FROM s""",
)
def bootstrap_auc_by_class(spark, sf):
    return rounded(R.bootstrap_auc_by_class(pred_view(spark, sf), "pred", F.col("actual") >= CUT, BOOT_AUC, 43))


@query(
    "bootstrap_group_means",
    f"""{MERGED}, g AS (SELECT grp AS id, mae_b - mae_a AS d_mae FROM both_runs), {drawn_sql(44, 'g', '', 'd_mae', BOOT)},
    s AS (SELECT b, avg(d_mae) AS m FROM drawn GROUP BY b)
    SELECT {r('quantile_cont(m, 0.025)')} AS mean_lo, {r('quantile_cont(m, 0.975)')} AS mean_hi, count(m) AS n_ok FROM s""",
)
def bootstrap_group_means(spark, sf):
    merged = P.paired_run_merge(pred_view(spark, sf), pred_view_b(spark, sf))
    return rounded(R.bootstrap_group_means(merged, "d_mae", BOOT, 44))


def _cluster_r2(v):
    return f"1 - sum(w_{v}) / (sum(q_{v}) - sum(s_{v}) * sum(s_{v}) / sum(n_rows)) AS r2_{v}"


@query(
    "bootstrap_cluster",
    f"""{V}, c AS (SELECT grp, actual - (SELECT avg(actual) FROM v_pred) AS actual, pred - (SELECT avg(pred) FROM v_pred) AS pred FROM v_pred),
    g AS (SELECT grp AS id, count(*) AS n_rows, {', '.join(f'sum({v}) AS s_{v}, sum({v} * {v}) AS q_{v}, sum({v} * {v}) - sum({v}) * sum({v}) / count(*) AS w_{v}' for v in ('actual', 'pred'))}
      FROM c GROUP BY grp), {drawn_sql(45, 'g', '', 'n_rows, s_actual, q_actual, w_actual, s_pred, q_pred, w_pred', BOOT_CLUSTER)},
    s AS (SELECT b, {_cluster_r2('actual')}, {_cluster_r2('pred')} FROM drawn GROUP BY b)
    SELECT {r('quantile_cont(r2_actual, 0.025)', 5)} AS actual_lo, {r('quantile_cont(r2_actual, 0.975)', 5)} AS actual_hi,
    {r('quantile_cont(r2_pred, 0.025)', 5)} AS pred_lo, {r('quantile_cont(r2_pred, 0.975)', 5)} AS pred_hi, count(*) AS n_ok FROM s""",
)
def bootstrap_cluster(spark, sf):
    return rounded(R.bootstrap_cluster(pred_view(spark, sf), ["actual", "pred"], BOOT_CLUSTER, 45), 5)


# --- few-shot and shrinkage -------------------------------------------------------------------------------

KS = (3, 10)


def few_sql(seed: int, min_eval: int, prior: bool = False) -> str:
    b = EB_DRAWS if prior else FEW_DRAWS
    pri = ""
    cols = ""
    join = ""
    if prior:
        pri = """st AS (SELECT grp, count(*) AS n, avg(r) AS rbar, var_samp(r) AS s2, avg(actual) AS ybar, var_samp(actual) AS s2y FROM base GROUP BY grp),
        prior AS (SELECT a.grp, avg(b.rbar) AS mu0, avg(b.s2) AS sigma2, var_samp(b.rbar) AS tau2_raw, greatest(0, var_samp(b.rbar) - avg(b.s2 / b.n)) AS tau2,
          avg(b.ybar) AS mu0_y, avg(b.s2y) AS sigma2_y, var_samp(b.ybar) AS tau2_y_raw, greatest(0, var_samp(b.ybar) - avg(b.s2y / b.n)) AS tau2_y, count(*) AS n_others
          FROM st a JOIN st b ON a.grp <> b.grp GROUP BY a.grp),"""
        join = "JOIN prior USING (grp)"
        w = {n: f"({t} / ({t} + {s} / k))" for n, t, s in (("w", "tau2", "sigma2"), ("w_u", "tau2_raw", "sigma2"), ("w_y", "tau2_y", "sigma2_y"))}
        cols = (f", {w['w']} AS w, {w['w_u']} AS w_u, {w['w_y']} AS w_y, {w['w']} * c_raw + (1 - {w['w']}) * mu0 AS c_shrunk, "
                f"{w['w_u']} * c_raw + (1 - {w['w_u']}) * mu0 AS c_shrunk_raw_tau, {w['w_y']} * y_raw + (1 - {w['w_y']}) * mu0_y AS y_shrunk")
    more = (", avg(abs(r - c_shrunk)) AS mae_c_shrunk, avg(abs(r - c_shrunk_raw_tau)) AS mae_c_shrunk_raw_tau, avg(abs(actual - y_shrunk)) AS mae_y_shrunk, "
            "any_value(w) AS w, any_value(w_u) AS w_u, any_value(w_y) AS w_y, abs(any_value(c_shrunk) - any_value(o)) AS offset_error_shrunk") if prior else ""
    return f"""base AS (SELECT id, grp, actual, pred - actual AS r, row_number() OVER (PARTITION BY grp ORDER BY {q_key(f'{seed}a', 'id')}, id) AS u FROM v_pred), {pri}
    whole AS (SELECT grp, count(*) AS n, avg(r) AS o, avg(actual) AS m FROM base GROUP BY grp),
    starts AS (SELECT grp, n, o, m, b, {q_mixed('k + b')} AS h FROM (SELECT *, {q_stratum(seed, 'grp')} AS k FROM whole), range(1, {b + 1}) t(b)),
    keyed AS (SELECT b, base.*, n, o, m, {q_mixed('h + u')} AS h FROM base JOIN starts USING (grp)),
    ordered AS (SELECT * EXCLUDE (h), row_number() OVER (PARTITION BY b, grp ORDER BY h, u) AS rn FROM keyed),
    ks AS (SELECT unnest([{', '.join(map(str, KS))}]) AS k),
    est0 AS (SELECT grp, k, b, avg(r) AS c_raw, avg(actual) AS y_raw FROM ordered, ks WHERE rn <= k AND n - k >= {min_eval} GROUP BY ALL),
    est AS (SELECT est0.*{cols} FROM est0 {join}),
    draws AS (SELECT grp, k, b, any_value(n) AS n, count(*) AS n_eval, any_value(o) AS "offset", avg(abs(r)) AS mae_uncorrected, avg(abs(r - o)) AS mae_oracle,
      avg(abs(actual - m)) AS mae_null_oracle, avg(r) AS offset_eval, avg(abs(r - c_raw)) AS mae_c_raw, avg(abs(actual - y_raw)) AS mae_y_raw,
      abs(any_value(c_raw) - any_value(o)) AS offset_error {more} FROM ordered JOIN est USING (grp, b) WHERE rn > k GROUP BY ALL)"""


FEW = """few AS (SELECT grp, k, max(n) AS n, max(n_eval) AS n_eval, avg(mae_uncorrected) AS model_uncorrected, avg(mae_c_raw) AS model_fewshot,
    stddev_samp(mae_c_raw) AS model_fewshot_sd, avg(mae_oracle) AS model_oracle, avg(mae_y_raw) AS null_fewshot, avg(mae_null_oracle) AS null_oracle,
    avg(offset_error) AS offset_error, stddev_samp(offset_error) AS offset_error_sd FROM draws GROUP BY grp, k)"""
FEW_COLS = ["model_uncorrected", "model_fewshot", "model_fewshot_sd", "model_oracle", "null_fewshot", "null_oracle", "offset_error", "offset_error_sd"]


def _cols(cols, d=6):
    return ", ".join(f'{r(chr(34) + c + chr(34), d)} AS "{c}"' for c in cols)


@query("fewshot_offset", f"{V}, {few_sql(51, 10)}, {FEW} SELECT grp, k, n, n_eval, {_cols(FEW_COLS)} FROM few")
def fewshot_offset(spark, sf):
    return rounded(K.fewshot_offset(pred_view(spark, sf), KS, FEW_DRAWS, 51))


@query(
    "fewshot_macro",
    f"""{V}, {few_sql(51, 10)}, {FEW} SELECT k, count(*) AS groups, {', '.join(f"{r(f'avg({c})')} AS {c}" for c in FEW_COLS if c != 'model_fewshot_sd')},
    count(*) FILTER (model_fewshot < model_uncorrected) AS n_helped, count(*) FILTER (model_fewshot < null_fewshot) AS n_beats_null FROM few GROUP BY k""",
)
def fewshot_macro(spark, sf):
    return rounded(K.fewshot_macro(K.fewshot_offset(pred_view(spark, sf), KS, FEW_DRAWS, 51)))


@query(
    "calibration_curve",
    f"""{V}, {few_sql(52, 1)}, {FEW} SELECT grp, k, {r('model_fewshot')} AS mae, {r('model_fewshot_sd')} AS mae_sd, n_eval FROM few WHERE n >= 20
    UNION ALL SELECT grp, 0, {r('avg(abs(pred - actual))')}, NULL, count(*) FROM v_pred GROUP BY grp HAVING count(*) >= 20""",
)
def calibration_curve(spark, sf):
    return rounded(K.calibration_curve(pred_view(spark, sf), KS, FEW_DRAWS, 52))


PRIOR_COLS = ["mu0", "sigma2", "tau2_raw", "tau2", "mu0_y", "sigma2_y", "tau2_y_raw", "tau2_y"]


@query("eb_shrinkage_priors", f"{V}, {few_sql(53, 10, True)} SELECT grp, n_others, {_cols(PRIOR_COLS)} FROM prior")
def eb_shrinkage_priors(spark, sf):
    return rounded(K.shrinkage_priors(pred_view(spark, sf)))


EB = f"""eb AS (SELECT grp, k, max(n) AS n, max(w) AS w, max(w_u) AS w_raw_tau, max(w_y) AS w_y, max("offset") AS "offset", avg(offset_eval) AS offset_eval,
    avg(mae_uncorrected) AS m1, avg(mae_c_raw) AS m2, avg(mae_c_shrunk) AS m3, avg(mae_c_shrunk_raw_tau) AS m3_raw_tau, avg(mae_oracle) AS m4, avg(mae_y_raw) AS m5,
    avg(mae_y_shrunk) AS m6, avg(offset_error) AS err_unshrunk, avg(offset_error_shrunk) AS err_shrunk,
    avg(CAST(mae_c_shrunk < mae_uncorrected - {K.TIE} AS INTEGER)) AS share_m3_lt_m1, avg(CAST(mae_c_shrunk < mae_c_raw - {K.TIE} AS INTEGER)) AS share_m3_lt_m2,
    avg(CAST(mae_c_shrunk < mae_y_raw - {K.TIE} AS INTEGER)) AS share_m3_lt_m5, avg(CAST(mae_c_shrunk < mae_y_shrunk - {K.TIE} AS INTEGER)) AS share_m3_lt_m6,
    CASE WHEN abs(max("offset")) < 2 THEN 'small' WHEN abs(max("offset")) < 5 THEN 'moderate' ELSE 'large' END AS offset_stratum FROM draws GROUP BY grp, k)"""
EB_COLS = ["w", "w_raw_tau", "w_y", "offset", "offset_eval", "m1", "m2", "m3", "m3_raw_tau", "m4", "m5", "m6", "err_unshrunk", "err_shrunk",
           "share_m3_lt_m1", "share_m3_lt_m2", "share_m3_lt_m5", "share_m3_lt_m6"]


@query("eb_shrinkage_offset", f"{V}, {few_sql(53, 10, True)}, {EB} SELECT grp, k, n, offset_stratum, {_cols(EB_COLS)} FROM eb")
def eb_shrinkage_offset(spark, sf):
    return rounded(K.eb_shrinkage_by_group(K.eb_shrinkage_draws(pred_view(spark, sf), KS, EB_DRAWS, 53)))


def macro_sql(keys):
    return f"""SELECT {keys}, count(*) AS groups, {', '.join(f"{r(f'avg({c})')} AS {c}" for c in ('m1', 'm2', 'm3', 'm3_raw_tau', 'm4', 'm5', 'm6'))},
    {r('avg(w)')} AS mean_w, {r('avg(err_shrunk)')} AS err_shrunk, {r('avg(err_unshrunk)')} AS err_unshrunk, count(*) FILTER (m3 < m1) AS n_helped,
    count(*) FILTER (m2 < m1) AS n_helped_unshrunk, count(*) FILTER (m3 < m5) AS n_beats_flat_null, count(*) FILTER (m3 < m6) AS n_beats_shrunk_null,
    {r('(avg(m1) - avg(m3)) / nullif(avg(m1) - avg(m4), 0)')} AS oracle_gain, {r('(avg(m1) - avg(m2)) / nullif(avg(m1) - avg(m4), 0)')} AS oracle_gain_unshrunk
    FROM eb GROUP BY {keys}"""


@query("eb_shrinkage_macro", f"{V}, {few_sql(53, 10, True)}, {EB} {macro_sql('k')}")
def eb_shrinkage_macro(spark, sf):
    return rounded(K.eb_shrinkage_macro(K.eb_shrinkage_by_group(K.eb_shrinkage_draws(pred_view(spark, sf), KS, EB_DRAWS, 53))))


@query("offset_stratum", f"{V}, {few_sql(53, 10, True)}, {EB} {macro_sql('offset_stratum, k')}")
def offset_stratum(spark, sf):
    by = K.eb_shrinkage_by_group(K.eb_shrinkage_draws(pred_view(spark, sf), KS, EB_DRAWS, 53))
    return rounded(K.eb_shrinkage_macro(by, ["offset_stratum", "k"]))


@query(
    "eb_draw_distribution",
    f"""{V}, {few_sql(53, 10, True)}, d AS (SELECT grp, k, 'm1_minus_m3' AS delta, mae_uncorrected - mae_c_shrunk AS v FROM draws
      UNION ALL SELECT grp, k, 'm2_minus_m3', mae_c_raw - mae_c_shrunk FROM draws), w AS (SELECT * FROM d UNION ALL SELECT * REPLACE ('ALL' AS grp) FROM d)
    SELECT grp, k, delta, count(*) AS n_draws, {', '.join(f"{r(f'quantile_cont(v, {p})')} AS {n}" for n, p in K.DRAW_QUANTILES.items())} FROM w GROUP BY grp, k, delta""",
)
def eb_draw_distribution(spark, sf):
    return rounded(K.eb_draw_distribution(K.eb_shrinkage_draws(pred_view(spark, sf), KS, EB_DRAWS, 53)))


# --- group calibrator, percentile maps --------------------------------------------------------------------

CALIB = f"""g AS (SELECT grp, avg(pred - actual) AS o, avg(pred) AS x FROM v_pred GROUP BY grp),
    f AS (SELECT a.grp, any_value(a.o) AS o, any_value(a.x) AS x, {q_slope('b.o', 'b.x')} AS slope, avg(b.o) AS bo, avg(b.x) AS bx FROM g a JOIN g b ON a.grp <> b.grp GROUP BY a.grp),
    loto AS (SELECT grp, o AS "offset", bo + slope * (x - bx) AS predicted, (SELECT avg(o) FROM g) AS naive FROM f)"""


def _group_table(spark, sf):
    df = pred_view(spark, sf)
    offsets = df.groupBy("grp").agg(F.avg(F.col("pred") - F.col("actual")).alias("offset"))
    return P.group_covariates(df).join(offsets, "grp")


@query("group_offset_calibrator", f"""{V}, {CALIB} SELECT grp, {_cols(['offset', 'predicted', 'naive'])} FROM loto""")
def group_offset_calibrator(spark, sf):
    return rounded(K.group_offset_calibrator(_group_table(spark, sf), ["mean_pred"]))


@query(
    "group_offset_summary",
    f"""{V}, {CALIB} SELECT count(*) AS groups, {r('avg(abs("offset" - predicted))')} AS loto_mae, {r('avg(abs("offset" - naive))')} AS naive_mae,
    {r('1 - sum(("offset" - predicted) * ("offset" - predicted)) / (var_pop("offset") * count(*))')} AS loto_r2 FROM loto""",
)
def group_offset_summary(spark, sf):
    return rounded(K.group_offset_summary(K.group_offset_calibrator(_group_table(spark, sf), ["mean_pred"])))


@query("group_offset_multi")
def group_offset_multi(spark, sf):
    """No SQL for a four-covariate fit per left-out group; tested against least squares on a fixture."""
    cov = ["mean_pred", "sd_pred", "mean_covariate", "mean_ood"]
    return rounded(K.group_offset_calibrator(_group_table(spark, sf), cov))


@query("ols_nested")
def ols_nested(spark, sf):
    """No SQL for a multiple regression; tested against least squares on a fixture."""
    groups = P.component_summary(parts_view(spark, sf))
    models = [["mean_total"], ["mean_part1", "mean_part2"], ["mean_total", "share_part1", "share_part2"]]
    return rounded(K.ols_nested(groups, "offset", models))


QT = f"""qt AS (SELECT id, grp, pred, ({q_midrank('grp', 'actual')} - 0.5) / count(*) OVER (PARTITION BY grp) AS q FROM v_pred),
    gm AS (SELECT grp, avg(pred) AS x, avg(q) AS q, avg(pred * pred) AS xx, avg(pred * q) AS xq FROM qt GROUP BY grp),
    ln AS (SELECT a.grp, (avg(b.xq) - avg(b.x) * avg(b.q)) / (avg(b.xx) - avg(b.x) * avg(b.x)) AS s, avg(b.q) AS mq, avg(b.x) AS mx FROM gm a JOIN gm b ON a.grp <> b.grp GROUP BY a.grp),
    qh AS (SELECT id, qt.grp, q, least(greatest(mq - s * mx + s * pred, 0), 1) AS q_hat FROM qt JOIN ln ON qt.grp = ln.grp)"""


@query("percentile_map_linear", f"{V}, {QT} SELECT id, grp, {r('q')} AS q_true, {r('q_hat')} AS q_hat FROM qh")
def percentile_map_linear(spark, sf):
    return rounded(K.percentile_map_linear(pred_view(spark, sf)).select("id", "grp", "q_true", "q_hat"))


@query("percentile_map_isotonic")
def percentile_map_isotonic(spark, sf):
    """No SQL: iterative."""
    return rounded(K.percentile_map_isotonic(pred_view(spark, sf)).select("id", "grp", "q_true", "q_hat"))


#: Newton steps that the SQL writes out.
SQL_STEPS = 12


def logistic_sql() -> str:
    steps = ["b0 AS (SELECT DISTINCT grp, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM ev)"]
    for k in range(1, SQL_STEPS + 1):
        steps.append(f"""b{k} AS (SELECT grp, a + (hxx * g0 - hx * g1) / (h * hxx - hx * hx) AS a, b + (h * g1 - hx * g0) / (h * hxx - hx * hx) AS b FROM (
          SELECT f.grp, any_value(a) AS a, any_value(b) AS b, sum(w * (e - mu)) AS g0, sum(w * (e - mu) * x) AS g1, sum(w * mu * (1 - mu)) AS h,
            sum(w * mu * (1 - mu) * x) AS hx, sum(w * mu * (1 - mu) * x * x) AS hxx
          FROM (SELECT f.grp, a, b, e, x, w, 1 / (1 + exp(-(a + b * x))) AS mu FROM ev JOIN b{k - 1} f ON ev.grp <> f.grp) f GROUP BY f.grp))""")
    return f"""{V}, {QT}, ev AS (SELECT id, qt.grp, q, CAST(q > 0.75 AS DOUBLE) AS e, (pred - m) / s AS x, 1.0::DOUBLE / n AS w FROM qt
      JOIN (SELECT grp, count(*) AS n FROM qt GROUP BY grp) c ON qt.grp = c.grp, (SELECT avg(pred) AS m, stddev_pop(pred) AS s FROM qt)),
    {', '.join(steps)}
    SELECT id, ev.grp, e AS event, {r('1 / (1 + exp(-(a + b * x)))', 4)} AS p_hat FROM ev JOIN b{SQL_STEPS} f ON ev.grp = f.grp"""


@query("percentile_map_logistic", logistic_sql())
def percentile_map_logistic(spark, sf):
    return rounded(K.percentile_map_logistic(pred_view(spark, sf)).select("id", "grp", "event", "p_hat"), 4)


# The names under which the whole counts were registered first.
for _name in (
    "permutation_test_mae", "permutation_test_spearman", "bootstrap_pairs_ci", "bootstrap_stratified", "bootstrap_auc_by_class", "bootstrap_group_means",
    "bootstrap_cluster", "fewshot_macro", "calibration_curve", "eb_shrinkage_offset", "eb_shrinkage_macro", "offset_stratum", "eb_draw_distribution",
):
    query(f"{_name}_full", ORACLES.get(_name))(QUERIES[_name])


# --- gene sets --------------------------------------------------------------------------------------------


def gene_sets(spark, sf):
    """Features 0-15 positive and 16-31 negative, taken from the matrix itself."""
    f = long_view(spark, sf).select("feature").distinct()
    name = F.when(F.col("feature") < "f16", "positive").when(F.col("feature") < "f32", "negative")
    return f.select(name.alias("set_name"), "feature").filter("set_name IS NOT NULL")


@query(
    "ssgsea_score",
    f"""{with_views('v_long')}, k AS (SELECT id, feature, {q_midrank('id', 'value')} AS rk, row_number() OVER (PARTITION BY id ORDER BY value DESC, feature) AS pos,
      count(*) OVER (PARTITION BY id) AS n FROM v_long),
    w AS (SELECT id, s, sum(CASE WHEN m THEN pow(rk, 0.25) ELSE 0 END) OVER o / sum(CASE WHEN m THEN pow(rk, 0.25) ELSE 0 END) OVER t
      - sum(CASE WHEN m THEN 0 ELSE 1 END) OVER o / sum(CASE WHEN m THEN 0 ELSE 1 END) OVER t AS walk
      FROM (SELECT k.*, s, CASE s WHEN 'positive' THEN feature < 'f16' ELSE feature >= 'f16' AND feature < 'f32' END AS m FROM k, (VALUES ('positive'), ('negative')) v(s))
      WINDOW o AS (PARTITION BY id, s ORDER BY pos), t AS (PARTITION BY id, s)),
    e AS (SELECT id, sum(walk) FILTER (s = 'positive') AS p, sum(walk) FILTER (s = 'negative') AS q FROM w GROUP BY id)
    SELECT id, {r('p')} AS positive, {r('q')} AS negative, {r('p - q')} AS difference FROM e""",
)
def ssgsea_score(spark, sf):
    return rounded(G.ssgsea_difference(G.ssgsea(long_view(spark, sf), gene_sets(spark, sf)), "positive", "negative"))


@query(
    "resolve_gene_ids",
    """SELECT p_partkey, CASE WHEN p_partkey % 70 = 3 THEN ' ' WHEN p_partkey % 50 = 0 THEN '?|' || p_partkey ELSE 'G' || p_partkey || '|' || p_partkey END AS raw_id,
    'compound' AS id_type, CASE WHEN p_partkey % 70 = 3 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS gene_id, p_partkey % 70 <> 3 AS valid FROM part""",
)
def resolve_gene_ids(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 70 == 3, " ").when(k % 50 == 0, F.concat(F.lit("?|"), k)).otherwise(F.concat(F.lit("G"), k, F.lit("|"), k))
    return G.resolve_gene_ids(table(spark, sf, "part").select("p_partkey", raw.alias("raw_id")))


@query("gene_id_duplicates", "SELECT 'ENSG' || (p_partkey % 97) AS gene_id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def gene_id_duplicates(spark, sf):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("ENSG"), k % 97, F.lit("."), k % 5)
    return G.gene_id_duplicates(G.resolve_gene_ids(table(spark, sf, "part").select("p_partkey", raw.alias("raw_id"))))


@query(
    "gene_row_audit",
    """SELECT vec_id, CASE WHEN vec_id % 20 = 1 THEN 'invalid_gene_id' WHEN vec_id % 20 = 2 THEN 'missing_or_nonfinite' WHEN vec_id % 20 = 3 THEN 'constant'
    ELSE 'retained' END AS status FROM embeddings""",
)
def gene_row_audit(spark, sf):
    v = F.col("vec_id") % 20
    x = F.col("embedding")
    spoiled = F.transform(x, lambda e, i: F.when((v == 2) & (i == 3), F.lit(float("nan"))).when(v == 3, F.element_at(x, 1)).otherwise(e))
    df = table(spark, sf, "embeddings").select("vec_id", spoiled.alias("x"), (v != 1).alias("valid"))
    return G.gene_row_audit(df).select("vec_id", "status")
