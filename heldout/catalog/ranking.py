"""Ordered, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.catalog.base import (
    LOCKED_SQL, VIEWS, parts_view, pred_view, pred_view_b, q_corr, q_midrank, query, r, rounded, table, with_views,
)
from heldout.functions.scalars import (
    QNORM_A, QNORM_B, QNORM_C, QNORM_D, QNORM_LOW, draw_key, draw_number,
)
from heldout.operators import ranking as R
from heldout.operators.metrics import metrics_panel
from heldout.plans.skew import attach, midrank, min_rank, number_rows, order_statistic, quantiles


def _poly_sql(coefs, x):
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + CAST({c!r} AS DOUBLE))"
    return acc


def q_norm(p: str) -> str:
    """Normal quantile in SQL with the same published coefficients."""
    def f(coefs, x):
        return _poly_sql([*coefs], x).replace(repr(coefs[0]), f"CAST({coefs[0]!r} AS DOUBLE)", 1)

    q = f"({p} - 0.5)"
    qq = f"({q} * {q})"
    centre = f"{f(QNORM_A, qq)} * {q} / ({f(QNORM_B, qq)} * {qq} + 1.0)"
    lo, hi = f"sqrt(ln({p}) * -2.0)", f"sqrt(ln(1.0 - {p}) * -2.0)"
    low = f"{f(QNORM_C, lo)} / ({f(QNORM_D, lo)} * {lo} + 1.0)"
    high = f"-{f(QNORM_C, hi)} / ({f(QNORM_D, hi)} * {hi} + 1.0)"
    return f"CASE WHEN {p} < {QNORM_LOW} THEN {low} WHEN {p} <= {1 - QNORM_LOW} THEN {centre} ELSE {high} END"


def q_key(seed, *ids):
    return "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"CAST({i} AS VARCHAR)" for i in ids) + "))"


def q_num(seed, *ids):
    return f"CAST(CAST('0x' || substr({q_key(seed, *ids)}, 1, 8) AS UBIGINT) AS BIGINT)"


P = with_views("v_pred")


@query("midrank", f"{P} SELECT id, grp, {q_midrank('grp', 'covariate')} AS rk FROM v_pred")
def _midrank(spark, sf):
    return midrank(pred_view(spark, sf), ["grp"], "covariate", "rk").select("id", "grp", "rk")


@query("midrank_global", f"{P} SELECT id, {q_midrank('', 'covariate')} AS rk FROM v_pred")
def _midrank_global(spark, sf):
    return midrank(pred_view(spark, sf), [], "covariate", "rk").select("id", "rk")


@query(
    "within_group_percentile",
    f"{P} SELECT id, {r('(' + q_midrank('grp', 'actual') + ' - 0.5) / count(*) OVER (PARTITION BY grp)')} AS q FROM v_pred",
)
def within_group_percentile(spark, sf):
    return rounded(R.within_group_percentile(pred_view(spark, sf), ["grp"], "actual", "q").select("id", "q"))


@query(
    "relative_target_centered",
    f"{P} SELECT id, {r('actual - avg(actual) OVER (PARTITION BY grp)')} AS target FROM v_pred",
)
def relative_target_centered(spark, sf):
    return rounded(R.relative_target(pred_view(spark, sf)).select("id", "target"))


@query(
    "relative_target",
    f"""{P}, k AS (SELECT id, ({q_midrank('grp', 'actual')} - 0.5) / count(*) OVER (PARTITION BY grp) AS p,
    min(actual) OVER (PARTITION BY grp) = max(actual) OVER (PARTITION BY grp) AS const FROM v_pred)
    SELECT id, CASE WHEN const THEN 0.0 ELSE {r(q_norm('p'))} END AS target FROM k""",
)
def relative_target(spark, sf):
    return rounded(R.relative_target(pred_view(spark, sf), "normal_score").select("id", "target"))


@query(
    "within_group_zscore",
    f"""{P} SELECT id, {r('coalesce((actual - avg(actual) OVER (PARTITION BY grp)) / nullif(stddev_samp(actual) OVER (PARTITION BY grp), 0), 0)')}
    AS z FROM v_pred""",
)
def within_group_zscore(spark, sf):
    return rounded(R.within_group_zscore(pred_view(spark, sf)).select("id", "z"))


@query("group_center", f"{P} SELECT id, {r('pred - avg(pred) OVER (PARTITION BY grp)')} AS centred FROM v_pred")
def group_center(spark, sf):
    return rounded(R.group_center(pred_view(spark, sf), value="pred").select("id", "centred"))


@query(
    "gather_by_label",
    f"{P} SELECT id, grp, {r('max(pred) OVER (PARTITION BY grp)')} AS group_max FROM v_pred",
)
def gather_by_label(spark, sf):
    df = pred_view(spark, sf)
    stats = df.groupBy("grp").agg(F.max("pred").alias("group_max"))
    return rounded(R.gather_by_label(df, stats).select("id", "grp", "group_max"))


@query(
    "group_weights",
    f"""{P}, g AS (SELECT grp, count(*) AS n FROM v_pred GROUP BY grp)
    SELECT id, {r('(SELECT sum(n) FROM g) / (n * (SELECT count(*) FROM g))')} AS weight FROM v_pred JOIN g USING (grp)""",
)
def group_weights(spark, sf):
    return rounded(R.group_weights(pred_view(spark, sf)).select("id", "weight"))


@query(
    "group_quantile_flag",
    f"{P} SELECT id, actual > quantile_cont(actual, 0.75) OVER (PARTITION BY grp) AS high FROM v_pred",
)
def group_quantile_flag(spark, sf):
    return R.group_quantile_flag(pred_view(spark, sf)).select("id", "high")


@query("group_fold_id", f"{P} SELECT id, dense_rank() OVER (ORDER BY grp) AS fold FROM v_pred")
def group_fold_id(spark, sf):
    return R.group_fold_id(pred_view(spark, sf)).select("id", "fold")


def q_dealt(seed, view="v_pred", part="grp"):
    return f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {q_key(seed, 'id')}, id) AS rn, count(*) OVER (PARTITION BY {part}) AS n FROM {view}"


@query("stratified_folds", f"{P} SELECT id, (rn - 1) % 5 + 1 AS fold FROM ({q_dealt(11)})")
def stratified_folds(spark, sf):
    return R.stratified_folds(pred_view(spark, sf), 5, seed=11).select("id", "fold")


@query(
    "stratified_holdout",
    f"{P} SELECT id, rn <= greatest(1, floor(0.2 * n)) AS holdout FROM ({q_dealt(12)})",
)
def stratified_holdout(spark, sf):
    return R.stratified_holdout(pred_view(spark, sf), seed=12).select("id", "holdout")


@query(
    "limit_per_group",
    f"""{P}, u AS (SELECT grp, owner, row_number() OVER (PARTITION BY grp ORDER BY owner) AS rn
    FROM (SELECT DISTINCT grp, owner FROM v_pred)) SELECT id, v_pred.grp, v_pred.owner FROM v_pred JOIN u
    ON v_pred.grp = u.grp AND v_pred.owner = u.owner WHERE rn <= 3""",
)
def limit_per_group(spark, sf):
    return R.limit_per_group(pred_view(spark, sf), 3, "owner", "grp").select("id", "grp", "owner")


@query("cap_sample", f"{P} SELECT id, grp FROM v_pred ORDER BY {q_key(5, 'id')}, id LIMIT 500")
def cap_sample(spark, sf):
    return R.cap_sample(pred_view(spark, sf), 500, seed=5).select("id", "grp")


IDS = [42, 7, 999999999, 13, 7, 100]


@query(
    "select_ids_ordered",
    f"{P} SELECT CAST(p.pos AS INTEGER) AS request_pos, p.id, grp FROM (VALUES (0, 42), (1, 7), (2, 999999999), (3, 13), (4, 100)) p(pos, id) LEFT JOIN v_pred ON v_pred.id = p.id",
)
def select_ids_ordered(spark, sf):
    found, gone = R.select_ids_ordered(pred_view(spark, sf), IDS)
    return found.select("request_pos", "id", "grp").unionByName(gone.select("request_pos", "id"), allowMissingColumns=True)


KNOTS = f"""s AS (SELECT pred, row_number() OVER (ORDER BY pred) AS i, count(*) OVER () AS n FROM v_pred),
    sel AS (SELECT DISTINCT CAST(round_even(1 + j * ((n - 1) / 50.0), 0) AS BIGINT) AS i
            FROM (SELECT count(*) AS n FROM v_pred), range(51) t(j)),
    knots AS (SELECT pred AS score, min((s.i - 0.5) / n) AS percentile FROM s JOIN sel ON s.i = sel.i GROUP BY pred)"""


@query("calibration_knots", f"{P}, {KNOTS} SELECT {r('score')} AS score, {r('percentile')} AS percentile FROM knots")
def calibration_knots(spark, sf):
    return rounded(R.calibration_knots(pred_view(spark, sf), "pred", 51))


@query(
    "bracket_interpolate",
    f"""{with_views('v_pred', 'v_pred_b')}, {KNOTS}, l AS (SELECT *, lead(score) OVER (ORDER BY score) AS s2,
    lead(percentile) OVER (ORDER BY score) AS p2, row_number() OVER (ORDER BY score) AS k FROM knots)
    SELECT b.id, {r('CASE WHEN l.k IS NULL THEN (SELECT min(percentile) FROM knots) WHEN s2 IS NULL THEN percentile ELSE percentile + (p2 - percentile) * (b.pred - score) / (s2 - score) END')} AS q
    FROM v_pred_b b LEFT JOIN l ON b.pred >= l.score AND (b.pred < l.s2 OR l.s2 IS NULL)""",
)
def bracket_interpolate(spark, sf):
    knots = R.calibration_knots(pred_view(spark, sf), "pred", 51)
    return rounded(R.bracket_interpolate(pred_view_b(spark, sf), knots, "pred", "q").select("id", "q"))


@query(
    "order_statistic",
    f"""{P}, e AS (SELECT grp, abs(pred - actual) AS x FROM v_pred),
    k AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY x) AS i, count(*) OVER (PARTITION BY grp) AS n FROM e)
    SELECT grp, n, CAST(ceil((n + 1) * CAST(0.95 AS DOUBLE)) AS BIGINT) AS k,
    {r('max(x) FILTER (i = ceil((n + 1) * CAST(0.95 AS DOUBLE)))')} AS q,
    CASE WHEN ceil((n + 1) * CAST(0.95 AS DOUBLE)) > n THEN 'infinite' ELSE 'finite' END AS status
    FROM k GROUP BY grp, n""",
)
def _order_statistic(spark, sf):
    df = pred_view(spark, sf).withColumn("x", F.abs(F.col("pred") - F.col("actual")))
    return rounded(order_statistic(df, ["grp"], "x", 0.95, "q"))


@query(
    "argmin_row",
    f"""{P} SELECT grp, id, loss FROM (SELECT grp, id, {r('abs(pred - actual)', 1)} AS loss,
    row_number() OVER (PARTITION BY grp ORDER BY {r('abs(pred - actual)', 1)}, id) AS rn FROM v_pred) WHERE rn = 1""",
)
def argmin_row(spark, sf):
    df = pred_view(spark, sf).select("grp", "id", F.round(F.abs(F.col("pred") - F.col("actual")), 1).alias("loss"))
    return R.argmin_row(df, ["grp"], "loss", ["id"])


@query(
    "dedup_first",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def dedup_first(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return R.dedup_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "score_rank_order",
    f"{P} SELECT id, row_number() OVER (ORDER BY pred, id) AS position, pred > 0 AS positive FROM v_pred",
)
def score_rank_order(spark, sf):
    return R.score_rank_order(pred_view(spark, sf), "pred").select("id", "position", "positive")


@query(
    "min_rank_placement",
    f"""{P} SELECT id, rank() OVER (PARTITION BY grp ORDER BY covariate) AS low_first,
    rank() OVER (PARTITION BY grp ORDER BY covariate DESC) AS high_first FROM v_pred""",
)
def min_rank_placement(spark, sf):
    df = min_rank(pred_view(spark, sf), ["grp"], "covariate", "low_first")
    return min_rank(df, ["grp"], "covariate", "high_first", descending=True).select("id", "low_first", "high_first")


@query("isotonic_weighted")
def isotonic_weighted(spark, sf):
    """No SQL: pool-adjacent-violators is iterative. Tested against brute force."""
    df = R.group_weights(R.within_group_percentile(pred_view(spark, sf), ["grp"], "actual", "q_true"))
    fit = R.isotonic_weighted(df, "pred", "q_true", "weight")
    return rounded(R.apply_isotonic(fit, df, "pred", "q_hat").select("id", "q_hat"))


# --- sorts, limits, sets ---------------------------------------------------------------------------------


@query(
    "head_tail",
    f"""{with_views('v_metrics')} SELECT * FROM (SELECT grp, {r('mae')} AS mae, 'worst' AS side FROM v_metrics ORDER BY mae DESC, grp LIMIT 5)
    UNION ALL SELECT * FROM (SELECT grp, {r('mae')} AS mae, 'best' AS side FROM v_metrics ORDER BY mae, grp LIMIT 5)""",
)
def head_tail(spark, sf):
    panel = rounded(metrics_panel(pred_view(spark, sf), ["grp"]).select("grp", "mae"))
    return R.head_tail(panel, "mae", 5, "grp", larger_is_better=False)


@query("sort_report", f"{with_views('v_metrics')} SELECT grp, n, {r('bias')} AS bias FROM v_metrics ORDER BY n DESC, grp")
def sort_report(spark, sf):
    panel = metrics_panel(pred_view(spark, sf), ["grp"])
    return rounded(panel.select("grp", "n", "bias")).orderBy(F.col("n").desc(), "grp")


@query("smoke_limit", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 25")
def smoke_limit(spark, sf):
    return R.first_n(table(spark, sf, "embeddings").select("vec_id", "label"), 25, ["vec_id"])


@query(
    "union_fill",
    f"""{with_views('v_pred', 'v_pred_b')} SELECT id, grp, {r('pred', 9)} AS pred, {r('bal', 9)} AS bal FROM v_pred
    UNION ALL SELECT id, grp, {r('pred', 9)}, NULL FROM v_pred_b""",
)
def union_fill(spark, sf):
    a = pred_view(spark, sf).select("id", "grp", "pred", "bal")
    return rounded(a.unionByName(pred_view_b(spark, sf).select("id", "grp", "pred"), allowMissingColumns=True), 9)


@query(
    "append_summary_rows",
    f"""{P}, g AS (SELECT grp, count(*) AS n, avg(actual) AS mean_actual FROM v_pred GROUP BY grp)
    SELECT grp, n, {r('mean_actual')} AS mean_actual FROM (SELECT * FROM g
    UNION ALL SELECT 'POOLED', count(*), avg(actual) FROM v_pred UNION ALL SELECT 'MACRO', count(*), avg(mean_actual) FROM g)""",
)
def append_summary_rows(spark, sf):
    df = pred_view(spark, sf)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("actual").alias("mean_actual")]
    per = df.groupBy("grp").agg(*aggs)
    pooled = df.agg(*aggs).withColumn("grp", F.lit("POOLED"))
    macro = per.agg(F.count(F.lit(1)).alias("n"), F.avg("mean_actual").alias("mean_actual")).withColumn("grp", F.lit("MACRO"))
    return rounded(per.unionByName(pooled).unionByName(macro))


@query("intersect_ids", "SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_ids(spark, sf):
    good = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).intersect(good)


@query("except_ids", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_ids(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return c.subtract(table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")))


@query(
    "set_equal",
    f"""{with_views('v_pred', 'v_pred_b')} SELECT count(*) FILTER (b.id IS NULL) AS only_left,
    count(*) FILTER (a.id IS NULL) AS only_right, count(*) FILTER (a.id IS NULL OR b.id IS NULL) = 0 AS equal
    FROM (SELECT id FROM v_pred) a FULL JOIN (SELECT id FROM v_pred_b WHERE id % 1000 <> 1) b ON a.id = b.id""",
)
def set_equal(spark, sf):
    from heldout.operators.checks import set_equal as op

    b = pred_view_b(spark, sf).filter(F.col("id") % 1000 != 1)
    return op(pred_view(spark, sf).select("id"), b.select("id"))


@query(
    "distinct_union_keys",
    "SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
)
def distinct_union_keys(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query(
    "last_wins_union",
    """SELECT name, size, source FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source DESC, size DESC) AS rn FROM
    (SELECT o_orderpriority || '|' || (o_orderkey % 500) AS name, o_orderkey AS size, 1 AS source FROM orders
     UNION ALL SELECT o_orderpriority || '|' || (o_orderkey % 300), o_orderkey, 2 FROM orders WHERE o_orderstatus = 'F')) WHERE rn = 1""",
)
def last_wins_union(spark, sf):
    from heldout.sources.manifest import last_wins_union as op

    o = table(spark, sf, "orders")

    def names(df, m):
        return df.select(
            F.concat("o_orderpriority", F.lit("|"), F.col("o_orderkey") % m).alias("name"), F.col("o_orderkey").alias("size")
        )

    return op([names(o, 500), names(o.filter("o_orderstatus = 'F'"), 300)], "name", ["size"]).select("name", "size", "source")
