"""Modelling queries: iterative fits have no SQL and are tested on fixtures; their closed-form parts have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.catalog.base import (
    ORACLES, QUERIES, VIEWS, long_view, missing_view, pred_view, q_corr, query, r, rounded, samples_view, table, with_views,
)
from heldout.catalog.features import train_transform
from heldout.catalog.ranking import q_key
from heldout.operators import features as X
from heldout.operators import model as M
from heldout.operators.ranking import stratified_holdout
from heldout.operators.checks import lambda_boundary as lambda_boundary_op
from heldout.plans.storage import materialise

FEATURES = 64
NAMES = [f"f{i:02d}" for i in range(FEATURES)]
GRID = {"alphas": (0.1, 0.5, 1.0), "steps": 8, "top": 40}


def vectors(spark, sf, holes: bool = False):
    """(id, grp, y, x): one row per sample with its feature array."""
    y = samples_view(spark, sf)
    mark = lambda i: F.col("vec_id") * 31 + i * 17
    e = table(spark, sf, "embeddings")
    value = lambda v, i: (v.cast("double") + 1.0) / 2.0
    if holes:
        value = lambda v, i: F.when(~((mark(i) % 29 == 0) | ((i == 7) & (mark(i) % 9 == 0))), (v.cast("double") + 1.0) / 2.0)
    x = e.select(F.col("vec_id").alias("id"), F.transform("embedding", value).alias("x"))
    return y.join(x, "id")


@query("logo_nested_grid")
def logo_nested_grid(spark, sf):
    """Tuning table of the nested leave-one-group-out grid (median imputation inside every fold)."""
    run = M.logo_nested(vectors(spark, sf, holes=True), FEATURES, **GRID)
    return rounded(run["tuning"], 5)


@query("logo_outer_run")
def logo_outer_run(spark, sf):
    run = M.logo_nested(vectors(spark, sf), FEATURES, missing=False, **GRID)
    return rounded(run["predictions"], 5)


@query("logo_merge")
def logo_merge(spark, sf):
    run = M.logo_nested(vectors(spark, sf), FEATURES, missing=False, **GRID)
    return rounded(M.logo_merge(run["predictions"], run["selected"]), 5)


@query("elastic_net_1se")
def elastic_net_1se(spark, sf):
    run = M.logo_nested(vectors(spark, sf), FEATURES, missing=False, rule="1se", **GRID)
    return rounded(run["selected"], 5)


@query("lambda_boundary_count")
def lambda_boundary_count(spark, sf):
    run = M.logo_nested(vectors(spark, sf), FEATURES, missing=False, **GRID)
    fold = F.col("outer_group").alias("fold")
    return lambda_boundary_op(run["tuning"].select(fold, "alpha", "lambda"), run["selected"].select(fold, "alpha", "lambda"))


@query("export_coefficients")
def export_coefficients(spark, sf):
    run = M.logo_nested(vectors(spark, sf), FEATURES, missing=False, **GRID)
    return rounded(M.export_coefficients(run["final"], NAMES), 5)


@query("freeze_model")
def freeze_model(spark, sf):
    run = M.freeze_model(vectors(spark, sf), FEATURES, seed=61, missing=False, **GRID)
    head = run["selected"].select("outer_group", "alpha", "lambda", "loss").withColumn("_one", F.lit(1))
    return rounded(head.join(F.broadcast(run["conformal"].withColumn("_one", F.lit(1))), "_one").drop("_one"), 5)


@query(
    "export_partitions",
    f"""{with_views('v_samples')} SELECT id, grp, CASE WHEN grp IN ('G8', 'G9') THEN 'locked' WHEN rn <= greatest(1, floor(0.2 * n)) THEN 'calibration' ELSE 'training' END AS role
    FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {q_key(61, 'id')}, id) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM v_samples)""",
)
def export_partitions(spark, sf):
    from heldout.operators.ranking import stratified_holdout

    roles = stratified_holdout(samples_view(spark, sf), 0.2, seed=61)
    role = F.when(F.col("grp").isin("G8", "G9"), "locked").when(F.col("holdout"), "calibration").otherwise("training")
    return roles.select("id", "grp", role.alias("role"))


@query("rank_model_fit")
def rank_model_fit(spark, sf):
    run = M.rank_model_fit(vectors(spark, sf), FEATURES, missing=False, **GRID)
    return rounded(run["predictions"].select("id", "grp", "actual", "pred"), 5)


@query("rank_model_predict")
def rank_model_predict(spark, sf):
    from heldout.operators.ranking import bracket_interpolate

    run = M.rank_model_fit(vectors(spark, sf), FEATURES, kind="normal_score", missing=False, **GRID)
    return rounded(bracket_interpolate(run["predictions"], run["knots"], "pred", "percentile").select("id", "pred", "percentile"), 5)


def standardized(spark, sf):
    long = long_view(spark, sf)
    stats = X.feature_center_scale(long)
    z = long.join(F.broadcast(stats), "feature").select("id", "pos", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))
    x = z.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "z"))), lambda e: e["z"]).alias("x"))
    return samples_view(spark, sf).join(x, "id")


@query("pairwise_rank_fit")
def pairwise_rank_fit(spark, sf):
    """The whole grid (3 mixes, 8 penalties) over all groups. No SQL: iterative."""
    return rounded(M.pairwise_rank_fit(materialise(standardized(spark, sf)), 3, seed=71)["tuning"], 4)


@query("pairwise_rank_predict")
def pairwise_rank_predict(spark, sf):
    rows = materialise(standardized(spark, sf))
    fit = M.pairwise_rank_fit(rows, 3, seed=71)
    return rounded(M.pairwise_predict(fit["model"], rows, fit["knots"]), 3)


@query("elastic_net_fit")
def elastic_net_fit(spark, sf):
    rows = standardized(spark, sf)
    model = M.elastic_net_fit(rows, 0.5, 0.01)
    coefs = [(n, float(c)) for n, c in zip(NAMES, model.coefficients.toArray())]
    return rounded(spark.createDataFrame([("(Intercept)", float(model.intercept)), *coefs], "term string, coefficient double"), 4)


# --- closed-form parts -------------------------------------------------------------------------------------

VIEWS["v_frozen"] = (
    ("v_z",),
    """SELECT id, 0.25 + sum(CASE WHEN feature < 'f05' OR feature = 'zz' THEN 0.5 - CAST(CASE WHEN feature = 'zz' THEN 0 ELSE CAST(substr(feature, 2) AS INTEGER) END AS DOUBLE) / 10 ELSE 0 END * z) AS pred,
    avg(CASE WHEN missing THEN 1.0 ELSE 0.0 END) AS missing_fraction, sqrt(avg(z * z)) AS ood_score FROM v_z GROUP BY id""",
)


def frozen_scores(spark, sf):
    transform = train_transform(spark, sf)
    z = X.apply_standardize(missing_view(spark, sf), transform)
    number = F.when(F.col("feature") == "zz", 0).otherwise(F.substring("feature", 2, 2).try_cast("int"))
    coefs = transform.filter("feature < 'f05' OR feature = 'zz'").select("feature", (F.lit(0.5) - number / 10).alias("beta"))
    return M.predict_frozen(z, coefs, 0.25, 1.05, 0.08)


@query(
    "predict_frozen",
    f"""{with_views('v_frozen')} SELECT id, {r('pred')} AS pred, {r('missing_fraction')} AS missing_fraction, {r('ood_score')} AS ood_score,
    ood_score > 1.05 AS ood, missing_fraction > 0.08 AS qc_fail, NOT (ood_score > 1.05) AND NOT (missing_fraction > 0.08) AS reportable FROM v_frozen""",
)
def predict_frozen(spark, sf):
    return rounded(frozen_scores(spark, sf))


@query(
    "interval_columns",
    f"""{with_views('v_frozen')}, f AS (SELECT *, NOT (ood_score > 1.05) AND NOT (missing_fraction > 0.08) AS ok FROM v_frozen)
    SELECT id, CASE WHEN ok THEN {r('greatest(pred - 0.4, 0)')} END AS lower, CASE WHEN ok THEN {r('pred + 0.4')} END AS upper,
    CASE WHEN ok THEN 'interval' ELSE 'not_reportable' END AS interval_status, CASE WHEN ok AND id % 10 <> 0 THEN {r('greatest(pred, 0)')} END AS estimate FROM f""",
)
def interval_columns(spark, sf):
    from heldout.functions import scalars as S

    f = frozen_scores(spark, sf)
    shown = S.display_mask(S.clip_floor("pred"), F.col("reportable"), F.col("id") % 10 == 0)
    return rounded(f.select("id", *S.interval_columns(F.col("pred"), F.lit(0.4), F.col("reportable")), shown.alias("estimate")))


@query(
    "ood_rms_distance",
    f"""{with_views('v_z')} SELECT {r('quantile_cont(d, 0.99)')} AS cut FROM (SELECT id, sqrt(avg(z * z)) AS d FROM v_z GROUP BY id)""",
)
def ood_rms_distance(spark, sf):
    return rounded(M.ood_rms_cut(X.apply_standardize(missing_view(spark, sf), train_transform(spark, sf))))


@query(
    "ood_outside_range",
    f"""{with_views('v_missing')}, l AS (SELECT feature, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM v_missing WHERE grp <> 'G9' GROUP BY feature)
    SELECT id, {r('avg(CASE WHEN value BETWEEN lo AND hi THEN 0.0 ELSE 1.0 END)')} AS outside_share, avg(CASE WHEN value BETWEEN lo AND hi THEN 0.0 ELSE 1.0 END) > 0.02 AS ood
    FROM v_missing m JOIN l ON m.feature = l.feature WHERE value IS NOT NULL GROUP BY id""",
)
def ood_outside_range(spark, sf):
    long = missing_view(spark, sf)
    return rounded(M.ood_outside_range(long.filter("grp <> 'G9'"), long, limit=0.02))


@query(
    "conformal_interval",
    f"""{with_views('v_pred')}, h AS (SELECT actual, pred, row_number() OVER (PARTITION BY grp ORDER BY {q_key(81, 'id')}, id) AS rn, count(*) OVER (PARTITION BY grp) AS m FROM v_pred),
    e AS (SELECT abs(actual - pred) AS x, row_number() OVER (ORDER BY abs(actual - pred)) AS i, count(*) OVER () AS n FROM h WHERE rn <= greatest(1, floor(m * CAST(0.2 AS DOUBLE))))
    SELECT n, CAST(ceil((n + 1) * CAST(0.95 AS DOUBLE)) AS BIGINT) AS k, {r('x')} AS q, 'finite' AS status FROM e WHERE i = ceil((n + 1) * CAST(0.95 AS DOUBLE))""",
)
def conformal_interval(spark, sf):
    """The half-width from the stratified hold-out rows of every group."""
    return rounded(M.conformal_interval(stratified_holdout(pred_view(spark, sf), seed=81).filter("holdout").drop("holdout")))


@query(
    "group_gram",
    f"""{with_views('v_long', 'v_samples')}, a AS (SELECT l.grp, l.id, pos, value FROM v_long l JOIN v_samples s ON l.id = s.id)
    SELECT a.grp, a.pos AS i, b.pos AS j, {r('sum(a.value * b.value)', 5)} AS v FROM a JOIN a b ON a.id = b.id GROUP BY 1, 2, 3""",
)
def group_gram(spark, sf):
    """Products of all features."""
    g = M.group_products(vectors(spark, sf)).filter(F.col("i").between(2, FEATURES + 1))
    g = g.select("grp", (F.col("i") - 2).cast("long").alias("i"), F.posexplode(F.slice("v", 3, FEATURES)).alias("j", "v"))
    return rounded(g.select("grp", "i", F.col("j").cast("long").alias("j"), "v"), 5)


# The names under which the whole tables were registered first.
for _name in ("group_gram", "ood_rms_distance", "conformal_interval"):
    query(f"{_name}_full", ORACLES[_name])(QUERIES[_name])
