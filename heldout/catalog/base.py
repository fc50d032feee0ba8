"""Registry of named queries, and the views over the given tables that they share (Spark and SQL side by side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.functions.scalars import safe_number
from heldout.plans.skew import cumulate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the SQL that must give the same rows."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison across engines; never used inside an operator."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- SQL fragments ---------------------------------------------------------------------------------------


def r(e: str, digits: int = 6) -> str:
    return f"(round({e}, {digits}) + 0.0)"


def q_corr(a: str, b: str) -> str:
    return f"(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0))"


def q_slope(y: str, x: str) -> str:
    return f"(covar_samp({y}, {x}) / nullif(var_samp({x}), 0))"


def q_midrank(part: str, x: str) -> str:
    by, tie = (f"PARTITION BY {part} ", f"{part}, ") if part else ("", "")
    return (
        f"(rank() OVER ({by}ORDER BY {x}) + (count(*) OVER (PARTITION BY {tie}{x}) - 1) / 2.0)"
    )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views and those they need."""
    seen: list[str] = []

    def visit(n):
        for d in VIEWS[n][0]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in seen)


# --- predictions -----------------------------------------------------------------------------------------

VIEWS["v_orders"] = (
    (),
    """SELECT o_orderkey AS id, n_name AS grp, o_custkey AS owner, o_totalprice / 10000 AS actual,
       c_acctbal / 1000 AS bal, n_regionkey AS regionkey,
       CAST((o_orderkey * 7 % 101) / 100.0 AS DOUBLE) AS covariate,
       CAST((o_orderkey * 13 % 97) / 97.0 AS DOUBLE) AS ood_score
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
VIEWS["v_pred"] = (
    ("v_orders",),
    """SELECT id, grp, owner, actual, covariate, ood_score, bal,
       0.6 * actual + 0.4 * bal + 0.5 * regionkey - 5 + 6 * ((id * 37 % 1000) / 1000.0) AS pred FROM v_orders""",
)
VIEWS["v_pred_b"] = (
    ("v_orders",),
    """SELECT id, grp, owner, actual, covariate, ood_score,
       0.5 * actual + 0.3 * bal + 0.2 * regionkey - 4 + 8 * ((id * 53 % 1000) / 1000.0) AS pred FROM v_orders""",
)
VIEWS["v_parts"] = (
    ("v_pred",),
    """SELECT id, grp, actual, pred, covariate, bal AS covariate2, actual * 0.2 AS part1,
       actual * 0.3 + (id * 11 % 50) / 100.0 AS part2,
       actual - actual * 0.2 - (actual * 0.3 + (id * 11 % 50) / 100.0) AS part3 FROM v_pred""",
)
VIEWS["v_metrics"] = (
    ("v_pred",),
    f"""SELECT grp, count(*) AS n, avg(abs(actual - pred)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse,
        1 - sum((pred - actual) * (pred - actual)) / nullif(var_pop(actual) * count(*), 0) AS r2,
        {q_corr('actual', 'pred')} AS pearson, {q_corr('ra', 'rp')} AS spearman,
        avg(actual) - {q_slope('actual', 'pred')} * avg(pred) AS calibration_intercept,
        {q_slope('actual', 'pred')} AS calibration_slope, avg(pred - actual) AS bias
        FROM (SELECT *, {q_midrank('grp', 'actual')} AS ra, {q_midrank('grp', 'pred')} AS rp FROM v_pred) GROUP BY grp""",
)


def orders_view(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("id"),
        F.col("n_name").alias("grp"),
        F.col("o_custkey").alias("owner"),
        (F.col("o_totalprice") / 10000).alias("actual"),
        (F.col("c_acctbal") / 1000).alias("bal"),
        F.col("n_regionkey").alias("regionkey"),
        ((key * 7 % 101) / F.lit(100.0)).alias("covariate"),
        ((key * 13 % 97) / F.lit(97.0)).alias("ood_score"),
    )


def pred_view(spark: SparkSession, sf: str) -> DataFrame:
    v = orders_view(spark, sf)
    noise = F.lit(6) * ((F.col("id") * 37 % 1000) / F.lit(1000.0))
    pred = F.lit(0.6) * F.col("actual") + F.lit(0.4) * F.col("bal") + F.lit(0.5) * F.col("regionkey") - 5 + noise
    return v.select("id", "grp", "owner", "actual", "covariate", "ood_score", "bal", pred.alias("pred"))


def pred_view_b(spark: SparkSession, sf: str) -> DataFrame:
    v = orders_view(spark, sf)
    noise = F.lit(8) * ((F.col("id") * 53 % 1000) / F.lit(1000.0))
    pred = F.lit(0.5) * F.col("actual") + F.lit(0.3) * F.col("bal") + F.lit(0.2) * F.col("regionkey") - 4 + noise
    return v.select("id", "grp", "owner", "actual", "covariate", "ood_score", pred.alias("pred"))


def parts_view(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("actual")
    part2 = y * 0.3 + (F.col("id") * 11 % 50) / F.lit(100.0)
    return pred_view(spark, sf).select(
        "id", "grp", "actual", "pred", "covariate", F.col("bal").alias("covariate2"),
        (y * 0.2).alias("part1"), part2.alias("part2"), (y - y * 0.2 - part2).alias("part3"),
    )


# --- feature matrix --------------------------------------------------------------------------------------

VIEWS["v_elements"] = (
    (),
    """SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings""",
)
VIEWS["v_samples"] = (
    (),
    """SELECT vec_id AS id, 'G' || label AS grp,
       CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) + 0.1 * label AS y FROM embeddings""",
)
VIEWS["v_long"] = (
    ("v_elements",),
    """SELECT vec_id AS id, 'G' || label AS grp, 'f' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature,
       (CAST(e AS DOUBLE) + 1.0) / 2.0 AS value, pos FROM v_elements""",
)
VIEWS["v_missing"] = (
    ("v_long",),
    """SELECT id, grp, feature, CASE WHEN (id * 31 + pos * 17) % 29 = 0 OR (pos = 7 AND (id * 31 + pos * 17) % 9 = 0)
       THEN NULL ELSE value END AS value FROM v_long""",
)


def samples_view(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("G"), F.col("label")).alias("grp"),
        (e.getItem(0).cast("double") + e.getItem(1).cast("double") + F.lit(0.1) * F.col("label")).alias("y"),
    )


def long_view(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "e"))
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("G"), F.col("label")).alias("grp"),
        F.concat(F.lit("f"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("feature"),
        ((F.col("e").cast("double") + 1.0) / 2.0).alias("value"),
        "pos",
    )


def missing_view(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.col("id") * 31 + F.col("pos") * 17
    gone = (mark % 29 == 0) | ((F.col("pos") == 7) & (mark % 9 == 0))
    return long_view(spark, sf).select("id", "grp", "feature", F.when(~gone, F.col("value")).alias("value"))


# --- segments --------------------------------------------------------------------------------------------

VIEWS["v_segments"] = (
    (),
    """SELECT sample, chromosome, arm, log2r,
       CAST(coalesce(sum(len + gap) OVER (PARTITION BY sample ORDER BY event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_start,
       CAST(coalesce(sum(len + gap) OVER (PARTITION BY sample ORDER BY event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len AS BIGINT) AS seg_end
       FROM (SELECT user_id AS sample, event_id, CAST(1 + event_id % 3 AS VARCHAR) AS chromosome,
             CASE WHEN event_id % 97 < 60 THEN 'p' ELSE 'q' END AS arm,
             1 + (event_id * 7919) % 20000000 AS len, (event_id * 31) % 1000000 AS gap,
             (value - 49) / 250.0 AS log2r FROM events)""",
)


def segments_view(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("sample"),
        "event_id",
        (F.lit(1) + i % 3).cast("string").alias("chromosome"),
        F.when(i % 97 < 60, "p").otherwise("q").alias("arm"),
        (F.lit(1) + (i * 7919) % 20000000).alias("len"),
        ((F.lit(1) + (i * 7919) % 20000000) + (i * 31) % 1000000).alias("step"),
        ((F.col("value") - 49) / F.lit(250.0)).alias("log2r"),
    )
    placed = cumulate(e, ["sample"], ["event_id"], ["step"])
    return placed.select(
        "sample", "chromosome", "arm", "log2r",
        F.col("step_before").alias("seg_start"), (F.col("step_before") + F.col("len")).alias("seg_end"),
    )


# --- partitions ------------------------------------------------------------------------------------------

LOCKED = ("NATION_3", "NATION_7")
LOCKED_SQL = "('NATION_3', 'NATION_7')"
