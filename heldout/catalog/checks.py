"""Governance and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.catalog.base import LOCKED, LOCKED_SQL, parts_view, pred_view, query, r, rounded, samples_view, table, with_views
from heldout.functions import scalars as S
from heldout.operators import checks as C

V = with_views("v_pred")


@query(
    "require_columns",
    f"{V} SELECT count(*) AS n FROM v_pred",
)
def require_columns(spark, sf):
    df = pred_view(spark, sf)
    C.require_columns(df, ["id", "grp", "actual", "pred"])
    return df.agg(F.count(F.lit(1)).alias("n"))


@query("check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_unique(spark, sf):
    return C.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "check_label_identity",
    f"""{with_views('v_parts')}, f AS (SELECT id, CASE WHEN id % 101 = 0 THEN NULL ELSE part1 END AS p1, part2, part3, CASE WHEN id % 103 = 0 THEN actual + 0.01 WHEN id % 107 = 0 THEN -1 ELSE actual END AS t FROM v_parts)
    SELECT * FROM (SELECT id, CASE WHEN p1 IS NULL THEN 'unknown' WHEN t < 0 THEN 'negative' WHEN abs(t - p1 - part2 - part3) > 1e-6 THEN 'sum_mismatch' END AS violation FROM f)
    WHERE violation IS NOT NULL""",
)
def check_label_identity(spark, sf):
    i = F.col("id")
    df = parts_view(spark, sf).withColumn("part1", F.when(i % 101 != 0, F.col("part1")))
    df = df.withColumn("actual", F.when(i % 103 == 0, F.col("actual") + 0.01).when(i % 107 == 0, -1.0).otherwise(F.col("actual")))
    return C.check_label_identity(df, "actual", ["part1", "part2", "part3"])


@query(
    "check_quality_vocab",
    """SELECT violation, n AS "count", 'error' AS severity FROM (SELECT 'blank' AS violation, count(*) FILTER (o_orderkey % 17 = 0) AS n FROM orders
    UNION ALL SELECT 'unknown', count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderstatus NOT IN ('F', 'O')) FROM orders) WHERE n > 0""",
)
def check_quality_vocab(spark, sf):
    o = table(spark, sf, "orders").withColumn("mark", F.when(F.col("o_orderkey") % 17 == 0, " ").otherwise(F.col("o_orderstatus")))
    return C.check_quality_vocab(o, "mark", ["F", "O"])


PART = f"""CASE WHEN id % 211 = 0 THEN ' ' WHEN id % 223 = 0 THEN 'held_out' WHEN id % 227 = 0 THEN 'locked' WHEN id % 229 = 0 THEN 'development'
    WHEN grp IN {LOCKED_SQL} THEN 'locked' ELSE 'development' END"""


def partitioned(spark, sf):
    i = F.col("id")
    p = (
        F.when(i % 211 == 0, " ").when(i % 223 == 0, "held_out").when(i % 227 == 0, "locked").when(i % 229 == 0, "development")
        .when(F.col("grp").isin(*LOCKED), "locked").otherwise("development")
    )
    return pred_view(spark, sf).withColumn("partition", p)


@query(
    "check_partition_agreement",
    f"""{V}, p AS (SELECT grp, trim({PART}) AS p, grp IN {LOCKED_SQL} AS listed FROM v_pred),
    k AS (SELECT grp, CASE WHEN p = '' THEN 'blank' WHEN p NOT IN ('locked', 'development') THEN 'unknown_label' WHEN listed AND p <> 'locked' THEN 'listed_but_open'
      WHEN NOT listed AND p = 'locked' THEN 'locked_but_not_listed' END AS violation FROM p) SELECT grp, violation, count(*) AS n FROM k WHERE violation IS NOT NULL GROUP BY 1, 2""",
)
def check_partition_agreement(spark, sf):
    return C.check_partition_agreement(partitioned(spark, sf), LOCKED)


@query(
    "filter_partition",
    f"{V} SELECT count(*) FILTER (grp NOT IN {LOCKED_SQL}) AS kept, count(*) FILTER (grp IN {LOCKED_SQL}) AS dropped FROM v_pred",
)
def filter_partition(spark, sf):
    return C.keep_development(pred_view(spark, sf), LOCKED)[1]


@query("keep_development", f"{V} SELECT id, grp FROM v_pred WHERE grp NOT IN {LOCKED_SQL}")
def keep_development(spark, sf):
    return C.keep_development(pred_view(spark, sf), LOCKED)[0].select("id", "grp")


@query("check_development_only", f"{V} SELECT grp, count(*) AS n FROM v_pred WHERE grp IN {LOCKED_SQL} GROUP BY grp")
def check_development_only(spark, sf):
    return C.check_development_only(pred_view(spark, sf), LOCKED)


@query(
    "check_disjoint_cover",
    """SELECT o_orderkey AS id, k AS n_roles, CASE WHEN k = 0 THEN 'uncovered' ELSE 'overlap' END AS violation FROM
    (SELECT o_orderkey, CAST(o_orderkey % 3 = 0 AS BIGINT) + CAST(o_orderkey % 3 = 1 AS BIGINT) + CAST(o_orderkey % 3 = 2 AND o_orderkey % 50 <> 2 OR o_orderkey % 90 = 0 AS BIGINT) AS k FROM orders) WHERE k <> 1""",
)
def check_disjoint_cover(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    roles = {
        "training": o.filter("id % 3 = 0"),
        "calibration": o.filter("id % 3 = 1"),
        "locked": o.filter("(id % 3 = 2 AND id % 50 <> 2) OR id % 90 = 0"),
    }
    return C.check_disjoint_cover(o, roles)


@query(
    "provenance_gate",
    """SELECT CASE WHEN count(*) = 0 THEN 'absent' WHEN NOT bool_and(length(c_name) > 0) THEN 'no_allowlist_hash' ELSE 'verified' END AS provenance,
    count(*) > 0 AS allowed, 'verified' AS stamp FROM customer""",
)
def provenance_gate(spark, sf):
    record = table(spark, sf, "customer").agg(F.lit(False).alias("engineering_only"), F.sha2(F.max("c_name"), 256).alias("allowlist_sha256"))
    return C.provenance_class(record)


@query(
    "allowlist_match",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' WHEN s_suppkey % 2 = 0 THEN 'matched' ELSE 'MISMATCH' END AS state FROM supplier""",
)
def allowlist_match(spark, sf):
    k = F.col("s_suppkey")
    a, b = F.md5("s_name"), F.when(k % 7 != 0, F.md5(F.when(k % 2 == 0, F.col("s_name")).otherwise("x")))
    return table(spark, sf, "supplier").select("s_suppkey", C.allowlist_match(a, b).alias("state"))


@query(
    "locked_scoring_guard",
    f"""{V} SELECT CASE WHEN id % 400 = 0 THEN 'unknown_sample' ELSE 'locked_without_opt_in' END AS violation, count(*) AS n FROM v_pred
    WHERE id % 400 = 0 OR grp IN {LOCKED_SQL} GROUP BY 1""",
)
def locked_scoring_guard(spark, sf):
    df = pred_view(spark, sf)
    samples = df.filter("id % 400 <> 0").select("id", F.when(F.col("grp").isin(*LOCKED), "locked").otherwise("development").alias("partition"))
    return C.locked_scoring_guard(df, samples, opted_in=False)


@query(
    "fold_completeness_gate",
    f"""{V}, e AS (SELECT DISTINCT grp AS fold FROM v_pred) SELECT fold, CASE fold WHEN 'NATION_1' THEN 'no_predictions' WHEN 'NATION_2' THEN 'no_metrics' WHEN 'NATION_4' THEN 'no_fold_table'
    WHEN 'NATION_5' THEN 'metrics_not_unique' WHEN 'NATION_6' THEN 'n_disagrees' WHEN 'NATION_8' THEN 'protocol_differs' END AS violation FROM e
    WHERE fold IN ('NATION_1', 'NATION_2', 'NATION_4', 'NATION_5', 'NATION_6', 'NATION_8')""",
)
def fold_completeness_gate(spark, sf):
    df = pred_view(spark, sf).select(F.col("grp").alias("fold"), "id")
    per = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    metrics = per.filter("fold <> 'NATION_2'").select(
        "fold", F.when(F.col("fold") == "NATION_6", F.col("n") + 1).otherwise(F.col("n")).alias("n"),
        F.when(F.col("fold") == "NATION_8", "clip").otherwise("identity").alias("protocol"),
    )
    metrics = metrics.unionByName(metrics.filter("fold = 'NATION_5'"))
    return C.fold_completeness(per.select("fold"), df.filter("fold <> 'NATION_1'"), metrics, per.select("fold").filter("fold <> 'NATION_4'"))


@query(
    "clip_rule_gate",
    f"""{V} SELECT violation, n FROM (SELECT 'rule_missing' AS violation, count(*) FILTER (id % 1000 = 5) AS n FROM v_pred UNION ALL SELECT 'several_rules', 1 FROM (SELECT 1)
    UNION ALL SELECT 'rule_unknown', count(*) FILTER (id % 1000 = 6) FROM v_pred UNION ALL SELECT 'negative_predictions', count(*) FILTER (pred < 0) FROM v_pred) WHERE n > 0""",
)
def clip_rule_gate(spark, sf):
    rule = F.when(F.col("id") % 1000 == 5, None).when(F.col("id") % 1000 == 6, "raw").otherwise("floor_at_zero")
    return C.clip_rule_gate(pred_view(spark, sf).withColumn("clip_rule", rule))


@query(
    "cohort_gate",
    f"""{V}, p AS (SELECT grp, {PART} = 'locked' AS l, grp IN {LOCKED_SQL} AS listed FROM v_pred WHERE grp IN {LOCKED_SQL})
    SELECT * FROM (SELECT 'not_locked' AS violation, count(*) FILTER (NOT l) AS n FROM p UNION ALL SELECT 'sources_disagree', count(*) FILTER (l <> listed) FROM p
    UNION ALL SELECT 'absent:NATION_99', 1) WHERE n > 0""",
)
def cohort_gate(spark, sf):
    df = partitioned(spark, sf).filter(F.col("grp").isin(*LOCKED))
    return C.cohort_gate(df, ["NATION_3", "NATION_99"], LOCKED)


@query("minimum_cohort_gate", f"{V} SELECT count(DISTINCT grp) AS groups, count(*) AS rows FROM v_pred HAVING count(DISTINCT grp) < 30 OR count(*) < 50")
def minimum_cohort_gate(spark, sf):
    return C.minimum_cohort_gate(pred_view(spark, sf), groups=30)


@query("map_conflict_check", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def map_conflict_check(spark, sf):
    return C.map_conflict_check(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


# --- scalars -----------------------------------------------------------------------------------------------


@query(
    "clip_floor",
    f"{V} SELECT id, {r('greatest(pred, 0)')} AS pred, {r('pred')} AS pred_raw, pred < 0 AS clipped, 'floor_at_zero' AS clip_rule FROM v_pred",
)
def clip_floor(spark, sf):
    return rounded(C.clip_and_stamp(pred_view(spark, sf).select("id", "pred")))


@query(
    "target_transform",
    f"{V} SELECT id, {r('ln(1 + actual)')} AS forward, {r('greatest(exp(pred / 10) - 1, 0)')} AS inverse, {r('greatest(pred, 0)')} AS clipped FROM v_pred",
)
def target_transform(spark, sf):
    t = S.target_transforms()
    df = pred_view(spark, sf)
    return rounded(df.select("id", t["log1p"][0](F.col("actual")).alias("forward"), t["log1p"][1](F.col("pred") / 10).alias("inverse"), t["clip"][1](F.col("pred")).alias("clipped")))


@query(
    "to_m_value",
    f"""{with_views('v_long')} SELECT id, feature, {r('log2(least(greatest(value, 0.001), 0.999) / (1 - least(greatest(value, 0.001), 0.999)))')} AS m, {r('least(greatest(value, 0.001), 0.999)')} AS back FROM v_long""",
)
def to_m_value(spark, sf):
    from heldout.catalog.base import long_view

    m = long_view(spark, sf).select("id", "feature", S.to_m_value("value").alias("m"))
    return rounded(m.withColumn("back", S.from_m_value("m")))


@query(
    "mixture_signal",
    f"""{V}, s AS (SELECT id, covariate AS p, id % 3 AS a, id % 2 AS b FROM v_pred) SELECT id,
    CASE WHEN p * (a + b) + 2 * (1 - p) > 0 THEN {r('log2((p * (a + b) + 2 * (1 - p)) / 2)')} END AS log_ratio,
    CASE WHEN p * (a + b) + 2 * (1 - p) > 0 THEN {r('(p * b + (1 - p)) / (p * (a + b) + 2 * (1 - p))')} END AS allele FROM s""",
)
def mixture_signal(spark, sf):
    df = pred_view(spark, sf)
    log_ratio, allele = S.mixture_signal(F.col("covariate"), F.col("id") % 3, F.col("id") % 2)
    return rounded(df.select("id", log_ratio.alias("log_ratio"), allele.alias("allele")))


@query(
    "safe_number",
    """SELECT event_id, try_cast(t AS DOUBLE) AS number FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '' ELSE CAST(value AS VARCHAR) END AS t FROM events)""",
)
def safe_number(spark, sf):
    i = F.col("event_id") % 5
    text = F.when(i == 0, "abc").when(i == 1, "").when((i == 2) & F.lit(False), "NaN").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", S.safe_number(text).alias("number"))


@query(
    "validate_unit_interval",
    """SELECT event_id, CASE WHEN k >= 2 AND value / 100 BETWEEN 0 AND 1 THEN value / 100 END AS beta, k < 2 OR coalesce(value / 100 BETWEEN 0 AND 1, false) AS valid
    FROM (SELECT event_id, value, event_id % 7 AS k FROM events)""",
)
def validate_unit_interval(spark, sf):
    k = F.col("event_id") % 7
    text = F.when(k == 0, " NA ").when(k == 1, "").otherwise((F.col("value") / 100).cast("string"))
    beta, valid = S.unit_interval(text)
    return table(spark, sf, "events").select("event_id", beta.alias("beta"), valid.alias("valid"))


@query("truthy", "SELECT o_orderkey, o_orderkey % 6 < 3 AS flag FROM orders")
def truthy(spark, sf):
    words = F.array(*[F.lit(w) for w in (" true", "YES", "1", "no", "0", "")])
    return table(spark, sf, "orders").select("o_orderkey", S.truthy(F.get(words, (F.col("o_orderkey") % 6).cast("int"))).alias("flag"))


@query("trim_record", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def trim_record(spark, sf):
    c = table(spark, sf, "customer")
    dirty = c.select("c_custkey", F.concat(F.lit(" \t"), "c_name", F.lit("\r\n")).alias("c_name"), F.concat("c_mktsegment", F.lit("  ")).alias("c_mktsegment"))
    return S.trim_record(dirty)


@query(
    "range_and_select_filter",
    f"{V} SELECT id, grp FROM v_pred WHERE actual BETWEEN 10 AND 30 AND grp IN ('NATION_1', 'NATION_2')",
)
def range_and_select_filter(spark, sf):
    return pred_view(spark, sf).filter(F.col("actual").between(10, 30) & F.col("grp").isin("NATION_1", "NATION_2")).select("id", "grp")


@query(
    "filter_allowlist",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)",
)
def filter_allowlist(spark, sf):
    allow = table(spark, sf, "part").filter("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(allow, "l_partkey", "left_semi")


@query("from_m_value", f"{with_views('v_long')} SELECT id, feature, {r('pow(2, 8 * value - 4) / (1 + pow(2, 8 * value - 4))')} AS beta FROM v_long")
def from_m_value(spark, sf):
    from heldout.catalog.base import long_view

    return rounded(long_view(spark, sf).select("id", "feature", S.from_m_value(F.col("value") * 8 - 4).alias("beta")))


@query(
    "display_mask",
    f"{V} SELECT id, CASE WHEN ood_score <= 0.8 AND id % 50 <> 0 THEN {r('greatest(pred, 0)')} END AS estimate FROM v_pred",
)
def display_mask(spark, sf):
    shown = S.display_mask(S.clip_floor("pred"), F.col("ood_score") <= 0.8, F.col("id") % 50 == 0)
    return rounded(pred_view(spark, sf).select("id", shown.alias("estimate")))


@query(
    "provenance_class",
    """SELECT s_nationkey, CASE WHEN count(*) FILTER (s_acctbal < 0) > 0 THEN 'engineering_fixture' ELSE 'verified' END AS provenance FROM supplier GROUP BY 1""",
)
def provenance_class(spark, sf):
    """The class of one record per nation: a fixture as soon as one of its sources is one."""
    records = table(spark, sf, "supplier").select("s_nationkey", (F.col("s_acctbal") < 0).alias("engineering_only"), F.sha2("s_name", 256).alias("allowlist_sha256"))
    return C.provenance_class(records, keys=["s_nationkey"]).select("s_nationkey", "provenance")
