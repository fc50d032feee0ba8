"""Feature-matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.catalog.base import (
    VIEWS, long_view, missing_view, q_corr, query, r, rounded, samples_view, segments_view, table, with_views,
)
from heldout.operators import features as X

L, MISS = with_views("v_long"), with_views("v_missing")
K = 20


@query(
    "feature_missing_filter",
    f"""{MISS} SELECT feature, {r('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing,
    avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.05 AS keep FROM v_missing GROUP BY feature""",
)
def feature_missing_filter(spark, sf):
    return rounded(X.feature_missing(missing_view(spark, sf)))


KEPT = "kept AS (SELECT * FROM v_missing WHERE feature IN (SELECT feature FROM v_missing GROUP BY feature HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.05))"


@query(
    "feature_median_impute",
    f"""{MISS}, {KEPT} SELECT id, grp, feature, {r('coalesce(value, quantile_cont(value, 0.5) OVER (PARTITION BY feature))')} AS value FROM kept""",
)
def feature_median_impute(spark, sf):
    return rounded(X.feature_median_impute(X.feature_missing_filter(missing_view(spark, sf))).select("id", "grp", "feature", "value"))


@query(
    "rank_pooled_variance",
    f"{L} SELECT feature, {r('var_samp(value)', 9)} AS score FROM v_long GROUP BY feature ORDER BY var_samp(value) DESC, feature LIMIT {K}",
)
def rank_pooled_variance(spark, sf):
    return rounded(X.rank_pooled_variance(long_view(spark, sf), K), 9)


@query(
    "topk_features",
    f"{L} SELECT feature, {r('avg(value)', 9)} AS score FROM v_long GROUP BY feature ORDER BY avg(value) DESC, feature LIMIT {K}",
)
def topk_features(spark, sf):
    return rounded(X.topk_features(long_view(spark, sf).groupBy("feature").agg(F.avg("value").alias("score")), K), 9)


@query(
    "rank_population_variance",
    f"{MISS} SELECT feature, {r('var_pop(value)', 9)} AS score, count(value) AS n_known FROM v_missing GROUP BY feature ORDER BY var_pop(value) DESC, feature LIMIT {K}",
)
def rank_population_variance(spark, sf):
    return rounded(X.rank_population_variance(missing_view(spark, sf), K), 9)


@query(
    "group_stats",
    f"""{MISS} SELECT feature, grp, count(value) AS n, count(*) - count(value) AS n_miss, {r('sum(value)')} AS s, {r('sum(value * value)')} AS q
    FROM v_missing GROUP BY feature, grp""",
)
def group_stats(spark, sf):
    return rounded(X.group_stats(missing_view(spark, sf)))


WGV = "wv AS (SELECT feature, sum((value - m) * (value - m)) / (count(*) - count(DISTINCT grp)) AS score FROM (SELECT *, avg(value) OVER (PARTITION BY feature, grp) AS m FROM v_long) GROUP BY feature)"


@query(
    "rank_within_group_variance",
    f"{L}, {WGV} SELECT feature, {r('score', 9)} AS score FROM wv ORDER BY wv.score DESC, feature LIMIT {K}",
)
def rank_within_group_variance(spark, sf):
    return rounded(X.rank_within_group_variance(X.group_stats(long_view(spark, sf)), K), 9)


def labelled_long(spark, sf):
    """Long matrix with the group-centred label of each sample attached before the vectors are exploded."""
    samples = X.centred_label(samples_view(spark, sf)).select("id", "y", "yc")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding").join(samples, "id")
    cells = e.select("id", F.concat(F.lit("G"), F.col("label")).alias("grp"), "y", "yc", F.posexplode("embedding").alias("pos", "e"))
    name = F.concat(F.lit("f"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("feature")
    return cells.select("id", "grp", "y", "yc", name, ((F.col("e").cast("double") + 1.0) / 2.0).alias("value"))


META_SQL = f"""xy AS (SELECT l.feature, l.grp, l.value AS x, s.y FROM v_long l JOIN v_samples s ON l.id = s.id),
    c AS (SELECT feature, grp, count(*) AS n, var_pop(x) * count(*) AS ssx, CASE WHEN count(*) >= 4 THEN count(*) - 3 ELSE 0 END AS w,
      CASE WHEN count(*) >= 4 THEN atanh(least(greatest(coalesce({q_corr('x', 'y')}, 0), -1 + 1e-6), 1 - 1e-6)) ELSE 0 END AS z
      FROM xy GROUP BY feature, grp),
    t AS (SELECT feature, var_pop(x) * count(*) AS sst, count(*) AS n FROM xy GROUP BY feature),
    m AS (SELECT c.feature, sum(w * z) / sqrt(sum(w)) AS z_meta, abs(sum(w * sign(z))) / sum(w) AS consistency,
      sum(w * z * z) - sum(w * z) * sum(w * z) / sum(w) AS qh, count(*) FILTER (w > 0) - 1 AS dfq, sum(ssx) AS ssw FROM c GROUP BY c.feature),
    meta AS (SELECT m.feature, t.n, z_meta, consistency, CASE WHEN dfq > 0 THEN greatest(0, (qh - dfq) / qh) ELSE 0 END AS i2,
      least(1, greatest(0, 1 - ssw / sst)) AS lineage, sst > 1e-12 AS nonconstant FROM m JOIN t ON m.feature = t.feature)"""


@query(
    "rank_meta_association",
    f"""{with_views('v_long', 'v_samples')}, {META_SQL} SELECT feature, n, {r('z_meta')} AS z_meta, {r('consistency')} AS consistency,
    {r('i2')} AS i2, {r('lineage')} AS lineage, nonconstant FROM meta""",
)
def rank_meta_association(spark, sf):
    stats = X.group_stats(labelled_long(spark, sf))
    return rounded(X.meta_association(stats, X.label_squares(samples_view(spark, sf))))


@query(
    "lineage_penalized_score",
    f"""{with_views('v_long', 'v_samples')}, {META_SQL}, h AS (SELECT feature, abs(z_meta) * consistency AS h, lineage AS l FROM meta),
    q AS (SELECT quantile_cont(h, 0.5) AS mh, quantile_cont(l, 0.5) AS ml FROM h),
    a AS (SELECT quantile_cont(abs(h - mh), 0.5) AS ah, quantile_cont(abs(l - ml), 0.5) AS al FROM h, q)
    SELECT feature, {r('h - 1.0 * (l - ml) / (al * 1.4826) * (ah * 1.4826)', 5)} AS score FROM h, q, a""",
)
def lineage_penalized_score(spark, sf):
    stats = X.group_stats(labelled_long(spark, sf))
    meta = X.meta_association(stats, X.label_squares(samples_view(spark, sf)))
    return rounded(X.lineage_penalized_score(meta, 1.0), 5)


@query(
    "feature_center_scale",
    f"{L} SELECT feature, {r('avg(value)', 9)} AS mean, {r('stddev_samp(value)', 9)} AS sd FROM v_long GROUP BY feature",
)
def feature_center_scale(spark, sf):
    return rounded(X.feature_center_scale(long_view(spark, sf)), 9)


def train_transform(spark, sf):
    """(feature, median, mean, sd) learned on all groups but G9, for the first 40 features and one that never occurs."""
    train = missing_view(spark, sf).filter("grp <> 'G9' AND feature < 'f40'")
    med = X.feature_medians(train)
    stats = X.feature_center_scale(X.feature_median_impute(train, med)).join(med, "feature")
    ghost = stats.filter("feature = 'f00'").withColumn("feature", F.lit("zz")).withColumn("mean", F.col("mean") + 0.01)
    return stats.unionByName(ghost)


VIEWS["v_transform"] = (
    ("v_missing",),
    """SELECT feature, median, mean, sd FROM (SELECT feature, any_value(med) AS median, avg(coalesce(value, med)) AS mean, stddev_samp(coalesce(value, med)) AS sd
    FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY feature) AS med FROM v_missing WHERE grp <> 'G9' AND feature < 'f40') GROUP BY feature)
    UNION ALL SELECT 'zz', any_value(med), avg(coalesce(value, med)) + 0.01, stddev_samp(coalesce(value, med))
    FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY feature) AS med FROM v_missing WHERE grp <> 'G9' AND feature = 'f00')""",
)
VIEWS["v_z"] = (
    ("v_transform",),
    """SELECT m.id, m.feature, (coalesce(value, median) - mean) / sd AS z, value IS NULL AS missing FROM v_missing m JOIN v_transform t ON m.feature = t.feature
    UNION ALL SELECT id, 'zz', (median - mean) / sd, true FROM (SELECT DISTINCT id FROM v_missing), v_transform WHERE feature = 'zz'""",
)


@query("apply_standardize", f"{with_views('v_z')} SELECT id, feature, {r('z')} AS z, missing FROM v_z")
def apply_standardize(spark, sf):
    return rounded(X.apply_standardize(missing_view(spark, sf), train_transform(spark, sf)))


@query(
    "row_missing_fraction",
    f"{with_views('v_z')} SELECT id, {r('avg(CASE WHEN missing THEN 1.0 ELSE 0.0 END)')} AS missing_fraction FROM v_z GROUP BY id",
)
def row_missing_fraction(spark, sf):
    return rounded(X.row_missing_fraction(X.apply_standardize(missing_view(spark, sf), train_transform(spark, sf))))


@query(
    "logo_feature_stats",
    f"""{L}, g AS (SELECT DISTINCT grp AS held_out FROM v_long) SELECT held_out, feature, count(*) AS n, {r('avg(value)')} AS mean,
    {r('stddev_samp(value)')} AS sd FROM g JOIN v_long ON grp <> held_out GROUP BY held_out, feature""",
)
def logo_feature_stats(spark, sf):
    return rounded(X.logo_stats(X.group_stats(long_view(spark, sf))))


@query(
    "exclusion_stats",
    f"""{L}, s AS (SELECT DISTINCT a.grp || '-' || b.grp AS set_id, a.grp AS x, b.grp AS y FROM v_long a, (SELECT DISTINCT grp FROM v_long) b
      WHERE a.grp < b.grp) SELECT set_id, feature, sum(n) AS n, {r('sum(s)')} AS s, {r('sum(q)', 5)} AS q FROM s JOIN
    (SELECT feature, grp, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM v_long GROUP BY feature, grp) t
    ON t.grp <> x AND t.grp <> y GROUP BY set_id, feature""".replace("sum(n) AS n,", "CAST(sum(n) AS BIGINT) AS n,"),
)
def exclusion_stats(spark, sf):
    from heldout.operators.model import exclusion_sets

    sets = exclusion_sets(samples_view(spark, sf)).filter("outer_group < inner_group").select(
        F.concat_ws("-", "outer_group", "inner_group").alias("set_id"), "excluded"
    )
    out = X.exclusion_stats(X.group_stats(long_view(spark, sf)), sets)
    return out.select("set_id", "feature", "n", F.round("s", 6).alias("s"), F.round("q", 5).alias("q"))


LOGO_SEL = f"""g AS (SELECT DISTINCT grp AS held_out FROM v_long), w AS (SELECT held_out, feature, sum((value - m) * (value - m)) / (count(*) - count(DISTINCT grp)) AS score
    FROM g JOIN (SELECT *, avg(value) OVER (PARTITION BY feature, grp) AS m FROM v_long) ON grp <> held_out GROUP BY held_out, feature),
    sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY score DESC, feature) AS rn FROM w) WHERE rn <= {K})"""


@query("logo_selected_features", f"{L}, {LOGO_SEL} SELECT held_out, feature, {r('score', 9)} AS score FROM sel")
def logo_selected_features(spark, sf):
    return rounded(X.logo_selected_features(X.group_stats(long_view(spark, sf)), K), 9)


@query(
    "feature_overlap",
    f"{L}, {LOGO_SEL} SELECT feature, count(DISTINCT held_out) AS folds, count(DISTINCT held_out) = (SELECT count(*) FROM g) AS in_all FROM sel GROUP BY feature",
)
def feature_overlap(spark, sf):
    return X.feature_overlap(X.logo_selected_features(X.group_stats(long_view(spark, sf)), K))


@query(
    "lambda_max_path",
    f"""{with_views('v_long', 'v_samples')}, c AS (SELECT feature, sum((value - mv) / sv * (y - my)) AS xy FROM
      (SELECT l.feature, value, y, avg(value) OVER (PARTITION BY feature) AS mv, stddev_samp(value) OVER (PARTITION BY feature) AS sv,
       avg(y) OVER (PARTITION BY feature) AS my FROM v_long l JOIN v_samples s ON l.id = s.id) GROUP BY feature),
    t AS (SELECT max(abs(xy)) / ((SELECT count(*) FROM v_samples) * CAST(0.5 AS DOUBLE)) AS top FROM c)
    SELECT CAST(0.5 AS DOUBLE) AS alpha, CAST(i AS INTEGER) AS step, {r('exp(ln(top) + i / 7.0 * ln(0.001))')} AS "lambda" FROM t, range(8) d(i)""",
)
def lambda_max_path(spark, sf):
    long = labelled_long(spark, sf)
    moments = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), (F.covar_pop("value", "y") * F.count(F.lit(1)) / F.stddev_samp("value")).alias("xy")
    )
    return rounded(X.lambda_path(moments, F.col("n"), 0.5))


SEG = """placed AS (SELECT *, seg_end - seg_start AS len, lag(seg_end) OVER w AS pe, lag(arm) OVER w AS pa, lag(seg_end - seg_start) OVER w AS pl, lag(log2r) OVER w AS pr
    FROM v_segments WINDOW w AS (PARTITION BY sample, chromosome ORDER BY seg_start, seg_end))"""


@query(
    "segment_features",
    f"""{with_views('v_segments')}, {SEG} SELECT sample, CAST(sum(len) AS BIGINT) AS covered, count(*) AS segments,
    {r('coalesce(sum(len) FILTER (abs(log2r) >= 0.15), 0) / sum(len)')} AS altered_fraction,
    {r('coalesce(sum(len) FILTER (log2r >= 0.15), 0) / sum(len)')} AS gain_fraction,
    {r('coalesce(sum(len) FILTER (log2r <= -0.15), 0) / sum(len)')} AS loss_fraction,
    {r('sum(len * abs(log2r)) / sum(len)')} AS amplitude, count(*) FILTER (len >= 2000000 AND abs(log2r) >= 0.15) AS large_altered,
    count(*) FILTER (pa = arm AND len >= 2000000 AND pl >= 2000000 AND seg_start - pe <= 50000000 AND abs(log2r - pr) >= 0.15) AS transitions,
    quantile_cont(CAST(len AS DOUBLE), 0.5) AS median_len FROM placed GROUP BY sample""",
)
def segment_features(spark, sf):
    return rounded(X.segment_features(segments_view(spark, sf), 0.15, 2_000_000, 50_000_000))


@query(
    "adjacent_segments",
    f"""{with_views('v_segments')}, f AS (SELECT sample, chromosome, seg_start, CASE WHEN seg_start % 3 = 0 THEN seg_end + 60000000 ELSE seg_end END AS seg_end FROM v_segments),
    p AS (SELECT *, lag(seg_end) OVER (PARTITION BY sample, chromosome ORDER BY seg_start, seg_end) AS pe FROM f)
    SELECT sample, chromosome, seg_start, seg_end, 'overlap' AS violation FROM p WHERE pe > seg_start""",
)
def adjacent_segments(spark, sf):
    """Neighbours that overlap after every third segment was prolonged."""
    end = F.when(F.col("seg_start") % 3 == 0, F.col("seg_end") + 60000000).otherwise(F.col("seg_end"))
    return X.check_segments(segments_view(spark, sf).withColumn("seg_end", end))


@query(
    "check_segments",
    f"""{with_views('v_segments')}, f AS (SELECT sample, chromosome, arm, log2r, seg_start, CASE WHEN seg_start % 50 = 7 THEN seg_start ELSE seg_end + (seg_start % 10) * 2000000 END AS seg_end FROM v_segments),
    p AS (SELECT *, lag(seg_end) OVER (PARTITION BY sample, chromosome ORDER BY seg_start, seg_end) AS pe FROM f)
    SELECT * FROM (SELECT sample, chromosome, seg_start, seg_end, CASE WHEN seg_end <= seg_start THEN 'invalid' WHEN pe > seg_start THEN 'overlap' END AS violation FROM p) WHERE violation IS NOT NULL""",
)
def check_segments(spark, sf):
    s = F.col("seg_start")
    end = F.when(s % 50 == 7, s).otherwise(F.col("seg_end") + (s % 10) * 2000000)
    return X.check_segments(segments_view(spark, sf).withColumn("seg_end", end))
