"""Feature statistics, rankers and transforms over the long matrix (id, grp, feature, value).

One pass gives additive statistics per (feature, group); every ranking, for every held-out group or set of
groups, is then arithmetic on that small table and the matrix is not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.operators.ranking import neighbours
from heldout.plans.skew import attach, broadcast_rows, group_attach, number_rows, profile, quantiles

R_CLAMP = 1 - 1e-6
MIN_GROUP = 4


def feature_missing(long: DataFrame, max_missing: float = 0.05) -> DataFrame:
    """Share of unknown values per feature and whether the feature is kept."""
    share = F.avg(F.col("value").isNull().cast("double"))
    return long.groupBy("feature").agg(share.alias("missing"), (share <= max_missing).alias("keep"))


def feature_missing_filter(long: DataFrame, max_missing: float = 0.05) -> DataFrame:
    """Drop features with too many unknown values; the kept list is small and joined back as a semi join."""
    keep = feature_missing(long, max_missing).filter("keep").select("feature")
    n = profile(long, ["feature"]).groups
    return long.join(F.broadcast(keep) if n <= broadcast_rows(long.sparkSession) else keep, ["feature"], "left_semi")


def feature_medians(long: DataFrame) -> DataFrame:
    """Exact median of the known values per feature."""
    return quantiles(long, ["feature"], "value", {"median": 0.5})


def feature_median_impute(long: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Fill unknown values with the (training) median of the feature."""
    medians = medians if medians is not None else feature_medians(long)
    rows = attach(long, medians, ["feature"], profile(long, ["feature"]).groups)
    return rows.withColumn("value", F.coalesce("value", "median")).drop("median")


def group_stats(long: DataFrame, group: str = "grp") -> DataFrame:
    """Additive statistics per (feature, group): n, s = sum x, q = sum x^2, and p = sum x*yc where ``yc`` is present.

    Unknown values count in ``n_miss``, with their yc sum in ``y_miss``, so a median can be put in later.
    """
    known, v = F.col("value").isNotNull(), F.col("value")
    aggs = [
        F.count("value").alias("n"),
        F.count_if(~known).alias("n_miss"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q"),
    ]
    if "yc" in long.columns:
        aggs += [
            F.coalesce(F.sum(v * F.col("yc")), F.lit(0.0)).alias("p"),
            F.coalesce(F.sum(F.when(~known, F.col("yc"))), F.lit(0.0)).alias("y_miss"),
        ]
    return long.groupBy("feature", group).agg(*aggs)


def imputed_stats(stats: DataFrame, medians: DataFrame) -> DataFrame:
    """The same statistics as if every unknown value were the feature's median; exact, without the rows."""
    j = stats.join(medians, "feature")
    m = F.col("median")
    out = [F.col("feature"), *[F.col(c) for c in stats.columns if c not in ("feature", "n", "n_miss", "s", "q", "p", "y_miss")]]
    out += [
        (F.col("n") + F.col("n_miss")).alias("n"),
        (F.col("s") + F.col("n_miss") * m).alias("s"),
        (F.col("q") + F.col("n_miss") * m * m).alias("q"),
    ]
    if "p" in stats.columns:
        out.append((F.col("p") + m * F.col("y_miss")).alias("p"))
    return j.select(*out)


def rank_pooled_variance(long: DataFrame, k: int) -> DataFrame:
    """Top k features by sample variance (> 0), name breaks ties."""
    var = long.groupBy("feature").agg(F.var_samp("value").alias("score")).filter("score > 0")
    return var.orderBy(F.col("score").desc(), "feature").limit(k)


def rank_population_variance(long: DataFrame, k: int) -> DataFrame:
    """Top k features by population variance over known values."""
    var = long.groupBy("feature").agg(F.var_pop("value").alias("score"), F.count("value").alias("n_known")).filter("score > 0")
    return var.orderBy(F.col("score").desc(), "feature").limit(k)


def _ss(n: Column, s: Column, q: Column) -> Column:
    ss = q - s * s / n
    return F.when((ss < 0) & (ss > -1e-8), 0.0).otherwise(ss)


def within_group_variance(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled within-group variance per feature from group statistics: sum of squares inside groups over N - T."""
    known = stats.filter("n > 0")
    n, t = F.sum("n"), F.count(F.lit(1))
    return known.groupBy(*keys, "feature").agg(
        n.alias("n"),
        t.alias("groups"),
        F.when(n - t >= 1, F.sum(_ss(F.col("n"), F.col("s"), F.col("q"))) / (n - t)).alias("score"),
    )


def rank_within_group_variance(stats: DataFrame, k: int) -> DataFrame:
    """Top k features by within-group variance."""
    return within_group_variance(stats).filter("score > 0").orderBy(F.col("score").desc(), "feature").limit(k).select("feature", "score")


def meta_association(stats: DataFrame, ssy: DataFrame, keys: Sequence[str] = (), group: str = "grp") -> DataFrame:
    """Per feature, the within-group association with the label combined over groups.

    ``stats`` has n, s, q, p per (feature, group), complete or imputed; ``ssy`` has (group, ssy): the label's
    centred sum of squares. Gives the combined Fisher z (weights n-3, none below 4 rows), sign consistency,
    heterogeneity I2, the share of variance between groups and whether the feature varies at all.
    """
    j = attach(stats, ssy, [group])
    n = F.col("n")
    ssx = _ss(n, F.col("s"), F.col("q"))
    w = F.when(n >= MIN_GROUP, (n - 3).cast("double")).otherwise(0.0)
    den = F.sqrt(ssx * F.col("ssy"))
    r = F.coalesce(F.when(den > 0, F.col("p") / den), F.lit(0.0))
    z = F.when((w > 0) & (F.col("ssy") > 0), F.atanh(F.least(F.greatest(r, F.lit(-R_CLAMP)), F.lit(R_CLAMP)))).otherwise(0.0)
    cells = j.select(*keys, "feature", "n", "s", "q", ssx.alias("ssx"), w.alias("w"), z.alias("z"))
    sw, swz = F.sum("w"), F.sum(F.col("w") * F.col("z"))
    # Cochran's Q as sum w*z^2 - (sum w*z)^2 / sum w
    q_het = F.greatest(F.sum(F.col("w") * F.col("z") * F.col("z")) - F.try_divide(swz * swz, sw), F.lit(0.0))
    df_q = F.greatest(F.count_if(F.col("w") > 0) - 1, F.lit(0).cast("long"))
    total, sst = F.sum("n"), F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    lineage = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.try_divide(F.sum("ssx"), sst)))
    return cells.groupBy(*keys, "feature").agg(
        total.alias("n"),
        F.try_divide(swz, F.sqrt(sw)).alias("z_meta"),
        F.abs(F.try_divide(F.sum(F.col("w") * F.signum("z")), sw)).alias("consistency"),
        F.when(df_q > 0, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(q_het - df_q, q_het), F.lit(0.0)))).otherwise(0.0).alias("i2"),
        F.when(sst > 0, lineage).otherwise(0.0).alias("lineage"),
        (sst > 1e-12).alias("nonconstant"),
    )


def lineage_penalized_score(meta: DataFrame, penalty: float) -> DataFrame:
    """|z| * consistency minus ``penalty`` robust units of the between-group share.

    Both scales are 1.4826 * MAD over features, else the sd, else 1. The three medians are exact and distributed.
    """
    rows = meta.withColumn("h", F.abs("z_meta") * F.col("consistency")).withColumn("l", F.col("lineage"))
    shape = profile(rows, [])

    def one(df):
        return df.withColumn("_one", F.lit(1))

    rows = one(rows)
    mids = one(quantiles(rows, [], "h", {"_mh": 0.5}, shape))
    mids = mids.join(F.broadcast(one(quantiles(rows, [], "l", {"_ml": 0.5}, shape))), "_one")
    dev = rows.join(F.broadcast(mids), "_one").withColumn("_dh", F.abs(F.col("h") - F.col("_mh"))).withColumn(
        "_dl", F.abs(F.col("l") - F.col("_ml"))
    )
    mads = one(quantiles(dev, [], "_dh", {"_ah": 0.5}, shape))
    mads = mads.join(F.broadcast(one(quantiles(dev, [], "_dl", {"_al": 0.5}, shape))), "_one")
    sds = one(rows.agg(F.stddev_samp("h").alias("_sh"), F.stddev_samp("l").alias("_sl")))
    j = dev.join(F.broadcast(mads.join(F.broadcast(sds), "_one")), "_one")

    def scale(mad, sd):
        return F.when(F.col(mad) > 0, F.col(mad) * 1.4826).when(F.col(sd) > 0, F.col(sd)).otherwise(1.0)

    l_std = (F.col("l") - F.col("_ml")) / scale("_al", "_sl") * scale("_ah", "_sh")
    return j.select("feature", (F.col("h") - F.lit(penalty) * l_std).alias("score"))


def topk_features(scores: DataFrame, k: int) -> DataFrame:
    """The k best features, score first, name second."""
    return scores.filter("score IS NOT NULL").orderBy(F.col("score").desc(), "feature").limit(k)


def feature_center_scale(long: DataFrame) -> DataFrame:
    """Mean and sample sd per feature (imputed values)."""
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def apply_standardize(long: DataFrame, transform: DataFrame) -> DataFrame:
    """Standardised values of the selected features, aligned by name.

    ``transform`` is (feature, median, mean, sd), at most a few thousand rows. Unknown values take the training
    median. A selected feature the matrix does not have at all is added for every sample at its median.
    """
    z = (F.coalesce("value", "median") - F.col("mean")) / F.col("sd")
    rows = attach(long, transform, ["feature"], how="inner")
    present = rows.select("id", "feature", z.alias("z"), F.col("value").isNull().alias("missing"))
    have = long.select("feature").distinct()
    absent = transform.join(have, "feature", "left_anti").agg(
        F.collect_list(F.struct("feature", ((F.col("median") - F.col("mean")) / F.col("sd")).alias("z"))).alias("_a")
    )
    samples = long.select("id").distinct().withColumn("_one", F.lit(1))
    filled = samples.join(F.broadcast(absent.withColumn("_one", F.lit(1))), "_one").select("id", F.explode("_a").alias("_f"))
    return present.unionByName(filled.select("id", "_f.feature", "_f.z", F.lit(True).alias("missing")))


def row_missing_fraction(z: DataFrame) -> DataFrame:
    return z.groupBy("id").agg(F.avg(F.col("missing").cast("double")).alias("missing_fraction"))


def logo_stats(stats: DataFrame, group: str = "grp") -> DataFrame:
    """Moments of every feature over all groups but one: totals minus the own part, for each group."""
    total = stats.groupBy("feature").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    j = stats.join(total, "feature")
    n, s, q = F.col("_n") - F.col("n"), F.col("_s") - F.col("s"), F.col("_q") - F.col("q")
    return j.select(
        F.col(group).alias("held_out"), "feature", n.alias("n"), F.try_divide(s, n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(_ss(n, s, q), F.lit(0.0)) / (n - 1))).alias("sd"),
    )


def exclusion_stats(stats: DataFrame, sets: DataFrame, group: str = "grp") -> DataFrame:
    """Statistics over all groups except those of each exclusion set.

    ``sets`` is (set_id, excluded array). Only the excluded parts are expanded, then taken from the totals.
    """
    cols = [c for c in ("n", "s", "q", "p") if c in stats.columns]
    parts = sets.select("set_id", F.explode("excluded").alias(group))
    out = parts.join(stats, group).groupBy("set_id", "feature").agg(*[F.sum(c).alias(f"_x_{c}") for c in cols])
    total = stats.groupBy("feature").agg(*[F.sum(c).alias(c) for c in cols])
    return out.join(total, "feature").select("set_id", "feature", *[(F.col(c) - F.col(f"_x_{c}")).alias(c) for c in cols])


def logo_selected_features(stats: DataFrame, k: int, group: str = "grp") -> DataFrame:
    """Top k features by within-group variance for every held-out group: (held_out, feature, score)."""
    known = stats.filter("n > 0").withColumn("_ss", _ss(F.col("n"), F.col("s"), F.col("q")))
    total = known.groupBy("feature").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_t"), F.sum("_ss").alias("_w"))
    j = known.join(total, "feature")
    free = (F.col("_n") - F.col("n")) - (F.col("_t") - 1)
    score = F.when(free >= 1, (F.col("_w") - F.col("_ss")) / free)
    scored = j.select(F.col(group).alias("held_out"), "feature", score.alias("score")).filter("score > 0")
    ranked = number_rows(scored, ["held_out"], [F.col("score").desc(), F.col("feature")], "rn")
    return ranked.filter(F.col("rn") <= k).select("held_out", "feature", "score")


def feature_overlap(selected: DataFrame) -> DataFrame:
    """In how many folds each feature was selected, and whether in all."""
    folds = selected.agg(F.count_distinct("held_out").alias("_all")).withColumn("_one", F.lit(1))
    per = selected.groupBy("feature").agg(F.count_distinct("held_out").alias("folds")).withColumn("_one", F.lit(1))
    return per.join(F.broadcast(folds), "_one").select("feature", "folds", (F.col("folds") == F.col("_all")).alias("in_all"))


def lambda_path(cross: DataFrame, n: Column, alpha: float, steps: int = 8, ratio: float = 1e-3) -> DataFrame:
    """Penalty path from (feature, xy = sum x*(y - mean y)): log-spaced from the largest useful value down.

    A degenerate label gives the fixed path 1, 0.1, 0.01.
    """
    top = cross.agg((F.max(F.abs("xy")) / (F.max(n) * F.lit(max(alpha, 0.01)))).alias("_top"))
    geometric = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.exp(F.log("_top") + i * F.lit(1.0) / (steps - 1) * F.log(F.lit(ratio)))
    )
    fixed = F.array(F.lit(1.0), F.lit(0.1), F.lit(0.01))
    path = F.when(F.coalesce(F.col("_top") > 0, F.lit(False)), geometric).otherwise(fixed)
    return top.select(F.lit(alpha).alias("alpha"), F.posexplode(path).alias("step", "lambda"))


def check_segments(segments: DataFrame) -> DataFrame:
    """Segments with impossible bounds, arm, chromosome or value, or overlapping the one before."""
    placed = neighbours(segments, ["sample", "chromosome"], ["seg_start", "seg_end"], ["seg_end"])
    bad = (
        F.when((F.col("seg_start") < 0) | (F.col("seg_end") <= F.col("seg_start")) | F.col("log2r").isNull(), "invalid")
        .when(~F.col("arm").isin("p", "q") | F.col("arm").isNull(), "arm")
        .when(~F.coalesce(F.col("chromosome").try_cast("int").between(1, 22), F.lit(False)), "chromosome")
        .when(F.col("prev_seg_end") > F.col("seg_start"), "overlap")
    )
    return placed.select("sample", "chromosome", "seg_start", "seg_end", bad.alias("violation")).filter("violation IS NOT NULL")


def segment_features(
    segments: DataFrame, threshold: float = 0.2, min_long: int = 10_000_000, max_gap: int = 3_000_000
) -> DataFrame:
    """Copy-number summary per sample; fractions are of the covered length.

    Transitions are boundaries between two long segments of one arm, close together, that differ in amplitude.
    """
    if threshold <= 0:
        raise ValueError("the amplitude threshold must be positive")
    rows = segments.withColumn("len", F.col("seg_end") - F.col("seg_start"))
    placed = neighbours(rows, ["sample", "chromosome"], ["seg_start", "seg_end"], ["seg_end", "arm", "len", "log2r"])
    size = F.abs("log2r")
    step = (
        (F.col("prev_arm") == F.col("arm"))
        & (F.col("len") >= min_long)
        & (F.col("prev_len") >= min_long)
        & (F.col("seg_start") - F.col("prev_seg_end") <= max_gap)
        & (F.abs(F.col("log2r") - F.col("prev_log2r")) >= threshold)
    )

    def covered(test):
        return F.coalesce(F.sum(F.when(test, F.col("len"))), F.lit(0)) / F.sum("len")

    stats = placed.groupBy("sample").agg(
        F.sum("len").alias("covered"),
        F.count(F.lit(1)).alias("segments"),
        covered(size >= threshold).alias("altered_fraction"),
        covered(F.col("log2r") >= threshold).alias("gain_fraction"),
        covered(F.col("log2r") <= -threshold).alias("loss_fraction"),
        (F.sum(F.col("len") * size) / F.sum("len")).alias("amplitude"),
        F.count_if((F.col("len") >= min_long) & (size >= threshold)).alias("large_altered"),
        F.count_if(step).alias("transitions"),
    )
    return stats.join(quantiles(rows, ["sample"], "len", {"median_len": 0.5}), "sample")


def centred_label(samples: DataFrame, group: str = "grp") -> DataFrame:
    """Add ``yc``, the label minus its group mean."""
    rows = group_attach(samples, [group], [F.avg("y").alias("_m")])
    return rows.withColumn("yc", F.col("y") - F.col("_m")).drop("_m")


def label_squares(samples: DataFrame, group: str = "grp") -> DataFrame:
    """Per group: the label's n, mean and centred sum of squares."""
    return samples.groupBy(group).agg((F.var_pop("y") * F.count("y")).alias("ssy"))

