"""Run comparisons, score cards, component reports and group-level statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.laws import COUNTED, correlation_p, signed_rank_p
from heldout.functions.scalars import clip_floor, fisher_ci, pnorm_two_sided, safe_corr, safe_slope
from heldout.operators.metrics import centred, group_identity_r2, metrics_panel, pairs
from heldout.plans.skew import Profile, midrank, midranks, null_safe_join, profile, quantiles


def one_row_join(*parts: DataFrame) -> DataFrame:
    """Put one-row tables side by side."""
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def excess_group_r2(a: DataFrame, b: DataFrame, group: str = "grp", unit: str = "id") -> DataFrame:
    """Group R2 of two runs' predictions beyond that of the label, and the share of the excess the second removes."""
    both = a.select(unit, group, "actual", F.col("pred").alias("pred_a")).join(
        b.select(unit, F.col("pred").alias("pred_b")), unit
    )
    r2 = group_identity_r2(both, ["actual", "pred_a", "pred_b"], group)

    def pick(q):
        return F.max(F.when(F.col("quantity") == q, F.col("group_r2")))

    s = r2.agg(pick("actual").alias("r2_truth"), pick("pred_a").alias("r2_a"), pick("pred_b").alias("r2_b"))
    return s.select(
        "*",
        (F.col("r2_a") - F.col("r2_truth")).alias("excess_a"),
        (F.col("r2_b") - F.col("r2_truth")).alias("excess_b"),
        F.try_divide(F.col("r2_a") - F.col("r2_b"), F.col("r2_a") - F.col("r2_truth")).alias("excess_removed"),
    )


def paired_run_merge(a: DataFrame, b: DataFrame, group: str = "grp") -> DataFrame:
    """Per-group metrics of two runs side by side with their differences (second minus first)."""
    cols = ["pearson", "spearman", "mae", "bias"]
    left = metrics_panel(a, [group]).select(group, "n", *[F.col(c).alias(f"{c}_a") for c in cols])
    right = metrics_panel(b, [group]).select(group, *[F.col(c).alias(f"{c}_b") for c in cols])
    both = null_safe_join(left, right, [group])
    return both.select(
        "*",
        *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"d_{c}") for c in ("pearson", "spearman", "mae")],
        (F.abs("bias_b") - F.abs("bias_a")).alias("d_abs_bias"),
    )


def gate_scorecard(summary: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Compare a one-row summary with (criterion, rule, threshold) rows; rule is ``min`` or ``max``."""
    names = [c for c in summary.columns]
    long = summary.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value")) for c in names
    ])).alias("_c")).select("_c.*")
    passed = F.when(F.col("rule") == "min", F.col("value") >= F.col("threshold")).otherwise(
        F.col("value") <= F.col("threshold")
    )
    return thresholds.join(long, "criterion", "left").withColumn("pass", F.coalesce(passed, F.lit(False)))


def gate_verdict(card: DataFrame, a: DataFrame, b: DataFrame, tie_margin: float = 0.01) -> DataFrame:
    """Verdict of a score card: the candidate wins when all gates pass and it is not a tie on the headline values."""
    sa = a.select(F.col("macro_r").alias("r_a"), F.col("r2_group_pred").alias("g_a"))
    sb = b.select(F.col("macro_r").alias("r_b"), F.col("r2_group_pred").alias("g_b"))
    one = one_row_join(card.agg(F.bool_and("pass").alias("all_pass"), F.count_if("pass").alias("n_pass")), sa, sb)
    tie = F.col("all_pass") & (F.abs(F.col("r_b") - F.col("r_a")) <= tie_margin) & (
        F.abs(F.col("g_b") - F.col("g_a")) <= tie_margin
    )
    return one.select(
        "all_pass", "n_pass", tie.alias("tie"), F.when(F.col("all_pass") & ~tie, "candidate").otherwise("incumbent").alias("primary")
    )


PARTS = ("part1", "part2", "part3")


def component_summary(df: DataFrame, parts: Sequence[str] = PARTS, group: str = "grp") -> DataFrame:
    """Per group: mean and sd of the parts, total and clipped prediction, offset, MAE and shares of the mean."""
    rows = df.withColumn("pred", clip_floor("pred"))
    err = F.col("pred") - F.col("actual")
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(p).alias(f"mean_{p}") for p in parts],
        *[F.stddev_samp(p).alias(f"sd_{p}") for p in parts],
        F.avg("actual").alias("mean_total"),
        F.stddev_samp("actual").alias("sd_total"),
        F.avg("pred").alias("mean_pred"),
        F.stddev_samp("pred").alias("sd_pred"),
        F.avg(err).alias("offset"),
        F.avg(F.abs(err)).alias("mae"),
        *[F.try_divide(F.avg(p), F.avg("actual")).alias(f"share_{p}") for p in parts],
    )


def identity_check(df: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """How exactly the parts add up to the total."""
    delta = F.col("actual") - sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(delta) > 1e-8).alias("n_mismatch"),
        (F.max(F.abs(delta)) <= 1e-8).alias("identity_holds"),
    )


def variance_shares(df: DataFrame, parts: Sequence[str] = PARTS, group: str = "grp") -> DataFrame:
    """cov(part, total)/var(total) and var(part)/var(total): pooled, within groups (centred), per group and their mean."""
    aggs = [
        F.var_samp("actual").alias("var_total"),
        *[F.try_divide(F.covar_samp(p, "actual"), F.var_samp("actual")).alias(f"share_{p}") for p in parts],
        *[F.try_divide(F.var_samp(p), F.var_samp("actual")).alias(f"var_frac_{p}") for p in parts],
    ]
    flat = centred(df, group, [*parts, "actual"])
    flat = flat.select(group, *[F.col(f"{c}_c").alias(c) for c in (*parts, "actual")])
    per = df.groupBy(group).agg(*aggs).withColumnRenamed(group, "scope")
    pooled = df.agg(*aggs).withColumn("scope", F.lit("pooled"))
    within = flat.agg(*aggs).withColumn("scope", F.lit("within_group"))
    macro = per.agg(*[F.avg(c).alias(c) for c in per.columns if c != "scope"]).withColumn("scope", F.lit("macro"))
    return per.unionByName(pooled).unionByName(within).unionByName(macro)


def component_correlation(df: DataFrame, targets: Sequence[str] = (*PARTS, "actual"), group: str = "grp") -> DataFrame:
    """Pearson and Spearman of the clipped prediction with each part: pooled, centred, per group; long by target."""
    rows = df.withColumn("pred", clip_floor("pred"))
    flat = centred(rows, group, [*targets, "pred"])
    flat = flat.select(F.lit("within_group").alias("scope"), *[F.col(f"{c}_c").alias(c) for c in (*targets, "pred")])
    own = rows.select(F.col(group).alias("scope"), *targets, "pred")
    shape = profile(df, [group])

    def correlations(scoped: DataFrame, like: Profile) -> DataFrame:
        n = F.count(F.lit(1))
        linear = scoped.groupBy("scope").agg(n.alias("n"), *[safe_corr("pred", t).alias(f"pearson_{t}") for t in targets])
        # Apart from the sums, so that a value leaves the rows once it is ranked.
        ranked = midranks(scoped, ["scope"], {"_p": "pred", **{f"_{t}": t for t in targets}}, like)
        return null_safe_join(linear, ranked.groupBy("scope").agg(*[safe_corr("_p", f"_{t}").alias(f"spearman_{t}") for t in targets]), ["scope"])

    whole = own.withColumn("scope", F.lit("pooled")).unionByName(flat)
    return correlations(own, shape).unionByName(correlations(whole, Profile(2, shape.rows, 2 * shape.rows)))


def component_correlation_macro(wide: DataFrame, reserved: Sequence[str] = ("pooled", "within_group")) -> DataFrame:
    """Mean over the per-group rows of each correlation: (statistic, target, macro_mean, groups)."""
    stats = [c for c in wide.columns if c not in ("scope", "n")]
    long = wide.filter(~F.col("scope").isin(*reserved)).unpivot(["scope"], stats, "name", "value")
    parts = F.split("name", "_", 2)
    return (
        long.withColumn("statistic", parts.getItem(0))
        .withColumn("target", parts.getItem(1))
        .groupBy("statistic", "target")
        .agg(F.avg("value").alias("macro_mean"), F.count("value").alias("groups"))
    )


def between_within_corr(df: DataFrame, x: str, y: str, group: str = "grp") -> DataFrame:
    """Pooled, within-group (centred) and between-group-means correlation with n, the p-value of the t law and the normal one."""
    known = pairs(df, x, y)
    flat = centred(known, group, [x, y])
    means = known.groupBy(group).agg(F.avg(x).alias(x), F.avg(y).alias(y))
    n = F.count(F.lit(1))

    def leg(rows, a, b, name):
        return rows.agg(n.alias("n"), F.when(n >= 3, safe_corr(a, b)).alias("r")).withColumn("level", F.lit(name))

    legs = leg(known, x, y, "pooled").unionByName(leg(flat, f"{x}_c", f"{y}_c", "within")).unionByName(
        leg(means, x, y, "between")
    )
    z = F.when((F.col("n") > 3) & (F.abs("r") < 1), F.atanh("r") * F.sqrt(F.greatest(F.col("n") - 3, F.lit(0))))
    return legs.withColumn("p_normal", pnorm_two_sided(z)).withColumn("p_value", correlation_p(F.col("r"), F.col("n")))


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Correlation of x and y given z, from the three pairwise correlations."""
    rows = pairs(df, x, y, z)
    rs = rows.agg(
        F.count(F.lit(1)).alias("n"), safe_corr(x, y).alias("xy"), safe_corr(x, z).alias("xz"), safe_corr(y, z).alias("yz")
    )
    bottom = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return rs.select("n", F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), bottom).alias("partial_r"))


def offset_by_group(df: DataFrame, parts: Sequence[str] = PARTS, group: str = "grp") -> DataFrame:
    """Component summary with the mean covariates and their known counts, largest offset first."""
    base = component_summary(df, parts, group)
    extra = df.groupBy(group).agg(
        F.avg("covariate").alias("mean_covariate"), F.count("covariate").alias("n_covariate"), F.avg("covariate2").alias("mean_covariate2")
    )
    keep = [group, "n", "offset", "mae", "mean_total", "mean_pred", *[f"mean_{p}" for p in parts], *[f"share_{p}" for p in parts]]
    return null_safe_join(base.select(*keep), extra, [group]).orderBy(F.col("offset").desc(), group)


def offset_correlations(groups: DataFrame, terms: Sequence[str], offset: str = "offset") -> DataFrame:
    """The offset, and its size, against group-level terms: Pearson with Fisher limits and the p-value of the t law, Spearman, normal p-value."""
    long = groups.withColumn("_abs", F.abs(offset)).select(
        F.explode(F.array(*[
            F.struct(F.lit(f"{kind}~{t}").alias("term"), F.col(c).alias("y"), F.col(t).cast("double").alias("x"))
            for kind, c in (("offset", offset), ("abs_offset", "_abs"))
            for t in terms
        ])).alias("_r")
    ).select("_r.*")
    ranked = midranks(pairs(long, "x", "y"), ["term"], {"_rx": "x", "_ry": "y"})
    out = ranked.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_groups"), safe_corr("x", "y").alias("pearson"), safe_corr("_rx", "_ry").alias("spearman")
    )
    lo, hi = fisher_ci("pearson", "n_groups")
    z = F.atanh("pearson") * F.sqrt(F.greatest(F.col("n_groups") - 3, F.lit(0)))
    return out.withColumn("fisher_lo", lo).withColumn("fisher_hi", hi).withColumn("p_normal", pnorm_two_sided(z)).withColumn(
        "p_value", correlation_p(F.col("pearson"), F.col("n_groups"))
    )


def wilcoxon_signed_rank(df: DataFrame, difference: str) -> DataFrame:
    """Paired signed-rank test over groups: W+, the normal approximation with tie correction and its p-value.

    ``p_value`` is exact for up to ``COUNTED`` groups without ties or zeros, else the normal one.
    """
    zeros = df.agg(F.count_if(F.col(difference) == 0).alias("_zeros"))
    rows = df.filter(F.col(difference).isNotNull() & (F.col(difference) != 0)).withColumn("_a", F.abs(difference))
    ranked = midrank(rows, [], "_a", "_r")
    ties = rows.groupBy("_a").agg(F.count(F.lit(1)).alias("t")).agg(
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("_ties")
    )
    w = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col(difference) > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus")
    )
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    shift = F.col("w_plus") - mean
    z = F.try_divide(shift - F.signum(shift) * 0.5, F.sqrt(var))
    out = one_row_join(one_row_join(w, ties), zeros).withColumn("z_normal", z).withColumn("p_normal", pnorm_two_sided(z))
    exact = (F.col("n") <= COUNTED) & (F.coalesce("_ties", F.lit(0)) == 0) & (F.col("_zeros") == 0)
    p = F.when(exact, signed_rank_p(F.col("w_plus"), F.col("n"))).otherwise(F.col("p_normal"))
    return out.withColumn("p_value", p).drop("_ties", "_zeros")


def group_covariates(df: DataFrame, group: str = "grp") -> DataFrame:
    """Label-free description of each group: n, mean and sd of prediction and covariate, mean OOD score; unknown sd is 0."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("pred").alias("mean_pred"),
        F.coalesce(F.stddev_samp("pred"), F.lit(0.0)).alias("sd_pred"),
        F.avg("covariate").alias("mean_covariate"),
        F.coalesce(F.stddev_samp("covariate"), F.lit(0.0)).alias("sd_covariate"),
        F.avg("ood_score").alias("mean_ood"),
    )


def published_value_check(table: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """Long (name, value) against expected (name, expected): difference and agreement, missing names included."""
    return expected.join(table, "name", "left").select(
        "name", "value", "expected",
        F.coalesce(F.abs(F.col("value") - F.col("expected")) <= tolerance, F.lit(False)).alias("agrees"),
    )


def recompute_integrity(computed: DataFrame, stored: DataFrame, keys: Sequence[str], cols: Sequence[str], tolerance: float) -> DataFrame:
    """Largest difference per metric between a recomputed and a stored table (a missing row counts as a mismatch)."""
    both = computed.select(*keys, *[F.col(c).alias(f"{c}_new") for c in cols]).join(
        stored.select(*keys, *[F.col(c).alias(f"{c}_old") for c in cols]), list(keys), "full"
    )
    cells = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.abs(F.col(f"{c}_new") - F.col(f"{c}_old")).alias("delta"),
                 (F.col(f"{c}_new").eqNullSafe(F.col(f"{c}_old"))).alias("same")) for c in cols
    ])
    long = both.select(F.explode(cells).alias("_c")).select("_c.*")
    bad = F.count_if(~(F.col("same") | F.coalesce(F.col("delta") <= tolerance, F.lit(False))))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), bad.alias("n_mismatch"), F.max("delta").alias("max_delta"))


def generalization_gradient(centroids: DataFrame, panel: DataFrame, performance: str = "mae", group: str = "grp") -> DataFrame:
    """Distance of each group's feature centroid from the mean centroid of the others, and performance regressed on it.

    ``centroids`` is (group, feature, m). The mean of the others is the feature total without the own value, so
    groups are not paired.
    """
    total = centroids.groupBy("feature").agg(F.sum("m").alias("_s"), F.count("m").alias("_g"))
    d = centroids.join(total, "feature")
    gap = F.col("m") - F.try_divide(F.col("_s") - F.col("m"), F.col("_g") - 1)
    dist = d.groupBy(group).agg(F.sqrt(F.sum(gap * gap)).alias("distance"))
    rows = null_safe_join(dist, panel.select(group, performance), [group])
    return rows.agg(
        F.count(F.lit(1)).alias("groups"),
        safe_slope(performance, "distance").alias("slope"),
        safe_corr(performance, "distance").alias("r"),
        F.avg("distance").alias("mean_distance"),
    )


def group_order_by_median(df: DataFrame, value: str, group: str = "grp") -> DataFrame:
    """Groups in the order of their median."""
    med = quantiles(df, [group], value, {"median": 0.5})
    return med.orderBy("median", group)


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Equal-width counts on [low, high] (right end included) with densities."""
    width = (high - low) / bins
    inside = df.filter(F.col(value).between(low, high))
    b = F.least(F.floor((F.col(value) - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all")).withColumn("_one", F.lit(1))
    return (
        counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
        .select("bin", "n", (F.col("n") / (F.col("_all") * F.lit(width))).alias("density"))
    )


def square_bin_counts(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """2-D counts on square bins."""
    bx, by = F.floor(F.col(x) / F.lit(width)), F.floor(F.col(y) / F.lit(width))
    return df.dropna(subset=[x, y]).groupBy(bx.alias("bx"), by.alias("by")).agg(F.count(F.lit(1)).alias("n"))


def component_long(df: DataFrame, unit: str = "id", parts: Sequence[str] = PARTS) -> DataFrame:
    """Parts to long form with their fixed order."""
    long = df.unpivot([unit], list(parts), "component", "value")
    order = F.create_map(*[x for i, p in enumerate(parts) for x in (F.lit(p), F.lit(i + 1))])
    return long.withColumn("component_order", order[F.col("component")])


def sample_projection_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows of a projection, sorted."""
    return df.select(*cols).distinct().orderBy(*cols)

