"""Ordered operators: ranks, percentiles, folds, holdouts, selections, interpolation.

Random choices are hash-ordered (md5 of seed and id), so a rerun, a lost executor or another engine makes
the same choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heldout.functions.scalars import draw_key, qnorm
from heldout.operators.fold_fits import fold_isotonic, interpolate
from heldout.plans.skew import (
    attach, broadcast_rows, cumulate, group_attach, hot_rows, midrank, null_safe_join, number_rows, profile, quantiles,
)


def within_group_percentile(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(midrank - 1/2) / n inside the group, for rows with a value."""
    known = df.dropna(subset=[value])
    like = profile(known, keys)
    ranked = group_attach(midrank(known, keys, value, "_r", like), keys, [F.count(F.lit(1)).alias("_n")], like)
    return ranked.withColumn(out, (F.col("_r") - 0.5) / F.col("_n")).drop("_r", "_n")


def relative_target(df: DataFrame, kind: str = "centered", group: str = "grp", value: str = "actual", out: str = "target") -> DataFrame:
    """The label relative to its group: ``centered`` on the group mean, or ``normal_score`` of the midrank.

    A constant group gives 0 for all its rows.
    """
    if kind == "centered":
        rows = group_attach(df, [group], [F.avg(value).alias("_m")])
        return rows.withColumn(out, F.col(value) - F.col("_m")).drop("_m")
    if kind != "normal_score":
        raise ValueError(f"unknown relative target: {kind}")
    like = profile(df, [group])
    ranked = group_attach(
        midrank(df, [group], value, "_r", like),
        [group],
        [F.count(value).alias("_n"), (F.max(value) == F.min(value)).alias("_const")],
        like,
    )
    share = (F.col("_r") - 0.5) / F.col("_n")
    share = F.least(F.greatest(share, 0.5 / F.col("_n")), 1 - 0.5 / F.col("_n"))
    return ranked.withColumn(out, F.when(F.col("_const"), 0.0).otherwise(qnorm(share))).drop("_r", "_n", "_const")


def within_group_zscore(df: DataFrame, group: str = "grp", value: str = "actual", out: str = "z") -> DataFrame:
    """(y - mean) / sd inside the group; 0 for a constant or single-row group."""
    rows = group_attach(df, [group], [F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")])
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), z)).drop("_m", "_s")


def group_center(df: DataFrame, group: str = "grp", value: str = "actual", out: str = "centred") -> DataFrame:
    return relative_target(df, "centered", group, value, out)


def gather_by_label(df: DataFrame, stats: DataFrame, group: str = "grp") -> DataFrame:
    """Give every row its group's row of ``stats``."""
    return attach(df, stats, [group])


def group_weights(df: DataFrame, mode: str = "group", group: str = "grp", out: str = "weight") -> DataFrame:
    """``sample``: weight 1. ``group``: equal total weight per group, rescaled to sum to the number of rows."""
    if mode == "sample":
        return df.withColumn(out, F.lit(1.0))
    if mode != "group":
        raise ValueError(f"unknown weight mode: {mode}")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_groups")).withColumn("_one", F.lit(1))
    weights = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(
        group, (F.col("_all") / (F.col("_n") * F.col("_groups"))).alias(out)
    )
    return attach(df, weights, [group], profile(df, [group]).groups)


def group_quantile_flag(df: DataFrame, q: float = 0.75, group: str = "grp", value: str = "actual", out: str = "high") -> DataFrame:
    """True for rows above their group's q-quantile."""
    cut = quantiles(df, [group], value, {"_cut": q})
    rows = attach(df, cut, [group], profile(df, [group]).groups)
    return rows.withColumn(out, F.col(value) > F.col("_cut")).drop("_cut")


def group_fold_id(df: DataFrame, group: str = "grp", unit: str = "id", seed: int = 0, out: str = "fold") -> DataFrame:
    """Fold = position of the group in sorted order; with fewer than 3 groups a balanced random 3-fold over rows."""
    shape = profile(df, [group])
    if shape.groups >= 3:
        folds = number_rows(df.select(group).distinct(), [], [group], out)
        return attach(df, folds, [group], shape.groups)
    if shape.rows < 9:
        raise ValueError("the row fallback needs at least 9 rows")
    dealt = number_rows(df.withColumn("_h", draw_key(seed, unit)), [], ["_h", unit], "_rn")
    return dealt.withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(3)) + 1).drop("_h", "_rn")


def stratified_folds(df: DataFrame, k: int, group: str = "grp", unit: str = "id", seed: int = 0, out: str = "fold") -> DataFrame:
    """Deal the hash-ordered rows of each stratum to k folds."""
    dealt = number_rows(df.withColumn("_h", draw_key(seed, unit)), [group], ["_h", unit], "_rn", profile(df, [group]))
    return dealt.withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(k)) + 1).drop("_h", "_rn")


def stratified_holdout(
    df: DataFrame, share: float = 0.2, group: str = "grp", unit: str = "id", seed: int = 0, out: str = "holdout"
) -> DataFrame:
    """Mark floor(share * n) rows of each group, at least one, by hash order."""
    like = profile(df, [group])
    dealt = number_rows(df.withColumn("_h", draw_key(seed, unit)), [group], ["_h", unit], "_rn", like)
    sized = group_attach(dealt, [group], [F.count(F.lit(1)).alias("_n")], like)
    take = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") * F.lit(share)))
    return sized.withColumn(out, F.col("_rn") <= take).drop("_h", "_rn", "_n")


def limit_per_group(df: DataFrame, n: int, unit: str, group: str | None = None) -> DataFrame:
    """All rows of the first n units (in order) of each group, or of the table."""
    keys = [group] if group else []
    units = number_rows(df.select(*keys, unit).distinct(), keys, [unit], "_rn")
    chosen = units.filter(F.col("_rn") <= n).select(*keys, unit)
    if keys:
        return null_safe_join(df, chosen, [*keys, unit], "left_semi")
    return df.join(F.broadcast(chosen) if n <= broadcast_rows(df.sparkSession) else chosen, [unit], "left_semi")


def cap_sample(df: DataFrame, n: int = 500, unit: str = "id", seed: int = 0) -> DataFrame:
    """At most n rows by hash order, returned in unit order (the display sample)."""
    chosen = df.withColumn("_h", draw_key(seed, unit)).orderBy("_h", unit).limit(n).drop("_h")
    return chosen.orderBy(unit)


def select_ids_ordered(df: DataFrame, ids: Sequence, unit: str = "id") -> tuple[DataFrame, DataFrame]:
    """Requested ids in request order without repeats, and those not present."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(
        [(pos, i) for pos, i in enumerate(dict.fromkeys(ids))], f"request_pos int, {unit} {df.schema[unit].dataType.simpleString()}"
    )
    found = df.join(F.broadcast(wanted), unit).orderBy("request_pos")
    present = df.select(unit).join(F.broadcast(wanted), unit, "left_semi").distinct()
    return found, wanted.join(present, unit, "left_anti")


def calibration_knots(df: DataFrame, score: str, max_knots: int = 501) -> DataFrame:
    """Percentile curve of a score: at most ``max_knots`` evenly spaced order statistics with p = (i - 1/2)/n.

    Duplicate scores keep their first knot; fewer than 5 scores give no curve.
    """
    known = df.dropna(subset=[score]).select(F.col(score).alias("score"))
    cells = known.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    cells = cumulate(cells, [], ["score"], ["n"], profile(known, []))
    total = cells.agg(F.sum("n").alias("_n")).withColumn("_one", F.lit(1))
    sized = cells.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").filter("_n >= 5")
    first, last, n = F.col("n_before") + 1, F.col("n_before") + F.col("n"), F.col("_n")

    # knot j (0-based) sits at order statistic round(1 + j*(n-1)/(max-1)); a value is kept when a knot falls on it
    step = (n - 1) / F.lit(float(max_knots - 1))
    guess = F.floor((first - 1) / step)
    candidates = F.array(*[F.bround(1 + (guess + d) * step) for d in (-1, 0, 1, 2)])
    hits = F.filter(candidates, lambda c: (c >= first) & (c <= last) & (c <= n))
    at = F.when(n <= max_knots, first.cast("double")).when(F.size(hits) > 0, F.array_min(hits).cast("double"))
    return sized.select("score", ((at - 0.5) / n).alias("percentile")).filter("percentile IS NOT NULL")


def bracket_interpolate(df: DataFrame, knots: DataFrame, x: str, out: str, knot_x: str = "score", knot_y: str = "percentile") -> DataFrame:
    """Piecewise-linear lookup of x among knots, constant outside.

    The knots are a bounded list (at most a few hundred), folded to one broadcast array; each row finds its
    bracket inside the array, so rows are neither shuffled nor paired with all knots.
    """
    curve = knots.agg(F.sort_array(F.collect_list(F.struct(F.col(knot_x).alias("x"), F.col(knot_y).alias("y")))).alias("_k"))
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(curve.withColumn("_one", F.lit(1))), "_one").drop("_one")
    xs = F.col(x)
    pos = F.size(F.filter("_k", lambda k: k["x"] <= xs))
    lo, hi = F.get(F.col("_k"), pos - 1), F.get(F.col("_k"), pos)
    inside = lo["y"] + (hi["y"] - lo["y"]) * (xs - lo["x"]) / (hi["x"] - lo["x"])
    value = (
        F.when(xs.isNull() | (F.size("_k") < 2), None)
        .when(pos == 0, hi["y"])
        .when(pos == F.size("_k"), lo["y"])
        .otherwise(inside)
    )
    return rows.withColumn(out, value).drop("_k")


def isotonic_weighted(df: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """Knots of the weighted non-decreasing fit of y on x; equal x values are pooled by weight first, rows without weight take no part.

    ``apply_isotonic`` predicts by linear interpolation, flat outside the range.
    """
    return fold_isotonic(df, x, y, weight, group=None)


def apply_isotonic(knots: DataFrame, df: DataFrame, x: str, out: str) -> DataFrame:
    return interpolate(df, knots, x, out)


def argmin_row(df: DataFrame, keys: Sequence[str], loss: str, order: Sequence[str]) -> DataFrame:
    """The row with the least loss per key; ties go to the first in ``order``."""
    others = [c for c in df.columns if c not in keys]
    pick = F.min(F.struct(loss, *[F.col(o) for o in order], *[F.col(c).alias(f"_{c}") for c in others]))
    known = df.dropna(subset=[loss])
    best = known.groupBy(*keys).agg(pick.alias("_b")) if keys else known.agg(pick.alias("_b"))
    return best.select(*keys, *[F.col(f"_b._{c}").alias(c) for c in others])


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``, as a map-side combined minimum."""
    others = [c for c in df.columns if c not in keys]
    pick = F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *others)).alias("_b")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others])


def score_rank_order(df: DataFrame, score: str, unit: str = "id", out: str = "position") -> DataFrame:
    """Position by score (ties by unit) and whether the score is positive."""
    return number_rows(df, [], [score, unit], out).withColumn("positive", F.col(score) > 0)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add ``prev_<c>`` from the preceding row of the same key (order unique inside a key).

    A key too large for one task is numbered in slices and each row joined to the number before it.
    """
    if profile(df, keys).largest <= hot_rows(df.sparkSession):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols])
    numbered = number_rows(df, keys, order, "_rn")
    before = numbered.select(*keys, (F.col("_rn") + 1).alias("_rn"), *[F.col(c).alias(f"prev_{c}") for c in cols])
    return null_safe_join(numbered, before, [*keys, "_rn"], "left").drop("_rn")


def head_tail(df: DataFrame, by: str, n: int, tie: str, larger_is_better: bool) -> DataFrame:
    """The n best and n worst rows of a report; for a loss the smallest are the best."""
    high = df.orderBy(F.col(by).desc_nulls_last(), tie).limit(n).withColumn("side", F.lit("best" if larger_is_better else "worst"))
    low = df.orderBy(F.col(by).asc_nulls_last(), tie).limit(n).withColumn("side", F.lit("worst" if larger_is_better else "best"))
    return high.unionByName(low)


def first_n(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows in a fixed order (smoke runs)."""
    return df.orderBy(*order).limit(n)
