"""Validation and governance. Each check returns a table of violations; ``enforce`` stops on a non-empty one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.functions.scalars import clip_floor


class GateError(ValueError):
    """A gate refused the input."""


def enforce(violations: DataFrame, what: str) -> None:
    """Raise with the first few violations if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise GateError(f"{what}: {[r.asDict() for r in found]}")


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    """Schema check on the driver; no data is read."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise GateError(f"missing columns: {missing}")


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_label_identity(df: DataFrame, total: str, parts: Sequence[str], unit: str = "id", tolerance: float = 1e-6) -> DataFrame:
    """Rows whose label is unknown, negative, or not the sum of its parts."""
    known = F.col(total).isNotNull()
    for p in parts:
        known = known & F.col(p).isNotNull()
    s = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    rule = (
        F.when(~known, "unknown")
        .when(F.col(total) < 0, "negative")
        .when(F.abs(F.col(total) - s) > tolerance, "sum_mismatch")
    )
    return df.select(unit, rule.alias("violation")).filter("violation IS NOT NULL")


def check_quality_vocab(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """One row per kind of problem in an annotation column: blank, unknown word, or the same word everywhere."""
    text = F.trim(F.col(column))
    blank = text.isNull() | (text == "")
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(blank).alias("blank"),
        F.count_if(~blank & ~text.isin(*allowed)).alias("unknown"),
        (F.count_distinct(text) == 1).cast("long").alias("blanket"),
    )
    long = facts.unpivot(["n"], ["blank", "unknown", "blanket"], "violation", "count")
    return long.filter("count > 0").select("violation", "count", F.when(F.col("violation") == "blanket", "warning").otherwise("error").alias("severity"))


def check_partition_agreement(
    df: DataFrame, locked: Sequence[str], group: str = "grp", partition: str = "partition",
    locked_label: str = "locked", development_label: str = "development",
) -> DataFrame:
    """Disagreement between the locked list and the partition column, by group and kind, in one pass."""
    require_columns(df, [group, partition])
    p, listed = F.trim(F.col(partition)), F.coalesce(F.col(group).isin(*locked), F.lit(False))
    kind = (
        F.when(p.isNull() | (p == ""), "blank")
        .when(~p.isin(locked_label, development_label), "unknown_label")
        .when(listed & (p != locked_label), "listed_but_open")
        .when(~listed & (p == locked_label), "locked_but_not_listed")
    )
    return df.select(group, kind.alias("violation")).filter("violation IS NOT NULL").groupBy(group, "violation").agg(
        F.count(F.lit(1)).alias("n")
    )


def keep_development(df: DataFrame, locked: Sequence[str], group: str = "grp") -> tuple[DataFrame, DataFrame]:
    """Development rows, and a one-row report of how many were kept and dropped."""
    is_locked = F.coalesce(F.col(group).isin(*locked), F.lit(False))
    report = df.agg(F.count_if(~is_locked).alias("kept"), F.count_if(is_locked).alias("dropped"))
    return df.filter(~is_locked), report


def check_development_only(df: DataFrame, locked: Sequence[str], group: str = "grp") -> DataFrame:
    """Locked groups present in what should be development data."""
    return df.filter(F.col(group).isin(*locked)).groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def check_disjoint_cover(all_units: DataFrame, roles: dict[str, DataFrame], unit: str = "id") -> DataFrame:
    """Units that are in no role, in several, or unknown: (unit, n_roles, violation)."""
    tagged = all_units.select(unit, F.lit(1).alias("_all"), F.lit(0).alias("_role"))
    for df in roles.values():
        tagged = tagged.unionByName(df.select(unit, F.lit(0).alias("_all"), F.lit(1).alias("_role")))
    counts = tagged.groupBy(unit).agg(F.max("_all").alias("_all"), F.sum("_role").alias("n_roles"))
    kind = (
        F.when(F.col("_all") == 0, "unknown")
        .when(F.col("n_roles") == 0, "uncovered")
        .when(F.col("n_roles") > 1, "overlap")
    )
    return counts.select(unit, "n_roles", kind.alias("violation")).filter("violation IS NOT NULL")


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows are only left, only right, and whether the two sets agree (one row)."""
    cols = a.columns
    tagged = a.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(
        b.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    )
    each = tagged.groupBy(*cols).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    left, right = F.count_if(F.col("_r") == 0), F.count_if(F.col("_l") == 0)
    return each.agg(left.alias("only_left"), right.alias("only_right"), ((left + right) == 0).alias("equal"))


def provenance_class(record: DataFrame, override: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Classify a provenance record (no row = absent): verified, engineering fixture, hash missing; allowed or not.

    With ``keys`` there is one class per key.
    """
    facts = record.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.bool_or(F.coalesce(F.col("engineering_only"), F.lit(True))).alias("fixture"),
        F.bool_and(F.coalesce(F.length(F.trim("allowlist_sha256")) > 0, F.lit(False))).alias("hashed"),
    )
    kind = (
        F.when(F.col("records") == 0, "absent")
        .when(F.col("fixture"), "engineering_fixture")
        .when(~F.col("hashed"), "no_allowlist_hash")
        .otherwise("verified")
    )
    out = facts.select(*keys, kind.alias("provenance"))
    allowed = (F.col("provenance") == "verified") | F.lit(override)
    return out.withColumn("allowed", allowed).withColumn(
        "stamp", F.when(F.col("provenance") == "verified", "verified").when(F.lit(override), F.concat(F.lit("override:"), "provenance"))
    )


def allowlist_match(model_hash: Column, matrix_hash: Column) -> Column:
    """Do model and matrix come from the same allow-list?"""
    return (
        F.when(model_hash.isNull() | matrix_hash.isNull(), "unknown")
        .when(model_hash == matrix_hash, "matched")
        .otherwise("MISMATCH")
    )


def locked_scoring_guard(scored: DataFrame, samples: DataFrame | None, opted_in: bool, unit: str = "id", partition: str = "partition") -> DataFrame:
    """Why scoring must be refused: locked rows without opt-in, samples without metadata, opt-in without metadata."""
    if samples is None:
        reason = F.lit("opt_in_without_metadata") if opted_in else F.lit("no_metadata")
        return scored.agg(F.count(F.lit(1)).alias("n")).select(reason.alias("violation"), "n").filter("n > 0")
    joined = scored.select(unit).join(samples.select(unit, partition, F.lit(True).alias("_known")), unit, "left")
    kind = F.when(F.col("_known").isNull(), "unknown_sample").when(
        (F.col(partition) == "locked") & ~F.lit(opted_in), "locked_without_opt_in"
    )
    return joined.select(kind.alias("violation")).filter("violation IS NOT NULL").groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def fold_completeness(expected: DataFrame, predictions: DataFrame, metrics: DataFrame, folds: DataFrame, protocol: str = "protocol") -> DataFrame:
    """Every expected fold is in all three outputs, has one metrics row, the same n, and one protocol overall."""
    p = predictions.groupBy("fold").agg(F.count(F.lit(1)).alias("n_pred"))
    m = metrics.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_metric_rows"), F.max("n").alias("n_metric"), F.min(protocol).alias("protocol")
    )
    f = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_fold_rows"))
    wide = expected.select("fold").join(p, "fold", "full").join(m, "fold", "full").join(f, "fold", "full")
    known = expected.select("fold", F.lit(True).alias("_expected"))
    wide = wide.join(known, "fold", "left")
    main = metrics.groupBy(protocol).agg(F.count(F.lit(1)).alias("c")).agg(F.max_by(protocol, "c").alias("_main")).withColumn("_one", F.lit(1))
    wide = wide.withColumn("_one", F.lit(1)).join(F.broadcast(main), "_one")
    kind = (
        F.when(F.col("_expected").isNull(), "unexpected_fold")
        .when(F.col("n_pred").isNull(), "no_predictions")
        .when(F.col("n_metric_rows").isNull(), "no_metrics")
        .when(F.col("n_fold_rows").isNull(), "no_fold_table")
        .when(F.col("n_metric_rows") != 1, "metrics_not_unique")
        .when(F.col("n_metric") != F.col("n_pred"), "n_disagrees")
        .when(F.col("protocol") != F.col("_main"), "protocol_differs")
    )
    return wide.select("fold", kind.alias("violation")).filter("violation IS NOT NULL")


def clip_rule_gate(df: DataFrame, rule: str = "clip_rule", pred: str = "pred", prefix: str = "floor") -> DataFrame:
    """The clipping rule is there, single, starts with ``prefix``, and no prediction is negative."""
    facts = df.agg(
        F.count_if(F.col(rule).isNull()).alias("rule_missing"),
        F.greatest(F.count_distinct(rule) - 1, F.lit(0).cast("long")).alias("several_rules"),
        F.count_if(~F.col(rule).startswith(prefix)).alias("rule_unknown"),
        F.count_if(F.col(pred) < 0).alias("negative_predictions"),
    )
    return facts.unpivot([], facts.columns, "violation", "n").filter("n > 0")


def cohort_gate(df: DataFrame, required: Sequence[str], locked: Sequence[str], group: str = "grp", partition: str = "partition") -> DataFrame:
    """A locked evaluation: all rows locked, every required group present, both partition sources agree."""
    by_list = F.coalesce(F.col(group).isin(*locked), F.lit(False))
    by_column = F.coalesce(F.col(partition) == "locked", F.lit(False))
    facts = df.agg(
        F.count_if(~by_column).alias("not_locked"),
        F.count_if(by_list != by_column).alias("sources_disagree"),
        *[F.when(F.count_if(F.col(group) == g) == 0, 1).otherwise(0).cast("long").alias(f"absent:{g}") for g in required],
    )
    return facts.unpivot([], facts.columns, "violation", "n").filter("n > 0")


def minimum_cohort_gate(df: DataFrame, groups: int = 3, rows: int = 50, group: str = "grp") -> DataFrame:
    """Too few groups or rows to train."""
    facts = df.agg(F.count_distinct(group).alias("groups"), F.count(F.lit(1)).alias("rows"))
    return facts.filter((F.col("groups") < groups) | (F.col("rows") < rows))


def map_conflict_check(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def membership(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``a`` whose key is in ``b``, and those whose key is not."""
    keys = b.select(key).distinct()
    return a.join(keys, key, "left_semi"), a.join(keys, key, "left_anti")


def lambda_boundary(tuning: DataFrame, selected: DataFrame) -> DataFrame:
    """How many folds picked an end of their penalty path (1e-8 relative); warn above half."""
    ends = tuning.groupBy("fold", "alpha").agg(F.max("lambda").alias("hi"), F.min("lambda").alias("lo"))
    at = selected.join(ends, ["fold", "alpha"])

    def near(end):
        return F.abs(F.col("lambda") - F.col(end)) <= 1e-8 * F.abs(F.col(end))

    out = at.agg(
        F.count(F.lit(1)).alias("folds"), F.count_if(near("hi")).alias("at_top"), F.count_if(near("lo")).alias("at_bottom")
    )
    return out.withColumn("warn", (F.col("at_top") + F.col("at_bottom")) * 2 > F.col("folds"))


def clip_and_stamp(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Clip at zero, keep the raw value, mark the clipped rows and stamp the rule."""
    return df.select(
        "*",
        F.col(pred).alias(f"{pred}_raw"),
        F.coalesce(F.col(pred) < 0, F.lit(False)).alias("clipped"),
        F.lit("floor_at_zero").alias("clip_rule"),
    ).withColumn(pred, clip_floor(pred))
