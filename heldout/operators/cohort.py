"""Cohort construction: cardinality-checked joins that keep one reason per rejected row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.functions.scalars import alias_values, draw_key, first_match, parse_barcode, safe_number, title_key, truthy
from heldout.plans.skew import null_safe_join, number_rows, profile, quantiles

INCLUDED = "included"
EXCLUDED = "excluded"


def unique_primary_count(meta: DataFrame, patient: str = "patient_id", kind: str = "kind") -> DataFrame:
    """Attach the number of primary specimens (kind 01) of each patient."""
    counts = meta.groupBy(patient).agg(F.count_if(F.col(kind) == "01").alias("n_primary"))
    return meta.join(counts, patient, "left")


def audited_join(
    meta: DataFrame, labels: DataFrame, types: DataFrame, quality: DataFrame, purity: DataFrame,
    parts: Sequence[str] = ("loh", "lst", "tai"), total: str = "total", platform: str = "methylation450",
    locked: Sequence[str] = ("GBM", "LGG"),
) -> tuple[DataFrame, DataFrame]:
    """Join candidates to labels, types, quality and purity; returns (kept, audit).

    Inputs: meta(patient_id, sample_id, cancer_type, …), labels(sample, parts…, total), types(sample, cancer_type),
    quality(aliquot, platform, do_not_use, pathology_excluded), purity(sample, purity, ploidy). Every side is
    reduced to one row per key with its cardinality before the join, so no join multiplies rows and an ambiguous
    match is excluded and never averaged. The audit has every candidate with the first rule that rejects it.
    """
    m = meta.withColumn("_b", parse_barcode("sample_id"))
    m = m.withColumn("_bad", F.col("_b").isNull()).select(
        "*", F.col("_b.patient").alias("_patient"), F.col("_b.key").alias("_key"), F.col("_b.kind").alias("kind"),
        F.substring("sample_id", 1, 16).alias("_vial"),
    ).drop("_b")
    m = unique_primary_count(m)

    label_cols = [*parts, total]
    lab = labels.groupBy(F.substring("sample", 1, 15).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n_label"), *[F.max(c).alias(f"_{c}") for c in label_cols]
    )
    typ = types.groupBy(F.substring("sample", 1, 12).alias("_patient")).agg(
        F.count_distinct(alias_values("cancer_type")).alias("_n_types"), F.max(alias_values("cancer_type")).alias("_type")
    )
    bad_quality = (F.lower("do_not_use") == "true") | (F.col("pathology_excluded") == "1.0")
    qual = quality.filter(F.lower("platform").contains(platform)).groupBy(
        F.substring("aliquot", 1, 16).alias("_vial")
    ).agg(F.lit(True).alias("_has_quality"), F.bool_or(F.coalesce(bad_quality, F.lit(False))).alias("_bad_quality"))
    pur = purity.groupBy(F.substring("sample", 1, 15).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n_pur"), F.max("purity").alias("_purity"), F.max("ploidy").alias("_ploidy")
    )
    j = m.join(lab, "_key", "left").join(typ, "_patient", "left").join(qual, "_vial", "left").join(pur, "_key", "left")

    values = [safe_number(f"_{c}") for c in label_cols]
    ok = values[0].isNotNull() & (values[0] >= 0)
    for v in values[1:]:
        ok = ok & v.isNotNull() & (v >= 0)
    gap = F.abs(sum(values[1:-1], values[0]) - values[-1])
    reason = first_match([
        (F.col("_bad"), "invalid_barcode"),
        (F.col("_patient") != F.col("patient_id"), "patient_metadata_mismatch"),
        (F.col("kind") != "01", "not_primary_tumor"),
        (F.col("n_primary") != 1, "ambiguous_primary_specimens"),
        (F.coalesce("_n_label", F.lit(0)) != 1, "missing_or_ambiguous_label"),
        (F.coalesce(F.col("cancer_type"), F.lit("")).isin("", "UNRESOLVED"), "missing_group"),
        ((F.col("_n_types") > 1) | (F.col("_type") != F.col("cancer_type")), "conflicting_group"),
        (F.col("_has_quality").isNull(), "missing_quality_annotation"),
        (F.col("_bad_quality"), "quality_excluded"),
        (~ok, "invalid_label"),
        (gap > 1e-6, "part_sum_mismatch"),
    ])
    judged = j.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), INCLUDED).otherwise(EXCLUDED))
    audit = judged.select(*meta.columns, "status", F.coalesce("reason", F.lit("unique_match")).alias("reason"))
    one_purity = F.col("_n_pur") == 1
    kept = judged.filter("reason IS NULL").select(
        *meta.columns,
        *[v.alias(c) for v, c in zip(values, label_cols)],
        F.when(one_purity, safe_number("_purity")).alias("purity"),
        F.when(one_purity, safe_number("_ploidy")).alias("ploidy"),
        F.when(F.col("cancer_type").isin(*locked), "locked").otherwise("development").alias("partition"),
    )
    return kept, audit


def coalesce_group_source(df: DataFrame, authoritative: DataFrame, subtype: DataFrame, key: str) -> DataFrame:
    """Group from the authoritative map, else from a unique subtype, else UNRESOLVED; with the source used."""
    auth = authoritative.groupBy(key).agg(F.max("grp").alias("_auth"))
    sub = subtype.groupBy(key).agg(F.when(F.count_distinct("grp") == 1, F.max("grp")).alias("_sub"))
    j = df.join(auth, key, "left").join(sub, key, "left")
    return j.select(
        *df.columns,
        F.coalesce("_auth", "_sub", F.lit("UNRESOLVED")).alias("grp"),
        F.when(F.col("_auth").isNotNull(), "authoritative").when(F.col("_sub").isNotNull(), "subtype").otherwise("none").alias("grp_source"),
    )


def cohort_five_number(df: DataFrame, value: str, cut: float, group: str = "grp") -> DataFrame:
    """Per group: N, minimum, quartiles, maximum, number at or above a cut (linear quantiles)."""
    five = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) >= cut).alias("n_high"))
    return null_safe_join(counts, quantiles(df, [group], value, five), [group], "left")


def exclusion_counts(audit: DataFrame) -> DataFrame:
    """Histogram of reasons, most frequent first."""
    return audit.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason")


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Blank or NULL values per column, long."""
    facts = df.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in cols])
    return facts.unpivot([], list(cols), "column", "n_missing")


def lookup_align(df: DataFrame, dim: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Attach a unique-key dimension to all rows; also the keys that have none (must be empty to go on)."""
    return df.join(dim, key, "left"), df.join(dim, key, "left_anti").select(key).distinct()


def bridge_join(a: DataFrame, b: DataFrame, key: str = "probe") -> tuple[DataFrame, DataFrame]:
    """Probes shared by two annotations at equal autosomal coordinates with clean masks; kept rows and step counts.

    Inputs have (probe, chromosome, position) and ``masked`` on the second.
    """
    left = a.select(key, F.col("chromosome").alias("chr_a"), F.col("position").alias("pos_a"))
    right = b.select(key, F.col("chromosome").alias("chr_b"), F.col("position").alias("pos_b"), "masked")
    common = left.join(right, key)
    autosome = F.regexp_replace("chr_a", "^chr", "").try_cast("int").between(1, 22)
    same = (F.col("chr_a") == F.col("chr_b")) & (F.col("pos_a") == F.col("pos_b"))
    clean = ~truthy("masked")
    steps = common.agg(
        F.count(F.lit(1)).alias("common"),
        F.count_if(autosome).alias("autosomal"),
        F.count_if(autosome & same).alias("same_coordinates"),
        F.count_if(autosome & same & clean).alias("kept"),
    )
    return common.filter(autosome & same & clean).select(key, F.col("chr_a").alias("chromosome"), F.col("pos_a").alias("position")), steps


def melt_join_dims(wide: DataFrame, unit: str, value_cols: Sequence[str], feature_map: DataFrame, samples: DataFrame) -> DataFrame:
    """Wide (feature, sample columns) to long, then genes (may repeat a row) and sample facts."""
    long = wide.unpivot([unit], list(value_cols), "sample", "value")
    return long.join(feature_map, unit, "left").join(samples, "sample", "left")


def checked_inner_merge(a: DataFrame, b: DataFrame, key: str, group: str = "grp", label: str = "actual", tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Inner join of two tables with their group and label, and one row of agreement facts."""
    right = b.select(key, F.col(group).alias("_g2"), F.col(label).alias("_y2"), *[c for c in b.columns if c not in (key, group, label)])
    j = a.join(right, key)
    facts = j.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col(group).eqNullSafe(F.col("_g2"))).alias("group_mismatch"),
        F.count_if(F.coalesce(F.abs(F.col(label) - F.col("_y2")) > tolerance, F.lit(True))).alias("label_mismatch"),
    )
    return j.drop("_g2", "_y2"), facts


def signature_map(sets: DataFrame, candidates: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Map set members to expressed ids; audit per member and coverage per set.

    sets(set_name, id), candidates(id, candidate), universe(candidate). A member is matched only when exactly one
    candidate is expressed.
    """
    expressed = universe.select("candidate").distinct().withColumn("_in", F.lit(True))
    j = sets.join(candidates.dropDuplicates(["id", "candidate"]), "id", "left").join(expressed, "candidate", "left")
    audit = j.groupBy("set_name", "id").agg(
        F.count("candidate").alias("n_candidates"),
        F.count_if(F.col("_in")).alias("n_expressed"),
        F.array_join(F.array_sort(F.collect_set("candidate")), ";").alias("candidate_ids"),
        F.max(F.when(F.col("_in"), F.col("candidate"))).alias("_hit"),
    )
    status = (
        F.when(F.col("n_expressed") == 1, "matched")
        .when(F.col("n_expressed") > 1, "ambiguous")
        .when(F.col("n_candidates") > 0, "not_in_universe")
        .otherwise("unmapped")
    )
    audit = audit.withColumn("status", status).withColumn("matched_id", F.when(status == "matched", F.col("_hit"))).drop("_hit")
    coverage = audit.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("set_size"),
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_distinct("matched_id").alias("unique_matched"),
        F.try_divide(F.count_distinct("matched_id"), F.count(F.lit(1))).alias("coverage"),
    )
    return audit, coverage


def first_per_key_merge(
    scores: DataFrame, master: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], master_order: Sequence[str]
) -> DataFrame:
    """First score row per key in order, joined to the first non-NULL value per column of the other side in ``master_order``."""
    from heldout.operators.ranking import dedup_first

    first = dedup_first(scores, [key], order)
    # A minimum over (order, value) skips NULLs and does not depend on the partitioning.
    aggs = [F.min(F.when(F.col(c).isNotNull(), F.struct(*master_order, F.col(c).alias("_v"))))["_v"].alias(c) for c in cols]
    return first.join(master.groupBy(key).agg(*aggs), key)


def within_group_pairs(df: DataFrame, per_row: int, group: str = "grp", unit: str = "id", value: str = "actual", seed: int = 0) -> DataFrame:
    """Ordered pairs inside a group with different labels, half of them turned around.

    The sampled mode of pair construction: the rows of a group are put in hash order and each is paired with the
    next ``per_row`` ones, so n rows give at most per_row*n pairs and no group is joined to itself in full. Pairs
    meet on (group, position), a key without skew. Groups no larger than ``per_row`` + 1 get all their pairs.
    """
    dealt = number_rows(
        df.select(group, unit, value).withColumn("_h", draw_key(seed, unit)), [group], ["_h", unit], "_rn", profile(df, [group])
    )
    left = dealt.select(group, F.col(unit).alias("a"), F.col(value).alias("_ya"), F.explode(
        F.sequence(F.col("_rn") + 1, F.col("_rn") + per_row)).alias("_rn"), F.col("_rn").alias("_ra"))
    right = dealt.select(group, "_rn", F.col(unit).alias("b"), F.col(value).alias("_yb"))
    met = null_safe_join(left, right, [group, "_rn"]).filter("_ya <> _yb")
    flip = F.pmod(F.col("_ra") + F.col("_rn"), F.lit(2)) == 0
    want_high_first = ~flip
    is_high_first = F.col("_ya") > F.col("_yb")
    keep = want_high_first == is_high_first
    return met.select(
        group,
        F.when(keep, F.col("a")).otherwise(F.col("b")).alias("i"),
        F.when(keep, F.col("b")).otherwise(F.col("a")).alias("j"),
        want_high_first.cast("int").alias("outcome"),
    )


def logo_prior_join(stats: DataFrame, cols: Sequence[str], group: str = "grp") -> DataFrame:
    """For every group: number, mean and sample variance of each column over all other groups.

    Total minus own value, with the grand mean taken out first for accuracy; groups are never paired.
    """
    centre = stats.agg(*[F.avg(c).alias(f"_c_{c}") for c in cols]).withColumn("_one", F.lit(1))
    rows = stats.withColumn("_one", F.lit(1)).join(F.broadcast(centre), "_one")
    rows = rows.select("*", *[(F.col(c) - F.col(f"_c_{c}")).alias(f"_d_{c}") for c in cols])
    total = rows.agg(
        F.count(F.lit(1)).alias("_g"),
        *[F.sum(f"_d_{c}").alias(f"_s_{c}") for c in cols],
        *[F.sum(F.col(f"_d_{c}") * F.col(f"_d_{c}")).alias(f"_q_{c}") for c in cols],
    ).withColumn("_one", F.lit(1))
    j = rows.join(F.broadcast(total), "_one")
    m = F.col("_g") - 1
    out = [group, m.alias("n_others")]
    for c in cols:
        s = F.col(f"_s_{c}") - F.col(f"_d_{c}")
        q = F.col(f"_q_{c}") - F.col(f"_d_{c}") * F.col(f"_d_{c}")
        out.append((F.col(f"_c_{c}") + F.try_divide(s, m)).alias(f"{c}_mean"))
        out.append(F.when(m > 1, F.greatest((q - s * s / m) / (m - 1), F.lit(0.0))).alias(f"{c}_var"))
    return j.select(*out)


def interval_lookup(points: DataFrame, segments: DataFrame, keys: Sequence[str], x: str, width: int) -> DataFrame:
    """First segment (lowest start) of the same key with start <= x < end; NULL if none.

    Segments are listed under each bin of ``width`` they touch, so this is an equi-join on (key, bin), made once per
    distinct position and given back to all points there.
    """
    seg = segments.select(*keys, "seg_start", "seg_end", *[c for c in segments.columns if c not in (*keys, "seg_start", "seg_end")])
    bins = F.sequence(F.floor(F.col("seg_start") / width), F.floor((F.col("seg_end") - 1) / width))
    listed = seg.withColumn("_bin", F.explode(bins))
    rest = [c for c in seg.columns if c not in (*keys,)]
    p = points.select(*keys, x).distinct().withColumn("_bin", F.floor(F.col(x) / width))
    hit = (F.col(x) >= F.col("seg_start")) & (F.col(x) < F.col("seg_end"))
    met = p.join(listed, [*keys, "_bin"], "left").withColumn("_hit", F.when(hit, F.struct(*rest)))
    found = met.groupBy(*keys, x).agg(F.min("_hit").alias("_b"))
    return points.join(found, [*keys, x], "left").select(*points.columns, *[F.col(f"_b.{c}").alias(c) for c in rest])


def title_key_join(a: DataFrame, b: DataFrame, year: str, title: str) -> DataFrame:
    """Join two title lists on year and normalised title key, each left row with the first right row of its key.

    The right side is reduced to one row per key first, so many copies of a title cannot multiply.
    """
    from heldout.operators.ranking import dedup_first

    left = a.withColumn("title_key", title_key(title))
    right = b.withColumn("title_key", title_key(title)).drop(title)
    rest = [c for c in right.columns if c not in (year, "title_key")]
    return left.join(dedup_first(right, [year, "title_key"], rest[:1]), [year, "title_key"])


def overlay_defaults(df: DataFrame, overlay: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Values from a matched overlay record, else the default of each column."""
    over = overlay.select(key, *[F.col(c).alias(f"_o_{c}") for c in defaults])
    j = df.join(over, key, "left")
    return j.select(*[c for c in df.columns if c not in defaults], *[F.coalesce(F.col(f"_o_{c}"), d).alias(c) for c, d in defaults.items()])

