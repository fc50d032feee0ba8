"""Rank-based gene-set scores and the id handling in front of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.plans.skew import attach, midrank, number_rows


def resolve_gene_ids(df: DataFrame, column: str = "raw_id") -> DataFrame:
    """Detect the id type from the whole column, then normalise: adds ``id_type``, ``gene_id`` and ``valid``.

    Types: ``compound`` (symbol|entrez), ``ensembl`` (version dropped), ``entrez`` (all numeric), else ``symbol``. Empty ids say
    nothing about the type and are not valid; what else is valid depends on the type. The type is one aggregated row, broadcast.
    Ids that coincide after this are found by ``gene_id_duplicates``.
    """
    c = F.trim(F.col(column))
    given = F.when(c != "", c)
    # The forms of the id types.
    kinds = df.agg(
        F.bool_and(given.rlike(r"^[^|]*\|[0-9]+$")).alias("_compound"),
        F.bool_and(given.rlike(r"^ENSG[0-9]+(\.[0-9]+)?$")).alias("_ensembl"),
        F.bool_and(given.rlike(r"^[0-9]+$")).alias("_entrez"),
    ).withColumn("_one", F.lit(1))
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(kinds), "_one").drop("_one")
    kind = (
        F.when(F.col("_compound"), "compound").when(F.col("_ensembl"), "ensembl").when(F.col("_entrez"), "entrez").otherwise("symbol")
    )
    gene = (
        F.when(F.col("_compound"), F.regexp_extract(c, r"\|([0-9]+)$", 1))
        .when(F.col("_ensembl"), F.regexp_replace(c, r"\.[0-9]+$", ""))
        .otherwise(c)
    )
    named = rows.select(*df.columns, kind.alias("id_type"), gene.alias("gene_id"))
    form = F.when(F.col("id_type").isin("compound", "entrez"), F.col("gene_id").rlike("^[0-9]+$")).when(
        F.col("id_type") == "ensembl", F.col("gene_id").rlike("^ENSG[0-9]+$")
    ).otherwise(~F.col("gene_id").isin("", "?"))
    return named.withColumn("valid", F.coalesce(form, F.lit(False)))


def gene_id_duplicates(resolved: DataFrame) -> DataFrame:
    """Valid ids that several rows share after normalising: gene_id, n."""
    return resolved.filter("valid").groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def gene_row_audit(df: DataFrame, values: str = "x", valid: str = "valid") -> DataFrame:
    """Status of each gene row over its array of values: retained or why not."""
    known = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    flat = F.forall(values, lambda v: v == F.element_at(values, 1))
    status = (
        F.when(~F.col(valid), "invalid_gene_id")
        .when(~known, "missing_or_nonfinite")
        .when(flat, "constant")
        .otherwise("retained")
    )
    return df.withColumn("status", status)


def ssgsea(long: DataFrame, sets: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Unnormalised single-sample enrichment of each set: (id, set_name, score).

    Genes are walked from high to low; the score is the sum over all positions of the weighted share of set genes
    met less the share of other genes met. That sum needs each gene's position only: a gene at position p counts
    for the N - p + 1 positions from there on. Ties share their average rank as weight and go by name.
    ``sets`` is (set_name, feature) inside the measured features.
    """
    ranked = midrank(long.filter("value IS NOT NULL"), ["id"], "value", "_rank")
    placed = number_rows(ranked, ["id"], [F.col("value").desc(), F.col("feature")], "_pos")
    sized = long.filter("value IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    j = placed.join(sized, "id").select("id", "feature", "_rank", (F.col("_n") - F.col("_pos") + 1).alias("_span"), "_n")
    whole = j.groupBy("id").agg(F.sum("_span").alias("_all"), F.max("_n").alias("_n"))
    members = attach(j.drop("_n"), sets.groupBy("feature").agg(F.collect_set("set_name").alias("_sets")), ["feature"], how="inner")
    hit = members.withColumn("set_name", F.explode("_sets")).withColumn("_w", F.pow("_rank", F.lit(alpha)))
    inside = hit.groupBy("id", "set_name").agg(
        F.sum(F.col("_w") * F.col("_span")).alias("_in"), F.sum("_w").alias("_wsum"), F.sum("_span").alias("_span_in"), F.count(F.lit(1)).alias("_m")
    )
    out = inside.join(whole, "id")
    score = F.col("_in") / F.col("_wsum") - F.try_divide(F.col("_all") - F.col("_span_in"), F.col("_n") - F.col("_m"))
    return out.select("id", "set_name", score.alias("score"))


def ssgsea_difference(scores: DataFrame, positive: str, negative: str) -> DataFrame:
    """Positive minus negative set score per sample."""
    pick = lambda s: F.max(F.when(F.col("set_name") == s, F.col("score")))
    return scores.groupBy("id").agg(pick(positive).alias("positive"), pick(negative).alias("negative")).withColumn(
        "difference", F.col("positive") - F.col("negative")
    )


def set_overlap(sets: DataFrame) -> DataFrame:
    """Features that belong to more than one set (must be empty)."""
    return sets.groupBy("feature").agg(F.count_distinct("set_name").alias("n_sets")).filter("n_sets > 1")

