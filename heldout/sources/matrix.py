"""Readers of feature matrices and the tables around them.

A matrix file has features in rows and samples in columns. It is read as text and split once, so thousands of
columns cost no schema; each row becomes (feature, x) with x an array in header order, and row work needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heldout.functions.scalars import NA_STRINGS, safe_number
from heldout.plans.skew import broadcast_rows


def strict_number(text: Column) -> Column:
    """A number, NULL for a missing marker, and an error for any other text: such a cell must not pass as unknown."""
    number = safe_number(text)
    missing = text.isNull() | F.lower(F.trim(text)).isin(*NA_STRINGS)
    wrong = F.raise_error(F.concat(F.lit("not a number in a matrix cell: "), text)).cast("double")
    return F.when(missing, F.lit(None).cast("double")).when(number.isNotNull(), number).otherwise(wrong)


def header_columns(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """The column names of a text matrix; reads one line."""
    first = spark.read.text(path).first()
    return first[0].lstrip("﻿").rstrip("\r").split(sep) if first else []


def scan_header_only(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(pos, sample) of every sample column, from the header line alone."""
    line = spark.read.text(path).limit(1)
    cells = line.select(F.posexplode(F.split(F.regexp_replace("value", "\r$", ""), re.escape(sep))).alias("pos", "sample"))
    return cells.filter("pos > 0").select((F.col("pos") - 1).alias("pos"), "sample")


def scan_matrix_tsv(spark: SparkSession, path: str, sep: str = "\t", keep: Sequence[int] | None = None) -> DataFrame:
    """Matrix text to (feature, x array<double>); missing markers are NULL, other text in a cell is an error.

    ``keep`` selects sample positions while splitting, so unwanted columns are never parsed. All files of a folder must have the
    header of the first: a line that begins like the header and differs from it is an error.
    """
    header = sep.join(header_columns(spark, path, sep))
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"))
    cells = lines.filter(F.col("value") != header).select("value", F.split("value", re.escape(sep)).alias("c"))
    # Filters may be reordered, so what raises errors tests by itself that it is not on a header line.
    data = F.col("value") != header
    first = F.get("c", F.lit(0))
    other = F.raise_error(F.lit("the files of this matrix have different headers")).cast("string")
    feature = F.when(data & (first == header.split(sep)[0]), other).otherwise(first)
    if keep is None:
        raw = F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0)))
    else:
        raw = F.transform(F.array(*[F.lit(int(p) + 1) for p in keep]), lambda p: F.get("c", p))
    return cells.select(feature.alias("feature"), F.when(data, F.transform(raw, strict_number)).alias("x"))


def matrix_violations(matrix: DataFrame, columns: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Features that occur twice, have the wrong number of columns, or values outside the range."""
    outside = F.exists("x", lambda v: (v < low) | (v > high))
    per = matrix.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(outside, F.lit(False))).alias("_out"), F.bool_or(F.size("x") != columns).alias("_width")
    )
    kind = F.when(F.col("n") > 1, "duplicate").when(F.col("_width"), "column_count").when(F.col("_out"), "out_of_range")
    return per.select("feature", "n", kind.alias("violation")).filter("violation IS NOT NULL")


def row_stats(x: str = "x") -> Column:
    """Struct (n, x0, s, q) of an array column in one walk: known count, first known value, and the sum and sum of
    squares of the differences from it (so a constant row has variance exactly 0)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("x0"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(acc, v):
        d = F.coalesce(v - F.coalesce(acc["x0"], v), F.lit(0.0))
        return F.struct(
            (acc["n"] + v.isNotNull().cast("int")).alias("n"), F.coalesce(acc["x0"], v).alias("x0"),
            (acc["s"] + d).alias("s"), (acc["q"] + d * d).alias("q"),
        )

    return F.aggregate(x, zero, add)


def with_row_stats(matrix: DataFrame) -> DataFrame:
    """Add ``n_known``, ``missing`` (share) and ``var`` (population variance) of each row."""
    rows = matrix.withColumn("_t", row_stats())
    n = F.col("_t.n")
    shift = F.try_divide(F.col("_t.s"), n)
    return rows.select(
        *matrix.columns, n.alias("n_known"), (1 - n / F.size("x")).alias("missing"), (F.try_divide(F.col("_t.q"), n) - shift * shift).alias("var")
    )


def scan_matrix_topk(matrix: DataFrame, k: int = 50_000, max_na: float = 0.05) -> DataFrame:
    """The k features of largest variance among those with few missing values and some variation.

    One pass; every task keeps its own k best before they are merged.
    """
    rows = with_row_stats(matrix).filter((F.col("missing") <= max_na) & (F.col("var") > 0))
    return rows.orderBy(F.col("var").desc(), "feature").limit(k)


def matrix_counts(matrix: DataFrame, max_na: float = 0.05) -> DataFrame:
    """Rows seen, dropped for missing values or for no variation, and with values outside [0, 1]."""
    rows = with_row_stats(matrix)
    outside = F.coalesce(F.exists("x", lambda v: (v < 0) | (v > 1)), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("missing") > max_na).alias("dropped_missing"),
        F.count_if((F.col("missing") <= max_na) & ~F.coalesce(F.col("var") > 0, F.lit(False))).alias("dropped_constant"),
        F.count_if(outside).alias("out_of_range"),
    )


def scan_matrix_features_only(matrix: DataFrame, needed: DataFrame, bound: int | None = None) -> DataFrame:
    """Only the rows a model needs."""
    limit = broadcast_rows(matrix.sparkSession)
    n = bound if bound is not None else needed.limit(limit + 1).count()
    return matrix.join(F.broadcast(needed) if n <= limit else needed, "feature", "left_semi")


def columns_by_prefix(header: DataFrame, samples: DataFrame, length: int = 16) -> tuple[DataFrame, DataFrame]:
    """Match samples to the one header column with the same prefix; also the samples with none or several."""
    h = header.select("pos", F.col("sample").alias("column_name"), F.substring("sample", 1, length).alias("_p"))
    s = samples.select("sample", F.substring("sample", 1, length).alias("_p"))
    per = s.join(h, "_p", "left").groupBy("sample").agg(
        F.count("pos").alias("n_columns"), F.min("pos").alias("pos"), F.min("column_name").alias("column_name")
    )
    return per.filter("n_columns = 1").drop("n_columns"), per.filter("n_columns <> 1").select("sample", "n_columns")


def matrix_long(matrix: DataFrame, index: DataFrame) -> DataFrame:
    """(feature, x) to (sample, feature, value) with a (pos, sample) index."""
    return matrix.select("feature", F.posexplode("x").alias("pos", "value")).join(F.broadcast(index), "pos").select("sample", "feature", "value")


def scan_sample_files(
    spark: SparkSession, path: str, manifest: DataFrame, key_pattern: str, allowlist: DataFrame | None = None, prefix: str = "cg"
) -> DataFrame:
    """One two-column file per sample, named by a manifest (file_key, sample): long (sample, feature, value).

    Keeps probe rows by prefix and allow-list. Text that is no number is an error; repeated features and values outside the range
    are found by ``sample_file_violations``, changed files by ``sources.manifest.digest_check``. A feature absent from a file is a missing row, which is NULL in every
    wide form.
    """
    rows = spark.read.schema("feature string, value string").option("sep", "\t").csv(path)
    rows = rows.select("feature", strict_number(F.col("value")).alias("value"), F.regexp_extract("_metadata.file_path", key_pattern, 1).alias("file_key"))
    rows = rows.filter(F.col("feature").startswith(prefix))
    if allowlist is not None:
        rows = rows.join(allowlist, "feature", "left_semi")
    return rows.join(manifest.select("file_key", "sample"), "file_key").select("sample", "feature", "value")


def sample_file_violations(rows: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(sample, feature) that occur more than once in their file or have a value outside the range."""
    value = F.col("value")
    per = rows.groupBy("sample", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or((value < low) | (value > high) | F.isnan(value)), F.lit(False)).alias("_out")
    )
    kind = F.when(F.col("n") > 1, "duplicate").when(F.col("_out"), "out_of_range")
    return per.select("sample", "feature", "n", kind.alias("violation")).filter("violation IS NOT NULL")


def scan_tsv_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", na: str = "NA") -> DataFrame:
    """Dimension table with a header, a fixed schema and NA strings."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", na).csv(path)


def scan_annotation_gz(spark: SparkSession, path: str, schema: str, key: str = "probe", prefix: str = "cg") -> DataFrame:
    """Compressed annotation table restricted to probe rows; the schema names the required columns."""
    return scan_tsv_table(spark, path, schema).filter(F.col(key).startswith(prefix))


# The sample type kept and the project prefix removed.
PRIMARY = "Primary Tumor"
PROJECT_PREFIX = "^TCGA-"
HITS_SCHEMA = (
    "hits array<struct<id:string, file_name:string, file_size:bigint, cases:array<struct<submitter_id:string, "
    "project:struct<project_id:string>, samples:array<struct<submitter_id:string, sample_type:string>>>>>>"
)


def scan_nested_json_hits(spark: SparkSession, path: str) -> DataFrame:
    """Flatten saved response pages to one row per file with exactly one case and one primary sample."""
    hits = spark.read.schema(HITS_SCHEMA).json(path).select(F.explode("hits").alias("h")).select("h.*")
    one = hits.filter((F.size("cases") == 1) & (F.size(F.col("cases")[0]["samples"]) == 1))
    case, sample = F.col("cases")[0], F.col("cases")[0]["samples"][0]
    return one.filter(sample["sample_type"] == PRIMARY).select(
        "id", F.col("file_name"), F.col("file_size"), case["submitter_id"].alias("patient_id"), sample["submitter_id"].alias("sample_id"),
        F.regexp_replace(case["project"]["project_id"], PROJECT_PREFIX, "").alias("grp"),
    )


def scan_gene_sets(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Ragged rows ``name, id, id, ...`` to (set_name, feature); blanks are dropped."""
    cells = spark.read.text(path).select(F.transform(F.split("value", re.escape(sep)), lambda c: F.trim(c)).alias("c"))
    rows = cells.select(F.get("c", F.lit(0)).alias("set_name"), F.explode(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0)))).alias("feature"))
    return rows.filter("set_name <> '' AND feature <> ''")


def gene_set_violations(sets: DataFrame) -> DataFrame:
    """Ids repeated in a set, or shared by several sets."""
    per = sets.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("set_name").alias("n_sets"))
    kind = F.when(F.col("n_sets") > 1, "shared").when(F.col("n") > 1, "repeated")
    return per.select("feature", kind.alias("violation")).filter("violation IS NOT NULL")


def scan_expression_matrix(spark: SparkSession, path: str, first_columns: int | None = None) -> DataFrame:
    """Gene matrix with id type, normalised id and status per row; optionally only the first sample columns."""
    from heldout.operators.gene_sets import gene_row_audit, resolve_gene_ids

    keep = None if first_columns is None else range(first_columns)
    m = scan_matrix_tsv(spark, path, keep=keep).withColumnRenamed("feature", "raw_id")
    return gene_row_audit(resolve_gene_ids(m))


def scan_headerless_map(spark: SparkSession, path: str, split_values: str | None = None) -> DataFrame:
    """Two-column map without header; a list such as ``A;B`` may be split to one row each."""
    rows = spark.read.schema("key string, value string").option("sep", "\t").csv(path)
    return rows if split_values is None else rows.select("key", F.explode(F.split("value", re.escape(split_values))).alias("value"))


def scan_fold_outputs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per-fold outputs whose columns may differ, bound by name with NULL for what a fold lacks."""
    out = None
    for p in paths:
        part = spark.read.parquet(p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


SIDECAR_SCHEMA = "engineering_only boolean, n_samples long, n_features long, allowlist_sha256 string, track string, sha256 string"


def scan_sidecar_json(spark: SparkSession, path: str) -> DataFrame:
    """Provenance record next to a matrix; an absent file gives an empty table of the same schema."""
    hadoop = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true")
    try:
        hadoop.load(path).select("path").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], SIDECAR_SCHEMA)
        raise
    return spark.read.schema(SIDECAR_SCHEMA).json(path)
