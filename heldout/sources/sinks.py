"""Writers: tables, append-only ledger, model bundles, resumable fold outputs, provenance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "run_id string, evaluated_at timestamp, status string, model string, grp string, n long, mae double"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a table or file set exist below this path?"""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").first()
        return True
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def sink_table(df: DataFrame, path: str, fields: Sequence[str], sep: str = "\t") -> None:
    """Text table with a fixed field order; other columns are ignored, NULL is written as NA."""
    df.select(*fields).write.option("header", True).option("sep", sep).option("nullValue", "NA").option("lineSep", "\n").csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], LEDGER)


def sink_ledger_append(entries: DataFrame, path: str) -> int:
    """Append evaluation rows in the fixed column order; returns how many rows the ledger had before."""
    spark = entries.sparkSession
    prior = read_ledger(spark, path).count()
    fields = [f.split()[0] for f in LEDGER.split(", ")]
    entries.select(*fields).write.mode("append").parquet(path)
    return prior


def recorded_evaluation(entry: DataFrame, path: str, work: Callable[[], None]) -> int:
    """Write the ledger row ``started``, do the work, write it again as ``finished``: a crash leaves a trace."""
    prior = sink_ledger_append(entry.withColumn("status", F.lit("started")), path)
    work()
    sink_ledger_append(entry.withColumn("status", F.lit("finished")), path)
    return prior


def sink_model_bundle(run: dict[str, DataFrame], path: str, parts: Sequence[str]) -> None:
    """The named tables of a run as one folder of Parquet tables."""
    for p in parts:
        run[p].write.parquet(f"{path}/{p}")


def read_model_bundle(spark: SparkSession, path: str, parts: Sequence[str]) -> dict[str, DataFrame]:
    return {p: spark.read.parquet(f"{path}/{p}") for p in parts}


def sink_fold_resumable(spark: SparkSession, path: str, folds: Sequence[str], run: Callable[[str], DataFrame]) -> list[str]:
    """Run and write the folds that have no finished output; returns those done now.

    A fold counts as finished by its ``_SUCCESS`` marker, which the output committer writes last.
    """
    done = []
    for f in folds:
        target = f"{path}/fold={f}"
        if not path_exists(spark, f"{target}/_SUCCESS"):
            run(f).write.mode("overwrite").parquet(target)
            done.append(f)
    return done


def export_run_manifest(facts: DataFrame) -> DataFrame:
    """One-row facts to (field, value) rows in column order."""
    cells = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for i, c in enumerate(facts.columns)]
    return facts.select(F.explode(F.array(*cells)).alias("_c")).select("_c.pos", "_c.field", "_c.value")


def provenance_record(matrix: DataFrame, allowlist: DataFrame, track: str, engineering_only: bool = False) -> DataFrame:
    """One-row provenance of a matrix (feature, x): sizes, track, and order-free hashes of allow-list and matrix.

    The hash of a table is the SHA-256 of its number of rows and of the sums of two 64-bit hashes of each row, names and values
    alike, so nothing is gathered in one place and a changed, added or missing value changes it. A file's own SHA-256, to be held
    against a published one, comes from ``sources.manifest.file_digests``.
    """

    def digest(df, *cols):
        sums = [F.sum(F.xxhash64(F.lit(salt), *cols).cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
        return df.agg(F.sha2(F.concat_ws(":", *sums, F.count(F.lit(1)).cast("string")), 256).alias("h"))

    sizes = matrix.agg(F.max(F.size("x")).cast("long").alias("n_samples"), F.count(F.lit(1)).alias("n_features")).withColumn("_one", F.lit(1))
    a = digest(allowlist, "feature").select(F.col("h").alias("allowlist_sha256"), F.lit(1).alias("_one"))
    m = digest(matrix, "feature", "x").select(F.col("h").alias("sha256"), F.lit(1).alias("_one"))
    j = sizes.join(F.broadcast(a), "_one").join(F.broadcast(m), "_one")
    return j.select(F.lit(engineering_only).alias("engineering_only"), "n_samples", "n_features", "allowlist_sha256", F.lit(track).alias("track"), "sha256")
