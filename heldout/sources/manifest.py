"""Manifests: unions where the later source wins, tier selection, digest checks, resumable outputs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.functions.scalars import trim_record


def last_wins_union(sources: Sequence[DataFrame], key: str, tie: Sequence[str] = ()) -> DataFrame:
    """Union of tables in which a later one replaces earlier rows of the same key; ``source`` is the 1-based origin."""
    tagged = None
    for i, df in enumerate(sources, 1):
        part = df.withColumn("source", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    others = [c for c in tagged.columns if c != key]
    pick = F.max(F.struct(F.col("source").alias("_s"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)], *others))
    return tagged.groupBy(key).agg(pick.alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in others])


def select_tier(manifest: DataFrame, tier: DataFrame, name: str = "filename", size: str = "size") -> tuple[DataFrame, DataFrame]:
    """The files of a tier (name, tier_pos) in its order, and the total number of files and bytes."""
    chosen = trim_record(manifest).join(trim_record(tier).select(name, "tier_pos"), name)
    total = chosen.agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    return chosen.orderBy("tier_pos"), total


#: Bytes up to which a file is one value; larger ones are read in blocks.
WHOLE_FILE = 64 << 20


def _block_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path, length in zip(batch["path"], batch["length"], strict=True):
            system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            md5, sha256 = hashlib.md5(), hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while block := stream.read(8 << 20):
                    md5.update(block)
                    sha256.update(block)
            rows.append((path, length, md5.hexdigest(), sha256.hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "length", "md5", "sha256"])


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """Name below ``path``, length, MD5 and SHA-256 of every file, computed where the file is read.

    Files above ``whole`` bytes are read in blocks, so no size is too large; only their names and lengths go through Spark.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= whole).select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole).select("path", "length").mapInPandas(_block_digests, "path string, length long, md5 string, sha256 string")
    name = F.regexp_extract("path", re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/(.*)$", 1)
    return small.unionByName(large).select(name.alias("filename"), "length", "md5", "sha256")


def digest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries against actual files: ok, missing, size_mismatch, md5_mismatch, sha256_mismatch."""
    m = manifest.select("filename", F.col("size").alias("want_size"), F.col("md5").alias("want_md5"),
                        (F.col("sha256") if "sha256" in manifest.columns else F.lit(None).cast(T.StringType())).alias("want_sha"))
    j = m.join(files, "filename", "left")
    status = (
        F.when(F.col("length").isNull(), "missing")
        .when(F.col("length") != F.col("want_size"), "size_mismatch")
        .when(F.col("md5") != F.col("want_md5"), "md5_mismatch")
        .when(F.col("want_sha").isNotNull() & (F.col("sha256") != F.col("want_sha")), "sha256_mismatch")
        .otherwise("ok")
    )
    return j.select("filename", status.alias("status"))
