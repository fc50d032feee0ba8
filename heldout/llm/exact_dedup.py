"""Exact deduplication with streaming state that is kept on disk and never expires.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. The work has three parts.

1. ``locate``: one pass over the texts appends a row per document (identifier, digest, length, content locator) to the inbox of the
   index's folder. The locator is the number of the run and of the row in it; with the identifier it finds the content again.
2. ``update_index``: a streaming aggregation over those rows. Its state is keyed by digest, lives in RocksDB and has no watermark,
   so nothing expires; each key retains the digest, the identifier and locator of the row that stays, and the count. Spark combines
   rows of one digest before the shuffle, so a digest that fills a third of the input arrives as one row per task. The folder may be
   given again with further documents: they then meet the state of all earlier runs.
3. ``verify``: digests seen more than once are hits. Their whole normalised texts are grouped byte by byte (again combined before
   the shuffle). A digest whose texts differ is split by the strong digest; two texts that share that as well stop the run, so
   different texts are never taken as copies.

Defined cases: a null text counts as empty, and empty texts are equal to each other; ids may be null (a null id is larger than any other
and is a group's keep_id only if no row of equal length has one); rows that repeat an id are separate rows of which at most one stays.
Ties on length go to the smallest id, then to the row written first. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heldout.llm.common import BROADCAST_IDS, drop_ids, free_name, text_of
from heldout.plans.storage import materialise, scratch_path

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
#: Session settings while the stream runs. Without preallocation a store of few keys takes few bytes of disk.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), WHITE_SPACE, "")


def locate(
    docs: DataFrame, folder: str, run: int = 0, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Append one row per document to the inbox: ``id``, ``digest``, ``sha256``, ``n_chars`` and the locator ``at``. Returns this run's rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.length(text_of(text_col)).cast("long").alias("n_chars"), normalised(text_col).alias("_norm"))
    rows = rows.select("id", "n_chars", digest(F.col("_norm")).cast("string").alias("digest"), F.sha2("_norm", 256).alias("sha256"))
    rows = rows.withColumn("at", F.struct(F.lit(run).alias("run"), F.monotonically_increasing_id().alias("row")))
    rows.write.mode("append").parquet(f"{folder}/inbox")
    return docs.sparkSession.read.schema(rows.schema).parquet(f"{folder}/inbox").filter(F.col("at.run") == run)


def _best() -> Column:
    """The row that stays: most code points, then the smallest id, then the first written."""
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("at").alias("at"))
    return F.min(order).alias("best")


def update_index(located: DataFrame, folder: str) -> DataFrame:
    """Feed what is new in the folder's inbox to the stream; return the last state of every digest: ``digest``, ``n``, ``best``.

    ``located`` gives the schema. The stream ends when it has read the inbox (``availableNow``); its checkpoint is in the folder.
    """
    spark = located.sparkSession
    rows = spark.readStream.schema(located.schema).parquet(f"{folder}/inbox")
    state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best())

    def keep(batch: DataFrame, number: int) -> None:
        # A repeated batch replaces its own files, so a restarted stream writes nothing twice.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/index/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).foreachBatch(keep).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if not located.inputFiles():
        return located.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best())
    last = spark.read.parquet(f"{folder}/index").groupBy("digest").agg(F.max_by(F.struct("n", "best"), "batch").alias("s"))
    return last.select("digest", "s.n", "s.best")


def verify(docs: DataFrame, index: DataFrame, text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests that were seen more than once with the texts and the strong digests behind them: ``digest``, ``texts``, ``strong``."""
    hits = index.filter("n > 1").select(F.col("digest").alias("_hit"))
    few = hits.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(normalised(text_col).alias("_norm")).withColumn("digest", digest(F.col("_norm")).cast("string"))
    met = texts.join(F.broadcast(hits) if few else hits, F.col("digest") == F.col("_hit"), "left_semi")
    return met.groupBy("digest", "_norm").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.count_distinct(F.sha2("_norm", 256)).alias("strong")
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all their columns.

    Rows are told apart by id, length and digest of their texts; where rows agree in all three, one of them stays.
    """
    found = exact_dedup(docs, id_col, text_col)
    n_chars, digest = F.length(text_of(text_col)), F.sha2(normalised(text_col), 256)
    stays = F.struct("keep_id", "text_sha256").alias("stays")
    gone = materialise(found.filter("NOT kept").select(F.col(id_col).alias("_id"), "n_chars", F.col("text_sha256").alias("_sha256"), stays), "gone")
    # A dropped row that has the id of the one that stays can only be told from it by length, or not at all.
    twin = gone.filter(F.col("_id").eqNullSafe(F.col("stays.keep_id"))).limit(1).count() > 0
    if not twin:
        ids = gone.select(F.col("_id").alias(id_col)).distinct()
        repeated = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        if not repeated.limit(1).count():
            return drop_ids(docs, ids, id_col)
    as_id, as_n, as_digest = (free_name(docs, c) for c in ("_id", "_n", "_sha256"))
    kept = found.filter("kept").select(F.col(id_col).alias(as_id), F.col("n_chars").alias(as_n), F.col("text_sha256").alias(as_digest))
    same = F.col(id_col).eqNullSafe(F.col(as_id)) & (n_chars == F.col(as_n)) & (digest == F.col(as_digest))
    chosen = docs.join(kept, same, "left_semi").withColumn(as_n, n_chars).withColumn(as_digest, digest)
    return chosen.dropDuplicates([id_col, as_n, as_digest]).drop(as_n, as_digest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_chars``."""
    spark: SparkSession = docs.sparkSession
    folder = scratch_path(spark, "dedup")
    located = locate(docs, folder, 0, id_col, text_col, digest)
    index = materialise(update_index(located, folder), "index")
    mixed = materialise(verify(docs, index, text_col, digest).filter("texts > 1"), "mixed")
    if mixed.filter("texts > strong").limit(1).count():
        raise ValueError("different texts have the same strong digest")
    mixed, same = mixed.select("digest"), located
    if mixed.limit(1).count():
        # Different texts behind one digest: their rows are grouped by the strong digest of the text as well.
        other = located.join(mixed, "digest").groupBy("digest", "sha256").agg(F.count(F.lit(1)).alias("n"), _best())
        clear = index.join(mixed, "digest", "left_anti").select("digest", F.lit(None).cast("string").alias("_sha256"), "n", "best")
        index = clear.unionByName(other.withColumnRenamed("sha256", "_sha256"))
        marked = located.join(mixed.withColumn("_mixed", F.lit(True)), "digest", "left")
        same = marked.withColumn("_sha256", F.when(F.col("_mixed"), F.col("sha256"))).drop("_mixed")
        joined = same.alias("l").join(
            index.alias("i"), (F.col("l.digest") == F.col("i.digest")) & F.col("l._sha256").eqNullSafe(F.col("i._sha256"))
        )
    else:
        joined = same.alias("l").join(index.alias("i"), F.col("l.digest") == F.col("i.digest"))
    return joined.select(
        F.col("l.id").alias(id_col), F.col("i.best.id").alias("keep_id"), F.col("i.n").cast("long").alias("group_size"),
        (F.col("l.at") == F.col("i.best.at")).alias("kept"), F.col("l.sha256").alias("text_sha256"), F.col("l.n_chars").alias("n_chars"),
    )
