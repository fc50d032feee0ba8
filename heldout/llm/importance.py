"""Importance resampling towards a target: hashed n-gram features, log-ratio gains, a draw without replacement by Gumbel keys.

Features are all runs of 1 to ``max_n`` consecutive words of the lower-cased (A-Z) text, joined by one space; repeats count. A feature's
bucket is the CRC-32 of its bytes modulo ``buckets``.

1. ``bucket_counts``: every task adds up one array of ``buckets`` counts over its whole texts and hands on its nonzero entries, so the
   shuffle holds at most tasks times buckets rows, and the driver gets ``buckets`` numbers whatever the input.
2. ``gains``: the gain of a bucket, from the counts of the raw and the target texts.
3. ``weigh``: a second pass over the texts; the gains (``buckets`` numbers) go along with the task.
4. ``draw_ranks``: documents ordered by weight plus Gumbel noise, in range-partitioned slices of which each is numbered on its own.

Both passes intern the n-grams of a batch in an open-addressed NumPy table (``GramTable``): the key is the 64-bit xxhash of the n-gram's
bytes, a hit is verified byte by byte, each taken slot stores bucket and count, and every occurrence keeps the number of its slot, through
which it gathers its gain. A batch holds ``BATCH_BYTES`` of text (one text at least), which bounds the table.

Defined cases: null and empty texts have no features and weigh 0; a null id draws with an empty id and stands before all others; rows that
repeat an id are documents of their own, in the order in which they were written; an empty table gives an empty table, an empty target
counts 0 everywhere. Extra columns are kept by ``resample``; columns named like its results are an error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.llm.common import give_back
from heldout.plans.skew import Profile, number_rows
from heldout.plans.storage import materialise

BUCKETS = 10_000
MAX_N = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text whose n-grams are interned together.
BATCH_BYTES = 2 << 20
#: Longer n-grams are hashed and compared one by one.
SHORT = 32

# Fixed values of the published 64-bit xxhash.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))

#: Byte to byte: A-Z in lower case, 0-9, a-z and all bytes beyond ASCII as they are, anything else a space.
FOLD = np.full(256, 32, np.uint8)
for _first, _last, _shift in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    FOLD[_first : _last + 1] = np.arange(_first, _last + 1) + _shift
#: The low 0 to 8 bytes of a word of eight.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class GramTable:
    """The distinct n-grams among spans of a byte array, in an open-addressed table with linear probing.

    ``slots``: slot number per span; ``taken``: the slots in use; per slot, ``bucket`` and ``count``.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int):
        """``data`` must end in eight spare bytes."""
        self.data, self.starts, self.sizes = data, starts, sizes
        self.eights = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
        self.keys = self._keys()
        self._intern()
        self.count = np.bincount(self.slots, minlength=len(self.owner))
        self.bucket = np.zeros(len(self.owner), np.int64)
        owners = self.owner[self.taken]
        raw = data.tobytes()
        firsts, ends = starts[owners].tolist(), (starts[owners] + sizes[owners]).tolist()
        self.bucket[self.taken] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(firsts, ends)]

    def _keys(self) -> np.ndarray:
        starts, sizes, data = self.starts, self.sizes, self.data
        h = P5 + sizes.astype(np.uint64)
        for k in range(SHORT // 8 - 1):
            some = np.flatnonzero(sizes >= 8 * (k + 1))
            x = _turn(self.eights[starts[some] + 8 * k] * P2, 31) * P1
            h[some] = _turn(h[some] ^ x, 27) * P1 + P4
        some = np.flatnonzero(sizes & 4)
        x = (self.eights[starts[some] + (sizes[some] & ~7)] & LOW[4]) * P1
        h[some] = _turn(h[some] ^ x, 23) * P2 + P3
        for k in range(3):
            some = np.flatnonzero((sizes & 3) > k)
            x = data[starts[some] + (sizes[some] & ~3) + k].astype(np.uint64) * P5
            h[some] = _turn(h[some] ^ x, 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(sizes >= SHORT).tolist():
            h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]])
        return h

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans numbered ``a`` and ``b`` hold the same bytes, pair by pair."""
        starts, sizes = self.starts, self.sizes
        equal = (self.keys[a] == self.keys[b]) & (sizes[a] == sizes[b])
        open_ = np.flatnonzero(equal & (a != b) & (sizes[a] < SHORT))
        for k in range(0, SHORT, 8):
            open_ = open_[sizes[a[open_]] > k]
            x = self.eights[starts[a[open_]] + k] ^ self.eights[starts[b[open_]] + k]
            differs = (x & LOW[np.minimum(sizes[a[open_]] - k, 8)]) != 0
            equal[open_[differs]] = False
            open_ = open_[~differs]
        for i in np.flatnonzero(equal & (a != b) & (sizes[a] >= SHORT)).tolist():
            x, y, n = starts[a[i]], starts[b[i]], sizes[a[i]]
            equal[i] = np.array_equal(self.data[x : x + n], self.data[y : y + n])
        return equal

    def _intern(self) -> None:
        n = len(self.starts)
        capacity = 1 << max(4, (2 * n).bit_length())
        self.owner = np.full(capacity, -1, np.int64)
        self.slots = np.empty(n, np.int64)
        last = capacity - 1
        waiting = np.arange(n)
        at = (self.keys & np.uint64(last)).astype(np.int64)
        while waiting.size:
            free = self.owner[at] < 0
            self.owner[at[free]] = waiting[free]
            hit = self._same(waiting, self.owner[at])
            self.slots[waiting[hit]] = at[hit]
            waiting, at = waiting[~hit], (at[~hit] + 1) & last
        self.taken = np.flatnonzero(self.owner >= 0)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in which the words of a text are joined by one space (with spare bytes at the end), and start, end and text of every word."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    folded = FOLD[raw]
    inside = folded != 32
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    kept = inside | before
    moved = np.cumsum(kept)
    data = np.concatenate([folded[kept], np.zeros(8, np.uint8)])
    return data, moved[starts] - 1, moved[ends - 1], owner


def _grams(texts: pa.Array, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, the n-grams in them (start, size, text) and the number of words per text."""
    data, starts, ends, owner = _words(texts)
    spans = []
    for n in range(1, max_n + 1):
        whole = owner[: len(owner) - n + 1] == owner[n - 1 :] if n <= len(owner) else np.zeros(0, bool)
        first = np.flatnonzero(whole)
        spans.append((starts[first], ends[first + n - 1] - starts[first], owner[first]))
    return data, *(np.concatenate(x) for x in zip(*spans)), np.bincount(owner, minlength=len(texts))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for k, n in enumerate(sizes):
        if size and size + n > BATCH_BYTES:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in _slices(whole, 0):
                data, starts, sizes, _, _ = _grams(batch.column(0), max_n)
                table = GramTable(data, starts, sizes, buckets)
                np.add.at(total, table.bucket[table.taken], table.count[table.taken])
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])
        give_back()

    counts = np.zeros(buckets, np.int64)
    for row in texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) per bucket, with p and q the smoothed shares of the bucket among target and raw features."""
    n = len(raw)
    s_all, t_all = int(raw.sum()), int(target.sum())
    ratios = [((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", max_n: int = MAX_N) -> DataFrame:
    """Add n_words, n_features and weight (the sum of the gains of all features) to every row."""
    at, buckets = docs.columns.index(text_col), len(gain)
    names = ["n_words", "n_features", "weight"]
    clash = {c.lower() for c in docs.columns} & set(names)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, at):
                data, starts, sizes, owner, words = _grams(batch.column(at), max_n)
                table = GramTable(data, starts, sizes, buckets)
                of_slot = gain[table.bucket]
                weight = np.zeros(batch.num_rows, np.int64)
                np.add.at(weight, owner, of_slot[table.slots])
                more = [words, np.bincount(owner, minlength=batch.num_rows), weight]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in more]], names=[*batch.schema.names, *names])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]]))


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw_ranks(scored: DataFrame, id_col: str, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Add rank: 1, 2, 3... by falling score (ties: smaller id) for the drawn share of the documents with enough words, else null.

    ``scored`` is a written table. All eligible rows are put into ranges of (score, id), so no task orders them all.
    """
    enough = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    eligible = scored.filter(enough)
    n = eligible.count()
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_first(), F.col("_at")]
    # The size that is told makes the numbering use its slices.
    ranked = number_rows(eligible, [], order, "rank", Profile(1, 1 << 62, n))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n * percent // 100, F.col("rank")))
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def importance(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = MAX_N,
    buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per document: its id, n_words, n_features, weight, score and rank (null: not drawn)."""
    gain = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets))
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_at"))
    weighed = weigh(texts, gain, "_text", max_n).drop("_text").withColumn("score", F.col("weight") + gumbel(id_col, seed))
    return draw_ranks(materialise(weighed, "importance"), id_col, percent, min_words).drop("_at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns and their rank. The options are those of ``importance``."""
    if "rank" in {c.lower() for c in docs.columns}:
        raise ValueError("columns exist already: ['rank']")
    rows = docs.withColumn("_row", F.struct(F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("id")))
    rows = materialise(rows, "documents")
    keyed = rows.select(F.col("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    gain = gains(bucket_counts(rows, text_col, options.get("max_n", MAX_N), options.get("buckets", BUCKETS)),
                 bucket_counts(target, target_col, options.get("max_n", MAX_N), options.get("buckets", BUCKETS)))
    weighed = weigh(keyed, gain, "_text", options.get("max_n", MAX_N)).drop("_text")
    scored = weighed.withColumn("score", F.col("weight") + gumbel("_id", options.get("seed", SEED))).withColumn("_at", F.col("_row.at"))
    ranks = draw_ranks(materialise(scored, "importance"), "_id", options.get("percent", PERCENT), options.get("min_words", MIN_WORDS))
    return rows.join(ranks.filter("rank IS NOT NULL").select("_row", "rank"), "_row").drop("_row")
