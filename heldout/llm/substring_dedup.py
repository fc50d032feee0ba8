"""Substring deduplication by level-wise doubling of repeated word windows.

A word is covered, and removed, if it lies in a window of ``WINDOW`` consecutive words whose word sequence starts at another place too, in the
same document or in any other. Windows are compared level by level: 9, 18, then 35 words (each level at most twice the one before). Only
windows repeated at one length are extended to the next, until the full length is reached or no candidate survives.

* Below the full length not every window is needed. In each run of 35 words the window with the smallest hash is taken (the leftmost of
  equals), so equal runs choose equal windows, about one in twenty words. A run whose own choice occurs once is not repeated.
* At the full length the surviving runs are compared by the 128-bit hash of their words.
* What travels is a hash with a count, combined per bucket of documents before the shuffle, and on the way back only what turned out to
  occur ONCE. So a passage that fills a third of all rows is one row per bucket, and is never sent back at all.
* Texts are dealt out once, evenly by a hash of identifier and text; all levels and the removal read this one exchange (Spark reuses it
  within the plan). The rest stays in tasks over one bucket of documents.

Defined cases: null and empty texts, and texts of white space, have no words and nothing is removed; a text shorter than the window keeps all
its words; rows that repeat (even with the same id) are separate documents, so their windows are repeated. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.llm.common import partitions_for, text_of
from heldout.llm.windows import Words

WINDOW = 35
HASHES = "bucket int, hi long, lo long, n long"

def levels_for(window: int) -> list[int]:
    """Lengths from short to full, each at most twice the one before: halves of the window down to 8 words or more."""
    out = [window]
    while out[-1] > 16:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def _choice(h: np.ndarray, frame: int) -> np.ndarray:
    """For each run of ``frame`` windows the position of its smallest hash."""
    runs = np.lib.stride_tricks.sliding_window_view(h, frame)
    return np.arange(len(runs)) + runs.argmin(axis=1)


def _survey(text: str | None, window: int, levels: list[int], once: dict[int, np.ndarray]) -> tuple[Words, np.ndarray, np.ndarray | None]:
    """Words, runs still alive after the levels in ``once``, and the hashes to compare at the first level not in it (below the full)."""
    words = Words(text)
    alive = np.ones(max(len(words) - window + 1, 0), bool)
    for length in levels[:-1]:
        if not alive.any():
            break
        h = words.hashes(length).view(np.int64)
        choice = _choice(h.view(np.uint64), window - length + 1)
        at = np.unique(choice[alive])
        if length not in once:
            return words, alive, h[at]
        unique = once[length]
        if len(unique):
            single = np.zeros(len(h), bool)
            single[at] = unique[np.minimum(np.searchsorted(unique, h[at]), len(unique) - 1)] == h[at]
            alive &= ~single[choice]
    return words, alive, None


def _counted(bucket: int, hashes: list[np.ndarray], digests: list[list[bytes]]) -> pd.DataFrame:
    """One row per different hash of a bucket with its count."""
    if digests:
        pairs = np.frombuffer(b"".join(b"".join(d) for d in digests), np.dtype([("hi", "<i8"), ("lo", "<i8")]))
        hashed = pd.DataFrame({"hi": pairs["hi"], "lo": pairs["lo"]}).groupby(["hi", "lo"], sort=False).size().reset_index(name="n")
    else:
        values, n = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.int64), return_counts=True)
        hashed = pd.DataFrame({"hi": values, "lo": np.zeros(len(values), np.int64), "n": n})
    hashed.insert(0, "bucket", np.int32(bucket))
    return hashed


def _singles(flags: pd.DataFrame, levels: list[int]) -> dict[int, np.ndarray]:
    """Sorted hashes that occur once, by level (below the full length)."""
    return {k: np.sort(flags["hi"].to_numpy()[flags["level"].to_numpy() == k]) for k in levels}


def _once(counted: DataFrame, level: int) -> DataFrame:
    """Hashes that occur once in all documents, with the bucket they are in."""
    total = counted.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.min("bucket").alias("bucket"))
    return total.filter("n = 1").select("bucket", F.lit(level).alias("level"), "hi", "lo")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_removed and ``kept``, the words that stay, joined by one space."""
    levels = levels_for(window)
    parts = partitions_for(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = text_of(text_col)
    # Identifiers travel as strings: pandas would turn whole numbers with nulls among them into floats.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(4 * parts)).cast("int").alias("bucket"))
    # Explicit on both sides, so that the texts keep one partitioning in every level's plan.
    dealt = rows.repartition(parts, "bucket")

    def first_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, own in batch.groupby("bucket", sort=False):
                found = [h for h in (_survey(t, window, levels, {})[2] for t in own["text"]) if h is not None]
                yield _counted(bucket, found, [])

    def next_level(length: int, before: list[int]):
        def run(key, own: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
            once, found, digests = _singles(flags, before), [], []
            for t in own["text"]:
                words, alive, h = _survey(t, window, levels, once)
                if length < window and h is not None:
                    found.append(h)
                elif length == window and alive.any():
                    digests.append(words.digests(np.flatnonzero(alive), window))
            return _counted(key[0], found, digests)

        return run

    def removal(key, own: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        once = _singles(flags, levels[:-1])
        full = flags[flags["level"] == window]
        pairs = np.zeros(len(full), np.dtype([("hi", "<i8"), ("lo", "<i8")]))
        pairs["hi"], pairs["lo"] = full["hi"], full["lo"]
        blob = pairs.tobytes()
        single = {blob[k : k + 16] for k in range(0, len(blob), 16)}
        out = []
        for doc, t in zip(own["id"], own["text"], strict=True):
            words, alive, _ = _survey(t, window, levels, once)
            at = np.flatnonzero(alive)
            if len(at):
                at = at[np.fromiter((d not in single for d in words.digests(at, window)), bool, len(at))]
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            stays = np.cumsum(cover)[:-1] == 0
            kept = b" ".join(compress(words.words, stays.tolist())) if len(at) else words.joined
            out.append((doc, len(words), len(words) - int(stays.sum()), kept.decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    if len(levels) > 1:
        flags = _once(rows.mapInPandas(first_level, HASHES), levels[0])
        done = levels[:1]
    else:
        flags = docs.sparkSession.createDataFrame([], "bucket int, level int, hi long, lo long")
        done = []
    for length in levels[len(done) :]:
        met = dealt.groupBy("bucket").cogroup(flags.repartition(parts, "bucket").groupBy("bucket"))
        flags = flags.unionByName(_once(met.applyInPandas(next_level(length, list(done)), HASHES), length))
        done.append(length)
    met = dealt.groupBy("bucket").cogroup(flags.repartition(parts, "bucket").groupBy("bucket"))
    found = met.applyInPandas(removal, "id string, n_words long, n_removed long, kept string")
    return found.select(F.col("id").cast(id_type).alias(id_col), "n_words", "n_removed", "kept")
