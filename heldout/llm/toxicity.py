"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios, trained on labelled text.

Features are the n-grams (4 and 5 characters of the lower-cased text) that occur in a document, hashed to ``BUCKETS``.

1. ``count_features``: over ALL training documents, how many toxic and how many other documents contain each bucket, and how many of
   those outside the check rows (an eighth of the ids). Each task adds up its documents and hands on one row per bucket it met, so the
   shuffle holds counts, not texts.
2. ``fit``: the buckets with the largest likelihood ratio statistic are kept. How many of them, one of ``SIZES``, is what serves the check
   rows best when buckets, ratios and coefficients come from the other training rows. Each bucket has the log-count ratio
   ``r = log((p + a) / |p|) - log((q + a) / |q|)``. A logistic regression with squared penalty is fitted on presence times r, over at
   most ``FIT_ROWS`` training documents (those whose hashed id is smallest: a documented bound; everything else covers all rows).
3. ``score``: one pass over the texts; the model is one of ``SIZES`` numbers whatever the input.

Defined cases: null and empty texts have no features and get the intercept's score; labels that are null or whose id is null are ignored, of
repeated labels the toxic one wins; a null id is not held out; without training rows every score is 0, with one class only it is the smoothed
share of that class. Extra columns are ignored by ``score`` and kept by ``reject_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.llm.common import free_name, give_back
from heldout.plans.storage import materialise

LENGTHS = (4, 5)
BUCKETS = 1 << 22
#: Numbers of kept buckets that are tried.
SIZES = (256, 512, 1024, 2048, 4096)
#: One in so many ids is a check row.
CHECK = 8
FIT_ROWS = 20_000
SMOOTHING = 1.0
PENALTY = 1.0
#: Labelled ids that may be broadcast; more are met in a shuffled join.
BROADCAST_LABELS = 1_000_000
#: Characters that are hashed at once (a longer text is taken in overlapping pieces).
PIECE = 1 << 20


def buckets_of(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, in pieces of bounded size."""
    if not text:
        return
    longest = max(LENGTHS)
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE + longest - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in LENGTHS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += codes[k : len(codes) - n + 1 + k]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield (h >> np.uint64(42)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Kept buckets with their weights (coefficient times ratio), and the intercept (None: the constant ``share``)."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float | None
    share: float = 0.0


def _joined_labels(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marks = materialise(marks, "labels")
    few = marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(marks) if few else marks, "id")


def _order(id_col: str = "id") -> Column:
    return F.xxhash64(F.col(id_col))


def count_features(training: DataFrame) -> DataFrame:
    """``bucket``, ``toxic``, ``other``: documents of either class that contain the bucket; ``toxic_fit``, ``other_fit``: those of them that
    are no check rows. Bucket -1 counts the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((4, BUCKETS), np.int32)
        docs = np.zeros(4, np.int64)

        def rows(at: np.ndarray | list, counts: np.ndarray) -> pd.DataFrame:
            other, toxic, other_fit, toxic_fit = counts.astype(np.int64)
            all_of = {"toxic": toxic + toxic_fit, "other": other + other_fit}
            return pd.DataFrame({"bucket": at, **all_of, "toxic_fit": toxic_fit, "other_fit": other_fit})

        for batch in batches:
            for text, part in zip(batch["text"], batch["part"], strict=True):
                docs[part] += 1
                parts = list(buckets_of(text))
                if parts:
                    seen[part, np.unique(np.concatenate(parts))] += 1
        met = np.flatnonzero(seen.any(axis=0))
        yield rows([-1], docs[:, None])
        for start in range(0, len(met), 100_000):
            at = met[start : start + 100_000]
            yield rows(at, seen[:, at])

    part = F.col("toxic") + F.when(F.pmod(_order(), F.lit(CHECK)) == 0, 0).otherwise(2)
    names = ["toxic", "other", "toxic_fit", "other_fit"]
    each = training.select("text", part.cast("long").alias("part")).mapInPandas(run, "bucket long, " + ", ".join(f"{c} long" for c in names))
    return each.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])


def _likelihood(a: Column, b: Column, n: int, m: int) -> Column:
    """Likelihood ratio statistic of a bucket in a of n toxic and b of m other documents."""

    def part(x: Column, of: float, row: Column) -> Column:
        expected = row * F.lit(of / (n + m))
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    return 2 * (part(a, n, a + b) + part(b, m, a + b) + part(n - a, n, n + m - a - b) + part(m - b, m, n + m - a - b))


class _Presence:
    """Which of a number of features each row has, as two flat lists, with the ratio every feature is scaled by."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.size, self.ratio = len(rows), ratio
        self.at = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(self.size, dtype=np.int32), [len(r) for r in rows])

    def only(self, chosen: np.ndarray) -> _Presence:
        """The same features of the chosen rows."""
        ends = np.cumsum(np.bincount(self.row, minlength=self.size))[:-1]
        return _Presence([r for r, c in zip(np.split(self.at, ends), chosen, strict=True) if c], self.ratio)

    def times(self, w: np.ndarray) -> np.ndarray:
        """Weights (the last one is the intercept) to the sum of every row."""
        return np.bincount(self.row, (self.ratio * w[:-1])[self.at], self.size) + w[-1]

    def summed(self, u: np.ndarray, power: int = 1) -> np.ndarray:
        """A number of every row to its sum over the rows of every feature, and over all rows."""
        return np.append(self.ratio**power * np.bincount(self.at, u[self.row], len(self.ratio)), u.sum())


def _logistic(x: _Presence, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Newton steps with halving for a logistic regression with squared penalty; the intercept is free. A step comes from conjugate gradients."""
    ridge = np.full(len(x.ratio) + 1, PENALTY)
    ridge[-1] = 1e-6
    w = np.zeros(len(ridge))

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * x.times(w)).sum() + 0.5 * (ridge * w * w).sum())

    def newton_step(gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        scale = x.summed(curvature, 2) + ridge
        step, left = np.zeros(len(gradient)), gradient.copy()
        ahead = left / scale
        weight, goal = left @ ahead, 1e-3 * np.linalg.norm(gradient)
        for _ in range(500):
            if np.linalg.norm(left) <= goal:
                break
            bent = x.summed(curvature * x.times(ahead)) + ridge * ahead
            size = weight / (ahead @ bent)
            step += size * ahead
            left -= size * bent
            weight, before = left @ (left / scale), weight
            ahead = left / scale + weight / before * ahead
        return step

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -500, 500)))
        step = newton_step(x.summed(p - y) + ridge * w, p * (1 - p))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before = w - size * step, now
        now = loss(w)
        if before - now <= 1e-8 * abs(before):
            return w[:-1], float(w[-1])
    raise ValueError("the classifier did not converge")


def _best(counts: DataFrame, toxic: str, other: str, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The most telling buckets by these counts, best first, and their log-count ratios."""
    worth = _likelihood(F.col(toxic).cast("double"), F.col(other).cast("double"), n, m).alias("worth")
    ranked = counts.filter(f"bucket >= 0 AND {toxic} + {other} > 0").select("bucket", F.col(toxic).alias("a"), F.col(other).alias("b"), worth)
    best = ranked.orderBy(F.desc("worth"), "bucket").limit(max(SIZES)).toPandas()
    ratio = np.log((best["a"] + SMOOTHING) / (n + SMOOTHING)) - np.log((best["b"] + SMOOTHING) / (m + SMOOTHING))
    return best["bucket"].to_numpy(np.int64), ratio.to_numpy(float)


def _chosen_size(rows: list[np.ndarray], check: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> int:
    """The size whose model, fitted on the rows that are not ``check``, has the least log loss on those that are; of equal ones the smallest."""
    losses = []
    for size in SIZES:
        x = _Presence([r[r < size] for r in rows], ratio[:size])
        w = np.append(*_logistic(x.only(~check), y[~check]))
        losses.append(np.logaddexp(0, -(2 * y - 1) * x.times(w))[check].sum())
    return SIZES[int(np.argmin(losses))]


def fit(training: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """``training``: id, text, toxic (0 or 1)."""
    counts = materialise(count_features(training), "features")
    names = ["toxic", "other", "toxic_fit", "other_fit"]
    n, m, n_fit, m_fit = (k or 0 for k in counts.filter("bucket = -1").agg(*[F.sum(c) for c in names]).first())
    if not n or not m:
        none = np.zeros(0)
        return Model(none.astype(np.int64), none, None, (n + 1) / (n + m + 2) if n + m else 0.0)
    whole, ratio = _best(counts, "toxic", "other", n, m)
    tried, ratio_tried = _best(counts, "toxic_fit", "other_fit", n_fit, m_fit) if n_fit and m_fit else (whole[:0], ratio[:0])
    kept = np.union1d(whole, tried)

    order = _order()
    last = training.select(order.alias("order")).orderBy("order").limit(fit_rows).agg(F.max("order")).first()[0]

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _Finder(kept)
        for batch in batches:
            found = [find(t).astype(np.int16).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"order": batch["order"], "id": batch["id"].astype(str), "toxic": batch["toxic"], "at": found})

    # Repeated ids share their hash, so the bound is set once more on the short rows that go to the driver.
    sample = training.select(order.alias("order"), "id", "text", "toxic").filter(F.col("order") <= last)
    rows = sample.mapInPandas(present, "order long, id string, toxic int, at binary").orderBy("order", "id", "at").limit(fit_rows).toPandas()
    y, check = rows["toxic"].to_numpy(float), rows["order"].to_numpy() % CHECK == 0

    def ranks(buckets: np.ndarray) -> list[np.ndarray]:
        """Of every row, the places of its buckets in this list."""
        place = np.full(len(kept), -1, np.int32)
        place[np.searchsorted(kept, buckets)] = np.arange(len(buckets))
        return [p[p >= 0] for p in (place[np.frombuffer(at, np.int16)] for at in rows["at"])]

    size = min(SIZES)
    if len(tried) and check.any() and len(set(y[~check])) == 2:
        size = _chosen_size(ranks(tried), check, y, ratio_tried)
    whole, ratio = whole[:size], ratio[:size]
    coefficients, intercept = _logistic(_Presence(ranks(whole), ratio), y)
    return Model(whole, coefficients * ratio, intercept)


class _Finder:
    """Which of the kept buckets a text contains."""

    def __init__(self, kept: np.ndarray):
        self.slot = np.full(BUCKETS, -1, np.int16)
        self.slot[kept] = np.arange(len(kept))

    def __call__(self, text: str | None) -> np.ndarray:
        found = [s[s >= 0] for s in (self.slot[b] for b in buckets_of(text))]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> Model:
    """Fit on the labelled rows of ``docs`` that are not ``held_out``."""
    labels = labels.filter(~held_out) if held_out is not None else labels
    return fit(_joined_labels(docs, labels, id_col, text_col))


def add_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of each text."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(model.buckets)
        for batch in batches:
            if model.intercept is None:
                scores = [model.share] * batch.num_rows
            else:
                sums = [model.intercept + model.weights[find(t.as_py())].sum() for t in batch.column(at)]
                scores = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def out_of_training(id_col: str = "doc_id") -> Column:
    """Rows kept out of training: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, out_of_training(id_col))
    scored = add_score(docs.select(F.col(id_col), F.col(text_col)), model, text_col).drop(text_col)
    return scored.select(id_col, out_of_training(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, all their columns."""
    model = train(docs, labels, id_col, text_col, out_of_training(id_col))
    score = free_name(docs, "_toxicity")
    return add_score(docs, model, text_col, score).filter(F.col(score) < 0.5).drop(score)
