"""Fits of all leave-one-group-out folds at once: logistic maps, monotone maps, and the pairwise ranker.

A fold is a group (the fit leaves its rows out) or None (all rows). Nothing here runs once per fold on the data: a pass sends every row past the
current coefficients of all folds (and grid points), tasks add up gradients with one matrix product per batch, and the driver holds
coefficients and sums of folds, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.plans.skew import attach, cumulate
from heldout.plans.storage import materialise

Fold = str | None


def fold_names(rows: DataFrame, group: str = "grp") -> list[Fold]:
    """All groups in order, then the fold of all rows."""
    found = rows.select(F.col(group).cast("string")).distinct().dropna().collect()
    return [*sorted(r[0] for r in found), None]


def _codes(batch: pa.RecordBatch, group: str, folds: Sequence[Fold]) -> np.ndarray:
    """The fold that leaves each row out (-1: none does)."""
    place = {f: k for k, f in enumerate(folds) if f is not None}
    return np.array([place.get(g, -1) for g in batch.column(group).to_pylist()], np.int64)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


#: Rows of a batch that are summed at once, which bounds the arrays of rows by models.
ROWS = 1024


def _sums(rows: DataFrame, add: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Arrays by number, summed over all batches: inside a task first, then map-side, then by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                for k, v in add(batch.slice(start, ROWS)).items():
                    total[k] = total.get(k, 0.0) + v
        if total:
            values = pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), values], names=["i", "v"])

    summed = rows.mapInArrow(run, "i int, v array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    return {r[0]: np.array(r[1]) for r in summed.select("i", vector_to_array("v")).collect()}


# --- logistic maps ----------------------------------------------------------------------------------------


def fold_logistic(
    rows: DataFrame, xs: Sequence[str], event: str, weight: str, group: str = "grp", passes: int = 40, tol: float = 1e-10,
) -> dict[Fold, np.ndarray]:
    """Weighted logistic regressions, intercept first, of every fold: Newton's method, one pass over ``rows`` per step.

    A step that lowers a fold's likelihood is halved. Where the events are separated the coefficients grow until ``passes`` end.
    """
    p = len(xs) + 1
    columns = rows.select(F.col(group).cast("string").alias("g"), F.col(event).cast("double").alias("e"), F.col(weight).cast("double").alias("w"), *[
        F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)
    ])
    columns = columns.dropna(subset=["e", "w", *[f"x{k}" for k in range(p - 1)]])
    folds = fold_names(columns, "g")
    stats = columns.agg(*[f(f"x{k}") for k in range(p - 1) for f in (F.avg, F.stddev_pop)], F.sum("w")).first()
    middle, spread = np.array(stats[0:-1:2], float), np.array(stats[1:-1:2], float)
    spread[~(spread > 0)] = 1.0
    whole = float(stats[-1] or 1.0)

    def passed(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def add(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            raw = np.column_stack([batch.column(f"x{k}").to_numpy() for k in range(p - 1)])
            x = np.column_stack([np.ones(len(raw)), (raw - middle) / spread])
            e, w = batch.column("e").to_numpy()[:, None], batch.column("w").to_numpy()[:, None] / whole
            w = w * (_codes(batch, "g", folds)[:, None] != np.arange(len(folds)))
            z = x @ beta.T
            mu = 1 / (1 + np.exp(-z))
            curve = w * mu * (1 - mu)
            like = (w * (e * z - np.logaddexp(0, z))).sum(0)
            hess = np.einsum("if,ia,ib->fab", curve, x, x)
            return {0: like, 1: (w * (e - mu)).T @ x, 2: hess}

        found = _sums(columns, add)
        n = len(folds)
        return found[0], found[1].reshape(n, p), found[2].reshape(n, p, p)

    beta = np.zeros((len(folds), p))
    step, best = np.zeros_like(beta), np.full(len(folds), -np.inf)
    for _ in range(passes if rows.limit(1).count() else 0):
        like, grad, hess = passed(beta)
        worse = like < best - 1e-12
        step[worse] /= 2
        beta[worse] -= step[worse]
        good = ~worse
        ridge = 1e-12 * np.trace(hess, axis1=1, axis2=2)[:, None, None] + 1e-300
        step[good] = np.linalg.solve(hess[good] + ridge[good] * np.eye(p), grad[good][..., None])[..., 0]
        # A step of more than ten standard deviations of the logit is cut back: it is refined by the next one.
        size = np.abs(step).max(axis=1, keepdims=True)
        step[good] = (step * np.minimum(1.0, 10 / np.maximum(size, 1e-300)))[good]
        best[good] = like[good]
        beta[good] += step[good]
        if np.abs(step).max() < tol:
            break
    beta[:, 1:] /= spread
    beta[:, 0] -= beta[:, 1:] @ middle
    return dict(zip(folds, beta))


# --- monotone maps ----------------------------------------------------------------------------------------

#: Slices whose blocks are merged at a time, and cells of a slice at least.
MERGED, SLICE_CELLS = 16, 256


def _pool(x_low: np.ndarray, x_high: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[list, list, list, list]:
    """Pool adjacent violators: neighbouring blocks (weight w, weighted sum s) whose means fall become one."""
    low, high, weight, total = [], [], [], []
    for a, b, u, v in zip(x_low.tolist(), x_high.tolist(), w.tolist(), s.tolist()):
        while weight and total[-1] * u >= v * weight[-1]:
            low_, _ = low.pop(), high.pop()
            u, v, a = u + weight.pop(), v + total.pop(), low_
        low.append(a)
        high.append(b)
        weight.append(u)
        total.append(v)
    return low, high, weight, total


BLOCKS = "fold int, slice int, low double, high double, w double, s double"


def _block_table(parts: list[tuple[int, int, tuple]]) -> pa.Table:
    columns: list[list] = [[], [], [], [], [], []]
    for fold, piece, (low, high, w, s) in parts:
        for at, values in zip(columns, ([fold] * len(low), [piece] * len(low), low, high, w, s)):
            at += values
    kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
    return pa.table({n: pa.array(v, k) for n, v, k in zip(("fold", "slice", "low", "high", "w", "s"), columns, kinds)})


def fold_isotonic(rows: DataFrame, x: str, y: str, weight: str, group: str | None = "grp", folds: Sequence[Fold] | None = None) -> DataFrame:
    """Knots (fold, x, y) of weighted non-decreasing fits of y on x, of every fold at once.

    Equal x of a group are one cell. Cells are put into ranges of x; each range pools its own cells once per fold, leaving out the fold's group, and
    hands on blocks. Pooling is associative, so the blocks of neighbouring ranges are pooled again, ``MERGED`` ranges at a time, until one
    range is left. A block gives its two ends as knots. Cells without weight take no part. ``folds``: names in ``fold_names``; without
    ``group`` there is one fold, None.
    """
    known = rows.select(
        (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"), F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w"),
    ).dropna(subset=["x", "y", "w"]).filter("w > 0")
    folds = list(folds) if folds is not None else (fold_names(known, "g") if group else [None])
    place = {f: k for k, f in enumerate(folds) if f is not None}
    cells = materialise(known.groupBy("g", "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s")), "cells")
    spark = rows.sparkSession
    slices = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // SLICE_CELLS)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        at, w, s = (table.column(c).to_numpy() for c in ("x", "w", "s"))
        code = np.array([place.get(g, -1) for g in table.column("g").to_pylist()])
        piece = table.column("slice")[0].as_py()
        values, cell = np.unique(at, return_inverse=True)
        all_w, all_s = np.bincount(cell, w, len(values)), np.bincount(cell, s, len(values))
        common = None
        for k, fold in enumerate(folds):
            own = code == k if fold is not None else np.zeros(len(code), bool)
            if own.any():
                # Added up anew, not subtracted: a cell that only the fold's group has must vanish exactly.
                left_w, left_s = np.bincount(cell[~own], w[~own], len(values)), np.bincount(cell[~own], s[~own], len(values))
                some = np.bincount(cell[~own], minlength=len(values)) > 0
                pooled = _pool(values[some], values[some], left_w[some], left_s[some])
            else:
                pooled = common = common or _pool(values, values, all_w, all_s)
            yield from _block_table([(k, piece, pooled)]).to_batches()

    ranged = cells.repartitionByRange(slices, "x").withColumn("slice", F.spark_partition_id())
    blocks = ranged.mapInArrow(first, BLOCKS)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        pooled = _pool(*(table.column(c).to_numpy() for c in ("low", "high", "w", "s")))
        return _block_table([(table.column("fold")[0].as_py(), table.column("slice")[0].as_py(), pooled)])

    while slices > 1:
        slices = -(-slices // MERGED)
        blocks = blocks.withColumn("slice", F.floor(F.col("slice") / MERGED).cast("int")).groupBy("fold", "slice").applyInArrow(merge, BLOCKS)
    names = F.array(*[F.lit(f).cast("string") for f in folds])
    knots = materialise(blocks, "blocks").select(F.get(names, F.col("fold")).alias("fold"), "low", "high", (F.col("s") / F.col("w")).alias("y"))
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    return knots.select("fold", F.explode(ends).alias("x"), "y")


def interpolate(rows: DataFrame, knots: DataFrame, x: str, out: str, key: str | None = None) -> DataFrame:
    """Piecewise-linear lookup of ``x`` among the knots of the row's fold (``key``; without it knots of fold None), constant outside.

    Rows and knots are ordered together once; the running number of knots places every row between two of them. No fold's knots are
    gathered anywhere.
    """
    own = rows.withColumn("_f", F.col(key).cast("string") if key else F.lit(None).cast("string")).withColumn("_at", F.monotonically_increasing_id())
    own = materialise(own.withColumn("_x", F.col(x).cast("double")).withColumn("_k", F.lit(0).cast("long")), "rows")
    marks = knots.select(F.col("fold").alias("_f"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(1).cast("long").alias("_k"))
    both = own.filter("_x IS NOT NULL").unionByName(marks, allowMissingColumns=True)
    # A knot stands before the rows at its place, so a row on a knot takes the knot's value.
    placed = materialise(cumulate(both, ["_f"], ["_x", F.col("_k").desc(), F.col("_at").asc_nulls_first()], ["_k"]), "placed")
    found = placed.filter("_k = 0").withColumnRenamed("_k_before", "_n")
    numbered = placed.filter("_k = 1").select("_f", (F.col("_k_before") + 1).alias("_n"), F.col("_x").alias("_kx"), F.col("_y").alias("_ky"))
    bound = numbered.count()
    low = attach(found.drop("_y", "_k"), numbered, ["_f", "_n"], bound)
    after = numbered.select("_f", (F.col("_n") - 1).alias("_n"), F.col("_kx").alias("_hx"), F.col("_ky").alias("_hy"))
    both_ends = attach(low, after, ["_f", "_n"], bound)
    inside = F.col("_ky") + (F.col("_hy") - F.col("_ky")) * F.try_divide(F.col("_x") - F.col("_kx"), F.col("_hx") - F.col("_kx"))
    value = F.when(F.col("_kx").isNull(), F.col("_hy")).when(F.col("_hx").isNull(), F.col("_ky")).otherwise(inside)
    done = both_ends.select(*rows.columns, value.alias(out))
    return done.unionByName(own.filter("_x IS NULL").select(*rows.columns, F.lit(None).cast("double").alias(out)))


# --- pairwise ranker --------------------------------------------------------------------------------------


#: Numbers of the curvatures that a task sums at once: the problems are taken in chunks of so many.
CURVATURES = 1 << 22


class PairFits:
    """Penalised logistic fits, without intercept, of every fold and grid point on pair differences (grp, outcome, x).

    Each training group has the same total weight. The objective of a fold is its weighted mean loss plus
    ``lambda (alpha |b|_1 + (1 - alpha) |b|^2 / 2)`` in coordinates divided by the fold's ``scales``. The problems advance together by proximal Newton steps: a
    pass over the pairs gives loss, gradient and curvature of all of them, and each then minimises its quadratic with its penalty, by
    coordinate descent over all problems at once. A step that raises an objective is halved.
    """

    def __init__(self, data: DataFrame, folds: Sequence[Fold], scales: np.ndarray):
        self.data, self.folds, self.scales = data, list(folds), scales
        self.features = scales.shape[1]
        sizes = {r[0]: r[1] for r in data.groupBy("grp").count().collect()}
        self.sizes = np.array([sizes.get(f, 0) for f in folds], float)
        self.trained = np.array([max(sum(n > 0 for g, n in sizes.items() if g is not None and g != f), 1) for f in folds], float)

    def _passed(self, beta: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, gradient and curvature of models with coefficients ``beta`` (in scaled coordinates), each of the fold numbered in ``fold``."""
        raw, folds, sizes, models, k = beta / self.scales[fold], self.folds, self.sizes, len(beta), self.features

        def add(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            d, code = _matrix(batch.column("x"), batch.num_rows), _codes(batch, "grp", folds)
            y = batch.column("outcome").to_numpy().astype(float)[:, None]
            w = np.where(code >= 0, 1 / np.maximum(sizes[code], 1), 0.0)[:, None] * (code[:, None] != fold)
            z = d @ raw.T
            mu = 1 / (1 + np.exp(-z))
            bend = w * mu * (1 - mu)
            curves = {m + 2: (d * bend[:, m : m + 1]).T @ d for m in range(models)}
            return {0: (w * (np.logaddexp(0, z) - y * z)).sum(0), 1: (w * (mu - y)).T @ d, **curves}

        found = _sums(self.data, add)
        scale, groups = self.scales[fold], self.trained[fold]
        curve = np.stack([found[m + 2].reshape(k, k) for m in range(models)])
        return found[0] / groups, found[1].reshape(models, k) / groups[:, None] / scale, curve / (groups[:, None, None] * scale[:, :, None] * scale[:, None, :])

    def solve(self, fold: np.ndarray, l1: np.ndarray, l2: np.ndarray, passes: int = 100, tol: float = 1e-6) -> np.ndarray:
        """Coefficients (models, features) in scaled coordinates."""
        step = max(1, CURVATURES // self.features**2)
        chunks = [slice(k, k + step) for k in range(0, len(fold), step)]
        return np.concatenate([self._solve(fold[c], l1[c], l2[c], passes, tol) for c in chunks])

    def _solve(self, fold: np.ndarray, l1: np.ndarray, l2: np.ndarray, passes: int, tol: float) -> np.ndarray:
        b = np.zeros((len(fold), self.features))
        at, last, open_ = b.copy(), np.full(len(fold), np.inf), np.arange(len(fold))
        for _ in range(passes):
            loss, grad, curve = self._passed(at[open_], fold[open_])
            here, p1, p2 = at[open_], l1[open_], l2[open_]
            value = loss + (p1[:, None] * np.abs(here)).sum(1) + (p2[:, None] * here * here).sum(1) / 2
            good = value <= last[open_] + 1e-12 * np.abs(value)
            best = _descend_all(here[good], grad[good], curve[good], p1[good], p2[good])
            size = np.abs(best - here[good]).max(axis=1, initial=0.0)
            ended = size <= tol * np.maximum(1.0, np.abs(best).max(axis=1, initial=0.0))
            which = open_[good]
            b[which], last[which], at[which] = here[good], value[good], best
            at[open_[~good]] = (at[open_[~good]] + b[open_[~good]]) / 2
            b[which[ended]] = best[ended]
            open_ = np.setdiff1d(open_, which[ended])
            if not len(open_):
                return b
        raise ValueError("a pairwise fit did not converge; a model is never returned unsolved")

    def pair_errors(self, beta: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Share of wrongly ordered pairs of each model's left-out group (NaN without one)."""
        raw = beta / self.scales[fold]
        folds = self.folds

        def add(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            d, code = _matrix(batch.column("x"), batch.num_rows), _codes(batch, "grp", folds)
            y = batch.column("outcome").to_numpy()[:, None] == 1
            mine = code[:, None] == fold
            wrong = (((d @ raw.T) > 0) != y) & mine
            return {0: np.concatenate([wrong.sum(0), mine.sum(0)]).astype(float)}

        found = _sums(self.data, add)[0]
        wrong, n = found[: len(fold)], found[len(fold) :]
        return np.divide(wrong, n, out=np.full(len(fold), np.nan), where=n > 0)


def _descend_all(at: np.ndarray, slope: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Minimise quadratics around ``at`` (slope, curvature ``h``) with their penalties, one coordinate of all problems at a time."""
    b, slope = at.copy(), slope.copy()
    top = np.maximum(np.abs(slope).max(axis=1, initial=0.0), 1e-12)
    for _ in range(1000):
        moved = np.zeros(len(b))
        for j in range(b.shape[1]):
            hj = h[:, j, j]
            r = hj * b[:, j] - slope[:, j]
            new = np.sign(r) * np.maximum(np.abs(r) - l1, 0.0) / np.maximum(hj + l2, 1e-300)
            step = new - b[:, j]
            if step.any():
                slope += step[:, None] * h[:, j]
                b[:, j] = new
                moved = np.maximum(moved, np.abs(step) * (hj + l2))
        if (moved <= 1e-9 * top).all():
            break
    return b


def fold_scales(rows: DataFrame, folds: Sequence[Fold], group: str = "grp") -> np.ndarray:
    """Standard deviation of every feature over the rows a fold trains on (1 where it is 0): group sums, total less the own."""
    place = list(folds)

    def add(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x, code = _matrix(batch.column("x"), batch.num_rows), _codes(batch, "g", place)
        out = {}
        for c in np.unique(code):
            part = x[code == c]
            out[int(c)] = np.concatenate([[len(part)], part.sum(0), (part * part).sum(0)])
        return out

    own = _sums(rows.select(F.col(group).cast("string").alias("g"), "x"), add)
    total = sum(own.values())
    k = (len(total) - 1) // 2
    out = np.ones((len(place), k))
    for i, fold in enumerate(place):
        left = total - own.get(i, 0.0) if fold is not None else total
        n = max(left[0], 1.0)
        var = (left[1 + k :] - left[1 : 1 + k] ** 2 / n) / max(n - 1, 1.0)
        out[i] = np.where(var > 1e-12, np.sqrt(np.maximum(var, 0.0)), 1.0)
    return out
