"""Leave-one-group-out elastic nets over sample rows (id, grp, y, x), x an array of feature values with NULL for unknown.

All folds are fitted from two passes over the data. The first sums, per group, moments of every feature (``group_moments``); they add up over
groups, so every outer and inner fold ranks its features from the total less the groups it leaves out, and only features that some fold keeps
go on (``screen``). The second sums, per group, the products of the columns (1, y, x, missing) of these, a tile of rows of the product at a
time where it is large. Median imputation, standardising and the penalty path are exact arithmetic on those sums. Each fold's small
problem (features by features, whatever the number of rows) is solved in its own task, and one more pass scores the left-out rows of all
inner folds at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.functions.scalars import draw_key
from heldout.operators.cohort import within_group_pairs
from heldout.operators.fold_fits import PairFits, fold_names, fold_scales
from heldout.operators.metrics import metric_columns
from heldout.operators.ranking import (
    argmin_row, bracket_interpolate, calibration_knots, relative_target, stratified_holdout,
)
from heldout.plans.skew import attach, hot_rows, number_rows, order_statistic, profile, quantiles
from heldout.plans.storage import materialise

ALPHAS = (0.1, 0.5, 1.0)
STEPS = 8
RATIO = 1e-3
TASK_BYTES = 512 << 20  # sums a task may hold before it passes them on
MODEL_BYTES = 256 << 20  # models sent to the scoring tasks at a time

# Rows of the summed table below the product matrix: within-group sums of squares as a quadratic in the imputed
# value (three rows), unweighted sums, squares and missing counts, and (rows, groups).
WSS0, WSS1, WSS2, SUM, SQUARE, MISSING, COUNTS, MEDIAN = -1, -2, -3, -4, -5, -6, -7, -8


def group_list(rows: DataFrame, group: str = "grp") -> DataFrame:
    """One row with the sorted array of groups."""
    return rows.select(group).distinct().agg(F.array_sort(F.collect_set(group)).alias("groups"))


def exclusion_sets(rows: DataFrame, group: str = "grp") -> DataFrame:
    """Outer folds (inner NULL, one group left out) and their inner folds (two groups left out)."""
    outer = group_list(rows, group).select("groups", F.explode("groups").alias("outer_group"))
    inner = F.concat(F.array(F.lit(None).cast("string")), F.array_remove("groups", F.col("outer_group")))
    sets = outer.select("outer_group", F.explode(inner).alias("inner_group"))
    return sets.select(
        F.concat_ws("|", "outer_group", "inner_group").alias("set_id"), "outer_group", "inner_group",
        F.array_compact(F.array("outer_group", "inner_group")).alias("excluded"),
    )


def single_sets(rows: DataFrame, group: str = "grp") -> DataFrame:
    """One fit on all groups and an inner fold per group."""
    inner = F.concat(F.array(F.lit(None).cast("string")), F.col("groups"))
    sets = group_list(rows, group).select(F.explode(inner).alias("inner_group"))
    return sets.select(
        F.concat_ws("|", F.lit("ALL"), "inner_group").alias("set_id"), F.lit("ALL").alias("outer_group"), "inner_group",
        F.array_compact(F.array("inner_group")).alias("excluded"),
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def group_moments(rows: DataFrame, group: str = "grp") -> DataFrame:
    """The additive rows of the summed table that need no products of two features, per group: (grp, i, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _matrix(b)
            gone = np.isnan(x)
            x = np.where(gone, 0.0, x)
            g = np.asarray(b.column("grp").to_pylist(), dtype=object)
            for name in dict.fromkeys(g):
                own = g == name
                part = np.vstack([np.full(x.shape[1], own.sum()), x[own].sum(0), (x[own] ** 2).sum(0), gone[own].sum(0)])
                acc[name] = acc.get(name, 0.0) + part
        for name, m in acc.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * 4), pa.array(np.arange(4, dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], names=["grp", "i", "v"]
            )

    known = rows.filter("y IS NOT NULL").select(F.col(group).alias("grp"), "x")
    summed = known.mapInArrow(run, "grp string, i int, v array<double>").groupBy("grp", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    wide = summed.groupBy("grp").agg(*[F.max(F.when(F.col("i") == k, vector_to_array("v"))).alias(c) for k, c in enumerate("nsqu")])
    return _lines(wide.withColumn("n", F.get("n", F.lit(0))))


def _lines(sums: DataFrame) -> DataFrame:
    """(grp, i, v) from per-group rows, sums, squares and missing counts (grp, n, s, q, u)."""
    n = F.col("n")
    w0 = F.zip_with("q", "s", lambda q, s: q - s * s / n)
    w1 = F.zip_with("s", "u", lambda s, u: s * u / n)
    w2 = F.transform("u", lambda u: u - u * u / n)
    lines = [(WSS0, w0), (WSS1, w1), (WSS2, w2), (SUM, F.col("s")), (SQUARE, F.col("q")), (MISSING, F.col("u")), (COUNTS, F.array(n, F.lit(1.0)))]
    return sums.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in lines])).alias("_r")).select("grp", "_r.i", "_r.v")


def group_products(rows: DataFrame, group: str = "grp", features: int | None = None) -> DataFrame:
    """Per group, row i of A'A with A = (1, y, x with 0 for unknown, unknown): (grp, i, v).

    Tasks sum their own rows with one matrix product per batch and group; the partial rows are added on the map
    side and then per (group, i). With ``features`` known, the rows of the product are taken in tiles that keep one group's sums of a tile within
    ``TASK_BYTES``; each tile reads the data once.
    """
    width = 2 + 2 * features if features else 0
    tile = max(1, TASK_BYTES // (8 * width)) if features else None
    tiles = range(0, width, tile) if features else [0]
    parts = None
    for start in tiles:
        one = _product_tile(rows, group, start, tile)
        parts = one if parts is None else parts.unionByName(one)
    return parts


def _product_tile(rows: DataFrame, group: str, start: int, size: int | None) -> DataFrame:
    stop = None if size is None else start + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, np.ndarray] = {}

        def flush():
            for g, m in acc.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(m)), pa.array(np.arange(start, start + len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))],
                    names=["grp", "i", "v"],
                )
            acc.clear()

        for b in batches:
            if b.num_rows == 0:
                continue
            x = _matrix(b)
            gone = np.isnan(x)
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            a = np.column_stack([np.ones(len(y)), y, np.where(gone, 0.0, x), gone])
            g = np.asarray(b.column("grp").to_pylist(), dtype=object)
            for name in dict.fromkeys(g):
                part = a[g == name]
                acc[name] = acc.get(name, 0.0) + part[:, start:stop].T @ part
                if sum(m.nbytes for m in acc.values()) > TASK_BYTES:
                    yield from flush()
        yield from flush()

    known = rows.filter("y IS NOT NULL").select(F.col(group).alias("grp"), F.col("y").cast("double").alias("y"), "x")
    partial = known.mapInArrow(run, "grp string, i int, v array<double>")
    summed = partial.groupBy("grp", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    return summed.select("grp", "i", vector_to_array("v").alias("v"))


def _extras(products: DataFrame, features: int) -> DataFrame:
    """The additive rows below the product matrix, per group, from its first row and diagonal."""
    k = features
    diag = products.filter(F.col("i").between(2, k + 1)).select("grp", F.struct("i", F.get("v", F.col("i")).alias("d")).alias("d"))
    diag = diag.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list("d")), lambda e: e["d"]).alias("q"))
    head = products.filter("i = 0").select(
        "grp", F.get("v", F.lit(0)).alias("n"), F.slice("v", 3, k).alias("s"), F.slice("v", k + 3, k).alias("u")
    )
    return _lines(head.join(diag, "grp"))


def less_excluded(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Additive rows of the training groups of each exclusion set, (set_id, i, v): the total less the excluded groups."""
    total = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("i", vector_to_array("v").alias("v"))
    ids = sets.agg(F.collect_list("set_id").alias("_ids")).withColumn("_one", F.lit(1))
    plus = total.withColumn("_one", F.lit(1)).join(F.broadcast(ids), "_one").select(F.explode("_ids").alias("set_id"), "i", "v")
    minus = sets.select("set_id", F.explode("excluded").alias("grp")).join(parts, "grp").select(
        "set_id", "i", F.transform("v", lambda e: -e).alias("v")
    )
    summed = plus.unionByName(minus).groupBy("set_id", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    return summed.select("set_id", "i", vector_to_array("v").alias("v"))


def screen(moments: DataFrame, sets: DataFrame, medians: DataFrame | None, top: int, rank: str, max_missing: float) -> list[int]:
    """Positions of the features that at least one exclusion set keeps, in order: features at most, whatever the rows."""
    sums = less_excluded(moments, sets)
    if medians is not None:
        sums = sums.unionByName(medians)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pos": _kept(dict(zip(pdf["i"], pdf["v"])), top, rank, max_missing)[0]})

    kept = sums.groupBy("set_id").applyInPandas(keep, "pos long").distinct()
    return sorted(r[0] for r in kept.collect())


def _kept(line: dict[int, np.ndarray], top: int, rank: str, max_missing: float) -> tuple[np.ndarray, ...]:
    """The features a training set keeps, from its moments; with its medians, means and variances."""
    k = len(line[SUM])
    n, groups = np.asarray(line[COUNTS])[:2]
    med = np.asarray(line.get(MEDIAN, np.zeros(k)), dtype=float)
    s, q, u = (np.asarray(line[i], dtype=float) for i in (SUM, SQUARE, MISSING))
    s, q = s + u * med, q + u * med * med
    mean, var = s / n, np.maximum(q - s * s / n, 0.0) / (n - 1)
    within = np.asarray(line[WSS0]) - 2 * med * np.asarray(line[WSS1]) + med * med * np.asarray(line[WSS2])
    score = within / max(n - groups, 1.0) if rank == "within_group" else var
    order = np.lexsort((np.arange(k), -score))
    usable = (u <= max_missing * n) & (score > 1e-14) & (var > 0)
    return np.sort(order[usable[order]][:top]), med, mean, var, n


def set_sums(products: DataFrame, sets: DataFrame, features: int, weights: str = "sample") -> DataFrame:
    """Sums over the training groups of each exclusion set: total less the excluded groups, (set_id, i, v).

    ``weights='group'`` gives each group the same total weight by dividing its products by its size.
    """
    extras = _extras(products, features)
    if weights == "group":
        sizes = products.filter("i = 0").select("grp", F.get("v", F.lit(0)).alias("_n"))
        products = products.join(sizes, "grp").select("grp", "i", F.transform("v", lambda e: e / F.col("_n")).alias("v"))
    return less_excluded(products.unionByName(extras), sets)


def fold_medians(rows: DataFrame, sets: DataFrame, features: int, group: str = "grp") -> DataFrame:
    """Exact training median per exclusion set of each feature that has unknown values: (set_id, i, v).

    Medians do not add up, so these (and only these) features are read again. While a feature's values fit a task they are sorted there once, and
    each set's median is a search in running counts, all rows less the excluded groups'. Beyond that the rows are given to every set.
    """
    cells = rows.select(group, F.posexplode("x").alias("pos", "value"))
    holey = cells.groupBy("pos").agg(F.bool_or(F.col("value").isNull()).alias("_h")).filter("_h").select("pos")
    known = cells.join(F.broadcast(holey), "pos", "left_semi").filter("value IS NOT NULL")
    if profile(rows, []).largest <= hot_rows(rows.sparkSession):
        listed = [(r["set_id"], list(r["excluded"])) for r in sets.select("set_id", "excluded").collect()]

        def middle(table: pa.Table) -> pa.Table:
            value = table.column("value").to_numpy()
            order = np.argsort(value, kind="stable")
            value, names = value[order], np.asarray(table.column("g").to_pylist(), dtype=object)[order]
            counts = {name: np.cumsum(names == name) for name in dict.fromkeys(names)}
            ids, found = [], []
            for set_id, excluded in listed:
                upto = np.arange(1, len(value) + 1) - sum(counts[e] for e in dict.fromkeys(excluded) if e in counts)
                if upto[-1] > 0:
                    low, high = (value[np.searchsorted(upto, at + 1)] for at in ((upto[-1] - 1) // 2, upto[-1] // 2))
                    ids.append(set_id)
                    found.append(low if low == high else 0.5 * low + 0.5 * high)
            return pa.table({"set_id": pa.array(ids, pa.string()), "pos": pa.array([table.column("pos")[0].as_py()] * len(ids), pa.int32()), "median": pa.array(found, pa.float64())})

        plain = known.select(F.col(group).cast("string").alias("g"), "pos", F.col("value").cast("double").alias("value"))
        med = plain.groupBy("pos").applyInArrow(middle, "set_id string, pos int, median double")
    else:
        listed = sets.agg(F.collect_list(F.struct("set_id", "excluded")).alias("_sets")).withColumn("_one", F.lit(1))
        train = F.filter("_sets", lambda s: ~F.array_contains(s["excluded"], F.col(group)))
        spread = known.withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one").select("pos", "value", F.explode(train).alias("_s"))
        med = quantiles(spread.select("pos", "value", "_s.set_id"), ["set_id", "pos"], "value", {"median": 0.5})
    by_set = med.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "median"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda p: F.coalesce(F.try_element_at("_m", p), F.lit(0.0)))
    return by_set.select("set_id", F.lit(MEDIAN).alias("i"), dense.alias("v"))


def _path(c: np.ndarray, alpha: float, steps: int) -> np.ndarray:
    top = np.abs(c).max(initial=0.0) / max(alpha, 0.01)
    if not np.isfinite(top) or top <= 0:
        return np.array([1.0, 0.1, 0.01])
    return top * RATIO ** (np.arange(steps) / (steps - 1))


def _descend(z: np.ndarray, c: np.ndarray, l1: float, l2: float, b: np.ndarray, tol: float = 1e-7) -> np.ndarray:
    """Coordinate descent for b'zb/2 - c'b + l1|b| + l2 b'b/2, starting from b.

    Sweeps run over the non-zero coefficients until they settle; a sweep over all then lets others in.
    """
    d, grad = np.diag(z) + l2, c - z @ b
    limit = tol * max(np.abs(c).max(initial=0.0), 1e-12)

    def sweep(which):
        worst = 0.0
        for j in which:
            r = grad[j] + z[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / d[j]
            step = new - b[j]
            if step:
                np.subtract(grad, step * z[j], out=grad)
                b[j] = new
                worst = max(worst, abs(step))
        return worst

    for _ in range(200):
        if sweep(range(len(b))) < limit:
            break
        for _ in range(500):
            if sweep(np.flatnonzero(b)) < limit:
                break
    else:
        raise ValueError("a penalty path did not converge; a model is never returned unsolved")
    return b


RANKERS = ("pooled", "within_group")


def _solver(alphas: Sequence[float], steps: int, top: int, rank: str, max_missing: float) -> Callable:
    """One exclusion set: rebuild the training moments, filter, rank and standardise the features, walk the penalty paths.

    A feature takes part if at most ``max_missing`` of its values in this training set are unknown.
    """
    if rank not in RANKERS:
        raise ValueError(f"unknown ranker: {rank}")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        line = dict(zip(pdf["i"], pdf["v"]))
        k = len(line[SUM])
        keep, med, mean, var, n = _kept(line, top, rank, max_missing)
        if len(keep) < 2:
            raise ValueError("a training set has fewer than two usable features")
        full = np.vstack([np.asarray(line[i], dtype=float) for i in range(2 + 2 * k)])
        put = np.zeros((2 + 2 * k, 2 + k))
        put[0, 0] = put[1, 1] = 1.0
        put[2 + np.arange(k), 2 + np.arange(k)] = 1.0
        put[2 + k + np.arange(k), 2 + np.arange(k)] = med
        g = put.T @ full @ put
        w, sd = g[0, 0], np.sqrt(var[keep])
        wm, ym = g[0, 2:][keep] / w, g[0, 1] / w
        cov = (g[2:, 2:][np.ix_(keep, keep)] / w - np.outer(wm, wm)) / np.outer(sd, sd)
        cxy = (g[2:, 1][keep] / w - wm * ym) / sd
        sdy = np.sqrt(max(g[1, 1] / w - ym * ym, 0.0))
        out = []
        for alpha in alphas:
            given = pdf["paths"].iloc[0] if "paths" in pdf.columns else None
            path = np.asarray(dict(given)[alpha]) if given is not None else _path(cxy, alpha, steps)
            b = np.zeros(len(keep))
            for i, lam in enumerate(path):
                b = _descend(cov, cxy, lam * alpha, lam * (1 - alpha) / sdy if sdy > 0 else lam, b.copy())
                raw = b / sd
                nz = np.flatnonzero(b)
                out.append({
                    "set_id": pdf["set_id"].iloc[0], "alpha": float(alpha), "step": i, "lambda": float(lam),
                    "intercept": float(ym - raw @ wm), "pos": keep[nz].tolist(), "beta": raw[nz].tolist(),
                    "fill": med[keep[nz]].tolist(), "mean": mean[keep[nz]].tolist(), "sd": sd[nz].tolist(), "n_train": int(n),
                })
        return pd.DataFrame(out)

    return solve


MODELS = (
    "set_id string, alpha double, step int, lambda double, intercept double, pos array<int>, beta array<double>, "
    "fill array<double>, mean array<double>, sd array<double>, n_train long"
)


def fit_sets(
    rows: DataFrame, sets: DataFrame, features: int, alphas: Sequence[float] = ALPHAS, steps: int = STEPS,
    top: int = 5000, rank: str = "pooled", weights: str = "sample", group: str = "grp", missing: bool = True, max_missing: float = 0.05,
) -> DataFrame:
    """Models of all exclusion sets over the penalty grid; inner folds use the path of their outer fold.

    Columns of ``MODELS`` with outer_group and inner_group. The coefficients are on the raw scale.
    """
    if rank not in RANKERS:
        raise ValueError(f"unknown ranker: {rank}")
    medians = materialise(fold_medians(rows, sets, features, group), "medians") if missing else None
    kept = screen(materialise(group_moments(rows, group), "moments"), sets, medians, top, rank, max_missing)
    if len(kept) < 2:
        raise ValueError("a training set has fewer than two usable features")
    places = F.array(*[F.lit(p) for p in kept]) if len(kept) < features else None
    if places is not None:
        rows = rows.withColumn("x", F.transform(places, lambda p: F.get("x", p)))
    sums = set_sums(group_products(rows, group, len(kept)), sets, len(kept), weights)
    if medians is not None:
        sums = sums.unionByName(medians if places is None else medians.withColumn("v", F.transform(places, lambda p: F.get("v", p))))
    # few rows but long solves: keep one task per few sets instead of letting small partitions be merged
    tasks = min(sets.count(), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    sums = materialise(sums)
    outer_ids = sets.filter("inner_group IS NULL").select("set_id", "outer_group")
    solve = _solver(tuple(alphas), steps, top, rank, max_missing)
    outer = materialise(sums.join(outer_ids, "set_id").select("set_id", "i", "v").repartition(tasks, "set_id").groupBy("set_id").applyInPandas(solve, MODELS))
    paths = (
        outer.join(outer_ids, "set_id").groupBy("outer_group", "alpha")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "lambda"))), lambda e: e["lambda"]).alias("path"))
        .groupBy("outer_group").agg(F.map_from_entries(F.collect_list(F.struct("alpha", "path"))).alias("paths"))
    )
    inner_ids = sets.filter("inner_group IS NOT NULL").select("set_id", "outer_group").join(paths, "outer_group").select("set_id", "paths")
    inner = sums.join(inner_ids, "set_id").repartition(tasks, "set_id").groupBy("set_id").applyInPandas(solve, MODELS)
    both = outer.unionByName(inner)
    if places is not None:
        both = both.withColumn("pos", F.transform("pos", lambda p: F.get(places, p)))
    return both.join(sets.select("set_id", "outer_group", "inner_group"), "set_id")


def _dense(models: pd.DataFrame, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, f = np.zeros((features, len(models))), np.zeros((features, len(models)))
    for c, (pos, beta, fill) in enumerate(zip(models["pos"], models["beta"], models["fill"])):
        b[list(pos), c] = beta
        f[list(pos), c] = np.asarray(beta) * np.asarray(fill)
    return models["intercept"].to_numpy(), b, f


def _chunks(models: DataFrame, features: int) -> Iterator[pd.DataFrame]:
    """Models for the scoring tasks, a bounded number at a time."""
    ids = [r[0] for r in models.select("outer_group").distinct().orderBy("outer_group").collect()]
    each = models.count() * features * 16 / max(len(ids), 1)
    size = max(1, int(MODEL_BYTES // max(each, 1)))
    for i in range(0, len(ids), size):
        yield models.filter(F.col("outer_group").isin(ids[i : i + size])).toPandas()


def inner_losses(rows: DataFrame, models: DataFrame, features: int, group: str = "grp") -> DataFrame:
    """MAE of every inner model on the group it left out: (outer_group, inner_group, alpha, step, lambda, n, mae).

    Rows are read once per chunk of models; tasks send on only error sums per model.
    """
    spark, parts = rows.sparkSession, None
    inner = materialise(models.filter("inner_group IS NOT NULL"))
    known = rows.filter("y IS NOT NULL").select(F.col(group).alias("grp"), F.col("y").cast("double").alias("y"), "x")
    for chunk in _chunks(inner, features):
        by_group = {
            g: (m[["outer_group", "inner_group", "alpha", "step", "lambda"]].reset_index(drop=True), *_dense(m, features))
            for g, m in chunk.groupby("inner_group")
        }
        shared = spark.sparkContext.broadcast(by_group)

        def run(batches, shared=shared):
            for b in batches:
                if b.num_rows == 0:
                    continue
                x, y = _matrix(b), b.column("y").to_numpy(zero_copy_only=False)
                g = np.asarray(b.column("grp").to_pylist(), dtype=object)
                for name in dict.fromkeys(g):
                    if name not in shared.value:
                        continue
                    facts, a, beta, fill = shared.value[name]
                    part, gone = x[g == name], np.isnan(x[g == name])
                    err = np.abs(a + np.where(gone, 0.0, part) @ beta + gone @ fill - y[g == name][:, None])
                    yield pa.RecordBatch.from_pandas(facts.assign(n=len(part), err=err.sum(0)), preserve_index=False)

        schema = "outer_group string, inner_group string, alpha double, step int, lambda double, n long, err double"
        out = known.mapInArrow(run, schema).groupBy("outer_group", "inner_group", "alpha", "step", "lambda").agg(
            F.sum("n").alias("n"), (F.sum("err") / F.sum("n")).alias("mae")
        )
        parts = out if parts is None else parts.unionByName(out)
    return parts


def tune(losses: DataFrame) -> DataFrame:
    """Mean over inner groups of the group's MAE for each grid point, with its standard error."""
    return losses.groupBy("outer_group", "alpha", "step", "lambda").agg(
        F.avg("mae").alias("loss"),
        (F.stddev_samp("mae") / F.sqrt(F.count("mae"))).alias("se"),
        F.count("mae").alias("inner_folds"),
    )


def select_min(tuning: DataFrame) -> DataFrame:
    """The grid point with the least loss per outer fold; the first in (alpha, path) order on ties."""
    return argmin_row(tuning, ["outer_group"], "loss", ["alpha", "step"])


def select_1se(tuning: DataFrame) -> DataFrame:
    """The alpha with the least loss, then the largest penalty whose loss is within one standard error of it."""
    best = select_min(tuning).select("outer_group", "alpha", (F.col("loss") + F.col("se")).alias("_limit"))
    near = tuning.join(best, ["outer_group", "alpha"]).filter(F.col("loss") <= F.col("_limit")).drop("_limit")
    near = near.withColumn("_neg", -F.col("lambda"))
    return argmin_row(near, ["outer_group"], "_neg", ["step"]).drop("_neg")


def score(rows: DataFrame, models: DataFrame, features: int, left_out: bool, group: str = "grp") -> DataFrame:
    """Predictions of one model per outer fold: on the group it left out, or on all rows for a single model.

    Each row meets the one model of its fold in a join; the sum over non-zero coefficients stays in the JVM.
    """
    m = models.select("outer_group", "intercept", F.arrays_zip("pos", "beta", "fill").alias("_terms"))
    if left_out:
        j = attach(rows.withColumn("outer_group", F.col(group)), m, ["outer_group"], profile(rows, [group]).groups, "inner")
    else:
        j = rows.withColumn("_one", F.lit(1)).join(F.broadcast(m.withColumn("_one", F.lit(1))), "_one").drop("_one")
    terms = F.aggregate(
        "_terms", F.lit(0.0), lambda acc, t: acc + t["beta"] * F.coalesce(F.get("x", t["pos"]), t["fill"])
    )
    return j.withColumn("pred", F.col("intercept") + terms).drop("_terms", "intercept")


def logo_nested(
    rows: DataFrame, features: int, alphas: Sequence[float] = ALPHAS, steps: int = STEPS, top: int = 5000,
    rank: str = "pooled", weights: str = "sample", missing: bool = True, rule: str = "min", max_missing: float = 0.05,
) -> dict[str, DataFrame]:
    """The whole nested run: models, tuning table, selected point per fold and predictions of each left-out group.

    Nested folds leave out two groups at a time, so three groups are the least; fewer are an error.
    """
    if rank not in RANKERS:
        raise ValueError(f"unknown ranker: {rank}")
    sets = materialise(exclusion_sets(rows))
    if sets.filter("inner_group IS NULL").limit(3).count() < 3:
        raise ValueError("nested leave-one-group-out needs three groups or more")
    models = materialise(fit_sets(rows, sets, features, alphas, steps, top, rank, weights, missing=missing, max_missing=max_missing))
    tuning = materialise(tune(inner_losses(rows, models, features)))
    chosen = select_1se(tuning) if rule == "1se" else select_min(tuning)
    final = models.filter("inner_group IS NULL").join(chosen.select("outer_group", "alpha", "step", "loss"), ["outer_group", "alpha", "step"])
    train_mean = rows.groupBy("grp").agg(F.count("y").alias("_n"), F.sum("y").alias("_s"))
    whole = train_mean.agg(F.sum("_n").alias("_n_all"), F.sum("_s").alias("_s_all")).withColumn("_one", F.lit(1))
    null = train_mean.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").select(
        "grp", F.try_divide(F.col("_s_all") - F.col("_s"), F.col("_n_all") - F.col("_n")).alias("null_pred")
    )
    scored = score(rows, final, features, left_out=True)
    predictions = attach(scored.select("id", "grp", F.col("y").alias("actual"), "pred"), null, ["grp"], profile(rows, ["grp"]).groups)
    return {"models": models, "tuning": tuning, "selected": chosen, "final": final, "predictions": predictions}


def logo_merge(predictions: DataFrame, selected: DataFrame) -> DataFrame:
    """One metrics row per left-out group with its tuning choice and null, and the pooled row."""
    aggs = [*metric_columns(), F.avg(F.abs(F.col("actual") - F.col("null_pred"))).alias("null_mae")]
    per = predictions.groupBy("grp").agg(*aggs).join(
        selected.select(F.col("outer_group").alias("grp"), "alpha", "lambda"), "grp", "left"
    )
    pooled = predictions.agg(*aggs).withColumn("grp", F.lit("POOLED"))
    return per.unionByName(pooled, allowMissingColumns=True)


def export_coefficients(model: DataFrame, names: Sequence[str]) -> DataFrame:
    """Intercept first, then non-zero coefficients by size: (outer_group, term, term_type, coefficient)."""
    lookup = F.array(*[F.lit(n) for n in names])
    terms = model.select("outer_group", F.explode(F.arrays_zip("pos", "beta")).alias("_t")).select(
        "outer_group", F.get(lookup, F.col("_t.pos")).alias("term"), F.lit("feature").alias("term_type"), F.col("_t.beta").alias("coefficient")
    )
    head = model.select("outer_group", F.lit("(Intercept)").alias("term"), F.lit("intercept").alias("term_type"), F.col("intercept").alias("coefficient"))
    return head.unionByName(terms).orderBy("outer_group", F.col("term_type").desc(), F.abs("coefficient").desc(), "term")


def tuning_folds(rows: DataFrame, seed: int = 0, group: str = "grp") -> DataFrame:
    """Rows whose groups are the tuning folds: the groups themselves, or below three groups three folds of rows dealt in hash order
    (nine rows at least)."""
    if rows.select(group).distinct().limit(3).count() >= 3:
        return rows
    if rows.limit(9).count() < 9:
        raise ValueError("fewer than three groups need nine rows or more to be dealt into folds")
    dealt = number_rows(rows.withColumn("_h", draw_key(f"{seed}f", "id")), [], ["_h", "id"], "_rn")
    return dealt.withColumn(group, F.concat(F.lit("rows"), F.col("_rn") % 3 + 1)).drop("_h", "_rn")


def freeze_model(
    rows: DataFrame, features: int, share: float = 0.2, coverage: float = 0.95, seed: int = 0, **grid
) -> dict[str, DataFrame]:
    """Reserve a calibration holdout in every group, tune and fit on the rest, take the conformal half-width from the holdout.

    Below three groups the tuning folds are dealt rows (``tuning_folds``); choices that need the groups themselves are an error then.
    """
    roles = stratified_holdout(rows, share, seed=seed)
    own, calib = roles.filter("NOT holdout").drop("holdout"), roles.filter("holdout").drop("holdout")
    train = tuning_folds(own, seed)
    if train is not own and (grid.get("rank") == "within_group" or grid.get("weights") == "group"):
        raise ValueError("ranking and weighting by group need three groups or more")
    sets = materialise(single_sets(train))
    models = materialise(fit_sets(train, sets, features, **grid))
    tuning = materialise(tune(inner_losses(train, models, features)))
    chosen = select_min(tuning)
    final = materialise(models.filter("inner_group IS NULL").join(chosen.select("outer_group", "alpha", "step", "loss"), ["outer_group", "alpha", "step"]))
    residual = score(calib, final, features, left_out=False).select(F.abs(F.col("y") - F.col("pred")).alias("abs_err"))
    q = order_statistic(residual, [], "abs_err", coverage, "q")
    partitions = roles.select("id", "grp", F.when(F.col("holdout"), "calibration").otherwise("training").alias("role"))
    return {"model": final, "tuning": tuning, "selected": chosen, "conformal": q, "partitions": partitions}


def rank_model_fit(rows: DataFrame, features: int, kind: str = "centered", weights: str = "group", rank: str = "within_group", **grid) -> dict[str, DataFrame]:
    """The same nested grid on the relative label with equal weight per group; percentile knots from out-of-fold scores.

    The relative label depends on a row's own group only, so it is the same in all folds.
    """
    relative = relative_target(rows, kind, "grp", "y", "_t").withColumn("y", F.col("_t")).drop("_t")
    run = logo_nested(relative, features, rank=rank, weights=weights, **grid)
    run["knots"] = calibration_knots(run["predictions"], "pred")
    return run


def elastic_net_fit(rows: DataFrame, alpha: float, lam: float, weight: str | None = None):
    """Elastic net by Spark ML on pre-standardised values, with no scaling of its own."""
    lr = LinearRegression(regParam=lam, elasticNetParam=alpha, standardization=False, solver="l-bfgs", maxIter=500, tol=1e-10)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"), *([weight] if weight else [])))


def pair_differences(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Feature differences x_i - x_j of sampled pairs."""
    x = rows.select("id", F.col("x").alias("_x"))
    j = pairs.join(x.withColumnRenamed("_x", "_xi"), pairs["i"] == x["id"]).drop("id")
    j = j.join(x.withColumnRenamed("_x", "_xj"), j["j"] == x["id"]).drop("id")
    return j.select(F.col("grp").cast("string").alias("grp"), "outcome", F.zip_with("_xi", "_xj", lambda a, b: a - b).alias("x"))


def pairwise_rank_fit(
    rows: DataFrame, pairs_per_row: int = 3, alphas: Sequence[float] = ALPHAS, steps: int = STEPS, lambdas: Sequence[float] | None = None, seed: int = 0,
    rescale: bool = True,
) -> dict:
    """Ranker from within-group pairs: penalised logistic regression on differences, no intercept, equal total weight per group.

    Tuned over the whole grid by leave-one-group-out pair error, macro over groups; the first in (alpha, path) order on ties. The
    penalty path comes from all pairs (or is given). ``rows`` are standardised (id, grp, y, x); ``rescale`` learns the scale of the features anew from each
    fold's training rows. All folds and grid points are fitted together (``PairFits``).

    Returns model (coefficients), alpha, lambda, tuning, pairs, scores (each sample by the fit that left its group out) and knots (the
    percentile curve of these scores).
    """
    pairs = within_group_pairs(rows, pairs_per_row, value="y", seed=seed)
    data = materialise(pair_differences(rows, pairs), "pairs")
    folds = fold_names(data)
    scales = fold_scales(rows, folds)
    if not rescale:
        scales = np.ones_like(scales)
    fits = PairFits(data, folds, scales)
    last = len(folds) - 1
    mean = data.agg(*[F.avg((F.col("outcome") - 0.5) * F.get("x", F.lit(k))).alias(f"g{k}") for k in range(scales.shape[1])]).first()
    cxy = np.array(mean, float) / scales[last]
    grid = [(float(a), i, float(lam)) for a in alphas for i, lam in enumerate(lambdas if lambdas is not None else _path(cxy, a, steps))]
    fold = np.repeat(np.arange(len(folds)), len(grid))
    alpha, lam = (np.tile([point[c] for point in grid], len(folds)) for c in (0, 2))
    beta = fits.solve(fold, lam * alpha, lam * (1 - alpha))
    errors = fits.pair_errors(beta, fold).reshape(len(folds), len(grid))
    loss = np.nanmean(errors[:last], axis=0)
    best = int(np.argmin(loss))
    raw = (beta / scales[fold]).reshape(len(folds), len(grid), -1)[:, best]
    spark = rows.sparkSession
    tuning = spark.createDataFrame([(a, i, s, float(e)) for (a, i, s), e in zip(grid, loss)], "alpha double, step int, lambda double, macro_pair_error double")
    own = spark.createDataFrame([(f, raw[k].tolist()) for k, f in enumerate(folds) if f is not None], "grp string, _b array<double>")
    scored = attach(rows, own, ["grp"], last).select("id", "grp", "y", _dot("x", F.col("_b")).alias("relative_score"))
    return {
        "model": raw[last].tolist(), "alpha": grid[best][0], "lambda": grid[best][2], "tuning": tuning, "pairs": pairs, "scores": scored,
        "knots": calibration_knots(scored, "relative_score"),
    }


def _dot(x: str, beta: Column) -> Column:
    return F.aggregate(F.zip_with(x, beta, lambda v, b: v * b), F.lit(0.0), lambda acc, t: acc + t)


def pairwise_predict(model: Sequence[float], rows: DataFrame, knots: DataFrame | None = None) -> DataFrame:
    """Raw relative score beta'x per sample, with its percentile if ``knots`` are given; no cohort statistic is needed."""
    out = rows.select("id", "grp", "y", _dot("x", F.array(*[F.lit(float(b)) for b in model])).alias("relative_score"))
    return out if knots is None else bracket_interpolate(out, knots, "relative_score", "percentile")


def null_control_labels(rows: DataFrame, mode: str = "within_group", seed: int = 0, label: str = "y") -> DataFrame:
    """Labels shuffled within groups or over all rows: the control that must show no skill."""
    from heldout.operators.resampling import permute

    return permute(rows, ["grp"] if mode == "within_group" else [], label, label, seed)


# --- frozen scoring over the long matrix ------------------------------------------------------------------


def predict_frozen(z: DataFrame, coefficients: DataFrame, intercept: float, ood_cut: float, max_missing: float = 0.1) -> DataFrame:
    """Score samples from standardised long values (id, feature, z, missing) and coefficients (feature, beta).

    One aggregation per sample: dot product, missing share, RMS distance; flags QC, OOD and whether to report.
    """
    j = attach(z, coefficients, ["feature"])
    out = j.groupBy("id").agg(
        (F.lit(intercept) + F.sum(F.coalesce("beta", F.lit(0.0)) * F.col("z"))).alias("pred"),
        F.avg(F.col("missing").cast("double")).alias("missing_fraction"),
        F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("ood_score"),
    )
    qc, ood = F.col("missing_fraction") > max_missing, F.col("ood_score") > ood_cut
    return out.select("*", ood.alias("ood"), qc.alias("qc_fail"), (~ood & ~qc).alias("reportable"))


def ood_rms_cut(z: DataFrame, share: float = 0.99) -> DataFrame:
    """The ``share`` quantile of the training rows' RMS distance."""
    dist = z.groupBy("id").agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("ood_score"))
    return quantiles(dist, [], "ood_score", {"cut": share})


def ood_outside_range(train: DataFrame, scored: DataFrame, low: float = 0.005, high: float = 0.995, limit: float = 0.25) -> DataFrame:
    """Share of a sample's features outside the training range of that feature, flagged above ``limit``."""
    limits = quantiles(train, ["feature"], "value", {"_lo": low, "_hi": high})
    j = attach(scored, limits, ["feature"], profile(train, ["feature"]).groups, "inner").filter("value IS NOT NULL")
    outside = ~F.col("value").between(F.col("_lo"), F.col("_hi"))
    return j.groupBy("id").agg(F.avg(outside.cast("double")).alias("outside_share")).withColumn("ood", F.col("outside_share") > limit)


def conformal_interval(calibration: DataFrame, coverage: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """Half-width of split-conformal intervals: an order statistic of |actual - pred|."""
    rows = calibration.withColumn("_e", F.abs(F.col("actual") - F.col("pred")))
    return order_statistic(rows, keys, "_e", coverage, "q")
