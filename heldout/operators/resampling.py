"""Permutation and bootstrap operators with hash-ordered draws.

Hashes of seed, replicate and row replace a random stream: the same rows are drawn after a task is rerun.

**Bootstrap.** A stratum of n rows has slices of at most ``SLICE`` rows. How many of a replicate's n draws fall into each slice is a multinomial
split, made by halving: a seeded tree of binomials over the slices, whose path to its slice every task follows on its own (``slice_draws``).
Inside the slice each draw is a hash; slices of one stratum share their hashes (``_Shared``). A task turns its rows into a multiplicity matrix
(replicates by rows, a block at a time) and hands on weighted sums or finished statistics per replicate (``resampled``), so rows times replicates
never pass a shuffle.

**Permutation.** A task has the rows of a group as arrays, orders them anew for every replicate, and hands on sums per replicate.

Statistics that need ranks of a whole stratum, and permutations of a whole group, do this while the stratum fits a task (``hotRows``); beyond that
a permutation's draws are made as rows and numbered in slices (``permuted_replicates``), with the same results. Correlations and the AUC of larger strata
need no rows: a task has a range of a value and makes the multiplicities anew (``_ranged_pairs``, ``_ranged_auc``). ``drawn`` gives the draws as rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.functions.scalars import DRAW_RANGE, RUN, draw_key, draw_number, mixed, mixed_array, mixed_runs, safe_corr
from heldout.plans.skew import (
    Profile, attach, group_attach, hot_rows, midranks, null_safe_join, number_rows, profile, spread, value_cells,
)
from heldout.plans.storage import materialise

#: Rows of a stratum whose draws are made together.
SLICE = 1 << 16
#: Replicates that share one stream of the slice tree, and that a task may be given at least.
BLOCK = 256
#: Cells of a multiplicity matrix in memory: one replicate at a time where a stratum has more rows.
CELLS = 1 << 18
#: The same where multiplicities take a byte.
BYTES = 1 << 22
#: Rows whose AUC one task bootstraps: more are ranged, which also uses all cores where there are few blocks of replicates.
AUC_ROWS = 1 << 18
#: Rows of a range of scores at least, unless a task may sort fewer.
RANGE_ROWS = 1 << 20
#: Slices of a stratum whose sums one task makes, with the hashes they share, and replicates that it multiplies at once.
TOGETHER, AT_ONCE = 8, 32
#: Rows whose multiplicities are multiplied at once.
ROWS_AT_ONCE = 1 << 14
#: Replicates whose multiplicities of a row share a 64-bit word, rows of such words worked on at once, and rows of a stratum whose products with a rank take 32 bits.
LANES, WORDS_AT_ONCE, WORD_ROWS = 8, 1 << 15, 1 << 23


def replicates(df: DataFrame, b: int) -> DataFrame:
    """Each row once per replicate 1..b."""
    return df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b))))


def permute(df: DataFrame, keys: Sequence[str], value: str, out: str, seed: int = 0, unit: str = "id") -> DataFrame:
    """Shuffle ``value`` inside ``keys``: the i-th row in one hash order takes the value of the i-th in another."""
    keys = list(keys)
    like = profile(df, keys)
    rows = number_rows(df.withColumn("_h", draw_key(f"{seed}a", unit)), keys, ["_h", unit], "_rn", like).drop("_h")
    donors = number_rows(
        df.select(*keys, F.col(unit).alias("_u"), F.col(value).alias("_v"), draw_key(f"{seed}b", unit).alias("_h")), keys, ["_h", "_u"], "_rn", like
    ).select(*keys, "_rn", "_v")
    joined = null_safe_join(rows, donors, [*keys, "_rn"])
    return joined.drop("_rn", *([out] if out in df.columns else [])).withColumnRenamed("_v", out)


def permuted_replicates(df: DataFrame, b: int, group: str = "grp", value: str = "actual", carry: Sequence[str] = ("pred",), seed: int = 0, unit: str = "id") -> DataFrame:
    """(b, carry..., value_perm): value shuffled inside the group, anew for each replicate.

    The receiving order is one hash order per group, the giving order a new one per replicate.
    """
    like = profile(df, [group])
    df = spread(df.select(group, unit, value, *carry), like)
    base = number_rows(df.withColumn("_h", draw_key(f"{seed}a", unit)), [group], ["_h", unit], "_rn", like)
    takers = replicates(base.select(group, "_rn", *carry), b)
    donors = replicates(base.select(group, F.col("_rn").alias("_u"), F.col(value).alias("value_perm"), stratum_key(seed, [group]).alias("_k")), b)
    donors = donors.withColumn("_k", mixed(F.col("_k") + F.col("b"))).withColumn("_h", mixed(F.col("_k") + F.col("_u")))
    donors = number_rows(donors, ["b", group], ["_h", "_u"], "_rn", like.times(b))
    return null_safe_join(takers, donors.select("b", group, "_rn", "value_perm"), ["b", group, "_rn"])


def permuted_sums(
    df: DataFrame, b: int, group: str, value: str, other: str, sums: Sequence[tuple[str, Callable]], seed: int = 0, unit: str = "id",
) -> DataFrame:
    """(b, sums...): totals over all rows of functions of (value shuffled inside its group, other), for each replicate.

    ``sums``: name, a function of two NumPy arrays or of two columns alike.
    """
    like = profile(df, [group])
    names = [n for n, _ in sums]
    if like.largest > hot_rows(df.sparkSession):
        rows = permuted_replicates(df, b, group, value, [other], seed, unit)
        return rows.groupBy("b").agg(*[F.sum(f(F.col("value_perm"), F.col(other))).alias(n) for n, f in sums])
    rows = df.select(group, unit, F.col(value).cast("double").alias("_v"), F.col(other).cast("double").alias("_o"))
    rows = number_rows(rows.withColumn("_h", draw_key(f"{seed}a", unit)), [group], ["_h", unit], "_rn", like)
    rows = rows.select(stratum_key(seed, [group]).alias("_k"), F.col(group).alias("_g"), "_rn", "_v", "_o")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rn = table.column("_rn").to_numpy()
        order = np.argsort(rn)
        v, o = (table.column(c).to_numpy()[order] for c in ("_v", "_o"))
        turns, stratum = np.arange(len(rn)), table.column("_k")[0].as_py()
        out = np.empty((len(key[1]), len(sums)))
        for i, start in enumerate(mixed_array(np.array(key[1]) + stratum)):
            # The row numbered r takes the value of the row that is r-th by hash. Hash and number in one integer sort as numbers do.
            giving = mixed_runs([start + 1], len(rn))[0].astype(np.int64)
            giving <<= 32
            giving |= turns
            giving.sort()
            giving &= 0xFFFFFFFF
            given = v.take(giving)
            out[i] = [float(np.sum(f(given, o))) for _, f in sums]
        return pa.table({"b": pa.array(key[1], pa.int32()), **{n: out[:, c] for c, n in enumerate(names)}})

    kind = T.StructType.fromDDL("b int, " + ", ".join(f"{n} double" for n in names))
    parts = _in_lanes(rows, ["_g"], b, like.groups, run, kind)
    return parts.groupBy("b").agg(*[F.sum(n).alias(n) for n in names])


def first_rows(df: DataFrame, b: int, group: str, k: int, cols: Sequence[str], seed: int = 0, unit: str = "id") -> DataFrame:
    """The first ``k`` rows of each group in the hash order of every replicate: (b, group, _turn from 1, cols...), cols as doubles."""
    like = profile(df, [group])
    rows = df.select(group, unit, *[F.col(c).cast("double").alias(c) for c in cols])
    rows = number_rows(rows.withColumn("_h", draw_key(f"{seed}a", unit)), [group], ["_h", unit], "_rn", like).drop("_h", unit)
    rows = rows.withColumn("_k", stratum_key(seed, [group]))
    if like.largest > hot_rows(df.sparkSession):
        each = replicates(rows, b).withColumn("_start", mixed(F.col("_k") + F.col("b"))).withColumn("_h", mixed(F.col("_start") + F.col("_rn")))
        # A limited window: only k rows per group and replicate leave a task.
        turn = F.row_number().over(Window.partitionBy("b", group).orderBy("_h", "_rn"))
        return each.withColumn("_turn", turn).filter(F.col("_turn") <= k).select("b", group, "_turn", *cols)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rn, stratum = table.column("_rn").to_numpy(), table.column("_k")[0].as_py()
        order = np.argsort(rn)
        n = min(k, len(rn))
        first = np.empty((len(key[1]), n), np.int64)
        for i, start in enumerate(mixed_array(np.array(key[1]) + stratum)):
            h = mixed_runs([start + 1], len(rn))[0]
            # The hashes are even: twice the share that is looked for, and more where that was not enough.
            share = (2 * n + 16) / len(rn)
            near = np.flatnonzero(h <= min(share, 1.0) * DRAW_RANGE)
            while len(near) < n:
                share *= 4
                near = np.flatnonzero(h <= min(share, 1.0) * DRAW_RANGE)
            first[i] = order[near[np.argsort(h[near], kind="stable")[:n]]]
        taken = table.take(pa.array(first.ravel()))
        turns = {"b": np.repeat(np.array(key[1], np.int32), n), "_turn": np.tile(np.arange(1, n + 1, dtype=np.int32), len(key[1]))}
        return pa.table({"b": turns["b"], group: taken.column(group), "_turn": turns["_turn"], **{c: taken.column(c) for c in cols}})

    double = T.DoubleType()
    fields = [T.StructField("b", T.IntegerType()), rows.schema[group], T.StructField("_turn", T.IntegerType()), *[T.StructField(c, double) for c in cols]]
    return _in_lanes(rows, [group], b, like.groups, run, T.StructType(fields))


def stratum_key(seed: int, strata: Sequence[str]) -> Column:
    """The number from which the draws of a stratum follow."""
    return draw_number(f"{seed}s", *(strata or [F.lit("all")])) % DRAW_RANGE


def lanes_of(b: int, units: int, cores: int) -> list[range]:
    """The replicates 1..b in runs of whole blocks: so many that units times runs keep all cores busy, one at least."""
    blocks = math.ceil(b / BLOCK)
    lanes = min(blocks, max(1, math.ceil(4 * cores / max(units, 1))))
    step = math.ceil(blocks / lanes) * BLOCK
    return [range(k + 1, min(k + step, b) + 1) for k in range(0, b, step)]


def _in_lanes(rows: DataFrame, keys: Sequence[str], b: int, units: int, run: Callable, kind: T.StructType) -> DataFrame:
    """Give the rows of each key to a task with (key, its replicates): a unit is copied once per lane, not once per replicate."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    lanes = lanes_of(b, units, cores)
    dealt = rows.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(len(lanes) - 1)))) if len(lanes) > 1 else rows.withColumn("_lane", F.lit(0))
    # More partitions than units, because units that meet in one wait for each other.
    tasks = min(4 * units * len(lanes), max(16 * cores, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartition(max(tasks, 1), *keys, "_lane")

    def each(key: tuple, table: pa.Table) -> pa.Table:
        return run((key[:-1], lanes[key[-1].as_py()]), table)

    return dealt.groupBy(*keys, "_lane").applyInArrow(each, kind)



def permutation_test_mae(df: DataFrame, b: int = 1000, seed: int = 0, group: str = "grp") -> DataFrame:
    """Observed MAE against the MAE of labels shuffled inside groups: median, 5% point and p = (1 + #{<=}) / (b + 1)."""
    known = df.dropna(subset=["actual", "pred"])
    sums = permuted_sums(known, b, group, "actual", "pred", [("off", lambda v, o: abs(v - o) if isinstance(v, np.ndarray) else F.abs(v - o))], seed)
    size = known.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    null = sums.withColumn("_one", F.lit(1)).join(F.broadcast(size), "_one").select("b", (F.col("off") / F.col("_n")).alias("null_mae"))
    obs = known.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("observed_mae")).withColumn("_one", F.lit(1))
    j = null.withColumn("_one", F.lit(1)).join(F.broadcast(obs), "_one")
    return j.agg(
        F.max("n").alias("n"),
        F.max("observed_mae").alias("observed_mae"),
        F.percentile("null_mae", F.lit(0.5)).alias("null_median"),
        F.percentile("null_mae", F.lit(0.05)).alias("null_q05"),
        ((1 + F.count_if(F.col("null_mae") <= F.col("observed_mae"))) / (F.count(F.lit(1)) + 1)).alias("p_value"),
        F.count(F.lit(1)).alias("n_perm"),
    )


def permutation_test_spearman(df: DataFrame, b: int = 500, seed: int = 0, group: str = "grp") -> DataFrame:
    """Two-sided test of Spearman against labels shuffled inside groups; a constant score gives rho 0 and p 1.

    Shuffling does not change the values, so both sides are ranked once and the ranks are shuffled.
    """
    known = df.dropna(subset=["actual", "pred"])
    ranked = midranks(known, [], {"_ra": "actual", "_rp": "pred"})
    middle = ranked.agg(((F.count(F.lit(1)) + 1) / F.lit(2.0)).alias("_mid")).withColumn("_one", F.lit(1))
    centred = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(middle), "_one")
    centred = centred.select(group, "id", (F.col("_ra") - F.col("_mid")).alias("_ca"), (F.col("_rp") - F.col("_mid")).alias("_cp"))
    products = [("xy", lambda v, o: v * o), ("xx", lambda v, o: v * v), ("yy", lambda v, o: o * o)]
    sums = permuted_sums(centred, b, group, "_ca", "_cp", products, seed)
    null = sums.select("b", F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("null_rho"))
    obs = ranked.agg(F.count(F.lit(1)).alias("n"), safe_corr("_ra", "_rp").alias("_rho"), (F.min("pred") == F.max("pred")).alias("_flat")).withColumn("_one", F.lit(1))
    j = null.withColumn("_one", F.lit(1)).join(F.broadcast(obs), "_one")
    out = j.agg(
        F.max("n").alias("n"),
        F.max("_rho").alias("_rho"),
        F.bool_or("_flat").alias("_flat"),
        F.percentile("null_rho", F.lit(0.5)).alias("_mid"),
        F.percentile("null_rho", F.lit(0.025)).alias("_lo"),
        F.percentile("null_rho", F.lit(0.975)).alias("_hi"),
        F.count_if(F.abs("null_rho") >= F.abs("_rho")).alias("_beyond"),
        F.count("null_rho").alias("_ok"),
    )

    def flat(c, v):
        return F.when(F.col("_flat"), F.lit(v)).otherwise(c)

    return out.select(
        "n",
        flat(F.col("_rho"), 0.0).alias("observed_rho"),
        flat(F.col("_mid"), 0.0).alias("null_median"),
        flat(F.col("_lo"), 0.0).alias("null_q025"),
        flat(F.col("_hi"), 0.0).alias("null_q975"),
        flat((1 + F.col("_beyond")) / (F.col("_ok") + 1), 1.0).alias("p_value"),
        flat(F.col("_ok"), 0).cast("long").alias("n_perm"),
    )


def shuffled_score_control(df: DataFrame, seed: int = 0, group: str = "grp") -> DataFrame:
    """Spearman of the score with one within-group shuffle of the label."""
    ranked = midranks(permute(df, [group], "actual", "shuffled", seed), [], {"_a": "shuffled", "_b": "pred"}, profile(df, []))
    return ranked.agg(F.count(F.lit(1)).alias("n"), safe_corr("_a", "_b").alias("control_rho"))


def slice_draws(key: int, sizes: Sequence[int], replicate: range, block: int | None = None) -> np.ndarray:
    """How many draws fall into each slice of a stratum, for replicates of whole blocks: (replicates, slices).

    The draws of a replicate are halved down a tree of the slices by binomials. A node's stream depends on the stratum, the node and the
    block of replicates alone, so every task that needs a slice finds the same numbers.
    """
    block = block or BLOCK
    ends = np.cumsum([0, *sizes])
    out = np.empty((len(replicate), len(sizes)), np.int64)
    first = (replicate[0] - 1) // block
    whole = math.ceil(len(replicate) / block) * block

    def halve(draws: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = draws[: len(replicate)]
            return
        middle = (low + high) // 2
        share = (ends[middle] - ends[low]) / (ends[high] - ends[low])
        left = np.concatenate([
            np.random.Generator(np.random.PCG64([key, low, high, first + k])).binomial(draws[k * block : (k + 1) * block], share) for k in range(whole // block)
        ])
        halve(left, low, middle)
        halve(draws - left, middle, high)

    halve(np.full(whole, ends[-1], np.int64), 0, len(sizes))
    return out


def slice_sizes(n: int, limit: int | None = None) -> list[int]:
    """Rows of the slices of a stratum of n rows."""
    limit = limit or SLICE
    return [min(limit, n - k) for k in range(0, n, limit)]


def multiplicities(key: int, part: int, size: int, draws: np.ndarray, replicate: Sequence[int]) -> np.ndarray:
    """How often each row of a slice is drawn: (replicates, rows)."""
    starts = mixed_array(np.asarray(replicate, np.int64) + (key + part))
    draws, out = np.asarray(draws), np.empty((len(starts), size), np.int32)
    step = max(1, RUN // max(int(draws.max(initial=0)), 1))
    for k in range(0, len(starts), step):
        m = draws[k : k + step]
        picks = mixed_runs(starts[k : k + step], int(m.max())).astype(np.int64)
        picks *= size
        picks >>= 31
        if len(m) > 1:
            picks += np.arange(len(m))[:, None] * size
        flat = picks.ravel() if (m == picks.shape[1]).all() else picks[np.arange(picks.shape[1]) < m[:, None]]
        out[k : k + step] = np.bincount(flat, minlength=len(m) * size).reshape(len(m), size)
    return out


def _blocks(rows: int, replicate: range, draws: np.ndarray) -> Iterator[tuple[slice, Sequence[int], np.ndarray]]:
    """Replicates whose multiplicities fit in memory together."""
    step = max(1, CELLS // max(rows, 1))
    for k in range(0, len(replicate), step):
        yield slice(k, k + step), replicate[k : k + step], draws[k : k + step]


class _Shared:
    """Multiplicities of the slices of a stratum that have as many rows as its first.

    The draws of slice p in replicate b and of slice p - 1 in replicate b + 1 follow from the same start, p + b and the stratum's key. So slices
    of one size have the same draws at the same p + b (a turn), but for how many they take: about as many as rows. These are made once per turn.
    """

    def __init__(self, key: int, size: int):
        self.key, self.size, self.made = key, size, {}
        self.low, self.high = max(size - 8 * math.isqrt(size) - 8, 0), size + 8 * math.isqrt(size) + 8

    def _picks(self, turn: int, n: int) -> np.ndarray:
        picks = mixed_runs(mixed_array(np.array([self.key + turn], np.int64)), n)[0].astype(np.int64)
        picks *= self.size
        picks >>= 31
        return picks

    def forget(self, before: int) -> None:
        for turn in [t for t in self.made if t < before]:
            del self.made[turn]

    def base(self, turn: int) -> np.ndarray:
        """How often each row is drawn by as many draws as there are rows."""
        if turn not in self.made:
            picks = self._picks(turn, self.high)
            counts = np.bincount(picks[: self.low], minlength=self.size)
            most = int((counts + np.bincount(picks[self.low :], minlength=self.size)).max())
            counts += np.bincount(picks[self.low : self.size], minlength=self.size)
            self.made[turn] = counts.astype(np.uint8 if most <= 255 else np.int32), picks[self.low :].copy()
        return self.made[turn][0]

    def rest(self, turn: int, draws: int) -> tuple[np.ndarray, int]:
        """The rows of the draws that ``base`` lacks or has too many, and 1 or -1."""
        first, last = min(draws, self.size), max(draws, self.size)
        sign = 1 if draws > self.size else -1
        if first < self.low or last > self.high:
            return self._picks(turn, last)[first:], sign
        self.base(turn)
        return self.made[turn][1][first - self.low : last - self.low], sign

    def counts(self, turn: int, draws: int) -> np.ndarray:
        base, (rest, sign) = self.base(turn), self.rest(turn, draws)
        out = base.copy() if self.low <= draws <= self.high else base.astype(np.int32)
        (np.add if sign > 0 else np.subtract).at(out, rest, out.dtype.type(1))
        return out


class _Strata:
    """Multiplicities of all rows of a stratum, slice by slice, for replicates in ascending order."""

    def __init__(self, key: int, sizes: Sequence[int], draws: np.ndarray):
        self.key, self.sizes, self.draws = key, sizes, draws
        self.alike = sum(size == sizes[0] for size in sizes)
        self.shared = _Shared(key, sizes[0])

    def slices(self, at: int, replicate: int) -> Iterator[np.ndarray]:
        """The slices' multiplicities in a replicate, whose numbers of draws are in row ``at``."""
        self.shared.forget(replicate)
        for part, size in enumerate(self.sizes):
            if self.alike > 1 and part < self.alike:
                yield self.shared.counts(replicate + part, int(self.draws[at, part]))
            else:
                yield _narrow(multiplicities(self.key, part, size, self.draws[at : at + 1, part], [replicate])[0])


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8) if counts.max(initial=0) <= 255 else counts


def _numbered(df: DataFrame, strata: Sequence[str], cols: Sequence[str], seed: int, unit: str, like: Profile) -> DataFrame:
    """Rows with their number in the stratum's hash order from 0 (_rn), the stratum's size (_n) and key (_k)."""
    rows = df.select(*strata, unit, *[c for c in cols if c not in strata]).withColumn("_h", draw_key(seed, unit))
    rows = number_rows(rows, strata, ["_h", unit], "_rn", like).withColumn("_rn", F.col("_rn") - 1).drop("_h", unit)
    return group_attach(rows, strata, [F.count(F.lit(1)).alias("_n")], like).withColumn("_k", stratum_key(seed, strata))


def resampled_sums(df: DataFrame, b: int, strata: Sequence[str], terms: dict[str, Column], seed: int = 0, unit: str = "id") -> DataFrame:
    """Row bootstrap: per replicate and stratum as many draws with replacement as the stratum has rows.

    Returns (b, strata..., names of ``terms``...): the sum of each term over the drawn rows. A unit of work is a slice, however large its
    stratum is.
    """
    strata, like = list(strata), profile(df, list(strata))
    names = list(terms)
    rows = _numbered(df.select("*", *[c.cast("double").alias(n) for n, c in terms.items()]), strata, names, seed, unit, like)
    limit, block, together, at_once = SLICE, BLOCK, TOGETHER, AT_ONCE
    rows = rows.withColumn("_run", F.floor(F.col("_rn") / (limit * together)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, replicate = key[0][-1].as_py() * together, key[1]
        rn = table.column("_rn").to_numpy() - first * limit
        n, stratum = table.column("_n")[0].as_py(), table.column("_k")[0].as_py()
        sizes = slice_sizes(n, limit)
        own = sizes[first : first + together]
        values = np.empty((sum(own), len(names)))
        for k, c in enumerate(names):
            values[rn, k] = table.column(c).to_numpy()
        draws = slice_draws(stratum, sizes, replicate, block)[:, first : first + together]
        out = np.zeros((len(replicate), len(names)))
        alike = sum(size == limit for size in own)
        alike = alike if alike > 1 else 0
        if alike:
            shared = _Shared(stratum, limit)
            parts = values[: alike * limit].reshape(alike, limit, -1)
            beside = np.concatenate(list(parts), axis=1)
            for k in range(0, len(replicate), at_once):
                some = replicate[k : k + at_once]
                turns = range(some[0] + first, some[-1] + first + alike)
                shared.forget(turns[0])
                # All turns against all slices; slice p of a replicate is p turns further on.
                sums = (np.array([shared.base(t) for t in turns], float) @ beside).reshape(len(turns), alike, -1)
                for p in range(alike):
                    out[k : k + len(some)] += sums[p : p + len(some), p]
                    for i, r in enumerate(some):
                        rest, sign = shared.rest(r + first + p, int(draws[k + i, p]))
                        out[k + i] += sign * parts[p].take(rest, axis=0).sum(axis=0)
        for p in range(alike, len(own)):
            mine = values[p * limit : p * limit + own[p]]
            for at, some, m in _blocks(own[p], replicate, draws[:, p]):
                out[at] += multiplicities(stratum, first + p, own[p], m, some).astype(float) @ mine
        same = table.select(strata).take(pa.array(np.zeros(len(replicate), np.int64)))
        return pa.table({"b": pa.array(replicate, pa.int32()), **{c: same.column(c) for c in strata}, **{c: out[:, k] for k, c in enumerate(names)}})

    fields = [T.StructField("b", T.IntegerType()), *[rows.schema[c] for c in strata], *[T.StructField(c, T.DoubleType()) for c in names]]
    units = like.groups + like.rows // (limit * together)
    parts = _in_lanes(rows, [*strata, "_run"], b, units, run, T.StructType(fields))
    # Sums of the slices of a stratum add up.
    return parts.groupBy("b", *strata).agg(*[F.sum(c).alias(c) for c in names])


def resampled(
    df: DataFrame, b: int, strata: Sequence[str], keys: Sequence[str], cols: Sequence[str], statistic: Callable, kind: str, seed: int = 0, unit: str = "id",
    like: Profile | None = None,
) -> DataFrame:
    """Statistics of whole samples: (b, keys..., columns of ``kind``), for strata that fit a task together under their ``keys``.

    ``statistic`` gets the columns (rows in the order of stratum and number) and the strata's numbers, prepares what does not depend on the
    draws, and returns a function from multiplicities (replicates, rows) to the statistics' columns.
    """
    strata, keys, like = list(strata), list(keys), like or profile(df, list(strata))
    rows = _numbered(df, strata, cols, seed, unit, like)
    names = T.StructType.fromDDL(kind).names
    limit, block = SLICE, BLOCK

    def run(key: tuple, table: pa.Table) -> pa.Table:
        replicate = key[1]
        stratum, rn, n = (table.column(c).to_numpy() for c in ("_k", "_rn", "_n"))
        order = np.lexsort((rn, stratum))
        stratum, n = stratum[order], n[order]
        firsts = np.flatnonzero(np.r_[True, stratum[1:] != stratum[:-1]])
        plans = [(int(stratum[k]), slice_sizes(int(n[k]), limit)) for k in firsts]
        evaluate = statistic({c: table.column(c).to_numpy(zero_copy_only=False)[order] for c in cols})
        found = []
        if all(len(sizes) < 3 for _, sizes in plans):
            draws = np.column_stack([slice_draws(k, sizes, replicate, block) for k, sizes in plans])
            parts = [(k, p, size) for k, sizes in plans for p, size in enumerate(sizes)]
            for _, some, m in _blocks(len(rn), replicate, draws):
                found.append(np.column_stack(evaluate(np.concatenate([multiplicities(k, p, size, m[:, c], some) for c, (k, p, size) in enumerate(parts)], axis=1))))
        else:
            strata_draws = [_Strata(k, sizes, slice_draws(k, sizes, replicate, block)) for k, sizes in plans]
            step = max(1, BYTES // len(rn) // LANES) * LANES
            for at in range(0, len(replicate), step):
                some = range(at, min(at + step, len(replicate)))
                found.append(np.column_stack(evaluate(np.stack([np.concatenate([w for s in strata_draws for w in s.slices(i, replicate[i])]) for i in some]))))
        values = np.concatenate(found)
        same = table.select(keys).take(pa.array(np.zeros(len(replicate), np.int64)))
        columns = {c: pa.array(values[:, k], mask=np.isnan(values[:, k])) for k, c in enumerate(names)}
        return pa.table({"b": pa.array(replicate, pa.int32()), **{c: same.column(c) for c in keys}, **columns})

    fields = [T.StructField("b", T.IntegerType()), *[rows.schema[c] for c in keys], *T.StructType.fromDDL(kind).fields]
    return _in_lanes(rows, keys, b, like.groups if keys else 1, run, T.StructType(fields))


def drawn(df: DataFrame, b: int, strata: Sequence[str], cols: Sequence[str], seed: int = 0, unit: str = "id") -> DataFrame:
    """The same draws as rows, for statistics of strata too large for a task: (b, strata..., cols..., w), a row per drawn row with its multiplicity."""
    strata, like = list(strata), profile(df, list(strata))
    rows = spread(_numbered(df, strata, cols, seed, unit, like), like)
    limit, block = SLICE, BLOCK
    heads = rows.filter("_rn = 0").select(*strata, "_n", "_k")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n, key = one.column("_n")[0].as_py(), one.column("_k")[0].as_py()
                sizes = slice_sizes(n, limit)
                for k in range(0, b, block):
                    replicate = range(k + 1, min(k + block, b) + 1)
                    m = slice_draws(key, sizes, replicate, block)
                    for part, size in enumerate(sizes):
                        same = one.select(strata).take(pa.array(np.zeros(len(replicate), np.int64)))
                        start = mixed_array(np.array(replicate) + (key + part))
                        more = [pa.array(x, pa.int64()) for x in (replicate, [part] * len(start), [size] * len(start), m[:, part], start)]
                        yield pa.RecordBatch.from_arrays([*same.columns, *more], names=[*strata, "b", "_part", "_size", "_m", "_start"])

    kind = T.StructType([*[rows.schema[c] for c in strata], *T.StructType.fromDDL("b long, _part long, _size long, _m long, _start long").fields])
    turns = heads.mapInArrow(split, kind).filter("_m > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    pick = F.col("_part") * limit + F.shiftright(mixed(F.col("_start") + F.col("_turn")) * F.col("_size"), 31)
    weights = turns.select(F.col("b").cast("int").alias("b"), *strata, pick.alias("_rn")).groupBy("b", *strata, "_rn").agg(F.count(F.lit(1)).alias("w"))
    return null_safe_join(weights, rows.drop("_n", "_k"), [*strata, "_rn"]).drop("_rn")


def weighted_corr(x: str, y: str, w: str = "w") -> Column:
    """Pearson correlation with frequency weights as an aggregate."""
    x, y, w = F.col(x), F.col(y), F.col(w)
    n = F.sum(w)
    cov = F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / n
    vx, vy = F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / n, F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / n
    return F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))


def weighted_midrank(df: DataFrame, keys: Sequence[str], value: str, out: str, like: Profile, w: str = "w") -> DataFrame:
    """Midranks in the sample where each row stands for ``w`` copies; ``like`` bounds the rows per key."""
    if like.largest <= hot_rows(df.sparkSession):
        by = Window.partitionBy(*keys).orderBy(value)
        upto, ties = F.sum(w).over(by.rangeBetween(Window.unboundedPreceding, 0)), F.sum(w).over(by.rangeBetween(0, 0))
        return df.withColumn(out, upto - (ties - 1) / F.lit(2.0))
    cells = value_cells(df, keys, value, {"copies": F.col(w)}, like=like)
    ranks = cells.select(*keys, value, (F.col("copies_before") + (F.col("copies") + 1) / F.lit(2.0)).alias(out))
    return null_safe_join(df, ranks, [*keys, value])


def percentile_ci(draws: DataFrame, keys: Sequence[str], cols: Sequence[str], coverage: float = 0.95) -> DataFrame:
    """Percentile limits of replicate statistics (b rows per key) and how many replicates were usable."""
    a = (1 - coverage) / 2
    aggs = []
    for c in cols:
        aggs += [F.percentile(c, F.lit(a)).alias(f"{c}_lo"), F.percentile(c, F.lit(1 - a)).alias(f"{c}_hi")]
    aggs.append(F.count(cols[0]).alias("n_ok"))
    return draws.groupBy(*keys).agg(*aggs) if keys else draws.agg(*aggs)


class _Cells:
    """Rows in the order of a value, and where its distinct values (cells) begin."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        ordered = values[self.order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        self.distinct = bool(new.all())
        self.firsts = np.flatnonzero(new)
        self.lasts = np.r_[self.firsts[1:], len(values)] - 1
        self.of_ordered = np.cumsum(new) - 1

    def totals(self, ordered: np.ndarray) -> np.ndarray:
        """Sums per cell of what is in the value's order: (replicates, cells)."""
        return ordered if self.distinct else np.add.reduceat(ordered, self.firsts, axis=1)


def _doubled_ranks(copies: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Twice the midrank of each cell of a weighted sample of ``n`` rows, less its mean: whole numbers, so a constant sample gives 0."""
    upto = np.cumsum(copies, axis=1, dtype=copies.dtype)  # a sum in another type than the copies' is slow
    upto += upto
    upto -= copies
    upto -= n[:, None].astype(copies.dtype)
    return upto


def _rank_squares(copies: np.ndarray, ranks: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of squares of the doubled ranks. Without ties it is a third of n^3 - n, and a tie of t rows takes off as much of t."""
    copies = copies.astype(float)
    tied, cubes = np.einsum("ij,ij->i", copies * copies, copies), n.astype(float) ** 3
    out = (cubes - tied) / 3
    # Much cancels where most rows are one tie.
    for k in np.flatnonzero(2 * tied >= cubes):
        out[k] = np.dot(copies[k], ranks[k].astype(float) ** 2)
    return out


def _weighted_pearson(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation per replicate of values with multiplicities; NaN where one is constant."""
    n = w.sum(axis=1, keepdims=True)
    dx, dy = x - (w * x).sum(axis=1, keepdims=True) / n, y - (w * y).sum(axis=1, keepdims=True) / n
    xy, xx, yy = (np.einsum("ij,ij,ij->i", w, a, c) for a, c in ((dx, dy), (dx, dx), (dy, dy)))
    some = (xx > 1e-12 * np.abs(x).max(initial=0.0)) & (yy > 1e-12 * np.abs(y).max(initial=0.0))
    return np.divide(xy, np.sqrt(xx * yy), out=np.full(len(w), np.nan), where=some)


class _Words:
    """Rank correlations of replicates whose multiplicities (bytes) share 64-bit words, so a row is looked up once for all of them.

    A word has byte k of replicate k. Cumulated, it is taken apart into words of two 32-bit counts, those of replicates k and k + 4.
    """

    def __init__(self, by_y: _Cells, by_p: _Cells, y_cell: np.ndarray):
        self.by_y, self.by_p, self.y_cell, self.n = by_y, by_p, y_cell, len(y_cell)
        self.whole = [np.empty(self.n, np.uint64) for _ in range(4)]
        at_once = min(WORDS_AT_ONCE, self.n)
        self.some = [np.empty(at_once, np.uint64) for _ in range(3)]
        self.lane = [np.empty(at_once) for _ in range(2)]

    @staticmethod
    def _two(words: np.ndarray, k: int, out: np.ndarray) -> np.ndarray:
        np.right_shift(words, np.uint64(8 * k), out=out)
        return np.bitwise_and(out, np.uint64(0x000000FF000000FF), out=out)

    def _ranks(self, words: np.ndarray, k: int, cells: _Cells, out: np.ndarray) -> np.ndarray:
        """Into ``out``, per cell: the copies up to it and those below it, the doubled midrank less 1. Returns both sums of squares of ``_rank_squares``."""
        n, upto = self.n, np.uint64(0)
        for a in range(0, n, WORDS_AT_ONCE):
            some = words[a : a + WORDS_AT_ONCE]
            two = self._two(some, k, self.some[0][: len(some)])
            two[0] += upto
            np.add.accumulate(two, out=out[a : a + len(some)])
            upto = out[a + len(some) - 1]
        below, tied, count = np.uint64(0), [0, 0], len(cells.lasts)
        for a in range(0, count, WORDS_AT_ONCE):
            m = min(WORDS_AT_ONCE, count - a)
            high, copies = out[a : a + m], self.some[0][:m]
            if not cells.distinct:
                high = np.take(out, cells.lasts[a : a + m], out=self.some[1][:m], mode="clip")
            copies[0] = high[0] - below
            np.subtract(high[1:], high[:-1], out=copies[1:])
            below = high[-1]
            np.add(high, high, out=out[a : a + m])
            out[a : a + m] -= copies
            each = copies.view(np.uint32)
            if each.max() <= 40:  # the cubes of so many fit 32 bits in sum
                cubes = each * each
                cubes *= each
                total = int(cubes.view(np.uint64).sum())
                tied = [tied[0] + (total & 0xFFFFFFFF), tied[1] + (total >> 32)]
            else:
                for i in (0, 1):
                    lane = each[i::2].astype(float)
                    tied[i] += float(np.dot(lane * lane, lane))
        squares = np.array([(float(n) ** 3 - t) / 3 for t in tied])
        for i in (0, 1):
            # Much cancels where most rows are one tie.
            if 2 * tied[i] >= float(n) ** 3:
                ranks = out[:count].view(np.int32)[i::2].astype(float) - n
                own = words.view(np.uint8)[k + i * (LANES // 2) :: LANES].astype(float)
                squares[i] = np.dot(cells.totals(own[None])[0], ranks * ranks)
        return squares

    def spearman(self, w: np.ndarray) -> np.ndarray:
        """For up to ``LANES`` replicates, each of as many draws as rows: (replicates, rows) of bytes."""
        n, (words, by_y, by_p, p_ranks) = self.n, self.whole
        found = np.full(LANES, np.nan)
        lanes = words.view(np.uint8).reshape(n, LANES)
        for k in range(LANES):
            lanes[:, k] = w[min(k, len(w) - 1)]
        np.take(words, self.by_y.order, out=by_y, mode="clip")
        np.take(words, self.by_p.order, out=by_p, mode="clip")
        y_ranks, middle = words, np.int32(n)
        for k in range(LANES // 2):
            yy = self._ranks(by_y, k, self.by_y, y_ranks)
            pp = self._ranks(by_p, k, self.by_p, p_ranks)
            yp = np.zeros(2)
            for a in range(0, n, WORDS_AT_ONCE):
                m = min(WORDS_AT_ONCE, n - a)
                copies = self._two(by_p[a : a + m], k, self.some[0][:m]).view(np.int32)
                ry = np.take(y_ranks, self.y_cell[a : a + m], out=self.some[1][:m], mode="clip").view(np.int32)
                rp = p_ranks[a : a + m] if self.by_p.distinct else np.take(p_ranks, self.by_p.of_ordered[a : a + m], out=self.some[2][:m], mode="clip")
                rp = rp.view(np.int32)
                ry -= middle
                ry *= copies
                left, right = self.lane[0][:m], self.lane[1][:m]
                for i in (0, 1):
                    left[...], right[...] = ry[i::2], rp[i::2]
                    right -= n
                    yp[i] += np.dot(left, right)
            found[[k, k + LANES // 2]] = np.divide(yp, np.sqrt(yy * pp), out=np.full(2, np.nan), where=(yy > 0) & (pp > 0))
        return found[: len(w)]


def _pair_statistic(columns: dict[str, np.ndarray]) -> Callable:
    y, p = columns["y"], columns["p"]
    by_y, by_p = _Cells(y), _Cells(p)
    y_cell = np.empty(len(y), np.int64)
    y_cell[by_y.order] = by_y.of_ordered
    y_cell = y_cell[by_p.order]
    terms = np.stack([y, p, y * y, p * p, y * p])
    words = None

    def pearson(w: np.ndarray, n: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(w), len(terms)))
        for k in range(0, len(y), ROWS_AT_ONCE):
            sums += w[:, k : k + ROWS_AT_ONCE].astype(float) @ terms[:, k : k + ROWS_AT_ONCE].T
        sy, sp, yy, pp, yp = sums.T
        vy, vp = yy - sy * sy / n, pp - sp * sp / n
        out = np.full(len(w), np.nan)
        # The values are centred, so little cancels; where much does, the replicate is centred itself.
        plain = (vy > 1e-3 * yy) & (vp > 1e-3 * pp)
        out[plain] = (yp - sy * sp / n)[plain] / np.sqrt(vy[plain] * vp[plain])
        for k in np.flatnonzero(~plain):
            out[k : k + 1] = _weighted_pearson(w[k : k + 1].astype(float), y, p)
        return out

    def spearman(w: np.ndarray, n: np.ndarray) -> np.ndarray:
        whole = np.int32 if n.max(initial=0) < 1 << 29 else np.int64
        copies = by_y.totals(w.take(by_y.order, axis=1).astype(whole))
        ry = _doubled_ranks(copies, n)
        yy = _rank_squares(copies, ry, n)
        ordered = w.take(by_p.order, axis=1).astype(whole)
        copies = by_p.totals(ordered)
        rp = _doubled_ranks(copies, n)
        pp = _rank_squares(copies, rp, n)
        shared = np.multiply(ry.take(y_cell, axis=1), ordered, dtype=float)
        yp = np.einsum("ij,ij->i", by_p.totals(shared), rp.astype(float))
        return np.divide(yp, np.sqrt(yy * pp), out=np.full(len(w), np.nan), where=(yy > 0) & (pp > 0))

    def evaluate(w: np.ndarray) -> list[np.ndarray]:
        nonlocal words
        if w.dtype == np.uint8 and len(y) <= WORD_ROWS:
            words = words or _Words(by_y, by_p, y_cell)
            n = np.full(len(w), len(y), np.int64)
            return [pearson(w, n), np.concatenate([words.spearman(w[k : k + LANES]) for k in range(0, len(w), LANES)])]
        n = w.sum(axis=1, dtype=np.int64)
        step = max(1, CELLS // max(len(y), 1))
        return [pearson(w, n), np.concatenate([spearman(w[k : k + step], n[k : k + step]) for k in range(0, len(w), step)])]

    return evaluate


def _ranged_pairs(rows: DataFrame, b: int, keys: Sequence[str], seed: int, like: Profile) -> DataFrame:
    """(b, keys..., pearson, spearman) for groups too large for a task: the same draws, made anew for every range of p.

    A task has the rows of a range of p, the order of all rows of the group by y (their numbers, packed) and some replicates. It cumulates the copies of
    all rows in that order, so it knows the ranks by y of its own, and ranks them by p inside the range; what lies in lower ranges is added afterwards. No
    more than sums per replicate and range leave it. Equal values of p are in one range.
    """
    keys, limit, block, hot = list(keys), SLICE, BLOCK, hot_rows(rows.sparkSession)
    numbered = materialise(_numbered(rows, keys, ["y", "p"], seed, "id", like).withColumn("_rn", F.col("_rn").cast("int")))
    pieces = max(math.ceil(like.largest / hot), 2)
    cuts = numbered.groupBy(*keys) if keys else numbered
    cuts = cuts.agg(F.array_distinct(F.percentile_approx("p", [k / pieces for k in range(1, pieces)], 20 * pieces)).alias("_cuts"))
    cuts = materialise(cuts)  # a sketch need not come out the same twice
    groups = like.rows // hot + 1
    at = F.size(F.filter("_cuts", lambda c: c < F.col("p")))
    cells = value_cells(numbered, keys, "y", like=like).select(*keys, "y", F.col("n_before").alias("_below"), (F.col("n_before") + F.col("n")).alias("_upto"))
    if keys:
        own = attach(numbered, cuts, keys, groups)
    else:
        own = numbered.withColumn("_one", F.lit(1)).join(F.broadcast(cuts.withColumn("_one", F.lit(1))), "_one").drop("_one")
    own = null_safe_join(own.withColumn("at", at).drop("_cuts"), cells, [*keys, "y"])
    own = own.select(*keys, "at", "_n", "_k", "_rn", "y", "p", "_below", "_upto", F.lit(None).cast("long").alias("_pack"), F.lit(None).cast("array<int>").alias("_order"))
    placed = number_rows(numbered.select(*keys, "_n", "_k", "_rn", "y"), keys, ["y", "_rn"], "_place", like)
    packs = placed.groupBy(*keys, "_n", "_k", F.floor((F.col("_place") - 1) / limit).alias("_pack")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_place", "_rn"))), lambda x: x["_rn"]).alias("_order")
    )
    empty = {c: F.lit(None).cast(own.schema[c].dataType) for c in ("_rn", "y", "p", "_below", "_upto")}
    packs = packs.withColumns(empty).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    names = ["n", "w", "r", "rr", "rc", "cc", "sy", "sp", "syy", "spp", "syp"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        replicate = key[1]
        held = table.filter(table.column("_pack").is_valid())
        turn = np.argsort(held.column("_pack").to_numpy())
        order = np.concatenate([held.column("_order")[int(k)].values.to_numpy() for k in turn])
        n, stratum = table.column("_n")[0].as_py(), table.column("_k")[0].as_py()
        mine = table.filter(table.column("_pack").is_null())
        del table, held
        out = np.zeros((len(replicate), len(names)))
        out[:, 0] = n
        if len(mine):
            rn, y, p, below, upto = (mine.column(c).to_numpy() for c in ("_rn", "y", "p", "_below", "_upto"))
            del mine
            by_p = _Cells(p)
            rn, y, p, below, upto = (x[by_p.order] for x in (rn, y, p, below, upto))
            terms = np.stack([y, p, y * y, p * p, y * p], axis=1)
            sizes = slice_sizes(n, limit)
            strata = _Strata(stratum, sizes, slice_draws(stratum, sizes, replicate, block))
            copies_of, by_y = np.empty(n, np.uint8), np.empty(n + 1, np.int64 if n > 1 << 30 else np.int32)
            by_y[0] = 0
            for i, r in enumerate(replicate):
                parts = list(strata.slices(i, r))
                if max(x.dtype.itemsize for x in parts) > copies_of.itemsize:
                    copies_of = copies_of.astype(np.int32)
                start = 0
                for x in parts:
                    copies_of[start : start + len(x)] = x
                    start += len(x)
                for k in range(0, n, WORDS_AT_ONCE):
                    some = copies_of.take(order[k : k + WORDS_AT_ONCE]).astype(by_y.dtype)
                    some[0] += by_y[k]
                    np.add.accumulate(some, out=by_y[k + 1 : k + 1 + len(some)])
                own_copies = copies_of.take(rn)
                inside = np.cumsum(own_copies, dtype=by_y.dtype)
                total = int(inside[-1])
                ends = inside[by_p.lasts]
                ranks = (ends + np.r_[0, ends[:-1]] - total).astype(float)
                for k in range(0, len(rn), WORDS_AT_ONCE):
                    w = own_copies[k : k + WORDS_AT_ONCE].astype(float)
                    ry = by_y.take(below[k : k + WORDS_AT_ONCE]).astype(float)
                    ry += by_y.take(upto[k : k + WORDS_AT_ONCE])
                    ry -= n
                    rp = ranks.take(by_p.of_ordered[k : k + WORDS_AT_ONCE])
                    both = w * ry
                    out[i, 2:6] += both.sum(), np.dot(both, ry), np.dot(both, rp), np.dot(w * rp, rp)
                    out[i, 6:] += w @ terms[k : k + WORDS_AT_ONCE]
                out[i, 1] = total
        own_key = [pa.array([v.as_py()] * len(replicate), v.type) for v in key[0][:-1]]
        columns = {"b": pa.array(replicate, pa.int32()), **dict(zip(keys, own_key)), "at": pa.array([key[0][-1].as_py()] * len(replicate), pa.int32())}
        return pa.table({**columns, **{c: out[:, k] for k, c in enumerate(names)}})

    fields = [T.StructField("b", T.IntegerType()), *[own.schema[c] for c in keys], T.StructField("at", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]]
    met = _in_lanes(own.unionByName(packs), [*keys, "at"], b, groups * pieces, run, T.StructType(fields))
    lower = F.coalesce(F.sum("w").over(Window.partitionBy("b", *keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # Inside a range the ranks are relative to its mean; the range's own mean is this far from that of the group.
    met = met.withColumn("_far", F.col("w") + 2 * lower - F.col("n"))
    n, sums = F.max("n"), {c: F.sum(c) for c in names}
    yp, pp = F.sum(F.col("rc") + F.col("_far") * F.col("r")), F.sum(F.col("cc") + F.col("w") * F.col("_far") * F.col("_far"))
    vy, vp = sums["syy"] - sums["sy"] * sums["sy"] / n, sums["spp"] - sums["sp"] * sums["sp"] / n
    pearson = F.try_divide(sums["syp"] - sums["sy"] * sums["sp"] / n, F.sqrt(F.greatest(vy, F.lit(0.0)) * F.greatest(vp, F.lit(0.0))))
    # The squares of ranks are 0 exactly where all drawn values are one.
    return met.groupBy("b", *keys).agg(
        F.when((sums["rr"] > 0) & (pp > 0), pearson).alias("pearson"), F.try_divide(yp, F.sqrt(sums["rr"] * pp)).alias("spearman")
    )


def bootstrap_pairs_ci(df: DataFrame, b: int = 10_000, keys: Sequence[str] = ("grp",), seed: int = 0) -> DataFrame:
    """Percentile intervals of Pearson and Spearman from one set of row bootstraps per key; none below 5 rows.

    Values are taken relative to the key's mean first, which changes no correlation and keeps the sums accurate.
    """
    keys = list(keys)
    known = df.dropna(subset=["actual", "pred"])
    shape = profile(known, keys)
    means = group_attach(known, keys, [F.avg("actual").alias("_my"), F.avg("pred").alias("_mp"), F.count(F.lit(1)).alias("_size")], shape)
    rows = means.filter("_size >= 5").select(*keys, "id", "_size", (F.col("actual") - F.col("_my")).alias("y"), (F.col("pred") - F.col("_mp")).alias("p"))
    statistics = "pearson double, spearman double"
    hot = hot_rows(df.sparkSession)
    if shape.largest <= hot:
        return percentile_ci(resampled(rows.drop("_size"), b, keys, keys, ["y", "p"], _pair_statistic, statistics, seed, like=shape), keys, ["pearson", "spearman"])
    rows = materialise(rows)
    small = rows.filter(F.col("_size") <= hot).drop("_size")
    stats = _ranged_pairs(rows.filter(F.col("_size") > hot).drop("_size"), b, keys, seed, shape)
    if keys:
        stats = stats.unionByName(resampled(small, b, keys, keys, ["y", "p"], _pair_statistic, statistics, seed, like=profile(small, keys)))
    return percentile_ci(stats, keys, ["pearson", "spearman"])


def bootstrap_stratified(a: DataFrame, b_run: DataFrame, b: int = 10_000, seed: int = 0, group: str = "grp") -> DataFrame:
    """Two runs on the same rows, resampled inside groups: intervals of both group R2, their difference, the share of
    excess removed, and the two-sided p of the difference.

    A group R2 needs sums of values and squares per group only. Values are taken relative to their mean, which changes no R2.
    """
    values = ["actual", "pred_a", "pred_b"]
    both = a.select("id", group, "actual", F.col("pred").alias("pred_a")).join(b_run.select("id", F.col("pred").alias("pred_b")), "id")
    both = group_attach(both.dropna(subset=values), [], [F.avg(v).alias(f"_m_{v}") for v in values])
    x = {v: F.col(v) - F.col(f"_m_{v}") for v in values}
    terms = {"n": F.lit(1.0), **{f"s_{v}": x[v] for v in values}, **{f"q_{v}": x[v] * x[v] for v in values}}
    sums = resampled_sums(both, b, [group], terms, seed)
    r2 = []
    for v in values:
        s, q = F.col(f"s_{v}"), F.col(f"q_{v}")
        sst = F.sum(q) - F.sum(s) * F.sum(s) / F.sum("n")
        r2.append(F.when(sst > 0, 1 - F.try_divide(F.sum(q - s * s / F.col("n")), sst)).alias(f"r2_{v}"))
    stats = materialise(sums.groupBy("b").agg(*r2))  # b rows, read twice below: the draws are made once
    d = F.col("r2_pred_a") - F.col("r2_pred_b")
    stats = stats.withColumn("diff", d).withColumn("removed", F.try_divide(d, F.col("r2_pred_a") - F.col("r2_actual")))
    ci = percentile_ci(stats, [], ["r2_pred_a", "r2_pred_b", "diff", "removed"])
    n = F.count(F.lit(1))
    p = stats.agg((2 * F.least(F.count_if(F.col("diff") <= 0) / n, F.count_if(F.col("diff") >= 0) / n)).alias("p_diff"))
    return ci.withColumn("_one", F.lit(1)).join(F.broadcast(p.withColumn("_one", F.lit(1))), "_one").drop("_one")


def _auc_statistic(columns: dict[str, np.ndarray]) -> Callable:
    score, positive = columns["_score"], columns["cls"].astype(bool)
    order = np.argsort(score, kind="stable")
    ordered = score[order]
    firsts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    lift = positive[order].astype(float)

    def evaluate(w: np.ndarray) -> list[np.ndarray]:
        w = w[:, order].astype(float)
        above = np.add.reduceat(w * lift, firsts, axis=1)
        below = np.add.reduceat(w, firsts, axis=1) - above
        wins = (above * (np.cumsum(below, axis=1) - below / 2)).sum(axis=1)
        pairs = above.sum(axis=1) * below.sum(axis=1)
        return [np.divide(wins, pairs, out=np.full(len(w), np.nan), where=pairs > 0)]

    return evaluate


def _ranged_auc(rows: DataFrame, b: int, seed: int, like: Profile) -> DataFrame:
    """(b, auc) for classes too large for a task: the same draws, made anew for every range of the score.

    A task has the rows of a range and some replicates. It makes the multiplicities of a class slice by slice (slices share their draws, so
    this costs little beside the rows), keeps those of its rows and counts wins inside the range; positives of a range also win against the
    negatives of all lower ranges. Equal scores are in one range.
    """
    numbered = _numbered(rows, ["cls"], ["_score"], seed, "id", like).withColumn("_score", F.col("_score").cast("double"))
    limit, block = SLICE, BLOCK
    hot = hot_rows(rows.sparkSession)
    pieces = math.ceil(like.rows / min(hot, max(RANGE_ROWS, like.rows // 16)))
    cuts = rows.agg(F.percentile_approx(F.col("_score").cast("double"), [k / pieces for k in range(1, pieces)], 10 * pieces)).first()[0] if pieces > 1 else []
    cuts = sorted(set(cuts or []))
    below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("_score"))) if cuts else F.lit(0)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        replicate = key[1]
        cls, stratum, rn, n, score = (table.column(c).to_numpy() for c in ("cls", "_k", "_rn", "_n", "_score"))
        turn = np.lexsort((rn, cls))
        cls, stratum, rn, n, score = (x[turn] for x in (cls, stratum, rn, n, score))
        classes = []
        for first in np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]):
            sizes = slice_sizes(int(n[first]), limit)
            own = rn[cls == cls[first]]
            ends = np.searchsorted(own, limit * np.arange(len(sizes) + 1))
            wanted = [own[ends[p] : ends[p + 1]] - p * limit for p in range(len(sizes))]
            classes.append((_Strata(int(stratum[first]), sizes, slice_draws(int(stratum[first]), sizes, replicate, block)), wanted))
        cells = _Cells(score)
        whole = np.int64 if len(score) > 1 << 26 else np.int32
        lost = (cls == 0)[cells.order].astype(whole)
        out = np.empty((len(replicate), 3))
        for i, r in enumerate(replicate):
            w = np.concatenate([m.take(rows) for drawn_rows, wanted in classes for m, rows in zip(drawn_rows.slices(i, r), wanted)])
            w = w.take(cells.order).astype(whole)
            neg = w * lost
            w -= neg
            pos, neg = cells.totals(w[None])[0], cells.totals(neg[None])[0]
            upto = np.cumsum(neg, dtype=whole)
            total = float(upto[-1])
            upto += upto
            upto -= neg
            out[i] = pos.sum(dtype=np.int64), total, np.dot(pos.astype(float), upto.astype(float)) / 2
        return pa.table({"b": pa.array(replicate, pa.int32()), "at": pa.array([key[0][0].as_py()] * len(replicate), pa.int32()), "pos": out[:, 0], "neg": out[:, 1], "wins": out[:, 2]})

    kind = T.StructType.fromDDL("b int, at int, pos double, neg double, wins double")
    met = _in_lanes(numbered.withColumn("at", below.cast("int")), ["at"], b, len(cuts) + 1, meet, kind)
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    each = met.withColumn("_lower", lower).groupBy("b")
    return each.agg(F.try_divide(F.sum(F.col("wins") + F.col("pos") * F.col("_lower")), F.sum("pos") * F.sum("neg")).alias("auc"))


def bootstrap_auc_by_class(df: DataFrame, score: str, event: Column, b: int = 2000, seed: int = 0) -> DataFrame:
    """Interval of the AUC with positives and negatives resampled separately."""
    rows = df.withColumn("cls", event.cast("int")).withColumn("_score", F.col(score)).dropna(subset=["_score", "cls"]).select("id", "cls", "_score")
    like = profile(rows, ["cls"])
    if like.rows <= min(hot_rows(df.sparkSession), AUC_ROWS):
        stats = resampled(rows, b, ["cls"], [], ["cls", "_score"], _auc_statistic, "auc double", seed, like=like)
        return percentile_ci(stats, [], ["auc"])
    return percentile_ci(_ranged_auc(materialise(rows), b, seed, like), [], ["auc"])


def bootstrap_group_means(groups: DataFrame, value: str, b: int = 10_000, seed: int = 0, group: str = "grp") -> DataFrame:
    """Resample whole groups: interval of the mean of a group-level value."""
    known = groups.select(F.col(group).alias("id"), F.col(value).alias("_v")).dropna(subset=["_v"])
    sums = resampled_sums(known, b, [], {"s": F.col("_v"), "n": F.lit(1.0)}, seed)
    return percentile_ci(sums.select((F.col("s") / F.col("n")).alias("mean")), [], ["mean"])


def bootstrap_cluster(df: DataFrame, values: Sequence[str], b: int = 1000, seed: int = 0, group: str = "grp") -> DataFrame:
    """Resample whole groups, each draw a group of its own: interval of the group R2 of each value.

    A group drawn w times counts as w equal groups, so only the group sums are resampled and the rows stay put. Values are taken relative
    to their mean, which changes no R2.
    """
    known = group_attach(df.dropna(subset=list(values)), [], [F.avg(v).alias(f"_m_{v}") for v in values])
    x = {v: F.col(v) - F.col(f"_m_{v}") for v in values}
    aggs = [F.sum(c).alias(f"_{p}_{v}") for v in values for p, c in (("s", x[v]), ("q", x[v] * x[v]))]
    sums = known.groupBy(F.col(group).alias("id")).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    terms = {"n": F.col("_rows")}
    for v in values:
        s, q = F.col(f"_s_{v}"), F.col(f"_q_{v}")
        terms |= {f"s_{v}": s, f"q_{v}": q, f"w_{v}": q - s * s / F.col("_rows")}
    sample = resampled_sums(sums, b, [], terms, seed)
    out = []
    for v in values:
        sst = F.col(f"q_{v}") - F.col(f"s_{v}") * F.col(f"s_{v}") / F.col("n")
        out.append(F.when(sst > 0, 1 - F.try_divide(f"w_{v}", sst)).alias(v))
    return percentile_ci(sample.select("b", *out), [], list(values))
