"""Group statistics, ranks and quantiles that hold when one group has most of the rows.

The groups of this library (a cohort's tissues, an order's nation) are few and uneven. Two rules follow:

* a group statistic goes back to the rows by a join against the aggregated table. The table is broadcast
  when the measured number of groups allows it and shuffled otherwise;
* a window is opened over a whole group only while the largest group fits in a task (``hotRows``). Beyond
  that the rows are range-partitioned by (group, order), each slice is numbered on its own, and the slice
  totals give every slice its starting point. The results are the same.

NULL is a key like any other: all joins on keys are null-safe, so the rows without a group are one group everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heldout.plans.storage import materialise

HOT_ROWS = "spark.heldout.hotRows"
HOT_ROWS_DEFAULT = 4_000_000
BROADCAST_ROWS = "spark.heldout.broadcastRows"
BROADCAST_ROWS_DEFAULT = 100_000


def hot_rows(spark: SparkSession) -> int:
    """Rows of one group that a single task may sort."""
    return int(spark.conf.get(HOT_ROWS, str(HOT_ROWS_DEFAULT)))


def broadcast_rows(spark: SparkSession) -> int:
    """Rows of a statistics table that may be broadcast."""
    return int(spark.conf.get(BROADCAST_ROWS, str(BROADCAST_ROWS_DEFAULT)))


@dataclass(frozen=True)
class Profile:
    """Measured shape of a grouping: number of groups, rows of the largest one, rows in all."""

    groups: int
    largest: int
    rows: int

    def times(self, copies: int) -> Profile:
        """The shape when every row is repeated under ``copies`` values of a further key."""
        return Profile(self.groups * copies, self.largest, self.rows * copies)


_profiles: dict[tuple, Profile] = {}


def profile(df: DataFrame, keys: Sequence[str]) -> Profile:
    """Measure a grouping with one column-pruned, map-side combined count.

    The result is one row. It is remembered per session, logical plan and files read, so operators that share an
    input do not count it again and a table written anew is counted anew.
    """
    spark = df.sparkSession
    subject = df.select(*keys)
    memo = (spark.sparkContext.applicationId, tuple(keys), subject.semanticHash(), tuple(sorted(subject.inputFiles())))
    if memo not in _profiles:
        sizes = subject.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        row = sizes.agg(F.count(F.lit(1)), F.max("rows"), F.sum("rows")).first()
        _profiles[memo] = Profile(row[0] or 0, row[1] or 0, row[2] or 0)
    return _profiles[memo]


SPREAD_ROWS = 20_000_000


def spread(df: DataFrame, like: Profile) -> DataFrame:
    """Give a small table to all cores before work that multiplies its rows.

    A table of few rows may sit in a single input split. A large one has splits enough and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if like.rows <= SPREAD_ROWS else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names in which NULL equals NULL; the keys of ``left`` are kept."""
    own = [f"_key_{i}" for i in range(len(keys))]
    named = right.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)])
    return left.join(named, same, how).drop(*own)


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], bound: int | None = None, how: str = "left") -> DataFrame:
    """Join one statistics row per key to ``rows``.

    ``bound`` is a known upper limit of the rows of ``stats``; without it the distinct keys are counted.
    Within the broadcast limit the big side is not shuffled. Above it this is an ordinary join in which
    adaptive execution splits skewed keys.
    """
    limit = broadcast_rows(rows.sparkSession)
    if bound is None:
        bound = stats.select(*keys).limit(limit + 1).count()
    return null_safe_join(rows, F.broadcast(stats) if bound <= limit else stats, keys, how)


def group_attach(rows: DataFrame, keys: Sequence[str], aggs: Sequence[Column], like: Profile | None = None) -> DataFrame:
    """Aggregate ``rows`` by ``keys`` and attach the result to every row (a group window without the sort).

    Without keys the aggregate is one row, which is always small enough to broadcast.
    """
    if not keys:
        one = rows.agg(*aggs).withColumn("_one", F.lit(1))
        return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")
    return attach(rows, rows.groupBy(*keys).agg(*aggs), keys, (like or profile(rows, keys)).groups)


def cumulate(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Sequence[str], like: Profile | None = None
) -> DataFrame:
    """Add ``<c>_before`` for each column of ``sums``: its total over rows of the same key that sort earlier.

    ``order`` must be free of ties inside a key. ``like`` is a profile that bounds this one.
    """
    spark, keys = df.sparkSession, list(keys)
    like = like or profile(df, keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]

    def before(window, c):
        return F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if like.largest <= hot_rows(spark):
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[before(whole, c).alias(f"{c}_before") for c in sums])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * math.ceil(like.rows / hot_rows(spark)))
    cut = materialise(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id())
    )
    totals = cut.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(c) for c in sums])
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    starts = totals.select(*keys, "_slice", *[before(by_slice, c).alias(f"{c}_start") for c in sums])
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = cut.select("*", *[before(inner, c).alias(f"{c}_inner") for c in sums])
    joined = attach(numbered, starts, [*keys, "_slice"], like.groups + parts)
    return joined.select(
        *df.columns, *[(F.col(f"{c}_start") + F.col(f"{c}_inner")).alias(f"{c}_before") for c in sums]
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "rn", like: Profile | None = None
) -> DataFrame:
    """``row_number`` per key in ``order`` (which must be unique inside a key), safe for a hot key."""
    like = like or profile(df, keys)
    if like.largest <= hot_rows(df.sparkSession):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    numbered = cumulate(df.withColumn("_unit", F.lit(1).cast("long")), keys, order, ["_unit"], like)
    return numbered.withColumn(out, F.col("_unit_before") + 1).drop("_unit", "_unit_before")


def value_cells(
    df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None, descending: bool = False,
    like: Profile | None = None,
) -> DataFrame:
    """One row per distinct (keys, value): ``n`` rows, ``n_before`` rows sorting earlier, and the like for ``sums``.

    NULL values are left out. Ties are combined on the map side, so a value that fills a third of the table
    is one row here.
    """
    known = df.filter(F.col(value).isNotNull())
    wanted = {"n": F.count(F.lit(1)), **{k: F.sum(c) for k, c in (sums or {}).items()}}
    cells = known.groupBy(*keys, value).agg(*[c.alias(k) for k, c in wanted.items()])
    order = F.col(value).desc() if descending else F.col(value).asc()
    return cumulate(cells, keys, [order], list(wanted), like or profile(df, keys))


def midrank(df: DataFrame, keys: Sequence[str], value: str, out: str, like: Profile | None = None) -> DataFrame:
    """Average-tie rank of ``value`` inside ``keys``; NULL stays NULL."""
    keys, like = list(keys), like or profile(df, keys)
    if like.largest <= hot_rows(df.sparkSession):
        w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return df.withColumn(out, F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / F.lit(2.0)))
    return midranks(df, keys, {out: value}, like)


def midranks(df: DataFrame, keys: Sequence[str], columns: dict[str, str], like: Profile | None = None) -> DataFrame:
    """Midranks of several columns (out name to column) over the same keys, measured once."""
    keys, like = list(keys), like or profile(df, keys)
    if like.largest > hot_rows(df.sparkSession):
        return _sliced_midranks(df, keys, columns, like)
    for out, value in columns.items():
        df = midrank(df, keys, value, out, like)
    return df


#: Partitions over which rows that need no sorting are spread.
SALT = 64


def _sliced_midranks(df: DataFrame, keys: list[str], columns: dict[str, str], like: Profile) -> DataFrame:
    """Midranks where a key has more rows than a task may sort: one shuffle of the rows per column.

    Cut values found by a sketch split each large key into open intervals (even slices) and the cut values themselves (odd slices). One count
    of the slices gives the rows before each. Rows of an interval are ranked among themselves; a row at a cut value needs only the counts, so
    a value that fills a third of the table is never sorted. The cuts need not be even for the ranks to be exact.
    """
    own = keys or ["_all"]
    df = materialise(df if keys else df.withColumn("_all", F.lit(1)))
    hot = hot_rows(df.sparkSession)
    big = df.groupBy(*own).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot).select(*own)
    bound = like.rows // hot + 1
    pieces = math.ceil(2 * like.largest / hot)
    values = list(dict.fromkeys(columns.values()))
    at = {v: f"_cuts_{i}" for i, v in enumerate(values)}
    large = attach(df.select(*own, *[v for v in values if v not in own]), big, own, bound, "inner")
    probs = [k / pieces for k in range(1, pieces)]
    # Written down, because a sketch need not come out the same twice.
    cuts = materialise(large.groupBy(*own).agg(*[F.array_distinct(F.percentile_approx(v, probs, 20 * pieces)).alias(c) for v, c in at.items()]))

    def slice_of(v: str) -> Column:
        known = lambda test: F.size(F.filter(F.coalesce(F.col(at[v]), F.array().cast(cuts.schema[at[v]].dataType)), test))
        return F.when(F.col(v).isNotNull(), known(lambda c: c < F.col(v)) + known(lambda c: c <= F.col(v)))

    placed = attach(large, cuts, own, bound)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_which"), slice_of(v).alias("_slice")) for v, c in at.items()]))
    counts = placed.select(*own, each.alias("_s")).select(*own, "_s.*").groupBy(*own, "_which", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*own, "_which").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(counts.filter("_slice IS NOT NULL").withColumn("_start", F.coalesce(before, F.lit(0))))
    for out, v in columns.items():
        c = at[v]
        rows = attach(df, cuts.select(*own, c), own, bound).withColumn("_slice", slice_of(v)).drop(c)
        counted = F.col(v).isNull() | (F.col("_slice") % 2 == 1)
        rows = rows.withColumn("_salt", F.when(counted, F.monotonically_increasing_id() % SALT).otherwise(0).cast("int"))
        w = Window.partitionBy(*own, "_slice", "_salt").orderBy(F.when(~counted, F.col(v)))
        ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        rows = rows.withColumn("_inside", F.rank().over(w) + (ties - 1) / F.lit(2.0)).drop("_salt")
        rows = attach(rows, starts.filter(F.col("_which") == c).drop("_which"), [*own, "_slice"], bound * (2 * pieces + 1))
        rank = F.when(counted, F.col("_start") + (F.col("_n") + 1) / F.lit(2.0)).otherwise(F.coalesce("_start", F.lit(0)) + F.col("_inside"))
        df = rows.withColumn(out, F.when(F.col(v).isNotNull(), rank)).drop("_slice", "_inside", "_start", "_n")
    return df.drop("_all")


def min_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = False, like: Profile | None = None
) -> DataFrame:
    """Minimum-tie rank (1 = first) in either direction; NULL stays NULL."""
    keys, like = list(keys), like or profile(df, keys)
    if like.largest <= hot_rows(df.sparkSession):
        order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(order)).cast("long")
        return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))
    df = materialise(df)  # the join below is on values, which must not be computed twice
    cells = value_cells(df, keys, value, descending=descending, like=like)
    return null_safe_join(df, cells.select(*keys, value, (F.col("n_before") + 1).alias(out)), [*keys, value], "left")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], like: Profile | None = None
) -> DataFrame:
    """Exact linear (type 7) quantiles per key, one column per entry of ``wanted``.

    A group that fits a task uses the built-in exact ``percentile``. Otherwise the positions are found in
    the counted values, because the built-in one gathers all distinct values of a group in one buffer.
    """
    keys, like = list(keys), like or profile(df, keys)
    if like.largest <= hot_rows(df.sparkSession):
        aggs = [F.percentile(value, F.lit(p)).alias(k) for k, p in wanted.items()]
        return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    cells = value_cells(df, keys, value, like=like)
    sized = group_attach(cells, keys, [F.sum("n").alias("_total")], like)
    ends = []
    for name, p in wanted.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("n_before") <= pos) & (pos < F.col("n_before") + F.col("n"))
            ends.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        ends.append(F.max(at).alias(f"_{name}_at"))
    found = sized.groupBy(*keys).agg(*ends) if keys else sized.agg(*ends)

    def between(n: str) -> Column:
        # The arithmetic of the built-in function, so that both ways agree to the last digit.
        lo, hi, at = F.col(f"_{n}_lo"), F.col(f"_{n}_hi"), F.col(f"_{n}_at")
        mixed = (F.ceil(at) - at) * lo.cast("double") + (at - F.floor(at)) * hi.cast("double")
        return F.when(lo == hi, lo.cast("double")).otherwise(mixed).alias(n)

    return _all_groups(df, keys, found.select(*keys, *[between(n) for n in wanted]))


def _all_groups(df: DataFrame, keys: Sequence[str], found: DataFrame) -> DataFrame:
    """``found`` with a row for every group of ``df``, also for groups without a known value."""
    return null_safe_join(df.select(*keys).distinct(), found, keys, "left") if keys else found


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, coverage: float, out: str) -> DataFrame:
    """The k-th smallest value per key, k = ceil((n+1)*coverage); NULL with status ``infinite`` when k > n."""
    like = profile(df, keys)
    cells = value_cells(df, keys, value, like=like)
    sized = group_attach(cells, keys, [F.sum("n").alias("_total")], like)
    k = F.ceil((F.col("_total") + 1) * F.lit(coverage))
    hit = (F.col("n_before") < k) & (k <= F.col("n_before") + F.col("n"))
    aggs = [
        F.max("_total").alias("n"),
        F.max(k).alias("k"),
        F.max(F.when(hit, F.col(value))).alias(out),
    ]
    found = sized.groupBy(*keys).agg(*aggs) if keys else sized.agg(*aggs)
    return found.withColumn("status", F.when(F.col("k") > F.col("n"), "infinite").otherwise("finite"))
