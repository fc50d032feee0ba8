"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rows of a table of ids that may be broadcast; beyond it the join is an ordinary one.
BROADCAST_IDS = 100_000


#: What an operator keeps in a worker between its tasks, by name, as a function that drops it.
_held: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Say how to drop what the operator ``name`` keeps in this worker."""
    _held[name] = drop


def give_back(keep: str = "") -> None:
    """At the end of a task, drop what other operators than ``keep`` hold in this worker, and return freed memory to the system: Python workers
    live on, and other stages need the room."""
    for name in [n for n in _held if n != keep]:
        _held.pop(name)()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(column: str) -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays (``lower`` would change letters beyond ASCII)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(df: DataFrame) -> int:
    """Partitions for work that is dealt out by key: as many as the input has splits, and the session's number at least."""
    spark: SparkSession = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def drop_ids(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not among ``dropped`` (distinct, materialised). A null id matches a null id."""
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    name = free_name(docs, "_gone")
    gone = dropped.select(F.col(id_col).alias(name))
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
