"""A Merkle manifest of a table: every row a leaf, one tree per source, the sources' roots in a tree of their own, and octopus multiproofs.

A digest is the lower-case hexadecimal SHA-256 of its inputs joined (digests as text). Leaves of a source stand in the order of their id; every
``FAN`` consecutive nodes become one, level by level, until one is left, the source's subroot. The subroots, ordered by source, become the root
the same way. Trees are named ``n`` (null source), ``s`` + source, and ``t`` for the tree of subroots; a node's coordinate is (tree, level, pos).

* ``build``: leaves are numbered per source in range-partitioned slices, so a source with a third of all rows is not one task's. Blocks of
  ``FAN ** STEP`` leaves give the next ``STEP`` levels in one pass, blocks of those the next, so the passes grow with the logarithm.
* ``prove``: wanted leaves are dealt out by block. Each partition computes the coordinates that its leaves together need and that it cannot
  derive itself (the minimal union), these are fetched once by a join, shared interiors are derived once, and every leaf's own proof is
  then read off locally. A partition holds about ``PROVED`` leaves whatever the sizes of the sources.
* ``fold``: the root that a claimed leaf digest leads to with a proof.

Tables of the manifest are written to the shared folder; a lost executor repeats its tasks from them.

Defined cases: a null value is ``-`` in a leaf; null ids stand before all others; rows that repeat an id are leaves of their own, ordered by
their digest and then as written; the null source is before all others, the empty source is another one; a table of one row has that leaf
as its root and empty proofs; an empty table has no leaves, no nodes and no root. Extra columns are ignored by leaves unless named in ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.llm.common import ascii_lower, give_back
from heldout.plans.skew import Profile, attach, number_rows, profile
from heldout.plans.storage import materialise

FAN = 16
#: Levels that one pass adds.
STEP = 3
#: Nodes of one partition, about: when levels are built, and when proofs are made (a proof may have some thousand characters).
PARTITION, PROVED = 1 << 14, 1 << 12
NODE = "tree string, level int, pos long, digest string"
TOP = "t"
#: Columns that a proof does not need any more.
INNER = ["bucket", "n", "top", "tops", "pos"]


def digest_of(values: Sequence[Column]) -> Column:
    """The leaf digest of some values: each ``-`` if null, else its bytes' number, a colon and the value, all joined."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def tree_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, pos, digest, id and carried columns. ``nodes``: all nodes, leaves and subroots of all trees included.
    ``trees``: tree, n (its leaves), subroot, top (position among the subroots), tops (subroots in all), root."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def _bucket(rows: int, size: int, levels: int) -> Column:
    """Deals the blocks of ``FAN ** levels`` nodes out to partitions of about ``size`` of ``rows`` nodes."""
    return F.pmod(F.xxhash64("tree", F.shiftright("pos", 4 * levels)), F.lit(max(1, -(-rows // size))))


def _levels(nodes: pa.Table) -> pa.Table:
    """The next ``STEP`` levels above the nodes of whole blocks (``size`` is the number of nodes of their level in the tree)."""
    blocks: dict[tuple[str, int], list[tuple[int, str, int, int]]] = {}
    for tree, pos, *rest in zip(*[nodes.column(c).to_pylist() for c in ("tree", "pos", "digest", "size", "level")]):
        blocks.setdefault((tree, pos // FAN**STEP), []).append((pos, *rest))
    out = []
    for (tree, _), block in blocks.items():
        first, _, size, level = min(block)
        digests = [digest for _, digest, _, _ in sorted(block)]
        for _ in range(STEP):
            if size == 1:
                break
            digests = [_hash(digests[k : k + FAN]) for k in range(0, len(digests), FAN)]
            size, level, first = -(-size // FAN), level + 1, first // FAN
            out += [(tree, level, first + k, digest, size) for k, digest in enumerate(digests)]
    kinds = {"tree": pa.string(), "level": pa.int32(), "pos": pa.int64(), "digest": pa.string(), "size": pa.int64()}
    columns = zip(*out) if out else [[]] * len(kinds)
    return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns)})


def _grow(leaves: DataFrame, rows: int) -> DataFrame:
    """All nodes above (and with) ``leaves``: tree, level, pos, digest, size."""
    kind = f"{NODE}, size long"
    base = leaves.select("tree", F.lit(0).alias("level"), "pos", "digest", "size")
    out, level = base, 0
    while True:
        bucket = _bucket(rows >> (4 * level), PARTITION, STEP)
        grown = base.filter("size > 1").groupBy(bucket.alias("bucket")).applyInArrow(_levels, kind)
        grown = materialise(grown, "nodes")
        out, level = out.unionByName(grown), level + STEP
        base = grown.filter(F.col("level") == level)
        if base.filter("size > 1").limit(1).count() == 0:
            return out


def build(rows: DataFrame, id_col: str, source_col: str, fields: Sequence[str], carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table. ``fields`` enter a leaf in their order; ``carry`` are further columns of the leaves."""
    carry = carry or {}
    leaves = rows.select(
        F.col(id_col).alias("id"), tree_of(F.col(source_col)).alias("tree"), F.col(source_col).cast("string").alias("source"),
        digest_of([F.col(f) for f in fields]).alias("digest"), F.monotonically_increasing_id().alias("_at"), *[c.alias(n) for n, c in carry.items()],
    )
    leaves = materialise(leaves, "leaves")
    shape = profile(leaves, ["tree"])
    # The size that is told makes the numbering use its slices.
    order = [F.col("id").asc_nulls_first(), F.col("digest"), F.col("_at")]
    numbered = number_rows(leaves, ["tree"], order, "pos", Profile(shape.groups, 1 << 62, shape.rows)).withColumn("pos", F.col("pos") - 1)
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("size"), F.first("source").alias("_name"))
    leaves = materialise(attach(numbered.drop("_at"), sizes.drop("_name"), ["tree"], shape.groups), "leaves")
    nodes = _grow(leaves, shape.rows)
    roots = nodes.filter("size = 1").select("tree", F.col("digest").alias("subroot"))
    named = materialise(sizes.join(roots, "tree"), "subroots")
    tops = number_rows(named, [], [F.col("_name").asc_nulls_first()], "top", Profile(1, 1 << 62 if shape.groups > PARTITION else 0, shape.groups))
    tops = tops.withColumn("top", F.col("top") - 1).withColumn("tops", F.lit(shape.groups).cast("long"))
    tops = materialise(tops.drop("_name").withColumnRenamed("size", "n"), "subroots")
    upper = _grow(tops.select(F.lit(TOP).alias("tree"), F.col("top").alias("pos"), F.col("subroot").alias("digest"), F.col("tops").alias("size")), shape.groups)
    root = upper.filter("size = 1").select(F.col("digest").alias("root"), F.lit(1).alias("_one"))
    trees = tops.withColumn("_one", F.lit(1)).join(F.broadcast(root), "_one").drop("_one")
    return Manifest(leaves.drop("size", "source"), nodes.unionByName(upper).drop("size"), materialise(trees, "trees"))


def missing(positions: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Coordinates (level, positions) that together with the nodes at ``positions`` of level 0 give the root of a tree of ``size`` leaves."""
    known, level = np.unique(positions), 0
    while size > 1:
        runs = np.unique(known // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(members[members < size], known, assume_unique=True)
        known, size, level = runs, -(-size // FAN), level + 1


def _needs(wanted: pa.Table) -> pa.Table:
    """What the leaves of one partition lack."""
    trees, positions, sizes = (wanted.column(c).to_pylist() for c in ("tree", "pos", "n"))
    asked: dict[str, tuple[int, list[int]]] = {TOP: (wanted.column("tops")[0].as_py(), wanted.column("top").to_pylist())}
    for tree, pos, n in zip(trees, positions, sizes):
        asked.setdefault(tree, (n, []))[1].append(pos)
    found = [(tree, level, lacking) for tree, (n, at) in asked.items() for level, lacking in missing(np.array(at), n)]
    counts = [len(lacking) for _, _, lacking in found]
    names = np.repeat(np.array([tree for tree, _, _ in found], object), counts)
    levels = np.repeat(np.array([level for _, level, _ in found], np.int32), counts)
    at = np.concatenate([lacking for _, _, lacking in found]) if found else np.zeros(0, np.int64)
    bucket = np.full(len(at), wanted.column("bucket")[0].as_py(), np.int64)
    return pa.table({"bucket": bucket, "tree": pa.array(names, pa.string()), "level": levels, "pos": at})


class _Known:
    """The nodes of one tree that a partition has: fetched ones and those it derives, each once."""

    def __init__(self, size: int, fetched: dict[tuple[int, int], str], leaves: dict[int, str]):
        self.levels, level, at = [], 0, leaves
        while size > 1:
            runs: dict[int, list[str]] = {}
            for run in {p // FAN for p in at}:
                members = range(run * FAN, min(run * FAN + FAN, size))
                runs[run] = [at[p] if p in at else fetched[level, p] for p in members]
            self.levels.append(runs)
            at, size, level = {run: _hash(digests) for run, digests in runs.items()}, -(-size // FAN), level + 1

    def path(self, pos: int) -> Iterator[tuple[list[str], int]]:
        """The run at every level and the place of the leaf's node in it."""
        for runs in self.levels:
            yield runs[pos // FAN], pos % FAN
            pos //= FAN


def _prove(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proofs of the leaves of one partition, given what it lacks."""
    stored: dict[str, dict[tuple[int, int], str]] = {}
    for tree, level, pos, digest in zip(*[fetched.column(c).to_pylist() for c in ("tree", "level", "pos", "digest")]):
        stored.setdefault(tree, {})[level, pos] = digest
    trees, positions, digests, tops = (leaves.column(c).to_pylist() for c in ("tree", "pos", "digest", "top"))
    members: dict[str, list[int]] = {}
    for k, tree in enumerate(trees):
        members.setdefault(tree, []).append(k)
    proof, left, right = [""] * len(trees), [None] * len(trees), [None] * len(trees)
    if trees:
        sizes = leaves.column("n").to_pylist()
        upper = _Known(leaves.column("tops")[0].as_py(), stored.get(TOP, {}), dict(zip(tops, leaves.column("subroot").to_pylist())))
        for tree, rows in members.items():
            own = _Known(sizes[rows[0]], stored.get(tree, {}), {positions[k]: digests[k] for k in rows})
            last = list(upper.path(tops[rows[0]]))
            for k in rows:
                steps = [*own.path(positions[k]), *last]
                proof[k] = "".join(d for run, at in steps for d in (*run[:at], *run[at + 1 :]))
                left[k], right[k] = [at for _, at in steps], [len(run) - at - 1 for run, at in steps]
    out = leaves.drop_columns(INNER).append_column("proof", pa.array(proof, pa.string()))
    for name, counts in (("left", left), ("right", right)):
        out = out.append_column(name, pa.array(counts, pa.list_(pa.int32())))
    return out


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """Proofs of ``wanted`` leaves (rows of ``manifest.leaves``; all by default): their columns but the position, subroot, root,
    ``proof`` (all siblings joined, from the leaf's run up to the root, left to right) and ``left`` and ``right`` (how many of a level's
    siblings stand before and after the node)."""
    wanted = manifest.leaves if wanted is None else wanted
    placed = attach(wanted, manifest.trees, ["tree"])
    placed = placed.withColumn("bucket", _bucket(wanted.count(), PROVED, STEP - 1))
    needs = placed.select("bucket", "tree", "pos", "n", "top", "tops").groupBy("bucket").applyInArrow(_needs, "bucket long, tree string, level int, pos long")
    needs = materialise(needs, "coordinates")
    # Coordinates below a partition's blocks are its own; only the few levels above them are asked for by many.
    levels = needs.select((F.col("tree") == TOP).alias("upper"), "level").distinct()
    asked = manifest.nodes.withColumn("upper", F.col("tree") == TOP).join(F.broadcast(levels), ["upper", "level"]).drop("upper")
    fetched = materialise(attach(needs, asked, ["tree", "level", "pos"], how="inner"), "fetched")
    kept = [f for f in placed.schema.fields if f.name not in INNER]
    more = [T.StructField("proof", T.StringType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("left", "right")]]
    both = placed.groupBy("bucket").cogroup(fetched.groupBy("bucket"))
    return both.applyInArrow(_prove, T.StructType([*kept, *more]))


def fold(proofs: DataFrame, claimed: str, out: str = "folded_root") -> DataFrame:
    """Add the root that the digest in column ``claimed`` leads to with the proof of its row."""
    at = [proofs.columns.index(c) for c in (claimed, "proof", "left", "right")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for digest, proof, left, right in zip(*[batch.column(k).to_pylist() for k in at]):
                start = 0
                for a, b in zip(left, right):
                    middle, end = start + 64 * a, start + 64 * (a + b)
                    digest = _hash((proof[start:middle], digest, proof[middle:end]))
                    start = end
                roots.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, out])
        give_back()

    return proofs.mapInArrow(run, T.StructType([*proofs.schema.fields, T.StructField(out, T.StringType())]))


def tampered_digest(id_col: str, text_col: str, fields: Sequence[str], every: int = 5) -> Column:
    """The leaf digest after A-Z of the text went to lower case, for rows whose id's CRC-32 is a multiple of ``every``, else null."""
    values = [ascii_lower(F.col(f)) if f == text_col else F.col(f) for f in fields]
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, digest_of(values))
