"""Near-duplicates by circulant MinHash, banding and exact Jaccard similarity of word shingles.

Two random permutations of a hashed universe give the whole signature: the first scatters the shingles, the second, shifted circularly by
0, 1, 2, ... places, ranks them; coordinate k is the smallest rank under shift k. 128 coordinates make 32 bands of 4. Two documents at the
threshold 0.75 share no band with probability (1 - 0.75^4)^32, about 5 in a million; no other candidate is left out, and every link is
confirmed on the full shingle sets (64-bit hashes of the shingles).

Large groups are never paired off:

1. Documents with equal sets are one class, combined before the shuffle. Everything further is about classes.
2. Buckets of a band are cut into chunks of about ``CHUNK`` classes by a hash that differs from band to band; equal chunks of several
   bands are one. A task gets the texts of a chunk, compares all of them and returns a spanning forest of the links, not the links.
3. Components of the forest. A bucket of several chunks whose classes are not one component yet is not settled: its classes, with
   all that such buckets connect, are a cluster. The classes outside the cluster's largest component are compared with all of the
   cluster, in blocks of ``BLOCK`` by ``BLOCK``, which covers every pair of every bucket that no chunk held. So the components are those of
   all links between candidates.

Shuffled data grow with the number of classes in buckets, a task holds the texts of one chunk or of two sides of a block, and no link, component or
signature goes to the driver.

Defined cases: null and empty texts, and texts of white space, have the empty set, are linked with nothing and are their own component; fewer
than five words are one shingle; rows that repeat an id and set are one class; a null id is never a component's id unless all ids of it
are null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.llm.common import BROADCAST_IDS, drop_ids, give_back, partitions_for
from heldout.llm.windows import Words
from heldout.plans.storage import materialise

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
UNIVERSE = 1 << 20
CHUNK = 128
BLOCK = 256
#: Shingles of a comparison that are counted at once.
COLUMNS = 1 << 15


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = Words(text, lower=True)
    return np.unique(words.hashes(min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


class Circulant:
    """Signatures from two permutations."""

    def __init__(self, coordinates: int = BANDS * ROWS, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(UNIVERSE).astype(np.int32)
        ranks = rng.permutation(UNIVERSE).astype(np.uint32)
        # Row i holds the ranks of place i under all shifts; it is a view of one array closed to a circle.
        self.ranks = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: coordinates - 1]]), coordinates)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        places = self.scatter[(hashes >> np.uint64(44)).astype(np.int64)]
        parts = [self.ranks[places[k : k + 4096]].min(axis=0) for k in range(0, len(places), 4096)]
        return np.minimum.reduce(parts)


_circulant: list[Circulant] = []


def _class_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per document: id, n (size of its set), cls (128-bit hash of the set) and one key per band."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not _circulant:
            _circulant.append(Circulant())
        for batch in batches:
            out = []
            for t in batch["text"]:
                own = shingles(t)
                if len(own):
                    bands = _circulant[0](own).reshape(BANDS, ROWS)
                    keys = [xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(bands)]
                    out.append((len(own), _class_of(own), np.array(keys, np.uint64).view(np.int64)))
                else:
                    out.append((0, None, None))
            n, cls, keys = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"id": batch["id"], "n": np.array(n, np.int64), "cls": cls, "bands": keys})
            give_back()

    # Identifiers travel as strings: pandas would turn whole numbers with nulls among them into floats.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInPandas(run, "id string, n long, cls binary, bands array<long>")
    return materialise(made.withColumn("id", F.col("id").cast(id_type)), "signed")


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` (edges) to ``node``, ``root`` (smallest node of its component), by alternating large and small stars."""
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialise(now, "edges"), None
    while True:
        shape = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if shape == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = shape
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from incidence matrices over blocks of the shared shingles."""
    everything = np.concatenate(left + right)
    values, where = np.unique(everything, return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    often = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[where]
    owner, where = owner[keep], column[where[keep]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    total = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(where, [start, start + COLUMNS])
        block = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        block[owner[a:b], where[a:b] - start] = 1
        total += np.rint(block[: len(left)] @ block[len(left) :].T).astype(np.int64)
    return total


def _forest(nodes: list[bytes], pairs: np.ndarray, joined: list[tuple[int, int]] = ()) -> list[tuple[bytes, bytes]]:
    """The pairs that join different trees, in order; ``joined`` are pairs known before."""
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in joined:
        parent[root(i)] = root(j)
    out = []
    for i, j in pairs.tolist():
        x, y = root(i), root(j)
        if x != y:
            parent[x] = y
            out.append((nodes[i], nodes[j]))
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    inter = _overlaps(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - inter
    return 100 * inter >= PERCENT * union


def _compare_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within one chunk of classes as a forest."""
    rows = rows.drop_duplicates("cls")
    nodes = rows["cls"].tolist()
    sets = [shingles(t) for t in rows["text"]]
    links = np.argwhere(np.triu(_linked(sets, sets), 1))
    if len(nodes) > CHUNK // 2:
        give_back()
    return pd.DataFrame(_forest(nodes, links), columns=["a", "b"])


def _compare_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the two sides of a block, except inside one component, as a forest."""
    sides = [rows[rows["side"] == k].drop_duplicates("cls") for k in (0, 1)]
    if not len(sides[0]) or not len(sides[1]):
        return pd.DataFrame([], columns=["a", "b"])
    linked = _linked(*[[shingles(t) for t in side["text"]] for side in sides])
    comps = [side["comp"].to_numpy() for side in sides]
    pairs = np.argwhere(linked & (comps[0][:, None] != comps[1][None, :]))
    nodes = [*sides[0]["cls"], *sides[1]["cls"]]
    pairs[:, 1] += len(sides[0])
    give_back()
    return pd.DataFrame(_forest(nodes, pairs), columns=["a", "b"])


def _compare(lists: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Links within the lists of classes, written."""
    each = lists.select(F.xxhash64("list").alias("chunk"), F.explode("list").alias("cls"))
    dealt = each.join(texts, "cls").repartition(parts, "chunk")
    return materialise(dealt.groupBy("chunk").applyInPandas(_compare_chunk, "a binary, b binary"), "links")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``cls`` and the text of its row with the given id, for the classes ``wanted`` (written: cls, id)."""
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    met = rows.join(F.broadcast(wanted) if few else wanted, F.col("_id").eqNullSafe(F.col("id"))).select("cls", "text")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Where rows of one id have different texts, only the row of this class is its text.
        for batch in batches:
            yield batch[[_class_of(shingles(t)) == c for t, c in zip(batch["text"], batch["cls"], strict=True)]]

    return materialise(met.mapInPandas(own, "cls binary, text string"), "texts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept."""
    signed = sign(docs, id_col, text_col)
    classes = signed.filter("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    keyed = classes.select("cls", F.explode("bands").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialise(keyed.join(sizes, "bucket"), "members")
    wanted = members.select("cls").distinct().join(classes.select("cls", "id"), "cls")
    texts = _texts(docs, materialise(wanted, "wanted"), id_col, text_col)

    chunk = F.pmod(F.xxhash64("cls", "bucket"), F.ceil(F.col("size") / CHUNK)).alias("chunk")
    # About CHUNK classes each, so the lists are bounded.
    cut = members.select("bucket", chunk, "cls").groupBy("bucket", "chunk")
    lists = materialise(cut.agg(F.array_sort(F.collect_list("cls")).alias("list")).filter(F.size("list") > 1).select("list").distinct(), "chunks")
    edges = _compare(lists, texts, partitions_for(docs))
    roots = components(edges)

    more = _settle(docs, members.filter(F.col("size") > CHUNK).select("bucket", "cls"), roots, texts)
    if more is not None:
        edges = edges.union(more)
        roots = components(edges)
    placed = signed.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("id", "n", F.coalesce("root", "cls").alias("comp"))
    placed = materialise(placed, "placed")
    first = placed.filter("n > 0").groupBy("comp").agg(F.min("id").alias("first"))
    found = placed.join(first, "comp", "left")
    component = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with each component's id, all its columns. An id of several rows (or null) stays as a whole if one of them stays."""
    found = near_duplicates(docs, id_col, text_col).groupBy(id_col).agg(F.bool_or("kept").alias("kept"))
    gone = found.filter("NOT kept").select(id_col)
    return drop_ids(docs, materialise(gone, "near"), id_col)


def _settle(docs: DataFrame, members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links between components inside buckets of several chunks, or None if each such bucket is one component."""
    named = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", F.coalesce("root", "cls").alias("comp"))
    named = materialise(named, "named")
    open_ = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cls").alias("first")).filter("lo != hi")
    star = materialise(named.join(open_.select("bucket", "first"), "bucket").select("cls", "comp", "first").distinct(), "open")
    if not star.limit(1).count():
        return None
    cluster = components(star.select(F.col("cls").alias("a"), F.col("first").alias("b")))
    nodes = star.select("cls", "comp").distinct().join(cluster.withColumnRenamed("node", "cls"), "cls", "left")
    nodes = materialise(nodes.select("cls", "comp", F.coalesce("root", "cls").alias("cluster")), "nodes")
    weights = nodes.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = weights.groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    main = main.select("cluster", F.col("top.comp").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("rest"))
    sided = nodes.join(main, "cluster")
    blocks_u, blocks_m = F.ceil(F.col("rest") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    place = F.xxhash64("cls")
    left = sided.filter("comp != main").select(
        "cluster", F.pmod(place, blocks_u).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks_m - 1)).alias("j"), F.lit(0).alias("side"), "cls", "comp"
    )
    right = sided.filter("rest > 0").select(
        "cluster", F.explode(F.sequence(F.lit(0), blocks_u - 1)).alias("i"), F.pmod(place, blocks_m).cast("int").alias("j"), F.lit(1).alias("side"), "cls", "comp"
    )
    block = F.xxhash64("cluster", "i", "j").alias("block")
    each = left.unionByName(right).select(block, "side", "cls", "comp")
    dealt = each.join(texts, "cls").repartition(partitions_for(docs), "block")
    return materialise(dealt.groupBy("block").applyInPandas(_compare_block, "a binary, b binary"), "links")
