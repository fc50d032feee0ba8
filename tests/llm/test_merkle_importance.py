"""The Merkle manifest and importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.llm import importance as IM
from heldout.llm import merkle as ME

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string, pos long, bucket int, level int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree_of(leaves):
    """The root of some digests and every leaf's list of (left siblings, right siblings)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 16 * 16
            path.append((level[run : at[k]], level[at[k] + 1 : run + 16]))
            at[k] //= 16
        level = [sha(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def expected_manifest(rows):
    sources = collections.defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    subroots, paths = {}, {}
    for name in names:
        ordered = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroots[name], of = tree_of([leaf_of(r) for r in ordered])
        for row, path in zip(ordered, of):
            paths.setdefault((row[0], leaf_of(row)), (name, path))
    root, tops = tree_of([subroots[n] for n in names])
    out = {}
    for row in rows:
        name, path = paths[row[0], leaf_of(row)]
        whole = path + tops[names.index(name)]
        out[row[0], leaf_of(row)] = (subroots[name], root, "".join("".join(a) + "".join(b) for a, b in whole))
    return out


def manifest_rows():
    rng = random.Random(2)
    rows = [(k, "hot", "en", 3, f"Text {k} é") for k in range(700)]
    rows += [(1000 + k, rng.choice(["a", "b", "", "é", "Z", "t", "n", None]), None, None if k % 3 else k, None if k % 7 == 0 else "x" * k) for k in range(120)]
    rows += [(2000 + k, f"s{k:03d}", "de", 1, "One") for k in range(40)]
    return rows + [(None, "a", None, None, None), (5000, "lone", "en", 10**6, "Long " * 200_000)]


def docs_frame(spark, rows):
    kind = T.StructType.fromDDL(DOCS)
    return spark.createDataFrame([(*r, *[None] * (len(kind) - len(r))) for r in rows], kind).repartition(4)


def build(docs):
    return ME.build(docs, "doc_id", "source", FIELDS, {"tampered": ME.tampered_digest("doc_id", "text", FIELDS), "given": F.col("doc_id")})


def test_manifest_and_proofs(spark, monkeypatch):
    monkeypatch.setattr(ME, "PROVED", 64)
    monkeypatch.setattr(ME, "PARTITION", 300)
    rows = manifest_rows()
    want, texts = expected_manifest(rows), {r[0]: r for r in rows}
    manifest = build(docs_frame(spark, rows))
    proofs = ME.fold(ME.fold(ME.prove(manifest), "digest", "own_root").withColumn("claimed", F.coalesce("tampered", "digest")), "claimed").collect()
    assert len(proofs) == len(rows)
    for r in proofs:
        assert r["given"] == r["id"]
        assert (r["subroot"], r["root"], r["proof"]) == want[r["id"], r["digest"]] and r["own_root"] == r["root"]
        row = texts[r["id"]]
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        assert (r["tampered"] is not None) == hit
        lowered = hit and row[4] is not None and row[4] != row[4].lower()
        assert (r["folded_root"] == r["root"]) == (not lowered)
    assert {len(r["left"]) for r in proofs} >= {2, 4, 5}


def test_proofs_of_some_leaves_fetch_only_what_is_missing(spark):
    rows = manifest_rows()
    want = expected_manifest(rows)
    manifest = build(docs_frame(spark, rows))
    some = ME.prove(manifest, manifest.leaves.filter("id IS NULL OR id IN (3, 17, 290, 2007)")).collect()
    assert len(some) == 5 and all((r["subroot"], r["root"], r["proof"]) == want[r["id"], r["digest"]] for r in some)


@pytest.mark.parametrize("size", [1, 2, 15, 16, 17, 256, 257, 4096, 4100])
def test_multiproof_is_minimal(size):
    rng = random.Random(size)
    for n in {1, min(3, size), min(40, size), size}:
        positions = np.array(rng.sample(range(size), n))
        given = {(level, int(p)) for level, lacking in ME.missing(positions, size) for p in lacking}
        nodes, width, level = {(0, int(p)) for p in positions}, size, 0
        while width > 1:
            runs = {p // 16 for at, p in nodes if at == level}
            for run in runs:
                members = {(level, p) for p in range(run * 16, min(run * 16 + 16, width))}
                # A node is asked for exactly if it is neither wanted nor derived.
                assert {m for m in members if m not in nodes} == {m for m in members if m in given}
            width, level = -(-width // 16), level + 1
            nodes |= {(level, run) for run in runs}


def test_manifest_of_small_tables(spark):
    one = build(docs_frame(spark, [(7, None, None, None, None)]))
    (r,) = ME.fold(ME.prove(one), "digest").collect()
    assert (r["digest"], r["subroot"], r["root"], r["proof"], r["folded_root"]) == (leaf_of((7, None, None, None, None)),) * 3 + ("", r["digest"])
    assert ME.prove(build(docs_frame(spark, []))).count() == 0
    twice = build(docs_frame(spark, [(1, "a", None, 1, "x")] * 20 + [(1, "a", None, 1, "y")]))
    proofs = ME.fold(ME.prove(twice), "digest").collect()
    assert len(proofs) == 21 and all(r["folded_root"] == r["root"] for r in proofs)


# --- importance resampling ---------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, max_n):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[k : k + n]) for n in range(1, max_n + 1) for k in range(len(words) - n + 1)]


def expected_importance(rows, target, max_n, buckets, percent, min_words):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = collections.Counter(bucket(f) for _, t in rows for f in features(t, max_n)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x, max_n)[1])
    gain = [math.floor(1000 * math.log(((t[k] + 1) * (s.total() + buckets)) / ((s[k] + 1) * (t.total() + buckets)))) for k in range(buckets)]
    out = []
    for d, text in rows:
        words, grams = features(text, max_n)
        weight = sum(gain[bucket(g)] for g in grams)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    eligible = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = eligible[: len(eligible) * percent // 100]
    return out, drawn


def importance_rows():
    rng = random.Random(9)
    words = ["Äpfel", "the", "THE", "a1b2", "日本語", "x" * 31, "x" * 32, "y" * 33, "z" * 5000, "quick", "brown", "Fox", "ſ"]
    gaps = [" ", "  ", ", ", "\n", "\u0000", "-", "_", "@"]
    rows = [(k, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, " ,. "), (503, "one"), (None, "the quick brown fox " * 10), (504, "Very long " * 120_000)]
    return rows + [(600 + k, "same text with more than twenty words " * 5) for k in range(60)] + [(600, "same text with more than twenty words " * 5)]


@pytest.mark.parametrize(("max_n", "buckets", "percent", "min_words"), [(1, 10_000, 10, 20), (3, 97, 50, 0)])
def test_importance(spark, max_n, buckets, percent, min_words):
    rows = importance_rows()
    target = ["The quick brown fox", None, "", "same words, other text", "日本語 日本語"]
    kind = "doc_id long, text string, weight long, _at long, _slice int"
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], kind).repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    found = IM.importance(docs, items, max_n=max_n, buckets=buckets, percent=percent, min_words=min_words).collect()
    want, drawn = expected_importance(rows, target, max_n, buckets, percent, min_words)

    def key(r):
        return tuple(-1 if v is None else v for v in r)

    assert sorted((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in found if r["doc_id"] is not None) == sorted(tuple(r) for r in want if r[0] is not None)
    got = sorted((r["rank"], r["doc_id"], r["score"]) for r in found if r["rank"] is not None)
    assert [g[0] for g in got] == list(range(1, len(drawn) + 1)) and [g[1:] for g in got] == [(r[0], r[4]) for r in drawn]
    texts = IM.resample(docs.drop("weight"), items, max_n=max_n, buckets=buckets, percent=percent, min_words=min_words)
    assert sorted(key((r["rank"], r["doc_id"])) for r in texts.collect()) == sorted(key(g[:2]) for g in got)
    assert set(texts.columns) == {"doc_id", "text", "_at", "_slice", "rank"}


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert IM.importance(none, some).count() == 0
    (r,) = IM.importance(some, none, min_words=1, percent=100).collect()
    assert (r["weight"], r["rank"]) == (2 * math.floor(1000 * math.log(10_002 / (2 * 10_000))), 1)
    with pytest.raises(ValueError):
        IM.weigh(some.withColumn("Weight", F.lit(1)), np.zeros(3, np.int64))


def test_gram_table(monkeypatch):
    rng = random.Random(4)
    grams = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.choice([1, 3, 4, 7, 8, 9, 15, 16, 31, 32, 33, 70]))) for _ in range(4000)]
    grams += [rng.choice(grams) for _ in range(4000)]
    data = np.frombuffer(b"".join(grams) + bytes(8), np.uint8)
    sizes = np.array([len(g) for g in grams])
    starts = np.cumsum(sizes) - sizes
    for weak in (False, True):
        if weak:  # keys that collide: only the bytes tell the n-grams apart
            monkeypatch.setattr(IM.GramTable, "_keys", lambda self: self.sizes.astype(np.uint64) % np.uint64(3))
        table = IM.GramTable(data, starts, sizes, 997)
        if not weak:
            assert [int(k) for k in table.keys] == [xxhash.xxh64_intdigest(g) for g in grams]
        counts = collections.Counter(grams)
        assert len(table.taken) == len(counts)
        for g, slot in zip(grams, table.slots):
            assert grams[table.owner[slot]] == g and table.count[slot] == counts[g] and table.bucket[slot] == zlib.crc32(g) % 997


def test_words_of_sliced_arrays():
    texts = pa.array(["skip", None, "Ab-c", "", "d", "e f"]).slice(1)
    data, starts, ends, owner = IM._words(texts)
    assert [(data[a:b].tobytes(), int(o)) for a, b, o in zip(starts, ends, owner)] == [(b"ab", 1), (b"c", 1), (b"d", 3), (b"e", 4), (b"f", 4)]
