"""Token files against the tokenizers library, token by token."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from heldout.llm import token_files as TF
from heldout.llm.catalog import word_tokenizer
from heldout.plans.storage import scratch_path

SIGNS = [
    *"abzAZ019'!.-_<|> \t\n\x0b\x0c\r\x1c\x1f\x85\xa0HJst", "'s", "'LL", "it's", "'Re", "''d", "'m", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>",
    "é", "é", "́", "İ", "ß", "Σ", "ς", "ΑΣ", "日本", " ", "ǅ", "ŉ", "ȿ", "ɐ", "ſ", "K", "̈́", "½", "²", "Ⅷ", "🤗", "​", "×", "÷", "ª",
    "\x00", "�", "가", "가", "ﬁ", "’s", "ǰ", "H̱", "J̌", "À",
]


def library(texts):
    tool = Tokenizer.from_file(word_tokenizer())
    return [tool.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_library():
    rng = random.Random(11)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(6000)] + ["", "a" * 50_000, "x " * 30_000, "日" * 2000]
    tool = TF.Encoder(word_tokenizer())
    for _ in range(2):
        tool.memory.limit = 100  # generations change between the slices
        found = [np.frombuffer(i, tool.width).tolist() for k in range(0, len(texts), 700) for i in tool.encode(pa.array(texts[k : k + 700])).to_pylist()]
        assert found == library(texts)
    assert [np.frombuffer(i, tool.width).tolist() for i in tool.encode(pa.array(["", "a b"]), 2).to_pylist()] == [[2], [*library(["a b"])[0], 2]]
    assert tool.encode(pa.array([], pa.string())).to_pylist() == []


def token_rows():
    rng = random.Random(7)
    rows = [(rng.randrange(10**6), "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    return rows + [(5, None), (6, ""), (None, "no id"), (7, "Long text, " * 40_000), (8, "same"), (8, "same"), (-1, "first")]


@pytest.mark.parametrize(("length", "file_tokens"), [(2048, 1 << 26), (7, 900)])
def test_files_hold_every_token(spark, length, file_tokens):
    rows = token_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, at long, file int").repartition(3)
    path = scratch_path(spark, "tokens")
    TF.write_tokens(docs, path, word_tokenizer(), 2, length, file_tokens=file_tokens)
    found = sorted(TF.read_documents(spark, path).collect(), key=lambda r: r["start"])
    want = [(d, [*i, 2]) for (d, _), i in zip(rows, library([t for _, t in rows]))]
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found]

    def order(x):
        return (x[0] is not None, x[0] or 0, x[1])

    assert sorted(got, key=order) == sorted(want, key=order)
    assert [g[0] for g in got] == [w[0] for w in sorted(want, key=order)]
    assert [r["start"] for r in found] == np.cumsum([0, *[len(i) for _, i in got]])[:-1].tolist() and all(r["n_tokens"] == len(i) for r, (_, i) in zip(found, got))
    crcs = TF.read_documents(spark, path).selectExpr("crc32(ids) AS c").collect()
    assert sorted(r["c"] for r in crcs) == sorted(zlib.crc32(np.array(i, "<u4").tobytes()) for _, i in got)
    # The sequences, end to end, are the documents; only padding at a file's end has mask 0.
    packed = TF.sequences(spark, path).collect()
    assert all(len(r["ids"]) == len(r["mask"]) == length for r in packed)
    cells = [c for r in packed for c in zip(r["ids"], r["mask"], r["last"])]
    kept = [(i, e) for i, m, e in cells if m]
    assert [i for i, _ in kept] == [i for _, ids in got for i in ids]
    assert [k + 1 for k, (_, e) in enumerate(kept) if e] == np.cumsum([len(i) for _, i in got]).tolist()
    assert all(i == 0 and not e for i, m, e in cells if not m)


def test_sequences_are_views_of_the_file(spark):
    path = scratch_path(spark, "tokens")
    TF.write_tokens(spark.createDataFrame([(1, "a b c " * 5000)], "doc_id long, text string"), path, word_tokenizer(), 2, 16)
    (row,) = spark.read.parquet(f"{path}/index").collect()
    before = pa.total_allocated_bytes()
    stored = TF.TokenFile(f"{path}/files/{row['file']}")
    ids, mask = stored.sequence(600)
    assert pa.total_allocated_bytes() - before < 4096 and not ids.flags.owndata and ids.dtype == np.uint16 and mask.to_pylist() == [True] * 16
    whole = np.concatenate([p.to_numpy() for p in stored.tokens(0, row["n_tokens"])])
    assert whole[9600:9616].tolist() == ids.tolist() and whole.tolist() == [*library(["a b c " * 5000])[0], 2]
    assert stored.reader.schema.field("ids").type.list_size == 16


def test_string_ids_in_order(spark):
    rows = [(i, f"text {k}") for k, i in enumerate(["b", "a", "é", "", None, "😀", "～", "a"] * 9)]
    path = scratch_path(spark, "tokens")
    TF.write_tokens(spark.createDataFrame(rows, "doc_id string, text string").repartition(5), path, word_tokenizer())
    found = [r["doc_id"] for r in sorted(TF.read_documents(spark, path).collect(), key=lambda r: r["start"])]
    assert found == sorted((i for i, _ in rows), key=lambda i: (i is not None, (i or "").encode()))


def test_empty_and_refused(spark, tmp_path):
    path = scratch_path(spark, "tokens")
    TF.write_tokens(spark.createDataFrame([], "doc_id string, text string"), path, word_tokenizer(), 2)
    assert TF.read_documents(spark, path).count() == 0 and TF.sequences(spark, path).count() == 0
    import public_tokenizers

    with pytest.raises((ValueError, KeyError)):
        TF.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
