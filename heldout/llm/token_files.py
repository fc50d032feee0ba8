"""Token ids in Arrow files of equal-length sequences, with zero-copy random access.

``write_tokens`` encodes whole texts with a tokenizer of the tokenizers library, puts an end id after each document and packs the ids, in
ascending order of the documents' ids, into sequences of ``LENGTH``. A file is an Arrow IPC file (stream format with a footer) whose batches hold
``ROWS`` sequences each (the last one fewer) in fixed-size lists, uncompressed:

* ``ids``: unsigned, 16 bits wide where the vocabulary allows it, else 32;
* ``mask``: one bit a token, set for tokens and clear for padding (the attention mask);
* ``last``: one bit a token, set for the last token of a document.

Sequence r is row r % ROWS of batch r // ROWS, so a memory-mapped file gives any sequence, or any document, as a view of its buffers
(``TokenFile``). Only the last sequence of a file is padded; a file ends behind the document that fills it.

1. bounds: the ids alone are put into ranges of (document id, written order), and the least of each range go to the driver: as many as files;
2. encoding and writing: a task encodes texts and finds each document's range, the ids (two or four bytes a token) are shuffled to their range, sorted
   there and written to files, and the task returns a row per document (its file, first token, tokens). Spark commits these rows as
   ``index``; a file counts only if the index names it, so what a lost or repeated task leaves behind is never read;
3. reading: tasks take rows of the index and fetch each document from its file.

Texts are cut at ASCII white space, over which no token of this kind of tokenizer reaches, and a chunk of Latin letters, digits and ASCII signs is
cut further into the runs that the tokenizer's own pattern makes. The runs of a batch are interned (the span table of ``importance``), a worker
remembers the ids of runs, and what it has not met yet goes through the library; ids of all occurrences are then gathered by their slots.
``Encoder`` refuses a tokenizer that is not of this kind.

Defined cases: null and empty texts are the end id alone; null ids stand before all others; rows that repeat an id are documents of their own, in
the order in which they were written; special tokens written out in a text become their ids, as in the library; an empty table gives an empty index and no
files. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.llm.common import give_back, hold, partitions_for
from heldout.llm.importance import GramTable

#: Tokens of a sequence, sequences of a batch, tokens after which a file is closed.
LENGTH, ROWS, FILE_TOKENS = 2048, 128, 1 << 26
#: Runs and chunks that a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Longer ones are encoded without being remembered.
LONG_CHUNK = 64
#: Bytes of text encoded together.
BATCH_BYTES = 2 << 20
# How the tokenizer normalises and cuts a text.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Kinds of bytes. Two-byte letters are those from U+00C0 to U+023F: letters in all versions of Unicode, composed, each one letter when lowered.
WHITE, LETTER, DIGIT, SIGN, LEAD, FOLLOW, OTHER = range(7)
KIND = np.full(256, OTHER, np.uint8)
for _first, _last, _kind in (
    (0x09, 0x0D, WHITE), (0x20, 0x20, WHITE), (0x21, 0x2F, SIGN), (0x30, 0x39, DIGIT), (0x3A, 0x40, SIGN), (0x41, 0x5A, LETTER), (0x5B, 0x60, SIGN),
    (0x61, 0x7A, LETTER), (0x7B, 0x7E, SIGN), (0x80, 0xBF, FOLLOW), (0xC3, 0xC8, LEAD),
):
    KIND[_first : _last + 1] = _kind
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class _Spans(GramTable):
    """The span table alone, without counts and buckets."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data, starts, sizes
        self.eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self.keys = self._keys()
        self._intern()


def cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, joined as bytes, as spans that are encoded apart: the bytes (letters of runs lowered), start and size of every span, and
    whether it is a run of the tokenizer's pattern (else a whole chunk, as it is)."""
    n = len(raw)
    kind, low = KIND[raw], LOWER[raw]
    inside = kind != WHITE
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~first
    starts = np.flatnonzero(inside & ~before)
    # The end of a chunk is where its successor's gap begins.
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:] | first[1:]
    ends = np.flatnonzero(inside & after) + 1
    # Bytes that no plain chunk has.
    odd = kind == OTHER
    lead, follow = kind == LEAD, kind == FOLLOW
    odd[1:] |= follow[1:] & ~lead[:-1]
    odd[:1] |= follow[:1]
    pair = (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == 0xC4) & (raw[1:] == 0xB0) | (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    odd[:-1] |= pair
    seen = np.concatenate([[0], np.cumsum(odd)])
    whole = seen[ends] > seen[starts]
    # Runs: a change of kind, and every digit.
    kind[lead | follow] = LETTER
    new = np.zeros(n + 1, bool)
    new[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    new[starts] = True
    # Contractions: an apostrophe that begins a run, and the letters after it, end before the next letter.
    at = np.flatnonzero(new[:n] & (raw == 0x27))
    pad = np.concatenate([np.where(first | ~inside, 0, low), np.zeros(3, np.uint8)])
    c, d = pad[at + 1], pad[at + 2]
    one = np.isin(c, np.frombuffer(b"stmd", np.uint8))
    two = ((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))
    new[at[one | two] + 1] = False
    new[at[one] + 2] = True
    new[at[two] + 3] = True
    new = new[:n] & inside
    # Whole chunks have no inner cuts and keep their letters.
    inner = np.zeros(n + 1, np.int32)
    inner[starts[whole]] += 1
    inner[ends[whole]] -= 1
    kept = np.cumsum(inner[:n]) > 0
    begins = np.zeros(n, bool)
    begins[starts] = True
    new &= ~kept | begins
    low[kept] = raw[kept]
    spans = np.flatnonzero(new)
    # A span ends where the next one of its chunk begins, or with the chunk.
    chunk = np.searchsorted(starts, spans, "right") - 1
    stops = np.concatenate([spans[1:], [n]]) if len(spans) else spans
    stops = np.minimum(stops, ends[chunk])
    return np.concatenate([low, np.zeros(8, np.uint8)]), spans, stops - spans, ~whole[chunk]


class _Memory:
    """A table of two generations: a full one becomes the old one, and what is met again is moved up."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def lacking(self, keys: set) -> list:
        """Those of ``keys`` that are not known; the others are in ``young`` afterwards."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for key in keys.difference(young):
            value = old.get(key)
            if value is None:
                out.append(key)
            else:
                young[key] = value
        return out


class Encoder:
    """Ids of texts by a tokenizer file, as little-endian bytes of ``width``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        steps = form["pre_tokenizer"]["pretokenizers"]
        usual = (
            form["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZER} and steps[0]["pattern"] == {"Regex": PATTERN}
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and form["model"]["end_of_word_suffix"] == "</w>"
            and all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in form["added_tokens"])
        )
        if not usual:
            raise ValueError("the tokenizer is not of the kind that this encoder is made for")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memory = _Memory(REMEMBERED)

    def _library(self, spans: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([s.decode("utf-8") for s in spans], add_special_tokens=False)
        return [np.array(e.ids, self.width).tobytes() for e in found]

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        """Encode runs together: the tokenizer keeps each in one, so that its last id and no other ends a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(runs).decode("utf-8"), add_special_tokens=False).ids, self.width)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(runs):
            return self._library(runs)
        raw, bounds = ids.tobytes(), [0, *(cuts * self.width.itemsize).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _meet(self, spans: list[bytes], runs: set[bytes]) -> dict[bytes, bytes]:
        """Ids of some distinct spans."""
        new, known = self.memory.lacking(set(spans)), self.memory.young
        cut_up, whole = [s for s in new if s in runs], [s for s in new if s not in runs]
        found = list(zip(whole, self._library(whole)))
        for k in range(0, len(cut_up), 1000):
            found += zip(cut_up[k : k + 1000], self._runs(cut_up[k : k + 1000]))
        if all(len(s) <= LONG_CHUNK for s in new):
            known.update(found)
            return known
        known.update((s, i) for s, i in found if len(s) <= LONG_CHUNK)
        return {**known, **dict(found)}

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """The ids of a column of texts (no nulls), each followed by the end id, as a binary column."""
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        data, starts, sizes, run = cut(raw, offsets)
        table = _Spans(data, starts, sizes)
        owners = table.owner[table.taken]
        joined = data.tobytes()
        spans = [joined[a:b] for a, b in zip(starts[owners].tolist(), (starts[owners] + sizes[owners]).tolist())]
        known = self._meet(spans, {s for s, r in zip(spans, run[owners].tolist()) if r})
        parts = [known[s] for s in spans]
        flat = np.frombuffer(b"".join(parts), self.width)
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) // self.width.itemsize
        place = np.zeros(len(table.owner), np.int64)
        place[table.taken] = np.arange(len(spans))
        which = place[table.slots]
        lengths = counts[which]
        # Token t of an occurrence is token t of its span.
        begin = np.cumsum(lengths) - lengths
        source = np.repeat((np.cumsum(counts) - counts)[which] - begin, lengths) + np.arange(lengths.sum())
        owner = np.searchsorted(offsets, starts, "right") - 1
        per_text = np.bincount(owner, lengths, len(texts)).astype(np.int64) + (end_id is not None)
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        ids = np.empty(bounds[-1], self.width)
        if end_id is None:
            ids[:] = flat[source]
        else:
            ids[np.arange(len(source)) + np.repeat(owner, lengths)] = flat[source]
            ids[bounds[1:] - 1] = end_id
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((bounds * self.width.itemsize).astype(np.int32)), pa.py_buffer(ids)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once per process and kept until another operator's task ends in it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    hold("tokenizer", _encoders.clear)
    return _encoders[path]


def _batches_of(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of a column of texts with a bounded number of bytes (one text at least); nulls are empty texts."""
    start, size = 0, 0
    texts = pc.fill_null(column, "")
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > BATCH_BYTES:
            yield texts.slice(start, k - start)
            start, size = k, 0
        size += n
    yield texts.slice(start)


def encode_ids(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, starts: Sequence[tuple] = (),
) -> DataFrame:
    """doc_id, at (the written order), tokens (the ids of each text and the end id, as little-endian bytes of the tokenizer's width) and part: how many
    of ``starts`` (ordered keys of (doc_id, at)) do not stand after the row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("at"), F.col(text_col).alias("tokens"))
    keys = [_key(*start) for start in starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = pa.array([bisect.bisect_right(keys, _key(d, a)) for d, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.int32())
            start = 0
            for texts in _batches_of(batch.column(2)):
                n = len(texts)
                columns = [*batch.slice(start, n).columns[:2], tool.encode(texts, end_id), parts.slice(start, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "tokens", "part"])
                start += n
        give_back("tokenizer")

    kind = [rows.schema["doc_id"], *T.StructType.fromDDL("at long, tokens binary, part int").fields]
    return rows.mapInArrow(run, T.StructType(kind))


def _key(doc_id, at: int) -> tuple:
    """Orders ids with nulls first; strings by their UTF-8 bytes, as Spark does."""
    value = doc_id.encode("utf-8") if isinstance(doc_id, str) else doc_id
    return (0, at) if doc_id is None else (1, value, at)


def range_starts(docs: DataFrame, id_col: str, parts: int) -> list[tuple]:
    """The least (doc_id, at) of each but the first of at most ``parts`` ranges of about equal numbers of documents."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("at"))
    ranged = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "at").withColumn("part", F.spark_partition_id())
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "at")).alias("least")
    found = ranged.groupBy("part").agg(least).orderBy("part").collect()
    return [(r["least"]["doc_id"], r["least"]["at"]) for r in found[1:]]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    if re.match(r"file:", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Writer:
    """Writes one file: full batches as they fill, the padded rest at the end."""

    def __init__(self, system: pafs.FileSystem, path: str, length: int, width: np.dtype):
        self.length, self.width, self.tokens = length, width, 0
        kind = pa.from_numpy_dtype(width)
        kinds = {"ids": kind, "mask": pa.bool_(), "last": pa.bool_()}
        self.schema = pa.schema([(name, pa.list_(pa.field("item", k, False), length)) for name, k in kinds.items()])
        self.sink = system.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.ids, self.lasts, self.held = [], [], 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids):
            last = np.zeros(len(ids), bool)
            last[-1] = True
            self.ids.append(ids)
            self.lasts.append(last)
            self.held += len(ids)
            self.tokens += len(ids)
        if self.held >= self.length * ROWS:
            self._put(self.held // (self.length * ROWS) * ROWS)

    def _put(self, rows: int) -> None:
        ids, lasts = np.concatenate(self.ids), np.concatenate(self.lasts)
        n = min(rows * self.length, len(ids))
        self.ids, self.lasts, self.held = [ids[n:]], [lasts[n:]], len(ids) - n
        pad = rows * self.length - n
        parts = [np.concatenate([x[:n], np.zeros(pad, x.dtype)]) for x in (ids, np.ones(len(ids), bool), lasts)]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(p), type=f.type) for p, f in zip(parts, self.schema)]
        for k in range(0, rows, ROWS):
            self.file.write_batch(pa.RecordBatch.from_arrays([x.slice(k, ROWS) for x in lists], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._put(-(-self.held // self.length))
        self.file.close()
        self.sink.close()


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Write the documents' ids as files below ``path`` (a new folder that all executors share) and their index."""
    starts = range_starts(docs, id_col, partitions_for(docs))
    coded = encode_ids(docs, tokenizer, id_col, text_col, end_id, starts)
    ordered = coded.repartitionById(len(starts) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "at")
    folder = f"{path}/files"
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = file_system(folder)
        width = encoder(tokenizer).width
        part, writer, number, rows = TaskContext.get().partitionId(), None, 0, []
        names = ["doc_id", "part", "number", "file", "first", "n_tokens"]
        for batch in batches:
            found = []
            # The bytes are viewed in place; a writer copies them when it has a batch full.
            for ids in batch.column(2):
                if writer is None:
                    file = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.arrow"
                    writer = _Writer(target, f"{base}/{file}", length, width)
                tokens = np.frombuffer(ids.as_buffer(), width)
                found.append((part, number, file, writer.tokens, len(tokens)))
                writer.add(tokens)
                if writer.tokens >= file_tokens:
                    writer.close()
                    writer, number = None, number + 1
            if found:
                columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))]
                rows.append(pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names))
        if writer is not None:
            writer.close()
        # Rows go out when their files are complete.
        yield from rows
        give_back("tokenizer")

    kind = T.StructType([coded.schema["doc_id"], *T.StructType.fromDDL("part int, number int, file string, first long, n_tokens long").fields])
    ordered.mapInArrow(run, kind).write.parquet(f"{path}/index")


class TokenFile:
    """A memory-mapped file of sequences (read whole where the store has no maps)."""

    def __init__(self, path: str):
        system, place = file_system(path)
        local = isinstance(system, pafs.LocalFileSystem)
        self.source = pa.memory_map(place) if local else system.open_input_file(place)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def _values(self, batch: int, name: str) -> pa.Array:
        return self.reader.get_batch(batch).column(name).flatten()

    def sequence(self, row: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence, views of the file's buffers."""
        ids, mask = (self._values(row // ROWS, c).slice(row % ROWS * self.length, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, first: int, n: int, name: str = "ids") -> Iterator[pa.Array]:
        """A run of tokens (or of a mask) as views, one per batch that it touches."""
        whole = self.length * ROWS
        while n > 0:
            at = first % whole
            piece = self._values(first // whole, name).slice(at, n)
            yield piece
            first, n = first + len(piece), n - len(piece)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document from the files: doc_id, start (tokens of all documents before it), n_tokens, and ids as little-endian unsigned
    32-bit integers in a binary column. A document whose mask does not end where the index says is an error."""
    index = spark.read.parquet(f"{path}/index")
    files = index.groupBy("file", "part", "number").agg(F.sum("n_tokens").alias("held"))
    # One row per file, so few that one task adds them up.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    folder, id_type = f"{path}/files", index.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, TokenFile] = {}
        for batch in batches:
            ids, kept, size = [], 0, 0
            for k, (file, first, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("file", "first", "n_tokens")])):
                if file not in opened:
                    opened.clear()
                    opened[file] = TokenFile(f"{folder}/{file}")
                if n and not next(opened[file].tokens(first + n - 1, 1, "last"))[0].as_py():
                    raise ValueError(f"{file} has no document that ends at token {first + n}")
                ids.append(b"".join(p.to_numpy().astype("<u4").tobytes() for p in opened[file].tokens(first, n)))
                size += len(ids[-1])
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    part = batch.slice(kept, len(ids))
                    columns = [*[part.column(c) for c in ("doc_id", "file", "first", "n_tokens")], pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "first", "n_tokens", "ids"])
                    ids, kept, size = [], k + 1, 0
        give_back("tokenizer")

    kind = T.StructType([id_type, *T.StructType.fromDDL("file string, first long, n_tokens long, ids binary").fields])
    placed = index.select("doc_id", "file", "first", "n_tokens").mapInArrow(run, kind).join(F.broadcast(starts), "file")
    return placed.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """All sequences in order: part, number and row (the place of the file and the sequence in it), ids, mask and last (arrays)."""
    index = spark.read.parquet(f"{path}/index")
    files = index.groupBy("file", "part", "number").agg(F.sum("n_tokens").alias("held"))
    folder = f"{path}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, part, number, held in zip(*[batch.column(c).to_pylist() for c in ("file", "part", "number", "held")]):
                stored = TokenFile(f"{folder}/{file}")
                n = -(-held // stored.length)
                for start in range(0, n, ROWS):
                    some = stored.reader.get_batch(start // ROWS)
                    rows = some.num_rows
                    at = [pa.array([v] * rows, pa.int32()) for v in (part, number)] + [pa.array(range(start, start + rows), pa.int64())]
                    kinds = {"ids": pa.int32(), "mask": pa.bool_(), "last": pa.bool_()}
                    lists = [pa.array(some.column(c).to_pylist(), pa.list_(k)) for c, k in kinds.items()]
                    yield pa.RecordBatch.from_arrays([*at, *lists], names=["part", "number", "row", *kinds])

    return files.mapInArrow(run, "part int, number int, row long, ids array<int>, mask array<boolean>, last array<boolean>").orderBy("part", "number", "row")
