"""Exact SentencePiece BPE encoding by backtracking, and decoding, for models without text normalisation and with byte fallback.

The library merges neighbouring symbols by score until nothing can be merged. The same ids come from a search over pieces: an Aho-Corasick
automaton gives the longest piece at every position; a piece may follow another only if merging their joined text again gives just these
two; where no piece fits, the last one is taken back, its end is marked in a bitfield of failed positions, and shorter pieces are tried.
Every position fails at most once, so the search is linear in the text.

Texts are cut where no piece has the two neighbouring characters inside, as no merge can cross such a place; that includes every place
before a space. The parts repeat, so each task keeps a bounded table of encoded words. Runs of spaces are merged last and leftmost
first, because their pieces share the lowest score.

The model is a file of the sentencepiece library, loaded once per Python worker from ``path`` (with Spark's files on the workers, or installed
there). Defined cases: null counts as the empty text, which has no ids; a character outside the vocabulary becomes its UTF-8 bytes; U+2581
in a text is a space, as in the library. Order and number of rows, nulls in other columns and extra columns are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.llm.common import give_back, hold

SPACE = "▁"
#: Entries of each of two generations of the tables of one worker: words, parts of words, pairs of pieces.
WORDS, PARTS, PAIRS = 200_000, 150_000, 200_000
#: Longer words are encoded without being remembered.
LONG_WORD = 48
#: Texts of one batch handed back to Spark: bytes.
BATCH_BYTES = 2 << 20


class _Memo(dict):
    """A dict that computes what it lacks. A full one becomes the old generation, and what is met again is moved up from there."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > LONG_WORD:
                return value
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, share: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces, self.scores, self.byte_ids, self.single = {}, {}, {}, {}
        self.text = [""] * size
        self.byte_of: dict[int, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_of[i] = int(piece[1:-1], 16)
                self.byte_ids[self.byte_of[i]] = i
            elif model.is_unknown(i):
                self.text[i] = " ⁇ "
            elif not model.is_control(i):
                self.pieces[piece], self.scores[piece] = i, model.get_score(i)
                self.text[i] = piece.replace(SPACE, " ")
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        probe = "\uff21"  # a letter that common normalisations change
        if model.encode(probe) != [self.pieces[SPACE], *[self.byte_ids[b] for b in probe.encode("utf-8")]]:
            raise ValueError("the model normalises texts or adds no space before them")
        runs = {p for p in self.pieces if set(p) == {SPACE} and len(p) > 1}
        mixed = [p for p in self.pieces if SPACE in p[1:] and p not in runs]
        others = [s for p, s in self.scores.items() if p not in runs and len(p) > 1]
        if mixed or len(set(others)) != len(others) or (runs and others and max(self.scores[p] for p in runs) >= min(others)):
            raise ValueError("the pieces of this model are not of the kind this encoder is made for")
        self.bigrams = {p[k : k + 2] for p in self.pieces if p not in runs for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            if p not in runs:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.prefix: dict[str, str | None] = {}
        self.fits = _Memo(self._fit, int(PAIRS * share))
        self.parts = _Memo(self._encode_part, int(PARTS * share))
        self.words = _Memo(self._encode_word, int(WORDS * share))
        self.stored = {p: np.array([i], np.int32).tobytes() for p, i in self.pieces.items()}
        self.spaces: dict[int, list[int]] = {}
        self.lone = np.array([self.pieces[SPACE]], np.int32).tobytes()
        self.fallback = np.zeros(size, bool)
        self.fallback[list(self.byte_of)] = True

    def _merge(self, text: str) -> list[str]:
        """Merge by score, leftmost first, as the library does."""
        if len(text) <= LONG_WORD:
            return self._merge_short(text)
        symbols, score = list(text), self.scores
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and right[i] < len(symbols):
                joined = symbols[i] + symbols[right[i]]
                if joined in score:
                    heapq.heappush(heap, (-score[joined], i, joined))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if not symbols[i] or right[i] >= len(symbols) or symbols[i] + symbols[right[i]] != joined:
                continue
            j = right[i]
            symbols[i], symbols[j], right[i] = joined, "", right[j]
            if right[j] < len(symbols):
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [s for s in symbols if s]

    def _merge_short(self, text: str) -> list[str]:
        symbols, score, none = list(text), self.scores.get, float("-inf")
        ranks = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = max(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = score(symbols[i] + symbols[i + 1], none)
            if i:
                ranks[i - 1] = score(symbols[i - 1] + symbols[i], none)
        return symbols

    def _fit(self, pair: tuple[str, str]) -> bool:
        """Whether the second piece may follow the first (at the start: "")."""
        last, piece = pair
        return self._merge(last + piece) == ([last, piece] if last else [piece])

    def _shorter(self, piece: str) -> str | None:
        """The longest piece that is a proper prefix of ``piece``."""
        if piece not in self.prefix:
            self.prefix[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.pieces), None)
        return self.prefix[piece]

    def _search(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all pieces."""
        # Matches come by their end, so the last one from a start is its longest.
        longest = {end - n + 1: n for end, n in self.automaton.iter(text)}
        size, fits = len(text), self.fits
        failed, chosen, at, last = 0, [], 0, ""
        piece: str | None = text[: longest[0]]
        while at < size:
            while piece is not None:
                if not (failed and failed >> (at + len(piece)) & 1) and fits[last, piece]:
                    break
                piece = self._shorter(piece)
            if piece is not None:
                chosen.append(piece)
                at += len(piece)
                last, piece = piece, text[at : at + longest[at]] if at < size else None
            else:
                failed |= 1 << at
                piece = chosen.pop()
                at -= len(piece)
                last = chosen[-1] if chosen else ""
        return chosen

    def _encode_part(self, part: str) -> bytes:
        """Ids of a text without inner cutting places."""
        if len(part) > 1:
            return b"".join(map(self.stored.__getitem__, self._search(part)))
        if part in self.stored:
            return self.stored[part]
        return np.array([self.byte_ids[b] for b in part.encode("utf-8")], np.int32).tobytes()

    def _encode_word(self, word: str) -> bytes:
        """Ids of a space and the word after it."""
        text, bigrams = SPACE + word, self.bigrams
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in bigrams]
        if not cuts:
            return self.parts[text]
        return b"".join([self.parts[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)])])

    def _spaces(self, n: int) -> bytes:
        if n not in self.spaces:
            if len(self.spaces) >= 1000:
                self.spaces.clear()
            self.spaces[n] = np.array([self.pieces[p] for p in self._merge(SPACE * n)], np.int32).tobytes()
        return self.spaces[n]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text."""
        if not text:
            return np.zeros(0, np.int32)
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)
        out, waiting = [], 0
        for word in words:
            if not word:
                waiting += 1
                continue
            ids = self.words[word]
            if waiting:
                # A space that did not join its word belongs to the run before it.
                alone = ids[:4] == self.lone
                out.append(self._spaces(waiting + alone))
                ids, waiting = ids[4 * alone :], 0
            out.append(ids)
        if waiting:
            out.append(self._spaces(waiting))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte pieces are joined to characters, the space before the first word is left out."""
        if len(ids) == 0:
            return ""
        marks = self.fallback[ids]
        if not marks.any():
            text = "".join(map(self.text.__getitem__, ids.tolist()))
        else:
            out, kept = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    kept.append(self.byte_of[i])
                    continue
                if kept:
                    out.append(kept.decode("utf-8", "replace"))
                    kept.clear()
                out.append(self.text[i])
            text = "".join(out) + kept.decode("utf-8", "replace")
        return text[1:] if not marks[0] and text.startswith(" ") else text


_codecs: dict[tuple[str, float], Codec] = {}


def codec(path: str, share: float = 1.0) -> Codec:
    """The codec of a model file, made once per process and kept until another operator's task ends in it."""
    if (path, share) not in _codecs:
        _codecs[path, share] = Codec(path, share)
    hold("sentencepiece", _codecs.clear)
    return _codecs[path, share]


def _list_array(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate(arrays) if arrays else np.zeros(0, np.int32))


def _in_batches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have a bounded number of bytes (one row at least); lengths are read without making strings."""
    start, size = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for k, n in enumerate(sizes):
        if size and size + n > BATCH_BYTES:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def encode(
    docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None, share: float = 1.0,
) -> DataFrame:
    """Add the ids of ``text_col`` as ``out`` (array of int) and, if named, the text decoded from them as ``decoded``.

    ``share`` scales the tables of remembered words: less memory of a worker for more time, the same ids.
    """
    clash = {c.lower() for c in docs.columns} & {out.lower(), (decoded or out).lower()}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    at = docs.columns.index(text_col)
    fields = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, share)
        for whole in batches:
            for batch in _in_batches(whole, at):
                ids = [tool.encode(t) for t in batch.column(at).to_pylist()]
                columns = [*batch.columns, _list_array(ids)] + ([pa.array(map(tool.decode, ids), pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out] + ([decoded] if decoded else []))
        give_back("sentencepiece")

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of ``ids_col`` as ``out``; null ids give null."""
    at = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            texts = [None if x is None else tool.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(out, T.StringType())]))


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded", keep: bool = False) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 to an encoded table and drop ids and text, unless they are to be kept."""
    joined = F.array_join(F.col(ids).cast("array<string>"), ",")
    return encoded.select(
        *[c for c in encoded.columns if keep or c not in (ids, decoded)], F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
