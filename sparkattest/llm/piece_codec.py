"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised as the vocabulary asks (every space becomes U+2581, one is put in
front) and split into characters. An agenda holds all adjacent symbol pairs whose
concatenation is a piece, best score first and leftmost among equals; the best pair is
merged and its new neighbours join the agenda. Characters outside the vocabulary become
byte pieces. Pieces never hold U+2581 behind another character, nor a line break, so the
agenda runs on each stretch between such cuts, and stretches are remembered per worker in a
table of bounded size.

Inside every Arrow batch each newly met stretch is also encoded by the sentencepiece
library and must agree (`check`).

Nulls and empty texts give an empty id list and an empty decoded text; other columns,
whatever their names, pass through; repeated rows and empty tables need no special case.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._tables import fresh
from ._words import WORKER_CACHES, trim

SPACE = "▁"
REMEMBERED = 600_000
SHORT, NEVER = 48, float("inf")


class Pieces:
    """A merge-type vocabulary read through the sentencepiece library."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.library.vocab_size()
        self.names = [self.library.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if self.library.is_control(i) or self.library.is_unknown(i)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.names) if self.library.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.names) if i not in self.special and not self.library.is_byte(i)}
        self.costs = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("pieces that run across a space or a line break are not supported")
        out = [b""] * n
        for p, i in self.ids.items():
            out[i] = p.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            out[i] = bytes([value])
        self.out = out
        self.known: dict[str, bytes] = {}
        WORKER_CACHES.append(self.known)

    def agenda(self, symbols: str) -> list[int]:
        """Ids of one stretch of normalised text. Few symbols keep their agenda in a list, many in a heap."""
        parts: list[str] = list(symbols)
        n = len(parts)
        if n <= SHORT:
            cost_of = self.costs.get
            agenda = [cost_of(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            while agenda:
                low = min(agenda)
                if low == NEVER:
                    break
                i = agenda.index(low)
                pair = parts[i] = parts[i] + parts.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = cost_of(pair + parts[i + 1], NEVER)
                if i:
                    agenda[i - 1] = cost_of(parts[i - 1] + pair, NEVER)
            return self._ids(parts)
        scores = self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = parts[i] + parts[i + 1]
            if pair in scores:
                heap.append((-scores[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != pair:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = pair + parts[k]
                if right in scores:
                    heapq.heappush(heap, (-scores[right], i, right))
            h = before[i]
            if h >= 0:
                left = parts[h] + pair
                if left in scores:
                    heapq.heappush(heap, (-scores[left], h, left))
        return self._ids([p for p in parts if p])

    def _ids(self, parts: list[str]) -> list[int]:
        ids = list(map(self.ids.get, parts))
        if None not in ids:
            return ids
        out: list[int] = []
        for p, own in zip(parts, ids):
            out += [own] if own is not None else [self.bytes[b] for b in p.encode()]
        return out

    def _stretch(self, key: str) -> bytes:
        """int32 ids of a stretch; its line breaks stand alone."""
        pieces = key.split("\n")
        if len(pieces) == 1:
            return array("i", self.agenda(key)).tobytes()
        line_break = np.array([self.ids["\n"]] if "\n" in self.ids else [self.bytes[10]], "<i4").tobytes()
        known = self.known
        out = []
        for p in pieces:
            got = known.get(p)
            if got is None:
                got = known[p] = array("i", self.agenda(p)).tobytes()
            out.append(got)
        return line_break.join(out)

    def encode_batch(self, texts: list[str | None], check: bool = True, remembered: int = REMEMBERED) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        if len(self.known) > remembered:
            self.known.clear()
        known, new, out = self.known, [], []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if SPACE in text:
                text = text.replace(SPACE, " ")
            words = text.split(" ")
            if "" in words:
                words = _runs(words)
            ids = []
            for w in words:
                key = SPACE + w
                got = known.get(key)
                if got is None:
                    got = known[key] = self._stretch(key)
                    if check and w:  # a lone space has no text that the library would read as one
                        new.append(w)
                ids.append(got)
            out.append(b"".join(ids))
            if len(known) > remembered:
                self._check(new)
                new = []
                known.clear()
        self._check(new)
        return out

    def _check(self, words: list[str]) -> None:
        if not words:
            return
        plain = [w.replace(SPACE, " ") for w in words]
        for w, ids in zip(words, self.library.encode(plain, num_threads=1), strict=True):
            if array("i", ids).tobytes() != self.known[SPACE + w]:
                raise ValueError(f"the library encodes {w!r} differently")

    def decode(self, ids: np.ndarray) -> str:
        """The text of an id list; the space put in front is taken away again."""
        raw = b"".join(map(self.out.__getitem__, ids.tolist()))
        if len(ids) and self.names[ids[0]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _runs(words: list[str]) -> list[str]:
    """Words behind several spaces keep the extra ones as leading U+2581."""
    out, extra = [], 0
    last = len(words) - 1
    for i, w in enumerate(words):
        if w == "" and i != last:
            extra += 1
        else:
            out.append(SPACE * extra + w)
            extra = 0
    return out


_LOADED: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """The vocabulary, loaded once per worker."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def _appended(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


STEP = 512


def encode(df: DataFrame, model: str, text: str = "text", out: str = "token_ids", *, check: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Add the piece ids of a text column as an array of ints; `out` gets underscores if taken.

    A worker remembers the ids of about `remembered` stretches, some 250 bytes each; fewer cost time, not results.
    """
    out = fresh(df, out)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        vocabulary = pieces(model)
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                blobs = vocabulary.encode_batch(batch.column(at).to_pylist(), check, remembered)
                offsets = np.zeros(len(blobs) + 1, np.int32)
                np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(blobs), "<i4"))
                yield _appended(batch, out, pa.ListArray.from_arrays(pa.array(offsets), values))

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the text of an id column; null ids give an empty text."""
    out = fresh(df, out)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        vocabulary = pieces(model)
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                column = batch.column(at)
                values = column.values.to_numpy(zero_copy_only=False)
                edges = column.offsets.to_numpy()
                texts = [vocabulary.decode(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield _appended(batch, out, pa.array(texts, pa.string()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))
