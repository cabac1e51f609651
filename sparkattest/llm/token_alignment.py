"""Alignment of two tokenizers and corpus-wide link counts.

Tokens. Tokenizer A reads a space and the text, B the text (and puts the space in front itself), so both cover the
same bytes. A text counts only if both token sequences spell exactly those bytes.

Groups. In a slice of many texts every token points to the farthest-right token that overlaps it: the one of the
other tokenizer that covers its last byte, if that ends later (at equal ends A's token points to B's, which points to
itself). Successor doubling, `next = next[next]` on the whole array, converges in a logarithm of the longest chain
to the last token of each component. Texts end in a common boundary, so components never cross texts.

Links are all pairs of an A and a B token in one group; they are counted by multiplying occurrences of distinct ids, never
listed pair by pair where a group is large.

Counts. A slice keeps its distinct id pairs once, and per text only places in that list with multiplicities; this
packed table is written once. Texts per pair are counted inside the slice, then summed over slices, so a pair that is in a third
of all texts is one row per slice. Up to `BROADCAST_PAIRS` counts (16 bytes each) go to every task as sorted arrays;
beyond that the slices' pair lists are joined with the counts and gathered by slice.

Null and empty texts and those that are not spelled exactly (for instance ones with U+2581) have no tokens: zeros and an empty digest. Repeated rows
count as often as they occur. Ids may be of any type and come back as they are; other columns are ignored. Empty tables give no
rows. Whole texts are read, of any length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import discard, stored, tasks
from ._words import SPACE

SLICE_BYTES = 1 << 21
BROADCAST_PAIRS = 2_000_000
LARGE = 1 << 16
LONG_RUN = 4096
LETTER = "▁"


class Tokenizers:
    """A: byte-level BPE (json file, and the same vocabulary as ranks); B: pieces."""

    def __init__(self, json_file: str, ranks_file: str, pattern: str, pieces_file: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_file)
        self.whole.encode_special_tokens = True  # their strings inside texts are plain text
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = [self._piece(i) for i in range(self.pieces.vocab_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # an id with what follows it in the description of the groups: inside and at the end of a group
        self.said = [f"{i}{mark}".encode() for n, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for mark in marks]

    def _piece(self, i: int) -> bytes:
        name = self.pieces.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.pieces.is_byte(i) else name.replace(LETTER, " ").encode()

    def a(self, text: str) -> list[int]:
        """Ids of A. The library that works on ranks takes time quadratic in an unbroken run, so texts with a long one go to the other."""
        raw = np.frombuffer(text.encode(), np.uint8)
        breaks = np.flatnonzero(np.r_[True, SPACE[raw], True])
        if np.diff(breaks).max() > LONG_RUN or len(raw) > LONG_RUN and _longest_blank(raw) > LONG_RUN:
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def both(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text that both spell exactly."""
        pieces = iter(self.pieces.encode([t for t in texts if t], num_threads=1))
        out: list = []
        for text in texts:
            if not text:
                out.append(None)
                continue
            a, b = self.a(" " + text), next(pieces)
            raw = (" " + text).encode()
            same = self.fast.decode_bytes(a) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out


def _longest_blank(raw: np.ndarray) -> int:
    return int(np.diff(np.flatnonzero(np.r_[True, ~SPACE[raw], True])).max())


_LOADED: dict[tuple, Tokenizers] = {}


def loaded(files: tuple[str, str, str, str]) -> Tokenizers:
    """The tokenizers, loaded once per worker."""
    if files not in _LOADED:
        _LOADED[files] = Tokenizers(*files)
    return _LOADED[files]


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token, as a number among B's, of the component of every A and every B token.

    Ends are increasing byte offsets of tokens without gaps; both sequences end at the same byte.
    """
    n = len(a_end)
    over_a, over_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)  # who covers my last byte
    successor = np.arange(n + len(b_end))
    successor[:n] = n + over_a  # B's token ends there or later
    later = a_end[over_b] > b_end
    successor[n:][later] = over_b[later]
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return successor[:n] - n, successor[n:] - n
        successor = doubled


def linked_pairs(doc: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, place, times), and the distinct pairs a << 32 | b that places refer to: links of every group by text and pair.

    `doc` is the text of each group; groups are numbered from 0 in token order.
    """
    many_a, many_b = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))
    first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    links = many_a * many_b
    docs, pairs, times = [], [], []
    small = np.flatnonzero(links <= LARGE)
    n = links[small]
    g = np.repeat(small, n)
    inner = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
    docs.append(doc[g])
    pairs.append(a[first_a[g] + inner // many_b[g]] << 32 | b[first_b[g] + inner % many_b[g]])
    times.append(np.ones(len(g), np.int64))
    for g in np.flatnonzero(links > LARGE):  # occurrences of distinct ids, multiplied
        x, nx = np.unique(a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
        docs.append(np.full(len(x) * len(y), doc[g]))
        pairs.append((x[:, None] << 32 | y[None, :]).reshape(-1))
        times.append((nx[:, None] * ny[None, :]).reshape(-1))
    docs, pairs, times = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
    distinct, places = np.unique(pairs, return_inverse=True)
    key = docs * max(len(distinct), 1) + places
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return docs[order[head]], places[order[head]], np.add.reduceat(times[order], head) if len(head) else times, distinct


PACKED = "ids array<{}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, pairs binary, texts binary, sizes binary, places binary, times binary"


def _aligned(files: tuple, id_type: pa.DataType):
    def packed(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        tokens = loaded(files)
        both = tokens.both(texts)
        own = [k for k, t in enumerate(both) if t is not None]
        figures, digests = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
        pairs, sizes, places, times, per_pair = (np.zeros(0, np.int64) for _ in range(5))
        if own:
            a, b = (np.concatenate([both[k][side] for k in own]) for side in (0, 1))
            n_a, n_b = (np.array([len(both[k][side]) for k in own]) for side in (0, 1))
            last_a, last_b = terminals(np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b]))
            ends, group_b = np.unique(last_b, return_inverse=True)
            group_a = np.searchsorted(ends, last_a)
            doc_a, doc_b = np.repeat(np.arange(len(own)), n_a), np.repeat(np.arange(len(own)), n_b)
            doc = doc_b[ends]
            many_a, many_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
            groups = np.bincount(doc, minlength=len(own))
            links = np.zeros(len(own), np.int64)
            np.add.at(links, doc, many_a * many_b)
            figures[:, own] = np.stack([n_a, n_b, groups, links])
            after_a, after_b = np.cumsum(many_a), np.cumsum(many_b)
            # `a1,a2|b1;a3|b2,b3`: the tokens of A, then of B, group by group
            said = np.empty(len(a) + len(b), np.int64)
            at_a, at_b = np.arange(len(a)), np.arange(len(b))
            said[at_a + (after_b - many_b)[group_a]] = 2 * a + (at_a + 1 == after_a[group_a])
            said[at_b + after_a[group_b]] = 2 * (len(tokens.a_size) + b) + (at_b + 1 == after_b[group_b])
            texts_end = np.cumsum(n_a + n_b)
            for k, start, end in zip(own, (texts_end - n_a - n_b).tolist(), texts_end.tolist(), strict=True):
                text = b"".join(map(tokens.said.__getitem__, said[start:end].tolist()))
                digests[k] = hashlib.sha256(text[:-1]).hexdigest()
            docs, places, times, pairs = linked_pairs(doc, group_a, group_b, a, b)
            per_pair = np.bincount(places, minlength=len(pairs))
            sizes = np.zeros(len(texts), np.int64)
            sizes[own] = np.bincount(docs, minlength=len(own))
        if len(sizes) == 0:
            sizes = np.zeros(len(texts), np.int64)
        lists = [pa.array([ids.to_pylist()], pa.list_(id_type)), *(pa.array([row.tolist()], pa.list_(pa.int64())) for row in figures), pa.array([digests], pa.list_(pa.string()))]
        blobs = [pairs.astype("<i8"), per_pair.astype("<i4"), sizes.astype("<i4"), places.astype("<i4"), times.astype("<i8" if len(times) and times.max() >= 2**31 else "<i4")]
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(length.astype(np.int64))
            row = 0
            while row < batch.num_rows:
                before = ends[row - 1] if row else 0
                last = max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), row + 1)
                yield packed(batch.column(0).slice(row, last - row), batch.column(1).slice(row, last - row).to_pylist())
                row = last

    return run


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): texts of a slice that hold the pair."""
    for batch in batches:
        for pairs, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(pairs, "<i8")), pa.array(np.frombuffer(texts, "<i4").astype(np.int64))], names=["pair", "n"]
            )


def _slice_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pair = np.frombuffer(pairs, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), number)), pa.array(np.arange(len(pair), dtype=np.int32)), pa.array(pair)], names=["slice", "at", "pair"])


def _summed(id_type: pa.DataType, counts):
    """Packed slices, with the counts of their pairs, -> one row per text. `counts(row)` gives (n, best) of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                sizes, places = (np.frombuffer(row[c].as_py(), "<i4") for c in ("sizes", "places"))
                raw = row["times"].as_py()
                times = np.frombuffer(raw, "<i8" if len(raw) == 8 * len(places) else "<i4").astype(np.int64)
                n, best = counts(row)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                of_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                np.add.at(of_best, doc, np.where(best[places], times, 0))
                np.add.at(total, doc, n[places] * times)
                lists = [row[c].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.array(of_best), pa.array(total), row["digests"].values],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return run


def align(
    docs: DataFrame, files: tuple[str, str, str, str], doc_id: str = "doc_id", text: str = "text", *, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    `files`: json and rank file of A, its split pattern, and the piece file of B.
    """
    spark = docs.sparkSession
    id_field = docs.schema[doc_id].dataType
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = pa.schema(narrow.limit(0).toArrow().schema).field("doc_id").type
    slices = stored(narrow.mapInArrow(_aligned(files, id_type), PACKED.format(id_field.simpleString())).withColumn("slice", F.monotonically_increasing_id()))
    counts = stored(slices.select("pairs", "texts").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    ranked = counts.join(highest, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    columns = ["ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "sizes", "places", "times"]
    schema = T.StructType([
        T.StructField("doc_id", id_field), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        T.StructField("groups_sha256", T.StringType()),
    ])
    if counts.count() <= broadcast_pairs:
        table = ranked.orderBy("pair").toArrow()  # 17 bytes a pair, at most broadcast_pairs of them
        shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

        def looked_up(row: dict) -> tuple[np.ndarray, np.ndarray]:
            pair, n, best = shared.value
            at = np.searchsorted(pair, np.frombuffer(row["pairs"].as_py(), "<i8"))
            return n[at], best[at].astype(bool)

        return slices.select(*columns).mapInArrow(_summed(id_type, looked_up), schema)
    listed = slices.select("slice", "pairs").mapInArrow(_slice_pairs, "slice long, at int, pair long").join(ranked, "pair")
    gathered = listed.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("found"))  # one list per slice of bounded bytes
    joined = slices.join(gathered, "slice", "left").select(*columns, F.col("found.n").alias("n"), F.col("found.best").alias("best"))

    def joined_in(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.array(row["n"].as_py() or [], np.int64), np.array(row["best"].as_py() or [], bool)

    return joined.mapInArrow(_summed(id_type, joined_in), schema)
