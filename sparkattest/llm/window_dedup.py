"""Substring deduplication by hashes of every fixed-length word window.

Map side, an Arrow batch at a time: Rabin-Karp hashes of every window of `size` words by
differences of prefix sums. Inside the batch only the earliest occurrence of a hash goes
on; later ones are marked at once, so a passage that a third of all documents share sends
one entry per batch. Entries are dealt to tasks by hash; a task orders its entries by
(hash, document, position) and marks all but the first. A document gathers its marks, and
overlapping marks merge into maximal removal intervals.

Equality is that of 61-bit or wider hashes (56 bits and the bucket number): among n windows one
false pair is expected about every n * n / 2**62.

A document is a doc_id, null being a value, with a text: only rows equal in both count as one, and are then no copies
of each other. Documents are ordered by doc_id, nulls first, and where a doc_id repeats by a hash of the text; ids that are no integers
are ordered by their hash. Null and empty texts have no words and stay as they are. Other
columns pass through. Texts shorter than a window are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import fresh, ids_repeat, own_number, release, stored, tasks
from ._words import Words, binary_column, forget, from_planes, mix, planes, slices

SIZE = 20
HASH_BYTES = 7
MARKED = -1
COLUMNS = ("ids", "ties", "counts", "positions", "hashes")
ENTRIES = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in COLUMNS]])
ENTRIES_DDL = "bucket int, " + ", ".join(f"{c} binary" for c in COLUMNS)
BATCH_WINDOWS = 1_000_000


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; the first does."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _packed(bucket: int, ids: np.ndarray, ties: np.ndarray, positions: np.ndarray, hashes: np.ndarray | None) -> tuple:
    """One row of entries; runs of one document share its id and its tie. Ties that are all zero take no bytes."""
    head = np.flatnonzero(_changes(ids, ties))
    counts = np.diff(np.r_[head, len(ids)])
    return (
        bucket, planes(ids[head].view(np.uint64), 8), planes(ties[head].view(np.uint64), 8) if ties.any() else b"", planes(counts, 4), planes(positions, 4),
        b"" if hashes is None else planes(hashes, HASH_BYTES),
    )


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    """(ids, ties, counts) of the runs; positions and hashes of the windows."""
    n_ids, n = len(row["ids"]) // 8, len(row["positions"]) // 4
    ids = from_planes(np.frombuffer(row["ids"], np.uint8), n_ids, 8).view(np.int64)
    ties = from_planes(np.frombuffer(row["ties"], np.uint8), n_ids, 8).view(np.int64) if row["ties"] else np.zeros(n_ids, np.int64)
    counts = from_planes(np.frombuffer(row["counts"], np.uint8), n_ids, 4).astype(np.int64)
    positions = from_planes(np.frombuffer(row["positions"], np.uint8), n, 4).astype(np.int64)
    hashes = from_planes(np.frombuffer(row["hashes"], np.uint8), n if row["hashes"] else 0, HASH_BYTES)
    return ids, ties, counts, positions, hashes


def _spread(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, tie, position) of every window."""
    ids, ties, counts, positions, _ = _unpacked(row)
    return np.repeat(ids, counts), np.repeat(ties, counts), positions


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *map(binary_column, columns[1:])], schema=ENTRIES)


def first_of_each(hashes: np.ndarray, ids: np.ndarray, positions: np.ndarray, ties: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Masks over the entries: earliest of its hash; and behind the earliest place of its hash.

    A second entry at the very same place, from a repeated row, is neither.
    """
    order = np.argsort(hashes)
    new = _changes(hashes[order])
    first, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    alone = new & np.r_[new[1:], True] if len(order) else new
    first[order[alone]] = True
    rest = order[~alone]
    if len(rest):
        documents = [ids] if ties is None else [ties, ids]
        rest = rest[np.lexsort((positions[rest], *[d[rest] for d in documents], hashes[rest]))]
        head = _changes(hashes[rest])
        lead = rest[np.flatnonzero(head)][np.cumsum(head) - 1]
        first[rest[head]] = True
        later[rest] = positions[rest] != positions[lead]
        for d in documents:
            later[rest] |= d[rest] != d[lead]
    return first, later


class _Held:
    """Windows of several slices or rows: 16 bytes each, documents being numbers."""

    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.runs: list[np.ndarray] = []
        self.positions: list[np.ndarray] = []
        self.documents: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = self.rows = 0

    def add(self, hashes: np.ndarray, rows: np.ndarray, positions: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.runs.append((rows + self.rows).astype(np.int32))
        self.positions.append(positions.astype(np.int32))
        self.documents.append((ids, ties))
        self.count += len(hashes)
        self.rows += len(ids)

    def joined(self) -> tuple[np.ndarray, ...]:
        """(ids, ties) of the documents in order; hashes, documents by their place there, and positions of the windows. Empties this."""
        ids, ties = (np.concatenate(x) for x in zip(*self.documents, strict=True))
        order = np.lexsort((ties, ids))
        ids, ties = ids[order], ties[order]
        new = _changes(ids, ties)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(new) - 1
        whole = []
        for parts in (self.hashes, self.runs, self.positions):
            whole.append(np.concatenate(parts))
            parts.clear()
        hashes, runs, positions = whole
        return ids[new], ties[new], hashes, rank[runs], positions

    def entries(self, buckets: int) -> pa.RecordBatch:
        """Packed entries; documents are compared by their rank among those held."""
        ids, ties, hashes, documents, positions = self.joined()
        first, later = first_of_each(hashes, documents, positions)
        out = []
        if later.any():
            out.append(_packed(MARKED, ids[documents[later]], ties[documents[later]], positions[later], None))
        hashes, documents, positions = hashes[first], documents[first], positions[first]
        bucket = (hashes % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            own = order[edges[b] : edges[b + 1]]
            out.append(_packed(int(b), ids[documents[own]], ties[documents[own]], positions[own], hashes[own] // np.uint64(buckets)))
        return _rows(out)


def _window_entries(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = _Held()
        for batch in batches:
            doc_ids, doc_ties = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for row, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                at, hashes = words.windows(words.hashes(), size)
                if len(at):
                    rows, own = words.rows[at], slice(row, row + len(offsets) - 1)
                    held.add(hashes, rows, at - words.first[rows], doc_ids[own], doc_ties[own])
                if held.count > BATCH_WINDOWS:
                    yield held.entries(buckets)
                    held = _Held()
        if held.count:
            yield held.entries(buckets)

    return run


def _marks(tasks_after: int):
    def dealt(ids: np.ndarray, ties: np.ndarray, positions: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Marks packed for the task that gathers their document."""
        if len(ids):
            to = (mix(ids.view(np.uint64) ^ mix(ties.view(np.uint64))) % np.uint64(tasks_after)).astype(np.int32)
            order = np.lexsort((positions, ties, ids, to))
            edges = np.searchsorted(to[order], np.arange(tasks_after + 1))
            parts = [(int(k), order[edges[k] : edges[k + 1]]) for k in np.flatnonzero(np.diff(edges))]
            yield _rows([_packed(k, ids[own], ties[own], positions[own], None) for k, own in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that start earlier elsewhere, from all entries of a task."""
        forget()
        held: dict[int, _Held] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] == MARKED:
                    yield from dealt(*_spread(row))
                else:
                    ids, ties, counts, positions, hashes = _unpacked(row)
                    held.setdefault(row["bucket"], _Held()).add(hashes, np.repeat(np.arange(len(ids)), counts), positions, ids, ties)
        while held:
            ids, ties, hashes, documents, positions = held.popitem()[1].joined()
            _, later = first_of_each(hashes, documents, positions)
            del hashes
            yield from dealt(ids[documents[later]], ties[documents[later]], positions[later])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tie, starts): one row per document that has marks."""
    held = [_spread(row) for batch in batches for row in batch.to_pylist()]
    if held:
        ids, ties, positions = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((positions, ties, ids))
        ids, ties, positions = ids[order], ties[order], positions[order]
        head = np.flatnonzero(_changes(ids, ties))
        parts = [planes(p, 4) for p in np.split(positions, head[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(ties[head]), binary_column(parts)], names=["id", "tie", "starts"])


def _keys(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """The order of documents: their id, and a tie that is 0 unless a doc_id repeats."""
    own = own_number(docs, doc_id)
    return own, F.xxhash64(F.col(text)) if ids_repeat(docs, own) else F.lit(0).cast("long")


def repeated_windows(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tie, starts): per document the word positions where a window starts that also starts earlier."""
    own, tie = _keys(docs, doc_id, text)
    return _marked(docs.select(own.alias("doc_id"), F.col(text).alias("text"), tie.alias("tie")), size)


def _marked(narrow: DataFrame, size: int) -> DataFrame:
    n = tasks(narrow.sparkSession)
    entries = narrow.mapInArrow(_window_entries(size, n), ENTRIES_DDL)
    by_task = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.hash("ids", "positions"), F.lit(n)))
    marks = entries.repartitionById(n, by_task.cast("int")).mapInArrow(_marks(n), ENTRIES_DDL)
    return marks.repartitionById(n, F.col("bucket")).mapInArrow(_gathered, "id long, tie long, starts binary")


def _removed(starts: bytes | None, size: int, n_words: int) -> np.ndarray:
    """Merged intervals [start, end) of words covered by the marked windows."""
    at = from_planes(np.frombuffer(starts or b"", np.uint8), len(starts or b"") // 4, 4).astype(np.int64)
    at = np.unique(at[at < n_words])
    if not len(at):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(at) > size)
    return np.c_[at[np.r_[0, gap + 1]], np.minimum(at[np.r_[gap, len(at) - 1]] + size, n_words)]


def remove_repeats(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without the words covered by a window that starts earlier.

    Each removed run goes with the white space behind it; a text that loses nothing is
    unchanged. Adds n_words, n_removed and removed_spans (start and end word of each maximal
    run); names that are taken get underscores.
    """
    own, tie = _keys(docs, doc_id, text)
    marks = stored(_marked(docs.select(own.alias("doc_id"), F.col(text).alias("text"), tie.alias("tie")), size))
    release(docs.sparkSession)
    key, mark_tie, starts = fresh(docs, "mark_id"), fresh(docs, "mark_tie"), fresh(docs, "mark_starts")
    found = marks.select(F.col("id").alias(key), F.col("tie").alias(mark_tie), F.col("starts").alias(starts))
    joined = docs.join(found, (own == F.col(key)) & (tie == F.col(mark_tie)), "left").drop(key, mark_tie)
    at, mark_at = docs.columns.index(text), len(docs.columns)
    old = docs.columns
    names = [fresh(docs, n) for n in ("n_words", "n_removed", "removed_spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row, data, offsets in slices(whole.column(at)):
                batch = whole.slice(row, len(offsets) - 1)
                words = Words(data, offsets)
                texts = batch.column(at).to_pylist()
                spans, removed = [], []
                for i, marked in enumerate(batch.column(mark_at).to_pylist()):
                    n = int(words.counts[i])
                    cut = _removed(marked, size, n)
                    spans.append([{"start": int(a), "end": int(b)} for a, b in cut])
                    removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
                    if len(cut):
                        first, at_end = int(words.first[i]), int(offsets[i + 1])
                        kept, place = [], int(offsets[i])
                        for a, b in cut:
                            kept.append(data[place : words.starts[first + a]])
                            place = int(words.starts[first + b]) if b < n else at_end
                        kept.append(data[place:at_end])
                        texts[i] = np.concatenate(kept).tobytes().decode()
                columns = [batch.column(k) for k in range(mark_at)]
                columns[at] = pa.array(texts, columns[at].type)
                span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                added = [pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, span_type)]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*old, *names])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), span), strict=True)]
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
