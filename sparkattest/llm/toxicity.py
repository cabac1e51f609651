"""Toxicity from bags of subwords.

A word is the bag of its 3 to 7 byte substrings, edges marked, and its whole; each hashes to a row of an embedding
table, and the word's vector is their mean, so an unseen misspelling shares most of its vector
with the word it disguises. The vectors of a segment of `SEGMENT` words are averaged
(short texts as if padded with zero vectors) into a linear softmax; a text scores as its worst segment, because
a few words in a long text are enough (segments of 2 words did best on texts set aside, 32 worst).
Table and softmax are trained jointly in numpy on the driver, by Adagrad, on at most `MAX_ROWS`
labelled texts per label, starting from smoothed log odds of the subwords: in a toxic text the segment
that looks worst so far is the example. A logistic fit on texts set aside turns logits into
probabilities at the labels' own rate.

Scoring is a map over whole texts. Since the softmax is linear, it needs one number per
table row, broadcast once (2**18 numbers, whatever the input).

Null and empty texts score as a segment without words. Rows without a label, or with one other than 0
and 1, teach nothing; several labels of one doc_id count as the largest. Without examples
of both labels the score is the rate of label 1 (0 without any). Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._tables import fresh
from ._words import _BYTE_VALUES, Words, forget, rolling, slices, text_buffers

MAX_ROWS, MAX_BYTES = 2000, 64 << 20
SCORED_BYTES = 1 << 18
SEGMENT, ROWS, WIDTH = 2, 1 << 18, 8
SHORTEST, LONGEST = 3, 7
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.05, 1e-4
SMOOTH, LEAST_TEXTS = 2.0, 4
SEED = 11
_EDGES = np.array([0x1234567089ABCDEF, 0x0FEDCBA987654321], np.uint64)


@dataclass
class Model:
    weights: np.ndarray  # softmax logit difference of each table row
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def probability(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -50, 50)))


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the substrings of each word between edge marks, and how many each word has."""
    length = ends - starts + 2
    word = np.repeat(np.arange(len(starts), dtype=np.int32), length)
    begin = np.cumsum(length) - length
    inner = np.arange(len(word)) - begin[word]
    edge = (inner == 0) | (inner == length[word] - 1)
    source = np.clip(starts[word] + inner - 1, 0, max(len(data) - 1, 0))
    values = np.where(edge, np.where(inner == 0, _EDGES[0], _EDGES[1]), _BYTE_VALUES[data[source]] if len(data) else np.uint64(0))
    owner, rows = [np.arange(len(starts), dtype=np.int32)], [rolling(values, begin, begin + length, "byte") ^ np.uint64(0xA5A5A5A5)]
    for size in range(SHORTEST, LONGEST + 1):
        many = np.maximum(length - size + 1, 0)
        own = np.repeat(np.arange(len(starts), dtype=np.int32), many)
        at = begin[own] + _spread(many)
        owner.append(own)
        rows.append(rolling(values, at, at + size, "byte"))
    owner, rows = np.concatenate(owner), (np.concatenate(rows) % np.uint64(ROWS)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.bincount(owner, minlength=len(starts))


def segments(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start word, end word): runs of SEGMENT words; a shorter rest joins the last run."""
    many = np.maximum(counts // SEGMENT, 1)
    row = np.repeat(np.arange(len(counts)), many)
    number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = first[row] + number * SEGMENT
    end = np.where(number == many[row] - 1, first[row] + counts[row], start + SEGMENT)
    return row, start, end


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[ends] - total[starts]


class _Examples:
    """Distinct words of the labelled texts, their subwords, and the segments as word lists."""

    def __init__(self, texts: pa.Array):
        hashes, lists, counts, segs, base_word, base_row = [], [], [], [], 0, 0
        known: dict[int, int] = {}
        words_of: list[np.ndarray] = []
        for _, data, offsets in slices(texts):
            words = Words(data, offsets)
            h = words.hashes()
            unique, index, inverse = np.unique(h, return_index=True, return_inverse=True)
            number = np.array([known.get(int(x), -1) for x in unique], np.int64)
            new = np.flatnonzero(number < 0)
            number[new] = len(known) + np.arange(len(new))
            known.update(zip(map(int, unique[new]), map(int, number[new]), strict=True))
            rows, many = subwords(words.data, words.starts[index[new]], words.ends[index[new]])
            lists.append(rows)
            counts.append(many)
            words_of.append(number[inverse].astype(np.int32))
            row, start, end = segments(words.first[:-1], words.counts)
            segs.append(np.c_[row + base_row, start + base_word, end + base_word])
            base_word += len(h)
            base_row += len(offsets) - 1
        self.words = np.concatenate(words_of)
        self.rows = np.concatenate(lists)
        self.ends = np.cumsum(np.concatenate(counts))
        self.starts = np.r_[0, self.ends[:-1]]
        segs = np.concatenate(segs)
        self.doc, self.first, self.last = segs[:, 0], segs[:, 1], segs[:, 2]
        self.size = np.maximum(self.last - self.first, SEGMENT)
        self.doc_start = np.flatnonzero(np.r_[True, self.doc[1:] != self.doc[:-1]])

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        word = np.add.reduceat(weights[self.rows], self.starts) / (self.ends - self.starts)
        return SEGMENT * _sums(word[self.words], self.first, self.last) / self.size + bias


    def log_odds(self, labels: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed log odds of each table row by texts that hold it; and which rows enough texts hold."""
        held = np.zeros((2, ROWS))
        ends = np.r_[self.doc_start[1:], len(self.doc)]
        for d in np.flatnonzero(use):
            words = np.unique(self.words[self.first[self.doc_start[d]] : self.last[ends[d] - 1]])
            many = self.ends[words] - self.starts[words]
            held[labels[d], np.unique(self.rows[np.repeat(self.starts[words], many) + _spread(many)])] += 1
        n0, n1 = (max(int((labels[use] == k).sum()), 1) for k in (0, 1))
        expected = (held[0] + held[1]) * n1 / (n0 + n1)  # in toxic texts, if the row said nothing
        odds = np.log((held[1] + SMOOTH) / (expected + SMOOTH))
        return odds, held.sum(axis=0) >= LEAST_TEXTS


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def train(texts: pa.Array, labels: np.ndarray, weights_of_label: tuple[float, float]) -> Model:
    """Fit table and softmax; weights_of_label: how many labelled rows one example of each label stands for."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(ROWS, np.float32), 0.0, 1.0, 0.0, float(labels[0]) if len(labels) else 0.0)
    x = _Examples(texts)
    rng = np.random.default_rng(SEED)
    aside = rng.random(len(labels)) < 0.2
    table = rng.normal(0, 0.01, (ROWS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias, seen, seen_out, seen_bias = np.zeros(2, np.float32), np.full(ROWS, 1e-6, np.float32), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)
    n_segments = np.diff(np.r_[x.doc_start, len(x.doc)])
    # start from smoothed log odds, so that the first worst segments are sensible ones
    direction = out[:, 1] - out[:, 0]
    odds, common = x.log_odds(labels, ~aside)
    table = (table + np.outer(odds, direction / (direction @ direction))).astype(np.float32)
    for epoch in range(EPOCHS):
        logits = x.logits(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))
        order = np.lexsort((-logits, x.doc))
        lead = np.searchsorted(x.doc[order], np.arange(len(labels)))
        second = order[lead + np.minimum(1, n_segments - 1)]
        clean = labels == 0
        chosen = np.r_[order[lead], second[clean], (x.doc_start + rng.integers(0, n_segments))[clean]]
        chosen = chosen[~aside[x.doc[chosen]]]
        chosen = rng.permutation(chosen)
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(chosen), BATCH):
            seg = chosen[at : at + BATCH]
            counts = x.last[seg] - x.first[seg]
            owner = np.repeat(np.arange(len(seg)), counts)
            words, inverse = np.unique(x.words[np.repeat(x.first[seg], counts) + _spread(counts)], return_inverse=True)
            if not len(words):
                continue
            many = x.ends[words] - x.starts[words]
            rows = x.rows[np.repeat(x.starts[words], many) + _spread(many)]
            edges = np.r_[0, np.cumsum(many)[:-1]]
            vectors = np.add.reduceat(table[rows], edges, axis=0) / many[:, None]
            share = (SEGMENT / x.size[seg])[owner]
            mean = np.zeros((len(seg), WIDTH))
            np.add.at(mean, owner, vectors[inverse] * share[:, None])
            scores = mean @ out + bias
            scores -= scores.max(axis=1, keepdims=True)
            p = np.exp(scores)
            p /= p.sum(axis=1, keepdims=True)
            y = labels[x.doc[seg]]
            p[np.arange(len(seg)), y] -= 1
            p /= len(seg)
            to_mean = p @ out.T
            g_out, g_bias = mean.T @ p, p.sum(axis=0)
            to_word = np.zeros((len(words), WIDTH))
            np.add.at(to_word, inverse, to_mean[owner] * share[:, None])
            order = np.argsort(rows, kind="stable")
            head = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
            g = np.add.reduceat(np.repeat(to_word / many[:, None], many, axis=0)[order], head, axis=0)
            own = rows[order][head]
            g = np.where(common[own][:, None], g + DECAY * table[own], 0)
            seen[own] += (g * g).mean(axis=1)
            table[own] -= rate * g / np.sqrt(seen[own])[:, None]
            seen_out += g_out * g_out
            out -= (0.1 * rate * g_out / np.sqrt(seen_out)).astype(np.float32)
            seen_bias += g_bias * g_bias
            bias -= (0.1 * rate * g_bias / np.sqrt(seen_bias)).astype(np.float32)
    weights, base = (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])
    worst = np.maximum.reduceat(x.logits(weights, base), x.doc_start)
    held = aside if len(set(labels[aside].tolist())) == 2 else ~aside
    slope, offset = _calibrated(worst[held], labels[held], np.where(labels[held] == 1, weights_of_label[1], weights_of_label[0]))
    return Model(weights, base, slope, offset)


def _calibrated(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of the label on one logit, by Newton steps with a small ridge."""
    centre, scale = float(np.median(logits)), float(np.std(logits)) or 1.0
    z = np.c_[(logits - centre) / scale, np.ones(len(logits))]
    beta, weight = np.array([1.0, 0.0]), weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (p - labels)) + 0.01 * beta
        curvature = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale)


def fit(
    docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "label",
    max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
) -> Model:
    """Learn from at most `max_rows` texts of each label, chosen by a hash of their doc_id, and in that order from no more than
    `max_bytes` of text. Of several texts of one doc_id the smallest teaches.

    labels holds doc_id and label, by default the documents themselves. Only ids are shuffled for the
    choice; the chosen ones, at most 2 * max_rows, are broadcast to the texts.
    """
    marked = (docs if labels is None else labels).filter(F.col(label).isin(0, 1))
    ids = marked.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    if labels is not None:
        ids = ids.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    ids = ids.filter("doc_id is not null")
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [ids.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.lower(text), F.lit("")).alias("text"))
    chosen = rows.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id")  # over the chosen rows only
    so_far = F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    kept = chosen.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes)
    got = kept.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").toArrow()
    y = got["y"].to_numpy().astype(np.int64)
    per = tuple(counts.get(k, 0) / max(int((y == k).sum()), 1) for k in (0, 1))
    model = train(got["text"].combine_chunks(), y, per) if len(y) else Model(np.zeros(ROWS, np.float32), 0.0, 1.0, 0.0, 0.0)
    if model.constant is not None and sum(counts.values()):
        model.constant = counts.get(1, 0) / sum(counts.values())
    return model


def _lowered(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of `SCORED_BYTES` in lower case, so that only one slice is held twice."""
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, row = np.cumsum(size), 0
    while row < len(size):
        last = max(int(np.searchsorted(ends, ends[row] - size[row] + SCORED_BYTES, "right")), row + 1)
        data, at = text_buffers(pc.utf8_lower(column.slice(row, last - row)))
        yield row, data[at[0] : at[-1]], at - at[0]
        row = last


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 for each whole text; `out` gets underscores if taken."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = fresh(docs, out)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        forget()
        for batch in batches:
            scores = [np.zeros(0)]
            for _, data, offsets in _lowered(batch.column(at)):
                words = Words(data, offsets)
                _, index, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
                rows, many = subwords(words.data, words.starts[index], words.ends[index])
                ends = np.cumsum(many)
                word = _sums(m.weights[rows], ends - many, ends) / np.maximum(many, 1)
                row, start, end = segments(words.first[:-1], words.counts)
                logit = SEGMENT * _sums(word[inverse], start, end) / np.maximum(end - start, SEGMENT) + m.bias
                worst = np.full(len(offsets) - 1, -np.inf)
                np.maximum.at(worst, row, logit)
                scores.append(m.probability(worst))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(run, schema)
