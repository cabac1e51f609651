"""Exact highest inner products by pivot-table elimination.

Table. From a sample of `SAMPLE` vectors `PIVOTS` pivots are chosen, each as far as possible from the ones before. One map
over all vectors turns them into integers, computes the distances to all pivots and packs blocks of neighbours
(same nearest pivot). The table of blocks is written once; a row is known by block and place.

Bounds. |d(q, p) - d(x, p)| is at most d(q, x) for every pivot p, and q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so the
largest such difference bounds the product from above without touching the vector.

Search. Blocks are dealt to shards of about `SHARD_ROWS` vectors; the packed queries go to every shard (a stated query
set against all rows, in blocks). In a shard each query orders the candidates by bound and evaluates them in growing
chunks until the next bound is below its k-th best score, ties included. It starts from
the k-th best of its own block. A shard returns at most k candidates a query, and a
window per query keeps the k best; no group is larger than k times the number of shards.

Vectors that are null or hold null or non-finite components take no part. A query sees every row but its own, also
rows that repeat its id or its vector; vectors of another length have no product with it and are no candidates.
Ties go to the smaller id, null ids last. Empty tables give no rows; other columns are ignored.
Components too large for exact products in a long are an error. The sample decides speed only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._tables import discard, stored, tasks
from ._vectors import BLOCK, exact, kept_vectors, packed, sample, unpacked

SAMPLE, PIVOTS = 1000, 32
SHARD_ROWS = 100_000
CHUNK = 64
LAST = np.iinfo(np.int64).max
BLOCKS = "dims int, n int, kind int, ids binary, known binary, asks binary, vectors binary, far binary"
QUERIES = "block long, dims int, n int, kind int, ids binary, places binary, least binary, vectors binary, far binary"
FOUND = "query_block long, query_place int, query_id long, block long, place int, vec_id long, score long"


def distances(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows to all pivots, rounded to float32."""
    a, b = matrix.astype(np.float64), pivots.astype(np.float64)
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def choose_pivots(matrix: np.ndarray, many: int) -> np.ndarray:
    """Rows of the matrix, each farthest from those chosen before; equal vectors are chosen once."""
    chosen = [0]
    near = distances(matrix, matrix[:1])[:, 0]
    while len(chosen) < many and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(matrix, matrix[chosen[-1:]])[:, 0])
        near[chosen] = 0
    return matrix[chosen]


def upper_bounds(q_square: int, q_far: np.ndarray, squares: np.ndarray, far: np.ndarray) -> np.ndarray:
    """No product of the query with a row is above its bound; allows for the rounding of the distances."""
    if not far.shape[1]:
        return np.full(len(squares), np.inf)
    gap = np.abs(far - q_far).max(axis=1).astype(np.float64)
    largest = float(q_far.max(initial=0)) + float(far.max(initial=0)) + math.sqrt(max(q_square, int(squares.max(initial=0))))
    gap = np.maximum(gap - 1e-6 * largest, 0)
    return np.floor((q_square + squares - gap * gap) / 2 + 1e-12 * largest * largest + 1e-6)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _blocks(pivots):
    """Arrow batches of (id, vector, asks) -> packed blocks with their pivot distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, asks = batch.column(0), batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            ids, known = all_ids.fill_null(LAST).to_numpy(), all_ids.is_valid().to_numpy(zero_copy_only=False)
            for rows, matrix in kept_vectors(batch.column(1)):
                dims = matrix.shape[1]
                far = distances(matrix, pivots.value.get(dims, np.zeros((0, dims), np.int64)))
                order = np.lexsort((far.min(axis=1), far.argmin(axis=1))) if far.shape[1] else np.arange(len(rows))
                for start in range(0, len(order), BLOCK):
                    own = order[start : start + BLOCK]
                    blob, kind = packed(matrix[own])
                    r = rows[own]
                    values = [dims, len(own), kind, ids[r].tobytes(), known[r].tobytes(), asks[r].tobytes(), blob, far[own].tobytes()]
                    types = [pa.int32()] * 3 + [pa.binary()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return run


def _queries(k: int):
    """Blocks -> their query rows, each with the k-th best score inside the block as its first limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                asks = np.flatnonzero(np.frombuffer(b["asks"], bool))
                if not len(asks):
                    continue
                x = unpacked(b["vectors"], b["kind"], b["n"], b["dims"])
                y = exact(x, b["dims"], int(np.abs(x).max(initial=0)))
                scores = (y[asks] @ y.T).astype(np.int64)
                least = np.full(len(asks), np.iinfo(np.int64).min)
                if b["n"] > k:
                    scores[np.arange(len(asks)), asks] = np.iinfo(np.int64).min
                    least = np.partition(scores, b["n"] - k, axis=1)[:, b["n"] - k]
                blob, kind = packed(x[asks])
                ids = np.frombuffer(b["ids"], np.int64)[asks]
                far = np.frombuffer(b["far"], np.float32).reshape(b["n"], -1)[asks]
                values = [b["block"], b["dims"], len(asks), kind, ids.tobytes(), asks.astype("<i4").tobytes(), least.tobytes(), blob, far.tobytes()]
                types = [pa.int64()] + [pa.int32()] * 3 + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in QUERIES.split(", ")])

    return run


class _Shard:
    """Candidates of one shard and one vector length."""

    def __init__(self, rows: list[dict]):
        dims = rows[0]["dims"]
        parts = [unpacked(r["vectors"], r["kind"], r["n"], dims) for r in rows]
        self.dims, self.x = dims, np.concatenate(parts)
        self.ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        self.known = np.concatenate([np.frombuffer(r["known"], bool) for r in rows])
        self.block = np.repeat([r["block"] for r in rows], [r["n"] for r in rows])
        self.place = np.concatenate([np.arange(r["n"]) for r in rows])
        self.far = np.concatenate([np.frombuffer(r["far"], np.float32).reshape(r["n"], -1) for r in rows])
        self.squares = (self.x * self.x).sum(axis=1)
        self.largest = int(np.abs(self.x).max(initial=0))
        self.values = exact(self.x, dims, self.largest)
        self.evaluated = 0

    def search(self, query: np.ndarray, q_far: np.ndarray, block: int, place: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best candidates of at least `least`, or fewer."""
        bound = upper_bounds(int((query * query).sum()), q_far, self.squares, self.far)
        bound[(self.block == block) & (self.place == place)] = -np.inf
        alive = np.flatnonzero(bound >= least) if least > np.iinfo(np.int64).min else np.flatnonzero(bound > -np.inf)
        size, at = CHUNK, np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        values = exact(query, self.dims, max(self.largest, int(np.abs(query).max(initial=0))))
        candidates = self.values if values.dtype == np.float64 else self.x
        while len(alive):
            if len(alive) > size:  # the next chunk in bound order, without sorting what may never be needed
                split = np.argpartition(-bound[alive], size)
                chunk, alive = alive[split[:size]], alive[split[size:]]
            else:
                chunk, alive = alive, alive[:0]
            self.evaluated += len(chunk)
            at, scores = np.r_[at, chunk], np.r_[scores, (candidates[chunk] @ values).astype(np.int64)]
            keep = best(scores, self.ids[at], k)
            at, scores = at[keep], scores[keep]
            if len(at) == k:
                least = max(least, int(scores[-1]))
            alive = alive[bound[alive] >= least]
            size *= 4
        good = scores >= least
        return at[good], scores[good]


def _search(k: int):
    """Rows of a task ordered by shard, candidates in front of queries -> the best of each query in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ready = None, {}, {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, held, ready = row["shard"], {}, {}
                if row["part"] == 0:
                    held.setdefault(row["dims"], []).append(row)
                    continue
                dims, n = row["dims"], row["n"]
                if dims not in ready:
                    ready[dims] = _Shard(held.pop(dims)) if dims in held else None
                if ready[dims] is None:
                    continue
                found, x = ready[dims], unpacked(row["vectors"], row["kind"], n, dims)
                far = np.frombuffer(row["far"], np.float32).reshape(n, -1)
                ids, least = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["least"], np.int64)
                for i, place in enumerate(np.frombuffer(row["places"], "<i4").tolist()):
                    at, scores = found.search(x[i], far[i], row["block"], place, int(least[i]), k)
                    for r, s in zip(at.tolist(), scores.tolist(), strict=True):
                        own = int(found.ids[r]) if found.known[r] else None
                        out.append((row["block"], place, int(ids[i]), int(found.block[r]), int(found.place[r]), own, s))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def top_products(
    vectors: DataFrame, asks: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", *,
    pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every row where `asks` holds."""
    spark = vectors.sparkSession
    tables = {m.shape[1]: choose_pivots(m, pivots) for m in sample(vectors, vec_id, vector, SAMPLE)}
    shared = spark.sparkContext.broadcast(tables)  # at most `pivots` vectors a length
    narrow = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), asks.alias("asks"))
    blocks = stored(narrow.mapInArrow(_blocks(shared), BLOCKS).withColumn("block", F.monotonically_increasing_id()))
    rows = blocks.agg(F.sum("n").alias("n")).first()["n"] or 0
    n = tasks(spark)
    shards = max(n, math.ceil(rows / shard_rows))
    queries = blocks.mapInArrow(_queries(k), QUERIES)
    to_all = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    own = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    columns = ["block", "dims", "n", "kind", "ids", "known", "places", "least", "vectors", "far"]
    none = F.lit(None).cast("binary")
    sides = [
        own.withColumns({"places": none, "least": none}).select("shard", F.lit(0).alias("part"), *columns),
        to_all.withColumn("known", none).select("shard", F.lit(1).alias("part"), *columns),
    ]
    dealt = sides[0].union(sides[1]).repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard", "part")
    found = stored(dealt.mapInArrow(_search(k), FOUND))
    discard(blocks)
    order = W.partitionBy("query_block", "query_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "block", "place")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
