"""Centroid clustering over a VA-file.

File. One map over all vectors turns them into integers and packs blocks of `BLOCK` vectors: the vectors themselves and, beside
them, one cell of four bits per component. Cell borders are quantiles of a sample of `SAMPLE` vectors; the outer
cells end at the smallest and largest component of the whole table, found by an aggregate. The borders
decide speed only.

Assignment. Each round makes lookup tables from the centroids: for two components at a time, the least and largest
squared distance of their cells to every centroid. Their sums give an interval per vector and centroid; only
centroids whose least distance is not above the smallest of the largest distances stay. With one left the vector is
assigned without being looked at; otherwise its exact distances to those left decide, ties to the smaller
centroid number.

Update. Each task adds up its vectors by cluster; the sums of at most `clusters` rows a task meet in a partial aggregate, and
`clusters` rows reach the driver. A centroid becomes the componentwise floor(sum / count); an empty one
stays. Nothing is shuffled but these sums, so equal vectors, however many, cost the same as others.

Vectors of another length than `dims`, null ones and those with null or non-finite components are left out. Initial
centroids are the vectors with the smallest SHA-256 of `2:<id>`, equal hashes by vector; null ids come last. With
fewer vectors than clusters each vector is a centroid; empty tables give no rows. Repeated rows count as often as
they occur. Components too large for exact distances in a long are an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import discard, stored
from ._vectors import BLOCK, SCALE, kept_vectors, packed, sample, unpacked

CLUSTERS, ROUNDS, DIMS = 40, 5, 64
SAMPLE = 2000
CELLS = 16
FILE = "n int, kind int, ids binary, known binary, vectors binary, cells binary, low array<long>, high array<long>"


def borders(matrix: np.ndarray) -> np.ndarray:
    """First value of cells 1 .. CELLS-1 of each component, (dims, CELLS - 1)."""
    cuts = np.quantile(matrix, np.arange(1, CELLS) / CELLS, axis=0, method="higher").T if len(matrix) else np.zeros((matrix.shape[1], CELLS - 1))
    return np.ascontiguousarray(cuts.astype(np.int64))


def cells_of(matrix: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Two cells a byte, (rows, ceil(dims / 2))."""
    cell = np.zeros((len(matrix), -(-matrix.shape[1] // 2) * 2), np.uint8)
    for d in range(matrix.shape[1]):
        cell[:, d] = np.searchsorted(cuts[d], matrix[:, d], "right")
    return cell[:, ::2] << 4 | cell[:, 1::2]


def lookup_tables(cuts: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(byte, value, 2 * centroids): least, then largest squared distance of two cells to each centroid."""
    first = np.c_[low, cuts]
    last = np.c_[cuts - 1, high]
    inside = np.maximum(first, np.minimum(last, centroids[:, :, None]))  # (centroid, dim, cell)
    least = np.where(first <= last, (inside - centroids[:, :, None]) ** 2, 0)
    largest = np.maximum((first - centroids[:, :, None]) ** 2, (last - centroids[:, :, None]) ** 2)
    both = np.concatenate([least, largest]).transpose(1, 2, 0)  # (dim, cell, 2 * centroids)
    if len(both) % 2:
        both = np.concatenate([both, np.zeros_like(both[:1])])
    pairs = both[::2][:, :, None, :] + both[1::2][:, None, :, :]
    return pairs.reshape(len(pairs), CELLS * CELLS, -1)


def assign(cells: np.ndarray, vectors, tables: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Nearest centroid of each row, and how many exact distances that took; `vectors(rows)` fetches rows."""
    k = len(centroids)
    sums = np.zeros((len(cells), 2 * k), np.int64)
    for b in range(cells.shape[1]):
        sums += tables[b][cells[:, b]]
    open_ = sums[:, :k] <= sums[:, k:].min(axis=1)[:, None]
    found = open_.argmax(axis=1)
    unsure = np.flatnonzero(open_.sum(axis=1) > 1)
    if not len(unsure):
        return found, 0
    row, centroid = np.nonzero(open_[unsure])
    away = vectors(unsure)[row] - centroids[centroid]
    away = np.einsum("ij,ij->i", away, away)
    order = np.lexsort((centroid, away, row))
    head = order[np.r_[True, row[order][1:] != row[order][:-1]]]
    found[unsure] = centroid[head]
    return found, len(row)


def _file(dims: int, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for rows, matrix in kept_vectors(batch.column(1)):
                if matrix.shape[1] != dims:
                    continue
                for start in range(0, len(rows), BLOCK):
                    r, x = rows[start : start + BLOCK], matrix[start : start + BLOCK]
                    blob, kind = packed(x)
                    values = [len(r), kind, ids[r].tobytes(), known[r].tobytes(), blob, cells_of(x, cuts).tobytes(), x.min(axis=0), x.max(axis=0)]
                    types = [pa.int32()] * 2 + [pa.binary()] * 4 + [pa.list_(pa.int64())] * 2
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in FILE.split(", ")])

    return run


def _assigned(batches: Iterator[pa.RecordBatch], dims: int, tables: np.ndarray, centroids: np.ndarray):
    """(block, vectors, cluster) of every block."""
    for batch in batches:
        for b in batch.to_pylist():
            x = unpacked(b["vectors"], b["kind"], b["n"], dims)
            cells = np.frombuffer(b["cells"], np.uint8).reshape(b["n"], -1)
            yield b, x, assign(cells, x.__getitem__, tables, centroids)[0]


def _sums(dims: int, shared):
    """One row per cluster and task: number of vectors and sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, centroids = shared.value
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for _, x, cluster in _assigned(batches, dims, tables, centroids):
            order = np.argsort(cluster, kind="stable")
            head = np.flatnonzero(np.r_[True, cluster[order][1:] != cluster[order][:-1]])
            total[cluster[order][head]] += np.add.reduceat(x[order], head, axis=0)
            count += np.bincount(cluster, minlength=len(centroids))
        at = np.flatnonzero(count)
        columns = [pa.array(at.astype(np.int32)), pa.array(count[at]), *[pa.array(total[at, d]) for d in range(dims)]]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *[f"s{d}" for d in range(dims)]])

    return run


def _members(dims: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, centroids = shared.value
        for b, x, cluster in _assigned(batches, dims, tables, centroids):
            away = x - centroids[cluster]
            ids = pa.array(np.frombuffer(b["ids"], np.int64), mask=~np.frombuffer(b["known"], bool))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(np.einsum("ij,ij->i", away, away))], names=["vec_id", "cluster", "distance"]
            )

    return run


def _first_centroids(vectors: DataFrame, clusters: int, dims: int, vec_id: str, vector: str) -> np.ndarray:
    """At most `clusters` integer vectors, in order of their hash."""
    v = F.col("v")
    kept = vectors.select(F.sha2(F.concat(F.lit("2:"), F.col(vec_id).cast("string")), 256).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    kept = kept.filter((F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))))
    whole = kept.select("h", F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))
    rows = whole.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dims)


class Clusters:
    """members: (vec_id, cluster, distance); centroids: integer matrix; inertia of each cluster."""

    def __init__(self, members: DataFrame, centroids: np.ndarray, inertia: list[int]):
        self.members, self.centroids, self.inertia = members, centroids, inertia


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, vec_id: str = "vec_id", vector: str = "embedding"
) -> Clusters:
    """Assign every kept vector after `rounds` updates of the centroids."""
    spark = vectors.sparkSession
    centroids = _first_centroids(vectors, clusters, dims, vec_id, vector)
    fitted = [m for m in sample(vectors.filter(F.size(vector) == dims), vec_id, vector, SAMPLE) if m.shape[1] == dims]
    cuts = borders(fitted[0] if fitted else np.zeros((0, dims)))
    narrow = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    file = stored(narrow.mapInArrow(_file(dims, cuts), FILE))
    if not len(centroids):
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, [])
    ends = {
        c: {r["at"]: r["x"] for r in file.select(F.posexplode(c).alias("at", "x")).groupBy("at").agg(pick("x").alias("x")).collect()}  # dims rows
        for c, pick in (("low", F.min), ("high", F.max))
    }
    # an outer border from the sample may lie beyond no vector at all
    low = np.minimum([ends["low"][d] for d in range(dims)], cuts[:, 0])
    high = np.maximum([ends["high"][d] for d in range(dims)], cuts[:, -1])
    schema = "cluster int, n long, " + ", ".join(f"s{d} long" for d in range(dims))
    read = file.select("n", "kind", "vectors", "cells")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((lookup_tables(cuts, low, high, centroids), centroids))
        sums = read.mapInArrow(_sums(dims, shared), schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(dims)])
        moved = centroids.copy()
        for r in sums.collect():  # one row per cluster
            moved[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
        centroids = moved
        shared.unpersist()
    shared = spark.sparkContext.broadcast((lookup_tables(cuts, low, high, centroids), centroids))
    members = stored(file.select("n", "kind", "ids", "known", "vectors", "cells").mapInArrow(_members(dims, shared), "vec_id long, cluster int, distance long"))
    discard(file)
    inertia = [0] * len(centroids)
    for r in members.groupBy("cluster").agg(F.sum("distance").alias("d")).collect():  # one row per cluster
        inertia[r["cluster"]] = r["d"]
    return Clusters(members, centroids, inertia)


def described(found: Clusters) -> DataFrame:
    """The members with cluster_inertia, inertia and centroid_sha256."""
    spark = found.members.sparkSession
    rows = [
        (c, inertia, hashlib.sha256(",".join(map(str, found.centroids[c].tolist())).encode()).hexdigest()) for c, inertia in enumerate(found.inertia)
    ]
    schema = T.StructType([
        T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())
    ])
    about = F.broadcast(spark.createDataFrame(rows, schema))  # one row per cluster
    total = F.lit(sum(found.inertia)).cast("long").alias("inertia")
    return found.members.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total, "centroid_sha256")
