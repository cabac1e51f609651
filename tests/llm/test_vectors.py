"""Pivot search and VA-file clustering: equal to brute force, and their bounds hold."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkattest.llm import _vectors, pivot_search, queries, va_clusters

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, cluster string"


def vector_rows(n=400, dims=64, seed=3):
    """Clustered vectors, a third of them one and the same, with every kind of odd row."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(n // 2)]
    odd = list(rows[3][1])
    rows += [
        (50, rows[50][1]), (50, rows[51][1]), (None, rows[9][1]), (None, rows[9][1]), (5000, None), (5001, [math.nan] + odd[1:]),
        (5050, [math.inf] + odd[1:]), (5002, [None] + odd[1:]), (5100, []), (5101, []), (5150, odd[:5]), (5151, odd[5:10]), (5152, odd[:63]), (-50, odd),
    ]
    return [(i, v, "x", 1, "y") for i, v in rows]


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(x)) for x in v]


def brute_top(rows, every, k):
    """Sorted (query_id, rank, vec_id, score) over all rows."""
    kept = [(i, whole(v)) for i, v, *_ in rows if whole(v) is not None]
    out = []
    for at, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(x, y, strict=True)), i is None, i or 0) for other, (i, y) in enumerate(kept) if other != at and len(x) == len(y)
        )
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("pivots, shard_rows", [(32, 100_000), (3, 40)])
def test_search_against_brute_force(spark, pivots, shard_rows):
    rows = vector_rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pivot_search.top_products(table, F.col("vec_id") % 50 == 0, 5, pivots=pivots, shard_rows=shard_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 50, 5)


def test_search_of_few_rows_and_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pivot_search.top_products(empty, F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], "", 1, ""), (1, [0.5, -1.0], "", 1, ""), (2, None, "", 1, "")], SCHEMA)
    assert [tuple(r) for r in pivot_search.top_products(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 128 - 512 * 256)]
    huge = spark.createDataFrame([(0, [1e30], "", 1, "")], SCHEMA)
    with pytest.raises(Exception, match="no exact product"):
        pivot_search.top_products(huge, F.col("vec_id") % 50 == 0).count()


def test_bounds_hold_and_spare_products():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 90, (20, 16))
    x = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(0, 6, (3000, 16))).astype(np.int64)
    pivots = pivot_search.choose_pivots(x[:500], 32)
    assert len(np.unique(pivots, axis=0)) == 32
    far = pivot_search.distances(x, pivots)
    squares = (x * x).sum(axis=1)
    for q in range(40):
        bound = pivot_search.upper_bounds(int(squares[q]), far[q], squares, far)
        assert (bound >= x @ x[q]).all()
    block = {
        "dims": 16, "n": len(x), "kind": 1, "vectors": x.astype("<i4").tobytes(), "ids": np.arange(len(x)).tobytes(), "known": np.ones(len(x), bool).tobytes(),
        "block": 0, "far": far.tobytes(),
    }
    shard = pivot_search._Shard([block])
    for q in range(40):
        at, scores = shard.search(x[q], far[q], 0, q, np.iinfo(np.int64).min, 5)
        products = x @ x[q]
        products[q] = -(10**9)
        assert sorted(scores.tolist(), reverse=True) == sorted(products.tolist(), reverse=True)[:5]
    assert shard.evaluated < 40 * len(x) / 3  # elimination, not a full scan


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**17 + k), -float(2**17 - 3 * k)], "", 1, "") for k in range(120)]
    got = pivot_search.top_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, got), key=str) == brute_top(rows, 50, 5)


def brute_clusters(rows, clusters, rounds, dims):
    kept = [(i, whole(v)) for i, v, *_ in rows if whole(v) is not None and len(v) == dims]
    keyed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in keyed[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        sides = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), s in zip(kept, sides, strict=True) if s == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    final = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, d, c in final:
        per[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, d, c in final), key=str)


@pytest.mark.parametrize("n, clusters, dims", [(300, 12, 64), (60, 40, 5), (3, 40, 64)])
def test_clusters_against_brute_force(spark, n, clusters, dims):
    rows = [r for r in vector_rows(max(n, 60), max(dims, 64)) if n > 3 or r[0] in (1, 2, 50)]
    rows = [(i, v[:dims] if v and len(v) == 64 else v, *rest) for i, v, *rest in rows]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = va_clusters.cluster(table, clusters, 5, dims)
    got = va_clusters.described(found)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, clusters, 5, dims)


def test_no_vectors_no_clusters(spark):
    assert va_clusters.described(va_clusters.cluster(spark.createDataFrame([], SCHEMA))).count() == 0
    odd = spark.createDataFrame([(1, None, "", 1, ""), (2, [1.0], "", 1, ""), (3, [math.nan] * 64, "", 1, "")], SCHEMA)
    assert va_clusters.described(va_clusters.cluster(odd)).count() == 0


def test_intervals_hold_and_spare_distances():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (12, 64))
    x = np.floor(centres[rng.integers(0, 12, 4000)] + rng.normal(0, 10, (4000, 64))).astype(np.int64)
    cuts = va_clusters.borders(x[:300])
    low, high = np.minimum(x.min(axis=0), cuts[:, 0]), np.maximum(x.max(axis=0), cuts[:, -1])
    centroids = np.floor(centres).astype(np.int64)
    tables = va_clusters.lookup_tables(cuts, low, high, centroids)
    cells = va_clusters.cells_of(x, cuts)
    sums = sum(tables[b][cells[:, b]] for b in range(cells.shape[1]))
    away = ((x[:, None] - centroids) ** 2).sum(axis=2)
    assert (sums[:, :12] <= away).all() and (sums[:, 12:] >= away).all()
    fetched = []
    found, computed = va_clusters.assign(cells, lambda rows: fetched.append(len(rows)) or x[rows], tables, centroids)
    assert (found == away.argmin(axis=1)).all()
    assert sum(fetched) < len(x) / 2 and computed < away.size / 10


def test_kept_vectors_and_packing():
    import pyarrow as pa

    column = pa.array([[0.5, -0.001], None, [1.0, None], [float("nan"), 1.0], [], [-1.0, 2.0]], pa.list_(pa.float32()))
    got = dict((m.shape[1], (rows.tolist(), m.tolist())) for rows, m in _vectors.kept_vectors(column))
    assert got == {0: ([4], [[]]), 2: ([0, 5], [[128, -1], [-256, 512]])}
    got = dict((m.shape[1], rows.tolist()) for rows, m in _vectors.kept_vectors(column.slice(4)))
    assert got == {0: [0], 2: [1]}
    for top in (2**15 - 1, 2**20):
        m = np.array([[top, -top], [0, 1]])
        assert (_vectors.unpacked(*_vectors.packed(m), 2, 2) == m).all()


def test_registered_queries(spark, tmp_path):
    rows = vector_rows(150)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, queries.op11_pivot_search(spark, str(tmp_path)).collect()), key=str) == brute_top(rows, 50, 5)
    assert sorted(map(tuple, queries.op13_va_clusters(spark, str(tmp_path)).collect()), key=str) == brute_clusters(rows, 40, 5, 64)
