"""Embedding columns as blocks of integer vectors.

A vector is kept if it is not null and holds neither a null nor a non-finite component; each component x
becomes floor(256 * x), x as double. Kept vectors of one length are packed into rows of `BLOCK` vectors, in the smallest
integer type that holds them, so later steps shuffle and read few, large values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
BLOCK = 1024
KINDS = ("<i2", "<i4")


def kept_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, int64 matrix) of the kept vectors, one entry per length."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    bad = np.r_[0, np.cumsum(~(known & np.isfinite(values)))]
    valid &= bad[ends] == bad[ends - size]
    out = []
    for d in np.unique(size[valid]):
        rows = np.flatnonzero(valid & (size == d))
        scaled = np.floor(values[(ends[rows] - d)[:, None] + np.arange(d)] * SCALE)
        if scaled.size and (d + 1) * (2 * np.abs(scaled).max() + 1) ** 2 >= 2.0**63:
            raise ValueError(f"components beyond +-{np.abs(scaled).max() / SCALE:g} have no exact product or distance in a long")
        out.append((rows, scaled.astype(np.int64)))
    return out


def packed(matrix: np.ndarray) -> tuple[bytes, int]:
    """Bytes of an integer matrix and the number of its type in `KINDS`."""
    kind = 0 if not matrix.size or np.abs(matrix).max() < 2**15 else 1
    return np.ascontiguousarray(matrix).astype(KINDS[kind]).tobytes(), kind


def unpacked(blob: bytes, kind: int, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(blob, KINDS[kind]).reshape(n, dims).astype(np.int64)


def exact(matrix: np.ndarray, dims: int, largest: int) -> np.ndarray:
    """As doubles where every sum of `dims` products stays below 2**53, which is faster and still exact."""
    return matrix.astype(np.float64) if dims * (2 * largest + 1) ** 2 < 2**53 else matrix


def sample(vectors: DataFrame, vec_id: str, vector: str, rows: int) -> list[np.ndarray]:
    """Matrices, by length, of the `rows` kept vectors with the smallest hash of id and vector; no more reach the driver."""
    usable = vectors.filter(F.col(vector).isNotNull()).select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    usable = usable.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))))
    got = usable.orderBy(F.xxhash64("id", "v"), "id").limit(rows).toArrow()["v"].combine_chunks()
    return [m for _, m in kept_vectors(got)]
