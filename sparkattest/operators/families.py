"""Families of rows linked by any shared value, transitively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import present
from ..session import cut_lineage
from .skew import HOT_ROWS, lookup_join


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def _nearest(edges: DataFrame, hot_rows: int) -> DataFrame:
    """Every edge with the smallest neighbour of its left end."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return lookup_join(edges, low, ["u"], "n", hot_rows=hot_rows)


def _large_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _nearest(both, hot_rows).withColumn("m", F.least("m", "u"))
    return near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    near = _nearest(edges, hot_rows)
    kept = near.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(near.select("u", F.col("m").alias("v"))).distinct()


def link_rows(df: DataFrame, row_id: str, link_columns: list[str]) -> DataFrame:
    """Row id and link value, one row per non-blank link."""
    links = F.array(
        *[
            F.when(present(F.col(c)), F.concat(F.lit(f"{c}="), F.trim(F.col(c).cast("string"))))
            for c in link_columns if c in df.columns
        ]
    )
    return df.select(F.col(row_id).alias("u"), F.explode(F.array_compact(links)).alias("link"))


def connected_families(
    df: DataFrame, row_id: str, link_columns: list[str] = C.LINK_COLUMNS, *, max_rounds: int = 60,
    hot_rows: int = HOT_ROWS, out: str = "family_id",
) -> DataFrame:
    """Add the smallest row id of each row's family.

    Alternating large-star and small-star rounds on a linear number of edges: each
    shared value contributes one edge per row, to its smallest row, and values of a
    single row contribute none. Rounds grow with the logarithm of the family size,
    long chains included. Each round is written to the shared checkpoint folder.
    """
    links = link_rows(df, row_id, link_columns)
    hubs = links.groupBy("link").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hubs = hubs.select("link", "v", "n")
    edges = lookup_join(links, hubs, ["link"], "n", hot_rows=hot_rows)
    edges = cut_lineage(edges.filter(F.col("v").isNotNull() & (F.col("u") > F.col("v"))).select("u", "v").distinct())
    state = _fingerprint(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        edges = cut_lineage(_small_star(_large_star(edges, hot_rows), hot_rows))
        new_state = _fingerprint(edges)
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError(f"families did not converge in {max_rounds} rounds")
    labels = edges.select(F.col("u").alias(row_id), F.col("v").alias("_root"))
    return df.join(labels, row_id, "left").withColumn(out, F.coalesce("_root", row_id)).drop("_root")
