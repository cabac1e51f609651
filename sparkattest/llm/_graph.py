"""Connected components over an edge table, in linear-size rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.families import _fingerprint, _large_star, _small_star
from ..operators.skew import HOT_ROWS
from ._tables import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every end of the undirected edges (u, v); root is the smallest id reachable.

    Alternating large-star and small-star rounds; each is written to the shared folder. No
    link or label passes through the driver.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = stored(edges.filter(F.col("u") != F.col("v")).select(high, low).distinct())
    state = _fingerprint(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        edges = stored(_small_star(_large_star(edges, HOT_ROWS), HOT_ROWS))
        new_state = _fingerprint(edges)
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")
    hubs = edges.select("v").distinct().join(edges.select("u"), F.col("v") == F.col("u"), "left_anti")
    return roots.union(hubs.select("v", "v"))
