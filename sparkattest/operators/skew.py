"""Joins and ranks that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

HOT_ROWS = 1_000_000
SALTS = 256


def lookup_join(
    left: DataFrame, right: DataFrame, on: list[str], rows: str, *,
    hot_rows: int = HOT_ROWS, salts: int = SALTS,
) -> DataFrame:
    """Left join to a table with one row per key, where `rows` counts left rows per key.

    A key with more than `hot_rows` left rows goes through a broadcast join. There
    are at most N / hot_rows such keys among N rows, so the broadcast side stays
    small however large the input is. Their left rows are spread over `salts`
    values before the shuffle join that serves all other keys.
    """
    payload = [c for c in right.columns if c not in on]
    hot = right.filter(F.col(rows) > hot_rows).select(
        *on, F.struct(*payload).alias("_hot")
    )
    cold = right.filter(F.col(rows) <= hot_rows).select(
        *on, F.lit(0).alias("_salt"), F.struct(*payload).alias("_cold")
    )
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int") + 1
    missing = F.lit(False)
    for k in on:
        missing = missing | F.col(k).isNull()
    # rows without a key match nothing and are spread like those of a hot key
    tagged = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | missing, spread).otherwise(F.lit(0))
    )
    joined = tagged.join(cold, [*on, "_salt"], "left").withColumn(
        "_hit", F.coalesce("_hot", "_cold")
    )
    return joined.select(*[F.col(c) for c in left.columns], *[F.col(f"_hit.{c}").alias(c) for c in payload])


def bucketed_rank(
    df: DataFrame, groups: list[str], bucket: Column, order: list[Column], out: str = "_rank"
) -> DataFrame:
    """Exact 1-based row number within `groups`, without sorting a group in one task.

    `bucket` must grow with the sort order and split large groups into many
    pieces. Rows are numbered inside (group, bucket); the sizes of the earlier
    buckets of the group are added on top.
    """
    tagged = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    sizes = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = tagged.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    same = [local[k].eqNullSafe(offsets[k]) for k in keys]
    joined = local.join(offsets, same, "left")
    return joined.select(
        *[local[c] for c in df.columns], (F.col("_local") + F.col("_before")).alias(out)
    )


def range_rank(
    df: DataFrame, groups: list[str], order: list[Column], row_id: str, out: str = "_rank", *, pieces: int | None = None
) -> DataFrame:
    """Exact 1-based row number within `groups` by `order` and then `row_id`, whatever the distribution.

    The rows' keys are cut into about equal ranges of (groups, order, row_id), so a group that holds all rows, or rows that
    are all equal or NULL in `order`, still spreads over all ranges: the id cuts ties. Ranges are written once,
    because their limits come from a sample. Numbers inside a range start at the first row of the group there; the
    rows of the group in earlier ranges are added. That table has at most one row per range more than there are groups.
    `row_id` must be unique and not NULL.
    """
    spark = df.sparkSession
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{i}" for i in range(len(order))]
    keys = df.select(*groups, *[c.alias(name) for c, name in zip(order, names, strict=True)], F.col(row_id).alias("_id"))
    sort = [F.col(g).asc_nulls_first() for g in groups] + [F.col(c).asc_nulls_first() for c in names] + [F.col("_id").asc()]
    ranges = cut_lineage(keys.repartitionByRange(n, *sort).select(*groups, *names, "_id", F.spark_partition_id().alias("_range")))
    sizes = ranges.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*groups, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in names], "_id")
    local = ranges.select(*groups, "_range", "_id", F.row_number().over(inside).alias("_local"))
    ranked = local.join(_keyed(offsets, [*groups, "_range"]), _same([*groups, "_range"]))
    numbers = ranked.select(F.col("_id").alias("_ranked_id"), (F.col("_local") + F.col("_before")).alias(out))
    return df.join(numbers, F.col(row_id) == F.col("_ranked_id")).drop("_ranked_id")


BINS = 256


def running_totals(
    df: DataFrame, value: str, sums: list[str], groups: list[str], *, descending: bool = False,
) -> DataFrame:
    """Add `upto_<c>` and `all_<c>` for each column: totals up to and with the row's value, and of the group.

    Needs one row per (group, value). Values of a group are cut at BINS quantiles of its distinct values, so far or
    infinite ones do not crowd the others into one bin; only bin totals are summed across a group, and no task sorts a
    whole group.
    """
    cuts = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    limits = _keyed(df.groupBy(*groups).agg(F.array_distinct(F.percentile_approx(value, cuts, 4 * BINS)).alias("_cuts")), groups)
    at = F.size(F.filter("_cuts", lambda cut: cut <= F.col(value)))
    binned = df.join(F.broadcast(limits) if not groups else limits, _same(groups)).select(
        *df.columns, F.coalesce(at, F.lit(0)).cast("int").alias("_bin")
    )
    sign = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    by = W.partitionBy(*[F.col(g) for g in groups]) if groups else W.partitionBy(F.lit(1))
    totals = binned.groupBy(*groups, "_bin").agg(*[F.sum(c).alias(f"_bin_{c}") for c in sums])
    before = by.orderBy(sign("_bin")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumns(
        {f"_before_{c}": F.coalesce(F.sum(f"_bin_{c}").over(before), F.lit(0)) for c in sums}
        | {f"all_{c}": F.sum(f"_bin_{c}").over(by) for c in sums}
    )
    inside = W.partitionBy(*groups, "_bin").orderBy(sign(value)).rowsBetween(W.unboundedPreceding, 0)
    local = binned.withColumns({f"_local_{c}": F.sum(c).over(inside) for c in sums})
    joined = local.join(_keyed(totals, [*groups, "_bin"]), _same([*groups, "_bin"]))
    return joined.select(
        *df.columns, *[(F.col(f"_before_{c}") + F.col(f"_local_{c}")).alias(f"upto_{c}") for c in sums],
        *[F.col(f"all_{c}") for c in sums],
    )


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_key_{k}" for k in keys})


def _same(keys: list[str]) -> Column:
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return match


def hash_order(*cols: Column, seed: int = 42) -> Column:
    """A seeded, engine-independent 32-bit order key: first eight hex digits of SHA-256."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long")


def hash_bucket(key: Column, bits: int = 16) -> Column:
    """High bits of a 32-bit hash key: order-preserving, about equally filled."""
    return F.shiftright(key, 32 - bits)
