"""One pass over a table for reports with many sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PAIR = "array<struct<dimension:string,value:string,score:double>>"


def pair(dimension: str, value: Column | None = None, score: Column | None = None, when: Column | None = None) -> Column:
    """What a row adds to a dimension: a text value, a number, or nothing where `when` does not hold."""
    text = F.lit(None).cast("string") if value is None else value.cast("string")
    number = F.lit(None).cast("double") if score is None else score.cast("double")
    one = F.struct(F.lit(dimension).alias("dimension"), text.alias("value"), number.alias("score"))
    return F.array(one) if when is None else F.when(when, F.array(one)).otherwise(F.array().cast(PAIR))


def long_counts(df: DataFrame, pairs: list[Column], by: dict[str, Column] | None = None) -> DataFrame:
    """(by..., dimension, value, score, n): how often each pair occurs.

    Rows become their pairs, are counted map-side and summed in one shuffle; the input is read once. The counts go to the
    shared folder, so every section of a report reads them instead of the input: they have one row per distinct value.
    """
    names = list(by or {})
    long = df.select(*[c.alias(n) for n, c in (by or {}).items()], F.explode(F.concat(*[p.cast(PAIR) for p in pairs])).alias("p")).select(*names, "p.*")
    return cut_lineage(long.groupBy(*names, "dimension", "value", "score").agg(F.count(F.lit(1)).alias("n")))


def mean_of(dimension: str) -> Column:
    """Mean of the numbers of a dimension, from the counts; rows without a number do not count."""
    here = (F.col("dimension") == dimension) & F.col("score").isNotNull()
    return F.try_divide(F.sum(F.when(here, F.col("score") * F.col("n"))), F.sum(F.when(here, F.col("n"))))


def total_of(dimension: str, value: str | None = None) -> Column:
    here = F.col("dimension") == dimension
    return F.coalesce(F.sum(F.when(here if value is None else here & (F.col("value") == value), F.col("n"))), F.lit(0))
