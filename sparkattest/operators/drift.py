"""Distribution drift between a stored baseline and current data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from ..session import cut_lineage
from .counters import long_counts, mean_of, pair
from .history import distribution_pairs, stored_completeness
from .skew import running_totals

# Dimensions whose drift raises the alarm.
ALARM_DIMENSIONS = ["prediction", "review_status", "certificate_type", "issuer"]


def nearest_rank(df: DataFrame, value: str, share: float, groups: list[str] | None = None) -> DataFrame:
    """Exact nearest-rank percentile of the stored values: the element at floor(share * (n - 1))."""
    keys = groups or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return _ranked(counted, keys, share)


def _ranked(counted: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Nearest-rank percentile from one row (keys, _v, _n) per distinct value."""
    running = running_totals(counted, "_v", ["_n"], keys)
    position = F.floor(F.lit(share) * (F.col("all__n") - 1))
    hit = running.filter((F.col("upto__n") > position) & (F.col("upto__n") - F.col("_n") <= position))
    return hit.select(*keys, F.col("_v").alias("percentile"))


def snapshots(df: DataFrame, period: Column) -> DataFrame:
    """Tidy snapshots (period, kind, item, value) of every period: five count distributions and the scalar moments.

    The rows are read once, whatever the number of periods; the sections come from their counts.
    """
    ok = F.col("prediction") != "error"
    text_pairs = F.transform(
        distribution_pairs(), lambda p: F.struct(p["dimension"].alias("dimension"), p["value"].alias("value"), F.lit(None).cast("double").alias("score"))
    )
    counts = long_counts(
        df, [text_pairs, pair("_risk", score=F.col("risk_score"), when=ok), pair("_complete", score=stored_completeness(F.col("extracted_info")), when=ok)],
        {"period": period},
    )
    sizes = counts.filter(~F.col("dimension").startswith("_")).select(
        "period", F.col("dimension").alias("kind"), F.col("value").alias("item"), F.col("n").cast("double").alias("value")
    )
    moments = counts.groupBy("period").agg(
        *[F.coalesce(F.round(mean_of(d), 4), F.lit(0.0)).alias(c) for d, c in (("_risk", "risk_mean"), ("_complete", "mean_completeness"))]
    )
    scalars = moments.select(
        "period", F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in ("risk_mean", "mean_completeness")])).alias("p"),
    ).select("period", F.lit("scalar").alias("kind"), "p.item", "p.value")
    risks = counts.filter((F.col("dimension") == "_risk") & F.col("score").isNotNull()).select("period", F.col("score").alias("_v"), F.col("n").alias("_n"))
    p95 = _ranked(risks, ["period"], 0.95).select("period", F.lit("scalar").alias("kind"), F.lit("risk_p95").alias("item"), F.col("percentile").alias("value"))
    return sizes.unionByName(scalars).unionByName(p95)


def snapshot(df: DataFrame) -> DataFrame:
    """Tidy snapshot (kind, item, value) of one table."""
    scalars = [(c, 0.0) for c in ("risk_mean", "mean_completeness")]
    found = cut_lineage(snapshots(df, F.lit(0)).drop("period"))
    if not found.isEmpty():
        return found
    return df.sparkSession.createDataFrame([("scalar", c, v) for c, v in scalars], "kind string, item string, value double")


def drift_between(df: DataFrame, later: Column, *, threshold: float = C.JSD_ALERT) -> DataFrame:
    """`drift_report` of the rows where `later` holds against the others, in one pass over the table."""
    both = snapshots(df, later)
    return drift_report(both.filter("NOT period").drop("period"), both.filter("period").drop("period"), threshold=threshold)


def _shares(base: DataFrame, current: DataFrame) -> DataFrame:
    """Both probability distributions side by side per dimension and value.

    The totals have one row per dimension and are broadcast.
    """
    b = base.select("dimension", "value", F.col("n").alias("_b"))
    c = current.select("dimension", "value", F.col("n").alias("_c"))
    both = b.join(c, ["dimension", "value"], "full").fillna(0, ["_b", "_c"])
    totals = both.groupBy("dimension").agg(F.sum("_b").alias("base_total"), F.sum("_c").alias("current_total"))
    share = both.join(F.broadcast(totals), "dimension")
    return share.withColumns(
        {
            "p": F.coalesce(F.try_divide("_b", "base_total"), F.lit(0.0)),
            "q": F.coalesce(F.try_divide("_c", "current_total"), F.lit(0.0)),
        }
    )


def _kl_term(p: Column, q: Column) -> Column:
    return F.when((p > 0) & (q > 0), p * F.log2(p / q)).otherwise(0.0)


def kl_divergence(base: DataFrame, current: DataFrame) -> DataFrame:
    """Kullback-Leibler divergence (base 2) per dimension; values absent on the right are skipped."""
    share = _shares(base, current)
    return share.groupBy("dimension").agg(F.round(F.sum(_kl_term(F.col("p"), F.col("q"))), 6).alias("kl"))


def js_distance(base: DataFrame, current: DataFrame) -> DataFrame:
    """Jensen-Shannon distance per dimension.

    The distance is 0 by contract when a side is empty; `baseline_empty` then says
    that 'no drift' only means 'no baseline'.
    """
    share = _shares(base, current)
    m = (F.col("p") + F.col("q")) / 2
    both_sides = (F.col("base_total") > 0) & (F.col("current_total") > 0)
    grouped = share.groupBy("dimension").agg(
        F.sum(_kl_term(F.col("p"), m)).alias("_a"), F.sum(_kl_term(F.col("q"), m)).alias("_b"),
        F.max((F.col("base_total") == 0)).alias("baseline_empty"),
        F.max(both_sides).alias("_both"),
    )
    distance = F.sqrt(F.greatest(F.lit(0.0), (F.col("_a") + F.col("_b")) / 2))
    return grouped.select(
        "dimension", F.round(F.when(F.col("_both"), distance).otherwise(0.0), 6).alias("jsd"), "baseline_empty"
    )


def js_distance_by(base: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Jensen-Shannon distance to one baseline for every `by` group and dimension of the current counts.

    The baseline is not repeated per group: a value that a group lacks adds its whole share p, so those
    values together add 1 minus the shares of the values the group has.
    """
    b = base.groupBy("dimension", "value").agg(F.sum("n").alias("_b"))
    base_totals = b.groupBy("dimension").agg(F.sum("_b").alias("_base"))  # one row per dimension
    keys = [*by, "dimension"]
    c = current.groupBy(*keys, "value").agg(F.sum("n").alias("_c"))
    totals = c.groupBy(*keys).agg(F.sum("_c").alias("_all"))
    held = c.join(totals, keys).join(F.broadcast(base_totals), "dimension", "left").join(b, ["dimension", "value"], "left")
    p = F.coalesce(F.try_divide(F.col("_b"), F.col("_base")), F.lit(0.0))
    q = F.coalesce(F.try_divide(F.col("_c"), F.col("_all")), F.lit(0.0))
    held = held.withColumns({"_p": p, "_q": q}).withColumn("_m", (F.col("_p") + F.col("_q")) / 2)
    grouped = held.groupBy(*keys).agg(
        F.sum(_kl_term(F.col("_p"), F.col("_m"))).alias("_pm"), F.sum(_kl_term(F.col("_q"), F.col("_m"))).alias("_qm"),
        F.sum("_p").alias("_met"), F.coalesce(F.max("_base"), F.lit(0)).alias("_base"), F.max("_all").alias("_all"),
    )
    distance = F.sqrt(F.greatest(F.lit(0.0), (F.col("_pm") + 1 - F.col("_met") + F.col("_qm")) / 2))
    both = (F.col("_base") > 0) & (F.col("_all") > 0)
    return grouped.select(*keys, F.round(F.when(both, distance).otherwise(0.0), 6).alias("jsd"), (F.col("_base") == 0).alias("baseline_empty"))


def histogram_moments(counts: DataFrame, by: list[str], share: float = 0.95) -> DataFrame:
    """Mean and nearest-rank percentile per group from counts (value, n) of rounded scores."""
    valued = counts.select(*by, F.col("value").cast("double").alias("_v"), "n").groupBy(*by, "_v").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*by).orderBy("_v")  # at most 10,001 four-decimal scores a group
    running = valued.withColumns(
        {"_upto": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("n").over(W.partitionBy(*by))}
    )
    at = F.floor(F.lit(share) * (F.col("_all") - 1))
    return running.groupBy(*by).agg(
        F.round(F.sum(F.col("_v") * F.col("n")) / F.sum("n"), 4).alias("risk_mean"),
        F.min(F.when(F.col("_upto") > at, F.col("_v"))).alias("risk_p95"),
    )


def window_report(base: DataFrame, counts: DataFrame, *, window: str = "window_start", threshold: float = C.JSD_ALERT) -> DataFrame:
    """(window, measure, value, baseline_empty, drifted) of each window of (window, dimension, value, n) counts.

    `base` is a snapshot (kind, item, value). The verdicts are those of `drift_report`, one window at a time.
    """
    base_counts = base.filter(F.col("kind").isin(ALARM_DIMENSIONS)).select(
        F.col("kind").alias("dimension"), F.col("item").alias("value"), F.col("value").cast("double").alias("n")
    )
    distances = js_distance_by(base_counts, counts.filter(F.col("dimension").isin(ALARM_DIMENSIONS)), [window]).select(
        window, F.col("dimension").alias("measure"), F.col("jsd").alias("value"), "baseline_empty", (F.col("jsd") >= threshold).alias("drifted")
    )
    moments = histogram_moments(counts.filter(F.col("dimension") == "risk_score"), [window])
    long = moments.select(window, F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("_c")) for c in ("risk_mean", "risk_p95")])).alias("m"))
    scalars = base.filter((F.col("kind") == "scalar") & F.col("item").isin("risk_mean", "risk_p95")).select("item", F.col("value").alias("_b"))
    shift = long.select(window, "m.*").join(F.broadcast(scalars), "item", "left")  # two rows
    delta = F.round(F.abs(F.col("_c") - F.coalesce("_b", F.lit(0.0))), 4)
    return distances.unionByName(shift.select(
        window, F.concat("item", F.lit("_delta")).alias("measure"), delta.alias("value"), F.col("_b").isNull().alias("baseline_empty"),
        ((F.col("item") == "risk_mean") & (delta > C.RISK_SHIFT_ALERT)).alias("drifted"),
    ))


def drift_report(base: DataFrame, current: DataFrame, *, threshold: float = C.JSD_ALERT) -> DataFrame:
    """Distances of two tidy snapshots plus the shifts of mean and p95, with a verdict per row."""

    def counts(s: DataFrame) -> DataFrame:
        return s.filter(F.col("kind").isin(ALARM_DIMENSIONS)).select(
            F.col("kind").alias("dimension"), F.col("item").alias("value"), F.col("value").cast("double").alias("n")
        )

    def scalars(s: DataFrame, name: str) -> DataFrame:
        return s.filter((F.col("kind") == "scalar") & F.col("item").isin("risk_mean", "risk_p95")).select(
            "item", F.col("value").alias(name)
        )

    distances = js_distance(counts(base), counts(current)).select(
        F.col("dimension").alias("measure"), F.col("jsd").alias("value"), "baseline_empty",
        (F.col("jsd") >= threshold).alias("drifted"),
    )
    shift = scalars(current, "_c").join(scalars(base, "_b"), "item", "left")
    delta = F.round(F.abs(F.col("_c") - F.coalesce("_b", F.lit(0.0))), 4)
    shifts = shift.select(
        F.concat("item", F.lit("_delta")).alias("measure"), delta.alias("value"),
        F.col("_b").isNull().alias("baseline_empty"),
        ((F.col("item") == "risk_mean") & (delta > C.RISK_SHIFT_ALERT)).alias("drifted"),
    )
    return distances.unionByName(shifts)
