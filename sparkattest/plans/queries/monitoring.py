"""Drift, windowed metrics and percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import drift as D
from ...operators.history import distributions
from ...streaming.jobs import windowed_metrics
from ..derived import ctes, derived, table
from . import query
from .history import DISTRIBUTIONS

V = ctes("verifications_v")
_HALF = "CASE WHEN created_at < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END"


def halves(spark, sf):
    v = derived(spark, sf, "verifications_v")
    old = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    return v.filter(old), v.filter(~old)


SHARES = V + f""", src AS (SELECT *, {_HALF} AS half FROM verifications_v), {DISTRIBUTIONS},
counts AS (SELECT dimension, value, count(*) FILTER (WHERE half = 0) AS b, count(*) FILTER (WHERE half = 1) AS c FROM dist_v GROUP BY dimension, value),
shares AS (SELECT dimension, value, b / sum(b) OVER (PARTITION BY dimension) AS p, c / sum(c) OVER (PARTITION BY dimension) AS q FROM counts)"""


@query("kl_divergence", SHARES + " SELECT dimension, round(sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END), 6) AS kl FROM shares GROUP BY dimension")
def kl_divergence(spark, sf):
    base, current = halves(spark, sf)
    return D.kl_divergence(distributions(base), distributions(current))


_JSD = "round(sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2)), 6)"


@query("jensen_shannon_distance", SHARES + f" SELECT dimension, {_JSD} AS jsd, 0 AS baseline_empty FROM shares GROUP BY dimension")
def jensen_shannon_distance(spark, sf):
    base, current = halves(spark, sf)
    return D.js_distance(distributions(base), distributions(current)).withColumn("baseline_empty", F.col("baseline_empty").cast("int"))


_EVENT_SHARES = """WITH counts AS (SELECT 'event_type' AS dimension, event_type AS value, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS b, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS c FROM events GROUP BY event_type),
shares AS (SELECT dimension, b / sum(b) OVER () AS p, c / sum(c) OVER () AS q FROM counts)"""


@query("event_type_drift", _EVENT_SHARES + f" SELECT dimension, {_JSD} AS jsd FROM shares GROUP BY dimension")
def event_type_drift(spark, sf):
    e = table(spark, sf, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")

    def counts(df):
        return df.groupBy(F.lit("event_type").alias("dimension"), F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))

    return D.js_distance(counts(e.filter(early)), counts(e.filter(~early))).select("dimension", "jsd")


_COMPLETE = "CASE WHEN document_id % 67 = 0 THEN 0.0 ELSE round((CAST(candidate_name <> '' AS INT) + CAST(issuer <> '' AS INT) + CAST(course <> '' AS INT) + 1 + CAST(cert_id IS NOT NULL AS INT)) / 5.0, 4) END"
_P95 = "(SELECT risk_score FROM (SELECT risk_score, row_number() OVER (ORDER BY risk_score) AS rn, count(*) OVER () AS n FROM {src}) WHERE rn = CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1)"


@query(
    "drift_snapshot",
    V + ", src AS (SELECT *, 0 AS half FROM verifications_v), ok AS (SELECT * FROM src WHERE prediction <> 'error'), " + DISTRIBUTIONS + f""" SELECT dimension AS kind, value AS item, CAST(count(*) AS DOUBLE) AS value FROM dist_v GROUP BY dimension, value
UNION ALL SELECT 'scalar', 'risk_mean', round(avg(risk_score), 4) FROM ok UNION ALL SELECT 'scalar', 'mean_completeness', round(avg({_COMPLETE}), 4) FROM ok UNION ALL SELECT 'scalar', 'risk_p95', {_P95.format(src='ok')}""",
)
def drift_snapshot(spark, sf):
    return D.snapshot(derived(spark, sf, "verifications_v"))


@query(
    "drift_report",
    SHARES + f""", ok0 AS (SELECT * FROM src WHERE prediction <> 'error' AND half = 0), ok1 AS (SELECT * FROM src WHERE prediction <> 'error' AND half = 1),
j AS (SELECT dimension AS measure, {_JSD} AS value FROM shares WHERE dimension <> 'model_version' GROUP BY dimension),
m AS (SELECT round(abs((SELECT round(avg(risk_score), 4) FROM ok1) - (SELECT round(avg(risk_score), 4) FROM ok0)), 4) AS d)
SELECT measure, value, 0 AS baseline_empty, CAST(value >= 0.25 AS INT) AS drifted FROM j UNION ALL SELECT 'risk_mean_delta', d, 0, CAST(d > 0.1 AS INT) FROM m
UNION ALL SELECT 'risk_p95_delta', round(abs({_P95.format(src='ok1')} - {_P95.format(src='ok0')}), 4), 0, 0""",
)
def drift_report(spark, sf):
    v = derived(spark, sf, "verifications_v")
    out = D.drift_between(v, F.col("created_at") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("baseline_empty", "drifted")})


@query(
    "nearest_rank_percentiles",
    V + """, r AS (SELECT prediction, risk_score, row_number() OVER (PARTITION BY prediction ORDER BY risk_score) AS rn, count(*) OVER (PARTITION BY prediction) AS n FROM verifications_v)
SELECT prediction, risk_score AS percentile FROM r WHERE rn = CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1""",
)
def nearest_rank_percentiles(spark, sf):
    return D.nearest_rank(derived(spark, sf, "verifications_v"), "risk_score", 0.95, ["prediction"])


@query(
    "daily_event_metrics",
    """SELECT date_trunc('day', ts) AS window_start, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS genuine_count, count(*) FILTER (WHERE event_type = 'view') AS suspicious_count,
  count(*) FILTER (WHERE event_type = 'error') AS error_count, coalesce(round(avg(value) FILTER (WHERE event_type <> 'error'), 4), 0) AS average_risk_score, coalesce(round(avg(value * 2) FILTER (WHERE event_type <> 'error'), 4), 0) AS average_confidence FROM events GROUP BY 1""",
)
def daily_event_metrics(spark, sf):
    """The windowed metrics on events: click, view and error stand for the predictions."""
    kind = F.when(F.col("event_type") == "click", "genuine").when(F.col("event_type") == "view", "suspicious").otherwise(F.col("event_type"))
    e = table(spark, sf, "events").select(
        F.col("ts").alias("created_at"), kind.alias("prediction"), F.col("value").alias("risk_score"), (F.col("value") * 2).alias("confidence")
    )
    out = windowed_metrics(e, every="1 day")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
