"""Exact evaluation metrics and Spark ML training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import models as M
from ...operators import scoring as S
from ...operators.splits import stratified_split
from ...session import cut_lineage
from ..derived import ctes, derived, table
from . import query
from .documents import training_features_df

V = ctes("verifications_v")
_SCORED = V + ", s AS (SELECT verification_id, document_id, prediction, risk_score AS score, CASE WHEN risk_score >= 0.55 OR (risk_score >= 0.3 AND document_id % 4 = 0) THEN 1 ELSE 0 END AS label, CASE document_id % 6 WHEN 0 THEN 'completion' WHEN 1 THEN 'technical' ELSE 'academic' END AS kind FROM verifications_v WHERE prediction <> 'error')"


def scored(spark, sf):
    v = derived(spark, sf, "verifications_v").filter(F.col("prediction") != "error")
    k = F.col("document_id")
    label = (F.col("risk_score") >= 0.55) | ((F.col("risk_score") >= 0.3) & (k % 4 == 0))
    return v.select(
        "verification_id", "document_id", F.col("risk_score").alias("score"), label.cast("int").alias("label"),
        (F.col("prediction") == "suspicious").cast("int").alias("predicted"),
        F.when(k % 6 == 0, "completion").when(k % 6 == 1, "technical").otherwise("academic").alias("certificate_type"),
    )


_CELLS = "count(*) AS n, count(*) FILTER (WHERE label = 1 AND prediction = 'suspicious') AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 'suspicious') AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 'genuine') AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 'genuine') AS tn"
_RATES = """coalesce(round((tp + tn) / n, 4), 0) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0) AS recall,
  coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) AS f1, coalesce(round(fp / nullif(fp + tn, 0), 4), 0) AS false_positive_rate, coalesce(round(fn / nullif(fn + tp, 0), 4), 0) AS false_negative_rate"""


@query(
    "class_metrics_by_type",
    _SCORED + f", g AS (SELECT kind AS group_value, {_CELLS} FROM s GROUP BY kind UNION ALL SELECT 'overall', {_CELLS} FROM s) SELECT *, {_RATES} FROM g",
)
def class_metrics_by_type(spark, sf):
    return S.class_metrics(scored(spark, sf), "label", "predicted", "certificate_type")


_RANKS = """w AS (SELECT kind, label, score, rank() OVER (PARTITION BY kind ORDER BY score) AS rk, count(*) OVER (PARTITION BY kind, score) AS ties FROM s),
auc AS (SELECT kind, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, sum(rk + (ties - 1) / 2.0) FILTER (WHERE label = 1) AS ranks FROM w GROUP BY kind),
h AS (SELECT kind, score, sum(label) AS pos, count(*) AS m FROM s GROUP BY kind, score), c AS (SELECT kind, pos, sum(pos) OVER (PARTITION BY kind ORDER BY score DESC) AS tp, sum(m) OVER (PARTITION BY kind ORDER BY score DESC) AS seen FROM h),
ap AS (SELECT kind, sum(pos * tp / seen) / sum(pos) AS ap FROM c GROUP BY kind)"""


@query(
    "ranking_metrics",
    _SCORED.replace("FROM verifications_v WHERE", "FROM verifications_v WHERE") + f""", {_RANKS} SELECT auc.kind AS certificate_type, positives, negatives, round((ranks - positives * (positives + 1) / 2.0) / (positives * negatives), 4) AS roc_auc, round(ap, 4) AS pr_auc FROM auc JOIN ap ON ap.kind = auc.kind""",
)
def ranking_metrics(spark, sf):
    return S.ranking_metrics(scored(spark, sf), "score", "label", ["certificate_type"])


@query(
    "metrics_per_type",
    _SCORED + f""", {_RANKS}, g AS (SELECT kind, {_CELLS} FROM s GROUP BY kind), r AS (SELECT *, {_RATES} FROM g)
SELECT r.kind AS group_value, n, CAST(n >= 5 AND positives > 0 AND negatives > 0 AS INT) AS sufficient, accuracy, precision, recall, f1, round((ranks - positives * (positives + 1) / 2.0) / (positives * negatives), 4) AS roc_auc, round(ap, 4) AS pr_auc, false_positive_rate, false_negative_rate
FROM r JOIN auc ON auc.kind = r.kind JOIN ap ON ap.kind = r.kind""",
)
def metrics_per_type(spark, sf):
    return S.per_type_metrics(scored(spark, sf), "label", "predicted", "score").withColumn("sufficient", F.col("sufficient").cast("int"))


@query(
    "threshold_sweep",
    _SCORED + """, t AS (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp, count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn FROM s, t GROUP BY threshold)
SELECT threshold, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM c""",
)
def threshold_sweep(spark, sf):
    return S.threshold_sweep(scored(spark, sf), "score", "label")


@query("brier_score", _SCORED + " SELECT round(avg(pow(score - label, 2)), 6) AS brier, round(avg(score), 6) AS mean_probability, round(avg(label), 6) AS positive_rate FROM s")
def brier_score(spark, sf):
    return S.brier(scored(spark, sf), "score", "label")


@query("label_quality_metrics", "WITH s AS (SELECT quality AS label, CASE WHEN toxic = 1 THEN 'suspicious' ELSE 'genuine' END AS prediction FROM labels), g AS (SELECT 'overall' AS group_value, " + _CELLS + f" FROM s) SELECT *, {_RATES} FROM g")
def label_quality_metrics(spark, sf):
    return S.class_metrics(table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted")), "label", "predicted")


@query("balanced_class_weights", ctes("raw_v") + " SELECT document_id, label, (SELECT count(*) FROM raw_v) / (2.0 * count(*) OVER (PARTITION BY label)) AS weight FROM raw_v")
def balanced_class_weights(spark, sf):
    return M.class_weights(derived(spark, sf, "raw_v").select("document_id", "label"))


@query("logistic_regression_scores")
def logistic_regression_scores(spark, sf):
    """Test-split scores of a balanced logistic regression on the feature table."""
    rows = cut_lineage(stratified_split(training_features_df(spark, sf), "document_id"))
    model = M.fit(rows.filter("split = 'train'"), "logistic_regression")
    return M.score(model, rows.filter("split = 'test'"), version="logistic_regression").select(
        "document_id", "label", "prediction", "risk_score", "confidence", "model_version"
    )


@query("forest_importances")
def forest_importances(spark, sf):
    """Importances of a small balanced forest over all training rows."""
    return M.importances(M.fit(cut_lineage(training_features_df(spark, sf)), "forest", trees=20), spark)


@query("candidate_benchmark")
def candidate_benchmark(spark, sf):
    """Two candidates trained and ranked on a stored split."""
    rows = stratified_split(training_features_df(spark, sf), "document_id").withColumn(
        "split", F.when(F.col("split") == "test", "test").otherwise("train")
    ).withColumn("certificate_id", F.col("document_id").cast("string"))
    return M.benchmark(rows, ["forest", "logistic_regression"], trees=20).select(
        "rank", "model", "n", "recall", "f1", "precision", "accuracy", "roc_auc", "pr_auc"
    )
