
import pytest
from pyspark.sql import functions as F

from sparkattest.operators import drift as D
from sparkattest.operators import scoring as S
from sparkattest.operators.feedback import error_analysis

COUNTS = "dimension string, value string, n long"


def jsd(spark, a, b):
    def frame(d):
        return spark.createDataFrame([("d", k, v) for k, v in d.items()], COUNTS)

    return D.js_distance(frame(a), frame(b)).first()


def test_distance_known_values(spark):
    same = jsd(spark, {"x": 7, "y": 12}, {"x": 11, "y": 13})
    assert round(same["jsd"], 4) == 0.0776 and not same["baseline_empty"]
    assert jsd(spark, {"x": 11, "y": 13}, {"x": 7, "y": 12})["jsd"] == same["jsd"]
    empty = jsd(spark, {}, {"academic": 4})
    assert empty["jsd"] == 0.0 and empty["baseline_empty"]
    assert jsd(spark, {"x": 1}, {"y": 1})["jsd"] == 1.0


def test_nearest_rank(spark):
    df = spark.range(19).withColumn("v", F.col("id").cast("double"))
    assert D.nearest_rank(df, "v", 0.95).first()[0] == 17.0
    assert D.nearest_rank(df.limit(0), "v", 0.95).count() == 0


def test_auc_with_ties_matches_pairs(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.35, 0), (0.8, 0), (0.9, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert S.ranking_metrics(df, "s", "y").first()["roc_auc"] == pytest.approx(wins, abs=1e-4)
    assert S.ranking_metrics(df.filter("y = 1"), "s", "y").first()["roc_auc"] is None


def test_metric_block_minimum(spark):
    schema = "reviewer_label string, original_prediction string, certificate_type string, issuer string, review_status string, review_priority string, extraction_completeness double"
    rows = [("confirmed_genuine", "genuine", "a", "", None, "low", 0.9)] * 6 + [("confirmed_suspicious", "suspicious", "b", "u", "x", "high", None)] * 6
    out = {(r["dimension"], r["group_value"]): r for r in error_analysis(spark.createDataFrame(rows, schema)).collect()}
    whole = out[("overall", "all")]
    assert (whole["tp"], whole["tn"], whole["accuracy"]) == (6, 6, 1.0)
    assert out[("issuer", "unknown")]["n"] == 6 and out[("extraction_completeness", "unknown")]["n"] == 6
    few = {(r["dimension"], r["group_value"]): r for r in error_analysis(spark.createDataFrame(rows[:4], schema)).collect()}
    assert not few[("overall", "all")]["sufficient"] and few[("overall", "all")]["accuracy"] is None


def test_model_ranking_puts_small_samples_last(spark):
    rows = [("a", 100, 0.8, 0.8, 0.8, 0.8), ("b", 100, 0.9, 0.7, 0.7, 0.7), ("c", 3, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "model string, n long, recall double, f1 double, precision double, accuracy double")
    assert [r["model"] for r in S.rank_models(df).orderBy("rank").collect()] == ["b", "a", "c"]


def test_metrics_use_unrounded_scores(spark):
    close = spark.createDataFrame([(0.49996, 1), (0.49997, 0)], "s double, y int")
    at_half = S.threshold_sweep(close, "s", "y", [0.5]).first()
    assert (at_half["tp"], at_half["fp"]) == (0, 0)
    pair = spark.createDataFrame([(0.90001, 1), (0.90002, 0)], "s double, y int")
    assert S.ranking_metrics(pair, "s", "y").first()["roc_auc"] == 0.0
    wide = spark.createDataFrame([(float(v * v), "a" if v % 2 else None) for v in range(200)], "v double, g string")
    got = {r["g"]: r["percentile"] for r in D.nearest_rank(wide, "v", 0.95, ["g"]).collect()}
    for g, odd in (("a", 1), (None, 0)):
        ordered = sorted(float(v * v) for v in range(200) if v % 2 == odd)
        assert got[g] == ordered[int(0.95 * (len(ordered) - 1))]
