"""Exact classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from .skew import running_totals

# Decision thresholds of the sweep.
THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]


def score_histogram(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """Positives and negatives per score, as stored: nothing is rounded."""
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        *(groups or []), F.col(score).cast("double").alias("score")
    ).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def ranking_metrics(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """ROC-AUC with ties counted half, and average precision. NULL for a single class."""
    keys = groups or []
    running = running_totals(score_histogram(df, score, label, groups), "score", ["pos", "neg"], keys, descending=True)
    tp, fp = F.col("upto_pos"), F.col("upto_neg")
    below = F.col("all_neg") - fp + F.col("neg") / 2.0
    parts = running.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * below).alias("_wins"), F.sum(F.col("pos") * tp / (tp + fp)).alias("_precision"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return parts.select(
        *keys, "positives", "negatives",
        F.when(both, F.round(F.col("_wins") / (F.col("positives") * F.col("negatives")), 4)).alias("roc_auc"),
        F.round(F.try_divide("_precision", "positives"), 4).alias("pr_auc"),
    )


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Precision, recall and F1 of the positive class at each threshold, in one pass over the raw scores."""
    positive, negative = F.col(label) == 1, F.col(label) == 0
    sums = [F.count_if(positive & F.col(score).isNotNull()).alias("p")]
    for i, t in enumerate(thresholds):
        sums += [F.count_if(positive & (F.col(score) >= t)).alias(f"tp{i}"), F.count_if(negative & (F.col(score) >= t)).alias(f"fp{i}")]
    cells = [
        F.struct(
            F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("p") - F.col(f"tp{i}")).alias("fn"),
        )
        for i, t in enumerate(thresholds)
    ]
    rows = df.agg(*sums).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rows.withColumns(
        {
            "precision": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4),
            "recall": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4),
            "f1": F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4),
        }
    )


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.agg(
        F.round(F.avg(F.pow(F.col(score) - F.col(label), 2)), 6).alias("brier"),
        F.round(F.avg(score), 6).alias("mean_probability"), F.round(F.avg(F.col(label)), 6).alias("positive_rate"),
    )


def class_metrics(df: DataFrame, label: str, predicted: str, group: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1, FPR, FNR and confusion, per group and overall.

    The false rates divide by all negatives and all positives of the truth.
    """
    y, p = F.col(label), F.col(predicted)
    cells = [
        F.count(F.lit(1)).alias("n"), F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
    ]
    if group is None:
        rows = df.agg(*cells).withColumn("group_value", F.lit("overall"))
    else:
        keyed = df.withColumn("group_value", F.coalesce(F.col(group), F.lit("unknown")))
        rows = keyed.rollup("group_value").agg(*cells).withColumn("group_value", F.coalesce("group_value", F.lit("overall")))
    return rate_columns(rows)


def rate_columns(rows: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def rate(num: Column, den: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(num, den), 4), F.lit(0.0))

    return rows.withColumns(
        {
            "accuracy": rate(tp + tn, F.col("n")), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn),
            "f1": rate(2 * tp, 2 * tp + fp + fn), "false_positive_rate": rate(fp, fp + tn),
            "false_negative_rate": rate(fn, fn + tp),
        }
    )


def per_type_metrics(df: DataFrame, label: str, predicted: str, score: str, group: str = "certificate_type") -> DataFrame:
    """Metrics per type; types with under five rows or one class are marked insufficient."""
    rows = class_metrics(df, label, predicted, group).filter(F.col("group_value") != "overall")
    auc = ranking_metrics(df.withColumn("group_value", F.coalesce(F.col(group), F.lit("unknown"))), score, label, ["group_value"])
    enough = (F.col("n") >= C.MIN_GROUP_SAMPLES) & (F.col("positives") > 0) & (F.col("negatives") > 0)
    joined = rows.join(auc, "group_value").withColumn("sufficient", enough)
    measured = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "false_positive_rate", "false_negative_rate"]
    return joined.select(
        "group_value", "n", "sufficient", *[F.when(F.col("sufficient"), F.col(c)).alias(c) for c in measured]
    )


def rank_models(metrics: DataFrame) -> DataFrame:
    """Models by recall, F1, precision and accuracy; insufficient ones last.

    One row per candidate model, so the window is tiny.
    """
    keys = [
        F.when(F.col("n") >= C.MIN_GROUP_SAMPLES, F.col(c)).otherwise(-1.0).desc()
        for c in ("recall", "f1", "precision", "accuracy")
    ]
    return metrics.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*keys, F.col("model"))))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each model version."""
    cols = [c for c in runs.columns if c != "version"]
    newest = runs.groupBy("version").agg(F.max_by(F.struct(*cols), F.struct("timestamp", "run_id")).alias("r"))
    return newest.select("version", "r.*")
