"""Reviewer feedback: validation, summaries and grouped error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scores import completeness_bucket, risk_band
from ..functions.text import present
from .history import evidence_snapshot, stored_completeness, stored_primary_type
from .intelligence import lookup
from .skew import lookup_join

TRUTH = {"confirmed_genuine": "genuine", "confirmed_suspicious": "suspicious"}
DECISIVE_ASSESSMENT = {"LIKELY_GENUINE": "genuine", "LIKELY_SUSPICIOUS": "suspicious"}
MAX_NOTE_CHARS = 2000


def is_disagreement(label: Column, prediction: Column) -> Column:
    truth = lookup(label, TRUTH)
    return F.coalesce(truth != prediction, F.lit(False))


def decisive(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reviewer_label").isin(C.DECISIVE_LABELS))


def validate_submissions(submissions: DataFrame, verifications: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Add reject_reason (NULL when accepted); the first broken rule is named.

    Of several submissions for one verification in the batch the lowest
    submission_id is accepted.
    """
    known = verifications.select("verification_id", F.col("prediction").alias("_prediction"))
    done = reviewed.select("verification_id").distinct().withColumn("_done", F.lit(True))
    # Everything known about a verification is joined per id first; the submissions then
    # look it up, also when one id holds a large share of them.
    per_id = submissions.groupBy("verification_id").agg(
        F.min("submission_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    facts = per_id.join(known, "verification_id", "left").join(done, "verification_id", "left")
    joined = lookup_join(submissions, facts, ["verification_id"], "_n")
    reason = (
        F.when(~F.coalesce(F.col("reviewer_label").isin(C.REVIEWER_LABELS), F.lit(False)), "invalid_label")
        .when(F.length("reviewer_note") > MAX_NOTE_CHARS, "note_too_long")
        .when(F.col("_prediction").isNull(), "unknown_verification")
        .when(F.col("_prediction") == "error", "failed_verification")
        .when(F.col("_done") | (F.col("submission_id") > F.col("_first")), "already_reviewed")
    )
    return joined.withColumn("reject_reason", reason).drop("_prediction", "_done", "_first", "_n")


def snapshot_reviews(accepted: DataFrame, verifications: DataFrame) -> DataFrame:
    """Freeze the stored result of each reviewed verification next to its label."""
    v = verifications.select(
        "verification_id", "user_id", F.col("prediction").alias("original_prediction"),
        F.col("risk_score").alias("original_risk_score"), F.col("confidence").alias("original_confidence"),
        "model_version", stored_primary_type(F.col("certificate_type")).alias("certificate_type"),
        stored_completeness(F.col("extracted_info")).alias("extraction_completeness"),
        "review_status", "issuer", "ood_status", "review_priority", "file_fingerprint",
        "cert_id_fingerprint", "identity_fingerprint",
        *[c.alias(n) for n, c in evidence_snapshot(F.col("evidence_json")).items()],
    )
    note = F.when(present(F.col("reviewer_note")), F.trim("reviewer_note"))
    return (
        accepted.select("verification_id", "reviewer_label", note.alias("reviewer_note"))
        .join(v, "verification_id")
        .withColumn("is_disagreement", is_disagreement(F.col("reviewer_label"), F.col("original_prediction")))
    )


def feedback_summary(feedback: DataFrame, verifications: DataFrame) -> DataFrame:
    """Review counts and rates in one row; rates are NULL without decisive reviews."""
    label = F.col("reviewer_label")
    counts = feedback.agg(
        F.count(F.lit(1)).alias("total_reviewed"),
        *[F.count_if(label == name).alias(name) for name in C.REVIEWER_LABELS],
        F.count_if(label.isin(C.DECISIVE_LABELS)).alias("decisive_reviews"),
        F.count_if(is_disagreement(label, F.col("original_prediction"))).alias("disagreement_count"),
    )
    good = verifications.agg(F.count_if(F.col("prediction") != "error").alias("_ok")).scalar()
    return (
        counts.withColumn("_ok", good)
        .withColumns(
            {
                "not_reviewed": F.greatest(F.col("_ok") - F.col("total_reviewed"), F.lit(0)),
                "agreement_count": F.col("decisive_reviews") - F.col("disagreement_count"),
                "disagreement_rate": F.round(F.try_divide("disagreement_count", "decisive_reviews"), 4),
                "reviewed_rate": F.round(F.try_divide("total_reviewed", "_ok"), 4),
            }
        )
        .withColumn("agreement_rate", F.round(F.try_divide("agreement_count", "decisive_reviews"), 4))
        .drop("_ok")
    )


def not_reviewed(verifications: DataFrame, feedback: DataFrame) -> DataFrame:
    ok = verifications.filter(F.col("prediction") != "error")
    return ok.join(feedback.select("verification_id"), "verification_id", "left_anti")


def orphan_feedback(feedback: DataFrame, verifications: DataFrame) -> DataFrame:
    return feedback.join(verifications.select("verification_id"), "verification_id", "left_anti")


def confusion(truth: Column, predicted: Column, prefix: str = "") -> list[Column]:
    """Four conditional counts with genuine as the positive class."""
    cells = {"tp": ("genuine", "genuine"), "fp": ("suspicious", "genuine"), "fn": ("genuine", "suspicious"), "tn": ("suspicious", "suspicious")}
    return [F.count_if((truth == t) & (predicted == p)).alias(prefix + name) for name, (t, p) in cells.items()]


def metric_block(df: DataFrame, minimum: Column | int, prefix: str = "") -> DataFrame:
    """Rates from tp, fp, fn, tn and n; NULL with sufficient=false under the minimum."""
    tp, fp, fn, tn = (F.col(prefix + c) for c in ("tp", "fp", "fn", "tn"))
    enough = F.col("n") >= minimum

    def rate(num: Column, den: Column) -> Column:
        return F.when(enough, F.round(F.try_divide(num, den), 4))

    return df.withColumns(
        {
            prefix + "sufficient": enough,
            prefix + "genuine_precision": rate(tp, tp + fp),
            prefix + "genuine_recall": rate(tp, tp + fn),
            prefix + "genuine_f1": rate(2 * tp, 2 * tp + fp + fn),
            prefix + "suspicious_precision": rate(tn, tn + fn),
            prefix + "suspicious_recall": rate(tn, tn + fp),
            prefix + "suspicious_f1": rate(2 * tn, 2 * tn + fp + fn),
            prefix + "false_positive_rate": rate(fp, fp + tn),
            prefix + "false_negative_rate": rate(fn, fn + tp),
            prefix + "accuracy": rate(tp + tn, F.col("n")),
        }
    )


def grouped(df: DataFrame, dimensions: dict[str, Column], aggregates: list[Column]) -> DataFrame:
    """Aggregates overall and per value of every dimension, from one scan.

    Grouping sets over the dimensions; blank values are 'unknown'. The result
    carries `dimension` ('overall' for the grand total) and `group_value`.
    """
    named = {f"_d{i}": (name, col) for i, (name, col) in enumerate(dimensions.items())}
    staged = df.withColumns(
        {alias: F.when(present(col), col.cast("string")).otherwise("unknown") for alias, (_, col) in named.items()}
    )
    sets = [[F.col(alias)] for alias in named] + [[]]
    out = staged.groupingSets(sets, *[F.col(alias) for alias in named]).agg(*aggregates)
    dimension = F.coalesce(*[F.when(F.col(a).isNotNull(), F.lit(n)) for a, (n, _) in named.items()], F.lit("overall"))
    value = F.coalesce(*[F.col(a) for a in named], F.lit("all"))
    return out.withColumns({"dimension": dimension, "group_value": value}).drop(*named)


def _truth(df: DataFrame) -> DataFrame:
    return decisive(df).withColumn("_truth", lookup(F.col("reviewer_label"), TRUTH))


def error_analysis(feedback: DataFrame, *, group_minimum: int = C.MIN_GROUP_SAMPLES) -> DataFrame:
    """Metric block overall and by type, issuer, review status, priority and completeness."""
    rows = _truth(feedback)
    dims = {
        "certificate_type": F.col("certificate_type"), "issuer": F.col("issuer"),
        "review_status": F.col("review_status"), "review_priority": F.col("review_priority"),
        "extraction_completeness": completeness_bucket(F.col("extraction_completeness")),
    }
    aggregates = [
        F.count(F.lit(1)).alias("n"), *confusion(F.col("_truth"), F.col("original_prediction")),
        F.count_if(F.col("_truth") != F.col("original_prediction")).alias("disagreements"),
    ]
    minimum = F.when(F.col("dimension") == "overall", C.MIN_METRIC_SAMPLES).otherwise(group_minimum)
    return metric_block(grouped(rows, dims, aggregates), minimum)


def feedback_analytics(feedback: DataFrame) -> DataFrame:
    """The monitoring variant: every group needs ten rows.

    False negatives are genuine documents predicted suspicious, as in the error
    analysis.
    """
    return error_analysis(feedback, group_minimum=C.MIN_METRIC_SAMPLES)


def reviewed_counters(feedback: DataFrame) -> DataFrame:
    """OOD and priority counts over all reviewed rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("dimension"), F.when(present(F.col(c)), F.col(c)).otherwise("unknown").alias("value"))
            for c in ("ood_status", "review_priority")
        ]
    )
    return feedback.select(F.explode(pairs).alias("p")).select("p.*").groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def decisive_pairs(df: DataFrame) -> DataFrame:
    """Rows with a confirmed truth and a decisive assessment, both as plain classes."""
    staged = df.withColumns(
        {"truth": lookup(F.col("reviewer_label"), TRUTH), "assessed": lookup(F.col("assessment"), DECISIVE_ASSESSMENT)}
    )
    return staged.filter(F.col("truth").isNotNull() & F.col("assessed").isNotNull())


def engine_vs_model(pairs: DataFrame) -> DataFrame:
    """Evidence engine and model against the truth, overall and by group."""
    rows = decisive_pairs(pairs)
    dims = {
        "certificate_type": F.col("certificate_type"), "ood_status": F.col("ood_status"),
        "issuer": F.col("issuer"), "risk_band": risk_band(F.col("risk_score")),
    }
    aggregates = [
        F.count(F.lit(1)).alias("n"), *confusion(F.col("truth"), F.col("assessed"), "engine_"),
        *confusion(F.col("truth"), F.col("prediction"), "model_"),
    ]
    out = grouped(rows, dims, aggregates)
    for side in ("engine_", "model_"):
        out = metric_block(out, C.MIN_DECISIVE_SAMPLES, side)
    return out


def assessment_distribution(pairs: DataFrame) -> DataFrame:
    known = F.coalesce("assessment", F.lit("REQUIRES_VERIFICATION"))
    return pairs.groupBy(known.alias("assessment")).agg(F.count(F.lit(1)).alias("n"))


def wrong_assessments(pairs: DataFrame, status_map: str = "category_status") -> DataFrame:
    """False positives and negatives with the categories that explain them."""
    rows = decisive_pairs(pairs).filter(F.col("truth") != F.col("assessed"))
    missed = F.col("truth") == "genuine"
    wanted = F.when(missed, "FAIL").otherwise("PASS")
    entries = F.array_sort(F.map_entries(F.map_filter(status_map, lambda k, v: v == wanted)))
    named = F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    last = F.when(missed, F.concat(F.lit("risk="), F.format_string("%.3f", F.col("risk_score")))).otherwise(
        F.concat(F.lit("anomaly="), F.coalesce("anomaly_level", F.lit("None")))
    )
    return rows.select(
        "verification_id", "issuer", F.when(missed, "false_negative").otherwise("false_positive").alias("kind"),
        "truth", "assessed", F.array_join(F.concat(named, F.array(last)), "; ").alias("failure_reason"),
    )


def external_validation(predictions: DataFrame) -> DataFrame:
    """Accuracy, recalls and error rates overall and per category of expected labels."""
    rows = predictions.filter(F.col("prediction") != "error")
    want, got = F.col("expected"), F.col("prediction")
    aggregates = [
        F.count(F.lit(1)).alias("n"), F.count_if(want == got).alias("n_correct"),
        F.count_if(want == "genuine").alias("n_genuine"), F.count_if(want == "suspicious").alias("n_suspicious"),
        F.count_if((want == "genuine") & (got == "suspicious")).alias("false_positives"),
        F.count_if((want == "suspicious") & (got == "genuine")).alias("false_negatives"),
    ]

    def rate(num: Column, den: str) -> Column:
        return F.coalesce(F.round(F.try_divide(num, F.col(den)), 4), F.lit(0.0))

    return grouped(rows, {"category": F.col("category")}, aggregates).withColumns(
        {
            "accuracy": rate(F.col("n_correct"), "n"),
            "genuine_recall": rate(F.col("n_genuine") - F.col("false_positives"), "n_genuine"),
            "suspicious_recall": rate(F.col("n_suspicious") - F.col("false_negatives"), "n_suspicious"),
            "false_positive_rate": rate(F.col("false_positives"), "n_genuine"),
            "false_negative_rate": rate(F.col("false_negatives"), "n_suspicious"),
        }
    )


def misclassified(predictions: DataFrame) -> DataFrame:
    """Wrong predictions with the likely cause: A extraction, C coverage, D model, E ambiguous."""
    wrong = predictions.filter((F.col("prediction") != "error") & (F.col("prediction") != F.col("expected")))
    return wrong.withColumn("cause", error_cause())


def error_cause() -> Column:
    def off(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) == 0

    signal = (F.coalesce(F.col("suspicious_keyword_count"), F.lit(0)) > 0) | (F.coalesce(F.col("suspicious_url_present"), F.lit(0)) == 1)
    no_type = off("certificate_type_academic") & off("certificate_type_completion") & off("certificate_type_training") & off("certificate_type_technical")
    rejected = (
        F.when(off("completion_date_present") | off("recipient_present") | off("issuer_present"), "A")
        .when(no_type | off("issuer_known"), "C")
        .when(off("grade_consistency_valid") & ~off("marks_pattern_valid"), "E")
        .when(signal, "E").otherwise("D")
    )
    accepted = F.when(signal, "E").otherwise("C")
    return (
        F.when((F.col("expected") == "genuine") & (F.col("prediction") == "suspicious"), rejected)
        .when((F.col("expected") == "suspicious") & (F.col("prediction") == "genuine"), accepted)
        .otherwise("?")
    )
