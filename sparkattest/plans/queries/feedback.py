"""Reviewer feedback: validation, summaries, grouped error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import feedback as B
from ...operators.scoring import latest_runs
from ..derived import ctes, derived, table
from . import query

FB = ctes("feedback_v")


def feedback(spark, sf):
    return derived(spark, sf, "feedback_v")


def stored(spark, sf):
    return derived(spark, sf, "verifications_v")


@query(
    "feedback_summary",
    FB + """, s AS (SELECT count(*) AS total_reviewed, count(*) FILTER (WHERE reviewer_label = 'confirmed_genuine') AS confirmed_genuine, count(*) FILTER (WHERE reviewer_label = 'confirmed_suspicious') AS confirmed_suspicious,
  count(*) FILTER (WHERE reviewer_label = 'uncertain') AS uncertain, count(*) FILTER (WHERE (reviewer_label = 'confirmed_genuine' AND original_prediction <> 'genuine') OR (reviewer_label = 'confirmed_suspicious' AND original_prediction <> 'suspicious')) AS disagreement_count FROM feedback_v),
ok AS (SELECT count(*) AS n FROM verifications_v WHERE prediction <> 'error')
SELECT total_reviewed, confirmed_genuine, confirmed_suspicious, uncertain, confirmed_genuine + confirmed_suspicious AS decisive_reviews, disagreement_count, greatest(n - total_reviewed, 0) AS not_reviewed,
  confirmed_genuine + confirmed_suspicious - disagreement_count AS agreement_count, round(disagreement_count / (confirmed_genuine + confirmed_suspicious), 4) AS disagreement_rate,
  round(total_reviewed / n, 4) AS reviewed_rate, round((confirmed_genuine + confirmed_suspicious - disagreement_count) / (confirmed_genuine + confirmed_suspicious), 4) AS agreement_rate FROM s, ok""",
)
def feedback_summary(spark, sf):
    return B.feedback_summary(feedback(spark, sf), stored(spark, sf))


@query(
    "unreviewed_verifications",
    FB + " SELECT verification_id FROM verifications_v WHERE prediction <> 'error' AND verification_id NOT IN (SELECT verification_id FROM feedback_v)",
)
def unreviewed_verifications(spark, sf):
    return B.not_reviewed(stored(spark, sf), feedback(spark, sf)).select("verification_id")


@query(
    "orphan_feedback",
    FB + " SELECT verification_id FROM feedback_v WHERE document_id % 4 <> 0",
)
def orphan_feedback(spark, sf):
    kept = stored(spark, sf).filter(F.col("document_id") % 4 == 0)
    return B.orphan_feedback(feedback(spark, sf), kept).select("verification_id")


@query(
    "reviewed_pairs",
    FB + """ SELECT v.verification_id, f.reviewer_label AS truth, v.prediction, v.risk_score, CAST((f.reviewer_label = 'confirmed_genuine' AND v.prediction <> 'genuine') OR (f.reviewer_label = 'confirmed_suspicious' AND v.prediction <> 'suspicious') AS INT) AS disagrees
FROM verifications_v v JOIN feedback_v f ON f.verification_id = v.verification_id""",
)
def reviewed_pairs(spark, sf):
    v = stored(spark, sf).select("verification_id", "prediction", "risk_score")
    f = feedback(spark, sf).select("verification_id", F.col("reviewer_label").alias("truth"))
    return v.join(f, "verification_id").withColumn("disagrees", B.is_disagreement(F.col("truth"), F.col("prediction")).cast("int"))


@query(
    "feedback_validation",
    ctes("verifications_v") + """, s AS (SELECT doc_id AS submission_id, 'V' || CAST(doc_id % 700 AS VARCHAR) AS verification_id, CASE doc_id % 6 WHEN 0 THEN 'fake' WHEN 1 THEN 'uncertain' ELSE 'confirmed_genuine' END AS reviewer_label, text AS reviewer_note FROM documents),
done AS (SELECT DISTINCT 'V' || CAST(doc_id * 3 AS VARCHAR) AS verification_id FROM labels)
SELECT s.submission_id, CASE WHEN reviewer_label = 'fake' THEN 'invalid_label' WHEN length(reviewer_note) > 2000 THEN 'note_too_long' WHEN v.prediction IS NULL THEN 'unknown_verification' WHEN v.prediction = 'error' THEN 'failed_verification'
  WHEN d.verification_id IS NOT NULL OR s.submission_id > min(s.submission_id) OVER (PARTITION BY s.verification_id) THEN 'already_reviewed' END AS reject_reason
FROM s LEFT JOIN verifications_v v ON v.verification_id = s.verification_id LEFT JOIN done d ON d.verification_id = s.verification_id""",
)
def feedback_validation(spark, sf):
    k = F.col("doc_id")
    subs = table(spark, sf, "documents").select(
        k.alias("submission_id"), F.concat(F.lit("V"), (k % 700).cast("string")).alias("verification_id"),
        F.when(k % 6 == 0, "fake").when(k % 6 == 1, "uncertain").otherwise("confirmed_genuine").alias("reviewer_label"),
        F.col("text").alias("reviewer_note"),
    )
    done = table(spark, sf, "labels").select(F.concat(F.lit("V"), (k * 3).cast("string")).alias("verification_id"))
    return B.validate_submissions(subs, stored(spark, sf), done).select("submission_id", "reject_reason")


@query(
    "review_snapshots",
    FB + """ SELECT f.verification_id, f.reviewer_label, nullif(f.reviewer_note, '') AS reviewer_note, v.prediction AS original_prediction, json_extract_string(v.evidence_json, '$.anomaly.level') AS anomaly_level,
  CAST((f.reviewer_label = 'confirmed_genuine' AND v.prediction <> 'genuine') OR (f.reviewer_label = 'confirmed_suspicious' AND v.prediction <> 'suspicious') AS INT) AS is_disagreement
FROM feedback_v f JOIN verifications_v v ON v.verification_id = f.verification_id""",
)
def review_snapshots(spark, sf):
    rows = B.snapshot_reviews(feedback(spark, sf).select("verification_id", "reviewer_label", "reviewer_note"), stored(spark, sf))
    return rows.select(
        "verification_id", "reviewer_label", "reviewer_note", "original_prediction", "anomaly_level",
        F.col("is_disagreement").cast("int").alias("is_disagreement"),
    )


def _rates(prefix: str = "", minimum: str = "m") -> str:
    p = prefix

    def rate(name: str, num: str, den: str) -> str:
        return f"CASE WHEN n >= {minimum} THEN round(({num}) / nullif({den}, 0), 4) END AS {p}{name}"

    return ", ".join(
        [
            f"CAST(n >= {minimum} AS INT) AS {p}sufficient",
            rate("genuine_precision", f"{p}tp", f"{p}tp + {p}fp"), rate("genuine_recall", f"{p}tp", f"{p}tp + {p}fn"),
            rate("genuine_f1", f"2 * {p}tp", f"2 * {p}tp + {p}fp + {p}fn"),
            rate("suspicious_precision", f"{p}tn", f"{p}tn + {p}fn"), rate("suspicious_recall", f"{p}tn", f"{p}tn + {p}fp"),
            rate("suspicious_f1", f"2 * {p}tn", f"2 * {p}tn + {p}fp + {p}fn"),
            rate("false_positive_rate", f"{p}fp", f"{p}fp + {p}tn"), rate("false_negative_rate", f"{p}fn", f"{p}fn + {p}tp"),
            rate("accuracy", f"{p}tp + {p}tn", "n"),
        ]
    )


def _cells(truth: str, pred: str, prefix: str = "") -> str:
    cells = {"tp": ("genuine", "genuine"), "fp": ("suspicious", "genuine"), "fn": ("genuine", "suspicious"), "tn": ("suspicious", "suspicious")}
    return ", ".join(f"count(*) FILTER (WHERE {truth} = '{t}' AND {pred} = '{p}') AS {prefix}{n}" for n, (t, p) in cells.items())


def _dims(dims: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        [f"SELECT *, 'overall' AS dimension, 'all' AS group_value FROM {source}"]
        + [f"SELECT *, '{d}', coalesce(nullif(trim({e}), ''), 'unknown') FROM {source}" for d, e in dims.items()]
    )


_FB_DIMS = {
    "certificate_type": "certificate_type", "issuer": "issuer", "review_status": "review_status", "review_priority": "review_priority",
    "extraction_completeness": "CASE WHEN extraction_completeness IS NULL THEN 'unknown' WHEN extraction_completeness < 0.4 THEN 'low' WHEN extraction_completeness < 0.8 THEN 'medium' ELSE 'high' END",
}


def _analysis_sql(group_minimum: int) -> str:
    return FB + f""", t AS (SELECT *, CASE reviewer_label WHEN 'confirmed_genuine' THEN 'genuine' ELSE 'suspicious' END AS truth FROM feedback_v WHERE reviewer_label <> 'uncertain'),
x AS ({_dims(_FB_DIMS, 't')}),
g AS (SELECT dimension, group_value, count(*) AS n, {_cells('truth', 'original_prediction')}, count(*) FILTER (WHERE truth <> original_prediction) AS disagreements, CASE WHEN dimension = 'overall' THEN 10 ELSE {group_minimum} END AS m FROM x GROUP BY dimension, group_value)
SELECT dimension, group_value, n, tp, fp, fn, tn, disagreements, {_rates()} FROM g"""


@query("feedback_error_analysis", _analysis_sql(5))
def feedback_error_analysis(spark, sf):
    return B.error_analysis(feedback(spark, sf)).withColumn("sufficient", F.col("sufficient").cast("int"))


@query("feedback_analytics", _analysis_sql(10))
def feedback_analytics(spark, sf):
    return B.feedback_analytics(feedback(spark, sf)).withColumn("sufficient", F.col("sufficient").cast("int"))


@query(
    "reviewed_counters",
    FB + """ SELECT 'ood_status' AS dimension, coalesce(nullif(ood_status, ''), 'unknown') AS value, count(*) AS n FROM feedback_v GROUP BY ALL
UNION ALL SELECT 'review_priority', coalesce(nullif(review_priority, ''), 'unknown'), count(*) FROM feedback_v GROUP BY ALL""",
)
def reviewed_counters(spark, sf):
    return B.reviewed_counters(feedback(spark, sf))


def pairs(spark, sf):
    f = feedback(spark, sf)
    return f.withColumns({"prediction": F.col("original_prediction"), "risk_score": F.col("original_risk_score")})


_PAIR = """p AS (SELECT *, CASE reviewer_label WHEN 'confirmed_genuine' THEN 'genuine' WHEN 'confirmed_suspicious' THEN 'suspicious' END AS truth,
  CASE assessment WHEN 'LIKELY_GENUINE' THEN 'genuine' WHEN 'LIKELY_SUSPICIOUS' THEN 'suspicious' END AS assessed FROM feedback_v),
q AS (SELECT * FROM p WHERE truth IS NOT NULL AND assessed IS NOT NULL)"""
_PAIR_DIMS = {
    "certificate_type": "certificate_type", "ood_status": "ood_status", "issuer": "issuer",
    "risk_band": "CASE WHEN original_risk_score >= 0.5 THEN 'high' WHEN original_risk_score >= 0.3 THEN 'elevated' ELSE 'low' END",
}


@query(
    "engine_vs_model",
    FB + f""", {_PAIR}, x AS ({_dims(_PAIR_DIMS, 'q')}),
g AS (SELECT dimension, group_value, count(*) AS n, {_cells('truth', 'assessed', 'engine_')}, {_cells('truth', 'original_prediction', 'model_')}, 5 AS m FROM x GROUP BY dimension, group_value)
SELECT dimension, group_value, n, {', '.join(s + c for s in ('engine_', 'model_') for c in ('tp', 'fp', 'fn', 'tn'))}, {_rates('engine_')}, {_rates('model_')} FROM g""",
)
def engine_vs_model(spark, sf):
    out = B.engine_vs_model(pairs(spark, sf))
    return out.withColumns({f"{s}_sufficient": F.col(f"{s}_sufficient").cast("int") for s in ("engine", "model")})


@query("assessment_distribution", FB + " SELECT assessment, count(*) AS n FROM feedback_v GROUP BY assessment")
def assessment_distribution(spark, sf):
    return B.assessment_distribution(pairs(spark, sf))


@query(
    "wrong_assessments",
    FB + f""", {_PAIR} SELECT verification_id, issuer, CASE WHEN truth = 'genuine' THEN 'false_negative' ELSE 'false_positive' END AS kind, truth, assessed,
  CASE WHEN truth = 'genuine' THEN CASE WHEN document_id % 2 = 0 THEN 'CONSISTENCY:FAIL; ' ELSE '' END || CASE WHEN document_id % 5 = 0 THEN 'ML:FAIL; ' ELSE '' END || 'risk=' || printf('%.3f', original_risk_score)
       ELSE CASE WHEN document_id % 2 = 1 THEN 'CONSISTENCY:PASS; ' ELSE '' END || CASE WHEN document_id % 5 <> 0 THEN 'ML:PASS; ' ELSE '' END || 'anomaly=low' END AS failure_reason
FROM q WHERE truth <> assessed""",
)
def wrong_assessments(spark, sf):
    k = F.col("document_id")
    status = F.create_map(
        F.lit("CONSISTENCY"), F.when(k % 2 == 0, "FAIL").otherwise("PASS"), F.lit("ML"), F.when(k % 5 == 0, "FAIL").otherwise("PASS")
    )
    rows = pairs(spark, sf).withColumns({"category_status": status, "anomaly_level": F.lit("low")})
    return B.wrong_assessments(rows)


_EXPECT = """e AS (SELECT verification_id, document_id, prediction, CASE WHEN risk_score >= 0.45 THEN 'suspicious' ELSE 'genuine' END AS expected, CASE document_id % 5 WHEN 0 THEN 'academic' WHEN 1 THEN 'completion' WHEN 2 THEN 'training' WHEN 3 THEN 'online' ELSE 'technical' END AS category FROM verifications_v)"""


def expected(spark, sf):
    k = F.col("document_id")
    kind = F.when(k % 5 == 0, "academic").when(k % 5 == 1, "completion").when(k % 5 == 2, "training").when(k % 5 == 3, "online").otherwise("technical")
    return stored(spark, sf).select(
        "verification_id", "document_id", "prediction",
        F.when(F.col("risk_score") >= 0.45, "suspicious").otherwise("genuine").alias("expected"), kind.alias("category"),
    )


@query(
    "external_validation",
    ctes("verifications_v") + f""", {_EXPECT}, v AS (SELECT * FROM e WHERE prediction <> 'error'), x AS ({_dims({'category': 'category'}, 'v')}),
g AS (SELECT dimension, group_value, count(*) AS n, count(*) FILTER (WHERE expected = prediction) AS n_correct, count(*) FILTER (WHERE expected = 'genuine') AS n_genuine, count(*) FILTER (WHERE expected = 'suspicious') AS n_suspicious,
  count(*) FILTER (WHERE expected = 'genuine' AND prediction = 'suspicious') AS false_positives, count(*) FILTER (WHERE expected = 'suspicious' AND prediction = 'genuine') AS false_negatives FROM x GROUP BY ALL)
SELECT *, round(n_correct / n, 4) AS accuracy, coalesce(round((n_genuine - false_positives) / nullif(n_genuine, 0), 4), 0) AS genuine_recall, coalesce(round((n_suspicious - false_negatives) / nullif(n_suspicious, 0), 4), 0) AS suspicious_recall,
  coalesce(round(false_positives / nullif(n_genuine, 0), 4), 0) AS false_positive_rate, coalesce(round(false_negatives / nullif(n_suspicious, 0), 4), 0) AS false_negative_rate FROM g""",
)
def external_validation(spark, sf):
    return B.external_validation(expected(spark, sf))


@query(
    "misclassification_causes",
    ctes("verifications_v") + f""", {_EXPECT}, w AS (SELECT *, document_id % 7 = 0 AS no_date, document_id % 3 = 0 AS no_type, document_id % 4 = 0 AS no_issuer, document_id % 2 = 0 AS bad_grade, document_id % 5 = 1 AS wording FROM e WHERE prediction <> 'error' AND prediction <> expected)
SELECT CASE WHEN expected = 'genuine' THEN CASE WHEN no_date THEN 'A' WHEN no_type OR no_issuer THEN 'C' WHEN bad_grade THEN 'E' WHEN wording THEN 'E' ELSE 'D' END WHEN wording THEN 'E' ELSE 'C' END AS cause, category, count(*) AS n FROM w GROUP BY ALL""",
)
def misclassification_causes(spark, sf):
    k = F.col("document_id")
    rows = expected(spark, sf).withColumns(
        {
            "completion_date_present": (k % 7 != 0).cast("int"), "recipient_present": F.lit(1), "issuer_present": F.lit(1),
            "certificate_type_academic": (k % 3 != 0).cast("int"), "certificate_type_completion": F.lit(0),
            "certificate_type_training": F.lit(0), "certificate_type_technical": F.lit(0), "issuer_known": (k % 4 != 0).cast("int"),
            "grade_consistency_valid": (k % 2 != 0).cast("int"), "marks_pattern_valid": F.lit(1),
            "suspicious_keyword_count": (k % 5 == 1).cast("int"), "suspicious_url_present": F.lit(0),
        }
    )
    return B.misclassified(rows).groupBy("cause", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "latest_model_runs",
    """SELECT version, run_id, stamp AS timestamp, value AS f1 FROM (SELECT 'v' || CAST(user_id % 7 AS VARCHAR) AS version, CAST(event_id AS VARCHAR) AS run_id, ts AS stamp, value, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_model_runs(spark, sf):
    e = table(spark, sf, "events")
    runs = e.select(
        F.concat(F.lit("v"), (F.col("user_id") % 7).cast("string")).alias("version"), F.col("event_id").cast("string").alias("run_id"),
        F.col("ts").alias("timestamp"), F.col("value").alias("f1"),
    )
    return latest_runs(runs)


