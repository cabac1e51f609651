"""Audit events: derived from finished documents and reviews, masked, ordered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import mask_json_values, safe_text
from .findings import yes
from .intelligence import lookup
from .skew import bucketed_rank


def severity_of(status: Column) -> Column:
    return lookup(status, C.SEVERITY_OF_STATUS, "info")


def tampering_severity(status: Column) -> Column:
    return lookup(status, {"strong_indicators": "error", "possible": "warning"}, "success")


def issuer_severity(status: Column) -> Column:
    return lookup(status, {"VERIFIED_BY_ISSUER": "success", "NOT_VERIFIED": "error", "ISSUER_UNKNOWN": "unknown"}, "warning")


def code_severity(state: Column) -> Column:
    return lookup(state, {"VERIFIED_BY_ISSUER": "success", "NOT_VERIFIED": "error", "NO_CODE": "info"}, "warning")


def assessment_severity(assessment: Column) -> Column:
    return lookup(
        assessment,
        {"LIKELY_SUSPICIOUS": "error", "REQUIRES_VERIFICATION": "warning", "INSUFFICIENT_EVIDENCE": "warning"},
        "success",
    )


def review_severity(label: Column) -> Column:
    return lookup(label, {"confirmed_genuine": "success", "uncertain": "warning", "confirmed_suspicious": "error"}, "info")


def prepare_events(events: DataFrame) -> DataFrame:
    """Fill severity, shorten title and description, mask identifiers in details."""
    given = F.col("severity") if "severity" in events.columns else F.lit(None).cast("string")
    return events.withColumns(
        {
            "severity": F.coalesce(given, severity_of(F.col("status"))),
            "title": F.coalesce(safe_text(F.col("title"), 200), F.col("event_type")),
            "description": safe_text(F.col("description")),
            "details": mask_json_values(F.coalesce(F.col("details"), F.lit("{}"))),
        }
    )


@dataclass
class Event:
    kind: str
    stage: str
    title: str
    severity: Column | str
    description: Column
    details: Column
    status: str = "completed"
    when: Column | None = None


def document_events(df: DataFrame, key: str = "document_id") -> DataFrame:
    """Up to thirteen events per finished document, in stage order.

    The kinds that apply are one short array on the row and exploded once; description and details are worked out on the
    event's own row, so nobody pays for them who does not select them. Provider events appear when
    their columns exist; a degraded document gets the failure event instead.
    """
    has = set(df.columns)
    n_text = F.col("extracted_text_length")

    def num(col: Column) -> Column:
        return col.cast("string")

    events = [
        Event("DOCUMENT_RECEIVED", "ingestion", "Document received", "success",
              F.concat(F.lit("Received document "), F.col(key).cast("string")), F.struct(n_text.alias("file_size"))),
        Event("TEXT_EXTRACTION", "extraction", "Text extraction completed", "success",
              F.concat(F.lit("Extracted characters: "), num(n_text)),
              F.struct(F.col("extraction_method").alias("method"), n_text.alias("text_length"), F.col("extraction_confidence").alias("confidence"))),
        Event("FEATURE_EXTRACTION", "feature_extraction", "Feature vector built", "success",
              F.lit(f"Built {len(C.FEATURE_COLUMNS)} features."), F.struct(F.lit(len(C.FEATURE_COLUMNS)).alias("feature_count"))),
        Event("ML_ANALYSIS", "ml_analysis", "Model analysis completed", "success",
              F.concat(F.lit("Prediction: "), F.col("prediction")),
              F.struct("prediction", F.round("risk_score", 4).alias("risk_score"), F.round("confidence", 4).alias("confidence"))),
        Event("INTELLIGENCE_ANALYSIS", "intelligence", "Intelligence analysis completed", "success",
              F.concat(F.lit("Review status: "), F.col("review_status")),
              F.struct("review_status", "structure_completeness", F.size("trust_signals").alias("positive_signals"), F.size("risk_signals").alias("risk_signals"))),
        Event("CONSISTENCY_ANALYSIS", "intelligence", "Consistency analysis completed",
              F.when(F.col("high_findings") > 0, "error").otherwise("success"),
              F.concat(F.lit("Consistency findings: "), num(F.size("findings"))),
              F.struct(F.size("findings").alias("finding_count"), F.col("high_findings").alias("high_severity_count"))),
    ]
    if "forensic_anomalies" in has:
        n = F.size("forensic_anomalies")
        events.append(Event("FORENSICS_ANALYSIS", "analysis", "Forensics analysis", F.when(n > 0, "warning").otherwise("success"), F.concat(F.lit("Anomalies: "), num(n)), F.struct(n.alias("anomaly_count"))))
    if "visual_anomalies" in has:
        n = F.size("visual_anomalies")
        events.append(Event("VISUAL_ANALYSIS", "analysis", "Visual analysis", "success", F.lit("Visual features analyzed."), F.struct(n.alias("anomaly_count"))))
    if "tampering_status" in has:
        events.append(Event("TAMPERING_ANALYSIS", "analysis", "Tampering assessment", tampering_severity(F.col("tampering_status")), F.concat(F.lit("Tampering: "), F.col("tampering_status")), F.struct(F.col("tampering_status").alias("status"))))
    if "issuer_verification" in has:
        events.append(Event("ISSUER_ANALYSIS", "analysis", "Issuer verification analysis", issuer_severity(F.col("issuer_verification")), F.concat(F.lit("Issuer check: "), F.col("issuer_verification")), F.struct(F.col("issuer_verification").alias("status"), F.col("organization").alias("issuer"))))
    if "code_state" in has:
        events.append(Event("VERIFICATION_CODE_ANALYSIS", "analysis", "Verification-code analysis", code_severity(F.col("code_state")), F.concat(F.lit("Code state: "), F.col("code_state")), F.struct(F.col("code_state").alias("state"), F.size("verification_codes").alias("code_count"))))
    degraded = yes(F.col("evidence_degraded")) if "evidence_degraded" in has else F.lit(False)
    events += [
        Event("PIPELINE_FAILED", "analysis", "Evidence degraded", "warning", F.lit("Evidence providers failed."), F.struct(degraded.alias("degraded")), status="failed", when=degraded),
        Event("EVIDENCE_FUSION", "fusion", "Evidence fusion", assessment_severity(F.col("assessment")),
              F.concat(F.lit("Assessment: "), F.col("assessment")), F.struct("assessment", "decision", F.col("decision_confidence").alias("confidence"))),
        Event("FINAL_DECISION", "decision", "Final decision", assessment_severity(F.col("assessment")),
              F.concat(F.lit("Decision: "), F.col("decision")), F.struct("decision")),
    ]
    body = [
        F.struct(F.lit(n).alias("_event"), (e.severity if isinstance(e.severity, Column) else F.lit(e.severity)).alias("severity"))
        for n, e in enumerate(events)
    ]
    kinds = F.array_compact(F.array(*[b if e.when is None else F.when(e.when, b) for b, e in zip(body, events, strict=True)]))
    exploded = df.select("*", F.posexplode(kinds).alias("_seq", "_e"))

    def by_event(values: list[Column]) -> Column:
        rule = F
        for n, value in enumerate(values):
            rule = rule.when(F.col("_e._event") == n, value)
        return rule

    rows = exploded.select(
        F.col(key).alias("verification_id"), F.col("_seq").alias("seq"),
        *[by_event([F.lit(getattr(e, c)) for e in events]).alias(name) for c, name in (("kind", "event_type"), ("stage", "stage"), ("status", "status"))],
        F.col("_e.severity").alias("severity"), by_event([F.lit(e.title) for e in events]).alias("title"),
        by_event([e.description for e in events]).alias("description"), by_event([F.to_json(e.details) for e in events]).alias("details"),
    )
    return prepare_events(rows)


def review_events(feedback: DataFrame) -> DataFrame:
    details = F.struct("reviewer_label", "is_disagreement", "original_prediction", "original_risk_score", "model_version")
    rows = feedback.select(
        "verification_id", F.lit("REVIEW_ACTION").alias("event_type"), F.lit("review").alias("stage"),
        F.lit("recorded").alias("status"), review_severity(F.col("reviewer_label")).alias("severity"),
        F.lit("Review decision recorded").alias("title"),
        F.concat(F.lit("Reviewer decision: "), F.col("reviewer_label")).alias("description"),
        F.to_json(details).alias("details"),
    )
    return prepare_events(rows)


def timeline(events: DataFrame, *, key: str = "verification_id", seq: str = "seq", bucket: int = 100_000) -> DataFrame:
    """Number the events of each verification from the oldest, in sequence order."""
    return bucketed_rank(events, [key], F.floor(F.col(seq) / bucket), [F.col(seq)], out="event_number")


def event_counts(verifications: DataFrame, events: DataFrame, key: str = "verification_id") -> DataFrame:
    """Events per verification and whether it had started at all."""
    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return verifications.select(key).join(counts, key, "left").select(
        key, F.coalesce("_n", F.lit(0)).alias("event_count"), F.col("_n").isNotNull().alias("started")
    )


