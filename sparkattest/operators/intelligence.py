"""Types, signals, review status, out-of-distribution status and review priority."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions.scores import confidence_level
from ..functions.semantics import credential_statement_present
from .consistency import consistency, consistency_rules, with_wording
from .findings import Rule, any_key, any_rule, as_array, count_of, severity_count, yes


def with_type_flags(df: DataFrame, text: str = "text", issuer: str = "organization") -> DataFrame:
    """Add six type flag columns and the credential statement."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    low_issuer = F.lower(F.coalesce(F.col(issuer), F.lit("")))
    flags = T.type_flag_columns(F.col("_low"), F.col("_low_issuer"))
    lowered = df.withColumns({"_low": low, "_low_issuer": low_issuer})
    return lowered.withColumns(
        {
            **{f"type_{name}": flags[name] for name in C.TYPE_PRECEDENCE},
            "credential_statement": credential_statement_present(F.col("_low")),
        }
    ).drop("_low", "_low_issuer")


def with_types(df: DataFrame, text: str = "text", issuer: str = "organization", *, marked: bool = False) -> DataFrame:
    """Add the type flags, their map, the primary type and the credential statement."""
    with_flags = df if marked else with_type_flags(df, text, issuer)
    stored = {name: F.col(f"type_{name}") for name in C.TYPE_PRECEDENCE}
    pairs = [x for name, col in stored.items() for x in (F.lit(name), col)]
    return with_flags.withColumns(
        {"type_flags": F.create_map(*pairs), "primary_type": T.primary_type(stored)}
    )


def has_text(text: str = "text") -> Column:
    return F.trim(F.coalesce(F.col(text), F.lit(""))) != ""


def with_text_marks(df: DataFrame) -> DataFrame:
    """Everything that the advisory rules and the features take from the text of extracted documents.

    After it the text is not needed any more: pass `marked=True` to `intelligence` and `build_features`.
    """
    return with_type_flags(with_wording(df)).withColumn("text_present", has_text())


def with_quality(df: DataFrame, text: str = "text", *, marked: bool = False) -> DataFrame:
    """Quality indicators from text presence and upstream image statistics."""

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    blank, color = number("visual_blank_ratio"), number("visual_color_anomaly") != 0
    present = F.col("text_present") if marked else has_text(text)
    failed = yes(F.col("ocr_failed")) if "ocr_failed" in df.columns else F.lit(False)
    return df.withColumns(
        {
            "text_present": present,
            "blank_document": ~present & (blank < 0.02),
            "text_extraction_quality": F.when(present, "ok").when(failed, "failed").otherwise("missing"),
            "visual_quality": F.when((blank < 0.5) & ~color, "ok").otherwise("attention"),
            "color_anomaly": color,
            "quality_noise": F.round(number("visual_noise"), 4),
            "quality_sharpness": F.round(number("visual_sharpness"), 4),
        }
    )


def trust_rules() -> list[Rule]:
    def ok(key: str, label: str, when: Column, detail: Column) -> Rule:
        return Rule(key, label, "low", when, detail, status="ok")

    return [
        ok("recognized_issuer", "Recognized issuer", F.col("issuer_status") == "ok", F.col("organization")),
        ok("recipient_extracted", "Recipient extracted", F.col("recipient_status") == "ok", F.col("candidate_name")),
        ok("consistent_date", "Consistent date", F.col("date_status") == "ok", F.col("issue_day")),
        ok("valid_certificate_id", "Valid certificate ID", F.col("certificate_id_status") == "ok", F.col("cert_id")),
        ok("valid_structure", "Valid certificate structure", F.col("structure_completeness") >= 0.6,
           F.col("structure_completeness")),
        ok("course_detected", "Course detected", F.col("course_status") == "ok", F.col("course")),
        ok("certificate_type_detected", "Certificate type detected", F.col("primary_type") != "unknown",
           F.col("primary_type")),
        ok("marks_detected", "Marks / grade present",
           F.col("marks_obtained").isNotNull() | T.present(F.col("grade")), F.lit("Marks or a grade were found.")),
    ]


def extra_risk_rules() -> list[Rule]:
    """Risk signals added after the consistency findings, in order."""
    low_confidence = (
        yes(F.col("ocr_failed")) | ~F.col("text_present")
        | yes(F.col("extraction_confidence") < 0.4) | (F.col("extraction_method") == "none")
    )
    return [
        Rule("unknown_issuer", "Unknown issuer", "medium", F.col("issuer_status") == "warning",
             F.concat(F.lit("Issuer may need verification elsewhere: "), F.col("organization"))),
        Rule("missing_text", "Missing document text", "medium", ~F.col("text_present"),
             F.lit("No text was extracted.")),
        Rule("visual_quality", "Poor visual quality", "medium", F.col("visual_quality") == "attention",
             F.lit("Unusual ink coverage or color profile.")),
        Rule("low_extraction_confidence", "Low extraction confidence", "medium", low_confidence,
             F.concat(F.lit("Extraction confidence: "),
                      confidence_level(F.col("extraction_confidence"), missing="unknown"))),
    ]


def with_signals(df: DataFrame) -> DataFrame:
    """Add `trust_signals` and `risk_signals` (findings first, then quality)."""
    return df.withColumns(
        {
            "trust_signals": as_array(trust_rules()),
            "risk_signals": F.concat("findings", as_array(extra_risk_rules())),
        }
    )


def review_status(prediction: Column, risk: Column, high: Column, medium: Column) -> Column:
    return (
        F.when((prediction == "suspicious") | (risk >= C.HIGH_RISK), "high_risk")
        .when((risk >= C.ELEVATED_RISK) | (high > 0) | (medium >= 2), "manual_review")
        .otherwise("low_risk")
    )


def lookup(col: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """A small fixed dictionary as a chain of conditions."""
    rule = F
    for key, value in mapping.items():
        rule = rule.when(col == key, F.lit(value))
    return rule.otherwise(F.lit(default))


def recommended_action(status: Column) -> Column:
    return lookup(status, C.ACTION_OF_REVIEW_STATUS, "manual_review")


def unusual_types(academic: Column, online: Column, workshop: Column, suspicious: Column | None = None) -> Column:
    combined = ((academic > 0) & (online > 0)) | ((academic > 0) & (workshop > 0))
    return combined if suspicious is None else combined | ((online > 0) & suspicious)


def ood_status(completeness: Column, keyword_count: Column, url_present: Column) -> Column:
    """normal / unusual / insufficient_information over the intelligence columns."""
    unusual = (
        (F.col("primary_type") == "unknown")
        | (F.col("structure_completeness") < 0.4)
        | (F.col("issuer_status") == "warning")
        | unusual_types(F.col("type_academic"), F.col("type_online"), F.col("type_workshop"))
        | F.col("blank_document")
        | (F.col("color_anomaly") & ~F.col("text_present"))
        | (F.col("high_findings") > 0)
        | ((keyword_count > 0) & (url_present > 0))
    )
    return (
        F.when(~F.col("text_present") & (completeness < 0.2), "insufficient_information")
        .when(unusual, "unusual").otherwise("normal")
    )


def review_priority(
    risk: Column, status: Column, findings: Column | None, is_duplicate: Column, ood: Column,
    completeness: Column, structure: Column,
) -> Column:
    """high / medium / low; without `findings` the rules are read from the row's own columns."""
    if findings is None:
        serious = F.col("high_findings") + F.col("medium_findings")
    else:
        serious = severity_count(findings, "high") + severity_count(findings, "medium")

    def any_of(keys: list[str]) -> Column:
        return any_rule(consistency_rules(), keys) if findings is None else any_key(findings, keys)

    return (
        F.when(
            yes(is_duplicate) | (status == "high_risk") | (risk >= C.HIGH_RISK)
            | any_of(C.HIGH_PRIORITY_KEYS) | (ood == "unusual") | (structure < 0.4),
            "high",
        )
        .when(
            (risk >= C.ELEVATED_RISK) | (status == "manual_review") | (serious >= 2)
            | any_of(C.MEDIUM_PRIORITY_KEYS) | (ood == "insufficient_information")
            | (completeness < 0.6),
            "medium",
        )
        .otherwise("low")
    )


def intelligence(
    df: DataFrame, *, as_of: dt.date, known_issuer: Column | None = None,
    max_year: int = C.MAX_ISSUE_YEAR, marked: bool = False,
) -> DataFrame:
    """Extracted documents with every advisory column; one narrow stage.

    `marked` is for tables that carry the columns of `with_text_marks`, with or without the text.
    """
    checked = consistency(df, as_of=as_of, known_issuer=known_issuer, max_year=max_year, marked=marked)
    return with_signals(with_quality(with_types(checked, marked=marked), marked=marked))


def with_review(df: DataFrame) -> DataFrame:
    """Review status, action, OOD status and priority; needs prediction and risk_score.

    Uses `is_duplicate` when the table has it. Rows with the columns of `intelligence` are judged by its rules;
    tables that store only the arrays of findings and signals by these.
    """
    analyzed = {"marks_ok", "labeled_id", "high_findings", "medium_findings"} <= set(df.columns)
    if analyzed:
        extra = extra_risk_rules()
        high, medium = (F.col(f"{s}_findings") + count_of(extra, s) for s in ("high", "medium"))
    else:
        high, medium = (severity_count(F.col("risk_signals"), s) for s in ("high", "medium"))
    duplicate = F.col("is_duplicate") if "is_duplicate" in df.columns else F.lit(False)
    staged = df.withColumns(
        {
            "review_status": review_status(
                F.col("prediction"), F.col("risk_score"), high, medium,
            ),
            "ood_status": ood_status(
                F.col("extraction_completeness"), F.col("keyword_count"), F.col("url_marker").cast("int"),
            ),
        }
    )
    return staged.withColumns(
        {
            "recommended_action": recommended_action(F.col("review_status")),
            "review_priority": review_priority(
                F.col("risk_score"), F.col("review_status"), None if analyzed else F.col("findings"), duplicate,
                F.col("ood_status"), F.col("extraction_completeness"), F.col("structure_completeness"),
            ),
        }
    )


def intelligence_record(df: DataFrame) -> DataFrame:
    """Nest the advisory columns into one `intelligence` struct per document."""
    fields = {
        "recipient": "candidate_name", "issuer": "organization", "course": "course",
        "issue_date": "issue_date", "certificate_id": "cert_id",
    }
    identity = F.struct(
        *[
            F.struct(F.col(c).alias("value"), T.present(F.col(c)).alias("present")).alias(name)
            for name, c in fields.items()
        ]
    )
    structural = F.struct(
        *[yes(F.col(f"has_{m}")).alias(m) for m in ("signature", "seal", "qr", "url")]
    )
    quality = F.struct(
        *[
            F.col(c)
            for c in (
                "text_present", "blank_document", "text_extraction_quality", "visual_quality",
                "quality_noise", "quality_sharpness", "color_anomaly",
            )
        ]
    )
    record = F.struct(
        F.struct(F.col("type_flags").alias("flags"), F.col("primary_type").alias("primary")).alias("certificate_type"),
        identity.alias("identity"), structural.alias("structural_signals"),
        quality.alias("quality_indicators"), F.col("findings").alias("consistency_findings"),
        F.col("checks").alias("consistency_checks"), F.col("structure_completeness"),
        *[
            F.col(c)
            for c in (
                "issuer_status", "certificate_id_status", "date_status", "recipient_status",
                "course_status",
            )
        ],
    )
    return df.withColumn("intelligence", record)


def explanation(df: DataFrame) -> DataFrame:
    """Long table of trust then risk signals: one row per document and signal."""
    return df.select(
        "document_id", F.posexplode(F.concat("trust_signals", "risk_signals")).alias("position", "signal")
    ).select("document_id", "position", "signal.*")
