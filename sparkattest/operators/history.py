"""Stored verifications: filters, listings, dashboards, JSON columns, status names."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import constants as C
from ..functions.scores import fraction_present
from ..functions.text import present
from .findings import yes
from .intelligence import lookup

FLAG_TYPE = "map<string,int>"
FIELDS_TYPE = ST.StructType([ST.StructField(c, ST.StringType()) for c in C.CORE_FIELDS])


def parse_flags(raw: Column) -> Column:
    """Type flags from JSON text; anything but an object becomes an empty map."""
    return F.coalesce(F.from_json(raw, FLAG_TYPE, {"mode": "PERMISSIVE"}), F.create_map().cast(FLAG_TYPE))


def parse_fields(raw: Column) -> Column:
    """Core fields from JSON text as a struct of nullable strings."""
    empty = F.struct(*[F.lit(None).cast("string").alias(c) for c in C.CORE_FIELDS])
    return F.coalesce(F.from_json(raw, FIELDS_TYPE, {"mode": "PERMISSIVE"}), empty)


def parse_object(raw: Column) -> Column:
    """Open-schema JSON as VARIANT; NULL unless it is a JSON object."""
    value = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def stored_completeness(raw: Column) -> Column:
    parsed = parse_fields(raw)
    return F.round(fraction_present(*[parsed[c] for c in C.CORE_FIELDS]), 4)


def stored_primary_type(raw: Column) -> Column:
    """First raised flag of a stored JSON flag object; NULL when none is."""
    flags = parse_flags(raw)
    rule = F
    for name in C.TYPE_PRECEDENCE:
        rule = rule.when(F.coalesce(F.element_at(flags, name), F.lit(0)) > 0, F.lit(name))
    return rule.otherwise(F.lit(None).cast("string"))


def successful(df: DataFrame) -> DataFrame:
    return df.filter(F.col("prediction") != "error")


def filter_history(
    df: DataFrame, *, user_id: str | None = None, prediction: str | None = None,
    review_status: str | None = None, issuer: str | None = None, filename: str | None = None,
    risk_min: float | None = None, risk_max: float | None = None, date_from: str | None = None,
    date_to: str | None = None, certificate_type: str | None = None, literal_search: bool = False,
) -> DataFrame:
    """The history filters. `date_to` includes the whole day; bad dates are ignored.

    Every condition except the type flag reaches the file scan as a pushed filter.
    """

    def day(text: str | None) -> dt.date | None:
        try:
            return dt.date.fromisoformat(text[:10]) if text else None
        except ValueError:
            return None

    def search(column: str, text: str) -> Column:
        if literal_search:
            return F.lower(F.col(column)).contains(text.lower())
        return F.col(column).ilike(f"%{text}%")

    out = df
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    if prediction:
        out = out.filter(F.col("prediction") == prediction)
    if review_status:
        out = out.filter(F.col("review_status") == review_status)
    if issuer:
        out = out.filter(search("issuer", issuer))
    if filename:
        out = out.filter(search("filename", filename))
    if risk_min is not None:
        out = out.filter(F.col("risk_score") >= risk_min)
    if risk_max is not None:
        out = out.filter(F.col("risk_score") <= risk_max)
    if (start := day(date_from)) is not None:
        out = out.filter(F.col("created_at") >= F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz"))
    if (end := day(date_to)) is not None:
        after = dt.datetime.combine(end + dt.timedelta(days=1), dt.time())
        out = out.filter(F.col("created_at") < F.lit(after).cast("timestamp_ntz"))
    if certificate_type:
        out = out.filter(F.coalesce(F.element_at(parse_flags(F.col("certificate_type")), certificate_type), F.lit(0)) > 0)
    return out


LISTING = [
    "verification_id", "filename", "prediction", "risk_score", "confidence", "model_version",
    "created_at", "review_status", "issuer", "certificate_type", "duplicate_of", "duplicate_type",
    "ood_status", "review_priority",
]
REVIEW_COLUMNS = ["reviewer_label", "reviewed_at", "is_disagreement"]


def listing(df: DataFrame, feedback: DataFrame) -> DataFrame:
    """Listing record with the three review columns where a review exists."""
    reviews = feedback.select("verification_id", *REVIEW_COLUMNS)
    return df.select(*LISTING).join(reviews, "verification_id", "left")


def newest(df: DataFrame, limit: int = 20, *, ascending: bool = False) -> DataFrame:
    """The newest (or oldest) rows, 1 to 100, with the id as tiebreak."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    keys = ["created_at", "verification_id"]
    order = [F.col(k).asc() if ascending else F.col(k).desc() for k in keys]
    return df.orderBy(*order).limit(limit)


def detail(df: DataFrame) -> DataFrame:
    """Detail record: a column wins over the same value inside the stored JSON."""
    snapshot = F.from_json(
        F.col("intelligence_json"),
        "struct<ood_status:string,review_priority:string,duplicate_of:string,primary_type:string>",
        {"mode": "PERMISSIVE"},
    )
    staged = df.withColumn("_s", snapshot)
    return staged.withColumns(
        {
            "ood_status": F.coalesce(F.nullif("ood_status", F.lit("")), F.col("_s.ood_status")),
            "review_priority": F.coalesce(F.nullif("review_priority", F.lit("")), F.col("_s.review_priority")),
            "primary_type": F.col("_s.primary_type"),
        }
    ).drop("_s")


def snapshot_features(df: DataFrame, features: DataFrame | None = None, key: str = "verification_id") -> DataFrame:
    """The stored feature vector, else the recomputed one, else features_available=false.

    `features` is a recomputed feature table keyed like `df`.
    """
    struct = "struct<features:struct<" + ",".join(f"{c}:double" for c in C.FEATURE_COLUMNS) + ">>"
    staged = df.withColumn("_stored", F.from_json("intelligence_json", struct, {"mode": "PERMISSIVE"})["features"])
    if features is not None:
        again = features.select(key, F.struct(*[F.col(c).cast("double").alias(c) for c in C.FEATURE_COLUMNS]).alias("_again"))
        staged = staged.join(again, key, "left").withColumn("_stored", F.coalesce("_stored", "_again")).drop("_again")
    keep = [c for c in df.columns if c not in C.FEATURE_COLUMNS]
    return staged.select(
        *keep, F.col("_stored").isNotNull().alias("features_available"),
        *[F.col(f"_stored.{c}").alias(c) for c in C.FEATURE_COLUMNS],
    )


def evidence_snapshot(raw: Column) -> dict[str, Column]:
    return {
        "final_assessment": F.get_json_object(raw, "$.verification_evidence.assessment"),
        "anomaly_score": F.get_json_object(raw, "$.anomaly.score").try_cast("double"),
        "anomaly_level": F.get_json_object(raw, "$.anomaly.level"),
    }


def error_rows(df: DataFrame, failed: Column) -> DataFrame:
    """Failed inputs stay as rows with prediction 'error' and zero scores."""
    bad = yes(failed)
    return df.withColumns(
        {
            "prediction": F.when(bad, "error").otherwise(F.col("prediction")),
            "risk_score": F.when(bad, 0.0).otherwise(F.col("risk_score")),
            "confidence": F.when(bad, 0.0).otherwise(F.col("confidence")),
        }
    )


def metric_aggregates() -> list[Column]:
    """Dashboard scalars as plain aggregates, reused by batch and streaming jobs."""
    ok = F.col("prediction") != "error"
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("prediction") == "genuine").alias("genuine_count"),
        F.count_if(F.col("prediction") == "suspicious").alias("suspicious_count"),
        F.count_if(F.col("prediction") == "error").alias("error_count"),
        F.coalesce(F.round(F.avg(F.when(ok, F.col("risk_score"))), 4), F.lit(0.0)).alias("average_risk_score"),
        F.coalesce(F.round(F.avg(F.when(ok, F.col("confidence"))), 4), F.lit(0.0)).alias("average_confidence"),
    ]


def dashboard(df: DataFrame) -> DataFrame:
    ok = F.col("prediction") != "error"
    row = df.agg(
        *metric_aggregates(),
        F.count_if(ok & (F.col("review_status") == "manual_review")).alias("manual_review_count"),
        F.coalesce(F.round(F.avg(F.when(ok, stored_completeness(F.col("extracted_info")))), 4), F.lit(0.0)).alias("average_completeness"),
    )
    good = F.col("total") - F.col("error_count")
    return row.withColumn(
        "manual_review_rate", F.coalesce(F.round(F.try_divide("manual_review_count", good), 4), F.lit(0.0))
    )


def history_summary(df: DataFrame) -> DataFrame:
    ok = F.col("prediction") != "error"
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("prediction") == "genuine").alias("genuine"),
        F.count_if(F.col("prediction") == "suspicious").alias("suspicious"),
        F.count_if(ok & (F.col("review_status") == "manual_review")).alias("manual_review"),
        F.coalesce(F.round(F.avg(F.when(ok, F.col("risk_score"))), 4), F.lit(0.0)).alias("average_risk_score"),
    )


def distribution_pairs() -> Column:
    """The (dimension, value) pairs of a stored row, as an array.

    Model versions include error rows; the other dimensions do not.
    """
    ok = F.col("prediction") != "error"

    def pair(name: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value")))

    issuer = F.trim(F.coalesce(F.col("issuer"), F.lit("")))
    raised = F.map_keys(F.map_filter(parse_flags(F.col("certificate_type")), lambda k, v: v > 0))
    pairs = F.array_compact(
        F.array(
            pair("prediction", F.col("prediction"), ok),
            pair("review_status", F.coalesce("review_status", F.lit("low_risk")), ok),
            pair("model_version", F.col("model_version"), F.lit(True)),
            pair("issuer", issuer, ok & (issuer != "")),
        )
    )
    flags = F.when(
        ok, F.transform(raised, lambda k: F.struct(F.lit("certificate_type").alias("dimension"), k.alias("value")))
    ).otherwise(F.array().cast("array<struct<dimension:string,value:string>>"))
    return F.concat(pairs, flags)


def distributions(df: DataFrame) -> DataFrame:
    """Rows per prediction, review status, model version, issuer and raised type flag.

    One scan: each row becomes its few (dimension, value) pairs, counted map-side.
    """
    return (
        df.select(F.explode(distribution_pairs()).alias("p")).select("p.*")
        .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def top_issuers(df: DataFrame, n: int = 15) -> DataFrame:
    named = successful(df).filter(present(F.col("issuer")))
    return named.groupBy("issuer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issuer").limit(n)


def case_status(assessment: Column, review: Column, prediction: Column) -> Column:
    """One case status from assessment, else review status, else prediction."""
    return F.coalesce(
        lookup(assessment, {
            "LIKELY_GENUINE": "verified", "LIKELY_SUSPICIOUS": "suspicious",
            "REQUIRES_VERIFICATION": "requires_verification", "INSUFFICIENT_EVIDENCE": "insufficient_evidence",
        }),
        lookup(review, {"low_risk": "verified", "manual_review": "requires_verification", "high_risk": "suspicious"}),
        lookup(prediction, {"genuine": "verified", "suspicious": "suspicious", "error": "error"}),
    )


# Display names of case statuses.
CASE_LABELS = {
    "verified": "Verified", "requires_verification": "Requires Verification", "suspicious": "Suspicious",
    "insufficient_evidence": "Insufficient Evidence", "error": "Error",
}


def case_label(status: Column) -> Column:
    return lookup(status, CASE_LABELS)


def normalize_severity(value: Column, keep_low: bool = True) -> Column:
    """Map free severities to a fixed scale; 'low' survives unless parity is wanted."""
    low = F.lower(F.coalesce(value, F.lit("")))
    rule = F.when(low == "critical", "critical").when(low == "high", "high").when(low.isin("medium", "warn", "warning"), "medium")
    return (rule.when(low == "low", "low") if keep_low else rule).otherwise("unknown")


def findings_table(df: DataFrame, key: str = "document_id") -> DataFrame:
    """All nested findings as one long table (group, position, key, label, severity).

    The arrays are joined on the row and exploded once: one scan, no union.
    """
    groups = {
        "forensic_anomalies": ("Document forensics", "key"), "tampering_findings": ("Tampering analysis", "kind"),
        "risk_signals": ("Risk signals", "key"), "findings": ("Identity consistency", "key"),
        "visual_anomalies": ("Visual analysis", "key"),
    }

    def rows(column: str) -> Column:
        name, id_field = groups[column]
        return F.transform(
            F.col(column),
            lambda a, i: F.struct(
                F.lit(name).alias("finding_group"), i.alias("position"), a[id_field].alias("finding_key"),
                a["label"].alias("label"), normalize_severity(a["severity"]).alias("severity"),
            ),
        )

    def single(on: Column, group: str, name: str, label: str, severity: str) -> Column:
        item = F.struct(
            F.lit(group).alias("finding_group"), F.lit(0).alias("position"), F.lit(name).alias("finding_key"),
            F.lit(label).alias("label"), F.lit(severity).alias("severity"),
        )
        return F.array_compact(F.array(F.when(yes(on), item)))

    parts = [rows(c) for c in groups if c in df.columns]
    if "qr_status" in df.columns:
        parts.append(single(F.col("qr_status") == "invalid_qr", "QR analysis", "qr-invalid", "Invalid QR code", "medium"))
        found = ["verified_externally", "verification_page_found", "verification_unavailable"]
        parts.append(single(F.col("qr_status").isin(found), "QR analysis", "qr-present", "QR code present", "low"))
    if "blank_document" in df.columns:
        parts.append(single(F.col("blank_document"), "Document quality", "blank-doc", "Blank or near-empty document", "medium"))
    if "ocr_failed" in df.columns:
        parts.append(single(F.col("ocr_failed"), "Document extraction", "ocr-failed", "OCR failed", "medium"))
    return df.select(key, F.explode(F.concat(*parts)).alias("f")).select(key, "f.*")


def retention_excess(files: DataFrame, keep: int = 200) -> DataFrame:
    """Files beyond the newest `keep`, as a delete list.

    The kept set is a top-k and its size is fixed, so it is broadcast for the anti join.
    """
    newest_files = files.orderBy(F.col("modified_at").desc(), F.col("path").desc()).limit(keep).select("path")
    return files.join(F.broadcast(newest_files), "path", "left_anti")
