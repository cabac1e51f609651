"""Documents with text in, documents with identity fields and quality columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import fields as X
from ..functions import scores as S
from ..functions import text as T

FIELD_COLUMNS = [
    "cert_id", "candidate_name", "organization", "course", "issue_date", "marks_total",
    "marks_obtained", "grade", "has_signature", "has_seal", "has_qr", "has_url",
    "certificate_title", "verification_codes", "has_verification_code",
]


def extract_fields(
    df: DataFrame, text: str = "text", *, allow_bare_name: bool = False, org_guard: bool = True,
    strict_grade: bool = False,
) -> DataFrame:
    """Add the fifteen identity fields. One narrow stage, no shuffle, no Python.

    `allow_bare_name` turns on the fallbacks for text recovered from images.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in df.columns if c not in FIELD_COLUMNS]
    base = df.select(
        *keep, raw.alias("_text"), F.lower(raw).alias("_low"), T.split_lines(raw).alias("_lines")
    )
    body, low, lines, kinds = F.col("_text"), F.col("_low"), F.col("_lines"), F.col("_kinds")
    # Each stage reads values of the stage before it, so no search runs twice.
    grade_pattern = C.GRADE_IN_TEXT_STRICT if strict_grade else C.GRADE_IN_TEXT
    searches = {
        "_cert": ("cert_id", C.CERT_ID_IN_TEXT, 0), "_name": ("name", C.NAME_AFTER_PHRASE, 1), "_label": ("label", C.ISSUER_LABEL, 1),
        "_marker": ("marker", C.ISSUER_MARKER, 1), "_marks": ("marks", C.MARKS_IN_TEXT, 0), "_grade": ("grade", grade_pattern, 1),
    }
    found = base.select(
        "*", X.line_kinds(low, lines).alias("_kinds"), X.date_hit(body).alias("_date"),
        *[X.searched(gate, low, body, pattern, group).alias(name) for name, (gate, pattern, group) in searches.items()],
        *[flag.alias(name) for name, flag in X.presence_flags(low).items()],
        F.when(T.contains_any(low, X.GATES["codes"]), X.verification_codes(body)).alias("_codes"),
    )
    no_codes = F.array().cast("array<struct<label:string,code:string,kind:string>>")
    hits = found.select(
        *[c for c in found.columns if c not in searches],
        F.upper(F.nullif("_cert", F.lit(""))).alias("cert_id"), F.upper(F.nullif("_grade", F.lit(""))).alias("grade"),
        F.trim(F.nullif("_name", F.lit(""))).alias("_name"),
        *[F.nullif(c, F.lit("")).alias(c) for c in ("_label", "_marker", "_marks")],
        X.first_title_line(kinds).alias("_title_at"), X.certificate_title(lines, kinds).alias("certificate_title"),
        F.coalesce("_codes", no_codes).alias("verification_codes"),
    )
    obtained, total = X.marks(F.col("_marks"))
    bare = X.bare_name(lines, org_guard)
    if not allow_bare_name:
        bare = F.when(F.col("_title_at") > 0, bare)
    parsed = hits.select(
        "*",
        X.clean_issuer(F.col("_label")).alias("_label_issuer"), X.clean_issuer(F.col("_marker")).alias("_marker_issuer"),
        X.date_iso(F.col("_date")).alias("issue_date"),
        total.alias("marks_total"), obtained.alias("marks_obtained"),
        F.coalesce("_name", X.name_before_verb(body, low), bare).alias("candidate_name"),
    )
    named = parsed.withColumn(
        "organization", X.issuer(F.col("_label_issuer"), F.col("_marker_issuer"), low, lines, kinds)
    )
    who = (F.col("candidate_name"), F.col("organization"))
    course = F.coalesce(
        X.course_above_title(lines, F.col("_title_at"), *who), X.course_phrase(low, body), X.course_keyword(low)
    )
    if allow_bare_name:
        course = F.coalesce(course, X.course_longest_line(lines, *who))
    return named.withColumn("course", course).select(
        *keep, *[c for c in FIELD_COLUMNS if c != "has_verification_code"],
        (F.size("verification_codes") > 0).alias("has_verification_code"),
    )


def with_extraction_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Method, confidence, completeness and length of a text-layer extraction."""
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    scored = df.withColumn("extraction_completeness", S.core_completeness())
    has_text = body != ""
    enough = S.text_sufficient(F.col(text), F.col("extraction_completeness"))
    return scored.withColumns(
        {
            "extraction_method": F.when(has_text, "pdf_text").otherwise("none"),
            "extraction_confidence": F.when(
                has_text, S.text_layer_confidence(F.col("extraction_completeness"))
            ).otherwise(0.0),
            "extracted_text_length": F.length(body),
            "text_sufficient": enough,
            "ocr_used": F.lit(False),
            "ocr_failed": ~enough,
        }
    )


def diagnostics(df: DataFrame) -> DataFrame:
    """The flat extraction diagnostics block per document."""
    found = sum((T.present(F.col(c)).cast("int") for c in C.CORE_FIELDS), F.lit(0))
    return df.withColumns(
        {
            "method": F.coalesce("extraction_method", F.lit("none")),
            "confidence_level": S.confidence_level(F.col("extraction_confidence")),
            "fields_detected": found,
            "fields_total": F.lit(len(C.CORE_FIELDS)),
        }
    )
