"""The fixed 31-column feature table, from raw records or from extracted fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scores as S
from ..functions import text as T


def _num(df: DataFrame, name: str) -> Column:
    """A numeric input column; absent columns and bad values count as zero."""
    if name not in df.columns:
        return F.lit(0.0)
    value = F.col(name).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


def _flag(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0)
    return F.coalesce(F.col(name).try_cast("boolean"), F.lit(False)).cast("int")


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def build_features(
    df: DataFrame, *, mode: str = "training", as_of: dt.date, known_issuer: Column | None = None,
    max_year: int = C.MAX_ISSUE_YEAR, keep: list[str] | None = None, marked: bool = False,
) -> DataFrame:
    """Add the feature contract to every row with column expressions only.

    mode='training' reads raw records (issuer, text_snippet, title, visual columns);
    mode='runtime' reads extracted fields (organization, text, certificate_title).
    The two differ on purpose: training needs names longer than three characters,
    counts the issuer in completeness and also trusts a stored link flag. `marked` takes what
    the features need of the text from the kept columns of `with_text_marks`.
    """
    if mode not in ("training", "runtime"):
        raise ValueError("mode must be 'training' or 'runtime'")
    training = mode == "training"
    issuer_name, text_name, title_name = (
        ("issuer", "text_snippet", "title") if training else ("organization", "text", "certificate_title")
    )
    keep = df.columns if keep is None else keep
    clash = {"organization_present", *C.FEATURE_COLUMNS} & set(keep)
    keep = [c for c in keep if c not in clash]
    issuer, organization = _text(df, issuer_name), _text(df, "organization")
    base = df.select(
        *[F.col(c) for c in keep],
        F.lower(_text(df, text_name)).alias("_low"), F.lower(issuer).alias("_low_issuer"),
        S.parse_date(F.col("issue_date")).alias("_day"),
        S.marks_percent(F.col("marks_total"), F.col("marks_obtained")).alias("_pct"),
        S.marks_valid(F.col("marks_total"), F.col("marks_obtained")).alias("_marks_ok"),
        (S.issuer_known(issuer) if known_issuer is None else known_issuer).alias("_known"),
        _text(df, "cert_id").alias("_cert_id"), _text(df, "candidate_name").alias("_name"),
        _text(df, "course").alias("_course"), issuer.alias("_issuer"),
        organization.alias("_org"), _text(df, title_name).alias("_title"),
        _text(df, "grade").alias("_grade"),
        (_flag(df, "has_url") if training else F.lit(0)).alias("_link"),
        *[_flag(df, f"has_{m}").alias(f"_{m}") for m in ("signature", "seal", "qr")],
        *[
            _num(df, src).alias(f"_{src}")
            for src in (
                ("blank_ratio", "sharpness", "noise_level", "color_anomaly") if training
                else ("visual_blank_ratio", "visual_sharpness", "visual_noise", "visual_color_anomaly")
            )
        ],
    )
    low, day = F.col("_low"), F.col("_day")
    visual = [c for c in base.columns if c in (
        "_blank_ratio", "_sharpness", "_noise_level", "_color_anomaly",
        "_visual_blank_ratio", "_visual_sharpness", "_visual_noise", "_visual_color_anomaly",
    )]
    name_ok = T.present(F.col("_name"))
    if training:
        name_ok = name_ok & (F.length(F.trim(F.col("_name"))) > 3)
        issuer_ok = T.present(F.when(F.col("_issuer") != "", F.col("_issuer")).otherwise(F.col("_org")))
        completeness = S.fraction_present(*[F.col(c) for c in ("_name", "_course", "_org", "_issuer")])
    else:
        issuer_ok = T.present(F.col("_org"))
        completeness = F.round(S.fraction_present(*[F.col(c) for c in ("_name", "_course", "_org")]), 4)
    title_ok, date_ok = T.present(F.col("_title")), day.isNotNull()
    if marked:
        types = {t: F.col(f"type_{t}") for t in C.TYPE_PRECEDENCE}
        keywords, marker = F.col("keyword_count"), F.col("url_marker")
    else:
        types = T.type_flag_columns(low, F.col("_low_issuer"))
        keywords, marker = T.count_contained(low, C.SUSPICIOUS_KEYWORDS), T.contains_any(low, C.URL_MARKERS)
    parts = [name_ok, date_ok, issuer_ok, title_ok]
    values = {
        "cert_id_format_valid": S.cert_id_format_valid(F.col("_cert_id")),
        "cert_id_checksum_valid": S.cert_id_checksum_valid(F.col("_cert_id")),
        "issuer_known": F.col("_known"),
        "issue_year_valid": S.year_valid(day, max_year),
        "date_consistency_valid": S.date_consistent(day, as_of, max_year),
        "candidate_name_present": name_ok,
        "course_present": T.present(F.col("_course")),
        "organization_present": T.present(F.col("_org")),
        "text_field_completeness": completeness,
        "marks_pattern_valid": F.col("_marks_ok"),
        "grade_consistency_valid": S.grade_consistent(F.col("_grade"), F.col("_pct")),
        "suspicious_keyword_count": keywords,
        "suspicious_url_present": marker | (F.col("_link") == 1),
        "signature_present": F.col("_signature"),
        "seal_present": F.col("_seal"),
        "qr_present": F.col("_qr"),
        "visual_blank_ratio": F.col(visual[0]),
        "visual_sharpness": F.col(visual[1]),
        "visual_noise": F.col(visual[2]),
        "visual_color_anomaly": F.col(visual[3]),
        "text_duplicate_similarity": F.lit(0.0),
        "issuer_domain_trust": S.issuer_trust(F.col("_issuer"), F.col("_known")),
        "certificate_type_academic": types["academic"],
        "certificate_type_completion": types["completion"],
        "certificate_type_training": types["training"],
        "certificate_type_technical": types["technical"],
        "recipient_present": name_ok,
        "completion_date_present": date_ok,
        "issuer_present": issuer_ok,
        "completion_title_present": title_ok,
        "certificate_structure_completeness": F.round(
            sum((p.cast("int") for p in parts), F.lit(0)) / len(parts), 4
        ),
    }
    return base.select(
        *keep,
        *[
            values[c].cast("double" if c in C.DOUBLE_FEATURES else "int").alias(c)
            for c in C.FEATURE_COLUMNS
        ],
    )


def feature_projection(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Features in contract order as doubles; missing or unparsable values become 0.0."""
    columns = [
        (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
        for c in C.FEATURE_COLUMNS
    ]
    return df.select(*(keep or []), *columns)
