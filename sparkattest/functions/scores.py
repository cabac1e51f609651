"""Numeric rules: check digits, grade bands, trust, completeness, confidence."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import contains_any, present


def cert_id_format_valid(cert_id: Column) -> Column:
    return F.coalesce(cert_id.rlike(C.STANDARD_CERT_ID), F.lit(False))


def checksum_digit(digits: Column) -> Column:
    """Sum of digit times position, modulo ten, over the first five digits."""
    terms = [F.substring(digits, i, 1).try_cast("int") * i for i in range(1, 6)]
    return reduce(lambda a, b: a + b, terms) % 10


def cert_id_checksum_valid(cert_id: Column) -> Column:
    serial = F.regexp_extract(cert_id, C.STANDARD_CERT_ID, 2)
    return F.coalesce(
        cert_id_format_valid(cert_id)
        & (checksum_digit(serial) == F.substring(serial, 6, 1).try_cast("int")),
        F.lit(False),
    )


def issuer_known(issuer: Column, names: list[str] | None = None) -> Column:
    known = [n.lower() for n in (C.KNOWN_ISSUERS if names is None else names)]
    return F.coalesce(F.lower(F.trim(issuer)).isin(known), F.lit(False))


def issuer_trust(issuer: Column, known: Column | None = None) -> Column:
    """1.0 recognized, 0.0 blank, 0.15 suspicious wording, otherwise 0.4."""
    known = issuer_known(issuer) if known is None else known
    return (
        F.when(known, 1.0)
        .when(~present(issuer), 0.0)
        .when(contains_any(F.lower(issuer), C.LOW_TRUST_ISSUER_WORDS), 0.15)
        .otherwise(0.4)
    )


def parse_date(value: Column) -> Column:
    """ISO date or datetime text to a date, NULL when it is not one."""
    s = F.trim(value.cast("string"))
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")), F.try_to_timestamp(s)).cast("date")


def year_valid(day: Column, max_year: int = C.MAX_ISSUE_YEAR) -> Column:
    return F.coalesce(F.year(day).between(C.MIN_ISSUE_YEAR, max_year), F.lit(False))


def date_consistent(day: Column, as_of: dt.date, max_year: int = C.MAX_ISSUE_YEAR) -> Column:
    """A plausible year and not after `as_of` (an argument, never the clock)."""
    return year_valid(day, max_year) & F.coalesce(day <= F.lit(as_of), F.lit(False))


def marks_valid(total: Column, obtained: Column) -> Column:
    total, obtained = total.try_cast("double"), obtained.try_cast("double")
    return F.coalesce((total > 0) & (obtained >= 0) & (obtained <= total), F.lit(False))


def marks_percent(total: Column, obtained: Column) -> Column:
    """Percentage, 0.0 when the total is missing or not positive."""
    total, obtained = total.try_cast("double"), obtained.try_cast("double")
    return F.coalesce(F.when(total > 0, obtained / total * 100), F.lit(0.0))


def grade_band(percent: Column) -> Column:
    return (
        F.when(percent >= 90, "A").when(percent >= 75, "B").when(percent >= 60, "C")
        .when(percent >= 50, "D").when(percent >= 35, "E").otherwise("F")
    )


def grade_consistent(grade: Column, percent: Column) -> Column:
    return F.coalesce(F.upper(F.trim(grade)) == grade_band(percent), F.lit(False))


def fraction_present(*cols: Column) -> Column:
    """Share of the given columns that hold a non-blank value."""
    return reduce(lambda a, b: a + b, [present(c).cast("int") for c in cols]) / len(cols)


def core_completeness(fields: dict[str, Column] | None = None) -> Column:
    cols = [(fields or {}).get(name, F.col(name)) for name in C.CORE_FIELDS]
    return F.round(fraction_present(*cols), 4)


def text_layer_confidence(completeness: Column) -> Column:
    return F.round(F.least(F.lit(0.6) + F.lit(0.4) * completeness, F.lit(0.95)), 4)


def ocr_confidence(mean_confidence: Column) -> Column:
    return F.round(F.least(F.coalesce(mean_confidence, F.lit(0.5)), F.lit(0.95)), 4)


def confidence_level(confidence: Column, missing: str = "low") -> Column:
    return (
        F.when(confidence.isNull(), missing).when(confidence >= 0.7, "high")
        .when(confidence >= 0.4, "medium").otherwise("low")
    )


def text_sufficient(
    text: Column, completeness: Column, *, min_chars: int = C.MIN_TEXT_CHARS,
    hybrid_chars: int = C.HYBRID_TEXT_CHARS, min_completeness: float = C.MIN_TEXT_COMPLETENESS,
) -> Column:
    """Whether a text layer can be trusted without another text source."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return (n > 0) & (n >= min_chars) & ((completeness >= min_completeness) | (n >= hybrid_chars))


def completeness_bucket(value: Column) -> Column:
    return (
        F.when(value.isNull(), "unknown").when(value < 0.4, "low")
        .when(value < 0.8, "medium").otherwise("high")
    )


def risk_band(risk: Column) -> Column:
    return (
        F.when(risk >= C.HIGH_RISK, "high").when(risk >= C.ELEVATED_RISK, "elevated").otherwise("low")
    )


def pdf_timestamp(value: Column) -> Column:
    """A D:YYYYMMDDHHmmSS stamp to a timestamp; stamps without a day are NULL."""
    shape = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    y, mo, d, h, mi, s = (F.regexp_extract(value, shape, g) for g in range(1, 7))

    def part(text: Column, default: str) -> Column:
        return F.when(text == "", default).otherwise(text)

    stamp = F.concat(
        y, F.lit("-"), part(mo, "01"), F.lit("-"), part(d, "00"), F.lit(" "),
        part(h, "00"), F.lit(":"), part(mi, "00"), F.lit(":"), part(s, "00"),
    )
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))
