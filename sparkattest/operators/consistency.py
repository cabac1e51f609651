"""Internal contradictions of one document: field statuses, findings, checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scores as S
from ..functions import text as T
from .findings import Rule, as_array, count_of, percent_text, yes


def with_wording(df: DataFrame) -> DataFrame:
    """Suspicious wording, link marks and the labeled identifier of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.withColumn("_low", F.lower(text)).withColumns(
        {
            "keyword_count": T.count_contained(F.col("_low"), C.SUSPICIOUS_KEYWORDS),
            "url_marker": T.contains_any(F.col("_low"), C.URL_MARKERS),
            "labeled_id": F.left(F.trim(T.extract(text, C.LABELED_ID, 1)), F.lit(40)),
        }
    ).drop("_low")


def field_statuses(
    df: DataFrame, *, as_of: dt.date, known_issuer: Column | None = None,
    max_year: int = C.MAX_ISSUE_YEAR, marked: bool = False,
) -> DataFrame:
    """Add ok / missing / warning per identity field, wording and structure completeness.

    `marked` skips the wording of tables that already carry it.
    """
    day = S.parse_date(F.col("issue_date"))
    known = S.issuer_known(F.col("organization")) if known_issuer is None else known_issuer
    with_day = (df if marked else with_wording(df)).withColumns({"_day": day, "_known": known})
    cert = F.trim(F.col("cert_id"))
    return with_day.withColumns(
        {
            "recipient_status": F.when(T.present(F.col("candidate_name")), "ok").otherwise("missing"),
            "course_status": F.when(T.present(F.col("course")), "ok").otherwise("missing"),
            "certificate_id_status": F.when(~T.present(cert), "missing")
            .when(S.cert_id_checksum_valid(cert), "ok").otherwise("warning"),
            "issuer_status": F.when(~T.present(F.col("organization")), "missing")
            .when(F.col("_known"), "ok").otherwise("warning"),
            "date_status": F.when(F.col("_day").isNull(), "missing")
            .when(S.date_consistent(F.col("_day"), as_of, max_year), "ok").otherwise("warning"),
            "structure_completeness": S.fraction_present(
                *[F.col(c) for c in ("candidate_name", "organization", "course", "cert_id", "issue_date")]
            ),
        }
    ).drop("_known").withColumnRenamed("_day", "issue_day")


def consistency_rules() -> list[Rule]:
    """The finding rules over the columns of `field_statuses`, in report order."""
    cert, grade = F.trim(F.col("cert_id")), F.col("grade")
    total, obtained = F.col("marks_total").try_cast("double"), F.col("marks_obtained").try_cast("double")
    pct = S.marks_percent(total, obtained)
    has_cert, has_issuer = T.present(cert), T.present(F.col("organization"))
    labeled, keywords = F.col("labeled_id"), F.col("keyword_count")
    structure = F.col("structure_completeness")
    bad_grade = T.present(grade) & (total > 0) & obtained.isNotNull() & ~S.grade_consistent(grade, pct)
    return [
        Rule("missing_recipient", "Missing recipient", "medium",
             F.col("recipient_status") == "missing", F.lit("No recipient name was found.")),
        Rule("invalid_date", "Invalid issue date", "high", F.col("date_status") == "warning",
             F.concat(F.lit("Issue date is implausible or in the future: "), F.col("issue_day").cast("string"))),
        Rule("marks_exceed_total", "Marks exceed total", "high", (total > 0) & (obtained > total),
             F.format_string("Marks %.0f exceed the total %.0f.", obtained, total)),
        Rule("invalid_marks", "Invalid marks", "medium", (total <= 0) & obtained.isNotNull(),
             F.lit("Marks are given but the total is not positive.")),
        Rule("grade_marks_mismatch", "Inconsistent grade", "high", bad_grade,
             F.concat(F.lit("Grade "), F.upper(grade), F.lit(" but the marks give "), S.grade_band(pct))),
        Rule("invalid_cert_id", "Invalid certificate ID", "high",
             F.col("certificate_id_status") == "warning",
             F.concat(F.lit("Identifier fails the format or check digit: "), cert)),
        Rule("invalid_cert_id", "Invalid certificate ID", "high",
             ~has_cert & T.present(labeled),
             F.concat(F.lit("Labeled identifier has another format: "), labeled)),
        Rule("unknown_issuer", "Unknown issuer", "medium", F.col("issuer_status") == "warning",
             F.concat(F.lit("Issuer is not in the recognized list: "), F.col("organization"))),
        Rule("cert_id_issuer_mismatch", "Certificate ID vs issuer", "medium",
             has_issuer & has_cert & ~S.cert_id_format_valid(cert),
             F.lit("The identifier does not follow the structure this issuer uses.")),
        Rule("suspicious_wording", "Suspicious wording", "high", keywords > 0,
             F.concat(keywords.cast("string"), F.lit(" suspicious phrase(s)."))),
        Rule("suspicious_url", "Suspicious URL", "high",
             F.col("url_marker"),
             F.lit("The text contains an external link.")),
        Rule("low_structure", "Missing expected structure", "medium", structure < 0.4,
             F.concat(F.lit("Only few expected fields are present: "), percent_text(structure))),
    ]


def _check(key: str, label: str, status: Column, severity: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(key).alias("key"), F.lit(label).alias("label"), status.alias("status"),
        severity.alias("severity"), F.coalesce(detail, F.lit("")).alias("detail"),
    )


def check_columns(marks_ok: Column) -> dict[str, tuple[Column, Column]]:
    """Status and severity of the seven per-field checks."""

    def three_way(status: str, warn_status: str, warn_severity: str) -> tuple[Column, Column]:
        col = F.col(status)
        return (
            F.when(col == "ok", "PASS").when(col == "warning", warn_status).otherwise("WARNING"),
            F.when(col == "ok", "low").when(col == "warning", warn_severity).otherwise("medium"),
        )

    low = F.lit("low")
    structure = F.col("structure_completeness") >= 0.6
    return {
        "recipient_consistency": (F.when(F.col("recipient_status") == "ok", "PASS").otherwise("WARNING"), low),
        "issuer_consistency": three_way("issuer_status", "WARNING", "medium"),
        "date_consistency": three_way("date_status", "FAIL", "high"),
        "course_consistency": (F.when(F.col("course_status") == "ok", "PASS").otherwise("WARNING"), low),
        "certificate_id_consistency": three_way("certificate_id_status", "FAIL", "high"),
        "marks_consistency": (
            F.when(marks_ok, "PASS").otherwise("FAIL"), F.when(marks_ok, "low").otherwise("high"),
        ),
        "structure_consistency": (
            F.when(structure, "PASS").otherwise("WARNING"), F.when(structure, "low").otherwise("medium"),
        ),
    }


MARKS_KEYS = ("marks_exceed_total", "grade_marks_mismatch", "invalid_marks")


def consistency(
    df: DataFrame, *, as_of: dt.date, known_issuer: Column | None = None,
    max_year: int = C.MAX_ISSUE_YEAR, marked: bool = False,
) -> DataFrame:
    """Add statuses, `findings`, severity counts, `marks_ok` and `checks`.

    The counts come from the rules, not from the array, so that a plan without findings builds none.
    """
    rules = consistency_rules()
    marks_bad = [yes(r.when) for r in rules if r.key in MARKS_KEYS]
    with_findings = field_statuses(
        df, as_of=as_of, known_issuer=known_issuer, max_year=max_year, marked=marked
    ).withColumns(
        {
            "findings": as_array(rules),
            "high_findings": count_of(rules, "high"),
            "medium_findings": count_of(rules, "medium"),
            "marks_ok": ~(marks_bad[0] | marks_bad[1] | marks_bad[2]),
        }
    )
    checks = check_columns(F.col("marks_ok"))
    notes = {
        "recipient_consistency": F.concat(F.lit("Recipient: "), F.coalesce("candidate_name", F.lit("none"))),
        "issuer_consistency": F.concat(F.lit("Issuer: "), F.coalesce("organization", F.lit("none"))),
        "date_consistency": F.concat(F.lit("Issue date: "), F.coalesce(F.col("issue_day").cast("string"), F.lit("none"))),
        "course_consistency": F.concat(F.lit("Course: "), F.coalesce("course", F.lit("none"))),
        "certificate_id_consistency": F.concat(F.lit("Identifier: "), F.coalesce("cert_id", F.lit("none"))),
        "marks_consistency": F.when(F.col("marks_ok"), "Marks and grade agree.").otherwise("Marks and grade disagree."),
        "structure_consistency": F.concat(F.lit("Fields present: "), percent_text(F.col("structure_completeness"))),
    }
    labels = {key: key.replace("_", " ").capitalize() for key in checks}
    return with_findings.withColumns(
        {
            "checks": F.array(
                *[_check(k, labels[k], status, severity, notes[k]) for k, (status, severity) in checks.items()]
            ),
        }
    )
