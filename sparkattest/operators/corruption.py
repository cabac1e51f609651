"""Deterministic corruption of clean records, to test how robust rules and models are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import checksum_digit
from .skew import hash_order

# Violations for every type and for single types.
COMMON_MODES = ["future_date", "suspicious_text", "unknown_issuer", "blank", "url_present", "poor_visual"]
TYPE_MODES = {
    "academic": [
        "bad_id_format", "bad_checksum", "marks_inconsistent", "grade_inconsistent",
        "missing_signature", "missing_seal", "missing_qr", "old_date",
    ],
    "technical": ["invalid_certification_code", "altered_name", "no_technical_context"],
    "workshop": ["invalid_workshop_code", "no_event_context"],
}
ALL_MODES = COMMON_MODES + [m for modes in TYPE_MODES.values() for m in modes]


def unit(row_id: Column, salt: str, seed: int) -> Column:
    """A reproducible number in [0, 1) per row and purpose."""
    return hash_order(row_id, F.lit(salt), seed=seed) / F.lit(4294967296.0)


def chosen_modes(row_id: Column, certificate_type: Column, seed: int = 42) -> Column:
    """One to three distinct violations that fit the type, in drawn order."""

    def draw(modes: list[str]) -> Column:
        keyed = F.array(*[F.struct(hash_order(row_id, F.lit(m), seed=seed).alias("k"), F.lit(m).alias("m")) for m in modes])
        return F.transform(F.array_sort(keyed), lambda s: s["m"])

    drawn = F
    for kind, extra in TYPE_MODES.items():
        drawn = drawn.when(certificate_type == kind, draw(COMMON_MODES + extra))
    pool = drawn.otherwise(draw(COMMON_MODES))
    count = F.least(F.floor(unit(row_id, "count", seed) * 3) + 1, F.lit(3)).cast("int")
    return F.slice(pool, F.lit(1), count)


def inject_violations(df: DataFrame, row_id: str, *, seed: int = 42, as_of_year: int = 2026) -> DataFrame:
    """Apply each row's drawn violations in a fixed order and set its label to 1.

    A narrow stage of conditional columns; `violations` lists what was applied.
    """
    rid = F.col(row_id)
    out = df.withColumn("violations", chosen_modes(rid, F.col("certificate_type"), seed))

    def on(mode: str) -> Column:
        return F.array_contains("violations", mode)

    def u(salt: str) -> Column:
        return unit(rid, salt, seed)

    def pick(column: str, *rules: tuple[Column, Column]) -> Column:
        value = F.col(column)
        for when, new in rules:
            value = F.when(when, new).otherwise(value)
        return value

    year = F.year(F.col("issue_date").try_cast("date"))
    serial = F.lpad(F.floor(u("serial") * 100000).cast("string"), 5, "0")
    wrong = (checksum_digit(serial) + 1 + F.floor(u("check") * 9)) % 10
    day_of_year = F.concat(
        F.lit("-"), F.lpad((F.floor(u("month") * 12) + 1).cast("string"), 2, "0"),
        F.lit("-"), F.lpad((F.floor(u("day") * 28) + 1).cast("string"), 2, "0"),
    )
    shop = F.element_at(
        F.array(*[F.lit(x) for x in ("Online Degree Emporium", "Fast Diploma Sale", "Instant Credentials")]),
        (F.floor(u("shop") * 3) + 1).cast("int"),
    )
    issued = F.concat_ws("\n", "title", F.concat(F.lit("Presented to "), F.col("candidate_name"), F.lit(" for the "), F.col("course"), F.lit(" program.")))
    plain = F.concat_ws("\n", "title", F.concat(F.col("candidate_name"), F.lit(" took the "), F.col("course"), F.lit(" course.")))
    empty = F.lit("")
    return out.withColumns(
        {
            "label": F.lit(1),
            "cert_id": pick(
                "cert_id",
                (on("bad_id_format"), F.concat(F.lit("FREECERT-"), year.cast("string"), F.lit("-999999"))),
                (on("bad_checksum"), F.concat(F.lit("CERT-"), year.cast("string"), F.lit("-"), serial, wrong.cast("int").cast("string"))),
                (on("invalid_certification_code"), F.lit("TEC-2024-12")),
                (on("invalid_workshop_code"), F.lit("ATT-1234")),
            ),
            "issuer": pick("issuer", (on("unknown_issuer"), shop), (on("blank"), empty)),
            "organization": pick("organization", (on("unknown_issuer"), shop), (on("blank"), empty)),
            "candidate_name": pick("candidate_name", (on("altered_name"), F.lit("Buy Certificates")), (on("blank"), empty)),
            "course": pick("course", (on("blank"), empty)),
            "issue_date": pick(
                "issue_date",
                (on("future_date"), F.concat(F.lit(str(as_of_year + 1)), day_of_year)),
                (on("old_date"), F.concat(F.lit("19"), (F.floor(u("year") * 40) + 50).cast("string"), day_of_year)),
            ),
            "marks_obtained": pick(
                "marks_obtained",
                (on("marks_inconsistent"), F.col("marks_total") + 1 + F.floor(u("marks") * 60)),
                (on("grade_inconsistent"), F.round(F.col("marks_total") * (0.95 + u("share") * 0.04), 1)),
            ),
            "grade": pick("grade", (on("grade_inconsistent"), F.lit("F"))),
            "text_snippet": pick(
                "text_snippet",
                (on("unknown_issuer"), issued),
                (on("no_technical_context") | on("no_event_context"), plain),
                (on("suspicious_text"), F.concat(F.lit("Buy verified certificates online. No exam needed for "), F.col("course"))),
                (on("url_present"), F.concat("text_snippet", F.lit(" Contact us at www.example.com"))),
                (on("blank"), F.lit(" ")),
            ),
            "has_url": pick("has_url", (on("url_present"), F.lit(True))),
            "has_signature": pick("has_signature", (on("missing_signature"), F.lit(False))),
            "has_seal": pick("has_seal", (on("missing_seal"), F.lit(False))),
            "has_qr": pick("has_qr", (on("missing_qr"), F.lit(False))),
            "blank_ratio": pick("blank_ratio", (on("blank"), F.round(u("blank") * 0.05, 4))),
            "sharpness": pick("sharpness", (on("poor_visual"), F.round(0.10 + u("sharp") * 0.30, 4))),
            "noise_level": pick("noise_level", (on("poor_visual"), F.round(0.25 + u("noise") * 0.35, 4))),
            "color_anomaly": pick("color_anomaly", (on("poor_visual"), F.floor(u("color") * 2).cast("int"))),
        }
    )


def corrupt_share(
    df: DataFrame, row_id: str, *, share: float = 0.30, label_noise: float = 0.05, seed: int = 42
) -> DataFrame:
    """Corrupt a share of all rows by hash and flip a share of the labels."""
    rid = F.col(row_id)
    marked = df.withColumn("_hit", unit(rid, "corrupt", seed) < share)
    bad = inject_violations(marked.filter("_hit"), row_id, seed=seed)
    clean = marked.filter(~F.col("_hit")).withColumn("violations", F.array().cast("array<string>"))
    flip = unit(rid, "noise", seed) < label_noise
    return clean.unionByName(bad).drop("_hit").withColumns(
        {"label": F.when(flip, 1 - F.col("label")).otherwise(F.col("label")), "label_flipped": flip}
    )
