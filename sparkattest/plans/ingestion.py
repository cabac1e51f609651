"""Labeled documents to a training table: status per row, nothing silently dropped."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import present, safe_stem
from ..operators.duplicates import mark_exact_copies
from ..operators.extraction import extract_fields
from ..operators.features import build_features
from ..operators.leakage import reject_external

TARGET = {"genuine": 0, "suspicious": 1}


def ingest(
    docs: DataFrame, *, seq: str, as_of: dt.date, frozen: DataFrame | None = None,
    known_issuer: Column | None = None, text: str = "text",
) -> DataFrame:
    """Mark duplicates and frozen-set overlap, and extract features.

    Adds sha256, duplicate_status, extraction_status, feature_extraction_status
    (success / failed / skipped), error and the 31 features. Copies and frozen
    documents are skipped, documents without text fail; neither carries features.

    Fields are extracted on the document's own row and the text is left behind, so only
    ids, hashes, statuses and features are shuffled.
    """
    hashed = docs.withColumns({"sha256": F.sha2(F.col(text), 256), "_readable": present(F.col(text))})
    featured = build_features(extract_fields(hashed, text), mode="runtime", as_of=as_of, known_issuer=known_issuer)
    narrow = featured.drop(text)
    marked = mark_exact_copies(hashed.select(seq, "sha256"), seq=seq)
    checked = reject_external(marked, frozen) if frozen is not None else marked
    rows = narrow.join(checked.select(seq, "duplicate_status", "duplicate_of"), seq, "left")
    skipped = F.col("duplicate_status").isin("duplicate", "external_validation")
    status = F.when(skipped, "skipped").when(F.col("_readable"), "success").otherwise("failed")
    done = status == "success"
    return rows.withColumns(
        {
            "extraction_status": status,
            "error": F.when(~skipped & ~F.col("_readable"), "no text in document"),
            "feature_extraction_status": F.when(done, "success").otherwise(status),
        } | {c: F.when(done, F.col(c)) for c in C.FEATURE_COLUMNS}
    ).drop("_readable")


def training_rows(ingested: DataFrame) -> DataFrame:
    """Eligible rows: features extracted and a decisive label, with provenance."""
    target = F.when(F.col("label") == "genuine", 0).when(F.col("label") == "suspicious", 1)
    eligible = ingested.filter((F.col("feature_extraction_status") == "success") & F.col("label").isin(*TARGET))
    kind = F.col("certificate_type") if "certificate_type" in ingested.columns else F.lit("unknown")
    name = F.col("original_filename") if "original_filename" in ingested.columns else F.lit("")
    return eligible.select(
        *C.FEATURE_COLUMNS, target.alias("label"), kind.alias("certificate_type"),
        F.col("sha256").alias("source_sha256"), safe_stem(name).alias("source_filename"),
    )


def ingestion_summary(ingested: DataFrame) -> DataFrame:
    """Rows per label, duplicate status and extraction status."""
    return ingested.groupBy("label", "duplicate_status", "extraction_status").agg(F.count(F.lit(1)).alias("n"))
