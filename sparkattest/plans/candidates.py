"""Reviewer feedback to a leakage-checked candidate dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import present
from ..operators.duplicates import dedupe_reviewed
from ..operators.history import parse_fields, snapshot_features
from ..operators.leakage import check_external_leakage, check_split_leakage
from ..operators.quality import quality_report
from ..operators.splits import assign_splits
from ..session import cut_lineage
from ..sources.writers import current_version, read_version, split_write_back, write_candidate_batch, write_version

META = [
    "verification_id", "reviewer_label", "reviewer_note", "reviewed_at", "original_prediction",
    "original_risk_score", "original_confidence", "model_version", "certificate_type",
    "extraction_completeness", "review_status", "issuer", "ood_status", "review_priority",
    "is_disagreement", *C.FINGERPRINT_COLUMNS,
]


def collect_reviewed(feedback: DataFrame, verifications: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Decisive reviews with metadata, label and features; orphans drop out of the join."""
    decisive = feedback.filter(F.col("reviewer_label").isin(C.DECISIVE_LABELS))
    meta = decisive.select(*[c for c in META if c in decisive.columns])
    stored = verifications.select("verification_id", "intelligence_json", "extracted_info")
    joined = meta.join(stored, "verification_id")
    fields = parse_fields(F.col("extracted_info"))
    rows = joined.withColumns(
        {
            "certificate_id": F.coalesce(fields["cert_id"], F.lit("")),
            "certificate_type": F.coalesce("certificate_type", F.lit("unknown")),
            "label": (F.col("reviewer_label") == "confirmed_suspicious").cast("int"),
            **{c: fields[c] for c in C.CORE_FIELDS if c not in joined.columns},
        }
    )
    return snapshot_features(rows, features).drop("intelligence_json", "extracted_info")


@dataclass
class Candidate:
    """The checked rows and their tidy report."""

    rows: DataFrame
    report: DataFrame


def build_candidate(
    reviewed: DataFrame, *, seq: str, batch: str, frozen: DataFrame | None = None,
    test_fraction: float = C.TEST_FRACTION, seed: int = 42,
) -> Candidate:
    """Dedupe, split by family, and check for leakage before anything is written.

    The split rows are cut into the checkpoint folder once, so the gate, the report
    and the write all see the same rows.
    """
    unique = dedupe_reviewed(reviewed, seq=seq)
    split = assign_splits(unique, seq, test_fraction=test_fraction, seed=seed)
    rows = cut_lineage(split.withColumn("dataset_batch", F.lit(batch)))
    check_split_leakage(rows)
    if frozen is not None:
        check_external_leakage(rows, frozen)
    return Candidate(rows, quality_report(rows).unionByName(split_report(rows)))


def split_report(rows: DataFrame) -> DataFrame:
    """Rows per split and label and the share with features, in tidy form."""
    available = F.count_if(F.col("features_available")) if "features_available" in rows.columns else F.count(F.lit(1))
    counts = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 0).alias("genuine"),
        F.count_if(F.col("label") == 1).alias("suspicious"), available.alias("features_available"),
    )
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in ("n_rows", "genuine", "suspicious", "features_available")
        ]
    )
    return counts.select(F.lit("split").alias("section"), F.col("split").alias("item"), F.explode(pairs).alias("p")).select(
        "section", "item", "p.*"
    )


def publish(candidate: Candidate, feedback: DataFrame, path: str) -> DataFrame:
    """Write the batch and return the feedback table with split and batch filled in."""
    write_candidate_batch(candidate.rows, path)
    return split_write_back(feedback, candidate.rows)


def publish_back(candidate: Candidate, feedback_path: str, path: str, *, version: str) -> DataFrame:
    """Write the batch, then the feedback table with split and batch as a new version of itself; returns that version.

    The batch is complete before the feedback names it. After a crash the old feedback stays current, and the same call
    finishes the work: it replaces the batch's own partitions and the unfinished version. Once the version is
    current the call changes nothing.
    """
    spark = candidate.rows.sparkSession
    if current_version(spark, feedback_path) != version:
        written = publish(candidate, read_version(spark, feedback_path), path)
        write_version(written, feedback_path, version)
    return read_version(spark, feedback_path)


def reviewed_with_fingerprints(df: DataFrame) -> DataFrame:
    """Rows that can be linked at all: at least one non-blank link value."""
    linked = F.lit(False)
    for c in C.LINK_COLUMNS:
        if c in df.columns:
            linked = linked | present(F.col(c))
    return df.filter(linked)
