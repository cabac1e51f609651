"""Leakage checks: shared values across splits, frozen-set overlap, duplicate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import present, template_key

MAX_BROADCAST_ROWS = 2_000_000


class LeakageError(Exception):
    """A dataset breaks a leakage rule."""


def key_rows(df: DataFrame, columns: list[str], *keep: str, blank_counts: bool = False) -> DataFrame:
    """Long form (column_name, value, keep...) of the key columns that exist."""
    present_columns = [c for c in columns if c in df.columns]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in present_columns]
    )
    long = df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")
    return long.filter(F.col("value").isNotNull() if blank_counts else present(F.col("value")))


def shared_values(df: DataFrame, columns: list[str] = C.LINK_COLUMNS, splits: list[str] = C.SPLITS) -> DataFrame:
    """(column_name, value) found in more than one split.

    Membership is one partial-aggregated flag per split, so a value that fills a
    third of the table is reduced before the shuffle.
    """
    long = key_rows(df, columns, "split")
    flags = [F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(f"in_{s}") for s in splits]
    hits = sum((F.col(f"in_{s}") for s in splits), F.lit(0))
    return long.groupBy("column_name", "value").agg(*flags).filter(hits > 1).select("column_name", "value")


def cross_split_counts(df: DataFrame, columns: list[str] = C.LINK_COLUMNS, splits: list[str] = C.SPLITS) -> DataFrame:
    """Number of shared values per key column, zero included."""
    long = key_rows(df, columns, "split")
    flags = [F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(f"in_{s}") for s in splits]
    hits = sum((F.col(f"in_{s}") for s in splits), F.lit(0))
    grouped = long.groupBy("column_name", "value").agg(*flags)
    return grouped.groupBy("column_name").agg(F.count_if(hits > 1).alias("cross_split_values"))


def check_split_leakage(df: DataFrame) -> DataFrame:
    """The per-column check table; raises before anything is written.

    Only as many rows as there are key columns reach the driver.
    """
    if "split" not in df.columns:
        raise LeakageError("the dataset has no 'split' column")
    unknown = df.filter(F.col("split").isNotNull() & ~F.col("split").isin(C.SPLITS)).select("split").distinct()
    found = [r[0] for r in unknown.limit(10).collect()]
    if found:
        raise LeakageError(f"unknown split values: {sorted(found)}")
    counts = cross_split_counts(df)
    bad = {r["column_name"]: r["cross_split_values"] for r in counts.collect() if r["cross_split_values"]}
    if bad:
        raise LeakageError(f"values in more than one split: {bad}")
    return counts.withColumn("ok", F.col("cross_split_values") == 0)


def fits_broadcast(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether a table of short rows stays under a row bound."""
    return df.limit(limit + 1).count() <= limit


def external_overlap(
    df: DataFrame, frozen: DataFrame, *, sha: str = "file_fingerprint", max_broadcast: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Add in_external_set: the row's hash belongs to the frozen set.

    The frozen hashes are broadcast below a row bound and shuffled beyond it.
    """
    hashes = frozen.select(F.col("sha256").alias(sha)).filter(F.col(sha).isNotNull()).distinct()
    hashes = hashes.withColumn("_frozen", F.lit(True))
    side = F.broadcast(hashes) if fits_broadcast(hashes, max_broadcast) else hashes
    return df.join(side, sha, "left").withColumn("in_external_set", F.coalesce("_frozen", F.lit(False))).drop("_frozen")


def reject_external(df: DataFrame, frozen: DataFrame, *, sha: str = "sha256") -> DataFrame:
    """Overwrite the status of rows that belong to the frozen set, so they are skipped."""
    flagged = external_overlap(df, frozen, sha=sha)
    status = F.col("duplicate_status") if "duplicate_status" in df.columns else F.lit("unique")
    return flagged.withColumn(
        "duplicate_status", F.when(F.col("in_external_set"), "external_validation").otherwise(status)
    ).drop("in_external_set")


def check_external_leakage(df: DataFrame, frozen: DataFrame, *, sha: str = "file_fingerprint") -> int:
    """Raise when any row belongs to the frozen set; returns the number of rows checked."""
    flagged = external_overlap(df, frozen, sha=sha)
    row = flagged.agg(F.count_if(F.col("in_external_set")).alias("hits"), F.count(F.lit(1)).alias("n")).first()
    if row["hits"]:
        raise LeakageError(f"{row['hits']} rows belong to the frozen external set")
    return row["n"]


def external_hashes(files: DataFrame) -> DataFrame:
    """File name and SHA-256 of a binary-file table, accepted extensions only."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(extension.isin(C.ACCEPTED_EXTENSIONS)).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.sha2("content", 256).alias("sha256")
    )


def duplicate_report(df: DataFrame, columns: list[str] = C.LINK_COLUMNS) -> DataFrame:
    """Duplicate groups and surplus rows per key column; blank text counts as a value."""
    sizes = key_rows(df, columns, blank_counts=True).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("column_name").agg(
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("affected_rows"),
    )


def hash_groups(df: DataFrame, sha: str = "sha256", label: str = "label") -> DataFrame:
    """Repeated hashes: group size and rows per label, in long form.

    Members stay rows; a group is never collected into one array.
    """
    per_label = df.groupBy(sha, label).agg(F.count(F.lit(1)).alias("n"))
    totals = per_label.groupBy(sha).agg(F.sum("n").alias("copies")).filter(F.col("copies") > 1)
    return per_label.join(totals, sha).select(
        F.col(sha), F.concat(F.left(F.col(sha), F.lit(16)), F.lit("...")).alias("sha_prefix"), label, "n", "copies"
    )


def hash_group_members(df: DataFrame, *, sha: str = "sha256", keep: list[str]) -> DataFrame:
    """Every row of a repeated hash, with the group size."""
    from .skew import lookup_join

    sizes = df.groupBy(sha).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    slim = df.select(sha, *keep)
    return lookup_join(slim, sizes, [sha], "copies").filter(F.col("copies").isNotNull())


def cross_split_report(df: DataFrame) -> DataFrame:
    """Fingerprints and templates that occur in both splits, as (kind, value)."""
    first = F.coalesce(*[F.when(present(F.col(c)), F.col(c)) for c in C.FINGERPRINT_COLUMNS if c in df.columns])
    keyed = df.select(
        "split", first.alias("fingerprint_cross_split"),
        template_key(F.col("issuer"), F.col("certificate_type")).alias("template_cross_split"),
    )
    shared = shared_values(keyed, ["fingerprint_cross_split", "template_cross_split"])
    return shared.select(F.col("column_name").alias("kind"), "value")


def leakage_summary(df: DataFrame, frozen: DataFrame, *, sha: str = "file_fingerprint") -> DataFrame:
    """All leakage checks as one table (check, violations, ok)."""
    overlap = external_overlap(df, frozen, sha=sha).agg(
        F.lit("external_overlap").alias("check"), F.count_if(F.col("in_external_set")).alias("violations")
    )
    copies = df.groupBy(sha).agg(F.count(F.lit(1)).alias("n")).agg(
        F.lit("duplicate_hashes").alias("check"), F.count_if(F.col("n") > 1).alias("violations")
    )
    split = cross_split_counts(df).select(
        F.concat(F.lit("split_leakage:"), "column_name").alias("check"), F.col("cross_split_values").alias("violations")
    )
    return overlap.union(copies).union(split).withColumn("ok", F.col("violations") == 0)


def raise_if(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """A row-level gate inside the plan: fails the job at the first bad row."""
    return df.filter(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))
