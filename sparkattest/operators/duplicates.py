"""Duplicate documents: priority lookup, exact copies, keep-first removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from ..functions import text as T
from ..session import cut_lineage
from .skew import HOT_ROWS, lookup_join


def with_fingerprints(df: DataFrame, content: str = "content") -> DataFrame:
    """Add file, certificate-id and identity fingerprints."""
    return df.withColumns(
        {
            "file_fingerprint": T.file_fingerprint(F.col(content)),
            "cert_id_fingerprint": T.cert_id_fingerprint(F.col("cert_id")),
            "identity_fingerprint": T.identity_fingerprint(
                F.col("candidate_name"), F.col("organization"), F.col("course"), F.col("issue_date")
            ),
        }
    )


# Which fingerprint wins when several match.
PRIORITY = {"file": 1, "cert_id": 2, "identity": 3}


def fingerprint_array(with_document: bool = False) -> Column:
    """The fingerprints of a row with their kinds and ranks, strongest first; rank 0 stands for the row itself."""
    own = [F.struct(F.lit(0).alias("rank"), F.lit("document").alias("kind"), F.lit("").alias("value"))] if with_document else []
    return F.array(
        *own,
        *[
            F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.col(f"{kind}_fingerprint").alias("value"))
            for kind, rank in PRIORITY.items()
        ],
    )


def fingerprint_rows(df: DataFrame, owner: str, seq: str, doc_id: str) -> DataFrame:
    """One row per document and non-blank fingerprint, strongest kind first; `_valid` is false for error rows."""
    long = df.select(
        F.col(seq).alias("_seq"), F.col(doc_id).alias("_doc"), F.col(owner).alias("_owner"),
        F.coalesce(F.col("prediction") != "error", F.lit(False)).alias("_valid"), F.explode(fingerprint_array()).alias("f"),
    )
    return long.select("_seq", "_doc", "_owner", "_valid", "f.*").filter(T.present(F.col("value")))


def prior_duplicates(
    df: DataFrame, *, seq: str, owner: str, doc_id: str, history: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add is_duplicate, duplicate_of and duplicate_type.

    A document is a duplicate when an earlier document of the same owner (by `seq`,
    without error rows) carries the same file, certificate-id or identity
    fingerprint, in that priority; the earliest one is named. With `history` the
    documents of `df` are looked up in that table instead of in `df` itself.

    The fingerprints of all three kinds are written once as one key table, so the documents are read twice: for
    their keys and for the result. The earliest (seq, id) per fingerprint is a partial aggregate, so no group is
    ever collected and no pairs are built; singletons are dropped before the join.
    """
    on = ["_owner", "rank", "value"]
    df = df.drop("is_duplicate", "duplicate_of", "duplicate_type")
    keys = cut_lineage(fingerprint_rows(df, owner, seq, doc_id))
    first = F.min(F.struct("_seq", "_doc")).alias("first")
    if history is None:
        rows = keys.filter("_valid")
        firsts = rows.groupBy(*on).agg(first, F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    else:
        rows = keys
        wanted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
        # the history shrinks to one row per fingerprint before it meets the documents
        stored = fingerprint_rows(history, owner, seq, doc_id).filter("_valid").groupBy(*on).agg(first)
        firsts = stored.join(wanted, on)
    matched = lookup_join(rows.select("_seq", "kind", *on), firsts, on, "n", hot_rows=hot_rows)
    earlier = matched.filter(F.col("first._seq") < F.col("_seq"))
    best = earlier.groupBy("_seq").agg(F.min(F.struct("rank", "kind", "first")).alias("b"))
    named = best.select(F.col("_seq").alias(seq), F.col("b.first._doc").alias("duplicate_of"), F.col("b.kind").alias("duplicate_type"))
    return df.join(named, seq, "left").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())


def mark_exact_copies(
    df: DataFrame, *, seq: str, sha: str = "sha256", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add duplicate_status and duplicate_of (the first other copy by `seq`).

    Every copy is marked, also the first; the first one points at the second. Rows without a hash are unique. Hashes are
    computed and written once; the two smallest `seq` of a hash come from a row limit per group, which
    keeps two rows per hash and task before the shuffle.
    """
    df = df.drop("copies", "duplicate_status", "duplicate_of")
    slim = cut_lineage(df.select(seq, sha)).filter(F.col(sha).isNotNull())
    order = W.partitionBy(sha).orderBy(seq)
    two = slim.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= 2)
    ends = two.groupBy(sha).agg(F.min(seq).alias("_first"), F.max(F.when(F.col("_at") == 2, F.col(seq))).alias("_second"))
    counts = slim.groupBy(sha).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    members = lookup_join(slim, ends.join(counts, sha), [sha], "copies", hot_rows=hot_rows).filter(F.col("_first").isNotNull())
    pointed = members.select(
        F.col(seq), "copies", F.when(F.col(seq) == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("duplicate_of")
    )
    return df.join(pointed, seq, "left").withColumns(
        {
            "duplicate_status": F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("unique"),
            "copies": F.coalesce("copies", F.lit(1)),
        }
    )


def keep_first(df: DataFrame, keys: list[str], *, seq: str, skip_blank: bool = True) -> DataFrame:
    """Keep the earliest row per key tuple; rows whose keys are all blank stay.

    The winners are found by a partial aggregate and kept by a semi join on the
    unique `seq`, so a hot key costs nothing extra.
    """
    filled = reduce(lambda a, b: a | b, [T.present(F.col(k)) for k in keys])
    keyed = df.select(F.col(seq), *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)], filled.alias("_filled"))
    single = F.when(F.col("_filled"), "").otherwise(F.col(seq).cast("string"))
    grouped = keyed.withColumn("_own", single if skip_blank else F.lit(""))
    winners = grouped.groupBy(*[f"_k{i}" for i in range(len(keys))], "_own").agg(F.min(seq).alias(seq))
    return df.join(winners.select(seq), seq, "left_semi")


def dedupe_reviewed(df: DataFrame, *, seq: str, skip_blank: bool = True) -> DataFrame:
    """Unique verification ids first, then unique fingerprint tuples."""
    by_id = keep_first(df, ["verification_id"], seq=seq)
    present = [c for c in C.FINGERPRINT_COLUMNS if c in df.columns]
    return keep_first(by_id, present, seq=seq, skip_blank=skip_blank) if present else by_id


def removed_count(before: DataFrame, after: DataFrame) -> DataFrame:
    left = after.agg(F.count(F.lit(1)).alias("n")).scalar()
    return before.agg(F.count(F.lit(1)).alias("rows_before")).withColumn("rows_after", left).withColumn(
        "removed", F.col("rows_before") - F.col("rows_after")
    )

