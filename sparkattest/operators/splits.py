"""Train and test assignment that is deterministic and free of leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import constants as C
from ..functions.text import present, template_key
from .families import connected_families
from .skew import bucketed_rank, hash_bucket, hash_order, range_rank


def canonical_key(df: DataFrame, row_id: str) -> Column:
    """A row's link values as one sorted text; its id when it has none."""
    parts = F.array_sort(
        F.array_compact(
            F.array(
                *[
                    F.when(present(F.col(c)), F.concat(F.lit(f"{c}="), F.trim(F.col(c).cast("string"))))
                    for c in C.LINK_COLUMNS if c in df.columns
                ]
            )
        )
    )
    joined = F.array_join(parts, "|")
    return F.when(joined != "", joined).otherwise(F.concat(F.lit("row="), F.col(row_id).cast("string")))


def greedy_takes(sizes: list[tuple[int, int]], target: int) -> dict[int, int]:
    """How many families of each size go to the test side.

    Walks the sizes from large to small and takes as many as still fit, which is
    what a family-by-family greedy walk in that order does.
    """
    room, takes = target, {}
    for size, count in sorted(sizes, reverse=True):
        takes[size] = min(count, room // size)
        room -= takes[size] * size
    return takes


def assign_splits(
    df: DataFrame, row_id: str, *, test_fraction: float = C.TEST_FRACTION, seed: int = 42
) -> DataFrame:
    """Add family_id and split; a family is never divided.

    Families are ordered by size and then by seeded hash. Only the (size, count)
    list reaches the driver; N rows have fewer than sqrt(2N) distinct sizes.
    """
    families = connected_families(df, row_id).withColumn("_canonical", canonical_key(df, row_id))
    per_family = families.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("_canonical", row_id).alias("_canonical")
    ).withColumn("_order", hash_order(F.col("_canonical"), seed=seed))
    sizes = [(r["size"], r["count"]) for r in per_family.groupBy("size").count().collect()]
    total = sum(size * count for size, count in sizes)
    takes = greedy_takes(sizes, int(round(total * test_fraction)))
    counts = dict(sizes)
    rule = [(s, k, k == counts[s]) for s, k in takes.items() if k > 0]
    schema = ST.StructType(
        [ST.StructField("size", ST.LongType()), ST.StructField("take", ST.LongType()), ST.StructField("whole", ST.BooleanType())]
    )
    # At most sqrt(2N) rows, as above.
    plan = F.broadcast(df.sparkSession.createDataFrame(rule, schema))
    chosen = per_family.join(plan, "size")
    whole = chosen.filter("whole").select("family_id")
    ranked = bucketed_rank(
        chosen.filter("NOT whole").select("family_id", "size", "take", "_order"),
        ["size"], hash_bucket(F.col("_order")), [F.col("_order"), F.col("family_id")],
    )
    test = whole.union(ranked.filter(F.col("_rank") <= F.col("take")).select("family_id")).withColumn("_test", F.lit(1))
    return families.drop("_canonical").join(test, "family_id", "left").withColumn(
        "split", F.when(F.col("_test") == 1, "test").otherwise("train")
    ).drop("_test")


def template_splits(
    df: DataFrame, row_id: str, *, order: str = "reviewed_at", whole_group: bool = False
) -> DataFrame:
    """Split decisive rows by issuer-and-type template; about a quarter is test.

    By default the members of a template rotate in review order. `whole_group`
    keeps each template on one side instead.
    """
    decisive = df.filter(F.col("reviewer_label").isin(C.DECISIVE_LABELS)).withColumn(
        "template_key", template_key(F.col("issuer"), F.col("certificate_type"))
    )
    if whole_group:
        first = F.left(F.sha1(F.col("template_key")), F.lit(1))
        return decisive.withColumn("split", F.when(first.isin(*"0123"), "test").otherwise("train"))
    ranked = range_rank(decisive, ["template_key"], [F.col(order)], row_id, out="template_index").withColumn(
        "template_index", F.col("template_index") - 1
    )
    first = F.left(F.sha1(F.concat_ws(":", "template_key", F.col("template_index").cast("string"))), F.lit(1))
    return ranked.withColumn("split", F.when(first.isin(*"0123"), "test").otherwise("train"))


LABELED_COLUMNS = [
    "document_id", "ground_truth", "prediction", "risk_score", "final_assessment", "issuer",
    "certificate_type", "extraction_method", "ood_status", "anomaly_level", "anomaly_score",
    "model_version", "split", "reviewer_label", "review_note_present", "created_at", "fingerprint",
]


def labeled_records(split_rows: DataFrame) -> DataFrame:
    """The flat 17-column export row of reviewed, split documents."""

    def get(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in split_rows.columns else F.lit(default)

    score = F.col("anomaly_score") if "anomaly_score" in split_rows.columns else F.lit(None).cast("double")
    prints = [F.when(present(F.col(c)), F.col(c)) for c in C.FINGERPRINT_COLUMNS if c in split_rows.columns]
    return split_rows.select(
        F.col("verification_id").alias("document_id"), F.col("reviewer_label").alias("ground_truth"),
        F.col("original_prediction").alias("prediction"), F.round("original_risk_score", 4).alias("risk_score"),
        get("final_assessment").alias("final_assessment"), get("issuer").alias("issuer"),
        get("certificate_type").alias("certificate_type"), F.lit("").alias("extraction_method"),
        get("ood_status").alias("ood_status"), get("anomaly_level").alias("anomaly_level"),
        F.round(score, 4).alias("anomaly_score"), get("model_version").alias("model_version"), "split",
        "reviewer_label", present(get("reviewer_note")).alias("review_note_present"),
        F.col("reviewed_at").alias("created_at"), F.coalesce(*prints, F.lit("")).alias("fingerprint"),
    )


def stratified_split(
    df: DataFrame, row_id: str, label: str = "label", *, test: float = 0.20, validation: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Exact shares of train / validation / test inside each label, by seeded hash."""
    keyed = df.withColumn("_order", hash_order(F.col(row_id), seed=seed))
    ranked = bucketed_rank(keyed, [label], hash_bucket(F.col("_order")), [F.col("_order"), F.col(row_id)])
    # One row per label value.
    totals = df.groupBy(label).agg(F.count(F.lit(1)).alias("_total")).withColumnRenamed(label, "_label")
    joined = ranked.join(F.broadcast(totals), ranked[label].eqNullSafe(totals["_label"]), "left")
    n_test = F.floor(F.col("_total") * test)
    n_val = F.floor(F.col("_total") * validation)
    split = (
        F.when(F.col("_rank") <= n_test, "test")
        .when(F.col("_rank") <= n_test + n_val, "validation").otherwise("train")
    )
    return joined.withColumn("split", split).drop("_order", "_rank", "_total", "_label")
