"""Dataset quality, schema and feature-alignment reports as tidy tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import constants as C
from ..functions.scores import completeness_bucket
from ..functions.text import present
from .counters import long_counts, mean_of, pair, total_of

TIDY = ["section", "item", "metric", "value"]


def tidy(df: DataFrame, section: str, item: Column, metrics: dict[str, Column]) -> DataFrame:
    """Turn named columns into rows (section, item, metric, value)."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()]
    )
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.explode(pairs).alias("p")).select(
        "section", "item", "p.*"
    )


def missing_field_rates(df: DataFrame, fields: list[str] = C.CORE_FIELDS) -> DataFrame:
    """Share of blank or missing values per field; NULL for a column that is absent."""
    aggregates = [
        (F.round(F.avg((~present(F.col(c))).cast("int")), 4) if c in df.columns else F.lit(None).cast("double")).alias(c)
        for c in fields
    ]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *aggregates)
    return tidy(row, "missing_field_rate", F.lit("all"), {c: F.col(c) for c in fields}).select(
        F.col("metric").alias("field"), F.col("value").alias("missing_rate")
    )


def group_sizes(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Rows per (dimension, item) for several dimensions in one scan."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("dimension"), col.cast("string").alias("item")) for name, col in dimensions.items()]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("dimension", "item").agg(F.count(F.lit(1)).alias("n"))


def underrepresented(df: DataFrame, *, below: int = C.UNDERREPRESENTED_BELOW) -> DataFrame:
    issuer = F.when(F.coalesce(F.col("issuer"), F.lit("")) == "", "unknown").otherwise(F.col("issuer"))
    sizes = group_sizes(df, {"certificate_type": F.col("certificate_type"), "issuer": issuer})
    return sizes.filter(F.col("n") < below)


def quality_report(df: DataFrame) -> DataFrame:
    """Balance, diversity, completeness, duplicates, missing fields and overlap.

    One pass: a row becomes its (dimension, value, split) pairs, and every section reads their counts.
    """
    completeness = F.col("extraction_completeness")
    issuer = F.when(F.coalesce(F.col("issuer"), F.lit("")) == "", "unknown").otherwise(F.col("issuer"))
    keys = [c for c in C.LINK_COLUMNS if c in df.columns]
    fields = [c for c in C.CORE_FIELDS if c in df.columns]
    counts = long_counts(
        df,
        [
            pair("rows"), pair("label", F.when(F.col("label") == 1, "suspicious").when(F.col("label").isNotNull(), "genuine")),
            pair("completeness", completeness_bucket(completeness), completeness), pair("disagreement", when=F.coalesce(F.col("is_disagreement") == 1, F.lit(False))),
            pair("certificate_type", F.col("certificate_type")), pair("issuer", issuer),
            *[pair(f"key:{c}", F.col(c), when=F.col(c).isNotNull()) for c in keys], *[pair(f"missing:{c}", when=~present(F.col(c))) for c in fields],
        ],
        {"split": F.col("split") if "split" in df.columns else F.lit(None).cast("string")},
    )
    scalars = counts.agg(
        total_of("rows").alias("n_rows"), total_of("label", "genuine").alias("genuine"), total_of("label", "suspicious").alias("suspicious"),
        F.round(mean_of("completeness"), 4).alias("average_completeness"),
        *[total_of("completeness", b).alias(f"completeness_{b}") for b in ("low", "medium", "high")],
        total_of("disagreement").alias("disagreements"), *[total_of(f"missing:{c}").alias(f"missing_{c}") for c in fields],
    )
    overall = tidy(
        scalars, "overall", F.lit("all"),
        {
            "n_rows": F.col("n_rows"), "genuine": F.col("genuine"), "suspicious": F.col("suspicious"),
            "suspicious_to_genuine": F.round(F.try_divide("suspicious", "genuine"), 4),
            "average_completeness": F.col("average_completeness"),
            **{f"completeness_{b}": F.col(f"completeness_{b}") for b in ("low", "medium", "high")},
            "disagreements": F.col("disagreements"),
            "disagreement_rate": F.round(F.try_divide("disagreements", "n_rows"), 4),
        },
    )
    sizes = counts.filter(F.col("dimension").isin("certificate_type", "issuer")).groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    groups = sizes.select(
        F.col("dimension").alias("section"), F.col("value").alias("item"), F.lit("n_rows").alias("metric"), F.col("n").cast("double").alias("value")
    )
    diversity = sizes.filter(F.col("dimension") == "issuer").agg(F.count(F.lit(1)).alias("n"))
    flags = [F.max(F.when(F.col("split") == s, 1).otherwise(0)) for s in C.SPLITS]
    shared = sum(flags, F.lit(0)) > 1
    held = counts.filter(F.col("dimension").startswith("key:")).groupBy(F.substring("dimension", 5, 100).alias("column_name"), "value").agg(
        F.sum("n").alias("n"), shared.alias("shared")
    )
    filled = present(F.col("value"))
    per_key = held.groupBy("column_name").agg(
        F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("affected_rows"),
        F.count_if(filled & F.col("shared")).alias("shared_values"), F.count_if(filled).alias("filled"),
    )
    rate = {c: F.round(F.try_divide(f"missing_{c}", "n_rows"), 4) if c in fields else F.lit(None).cast("double") for c in C.CORE_FIELDS}
    parts = [
        overall, groups,
        tidy(diversity, "issuer_diversity", F.lit("all"), {"issuers": F.col("n")}),
        tidy(per_key, "duplicates", F.col("column_name"), {"groups": F.col("groups"), "affected_rows": F.col("affected_rows")}),
        *[tidy(scalars, "missing_field_rate", F.lit(c), {"rate": r}) for c, r in rate.items()],
    ]
    if "split" in df.columns:
        parts.append(tidy(per_key.filter("filled > 0"), "cross_split", F.col("column_name"), {"shared_values": F.col("shared_values")}))
    return reduce(lambda a, b: a.unionByName(b), parts)


def feature_coverage(df: DataFrame) -> DataFrame:
    """Non-null count and rate and non-numeric values per expected feature, in one pass."""
    aggregates = []
    for i, c in enumerate(C.FEATURE_COLUMNS):
        value = F.col(c) if c in df.columns else F.lit(None).cast("double")
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.isNotNull() & value.cast("string").try_cast("double").isNull()).alias(f"b{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("total"), *aggregates)
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.lit(c in df.columns).alias("in_schema"),
                F.col(f"n{i}").alias("present_count"), F.col(f"b{i}").alias("non_numeric"),
            )
            for i, c in enumerate(C.FEATURE_COLUMNS)
        ]
    )
    return row.select("total", F.explode(items).alias("i")).select(
        "i.*", F.round(F.try_divide("i.present_count", "total"), 4).alias("rate"),
        (F.col("i.present_count") == 0).alias("zero_coverage"),
    )


EXTRA_ALLOWED = ["label", "certificate_type", "source_sha256", "source_filename"]


def schema_alignment(df: DataFrame) -> DataFrame:
    """Missing, unexpected and non-numeric columns against the contract."""
    numeric = (ST.NumericType, ST.BooleanType)
    rows = [("missing_column", c) for c in C.FEATURE_COLUMNS if c not in df.columns]
    rows += [("extra_column", c) for c in df.columns if c not in C.FEATURE_COLUMNS + EXTRA_ALLOWED]
    rows += [
        ("dtype_issue", f.name) for f in df.schema.fields
        if f.name in C.FEATURE_COLUMNS and not isinstance(f.dataType, numeric)
    ]
    return df.sparkSession.createDataFrame(rows, "issue string, column_name string")


def null_rates(df: DataFrame) -> DataFrame:
    present_features = [c for c in C.FEATURE_COLUMNS if c in df.columns]
    row = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 4).alias(c) for c in present_features])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_rate")) for c in present_features])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def column_order_mismatches(df: DataFrame, other: DataFrame) -> DataFrame:
    """Positions where two tables order the contract columns differently."""
    left = [c for c in df.columns if c in C.FEATURE_COLUMNS]
    right = [c for c in other.columns if c in C.FEATURE_COLUMNS]
    rows = [(str(i), a, b) for i, (a, b) in enumerate(zip(left, right)) if a != b]
    if len(left) != len(right):
        rows.append(("count", str(len(left)), str(len(right))))
    return df.sparkSession.createDataFrame(rows, "position string, actual string, expected string")


def alignment_table(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Per contract feature: in the schema, numeric, at the expected position, null rate."""
    issues = [(r["issue"], r["column_name"]) for r in schema_alignment(df).collect()]
    got = [c for c in df.columns if c in C.FEATURE_COLUMNS]
    want = [c for c in expected.columns if c in C.FEATURE_COLUMNS and c in got]
    rows = [
        (
            c, int(("missing_column", c) not in issues),
            int(c in got and ("dtype_issue", c) not in issues),
            int(c in got and got.index(c) == want.index(c)),
        )
        for c in C.FEATURE_COLUMNS
    ]
    # One row per contract feature.
    shape = df.sparkSession.createDataFrame(rows, "feature string, in_schema int, numeric_type int, same_position int")
    return shape.join(null_rates(df), "feature", "left")


# Certificate types the training table accepts without a warning.
TRAINING_TYPES = ["academic", "non_academic", "unknown"]


def schema_checks(df: DataFrame) -> DataFrame:
    """Training-table checks as (check_name, severity, violations)."""
    features = [c for c in C.FEATURE_COLUMNS if c in df.columns]
    has_label = "label" in df.columns
    label = F.col("label") if has_label else F.lit(None).cast("int")
    type_col = F.col("certificate_type") if "certificate_type" in df.columns else F.lit(None).cast("string")
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features], F.lit(False))
    non_numeric = [
        f.name for f in df.schema.fields
        if f.name in C.FEATURE_COLUMNS and not isinstance(f.dataType, (ST.NumericType, ST.BooleanType))
    ]
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(label.isNotNull() & ~label.isin(0, 1)).alias("bad_label"),
        F.count_if(label == 0).alias("n0"), F.count_if(label == 1).alias("n1"), F.count_if(nulls).alias("null_rows"),
        F.count_if(type_col.isNotNull() & ~type_col.isin(TRAINING_TYPES)).alias("odd_types"),
    )
    smallest = F.least("n0", "n1")
    checks = [
        ("missing_features", "error", F.lit(len(C.FEATURE_COLUMNS) - len(features))),
        ("missing_label", "error", F.lit(int(not has_label))),
        ("invalid_labels", "error", F.col("bad_label")),
        ("empty_class", "error", (smallest < 1).cast("int")),
        ("small_class", "warning", (smallest == 1).cast("int")),
        ("null_features", "error", F.col("null_rows")),
        ("dtype_mismatch", "error", F.lit(len(non_numeric))),
        ("insufficient_rows", "error", (F.col("n") < 2).cast("int")),
        ("unknown_certificate_types", "warning", F.col("odd_types")),
    ]
    items = F.array(
        *[
            F.struct(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), v.cast("long").alias("violations"))
            for name, severity, v in checks
        ]
    )
    return row.select(F.explode(items).alias("c")).select("c.*")


def unexpected_values(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Distinct values outside an allowed domain."""
    return df.select(column).filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).distinct()


def readiness(df: DataFrame) -> DataFrame:
    """Dry-run summary: would this table pass training."""
    errors = schema_checks(df).filter("severity = 'error'").agg(F.sum("violations").alias("n")).scalar()
    issues = schema_alignment(df).filter("issue <> 'extra_column'").agg(F.count(F.lit(1)).alias("n")).scalar()
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("int")
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(label == 0).alias("genuine_count"),
        F.count_if(label == 1).alias("suspicious_count"),
    )
    return counts.withColumns({"schema_errors": errors, "alignment_errors": issues}).withColumn(
        "would_pass_training", (F.col("schema_errors") == 0) & (F.col("alignment_errors") == 0)
    )
