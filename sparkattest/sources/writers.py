"""Writers: training tables, manifests, exports, snapshots, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C


def table_checksum(df: DataFrame) -> Column:
    """Order-free checksum of all rows; a decimal sum, so repeated rows count."""
    return F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")).cast("string")


def write_training_table(df: DataFrame, path: str, *, dataset: str) -> DataFrame | None:
    """Write the feature table, then its one-row metadata from what was written; nothing for empty input."""
    if df.isEmpty():  # reads until the first row
        return None
    rows = f"{path}/rows"
    df.write.mode("overwrite").partitionBy("label").parquet(rows)
    written = df.sparkSession.read.schema(df.schema).parquet(rows)
    meta = written.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("label") == 0).alias("genuine_count"),
        F.count_if(F.col("label") == 1).alias("suspicious_count"), table_checksum(written.select(*df.columns)).alias("checksum"),
    ).withColumns(
        {
            "dataset": F.lit(dataset), "feature_schema_version": F.lit(C.FEATURE_SCHEMA_VERSION),
            "features": F.array(*[F.lit(c) for c in C.FEATURE_COLUMNS]),
        }
    )
    meta.write.mode("overwrite").json(f"{path}/metadata")
    return meta


def file_id(sha: Column) -> Column:
    """Deterministic id of a hash, whole."""
    return F.sha1(F.concat(F.lit("document:"), sha))


def manifest_records(entries: DataFrame) -> DataFrame:
    """Provenance record per ingested file."""
    return entries.select(
        file_id(F.col("sha256")).alias("file_id"), F.left(file_id(F.col("sha256")), F.lit(16)).alias("short_id"), "sha256", "label",
        "original_filename",
        F.col("label").alias("source_dir"),
        *[
            (F.coalesce(F.col(c), F.lit("pending")) if c in entries.columns else F.lit("pending")).alias(c)
            for c in ("extraction_status", "feature_extraction_status", "duplicate_status")
        ],
    )


def manifest_summary(records: DataFrame) -> DataFrame:
    """Counts by label and status, in one row."""
    return records.agg(
        F.count(F.lit(1)).alias("total_records"),
        *[F.count_if(F.col("label") == v).alias(f"{v}_count") for v in ("genuine", "suspicious", "uncertain")],
        F.count_if(F.col("extraction_status") == "success").alias("extraction_success_count"),
        F.count_if(F.col("feature_extraction_status") == "success").alias("feature_success_count"),
        F.count_if(F.col("duplicate_status") == "unique").alias("unique_count"),
        F.count_if(F.col("duplicate_status") == "duplicate").alias("duplicate_count"),
        F.count_if(F.col("duplicate_status") == "external_validation").alias("external_validation_rejected"),
    )


def write_manifest(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(f"{path}/records")
    manifest_summary(records).repartition(1).write.mode("overwrite").json(f"{path}/summary")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_candidate_batch(df: DataFrame, path: str) -> None:
    """Candidate rows partitioned by batch and split; only these partitions are replaced."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_batch", "split").parquet(path)
    )


def split_write_back(feedback: DataFrame, assigned: DataFrame) -> DataFrame:
    """Feedback rows with the new split and batch where one was assigned."""
    new = assigned.select("verification_id", F.col("split").alias("_split"), F.col("dataset_batch").alias("_batch"))
    old = {c: (F.col(c) if c in feedback.columns else F.lit(None).cast("string")) for c in ("split", "dataset_batch")}
    return feedback.join(new, "verification_id", "left").withColumns(
        {"split": F.coalesce("_split", old["split"]), "dataset_batch": F.coalesce("_batch", old["dataset_batch"])}
    ).drop("_split", "_batch")


POINTER = "CURRENT"


def _pointer(spark: SparkSession, path: str) -> tuple:
    """The pointer file of a versioned table and the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path(folder, POINTER), hadoop


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names, None before the first one."""
    fs, pointer, _ = _pointer(spark, path)
    return spark.read.text(pointer.toString()).first()[0] if fs.exists(pointer) else None


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current version of a versioned table."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no published version")
    return spark.read.parquet(f"{path}/{version}")


def write_version(rows: DataFrame, path: str, version: str) -> None:
    """Publish rows as a version of a table; readers see the old version or the new one, never a part.

    The rows go to a folder of their own. Only when they are complete a new pointer file is written beside the old one and
    put in its place by one rename. A crash before that leaves the old version current, and a rerun replaces what it left
    behind. Versions may read each other, so the one that is current cannot be overwritten.
    """
    spark = rows.sparkSession
    if current_version(spark, path) == version:
        raise ValueError(f"version {version} of {path} is current and cannot be overwritten")
    rows.write.mode("overwrite").parquet(f"{path}/{version}")
    fs, pointer, hadoop = _pointer(spark, path)
    staged = hadoop.Path(pointer.getParent(), f"{POINTER}-{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE")
    context.rename(staged, pointer, options)


def write_report(tidy: DataFrame, path: str) -> None:
    """A report is a tidy table of at most a few thousand rows: one JSON file."""
    tidy.repartition(1).write.mode("overwrite").json(path)


def save_snapshot(snapshot: DataFrame, path: str, snapshot_id: str) -> None:
    (
        snapshot.withColumn("snapshot_id", F.lit(snapshot_id)).repartition(1).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)
    )


def load_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def log_run(spark: SparkSession, path: str, *, run_id: str, experiment: str, version: str, timestamp: str, model: str, metrics: dict, params: dict) -> None:
    from .readers import RUN_SCHEMA

    row = [(run_id, experiment, version, timestamp, model, {k: float(v) for k, v in metrics.items()}, {k: str(v) for k, v in params.items()})]
    spark.createDataFrame(row, RUN_SCHEMA).write.mode("append").json(path)


def save_model(model: PipelineModel, path: str, version: str, *, promoted: bool = False) -> None:
    """Save under its version with a metadata row; promotion is an explicit choice."""
    model.write().overwrite().save(f"{path}/{version}")
    spark = SparkSession.getActiveSession()
    row = [(version, promoted, C.FEATURE_SCHEMA_VERSION, C.FEATURE_COLUMNS)]
    spark.createDataFrame(row, "version string, promoted boolean, feature_schema string, features array<string>").write.mode(
        "overwrite"
    ).json(f"{path}/{version}_metadata")


def union_evolved(*tables: DataFrame) -> DataFrame:
    """Tables of different generations as one; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
