"""Readers: document folders, CSV with a fixed schema, manifests, registries, run logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import constants as C

RAW_RECORD_SCHEMA = ST.StructType(
    [
        *[ST.StructField(c, ST.StringType()) for c in ("cert_id", "issuer", "issue_date", "candidate_name", "course", "organization")],
        ST.StructField("marks_total", ST.DoubleType()), ST.StructField("marks_obtained", ST.DoubleType()),
        ST.StructField("grade", ST.StringType()),
        *[ST.StructField(c, ST.BooleanType()) for c in ("has_signature", "has_seal", "has_qr", "has_url")],
        *[ST.StructField(c, ST.StringType()) for c in ("text_snippet", "title", "certificate_type")],
        *[ST.StructField(c, ST.DoubleType()) for c in ("blank_ratio", "sharpness", "noise_level")],
        ST.StructField("color_anomaly", ST.IntegerType()), ST.StructField("label", ST.IntegerType()),
    ]
)
FEATURE_SCHEMA = ST.StructType(
    [
        *[
            ST.StructField(c, ST.DoubleType() if c in C.DOUBLE_FEATURES else ST.IntegerType())
            for c in C.FEATURE_COLUMNS
        ],
        ST.StructField("label", ST.IntegerType()), ST.StructField("certificate_type", ST.StringType()),
    ]
)
REGISTRY_SCHEMA = ST.StructType(
    [
        ST.StructField("name", ST.StringType()), ST.StructField("aliases", ST.ArrayType(ST.StringType())),
        ST.StructField("verification_domain", ST.StringType()),
        ST.StructField("verification_url_pattern", ST.StringType()),
        ST.StructField("issuer_type", ST.StringType()), ST.StructField("country", ST.StringType()),
        ST.StructField("verification_methods", ST.ArrayType(ST.StringType())),
        ST.StructField("identifier_types", ST.ArrayType(ST.StringType())),
        ST.StructField("verification_endpoint", ST.StringType()), ST.StructField("enabled", ST.BooleanType()),
        ST.StructField("official_verification_url", ST.StringType()),
        ST.StructField("verification_note", ST.StringType()),
        ST.StructField("verification_success_marker", ST.StringType()),
        ST.StructField("verification_negative_marker", ST.StringType()),
    ]
)
MANIFEST_RECORD = ST.StructType(
    [
        ST.StructField(c, ST.StringType())
        for c in (
            "file_id", "sha256", "label", "original_filename", "source_dir", "extraction_status",
            "feature_extraction_status", "duplicate_status", "ingested_at",
        )
    ]
)


def read_csv(spark: SparkSession, path: str, schema: ST.StructType = RAW_RECORD_SCHEMA, *, whole_files: bool = True) -> DataFrame:
    """CSV with a declared schema: no inference pass over the data.

    With `whole_files` one task reads a file, because a quoted field may hold line breaks; otherwise
    `read_csv_ranges` cuts the files into byte ranges.
    """
    if not whole_files:
        return read_csv_ranges(spark, path, schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


#: most byte ranges that start inside quotes whose list is broadcast; more are joined by shuffle
MAX_BROADCAST_RANGES = 100_000
_PIECE = "file string, start long, part int, piece string"


def read_csv_ranges(spark: SparkSession, path: str, schema: ST.StructType = RAW_RECORD_SCHEMA) -> DataFrame:
    """CSV with a header, quoted line breaks included, read by byte range.

    A line break ends a record only where an even number of quotes precedes it. Quotes are counted per
    range; the running parity over the ranges of a file (a row per range) tells which ranges
    start inside a quoted field. Each range then cuts its own records; the ends that two ranges share
    are put together by a shuffle that carries only those.

    The files follow RFC 4180: quotes occur around fields and doubled inside them. A file with an odd
    number of quotes is an error when it is read. Blank lines give no row, an empty field is NULL, a file with a header alone is
    empty, and every file has a header.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long")
    counted = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = counted.select("file", "start", F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("seen")).filter("seen % 2 = 1")
    inside = inside.select("file", "start", F.lit(True).alias("inside"))
    if inside.limit(MAX_BROADCAST_RANGES + 1).count() <= MAX_BROADCAST_RANGES:
        flagged = lines.join(F.broadcast(inside), ["file", "start"], "left").select("file", "start", "inside", "value")
    else:  # lines keep their order inside a range by number
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        by_range = numbered.join(inside, ["file", "start"], "left").repartition("file", "start").sortWithinPartitions("file", "start", "at")
        flagged = by_range.select("file", "start", "inside", "value")
    pieces = flagged.mapInArrow(_cut_records, _PIECE)
    # parts: 0 whole records, 1 the end of a record begun earlier, 2 a range inside one record, 3 the begin of a record
    shared = pieces.filter("part > 0")
    order = Window.partitionBy("file").orderBy("start", "part")
    owned = shared.withColumn("record", F.sum((F.col("part") == 3).cast("int")).over(order))
    joined = owned.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "part", "piece"))).alias("pieces"), F.max((F.col("part") == 1).cast("int")).alias("closed")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n")
    message = F.concat(F.lit("odd number of quotes in "), F.col("file"))
    whole = joined.select(F.when(F.col("closed") == 1, text).otherwise(F.raise_error(message)).alias("piece"))
    records = pieces.filter("part = 0").select("piece").unionByName(whole)
    row = F.from_csv(F.col("piece"), schema.simpleString(), {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return records.select(row.alias("row")).select("row.*")


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the ranges of a partition; ends shared with other ranges are marked by part.

    A range with one record that neither begins nor ends in it is part 2. The first record of a file is
    its header and left out.
    """
    at: tuple[str, int] | None = None
    held: list[str] = []
    odd = False  # inside a quoted field
    borrowed = False  # the open record began in an earlier range
    header = False
    out: list[tuple[str, int, int, str]] = []

    def close(part: int) -> None:
        nonlocal header, borrowed
        text = "\n".join(held)
        held.clear()
        if header and part == 0:
            header = False
        elif part or text.strip("\r"):
            out.append((*at, part, text.removesuffix("\r") if part in (0, 1) else text))
        borrowed = False

    def finish() -> None:
        if held:
            close(2 if borrowed else 3)

    for batch in batches:
        for file, start, inside, value in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (file, start) != at:
                finish()
                at, odd, borrowed, header = (file, start), bool(inside), bool(inside), start == 0
            held.append(value)
            odd ^= value.count('"') % 2 == 1
            if not odd:
                close(1 if borrowed else 0)
        if out:
            yield _piece_batch(out)
            out.clear()
    finish()
    if out:
        yield _piece_batch(out)


def _piece_batch(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    file, start, part, piece = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.string()), pa.array(start, pa.int64()), pa.array(part, pa.int32()), pa.array(piece, pa.string())],
        names=["file", "start", "part", "piece"],
    )


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A database table split by a numeric key into parallel range reads."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, **options)
        .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()
    )


def read_labeled_files(spark: SparkSession, base: str) -> DataFrame:
    """Files under genuine/, suspicious/ and uncertain/ of the base folder with their label.

    The label is the first folder below the base, whatever folders lie above or further down.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    tagged = files.withColumns(
        {
            "label": F.regexp_extract("path", re.escape(re.sub(r"^[a-z]+:/*(?=/)", "", base).rstrip("/")) + r"/+(genuine|suspicious|uncertain)/", 1),
            "original_filename": F.regexp_extract("path", r"([^/]+)$", 1),
            "extension": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)),
        }
    )
    return tagged.filter((F.col("label") != "") & F.col("extension").isin(C.ACCEPTED_EXTENSIONS))


def reject_reason(filename: Column, length: Column, content: Column, max_bytes: int = C.MAX_FILE_BYTES) -> Column:
    """Why a file is not admitted: missing_name, extension, size or magic; NULL when it is."""
    extension = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    magic = F.lit(False)
    for name, marker in C.MAGIC_BYTES.items():
        head = F.hex(F.substring(content, 1, len(marker)))
        magic = F.when(extension == name, head == marker.hex().upper()).otherwise(magic)
    return (
        F.when(F.coalesce(F.trim(filename), F.lit("")) == "", "missing_name")
        .when(~extension.isin(C.ACCEPTED_EXTENSIONS), "extension")
        .when(length > max_bytes, "size")
        .when(~F.coalesce(magic, F.lit(False)), "magic")
    )


def admit(files: DataFrame, *, filename: str = "original_filename") -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected with reject_reason)."""
    tagged = files.withColumn("reject_reason", reject_reason(F.col(filename), F.col("length"), F.col("content")))
    return tagged.filter("reject_reason IS NULL").drop("reject_reason"), tagged.filter("reject_reason IS NOT NULL")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a manifest that `write_manifest` wrote: one JSON object a line."""
    return spark.read.schema(MANIFEST_RECORD).json(f"{path}/records")


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """Records of a manifest kept as one JSON document."""
    schema = ST.StructType([ST.StructField("records", ST.ArrayType(MANIFEST_RECORD))])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Expectation manifest (path to category, expected, source, note) as rows."""
    entry = "struct<category:string,expected:string,source:string,note:string>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{entry}>").alias("m"))
    return whole.select(F.explode("m").alias("path", "e")).select("path", "e.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    schema = ST.StructType([ST.StructField("issuers", ST.ArrayType(REGISTRY_SCHEMA))])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("issuers").alias("i")).select("i.*")


RUN_SCHEMA = "run_id string, experiment string, version string, timestamp string, model string, metrics map<string,double>, params map<string,string>"


def read_runs(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    runs = spark.read.schema(RUN_SCHEMA).json(path)
    return runs.filter(F.col("experiment") == experiment) if experiment else runs
