"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture doubles the time to build large expressions from Python.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str | int = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sparkattest")
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    shuffle = "8" if cores == "*" else str(cores)
    builder = builder.config("spark.sql.shuffle.partitions", shuffle)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: HotSpot compiles no method of more bytes of code; Spark's own limit is 65,535, and a stage between the two runs interpreted
COMPILED_BYTES = 8_000


def keep_methods_compiled(spark: SparkSession) -> None:
    """Let Spark run a stage operator by operator, in small methods, where its one generated method would not be compiled.

    Sets `spark.sql.codegen.hugeMethodLimit` of the session, unless the session has a limit of its own.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, str(COMPILED_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, because executors share no local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    A columnar table instead of an in-memory checkpoint: it survives the loss of
    executors, later steps read only the columns they need, and its size is known
    to the optimizer.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
