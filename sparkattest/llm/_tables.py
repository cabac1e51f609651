"""Intermediate tables in the shared folder, column-name hygiene, and keys of documents."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

NO_ID = -(2**63)


def release(spark: SparkSession) -> None:
    """Ask for garbage collection, so that Spark deletes the shuffle files of plans no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write the rows to the folder that driver and executors share and read them back.

    This cuts the lineage at files that outlive any executor.
    """
    spark = df.sparkSession
    release(spark)
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of `stored` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has, ignoring case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks(spark: SparkSession) -> int:
    """How many reduce tasks the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_number(docs: DataFrame, doc_id: str) -> Column:
    """A doc_id as a long, `NO_ID` for null. Ids of other types than integers become 64-bit hashes."""
    kind = docs.schema[doc_id].dataType
    number = F.col(doc_id).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(F.col(doc_id))
    return F.when(F.col(doc_id).isNull(), F.lit(NO_ID)).otherwise(number)


def ids_repeat(docs: DataFrame, own: Column) -> bool:
    return not docs.groupBy(own.alias("own")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty()


def document_key(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, bool]:
    """A long that tells documents, which are a doc_id with a text, apart; and whether a doc_id repeats.

    While none does the key is the doc_id, null being `NO_ID`; else it is a 64-bit hash of both.
    """
    own = own_number(docs, doc_id)
    if not ids_repeat(docs, own):
        return own, False
    return F.xxhash64(F.col(doc_id).isNull(), own, F.col(text).isNull(), F.col(text)), True
