"""Structured Streaming twins of the batch operators.

Every job takes its source DataFrame from the caller and its checkpoint folder
as an argument, so it can resume after a lost executor or driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..functions.text import present
from ..operators.audit import prepare_events
from ..operators.drift import window_report
from ..operators.duplicates import fingerprint_array
from ..operators.history import distribution_pairs, metric_aggregates
from ..plans.verify import analyze


def read_documents(spark, path: str, schema, *, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def score_arrivals(docs: DataFrame, *, as_of: dt.date, known_issuer: Column | None = None) -> DataFrame:
    """Extraction and rules for arriving documents; stateless, so it equals the batch plan."""
    return analyze(docs, as_of=as_of, known_issuer=known_issuer)


def windowed_metrics(
    events: DataFrame, *, ts: str = "created_at", every: str = "1 day", watermark: str | None = None
) -> DataFrame:
    """Dashboard counts and means per time window; works on batch and stream alike."""
    src = events.withWatermark(ts, watermark) if watermark else events
    grouped = src.groupBy(F.window(F.col(ts), every).alias("w")).agg(*metric_aggregates())
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])


def start_append(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once per checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_event_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only audit log: severity, masking and truncation happen on the way in."""
    return start_append(prepare_events(events), path, checkpoint)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_occurrences(docs: DataFrame, *, seq: str, owner: str, doc_id: str) -> DataFrame:
    """Per document and non-blank fingerprint the earliest valid document with it, as a stateful stream.

    State: one (first seq, first id) per owner, kind and fingerprint, kept for good; a micro-batch touches only the keys it
    holds and never reads earlier documents. Error rows are looked up but not remembered, as in the batch
    plan. Only ids travel: of a fingerprint that fills a micro-batch a task holds its numbers, not its rows.
    A document without any fingerprint passes with rank 0.
    """
    seq_type, id_type = docs.schema[seq].dataType, docs.schema[doc_id].dataType
    long = docs.select(
        F.col(seq).alias("seq"), F.col(doc_id).alias("doc"), F.col(owner).cast("string").alias("owner"), (F.col("prediction") != "error").alias("valid"),
        F.explode(fingerprint_array(with_document=True)).alias("f"),
    ).select("seq", "doc", "valid", "owner", "f.rank", "f.kind", "f.value")
    own_row = F.col("rank") == 0
    long = long.filter(own_row | present(F.col("value")) & F.col("owner").isNotNull())
    long = long.withColumn("value", F.when(own_row, F.pmod(F.xxhash64("seq"), F.lit(1024)).cast("string")).otherwise(F.col("value")))
    output = ST.StructType([
        ST.StructField("seq", seq_type), ST.StructField("doc", id_type), ST.StructField("rank", ST.IntegerType()), ST.StructField("kind", ST.StringType()),
        ST.StructField("first_doc", id_type),
    ])
    state_type = ST.StructType([ST.StructField("seq", seq_type), ST.StructField("doc", id_type)])

    def remember(key, chunks, state):
        import pandas as pd

        parts = [chunk[["seq", "doc", "valid", "kind"]] for chunk in chunks]
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"seq": [], "doc": [], "valid": [], "kind": []})
        rank = int(key[1])
        first = None
        if rank:
            first = state.get if state.exists else None
            valid = rows[rows["valid"].fillna(False).astype(bool)]
            if len(valid):
                new = valid.loc[valid["seq"].idxmin()]
                if first is None or new["seq"] < first[0]:
                    first = (new["seq"].item() if hasattr(new["seq"], "item") else new["seq"], new["doc"].item() if hasattr(new["doc"], "item") else new["doc"])
                    state.update(first)
        later = rows["seq"] > first[0] if first is not None else pd.Series(False, index=rows.index)
        yield pd.DataFrame({
            "seq": rows["seq"], "doc": rows["doc"], "rank": rank, "kind": rows["kind"],
            "first_doc": pd.Series([first[1] if is_later else None for is_later in later], index=rows.index, dtype=object),
        })

    grouped = long.groupBy("owner", "rank", "value")
    return grouped.applyInPandasWithState(remember, output, state_type, "append", "NoTimeout")


def start_duplicate_check(
    docs: DataFrame, report_path: str, checkpoint: str, *, seq: str, owner: str, doc_id: str
) -> StreamingQuery:
    """Exact duplicate lookup of arriving documents against all earlier ones, whatever their number.

    Writes (seq, doc_id, is_duplicate, duplicate_of, duplicate_type, batch_id) per document. The first occurrences live in a
    state store on disk beside the checkpoint. A document counts as earlier by `seq`; one that arrives late changes what
    comes after it, not what has been reported. A replayed batch starts from the state before it and
    overwrites its own folder, so a retry changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        best = F.min(F.when(F.col("first_doc").isNotNull(), F.struct("rank", "kind", "first_doc"))).alias("b")
        report = batch.groupBy("seq", "doc").agg(best).select(
            F.col("seq").alias(seq), *([F.col("doc").alias(doc_id)] if doc_id != seq else []), F.col("b").isNotNull().alias("is_duplicate"),
            F.col("b.first_doc").alias("duplicate_of"), F.col("b.kind").alias("duplicate_type"), F.lit(batch_id).cast("long").alias("batch_id"),
        )
        write_batch(report, report_path)

    spark = docs.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)  # read once, when the query starts; the checkpoint remembers it
    try:
        found = first_occurrences(docs, seq=seq, owner=owner, doc_id=doc_id)
        return found.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def write_batch(rows: DataFrame, path: str) -> None:
    """Write the rows of one micro-batch to its own folder, replacing what an earlier attempt left there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def drop_recent_duplicates(docs: DataFrame, *, keys: list[str], ts: str, within: str) -> DataFrame:
    """Bounded-state variant: drops copies that arrive within a time span."""
    return docs.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def drift_counts(docs: DataFrame, *, ts: str = "created_at", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, dimension, value, n) counts of closed windows, also of scores rounded to four places.

    On a stream a window is given once, when the watermark passes its end; rows that come later are dropped. A window
    into which nothing fell is not given. On a batch all windows are given.
    """
    ok = F.col("prediction") != "error"
    score = F.when(
        ok & F.col("risk_score").isNotNull(),
        F.array(F.struct(F.lit("risk_score").alias("dimension"), F.round("risk_score", 4).cast("string").alias("value"))),
    ).otherwise(F.array().cast("array<struct<dimension:string,value:string>>"))
    timed = docs.withWatermark(ts, late) if docs.isStreaming else docs
    pairs = timed.select(F.col(ts).alias("_ts"), F.explode(F.concat(distribution_pairs(), score)).alias("p"))
    counts = pairs.groupBy(F.window("_ts", every).alias("w"), "p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "dimension", "value", "n")


def start_drift_watch(
    docs: DataFrame, baseline: DataFrame, report_path: str, checkpoint: str, *, ts: str = "created_at", every: str = "1 day",
    late: str = "1 hour", threshold: float = C.JSD_ALERT,
) -> StreamingQuery:
    """Each closed time window against a stored snapshot: distances, score shifts and verdicts.

    Windows are judged one by one, so a long calm past does not fade a new shift. A replayed batch gives the same
    windows and overwrites its own folder.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(window_report(baseline, batch, threshold=threshold).withColumn("batch_id", F.lit(batch_id).cast("long")), report_path)

    counts = drift_counts(docs, ts=ts, every=every, late=late)
    return counts.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
