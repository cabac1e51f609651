"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of documents. Null texts count as empty; empty tables stay
empty; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkattest.llm import piece_codec, prefix_join, spaced_seeds, toxicity, window_dedup
from sparkattest.llm._tables import fresh, stored
from sparkattest.llm.queries import TOXIC_AT, table, toxicity_model, vocabulary

#: stretches a worker remembers in the last stage, where the decoding workers run beside the encoding ones
REMEMBERED = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the toxicity query."""
    score = fresh(docs, "toxicity_score")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), out=score)
    return scored.filter(F.col(score) < TOXIC_AT).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return prefix_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier; n_chars follows where a text changes."""
    cut = window_dedup.remove_repeats(docs)
    changed = F.col(cut.columns[len(docs.columns) + 1]) > 0
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return spaced_seeds.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece ids and the text decoded from them."""
    model = vocabulary("piece_bpe_32k.model")
    coded = piece_codec.encode(docs, model, remembered=REMEMBERED)
    return piece_codec.decode(coded, model, ids=coded.columns[-1])


STAGES = [
    ("drop_toxic", drop_toxic),
    ("keep_one_of_near_copies", keep_one_of_near_copies),
    ("cut_repeated_passages", cut_repeated_passages),
    ("drop_benchmark_leaks", drop_benchmark_leaks),
    ("encode_pieces", encode_pieces),
]
#: trained scores, transitive links and piece ids are not SQL; tests/llm covers the operators that the stages call
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
