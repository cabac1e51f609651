"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, html_layout, katz, piece_codec, pivot_search, prefix_join, robust_outliers, spaced_seeds, suffix_dedup, token_alignment, toxicity,
    va_clusters, window_dedup,
)
from ._tables import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = robust_outliers.with_statistics(table(spark, sf_dir, "documents")).drop("text", "n_chars")
    judged = robust_outliers.judge(stored(counted))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("distance", 6).alias("distance"),
    )


@query
def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    coded = piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    decoded = piece_codec.decode(coded.select("doc_id", "token_ids"), model)
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_layout.extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text")


TOXIC_AT = 0.3


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    labels = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return toxicity.fit(docs.select("doc_id", "text"), labels)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
    )


@query
def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spaced_seeds.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "at")


@query
def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    model = katz.fit(docs, ~held_out)
    scored = katz.score(docs, model, fitted=True)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


@query
def op7_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = prefix_join.linked_documents(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", "n_shingles", "component_id")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = window_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.windows(rows, chat.turn_tokens(vocabulary("byte_bpe_50k.tiktoken"))))


@query
def op11_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_search.top_products(vectors, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score")


def aligned_vocabularies() -> tuple[str, str, str, str]:
    import public_tokenizers

    return vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, vocabulary("piece_bpe_32k.model")


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), aligned_vocabularies())


@query
def op13_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_clusters.described(va_clusters.cluster(table(spark, sf_dir, "embeddings")))
