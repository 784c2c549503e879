"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, counts, graph, middle, packing, ranked, secrets, simhash, sql, topk, toxicity, warc, wrapper

#: Sizes that the queries are run with.
SEQUENCE = 2048
TOKEN_LIMIT = 512


#: The tools that conversations may call.
TOOLS = {
    "calculate": {"expression": ("string", True), "digits": ("integer", False)},
    "fetch": {"url": ("string", True), "timeout": ("number", False), "follow": ("boolean", False)},
    "search": {"query": ("string", True), "limit": ("integer", False), "filters": ("object", False), "fields": ("array", False)},
}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), SEQUENCE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("toxic", scored["p_toxic"] > toxicity.THRESHOLD)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), most=5, every=50, scale=256)


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.shown(simhash.groups(docs, words=4, bits=64, radius=4))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), most=5, every=50)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"), chat.tool_schemas(spark, TOOLS))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("file", "start", "end")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"), TOKEN_LIMIT)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), most=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, XXH64 with a seed, graphs and classifier chains are beyond SQL; their queries are tested against plain versions."""
    return {"op3_exact_top_k": sql.TOP_K, "op6_secret_scans": sql.secret_scans(), "op8_chat_formatting": sql.CHAT, "op9_warc": sql.WARC, "op11_fill_in_middle": sql.MIDDLE, "op13_ranked_search": sql.RANKED}
