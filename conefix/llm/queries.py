"""The thin queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conefix.llm import centroids, chat, chunk_dedup, conversation_trie, decontaminate, html, matroska, packing, secret_scan, simhash, sql, tokens, toxicity, wacz
from conefix.session import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), simhash.Scheme())
    return found.select("doc_id", F.lower(F.hex("sketch")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_and_read(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wacz.archive_and_read(read_table(spark, sf_dir, "pages")).drop("url")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), own.alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.format_and_read(rows.withColumn("parts", chat.text_parts(F.col("text"))))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.learn(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read_table(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.deduplicate(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_toxicity": op2_toxicity,
        "op3_packing": op3_packing,
        "op4_token_counts": op4_token_counts,
        "op5_matroska": op5_matroska,
        "op6_warc": op6_warc,
        "op7_chat": op7_chat,
        "op8_secret_scan": op8_secret_scan,
        "op9_decontamination": op9_decontamination,
        "op10_main_text": op10_main_text,
        "op11_centroids": op11_centroids,
        "op12_chunk_dedup": op12_chunk_dedup,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": sql.WARC, "op7_chat": sql.CHAT, "op9_decontamination": sql.DECONTAMINATE, "op11_centroids": sql.CENTROIDS, "op12_chunk_dedup": sql.CHUNK_DEDUP, "op13_conversation_trie": sql.TRIE}
