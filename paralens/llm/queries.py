"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convrepair, convtrie, decontam, exactdedup, htmltext, linededup, pii, quality, sentencepieces, simhash, tokenbin, toxicity, urlfilter
from .common import shared, table

END_OF_TEXT = 2
#: least score of a document that is predicted toxic
TOXIC = 0.3
#: fixed values: the url rules and their verdicts
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def tokenizer_file(name: str) -> str:
    """The place of one of the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "text", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines", "n_links")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.rendered(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assessed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), name="score")
    return scored.select("doc_id", (toxicity.fold("doc_id") == toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.found_in(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared(spark)}/token-shards-{uuid.uuid4().hex}"
    tokenbin.write(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), END_OF_TEXT)
    return tokenbin.read(spark, path).withColumnRenamed("id", "doc_id")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.of_damaged(table(spark, sf_dir, "conversations")).withColumnRenamed("id", "conv_id")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(convtrie.rebuilt(convtrie.sequences(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_text": op4_html_text,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_personal_data": op9_personal_data,
    "op10_token_binary": op10_token_binary,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": urlfilter.sql(URL_RULES),
    "op11_exact_dedup": exactdedup.sql(),
    "op13_conversation_trie": convtrie.sql(),
}
