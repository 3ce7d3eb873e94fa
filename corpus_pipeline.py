"""Corpus cleaning as a row of stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a
stage's rows as Parquet to the shared folder and reads them as the next one's docs.
All stages but the last keep the columns of ``documents``, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralens.llm import common, decontam, linededup, sentencepieces, simhash
from paralens.llm import queries as production
from paralens.llm import toxicity as toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity models don't reject."""
    score = "toxicity_score"
    while score in docs.columns:
        score += "_"
    return toxic.scored(docs, common.table(spark, sf_dir, "labels"), name=score).where(F.col(score) < production.TOXIC).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that match an earlier line; one whose words all went goes.

    ``n_chars`` follows the text where it is a column.
    """
    found = linededup.deduplicated(docs)
    left = found.where((F.size("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item was found."""
    return decontam.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, ids_crc32, parity, lossless, decoded) of each document."""
    return sentencepieces.encoded(docs, production.tokenizer_file("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: SQL can express neither the language models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after the other."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
