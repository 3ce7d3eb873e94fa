"""Quality rules with a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words are runs outside ``\\x20`` and ``\\x09-\\x0D`` (no case folding).  Every word and
every pair of neighbouring words falls into one of ``buckets`` by its hash.  Two
multinomials over the buckets, one of trusted documents and one of the whole corpus,
are counted over all whole texts and smoothed by one; a document's ratio is the sum
of log p_trusted - log p_corpus over its n-grams divided by their number.  It is kept
if the ratio is at least the threshold and the base rules hold.

The threshold follows from the data unless it is given: trusted documents whose id has
remainder ``HELD_OUT`` of crc32 by ``FOLDS`` stay out of the trusted counts, and the
threshold is the largest multiple of 1/``STEPS`` that at least the share ``keep`` of
them reaches.  Without any, every ratio passes.

The weights, one double for each bucket, are all that leaves the executors.  Labels
of a checked size are broadcast to mark trusted rows; more of them are joined in a
shuffle.

Null texts have no words; a text without n-grams has ratio 0; without trusted rows
every ratio is 0.  Repeated rows count each; an id is trusted only if all its labels
are 1.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, WINDOW, BROADCAST_LABELS = 10_000, 8, 2_000_000
KEEP, HELD_OUT, FOLDS, STEPS = 0.98, 2, 4, 1000
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " ", -1), "")


def _hashes(words_: str) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _grams(hashes: str, buckets: int) -> Column:
    """Buckets of all words and pairs of words, from the words' hashes."""
    n = F.size(hashes)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _marks(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(label_id, fold) of the trusted documents, ready for a join."""
    marks = labels.groupBy(F.col(key).alias("label_id")).agg(F.min(F.col(label).cast("int")).alias("low")).where("low = 1 and label_id is not null")
    small = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    marks = marks.select("label_id", F.pmod(F.crc32(F.col("label_id").cast("string")), F.lit(FOLDS)).alias("fold"))
    return F.broadcast(marks) if small else marks


def weights(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", buckets: int = BUCKETS, held_out: int | None = None) -> list[float]:
    """log p_trusted - log p_corpus of each bucket; trusted documents of the fold ``held_out`` count for the corpus only."""
    source = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    marks = _marks(labels, key, label)
    if held_out is not None:
        marks = marks.where(F.col("fold") != held_out)
    rows = source.join(marks, source["id"] == marks["label_id"], "left").select("text", F.col("label_id").isNotNull().cast("int").alias("trusted"))
    hashed = rows.where("text is not null").select("trusted", words(F.col("text")).alias("w")).select("trusted", _hashes("w").alias("h"))
    grams = hashed.select("trusted", F.explode(_grams("h", buckets)).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("corpus"), F.sum("trusted").alias("trusted"))
    corpus, trusted = [0] * buckets, [0] * buckets
    for row in counted.collect():  # one row for each bucket at most
        corpus[row["bucket"]], trusted[row["bucket"]] = row["corpus"], row["trusted"]
    if not sum(trusted):
        return [0.0] * buckets
    of_corpus, of_trusted = math.log(sum(corpus) + buckets), math.log(sum(trusted) + buckets)
    return [math.log(t + 1) - of_trusted - math.log(c + 1) + of_corpus for t, c in zip(trusted, corpus)]


def _repeated(docs: DataFrame, window: int) -> DataFrame:
    """Adds n_repeat_words: words in windows found twice or more in the text, from the column of word hashes ``h``."""
    n = F.size("h")
    none = F.array().cast("array<bigint>")
    docs = docs.withColumn("win", F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(F.slice("h", i + 1, window)))).otherwise(none))
    docs = docs.withColumn("again", F.size(F.array_distinct("win")) < F.size("win"))
    placed = F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    docs = docs.withColumn("placed", F.when(F.col("again"), placed))
    found = F.filter("placed", lambda s, k: (s["x"] == F.get("placed", k - 1)["x"]) | (s["x"] == F.get("placed", k + 1)["x"]))
    docs = docs.withColumn("starts", F.when(F.col("again"), F.sort_array(F.transform(found, lambda s: s["i"]))))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return docs.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(F.lit(0).cast("long"))).drop("win", "again", "placed", "starts")


def _ratio(rows: DataFrame, weight: list[float], buckets: int) -> DataFrame:
    """Adds ratio, from the column of word hashes ``h``."""
    rows = rows.withColumn("grams", _grams("h", buckets))
    table = F.lit(np.array(weight))
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return rows.withColumn("ratio", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0))


def derived_threshold(docs: DataFrame, labels: DataFrame, weight: list[float], key: str = "doc_id", text: str = "text", label: str = "quality", keep: float = KEEP) -> float:
    """The threshold that the share ``keep`` of the held-out trusted documents reaches; counts by step are all that is collected."""
    marks = _marks(labels, key, label).where(F.col("fold") == HELD_OUT)
    source = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("t")).where("t is not null")
    rows = source.join(marks, source["id"] == marks["label_id"]).select(words(F.col("t")).alias("w")).where(F.size("w") > 0).select(_hashes("w").alias("h"))
    steps = _ratio(rows, weight, len(weight)).groupBy(F.floor(F.col("ratio") * STEPS).alias("step")).agg(F.count("*").alias("n")).collect()
    above, least = 0, keep * sum(r["n"] for r in steps)
    for row in sorted(steps, key=lambda r: -r["step"]):
        above += row["n"]
        if above >= least:
            return row["step"] / STEPS
    return -math.inf


def assessed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", buckets: int = BUCKETS, threshold: float | None = None, window: int = WINDOW, keep: float = KEEP) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept) of every row.

    The base rules fail a text with fewer than 20 words, or with over 30 % of its
    words in repeated windows.
    """
    weight = weights(docs, labels, key, text, label, buckets, HELD_OUT if threshold is None else None)
    if threshold is None:
        threshold = derived_threshold(docs, labels, weight, key, text, label, keep)
    t = F.col("t")
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    rows = docs.select(docs[key].alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumns({"w": words(t), "lines": lines})
    rows = rows.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _hashes("w").alias("h"),
    )
    rows = _ratio(_repeated(rows, window), weight, buckets)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", (~F.col("base_failed") & (F.col("ratio") >= F.lit(threshold))).alias("kept"))
