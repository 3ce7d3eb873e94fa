"""Exact deduplication: the codes, the exchange, and brute force on odd tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paralens.llm import exactdedup

ODD = [None, "", " ", "x", "x ", "日本語", "word " * 5000, "word " * 5000, "é" * 3000, None, "a\nb", "a\r\nb"]


def brute(rows):
    """{(id, text): sorted (keep_id, size, kept)} of (id, text) rows."""
    same = defaultdict(list)
    for k, t in rows:
        same[t or ""].append(k)
    out = []
    for t, ids in same.items():
        top = max((k for k in ids if k is not None), default=None)
        left = True
        for k in ids:
            kept = left and k == top
            left = left and not kept
            out.append((k, top, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("id", "keep_id", "group_size", "kept", "sha256").collect()), key=repr)


@pytest.mark.parametrize(("n", "bits"), [(0, 20), (1, 1), (1, 30), (7, 3), (300, 12), (5000, 40)])
def test_golomb_codes_come_back(n, bits):
    r = np.random.default_rng(n + bits)
    base = 5 << bits
    values = np.unique(r.integers(0, 1 << bits, n)) + base
    if n:
        values = np.unique(np.append(values, [base, base + (1 << bits) - 1][: n]))
    coded = exactdedup.golomb(values, base, 1 << bits)
    assert exactdedup.ungolomb(len(values), base, *coded).tolist() == values.tolist()
    if n == 5000:
        assert sum(map(len, coded[1:])) * 8 < len(values) * (bits - 12 + 3)


def test_groups_equal_brute_force(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(r.choices("ab cd ef gh".split(), k=r.randint(0, 4))) for _ in range(300)] + ODD
    rows = [(k if r.random() < 0.95 else None, t) for k, t in enumerate(texts)]
    rows += [(1000, "hot")] * 3 + [(k, "hot") for k in range(400)] + [rows[3], rows[3]]
    r.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "v", 1, True, "p") for k, t in rows], "doc_id long, text string, id string, at int, suspect boolean, path string")
    want = brute(rows)
    assert found(exactdedup.groups(docs)) == want
    # read from several files, in several scans, with pieces and owners of a few rows
    docs.repartition(5).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    for options in ({}, {"broadcast_bytes": 1, "piece_rows": 50, "owner_rows": 100}, {"broadcast_bytes": 1600, "spare": 0}):
        assert found(exactdedup.groups(read, **options)) == want
    kept = exactdedup.deduplicated(read.where("doc_id is not null or text is null"))
    assert kept.columns == docs.columns
    assert sorted((x["text"] or "") for x in kept.collect()) == sorted({t or "" for k, t in rows if k is not None or t is None})


def test_empty_tables_and_columns_of_that_name(spark):
    docs = spark.createDataFrame([(1, "a", "m"), (2, "a", "m"), (3, "b", "m")], "k long, body string, _metadata string")
    assert found(exactdedup.groups(docs, "k", "body")) == brute([(1, "a"), (2, "a"), (3, "b")])
    assert exactdedup.groups(docs.limit(0), "k", "body").count() == 0


def test_few_texts_without_a_copy_are_suspected(spark, monkeypatch, tmp_path):
    """The exchange spares unique texts the shuffle and misses no copy."""
    spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 3900).alias("text")).repartition(6).write.parquet(str(tmp_path / "docs"))
    seen = {}
    real = exactdedup.stored

    def stored(df, name):
        seen[name] = real(df, name)
        return seen[name]

    monkeypatch.setattr(exactdedup, "stored", stored)
    assert exactdedup.groups(spark.read.parquet(str(tmp_path / "docs"))).where("kept").count() == 3900
    marked = sum(bin(w & (2**64 - 1)).count("1") for x in seen["exact-suspects"].collect() for w in x["words"])
    assert 200 <= marked <= 200 + 3800 / 256 * 3 + 10
    assert {x["n"] > 0 for x in seen["exact-fingerprints"].select("n").collect()} == {True}
