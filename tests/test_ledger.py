"""Commits over several tables: repeated, half-failed and deleting ones."""

import pytest
from pyspark.sql import functions as F

from paralens.sources.ledger import Ledger

TABLES = {"records": (["id"], "id long, name string"), "reports": (["id", "page"], "id long, page int, score double"), "links": (["id"], "id long, glossary string")}


@pytest.fixture
def book(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "book"), TABLES, buckets=4)


def rows(spark, ids, name):
    ids = spark.createDataFrame([(k,) for k in ids], "id long")
    return {"records": ids.withColumn("name", F.lit(name)), "reports": ids.select("id", F.lit(1).alias("page"), F.col("id").cast("double").alias("score")), "links": ids.withColumn("glossary", F.lit(name))}


def names(book, table="records", column="name"):
    return {r["id"]: r[column] for r in book.read(table).collect()}


def test_a_half_failed_write_is_not_seen_and_can_be_repeated(spark, book, monkeypatch):
    assert book.write("a", rows(spark, [1, 2, 3], "old"))
    real, calls = Ledger.append, []

    def fails(self, name, *args):
        calls.append(name)
        if len(calls) == 2:
            raise OSError("lost")
        real(self, name, *args)

    monkeypatch.setattr(Ledger, "append", fails)
    with pytest.raises(OSError):
        book.write("b", rows(spark, [2, 4], "new"))
    monkeypatch.setattr(Ledger, "append", real)
    assert names(book) == names(book, "links", "glossary") == {1: "old", 2: "old", 3: "old"} and book.read("reports").count() == 3
    assert book.write("b", rows(spark, [2, 4], "new"))
    assert names(book) == names(book, "links", "glossary") == {1: "old", 2: "new", 3: "old", 4: "new"} and book.read("reports").count() == 4


def test_a_repeated_id_is_passed_over(spark, book):
    assert book.write("a", rows(spark, [1], "one"))
    assert not book.write("a", rows(spark, [1, 2], "two"))
    assert names(book) == names(book, "links", "glossary") == {1: "one"}


def test_deleted_rows_and_compaction(spark, book):
    book.write("a", rows(spark, range(40), "one"))
    book.write("b", rows(spark, range(0, 40, 2), "two"))
    gone = spark.createDataFrame([(k,) for k in range(10)], "id long")
    book.write("c", {}, {"records": gone, "links": gone})
    want = {k: "one" if k % 2 else "two" for k in range(10, 40)}
    assert names(book) == want and names(book, "links", "glossary") == want and book.read("reports").count() == 40
    book.append("records", "never", "broken", rows(spark, [99], "no")["records"])
    before = book._rows("records").count()
    assert book.compact("records") > 0
    assert names(book) == want and book._rows("records").count() < before
    assert book.compact("records") == 0
    book.write("d", rows(spark, [3], "back"))
    assert names(book) == want | {3: "back"}


def test_untouched_partitions_are_not_rewritten(spark, book):
    book.write("a", rows(spark, range(20), "one"))
    book.write("b", {"records": rows(spark, [5], "two")["records"]})
    own = book._rows("records").where("id = 5").first()["bucket"]
    files = lambda: {f for f in book._rows("records").inputFiles() if f"bucket={own}/" not in f}
    before = files()
    assert book.compact("records") == 1 and files() == before


def test_empty_tables_and_repeated_rows(spark, book):
    assert book.read("records").count() == 0 and book.commits().count() == 0
    one = rows(spark, [7], "x")["records"]
    book.write("a", {"records": one.unionByName(one).unionByName(rows(spark, [7], "y")["records"])})
    first = names(book)
    assert set(first) == {7} and names(book) == first
