"""The trigram index finds what a search of all names finds."""

import pytest

from paralens.operators import names, store


@pytest.mark.parametrize("part", ["", "a", "ab", "abc", "BCA", "文档一", "c.pdf", "zzz", "aaaa", "a%b"])
def test_search_equals_a_scan(spark, tmp_path, part):
    rows = [(k, "pass" if k % 2 else "fail", a, b) for k, (a, b) in enumerate([("abc.pdf", "xabca"), ("ABCABC", None), (None, "文档一二三"), ("aaaaa", "a%b"), ("", "bc"), ("aab", "zz"), ("中文档", "文档一")])]
    records = spark.createDataFrame(rows, "record_id long, status string, source_name string, target_name string")
    names.write_index(records, str(tmp_path / "index"))
    for status in (None, "pass"):
        want = sorted(r["record_id"] for r in store.search_records(records, status, part).collect())
        assert sorted(r["record_id"] for r in names.search(records, str(tmp_path / "index"), part, status).collect()) == want


def test_a_search_reads_the_partitions_of_its_trigrams(spark, tmp_path):
    records = spark.range(2000).selectExpr("id as record_id", "'pass' as status", "concat('file-', id, '.pdf') as source_name", "concat('copy of ', id) as target_name")
    names.write_index(records, str(tmp_path / "index"))
    plan = names.search(records, str(tmp_path / "index"), "e-17")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan
    assert names.search(records, str(tmp_path / "index"), "e-17").count() == store.search_records(records, None, "e-17").count() > 100
