"""Search for a part of a display name through an index of trigrams.

The index has a row for each trigram of a record's lower-cased names, partitioned by a
hash of the trigram, so a search reads only the partitions of its part's trigrams.  Rows
that have all of them are candidates; ``contains`` decides.  A part of one or two
characters has no trigram: it is looked for in all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import search_records

PARTITIONS = 64
NAMES = ("source_name", "target_name")


def trigrams(text: str) -> list[str]:
    return sorted({text[k : k + 3] for k in range(len(text) - 2)})


def _partition(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTITIONS)).cast("int")


def write_index(records: DataFrame, path: str) -> None:
    """Writes (gram, record_id) of all records; a null name has none."""

    def grams_of(name: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(name) - 2)
        return F.when(F.length(name) >= 3, F.transform(places, lambda k: F.substring(name, k, F.lit(3))))

    own = [grams_of(F.lower(c)) for c in NAMES]
    grams = F.array_distinct(F.concat(*[F.coalesce(g, F.array().cast("array<string>")) for g in own]))
    rows = records.select("record_id", F.explode(grams).alias("gram"))
    rows.withColumn("part", _partition(F.col("gram"))).repartition("part").sortWithinPartitions("gram").write.partitionBy("part").parquet(path)


def search(records: DataFrame, path: str, part: str, status: str | None = None) -> DataFrame:
    """What search_records() finds, through the index."""
    spark, grams = records.sparkSession, trigrams(part.lower())
    if not grams:
        return search_records(records, status, part)
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(_partition(F.col("gram"))).distinct()
    index = spark.read.parquet(path).where(F.col("part").isin([r[0] for r in wanted.collect()]) & F.col("gram").isin(grams))
    found = index.groupBy("record_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("record_id")
    return search_records(records.join(found, "record_id", "left_semi"), status, part)
