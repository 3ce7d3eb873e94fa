"""Tables that change together: rows of one commit are seen in all of them or in none.

A write appends its rows to each table, marked with the commit's id and the attempt that
wrote them, and names the attempt in the list of commits last.  Readers take only rows of
attempts named there, so a write that broke off half way changes nothing, whatever it
left behind, and can be tried again under the same id; an id that is there already is
passed over.  Of rows with one key the latest commit's counts, and a row marked as gone
hides the older ones.

Tables are partitioned by a hash of the key.  ``compact`` rewrites only the partitions
that hold more than they show, by dynamic partition overwrite.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored

#: columns beside a table's own
MARKS = ("commit_id", "attempt", "gone", "bucket")


class Ledger:
    """Tables under ``path``; ``tables`` has each one's key columns and schema (DDL)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[list[str], str]], buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path, tables, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        spark = self.spark
        file_system = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not file_system.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file_system):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def commits(self) -> DataFrame:
        """(commit_id, attempt, seq) of every commit, numbered from 0."""
        return self._read("commits", "commit_id string, attempt string, seq long")

    def _rows(self, name: str) -> DataFrame:
        return self._read(f"table-{name}", f"{self.tables[name][1]}, commit_id string, attempt string, gone boolean, bucket int")

    def write(self, commit_id: str, rows: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None) -> bool:
        """Commits rows to several tables; ``gone`` has the keys of rows to delete.  False if the id is there already."""
        known = self.commits()
        if known.where(F.col("commit_id") == commit_id).limit(1).count():
            return False
        attempt = uuid.uuid4().hex
        for name in rows.keys() | (gone or {}).keys():
            self.append(name, commit_id, attempt, rows.get(name), (gone or {}).get(name))
        self.spark.range(1).select(F.lit(commit_id).alias("commit_id"), F.lit(attempt).alias("attempt"), F.lit(known.count()).cast("long").alias("seq")).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def append(self, name: str, commit_id: str, attempt: str, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Rows of one table, not seen before the attempt is named in the list of commits."""
        keys, schema = self.tables[name]
        empty = self.spark.createDataFrame([], schema)
        columns = empty.dtypes
        parts = []
        if rows is not None:
            parts.append(rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns], F.lit(False).alias("gone")))
        if gone is not None:
            parts.append(gone.select(*[(F.col(c) if c in keys else F.lit(None)).cast(t).alias(c) for c, t in columns], F.lit(True).alias("gone")))
        for part in parts:
            marked = part.select(*[c for c, _ in columns], F.lit(commit_id).alias("commit_id"), F.lit(attempt).alias("attempt"), "gone", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias("bucket"))
            marked.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/table-{name}")

    def _latest(self, name: str) -> DataFrame:
        keys, schema = self.tables[name]
        seen = self._rows(name).join(self.commits(), ["commit_id", "attempt"])
        columns = [c for c, _ in self.spark.createDataFrame([], schema).dtypes]
        # a commit that names a key twice leaves one row, the same one always
        order = F.struct("seq", F.xxhash64(*columns))
        best = seen.groupBy("bucket", *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*columns, "commit_id", "attempt", "gone"), order).alias("row"))
        return best.select("bucket", "row.*")

    def read(self, name: str) -> DataFrame:
        """A table as the commits have left it."""
        return self._latest(name).where("not gone").drop(*MARKS)

    def compact(self, name: str) -> int:
        """Rewrites the partitions with rows that aren't read any more; how many they were."""
        now = stored(self._latest(name).where("not gone"), f"ledger-{name}")
        sizes = self._rows(name).groupBy("bucket").agg(F.count("*").alias("n")).join(now.groupBy("bucket").agg(F.count("*").alias("m")), "bucket", "left")
        touched = [r["bucket"] for r in sizes.where("m is null or n > m").select("bucket").collect()]
        if touched:
            kept = now.where(F.col("bucket").isin(touched)).select(*[c for c in now.columns if c != "bucket"], "bucket")
            # a partition that shows nothing keeps a mark, as one without rows would not be overwritten
            first = self._rows(name).where(F.col("bucket").isin(touched)).dropDuplicates(["bucket"]).join(kept.select("bucket").distinct(), "bucket", "left_anti")
            marks = first.withColumns({"commit_id": F.lit("-"), "attempt": F.lit("-")}).select(*kept.columns)
            out = stored(kept.unionByName(marks), f"ledger-{name}")
            out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/table-{name}")
        return len(touched)
