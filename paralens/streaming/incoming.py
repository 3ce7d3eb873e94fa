"""Comparison of pairs as they arrive: an extra of this engine, a micro-batch at a time.

Each micro-batch of blocks is compared as a batch of its own, so a pair's blocks must
arrive together (one file or one message for each pair).  Results are written under
the batch's number, which makes a repeated batch overwrite itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.compare import compare
from ..plans.profile import Profile


def compare_stream(blocks: DataFrame, page_size: tuple[float, float], out: str, checkpoint: str, profile: Profile | None = None) -> StreamingQuery:
    """Starts a query that compares every micro-batch and writes documents and issues."""
    from pyspark.sql import functions as F

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        pages = rows.groupBy("pair_id", "side", "page").agg(F.lit(page_size[0]).alias("width"), F.lit(page_size[1]).alias("height"), F.lit(None).cast("string").alias("background_color"), F.array().cast("array<struct<x:double,y:double,width:double,height:double>>").alias("dark_boxes"))
        found = compare(pages, rows, profile)
        found.documents.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        found.issues.write.mode("overwrite").parquet(f"{out}/issues/batch={number}")

    return blocks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
