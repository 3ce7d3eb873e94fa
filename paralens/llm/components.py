"""Connected components of a graph held as an edge table.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
components in MapReduce and beyond", 2014) until the edges stop changing.  Each
step is one min-aggregate and one join, so a hub is pre-aggregated before its
rows move and is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(moved).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    ``edges`` has two columns of one orderable type.  Loops, repeats and edges with
    a null end are ignored; no edges give no rows.
    """
    first, second = edges.columns[:2]
    now = edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
    now = cut(now.where(F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        last, state = state, _state(now)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
