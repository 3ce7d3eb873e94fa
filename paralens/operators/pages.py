"""Page pairs: similarity of pages, monotone alignment, report entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
import numpy as np
import pandas as pd

from ..plans.rules import Rules
from . import solvers
from .groupwise import per_groups, runs, ship

#: source pages that are compared with the pages near them at once
ZONE = 32


def side(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """One side's rows with prefixed columns; pair_id keeps its name."""
    rows = df.where(F.col("side") == name).drop("side")
    return rows.select("pair_id", *[F.col(c).alias(prefix + c) for c in rows.columns if c != "pair_id"])


def similarity(regions: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    """(pair_id, s_page, t_page, similarity) of all pages of a pair at most ``max_page_shift`` apart.

    Source pages are taken in zones of a number of pages, each with the target pages near it;
    all zones of a batch are compared in one pass of arrays.
    """
    columns = ["region_ord", "type", "x", "y", "width", "height"]
    weights = ("position", "size", "type", "text_types")
    paper = rules.attach(pages).select("pair_id", "side", "page", F.col("width").alias("wide"), F.col("height").alias("high"), rules.value("max_page_shift").cast("long").alias("shift"), *[rules.value(w).cast("double").alias(f"w_{w}") for w in weights])
    # a page without regions keeps a row
    rows = paper.join(regions.select("pair_id", "side", "page", *columns), ["pair_id", "side", "page"], "left").withColumn("target", (F.col("side") == "target").cast("int")).drop("side")
    zone = lambda c: F.floor(c / ZONE)
    number = F.col("page").cast("long")
    own = rows.where("target = 0").withColumn("zone", zone(number))
    near = rows.where("target = 1").withColumn("zone", F.explode(F.sequence(zone(number - F.col("shift")), zone(number + F.col("shift")))))

    def solve(g: dict[str, np.ndarray], marks: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        # rows come by zone, side and page
        new = np.zeros(len(g["page"]), dtype=bool)
        new[marks[:-1]] = True
        new[1:] |= (g["target"][1:] != g["target"][:-1]) | (g["page"][1:] != g["page"][:-1])
        begin = np.flatnonzero(new)
        group, target, page = np.searchsorted(marks, begin, "right"), g["target"][begin], g["page"][begin]
        there = np.flatnonzero(~np.isnan(g["x"].astype(float)))
        first = np.searchsorted(there, np.append(begin, len(new)))
        held = {c: g[c][there] for c in columns}
        # the target pages of a zone ascend: those near a source page are a run
        t, s = np.flatnonzero(target == 1), np.flatnonzero(target == 0)
        low = int(page.min())
        wide = int(page.max()) - low + 2 * int(g["shift"].max()) + 2
        place = group[t] * wide + (page[t] - low)
        at, shift = group[s] * wide + (page[s] - low), g["shift"][begin[s]]
        # a zone's places don't reach into the next one's
        a = np.searchsorted(place, np.maximum(at - shift, group[s] * wide))
        b = np.searchsorted(place, np.minimum(at + shift, group[s] * wide + wide - 1), "right")
        i, j = np.repeat(s, b - a), t[runs(a, b - a)] if len(t) else np.zeros(0, dtype=np.int64)
        settings = {k: g[k][begin] for k in ("wide", "high", *[f"w_{w}" for w in weights])}
        return begin[i], {"s_page": page[i], "t_page": page[j], "similarity": solvers.page_similarities(held, first, settings, i, j)}

    types = dict(rows.dtypes)
    schema = f"pair_id {types['pair_id']}, zone bigint, s_page {types['page']}, t_page {types['page']}, similarity double"
    return per_groups(own.unionByName(near), ["pair_id", "zone"], ["target", "page", "region_ord"], solve, schema).drop("zone")


def identity(pages: DataFrame) -> DataFrame:
    """(pair_id, s_page, t_page): pages of equal number together, the others alone."""
    s = side(pages, "source", "s_").select("pair_id", "s_page", F.col("s_page").alias("number"))
    t = side(pages, "target", "t_").select("pair_id", "t_page", F.col("t_page").alias("number"))
    return s.join(t, ["pair_id", "number"], "full").drop("number")


def aligned(pages: DataFrame, regions: DataFrame, rules: Rules) -> DataFrame:
    """(pair_id, s_page, t_page) by the best monotone alignment of each pair of documents; pages of equal number where a profile aligns none."""
    ship(pages.sparkSession)
    numbers = pages.groupBy("pair_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("side") == n, F.col("page")))).alias(n) for n in ("source", "target")])
    scores = similarity(regions, pages, rules).groupBy("pair_id").agg(F.collect_list(F.struct("s_page", "t_page", "similarity")).alias("scores"))
    kind, page = pages.schema["pair_id"].dataType, pages.schema["page"].dataType
    schema = T.StructType([T.StructField("pair_id", kind), T.StructField("s_page", page), T.StructField("t_page", page)])
    settings = [rules.value(k).alias(k) for k in ("skip_penalty", "shift_margin", "align_pages")]

    def run(batches):
        for table in batches:
            rows = []
            for pair, source, target, scored, skip, margin, align in zip(*[table[c] for c in ("pair_id", "source", "target", "scores", "skip_penalty", "shift_margin", "align_pages")]):
                values = {(s["s_page"], s["t_page"]): s["similarity"] for s in scored} if scored is not None and align else {}
                pairs, missing, extra = solvers.align_pages(list(source), list(target), values, skip, margin if align else float("inf"))
                rows += [(pair, a, b) for a, b in pairs] + [(pair, a, None) for a in missing] + [(pair, None, b) for b in extra]
            yield pd.DataFrame(rows, columns=["pair_id", "s_page", "t_page"]).astype({"s_page": "Int64", "t_page": "Int64"})

    joined = rules.attach(numbers.join(scores, "pair_id", "left"))
    return joined.select("pair_id", "source", "target", "scores", *settings).mapInPandas(run, schema)


def entries(paired: DataFrame) -> DataFrame:
    """Report entries in order: (pair_id, s_page, t_page, report_page, kind); pairs first within a page number."""
    kind = F.when(F.col("t_page").isNull(), "missing").when(F.col("s_page").isNull(), "extra").otherwise("pair")
    return paired.select("pair_id", "s_page", "t_page", F.coalesce("s_page", "t_page").alias("report_page"), kind.alias("kind"))
