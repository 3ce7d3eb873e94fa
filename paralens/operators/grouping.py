"""Spans to regions: group by source block, split apart what is disconnected, describe each part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.profile import Profile
from ..plans.rules import Rules
from ..sources.tables import JOINED
from . import solvers, texts
from .groupwise import ship

PAGE = ["pair_id", "side", "page"]
#: columns of a table of blocks
BLOCKS = [*PAGE, "block_ord", "block_id", "type", "x", "y", "width", "height", "font_size", "color", "text", "source_block_index", "opacity"]


def page_median_font(blocks: DataFrame) -> DataFrame:
    """(pair_id, side, page, median_font) over text blocks with a size."""
    return blocks.where("type = 'text' and font_size is not null").groupBy(*PAGE).agg(F.median("font_size").alias("median_font"))


def _gathered(blocks: DataFrame, columns: list[str], ratio: Column) -> DataFrame:
    """The source blocks with ``own``, the columns of their blocks by block_ord, and whether any is no text (not_text)."""
    return blocks.groupBy(*PAGE, "source_index").agg(F.array_sort(F.collect_list(F.struct("block_ord", *columns))).alias("own"), F.max((F.col("type") != "text").cast("int")).alias("not_text"), F.first(ratio).alias("ratio"))


def _swept(blocks: DataFrame, ratio: Column) -> DataFrame:
    """(PAGE, source_index, turn, starts, sizes) of source blocks of more than two text blocks.

    ``turn``: places of their blocks by part and by place in it; ``starts`` (from 1) and ``sizes``: the parts in it.
    """
    ship(blocks.sparkSession)
    box = ["x", "y", "width", "height"]
    keys = [*PAGE, "source_index"]
    blocks = blocks.select(*keys, "block_ord", "type", "block_id", *box, ratio.cast("double").alias("r"))
    sound = F.nanvl(F.col("x") + F.col("y") + F.col("width") + F.col("height"), F.lit(None).cast("double"))
    counted = blocks.groupBy(*keys).agg(F.count("*").alias("n"), F.count(sound).alias("sound"), F.max((F.col("type") != "text").cast("int")).alias("not_text"))
    several = counted.where("n > 1 and not_text = 0 and (n > 2 or sound < 2)").select(*keys)
    # of the blocks dealt, only these are sorted
    rows = _gathered(blocks.join(several.hint("shuffle_hash"), keys), ["block_id", *box], F.col("r"))
    rows = rows.select(*keys, *[F.col(f"own.{c}").alias(c) for c in ("block_id", *box)], "ratio")
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", turn array<int>, starts array<int>, sizes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn, starts, sizes = [], [], []
            for k in range(batch.num_rows):
                own = {c: batch.column(c)[k].values for c in ("block_id", *box)}
                part = solvers.span_parts(*[own[c].to_numpy(zero_copy_only=False).astype(float) for c in box], batch.column("ratio")[k].as_py())
                ids = np.unique(np.array([v or "" for v in own["block_id"].to_pylist()]), return_inverse=True)[1]
                # what is unknown comes first
                x, y = (own[c].fill_null(-np.inf).to_numpy() for c in ("x", "y"))
                turn.append(np.lexsort((ids, x, y, part)).astype(np.int32))
                sizes.append(np.bincount(part).astype(np.int32))
                starts.append((np.cumsum(sizes[-1]) - sizes[-1] + 1).astype(np.int32))
            found = [pa.array(v, pa.list_(pa.int32())) for v in (turn, starts, sizes)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *found], names=[*keys, "turn", "starts", "sizes"])

    return rows.mapInArrow(run, schema)


def _facts(blocks: DataFrame) -> tuple[str, ...]:
    """The columns that stand for the text, if any."""
    return texts.FACTS if texts.known(blocks) else ()


def _parts(blocks: DataFrame, dealt: DataFrame, rules: Rules) -> DataFrame:
    """(PAGE, source_index, part, own, median_font) of the connected parts of source blocks, ``own`` their blocks in order.

    Only source blocks of two or more text blocks can fall apart; all others pass by.  Two blocks are
    compared by columns, more are swept.  Parts are numbered by their upper left corners and ordered by place,
    whole source blocks as they came.  ``blocks``: the rows of ``dealt`` in order, with their page's median font.
    """
    ratio = rules.value("span_gap_ratio")
    keys = [*PAGE, "source_index"]
    gathered = _gathered(blocks, ["type", "block_id", "x", "y", "width", "height", "font_size", "color", "text", "opacity", "median_font", *_facts(blocks)], ratio)
    found = gathered.join(_swept(dealt, ratio).hint(JOINED), keys, "left")
    own = F.col("own")
    a, b = F.get(own, F.lit(0)), F.get(own, F.lit(1))
    limit = F.greatest(a["height"], b["height"]) * F.col("ratio")
    gap = lambda at, size: F.greatest(a[at], b[at]) - F.least(a[at] + a[size], b[at] + b[size])
    across, down = gap("x", "width"), gap("y", "height")
    met = ((down <= 0) & (across <= limit)) | ((down <= limit) & ((across <= 0) | (F.abs(a["x"] - b["x"]) <= limit)))
    corner = lambda r, *more: F.struct(*[r[c].alias(c) for c in ("y", "x", *more)])
    together = F.array(F.when(corner(a, "block_id") > corner(b, "block_id"), F.array(b, a)).otherwise(own))
    apart = F.when(corner(a) > corner(b), F.array(F.array(b), F.array(a))).otherwise(F.array(F.array(a), F.array(b)))
    two = F.when(met, together).otherwise(apart)
    swept = F.transform("sizes", lambda n, k: F.transform(F.slice("turn", F.get("starts", k), n), lambda i: F.get(own, i)))
    parts = F.when(F.col("turn").isNotNull(), swept).when((F.size(own) == 1) | (F.col("not_text") == 1), F.array(own)).otherwise(two)
    return found.select(*keys, F.posexplode(parts).alias("part", "own"))


def regions(blocks: DataFrame, rules: Rules | Profile, split: bool = True, buckets: int | None = None, lie: bool = False) -> DataFrame:
    """The regions of all pages with ids, order, text, style, children and neighbours.

    ``split=False`` leaves source blocks whole (inputs with one span for each block).
    The rows are dealt by page, or by pair to a number of ``buckets``, unless they ``lie`` by pair.
    """
    rules = Rules(rules) if isinstance(rules, Profile) else rules
    indexed = rules.attach(blocks).withColumn("source_index", F.coalesce("source_block_index", "block_ord"))
    # dealt and sorted once: a page's median, its groups and its reading order need no further shuffle
    dealt = indexed if lie else indexed.repartition(buckets, "pair_id") if buckets else indexed.repartition(*PAGE)
    # groups of sorted rows need no table of them
    dealt.sparkSession.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    text = F.col("type") == "text"
    median = F.median(F.when(text & F.col("font_size").isNotNull(), F.col("font_size"))).over(Window.partitionBy(*PAGE))
    sorted_ = dealt.sortWithinPartitions(*PAGE, "source_index").withColumn("median_font", median)
    if split:
        parts = _parts(sorted_, dealt, rules)
        low = lambda c: F.array_min(F.col(f"own.{c}"))
        reach = lambda at, size: F.array_max(F.transform("own", lambda b: b[at] + b[size])) - low(at)
        grouped = parts.select(*PAGE, "source_index", "part", "own", low("x").alias("x"), low("y").alias("y"), reach("x", "width").alias("width"), reach("y", "height").alias("height"), F.array_max("own.opacity").alias("opacity"), F.get("own.median_font", F.lit(0)).alias("median_font"))
    else:
        grouped = sorted_.groupBy(*PAGE, "source_index").agg(
            F.lit(0).alias("part"),
            F.array_sort(F.collect_list(F.struct("block_ord", "type", "block_id", "font_size", "color", "text", *_facts(blocks)))).alias("own"),
            F.min("x").alias("x"),
            F.min("y").alias("y"),
            (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
            (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
            F.max("opacity").alias("opacity"),
            F.first("median_font").alias("median_font"),
        )
    first = F.get("own", F.lit(0))
    # the first of the largest sizes represents the text
    words = F.filter("own", lambda b: b["type"] == "text")
    # most groups are one block, of which nothing has to be chosen
    single = F.size("own") == 1
    either = lambda one, of_many: F.when(single, one).otherwise(of_many)
    largest = F.get(F.array_sort(F.transform(words, lambda b, k: F.struct((-F.coalesce(b["font_size"], F.lit(0.0))).alias("size"), k.alias("nth"), b["font_size"].alias("font_size"), b["color"].alias("color")))), F.lit(0))
    grouped = grouped.select(
        *[c for c in grouped.columns if c != "own"],
        first["type"].alias("first_type"),
        either(first["type"] == "text", F.exists("own", lambda b: b["type"] == "text")).cast("int").alias("has_text"),
        either(first["font_size"], largest["font_size"]).alias("text_font"),
        either(first["color"], largest["color"]).alias("text_color"),
        first["font_size"].alias("first_font"),
        first["color"].alias("first_color"),
        first["text"].alias("first_text"),
        either(F.coalesce(first["text"], F.lit("")), F.array_join(F.filter(words, lambda b: F.coalesce(b["text"], F.lit("")) != "")["text"], "\n")).alias("all_text"),
        F.col("own.block_id").alias("children"),
        either(F.when(first["color"] != "", F.array(first["color"])).otherwise(F.array().cast("array<string>")), F.filter(F.col("own.color"), lambda c: c != "")).alias("colors"),
        *(texts.combined(first, words, single | (first["type"] == "image") | ~F.exists("own", lambda b: b["type"] == "text")) if _facts(blocks) else []),
    )
    image, is_text = F.col("first_type") == "image", F.col("has_text") == 1
    joined = rules.attach(grouped)
    heading = F.col("text_font") >= F.col("median_font") * rules.value("heading_ratio")
    kind = F.when(image, "image").when(~is_text, F.col("first_type")).when(F.coalesce(heading, F.lit(False)), "heading").otherwise("paragraph")
    described = joined.select(
        *PAGE,
        "source_index",
        "part",
        F.concat(F.lit("p"), F.col("page"), F.lit("-r"), F.col("source_index"), F.when(F.col("part") > 0, F.concat(F.lit("-c"), F.col("part") + 1)).otherwise("")).alias("region_id"),
        kind.alias("type"),
        "x",
        "y",
        "width",
        "height",
        F.when(image, None).when(is_text, F.col("text_font")).otherwise(F.col("first_font")).alias("font_size"),
        F.when(image, None).when(is_text, F.col("text_color")).otherwise(F.col("first_color")).alias("color"),
        (F.lit(None).cast("string") if _facts(blocks) else F.when(image | ~is_text, F.col("first_text")).otherwise(F.col("all_text"))).alias("text"),
        "children",
        "opacity",
        "colors",
        *_facts(blocks),
    )
    reading = Window.partitionBy(*PAGE).orderBy("y", "x", "source_index", "part")
    return described.select("*", (F.row_number().over(reading) - 1).alias("region_ord"), F.lag("region_id").over(reading).alias("above"), F.lead("region_id").over(reading).alias("below"))


def integrity(blocks: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """(rule, pair_id, side, page, item) of every breach of the data model."""
    def row(df: DataFrame, rule: str, item: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), *PAGE, F.col(item).cast("string").alias("item"))

    twice = [row(df.groupBy(*PAGE, key).count().where("count > 1"), rule, key) for df, key, rule in ((blocks, "block_id", "block_twice"), (found, "region_id", "region_twice"))]
    size = row(blocks.where("not (width > 0 and height > 0)"), "size", "block_id")
    paper = pages.where("not (width > 0 and height > 0)").select(F.lit("page_size").alias("rule"), *PAGE, F.col("page").cast("string").alias("item"))
    pages_twice = pages.groupBy(*PAGE).count().where("count > 1").select(F.lit("page_twice").alias("rule"), *PAGE, F.col("page").cast("string").alias("item"))
    stray = row(blocks.join(pages, PAGE, "left_anti"), "no_page", "block_id")
    children = found.select(*PAGE, F.explode("children").alias("block_id"))
    unknown = row(children.join(blocks, [*PAGE, "block_id"], "left_anti"), "unknown_child", "block_id")
    out = size
    for part in (*twice, paper, pages_twice, stray, unknown):
        out = out.unionByName(part)
    return out
