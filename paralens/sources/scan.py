"""Raw page layouts to tables of blocks and pages.

A layout is what a PDF library tells of a page: blocks of lines of spans, images and
filled shapes.  The library itself is not part of this engine; ``pdf_layouts`` takes
a function that reads one document's bytes, so any library can be plugged in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: one page: text blocks, image blocks and filled shapes with boxes as [x0, y0, x1, y1]
LAYOUT = """pair_id string, side string, page int, width double, height double,
blocks array<struct<type:int, bbox:array<double>, width:int, height:int, ext:string, lines:array<struct<spans:array<struct<text:string, bbox:array<double>, size:double, flags:int, color:int, alpha:int, font:string>>>>>>,
fills array<struct<bbox:array<double>, color:string>>"""
MAX_BYTES, MAX_PAGES = 100 * 1024 * 1024, 500
#: what is known of images only
IMAGE = {"asset_ref": "string", "pixel_width": "int", "pixel_height": "int", "extension": "string"}
BOLD, ITALIC = 16, 2
DARK_PART, LIGHT_PART, LIGHT = 0.10, 0.50, 0.92


class Locked(Exception):
    """What ``read`` raises for a file that needs a password."""


def _pages(name: str, content: bytes, read: Callable[[str, bytes], Iterator[dict]]) -> tuple[list[dict], str | None, str | None]:
    """The pages of a file, or why there are none: a kind of error and what was said."""
    pages: list[dict] = []
    try:
        for page in read(name, content):
            pages.append(page)
            if len(pages) > MAX_PAGES:
                return [], "too_many_pages", f"{name} has more than {MAX_PAGES} pages"
    except Locked as e:
        return [], "locked", f"{name} needs a password: {e}"
    except Exception as e:  # noqa: BLE001  a reader may raise anything on a broken file
        return [], "broken", f"{name} can't be read: {e}"
    return pages, None, None


def pdf_files(spark: SparkSession, path: str, read: Callable[[str, bytes], Iterator[dict]], max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, error, message, layout): a row for each page of the ``.pdf`` files under a path, and one for each file that has none to give.

    ``error`` is null, too_large, too_many_pages, locked (``read`` raises Locked) or broken.
    A file that is too large is not opened; one bad file doesn't stop the others.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    schema = f"path string, error string, message string, layout struct<{LAYOUT}>"
    large = files.where(F.col("length") > max_bytes).select("path", F.lit("too_large").alias("error"), F.concat("path", F.lit(f" has more than {max_bytes} bytes")).alias("message"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                pages, error, message = _pages(name, content, read)
                rows = [(name, None, None, p) for p in pages] or [(name, error, message, None)] * (error is not None)
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "error", "message", "layout"])

    found = files.where(F.col("length") <= max_bytes).select("path", "content").mapInPandas(run, schema)
    return found.unionByName(large, allowMissingColumns=True)


def pdf_layouts(spark: SparkSession, path: str, read: Callable[[str, bytes], Iterator[dict]], max_bytes: int = MAX_BYTES) -> DataFrame:
    """Layouts of the ``.pdf`` files under a path; ``read`` yields a dict for each page of one file.

    A file with too many bytes or pages, or one that can't be read, is an error; pdf_files() tells of each instead.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    large = files.where(F.col("length") > max_bytes).select("path").first()
    if large:
        raise ValueError(f"{large['path']} has more than {max_bytes} bytes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                pages, error, message = _pages(name, content, read)
                if error:
                    raise ValueError(message)
                if pages:
                    yield pd.DataFrame(pages)

    return files.select("path", "content").mapInPandas(run, LAYOUT)


def _box(b: Column) -> list[Column]:
    return [b[0].alias("x"), b[1].alias("y"), (b[2] - b[0]).alias("width"), (b[3] - b[1]).alias("height")]


def text_blocks(layouts: DataFrame) -> DataFrame:
    """One row for each span with an area: ids by block, line and span; bold as weight 700; alpha as opacity."""
    rows = layouts.select("pair_id", "side", "page", F.posexplode("blocks").alias("b", "block")).where("block.type = 0")
    rows = rows.select("pair_id", "side", "page", "b", F.posexplode("block.lines").alias("l", "line"))
    rows = rows.select("pair_id", "side", "page", "b", "l", F.posexplode("line.spans").alias("s", "span"))
    box = F.col("span.bbox")
    found = rows.select(
        "pair_id",
        "side",
        "page",
        F.concat(F.lit("p"), "page", F.lit("-b"), "b", F.lit("-l"), "l", F.lit("-s"), "s").alias("block_id"),
        F.lit("text").alias("type"),
        *_box(box),
        F.when(F.col("span.size") > 0, F.col("span.size")).alias("font_size"),
        F.when(F.col("span.color").isNotNull(), F.concat(F.lit("#"), F.lpad(F.hex(F.col("span.color").bitwiseAND(F.lit(0xFFFFFF))), 6, "0"))).alias("color"),
        F.col("span.text").alias("text"),
        F.col("b").alias("source_block_index"),
        # greatest() and least() pass over nulls; an unknown alpha stays unknown
        F.when(F.col("span.alpha").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("span.alpha") / 255))).alias("opacity"),
        F.col("span.font").alias("font_family"),
        F.col("l").alias("source_line_index"),
        F.col("s").alias("source_span_index"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in IMAGE.items()],
        F.when(F.col("span.flags").bitwiseAND(F.lit(BOLD)) > 0, 700).otherwise(400).alias("weight"),
        (F.col("span.flags").bitwiseAND(F.lit(ITALIC)) > 0).alias("italic"),
        F.struct("b", "l", "s").alias("place"),
    )
    return found.where("width > 0 and height > 0")


def image_blocks(layouts: DataFrame) -> DataFrame:
    """One row for each image with an area; bytes stay in the file."""
    rows = layouts.select("pair_id", "side", "page", F.posexplode("blocks").alias("b", "block")).where("block.type = 1")
    none = F.lit(None)
    found = rows.select(
        "pair_id",
        "side",
        "page",
        F.concat(F.lit("p"), "page", F.lit("-b"), "b", F.lit("-image")).alias("block_id"),
        F.lit("image").alias("type"),
        *_box(F.col("block.bbox")),
        none.cast("double").alias("font_size"),
        none.cast("string").alias("color"),
        none.cast("string").alias("text"),
        F.col("b").alias("source_block_index"),
        none.cast("double").alias("opacity"),
        none.cast("string").alias("font_family"),
        none.cast("int").alias("source_line_index"),
        none.cast("int").alias("source_span_index"),
        F.concat(F.lit("block-"), "b", F.lit("."), F.coalesce("block.ext", F.lit("bin"))).alias("asset_ref"),
        F.col("block.width").alias("pixel_width"),
        F.col("block.height").alias("pixel_height"),
        F.col("block.ext").alias("extension"),
        none.cast("int").alias("weight"),
        F.lit(False).alias("italic"),
        F.struct("b", F.lit(-1).alias("l"), F.lit(-1).alias("s")).alias("place"),
    )
    return found.where("width > 0 and height > 0")


def blocks(layouts: DataFrame) -> DataFrame:
    """Text and image blocks, numbered in the order of the page."""
    from pyspark.sql.window import Window

    both = text_blocks(layouts).unionByName(image_blocks(layouts))
    order = Window.partitionBy("pair_id", "side", "page").orderBy("place")
    return both.withColumn("block_ord", F.row_number().over(order) - 1).drop("place")


def darkest(color: Column) -> Column:
    """The smallest channel of a ``#RRGGBB`` colour, 0 to 1; null if it isn't one."""
    return F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), F.least(*[F.conv(F.substring(color, k, 2), 16, 10).cast("double") for k in (2, 4, 6)]) / 255)


def pages(layouts: DataFrame) -> DataFrame:
    """Page sizes, the largest light fill of half a page as background, dark fills and images as dark boxes.

    A fill is dark if any of its channels is; among equal light fills the first is the background.
    """
    area = lambda f: (f["bbox"][2] - f["bbox"][0]) * (f["bbox"][3] - f["bbox"][1])
    paper = F.col("width") * F.col("height")
    box = lambda b: F.struct(b[0].alias("x"), b[1].alias("y"), (b[2] - b[0]).alias("width"), (b[3] - b[1]).alias("height"))
    fills = F.coalesce("fills", F.array().cast("array<struct<bbox:array<double>,color:string>>"))
    light = F.filter(fills, lambda f: (darkest(f["color"]) >= LIGHT) & (area(f) >= LIGHT_PART * paper))
    best = F.array_max(F.transform(light, lambda f, i: F.struct(area(f).alias("a"), (-i).alias("nth"), F.upper(f["color"]).alias("c"))))
    dark = F.filter(fills, lambda f: (darkest(f["color"]) < LIGHT) & (area(f) >= DARK_PART * paper))
    images = F.filter("blocks", lambda b: b["type"] == 1)
    boxes = F.concat(F.transform(dark, lambda f: box(f["bbox"])), F.transform(images, lambda b: box(b["bbox"])))
    return layouts.select("pair_id", "side", "page", "width", "height", best["c"].alias("background_color"), boxes.alias("dark_boxes"))


def uploads(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(sha256, path, length) of PDF contents up to a size, each content once."""
    pdf = files.where((F.col("length") <= max_bytes) & (F.substring("content", 1, 4) == F.lit(b"%PDF")))
    return pdf.select(F.sha2("content", 256).alias("sha256"), "path", "length").dropDuplicates(["sha256"])
