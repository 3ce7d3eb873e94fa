"""Document pairs derived from a table of texts, in integer arithmetic only.

Each line of a text is a span of a source document; the target is the source with
changes that a residue of (document, line) picks.  The same definition is plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATIN = "abcdefghijklmnopqrstuvwxyz"
CJK = "的一是不了人我在有他这为之大来以个中上们到说国和地也"
PAGE_LINES, WIDTH, HEIGHT, EXTRA = 12, 500, 800, 100_000


def lines(documents: DataFrame) -> DataFrame:
    """(pair_id, i, line) of every line, numbered from 0."""
    return documents.where("text is not null").select(F.col("doc_id").alias("pair_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


def source_spans(documents: DataFrame) -> DataFrame:
    """(pair_id, i, page, slot, type, x, y, width, height, font_size, opacity, color, text)."""
    image = (F.col("pair_id") * 7 + F.col("i")) % 11 == 0
    rows = lines(documents).withColumns({"page": (F.col("i") / PAGE_LINES).cast("long") + 1, "slot": F.col("i") % PAGE_LINES})
    return rows.select(
        "pair_id",
        "i",
        "page",
        "slot",
        F.when(image, "image").otherwise("text").alias("type"),
        (20 + 5 * ((F.col("pair_id") + F.col("i")) % 4)).cast("double").alias("x"),
        (20 + 60 * F.col("slot")).cast("double").alias("y"),
        F.least(F.lit(400), 10 + 4 * F.length("line")).cast("double").alias("width"),
        F.lit(30.0).alias("height"),
        F.when(~image, F.when(F.col("i") % 9 == 0, 16.0).otherwise(10.0)).alias("font_size"),
        F.when(~image, F.lit(1.0)).alias("opacity"),
        F.when(~image, F.lit("#000000")).alias("color"),
        F.when(~image, F.concat("line", F.lit(" "), F.col("pair_id") % 100 + F.col("i"))).alias("text"),
        "line",
    )


def target_spans(documents: DataFrame) -> DataFrame:
    """The same columns after the changes; h = (31 pair + 17 i) mod 97 picks a span's change, pair mod 10 a page's."""
    h = F.col("h")
    text = F.col("type") == "text"
    rows = source_spans(documents).withColumn("h", (F.col("pair_id") * 31 + F.col("i") * 17) % 97).where("h <> 3")
    edit = F.col("pair_id") % 10
    rows = rows.where(~((edit == 1) & (F.col("page") == 2)))
    page = F.when((edit == 1) & (F.col("page") > 2), F.col("page") - 1).when(edit == 2, F.col("page") + 1).otherwise(F.col("page"))
    changed = F.when(h == 41, F.concat("line", F.lit(" "), F.col("pair_id") % 100 + F.col("i") + 1)).when(h == 43, F.lit("AB")).otherwise(F.col("text"))
    translated = F.when(h.isin(43, 53), changed).otherwise(F.translate(changed, LATIN, CJK))
    moved = rows.select(
        "pair_id",
        "i",
        page.alias("page"),
        "slot",
        "type",
        (F.col("x") + F.when(h == 5, 60.0).when(h == 7, 90.0).otherwise(0.0)).alias("x"),
        F.when(h == 29, 790.0).when(h == 31, F.col("y") + 50).otherwise(F.col("y")).alias("y"),
        F.when(h == 19, F.col("width") * 0.375).when(h == 23, F.col("width") * 0.125).when(h == 43, 12.0).otherwise(F.col("width")).alias("width"),
        "height",
        (F.col("font_size") * F.when(h == 11, 0.7).when(h == 13, 0.5).when(h == 17, 1.5).otherwise(1.0)).alias("font_size"),
        F.when(text, F.when(h == 37, 0.0).otherwise(1.0)).alias("opacity"),
        F.when(text, F.when(h == 59, "#FFFFFF").otherwise("#000000")).alias("color"),
        F.when(text, F.when((edit == 3) & (F.col("page") == 1), F.lit("")).otherwise(translated)).alias("text"),
        "line",
    )
    extra = rows.where("h = 47").select("pair_id", (F.col("i") + EXTRA).alias("i"), page.alias("page"), "slot", F.lit("text").alias("type"), F.lit(430.0).alias("x"), F.col("y").alias("y"), F.lit(40.0).alias("width"), F.lit(20.0).alias("height"), F.lit(10.0).alias("font_size"), F.lit(1.0).alias("opacity"), F.lit("#000000").alias("color"), F.lit("新").alias("text"), "line")
    front = documents.where("text is not null and doc_id % 10 = 2").select(F.col("doc_id").alias("pair_id"), F.lit(2 * EXTRA).cast("long").alias("i"), F.lit(1).cast("long").alias("page"), F.lit(0).cast("long").alias("slot"), F.lit("text").alias("type"), F.lit(20.0).alias("x"), F.lit(20.0).alias("y"), F.lit(100.0).alias("width"), F.lit(30.0).alias("height"), F.lit(10.0).alias("font_size"), F.lit(1.0).alias("opacity"), F.lit("#000000").alias("color"), F.lit("新页").alias("text"), F.lit("").alias("line"))
    return moved.unionByName(extra).unionByName(front)


def _block(df: DataFrame, side: str) -> DataFrame:
    order = (F.when(F.col("i") >= 2 * EXTRA, 0).when(F.col("i") >= EXTRA, F.col("slot") + PAGE_LINES).otherwise(F.col("slot"))).cast("int")
    return df.select("pair_id", F.lit(side).alias("side"), "page", order.alias("block_ord"), F.concat(F.lit("p"), F.col("page"), F.lit("-b"), order, F.when(F.col("type") == "image", "-image").otherwise("-l0-s0")).alias("block_id"), "type", "x", "y", "width", "height", "font_size", "color", "text", order.alias("source_block_index"), "opacity", "i")


def blocks(documents: DataFrame) -> DataFrame:
    """Both sides as blocks, each its own source block; ``i`` tells which spans belong together."""
    return _block(source_spans(documents), "source").unionByName(_block(target_spans(documents), "target"))


def pages(blocks_: DataFrame) -> DataFrame:
    """The pages of the blocks: 500 by 800, white, images as dark boxes."""
    box = F.struct("x", "y", "width", "height")
    dark = F.collect_list(F.when(F.col("type") == "image", box))
    return blocks_.groupBy("pair_id", "side", "page").agg(F.array_sort(dark).alias("dark_boxes")).select("pair_id", "side", "page", F.lit(float(WIDTH)).alias("width"), F.lit(float(HEIGHT)).alias("height"), F.lit("#FFFFFF").alias("background_color"), "dark_boxes")


def true_pages(blocks_: DataFrame) -> DataFrame:
    """(pair_id, s_page, t_page) as the page changes are known to be."""
    edit = F.col("pair_id") % 10
    moved = F.when((edit == 1) & (F.col("page") == 2), None).when((edit == 1) & (F.col("page") > 2), F.col("page") - 1).when(edit == 2, F.col("page") + 1).otherwise(F.col("page"))
    both = blocks_.select("pair_id", "side", "page").distinct()
    s = both.where("side = 'source'").select("pair_id", F.col("page").alias("s_page"), moved.alias("to"))
    t = both.where("side = 'target'").select(F.col("pair_id").alias("p"), F.col("page").alias("t_page"))
    return s.join(t, (F.col("pair_id") == F.col("p")) & (F.col("to") == F.col("t_page")), "full").select(F.coalesce("pair_id", "p").alias("pair_id"), "s_page", "t_page")


def true_matches(blocks_: DataFrame) -> DataFrame:
    """(pair_id, report_page, s_region_id, t_region_id) of spans that came from one line."""
    def side(name: str, p: str) -> DataFrame:
        region = F.concat(F.lit("p"), F.col("page"), F.lit("-r"), F.col("source_block_index"))
        return blocks_.where(F.col("side") == name).select("pair_id", "i", F.col("page").alias(f"{p}page"), region.alias(f"{p}region_id"))

    return side("source", "s_").join(side("target", "t_"), ["pair_id", "i"]).select("pair_id", F.col("s_page").alias("report_page"), "s_region_id", "t_region_id")


def truth(blocks_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pages, the page pairs and the matches of the blocks."""
    return pages(blocks_), true_pages(blocks_), true_matches(blocks_)


CLEAR_LINES, FLOW_LINES = 6, 10


def _text_block(rows: DataFrame, side: str, **columns) -> DataFrame:
    """Blocks of text in 10 points; ``columns`` give what differs."""
    base = {"side": F.lit(side), "type": F.lit("text"), "height": F.lit(20.0), "font_size": F.lit(10.0), "color": F.lit("#000000"), "opacity": F.lit(1.0)} | columns
    order = ["pair_id", "side", "page", "block_ord", "block_id", "type", "x", "y", "width", "height", "font_size", "color", "text", "source_block_index", "opacity"]
    return rows.select("pair_id", *[base[c].alias(c) if c in base else F.col(c) for c in order[1:]])


def clear_blocks(documents: DataFrame) -> DataFrame:
    """Both sides of pairs whose regions, pages and matches leave no doubt.

    A line is a source block of two spans: near ones stay one region, far ones fall
    apart.  The target drops the first page, gets a new one in front, drops lines, or
    turns lines into images over transparent text, by pair mod 4.
    """
    page, k = (F.col("i") / CLEAR_LINES).cast("long") + 1, F.col("i") % CLEAR_LINES
    rows = lines(documents).select("pair_id", "i", page.alias("page"), k.alias("k"), (F.col("pair_id") % 4).alias("edit"))
    rows = rows.withColumns({"x0": (20 + 45 * (F.col("page") % 4)).cast("double"), "y": (30 + 120 * F.col("k") + 20 * (F.col("page") % 3)).cast("double"), "w0": (60 + 10 * ((F.col("i") * 7) % 9)).cast("double"), "gap": F.when(F.col("i") % 3 != 0, 10.0).otherwise(90.0)})
    spans = rows.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))

    def placed(r: DataFrame, side: str, move: float, page: F.Column, opacity: F.Column) -> DataFrame:
        x = F.col("x0") + move + F.when(F.col("s") == 1, F.col("w0") + F.col("gap")).otherwise(0.0)
        r = r.withColumn("page", page.cast("long"))
        return _text_block(r, side, block_ord=(F.col("k") * 2 + F.col("s")).cast("int"), block_id=F.concat(F.lit("p"), F.col("page"), F.lit("-b"), F.col("k"), F.lit("-s"), F.col("s")), x=x, width=F.when(F.col("s") == 1, 40.0).otherwise(F.col("w0")), text=F.when(F.col("s") == 1, F.lit("value")).otherwise(F.concat(F.lit("label "), F.col("i"))), source_block_index=F.col("k").cast("int"), opacity=opacity)

    target = spans.where("not (edit = 1 and page = 1) and not (edit = 3 and k = 5)")
    moved = F.when(F.col("edit") == 1, F.col("page") - 1).when(F.col("edit") == 2, F.col("page") + 1).otherwise(F.col("page"))
    raster = (F.col("edit") == 0) & (F.col("i") % 7 == 5) & (F.col("i") % 3 != 0)
    none = F.lit(None)
    images = _text_block(rows.where(raster), "target", type=F.lit("image"), block_ord=(100 + F.col("k")).cast("int"), block_id=F.concat(F.lit("p"), F.col("page"), F.lit("-b"), 100 + F.col("k"), F.lit("-image")), x=F.col("x0") + 3.0, width=F.col("w0") + 50.0, text=none.cast("string"), source_block_index=(100 + F.col("k")).cast("int"), opacity=none.cast("double"), font_size=none.cast("double"), color=none.cast("string"))
    front = _text_block(rows.where("edit = 2 and i = 0").withColumn("page", F.lit(1).cast("long")), "target", block_ord=F.lit(0), block_id=F.lit("p1-b0-s0"), x=F.lit(200.0), y=F.lit(400.0), width=F.lit(90.0), height=F.lit(25.0), text=F.lit("front"), source_block_index=F.lit(0))
    return placed(spans, "source", 0.0, F.col("page"), F.lit(1.0)).unionByName(placed(target, "target", 3.0, moved, F.when(raster, 0.0).otherwise(1.0))).unionByName(images).unionByName(front)


def flow_blocks(documents: DataFrame) -> DataFrame:
    """Both sides of pairs whose pages are one flow of lines: left in the source; left, right or centred in the target by pair mod 3."""
    page, k = (F.col("i") / FLOW_LINES).cast("long") + 1, F.col("i") % FLOW_LINES
    rows = lines(documents).select("pair_id", "i", page.alias("page"), k.alias("k"), (100 + 13 * ((F.col("i") * 5) % 11)).cast("double").alias("width"))
    edit = F.col("pair_id") % 3
    moved = F.when(edit == 0, 60.0).when(edit == 1, 440 - F.col("width")).otherwise(250 - F.col("width") / 2)
    side = lambda name, x: _text_block(rows, name, block_ord=F.col("k").cast("int"), block_id=F.concat(F.lit("p"), F.col("page"), F.lit("-b"), F.col("k")), x=x, y=(20 + 24 * F.col("k")).cast("double"), text=F.concat(F.lit("line "), F.col("i")), source_block_index=F.col("k").cast("int"))
    return side("source", F.lit(60.0)).unionByName(side("target", moved))


def layouts(documents: DataFrame) -> DataFrame:
    """One raw page layout for each document: a block for each of its first lines or images, and three fills."""
    n = F.size(F.split("text", "\n", -1))
    rows = documents.where("text is not null").select(F.col("doc_id").alias("pair_id"), F.lit("source").alias("side"), F.lit(1).alias("page"), F.lit(500.0).alias("width"), F.lit(800.0).alias("height"), n.alias("n"))

    def box(*values) -> F.Column:
        return F.array(*[(v if isinstance(v, F.Column) else F.lit(v)).cast("double") for v in values])

    def block(i: F.Column) -> F.Column:
        image = (F.col("pair_id") + i) % 5 == 0
        width = (F.col("pair_id") * 3 + i) % 4 * 10
        span = lambda s: F.struct(F.concat(F.lit("t"), i, F.lit("."), F.lit(s)).alias("text"), box(10 + 100 * s, 20 * i, 10 + 100 * s + width, 20 * i + 10).alias("bbox"), ((F.col("pair_id") + i) % 3 * 6).cast("double").alias("size"), ((i % 4) * 8).cast("int").alias("flags"), ((F.col("pair_id") * 65793) % 16777216).cast("int").alias("color"), F.when((F.col("pair_id") + i) % 7 != 6, (F.col("pair_id") + i) % 3 * 130).cast("int").alias("alpha"), F.lit("f").alias("font"))
        lines_ = F.array(F.struct(F.array(span(0), span(1)).alias("spans")))
        return F.struct(image.cast("int").alias("type"), box(10, 20 * i, 60, 20 * i + 10 * (i % 2)).alias("bbox"), F.lit(5).alias("width"), F.lit(4).alias("height"), F.when(i % 4 == 1, "png").alias("ext"), F.when(~image, lines_).alias("lines"))

    channel = lambda k: F.lpad(F.hex(F.col("pair_id") * k % 64 + 192), 2, "0")
    own = F.concat(F.lit("#"), channel(7), channel(11), channel(13))
    fills = F.array(
        F.struct(box(0, 0, 500, 800 - 100 * (F.col("pair_id") % 6)).alias("bbox"), own.alias("color")),
        F.struct(box(0, 0, 500, 500).alias("bbox"), F.lit("#FAFAFA").alias("color")),
        F.struct(box(0, 0, 50 * (F.col("pair_id") % 11), 100).alias("bbox"), F.lit("#FFEE00").alias("color")),
    )
    return rows.select("pair_id", "side", "page", "width", "height", F.transform(F.sequence(F.lit(0), F.col("n") - 1), block).alias("blocks"), fills.alias("fills"))


TANGLED, SPACING, STEP = 6, 100, 95


def tangled_blocks(documents: DataFrame) -> DataFrame:
    """Both sides of pairs whose lines move almost to their neighbours' places, up or down by pair mod 2.

    The best single match of most lines is a neighbour's; the best matches of all keep them together.
    """
    rows = lines(documents).select("pair_id", "i", ((F.col("i") / TANGLED).cast("long") + 1).alias("page"), (F.col("i") % TANGLED).alias("k"))
    moved = F.when(F.col("pair_id") % 2 == 0, STEP).otherwise(-STEP)
    side = lambda name, y: _text_block(rows, name, block_ord=F.col("k").cast("int"), block_id=F.concat(F.lit("p"), F.col("page"), F.lit("-b"), F.col("k")), x=F.lit(50.0), width=F.lit(120.0), y=y.cast("double"), text=F.concat(F.lit("line "), F.col("i")), source_block_index=F.col("k").cast("int"))
    place = 120 + SPACING * F.col("k")
    return side("source", place).unionByName(side("target", place + moved))


SHARED_LINES = 8


def shared_image_blocks(documents: DataFrame) -> DataFrame:
    """Both sides of pairs in which two transparent texts lie under the same two images.

    Each text lies most under the first image; the first text covers it wholly and takes it, the second gets the other.
    """
    rows = lines(documents).select("pair_id", "i", ((F.col("i") / SHARED_LINES).cast("long") + 1).alias("page"), (F.col("i") % SHARED_LINES).alias("k"))
    place = (30 + 90 * F.col("k")).cast("double")
    none = F.lit(None)

    def boxes(side: str, at: dict[int, float], image: bool, opacity: float) -> DataFrame:
        spread = rows.withColumn("s", F.explode(F.array(*[F.lit(s) for s in at])))
        x = F.element_at(F.create_map(*[F.lit(v) for pair in at.items() for v in pair]), F.col("s"))
        own = {"type": F.lit("image"), "opacity": none.cast("double"), "font_size": none.cast("double"), "color": none.cast("string")} if image else {"opacity": F.lit(opacity)}
        return _text_block(spread, side, block_ord=(F.col("k") * 4 + F.col("s")).cast("int"), block_id=F.concat(F.lit("p"), F.col("page"), F.lit("-b"), F.col("k") * 4 + F.col("s")), x=x, y=place, width=F.lit(100.0), text=none.cast("string") if image else F.concat(F.lit("label "), F.col("i"), F.lit("."), F.col("s")), source_block_index=(F.col("k") * 4 + F.col("s")).cast("int"), **own)

    text, images = {0: 100.0, 1: 105.0}, {2: 100.0, 3: 90.0}
    return boxes("source", text, False, 1.0).unionByName(boxes("target", text, False, 0.0)).unionByName(boxes("target", images, True, 1.0))


def column_blocks(documents: DataFrame) -> DataFrame:
    """Both sides of pairs with two columns of lines; the left column turns from left to right aligned by pair mod 2, the right one stays."""
    rows = lines(documents).select("pair_id", "i", ((F.col("i") / 20).cast("long") + 1).alias("page"), (F.col("i") % 20).alias("k"), (60 + 10 * ((F.col("i") * 5) % 11)).cast("double").alias("width"))
    left = F.col("k") % 2 == 0
    edge = F.when(F.col("pair_id") % 2 == 1, 210 - F.col("width")).otherwise(40.0)
    side = lambda name, x: _text_block(rows, name, block_ord=F.col("k").cast("int"), block_id=F.concat(F.lit("p"), F.col("page"), F.lit("-b"), F.col("k")), x=F.when(left, x).otherwise(300.0), y=(20 + 24 * F.floor(F.col("k") / 2)).cast("double"), text=F.concat(F.lit("line "), F.col("i")), source_block_index=F.col("k").cast("int"))
    return side("source", F.lit(40.0)).unionByName(side("target", edge))


def gapped_blocks(documents: DataFrame) -> DataFrame:
    """Both sides of pairs that lose page 2, or get a page after it, or one after pages 2 and 4 each, by pair mod 3."""
    page = (F.col("i") / CLEAR_LINES).cast("long") + 1
    rows = lines(documents).select("pair_id", "i", page.alias("page"), (F.col("i") % CLEAR_LINES).alias("k"), (F.col("pair_id") % 3).alias("edit"))
    x, y = (20 + 45 * (F.col("page") * 3 % 7)).cast("double"), (30 + 120 * F.col("k") + 15 * (F.col("page") * 5 % 7)).cast("double")
    width = (60 + 30 * ((F.col("i") * 7 + F.col("page")) % 9)).cast("double")
    after = lambda p: (F.col("page") > p).cast("long")
    to = F.col("page") + F.when(F.col("edit") == 0, -after(2)).when(F.col("edit") == 1, after(2)).otherwise(after(2) + after(4))

    def placed(r: DataFrame, name: str, number: F.Column) -> DataFrame:
        r = r.withColumns({"x": x, "y": y, "width": width}).withColumn("page", number.cast("long"))
        return _text_block(r, name, block_ord=F.col("k").cast("int"), block_id=F.concat(F.lit("p"), F.col("page"), F.lit("-b"), F.col("k")), text=F.concat(F.lit("line "), F.col("i")), source_block_index=F.col("k").cast("int"))

    kept = rows.where("not (edit = 0 and page = 2)")
    new = rows.where("k = 0 and edit > 0 and (page = 3 or (edit = 2 and page = 5))").withColumn("page", F.when(F.col("page") == 3, 3).otherwise(6).cast("long"))
    front = _text_block(new, "target", block_ord=F.lit(0), block_id=F.concat(F.lit("p"), F.col("page"), F.lit("-new")), x=F.lit(430.0), y=F.lit(770.0), width=F.lit(15.0), height=F.lit(9.0), text=F.lit("new"), source_block_index=F.lit(0))
    return placed(rows, "source", F.col("page")).unionByName(placed(kept, "target", to)).unionByName(front)
