"""Regions of a page pair: scores, one-to-one matches, differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.rules import Rules
from ..sources.tables import JOINED
from . import solvers, texts
from .groupwise import per_groups
from .pages import side

PAIR = ["pair_id", "report_page"]


#: regions of a page pair for each band of its height, where pairs of them are looked for
BAND_REGIONS = 8


def sheets(regions: DataFrame, pages: DataFrame, entries: DataFrame, rules: Rules) -> DataFrame:
    """The report entries, each with what is known of its two pages: sizes, fills, regions, characters.

    A page pair is vectorized if its text turned into drawings.
    """
    counts = regions.groupBy("pair_id", "side", "page").agg(F.count("*").alias("n"), F.sum(texts.chars(regions)).alias("chars"))
    paper = pages.join(counts, ["pair_id", "side", "page"], "left")
    own = ["page", "width", "height", "n", "chars"]
    s = side(paper.select("pair_id", "side", *own), "source", "s_").withColumnsRenamed({"s_width": "sp_width", "s_height": "sp_height"})
    t = side(paper.select("pair_id", "side", *own, "background_color", "dark_boxes"), "target", "t_").withColumnsRenamed({"t_width": "tp_width", "t_height": "tp_height", "t_background_color": "background_color", "t_dark_boxes": "dark_boxes"})
    # hints end at a join, and a left join counts as no larger than its left side
    both = rules.attach(entries).join(s.hint(JOINED), ["pair_id", "s_page"], "left").join(t.hint(JOINED), ["pair_id", "t_page"], "left").na.fill(0, ["s_n", "t_n", "s_chars", "t_chars"])
    empty = (F.col("kind") == "pair") & (F.col("s_chars") >= rules.t("vectorized_min_source_chars")) & (F.col("t_chars") <= F.col("s_chars") * rules.t("vectorized_max_target_ratio"))
    return both.withColumns({"vectorized": empty, "bands": F.greatest(F.lit(1), ((F.col("s_n") + F.col("t_n")) / BAND_REGIONS).cast("int"))})


def on_sheets(regions: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source and target regions of paired pages with report_page, both pages' sizes and the number of regions.

    A pair is reported on its source page.
    """
    paired = sheets.where("kind = 'pair'")
    keep = [*PAIR, "sp_width", "sp_height", "tp_width", "tp_height", "vectorized", "bands", *(["rules"] if "rules" in sheets.columns else [])]
    source = side(regions, "source", "s_").withColumn("report_page", F.col("s_page"))
    return paired.select(*keep, "s_n").join(source, PAIR), paired.select(*keep, "t_page", "t_n").join(side(regions, "target", "t_"), ["pair_id", "t_page"])


def banded(rows: DataFrame, p: str) -> DataFrame:
    """The rows for each band of the page's height that their box crosses: ``band``, and ``{p}band``, the first of them."""
    high = F.greatest("sp_height", "tp_height") / F.col("bands")
    place = lambda y: F.least(F.greatest(F.floor(y / high), F.lit(0)), F.col("bands") - 1)
    crossed = F.sequence(place(F.col(f"{p}y")), place(g.bottom(p)))
    return rows.withColumn(f"{p}band", F.get(crossed, 0)).withColumn("band", F.explode(crossed))


def meeting(left: DataFrame, p: str, right: DataFrame, q: str) -> DataFrame:
    """Boxes of a page whose heights meet, each pair once: in the first band that both cross.

    ``left`` has the page's sizes and bands; ``right`` has been banded.
    """
    first = F.col("band") == F.greatest(f"{p}band", f"{q}band")
    meet = (F.col(f"{p}y") < g.bottom(q)) & (F.col(f"{q}y") < g.bottom(p))
    return banded(left, p).join(right, [*PAIR, "band"]).where(first & meet)


def scores(source: DataFrame, target: DataFrame, rules: Rules, known: DataFrame | None = None) -> DataFrame:
    """The four similarities and their weighted sum for all regions of a page pair, or for ``known`` matches only."""
    weights = ("position", "size", "type", "order", "text_types")
    left = source.select(*PAIR, "sp_width", "sp_height", "tp_width", "tp_height", "s_n", "s_region_ord", "s_region_id", "s_type", "s_x", "s_y", "s_width", "s_height", *[rules.value(w).alias(f"w_{w}") for w in weights])
    right = target.select(*PAIR, "t_n", "t_region_ord", "t_region_id", "t_type", "t_x", "t_y", "t_width", "t_height")
    met = left.join(right, PAIR) if known is None else left.join(known, [*PAIR, "s_region_id"]).join(right, [*PAIR, "t_region_id"])
    parts = {
        "position": g.position_similarity("s_", "t_", F.greatest("sp_width", "tp_width"), F.greatest("sp_height", "tp_height")),
        "size": g.size_similarity("s_", "t_"),
        "type": g.type_similarity("s_type", "t_type", F.col("w_text_types")),
        "order": g.order_similarity("s_region_ord", "s_n", "t_region_ord", "t_n"),
    }
    joined = met.select(*PAIR, "s_region_ord", "t_region_ord", "s_region_id", "t_region_id", *[v.alias(k) for k, v in parts.items()], *[f"w_{w}" for w in parts])
    total = sum((F.col(f"w_{w}") * F.col(w) for w in ("size", "type", "order")), F.col("w_position") * F.col("position"))
    return joined.withColumn("score", total).drop(*[f"w_{w}" for w in parts])


#: settings that scoring and assigning a page pair needs
WEIGHTS = ("position", "size", "type", "order", "text_types", "minimum_score")


def matched(source: DataFrame, target: DataFrame, rules: Rules) -> DataFrame:
    """The rows of ``scores`` that the best one-to-one assignment keeps, at least at the minimum score.

    Both sides of a page pair meet in one pass; all page pairs of a batch are scored together.
    """
    columns = ["n", "region_ord", "region_id", "type", "x", "y", "width", "height"]
    sizes = ["sp_width", "sp_height", "tp_width", "tp_height"]
    settings = [rules.value(w).cast("double").alias(f"w_{w}") for w in WEIGHTS]
    sides = [rows.select(*PAIR, F.lit(k).alias("side"), *sizes, *settings, *[F.col(p + c).alias(c) for c in columns]) for k, (rows, p) in enumerate(((source, "s_"), (target, "t_")))]
    both = sides[0].unionByName(sides[1])

    def solve(rows: dict[str, np.ndarray], marks: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        i, j, parts = solvers.assigned(rows, marks)
        ids = {"s_region_ord": rows["region_ord"][i], "t_region_ord": rows["region_ord"][j], "s_region_id": rows["region_id"][i], "t_region_id": rows["region_id"][j]}
        return i, ids | parts

    types = dict(both.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in PAIR) + f", s_region_ord {types['region_ord']}, t_region_ord {types['region_ord']}, s_region_id string, t_region_id string, position double, size double, type double, `order` double, score double"
    return per_groups(both, PAIR, ["side", "region_ord"], solve, schema)


def unmatched(source: DataFrame, target: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source and target regions of paired pages without a match."""
    return source.join(matches, [*PAIR, "s_region_id"], "left_anti"), target.join(matches, [*PAIR, "t_region_id"], "left_anti")


def laid(matches: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Every target region, beside its matched source region and the relative changes of place, size and font (else nulls)."""
    s = source.select(*PAIR, "s_page", *[c for c in source.columns if c.startswith("s_") and c != "s_page"])
    both = matches.drop("s_region_ord", "t_region_ord").join(s, [*PAIR, "s_region_id"])
    return target.join(both, [*PAIR, "t_region_id"], "left").withColumns(
        {
            "dx": (F.col("t_x") - F.col("s_x")) / F.col("sp_width"),
            "dy": (F.col("t_y") - F.col("s_y")) / F.col("sp_height"),
            "dw": (F.col("t_width") - F.col("s_width")) / F.col("s_width"),
            "dh": (F.col("t_height") - F.col("s_height")) / F.col("s_height"),
            "font_change": (F.col("t_font_size") - F.col("s_font_size")) / F.col("s_font_size"),
            "color_changed": F.coalesce(F.col("s_color") != F.col("t_color"), F.lit(False)),
        }
    )
