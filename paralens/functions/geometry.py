"""Box geometry as column expressions.

A box is four columns with a common prefix: ``{p}x``, ``{p}y``, ``{p}width``,
``{p}height`` (width and height above 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_TYPES = ("text", "paragraph", "heading", "list", "header", "footer")


def right(p: str) -> Column:
    return F.col(f"{p}x") + F.col(f"{p}width")


def bottom(p: str) -> Column:
    return F.col(f"{p}y") + F.col(f"{p}height")


def area(p: str) -> Column:
    return F.col(f"{p}width") * F.col(f"{p}height")


def is_text(column: str) -> Column:
    return F.col(column).isin(*TEXT_TYPES)


def overlap_area(a: str, b: str) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(right(a), right(b)) - F.greatest(F.col(f"{a}x"), F.col(f"{b}x")))
    high = F.greatest(F.lit(0.0), F.least(bottom(a), bottom(b)) - F.greatest(F.col(f"{a}y"), F.col(f"{b}y")))
    return wide * high


def intersection_ratio(a: str, b: str) -> Column:
    """Shared area as a part of the smaller box."""
    return overlap_area(a, b) / F.least(area(a), area(b))


def center_inside(inner: str, outer: str) -> Column:
    x, y = F.col(f"{inner}x") + F.col(f"{inner}width") / 2, F.col(f"{inner}y") + F.col(f"{inner}height") / 2
    return (F.col(f"{outer}x") <= x) & (x <= right(outer)) & (F.col(f"{outer}y") <= y) & (y <= bottom(outer))


def position_similarity(a: str, b: str, page_width: Column, page_height: Column) -> Column:
    """1 less the distance of the centres as a part of the page's diagonal, 0 at least."""
    dx = F.col(f"{a}x") + F.col(f"{a}width") / 2 - (F.col(f"{b}x") + F.col(f"{b}width") / 2)
    dy = F.col(f"{a}y") + F.col(f"{a}height") / 2 - (F.col(f"{b}y") + F.col(f"{b}height") / 2)
    diagonal = F.sqrt(page_width * page_width + page_height * page_height)
    return F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy) / diagonal)


def size_similarity(a: str, b: str) -> Column:
    def part(side: str) -> Column:
        return F.least(f"{a}{side}", f"{b}{side}") / F.greatest(f"{a}{side}", f"{b}{side}")

    return (part("width") + part("height")) / 2


def type_similarity(a: str, b: str, both_text: Column | float) -> Column:
    return F.when(F.col(a) == F.col(b), 1.0).when(is_text(a) & is_text(b), both_text).otherwise(0.0)


def order_similarity(i: str, n: str, j: str, m: str) -> Column:
    """1 less the difference of the relative places i of n and j of m (places from 0)."""
    return 1 - F.abs(F.col(i) / F.greatest(F.lit(1), F.col(n) - 1) - F.col(j) / F.greatest(F.lit(1), F.col(m) - 1))


def min_channel(color: Column) -> Column:
    """The smallest of a ``#RRGGBB`` colour's channels; 0 if it isn't one."""
    hexes = F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), color)
    channels = [F.conv(F.substring(hexes, k, 2), 16, 10).cast("int") for k in (2, 4, 6)]
    return F.coalesce(F.least(*channels), F.lit(0))
