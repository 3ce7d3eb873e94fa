"""What issues tell of their findings: one typed struct for all issue types, JSON only where it leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOX, _SPREADS = "struct<x:double,y:double,width:double,height:double>", "struct<left:double,right:double,center:double,confidence:double>"
#: What is told of a region and of a match, by the names that reports have.
SIDE = {"text": "string", "bbox": _BOX, "region_type": "string"}
SOURCE, TARGET = ({f"{side}_{k}": v for k, v in SIDE.items()} for side in ("source", "target"))
MATCH = {"match_score": "double", **{f"match_{k}_similarity": "double" for k in ("position", "size", "type", "order")}}
_BOTH = SOURCE | TARGET
_OVERLAP = {"overlap_ratio": "double", "source_overlap_ratio": "double", "overlap_increase_ratio": "double", "other_region": "string", "primary_text": "string", "other_text": "string", "primary_region_type": "string", "other_region_type": "string", "other_bbox": _BOX} | TARGET
_FONT = {"font_size_change_ratio": "double"} | _BOTH | MATCH
#: The keys of each issue type, in order, and their types.
KEYS: dict[str, dict[str, str]] = {
    "page_missing": {"source_region_count": "bigint"},
    "extra_page": {"target_region_count": "bigint"},
    "missing_element": {"region_type": "string"} | SOURCE,
    "missing_image": {"region_type": "string"} | SOURCE,
    "added_element": {"region_type": "string"} | TARGET,
    "text_rasterized": _BOTH | MATCH | {"region_type": "string", "type_change": "string", "text_opacity": "double", "image_overlap_ratio": "double", "invisible_text_region": "string", "invisible_text_bbox": _BOX, "visible_image_region": "string"},
    "region_shifted": {"x_shift_ratio": "double", "y_shift_ratio": "double"} | _BOTH | MATCH,
    "font_shrink": _FONT,
    "typography_changed": _FONT,
    "region_resized": {"width_change_ratio": "double", "height_change_ratio": "double", "resize_magnitude": "double"} | _BOTH | MATCH,
    "text_fragmented": {"text": "string", "source_text": "string", "target_text": "string", "bbox_width": "double", "letter_count": "int"} | _BOTH,
    "text_alignment_changed": {"source_alignment": "string", "target_alignment": "string", "source_line_count": "bigint", "target_line_count": "bigint", "source_spreads": _SPREADS, "target_spreads": _SPREADS, "group_match_count": "bigint", "group_match_ratio": "double"} | _BOTH,
    "invisible_text": {"text_color": "string", "background_color": "string", "text_opacity": "double", "text": "string", "source_text": "string", "target_text": "string"} | _BOTH,
    "content_out_of_page": {"page_width": "double", "page_height": "double"} | TARGET,
    "text_overlap": _OVERLAP,
    "text_image_overlap": _OVERLAP,
    "text_vectorized": {"source_text_chars": "bigint", "target_text_chars": "bigint"},
    "number_mismatch": {"source_numbers": "array<string>", "target_numbers": "array<string>", "missing_numbers": "array<string>", "extra_numbers": "array<string>", "diff_count": "int"} | _BOTH,
    "untranslated_text": {"source_script": "string", "source_language_ratio": "double", "threshold": "double", "sample": "string"} | _BOTH | MATCH,
    "glossary_violation": {"term": "string", "allowed_translations": "array<string>", "note": "string", "glossary_reference": "string"} | _BOTH,
}
#: every key of any issue with its type
ALL: dict[str, str] = {k: v for keys in KEYS.values() for k, v in keys.items()}
#: keys that are told even where the region they are of is not there
_ALWAYS = {"text_fragmented": ("source_text", "target_text"), "invisible_text": ("source_text", "target_text")}


def box(p: str) -> Column:
    return F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("x", "y", "width", "height")])


def of(source: str | None = None, target: str | None = None, match: bool = False) -> dict[str, Column]:
    """What is told of the regions whose columns have a prefix, and of their match; a later map's keys win over an earlier one's."""
    out: dict[str, Column] = {}
    for p, name in ((source, "source"), (target, "target")):
        if p is not None:
            out |= {f"{name}_text": F.col(f"{p}text"), f"{name}_bbox": F.when(F.col(f"{p}x").isNotNull(), box(p)), f"{name}_region_type": F.col(f"{p}type")}
    if match:
        out |= {"match_score": F.col("score"), **{f"match_{k}_similarity": F.col(k) for k in ("position", "size", "type", "order")}}
    return out


def part(told: dict[str, Column], keys: Iterable[str] | None = None) -> Column:
    """The typed struct of the told keys, or of ``keys``, where those that aren't told are null."""
    return F.struct(*[told[k].cast(ALL[k]).alias(k) if k in told else F.expr(f"cast(null as {ALL[k]}) as {k}") for k in (told if keys is None else keys)])


def whole(keys: Iterable[str], at: str) -> Column:
    """The struct of all keys from one of some keys."""
    have = set(keys)
    return F.expr("named_struct(" + ", ".join(f"'{k}', {f'{at}.{k}' if k in have else f'cast(null as {kind})'}" for k, kind in ALL.items()) + ")")


#: issue types that may name no source or no target region, and then tell nothing of it
_OPTIONAL = ("text_fragmented", "invisible_text", "number_mismatch")


def _cases(make: Callable[[list[str]], str]) -> Column:
    """make(keys) of the keys that an issue tells, by its type and by which regions it names."""
    parts = []
    for kind, own in KEYS.items():
        named = "type = 'added_element' and detector = 'page'" if kind == "extra_page" else f"type = '{kind}'"
        if kind in _OPTIONAL:
            left = lambda *gone: make([k for k in own if k in _ALWAYS.get(kind, ()) or not any(k in names for names in gone)])  # noqa: B023, E731
            parts += [f"when {named} and source_region is null and target_region is null then {left(SOURCE, TARGET)}", f"when {named} and source_region is null then {left(SOURCE)}", f"when {named} and target_region is null then {left(TARGET)}"]
        # pages without a source page come before regions without one
        parts.insert(0 if kind == "extra_page" else len(parts), f"when {named} then {make(list(own))}")
    return F.expr(f"case {' '.join(parts)} end")


def keys() -> Column:
    """The keys that an issue tells, in order."""
    return _cases(lambda own: "array(" + ", ".join(f"'{k}'" for k in own) + ")")


def as_json(evidence: str = "evidence") -> Column:
    """The told keys as JSON, keys without a value as null."""
    return _cases(lambda own: "to_json(named_struct(" + ", ".join(f"'{k}', {evidence}.{k}" for k in own) + "), map('ignoreNullFields', 'false'))")


def _plain(value: str, kind: str) -> str:
    """SQL for a value as text: numbers in millionths, boxes and lists comma-joined."""
    if kind == "double":
        return f"cast(cast(floor({value} * 1000000 + 0.5) as bigint) as string)"
    if kind.startswith("struct"):
        fields = [f.partition(":")[0] for f in kind[len("struct<") : -1].split(",")]
        return f"array_join(array({', '.join(_plain(f'{value}.{f}', 'double') for f in fields)}), ',')"
    return f"array_join({value}, ',')" if kind.startswith("array") else f"cast({value} as string)"


def told(issues: DataFrame) -> DataFrame:
    """(pair_id, report_page, issue_id, key, value): each key that an issue tells, its value as text."""
    values = F.expr("map(" + ", ".join(f"'{k}', {_plain(f'evidence.{k}', kind)}" for k, kind in ALL.items()) + ")")
    rows = issues.select("pair_id", "report_page", "issue_id", keys().alias("keys"), values.alias("values"))
    return rows.select("pair_id", "report_page", "issue_id", F.explode("keys").alias("key"), "values").select("pair_id", "report_page", "issue_id", "key", F.col("values")[F.col("key")].alias("value"))
