"""The rule profile: every threshold and weight of a comparison, versioned, as JSON."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
#: The issue types and how much each may take off a page's score.
CAPS = {
    "region_shifted": 12.0,
    "region_resized": 10.0,
    "text_fragmented": 10.0,
    "text_overflow": 25.0,
    "text_clipped": 25.0,
    "abnormal_wrap": 10.0,
    "line_count_explosion": 10.0,
    "font_shrink": 10.0,
    "text_overlap": 10.0,
    "text_image_overlap": 25.0,
    "content_out_of_page": 25.0,
    "missing_element": 10.0,
    "added_element": 3.0,
    "missing_image": 25.0,
    "typography_changed": 10.0,
    "table_structure_changed": 25.0,
    "page_missing": 25.0,
    "number_mismatch": 12.0,
    "untranslated_text": 12.0,
    "glossary_violation": 12.0,
    "invisible_text": 25.0,
    "text_rasterized": 10.0,
    "text_vectorized": 0.0,
    "text_alignment_changed": 10.0,
    "other": 10.0,
}
#: Points off for each issue of a severity.
DEDUCTIONS = {"info": 0.0, "low": 1.0, "medium": 4.0, "high": 10.0, "critical": 25.0}
#: The detectors that can be switched off, as published profiles name them.
TOGGLES = (
    "missing_element",
    "region_shifted",
    "font_shrink",
    "content_out_of_page",
    "overlap",
    "number_mismatch",
    "untranslated_text",
    "region_resized",
    "text_fragmented",
    "font_grow",
    "invisible_text",
    "text_rasterized",
    "text_alignment_changed",
)
#: Thresholds of detection, as published profiles name them.
THRESHOLDS = {
    "shifted_ratio": 0.05,
    "severely_shifted_ratio": 0.15,
    "font_shrink_ratio": -0.20,
    "overlap_ratio": 0.05,
    "overlap_increase_ratio": 0.05,
    "image_caption_area_ratio": 0.005,
    "untranslated_ratio": 0.7,
    "untranslated_min_letters": 8,
    "conversion_noise_ratio": 0.03,
    "region_resize_ratio": 0.5,
    "font_grow_ratio": 0.25,
    "fragment_max_width": 18.0,
    "fragment_max_letters": 3,
    "invisible_color_threshold": 235,
    "invisible_opacity_threshold": 0.01,
    "rasterized_image_overlap_ratio": 0.8,
    "vectorized_min_source_chars": 30,
    "vectorized_max_target_ratio": 0.1,
    "alignment_min_lines": 3,
    "alignment_line_gap_ratio": 0.6,
    "alignment_horizontal_overlap_ratio": 0.3,
    "alignment_font_size_tolerance_ratio": 0.15,
    "alignment_edge_tolerance_ratio": 0.015,
    "alignment_confidence_margin": 0.01,
    "alignment_group_match_ratio": 0.6,
    "text_label_max_chars": 30,
    "text_resize_height_tolerance_ratio": 0.2,
    "text_resize_font_tolerance_ratio": 0.1,
}
#: Limits that profiles don't carry.
LIMITS = {"flow_back": 0.25, "dark_overlap": 0.3}
#: Fixed values: (at least, severity) of each graded measure, as published profiles name them.
BANDS = {
    "number_mismatch_bands": ((5.0, "high"), (1.0, "medium")),
    "font_shrink_bands": ((0.4, "high"), (0.2, "medium")),
    "untranslated_bands": ((0.9, "high"), (0.7, "medium")),
    "region_resize_bands": ((0.8, "high"), (0.5, "medium")),
}
#: Where a published profile keeps a setting, by its name here.
PLACES = {
    "position": ("matching", "weights", "position"),
    "size": ("matching", "weights", "size"),
    "type": ("matching", "weights", "type"),
    "order": ("matching", "weights", "order"),
    "minimum_score": ("matching", "minimum_score"),
    "merged_coverage": ("matching", "merged_text_coverage_ratio"),
    "text_types": ("matching", "text_type_similarity"),
    "analog_position": ("detectors", "layout_analog_weights", "position"),
    "analog_size": ("detectors", "layout_analog_weights", "size"),
    "align_pages": ("alignment", "enabled"),
    "max_page_shift": ("alignment", "max_shift"),
    "skip_penalty": ("alignment", "skip_penalty"),
    "shift_margin": ("alignment", "shift_margin"),
    "heading_ratio": ("grouping", "heading_ratio"),
    "span_gap_ratio": ("grouping", "disconnected_span_gap_ratio"),
    "pass_score": ("scoring", "pass_score"),
    "fail_score": ("scoring", "fail_score"),
    "critical_forces_fail": ("scoring", "critical_forces_fail"),
    "high_forces_review": ("scoring", "high_forces_review"),
    "deductions": ("scoring", "severity_deductions"),
    "caps": ("scoring", "issue_type_deduction_caps"),
    "severity_overrides": ("detectors", "severity_overrides"),
}


@dataclass(frozen=True)
class Profile:
    """Immutable; ``check`` has run on every instance."""

    profile_id: str = "translation-balanced"
    version: int = 1
    status: str = "published"
    language: str = "auto"
    position: float = 0.40
    size: float = 0.25
    type: float = 0.20
    order: float = 0.15
    minimum_score: float = 0.45
    merged_coverage: float = 0.40
    text_types: float = 0.80
    analog_position: float = 0.70
    analog_size: float = 0.30
    align_pages: bool = True
    max_page_shift: int = 3
    skip_penalty: float = 0.5
    shift_margin: float = 0.01
    heading_ratio: float = 1.25
    span_gap_ratio: float = 3.0
    pass_score: float = 90.0
    fail_score: float = 75.0
    critical_forces_fail: bool = True
    high_forces_review: bool = True
    off: tuple[str, ...] = ()
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    bands: dict = field(default_factory=lambda: dict(BANDS))
    caps: dict = field(default_factory=lambda: dict(CAPS))
    deductions: dict = field(default_factory=lambda: dict(DEDUCTIONS))
    severity_overrides: dict = field(default_factory=dict)
    language_thresholds: dict = field(default_factory=dict)
    #: by language pair, beside its thresholds: detectors that are off, and bands
    language_off: dict = field(default_factory=dict)
    language_bands: dict = field(default_factory=dict)

    def __post_init__(self):
        self.check()

    def check(self) -> None:
        """Raises ValueError where weights, orders or keys don't fit."""
        if abs(self.position + self.size + self.type + self.order - 1) > 1e-6:
            raise ValueError("matching weights must add up to 1")
        if abs(self.analog_position + self.analog_size - 1) > 1e-6:
            raise ValueError("layout weights must add up to 1")
        if self.thresholds["severely_shifted_ratio"] <= self.thresholds["shifted_ratio"]:
            raise ValueError("the severe shift must exceed the shift")
        if self.fail_score >= self.pass_score:
            raise ValueError("the fail score must be below the pass score")
        if set(self.caps) != set(CAPS) or set(self.deductions) != set(SEVERITIES):
            raise ValueError("caps and deductions need a value for each key")
        if unknown := {t for off in (self.off, *self.language_off.values()) for t in off} - set(TOGGLES):
            raise ValueError(f"no such detector: {sorted(unknown)}")

    @property
    def reference(self) -> str:
        return f"{self.profile_id}@{self.version}"

    def on(self, toggle: str) -> bool:
        return toggle not in self.off

    def t(self, name: str) -> float:
        return LIMITS[name] if name in LIMITS else self.thresholds[name]

    def languages(self) -> list[str]:
        """Language pairs with settings of their own."""
        return sorted({*self.language_thresholds, *self.language_off, *self.language_bands})

    def override(self, language: str) -> tuple[dict, tuple[str, ...], dict]:
        """Thresholds, detectors that are off, and bands of a language pair; they replace the profile's as a whole."""
        return THRESHOLDS | self.language_thresholds.get(language, {}), tuple(self.language_off.get(language, ())), BANDS | self.language_bands.get(language, {})

    def severity(self, issue_type: str, default: str) -> str:
        return self.severity_overrides.get(issue_type, default)

    def band(self, name: str, value: Column, default: str = "high", bands: dict | None = None) -> Column:
        """The severity of the highest band that the value reaches."""
        out = F.lit(default)
        for least, severity in sorted((bands or self.bands)[name]):
            out = F.when(value >= least, F.lit(severity)).otherwise(out)
        return out

    def with_noise(self, extra: float | None = None) -> Profile:
        """For converted inputs: both shift thresholds raised."""
        extra = self.t("conversion_noise_ratio") if extra is None else extra
        return replace(self, thresholds=self.thresholds | {k: self.thresholds[k] + extra for k in ("shifted_ratio", "severely_shifted_ratio")})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def published(self) -> dict:
        """The profile in the nested form of published profiles."""
        out: dict = {"profile_id": self.profile_id, "version": self.version, "status": self.status, "language": self.language}
        for name, place in PLACES.items():
            at = out
            for part in place[:-1]:
                at = at.setdefault(part, {})
            at[place[-1]] = getattr(self, name)
        def nested(thresholds: dict, off: tuple[str, ...], bands: dict) -> dict:
            graded = {k: [{"gte": least, "severity": severity} for least, severity in v] for k, v in bands.items()}
            return {"enabled": {t: t not in off for t in TOGGLES}, "thresholds": thresholds | graded}

        out["detectors"] |= nested(self.thresholds, self.off, self.bands)
        out["language_overrides"] = {k: nested(*self.override(k)) for k in self.languages()}
        return out

    @classmethod
    def from_published(cls, text: str) -> Profile:
        """A profile from the JSON of a published one; missing settings get defaults, names and descriptions are passed over."""
        given = merge_defaults(cls().published(), json.loads(text))
        values = {k: given[k] for k in ("profile_id", "version", "status", "language")}
        for name, place in PLACES.items():
            at = given
            for part in place:
                at = at[part]
            values[name] = at
        def flat(detectors: dict) -> tuple[dict, tuple[str, ...], dict]:
            found = detectors["thresholds"]
            return {k: found[k] for k in THRESHOLDS}, tuple(t for t in TOGGLES if not detectors["enabled"][t]), {k: tuple((b["gte"], b["severity"]) for b in found[k]) for k in BANDS}

        values["thresholds"], values["off"], values["bands"] = flat(given["detectors"])
        base = cls().published()["detectors"]
        own = {k: flat(merge_defaults(base, v)) for k, v in given["language_overrides"].items()}
        values["language_thresholds"] = {k: v[0] for k, v in own.items()}
        values["language_off"] = {k: v[1] for k, v in own.items() if v[1]}
        values["language_bands"] = {k: v[2] for k, v in own.items() if v[2] != BANDS}
        return cls(**values)

    @classmethod
    def from_json(cls, text: str) -> Profile:
        """Missing keys get defaults, also inside the tables; old values win.  Unknown keys are an error."""
        given = json.loads(text)
        base = asdict(cls())
        if unknown := set(given) - set(base):
            raise ValueError(f"no such setting: {sorted(unknown)}")
        merged = merge_defaults(base, given)
        merged["off"] = tuple(merged["off"])
        paired = lambda bands: {k: tuple(map(tuple, v)) for k, v in bands.items()}
        merged["bands"] = paired(merged["bands"])
        merged["language_off"] = {k: tuple(v) for k, v in merged["language_off"].items()}
        merged["language_bands"] = {k: paired(v) for k, v in merged["language_bands"].items()}
        return cls(**merged)


def merge_defaults(defaults: dict, values: dict) -> dict:
    """The values, with defaults for missing keys at every level."""
    return defaults | {k: merge_defaults(defaults[k], v) if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in values.items()}


def save(profile: Profile, path: str) -> None:
    """Writes the profile's JSON in one step: a temporary file beside the target, then a rename."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w") as f:
        f.write(profile.to_json())
    os.replace(name, path)


def load(path: str) -> Profile:
    with open(path) as f:
        return Profile.from_json(f.read())


def json_schema() -> dict:
    """Names, types and defaults of the settings."""
    kinds = {bool: "boolean", int: "integer", float: "number", str: "string", tuple: "array", list: "array", dict: "object"}
    return {"type": "object", "additionalProperties": False, "properties": {k: {"type": kinds[type(v)], "default": v} for k, v in asdict(Profile()).items()}}
