"""What a rule profile says, as columns: one profile for all pairs, or a table of profile versions that pairs name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import BANDS, CAPS, DEDUCTIONS, LIMITS, PLACES, THRESHOLDS, TOGGLES, Profile

#: settings of a profile that are plain numbers or switches
PLAIN = tuple(k for k in PLACES if k not in ("deductions", "caps", "severity_overrides"))
_SWITCHES = ("align_pages", "critical_forces_fail", "high_forces_review")
_DETECTORS = f"struct<t:struct<{','.join(f'{k}:double' for k in THRESHOLDS)}>,`on`:struct<{','.join(f'{k}:boolean' for k in TOGGLES)}>,bands:struct<{','.join(f'{k}:array<struct<least:double,severity:string>>' for k in BANDS)}>>"
#: schema of the column ``rules``
RULES = f"struct<reference:string,language:string,{','.join(f'{k}:' + ('boolean' if k in _SWITCHES else 'double') for k in PLAIN)},detectors:{_DETECTORS},overrides:map<string,{_DETECTORS}>,severities:map<string,string>,caps:map<string,double>,deductions:map<string,double>>"


def _detectors(thresholds: dict, off: tuple[str, ...], bands: dict) -> dict:
    return {"t": {k: float(v) for k, v in thresholds.items()}, "on": {k: k not in off for k in TOGGLES}, "bands": {k: [{"least": float(x), "severity": s} for x, s in sorted(v, reverse=True)] for k, v in bands.items()}}


def as_row(p: Profile) -> dict:
    """A profile as a value of the column ``rules``."""
    plain = {k: getattr(p, k) if k in _SWITCHES else float(getattr(p, k)) for k in PLAIN}
    overrides = {k: _detectors(*p.override(k)) for k in p.languages()}
    return {"reference": p.reference, "language": p.language, **plain, "detectors": _detectors(p.thresholds, p.off, p.bands), "overrides": overrides, "severities": dict(p.severity_overrides), "caps": {k: float(v) for k, v in p.caps.items()}, "deductions": {k: float(v) for k, v in p.deductions.items()}}


class Rules:
    """One profile for every pair: thresholds are literals, switched-off detectors don't run."""

    #: whether rows carry the column ``rules``
    carried = False

    def __init__(self, profile: Profile):
        self.profile = profile

    def attach(self, rows: DataFrame) -> DataFrame:
        """The rows with what the other methods need."""
        return rows

    def value(self, name: str) -> Column:
        """A plain setting."""
        return F.lit(getattr(self.profile, name))

    def t(self, name: str) -> Column:
        return F.lit(float(self.profile.t(name)))

    def on(self, rows: DataFrame, toggle: str | None) -> DataFrame | None:
        """The rows of pairs whose profile has the detector on; None if there can't be any."""
        return rows if toggle is None or self.profile.on(toggle) else None

    def band(self, name: str, value: Column) -> Column:
        return self.profile.band(name, value)

    def severity(self, issue_type: str, default: str) -> Column:
        return F.lit(self.profile.severity(issue_type, default))

    def points(self, table: str, key: str, default: float) -> Column:
        out = F.lit(default)
        for k, v in getattr(self.profile, table).items():
            out = F.when(F.col(key) == k, v).otherwise(out)
        return out

    def language(self) -> Column | None:
        """The declared language pair; null: by the text."""
        return F.lit(None if self.profile.language == "auto" else self.profile.language).cast("string")

    def content_on(self, rows: DataFrame, toggle: str) -> DataFrame:
        """The rows of language pairs for which a content detector is on."""
        on = F.lit(self.profile.on(toggle))
        for k in self.profile.languages():
            on = F.when(F.col("language") == k, F.lit(toggle not in self.profile.override(k)[1])).otherwise(on)
        return rows.where(on)

    def content_t(self, name: str) -> Column:
        out = self.t(name)
        for k in self.profile.languages():
            out = F.when(F.col("language") == k, F.lit(float(self.profile.override(k)[0][name]))).otherwise(out)
        return out

    def content_band(self, name: str, value: Column) -> Column:
        out = self.band(name, value)
        for k in self.profile.languages():
            out = F.when(F.col("language") == k, self.profile.band(name, value, bands=self.profile.override(k)[2])).otherwise(out)
        return out


class TabledRules(Rules):
    """Profiles by pair: (pair_id, rules); thresholds, switches and bands are columns of the rows."""

    carried = True

    def __init__(self, table: DataFrame):
        self.table = table

    def attach(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table.select("pair_id", "rules"), "pair_id")

    def value(self, name: str) -> Column:
        return F.col(f"rules.{name}")

    def t(self, name: str) -> Column:
        return F.lit(LIMITS[name]) if name in LIMITS else F.col(f"rules.detectors.t.{name}")

    def on(self, rows: DataFrame, toggle: str | None) -> DataFrame | None:
        return rows if toggle is None else rows.where(F.col(f"rules.detectors.on.{toggle}"))

    def _reached(self, bands: Column, value: Column) -> Column:
        return F.coalesce(F.get(F.filter(bands, lambda b: value >= b["least"]), 0)["severity"], F.lit("high"))

    def band(self, name: str, value: Column) -> Column:
        return self._reached(F.col(f"rules.detectors.bands.{name}"), value)

    def severity(self, issue_type: str, default: str) -> Column:
        return F.coalesce(F.col("rules.severities")[issue_type], F.lit(default))

    def points(self, table: str, key: str, default: float) -> Column:
        return F.coalesce(F.col(f"rules.{table}")[F.col(key)], F.lit(default))

    def language(self) -> Column:
        return F.when(F.col("rules.language") != "auto", F.col("rules.language"))

    def _content(self) -> Column:
        return F.coalesce(F.col("rules.overrides")[F.col("language")], F.col("rules.detectors"))

    def content_on(self, rows: DataFrame, toggle: str) -> DataFrame:
        return rows.where(self._content()["on"][toggle])

    def content_t(self, name: str) -> Column:
        return self._content()["t"][name]

    def content_band(self, name: str, value: Column) -> Column:
        return self._reached(self._content()["bands"][name], value)


def profile_table(spark, profiles: list[Profile]) -> DataFrame:
    """(reference, rules) of each profile version."""
    return spark.createDataFrame([(p.reference, as_row(p)) for p in profiles], f"reference string, rules {RULES}")


def by_pair(pairs: DataFrame, profiles: DataFrame) -> TabledRules:
    """Rules for ``pairs`` (pair_id, reference), each with the profile version it names."""
    return TabledRules(pairs.join(profiles, "reference").select("pair_id", "rules"))


__all__ = ["CAPS", "DEDUCTIONS", "RULES", "Rules", "TabledRules", "as_row", "by_pair", "profile_table"]
