"""The comparison of document pairs as a plan over tables, and its stages by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors, evidence, grouping, matching, pages, scoring, texts
from ..sources.tables import JOINED, bucketed, removed, stored, together
from .profile import Profile
from .rules import Rules

STAGES = ("parse", "group", "alignment", "match", "detect", "report")
PAIR = matching.PAIR
#: blocks of a bucket, while there are fewer buckets than shuffle partitions
BUCKET_BLOCKS = 200_000


class Comparison:
    """The tables of one comparison of many pairs; each is made when it is first asked for, from those it needs only.

    Tables that several others read are written once as Parquet in the shared folder:
    their lineage ends there and their columns stay prunable.  They lie in buckets of the
    pair of documents, so what meets on a page or a page pair isn't moved again.
    """

    #: whether issues have evidence
    told = True
    #: whether the blocks lie by pair, in as many buckets as the other tables
    _lie = False

    def __init__(self, pages_: DataFrame, blocks: DataFrame, rules: Rules, glossary: DataFrame | None, split: bool, paired: DataFrame | None, matched: DataFrame | None, group: Callable | None, derived: Callable | None = None):
        self.rules, self.glossary = rules, glossary
        self._given = (pages_, blocks, split, paired, matched, group)
        self._derived = derived

    @property
    def context(self) -> Comparison:
        """What the detectors read: the comparison itself."""
        return self

    @property
    def profile(self) -> Profile:
        """The profile of all pairs, where there is one."""
        return self.rules.profile

    @property
    def _spark(self):
        return self._given[0].sparkSession

    @cached_property
    def _buckets(self) -> int:
        """Buckets of all tables: a core each at least, more for many blocks, up to the session's shuffle partitions."""
        cores, most = self._spark.sparkContext.defaultParallelism, int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, min(most, max(cores, self.blocks_once.count() // BUCKET_BLOCKS)))

    def _bucketed(self, df: DataFrame, name: str, dealt: bool = False) -> DataFrame:
        return bucketed(df, name, ["pair_id"], self._buckets, dealt)

    def forget(self) -> None:
        """Deletes the tables that were made; what was read from the comparison can't be read again."""
        brief = self.__dict__.pop("brief", self)
        if brief is not self:
            brief.forget()
        for name in ("pages", "blocks", "regions", "sheets", "source", "target", "matches", "laid", "laps", "claims", "lines", "flows", "languages", "typed_issues", "brief_issues"):
            if name in self.__dict__:
                removed(self.__dict__.pop(name))
        self.__dict__.pop("_sides", None)

    @cached_property
    def brief(self) -> Comparison:
        """The same comparison of blocks whose texts were replaced by what issues without evidence need of them.

        A glossary's terms and a grouping that was given read the texts themselves.
        """
        if self.glossary is not None or self._given[5] is not None or not self.told:
            return self
        pages_, blocks, split, paired, matched, _ = self._given
        found = Comparison(pages_, blocks, self.rules, None, split, paired, matched, None)
        found.told, found._lie, found._buckets = False, True, self._buckets
        found.blocks = found._bucketed(texts.replaced(self.blocks_once, self.rules), "blocks")
        if self._derived:
            pages_, paired, matched = self._derived(found.blocks)
        found._given = (pages_, found.blocks, split, paired, matched, None)
        return found

    @property
    def _reader(self) -> Comparison:
        """What readers that need no evidence read: issues that are there, else those of the brief comparison."""
        return self if "typed_issues" in self.__dict__ else self.brief

    @cached_property
    def pages(self) -> DataFrame:
        return stored(self._given[0], "pages")

    @cached_property
    def blocks(self) -> DataFrame:
        return stored(self._given[1], "blocks")

    @cached_property
    def regions(self) -> DataFrame:
        _, _, split, _, _, group = self._given
        # blocks that are cut are read several times
        blocks = self.blocks if split and not group else self.blocks_once
        made = group(blocks, self.rules) if group else grouping.regions(blocks, self.rules, split, self._buckets, self._lie)
        if not self.told:
            made = made.drop("children", "above", "below")
        return self._bucketed(made, "regions", dealt=not group)

    @property
    def blocks_once(self) -> DataFrame:
        """The blocks for one reader: the table if it is there, else what was given."""
        return self.__dict__.get("blocks", self._given[1])

    @property
    def regions_once(self) -> DataFrame:
        """The regions for one reader: the table if it is there, else its plan, which carries only what is read."""
        if "regions" in self.__dict__:
            return self.regions
        _, _, split, _, _, group = self._given
        return group(self.blocks_once, self.rules) if group else grouping.regions(self.blocks_once, self.rules, split)

    @cached_property
    def sheets(self) -> DataFrame:
        """The report entries with what is known of their pages."""
        paired = self._given[3]
        if paired is None and (self.rules.carried or self.profile.align_pages):
            paired = pages.aligned(self.pages, self.regions, self.rules)
        entries = pages.entries(pages.identity(self.pages) if paired is None else paired)
        return self._bucketed(matching.sheets(self.regions, self.pages, entries, self.rules), "sheets")

    @property
    def entries(self) -> DataFrame:
        return self.sheets.select("pair_id", "s_page", "t_page", "report_page", "kind")

    @cached_property
    def _sides(self) -> list[DataFrame]:
        source, target = matching.on_sheets(self.regions, self.sheets)
        return together(self._spark, lambda: self._bucketed(source, "source", True), lambda: self._bucketed(target, "target", True))

    @cached_property
    def source(self) -> DataFrame:
        """Source regions of paired pages."""
        return self._sides[0]

    @cached_property
    def target(self) -> DataFrame:
        """Target regions of paired pages."""
        return self._sides[1]

    @cached_property
    def matches(self) -> DataFrame:
        known = self._given[4]
        if known is None:
            return self._bucketed(matching.matched(self.source, self.target, self.rules), "matches")
        keys = [*PAIR, "s_region_id", "t_region_id"]
        return self._bucketed(matching.scores(self.source, self.target, self.rules, known.select(*keys)), "matches")

    @cached_property
    def laid(self) -> DataFrame:
        """Target regions beside the source regions they match, if any."""
        sides = (self.source, self.target) if self.told else (self.source.drop("s_numbers", "s_counts"), self.target.drop("t_numbers"))
        return self._bucketed(matching.laid(self.matches, *sides), "laid", True)

    @property
    def diffs(self) -> DataFrame:
        """Matched regions with their differences."""
        return self.laid.where("s_region_id is not null")

    @cached_property
    def laps(self) -> DataFrame:
        """Pairs of target regions that overlap."""
        return self._bucketed(detectors.overlap_pairs(self.target, self.rules), "laps")

    @cached_property
    def claims(self) -> DataFrame:
        """Transparent text with the image that stands for it."""
        return self._bucketed(detectors.rasterized(self), "claims")

    @cached_property
    def lines(self) -> DataFrame:
        """Text regions of both sides with their flows."""
        return self._bucketed(detectors.text_lines(self.source, self.target, self.rules), "lines")

    @cached_property
    def flows(self) -> DataFrame:
        """Flows whose alignment changed, of pairs whose profile looks at it."""
        changed = detectors.changed_flows(self)
        if self.rules.carried:
            changed = self.rules.on(self.rules.attach(changed), "text_alignment_changed").drop("rules")
        return self._bucketed(changed, "flows")

    @cached_property
    def languages(self) -> DataFrame:
        """The scripts of page pairs, and the language pair they give."""
        return self._bucketed(detectors.languages(self), "languages")

    def _told(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("metrics", evidence.as_json())

    def typed_issues_of(self, *types: str) -> DataFrame:
        """The issues of some types, from the detectors that can raise them only."""
        return detectors.issues(self, types).where(F.col("type").isin(*types))

    def issues_of(self, *types: str) -> DataFrame:
        """typed_issues_of() with their evidence as JSON too."""
        return self._told(self.typed_issues_of(*types))

    def _detected(self) -> DataFrame:
        """The plan of all detectors, over tables that are there."""
        self.source, self.target  # noqa: B018  both are needed twice below
        together(self._spark, lambda: self.lines, lambda: self.laid, lambda: self.laps, lambda: self.languages)
        together(self._spark, lambda: self.claims, lambda: self.flows)
        return detectors.issues(self)

    @cached_property
    def typed_issues(self) -> DataFrame:
        return self._bucketed(self._detected(), "issues")

    @cached_property
    def brief_issues(self) -> DataFrame:
        """All issues without their evidence, for readers that need none: no text travels for it."""
        if "typed_issues" in self.__dict__:
            return self.typed_issues.drop("evidence")
        if self.brief is not self:
            return self.brief.brief_issues
        return self._bucketed(self._detected().drop("evidence"), "brief_issues")

    @property
    def issues(self) -> DataFrame:
        """All issues; ``metrics`` is their evidence as JSON, made when it is read."""
        return self._told(self.typed_issues)

    @cached_property
    def page_results(self) -> DataFrame:
        if self._reader is not self:
            return self._reader.page_results
        return scoring.page_results(self.rules.attach(self.entries), self.brief_issues, self.rules)

    @cached_property
    def documents(self) -> DataFrame:
        if self._reader is not self:
            return self._reader.documents
        return scoring.document_results(self.pages, self.page_results, self.brief_issues)


def compare(pages_: DataFrame, blocks: DataFrame, profile: Profile | Rules | None = None, glossary: DataFrame | None = None, split: bool = True, paired: DataFrame | None = None, matched: DataFrame | None = None, group: Callable | None = None, derived: Callable | None = None) -> Comparison:
    """Compares the source and target side of every pair.

    ``pages_``: pair_id, side, page, width, height, background_color, dark_boxes.
    ``blocks``: the columns of grouping.BLOCKS.  ``paired`` (pair_id, s_page, t_page)
    and ``matched`` (pair_id, report_page, s_region_id, t_region_id) replace page
    alignment and the assignment where the truth is known; ``group`` replaces grouping.
    ``derived``: where pages, ``paired`` and ``matched`` follow from the blocks, makes the three
    from a table of them.
    ``profile``: one for all pairs, or rules.by_pair() for profile versions that pairs name.
    """
    return Comparison(pages_, blocks, profile if isinstance(profile, Rules) else Rules(profile or Profile()), glossary, split, paired, matched, group, derived)


def stage(found: Comparison, name: str) -> DataFrame:
    """A stage's summary, one row for each pair."""
    if name == "parse":
        return found.blocks_once.groupBy("pair_id", "side").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("blocks"))
    if name == "group":
        return found.regions.groupBy("pair_id", "side", "type").agg(F.count("*").alias("regions"))
    if name == "alignment":
        return found.entries.groupBy("pair_id", "kind").agg(F.count("*").alias("pages"))
    if name == "match":
        return found.matches.groupBy("pair_id", "report_page").agg(F.count("*").alias("matches"), F.avg("score").alias("mean_score"))
    if name == "detect":
        return scoring.type_counts(found.brief_issues)
    if name == "report":
        return found.documents
    raise ValueError(f"no such stage: {name}")


def contents(found: Comparison, name: str) -> DataFrame:
    """What a stage found, one row for each pair: (pair_id, data); ``report`` gives the nested reports instead.

    parse, group: of each side its pages, blocks or regions, and regions by type; alignment: page pairs
    and pages left over; match: of each page pair its matches, what they leave over and their mean score;
    detect: issues by type.
    """
    listed = lambda c: F.sort_array(F.collect_list(c))
    if name in ("parse", "group"):
        rows, unit = (found.blocks_once, "blocks") if name == "parse" else (found.regions, "regions")
        kinds = rows.groupBy("pair_id", "side", "page", "type").agg(F.count("*").alias("n")).groupBy("pair_id", "side", "type").agg(F.sum("n").alias("n"), F.collect_set("page").alias("on"))
        side = kinds.groupBy("pair_id", "side").agg(F.size(F.array_distinct(F.flatten(F.collect_list("on")))).cast("long").alias("pages"), F.sum("n").alias(unit), F.map_from_entries(listed(F.struct("type", "n"))).alias("types"))
        told = F.struct("pages", unit, *["types"] * (name == "group"))
        return side.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("side", told))).alias("data"))
    if name == "alignment":
        pair = F.when(F.col("kind") == "pair", F.struct("s_page", "t_page"))
        alone = lambda kind, page: listed(F.when(F.col("kind") == kind, F.col(page)))
        return found.entries.groupBy("pair_id").agg(F.struct(listed(pair).alias("pairs"), alone("missing", "s_page").alias("missing_source_pages"), alone("extra", "t_page").alias("extra_target_pages")).alias("data"))
    if name == "match":
        met = found.laid.groupBy(*PAIR).agg(F.count("s_region_id").alias("matched"), listed(F.when(F.col("s_region_id").isNull(), F.struct("t_region_ord", "t_region_id"))).alias("t"), F.avg("score").alias("mean_score"))
        alone = found.source.join(found.diffs.select(*PAIR, "s_region_id"), [*PAIR, "s_region_id"], "left_anti").groupBy(*PAIR).agg(listed(F.struct("s_region_ord", "s_region_id")).alias("s"))
        pages_ = found.sheets.where("kind = 'pair'").select(*PAIR, "s_page", "t_page").join(met, PAIR, "left").join(alone.hint(JOINED), PAIR, "left")
        ids = lambda c: F.coalesce(F.col(f"{c}.{c}_region_id"), F.array().cast("array<string>"))
        page = F.struct("s_page", "t_page", F.coalesce("matched", F.lit(0)).alias("matched"), ids("s").alias("unmatched_source"), ids("t").alias("unmatched_target"), "mean_score")
        return pages_.groupBy("pair_id").agg(listed(page).alias("data"))
    if name == "detect":
        return scoring.type_counts(found.brief_issues).groupBy("pair_id").agg(F.struct(F.sum("n").alias("total"), F.map_from_entries(listed(F.struct("type", "n"))).alias("by_type")).alias("data"))
    if name == "report":
        return reports(found, found.profile)
    raise ValueError(f"no such stage: {name}")


def stages(found: Comparison, stop_after: str = "report") -> dict[str, DataFrame]:
    """Summaries of all stages up to one."""
    return {name: stage(found, name) for name in STAGES[: STAGES.index(stop_after) + 1]}


def reports(found: Comparison, profile: Profile) -> DataFrame:
    """One nested report for each pair, with its pages, their issues and the profile it was made with."""
    order = F.array_sort(F.collect_list(F.struct("detector_ord", "row_ord", "issue_id", "type", "severity", "page", "source_region", "target_region", "x", "y", "width", "height", "metrics", "detector")))
    kind = F.when(F.col("detector") != "page", "pair").when(F.col("type") == "page_missing", "missing").otherwise("extra")
    of_page = found.issues.withColumn("kind", kind).groupBy("pair_id", "report_page", "kind").agg(order.alias("issues"))
    pages_ = found.page_results.join(of_page, ["pair_id", "report_page", "kind"], "left")
    rank = F.when(F.col("kind") == "pair", 0).when(F.col("kind") == "missing", 1).otherwise(2)
    nested = pages_.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("report_page", rank.alias("rank"), "kind", "score", "status", "issues"))).alias("pages"))
    return found.documents.join(nested, "pair_id", "left").withColumns({"profile_reference": F.lit(profile.reference), "profile": F.lit(profile.to_json())})
