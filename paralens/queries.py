"""Registered queries of the comparison engine; each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import detectors, evidence, grouping, matching, names, pages, scoring, store
from .plans.compare import Comparison, compare, contents, reports
from .plans.profile import Profile
from .plans.rules import Rules, by_pair, profile_table
from .sources import fixtures, ledger, scan
from .sources.tables import JOINED
from .sources.tables import shared as shared_folder

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.blocks(documents(spark, sf_dir))


#: comparisons that queries share, by application, input and the input's state
_SHARED: dict[tuple, Comparison] = {}


def forget() -> None:
    """Lets the next query make its own tables, and deletes those that were made (a benchmark calls it before each one)."""
    while _SHARED:
        _SHARED.popitem()[1].forget()


def shared(make: Callable[..., Comparison]) -> Callable[..., Comparison]:
    """Queries of one application over unchanged files share a comparison, whose tables are made when first asked for."""

    @wraps(make)
    def given(spark: SparkSession, sf_dir: str, **options) -> Comparison:
        # one small job: the files' times and names, not their rows
        files = documents(spark, sf_dir).select("_metadata.file_path", "_metadata.file_modification_time").distinct()
        state = files.agg(F.max("file_modification_time"), F.count("*"), F.sum(F.xxhash64("file_path").cast("decimal(38,0)"))).first()
        values = tuple(sorted((k, v._jdf.queryExecution().analyzed().canonicalized().hashCode() if isinstance(v, DataFrame) else v) for k, v in options.items()))
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__, tuple(state), values)
        if key not in _SHARED:
            _SHARED[key] = make(spark, sf_dir, **options)
        return _SHARED[key]

    return given


@shared
def known(spark: SparkSession, sf_dir: str, **options) -> Comparison:
    """The comparison with the known page pairs and matches of the derived pairs."""
    b = blocks(spark, sf_dir)
    pages_, paired, matched = fixtures.truth(b)
    return compare(pages_, b, split=False, paired=paired, matched=matched, derived=fixtures.truth, **options)


@shared
def solved(spark: SparkSession, sf_dir: str) -> Comparison:
    """The comparison of clear pairs with everything found: parts, page alignment, assignment."""
    b = fixtures.clear_blocks(documents(spark, sf_dir))
    return compare(fixtures.pages(b), b)


@shared
def flowing(spark: SparkSession, sf_dir: str) -> Comparison:
    """The comparison of pairs of flows, with the assignment found."""
    b = fixtures.flow_blocks(documents(spark, sf_dir))
    return compare(fixtures.pages(b), b, Profile(align_pages=False))


def _pairs(make: Callable[[DataFrame], DataFrame], align: bool = False) -> Callable[..., Comparison]:
    """The comparison, as found, of pairs that ``make`` derives."""

    def compared(spark: SparkSession, sf_dir: str) -> Comparison:
        b = make(documents(spark, sf_dir))
        return compare(fixtures.pages(b), b, Profile(align_pages=align))

    compared.__name__ = make.__name__
    return shared(compared)


tangled, sharing, columns = _pairs(fixtures.tangled_blocks), _pairs(fixtures.shared_image_blocks), _pairs(fixtures.column_blocks)
gapped = _pairs(fixtures.gapped_blocks, align=True)


def glossary(spark: SparkSession) -> DataFrame:
    rows = [("demo", 1, 0, "The", ["的"], None, False), ("demo", 1, 1, "und", ["和", "与"], "two renderings", True), ("demo", 1, 2, "la", ["这"], None, True)]
    return spark.createDataFrame(rows, "glossary_id string, version int, term_ord int, term string, translations array<string>, note string, case_sensitive boolean")


def _e6(c: str) -> F.Column:
    return F.floor(F.col(c) * 1_000_000 + 0.5).cast("long")


def _issue(*types: str, kind: str = "pair"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(known(spark, sf_dir).issues_of(*types).where(F.col("detector") != "page"))

    return query


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("pair_id", "report_page", "page", "issue_id", "type", "severity", "source_region", "target_region")


def _spans(make: Callable[[DataFrame], DataFrame]):
    return lambda s, d: make(documents(s, d)).drop("line")


def _page_issue(kind: str):
    return lambda s, d: known(s, d).issues_of(kind).where((F.col("detector") == "page") & (F.col("type") == kind)).select("pair_id", "report_page", "issue_id", "severity")


def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = known(spark, sf_dir)
    rows = matching.scores(c.source, c.target, c.rules)
    return rows.select("pair_id", "report_page", "s_region_id", "t_region_id", _e6("position").alias("position_e6"), _e6("size").alias("size_e6"), F.round(F.col("type") * 100).cast("int").alias("type_pct"), _e6("order").alias("order_e6"))


def unmatched_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = known(spark, sf_dir)
    s, t = matching.unmatched(c.context.source, c.context.target, c.matches)
    named = lambda df, p, side: df.select("pair_id", "report_page", F.lit(side).alias("side"), F.col(f"{p}region_id").alias("region_id"))
    return named(s, "s_", "source").unionByName(named(t, "t_", "target"))


def structured_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = known(spark, sf_dir).diffs
    return rows.select("pair_id", "report_page", "s_region_id", "t_region_id", *[_e6(c).alias(n) for c, n in (("dx", "dx_e6"), ("dy", "dy_e6"), ("dw", "dw_e6"), ("dh", "dh_e6"), ("font_change", "font_e6"))], "color_changed")


def covered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source regions that target text covers, of those that a part of the matches leaves alone."""
    c = known(spark, sf_dir)
    alone, _ = matching.unmatched(c.source, c.target, c.matches.where("s_region_ord % 6 <> 0"))
    return detectors.covered(c, alone).select("pair_id", "report_page", F.col("s_region_id").alias("region_id"))


def dominant_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = known(spark, sf_dir).context
    sides = [detectors.page_scripts(rows, text, matching.PAIR).withColumn("side", F.lit(side)) for rows, text, side in ((c.source, "s_text", "source"), (c.target, "t_text", "target"))]
    return sides[0].unionByName(sides[1])


def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = known(spark, sf_dir)
    tables = {"parse": c.blocks_once, "group": c.regions, "alignment": c.entries, "match": c.matches, "detect": c.brief_issues}
    return reduce(DataFrame.unionByName, [t.groupBy("pair_id").agg(F.lit(n).alias("stage"), F.count("*").alias("n")) for n, t in tables.items()])


def stage_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages of the known pairs found, as text."""
    c = known(spark, sf_dir)
    told = {
        "group": "array_join(transform(array('source', 'target'), s -> concat(s, ':', coalesce(data[s].pages, 0), ':', coalesce(data[s].regions, 0), ':', coalesce(array_join(transform(array_sort(map_entries(data[s].types)), e -> concat(e.key, '=', e.value)), ','), ''))), ' ')",
        "alignment": "concat(array_join(transform(data.pairs, p -> concat(p.s_page, '-', p.t_page)), ','), '|', array_join(data.missing_source_pages, ','), '|', array_join(data.extra_target_pages, ','))",
        "match": "array_join(transform(data, p -> concat(p.s_page, '-', p.t_page, ':', p.matched, ':', array_join(p.unmatched_source, ','), ':', array_join(p.unmatched_target, ','), ':', coalesce(cast(cast(floor(p.mean_score * 1000000 + 0.5) as bigint) as string), ''))), ' ')",
        "detect": "concat(data.total, ':', array_join(transform(array_sort(map_entries(data.by_type)), e -> concat(e.key, '=', e.value)), ','))",
    }
    return reduce(DataFrame.unionByName, [contents(c, name).select("pair_id", F.lit(name).alias("stage"), F.expr(how).alias("told")) for name, how in told.items()])


def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of every rule of the data model, put into the known tables."""
    c = known(spark, sf_dir)
    b = c.blocks.withColumn("width", F.when((F.col("pair_id") % 11 == 3) & (F.col("page") == 1), 0.0).otherwise(F.col("width")))
    b = b.where("not (pair_id % 5 = 4 and block_ord = 1 and side = 'target')")
    p = c.pages.where("not (pair_id % 13 = 5 and page = 2)").withColumn("width", F.when(F.col("pair_id") % 19 == 2, 0.0).otherwise(F.col("width")))
    r = c.regions
    twice = lambda df, which: df.unionByName(df.where(which))
    found = grouping.integrity(twice(b, "pair_id % 7 = 0 and block_ord = 0"), twice(p, "pair_id % 17 = 1"), twice(r, "pair_id % 23 = 4 and region_ord = 0"))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.demo_records(documents(spark, sf_dir).select("doc_id", "text"))


def compared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with the verdicts and scores that their comparison finds."""
    found = known(spark, sf_dir).documents.select(F.col("pair_id").alias("record_id"), "status", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli"))
    return records(spark, sf_dir).drop("status", "score_milli").join(found.hint(JOINED), "record_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.demo_samples(documents(spark, sf_dir).select("doc_id", "text"))


def decisions(i: DataFrame) -> DataFrame:
    """Review decisions on a part of the issues."""
    size = F.length("issue_id")
    return i.where((F.col("pair_id") * 3 + size) % 4 == 0).select("pair_id", "issue_id", F.when((F.col("pair_id") + size) % 2 == 0, "accepted").otherwise("rejected").alias("decision"), ((F.col("pair_id") * 13) % 101).alias("reviewed_at"))


def review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = decisions(known(spark, sf_dir).brief_issues)
    new = old.where("reviewed_at % 3 = 0").select("pair_id", "issue_id", F.lit("revised").alias("decision"), (F.col("reviewed_at") + 1000).alias("reviewed_at"))
    return store.upsert(old, new, ["pair_id", "issue_id"], "reviewed_at")


def bcp47_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit(" "), F.upper("lang"), F.lit("-"), F.when(F.col("doc_id") % 3 == 0, "LATN").when(F.col("doc_id") % 3 == 1, "gb").otherwise("X1"))
    return documents(spark, sf_dir).select("doc_id", tx.language_tag(messy).alias("tag"))


def builtin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = documents(spark, sf_dir).select(F.col("source").alias("name")).distinct()
    both = names.unionByName(names.select(F.concat(F.lit("translated_"), "name").alias("name")))
    return store.discover_pairs(both)


def profile_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 3 == 0, "draft").when(F.col("doc_id") % 3 == 1, "published").otherwise("archived")
    profiles = documents(spark, sf_dir).select(F.col("source").alias("profile_id"), F.col("doc_id").alias("version"), status.alias("status"))
    return store.set_status(profiles, {"profile_id": "src3"}, "published", ["draft"])


def legacy_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = documents(spark, sf_dir).select(F.concat_ws("-", "lang", F.col("doc_id") % 50).alias("import_key"), (F.col("doc_id") % 3 == 0).alias("old"))
    old = keyed.where("old").select("import_key", F.lit("old").alias("origin")).distinct()
    new = keyed.where("not old").select("import_key", F.lit("new").alias("origin"))
    return store.append_new(old, new, ["import_key"])


def language_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    file_id = F.concat(F.lit("f"), "doc_id")
    ending = F.when(F.col("doc_id") % 3 == 0, "-en.pdf").when(F.col("doc_id") % 3 == 1, "-zh.pdf").otherwise(".pdf")
    rows = docs.select(F.col("doc_id").alias("record_id"), file_id.alias("source_file_id"), F.when(F.col("doc_id") % 2 == 1, "fr").alias("source_language"))
    names = docs.select(file_id.alias("file_id"), F.concat(file_id, ending).alias("file_name"))
    return store.language_backfill(rows, names).select("record_id", "source_language")


def flow_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of each document's lines, taken as one flow."""
    spans = fixtures.source_spans(documents(spark, sf_dir)).where("type = 'text'")
    lines = spans.select("pair_id", F.col("page").alias("report_page"), F.col("i").alias("region_ord"), F.concat(F.lit("r"), "i").alias("region_id"), "x", "y", "width", "height", F.lit(500.0).alias("page_width"))
    found = detectors.flow_alignment(lines, Rules(Profile()), ["pair_id", "report_page"])
    return found.select("pair_id", "report_page", F.col("lines"), "first_region", "last_region", "alignment", *[F.floor(F.col(c) * 1_000_000 + 0.5).cast("long").alias(f"{c}_e6") for c in ("left", "right", "center")])


def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one row for each pair after the whole comparison."""
    return known(spark, sf_dir).documents.withColumn("score_milli", F.floor(F.col("score") * 1000 + 0.5).cast("long")).drop("score")


def issue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every issue of the known pairs tells, key by key."""
    return evidence.told(known(spark, sf_dir).typed_issues)


def found_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rasterized text, changed flows and terms tell, key by key."""
    kinds = ((solved(spark, sf_dir), "text_rasterized"), (flowing(spark, sf_dir), "text_alignment_changed"), (known(spark, sf_dir, glossary=glossary(spark)), "glossary_violation"))
    return reduce(DataFrame.unionByName, [evidence.told(c.typed_issues_of(t)).withColumn("type", F.lit(t)) for c, t in kinds])


def profile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comparison in which pairs name three profile versions: the default, a lenient one, one with other rules for a language pair."""
    b = blocks(spark, sf_dir)
    base = Profile()
    lenient = replace(base, profile_id="lenient", version=2, off=("font_grow", "overlap"), thresholds=base.thresholds | {"shifted_ratio": 0.13, "severely_shifted_ratio": 0.17}, bands=base.bands | {"font_shrink_bands": ((0.4, "low"), (0.2, "info"))})
    spoken = replace(base, profile_id="spoken", version=3, language_off={"latin-cjk": ("number_mismatch",)}, high_forces_review=False, caps=base.caps | {"font_shrink": 4.0})
    named = F.when(F.col("pair_id") % 3 == 0, base.reference).when(F.col("pair_id") % 3 == 1, lenient.reference).otherwise(spoken.reference)
    rules = by_pair(fixtures.pages(b).select("pair_id").distinct().withColumn("reference", named), profile_table(spark, [base, lenient, spoken]))
    found = compare(fixtures.pages(b), b, rules, split=False, paired=fixtures.true_pages(b), matched=fixtures.true_matches(b))
    per_page = found.typed_issues.groupBy("pair_id", "report_page", *[F.when(F.col("detector") != "page", "pair").when(F.col("type") == "page_missing", "missing").otherwise("extra").alias("kind")]).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "issue_id", "type", "severity"))), ",").alias("issues"))
    return found.page_results.join(per_page, ["pair_id", "report_page", "kind"], "left")


#: a comparison's record, its report and the glossary it was made with
RECORD_TABLES = {"records": (["record_id"], "record_id long, status string, source_file_id string"), "reports": (["record_id"], "record_id long, score_milli long, pages long"), "links": (["record_id"], "record_id long, glossary string")}


def record_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with reports and glossary links after commits, a repeated commit and one that broke off."""
    docs = documents(spark, sf_dir).where("text is not null").select("doc_id", F.sha2("text", 256).alias("file_id"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))
    book = ledger.Ledger(spark, f"{shared_folder(spark)}/records-{uuid.uuid4().hex}", RECORD_TABLES, buckets=8)

    def rows(which: str, status: str, add: int) -> dict[str, DataFrame]:
        own = docs.where(which)
        return {
            "records": own.select(F.col("doc_id").alias("record_id"), F.lit(status).alias("status"), F.col("file_id").alias("source_file_id")),
            "reports": own.select(F.col("doc_id").alias("record_id"), ((F.col("doc_id") * 37) % 1000 + add).alias("score_milli"), F.col("lines").alias("pages")),
            "links": own.where("doc_id % 4 = 0").select(F.col("doc_id").alias("record_id"), F.concat(F.lit("g"), F.col("doc_id") % 5, F.lit(f"@{add}")).alias("glossary")),
        }

    book.write("first", rows("doc_id % 2 = 0", "new", 0))
    book.write("second", rows("doc_id % 3 = 0", "again", 1000))
    book.write("second", rows("doc_id % 5 = 0", "never", 5000))
    book.append("records", "third", "broken", rows("doc_id % 7 = 0", "half", 9000)["records"])
    book.write("fourth", {}, {name: docs.where("doc_id % 11 = 0").select(F.col("doc_id").alias("record_id")) for name in RECORD_TABLES})
    return book.read("records").join(book.read("reports"), "record_id", "full").join(book.read("links"), "record_id", "full")


def issue_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(known(spark, sf_dir, glossary=glossary(spark)).issues_of("glossary_violation"))


def match_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = solved(spark, sf_dir).matches
    return rows.select("pair_id", "report_page", "s_region_id", "t_region_id", F.round(F.col("type") * 100).cast("int").alias("type_pct"), *[_e6(c).alias(f"{c}_e6") for c in ("position", "size")])


def page_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = known(spark, sf_dir)
    return pages.similarity(c.regions, c.pages, c.rules).select("pair_id", "s_page", "t_page", _e6("similarity").alias("similarity_e6"))


def nested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nested reports hold, told by their shape: pages, issues, the issues' order."""
    rows = reports(known(spark, sf_dir), Profile())
    ids = F.transform(F.flatten(F.transform(F.filter("pages", lambda p: p["issues"].isNotNull()), lambda p: p["issues"])), lambda i: i["issue_id"])
    found = rows.withColumn("ids", ids)
    return found.select("pair_id", "status", "profile_reference", F.size("pages").cast("long").alias("pages"), F.sha2(F.array_join("ids", ","), 256).alias("issues_sha256"))


def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the order of the history list: newest first, ids break ties."""
    rows = records(spark, sf_dir).select("record_id", "source_file_id", "target_file_id", "status", "score_milli", "created_at")
    return rows.orderBy(F.desc("created_at"), F.desc("record_id"))


def glossary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary versions after a save of some and the archiving of others."""
    rows = documents(spark, sf_dir).select(F.concat(F.lit("g"), F.col("doc_id") % 40).alias("glossary_id"), (F.col("doc_id") % 7).alias("version"), F.concat(F.lit("n"), F.col("doc_id") % 11).alias("name"), (F.col("doc_id") % 3).alias("part"), (F.col("doc_id") % 13).cast("long").alias("entry_count"))
    one = lambda k: rows.where(F.col("part") == k).groupBy("glossary_id", "version").agg(F.max("name").alias("name"), F.max("entry_count").alias("entry_count"))
    old = one(0).select("*", F.lit("active").alias("status"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"))
    saved = store.put_glossary(old, one(1), now=2)
    return store.archive_glossary(saved, one(2).where("version = 3").select("glossary_id", "version"), now=3)


def sample_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples after some new ones: taken names and equal files are refused."""
    all_ = samples(spark, sf_dir).withColumn("origin", F.when(F.col("sample_id") % 10 == 0, "builtin").otherwise("user"))
    old, new = all_.where("sample_id % 3 = 0"), all_.where("sample_id % 3 = 1")
    archived = store.archive_samples(store.add_sample(old, new), all_.where("sample_id % 5 = 0").select("sample_id"))
    return archived.select("sample_id", "name", "status", "origin")


def scripts_of_all_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main script and letters of texts put into one script after another, and into two at once."""
    k, n = F.col("doc_id"), len(SCRIPT_LETTERS)
    first = F.substring("text", 1, 200)
    put = lambda which: F.element_at(F.array(*[F.translate(first, fixtures.LATIN, letters) for letters in SCRIPT_LETTERS.values()]), which.cast("int") + 1)
    mixed = F.when(k % 4 == 3, F.concat(put(k % n), F.lit(" "), put((k + 1) % n))).otherwise(put(k % n))
    rows = documents(spark, sf_dir).where("text is not null").select("doc_id", mixed.alias("t"))
    return rows.select("doc_id", tx.main_script(F.col("t")).alias("script"), tx.letters(F.col("t")).cast("long").alias("letters"))


#: letters that stand for a to z, for each script
SCRIPT_LETTERS = {name: "".join(chr(start + k) for k in range(26)) for name, start in (("latin", 0x61), ("cjk", 0x4E00), ("arabic", 0x0620), ("hebrew", 0x05D0), ("cyrillic", 0x0430), ("greek", 0x03B1), ("devanagari", 0x0905), ("bengali", 0x0985), ("thai", 0x0E01), ("hangul", 0xAC00), ("kana", 0x3041))}


def demo_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 3 == 0, "draft").when(F.col("doc_id") % 3 == 1, "published").otherwise("archived")
    return documents(spark, sf_dir).select(F.col("source").alias("profile_id"), F.col("doc_id").alias("version"), status.alias("status"), F.when(F.col("doc_id") % 2 == 0, "builtin").otherwise("user").alias("origin"))


def issue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of one report page, by type and review."""
    i = known(spark, sf_dir).brief_issues
    return store.filter_issues(i, decisions(i), types=["region_shifted", "font_shrink", "added_element"], review="pending", page=1).select("pair_id", "report_page", "issue_id", "type")


def history_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records found by a part of a name through the index of trigrams."""
    rows, path = records(spark, sf_dir), f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    names.write_index(rows, path)
    return names.search(rows, path, "oC7").select("record_id", "status")


def evict_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the records' events once all but the newest records are evicted."""
    events = documents(spark, sf_dir).select((F.col("doc_id") % 700).alias("record_id"), F.col("doc_id").alias("event_id"))
    return store.children(events, store.newest(records(spark, sf_dir), 100))


def profile_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of partly filled profiles, one for each document, after the defaults were merged in."""
    k = F.col("doc_id")
    part = F.to_json(F.struct(F.when(k % 2 == 0, (k % 7) / 10).alias("minimum_score"), F.when(k % 3 == 0, F.struct((k % 5 + 1.0).alias("font_shrink"))).alias("caps")))
    rows = documents(spark, sf_dir).select("doc_id", part.alias("given"))
    base = F.from_json(F.lit(Profile().to_json()), "minimum_score double, fail_score double, caps map<string,double>")
    given = F.from_json("given", "minimum_score double, caps map<string,double>")
    caps = F.map_concat(F.map_filter(base["caps"], lambda c, v: ~F.map_contains_key(F.coalesce(given["caps"], F.create_map().cast("map<string,double>")), c)), F.coalesce(given["caps"], F.create_map().cast("map<string,double>")))
    merged = rows.select("doc_id", F.coalesce(given["minimum_score"], base["minimum_score"]).alias("minimum_score"), base["fail_score"].alias("fail_score"), caps.alias("caps"))
    return merged.select("doc_id", F.round(F.col("minimum_score") * 10).cast("long").alias("minimum_tenths"), F.col("fail_score").cast("long").alias("fail_score"), F.col("caps")["font_shrink"].cast("long").alias("font_cap"), F.col("caps")["region_shifted"].cast("long").alias("shift_cap"), F.size("caps").cast("long").alias("n_caps"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded contents up to a size, each once; every third document isn't a PDF."""
    head = F.when(F.col("doc_id") % 3 == 0, "<!-- ").otherwise("%PDF-")
    files = documents(spark, sf_dir).where("text is not null").select(F.concat(F.lit("f"), "doc_id").alias("path"), F.concat(head, "text").cast("binary").alias("content"))
    return scan.uploads(files.withColumn("length", F.length("content").cast("long")), max_bytes=2000).select("sha256", "length")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "document_report": document_report,
    "spans_source": _spans(fixtures.source_spans),
    "spans_target": _spans(fixtures.target_spans),
    "page_background": lambda s, d: fixtures.pages(blocks(s, d)).select("pair_id", "side", "page", "width", "height", "background_color", F.size("dark_boxes").cast("long").alias("dark_boxes")),
    "page_median_font": lambda s, d: grouping.page_median_font(blocks(s, d)),
    "regions_fastpath": lambda s, d: known(s, d).regions.select("pair_id", "side", "page", "region_id", "type", "x", "y", "width", "height", "font_size", "text", "region_ord"),
    "regions_components": lambda s, d: solved(s, d).regions.select("pair_id", "side", "page", "region_id", "type", "x", "y", "width", "height", "text", "region_ord"),
    "region_neighbors": lambda s, d: known(s, d).regions_once.select("pair_id", "side", "page", "region_id", "above", "below"),
    "region_styles": lambda s, d: known(s, d).regions.select("pair_id", "side", "page", "region_id", "opacity", F.size("colors").alias("n_colors"), F.get("colors", F.lit(0)).alias("first_color")),
    "integrity_violations": integrity_violations,
    "page_pairs_identity": lambda s, d: pages.identity(fixtures.pages(blocks(s, d))),
    "page_entries": lambda s, d: known(s, d).entries.select("pair_id", "s_page", "t_page", "report_page", "kind"),
    "page_similarity": page_similarity,
    "page_alignment": lambda s, d: solved(s, d).entries,
    "score_matrix": score_matrix,
    "match_full": match_full,
    "unmatched_regions": unmatched_regions,
    "structured_diff": structured_diff,
    "layout_analog": lambda s, d: (lambda c: detectors.layout_analogs(c.source, c.target, c.rules))(known(s, d)).select("pair_id", "report_page", "t_region_ord", "a_region_ord"),
    "overlap_pairs": lambda s, d: (lambda c: detectors.overlap_pairs(c.target, c.rules))(known(s, d)).select("pair_id", "report_page", F.col("t_region_id").alias("first_region"), F.col("o_region_id").alias("second_region"), _e6("ratio").alias("ratio_e6"), "with_image"),
    "covered_text": covered_text,
    "issue_page_missing": _page_issue("page_missing"),
    "issue_extra_page": _page_issue("added_element"),
    "issue_missing": _issue("missing_image", "missing_element"),
    "issue_added": _issue("added_element"),
    "issue_shift": _issue("region_shifted"),
    "issue_font_shrink": _issue("font_shrink"),
    "issue_font_grow": _issue("typography_changed"),
    "issue_resized": _issue("region_resized"),
    "issue_fragmented": _issue("text_fragmented"),
    "issue_invisible": _issue("invisible_text"),
    "issue_out_of_page": _issue("content_out_of_page"),
    "issue_overlap": _issue("text_overlap"),
    "issue_text_image": _issue("text_image_overlap"),
    "issue_vectorized": _issue("text_vectorized"),
    "issue_numbers": _issue("number_mismatch"),
    "issue_untranslated": _issue("untranslated_text"),
    "issue_glossary": issue_glossary,
    "match_tangled": lambda s, d: tangled(s, d).matches.select("pair_id", "report_page", "s_region_id", "t_region_id"),
    "claims_shared": lambda s, d: _plain(sharing(s, d).issues_of("text_rasterized")),
    "alignment_columns": lambda s, d: _plain(columns(s, d).issues_of("text_alignment_changed")),
    "alignment_gaps": lambda s, d: gapped(s, d).entries,
    "profile_versions": profile_versions,
    "record_commits": record_commits,
    "issue_metrics": issue_metrics,
    "found_metrics": found_metrics,
    "issue_rasterized": lambda s, d: _plain(solved(s, d).issues_of("text_rasterized")),
    "issue_alignment": lambda s, d: _plain(flowing(s, d).issues_of("text_alignment_changed")),
    "dominant_script": dominant_script,
    "page_score": lambda s, d: known(s, d).page_results,
    "document_score": lambda s, d: known(s, d).documents.select("pair_id", "status", "page_count", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli")),
    "severity_counts": lambda s, d: scoring.severity_counts(known(s, d).brief_issues),
    "status_counts": lambda s, d: known(s, d).page_results.groupBy("status").agg(F.count("*").alias("pages")),
    "issue_types": lambda s, d: scoring.type_counts(known(s, d).brief_issues),
    "problem_pages": lambda s, d: known(s, d).page_results.where("status <> 'pass'").select("pair_id", "report_page", "kind", "status"),
    "distinct_types": lambda s, d: known(s, d).brief_issues.select("type").distinct(),
    "stage_summary": stage_summary,
    "stage_contents": stage_contents,
    "bbox_groups": lambda s, d: scoring.box_groups(known(s, d).brief_issues),
    "top_issues": lambda s, d: store.top_issues(known(s, d).brief_issues, 10).select("pair_id", "place", "report_page", "issue_id", "type", "severity"),
    "nested_reports": nested_reports,
    "issue_filter_review": lambda s, d: (lambda i: store.filter_issues(i, decisions(i), severities=["critical", "high"]).select("pair_id", "issue_id", "severity", "review"))(known(s, d).brief_issues),
    "related_issues": lambda s, d: store.related_issues(known(s, d).brief_issues),
    "ui_rollup": lambda s, d: (lambda i: scoring.rollup(i, decisions(i)))(known(s, d).brief_issues),
    "stored_files": lambda s, d: store.files(documents(s, d).select("doc_id", "text")).select("file_id", "first_doc"),
    "history_list": history_list,
    "history_page": lambda s, d: store.page_of(records(s, d), [F.desc("created_at"), F.desc("record_id")], 3, 8).select("record_id"),
    "glossary_upsert": glossary_upsert,
    "sample_create": sample_create,
    "schema_descriptions": lambda s, d: store.schema_descriptions({"files": store.files(documents(s, d).select("doc_id", "text")), "records": records(s, d), "samples": samples(s, d), "documents": documents(s, d)}),
    "main_scripts": scripts_of_all_classes,
    "issue_filters": issue_filters,
    "evict_cascade": evict_cascade,
    "profile_defaults": profile_defaults,
    "uploads": uploads,
    "profiles_selectable": lambda s, d: store.selectable_profiles(demo_profiles(s, d)),
    "glossary_by_reference": lambda s, d: store.glossary_by_reference(documents(s, d).select(F.concat(F.lit("g"), F.col("doc_id") % 40).alias("glossary_id"), (F.col("doc_id") % 7).alias("version"), "doc_id"), "g3@2").select("doc_id"),
    "valid_ids": lambda s, d: store.valid_ids(documents(s, d).select("doc_id", F.concat("source", F.when(F.col("doc_id") % 4 == 0, "/").when(F.col("doc_id") % 4 == 1, "é_").when(F.col("doc_id") % 4 == 2, " ").otherwise("-x")).alias("id")), "id"),
    "flow_suppression": lambda s, d: _plain(flowing(s, d).issues_of("region_shifted")),
    "scan_blocks": lambda s, d: scan.blocks(fixtures.layouts(documents(s, d))).select("pair_id", "block_ord", "block_id", "type", "x", "y", "width", "height", "font_size", "color", "text", "source_block_index", F.round(F.col("opacity") * 1000).cast("long").alias("opacity_milli"), "weight", "italic", "font_family", "source_line_index", "source_span_index", *scan.IMAGE),
    "scan_pages": lambda s, d: scan.pages(fixtures.layouts(documents(s, d))).select("pair_id", "background_color", F.size("dark_boxes").cast("long").alias("dark_boxes"), F.aggregate("dark_boxes", F.lit(0.0), lambda acc, b: acc + b["width"] * b["height"]).cast("long").alias("dark_area")),
    "history_search": lambda s, d: store.search_records(compared_records(s, d), "fail", "7").select("record_id", "status"),
    "history_search_index": history_search_index,
    "history_evict": lambda s, d: store.newest(records(s, d), 100).select("record_id"),
    "sample_autolink": lambda s, d: store.autolink(records(s, d), samples(s, d)),
    "samples_active": lambda s, d: store.active_samples(samples(s, d)).select("sample_id", "name"),
    "sample_unique_name": lambda s, d: store.clashing_names(samples(s, d)),
    "review_upsert": review_upsert,
    "next_version": lambda s, d: store.next_version(documents(s, d).select(F.col("lang").alias("family"), (F.col("doc_id") % 97).alias("version"))),
    "number_tokens": lambda s, d: documents(s, d).select("doc_id", F.explode(tx.numbers(F.col("text"))).alias("number")),
    "digit_normalize": lambda s, d: documents(s, d).where("text is not null").select("doc_id", F.sha2(tx.normalized_digits(F.col("text")), 256).alias("digest")),
    "bcp47_normalize": bcp47_normalize,
    "builtin_pairs": builtin_pairs,
    "band_severity": lambda s, d: documents(s, d).select("doc_id", *[Profile().band(b, (F.col("doc_id") % 100) / m).alias(b) for b, m in (("number_mismatch_bands", 10), ("font_shrink_bands", 100), ("untranslated_bands", 100), ("region_resize_bands", 100))]),
    "profile_publish": profile_publish,
    "legacy_import": legacy_import,
    "language_backfill": language_backfill,
    "flow_inference": flow_inference,
}
