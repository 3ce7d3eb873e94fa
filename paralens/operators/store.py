"""Queries and writes over the tables of files, samples, records, profiles and reviews.

Writes return the table after the write; the caller stores it.  Uniqueness and
status rules are checks over the rows, as a table format without keys needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def files(docs: DataFrame) -> DataFrame:
    """(file_id, text, first_doc): contents stored once, named by their digest."""
    return docs.where("text is not null").groupBy(F.sha2("text", 256).alias("file_id")).agg(F.min("text").alias("text"), F.min("doc_id").alias("first_doc"))


def _with_files(docs: DataFrame) -> DataFrame:
    own = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("source_file_id"))
    other = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source_file_id").alias("target_file_id"))
    return own.join(other, "doc_id")


def demo_records(docs: DataFrame) -> DataFrame:
    """Comparison records of neighbouring documents; verdict and score follow from the document's number."""
    k = F.col("doc_id")
    status = F.when(k % 4 == 0, "pass").when(k % 4 == 1, "review").otherwise("fail")
    return _with_files(docs).select(k.alias("record_id"), "source_file_id", "target_file_id", F.concat(F.lit("doc"), k).alias("source_name"), F.concat(F.lit("doc"), k + 1).alias("target_name"), status.alias("status"), ((k * 37) % 100_000).alias("score_milli"), ((k * 7919) % 10007).alias("created_at"))


def demo_samples(docs: DataFrame) -> DataFrame:
    """Samples of neighbouring documents."""
    rows = _with_files(docs)
    return rows.select(F.col("doc_id").alias("sample_id"), "source_file_id", "target_file_id", F.when(F.col("doc_id") % 3 == 0, "archived").otherwise("active").alias("status"), ((F.col("doc_id") * 31) % 1009).alias("updated_at"), F.concat(F.when(F.col("doc_id") % 4 == 0, "Sample ").otherwise("sample "), F.col("doc_id") % 500).alias("name"))


def newest(records: DataFrame, n: int) -> DataFrame:
    """The newest n records; the others are evicted, and their children with them (children())."""
    return records.orderBy(F.desc("created_at"), F.desc("record_id")).limit(n)


def children(rows: DataFrame, records: DataFrame) -> DataFrame:
    """The rows whose record is still there."""
    return rows.join(records.select("record_id"), "record_id", "left_semi")


def valid_ids(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose id has letters, digits, hyphens and underscores only; a null id has none of these and goes."""
    return rows.where(F.col(column).rlike(r"^[\p{L}\p{N}_-]*\z"))


def search_records(records: DataFrame, status: str | None = None, part: str = "") -> DataFrame:
    """Records of a status whose source or target name holds a part, whatever its case."""
    rows = records if status is None else records.where(F.col("status") == status)
    return rows.where(F.contains(F.lower("source_name"), F.lit(part.lower())) | F.contains(F.lower("target_name"), F.lit(part.lower())))


def autolink(records: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_id, sample_id): the newest active sample with the record's two files."""
    active = samples.where("status = 'active'").select("sample_id", "updated_at", "source_file_id", "target_file_id")
    found = records.join(active, ["source_file_id", "target_file_id"])
    return found.groupBy("record_id").agg(F.max_by("sample_id", F.struct("updated_at", "sample_id")).alias("sample_id"))


def active_samples(samples: DataFrame, archived: bool = False) -> DataFrame:
    rows = samples if archived else samples.where("status = 'active'")
    return rows.orderBy(F.desc("updated_at"), "name")


def clashing_names(samples: DataFrame) -> DataFrame:
    """Names that more than one sample has, whatever their case."""
    return samples.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def add_sample(samples: DataFrame, new: DataFrame) -> DataFrame:
    """The samples with the new ones whose names are free and whose two files differ."""
    known = samples.select(F.lower("name").alias("_name"))
    fit = new.where("source_file_id <> target_file_id").join(known, F.lower("name") == F.col("_name"), "left_anti")
    once = fit.withColumn("_nth", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("sample_id"))).where("_nth = 1").drop("_nth")
    return samples.unionByName(once)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: the one with the highest version, a new one before an old one of equal version."""
    both = table.withColumn("_fresh", F.lit(0)).unionByName(new.withColumn("_fresh", F.lit(1)))
    ranked = both.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_fresh"))))
    return ranked.where("_nth = 1").drop("_nth", "_fresh")


def append_new(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the new rows whose keys it lacks (insert or ignore); also a one-time import."""
    return table.unionByName(new.dropDuplicates(keys).join(table, keys, "left_anti").select(table.columns))


def put_profile(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """Profile versions: a draft may be overwritten, a published or archived version may not."""
    keys = ["profile_id", "version"]
    fixed = profiles.where("status <> 'draft'")
    allowed = new.join(fixed, keys, "left_anti")
    return profiles.join(allowed, keys, "left_anti").unionByName(allowed)


def set_status(table: DataFrame, keys: dict, status: str, allowed_from: list[str]) -> DataFrame:
    """The table with one row's status changed, if it may change from what it is."""
    hit = F.lit(True)
    for k, v in keys.items():
        hit = hit & (F.col(k) == v)
    return table.withColumn("status", F.when(hit & F.col("status").isin(*allowed_from), status).otherwise(F.col("status")))


def next_version(versions: DataFrame) -> DataFrame:
    """(family, version): one more than the highest version of each family."""
    return versions.groupBy("family").agg((F.max("version") + 1).alias("version"))


def selectable_profiles(profiles: DataFrame) -> DataFrame:
    """Published versions, and what isn't archived unless it is built in."""
    return profiles.where("status = 'published' or (status <> 'archived' and origin <> 'builtin')")


def glossary_by_reference(glossaries: DataFrame, reference: str) -> DataFrame:
    """The entries of ``id@version``."""
    name, _, version = reference.rpartition("@")
    return glossaries.where((F.col("glossary_id") == name) & (F.col("version") == int(version)))


def language_backfill(records: DataFrame, names: DataFrame) -> DataFrame:
    """Records without a source language whose source file's name ends in ``-en.*`` get ``en``, ``-zh.*`` ``zh``."""
    tag = F.regexp_extract("file_name", r"-(en|zh)\.[^.]*$", 1)
    found = names.select(F.col("file_id").alias("source_file_id"), tag.alias("tag")).where("tag <> ''").groupBy("source_file_id").agg(F.min("tag").alias("tag"))
    return records.join(found, "source_file_id", "left").withColumn("source_language", F.coalesce("source_language", "tag")).drop("tag")


def discover_pairs(names: DataFrame) -> DataFrame:
    """(source_name, target_name): ``X`` with ``translated_X``, and ``*-en.*`` with ``*-zh.*``."""
    plain = names.select(F.col("name").alias("source_name"))
    translated = names.where(F.col("name").startswith("translated_")).select(F.col("name").alias("target_name"), F.regexp_replace("name", "^translated_", "").alias("source_name"))
    chinese = names.where(F.col("name").rlike(r"-zh\.[^.]*$")).select(F.col("name").alias("target_name"), F.regexp_replace("name", r"-zh(\.[^.]*)$", "-en$1").alias("source_name"))
    return plain.join(translated.unionByName(chinese), "source_name").select("source_name", "target_name").distinct()


def filter_issues(issues: DataFrame, decisions: DataFrame, severities: list[str] | None = None, types: list[str] | None = None, review: str | None = None, page: int | None = None) -> DataFrame:
    """Issues with ``review`` (done or pending), by severity, type, review and page."""
    done = decisions.select("pair_id", "issue_id").distinct().withColumn("review", F.lit("done"))
    rows = issues.join(done, ["pair_id", "issue_id"], "left").withColumn("review", F.coalesce("review", F.lit("pending")))
    for column, wanted in (("severity", severities), ("type", types), ("review", review and [review]), ("report_page", page is not None and [page])):
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    return rows


def related_issues(issues: DataFrame) -> DataFrame:
    """(pair_id, report_page, issue_id, related): how many other issues name the same two regions."""
    none = "\x00"
    kind = F.when(F.col("detector") != "page", "pair").otherwise(F.col("type"))
    keys = issues.select("pair_id", "report_page", "issue_id", kind.alias("kind"), *[F.coalesce(c, F.lit(none)).alias(c) for c in ("source_region", "target_region")])
    same = Window.partitionBy("pair_id", "report_page", "kind", "source_region", "target_region")
    return keys.withColumn("related", F.count("*").over(same) - 1).where("related > 0").select("pair_id", "report_page", "issue_id", "related")


def top_issues(issues: DataFrame, n: int) -> DataFrame:
    """The first n issues of each pair in report order."""
    order = Window.partitionBy("pair_id").orderBy("report_page", "detector_ord", "row_ord", "issue_id")
    return issues.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def page_of(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a list with ``size`` rows a page."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def put_glossary(versions: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Glossary versions with new ones; one that is there is overwritten but keeps its status and creation time."""
    keys = ["glossary_id", "version"]
    kept = versions.select(*keys, F.col("status").alias("_status"), F.col("created_at").alias("_created"))
    fresh = new.join(kept, keys, "left").withColumns({"status": F.coalesce("_status", F.lit("active")), "created_at": F.coalesce("_created", F.lit(now).cast("long")), "updated_at": F.lit(now).cast("long")}).drop("_status", "_created")
    return versions.join(new.select(*keys), keys, "left_anti").unionByName(fresh)


def archive_glossary(versions: DataFrame, which: DataFrame, now: int) -> DataFrame:
    """The active ones of the named versions are archived; references to them still load."""
    keys = ["glossary_id", "version"]
    marked = versions.join(which.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "active")
    return marked.withColumns({"updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at")), "status": F.when(hit, "archived").otherwise(F.col("status"))}).drop("_hit")


def archive_samples(samples: DataFrame, which: DataFrame) -> DataFrame:
    """The named samples are archived, but for built-in ones, which are read-only."""
    marked = samples.join(which.select("sample_id").distinct().withColumn("_hit", F.lit(True)), "sample_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("origin") != "builtin")
    return marked.withColumn("status", F.when(hit, "archived").otherwise(F.col("status"))).drop("_hit")


#: what the tables of the store hold
DESCRIPTIONS = {
    "files": {"file_id": "digest of the content", "text": "content", "first_doc": "smallest document with the content"},
    "records": {"record_id": "comparison", "source_file_id": "source content", "target_file_id": "target content", "status": "verdict", "score_milli": "score in thousandths", "created_at": "place in time"},
    "samples": {"sample_id": "sample", "source_file_id": "source content", "target_file_id": "target content", "status": "active or archived", "updated_at": "last change", "name": "unique whatever its case"},
    "decisions": {"pair_id": "comparison", "issue_id": "issue", "decision": "what the reviewer says", "reviewed_at": "place in time"},
    "profiles": {"profile_id": "profile family", "version": "version", "status": "draft, published or archived"},
    "glossaries": {"glossary_id": "glossary family", "version": "version", "name": "name", "entry_count": "number of terms", "status": "active or archived", "created_at": "first save", "updated_at": "last change"},
}


def schema_descriptions(tables: dict[str, DataFrame]) -> DataFrame:
    """The data dictionary of the given tables: (table_name, column_name, data_type, description), null where nothing is told of a column."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, kind, DESCRIPTIONS.get(t, {}).get(c)) for t, df in tables.items() for c, kind in df.dtypes]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, description string").orderBy("table_name", "column_name")
