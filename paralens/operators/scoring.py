"""Scores and verdicts of pages and documents, counts and rollups of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.profile import SEVERITIES, Profile
from ..plans.rules import Rules

PAGE = ["pair_id", "report_page", "kind"]
STATUSES = ("pass", "review", "fail")


def page_results(entries: DataFrame, issues: DataFrame, rules: Rules | Profile) -> DataFrame:
    """(pair_id, report_page, kind, issue_count, score, status) of every report entry.

    Deductions add up by issue type up to the type's cap.  Issues belong to the entry
    of their kind, as a page number can stand for a pair and an extra page at once.
    """
    kind = F.when(F.col("detector") != "page", "pair").when(F.col("type") == "page_missing", "missing").otherwise("extra")
    marked = issues.withColumn("kind", kind)
    rules = Rules(rules) if isinstance(rules, Profile) else rules
    counted = marked.groupBy(*PAGE, "type", "severity").agg(F.count("*").alias("n"))
    rows = entries.select(*PAGE, *(["rules"] if rules.carried else [])).join(counted, PAGE, "left")
    carried = {"rules": F.first("rules")} if rules.carried else {}
    first = [v.alias(k) for k, v in carried.items()]
    off = F.coalesce(F.col("n"), F.lit(0)) * rules.points("deductions", "severity", 0.0)
    per_type = rows.withColumn("off", off).groupBy(*PAGE, "type").agg(F.sum("off").alias("off"), F.sum("n").alias("n"), *[F.max((F.col("severity") == s).cast("int")).alias(s) for s in ("critical", "high")], *first)
    capped = F.least("off", rules.points("caps", "type", 10.0))
    rows = per_type.withColumn("off", capped).groupBy(*PAGE).agg(F.sum("off").alias("off"), F.sum("n").alias("n"), F.max("critical").alias("critical"), F.max("high").alias("high"), *first).na.fill(0, ["off", "n", "critical", "high"])
    rows = rows.withColumn("score", F.greatest(F.lit(0.0), 100 - F.col("off")))
    failed = (F.col("score") < rules.value("fail_score")) | (rules.value("critical_forces_fail") & (F.col("critical") == 1))
    doubtful = (F.col("score") < rules.value("pass_score")) | (rules.value("high_forces_review") & (F.col("high") == 1))
    status = F.when(failed, "fail").when(doubtful, "review").otherwise("pass")
    return rows.select(*PAGE, F.col("n").alias("issue_count"), "score", status.alias("status"))


def document_results(pairs: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each pair: score (mean of its pages, 100 without), worst status, counts of pages and issues."""
    worst = F.when(F.max((F.col("status") == "fail").cast("int")) == 1, "fail").when(F.max((F.col("status") == "review").cast("int")) == 1, "review").otherwise("pass")
    per_pair = pages.groupBy("pair_id").agg(F.avg("score").alias("score"), worst.alias("status"), F.count("*").alias("page_count"), *[F.sum((F.col("status") == s).cast("long")).alias(f"{s}_pages") for s in STATUSES])
    counts = severity_counts(issues)
    rows = pairs.select("pair_id").distinct().join(per_pair, "pair_id", "left").join(counts, "pair_id", "left")
    zeros = ["page_count", *[f"{s}_pages" for s in STATUSES], *SEVERITIES, "issue_total"]
    return rows.na.fill(0, zeros).withColumns({"score": F.coalesce("score", F.lit(100.0)), "status": F.coalesce("status", F.lit("pass"))})


def severity_counts(issues: DataFrame) -> DataFrame:
    """(pair_id, info, low, medium, high, critical, issue_total)."""
    return issues.groupBy("pair_id").agg(*[F.sum((F.col("severity") == s).cast("long")).alias(s) for s in SEVERITIES], F.count("*").alias("issue_total"))


def type_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("pair_id", "type").agg(F.count("*").alias("n"))


def rollup(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """(pair_id, severe, general, reviewed, reviewed_percent): what an overview shows."""
    done = decisions.select("pair_id", "issue_id").distinct().withColumn("done", F.lit(1))
    rows = issues.join(done, ["pair_id", "issue_id"], "left")
    severe = F.col("severity").isin("critical", "high")
    counted = rows.groupBy("pair_id").agg(F.sum(severe.cast("long")).alias("severe"), F.sum((~severe).cast("long")).alias("general"), F.count("done").alias("reviewed"), F.count("*").alias("n"))
    return counted.select("pair_id", "severe", "general", "reviewed", F.floor(100 * F.col("reviewed") / F.col("n") + 0.5).cast("long").alias("reviewed_percent"))


def box_groups(issues: DataFrame) -> DataFrame:
    """Issues that share a box when its numbers are rounded half up."""
    rounded = {k: F.floor(F.col(k) + 0.5).cast("long").alias(k) for k in ("x", "y", "width", "height")}
    rows = issues.where("x is not null").select("pair_id", "page", *rounded.values(), "issue_id")
    return rows.groupBy("pair_id", "page", "x", "y", "width", "height").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("issue_id")), ",").alias("issue_ids"))
