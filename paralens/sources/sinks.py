"""Reports out: nested JSON, a flat issue sheet, an HTML page of what needs a look, stage artifacts."""

from __future__ import annotations

import html
import os
import tempfile

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.compare import STAGES, Comparison, contents, reports
from ..plans.profile import Profile


def write_json(found: Comparison, profile: Profile, path: str) -> None:
    """One JSON line for each pair's nested report."""
    reports(found, profile).write.mode("overwrite").json(path)


def issue_sheet(issues: DataFrame) -> DataFrame:
    """The sheet's 13 columns for each issue, coordinates with one digit."""
    return issues.select(
        "pair_id",
        "report_page",
        "issue_id",
        "type",
        "severity",
        "source_region",
        "target_region",
        *[F.round(c, 1).alias(c) for c in ("x", "y", "width", "height")],
        "detector",
        "metrics",
    )


def write_sheet(found: Comparison, path: str) -> None:
    """The sheet as CSV with a header, and the summary beside it."""
    issue_sheet(found.issues).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/issues")
    found.documents.write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def pages_to_show(found: Comparison, scope: str = "issues") -> DataFrame:
    """(pair_id, report_page, kind): all report pages, or those that don't pass or have issues."""
    rows = found.page_results
    if scope == "issues":
        rows = rows.where("status <> 'pass' or issue_count > 0")
    return rows.select("pair_id", "report_page", "kind").distinct()


def html_report(found: Comparison, pair_id, path: str) -> None:
    """One pair's page: its verdict and the pages that need a look, all text escaped; written in one step."""
    head = found.documents.where(F.col("pair_id") == pair_id).first()
    shown = found.page_results.where((F.col("pair_id") == pair_id) & ((F.col("status") != "pass") | (F.col("issue_count") > 0))).orderBy("report_page", "kind").collect()
    issues = found.issues.where(F.col("pair_id") == pair_id).orderBy("report_page", "detector_ord", "row_ord", "issue_id").collect()
    parts = [f"<h1>{html.escape(str(pair_id))}: {html.escape(head['status'])}, {head['score']:.2f}</h1>"]
    for page in shown:
        parts.append(f"<h2>{page['report_page']} ({html.escape(page['kind'])}): {html.escape(page['status'])}, {page['score']:.1f}</h2><ul>")
        parts += [f"<li>{html.escape(i['severity'])} {html.escape(i['type'])} {html.escape(i['target_region'] or i['source_region'] or '')}</li>" for i in issues if i["report_page"] == page["report_page"]]
        parts.append("</ul>")
    write_text("<!doctype html><meta charset=utf-8>" + "".join(parts), path)


def write_text(text: str, path: str) -> None:
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w") as f:
        f.write(text)
    os.replace(name, path)


def write_stages(found: Comparison, folder: str, stop_after: str = "report") -> dict[str, dict]:
    """Each stage up to one: its contents as JSON lines under ``stage-<name>``, one line for each pair; returns the totals.

    The totals are observed while the contents are written, by no further job.
    """
    out = {}
    for name in STAGES[: STAGES.index(stop_after) + 1]:
        told, seen = contents(found, name), Observation(f"stage-{name}")
        observed = told.observe(seen, F.count(F.lit(1)).alias("pairs"), F.sum(F.size("data" if name in ("parse", "group", "match") else "pages")).alias("items")) if name in ("parse", "group", "match", "report") else told.observe(seen, F.count(F.lit(1)).alias("pairs"))
        observed.write.mode("overwrite").json(f"{folder}/stage-{name}")
        out[name] = seen.get
    return out
