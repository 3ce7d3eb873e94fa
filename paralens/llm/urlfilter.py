"""URL filter: rules, and link-graph propagation for what no rule names.

A rule ``host/path`` fits a url if its host is the rule's or a subdomain of it and
its path starts with the rule's; the longest rule that fits decides.  Every other url
is judged by its host.  Hosts whose pages rules allow are trusted seeds, hosts whose
pages rules block are distrusted seeds, each with the share of its pages
(n / (pages + 1)).  Trust follows the links between hosts, distrust goes against
them; both are personalised PageRanks in the scaled form

    x(v) = seed(v) + damping * sum over u of x(u) * weight(u, v) / out(u)

with distrust on the reversed edges.  Each host has a threshold of its own: it is
blocked if its distrust is at least ``floor`` (of the distrust of a host all of whose
pages are blocked) and exceeds its trust by more than the share ``threshold`` of both.
After ``steps`` steps a rank lacks what walks of more steps add, at most
damping ** (steps + 1) / (1 - damping) of the largest seed.

Ranks are whole billionths, so sums don't depend on their order.  Edges are one row
for each pair of hosts, counted before they move; a host with many pages or links is
pre-aggregated, and a large side of a join stays splittable.

Null urls and urls without ``://`` have an empty host and path, no rule, and are
allowed.  Repeated pages keep their rows (and count in their host's share); null html
has no links.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DAMPING, STEPS, THRESHOLD, FLOOR, UNIT = 0.85, 12, 0.5, 0.1, 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the host of a link to a host, in group 1
LINK = r"""<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*["']?\s*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The url's host (A-Z lower-cased) and path; both empty without ``://``."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.  Rules are (``host/path``, verdict) literals of the plan."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _spread(seeds: DataFrame, edges: DataFrame, damping: float, steps: int) -> DataFrame:
    """(host, x) after ``steps`` steps along the edges (a, b, weight)."""
    out = edges.groupBy("a").agg(F.sum("weight").alias("out"))
    shares = cut(edges.join(out, "a").select("a", "b", "weight", "out"))
    now = seeds
    for _ in range(steps):
        moved = now.join(shares, now["host"] == shares["a"]).select(F.col("b").alias("host"), F.floor(F.col("x") * F.lit(damping) * F.col("weight") / F.col("out")).cast("long").alias("x"))
        now = cut(seeds.unionByName(moved).groupBy("host").agg(F.sum("x").alias("x")).where("x > 0"))
    return now


def host_edges(pages: DataFrame) -> DataFrame:
    """(a, b, weight): links between different hosts, from (host, html)."""
    links = pages.where("html is not null and host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("b"))
    links = links.select(F.col("host").alias("a"), F.translate("b", UPPER, LOWER).alias("b")).where("a <> b")
    return links.groupBy("a", "b").agg(F.count("*").alias("weight"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html", damping: float = DAMPING, steps: int = STEPS, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page."""
    host, path = host_and_path(pages[url].cast("string"))
    rows = pages.select(pages[key].alias("id"), host.alias("host"), path.alias("path"), pages[html].cast("string").alias("html"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    named = rows.select("id", "host", "path", rule.alias("rule"), says.alias("says"))
    edges = cut(host_edges(rows.select("host", "html")))
    per_host = named.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("says") == v, 1)).alias(v) for v in ("allow", "block")])
    seeds = cut(per_host.select("host", *[F.floor(F.col(v) * F.lit(UNIT) / (F.col("n") + 1)).cast("long").alias(v) for v in ("allow", "block")]))
    trust, distrust = (seeds.select("host", F.col(v).alias("x")).where("x > 0") for v in ("allow", "block"))
    if edges.limit(1).count():
        trust = _spread(trust, edges, damping, steps)
        distrust = _spread(distrust, edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"), damping, steps)
    scores = trust.select("host", F.col("x").alias("trust"), F.lit(0).cast("long").alias("distrust")).unionByName(distrust.select("host", F.lit(0).cast("long").alias("trust"), F.col("x").alias("distrust")))
    scores = cut(scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    found = named.join(scores, "host", "left")
    trust_, distrust_ = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    bad = (distrust_ >= int(floor * UNIT)) & (1000 * (distrust_ - trust_) > int(1000 * threshold) * (distrust_ + trust_))
    verdict = F.coalesce("says", F.when(bad, "block").otherwise("allow"))
    return found.select("id", "host", "path", "rule", verdict.alias("verdict"), trust_.alias("trust"), distrust_.alias("distrust"))


def sql(rules: list[tuple[str, str]], damping: float = DAMPING, steps: int = STEPS, threshold: float = THRESHOLD, floor: float = FLOOR) -> str:
    """The same as SQL over the view ``pages``, one common table for each step."""
    link = LINK.replace("'", "''")
    fits = []
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits.append((f"(host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '{slash}{rest}')", rule, says))
    rule = "case " + " ".join(f"when {f} then '{r}'" for f, r, _ in fits) + " else null end"
    says = "case " + " ".join(f"when {f} then '{s}'" for f, _, s in fits) + " else null end"
    parts = [
        "rest as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages)",
        f"rows_ as (select page_id, html, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) as path from rest)",
        f"named as (select page_id, host, path, {rule} as rule, {says} as says from rows_)",
        f"links as (select host as a, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') as b from rows_ where html is not null and host <> '')",
        "edges as (select a, b, count(*) as weight from links where a <> b group by a, b)",
        f"seeds as (select host, cast(floor(count(*) filter (where says = 'allow') * {UNIT} / (count(*) + 1)) as bigint) as allow, cast(floor(count(*) filter (where says = 'block') * {UNIT} / (count(*) + 1)) as bigint) as block from named where host <> '' group by host)",
    ]
    for side, a, b in (("allow", "a", "b"), ("block", "b", "a")):
        parts.append(f"share_{side} as (select {a} as a, {b} as b, weight, sum(weight) over (partition by {a}) as out_ from edges)")
        parts.append(f"{side}_0 as (select host, {side} as x from seeds where {side} > 0)")
        for k in range(steps):
            moved = f"select b as host, cast(floor(cast(x as double) * {damping} * weight / out_) as bigint) as x from {side}_{k} join share_{side} on host = a"
            parts.append(f"{side}_{k + 1} as (select host, cast(sum(x) as bigint) as x from (select * from {side}_0 union all {moved}) group by host having sum(x) > 0)")
    scores = f"scores as (select host, cast(sum(t) as bigint) as trust, cast(sum(d) as bigint) as distrust from (select host, x as t, 0 as d from allow_{steps} union all select host, 0, x from block_{steps}) group by host)"
    d, t = "coalesce(distrust, 0)", "coalesce(trust, 0)"
    bad = f"{d} >= {int(floor * UNIT)} and 1000 * ({d} - {t}) > {int(1000 * threshold)} * ({d} + {t})"
    body = f"select page_id, named.host, path, rule, coalesce(says, case when {bad} then 'block' else 'allow' end) as verdict, coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust from named left join scores on named.host = scores.host"
    return f"with {', '.join([*parts, scores])} {body}"
