"""Personal data by rules and by bootstrapped contexts, in DataFrame functions only.

Rules find e-mail addresses, IP addresses, card and phone numbers (``BASE``).  The
bootstrap then treats every identifier-like token (one with a digit or ``@``, and
whole phone or card numbers) as an instance, and what stands around it as lexical
patterns: the two words before it; the word before with the word after; the word
before with the token's opening marks and the kinds of characters it is made of.

    pattern score  = (confidence of its different instances) / (their number + 1),
                     0 unless at least ``support`` of them are confident
    instance score = 1 - product of (1 - score) over its different patterns

Seeds have confidence 1 for their kind: instances that the rules accept, and for the
kind ``secret``, of which there is no rule, long runs of hexadecimal digits (``KEY``).
In each round the pattern-instance graph is scored anew, and instances that reach
``confidence`` become seeds for the next, until a round changes nothing (at most
``rounds``).  Their mentions become spans of the kind unless they overlap a rule's
span; a run of hexadecimal digits is a secret only if patterns make it one.  Copies of
a passage count once, because instances and patterns are different ones.  All steps
are aggregates and joins over the mentions; nothing is collected.

Positions are code points, ends exclusive.  Null texts count as empty and have no
spans.  Rows of equal id and text share their spans; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed patterns of the kinds, in their order; possessive where that can't change a match.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
RULES, KINDS = list(BASE), [*BASE, "secret"]
#: seeds of the kind ``secret``
KEY = r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{32,}$"
MENTION = r"\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){13,}+|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
OPENING, CLOSING = r"^[\x22'(\[<]*+", r"[.,;:!?)\]>\x22']++$"
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
BLOCK = 256
ROUNDS, SUPPORT, CONFIDENCE = 20, 3, 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: every second one from the right doubled, digit sums divisible by 10."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\.", -1), lambda p: p.rlike(OCTET))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``starts``, where each match of ``found`` between the ``gaps`` starts: the lengths of all gaps and matches before it.

    Lengths are summed by block and blocks one after the other, so a text's work is proportional to its matches.
    """
    rows = rows.withColumn("steps", F.transform("found", lambda m, i: F.length(F.get("gaps", i)) + F.length(m)))
    blocks = F.sequence(F.lit(0), ((F.size("steps") - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice("steps", b * BLOCK + 1, BLOCK), F.lit(0), lambda acc, x: acc + x))

    def running(values: Column, base: Column) -> Column:
        first = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")), lambda acc: acc["out"])

    rows = rows.withColumn("sums", F.when(F.size("steps") > 0, running(sums, F.lit(0))))

    def block(b: Column) -> Column:
        ends = running(F.slice("steps", b * BLOCK + 1, BLOCK), F.coalesce(F.get("sums", b - 1), F.lit(0)))
        return F.transform(ends, lambda e, j: e - F.length(F.get("found", b * BLOCK + j)))

    return rows.withColumn("starts", F.when(F.size("steps") > 0, F.flatten(F.transform(blocks, block)))).drop("steps", "sums")


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the rules' spans (start, place of the kind, end), sorted."""
    hint = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for k, (kind, pattern) in enumerate(BASE.items()):
        some = hint.get(kind, F.col("text").rlike("[0-9]"))
        docs = docs.withColumn("found", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
        docs = docs.withColumn("gaps", F.when(F.size("found") > 0, F.split("text", pattern, -1)))
        docs = _with_starts(docs)
        spans = F.transform(F.filter(F.arrays_zip("starts", "found"), lambda s: _valid(kind, s["found"])), lambda s: F.struct(s["starts"].alias("start"), F.lit(k).alias("kind"), (s["starts"] + F.length(s["found"])).alias("end")))
        docs = docs.withColumn(f"of_{kind}", F.coalesce(spans, F.array()).cast(SPAN)).drop("found", "gaps", "starts")
    return docs.withColumn("base", F.sort_array(F.concat(*[f"of_{kind}" for kind in RULES]))).drop(*[f"of_{kind}" for kind in RULES])


def mentions(docs: DataFrame) -> DataFrame:
    """(id, h, start, end, instance, patterns, seed) of every identifier-like token of (id, h, text).

    ``seed`` is the place of the kind whose rule accepts the whole instance, or null.
    """
    rows = docs.where(F.col("text").rlike("[0-9@]"))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).where(F.size("found") > 0)
    rows = _with_starts(rows.withColumn("gaps", F.split("text", MENTION, -1)))
    near = F.transform("found", lambda m, i: F.struct(m.alias("m"), F.get("starts", i).alias("at"), F.get("gaps", i).alias("before"), F.get("gaps", i + 1).alias("after")))
    # of the gaps, which may be long, the neighbouring words only
    words = F.transform(near, lambda x: F.struct(x["m"].alias("m"), x["at"].alias("at"), F.regexp_extract(x["before"], r"(?:^|\s)(\S++)\s++\S++\s*+$", 1).alias("last2"), F.regexp_extract(x["before"], r"(?:^|\s)(\S++)\s*+$", 1).alias("last"), F.regexp_extract(x["after"], r"^\s*+(\S++)", 1).alias("following")))
    rows = rows.select("id", "h", F.explode(words).alias("x")).select("id", "h", "x.*")
    core = F.regexp_replace(F.regexp_replace("m", OPENING, ""), CLOSING, "")
    opening = F.regexp_extract("m", OPENING, 0)
    rows = rows.withColumns({"core": core, "opening": opening}).where("core <> ''")
    last2, last, following = (F.lower(c) for c in ("last2", "last", "following"))
    made_of = F.concat(*[F.when(F.col("core").rlike(p), name).otherwise("") for name, p in (("a", r"\p{L}"), ("9", "[0-9]"), ("@", "@"), (".", r"\."), ("-", r"[^\p{L}0-9@.]"))])
    patterns = F.filter(
        F.array(
            F.when((last != "") & (last2 != ""), F.concat_ws(" ", last2, last, F.lit("_"))),
            F.when((last != "") & (following != ""), F.concat_ws(" ", last, F.lit("_"), following)),
            F.when(last != "", F.concat_ws(" ", last, F.concat("opening", F.lit("_"), made_of))),
        ),
        lambda p: p.isNotNull(),
    )
    seed = F.coalesce(*[F.when(F.col("core").rlike(f"^(?:{p})$") & _valid(kind, F.col("core")), F.lit(k)) for k, (kind, p) in enumerate(BASE.items())], F.when(F.col("core").rlike(KEY), F.lit(len(BASE))))
    start = F.col("at") + F.length("opening")
    return rows.select("id", "h", start.alias("start"), (start + F.length("core")).alias("end"), F.lower("core").alias("instance"), patterns.alias("patterns"), seed.alias("seed"))


def bootstrapped(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(instance, kind, score) of the instances that the graph of all mentions makes confident, without those that a rule accepts."""
    graph = cut(found.select("instance", F.explode("patterns").alias("pattern")).distinct())
    sizes = cut(graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    first = found.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind")).select("instance", "kind", F.lit(1.0).alias("score"))
    first = cut(first)
    seeds, state = first, None
    for _ in range(rounds):
        sure = graph.join(seeds, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("sure")).where(F.col("sure") >= support)
        scored = sure.join(sizes, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("p"))
        # in whole millionths of the logarithm, so that the sum doesn't depend on its order
        doubt = F.sum(F.round(F.log(1 - F.least("p", F.lit(0.999))) * 1e6).cast("long"))
        learnt = graph.join(scored, "pattern").groupBy("instance", "kind").agg(doubt.alias("doubt")).select("instance", "kind", (1 - F.exp(F.col("doubt") / 1e6)).alias("score"))
        best = learnt.where(F.col("score") >= confidence).groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("nth"))).alias("b"))
        best = cut(best.select("instance", (-F.col("b.nth")).alias("kind"), "b.score"))
        now = best.agg(F.count("*"), F.sum(F.xxhash64("instance", "kind").cast("decimal(38,0)"))).first()
        if now == state:
            break
        seeds, state = first.unionByName(best.join(first, "instance", "left_anti")), now
    return best.join(first.where(F.col("kind") < len(BASE)), "instance", "left_anti")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_in(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, base, learnt): of every row the rules' spans and the spans that contexts add, as (start, place of the kind, end)."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[key].alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))
    seen = cut(mentions(rows))
    new = bootstrapped(seen, **options)
    added = seen.where(F.col("seed").isNull() | (F.col("seed") == len(BASE))).join(new, "instance").groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("start", F.col("kind").cast("int").alias("kind"), "end"))).alias("added"))
    added = added.select(F.col("id").alias("of"), F.col("h").alias("of_h"), "added")
    own = _base_spans(rows).select("id", "h", "base")
    both = own.join(added, own["id"].eqNullSafe(added["of"]) & (own["h"] == added["of_h"]), "left")
    learnt = F.filter(F.coalesce("added", F.array().cast(SPAN)), lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return both.select("id", "base", learnt.alias("learnt"))


def digest(found: DataFrame) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learnt, n_spans) of found_in()'s rows."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(RULES)]
    learnt = F.size("learnt").cast("long")
    return found.select("id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "learnt"))).alias("spans"), learnt.alias("n_learnt"), (F.size("base") + learnt).alias("n_spans"))
