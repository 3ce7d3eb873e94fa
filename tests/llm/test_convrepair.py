"""Repair of conversations against an enumeration of edits, written from the rules."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from paralens.llm import convrepair
from paralens.llm import queries as Q

SPACE = " \t\n\x0b\x0c\r"
PATTERN = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for k, turn, role, text in rows:
        name = f"{' ' if k is None else k}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(name.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(k, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(row, fault):
    """(letter, cost, role, text) of the edits of a row that use it up."""
    late = 1 if fault == "truncated" else 0
    yield "D", 3, None, None
    if fault not in ("blank", "duplicate"):
        yield "K", late, row[2], row[3]
        for role in ("user", "assistant"):
            yield "R", 2 + late, role, row[3]


def enumerated(rows, found):
    """The least (cost, audit, turns) of all edits with at most three inserts at one place."""
    best = None
    inserts = [x for n in range(4) for x in itertools.product(("user", "assistant"), repeat=n)]
    for ways in itertools.product(*[list(options(r, f)) for r, f in zip(rows, found)]):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            audit, cost, turns = "", 0, []
            for k in range(len(rows) + 1):
                audit, cost = audit + "I" * len(put[k]), cost + 2 * len(put[k])
                turns += [(role, "") for role in put[k]]
                if k < len(rows):
                    letter, more, role, text = ways[k]
                    audit, cost = audit + letter, cost + more
                    turns += [(role, text)] if role is not None else []
            if best is None or (cost, audit) < best[:2]:
                initials = [r[:1] for r, _ in turns]
                if all(initials) and PATTERN.fullmatch("".join(initials)):
                    best = (cost, audit, turns)
    return best


def searched(rows, found):
    """The same by a search over what the initials so far allow."""

    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @lru_cache(None)
    def best(k, state, inserted):
        ways = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if after(state, role[0]):
                    c, a, t = best(k, after(state, role[0]), inserted + 1)
                    ways.append((c + 2, "I" + a, ((role, ""), *t)))
        if k < len(rows):
            for letter, cost, role, text in options(rows[k], found[k]):
                to = state if role is None else after(state, role[:1])
                if to is not None:
                    c, a, t = best(k + 1, to, 0)
                    ways.append((c + cost, letter + a, t if role is None else ((role, text), *t)))
        return min(ways, default=(1 << 60, "", ()))

    sys.setrecursionlimit(20_000)
    return best(0, "", 0)


def expected(rows, solve=searched):
    out = {}
    for k in {r[0] for r in rows}:
        own = ordered([r for r in damage(rows) if r[0] == k])
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, kept = solve(own, found)
        out[k] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        }
    return out


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, k string, n int")


def got(df):
    return {r["id"]: {c: r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")} for r in df.collect()}


def random_rows(seed, n, longest):
    r = random.Random(seed)
    texts = ["a.", "b!", "c", "d?", "", " \n", "e. ", "f ", "ü.", "a.", "x" * 50]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", "u", "", None]
    rows = []
    for k in range(n):
        at = r.choice([0, 0, 0, 5, -3])
        for i in range(r.randint(1, longest)):
            at += r.choice([0, 1, 1, 1, 1, 2])
            role = r.choice(roles) if r.random() < 0.4 else ("user", "assistant")[i % 2]
            rows.append((k if k else None, None if r.random() < 0.05 else at, role, None if r.random() < 0.05 else r.choice(texts) + r.choice(["", "", str(i) + "."])))
    return rows + rows[:: max(1, n // 2)]


def test_steps_equal_an_enumeration():
    r = random.Random(2)
    for n in (0, 1, 2, 3):
        for _ in range(40 if n < 3 else 6):
            rows = [(1, i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", "", "a."])) for i in range(n)]
            found = faults(rows)
            cost, audit, kept = enumerated(rows, found)
            assert searched(rows, found) == (cost, audit, tuple(kept))


def test_repair_equals_a_search(spark):
    rows = random_rows(3, 150, 9)
    assert got(convrepair.of_damaged(turns(spark, rows))) == expected(rows)


def test_long_conversations_over_many_chunks(spark):
    rows = random_rows(4, 3, 400) + random_rows(5, 30, 4)
    rows = [((k or 0) % 7, *x) for k, *x in rows] + [(99, i, "user", "same.") for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(convrepair.of_damaged(turns(spark, rows))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_without_turns_left_and_empty_tables(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a."), (None, None, None, None)]
    found = got(convrepair.of_damaged(turns(spark, rows)))
    assert found == expected(rows)
    assert found[gone]["audit"] == "" and found[gone]["repaired_sha256"] == hashlib.sha256().hexdigest()
    assert convrepair.of_damaged(turns(spark, rows).limit(0)).count() == 0
    undamaged = convrepair.repaired(turns(spark, [(1, 0, "user", "a."), (1, 1, "assistant", "b.")]))
    assert [(r["cost"], r["audit"]) for r in undamaged.collect()] == [(0, "KK")]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_over_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = Q.op12_conversation_repair(spark, f"/root/testdata/{sf}").withColumnRenamed("conv_id", "id")
    assert got(found) == expected(rows)
