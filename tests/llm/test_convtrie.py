"""The prefix trie of conversations against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from paralens.llm import convtrie


def token(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def spliced(rows):
    own = defaultdict(list)
    for k, turn, role, text in rows:
        if k is not None:
            own[k].append(((turn is not None, turn or 0), token(role, text), role or "", text or ""))
    own = {k: [x[2:] for x in sorted(v)] for k, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Nodes of {id: [(role, text)]}, one dictionary entry for each prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    rows = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        rows.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def random_rows(seed, n, longest, words=3):
    r = random.Random(seed)
    rows = []
    for k in r.sample(range(-3, 3 * n), n):
        for turn in range(r.choice([1, 2, 3, longest])):
            rows.append((k, None if r.random() < 0.02 else turn, r.choice(["user", "assistant", None]) if r.random() < 0.1 else ("user", "assistant")[turn % 2], r.choice([None, "", "é", "b" * 9][: words + 1]) if r.random() < 0.3 else "hot"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n int")


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tree_of_one_chunk_equals_brute_force():
    r = random.Random(1)
    for size in (1, 2, 5, 40):
        convs = {k: [("u", r.choice("abc")) for _ in range(r.randint(0, 6))] for k in range(size)}
        distinct = sorted({"".join(f"{t:16}" for _, t in v).encode() for v in convs.values()})
        members = [[k for k, v in convs.items() if "".join(f"{t:16}" for _, t in v).encode() == d] for d in distinct]
        tree = convtrie.Patricia(distinct, [np.ones(len(d) // 16, dtype=np.int64) for d in distinct], [len(m) for m in members], [min(m) for m in members], -1, -1)
        # points are the root, branches, ends and leaves only
        assert (((tree.children != 1) | (tree.end >= 0))[1:]).all()
        for most in (1, 4, 1000):
            pieces = [*tree.nodes(most)]
            rows = [(int(x["conv_id"][i]), int(x["depth"][i]), int(x["parent_conv_id"][i]) if x["depth"][i] else None, *(int(x[c][i]) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))) for x in pieces for i in range(len(x["depth"]))]
            assert sorted(rows, key=repr) == sorted([x[:-1] for x in brute(convs)], key=repr)


@pytest.mark.parametrize(("n", "longest", "parts"), [(120, 9, 1), (150, 6, 17), (40, 60, 11)])
def test_trie_equals_brute_force(spark, n, longest, parts):
    rows = random_rows(n, n, longest)
    rows += [(1000 + k, t, "user", "same") for k in range(60) for t in range(5)] + [(None, 1, "user", "x"), rows[0]]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(convtrie.trie(convtrie.rebuilt(convtrie.sequences(frame(spark, rows)))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(spliced(rows))
    assert any(r[1] == 0 and r[2] is None for r in got)


def test_prefixes_of_each_other_over_many_chunks(spark):
    """Every content goes on the one before, so whole paths are shared at every border."""
    rows = [(5 * k, t, "u", "x" * (t % 3)) for k in range(40) for t in range(k + 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(convtrie.trie(convtrie.sequences(frame(spark, rows))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = defaultdict(list)
    for k, _, role, text in rows:
        own[k].append((role, text))
    assert got == brute(own)


def test_turnless_conversations_and_empty_tables(spark):
    # all turns of such a conversation are replaced by those of a conversation that isn't there
    alone = next(k for k in range(1, 999) if k % 5 and zlib.crc32(str(k).encode()) % 9)
    rows = [(alone, 0, "user", "a")]
    got = found(convtrie.trie(convtrie.rebuilt(convtrie.sequences(frame(spark, rows)))))
    assert got == brute({alone: []}) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert convtrie.trie(convtrie.rebuilt(convtrie.sequences(frame(spark, rows).limit(0)))).count() == 0
    assert convtrie.trie(convtrie.sequences(frame(spark, [(None, 0, "u", "x")]))).count() == 0
