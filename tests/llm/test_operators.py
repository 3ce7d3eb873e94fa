"""The training-data operators: edge cases, and brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paralens.llm import components, decontam, htmltext, linededup, pii, quality, rans, sentencepieces, simhash, tokenbin, toxicity, urlfilter
from paralens.llm import queries as Q
from paralens.llm import words as W
from paralens.llm.xxh import xxh64

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = [None, "", " \n\t ", "x", "one two", "A b\nC  d\x0be", "日本語 テスト", "word " * 3000, "é" * 2000]


def texts(seed=0, n=40):
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS, k=r.randint(1, 60))) for _ in range(n)]
    near = [re.sub("alpha", "omega", t, count=1) for t in base[: n // 4]]
    return base + near + base[:5] + ["\n".join(base[k : k + 3]) for k in range(6)]


def documents(spark, rows, extra=True):
    """(doc_id, text) with columns whose names operators use inside, and a repeated row."""
    data = [(k, t, "v", 1, "w") for k, t in enumerate(rows)]
    if extra:
        data += [data[-1]]
    return spark.createDataFrame(data, "doc_id long, text string, id string, fp int, row string")


def words(t, lower=True):
    t = t or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def fingerprint(t):
    w = words(t)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_xxh64_matches_the_library():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    start = np.arange(0, 900)
    end = start + np.arange(900) % 700
    got = xxh64(data, start, end)
    assert all(int(g) == xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for g, a, b in zip(got, start, end))


def test_gray_index_finds_all_pairs():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64)) for _ in range(4)]]))
    index = simhash.GrayIndex(codes)
    got = {(int(codes[a]), int(index.codes[b])) for q, m in index.within(codes, 4) for a, b in zip(q, m)}
    want = {(int(a), int(b)) for a in codes for b in codes if bin(int(a) ^ int(b)).count("1") <= 4}
    assert got == want


def test_gray_index_finds_the_links_of_every_cell(monkeypatch):
    r = np.random.default_rng(4)
    sizes = np.array([1, 2, 3, 7, 8, 9, 64, 65, 300, 0, 5])
    cells = np.repeat(np.arange(len(sizes)), sizes)
    codes = r.integers(0, 2**63, len(cells), dtype=np.uint64)
    near = r.permutation(len(cells))[:200]
    codes[near] = codes[near - 1] ^ np.bitwise_or.reduce([np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64) for _ in range(4)])
    root = simhash.forest(codes, 4, cells)
    want = np.arange(len(cells))
    while True:
        before = want.copy()
        for a in range(len(cells)):
            linked = np.flatnonzero((cells == cells[a]) & (np.bitwise_count(codes ^ codes[a]) <= 4))
            want[linked] = want[linked].min()
        if (before == want).all():
            break
    assert len(set(want.tolist())) < len(cells) - 20
    assert [[root[a] == root[b] for b in range(len(cells))] for a in range(len(cells))] == [[want[a] == want[b] for b in range(len(cells))] for a in range(len(cells))]
    assert (cells[root] == cells).all()
    monkeypatch.setattr(simhash.GrayIndex, "within", lambda *_: iter(()))
    assert (simhash.forest(codes, 4, cells) == np.arange(len(cells))).all()


def test_simhash_components(spark):
    rows = texts() + ODD
    got = {r["id"]: r for r in simhash.near_duplicates(documents(spark, rows), cell_rows=3).collect()}
    codes = [fingerprint(t) for t in rows]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        for a in range(len(rows)):
            for b in range(len(rows)):
                if bin(codes[a] ^ codes[b]).count("1") <= 4:
                    root[a] = min(root[a], root[b])
    assert all(got[k]["fp"] & (2**64 - 1) == codes[k] and got[k]["component"] == root[k] for k in range(len(rows)))
    kept = simhash.deduplicated(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "fp", "row"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*root})
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_simhash_keeps_a_row_of_each_component(spark):
    rows = [(None, t) for t in texts(12, 6)[:6] + texts(12, 6)[:2]] + [(7, None), (7, "")] + [(3, texts(13)[0]), (3, texts(13)[1]), (None, texts(13)[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in simhash.deduplicated(docs).collect()]
    assert sorted(t for k, t in got if k is None) == sorted(texts(12, 6)[:6])
    assert sorted(k for k, _ in got if k is not None) == [3, 7]
    again = simhash.deduplicated(docs.orderBy(F.desc("text")).repartition(3))
    assert sorted(got, key=str) == sorted(map(tuple, again.collect()), key=str)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 50), (None, 3), (31, 30)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(21)} | {30: 30, 31: 30}


def line_set(line):
    folded = re.sub(r"[!-/:-@\[-`{-~]", " ", line.lower())
    return frozenset(w for w in re.split(r"[\x20\x09-\x0d]+", folded) if w)


def test_line_dedup(spark):
    rows = ["\n".join(t) for t in zip(texts(1), texts(2), texts(1)[::-1])] + ODD
    got = {r["row"]["doc_id"]: r for r in linededup.deduplicated(documents(spark, rows)).collect()}
    lines = [(d, i, line_set(x)) for d, t in enumerate(rows) for i, x in enumerate((t or "").split("\n"))]
    for d, t in enumerate(rows):
        want = []
        for i, x in enumerate((t or "").split("\n")):
            own = line_set(x)
            if own and any(o and (e, j) < (d, i) and len(own & o) >= 0.8 * len(own | o) - 1e-9 for e, j, o in lines):
                want.append(i)
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want)
        assert (got[d]["removed_lines"], got[d]["text"]) == (want, left)
    assert linededup.deduplicated(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_line_links_and_thresholds(spark, monkeypatch, threshold):
    # small lists are split into parts too
    monkeypatch.setattr(linededup, "LIST_ROWS", 8)
    r = random.Random(int(10 * threshold))
    base = [r.choices(WORDS, k=r.randint(1, 9)) for _ in range(25)]
    rows = [" ".join(b) for b in base] + [" ".join(b[1:] + r.choices(WORDS, k=1)) for b in base] + ["a b c", "a b", "a"]
    long = [f"word{k}" for k in range(3000)]
    rows += [" ".join(long), " ".join(long[: int(3000 * threshold)]), " ".join(long[: int(3000 * threshold) - 1])]
    docs = documents(spark, rows, extra=False)
    got = {x["row"]["doc_id"]: (x["n_links"], bool(x["removed_lines"])) for x in linededup.deduplicated(docs, threshold=threshold).collect()}
    sets = [line_set(t) for t in rows]
    alike = lambda a, b: len(a & b) >= threshold * len(a | b) - 1e-9
    assert any(n for n, _ in got.values()) == (threshold < 1)
    for k, own in enumerate(sets):
        want = len({o for o in sets if o != own and alike(o, own)}), any(alike(o, own) for o in sets[:k])
        assert got[k] == want, (k, own)


def test_pipeline_drops_documents_without_words(spark):
    import corpus_pipeline

    line = "a line of some words to copy"
    rows = [(0, line), (1, f"{line}\n\n\n"), (2, f"\t\n{line}\n \x0b"), (3, f"{line}\n\nnew words here"), (4, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.line_dedup(spark, docs, "").collect()) == [0, 3, 4]


def test_decontamination(spark):
    r = random.Random(5)
    item = [" ".join(f"w{r.randint(0, 500)}" for _ in range(30)) for _ in range(6)] + ["short item here", None, "", "one"]
    edited = item[1].split()
    edited[28] = "changed"  # breaks two of its 26 shingles
    rows = ["lead " + item[0].upper() + ", tail", "x y " + " ".join(edited) + " z", item[2][: len(item[2]) // 2], "nothing at all", "a short item here b", item[3].replace(" ", "\n")] + ODD
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    got = {(x["id"], x["item"]): x for x in decontam.matches(documents(spark, rows), bench).collect()}
    hits = {(0, 0), (1, 1), (4, 6), (5, 3)}
    assert {k for k in got if k[0] < 6} == hits | {(k[0], 9) for k in got if k[0] < 6 and k[1] == 9}
    assert got[0, 0]["similarity"] == 1.0 and got[0, 0]["first_word"] == 1 and got[1, 1]["similarity"] == 24 / 28
    clean = decontam.decontaminated(documents(spark, rows), bench)
    assert {x["doc_id"] for x in clean.collect()} == set(range(len(rows))) - {k[0] for k in got}
    assert decontam.matches(documents(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    r = random.Random(15)
    some = [f"w{k}" for k in range(400)]
    item = [r.choices(some, k=r.choice([3, 5, 9, 14, 30, 31, 60])) for _ in range(25)] + [["a", "b"] * 12]
    rows = []
    for k in range(160):
        own = list(r.choice(item))
        for _ in range(r.randint(0, 2)):  # words put in, taken out or changed
            at = r.randrange(len(own))
            own[at : at + r.randint(0, 1)] = r.choices(some, k=r.randint(0, 1))
        rows.append(" ".join(r.choices(some, k=r.randint(0, 20)) + own[: r.choice([90, 90, r.randint(1, 60)])] + r.choices(some, k=r.randint(0, 20))))
    rows += [" ".join(item[4] + item[4] + item[5])] + ODD

    def shingles(w):
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    want = {}
    for d, t in enumerate(rows):
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if x]
        for i, own in enumerate(item):
            size = min(len(own), len(w))
            for s in range(len(w) - size + 1 if size and len(set(w)) > 1 else 0):
                a, b = shingles(w[s : s + size]), shingles(own)
                sim = (a & b).total() / (a | b).total()
                if sim >= 0.8 and sim > want.get((d, i), (0, 0))[1]:
                    want[d, i] = (s, sim)
    docs, bench = documents(spark, rows, extra=False), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(item)], "item_id long, text string")
    got = {(x["id"], x["item"]): (x["first_word"], x["similarity"]) for x in decontam.matches(docs, bench).collect()}
    assert len(want) > 60 and got.items() <= want.items() and len(got) >= 0.98 * len(want)
    assert got == {(x["id"], x["item"]): (x["first_word"], x["similarity"]) for x in decontam.matches(docs, bench, group_bytes=900).collect()}
    kept = {x["doc_id"] for x in decontam.decontaminated(docs, bench, group_bytes=900).collect()}
    assert kept == set(range(len(rows))) - {d for d, _ in got}
    # what the fingerprints don't find is not found
    monkeypatch.setattr(decontam.HammingBlocks, "search", lambda self, codes: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not list(decontam.Items([0], [" ".join(item[4])], 0.8, 19).matches(W.folded_words(pa.array(rows))))


def test_hamming_blocks_find_all_in_radius():
    r = np.random.default_rng(2)
    codes = r.integers(0, 2**63, 300, dtype=np.uint64)
    near = codes[:50] ^ np.bitwise_or.reduce([np.uint64(1) << r.integers(0, 64, 50, dtype=np.uint64) for _ in range(20)])
    index = decontam.HammingBlocks(codes)
    for code in near.tolist():
        want = [k for k, c in enumerate(codes.tolist()) if bin(c ^ code).count("1") <= decontam.RADIUS]
        assert index.near(code).tolist() == want


def test_quality_rules(spark):
    rows = texts(4) + ODD + ["a b c d e f g h " * 5, "### $$$\nline one\nline one\n\n  \nline one "]
    labels = spark.createDataFrame([(k, 1 if k % 2 else 0) for k in range(20)], "doc_id long, quality int")
    got = {r["id"]: r for r in quality.assessed(documents(spark, rows, extra=False), labels).collect()}
    for d, t in enumerate(rows):
        w, t = words(t, lower=False), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 8)} if len(windows) < 500 else set(range(len(w)))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[d]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (got[d]["base_failed"] and got[d]["kept"])
    assert quality.assessed(documents(spark, rows).limit(0), labels).count() == 0


def test_quality_ratio_against_brute_force(spark):
    import math
    import struct

    def h64(data, seed=42):
        x = xxhash.xxh64_intdigest(data, seed)
        return x - (1 << 64) if x >> 63 else x

    def grams(t, buckets):
        h = [h64(w.encode()) for w in words(t, lower=False)]
        pair = lambda a, b: h64(struct.pack("<q", b), h64(struct.pack("<q", a)) & (2**64 - 1))
        return [x % buckets for x in [*h, *map(pair, h, h[1:])]]

    rows = texts(14) + ODD
    rows += rows[3:5]
    docs = documents(spark, rows)
    rows = [*rows, rows[-1]]  # documents() repeats a row
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(30)] + [(6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    good = {k for k in range(30) if k % 3 == 0} - {6}
    ids = [*range(len(rows) - 1), len(rows) - 2]
    corpus, trusted = Counter(), Counter()
    for k, t in zip(ids, rows):
        corpus.update(grams(t, 97))
        if k in good:
            trusted.update(grams(t, 97))
    weight = [math.log(trusted[b] + 1) - math.log(trusted.total() + 97) - math.log(corpus[b] + 1) + math.log(corpus.total() + 97) for b in range(97)]
    ratios = [sum(weight[b] for b in g) / len(g) if g else 0.0 for g in (grams(t, 97) for t in rows)]
    least = sorted(v for v, t in zip(ratios, rows) if len(words(t)) >= 20)[10] + 1e-6
    found = quality.assessed(docs, labels, buckets=97, threshold=least).collect()
    assert len(found) == len(rows)
    for x in found:
        ratio = ratios[x["id"]]
        assert x["ratio"] == pytest.approx(ratio, abs=1e-9) and x["kept"] == (not x["base_failed"] and ratio >= least)
    assert any(x["kept"] for x in found) and any(not x["kept"] and not x["base_failed"] for x in found)


def test_quality_threshold_follows_held_out_documents(spark):
    r = random.Random(41)
    rows = [" ".join(r.choices(WORDS[:12] if k % 2 else WORDS[8:], k=r.randint(25, 60))) for k in range(200)]
    docs = documents(spark, rows, extra=False)
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)], "doc_id long, quality int")
    found = {x["id"]: x for x in quality.assessed(docs, labels, keep=0.9).collect()}
    held = [k for k in range(160) if k % 2 and zlib.crc32(str(k).encode()) % 4 == quality.HELD_OUT]
    weight = quality.weights(docs, labels, held_out=quality.HELD_OUT)
    least = quality.derived_threshold(docs, labels, weight, keep=0.9)
    ratios = sorted((found[k]["ratio"] for k in held), reverse=True)
    assert least <= ratios[-(-9 * len(held) // 10) - 1] < least + 0.001 + 1e-9
    assert all(found[k]["kept"] == (not found[k]["base_failed"] and found[k]["ratio"] >= least) for k in found)
    assert sum(found[k]["kept"] for k in range(161, 200, 2)) > 3 * sum(found[k]["kept"] for k in range(160, 200, 2))
    none = quality.assessed(docs, labels.where("quality = 0")).collect()
    assert all(x["ratio"] == 0 and x["kept"] == (not x["base_failed"]) for x in none)


def test_pipeline_toxicity_stage_rejects(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(17)
    rows = []
    for k in range(240):
        w = [f"w{r.randint(0, 300)}" for _ in range(r.randint(5, 60))]
        for _ in range(3 * (k % 5 == 0)):
            w.insert(r.randrange(len(w)), r.choice(["vile", "awful"]))
        rows.append(" ".join(w))
    data = [(k, t, 0.5) for k, t in enumerate(rows)] + [(None, None, 1.0), (None, "w1 w2", 1.0), (3, rows[3], 0.5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxicity_score double")
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(240)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    left = [x["doc_id"] for x in kept.collect()]
    assert sorted(k for k in left if k is not None) == sorted([k for k in range(240) if k % 5] + [3]) and left.count(None) == 2
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        again = [x["doc_id"] for x in stage(spark, docs, str(tmp_path)).collect()]
        assert None in again and len(again) >= 230
    assert corpus_pipeline.toxicity(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_toxicity(spark):
    r = random.Random(7)
    rows = []
    for k in range(400):
        w = [f"w{r.randint(0, 300)}" for _ in range(r.randint(5, 80))]
        if k % 5 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vile", "awful"]))
        rows.append(" ".join(w))
    docs = documents(spark, rows + ODD)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = {x["doc_id"]: x["toxicity"] for x in toxicity.scored(docs, labels).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all((got[k] >= 0.3) == (k % 5 == 0) for k in held)
    assert all(0 <= v < 0.3 for k, v in got.items() if k >= 400)
    nobody = toxicity.scored(docs, labels.where("toxic = 0"))
    assert {x["toxicity"] for x in nobody.collect()} == {0.0}


def test_toxicity_of_rare_words_and_fixed_phrases(spark):
    r = random.Random(8)
    rows = []
    for k in range(400):
        w = [f"w{r.randint(0, 300)}" for _ in range(r.randint(5, 80))]
        if k % 5 == 0:  # each word is rare, and its bigrams are always the same
            w[r.randrange(len(w)) : 0] = r.choice([f"mean phrase{j} of hate{j}" for j in range(12)]).split()
        elif k % 5 == 1:
            w[r.randrange(len(w)) : 0] = f"mean of phrase{r.randint(20, 30)}".split()
        rows.append(" ".join(w))
    docs = documents(spark, rows, extra=False)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = {x["doc_id"]: x["toxicity"] for x in toxicity.scored(docs, labels, shard_keys=500).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k] >= 0.3 for k in held if k % 5 == 0) >= 0.9 * sum(k % 5 == 0 for k in held)
    assert sum(got[k] >= 0.3 for k in held if k % 5) <= 0.1 * sum(k % 5 != 0 for k in held)


def test_toxicity_keeps_rare_bigrams_of_large_corpora(spark):
    codes = np.array([8 << 32 | 4, 9 << 32 | 5, 9 << 32 | 6], np.uint64)
    counts = np.array([[1 << 30, 100, 0], [1 << 32, 0, 1]], np.int64)
    order = np.argsort(W.mix(codes))
    rows = toxicity._counted(W.mix(codes)[order], counts[:, order], 4)
    model = toxicity.Model(spark.createDataFrame([tuple(x.values()) for x in rows.to_pylist()], toxicity.COUNTED))
    often = dict(zip(*(x.tolist() for x in model.frequent())))
    seldom = {int(k): float(v) for x in model.rows().collect() for k, v in zip(toxicity._of_ascending(bytes(x["keys"])), toxicity._of_planes(bytes(x["one"]), "<f4"))}
    keys = toxicity.keys_of(W.mix(codes), True, model.bits).tolist()
    assert len(often) == 2 and len(seldom) == 4 and keys[0] in often
    assert seldom[keys[1]] > 3 and seldom[keys[2]] != 0


def test_toxicity_sums_against_brute_force(spark, monkeypatch):
    # few expressions are frequent, so both ways of the lookup are taken
    monkeypatch.setattr(toxicity, "FREQUENT", 6)
    r = random.Random(21)
    rows = [" ".join(r.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=r.randint(0, 40))) for _ in range(60)] + ODD
    docs = documents(spark, rows, extra=False)
    marked = spark.createDataFrame([(k, rows[k], k % 2) for k in range(40)], "id long, text string, toxic int")
    got = {x["h"]: x for x in toxicity.evidence(docs, marked, shard_keys=50).collect()}
    hashes = {x["doc_id"]: x["h"] for x in docs.select("doc_id", toxicity.text_hash(F.col("text")).alias("h")).collect()}
    fold = lambda t: [w for w in re.split(r"[\x20\x09-\x0d!-/:-@\[-`{-~]+", (t or "").lower()) if w]
    pairs_of = lambda t: list(zip([None, *fold(t)], fold(t)))
    pairs = {}
    for k in range(40):
        for p in pairs_of(rows[k]):
            pairs.setdefault(p, [0, 0])[1 - k % 2] += 1
    words_ = {}
    for (_, w), n in pairs.items():
        for c in (0, 1):
            words_.setdefault(w, [0, 0])[c] += n[c] > 0

    def values(table):
        kind = {}
        for c, name in enumerate(toxicity.CLASSES):
            own = [n[c] for n in table.values()]
            kind[f"x_{name}_total"] = sum(own)
            kind |= {f"x_{name}_{k}": own.count(k) for k in (1, 2, 3, 4)} | {f"x_{name}_more": sum(n > 4 for n in own)}
        counts = toxicity.Counts(kind, "x")
        return dict(zip(table, counts.evidence(*np.array(list(table.values())).T).tolist()))

    of_pairs, of_words = values(pairs), values(words_)
    for k, t in enumerate(rows):
        found = got[hashes[k]]
        v = [of_words.get(w, 0) for w in fold(t)]
        b = [of_pairs.get(p, 0) for p in pairs_of(t)]
        want = {"n_words": max(1, len(v)), "n_pairs": max(1, len(b)), "words": sum(v), "pairs": sum(b), "words4": sum(max(x, 0) ** 4 for x in v), "pairs4": sum(max(x, 0) ** 4 for x in b)}
        assert {s: found[s] for s in want} == pytest.approx(want, rel=1e-4, abs=1e-5), (k, t)


SPANS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def fits(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(x) * (2 if i % 2 else 1), 10)) for i, x in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and total % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(SPANS.items()) for m in re.finditer(p, t or "") if fits(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_personal_data(spark):
    r = random.Random(9)
    odd = [*ODD, "a@b.cc é x.y+z@h-1.org. 1.2.3.256 01.2.3.4.5", "4111 1111-1111 1111 and 4111111111111112", "+1 (988) 555-2485 tel +123", "9" * 3000, "x@y " * 500, "😀 a@b.c 😀 10.0.0.1"]
    people = [f"please write to agent user{k}@mail.org today" for k in range(8)] + ["please write to agent jo(at)m4il today", "lone token 77b"]
    rows = odd + people + ["".join(r.choices("ab1.+@- ()9", k=60)) for _ in range(60)]
    got = {x["id"]: x for x in pii.digest(pii.found_in(documents(spark, rows))).collect()}
    for d, t in enumerate(rows):
        want = base_spans(t)
        assert got[d]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[d]["spans"].split(","))
    assert got[len(odd) + 8]["spans"] == "email:22:32"
    assert got[len(odd) + 9]["spans"] == ""
    assert pii.digest(pii.found_in(documents(spark, rows).limit(0))).count() == 0


def test_bootstrap_scores_against_brute_force(spark):
    r = random.Random(31)
    n = iter(range(10**6))

    def token(kind):
        k = next(n)
        return {"mail": f"user{k}@mail.org", "odd": f"user{k}(at)m4il", "key": f"{k:032x}a", "short": f"k{k}x9", "year": str(1900 + k % 90)}[kind]

    rows = []
    for _ in range(150):
        kind = r.choices(["mail", "odd", "year", "key", "short"], [8, 1, 1, 8, 1])[0]
        before = {"mail": ["write to", "mail to", "to"], "odd": ["write to", "mail to"], "year": ["in the", "from"], "key": ["token =", "key ="], "short": ["token =", "the"]}[kind]
        mark = '"' if kind in ("key", "short") and r.random() < 0.7 else ""
        rows.append(" ".join([r.choice(["a b c", "please", ""]), r.choice(before), mark + token(kind) + mark, r.choice(["today", "now x", ""])]).strip())
    docs = documents(spark, rows)
    seen = [x.asDict() for x in pii.mentions(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")).collect()]
    graph = {(m["instance"], p) for m in seen for p in m["patterns"]}
    for m in seen:
        t, core = rows[m["id"]], rows[m["id"]][m["start"] : m["end"]]
        assert core.lower() == m["instance"] and core[0] != '"' and core[-1] != '"'
        w = t[: m["start"]].strip('"').lower().split()
        assert not w or any(p.startswith(w[-1] + " ") and "_" in p for p in m["patterns"])
    first = {}
    for m in seen:
        if m["seed"] is not None:
            first[m["instance"]] = min(first.get(m["instance"], 9), m["seed"])
    seeds, best = {i: (k, 1.0) for i, k in first.items()}, None
    for _ in range(pii.ROUNDS):
        sure, size = {}, {}
        for i, p in graph:
            size[p] = size.get(p, 0) + 1
            if i in seeds:
                sure.setdefault((p, seeds[i][0]), []).append(seeds[i][1])
        score = {k: sum(v) / (size[k[0]] + 1) for k, v in sure.items() if len(v) >= pii.SUPPORT}
        learnt = {}
        for i, p in graph:
            for kind in range(5):
                if (p, kind) in score:
                    learnt[i, kind] = learnt.get((i, kind), 1) * (1 - min(score[p, kind], 0.999))
        now = {}
        for (i, kind), doubt in sorted(learnt.items()):
            if 1 - doubt >= pii.CONFIDENCE and 1 - doubt > now.get(i, (0, 0))[1] + 1e-6:
                now[i] = (kind, 1 - doubt)
        if best is not None and {i: k for i, (k, _) in now.items()} == {i: k for i, (k, _) in best.items()}:
            break
        best = now
        seeds = now | {i: (k, 1.0) for i, k in first.items()}
    want = {i: v for i, v in now.items() if first.get(i, 9) > 3}
    got = {x["instance"]: (x["kind"], x["score"]) for x in pii.bootstrapped(spark.createDataFrame(seen, "id long, h long, start int, end int, instance string, patterns array<string>, seed int")).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert {i: s for i, (_, s) in got.items()} == pytest.approx({i: s for i, (_, s) in want.items()}, abs=1e-4)
    # addresses and keys that no rule knows, and no years
    assert any("(at)" in i for i in got) and any(i.startswith("k") and i.endswith("x9") for i in got) and not any(i.isdigit() for i in got)


def test_html_rendering():
    page = """<title>A &amp; B</title><style>.x{display:none}</style><h1>Head</h1>intro <b>bold</b>
 text<p>One<p>Two<br>line<div>div<span hidden>no</span><span class=x>no</span></div><ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>
<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td rowspan=2>r<td>1<tr><td>2</table><pre>  keep
   this</pre><div style="visibility:hidden">h<span style="visibility:visible">v</span></div>x &lt; y"""
    title, text = htmltext.render(page)
    assert title == "A & B"
    assert text == "Head\n\nintro bold text\n\nOne\n\nTwo\nline\n\ndiv\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nCap\nName       Qty\nApple pie  3\nr          1\n           2\n\n  keep\n   this\n\nv\nx < y"
    assert htmltext.render(None) == htmltext.render("") == ("", "")
    for odd in ("<", "<a", "</", "<!--", "<table>x<tr>y<td>z", "<div>" * 3000 + "deep", "<ul><li>" * 900 + "deep", "<p>a</p></p><li>b", "a<script>if (a<b) x()</script>b", '<a href="open>link</a> tail'):
        htmltext.render(odd)
    assert "deep" in htmltext.render("<table><tr><td>" * 600 + "deep")[1]


def test_html_keeps_elements_between_cells():
    for page, text in {
        "<table><div>x</div><tr><td>a</table>z": "x\n\na\n\nz",
        "<table><tr><a>x</a><td>y</table>": "x\n\ny",
        "<table><tr><td>a</tr><center>x</center></table>": "x\n\na",
        "<table><form><tr><td>q</td></tr></form></table>": "q",
        "<table><colgroup><col><div>k</div><tr><td>m</table>": "k\n\nm",
    }.items():
        assert htmltext.render(page)[1] == text


def test_html_style_cascade():
    nav = "<div class=n id=i>nav</div>"
    for css in ("@media print{.n{display:none}}", "@media (max-width:600px){.n{display:none}}", "@media not screen{.n{display:none}}", ".n{display:none} .n{display:block}", "#i{display:block} .n{display:none}", "@media print{@media screen{.n{display:none}}}", "@font-face{x:y} .n{display:none;display:flex}", ".n{display:none;display:bogus;display:block}"):
        assert htmltext.render(f"<style>{css}</style>{nav}")[1] == "nav", css
    for css in (".n{display:none}", "@media screen{.n{display:none}}", "@media print{.x{display:none}} .n{display:none}", "@media screen and (min-width:600px){.n{display:none}}", ".n{display:none!important} .n{display:block}", ".n{display:block;display:none", "@import 'a'; .n{color:red;display:none}", "@media all,print{.n{visibility:hidden}}", "@media(min-width:10em){.n{display:none}}"):
        assert htmltext.render(f"<style>{css}</style>{nav}")[1] == "", css
    assert htmltext.render(f"<style media=print>.n{{display:none}}</style>{nav}")[1] == "nav"
    assert htmltext.render("<style>.n{display:none}</style><p class=n style='display:block'>nav")[1] == "nav"
    assert htmltext.render("<p hidden style='display:block'>a</p><p hidden>b")[1] == "a"


def test_html_selectors_and_display():
    for page, text in {
        "a<span style=display:block>b</span>c": "a\nb\nc",
        "<style>.b{display:flex}</style>a<b class=b>b</b>c": "a\nb\nc",
        "<style>.b{display:inline-block}</style>a<div class=b>b</div>c": "abc",
        "<style>div .n{display:none}</style><div><i><b class=n>x</b></i></div><b class=n>y</b>": "y",
        "<style>div>.n{display:none}</style><div><i><b class=n>x</b></i><b class=n>z</b></div>": "x",
        "<style>#a b.n i{display:none}</style><p id=a><b class='m n'><u><i>x</i></u></b><b><i>y</i></b>": "y",
        "<style>p.a.b{visibility:hidden}</style><p class='b a'>z</p><p class=a>w": "w",
        "<style>div .n{display:none} .n{display:inline}</style><div><b class=n>x</b></div>y": "y",
        "<style>a:hover,.n[x]{display:none} ul > li + li{display:none}</style><ul><li>p<li>q</ul>": "- p\n- q",
        "<style>> b{display:none} b >{display:none}</style><b>x</b>": "x",
    }.items():
        assert htmltext.render(page)[1] == text, page


def test_html_query_covers_all_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a", "z"), (1, "<p>a", "z"), (2, None, None)], "page_id long, html string, text string")
    assert sorted((x["id"], x["text"]) for x in htmltext.rendered(pages).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert htmltext.rendered(pages.limit(0)).count() == 0


def test_url_filter(spark):
    link = '<a href="http://{}/x">'
    rows = [
        (1, "http://good.org/fr/1", link.format("friend.com")),
        (2, "https://friend.com/a?q", None),
        (3, "http://bad.net/", ""),
        (4, "http://farm.com/p#f", link.format("bad.net") + link.format("bad.net")),
        (5, "http://A.Example.NET/en/9", None),
        (6, "http://x.net", None),
        (7, None, None),
        (8, "no scheme", "<a"),
        (9, "http://bad.net/q", ""),
        (9, "http://bad.net/q", ""),
        (10, "http://mixed.org/fr/2", link.format("bad.net") + link.format("friend.com")),
        (11, "http://mixed.org/x", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["id"]: x for x in urlfilter.judged(pages, Q.URL_RULES).collect()}
    assert {k: (v["rule"], v["verdict"]) for k, v in got.items()} == {
        1: ("org/fr/", "allow"), 2: (None, "allow"), 3: ("net/", "block"), 4: (None, "block"), 5: ("example.net/en/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("net/", "block"), 10: ("org/fr/", "allow"), 11: (None, "allow"),
    }
    # as much trust as distrust doesn't block
    assert got[11]["distrust"] > 0.1 * urlfilter.UNIT and got[11]["trust"] > 0
    assert got[2]["trust"] > 0 and got[4]["distrust"] > got[4]["trust"] and (got[7]["host"], got[7]["path"]) == ("", "")
    assert got[5]["host"] == "a.example.net" and got[2]["path"] == "/a"
    assert urlfilter.judged(pages.limit(0), Q.URL_RULES).count() == 0


def test_rans_round_trip_and_checksums():
    r = np.random.default_rng(0)
    for n in (0, 1, 31, 32, 33, 16384, 16385, 50_000):
        ids = np.minimum(r.zipf(1.3, n), 2**31).astype(np.uint32)
        data = rans.encode(ids)
        assert (rans.decode(data) == ids).all()
        assert (rans.decode(rans.encode(ids % 5000)) == ids % 5000).all()
        if n > 40_000:
            assert (rans.decode(data, 1, 2) == ids[16384 : 3 * 16384]).all()
            broken = bytearray(data)
            broken[-5] ^= 1
            with pytest.raises(ValueError):
                rans.decode(bytes(broken))


def test_plain_units_go_to_the_model():
    """Plain letters and marks pass by the pre-tokenizer; the ids stay the library's, also where room is made."""
    encode = tokenbin.UnitEncoder(Q.tokenizer_file("byte_bpe_50k.json"), most=60)
    whole = encode.tokenizer
    r, parts = random.Random(3), ["the", "École", "ﬁne", "x", "don't", "'s", ".", ",[\\]", " ", " ", "  ", "\n", "\n\n", "7", "42", "日本", "\u00a0", "\x1c", "ɏɐ", "<|endoftext|>"]
    rows = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(2000)]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in rows]
    assert [ids for lo in range(0, len(rows), 50) for ids in encode(rows[lo : lo + 50])] == want
    # marks and letters are new here; only the run of marks needs the whole tokenizer
    fresh, asked = tokenbin.UnitEncoder(Q.tokenizer_file("byte_bpe_50k.json")), []
    fresh._encode = lambda texts, plain=fresh._encode: asked.extend(texts) or plain(texts)
    fresh(["alpha Beta, gamma\nDélta, eta"])
    assert asked == [","]


def test_token_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file("byte_bpe_50k.json")
    rows = texts(3) + ODD + ["  a b", "a\n b c\t d ", "<|endoftext|> hi", "a <|endoftext|> b", "a <|endoftext|><|endoftext|>\n", "a\x85 b"]
    docs = documents(spark, rows)
    tokenbin.write(docs, str(tmp_path / "s"), path, 2, segment_tokens=300)
    t = Tokenizer.from_file(path)
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = sorted(map(tuple, tokenbin.read(spark, str(tmp_path / "s"), with_ids=True).collect()))
    start = 0
    for k, t_ in enumerate([*rows, rows[-1]]):
        ids = [*t.encode(t_ or "", add_special_tokens=False).ids, 2]
        assert got[k] == (min(k, len(rows) - 1), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    tokenbin.write(docs.limit(0), str(tmp_path / "none"), path, 2)
    assert tokenbin.read(spark, str(tmp_path / "none")).count() == 0


def _proto(pieces, kind):
    """A small model's protobuf."""
    import struct

    def field(number, wire, value):
        return bytes([number << 3 | wire]) + (value if wire != 2 else bytes([len(value)]) + value)

    out = b""
    for piece, score, t in pieces:
        out += field(1, 2, field(1, 2, piece.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([t])))
    return out + field(2, 2, field(3, 0, bytes([kind]))) + field(3, 2, field(1, 2, b"identity"))


def test_sentencepiece_parity(spark):
    import sentencepiece

    path = Q.tokenizer_file("piece_bpe_32k.model")
    r = random.Random(0)
    rows = texts(6) + ODD + ["".join(r.choice(" a▁b\n the😀é<0x41>") for _ in range(r.randint(0, 60))) for _ in range(200)] + [" " * 37 + "z" + " " * 19]
    got = {x["id"]: x for x in sentencepieces.encoded(documents(spark, rows), path).collect()}
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    for k, t in enumerate(rows):
        want = processor.encode(t or "")
        assert got[k]["token_ids"] == want and got[k]["parity"]
        assert (got[k]["decoded"] if not got[k]["lossless"] else t or "") == processor.decode(want)
    assert sentencepieces.encoded(documents(spark, rows).limit(0), path).count() == 0


def test_sentencepiece_parity_sees_faults_of_cutting():
    with open(Q.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        codec = sentencepieces.Codec(f.read())
    rows = ["a  b", " a b", "a b ", "a▁b", "a b"]
    assert codec.encode(rows)[1] == [True] * 5
    codec._cut = lambda text: text.replace("▁", " ").split()
    assert codec.encode(rows)[1] == [False, False, False, True, True]


def test_sentencepiece_unigram_parity():
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("▁th", -2.5, 1), ("he", -2.7, 1), ("▁the", -3.0, 1), ("n", -4.0, 1), ("t", -4.1, 1), ("h", -4.2, 1), ("e", -4.3, 1)]
    data = _proto(pieces, 1)
    codec = sentencepieces.Codec(data, parity=False)
    processor = sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in ("the then hen", "  the   n ", "", "then", "teeth he"):
        assert np.frombuffer(codec.encode([t])[0][0], "<u4").tolist() == processor.encode(t), t


def test_pipeline_keeps_columns_and_takes_effect(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    rows = [" ".join(f"w{r.randint(0, 3000)}" for _ in range(60)) for _ in range(60)]
    rows += [rows[0], rows[1].replace(" ", "  ", 1)]
    item = " ".join(f"q{r.randint(0, 900)}" for _ in range(30))
    rows.append("before " + item + " after")
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(60)) and all(x["lossless"] and x["parity"] for x in out.values())


def test_marked_lines_are_picked_from_texts():
    """Lines are cut from the raw texts, and only marked ones, so words are looked for in no others."""
    texts = ["a b\nÄ c\n", None, "", "\n\nx", "one"]
    want = [(t, k, line) for t, text in enumerate(texts) for k, line in enumerate((text or "").split("\n"))]
    text, number, lines = linededup.picked(pa.array(texts), lambda text, number: np.ones(len(text), dtype=bool))
    assert list(zip(text.tolist(), number.tolist(), lines.to_pylist())) == want
    text, number, lines = linededup.picked(pa.array(texts), lambda text, number: number == 1)
    assert list(zip(text.tolist(), number.tolist(), lines.to_pylist())) == [w for w in want if w[1] == 1]


def test_words_of_one_bucket_have_one_order_in_all_batches():
    """Two words of equal rank stand in the same order in a batch of one line and in one of many."""
    words = [f"w{k}" for k in range(200)]
    ranks = np.zeros(linededup.BUCKETS, dtype=np.int32)
    line = " ".join(words)
    few = linededup.Lines(pa.array([line]), ranks, 0.8)
    many = linededup.Lines(pa.array([line + "\nx" * 70_000]), ranks, 0.8)
    assert few.h.tolist() == many.h[many.line == 0].tolist()


def test_sentencepiece_lets_units_go_after_a_task(monkeypatch):
    """A worker outlives its task: then it holds few units, and no tokenizer that its model doesn't use."""
    path = Q.tokenizer_file("piece_bpe_32k.model")
    with open(path, "rb") as f:
        data = f.read()
    codec = sentencepieces.Codec(data, most=40, kept=10)
    monkeypatch.setattr(sentencepieces, "_codec", lambda model: codec)
    rows = [" ".join(f"w{k + n}" for n in range(30)) for k in range(100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(rows)], names=["id", "text"])] * 2
    names = ["id", "token_ids", "n_tokens", "ids_crc32", "parity", "lossless", "decoded"]
    got = [ids for b in sentencepieces._encoded(iter(batches), path, names) for ids in b.column("token_ids").to_pylist()]
    assert got == [list(i) for i in codec.check.encode(rows)] * 2
    assert len(codec.units) == 10 and "whole" not in codec.__dict__


def test_line_dedup_ships_and_cuts_texts_once(spark):
    plan = linededup.deduplicated(documents(spark, ["a b c d\ne", "a b c d\nf"]))._jdf.queryExecution().optimizedPlan()
    joins = [plan.children().apply(0)]
    while not joins[0].nodeName().startswith("Join"):
        joins = [joins[0].children().apply(0)]
    left = joins[0].children().apply(0).output()
    assert [left.apply(k).name() for k in range(left.size())] == ["row", "k", "th"]
    assert plan.toString().count("split(") == 1
