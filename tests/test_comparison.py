"""The comparison's plans, evidence, solvers, bands, terms and rules against plain versions."""

import dataclasses
import itertools
import json
import random
import resource
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paralens import queries as Q
from paralens.functions import text as tx
from paralens.operators import detectors, evidence, grouping, groupwise, matching, pages, solvers, terms
from paralens.plans.compare import compare
from paralens.plans.profile import Profile
from paralens.plans.rules import Rules, as_row, by_pair, profile_table
from paralens.sources import fixtures, scan, tables
from tests.test_engine import BLOCK, PAGE, pairs

BOX = {"x", "y", "width", "height"}


@pytest.fixture(scope="module")
def made(spark):
    """A comparison of the hand-made pairs, and its tables."""
    blocks = [(name, *b[1:]) for name, rows in pairs().items() for b in rows]
    pages = spark.createDataFrame([(*k, 200.0, 240.0, None, []) for k in sorted({b[:3] for b in blocks})], PAGE)
    glossary = spark.createDataFrame([("g", 1, 0, "AI", ["人工智能"], "note", False)], "glossary_id string, version int, term_ord int, term string, translations array<string>, note string, case_sensitive boolean")
    out = compare(pages, spark.createDataFrame(blocks, BLOCK), glossary=glossary)
    return out, out.issues.collect()


def test_issues_tell_the_keys_of_their_type(made):
    _, rows = made
    seen = set()
    for row in rows:
        told = json.loads(row["metrics"])
        kind = "extra_page" if row["type"] == "added_element" and row["detector"] == "page" else row["type"]
        keys = list(evidence.KEYS[kind])
        if row["source_region"] is None and kind in ("text_fragmented", "invisible_text", "number_mismatch"):
            keys = [k for k in keys if not k.startswith("source_") or k == "source_numbers" or (k == "source_text" and kind != "number_mismatch")]
        if row["target_region"] is None and kind == "number_mismatch":
            keys = [k for k in keys if not k.startswith("target_") or k == "target_numbers"]
        assert list(told) == keys
        assert all(set(told[k]) == BOX for k in told if k.endswith("_bbox") and told[k])
        seen.add(kind)
    assert {"page_missing", "missing_image", "region_shifted", "font_shrink", "text_rasterized", "text_alignment_changed", "text_image_overlap", "number_mismatch", "untranslated_text", "glossary_violation"} <= seen


def test_what_is_told_of_the_image_wins_over_the_text(made):
    told = next(json.loads(r["metrics"]) for r in made[1] if r["type"] == "text_rasterized")
    assert told["target_region_type"] == "image" and told["target_bbox"] == told["invisible_text_bbox"] and told["match_type_similarity"] == 1.0
    spread = next(json.loads(r["metrics"]) for r in made[1] if r["type"] == "text_alignment_changed")
    assert set(spread["source_spreads"]) == {"left", "right", "center", "confidence"} and spread["source_text"].startswith("one more line")


def test_detectors_move_no_rows(made):
    """Tables lie by page pair, so only side tables of a few rows are sent around."""
    out, _ = made
    for raised, make in detectors.DETECTORS:
        if raised == ("glossary_violation",):
            continue
        plan = make(out)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan, (raised, plan)


def test_tables_meet_without_broadcasts(made):
    """Rows that grow with the input never pass through the driver, however small their packed files look to the planner."""
    out, _ = made
    made = {"unmatched": matching.unmatched(out.source, out.target, out.matches)[0], "flows": detectors.alignment_issues(out), "geometry": detectors.geometry_issues(out), "laid": matching.laid(out.matches, out.source, out.target), "sheets": matching.sheets(out.regions, out.pages, out.entries, out.rules)}
    plans = {name: rows._jdf.queryExecution().executedPlan().toString() for name, rows in made.items()}
    assert [name for name, plan in plans.items() if "SortMergeJoin" not in plan or "Broadcast" in plan] == []


def test_blocks_are_dealt_once_for_their_regions(spark):
    """Medians, groups and reading order share one shuffle, and a reader of few columns carries these only and writes nothing."""
    b = fixtures.blocks(spark.createDataFrame([(1, "one line of text\nand two")], "doc_id long, text string"))
    c = compare(fixtures.pages(b), b, split=False)
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    assert plan(c.regions_once).count("Exchange hashpartitioning") == 1
    few = plan(c.regions_once.select("pair_id", "side", "page", "region_id", "above", "below"))
    assert few.count("Exchange hashpartitioning") == 1 and "translate(" not in few
    assert not {"blocks", "pages", "regions"} & set(c.__dict__)


def test_texts_are_dealt_once(spark):
    """What lies by pair stays where it is up to the matches, blocks that are read once are not stored, and brief issues leave texts alone."""
    b = fixtures.blocks(spark.createDataFrame([(1, "one line of text\nand two"), (12, "three\nfour")], "doc_id long, text string"))
    c = compare(fixtures.pages(b), b, split=False, paired=fixtures.true_pages(b), matched=fixtures.true_matches(b))
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    c.source, c.matches  # noqa: B018
    made = [*matching.on_sheets(c.regions, c.sheets), matching.laid(c.matches, c.source, c.target)]
    assert ["Exchange" in plan(rows) for rows in made] == [False] * 3
    assert "blocks" not in c.__dict__
    assert "evidence" not in c.brief_issues.columns and "typed_issues" not in c.__dict__
    assert sorted(map(tuple, c.brief_issues.collect())) == sorted(map(tuple, c.typed_issues.drop("evidence").collect()))
    assert c.documents.count() == 2


def test_script_patterns_are_single_classes(spark):
    """Counts, acronyms and numbers are what the longer patterns found."""
    r = random.Random(4)
    parts = ["A", "AB", "ABC", "aB", "é", "ÉA", " ", ".", "-", "_", "1", "1,234", "12,3456.7", "１２", "٣", "新", "ひ", "한", "Ж", "ﬁ", "\u0301"]
    rows = [("".join(r.choices(parts, k=r.randint(0, 14))),) for _ in range(1500)]
    t = F.col("t")
    old = {"any": "|".join(tx.SCRIPTS.values()), "acronym": r"(?U)\b[A-Z]{2,}\b", "number": r"(?U)\d+(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"}
    new = {"any": tx.ANY_SCRIPT, "acronym": tx.ACRONYM, "number": tx.NUMBER}
    df = spark.createDataFrame(rows, "t string").select("t", *[F.regexp_replace(t, p, "<>").alias(f"{k}_{n}") for n, ps in (("old", old), ("new", new)) for k, p in ps.items()])
    differs = df.where("any_old <> any_new or acronym_old <> acronym_new or number_old <> number_new")
    assert differs.count() == 0
    assert "|" not in tx.ANY_SCRIPT


def test_tables_are_deleted(spark):
    b = fixtures.blocks(spark.createDataFrame([(1, "one line of text\nand two")], "doc_id long, text string"))
    c = compare(fixtures.pages(b), b, Profile(align_pages=False), split=False)
    files = c.target.inputFiles()
    assert files and c.typed_issues is not None
    c.forget()
    again = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not again.getFileSystem(spark._jsc.hadoopConfiguration()).exists(again)
    assert tables.shared(spark)


def hungarian(cost):
    """Row by row with potentials, as in textbooks; the least total cost."""
    n, m = len(cost), len(cost[0])
    u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0], i0, delta, j1 = True, p[j0], float("inf"), -1
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not p[j0]:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return sum(cost[p[j] - 1][j - 1] for j in range(1, m + 1) if p[j])


def test_assignment_against_a_plain_one():
    r = np.random.default_rng(7)
    greedy_wrong = 0
    for t in range(150):
        n = int(r.integers(2, 25))
        m = n if t % 3 == 0 else int(r.integers(n, 30))
        s = [r.random((n, m)), r.integers(0, 4, (n, m)) / 3, 1 - np.abs(np.subtract.outer(r.random(n), r.random(m)))][t % 3]
        pairs_ = solvers.assign(s)
        total = sum(1 - s[i, j] for i, j in pairs_)
        assert len({j for _, j in pairs_}) == n and abs(total - hungarian((1 - s).tolist())) < 1e-9
        left, greedy = set(range(m)), 0.0
        for i in range(n):
            j = max(left, key=lambda j: s[i, j])
            left.discard(j)
            greedy += 1 - s[i, j]
        greedy_wrong += greedy > total + 1e-9
        assert sorted((j, i) for i, j in solvers.assign(s.T)) == sorted(pairs_) or abs(sum(1 - s[j, i] for i, j in solvers.assign(s.T)) - total) < 1e-9
    assert greedy_wrong > 50


def alignments(source, target, similarity):
    """All monotone alignments as lists of pairs."""
    allowed = [p for p in itertools.product(source, target) if p in similarity]
    for k in range(min(len(source), len(target)) + 1):
        for some in itertools.combinations(allowed, k):
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(some, some[1:])):
                yield list(some)


def test_alignment_against_all_alignments():
    r = random.Random(11)
    moved = 0
    for t in range(250):
        source = sorted(r.sample(range(1, 9), r.randint(1, 4)))
        target = sorted(r.sample(range(1, 9), r.randint(1, 4)))
        near = {(a, b): r.choice([0.1, 0.5, 0.9, 0.9]) + r.choice([0.0, 0.0, 0.004, 0.011]) for a in source for b in target if abs(a - b) <= 4}
        skip, margin = 0.5, 0.01
        worth = lambda ps: sum(near[p] for p in ps) - skip * (len(source) + len(target) - 2 * len(ps))  # noqa: B023, E731
        best = max(map(worth, alignments(source, target, near)))
        pairs_, missing, extra = solvers.align_pages(source, target, near, skip, margin)
        same = [p for p in ((a, a) for a in source) if p[1] in target]
        plain = sum(near.get(p, 0.0) for p in same) - skip * (len(source) + len(target) - 2 * len(same))
        if pairs_ == same:
            # the plain pairs stay unless each other pair earns the margin
            assert any(worth(ps) >= best - 1e-9 and best <= plain + margin * len(set(ps) - set(same)) + 1e-9 for ps in alignments(source, target, near))
        else:
            moved += 1
            assert abs(worth(pairs_) - best) < 1e-9 and best > plain + margin * len(set(pairs_) - set(same)) - 1e-9
        assert sorted([a for a, _ in pairs_] + missing) == source and sorted([b for _, b in pairs_] + extra) == target
    assert moved > 60


def test_alignment_of_many_pages_with_gaps():
    n = 600
    source, target = list(range(1, n + 1)), list(range(1, n + 1))
    true = lambda a: a + (a > 200) - (a > 400)  # noqa: E731  a page more after 200, one less after 400
    near = {(a, b): 0.95 if b == true(a) else 0.2 for a in source for b in target if abs(a - b) <= 3}
    began = time.time()
    pairs_, missing, extra = solvers.align_pages(source, target, near, 0.5, 0.01)
    assert time.time() - began < 0.5
    assert extra == [201] and len(missing) == 1 and missing[0] in (400, 401) and len(pairs_) == n - 1


def test_span_parts_against_all_pairs():
    r = np.random.default_rng(3)
    for t in range(120):
        n = int(r.integers(1, 60))
        x, y = r.integers(0, 300, n) * 1.0, r.integers(0, 200, n) * 1.0
        w, h = r.integers(1, 40, n) * 1.0, r.integers(5, 15, n) * 1.0
        root = list(range(n))
        for _ in range(n):
            for a, b in itertools.combinations(range(n), 2):
                limit = max(h[a], h[b]) * 1.5
                across, down = max(x[a], x[b]) - min(x[a] + w[a], x[b] + w[b]), max(y[a], y[b]) - min(y[a] + h[a], y[b] + h[b])
                if (down <= 0 and across <= limit) or (down <= limit and (across <= 0 or abs(x[a] - x[b]) <= limit)):
                    root[a] = root[b] = min(root[a], root[b])
            if t % 4 and n > 20:
                break
        if t % 4 and n > 20:
            continue
        heads = sorted(set(root), key=lambda k: (min(y[i] for i in range(n) if root[i] == k), min(x[i] for i in range(n) if root[i] == k)))
        got = solvers.span_parts(x, y, w, h, 1.5)
        assert len(set(got.tolist())) == len(heads)
        assert {tuple(np.flatnonzero(got == k)) for k in set(got.tolist())} == {tuple(i for i in range(n) if root[i] == k) for k in heads}


def test_many_spans_take_little_memory():
    n = 50_000
    x, y = np.tile(np.arange(10) * 60.0, n // 10), np.repeat(np.arange(n // 10) * 20.0, 10)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    part = solvers.span_parts(x, y, np.full(n, 20.0), np.full(n, 5.0), 3.0)
    assert len(set(part.tolist())) == 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_bands_meet_every_pair_once(spark):
    r = random.Random(9)
    boxes = [("a", 1, k, r.uniform(-20, 500), r.uniform(-50, 820), r.uniform(1, 60), r.choice([5.0, 8.0, 200.0])) for k in range(300)]
    side = lambda p: spark.createDataFrame(boxes, f"pair_id string, report_page int, {p}k int, {p}x double, {p}y double, {p}width double, {p}height double")
    paper = {"sp_height": F.lit(800.0), "tp_height": F.lit(800.0)}
    for bands in (1, 7, 40):
        left = side("t_").withColumns(paper | {"bands": F.lit(bands)})
        right = matching.banded(side("o_").withColumns(paper | {"bands": F.lit(bands)}), "o_").drop("bands", *paper)
        got = [tuple(x) for x in matching.meeting(left, "t_", right, "o_").select("t_k", "o_k").collect()]
        want = {(a[2], b[2]) for a in boxes for b in boxes if a[4] < b[4] + b[6] and b[4] < a[4] + a[6]}
        assert len(got) == len(set(got)) and set(got) == want


def test_candidates_of_large_pages_grow_with_the_regions(spark):
    sizes = {}
    for n in (2_000, 8_000):
        rows = spark.range(n).select(F.lit("a").alias("pair_id"), F.lit(1).alias("report_page"), F.col("id").alias("t_k"), F.lit(0.0).alias("t_x"), (F.col("id") * (800.0 / n)).alias("t_y"), F.lit(9.0).alias("t_width"), F.lit(800.0 / n * 0.9).alias("t_height"))
        rows = rows.withColumns({"sp_height": F.lit(800.0), "tp_height": F.lit(800.0), "bands": F.lit(2 * n // matching.BAND_REGIONS)})
        sizes[n] = rows.transform(lambda d: matching.banded(d, "t_")).alias("l").join(matching.banded(rows, "t_").alias("r"), ["pair_id", "report_page", "band"]).count()
    assert sizes[8_000] < 5 * sizes[2_000] and sizes[8_000] < 40 * 8_000


def test_terms_against_a_search_for_each():
    r = random.Random(4)
    words = ["AI", "ai", "Said", "人工", "人工智能", "a-b", "C++", "naïve", "x_y", "İs", "技术AI", "..", "e"]
    known = [(r.choice(words) + r.choice(["", " ", "s", "术"]) + r.choice(["", "ai", "人"]), r.random() < 0.5) for _ in range(300)]
    automaton = terms.Automaton(known)
    for _ in range(200):
        text = "".join(r.choice([*words, " ", ".", "的", "said "]) for _ in range(r.randint(0, 12)))
        low = terms.folded(text)
        assert automaton.find(text, low) == {k for k, (t, case) in enumerate(known) if terms.stands(text, low, t, case)}
    assert terms.stands("he said AI.", "he said ai.", "ai", False) and not terms.stands("raining", "raining", "ai", False) and terms.stands("人工智能技术", "人工智能技术", "智能", True)


def test_a_hundred_thousand_terms(spark):
    known = [("g", 1, k, f"term{k:06d}" if k % 3 else f"术{k:06d}语", ["translation"], None, bool(k % 2)) for k in range(100_000)]
    glossary = spark.createDataFrame(known, "glossary_id string, version int, term_ord int, term string, translations array<string>, note string, case_sensitive boolean")
    texts = [(k, f"some TERM{k:06d} and term{k + 1:06d}, 的术{3 * k:06d}语的", "a translation" if k % 4 == 0 else "nothing") for k in range(1, 200)]
    rows = spark.createDataFrame(texts, "n int, s_text string, t_text string")
    got = {(r["n"], r["g_term_ord"]) for r in terms.breaches(rows, glossary, group_bytes=2 << 20).collect()}
    by_text = {}
    for _, _, k, term, _, _, case in known:
        by_text[term] = (k, case)
    want = set()
    for n, _, t in texts:
        if t == "nothing":
            upper = by_text.get(f"term{n:06d}")
            want |= {(n, upper[0])} if upper and not upper[1] else set()
            for term in (f"term{n + 1:06d}", f"术{3 * n:06d}语"):
                want |= {(n, by_text[term][0])} if term in by_text else set()
    assert got == want and len(want) > 250


def test_profile_versions_by_pair(spark, made):
    """Pairs under their own profiles get what a comparison with that profile alone gives."""
    _, rows = made
    base = Profile()
    quiet = dataclasses.replace(base, profile_id="quiet", off=("overlap", "region_shifted", "text_rasterized"), minimum_score=0.6)
    spoken = dataclasses.replace(base, profile_id="spoken", language_off={"latin-cjk": ("number_mismatch",)}, language_bands={"latin-cjk": {"untranslated_bands": ((0.5, "low"),)}})
    profiles = [base, quiet, spoken]
    blocks = [(name, *b[1:]) for name, rows_ in pairs().items() for b in rows_]
    tagged = [(f"{name}/{p.profile_id}", *rest) for p in profiles for name, *rest in blocks]
    pages = spark.createDataFrame([(*k, 200.0, 240.0, None, []) for k in sorted({b[:3] for b in tagged})], PAGE)
    named = pages.select("pair_id").distinct().withColumn("reference", F.concat(F.substring_index("pair_id", "/", -1), F.lit("@1")))
    together = compare(pages, spark.createDataFrame(tagged, BLOCK), by_pair(named, profile_table(spark, profiles)))
    got = {}
    for r in together.typed_issues.collect():
        got.setdefault(r["pair_id"], set()).add((r["issue_id"], r["type"], r["severity"]))
    scores = {r["pair_id"]: (r["score"], r["status"]) for r in together.documents.collect()}
    for p in profiles:
        one = compare(spark.createDataFrame([(*k, 200.0, 240.0, None, []) for k in sorted({b[:3] for b in blocks})], PAGE), spark.createDataFrame(blocks, BLOCK), p)
        alone = {}
        for r in one.typed_issues.collect():
            alone.setdefault(r["pair_id"], set()).add((r["issue_id"], r["type"], r["severity"]))
        for r in one.documents.collect():
            name = f"{r['pair_id']}/{p.profile_id}"
            assert got.get(name, set()) == alone.get(r["pair_id"], set()) and scores[name] == (r["score"], r["status"])
    assert any(t == "number_mismatch" for _, t, _ in got["content/translation-balanced"]) and not any(t == "number_mismatch" for _, t, _ in got["content/spoken"])
    assert any(s == "low" for _, t, s in got["content/spoken"] if t == "untranslated_text")


def test_overrides_keep_their_switches_and_bands():
    p = Profile(language_off={"latin-arabic": ("number_mismatch",)}, language_bands={"latin-arabic": {"untranslated_bands": ((0.5, "low"),)}})
    q = Profile.from_published(json.dumps(p.published()))
    assert q.override("latin-arabic") == p.override("latin-arabic") and q.languages() == ["latin-arabic"]
    assert Profile.from_json(p.to_json()) == p
    assert not as_row(p)["overrides"]["latin-arabic"]["on"]["number_mismatch"] and as_row(p)["detectors"]["on"]["number_mismatch"]
    assert Rules(p).profile is p
    with pytest.raises(ValueError):
        Profile(language_off={"x": ("nothing",)})


def test_unknown_opacity_stays_unknown(spark):
    span = lambda text, alpha: {"text": text, "bbox": [1.0, 1.0, 9.0, 9.0], "size": 9.0, "flags": 0, "color": 0, "alpha": alpha, "font": "Serif"}
    blocks = [{"type": 0, "bbox": [0.0, 0.0, 9.0, 9.0], "lines": [{"spans": [span("a", None), span("b", 0), span("c", 300)]}]}, {"type": 1, "bbox": [0.0, 50.0, 50.0, 90.0], "width": 5, "height": 4, "ext": "png"}, {"type": 1, "bbox": [0.0, 50.0, 50.0, 90.0]}]
    rows = scan.blocks(spark.createDataFrame([("a", "source", 1, 100.0, 100.0, blocks, [])], scan.LAYOUT)).orderBy("block_ord").collect()
    assert [r["opacity"] for r in rows] == [None, 0.0, 1.0, None, None]
    assert [(r["font_family"], r["source_line_index"], r["source_span_index"]) for r in rows[:3]] == [("Serif", 0, 0), ("Serif", 0, 1), ("Serif", 0, 2)]
    assert [(r["asset_ref"], r["extension"], r["pixel_width"]) for r in rows[3:]] == [("block-1.png", "png", 5), ("block-2.bin", None, None)]


def _read(name, content):
    """A reader for tests: the file says what it is."""
    if content == b"locked":
        raise scan.Locked("secret")
    if content == b"broken":
        raise RuntimeError("no pages here")
    for k in range(int(content)):
        yield {"pair_id": name[-5:], "side": "source", "page": k + 1, "width": 1.0, "height": 1.0, "blocks": [], "fills": []}


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    for name, content in (("a", b"2"), ("b", b"locked"), ("c", b"broken"), ("d", b"501"), ("e", b"x" * 99)):
        (tmp_path / f"{name}.pdf").write_bytes(content)
    rows = scan.pdf_files(spark, str(tmp_path), _read, max_bytes=50).collect()
    assert sorted((r["path"][-5:], r["error"] or "") for r in rows) == [("a.pdf", ""), ("a.pdf", ""), ("b.pdf", "locked"), ("c.pdf", "broken"), ("d.pdf", "too_many_pages"), ("e.pdf", "too_large")]
    assert sorted(r["layout"]["page"] for r in rows if r["layout"]) == [1, 2]


def test_queries_share_a_comparison_of_equal_inputs(spark):
    folder = "/root/testdata/sf0.001"
    Q.forget()
    assert Q.known(spark, folder) is Q.known(spark, folder)
    assert Q.known(spark, folder, glossary=Q.glossary(spark)) is not Q.known(spark, folder)
    Q.forget()


def test_searched_records_have_the_verdicts_of_their_comparison(spark, tmp_path):
    rows = [(k, "\n".join(f"some words {k * n} of line {n}" for n in range(2 + 7 * (k % 3)))) for k in range(60, 81)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    failed = {r["pair_id"] for r in Q.QUERIES["document_report"](spark, str(tmp_path)).collect() if r["status"] == "fail"}
    named = {k for k in range(60, 80) if "7" in f"{k} {k + 1}"}
    found = {r["record_id"] for r in Q.QUERIES["history_search"](spark, str(tmp_path)).collect()}
    assert found == failed & named and failed & named not in (set(), named)


def test_stages_are_written_with_their_contents(spark, made, tmp_path):
    from paralens.sources import sinks

    out, rows = made
    totals = sinks.write_stages(out, str(tmp_path), "detect")
    assert set(totals) == {"parse", "group", "alignment", "match", "detect"} and totals["group"]["pairs"] == len(pairs())
    read = {name: {r["pair_id"]: json.loads(r["data"]) for r in spark.read.json(str(tmp_path / f"stage-{name}")).select("pair_id", F.to_json("data").alias("data")).collect()} for name in totals}
    assert read["group"]["lost"]["source"]["regions"] == 2 and read["group"]["lost"]["target"]["types"] == {"paragraph": 1}
    assert read["alignment"]["lost"]["missing_source_pages"] == [2] and read["alignment"]["same"]["pairs"] == [{"s_page": 1, "t_page": 1}]
    assert read["match"]["shift"][0]["matched"] == 1 and read["match"]["shift"][0]["unmatched_source"] == ["p1-r1"]
    assert sum(d["total"] for d in read["detect"].values()) == len(rows)


def _boxes(r, n):
    return {"type": r.choice(np.array(["image", "paragraph", "heading"], object), n), "x": r.integers(0, 400, n) * 1.0, "y": r.integers(0, 700, n) * 1.0, "width": r.integers(1, 90, n) * 1.0, "height": r.integers(1, 30, n) * 1.0, "region_ord": np.arange(n), "n": np.full(n, n)}


def test_many_page_pairs_are_assigned_at_once(monkeypatch):
    r = np.random.default_rng(5)
    paper = {"sp_width": 500.0, "sp_height": 800.0, "tp_width": 510.0, "tp_height": 700.0}
    weights = {"position": 0.4, "size": 0.3, "type": 0.2, "order": 0.1, "text_types": 0.5, "minimum_score": 0.6}
    parts, marks, want = [], [0], []
    for _ in range(300):
        n, m = (int(v) for v in r.integers(0, 9, 2))
        if not n + m:
            continue
        s, t = _boxes(r, n), _boxes(r, m)
        k = int(r.integers(0, min(n, m) + 1))
        for c in ("type", *BOX):
            t[c][:k] = s[c][:k]
        parts += [side | {"side": np.full(len(side["x"]), which)} for which, side in enumerate((s, t))]
        if n and m:
            one = {c: np.full(1, v) for c, v in paper.items()}
            alike = solvers.similarities(s | one, t | one, 0.5)
            total = 0.3 * alike[1] + 0.2 * alike[2] + 0.1 * alike[3] + 0.4 * alike[0]
            want += [(marks[-1] + i, marks[-1] + n + j) for i, j in solvers.assign(total) if total[i, j] >= 0.6]
        marks.append(marks[-1] + n + m)
    rows = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    rows |= {c: np.full(marks[-1], v) for c, v in (paper | {f"w_{w}": v for w, v in weights.items()}).items()}
    calls = []
    solve = solvers.assign
    monkeypatch.setattr(solvers, "assign", lambda table: calls.append(1) or solve(table))
    i, j, _ = solvers.assigned(rows, np.array(marks))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want) and len(calls) < len(marks) - 1


def test_pages_near_a_zone_are_read_once(spark, monkeypatch):
    """Target regions travel about once for each zone of source pages, not once for each source page near them."""
    r = np.random.default_rng(6)
    n = 150
    rows = [("a", side, p, k, "text", float(r.integers(0, 400)), float(r.integers(0, 700)), 50.0, 10.0) for side in ("source", "target") for p in range(1, n + 1) if p % 11 for k in range(p % 4)]
    regions = spark.createDataFrame(rows, "pair_id string, side string, page long, region_ord int, type string, x double, y double, width double, height double")
    paper = spark.createDataFrame([("a", side, p, 500.0, 800.0) for side in ("source", "target") for p in range(1, n + 1)], "pair_id string, side string, page long, width double, height double")
    seen = []
    inner = groupwise.per_groups
    monkeypatch.setattr(pages, "per_groups", lambda df, *more: seen.append(df.count()) or inner(df, *more))
    got = {(x["s_page"], x["t_page"]): x["similarity"] for x in pages.similarity(regions, paper, Rules(Profile())).collect()}
    assert seen[0] <= 1.3 * (len(rows) + 2 * n)
    assert set(got) == {(a, b) for a in range(1, n + 1) for b in range(1, n + 1) if abs(a - b) <= 3}
    held = {}
    for _, side, p, _, kind, *box in rows:
        held.setdefault((side, p), []).append((kind, *box))
    p = Profile()
    for (a, b), value in got.items():
        s, t = held.get(("source", a), []), held.get(("target", b), [])
        if not s or not t:
            assert value == (0.0 if s or t else 1.0)
            continue
        far = lambda u, v: ((u[1] - v[1]) ** 2 + (u[2] - v[2]) ** 2) ** 0.5 / (500.0**2 + 800.0**2) ** 0.5
        score = np.array([[(p.position * (1 - far(u, v)) + p.size + p.type) / (p.position + p.size + p.type) for v in t] for u in s])
        assert abs(value - (score.max(1).sum() + score.max(0).sum()) / max(score.shape) / 2) < 1e-9


def test_parts_of_two_and_of_more_blocks(spark):
    """Source blocks of one, two and more spans, also with unknown places, fall apart as the sweep says; two spans need no sweep."""
    r = np.random.default_rng(7)
    rows, want = [], {}
    for k in range(400):
        n = int(r.integers(1, 6))
        box = [[float(v) for v in (r.integers(0, 120), r.integers(0, 60), r.integers(1, 40), r.integers(5, 15))] for _ in range(n)]
        kinds = ["image" if r.random() < 0.05 else "text" for _ in range(n)]
        if r.random() < 0.05:
            box[0][2] = None
        rows += [("a", "source", k // 20 + 1, 10 * k + i, f"b{int(r.integers(0, 99)):02d}-{i}", kinds[i], *box[i], 10.0, "#000000", f"t{i}", k, 1.0) for i in range(n)]
        own = rows[-n:]
        whole = n == 1 or "image" in kinds
        part = np.zeros(n, int) if whole else solvers.span_parts(*np.array(box, dtype=float).T, Profile().span_gap_ratio)
        for p in set(part.tolist()):
            here = [b for b, q in zip(own, part) if q == p]
            order = here if whole else sorted(here, key=lambda b: (b[7], b[6], b[4], b[3]))
            want[f"p{k // 20 + 1}-r{k}" + (f"-c{p + 1}" if p else "")] = [b[4] for b in order]
    found = grouping.regions(spark.createDataFrame(rows, BLOCK), Profile(), buckets=3)
    assert {x["region_id"]: x["children"] for x in found.collect()} == want


def test_facts_of_texts_against_the_column_functions(spark):
    """What is made of texts in arrays is what the columns' patterns find, in texts of any script."""
    from paralens.operators import texts
    import pyarrow as pa

    r = random.Random(8)
    parts = ["A", "AB", "ABC", "aB", "é", "ÉA", " ", ".", "-", "_", "1", "1,234", "12,3456.7", "１２", "٣", "٫", "，", "007", "0.50", "新", "ひ", "한", "Ж", "ﬁ", "́", " ", "　", "\n", "Ⓐ", "😀", "‍", ",", "0", "ก", "ب", "ב", "α", "क", "ক"]
    rows = [("".join(r.choices(parts, k=r.randint(0, 14))),) for _ in range(2000)] + [("",)]
    t = F.col("t")
    columns = {"chars": F.length(t), "solid": F.length(F.regexp_replace(t, r"(?U)\s", "")), "capitals": F.length(t) - F.length(tx.without_acronyms(t)), "letters": F.regexp_count(t, F.lit(r"\p{L}")), "counts": F.array(*[tx.count_of(t, p) for p in tx.SCRIPTS.values()]), "numbers": tx.numbers(t)}
    want = spark.createDataFrame(rows, "t string").select("t", *[v.alias(k) for k, v in columns.items()], tx.letters(t).alias("every")).collect()
    every = np.ones(len(want), dtype=bool)
    found = texts.facts(pa.array([w["t"] for w in want]), every, every)
    assert {k: [(w["t"], w[k], v) for w, v in zip(want, found[k].to_pylist()) if w[k] != v] for k in texts.FACTS} == {k: [] for k in texts.FACTS}
    assert all(w["every"] == sum(w["counts"]) for w in want)


def test_brief_issues_are_those_with_evidence(spark):
    """No text is moved or written for issues without evidence, and they and the verdicts are the same, whatever the parts and the rules."""
    blocks = [(name, *b[1:]) for name, rows in pairs().items() for b in rows]
    joined = [(("two", side, 1, k, f"b{k}", "text", 20.0, 20.0 + 22 * k, 140.0, 20.0, 12.0, "#000000", words[k], 0, 1.0)) for side, words in (("source", ["The year 2024", "had 1,137 days"]), ("target", ["The AI year 2024", "stays as before"])) for k in range(2)]
    blocks += joined
    pages_ = spark.createDataFrame([(*k, 200.0, 240.0, None, []) for k in sorted({b[:3] for b in blocks})], PAGE)
    rows = spark.createDataFrame(blocks, BLOCK)
    names = pages_.select("pair_id").distinct().withColumn("reference", F.lit(Profile().reference))
    for rules in (Profile(), by_pair(names, profile_table(spark, [Profile()]))):
        brief, full = compare(pages_, rows, rules), compare(pages_, rows, rules)
        issues = full.typed_issues.drop("evidence")
        assert sorted(map(str, brief.brief_issues.select(issues.columns).collect())) == sorted(map(str, issues.collect())) != []
        assert sorted(map(str, brief.documents.collect())) == sorted(map(str, full.documents.collect()))
        assert not {"regions", "source", "target", "laid"} & set(brief.__dict__)
        assert brief.brief.laid.where("s_text is not null or t_text is not null").count() == 0


def test_flows_of_many_groups_are_those_of_each():
    r = np.random.default_rng(7)
    for _ in range(10):
        sizes = r.integers(1, 14, 40).tolist() + [90]
        y = np.concatenate([np.sort(r.integers(0, 12 * max(1, n // 8), n) * 9.0) for n in sizes])
        n = len(y)
        rows = {"x": r.integers(0, 60, n) * 1.0, "y": y, "width": r.integers(5, 60, n) * 1.0, "height": r.integers(8, 14, n) * 1.0, "type": r.choice(["paragraph", "heading"], n).astype(object), "font_size": r.choice([10.0, 10.5, 14.0, np.nan], n)}
        marks = np.append(0, np.cumsum(sizes))
        ratios = [r.choice(v, len(sizes)) for v in ([0.6, 0.3], [0.25, 0.1], [0.3, 0.5], [0.15, 0.05])]
        each = [solvers.flows(*[rows[k][a:b] for k in ("x", "y", "width", "height", "type", "font_size")], *[float(v[k]) for v in ratios]) for k, (a, b) in enumerate(zip(marks[:-1], marks[1:]))]
        assert solvers.flows_of(rows, marks, *ratios).tolist() == np.concatenate(each).tolist()
