"""The comparison engine on small hand-made pairs, and its sequential solvers against brute force."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paralens.functions import geometry as g
from paralens.functions import text as tx
from paralens.operators import grouping, scoring, solvers, store
from paralens.plans.compare import compare, stages
from paralens.plans.profile import Profile
from paralens.sources import scan

BLOCK = "pair_id string, side string, page int, block_ord int, block_id string, type string, x double, y double, width double, height double, font_size double, color string, text string, source_block_index int, opacity double"
PAGE = "pair_id string, side string, page int, width double, height double, background_color string, dark_boxes array<struct<x:double,y:double,width:double,height:double>>"


def block(side, page, k, box, text="body text here", kind="text", font=12.0, color="#000000", opacity=1.0, pair="a"):
    none = kind == "image"
    return (pair, side, page, k, f"p{page}-b{k}", kind, *map(float, box), None if none else font, None if none else color, None if none else text, k, None if none else opacity)


def pairs():
    """Blocks of all hand-made pairs, by name."""
    def page(side, lefts, widths):
        return [block(side, 1, k, (x, 20 + 18 * k, w, 16), f"one more line of text {k}") for k, (x, w) in enumerate(zip(lefts, widths))]

    chinese = "二零二四年报告内容已经翻译完成"
    text, image = (20, 30, 100, 20), {"kind": "image"}
    return {
        "same": [block(s, 1, k, (10, 10 + 40 * k, 100, 20), f"line number {k}") for s in ("source", "target") for k in range(3)],
        "shift": [block("source", 1, 0, (10, 10, 100, 20)), block("source", 1, 1, (10, 80, 80, 60), **image), block("target", 1, 0, (45, 10, 100, 20), font=7.0)],
        "raster": [block("source", 1, 0, text), block("target", 1, 0, text, opacity=0.0), block("target", 1, 1, text, **image)],
        "visible": [block("source", 1, 0, text), block("target", 1, 0, text), block("target", 1, 1, text, **image)],
        "merged": [block("source", 1, 0, (10, 10, 100, 20)), block("source", 1, 1, (10, 35, 100, 20)), block("target", 1, 0, (10, 10, 100, 50))],
        "flow": page("source", [80, 50, 100, 60], [100, 130, 80, 120]) + page("target", [20, 20, 20, 20], [120, 90, 130, 100]),
        "lost": [block("source", 1, 0, (10, 10, 100, 20)), block("source", 2, 0, (10, 10, 100, 20)), block("target", 1, 0, (10, 10, 100, 20))],
        "overlap": [block("source", 1, 0, (0, 100, 200, 100), **image), block("source", 1, 1, (20, 20, 100, 30)), block("target", 1, 0, (0, 100, 200, 100), **image), block("target", 1, 1, (20, 110, 100, 30))],
        "content": [
            block("source", 1, 0, (20, 20, 160, 20), "In 2024 growth was 15% overall"),
            block("source", 1, 1, (20, 80, 160, 20), "Untranslated sentence stays"),
            block("source", 1, 2, (20, 140, 160, 20), "The AI said 1,137"),
            block("target", 1, 0, (20, 20, 160, 20), "2024 " + chinese),
            block("target", 1, 1, (20, 80, 160, 20), "Untranslated sentence stays"),
            block("target", 1, 2, (20, 140, 160, 20), chinese + " 1137"),
        ],
    }


@pytest.fixture(scope="module")
def found(spark):
    """One comparison of all pairs; issues by pair."""
    blocks = [(name, *b[1:]) for name, rows in pairs().items() for b in rows]
    keys = sorted({b[:3] for b in blocks})
    pages_ = spark.createDataFrame([(*k, 200.0, 240.0, None, []) for k in keys], PAGE)
    terms = spark.createDataFrame([("g", 1, 0, "AI", ["人工智能"], None, False), ("g", 1, 1, "aid", ["援助"], None, False)], "glossary_id string, version int, term_ord int, term string, translations array<string>, note string, case_sensitive boolean")
    out = compare(pages_, spark.createDataFrame(blocks, BLOCK), glossary=terms)
    by_pair = {name: [] for name in pairs()}
    for row in out.issues.collect():
        by_pair[row["pair_id"]].append(row)
    return out, by_pair, {r["pair_id"]: r for r in out.documents.collect()}


def kinds(rows):
    return sorted((r["type"], r["severity"]) for r in rows)


def test_assignment_is_optimal():
    r = np.random.default_rng(1)
    for t in range(200):
        n, m = r.integers(1, 6, 2)
        s = r.integers(0, 5, (n, m)) / 4 if t % 2 else r.random((n, m))
        pairs = solvers.assign(s)
        a = s if n <= m else s.T
        best = max(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
        assert abs(sum(s[i, j] for i, j in pairs) - best) < 1e-9
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)
    assert solvers.assign(np.zeros((0, 3))) == []


@pytest.mark.parametrize(
    "source, target, similar, expected",
    [
        ([1, 2, 3, 4], [2, 3, 4, 5], lambda a, b: 1.0 if b == a + 1 else 0.5, ([(1, 2), (2, 3), (3, 4), (4, 5)], [], [])),
        ([1, 2, 3, 4], [2, 3, 4], lambda a, b: 1.0 if b == a + 1 else 0.5, ([(1, 2), (2, 3), (3, 4)], [4], [])),
        ([1, 2, 3], [1, 2, 3], lambda a, b: 0.9, ([(1, 1), (2, 2), (3, 3)], [], [])),
        ([1], [], lambda a, b: 1.0, ([], [1], [])),
    ],
)
def test_page_alignment(source, target, similar, expected):
    values = {(a, b): similar(a, b) for a in source for b in target if abs(a - b) <= 3}
    assert solvers.align_pages(source, target, values, 0.5, 0.01) == expected


def test_same_pages_have_no_comparative_issue(found):
    out, issues, documents = found
    assert kinds(issues["same"]) == [] and documents["same"]["score"] == 100.0 and documents["same"]["status"] == "pass"
    same = out.matches.where("pair_id = 'same'")
    assert same.count() == 3 and same.agg(F.min("score")).first()[0] > 0.9
    assert set(stages(out)) == {"parse", "group", "alignment", "match", "detect", "report"}


def test_shift_shrink_and_missing_image(found):
    _, issues, documents = found
    assert kinds(issues["shift"]) == [("font_shrink", "high"), ("missing_image", "critical"), ("region_shifted", "high")]
    assert documents["shift"]["status"] == "fail"


def test_rasterized_text_takes_its_image_and_text(found):
    _, issues, _ = found
    assert kinds(issues["raster"]) == [("text_rasterized", "high")]
    assert ("added_element", "low") in kinds(issues["visible"]) and ("text_rasterized", "high") not in kinds(issues["visible"])


def test_merged_text_is_not_missing(found):
    assert "missing_element" not in {k for k, _ in kinds(found[1]["merged"])}


def test_flow_alignment_change_explains_its_lines(found):
    names = [k for k, _ in kinds(found[1]["flow"])]
    assert names.count("text_alignment_changed") == 1 and "region_shifted" not in names


def test_new_overlap_of_text_and_image(found):
    assert ("text_image_overlap", "critical") in kinds(found[1]["overlap"])


def test_missing_page(found):
    _, issues, documents = found
    assert ("page_missing", "critical") in kinds(issues["lost"]) and documents["lost"]["status"] == "fail"


def test_numbers_scripts_and_terms(found):
    rows = {r["type"]: r for r in found[1]["content"]}
    assert '"missing_numbers":["15"]' in rows["number_mismatch"]["metrics"]
    assert rows["untranslated_text"]["target_region"] == "p1-r1"
    assert [r["issue_id"][-3:] for r in found[1]["content"] if r["type"] == "glossary_violation"] == ["-AI"]


def test_sinks(found, tmp_path):
    from paralens.sources import sinks

    out, _, _ = found
    sinks.html_report(out, "shift", str(tmp_path / "r.html"))
    assert "missing_image" in (tmp_path / "r.html").read_text()
    assert len(sinks.issue_sheet(out.issues).columns) == 13
    assert sinks.pages_to_show(out).where("pair_id = 'same'").count() == 0


def test_grouping_splits_far_labels_and_keeps_lines(spark):
    rows = [("a", "source", 1, 0, "x", "text", 10.0, 10.0, 40.0, 10.0, 12.0, None, "one", 0, None), ("a", "source", 1, 1, "y", "text", 10.0, 25.0, 40.0, 10.0, 12.0, None, "two", 0, None)]
    far = [("a", "source", 2, 0, "x", "text", 10.0, 10.0, 20.0, 10.0, 12.0, None, "left", 0, None), ("a", "source", 2, 1, "y", "text", 150.0, 10.0, 20.0, 10.0, 12.0, None, "right", 0, None)]
    found = {(r["page"], r["region_id"]): r for r in grouping.regions(spark.createDataFrame(rows + far, BLOCK), Profile()).collect()}
    assert set(found) == {(1, "p1-r0"), (2, "p2-r0"), (2, "p2-r0-c2")}
    assert found[1, "p1-r0"]["text"] == "one\ntwo" and found[1, "p1-r0"]["height"] == 25.0 and found[1, "p1-r0"]["children"] == ["x", "y"]
    assert found[2, "p2-r0"]["below"] == "p2-r0-c2"


def test_number_tokens_and_language_tags(spark):
    df = spark.createDataFrame([("1,137.5 and 007 and 0.50",), ("２０２４年",), (None,)], "t string").select(tx.numbers(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [["1137.5", "7", "0.50"], ["2024"], []]
    tags = spark.createDataFrame([(" ZH-hans-cn",), ("und",), ("x",), (None,)], "t string").select(tx.language_tag(F.col("t")).alias("n"))
    assert [r["n"] for r in tags.collect()] == ["zh-Hans-CN", "und", None, None]
    hits = spark.createDataFrame([("he said AI.", "AI"), ("he said", "AI"), ("raining", "AI"), ("用AI的", "AI"), ("人工智能技术", "智能")], "t string, w string")
    assert [r[0] for r in hits.select(tx.term_hit(F.col("t"), F.col("w"), F.lit(False))).collect()] == [True, False, False, False, True]
    colors = spark.createDataFrame([("#FFFFF0",), ("red",), (None,)], "c string").select(g.min_channel(F.col("c")).alias("m"))
    assert [r["m"] for r in colors.collect()] == [240, 0, 0]


def test_caps_limit_deductions(spark):
    entries = spark.createDataFrame([("a", 1, 1, 1, "pair")], "pair_id string, s_page int, t_page int, report_page int, kind string")
    issues = spark.createDataFrame([("a", 1, "geometry", "font_shrink", "high")] * 12, "pair_id string, report_page int, detector string, type string, severity string")
    row = scoring.page_results(entries, issues, Profile()).first()
    assert (row["score"], row["status"]) == (90.0, "review")


def test_profile_rules():
    p = Profile()
    assert Profile.from_json(p.to_json()) == p
    assert Profile.from_json('{"caps": {"font_shrink": 5.0}}').caps["region_shifted"] == 12.0
    for bad in ({"position": 0.5}, {"off": ("nothing",)}, {"fail_score": 95.0}):
        with pytest.raises(ValueError):
            Profile(**bad)
    with pytest.raises(ValueError):
        Profile.from_json('{"unknown": 1}')


def test_published_profiles():
    p = Profile(off=("region_shifted",), high_forces_review=False, language_thresholds={"latin-cjk": Profile().thresholds | {"untranslated_ratio": 0.5}})
    assert Profile.from_published(json.dumps(p.published())) == p
    text = '{"profile_id": "own", "name": "x", "matching": {"weights": {"position": 0.5, "size": 0.15}}, "detectors": {"enabled": {"font_grow": false}, "thresholds": {"alignment_edge_tolerance_ratio": 0.02, "number_mismatch_bands": [{"gte": 2, "severity": "low"}]}}, "scoring": {"critical_forces_fail": false}}'
    q = Profile.from_published(text)
    assert (q.position, q.size, q.type, q.off, q.critical_forces_fail) == (0.5, 0.15, 0.2, ("font_grow",), False)
    assert q.t("alignment_edge_tolerance_ratio") == 0.02 and q.bands["number_mismatch_bands"] == ((2, "low"),) and q.profile_id == "own"


def test_forced_verdicts_can_be_switched_off(spark):
    entries = spark.createDataFrame([("a", 1, "pair"), ("b", 1, "pair")], "pair_id string, report_page int, kind string")
    issues = spark.createDataFrame([("a", 1, "out_of_page", "content_out_of_page", "critical"), ("b", 1, "geometry", "font_shrink", "high")], "pair_id string, report_page int, detector string, type string, severity string")
    status = lambda p: {r["pair_id"]: r["status"] for r in scoring.page_results(entries, issues, p).collect()}
    assert status(Profile()) == {"a": "fail", "b": "review"}
    assert status(Profile(critical_forces_fail=False, high_forces_review=False, pass_score=85.0)) == {"a": "review", "b": "pass"}


def test_flows_against_a_plain_version():
    r = np.random.default_rng(5)
    for _ in range(60):
        n = int(r.integers(0, 14))
        y = np.sort(r.integers(0, 12, n) * 9.0)
        x, w, h = r.integers(0, 60, n) * 1.0, r.integers(5, 60, n) * 1.0, r.integers(8, 14, n) * 1.0
        kind, font = r.choice(["paragraph", "heading"], n), r.choice([10.0, 10.5, 14.0, np.nan], n)
        want, last = [], []
        for k in range(n):
            fits = []
            for f, p in enumerate(last):
                gap, tall = y[k] - y[p] - h[p], max(h[p], h[k])
                both = max(0.0, min(x[p] + w[p], x[k] + w[k]) - max(x[p], x[k])) / min(w[p], w[k])
                sized = np.isnan(font[p]) or np.isnan(font[k]) or abs(font[p] - font[k]) / max(font[p], font[k]) <= 0.15
                if kind[p] == kind[k] and y[k] >= y[p] and -0.25 * tall <= gap <= 0.6 * tall and both >= 0.3 and sized:
                    fits.append((abs(gap), f))
            want.append(min(fits)[1] if fits else len(last))
            last[want[-1] : want[-1] + 1] = [k]
        assert solvers.flows(x, y, w, h, kind, font, 0.6, 0.25, 0.3, 0.15).tolist() == want


def test_store_rules(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, v int, d string")
    new = spark.createDataFrame([("a", 1, "y"), ("c", 0, "z")], "k string, v int, d string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], "v").collect())) == [("a", 1, "y"), ("b", 1, "x"), ("c", 0, "z")]
    assert store.append_new(old, new, ["k"]).count() == 3
    profiles = spark.createDataFrame([("p", 1, "published"), ("p", 2, "draft")], "profile_id string, version int, status string")
    put = store.put_profile(profiles, spark.createDataFrame([("p", 1, "draft"), ("p", 2, "published")], profiles.schema))
    assert sorted(map(tuple, put.collect())) == [("p", 1, "published"), ("p", 2, "published")]
    names = spark.createDataFrame([("x-en.pdf",), ("x-zh.pdf",), ("r.pdf",), ("translated_r.pdf",)], "name string")
    assert sorted(map(tuple, store.discover_pairs(names).collect())) == [("r.pdf", "translated_r.pdf"), ("x-en.pdf", "x-zh.pdf")]


def test_layout_scan(spark):
    span = lambda text, box: {"text": text, "bbox": box, "size": 9.0, "flags": 16, "color": 255, "alpha": 255, "font": "f"}
    page = ("a", "source", 1, 100.0, 100.0, [{"type": 0, "bbox": [0.0, 0.0, 9.0, 9.0], "width": None, "height": None, "lines": [{"spans": [span("hi", [1.0, 1.0, 9.0, 9.0]), span("", [1.0, 1.0, 1.0, 9.0])]}]}, {"type": 1, "bbox": [0.0, 50.0, 50.0, 90.0], "width": 5, "height": 4, "lines": None}], [{"bbox": [0.0, 0.0, 100.0, 100.0], "color": "#FFFFFF"}, {"bbox": [0.0, 0.0, 50.0, 50.0], "color": "#101010"}])
    layouts = spark.createDataFrame([page], scan.LAYOUT)
    rows = {r["block_id"]: r for r in scan.blocks(layouts).collect()}
    assert set(rows) == {"p1-b0-l0-s0", "p1-b1-image"} and rows["p1-b0-l0-s0"]["color"] == "#0000FF" and rows["p1-b0-l0-s0"]["weight"] == 700
    pale = layouts.withColumn("fills", F.array(F.struct(F.array(*[F.lit(v) for v in (0.0, 0.0, 100.0, 60.0)]).alias("bbox"), F.lit("#FFFFC0").alias("color"))))
    assert scan.pages(pale).first()["background_color"] is None and len(scan.pages(pale).first()["dark_boxes"]) == 2
    paper = scan.pages(layouts).first()
    assert paper["background_color"] == "#FFFFFF" and len(paper["dark_boxes"]) == 2


def test_entry_without_optional_parts():
    import __spark_entry__

    assert {"document_report", "page_score", "issue_shift"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pdf_layouts_reject_large_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 11)
    with pytest.raises(ValueError, match="more than 10 bytes"):
        scan.pdf_layouts(spark, str(tmp_path), lambda name, content: iter(()), max_bytes=10)
    assert scan.pdf_layouts(spark, str(tmp_path), lambda name, content: iter(()), max_bytes=11).count() == 0
