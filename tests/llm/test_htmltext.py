"""Visible text of web pages: lost text, and a second renderer of generated pages."""

import random

import pytest

from paralens.llm import htmltext


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("keep<!-- note --!><p>lost text</p>", "keep\n\nlost text"),
        ("<p>one</p><!---><p>two</p>", "one\n\ntwo"),
        ("<p>one</p><!--><p>two</p>", "one\n\ntwo"),
        ("<p>one</p><!-- a > b -- c -->two", "one\n\ntwo"),
        ("a<!---->b", "ab"),
        ("a<!-- never ends", "a"),
        ("<map name=m>area text</map>", "area text"),
        ("<object>shown instead</object>", "shown instead"),
        ("<object data=x.swf>not shown</object>", ""),
        ("<select><option>one<option>two</select>", "one"),
        ("<select><option disabled>pick<option>one<option selected>two</select>", "two"),
        ("<select multiple><option>one<option>two</select>", "one\ntwo"),
        ("<select size=4><option>one<option>two</select>", "one\ntwo"),
    ],
)
def test_visible_text_is_not_lost(page, text):
    assert htmltext.render(page)[1] == text


def generated(r, depth=0):
    """(html, the visible words in order) of a random piece of a page."""
    word = lambda: r.choice("alpha beta gamma delta épsilon 東京 x1".split()) + str(r.randint(0, 999))
    kind = r.choice(["text", "text", "inline", "block", "list", "table", "hidden", "comment", "script", "implied"] if depth < 5 else ["text"])
    if kind == "text":
        w = [word() for _ in range(r.randint(1, 4))]
        return r.choice([" ", "\n"]) + r.choice([" ", "  \n "]).join(w) + " ", w
    inner = [generated(r, depth + 1) for _ in range(r.randint(1, 3))]
    code, words = "".join(h for h, _ in inner), [w for _, ws in inner for w in ws]
    if kind == "inline":
        tag = r.choice(["b", "span class=z", "em", "u"])
        return f"<{tag}>{code}</{tag.split()[0]}>", words
    if kind == "block":
        tag = r.choice(["div", "section", "blockquote", "article", "DIV id=q"])
        return f"<{tag}>{code}</{tag.split()[0]}>", words
    if kind == "list":
        tag = r.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{h}" + r.choice(["", "</li>"]) for h, _ in inner) + f"</{tag}>", words
    if kind == "table":
        cells = [[(w, w) for w in (word(), word())] for _ in range(r.randint(1, 3))]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" + r.choice(["", "</td>"]) for c, _ in row) for row in cells) + "</table>", [w for row in cells for _, w in row]
    if kind == "hidden":
        return r.choice([f"<div hidden>{word()}</div>", f"<p style='display:none'>{word()}</p>", f"<noscript>{word()}</noscript>"]), []
    if kind == "comment":
        return r.choice(["<!-- a <b> -->", "<!-->", "<!--->", "<!-- x --!>", "<!doctype x>", "<?php ?>"]), []
    if kind == "script":
        return r.choice(["<script>if (a < b) {x = '<p>no</p>'}</script>", "<style>p {color: red}</style>"]), []
    return "".join(f"<div><p>{w}" + "</div>" for w in words[:3]), words[:3]


def test_visible_words_of_generated_pages_stay_in_order():
    r = random.Random(8)
    for _ in range(400):
        parts = [generated(r) for _ in range(r.randint(1, 5))]
        page, words = "".join(h for h, _ in parts), [w for _, ws in parts for w in ws]
        shown = htmltext.render(page)[1].replace("|", " ").split()
        marks = {"-", "*", "•", "◦"} | {f"{k}." for k in range(1, 20)}
        assert [w for w in shown if w not in marks] == words, page


def test_long_flat_page():
    page = "<p>word " * 40_000
    assert htmltext.render(page)[1].count("word") == 40_000
