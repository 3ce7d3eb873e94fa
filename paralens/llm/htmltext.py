"""Layout-aware text of web pages.

``parse`` builds a tree: it supplies the tags that HTML lets authors leave out
(paragraphs, list items, table rows and sections, options, ruby), closes what a new
tag or an end tag implies, moves text and elements that stand between table cells
before the table, and nests at most ``DEPTH`` deep (deeper elements become siblings, as in
browsers).  ``render`` lays the visible text out: blocks on lines of their own,
paragraphs and headings with blank lines around them, list items with markers and
indents, tables as aligned columns with spans, preformatted text as it stands.

Not visible: head, script, style, template and fallback contents, ``hidden``
elements, closed dialogs and details, and what ``display:none`` or
``visibility:hidden`` hides, in a style attribute or by a selector of the page's own
style sheets (tags, classes, ids, all of them together, descendants and children), as
far as their media apply to a screen; of several values the important, the more
specific, the later one holds.  A ``visibility:visible`` inside shows again.  Other
values of ``display`` put an element on lines of its own or into the line.

Null html counts as empty; repeated pages keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words as W
from .common import ship

DEPTH = 512
#: the screen that media queries are asked for, in CSS pixels
SCREEN = {"width": 1280, "height": 800}
#: Fixed values of HTML: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript plaintext template textarea title".split())
UNSEEN = set("head script style template noscript iframe noembed noframes audio video canvas datalist rp title meta link base param source track area".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split())
BLOCK = CLOSES_P | set("html body optgroup option legend caption tr tbody thead tfoot listing xmp plaintext select textarea".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset".split())
HEAD = set("title meta link base style script noscript template".split())
SCOPES = {"li": {"ul", "ol", "menu", "dir", "table", "td", "th"}, "dt": {"dl", "table", "td", "th"}, "dd": {"dl", "table", "td", "th"}, "p": {"table", "td", "th", "caption", "button", "object"}, "option": {"select", "datalist"}}
TABLE_PARTS = {"td": 3, "th": 3, "tr": 2, "tbody": 1, "thead": 1, "tfoot": 1, "caption": 1, "colgroup": 1}
BETWEEN = {"table", "tbody", "thead", "tfoot", "tr", "colgroup"}
#: besides its parts, what may stand in a table without being moved before it
IN_TABLE = {"col", "style", "script", "template"}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_EMPTY_COMMENT, _COMMENT_END = re.compile(r"-?>"), re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_CSS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[{};]|[^{};\"']+|[\"']", re.S)
_DISPLAY = re.compile(r"none|block|inline|contents|list-item|flow-root|flex|grid|(?:inline-)(?:block|flex|grid|table)|table(?:-[a-z-]+)?|ruby(?:-[a-z-]+)?|-webkit-(?:inline-)?(?:box|flex)|(?:block|inline)(?:flow|flow-root|flex|grid|table|ruby)|run-in|initial|inherit|unset|revert(?:-layer)?")
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_INLINE = re.compile(r"inline.*|contents|ruby.*|-webkit-inline-.*|run-in|initial|unset")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []

    def get(self, name: str) -> str | None:
        """An attribute's value ('' without one), or None."""
        if name not in self.attributes.lower():
            return None
        for key, a, b, c in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(a or b or c)
        return None


def _tokens(text: str) -> Iterator[tuple[str, str, str]]:
    """('text' | 'start' | 'end' | 'raw', name or text, attributes or text)."""
    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            yield "text", text[at:], ""
            return
        if lt > at:
            yield "text", text[at:lt], ""
        following = text[lt + 1 : lt + 2]
        if following == "!" or following == "?":
            if text.startswith("<!--", lt):
                # at once by > or ->, else at the first --> or --!>
                end = _EMPTY_COMMENT.match(text, lt + 4) or _COMMENT_END.search(text, lt + 4)
                at = end.end() if end else n
            else:
                end = text.find(">", lt)
                at = end + 1 if end >= 0 else n
            continue
        closing = following == "/"
        first = text[lt + 2 : lt + 3] if closing else following
        if not (first.isascii() and first.isalpha()):
            if closing and first:
                end = text.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        tag = _TAG.match(text, lt)
        if tag:
            name, attributes, at = tag[1].lower(), tag[2], tag.end()
        else:  # a quote that stays open: the tag ends at the next >
            end = text.find(">", lt)
            if end < 0:
                return
            name, _, attributes = text[lt + 1 + closing : end].partition(" ")
            name, at = name.lower().strip("/\t\n\f\r"), end + 1
        yield "end" if closing else "start", name, attributes
        if not closing and name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(text, at) if name != "plaintext" else None
            yield "raw", name, text[at : close.start() if close else n]
            if not close:
                return
            end = text.find(">", close.start())
            yield "end", name, ""
            at = end + 1 if end >= 0 else n


def parse(text: str) -> Node:
    """The page's tree; its root is ``html`` with a ``head`` and a ``body``."""
    root = Node("html")
    head, body = Node("head"), Node("body")
    root.children = [head, body]
    stack = [root, body]
    in_head = True

    def pop_to(name: str, stops: set[str] = frozenset()) -> bool:
        for k in range(len(stack) - 1, 1, -1):
            if stack[k].name == name:
                del stack[k:]
                return True
            if stack[k].name in stops:
                return False
        return False

    def push(node: Node, keep: bool = True) -> None:
        stack[-1].children.append(node)
        if keep and len(stack) < DEPTH:
            stack.append(node)

    def foster(item: Node | str) -> None:
        """What stands between table cells goes before the table."""
        at = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == "table" or k == 1)
        parent = stack[at - 1] if stack[at].name == "table" else stack[at]
        place = next((i for i in range(len(parent.children) - 1, -1, -1) if parent.children[i] is stack[at]), len(parent.children))
        parent.children.insert(place, item)

    def table_place(level: int) -> bool:
        """Opens the sections and rows that a table part of this level needs; false outside of tables."""
        at = next((k for k in range(len(stack) - 1, 1, -1) if stack[k].name == "table"), None)
        if at is None:
            return False
        del stack[_open(at, level) :]
        if level >= 2 and stack[-1].name == "table":
            push(Node("tbody"))
        if level == 3 and stack[-1].name != "tr":
            push(Node("tr"))
        return True

    def _open(at: int, level: int) -> int:
        """How much of the stack stays open for a new part: the table, its open section, its open row."""
        k = at + 1
        while k < len(stack) and TABLE_PARTS.get(stack[k].name, 9) < level and stack[k].name not in ("caption", "colgroup"):
            k += 1
        return k

    for kind, name, rest in _tokens(text):
        if kind == "text":
            content = html.unescape(name) if "&" in name else name
            if in_head and not _SPACE.sub("", content):
                continue
            in_head = False
            if stack[-1].name in BETWEEN:
                if _SPACE.sub("", content):
                    foster(content)
                continue
            stack[-1].children.append(content)
        elif kind == "raw":
            if name in ("textarea", "title"):
                rest = html.unescape(rest)
            stack[-1].children.append(rest)
        elif kind == "start":
            if name in ("html", "body", "head", "frameset"):
                target = {"html": root, "body": body, "head": head}.get(name)
                if target is not None and not target.attributes:
                    target.attributes = rest
                in_head = in_head and name != "body"
                continue
            if in_head and name in HEAD:
                node = Node(name, rest)
                head.children.append(node)
                if name not in VOID:
                    stack.append(node)
                continue
            in_head = False
            if name == "image":
                name = "img"
            if name in CLOSES_P:
                pop_to("p", SCOPES["p"])
            if name == "li":
                pop_to("li", SCOPES["li"])
            elif name in ("dt", "dd"):
                pop_to("dt", SCOPES["dt"]) or pop_to("dd", SCOPES["dd"])
            elif name in ("option", "optgroup"):
                pop_to("option", SCOPES["option"])
                if name == "optgroup":
                    pop_to("optgroup", SCOPES["option"])
            elif name in ("rt", "rp"):
                pop_to("rt", {"ruby"}) or pop_to("rp", {"ruby"})
            elif name in TABLE_PARTS and not table_place(TABLE_PARTS[name]):
                continue
            elif name == "table" and stack[-1].name in BETWEEN:
                pop_to("table")
            elif re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", stack[-1].name):
                stack.pop()
            node, keep = Node(name, rest), name not in VOID and name != "col"
            if stack[-1].name in BETWEEN and name not in TABLE_PARTS and name not in IN_TABLE:
                if stack[-1].name == "colgroup":
                    stack.pop()
                foster(node)
                if keep and len(stack) < DEPTH:
                    stack.append(node)
            else:
                push(node, keep)
        elif kind == "end":
            if name in ("html", "body"):
                continue
            if name == "head":
                in_head = False
            elif name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p":
                pop_to("p", SCOPES["p"])
            elif re.fullmatch("h[1-6]", name):
                if not pop_to(name, {"table", "td", "th"}):
                    for other in ("h1", "h2", "h3", "h4", "h5", "h6"):
                        if pop_to(other, {"table", "td", "th"}):
                            break
            elif name not in VOID:
                stops = SCOPES.get(name, {"td", "th", "caption"} if name not in ("table", "tr", "td", "th", "caption", "tbody", "thead", "tfoot") else ({"table"} if name != "table" else set()))
                pop_to(name, stops)
    return root


def _selector(text: str) -> tuple[list[tuple[str, str, set[str], set[str]]], int] | None:
    """A selector's parts from the last to the first, each (combinator after it, tag, classes, ids), and its weight; None if it has others."""
    parts, weight, before = [], 0, ""
    for word in re.sub(r"\s*>\s*", " > ", text.strip()).split():
        if word == ">":
            if not parts or before == ">":
                return None
            before = ">"
            continue
        m = _COMPOUND.fullmatch(word)
        if not m or not word:
            return None
        marks = re.findall(r"[.#][\w-]+", m[2])
        classes, ids = ({x[1:] for x in marks if x[0] == mark} for mark in ".#")
        tag = "" if m[1] in (None, "*") else m[1].lower()
        if parts:
            parts[-1] = (before or " ", *parts[-1][1:])
        parts.append(("", tag, classes, ids))
        weight += 100 * len(ids) + 10 * len(classes) + bool(tag)
        before = ""
    return (parts[::-1], weight) if parts and not before else None


def _sheet(root: Node) -> list[tuple]:
    """(selector's parts, weight, effects) of the rules that hide, show or lay out, from the page's style elements."""
    out: list[tuple] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.name == "style" and _applies(node.get("media") or ""):
            css = _COMMENT.sub("", "".join(c for c in node.children if isinstance(c, str)))
            for selectors, body in _rules(css):
                effects = _effects(body)
                for selector in selectors.split(",") if effects else ():
                    found = _selector(selector)
                    if found:
                        out.append((*found, effects))
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that apply to the screen; rules nested in rules are left out."""
    frames: list[list] = [["group", True, ""]]  # kind, whether it applies, selectors
    text, kept = "", ""
    for token in _CSS.findall(css):
        kind, applies, selectors = frames[-1]
        if token == "{":
            before = text.strip()
            if kind == "body":
                kept += text.rpartition(";")[0] + ";"
            if kind != "group":
                frames.append(["skip", False, ""])
            elif before[:1] == "@":
                name, _, condition = before[1:].partition(" ") if "(" not in before.split(" ")[0] else before[1:].replace("(", " (", 1).partition(" ")
                name, condition = name.strip().lower(), condition.strip()
                if name == "media":
                    frames.append(["group", applies and _applies(condition), ""])
                elif name in ("supports", "layer"):
                    frames.append(["group", applies and not condition.lower().startswith("not"), ""])
                else:
                    frames.append(["skip", False, ""])
            else:
                frames.append(["body", applies, before])
                kept = ""
            text = ""
        elif token == "}":
            if kind == "body" and applies:
                yield selectors, kept + text
            if len(frames) > 1:
                frames.pop()
            text = ""
        elif token == ";" and kind == "group" and text.lstrip()[:1] == "@":
            text = ""
        else:
            text += token
    if frames[-1][0] == "body" and frames[-1][1]:
        yield frames[-1][2], kept + text


def _applies(condition: str) -> bool:
    """Whether a media query list applies to a screen of ``SCREEN``; a feature that is not known doesn't."""
    queries = [" ".join(q.split()) for q in condition.lower().split(",")]
    return queries == [""] or any(map(_query_applies, queries))


def _query_applies(query: str) -> bool:
    m = re.fullmatch(r"(?:(not|only) )?([a-z-]+)?(?: ?and ?)?((?:\([^()]*\)(?: ?and ?)?)*)", query)
    if not m or not (m[2] or m[3]):
        return False
    found = [_feature(f) for f in re.findall(r"\(([^()]*)\)", m[3])]
    if None in found:
        return False
    return ((m[2] or "all") in ("all", "screen") and all(found)) != (m[1] == "not")


def _feature(feature: str) -> bool | None:
    name, colon, value = (x.strip() for x in feature.partition(":"))
    fixed = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "pointer": "fine", "scripting": "enabled"}
    if name in fixed:
        return value == fixed[name] if colon else fixed[name] != "no-preference"
    m = re.fullmatch(r"(min-|max-)?(?:device-)?(width|height)", name)
    if not m:
        return None
    size = re.fullmatch(r"([\d.]+)(px|em|rem)?", value)
    if not colon:
        return True
    if not size or size[1].count(".") > 1 or not re.search(r"\d", size[1]):
        return None
    length, own = float(size[1]) * (1 if size[2] in ("px", None) else 16), SCREEN[m[2]]
    return own >= length if m[1] == "min-" else own <= length if m[1] == "max-" else own == length


def _effects(css: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of what hides or shows."""
    out = []
    for declaration in css.lower().split(";"):
        name, _, value = declaration.partition(":")
        name, value = name.strip(), "".join(value.split())
        important = value.endswith("!important")
        value = value.removesuffix("!important")
        if name == "display" and _DISPLAY.fullmatch(value) or name == "visibility" and value in ("hidden", "collapse", "visible", "initial", "inherit", "unset", "revert"):
            out.append((name, value, important))
    return out


def _unchosen(select: Node) -> set[int]:
    """The options that a dropdown doesn't show: all but the last selected one, or else the first that can be chosen."""
    size = (select.get("size") or "").strip()
    if select.get("multiple") is not None or size.isdecimal() and int(size) > 1:
        return set()
    options, todo = [], [select]
    while todo:
        node = todo.pop()
        if node.name == "option":
            options.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    chosen = [o for o in options if o.get("selected") is not None][-1:] or [o for o in options if o.get("disabled") is None][:1]
    return {id(o) for o in options} - {id(o) for o in chosen}


class Renderer:
    def __init__(self, root: Node):
        self.rules = _sheet(root)
        self.parents: dict[int, Node] = {}
        #: options that their dropdowns don't show
        self.unchosen: set[int] = set()
        if any(len(parts) > 1 for parts, _, _ in self.rules):
            todo = [root]
            while todo:
                node = todo.pop()
                inner = [c for c in node.children if isinstance(c, Node)]
                self.parents.update((id(c), node) for c in inner)
                todo += inner

    def fits(self, node: Node, parts: list[tuple], k: int = 0) -> bool:
        """Whether a selector's parts from the k-th on fit an element and its ancestors."""
        _, tag, classes, ids = parts[k]
        if tag and tag != node.name or (classes or ids) and not node.attributes:
            return False
        if classes and not classes <= set((node.get("class") or "").split()) or ids and ids != {node.get("id")}:
            return False
        if k + 1 == len(parts):
            return True
        above = self.parents.get(id(node))
        if parts[k + 1][0] == ">":
            return above is not None and self.fits(above, parts, k + 1)
        while above is not None:
            if self.fits(above, parts, k + 1):
                return True
            above = self.parents.get(id(above))
        return False

    def state(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """Whether the element is laid out, and whether its text is visible."""
        return self.look(node, visible)[:2]

    def look(self, node: Node, visible: bool) -> tuple[bool, bool, bool | None]:
        """state(), and whether styles make the element a block (None: they say nothing)."""
        if node.name in UNSEEN or node.name == "object" and node.get("data") or id(node) in self.unchosen:
            return False, False, None
        if node.name == "select":
            self.unchosen |= _unchosen(node)
        if node.attributes and node.name == "input" and (node.get("type") or "").lower() == "hidden":
            return False, False, None
        own = bool(node.attributes) and node.get("hidden") is not None or node.name == "dialog" and node.get("open") is None
        display, rank = "none" if own else "", {"display": (False, -1), "visibility": (False, -1)}
        inherited, shown = visible, visible
        found = [(weight, effects) for parts, weight, effects in self.rules if self.fits(node, parts)]
        if node.attributes and (style := node.get("style")) is not None:
            found.append((1000, _effects(style)))
        for weight, effects in found:
            for name, value, important in effects:
                if (important, weight) < rank[name]:
                    continue
                rank[name] = important, weight
                if name == "display":
                    display = ("none" if own else "") if value.startswith("revert") else value
                else:
                    shown = value in ("visible", "initial") or value not in ("hidden", "collapse") and inherited
        if display == "none":
            return False, False, None
        return True, shown, None if display in ("", "inherit") else not _INLINE.fullmatch(display)

    def block(self, node: Node, visible: bool = True, pre: bool = False) -> list[str]:
        """The lines of an element's contents; blank lines only between other lines."""
        lines: list[str] = []
        line: list[str] = []
        gap = 0  # blank lines owed before the next line

        def end_line() -> None:
            nonlocal gap
            if line:
                text = "".join(line)
                line.clear()
                add(text.split("\n") if pre_seen[0] else [text.strip(" ")])
                pre_seen[0] = False

        def add(new: list[str]) -> None:
            nonlocal gap
            while new and not new[0].strip(" "):
                new = new[1:]
            while new and not new[-1].strip(" "):
                new = new[:-1]
            if new:
                if lines and gap:
                    lines.append("")
                gap = 0
                lines.extend(new)

        pre_seen = [False]

        def put(text: str, keep: bool) -> None:
            if keep:
                line.append(text)
                pre_seen[0] = pre_seen[0] or "\n" in text
                return
            text = _SPACE.sub(" ", text)
            if text and (not line or line[-1][-1:] in (" ", "\n")):
                text = text.lstrip(" ")
            if text:
                line.append(text)

        def blank() -> None:
            nonlocal gap
            gap = 1

        todo: list = [(c, visible, pre) for c in reversed(node.children)]
        if node.name == "details" and node.get("open") is None:
            todo = [t for t in todo if isinstance(t[0], Node) and t[0].name == "summary"]
        while todo:
            item, shown, keep = todo.pop()
            if isinstance(item, str):
                if shown:
                    put(item, keep)
                continue
            if callable(item):
                item()
                continue
            laid, inner, as_block = self.look(item, shown)
            if not laid:
                continue
            name = item.name
            if name == "br":
                if line:
                    end_line()
                elif lines and inner:
                    blank()
                continue
            if name == "hr":
                end_line()
                blank()
                continue
            if name == "input":
                if inner and (item.get("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                    put(item.get("value") or "", False)
                continue
            if name in VOID:
                continue
            if name in ("ul", "ol", "menu", "dir", "table", "blockquote", "dd", "details", "pre", "listing", "textarea"):
                end_line()
                if name in SPACED and not (name in ("ul", "ol") and node.name in ("li", "ul", "ol")):
                    blank()
                if name == "table":
                    add(self.table(item, inner))
                elif name in ("ul", "ol", "menu", "dir"):
                    add(self.items(item, inner))
                elif name in ("blockquote", "dd"):
                    add([f"  {x}" if x else x for x in self.block(item, inner, keep)])
                else:
                    add(self.block(item, inner, keep or name in ("pre", "listing", "textarea")))
                if name in SPACED and not (name in ("ul", "ol") and node.name in ("li", "ul", "ol")):
                    blank()
                continue
            if name in BLOCK or name in TABLE_PARTS if as_block is None else as_block:
                end_line()
                if name in SPACED:
                    blank()
                todo.append((blank if name in SPACED else end_line, shown, keep))
                todo.append((end_line, shown, keep))
            elif name == "q":
                todo.append(("”", inner, keep))
                put("“", False)
            todo += [(c, inner, keep) for c in reversed(item.children)]
        end_line()
        return lines

    def items(self, node: Node, visible: bool) -> list[str]:
        """A list's lines: a marker before each item, its further lines indented."""
        items = [c for c in node.children if isinstance(c, Node) and c.name == "li"]
        number, step = 1, 1
        if node.name == "ol":
            if node.get("reversed") is not None:
                number, step = len(items), -1
            start = (node.get("start") or "").strip()
            if re.fullmatch(r"-?\d{1,9}", start):
                number = int(start)
        out: list[str] = []
        loose = Node("div")
        for child in node.children:
            if not (isinstance(child, Node) and child.name == "li"):
                loose.children.append(child)
                continue
            out += [f"  {x}" if x else x for x in self.block(loose, visible)]
            loose = Node("div")
            laid, inner = self.state(child, visible)
            if not laid:
                continue
            value = (child.get("value") or "").strip()
            if node.name == "ol" and re.fullmatch(r"-?\d{1,9}", value):
                number = int(value)
            marker = f"{number}. " if node.name == "ol" else "- "
            number += step
            lines = self.block(child, inner)
            if lines or inner:
                out += [(marker + (lines[0] if lines else "")).rstrip(" "), *[" " * len(marker) + x if x else x for x in lines[1:]]]
        return out + [f"  {x}" if x else x for x in self.block(loose, visible)]

    def table(self, node: Node, visible: bool) -> list[str]:
        """A table's lines: caption, then rows with cells padded to their columns' widths."""
        captions: list[str] = []
        rows: dict[int, list[tuple[Node, bool]]] = {0: [], 1: [], 2: []}

        def gather(parent: Node, shown: bool, part: int) -> None:
            for child in parent.children:
                if not isinstance(child, Node):
                    continue
                laid, inner = self.state(child, shown)
                if not laid:
                    continue
                if child.name == "caption":
                    captions.extend(self.block(child, inner))
                elif child.name == "tr":
                    rows[part].append((child, inner))
                elif child.name in ("thead", "tbody", "tfoot"):
                    gather(child, inner, {"thead": 0, "tbody": 1, "tfoot": 2}[child.name])

        gather(node, visible, 1)
        grid: list[dict[int, tuple[list[str], int]]] = []
        taken: dict[int, int] = {}
        for row, shown in [*rows[0], *rows[1], *rows[2]]:
            cells: dict[int, tuple[list[str], int]] = {}
            column = 0
            spans: dict[int, int] = {}
            for cell in row.children:
                if not (isinstance(cell, Node) and cell.name in ("td", "th")):
                    continue
                laid, inner = self.state(cell, shown)
                if not laid:
                    continue
                while taken.get(column, 0) > 0:
                    column += 1
                wide, deep = (min(1000, max(1, int(v))) if (v := (cell.get(k) or "").strip()).isascii() and v.isdigit() and len(v) < 9 else 1 for k in ("colspan", "rowspan"))
                cells[column] = (self.block(cell, inner), wide)
                for k in range(column, column + wide):
                    spans[k] = deep
                column += wide
            taken = {k: max(taken.get(k, 0), spans.get(k, 0)) - 1 for k in {*taken, *spans}}
            if any(lines for lines, _ in cells.values()):
                grid.append(cells)
        widths: dict[int, int] = {}
        for cells in grid:
            for k, (lines, wide) in cells.items():
                if wide == 1:
                    widths[k] = max([widths.get(k, 0), *map(width, lines)])
        for cells in grid:
            for k, (lines, wide) in cells.items():
                if wide > 1:
                    own = sum(widths.setdefault(c, 0) for c in range(k, k + wide)) + 2 * (wide - 1)
                    widths[k + wide - 1] += max(0, max(map(width, lines), default=0) - own)
        order = sorted(widths)
        starts, at = {}, 0
        for k in order:
            starts[k] = at
            at += widths[k] + 2
        out = captions
        for cells in grid:
            for nth in range(max(len(lines) for lines, _ in cells.values())):
                line, used = "", 0
                for k in sorted(cells):
                    lines = cells[k][0]
                    if nth < len(lines) and lines[nth]:
                        line += " " * (starts[k] - used) + lines[nth]
                        used = max(used, starts[k]) + width(lines[nth])
                out.append(line.rstrip(" "))
        return out


def width(text: str) -> int:
    """Columns a text takes: wide letters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def render(page: str | None) -> tuple[str, str]:
    """The title and the visible text of a page."""
    if not page:
        return "", ""
    if sys.getrecursionlimit() < 8 * DEPTH:
        sys.setrecursionlimit(8 * DEPTH)
    root = parse(page.replace("\r\n", "\n").replace("\r", "\n"))
    titles = [c for c in root.children[0].children if isinstance(c, Node) and c.name == "title"]
    title = _SPACE.sub(" ", "".join(x for x in titles[0].children if isinstance(x, str))).strip(" ") if titles else ""
    renderer = Renderer(root)
    laid, visible = renderer.state(root.children[1], True)
    lines = renderer.block(root.children[1], visible) if laid else []
    return title, "\n".join(x.replace(" ", " ").rstrip(" ") for x in lines)


def rendered(pages: DataFrame, key: str = "page_id", html_: str = "html") -> DataFrame:
    """(id, title, text) of every page."""
    ship(pages.sparkSession)
    source = pages.select(pages[key].alias("id"), pages[html_].cast("string").alias("html"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "html"):
            titles, texts = zip(*map(render, batch.column("html").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=schema.fieldNames())

    return source.mapInArrow(run, schema)
