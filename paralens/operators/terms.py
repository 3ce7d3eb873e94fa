"""Terms of a glossary in texts: one pass of an Aho-Corasick automaton over each text.

A term with a Latin letter stands as whole words, whatever the case unless it is case
sensitive; any other term is found wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groupwise import ship

GLOSSARY = ("glossary_id", "version", "term_ord", "term", "translations", "note", "case_sensitive")


def has_latin(term: str) -> bool:
    return any("a" <= c.lower() <= "z" for c in term)


def folded(text: str) -> str:
    """In lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def bounded(text: str, start: int, end: int) -> bool:
    """Whether words begin or end at both ends of a part of a text."""
    before = start > 0 and _is_word(text[start - 1])
    after = end < len(text) and _is_word(text[end])
    return before != _is_word(text[start]) and after != _is_word(text[end - 1])


def stands(text: str, low: str, term: str, case_sensitive: bool) -> bool:
    """Whether one term stands in a text; ``low`` is the folded text."""
    if not term:
        return not has_latin(term)
    if not has_latin(term):
        return term in text
    text, term = (text, term) if case_sensitive else (low, folded(term))
    at = text.find(term)
    while at >= 0:
        if bounded(text, at, at + len(term)):
            return True
        at = text.find(term, at + 1)
    return False


class Automaton:
    """All terms of a group; ``find`` tells which of them stand in a text."""

    def __init__(self, terms: list[tuple[str, bool]]):
        import ahocorasick

        self.exact, self.low = ahocorasick.Automaton(), ahocorasick.Automaton()
        places: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        for k, (term, case_sensitive) in enumerate(terms):
            free = has_latin(term) and not case_sensitive
            places[free].setdefault(folded(term) if free else term, []).append(k)
        for automaton, words in zip((self.exact, self.low), places):
            for word, own in words.items():
                automaton.add_word(word, (len(word), has_latin(word), own))
            if words:
                automaton.make_automaton()
        self.some = tuple(map(bool, places))

    def find(self, text: str, low: str) -> set[int]:
        out: set[int] = set()
        for automaton, used, given in ((self.exact, self.some[0], text), (self.low, self.some[1], low)):
            if used:
                for last, (size, whole, own) in automaton.iter(given):
                    if not whole or bounded(given, last + 1 - size, last + 1):
                        out.update(own)
        return out


def breaches(rows: DataFrame, glossary: DataFrame, group_bytes: int = 4 << 20) -> DataFrame:
    """Rows with s_text and t_text for each term (g_) that s_text has while t_text has none of its translations.

    The glossary goes in groups of about ``group_bytes``, each broadcast for one pass.
    """
    ship(rows.sparkSession)
    known = glossary.where("term <> ''").select(*[F.col(c).alias(f"g_{c}") for c in GLOSSARY])
    size = known.agg(F.sum(F.octet_length("g_term") + F.octet_length(F.array_join("g_translations", " ")) + 32)).first()[0] or 0
    groups = int(size // group_bytes) + 1
    columns = [c for c in rows.columns if c != "rules" and not c.endswith(("_colors", "_children"))]
    rows = rows.select(*columns)
    out = None
    for k in range(groups):
        own = known.where(F.pmod(F.xxhash64(*known.columns), F.lit(groups)) == k).collect()
        part = _searched(rows, [tuple(r) for r in own], known.schema)
        out = part if out is None else out.unionByName(part)
    return out


def _searched(rows: DataFrame, known: list[tuple], schema) -> DataFrame:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([(r[3], r[6]) for r in known])
        for batch in batches:
            at, hit = [], []
            for i, (s, t) in enumerate(zip(batch.column("s_text").to_pylist(), batch.column("t_text").to_pylist())):
                found = automaton.find(s or "", folded(s or ""))
                low = folded(t or "") if found else ""
                for k in sorted(found):
                    if not any(stands(t or "", low, x, known[k][6]) for x in known[k][4]):
                        at.append(i)
                        hit.append(k)
            taken = batch.take(pa.array(at, pa.int64()))
            told = [pa.array([known[k][c] for k in hit], f.type) for c, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*taken.columns, *told], names=[*batch.schema.names, *added.names])

    added = to_arrow_schema(schema)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *schema.fields]))
