"""What a comparison without evidence needs to know of texts, in their place.

All of it adds up over the parts of a text, so it is made where a block is read; from there on
no text is moved, sorted or written.  Readers take it from the columns where they are there,
else from the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..plans.rules import Rules
from .groupwise import ship

#: what is known of a text: its characters, those that aren't spaces, letters by script (as tx.SCRIPTS), numbers; of target texts also letters of acronyms, and all letters of a narrow one
SUMS = ("chars", "solid", "capitals", "letters")
FACTS = (*SUMS, "counts", "numbers")


#: flags of a code point, above its script: a space, a decimal digit, what numbers are written with, a letter, what words are written with, A to Z
SPACE, DIGIT, NUMBER, LETTER, WORD, CAPITAL = (16 << k for k in range(6))
#: bytes of text that are looked at together, so that their arrays stay in a processor's cache
CHUNK = 1 << 17


@lru_cache(1)
def _table() -> np.ndarray:
    """For each code point its script (a place in tx.SCRIPTS, from 1) and, as flags, what else it is."""
    n = 0x110000
    category = np.array([unicodedata.category(chr(c)) for c in range(n)])
    script = np.zeros(n, dtype=np.uint16)
    for k, pattern in enumerate(tx.SCRIPTS.values()):
        for low, high in re.findall("(.)-(.)", pattern[1:-1], re.DOTALL):
            script[ord(low) : ord(high) + 1] = k + 1
    flag = lambda *some: np.isin(np.arange(n), [ord(c) for c in "".join(some)])
    word = np.isin(category, ["Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Me", "Mc", "Nd", "Pc"]) | flag("\u200c\u200d")
    for low, high in ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189)):
        word[low : high + 1] = True
    space = np.isin(category, ["Zs", "Zl", "Zp"]) | flag("\t\n\v\f\r\x85")
    digit = category == "Nd"
    number = digit | flag(".,", tx.DIGITS_FROM)
    capital = flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    flags = {SPACE: space, DIGIT: digit, NUMBER: number, LETTER: np.char.startswith(category, "L"), WORD: word, CAPITAL: capital}
    return script + sum(v.astype(np.uint16) * k for k, v in flags.items()).astype(np.uint16)


_NUMBER, _DIGITS = re.compile(tx.NUMBER.removeprefix("(?U)")), str.maketrans(tx.DIGITS_FROM, tx.DIGITS_TO)


def numbers_in(part: str) -> list[str]:
    """tx.numbers() of a text."""
    if part.isascii() and part.isdigit():
        return [part.lstrip("0") or "0"]
    found = []
    for token in _NUMBER.findall(part.translate(_DIGITS)):
        whole, dot, fraction = token.replace(",", "").partition(".")
        found.append((re.sub("^0+(?=.)", "", whole)) + dot + fraction)
    return found


def facts(texts: pa.StringArray, target: np.ndarray, narrow: np.ndarray) -> dict[str, pa.Array]:
    """The facts of many texts (none of them null), in one pass of arrays over their characters."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    whole = raw.tobytes().decode("utf-8", "replace")
    codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
    # places of the texts in characters
    begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])[at - at[0]] if len(codes) != len(raw) else at - at[0]
    size = np.diff(begin)
    held = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])[begin])
    is_ = _table()[codes]
    script = (is_ & 15).astype(np.uint8)
    counts = np.zeros((n, len(tx.SCRIPTS)), dtype=np.int32)
    for k in np.flatnonzero(np.bincount(script, minlength=1)[1:]).tolist():
        counts[:, k] = held(script == k + 1)
    first = np.zeros(len(codes) + 1, dtype=bool)
    first[begin] = True

    def parts(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to of the runs of marked characters; none reaches into the next text."""
        on = np.concatenate([marks, [False]])
        before = np.concatenate([[False], marks])
        starts = np.flatnonzero(on & (~before | first))
        ends = np.flatnonzero(before & (~on | first))
        return starts, ends

    a, b = parts(is_ & CAPITAL > 0)
    long = b - a > 1
    a, b = a[long], b[long]
    word = np.append(is_ & WORD > 0, False)
    free = (first[a] | ~word[a - 1]) & (first[b] | ~word[b])
    row = lambda places: np.searchsorted(begin, places, "right") - 1
    capitals = np.bincount(row(a[free]), weights=(b - a)[free], minlength=n)[:n].astype(np.int32)
    letters = np.zeros(n, dtype=np.int32)
    for k in np.flatnonzero(narrow).tolist():
        letters[k] = np.count_nonzero(is_[begin[k] : begin[k + 1]] & LETTER)
    a, b = parts(is_ & NUMBER > 0)
    # parts without a digit hold no number
    digits = np.concatenate([[0], np.cumsum(is_ & DIGIT > 0, dtype=np.int32)])
    kept = digits[b] > digits[a]
    a, b = a[kept], b[kept]
    found = [numbers_in(whole[i:j]) for i, j in zip(a.tolist(), b.tolist())]
    each = np.bincount(row(a), weights=[len(f) for f in found], minlength=n)[:n].astype(np.int64) if found else np.zeros(n, dtype=np.int64)
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return {
        "chars": pa.array(size, pa.int32()),
        "solid": pa.array(size - held(is_ & SPACE > 0), pa.int32()),
        "capitals": pa.array(np.where(target, capitals, 0), pa.int32()),
        "letters": pa.array(letters),
        "counts": pa.ListArray.from_arrays(ends(np.full(n, len(tx.SCRIPTS))), pa.array(counts.ravel())),
        "numbers": pa.ListArray.from_arrays(ends(each), pa.array([x for f in found for x in f], pa.string())),
    }


def replaced(blocks: DataFrame, rules: Rules) -> DataFrame:
    """The blocks with what is known of their texts instead of the texts."""
    ship(blocks.sparkSession)
    # a region is as wide as its widest block, but for rounding
    narrow = F.coalesce(F.col("width") <= rules.t("fragment_max_width") + 1, F.lit(True))
    target = F.coalesce(F.col("side") == "target", F.lit(False))
    plain = [c for c in blocks.columns if c != "text"]
    rows = rules.attach(blocks).select(*plain, F.coalesce("text", F.lit("")).alias("text"), target.alias("target"), (target & narrow).alias("narrow"))
    kept = T.StructType([f for f in rows.schema.fields if f.name in plain])
    schema = T.StructType([*kept, *[T.StructField(k, T.IntegerType()) for k in SUMS], T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("numbers", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, *marks = batch.column("text").cast(pa.string()), *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("target", "narrow")]
                cuts = np.unique(np.append(np.searchsorted(np.cumsum(pc.binary_length(text).to_numpy()), np.arange(0, text.nbytes, CHUNK)), len(text)))
                cuts = cuts if cuts[0] == 0 else np.append(0, cuts)
                made = [facts(text[lo:hi], *[m[lo:hi] for m in marks]) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                told = {k: pa.concat_arrays([m[k] for m in made]) for k in FACTS}
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], *told.values()], names=[*plain, *told])

    return rows.mapInArrow(run, schema).select(*plain, F.lit(None).cast("string").alias("text"), *FACTS)


def known(rows: DataFrame, p: str = "") -> bool:
    """Whether the rows have the facts of the texts with a prefix."""
    return f"{p}chars" in rows.columns


def combined(first: Column, texts: Column, alone: Column) -> list[Column]:
    """The facts of a region: of its first block where that is ``alone``, else of its ``texts``, which are joined by line ends."""
    own = F.filter(texts, lambda b: b["chars"] > 0)
    add = lambda acc, v: acc + v
    out = []
    for k in SUMS:
        value = F.aggregate(own[k], F.lit(0), add)
        if k == "chars":
            value = value + F.greatest(F.size(own) - 1, F.lit(0))
        out.append(F.when(alone, first[k]).otherwise(value).alias(k))
    added = F.aggregate(own["counts"], F.array_repeat(F.lit(0), len(tx.SCRIPTS)), lambda acc, v: F.zip_with(acc, v, add))
    return [*out, F.when(alone, first["counts"]).otherwise(added).alias("counts"), F.when(alone, first["numbers"]).otherwise(F.flatten(own["numbers"])).alias("numbers")]


def chars(rows: DataFrame, p: str = "") -> Column:
    return F.col(f"{p}chars") if known(rows, p) else F.length(F.coalesce(f"{p}text", F.lit("")))


def solid(rows: DataFrame, p: str = "") -> Column:
    """Characters that aren't spaces."""
    return F.col(f"{p}solid") if known(rows, p) else F.length(F.regexp_replace(F.coalesce(f"{p}text", F.lit("")), r"(?U)\s", ""))


def narrow_letters(rows: DataFrame, p: str) -> Column:
    """All letters of a text on a narrow target region."""
    return F.col(f"{p}letters") if known(rows, p) else F.regexp_count(f"{p}text", F.lit(r"\p{L}"))


def script(rows: DataFrame, p: str) -> Column:
    """The script with most letters; null without letters or on a tie."""
    if not known(rows, p):
        return tx.main_script(F.col(f"{p}text"))
    counts = F.col(f"{p}counts")
    most = F.array_max(counts)
    place = F.array_position(counts, most).cast("int")
    after = F.slice(counts, place + 1, len(tx.SCRIPTS))
    return F.when((most > 0) & (F.array_position(after, most) == 0), F.element_at(F.array(*[F.lit(s) for s in tx.SCRIPTS]), place))


def letters_by_script(rows: DataFrame, p: str, script: Column) -> tuple[Column, Column, Column]:
    """Of a text's letters all, those of a script, and those outside acronyms."""
    if not known(rows, p):
        text = F.col(f"{p}text")
        return tx.letters(text), tx.script_letters(text, script), tx.letters(tx.without_acronyms(text))
    counts = F.col(f"{p}counts")
    at = lambda k: F.get(counts, F.lit(k))
    own = F.lit(0)
    for k, name in enumerate(tx.SCRIPTS):
        own = F.when(script == name, at(k)).otherwise(own)
    every = sum((at(k) for k in range(1, len(tx.SCRIPTS))), at(0))
    return every, own, every - F.col(f"{p}capitals")
