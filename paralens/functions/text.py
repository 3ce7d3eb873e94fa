"""Text functions as column expressions: numbers, scripts, terms, language tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits and separators of other writing systems and their ASCII forms.
DIGITS_FROM = "０１２３４５６７８９．，٠١٢٣٤٥٦٧٨٩٫٬۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "0123456789.,0123456789.,0123456789"
NUMBER = r"(?U)\d+(?:(?:,\d{3})+(?:\.\d+)?|(?:\.\d+)?)"
#: Letters of each script.
SCRIPTS = {
    "latin": r"[A-Za-z]",
    "cjk": r"[一-鿿㐀-䶿]",
    "arabic": r"[ؠ-يٮ-ۓ]",
    "hebrew": r"[ְ-ת]",
    "cyrillic": r"[Ѐ-ӿ]",
    "greek": r"[Ͱ-Ͽἀ-῿]",
    "devanagari": r"[ऀ-ॿ]",
    "bengali": r"[ঀ-৿]",
    "thai": r"[฀-๿]",
    "hangul": r"[가-힯ᄀ-ᇿ]",
    "kana": r"[぀-ヿ]",
}
# one class, not eleven ways to try at each character
ANY_SCRIPT = f"[{''.join(p[1:-1] for p in SCRIPTS.values())}]"
# the first capital is found before its boundary is looked at
ACRONYM = r"(?U)[A-Z](?<=\b[A-Z])[A-Z]+\b"


def normalized_digits(text: Column) -> Column:
    return F.translate(text, DIGITS_FROM, DIGITS_TO)


def normalized_number(token: Column) -> Column:
    """Without thousands commas and leading zeros; the fraction stays as written."""
    plain = F.regexp_replace(token, ",", "")
    whole = F.regexp_replace(F.substring_index(plain, ".", 1), "^0+(?=.)", "")
    return F.when(F.contains(plain, F.lit(".")), F.concat(whole, F.lit("."), F.substring_index(plain, ".", -1))).otherwise(whole)


def numbers(text: Column) -> Column:
    """The normal forms of all numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(normalized_digits(F.coalesce(text, F.lit(""))), F.lit(NUMBER), F.lit(0)), normalized_number)


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of a text a class of characters takes."""
    text = F.coalesce(text, F.lit(""))
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def uncommon(text: Column) -> Column:
    """What neither ASCII nor the commonest script has of a text: mostly little."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x00-\x7F{SCRIPTS['cjk'][1:-1]}]+", "")


def letters(text: Column) -> Column:
    """Letters of any of the scripts."""
    return count_of(text, SCRIPTS["latin"]) + count_of(text, SCRIPTS["cjk"]) + count_of(uncommon(text), ANY_SCRIPT)


def without_acronyms(text: Column) -> Column:
    return F.regexp_replace(text, ACRONYM, "")


def script_letters(text: Column, script: Column) -> Column:
    """Letters of the script that a column names."""
    out = F.lit(0)
    for name, pattern in SCRIPTS.items():
        out = F.when(script == name, count_of(text, pattern)).otherwise(out)
    return out


def main_script(text: Column) -> Column:
    """The script with most letters; null without letters or on a tie."""
    # a variable of transform holds what is made once
    counts = lambda rest: F.sort_array(F.array(*[F.struct(count_of(text if name in ("latin", "cjk") else rest, p).alias("n"), F.lit(name).alias("script")) for name, p in SCRIPTS.items()]), asc=False)
    votes = F.transform(F.array(uncommon(text)), counts)
    return F.get(F.transform(votes, lambda v: F.when((v[0]["n"] > 0) & (v[0]["n"] > v[1]["n"]), v[0]["script"])), 0)


def term_hit(text: Column, term: Column, case_sensitive: Column) -> Column:
    """Whether a term stands in a text: as whole words if it has a Latin letter, else as a substring."""
    quoted = F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    boundary = F.concat(F.when(case_sensitive, F.lit("(?U)")).otherwise(F.lit("(?iU)")), F.lit(r"\b"), quoted, F.lit(r"\b"))
    return F.when(term.rlike("[A-Za-z]"), F.rlike(text, boundary)).otherwise(F.contains(text, term))


def language_tag(value: Column) -> Column:
    """A BCP 47 tag in normal case: language lower, script title, region upper; ``und`` stays, what isn't a tag is null."""
    raw = F.trim(value)
    shaped = F.transform(
        F.split(raw, "-"),
        lambda p, i: F.when(i == 0, F.lower(p)).when(p.rlike("^[A-Za-z]{4}$"), F.initcap(F.lower(p))).when(p.rlike("^[A-Za-z]{2}$"), F.upper(p)).otherwise(F.lower(p)),
    )
    return F.when(F.lower(raw) == "und", F.lit("und")).when(raw.rlike("^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$"), F.array_join(shaped, "-"))
