"""Column functions over text: folding, tokens, trimming, names, front matter and links."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser's string functions see it.
WS = "[\\s\\x0B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: The characters that WS is for.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@cache
def _accents() -> tuple[str, str]:
    """Letters that are one base letter with marks, and their bases; Hangul syllables are left whole."""
    pairs = []
    for code in range(0x80, 0x20000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        bases = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(bases) == 1 and bases[0] != c:
            pairs.append((c, bases[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), *_accents()), "\\p{Mn}", "")


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text; none for null.

    Marks count as part of a run until it is folded, and only runs with letters beyond ASCII are.
    """
    plain = "[^\\x00-\\x7F]"
    found = F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}\\p{Mn}]+)"), F.lit(1))
    folded = F.filter(F.transform(found, lambda t: F.when(t.rlike(plain), fold(t)).otherwise(t)), lambda t: t != "")
    return F.coalesce(F.when(text.rlike(plain), folded).otherwise(found), F.array().cast("array<string>"))


def query_tokens(query: str) -> list[str]:
    """A query's tokens, folded; each stands for every term that it begins. Composed first, so that a decomposed query
    finds what a composed one finds."""
    text = unicodedata.normalize("NFC", query).lower()
    runs, run = [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            runs.append(run)
            run = ""
    table = str.maketrans(*_accents())
    return [r.translate(table) for r in runs]


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    inner = strip(text)
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, f"{WS}+")))


def safe_name(text: Column) -> Column:
    """A file name: forbidden characters to '-', runs of blanks to one, at most 180 characters, 'untitled' if empty."""
    clean = F.regexp_replace(F.regexp_replace(text, '[:/\\\\?*"<>|]', "-"), f"{WS}+", " ")
    return F.coalesce(F.nullif(F.substring(strip(clean), 1, 180), F.lit("")), F.lit("untitled"))


def split_authors(text: Column) -> Column:
    """Names between '&', ';' and 'and', without blanks around them."""
    parts = F.transform(F.split(text, f"(?i){WS}*[&;]{WS}*|{WS}+and{WS}+"), strip)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def tag_name(text: Column) -> Column:
    """A tag without its '#', in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(strip(text), "^#", "")), F.lit(""))


def match_key(text: Column) -> Column:
    """Letters and digits in lower case, to compare names by."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def wiki_targets(text: Column) -> Column:
    """Targets of [[target#section|alias]] links, without blanks around them."""
    inner = F.regexp_extract_all(text, F.lit("\\[\\[([^\\]]+)\\]\\]"), F.lit(1))
    return F.transform(inner, lambda x: strip(F.regexp_extract(x, "^([^#|]*)", 1)))


def leading_number(text: Column) -> Column:
    """The number that a text begins with; null if none."""
    return F.nullif(F.regexp_extract(text, f"^{WS}*([-+]?[0-9]*\\.?[0-9]+)", 1), F.lit("")).cast("double")


def _subtracted(numeral: Column) -> Column:
    """The sum of a numeral's digits in capitals, with each before a larger one taken off."""
    value = F.create_map(*(x for k, v in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in (F.lit(k), F.lit(v))))
    digits = F.transform(F.split(numeral, ""), lambda c: F.try_element_at(value, c))
    signed = F.transform(digits, lambda d, i: F.when(d < F.coalesce(F.get(digits, i + 1), F.lit(0)), -d).otherwise(d))
    return F.aggregate(signed, F.lit(0), lambda a, b: a + b)


def roman(text: Column) -> Column:
    """The value of a roman numeral by subtraction; null for any other text."""
    return F.when(F.upper(text).rlike("^(?=.)M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\\z"), _subtracted(F.upper(text)))


def scanned_readings(text: Column) -> tuple[Column, Column]:
    """What a numeral of a scan says, and what it says with each l as an I; null for what is none.

    Numerals that no one writes are read as well ('VL' is 45), but none with V, L or D twice in a row.
    """

    def read(numeral: Column) -> Column:
        clean = F.upper(strip(numeral))
        value = _subtracted(clean)
        return F.when(clean.rlike("^[IVXLCDM]+\\z") & ~clean.rlike("VV|LL|DD") & (value > 0), value)

    return read(text), F.when(text.rlike("[lL]"), read(F.translate(text, "lL", "ii")))


def scanned_roman(text: Column, last: Column) -> Column:
    """A chapter's roman numeral as a scan gives it: one beyond the last chapter is read again with each l as an I."""
    first, again = scanned_readings(text)
    return F.when((first > last) & (again <= last), again).otherwise(first)


def capitalised(text: Column) -> Column:
    """Each run of A-Z in either case with a capital and the rest in lower case."""
    parts = F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike("^[A-Za-z]"), F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))).otherwise(w)), "")


def html_text(html: Column) -> Column:
    """The text of a page: line breaks to blanks, no scripts, styles or tags, common entities decoded, blanks as one."""
    body = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>", " ")
    body = F.regexp_replace(F.regexp_replace(body, "(?i)<br\\s*/?>", " "), "(?s)<[^>]*>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(mark))
    return strip(F.regexp_replace(body, f"{WS}+", " "))
