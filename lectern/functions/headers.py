"""Headings that open an excerpt. A shape says what stands around a span of verses; the span is then taken apart by itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.names import numeral
from lectern.functions.references import Book, find_references
from lectern.functions.text import WS, roman, scanned_readings, strip
from lectern.functions.values import once

#: What a scan makes of the digit 1, the marks between two ends, and the words before a chapter and a verse.
STROKES = "lLI|]"
DASHES = "-–—"
CHAPTER_WORDS = ("Chapter", "Chap", "Cap")
VERSE_WORDS = ("Verses", "Verse", "Vers", "Vv", "V")

_DIGITS = "[0-9]{1,3}"
_SCANNED = f"(?:{_DIGITS}|[{STROKES.replace(']', chr(92) + ']')}]{{1,2}})"
_DASH = f"{WS}*[{DASHES}]{WS}*"


def _word(words: tuple[str, ...]) -> str:
    """One of some words in any case, with a full stop or none."""
    return f"(?i:(?:{'|'.join(words)})\\.?)"


@dataclass(frozen=True)
class Shape:
    """opens, a span and closes, from the start of a line. The span's numbers may be scanned strokes, its ends may name
    chapters before a colon, or a chapter in Roman letters may stand before it; the current chapter holds otherwise."""

    opens: str = ""
    closes: str = ""
    colon: bool = False
    roman: bool = False
    scanned: bool = True

    def pattern(self) -> str:
        """With the Roman chapter and the span as groups."""
        number = _SCANNED if self.scanned else _DIGITS
        chapter = f"{_DIGITS}{WS}*:{WS}*"
        first, second = (chapter + number, f"(?:{chapter})?{number}") if self.colon else (number, number)
        before = f"((?i:[ivxlcdm]+))(?![A-Za-z0-9_])[.,]?{WS}*(?:{_word(VERSE_WORDS)})?{WS}*" if self.roman else "()"
        return f"^{self.opens}{before}({first}(?:{_DASH}{second})?){self.closes}"


#: Shapes by the names that settings use (fixed values).
SHAPES = {
    "chapter-verse": Shape("\\(?", "\\)?", colon=True, scanned=False),
    "chapter-verse-roman": Shape(f"\\(?(?:{_word(CHAPTER_WORDS)})?{WS}*", "\\)?", roman=True, scanned=False),
    "bracket-number": Shape("\\[", "\\]"),
    "paren-number": Shape(closes="\\)"),
    "word-label": Shape(f"{_word(VERSE_WORDS)}{WS}+", "\\.?"),
    "phrase-label": Shape(f"[^:\\n]{{1,80}}:{WS}*{_word(VERSE_WORDS)}{WS}+", "\\.?"),
    "bare-range": Shape(closes="\\."),
}


def parse_header(line: Column, shape: str, book: Column, chapter: Column, canon: list[Book]) -> Column:
    """struct(raw, book, cs, vs, ce, ve, contextual, glitched) of a line in a shape; null if it isn't in it.

    book and chapter are those that are current: 'book-chapter-verse' needs neither, the two with a chapter need the
    book, and bare verses need both. glitched: the verse was no number in digits, and is taken for 1.
    """
    if shape == "book-chapter-verse":

        def found(ref: Column) -> Column:
            made = _made(ref["raw"], ref["book"], ref["chapter"], F.coalesce(ref["verse"], F.lit(1)), ref["chapter"], F.coalesce(ref["verse_end"], F.lit(1)), False, F.lit(False))
            return F.when(ref["at"] == 0, made)

        return once(once(strip(line), lambda text: F.get(find_references(text, canon), F.lit(0))), found)
    is_of = SHAPES[shape]
    group = lambda text, i: F.regexp_extract(text, is_of.pattern(), i)
    digits = lambda x: F.when(x.rlike("^[0-9]+\\z"), x.cast("int"))

    def taken(text: Column, span: Column) -> Column:
        return F.when((span != "") & book.isNotNull(), once(F.split(span, _DASH), lambda ends: spanned(text, ends)))

    def spanned(text: Column, ends: Column) -> Column:
        sides = F.transform(F.array(F.get(ends, F.lit(0)), F.get(ends, F.lit(1))), lambda e: F.split(e, f"{WS}*:{WS}*"))
        return once(sides, lambda s: header(text, [F.get(s, F.lit(k)) for k in (0, 1)]))

    def header(text: Column, sides: list[Column]) -> Column:
        verses = [F.element_at(side, -1) for side in sides]
        named = [F.when(F.size(side) > 1, digits(F.get(side, F.lit(0)))) for side in sides]
        start = once(F.nullif(group(text, 1), F.lit("")), roman) if is_of.roman else named[0] if is_of.colon else chapter
        own = F.struct(start.alias("start"), numeral(verses[0]).alias("first"), digits(verses[0]).isNull().alias("glitched"))
        contextual = not (is_of.colon or is_of.roman)
        made = lambda o: _made(group(text, 0), book, o["start"], o["first"], F.coalesce(named[1], o["start"]), F.coalesce(digits(verses[1]), o["first"]), contextual, o["glitched"])
        return once(own, lambda o: F.when(o["start"].isNotNull(), made(o)))

    return once(strip(line), lambda text: once(group(text, 2), lambda span: taken(text, span)))


def _made(raw: Column, book: Column, cs: Column, vs: Column, ce: Column, ve: Column, contextual: bool, glitched: Column) -> Column:
    names = ("raw", "book", "cs", "vs", "ce", "ve", "contextual", "glitched")
    return F.struct(*(x.alias(n) for x, n in zip((raw, book, cs, vs, ce, ve, F.lit(contextual), glitched), names)))


def _chapter_words(line: Column) -> tuple[Column, Column]:
    """Whether a line is two words of which the first means a chapter, and the second."""
    words = F.split(strip(line), f"{WS}+")
    first = F.lower(F.regexp_replace(F.get(words, F.lit(0)), "\\.\\z", ""))
    return (F.size(words) == 2) & first.isin(*map(str.lower, CHAPTER_WORDS)), F.get(words, F.lit(1))


def chapter_header(line: Column) -> Column:
    """The number of a heading that is only a chapter's: 'Chapter III', 'Cap. iv.'; null for any other."""
    named, number = _chapter_words(line)
    return F.when(named, roman(F.lower(F.regexp_replace(number, "\\.\\z", ""))))


def scanned_chapter_header(line: Column) -> tuple[Column, Column]:
    """The number of such a heading in a scan, and its other reading; see text.scanned_readings."""
    named, number = _chapter_words(line)
    first, again = scanned_readings(F.regexp_replace(number, "\\.\\z", ""))
    return F.when(named, first), F.when(named, again)


def may_be_chapter_title(line: Column) -> Column:
    """Whether a line is 'Chapter' and a word, whatever a scan made of that."""
    return F.coalesce(_chapter_words(line)[0], F.lit(False))
