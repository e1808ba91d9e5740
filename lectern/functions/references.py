"""References to passages in free text, for any canon that is given as a list of books."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import WS, strip


@dataclass(frozen=True)
class Book:
    """A book of a canon: its code, name, chapters, further spellings, and spellings that only whole headings use."""

    code: str
    name: str
    chapters: int
    abbreviations: tuple[str, ...] = ()
    long_names: tuple[str, ...] = ()


def _either(spellings: list[str]) -> str:
    return "|".join(re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", s) for s in sorted(spellings, key=len, reverse=True))


def _known(canon: list[Book]) -> Column:
    """A map from each spelling in lower case to its book."""
    cells = []
    for b in canon:
        for s in dict.fromkeys(x.lower() for x in (b.name, *b.abbreviations, *b.long_names)):
            cells += [F.lit(s), F.struct(F.lit(b.code).alias("code"), F.lit(b.name).alias("name"), F.lit(b.chapters).alias("chapters"))]
    return F.create_map(*cells)


def _core(canon: list[Book]) -> str:
    names = _either([s for b in canon for s in (b.name, *b.abbreviations)])
    return f"({names})(?![A-Za-z0-9_])\\.?{WS}+([0-9]{{1,3}})(?::([0-9]{{1,3}})(?:{WS}*[-–]{WS}*([0-9]{{1,3}}))?)?"


def _built(known: Column, raw: Column, spelling: Column, chapter: Column, first: Column, last: Column, at: Column) -> Column:
    """A reference, or null where the book has no such chapter."""
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    book = F.try_element_at(known, F.lower(spelling))
    made = F.struct(
        raw.alias("raw"), at.cast("int").alias("at"), book["code"].alias("book"), book["name"].alias("name"),
        number(chapter).alias("chapter"), number(first).alias("verse"), F.coalesce(number(last), number(first)).alias("verse_end"),
    )
    return F.when(number(chapter).between(1, book["chapters"]), made)


def find_references(text: Column, canon: list[Book]) -> Column:
    """array<struct(raw, at, book, name, chapter, verse, verse_end)> of the references in a text; empty for null.

    'Rom. 3:28-30', in the case of the canon's spellings, the longest spelling first; `at` counts characters from 0.
    The text between the matches gives their places, so that no Python is needed.
    """
    pattern = f"(?<![A-Za-z0-9_]){_core(canon)}"
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    cells = F.arrays_zip(part(0).alias("raw"), part(1).alias("s"), part(2).alias("c"), part(3).alias("v"), part(4).alias("w"), gaps.alias("gap"))
    none = "array<struct<raw:string,at:int,book:string,name:string,chapter:int,verse:int,verse_end:int>>"
    known = _known(canon)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(none).alias("found"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + x["gap"]
        one = F.array_compact(F.array(_built(known, x["raw"], x["s"], x["c"], x["v"], x["w"], at)))
        return F.struct((at + F.coalesce(F.length(x["raw"]), F.lit(0))).alias("at"), F.concat(state["found"], one.cast(none)).alias("found"))

    found = F.aggregate(cells, start, step, lambda s: s["found"])
    return F.coalesce(F.when(text.rlike(pattern), found), F.array().cast(none))


def parse_reference(text: Column, canon: list[Book]) -> Column:
    """The one reference that a text is, in any case; null if it is none."""
    part = lambda i: F.regexp_extract(text, f"(?i)^{WS}*{_core(canon)}{WS}*\\z", i)
    return F.when(part(1) != "", _built(_known(canon), strip(text), part(1), part(2), part(3), part(4), F.lit(0)))


def book_code(name: Column, canon: list[Book]) -> Column:
    """The code of a book by any of its spellings, in any case; null if there is none."""
    return F.try_element_at(_known(canon), F.lower(strip(name)))["code"]


def label_book(label: Column, canon: list[Book]) -> Column:
    """The code of the book that a label of a table of contents is, stops at its end apart; null if it says anything else."""
    clean = F.regexp_replace(strip(F.regexp_replace(label, f"{WS}+", " ")), "[.,;:]+\\z", "")
    return F.try_element_at(_known(canon), F.lower(clean))["code"]


def trailing_book(text: Column, canon: list[Book]) -> Column:
    """The code of the book whose full name a text ends with, as a running header does; null if none."""
    names = _either([s for b in canon for s in (b.name, *b.long_names)])
    return book_code(F.regexp_extract(strip(text), f"(?<![A-Za-z0-9_])({names})\\z", 1), canon)


def trailing_reference(text: Column, canon: list[Book]) -> Column:
    """struct(book, chapter, verse, verse_end) of a heading that ends with 'JAMES 3:13-18', in any case; else null.

    Books of one chapter may go without it: '2 JOHN 7-11'.
    """
    names = _either([s for b in canon for s in (b.name, *b.abbreviations)])
    known, number = _known(canon), lambda c: F.nullif(c, F.lit("")).cast("int")
    span = f"([0-9]{{1,3}})(?:{WS}*[-–—]{WS}*([0-9]{{1,3}}))?{WS}*\\z"
    full = lambda i: F.regexp_extract(text, f"(?i)(?<![A-Za-z0-9_])({names}){WS}+([0-9]{{1,3}})[:.]{span}", i)
    bare = lambda i: F.regexp_extract(text, f"(?i)(?<![A-Za-z0-9_])({names}){WS}+{span}", i)

    def made(name: Column, chapter: Column, first: Column, last: Column) -> Column:
        code = F.try_element_at(known, F.lower(name))["code"]
        return F.struct(code.alias("book"), chapter.alias("chapter"), number(first).alias("verse"), F.coalesce(number(last), number(first)).alias("verse_end"))

    single = F.try_element_at(known, F.lower(bare(1)))["chapters"] == 1
    return F.when(full(1) != "", made(full(1), number(full(2)), full(3), full(4))).when(single, made(bare(1), F.lit(1), bare(2), bare(3)))


def section_reference(ref: Column) -> Column:
    """struct(document, ordinal) of 'AC:4'; null if it isn't one. Whether the document is known is a join's matter."""
    part = lambda i: F.regexp_extract(strip(ref), "^([A-Z-]+):([0-9]+)\\z", i)
    ordinal = F.nullif(part(2), F.lit("")).cast("int")
    return F.when(ordinal >= 1, F.struct(part(1).alias("document"), ordinal.alias("ordinal")))
