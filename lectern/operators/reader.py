"""A reader of headings: the book and chapter that it is in, carried through any number of tasks.

What a stretch of headings does to a reader is a function of where it was before. Each task works out that function for
its stretch of a key that others have stretches of too, a small table applies one after the other, and each task then reads
its stretch from where it begins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.scans import in_ranges, joined_by
from lectern.session import ship

FAR = 1 << 62


class Place(NamedTuple):
    """Where a reader is, and whether it has seen a verse since its chapter changed. chapter: None where it has none.

    moved: the chapter is that of the reader before the stretch, plus `chapter`.
    """

    book: str | None
    chapter: int | None
    seen: bool
    moved: bool = False


class Heading(NamedTuple):
    """What a line may be to a reader.

    what: 'begin' begins a book at chapter 1; 'edges' are a page's first and last line, a book with a chapter or alone;
    'chapter' names one, `again` is another reading of a number that is too large; 'section' is a heading that opens a
    section if its chapter is the reader's or the next; 'verse' is of its own chapter where it has a number; 'line' is
    a header (`header`: 'whole' with book and chapter, 'chaptered', 'bare'), or anything else. title: it may also be a
    chapter's title, and if verses were seen it is. last: the book's chapters, where the reader doesn't know them.
    """

    what: str
    book: str | None = None
    number: int | None = None
    again: int | None = None
    book2: str | None = None
    number2: int | None = None
    header: str | None = None
    title: bool = False
    last: int | None = None


#: Columns of headings (named so, behind MARK), and what reading adds to them.
MARK = "_h_"
COLUMNS = {"what": "string", "book": "string", "number": "int", "again": "int", "book2": "string", "number2": "int", "header": "string", "title": "boolean", "last": "int"}
READ = "read string, at_book string, at_chapter int"

Piece = tuple[int, int, Place, str]


def _where(place: Place, value: int, low: int, high: int) -> list[tuple[int, int, Place, bool]]:
    """place parted by whether its chapter is value. low and high: between which the chapter before the stretch is."""
    if not place.moved:
        return [(low, high, place, place.chapter == value)]
    at = value - place.chapter
    parts = ((low, min(high, at - 1), False), (max(low, at), min(high, at), True), (max(low, at + 1), high, False))
    return [(a, b, place, is_it) for a, b, is_it in parts if a <= b]


def _to(place: Place, book: str | None, chapter: int, low: int, high: int, read: str) -> list[Piece]:
    """At a place; what was seen holds if the reader is there already."""
    if not place.seen or place.book != book:
        return [(low, high, Place(book, chapter, False), read)]
    return [(a, b, Place(book, chapter, same), read) for a, b, _, same in _where(place, chapter, low, high)]


def read(place: Place, h: Heading, low: int, high: int, lasts: dict[str, int] | None) -> list[Piece]:
    """Where a heading leaves a reader, and what it was to it: one piece, or several if it depends on the unknown chapter."""
    last = h.last if lasts is None else lasts.get(place.book)
    if h.what == "begin":
        return [(low, high, Place(h.book or place.book, 1, False), "begin")]
    if h.what == "edges":
        for book, number in ((h.book, h.number), (h.book2, h.number2)):
            if book is not None and number is not None:
                return _to(place, book, number, low, high, "edges")
            if book is not None and book != place.book:
                return [(low, high, Place(book, 1, False), "edges")]
        return [(low, high, place, "edges")]
    if h.what == "chapter" and h.number is not None:
        number = h.number
        if last is not None and number > last:
            number = h.again if h.again is not None and h.again <= last else last
        return _to(place, place.book, number, low, high, "chapter")
    if h.what == "section":
        if h.number is None:
            return [(low, high, place, "")]
        if place.chapter is None:
            return [(low, high, place._replace(chapter=h.number), "section")]
        found: list[Piece] = []
        for a, b, p, same in _where(place, h.number, low, high):
            for x, y, q, next_ in [(a, b, p, True)] if same else _where(p, h.number - 1, a, b):
                found.append((x, y, Place(q.book, h.number, q.seen), "section") if next_ else (x, y, q, ""))
        return found
    if h.title and place.chapter is not None and place.seen:
        most = FAR if last is None else last
        if not place.moved:
            return [(low, high, Place(place.book, min(place.chapter + 1, most), False), "title")]
        top = most - place.chapter  # from here on, the next chapter would be beyond the last
        parts = ((low, min(high, top - 1), Place(place.book, place.chapter + 1, False, True)), (max(low, top), high, Place(place.book, most, False)))
        return [(a, b, p, "title") for a, b, p in parts if a <= b]
    if h.what == "verse":
        there = place if h.number is None else Place(place.book, h.number, place.seen)
        return [(low, high, there._replace(seen=place.seen or there.chapter is not None), "verse")]
    if h.header == "whole":
        return [(low, high, Place(h.book, h.number, True), "header")]
    if h.header == "chaptered" and place.book is not None:
        return [(low, high, Place(place.book, h.number, True), "header")]
    if h.header == "bare" and place.book is not None and place.chapter is not None:
        return [(low, high, place._replace(seen=True), "header")]
    return [(low, high, place, "")]


class Stretch:
    """What a stretch of headings does to a reader, from wherever it comes."""

    def __init__(self, books: list[str | None], lasts: dict[str, int] | None):
        self.lasts = lasts
        self.ends: dict[Place, list[tuple]] = {}
        for book in books:
            for seen in (False, True):
                self.ends[Place(book, None, seen)] = [(book, seen, None, None)]
                self.ends[Place(book, 0, seen, True)] = [(book, seen, -FAR, FAR)]

    def add(self, h: Heading) -> None:
        ends: dict[Place, list[tuple]] = {}
        for place, starts in self.ends.items():
            if not place.moved:
                [(_, _, there, _)] = read(place, h, 0, 0, self.lasts)
                ends.setdefault(there, []).extend(starts)
                continue
            for book, seen, low, high in starts:
                for a, b, there, _ in read(place, h, low, high, self.lasts):
                    ends.setdefault(there, []).append((book, seen, a, b))
        self.ends = ends

    def packed(self) -> str:
        return json.dumps([[list(p), starts] for p, starts in self.ends.items()])


def after(stretch: str, place: Place) -> Place:
    """Where a reader is behind a packed stretch."""
    for (book, chapter, seen, moved), starts in json.loads(stretch):
        for book0, seen0, low, high in starts:
            known = low is not None
            if (book0, seen0, known) == (place.book, place.seen, place.chapter is not None) and (not known or low <= place.chapter <= high):
                return Place(book, place.chapter + chapter if moved else chapter, seen)
    raise ValueError(f"{place} is not among the books that the reader knows")


def heading_columns(**said: Column) -> dict[str, Column]:
    """A Heading's fields as columns; those that aren't said are null."""
    return {MARK + c: said.get(c, F.lit(None)).cast(kind) for c, kind in COLUMNS.items()}


def _headings(batch: pd.DataFrame) -> Iterator[Heading]:
    values = []
    for c, kind in COLUMNS.items():
        column = batch[MARK + c]
        kept = column.astype(object).where(column.notna(), None)
        values.append([None if v is None else int(v) for v in kept] if kind == "int" else [bool(v) for v in kept] if kind == "boolean" else list(kept))
    return map(Heading, *values)


def headings_read(
    headings: DataFrame, keys: list[str], order: list[str], books: list[str] | None = None, lasts: dict[str, int] | None = None, parts: int | None = None
) -> DataFrame:
    """headings(keys, order, heading_columns(), ...) with READ in place of these: what each was to its key's reader, and where it left it.

    A reader begins in the book that `first_book` says, if there is such a column, and in no chapter. books: all that
    headings may name. lasts: their chapters; without it headings say them. Each task holds a function of its stretch:
    a few pieces for each book, until a heading names a place whatever was before. What is carried between tasks is
    one such function for each part of a key that has several, of which there are fewer than parts; keys of one part
    are read at once. Headings that in_ranges has written are read as they are.
    """
    ship(headings.sparkSession)
    ranged = headings if "_part" in headings.columns else in_ranges(headings, keys, order, parts)
    known = [None, *(books or [])]
    by = [*keys, "_part"]
    first = "first_book" in headings.columns
    kinds = ", ".join(f"`{k}` {ranged.schema[k].dataType.simpleString()}" for k in by)

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stretch, book = None, None, None
        for batch in batches:
            out = []
            for *key, h, begins in zip(*(batch[k] for k in by), _headings(batch), batch["first_book"] if first else [None] * len(batch), strict=True):
                if stretch is None or not _same(key, now):
                    if stretch is not None:
                        out.append([*now, book, stretch.packed()])
                    now, stretch, book = key, Stretch(known, lasts), None if pd.isna(begins) else begins
                stretch.add(h)
            yield pd.DataFrame(out, columns=[*by, "_book", "_stretch"])
        if stretch is not None:
            yield pd.DataFrame([[*now, book, stretch.packed()]], columns=[*by, "_book", "_stretch"])

    def begun(stretches: pd.DataFrame) -> pd.DataFrame:
        stretches = stretches.sort_values("_part")
        book = stretches["_book"].iloc[0]
        place, starts = Place(None if pd.isna(book) else book, None, False), []
        for stretch in stretches["_stretch"]:
            starts.append(json.dumps(place))
            place = after(stretch, place)
        return stretches[by].assign(_start=starts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, place = None, None
        for batch in batches:
            out = []
            for *key, start, begins, h in zip(*(batch[k] for k in by), batch["_start"], batch["first_book"] if first else [None] * len(batch), _headings(batch), strict=True):
                if now is None or not _same(key, now):
                    now, place = key, Place(None if pd.isna(begins) else begins, None, False) if pd.isna(start) else Place(*json.loads(start))
                [(_, _, place, was)] = read(place, h, 0, 0, lasts)
                out.append((was, place.book, place.chapter))
            said = pd.DataFrame(out, columns=["read", "at_book", "at_chapter"], index=batch.index)
            yield batch.drop(columns=["_start"]).assign(read=said["read"], at_book=said["at_book"], at_chapter=said["at_chapter"].astype("Int32"))

    apart = lambda rows: rows.repartition(*by).sortWithinPartitions(*by, *order)
    needed = [*by, *(c for c in order if c not in by), *(MARK + c for c in COLUMNS), *(["first_book"] if first else [])]
    several = ranged.groupBy(*keys).agg((F.min("_part") < F.max("_part")).alias("_several")).where("_several")  # fewer than parts
    cut = joined_by(ranged.select(*dict.fromkeys(needed)), F.broadcast(several), keys).where("_several").drop("_several")
    functions = apart(cut).mapInPandas(stretches, f"{kinds}, _book string, _stretch string")
    starts = functions.groupBy(*keys).applyInPandas(begun, f"{kinds}, _start string")
    rows = joined_by(ranged, F.broadcast(starts), by)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    return apart(rows).mapInPandas(run, f"{shape}, {READ}").drop("_part", *(MARK + c for c in COLUMNS))


def _same(a: list, b: list) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True))

