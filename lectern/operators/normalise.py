"""Putting excerpts right: verses beyond their chapter, headings that are only citations, and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.reader import heading_columns, headings_read
from lectern.operators.scans import scanned


def within_chapters(excerpts: DataFrame, verses: DataFrame) -> DataFrame:
    """excerpts(book, position, cs, vs, ce, ve, ...) inside their chapters, with what was done to them as `fix`.

    verses(book, chapter, last) are the known chapters; books that it doesn't have stay as they are. An end beyond the
    chapter is clamped; a start one verse beyond goes to the last verse; else the excerpt is taken for one of the chapter
    before, if it fits there and no excerpt has that place; what is left is dropped. Rows that would take the same place
    in the chapter before are exactly those that have the same place now, so the first of them takes it: no pass over
    the rows one by one is needed.
    """
    last = verses
    here = last.select("book", F.col("chapter").alias("cs"), F.col("last").alias("_here"))
    before = last.select("book", (F.col("chapter") + 1).alias("cs"), F.col("last").alias("_before"))
    known = verses.select("book").distinct().withColumn("_known", F.lit(True))
    place = ["book", "cs", "vs", "ve"]
    taken = excerpts.select("book", (F.col("cs") + 1).alias("cs"), "vs", "ve").distinct().withColumn("_taken", F.lit(True))
    rows = excerpts.join(known, "book", "left").join(here, ["book", "cs"], "left").join(before, ["book", "cs"], "left")
    rows = rows.join(taken, place, "left").withColumn("_nth", F.row_number().over(Window.partitionBy(*place).orderBy("position")))
    most = F.coalesce("_here", F.lit(0))
    prior = F.coalesce("_before", F.lit(0))
    fits = (F.col("vs") <= prior) & (F.col("ve") <= prior) & F.col("_taken").isNull() & (F.col("_nth") == 1)
    fix = (
        F.when(F.col("_known").isNull() | ((F.col("vs") <= most) & (F.col("ve") <= most)), "none")
        .when((most > 0) & (F.col("vs") <= most), "clamp")
        .when((most > 0) & (F.col("vs") == most + 1) & (F.col("ve") <= most + 1), "merge")
        .when(fits, "relabel")
        .otherwise("drop")
    )
    rows = rows.withColumn("fix", fix).where("fix <> 'drop'")
    back = F.when(F.col("fix") == "relabel", 1).otherwise(0)
    new = {
        "cs": F.col("cs") - back,
        "ce": F.col("ce") - back,
        "vs": F.when(F.col("fix") == "merge", most).otherwise(F.col("vs")),
        "ve": F.when(F.col("fix").isin("clamp", "merge"), most).otherwise(F.col("ve")),
    }
    return rows.withColumns(new).select(*excerpts.columns, "fix")


def reading_order() -> list:
    """Order of excerpts within a book: by start, the wider range first."""
    return [F.col("cs").asc(), F.col("vs").asc(), F.col("ve").desc(), F.col("position").asc()]


def section_headings(headings: DataFrame, keys: list[str], order: str = "position", chapter: str = "chapter", parts: int | None = None) -> DataFrame:
    """Add opens: whether a heading is a section's, or a citation of a chapter that is neither the last one nor the next.

    The last chapter moves only with headings that open a section; reader.headings_read carries it through the parts of
    a key. Headings are short, so their texts should be joined on later. A null chapter opens nothing.
    """
    rows = headings.withColumns(heading_columns(what=F.lit("section"), number=F.col(chapter)))
    found = headings_read(rows, keys, [order], parts=parts)
    return found.select(*headings.columns, (F.col("read") == "section").alias("opens"))


def folded(headings: DataFrame, keys: list[str], order: str = "position") -> DataFrame:
    """Headings that open a section, with their text and that of all headings after them which don't.

    headings: keys, order, ref, chapter, text; the result's text joins 'ref text' of what was folded in by blanks.
    """
    rows = scanned(section_headings(headings, keys, order), keys, [order], last={"_of": F.when(F.col("opens"), F.col(order))}).where("_of is not null")
    said = F.when(F.col("opens"), F.col("text")).otherwise(F.concat_ws(" ", "ref", "text"))
    made = rows.groupBy(*keys, F.col("_of").alias(order)).agg(
        F.max(F.when(F.col("opens"), F.col("ref"))).alias("ref"),
        F.max(F.when(F.col("opens"), F.col("chapter"))).alias("chapter"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), said.alias("said")))).alias("parts"),
    )
    return made.select(*keys, order, "ref", "chapter", F.array_join(F.transform("parts", lambda p: p["said"]), " ").alias("text"))


def speculative_chapters(lines: DataFrame, keys: list[str], order: str = "position", parts: int | None = None) -> DataFrame:
    """Add chapter and advanced to lines(keys, order, what, number, last): the chapter after each line of a scanned book.

    what: 'book' begins a book at chapter 1; 'chapter' names a chapter (number); 'verse' is a heading, of its own chapter
    where it has a number; 'title' may be a chapter's, and advances the chapter if a verse was seen since it last changed;
    other lines change nothing. A chapter beyond the book's last one (null: not known) is taken for that. Like
    section_headings, no task sees more than a part of a key.
    """
    kind = F.when(F.col("what") == "book", "begin").when(F.col("what").isin("chapter", "verse"), F.col("what")).otherwise("line")
    rows = lines.withColumns(heading_columns(what=kind, number=F.col("number"), title=F.col("what") == "title", last=F.col("last")))
    found = headings_read(rows, keys, [order], parts=parts)
    return found.select(*lines.columns, F.col("at_chapter").alias("chapter"), (F.col("read") == "title").alias("advanced"))
