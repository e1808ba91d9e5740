"""Scanned books: how a source sets its headers, learned from a sample of its pages, and its excerpts by that style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.headers import SHAPES, may_be_chapter_title, parse_header, scanned_chapter_header
from lectern.functions.references import Book, trailing_book
from lectern.functions.text import capitalised, strip
from lectern.operators.reader import heading_columns, headings_read
from lectern.operators.scans import in_ranges, joined_by, medians, scanned
from lectern.operators.upkeep import repaired
from lectern.operators.validation import evenly_sampled
from lectern.session import materialize

#: All shapes, in the order in which one of equals is taken, and those that don't need a chapter or a book before them.
ALL_SHAPES = ("book-chapter-verse", *SHAPES)
WITH_CHAPTER = ("chapter-verse", "chapter-verse-roman")
#: Pages of a sample at most.
PAGES = 40
#: Lines that a shape must have at least; the others must be more.
LEAST_LINES = 3
#: How far sizes, margins and shares of lines in several fonts may be apart and still count as equal.
SIZE_APART, MARGIN_APART, FONTS_APART = 0.75, 4.0, 0.3
#: How much larger than the text a chapter's title is.
TITLE_LARGER = 3.0
#: Pages on both sides that a running line is looked for on, how many must have it, and pages in a bucket of them.
AROUND, AGAIN, BUCKET = 8, 3, 512
#: Samples of headers in a profile, and characters of what follows them.
SAMPLES, SNIPPET = 10, 150


def profiling_pages(lines: DataFrame, source: str = "source", parts: int | None = None) -> DataFrame:
    """(source, page): all pages of a source of at most PAGES, else so many, evenly spaced behind its first tenth."""
    return evenly_sampled(lines.select(source, "page").distinct(), source, "page", PAGES, parts)


def _matched(lines: DataFrame, canon: list[Book]) -> DataFrame:
    """Add shapes: the numbers of all shapes that a line could be a header in, in some book and chapter."""
    some = lambda i, s: F.when(parse_header(F.col("text"), s, F.lit("X"), F.lit(1), canon).isNotNull(), F.lit(i))
    return lines.withColumn("shapes", F.array_compact(F.array(*(some(i, s) for i, s in enumerate(ALL_SHAPES)))))


def profiles(lines: DataFrame, canon: list[Book], source: str = "source", parts: int | None = None) -> DataFrame:
    """(source, shape, lines, headers, header_size, body_size, header_x, body_x, header_fonts, body_fonts) by a sample.

    lines: source, page, line, text, size, x, multi_font. The shape is that of most lines among those with at least
    LEAST_LINES and less than half of all; if there is none it is the first shape, without headers. Sizes and margins
    are exact medians, of no lines 0; fonts are the share of lines in several fonts. All is counted: shapes by source,
    medians by refined histograms, so a source of any size is in many tasks.
    """
    sample = lines.join(profiling_pages(lines, source, parts), [source, "page"], "left_semi").select(source, "text", "size", "x", "multi_font")
    return _profiled(sample, canon, source)[0]


def _profiled(sample: DataFrame, canon: list[Book], source: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(_matched(sample, canon))
    many = rows.groupBy(source).agg(F.count("*").alias("lines"))
    of = rows.select(source, F.explode("shapes").alias("nth")).groupBy(source, "nth").agg(F.count("*").alias("headers"))
    good = joined_by(of, many, [source]).where((F.col("headers") >= LEAST_LINES) & (2 * F.col("headers") < F.col("lines")))
    best = good.groupBy(source).agg(F.max(F.struct("headers", (-F.col("nth")).alias("back"))).alias("best"))
    best = best.select(source, F.col("best.headers").alias("headers"), (-F.col("best.back")).alias("nth"))
    elected = joined_by(many, best, [source])
    sided = joined_by(rows, elected.select(source, "nth"), [source])
    sided = sided.withColumn("is_header", F.coalesce(F.array_contains("shapes", F.col("nth")), F.lit(False)))
    fonts = sided.groupBy(source).agg(*(F.avg(F.when(F.col("is_header") == b, F.col("multi_font").cast("double"))).alias(f"{n}_fonts") for n, b in (("header", True), ("body", False))))
    values = F.inline(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("value")) for c in ("size", "x"))))
    middle = medians(sided.select(source, "is_header", values), [source, "is_header", "axis"], F.col("value"))
    side = lambda b, c: F.max(F.when((F.col("is_header") == b) & (F.col("axis") == c), F.col("median")))
    sides = middle.groupBy(source).agg(*(side(b, c).alias(f"{n}_{c}") for n, b in (("header", True), ("body", False)) for c in ("size", "x")))
    out = joined_by(joined_by(elected, fonts, [source]), sides, [source])
    shape = F.get(F.array(*map(F.lit, ALL_SHAPES)), F.coalesce("nth", F.lit(0)))
    numbers = ("header_size", "body_size", "header_x", "body_x", "header_fonts", "body_fonts")
    none = lambda c, kind="double": F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return out.select(source, shape.alias("shape"), "lines", none("headers", "long"), *map(none, numbers)), sided


def profile_samples(lines: DataFrame, found: DataFrame, canon: list[Book], source: str = "source", parts: int | None = None) -> DataFrame:
    """(source, page, line, header, after): the first SAMPLES headers of a source's sample, with two lines behind each.

    found: profiles(). Lines behind are of the same page, parted by a blank, SNIPPET characters at most.
    """
    sample = lines.join(profiling_pages(lines, source, parts), [source, "page"], "left_semi")
    rows = joined_by(_matched(sample, canon), found.select(source, "shape", "headers"), [source])
    page = Window.partitionBy(source, "page").orderBy("line")
    rows = rows.withColumn("after", F.substring(F.concat_ws(" ", F.lead("text", 1).over(page), F.lead("text", 2).over(page)), 1, SNIPPET))
    is_one = F.array_contains("shapes", (F.array_position(F.array(*map(F.lit, ALL_SHAPES)), F.col("shape")) - 1).cast("int"))
    first = Window.partitionBy(source).orderBy("page", "line")
    rows = rows.where(is_one & (F.col("headers") > 0)).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLES)
    return rows.select(source, "page", "line", F.col("text").alias("header"), "after")


def in_style(size: Column, x: Column, multi_font: Column) -> Column:
    """Whether a line is set like its source's headers, on an axis that tells these from the text."""
    apart = lambda a, b, most: F.abs(F.col(a) - F.col(b)) > most
    by_size = apart("header_size", "body_size", SIZE_APART) & (F.abs(size - F.col("header_size")) <= SIZE_APART)
    by_margin = apart("header_x", "body_x", MARGIN_APART) & (F.abs(x - F.col("header_x")) <= MARGIN_APART)
    by_fonts = apart("header_fonts", "body_fonts", FONTS_APART) & (multi_font == (F.col("header_fonts") > 0.5))
    return by_size | by_margin | by_fonts


def edge_key(text: Column) -> Column:
    """A page's first or last line to compare by: each number is one mark."""
    return F.regexp_replace(strip(text), "[0-9]+", "#")


def page_edges(lines: DataFrame, source: str = "source") -> DataFrame:
    """(source, page, top, bottom, first, last): each page's first and last line, and where they are."""
    edge = lambda pick: pick(F.struct("line", "text"))
    rows = lines.groupBy(source, "page").agg(edge(F.min).alias("a"), edge(F.max).alias("b"))
    return rows.select(source, "page", F.col("a.text").alias("top"), F.col("b.text").alias("bottom"), F.col("a.line").alias("first"), F.col("b.line").alias("last"))


def running_lines(edges: DataFrame, source: str = "source") -> DataFrame:
    """(source, edge, key): top and bottom lines on at least half of the pages of a source of three or more.

    A page's last line counts only where it isn't like its first one.
    """
    top, bottom = edge_key(F.col("top")), edge_key(F.col("bottom"))
    both = F.array(F.struct(F.lit("top").alias("edge"), top.alias("key")), F.struct(F.lit("bottom").alias("edge"), F.when(bottom != top, bottom).alias("key")))
    seen = edges.select(source, F.inline(both)).where("key IS NOT NULL").groupBy(source, "edge", "key").agg(F.count("*").alias("n"))
    many = edges.groupBy(source).agg(F.count("*").alias("pages")).where("pages >= 3")
    return joined_by(seen, many, [source]).where("2 * n >= pages").select(source, "edge", "key")


def recurring_edges(edges: DataFrame, source: str = "source") -> DataFrame:
    """(source, page, edge): edges that at least AGAIN of the AROUND pages on each side have too.

    Pages are looked at in buckets of BUCKET with those around them, so that a line on every page of a long source
    isn't in one task.
    """
    both = F.array(F.struct(F.lit("top").alias("edge"), edge_key(F.col("top")).alias("key")), F.struct(F.lit("bottom").alias("edge"), edge_key(F.col("bottom")).alias("key")))
    rows = edges.select(source, "page", F.inline(both)).withColumn("own", F.expr(f"page div {BUCKET}"))
    rows = rows.withColumn("bucket", F.explode(F.expr(f"sequence((page - {AROUND}) div {BUCKET}, (page + {AROUND}) div {BUCKET})")))
    near = Window.partitionBy(source, "edge", "key", "bucket").orderBy("page").rangeBetween(-AROUND, AROUND)
    rows = rows.withColumn("n", F.count("*").over(near) - 1).where((F.col("bucket") == F.col("own")) & (F.col("n") >= AGAIN))
    return rows.select(source, "page", "edge")


def _edge_headings(edges: DataFrame, canon: list[Book], source: str) -> DataFrame:
    """Headings of recurring edges that name a place or end with a book's name, behind which a page's lines come."""
    recurring = recurring_edges(edges, source).groupBy(source, "page").agg(F.collect_set("edge").alias("which"))
    rows = edges.join(recurring, [source, "page"])
    said = {}
    for edge, book, number in (("top", "book", "number"), ("bottom", "book2", "number2")):
        text = capitalised(F.col(edge))
        ref = parse_header(text, "book-chapter-verse", F.lit(None).cast("string"), F.lit(None).cast("int"), canon)
        is_one = F.array_contains("which", edge)
        said[book] = F.when(is_one, F.coalesce(ref["book"], trailing_book(text, canon)))
        said[number] = F.when(is_one, ref["cs"])
    rows = rows.withColumns(heading_columns(what=F.lit("edges"), **said))
    return rows.where("_h_book IS NOT NULL OR _h_book2 IS NOT NULL").withColumn("line", F.lit(-1))


def excerpts(lines: DataFrame, found: DataFrame, canon: list[Book], books: DataFrame | None = None, source: str = "source", parts: int | None = None) -> DataFrame:
    """(source, position, page, header, book, cs, vs, ce, ve, text): a scanned source's excerpts in their order.

    lines: source, page (from 1, also of pages without lines), line, text, size, x, multi_font; found: profiles(); books:
    (source, first_book) that sources begin in. A line is a chapter's heading, a title that may be a chapter's, a header
    in the source's shape and style, or text of the last header. The place of headers that don't say it is the reader's,
    which recurring page edges move too; see operators.reader. Lines on half of the pages' edges are left out, and so is
    what comes before the first header. A verse that couldn't be read follows the excerpt before it. Only headings go
    through Python; all other steps are joins, counts and scans over ranges of (source, page, line), so that one source
    may have most of the lines. Null texts are left out; an empty table gives no rows.
    """
    lines = lines.where(F.col("text").isNotNull() & (strip(F.col("text")) != ""))
    edges = materialize(page_edges(lines, source))  # a row a page, read by several steps
    running = running_lines(edges, source)
    cut = []
    for edge, text, at in (("top", "top", "first"), ("bottom", "bottom", "last")):
        which = running.where(F.col("edge") == edge).select(source, F.col("key").alias("_key"))
        cut.append(edges.withColumn("_key", edge_key(F.col(text))).join(which, [source, "_key"], "left_semi").select(source, "page", F.col(at).alias("line")))
    rows = lines.join(cut[0].unionByName(cut[1]), [source, "page", "line"], "left_anti")
    rows = joined_by(rows, found, [source])

    number, again = scanned_chapter_header(F.col("text"))
    header, kind = F.lit(None), F.lit(None).cast("string")
    for shape in ALL_SHAPES:
        parsed = parse_header(F.col("text"), shape, F.lit("X"), F.lit(1), canon)
        is_it = F.col("shape") == shape
        header = F.when(is_it, parsed).otherwise(header)
        kind = F.when(is_it, F.lit("whole" if shape == ALL_SHAPES[0] else "chaptered" if shape in WITH_CHAPTER else "bare")).otherwise(kind)
    rows = rows.withColumn("_header", header).withColumn("_number", number).withColumn("_again", again)
    is_header = F.col("_number").isNull() & F.col("_header").isNotNull() & in_style(F.col("size"), F.col("x"), F.col("multi_font"))
    title = F.col("_number").isNull() & (F.col("size") > F.col("body_size") + TITLE_LARGER) & may_be_chapter_title(F.col("text"))
    rows = rows.withColumn("_kind", F.when(is_header, kind))
    named = F.when(F.col("_number").isNotNull(), F.col("_number")).when(F.col("_kind").isNotNull(), F.col("_header.ce"))
    said = {
        "what": F.when(F.col("_number").isNotNull(), "chapter").otherwise("line"),
        "book": F.when(F.col("_kind") == "whole", F.col("_header.book")),
        "number": named,
        "again": F.col("_again"),
        "header": F.col("_kind"),
        "title": title,
    }
    rows = rows.withColumns(heading_columns(**said))
    needed = [source, "page", "line", "text", "_header", *(c for c in rows.columns if c.startswith("_h_"))]
    pages = _edge_headings(edges, canon, source)
    empty = {"text": F.lit(None).cast("string"), "_header": F.lit(None).cast(rows.schema["_header"].dataType)}
    rows = materialize(rows.select(*needed)).unionByName(pages.withColumns(empty).select(*needed))
    begun = F.lit(None).cast("string")
    rows = joined_by(rows, books.select(source, "first_book"), [source]) if books is not None else rows.withColumn("first_book", begun)
    rows = in_ranges(rows, [source], ["page", "line"], parts)

    heading = (F.col("_h_what") != "line") | F.col("_h_header").isNotNull() | F.coalesce("_h_title", F.lit(False))
    shown = [source, "page", "line", "text", "_header"]
    read = headings_read(rows.where(heading), [source], ["page", "line"], [b.code for b in canon], {b.code: b.chapters for b in canon})
    read = read.select(*shown, "read", "at_book", "at_chapter")
    plain = rows.where(~heading).select(*shown, F.lit("").alias("read"), F.lit(None).cast("string").alias("at_book"), F.lit(None).cast("int").alias("at_chapter"))
    told = read.unionByName(plain).where(F.col("read").isin("", "header"))
    told = scanned(told, [source], ["page", "line"], total={"position": F.when(F.col("read") == "header", 1).otherwise(0)}, parts=parts).where("position > 0")
    told = materialize(told.select(*shown, "read", "at_book", "at_chapter", "position"))

    bare = F.col("_header.contextual")
    heads = told.where("read = 'header'").select(
        source, "position", "page", F.col("text").alias("header"), F.col("at_book").alias("book"),
        F.when(bare, F.col("at_chapter")).otherwise(F.col("_header.cs")).alias("cs"), F.col("_header.vs").alias("vs"),
        F.when(bare, F.col("at_chapter")).otherwise(F.col("_header.ce")).alias("ce"), F.col("_header.ve").alias("ve"),
        F.col("_header.glitched").alias("glitched"),
    )
    said = F.array_sort(F.collect_list(F.struct("page", "line", "text")))  # an excerpt's text is one value
    texts = told.where("read = ''").groupBy(source, "position").agg(F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"))
    heads = repaired(heads, [source], "position", parts)
    return joined_by(heads, texts, [source, "position"]).withColumn("text", F.coalesce("text", F.lit(""))).drop("glitched")
