"""Quotes: made, shown with tags and citations, listed, grouped and edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tag_name
from lectern.operators import catalog
from lectern.operators.ranges import parse_reference, reference
from lectern.operators.scans import scanned

ANNOTATIONS = "array<struct<id:string,text:string,createdAt:long>>"


def annotations(stored: Column) -> Column:
    """A quote's remarks from its column: JSON, or one remark as it is where that isn't JSON; none for JSON of another kind."""
    none = F.array().cast(ANNOTATIONS)
    is_json = F.try_parse_json(stored).isNotNull()
    plain = F.array(F.struct(F.lit(None).cast("string").alias("id"), stored.alias("text"), F.lit(None).cast("long").alias("createdAt")))
    blank = F.coalesce(stored, F.lit("")) == ""
    some = F.when(F.schema_of_variant(F.try_parse_json(stored)).startswith("ARRAY"), F.from_json(stored, ANNOTATIONS))
    return F.when(blank, none).when(is_json, F.coalesce(some, none)).otherwise(plain.cast(ANNOTATIONS))


def passage_quotes(rows: DataFrame) -> DataFrame:
    """New quotes of passages: ref of (book, chapter, verse, verse_end), whose end is left out where it is the start."""
    ref = reference(F.col("book"), F.col("chapter"), F.col("verse"), F.col("verse_end"))
    return rows.withColumn("ref", ref).drop("book", "chapter", "verse", "verse_end")


def section_quotes(rows: DataFrame) -> DataFrame:
    """New quotes of sections: ref of (document, ordinal)."""
    return rows.withColumn("ref", F.concat_ws(":", "document", F.col("ordinal").cast("string"))).drop("document", "ordinal")


def viewed(quotes: DataFrame, quote_tags: DataFrame, cited: list[DataFrame]) -> DataFrame:
    """Quotes with their tags, remarks, place and citation.

    quote_tags(quote_id, tag). cited: tables (quote_id, citation) by precedence; a quote's own citation comes before
    them all if it isn't blank, and '' stands where none has one.
    """
    out = quotes.join(catalog.values_by(quote_tags, "quote_id", "tag").withColumnRenamed("values", "tags"), "quote_id", "left")
    out = out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    given = [F.nullif(F.trim(F.coalesce("citation_override", F.lit(""))), F.lit(""))]
    for i, table in enumerate(cited):
        out = out.join(table.select("quote_id", F.col("citation").alias(f"_cited{i}")), "quote_id", "left")
        given.append(F.nullif(F.col(f"_cited{i}"), F.lit("")))
    out = out.withColumn("citation", F.coalesce(*given, F.lit(""))).withColumn("place", parse_reference(F.col("ref")))
    return out.withColumn("annotations", annotations(F.col("annotations"))).drop(*(f"_cited{i}" for i in range(len(cited))))


def document_text(text: Column, remarks: Column, tags: Column) -> Column:
    """What is searched of a quote: its text, its remarks and its tags with a # each, a line for each that isn't blank."""
    marked = F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), t)), " ")
    lines = F.concat(F.array(text), F.coalesce(remarks, F.array().cast("array<string>")), F.array(marked))
    return F.array_join(F.filter(lines, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), "\n")


def by_chapter(quotes: DataFrame) -> DataFrame:
    """quotes(ref, position, ...) of passages with chapter and first: where in the listing the chapter is first seen.

    In order of first and position they are the chapters' buckets; none is gathered. Refs without a chapter go.
    """
    rows = quotes.withColumn("chapter", F.nullif(F.regexp_extract("ref", "^\\S+ ([0-9]+)", 1), F.lit("")).cast("int")).where("chapter is not null")
    first = rows.groupBy("chapter").agg(F.min("position").alias("first"))
    return rows.join(first, "chapter")


def kept_override(override: Column, generated: Column) -> Column:
    """A user's citation, unless it is blank or what would be generated anyway."""
    return F.nullif(F.nullif(F.trim(override), F.lit("")), generated)


def of_book(quotes: DataFrame, book: str) -> DataFrame:
    """Quotes of a book of scripture, by its code in any case."""
    return quotes.where(F.startswith(F.upper("ref"), F.lit(f"{book.upper()} ")))


def of_chapter(quotes: DataFrame, book: str, chapter: int) -> DataFrame:
    return quotes.where(F.startswith(F.upper("ref"), F.lit(f"{book.upper()} {chapter}:")))


def of_document(quotes: DataFrame, document: str) -> DataFrame:
    return quotes.where(F.startswith(F.upper("ref"), F.lit(f"{document.upper()}:")))


def by_place() -> list[Column]:
    """Order of passages: chapter, verse, time."""
    place = parse_reference(F.col("ref"))
    return [place["chapter"].asc(), place["verse"].asc(), F.col("created").asc()]


def by_section() -> list[Column]:
    """Order of sections: ordinal, paragraph (0 without one), time."""
    ordinal = F.regexp_extract("ref", ":([0-9]+)\\z", 1)
    return [F.nullif(ordinal, F.lit("")).cast("int").asc(), F.coalesce("paragraph", F.lit(0)).asc(), F.col("created").asc()]


def groups(quotes: DataFrame) -> DataFrame:
    """(kind, name, n): quotes grouped by book, by book of scripture, by source of commentary and by document.

    quotes: book_id, source_id, ref. One pass over them: each quote has the one kind that its columns say.
    """
    passage = parse_reference(F.col("ref"))["book"]
    document = F.regexp_extract("ref", "^([A-Z-]+):[0-9]+\\z", 1)
    group = (
        F.when(F.col("book_id").isNotNull(), F.struct(F.lit("book").alias("kind"), F.col("book_id").cast("string").alias("name")))
        .when(F.col("source_id").isNotNull() & (document == ""), F.struct(F.lit("commentary").alias("kind"), F.col("source_id").cast("string").alias("name")))
        .when(document != "", F.struct(F.lit("document").alias("kind"), document.alias("name")))
        .when(passage.isNotNull(), F.struct(F.lit("scripture").alias("kind"), passage.alias("name")))
    )
    return quotes.select(group.alias("g")).where("g is not null").groupBy("g.kind", "g.name").agg(F.count("*").alias("n"))


def tags_set(quote_tags: DataFrame, edits: DataFrame) -> DataFrame:
    """quote_tags(quote_id, tag) with the tags of edits(quote_id, tags) in the place of a quote's old ones."""
    new = edits.select("quote_id", F.explode("tags").alias("tag")).select("quote_id", tag_name(F.col("tag")).alias("tag"))
    left = quote_tags.join(edits.select("quote_id"), "quote_id", "left_anti")
    return left.unionByName(new.where("tag is not null").distinct())


def quote_counts(books: DataFrame, quotes: DataFrame) -> DataFrame:
    """books with quote_count as it is, whatever was counted before."""
    counts = quotes.where("book_id is not null").groupBy("book_id").agg(F.count("*").alias("_n"))
    out = books.drop("quote_count").join(counts, "book_id", "left")
    return out.withColumn("quote_count", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")


def chapter_note(quotes: DataFrame, block: Column, keys: list[str]) -> DataFrame:
    """(keys, note): the blocks of each passage's quotes under '## Chapter n' headings in order of number.

    quotes: keys, chapter, created, quote_id. A note holds what one user marked in one book, so it fits in one row.
    """
    blocks = F.array_sort(F.collect_list(F.struct("created", "quote_id", block.alias("block"))))
    chapters = quotes.groupBy(*keys, "chapter").agg(blocks.alias("blocks"))
    text = F.concat(F.lit("## Chapter "), F.col("chapter").cast("string"), F.lit("\n\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("chapter", text.alias("text"))))
    return chapters.groupBy(*keys).agg(parts.alias("parts")).select(*keys, F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("note"))


def marked_verses(quotes: DataFrame) -> DataFrame:
    """(book, chapter, verse, color): the color of each verse that quotes(ref, color, created) mark; the latest wins."""
    rows = quotes.select(parse_reference(F.col("ref")).alias("p"), "color", "created").where("p.verse <= p.verse_end")
    rows = rows.select("p.book", "p.chapter", F.explode(F.sequence("p.verse", "p.verse_end")).alias("verse"), "color", "created")
    return rows.groupBy("book", "chapter", "verse").agg(F.max(F.struct("created", "color"))["color"].alias("color"))


#: The color of a quote that says none, and what a quote can be of.
AMBER = "amber"
KINDS = ("book", "scripture", "commentary", "confession", "confession commentary")


def made(new: DataFrame) -> DataFrame:
    """Rows of new quotes(quote_id, kind, text, color, created, book_id, page, source_id, translation, book, chapter, verse,
    verse_end, document, ordinal, section_number, section_label, paragraph), each with what its kind has, and its ref.

    A passage's end is left out where it is the start or 0. Only quotes of books have a page, only those of scripture a
    translation, and only those of confessions a section. Unknown kinds make nothing.
    """
    is_of = lambda *kinds: F.col("kind").isin(*kinds)
    only = lambda c, *kinds: F.when(is_of(*kinds), F.col(c)).alias(c)
    confession = KINDS[3:]
    passage = reference(F.col("book"), F.col("chapter"), F.col("verse"), F.nullif(F.col("verse_end"), F.lit(0)))
    section = F.concat_ws(":", "document", F.col("ordinal").cast("string"))
    ref = F.when(is_of("scripture", "commentary"), passage).when(is_of(*confession), section)
    return new.where(is_of(*KINDS)).select(
        "quote_id", "kind", "text", F.coalesce("color", F.lit(AMBER)).alias("color"), "created", only("book_id", "book"), only("page", "book"),
        only("source_id", "commentary", *confession), only("translation", "scripture"), ref.alias("ref"),
        only("section_number", *confession), only("section_label", *confession), only("paragraph", *confession),
    )


def listed(rows: DataFrame, keys: list[str], *order: Column, parts: int | None = None) -> DataFrame:
    """rows with n, their place from 1 among those of equal keys in an order without ties, however many a key has."""
    by = {f"_o{i}": c for i, c in enumerate(order)}
    found = scanned(rows.withColumns(by), keys, list(by), total={"n": F.lit(1)}, parts=parts)
    return found.withColumn("n", F.col("n").cast("int")).drop(*by)


def place_in_ref() -> list[Column]:
    """Chapter and verse of a ref, 0 where it has none."""
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract("ref", "\\s([0-9]+):([0-9]+)", i), F.lit("")).cast("int"), F.lit(0))
    return [number(1), number(2)]


def highlights(quotes: DataFrame, book: str, chapter: int) -> DataFrame:
    """(quote_id, verse, verse_end, color): what a chapter's quotes mark; refs that end otherwise mark nothing."""
    part = lambda i: F.nullif(F.regexp_extract("ref", ":([0-9]+)(?:-([0-9]+))?\\z", i), F.lit("")).cast("int")
    rows = of_chapter(quotes, book, chapter).select("quote_id", part(1).alias("verse"), F.coalesce(part(2), part(1)).alias("verse_end"), "color")
    return rows.where("verse IS NOT NULL")


def edited(quotes: DataFrame, edits: DataFrame) -> DataFrame:
    """quotes(quote_id, text, annotations, citation_override, ...) after edits(quote_id, position, what, value).

    what: 'text', 'annotations', 'citation' (a blank one goes back to what is generated) or 'delete', of which the last
    of each counts, before a quote's first deletion. Quotes that aren't there stay so.
    """
    first = edits.where("what = 'delete'").groupBy("quote_id").agg(F.min("position").alias("_gone"))
    rows = edits.join(first, "quote_id", "left").where(F.col("_gone").isNull() | (F.col("position") <= F.col("_gone")))
    named = {"text": "text", "annotations": "annotations", "citation": "citation_override"}
    last = [F.max_by(F.struct("value"), F.when(F.col("what") == w, F.col("position"))).alias(f"_{c}") for w, c in named.items()]
    last.append(F.max(F.col("what") == "delete").alias("_deleted"))
    out = quotes.join(rows.groupBy("quote_id").agg(*last), "quote_id", "left").where(~F.coalesce("_deleted", F.lit(False)))
    value = {"citation_override": F.nullif(F.trim(F.col("_citation_override.value")), F.lit(""))}
    new = {c: F.when(F.col(f"_{c}").isNotNull(), value.get(c, F.col(f"_{c}.value"))).otherwise(F.col(c)) for c in named.values()}
    return out.withColumns(new).select(*quotes.columns)
