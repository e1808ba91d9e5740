"""Upkeep of shelves, sources, files and notes, and the small listings that a library's screens ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import safe_name
from lectern.operators.scans import in_ranges, scanned

#: The letters that names are compared without the case of.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A text with A-Z in lower case and all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def listed(name: str = "name") -> list[Column]:
    """Order of shelves, tags and sources: as the user put them, then by name whatever the case of A-Z."""
    return [F.col("sort_order").asc(), ascii_lower(F.col(name)).asc(), F.col(name).asc()]


def by_language(name: str) -> list[Column]:
    """Order in which a reader looks for titles: a before A before á before b."""
    return [F.collate(F.col(name), "UNICODE").asc()]


def renamed(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """rows(id, name, ...) after renames(id, name). Blank names and those that another row bears do nothing.

    Names are as they were before any of the renames; of two rows that ask for one name the smaller id gets it.
    """
    asked = renames.select("id", F.trim("name").alias("_name")).where("_name <> ''")
    asked = asked.groupBy("id").agg(F.min("_name").alias("_name")).join(rows.select("id"), "id", "left_semi")
    asked = asked.groupBy("_name").agg(F.min("id").alias("id"))
    taken = rows.select(F.col("name").alias("_name"), F.col("id").alias("_holder"))
    free = asked.join(taken, "_name", "left").where(F.col("_holder").isNull() | (F.col("_holder") == F.col("id"))).select("id", "_name")
    return rows.join(free, "id", "left").withColumn("name", F.coalesce("_name", "name")).select(*rows.columns)


def relinked(books: DataFrame, chosen: DataFrame, folder: str = "pdf-cache") -> DataFrame:
    """books(id, pdf_exists, local_path, source_path, ...) after files were chosen for some, chosen(id, path).

    The copy's path is set; where the drive has no file, the chosen one is remembered unless there is a source.
    """
    new = chosen.groupBy("id").agg(F.min("path").alias("_path"))
    rows = books.join(new, "id", "left")
    some, lost = F.col("_path").isNotNull(), ~F.coalesce(F.col("pdf_exists"), F.lit(False))
    copy = F.concat(F.lit(f"{folder}/"), F.col("id").cast("string"), F.lit(".pdf"))
    changed = {
        "local_path": F.when(some, copy).otherwise(F.col("local_path")),
        "source_path": F.when(some & lost, F.coalesce("source_path", "_path")).otherwise(F.col("source_path")),
    }
    return rows.withColumns(changed).select(*books.columns)


def _plain(path: Column) -> Column:
    """The steps of an absolute path without '.' and '..'."""
    none = F.array().cast("array<string>")
    walked = lambda at, step: (
        F.when(step.isin("", "."), at)
        .when(step == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
        .otherwise(F.concat(at, F.array(step)))
    )
    return F.aggregate(F.split(path, "/", -1), none, walked)


def within_vault(vault: str, path: Column) -> Column:
    """The absolute place of a path given relative to a vault; null if it isn't below it."""
    root = _plain(F.lit(vault))
    steps = _plain(F.concat(F.lit(vault + "/"), path))
    below = F.slice(steps, F.size(root) + 1, F.size(steps) + 1)
    good = (F.slice(steps, F.lit(1), F.greatest(F.size(root), F.lit(1))) == root) & (F.size(below) > 0) & ~F.startswith(F.get(below, F.lit(0)), F.lit(".."))
    return F.when(good, F.concat(F.lit("/"), F.array_join(steps, "/")))


def new_notes(asked: DataFrame, there: DataFrame, kinds: list[str], folder: str = "notes/standalone") -> DataFrame:
    """(path, title, type, text) of notes to create, asked(title, type, suffix), beside there(path).

    A path that is taken gets the suffix; an unknown type is the first of kinds; no title is 'Untitled'.
    """
    title = F.trim(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
    rows = asked.select(title.alias("title"), F.when(F.col("type").isin(*kinds), F.col("type")).otherwise(kinds[0]).alias("type"), "suffix")
    rows = rows.withColumn("_base", F.concat(F.lit(f"{folder}/"), safe_name(F.col("title"))))
    taken = there.select(F.col("path").alias("_taken")).distinct()
    rows = rows.join(taken, F.concat("_base", F.lit(".md")) == F.col("_taken"), "left")
    path = F.concat("_base", F.when(F.col("_taken").isNotNull(), F.concat(F.lit("-"), "suffix")).otherwise(""), F.lit(".md"))
    text = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntype: "), "type", F.lit("\n---\n\n# "), "title", F.lit("\n\n"))
    return rows.select(path.alias("path"), "title", "type", text.alias("text"))


def cover_url(path: Column, content: Column) -> Column:
    """A cover as a data URL; null without a file."""
    kind = F.when(F.lower(path).endswith(".png"), "image/png").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def picked(rows: DataFrame, members: DataFrame, key: str, name: Column, typed: str, inside: bool) -> DataFrame:
    """Rows that are members (or aren't) and whose name holds what was typed, in any case."""
    held = rows if not typed.strip() else rows.where(F.contains(F.lower(name), F.lit(typed.strip().lower())))
    return held.join(members.select(key), key, "left_semi" if inside else "left_anti")


def flagged(excerpts: DataFrame, source: int | str | None = None) -> DataFrame:
    """Flagged excerpts, of one source or of all."""
    rows = excerpts.where("flagged")
    return rows if source is None else rows.where(F.col("source") == source)


def assembled(asked: DataFrame, books: DataFrame, editions: DataFrame) -> DataFrame:
    """asked(edition, book, chapter) with edition_name and reference; the first edition where the asked one isn't known.

    books(book, name, chapters) and editions(position, edition, edition_name) are short lists. Unknown books and
    chapters beyond a book go.
    """
    rows = asked.join(books, "book").where(F.col("chapter").between(1, F.col("chapters")))
    first = editions.agg(F.min_by("edition", "position").alias("_first"))  # one row
    rows = rows.join(editions.select("edition", F.lit(True).alias("_known")), "edition", "left").crossJoin(F.broadcast(first))
    rows = rows.withColumn("edition", F.when(F.col("_known"), F.col("edition")).otherwise(F.col("_first"))).join(editions, "edition")
    return rows.select("edition", "edition_name", "book", "chapter", F.concat_ws(" ", "name", F.col("chapter").cast("string")).alias("reference"))


def author_of(rows: DataFrame, unknown: str = "Unknown author", passage: str = "Scripture") -> DataFrame:
    """Add bucket to quotes(book_id, book_author, source, source_author): the author, or what stands for none."""
    named = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(unknown))
    return rows.withColumn("bucket", F.when(F.col("book_id").isNotNull(), named("book_author")).when(F.col("source").isNotNull(), named("source_author")).otherwise(passage))


def yields(excerpts: DataFrame) -> DataFrame:
    """(source, excerpts, books, mean_length, contaminated) of excerpts(source, book, text).

    contaminated: over three books, of which the largest has more excerpts than all others together and the upper
    median of the others is at most 3.
    """
    by_book = excerpts.groupBy("source", "book").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    made = by_book.groupBy("source").agg(
        F.sum("n").alias("excerpts"), F.count("*").alias("books"), F.sum("chars").alias("chars"),
        F.sort_array(F.collect_list("n"), asc=False).alias("sizes"),  # one number for each book of a source
    )
    rest = F.slice("sizes", F.lit(2), F.size("sizes"))
    middle = F.get(rest, F.floor(F.size(rest) / 2).cast("int"))
    odd = (F.col("books") > 3) & (middle <= 3) & (2 * F.get("sizes", F.lit(0)) > F.col("excerpts"))
    return made.select("source", "excerpts", "books", (F.col("chars") / F.col("excerpts")).alias("mean_length"), F.coalesce(odd, F.lit(False)).alias("contaminated"))


def chapter_yields(excerpts: DataFrame) -> DataFrame:
    """(source, book, excerpts, chapters) of excerpts(source, book, cs): how many of a book there are, and in which chapters."""
    return excerpts.groupBy("source", "book").agg(F.count("*").alias("excerpts"), F.array_sort(F.collect_set("cs")).alias("chapters"))


def doubtful_yields(excerpts: DataFrame, pages: DataFrame, per_page: float = 0.15, length: int = 40) -> DataFrame:
    """(source, pages, excerpts, yield, few, brief) for each of pages(source, pages), excerpts(source, text).

    few: less than per_page excerpts a page, also none; brief: excerpts are shorter than length on average.
    """
    made = excerpts.groupBy("source").agg(F.count("*").alias("excerpts"), F.avg(F.length("text")).alias("_mean"))
    rows = pages.join(made, "source", "left").withColumn("excerpts", F.coalesce("excerpts", F.lit(0)))
    rows = rows.withColumn("yield", F.col("excerpts") / F.greatest("pages", F.lit(1)))
    return rows.select("source", "pages", "excerpts", "yield", (F.col("yield") < per_page).alias("few"), F.coalesce(F.col("_mean") < length, F.lit(False)).alias("brief"))


def outcomes(rows: DataFrame, first: int = 50) -> DataFrame:
    """(outcome, n, titles) of rows(outcome, title): how many there are, and the first titles in order.

    Titles are ranked and cut in each task before they meet, so an outcome of most rows sends only a few.
    """
    best = Window.partitionBy("outcome").orderBy("title")
    few = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= first)
    titles = few.groupBy("outcome").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n")).join(titles, "outcome")


def repaired(excerpts: DataFrame, keys: list[str], order: str = "position", parts: int | None = None) -> DataFrame:
    """excerpts(keys, order, book, cs, vs, ce, ve, glitched) with verses that couldn't be read, from those before them.

    A verse that couldn't be read follows the end of the excerpt before it, if that ends in its chapter; a range that
    began and ended there ends there still. What follows a readable end is that end and the number of rows since.
    """
    before = {"_book": F.col("book"), "_chapter": F.col("ce")}
    rows = scanned(in_ranges(excerpts, keys, [order], parts), keys, [order], previous=before)
    follows = F.col("glitched") & F.coalesce((F.col("_book") == F.col("book")) & (F.col("_chapter") == F.col("cs")), F.lit(False))
    rows = rows.withColumn("_follows", follows).withColumn("_chained", F.col("_follows") & (F.col("ve") == F.col("vs")))
    read = F.when(~F.col("_chained"), F.struct("ve"))
    rows = scanned(rows, keys, [order], last={"_end": read}, total={"_n": F.lit(1)})
    rows = scanned(rows, keys, [order], last={"_at": F.when(~F.col("_chained"), F.col("_n"))})
    rows = rows.withColumn("_end", (F.col("_end.ve") + F.col("_n") - F.col("_at")).cast(excerpts.schema["ve"].dataType))
    rows = scanned(rows, keys, [order], previous={"_ended": F.col("_end")})
    start = F.when(F.col("_follows"), F.col("_ended") + 1).otherwise(F.col("vs")).cast(excerpts.schema["vs"].dataType)
    return rows.withColumns({"vs": start, "ve": F.when(F.col("_chained"), F.col("_end")).otherwise(F.col("ve"))}).select(*excerpts.columns)
