"""Commentary in Markdown: headings open excerpts, and the lines under them are their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import notes
from lectern.functions.text import strip


def read_markdown(spark, path: str) -> DataFrame:
    """(path, text) of every Markdown file under a folder."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def excerpts(files: DataFrame, books: DataFrame) -> DataFrame:
    """(path, position, book, cs, vs, ce, ve, header, text) of files(path, text), with books(name, code) by spelling.

    '# Matthew' sets the book; '## 3:16-18' or '## 3:16-4:2' opens an excerpt of it, and '## Romans 3:16' sets the book
    as well, from verse 1 where it names none. Any other heading closes the excerpt. All is window work within a file.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("position", "line"))
    heading = F.regexp_extract("line", "^#{1,6}\\s+(.*)$", 1)
    lines = lines.withColumn("header", F.when(F.col("line").rlike("^#{1,6}\\s"), strip(heading)))
    place = "([0-9]+):([0-9]+)(?:[-–—](?:([0-9]+):)?([0-9]+))?"
    bare = lambda i: F.nullif(F.regexp_extract("header", f"^{place}(?:\\s.*)?$", i), F.lit(""))
    full = lambda i: F.nullif(F.regexp_extract("header", "^(.+?)\\.?\\s+([0-9]+)(?::([0-9]+)(?:[-–]([0-9]+))?)?(?:\\s.*)?$", i), F.lit(""))
    names = books.select(F.lower("name").alias("_name"), "code")
    lines = lines.withColumn("_name", F.lower(F.coalesce(full(1), F.col("header"))))
    lines = lines.join(names, "_name", "left").withColumn("is_full", F.col("code").isNotNull() & full(1).isNotNull())
    upto = Window.partitionBy("path").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("book", F.last("code", ignorenulls=True).over(upto))
    opens = F.col("is_full") | (bare(1).isNotNull() & F.col("book").isNotNull())
    number = lambda c: c.cast("int")
    opened = F.struct(
        F.col("position").alias("position"),
        F.col("book").alias("book"),
        number(F.when(F.col("is_full"), full(2)).otherwise(bare(1))).alias("cs"),
        number(F.when(F.col("is_full"), F.coalesce(full(3), F.lit("1"))).otherwise(bare(2))).alias("vs"),
        number(F.when(F.col("is_full"), full(2)).otherwise(F.coalesce(bare(3), bare(1)))).alias("ce"),
        number(F.when(F.col("is_full"), F.coalesce(full(4), full(3), F.lit("1"))).otherwise(F.coalesce(bare(4), bare(2)))).alias("ve"),
        F.col("header").alias("header"),
    )
    state = F.when(F.col("header").isNotNull(), F.struct(opens.alias("open"), opened.alias("at")))
    lines = lines.withColumn("state", F.last(state, ignorenulls=True).over(upto)).where("state.open")
    body = F.when(F.col("header").isNull(), F.struct("position", "line"))
    made = lines.groupBy("path", "state.at").agg(F.array_sort(F.collect_list(body)).alias("body"))
    text = strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n"))
    return made.select("path", "at.*", text.alias("text"))


def sections(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, position, document, ordinal, number, label, part, header, text) of confessions, files(path, text).

    '# Title' sets the document, by documents(name, code); '## 4 | IV | Of Justification | Chief Articles' opens a
    section of it. Any other heading closes the section, and one of the first level that is no document ends it.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("position", "line"))
    part = lambda i: F.regexp_extract("line", "^(#{1,6})\\s+(?=\\S)(.*)$", i)
    lines = lines.withColumn("level", F.length(part(1))).withColumn("header", F.when(F.col("level") > 0, part(2)))
    names = documents.select(F.lower("name").alias("_name"), "code").dropDuplicates(["_name"])
    lines = lines.withColumn("_name", F.when(F.col("level") == 1, F.lower(strip(F.col("header"))))).join(names, "_name", "left")
    upto = Window.partitionBy("path").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("document", F.last(F.when(F.col("level") == 1, F.struct("code")), ignorenulls=True).over(upto)["code"])
    cell = lambda i: strip(F.get(F.split("header", "\\|", -1), F.lit(i)))
    ordinal = F.when(cell(0).rlike("^\\+?[0-9]+(?:\\.0*)?\\z"), cell(0).cast("double").cast("int"))
    opens = (F.col("level") > 1) & F.col("document").isNotNull() & (ordinal >= 1) & (F.coalesce(cell(2), F.lit("")) != "")
    opened = F.struct(
        F.col("position").alias("position"), F.col("document").alias("document"), ordinal.alias("ordinal"),
        F.nullif(cell(1), F.lit("")).alias("number"), cell(2).alias("label"), F.nullif(cell(3), F.lit("")).alias("part"),
        F.col("header").alias("header"),
    )
    state = F.when(F.col("level") > 0, F.struct(F.coalesce(opens, F.lit(False)).alias("open"), opened.alias("at")))
    lines = lines.withColumn("state", F.last(state, ignorenulls=True).over(upto)).where("state.open")
    body = F.when(F.col("header").isNull(), F.struct("position", "line"))
    made = lines.groupBy("path", "state.at").agg(F.array_sort(F.collect_list(body)).alias("body"))
    return made.select("path", "at.*", strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n")).alias("text"))


def indexed_sections(found: DataFrame) -> DataFrame:
    """Sections that say something; what is only a heading goes."""
    return found.where("text <> ''")


def section_notes(found: DataFrame) -> DataFrame:
    """Sections of a commentary, as ranges of the one section that each is about."""
    return indexed_sections(found).withColumn("first", F.col("ordinal")).withColumn("last", F.col("ordinal"))


def written_parts(excerpts: DataFrame, books: DataFrame) -> DataFrame:
    """(source, place, cs, vs, ve, position, text): a row for each of excerpts(source, book, cs, vs, ve, position, text).

    books(code, name, position) gives names and, as place, order; excerpts of other books go. The text is Markdown that
    excerpts() reads, and the first of a book begins with its heading. position tells excerpts of one source apart.
    """
    start = F.concat_ws(":", F.col("cs").cast("string"), F.col("vs").cast("string"))
    heading = F.concat(F.lit("## "), F.when(F.col("ve") != F.col("vs"), F.concat(start, F.lit("-"), F.col("ve").cast("string"))).otherwise(start))
    rows = excerpts.join(books.select(F.col("code").alias("book"), "name", F.col("position").alias("place")), "book")
    rank = F.struct("cs", "vs", (-F.col("ve")).alias("wide"), "position")
    first = rows.groupBy("source", "book").agg(F.min(rank).alias("_first"))
    title = F.when(rank == F.col("_first"), F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"))).otherwise("")
    said = F.concat(title, heading, F.lit("\n"), strip(F.col("text")), F.lit("\n"))
    return rows.join(first, ["source", "book"]).select("source", "place", "cs", "vs", "ve", "position", said.alias("text"))


def write_markdown(parts: DataFrame, path: str) -> None:
    """Write written_parts(): a folder source=<source> for each source, whose files in order of name are its Markdown."""
    order = ["source", "place", "cs", "vs", F.desc("ve"), "position"]
    parts.repartitionByRange(*order).sortWithinPartitions(*order).select("source", "text").write.partitionBy("source").text(path)


def written(excerpts: DataFrame, books: DataFrame) -> DataFrame:
    """(source, text): written_parts() of each source in one row, so for sources that fit in one.

    An excerpt's start comes first, the wider range first among equals.
    """
    entry = F.struct("place", "cs", "vs", (-F.col("ve")).alias("wide"), "position", "text")
    made = written_parts(excerpts, books).groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return made.select("source", F.array_join(F.transform("entries", lambda e: e["text"]), "\n").alias("text"))


def standalone_notes(files: DataFrame, folder: str) -> DataFrame:
    """(path, title, type, tags) of the notes right in a folder, not in those below it, files(path, text)."""
    here = F.regexp_extract("path", "^(.*)/[^/]*\\z", 1) == folder.rstrip("/")
    name = F.regexp_extract("path", "([^/]*?)(?:\\.md)?\\z", 1)
    text = F.col("text")
    return files.where(here).select("path", notes.title(text, name).alias("title"), notes.note_type(text).alias("type"), notes.tags(text).alias("tags"))


def highlights(sidecars: DataFrame, kinds: str) -> DataFrame:
    """(key, highlight) of sidecars(key, json), each a JSON list of kinds (DDL of one); a malformed one has none."""
    return sidecars.select("key", F.explode(F.from_json("json", f"array<{kinds}>")).alias("highlight"))


def list_pdfs(spark, path: str, excluded: list[str] | None = None) -> DataFrame:
    """(path, size, mtime) of every PDF under a folder but those in dot folders and below excluded ones (paths below it)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
    below = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    root = path.rstrip("/")
    rows = files.select(below.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    rows = rows.where(F.lower("path").endswith(".pdf") & ~F.contains(F.substring("path", len(root) + 1, 1 << 30), F.lit("/.")))
    for name in excluded or []:
        rows = rows.where(~F.startswith(F.col("path"), F.lit(f"{root}/{name.strip('/')}/")))
    return rows
