"""Reconciling file listings with a catalogue, and links between notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import parse_file_name, title_of_path
from lectern.functions.text import wiki_targets
from lectern.operators.catalog import patched
from lectern.operators.prefixes import nested


def new_files(local: DataFrame, known: DataFrame) -> DataFrame:
    """Local files whose name isn't known and whose size isn't either; files of unknown size are left out."""
    left = local.where("size is not null").join(known.select("name").distinct(), "name", "left_anti")
    return left.join(known.select("size").distinct(), "size", "left_anti")


def incomplete_scan(found: Column, catalogued: Column) -> Column:
    """A scan that can't be trusted: nothing found of something, or under four fifths of more than twenty."""
    return ((found == 0) & (catalogued > 0)) | ((catalogued > 20) & (found < 0.8 * catalogued))


def to_index(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose modification time differs from the cached one, or that were never indexed."""
    seen = cache.select("path", F.col("mtime").alias("_mtime"), F.col("status").alias("_status"))
    out = files.join(seen, "path", "left")
    changed = ~F.col("mtime").eqNullSafe(F.col("_mtime")) | ~F.col("_status").eqNullSafe(F.lit("indexed"))
    return out.where(changed).drop("_mtime", "_status")


def mirror_actions(here: DataFrame, there: DataFrame, slack: float = 1.0) -> DataFrame:
    """(path, action): which way each file is copied if one side is newer by more than the slack; none is deleted."""
    a, b = here.select("path", F.col("mtime").alias("a")), there.select("path", F.col("mtime").alias("b"))
    action = (
        F.when(F.col("b").isNull() | (F.col("a") > F.col("b") + slack), "push")
        .when(F.col("a").isNull() | (F.col("b") > F.col("a") + slack), "pull")
        .otherwise("none")
    )
    return a.join(b, "path", "full").select("path", action.alias("action"))


def note_links(notes: DataFrame) -> DataFrame:
    """(note, target): the wiki links of notes(note, text)."""
    return notes.select("note", F.explode(wiki_targets(F.col("text"))).alias("target")).where("target <> ''")


def backlinks(links: DataFrame, targets: DataFrame) -> DataFrame:
    """(title, note): the notes that link to each of targets(title), ignoring case; once each."""
    t = targets.select("title", F.lower("title").alias("_key"))
    return links.withColumn("_key", F.lower("target")).join(t, "_key").select("title", "note").distinct()


def broken_links(links: DataFrame, titles: DataFrame) -> DataFrame:
    """(note, target): links that lead to no title, once for each note and spelling in lower case, the first spelling."""
    left = links.withColumn("key", F.lower("target")).join(titles.select(F.lower("title").alias("key")).distinct(), "key", "left_anti")
    return left.groupBy("note", "key").agg(F.min("target").alias("target")).select("note", "target")


def matched_names(names: DataFrame, primary: DataFrame, least: int = 24, parts: int | None = None) -> DataFrame:
    """(id, file): for each of names(id, key) the file of primary(file, key, position) of the same key, else of the longest
    key that begins the other or that it begins, both of at least so many characters; the first of equal ones.

    What matches exactly goes by an equi join; the rest is found along the order of all keys, so that any number of them
    may begin alike. positions of primary are distinct.
    """
    firsts = primary.groupBy("key").agg(F.min_by("file", "position").alias("file"), F.min("position").alias("position"))  # however many have a key
    same = names.join(firsts, "key").groupBy("id").agg(F.min_by("file", "position").alias("file"))
    left = names.join(same, "id", "left_anti").where(F.length("key") >= least)
    ranks = primary.where(F.length("key") >= least).groupBy("key").agg(F.min("position").alias("own"))
    wanted = left.select("key").distinct().withColumn("wanted", F.lit(True))
    keys = ranks.join(wanted, "key", "full").select("key", "own", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    near = nested(keys, parts).select("key", F.coalesce("best", "above").alias("position")).where("position IS NOT NULL")
    found = left.join(near, "key").select("id", "position").join(primary.select("position", "file"), "position")
    return same.unionByName(found.select("id", "file"))


def adopted_by_size(missing: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file): for each of missing(id, size) the first file(file, size, position) of the same size."""
    return missing.join(files.groupBy("size").agg(F.min_by("file", "position").alias("file")), "size").select("id", "file")


def prunable(drive: Column, local: Column, primary: Column) -> Column:
    """A catalogued book goes only if it is in none of the three places."""
    return ~(drive | local | primary)


def enriched(books: DataFrame) -> DataFrame:
    """books(pdf_path, title, author, series, series_number, meta_fetched, ...) with what their file names say.

    Only a name that has an author changes title and author; a series that the name doesn't tell stays.
    """
    told = parse_file_name(title_of_path(F.col("pdf_path")))
    rows = books.withColumn("_told", F.when(F.col("meta_fetched"), None).otherwise(told))
    found = F.col("_told.author").isNotNull()
    new = {
        "title": F.when(found, F.col("_told.title")).otherwise(F.col("title")),
        "author": F.when(found, F.col("_told.author")).otherwise(F.col("author")),
        "series": F.when(found, F.coalesce("_told.series", "series")).otherwise(F.col("series")),
        "series_number": F.when(found, F.coalesce("_told.series_number", "series_number")).otherwise(F.col("series_number")),
        "meta_fetched": F.lit(True),
    }
    return rows.withColumns(new).select(*books.columns)


def imported(books: DataFrame, files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """books and the files(path) that aren't there yet, by path or by the id in their sidecar.

    sidecars(path, book_id, title, author, series, series_number) go before what the file's name says; a file without
    one gets its path's hash as id. A path or id that comes twice is taken once.
    """
    side = sidecars.select("path", *(F.col(c).alias(f"_{c}") for c in ("book_id", "title", "author", "series", "series_number")))
    rows = files.select("path").distinct().join(books.select(F.col("pdf_path").alias("path")), "path", "left_anti").join(side, "path", "left")
    told = parse_file_name(title_of_path(F.col("path")))
    rows = rows.select(
        F.coalesce("_book_id", F.sha2("path", 256)).alias("book_id"),
        F.col("path").alias("pdf_path"),
        *(F.coalesce(f"_{c}", told[c]).alias(c) for c in ("title", "author", "series", "series_number")),
    )
    first = rows.groupBy("book_id").agg(F.min(F.struct("pdf_path", "title", "author", "series", "series_number")).alias("r")).select("book_id", "r.*")
    return books.unionByName(first.join(books, "book_id", "left_anti"), allowMissingColumns=True)


def backfilled(books: DataFrame) -> DataFrame:
    """books(local_path, local_exists, adopted, pdf_path, pdf_exists, ...) with an outcome and the local path after it.

    'alreadyLocal' with the local copy or an adopted file, 'connected' where the file must be copied, else 'missing'.
    """
    here = F.col("local_path").isNotNull() & F.col("local_exists")
    outcome = F.when(here | F.col("adopted").isNotNull(), "alreadyLocal").when(F.col("pdf_path").isNotNull() & F.col("pdf_exists"), "connected").otherwise("missing")
    after = F.when(here, F.col("local_path")).otherwise(F.coalesce("adopted", "local_path"))
    return books.withColumns({"outcome": outcome, "local_path": after})


def file_source(local: Column, primary: Column, drive: Column) -> Column:
    """Where a book is read from: its local copy, the primary folder, the drive, or nowhere."""
    return F.when(local, "local").when(primary, "primary").when(drive, "drive").otherwise("missing")


def sidecar(fields: dict[str, Column]) -> Column:
    """A book's metadata as one JSON text, in the given order; nulls are written out."""
    return F.to_json(F.struct(F.lit(1).alias("version"), *(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def with_sidecar(books: DataFrame, sidecars: DataFrame, kinds: str) -> DataFrame:
    """books with each value that their sidecar has: sidecars(book_id, json), kinds its DDL. A malformed one says nothing."""
    side = sidecars.select("book_id", F.from_json("json", kinds).alias("_s")).select("book_id", "_s.*")
    return patched(books, side.drop(*(c for c in side.columns if c not in books.columns)), "book_id")


def resolved_links(links: DataFrame, books: DataFrame, notes: DataFrame) -> DataFrame:
    """links(note, target) with kind and id: of books(id, title) first, then notes(id, title), ignoring case; null if none.

    Of equal titles the smallest id counts.
    """
    named = books.select(F.lit("book").alias("kind"), F.col("id").cast("string").alias("id"), "title")
    named = named.unionByName(notes.select(F.lit("note").alias("kind"), F.col("id").cast("string").alias("id"), "title"))
    first = named.groupBy(F.lower("title").alias("_key")).agg(F.min(F.struct("kind", "id")).alias("_to"))  # book < note
    return links.join(first, F.lower("target") == F.col("_key"), "left").select(*links.columns, "_to.kind", "_to.id")


def renamed_notes(quotes: DataFrame, titles: DataFrame) -> DataFrame:
    """quotes(book_id, note_path, ...) with the paths of notes whose book was renamed: titles(book_id, old, new)."""
    path = lambda c: F.concat(F.lit("notes/"), c, F.lit("/"), c, F.lit(".md"))
    t = titles.where("old <> new").select("book_id", path(F.col("old")).alias("_old"), path(F.col("new")).alias("_new"))
    out = quotes.join(t, "book_id", "left")
    return out.withColumn("note_path", F.when(F.col("note_path") == F.col("_old"), F.col("_new")).otherwise(F.col("note_path"))).select(*quotes.columns)


def valid_tabs(tabs: DataFrame, books: DataFrame, notes: DataFrame) -> DataFrame:
    """tabs(kind, id, ...) without those of books(id) and notes(id) that aren't there; other kinds stay."""
    known = books.select(F.lit("book").alias("kind"), "id").unionByName(notes.select(F.lit("note").alias("kind"), "id"))
    free = ~F.col("kind").isin("book", "note")
    return tabs.where(free).unionByName(tabs.where(~free).join(known, ["kind", "id"], "left_semi").select(*tabs.columns))


def synchronised(books: DataFrame, vault: DataFrame, local: DataFrame, primary: DataFrame) -> DataFrame:
    """books(book_id, pdf_path, name, size, ...) as three listings(path, name, size) leave it.

    Files of the vault that aren't catalogued come in, then local ones that no file of the vault is like by name or size;
    a book goes only if none of the three has it, and none goes after a scan that looks incomplete. New rows have their
    path's hash as id. Every step is a join on path, name or size.
    """
    fresh = vault.join(books.select(F.col("pdf_path").alias("path")), "path", "left_anti")
    more = new_files(local, vault).join(books.select("name"), "name", "left_anti")
    added = fresh.unionByName(more).dropDuplicates(["path"])
    added = added.select(F.sha2("path", 256).alias("book_id"), F.col("path").alias("pdf_path"), "name", "size")
    mark = lambda df, on, as_: df.select(on).distinct().withColumn(as_, F.lit(True))
    rows = books.join(mark(vault.withColumnRenamed("path", "pdf_path"), "pdf_path", "_vault"), "pdf_path", "left")
    rows = rows.join(mark(local, "name", "_local"), "name", "left").join(mark(primary, "name", "_primary"), "name", "left")
    counted = rows.agg(F.count("_vault").alias("_found"), F.count("*").alias("_known"))  # one row
    there = F.coalesce(F.col("_vault"), F.col("_local"), F.col("_primary"), F.lit(False))
    kept = rows.crossJoin(F.broadcast(counted)).where(there | incomplete_scan(F.col("_found"), F.col("_known")))
    return kept.select(*books.columns).unionByName(added, allowMissingColumns=True)
