"""Checks on ingested excerpts: sequence, bounds, size, coverage, corrections and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.scans import in_ranges, joined_by, medians, scanned

SHORT, LONG, DOUBT = 20, 10, 0.6


def sequence_reasons(rows: DataFrame, source: str, order: str, parts: int | None = None) -> DataFrame:
    """Add out_of_sequence: the place is before that of the row before it in the source, if both are of one book."""
    key = F.col("chapter") * 1000 + F.col("verse")
    rows = scanned(rows, [source], [order], previous={"_book": F.col("book"), "_key": key}, parts=parts)
    late = (F.col("_book") == F.col("book")) & (key < F.col("_key"))
    return rows.withColumn("out_of_sequence", F.coalesce(late, F.lit(False))).drop("_book", "_key")


def validated(rows: DataFrame, verses: DataFrame, source: str, order: str, parts: int | None = None) -> DataFrame:
    """Add out_of_sequence, out_of_bounds, odd_size, flagged and confidence to rows with book, chapter, verse, words.

    verses(book, chapter, last) are the known chapters; unknown ones aren't flagged. An odd size (under SHORT words or
    over LONG times the source's median) lowers confidence and never flags. A source of any size is scanned in parts,
    and its median is counted, not gathered.
    """
    middle = medians(rows, [source], F.col("words"), "middle")
    rows = sequence_reasons(rows, source, order, parts).join(verses, ["book", "chapter"], "left")
    beyond = F.coalesce((F.col("verse") > F.col("last")) | (F.col("verse") < 1), F.lit(False))
    rows = joined_by(rows.withColumn("out_of_bounds", beyond), middle, [source])
    odd = F.coalesce((F.col("words") < SHORT) | (F.col("words") > LONG * F.col("middle")), F.lit(False))
    rows = rows.withColumn("odd_size", odd).withColumn("flagged", F.col("out_of_sequence") | F.col("out_of_bounds"))
    return rows.withColumn("confidence", F.when(F.col("odd_size"), F.lit(DOUBT)).otherwise(F.lit(1.0))).drop("middle", "last")


def gaps(rows: DataFrame) -> DataFrame:
    """(book, low, high): stretches of chapters between a book's first and last that no excerpt starts or ends in.

    A stretch is a row however long it is, so a faulty chapter number makes one wide row.
    """
    touched = rows.select("book", F.explode(F.array("cs", "ce")).alias("c")).where("c IS NOT NULL").distinct()
    next_ = F.lead("c").over(Window.partitionBy("book").orderBy("c"))
    return touched.withColumn("next", next_).where("next > c + 1").selectExpr("book", "c + 1 AS low", "next - 1 AS high")


def coverage(rows: DataFrame) -> DataFrame:
    """(book, total, flagged, missing, gaps): how many chapters no excerpt starts or ends in, and in which stretches."""
    flags = F.sum(F.col("flagged").cast("long"))
    held = rows.groupBy("book").agg(F.count("*").alias("total"), flags.alias("flagged"))
    listed = F.array_sort(F.collect_list(F.struct("low", "high"))).alias("gaps")  # fewer than a book has chapters
    lost = gaps(rows).groupBy("book").agg(F.sum(F.col("high").cast("long") - F.col("low") + 1).alias("missing"), listed)
    return joined_by(held, lost, ["book"]).withColumn("missing", F.coalesce("missing", F.lit(0)))


def content_hash(header: Column, text: Column) -> Column:
    """What a correction is found by."""
    return F.sha2(F.concat(header, F.lit("\n"), text), 256)


PLACE = ("book", "cs", "vs", "ce", "ve")


def corrected(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows with the last correction of their hash applied, and action: what it was.

    Discarded rows go, confirmed and reassigned ones lose their flag, and reassigned ones take the correction's place,
    as far as it has the columns of one.
    """
    last = Window.partitionBy("hash").orderBy(F.desc("position"))
    moved = [c for c in PLACE if c in corrections.columns and c in rows.columns]
    latest = corrections.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("hash", "action", *(F.col(c).alias(f"_{c}") for c in moved))
    rows = rows.join(latest, "hash", "left").where("action is null or action <> 'discard'")
    is_moved = F.coalesce(F.col("action") == "reassign", F.lit(False))
    for c in moved:
        rows = rows.withColumn(c, F.when(is_moved, F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    settled = F.coalesce(F.col("action").isin("confirm", "reassign"), F.lit(False))
    return rows.drop(*(f"_{c}" for c in moved)).withColumn("flagged", F.col("flagged") & ~settled)


def orphans(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections whose text is no longer there."""
    return corrections.join(rows.select("hash"), "hash", "left_anti")


def finalised(rows: DataFrame, corrections: DataFrame, verses: DataFrame, source: str, order: str) -> DataFrame:
    """An index's rows (hash, book, cs, vs, ce, ve, words, ...) as they are kept: corrected, validated, settled ones unflagged.

    A reassigned row is validated where it now is. What a user has confirmed or moved stays unflagged whatever the
    validation says; its reasons stay.
    """
    fixed = corrected(rows.withColumn("flagged", F.lit(False)), corrections).drop("flagged")
    fixed = fixed.withColumn("chapter", F.col("cs")).withColumn("verse", F.col("vs"))
    checked = validated(fixed, verses, source, order)
    settled = F.coalesce(F.col("action").isin("confirm", "reassign"), F.lit(False))
    return checked.withColumn("flagged", F.col("flagged") & ~settled).drop("action", "chapter", "verse")


def runs(rows: DataFrame, partition: str, order: str, value: str, parts: int | None = None) -> DataFrame:
    """Add run: the number of the stretch of equal values that a row is in."""
    ranged = in_ranges(rows, [partition], [order], parts)
    before = scanned(ranged, [partition], [order], previous={"_before": F.struct(value)})
    new = F.when(F.col("_before").isNotNull() & F.col(value).eqNullSafe(F.col("_before")[value]), 0).otherwise(1)
    return scanned(before, [partition], [order], total={"run": new}).drop("_before", "_part")


def carried(rows: DataFrame, partition: str, order: str, value: str, parts: int | None = None) -> DataFrame:
    """Replace a null value by the last one before it."""
    found = scanned(rows, [partition], [order], last={"_carried": F.col(value)}, parts=parts)
    return found.withColumn(value, F.col("_carried")).drop("_carried")


def running_edges(pages: DataFrame) -> DataFrame:
    """(book, edge): digit-free edge lines on at least half of a book's pages, of books with three pages or more."""
    edges = pages.withColumn("edge", F.regexp_replace("edge", "[0-9]+", "#"))
    total = edges.groupBy("book").agg(F.countDistinct("page").alias("pages")).where("pages >= 3")
    seen = edges.groupBy("book", "edge").agg(F.countDistinct("page").alias("n"))
    return seen.join(total, "book").where("2 * n >= pages").select("book", "edge", "n")


def nearby_edges(pages: DataFrame, around: int = 8, least: int = 3, bucket: int = 512) -> DataFrame:
    """(book, page): pages whose digit-free edge line is that of at least `least` of the pages around, itself apart.

    Pages are looked at in buckets with those around them, so that a line on every page of a long book isn't in one task.
    """
    edges = pages.withColumn("edge", F.regexp_replace("edge", "[0-9]+", "#")).withColumn("_own", F.expr(f"floor(page / {bucket})"))
    some = f"sequence(CAST(floor((page - {around}) / {bucket}) AS bigint), CAST(floor((page + {around}) / {bucket}) AS bigint))"
    edges = edges.withColumn("_bucket", F.explode(F.expr(some)))
    near = Window.partitionBy("book", "edge", "_bucket").orderBy("page").rangeBetween(-around, around)
    found = edges.withColumn("_n", F.count("*").over(near) - 1)
    return found.where((F.col("_n") >= least) & (F.col("_bucket") == F.col("_own"))).select("book", "page")


def evenly_sampled(rows: DataFrame, partition: str, order: str, most: int = 40, parts: int | None = None) -> DataFrame:
    """All rows of a part of at most `most`, else so many of it, evenly spaced behind its first tenth."""
    found = scanned(rows, [partition], [order], total={"_nth": F.lit(1)}, parts=parts)
    found = joined_by(found, rows.groupBy(partition).agg(F.count("*").alias("_many")), [partition])
    found = found.withColumn("_skip", F.when(F.col("_many") <= most, 0).otherwise(F.floor(F.col("_many") * 0.1)))
    found = found.withColumn("_at", F.col("_nth") - 1 - F.col("_skip")).withColumn("_step", F.greatest(F.lit(1), F.expr(f"(_many - _skip) div {most}")))
    found = found.where((F.col("_at") >= 0) & (F.col("_at") % F.col("_step") == 0) & (F.expr("_at div _step") < most))
    return found.select(*rows.columns)


def reviewed(excerpts: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(excerpts, corrections) after reviews(excerpt_id, action, book, cs, vs, ce, ve, position), of which the last counts.

    'confirm' takes the flag off, 'reassign' sets the place and takes it off, 'discard' puts it on. A correction is kept
    under the hash of the excerpt's header and text, so that it holds when they are extracted again.
    """
    last = reviews.groupBy("excerpt_id").agg(F.max_by(F.struct("action", "book", "cs", "vs", "ce", "ve", "position"), "position").alias("_r"))
    rows = excerpts.join(last, "excerpt_id", "left")
    action = F.col("_r.action")
    place = {c: F.when(action == "reassign", F.col(f"_r.{c}")).otherwise(F.col(c)) for c in ("book", "cs", "vs", "ce", "ve")}
    flag = F.when(action == "discard", True).when(action.isin("confirm", "reassign"), False).otherwise(F.col("flagged"))
    found = rows.where(action.isNotNull()).select(content_hash(F.coalesce("header", F.lit("")), F.col("text")).alias("hash"), "_r.*")
    return rows.withColumns({**place, "flagged": flag}).select(*excerpts.columns), found


def index_status(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """sources(source, ...) with status: 'indexed' where there are rows(source) of them, else 'unindexed'."""
    there = rows.select("source").distinct().withColumn("_there", F.lit(True))
    out = sources.drop("status").join(there, "source", "left")
    return out.withColumn("status", F.when(F.col("_there"), "indexed").otherwise("unindexed")).drop("_there")


def numbered(rows: DataFrame, partition: str, order: str, parts: int | None = None) -> DataFrame:
    """Add ordinal: a section's place in its document, from 1."""
    return scanned(rows, [partition], [order], total={"ordinal": F.lit(1)}, parts=parts).withColumn("ordinal", F.col("ordinal").cast("int"))
