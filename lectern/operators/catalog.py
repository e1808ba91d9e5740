"""Catalogue queries: members, counts, groups and orders over books, tags, shelves and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import leading_number
from lectern.operators.scans import scanned


def member_counts(dim: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Each row of dim with how many members it has, also none."""
    counts = members.groupBy(key).agg(F.count("*").alias("n"))
    return dim.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def values_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the sorted distinct values of each key."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def in_groups(rows: DataFrame, group: Column, default: str) -> DataFrame:
    """Rows with a bucket for each of their groups (an array), or the default where they have none."""
    some = F.when(F.size(group) > 0, group).otherwise(F.array(F.lit(default)))
    return rows.withColumn("bucket", F.explode(F.coalesce(some, F.array(F.lit(default)))))


def by_series(rows: DataFrame, number: str, title: str) -> list[Column]:
    """Order in a series: numbered before not, by number, then title."""
    return [leading_number(F.col(number)).asc_nulls_last(), F.col(title).asc()]


def with_citations(books: DataFrame, quotes: DataFrame) -> DataFrame:
    """Books that are quoted, with the number of quotes."""
    return books.join(quotes.groupBy("book_id").agg(F.count("*").alias("quotes")), "book_id")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without the new ones' keys, and the new rows."""
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Old rows, and new rows of keys that aren't there; of several the first in an order, or any."""
    fresh = new.join(old, keys, "left_anti")
    fresh = fresh.dropDuplicates(keys) if order is None else best_per_key(fresh, keys, order, F.min_by)
    return old.unionByName(fresh, allowMissingColumns=True)


def best_per_key(rows: DataFrame, keys: list[str], order: Column, pick=F.max_by) -> DataFrame:
    """The row of each key that is last in an order (or first: F.min_by), found without a sort or a window."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(pick(whole, order).alias("_row")).select("_row.*")


def replaced(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Old rows and new ones, of which the last in an order takes the place of all others of its key."""
    return upsert(old, best_per_key(new, keys, order), keys)


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with every column that the patch has a value for."""
    p = patch.select(key, *(F.col(c).alias(f"_new_{c}") for c in patch.columns if c != key))
    out = rows.join(p, key, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in patch.columns and c != key else F.col(c) for c in rows.columns))


def cascade(children: DataFrame, gone: DataFrame, key: str, keep: bool = False) -> DataFrame:
    """Children without those of deleted parents, or with a null in place of the parent."""
    if not keep:
        return children.join(gone.select(key), key, "left_anti")
    mark = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    out = children.join(mark, key, "left")
    return out.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone").select(*children.columns)


def reordered(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows with sort_order from a list of ids, which begins at 1; rows that aren't in it keep theirs."""
    place = rows.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(ids)], f"{key} {rows.schema[key].dataType.simpleString()}, _place int")
    out = rows.join(place, key, "left")
    return out.withColumn("sort_order", F.coalesce("_place", "sort_order")).drop("_place").select(*rows.columns)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with _n, their number from 1 in an order over all of them, which has no ties.

    They are sorted in range partitions and scanned: a window without a key would put all rows in one task.
    """
    return scanned(rows.withColumn("_all", F.lit(0)), ["_all"], list(order), total={"_n": F.lit(1)}).drop("_all")


def appended(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows and new ones behind them, in order of name: sort_order goes on from the largest."""
    last = rows.agg(F.coalesce(F.max("sort_order"), F.lit(0)).alias("_last"))  # one row
    order = (F.col("_last") + F.col("_n")).cast(rows.schema["sort_order"].dataType)
    more = numbered(new, "name").crossJoin(F.broadcast(last)).withColumn("sort_order", order).drop("_last", "_n")
    return rows.unionByName(more)


def filled(rows: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """A blank value is filled with the first that isn't of the same key, ignoring case."""
    some = rows.where(F.trim(F.coalesce(value, F.lit(""))) != "").groupBy(F.lower(key).alias("_key")).agg(F.min_by(value, order).alias("_value"))
    out = rows.join(some, F.lower(key) == F.col("_key"), "left")
    return out.withColumn(value, F.coalesce(F.nullif(F.trim(value), F.lit("")), "_value")).select(*rows.columns)


def by_document(quotes: DataFrame, sources: DataFrame, others: DataFrame) -> DataFrame:
    """(source, name, document, n): quotes by source and the part of ref before ':', with names from either table."""
    named = sources.unionByName(others).groupBy("source").agg(F.min("name").alias("name"))
    rows = quotes.where(F.instr("ref", ":") > 1).withColumn("document", F.substring_index("ref", ":", 1))
    counts = rows.groupBy("source", "document").agg(F.count("*").alias("n"))
    return counts.join(named, "source", "left").withColumn("name", F.coalesce("name", F.lit("Unknown source")))


def author_names(books: DataFrame) -> DataFrame:
    """(author): every author of books(author) once, whatever stands between several of one book."""
    each = books.select(F.explode(F.split("author", "\\s*[&;]\\s*|\\s+and\\s+")).alias("author"))
    return each.select(F.trim("author").alias("author")).where("author <> ''").distinct()


def series_names(books: DataFrame) -> DataFrame:
    """(series): every series of books(series) once."""
    return books.select(F.trim("series").alias("series")).where("series <> ''").distinct()


def on_shelf(books: DataFrame, members: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Books whose key is among members, or isn't."""
    return books.join(members.select(key), key, "left_semi" if inside else "left_anti")


def completions(rows: DataFrame, column: str, typed: str, *ties: str, limit: int = 8) -> DataFrame:
    """The first values, in any case, of those that hold what was typed."""
    return rows.where(F.contains(F.lower(column), F.lit(typed.lower()))).orderBy(F.lower(column), column, *ties).limit(limit)
