"""The reference tables, derived from the driver's tables; the SQL beside each gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_docs(spark: SparkSession, d: str) -> DataFrame:
    """Pages from documents, notes from conversations, quotes from the benchmark."""
    pages = table(spark, d, "documents").selectExpr("concat('d', doc_id) AS key", "'page' AS kind", "source AS book_id", "text AS content")
    notes = table(spark, d, "conversations").selectExpr("concat('c', conv_id, '-', turn) AS key", "'note' AS kind", "role AS book_id", "text AS content")
    quotes = table(spark, d, "benchmark").selectExpr("concat('b', item_id) AS key", "'quote' AS kind", "'bench' AS book_id", "text AS content")
    return pages.unionByName(notes).unionByName(quotes).withColumn("ref", F.lit(None).cast("string"))


_written: dict[tuple[str, str], search.Index] = {}


def search_index(spark: SparkSession, d: str) -> search.Index:
    """The index of search_docs: written once for an application, and read by all its searches; derived if nothing is shared."""
    key, folder = (spark.sparkContext.applicationId, d), shared_folder(spark)
    if key not in _written:
        index = search.build_index(search_docs(spark, d))
        _written[key] = search.write_index(index, f"{folder}/lectern-{key[0]}/search-{len(_written)}") if folder else index
    return _written[key]


SEARCH_DOCS = """
s AS (SELECT 'd' || doc_id AS key, 'page' AS kind, source AS book_id, text AS content FROM documents
      UNION ALL SELECT 'c' || conv_id || '-' || turn, 'note', role, text FROM conversations
      UNION ALL SELECT 'b' || item_id, 'quote', 'bench', text FROM benchmark)"""


def books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "p_partkey AS book_id", "p_name AS title", "p_type AS author", "p_brand AS series",
        "CASE WHEN p_size % 5 <> 0 THEN cast(p_size AS string) END AS series_number", "1850 + p_size * 5 AS year",
        "CASE WHEN p_size % 3 <> 0 THEN concat('House ', p_brand) END AS publisher",
    )


BOOKS = """
books AS (SELECT p_partkey AS book_id, p_name AS title, p_type AS author, p_brand AS series,
          CASE WHEN p_size % 5 <> 0 THEN p_size::VARCHAR END AS series_number, 1850 + p_size * 5 AS year,
          CASE WHEN p_size % 3 <> 0 THEN 'House ' || p_brand END AS publisher FROM part)"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS quote_id", "l_partkey AS book_id",
        "CASE WHEN l_linenumber <> 1 THEN l_linenumber END AS page", "l_shipdate AS created", "l_returnflag AS color",
        "l_suppkey AS source_id",
    )


QUOTES = """
quotes AS (SELECT l_orderkey || '-' || l_linenumber AS quote_id, l_partkey AS book_id,
           CASE WHEN l_linenumber <> 1 THEN l_linenumber END AS page, l_shipdate AS created, l_returnflag AS color,
           l_suppkey AS source_id FROM lineitem)"""


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of one to three chapters; some inverted, some flagged."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS excerpt_id", "cast(o_custkey % 66 AS int) AS book", "cast(o_orderkey % 40 + 1 AS int) AS cs",
        "cast(o_custkey % 30 + 1 AS int) AS vs", "cast(o_orderkey % 40 + 1 + o_orderkey % 3 AS int) AS ce",
        "cast((o_custkey + o_orderkey) % 30 + 1 AS int) AS ve", "o_orderstatus = 'P' AS flagged",
        "cast(o_custkey % 7 AS int) AS source", "length(o_orderpriority) * 3 + cast(o_orderkey % 60 AS int) AS words",
    )


EXCERPTS = """
excerpts AS (SELECT o_orderkey AS excerpt_id, (o_custkey % 66)::INT AS book, (o_orderkey % 40 + 1)::INT AS cs,
             (o_custkey % 30 + 1)::INT AS vs, (o_orderkey % 40 + 1 + o_orderkey % 3)::INT AS ce,
             ((o_custkey + o_orderkey) % 30 + 1)::INT AS ve, o_orderstatus = 'P' AS flagged,
             (o_custkey % 7)::INT AS source, (length(o_orderpriority) * 3 + o_orderkey % 60)::INT AS words FROM orders)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("point_id"), (F.col("l_partkey") % 66).cast("int").alias("book"),
        (F.col("l_orderkey") % 42 + 1).cast("int").alias("chapter"), (F.col("l_suppkey") % 31 + 1).cast("int").alias("verse"),
    )


POINTS = """
points AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, (l_partkey % 66)::INT AS book, (l_orderkey % 42 + 1)::INT AS chapter,
           (l_suppkey % 31 + 1)::INT AS verse FROM lineitem)"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns with links to nations, spelled in several ways, and to names that aren't there."""
    n = table(spark, d, "nation").selectExpr("n_nationkey AS k", "n_name AS name")
    turns = table(spark, d, "conversations").selectExpr("concat(conv_id, '-', turn) AS note", "conv_id % 25 AS k", "conv_id + turn AS v", "text")
    text = "concat(text, ' [[', CASE v % 3 WHEN 0 THEN name WHEN 1 THEN lower(name) ELSE concat('No ', name) END, CASE v % 2 WHEN 0 THEN '#s|alias]]' ELSE ']]' END)"
    return turns.join(F.broadcast(n), "k").selectExpr("note", f"{text} AS text")


NOTES = """
notes AS (SELECT conv_id || '-' || turn AS note, text || ' [[' || CASE (conv_id + turn) % 3 WHEN 0 THEN n_name
          WHEN 1 THEN lower(n_name) ELSE 'No ' || n_name END || CASE (conv_id + turn) % 2 WHEN 0 THEN '#s|alias]]' ELSE ']]' END AS text
          FROM conversations JOIN nation ON conv_id % 25 = n_nationkey),
links AS (SELECT note, trim(regexp_extract(unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)), '^([^#|]*)', 1)) AS target FROM notes)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "concat(event_type, '/', user_id) AS path", "timestampdiff(SECOND, timestamp_ntz '1970-01-01', ts) AS mtime", "concat('f', user_id % 50) AS name",
        "cast(event_id % 97 AS int) AS size", "event_id",
    )


FILES = """
files AS (SELECT event_type || '/' || user_id AS path, floor(epoch(ts))::BIGINT AS mtime, 'f' || (user_id % 50) AS name,
          (event_id % 97)::INT AS size, event_id FROM events)"""
