"""Queries of shelves, sources, notes, counts and scanned chapters, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import notes, values
from lectern.operators import catalog, normalise, quotes, search, upkeep
from lectern.plans import fixtures as fx
from lectern.plans.bm25 import SHOWN
from lectern.plans.bm25 import bm25 as _bm25
from lectern.plans.registry import query


@query("agg1_health", """SELECT (SELECT count(*) FROM part) AS books, (SELECT count(*) FROM part WHERE p_size % 5 = 0) AS indexed, (SELECT count(*) FROM lineitem) AS quotes, (SELECT count(*) FROM conversations) AS notes""")
def agg1_health(spark: SparkSession, d: str) -> DataFrame:
    """AGG1: how much there is of everything; one pass over each table, one row from each."""
    books = fx.table(spark, d, "part").agg(F.count("*").alias("books"), F.count_if(F.col("p_size") % 5 == 0).alias("indexed"))
    one = lambda t, n: F.broadcast(fx.table(spark, d, t).agg(F.count("*").alias(n)))
    return books.crossJoin(one("lineitem", "quotes")).crossJoin(one("conversations", "notes"))


_REFS = "concat(CASE l_suppkey % 3 WHEN 0 THEN 'ROM' WHEN 1 THEN 'JHN' ELSE 'X' END, CASE WHEN l_linenumber = 1 THEN '' ELSE concat(' ', l_partkey % 9, ':', l_linenumber) END)"


@query("agg5_quoted_chapters", f"""WITH q AS (SELECT {_REFS} AS ref FROM lineitem)
SELECT book, chapter, count(*) AS n, coalesce(max(b.o), 0)::INT AS place FROM (SELECT regexp_extract(ref, '^(\\S+)\\s+(\\d+):', 1) AS book, regexp_extract(ref, '^(\\S+)\\s+(\\d+):', 2) AS chapter FROM q) LEFT JOIN (VALUES ('ROM', 45), ('JHN', 43)) b(c, o) ON c = book WHERE book <> '' GROUP BY 1, 2""")
def agg5_quoted_chapters(spark: SparkSession, d: str) -> DataFrame:
    """AGG5, SRT4: quotes by chapter, with the book's place in the canon; 0 where it isn't in it."""
    part = lambda i: F.regexp_extract("ref", "^(\\S+)\\s+(\\d+):", i)
    rows = fx.table(spark, d, "lineitem").selectExpr(f"{_REFS} AS ref").select(part(1).alias("book"), part(2).alias("chapter")).where("book <> ''")
    canon = spark.createDataFrame([("ROM", 45), ("JHN", 43)], "book string, place int")
    counts = rows.groupBy("book", "chapter").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(canon), "book", "left").withColumn("place", F.coalesce("place", F.lit(0)))


@query("agg6_quoted_books", f"SELECT split_part({_REFS}, ' ', 1) AS book, count(*) AS n FROM lineitem GROUP BY 1")
def agg6_quoted_books(spark: SparkSession, d: str) -> DataFrame:
    """AGG6: quotes by book, also those that name no chapter."""
    rows = fx.table(spark, d, "lineitem").selectExpr(f"{_REFS} AS ref")
    return rows.groupBy(F.substring_index("ref", " ", 1).alias("book")).agg(F.count("*").alias("n"))


@query("agg7_quote_authors", """SELECT CASE WHEN l_linenumber < 4 THEN CASE WHEN p_size % 3 = 0 THEN 'Unknown author' ELSE p_type END WHEN l_linenumber < 6 THEN coalesce(s_name, 'Unknown author') ELSE 'Scripture' END AS bucket, count(*) AS n
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 2 = 0 GROUP BY 1""")
def agg7_quote_authors(spark: SparkSession, d: str) -> DataFrame:
    """AGG7: quotes by author, and in one bucket each without one and of scripture."""
    rows = fx.table(spark, d, "lineitem").selectExpr("l_partkey", "l_suppkey", "CASE WHEN l_linenumber < 4 THEN l_partkey END AS book_id", "CASE WHEN l_linenumber < 6 THEN l_suppkey END AS source")
    authors = fx.table(spark, d, "part").selectExpr("p_partkey AS l_partkey", "CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_type END AS book_author")
    others = fx.table(spark, d, "supplier").where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS l_suppkey", "s_name AS source_author")
    rows = rows.join(authors, "l_partkey", "left").join(others, "l_suppkey", "left")
    return upkeep.author_of(rows).groupBy("bucket").agg(F.count("*").alias("n"))


@query("agg15_flagged", f"WITH {fx.EXCERPTS} SELECT source, count(*) AS n FROM excerpts WHERE flagged GROUP BY 1")
def agg15_flagged(spark: SparkSession, d: str) -> DataFrame:
    """AGG15: flagged excerpts by source."""
    return upkeep.flagged(fx.excerpts(spark, d)).groupBy("source").agg(F.count("*").alias("n"))


@query("agg18_last_per_verse", f"WITH {fx.EXCERPTS} SELECT book, vs, ve, max(excerpt_id) AS excerpt_id FROM excerpts GROUP BY ALL")
def agg18_last_per_verse(spark: SparkSession, d: str) -> DataFrame:
    """AGG18: the last excerpt of each range of verses."""
    return catalog.first_per_key(fx.excerpts(spark, d), ["book", "vs", "ve"], [F.desc("excerpt_id")]).select("book", "vs", "ve", "excerpt_id")


@query("agg19_yields", """WITH b AS (SELECT o_custkey % 20 AS source, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 40 WHEN o_orderkey % 8 = 0 THEN o_orderkey % 5 ELSE 0 END AS book, count(*) AS n, sum(length(o_orderpriority)) AS chars FROM orders GROUP BY 1, 2),
s AS (SELECT source, sum(n)::BIGINT AS excerpts, count(*) AS books, sum(chars) / sum(n) AS mean_length, list_reverse_sort(list(n)) AS l FROM b GROUP BY 1)
SELECT source, excerpts, books, mean_length, books > 3 AND l[2 + (books - 1) // 2] <= 3 AND 2 * l[1] > excerpts AS contaminated FROM s""")
def agg19_yields(spark: SparkSession, d: str) -> DataFrame:
    """AGG19: what a conversion gave, and whether its books look like citations."""
    book = "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 40 WHEN o_orderkey % 8 = 0 THEN o_orderkey % 5 ELSE 0 END AS book"
    return upkeep.yields(fx.table(spark, d, "orders").selectExpr("o_custkey % 20 AS source", book, "o_orderpriority AS text"))


@query("agg19_chapters", f"WITH {fx.EXCERPTS} SELECT source, book, count(*) AS excerpts, list_sort(list(DISTINCT cs))::VARCHAR AS chapters FROM excerpts GROUP BY ALL")
def agg19_chapters(spark: SparkSession, d: str) -> DataFrame:
    """AGG19: excerpts and chapters of each book that a conversion found."""
    rows = upkeep.chapter_yields(fx.excerpts(spark, d))
    return rows.withColumn("chapters", F.concat(F.lit("["), F.concat_ws(", ", F.col("chapters").cast("array<string>")), F.lit("]")))


@query("agg19_doubtful", """WITH o AS (SELECT o_custkey AS source, count(*) AS n, avg(length(o_comment)) AS mean FROM (SELECT o_custkey, o_orderpriority AS o_comment FROM orders) GROUP BY 1)
SELECT c_custkey AS source, (1 + c_custkey % 200)::INT AS pages, coalesce(n, 0) AS excerpts, coalesce(n, 0) / (1 + c_custkey % 200) AS yield, coalesce(n, 0) / (1 + c_custkey % 200) < 0.15 AS few, coalesce(mean < 10, false) AS brief
FROM customer LEFT JOIN o ON c_custkey = source""")
def agg19_doubtful(spark: SparkSession, d: str) -> DataFrame:
    """AGG19: sources with few excerpts for their pages, none, or short ones."""
    pages = fx.table(spark, d, "customer").selectExpr("c_custkey AS source", "cast(1 + c_custkey % 200 AS int) AS pages")
    return upkeep.doubtful_yields(fx.table(spark, d, "orders").selectExpr("o_custkey AS source", "o_orderpriority AS text"), pages, length=10)


@query("agg21_first_titles", """WITH r AS (SELECT o_orderstatus AS outcome, o_orderpriority || o_orderkey AS title FROM orders),
k AS (SELECT outcome, title FROM r QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY title) <= 50)
SELECT outcome, (SELECT count(*) FROM r WHERE r.outcome = k.outcome) AS n, string_agg(title, '|' ORDER BY title) AS titles FROM k GROUP BY outcome""")
def agg21_first_titles(spark: SparkSession, d: str) -> DataFrame:
    """AGG21, SRT9: how many books an import left in each state, and their first 50 titles."""
    rows = fx.table(spark, d, "orders").selectExpr("o_orderstatus AS outcome", "concat(o_orderpriority, o_orderkey) AS title")
    return upkeep.outcomes(rows).withColumn("titles", F.array_join("titles", "|"))


@query("agg21_outcomes", "SELECT l_shipmode AS outcome, count(*) AS n FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'alreadyLocal' WHEN 1 THEN 'connected' ELSE 'missing' END AS l_shipmode FROM lineitem) GROUP BY 1")
def agg21_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """AGG21: how many books an import left in each state."""
    outcome = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'alreadyLocal' WHEN 1 THEN 'connected' ELSE 'missing' END")
    return fx.table(spark, d, "lineitem").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("flt4_picked", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7 AND l_suppkey % 10 = 3) AS inside FROM part WHERE contains(lower(p_name), 'ring')")
def flt4_picked(spark: SparkSession, d: str) -> DataFrame:
    """FLT4: what a picker shows: sources of a project and what could become one."""
    part, members = fx.table(spark, d, "part"), fx.table(spark, d, "lineitem").where("l_linenumber = 7 AND l_suppkey % 10 = 3").selectExpr("l_partkey AS p_partkey")
    side = lambda x: upkeep.picked(part, members, "p_partkey", F.col("p_name"), " Ring", x).select("p_partkey", F.lit(x).alias("inside"))
    return side(True).unionByName(side(False))


@query("flt7_flagged_of_source", f"WITH {fx.EXCERPTS} SELECT excerpt_id FROM excerpts WHERE flagged AND source = 3")
def flt7_flagged_of_source(spark: SparkSession, d: str) -> DataFrame:
    """FLT7: flagged excerpts of a source; the filter reaches the scan."""
    return upkeep.flagged(fx.excerpts(spark, d), 3).select("excerpt_id")


@query("flt8_point", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 42")
def flt8_point(spark: SparkSession, d: str) -> DataFrame:
    """FLT8: one row by key."""
    return fx.table(spark, d, "part").where("p_partkey = 42").select("p_partkey", "p_name")


@query("srt3_listed", "SELECT r_regionkey, n, row_number() OVER (PARTITION BY r_regionkey ORDER BY s, lower(n), n)::INT AS place FROM (SELECT n_regionkey AS r_regionkey, n_nationkey % 2 AS s, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS n FROM nation)")
def srt3_listed(spark: SparkSession, d: str) -> DataFrame:
    """SRT3, SYS5: rows as the user put them, then by name whatever its case."""
    rows = fx.table(spark, d, "nation").selectExpr("n_regionkey AS r_regionkey", "n_nationkey % 2 AS sort_order", "CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("r_regionkey").orderBy(*upkeep.listed("n")))).drop("sort_order")


@query("srt7_by_language", "SELECT n_regionkey, n, row_number() OVER (PARTITION BY n_regionkey ORDER BY strip_accents(lower(n)))::INT AS place FROM (SELECT n_regionkey, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(n_name, 'A', 'á') ELSE n_name END AS n FROM nation)")
def srt7_by_language(spark: SparkSession, d: str) -> DataFrame:
    """SRT7: titles in the order of a language, accents and case last."""
    rows = fx.table(spark, d, "nation").selectExpr("n_regionkey", "CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(n_name, 'A', 'á') ELSE n_name END AS n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(*upkeep.by_language("n"))))


@query("sys2_renamed_shelf", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'New ' || n_nationkey ELSE n_name END AS name FROM nation")
def sys2_renamed_shelf(spark: SparkSession, d: str) -> DataFrame:
    """SYS2: shelves get new names, but not blank ones and not another's."""
    n = fx.table(spark, d, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    new = "CASE id % 5 WHEN 0 THEN concat(' New ', id) WHEN 1 THEN ' ' WHEN 2 THEN 'NATION_7' ELSE name END AS name"
    return upkeep.renamed(n, n.selectExpr("id", new))


@query("sys3_relinked", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'pdf-cache/' || p_partkey || '.pdf' END AS local_path,
 CASE WHEN p_partkey % 5 = 0 THEN 'source' WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN 'f' || p_partkey END AS source_path FROM part""")
def sys3_relinked(spark: SparkSession, d: str) -> DataFrame:
    """SYS3: files chosen for books; the source is remembered where the drive has none."""
    books = fx.table(spark, d, "part").selectExpr("p_partkey AS id", "p_partkey % 3 = 0 AS pdf_exists", "cast(null AS string) AS local_path", "CASE WHEN p_partkey % 5 = 0 THEN 'source' END AS source_path")
    chosen = fx.table(spark, d, "part").where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "concat('f', p_partkey) AS path")
    return upkeep.relinked(books, chosen).drop("pdf_exists")


@query("sys4_vault_paths", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '/data/vault/notes/' || n_name || '.md' END AS place FROM nation")
def sys4_vault_paths(spark: SparkSession, d: str) -> DataFrame:
    """SYS4: paths that leave the vault, by '..' or into a folder whose name begins like its, are none."""
    path = F.expr("CASE n_nationkey % 3 WHEN 0 THEN concat('notes/./x/../', n_name, '.md') WHEN 1 THEN concat('../vault-backup/', n_name) ELSE concat('a/../../', n_name) END")
    return fx.table(spark, d, "nation").select("n_nationkey", upkeep.within_vault("/data/vault", path).alias("place"))


@query("sys4_new_notes", "SELECT 'notes/standalone/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '-x' || n_nationkey ELSE '' END || '.md' AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'project' ELSE 'note' END AS type FROM nation")
def sys4_new_notes(spark: SparkSession, d: str) -> DataFrame:
    """SYS4: notes to create, beside those that are there."""
    n = fx.table(spark, d, "nation")
    there = n.where("n_nationkey % 2 = 0").selectExpr("concat('notes/standalone/', n_name, '.md') AS path")
    asked = n.selectExpr("n_name AS title", "CASE WHEN n_nationkey % 3 = 0 THEN 'project' ELSE 'bad' END AS type", "concat('x', n_nationkey) AS suffix")
    return upkeep.new_notes(asked, there, ["note", "project"]).select("path", "type")


@query("sys1_covers", "SELECT n_nationkey, 'data:image/' || CASE WHEN n_nationkey % 2 = 0 THEN 'png' ELSE 'jpeg' END || ';base64,' || to_base64(encode(n_name)) AS url FROM nation")
def sys1_covers(spark: SparkSession, d: str) -> DataFrame:
    """SYS1: covers as data URLs."""
    path = F.when(F.col("n_nationkey") % 2 == 0, "a/x.PNG").otherwise("a/x.jpg")
    return fx.table(spark, d, "nation").select("n_nationkey", upkeep.cover_url(path, F.col("n_name").cast("binary")).alias("url"))


@query("sys10_chapters", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'KJV' ELSE 'BSB' END AS edition, r_name || ' ' || (c_custkey % 12) AS reference FROM customer JOIN region ON r_regionkey = c_nationkey % 7 WHERE c_custkey % 12 BETWEEN 1 AND r_regionkey + 4""")
def sys10_chapters(spark: SparkSession, d: str) -> DataFrame:
    """SYS10: chapters to show, in the first edition where the asked one isn't known."""
    asked = fx.table(spark, d, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 2 THEN 'KJV' WHEN 3 THEN 'gone' ELSE 'BSB' END AS edition", "c_nationkey % 7 AS book", "c_custkey % 12 AS chapter")
    books = fx.table(spark, d, "region").selectExpr("r_regionkey AS book", "r_name AS name", "r_regionkey + 4 AS chapters")
    editions = spark.createDataFrame([(1, "BSB", "Standard"), (2, "KJV", "King James")], "position int, edition string, edition_name string")
    made = upkeep.assembled(asked.select("edition", "book", "chapter").distinct(), books, editions)
    keyed = asked.withColumn("edition", F.when(F.col("edition") == "gone", "BSB").otherwise(F.col("edition")))
    return keyed.join(made.distinct(), ["edition", "book", "chapter"]).select("c_custkey", "edition", "reference")


@query("fts12_in_book", f"""WITH h AS ({_bm25("kind = 'page' AND book_id = 'src0'", ("er",))}), p AS (SELECT key, substr(key, 2)::BIGINT AS page, rank FROM h),
n AS (SELECT *, row_number() OVER (ORDER BY page, key)::INT AS n FROM p)
SELECT key, page, rank, n, coalesce(lead(key) OVER (ORDER BY n), first_value(key) OVER (ORDER BY n)) AS following FROM n""")
def fts12_in_book(spark: SparkSession, d: str) -> DataFrame:
    """FTS12, FTS13: hits in one book by page, cut by rank first, each with the hit after it, the first after the last."""
    hits = search.search(fx.search_index(spark, d), "er", (F.col("kind") == "page") & (F.col("book_id") == "src0"), digits=SHOWN)
    found = search.by_page(hits.withColumn("page", F.substring("key", 2, 20).cast("long")))
    return found.withColumn("rank", F.round("rank", 9))


@query("str30_styled", "SELECT c_custkey, 'text:a ,bold:' || c_name || ',text: and ,italic:' || c_mktsegment || ',struck:gone,text: **' AS parts FROM customer")
def str30_styled(spark: SparkSession, d: str) -> DataFrame:
    """STR30: a quote's marks; those that aren't closed stay."""
    text = F.expr("concat('a **', c_name, '** and *', c_mktsegment, '*~~gone~~ **')")
    listed = F.array_join(F.transform(notes.styled_parts(text), lambda p: F.concat_ws(":", p["kind"], p["text"])), ",")
    return fx.table(spark, d, "customer").select("c_custkey", listed.alias("parts"))


@query("win11_repaired", """WITH RECURSIVE e AS (SELECT event_id, user_id, user_id % 3 AS book, (event_id // 900)::INT AS c, (event_id % 20 + 1)::INT AS vs, (event_id % 20 + 1 + CASE WHEN event_id % 6 = 0 THEN 2 ELSE 0 END)::INT AS ve, event_id % 4 <> 0 AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT event_id, user_id, k, c, vs, ve FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.user_id, e.k, e.c, CASE WHEN g AND e.c = s.c THEN s.ve + 1 ELSE e.vs END, CASE WHEN g AND e.c = s.c AND e.ve = e.vs THEN s.ve + 1 ELSE e.ve END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, vs, ve FROM s""")
def win11_repaired(spark: SparkSession, d: str) -> DataFrame:
    """WIN11: verses that couldn't be read follow the excerpt before them."""
    rows = fx.table(spark, d, "events").selectExpr(
        "event_id", "user_id", "user_id % 3 AS book", "cast(event_id div 900 AS int) AS cs", "cast(event_id div 900 AS int) AS ce",
        "cast(event_id % 20 + 1 AS int) AS vs", "cast(event_id % 20 + 1 + CASE WHEN event_id % 6 = 0 THEN 2 ELSE 0 END AS int) AS ve", "event_id % 4 <> 0 AS glitched",
    )
    return upkeep.repaired(rows, ["user_id"], "event_id").select("event_id", "vs", "ve")


@query("win12_speculative", """WITH RECURSIVE h AS (SELECT event_id, user_id, CASE event_id % 7 WHEN 0 THEN 'verse' WHEN 1 THEN 'title' WHEN 2 THEN 'chapter' WHEN 3 THEN 'verse' WHEN 4 THEN 'title' WHEN 5 THEN 'body' ELSE 'title' END AS w,
  CASE WHEN event_id % 7 = 2 THEN event_id % 9 + 1 WHEN event_id % 14 = 3 THEN event_id % 6 + 1 END::INT AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT NULL::BIGINT AS event_id, user_id, 0::BIGINT AS k, NULL::INT AS c, false AS seen, false AS adv FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT h.event_id, h.user_id, h.k, CASE w WHEN 'chapter' THEN least(n, 6) WHEN 'title' THEN CASE WHEN c IS NOT NULL AND seen THEN least(c + 1, 6) ELSE c END WHEN 'verse' THEN coalesce(n, c) ELSE c END,
  CASE w WHEN 'chapter' THEN seen AND least(n, 6) IS NOT DISTINCT FROM c WHEN 'title' THEN seen AND c IS NULL WHEN 'verse' THEN seen OR coalesce(n, c) IS NOT NULL ELSE seen END, w = 'title' AND c IS NOT NULL AND seen
 FROM s JOIN h ON h.user_id = s.user_id AND h.k = s.k + 1)
SELECT event_id, c AS chapter, adv AS advanced FROM s WHERE k > 0""")
def win12_speculative(spark: SparkSession, d: str) -> DataFrame:
    """WIN12: titles that may begin a chapter do so once for each stretch of verses, and not beyond the book."""
    what = "CASE event_id % 7 WHEN 0 THEN 'verse' WHEN 1 THEN 'title' WHEN 2 THEN 'chapter' WHEN 3 THEN 'verse' WHEN 4 THEN 'title' WHEN 5 THEN 'body' ELSE 'title' END AS what"
    number = "cast(CASE WHEN event_id % 7 = 2 THEN event_id % 9 + 1 WHEN event_id % 14 = 3 THEN event_id % 6 + 1 END AS int) AS number"
    rows = fx.table(spark, d, "events").selectExpr("event_id", "user_id", what, number, "6 AS last")
    return normalise.speculative_chapters(rows, ["user_id"], "event_id").select("event_id", "chapter", "advanced")


@query("fts15_quote_texts", """SELECT l_orderkey, l_linenumber, concat_ws(chr(10), CASE WHEN l_linenumber % 4 <> 0 THEN 'text ' || l_partkey END, CASE WHEN l_linenumber % 3 = 0 THEN 'remark' END,
 '#' || l_returnflag || ' #' || l_linestatus) AS content FROM lineitem""")
def fts15_quote_texts(spark: SparkSession, d: str) -> DataFrame:
    """FTS15: what of a quote is indexed; blank parts aren't."""
    text = F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("text "), F.col("l_partkey").cast("string"))).otherwise("  ")
    remarks = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit(""), F.lit("remark")))
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quotes.document_text(text, remarks, F.array("l_returnflag", "l_linestatus")).alias("content"))


@query("fts16_unindexed", "SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND p_partkey % 5 <> 0")
def fts16_unindexed(spark: SparkSession, d: str) -> DataFrame:
    """FTS16: books with a file that aren't indexed yet."""
    books = fx.table(spark, d, "part").selectExpr("p_partkey", "CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS indexed", "CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS pdf_path")
    return search.unindexed(books).select("p_partkey")


@query("snk1_pages_replaced", """SELECT p_partkey || '/' || page AS key, CASE WHEN p_partkey % 2 = 0 THEN 'new ' ELSE 'old ' END || page AS content FROM part, (VALUES (1), (2), (3)) v(page) WHERE NOT (p_partkey % 2 = 0 AND page = 3)""")
def snk1_pages_replaced(spark: SparkSession, d: str) -> DataFrame:
    """SNK1: all rows of a book's pages give way to its new ones, and blank pages have none."""
    pages = fx.table(spark, d, "part").selectExpr("p_partkey AS k", "cast(p_partkey AS string) AS book_id", "p_name AS title", "explode(array(1, 2, 3)) AS page")
    old = search.page_rows(pages.withColumn("text", F.concat(F.lit("old "), F.col("page").cast("string"))))
    new = search.page_rows(pages.where("k % 2 = 0").withColumn("text", F.when(F.col("page") < 3, F.concat(F.lit("new "), F.col("page").cast("string"))).otherwise(" ")))
    return search.replaced_source(old, new, "page", "book_id").select("key", "content")


@query("agg11_names", "SELECT DISTINCT trim(unnest(string_split_regex(s_name || ' & ' || n_name || ' and B', '\\s*[&;]\\s*|\\s+and\\s+'))) AS author FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def agg11_names(spark: SparkSession, d: str) -> DataFrame:
    """AGG11: all authors, those of one book apart."""
    rows = fx.table(spark, d, "supplier").join(fx.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return catalog.author_names(rows.select(F.concat("s_name", F.lit(" & "), "n_name", F.lit(" and B")).alias("author")))


@query("agg11_series", "SELECT DISTINCT p_brand AS series FROM part WHERE p_size % 4 <> 0")
def agg11_series(spark: SparkSession, d: str) -> DataFrame:
    """AGG11: all series."""
    return catalog.series_names(fx.table(spark, d, "part").select(F.when(F.col("p_size") % 4 != 0, F.concat(F.lit(" "), "p_brand")).otherwise(" ").alias("series")))


@query("agg24_chapters_seen", """WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS position, l_partkey % 40 AS chapter FROM lineitem WHERE l_linenumber <> 2)
SELECT position, chapter::INT AS chapter, min(position) OVER (PARTITION BY chapter) AS first FROM q""")
def agg24_chapters_seen(spark: SparkSession, d: str) -> DataFrame:
    """AGG24: a book's quotes with their chapters in the order in which a listing first has them."""
    ref = "CASE WHEN l_linenumber = 2 THEN 'AC:4' ELSE concat('JHN ', l_partkey % 40, ':3') END"
    rows = fx.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS position", f"{ref} AS ref")
    return quotes.by_chapter(rows).select("position", "chapter", "first")


@query("mth2_values", """SELECT p_partkey, greatest(10, least(40, p_size))::INT AS clamped, greatest(1, floor(p_retailprice / 400 - 2 + 0.5))::BIGINT AS whole FROM part""")
def mth2_values(spark: SparkSession, d: str) -> DataFrame:
    """MTH2: bounds, and whole numbers of one at least."""
    clamped = values.clamped(F.col("p_size"), F.lit(10), F.lit(40))
    return fx.table(spark, d, "part").select("p_partkey", clamped.alias("clamped"), values.whole_part(F.col("p_retailprice") / 400 - 2).alias("whole"))


@query("dat1_times", """SELECT event_id, floor(event_id * 777 / 1000.0)::BIGINT AS seconds, strftime(ts, '%B %-d, %Y') AS day FROM events""")
def dat1_times(spark: SparkSession, d: str) -> DataFrame:
    """DAT1: whole seconds, and days in words."""
    return fx.table(spark, d, "events").select("event_id", values.seconds(F.col("event_id") * 777).alias("seconds"), values.long_date(F.col("ts")).alias("day"))
