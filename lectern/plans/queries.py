"""Queries over the driver's tables, one or more for each family of operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.citation import book_citation, video_citation
from lectern.functions.text import html_text, safe_name, split_authors, tag_name, tokens, word_count
from lectern.operators import catalog, ranges, reconcile, search, validation
from lectern.plans import fixtures as fx
from lectern.plans import parts, scans, texts, upkeep  # noqa: F401  (their queries are put down as well)
from lectern.plans.bm25 import PREFIXES, SHOWN
from lectern.plans.bm25 import bm25 as _bm25
from lectern.plans.registry import ORACLES, QUERIES, query  # noqa: F401

def _found(hits: DataFrame) -> DataFrame:
    return hits.select("key", "kind", "book_id", F.round("rank", 9).alias("rank"))


@query("fts_search_all", _bm25())
def fts_search_all(spark: SparkSession, d: str) -> DataFrame:
    """FTS1-FTS4, FTS6: folded prefixes, all of them, best 200 by BM25."""
    return _found(search.search(fx.search_index(spark, d), " ".join(PREFIXES), digits=SHOWN))


@query("fts_search_kind", _bm25("kind = 'note'"))
def fts_search_kind(spark: SparkSession, d: str) -> DataFrame:
    """FTS7: the scope is applied after ranking, so ranks are those of the whole index."""
    return _found(search.search(fx.search_index(spark, d), " ".join(PREFIXES), F.col("kind") == "note", digits=SHOWN))


@query("fts_search_shelf", _bm25("kind = 'page' AND book_id IN (SELECT source FROM documents WHERE lang = 'es' GROUP BY source HAVING count(*) > 3)"))
def fts_search_shelf(spark: SparkSession, d: str) -> DataFrame:
    """FTS8, JN4: pages of the books of a shelf, by a semi join."""
    index = fx.search_index(spark, d)
    shelf = fx.table(spark, d, "documents").where("lang = 'es'").groupBy(F.col("source").alias("book_id")).count().where("count > 3")
    return _found(search.search(index, " ".join(PREFIXES), F.col("kind") == "page", books=shelf, digits=SHOWN))


@query("fts_search_items", _bm25("(kind = 'page' AND book_id IN ('src0', 'src1', 'src3', 'src5', 'src8')) OR (kind = 'note' AND key IN ('c1-0', 'c2-1', 'c4-0'))"))
def fts_search_items(spark: SparkSession, d: str) -> DataFrame:
    """FTS9, SET5: any of some books and notes."""
    scope = search.item_scope(["src0", "src1", "src3", "src5", "src8"], ["c1-0", "c2-1", "c4-0"])
    return _found(search.search(fx.search_index(spark, d), " ".join(PREFIXES), scope, digits=SHOWN))


@query("fts_search_empty_scope", _bm25("false"))
def fts_search_empty_scope(spark: SparkSession, d: str) -> DataFrame:
    """FTS9: an empty set of items gives no rows."""
    return _found(search.search(fx.search_index(spark, d), " ".join(PREFIXES), search.item_scope(), digits=SHOWN))


@query("fts_groups", f"WITH h AS ({_bm25()}) SELECT CASE WHEN kind IN ('page', 'quote') THEN book_id ELSE 'notes' END AS bucket, count(*) AS n FROM h GROUP BY 1")
def fts_groups(spark: SparkSession, d: str) -> DataFrame:
    """FTS11: hits by book, notes together."""
    return search.grouped_hits(search.search(fx.search_index(spark, d), " ".join(PREFIXES), digits=SHOWN)).select("bucket", "n")


@query("fts_index_terms", f"""WITH {fx.SEARCH_DOCS}, u AS (SELECT key, unnest(regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM s)
SELECT term, count(DISTINCT key) AS docs, count(*) AS total FROM u GROUP BY term""")
def fts_index_terms(spark: SparkSession, d: str) -> DataFrame:
    """FTS2: the vocabulary with its counts."""
    postings = search.build_index(fx.search_docs(spark, d)).postings
    return postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total"))


@query("jn6_covering", f"""WITH {fx.EXCERPTS}, {fx.POINTS}
SELECT point_id, excerpt_id, source FROM points p JOIN excerpts e ON p.book = e.book AND NOT e.flagged
AND (e.cs, e.vs) <= (p.chapter, p.verse) AND (p.chapter, p.verse) <= (e.ce, e.ve)""")
def jn6_covering(spark: SparkSession, d: str) -> DataFrame:
    """JN6: the excerpts whose range holds each point."""
    return ranges.covering(fx.points(spark, d), fx.excerpts(spark, d)).select("point_id", "excerpt_id", "source")


@query("jn7_sections", f"""WITH {fx.EXCERPTS}, {fx.POINTS}
SELECT point_id, excerpt_id FROM points p JOIN excerpts e ON p.book = e.book AND p.chapter BETWEEN e.cs AND e.ce""")
def jn7_sections(spark: SparkSession, d: str) -> DataFrame:
    """JN7: excerpts whose sections hold each ordinal."""
    p = fx.points(spark, d).selectExpr("point_id", "book AS document", "chapter AS ordinal")
    e = fx.excerpts(spark, d).selectExpr("excerpt_id", "book AS document", "cs AS first", "ce AS last")
    return ranges.covering_sections(p, e).select("point_id", "excerpt_id")


@query("agg14_by_source", f"""WITH {fx.EXCERPTS}, {fx.POINTS}
SELECT point_id, source, count(*) AS n FROM points p JOIN excerpts e ON p.book = e.book AND NOT e.flagged
AND (e.cs, e.vs) <= (p.chapter, p.verse) AND (p.chapter, p.verse) <= (e.ce, e.ve) GROUP BY ALL""")
def agg14_by_source(spark: SparkSession, d: str) -> DataFrame:
    """AGG14: matches by source."""
    found = ranges.covering_counts(fx.points(spark, d), fx.excerpts(spark, d), "source")
    return found.groupBy("point_id", "source").agg(F.sum("n").alias("n"))


@query("ref3_labels", f"WITH {fx.EXCERPTS} SELECT excerpt_id, 'B' || book || ' ' || cs || ':' || vs || CASE WHEN ve = vs THEN '' ELSE '-' || ve END AS label, ve AS verse_end FROM excerpts")
def ref3_labels(spark: SparkSession, d: str) -> DataFrame:
    """REF3, REF6: references written, and read again."""
    e = fx.excerpts(spark, d)
    label = ranges.reference(F.concat(F.lit("B"), "book"), F.col("cs"), F.col("vs"), F.col("ve"))
    return e.select("excerpt_id", label.alias("label")).select("*", ranges.parse_reference(F.col("label"))["verse_end"].alias("verse_end"))


@query("agg2_shelf_counts", "SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL")
def agg2_shelf_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG2, JN3: members of each shelf, also none."""
    members = fx.table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return catalog.member_counts(fx.table(spark, d, "nation").select("n_nationkey", "n_name"), members, "n_nationkey")


@query("jn16_values", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority))::VARCHAR AS tags FROM orders GROUP BY 1")
def jn16_values(spark: SparkSession, d: str) -> DataFrame:
    """JN1, JN16: each book's tags as one sorted list."""
    found = catalog.values_by(fx.table(spark, d, "orders"), "o_custkey", "o_orderpriority")
    return found.select("o_custkey", F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]")).alias("tags"))


@query("agg10_groups", f"WITH {fx.BOOKS} SELECT coalesce(publisher, 'No publisher') AS bucket, count(*) AS n, min(year) AS first_year FROM books GROUP BY 1")
def agg10_groups(spark: SparkSession, d: str) -> DataFrame:
    """AGG10: books by a group with a default."""
    rows = catalog.in_groups(fx.books(spark, d), F.array_compact(F.array("publisher")), "No publisher")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("year").alias("first_year"))


@query("agg10_series_order", f"""WITH {fx.BOOKS} SELECT book_id, row_number() OVER (PARTITION BY series ORDER BY TRY_CAST(series_number AS DOUBLE) NULLS LAST, title, book_id) AS n FROM books""")
def agg10_series_order(spark: SparkSession, d: str) -> DataFrame:
    """AGG10, SRT6: place in a series, numbered books first."""
    from pyspark.sql import Window

    rows = fx.books(spark, d)
    order = Window.partitionBy("series").orderBy(*catalog.by_series(rows, "series_number", "title"), "book_id")
    return rows.select("book_id", F.row_number().over(order).alias("n"))


@query("agg20_bibliography", f"""WITH {fx.BOOKS}, {fx.QUOTES}, c AS (SELECT book_id, count(*) AS quotes FROM quotes GROUP BY 1)
SELECT book_id, quotes, string_split(author, ' ')[-1] || CASE WHEN contains(author, ' ') THEN ', ' || array_to_string(string_split(author, ' ')[:-2], ' ') ELSE '' END
 || '. *' || trim(title) || '*. ' || CASE WHEN year < 1900 THEN '[city]: ' ELSE '' END || coalesce(publisher, '[publisher]') || ', ' || year || '.' AS entry FROM books JOIN c USING (book_id)""")
def agg20_bibliography(spark: SparkSession, d: str) -> DataFrame:
    """AGG20, JN5, CIT1: an entry and the number of quotes of each book that is quoted."""
    cited = catalog.with_citations(fx.books(spark, d), fx.quotes(spark, d))
    none = F.lit(None).cast("string")
    entry = book_citation("bibliography", F.col("title"), split_authors(F.col("author")), F.col("year"), F.col("publisher"), none, none)
    return cited.select("book_id", "quotes", entry.alias("entry"))


@query("cit1_footnotes", f"""WITH {fx.BOOKS}, {fx.QUOTES} SELECT quote_id, author || ', *' || trim(title) || '* (' || CASE WHEN year < 1900 THEN '[city]: ' ELSE '' END
 || coalesce(publisher, '[publisher]') || ', ' || year || ')' || coalesce(', ' || page, '') || '.' AS footnote FROM quotes JOIN books USING (book_id)""")
def cit1_footnotes(spark: SparkSession, d: str) -> DataFrame:
    """CIT1, MTH1: the footnote of every quote."""
    rows = fx.quotes(spark, d).join(fx.books(spark, d), "book_id")
    none = F.lit(None).cast("string")
    return rows.select("quote_id", book_citation("footnote", F.col("title"), split_authors(F.col("author")), F.col("year"), F.col("publisher"), none, F.col("page")).alias("footnote"))


@query("cit1_videos", f"""WITH {fx.BOOKS}, v AS (SELECT *, ', "' || trim(title) || '," video, ' || coalesce(publisher, '[channel]') || ', ' || year || CASE WHEN book_id % 2 = 0 THEN ', v/' || book_id ELSE '' END || '.' AS said,
 regexp_replace(author, '^(.*)\\s+(\\S+)$', '\\2, \\1') AS inverted, regexp_extract(author, '\\S+$') AS family FROM books)
SELECT book_id, author || said AS footnote, inverted || said AS bibliography, '(' || family || ' ' || year || ')' AS author_date FROM v""")
def cit1_videos(spark: SparkSession, d: str) -> DataFrame:
    """CIT1: books cited as videos, some without a channel or an address."""
    url = F.expr("CASE WHEN book_id % 2 = 0 THEN concat('v/', book_id) END")
    cited = lambda s: video_citation(s, F.col("title"), split_authors(F.col("author")), F.col("year"), F.col("publisher"), url)
    return fx.books(spark, d).select("book_id", cited("footnote").alias("footnote"), cited("bibliography").alias("bibliography"), cited("author-date").alias("author_date"))


@query("agg3_by_source", f"WITH {fx.QUOTES} SELECT s_suppkey, s_name, count(*) AS n FROM quotes JOIN supplier ON source_id = s_suppkey GROUP BY ALL")
def agg3_by_source(spark: SparkSession, d: str) -> DataFrame:
    """AGG3, JN8: quotes by source."""
    counts = fx.quotes(spark, d).groupBy("source_id").agg(F.count("*").alias("n"))
    return counts.join(fx.table(spark, d, "supplier"), F.col("source_id") == F.col("s_suppkey")).select("s_suppkey", "s_name", "n")


@query("agg8_by_tag", "SELECT coalesce(tag, 'untagged') AS tag, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE lower(l_returnflag) END AS tag FROM lineitem) GROUP BY 1")
def agg8_by_tag(spark: SparkSession, d: str) -> DataFrame:
    """AGG8, STR8: quotes by tag, and those without."""
    rows = fx.table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit(" #"), "l_returnflag")).alias("tag"))
    rows = catalog.in_groups(rows, F.array_compact(F.array(tag_name(F.col("tag")))), "untagged")
    return rows.groupBy(F.col("bucket").alias("tag")).agg(F.count("*").alias("n"))


@query("srt2_quote_order", f"WITH {fx.QUOTES} SELECT quote_id, row_number() OVER (PARTITION BY book_id ORDER BY page NULLS LAST, created, quote_id) AS n FROM quotes")
def srt2_quote_order(spark: SparkSession, d: str) -> DataFrame:
    """SRT2, QTE3: a book's quotes by page, those without last."""
    from pyspark.sql import Window

    order = Window.partitionBy("book_id").orderBy(F.col("page").asc_nulls_last(), "created", "quote_id")
    return fx.quotes(spark, d).select("quote_id", F.row_number().over(order).alias("n"))


@query("agg17_first_per_key", f"WITH {fx.FILES} SELECT name, min(event_id) AS event_id FROM files GROUP BY name")
def agg17_first_per_key(spark: SparkSession, d: str) -> DataFrame:
    """AGG17: the first file of each name."""
    return catalog.first_per_key(fx.files(spark, d), ["name"], [F.col("event_id").asc()]).select("name", "event_id")


@query("flt1_book_match", f"WITH {fx.BOOKS} SELECT book_id FROM books WHERE contains(lower(concat_ws(' ', title, author, series, series_number)), 'brand#1') AND contains(lower(concat_ws(' ', title, author, series, series_number)), '1')")
def flt1_book_match(spark: SparkSession, d: str) -> DataFrame:
    """FLT1: every term of the query is somewhere in a book's fields."""
    hay = F.lower(F.concat_ws(" ", "title", "author", "series", "series_number"))
    terms = F.split(F.lit("brand#1 1"), " ")
    return fx.books(spark, d).where(F.forall(terms, lambda t: F.contains(hay, t))).select("book_id")


@query("val1_validation", f"""WITH {fx.EXCERPTS},
k AS (SELECT *, lag(book) OVER w AS pb, lag(cs * 1000 + vs) OVER w AS pk FROM excerpts WINDOW w AS (PARTITION BY source ORDER BY excerpt_id)),
m AS (SELECT source, median(words) AS middle FROM excerpts GROUP BY 1),
v AS (SELECT excerpt_id, coalesce(pb = book AND cs * 1000 + vs < pk, false) AS out_of_sequence, coalesce(cs <= 30 AND vs > 20 + cs % 10, false) AS out_of_bounds,
      words < 20 OR words > 10 * middle AS odd_size FROM k JOIN m USING (source))
SELECT *, out_of_sequence OR out_of_bounds AS flagged, CASE WHEN odd_size THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM v""")
def val1_validation(spark: SparkSession, d: str) -> DataFrame:
    """VAL1, WIN1, AGG12, MAP1: sequence, bounds and size."""
    verses = spark.range(66).crossJoin(spark.range(1, 31).withColumnRenamed("id", "c")).selectExpr("cast(id AS int) AS book", "cast(c AS int) AS chapter", "cast(20 + c % 10 AS int) AS last")
    rows = fx.excerpts(spark, d).drop("flagged").selectExpr("*", "cs AS chapter", "vs AS verse")
    found = validation.validated(rows, verses, "source", "excerpt_id")
    return found.select("excerpt_id", "out_of_sequence", "out_of_bounds", "odd_size", "flagged", "confidence")


@query("agg13_coverage", f"""WITH {fx.EXCERPTS}, e AS (SELECT book, cs * 3 AS cs, ce * 3 AS ce, flagged FROM excerpts),
b AS (SELECT book, count(*) AS total, count(*) FILTER (flagged) AS flagged, least(min(cs), min(ce)) AS lo, greatest(max(cs), max(ce)) AS hi FROM e GROUP BY book),
s AS (SELECT book, unnest(range(lo, hi + 1)) AS c FROM b),
x AS (SELECT s.book, count(*) AS missing FROM s ANTI JOIN (SELECT book, cs AS c FROM e UNION SELECT book, ce FROM e) t ON s.book = t.book AND s.c = t.c GROUP BY 1)
SELECT book, total, flagged, coalesce(missing, 0) AS missing FROM b LEFT JOIN x USING (book)""")
def agg13_coverage(spark: SparkSession, d: str) -> DataFrame:
    """AGG13: chapters that nothing touches. Chapters are every third one here, so that some are missing."""
    found = validation.coverage(fx.excerpts(spark, d).selectExpr("book", "cs * 3 AS cs", "ce * 3 AS ce", "flagged"))
    return found.select("book", "total", "flagged", "missing")


_CORRECTIONS = "CASE doc_id % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reassign' ELSE 'discard' END"


@query("jn10_corrections", f"""WITH r AS (SELECT doc_id, sha256(source || chr(10) || text) AS hash, doc_id % 2 = 0 AS flagged, (doc_id % 7)::INT AS book, 1 AS cs FROM documents),
c AS (SELECT hash, arg_max({_CORRECTIONS}, doc_id) AS action, max(doc_id) AS k FROM r WHERE doc_id % 5 = 0 GROUP BY hash)
SELECT doc_id, flagged AND coalesce(action, '') NOT IN ('confirm', 'reassign') AS flagged, CASE WHEN action = 'reassign' THEN 99 ELSE book END AS book,
 CASE WHEN action = 'reassign' THEN coalesce(CASE WHEN k % 2 = 0 THEN 5 END, cs) ELSE cs END AS cs FROM r LEFT JOIN c USING (hash) WHERE coalesce(action, '') <> 'discard'""")
def jn10_corrections(spark: SparkSession, d: str) -> DataFrame:
    """JN10, STR15, VAL2: the last correction of a text's hash wins; a moved excerpt stands where it was moved to."""
    rows = fx.table(spark, d, "documents").select("doc_id", validation.content_hash(F.col("source"), F.col("text")).alias("hash"), (F.col("doc_id") % 2 == 0).alias("flagged"), (F.col("doc_id") % 7).cast("int").alias("book"), F.lit(1).alias("cs"))
    corrections = rows.where("doc_id % 5 = 0").selectExpr("hash", f"{_CORRECTIONS} AS action", "doc_id AS position", "99 AS book", "CASE WHEN doc_id % 2 = 0 THEN 5 END AS cs")
    return validation.corrected(rows, corrections).select("doc_id", "flagged", "book", "cs")


@query("val2_orphans", """WITH r AS (SELECT sha256(source || chr(10) || text) AS hash FROM documents)
SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(source || chr(10) || 'gone ' || doc_id) ELSE sha256(source || chr(10) || text) END AS hash FROM documents) WHERE hash NOT IN (SELECT hash FROM r WHERE hash IS NOT NULL) OR hash IS NULL""")
def val2_orphans(spark: SparkSession, d: str) -> DataFrame:
    """VAL2: corrections whose text is no longer there."""
    docs = fx.table(spark, d, "documents")
    rows = docs.select(validation.content_hash(F.col("source"), F.col("text")).alias("hash"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("gone "), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return validation.orphans(rows, docs.select("doc_id", validation.content_hash(F.col("source"), text).alias("hash"))).select("doc_id")


@query("win5_runs", """WITH a AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT event_id, sum(CASE WHEN k > 1 AND p IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM a""")
def win5_runs(spark: SparkSession, d: str) -> DataFrame:
    """WIN5: stretches of equal values."""
    return validation.runs(fx.table(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id", "run")


@query("win2_carried", """SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS book FROM events""")
def win2_carried(spark: SparkSession, d: str) -> DataFrame:
    """WIN2, WIN4, WIN6: the last heading carries on."""
    rows = fx.table(spark, d, "events").selectExpr("user_id", "event_id", "CASE WHEN event_id % 4 = 0 THEN event_type END AS book")
    return validation.carried(rows, "user_id", "event_id", "book").select("event_id", "book")


@query("jn13_backlinks", f"WITH {fx.NOTES} SELECT DISTINCT n_name AS title, note FROM links JOIN nation ON lower(target) = lower(n_name)")
def jn13_backlinks(spark: SparkSession, d: str) -> DataFrame:
    """JN13, STR14: notes that link to a title."""
    titles = fx.table(spark, d, "nation").select(F.col("n_name").alias("title"))
    return reconcile.backlinks(reconcile.note_links(fx.notes(spark, d)), titles)


@query("jn14_broken_links", f"WITH {fx.NOTES} SELECT note, min(target) AS target FROM links WHERE lower(target) NOT IN (SELECT lower(n_name) FROM nation) GROUP BY note, lower(target)")
def jn14_broken_links(spark: SparkSession, d: str) -> DataFrame:
    """JN14, SET3: links that lead nowhere."""
    titles = fx.table(spark, d, "nation").select(F.col("n_name").alias("title"))
    return reconcile.broken_links(reconcile.note_links(fx.notes(spark, d)), titles)


@query("set2_new_files", f"""WITH {fx.FILES}, k AS (SELECT * FROM files WHERE size < 40 AND event_id % 7 < 2 AND name < 'f3')
SELECT event_id FROM files WHERE NOT (size < 40 AND event_id % 7 < 2 AND name < 'f3') AND name NOT IN (SELECT name FROM k) AND size NOT IN (SELECT size FROM k)""")
def set2_new_files(spark: SparkSession, d: str) -> DataFrame:
    """SET2, SYN1: files that match neither by name nor by size. Some of the small ones are in the catalogue."""
    f, known = fx.files(spark, d), "size < 40 AND event_id % 7 < 2 AND name < 'f3'"
    return reconcile.new_files(f.where(f"NOT ({known})"), f.where(known)).select("event_id")


@query("syn6_reindex", f"""WITH {fx.FILES}, h AS (SELECT path, max(mtime) AS mtime FROM files GROUP BY path),
c AS (SELECT path, min(mtime) AS mtime, CASE WHEN count(*) % 2 = 0 THEN 'indexed' ELSE 'unindexed' END AS status FROM files WHERE event_id % 3 > 0 GROUP BY path)
SELECT h.path, h.mtime FROM h LEFT JOIN c USING (path) WHERE h.mtime IS DISTINCT FROM c.mtime OR c.status IS DISTINCT FROM 'indexed'""")
def syn6_reindex(spark: SparkSession, d: str) -> DataFrame:
    """SYN6: changed files, and those never indexed."""
    f = fx.files(spark, d)
    here = f.groupBy("path").agg(F.max("mtime").alias("mtime"))
    cache = f.where("event_id % 3 > 0").groupBy("path").agg(F.min("mtime").alias("mtime"), F.when(F.count("*") % 2 == 0, "indexed").otherwise("unindexed").alias("status"))
    return reconcile.to_index(here, cache).select("path", "mtime")


@query("snk18_mirror", f"""WITH {fx.FILES}, a AS (SELECT path, max(mtime) AS m FROM files WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT path, max(mtime) AS m FROM files WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.m IS NULL OR a.m > b.m + 1 THEN 'push' WHEN a.m IS NULL OR b.m > a.m + 1 THEN 'pull' ELSE 'none' END AS action FROM a FULL JOIN b ON a.path = b.path""")
def snk18_mirror(spark: SparkSession, d: str) -> DataFrame:
    """SNK18: which way each file is copied."""
    f = fx.files(spark, d)
    side = lambda k: f.where(F.col("event_id") % 2 == k).groupBy("path").agg(F.max("mtime").alias("mtime"))
    return reconcile.mirror_actions(side(0), side(1))


@query("snk2_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def snk2_upsert(spark: SparkSession, d: str) -> DataFrame:
    """SNK2, SNK7: new rows in the place of old ones, and beside them."""
    old = fx.table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment AS v")
    third = old.where("c_custkey % 3 = 0")
    return catalog.upsert(old, third.selectExpr("c_custkey", "'new' AS v").union(third.selectExpr("-c_custkey", "'new'")), ["c_custkey"])


@query("snk9_patch", "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'patched' ELSE c_name END AS c_name FROM customer")
def snk9_patch(spark: SparkSession, d: str) -> DataFrame:
    """SNK8, SNK9: only what the patch has a value for changes."""
    rows = fx.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    patch = rows.where("c_custkey % 4 = 0").selectExpr("c_custkey", "CASE WHEN c_custkey % 8 <> 0 THEN 'patched' END AS c_name")
    return catalog.patched(rows, patch, "c_custkey")


@query("snk10_cascade", "SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 7 <> 0")
def snk10_cascade(spark: SparkSession, d: str) -> DataFrame:
    """SNK10: deleted with one parent, kept without the other."""
    rows = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    left = catalog.cascade(rows, rows.where("o_orderkey % 7 = 0"), "o_orderkey")
    return catalog.cascade(left, fx.table(spark, d, "customer").where("c_custkey % 10 = 0").selectExpr("c_custkey AS o_custkey"), "o_custkey", keep=True)


_WORDS = "CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"


@query("str7_word_count", f"SELECT doc_id, {_WORDS}::INT AS n FROM documents")
def str7_word_count(spark: SparkSession, d: str) -> DataFrame:
    """STR7: words of a text."""
    return fx.table(spark, d, "documents").select("doc_id", word_count(F.col("text")).alias("n"))


@query("str1_safe_names", """SELECT l_orderkey, l_linenumber, left(trim(regexp_replace(regexp_replace(l_shipdate::VARCHAR || ' a/b: "' || l_returnflag || '"?', '[:/\\\\?*"<>|]', '-', 'g'), '\\s+', ' ', 'g')), 180) AS name FROM lineitem""")
def str1_safe_names(spark: SparkSession, d: str) -> DataFrame:
    """STR1: names that a file can have."""
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    raw = F.concat(stamp, F.lit(' a/b: "'), "l_returnflag", F.lit('"?'))
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", safe_name(raw).alias("name"))


_TEXT = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\\b.*?</script|style\\b.*?</style)>', ' ', 'g'), '(?i)<br\\s*/?>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_a}', '{_b}')"


@query("str16_html_text", f"SELECT page_id, trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g')) AS text FROM pages")
def str16_html_text(spark: SparkSession, d: str) -> DataFrame:
    """STR16, STR17: the text of a page."""
    return fx.table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query("fts14_tokens", "SELECT doc_id, len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS n FROM documents")
def fts14_tokens(spark: SparkSession, d: str) -> DataFrame:
    """FTS2, FTS14: folded tokens of each document."""
    return fx.table(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query("fts10_used_in", f"""WITH h AS ({_bm25()}) SELECT key, CASE WHEN kind = 'quote' THEN coalesce(n, 0) ELSE 0 END::INT AS used FROM h
LEFT JOIN (SELECT 'b' || item_id AS key, CASE WHEN item_id % 3 = 1 THEN NULL ELSE item_id % 3 END AS n FROM benchmark) USING (key)""")
def fts10_used_in(spark: SparkSession, d: str) -> DataFrame:
    """FTS10, JN2: in how many places each hit is used, none where the list is malformed."""
    used = F.expr("CASE item_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '{broken' ELSE '[\"a\",\"b\"]' END")
    q = fx.table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("key"), F.from_json(used, "array<string>").alias("used_in"))
    hits = search.search(fx.search_index(spark, d), " ".join(PREFIXES), digits=SHOWN).join(q, "key", "left")
    count = F.coalesce(F.when(F.col("used_in").isNotNull(), F.size("used_in")), F.lit(0))
    return hits.select("key", F.when(F.col("kind") == "quote", count).otherwise(0).alias("used"))


@query("jn11_name_match", """WITH n AS (SELECT p_partkey AS id, lower(regexp_replace(p_type || p_name, '[^A-Za-z0-9]+', '', 'g')) AS key FROM part WHERE p_partkey % 2 = 0),
p AS (SELECT p_partkey AS position, 'f' || p_partkey AS file, left(lower(regexp_replace(p_type || p_name, '[^A-Za-z0-9]+', '', 'g')), CASE WHEN p_partkey % 3 = 0 THEN 26 ELSE 99 END) AS key FROM part WHERE p_partkey % 4 <> 0),
e AS (SELECT id, arg_min(file, position) AS file FROM n JOIN p USING (key) GROUP BY id),
s AS (SELECT n.id, p.file, row_number() OVER (PARTITION BY n.id ORDER BY least(length(n.key), length(p.key)) DESC, position) AS k FROM n ANTI JOIN e USING (id) JOIN p ON length(n.key) >= 24 AND length(p.key) >= 24 AND (starts_with(n.key, p.key) OR starts_with(p.key, n.key)))
SELECT id, file FROM e UNION ALL SELECT id, file FROM s WHERE k = 1""")
def jn11_name_match(spark: SparkSession, d: str) -> DataFrame:
    """JN11, STR5: the same name, or the longest that one begins the other with."""
    key = "lower(regexp_replace(concat(p_type, p_name), '[^A-Za-z0-9]+', ''))"
    part = fx.table(spark, d, "part")
    names = part.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", f"{key} AS key")
    cut = f"left({key}, CASE WHEN p_partkey % 3 = 0 THEN 26 ELSE 99 END)"
    primary = part.where("p_partkey % 4 <> 0").selectExpr("p_partkey AS position", "concat('f', p_partkey) AS file", f"{cut} AS key")
    return reconcile.matched_names(names, primary)


@query("jn12_by_size", f"WITH {fx.FILES} SELECT c_custkey AS id, file FROM customer JOIN (SELECT size, arg_min(path, event_id) AS file FROM files GROUP BY size) f ON f.size = c_custkey % 150")
def jn12_by_size(spark: SparkSession, d: str) -> DataFrame:
    """JN12: the first file of the same size."""
    missing = fx.table(spark, d, "customer").selectExpr("c_custkey AS id", "cast(c_custkey % 150 AS int) AS size")
    return reconcile.adopted_by_size(missing, fx.files(spark, d).selectExpr("path AS file", "size", "event_id AS position"))


@query("agg4_by_document", """WITH q AS (SELECT (o_custkey % 150)::INT AS source, CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE o_orderpriority || ':' || o_orderkey END AS ref FROM orders),
n AS (SELECT s_suppkey::INT AS source, s_name AS name FROM supplier UNION ALL SELECT 100 + n_nationkey, n_name FROM nation)
SELECT q.source, coalesce(min(name), 'Unknown source') AS name, split_part(ref, ':', 1) AS document, count(DISTINCT ref) AS n FROM q LEFT JOIN n ON q.source = n.source WHERE strpos(ref, ':') > 1 GROUP BY q.source, document""")
def agg4_by_document(spark: SparkSession, d: str) -> DataFrame:
    """AGG4, JN9, SET1: quotes by source and document, named from either table."""
    ref = "CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE concat(o_orderpriority, ':', o_orderkey) END AS ref"
    q = fx.table(spark, d, "orders").selectExpr("cast(o_custkey % 150 AS int) AS source", ref)
    a = fx.table(spark, d, "supplier").selectExpr("cast(s_suppkey AS int) AS source", "s_name AS name")
    b = fx.table(spark, d, "nation").selectExpr("100 + n_nationkey AS source", "n_name AS name")
    return catalog.by_document(q, a, b)


@query("agg23_filled", f"WITH {fx.BOOKS}, f AS (SELECT lower(series) AS k, arg_min(publisher, book_id) AS p FROM books WHERE trim(coalesce(publisher, '')) <> '' GROUP BY 1) SELECT book_id, coalesce(publisher, p) AS publisher FROM books LEFT JOIN f ON lower(series) = k")
def agg23_filled(spark: SparkSession, d: str) -> DataFrame:
    """AGG23: a blank is filled from the first of the same series."""
    return catalog.filled(fx.books(spark, d), "series", "publisher", F.col("book_id")).select("book_id", "publisher")


@query("win8_nearby_edges", """WITH e AS (SELECT event_id AS page, user_id % 5 AS book, regexp_replace(event_type || user_id % 3 * 7, '[0-9]+', '#', 'g') AS edge FROM events)
SELECT book, page FROM (SELECT book, page, count(*) OVER (PARTITION BY book, edge ORDER BY page RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) - 1 AS n FROM e) WHERE n >= 3""")
def win8_nearby_edges(spark: SparkSession, d: str) -> DataFrame:
    """WIN8, STR25: edges that come again on the pages around; here within 20, as these pages lie far apart."""
    rows = fx.table(spark, d, "events").selectExpr("event_id AS page", "user_id % 5 AS book", "concat(event_type, user_id % 3 * 7) AS edge")
    return validation.nearby_edges(rows, around=20)


@query("win13_sampled", """WITH a AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
b AS (SELECT event_id, k - floor(n * 0.1::DOUBLE)::BIGINT AS k, greatest(1, floor((n - floor(n * 0.1::DOUBLE)) / 40))::BIGINT AS step FROM a)
SELECT event_id FROM b WHERE k >= 0 AND k % step = 0 AND k // step < 40""")
def win13_sampled(spark: SparkSession, d: str) -> DataFrame:
    """WIN13: at most 40 evenly spaced pages behind the first tenth."""
    return validation.evenly_sampled(fx.table(spark, d, "events"), "event_type", "event_id").select("event_id")


@query("snk19_reordered", "SELECT n_nationkey, CASE n_nationkey WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE n_regionkey END AS sort_order FROM nation")
def snk19_reordered(spark: SparkSession, d: str) -> DataFrame:
    """SNK19: a list's order becomes sort_order."""
    return catalog.reordered(fx.table(spark, d, "nation").selectExpr("n_nationkey", "n_regionkey AS sort_order"), [7, 3, 5], "n_nationkey")


@query("snk20_appended", "SELECT n_name AS name, n_nationkey AS sort_order FROM nation UNION ALL SELECT r_name, ((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name))::INT FROM region")
def snk20_appended(spark: SparkSession, d: str) -> DataFrame:
    """SNK20, AGG16: new rows go behind the last."""
    old = fx.table(spark, d, "nation").selectExpr("n_name AS name", "n_nationkey AS sort_order")
    return catalog.appended(old, fx.table(spark, d, "region").selectExpr("r_name AS name"))


@query("agg9_tag_counts", "SELECT lower(role) AS tag, count(*) AS n FROM conversations GROUP BY 1")
def agg9_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG9, AGG11: notes by tag."""
    return fx.table(spark, d, "conversations").groupBy(tag_name(F.concat(F.lit("#"), "role")).alias("tag")).agg(F.count("*").alias("n"))


@query("agg22_passages", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def agg22_passages(spark: SparkSession, d: str) -> DataFrame:
    """AGG22: verses joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = fx.table(spark, d, "conversations").groupBy("conv_id").agg(parts.alias("parts"))
    return rows.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))
