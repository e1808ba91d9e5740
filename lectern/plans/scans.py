"""Queries over scanned books and over what is scanned along an order, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.references import Book
from lectern.operators import catalog, quotes, validation
from lectern.plans import fixtures as fx
from lectern.plans.registry import query
from lectern.session import shared_folder
from lectern.sources import epub, providers, scanned
from lectern.streaming import runs

CANON = [Book("JAS", "James", 5, ("Jas",)), Book("ROM", "Romans", 16, ("Rom",))]
#: A header in each shape, by a line's number n; a source is set in the shape of its own number.
_HEADERS = (
    "concat('James ', n % 5 + 1, ':', n % 25 + 1)", "concat('(', n % 9 + 1, ':', n % 25 + 1, ')')", "concat('Chap. ', CASE n % 3 WHEN 0 THEN 'iv' WHEN 1 THEN 'ix' ELSE 'ii' END, '. ', n % 25 + 1)",
    "concat('[', n % 25 + 1, '-', n % 25 + 3, '] so')", "concat(n % 25 + 1, ') so')", "concat('Verse ', n % 25 + 1, '.')", "concat('On faith: Verses ', n % 25 + 1)", "concat(n % 25 + 1, '. so')",
)
_SHAPES = " ".join(f"WHEN {k} THEN {h}" for k, h in enumerate(_HEADERS))
#: Every fifth line is a header, every 83rd a chapter's heading; others are text. Half of the sources set headers larger.
_TEXT = f"CASE WHEN n % 83 = 7 THEN concat('Chapter ', CASE n % 4 WHEN 0 THEN 'II' WHEN 1 THEN 'iv.' WHEN 2 THEN 'Vl' ELSE 'LX' END) WHEN n % 5 = 0 THEN CASE k {_SHAPES} END ELSE concat('and so on ', translate(CAST(n AS VARCHAR(20)), '0123456789', 'abcdefghij')) END"
_LINE = {
    "source": "k", "page": "CAST(floor(n / 200) AS int) + 1", "line": "CAST(n AS int)", "text": _TEXT,
    "size": "CASE WHEN n % 5 = 0 AND k % 2 = 0 THEN 12.0 + n % 3 * 0.125 ELSE 10.0 END", "x": "CASE WHEN n % 5 = 0 THEN 72.0 + n % 2 ELSE 50.0 + n % 4 * 0.5 END",
    "multi_font": "n % 5 = 0 AND n % 7 > 1 OR n % 11 = 0",
}


def scanned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of eight scanned books out of events, a book for each user by remainder."""
    events = fx.table(spark, d, "events").selectExpr("event_id AS n", "CAST(user_id % 8 AS int) AS k")
    kinds = {"size": "double", "x": "double"}
    return events.select(*(F.expr(e).cast(kinds[c]).alias(c) if c in kinds else F.expr(e).alias(c) for c, e in _LINE.items()))


LINES = f"""
e AS (SELECT event_id AS n, (user_id % 8)::INT AS k FROM events),
lines AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _LINE.items() if c not in ("size", "x"))}, ({_LINE["size"]})::DOUBLE AS size, ({_LINE["x"]})::DOUBLE AS x FROM e)"""

_DIGITS, _ANY = "[0-9]{1,3}", "(?:[0-9]{1,3}|[lLI|\\]]{1,2})"
_PATTERNS = (
    "^(?:James|Jas|Romans|Rom)\\b\\.?\\s+[0-9]{1,3}", f"^\\(?{_DIGITS}\\s*:\\s*{_DIGITS}", f"^(?i)\\(?(?:chapter|chap\\.?|cap\\.?)?\\s*[ivxlcdm]+\\b[.,]?\\s*(?:verse|verses|vers\\.?|vv?\\.?)?\\s*{_DIGITS}",
    f"^\\[{_ANY}(?:\\s*-\\s*{_ANY})?\\]", f"^{_ANY}(?:\\s*-\\s*{_ANY})?\\)", f"^(?i:verses?|vers\\.?|vv?\\.?)\\s+{_ANY}", f"^[^:\\n]{{1,80}}:\\s*(?i:verses?|vers\\.?|vv?\\.?)\\s+{_ANY}", f"^{_ANY}(?:\\s*-\\s*{_ANY})?\\.",
)
_PROFILES = f"""{LINES},
pages AS (SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page) - 1 AS nth0, count(*) OVER (PARTITION BY source) AS many FROM (SELECT DISTINCT source, page FROM lines)),
skips AS (SELECT *, CASE WHEN many <= 40 THEN 0 ELSE floor(many * 0.1::DOUBLE)::BIGINT END AS skipped FROM pages),
steps AS (SELECT *, greatest(1, (many - skipped) // 40) AS step FROM skips),
sampled AS (SELECT lines.* FROM lines JOIN steps USING (source, page) WHERE nth0 >= skipped AND (nth0 - skipped) % step = 0 AND (nth0 - skipped) // step < 40),
tested AS (SELECT *, [{", ".join(f"regexp_matches(text, '{p}')" for p in _PATTERNS)}] AS fits FROM sampled),
counted AS (SELECT source, nth, count(*) FILTER (fits[nth]) AS headers, count(*) AS lines FROM tested, range(1, 9) r(nth) GROUP BY ALL),
elected AS (SELECT source, arg_max(nth, headers * 100 - nth) AS nth FROM counted WHERE headers >= 3 AND 2 * headers < lines GROUP BY source),
sides AS (SELECT t.*, fits[nth] AS is_header, nth FROM tested t JOIN elected USING (source)),
found AS (SELECT source, list_value({", ".join(f"'{s}'" for s in scanned.ALL_SHAPES)})[any_value(nth)] AS shape, count(*) AS lines, count(*) FILTER (is_header) AS headers,
 median(size) FILTER (is_header) AS header_size, median(size) FILTER (NOT is_header) AS body_size, median(x) FILTER (is_header) AS header_x, median(x) FILTER (NOT is_header) AS body_x,
 avg(multi_font::INT) FILTER (is_header) AS header_fonts, avg(multi_font::INT) FILTER (NOT is_header) AS body_fonts FROM sides GROUP BY source)"""


@query("ing4_profiles", f"WITH {_PROFILES} SELECT * FROM found")
def ing4_profiles(spark: SparkSession, d: str) -> DataFrame:
    """ING4, AGG12, WIN13: how each scanned source sets its headers, by an election of shapes and exact medians."""
    return scanned.profiles(scanned_lines(spark, d), CANON)


@query("srt9_samples", f"""WITH {_PROFILES},
b AS (SELECT *, substr(concat_ws(' ', lead(text, 1) OVER w, lead(text, 2) OVER w), 1, 150) AS after FROM sides WINDOW w AS (PARTITION BY source, page ORDER BY line)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, line) AS k FROM b WHERE is_header)
SELECT source, page, line, text AS header, after FROM r WHERE k <= 10""")
def srt9_samples(spark: SparkSession, d: str) -> DataFrame:
    """SRT9, ING4: the first ten headers of each source's sample and what follows them."""
    lines = scanned_lines(spark, d)
    return scanned.profile_samples(lines, scanned.profiles(lines, CANON), CANON)


_KEPT = """
keyed AS (SELECT *, regexp_replace(trim(text), '[0-9]+', '#', 'g') AS key, row_number() OVER (PARTITION BY source, page ORDER BY line) AS up, row_number() OVER (PARTITION BY source, page ORDER BY line DESC) AS down FROM lines),
edges AS (SELECT source, page, any_value(key) FILTER (up = 1) AS top, any_value(key) FILTER (down = 1) AS bottom, count(*) OVER (PARTITION BY source) AS pages FROM keyed GROUP BY source, page),
tops AS (SELECT source, top AS key FROM edges GROUP BY source, top, pages HAVING 2 * count(*) >= pages AND pages >= 3),
bottoms AS (SELECT source, bottom AS key FROM edges WHERE bottom <> top GROUP BY source, bottom, pages HAVING 2 * count(*) >= pages AND pages >= 3),
kept AS (SELECT k.* FROM keyed k LEFT JOIN tops t ON t.source = k.source AND t.key = k.key AND up = 1 LEFT JOIN bottoms b ON b.source = k.source AND b.key = k.key AND down = 1 WHERE t.key IS NULL AND b.key IS NULL)"""


@query("ing4_excerpts", f"""WITH {LINES}, {_KEPT},
c AS (SELECT *, line % 83 = 7 AS is_chapter, line % 5 = 0 AND line % 83 <> 7 AS is_header, CASE WHEN line % 83 = 7 THEN CASE line % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 9 END WHEN source = 1 AND line % 5 = 0 THEN line % 9 + 1
 WHEN source = 2 AND line % 5 = 0 THEN CASE line % 3 WHEN 0 THEN 4 WHEN 1 THEN 9 ELSE 2 END WHEN source = 0 AND line % 5 = 0 THEN line % 5 + 1 END AS n FROM kept),
s AS (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY source ORDER BY page, line) AS chapter FROM c),
h AS (SELECT *, is_header AND chapter IS NOT NULL AS good FROM s),
g AS (SELECT *, sum(good::INT) OVER (PARTITION BY source ORDER BY page, line) AS position FROM h WHERE NOT is_chapter),
t AS (SELECT source, position, string_agg(text, chr(10) ORDER BY page, line) AS text FROM g WHERE NOT good GROUP BY ALL)
SELECT g.source, g.position, page, g.text AS header, CASE g.source WHEN 0 THEN 'JAS' ELSE 'ROM' END AS book, chapter AS cs, line % 25 + 1 AS vs, chapter AS ce, line % 25 + 1 + CASE g.source WHEN 3 THEN 2 ELSE 0 END AS ve, coalesce(t.text, '') AS text
FROM g LEFT JOIN t USING (source, position) WHERE good""")
def ing4_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """ING4, WIN10-WIN12, STR21, REF4: excerpts of scanned books in eight shapes, their chapters carried by the reader."""
    lines = scanned_lines(spark, d)
    books = lines.select("source").distinct().withColumn("first_book", F.lit("ROM"))
    return scanned.excerpts(lines, scanned.profiles(lines, CANON), CANON, books)


@query("win9_scanned_edges", """WITH p AS (SELECT event_type AS source, event_id AS page, CASE WHEN event_id % 7 < 5 THEN 'Page # of ' || event_type ELSE 'ON FAITH' END AS top,
 CASE WHEN event_id % 7 < 3 THEN 'Page # of ' || event_type ELSE 'foot #' END AS bottom FROM events),
n AS (SELECT source, count(*) AS pages FROM p GROUP BY 1),
s AS (SELECT source, 'top' AS edge, top AS key FROM p UNION ALL SELECT source, 'bottom', bottom FROM p WHERE bottom <> top)
SELECT source, edge, key FROM s JOIN n USING (source) GROUP BY source, edge, key, pages HAVING 2 * count(*) >= pages AND pages >= 3""")
def win9_scanned_edges(spark: SparkSession, d: str) -> DataFrame:
    """WIN9: first and last lines on half of the pages of a source, numbers apart."""
    rows = fx.table(spark, d, "events").selectExpr(
        "event_type AS source", "event_id AS page", "CASE WHEN event_id % 7 < 5 THEN concat('Page ', event_id, ' of ', event_type) ELSE 'ON FAITH' END AS top",
        "CASE WHEN event_id % 7 < 3 THEN concat('Page ', event_id, ' of ', event_type) ELSE concat('foot ', event_id) END AS bottom",
    )
    return scanned.running_lines(rows)


@query("win8_scanned_edges", """WITH p AS (SELECT (user_id % 3)::INT AS source, event_id AS page, CASE WHEN event_id // 20 % 3 = 0 THEN 'a #' WHEN event_id % 5 < 2 THEN 'b #' ELSE 'c' || (event_id % 4 = 1) || ' #' END AS key FROM events)
SELECT source, page, 'top' AS edge FROM (SELECT source, page, count(*) OVER (PARTITION BY source, key ORDER BY page RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) - 1 AS n FROM p) WHERE n >= 3""")
def win8_scanned_edges(spark: SparkSession, d: str) -> DataFrame:
    """WIN8: first lines that at least three of the pages around have too, in buckets of pages."""
    top = "CASE WHEN event_id div 20 % 3 = 0 THEN 'a' WHEN event_id % 5 < 2 THEN 'b' ELSE concat('c', event_id % 4 = 1) END"
    rows = fx.table(spark, d, "events").selectExpr("CAST(user_id % 3 AS int) AS source", "event_id AS page", f"concat({top}, ' ', event_id) AS top", "concat('x', uuid()) AS bottom")
    return scanned.recurring_edges(rows).where("edge = 'top'")


@query("agg12_medians", """SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS price, median(l_quantity) AS quantity FROM lineitem GROUP BY ALL""")
def agg12_medians(spark: SparkSession, d: str) -> DataFrame:
    """AGG12: exact medians of few groups that hold all rows, by counting passes."""
    from lectern.operators.scans import joined_by, medians

    rows, keys = fx.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    return joined_by(medians(rows, keys, F.col("l_extendedprice"), "price"), medians(rows, keys, F.col("l_quantity"), "quantity"), keys)


@query("agg13_gaps", f"""WITH {fx.EXCERPTS}, t AS (SELECT DISTINCT book, unnest([cs * 3, ce * 7]) AS c FROM excerpts),
n AS (SELECT book, c, lead(c) OVER (PARTITION BY book ORDER BY c) AS next FROM t) SELECT book, c + 1 AS low, next - 1 AS high FROM n WHERE next > c + 1""")
def agg13_gaps(spark: SparkSession, d: str) -> DataFrame:
    """AGG13: the stretches of chapters that nothing touches."""
    return validation.gaps(fx.excerpts(spark, d).selectExpr("book", "cs * 3 AS cs", "ce * 7 AS ce"))


_ACTION = "CASE excerpt_id % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reassign' ELSE 'discard' END"


@query("val2_finalised", f"""WITH {fx.EXCERPTS}, r AS (SELECT *, 'h' || excerpt_id % 5000 AS hash FROM excerpts),
c AS (SELECT hash, arg_max({_ACTION}, excerpt_id) AS action, arg_max(excerpt_id, excerpt_id) AS position FROM r WHERE excerpt_id % 9 = 0 GROUP BY hash),
f AS (SELECT r.* REPLACE (CASE WHEN action = 'reassign' THEN (position % 66)::INT ELSE book END AS book, CASE WHEN action = 'reassign' AND position % 2 = 0 THEN 3 ELSE cs END AS cs), action
 FROM r LEFT JOIN c USING (hash) WHERE coalesce(action, '') <> 'discard'),
k AS (SELECT *, lag(book) OVER w AS pb, lag(cs * 1000 + vs) OVER w AS pk FROM f WINDOW w AS (PARTITION BY source ORDER BY excerpt_id)),
m AS (SELECT source, median(words) AS middle FROM f GROUP BY 1),
v AS (SELECT excerpt_id, book, cs, action, coalesce(pb = book AND cs * 1000 + vs < pk, false) AS out_of_sequence, coalesce(cs <= 30 AND vs > 20 + cs % 10, false) AS out_of_bounds, words < 20 OR words > 10 * middle AS odd_size
 FROM k JOIN m USING (source))
SELECT excerpt_id, book, cs, out_of_sequence, out_of_bounds, odd_size, (out_of_sequence OR out_of_bounds) AND coalesce(action, '') NOT IN ('confirm', 'reassign') AS flagged, CASE WHEN odd_size THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM v""")
def val2_finalised(spark: SparkSession, d: str) -> DataFrame:
    """VAL2: an index as it is kept: corrected, validated where its rows now are, and unflagged where a user has settled it."""
    rows = fx.excerpts(spark, d).drop("flagged").withColumn("hash", F.expr("concat('h', excerpt_id % 5000)"))
    corrections = rows.where("excerpt_id % 9 = 0").selectExpr("hash", f"{_ACTION} AS action", "excerpt_id AS position", "CAST(excerpt_id % 66 AS int) AS book", "CASE WHEN excerpt_id % 2 = 0 THEN 3 END AS cs")
    verses = spark.range(66).crossJoin(spark.range(1, 31).withColumnRenamed("id", "c")).selectExpr("cast(id AS int) AS book", "cast(c AS int) AS chapter", "cast(20 + c % 10 AS int) AS last")
    found = validation.finalised(rows, corrections, verses, "source", "excerpt_id")
    return found.select("excerpt_id", "book", "cs", "out_of_sequence", "out_of_bounds", "odd_size", "flagged", "confidence")


@query("snk7_ignored", """SELECT o_custkey AS id, max(o_orderkey)::BIGINT AS value FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1
UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1""")
def snk7_ignored(spark: SparkSession, d: str) -> DataFrame:
    """SNK7: rows of keys that are there are ignored; of several new ones of a key the first stays."""
    rows = fx.table(spark, d, "orders").selectExpr("o_custkey AS id", "o_orderkey AS value")
    old = rows.where("value % 2 = 0").groupBy("id").agg(F.max("value").alias("value"))
    return catalog.insert_or_ignore(old, rows.where("value % 2 = 1"), ["id"], F.col("value"))


@query("snk7_replaced", """SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1""")
def snk7_replaced(spark: SparkSession, d: str) -> DataFrame:
    """SNK7: the latest row of a key takes the place of what was there."""
    rows = fx.table(spark, d, "orders").selectExpr("o_custkey AS id", "o_orderkey AS at", "o_orderpriority AS value")
    old = rows.where("at % 3 = 0").groupBy("id").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return catalog.replaced(old, rows, ["id"], F.col("at")).select("id", "value")


_KIND = "CASE l_linenumber WHEN 1 THEN 'book' WHEN 2 THEN 'scripture' WHEN 3 THEN 'commentary' WHEN 4 THEN 'confession' WHEN 5 THEN 'confession commentary' ELSE 'other' END"
_NEW = {
    "quote_id": "concat(l_orderkey, '-', l_linenumber)", "kind": _KIND, "text": "concat('text ', l_partkey)", "color": "CASE WHEN l_quantity > 25 THEN l_returnflag END", "created": "l_shipdate", "book_id": "l_partkey",
    "page": "l_suppkey", "source_id": "l_partkey % 9", "translation": "'BSB'", "book": "CASE WHEN l_suppkey % 2 = 0 THEN 'JHN' ELSE 'ROM' END", "chapter": "CAST(l_partkey % 21 + 1 AS int)", "verse": "CAST(l_orderkey % 30 + 1 AS int)",
    "verse_end": "CAST(CASE l_orderkey % 4 WHEN 0 THEN l_orderkey % 30 + 1 WHEN 1 THEN l_orderkey % 30 + 4 WHEN 2 THEN 0 END AS int)", "document": "CASE WHEN l_suppkey % 2 = 0 THEN 'AC' ELSE 'SC' END", "ordinal": "CAST(l_partkey % 28 + 1 AS int)",
    "section_number": "'IV'", "section_label": "'Of Faith'", "paragraph": "CAST(CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey % 7 END AS int)",
}
NEW_QUOTES = f"""
new AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _NEW.items())} FROM lineitem),
made AS (SELECT quote_id, kind, text, coalesce(color, 'amber') AS color, created, CASE kind WHEN 'book' THEN book_id END AS book_id, CASE kind WHEN 'book' THEN page END AS page,
 CASE WHEN kind NOT IN ('book', 'scripture') THEN source_id END AS source_id, CASE kind WHEN 'scripture' THEN translation END AS translation,
 CASE WHEN kind IN ('scripture', 'commentary') THEN book || ' ' || chapter || ':' || verse || CASE WHEN verse_end > 0 AND verse_end <> verse THEN '-' || verse_end ELSE '' END
  WHEN kind LIKE 'confession%' THEN document || ':' || ordinal END AS ref,
 CASE WHEN kind LIKE 'confession%' THEN section_number END AS section_number, CASE WHEN kind LIKE 'confession%' THEN section_label END AS section_label, CASE WHEN kind LIKE 'confession%' THEN paragraph END AS paragraph
 FROM new WHERE kind <> 'other')"""


def new_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of every kind out of lineitem, made."""
    return quotes.made(fx.table(spark, d, "lineitem").select(*(F.expr(e).alias(c) for c, e in _NEW.items())))


@query("qte2_made", f"WITH {NEW_QUOTES} SELECT * FROM made")
def qte2_made(spark: SparkSession, d: str) -> DataFrame:
    """QTE2: new quotes of books, scripture, commentaries, confessions and commentaries on these."""
    return new_quotes(spark, d)


@query("qte3_of_source", f"""WITH {NEW_QUOTES} SELECT quote_id, row_number() OVER (PARTITION BY source_id ORDER BY regexp_extract(ref, '\\s(\\d+):', 1)::INT, regexp_extract(ref, ':(\\d+)', 1)::INT, created, quote_id)::INT AS n
FROM made WHERE kind = 'commentary'""")
def qte3_of_source(spark: SparkSession, d: str) -> DataFrame:
    """QTE3, SRT4: a commentary's quotes in order of place and time."""
    rows = new_quotes(spark, d).where("kind = 'commentary'")
    return quotes.listed(rows, ["source_id"], *quotes.place_in_ref(), F.col("created"), F.col("quote_id")).select("quote_id", "n")


@query("qte3_of_document", f"""WITH {NEW_QUOTES} SELECT quote_id, row_number() OVER (PARTITION BY source_id ORDER BY split_part(ref, ':', 2)::INT, coalesce(paragraph, 0), created, quote_id)::INT AS n
FROM made WHERE kind = 'confession' AND ref LIKE 'AC:%'""")
def qte3_of_document(spark: SparkSession, d: str) -> DataFrame:
    """QTE3, SRT5: a confession's quotes by section, paragraph and time."""
    rows = quotes.of_document(new_quotes(spark, d).where("kind = 'confession'"), "AC")
    order = (F.substring_index("ref", ":", -1).cast("int"), F.coalesce("paragraph", F.lit(0)), F.col("created"), F.col("quote_id"))
    return quotes.listed(rows, ["source_id"], *order).select("quote_id", "n")


@query("qte3_highlights", f"""WITH {NEW_QUOTES} SELECT quote_id, regexp_extract(ref, ':(\\d+)', 1)::INT AS verse, coalesce(nullif(regexp_extract(ref, '-(\\d+)$', 1), ''), regexp_extract(ref, ':(\\d+)', 1))::INT AS verse_end, color
FROM made WHERE kind = 'scripture' AND ref LIKE 'JHN 3:%'""")
def qte3_highlights(spark: SparkSession, d: str) -> DataFrame:
    """QTE3: what a chapter's quotes mark."""
    return quotes.highlights(new_quotes(spark, d).where("kind = 'scripture'"), "JHN", 3)


@query("qte3_all", f"WITH {NEW_QUOTES} SELECT quote_id, row_number() OVER (ORDER BY created, quote_id)::INT AS n FROM made")
def qte3_all(spark: SparkSession, d: str) -> DataFrame:
    """QTE3: all quotes in order of time."""
    return quotes.listed(new_quotes(spark, d), [], F.col("created"), F.col("quote_id")).select("quote_id", "n")


_EDITS = {
    "quote_id": "concat(l_orderkey, '-', 1 + l_partkey % 5)", "position": "(l_orderkey * 10 + l_linenumber) * 10000000 + CAST(round(l_extendedprice) AS bigint)",
    "what": "CASE WHEN l_linenumber = 7 THEN 'delete' WHEN l_linenumber % 3 = 0 THEN 'text' WHEN l_linenumber % 3 = 1 THEN 'annotations' ELSE 'citation' END",
    "value": "CASE WHEN l_suppkey % 3 = 0 THEN ' ' WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat(' v', l_suppkey, ' ') END",
}


@query("qte5_edited", f"""WITH {NEW_QUOTES}, q AS (SELECT quote_id, text, 'old' AS annotations, 'own' AS citation_override FROM made),
e AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _EDITS.items())} FROM lineitem),
g AS (SELECT quote_id, min(position) AS gone FROM e WHERE what = 'delete' GROUP BY 1),
u AS (SELECT e.* FROM e LEFT JOIN g USING (quote_id) WHERE gone IS NULL OR position <= gone),
r AS (SELECT *, row_number() OVER (PARTITION BY quote_id, what ORDER BY position DESC) AS k FROM u),
l AS (SELECT quote_id, max(CASE what WHEN 'text' THEN 1 END) AS t, max(CASE what WHEN 'annotations' THEN 1 END) AS a, max(CASE what WHEN 'citation' THEN 1 END) AS c, max(CASE what WHEN 'delete' THEN 1 END) AS gone,
 max(CASE what WHEN 'text' THEN value END) AS tv, max(CASE what WHEN 'annotations' THEN value END) AS av, max(CASE what WHEN 'citation' THEN value END) AS cv FROM r WHERE k = 1 GROUP BY 1)
SELECT quote_id, CASE WHEN t = 1 THEN tv ELSE text END AS text, CASE WHEN a = 1 THEN av ELSE annotations END AS annotations, CASE WHEN c = 1 THEN nullif(trim(cv), '') ELSE citation_override END AS citation_override
FROM q LEFT JOIN l USING (quote_id) WHERE gone IS NULL""")
def qte5_edited(spark: SparkSession, d: str) -> DataFrame:
    """QTE5: texts, remarks and citations of quotes as they were edited last, without deleted ones."""
    rows = new_quotes(spark, d).select("quote_id", "text", F.lit("old").alias("annotations"), F.lit("own").alias("citation_override"))
    return quotes.edited(rows, fx.table(spark, d, "lineitem").select(*(F.expr(e).alias(c) for c, e in _EDITS.items())))


_REGISTRY = [
    {"edition": "BSB", "provider": "free-use", "provider_id": "0"}, {"edition": "NASB", "provider": "api-bible", "provider_id": "1"}, {"edition": "ESV", "provider": "esv", "provider_id": "2"},
    {"edition": "OLD", "provider": "gone", "provider_id": "0"},
]


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    folder = shared_folder(spark)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder}/lectern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored_chapters(spark: SparkSession, d: str) -> str:
    """Where documents are stored as chapters that three providers answered."""
    answer = """CASE doc_id % 3 WHEN 0 THEN to_json(struct(struct(array(named_struct('type', 'heading', 'number', 9, 'content', array('no')), named_struct('type', 'verse', 'number', 1, 'content', array(source)),
      named_struct('type', 'verse', 'number', 2, 'content', array(lang, CAST(n_chars AS string)))) AS content) AS chapter))
      WHEN 1 THEN to_json(struct(struct(concat('before [1] ', source, ' [2]  ', lang, '\\n', n_chars) AS content) AS data)) WHEN 2 THEN to_json(struct(array(concat('[1] ', source), concat('[2] ', lang, ' ', n_chars, ' [3] ')) AS passages)) END"""
    books = "CASE doc_id % 5 WHEN 0 THEN 'GEN' WHEN 1 THEN 'JHN' ELSE 'ROM' END"
    path = _folder(spark, "answers")
    providers.write_answers(fx.table(spark, d, "documents").selectExpr("CAST(doc_id % 3 AS string) AS provider_id", f"{books} AS book", "CAST(doc_id AS int) AS chapter", f"{answer} AS answer"), path)
    return path


@query("src8_chapters", """WITH v AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'BSB' WHEN 1 THEN 'NASB' ELSE 'ESV' END AS edition, CASE doc_id % 5 WHEN 0 THEN 'GEN' WHEN 1 THEN 'JHN' ELSE 'ROM' END AS book, doc_id::INT AS chapter,
 unnest([1, 2]) AS verse, unnest([source, lang || ' ' || n_chars]) AS text FROM documents)
SELECT * FROM v WHERE edition IN ('BSB', 'ESV') AND book = 'ROM' OR edition = 'NASB' AND book = 'JHN'""")
def src8_chapters(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, SRC11: verses of stored answers of three providers; only the books that are asked for are read."""
    path = stored_chapters(spark, d)
    some = providers.read_chapters(spark, path, _REGISTRY, editions=["BSB", "ESV"], books=["ROM"])
    other = providers.read_chapters(spark, path, _REGISTRY, editions=["NASB", "OLD"], books=["JHN"])
    return providers.chapter_verses(some).unionByName(providers.chapter_verses(other))


@query("src14_epub_chapters", """SELECT CASE WHEN page_id % 7 = 0 THEN 'large' ELSE 'b' || page_id % 7 END AS book, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id)::INT - 1 AS position, 'p' || page_id || '.xhtml' AS name, html FROM pages""")
def src14_epub_chapters(spark: SparkSession, d: str) -> DataFrame:
    """SRC14: chapters of EPUBs, written from pages, by a data source; runs of a large archive's members are read apart."""
    path = _folder(spark, "epubs")
    pages = fx.table(spark, d, "pages").selectExpr("CASE WHEN page_id % 7 = 0 THEN 'large' ELSE concat('b', page_id % 7) END AS book", "page_id", "concat('p', page_id, '.xhtml') AS name", "html")
    epub.write_epubs(pages, path, "page_id")
    providers.register(spark)
    rows = spark.read.format("epub_chapters").option("path", path).option("together", 1 << 16).option("run", 16).load()
    return rows.select(F.regexp_extract("path", "([^/]*)\\.epub\\z", 1).alias("book"), "position", "name", "html")


@query("snk1_merged", """WITH v AS (SELECT doc_id, source, lang, n_chars, text, doc_id % 3 AS last, source IN ('src1', 'src4') AS lost FROM documents)
SELECT 'd' || doc_id AS key, coalesce(list_aggregate([1 FOR x IN regexp_extract_all(strip_accents(lower(CASE last WHEN 1 THEN lang || ' again ' || n_chars ELSE source || ' ' || lang END)), '[\\p{L}\\p{N}]+')], 'sum'), 0)::BIGINT AS terms
FROM v WHERE last <> 2 AND (NOT lost OR last = 1)""")
def snk1_merged(spark: SparkSession, d: str) -> DataFrame:
    """SNK1-SNK3: an index in runs: rows, then newer rows and removals by key and by book, merged and read again."""
    docs, path = fx.table(spark, d, "documents"), _folder(spark, "runs")
    row = lambda content, version, removed: F.struct(
        F.concat(F.lit("d"), "doc_id").alias("key"), F.lit("page").alias("kind"), F.col("source").alias("book_id"), content.alias("content"),
        F.lit(version).alias("version"), F.lit(removed).alias("removed"), F.lit(None).cast("string").alias("ref"),
    )
    first = docs.select(row(F.concat_ws(" ", "source", "lang"), 1, False).alias("r")).select("r.*")
    newer = docs.where("doc_id % 3 = 1").select(row(F.concat_ws(" ", "lang", F.lit("again"), F.col("n_chars").cast("string")), 3, False).alias("r")).select("r.*")
    gone = docs.where("doc_id % 3 = 2").select(row(F.lit(None).cast("string"), 2, True).alias("r")).select("r.*")
    books = docs.where("source IN ('src1', 'src4')").select(row(F.lit(None).cast("string"), 2, True).alias("r")).select("r.*").withColumn("key", F.lit(None).cast("string")).distinct()
    late = first.where("book_id = 'src4'")  # an old version that comes again stays out
    for n, changes in enumerate((newer, first, gone.unionByName(books), late)):
        runs.put_changes(changes, path, f"r{n}")
    runs.merged(spark, path)
    index = runs.read_changes(spark, path)
    counts = index.postings.groupBy("key").agg(F.sum("tf").alias("terms"))
    return index.docs.select("key").join(counts, "key", "left").select("key", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))
