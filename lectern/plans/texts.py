"""Queries over texts and quotes: references, notes, names, chapters, layout and imports, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import citation, headers, names, notes, references
from lectern.functions.references import Book
from lectern.operators import catalog, normalise, quotes, reconcile, search, validation
from lectern.plans import fixtures as fx
from lectern.plans.registry import query
from lectern.session import spread
from lectern.sources import epub, layout, markdown, passages

CANON = [
    Book("AUT", "AUTOMOBILE", 30, ("Auto", "Aut")), Book("BUI", "BUILDING", 40, ("Build",)),
    Book("FUR", "FURNITURE", 20, ("Furn",)), Book("HOU", "HOUSEHOLD", 1, ("House",), ("The HOUSEHOLD",)),
    Book("MAC", "MACHINERY", 50, ("Mach", "1 Mach")),
]
_CODES = "CASE {0} WHEN 'AUTOMOBILE' THEN 'AUT' WHEN 'BUILDING' THEN 'BUI' WHEN 'FURNITURE' THEN 'FUR' WHEN 'HOUSEHOLD' THEN 'HOU' ELSE 'MAC' END"
_CHAPTERS = "CASE {0} WHEN 'AUTOMOBILE' THEN 30 WHEN 'BUILDING' THEN 40 WHEN 'FURNITURE' THEN 20 WHEN 'HOUSEHOLD' THEN 1 ELSE 50 END"
_SEG = "c_mktsegment"


@query("ref1_references", f"""WITH t AS (SELECT c_custkey, {_CODES.format(_SEG)} AS book, {_CHAPTERS.format(_SEG)} AS most, 1 + c_custkey % 55 AS ch,
 'Ü ' || {_SEG} || ' ' || (1 + c_custkey % 55) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ':' || (c_custkey % 9) || CASE WHEN c_custkey % 2 = 0 THEN ' – 12' ELSE '' END END AS a, c_custkey % 9 AS v FROM customer)
SELECT c_custkey, 2 AS at, substr(a, 3) AS raw, book, ch::INT AS chapter, CASE WHEN c_custkey % 3 > 0 THEN v::INT END AS verse,
 CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 12 ELSE v::INT END END AS verse_end FROM t WHERE ch <= most
UNION ALL SELECT c_custkey, length(a) + 7, '1 Mach. 7', 'MAC', 7, NULL, NULL FROM t""")
def ref1_references(spark: SparkSession, d: str) -> DataFrame:
    """REF1: references in free text, with their places; chapters beyond a book and words in lower case are none."""
    text = f"""concat('Ü ', {_SEG}, ' ', 1 + c_custkey % 55, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(':', c_custkey % 9, CASE WHEN c_custkey % 2 = 0 THEN ' – 12' ELSE '' END) END,
        ', also 1 Mach. 7, not ', lower({_SEG}), ' 3 or xAuto 1')"""
    rows = fx.table(spark, d, "customer").selectExpr("c_custkey", f"{text} AS text")
    found = rows.select("c_custkey", F.explode(references.find_references(F.col("text"), CANON)).alias("r"))
    return found.select("c_custkey", "r.at", "r.raw", "r.book", "r.chapter", "r.verse", "r.verse_end")


@query("ref2_parsed", f"SELECT c_custkey, {_CODES.format(_SEG)} AS book, (c_custkey % 30)::INT AS chapter FROM customer WHERE c_custkey % 30 BETWEEN 1 AND {_CHAPTERS.format(_SEG)} AND c_custkey % 4 > 0")
def ref2_parsed(spark: SparkSession, d: str) -> DataFrame:
    """REF2, REF4: one reference in any case; a longer text is none."""
    text = F.expr(f"concat(' ', lower({_SEG}), '. ', c_custkey % 30, CASE WHEN c_custkey % 4 = 0 THEN ' x' ELSE ' ' END)")
    found = fx.table(spark, d, "customer").select("c_custkey", references.parse_reference(text, CANON).alias("r"))
    return found.where("r is not null").select("c_custkey", "r.book", "r.chapter")


@query("ref9_trailing", f"""SELECT c_custkey, {_CODES.format(_SEG)} AS book, CASE WHEN c_custkey % 2 = 0 THEN (1 + c_custkey % 7)::INT ELSE 1 END AS chapter, (c_custkey % 9)::INT AS verse, (c_custkey % 9 + 2)::INT AS verse_end
FROM customer WHERE c_custkey % 2 = 0 OR {_SEG} = 'HOUSEHOLD'""")
def ref9_trailing(spark: SparkSession, d: str) -> DataFrame:
    """REF9: the reference that a heading ends with; books of one chapter may go without it."""
    text = F.expr(f"concat('TRUE WISDOM ', lower({_SEG}), ' ', CASE WHEN c_custkey % 2 = 0 THEN concat(1 + c_custkey % 7, '.') ELSE '' END, c_custkey % 9, '—', c_custkey % 9 + 2)")
    found = fx.table(spark, d, "customer").select("c_custkey", references.trailing_reference(text, CANON).alias("r"))
    return found.where("r is not null").select("c_custkey", "r.*")


#: Chapters 1 to 30 of books under 60 have 20 + c % 10 verses.
_MOST = "CASE WHEN {0} BETWEEN 1 AND 30 AND book < 60 THEN 20 + {0} % 10 ELSE 0 END"


@query("val3_within_chapters", f"""WITH {fx.EXCERPTS}, r AS (SELECT excerpt_id AS position, book, cs, vs % 33 + 1 AS vs, cs AS ce, CASE WHEN excerpt_id % 2 = 0 THEN vs % 33 + 1 ELSE vs % 33 + 2 END AS ve FROM excerpts),
m AS (SELECT *, {_MOST.format("cs")} AS most, {_MOST.format("(cs - 1)")} AS prior, row_number() OVER (PARTITION BY book, cs, vs, ve ORDER BY position) AS nth,
 EXISTS (SELECT 1 FROM r o WHERE o.book = r.book AND o.cs = r.cs - 1 AND o.vs = r.vs AND o.ve = r.ve) AS taken FROM r),
f AS (SELECT *, CASE WHEN book >= 60 OR (vs <= most AND ve <= most) THEN 'none' WHEN most > 0 AND vs <= most THEN 'clamp' WHEN most > 0 AND vs = most + 1 AND ve <= most + 1 THEN 'merge'
 WHEN vs <= prior AND ve <= prior AND NOT taken AND nth = 1 THEN 'relabel' ELSE 'drop' END AS fix FROM m),
g AS (SELECT position, book, CASE WHEN fix = 'relabel' THEN cs - 1 ELSE cs END AS cs, CASE WHEN fix = 'merge' THEN most ELSE vs END AS vs, CASE WHEN fix IN ('merge', 'clamp') THEN most ELSE ve END AS ve, fix FROM f WHERE fix <> 'drop')
SELECT *, row_number() OVER (PARTITION BY book ORDER BY cs, vs, ve DESC, position)::INT AS n FROM g""")
def val3_within_chapters(spark: SparkSession, d: str) -> DataFrame:
    """VAL3, SRT8: verses beyond a chapter are clamped, merged, moved to the chapter before or dropped; then reading order."""
    rows = fx.excerpts(spark, d).selectExpr("excerpt_id AS position", "book", "cs", "vs % 33 + 1 AS vs", "cs AS ce", "CASE WHEN excerpt_id % 2 = 0 THEN vs % 33 + 1 ELSE vs % 33 + 2 END AS ve")
    verses = spark.range(60).crossJoin(spark.range(1, 31).withColumnRenamed("id", "c")).selectExpr("cast(id AS int) AS book", "cast(c AS int) AS chapter", "cast(20 + c % 10 AS int) AS last")
    n = F.row_number().over(Window.partitionBy("book").orderBy(*normalise.reading_order()))
    return normalise.within_chapters(rows, verses).withColumn("n", n).drop("ce")


@query("win10_section_headings", """WITH RECURSIVE h AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id // 90 + event_id % 3 END AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT event_id, user_id, k, c IS NOT NULL AS opens, c AS last FROM h WHERE k = 1
 UNION ALL SELECT h.event_id, h.user_id, h.k, coalesce(h.c >= s.last AND h.c <= s.last + 1, h.c IS NOT NULL AND s.last IS NULL), CASE WHEN coalesce(h.c >= s.last AND h.c <= s.last + 1, h.c IS NOT NULL AND s.last IS NULL) THEN h.c ELSE s.last END
 FROM s JOIN h ON h.user_id = s.user_id AND h.k = s.k + 1)
SELECT event_id, opens FROM s""")
def win10_section_headings(spark: SparkSession, d: str) -> DataFrame:
    """WIN10: headings of a chapter that is neither the last one nor the next are citations."""
    rows = fx.table(spark, d, "events").selectExpr("event_id", "user_id", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id div 90 + event_id % 3 END AS chapter")
    return normalise.section_headings(rows, ["user_id"], "event_id").select("event_id", "opens")


@query("ing2_sections", """SELECT n_name AS path, r_name AS document, o AS ordinal, CASE o WHEN 1 THEN 'I' END AS number, CASE o WHEN 1 THEN 'Of ' || n_name ELSE 'Two' END AS label,
 CASE o WHEN 1 THEN 'Part' END AS part, CASE o WHEN 1 THEN 'first' || chr(10) || chr(10) || 'second' ELSE '' END AS text FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (1), (2)) v(o)""")
def ing2_sections(spark: SparkSession, d: str) -> DataFrame:
    """ING2, WIN4: sections of confessions from piped headings; other headings close them."""
    region = fx.table(spark, d, "region")
    files = fx.table(spark, d, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "n_name AS path",
        r"concat('lost\n#  ', lower(r_name), ' \r\nintro\n## 1 | I | Of ', n_name, ' | Part\r\nfirst\n\nsecond\n\n## stray\nlost\n### 2 || Two\n## 0 | x | bad\nlost\n# None\n## 3 | I | Gone\nlost') AS text",
    )
    documents = region.selectExpr("r_name AS name", "r_name AS code")
    return markdown.sections(files, documents).select("path", "document", "ordinal", "number", "label", "part", "text")


@query("src10_marked_verses", "SELECT o_orderkey AS key, 1 AS verse, o_orderpriority || ' ' || o_orderstatus AS text FROM orders UNION ALL SELECT o_orderkey, 12, 'key ' || o_orderkey FROM orders")
def src10_marked_verses(spark: SparkSession, d: str) -> DataFrame:
    """SRC10: verses of a text with '[n]' before each; blank ones go."""
    rows = fx.table(spark, d, "orders").selectExpr("o_orderkey AS key", r"concat('before [1]  ', o_orderpriority, '\n ', o_orderstatus, ' [2]   [12] key ', o_orderkey) AS answer")
    return passages.marked_verses(rows)


@query("str26_paragraphs", "SELECT o_orderkey AS key, 0 AS position, NULL::INT AS paragraph, o_orderpriority || ' ' AS text FROM orders UNION ALL SELECT o_orderkey, 1, 7, 'key ' || o_orderkey FROM orders")
def str26_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """STR26: paragraphs of a section by their markers; what comes before the first has none."""
    return passages.paragraphs(fx.table(spark, d, "orders").selectExpr("o_orderkey AS key", "concat(o_orderpriority, ' [3]  [7] key ', o_orderkey) AS text"))


@query("src8_json_verses", "SELECT c_custkey AS key, (c_custkey % 40)::INT AS verse, c_name || ' said ' || c_mktsegment AS text FROM customer WHERE c_custkey % 10 <> 3")
def src8_json_verses(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, SRC9: verses of a provider's JSON, of texts and objects; headings, blanks and malformed answers go."""
    answer = r"""concat('{"chapter":{"content":[{"type":"heading","content":["H"]},{"type":"verse","number":', c_custkey % 40, ',"content":["', c_name, '",{"text":" said "},{"noteId":1},"', c_mktsegment, '"]},
        {"type":"verse","number":9,"content":[" "]},{"type":"verse","content":["no number"]}]}', CASE WHEN c_custkey % 10 = 3 THEN '' ELSE '}' END)"""
    return passages.json_verses(fx.table(spark, d, "customer").selectExpr("c_custkey AS key", f"{answer} AS answer"))


@query("src13_recordings", "SELECT n_nationkey, 0 AS position, 'hays' AS reader, 'Hays' AS label, 'h' || n_name AS url FROM nation UNION ALL SELECT n_nationkey, 1, 'anna', 'Anna', n_name FROM nation UNION ALL SELECT n_nationkey, 2, 'zoe', 'Zoe', n_name FROM nation")
def src13_recordings(spark: SparkSession, d: str) -> DataFrame:
    """SRC13: recordings by known readers first, then by name."""
    links = F.expr("map('zoe', n_name, 'anna', n_name, 'souer', '', 'hays', concat('h', n_name))")
    rows = fx.table(spark, d, "nation").select("n_nationkey", F.posexplode(passages.recordings(links)).alias("position", "r"))
    return rows.select("n_nationkey", "position", "r.*")


@query("src12_editions", """SELECT w.id, arg_min(p_name, p_partkey) AS provider_id FROM part JOIN (VALUES ('a', '#1[0-9]'), ('b', '^Brand#2'), ('c', 'absent')) w(id, pattern)
 ON regexp_matches(p_name, pattern) OR regexp_matches(p_brand, pattern) GROUP BY w.id""")
def src12_editions(spark: SparkSession, d: str) -> DataFrame:
    """SRC12: the first edition of a catalogue that matches what is wanted by any of its names."""
    wanted = spark.createDataFrame([("a", "#1[0-9]"), ("b", "^Brand#2"), ("c", "absent")], "id string, pattern string")
    catalogue = fx.table(spark, d, "part").selectExpr("p_partkey AS position", "p_name AS provider_id", "array(p_name, p_brand) AS names")
    return passages.resolved_editions(wanted, catalogue)


@query("src11_read_through", "SELECT o_orderkey, o_custkey AS k, CASE WHEN o_custkey % 3 = 0 THEN 'cached' ELSE 'fetched' END AS v FROM orders")
def src11_read_through(spark: SparkSession, d: str) -> DataFrame:
    """SRC11: the cache first, and what it hasn't is fetched once for each key."""
    asked = fx.table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS k")
    cache = fx.table(spark, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS k", "'cached' AS v")
    answers, _ = passages.read_through(asked, cache, ["k"], lambda m: m.withColumn("v", F.lit("fetched")), lambda m: m)
    return answers


_QUOTES = f"SELECT c_custkey AS quote_id, c_nationkey AS n, CASE WHEN c_custkey % 5 = 0 THEN 'JHN' ELSE 'ROM' END || ' ' || (c_custkey % 12) || ':' || (c_custkey % 7) AS ref, -c_custkey AS created FROM customer"


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "customer").selectExpr(
        "c_custkey AS quote_id", "c_nationkey AS n", "concat(CASE WHEN c_custkey % 5 = 0 THEN 'JHN' ELSE 'ROM' END, ' ', c_custkey % 12, ':', c_custkey % 7) AS ref", "-c_custkey AS created"
    )


@query("qte1_viewed", f"""WITH q AS ({_QUOTES}), t AS (SELECT o_custkey AS quote_id, list_sort(list(DISTINCT o_orderpriority)) AS tags FROM orders GROUP BY 1)
SELECT q.quote_id, coalesce(array_to_string(tags, ','), '') AS tags, CASE WHEN q.quote_id % 4 = 0 THEN 'own' WHEN q.quote_id % 3 = 0 THEN 'book' WHEN q.quote_id % 2 = 0 THEN 'source' ELSE '' END AS citation,
 CASE WHEN q.quote_id % 6 = 0 THEN 2 WHEN q.quote_id % 6 = 1 THEN 1 ELSE 0 END AS remarks, (q.quote_id % 12)::INT AS chapter FROM q LEFT JOIN t USING (quote_id)""")
def qte1_viewed(spark: SparkSession, d: str) -> DataFrame:
    """QTE1, CIT3, JSN1: quotes with tags, remarks and citation: the own one, else the book's, else the source's."""
    stored = """CASE quote_id % 6 WHEN 0 THEN '[{"text":"a"},{"text":"b"}]' WHEN 1 THEN 'not { json' WHEN 2 THEN '{"text":"a"}' WHEN 3 THEN '' WHEN 4 THEN '[]' END"""
    q = _quotes(spark, d).selectExpr("*", "CASE WHEN quote_id % 4 = 0 THEN ' own' WHEN quote_id % 4 = 1 THEN ' ' END AS citation_override", f"{stored} AS annotations")
    tags = fx.table(spark, d, "orders").selectExpr("o_custkey AS quote_id", "o_orderpriority AS tag")
    book = q.where("quote_id % 3 = 0").selectExpr("quote_id", "'book' AS citation")
    source = q.where("quote_id % 2 = 0").selectExpr("quote_id", "'source' AS citation")
    rows = quotes.viewed(q, tags, [book, source])
    return rows.select("quote_id", F.array_join("tags", ",").alias("tags"), "citation", F.size("annotations").alias("remarks"), "place.chapter")


@query("qte3_by_place", f"WITH q AS ({_QUOTES}) SELECT quote_id, row_number() OVER (ORDER BY quote_id % 12, quote_id % 7, created)::INT AS n FROM q WHERE ref LIKE 'JHN %'")
def qte3_by_place(spark: SparkSession, d: str) -> DataFrame:
    """QTE3, FLT6, SRT4: a book's quotes in order of place and time."""
    rows = quotes.of_book(_quotes(spark, d), "jhn")
    return quotes.listed(rows, [], *quotes.place_in_ref(), F.col("created"), F.col("quote_id")).select("quote_id", "n")


@query("qte3_by_section", """SELECT o_orderkey AS quote_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 20, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 END, o_orderdate, o_orderkey)::INT AS n
FROM orders WHERE o_orderstatus = 'O'""")
def qte3_by_section(spark: SparkSession, d: str) -> DataFrame:
    """QTE2, QTE3, SRT5: a document's quotes by section, paragraph and time."""
    rows = fx.table(spark, d, "orders").selectExpr("o_orderkey AS quote_id", "o_custkey", "CASE o_orderstatus WHEN 'O' THEN 'SC' ELSE 'LC' END AS document", "o_orderkey % 20 AS ordinal", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END AS paragraph", "o_orderdate AS created")
    rows = quotes.of_document(quotes.section_quotes(rows), "SC")
    return rows.select("quote_id", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*quotes.by_section(), "quote_id")).alias("n"))


@query("qte4_groups", """WITH q AS (SELECT CASE WHEN l_linenumber = 1 THEN l_partkey END AS b, CASE WHEN l_linenumber IN (2, 3) THEN l_suppkey END AS s,
 CASE l_linenumber WHEN 3 THEN 'AC:' || l_partkey WHEN 4 THEN 'ROM ' || l_partkey || ':1' WHEN 5 THEN 'nothing' END AS ref FROM lineitem),
k AS (SELECT CASE WHEN b IS NOT NULL THEN 'book' WHEN s IS NOT NULL AND ref IS NULL THEN 'commentary' WHEN ref LIKE 'AC:%' THEN 'document' WHEN ref LIKE 'ROM %' THEN 'scripture' END AS kind, b, s FROM q)
SELECT kind, CASE kind WHEN 'book' THEN b::VARCHAR WHEN 'commentary' THEN s::VARCHAR WHEN 'document' THEN 'AC' ELSE 'ROM' END AS name, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def qte4_groups(spark: SparkSession, d: str) -> DataFrame:
    """QTE4: quotes by book, commentary, document and book of scripture."""
    rows = fx.table(spark, d, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 1 THEN l_partkey END AS book_id", "CASE WHEN l_linenumber IN (2, 3) THEN l_suppkey END AS source_id",
        "CASE l_linenumber WHEN 3 THEN concat('AC:', l_partkey) WHEN 4 THEN concat('ROM ', l_partkey, ':1') WHEN 5 THEN 'nothing' END AS ref",
    )
    return quotes.groups(rows.withColumn("ref", F.coalesce("ref", F.lit(""))))


@query("qte5_tags_set", "SELECT DISTINCT o_custkey AS quote_id, o_orderpriority AS tag FROM orders WHERE o_custkey % 4 <> 0 UNION ALL SELECT c_custkey, lower(c_mktsegment) FROM customer WHERE c_custkey % 4 = 0")
def qte5_tags_set(spark: SparkSession, d: str) -> DataFrame:
    """QTE5: a quote's new tags in the place of the old ones."""
    old = fx.table(spark, d, "orders").selectExpr("o_custkey AS quote_id", "o_orderpriority AS tag").distinct()
    edits = fx.table(spark, d, "customer").where("c_custkey % 4 = 0").selectExpr("c_custkey AS quote_id", "array(concat(' #', c_mktsegment), lower(c_mktsegment), '#') AS tags")
    return quotes.tags_set(old, edits)


@query("snk11_quote_counts", "SELECT p_partkey AS book_id, count(l_orderkey) AS quote_count FROM part LEFT JOIN lineitem ON p_partkey = l_partkey * 2 GROUP BY 1")
def snk11_quote_counts(spark: SparkSession, d: str) -> DataFrame:
    """SNK11, FLT10: how many quotes each book has, counted anew."""
    q = fx.table(spark, d, "lineitem").selectExpr("l_partkey * 2 AS book_id")
    return quotes.quote_counts(fx.table(spark, d, "part").selectExpr("p_partkey AS book_id", "-1 AS quote_count"), q)


@query("snk12_quote_blocks", """WITH n AS (SELECT n_nationkey AS k, '<!-- quote:' || n_nationkey || ' -->' || chr(10) || '> ' || n_name || chr(10) || '> b' || chr(10) || '>' || chr(10) || '> — cited' || chr(10) || chr(10) || 'said' || chr(10) || '<!-- /quote:' || n_nationkey || ' -->' AS block FROM nation)
SELECT k, '# N' || chr(10) || chr(10) || block || chr(10) AS added, '# N' || chr(10) || chr(10) || block || chr(10) AS again, NULL::VARCHAR AS removed, '# N' || chr(10) || chr(10) || block || chr(10) AS other FROM n""")
def snk12_quote_blocks(spark: SparkSession, d: str) -> DataFrame:
    """SNK12: a quote's block put into a note, put in again, taken out again (nothing is left then), and another taken out."""
    text, said = F.concat("n_name", F.lit("\r\n\nb")), F.array(F.lit(" "), F.lit("said "))
    key = F.col("k")
    block = notes.quote_block(key, text, F.lit("cited"), said)
    rows = fx.table(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("string")).withColumn("block", block)
    rows = rows.withColumn("added", notes.with_block(F.lit("# N\n"), key, F.col("block")))
    old = F.replace("added", F.lit("cited"), F.lit("old"))
    return rows.select("n_nationkey", "added", notes.with_block(old, key, F.col("block")).alias("again"), notes.without_block(F.col("added"), key).alias("removed"), notes.without_block(F.col("added"), F.lit("99")).alias("other")).withColumnRenamed("n_nationkey", "k")


@query("snk13_chapter_notes", """WITH q AS (SELECT c_nationkey AS n, c_custkey % 12 AS c, string_agg('q' || c_custkey, chr(10) || chr(10) ORDER BY c_custkey) AS b FROM customer GROUP BY ALL)
SELECT n, string_agg('## Chapter ' || c || chr(10) || chr(10) || b, chr(10) || chr(10) ORDER BY c) AS note FROM q GROUP BY n""")
def snk13_chapter_notes(spark: SparkSession, d: str) -> DataFrame:
    """SNK13: the blocks of quotes under their chapters."""
    rows = fx.table(spark, d, "customer").selectExpr("c_nationkey AS n", "c_custkey % 12 AS chapter", "c_custkey AS created", "cast(c_custkey AS string) AS quote_id")
    return quotes.chapter_note(rows, F.concat(F.lit("q"), "quote_id"), ["n"])


@query("snk14_front_matter", """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'T ' || n_name WHEN 1 THEN 'H ' || n_name ELSE 'fallback' END AS title, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 'topic' ELSE 'note' END AS type,
 CASE n_nationkey % 3 WHEN 0 THEN 'a|b c' ELSE '' END AS tags, CASE n_nationkey % 3 WHEN 1 THEN '# H ' || n_name || chr(10) || 'text' WHEN 0 THEN 'text' ELSE 'text' END AS body FROM nation""")
def snk14_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """SNK14, STR10-STR13: front matter written and read again."""
    fields = {"title": F.concat(F.lit("T "), "n_name"), "type": F.when(F.col("n_nationkey") % 2 == 0, "topic").otherwise("other"), "tags": F.lit("[a, 'b c', ]")}
    kind = F.col("n_nationkey") % 3
    note = F.when(kind == 0, notes.with_front_matter(F.lit("text"), fields)).when(kind == 1, F.concat(F.lit("# H "), "n_name", F.lit("\ntext"))).otherwise("text")
    rows = fx.table(spark, d, "nation").select("n_nationkey", note.alias("note"))
    c = F.col("note")
    return rows.select("n_nationkey", notes.title(c, F.lit("fallback")).alias("title"), notes.note_type(c).alias("type"), F.array_join(notes.tags(c), "|").alias("tags"), notes.body(c).alias("body"))


@query("snk17_print_text", "SELECT n_nationkey, '# ' || n_name || ' Alias and ' || n_name || ' and (, C#x  #1' AS text FROM nation")
def snk17_print_text(spark: SparkSession, d: str) -> DataFrame:
    """SNK17: a note for print: no front matter, links flat, no tags."""
    note = F.concat(F.lit("---\na: b\n---\n# "), "n_name", F.lit(" [["), "n_name", F.lit("#s| Alias]] and [["), "n_name", F.lit("#s]] and (#tag-x, C#x #tag #1"))
    return fx.table(spark, d, "nation").select("n_nationkey", notes.print_text(note).alias("text"))


@query("str4_file_names", """SELECT p_partkey, 'T-' || p_name AS title, 'A B & C D' AS author, CASE WHEN p_size % 2 = 0 THEN p_brand END AS series, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS series_number,
 'T-' || p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_brand || ' ' || p_size || ')' ELSE '' END || ' - A B & C D' AS base FROM part""")
def str4_file_names(spark: SparkSession, d: str) -> DataFrame:
    """STR2-STR4: title, authors and series of a file's name, and the name that they give."""
    base = F.expr("concat('T-', p_name, CASE WHEN p_size % 2 = 0 THEN concat('__(', p_brand, ' ', p_size, ')') ELSE '' END, ' -  A B and C D')")
    rows = spread(fx.table(spark, d, "part")).select("p_partkey", names.parse_file_name(base).alias("m")).select("p_partkey", "m.*")
    return rows.withColumn("base", names.file_base(F.col("title"), F.col("author"), F.col("series"), F.col("series_number")))


@query("str20_labels", f"SELECT c_custkey, left({_SEG}, 1) || lower(substr({_SEG}, 2)) || ' IV: Don''t' AS label, lower({_SEG}) || ' enchiridion' AS key FROM customer")
def str20_labels(spark: SparkSession, d: str) -> DataFrame:
    """STR20, STR23, STR24: headings in capitals shown in title case, and headings to compare by."""
    label = names.display_label(names.without_article(names.without_marker(F.concat(F.lit("[14] ARTICLE "), _SEG, F.lit(" IV: DON'T")))))
    key = names.heading_key(F.concat(F.lit("«The "), F.lower(_SEG), F.lit(":  [enchiridion]» (1580) ")))
    return fx.table(spark, d, "customer").select("c_custkey", label.alias("label"), key.alias("key"))


_TAGS = "'(?s)<[^>]*>'"


@query("str18_headings", f"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>') AS hs FROM pages), e AS (SELECT page_id, unnest(hs) AS h, unnest(range(len(hs))) AS position FROM h)
SELECT page_id AS key, position::INT AS position, replace(trim(regexp_replace(regexp_replace(h, {_TAGS}, ' ', 'g'), '\\s+', ' ', 'g')), '&amp;', '&') AS heading FROM e""")
def str18_headings(spark: SparkSession, d: str) -> DataFrame:
    """STR17, STR18: the headings of a page."""
    return epub.headings(fx.table(spark, d, "pages").selectExpr("page_id AS key", "html")).select("key", "position", "heading")


@query("str19_trimmed", "SELECT doc_id, 'On ' || source AS text FROM documents")
def str19_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """STR19: excerpts cut at what a publisher puts between them, without a dangling reference."""
    text = F.concat(F.lit("On "), "source", F.when(F.col("doc_id") % 3 == 0, " (1:12–17) PART 2 x").when(F.col("doc_id") % 3 == 1, " 3:4 in Devotion and Prayer PART 1").otherwise(" ESV  KJV"))
    return fx.table(spark, d, "documents").select("doc_id", epub.trimmed(text).alias("text"))


@query("syn4_imported", """WITH b AS (SELECT p_partkey::VARCHAR AS book_id, p_name || '.pdf' AS pdf_path, p_name AS title FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_partkey AS k, p_name, p_brand FROM part WHERE p_partkey % 2 = 1)
SELECT book_id, pdf_path, title, NULL::VARCHAR AS author FROM b
UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'id' || k ELSE sha256(p_name || '_' || k || ' - X Y.pdf') END, p_name || '_' || k || ' - X Y.pdf', CASE WHEN k % 3 = 0 THEN 'Side' ELSE p_name || ' ' || k END, 'X Y' FROM n""")
def syn4_imported(spark: SparkSession, d: str) -> DataFrame:
    """SYN4, SRC6: files that aren't in the catalogue, their sidecar before their name; one row for each."""
    part = fx.table(spark, d, "part")
    books = part.where("p_partkey % 2 = 0").selectExpr("cast(p_partkey AS string) AS book_id", "concat(p_name, '.pdf') AS pdf_path", "p_name AS title", "cast(null AS string) AS author")
    path = "concat(p_name, '_', p_partkey, ' - X Y.pdf')"
    new = part.where("p_partkey % 2 = 1")
    files = books.selectExpr("pdf_path AS path").union(new.selectExpr(path)).union(new.selectExpr(path))
    side = new.where("p_partkey % 3 = 0").selectExpr(f"{path} AS path", "concat('id', p_partkey) AS book_id", "'Side' AS title", "cast(null AS string) AS author", "cast(null AS string) AS series", "cast(null AS string) AS series_number")
    return reconcile.imported(books, files, side).select("book_id", "pdf_path", "title", "author")


@query("syn5_enriched", f"""WITH {fx.BOOKS} SELECT book_id, CASE book_id % 4 WHEN 1 THEN 'New' ELSE title END AS title, CASE book_id % 4 WHEN 1 THEN 'A' ELSE author END AS author, series,
 CASE WHEN book_id % 8 = 1 THEN '2' ELSE series_number END AS series_number FROM (SELECT * REPLACE (CASE WHEN book_id % 8 = 1 THEN 'S' ELSE series END AS series) FROM books)""")
def syn5_enriched(spark: SparkSession, d: str) -> DataFrame:
    """SYN5, SYN9: a file's name changes a book only if it names an author, and its series only if it names one."""
    rows = fx.books(spark, d).drop("year", "publisher").selectExpr("*", "CASE book_id % 4 WHEN 0 THEN 'v/Only.pdf' WHEN 3 THEN null ELSE concat('v/New', CASE WHEN book_id % 8 = 1 THEN ' (S 2)' ELSE '' END, ' - A.pdf') END AS pdf_path", "book_id % 4 = 2 AS meta_fetched")
    return reconcile.enriched(rows).select("book_id", "title", "author", "series", "series_number")


@query("syn7_backfilled", "SELECT CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'alreadyLocal' WHEN c_custkey % 5 = 0 THEN 'missing' ELSE 'connected' END AS outcome, count(*) AS n FROM customer GROUP BY 1")
def syn7_backfilled(spark: SparkSession, d: str) -> DataFrame:
    """SYN7, FLT16: how many books have a local copy, can get one, or miss one."""
    rows = fx.table(spark, d, "customer").selectExpr("c_name AS local_path", "c_custkey % 2 = 0 AS local_exists", "CASE WHEN c_custkey % 3 = 0 THEN 'f' END AS adopted", "c_name AS pdf_path", "c_custkey % 5 <> 0 AS pdf_exists")
    return reconcile.backfilled(rows).groupBy("outcome").agg(F.count("*").alias("n"))


@query("snk15_sidecars", f"WITH {fx.BOOKS} SELECT book_id, title, author, CASE WHEN book_id % 3 = 0 THEN 'No year' ELSE 'House' END AS publisher FROM books")
def snk15_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """SNK15, SRC6: metadata written as JSON, read again, and put before what the catalogue has; a malformed one is passed over."""
    rows = fx.books(spark, d).select("book_id", "title", "author", F.lit("House").alias("publisher"))
    json = reconcile.sidecar({"title": F.col("title"), "author": F.col("author"), "publisher": F.when(F.col("book_id") % 3 == 0, "No year")})
    side = rows.select("book_id", F.when(F.col("book_id") % 5 == 1, json).when(F.col("book_id") % 3 == 0, json).otherwise("{broken").alias("json"))
    return reconcile.with_sidecar(rows.withColumn("title", F.coalesce("title", F.lit("?"))), side, "title string, author string, publisher string")


@query("ing4_lines", """WITH g AS (SELECT user_id, event_id % 4 AS row, string_agg(event_type, '' ORDER BY event_id) AS text, min(event_id)::DOUBLE AS x FROM events GROUP BY ALL)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY row DESC) - 1)::INT AS line, x, text FROM g""")
def ing4_lines(spark: SparkSession, d: str) -> DataFrame:
    """ING4: lines of a page from its placed pieces, those of nearly the same height together. (No page here has columns.)"""
    pieces = fx.table(spark, d, "events").selectExpr("user_id", "event_id AS position", "cast(event_id AS double) AS x", "event_id % 4 * 10 + event_id % 3 * 0.5D AS y", "1e9D AS width", "10.0D AS size", "event_type AS text")
    return layout.lines(pieces, ["user_id"]).select("user_id", "line", "x", "text")


@query("snk16_written", f"""WITH {fx.EXCERPTS} SELECT source, book AS place, cs, vs, ve, excerpt_id AS position,
 CASE WHEN row_number() OVER (PARTITION BY source, book ORDER BY cs, vs, ve DESC, excerpt_id) = 1 THEN '# Book ' || book || chr(10) || chr(10) ELSE '' END
 || '## ' || cs || ':' || vs || CASE WHEN ve <> vs THEN '-' || ve ELSE '' END || chr(10) || 't' || excerpt_id || chr(10) AS text FROM excerpts""")
def snk16_written(spark: SparkSession, d: str) -> DataFrame:
    """SNK16: excerpts of all 66 books as parts of their sources' Markdown."""
    rows = fx.excerpts(spark, d).selectExpr("source", "book", "cs", "vs", "ve", "excerpt_id AS position", "concat('t', excerpt_id) AS text")
    books = spark.range(66).selectExpr("cast(id AS int) AS code", "concat('Book ', id) AS name", "cast(id AS int) AS position")
    return markdown.written_parts(rows, books)


@query("ref8_headers", """SELECT c_custkey, shape, CASE WHEN shape = 'book-chapter-verse' THEN 'MAC' ELSE 'FUR' END AS book, CASE shape WHEN 'book-chapter-verse' THEN 1 + c_custkey % 9 WHEN 'chapter-verse' THEN 1 + c_custkey % 9 WHEN 'chapter-verse-roman' THEN 14 ELSE 7 END::INT AS cs,
 CASE WHEN shape = 'bare-range' THEN 1 ELSE c_custkey % 5 END::INT AS vs, CASE shape WHEN 'bare-range' THEN 1 WHEN 'paren-number' THEN 8 ELSE c_custkey % 5 + 2 END::INT AS ve FROM customer,
 (VALUES ('book-chapter-verse'), ('chapter-verse'), ('chapter-verse-roman'), ('bracket-number'), ('paren-number'), ('word-label'), ('phrase-label'), ('bare-range')) v(shape)""")
def ref8_headers(spark: SparkSession, d: str) -> DataFrame:
    """REF8, STR21, STR22: headings in each of eight shapes, with the book and chapter that are current."""
    v, w = "c_custkey % 5", "c_custkey % 5 + 2"
    lines = {
        "book-chapter-verse": f"concat('Mach. ', 1 + c_custkey % 9, ':', {v}, '-', {w}, ' Title')", "chapter-verse": f"concat('(', 1 + c_custkey % 9, ' : ', {v}, '–', {w}, ') x')",
        "chapter-verse-roman": f"concat('Cap. XIV. v. ', {v}, '-', {w})", "bracket-number": f"concat('[', {v}, '-', {w}, '] x')", "paren-number": f"concat({v}, ' - 8) x')",
        "word-label": f"concat('Vv. ', {v}, '—', {w}, '.')", "phrase-label": f"concat('The end: verses ', {v}, '-', {w})", "bare-range": "'l-I. x'",
    }
    rows = spread(fx.table(spark, d, "customer"))
    made = [
        rows.select("c_custkey", F.lit(shape).alias("shape"), headers.parse_header(F.expr(line), shape, F.lit("FUR"), F.lit(7), CANON).alias("h"))
        for shape, line in lines.items()
    ]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.where("h is not null").select("c_custkey", "shape", "h.book", "h.cs", "h.vs", "h.ve")


@query("ing5_epub_excerpts", """SELECT n_name AS path, 'A' AS book, 1 AS chapter, 2 AS verse, 3 AS verse_end, 'of ' || n_name || ' 7:1 cited more and next page' AS text FROM nation UNION ALL SELECT n_name, 'A', 2, 1, 1, 'two' FROM nation
UNION ALL SELECT n_name, 'S', 1, 4, 4, 'said' FROM nation""")
def ing5_epub_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """ING5: excerpts of an EPUB's pages; citations stay in the text, and books of one chapter have bare verses."""
    pages = fx.table(spark, d, "nation").selectExpr("n_name AS path", """explode(array(
        struct(0 AS position, 'front' AS name, '<b>1:1</b> front' AS html),
        struct(1 AS position, 'a1' AS name, concat('<body>intro <b>1:2–3</b> of <i>', n_name, '</i> <h3>7.1</h3> cited<br/>more</body>') AS html),
        struct(2 AS position, 'a2' AS name, 'and next page <strong> 2:1 </strong> two PART 3 x' AS html),
        struct(3 AS position, 's' AS name, '<p><b>4</b> passage <p class="x"><span>4</span> said <b>3:3</b>' AS html))) AS p""").select("path", "p.*")
    pages = pages.withColumn("html", F.when(F.col("name") == "s", F.replace("html", F.lit(" <b>3:3</b>"), F.lit(""))).otherwise(F.col("html")))
    starts = fx.table(spark, d, "nation").selectExpr("n_name AS path", "explode(array(struct('a1' AS name, 'A' AS book), struct('s' AS name, 'S' AS book))) AS s").select("path", "s.*")
    return epub.excerpts(pages, starts, ["S"]).drop("at")


@query("snk21_reviewed", f"""WITH {fx.EXCERPTS} SELECT excerpt_id, CASE WHEN excerpt_id % 4 = 1 THEN 99 ELSE book END AS book, CASE excerpt_id % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true ELSE flagged END AS flagged FROM excerpts""")
def snk21_reviewed(spark: SparkSession, d: str) -> DataFrame:
    """SNK21, SYS7: reviews confirm, reassign or discard excerpts; the last of each counts."""
    rows = fx.excerpts(spark, d).selectExpr("*", "'h' AS header", "cast(excerpt_id AS string) AS text")
    told = "CASE excerpt_id % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reassign' WHEN 2 THEN 'discard' END"
    place = "99 AS book", "1 AS cs", "1 AS vs", "1 AS ce", "1 AS ve"
    reviews = rows.where("excerpt_id % 4 < 3").selectExpr("excerpt_id", f"{told} AS action", *place, "2 AS position").union(rows.where("excerpt_id % 8 < 3").selectExpr("excerpt_id", "'discard' AS action", *place, "1"))
    return validation.reviewed(rows, reviews)[0].select("excerpt_id", "book", "flagged")


@query("snk22_renamed", "SELECT l_orderkey, l_linenumber, 'notes/' || CASE WHEN l_partkey % 3 = 0 AND l_linenumber <> 2 THEN 'new' ELSE 'old' END || '/' || CASE WHEN l_linenumber = 2 THEN 'x' WHEN l_partkey % 3 = 0 THEN 'new' ELSE 'old' END || '.md' AS note_path FROM lineitem")
def snk22_renamed(spark: SparkSession, d: str) -> DataFrame:
    """SNK22: quotes follow their book's note to its new path."""
    q = fx.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS book_id", "CASE WHEN l_linenumber = 2 THEN 'notes/old/x.md' ELSE 'notes/old/old.md' END AS note_path")
    titles = fx.table(spark, d, "part").selectExpr("p_partkey AS book_id", "'old' AS old", "CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS new")
    return reconcile.renamed_notes(q, titles).select("l_orderkey", "l_linenumber", "note_path")


@query("flt9_resolved_links", f"WITH {fx.NOTES} SELECT note, target, CASE WHEN n_regionkey < 3 THEN 'book' WHEN n_name IS NOT NULL THEN 'note' END AS kind, n_nationkey::VARCHAR AS id FROM links LEFT JOIN nation ON lower(target) = lower(n_name)")
def flt9_resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """FLT9: links lead to a book of that title, else to a note."""
    n = fx.table(spark, d, "nation")
    title = lambda df: df.selectExpr("n_nationkey AS id", "n_name AS title")
    links = reconcile.note_links(fx.notes(spark, d))
    return reconcile.resolved_links(links, title(n.where("n_regionkey < 3")), title(n))


@query("flt13_valid_tabs", "SELECT o_orderkey, kind FROM (SELECT o_orderkey, o_custkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'note' ELSE 'scripture' END AS kind FROM orders) WHERE kind = 'scripture' OR (kind = 'book' AND id % 2 = 0) OR (kind = 'note' AND id % 5 = 0)")
def flt13_valid_tabs(spark: SparkSession, d: str) -> DataFrame:
    """FLT13: tabs of books and notes that are gone are left out."""
    tabs = fx.table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'note' ELSE 'scripture' END AS kind")
    there = lambda k: fx.table(spark, d, "customer").where(F.col("c_custkey") % k == 0).selectExpr("c_custkey AS id")
    return reconcile.valid_tabs(tabs, there(2), there(5)).select("o_orderkey", "kind")


@query("arr1_marked_verses", "WITH q AS (SELECT o_custkey AS c, unnest(range(o_orderkey % 20 + 1, o_orderkey % 20 + 1 + o_custkey % 4 + 1)) AS v, o_orderpriority AS color, o_orderkey AS k FROM orders) SELECT 'JHN' AS book, c::INT AS chapter, v::INT AS verse, arg_max(color, k) AS color FROM q GROUP BY c, v")
def arr1_marked_verses(spark: SparkSession, d: str) -> DataFrame:
    """ARR1: the color of each marked verse, the latest mark on top."""
    q = fx.table(spark, d, "orders").selectExpr("concat('JHN ', o_custkey, ':', o_orderkey % 20 + 1, '-', o_orderkey % 20 + 1 + o_custkey % 4) AS ref", "o_orderpriority AS color", "o_orderkey AS created")
    return quotes.marked_verses(q)


@query("cit2_other_citations", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ', ' ELSE '' END || '*C*' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ', JHN 3:' || c_custkey END AS commentary,
 CASE WHEN c_custkey % 2 = 0 THEN 'AC IV' ELSE 'AC, Preface' END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ', ' || c_custkey END || ' (Edition)' AS section FROM customer""")
def cit2_other_citations(spark: SparkSession, d: str) -> DataFrame:
    """CIT2: citations of commentaries and confessions."""
    even, third = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 != 0
    author = F.when(even, F.concat(F.col("c_name"), F.lit(" "))).otherwise(" ")
    place = F.when(third, F.concat(F.lit("JHN 3:"), F.col("c_custkey").cast("string")))
    section = citation.section_citation(F.lit("AC"), F.when(even, "IV"), F.lit("Preface"), F.when(third, F.col("c_custkey")), F.lit("Edition"))
    return fx.table(spark, d, "customer").select("c_custkey", citation.commentary_citation(author, F.lit("C"), place).alias("commentary"), section.alias("section"))


@query("snk3_without_book", f"WITH {fx.SEARCH_DOCS} SELECT key, kind, NULL::INT AS page FROM s WHERE NOT (kind IN ('page', 'quote') AND book_id IS NOT DISTINCT FROM 'src0') UNION ALL SELECT 'n/AC:' || n_nationkey, 'confession', NULL FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'JHN:3:' || n_nationkey, 'scripture', n_nationkey FROM nation")
def snk3_without_book(spark: SparkSession, d: str) -> DataFrame:
    """SNK3-SNK6: a book's rows leave the index, a source's are replaced, and passages of editions that may be kept come in."""
    docs = search.without_book(fx.search_docs(spark, d), "src0")
    n = fx.table(spark, d, "nation")
    sections = search.section_rows(n.selectExpr("'n' AS source", "'AC' AS document", "n_nationkey AS ordinal", "CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE ' ' END AS text"))
    docs = search.replaced_source(docs.unionByName(sections.withColumn("key", F.lit("old"))), sections, "confession", "book_id")
    verses = n.selectExpr("'JHN' AS book", "3 AS chapter", "n_nationkey AS verse", "n_name AS text")
    passages_in = search.passage_rows(verses, "BSB").unionByName(search.passage_rows(verses, "ESV"))
    return docs.unionByName(passages_in, allowMissingColumns=True).select("key", "kind", "page")


@query("srt1_title_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END), p_partkey) AS n FROM part")
def srt1_title_order(spark: SparkSession, d: str) -> DataFrame:
    """SRT1, SRT3: titles in order, ignoring case."""
    rows = fx.table(spark, d, "part").selectExpr("p_partkey", "p_brand", "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS title")
    return rows.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.collate("title", "UTF8_LCASE"), "p_partkey")).alias("n"))


@query("sys8_index_status", "SELECT s_suppkey AS source, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 40) THEN 'indexed' ELSE 'unindexed' END AS status FROM supplier")
def sys8_index_status(spark: SparkSession, d: str) -> DataFrame:
    """SYS8: sources are indexed if rows of them are there."""
    rows = fx.table(spark, d, "lineitem").where("l_linenumber = 7 AND l_quantity > 40").selectExpr("l_suppkey AS source")
    return validation.index_status(fx.table(spark, d, "supplier").selectExpr("s_suppkey AS source", "'?' AS status"), rows)


@query("syn1_synchronised", """WITH b AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS book_id FROM part WHERE p_partkey % 10 <> 0)
SELECT book_id FROM b WHERE k % 10 < 9 OR k % 3 = 0 UNION ALL SELECT sha256('v' || p_partkey) FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT sha256('l' || n_nationkey) FROM nation WHERE n_nationkey % 2 = 0""")
def syn1_synchronised(spark: SparkSession, d: str) -> DataFrame:
    """SYN1, SYN2, SYN3: what the vault and the local folder have comes in, and what nothing has any more goes."""
    part, n = fx.table(spark, d, "part"), fx.table(spark, d, "nation")
    books = part.where("p_partkey % 10 <> 0").selectExpr("cast(p_partkey AS string) AS book_id", "concat('v', p_partkey) AS pdf_path", "concat('n', p_partkey) AS name", "p_partkey AS size")
    vault = part.where("p_partkey % 10 < 9").selectExpr("concat('v', p_partkey) AS path", "concat('n', p_partkey) AS name", "p_partkey AS size")
    local = n.selectExpr("concat('l', n_nationkey) AS path", "concat('local', n_nationkey) AS name", "CASE WHEN n_nationkey % 2 = 0 THEN -n_nationkey - 1 ELSE 1L END AS size")
    primary = part.where("p_partkey % 3 = 0").selectExpr("concat('x', p_partkey) AS path", "concat('n', p_partkey) AS name", "p_partkey AS size")
    return reconcile.synchronised(books, vault, local, primary).select("book_id")


@query("syn8_book_views", """SELECT p_partkey, coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag)), ','), '') AS shelves, coalesce(array_to_string(list_sort(list(DISTINCT l_linestatus)), ','), '') AS tags FROM part LEFT JOIN lineitem ON p_partkey = l_partkey * 2 GROUP BY 1""")
def syn8_book_views(spark: SparkSession, d: str) -> DataFrame:
    """SYN8, JN16: each book with its shelves and tags, also none; one pass over each relation."""
    part = fx.table(spark, d, "part").select("p_partkey")
    rows = fx.table(spark, d, "lineitem").withColumn("p_partkey", F.col("l_partkey") * 2)
    held = rows.groupBy("p_partkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("shelves"), F.array_sort(F.collect_set("l_linestatus")).alias("tags"))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return part.join(held, "p_partkey", "left").select("p_partkey", listed("shelves"), listed("tags"))


@query("flt_membership", """SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7 AND l_suppkey % 10 = 3) AND contains(lower(p_name), 'ring')""")
def flt_membership(spark: SparkSession, d: str) -> DataFrame:
    """FLT2, FLT3, FLT5: books on a shelf, not on another, whose name has a text."""
    rows = fx.table(spark, d, "lineitem").selectExpr("l_partkey AS p_partkey", "l_returnflag", "l_linenumber", "l_suppkey")
    part = fx.table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("ring")))
    there = catalog.on_shelf(part, rows.where("l_returnflag = 'R'"), "p_partkey")
    return catalog.on_shelf(there, rows.where("l_linenumber = 7 AND l_suppkey % 10 = 3"), "p_partkey", inside=False).select("p_partkey")


@query("flt12_completions", "SELECT p_name FROM part WHERE contains(lower(p_name), 'ri') ORDER BY lower(p_name), p_name, p_partkey LIMIT 8")
def flt12_completions(spark: SparkSession, d: str) -> DataFrame:
    """FLT12, SRT9: the first eight titles that hold what was typed."""
    return catalog.completions(fx.table(spark, d, "part"), "p_name", "Ri", "p_partkey").select("p_name")


@query("flt11_verses", f"WITH {fx.POINTS} SELECT point_id FROM points WHERE book = 3 AND chapter BETWEEN 1 AND 30 AND verse BETWEEN 5 AND 20")
def flt11_verses(spark: SparkSession, d: str) -> DataFrame:
    """FLT11: verses within a reference."""
    return fx.points(spark, d).where((F.col("book") == 3) & F.col("chapter").between(1, 30) & F.col("verse").between(5, 20)).select("point_id")


@query("set4_items", "SELECT n_nationkey, 'a,b' || CASE WHEN n_nationkey % 2 = 0 THEN ',c' ELSE '' END AS added, CASE WHEN n_nationkey % 2 = 0 THEN 'a,b' ELSE 'b' END AS removed FROM nation")
def set4_items(spark: SparkSession, d: str) -> DataFrame:
    """SET4: an item is added once, and taken out by equality."""
    held = F.array(F.lit("a"), F.lit("b"))
    item = F.when(F.col("n_nationkey") % 2 == 0, "c").otherwise("a")
    return fx.table(spark, d, "nation").select("n_nationkey", F.array_join(F.array_union(held, F.array(item)), ",").alias("added"), F.array_join(F.array_except(held, F.array(item)), ",").alias("removed"))


@query("win7_ordinals", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS ordinal FROM events")
def win7_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """WIN7: a section's place in its document."""
    return validation.numbered(fx.table(spark, d, "events"), "user_id", "event_id").select("event_id", "ordinal")


@query("str29_blockquotes", "SELECT item_id, '> ' || regexp_replace(text, '(\\r?\\n)+', chr(10) || '> ', 'g') || chr(10) || '>' || chr(10) || '> — B' || item_id AS quoted FROM benchmark")
def str29_blockquotes(spark: SparkSession, d: str) -> DataFrame:
    """STR29: quotes as Markdown."""
    return fx.table(spark, d, "benchmark").select("item_id", notes.blockquote(F.col("text"), F.concat(F.lit("B"), "item_id")).alias("quoted"))


@query("sys6_registered", "SELECT n_name AS path, n_nationkey AS sort_order FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_name, (19 + row_number() OVER (ORDER BY n_name))::INT FROM nation WHERE n_nationkey >= 20")
def sys6_registered(spark: SparkSession, d: str) -> DataFrame:
    """SYS6, SNK20: sources are registered once by path, behind those that are there."""
    n = fx.table(spark, d, "nation").selectExpr("n_name AS name", "n_nationkey AS sort_order")
    old = n.where("sort_order < 20")
    return catalog.appended(old, n.select("name").join(old, "name", "left_anti")).withColumnRenamed("name", "path")


@query("sys9_provider_ids", "SELECT n_nationkey, coalesce(r_name, n_name) AS provider FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def sys9_provider_ids(spark: SparkSession, d: str) -> DataFrame:
    """SYS9: a provider's id of a book by canonical order, else the book's code."""
    ids = fx.table(spark, d, "region").selectExpr("r_regionkey AS n_nationkey", "r_name")
    return fx.table(spark, d, "nation").join(ids, "n_nationkey", "left").select("n_nationkey", F.coalesce("r_name", "n_name").alias("provider"))
