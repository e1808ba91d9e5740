"""Small cases of the operators, among them empty input, nulls, ties and odd text."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import citation, text
from lectern.operators import catalog, ranges, reconcile, search, validation
from lectern.sources import markdown


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds or "x int").select(column.alias("r")).first()["r"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [("a", "page", "b1", "Über Größe"), ("b", "page", "b1", "the theme over"), ("c", "note", "n", "the the over uber"), ("d", "note", "n", ""), ("e", "quote", "b2", None)]
    return search.build_index(spark.createDataFrame([(*r, None) for r in rows], "key string, kind string, book_id string, content string, ref string"))


@pytest.mark.parametrize("query, keys", [("uber", {"a", "c"}), ("Über", {"a", "c"}), ("groß", {"a"}), ("gross", set()), ("th ov", {"b", "c"}), ("the AND", set()), ("", set()), ("!?", set()), ("zzz", set())])
def test_search(index, query, keys):
    assert {r["key"] for r in search.search(index, query).collect()} == keys


def test_rank_ignores_scope(index):
    every = {r["key"]: r["rank"] for r in search.search(index, "the").collect()}
    notes = {r["key"]: r["rank"] for r in search.search(index, "the", F.col("kind") == "note").collect()}
    assert notes == {"c": every["c"]} and search.search(index, "the", search.item_scope()).count() == 0


def test_written_index(index, tmp_path):
    again = search.write_index(index, str(tmp_path))
    assert {r["key"] for r in search.search(again, "over").collect()} == {"b", "c"}


@pytest.mark.parametrize("place, n", [((3, 24), 0), ((3, 25), 1), ((4, 1), 1), ((4, 2), 1), ((4, 3), 0)])
def test_range_over_chapters(spark, place, n):
    e = spark.createDataFrame([(1, 3, 25, 4, 2, False), (1, 3, 25, 4, 2, True), (1, 3, 25, 3, 4, False)], "book int, cs int, vs int, ce int, ve int, flagged boolean")
    p = spark.createDataFrame([(1, *place)], "book int, chapter int, verse int")
    assert ranges.covering(p, e).count() == n


@pytest.mark.parametrize("names, style, start", [
    ([], "footnote", "[author], *T*"), (["A B"], "footnote", "A B, *T*"), (["A B", "C D"], "footnote", "A B and C D, *T*"),
    (["A B", "C D", "E F"], "footnote", "A B et al., *T*"), (["A B", "C D", "E F"], "bibliography", "B, A, C D, and E F. *T*"),
    (["A B"] + ["C D"] * 6, "bibliography", "B, A, C D, C D, et al.. *T*"), (["A B"], "short", "B, *T*"), (["A B", "C D"], "author-date", "(B and D 1899, 7)"),
])
def test_citations(spark, names, style, start):
    c = citation.book_citation(style, F.col("t"), F.col("a"), F.col("y"), F.lit(None).cast("string"), F.lit("X"), F.col("p"))
    found = one(spark, c, t=" T ", a=names, y=1899, p=7)
    assert found.startswith(start) and (style in ("short", "author-date") or "X: [publisher], 1899" in found)


@pytest.mark.parametrize("s, n", [("XIV", 14), ("mcmxc", 1990), ("IIII", None), ("VV", None), ("", None), ("x1", None)])
def test_roman(spark, s, n):
    assert one(spark, text.roman(F.col("s")), s=s) == n


@pytest.mark.parametrize("s, n", [(" a\tb\r\nc ", 3), ("\t", 0), ("", 0), ("﻿x", 1)])
def test_word_count(spark, s, n):
    assert one(spark, text.word_count(F.col("s")), s=s) == n


def test_text_functions(spark):
    assert one(spark, text.safe_name(F.col("s")), s='a/b: "c"?\n d') == "a-b- -c-- d"
    assert one(spark, text.safe_name(F.col("s")), s="  ") == "untitled"
    assert one(spark, text.split_authors(F.col("s")), s="A & B; C and D") == ["A", "B", "C", "D"]
    assert one(spark, text.wiki_targets(F.col("s")), s="x [[A b#c|d]] [[E]] [[]]") == ["A b", "E"]
    assert one(spark, text.html_text(F.col("s")), s="<p>a<br>b &amp;lt; <script>x</script>c") == "a b &lt; c"
    assert one(spark, text.tag_name(F.col("s")), s=" #Tag ") == "tag"


def test_markdown(spark):
    books = spark.createDataFrame([("Romans", "ROM"), ("John", "JHN"), ("1 John", "1JN")], "name string, code string")
    md = "intro\n# Romans\n## 3:16 Title\nfirst\n\nmore\r\n## 3:25-4:2\nsecond\n## Stray\nlost\n## John 1:1-3\nthird\n# 1 John\n## 2:1\n# Romans 5\nfifth"
    found = markdown.excerpts(spark.createDataFrame([("f", md), ("g", "no heading")], "path string, text string"), books)
    rows = [tuple(r)[2:7] + (r["text"],) for r in found.orderBy("position").collect()]
    assert rows == [("ROM", 3, 16, 3, 16, "first\n\nmore"), ("ROM", 3, 25, 4, 2, "second"), ("JHN", 1, 1, 1, 3, "third"), ("1JN", 2, 1, 2, 1, ""), ("ROM", 5, 1, 5, 1, "fifth")]


def test_validation(spark):
    rows = [("s", i, "ROM", c, v, w) for i, (c, v, w) in enumerate([(1, 5, 20), (1, 4, 19), (2, 40, 300), (9, 1, 25)])] + [("s", 4, "XXX", 0, 1, 25)]
    rows = spark.createDataFrame(rows, "source string, n int, book string, chapter int, verse int, words int")
    verses = spark.createDataFrame([("ROM", 1, 32), ("ROM", 2, 29)], "book string, chapter int, last int")
    got = {r["n"]: (r["out_of_sequence"], r["out_of_bounds"], r["odd_size"]) for r in validation.validated(rows, verses, "source", "n").collect()}
    assert got == {0: (False, False, False), 1: (True, False, True), 2: (False, True, True), 3: (False, False, False), 4: (False, False, False)}


@pytest.mark.parametrize("found, known, bad", [(0, 1, True), (0, 0, False), (15, 20, False), (16, 21, True), (80, 100, False), (79, 100, True)])
def test_incomplete_scan(spark, found, known, bad):
    assert one(spark, reconcile.incomplete_scan(F.col("a"), F.col("b")), a=found, b=known) is bad


def test_insert_or_ignore_and_empty(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, catalog.insert_or_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
    assert catalog.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_stream_replaces_partitions(spark, tmp_path):
    from lectern.streaming.indexing import index_stream

    schema = "key string, kind string, book_id string, content string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate([[("a", "page", "b1", "one two"), ("b", "page", "b2", "two")], [("a", "page", "b1", "three")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "check")).awaitTermination()
        assert i or spark.read.parquet(out).count() == 3
    assert {r["term"] for r in spark.read.parquet(out).collect()} == {"three", "two"}


def test_stream_of_versions_keeps_books_that_come_in_parts(spark, tmp_path):
    from lectern.streaming.indexing import index_runs, read_runs

    schema = "key string, kind string, book_id string, content string, version long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    runs = [
        [("a1", "page", "a", "one two", 1), ("n", "note", None, "first", 1), ("x", "page", None, "lone", 1)],
        [("a2", "page", "a", "two", 1), ("a2", "page", "a", "two", 1)],
        [("a1", "page", "a", "three", 2), ("n", "note", None, "second", 2)],
        [("a3", "page", "a", "three four", 2), ("old", "page", "a", "late", 1)],
    ]
    keys = []
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        index_runs(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "check")).awaitTermination()
        keys.append({r["key"] for r in read_runs(spark, out).docs.collect()})
    assert keys == [{"a1", "n", "x"}, {"a1", "a2", "n", "x"}, {"a1", "n", "x"}, {"a1", "a3", "n", "x"}]
    index = read_runs(spark, out)
    found = lambda q: [r["key"] for r in search.search(index, q).collect()]
    assert found("three") == ["a1", "a3"] and found("two") == found("first") == found("late") == [] and found("sec") == ["n"]


def test_numbered_over_many_partitions(spark):
    from lectern.operators import catalog

    rows = spark.createDataFrame([(f"n{i * 7919 % 1000:03d}",) for i in range(1000)], "name string").repartition(13)
    got = catalog.numbered(rows, "name").collect()
    assert {(r["name"], r["_n"]) for r in got} == {(f"n{i:03d}", i + 1) for i in range(1000)}
    assert catalog.numbered(rows.limit(0), "name").count() == 0


def test_written_index_is_pruned_by_prefix(spark, tmp_path):
    """The prefix of each token reaches the scan of the sorted postings, and content is read for the best keys only."""
    docs = spark.createDataFrame([(str(i), "page", "b", f"word{i} common text", None) for i in range(300)], "key string, kind string, book_id string, content string, ref string")
    index = search.write_index(search.build_index(docs), str(tmp_path))
    plan = lambda df: df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "StringStartsWith(term,word1)" in plan(search.ranked(index, "word1"))
    found = search.search(index, "word1 comm", limit=5)
    assert [r["key"] for r in found.collect()] == [r["key"] for r in search.search(search.build_index(docs), "word1 comm", limit=5).collect()]
    assert found.count() == 5 and "TakeOrderedAndProject" in plan(found)


def test_corrections_move_confirm_and_discard(spark):
    from lectern.operators import validation

    rows = spark.createDataFrame([("a", "ROM", 1, 30, 1, 30, 50, 1), ("b", "ROM", 1, 40, 1, 40, 50, 2), ("c", "ROM", 1, 50, 1, 50, 50, 3), ("d", "ROM", 2, 1, 2, 1, 50, 4)], "hash string, book string, cs int, vs int, ce int, ve int, words int, nth int").withColumn("source", F.lit("s"))
    made = [("a", "discard", None, None, None, None, None, 1), ("b", "reassign", "ROM", 1, 3, 1, 5, 1), ("c", "confirm", None, None, None, None, None, 1), ("gone", "confirm", None, None, None, None, None, 1)]
    corrections = spark.createDataFrame(made, "hash string, action string, book string, cs int, vs int, ce int, ve int, position int")
    verses = spark.createDataFrame([("ROM", 1, 32), ("ROM", 2, 29)], "book string, chapter int, last int")
    out = {r["hash"]: r for r in validation.finalised(rows, corrections, verses, "source", "nth").collect()}
    assert set(out) == {"b", "c", "d"} and (out["b"]["vs"], out["b"]["ve"], out["b"]["flagged"]) == (3, 5, False)
    assert not out["c"]["flagged"] and out["c"]["out_of_bounds"] and not out["d"]["flagged"]
    assert [r["hash"] for r in validation.orphans(rows, corrections).collect()] == ["gone"]


def test_very_long_ranges(spark):
    points = spark.createDataFrame([(1, "A", 5, 3), (2, "A", 10**6, 3), (3, "B", 1, 1)], "id int, book string, chapter int, verse int")
    excerpts = spark.createDataFrame([("x", "A", 5, 4, 2 * 10**9, 1, False), ("y", "A", 4, 1, 6, 1, False)], "e string, book string, cs int, vs int, ce int, ve int, flagged boolean")
    assert sorted((r["id"], r["e"]) for r in ranges.covering(points, excerpts).collect()) == [(1, "y"), (2, "x")]
    sections = spark.createDataFrame([("x", "D", 2, 2 * 10**9), ("y", "D", 1, 2), ("z", "D", 3, 1)], "e string, document string, first int, last int")
    at = spark.createDataFrame([("D", 2), ("D", 5000)], "document string, ordinal int")
    assert sorted((r["ordinal"], r["e"]) for r in ranges.covering_sections(at, sections).collect()) == [(2, "x"), (2, "y"), (5000, "x")]


def test_counts_of_covering_excerpts_pair_distinct_ranges_and_places(spark, monkeypatch):
    met = []
    plain = ranges.covering
    monkeypatch.setattr(ranges, "covering", lambda p, e: met.append((p.count(), e.count())) or plain(p, e))
    p = spark.range(300).selectExpr("id AS point", "1 AS book", "cast(id % 3 + 1 AS int) AS chapter", "5 AS verse")
    e = spark.range(200).selectExpr("id AS e", "1 AS book", "1 AS cs", "1 AS vs", "cast(id % 2 + 1 AS int) AS ce", "9 AS ve", "id % 4 = 3 AS flagged", "'s' AS source")
    got = {(r["point"], r["source"], r["n"]) for r in ranges.covering_counts(p, e, "source").collect()}
    # Half of the ranges end in chapter 1, and half of the others, which end in chapter 2, are flagged.
    assert got == {(k, "s", 150 if k % 3 == 0 else 50) for k in range(300) if k % 3 < 2}
    assert met == [(3, 2)]
