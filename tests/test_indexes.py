"""Written indexes: blocks that are passed over, runs that are merged, sources that are pruned, keys that begin others."""

import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import quotes, ranges, reconcile, search
from lectern.sources import epub, providers
from lectern.streaming import runs

SCHEMA = "key string, kind string, book_id string, content string, ref string"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Documents in blocks, of which few have a rare word often, and the same index as it is derived."""
    rng = random.Random(1)
    rows = []
    for i in range(6000):
        words = rng.choices(["common", "other", "words", "text"], k=rng.randint(3, 40)) + ["rare"] * (rng.randint(1, 9) if i // 1500 == 2 and i % 5 == 0 else int(i % 97 == 0))
        rows.append((f"k{i:05d}", "page" if i % 3 else "note", f"b{i % 7}", " ".join(words), None))
    index = search.build_index(spark.createDataFrame(rows, SCHEMA).repartition(4))
    return search.write_index(index, str(tmp_path_factory.mktemp("index"))), index


@pytest.mark.parametrize("query", ["rare", "rar comm", "common", "text words", "nothing", "common nothing"])
def test_blocks_give_the_same_rows(written, query):
    mine, plain = written
    for scope, limit in ((None, 200), (None, 7), (F.col("kind") == "note", 50), (F.lit(False), 10)):
        rows = [[(r["key"], r["rank"]) for r in search.search(i, query, scope, limit).collect()] for i in written]
        assert rows[0] == rows[1], (query, limit)


def test_blocks_are_passed_over_and_contents_looked_up(written):
    mine, _ = written
    best, took = search.scored_blocks(mine, ["rare"], None, 20)
    every = mine.blocks.where("term = 'rare'").select("block").distinct().count()
    assert best.count() == 20 and took.distinct().count() < every
    hits = search.search(mine, "rare", limit=20)
    shown = hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [Or(" in shown or "PushedFilters: [In(doc" in shown or "EqualTo(doc" in shown
    assert len(hits.collect()) == 20


def test_postings_of_a_written_index(written):
    mine, plain = written
    counts = lambda i: sorted(map(tuple, i.postings.groupBy("term").agg(F.count("*"), F.sum("tf")).collect()))
    assert counts(mine) == counts(plain)


def test_ranks_that_are_equal_as_shown_go_by_key(written):
    """A word of nearly all documents has ranks of some 1e-6, which 9 digits hardly tell apart (F5)."""
    for index in written:
        every = search.ranked(index, "common").collect()
        want = sorted((round(r["rank"], 9), r["key"]) for r in every)[:50]
        assert want[-1][0] - min(r["rank"] for r in every) < 2e-6
        assert [(r["rank"], r["key"]) for r in search.search(index, "common", limit=50, digits=9).collect()] == want


def test_an_index_is_written_from_one_reading_of_its_contents(spark, tmp_path, monkeypatch):
    """Terms are counted beside their document, and no postings are written before they are in their blocks (F10, F11, F13)."""
    texts = ["b a b", "", None, "Ä ä a", "a"] + [" ".join(f"w{(i * j) % 7}" for j in range(i)) for i in range(1, 60)]
    docs = spark.createDataFrame([(f"k{i:02d}", "page", "b", t, None) for i, t in enumerate(texts)], SCHEMA)
    plain = search.build_index(docs)
    monkeypatch.setattr(search, "materialize", None)
    mine = search.write_index(plain, str(tmp_path))
    rows = lambda i: sorted(map(tuple, i.postings.select("key", "term", F.col("tf").cast("long")).collect()))
    assert rows(mine) == rows(plain) and ("k03", "a", 3) in rows(mine)
    same = lambda i: sorted(map(tuple, i.docs.select("key", "content", "length").fillna("").collect()))
    assert same(mine) == same(plain) and mine.whole.first()["total"] == len(texts)
    blocks = mine.blocks.groupBy("term", "block").count().where("count > 1")
    assert blocks.isEmpty()


# Runs

CHANGES = "key string, kind string, book_id string, content string, version long, removed boolean, ref string"


def loop_index(changes):
    """What is left of changes in the order of their runs, one by one."""
    docs, gone = {}, {}
    for run in changes:
        for key, kind, book, content, version, removed, _ in run:
            if key is None:
                gone[book] = max(version, gone.get(book, version))
            elif key not in docs or version >= docs[key][0]:
                docs[key] = (version, removed, kind, book, content)
    return {k: c for k, (v, removed, kind, book, c) in docs.items() if not removed and not (kind in runs.WITH_BOOK and v < gone.get(book, v))}


def test_changes_in_any_runs_and_merged(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "index")
    put = []
    for n in range(5):
        keys = rng.sample(range(60), 25)
        run = [(f"k{k}", rng.choice(["page", "note"]), f"b{k % 4}", f"word{rng.randint(0, 9)} text", rng.randint(1, 9), rng.random() < 0.2, None) for k in keys]
        run += [(None, "page", f"b{rng.randint(0, 3)}", None, rng.randint(1, 9), True, None)] if n in (1, 3) else []
        put.append(run)
        runs.put_changes(spark.createDataFrame(run, CHANGES), path, f"run{n}")
        if n == 2:  # one that is put again counts once
            runs.put_changes(spark.createDataFrame(run, CHANGES), path, f"run{n}")
    want = loop_index(put)
    read = lambda: {r["key"]: r["content"] for r in runs.read_changes(spark, path).docs.collect()}
    assert read() == want and len(runs.manifest(path)) == 5
    before = [(r["key"], r["rank"]) for r in search.search(runs.read_changes(spark, path), "word").collect()]
    late = runs.read_changes(spark, path)
    name = runs.merged(spark, path)
    assert read() == want and [r["name"] for r in runs.manifest(path)] == [name]
    assert [(r["key"], r["rank"]) for r in search.search(runs.read_changes(spark, path), "word").collect()] == before
    assert {r["key"] for r in late.docs.collect()} == set(want)  # who began to read before still can
    more = [("k1", "note", "b1", "word99", 20, False, None), ("k2", "note", "b2", None, 20, True, None)]
    runs.put_changes(spark.createDataFrame(more, CHANGES), path, "later")
    assert read() == {**{k: v for k, v in want.items() if k != "k2"}, "k1": "word99"}
    assert runs.cleared(path) == [f"run{n}" for n in range(5)] and read()["k1"] == "word99"


def test_a_stream_of_changes_with_removals(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    batches = [[("a", "page", "x", "one two", 1, False, None), ("b", "page", "x", "two", 1, False, None)], [("a", "page", "x", "three", 2, False, None), ("b", "page", "x", None, 2, True, None), ("c", "note", None, "two", 1, False, None)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(source)
        runs.changes_stream(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    found = lambda q: {r["key"] for r in search.search(runs.read_changes(spark, path), q).collect()}
    for _ in range(2):
        assert (found("two"), found("one"), found("three")) == ({"c"}, set(), {"a"})
        runs.merged(spark, path)


# Ranges and prefixes


def test_nodes_hold_each_number_once(spark):
    rng = random.Random(3)
    pairs = [(a, a + rng.randint(-2, 70)) for a in (rng.randint(-90, 90) for _ in range(200))] + [(-(2**31), 2**31 - 1), (0, 0), (5, 4), (7, 2**31 - 1)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", ranges.nodes(F.col("a"), F.col("b")).alias("n")).collect()
    for r in rows:
        held = sorted((n["node"] << n["level"], (n["node"] + 1 << n["level"]) - 1) for n in r["n"])
        size = r["b"] - r["a"] + 1
        assert len(held) <= 2 * max(1, size.bit_length()) if size > 0 else not held
        assert not held or held[0][0] == r["a"] and held[-1][1] == r["b"] and all(x[1] + 1 == y[0] for x, y in zip(held, held[1:]))


def test_ranges_of_any_length_equal_a_loop(spark):
    rng = random.Random(4)
    some = []
    for i in range(400):
        cs = rng.randint(1, 40)
        ce = cs + rng.choice([0, 0, 1, 2, 9, 1_000_000, -1])
        some.append((i, rng.choice("AB"), cs, rng.randint(1, 30), ce, rng.randint(1, 30), rng.random() < 0.1))
    points = [(i, rng.choice("AB"), rng.randint(1, 60) if i % 9 else rng.randint(1, 10**6), rng.randint(1, 31)) for i in range(300)]
    want = {
        (p, e)
        for p, book, c, v in points
        for e, b, cs, vs, ce, ve, flagged in some
        if b == book and not flagged and cs <= ce and (c, v) >= (cs, vs) and (c, v) <= (ce, ve)
    }
    e = spark.createDataFrame(some, "e int, book string, cs int, vs int, ce int, ve int, flagged boolean")
    p = spark.createDataFrame(points, "p int, book string, chapter int, verse int")
    got = [(r["p"], r["e"]) for r in ranges.covering(p, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ranges.covering(p, e.limit(0)).count() == 0 and ranges.covering(p.limit(0), e).count() == 0


def shuffled(df) -> int:
    """Rows that all exchanges of an executed plan have written."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    found, open_ = 0, [text]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name == "Exchange":
            found += node.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif "QueryStage" in name:
            open_.append(node.plan())
        else:
            open_.extend(node.children().apply(i) for i in range(node.children().size()))
    return found


def test_points_of_ranges_move_once(spark, monkeypatch):
    """Points were sent once for each level of the ranges' nodes."""
    monkeypatch.setattr(ranges, "HELD", 100, raising=False)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    p = spark.range(4000).selectExpr("id AS p", "cast(id % 3 AS int) AS book", "cast(id % 42 + 1 AS int) AS chapter", "cast(id % 31 + 1 AS int) AS verse")
    e = spark.range(200).selectExpr("id AS e", "cast(id % 3 AS int) AS book", "cast(id % 40 + 1 AS int) AS cs", "cast(id % 30 + 1 AS int) AS vs", "cast(id % 40 + 1 + id % 3 AS int) AS ce", "cast(id * 7 % 30 + 1 AS int) AS ve", "false AS flagged")
    found = ranges.covering(p, e)
    try:
        assert 4000 <= shuffled(found) < 4000 + 2 * 4 * 200
        sections = ranges.covering_sections(p.selectExpr("p", "book AS document", "chapter AS ordinal"), e.selectExpr("e", "book AS document", "cs AS first", "ce AS last"))
        assert 4000 <= shuffled(sections) < 4000 + 2 * 4 * 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_heavy_cells_are_parted(spark, monkeypatch):
    """Nearly all points and ranges in one chapter: slices of both meet each other, and no pair is lost or made twice."""
    monkeypatch.setattr(ranges, "HELD", 20)
    points = [(i, "A", 3 if i % 10 else 40, i % 31 + 1) for i in range(600)]
    some = [(i, "A", 3, i % 20 + 1, 3 + i % 2 * 30, i % 7 + 15, False) for i in range(500)]
    want = {(p, e) for p, _, c, v in points for e, _, cs, vs, ce, ve, _ in some if (cs, vs) <= (c, v) <= (ce, ve)}
    p = spark.createDataFrame(points, "p int, book string, chapter int, verse int")
    e = spark.createDataFrame(some, "e int, book string, cs int, vs int, ce int, ve int, flagged boolean")
    got = [(r["p"], r["e"]) for r in ranges.covering(p, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sections = ranges.covering_sections(p.selectExpr("p", "book AS document", "chapter AS ordinal"), e.selectExpr("e", "book AS document", "cs AS first", "ce AS last"))
    got = [(r["p"], r["e"]) for r in sections.collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, e) for p, _, c, _ in points for e, _, cs, _, ce, _, _ in some if cs <= c <= ce}


def dense(spark):
    """Points and excerpts of which many lie at one place, in no order of their keys."""
    p = spark.range(6000).selectExpr("id * 7919 % 60000 AS p", "cast(id % 3 AS int) AS book", "cast(id % 4 + 1 AS int) AS chapter", "cast(id % 5 + 1 AS int) AS verse")
    e = spark.range(90).selectExpr("id * 7919 % 60000 AS e", "cast(id % 3 AS int) AS book", "cast(id % 4 + 1 AS int) AS cs", "cast(id % 7 + 1 AS int) AS vs", "cast(id % 4 + 1 + id % 2 AS int) AS ce", "cast(id * 7 % 5 + 1 AS int) AS ve", "false AS flagged")
    return p, e


def in_runs(found, want, least):
    """Whether rows are those wanted, those of an excerpt follow each other, and so do the same points for many excerpts."""
    got = [(r["p"], r["e"]) for r in found.collect()]
    assert len(got) > 10_000 and sorted(got) == sorted(map(tuple, want.collect()))
    runs = [tuple(p for p, _ in run) for _, run in itertools.groupby(got, key=lambda r: r[1])]
    return len(runs) * least < len(got) and len(set(runs)) * 2 < len(runs)


def test_points_of_a_place_follow_each_excerpt(spark):
    """Points met their excerpts one by one, so each row of the result took its own place on disk (F1)."""
    p, e = dense(spark)
    want = p.join(e, "book").where("(cs, vs) <= (chapter, verse) AND (chapter, verse) <= (ce, ve)").select("p", "e")
    assert in_runs(ranges.covering(p, e), want, 50)


def test_lists_of_a_section_follow_each_excerpt(spark, monkeypatch):
    """Sections' points met their excerpts one by one (F2); a section of many points is parted into lists."""
    monkeypatch.setattr(ranges, "LIST", 50, raising=False)
    p, e = dense(spark)
    p, e = p.selectExpr("p", "book AS document", "chapter AS ordinal"), e.selectExpr("e", "book AS document", "cs AS first", "ce AS last")
    want = p.join(e, "document").where("ordinal BETWEEN first AND last").select("p", "e")
    assert in_runs(ranges.covering_sections(p, e), want, 20)


def naive_match(key, primary, least):
    same = [(pos, f) for f, k, pos in primary if k == key]
    if same:
        return min(same)[1]
    near = [(-min(len(key), len(k)), pos, f) for f, k, pos in primary if len(k) >= least and len(key) >= least and (key.startswith(k) or k.startswith(key))]
    return min(near)[2] if near else None


def test_names_that_begin_alike(spark):
    rng = random.Random(5)
    key = lambda: "s" * 5 + "".join(rng.choices("ab", k=rng.randint(0, 7)))
    primary = [(f"f{i}", key(), i) for i in rng.sample(range(1000), 150)]
    names = [(i, key()) for i in range(400)]
    n, p = spark.createDataFrame(names, "id int, key string"), spark.createDataFrame(primary, "file string, key string, position int")
    want = {i: naive_match(k, primary, 6) for i, k in names}
    for parts in (1, 5, 16):
        got = {r["id"]: r["file"] for r in reconcile.matched_names(n, p, 6, parts).collect()}
        assert got == {i: f for i, f in want.items() if f is not None}, parts
    assert reconcile.matched_names(n, p.limit(0), 6).count() == 0


def test_a_hundred_thousand_titles_of_one_head(spark):
    head = "commentaryonthewholebible"
    titles = spark.range(100_000).select(F.concat(F.lit(head), F.lpad("id", 6, "0"), F.lit("x")).alias("key"), "id")
    primary = titles.select(F.concat(F.lit("f"), "id").alias("file"), "key", F.col("id").alias("position"))
    names = titles.where("id % 2 = 0").select("id", F.expr("left(key, length(key) - 1)").alias("key"))
    found = reconcile.matched_names(names, primary, parts=6)
    assert found.where("file = concat('f', id)").count() == found.count() == 50_000


# Data sources


def test_only_books_that_are_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = [(str(n % 2), book, c, f"[1] {book} {c}") for n, book in enumerate(["GEN", "EXO", "JHN", "ROM"]) for c in range(1, 6)]
    providers.write_answers(spark.createDataFrame(rows, "provider_id string, book string, chapter int, answer string"), path)
    registry = [{"edition": "A", "provider": "esv", "provider_id": "0"}, {"edition": "B", "provider": "api-bible", "provider_id": "1"}, {"edition": "C", "provider": "unknown", "provider_id": "1"}]
    reader = lambda **wanted: providers.ChapterReader(path, registry, wanted)
    assert {(b.edition, b.book) for b in reader().partitions()} == {("A", "GEN"), ("A", "JHN"), ("B", "EXO"), ("B", "ROM")}
    one = reader(edition={"A"}, book={"GEN", "ROM"}, chapter={3})
    assert [(b.edition, b.book) for b in one.partitions()] == [("A", "GEN")]
    assert [r[3] for p in one.partitions() for r in one.read(p)] == [3]
    table = providers.read_chapters(spark, path, registry)
    assert table.count() == 20 and table.where("edition = 'B' AND book = 'ROM' AND chapter > 3").count() == 2
    assert table.where("edition = 'A'").unionByName(table.where("book = 'ROM'")).count() == 15
    assert providers.read_chapters(spark, path, registry, books=["REV"]).count() == 0
    assert providers.read_chapters(spark, path, registry, editions=["A", "C"], chapters=[2]).count() == 2
    verses = providers.chapter_verses(spark.createDataFrame([("A", "esv", "GEN", 1, '{"passages":["[1] a","[2] b  c [3] "]}'), ("A", "esv", "GEN", 2, "broken"), ("A", "free-use", "GEN", 3, None)], "edition string, provider string, book string, chapter int, answer string"))
    assert sorted(map(tuple, verses.collect())) == [("A", "GEN", 1, 1, "a"), ("A", "GEN", 1, 2, "b c")]


def test_epub_source_equals_whole_archives(spark, tmp_path):
    rows = [(f"b{i % 3}", f"p{i}.xhtml", None if i == 4 else f"<p>{i} é</p>" * (400 if i % 3 == 0 else 1), i) for i in range(60)]
    epub.write_epubs(spark.createDataFrame(rows, "book string, name string, html string, n int"), str(tmp_path), "n")
    (tmp_path / "broken.epub").write_bytes(b"no archive" * 9000)
    with zipfile.ZipFile(tmp_path / "none.epub", "w") as archive:
        archive.writestr("a.txt", "no package")
    providers.register(spark)
    whole = sorted(map(tuple, epub.read_epub(spark, str(tmp_path)).collect()))
    for together, run in ((1 << 20, 64), (2000, 7)):
        source = spark.read.format("epub_chapters").option("path", str(tmp_path)).option("together", together).option("run", run).load()
        assert sorted(map(tuple, source.collect())) == whole and len(whole) == 60
    parts = providers.EpubReader(str(tmp_path), 2000, 7).partitions()
    assert len(parts) > 3 and all(len(names or []) <= 7 for p in parts for _, _, names in p.runs)


def test_members_of_a_large_archive_are_read_where_they_are(spark, tmp_path, monkeypatch):
    """A run doesn't read the directory of its archive again, and runs are dealt to a bounded number of tasks (F18)."""
    rows = [("b", f"p{i:02d}.xhtml", f"<p>{i} é</p>" * (i + 1), i) for i in range(40)]
    epub.write_epubs(spark.createDataFrame(rows, "book string, name string, html string, n int"), str(tmp_path), "n")
    monkeypatch.setattr(providers, "TASKS", 4, raising=False)
    reader = providers.EpubReader(str(tmp_path), 100, 3)
    parts = reader.partitions()
    assert len(parts) <= 4 and all(len(members) <= 3 for p in parts for _, _, members in p.runs)
    monkeypatch.setattr(providers.zipfile, "ZipFile", None)
    read = sorted((r for p in parts for r in reader.read(p)), key=lambda r: r[1])
    assert [r[1:] for r in read] == [(i, name, html) for _, name, html, i in rows]


def test_edits_after_a_deletion_and_of_quotes_that_are_gone(spark):
    rows = spark.createDataFrame([("a", "t", "r", "c"), ("b", "t", "r", None), ("c", "t", "r", "c")], "quote_id string, text string, annotations string, citation_override string")
    edits = [("a", 1, "text", "x"), ("a", 2, "text", "y"), ("a", 3, "citation", " "), ("b", 1, "delete", None), ("b", 2, "text", "z"), ("c", 1, "citation", " own "), ("d", 1, "text", "q"), ("a", 4, "annotations", None)]
    got = sorted(map(tuple, quotes.edited(rows, spark.createDataFrame(edits, "quote_id string, position int, what string, value string")).collect()))
    assert got == [("a", "y", None, None), ("c", "t", "r", "own")]
