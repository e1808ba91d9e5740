"""Small cases of references, notes, names, chapters, layout and normalising, several against plain Python."""

import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import names, notes, references
from lectern.functions.references import Book
from lectern.operators import normalise, quotes, reconcile
from lectern.sources import epub, layout, markdown, passages

CANON = [Book("JHN", "John", 21, ("Jn",)), Book("1JN", "1 John", 5, ("1 Jn",), ("First John",)), Book("SNG", "Song of Songs", 8, ("Song",)), Book("PHM", "Philemon", 1)]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text, found", [
    ("see John 3:16-18.", [("John 3:16-18", 4, "JHN", 3, 16, 18)]), ("1 John 2", [("1 John 2", 0, "1JN", 2, None, None)]),
    ("Song of Songs 1:2; Song. 3", [("Song of Songs 1:2", 0, "SNG", 1, 2, 2), ("Song. 3", 19, "SNG", 3, None, None)]),
    ("john 3, John 22:1, xJohn 2, First John 3", [("John 3", 34, "JHN", 3, None, None)]), ("", []), (None, []), ("😀 Jn 1", [("Jn 1", 2, "JHN", 1, None, None)]),
])
def test_references(spark, text, found):
    got = one(spark, references.find_references(F.col("s"), CANON), text)
    assert [(r["raw"], r["at"], r["book"], r["chapter"], r["verse"], r["verse_end"]) for r in got] == found


def test_references_against_a_scan(spark):
    draw = random.Random(3)
    bits = ["John", "1 John", "Jn", "Song of Songs", "Song", "Philemon", "3", "12:4", "5:6-7", "5:6 – 9", ".", " ", " ", " ", "and", "\n", "ü"]
    texts = ["".join(draw.choice(bits) for _ in range(40)) for _ in range(200)]
    scan = re.compile(r"(?<![A-Za-z0-9_])(Song of Songs|Philemon|1 John|1 Jn|John|Song|Jn)(?![A-Za-z0-9_])\.?\s+([0-9]{1,3})(?::([0-9]{1,3})(?:\s*[-–]\s*([0-9]{1,3}))?)?")
    most = {"song of songs": 8, "song": 8, "philemon": 1, "1 john": 5, "1 jn": 5, "john": 21, "jn": 21}
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", references.find_references(F.col("s"), CANON).alias("r")).collect()
    for row in rows:
        want = [(m[0], m.start()) for m in scan.finditer(texts[row["i"]]) if 1 <= int(m[2]) <= most[m[1].lower()]]
        assert [(r["raw"], r["at"]) for r in row["r"]] == want


def test_other_references(spark):
    parse = lambda s: one(spark, references.parse_reference(F.col("s"), CANON), s)
    assert parse(" jn. 3:16 ")["raw"] == "jn. 3:16" and parse("John 3 x") is None and parse("John 99") is None and parse(None) is None
    assert one(spark, references.trailing_book(F.col("s"), CANON), "Interpretation of First John ") == "1JN"
    assert one(spark, references.trailing_book(F.col("s"), CANON), "in John we read") is None
    assert one(spark, references.trailing_reference(F.col("s"), CANON), "RUN AWAY philemon 7–11")["verse_end"] == 11
    assert one(spark, references.trailing_reference(F.col("s"), CANON), "AWAY John 7-11") is None
    assert tuple(one(spark, references.section_reference(F.col("s")), " AC:4 ")) == ("AC", 4) and one(spark, references.section_reference(F.col("s")), "AC:0") is None


def test_within_chapters_against_a_loop(spark):
    draw, last = random.Random(5), {("A", 1): 5, ("A", 2): 3, ("A", 3): 4}
    rows = [(b, i, draw.randint(0, 4), (v := draw.randint(1, 7)), draw.choice([v, v + 1])) for i, b in enumerate("AAAAAAAAAB" * 30)]
    want = []
    for book in "AB":
        mine = [r for r in rows if r[0] == book]
        seen = {r[2:] for r in mine}
        for _, i, c, v, w in mine:
            top, prior = last.get((book, c), 0), last.get((book, c - 1), 0)
            if book == "B" or (v <= top and w <= top):
                want.append((i, c, v, w, "none"))
            elif top and v <= top:
                want.append((i, c, v, top, "clamp"))
            elif top and v == top + 1 and w <= top + 1:
                want.append((i, c, top, top, "merge"))
            elif v <= prior and w <= prior and (c - 1, v, w) not in seen:
                seen.add((c - 1, v, w))
                want.append((i, c - 1, v, w, "relabel"))
    frame = spark.createDataFrame([(b, i, c, v, c, w) for b, i, c, v, w in rows], "book string, position int, cs int, vs int, ce int, ve int")
    verses = spark.createDataFrame([(*k, n) for k, n in last.items()], "book string, chapter int, last int")
    got = normalise.within_chapters(frame, verses).select("position", "cs", "vs", "ve", "fix").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {w[4] for w in want} == {"none", "clamp", "merge", "relabel"}
    assert normalise.within_chapters(frame.limit(0), verses).count() == 0


def test_folded_headings(spark):
    rows = [("s", 1, "1:1", 1, "a"), ("s", 2, "4:2", 4, "b"), ("s", 3, "2:1", 2, "c"), ("s", 4, "1:9", 1, "d"), ("s", 5, "x", None, "e"), ("t", 6, "x", None, "f"), ("t", 7, "9:1", 9, "g")]
    got = normalise.folded(spark.createDataFrame(rows, "source string, position int, ref string, chapter int, text string"), ["source"]).orderBy("position")
    assert [tuple(r) for r in got.collect()] == [("s", 1, "1:1", 1, "a 4:2 b"), ("s", 3, "2:1", 2, "c 1:9 d x e"), ("t", 7, "9:1", 9, "g")]


def test_gutter_against_every_step():
    draw = np.random.default_rng(1)
    for columns in (1, 2):
        for _ in range(20):
            left = draw.uniform(0, 200, 60) + (draw.integers(0, 2, 60) * 300 if columns == 2 else draw.uniform(0, 300, 60))
            right = left + draw.uniform(1, 60, 60)
            low, span = left.min(), right.max() - left.min()
            steps = low + span * 0.33 + 2.0 * np.arange(int(span * 0.33 / 2) + 1)
            across = np.array([((left < x) & (right > x)).sum() for x in steps])
            best = steps[across.argmin()]
            good = across.min() <= 1.2 and min((right <= best).sum(), (left >= best).sum()) >= 15
            assert layout.gutter(left, right) == (pytest.approx(best) if good else None)
    assert layout.gutter(np.zeros(50), np.full(50, 1e12)) is None and layout.gutter(np.zeros(0), np.zeros(0)) is None


def test_lines_of_two_columns(spark):
    rows = [("p", i, float(50 + 300 * (i % 2)), 700.0 - 10 * (i // 2) + (i % 3) * 0.5, 80.0, 10.0, f"{'lr'[i % 2]}{i // 2} ") for i in range(60)] + [("q", 0, 5.0, 1.0, None, 9.0, "b"), ("q", 1, 1.0, 2.5, 1.0, 9.0, "a"), ("q", 2, 0.0, 50.0, 1.0, 9.0, " "), ("q", 3, 0.0, 60.0, 1.0, 9.0, None)]
    got = layout.lines(spark.createDataFrame(rows, "page string, position int, x double, y double, width double, size double, text string"), ["page"]).orderBy("page", "line").collect()
    assert [r["text"] for r in got if r["page"] == "p"] == [f"l{i} " for i in range(30)] + [f"r{i} " for i in range(30)]
    assert [r["text"] for r in got if r["page"] == "q"] == ["ab"]


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<rootfile full-path="o/c.opf"/>')
        z.writestr("o/c.opf", '<item href="b%20.html" id="b"/><item id="a" href="a.html"/><itemref idref="b"/><itemref idref="a"/><itemref idref="none"/>')
        z.writestr("o/a.html", "<body><h1>One <b>&amp;</b></h1><p>x</p><h2>Two</h2>y</body>")
        z.writestr("o/b .html", "no headings")
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    pages = epub.read_epub(spark, str(tmp_path))
    assert [(r["position"], r["name"]) for r in pages.orderBy("position").collect()] == [(0, "o/b .html"), (1, "o/a.html")]
    found = epub.headings(pages.select(F.col("name").alias("key"), "html")).orderBy("position").collect()
    assert [(r["heading"], r["body"]) for r in found] == [("One &", "<p>x</p>"), ("Two", "y")]
    assert one(spark, epub.paragraphs(F.col("s")), '<p>a<br/>b<a class="apnf">1</a></p><p> </p><div>c</div>') == ["a b", "c"]


def test_markdown_round_trip(spark):
    rows = [("s", "JHN", 3, 16, 18, 0, "wide"), ("s", "JHN", 3, 16, 16, 1, "one\n\ntwo"), ("s", "JHN", 1, 2, 2, 2, "first"), ("s", "PHM", 1, 7, 7, 3, "p")]
    frame = spark.createDataFrame(rows, "source string, book string, cs int, vs int, ve int, position int, text string")
    books = spark.createDataFrame([("JHN", "John", 1), ("PHM", "Philemon", 2)], "code string, name string, position int")
    files = markdown.written(frame, books).withColumnRenamed("source", "path")
    got = markdown.excerpts(files, books).orderBy("position").select("book", "cs", "vs", "ve", "text").collect()
    assert [tuple(r) for r in got] == [("JHN", 1, 2, 2, "first"), ("JHN", 3, 16, 18, "wide"), ("JHN", 3, 16, 16, "one\n\ntwo"), ("PHM", 1, 7, 7, "p")]


def test_markdown_files_in_parts(spark, tmp_path):
    """Files of a source in order of name are its Markdown, however many tasks wrote them."""
    rows = [(s, b, c, v, v, c * 9 + v, f"t{c}.{v}") for s in "ab" for b in ("JHN", "PHM") for c in range(1, 4) for v in range(1, 9)]
    frame = spark.createDataFrame(rows, "source string, book string, cs int, vs int, ve int, position int, text string").repartition(5)
    books = spark.createDataFrame([("JHN", "John", 1), ("PHM", "Philemon", 2)], "code string, name string, position int")
    whole = {r["source"]: r["text"] for r in markdown.written(frame, books).collect()}
    markdown.write_markdown(markdown.written_parts(frame, books), str(tmp_path / "out"))
    for s in "ab":
        files = sorted((tmp_path / "out" / f"source={s}").glob("part-*"))
        assert "".join(f.read_text() for f in files).strip() == whole[s].strip()


@pytest.mark.parametrize("name, want", [
    ("Only a title", ("Only a title", None, None, None)), ("A - B - C and D", ("A - B", "C & D", None, None)), ("T (S 1.5) - A; B", ("T", "A & B", "S", "1.5")),
    ("T (Note) - A", ("T (Note)", "A", None, None)), ("Quenstedt - Topic", ("Quenstedt - Topic", None, None, None)), ("a_b__c", ("a b c", None, None, None)), ("", ("", None, None, None)),
])
def test_file_names(spark, name, want):
    assert tuple(one(spark, names.parse_file_name(F.col("s")), name)) == want


def test_names(spark):
    base = lambda *x: spark.createDataFrame([x], "t string, a string, s string, n string").select(names.file_base(*map(F.col, "tasn")).alias("r")).first()["r"]
    assert base("T", "A", "S", "2") == "T (S 2) - A" and base("By A. B", "a b", None, None) == "By A. B" and base(" T ", None, "S", " ") == "T (S)"
    assert one(spark, names.title_case(F.col("s")), "of the iv: DON'T stop") == "Of The IV: Don't Stop"
    assert one(spark, names.metadata_folder(F.col("s")), "a/b/Name. .PDF") == "Name" and one(spark, names.parse_file_name(F.col("s")), None) is None


@pytest.mark.parametrize("text, want", [("[a, 'b c', \"d\", ]", ["a", "b c", "d"]), ("#a, b  #c", ["a", "b", "c"]), ("", []), (None, []), ("[]", [])])
def test_tag_lists(spark, text, want):
    assert one(spark, notes.tag_list(F.col("s")), text) == want


def test_notes(spark):
    note = '---\r\ntitle: T\r\ntype: project\r\nitems: [{"kind":"book","id":"x"},{"kind":"note"},{"kind":"scripture","book":"JHN","chapter":3}]\r\n---\r\n\r\nbody'
    assert one(spark, notes.body(F.col("s")), note) == "body" and one(spark, notes.note_type(F.col("s")), note) == "project"
    assert [r["kind"] for r in one(spark, notes.items(F.col("s")), note)] == ["book", "scripture"]
    assert one(spark, notes.items(F.col("s")), "---\nitems: {bad\n---\n") == [] and one(spark, notes.body(F.col("s")), None) is None
    assert one(spark, notes.title(F.col("s"), F.lit("f")), "x\n#  H \n") == "H" and one(spark, notes.title(F.col("s"), F.lit("f")), "") == "f"
    assert one(spark, notes.italics_html(F.col("s")), "a *b* <c>") == "a <em>b</em> &lt;c&gt;"
    two = "# N\n<!-- quote:1 -->\na\n<!-- /quote:1 -->\n<!-- quote:2 -->\n$1 \\\n<!-- /quote:2 -->\n"
    assert one(spark, notes.without_block(F.col("s"), F.lit("1")), two) == "# N\n<!-- quote:2 -->\n$1 \\\n<!-- /quote:2 -->\n"
    assert one(spark, notes.with_block(F.col("s"), F.lit("3"), F.lit("B")), None) == "\n\nB\n"


def test_quotes_and_imports(spark):
    read = lambda s: [a["text"] for a in one(spark, quotes.annotations(F.col("s")), s)]
    assert read('[{"text":"a"}]') == ["a"] and read("plain") == ["plain"] and read("{}") == [] and read("") == [] and read(None) == [] and read("3") == []
    assert one(spark, quotes.kept_override(F.col("s"), F.lit("g")), " g ") is None and one(spark, quotes.kept_override(F.col("s"), F.lit("g")), "h") == "h"
    books = spark.createDataFrame([], "book_id string, pdf_path string, title string, author string, series string, series_number string")
    side = spark.createDataFrame([], "path string, book_id string, title string, author string, series string, series_number string")
    files = spark.createDataFrame([("v/T - A.pdf",), ("v/T - A.pdf",)], "path string")
    assert [r["title"] for r in reconcile.imported(books, files, side).collect()] == ["T"] and reconcile.imported(books, files.limit(0), side).count() == 0


def test_passages(spark):
    frame = lambda s: spark.createDataFrame([("k", s)], "key string, answer string")
    assert [(r["verse"], r["text"]) for r in passages.marked_verses(frame("[1] a\n b [2][3] c")).collect()] == [(1, "a b"), (3, "c")]
    assert passages.marked_verses(frame("none")).count() == passages.json_verses(frame("{")).count() == passages.json_verses(frame(None)).count() == 0
    assert one(spark, passages.recordings(F.from_json("s", "map<string,string>")), None) == []


@pytest.mark.parametrize("line, shape, want", [
    ("Jn 3:16-18 x", "book-chapter-verse", ("JHN", 3, 16, 3, 18, False)), ("3:25–4:2", "chapter-verse", ("PHM", 3, 25, 4, 2, False)),
    ("Chap. IV. vers. 2", "chapter-verse-roman", ("PHM", 4, 2, 4, 2, False)), ("Chap. IV.", "chapter-verse-roman", None), ("[l-3] x", "bracket-number", ("PHM", 9, 1, 9, 3, True)),
    ("4-ll) x", "paren-number", ("PHM", 9, 4, 9, 4, False)), ("Verse 5.", "word-label", ("PHM", 9, 5, 9, 5, False)), ("A: V. 5", "phrase-label", ("PHM", 9, 5, 9, 5, False)),
    ("x 5.", "bare-range", None), ("", "bare-range", None), (None, "chapter-verse", None),
])
def test_headers(spark, line, shape, want):
    from lectern.functions import headers

    got = one(spark, headers.parse_header(F.col("s"), shape, F.lit("PHM"), F.lit(9), CANON), line)
    assert (got and (got["book"], got["cs"], got["vs"], got["ce"], got["ve"], got["glitched"])) == want
    without = one(spark, headers.parse_header(F.col("s"), shape, F.lit(None).cast("string"), F.lit(None).cast("int"), CANON), line)
    assert (without is not None) == (shape == "book-chapter-verse")


def test_chapter_headers_and_snippets(spark):
    from lectern.functions import headers

    assert one(spark, headers.chapter_header(F.col("s")), " Cap. iv. ") == 4 and one(spark, headers.chapter_header(F.col("s")), "Chapter IV verse") is None
    assert [tuple(p) for p in one(spark, notes.snippet_parts(F.col("s")), "a ⟦b⟧ c")] == [("a ", False), ("b", True), (" c", False)]
    assert one(spark, notes.plain_bibliography(F.array("s", F.lit("B *T*"))), "A *T*") == "A T\n\nB T"


def test_reviews_are_kept_as_corrections(spark):
    from lectern.operators import validation

    kinds = "excerpt_id int, book string, cs int, vs int, ce int, ve int, flagged boolean, header string, text string"
    rows = spark.createDataFrame([(1, "A", 1, 1, 1, 1, True, None, "t"), (2, "A", 2, 1, 2, 1, True, "h", "u"), (3, "A", 3, 1, 3, 1, True, "h", "v")], kinds)
    reviews = spark.createDataFrame([(1, "confirm", None, None, None, None, None, 1), (2, "discard", "B", 1, 1, 1, 1, 1), (2, "reassign", "B", 9, 8, 9, 8, 2)], "excerpt_id int, action string, book string, cs int, vs int, ce int, ve int, position int")
    after, corrections = validation.reviewed(rows, reviews)
    assert [(r["book"], r["cs"], r["flagged"]) for r in after.orderBy("excerpt_id").collect()] == [("A", 1, False), ("B", 9, False), ("A", 3, True)]
    again = rows.withColumn("hash", validation.content_hash(F.coalesce("header", F.lit("")), F.col("text")))
    assert sorted(r["action"] for r in again.join(corrections.select("hash", "action"), "hash").collect()) == ["confirm", "reassign"]
    assert validation.reviewed(rows.limit(0), reviews)[0].count() == 0


def test_note_and_file_listings(spark, tmp_path):
    files = spark.createDataFrame([("v/notes/b.md", "# Title\nx"), ("v/notes/a.md", "---\ntags: [t]\n---\nx"), ("v/notes/deep/c.md", "x")], "path string, text string")
    got = markdown.standalone_notes(files, "v/notes/").orderBy("title").collect()
    assert [(r["title"], r["tags"]) for r in got] == [("Title", []), ("a", ["t"])]
    side = spark.createDataFrame([("k", '[{"id":"1"},{"id":"2"}]'), ("m", "{bad"), ("n", None)], "key string, json string")
    assert [r["highlight"]["id"] for r in markdown.highlights(side, "struct<id:string>").collect()] == ["1", "2"]
    for name in ("a.pdf", "b/C.PDF", ".hidden/d.pdf", "cache/e.pdf", "b/f.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = markdown.list_pdfs(spark, str(tmp_path), ["cache"]).collect()
    assert sorted(r["path"].removeprefix(str(tmp_path)) for r in found) == ["/a.pdf", "/b/C.PDF"] and {r["size"] for r in found} == {5}


def test_contents_say_where_books_begin(spark, tmp_path):
    import zipfile

    from lectern.sources import epub

    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("OEBPS/toc.ncx", '<navMap><navPoint><navLabel><text>Preface</text></navLabel><content src="p.html"/><navPoint><navLabel><text> John </text></navLabel><content src="t/jn%201.html#x"/></navPoint></navPoint></navMap>')
        z.writestr("OEBPS/nav.xhtml", '<nav epub:type="toc"><a href="t/jn%201.html">John 1</a><a href="ph.html"><b>Philemon</b></a></nav><nav><a href="no.html">John</a></nav>')
    (tmp_path / "broken.epub").write_bytes(b"PK no archive")
    got = {(r["name"], r["book"]) for r in epub.starts(spark, str(tmp_path), CANON).collect()}
    assert got == {("OEBPS/t/jn 1.html", "JHN"), ("OEBPS/ph.html", "PHM")}


def _written(spark, column):
    """What Spark makes of an expression over s, as text."""
    return spark.range(1).selectExpr("cast(id AS string) AS s").select(column.alias("r"))._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_headers_are_matched_once(spark):
    from lectern.functions import headers

    assert _written(spark, names.parse_file_name(F.col("s"))).count("regexp_extract(") == 2  # one for each side of the dash
    for shape in headers.SHAPES:
        assert _written(spark, headers.parse_header(F.col("s"), shape, F.lit("PHM"), F.lit(9), CANON)).count("regexp_extract(") <= 4


def test_many_files_of_one_name(spark):
    import time

    from lectern.operators.reconcile import matched_names

    names_, files = spark.range(100_000).selectExpr("id", "'same' AS key"), spark.range(100_000).selectExpr("id + 5 AS position", "concat('f', id) AS file", "'same' AS key")
    began = time.monotonic()
    assert matched_names(names_, files).where("file = 'f0'").count() == 100_000
    assert time.monotonic() - began < 100  # no pairs of them are made
