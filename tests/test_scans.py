"""Scans over ranges, exact medians, and the reader of headings, each against a plain loop, with one key of most rows."""

import random
import re
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.functions.references import Book
from lectern.operators import normalise, reader, scans, upkeep, validation
from lectern.sources import scanned


def hot(n, seed=3):
    """Keys of which one, and a null one, have nearly all rows."""
    rng = random.Random(seed)
    return [(rng.choices(["hot", None, "a", "b"], [90, 6, 3, 1])[0], i, rng.choice([None, 1, 2, 3]), rng.randint(-5, 5)) for i in range(n)]


def test_scans_equal_loops_and_are_spread(spark):
    rows = hot(4000)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, v int, w int").repartition(5)
    ranged = scans.in_ranges(df, ["k"], ["at"], 8)
    sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(rows) / 8
    out = scans.scanned(ranged, ["k"], ["at"], previous={"p": F.col("v")}, last={"l": F.col("v")}, total={"t": F.col("w"), "n": F.lit(1)}).collect()
    want, state = {}, defaultdict(lambda: (None, None, 0, 0))
    for k, at, v, w in sorted(rows, key=lambda r: r[1]):
        before, last, total, n = state[k]
        last, total, n = v if v is not None else last, total + w, n + 1
        want[k, at] = (before, last, total, n)
        state[k] = (v, last, total, n)
    assert {(r["k"], r["at"]): (r["p"], r["l"], r["t"], r["n"]) for r in out} == want
    assert scans.scanned(df.limit(0), ["k"], ["at"], total={"t": F.lit(1)}).count() == 0


def test_runs_and_sequence_on_a_huge_source(spark):
    rows = hot(3000)
    df = spark.createDataFrame(rows, "k string, at int, v int, w int")
    got = {(r["k"], r["at"]): r["run"] for r in validation.runs(df, "k", "at", "v", parts=6).collect()}
    state, want = {}, {}
    for k, at, v, _ in rows:
        run = state[k][1] + (v != state[k][0]) if k in state else 1
        state[k] = (v, run)
        want[k, at] = run
    assert got == want
    places = df.selectExpr("k AS source", "at", "coalesce(v, 0) AS book", "w + 6 AS chapter", "at % 7 AS verse")
    got = {r["at"]: r["out_of_sequence"] for r in validation.sequence_reasons(places, "source", "at", parts=6).collect()}
    last, want = {}, {}
    for k, at, v, w in rows:
        now = (v or 0, (w + 6) * 1000 + at % 7)
        want[at] = k in last and last[k][0] == now[0] and now[1] < last[k][1]
        last[k] = now
    assert got == want


@pytest.mark.parametrize("kind", ["few", "many", "ties", "wide"])
def test_medians_are_exact(spark, kind):
    rng = random.Random(kind)
    draw = {
        "few": lambda: rng.randint(0, 3), "many": lambda: rng.uniform(-1e6, 1e6), "ties": lambda: rng.choice([0.1, 0.1, 7.5]),
        "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-6, 12),
    }[kind]
    rows = [(k, float(draw())) for k, n in (("hot", 2501), ("even", 40), (None, 7), ("two", 2), ("one", 1)) for _ in range(n)] + [("hot", None), ("none", None)]
    got = {r["k"]: r["median"] for r in scans.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v")).collect()}
    by = defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(float(v))
    assert got == {k: statistics.median(v) for k, v in by.items()}


def test_gaps_don_t_span_them_all(spark):
    rows = spark.createDataFrame([("a", 1, 2, True), ("a", 2_000_000_000, 5, False), ("b", 3, 3, False)], "book string, cs int, ce int, flagged boolean")
    got = {r["book"]: (r["total"], r["flagged"], r["missing"], r["gaps"]) for r in validation.coverage(rows).collect()}
    assert got["a"][:3] == (2, 1, 2_000_000_000 - 4) and [tuple(g) for g in got["a"][3]] == [(3, 4), (6, 1_999_999_999)]
    assert got["b"] == (1, 0, 0, None)


def test_sections_equal_a_loop_in_many_parts(spark):
    rng = random.Random(5)
    rows, chapter = [], 1
    for i in range(3000):
        chapter = rng.choice([chapter, chapter, chapter + 1, rng.randint(1, 60)])
        rows.append((rng.choices(["hot", "b", None], [9, 1, 1])[0], i, rng.choice([None, chapter, chapter + rng.randint(-2, 3)])))
    df = spark.createDataFrame(rows, "k string, position int, chapter int").repartition(4)
    last, want = {}, {}
    for k, i, n in rows:
        want[i] = n is not None and (last.get(k) is None or last[k] <= n <= last[k] + 1)
        if want[i]:
            last[k] = n
    for parts in (1, 9):
        assert {r["position"]: r["opens"] for r in normalise.section_headings(df, ["k"], parts=parts).collect()} == want


def test_keys_of_one_part_are_read_at_once(spark, monkeypatch):
    """Only stretches of a key that others have stretches of too need a function of what came before (F16, F17)."""

    class Never:
        def __init__(self, *_):
            raise AssertionError("a stretch of a key of one part")

    chapters = (4, 5, 5, 9, None, 6)
    df = spark.createDataFrame([(k, i, c) for k in (*range(30), None) for i, c in enumerate(chapters)], "k int, position int, chapter int")
    monkeypatch.setattr(reader, "Stretch", Never)
    out = normalise.section_headings(df, ["k"], parts=1).collect()
    assert len(out) == len(chapters) * 31 and all(r["opens"] == (r["position"] in (0, 1, 2, 5)) for r in out)


def test_speculative_chapters_equal_a_loop_in_many_parts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(4000):
        what = rng.choices(["book", "chapter", "verse", "title", "body"], [1, 6, 30, 30, 30])[0]
        rows.append((rng.choices(["hot", "b"], [9, 1])[0], i, what, rng.choice([None, rng.randint(1, 30)]), rng.choice([None, 20, 20, 20])))
    df = spark.createDataFrame(rows, "k string, position int, what string, number int, last int").repartition(4)
    state, want = {}, {}
    for k, i, what, number, last in rows:
        chapter, seen = state.get(k, (None, False))
        most, moved = last or 10**9, False
        if what == "book":
            chapter, seen = 1, False
        elif what == "chapter" and number:
            seen, chapter = seen and chapter == min(number, most), min(number, most)
        elif what == "title" and seen and chapter:
            chapter, seen, moved = min(chapter + 1, most), False, True
        elif what == "verse":
            chapter = number or chapter
            seen = seen or chapter is not None
        state[k], want[i] = (chapter, seen), (chapter, moved)
    for parts in (1, 11):
        out = normalise.speculative_chapters(df, ["k"], parts=parts).collect()
        assert {r["position"]: (r["chapter"], r["advanced"]) for r in out} == want


def test_a_stretch_is_a_function_of_where_the_reader_was():
    """Packed stretches give, from every place, what reading heading by heading gives; also one after the other."""
    rng, lasts = random.Random(7), {"A": 9, "B": 30}
    for _ in range(150):
        hs = [
            rng.choice(
                [
                    reader.Heading("edges", rng.choice(["A", "B"]), rng.choice([None, 3, 4]), None, rng.choice([None, "A", "B"]), rng.choice([None, 5])),
                    reader.Heading("chapter", number=rng.randint(1, 40), again=rng.choice([None, 2, 35])),
                    reader.Heading("section", number=rng.randint(1, 6)),
                    reader.Heading("line", title=True, header=rng.choice([None, "bare"])),
                    reader.Heading("line", title=True),
                    reader.Heading("line", header="bare"),
                    reader.Heading("line", header="chaptered", number=rng.randint(1, 9)),
                ]
            )
            for _ in range(rng.randint(0, 7))
        ]
        cut = rng.randint(0, len(hs))
        packed = []
        for some in (hs[:cut], hs[cut:]):
            stretch = reader.Stretch([None, "A", "B"], lasts)
            for h in some:
                stretch.add(h)
            packed.append(stretch.packed())
        for book in (None, "A", "B"):
            for chapter in (None, *range(-1, 45)):
                for seen in (False, True):
                    place = reader.Place(book, chapter, seen)
                    for h in hs:
                        [(_, _, place, _)] = reader.read(place, h, 0, 0, lasts)
                    assert reader.after(packed[1], reader.after(packed[0], reader.Place(book, chapter, seen))) == place


def test_unread_verses_follow_in_many_parts(spark):
    rng, rows = random.Random(8), []
    for i in range(1500):
        vs = rng.randint(1, 20)
        rows.append((rng.choices(["hot", "b"], [9, 1])[0], i, rng.choice("AB"), 1, vs, rng.choice([1, 1, 2]), vs + rng.choice([0, 0, 3]), rng.random() < 0.6))
    df = spark.createDataFrame(rows, "k string, position int, book string, cs int, vs int, ce int, ve int, glitched boolean")
    before, want = {}, {}
    for k, i, book, cs, vs, ce, ve, glitched in rows:
        start = before[k][2] + 1 if glitched and k in before and before[k][:2] == (book, cs) else vs
        end = start if ve == vs else ve
        before[k], want[i] = (book, ce, end), (start, end)
    got = {r["position"]: (r["vs"], r["ve"]) for r in upkeep.repaired(df, ["k"], parts=7).collect()}
    assert got == want


# Scanned books

CANON = [Book("JAS", "James", 5, ("Jas",)), Book("ROM", "Romans", 16, ("Rom",)), Book("1TI", "1 Timothy", 6, ("1 Tim",))]
CHAPTERS = {b.code: b.chapters for b in CANON}
#: A header of each shape.
SAID = {
    "book-chapter-verse": lambda c, v: f"James {c}:{v} on it", "chapter-verse": lambda c, v: f"{c}:{v} on it",
    "chapter-verse-roman": lambda c, v: f"Chap. {'i ii iii iv v'.split()[c - 1]}. {v}", "bracket-number": lambda c, v: f"[{v}] on it",
    "paren-number": lambda c, v: f"{v}) on it", "word-label": lambda c, v: f"Verse {v}. on it", "phrase-label": lambda c, v: f"On faith: Verses {v}", "bare-range": lambda c, v: f"{v}. on it",
}


def book_lines(source, shape, pages, seed):
    """Lines of a scanned book: running heads, chapters' headings, titles that can't be read, headers, and text."""
    rng, out, verse = random.Random(seed), [], 0
    for page in range(1, pages + 1):
        rows = [(rng.choice([f"{page} JAMES", f"JAMES 2:{page}", "ON 1 TIMOTHY", f"{page} JAMES"]), 9.0, 50.0, False)]
        for _ in range(rng.randint(3, 9)):
            what = rng.choices(["text", "header", "chapter", "title", "fake"], [8, 4, 1, 1, 1])[0]
            verse = rng.randint(1, 25)
            if what == "header":
                said = SAID[shape](rng.randint(1, 5), "l" if rng.random() < 0.2 and shape in ("bracket-number", "paren-number", "bare-range") else verse)
                rows.append((said, rng.choice([12.0, 12.3]), 70.0, True))
            elif what == "chapter":
                rows.append((rng.choice(["Chapter III", "CHAPTER Vl", "Cap. iv.", "Chap. LX"]), 16.0, 60.0, False))
            elif what == "title":
                rows.append((rng.choice(["CHAPTER |", "Chapter I1"]), 16.0, 60.0, False))
            elif what == "fake":
                rows.append((SAID[shape](2, verse), 10.0, 50.0, False))
            else:
                rows.append((rng.choice(["plain words of a text", "and more of them", "as it says"]), 10.0, 50.0, rng.random() < 0.1))
        rows.append((f"foot {page}", 8.0, 50.0, False))
        out += [(source, page, i, *r) for i, r in enumerate(rows)]
    return out


SCHEMA = "source string, page int, line int, text string, size double, x double, multi_font boolean"
NUMBER = r"(?:\d{1,3}|[lLI|\]]{1,2})"
PATTERNS = {
    "chapter-verse": r"\(?(\d{1,3})\s*:\s*(\d{1,3})", "chapter-verse-roman": r"(?i)\(?(?:Chapter|Chap\.?|Cap\.?)?\s*([ivxlcdm]+)\b[.,]?\s*(?:vers\.?|vv?\.?)?\s*(\d{1,3})",
    "bracket-number": rf"()\[({NUMBER})(?:\s*-\s*{NUMBER})?\]", "paren-number": rf"()({NUMBER})(?:\s*-\s*{NUMBER})?\)", "word-label": rf"(?i)()(?:Verses?|Vers|Vv|V)\.?\s+({NUMBER})",
    "phrase-label": rf"(?i)()[^:\n]{{1,80}}:\s*(?:Verses?|Vers|Vv|V)\.?\s+({NUMBER})", "bare-range": rf"()({NUMBER})(?:\s*-\s*{NUMBER})?\.",
}
ROMANS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5}


def header_of(text, shape):
    """(book, chapter, verse, whether it could be read) of a header in a shape; none of these books has ranges."""
    if shape == "book-chapter-verse":
        m = re.match(r"(James|Jas|Romans|Rom|1 Timothy|1 Tim)\b\.?\s+(\d{1,3})(?::(\d{1,3}))?", text)
        code = m and next(b.code for b in CANON if m[1] in (b.name, *b.abbreviations))
        return (code, int(m[2]), int(m[3] or 1), True) if m and 1 <= int(m[2]) <= CHAPTERS[code] else None
    m = re.match(PATTERNS[shape], text)
    if not m:
        return None
    chapter = ROMANS.get(m[1].lower()) if shape == "chapter-verse-roman" else int(m[1]) if m[1] else None
    if shape == "chapter-verse-roman" and chapter is None:
        return None
    return None, chapter, int(m[2]) if m[2].isdigit() else 1, m[2].isdigit()


def loop_profile(rows):
    pages = sorted({r[1] for r in rows})
    if len(pages) > 40:
        pages = pages[int(len(pages) * 0.1) :]
        pages = pages[:: max(1, len(pages) // 40)][:40]
    sample = [r for r in rows if r[1] in set(pages)]
    best, headers = scanned.ALL_SHAPES[0], []
    for shape in scanned.ALL_SHAPES:
        found = [r for r in sample if header_of(r[3].strip(), shape)]
        if 3 <= len(found) < len(sample) / 2 and len(found) > len(headers):
            best, headers = shape, found
    body = [r for r in sample if not headers or not header_of(r[3].strip(), best)]
    middle = lambda rows, c: statistics.median(r[c] for r in rows) if rows else 0
    share = lambda rows: sum(r[6] for r in rows) / len(rows) if rows else 0
    return best, len(sample), len(headers), middle(headers, 4), middle(body, 4), middle(headers, 5), middle(body, 5), share(headers), share(body)


def loop_excerpts(rows, profile, begins):
    """A source's excerpts, one line after the other."""
    shape, _, _, hs, bs, hx, bx, hf, bf = profile
    pages = defaultdict(list)
    for r in rows:
        pages[r[1]].append(r)
    key = lambda t: re.sub(r"\d+", "#", t.strip())
    capital = lambda t: re.sub("[A-Za-z]+", lambda m: m[0].capitalize(), t)
    tops, bottoms = {p: key(v[0][3]) for p, v in pages.items()}, {p: key(v[-1][3]) for p, v in pages.items()}
    count = lambda keys: {k for k in keys if 2 * sum(x == k for x in keys) >= len(pages) >= 3}
    running = count(list(tops.values())), count([b if b != tops[p] else None for p, b in bottoms.items()])
    book, chapter, seen, out = begins, None, False, []
    for page in sorted(pages):
        for keys, line in ((tops, pages[page][0]), (bottoms, pages[page][-1])):
            if sum(keys.get(p) == keys[page] for p in range(page - 8, page + 9)) - 1 < 3:
                continue
            text = capital(line[3]).strip()
            place = header_of(text, "book-chapter-verse")
            named = re.search(r"\b(James|Romans|1 Timothy)$", text)
            named = named and next(b.code for b in CANON if b.name == named[1])
            if place:
                seen = seen and (book, chapter) == place[:2]
                book, chapter = place[:2]
                break
            if named and named != book:
                book, chapter, seen = named, 1, False
                break
        for n, (_, _, _, text, size, x, fonts) in enumerate(pages[page]):
            if n == 0 and tops[page] in running[0] or n == len(pages[page]) - 1 and bottoms[page] in running[1]:
                continue
            last = CHAPTERS.get(book, 10**9)
            m = re.match(r"(?i)(?:chapter|chap\.?|cap\.?)\s+([ivxlcdm]+)\.?$", text.strip())
            if m:
                number = {"iii": 3, "vl": 45, "iv": 4, "lx": 60}[m[1].lower()]
                if number > last:
                    number = 6 if m[1].lower() == "vl" and last >= 6 else last
                seen, chapter = seen and chapter == number, number
                continue
            if size > bs + 3 and re.match(r"(?i)(chapter|chap\.?|cap\.?)\s+\S+$", text.strip()) and chapter is not None and seen:
                chapter, seen = min(chapter + 1, last), False
                continue
            found = header_of(text.strip(), shape)
            styled = abs(hs - bs) > 0.75 and abs(size - hs) <= 0.75 or abs(hx - bx) > 4 and abs(x - hx) <= 4 or abs(hf - bf) > 0.3 and fonts == (hf > 0.5)
            if found and styled and (found[0] or book) and (found[1] or chapter is not None):
                book, chapter, seen = found[0] or book, found[1] or chapter, True
                before = out[-1] if out else None
                follows = not found[3] and before and before[2:4] == [book, chapter]
                out.append([page, text, book, chapter, before[4] + 1 if follows else found[2], []])
            elif out:
                out[-1][5].append(text)
    return [(i + 1, p, h, b, c, v, c, v, "\n".join(t)) for i, (p, h, b, c, v, t) in enumerate(out)]


@pytest.fixture(scope="module")
def shelf():
    """A source of each shape, one of them with most of the lines, and one without headers."""
    rows = {shape: book_lines(shape, shape, 30 + 17 * i, i) for i, shape in enumerate(scanned.ALL_SHAPES)}
    rows["bracket-number"] = book_lines("bracket-number", "bracket-number", 700, 99)
    rows["none"] = [("none", 1, i, "just a text", 10.0, 50.0, False) for i in range(9)]
    return rows


def test_scanned_books_equal_a_loop(spark, shelf):
    lines = spark.createDataFrame([r for rows in shelf.values() for r in rows], SCHEMA).repartition(5)
    found = scanned.profiles(lines, CANON, parts=5).collect()
    want = {source: loop_profile(rows) for source, rows in shelf.items()}
    names = ("shape", "lines", "headers", "header_size", "body_size", "header_x", "body_x", "header_fonts", "body_fonts")
    assert {r["source"]: tuple(r[c] for c in names) for r in found} == want
    assert all(want[s][0] == s for s in scanned.ALL_SHAPES)

    books = spark.createDataFrame([(s, "JAS") for s in shelf if s != "paren-number"], "source string, first_book string")
    made = scanned.excerpts(lines, spark.createDataFrame(found), CANON, books, parts=12).collect()
    got = defaultdict(list)
    for r in made:
        got[r["source"]].append(tuple(r[c] for c in ("position", "page", "header", "book", "cs", "vs", "ce", "ve", "text")))
    for source, rows in shelf.items():
        assert sorted(got[source]) == loop_excerpts(rows, want[source], None if source == "paren-number" else "JAS"), source
    assert len(got["bracket-number"]) > 300 and not got["none"]


def test_scanned_lines_are_read_twice(spark, shelf):
    """Once for their pages' edges and once for themselves; edges were made anew by each step that reads them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    rows = shelf["word-label"] + shelf["paren-number"]
    lines = spark.createDataFrame(rows, SCHEMA)
    found = spark.createDataFrame(scanned.profiles(lines, CANON).collect())
    books = spark.createDataFrame([("word-label", "JAS"), ("paren-number", "JAS")], "source string, first_book string")
    told = lines.withColumn("text", F.udf(counted, "string").asNondeterministic()("text"))
    assert scanned.excerpts(told, found, CANON, books).count() > 0
    assert 0 < seen.value <= 2 * len(rows)


def test_profile_samples_and_empty_tables(spark, shelf):
    lines = spark.createDataFrame(shelf["word-label"] + shelf["none"], SCHEMA)
    found = scanned.profiles(lines, CANON)
    out = sorted(map(tuple, scanned.profile_samples(lines, found, CANON).collect()))
    shown = [r for r in shelf["word-label"] if header_of(r[3], "word-label")]
    pages = sorted({r[1] for r in shelf["word-label"]})
    used = pages if len(pages) <= 40 else pages[int(len(pages) * 0.1) :][:: max(1, (len(pages) - int(len(pages) * 0.1)) // 40)][:40]
    shown = [r for r in shown if r[1] in used][:10]
    behind = lambda r: " ".join(x[3] for x in shelf["word-label"] if x[1] == r[1] and r[2] < x[2] <= r[2] + 2)[:150]
    assert out == sorted((r[0], r[1], r[2], r[3], behind(r)) for r in shown)
    none = lines.limit(0)
    assert scanned.profiles(none, CANON).count() == 0
    assert scanned.excerpts(none, found, CANON).count() == 0
