"""Upkeep, scanned chapters and small stores on small cases, several against plain Python."""

import json
import random

from pyspark.sql import functions as F

from lectern.functions import notes
from lectern.operators import normalise, search, upkeep
from lectern.plans.queries import QUERIES
from lectern.sources import stores

SF = "/root/testdata/sf0.001"


def test_paths_stay_in_the_vault(spark):
    cases = {
        "notes/a.md": "/d/vault/notes/a.md", "": None, ".": None, "../vault/a": "/d/vault/a", "../vault-x/a": None, "../..": None,
        "/etc/passwd": "/d/vault/etc/passwd", "a/../..": None, "..a": None, "a/./b//c": "/d/vault/a/b/c", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", upkeep.within_vault("/d/vault", F.col("p")).alias("x"))
    assert {r["p"]: r["x"] for r in rows.collect()} == cases


def test_marks_of_a_line(spark):
    texts = ["*A* b [c d] e", "", "**x** ~~y~~*z*", "a ** b", "*", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(notes.citation_parts(F.col("t")).alias("c"), notes.styled_parts(F.col("t")).alias("s")).collect()
    plain = lambda parts: None if parts is None else [tuple(p) for p in parts]
    assert plain(found[0]["c"]) == [("italic", "A"), ("text", " b "), ("missing", "[c d]"), ("text", " e")]
    assert plain(found[1]["s"]) == []
    assert plain(found[2]["s"]) == [("bold", "x"), ("text", " "), ("struck", "y"), ("italic", "z")]
    assert plain(found[3]["s"]) == [("text", "a ** b")]


def test_new_notes(spark):
    asked = spark.createDataFrame([("A/b", "x", "s1"), ("", None, "s2"), (None, "project", "s3")], "title string, type string, suffix string")
    there = spark.createDataFrame([("notes/standalone/A-b.md",), ("notes/standalone/A-b.md",)], "path string")
    rows = {r["path"]: r for r in upkeep.new_notes(asked, there, ["note", "project"]).collect()}
    assert set(rows) == {"notes/standalone/A-b-s1.md", "notes/standalone/Untitled.md"}
    assert rows["notes/standalone/A-b-s1.md"]["text"] == "---\ntitle: A/b\ntype: note\n---\n\n# A/b\n\n"


def _repaired(rows):
    out, before = [], None
    for book, c, vs, ve, bad in rows:
        start = before[2] + 1 if bad and before and before[:2] == (book, c) else vs
        end = start if ve == vs else ve
        out.append((start, end))
        before = (book, c, end)
    return out


def test_repaired_is_the_walk(spark):
    rng = random.Random(4)
    rows = []
    for k in range(30):
        for i in range(rng.randrange(1, 25)):
            vs = rng.randrange(1, 9)
            c = i // 9
            rows.append((k, i, rng.randrange(2) if k % 2 else 1, c, vs, c, vs + rng.choice([0, 0, 2]), rng.random() < 0.6))
    df = spark.createDataFrame(rows, "k int, position int, book int, cs int, vs int, ce int, ve int, glitched boolean")
    found = {(r["k"], r["position"]): (r["vs"], r["ve"]) for r in upkeep.repaired(df, ["k"]).collect()}
    for k in range(30):
        mine = [r for r in rows if r[0] == k]
        for r, want in zip(mine, _repaired([(r[2], r[3], r[4], r[6], r[7]) for r in mine])):
            assert found[k, r[1]] == want


def test_chapters_of_titles(spark):
    lines = [("title", None), ("book", None), ("title", None), ("verse", None), ("title", None), ("title", None), ("verse", None),
             ("chapter", 2), ("title", None), ("chapter", 9), ("verse", None), ("title", None), ("verse", 7), ("body", None)]
    df = spark.createDataFrame([(1, i, w, n, 3) for i, (w, n) in enumerate(lines)], "k int, position int, what string, number int, last int")
    rows = sorted(normalise.speculative_chapters(df, ["k"]).collect(), key=lambda r: r["position"])
    assert [r["chapter"] for r in rows] == [None, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 7, 7]
    assert [r["position"] for r in rows if r["advanced"]] == [4, 8, 11]
    assert normalise.speculative_chapters(df.limit(0), ["k"]).count() == 0


def test_stores(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "page": 1}, {"id": "b", "page": None}], indent=2))
    (tmp_path / "m.json").write_text(json.dumps({"x.md": 1.5, "y.md": 2}, indent=2))
    (tmp_path / "bad.json").write_text("[{")
    kinds = "id string, page int"
    rows = stores.read_records(spark, str(tmp_path / "c.json"), kinds)
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("a", 1), ("b", None)]
    assert {tuple(r) for r in stores.read_map(spark, str(tmp_path / "m.json")).collect()} == {("x.md", 1.5), ("y.md", 2.0)}
    for path in ("bad.json", "none.json"):
        assert stores.read_records(spark, str(tmp_path / path), kinds).count() == 0
        assert stores.read_map(spark, str(tmp_path / path)).count() == 0
    stores.write_records(rows, str(tmp_path / "out"))
    assert {tuple(r) for r in stores.read_written(spark, str(tmp_path / "out"), kinds).collect()} == {("a", 1), ("b", None)}


def test_hits_in_a_book_go_round(spark):
    hits = spark.createDataFrame([("d3", "b", 3, -1.0), ("d1", "b", 1, -0.5), ("d2", "b", 2, -2.0)], "key string, book_id string, page long, rank double")
    rows = {r["key"]: r["following"] for r in search.by_page(hits).collect()}
    assert rows == {"d1": "d2", "d2": "d3", "d3": "d1"}
    found = QUERIES["fts12_in_book"](spark, SF).collect()
    keys = sorted((r["page"], r["key"]) for r in found)
    assert {r["key"]: r["following"] for r in found} == {k: keys[(i + 1) % len(keys)][1] for i, (_, k) in enumerate(keys)}


def test_contaminated_sources(spark):
    rows = [("bad", b, "x") for b in ["A"] * 9 + list("BCDD")] + [("good", b, "xy") for b in "AAABBBCCCDDD"] + [("two", "A", "x"), ("two", "B", "x")]
    found = {r["source"]: r for r in upkeep.yields(spark.createDataFrame(rows, "source string, book string, text string")).collect()}
    assert {k: r["contaminated"] for k, r in found.items()} == {"bad": True, "good": False, "two": False}
    assert found["good"]["mean_length"] == 2 and found["bad"]["excerpts"] == 13 and found["bad"]["books"] == 4


def test_renamed_shelves(spark):
    shelves = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "id int, name string")
    asked = spark.createDataFrame([(1, "B"), (2, " "), (3, "E"), (4, "E"), (9, "Z")], "id int, name string")
    assert {tuple(r) for r in upkeep.renamed(shelves, asked).collect()} == {(1, "A"), (2, "B"), (3, "E"), (4, "D")}


def test_video_citations(spark):
    from lectern.functions.citation import video_citation

    rows = spark.createDataFrame([(["Ann B. Lee", "C D"], 2001, "Ch", "u"), ([], None, "", None)], "a array<string>, y int, c string, u string")
    cited = lambda s: [r[0] for r in rows.select(video_citation(s, F.lit(" T "), F.col("a"), F.col("y"), F.col("c"), F.col("u"))).collect()]
    assert cited("footnote") == ['Ann B. Lee and C D, "T," video, Ch, 2001, u.', '[author], "T," video, [channel], [year].']
    assert cited("bibliography")[0] == 'Lee, Ann B. and C D, "T," video, Ch, 2001, u.'
    assert cited("author-date") == ["(Lee and D 2001)", "([author] [year])"]
