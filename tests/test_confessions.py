"""Confessions told apart by windows against a plain loop over the same paragraphs."""

import random
import re
from collections import Counter

from lectern.sources import confessions

TITLES = {"AC": ["Augsburg Confession"], "SC": ["Small Catechism", "Enchiridion"], "FC-EP": ["Epitome"], "FC-SD": []}
KINDS = [
    ("pt", "THE AUGSBURG CONFESSION (1530)"), ("ch_h", "Small Catechism"), ("pt", "THE FORMULA OF CONCORD"), ("pt", "[First Part]"), ("toc_head", "Second Part"),
    ("pt", "THE CONFESSION OF FAITH"), ("toc_head1", "Glossary"), ("tab_ti", "OUTLINE"), ("article", "ARTICLE IV"), ("ch_h1a", "Of Faith"), ("ch_h1b", "II."),
    ("ch_h1b", "Article IIIa The Holy Supper"), ("ch_h1b", "Conclusion"), ("ch_h", "EDITORS' INTRODUCTION"), ("heading2", "Editor's Introduction to it"), ("ch_h", "OF GOD"),
    ("toc_head", "OF SIN"), ("heading", "To the Christian Reader"), ("heading", "[14] Third"), ("txt_center", "Amen"), ("ch_note", "a remark"), ("noindent2", "Note: this"),
    ("pagebreak", "12"), ("p", "some text"), ("p", "more text"), ("noindent", "yet more"),
]


def plain(rows):
    """Counter of (document, opening, ordinal, number, label, kind, position)."""
    keys = {"augsburg confession": "AC", "ac": "AC", "small catechism": "SC", "sc": "SC", "enchiridion": "SC", "epitome": "FC-EP", "fc-ep": "FC-EP", "fc-sd": "FC-SD"}
    out, waiting = [], []
    doc = section = article = former = None
    title, opening, ordinal, intro, fresh = "", 0, 0, False, False

    def show(s):
        return " ".join(w.capitalize() if not re.fullmatch("[IVXLCDM]+\\.?", w) else w for w in s.split(" ")) if s == s.upper() else s

    def begin(label, number, at):
        nonlocal section, ordinal, waiting
        ordinal += 1
        section = (doc, opening, ordinal, number, show(re.sub("^\\[[0-9]+\\] ", "", label)))
        out.append((*section, "section", at))
        if ordinal == 1:
            out.extend((*section, "note", w) for w in waiting)
            waiting = []

    def note(at):
        waiting.append(at) if section is None else out.append((*section, "note", at))

    for at, (cls, text) in enumerate(rows):
        if cls == "pagebreak":
            continue
        if cls == "toc_head1":
            doc, section, intro = None, None, False
            continue
        was_fresh, fresh = fresh, False
        if cls == "tab_ti":
            intro = True
        elif cls == "article":
            article = re.sub("(?i)^article ", "", text)
        elif cls == "txt_center":
            if section:
                out.append((*section, "body", at))
            elif intro:
                waiting.append(at)
        elif cls == "ch_h1a" and article:
            begin(text, article, at)
            article = None
        elif cls == "ch_h1b" and text == "II.":
            begin(text, None, at)
        elif cls == "ch_h1b" and text.startswith("Article"):
            begin("The Holy Supper", "IIIA", at)
        elif cls in ("toc_head", "pt", "heading", "heading2") or cls.startswith("ch_h"):
            key = re.sub(r" \(\d+\)$", "", re.sub("^the ", "", text.strip("[]").lower() if text[0] == "[" and "]" == text[-1] else text.replace("[", "").replace("]", "").lower()))
            half = {"first part": "FC-EP", "second part": "FC-SD"}.get(key) if former == "formula of concord" else None
            former = key
            code = half or keys.get(key)
            if code:
                intro = False
                if half or code != doc:
                    doc, section, title, ordinal, fresh = code, None, text, 0, True
                    opening += 1
            elif cls == "pt":
                pass
            elif key.startswith("editor"):
                intro = intro or re.match("editor('?s|ial)? introduction", key) is not None
                if not re.match("editor('?s|ial)? introduction", key) and not was_fresh:
                    intro = intro and cls != "ch_h"
                    waiting.append(at) if intro else begin(text, None, at)
            elif was_fresh:
                pass
            elif intro and not (key == "to the christian reader" or cls == "ch_h" and text == text.upper()):
                waiting.append(at)
            else:
                intro = False
                begin(text, None, at)
        elif cls == "ch_note" or text.startswith("Note:"):
            note(at)
        elif section:
            out.append((*section, "body", at))
        elif intro:
            waiting.append(at)
        elif doc:
            begin(title, None, at)
            out.append((*section, "body", at))
    return Counter(x for x in out if x[0])


def test_as_a_plain_loop(spark):
    rng = random.Random(3)
    books = {b: [rng.choice(KINDS if b % 2 else KINDS[:2] + KINDS[10:]) for _ in range(rng.choice([0, 1, 30, 200]))] for b in range(40)}
    rows = spark.createDataFrame([(b, i, c, t) for b, ps in books.items() for i, (c, t) in enumerate(ps)], "book int, position int, class string, text string")
    found = confessions.lines(rows, TITLES, ["position"]).collect()
    for b, ps in books.items():
        have = Counter((r.document, r.opening, r.ordinal, r.number, r.label, r.kind, r.position) for r in found if r.book == b)
        want = plain(ps)
        assert have == want, (b, sorted(map(str, have - want))[:4], sorted(map(str, want - have))[:4], ps[:12])
    assert len(found) > 1000


def test_parts_and_paragraphs(spark):
    html = """<html><head><p class="p">head</p></head><body class="x"><p class="pt">The<br class="y"/>Augsburg &amp; Confession</p><p>no class</p>
    <p class="pt">Augsburg Confession</p><p class="ch_h">A subtitle</p><P CLASS="ch_h">CHIEF <b>ARTICLES</b></P><p class="ch_h1b">I.</p><p class="p"> one
    line </p><p class="p"> </p><p class="ch_note">aside</p></body></html>"""
    pages = spark.createDataFrame([(1, 1, html), (1, 2, ""), (1, 3, None)], "book int, page int, html string")
    ps = confessions.paragraphs(pages)
    assert [(r["class"], r.text) for r in ps.orderBy("page", "place").collect()] == [
        ("pt", "The Augsburg & Confession"), ("pt", "Augsburg Confession"), ("ch_h", "A subtitle"), ("ch_h", "CHIEF ARTICLES"), ("ch_h1b", "I."), ("p", "one line"), ("ch_note", "aside"),
    ]
    lines = confessions.lines(ps, TITLES, ["page", "place"])
    made = confessions.sections(lines).orderBy("ordinal").collect()
    assert [(r.document, r.ordinal, r.label, r.part, r.paragraphs, r.notes) for r in made] == [("AC", 1, "Chief Articles", None, 0, 0), ("AC", 2, "I.", "Chief Articles", 1, 1)]
    assert confessions.lines(ps.limit(0), TITLES, ["page", "place"]).count() == 0


def test_books_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """A task's windows hold no more than some paragraphs, however many books there are (F15)."""
    rows = [(b, i, *KINDS[(b + i) % len(KINDS)]) for b in range(8) for i in range(25)]
    df = spark.createDataFrame(rows, "book int, position int, class string, text string")
    out = lambda: confessions.lines(df, TITLES, ["position"])
    before = Counter(map(str, out().collect()))
    monkeypatch.setattr(confessions, "ROWS", 20, raising=False)
    kept = sum(r[2] not in confessions.SILENT for r in rows)
    plan = out()._jdf.queryExecution().toString()
    assert f"{1 + kept // 20}), REPARTITION_BY_NUM" in plan or f"{1 + kept // 20}]" in plan and "REPARTITION_BY_NUM" in plan
    assert Counter(map(str, out().collect())) == before
