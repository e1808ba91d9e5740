"""A collection of confessions as an EPUB's paragraphs, told apart by their classes: documents, sections, texts and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.names import all_caps, display_label, heading_key, without_article, without_marker
from lectern.functions.text import WS, strip

# Classes of the layout without text of the work, and phrases of its headings.
SILENT = [
    "pagebreak", "com_img", "tit_img1", "img_cap_line", "antx-caption", "p_cap", "line_img", "line_img1", "line_img2",
    "tab_num", "tab_txt", "toc1", "toc2", "title_rev", "image1",
]
BODY_PHRASES = ["to the christian reader"]
EDITORS = ["editor", "editors", "editor's", "editorial"]
TWO_PART_TITLE = "formula of concord"
PARTS = {"first part": "FC-EP", "second part": "FC-SD"}
#: Paragraphs in a task, about: all windows over a book keep its rows at once, some 3 KB for each.
ROWS = 1 << 17


def paragraphs(pages: DataFrame) -> DataFrame:
    """(book, page, place, class, text) of the <p class=...> of pages(book, page, html); those without text go."""
    body = F.regexp_replace("html", "(?is)^.*?<body[^>]*>|</body>.*\\z", "")
    ends = F.filter(F.split(body, "(?i)</p>", -1), lambda x: x.rlike("(?is)<p\\b[^>]*\\bclass=\"[A-Za-z0-9_-]+\"[^>]*>"))
    rows = pages.select("book", "page", F.posexplode(ends).alias("place", "p"))
    opening = '(?is)<p\\b[^>]*\\bclass="([A-Za-z0-9_-]+)"[^>]*>(.*)\\z'
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract("p", opening, 2), "(?i)<br\\b[^>]*>", " "), "(?s)<[^>]*>", "")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(mark))
    text = strip(F.regexp_replace(plain, f"{WS}+", " "))
    return rows.select("book", "page", "place", F.regexp_extract("p", opening, 1).alias("class"), text.alias("text")).where("text <> ''")


def _code(titles: dict[str, list[str]], key: Column) -> Column:
    """The document of a heading's key in lower case, the later one where two have the same title; null if none."""
    pairs = [F.struct(F.lower(heading_key(F.lit(n))).alias("k"), F.lit(code).alias("v")) for code, names in titles.items() for n in (code, *names)]
    return F.try_element_at(F.filter(F.array(*pairs), lambda p: p["k"] == key), F.lit(-1))["v"]


def _is_roman(word: Column) -> Column:
    """Whether a word is made of letters of roman numerals, in either case."""
    return (word != "") & (F.translate(F.upper(word), "IVXLCDM", "") == "")


def _is_number(word: Column) -> Column:
    """Whether a word is a number in roman letters or in digits, with a full stop or none."""
    bare = F.when(F.endswith(word, F.lit(".")), F.left(word, F.length(word) - 1)).otherwise(word)
    return _is_roman(bare) | (bare != "") & (F.translate(bare, "0123456789", "") == "")


def lines(paragraphs: DataFrame, titles: dict[str, list[str]], order: list[str], key: str = "book") -> DataFrame:
    """(key, order, document, opening, ordinal, number, label, kind, text) of paragraphs(key, order, class, text).

    Each row is a section's heading ('section'), a paragraph of its text ('body') or a note to it ('note'). titles gives
    the spellings of each document's title by code. Which paragraph does what:

    - A title opens its document; under the title of a work in two parts, the name of a part does. The open document's
      title once more ends its introduction. 'toc_head1' closes it: nothing belongs to it until another one opens.
    - The heading right behind an opening is a subtitle. Other headings open sections, but for those of class 'pt', and
      in an introduction, whose headings are notes until one of class 'ch_h' in capitals or one of BODY_PHRASES ends it.
    - 'article' gives the number of the 'ch_h1a' behind it; a 'ch_h1b' may be a number, or have one before its label.
    - Other paragraphs are the open section's text, or its notes by class or 'Note:'. Text without a section opens one
      under the document's title; that of an introduction is notes, and they go with the first section that opens next.

    What a paragraph does hangs on the last event of each kind before it, never on a state that has to be run through,
    so all is windows over a book in its order. Text outside all documents goes. opening counts the openings. Books are
    dealt to as many tasks as their paragraphs need (ROWS), which are counted before; a book is in one task.
    """
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    step = Window.partitionBy(key).orderBy(*order)
    last = lambda what, window: F.last(what, ignorenulls=True).over(window)
    yes = lambda c: F.coalesce(c, F.lit(False))
    cls, text = F.col("class"), F.col("text")

    rows = paragraphs.where(~cls.isin(*SILENT))
    rows = rows.repartition(1 + rows.count() // ROWS, key).withColumn("_at", F.row_number().over(step))
    # Headings with a number of their own.
    rows = rows.withColumn("_article", last(F.when(cls == "article", F.struct("_at", "text")), before))
    rows = rows.withColumn("_h1a", last(F.when(cls == "ch_h1a", F.col("_at")), before))
    waiting = (cls == "ch_h1a") & F.col("_article").isNotNull() & (F.col("_article._at") > F.coalesce("_h1a", F.lit(0)))
    words = F.split("text", " ")  # texts have single blanks
    bare = (cls == "ch_h1b") & (F.size(words) == 1) & _is_number(text)
    nth = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    numbered = _is_roman(nth) | _is_roman(F.left(nth, F.length(nth) - 1)) & F.right(nth, F.lit(1)).rlike("[A-Za-z]")
    joined = (cls == "ch_h1b") & (F.size(words) > 2) & (F.lower(F.get(words, F.lit(0))) == "article") & numbered
    rows = rows.withColumn("_numbered", yes(waiting | bare | joined))
    number = F.when(waiting, without_article(F.col("_article.text"))).when(joined & ~bare, F.upper(nth))
    named = F.when(joined & ~bare & ~waiting, F.array_join(F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), " ")).otherwise(text)
    rows = rows.withColumns({"_number": number, "_named": named})
    # Titles of documents.
    heading = (cls.isin("toc_head", "pt", "heading") | cls.rlike("^ch_h|^heading[0-9]")) & ~F.col("_numbered")
    rows = rows.withColumn("_key", F.when(heading, F.lower(heading_key(text))))
    rows = rows.withColumn("_former", last("_key", before))
    part = F.when(F.col("_former") == TWO_PART_TITLE, F.try_element_at(F.create_map(*(F.lit(x) for p in PARTS.items() for x in p)), F.col("_key")))
    rows = rows.withColumn("_part", part).withColumn("_code", F.coalesce(F.col("_part"), _code(titles, F.col("_key"))))
    told = F.when(cls == "toc_head1", F.struct(F.lit(None).cast("string").alias("code"))).when(F.col("_code").isNotNull(), F.struct(F.col("_code").alias("code")))
    rows = rows.withColumn("_told", told)
    rows = rows.withColumn("_open", yes(F.col("_code").isNotNull() & (F.col("_part").isNotNull() | ~F.col("_code").eqNullSafe(last("_told", before)["code"]))))
    rows = rows.withColumn("document", last("_told", upto)["code"])
    rows = rows.withColumn("opening", F.sum(F.col("_open").cast("int")).over(upto))
    rows = rows.withColumn("_stretch", F.sum((F.col("_open") | (cls == "toc_head1")).cast("int")).over(upto))
    rows = rows.withColumn("_title", last(F.when(F.col("_open"), text), upto))
    rows = rows.withColumn("_fresh", yes(last(F.when(cls != "toc_head1", F.col("_open")), before)))
    # Introductions: the last paragraph that says so.
    free = F.col("_key").isNotNull() & F.col("_code").isNull() & (cls != "pt")
    said = F.split(F.lower(heading_key(text)), " ")
    second = F.substring_index(F.translate(F.get(said, F.lit(1)), ".,;-", "    "), " ", 1)
    intro = free & F.get(said, F.lit(0)).isin(*EDITORS) & (second == "introduction")
    plain = free & ~intro & ~F.col("_fresh")
    starts = plain & (((cls == "ch_h") & all_caps(text)) | F.col("_key").isin(*BODY_PHRASES))
    turned = F.when(F.col("_code").isNotNull() | (cls == "toc_head1"), False).when(cls == "tab_ti", True).when(intro, True).when(starts, False)
    rows = rows.withColumn("_intro", F.coalesce(last(turned, upto), F.lit(False)))
    rows = rows.withColumn("_head", yes(F.col("_numbered") | (plain & ~F.col("_intro"))))
    # What stands in sections.
    rows = rows.withColumn("_aside", yes(plain & F.col("_intro")))
    other = F.col("_key").isNull() & ~F.col("_numbered") & ~cls.isin("toc_head1", "tab_ti", "article")
    note = cls.isin("ch_note", "note") | text.rlike("(?i)^\\[?note:")
    rows = rows.withColumn("_note", yes(other & (cls != "txt_center") & note)).withColumn("_text", yes(other & ((cls == "txt_center") | ~note)))
    within = Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opens_one = F.col("_text") & (cls != "txt_center") & ~F.col("_intro") & F.col("document").isNotNull()
    rows = rows.withColumn("_begun", F.min(F.when(F.col("_head") | opens_one, F.col("_at"))).over(within))
    rows = rows.withColumn("_implied", yes(opens_one & (F.col("_begun") == F.col("_at"))))
    rows = rows.withColumn("_section", F.col("_head") | F.col("_implied"))
    whole = Window.partitionBy(key, "opening").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_ordinal", F.sum(F.col("_section").cast("int")).over(whole))
    label = display_label(without_marker(F.when(F.col("_implied"), F.coalesce("_title", "document")).otherwise(F.col("_named"))))
    made = F.struct("document", "opening", F.col("_ordinal").alias("ordinal"), F.when(~F.col("_implied"), F.col("_number")).alias("number"), label.alias("label"))
    rows = rows.withColumn("_made", F.when(F.col("_section"), made))
    # Backwards, as a frame without an end would be gone through for each row.
    behind = Window.partitionBy(key).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    following = last(F.when(F.col("_section") & (F.col("_ordinal") == 1), F.col("_made")), behind)
    current = F.when(F.col("_begun").isNotNull(), last("_made", within))
    waits = F.col("_aside") | (F.col("_begun").isNull() & (F.col("_note") | (F.col("_text") & F.col("_intro"))))
    at = F.when(waits, following).otherwise(current)
    kind = F.when(F.col("_head"), "section").when(waits | F.col("_note"), "note").when(F.col("_text"), "body")
    out = rows.withColumn("_in", at).withColumn("kind", kind)
    headings = out.where("_implied").withColumn("kind", F.lit("section"))
    out = out.unionByName(headings).where("kind IS NOT NULL AND _in.document IS NOT NULL")
    return out.select(key, *order, "_in.*", "kind", F.when(F.col("kind") == "section", F.col("_in.label")).otherwise(text).alias("text"))


def sections(lines: DataFrame, key: str = "book") -> DataFrame:
    """(key, document, opening, ordinal, number, label, part, paragraphs, notes) of lines(): how much is in each section.

    A section without text is the part that those behind it in its document are of, and is of none itself.
    """
    at = ["document", "opening", "ordinal"]
    named = F.any_value(F.when(F.col("kind") == "section", F.struct("number", "label")), True).alias("_n")
    made = lines.groupBy(key, *at).agg(named, F.count_if(F.col("kind") == "body").alias("paragraphs"), F.count_if(F.col("kind") == "note").alias("notes"))
    made = made.select(key, *at, "_n.*", "paragraphs", "notes")
    upto = Window.partitionBy(key, "document").orderBy("opening", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    running = F.last(F.when(F.col("paragraphs") == 0, F.col("label")), ignorenulls=True).over(upto)
    return made.withColumn("part", F.when(F.col("paragraphs") > 0, running))
