"""Notes in Markdown as column expressions: front matter, links and tags, and the blocks of quotes in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import WS, strip

#: What a note can be.
NOTE_TYPES = ("note", "page", "chapter", "topic", "book-note", "project")

_FRONT = "^---\\r?\\n([\\s\\S]*?)\\r?\\n---"


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def front_matter(note: Column) -> Column:
    """What stands between the two '---' lines that a note begins with; null if it doesn't."""
    return F.when(note.rlike(_FRONT), F.regexp_extract(note, _FRONT, 1))


def field(note: Column, name: str) -> Column:
    """A front matter field's value without blanks around it; null if it is missing or blank."""
    return F.nullif(strip(F.regexp_extract(front_matter(note), f"(?m)^{name}:{WS}*(.+)$", 1)), F.lit(""))


def title(note: Column, fallback: Column) -> Column:
    """The front matter's title, else the first heading, else the fallback."""
    heading = F.when(note.rlike(f"(?m)^#{WS}+.+$"), strip(F.regexp_extract(note, f"(?m)^#{WS}+(.+)$", 1)))
    return F.coalesce(field(note, "title"), heading, fallback)


def note_type(note: Column) -> Column:
    """The front matter's type if it is one of NOTE_TYPES, else 'note'."""
    found = field(note, "type")
    return F.when(found.isin(*NOTE_TYPES), found).otherwise("note")


def tag_list(text: Column) -> Column:
    """Tags of '[a, "b"]', or of a list parted by blanks and commas whose '#' go."""
    inner = strip(text)
    bare = F.regexp_replace(inner, "^\\[|\\]\\z", "")
    quoted = F.transform(F.split(bare, ","), lambda x: F.regexp_replace(strip(x), "^['\"]|['\"]\\z", ""))
    plain = F.transform(F.split(inner, f"(?:,|{WS})+"), lambda x: F.regexp_replace(x, "^#", ""))
    found = F.when(F.startswith(inner, F.lit("[")), quoted).otherwise(plain)
    return F.coalesce(F.filter(found, lambda x: x != ""), _no_strings())


def tags(note: Column) -> Column:
    """The front matter's tags; none if it names none."""
    return tag_list(field(note, "tags"))


def items(note: Column) -> Column:
    """A project's items: the front matter's JSON list without what isn't a book, a note or a chapter; [] if malformed."""
    kinds = "array<struct<kind:string,id:string,path:string,book:string,chapter:double>>"
    found = F.from_json(field(note, "items"), kinds)
    good = lambda x: (
        ((x["kind"] == "book") & x["id"].isNotNull())
        | ((x["kind"] == "note") & x["path"].isNotNull())
        | ((x["kind"] == "scripture") & x["book"].isNotNull() & x["chapter"].isNotNull())
    )
    return F.coalesce(F.filter(found, lambda x: F.coalesce(good(x), F.lit(False))), F.array().cast(kinds))


def body(note: Column) -> Column:
    """A note behind its front matter, without blanks before it."""
    behind = F.regexp_replace(note, f"{_FRONT}\\r?\\n?", "")
    return F.when(note.rlike(_FRONT), F.regexp_replace(behind, f"^{WS}+", "")).otherwise(note)


def with_front_matter(body: Column, fields: dict[str, Column]) -> Column:
    """A note of a body and front matter fields in the given order; a null field is left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()]
    return F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---")), F.lit("\n\n"), body)


def print_text(note: Column) -> Column:
    """A note for print: no front matter, links as their alias or target, no #tags."""
    text = F.regexp_replace(note, "^---\\n[\\s\\S]*?\\n---\\n?", "")
    gaps = F.split(text, "\\[\\[[^\\]]+\\]\\]", -1)
    inner = F.regexp_extract_all(text, F.lit("\\[\\[([^\\]]+)\\]\\]"), F.lit(1))
    shown = F.transform(inner, lambda x: strip(F.get(F.split(F.coalesce(F.get(F.split(x, "\\|", -1), F.lit(1)), x), "#", -1), F.lit(0))))
    flat = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(shown, i), F.lit("")))), "")
    return F.regexp_replace(flat, f"(?m)(^|[(]|{WS})#([A-Za-z][A-Za-z0-9_-]+)(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])", "$1")


def escaped_html(text: Column) -> Column:
    """Text with '&', '<' and '>' as entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def italics_html(text: Column) -> Column:
    """Escaped text with *italics* as <em>."""
    return F.regexp_replace(escaped_html(text), "\\*([^*]+)\\*", "<em>$1</em>")


def saved(note: Column) -> Column:
    """A note as an editor saves it, with the brackets of links unescaped again."""
    return F.regexp_replace(F.regexp_replace(note, "\\\\\\[\\\\\\[", "[["), "\\\\\\]\\\\\\]", "]]")


def blockquote(text: Column, citation: Column) -> Column:
    """A quote in Markdown: each line quoted, and the citation under it."""
    return F.concat(F.lit("> "), F.regexp_replace(text, "(?:\\r?\\n)+", "\n> "), F.lit("\n>\n> — "), citation)


def quote_block(quote_id: Column, text: Column, citation: Column, remarks: Column) -> Column:
    """A quote's block between its markers: blockquote, citation and whatever remarks (an array) aren't blank."""
    said = F.array_join(F.filter(F.transform(remarks, strip), lambda x: x != ""), "\n\n")
    behind = F.when(said != "", F.concat(F.lit("\n"), said, F.lit("\n"))).otherwise(F.lit("\n"))
    return F.concat(
        F.lit("<!-- quote:"), quote_id, F.lit(" -->\n"), blockquote(text, citation), F.lit("\n"), behind,
        F.lit("<!-- /quote:"), quote_id, F.lit(" -->"),
    )


def _around(note: Column, quote_id: Column) -> tuple[Column, Column]:
    """Where a quote's block begins, and what comes behind it, both from 1; 0 if it isn't there."""
    first = F.concat(F.lit("<!-- quote:"), quote_id, F.lit(" -->"))
    last = F.concat(F.lit("<!-- /quote:"), quote_id, F.lit(" -->"))
    begin = F.instr(note, first)
    tail = F.instr(F.substring(note, begin, F.length(note)), last)
    return begin, F.when((begin > 0) & (tail > 0), begin + tail - 1 + F.length(last)).otherwise(0)


def with_block(note: Column, quote_id: Column, block: Column) -> Column:
    """A note with a quote's block in the place of its old one, or behind everything. A null note is empty."""
    note = F.coalesce(note, F.lit(""))
    begin, behind = _around(note, quote_id)
    put = F.concat(F.substring(note, F.lit(1), begin - 1), block, F.substring(note, behind, F.length(note)))
    gap = F.when(F.endswith(note, F.lit("\n")), "\n").otherwise("\n\n")
    return F.when(behind > 0, put).otherwise(F.concat(note, gap, block, F.lit("\n")))


def without_block(note: Column, quote_id: Column) -> Column:
    """A note without a quote's block and the line ends around it; null once no block is left."""
    begin, behind = _around(note, quote_id)
    head = F.regexp_replace(F.substring(note, F.lit(1), begin - 1), "\\n\\z", "")
    tail = F.regexp_replace(F.substring(note, behind, F.length(note)), "^\\n", "")
    left = F.when(behind > 0, F.concat(head, F.lit("\n"), tail)).otherwise(note)
    return F.when(F.contains(left, F.lit("<!-- quote:")), left)


def snippet_parts(snippet: Column) -> Column:
    """array<struct(text, match)> of a snippet with its matches between ⟦ and ⟧."""
    return F.transform(F.split(snippet, "[⟦⟧]", -1), lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("match")))


def plain_bibliography(entries: Column) -> Column:
    """Entries (an array) as plain text, without the stars of italics, parted by blank lines."""
    return F.array_join(F.transform(entries, lambda e: F.replace(e, F.lit("*"), F.lit(""))), "\n\n")


#: Marks within a line (patterns, as fixed values) and the kinds they give.
_CITED = "\\*[^*]+\\*|\\[[^\\]]+\\]"
_STYLED = "\\*\\*[^*]+\\*\\*|\\*[^*]+\\*|~~[^~]+~~"


def _marked(text: Column, pattern: str, kinds: list[tuple[str, str, str, bool]]) -> Column:
    """[(kind, text)] of a line cut at marks; kinds are (kind, begins, ends, whether the marks go)."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    half = lambda i: F.floor(i / 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), 2 * F.size(gaps) - 2), lambda i: F.when(i % 2 == 0, F.get(gaps, half(i))).otherwise(F.get(found, half(i))))

    def named(part: Column) -> Column:
        out = F.struct(F.lit("text").alias("kind"), part.alias("text"))
        for kind, begins, ends, bare in reversed(kinds):
            inner = F.substring(part, F.lit(len(begins) + 1), F.greatest(F.length(part) - len(begins) - len(ends), F.lit(0)))
            made = F.struct(F.lit(kind).alias("kind"), (inner if bare else part).alias("text"))
            out = F.when(F.startswith(part, F.lit(begins)) & F.endswith(part, F.lit(ends)), made).otherwise(out)
        return out

    return F.filter(F.transform(parts, named), lambda p: p["text"] != "")


def citation_parts(text: Column) -> Column:
    """A citation as [(kind, text)]: '*titles*' in italics, '[what is missing]' with its brackets, and plain text."""
    return _marked(text, _CITED, [("italic", "*", "*", True), ("missing", "[", "]", False)])


def styled_parts(text: Column) -> Column:
    """A quote as [(kind, text)]: '**bold**', '~~struck~~', '*italic*' and plain text; marks that aren't closed stay."""
    return _marked(text, _STYLED, [("bold", "**", "**", True), ("struck", "~~", "~~", True), ("italic", "*", "*", True)])
