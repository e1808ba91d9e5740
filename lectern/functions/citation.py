"""Citations as column expressions, after the Chicago manual: footnote, short, author-date and bibliography."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip


def _or_placeholder(value: Column, name: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(f"[{name}]"))


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, "\\s+"), -1)


def _inverted(name: Column) -> Column:
    parts = F.split(name, "\\s+")
    rest = F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ")
    return F.when(F.size(parts) < 2, name).otherwise(F.concat(_last(name), F.lit(", "), rest))


def _listed(authors: Column, shown) -> Column:
    """Up to two names, else the first and et al."""
    n, one = F.size(authors), shown(F.get(authors, F.lit(0)))
    two = F.concat(one, F.lit(" and "), shown(F.get(authors, F.lit(1))))
    return F.when(n == 0, "[author]").when(n == 1, one).when(n == 2, two).otherwise(F.concat(one, F.lit(" et al.")))


def _bibliography_authors(authors: Column) -> Column:
    """The first name inverted; six at most in full, else three and et al."""
    n = F.size(authors)
    names = F.transform(authors, lambda a, i: F.when(i == 0, _inverted(a)).otherwise(a))
    most = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    two = F.concat(F.get(names, F.lit(0)), F.lit(" and "), F.get(names, F.lit(1)))
    many = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(", et al."))
    several = F.concat(most, F.lit(", and "), F.element_at(names, -1))
    return F.when(n == 0, "[author]").when(n == 1, F.get(names, F.lit(0))).when(n == 2, two).when(n > 6, many).otherwise(several)


def book_citation(style: str, title: Column, authors: Column, year: Column, publisher: Column, city: Column, page: Column) -> Column:
    """A book's citation; what is missing shows as [field], and a city only before 1900."""
    name = _or_placeholder(strip(title), "title")
    when = _or_placeholder(year.cast("string"), "year")
    imprint = F.concat(_or_placeholder(publisher, "publisher"), F.lit(", "), when)
    imprint = F.when(year < 1900, F.concat(_or_placeholder(city, "city"), F.lit(": "), imprint)).otherwise(imprint)
    at = F.when(page.isNull(), "").otherwise(F.concat(F.lit(", "), page.cast("string")))
    if style == "footnote":
        return F.concat(_listed(authors, lambda a: a), F.lit(", *"), name, F.lit("* ("), imprint, F.lit(")"), at, F.lit("."))
    if style == "short":
        words = F.array_join(F.slice(F.split(name, "\\s+"), 1, 4), " ")
        short = F.when(F.size(F.split(name, "\\s+")) <= 4, name).otherwise(words)
        return F.concat(_listed(authors, _last), F.lit(", *"), short, F.lit("*"), at, F.lit("."))
    if style == "author-date":
        return F.concat(F.lit("("), _listed(authors, _last), F.lit(" "), when, at, F.lit(")"))
    if style == "bibliography":
        return F.concat(_bibliography_authors(authors), F.lit(". *"), name, F.lit("*. "), imprint, F.lit("."))
    raise ValueError(f"no such style: {style}")


def video_citation(style: str, title: Column, authors: Column, year: Column, channel: Column, url: Column) -> Column:
    """A video's citation: whose it is, its title in quotes, channel, year and, if there is one, its address."""
    when = _or_placeholder(year.cast("string"), "year")
    if style == "author-date":
        return F.concat(F.lit("("), _listed(authors, _last), F.lit(" "), when, F.lit(")"))
    if style not in ("footnote", "short", "bibliography"):
        raise ValueError(f"no such style: {style}")
    who = _bibliography_authors(authors) if style == "bibliography" else _listed(authors, lambda a: a)
    address = F.nullif(url, F.lit(""))
    said = F.concat_ws(", ", F.lit("video"), _or_placeholder(channel, "channel"), when, address)
    return F.concat(who, F.lit(', "'), _or_placeholder(strip(title), "title"), F.lit('," '), said, F.lit("."))


def passage_citation(book: Column, chapter: Column, first: Column, last: Column, edition: Column) -> Column:
    """'John 3:16–18 (BSB)'."""
    verses = F.when(last.isNull() | (last == first), first.cast("string")).otherwise(F.concat_ws("–", first, last))
    return F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), verses, F.lit(" ("), edition, F.lit(")"))


def has_placeholders(citation: Column) -> Column:
    return citation.rlike("\\[[^\\]]+\\]")


def commentary_citation(author: Column, name: Column, place: Column) -> Column:
    """'Author, *Commentary*, JHN 3:16'; what is blank is left out."""
    blank = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws(", ", blank(author), F.concat(F.lit("*"), name, F.lit("*")), blank(place))


def section_citation(abbreviation: Column, number: Column, label: Column, paragraph: Column, source: Column) -> Column:
    """"AC IV, 2 (Reader's Edition)", or with the label where a section has no number."""
    numbered = F.coalesce(number, F.lit("")) != ""
    head = F.when(numbered, F.concat_ws(" ", abbreviation, number)).otherwise(F.concat(abbreviation, F.lit(", "), F.coalesce(label, F.lit(""))))
    return F.concat(F.concat_ws(", ", head, paragraph.cast("string")), F.lit(" ("), source, F.lit(")"))


def printed_page(page: Column, offset: Column) -> Column:
    """The number that is printed on a page of the file."""
    return page - F.coalesce(offset, F.lit(0))
