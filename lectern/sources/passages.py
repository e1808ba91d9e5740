"""Chapters of scripture as providers send them: verses from JSON and from marked text, recordings, editions, a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WS, strip

#: Readers that come before others, in this order.
READERS = ("david", "hays", "souer")

CHAPTER = "struct<chapter:struct<content:array<string>>,thisChapterAudioLinks:map<string,string>>"


def one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def flat_verse(content: Column) -> Column:
    """The text of a verse's content (an array of JSON texts): plain texts and objects' `text`, in one line."""
    parts = F.transform(
        content,
        lambda x: F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.text")).otherwise(x),
    )
    return one_line(F.array_join(F.filter(parts, lambda p: p.isNotNull()), " "))


def json_verses(answers: DataFrame) -> DataFrame:
    """(key, verse, text) of chapters(key, answer) in JSON; what isn't a verse, has no number or no text is left out.

    A malformed answer has no verses.
    """
    items = F.from_json("answer", CHAPTER)["chapter"]["content"]
    rows = answers.select("key", F.posexplode(items).alias("position", "item"))
    parsed = F.from_json("item", "struct<type:string,number:int,content:array<string>>")
    rows = rows.select("key", "position", parsed.alias("v")).where("v.type = 'verse' and v.number is not null")
    rows = rows.select("key", "position", F.col("v.number").alias("verse"), flat_verse(F.col("v.content")).alias("text"))
    return rows.where("text <> ''").select("key", "verse", "text")


def marked_parts(text: Column, before: bool) -> Column:
    """array<struct(n, text)> of '[1] In the beginning [2] And', without blank ones; before: also what comes first, n null."""
    marker = f"\\[([0-9]+)\\]{WS}*"
    found = F.regexp_extract_all(text, F.lit(marker), F.lit(1))
    gaps = F.split(text, marker, -1)
    cells = F.transform(gaps, lambda g, i: F.struct(F.when(i > 0, F.get(found, i - 1)).cast("int").alias("n"), g.alias("text")))
    cells = F.filter(cells, lambda c: strip(c["text"]) != "")
    return cells if before else F.filter(cells, lambda c: c["n"].isNotNull())


def marked_verses(answers: DataFrame) -> DataFrame:
    """(key, verse, text) of chapters(key, answer) with '[n]' before each verse; what comes before the first is left out."""
    rows = answers.select("key", F.explode(marked_parts(F.col("answer"), before=False)).alias("v"))
    return rows.select("key", F.col("v.n").alias("verse"), one_line(F.col("v.text")).alias("text"))


def paragraphs(sections: DataFrame) -> DataFrame:
    """(key, position, paragraph, text) of sections(key, text) with '[n]' before paragraphs; none before the first."""
    rows = sections.select("key", F.posexplode(marked_parts(F.col("text"), before=True)).alias("position", "p"))
    return rows.select("key", "position", F.col("p.n").alias("paragraph"), F.col("p.text").alias("text"))


def recordings(links: Column, order: tuple[str, ...] = READERS) -> Column:
    """array<struct(reader, label, url)> of a map of links: readers in the given order, then by name; no blank links."""
    place = lambda r: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), r), F.lit(0)), F.lit(99))
    cells = F.transform(
        F.filter(F.map_entries(links), lambda e: F.coalesce(e["value"], F.lit("")) != ""),
        lambda e: F.struct(place(e["key"]).alias("place"), e["key"].alias("reader"), e["value"].alias("url")),
    )
    label = lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))
    out = F.transform(F.array_sort(cells), lambda c: F.struct(c["reader"].alias("reader"), label(c["reader"]).alias("label"), c["url"].alias("url")))
    return F.coalesce(out, F.array().cast("array<struct<reader:string,label:string,url:string>>"))


def resolved_editions(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(id, provider_id) of wanted(id, pattern) editions: the first of catalogue(position, provider_id, names) that matches.

    wanted is a short list of the user's; names is an array, of which any may match.
    """
    pairs = catalogue.join(wanted, F.expr("exists(names, n -> n rlike pattern)"))
    return pairs.groupBy("id").agg(F.min_by("provider_id", "position").alias("provider_id"))


def read_through(asked: DataFrame, cache: DataFrame, keys: list[str], fetch, keep) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache): what the cache has, and what fetch(DataFrame of the missing keys) gives for the rest.

    keep(DataFrame) says which of the fetched rows the cache may hold. Fetched rows are read twice: write them first
    where fetching is dear.
    """
    missing = fetch(asked.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti"))
    answers = asked.join(cache.unionByName(missing), keys)
    return answers, cache.unionByName(keep(missing))
