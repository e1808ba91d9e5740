"""Cross-site boilerplate: lines that stand on many distinct sites are removed from every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import materialize

#: Distinct sources on which a line is boilerplate.
SITES = 10
#: Sketches have 2**LOG_K buckets; estimates within NEAR of the limit, as a share and a count, are counted exactly.
LOG_K, NEAR, NEAR_SITES = 12, 0.1, 1
#: What a line is stripped of before it is compared.
STRIPPED = " \t\r"


def text_key(text: Column) -> Column:
    """Two hashes of a whole text, 128 bits together."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("line dedup"), text).alias("b"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes (line) on at least so many distinct sources, of rows (line, source). A null source is no site.

    Sketches of each line's sources merge map-side; only lines near the limit are counted exactly.
    """
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("source", LOG_K)).alias("sites")
    low, high = sites - NEAR_SITES - sites * NEAR, sites + NEAR_SITES + sites * NEAR
    spread = materialize(lines.groupBy("line").agg(sketch).where(F.col("sites") >= low))
    near = lines.join(spread.where(F.col("sites") <= high), "line", "left_semi")
    exact = near.groupBy("line").agg(F.countDistinct("source").alias("sites")).where(F.col("sites") >= sites)
    return spread.where(F.col("sites") > high).select("line").unionByName(exact.select("line"))


def one_site_each(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, source) of lines(key, line, ...): each of texts(key, text, source) counts for one of its sources, so copies add none.

    Which source that is goes by a digest of both, so that texts of many sources don't all count for the same one.
    """
    placed = F.struct(F.md5(F.concat(F.md5("text"), F.lit("/"), "source")).alias("digest"), "source")
    sites = texts.where(F.col("source").isNotNull()).groupBy("key").agg(F.min(placed).alias("one"))
    return materialize(lines.select("line", "key").distinct().join(sites.select("key", "one.source"), "key").select("line", "source"))


def without_boilerplate(docs: DataFrame, sites: int = SITES, by_text: bool = True) -> DataFrame:
    """(row, text, n_lines, n_removed): each document as a struct, and its text without lines found on many sources.

    A line is compared without blanks at its ends; blank lines stay. A null text stays null, with no lines; an empty
    one is one blank line; one that loses every line becomes empty. Equal rows stay separate rows. The text itself
    moves between machines once, and lines only as hashes. by_text: sites are counted over distinct texts, so that a
    text keeps its lines however many sources have copies of it.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    split = F.split(F.col("row.text"), "\n", -1)
    keyed = docs.select(row).select("row", text_key(F.col("row.text")).alias("key"))
    lines = keyed.select("key", F.col("row.source").alias("source"), F.posexplode(split).alias("pos", "text"))
    stripped = F.btrim("text", F.lit(STRIPPED))
    lines = lines.where(stripped != "").select("key", "source", "pos", F.xxhash64(stripped).alias("line"))
    lines = materialize(lines)
    texts = keyed.select("key", F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    placed = one_site_each(texts, lines) if by_text else lines.select("line", "source")
    gone = lines.join(boilerplate(placed, sites), "line", "left_semi")
    gone = materialize(gone.groupBy("key").agg(F.collect_set("pos").alias("gone")))  # apart, so the join can split a hot key
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # hashed, so linear in the lines
    left = F.transform(stay, lambda i: F.get("lines", i))
    out = keyed.join(gone, "key", "left").select("row", "gone", F.when(F.col("gone").isNotNull(), split).alias("lines"), split.alias("all"))
    return out.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.greatest(F.size("all"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with boilerplate lines gone from text, sites counted over distinct texts; all rows and the columns as given.

    A null text stays null, a text that loses every line becomes empty, and equal rows stay separate rows. A null
    source is no site. An empty table stays empty.
    """
    out = without_boilerplate(docs, sites)
    return out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
p AS (SELECT text, arg_min(source, md5(md5(text) || '/' || source)) AS site FROM documents WHERE source IS NOT NULL GROUP BY text),
b AS (SELECT k FROM k JOIN d USING (r) JOIN p USING (text) WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= {SITES}),
m AS (SELECT k.*, b.k IS NOT NULL AS gone FROM k LEFT JOIN b USING (k)),
o AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
      count(*) FILTER (gone) AS n_removed FROM m GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE o.text END AS text, coalesce(o.n_lines, 0) AS n_lines,
       coalesce(o.n_removed, 0) AS n_removed
FROM d LEFT JOIN o USING (r)
"""
