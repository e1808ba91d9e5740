"""Source divergence audit: how each source of a language differs from the others and from the language, term by term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import bounded_batches, materialize

#: Documents of a language that a term must be in; ranks of a group's terms that are returned; parts of a probability of 1.
LEAST_DOCS, RANKS, UNIT = 3, 200, 1_000_000_000
#: Terms in a shard of postings and sources in a block of them, at most: what one row of pairs works on.
SHARD, SIDE = 4096, 128
#: Terms that a task holds before it gives their counts out.
HELD = 1 << 20
#: What separates terms: ASCII without its letters.
_SPLIT = bytes.maketrans(
    bytes(range(0x80)), bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A else 0x20 for c in range(0x80))
)
COUNTED = "lang string, source string, term string, n long, docs long"


def terms_of(text: str) -> list[bytes]:
    """A text's terms in UTF-8: runs of ASCII letters and of all that is beyond ASCII, with A-Z as a-z."""
    return text.encode().translate(_SPLIT).split()


def _counts_of(groups: list[tuple[str, str]], found: list[list[bytes]]) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of documents' terms; a row with a null term says that a group is there."""
    names = sorted(set(groups))
    at = {g: i for i, g in enumerate(names)}
    coded = pa.array([t for terms in found for t in terms], pa.binary()).dictionary_encode()
    size = max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(len(found), dtype=np.int64), [len(terms) for terms in found])
    in_doc, n = np.unique(doc * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    group = np.array([at[g] for g in groups], np.int64)[in_doc // size] if len(in_doc) else in_doc
    in_group, where = np.unique(group * size + in_doc % size, return_inverse=True)
    of = np.concatenate((in_group // size, np.arange(len(names))))
    columns = [pa.array([g[k] for g in names], pa.string()).take(pa.array(of)) for k in (0, 1)]
    terms = coded.dictionary.cast(pa.string()).take(pa.array(np.concatenate((in_group % size, np.zeros(len(names), np.int64))), mask=np.arange(len(of)) >= len(in_group)))
    sums = [np.concatenate((np.bincount(where, w, len(in_group)).astype(np.int64), np.zeros(len(names), np.int64))) for w in (n, None)]
    return pa.RecordBatch.from_arrays([*columns, terms, *map(pa.array, sums)], ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of texts, given out whenever HELD terms are held."""
    groups, found, held = [], [], 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            groups.append((lang, source))
            found.append(terms_of(text))
            held += len(found[-1])
            if held >= HELD:
                yield _counts_of(groups, found)
                groups, found, held = [], [], 0
    yield _counts_of(groups, found)


def _share(count: str, size: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (size + v)), exact for any counts; null where nothing is kept."""
    return F.expr(f"CASE WHEN v > 0 THEN 1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div CAST({size} + v AS DECIMAL(20, 0)) END")


def difference(p: str, q: str) -> Column:
    """floor((p - q)^2 / q). Both are at most UNIT + 1, so the square fits a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, postings).

    groups: (lang, source, size, v, whole, p0): each group, its number of kept terms' occurrences, the language's number of
    kept terms and of their occurrences, and the share of a term that the group lacks. postings: (lang, source, term, n,
    total, p, q, v): each kept term of a group, its count there and in the language, and its shares.
    """
    bounded_batches(docs.sparkSession)
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = named.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term")
    found = materialize(found.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    terms = materialize(terms.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    kept = materialize(found.where("term IS NOT NULL").drop("docs").join(terms, ["lang", "term"]))
    words = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = found.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(words, "lang", "left")
    groups = materialize(groups.na.fill(0, ["size", "v", "whole"]).withColumn("p0", _share("0", "size")))
    shared = kept.join(groups.drop("p0"), ["lang", "source"])
    return groups, materialize(shared.select("lang", "source", "term", "n", "total", _share("n", "size").alias("p"), _share("total", "whole").alias("q"), "v"))


def _bucket(count: str) -> Column:
    """Which of at most 960 buckets a count is in: itself below 16, else its leading five bits and their place."""
    place = F.length(F.bin(count)) - 5
    return F.when(F.col(count) < 16, F.col(count)).otherwise(F.expr(f"shiftright({count}, length(bin({count})) - 5)") + place * 16)


def buckets(above: DataFrame) -> DataFrame:
    """(lang, source, bucket, many, bound, before): buckets of a group's terms by their counts there and in the language.

    bound is the difference between the largest share and the least share in the language of a bucket's terms, so none of
    them has more. before: terms in the group's buckets with larger bounds. A group has a bounded number of buckets.
    """
    sums = above.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("many"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bound", difference("p", "q"))
    return sums.select("lang", "source", "bucket", "many", "bound", F.coalesce(F.sum("many").over(best), F.lit(0)).alias("before"))


def _ranked(rows: DataFrame, ranks: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if ranks is None else rows.where(F.col("rank") <= ranks)


def top_terms(postings: DataFrame, ranks: int = RANKS) -> tuple[DataFrame, DataFrame]:
    """(rows, evaluated): each group's terms above the language's share, of the largest differences; and what it took.

    Best first: buckets with the largest bounds that hold `ranks` terms are evaluated, and give each group the value of
    its last rank. The search stops where no bucket that is left has a bound of at least that; ties are thus evaluated too.
    """
    above = postings.where("p > q").withColumn("bucket", F.struct(_bucket("n").alias("n"), _bucket("total").alias("total")))
    found = materialize(buckets(above))
    key = ["lang", "source", "bucket"]

    def evaluated(which: DataFrame) -> DataFrame:
        rows = above.join(which.select(*key), key, "left_semi")
        return rows.select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))

    first = materialize(_ranked(evaluated(found.where(F.col("before") < ranks)), ranks))
    last = first.where(F.col("rank") == ranks).select("lang", "source", F.col("value").alias("least"))
    more = materialize(found.where(F.col("before") >= ranks).join(last, ["lang", "source"]).where("bound >= least"))
    rows = _ranked(first.drop("rank").unionByName(evaluated(more)), ranks)
    return rows, found.where(F.col("before") < ranks).select(*key, "many").unionByName(more.select(*key, "many"))


def _pair_sums(terms_a, slots_a, shares_a, base_a, terms_b, slots_b, shares_b, base_b) -> np.ndarray:
    """Sums over the terms that occur on either side: the difference of two sources less that of two that lack the term."""
    base_a, base_b = np.asarray(base_a, np.int64), np.asarray(base_b, np.int64)
    lists = [x if x is not None else () for x in (terms_a, terms_b)]
    codes, names = pd.factorize(np.concatenate([np.asarray(x, object) for x in lists]))
    sides = []
    for base, at, slots, shares in ((base_a, slice(None, len(lists[0])), slots_a, shares_a), (base_b, slice(len(lists[0]), None), slots_b, shares_b)):
        side = np.repeat(base[None, :], len(names), 0)
        if slots is not None and len(slots):
            side[codes[at], np.asarray(slots, np.int64)] = np.asarray(shares, np.int64)
        sides.append(side)
    p, q = sides
    out = np.empty((len(base_a), len(base_b)), np.int64)
    for i, p0 in enumerate(base_a):
        apart, lacking = p[:, i, None] - q, p0 - base_b
        out[i] = (apart * apart // q).sum(0) - len(names) * (lacking * lacking // base_b)
    return out.ravel()


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sums(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([_pair_sums(*row) for row in zip(*columns, strict=True)], dtype=object)


def pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): every two sources of a language and the sum of their differences over all kept terms.

    Two sources that lack a term differ in it by what their sizes give, so only terms that occur on a side are looked at.
    Postings of up to SHARD terms and SIDE sources are a row; rows of two sides meet by shard, and give SIDE * SIDE sums.
    """
    order = Window.partitionBy("lang").orderBy("source")
    groups = materialize(groups.withColumn("i", F.row_number().over(order) - 1).selectExpr("*", f"i div {SIDE} AS side", f"i % {SIDE} AS slot"))
    bases = groups.where("v > 0").groupBy("lang", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "p0"))), lambda x: x["p0"]).alias("base"))
    sides = groups.groupBy("lang").agg(F.max("side").alias("last"))
    shard = F.expr(f"pmod(xxhash64(term), (v + {SHARD} - 1) div {SHARD})").alias("shard")
    placed = postings.select("lang", "source", "term", "p", shard).join(groups.select("lang", "source", "side", "slot"), ["lang", "source"])
    sheets = placed.groupBy("lang", "shard", "side").agg(*(F.collect_list(c).alias(k) for c, k in (("term", "terms"), ("slot", "slots"), ("p", "shares"))))
    sheet = F.struct("terms", "slots", "shares").alias("sheet")
    met = sheets.join(sides, "lang").select("lang", "shard", "side", sheet, F.explode(F.expr("sequence(0L, last)")).alias("other"))
    met = met.select("lang", "shard", "sheet", F.explode(F.array(
        F.struct(F.col("side").alias("a"), F.col("other").alias("b"), F.lit(True).alias("first")),
        F.struct(F.col("other").alias("a"), F.col("side").alias("b"), F.lit(False).alias("first")),
    )).alias("at")).select("lang", "shard", "sheet", "at.*")
    one = lambda of: F.first(F.when(of, F.col("sheet")), ignorenulls=True)
    met = met.groupBy("lang", "shard", "a", "b").agg(one(F.col("first")).alias("l"), one(~F.col("first")).alias("r"))
    for side, name in (("a", "base_a"), ("b", "base_b")):
        met = met.join(bases.select("lang", F.col("side").alias(side), F.col("base").alias(name)), ["lang", side])
    sums = _sums("l.terms", "l.slots", "l.shares", "base_a", "r.terms", "r.slots", "r.shares", "base_b")
    found = met.select("lang", "a", "b", F.size("base_b").alias("width"), F.posexplode(sums).alias("k", "value"))
    found = found.select("lang", (F.col("a") * SIDE + F.expr("k div width")).alias("i"), (F.col("b") * SIDE + F.expr("k % width")).alias("j"), "value")
    found = materialize(found.groupBy("lang", "i", "j").agg(F.sum("value").alias("sum")))
    here = groups.select("lang", "source", "i", "v", F.col("p0").alias("p"))
    there = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"), F.col("p0").alias("q"))
    both = here.join(there, "lang").where("i <> j").join(found, ["lang", "i", "j"], "left")
    absent = F.when(F.col("v") > 0, F.col("v") * difference("p", "q")).otherwise(0)
    return both.select("lang", "source", "item", (absent + F.coalesce("sum", F.lit(0))).alias("value"))


def audit(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) as the module says; part is `pair` or `term`.

    Null text, lang and source are empty. Each row is a document, equal ones and those with the same id too. A group without
    terms is there, with its pairs; where a language keeps no term its pairs have the value 0. Ties go by item in UTF-8.
    An empty table gives no rows, and other columns don't matter. A group of any size is spread: terms are counted within
    batches before they move, and buckets, not terms, are ranked by group.
    """
    groups, postings = counts(docs)
    near = _ranked(pairs(groups, postings), None).withColumn("part", F.lit("pair"))
    rows = near.unionByName(top_terms(postings, ranks)[0].withColumn("part", F.lit("term")))
    return rows.select("lang", "source", "part", "item", "value", "rank")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS whole FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(s.size, 0)::HUGEINT AS size, coalesce(v.v, 0)::HUGEINT AS v, v.whole FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source) s USING (lang, source) LEFT JOIN v USING (lang)),
a AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + {UNIT} * (coalesce(n, 0) + 1) // (size + v) AS p, 1 + {UNIT} * (total + 1) // (whole + v) AS q
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM a WHERE n > 0 AND p > q),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM a x JOIN a y USING (lang, term) GROUP BY ALL),
p AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM t UNION ALL FROM p))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM z WHERE part = 'pair' OR rank <= {RANKS}
"""
