"""Accent-folded prefix search ranked by BM25 over a written or derived inverted index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import query_tokens, tokens
from lectern.session import materialize

K1, B = 1.2, 0.75
LIMIT, SNIPPET = 200, 14
#: Numbers of documents in a block of postings, at most, and in one filter that a scan of Parquet looks up exactly.
BLOCK, LOOKED_UP = 1024, 10
#: Digits of a rank; the order in which parts are added up changes those beyond.
DIGITS = 12


@dataclass
class Index:
    """docs: key, kind, book_id, ref, page, title, content and length; postings: key, term, tf."""

    docs: DataFrame
    postings: DataFrame


@dataclass
class WrittenIndex(Index):
    """docs also have doc, a number in order of key, and are sorted by it. blocks: term, block, entries(doc, tf, length) of
    documents with near numbers, with the most of tf and the least length among them, sorted by term. whole: one row,
    the number of documents and their mean length."""

    blocks: DataFrame
    whole: DataFrame


def build_index(docs: DataFrame, *keys: str) -> Index:
    """An index of rows with key (or keys) and content; other columns stay. Blank documents count, without terms."""
    keys = keys or ("key",)
    docs = docs.withColumn("length", F.size(tokens(F.col("content"))).cast("long"))
    terms = docs.select(*keys, F.explode(tokens(F.col("content"))).alias("term"))
    return Index(docs, terms.groupBy("term", *keys).agg(F.count("*").alias("tf")))


def _counts(words: Column) -> Column:
    """array<struct(term, tf)> of a document's words: sorted, each run of equal ones is a term."""

    def counted(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda at: F.transform(at, lambda i, n: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(s)) - i).alias("tf")))
        return F.get(F.transform(F.array(begins), run), F.lit(0))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    # As in snippet, the lambda's variable holds the sorted words once.
    return F.when(F.size(words) == 0, none).otherwise(F.get(F.transform(F.array(F.sort_array(words)), counted), F.lit(0)))


def write_index(index: Index, path: str) -> WrittenIndex:
    """Write an index so that a search reads little of it; keys are distinct.

    A prefix reads the few files of its terms. Blocks say what their documents can score at most, so most of them are
    passed over. Contents are found by number, and only a search's hits are read. Contents are split once, after they
    are ranged, and a document's terms are written beside it; so postings move once, to the range of their term.
    """
    spark = index.docs.sparkSession
    docs = index.docs.drop("length").repartitionByRange("key").sortWithinPartitions("key").withColumn("doc", F.monotonically_increasing_id())
    docs = docs.withColumn("_words", tokens(F.col("content")))
    docs = docs.withColumns({"length": F.size("_words").cast("long"), "_terms": _counts(F.col("_words"))}).drop("_words")
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    block = F.expr(f"doc div {BLOCK}").alias("block")  # numbers of a part begin at a multiple of it
    postings = docs.select(block, "doc", "length", F.inline("_terms")).repartitionByRange("term", "block")
    entry = F.struct("doc", F.col("tf").cast("long").alias("tf"), "length")
    sums = (F.sort_array(F.collect_list(entry)).alias("entries"), F.max("tf").cast("long").alias("most"), F.min("length").alias("least"))
    postings.groupBy("term", "block").agg(*sums).sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    docs.agg(F.count("*").cast("double").alias("total"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{path}/whole")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> WrittenIndex:
    """The index that write_index wrote."""
    docs, blocks, whole = (spark.read.parquet(f"{path}/{name}") for name in ("docs", "blocks", "whole"))
    docs = docs.drop("_terms")
    each = blocks.select("term", F.explode("entries").alias("e")).select("term", "e.doc", "e.tf")
    return WrittenIndex(docs, each.join(docs.select("doc", "key"), "doc").select("key", "term", "tf"), blocks, whole)


def _of_tokens(words: list[str]) -> tuple[Column, Column]:
    """Whether a term begins with one of the words, and the numbers of those that it begins with."""
    begins = [F.col("term").startswith(w) for w in words]
    return reduce(Column.__or__, begins), F.filter(F.array(*(F.when(b, F.lit(i)) for i, b in enumerate(begins))), lambda x: x.isNotNull())


def _weights(seen: DataFrame, whole: DataFrame) -> DataFrame:
    """(token, idf, mean): a row for each token of the query, of seen(token, n) and the one row of whole."""
    idf = F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return seen.crossJoin(whole).select("token", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf"), "mean")


def _score(f: str, length: str) -> Column:
    """What a token that a document of that length has f times adds to its score."""
    norm = K1 * (1 - B + B * F.col(length) / F.col("mean"))
    return F.col("idf") * F.col(f) * (K1 + 1) / (F.col(f) + norm)


def _rank(digits: int) -> Column:
    """The rank of a document's scores, cut to so many digits."""
    rank = F.round(-F.sum("score"), DIGITS)
    return (rank if digits == DIGITS else F.round(rank, digits)).alias("rank")


def ranked(index: Index, query: str, digits: int = DIGITS) -> DataFrame:
    """(key, rank) of every document in which each token begins some term; a lower rank is better.

    Counts of documents and lengths are those of the whole index, whatever scope is applied to the result.
    """
    words = query_tokens(query)
    if not words:
        return index.docs.select("key", F.lit(0.0).alias("rank")).where(F.lit(False))
    begun, which = _of_tokens(words)
    rows = index.postings.where(begun).select("key", "tf", F.explode(which).alias("token"))
    hits = rows.groupBy("key", "token").agg(F.sum("tf").cast("double").alias("f"))
    seen = hits.groupBy("token").agg(F.count("*").cast("double").alias("n"))  # a row for each token of the query
    if isinstance(index, WrittenIndex):
        whole = index.whole
    else:
        whole = index.docs.agg(F.count("*").cast("double").alias("total"), F.avg("length").alias("mean"))  # one row
    scored = hits.join(F.broadcast(_weights(seen, whole)), "token").join(index.docs.select("key", "length"), "key")
    scored = scored.withColumn("score", _score("f", "length"))
    return scored.groupBy("key").agg(_rank(digits), F.count("*").alias("found")).where(F.col("found") == len(words)).drop("found")


def scored_blocks(index: WrittenIndex, words: list[str], docs: DataFrame | None, limit: int, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """(best, blocks): (doc, rank) of the best documents for all words, those in docs(doc) if given; and the blocks it took.

    Blocks bound what their documents can score. Those with the largest bounds that may hold `limit` documents are scored
    first; of the others only those that can still reach the last of the best are. Entries of one block are never more
    than BLOCK for a term.
    """
    begun, which = _of_tokens(words)
    rows = index.blocks.where(begun).select("*", F.explode(which).alias("token"))
    once = F.size(F.array_distinct(F.flatten(F.collect_list("entries.doc"))))
    seen = rows.groupBy("token", "block").agg(F.sum("most").cast("double").alias("f"), F.min("least").alias("length"), once.alias("n"))
    seen = materialize(seen)
    weights = materialize(_weights(seen.groupBy("token").agg(F.sum("n").cast("double").alias("n")), index.whole))
    bound = F.sum(_score("f", "length") * (1 + 1e-9)).alias("bound")
    blocks = seen.join(weights, "token").groupBy("block").agg(bound, F.min("n").alias("n"), F.count("*").alias("found"))
    order = Window.orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.where(F.col("found") == len(words)).orderBy(F.desc("bound"), "block").limit(limit)  # each has one hit or more
    first = first.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < limit).select("block", "bound")
    numbers = sorted(r["block"] for r in first.select("block").collect())  # at most limit

    def best_of(rows: DataFrame) -> DataFrame:
        each = rows.select("token", F.explode("entries").alias("e")).select("token", "e.*")
        each = each if docs is None else each.join(docs, "doc", "left_semi")
        hits = each.groupBy("doc", "token").agg(F.sum("tf").cast("double").alias("f"), F.min("length").alias("length"))
        scored = hits.join(F.broadcast(weights), "token").withColumn("score", _score("f", "length"))
        found = scored.groupBy("doc").agg(_rank(digits), F.count("*").alias("found"))
        return found.where(F.col("found") == len(words)).drop("found")

    top = lambda rows: rows.orderBy("rank", "doc").limit(limit)  # noqa: E731  (numbers are in order of key)
    best = materialize(top(best_of(rows.where(_among("block", numbers)))))
    held, last = best.agg(F.count("*"), F.max("rank")).first()
    rest = blocks.where((F.col("found") == len(words)) & ~_among("block", numbers))
    rest = materialize((rest if held < limit else rest.where(F.col("bound") + 10.0**-digits >= -last)).select("block"))
    if not rest.isEmpty():
        best = materialize(top(best.unionByName(best_of(rows.join(rest, "block", "left_semi")))))
    return best, rest.unionByName(first.select("block"))


def _among(column: str, numbers: list[int]) -> Column:
    """Whether a column is one of the numbers, in filters so small that a scan looks each number up."""
    groups = [numbers[i : i + LOOKED_UP] for i in range(0, len(numbers), LOOKED_UP)]
    return reduce(Column.__or__, (F.col(column).isin(g) for g in groups), F.lit(False))


def search(index: Index, query: str, scope: Column | None = None, limit: int = LIMIT, books: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """The best documents of a scope, by rank and then key. A scope that is never true gives no rows.

    books(book_id): only documents of these. digits: of a rank, DIGITS at most; ranks that are equal in these go by key. Keys are ranked and cut before any content is read. Of a written index only
    the blocks are scored that can matter, and the contents of the hits are looked up by number, of which the driver
    learns as many as limit.
    """
    found = index.docs.drop("content")
    found = found if scope is None else found.where(scope)
    if books is not None:
        found = found.join(books.select("book_id"), "book_id", "left_semi")
    words = query_tokens(query)
    if isinstance(index, WrittenIndex) and words and limit <= LIMIT:
        every = scope is None and books is None
        best, _ = scored_blocks(index, words, None if every else found.select("doc"), limit, digits)
        hits = index.docs.where(_among("doc", sorted(r["doc"] for r in best.select("doc").collect())))
        return hits.join(F.broadcast(best), "doc").drop("doc").orderBy("rank", "key").limit(limit)
    best = found.select("key").join(ranked(index, query, digits), "key").orderBy("rank", "key").limit(limit)
    hits = index.docs.join(F.broadcast(best) if limit <= LIMIT else best, "key").orderBy("rank", "key")
    return hits.drop("doc")


def by_page(hits: DataFrame) -> DataFrame:
    """Hits of one book (a search's limit of rows at most) by page, each with its number and the key of the next.

    The hit after the last is the first.
    """
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("page", "key"))
    rows = hits.withColumn("n", n)
    around = Window.partitionBy("book_id").orderBy("n")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("key", "page", "rank", "n", F.coalesce(F.lead("key").over(around), F.first("key").over(whole)).alias("following"))


def item_scope(book_ids: list = (), notes: list = (), refs: list = ()) -> Column:
    """Pages of these books, notes of these keys or passages of these refs; nothing if all are empty."""
    parts = [(F.col("kind") == k) & F.col(c).isin(*v) for k, c, v in (("page", "book_id", book_ids), ("note", "key", notes), ("scripture", "ref", refs)) if v]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def grouped_hits(hits: DataFrame) -> DataFrame:
    """Hits by book, or by ref for scripture, else in one group of notes; groups in order of their best hit."""
    group = F.when(F.col("kind").isin("page", "quote"), F.col("book_id").cast("string")).when(F.col("kind") == "scripture", F.col("ref")).otherwise("notes")
    return hits.groupBy(group.alias("bucket")).agg(F.min(F.struct("rank", "key")).alias("best"), F.count("*").alias("n")).orderBy("best")


def snippet(content: Column, words: list[str], size: int = SNIPPET) -> Column:
    """At most size words around the first matches, matched ones between ⟦ and ⟧, … where text is cut off.

    The window is the one with most of the words, then with most matches, the earliest of equals. Words are split at blanks.
    """
    known = F.array(*map(F.lit, words))
    begun = lambda p: F.flatten(F.transform(tokens(p), lambda t: F.filter(known, lambda w: t.startswith(w))))
    parts = F.split(F.regexp_replace(content, "\\s+", " "), " ")
    cells = F.transform(parts, lambda p: F.struct(p.alias("text"), F.array_distinct(begun(p)).alias("words")))
    # The lambda's variable holds the words once; as an expression they would be made again for each window.
    return F.get(F.transform(F.array(cells), lambda c: _window(c, size)), F.lit(0))


def _window(cells: Column, size: int) -> Column:
    """The text of the best window of array<struct(text, words)>."""
    is_hit = lambda x: F.size(x["words"]) > 0
    starts = F.sequence(F.lit(0), F.greatest(F.size(cells) - size, F.lit(0)))

    def scored(start: Column) -> Column:
        seen = F.filter(F.slice(cells, start + 1, F.lit(size)), is_hit)
        found = F.array_distinct(F.flatten(F.transform(seen, lambda x: x["words"])))
        return F.struct(F.size(found).alias("words"), F.size(seen).alias("n"), (-start).alias("at"))

    def written(best: Column) -> Column:
        at = -best["at"]
        shown = F.transform(F.slice(cells, at + 1, F.lit(size)), lambda x: F.when(is_hit(x), F.concat(F.lit("⟦"), x["text"], F.lit("⟧"))).otherwise(x["text"]))
        return F.concat(F.when(at > 0, "…").otherwise(""), F.array_join(shown, " "), F.when(at + size < F.size(cells), "…").otherwise(""))

    return F.get(F.transform(F.array(F.array_max(F.transform(starts, scored))), written), F.lit(0))


def passage_rows(verses: DataFrame, edition: str, open_edition: str = "BSB") -> DataFrame:
    """Rows to index of verses(book, chapter, verse, text, title), each with its verse as page: none of an edition that may not be kept."""
    rows = verses.where(F.lit(edition == open_edition) & (F.trim("text") != ""))
    ref = F.concat_ws(":", "book", F.col("chapter").cast("string"))
    return rows.select(F.concat_ws(":", ref, F.col("verse").cast("string")).alias("key"), F.lit("scripture").alias("kind"), F.lit(None).cast("string").alias("book_id"), F.col("text").alias("content"), ref.alias("ref"), F.col("verse").alias("page"))


def section_rows(sections: DataFrame) -> DataFrame:
    """Rows to index of sections(source, document, ordinal, text): blank ones aren't."""
    ref = F.concat_ws(":", "document", F.col("ordinal").cast("string"))
    rows = sections.where(F.trim("text") != "")
    return rows.select(F.concat_ws("/", "source", ref).alias("key"), F.lit("confession").alias("kind"), F.col("source").alias("book_id"), F.col("text").alias("content"), ref.alias("ref"))


def unindexed(books: DataFrame) -> DataFrame:
    """Books with a file whose pages aren't in the index yet, of books(indexed, pdf_path, ...)."""
    return books.where((F.coalesce(F.col("indexed").cast("int"), F.lit(0)) == 0) & F.col("pdf_path").isNotNull())


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows to index of pages(book_id, page, title, text): blank ones aren't."""
    rows = pages.where(F.trim("text") != "")
    key = F.concat_ws("/", "book_id", F.col("page").cast("string"))
    return rows.select(key.alias("key"), F.lit("page").alias("kind"), "book_id", F.col("text").alias("content"), F.lit(None).cast("string").alias("ref"), "page", "title")


def without_book(docs: DataFrame, book_id: str) -> DataFrame:
    """Indexed rows without the pages and quotes of a book; whatever else bears its id stays."""
    gone = F.col("kind").isin("page", "quote") & (F.col("book_id") == book_id)
    return docs.where(~F.coalesce(gone, F.lit(False)))


def replaced_source(docs: DataFrame, new: DataFrame, kind: str, column: str) -> DataFrame:
    """Indexed rows with those of a kind replaced by new ones, for each value of column that new has."""
    old = docs.join(new.select(column).distinct().withColumn("_again", F.lit(True)), column, "left")
    kept = old.where((F.col("kind") != kind) | F.col("_again").isNull()).drop("_again")
    return kept.unionByName(new)
