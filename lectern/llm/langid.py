"""Language identification by rank-order profiles of n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lectern.llm.shared import bounded_batches, materialize, returning_memory

#: N-grams in a profile.
RANKS = 300
#: Languages whose profiles fit in a broadcast; with more, profiles stay a table that n-grams of documents are joined with.
MOST_LANGUAGES = 1000
#: Distinct words that a task counts before it passes their n-grams on.
WORDS = 200_000
UNKNOWN = "und"
#: How far on from the largest distance of its training documents to the largest possible one a language still holds.
BEYOND = 0.5

NO_LETTERS = re.compile(r"[\W\d_]+")

Profiles = dict[str, list[str]]


def words_of(text: str) -> str:
    """The runs of letters in lower case, each between blanks."""
    return f" {NO_LETTERS.sub(' ', text.lower()).strip()} "


def grams_of(padded: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The n-grams (n from 1 to 3) of text with single blanks between words, as numbers; none has a blank inside."""
    blank = padded == 32
    c = padded.astype(np.int64)
    one = c[~blank]
    two = (c[:-1] << 21 | c[1:])[~(blank[:-1] & blank[1:])]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[~blank[1:-1]]
    return [(1, one), (2, two), (3, three)]


def spelled(gram: int) -> str:
    return "".join(chr(gram >> s & 0x1FFFFF) for s in (42, 21, 0) if gram >> s & 0x1FFFFF)


def coded(gram: str) -> int:
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def in_training(doc_id: str) -> F.Column:
    """Documents whose id's CRC-32 isn't divisible by five; those with it, or without an id, are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over whole texts of all documents with a language and text, in part sums of each task."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def passed_on() -> pa.RecordBatch:
            langs, grams, counts = [], [], []
            for lang, seen in words.items():
                n: Counter = Counter()
                for word, times in seen.items():
                    w = f" {word} "
                    for k in range(1, len(w) + 1):
                        if k < len(w):
                            n[w[k - 1 : k + 1]] += times
                            if k + 1 < len(w):
                                n[w[k]] += times
                                n[w[k - 1 : k + 2]] += times
                langs += [lang] * len(n)
                grams += n.keys()
                counts += n.values()
            words.clear()
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([*map(pa.array, (langs, grams, counts), kinds)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text).split())
            if sum(map(len, words.values())) > WORDS:
                yield passed_on()
        yield passed_on()

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    return known.mapInArrow(returning_memory(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profile_table(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, rank, gram): each language's most frequent n-grams, most frequent first, from rank 1; ties by spelling."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return gram_counts(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).select("lang", "rank", "gram")


def collected(table: DataFrame) -> Profiles:
    """A table of profiles of few languages as lists."""
    found: dict[str, list[tuple[int, str]]] = {}
    for r in table.collect():
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(grams)] for lang, grams in sorted(found.items())}


def learn(docs: DataFrame, ranks: int = RANKS) -> Profiles | DataFrame:
    """Profiles as lists where they are of few languages, which alone go to the driver; as a table otherwise."""
    table = materialize(profile_table(docs, ranks))
    few = len(table.where("rank = 1").select("lang").limit(MOST_LANGUAGES + 1).collect()) <= MOST_LANGUAGES
    return collected(table) if few else table


def top_grams(text: str, ranks: int) -> np.ndarray | None:
    """A text's most frequent n-grams as numbers, most frequent first, ties by number; None for a text without a letter."""
    padded = words_of(text)
    if not any(map(str.isalpha, padded)):
        return None
    codepoints = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4")
    counted = [np.unique(g, return_counts=True) for _, g in grams_of(codepoints)]
    grams, n = (np.concatenate(x) for x in zip(*counted, strict=True))
    if len(grams) > ranks:
        nth = np.partition(n, -ranks)[-ranks]
        keep = np.flatnonzero(n >= nth)
        grams, n = grams[keep], n[keep]
    return grams[np.lexsort((grams, -n))[:ranks]]


def distances(text: str, codes: np.ndarray, rank: np.ndarray, langs: int, ranks: int) -> np.ndarray | None:
    """The out-of-place distance of a text to each language, from 0 to 1; None for a text without a letter.

    codes, rank: sorted n-grams of all profiles with their place in each (ranks where a profile has them not).
    """
    grams = top_grams(text, ranks)
    if grams is None:
        return None
    at = np.minimum(np.searchsorted(codes, grams), max(len(codes) - 1, 0))
    there = codes[at] == grams
    out = np.where(there[:, None], np.abs(rank[at] - np.arange(len(grams))[:, None]), ranks)
    out = np.where(rank[at] == ranks, ranks, out)
    return out.sum(0) / (ranks * len(grams))


def tables(profiles: Profiles, ranks: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    langs = list(profiles)
    codes = np.array(sorted({coded(g) for p in profiles.values() for g in p}), np.int64)
    rank = np.full((len(codes), len(langs)), ranks)
    for k, p in enumerate(profiles.values()):
        rank[np.searchsorted(codes, [coded(g) for g in p]), k] = np.arange(len(p))
    return langs, codes, rank


def lead(best: float, second: float) -> float:
    """How far the smallest distance is ahead of the next, as a share of that."""
    return 1.0 if second <= 0 else min(1.0, max(0.0, 1 - best / second))


def document_grams(rows: DataFrame, ranks: int) -> DataFrame:
    """(at, grams) of rows(at, text): the most frequent n-grams of each text, null without a letter; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [top_grams(text, ranks) if text else None for text in batch.column(1).to_pylist()]
            grams = [None if g is None else [spelled(x) for x in g.tolist()] for g in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.string()))], ["at", "grams"])

    return materialize(rows.select("at", "text").mapInArrow(run, "at long, grams array<string>"))


def predict_by_join(rows: DataFrame, profiles: DataFrame, ranks: int) -> DataFrame:
    """As predict(), of rows (doc_id, held_out, text), by joining documents' n-grams with a table of any number of profiles."""
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("at"), "*"))
    grams = document_grams(rows, ranks)
    each = grams.select("at", F.size("grams").alias("n"), F.posexplode("grams").alias("place", "gram"))
    near = F.lit(ranks) - F.abs(F.col("rank") - 1 - F.col("place"))
    close = each.join(profiles, "gram").groupBy("at", "lang").agg(F.sum(near).alias("near"), F.first("n").alias("n"))
    close = close.select("at", "lang", (1 - F.col("near") / (F.lit(float(ranks)) * F.col("n"))).alias("distance"))
    order = Window.partitionBy("at").orderBy("distance", "lang")
    two = close.withColumn("nth", F.row_number().over(order)).where("nth <= 2").groupBy("at")
    two = two.agg(F.min(F.struct("distance", "lang")).alias("best"), F.max("nth").alias("n"), F.max("distance").alias("second"))
    none = profiles.agg(F.min("lang").alias("least"))  # what wins where no n-gram of a document is in any profile
    distance, second = F.coalesce("best.distance", F.lit(1.0)), F.when(F.col("n") == 2, F.col("second")).otherwise(1.0)
    share = F.when(second <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - distance / second)))
    letters = F.col("grams").isNotNull()
    out = rows.join(grams, "at").join(two, "at", "left").crossJoin(F.broadcast(none))  # one row
    return out.select(
        "doc_id",
        "held_out",
        F.when(letters, F.coalesce("best.lang", "least")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, share).otherwise(0.0).alias("score"),
        F.when(letters, distance).otherwise(1.0).alias("distance"),
    )


def predict(docs: DataFrame, profiles: Profiles | DataFrame, ranks: int = RANKS) -> DataFrame:
    """docs(doc_id, text, ...) as doc_id, held_out, lang_pred and score, and the distance of the chosen language.

    The language is that of the smallest distance, the first by name of equal ones; score is how far it is ahead of
    the next, or of the largest possible distance, as a share of that. und and 0 where the text is null or has no
    letter, or where there is no profile. Equal rows give equal rows, an empty table none.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (~in_training("doc_id")).alias("held_out"), "text")
    if isinstance(profiles, DataFrame):
        return predict_by_join(rows, profiles, ranks)
    langs, codes, rank = tables(profiles, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, distance = [], [], []
            for text in batch.column(2).to_pylist():
                d = distances(text, codes, rank, len(langs), ranks) if text and langs else None
                best = None if d is None else int(d.argmin())
                pred.append(UNKNOWN if best is None else langs[best])
                distance.append(1.0 if best is None else float(d[best]))
                rest = [] if best is None else np.delete(d, best)
                score.append(0.0 if best is None else lead(distance[-1], float(min(rest)) if len(rest) else 1.0))
            out = [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(distance, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score", "distance"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, distance double")


def identify(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Learn from the documents that aren't held out, and predict all.

    A null lang teaches nothing; a null doc_id is held out. Equal rows give equal rows, an empty table none; columns
    other than doc_id, text and lang are not read.
    """
    return predict(docs, learn(docs.where(in_training("doc_id")), ranks), ranks)


def keep_identified(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """docs without those whose language can't be told: null text, no letters, or too far from the profile next to them.

    How far is too far is learned from the training documents whose language is told right: for each language and power
    of two of a text's length it is BEYOND of the way from the largest distance of these to 1. Where there are none of
    that length, a text stays if it is like any profile at all. Where nothing could be learned, as no document has a
    language, all texts with letters stay. Equal rows stay or go together; an empty table stays empty; all columns are
    as given.
    """
    bounded_batches(docs.sparkSession)
    profiles = learn(docs.where(in_training("doc_id")), ranks)
    few = not isinstance(profiles, DataFrame)
    rows = materialize(told_in_tasks(docs, profiles, ranks) if few else told_by_join(docs, profiles, ranks))
    rows = rows.where("_lang is not null").withColumn("_size", F.floor(F.log2(F.length("text"))))
    right = rows.where(in_training("doc_id") & (F.col("lang") == F.col("_lang")))
    limits = right.groupBy("_lang", "_size").agg(F.max("_distance").alias("_most"))  # rows by languages and sizes
    limit = F.col("_most") + BEYOND * (1 - F.col("_most"))
    near = (F.col("_distance") < 1) & F.coalesce(F.col("_distance") <= limit + 1e-9, F.lit(True))
    kept = rows.join(F.broadcast(limits) if few else limits, ["_lang", "_size"], "left").where(near)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def told_in_tasks(docs: DataFrame, profiles: Profiles, ranks: int = RANKS) -> DataFrame:
    """docs with _lang, the language of the smallest distance (null without a letter), and _distance; '' and 0 without profiles."""
    langs, codes, rank = tables(profiles, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, far = [], []
            for text in batch.column("text").to_pylist():
                if not langs:
                    lang.append("" if text and top_grams(text, ranks) is not None else None)
                    far.append(0.0)
                    continue
                d = distances(text, codes, rank, len(langs), ranks) if text else None
                lang.append(None if d is None else langs[int(d.argmin())])
                far.append(1.0 if d is None else float(d.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(far, pa.float64())], [*batch.schema.names, "_lang", "_distance"])

    return docs.mapInArrow(returning_memory(run), StructType([*docs.schema.fields, StructField("_lang", StringType()), StructField("_distance", DoubleType())]))


def told_by_join(docs: DataFrame, profiles: DataFrame, ranks: int = RANKS) -> DataFrame:
    """As told_in_tasks(), by joining documents' n-grams with a table of any number of profiles."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = materialize(docs.select(row).select(F.monotonically_increasing_id().alias("_at"), "row"))
    found = predict(rows.select(F.col("_at").alias("doc_id"), F.col("row.text").alias("text")), profiles, ranks)
    found = found.select(F.col("doc_id").alias("_at"), F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred")).alias("_lang"), F.col("distance").alias("_distance"))
    return rows.join(found, "_at").select("row.*", "_lang", "_distance")
