"""Quality rules, line first: lines that fail are left out, and documents that lose too much go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of fewer words fail, and those of which more than half the words are in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document must keep this share of the characters of its lines.
LEAST_KEPT = 0.5
#: A line fails with more symbols or exclamation marks than this share of its characters.
MOST_SYMBOLS, MOST_SHOUTS = 0.1, 0.05
#: A line with at least so many bars is a menu; one without end punctuation and of fewer words is a heading or label.
BARS, LABEL_WORDS = 3, 4

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fixed phrases of boilerplate lines in four languages, in lower case and with blanks for marks; they count as whole words.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "cookies", "enable javascript", "licensed under", "log in",
    "privacy policy", "sign up", "skip to content", "subscribe", "terms of service", "terms of use",
    "alle rechte vorbehalten", "datenschutzerklärung", "hier klicken", "impressum", "nutzungsbedingungen", "zum inhalt springen",
    "aviso legal", "haga clic aquí", "iniciar sesión", "política de privacidad", "términos de uso", "todos los derechos reservados",
    "cliquez ici", "conditions d utilisation", "mentions légales", "politique de confidentialité", "se connecter", "tous droits réservés",
)
#: Characters of a line that such a phrase makes boilerplate, at most; longer ones are prose that mentions it.
MOST_PHRASE = 160
#: Marks that stand between words like blanks.
MARKS = ".,;:!?()[]'\"|/-\t\r"
#: Marks that can end a sentence or stand behind its end.
ENDS = ".!?:;\"')]…»”"
#: Bits for a word's place in a packed number; the rest hold a hash.
PLACE = 24


def count_of(text: Column, marks: str) -> Column:
    """How many of the marks a text holds."""
    rest = reduce(lambda t, m: F.replace(t, F.lit(m), F.lit("")), marks, text)
    return F.length(text) - F.length(rest)


def line_passes(line: Column) -> Column:
    """The rules of one line: punctuation, navigation, boilerplate, symbols and shouting."""
    size = F.length(line)
    ends = F.btrim(line, F.lit(BLANKS))
    words = F.size(F.split(ends, "[ \\t-\\r]+"))
    spaced = F.concat(F.lit(" "), F.translate(F.lower(line), MARKS, " " * len(MARKS)), F.lit(" "))
    phrase = spaced.rlike(f" (?:{'|'.join(BOILERPLATE)}) ")  # one pass over the spaced line, which is made once
    return ~(
        (F.instr(F.lit(ENDS), F.right(ends, F.lit(1))) == 0) & (words < LABEL_WORDS)
        | (count_of(line, "|") >= BARS)
        | (count_of(line, SYMBOLS) > MOST_SYMBOLS * size)
        | (count_of(line, "!") > MOST_SHOUTS * size)
        | (size <= MOST_PHRASE) & phrase
    )


def covered(places: Column) -> Column:
    """How many words lie in windows of three that begin at these places, in order."""
    step = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))).cast("long"))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, b: a + b)


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars, line_chars.

    A null text has no words and fails, like an empty one. Equal rows give equal rows, and an empty table none;
    columns other than doc_id and text are not read. All built from SQL functions on the row: nothing is shuffled.
    """
    inner = F.btrim("text", F.lit(BLANKS))
    none = F.array().cast("array<string>")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.when(inner == "", none).otherwise(F.split(inner, "[ \\t-\\r]+")).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    # windows of three words as hashes; with their places in the low bits, equal ones are neighbours once sorted
    window = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    rows = rows.select("*", window.alias("windows"))
    packed = F.sort_array(
        F.transform("windows", lambda h, i: F.shiftleft(h, PLACE).bitwiseOR(i.cast("long")))
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select("*", F.when(repeats, packed).alias("packed"))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    key = lambda x: F.shiftright(x, PLACE)
    same = F.filter(
        "packed",
        lambda x, k: F.coalesce(key(x) == key(F.get("packed", k + 1)), F.lit(False))
        | F.coalesce(key(x) == key(F.get("packed", F.when(k > 0, k - 1))), F.lit(False)),
    )
    rows = rows.select("*", same.alias("same"))
    at = lambda i: F.concat_ws(" ", *(F.get("words", i + j) for j in range(3)))
    clash = F.exists(  # equal hashes of different windows
        F.transform(
            "same",
            lambda x, k: (key(x) == key(F.get("same", k + 1))) & (at(place(x)) != at(place(F.get("same", k + 1)))),
        ),
        lambda x: F.coalesce(x, F.lit(False)),
    ) | (F.size("words") >= 1 << PLACE)
    rows = rows.select("*", F.coalesce(clash, F.lit(False)).alias("clash"))
    spelled = F.array_sort(F.when(F.col("clash"), F.transform("windows", lambda _, i: F.struct(at(i).alias("w"), i.alias("i")))))
    rows = rows.select("*", spelled.alias("spelled"))
    exact = F.transform(
        F.filter(
            "spelled",
            lambda x, k: F.coalesce(x["w"] == F.get("spelled", k + 1)["w"], F.lit(False))
            | F.coalesce(x["w"] == F.get("spelled", F.when(k > 0, k - 1))["w"], F.lit(False)),
        ),
        lambda x: x["i"],
    )
    places = F.sort_array(F.when(F.col("clash"), exact).otherwise(F.transform("same", place)))
    good = F.filter("lines", line_passes)
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        places.alias("places"),
        F.length(F.array_join(good, "")).cast("long").alias("kept_chars"),
        F.length(F.array_join("lines", "")).cast("long").alias("line_chars"),
    )
    rows = rows.select("*", F.coalesce(covered(F.col("places")), F.lit(0).cast("long")).alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("kept_chars") >= LEAST_KEPT * F.col("line_chars"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select("*", failed.alias("base_failed")).select(*names, kept.alias("kept"), "kept_chars", "line_chars")


def _sql_count(of: str, marks: str) -> str:
    return f"(length({of}) - length(translate({of}, '{marks}', '')))"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_MARKS = "'" + MARKS.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '") + "'"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
h AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM g),
n AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM n) GROUP BY r),
q AS (SELECT r, unnest(lines) AS line FROM w),
e AS (SELECT r, line, trim(line, {_BLANKS}) AS t FROM q),
s AS (SELECT *, ' ' || translate(lower(line), {_MARKS}, '{" " * len(MARKS)}') || ' ' AS spaced FROM e),
v AS (SELECT r, sum(length(line)) AS line_chars, sum(length(line)) FILTER (NOT (
        (strpos('{ENDS.replace("'", "''")}', right(t, 1)) = 0 AND len(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+')) < {LABEL_WORDS})
        OR {_sql_count("line", "|")} >= {BARS}
        OR {_sql_count("line", SYMBOLS)} > {MOST_SYMBOLS} * length(line)
        OR {_sql_count("line", "!")} > {MOST_SHOUTS} * length(line)
        OR length(line) <= {MOST_PHRASE} AND ({" OR ".join(f"contains(spaced, ' {p} ')" for p in BOILERPLATE)}))) AS kept_chars FROM s GROUP BY r),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      {_sql_count("text", SYMBOLS)}::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
      coalesce(v.kept_chars, 0)::BIGINT AS kept_chars, coalesce(v.line_chars, 0)::BIGINT AS line_chars
      FROM w LEFT JOIN c USING (r) LEFT JOIN v USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_chars >= {LEAST_KEPT} * line_chars AS kept, kept_chars, line_chars FROM b
"""
