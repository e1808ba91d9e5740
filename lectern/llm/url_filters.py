"""URL filters: rules for hosts and paths, and a weighted vocabulary that is searched for with Aho-Corasick."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: Rules for hosts and their subdomains whose paths begin so; the longest that fits decides.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: One of these rejects a URL. Spellings in a line are one term.
STRICT = """
porn porno pornography pornographic
xxx
adult adults
hentai
milf milfs
bdsm
camgirl camgirls
escorts
nsfw
erotica erotic
casino casinos
viagra
cialis
warez
keygen keygens
spam spammer spammers
malware
phishing
"""

#: So many different ones of these reject a URL.
SOFT = """
sex sexy
nude nudes naked
girls
dating
webcam webcams
bet bets betting
bookmaker bookmakers
poker
slots
jackpot jackpots
lottery lotto
gambling
win winner winners
bonus bonuses
free
cheap cheapest
discount discounts
pill pills
pharmacy pharma
weightloss
loan loans
payday
crack cracked cracks
torrent torrents
ad ads adserver adservers
track tracker trackers tracking
banner banners
popup popups
click clicks
affiliate affiliates
farm farms
backlink backlinks
replica replicas
"""

#: Terms within one of these, with any one separator for each blank, count for nothing.
SAFE = """
adult education
adult learning
adult literacy
adult learners
adult social care
young adult
young adults
older adults
anti spam
antispam
spam filter
spam filters
anti malware
malware analysis
malware removal
anti phishing
sex education
sex discrimination
sex differences
free software
open and free
track and field
bet shemesh
"""

STRICT_WEIGHT, SOFT_WEIGHT, REJECT = 2, 1, 2
_LOWER = {c: c + 32 for c in range(65, 91)}
_ESCAPE = re.compile("%([0-7][0-9a-fA-F])")
_HOST, _PATH = re.compile("[^/?#]*"), re.compile("[^?#]*")
FOUND = "host string, path string, rule string, verdict string, n_strict long, n_soft long, terms string"


def spellings(lines: str) -> dict[str, str]:
    """Each spelling of a vocabulary, and the first one of its line."""
    return {word: line.split()[0] for line in lines.strip().splitlines() for word in line.split()}


def host_and_path(url: str | None) -> tuple[str, str]:
    """What a URL has after its first `://`; both empty where it has none."""
    _, there, rest = (url or "").partition("://")
    host = _HOST.match(rest)[0] if there else ""
    return host.translate(_LOWER), _PATH.match(rest, len(host))[0] if there else ""


class Vocabulary:
    """An automaton for strict, soft and safe terms."""

    def __init__(self, strict: str, soft: str, safe: str):
        self.found = ahocorasick.Automaton()
        for word, term in spellings(soft).items():
            self.found.add_word(word, (len(word), SOFT_WEIGHT, term))
        for word, term in spellings(strict).items():
            self.found.add_word(word, (len(word), STRICT_WEIGHT, term))
        for phrase in safe.strip().splitlines():
            self.found.add_word(phrase, (len(phrase), 0, ""))
        self.found.make_automaton()

    def terms(self, url: str) -> dict[str, int]:
        """The distinct terms of a URL and their weights.

        Escapes of ASCII characters are read, A-Z count as a-z, and a term stands alone: no ASCII letter or digit and
        no character beyond ASCII is next to it.
        """
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), url).translate(_LOWER)
        text = "".join(c if c >= "\x80" or c.isalnum() else " " for c in text)
        text = f" {text} "
        hits, safe = [], []
        for last, (length, weight, term) in self.found.iter(text):
            start, end = last + 1 - length, last + 1
            if text[start - 1] == text[end] == " ":
                (hits if weight else safe).append((start, end, weight, term))
        safe.sort()
        starts, ends = [a for a, *_ in safe], list(accumulate((b for _, b, *_ in safe), max))
        held = lambda a, b: (k := bisect_right(starts, a)) and ends[k - 1] >= b
        return {term: w for a, b, w, term in hits if not held(a, b)}


class Rules:
    """Rules by host; a URL's host and its parents are looked up, longest rule first."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)

    def fitting(self, host: str, path: str) -> Rule | None:
        labels = host.split(".")
        parents = (".".join(labels[k:]) for k in range(len(labels)))
        fit = (r for parent in parents for r in self.by_host.get(parent, ()) if path.startswith(r.path))
        return max(fit, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)


@lru_cache
def _vocabulary(strict: str, soft: str, safe: str) -> Vocabulary:
    return Vocabulary(strict, soft, safe)


@lru_cache
def _rules(rules: tuple[Rule, ...]) -> Rules:
    return Rules(rules)


def judge(url: str | None, rules: Rules, vocabulary: Vocabulary) -> tuple:
    """A row of FOUND for a URL."""
    host, path = host_and_path(url)
    rule, terms = rules.fitting(host, path), vocabulary.terms(url or "")
    strict = sum(w == STRICT_WEIGHT for w in terms.values())
    verdict = rule.verdict if rule else "block" if sum(terms.values()) >= REJECT else "allow"
    return host, path, rule and rule.host + rule.path, verdict, strict, len(terms) - strict, ",".join(sorted(terms))


def judged(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: str = STRICT, soft: str = SOFT, safe: str = SAFE
) -> DataFrame:
    """pages with one more column, `judged`, a struct of FOUND.

    A rule's verdict holds where one fits. Else a URL is blocked for one strict term or two different soft ones, anywhere
    in it; a term within a safe phrase doesn't count. Nothing moves between machines, and only the url goes to Python.
    A null or empty url, or one without `://`, has an empty host and path, so that no rule fits; terms are looked for in
    all of it. Equal rows stay separate rows, other columns stay as they are, and an empty table stays empty.
    """
    bounded_batches(pages.sparkSession)
    rules = tuple(rules)

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        by_host, words = _rules(rules), _vocabulary(strict, soft, safe)
        for urls in batches:
            yield pd.DataFrame([judge(u, by_host, words) for u in urls], columns=names)

    return pages.withColumn("judged", found("url"))


def filter_urls(pages: DataFrame, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, terms) of every page; see judged()."""
    return judged(pages.select("page_id", "url"), **how).select("page_id", "judged.*")


def keep_allowed(pages: DataFrame, **how) -> DataFrame:
    """The pages whose URL is not blocked, with their columns as given; see judged()."""
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row")
    kept = judged(pages.select(row, F.col("url").alias("url")), **how).where(F.col("judged.verdict") != "block")
    return kept.select(*(F.col("row")[c].alias(c) for c in pages.columns))


def _quoted(*values: str) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def oracle() -> str:
    """SQL with the rows of filter_urls. Separators are doubled, so that neighbouring terms needn't share one."""
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "CAST('0x' || substr(x, 1, 2) AS INTEGER)"
    read = f"CASE WHEN i > 1 AND regexp_matches(x, '^[0-7][0-9a-fA-F]') THEN chr({byte}) || substr(x, 3) WHEN i > 1 THEN '%' || x ELSE x END"
    safe = "|".join(sorted((p.replace(" ", "  ") for p in SAFE.strip().splitlines()), key=len, reverse=True))
    words = [(w, t, n) for lines, n in ((STRICT, STRICT_WEIGHT), (SOFT, SOFT_WEIGHT)) for w, t in spellings(lines).items()]
    return f"""
WITH rules(h, p, v) AS (VALUES {", ".join(_quoted(*r) for r in RULES)}),
words(w, t, n) AS (VALUES {", ".join(f"('{w}', '{t}', {n})" for w, t, n in words)}),
u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
a AS (SELECT r, page_id, url, strpos(url, '://') AS cut, substr(url, strpos(url, '://') + 3) AS rest FROM u),
b AS (SELECT *, CASE WHEN cut > 0 THEN regexp_extract(rest, '^[^/?#]*') ELSE '' END AS raw FROM a),
c AS (SELECT r, page_id, {lower("raw")} AS host, CASE WHEN cut > 0 THEN regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') ELSE '' END AS path,
      ' ' || regexp_replace({lower(f"array_to_string(list_transform(string_split(url, '%'), lambda x, i: {read}), '')")},
      '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]', '  ', 'g') || ' ' AS t FROM b),
s AS (SELECT * REPLACE (regexp_replace(t, ' ({safe}) ', '  ', 'g') AS t) FROM c),
fit AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS k
        FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
hit AS (SELECT DISTINCT r, words.t, n FROM s JOIN words ON contains(s.t, ' ' || w || ' ')),
hits AS (SELECT r, count(*) FILTER (n = {STRICT_WEIGHT}) AS n_strict, count(*) FILTER (n = {SOFT_WEIGHT}) AS n_soft, sum(n) AS weight,
         string_agg(t, ',' ORDER BY t) AS terms FROM hit GROUP BY r)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN weight >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(terms, '') AS terms
FROM s LEFT JOIN hits USING (r) LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (r)
"""


ORACLE = oracle()
