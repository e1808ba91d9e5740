"""Secrets: assignments, access keys and long hex, and whatever a tokenizer finds unusually hard to spell."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from lectern.llm.shared import bounded_batches, tokenizer_file
from lectern.llm.spans import Span, cut, digest, listed

ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
#: A string that takes a token for less than so many of its characters is taken for random: random letters and digits
#: take one for 1.3 to 2.0, and the invented words of the test tables, which are strings of syllables, one for 2.2 or more.
MOST_CHARS_PER_TOKEN = 2.1
#: A run of so many letters is a word if it takes a token for at least so many of them; what is half words is an identifier.
WORD_LETTERS, WORD_CHARS_PER_TOKEN = 4, 2.5
#: Characters of a string that is put to the test, at least; and of shorter ones, of letters and digits alone, that change
#: between small letters, capitals and digits at least so often and take a token for less than so many characters.
LEAST, SHORT, CHANGES, MOST_SHORT_CHARS_PER_TOKEN = 20, 12, 3, 1.75
#: Fixed sequences; a string that mostly runs along these is no secret.
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "qwertyuiopasdfghjklzxcvbnm")
RUNS = frozenset(a + b for q in SEQUENCES for a, b in zip(q, q[1:]))

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that is too short fails as a whole, so the length can be part of it
HEX = re.compile(r"[0-9a-f]{24,}")
STRING = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
SHORT_STRING = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9]{{{SHORT},{LEAST - 1}}}(?![A-Za-z0-9+/_=-])")
#: Words, numbers and short codes, three or more, between separators: how hosts, constants, versions and dates are named.
SEGMENTS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Za-z0-9]{1,5})(?:[-_/.](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Za-z0-9]{1,5})){2,}\Z")
CLASSES = re.compile(r"[a-z]+|[A-Z]+|[0-9]+")
#: Digests (MD5 to SHA-512, in one case throughout) and UUIDs.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\Z"
)
#: Runs of letters that names are made of: capitals, or one capital at most before small letters.
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@cache
def encoding(path: str | None) -> tiktoken.Encoding:
    with open(tokenizer_file("byte_bpe_50k.tiktoken", path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing matches are dropped, and nothing in them is tried again."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def tokens_of(s: str, path: str | None) -> int:
    """How many tokens a string takes, in pieces of 500 characters, as time grows with the square of a run."""
    return sum(len(encoding(path).encode_ordinary(s[i : i + 500])) for i in range(0, len(s), 500))


def named(s: str, path: str | None = None) -> bool:
    """Whether at least half of a string is words, as names, paths and other identifiers are: runs of letters that spell well."""
    runs = [w for w in LETTERS.findall(s) if len(w) >= WORD_LETTERS]
    return 2 * sum(len(w) for w in runs if len(w) >= WORD_CHARS_PER_TOKEN * tokens_of(w.lower(), path)) >= len(s)


def sequence(s: str) -> bool:
    """Whether most neighbours in a string are neighbours in a fixed sequence."""
    low = s.lower()
    return sum(low[i : i + 2] in RUNS for i in range(len(low) - 1)) >= 0.7 * (len(low) - 1)


def random_spans(text: str, path: str | None = None, most: float = MOST_CHARS_PER_TOKEN) -> list[Span]:
    """Strings with a letter that are no known digest or identifier and spell badly: few characters a token.

    Measured on random strings (tests repeat it): found at 20, 32 and 64 characters are at least 0.99 of letters and
    digits, of base32, of capitals, and of letters of both cases, and 0.97 of small letters. Digits alone are numbers,
    not secrets. Shorter strings are too short for the ratio alone, so they need a digit and changes of class too; found
    at 16 characters are at least 0.8 of letters and digits, at 12 at least 0.7.
    """
    found = []
    for m in STRING.finditer(text):
        s = m[0]
        if not any(map(str.isalpha, s)) or KNOWN.match(s) or SEGMENTS.match(s) or sequence(s):
            continue
        if len(s) < most * tokens_of(s, path) and not named(s, path):
            found.append((*m.span(), "random"))
    for m in SHORT_STRING.finditer(text):
        s = m[0]
        if not any(map(str.isdigit, s)) or not any(map(str.isalpha, s)) or len(CLASSES.findall(s)) <= CHANGES:
            continue
        if len(s) < MOST_SHORT_CHARS_PER_TOKEN * tokens_of(s, path) and not named(s, path) and not sequence(s):
            found.append((*m.span(), "random"))
    return sorted(found)


def spans_of(text: str, path: str | None = None) -> tuple[list[Span], list[Span]]:
    """The base spans, and what the token test adds: random strings, without the parts that base spans have already."""
    base = base_spans(text)
    return base, cut(random_spans(text, path), base)


def find_secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random and n_spans (of all kinds) of each document's whole text.

    A null text has no spans, like an empty one. Equal rows give equal rows, and an empty table none; columns other
    than doc_id and text are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = spans_of(text or "", path)
                count = [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
                rows.append((*count, digest(base, ORDER), listed([*base, *more], ORDER), len(more), len(base) + len(more)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "n_spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names)

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, n_spans long"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def redact_secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with every secret in text replaced by [kind]; all rows and columns as given.

    A null text stays null, and an empty one empty. Equal rows stay equal, and an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text is not None:
                    base, more = spans_of(text, path)
                    text = replaced(text, [*base, *more])
                out.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the kind of its first in brackets."""
    parts, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])
