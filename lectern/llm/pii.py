"""Personal data: fixed patterns, and a skip-chain conditional random field that carries labels to repeated tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.secrets import replaced
from lectern.llm.shared import bounded_batches, returning_memory
from lectern.llm.spans import Span, beside, digest, listed

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the field adds have a mark before them, and come after the base kinds.
ORDER = {k: i for i, k in enumerate((*KINDS, *(f"linked_{k}" for k in KINDS)))}
#: Documents, by order of their ids' hashes, that the field's potentials are estimated on.
SAMPLE = 4000
#: Messages have settled where none moves by more in a round. Of an old message a share stays, which grows with each of
#: so many rounds in which they haven't, to what the last one says.
SETTLED, STRETCH, DAMPING = 1e-6, 100, (0.3, 0.6, 0.8, 0.9, 0.95, 0.98)
#: A token is personal data if this much of its marginal lies on one kind.
LEAST = 0.5

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a run of digits can only be taken whole
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}+")  # shorter runs fail as a whole
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@+]\S*")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost addresses, found from their @: what a scan of the whole pattern gives, in linear time."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing matches are dropped, and nothing in them is tried again."""
    found = emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return found


@dataclass
class Tokens:
    """The marked tokens of a text: spans, features, labels that base spans give (0: none), and pairs of them.

    far holds pairs of an unlabelled token and a labelled one like it, wherever that is in the text.
    """

    spans: list[tuple[int, int]]
    features: list[int]
    labels: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    far: list[tuple[int, int]]


def feature_bits(s: str) -> int:
    """What a token looks like, as bits."""
    digits = sum(map(str.isdigit, s))
    marks = [
        True, "@" in s, "." in s.partition("@")[2], s[0] == "+", s.count(".") == 3, "-" in s, "(" in s, "." in s,
        any(map(str.isalpha, s)), digits == len(s),
        *(a <= digits <= b for a, b in ((0, 0), (1, 3), (4, 5), (6, 8), (9, 11), (12, 15), (16, 19), (20, 10**9))),
        *(a <= len(s) <= b for a, b in ((0, 5), (6, 10), (11, 20), (21, 10**9))),
    ]
    return sum(1 << i for i, x in enumerate(marks) if x)


FEATURES = 22


def marked_tokens(text: str, base: list[Span]) -> Tokens:
    """Tokens with a digit, @ or +, without punctuation around them; chained if one blank is between, skip-linked if alike.

    Tokens are alike if they have the same letters and digits in any case, the same six or more digits, or one is
    the local part of the other's address. Each is linked to the last before it that shares such a key, and an
    unlabelled one to the first of each label too, so that what is known of a token reaches all its repeats in one step.
    """
    spans, free = [], 0
    for m in MARKED.finditer(text):
        a, b = m.span()
        while a > free and not text[a - 1].isspace():
            a -= 1
        free = b
        s = text[a:b]
        a += len(s) - len(s.lstrip("\"'([{<,;:.!?"))
        b -= len(s) - len(s.rstrip("\"')]}>,;:.!?"))
        if a < b:
            spans.append((a, b))
    labels, k = np.zeros(len(spans), np.int64), 0
    ordered = sorted(base)
    for i, (a, b) in enumerate(spans):
        while k < len(ordered) and ordered[k][1] <= a:
            k += 1
        for at in range(k, len(ordered)):
            x, y, kind = ordered[at]
            if x >= b:
                break
            if a < y:
                labels[i] = 1 + KINDS.index(kind)
                break
    last: dict[str, int] = {}
    known: dict[str, dict[int, int]] = {}
    keys = []
    skip = set()
    for i, (a, b) in enumerate(spans):
        s = text[a:b].lower()
        core = "".join(filter(str.isalnum, s))
        digits = "".join(filter(str.isdigit, s))
        local = "".join(filter(str.isalnum, s.partition("@")[0])) if "@" in s else ""
        keys.append([k for k in {core, digits if len(digits) >= 6 else "", local if len(local) >= 5 else ""} if len(k) >= 5])
        for key in keys[-1]:
            if key in last:
                skip.add((last[key], i))
            last[key] = i
            if labels[i]:
                known.setdefault(key, {}).setdefault(int(labels[i]), i)
    heard = {(x, int(labels[y])) for pair in skip for x, y in (pair, pair[::-1])}
    far = {
        (min(i, j), max(i, j))
        for i in np.flatnonzero(labels == 0).tolist()
        for key in keys[i]
        for label, j in known.get(key, {}).items()
        if (i, label) not in heard
    }
    chain = [(i, i + 1) for i, (x, y) in enumerate(zip(spans, spans[1:])) if y[0] - x[1] <= 1]
    return Tokens(spans, [feature_bits(text[a:b]) for a, b in spans], labels, chain, sorted(skip), sorted(far))


@dataclass
class Field:
    """Potentials, as logarithms: node (features x labels), chain and skip (labels x labels)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def unpacked(bits: list[int]) -> np.ndarray:
    return (np.array(bits, np.int64)[:, None] >> np.arange(FEATURES) & 1).astype(float)


def fit_field(nodes: Counter, chain: Counter, skip: Counter) -> Field:
    """Potentials from counts of (features, label) and of (label, label) pairs, piece by piece.

    This is piecewise training: each factor is fitted on its own, the node's as a logistic regression and the pairs' as
    how much more often than by chance two labels meet at a link. Fitted together, the node weights would explain all
    labels, as these come of patterns, and nothing would be left for the links to say.
    """
    n = 1 + len(KINDS)
    weights = np.zeros((FEATURES, n))
    if nodes:
        x, y = unpacked([f for f, _ in nodes]), np.eye(n)[[k for _, k in nodes]]
        count = np.array(list(nodes.values()), float)
        share = np.sqrt(count)[:, None] / np.sqrt(count).sum()  # common shapes count less than in proportion
        for _ in range(400):
            p = np.exp(x @ weights - (x @ weights).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weights += 2.0 * (x.T @ (share * (y - p)) - 1e-4 * weights)

    def pairs(seen: Counter) -> np.ndarray:
        table = np.full((n, n), 0.5) + 2.0 * np.eye(n)
        for (a, b), c in seen.items():
            table[a, b] += c / 2
            table[b, a] += c / 2
        return np.log(table * table.sum() / np.outer(table.sum(1), table.sum(0)))

    return Field(weights, pairs(chain), pairs(skip))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Estimate the field on at most sample documents, those whose ids hash lowest, with base spans as labels."""
    bounded_batches(docs.sparkSession)
    low = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(low), "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                t = marked_tokens(text or "", base_spans(text or ""))
                seen.update(("node", f, int(k)) for f, k in zip(t.features, t.labels, strict=True))
                seen.update(("chain", int(t.labels[a]), int(t.labels[b])) for a, b in t.chain)
                seen.update(("skip", int(t.labels[a]), int(t.labels[b])) for a, b in t.skip)
        columns = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], ["what", "a", "b", "n"])

    made = chosen.mapInArrow(run, "what string, a long, b long, n long")
    rows = made.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()  # shapes, bounded by FEATURES and sample
    of = lambda what: Counter({(r["a"], r["b"]): r["n"] for r in sorted(rows) if r["what"] == what})
    return fit_field(of("node"), of("chain"), of("skip"))


def marginals(field: Field, tokens: Tokens) -> np.ndarray:
    """Each token's distribution over labels by loopy sum-product messages; labels of base spans are evidence.

    Messages are passed until they settle. Where they go round in a loop instead, after all of DAMPING, the mean of the
    last STRETCH rounds stands for them.
    """
    n = len(KINDS) + 1
    node = unpacked(tokens.features) @ field.node
    given = tokens.labels > 0
    node[given] = -30.0
    node[given, tokens.labels[given]] = 0.0
    known = {x for pair in (*tokens.skip, *tokens.far) for x, y in (pair, pair[::-1]) if given[y] and not given[x]}
    # Repeats that hear of a label themselves aren't linked to each other: their number would outweigh it.
    alike = [*((a, b) for a, b in tokens.skip if not (a in known and b in known)), *tokens.far]
    if tokens.chain or alike:
        a, b = np.array([*tokens.chain, *alike]).T
        source, target = np.concatenate((a, b)), np.concatenate((b, a))
        m = len(a)
        chained = np.concatenate((np.arange(m), np.arange(m))) < len(tokens.chain)
        message = np.zeros((2 * m, n))
        mean = np.zeros_like(message)
        for at in range(STRETCH * len(DAMPING)):
            stays, old = DAMPING[at // STRETCH], message
            total = node.copy()
            np.add.at(total, target, message)
            before = total[source] - np.concatenate((message[m:], message[:m]))  # without what came the other way
            before = np.exp(before - before.max(1, keepdims=True))
            new = np.empty_like(before)
            for rows, table in ((chained, field.chain), (~chained, field.skip)):  # two tables for all links
                new[rows] = before[rows] @ np.exp(table)
            new = np.log(new / new.sum(1, keepdims=True))
            message = stays * message + (1 - stays) * new
            message[given[target]] = 0.0  # evidence stays what it is, however many tokens lean away from it
            mean += (message - mean) / (at % STRETCH + 1)
            if np.abs(message - old).max() < SETTLED * (1 - stays):
                break
        else:
            message = mean
        np.add.at(node, target, message)
    p = np.exp(node - node.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def spans_of(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and tokens beside them that the field labels because tokens like them are labelled."""
    base = base_spans(text)
    if not base:
        return base, []
    tokens = marked_tokens(text, base)
    if not tokens.skip:
        return base, []
    p = marginals(field, tokens)
    linked = {i for pair in tokens.skip for i in pair}
    more = []
    for i in np.flatnonzero((p[:, 1:].max(1) >= LEAST) & (tokens.labels == 0)):
        if int(i) in linked:
            more.append((*tokens.spans[i], f"linked_{KINDS[int(p[i, 1:].argmax())]}"))
    return base, beside(more, base)


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_linked and n_spans (of all kinds) of each document's whole text.

    A null text has no spans, like an empty one. Equal rows give equal rows, and an empty table none; columns other
    than doc_id and text are not read.
    """
    field = field or fit(docs)
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = spans_of(text or "", field)
                count = [sum(s[2] == k for s in base) for k in KINDS]
                rows.append((*count, digest(base, ORDER), listed([*base, *more], ORDER), len(more), len(base) + len(more)))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_linked", "n_spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_linked long, n_spans long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span in text replaced by [kind]; all rows and columns as given.

    A null text stays null, and an empty one empty. Equal rows stay equal, and an empty table stays empty.
    """
    field = field or fit(docs)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text is not None:
                    base, more = spans_of(text, field)
                    text = replaced(text, [*base, *more])
                out.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(returning_memory(run), docs.schema)
