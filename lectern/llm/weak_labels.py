"""Quality classifier from weak labels: overlapping heuristics, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches, discard, materialize

#: Documents, by order of their ids' hashes, that the linear scorer is trained on, and entries of their sparse rows in all.
SAMPLE, ENTRIES = 6000, 4_000_000
#: Hash buckets of words, and the weights of text shape behind them.
BUCKETS = 1 << 16
#: Rounds of EM at most, steps of training, and its shrinkage.
EM_ROUNDS, STEPS, SHRINK = 300, 150, 1e-4
#: Documents that score less are rejected.
LEAST = 0.5

SYMBOLS = "#*$%&|<>"
MARKS = frozenset(SYMBOLS)
#: Fixed lists of insults, in lower case: of the mind, and of the worth.
OF_MIND = frozenset("clown dumb idiot idiotic idiots imbecile imbeciles moron moronic morons stupid".split())
OF_WORTH = frozenset("bastard bastards disgusting loser losers pathetic scum trash ugly vermin worthless".split())
INSULTS = OF_MIND | OF_WORTH


@dataclass
class Shape:
    """Counts of a text that the labellers vote on."""

    words: list[str]
    chars: int
    symbols: float
    shouts: float
    upper: float
    distinct: float
    length: float
    lines_equal: float
    ended: float
    marked: float
    lines_marked: float
    letters: int
    stutter: float
    giants: float
    chars_equal: float
    stops: float
    of_mind: int
    of_worth: int

    @property
    def insults(self) -> int:
        return self.of_mind + self.of_worth


def shape_of(text: str) -> Shape:
    words = text.split()
    n, c = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    low = text.lower()
    lowered = low.split()
    symbols = sum(map(text.count, SYMBOLS))
    insults = [w for w in (w.strip(".,;:!?\"'()") for w in lowered) if w in INSULTS] if any(map(low.__contains__, INSULTS)) else []
    seen = set(lines)
    return Shape(
        words=lowered,
        chars=len(text),
        symbols=symbols / c,
        shouts=text.count("!") / c,
        upper=sum(map(str.isupper, words)) / n,
        distinct=len(set(words)) / n,
        length=sum(map(len, words)) / n,
        lines_equal=1 - len(seen) / max(1, len(lines)),
        ended=sum(x.rstrip()[-1] in ".!?:;\"')" for x in lines) / max(1, len(lines)),
        marked=symbols / n,
        lines_marked=sum(not MARKS.isdisjoint(x) for x in lines) / max(1, len(lines)),
        letters=sum(map(len, words)) - symbols,
        stutter=sum(map(str.__eq__, lowered, lowered[1:])) / n,
        giants=sum(w > 25 for w in map(len, words)) / n,
        chars_equal=1 - sum(map(len, seen)) / max(1, sum(map(len, lines))),
        stops=sum(map(text.count, ".!?:;")) / n,
        of_mind=sum(w in OF_MIND for w in insults),
        of_worth=sum(w in OF_WORTH for w in insults),
    )


def votes_of(s: Shape) -> tuple[int, ...]:
    """Each labeller's vote on a text's quality: 1 good, -1 bad, 0 none."""
    n = len(s.words)
    rich = s.distinct * n / max(1.0, min(n, 3 * n**0.5))  # distinct words against what so many words have at least
    return (
        1 if n else -1,
        1 if s.letters else -1,
        -1 if s.symbols > 0.03 else 1 if s.symbols < 0.005 else 0,
        -1 if s.marked > 0.2 else 1 if s.marked < 0.02 else 0,
        -1 if s.lines_marked > 0.5 else 1 if s.lines_marked < 0.1 else 0,
        -1 if s.shouts > 0.02 else 1 if s.shouts < 0.002 else 0,
        -1 if s.upper > 0.4 else 1 if s.upper < 0.1 else 0,
        -1 if rich < 0.5 else 1 if rich > 0.8 else 0,
        -1 if s.stutter > 0.25 else 1 if s.stutter < 0.08 else 0,
        1 if 3 <= s.length <= 9 else -1 if s.length < 2.5 or s.length > 12 else 0,
        -1 if s.giants > 0.1 else 1 if s.giants < 0.02 else 0,
        -1 if s.lines_equal > 0.3 else 1,
        -1 if s.chars_equal > 0.3 else 1,
        1 if s.ended > 0.8 else -1 if s.ended < 0.3 else 0,
        1 if s.stops > 0.04 else -1 if s.stops < 0.01 else 0,
    )


def toxic_votes_of(s: Shape) -> tuple[int, ...]:
    """Each labeller's vote on whether a text is toxic: -1 that it is, 1 that it isn't, 0 none."""
    return (
        -1 if s.of_mind else 1,
        -1 if s.of_worth else 1,
        -1 if s.insults > 1 else 1 if not s.insults else 0,
    )


#: What each labeller is about: a kind of bad text, with two at least for each.
KINDS = (
    "size", "size", "symbols", "symbols", "symbols", "shouting", "shouting", "repeated words", "repeated words", "words", "words",
    "repeated lines", "repeated lines", "ends", "ends",
)
TOXIC_KINDS = ("insults", "insults", "insults")
#: What is believed before a vote is seen: how often a labeller votes bad, not at all and good on good text, on bad text of
#: its kind, and on bad text of another kind. It counts like WEIGHT documents of each kind of text.
GOOD, OWN, OTHER, WEIGHT = np.array([0.01, 0.14, 0.85]), np.array([0.9, 0.05, 0.05]), np.array([0.05, 0.1, 0.85]), 10.0


@dataclass
class Labellers:
    """How common good text (0) and each kind of bad text is, and how labellers vote on them.

    table[c, j, v + 1]: how often labeller j votes v on text of class c. kinds: each labeller's own class, from 1.
    """

    prior: np.ndarray
    table: np.ndarray
    kinds: np.ndarray

    def shares(self, votes: np.ndarray) -> np.ndarray:
        """How likely each row of votes is of each class."""
        if not len(votes):
            return np.zeros((0, len(self.prior)))
        j = np.arange(votes.shape[1])
        log = np.stack([np.log(t[j, votes + 1]).sum(1) for t in self.table], 1) + np.log(self.prior)
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """How likely each row of votes is of a good document."""
        return self.shares(votes)[:, 0]


def estimate(patterns: dict[tuple[int, ...], int], kinds: tuple[str, ...] | None = None) -> Labellers:
    """Expectation-maximisation over the counts of vote patterns: a latent class for good text and one for each kind of bad.

    kinds: what each labeller is about; without it all are about one kind. A vote of none is an outcome like the
    others. It starts from the votes about each kind, and estimates all rates from the votes.
    """
    size = len(next(iter(patterns))) if patterns else len(kinds or KINDS)
    names = sorted(set(kinds)) if kinds else [""]
    of = np.array([1 + names.index(k) for k in kinds]) if kinds else np.ones(size, np.int64)
    belief = np.stack([np.repeat(GOOD[None], size, 0), *(np.where((of == c)[:, None], OWN, OTHER) for c in range(1, 1 + len(names)))])
    model = Labellers(np.full(len(belief), 1 / len(belief)), belief, of)
    if not patterns:
        return model
    votes, n = np.array(sorted(patterns)), np.array([patterns[k] for k in sorted(patterns)], float)
    cast = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # patterns, labellers, votes
    about = [votes[:, of == c] for c in range(1, len(belief))]
    bad = np.stack([(v < 0).any(1) / (1 + np.exp(2.0 * v.sum(1))) for v in about], 1)
    share = np.concatenate((np.maximum(1 - bad.sum(1, keepdims=True), 0.01), bad), 1)
    share /= share.sum(1, keepdims=True)
    for _ in range(EM_ROUNDS):
        weight = share * n[:, None]
        prior = weight.sum(0) + WEIGHT
        table = np.einsum("pc,pjv->cjv", weight, cast) + WEIGHT * belief
        table /= prior[:, None, None]
        model = Labellers(prior / prior.sum(), table, of)
        before, share = share, model.shares(votes)
        if np.abs(share - before).max() < 1e-6:
            break
    return model


def features(s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and text shape as a sparse row of length one: places and values."""
    hashed = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in s.words), np.int64, len(s.words)) % BUCKETS
    at, n = np.unique(hashed, return_counts=True)
    value = np.log1p(n)
    value = value / max(1e-9, float(np.sqrt((value**2).sum())))
    more = [1.0, min(1.0, len(s.words) / 200), min(1.0, s.symbols * 10), min(1.0, s.shouts * 10), s.upper, s.distinct, s.length / 10, s.lines_equal, s.ended, min(1.0, s.insults)]
    return np.concatenate((at, BUCKETS + np.arange(len(more)))), np.concatenate((value, more))


def train(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic scorer on soft labels, by gradient steps with a momentum; times: how often each row counts."""
    weights, moved = np.zeros(BUCKETS + 10), np.zeros(BUCKETS + 10)
    if not rows:
        return weights
    times = np.ones(len(rows)) if times is None else times
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, value = (np.concatenate(x) for x in zip(*rows, strict=True))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.bincount(row, value * weights[at], len(rows))))
        slope = np.bincount(at, value * (times * (good - p))[row], len(weights)) / times.sum() - SHRINK * weights
        moved = 0.9 * moved + slope
        weights = weights + 2.0 * moved
    return weights


def scores(weights: tuple[np.ndarray, ...], s: Shape) -> list[float]:
    at, value = features(s)
    return [float(1 / (1 + np.exp(-(w[at] @ value)))) for w in weights]


@dataclass
class Model:
    """Labellers of quality and of toxicity, and the weights of a linear scorer for each."""

    quality: Labellers
    clean: Labellers
    quality_weights: np.ndarray
    clean_weights: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Accuracies from the votes on all documents, and scorers trained on at most sample of them.

    Only counts of vote patterns (3 to the power of the labellers at most, and few of these occur) and the sample's rows
    go to the driver; of these, by order of their ids' hashes, only as many as have ENTRIES entries together. Rows of
    equal id and text are one that counts as often as it is there.
    """
    bounded_batches(docs.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shape_of(text or "")
                seen.update(((True, votes_of(s)), (False, toxic_votes_of(s))))
        out = pa.array([q for q, _ in seen], pa.bool_()), pa.array([list(v) for _, v in seen], pa.list_(pa.int64())), pa.array(list(seen.values()), pa.int64())
        yield pa.RecordBatch.from_arrays([*out], ["quality", "votes", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [shape_of(text or "") for text in batch.column(2).to_pylist()]
            places, values = zip(*map(features, shapes), strict=True) if shapes else ((), ())
            votes = [pa.array([list(f(s)) for s in shapes], pa.list_(pa.int64())) for f in (votes_of, toxic_votes_of)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *votes, pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["h", "k", "votes", "toxic_votes", "at", "value"])

    voted = docs.select("text").mapInArrow(vote, "quality boolean, votes array<long>, n long").groupBy("quality", "votes").agg(F.sum("n").alias("n")).collect()
    quality, clean = (estimate({tuple(r["votes"]): r["n"] for r in voted if r["quality"] == q}, kinds) for q, kinds in ((True, KINDS), (False, TOXIC_KINDS)))
    marked = docs.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("k"), "text")
    low = materialize(marked.select("h", "k").groupBy("h", "k").agg(F.count("*").alias("times")).orderBy("h", "k").limit(sample))
    chosen = marked.join(F.broadcast(low.select("h", "k")), ["h", "k"], "left_semi")  # as many rows as sample
    made = chosen.mapInArrow(rows, "h long, k long, votes array<long>, toxic_votes array<long>, at array<int>, value array<float>")
    made = materialize(made.dropDuplicates(["h", "k"]))
    so_far = F.sum("size").over(Window.orderBy("h", "k"))  # of as many narrow rows as sample
    fits = made.select("h", "k", F.size("at").alias("size")).select("h", "k", so_far.alias("so_far")).where(F.col("so_far") <= ENTRIES)
    table = made.join(fits, ["h", "k"]).join(low, ["h", "k"]).orderBy("h", "k").select("votes", "toxic_votes", "at", "value", "times").toArrow()
    at, value, times = (table.column(c).to_numpy() for c in ("at", "value", "times"))
    entries = [(np.asarray(a, np.int64), np.asarray(v, float)) for a, v in zip(at, value, strict=True)]
    weights = []
    for labellers, votes in ((quality, "votes"), (clean, "toxic_votes")):
        said = table.column(votes).to_pylist()
        weights.append(train(entries, labellers.posterior(np.array(said)) if said else np.zeros(0), np.asarray(times, float)))
    discard(low, made)
    return Model(quality, clean, *weights)


def classify(docs: DataFrame, model: Model | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, weak_label (the labellers' posterior), score, kept, toxic_label, toxic_score and is_toxic of each whole text.

    kept is about quality alone: a text that is well written is kept, and is_toxic says if it insults. A null text is
    judged like an empty one. Equal rows give equal rows, and an empty table none; columns other than doc_id and text
    are not read.
    """
    model = model or fit(docs)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as BUCKETS
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            shapes = [shape_of(text or "") for text in batch.column(1).to_pylist()]
            weak = m.quality.posterior(np.array([votes_of(s) for s in shapes], np.int64))
            clean = m.clean.posterior(np.array([toxic_votes_of(s) for s in shapes], np.int64))
            found = np.array([scores((m.quality_weights, m.clean_weights), s) for s in shapes], float).reshape(-1, 2)
            toxic = 1 - found[:, 1]
            out = [batch.column(0), weak, found[:, 0], found[:, 0] >= least, 1 - clean, toxic, toxic > 1 - least]
            yield pa.RecordBatch.from_arrays([out[0], *map(pa.array, out[1:])], ["doc_id", *(c.split()[0] for c in made.split(", "))])

    made = "weak_label double, score double, kept boolean, toxic_label double, toxic_score double, is_toxic boolean"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {made}")
