"""SentencePiece encoding and decoding, with giant documents split into chunks by a max-plus scan.

The public model merges pairs (BPE), so the best segmentation is not that of the largest sum of piece scores. What a
scan needs is a local weight: a sequence of pieces is the model's own exactly if every two neighbours, encoded
together, come out as these two. Such neighbours weigh 0 and all others minus infinity; the path of weight 0 is the
encoding, and sums and maxima over chunks combine as for any lattice.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches, materialize, tokenizer_file

#: Characters in a chunk; a text of no more is one chunk.
CHUNK = 50_000
#: Matrices that are combined into one at a time.
FAN = 64
SPACE = "▁"

State = tuple[int, int]  # of the piece over a boundary: characters behind the boundary, and in all


class Pieces:
    """The model, its pieces, and which may stand side by side."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        usual = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.id = {m.id_to_piece(i): i for i in usual}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in usual}
        self.longest = max(map(len, self.id))
        self.mark = m.piece_to_id(SPACE + "a")
        self.fits: dict[tuple[str, str], bool] = {}

    def is_piece(self, s: str) -> bool:
        """A piece of the vocabulary, or one character without a piece, which becomes bytes."""
        return len(s) == 1 or s in self.score

    def merged(self, s: str) -> list[str]:
        """The best pair, leftmost of equal ones, is merged until none is left."""
        parts = list(s)
        while True:
            best = max(
                ((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score),
                default=None,
            )
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    def weight(self, a: str, b: str) -> bool:
        """Whether two neighbours weigh 0 (else minus infinity)."""
        if (a, b) not in self.fits:
            if len(self.fits) > 500_000:
                self.fits.clear()
            self.fits[a, b] = self.merged(a + b) == [a, b]
        return self.fits[a, b]

    def ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            out += [self.id[p]] if p in self.id else [self.model.piece_to_id(f"<0x{b:02X}>") for b in p.encode()]
        return out

    def ends(self, t: str, start: int, to: int) -> Iterator[int]:
        """Where pieces that start here end."""
        for e in range(start + 1, min(to, start + self.longest) + 1):
            if self.is_piece(t[start:e]):
                yield e

    def paths(self, t: str, first: list[tuple[int, int]], stop: int, to: int) -> dict[tuple[int, int], tuple[int, int] | None]:
        """Forward pass: pieces (start, end) that paths of weight 0 reach from the first ones, each with one before it.

        Pieces that end at or behind stop are reached but not followed; nothing is read from `to` on.
        """
        before: dict[tuple[int, int], tuple[int, int] | None] = dict.fromkeys(first)
        by_end: dict[int, list[tuple[int, int]]] = {}
        for p in first:
            by_end.setdefault(p[1], []).append(p)
        at = min(by_end, default=stop)
        while at < stop:
            for p in by_end.pop(at, ()):
                for e in self.ends(t, at, to):
                    q = (at, e)
                    if q not in before and self.weight(t[p[0] : p[1]], t[at:e]):
                        before[q] = p
                        by_end.setdefault(e, []).append(q)
            at += 1
        return before


@cache
def pieces_of(path: str | None) -> Pieces:
    return Pieces(tokenizer_file("piece_bpe_32k.model", path))


def unit_start(t: str, a: int, b: int, last: bool = False) -> int:
    """The first (or last) place in [a, b) where a run of blanks begins, -1 if none: no piece lies across it."""
    at = b if last else a - 1
    while True:
        at = t.rfind(SPACE, a, at) if last else t.find(SPACE, at + 1, b)
        if at < 0 or (at > 0 and t[at - 1] != SPACE):
            return at


class Chunk:
    """One chunk: text with the characters around it that pieces over its ends can reach; [a, b) is its own."""

    def __init__(self, known: Pieces, t: str, a: int, b: int, opens: bool, closes: bool):
        self.known, self.t, self.a, self.b, self.opens, self.closes = known, t, a, b, opens, closes
        self.head = a if opens else unit_start(t, a, b)
        self.tail = b if closes else unit_start(t, max(a, 1), b, last=True)
        if opens and self.tail < 0:
            self.tail = a

    def entering(self) -> list[State]:
        """Pieces over the chunk's start: (characters in the chunk, length)."""
        n, t = self.known.longest, self.t
        return [(r, k) for r in range(n) for k in range(r + 1, min(n, self.a + r) + 1) if self.a + r <= len(t) and self.known.is_piece(t[self.a + r - k : self.a + r])]

    def piece(self, s: State) -> tuple[int, int]:
        return self.a + s[0] - s[1], self.a + s[0]

    def leaving(self, reached: dict[tuple[int, int], tuple[int, int] | None]) -> list[State]:
        return sorted((e - self.b, e - s) for s, e in reached if s < self.b <= e)

    def starts(self, at: int) -> list[tuple[int, int]]:
        return [(at, e) for e in self.known.ends(self.t, at, len(self.t))]

    def transfers(self) -> list[tuple[State, State]]:
        """The entries of weight 0 of the chunk's transfer matrix; (0, 0) stands for a document's start and end."""
        if self.head < 0:  # no unit begins here: every entering piece is followed through
            found = []
            for s in self.entering():
                reached = self.known.paths(self.t, [self.piece(s)], self.b, len(self.t))
                if self.closes:
                    found += [(s, (0, 0))] if any(e == self.b for _, e in reached) else []
                else:
                    found += [(s, out) for out in self.leaving(reached)]
            return found
        into = [(0, 0)] if self.opens else [s for s in self.entering() if self.through_head(s) is not None]
        if self.closes:
            return [(s, (0, 0)) for s in into]
        out = self.leaving(self.known.paths(self.t, self.starts(self.tail), self.b, len(self.t)))
        return [(s, o) for s in into for o in out]

    def through_head(self, s: State) -> list[tuple[int, int]] | None:
        """The pieces from an entering one to where the first unit begins."""
        if self.head < self.piece(s)[1]:
            return None
        return self.walk([self.piece(s)], self.head, lambda p: p[1] == self.head, self.head)

    def walk(self, first, stop, is_end, to) -> list[tuple[int, int]] | None:
        reached = self.known.paths(self.t, first, stop, to)
        end = next((p for p in reached if is_end(p)), None)
        back = []
        while end is not None:
            back.append(end)
            end = reached[end]
        return back[::-1] or None

    def encode(self, into: State, out: State) -> list[int]:
        """The ids of the pieces that start in this chunk, given those over its ends."""
        spell = lambda path: self.known.ids([self.t[s:e] for s, e in path])
        end = (lambda p: p[1] == self.b) if self.closes else lambda p: p == (self.b + out[0] - out[1], self.b + out[0])
        if self.head < 0:
            return spell(self.walk([self.piece(into)], self.b, end, len(self.t))[1:])
        ids = [] if self.opens else spell(self.through_head(into)[1:])
        if self.tail > self.head:
            inner = self.t[self.head + 1 : self.tail]  # the model puts the blank before it back
            ids += self.known.model.encode(inner, num_threads=1) if inner else self.known.ids([SPACE])
        if not self.closes:
            ids += spell(self.walk(self.starts(self.tail), self.b, end, len(self.t)))
        return ids


def chunks(rows: DataFrame, size: int, reach: int) -> DataFrame:
    """(at, doc_id, chunk, last, before, text) of rows (at, doc_id, text): texts in chunks, each with what is around.

    before: how much of the text of a chunk stands before its own size characters.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["at", "doc_id", "chunk", "last", "before", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, whole in enumerate(batch.column(2).to_pylist()):
                last = max(0, len(whole) - 1) // size
                for k in range(0, last + 1, 16):  # some chunks a batch
                    nth = np.arange(k, min(k + 16, last + 1))
                    start = np.maximum(nth * size - reach, 0)
                    text = [whole[a : c * size + size + reach] for a, c in zip(start.tolist(), nth.tolist(), strict=True)]
                    same = [batch.column(c).take(pa.array(np.full(len(nth), row))) for c in (0, 1)]
                    out = [*same, pa.array(nth), pa.array(np.full(len(nth), last)), pa.array(nth * size - start), pa.array(text, pa.string())]
                    yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, f"at long, doc_id {kind}, chunk long, last long, before long, text string")


def as_chunk(known: Pieces, text: str, chunk: int, last: int, before: int, size: int) -> Chunk:
    """The model sees a blank before the text and marks for blanks."""
    t, a = text.replace(" ", SPACE), before
    if chunk == 0:
        t, b = SPACE + t, size + 1
    else:
        b = a + size
    return Chunk(known, t, a, min(b, len(t)), chunk == 0, chunk == last)


Matrix = dict[tuple[State, State], float]  # entries above minus infinity


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices; it is associative."""
    by_in: dict[State, list[tuple[State, float]]] = {}
    for (i, o), w in b.items():
        by_in.setdefault(i, []).append((o, w))
    out: Matrix = {}
    for (i, mid), w in a.items():
        for o, more in by_in.get(mid, ()):
            out[i, o] = max(out.get((i, o), w + more), w + more)
    return out


def between(matrices: list[Matrix], into: State, out: State) -> list[tuple[State, State]]:
    """The states on both sides of each matrix on the best path from into to out; of equal ones the least."""
    best: list[dict[State, float]] = [{into: 0.0}]
    for m in matrices:
        reached: dict[State, float] = {}
        for (i, o), w in m.items():
            if i in best[-1]:
                reached[o] = max(reached.get(o, -float("inf")), best[-1][i] + w)
        best.append(reached)
    found, state = [], out
    for m, before in zip(reversed(matrices), reversed(best[:-1]), strict=True):
        value = max(before[i] + w for (i, o), w in m.items() if o == state and i in before)
        left = min(i for (i, o), w in m.items() if o == state and i in before and before[i] + w == value)
        found.append((left, state))
        state = left
    return found[::-1]


def packed(m: Matrix) -> list[list[float]]:
    return [[*i, *o, w] for (i, o), w in sorted(m.items())]


def unpacked(rows: list[list[float]]) -> Matrix:
    return {((int(a), int(b)), (int(c), int(d))): w for a, b, c, d, w in rows}


def combined(table: pd.DataFrame) -> pd.DataFrame:
    """One matrix of up to FAN neighbours of one document."""
    table = table.sort_values("chunk")
    whole = reduce(product, (unpacked(m) for m in table["moves"]))
    return pd.DataFrame({"at": table["at"].iloc[:1], "chunk": table["chunk"].iloc[:1] // FAN, "moves": [packed(whole)]})


def parted(table: pd.DataFrame) -> pd.DataFrame:
    """The states around each of up to FAN neighbours, from those around all of them together."""
    table = table.sort_values("chunk")
    into, out = table["into"].iloc[0], table["out"].iloc[0]
    found = between([unpacked(m) for m in table["moves"]], tuple(into), tuple(out))
    made = table[["at", "chunk"]].copy()
    made["into"], made["out"] = [list(i) for i, _ in found], [list(o) for _, o in found]
    return made


def boundary_states(moves: DataFrame, most: int) -> DataFrame:
    """(at, chunk, into, out): which pieces lie over a chunk's ends on its document's best path; most: chunks of a document.

    Up a tree, FAN neighbouring matrices at a time become one by their product, until one is left of each document; its
    ends are known, so down the tree every node learns the states around its children. No task holds more than FAN.
    """
    levels = [moves]
    while most > 1:
        group = (F.col("chunk") / FAN).cast("long")
        up = levels[-1].groupBy("at", group).applyInPandas(combined, "at long, chunk long, moves array<array<double>>")
        levels.append(materialize(up))
        most = -(-most // FAN)
    ends = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    states = levels[-1].select("at", "chunk", ends.alias("into"), ends.alias("out"))
    for below in reversed(levels[:-1]):
        above = states.withColumnRenamed("chunk", "above")
        rows = below.withColumn("above", (F.col("chunk") / FAN).cast("long")).join(above, ["at", "above"])
        states = rows.groupBy("at", "above").applyInPandas(parted, "at long, chunk long, into array<long>, out array<long>")
    return states


def encode(docs: DataFrame, path: str | None = None, size: int = CHUNK) -> DataFrame:
    """(doc_id, chunk, last, text, ids): each document's ids in order of chunk, and the chunk's own characters.

    A text of no more than size characters is one chunk, which the model encodes; a null or empty text is one without
    ids. Equal rows, also of null doc_id, stay apart; an empty table gives no rows; columns other than doc_id and text
    are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    reach = 2 * pieces_of(path).longest
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    large = rows.where(F.length("text") > size).select(F.monotonically_increasing_id().alias("at"), "*")
    giant = materialize(chunks(large, size, reach))

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(path)
        for batch in batches:
            moves = []
            for chunk, last, before, text in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                moves.append(packed(dict.fromkeys(as_chunk(known, text, chunk, last, before, size).transfers(), 0.0)))
            out = [batch.column(0), batch.column(2), pa.array(moves, pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(out, ["at", "chunk", "moves"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(path)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(2, 8)]
            ids, own = [], []
            whole = [t for t, last in zip(columns[3], columns[1], strict=True) if last == 0]
            simple = iter(known.model.encode(whole, num_threads=1) if whole else [])
            for chunk, last, before, text, into, out in zip(*columns, strict=True):
                if last == 0:
                    ids.append(next(simple))
                    own.append(text)
                else:
                    ids.append(as_chunk(known, text, chunk, last, before, size).encode(tuple(into), tuple(out)))
                    own.append(text[before : before + size])
            made = [batch.column(1), batch.column(2), batch.column(3), pa.array(own, pa.string()), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "chunk", "last", "text", "ids"])

    most = giant.agg(F.max("last") + 1).first()[0] or 0
    none, zero = F.lit(None).cast("array<long>"), F.lit(0).cast("long")
    small = rows.where(F.length("text") <= size)
    parts = small.select(zero.alias("at"), "doc_id", zero.alias("chunk"), zero.alias("last"), zero.alias("before"), "text", none.alias("into"), none.alias("out"))
    if most:
        moves = materialize(giant.mapInArrow(transfer, "at long, chunk long, moves array<array<double>>"))
        states = boundary_states(moves, most)
        parts = parts.unionByName(giant.join(states, ["at", "chunk"]).select(*parts.columns))
    return parts.mapInArrow(encoded, f"doc_id {kind}, chunk long, last long, text string, ids array<int>")


def decode_ids(known: Pieces, ids: list[int], first: bool) -> str:
    """The text of a document's ids, or of one chunk's.

    The model drops the blank that it puts before a text; a piece before other chunks keeps it from doing so there.
    """
    return known.model.decode(ids) if first else known.model.decode([known.mark, *ids])[1:]


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, chunk, n_tokens, ids_crc32 and n_chars (of the text decoded from the ids) of each chunk of encode().

    A null or empty text is one chunk of no tokens and no characters; equal rows give equal rows, an empty table none.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(path)
        for batch in batches:
            chunk, ids = (batch.column(c).to_pylist() for c in (1, 4))
            crc = [zlib.crc32(array("I", x).tobytes()) for x in ids]
            text = [decode_ids(known, x, k == 0) for x, k in zip(ids, chunk, strict=True)]
            out = [batch.column(0), batch.column(1), pa.array(list(map(len, ids)), pa.int64()), pa.array(crc, pa.int64()), pa.array(list(map(len, text)), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "chunk", "n_tokens", "ids_crc32", "n_chars"])

    return encoded.mapInArrow(run, f"doc_id {kind}, chunk long, n_tokens long, ids_crc32 long, n_chars long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, chunk, text) from the ids alone; a document is its chunks in order.

    Chunks without ids, as of null or empty texts, give an empty text; equal rows give equal rows, an empty table none.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(path)
        for batch in batches:
            chunk, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            text = [decode_ids(known, x, k == 0) for x, k in zip(ids, chunk, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["doc_id", "chunk", "text"])

    return encoded.select("doc_id", "chunk", "ids").mapInArrow(run, f"doc_id {kind}, chunk long, text string")
