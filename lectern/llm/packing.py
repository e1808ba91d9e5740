"""Best-fit packing of tokenized documents into sequences, planned by linear grouping."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm.shared import bounded_batches, materialize, returning_memory, tokenizer_file

#: Tokens in a sequence.
CAPACITY = 2048
#: Groups of equal cardinality that large lengths are rounded up within.
GROUPS = 128
#: Lengths of at most this share of a sequence are small.
SMALL = 3 / 8
#: Columns of a configuration program at most; it may stop short of the optimum.
PIVOTS = 3000
#: Pieces that a task plans at a time, and groups of such a plan.
BUFFER, BUFFER_GROUPS = 8192, 64
#: A task closes the sequences of its plans with at most this share of a sequence empty; the rest is planned for all tasks.
SLACK = 1 / 512

#: Runs of so many characters without a blank are left to a tokenizer whose time doesn't grow with their square.
LONG_RUN = re.compile(r"\S{2000}")


@cache
def by_ranks(path: str | None) -> tiktoken.Encoding:
    """The vocabulary as ranks, which is the faster way."""
    with open(tokenizer_file("byte_bpe_50k.tiktoken", path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def by_model(path: str | None) -> Tokenizer:
    """The same vocabulary as a model; it takes 33 MB of a worker, and is there only where a text needs it."""
    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json", path))


@cache
def added_tokens(path: str | None) -> tuple[str, ...]:
    """The strings of the model's added tokens, from its file, in which they stand before the vocabulary."""
    with open(tokenizer_file("byte_bpe_50k.json", path), encoding="utf-8") as file:
        text = file.read()
    found, _ = json.JSONDecoder().raw_decode(text, text.index("[", text.index('"added_tokens"')))
    return tuple(t["content"] for t in found)


def ids(text: str, ranks_path: str | None = None, model_path: str | None = None) -> bytes:
    """The model's ids of a text as little-endian 32-bit numbers, without an end.

    Text that holds an added token or a very long run goes to the model, all other to the ranks; what they give is
    the same (tests compare whole tables).
    """
    if any(map(text.__contains__, added_tokens(model_path))) or LONG_RUN.search(text):
        return array("I", by_model(model_path).encode(text, add_special_tokens=False).ids).tobytes()
    return array("I", by_ranks(ranks_path).encode_ordinary(text)).tobytes()


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str | None, str | None] = (None, None), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece, and its place: sequence_id and offset, or task and rank.

    A document is the ids of its text (null: empty) and id 0. Longer ones than capacity are cut; the first piece
    takes what is left over, all others are full. A task plans BUFFER pieces at a time and closes the sequences that are
    full but for SLACK; what is in others waits for the next plan. What is left at the end, or what fills most of the
    buffer though planned, has no sequence yet, but a rank among the task's pieces of the same length. paths: the
    vocabulary's files, if not where this machine has them.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, at, start, length, crc, kept = [], [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            data = memoryview(ids(text or "", *paths) + b"\0\0\0\0")
            n = len(data) // 4
            cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                rows.append(row), at.append(k), start.append(a), length.append(b - a)
                crc.append(zlib.crc32(data[4 * a : 4 * b]))
            if with_ids:
                kept.append(data)
        out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            ends = np.cumsum([0, *length]).astype(np.int32)  # pieces follow each other as in their documents
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(kept), "<i4"))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen, made = np.zeros(capacity + 1, np.int64), 0
        held: list[pa.RecordBatch] = []

        def placed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            length = np.concatenate([b.column("length").to_numpy() for b in held])
            sequence, offset = assigned(length, capacity)
            full = np.bincount(sequence, length)[sequence] >= capacity * (1 - SLACK)
            _, sequence[full] = np.unique(sequence[full], return_inverse=True)
            sequence += (task << 40) + made
            made += len(np.unique(sequence[full]))
            planned, held, at = held[::-1], [], 0
            while planned:  # batch by batch, so that ids are there once
                b = planned.pop()
                here, at = full[at : at + b.num_rows], at + b.num_rows
                if not here.all():
                    held.append(b.filter(pa.array(~here)))
                b, rows = b.filter(pa.array(here)), at - len(here) + np.flatnonzero(here)
                yield from with_place(b, sequence[rows], offset[rows], np.zeros(len(rows), np.int64))
            if last or 2 * sum(b.num_rows for b in held) > BUFFER:
                planned, held = held[::-1], []
                while planned:
                    b = planned.pop()
                    rank = np.empty(b.num_rows, np.int64)
                    for k, n in enumerate(b.column("length").to_pylist()):
                        rank[k] = seen[n]
                        seen[n] += 1
                    yield from with_place(b, None, None, rank)
            elif held:
                held = pa.Table.from_batches(held).combine_chunks().to_batches()

        def with_place(b, sequence, offset, rank) -> Iterator[pa.RecordBatch]:
            numbers = lambda x: pa.nulls(b.num_rows, pa.int64()) if x is None else pa.array(x, pa.int64())
            t = pa.Table.from_batches([b])
            for name, x in (("sequence_id", sequence), ("offset", offset), ("task", np.full(b.num_rows, task)), ("rank", rank)):
                t = t.append_column(name, numbers(x))
            yield from t.to_batches(max_chunksize=1024)

        for batch in batches:
            held.append(cut(batch))
            if sum(b.num_rows for b in held) >= BUFFER:
                yield from placed(False)
        if held:
            yield from placed(True)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(returning_memory(run), f"{schema}, sequence_id long, offset long, task long, rank long")


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, largest first, in groups of equal cardinality: (length, documents) runs. Every length alone if few."""
    runs = sorted(counts.items(), reverse=True)
    if len(runs) <= groups:
        return [[r] for r in runs]
    share, found, room = -(-sum(counts.values()) // groups), [[]], 0
    room = share
    for length, n in runs:
        while n:
            take = min(n, room)
            found[-1].append((length, take))
            n, room = n - take, room - take
            if not room:
                found.append([])
                room = share
    return [g for g in found if g]


def best_configuration(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits and is worth most, by dynamic programming over the number of items."""
    at = np.arange(capacity + 1)[None, :] - sizes[:, None]
    value, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        with_one = np.where(at >= 0, worth[:, None] + value[np.maximum(at, 0)], -np.inf)
        pick = with_one.argmax(0)
        after = with_one[pick, np.arange(capacity + 1)]
        pick = np.where(after > value + 1e-12, pick, -1)
        if (pick < 0).all():
            break
        chosen.append(pick)
        value = np.maximum(after, value)
    config, room = np.zeros(len(sizes)), capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            config[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(config @ worth), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of configurations that together hold no more than the demand: the linear program, rounded down."""
    fit = capacity // sizes
    columns, inverse = np.diag(fit).astype(float), np.diag(1 / fit)
    amount = demand / fit
    for _ in range(PIVOTS):
        worth = inverse.sum(0)
        gain, config = best_configuration(worth, sizes, capacity)
        if gain <= 1 + 1e-7:
            break
        step = inverse @ config
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - step * ratio[out], 0)
        amount[out] = ratio[out]
        inverse[out] /= step[out]
        rest = np.arange(len(sizes)) != out
        inverse[rest] -= np.outer(step[rest], inverse[out])
        columns[:, out] = config
    left, found = demand.astype(np.int64).copy(), []
    for i in np.argsort(-amount, kind="stable"):
        config = columns[:, i].astype(np.int64)
        n = min(int(amount[i] + 1e-6), *(int(left[j] // config[j]) for j in np.flatnonzero(config)))
        if n > 0:
            left -= n * config
            found.append((n, config))
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, ...]]:
    """Where each document goes, from the number of documents of each length alone.

    Rows: length, lo, hi, sequence, copies, offset. Of the documents of a length, the one of rank lo <= r < hi goes to
    sequence + (r - lo) // copies at offset + (r - lo) % copies * length. Large lengths are rounded up to the largest
    of their group, configurations of rounded lengths are optimised, actual documents take their places, and
    whatever is left is put best-fit into the room that remains, longest first. The plan's size depends on the
    capacity, not on the number of documents.
    """
    if not counts:
        return []
    large = {k: n for k, n in counts.items() if k > capacity * SMALL}
    left = {k: n for k, n in counts.items() if k not in large}
    bins: list[tuple[int, tuple[int, ...]]] = []  # equal bins: how many, and the lengths in each
    if large:
        runs = grouped(large, groups)
        sizes, demand = np.array([g[0][0] for g in runs]), np.array([sum(n for _, n in g) for g in runs])
        queue = [list(g) for g in runs]
        for n, config in configurations(sizes, demand, capacity):
            made = [(n, ())]
            for g in np.flatnonzero(config):
                for _ in range(config[g]):
                    after = []
                    for m, held in made:
                        while m:
                            length, there = queue[g][0]
                            take = min(m, there)
                            after.append((take, (*held, length)))
                            m -= take
                            queue[g][:1] = [(length, there - take)] if there > take else []
                    made = after
            bins += made
        for g in queue:
            for length, n in g:
                left[length] = left.get(length, 0) + n
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(n: int, held: tuple[int, ...]) -> None:
        room = capacity - sum(held)
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((n, held))

    for n, held in bins:
        put(n, held)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                m, held, room = -(-n // (capacity // length)), (), capacity
            else:
                room = rooms[k]
                m, held = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(k)
            each = min(room // length, n)
            full = min(m, n // each)
            put(full, (*held, *[length] * each))
            n, m = n - full * each, m - full
            if m and n and n < each:
                put(1, (*held, *[length] * n))
                n, m = 0, m - 1
            if m and held:
                put(m, held)
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for same in by_room.values():
        for m, held in same:
            offset = 0
            for length in sorted(set(held), reverse=True):
                copies = held.count(length)
                rows.append((length, rank[length], rank[length] + m * copies, sequence, copies, offset))
                rank[length] += m * copies
                offset += copies * length
            sequence += m
    return rows


def assigned(length: np.ndarray, capacity: int, groups: int = BUFFER_GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each of some pieces, by a plan of their own."""
    sizes, counts = np.unique(length, return_counts=True)
    rows = np.array(sorted(plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), capacity, groups)), np.int64).reshape(-1, 6)
    order = np.argsort(length, kind="stable")
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
    wide = len(length) + 1
    size, low, _, sequence, copies, first = rows[np.searchsorted(rows[:, 0] * wide + rows[:, 1], length * wide + rank, side="right") - 1].T
    return sequence + (rank - low) // copies, first + (rank - low) % copies * size


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece of pieces(), written to a table, its sequence_id and offset.

    Only pieces that their task left over are planned here, from the number of them of each length, which goes to the
    driver (as many rows as capacity at most). The plan, whose size the capacity bounds, is broadcast; how many of a
    length the tasks before have is joined as the optimizer sees fit.
    """
    rest = made.where("sequence_id is null").drop("sequence_id", "offset")
    counts = materialize(rest.groupBy("length", "task").agg(F.count("*").alias("n")))
    of = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = np.array(plan(of, capacity), np.int64).reshape(-1, 6)
    table = pa.table(dict(zip(("of", "lo", "hi", "sequence", "copies", "first"), map(pa.array, rows.T), strict=True)))
    where = F.broadcast(made.sparkSession.createDataFrame(table))  # of Arrow: rows of tuples would start more workers
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rest.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    at = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    names = [c for c in made.columns if c not in ("task", "rank", "sequence_id", "offset")]
    planned = ranked.join(where, at).select(
        *names,
        (-1 - F.col("sequence") - F.floor(nth / F.col("copies"))).alias("sequence_id"),
        (F.col("first") + nth % F.col("copies") * F.col("length")).alias("offset"),
    )
    return made.where("sequence_id is not null").select(*names, "sequence_id", "offset").unionByName(planned)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str | None, str | None] = (None, None), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each document (and its ids).

    A null or empty text is the one id 0. Equal rows, also of equal or null doc_id, are packed as rows of their own;
    an empty table gives no rows; columns other than doc_id and text are not read.
    """
    return pack(materialize(pieces(docs, capacity, paths, with_ids)), capacity)
