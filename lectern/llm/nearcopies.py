"""Near copies by the Jaccard similarity of word shingles: blocked by shared least hashes, compared as SimHash fingerprints
on bit planes, and verified on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bitplanes import close_pairs, majority, spanning_star
from lectern.llm.components import connected_components
from lectern.llm.shared import bounded_batches, discard, materialize, returning_memory

#: Words of a shingle, and the similarity from which two texts are near copies.
WIDTH, SIMILAR = 5, 0.8
#: Blocks: a pair of similarity s shares one with probability 1 - (1 - s**ROWS)**BANDS: all but 4e-5 of pairs at 0.8.
BANDS, ROWS = 14, 3
#: Bits in which fingerprints of such a pair differ at most: 10 to 12 on average with a deviation of 3, so all but 1e-6.
RADIUS = 28
#: A block of n texts that are still apart is cut into about sqrt(n / PART) parts, and into parts of at most HASHES hashes in
#: all; every two of its parts are a task's work.
PART, HASHES = 256, 1 << 21

_made = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
FACTORS, OFFSETS = _made[0] | np.uint64(1), _made[1]


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles, split into words as for fingerprints; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A 64-bit hash of each band of the set's least values; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 1024):  # giant texts in pieces
        np.minimum(least, (hashes[at : at + 1024, None] * FACTORS + OFFSETS).min(0), out=least)
    cells = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(c.tobytes(), k) - (1 << 63) for k, c in enumerate(cells)]


def signatures(docs: DataFrame) -> DataFrame:
    """(at, key, fp, n, bands) of docs(at long, text): a hash of the shingle set, its fingerprint, size and blocks."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps, sizes, cells = [], [], [], []
            for x in batch.column(1).to_pylist():
                s = shingles(x or b"")
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                fps.append(majority(s).view(np.int64))
                sizes.append(len(s))
                cells.append(bands(s))
            out = [batch.column(0), pa.array(keys, pa.binary()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["at", "key", "fp", "n", "bands"])

    rows = docs.select("at", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(returning_memory(run), "at long, key binary, fp long, n long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, hashes) of docs(at, text): the shingle set as sorted 64-bit numbers, in bytes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x or b"").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return docs.select("at", F.col("text").cast("binary").alias("text")).mapInArrow(returning_memory(run), "node long, hashes binary")


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, hashes) of the texts in docs(at, text) that nodes(at) name; only these are read as sets.

    The list of nodes is written first, so that its size is known when the join with the texts is planned.
    """
    nodes = materialize(nodes.distinct())
    sets = materialize(shingle_sets(docs.join(nodes, "at", "left_semi")))
    discard(nodes)
    return sets


def similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct written pairs(u, v) whose texts in docs(at, text) have a Jaccard similarity of SIMILAR or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= SIMILAR * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("at")), docs)
    first = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
    both = first.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    found = materialize(both.select("u", "v", "a", "b").mapInArrow(returning_memory(run), "u long, v long"))
    discard(sets)
    return found


def alike(a: str, b: str) -> F.Column:
    """Whether two structs (node, fp, n) can be near copies by their sizes and fingerprints."""
    size = F.least(f"{a}.n", f"{b}.n") >= SIMILAR * F.greatest(f"{a}.n", f"{b}.n")
    return size & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= RADIUS) & (F.col(f"{a}.node") != F.col(f"{b}.node"))


def split_in_two(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of two parts, the lower part first, and for each row which rows (from, to) it is compared with."""
    low = t.column("own_low").to_numpy()
    t = t.take(pa.array(np.argsort(~low, kind="stable")))
    rows, n = np.arange(len(low)), len(low)
    if t.column("lo")[0].as_py() == t.column("hi")[0].as_py():
        return t, rows + 1, np.full(n, n)
    return t, np.where(rows < low.sum(), low.sum(), n), np.full(n, n)


def with_partners(t: pa.Table) -> pa.Table:
    """Those rows of two parts that are within the radius of one of another component, by their bit planes."""
    t, first, end = split_in_two(t)
    i, j = close_pairs(t.column("fp").to_numpy().view(np.uint64), first, end, RADIUS)
    n, part = t.column("n").to_numpy(), t.column("component").to_numpy()
    good = (part[i] != part[j]) & (np.minimum(n[i], n[j]) >= SIMILAR * np.maximum(n[i], n[j]))
    keep = np.zeros(len(n), bool)
    keep[i[good]] = keep[j[good]] = True
    return t.filter(pa.array(keep))


def stars_of_copies(t: pa.Table) -> pa.RecordBatch:
    """A star (u, v) of each set of nodes that near copies among two parts connect, by counting shared hashes of whole sets."""
    t, first, end = split_in_two(t)
    sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
    size, node, part = np.array([len(s) for s in sets], np.int64), t.column("node").to_numpy(), t.column("component").to_numpy()
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    count = np.bincount(code)
    start, at = np.cumsum(count) - count, np.cumsum(size) - size
    found = [np.zeros((2, 0), np.int64)]
    for i in np.flatnonzero(first < end):
        mine = code[at[i] : at[i] + size[i]]
        mine = mine[count[mine] > 1]
        skip = np.cumsum(count[mine]) - count[mine]
        holders = owner[np.repeat(start[mine] - skip, count[mine]) + np.arange(count[mine].sum())]
        shared = np.bincount(holders, minlength=len(sets))[first[i] : end[i]]
        j = first[i] + np.flatnonzero((shared >= SIMILAR * (size[i] + size[first[i] : end[i]] - shared)) & (part[first[i] : end[i]] != part[i]))
        found.append(np.stack((np.full(len(j), i), j)))
    root, member = spanning_star(len(sets), *np.concatenate(found, axis=1))
    return pa.RecordBatch.from_arrays([pa.array(node[root]), pa.array(node[member])], ["u", "v"])


def copies_apart(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) that connect near copies of one bucket and different components, from rows (bucket, me, component).

    A bucket is cut into parts by a hash of the node, and every two of its parts are one task's work. First fingerprints
    are compared on bit planes, and only texts within the radius of one of another component go on; of these whole sets
    are compared. Only stars leave, so rows grow with the texts, not with the pairs.
    """
    size = F.greatest(F.sqrt(F.count("*") / PART), F.ceil(F.sum("me.n") / HASHES).cast("double"), F.lit(1.0))
    parts = rows.groupBy("bucket").agg(F.floor(size).cast("long").alias("parts"))
    cut = rows.join(parts, "bucket").select("*", F.pmod(F.xxhash64("me.node"), F.col("parts")).alias("own"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    cut = cut.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("own_low"), "me.*", "component")
    together = lambda df: df.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            yield from with_partners(t).to_batches()

    near_ones = materialize(together(cut).mapInArrow(returning_memory(near), cut.schema))
    sets = sets_of(near_ones.select(F.col("node").alias("at")), docs)
    full = together(near_ones.join(sets, "node").select(*near_ones.columns, "hashes"))
    found = materialize(full.mapInArrow(returning_memory(lambda batches: map(stars_of_copies, runs(batches, 3))), "u long, v long").distinct())
    discard(near_ones, sets)
    return found


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches as one table for each run of rows that are equal in the first columns (whole numbers)."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)])
        starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), key.shape[1]]
        for a, b in zip(starts, starts[1:]):
            if a < b:
                this = tuple(key[:, a])
                if this != last and kept:
                    yield pa.Table.from_batches(kept).combine_chunks()
                    kept = []
                kept.append(batch.slice(a, b - a))
                last = this
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def components(docs: DataFrame) -> DataFrame:
    """(at, component) of each of docs(at long, text): what near copies connect; texts of equal sets belong together.

    First each text is compared with one other, the least of its buckets' least that can be a copy; then, in buckets that
    are not one component yet, with one more member of each; then whatever is still apart in a bucket with all of it. What is
    connected needs no more comparing, so a group of any size takes few comparisons, and no bucket is capped.
    """
    marks = materialize(signatures(docs))
    best = marks.groupBy("key").agg(F.min(F.struct("at", "fp", "n", "bands")).alias("m"))
    classes = materialize(best.select("key", F.struct(F.col("m.at").alias("node"), "m.fp", "m.n").alias("me"), "m.bands"))
    cells = classes.select("me", F.explode("bands").alias("bucket"))
    shared = materialize(cells.groupBy("bucket").agg(F.count("*").alias("n"), F.min("me").alias("one")).where("n > 1"))
    cells = materialize(cells.join(shared.select("bucket", "one"), "bucket"))
    least = cells.where(alike("me", "one")).groupBy("me.node").agg(F.min("one.node").alias("u"))
    pairs = materialize(least.select("u", F.col("node").alias("v")))
    edges = similar(pairs, docs)
    labels = materialize(connected_components(edges))
    for last in (False, True):
        rows = cells.join(labels, F.col("me.node") == labels.node, "left").select("bucket", "me", F.coalesce("component", "me.node").alias("component"))
        parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.max("me").alias("some"))
        parts = parts.groupBy("bucket").agg(F.min(F.struct("n", "some")).alias("least"), F.count("*").alias("parts")).where("parts > 1")
        rows = materialize(rows.join(parts.select("bucket", F.col("least.some").alias("one")), "bucket"))
        if rows.isEmpty():
            break
        if last:
            found = copies_apart(rows.select("bucket", "me", "component"), docs)
        else:
            pairs = materialize(rows.where(alike("me", "one")).select(F.least("me.node", "one.node").alias("u"), F.greatest("me.node", "one.node").alias("v")).distinct())
            found = similar(pairs, docs)
            discard(pairs)
        edges, old = edges.unionByName(found), labels
        labels = materialize(connected_components(edges))
        discard(rows, old)
    classes = classes.join(labels, F.col("me.node") == labels.node, "left")
    classes = classes.select("key", F.coalesce("component", "me.node").alias("component"))
    return marks.select("at", "key").join(classes, "key").select("at", "component")
