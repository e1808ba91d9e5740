"""Near-duplicate vectors: E8 lattice hashing of random projections, cells compared in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bitplanes import spanning_star
from lectern.llm.components import connected_components
from lectern.llm.nearcopies import runs
from lectern.llm.shared import bounded_batches, discard, materialize

#: Least cosine of a link.
COSINE = 0.93
#: Hash tables, neighbouring cells probed in each, and the length of a unit vector in units of the lattice.
TABLES, PROBES, SCALE = 8, 2, 0.9
#: A cell of n vectors is cut into about sqrt(n / PART) blocks, every two of which are compared in a task: with n, blocks
#: grow as well as their number, so copies of a vector grow with the root of n only.
PART = 16
#: Vectors of a block that are multiplied at a time, which bounds memory.
TILE = 512
SEED = 8


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: of D8 or of D8 moved by a half."""

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(1) % 2)
        worst = np.abs(y - near)[odd].argmax(1)
        near[odd, worst] += np.where(y[odd, worst] >= near[odd, worst], 1, -1)
        return near

    a, b = even(x), even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """For unit vectors: cell numbers, (rows, tables, 1 + probes), first the own cell, then the nearest neighbours."""
    rng = np.random.default_rng(SEED)
    width = x.shape[1]
    turns = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-8 * tables // width))]
    axes = np.concatenate(turns, axis=1) * np.sqrt(width) * scale  # random axes, at right angles as far as they go
    steps, mix = roots(), rng.integers(1, 1 << 62, 8, dtype=np.int64) | 1
    found = np.empty((len(x), tables, 1 + probes), np.int64)
    for t in range(tables):
        y = x @ axes[:, 8 * t : 8 * t + 8] + rng.uniform(0, 1, 8)
        at = nearest(y)
        towards = np.argpartition(-((y - at) @ steps.T), probes, axis=1)[:, :probes]
        for k in range(1 + probes):
            point = at if k == 0 else at + steps[towards[:, k - 1]]
            with np.errstate(over="ignore"):
                found[:, t, k] = (np.rint(2 * point).astype(np.int64) * mix).sum(1) * 31 + t
    return found


def usable(column: str = "embedding") -> F.Column:
    """A vector with a direction: not null, nothing in it null or not finite, and not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda e: e != 0), F.lit(False))


def unit(values: pa.ListArray) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    width = len(values[0])
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def addresses(classes: DataFrame) -> DataFrame:
    """(id, label, width, all) of classes(id, label, embedding): its cells, own ones and visited ones of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array(batch.column(2).value_lengths())
            for width in np.unique(widths):
                rows = pa.array(np.flatnonzero(widths == width))
                found = cells(unit(batch.column(2).take(rows))).reshape(len(rows), -1)
                out = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(rows), width), pa.int64()), pa.array(list(found), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, ["id", "label", "width", "all"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("id", "label", "embedding").mapInArrow(run, f"id long, label {kind}, width long, all array<long>")


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one cell at which each pair of rows of cells (pairs, tables, 1 + probes) counts.

    Two vectors meet where one is at home and the other is at home or visits. Of the first table in which they do, it
    is the smaller cell.
    """
    there, back = (b == a[:, :, :1]).any(2), (a == b[:, :, :1]).any(2)
    first = (there | back).argmax(1)
    row = np.arange(len(a))
    low, high = a[row, first, 0], b[row, first, 0]
    both = there[row, first] & back[row, first]
    return np.where(both, np.minimum(low, high), np.where(there[row, first], low, high))


def linked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """What links add, of rows (key, lo, hi, low, cell, home, id, n, all, embedding) sorted by (key, lo, hi).

    Rows out: (id, root, more): the members of linked classes of an id, as far as they count here, and one vector that
    links connect it with. Two blocks of one cell are compared as matrix products of tiles; two visitors aren't compared.
    """

    def compared(t: pa.Table) -> pa.RecordBatch:
        low, cell, home, ids, n = (t.column(c).to_numpy() for c in ("low", "cell", "home", "id", "n"))
        x = unit(t.column("embedding").combine_chunks())
        at = t.column("all").combine_chunks().flatten().to_numpy().reshape(len(ids), TABLES, 1 + PROBES)
        within = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        left = np.arange(len(ids)) if within else np.flatnonzero(low)
        right = left if within else np.flatnonzero(~low)
        more, ends = np.zeros(len(ids), np.int64), [np.zeros((2, 0), np.int64)]
        for p in range(0, len(left), TILE):
            for q in range(p if within else 0, len(right), TILE):
                i, j = np.nonzero(x[left[p : p + TILE]] @ x[right[q : q + TILE]].T >= least - 1e-12)
                i, j = left[p + i], right[q + j]
                here = (i < j if within else i != j) & (home[i] | home[j])
                i, j = i[here], j[here]
                # the product of the pair alone decides, so that no other row changes the last digits
                here = np.einsum("ij,ij->i", x[i], x[j]) >= least
                i, j = i[here], j[here]
                here = meeting(at[i], at[j]) == cell[0]
                i, j = i[here], j[here]
                np.add.at(more, i, n[j])
                np.add.at(more, j, n[i])
                ends.append(np.stack(spanning_star(len(ids), i, j)))
        root, member = spanning_star(len(ids), *np.concatenate(ends, axis=1))
        to = np.arange(len(ids))
        to[member] = root
        keep = more > 0
        out = [pa.array(v[keep]) for v in (ids, ids[to], more)]
        return pa.RecordBatch.from_arrays(out, ["id", "root", "more"])

    yield from map(compared, runs(batches, 3))


def links(classes: DataFrame, least: float = COSINE) -> DataFrame:
    """(id, root, more) over classes(id, label, embedding, n) of one label; more, summed by id, counts linked rows.

    A pair of vectors is counted at one of the cells where it meets. Of what a block connects only a star is kept, so
    the rows that leave grow with the vectors, not with the links.
    """
    placed = materialize(addresses(classes))
    nth = F.posexplode("all").alias("nth", "cell")
    rows = placed.select("id", "label", "width", nth)
    rows = rows.select("id", "cell", F.xxhash64("cell", "label", "width").alias("key"), (F.col("nth") % (1 + PROBES) == 0).alias("home"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes"))
    sizes = materialize(sizes.where("n > 1 and homes > 0").select("key", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n") / PART))).cast("long").alias("blocks")))
    rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("low"), "cell", "home", "id")
    rows = rows.join(placed.select("id", "all"), "id").join(classes.select("id", "n", "embedding"), "id")
    rows = rows.select("key", "lo", "hi", "low", "cell", "home", "id", "n", "all", "embedding").repartition("key", "lo", "hi")
    rows = rows.sortWithinPartitions("key", "lo", "hi")
    found = materialize(rows.mapInArrow(lambda batches: linked(batches, least), "id long, root long, more long"))
    discard(placed, sizes)
    return found


def near_duplicate_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label).

    Equal vectors of one label are one class, whose members link with each other; classes link at a cosine of at
    least `least` in double precision, among those that share a lattice cell or visit one (the index; its recall is
    measured in the tests). Vectors that are null, zero or hold null or non-finite components, those without a label
    and those of different width link with nothing. A row without a link is its own component; component_id is the
    smallest vec_id reachable, null ids apart. Equal rows count as rows; an empty table gives none; columns other than
    vec_id, embedding and label are not read.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding", "label", (usable() & F.col("label").isNotNull()).alias("ok"))
    good = rows.where("ok")
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "*"))
    found = links(classes, least)
    labels = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    partners = found.groupBy("id").agg(F.sum("more").alias("more"))
    classes = classes.join(labels, classes.id == labels.node, "left").drop("node")
    classes = classes.withColumn("component", F.coalesce("component", "id"))
    least_id = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(least_id, "component").join(partners, "id", "left")
    links_of = F.col("n") - 1 + F.coalesce("more", F.lit(0))
    classes = classes.select("label", "embedding", "component_id", links_of.alias("n_links"))
    done = good.select("vec_id", "label", "embedding").join(classes, ["label", "embedding"])
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = done.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
