"""SimHash near-duplicates, compared on vertical bit planes (bitplanes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bitplanes import close_pairs, majority, spanning_star, within  # noqa: F401
from lectern.llm.components import connected_components
from lectern.llm.nearcopies import components
from lectern.llm.shared import bounded_batches, materialize

#: Fingerprints of one bucket that are compared with each other; larger buckets are cut finer.
BUCKET = 256


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority of the bits of all shingles' XXH64 (seed 42); 0 for a text without words. As a signed 64-bit integer."""
    words = text.lower().split()  # of bytes: only A-Z are lowered, and only ASCII white space splits
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last)), np.uint64, n)
    return int(majority(hashes).view(np.int64))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row of documents. A null text has no words, like an empty one."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x or b"", width) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def bucket_links(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (root, member) of each set of fingerprints that links connect within a bucket; sorted by bucket."""
    end = np.searchsorted(bucket, bucket, side="right")
    i, j = close_pairs(fp, np.arange(1, len(fp) + 1), end, radius)
    return spanning_star(len(fp), i, j)


def _finer(df: DataFrame, width: int) -> DataFrame:
    """Six buckets a row: of four blocks of the free bits, two must agree where two fingerprints differ in two bits at most.

    df: bucket, fp, free (4 * width bits). The other two blocks are the free bits of the finer bucket.
    """
    block = [F.shiftrightunsigned("free", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)]
    join = lambda i, j: F.shiftleft(block[i], width).bitwiseOR(block[j])
    ways = [(0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2), (1, 2, 0, 3), (1, 3, 0, 2), (2, 3, 0, 1)]
    cells = F.array(
        *(
            F.struct(F.xxhash64("bucket", F.lit(t), join(i, j)).alias("bucket"), join(p, q).alias("free"))
            for t, (i, j, p, q) in enumerate(ways)
        )
    )
    return df.select("fp", F.explode(cells).alias("c")).select("c.bucket", "fp", "c.free")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints(fp) that connect whatever differs in two bits at most.

    Candidates share two of four blocks. A bucket of more than BUCKET fingerprints is cut by blocks of the bits that
    are still free, twice if need be; then 8 free bits are left, so no bucket is larger and none is capped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def linked(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            root, member = bucket_links(b, f, 2)
            return pa.RecordBatch.from_arrays([pa.array(f[x].view(np.int64)) for x in (root, member)], ["u", "v"])

        for batch in batches:
            bucket = np.concatenate((bucket, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(bucket):
                ended = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
                yield linked(bucket[:ended], fp[:ended])
                bucket, fp = bucket[ended:], fp[ended:]
        yield linked(bucket, fp)

    rows = fps.select(F.lit(0).cast("long").alias("bucket"), "fp", F.col("fp").alias("free"))
    edges = None
    for width in (16, 8, 4):
        rows = materialize(_finer(rows, width))
        sizes = rows.groupBy("bucket").count().where("count > 1")
        rows = rows.join(sizes, "bucket")
        small = rows.where(F.col("count") <= BUCKET).repartition("bucket").select("bucket", "fp")
        found = small.sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        rows = rows.where(F.col("count") > BUCKET)
        if width == 4 or rows.isEmpty():
            break
    return edges


def near_duplicates(marked: DataFrame) -> DataFrame:
    """Add component (a number) and component_id to rows of (doc_id, fp, ...) by the links of their fingerprints.

    component_id is the smallest doc_id reachable; rows with a null doc_id take part, and it is null where a component
    has no other. marked is read more than once and should be a written table.
    """
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(links(classes.select("fp")))
    classes = classes.join(labels, classes.fp == labels.node, "left")
    classes = materialize(classes.select("fp", "first", F.coalesce("component", "fp").alias("component")))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    return marked.join(classes.join(least, "component").select("fp", "component", "component_id"), "fp")


def simhash_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document.

    Fingerprints of three-word shingles link at two or fewer differing bits. A null or empty text has fingerprint
    zero and links like any other. Equal rows stay separate rows; an empty table gives none; columns other than
    doc_id and text are not read.
    """
    found = near_duplicates(materialize(fingerprints(docs)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id, any one of equal rows; columns as given.

    Near copies share four fifths of their five-word shingles. 64-bit fingerprints at that similarity are about 10
    bits apart, too far to find each other by shared blocks of bits, so candidates meet otherwise (see nearcopies),
    are compared on bit planes at a radius that such pairs stay within, and are verified on their shingles. Texts without words are copies of each
    other. A row with a null doc_id stays only if its component has no other. An empty table stays empty.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("at"), row))
    found = components(rows.select("at", F.col("row.text").alias("text")))
    marks = rows.select("at", F.col("row.doc_id").alias("doc_id")).join(found, "at")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    kept = marks.groupBy("component").agg(F.min(first).alias("first"))
    return rows.join(kept.select(F.col("first.at").alias("at")), "at", "left_semi").select("row.*")
