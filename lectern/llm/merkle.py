"""A Merkle manifest of a dataset: a tree for each source, one over the sources, and a proof for every document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import bounded_batches, materialize

#: Children of a node; levels and leaves of the aligned blocks that one task walks through at a time.
FANOUT, LEVELS = 16, 3
BLOCK = FANOUT**LEVELS
#: Documents with an id whose checksum this divides are the ones tampered with.
TAMPERED = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def height(n: int) -> int:
    """Levels that a block climbs, of a tree with n nodes at its level: until one node is left, at most LEVELS."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def climb(leaves: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """The root over leaves, so many levels up, and each leaf's path: what stands before and after it, level by level.

    The traversal is in postorder: a subtree gives back its digest, and on the way back the digests of its siblings are
    appended to the paths of the leaves that it contains.
    """
    paths: list[list[str]] = [[] for _ in leaves]

    def visit(low: int, level: int) -> str:
        if not level:
            return leaves[low]
        step = FANOUT ** (level - 1)
        starts = range(low, min(low + FANOUT * step, len(leaves)), step)
        below = [visit(at, level - 1) for at in starts]
        for k, at in enumerate(starts):
            beside = ["".join(below[:k]), "".join(below[k + 1 :])]
            for leaf in range(at, min(at + step, len(leaves))):
                paths[leaf] += beside
        return digest("".join(below))

    return visit(0, levels), paths


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for before, after in zip(path[::2], path[1::2], strict=True):
        leaf = digest(before + leaf + after)
    return leaf


def _cut(digests: str) -> list[str]:
    return [digests[k : k + HEX] for k in range(0, len(digests), HEX)]


@F.pandas_udf(T.StringType())
def _root(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for digests, n in batches:
        yield pd.Series([climb(_cut(d), height(k))[0] for d, k in zip(digests, n, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _paths(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for digests, n, above in batches:
        rows = zip(digests, n, above, strict=True)
        yield pd.Series([[[*p, *up] for p in climb(_cut(d), height(k))[1]] for d, k, up in rows], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("leaf", "proof", "folded")])))
def _proofs(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for digests, seen, n, above in batches:
        found = []
        for d, now, k, up in zip(digests, seen, n, above, strict=True):
            paths = [[*p, *up] for p in climb(_cut(d), height(k))[1]]
            rows = zip(_cut(d), _cut(now), paths, strict=True)
            found.append([{"leaf": x, "proof": digest("".join(p)), "folded": fold(y, p)} for x, y, p in rows])
        yield pd.Series(found, dtype=object)


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a document's fields, each with its length in bytes."""
    said = []
    for name in FIELDS:
        text = columns[name].cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*said), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows of (grp, ...) with pos, their place in grp by order (nulls first), and n, the rows of grp.

    Rows are partitioned and sorted by ranges of (grp, order); a small table of where each range takes up a group gives
    the rest, so a group of any size is in as many tasks as it needs.
    """
    keys = ["grp", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    starts = ranged.groupBy(part, "grp").agg(F.min("at").alias("start"), F.count("*").alias("held"))
    of = Window.partitionBy("grp")
    before = F.coalesce(F.sum("held").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("part", "grp", (before - F.col("start")).alias("shift"), F.sum("held").over(of).alias("n"))
    placed = ranged.withColumn("part", part).join(starts, ["part", "grp"])
    return placed.withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(nodes: DataFrame, **more: str) -> DataFrame:
    """(grp, block, n, digests, ...): nodes (grp, pos, n, digest) of aligned blocks, in order; more columns as arrays."""
    held = ["pos", "digest", *more.values()]
    listed = F.sort_array(F.collect_list(F.struct(*held)))  # BLOCK rows at most
    rows = nodes.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block"), "n").agg(listed.alias("held"))
    return rows.select("grp", "block", "n", F.array_join("held.digest", "").alias("digests"), *(F.col(f"held.{c}").alias(k) for k, c in more.items()))


def _above(blocks: DataFrame) -> DataFrame:
    """(grp, block, path, top): for each block, the path from its root to its group's root, and that root.

    The blocks' roots are the leaves of another such traversal, until every group has one.
    """
    roots = blocks.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK} - 1) div {BLOCK}").alias("n"), _root("digests", "n").alias("digest"))
    roots = materialize(roots)
    if (roots.agg(F.max("n")).first()[0] or 0) <= 1:
        return roots.select("grp", F.col("pos").alias("block"), F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    return paths(roots).withColumnRenamed("pos", "block")


def paths(nodes: DataFrame) -> DataFrame:
    """(grp, pos, path, top) for nodes (grp, pos, n, digest): each one's path to its group's root, and that root."""
    blocks = materialize(_blocks(nodes))
    rows = blocks.join(_above(blocks), ["grp", "block"])
    each = F.posexplode(_paths("digests", "n", "path")).alias("k", "path")
    return rows.select("grp", "block", "top", each).select("grp", (F.col("block") * BLOCK + F.col("k")).alias("pos"), "path", "top")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Leaves of a source ascend by doc_id, those with the same doc_id by digest; a null doc_id comes first, and is tampered
    with never. A null source is a source of its own, before the others. Equal rows are leaves of their own. A null field
    is told from an empty one. Other columns don't matter. An empty table has an empty manifest.

    Texts are read once, for the leaves; what moves afterwards are digests. A source of any size is cut into aligned
    blocks of 4,096 leaves, each walked through in one task; block roots feed the next traversal, sources' roots the last.
    The only thing that the driver learns is the number of nodes of the widest group of a level.
    """
    bounded_batches(docs.sparkSession)
    fields = {c: F.col(c) for c in FIELDS}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    grp = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # in the order of sources, null first
    seen = F.when(picked & (lowered != F.col("text")), leaf(fields | {"text": lowered}))
    leaves = docs.select("doc_id", grp.alias("grp"), leaf(fields).alias("digest"), seen.alias("seen"))
    leaves = leaves.withColumn("seen", F.coalesce("seen", "digest"))
    blocks = _blocks(numbered(materialize(leaves), ["doc_id", "digest"]), ids="doc_id", seen="seen")
    blocks = materialize(blocks.withColumn("seen", F.array_join("seen", "")))
    trees = materialize(_above(blocks))

    sources = trees.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("digest"))
    sources = materialize(numbered(sources, ["name"]))
    whole = paths(sources).withColumnRenamed("path", "rest").withColumnRenamed("top", "root")
    whole = sources.join(whole, ["grp", "pos"]).select(F.col("name").alias("grp"), "rest", "root")
    wide = blocks.groupBy("grp").agg(F.max("block").alias("most"))  # a row for each BLOCK blocks, so that no key is hot
    whole = whole.join(wide, "grp").select("grp", "rest", "root", F.explode(F.expr(f"sequence(0L, most div {BLOCK})")).alias("part"))
    trees = trees.withColumn("part", F.expr(f"block div {BLOCK}")).join(whole, ["grp", "part"])
    trees = trees.select("grp", "block", F.concat("path", "rest").alias("path"), F.col("top").alias("subroot"), "root")

    rows = blocks.join(trees, ["grp", "block"])
    made = F.arrays_zip("ids", _proofs("digests", "seen", "n", "path").alias("p")).alias("rows")
    rows = rows.select("subroot", "root", made).select("subroot", "root", F.inline("rows"))
    return rows.select(
        F.col("ids").alias("doc_id"),
        F.col("p.leaf").alias("leaf"),
        "subroot",
        "root",
        F.col("p.proof").alias("proof_sha256"),
        F.col("p.folded").alias("folded_root"),
        (F.col("p.folded") == F.col("root")).alias("verified"),
    )


def _levels(name: str, count: int) -> str:
    """CTEs name0 to name{count} of a tree's levels and {name}_proof of its leaves' siblings; name0(grp, pos, d, n) is there."""
    rows, proofs = [], []
    for k in range(count):
        many = f"SELECT grp, pos // {FANOUT} AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d, ANY_VALUE((n + {FANOUT - 1}) // {FANOUT}) AS n"
        one = f"SELECT grp, pos, d, n FROM {name}{k} WHERE n = 1"
        rows.append(f"{name}{k + 1} AS ({many} FROM {name}{k} WHERE n > 1 GROUP BY grp, pos // {FANOUT} UNION ALL {one})")
        wide = FANOUT**k
        near = lambda which: f"""(SELECT l.grp, l.pos, string_agg(s.d, '' ORDER BY s.pos) AS s FROM {name}0 l JOIN {name}{k} s
            ON s.grp = l.grp AND s.n > 1 AND s.pos // {FANOUT} = l.pos // {wide * FANOUT} AND s.pos {which} l.pos // {wide} GROUP BY l.grp, l.pos)"""  # noqa: B023, E731
        proofs.append((near("<>"), near("<")))
    joins = "".join(f" LEFT JOIN {b} s{k} USING (grp, pos)" for k, (b, _) in enumerate(proofs))
    joins += "".join(f" LEFT JOIN {b} b{k} USING (grp, pos)" for k, (_, b) in enumerate(proofs))
    said = " || ".join(f"coalesce(s{k}.s, '')" for k in range(count))
    own = ", ".join(f"coalesce(s{k}.s, '') AS s{k}, length(coalesce(b{k}.s, '')) AS b{k}" for k in range(count))
    rows.append(f"{name}_proof AS (SELECT grp, pos, n, {said} AS proof, {own} FROM {name}0{joins})")
    return ",\n".join(rows)


def oracle(levels: int = 5, above: int = 3) -> str:
    """SQL with the rows of manifest(), for sources of at most 16 ** levels documents and 16 ** above sources."""
    leaf = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    byte = f"list_reduce(range(8), lambda v, k: {step}, xor(r, ascii(c)::BIGINT))"
    ones = "4294967295::BIGINT"
    crc = f"xor(list_reduce(string_split(doc_id::VARCHAR, ''), lambda r, c: {byte}, {ones}), {ones})"
    folded, prefix = "seen", []
    for name, count in (("t", levels), ("u", above)):
        for k in range(count):
            run = f"{name}{k}_n > 1"
            prefix.append(f"CASE WHEN {run} THEN sha256(substr({name}s{k}, 1, {name}b{k}) || {{d}} || substr({name}s{k}, {name}b{k} + 1)) ELSE {{d}} END")
    steps, last = [], "f"
    for i, step in enumerate(prefix):
        steps.append(f"f{i} AS (SELECT * REPLACE ({step.format(d=folded)} AS seen) FROM {last})")
        last = f"f{i}"
    widths = lambda name, count: ", ".join(f"(({name}p.n + {FANOUT**k - 1}) // {FANOUT**k}) AS {name}{k}_n, {name}p.s{k} AS {name}s{k}, {name}p.b{k} AS {name}b{k}" for k in range(count))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text FROM documents),
x AS (SELECT r, doc_id, coalesce('=' || source, '') AS grp, sha256({leaf}) AS d,
      CASE WHEN doc_id IS NOT NULL AND {crc} % {TAMPERED} = 0 THEN sha256({leaf.replace("text", lowered)}) END AS seen FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM x),
t0 AS (SELECT grp, pos, d, n FROM l),
{_levels("t", levels)},
w AS (SELECT grp AS name, d, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t{levels}),
u0 AS (SELECT '' AS grp, pos, d, n FROM w),
{_levels("u", above)},
f AS (SELECT doc_id, l.d AS leaf, w.d AS subroot, top.d AS root, sha256(tp.proof || up.proof) AS proof_sha256, coalesce(seen, l.d) AS seen,
      {widths("t", levels)}, {widths("u", above)}
      FROM l JOIN t_proof tp USING (grp, pos) JOIN w ON w.name = l.grp JOIN u_proof up ON up.pos = w.pos, u{above} top),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, seen AS folded_root, seen = root AS verified FROM {last}
"""


ORACLE = oracle()
