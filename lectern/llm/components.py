"""Connected components of an edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import discard, materialize


def _simple(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, as u < v."""
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _follow(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """Replace a column's node by what it hooks to, if it hooks."""
    h = hooks.select(F.col("v").alias("_from"), F.col("to").alias("_to"))
    return (
        df.join(h, F.col(column) == F.col("_from"), "left")
        .withColumn(column, F.coalesce("_to", column))
        .drop("_from", "_to")
    )


def contract(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, component) as connected_components gives them, and the rounds that it took."""
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    left = materialize(_simple(edges.dropna(subset=["u", "v"])))
    labels = left.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
    rounds = 0
    while not left.isEmpty():
        ends = F.when(place("u") < place("v"), F.struct(F.col("v").alias("v"), place("u").alias("p")))
        ends = left.select(ends.otherwise(F.struct(F.col("u").alias("v"), place("v").alias("p"))).alias("e"))
        once = materialize(ends.groupBy("e.v").agg(F.min("e.p").alias("p")).select("v", F.col("p.n").alias("to")))
        twice = materialize(_follow(once, "to", once))
        hooks = materialize(_follow(twice, "to", twice))
        old, known = left, labels
        labels = materialize(_follow(known, "label", hooks))
        left = materialize(_simple(_follow(_follow(left, "u", hooks), "v", hooks)))
        discard(once, twice, hooks, old, *([known] if rounds else []))
        rounds += 1
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component"), rounds


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest node reachable.

    Every round hooks each node to that of its neighbours whose hash is least, if less than its own, follows the
    hooks four deep and rewrites the edges between what is left, until none is. Hashes have no order along a path, so
    a round leaves at most about a third of it, however nodes are numbered, and a star takes two rounds. All steps are
    joins and minima with map-side parts; nothing is gathered by component. Tables of past rounds are deleted. Loops
    and repeated edges do no harm; an edge with a null end is dropped; without edges the result is empty.
    """
    return contract(edges)[0]
