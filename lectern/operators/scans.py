"""Scans along an order that no single task has to see: ranges are scanned apart, and a small table carries between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize

#: Cells that a pass over the values of a key counts in.
CELLS = 1024


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with _part, written: rows of a key are in one part or in parts that follow each other in the order.

    However many rows a key has, a part holds about as many as any other. Rows of equal keys and order stay together.
    """
    by = [*keys, *order]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return materialize(ranged.withColumn("_part", F.spark_partition_id()))


def joined_by(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of other's row of the same keys; null keys are equal to each other."""
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    other = other.withColumnsRenamed(named)
    same = F.lit(True)
    for k, n in named.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(other, same, "left").drop(*named.values())


def scanned(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    previous: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add columns along each key's rows, whose order has no ties.

    previous: a value of the row before; null for the first. last: a value's last one that isn't null, up to the row.
    total: the sum up to the row. Windows are by key and part, and a table of a row for each of these takes what a part
    leaves to the next ones, so a key of any size is in as many tasks as it has parts. rows that in_ranges has written
    (with the same keys and order) are scanned as they are, and keep _part. An empty table stays empty.
    """
    previous, last, total = previous or {}, last or {}, total or {}
    values = {f"_v{i}": c for i, c in enumerate((*previous.values(), *last.values(), *total.values()))}
    names = dict(zip((*previous, *last, *total), values, strict=True))
    ranged = rows if "_part" in rows.columns else in_ranges(rows, keys, order, parts)
    ranged = ranged.withColumns(values)
    along = Window.partitionBy(*keys, "_part").orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*(F.col(c) for c in order))
    ends, carry, across = [], [], Window.partitionBy(*keys).orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    local, final = {"_first": F.row_number().over(along) == 1}, {}
    for name in previous:
        v = names[name]
        local[name] = F.lag(v).over(along)
        ends.append(F.max_by(F.struct(v), place)[v].alias(v))
        carry.append(F.lag(v).over(across).alias(f"_c{v}"))
        final[name] = F.when(F.col("_first"), F.col(f"_c{v}")).otherwise(F.col(name))
    for name in last:
        v = names[name]
        local[name] = F.last(v, ignorenulls=True).over(upto)
        ends.append(F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(v))
        carry.append(F.last(v, ignorenulls=True).over(before).alias(f"_c{v}"))
        final[name] = F.coalesce(name, f"_c{v}")
    for name in total:
        v = names[name]
        local[name] = F.coalesce(F.sum(v).over(upto), F.lit(0))
        ends.append(F.sum(v).alias(v))
        carry.append(F.sum(v).over(before).alias(f"_c{v}"))
        final[name] = F.col(name) + F.coalesce(f"_c{v}", F.lit(0))
    carried = ranged.groupBy(*keys, "_part").agg(*ends).select(*keys, "_part", *carry)
    kept = [c for c in rows.columns if c not in names]
    found = joined_by(ranged.withColumns(local), carried, [*keys, "_part"])
    return found.select(*kept, *(final[n].alias(n) for n in names))


def medians(rows: DataFrame, keys: list[str], value: Column, name: str = "median") -> DataFrame:
    """(keys, name): the exact median of each key's values, of two in the middle their mean; null values don't count.

    No key's values are gathered: a pass counts them in CELLS cells between the least and the largest one that can still
    be in the middle, and the next looks into the cells of the two middle ranks only. A pass leaves one in CELLS of a
    range, so values of one size take two or three of them, and at least one distinct value less, so it ends. A key
    without values gets none.
    """
    values = materialize(rows.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)"))
    whole = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    ranks = F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("rank")
    wanted = materialize(whole.select(*keys, "low", "high", ranks).withColumn("side", F.monotonically_increasing_id()))
    done = wanted.where("low = high")
    wanted = wanted.where("low < high")
    while not wanted.isEmpty():
        spans = wanted.select(*keys, "low", "high").distinct()
        spans = spans.select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)), "low", "high")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_s{i}"))
        met = values.join(spans, same & F.col("_v").between(F.col("low"), F.col("high")))
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * CELLS)).alias("cell")
        cells = met.groupBy(*keys, "low", "high", cell).agg(F.count("*").alias("held"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        before = Window.partitionBy(*keys, "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
        cells = cells.select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)), F.col("low").alias("_low"), F.col("high").alias("_high"), "before", "held", "least", "most")
        here = same & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
        here = here & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("held"))
        found = wanted.join(cells, here).select(*keys, F.col("least").alias("low"), F.col("most").alias("high"), (F.col("rank") - F.col("before")).alias("rank"), "side")
        found = materialize(found)
        done, wanted = done.unionByName(found.where("low = high")), found.where("low < high")
    return done.groupBy(*keys).agg((F.sum("low") / 2).alias(name))
