"""Keys that begin other keys, found along their order: whatever they have in common, no two are compared as a pair."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.scans import in_ranges
from lectern.session import ship

FOUND = "key string, above long, best long"


class Open:
    """A key that those after it may begin with. own: its rank, if it can be found; best: the least rank found behind it."""

    __slots__ = ("key", "own", "wanted", "above", "best", "carried")

    def __init__(self, key: str, own: int | None, wanted: bool, above: int | None = None, carried: bool = False):
        self.key, self.own, self.wanted, self.above, self.best, self.carried = key, own, wanted, above, None, carried


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Walk:
    """A walk along sorted keys that holds the keys which the present one begins with, as many as it has characters at most."""

    def __init__(self, start: list[tuple]):
        self.open: list[Open] = []
        self.out: list[tuple] = []
        for key, own, wanted in start:
            self.open.append(Open(key, own, wanted, self._above(), True))

    def _above(self) -> int | None:
        return None if not self.open else self.open[-1].above if self.open[-1].own is None else self.open[-1].own

    def _close(self) -> None:
        o = self.open.pop()
        if o.wanted:
            self.out.append((o.key, None if o.carried else o.above, o.best))
        if self.open:
            mine = None if o.carried else o.own
            self.open[-1].best = least(self.open[-1].best, least(mine, o.best))

    def add(self, key: str, own: int | None, wanted: bool) -> None:
        while self.open and not key.startswith(self.open[-1].key):
            self._close()
        self.open.append(Open(key, own, wanted, self._above()))

    def end(self) -> None:
        while self.open:
            self._close()

    def left(self) -> list[tuple]:
        return [(o.key, o.own, o.wanted) for o in self.open]


def _rows(batch: pd.DataFrame) -> Iterator[tuple]:
    for part, key, own, wanted in zip(batch["_part"], batch["key"], batch["own"], batch["wanted"], strict=True):
        yield part, key, None if pd.isna(own) else int(own), bool(wanted)


def nested(keys: DataFrame, parts: int | None = None) -> DataFrame:
    """(key, above, best) of the wanted ones of keys(key, own, wanted), which are distinct.

    above: the rank `own` of the longest other key that a key begins with; best: the least rank of all keys that begin
    with it; null where there is none, and keys with a null rank are not found. Keys are sorted in range partitions. A
    first walk says which keys are open at the end of each, a small table hands them on, and a second one finds.
    """
    ship(keys.sparkSession)
    ranged = in_ranges(keys.select("key", F.col("own").cast("long").alias("own"), "wanted"), [], ["key"], parts)
    walked = lambda rows: rows.repartition("_part").sortWithinPartitions("_part", "key")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, walk, last = None, Walk([]), ""
        out = []
        for batch in batches:
            for part, key, own, wanted in _rows(batch):
                if part != now:
                    out += [(now, last, json.dumps(walk.left()))] if now is not None else []
                    now, walk = part, Walk([])
                walk.add(key, own, wanted)
                walk.out.clear()
                last = key
        out += [(now, last, json.dumps(walk.left()))] if now is not None else []
        yield pd.DataFrame(out, columns=["_part", "last", "left"])

    def starts(parts: pd.DataFrame) -> pd.DataFrame:
        held, out = [], []
        for part, last, left in parts.sort_values("_part").itertuples(index=False):
            out.append((part, json.dumps(held)))
            held = [o for o in held if last.startswith(o[0])] + json.loads(left)
        return pd.DataFrame(out, columns=["_part", "start"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, walk = None, Walk([])
        for batch in batches:
            for (part, key, own, wanted), start in zip(_rows(batch), batch["start"], strict=True):
                if part != now:
                    walk.end()
                    out, now, walk = walk.out, part, Walk(json.loads(start))
                    walk.out = out
                walk.add(key, own, wanted)
            yield _frame(walk)
        walk.end()
        yield _frame(walk)

    left = walked(ranged).mapInPandas(ends, "_part int, last string, left string")
    begun = left.groupBy(F.lit(0).alias("all")).applyInPandas(starts, "_part int, start string")  # a row for each part
    found = walked(ranged.join(begun, "_part")).mapInPandas(find, FOUND)
    return found.groupBy("key").agg(F.max("above").alias("above"), F.min("best").alias("best"))


def _frame(walk: Walk) -> pd.DataFrame:
    out = pd.DataFrame(walk.out, columns=["key", "above", "best"]).astype({"above": "Int64", "best": "Int64"})
    walk.out = []
    return out
