"""A written index that takes changes and removals: runs beside each other, made visible by a manifest, merged from time to time."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.catalog import best_per_key
from lectern.operators.search import Index, build_index
from lectern.sources.providers import opened

#: Kinds of rows that go with their book.
WITH_BOOK = ("page", "quote")


def manifest(path: str) -> list[dict]:
    """The runs that are visible, oldest first: name, and whether it was merged from all before it. None where there is none yet."""
    where, folder = opened(path)
    files = where.get_file_info(fs.FileSelector(f"{folder}/manifest", allow_not_found=True))
    last = max((f for f in files if f.base_name.endswith(".json")), key=lambda f: f.base_name, default=None)
    if last is None:
        return []
    with where.open_input_stream(last.path) as file:
        return json.loads(file.read())


def _show(path: str, runs: list[dict]) -> None:
    """Make runs visible, documents and postings together: one file, moved into place when it is whole."""
    where, folder = opened(path)
    where.create_dir(f"{folder}/manifest", recursive=True)
    n = len([f for f in where.get_file_info(fs.FileSelector(f"{folder}/manifest")) if f.base_name.endswith(".json")])
    with where.open_output_stream(f"{folder}/manifest/.next") as file:
        file.write(json.dumps(runs).encode())
    where.move(f"{folder}/manifest/.next", f"{folder}/manifest/{n:012d}.json")


def _write(index: Index, path: str, name: str) -> None:
    """A run's documents sorted by key and its postings by term; one that is written again replaces itself."""
    for part, rows, by in (("docs", index.docs, ["key"]), ("postings", index.postings, ["term", "key"])):
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/runs/{name}/{part}")


def put_changes(changes: DataFrame, path: str, name: str) -> None:
    """Add a run of changes(key, kind, book_id, content, version, removed, ...) under a name.

    removed: the row of the key goes, or, without a key, all pages and quotes of the book that are of a lower version.
    A larger version wins over a lower one, whatever the order of runs; of equal ones the later run does. A run that is
    put again takes the place of itself.
    """
    whole = changes.where("key IS NULL")
    rows = best_per_key(changes.where("key IS NOT NULL"), ["key"], F.struct("version", F.col("removed").cast("int"), F.hash("content"))).unionByName(whole)
    index = build_index(rows.withColumn("content", F.when(~F.col("removed"), F.col("content"))))
    _write(Index(index.docs, index.postings.where("key IS NOT NULL")), path, name)
    known = manifest(path)
    if name not in [r["name"] for r in known]:
        _show(path, [*known, {"name": name, "merged": False}])


def changes_stream(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Put a stream of changes, a run for each micro-batch."""
    put = lambda batch, number: put_changes(batch, path, f"batch-{number:012d}")
    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _live(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, postings) of the visible runs, docs with the run they are of."""
    runs = manifest(path)
    read = lambda part, i, r: spark.read.parquet(f"{path}/runs/{r['name']}/{part}").withColumn("run", F.lit(i))
    if not runs:
        raise FileNotFoundError(f"no index in {path}")
    docs, postings = read("docs", 0, runs[0]), read("postings", 0, runs[0])
    for i, r in enumerate(runs[1:], 1):
        docs = docs.unionByName(read("docs", i, r), allowMissingColumns=True)
        postings = postings.unionByName(read("postings", i, r))
    if len(runs) == 1 and runs[0]["merged"]:
        return docs, postings  # nothing in it is removed or old
    gone = docs.where("key IS NULL AND removed").groupBy(F.col("book_id").alias("_book")).agg(F.max("version").alias("_before"))
    last = best_per_key(docs.where("key IS NOT NULL"), ["key"], F.struct("version", "run")).where("NOT removed")
    lost = F.col("kind").isin(*WITH_BOOK) & (F.col("version") < F.col("_before"))
    kept = last.join(gone, F.col("book_id") == F.col("_book"), "left").where(~F.coalesce(lost, F.lit(False))).drop("_book", "_before")
    return kept, postings.join(kept.select("key", "run"), ["key", "run"], "left_semi")


def read_changes(spark: SparkSession, path: str) -> Index:
    """The index as the visible runs make it: what a search takes, as it was when this was called."""
    docs, postings = _live(spark, path)
    return Index(docs.drop("run", "removed", "version"), postings.drop("run"))


def merged(spark: SparkSession, path: str) -> str:
    """Merge all visible runs into one without old and removed rows, and make that visible in their place; its name.

    Both of its tables are sorted by range, as runs are. Versions stay with the documents, so that late changes of lower
    versions still lose; removals that were carried out are forgotten, and with them that something was there. Files of
    the merged runs stay, for those who still read them, until they are cleared away. There must be one writer.
    """
    name = f"merged-{len(manifest(path)):06d}-{manifest(path)[-1]['name']}"
    docs, postings = _live(spark, path)
    _write(Index(docs.drop("run"), postings.drop("run")), path, name)
    _show(path, [{"name": name, "merged": True}])
    return name


def cleared(path: str) -> list[str]:
    """Delete the files of runs that are no longer visible; their names."""
    where, folder = opened(path)
    seen = {r["name"] for r in manifest(path)}
    old = [f for f in where.get_file_info(fs.FileSelector(f"{folder}/runs", allow_not_found=True)) if f.base_name not in seen]
    for f in old:
        where.delete_dir(f.path)
    return sorted(f.base_name for f in old)
