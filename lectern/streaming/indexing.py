"""Continuous indexing: documents that arrive are put in the place of those of the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.search import Index, build_index


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write postings of a stream of rows(kind, book_id, key, content, ...), a partition for each kind and book.

    A micro-batch replaces the partitions that it has rows of, as re-indexing a book does; so a book has to come in one
    micro-batch. Where it may not, use index_runs.
    """

    def replace(batch: DataFrame, _: int) -> None:
        index = build_index(batch)
        rows = index.postings.join(index.docs.select("key", "kind", "book_id"), "key")
        out = rows.write.mode("overwrite").partitionBy("kind", "book_id")
        out.option("partitionOverwriteMode", "dynamic").parquet(path)

    return docs.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_runs(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write an index of a stream of rows(kind, book_id, key, content, version, ...) that read_runs gives back.

    version is a number that grows each time a book is read again, such as the time of its file: rows of one version may
    come in any number of micro-batches. A batch is a partition of its own, so one that is done again replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        index = build_index(batch.dropDuplicates(["key", "version"]), "key", "version")
        for name, rows in (("docs", index.docs), ("postings", index.postings)):
            out = rows.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch")
            out.option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_runs(spark: SparkSession, path: str) -> Index:
    """The index that index_runs wrote: of a book its pages of the newest version, of all else the newest row of each key.

    Rows of a key and version that came twice count once, as they came last.
    """
    docs, postings = (spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings"))
    again = Window.partitionBy("key").orderBy(F.desc("version"), F.desc("batch"))
    newest = docs.withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n")
    books = docs.where("kind = 'page'").groupBy(F.col("book_id").alias("_book")).agg(F.max("version").alias("_newest"))
    page = F.col("kind") == "page"
    kept = newest.join(books, F.col("book_id").eqNullSafe(F.col("_book")) & page, "left")
    kept = kept.where(~page | (F.col("version") == F.col("_newest"))).drop("_book", "_newest")
    found = postings.join(kept.select("key", "version", "batch"), ["key", "version", "batch"], "left_semi")
    return Index(kept.drop("version", "batch"), found.drop("version", "batch"))
