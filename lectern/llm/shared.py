"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.session import ship

#: Rows and bytes in one Arrow batch to a Python worker, at most; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session takes a folder of its own; on a cluster that is an error, as executors would
    write where no other machine can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    All tables of one application lie in one folder, which goes when the application is done with; what is in the way
    before that is for discard().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small in rows and bytes, and send the workers this package.

    Both are settings of the session, read when a plan runs; they are only ever lowered.
    """
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        now = int(now.rstrip("b")) if now.rstrip("b").lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def returning_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, for mapInArrow, with its worker's unused Arrow memory given back when a task ends.

    Workers live on from stage to stage, and what one stage took at its peak would count in all that follow.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidy


def tokenizer_file(name: str, path: str | None) -> str:
    """path, or where this machine keeps the public tokenizer of that name."""
    return path or public_tokenizers.path(name)
