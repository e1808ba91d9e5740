"""What a session needs before it runs this package's Python functions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    home = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent))
    context.addPyFile(archive)
    _sent.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str | None:
    """A folder that driver and executors share: spark.checkpoint.dir, or a local session's own; None if there is none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder or not spark.sparkContext.master.startswith("local"):
        return folder and folder.rstrip("/")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, for much work on each row of a small file, which few tasks would read."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and what tasks numbered stays so."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder}/lectern-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
