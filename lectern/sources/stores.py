"""Small stores that an application keeps as JSON files: lists of records, and maps from a path to a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _texts(spark, path: str) -> DataFrame:
    """Each file under a path as one text; none where there is no file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path, wholetext=True)


def read_records(spark, path: str, kinds: str) -> DataFrame:
    """Records (kinds: DDL) of JSON files that hold a list each; a missing or malformed file has none."""
    return _texts(spark, path).select(F.explode(F.from_json("value", f"array<struct<{kinds}>>")).alias("r")).select("r.*")


def read_map(spark, path: str, kind: str = "double") -> DataFrame:
    """(path, value) of JSON files that hold an object each; a missing or malformed file has none."""
    return _texts(spark, path).select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("path", "value"))


def write_records(rows: DataFrame, path: str) -> None:
    """Records as lines of JSON, one file for each part; the committer puts them in place as a whole."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_written(spark, path: str, kinds: str) -> DataFrame:
    """What write_records wrote; lines that are no record of these kinds give nulls."""
    return spark.read.schema(kinds).json(path)
