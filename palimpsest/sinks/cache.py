"""A Parquet cache of files and edges, valid while the archives it was made from stay as they were."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Raise when a parser changes what it finds.
PARSER_VERSION = 2


def save(folder: str, files: DataFrame, edges: DataFrame, marks: DataFrame) -> None:
    """``marks``: path, size, mtime of each archive."""
    files.write.mode("overwrite").parquet(f"{folder}/files")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    marks.write.mode("overwrite").parquet(f"{folder}/marks")
    spark = files.sparkSession
    spark.createDataFrame([(json.dumps({"parser_version": PARSER_VERSION}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def is_valid(spark: SparkSession, folder: str, marks: DataFrame, strategy: str = "mtime") -> bool:
    """Whether the archives are the same, by path, size and time, or by path and ``hash`` of their bytes; and the parsers too."""
    columns = ["path", "sha256"] if strategy == "hash" else ["path", "size", "mtime"]
    try:
        meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
        old = spark.read.parquet(f"{folder}/marks").select(columns)
    except Exception:  # noqa: BLE001 - no cache, or half of one
        return False
    new = marks.select(columns)
    return meta.get("parser_version") == PARSER_VERSION and old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/files"), spark.read.parquet(f"{folder}/edges")
