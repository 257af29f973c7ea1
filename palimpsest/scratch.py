"""Intermediate tables in the shared checkpoint folder.

Iterative operators cut their lineage by writing a Parquet table below the folder named by ``spark.checkpoint.dir`` and
reading it back. Such a table survives the loss of any executor, is written once (an eager ``checkpoint()`` computes its
last stage twice), and keeps column pruning and size estimates for the stages that follow.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session's cluster. Only a local session without the setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return _own[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back, with its lineage cut."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextmanager
def scope() -> Iterator[None]:
    """Deletes, at its end, all tables and folders that were made within: whatever is to be kept is read or written before."""
    before = len(_made)
    try:
        yield
    finally:
        for spark, path in _made[before:]:
            _delete(spark, path)
        del _made[before:]


def folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder for files that are no tables; it goes when the process ends."""
    path = f"{scratch_root(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one file, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()


def discard(df: DataFrame | None) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more (a superseded round of an iteration)."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:
            pass
    for path in _own.values():
        import shutil

        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
