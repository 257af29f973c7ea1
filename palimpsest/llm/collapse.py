"""Duplicates hidden by formatting: range partition, external sort, scan of adjacent runs.

Records are reduced to canonical keys. Rows are range-partitioned and sorted (spilling to disk as needed) by a hash of the
key, the key itself and the id, so that equal keys are neighbours and the smallest id leads. A scan then compares full
neighbouring keys. The id belongs to the partitioning, so a group that holds a third of all rows is cut over many
partitions; what a partition cannot know about its first and last run is settled by one small table with one row per
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pathkey import folded
from ..scratch import materialize


def canonical(*parts: Column) -> Column:
    """One key from several parts, each led by its length, so that no two lists of parts meet. Null equals null only."""
    cast = [p.cast("string") for p in parts]
    return F.concat(*[F.coalesce(F.concat(F.char_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in cast])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted (pid, key, id): one row (pid, key, id, first, n, edge) for each row but a run's first, and for each run.

    ``edge`` is 0 for a copy, 2 for the summary row of a run: id = first, n = its rows; summaries carry the key only
    where the run touches an end of the partition.
    """
    names = ["pid", "key", "id", "first", "n", "edge"]
    run_key, run_first, run_n, runs, pid = None, None, 0, 0, None

    def copies(ids: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([pid] * n, pa.int32()), pa.nulls(n, pa.string()), pa.array(ids), pa.array(firsts), pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, np.int32))], names
        )

    def summaries(rows: list[tuple]) -> pa.RecordBatch:
        k, f, n = zip(*rows)
        m = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([pid] * m, pa.int32()), pa.array(k, pa.string()), pa.array(f, pa.int64()), pa.array(f, pa.int64()), pa.array(n, pa.int64()), pa.array([2] * m, pa.int32())], names)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        pid = b.column(0)[0].as_py()
        keys, ids = b.column(1), b.column(2).to_numpy()
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = run_key is None or keys[0].as_py() != run_key
        starts = np.flatnonzero(new)
        run_of = np.cumsum(new) - 1  # -1: goes on with the open run
        firsts = np.where(run_of >= 0, ids[starts[np.maximum(run_of, 0)]] if len(starts) else 0, run_first if run_first is not None else 0)
        copy = ~new
        if copy.any():
            yield copies(ids[copy], firsts[copy])
        done = []
        counts = np.diff(np.append(starts, n))
        head = int(starts[0]) if len(starts) else n
        run_n += head
        if len(starts):
            if run_key is not None:
                done.append((run_key if runs == 1 else None, run_first, run_n))
            for i in range(len(starts) - 1):
                if counts[i] > 1 or (runs == 0 and i == 0 and run_key is None):
                    done.append((keys[int(starts[i])].as_py() if runs + i == 0 else None, int(ids[starts[i]]), int(counts[i])))
            runs += len(starts)
            run_key, run_first, run_n = keys[int(starts[-1])].as_py(), int(ids[starts[-1]]), int(counts[-1])
        if done:
            yield summaries(done)
    if run_key is not None:
        yield summaries([(run_key, run_first, run_n)])


def sorted_runs(records: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scanned rows and the partition-end fixes for ``records`` (key STRING, id BIGINT unique); see ``collapse``."""
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    h = F.xxhash64("key").alias("h")
    # Range partitioning reads its input twice, once for a sample; keys may be costly to compute, so they are written down.
    records = materialize(records.filter("key is not null").select("key", "id"), "records")
    placed = records.select(h, "key", "id").repartitionByRange(n, "h", "key", "id").sortWithinPartitions("h", "key", "id")
    rows = placed.select(F.spark_partition_id().alias("pid"), "key", "id").mapInArrow(_scan, "pid int, key string, id long, first long, n long, edge int")
    rows = materialize(rows, "runs")
    # One or two rows per partition: its first run and, if another, its last. A run that goes on from the partition
    # before has that partition's last key; its true first is the first of the earliest partition of the chain.
    ends = rows.filter("edge = 2 and key is not null").select("pid", F.xxhash64("key").alias("h"), "key", "first", "n")
    fixes = ends.select(F.col("first").alias("found"), F.min("first").over(Window.partitionBy("h", "key")).alias("true_first"))
    return rows, fixes


def collapse(records: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Collapse records with equal keys: (copies, groups).

    ``records``: key STRING, id BIGINT, unique. copies: (first_id, copy_id) for each record that is not the first of its
    group, first_id being the group's smallest id. groups: (first_id, n_copies) for each group of two or more.
    Null keys are dropped (fold null parts with ``canonical``); the empty key is a key. An empty table gives empty
    results. Other columns are not read. The count is exact for a group of any size.
    """
    rows, fixes = sorted_runs(records, partitions)
    moved = fixes.filter("found <> true_first").select(F.col("found").alias("first"), "true_first")
    # Runs cut by a partition end: at most one for each end. Their leading rows are copies too.
    heads = moved.select(F.col("true_first").alias("first_id"), F.col("first").alias("copy_id"))
    inner = rows.filter("edge < 2").select("first", F.col("id").alias("copy_id")).join(F.broadcast(moved), "first", "left")
    copies = inner.select(F.coalesce("true_first", "first").alias("first_id"), "copy_id").unionByName(heads)
    counted = rows.filter("edge = 2").select("first", "n").join(F.broadcast(moved), "first", "left")
    groups = counted.groupBy(F.coalesce("true_first", "first").alias("first_id")).agg(F.sum("n").alias("n_copies")).filter("n_copies > 1")
    return copies, groups


#: Names of the four fields of a catalogue line.
LINE_FIELDS = ("virtual_path", "source_name", "priority", "file_hash")
#: A field's name with what must stand around it, in any notation.
FIELD_HEAD = r"""(?:^|[\s{{\[("';|,])(?:{})(?:"?\s*[:=]|"\s)"""


def line_fields(raw: Column) -> dict[str, Column]:
    """The folded value of each field of a raw catalogue line, in any notation and order.

    A field's value is what lies between its name and the next field's name; folding drops quotes, brackets, separators
    and white space around it. In quoted notations backslash escapes are resolved first. An absent field is null.
    """
    quoted = raw.rlike(r'(?i)"(?:virtual_path|source_name|priority|file_hash)"')
    plain = F.regexp_replace(raw, r"\\\\", "/")
    plain = F.regexp_replace(plain, r"\\[ntrbf\"/]", " ")
    text = F.when(quoted, plain).otherwise(raw)
    out = {}
    for f in LINE_FIELDS:
        head = FIELD_HEAD.format(f)
        value = F.regexp_extract(text, rf"(?is){head}(.*?)(?:{FIELD_HEAD.format('|'.join(LINE_FIELDS))}|$)", 1)
        out[f] = F.when(text.rlike(f"(?i){head}"), folded(value))
    return out
