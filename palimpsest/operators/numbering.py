"""Numbers without gaps for distinct values, given out in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def numbered(values: DataFrame, name: str = "i") -> DataFrame:
    """``values`` with a column ``name``: INT from 0 on, each once. Only one count per write task comes to the driver."""
    at = F.monotonically_increasing_id()
    kept = values.columns
    placed = materialize(values.withColumn("__part", F.call_function("shiftright", at, F.lit(33)).cast("int")).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    first, start = {}, 0
    for r in sorted(placed.groupBy("__part").agg(F.count(F.lit(1)).alias("m")).collect()):
        first[r[0]] = start
        start += r.m
    starts = F.split(F.lit(",".join(str(first.get(i, 0)) for i in range(max(first, default=0) + 1))), ",").cast("array<bigint>")
    return placed.select(*kept, (F.get(starts, F.col("__part")) + F.col("__at")).cast("int").alias(name))
