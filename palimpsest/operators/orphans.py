"""References to records that do not exist, by bitmaps over key ranges and periods.

1. The referenced keys are dictionary-encoded as integers; a key's row in the dictionary also holds the months in which it
   is referenced, as bits.
2. References become bitmaps: for each range of 64 keys and each month one 64-bit word, stored only where it is not zero.
   Parents become words of the same form for the months through which they are live from end to end. A parent's months
   are kept as (from, to) runs until keys are combined into words, so expansion to months happens per word, not per row.
3. ``reference AND NOT parent`` is one join of words. Surviving bits are decoded to (key, month) pairs.
4. Only references of surviving pairs are checked to the microsecond: a parent may appear or vanish within a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .skew import spread_join

#: Months in one 64-bit mask of a dictionary row; the sign bit stays free.
MASK = 63
FAR = "9999-12-31 23:59:59.999999"


def month_index(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t) - 1


def _far() -> Column:
    return F.lit(FAR).cast("timestamp_ntz")


def orphan_references(refs: DataFrame, parents: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """(tab, ref_id, period, state) of every reference that has no parent live at its time.

    ``refs``: tab, ref_id, key, t. ``parents``: key, t_from, t_to (null: still there). ``always``: key of parents that
    were there all along. ``state``: ``missing`` (no parent at all), ``later`` (none from t or before), ``removed``.

    References with a null key are no references and give no row; a null t is judged as if after all other times and
    has a null period. A parent with a null key is none; one with a null t_from counts as appearing after everything.
    Repeated references come out each, repeated parents count once. Empty refs give an empty result; with empty
    parents all is missing. Further columns of the inputs are not read.
    """
    spark = refs.sparkSession
    # Keys may be costly to compute, and both sides are read several times: they are written down once.
    refs = refs.select("tab", "ref_id", "key", F.coalesce("t", _far()).alias("t"), F.col("t").isNotNull().alias("timed")).filter("key is not null")
    parents = parents.select("key", F.coalesce("t_from", _far()).alias("t_from"), F.coalesce("t_to", _far()).alias("t_to")).filter("key is not null")
    refs, parents = materialize(refs, "refs"), materialize(parents, "parents")
    lo, hi = refs.filter("timed").agg(F.min(month_index(F.col("t"))), F.max(month_index(F.col("t")))).first()
    lo, hi = (lo, hi + 1) if lo is not None else (0, 0)  # hi is the month of untimed references
    refs = refs.withColumn("p", F.when(F.col("timed"), month_index(F.col("t"))).otherwise(F.lit(hi)) - lo)
    masks = (hi - lo) // MASK + 1

    def mask(j: int) -> Column:
        at = F.col("p") - j * MASK
        return F.bit_or(F.when((at >= 0) & (at < MASK), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))).alias(f"m{j}")

    names = [f"m{j}" for j in range(masks)]
    months = F.array_compact(F.array(*[F.when(_bit(F.col(names[p // MASK]), F.lit(p % MASK)), F.lit(p)) for p in range(hi - lo + 1)]))
    # 1. The dictionary. Ids are given once and written down; ids of one write task are consecutive.
    words = materialize(refs.groupBy("key").agg(*map(mask, range(masks)), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    word, bit = F.call_function("shiftright", F.col("id"), F.lit(6)).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 64).cast("int"))

    # 2. Bitmaps.
    of_refs = words.select(word, bit.alias("b"), F.explode(months).alias("p")).groupBy("w", "p").agg(F.bit_or("b").alias("b"))
    begins = month_index(F.col("t_from")) - lo + F.when(F.col("t_from") > F.date_trunc("month", "t_from").cast("timestamp_ntz"), 1).otherwise(0)
    runs = parents.select(
        "key",
        F.greatest(begins, F.lit(0)).alias("p0"),
        F.least(F.when(F.col("t_to") >= _far(), F.lit(hi - lo)).otherwise(month_index(F.col("t_to")) - lo - 1), F.lit(hi - lo)).alias("p1"),
    )
    if always is not None:
        runs = runs.unionByName(always.select("key", F.lit(0).alias("p0"), F.lit(hi - lo).alias("p1")).filter("key is not null"))
    runs = runs.filter("p0 <= p1").groupBy("key", "p0").agg(F.max("p1").alias("p1"))
    of_parents = (
        runs.join(words.select("key", "id"), "key")
        .groupBy(word, "p0", "p1").agg(F.bit_or(bit).alias("b"))
        .select("w", "b", F.explode(F.sequence("p0", "p1")).alias("p"))
        .groupBy("w", "p").agg(F.bit_or("b").alias("pb"))
    )

    # 3. AND NOT, and back to keys.
    left = of_refs.join(of_parents, ["w", "p"], "left").select("w", "p", F.col("b").bitwiseAND(F.bitwise_not(F.coalesce("pb", F.lit(0).cast("long")))).alias("b")).filter("b <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: _bit(F.col("b"), i))
    decoded = left.select("p", F.explode(F.transform(bits, lambda i: F.col("w") * 64 + i)).alias("id"))
    suspects = decoded.groupBy("id").agg(*map(mask, range(masks))).join(words.select("key", "id", "n"), "id").select("key", "n", *names)

    # 4. The exact check of the suspects.
    lives = parents.join(suspects.select("key"), "key", "left_semi")
    first = lives.groupBy("key").agg(F.min("t_from").alias("first_at"))
    suspects = materialize(suspects.join(first, "key", "left"), "suspects")
    held = F.array(*map(F.col, names))
    # A key may hold a third of all references: its rows are spread, and its suspect copied to each of their places.
    asked = spread_join(refs, suspects.drop("n"), "key", suspects.select(F.col("key").alias("k"), "n"))
    asked = asked.filter(_bit(held[F.floor(F.col("p") / MASK).cast("int")], (F.col("p") % MASK).cast("int")))
    asked = materialize(asked.select("tab", "ref_id", "key", "t", "timed", "first_at"), "asked")
    period = F.when(F.col("timed"), F.date_format("t", "yyyy-MM")).alias("period")
    known = asked.filter(F.col("first_at").isNull() | (F.col("t") < F.col("first_at")))
    known = known.select("tab", "ref_id", period, F.when(F.col("first_at").isNull(), "missing").otherwise("later").alias("state"))

    open_ = asked.filter("first_at <= t")
    dead = _dead_at(open_.withColumn("kind", F.lit(2)), lives)
    return known.unionByName(dead.select("tab", "ref_id", period, F.lit("removed").alias("state")))


def _bit(mask: Column, i: Column) -> Column:
    return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1


def _dead_at(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """Refs at whose time no life of their key holds: the latest end among lives begun by then is not after t.

    Rows are range-partitioned by key and time, so that a key's rows, however many and however close in time, are cut
    over many partitions. The running maximum is taken within a partition's part of a key; what went before it in other
    partitions comes in as one row for each part, of which a key has no more than there are partitions.
    """
    rows = refs.select("key", "t", "kind", "tab", "ref_id", "timed").unionByName(lives.select("key", F.col("t_from").alias("t"), F.lit(1).alias("kind"), F.col("t_to").alias("m")), allowMissingColumns=True)
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartitionByRange(n, "key", "t", "kind", "tab", "ref_id").withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("key", "part").agg(F.max("m").alias("m")).select("key", "part", F.max("m").over(before).alias("m")).filter("m is not null")
    carried = parts.select("key", "part", F.lit(0).alias("kind"), "m")
    within = Window.partitionBy("key", "part").orderBy(F.col("kind") > 0, "t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionByName(carried, allowMissingColumns=True).withColumn("ends", F.max("m").over(within)).filter("kind = 2 and not coalesce(ends > t, false)")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and state."""
    return orphans.groupBy("tab", "period", "state").agg(F.count(F.lit(1)).alias("n"))
