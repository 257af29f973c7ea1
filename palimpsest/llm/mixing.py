"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``rate`` times in the mix, rate being what the source must give divided by what it
has. Prefix sums of the expected copies run through a source in random order; after one random offset per source, a
document is emitted once for every integer its stretch crosses: floor(rate) or ceil(rate) times. The sums are whole numbers
of 2**-24 copies, so they neither drift nor depend on the order of addition. A source is cut into hashed buckets;
bucket totals give each bucket its start, and no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: Fractions of a copy are multiples of 2**-BITS.
BITS = 24
#: Rows a bucket holds on average.
BUCKET_ROWS = 50_000


def plan_rates(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, weight, cap, have, n_docs, goal, rate) for every source with a positive weight and cap and some size.

    ``sizes``: source, size of each document. ``targets``: source, target_weight, max_repeats; repeated sources add
    their weights and take the larger cap. Weights are taken relative to those of the sources there are. Without
    ``total`` the mix is as large as it can be with every share exact; with it, a source's rate stops at its cap, and the
    shares reached differ from those wanted.
    """
    have = sizes.filter("source is not null and size > 0").groupBy("source").agg(F.sum("size").alias("have"), F.count(F.lit(1)).alias("n_docs"))
    want = targets.filter("source is not null").groupBy("source").agg(F.sum("target_weight").alias("weight"), F.max("max_repeats").alias("cap"))
    both = have.join(want.filter("weight > 0 and cap > 0"), "source")
    row = both.agg(F.sum("weight").alias("w"), F.min(F.col("have") * F.col("cap") / F.col("weight")).alias("unit")).first()
    if row.w is None:
        return both.withColumn("goal", F.lit(0.0)).withColumn("rate", F.lit(0.0))
    unit = row.unit if total is None else total / row.w
    goal = F.col("weight") * F.lit(float(unit))
    return both.withColumn("goal", goal).withColumn("rate", F.least(F.col("goal") / F.col("have"), F.col("cap").cast("double")))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, shares) of a mix of ``documents``: key, source, size.

    rows: key, source, size, copy_no, one row per use, copy_no from 1. shares: source, target_share, aimed_share,
    actual_share, have, used, max_repeats, most_repeats, for every source of either table. target_share is relative to all
    targets, and null for a source without one, which is not used; aimed_share is relative to the sources there are, and
    null for those that cannot be used. aimed_share is what the mix expects to reach: actual_share differs from it by
    what single documents make up, and by caps where a ``total`` is asked for. Null sources, null sizes and sizes below 1 are not used. Keys must be unique and not
    null. Empty inputs give empty rows. Equal seeds give equal mixes.
    """
    docs = documents.select("key", "source", F.col("size").cast("long").alias("size"))
    rates = materialize(plan_rates(docs, targets, total), "rates")
    largest = rates.agg(F.max("n_docs")).first()[0] or 1
    buckets = max(1, -(-largest // BUCKET_ROWS))
    placed = (
        docs.filter("source is not null and size > 0")
        .join(rates.select("source", F.round(F.col("rate") * (1 << BITS)).cast("long").alias("e")), "source")
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(buckets)))
    )
    sums = placed.groupBy("source", "bucket").agg(F.sum("e").alias("e"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << BITS))
    starts = sums.select("source", "bucket", (F.coalesce(F.sum("e").over(before), F.lit(0)) + offset).alias("start"))
    # Within a bucket, which is a random part of its source, documents go by size: neighbours are alike, so that
    # taking every k-th evens out the sizes drawn.
    inside = Window.partitionBy("source", "bucket").orderBy("size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("upto", F.sum("e").over(inside)).join(starts, ["source", "bucket"])
    whole = lambda c: F.call_function("shiftright", c, F.lit(BITS))
    copies = (whole(F.col("start") + F.col("upto")) - whole(F.col("start") + F.col("upto") - F.col("e"))).cast("int")
    used = run.select("key", "source", "size", copies.alias("copies")).filter("copies > 0")
    rows = used.select("key", "source", "size", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))
    return rows, _shares(used, rates, docs, targets)


def _shares(used: DataFrame, rates: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    got = used.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.max("copies").alias("most_repeats"))
    have = docs.filter("source is not null").groupBy("source").agg(F.sum(F.coalesce("size", F.lit(0))).alias("have"))
    want = targets.filter("source is not null").groupBy("source").agg(F.sum("target_weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    aims = rates.select("source", F.col("weight").alias("aim"))
    all_ = have.join(want, "source", "full").join(got, "source", "left").join(aims, "source", "left")
    over = Window.partitionBy(F.lit(0))  # one row per source
    return all_.select(
        "source",
        (F.col("weight") / F.sum("weight").over(over)).alias("target_share"),
        (F.col("aim") / F.sum("aim").over(over)).alias("aimed_share"),
        (F.coalesce("used", F.lit(0)) / F.sum("used").over(over)).alias("actual_share"),
        F.coalesce("have", F.lit(0)).alias("have"),
        F.coalesce("used", F.lit(0)).alias("used"),
        "max_repeats",
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
