"""Overlay resolution: of all records of one path, the enabled one of highest priority is active, the rest redundant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def overlay_key(path: Column) -> Column:
    """Lower case, with forward slashes."""
    return F.lower(F.translate(path, "\\", "/"))


def resolve(nodes: DataFrame, ordinal: str, eligible: Column | None = None) -> DataFrame:
    """``nodes`` with is_winner and is_redundant set.

    Needs virtual_path, priority, and an ``ordinal`` column that gives the order of insertion: the first of equal
    priorities wins; a null priority is lowest. ``eligible`` defaults to is_enabled and not is_dead, nulls counting
    as no. A key without an eligible record has no winner, and its flags stay as they were (false where absent). A null path
    belongs to no key and is left alone. The winner per key is an aggregate combined before the shuffle and joined back,
    so a path with very many records needs no sort of them in one task.
    """
    if eligible is None:
        eligible = F.col("is_enabled") & ~F.coalesce(F.col("is_dead") if "is_dead" in nodes.columns else F.lit(False), F.lit(False))
    ok = F.coalesce(eligible, F.lit(False))
    rows = nodes.withColumn("__key", overlay_key(F.col("virtual_path"))).withColumn("__ok", ok)
    best = rows.filter("__ok and __key is not null").groupBy("__key").agg(F.max(F.struct(F.col("priority"), (-F.col(ordinal)).alias("o"))).alias("__best"))
    best = best.select("__key", (-F.col("__best.o")).alias("__win"))
    was = F.coalesce("is_redundant", F.lit(False)) if "is_redundant" in nodes.columns else F.lit(False)
    out = rows.join(best, "__key", "left")
    wins = F.coalesce(F.col(ordinal) == F.col("__win"), F.lit(False))
    return out.withColumn("is_winner", wins).withColumn("is_redundant", F.when(F.col("__win").isNotNull(), ~wins).otherwise(was)).drop("__key", "__ok", "__win")


def active(resolved: DataFrame) -> DataFrame:
    """One row per key that has a winner, with its ``path_key``."""
    return resolved.filter("is_winner").withColumn("path_key", overlay_key(F.col("virtual_path")))


def what_if(base: DataFrame, extra: DataFrame, ordinal: str, priority: int) -> DataFrame:
    """The overlay with further records put in at a priority, after all others; the base stays as it is."""
    top = base.agg(F.max(ordinal)).first()[0] or 0
    # The numbers are written down: given out anew whenever the plan runs, they could differ between its branches.
    added = numbered(extra.drop(ordinal), "__at").withColumn(ordinal, (F.lit(top) + F.col("__at") + 1).cast(base.schema[ordinal].dataType)).drop("__at")
    added = added.withColumn("priority", F.lit(priority)).withColumn("is_enabled", F.lit(True))
    return resolve(base.unionByName(added, allowMissingColumns=True), ordinal)


def prioritise(addons: DataFrame, descending: bool = True) -> DataFrame:
    """Priorities of add-ons (name, listed_order INT, null if not listed): listed ones by order, then others by name.

    Ascending gives 1000 - place, descending 1000 + (count - place), places counting from 0: both favour the first. The
    others are sorted by lower-cased name, from the end of the alphabet if descending. One row per add-on of an
    installation; the number of places is that of the archives in one folder.
    """
    low = F.lower("name")
    order = Window.orderBy(F.col("listed_order").isNull(), "listed_order", low.desc() if descending else low.asc(), "name")
    place = F.row_number().over(order) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return addons.withColumn("priority", (F.lit(1000) + total - place if descending else F.lit(1000) - place).cast("int"))
