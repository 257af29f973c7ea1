"""Per-key work without stragglers: fragment and replicate by estimated load.

The load of every key is counted with map-side combination. Keys are then packed into ``tasks`` bins of near equal load:
a key above ``split_above`` of a bin's fair share is cut into as many shards as its load asks for, each shard placed
on its own bin; all lighter keys are hashed into small groups, and the groups are packed as wholes. The packing is
driver-side but its input is bounded: at most ``tasks / split_above`` heavy keys and ``GROUPS_PER_TASK * tasks`` group
loads, whatever the number of rows or keys.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS_PER_TASK = 16


@dataclass
class Packing:
    """Where each key goes. ``heavy``: key -> bins of its shards; ``groups``: bin of each group of light keys."""

    tasks: int
    total: int
    heavy: dict[str, list[int]] = field(default_factory=dict)
    groups: list[int] = field(default_factory=list)
    loads: list[int] = field(default_factory=list)
    group_of: dict[str, int] = field(default_factory=dict)  # of the heavy keys


def _group(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def pack(df: DataFrame, key: str, tasks: int | None = None, split_above: float = 0.5) -> Packing:
    """Estimate the load per key and pack it into ``tasks`` bins (default: the session's shuffle partitions).

    One pass over the key column. A null key is a key like any other.
    """
    return pack_loads(df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n")), tasks, split_above)


def pack_loads(per_key: DataFrame, tasks: int | None = None, split_above: float = 0.5) -> Packing:
    """``pack`` from loads that are known already: ``per_key`` is k STRING, n, each key once."""
    spark = per_key.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_groups = GROUPS_PER_TASK * tasks
    # Loads per group; the heaviest key of each group is kept by name.
    rows = (
        per_key.groupBy(_group(F.col("k"), n_groups).alias("g"))
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", F.col("k").isNotNull().alias("real"), "k")).alias("top"))
        .collect()
    )
    total = sum(r.n for r in rows)
    share = max(1.0, split_above * total / tasks)
    # A group holds about 1/16 of a bin, so a second heavy key in one group is rare; a further pass finds it.
    heavy = {r.top.k: r.top.n for r in rows if r.top.n > share}
    group_of = {r.top.k: r.g for r in rows if r.top.n > share}
    crowded = [r.g for r in rows if r.n - r.top.n > share]
    if crowded:
        more = per_key.select("k", "n", _group(F.col("k"), n_groups).alias("g")).filter(F.col("g").isin(crowded) & (F.col("n") > F.lit(share))).collect()
        heavy |= {r.k: r.n for r in more}
        group_of |= {r.k: r.g for r in more}
    light = {r.g: r.n for r in rows}
    for k, n in heavy.items():
        light[group_of[k]] -= n
    pieces: list[tuple[float, int, str | None | int]] = []
    for k, n in heavy.items():
        shards = min(tasks, max(2, round(n / share)))
        pieces += [(n / shards, 1, k)] * shards
    pieces += [(n, 0, g) for g, n in light.items() if n]
    pieces.sort(key=lambda p: -p[0])
    bins = [(0.0, b) for b in range(tasks)]
    heapq.heapify(bins)
    out = Packing(tasks, total, {k: [] for k in heavy}, [g % tasks for g in range(n_groups)], [0] * tasks, group_of)
    for n, is_heavy, what in pieces:
        load, b = heapq.heappop(bins)
        if is_heavy:
            out.heavy[what].append(b)
        else:
            out.groups[what] = b
        out.loads[b] = round(load + n)
        heapq.heappush(bins, (load + n, b))
    return out


def _shard_list(p: Packing, key: Column) -> Column:
    """Bins of a heavy key: a literal array of maps, one for each group of keys, so that a lookup meets few entries.

    The heavy keys are bounded in number by tasks / split_above.
    """
    maps: list[dict[str, list[int]]] = [{} for _ in p.groups]
    for k, bins in p.heavy.items():
        if k is not None:
            maps[p.group_of[k]][k] = bins
    table = F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), "array<map<string,array<int>>>")
    return table[_group(key, len(p.groups))][key]


def _bins_of_groups(p: Packing) -> Column:
    """The groups' bins as one literal: a split of a constant, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, p.groups))), ",").cast("array<int>")


def heavy_bins(p: Packing, key: Column) -> Column:
    """Bins of a heavy key's shards, null for a light key."""
    real = [k for k in p.heavy if k is not None]
    hit = F.when(key.isin(real), _shard_list(p, key)) if real else F.lit(None).cast("array<int>")
    if None in p.heavy:
        hit = F.when(key.isNull(), F.array(*map(F.lit, p.heavy[None]))).otherwise(hit)
    return hit


def is_heavy(p: Packing, key: Column) -> Column:
    """Whether the key has shards. Never null."""
    hit = F.coalesce(key.isin([k for k in p.heavy if k is not None]), F.lit(False)) if p.heavy else F.lit(False)
    return hit | key.isNull() if None in p.heavy else hit


def to_bins(df: DataFrame, p: Packing) -> DataFrame:
    """Send rows to the task named by ``_bin``, one task for each bin."""
    return df.repartitionById(p.tasks, F.col("_bin"))


def route(df: DataFrame, p: Packing, key: str, spread: list[str]) -> DataFrame:
    """Add ``_shard`` (null for light keys) and ``_bin`` to every row.

    ``spread``: columns whose hash picks the shard of a heavy key; rows equal in them meet in one shard.
    """
    k = F.col(key).cast("string")
    n_groups = len(p.groups)
    bins = heavy_bins(p, k)
    df = df.withColumn("_shard", F.when(bins.isNotNull(), F.pmod(F.xxhash64(F.lit(17), *spread), F.size(bins)).cast("int")))
    light = _bins_of_groups(p)[_group(k, n_groups)]
    return df.withColumn("_bin", F.when(bins.isNotNull(), bins[F.col("_shard")]).otherwise(light))


def per_key_stats(
    df: DataFrame,
    key: str,
    distinct: str,
    first: str,
    packing: Packing | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Per key: n_rows, n_distinct (non-null values of ``distinct``), first_at and last_at of ``first``.

    Rows of light keys go straight to their bins, once. Of heavy keys, copies of one (key, value) pair are combined
    map-side first, so that a pair repeated millions of times cannot overload a shard; the pairs are then cut by the
    hash of the value, each shard travelling to its own bin: every value lies in one shard, so the shards' distinct
    counts add up. Only the shards' partial rows, one each, take a last, tiny exchange.
    Null keys form a group; null values of ``distinct`` count as rows but not as distinct values; an empty table
    gives an empty result. Only the three columns are read, so other columns cannot clash.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(distinct).alias("v"), F.col(first).alias("t"))
    p = packing or pack(rows, "k", tasks)
    k = F.col("k")
    sums = [F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")]
    merged = [F.sum("n").alias("n"), F.count("v").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    out = [k.alias(key), F.col("n").alias("n_rows"), F.col("d").alias("n_distinct"), F.col("lo").alias("first_at"), F.col("hi").alias("last_at")]
    light = (
        to_bins(route(rows.filter(~is_heavy(p, k)), p, "k", ["v"]), p)
        .groupBy("_bin", "k", "v").agg(*sums)
        .groupBy("_bin", "k").agg(*merged)
    )
    if not p.heavy:
        return light.select(*out)
    heavy = (
        to_bins(route(rows.filter(is_heavy(p, k)).groupBy("k", "v").agg(*sums), p, "k", ["v"]), p)
        .groupBy("_bin", "_shard", "k").agg(*merged)
        .groupBy("k").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    return light.select(*out).unionByName(heavy.select(*out))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", packing: Packing | None = None, tasks: int | None = None) -> DataFrame:
    """Equi-join on ``key`` in which no key of ``left`` can hold up the rest.

    ``how``: inner, left, left_semi or left_anti. Left rows of a heavy key are spread over its shards, and only that
    key's right rows are copied, once to each of those shards; all other right rows travel once. Null keys never
    match. Right columns other than the key must not bear names of left columns; the operator's own working
    columns are named ``_bin`` and ``_shard``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    p = packing or pack(left, key, tasks)
    spread = [c for c, t in left.dtypes if not t.startswith("map")]
    l2 = route(left, p, key, spread).withColumn("_shard", F.coalesce("_shard", F.lit(-1)))
    bins = heavy_bins(p, F.col(key).cast("string"))
    n_groups = len(p.groups)
    light = _bins_of_groups(p)[_group(F.col(key).cast("string"), n_groups)]
    shards = F.when(bins.isNotNull(), F.sequence(F.lit(0), F.size(bins) - 1)).otherwise(F.array(F.lit(-1)))
    r2 = right.filter(F.col(key).isNotNull()).withColumn("_shard", F.explode(shards)).withColumn("_bin", F.when(F.col("_shard") < 0, light).otherwise(bins[F.col("_shard")]))
    return to_bins(l2, p).join(to_bins(r2, p), ["_bin", "_shard", key], how).drop("_bin", "_shard")


#: Rows of one key up to which a plain join is as well: some ten megabytes in one task.
HOT_ROWS = 1_000_000


def spread_join(left: DataFrame, right: DataFrame, key: str, loads: DataFrame, how: str = "inner") -> DataFrame:
    """``skew_join`` where a key of ``left`` is hot, by its known ``loads`` (k STRING, n); else a plain join. The rows are equal."""
    if (loads.agg(F.max("n")).first()[0] or 0) <= HOT_ROWS:
        return left.join(right, key, how)
    return skew_join(left, right, key, how, packing=pack_loads(loads))
