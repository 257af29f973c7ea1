"""Connected components by alternating star contractions (Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize


#: Edges of a centre beyond which it is joined by itself, and the most such centres.
HOT, HOT_MOST = 1_000_000, 1000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id it can reach, links having no direction.

    ``edges``: u, v of one ordered type. Rows with a null end are ignored; a loop (v, v) makes v a node. An empty table
    gives an empty result. Each round is two aggregations with map-side combination, each joined back to its edges; the
    number of rounds grows with the logarithm of the longest path. ``max_rounds`` only guards against a fault.
    """
    given = edges.select("u", "v").filter("u is not null and v is not null")
    now = materialize(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "star")
    last = _sum(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # Large star: every larger neighbour points at the least of the neighbourhood.
        large = _with_least(now.select(F.col("v").alias("u"), F.col("u").alias("v")), least, last[0]).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # Small star: of the smaller neighbours, all point at the least, and so does the node itself.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, low, last[0])
        nxt = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = materialize(nxt, "star")
        discard(now)
        now, before, last = nxt, last, _sum(nxt)
        if last == before:
            break
    else:
        raise RuntimeError("connected components did not converge")
    nodes = given.select(F.col("u").alias("id")).union(given.select("v")).distinct()
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _with_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``edges`` (u, v) with the least neighbour m of u. Centres of very many edges are joined where the edges lie: there
    are fewer than rows / HOT of them, and their number is bounded by HOT_MOST besides."""
    hot = max(HOT, 2 * rows // HOT_MOST)
    if rows <= hot:
        return edges.join(least.select("u", "m"), "u")
    keys = [r.u for r in least.filter(F.col("n") > hot).select("u").collect()]
    if not keys:
        return edges.join(least.select("u", "m"), "u")
    few = F.broadcast(least.filter(F.col("u").isin(keys)).select("u", "m"))
    rest = least.filter(~F.col("u").isin(keys)).select("u", "m")
    return edges.filter(F.col("u").isin(keys)).join(few, "u").unionByName(edges.filter(~F.col("u").isin(keys)).join(rest, "u"))


def _sum(stars: DataFrame) -> tuple:
    """Fingerprint of a set of edges: one row, whatever the size."""
    h = F.xxhash64("u", "v")
    return tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 40)))).first())
