"""Registered queries of the general problems: hierarchies (2), orphan references (5), heavy keys (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pathkey import is_blank, path_key
from ..operators.hierarchy import descendants, hierarchy, loops
from ..operators.orphans import orphan_counts, orphan_references
from ..operators.skew import pack, per_key_stats, skew_join
from .sqlparts import sql_key, sql_nonblank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def include_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dependencies")
    d = d.filter((F.col("dep_kind") == "include") & ~is_blank(F.col("to_path")))
    return d.select(F.col("from_path").alias("parent"), F.col("to_path").alias("child"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(include_links(spark, sf_dir), with_path=False)
    return h.select(F.col("node").alias("node_path"), F.col("root").alias("root_path"), F.col("depth").cast("int").alias("depth"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(include_links(spark, sf_dir))
    return h.select(F.col("node").alias("node_path"), F.array_join("path", " > ").alias("full_path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(include_links(spark, sf_dir))
    return descendants(h).select(F.col("node").alias("node_path"), F.col("descendant").alias("descendant_path"))


def p2_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(include_links(spark, sf_dir))
    return loops(h).select(F.col("root").alias("root_path"), F.col("length").cast("int").alias("length"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "dependencies"), table(spark, sf_dir, "entry_points")
    d = d.select(F.lit("dependencies").alias("tab"), F.col("dep_id").alias("ref_id"), path_key(F.col("to_path")).alias("key"), F.col("seen_at").alias("t"))
    e = e.select(F.lit("entry_points").alias("tab"), F.col("entry_id").alias("ref_id"), path_key(F.col("virtual_path")).alias("key"), F.col("seen_at").alias("t"))
    return d.unionByName(e)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select(path_key(F.col("virtual_path")).alias("key"), F.col("seen_at").alias("t_from"), F.col("removed_at").alias("t_to"))
    x = table(spark, sf_dir, "external_files").select(path_key(F.col("virtual_path")).alias("key"))
    return orphan_references(references(spark, sf_dir), f, x)


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p5_found(spark, sf_dir))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dependencies").select("to_path", "from_path", "seen_at").filter(~is_blank(F.col("to_path")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = targets(spark, sf_dir)
    p = pack(rows, "to_path")
    return per_key_stats(rows, "to_path", "from_path", "seen_at", packing=p).filter(F.col("n_rows") * 100 >= F.lit(2 * p.total)).select("to_path")


def p6_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_key_stats(targets(spark, sf_dir), "to_path", "from_path", "seen_at")


def p6_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dependency with the stock packages that hold its to_path: the hot paths are stock paths."""
    rows = table(spark, sf_dir, "dependencies").select("dep_id", "to_path")
    x = table(spark, sf_dir, "external_files").select(F.col("virtual_path").alias("to_path"), "ext_source_name", "ext_priority")
    return skew_join(rows, x, "to_path", "inner").select("dep_id", "to_path", "ext_source_name", "ext_priority")


QUERIES = {
    "p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p2_loops": p2_loops,
    "p5_found": p5_found, "p5_counts": p5_counts,
    "p6_found": p6_found, "p6_per_key": p6_per_key, "p6_join": p6_join,
}

LINKS_SQL = f"""links AS (SELECT DISTINCT from_path AS parent, to_path AS child FROM dependencies
  WHERE dep_kind = 'include' AND {sql_nonblank('to_path')} AND from_path IS NOT NULL),
nodes AS (SELECT parent AS node FROM links UNION SELECT child FROM links),
walk AS (SELECT node, [node] AS line FROM nodes
  UNION ALL SELECT w.node, list_prepend(l.parent, w.line) FROM walk w JOIN links l ON l.child = w.line[1]
  WHERE NOT list_contains(w.line, l.parent)),
tops AS (SELECT node, arg_max(line, len(line)) AS line FROM walk GROUP BY node),
closed AS (SELECT t.node, t.line, list_position(t.line, l.parent) AS cut FROM tops t LEFT JOIN links l ON l.child = t.line[1]),
shown AS (SELECT node, line, cut, CASE WHEN cut IS NULL THEN line[1] ELSE list_min(line[1:cut]) END AS root,
  CASE WHEN cut IS NULL THEN len(line) - 1 WHEN cut = len(line) THEN -1 ELSE -2 END AS depth FROM closed),
paths AS (SELECT node, root, depth, CASE WHEN cut IS NULL THEN line
  ELSE list_concat(line[list_position(line, root):cut], list_concat(line[1:list_position(line, root) - 1], line[cut + 1:])) END AS path FROM shown)"""

_REFS = f"""refs AS (SELECT 'dependencies' AS tab, dep_id AS ref_id, {sql_key('to_path')} AS key, seen_at AS t FROM dependencies
  UNION ALL SELECT 'entry_points', entry_id, {sql_key('virtual_path')}, seen_at FROM entry_points),
stock AS (SELECT DISTINCT {sql_key('virtual_path')} AS key FROM external_files),
recs AS (SELECT {sql_key('virtual_path')} AS key, seen_at, removed_at FROM files),
judged AS (SELECT tab, ref_id, t, count(recs.key) AS n, min(recs.seen_at) AS first_at,
    count(*) FILTER (recs.seen_at <= t AND (removed_at IS NULL OR removed_at > t)) AS live
  FROM refs LEFT JOIN recs ON recs.key = refs.key
  WHERE refs.key IS NOT NULL AND refs.key NOT IN (SELECT key FROM stock WHERE key IS NOT NULL) GROUP BY tab, ref_id, t),
found AS (SELECT tab, ref_id, strftime(t, '%Y-%m') AS period,
  CASE WHEN n = 0 THEN 'missing' WHEN first_at > t THEN 'later' ELSE 'removed' END AS state FROM judged WHERE live = 0)"""

_KEYED = f"FROM dependencies WHERE {sql_nonblank('to_path')}"

ORACLE = {
    "p2_found": f"WITH RECURSIVE {LINKS_SQL} SELECT node AS node_path, root AS root_path, depth::INT AS depth FROM shown",
    "p2_paths": f"WITH RECURSIVE {LINKS_SQL} SELECT node AS node_path, array_to_string(path, ' > ') AS full_path FROM paths",
    "p2_descendants": f"WITH RECURSIVE {LINKS_SQL}, flat AS (SELECT unnest(path) AS node_path, node AS descendant_path FROM paths) SELECT * FROM flat WHERE node_path <> descendant_path",
    "p2_loops": f"WITH RECURSIVE {LINKS_SQL} SELECT root AS root_path, count(*)::INT AS length FROM shown WHERE depth = -1 GROUP BY root",
    "p5_found": f"WITH {_REFS} SELECT * FROM found",
    "p5_counts": f"WITH {_REFS} SELECT tab, period, state, count(*) AS n FROM found GROUP BY ALL",
    "p6_found": f"SELECT to_path {_KEYED} GROUP BY to_path HAVING count(*) * 100 >= 2 * (SELECT count(*) {_KEYED})",
    "p6_per_key": f"SELECT to_path, count(*) AS n_rows, count(DISTINCT from_path) AS n_distinct, min(seen_at) AS first_at, max(seen_at) AS last_at {_KEYED} GROUP BY to_path",
    "p6_join": "SELECT dep_id, to_path, ext_source_name, ext_priority FROM dependencies JOIN external_files ON to_path = virtual_path",
}
