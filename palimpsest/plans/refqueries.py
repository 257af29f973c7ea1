"""Registered queries of the relational, graph and analysis operators, with their DuckDB counterparts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators import analyzers as A
from ..operators import graph as G
from ..operators.overlay import resolve
from ..operators.relation import Relation
from .presets import PRESETS
from .problems import LINKS_SQL

TPC = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
OWN = ["files", "dependencies", "addons", "entry_points", "external_files"]


def catalog(spark: SparkSession, sf_dir: str, edges: bool = False) -> Catalog:
    c = Catalog.from_parquet(spark, sf_dir, [*TPC, *OWN])
    return c.with_edges(chain_edges(spark, sf_dir)) if edges else c


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of orders, customers, nations and regions, with suppliers beside: acyclic, five levels."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = t("orders").select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst"))
    c = t("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    s = t("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))
    n = t("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    return o.union(c).union(s).union(n)


_EDGES = """edges AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def dsl(spec: dict, spark: SparkSession, sf_dir: str, tiebreak: list[str] | None = None) -> DataFrame:
    return catalog(spark, sf_dir).execute(spec, tiebreak)


def all_of(name: str, where: dict) -> dict:
    return {"select": ["*"], "from": name, "where": where}


SPECS: dict[str, tuple[dict, str]] = {
    "scan_star": ({"select": ["*"], "from": "nation"}, "SELECT * FROM nation"),
    "project_distinct": ({"select": ["l_returnflag", "l_linestatus"], "from": "lineitem"}, "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "project_after_limit": ({"select": ["o_orderstatus"], "from": "orders", "order_by": {"by": "o_orderkey"}, "limit": 50}, "SELECT DISTINCT o_orderstatus FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50)"),
    "filter_eq": (all_of("customer", {"eq": ["c_mktsegment", "BUILDING"]}), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_eq_null": ({"select": ["file_id"], "from": "files", "where": {"eq": ["file_hash", None]}}, "SELECT file_id FROM files WHERE file_hash IS NULL"),
    "filter_neq_null": ({"select": ["file_id"], "from": "files", "where": {"neq": ["source_name", "base"]}}, "SELECT file_id FROM files WHERE source_name IS DISTINCT FROM 'base'"),
    "filter_eq_ill_typed": ({"select": ["file_id"], "from": "files", "where": {"or": [{"eq": ["is_enabled", 1]}, {"eq": ["priority", "x"]}]}}, "SELECT file_id FROM files WHERE is_enabled"),
    "filter_range": ({"select": ["file_id", "priority"], "from": "files", "where": {"and": [{"gte": ["priority", 200]}, {"lt": ["priority", 400]}]}}, "SELECT file_id, priority FROM files WHERE priority >= 200 AND priority < 400"),
    "filter_lte": ({"select": ["file_id", "priority"], "from": "files", "where": {"lte": ["priority", 200]}}, "SELECT file_id, priority FROM files WHERE priority <= 200"),
    "filter_not_range": ({"select": ["file_id"], "from": "files", "where": {"not": {"gt": ["priority", 300]}}}, "SELECT file_id FROM files WHERE coalesce(NOT priority > 300, true)"),
    "filter_cross_column": ({"select": ["l_orderkey", "l_linenumber"], "from": "lineitem", "where": {"gt": ["l_tax", ["l_discount"]]}}, "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount"),
    "filter_like_glob": ({"select": ["file_id"], "from": "files", "where": {"like": ["virtual_path", "mat*/[a-f]*/??*.vm[tf]"]}}, "SELECT file_id FROM files WHERE virtual_path GLOB 'mat*/[a-f]*/??*.vm[tf]'"),
    "filter_in": ({"select": ["file_id"], "from": "files", "where": {"in": ["source_type", ["vpk", None]]}}, "SELECT file_id FROM files WHERE source_type = 'vpk' OR source_type IS NULL"),
    "filter_not_in": ({"select": ["file_id"], "from": "files", "where": {"not_in": ["source_name", ["base", "pak01_dir"]]}}, "SELECT file_id FROM files WHERE coalesce(source_name NOT IN ('base', 'pak01_dir'), true)"),
    "filter_null": ({"select": ["entry_id"], "from": "entry_points", "where": {"or": [{"is_null": "source_type"}, {"not": {"is_not_null": "virtual_path"}}]}}, "SELECT entry_id FROM entry_points WHERE source_type IS NULL OR virtual_path IS NULL"),
    "filter_string_ops": ({"select": ["file_id"], "from": "files", "where": {"and": [{"starts_with": ["virtual_path", "materials/"]}, {"ends_with": ["virtual_path", ".vmt"]}, {"contains": ["virtual_path", "_"]}, {"not_contains": ["source_name", "base"]}]}}, "SELECT file_id FROM files WHERE starts_with(virtual_path, 'materials/') AND virtual_path LIKE '%.vmt' AND contains(virtual_path, '_') AND NOT contains(source_name, 'base')"),
    "filter_bool_tree": ({"select": ["file_id"], "from": "files", "where": {"or": [{"and": [{"eq": ["is_active", True]}, {"not": {"eq": ["is_dead", True]}}]}, {"and": [{"gt": ["file_size", 2000000]}, {"neq": ["file_hash", None]}]}]}}, "SELECT file_id FROM files WHERE (is_active AND NOT is_dead) OR (file_size > 2000000 AND file_hash IS NOT NULL)"),
    "exists_in": ({"select": ["dep_id"], "from": "dependencies", "where": {"exists_in": ["to_path", "files"]}}, "SELECT dep_id FROM dependencies d WHERE EXISTS (SELECT 1 FROM files f WHERE f.virtual_path IS NOT DISTINCT FROM d.to_path)"),
    "not_exists_in": ({"select": ["dep_id"], "from": "dependencies", "where": {"not_exists_in": ["to_path", "files"]}}, "SELECT dep_id FROM dependencies d WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.virtual_path IS NOT DISTINCT FROM d.to_path)"),
    "exists_in_nested_or": ({"select": ["dep_id"], "from": "dependencies", "where": {"or": [{"exists_in": ["to_path", "external_files"]}, {"eq": ["dep_kind", "include"]}]}}, "SELECT dep_id FROM dependencies WHERE dep_kind = 'include' OR coalesce(to_path IN (SELECT virtual_path FROM external_files), false)"),
    "exists_in_column": ({"select": ["p_partkey"], "from": "part", "where": {"not_exists_in": ["p_partkey", "lineitem", "l_partkey"]}}, "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"),
    "exists_in_column_there": ({"select": ["c_custkey"], "from": "customer", "where": {"exists_in": ["c_custkey", "orders", "o_custkey"]}}, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "join_on_exists": ({"select": ["file_id", "addon_row"], "from": "files", "join": {"type": "left", "with": "addons", "on": {"and": [{"eq": ["files.source_name", ["addons", "addon_id"]]}, {"exists_in": [["files", "virtual_path"], "dependencies", "to_path"]}]}}}, "SELECT DISTINCT file_id, addon_row FROM files LEFT JOIN addons ON source_name = addon_id AND (virtual_path IN (SELECT to_path FROM dependencies WHERE to_path IS NOT NULL) OR virtual_path IS NULL)"),
    "join_on_not_exists": ({"select": ["file_id", "addon_row"], "from": "files", "join": {"with": "addons", "on": {"and": [{"eq": ["files.source_name", ["addons", "addon_id"]]}, {"or": [{"not_exists_in": [["files", "virtual_path"], "dependencies", "to_path"]}, {"gt": [["addons", "priority"], 300]}]}]}}}, "SELECT DISTINCT file_id, addon_row FROM files f JOIN addons a ON source_name = addon_id AND (NOT coalesce(virtual_path IN (SELECT to_path FROM dependencies WHERE to_path IS NOT NULL), true) OR coalesce(a.priority > 300, false))"),
    "join_inner": ({"select": ["n_name", "r_name"], "from": "nation", "join": {"with": "region", "on": {"eq": ["n_regionkey", ["r_regionkey"]]}}}, "SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_left": ({"select": ["files.file_id", "addons.addon_row"], "from": "files", "join": {"type": "left", "with": "addons", "on": {"eq": ["files.source_name", ["addons", "addon_id"]]}}}, "SELECT DISTINCT file_id, addon_row FROM files LEFT JOIN addons ON source_name = addon_id"),
    "join_right": ({"select": ["addon_row", "file_id"], "from": "files", "join": {"type": "right", "with": "addons", "on": {"eq": ["files.source_name", ["addons", "addon_id"]]}}}, "SELECT DISTINCT addon_row, file_id FROM files RIGHT JOIN addons ON source_name = addon_id"),
    "join_full": ({"select": ["virtual_path", "file_id", "entry_id"], "from": "files", "join": {"type": "full", "with": "entry_points", "on": {"eq": ["files.virtual_path", ["entry_points", "virtual_path"]]}}}, "SELECT DISTINCT coalesce(f.virtual_path, e.virtual_path) AS virtual_path, file_id, entry_id FROM files f FULL JOIN entry_points e ON f.virtual_path = e.virtual_path"),
    "join_composite": ({"select": ["file_id", "addon_row"], "from": "files", "join": {"with": "addons", "on": {"and": [{"eq": ["files.source_name", ["addons", "addon_id"]]}, {"eq": ["files.priority", ["addons", "priority"]]}]}}}, "SELECT DISTINCT file_id, addon_row FROM files f JOIN addons a ON source_name = addon_id AND f.priority = a.priority"),
    "join_swapped_on": ({"select": ["n_name", "r_name"], "from": "nation", "join": {"with": "region", "on": {"eq": ["region.r_regionkey", ["nation", "n_regionkey"]]}}}, "SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_residual": ({"select": ["file_id", "addon_row"], "from": "files", "join": {"type": "left", "with": "addons", "on": {"and": [{"eq": ["files.source_name", ["addons", "addon_id"]]}, {"gt": [["files", "priority"], ["addons", "priority"]]}]}}}, "SELECT DISTINCT file_id, addon_row FROM files f LEFT JOIN addons a ON source_name = addon_id AND f.priority > a.priority"),
    "join_theta": ({"select": ["n_nationkey", "r_regionkey"], "from": "nation", "join": {"with": "region", "on": {"lt": [["nation", "n_regionkey"], ["region", "r_regionkey"]]}}}, "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "join_theta_left": ({"select": ["n_nationkey", "r_regionkey"], "from": "nation", "join": {"type": "left", "with": "region", "on": {"lt": [["nation", "n_regionkey"], ["region", "r_regionkey"]]}}}, "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey < r_regionkey"),
    "join_theta_full": ({"select": ["n_nationkey", "r_regionkey"], "from": "nation", "join": {"type": "full", "with": "region", "on": {"and": [{"lt": [["nation", "n_regionkey"], ["region", "r_regionkey"]]}, {"eq": ["n_name", "CHINA"]}]}}}, "SELECT n_nationkey, r_regionkey FROM nation FULL JOIN region ON n_regionkey < r_regionkey AND n_name = 'CHINA'"),
    "join_multi": ({"select": ["c_custkey", "n_name", "r_name"], "from": "customer", "joins": [{"with": "nation", "on": {"eq": ["c_nationkey", ["n_nationkey"]]}}, {"with": "region", "on": {"eq": ["n_regionkey", ["r_regionkey"]]}}]}, "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "join_self": ({"select": ["n_name", "n_name_right"], "from": "nation", "join": {"with": "nation", "on": {"eq": ["n_regionkey", ["n_regionkey"]]}}}, "SELECT DISTINCT a.n_name, b.n_name AS n_name_right FROM nation a JOIN nation b USING (n_regionkey)"),
    "agg_count": ({"select": ["source_name", "n"], "from": "files", "group_by": {"by": ["source_name"], "agg": {"n": "count"}}}, "SELECT source_name, count(*) AS n FROM files GROUP BY source_name"),
    "agg_sum_avg_min_max": ({"select": ["l_suppkey", "s", "a", "lo", "hi"], "from": "lineitem", "group_by": {"by": ["l_suppkey"], "agg": {"s": ["sum", "l_quantity"], "a": ["avg", "l_quantity"], "lo": ["min", "l_shipdate"], "hi": ["max", "l_quantity"]}}}, "SELECT l_suppkey, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_shipdate) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_suppkey"),
    "agg_sum_bool": ({"select": ["source_type", "s"], "from": "files", "group_by": {"by": ["source_type"], "agg": {"s": ["sum", "is_enabled"]}}}, "SELECT source_type, coalesce(sum(is_enabled::INT::DOUBLE), 0.0) AS s FROM files GROUP BY source_type"),
    "agg_count_where": ({"select": ["source_type", "n"], "from": "files", "group_by": {"by": ["source_type"], "agg": {"n": {"count_where": {"and": [{"neq": ["is_enabled", True]}, {"exists_in": ["virtual_path", "external_files"]}]}}}}}, "SELECT source_type, count(*) FILTER (is_enabled IS DISTINCT FROM true AND coalesce(virtual_path IN (SELECT virtual_path FROM external_files), false)) AS n FROM files GROUP BY source_type"),
    "agg_having": ({"select": ["l_suppkey", "cnt", "qty"], "from": "lineitem", "where": {"gt": ["l_quantity", 10]}, "group_by": {"by": ["l_suppkey"], "agg": {"cnt": "count", "qty": ["sum", "l_quantity"]}}, "having": {"gte": ["cnt", 5]}}, "SELECT l_suppkey, count(*) AS cnt, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity > 10 GROUP BY l_suppkey HAVING count(*) >= 5"),
    "agg_multi_key": ({"select": ["l_returnflag", "l_linestatus", "n"], "from": "lineitem", "group_by": {"by": ["l_returnflag", "l_linestatus"], "agg": {"n": "count"}}}, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL"),
    "agg_after_join": ({"select": ["r_name", "s"], "from": "supplier", "joins": [{"with": "nation", "on": {"eq": ["s_nationkey", ["n_nationkey"]]}}, {"with": "region", "on": {"eq": ["n_regionkey", ["r_regionkey"]]}}], "group_by": {"by": ["r_name"], "agg": {"s": ["max", "s_acctbal"]}}}, "SELECT r_name, max(s_acctbal) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "agg_global": ({"select": ["n", "hi"], "from": "orders", "group_by": {"by": [], "agg": {"n": "count", "hi": ["max", "o_totalprice"]}}}, "SELECT count(*) AS n, max(o_totalprice) AS hi FROM orders"),
    "order_limit_offset": ({"select": ["o_orderkey", "o_totalprice"], "from": "orders", "order_by": {"by": "o_totalprice", "dir": "desc"}, "limit": 25, "offset": 10}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10"),
    "topk": ({"select": ["l_suppkey", "cnt", "qty"], "from": "lineitem", "where": {"gt": ["l_quantity", 10]}, "group_by": {"by": ["l_suppkey"], "agg": {"cnt": "count", "qty": ["sum", "l_quantity"]}}, "having": {"gte": ["cnt", 5]}, "order_by": {"by": "cnt", "dir": "desc"}, "limit": 20}, "SELECT l_suppkey, count(*) AS cnt, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity > 10 GROUP BY l_suppkey HAVING count(*) >= 5 ORDER BY cnt DESC, l_suppkey LIMIT 20"),
    "subquery_from": ({"select": ["source_name", "n"], "from": {"query": {"select": ["source_name", "n"], "from": "files", "group_by": {"by": ["source_name"], "agg": {"n": "count"}}}}, "where": {"gt": ["n", 20]}}, "SELECT * FROM (SELECT source_name, count(*) AS n FROM files GROUP BY source_name) WHERE n > 20"),
    "subquery_join": ({"select": ["addon_row", "n"], "from": "addons", "join": {"with": {"query": {"select": ["source_name", "n"], "from": "files", "group_by": {"by": ["source_name"], "agg": {"n": "count"}}}}, "on": {"eq": ["addon_id", ["source_name"]]}}}, "SELECT addon_row, n FROM addons JOIN (SELECT source_name, count(*) AS n FROM files GROUP BY source_name) ON addon_id = source_name"),
}

TIES = {"order_limit_offset": ["o_orderkey"], "topk": ["l_suppkey"], "project_after_limit": ["o_orderkey"]}


# --- Relation algebra and set operations --------------------------------------------------------------------------------


def _rel(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    return Relation(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)


def rename_columns(spark, sf_dir):
    return _rel(spark, sf_dir, "region").rename({"r_name": "region_name", "nothing": "x"}).df


def update_cell(spark, sf_dir):
    return _rel(spark, sf_dir, "files").update(F.col("priority") > 900, "priority", 900)[0].df.select("file_id", "priority")


def algebra_join_theta(spark, sf_dir):
    a, b = _rel(spark, sf_dir, "nation"), _rel(spark, sf_dir, "region")
    return a.join_theta(b, lambda l, r: l("n_regionkey") > r("r_regionkey"), "right").df.select("r_regionkey", "n_nationkey")


def algebra_join_full(spark, sf_dir):
    a, b = _rel(spark, sf_dir, "files").project("virtual_path"), _rel(spark, sf_dir, "external_files").project("virtual_path", "ext_source_name")
    return a.join_full(b, "virtual_path").df


def ndv(spark, sf_dir):
    r = _rel(spark, sf_dir, "files")
    return spark.createDataFrame([("file_hash", r.distinct_count("file_hash")), ("source_name", r.distinct_count("source_name"))], "col string, n long")


def set_union_all(spark, sf_dir):
    return _rel(spark, sf_dir, "nation").union_all(_rel(spark, sf_dir, "nation")).df


def _keys(spark, sf_dir):
    return _rel(spark, sf_dir, "files").project("virtual_path"), _rel(spark, sf_dir, "entry_points").project("virtual_path")


def set_union(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.union(b).df


def set_minus(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return b.minus(a).df


def set_intersect(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersect(b).df


# --- Graph --------------------------------------------------------------------------------------------------------------


def graph_descendants(spark, sf_dir):
    return G.descendants_of(chain_edges(spark, sf_dir), "o1")


def graph_ancestors(spark, sf_dir):
    return G.ancestors_of(chain_edges(spark, sf_dir), "n3")


def graph_reach_multi(spark, sf_dir):
    seeds = spark.createDataFrame([("c1",), ("c2",), ("s1",), ("n1",)], "id string")
    return G.reachable(chain_edges(spark, sf_dir), seeds)


def graph_pred_ancestor(spark, sf_dir):
    edges = chain_edges(spark, sf_dir)
    return G.reached_by_other(edges, G.nodes_of(edges).filter("id like 'c%'"))


def graph_pred_descendant(spark, sf_dir):
    edges = chain_edges(spark, sf_dir)
    return G.reached_by_other(G.reverse(edges), G.nodes_of(edges).filter("id in ('n1', 'r2')"))


def graph_has_path(spark, sf_dir):
    e = chain_edges(spark, sf_dir)
    return spark.createDataFrame([(G.has_path(e, "s1", "o1"), G.has_path(e, "o1", "o1"), G.has_path(e, "zz", "o1"))], "a boolean, b boolean, c boolean")


def graph_degree(spark, sf_dir):
    return G.degrees(chain_edges(spark, sf_dir)).select("id", "degree")


def event_edges(spark, sf_dir):
    """From each event type to the type of the same user's next event: a small cyclic graph."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("src"), nxt.alias("dst")).filter("dst is not null").distinct()


def graph_cycles(spark, sf_dir):
    return G.elementary_cycles(event_edges(spark, sf_dir)).select(F.array_join("cycle", ">").alias("cycle"), "length")


def graph_source_dsl(spark, sf_dir):
    """Files below the most used script of the include graph, through the query language."""
    c = catalog(spark, sf_dir)
    inc = c["dependencies"].filter("dep_kind = 'include'").select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))
    start = inc.groupBy("src").count().orderBy(F.desc("count"), "src").first().src
    return c.with_edges(inc).execute({"select": ["file_id", "virtual_path"], "from": {"descendants_of": start}})


def graph_predicate_dsl(spark, sf_dir):
    """Per type, files that a map reaches."""
    c = catalog(spark, sf_dir)
    return c.execute({"select": ["source_type", "n"], "from": "files", "where": {"ancestor_is_map": "virtual_path"}, "group_by": {"by": ["source_type"], "agg": {"n": "count"}}})


def join_on_graph(spark, sf_dir):
    """Files with the add-ons that hold them, if a map reaches them."""
    on = {"and": [{"eq": ["files.source_name", ["addons", "addon_id"]]}, {"ancestor_is_map": ["files", "virtual_path"]}]}
    return catalog(spark, sf_dir).execute({"select": ["file_id", "addon_row"], "from": "files", "join": {"with": "addons", "on": on}})


def graph_ancestors_dsl(spark, sf_dir):
    """Files above the stock texture, through the query language, over all links."""
    return catalog(spark, sf_dir).execute({"select": ["file_id", "virtual_path"], "from": {"ancestors_of": "materials/common/blank_surface.vtf"}})


def graph_any_descendant_dsl(spark, sf_dir):
    """Files that reach a sound or a particle file."""
    where = {"descendant_is_any": {"column": "virtual_path", "params": {"extensions": [".wav", ".PCF"]}}}
    return catalog(spark, sf_dir).execute({"select": ["file_id"], "from": "files", "where": where})


def graph_script_descendant_dsl(spark, sf_dir):
    return catalog(spark, sf_dir).execute({"select": ["file_id"], "from": "files", "where": {"descendant_is_script": "virtual_path"}})


def find_cycles(spark, sf_dir):
    """The cycles of one or two links through the source of the query language, over all links."""
    c = catalog(spark, sf_dir)
    c = c.with_relation("dependency_cycles", G.elementary_cycles(c.edges, max_length=2))
    return c.execute({"select": ["*"], "from": {"find_cycles": True}}).select(F.array_join("cycle", ">").alias("cycle"), "length")


def impact_counts(spark, sf_dir):
    return G.impact_counts(chain_edges(spark, sf_dir))


def impact_dependencies(spark, sf_dir):
    """Strict descendants of every path, over all links."""
    return G.impact_counts(catalog(spark, sf_dir).edges)


def graph_centrality(spark, sf_dir):
    return G.degrees(catalog(spark, sf_dir).edges).select("id", "degree", F.round("centrality", 9).alias("centrality"))


# --- Overlay and analyzers ------------------------------------------------------------------------------------------------


def _nodes(spark, sf_dir):
    return resolve(spark.read.parquet(f"{sf_dir}/files.parquet"), "file_id")


def _edges(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/dependencies.parquet").select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))


def overlay_resolve(spark, sf_dir):
    return _nodes(spark, sf_dir).select("file_id", "is_winner", "is_redundant")


def dead_files(spark, sf_dir):
    f = spark.read.parquet(f"{sf_dir}/files.parquet")
    e = spark.read.parquet(f"{sf_dir}/entry_points.parquet")
    return A.mark_dead(f, _edges(spark, sf_dir), e).select("file_id", "is_dead")


def hash_conflicts(spark, sf_dir):
    return A.hash_conflicts(spark.read.parquet(f"{sf_dir}/files.parquet"), "file_id")


def dep_conflicts(spark, sf_dir):
    return A.dependency_conflicts(_nodes(spark, sf_dir), _edges(spark, sf_dir))


def isolated(spark, sf_dir):
    return A.isolated_packages(spark.read.parquet(f"{sf_dir}/files.parquet")).select("source_name", "dead_file_count", F.array_join("example_paths", "|").alias("example_paths"))


def cascade(spark, sf_dir):
    return A.cascade_overrides(spark.read.parquet(f"{sf_dir}/files.parquet"), "file_id").select("virtual_path", F.size("chain_sources").alias("n"), "active_source")


def global_scripts(spark, sf_dir):
    return A.global_scripts(spark.read.parquet(f"{sf_dir}/files.parquet"))


def implicit_deps(spark, sf_dir):
    return A.implicit_dependencies(_nodes(spark, sf_dir), _edges(spark, sf_dir))


def mod_types(spark, sf_dir):
    f = spark.read.parquet(f"{sf_dir}/files.parquet")
    return A.classify_sources(f, spark.read.parquet(f"{sf_dir}/external_files.parquet"))


def map_conflicts(spark, sf_dir):
    return A.map_conflicts(spark.read.parquet(f"{sf_dir}/files.parquet"), spark.read.parquet(f"{sf_dir}/external_files.parquet"), "file_id")


def pure_whitelist(spark, sf_dir):
    return A.pure_allowed(spark.read.parquet(f"{sf_dir}/files.parquet"), ["materials/*.vmt", "sound/*"]).select("file_id", "is_pure_allowed")


def entry_points_found(spark, sf_dir):
    return A.discover_entry_points(spark.read.parquet(f"{sf_dir}/files.parquet"))


def entry_points_of_game(spark, sf_dir):
    """With a game's own manifests, all maps, and files that scripts list."""
    listed = spark.read.parquet(f"{sf_dir}/dependencies.parquet").filter("dep_kind = 'script'").select(F.col("to_path").alias("path"))
    return A.discover_entry_points(spark.read.parquet(f"{sf_dir}/files.parquet"), -1, "l4d2", listed)


def entry_points_live(spark, sf_dir):
    return A.live_entry_points(spark.read.parquet(f"{sf_dir}/entry_points.parquet"), _edges(spark, sf_dir)).select("entry_id")


def check_extensions(spark, sf_dir):
    return A.extension_filter(spark.read.parquet(f"{sf_dir}/dependencies.parquet"), ["from_path", "to_path"], {".wav", ".pcf"}).select("dep_id")


def synthetic(spark, sf_dir):
    """Over the files and, beside each map and model, the files that belong to it."""
    f = spark.read.parquet(f"{sf_dir}/files.parquet").select("file_id", "virtual_path", "source_name", "priority", "is_enabled", "is_dead")
    stem = F.regexp_extract("k", r"([^/]*)\.bsp$", 1)
    k = f.withColumn("k", F.lower(F.translate("virtual_path", "\\", "/")))
    own = [F.concat(F.lit("maps/"), stem, F.lit("_level_sounds.txt")), F.concat(F.lit("scripts/soundscapes_"), stem, F.lit(".txt"))]
    maps = [k.filter("k like '%.bsp'").select((F.col("file_id") + 10_000_000 * (i + 1)).alias("file_id"), p.alias("virtual_path"), "source_name", "priority", "is_enabled", "is_dead") for i, p in enumerate(own)]
    models = k.filter("k like '%.mdl'").select((F.col("file_id") + 30_000_000).alias("file_id"), F.regexp_replace("k", r"\.mdl$", ".phy").alias("virtual_path"), "source_name", "priority", "is_enabled", "is_dead")
    return A.synthetic_edges(resolve(f.unionByName(maps[0]).unionByName(maps[1]).unionByName(models), "file_id"))


def top3_per_group(spark, sf_dir):
    from pyspark.sql import Window

    f = spark.read.parquet(f"{sf_dir}/files.parquet").filter("source_name is not null")
    w = Window.partitionBy("source_name").orderBy(F.desc_nulls_last("file_size"), "file_id")
    return f.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("source_name", "file_id", "n")


PY = [
    rename_columns, update_cell, algebra_join_theta, algebra_join_full, ndv, set_union_all, set_union, set_minus, set_intersect, graph_descendants, graph_ancestors, graph_reach_multi,
    join_on_graph, graph_ancestors_dsl, graph_any_descendant_dsl, graph_script_descendant_dsl, find_cycles, impact_dependencies, graph_centrality,
    graph_pred_ancestor, graph_pred_descendant, graph_has_path, graph_degree, graph_cycles, graph_source_dsl, graph_predicate_dsl, impact_counts, overlay_resolve, dead_files, hash_conflicts,
    dep_conflicts, isolated, cascade, global_scripts, implicit_deps, mod_types, map_conflicts, pure_whitelist, entry_points_found, entry_points_of_game, entry_points_live, check_extensions, synthetic, top3_per_group,
]


# --- Presets over the stored tables ---------------------------------------------------------------------------------------


def own_reference(spark, sf_dir):
    """The game's own packages as an external reference: stock paths, with other hashes where the size is odd."""
    f = spark.read.parquet(f"{sf_dir}/files.parquet").filter("source_name in ('base', 'pak01_dir') and virtual_path is not null")
    f = f.groupBy("virtual_path").agg(F.max("file_size").alias("ext_file_size"), F.min("file_hash").alias("h"))
    return f.select("virtual_path", F.lit("ref:own").alias("ext_source_name"), F.when(F.col("ext_file_size") % 3 == 0, 90).otherwise(400).alias("ext_priority"), F.when(F.col("ext_file_size") % 2 == 1, "0").otherwise(F.col("h")).alias("ext_file_hash"), "ext_file_size")


def _own(spark, sf_dir, c):
    return c.with_relation("external_files", own_reference(spark, sf_dir))


def _extracted(kind, spark, sf_dir, c):
    """Dependencies as the extractor of one format finds them."""
    from .filequeries import extracted

    e = extracted(kind, spark, sf_dir).select(F.col("src").alias("from_path"), F.col("dst").alias("to_path"), F.lit(None).cast("string").alias("expected_source"))
    return c.with_relation("dependencies", e)


def _hotel(spark, sf_dir, c):
    """The graph with the preset's map put above all levels."""
    d = c["dependencies"]
    tops = d.filter("dep_kind = 'level' and from_path is not null").select(F.lit("maps/c1m1_hotel.bsp").alias("src"), F.col("from_path").alias("dst"))
    return c.with_edges(c.edges.union(tops))


def _packed(spark, sf_dir, c):
    """Files whose sources bear the names of their archives."""
    return c.with_relation("files", c["files"].withColumn("source_name", F.concat("source_name", F.lit(".vpk"))))


#: Presets that find nothing in the stored tables, with what they are run over as well.
OVER = {
    "external_overlap": _own, "external_overridden": _own, "external_overrides": _own, "infected_model_usage": partial(_extracted, "x_population"),
    "melee_weapon_chain": partial(_extracted, "x_melee"), "map_descendants": _hotel, "cross_map_pollution": _packed,
}


def preset(name: str, spark: SparkSession, sf_dir: str, over=None) -> DataFrame:
    """A preset over the stored tables and the relations derived from them. Ties at a limit are broken by all columns; a
    preset with a limit and no order is ordered by its first column, so that its rows are defined."""
    c = catalog(spark, sf_dir)
    if over is not None:
        c = over(spark, sf_dir, c)
    spec = PRESETS[name]
    src = spec["from"] if isinstance(spec["from"], str) else "files"
    derive = {
        "dep_conflicts": lambda: A.dependency_conflicts(_nodes(spark, sf_dir), c.edges), "cascade_overrides": lambda: A.cascade_overrides(c["files"], "file_id"), "global_scripts": lambda: A.global_scripts(c["files"]),
        "hash_conflicts": lambda: A.hash_conflicts(c["files"], "file_id"), "implicit_deps": lambda: A.implicit_dependencies(_nodes(spark, sf_dir), c.edges), "isolated": lambda: A.isolated_packages(c["files"]),
        "mod_types": lambda: A.classify_sources(c["files"], c["external_files"]), "impact": lambda: A.impact(_nodes(spark, sf_dir), c.edges, None), "dependency_cycles": lambda: G.elementary_cycles(c.edges, at_least=spec["limit"]),
    }
    if src in derive:
        c = c.with_relation(src, derive[src]())
    ties = [x if isinstance(x, str) else x[-1] for x in spec["select"]]
    if "order_by" not in spec and "limit" in spec:
        first = spec["select"][0]
        spec = {**spec, "order_by": {"by": first}}
    out = c.execute(spec, [t.split(".")[-1] for t in ties])
    if name == "dependency_cycles":
        out = out.select(F.array_join("cycle", ">").alias("cycle"), "length")
    return out


QUERIES = {
    **{k: partial(dsl, v[0], tiebreak=TIES.get(k)) for k, v in SPECS.items()},
    **{f.__name__: f for f in PY},
    **{f"preset_{n}": partial(preset, n) for n in PRESETS},
    **{f"preset_{n}_derived": partial(preset, n, over=o) for n, o in OVER.items()},
}

_KEY = "lower(replace(virtual_path, chr(92), '/'))"
_RESOLVED = f"""res AS (SELECT *, {_KEY} AS k, first_value(CASE WHEN coalesce(is_enabled AND NOT is_dead, false) THEN file_id END) OVER (PARTITION BY {_KEY} ORDER BY coalesce(is_enabled AND NOT is_dead, false) DESC, priority DESC NULLS LAST, file_id) AS win FROM files WHERE virtual_path IS NOT NULL),
act AS (SELECT virtual_path, source_name, k FROM res WHERE file_id = win),
links AS (SELECT DISTINCT from_path AS src, to_path AS dst FROM dependencies WHERE from_path IS NOT NULL AND to_path IS NOT NULL)"""
_DEPC = f"""{_RESOLVED}, depc AS (SELECT src AS from_path, dst AS to_path, s.source_name AS expected_source, CASE WHEN a.k IS NULL THEN 'MISSING' ELSE a.source_name END AS actual_source
  FROM links JOIN act s ON s.virtual_path = src LEFT JOIN act a ON a.k = lower(replace(dst, chr(92), '/')) WHERE a.k IS NULL OR a.source_name IS DISTINCT FROM s.source_name)"""
_HASHC = """n AS (SELECT * FROM files WHERE is_enabled AND file_hash <> '' AND virtual_path IS NOT NULL),
w AS (SELECT DISTINCT ON (virtual_path) virtual_path, source_name AS ws, file_hash AS wh FROM n ORDER BY virtual_path, priority DESC NULLS LAST, file_id),
hashc AS (SELECT virtual_path, ws AS winner_source, source_name AS loser_source, wh AS winner_hash, file_hash AS loser_hash,
  CASE WHEN coalesce(regexp_matches(ws, '(^base|_dir)([.][^.]*)?$'), false) OR coalesce(regexp_matches(source_name, '(^base|_dir)([.][^.]*)?$'), false) THEN 'info' ELSE 'warning' END AS severity
  FROM n JOIN w USING (virtual_path) WHERE file_hash <> wh)"""
_CASC = """casc AS (SELECT virtual_path, count(*)::INT AS n, arg_min(coalesce(source_name, chr(1)), o) AS s FROM
  (SELECT *, row_number() OVER (PARTITION BY virtual_path ORDER BY priority DESC NULLS LAST, file_id) AS o FROM files WHERE virtual_path IS NOT NULL) GROUP BY virtual_path HAVING count(*) >= 3)"""
_IMPL = f"""{_RESOLVED}, impl AS (SELECT DISTINCT a.source_name AS dependent_addon, b.source_name AS provider_addon, dst AS virtual_path FROM links JOIN act a ON a.virtual_path = src JOIN act b ON b.virtual_path = dst WHERE a.source_name <> b.source_name)"""
_MODT = """ext AS (SELECT DISTINCT virtual_path FROM external_files WHERE virtual_path IS NOT NULL),
g AS (SELECT source_name, count(*)::INT AS total_files, count(*) FILTER (is_dead)::INT AS dead_files, count(*) FILTER (is_redundant)::INT AS redundant_files, count(*) FILTER (is_active AND NOT is_dead)::INT AS active_files,
  coalesce(bool_or(is_disabled_addon), false) AS is_disabled, coalesce(bool_or(virtual_path LIKE '%.bsp'), false) AS m, coalesce(bool_or(virtual_path LIKE '%.nut'), false) AS s,
  count(DISTINCT e.virtual_path) AS o, count(DISTINCT files.virtual_path) AS p FROM files LEFT JOIN ext e USING (virtual_path) GROUP BY source_name),
modt AS (SELECT source_name, CASE WHEN is_disabled THEN 'disabled' WHEN m THEN 'map' WHEN s THEN 'script' WHEN o * 2 > p THEN 'replacement' WHEN total_files < 10 THEN 'fragment' ELSE 'resource_pack' END AS mod_type, total_files, dead_files, redundant_files, active_files, is_disabled FROM g)""".replace("bool_or(virtual_path", "bool_or(files.virtual_path")
_ISOL = """bad AS (SELECT DISTINCT source_name, virtual_path FROM files WHERE is_dead OR is_redundant),
ex AS (SELECT source_name, string_agg(virtual_path, '|' ORDER BY virtual_path) AS p FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY virtual_path NULLS FIRST) AS n FROM bad) WHERE n <= 3 GROUP BY source_name),
isol AS (SELECT f.source_name, count(*) FILTER (is_dead OR is_redundant)::INT AS dead_file_count, coalesce(any_value(ex.p), '') AS example_paths FROM files f LEFT JOIN ex ON ex.source_name IS NOT DISTINCT FROM f.source_name GROUP BY f.source_name)"""
_LINKS = "links AS (SELECT DISTINCT from_path AS src, to_path AS dst FROM dependencies WHERE from_path IS NOT NULL AND to_path IS NOT NULL)"
_REACH = "WITH RECURSIVE {e}, reach AS (SELECT dst AS id FROM edges WHERE {s} UNION SELECT dst FROM edges JOIN reach ON src = id) "
_PAIRS = f"WITH RECURSIVE {_EDGES}, pairs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM pairs JOIN edges ON src = b) "
def _entries_sql(more: str, listed: str) -> str:
    return rf"""WITH p AS (SELECT DISTINCT virtual_path, lower(replace(virtual_path, '\', '/')) AS k FROM files WHERE virtual_path IS NOT NULL AND is_active), maps AS (SELECT regexp_extract(k, '([^/]*)[.]bsp$', 1) AS stem FROM p WHERE k LIKE '%.bsp'),
      f AS (SELECT * FROM p WHERE (k LIKE 'scripts/vscripts/%' AND k LIKE '%.nut') OR (k LIKE 'missions/%' AND k LIKE '%.txt') OR {more} OR {listed}
        OR k IN ('scripts/soundscapes_manifest.txt', 'scripts/game_sounds_manifest.txt', 'particles/particles_manifest.txt', 'cfg/config.cfg', 'cfg/autoexec.cfg', 'scripts/population.txt', 'scripts/sound_prefetch.txt', 'gameinfo.txt')
        OR k IN (SELECT 'maps/' || stem || '_level_sounds.txt' FROM maps UNION SELECT 'scripts/soundscapes_' || stem || '.txt' FROM maps))
      SELECT virtual_path, CASE WHEN contains(v, 'manifest') THEN 'manifest' WHEN v LIKE '%.bsp' THEN 'map' WHEN v LIKE 'missions/%' THEN 'mission' WHEN contains(v, 'soundscapes_') AND v LIKE '%.txt' THEN 'soundscape' WHEN ends_with(v, '_level_sounds.txt') THEN 'level_sounds'
        WHEN ends_with(v, 'population.txt') THEN 'population' WHEN v LIKE '%.nut' OR starts_with(v, 'scripts/vscripts/') OR v IN ('cfg/config.cfg', 'cfg/autoexec.cfg', 'gameinfo.txt', 'scripts/sound_prefetch.txt') THEN 'script' ELSE 'user_specified' END AS source_type
      FROM (SELECT *, lower(virtual_path) AS v FROM f)"""


_SCRIPT_STEM = r"regexp_extract(k, '([^/]*)[.]bsp$', 1)"

ORACLE = {
    **{k: v[1] for k, v in SPECS.items()},
    "rename_columns": "SELECT r_regionkey, r_name AS region_name FROM region",
    "update_cell": "SELECT file_id, CASE WHEN priority > 900 THEN 900 ELSE priority END AS priority FROM files",
    "algebra_join_theta": "SELECT r_regionkey, n_nationkey FROM nation RIGHT JOIN region ON n_regionkey > r_regionkey",
    "algebra_join_full": "SELECT coalesce(a.virtual_path, b.virtual_path) AS virtual_path, ext_source_name FROM (SELECT DISTINCT virtual_path FROM files) a FULL JOIN (SELECT DISTINCT virtual_path, ext_source_name FROM external_files) b ON a.virtual_path = b.virtual_path",
    "ndv": "SELECT 'file_hash' AS col, count(DISTINCT file_hash) + max((file_hash IS NULL)::INT) AS n FROM files UNION ALL SELECT 'source_name', count(DISTINCT source_name) + max((source_name IS NULL)::INT) FROM files",
    "set_union_all": "SELECT * FROM nation UNION ALL SELECT * FROM nation",
    "set_union": "SELECT virtual_path FROM files UNION SELECT virtual_path FROM entry_points",
    "set_minus": "SELECT virtual_path FROM entry_points EXCEPT SELECT virtual_path FROM files",
    "set_intersect": "SELECT virtual_path FROM files INTERSECT SELECT virtual_path FROM entry_points",
    "graph_descendants": _REACH.format(e=_EDGES, s="src = 'o1'") + "SELECT id FROM reach WHERE id <> 'o1'",
    "graph_ancestors": f"WITH RECURSIVE {_EDGES}, reach AS (SELECT src AS id FROM edges WHERE dst = 'n3' UNION SELECT src FROM edges JOIN reach ON dst = id) SELECT id FROM reach WHERE id <> 'n3'",
    "graph_reach_multi": _REACH.format(e=_EDGES, s="src IN ('c1', 'c2', 's1', 'n1')") + "SELECT id FROM reach",
    "graph_pred_ancestor": _PAIRS + "SELECT DISTINCT b AS id FROM pairs WHERE a LIKE 'c%' AND a <> b",
    "graph_pred_descendant": _PAIRS + "SELECT DISTINCT a AS id FROM pairs WHERE b IN ('n1', 'r2') AND a <> b",
    "graph_has_path": _PAIRS + "SELECT EXISTS (SELECT 1 FROM pairs WHERE a = 's1' AND b = 'o1') AS a, true AS b, false AS c",
    "graph_degree": f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id",
    "graph_cycles": """WITH RECURSIVE e AS (SELECT DISTINCT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), edges AS (SELECT * FROM e WHERE dst IS NOT NULL),
      paths AS (SELECT src AS first, dst AS last, [src] AS path FROM edges WHERE src <= dst UNION ALL SELECT first, dst, list_append(path, last) FROM paths JOIN edges ON src = last WHERE last <> first AND NOT list_contains(path, last) AND (dst > first OR dst = first))
      SELECT array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM paths WHERE first = last""",
    "graph_source_dsl": """WITH RECURSIVE edges AS (SELECT DISTINCT from_path AS src, to_path AS dst FROM dependencies WHERE dep_kind = 'include' AND to_path IS NOT NULL AND from_path IS NOT NULL),
      top AS (SELECT from_path AS s FROM dependencies WHERE dep_kind = 'include' GROUP BY from_path ORDER BY count(*) DESC, from_path LIMIT 1),
      reach AS (SELECT dst AS id FROM edges JOIN top ON src = s UNION SELECT dst FROM edges JOIN reach ON src = id)
      SELECT file_id, virtual_path FROM files WHERE virtual_path IN (SELECT id FROM reach) AND virtual_path NOT IN (SELECT s FROM top)""",
    "graph_predicate_dsl": """WITH RECURSIVE edges AS (SELECT DISTINCT from_path AS src, to_path AS dst FROM dependencies WHERE from_path IS NOT NULL AND to_path IS NOT NULL),
      pairs AS (SELECT src AS a, dst AS b FROM edges WHERE src LIKE '%.bsp' UNION SELECT a, dst FROM pairs JOIN edges ON src = b)
      SELECT source_type, count(*) AS n FROM files WHERE virtual_path IN (SELECT b FROM pairs WHERE a <> b) GROUP BY source_type""",
    "join_on_graph": f"WITH RECURSIVE {_LINKS}, below AS (SELECT src AS a, dst AS b FROM links WHERE src LIKE '%.bsp' UNION SELECT a, dst FROM below JOIN links ON src = b) SELECT DISTINCT file_id, addon_row FROM files JOIN addons ON source_name = addon_id WHERE virtual_path IN (SELECT b FROM below WHERE a <> b)",
    "graph_ancestors_dsl": f"WITH RECURSIVE {_LINKS}, up AS (SELECT src AS id FROM links WHERE dst = 'materials/common/blank_surface.vtf' UNION SELECT src FROM links JOIN up ON dst = id) SELECT file_id, virtual_path FROM files WHERE virtual_path IN (SELECT id FROM up) AND virtual_path <> 'materials/common/blank_surface.vtf'",
    "graph_any_descendant_dsl": f"WITH RECURSIVE {_LINKS}, up AS (SELECT dst AS b, src AS a FROM links WHERE regexp_matches(dst, '(?i)[.](wav|pcf)$') UNION SELECT b, src FROM up JOIN links ON dst = a) SELECT file_id FROM files WHERE virtual_path IN (SELECT a FROM up WHERE a <> b)",
    "graph_script_descendant_dsl": f"WITH RECURSIVE {_LINKS}, up AS (SELECT dst AS b, src AS a FROM links WHERE dst LIKE '%.nut' UNION SELECT b, src FROM up JOIN links ON dst = a) SELECT file_id FROM files WHERE virtual_path IN (SELECT a FROM up WHERE a <> b)",
    "find_cycles": f"WITH {_LINKS} SELECT src AS cycle, 1 AS length FROM links WHERE src = dst UNION ALL SELECT a.src || '>' || a.dst, 2 FROM links a JOIN links b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst",
    "impact_dependencies": f"WITH RECURSIVE {_LINKS}, pairs AS (SELECT src AS a, dst AS b FROM links UNION SELECT a, dst FROM pairs JOIN links ON src = b), nodes AS (SELECT src AS id FROM links UNION SELECT dst FROM links) SELECT id, count(b) AS impact_count FROM nodes LEFT JOIN pairs ON a = id AND a <> b GROUP BY id",
    "graph_centrality": f"WITH {_LINKS}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY id) SELECT id, degree, round(degree / (count(*) OVER () - 1), 9) AS centrality FROM d",
    "impact_counts": _PAIRS + ", nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT id, count(DISTINCT b) AS impact_count FROM nodes LEFT JOIN pairs ON a = id AND a <> b GROUP BY id",
    "overlay_resolve": f"WITH {_RESOLVED} SELECT files.file_id, coalesce(files.file_id = win, false) AS is_winner, CASE WHEN win IS NOT NULL THEN files.file_id <> win ELSE coalesce(files.is_redundant, false) END AS is_redundant FROM files LEFT JOIN res USING (file_id)",
    "dead_files": """WITH RECURSIVE edges AS (SELECT DISTINCT from_path AS src, to_path AS dst FROM dependencies WHERE from_path IS NOT NULL AND to_path IS NOT NULL),
      live AS (SELECT virtual_path AS id FROM entry_points WHERE virtual_path IS NOT NULL UNION SELECT dst FROM edges JOIN live ON src = id)
      SELECT file_id, coalesce(is_dead, false) OR (coalesce(is_active, false) AND coalesce(virtual_path NOT IN (SELECT id FROM live), true)) AS is_dead FROM files""",
    "hash_conflicts": f"WITH {_HASHC} SELECT * FROM hashc",
    "dep_conflicts": f"WITH {_DEPC} SELECT * FROM depc",
    "isolated": f"WITH {_ISOL} SELECT * FROM isol",
    "cascade": f"WITH {_CASC} SELECT virtual_path, n, nullif(s, chr(1)) AS active_source FROM casc",
    "global_scripts": "SELECT virtual_path, source_name, source_type FROM files WHERE virtual_path LIKE '%.nut' AND NOT contains(virtual_path, 'maps/')",
    "implicit_deps": f"WITH {_IMPL} SELECT * FROM impl",
    "mod_types": f"WITH {_MODT} SELECT * FROM modt",
    "map_conflicts": """WITH n AS (SELECT virtual_path, source_name, priority, file_hash, file_id::HUGEINT AS o FROM files WHERE virtual_path LIKE '%.bsp' UNION ALL SELECT virtual_path, ext_source_name, -1, NULL, 4611686018427387904 FROM external_files WHERE virtual_path LIKE '%.bsp'),
      ok AS (SELECT virtual_path FROM n GROUP BY virtual_path HAVING count(DISTINCT source_name) >= 2 AND count(DISTINCT file_hash) > 1),
      w AS (SELECT *, row_number() OVER (PARTITION BY virtual_path ORDER BY priority DESC NULLS LAST, o) AS r FROM n SEMI JOIN ok USING (virtual_path))
      SELECT a.virtual_path, b.source_name AS winner_source, a.source_name AS loser_source, b.file_hash AS winner_hash, a.file_hash AS loser_hash, 'warning' AS severity FROM w a JOIN w b ON a.virtual_path = b.virtual_path AND b.r = 1 AND a.r > 1""",
    "pure_whitelist": "SELECT file_id, coalesce(lower(virtual_path) GLOB 'materials/*.vmt' OR lower(virtual_path) GLOB 'sound/*', false) AS is_pure_allowed FROM files",
    "entry_points_found": _entries_sql("false", "false"),
    "entry_points_of_game": _entries_sql("k IN ('scripts/melee/melee_manifest.txt', 'scripts/bonus_maps_manifest.txt', 'scripts/sprays_manifest.txt') OR k LIKE '%.bsp'", rf"k IN (SELECT lower(replace(to_path, '\', '/')) FROM dependencies WHERE dep_kind = 'script')"),
    "entry_points_live": "SELECT entry_id FROM entry_points WHERE virtual_path IN (SELECT from_path FROM dependencies)",
    "check_extensions": r"SELECT dep_id FROM dependencies WHERE coalesce(lower(regexp_extract(from_path, '([.][^./\\]*)$', 1)) IN ('.wav', '.pcf'), false) OR coalesce(lower(regexp_extract(to_path, '([.][^./\\]*)$', 1)) IN ('.wav', '.pcf'), false)",
    "synthetic": f"""WITH own AS (SELECT *, {_KEY} AS k FROM files), stems AS (SELECT *, {_SCRIPT_STEM} AS stem FROM own WHERE k LIKE '%.bsp'),
      more AS (SELECT file_id, virtual_path, source_name, priority, is_enabled, is_dead FROM files UNION ALL SELECT file_id + 10000000, 'maps/' || stem || '_level_sounds.txt', source_name, priority, is_enabled, is_dead FROM stems
        UNION ALL SELECT file_id + 20000000, 'scripts/soundscapes_' || stem || '.txt', source_name, priority, is_enabled, is_dead FROM stems
        UNION ALL SELECT file_id + 30000000, regexp_replace(k, '[.]mdl$', '.phy'), source_name, priority, is_enabled, is_dead FROM own WHERE k LIKE '%.mdl'),
      act AS (SELECT DISTINCT ON (k) virtual_path, k FROM (SELECT *, {_KEY} AS k FROM more WHERE virtual_path IS NOT NULL AND is_enabled AND NOT coalesce(is_dead, false)) ORDER BY k, priority DESC NULLS LAST, file_id),
      s AS (SELECT virtual_path AS src, 'maps/' || {_SCRIPT_STEM} || '_level_sounds.txt' AS t FROM act WHERE k LIKE '%.bsp' UNION SELECT virtual_path, 'scripts/soundscapes_' || {_SCRIPT_STEM} || '.txt' FROM act WHERE k LIKE '%.bsp'
      UNION SELECT virtual_path, regexp_replace(k, '[.]mdl$', '.phy') FROM act WHERE k LIKE '%.mdl') SELECT DISTINCT src, act.virtual_path AS dst FROM s JOIN act ON act.k = t""",
    "top3_per_group": "SELECT source_name, file_id, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY file_size DESC NULLS LAST, file_id) AS n FROM files WHERE source_name IS NOT NULL) WHERE n <= 3",
}


def _preset_sql(name: str) -> str | None:
    """SQL of a preset, put together from its own parts: order by its key and then by all its columns."""
    spec = PRESETS[name]
    src = spec["from"] if isinstance(spec["from"], str) else None
    if src is None or "ancestor_is_map" in str(spec) or src == "dependency_cycles":
        return None
    ctes = {"dep_conflicts": (_DEPC, "depc"), "hash_conflicts": (_HASHC, "hashc"), "implicit_deps": (_IMPL, "impl"), "mod_types": (_MODT, "modt"), "isolated": (_ISOL, "isol"),
            "cascade_overrides": (_CASC, "(SELECT virtual_path, nullif(s, chr(1)) AS active_source FROM casc)"), "global_scripts": ("gs AS (" + ORACLE["global_scripts"] + ")", "gs")}
    head, rel = ctes.get(src, ("one AS (SELECT 1)", src))
    alias = src
    cols = [c if isinstance(c, str) else c[-1] for c in spec["select"]]
    out = [c.split(".")[-1] for c in cols]
    joins = ""
    for j in spec.get("joins", [spec["join"]] if "join" in spec else []):
        a, b = j["on"]["eq"]
        joins += f" {j.get('type', 'inner').upper()} JOIN {j['with']} ON {a} = {'.'.join(b)}"
    where = _where(spec["where"]) if "where" in spec else "true"
    grouped = ""
    items = [f"{c} AS {o}" for c, o in zip(cols, out)]
    if "group_by" in spec:
        g = spec["group_by"]
        agg = {n: _agg_sql(a) for n, a in g["agg"].items()}
        items = [f"{agg.get(c, c)} AS {c}" for c in cols]
        grouped = " GROUP BY " + ", ".join(f"{alias}.{k}" for k in g["by"])
        if "having" in spec:
            op, (c, v) = next(iter(spec["having"].items()))
            grouped += f" HAVING {agg.get(c, c)} {OPS[op]} {v}"
    by = spec.get("order_by", {"by": cols[0]})
    at = by["by"].split(".")[-1]
    order = f"ORDER BY {at} {by.get('dir', 'asc')} NULLS LAST, " + ", ".join(f"{o} NULLS LAST" for o in out)
    limit = f" LIMIT {spec['limit']}" if "limit" in spec else ""
    return f"WITH {head} SELECT DISTINCT * FROM (SELECT {', '.join(items)} FROM {rel} {alias if rel != alias else ''}{joins} WHERE {where}{grouped} {order}{limit})"


OPS = {"eq": "=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def _agg_sql(a) -> str:
    if a == "count":
        return "count(*)"
    if isinstance(a, dict):
        return f"count(*) FILTER ({_where(a['count_where'])})"
    return f"sum({a[1]}::DOUBLE)"


def _where(p: dict) -> str:
    op, arg = next(iter(p.items()))
    if op in ("and", "or"):
        return "(" + f" {op.upper()} ".join(map(_where, arg)) + ")"
    if op == "not_exists_in":
        return f"{arg[0]} NOT IN (SELECT virtual_path FROM {arg[1]} WHERE virtual_path IS NOT NULL)"
    c = ".".join(arg[0]) if isinstance(arg[0], list) else arg[0]
    v = arg[1]
    if op == "like":
        return f"{c} GLOB '{v}'"
    if op == "ends_with":
        return f"ends_with({c}, '{v}')"
    if op == "not_contains":
        return f"NOT contains({c}, '{v}')"
    lit = ".".join(v) if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v).lower()
    return f"{c} IS NOT DISTINCT FROM {lit}" if op == "eq" else f"{c} IS DISTINCT FROM {lit}" if op == "neq" else f"{c} {OPS[op]} {lit}"


# All links, as the query and the preset read them. Paths within the cyclic links grow from their least node. They are cut at
# 16 links, which is no bound of the query: on the tables compared there are more than 50 cycles of so few links.
ORACLE["preset_dependency_cycles"] = f"""WITH RECURSIVE {_LINKS}, pairs AS (SELECT src AS a, dst AS b FROM links UNION SELECT a, dst FROM pairs JOIN links ON src = b),
  core AS (SELECT src, dst FROM links JOIN pairs ON a = dst AND b = src),
  paths AS (SELECT src AS first, dst AS last, [src] AS path FROM core WHERE src <= dst
    UNION ALL SELECT first, dst, list_append(path, last) FROM paths JOIN core ON src = last WHERE last <> first AND len(path) < 16 AND dst >= first AND NOT list_contains(path, last))
  SELECT array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM paths WHERE first = last ORDER BY len(path), path LIMIT 50"""
ORACLE["preset_top_impact"] = f"""WITH RECURSIVE {_RESOLVED}, pairs AS (SELECT src AS a, dst AS b FROM links UNION SELECT a, dst FROM pairs JOIN links ON src = b),
  n AS (SELECT a, count(*)::INT AS n FROM pairs WHERE a <> b GROUP BY a)
  SELECT virtual_path, source_name, coalesce(n, 0) AS impact_count FROM act LEFT JOIN n ON a = virtual_path ORDER BY impact_count DESC, virtual_path, source_name LIMIT 20"""
_BELOW_MAP = "below AS (SELECT src AS a, dst AS b FROM edges WHERE src LIKE '%.bsp' UNION SELECT a, dst FROM below JOIN edges ON src = b)"
_POLLUTION = """SELECT source_name, count(*) AS file_count FROM f WHERE ends_with(source_name, '.vpk') AND virtual_path IN (SELECT b FROM below WHERE a <> b) GROUP BY 1 HAVING count(*) >= 10 ORDER BY file_count DESC, source_name LIMIT 200"""
_DOWN = """down AS (SELECT dst AS id FROM edges WHERE src = 'maps/c1m1_hotel.bsp' UNION SELECT dst FROM edges JOIN down ON src = id)
  SELECT source_name, count(*) AS file_count FROM files WHERE virtual_path IN (SELECT id FROM down WHERE id <> 'maps/c1m1_hotel.bsp') AND coalesce(source_name NOT IN ('base', 'pak01_dir'), true) GROUP BY 1 ORDER BY file_count DESC, source_name NULLS LAST LIMIT 200"""
_ALL_EDGES = "edges AS (SELECT DISTINCT from_path AS src, to_path AS dst FROM dependencies WHERE from_path IS NOT NULL AND to_path IS NOT NULL"
ORACLE |= {f"preset_{n}": s for n in PRESETS if f"preset_{n}" not in ORACLE and (s := _preset_sql(n))}
ORACLE["preset_map_descendants"] = f"WITH RECURSIVE {_ALL_EDGES}), {_DOWN}"
ORACLE["preset_map_descendants_derived"] = f"WITH RECURSIVE {_ALL_EDGES} UNION SELECT 'maps/c1m1_hotel.bsp', from_path FROM dependencies WHERE dep_kind = 'level' AND from_path IS NOT NULL), {_DOWN}"
ORACLE["preset_cross_map_pollution"] = f"WITH RECURSIVE {_ALL_EDGES}), {_BELOW_MAP}, f AS (SELECT virtual_path, source_name FROM files) {_POLLUTION}"
ORACLE["preset_cross_map_pollution_derived"] = f"WITH RECURSIVE {_ALL_EDGES}), {_BELOW_MAP}, f AS (SELECT virtual_path, source_name || '.vpk' AS source_name FROM files) {_POLLUTION}"
_REFERENCE = """external_files AS (SELECT virtual_path, 'ref:own' AS ext_source_name, CASE WHEN ext_file_size % 3 = 0 THEN 90 ELSE 400 END AS ext_priority, CASE WHEN ext_file_size % 2 = 1 THEN '0' ELSE h END AS ext_file_hash, ext_file_size
  FROM (SELECT virtual_path, max(file_size) AS ext_file_size, min(file_hash) AS h FROM files WHERE source_name IN ('base', 'pak01_dir') AND virtual_path IS NOT NULL GROUP BY 1))"""


def _derived_sql() -> dict[str, str]:
    from .filequeries import ORACLE as FOUND

    heads = {**dict.fromkeys(("external_overlap", "external_overridden", "external_overrides"), _REFERENCE)}
    for n, kind in (("infected_model_usage", "x_population"), ("melee_weapon_chain", "x_melee")):
        heads[n] = f"found AS ({FOUND[kind]}), dependencies AS (SELECT src AS from_path, dst AS to_path FROM found)"
    return {f"preset_{n}_derived": _preset_sql(n).replace("WITH ", f"WITH {head}, ", 1) for n, head in heads.items()}


ORACLE |= _derived_sql()
