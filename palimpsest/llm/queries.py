"""Registered queries of the text problems (1, 3, 4, 7, 8, 9) and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pathkey import is_blank, path_key
from ..plans.sqlparts import sql_key, sql_nonblank
from . import collapse as dup
from . import garbled, mixing, sentences, tokens, truth


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1. Garbled text from wrong character encoding ------------------------------------------------------------------


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, m = table(spark, sf_dir, "addons"), table(spark, sf_dir, "addon_manifests")
    a = a.select(F.lit("addons").alias("field"), F.col("addon_row").alias("row_key"), F.col("addon_id").alias("source"), "name")
    return a.unionByName(m.select(F.lit("addon_manifests").alias("field"), F.col("manifest_row").alias("row_key"), F.col("addon_id").alias("source"), "name"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.find_garbled(_names(spark, sf_dir)).select(F.col("field").alias("tab"), "row_key")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The found rows with the name as it was written, null where it can no longer be known."""
    return garbled.find_garbled(_names(spark, sf_dir)).select(F.col("field").alias("tab"), "row_key", "name", "restored", "chain")


# --- 3. Duplicates hidden by formatting -----------------------------------------------------------------------------

TABS = ("files", "dependencies", "catalog_lines")
FILE_VALUES = ("source_name", "source_type", "priority", "file_hash", "file_size", "is_active", "is_dead", "is_redundant", "is_enabled", "is_disabled_addon", "is_pure_allowed")


def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, id) of the three tables as one: the key begins with the table, the id ends with it."""
    f, d, c = (table(spark, sf_dir, t) for t in TABS)
    path = path_key(F.col("virtual_path"))
    f = f.select(F.when(path.isNotNull(), F.concat(F.lit("0"), dup.canonical(path, *[F.col(x) for x in FILE_VALUES]))).alias("key"), (F.col("file_id") * 3).alias("id"))
    to = path_key(F.col("to_path"))
    d = d.select(F.when(to.isNotNull(), F.concat(F.lit("1"), dup.canonical(to, F.col("from_path"), F.col("expected_source"), F.col("dep_kind")))).alias("key"), (F.col("dep_id") * 3 + 1).alias("id"))
    values = dup.line_fields(F.col("raw_line"))
    c = c.select((F.col("line_id") * 3 + 2).alias("id"), *[v.alias(n) for n, v in values.items()]).filter("coalesce(virtual_path, '') <> ''")
    c = c.select(F.concat(F.lit("2"), dup.canonical(*[F.col(n) for n in dup.LINE_FIELDS])).alias("key"), "id")
    return f.unionByName(d).unionByName(c)


def _tab(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TABS)), (F.pmod(c, F.lit(3)) + 1).cast("int"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies, _ = dup.collapse(canonical_records(spark, sf_dir))
    return copies.select(_tab(F.col("first_id")).alias("tab"), F.floor(F.col("first_id") / 3).alias("first_id"), F.floor(F.col("copy_id") / 3).alias("copy_id"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups = dup.collapse(canonical_records(spark, sf_dir))
    return groups.select(_tab(F.col("first_id")).alias("tab"), F.floor(F.col("first_id") / 3).alias("first_id"), "n_copies")


# --- 4. Best representative of each duplicate group -----------------------------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files")
    return truth.ranked_representatives(
        f.select(
            path_key(F.col("virtual_path")).alias("grp"),
            F.col("file_id").alias("id"),
            F.col("source_name").alias("src"),
            F.struct("priority", "seen_at", (-F.col("file_id")).alias("order")).alias("rank"),
            F.col("is_enabled").alias("eligible"),
            (~is_blank(F.col("source_name"))).alias("named"),
        )
    )


SURVIVOR_FIELDS = ["source_type", "priority", "file_hash", "file_size", "is_enabled"]


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").withColumn("path", path_key(F.col("virtual_path")))
    return truth.merge_groups(f, "path", "source_name", SURVIVOR_FIELDS)[0]


# --- 7. Encoding with a public tokenizer ----------------------------------------------------------------------------


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids are not their text: none."""
    ids = p7_ids(spark, sf_dir)
    back = ids.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return back.filter(tokens.decode_ids(F.col("ids")) != F.encode(F.coalesce("text", F.lit("")), "UTF-8")).select("doc_id")


# --- 8. Mixing sources to target weights ----------------------------------------------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    counts = tokens.encode_documents(docs, "doc_id", "text", counts_only=True)
    sized = docs.select("doc_id", "source").join(counts, "doc_id").select(F.col("doc_id").alias("key"), "source", F.col("n_tokens").alias("size"))
    return mixing.mix(tokens.materialize(sized, "sized"), table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].select(F.col("key").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copy_no")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


# --- 9. Sentence boundaries across languages and scripts ------------------------------------------------------------


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p1_restored": p1_restored,
    "p3_found": p3_found, "p3_groups": p3_groups,
    "p4_found": p4_found, "p4_survivors": p4_survivors,
    "p7_ids": p7_ids, "p7_round_trip": p7_round_trip,
    "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found,
}


def _sql_field(name: str) -> str:
    head = dup.FIELD_HEAD.replace("'", "''")
    names = "|".join(dup.LINE_FIELDS)
    text = r"""CASE WHEN regexp_matches(raw_line, '"(virtual_path|source_name|priority|file_hash)"', 'i')
      THEN regexp_replace(replace(raw_line, '\\', '/'), '\\[ntrbf"/]', ' ', 'g') ELSE raw_line END"""
    return f"regexp_extract({text}, '{head.format(name)}(.*?)(?:{head.format(names)}|$)', 1, 'is')"


_VALUES = ", ".join(FILE_VALUES)
_RECORDS = f"""recs AS (
  SELECT 'files' AS tab, file_id AS id, {sql_key('virtual_path')} AS path, to_json([{', '.join(f"coalesce({v}::VARCHAR, chr(1))" for v in FILE_VALUES)}]) AS rest FROM files
  UNION ALL SELECT 'dependencies', dep_id, {sql_key('to_path')}, to_json([from_path, coalesce(expected_source, chr(1)), dep_kind]) FROM dependencies
  UNION ALL SELECT 'catalog_lines', line_id, {sql_key(_sql_field('virtual_path'))}, to_json([{', '.join(f"coalesce({sql_key(_sql_field(v))}, chr(1))" for v in dup.LINE_FIELDS[1:])}]) FROM catalog_lines),
grouped AS (SELECT tab, id, min(id) OVER (PARTITION BY tab, path, rest) AS first_id FROM recs WHERE path IS NOT NULL AND NOT (tab = 'catalog_lines' AND path = ''))"""

_ORDER = "ORDER BY priority DESC NULLS LAST, seen_at DESC NULLS LAST, file_id"
ORACLE = {
    "p3_found": f"WITH {_RECORDS} SELECT tab, first_id, id AS copy_id FROM grouped WHERE id <> first_id",
    "p3_groups": f"WITH {_RECORDS} SELECT tab, first_id, count(*) AS n_copies FROM grouped GROUP BY ALL HAVING count(*) > 1",
    "p4_found": f"""WITH recs AS (SELECT *, {sql_key('virtual_path')} AS path, {sql_nonblank('source_name')} IS TRUE AS named FROM files),
      groups AS (SELECT path, min(file_id) AS group_id FROM recs WHERE path IS NOT NULL GROUP BY path HAVING count(*) >= 2 AND bool_or(is_enabled)),
      wins AS (SELECT path, first(file_id {_ORDER}) AS win_id, first(file_id {_ORDER}) FILTER (named) AS name_id FROM recs WHERE is_enabled GROUP BY path)
      SELECT group_id, win_id, coalesce(name_id, 0) AS name_id FROM groups JOIN wins USING (path)""",
    "p7_round_trip": "SELECT doc_id FROM documents WHERE false",
}
