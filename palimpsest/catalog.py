"""The catalogue: named relations with declared schemas, and the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The relations and their columns in order.
SCHEMAS = {
    "files": "virtual_path string, source_name string, source_type string, priority int, file_hash string, file_size bigint, is_active boolean, is_dead boolean, is_redundant boolean, is_enabled boolean, is_disabled_addon boolean, is_pure_allowed boolean",
    "dependencies": "from_path string, to_path string, expected_source string",
    "addons": "addon_id string, name string, enabled boolean, priority int",
    "hash_conflicts": "virtual_path string, winner_source string, loser_source string, winner_hash string, loser_hash string, severity string",
    "dep_conflicts": "from_path string, to_path string, expected_source string, actual_source string",
    "isolated": "source_name string, dead_file_count int, example_paths array<string>",
    "impact": "virtual_path string, source_name string, impact_count int",
    "entry_points": "virtual_path string, source_type string",
    "external_files": "virtual_path string, ext_source_name string, ext_priority int, ext_file_hash string, ext_file_size bigint",
    "dependency_cycles": "cycle array<string>, length int",
    "cascade_overrides": "virtual_path string, chain_sources array<string>, chain_priorities array<int>, active_source string",
    "global_scripts": "virtual_path string, source_name string, source_type string",
    "implicit_deps": "dependent_addon string, provider_addon string, virtual_path string",
    "mod_types": "source_name string, mod_type string, total_files int, dead_files int, redundant_files int, active_files int, is_disabled boolean",
}


class Catalog:
    """Name to DataFrame. A declared relation that nobody filled is an empty table with its schema."""

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame] | None = None, edges: DataFrame | None = None):
        self.spark = spark
        self.relations = dict(relations or {})
        self._edges = edges

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: list[str] | None = None) -> Catalog:
        """The declared relations found as ``folder/<name>.parquet``, or the named ones."""
        out = cls(spark)
        for n in names or ["files", "dependencies", "addons", "entry_points", "external_files"]:
            out.relations[n] = spark.read.parquet(f"{folder}/{n}.parquet")
        return out

    def __contains__(self, name: str) -> bool:
        return name in self.relations or name in SCHEMAS

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.relations:
            return self.relations[name]
        if name in SCHEMAS:
            return self.spark.createDataFrame([], SCHEMAS[name])
        raise KeyError(f"Relation not found: {name}")

    def names(self) -> list[str]:
        return [*SCHEMAS, *(n for n in self.relations if n not in SCHEMAS)]

    def with_relation(self, name: str, df: DataFrame) -> Catalog:
        return Catalog(self.spark, {**self.relations, name: df}, self._edges)

    def with_edges(self, edges: DataFrame) -> Catalog:
        return Catalog(self.spark, self.relations, edges)

    @property
    def edges(self) -> DataFrame:
        """(src, dst); by default the rows of ``dependencies``."""
        if self._edges is not None:
            return self._edges
        return self["dependencies"].select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))

    def execute(self, query, tiebreak: list[str] | None = None) -> DataFrame:
        """Run a query of the JSON language: parse, validate, compile to one lazy DataFrame."""
        from .plans.compile import run

        return run(self, query, tiebreak)
