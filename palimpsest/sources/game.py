"""From a game's folder to a catalogue: which archives and folders it mounts, their files, links, add-ons and entry points.

Planning is done on the driver and is as small as the list of archives. Indexes, contents and links are read by tasks; of
contents only the links leave a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.extract import addon_info, decode_text, extract_edges
from ..operators.analyzers import addon_dependency_conflicts, assemble, discover_entry_points, entry_type, live_entry_points, synthetic_edges
from ..operators.graph import edge_set
from ..operators.overlay import prioritise, resolve
from ..scratch import materialize
from ..sinks import cache
from . import archives
from .settings import addon_list, game_info, read_text

# Priorities of mounted folders and of disabled add-ons, tokens of folders without loose files.
FIRST_FOLDER, DISABLED = 100, -1000
UPDATES = ("game update", "gameupdate")


@dataclass
class Plan:
    """``archives``: path, name, priority, source_type, enabled, disabled, place. ``loose``: folder and priority."""

    archives: DataFrame
    loose: list[tuple[Path, int]]


def _resolved(root: Path, named: str) -> Path | None:
    """A search path: a place-holder, an absolute path, or a folder beside or in the game's own."""
    named = named.strip().replace("\\", "/")
    low = named.lower()
    if low.startswith("|gameinfo_path|"):
        tries = [root / named[len("|gameinfo_path|") :].lstrip("/")]
    elif low.startswith("|all_source_engine_paths|"):
        tries = [root.parent / named[len("|all_source_engine_paths|") :].lstrip("/")]
    else:
        tries = [Path(named)] if Path(named).is_absolute() else [root.parent / named, root / named]
    return next((t for t in tries if t.is_dir()), None)


def plan_sources(spark: SparkSession, root: str | Path, descending: bool = True) -> Plan:
    """What is mounted, in order: folders of the search paths with falling priority, then add-ons by their list and name."""
    root = Path(root).resolve()
    info = game_info(read_text(root / "gameinfo.txt"))
    mounted, loose = [], []
    for i, (token, named) in enumerate((k, v) for k, v in info.search_paths if k.startswith("game")):
        folder = _resolved(root, named)
        if folder is None:
            continue
        mounted += [(str(p), p.name, FIRST_FOLDER - i, "vpk", True, False) for p in sorted(folder.glob("*_dir.vpk"))]
        if token not in UPDATES and folder.resolve().is_relative_to(root):
            loose.append((folder.resolve(), FIRST_FOLDER - i))
    listed = root / "addonlist.txt"
    orders = {name: (enabled, place) for name, enabled, place in addon_list(read_text(listed))} if listed.is_file() else {}
    found = []
    for named in dict.fromkeys([v for k, v in info.search_paths if "addon" in k] + ["addons"]):
        folder = _resolved(root, named) or (root / named if (root / named).is_dir() else None)
        for place in (folder, folder / "workshop") if folder else ():
            found += [p for p in sorted(place.glob("*.vpk"))] if place.is_dir() else []
    off = root / "addons" / "disable"
    mounted += [(str(p), p.name, DISABLED, "addon", False, True) for p in sorted(off.glob("*.vpk"))] if off.is_dir() else []
    columns = "path string, name string, priority int, source_type string, enabled boolean, disabled boolean"
    plan = spark.createDataFrame(mounted, columns)
    if found:
        rows = [(str(p), p.name, "addon", orders.get(p.name, (True, None))[0], orders.get(p.name, (True, None))[1]) for p in found]
        added = prioritise(spark.createDataFrame(rows, "path string, name string, source_type string, enabled boolean, listed_order int"), descending)
        plan = plan.unionByName(added.select("path", "name", "priority", "source_type", "enabled", (~F.col("enabled")).alias("disabled")))
    order = {p: i for i, p in enumerate([*(m[0] for m in mounted), *map(str, found)])}
    places = spark.createDataFrame(list(order.items()), "path string, place int")
    return Plan(plan.join(places, "path"), loose)


def read_records(spark: SparkSession, plan: Plan) -> DataFrame:
    """The files of all sources, with ``ordinal`` in order of mounting and the path of the archive."""
    paths = [r.path for r in plan.archives.select("path").collect()]
    columns = ["ordinal", "virtual_path", "source_name", "source_type", "priority", "file_hash", "file_size", "is_enabled", "is_disabled_addon", "archive"]
    parts = []
    if paths:
        index = archives.scan_paths(spark, paths)
        joined = index.join(plan.archives.withColumnRenamed("path", "archive"), "archive")
        parts.append(
            joined.select(
                (F.call_function("shiftleft", (F.col("place") + len(plan.loose)).cast("long"), F.lit(32)) + F.col("at")).alias("ordinal"),
                "virtual_path", F.col("name").alias("source_name"), "source_type", "priority", F.coalesce("file_hash", F.lit("")).alias("file_hash"), "file_size",
                F.col("enabled").alias("is_enabled"), F.col("disabled").alias("is_disabled_addon"), "archive",
            )
        )
    for i, (folder, priority) in enumerate(plan.loose):
        own = archives.scan_folder(spark, str(folder), priority)
        at = F.call_function("shiftleft", F.lit(i).cast("long"), F.lit(32)) + F.pmod(F.xxhash64("virtual_path"), F.lit(1 << 32))
        parts.append(own.withColumn("ordinal", at).withColumn("is_disabled_addon", F.lit(False)).withColumn("archive", F.lit(None).cast("string")).withColumn("file_hash", F.lit("")).select(columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(columns)


def read_links(spark: SparkSession, plan: Plan, records: DataFrame, game: str = "") -> DataFrame:
    """(src, dst) of the active files: what their contents in archives name, and the synthetic links."""
    nodes = resolve(records, "ordinal")
    active = nodes.filter("is_winner").select("archive", F.col("virtual_path").alias("src"))
    paths = [r.path for r in plan.archives.select("path").collect()]
    out = synthetic_edges(nodes)
    if paths:
        named = extract_edges(archives.read_contents(spark, paths), game, keep=("archive",))
        out = named.join(active, ["archive", "src"]).select("src", "dst").unionByName(out)
    return edge_set(out)


def read_addons(spark: SparkSession, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(addons, needs) of the add-on archives: addon_id, name, enabled, priority; virtual_path, source_name, workshop_id."""
    own = plan.archives.filter("source_type = 'addon'")
    paths = [r.path for r in own.select("path").collect()]
    schema = "archive string, virtual_path string, title string, needs array<string>"

    def run(batches):
        import pandas as pd

        for b in batches:
            got = [addon_info(decode_text(c)) for c in b["content"]]
            yield pd.DataFrame({"archive": b["archive"], "virtual_path": b["virtual_path"], "title": [g["title"] for g in got], "needs": [g["dependencies"] for g in got]})

    if paths:
        told = archives.read_contents(spark, paths, r"(?i)addoninfo\.txt$").select("archive", "virtual_path", "content").mapInPandas(run, schema)
    else:
        told = spark.createDataFrame([], schema)
    told = told.join(own.withColumnRenamed("path", "archive"), "archive", "right")
    addons = told.groupBy(F.col("name").alias("addon_id")).agg(F.coalesce(F.min("title"), F.first("name")).alias("name"), F.max("enabled").alias("enabled"), F.max("priority").alias("priority"))
    return addons, told.select("virtual_path", F.col("name").alias("source_name"), F.explode("needs").alias("workshop_id"))


def build_catalog(
    spark: SparkSession, root: str | Path, game: str = "", descending: bool = True, max_maps: int = 0, entry_points: list[str] | None = None, maps: list[str] | None = None,
    with_impact: bool = False, cache_dir: str | None = None, strategy: str = "mtime",
):
    """(catalogue, engine) of a game's folder: every relation, analysed.

    ``entry_points`` replaces discovery, ``maps`` adds maps by name. With ``cache_dir``, files and links are taken from there
    as long as the archives are as they were, and are resolved anew; else they are read and put there.
    """
    plan = plan_sources(spark, root, descending)
    marks = archives.marks_of(spark, [r.path for r in plan.archives.select("path").collect()], strategy == "hash")
    if cache_dir and cache.is_valid(spark, cache_dir, marks, strategy):
        records, links = cache.load(spark, cache_dir)
    else:
        records = materialize(read_records(spark, plan), "records")
        links = materialize(read_links(spark, plan, records, game), "links")
        if cache_dir:
            cache.save(cache_dir, records, links, marks)
    nodes = resolve(records, "ordinal")
    addons, needs = read_addons(spark, plan)
    winners = nodes.filter("is_winner").select("virtual_path", "source_name")
    if entry_points is not None:
        entries = spark.createDataFrame([(p,) for p in entry_points], "virtual_path string").withColumn("source_type", entry_type(F.col("virtual_path")))
    else:
        listed = links.filter("lower(src) like '%manifest%.txt'").select(F.col("dst").alias("path"))
        entries = discover_entry_points(winners, max_maps, game, listed)
    if maps:
        more = spark.createDataFrame([(f"maps/{m}.bsp",) for m in maps], "virtual_path string").withColumn("source_type", F.lit("map"))
        entries = entries.unionByName(more).distinct()
    entries = materialize(live_entry_points(entries, links), "entries")
    sources = winners.select(F.col("virtual_path").alias("from_path"), F.col("source_name").alias("expected_source"))
    dependencies = links.select(F.col("src").alias("from_path"), F.col("dst").alias("to_path")).join(sources, "from_path", "left").select("from_path", "to_path", F.coalesce("expected_source", F.lit("")).alias("expected_source"))
    catalog = Catalog(spark, {"entry_points": entries, "dependencies": dependencies, "addons": materialize(addons, "addons")}, links)
    catalog, engine = assemble(catalog, records, "ordinal", with_impact)
    lost = addon_dependency_conflicts(needs, catalog["files"].select("source_name").union(addons.select("addon_id")))
    return catalog.with_relation("dep_conflicts", materialize(catalog["dep_conflicts"].unionByName(lost), "dep_conflicts")), engine


__all__ = ["Plan", "build_catalog", "plan_sources", "read_addons", "read_links", "read_records"]
