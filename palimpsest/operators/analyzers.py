"""Analyzers: composite operators over the catalogue's files and dependencies. All are pure DataFrame transformations."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from . import graph as G
from .overlay import active, overlay_key, resolve
from .predicates import glob_regex

log = logging.getLogger(__name__)

#: Stands for the source of a file that is not there.
MISSING = "MISSING"


def mark_dead(files: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """``files`` with is_dead set on active files that are neither an entry point nor reachable from one.

    Without entry points nothing is judged. Paths are compared as they are written.
    """
    seeds = entry_points.select(F.col("virtual_path").alias("id")).filter("id is not null").distinct()
    if seeds.isEmpty():
        return files
    live = G.reachable(edges, seeds).union(seeds).distinct().withColumn("__live", F.lit(True))
    out = files.join(live, files["virtual_path"] == live["id"], "left").drop("id")
    dead = F.coalesce("is_active", F.lit(False)) & F.col("__live").isNull()
    return out.withColumn("is_dead", F.when(dead, True).otherwise(F.coalesce("is_dead", F.lit(False)))).drop("__live").select(files.columns)


def hash_conflicts(nodes: DataFrame, ordinal: str) -> DataFrame:
    """(virtual_path, winner_source, loser_source, winner_hash, loser_hash, severity) where enabled records of a path differ.

    Only enabled records with a hash count; the winner is the one of highest priority, then first. severity is ``info``
    if either source is a base package (``base`` or a name ending in ``_dir`` before its suffix).
    """
    n = nodes.filter("coalesce(is_enabled, false) and file_hash <> '' and virtual_path is not null")
    top = n.groupBy("virtual_path").agg(F.max(F.struct("priority", (-F.col(ordinal)).alias("o"), "source_name", "file_hash")).alias("w"))
    both = n.join(top, "virtual_path").filter(F.col("file_hash") != F.col("w.file_hash"))
    stock = lambda c: F.coalesce(c.rlike(r"(?:^base|_dir)(?:\.[^.]*)?$"), F.lit(False))
    return both.select(
        "virtual_path", F.col("w.source_name").alias("winner_source"), F.col("source_name").alias("loser_source"), F.col("w.file_hash").alias("winner_hash"), F.col("file_hash").alias("loser_hash"),
        F.when(stock(F.col("w.source_name")) | stock(F.col("source_name")), "info").otherwise("warning").alias("severity"),
    )


def dependency_conflicts(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_path, to_path, expected_source, actual_source) of links of active files into another source or nowhere."""
    src = files.filter("is_winner").select(F.col("virtual_path").alias("src"), F.col("source_name").alias("expected_source"))
    got = active(files).select(F.col("path_key").alias("k"), F.col("source_name").alias("actual"), F.lit(True).alias("there"))
    links = G.edge_set(edges).join(src, "src").withColumn("k", overlay_key(F.col("dst"))).join(got, "k", "left")
    wrong = F.col("there").isNull() | ~F.col("actual").eqNullSafe(F.col("expected_source"))
    return links.filter(wrong).select(F.col("src").alias("from_path"), F.col("dst").alias("to_path"), "expected_source", F.when(F.col("there").isNull(), MISSING).otherwise(F.col("actual")).alias("actual_source"))


def isolated_packages(files: DataFrame, examples: int = 3) -> DataFrame:
    """(source_name, dead_file_count, example_paths): dead or redundant files per source, all sources, some least paths."""
    bad = F.coalesce("is_dead", F.lit(False)) | F.coalesce("is_redundant", F.lit(False))
    counts = files.groupBy("source_name").agg(F.count_if(bad).cast("int").alias("dead_file_count"))
    ranked = files.filter(bad).select("source_name", "virtual_path").distinct()
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("source_name").orderBy("virtual_path"))).filter(F.col("n") <= examples)
    some = ranked.groupBy("source_name").agg(F.sort_array(F.collect_list("virtual_path")).alias("example_paths"))
    out = counts.join(some, counts["source_name"].eqNullSafe(some["source_name"]), "left")
    return out.select(counts["source_name"], "dead_file_count", F.coalesce("example_paths", F.array().cast("array<string>")).alias("example_paths"))


def impact(files: DataFrame, edges: DataFrame, top: int | None = 20) -> DataFrame:
    """(virtual_path, source_name, impact_count) of the active files with most strict descendants; of all for None."""
    counts = G.impact_counts(edges).filter("impact_count > 0")
    act = files.filter("is_winner").select("virtual_path", "source_name")
    out = act.join(counts, act["virtual_path"] == counts["id"], "left").select("virtual_path", "source_name", F.coalesce("impact_count", F.lit(0)).cast("int").alias("impact_count"))
    return out if top is None else out.orderBy(F.desc("impact_count"), "virtual_path").limit(top)


def cascade_overrides(files: DataFrame, ordinal: str, least: int = 3) -> DataFrame:
    """(virtual_path, chain_sources, chain_priorities, active_source) of paths with at least ``least`` records.

    The chain runs from high to low priority, then in order of insertion; its first is the active source even if disabled.
    """
    many = files.groupBy("virtual_path").count().filter((F.col("count") >= least) & F.col("virtual_path").isNotNull()).select("virtual_path")
    chain = F.sort_array(F.collect_list(F.struct((-F.coalesce("priority", F.lit(-(2**31) + 1))).alias("p"), F.col(ordinal).alias("o"), F.col("priority").alias("priority"), F.col("source_name").alias("source"))))
    out = files.join(many, "virtual_path", "left_semi").groupBy("virtual_path").agg(chain.alias("c"))
    return out.select("virtual_path", F.col("c.source").alias("chain_sources"), F.col("c.priority").alias("chain_priorities"), F.col("c")[0]["source"].alias("active_source"))


def global_scripts(files: DataFrame) -> DataFrame:
    """(virtual_path, source_name, source_type) of scripts outside the folder of maps."""
    return files.filter("virtual_path like '%.nut' and not contains(virtual_path, 'maps/')").select("virtual_path", "source_name", "source_type")


def implicit_dependencies(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(dependent_addon, provider_addon, virtual_path) of links between active files of different sources, each once."""
    act = files.filter("is_winner").select("virtual_path", "source_name")
    a = act.select(F.col("virtual_path").alias("src"), F.col("source_name").alias("dependent_addon"))
    b = act.select(F.col("virtual_path").alias("dst"), F.col("source_name").alias("provider_addon"))
    return G.edge_set(edges).join(a, "src").join(b, "dst").filter("dependent_addon <> provider_addon").select("dependent_addon", "provider_addon", F.col("dst").alias("virtual_path")).distinct()


def classify_sources(files: DataFrame, base_paths: DataFrame | None = None) -> DataFrame:
    """(source_name, mod_type, counts, is_disabled): what kind of package each source is.

    disabled, map (has .bsp), script (has .nut), replacement (more than half of its paths are in ``base_paths``,
    virtual_path), fragment (under ten files), else resource_pack; the first that fits.
    """
    f = files.withColumn("__b", F.lit(False))
    if base_paths is not None:
        b = base_paths.select(F.col("virtual_path").alias("__p")).distinct().withColumn("__hit", F.lit(True))
        f = files.join(b, files["virtual_path"] == b["__p"], "left").withColumn("__b", F.coalesce("__hit", F.lit(False)))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    g = f.groupBy("source_name").agg(
        F.count(F.lit(1)).cast("int").alias("total_files"),
        F.count_if(flag("is_dead")).cast("int").alias("dead_files"),
        F.count_if(flag("is_redundant")).cast("int").alias("redundant_files"),
        F.count_if(flag("is_active") & ~flag("is_dead")).cast("int").alias("active_files"),
        F.max(flag("is_disabled_addon")).alias("is_disabled"),
        F.max(F.coalesce(F.col("virtual_path").endswith(".bsp"), F.lit(False))).alias("__map"),
        F.max(F.coalesce(F.col("virtual_path").endswith(".nut"), F.lit(False))).alias("__script"),
        F.countDistinct(F.when(F.col("__b"), F.col("virtual_path"))).alias("__over"),
        F.countDistinct("virtual_path").alias("__paths"),
    )
    kind = (
        F.when(F.col("is_disabled"), "disabled").when(F.col("__map"), "map").when(F.col("__script"), "script")
        .when(F.col("__over") * 2 > F.col("__paths"), "replacement").when(F.col("total_files") < 10, "fragment").otherwise("resource_pack")
    )
    return g.select("source_name", kind.alias("mod_type"), "total_files", "dead_files", "redundant_files", "active_files", "is_disabled")


def addon_dependency_conflicts(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Declared needs (virtual_path, source_name, workshop_id) for which there is no add-on, as rows of dep_conflicts."""
    have = files.select(F.col("source_name").alias("k")).distinct()
    lost = declared.join(have, declared["workshop_id"] == have["k"], "left_anti")
    return lost.select(F.col("virtual_path").alias("from_path"), F.col("workshop_id").alias("to_path"), F.col("source_name").alias("expected_source"), F.lit(MISSING).alias("actual_source"))


def map_conflicts(files: DataFrame, external: DataFrame, ordinal: str) -> DataFrame:
    """Maps held by two or more sources with differing hashes: the winner against every other holder."""
    a = files.filter("virtual_path like '%.bsp'").select("virtual_path", "source_name", "priority", "file_hash", F.col(ordinal).cast("long").alias("o"))
    b = external.filter("virtual_path like '%.bsp'").select("virtual_path", F.col("ext_source_name").alias("source_name"), F.lit(-1).alias("priority"), F.lit(None).cast("string").alias("file_hash"), F.lit(2**62).alias("o"))
    n = a.unionByName(b)
    top = n.groupBy("virtual_path").agg(F.countDistinct("source_name").alias("s"), F.countDistinct("file_hash").alias("h"), F.max(F.struct("priority", (-F.col("o")).alias("o"), "source_name", "file_hash")).alias("w"))
    both = n.join(top.filter("s >= 2 and h > 1"), "virtual_path").filter(F.col("o") != -F.col("w.o"))
    return both.select("virtual_path", F.col("w.source_name").alias("winner_source"), F.col("source_name").alias("loser_source"), F.col("w.file_hash").alias("winner_hash"), F.col("file_hash").alias("loser_hash"), F.lit("warning").alias("severity"))


def pure_allowed(files: DataFrame, patterns: list[str]) -> DataFrame:
    """``files`` with is_pure_allowed: whether the path matches a whitelist glob; ``**`` allows everything."""
    ok = F.lit(False)
    for p in patterns:
        ok = ok | (F.lit(True) if p == "**" else F.coalesce(F.lower("virtual_path").rlike(glob_regex(p.lower().replace("**", "*"))), F.lit(False)))
    return files.withColumn("is_pure_allowed", ok)


def entry_type(path: Column) -> Column:
    """Kind of an entry point by its path; the first that fits."""
    p = F.lower(path)
    return (
        F.when(p.contains("manifest"), "manifest")
        .when(p.endswith(".bsp"), "map")
        .when(p.startswith("missions/"), "mission")
        .when(p.contains("soundscapes_") & p.endswith(".txt"), "soundscape")
        .when(p.endswith("_level_sounds.txt"), "level_sounds")
        .when(p.endswith("population.txt"), "population")
        .when(p.endswith(".nut") | p.startswith("scripts/vscripts/") | p.isin("cfg/config.cfg", "cfg/autoexec.cfg", "gameinfo.txt", "scripts/sound_prefetch.txt"), "script")
        .otherwise("user_specified")
    )


# What the engine loads by itself, for all games and for single ones.
AUTO_MANIFESTS = ("scripts/soundscapes_manifest.txt", "scripts/game_sounds_manifest.txt", "particles/particles_manifest.txt")
SCRIPT_ENTRIES = ("cfg/config.cfg", "cfg/autoexec.cfg", "scripts/population.txt", "scripts/sound_prefetch.txt")
GAME_MANIFESTS = {
    "l4d2": ("scripts/melee/melee_manifest.txt", "scripts/bonus_maps_manifest.txt", "scripts/sprays_manifest.txt"),
    "l4d1": ("scripts/melee/melee_manifest.txt",),
    "tf2": ("scripts/hudanimations_manifest.txt",),
}


def known_entry_points(game: str) -> list[str]:
    """Paths that a game is known to load, whether they are there or not; none without a game."""
    return [*AUTO_MANIFESTS, *GAME_MANIFESTS.get(game.lower().strip(), ()), *SCRIPT_ENTRIES, "maps/*.bsp"] if game else []


def discover_entry_points(files: DataFrame, max_maps: int = 0, game: str = "", listed: DataFrame | None = None) -> DataFrame:
    """(virtual_path, source_type) of the active files that the engine loads by itself.

    The manifests of all games and of ``game``; files that manifests name (``listed``: path); maps (none by default, all
    for -1, else the first by path); configurations and script entries; all scripts below scripts/vscripts; the game's
    description; the sound files of every map; missions. Paths are compared in lower case with forward slashes. Without
    an is_active column all files count as active.
    """
    f = files.filter(F.coalesce("is_active", F.lit(False))) if "is_active" in files.columns else files
    p = f.select("virtual_path").filter("virtual_path is not null").distinct().withColumn("k", F.lower(F.translate("virtual_path", "\\", "/")))
    maps = p.filter("k like '%.bsp'")
    taken = maps.orderBy("k", "virtual_path").limit(max_maps) if max_maps >= 0 else maps
    stem = F.regexp_extract("k", r"([^/]*)\.bsp$", 1)
    wanted = maps.select(F.explode(F.array(F.concat(F.lit("maps/"), stem, F.lit("_level_sounds.txt")), F.concat(F.lit("scripts/soundscapes_"), stem, F.lit(".txt")))).alias("k"))
    if listed is not None:
        wanted = wanted.union(listed.select(F.lower(F.translate("path", "\\", "/"))).filter("path is not null"))
    fixed = [*AUTO_MANIFESTS, *GAME_MANIFESTS.get(game.lower().strip(), ()), *SCRIPT_ENTRIES, "gameinfo.txt"]
    rest = p.filter(F.col("k").isin(fixed) | F.expr("(k like 'scripts/vscripts/%' and k like '%.nut') or (k like 'missions/%' and k like '%.txt')"))
    found = taken.union(rest).union(p.join(wanted.distinct(), "k", "left_semi").select("virtual_path", "k")).select("virtual_path").distinct()
    return found.withColumn("source_type", entry_type(F.col("virtual_path")))


def live_entry_points(entry_points: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry points from which at least one link goes out."""
    out = edges.select(F.col("src").alias("virtual_path")).filter("virtual_path is not null").distinct()
    return entry_points.join(out, "virtual_path", "left_semi").select(entry_points.columns)


def synthetic_edges(files: DataFrame) -> DataFrame:
    """Links no content tells: a map to its sound files, a model to its physics, where the targets are active."""
    act = files.filter("is_winner").select("virtual_path", overlay_key(F.col("virtual_path")).alias("k"))
    stem = F.regexp_extract("k", r"([^/]*)\.bsp$", 1)
    maps = act.filter("k like '%.bsp'").select(F.col("virtual_path").alias("src"), F.explode(F.array(F.concat(F.lit("maps/"), stem, F.lit("_level_sounds.txt")), F.concat(F.lit("scripts/soundscapes_"), stem, F.lit(".txt")))).alias("k"))
    models = act.filter("k like '%.mdl'").select(F.col("virtual_path").alias("src"), F.regexp_replace("k", r"\.mdl$", ".phy").alias("k"))
    return maps.unionByName(models).join(act.select("k", F.col("virtual_path").alias("dst")), "k").select("src", "dst").distinct()


def extension_filter(rows: DataFrame, columns: list[str], extensions: set[str]) -> DataFrame:
    """Rows of which one of the path columns ends in one of the extensions, in any case."""
    ok = F.lit(False)
    for c in columns:
        ok = ok | F.coalesce(F.lower(F.regexp_extract(c, r"(\.[^./\\]*)$", 1)).isin([e.lower() for e in extensions]), F.lit(False))
    return rows.filter(ok)


class Engine:
    """Runs analyzers in order, each a function of the catalogue that returns relations. One failure is logged and kept in
    ``errors``; the others run on."""

    def __init__(self, steps: list[tuple[str, Callable]]):
        self.steps, self.errors = steps, {}
        self.before: list[Callable[[str], None]] = []
        self.after: list[Callable[[str], None]] = []

    def run(self, catalog):
        for name, step in self.steps:
            for hook in self.before:
                hook(name)
            try:
                # Written down, so that a failure of the action, too, is this analyzer's and no later one's.
                for relation, df in [(r, materialize(df, r)) for r, df in step(catalog).items()]:
                    catalog = catalog.with_relation(relation, df)
            except Exception as e:  # noqa: BLE001
                log.error("analyzer %s failed: %s", name, e)
                self.errors[name] = e
            for hook in self.after:
                hook(name)
        return catalog


def default_steps(ordinal: str, with_impact: bool = False) -> list[tuple[str, Callable]]:
    """The analyzers over a catalogue whose ``nodes`` relation holds the resolved records."""

    def nodes(c):
        return c["nodes"]

    steps: list[tuple[str, Callable]] = [
        ("redundancy", lambda c: {"files": file_rows(nodes(c))}),
        ("dead_files", lambda c: {"files": mark_dead(c["files"], c.edges, c["entry_points"])}),
        ("hash_conflicts", lambda c: {"hash_conflicts": hash_conflicts(nodes(c), ordinal)}),
        ("dep_conflicts", lambda c: {"dep_conflicts": dependency_conflicts(nodes(c), c.edges)}),
        ("isolated", lambda c: {"isolated": isolated_packages(c["files"])}),
        ("cycles", lambda c: {"dependency_cycles": G.elementary_cycles(c.edges)}),
        ("cascade", lambda c: {"cascade_overrides": cascade_overrides(nodes(c), ordinal)}),
        ("global_scripts", lambda c: {"global_scripts": global_scripts(c["files"])}),
        ("implicit", lambda c: {"implicit_deps": implicit_dependencies(nodes(c), c.edges)}),
        ("mod_types", lambda c: {"mod_types": classify_sources(c["files"], c["files"].filter("source_name = 'base' and is_active").select("virtual_path"))}),
    ]
    if with_impact:
        steps.append(("impact", lambda c: {"impact": impact(nodes(c), c.edges)}))
    return steps


FILE_COLUMNS = ["virtual_path", "source_name", "source_type", "priority", "file_hash", "file_size", "is_active", "is_dead", "is_redundant", "is_enabled", "is_disabled_addon", "is_pure_allowed"]


def file_rows(resolved: DataFrame) -> DataFrame:
    """Resolved records as rows of ``files``: active is what is not redundant."""
    out = resolved.withColumn("is_active", ~F.coalesce("is_redundant", F.lit(False)))
    for c, default in (("is_dead", False), ("is_disabled_addon", False), ("is_pure_allowed", True)):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(default))
    return out.select(FILE_COLUMNS)


def assemble(catalog, records: DataFrame, ordinal: str, with_impact: bool = False):
    """Resolve the overlay of ``records`` and run all analyzers: a catalogue with every relation, and the engine."""
    resolved = resolve(records, ordinal)
    engine = Engine(default_steps(ordinal, with_impact))
    return engine.run(catalog.with_relation("nodes", resolved)), engine
