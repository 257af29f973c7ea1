"""Command line: a catalogue from relation tables or from a game's folder; queries, presets, analyses, reports, a shell."""

from __future__ import annotations

import argparse
import logging
import shutil
import sys
import traceback
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

from pyspark.sql import functions as F

from . import __version__
from .catalog import Catalog
from .operators.analyzers import assemble, extension_filter, map_conflicts, pure_allowed
from .plans.dsl import QueryParseError, QueryValidationError
from .plans.presets import PRESETS, resolve_spec
from .session import build_session
from .sinks.reports import FORMATS, SHOWN, WRITERS, dot, external_report, summary, write_parts, write_report
from .sources.settings import load_config, read_text, whitelist

# Endings that belong to each kind of check.
CHECKS = {
    "textures": {".vmt", ".vtf", ".tga", ".png", ".jpg"}, "models": {".mdl", ".vvd", ".vtx", ".phy", ".ani"}, "sounds": {".wav", ".mp3", ".ogg"}, "scripts": {".nut", ".nuc"},
    "configs": {".cfg", ".txt", ".res"}, "maps": {".bsp"}, "manifests": {"_manifest.txt"},
}
#: Presets that compare an external archive with the catalogue, by their short names.
REFERENCE = {"overrides": "external_overrides", "overridden": "external_overridden", "new_files": "external_new_files"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("--version", action="version", version=f"palimpsest {__version__}")
    src = p.add_argument_group("catalogue")
    src.add_argument("--data", help="folder with <relation>.parquet tables")
    src.add_argument("--game-root", help="folder with gameinfo.txt: read archives and folders, and analyse them")
    src.add_argument("--game", default="", help="game, for its manifests and the key of its encrypted scripts")
    src.add_argument("--config", help="TOML file with defaults for the flags below")
    src.add_argument("--entry-points", nargs="*", help="paths to start from, instead of those found")
    src.add_argument("--all-maps", action="store_true", help="start from every map as well")
    src.add_argument("--maps", nargs="*", help="start from these maps as well")
    src.add_argument("--cache-dir", help="folder that keeps files and links while the archives stay as they are")
    src.add_argument("--cache-strategy", choices=("mtime", "hash"), default="mtime")
    src.add_argument("--no-cache", action="store_true")
    src.add_argument("--clean-cache", action="store_true")
    src.add_argument("--ordinal", default="file_id", help="column that gives the order of insertion of --data records")
    run = p.add_argument_group("session")
    run.add_argument("--master", help="Spark master; leave it to spark-submit on a cluster")
    run.add_argument("--cpu", type=int, help="cores of a local session; 0 for all")
    run.add_argument("--memory", help="memory of a local session, such as 4g")
    run.add_argument("--io", type=int, help="files that are read at a time by a local session, at most; 0 for no limit")
    run.add_argument("--nolimit", action="store_true", help="all cores of this machine")
    run.add_argument("--log-level", choices=("DEBUG", "INFO", "WARNING", "ERROR"), default="WARNING")
    run.add_argument("--debug", action="store_true", help="show where an error came from")
    run.add_argument("--yes", "-y", action="store_true", help="accepted for scripts; nothing is ever asked")
    what = p.add_argument_group("what to do")
    what.add_argument("--analyze", action="store_true", help="derive all relations and print one number for each")
    what.add_argument("--impact", action="store_true", help="also count descendants of every file")
    for kind in CHECKS:
        what.add_argument(f"--check-{kind}", action="store_true", help=f"keep conflicts of {kind}")
    what.add_argument("--check-all", action="store_true", help="keep conflicts of all these kinds")
    what.add_argument("--compare-maps", nargs="+", metavar="ARCHIVE", help="compare maps with those in archives")
    what.add_argument("--external", metavar="ARCHIVE", help="compare an archive with the catalogue and write a report")
    what.add_argument("--vpk-priority", choices=("highest", "lowest"), default="highest", help="priority of that archive")
    what.add_argument("--ref-query", choices=("all", *REFERENCE), default="all", help="which comparison")
    what.add_argument("--sv-pure", metavar="WHITELIST", help="mark files that a whitelist does not allow")
    what.add_argument("--query", help="preset name, inline JSON or a JSON file")
    what.add_argument("--limit", type=int)
    what.add_argument("--offset", type=int)
    what.add_argument("--format", choices=FORMATS, default="table")
    what.add_argument("--page", type=int, default=0, help="lines between pauses on a terminal; 0 for none")
    what.add_argument("--report", choices=WRITERS)
    what.add_argument("--report-dir", "--output-dir", default=None)
    what.add_argument("--graphviz", metavar="FILE", help="write a drawing of the graph")
    what.add_argument("--list-presets", action="store_true")
    what.add_argument("--repl", action="store_true")
    return p


def pages(lines: Iterable[str], size: int, ask=input) -> Iterator[str]:
    """Lines with a pause after every ``size``; ``q`` ends them. No pauses for 0."""
    lines = iter(lines)
    while page := list(islice(lines, size or None)):
        yield from page
        if size and len(page) == size and ask("-- more, q to end -- ").strip().lower() == "q":
            return


def print_result(df, fmt: str, out=None, page: int = 0) -> None:
    out = out or sys.stdout
    rows = [r.asDict(recursive=True) for r in df.limit(SHOWN + 1).collect()]
    for line in pages(FORMATS[fmt](rows[:SHOWN]).split("\n"), page if out is sys.stdout and sys.stdout.isatty() else 0):
        print(line, file=out)
    if len(rows) > SHOWN:
        print(f"... first {SHOWN} rows", file=out)


def check_extensions(a: argparse.Namespace) -> set[str]:
    return {e for kind, ends in CHECKS.items() if a.check_all or getattr(a, f"check_{kind}") for e in ends}


def checked(catalog: Catalog, ends: set[str]) -> Catalog:
    """Conflicts of the given endings only, at either end of a link."""
    for name, columns in (("hash_conflicts", ["virtual_path"]), ("dep_conflicts", ["from_path", "to_path"])):
        catalog = catalog.with_relation(name, extension_filter(catalog[name], columns, ends))
    return catalog


def archive_file(named: str, root: str | None) -> str:
    tries = [Path(named), *([Path(root) / named] if root else []), Path.cwd() / named]
    found = next((t for t in tries if t.is_file()), None)
    if found is None:
        raise FileNotFoundError(f"no such archive: {named}")
    return str(found.resolve())


def _session(a: argparse.Namespace):
    conf = {"spark.driver.memory": a.memory} if a.memory else {}
    if a.io:  # files are opened by tasks; fewer tasks at a time open fewer files
        a.cpu = min(a.cpu or a.io, a.io)
    master = a.master or ("local[*]" if a.nolimit or a.cpu == 0 else f"local[{a.cpu}]" if a.cpu else None)
    return build_session(master=master, conf=conf)


def _catalog(spark, a: argparse.Namespace, config) -> tuple[Catalog, bool]:
    if not a.game_root:
        return Catalog.from_parquet(spark, a.data), False
    from .sources.game import build_catalog

    where = None if a.no_cache else a.cache_dir or config.cache_dir or None
    if where and a.clean_cache:
        shutil.rmtree(where, ignore_errors=True)
    limit = -1 if a.all_maps else max(config.max_maps, 0)
    catalog, engine = build_catalog(spark, a.game_root, a.game, config.addon_order == "descending", limit, a.entry_points, a.maps, a.impact or config.run_impact, where, a.cache_strategy)
    for name, error in engine.errors.items():
        print(f"analyzer {name} failed: {error}", file=sys.stderr)
    return catalog, True


def _run(spark, a: argparse.Namespace) -> None:
    from .sources.archives import reference_files, scan_paths

    config = load_config(a.config)
    folder = a.report_dir or config.report_dir
    catalog, analysed = _catalog(spark, a, config)
    ends = check_extensions(a)
    if (a.analyze or ends or a.compare_maps) and not analysed:
        catalog, _ = assemble(catalog, catalog["files"], a.ordinal, a.impact or config.run_impact)
    if ends:
        catalog = checked(catalog, ends)
    if a.compare_maps:
        paths = [archive_file(x, a.game_root) for x in a.compare_maps]
        there = scan_paths(spark, paths).select("virtual_path", F.regexp_extract("archive", r"([^/]*)$", 1).alias("ext_source_name"))
        ordinal = "ordinal" if analysed else a.ordinal
        found = map_conflicts(catalog["nodes"].join(there.select("virtual_path").distinct(), "virtual_path", "left_semi"), there, ordinal)
        catalog = catalog.with_relation("hash_conflicts", catalog["hash_conflicts"].unionByName(found))
    if a.sv_pure:
        patterns = whitelist(read_text(a.sv_pure))
        catalog = catalog.with_relation("files", pure_allowed(catalog["files"], patterns))
    if a.analyze or ends or a.compare_maps:
        for k, v in summary(catalog).items():
            print(f"{k}: {v}")
    if a.graphviz:
        print(write_parts(a.graphviz, [dot(catalog.edges)]))
    if a.external:
        path = archive_file(a.external, a.game_root)
        priority = 2000 if a.vpk_priority == "highest" else -100
        catalog = catalog.with_relation("external_files", reference_files(scan_paths(spark, [path]), Path(path).stem, priority))
        names = list(REFERENCE.values()) if a.ref_query == "all" else [REFERENCE[a.ref_query]]
        print(external_report(catalog, folder, Path(path), priority, names, lambda name, df: (print(f"\n{name}"), print_result(df, a.format, page=a.page))))
    if a.report:
        print(write_report(catalog, folder, a.report))
    if a.query:
        spec = dict(resolve_spec(a.query))
        spec |= {k: v for k, v in (("limit", a.limit), ("offset", a.offset)) if v is not None}
        print_result(catalog.execute(spec), a.format, page=a.page)
    if a.repl:
        from .repl import Shell

        Shell(catalog, ordinal=a.ordinal).loop()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.list_presets:
        print("\n".join(PRESETS))
        return 0
    if not a.data and not a.game_root:
        print("error: give --data or --game-root", file=sys.stderr)
        return 2
    logging.basicConfig(level="DEBUG" if a.debug else a.log_level)
    try:
        _run(_session(a), a)
    except (QueryParseError, QueryValidationError, FileNotFoundError, ValueError) as e:
        if a.debug:
            traceback.print_exc()
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
