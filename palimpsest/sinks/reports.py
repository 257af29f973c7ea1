"""Reports of a catalogue as JSON, CSV, text, HTML or a Graphviz drawing; tables as text.

Reports are whole. They go through the driver, one partition of a relation at a time, into one file; ``write_relations``
writes in parallel, as Parquet, CSV or JSON, what is too large to read in one.
"""

from __future__ import annotations

import csv
import html
import io
import json
import os
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from itertools import chain, islice
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import degrees, edge_set

MAIN = ["files", "hash_conflicts", "dep_conflicts", "isolated", "impact"]
SHOWN = 200
#: Names of relations with their rows.
Relations = Iterable[tuple[str, Iterable[dict]]]


def write_relations(catalog, folder: str, names: list[str] | None = None, fmt: str = "parquet") -> None:
    for n in names or [x for x in catalog.names() if x in catalog.relations]:
        df = catalog[n]
        if fmt == "csv":
            df = df.select([F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
        w = df.write.mode("overwrite")
        (w.option("header", True) if fmt == "csv" else w).format(fmt).save(f"{folder}/{n}")


def rows_of(df: DataFrame) -> Iterator[dict]:
    """All rows, a partition at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def to_dict(catalog, names: list[str] | None = None) -> dict[str, list[dict]]:
    """Whole relations in memory; ``write_report`` needs no such memory."""
    return {n: list(rows_of(catalog[n])) for n in names or catalog.names()}


def _json(v) -> str:
    return json.dumps(v, ensure_ascii=False, default=str)


def json_parts(data: Relations) -> Iterator[str]:
    yield "{"
    for i, (name, rows) in enumerate(data):
        yield f"{',' if i else ''}\n  {_json(name)}: ["
        for j, r in enumerate(rows):
            yield f"{',' if j else ''}\n    {_json(r)}"
        yield "\n  ]"
    yield "\n}\n"


def csv_parts(data: Relations) -> Iterator[str]:
    for name, rows in data:
        yield f"# {name}\n"
        for i, r in enumerate(rows):
            out = io.StringIO()
            w = csv.DictWriter(out, list(r), lineterminator="\n")
            if not i:
                w.writeheader()
            w.writerow(r)
            yield out.getvalue()
        yield "\n"


def json_report(data: dict[str, list[dict]]) -> str:
    return "".join(json_parts(data.items()))


def csv_report(data: dict[str, list[dict]]) -> str:
    return "".join(csv_parts(data.items()))


def table(rows: list[dict]) -> str:
    if not rows:
        return "Empty set."
    names = list(rows[0])
    cells = [[("NULL" if r[n] is None else str(r[n])) for n in names] for r in rows]
    widths = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda c: "|" + "|".join(f" {x:<{w}} " for x, w in zip(c, widths)) + "|"
    return "\n".join([rule, line(names), rule, *map(line, cells), rule])


def vertical(rows: list[dict]) -> str:
    if not rows:
        return "Empty set."
    w = max(map(len, rows[0]))
    return "\n".join(f"*** {i} ***\n" + "\n".join(f"{k:>{w}}: {v}" for k, v in r.items()) for i, r in enumerate(rows, 1))


FORMATS = {"table": table, "vertical": vertical, "json": lambda rows: json.dumps(rows, indent=2, ensure_ascii=False, default=str), "csv": lambda rows: csv_report({"result": rows}).split("\n", 1)[1].rstrip("\n") if rows else "Empty set."}


#: Rows of a text report that share one set of column widths.
PAGE = 1000


def text_parts(data: Relations) -> Iterator[str]:
    for name, rows in data:
        rows, n = iter(rows), 0
        yield f"{name}\n"
        while page := list(islice(rows, PAGE)):
            n += len(page)
            yield table(page) + "\n"
        yield f"({n})\n\n"


def html_parts(data: Relations) -> Iterator[str]:
    e = lambda v: html.escape("" if v is None else str(v))
    yield "<!doctype html><meta charset=utf-8><title>Report</title>\n"
    for name, rows in data:
        yield f"<h2>{e(name)}</h2><table>\n"
        n = 0
        for r in rows:
            if not n:
                yield "<tr>" + "".join(f"<th>{e(k)}</th>" for k in r) + "</tr>\n"
            n += 1
            yield "<tr>" + "".join(f"<td>{e(v)}</td>" for v in r.values()) + "</tr>\n"
        yield f"</table><p>({n})</p>\n"


def text_report(data: dict[str, list[dict]]) -> str:
    return "".join(text_parts(data.items()))


def html_report(data: dict[str, list[dict]]) -> str:
    return "".join(html_parts(data.items()))


WRITERS = {"json": json_parts, "csv": csv_parts, "text": text_parts, "html": html_parts}
SUFFIX = {"json": "json", "csv": "csv", "text": "txt", "html": "html"}


def write_parts(path: str | Path, parts: Iterable[str]) -> Path:
    """One file, whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".part")
    with open(part, "w", encoding="utf-8") as f:
        f.writelines(parts)
    os.replace(part, path)
    return path


def write_report(catalog, folder: str | Path, fmt: str = "json", names: list[str] | None = None) -> Path:
    """Write a report of whole relations with a time in its name."""
    if fmt not in WRITERS:
        raise ValueError(f"unknown report format: {fmt}")
    names = names or (catalog.names() if fmt == "json" else MAIN)
    path = Path(folder) / f"report_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}.{SUFFIX[fmt]}"
    return write_parts(path, WRITERS[fmt]((n, rows_of(catalog[n])) for n in names))


def external_report(catalog, folder: str | Path, archive: Path, priority: int, presets: list[str], show=lambda name, df: None) -> Path:
    """What an archive, loaded as external_files, would override, lose and add: each preset shown, all in one JSON file."""
    from ..plans.presets import PRESETS

    head = {"external_vpk": archive.name, "ref_name": archive.stem, "total_files": catalog["external_files"].count(), "priority": priority}
    found = {n: catalog.execute(PRESETS[n]) for n in presets}
    for n, df in found.items():
        show(n, df)
    lines = ["{\n"] + [f"  {_json(k)}: {_json(v)},\n" for k, v in head.items()]
    parts = json_parts((n, rows_of(df)) for n, df in found.items())
    next(parts)  # the opening brace is there
    return write_parts(Path(folder) / f"external_{archive.stem}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}.json", chain(lines, parts))


COLOURS = {"bsp": "lightblue", "vmt": "lightgreen", "vtf": "palegreen", "mdl": "orange", "nut": "gold", "wav": "plum", "pcf": "salmon", "txt": "lightgrey"}


def dot(edges: DataFrame, most: int = 2000) -> str:
    """The graph for Graphviz; beyond ``most`` nodes, those of highest degree and the links among them."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(most).select("id").persist()
    e = edge_set(edges)
    e = e.join(top.withColumnRenamed("id", "src"), "src", "left_semi").join(top.withColumnRenamed("id", "dst"), "dst", "left_semi")
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    nodes = sorted(r.id for r in top.collect())
    lines = [f"  {q(n)} [style=filled, fillcolor={COLOURS.get(n.rsplit('.', 1)[-1].lower(), 'white')}];" for n in nodes]
    lines += [f"  {q(r.src)} -> {q(r.dst)};" for r in e.orderBy("src", "dst").collect()]
    top.unpersist()
    return "digraph dependencies {\n" + "\n".join(lines) + "\n}\n"


def summary(catalog) -> dict[str, int]:
    """One number per analyzer, the file flags in one pass."""
    f = catalog["files"].agg(F.count_if(F.coalesce("is_redundant", F.lit(False))).alias("r"), F.count_if(F.coalesce("is_dead", F.lit(False))).alias("d")).first()
    return {
        "redundancy": f.r, "dead_files": f.d, "hash_conflicts": catalog["hash_conflicts"].count(), "dep_conflicts": catalog["dep_conflicts"].count(),
        "isolated": catalog["isolated"].filter("dead_file_count > 0").count(), "impact": catalog["impact"].count(),
    }
