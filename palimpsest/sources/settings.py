"""Small text files read on the driver: add-on lists, game descriptions, whitelists, configuration, saved reports."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import SparkSession

from ..catalog import SCHEMAS, Catalog
from ..functions.extract import decode_text
from ..functions.keyvalues import leaves


def read_text(path: str | Path) -> str:
    return decode_text(Path(path).read_bytes())


def addon_list(text: str) -> list[tuple[str, bool, int]]:
    """(name, enabled, place) of each line ``"name" "1"``; a path counts by its last part; the first of a name holds."""
    out: dict[str, tuple[str, bool, int]] = {}
    for line in text.lstrip("﻿").splitlines():
        m = re.fullmatch(r'\s*"([^"]+)"\s+"([^"]*)"\s*', line)
        if m:
            name = re.split(r"[\\/]", m.group(1))[-1]
            out.setdefault(name, (name, m.group(2) == "1", len(out)))
    return list(out.values())


@dataclass
class GameInfo:
    """Where a game says its contents lie."""

    title: str | None
    search_paths: list[tuple[str, str]]

    @property
    def game_dirs(self) -> list[str]:
        return [v for k, v in self.search_paths if k.startswith("game")]

    @property
    def addon_roots(self) -> list[str]:
        return [v for k, v in self.search_paths if "addon" in k or "addon" in v.lower()]


def game_info(text: str) -> GameInfo:
    flat = leaves(text)
    return GameInfo(next((v for p, v in flat if p[-1] == "game" and len(p) == 2), None), [(p[-1], v) for p, v in flat if "searchpaths" in p[:-1]])


def whitelist(text: str) -> list[str]:
    """Patterns of a whitelist, comments dropped; ``...`` at the end of a folder stands for all below it."""
    out = []
    for line in text.splitlines():
        line = re.split(r"//|#", line)[0].strip().strip('"')
        if line and line not in "{}" and not line.lower().startswith("whitelist"):
            out.append(line.split('"')[0].strip().replace("...", "**"))
    return out


@dataclass
class Config:
    """Settings with their defaults; unknown keys of a file are ignored."""

    game_dir: str = ""
    cache_dir: str = ""
    report_format: str = "json"
    report_dir: str = "."
    run_impact: bool = False
    max_maps: int = 0
    addon_order: str = "descending"
    extra: dict = field(default_factory=dict)


def load_config(path: str | Path | None) -> Config:
    c = Config()
    if path and Path(path).is_file():
        flat: dict = {}
        for k, v in tomllib.loads(Path(path).read_text(encoding="utf-8")).items():
            flat |= v if isinstance(v, dict) else {k: v}
        for f in fields(Config):
            if f.name in flat:
                setattr(c, f.name, flat[f.name])
    return c


def load_report(spark: SparkSession, path: str | Path) -> Catalog:
    """A catalogue from a saved JSON report; relations that do not fit their schema are left out."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    c = Catalog(spark)
    for name, rows in data.items():
        if name in SCHEMAS and isinstance(rows, list):
            try:
                c.relations[name] = spark.createDataFrame([tuple(r.get(x.split()[0]) for x in _columns(name)) for r in rows], SCHEMAS[name])
            except Exception:  # noqa: BLE001 - a relation of another shape
                continue
    return c


def _columns(name: str) -> list[str]:
    return [x.strip() for x in SCHEMAS[name].split(", ")]
