"""Archive indexes and folders as rows of files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = 0x55AA1234
ENTRY = struct.Struct("<IHHIIH")
INDEX_SCHEMA = "archive string, virtual_path string, file_size long, file_hash string, at int"
#: Number of the archive of files that lie in the directory's own file.
OWN = 0x7FFF
#: Files whose contents name others.
NAMING = r"(?i)\.(?:vmt|mdl|nut|txt|pcf|res|nuc|ani|bsp)$"


class ArchiveError(ValueError):
    """The bytes are no archive index."""


@dataclass
class Entry:
    """A file in an archive: its first bytes lie in the directory, the rest at a place of a numbered file."""

    path: str
    crc: int
    preload: bytes
    archive: int
    offset: int
    length: int


def entries(raw: bytes) -> tuple[list[Entry], int]:
    """The files of a version 1 or 2 archive directory, and where the data in its own file begin."""
    try:
        magic, version = struct.unpack_from("<II", raw, 0)
        if magic != SIGNATURE or version not in (1, 2):
            raise ArchiveError("not an archive directory")
        at = 12 if version == 1 else 28
        begin = at + struct.unpack_from("<I", raw, 8)[0]
        out = []

        def word() -> str:
            nonlocal at
            end = raw.index(b"\0", at)
            s = raw[at:end].decode("utf-8", "replace")
            at = end + 1
            return s

        while ext := word():
            while folder := word():
                while name := word():
                    crc, preload, archive, offset, length, _ = ENTRY.unpack_from(raw, at)
                    at += ENTRY.size
                    path = ("" if folder == " " else folder + "/") + name + ("" if ext == " " else "." + ext)
                    out.append(Entry(path, crc, raw[at : at + preload], archive, offset, length))
                    at += preload
        return out, begin
    except (struct.error, ValueError) as e:
        raise ArchiveError(str(e)) from e


def read_index(raw: bytes) -> list[tuple[str, int, str | None]]:
    """(virtual_path, size, checksum as 8 hex digits or None for 0) of an archive directory."""
    return [(e.path, e.length + len(e.preload), f"{e.crc:08x}" if e.crc else None) for e in entries(raw)[0]]


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, raw in zip(b["path"], b["content"]):
            try:
                rows = read_index(raw)
            except ArchiveError:
                continue
            yield pd.DataFrame([(path, *r, i) for i, r in enumerate(rows)], columns=["archive", "virtual_path", "file_size", "file_hash", "at"])


def scan_archives(spark: SparkSession, folder: str, pattern: str = "*.vpk") -> DataFrame:
    """Index rows of all archives below a folder, one task's batch at a time; unreadable archives give no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(_entries, INDEX_SCHEMA).drop("at")


def _local(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def scan_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Index rows of the given archives, with the place ``at`` of each file in its archive."""
    files = spark.read.format("binaryFile").load(paths).select(_local(F.col("path")).alias("path"), "content")
    return files.mapInPandas(_entries, INDEX_SCHEMA)


def read_contents(spark: SparkSession, paths: list[str], pattern: str = NAMING) -> DataFrame:
    """(archive, virtual_path, content) of the files in the given archives whose path fits; one archive is one task's work.

    Numbered files are opened beside their directory, on storage that all executors see. Damaged archives and files
    whose bytes are not there give no rows.
    """
    wanted = re.compile(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                try:
                    found, begin = entries(raw)
                except ArchiveError:
                    continue
                rows, size = [], 0
                for e in found:
                    if not wanted.search(e.path):
                        continue
                    rest = raw[begin + e.offset : begin + e.offset + e.length] if e.archive == OWN else _numbered(path, e)
                    if rest is not None and len(rest) == e.length:
                        rows.append((path, e.path, e.preload + rest))
                        size += len(rows[-1][2])
                    if size > 16 << 20:
                        yield pd.DataFrame(rows, columns=["archive", "virtual_path", "content"])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "virtual_path", "content"])

    files = spark.read.format("binaryFile").load(paths).select(_local(F.col("path")).alias("path"), "content")
    return files.mapInPandas(run, "archive string, virtual_path string, content binary")


def _numbered(path: str, e: Entry) -> bytes | None:
    if not e.length:
        return b""
    try:
        with open(f"{path.removesuffix('_dir.vpk')}_{e.archive:03d}.vpk", "rb") as f:
            f.seek(e.offset)
            return f.read(e.length)
    except OSError:
        return None


def marks_of(spark: SparkSession, paths: list[str], with_hash: bool = False) -> DataFrame:
    """(path, size, mtime, sha256) of the given archives; sha256 is null unless asked for, for it reads them whole."""
    schema = "path string, size long, mtime timestamp, sha256 string"
    if not paths:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(paths)
    return files.select(_local(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), (F.sha2("content", 256) if with_hash else F.lit(None).cast("string")).alias("sha256"))


def scan_folder(spark: SparkSession, folder: str, priority: int, skip: tuple[str, ...] = ("bin", ".git")) -> DataFrame:
    """Loose files of a game folder as rows: source ``base``, type ``game``, no hash. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    rel = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    root = folder.removeprefix("file://").rstrip("/") + "/"
    out = files.select(F.substring_index(rel, root, -1).alias("virtual_path"), F.col("length").alias("file_size"))
    for s in skip:
        out = out.filter(~F.concat(F.lit("/"), F.col("virtual_path")).contains(f"/{s}/"))
    return out.select("virtual_path", F.lit("base").alias("source_name"), F.lit("game").alias("source_type"), F.lit(priority).alias("priority"), F.lit(None).cast("string").alias("file_hash"), "file_size", F.lit(True).alias("is_enabled"))


def fingerprint(spark: SparkSession, folder: str, pattern: str = "*.vpk") -> DataFrame:
    """(path, size, mtime) of every archive, from metadata alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def reference_files(index: DataFrame, name: str, priority: int = 2000) -> DataFrame:
    """An archive index as rows of ``external_files``."""
    return index.select("virtual_path", F.lit(f"ref:{name}").alias("ext_source_name"), F.lit(priority).alias("ext_priority"), F.col("file_hash").alias("ext_file_hash"), F.col("file_size").alias("ext_file_size"))
