"""Registered queries of the content extractors, the readers and the writers.

Contents are made from the stored tables: each dependency becomes a small file that names its to_path in the notation of
one format, and extraction must give back what SQL gives by normalising to_path. Archives, folders, lists and reports
are written to the scratch folder from whole tables and read again.
"""

from __future__ import annotations

import csv
import io
import struct
import zipfile
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..catalog import Catalog
from ..functions import extract as X
from ..functions.keyvalues import leaves
from ..operators import analyzers as A
from ..operators import graph as G
from ..operators.overlay import prioritise, what_if
from ..operators.relation import Relation
from ..scratch import folder, put
from ..sinks import cache, reports
from ..sources import archives, settings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Extractors: one file for each dependency -------------------------------------------------------------------------

_W = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_W}+', ''), '{_W}+$', '')"


def _slashes(c: str) -> str:
    return rf"replace({_strip(c)}, '\', '/')"


def _led(c: str, *prefixes: str) -> str:
    return f"CASE WHEN {' OR '.join(f'''starts_with(lower({c}), '{p}')''' for p in prefixes)} THEN {c} ELSE '{prefixes[0]}' || {c} END"


def _ended(c: str, ends: str, default: str, any_case: bool = False) -> str:
    return rf"(CASE WHEN regexp_matches({c}, '{'(?i)' if any_case else ''}\.({ends})$') THEN {c} ELSE {c} || '{default}' END)"


_SOUND = _led(_slashes("v"), "sound/")
_TEXTURE = _ended(_slashes("v"), "vtf|vmt|png", ".vtf", True)
_SCRIPT = _ended(_slashes("v"), "nut", ".nut")
_SCRIPT = f"(CASE WHEN contains({_SCRIPT}, '/') THEN {_SCRIPT} ELSE 'scripts/vscripts/' || {_SCRIPT} END)"
#: A name as the particle reader shows it: bytes beyond ASCII are replaced one by one.
_BYTES = r"regexp_replace(regexp_replace(regexp_replace(v, '[\x{800}-\x{FFFF}]', repeat(chr(65533), 3), 'g'), '[\x{10000}-\x{10FFFF}]', repeat(chr(65533), 4), 'g'), '[\x{80}-\x{7FF}]', repeat(chr(65533), 2), 'g')"
_PCF = rf"replace({_BYTES}, '\', '/')"

#: Format: path before and after the id, content around the name, and the expected names as SQL over v.
FORMATS: dict[str, tuple[str, str, str, list[str]]] = {
    "x_vmt": ("materials/d", ".vmt", '"Shader"\n{\n\t"$baseTexture" "%s"\n\t"$alpha" "1"\n}\n', [rf"CASE WHEN starts_with({_ended(_slashes('v'), 'vtf|vmt|png|jpg|tga', '.vtf')}, 'materials/') THEN {_ended(_slashes('v'), 'vtf|vmt|png|jpg|tga', '.vtf')} ELSE 'materials/' || {_ended(_slashes('v'), 'vtf|vmt|png|jpg|tga', '.vtf')} END"]),
    "x_nut": ("scripts/vscripts/d", ".nut", 'IncludeScript( "%s" )\nPrecacheModel("%s");\nPrecacheSound("%s")\n', [_SCRIPT, "v", _SOUND]),
    "x_pcf": ("particles/d", ".pcf", "\x05\x00material\x00\x00%s\x00end", [_led(_ended(_PCF, "vmt|vtf", ".vmt", True), "materials/"), rf"""replace(regexp_extract({_BYTES}, '(?i)materials[/\\][^"]+\.vmt'), '\', '/')"""]),
    "x_res": ("resource/ui/d", ".res", '"Panel"\n{\n\t"Inner"\n\t{\n\t\t"image"\t"%s"\n\t\t"fieldName" "x"\n\t}\n}\n', [_led(_ended(_slashes("v"), "vtf|vmt|png|ttf|tga", ".vtf", True), "materials/", "resource/")]),
    "x_ani": ("models/d", ".ani", 'x\n"Model" "%s" "model" "none.txt"', [r"CASE WHEN ends_with(lower(v), '.mdl') THEN lower(replace(v, '\', '/')) ELSE '' END"]),
    "x_manifest": ("scripts/d", "_manifest.txt", "// head\n\n# more\n%s\n", [f"CASE WHEN regexp_matches({_strip('v')}, '^(//|#)') THEN '' ELSE {_strip('v')} END"]),
    "x_game_sounds": ("scripts/game_sounds_d", ".txt", '"Entry"\n{\n\t"wave" "%s"\n\t"rndwave"\n\t{\n\t\t"wave" "own.wav"\n\t}\n}\n', [_SOUND, "'sound/own.wav'"]),
    "x_soundscapes": ("scripts/soundscapes_d", ".txt", '"s" { "playlooping" { "wave" "%s" } }', [_SOUND]),
    "x_level_sounds": ("maps/d", "_level_sounds.txt", '"Entry"\n{\n\t"sound" "%s"\n\t"volume" "1"\n}\n', [_SOUND]),
    "x_population": ("scripts/d", "population.txt", '"group"\n{\n\t"zombie_class" "%s"\n}\n"other"\n{\n\t"zombie_class" "Tank"\n}\n', ["'models/infected/' || lower(v) || '.mdl'", "'models/infected/hulk.mdl'"]),
    "x_melee": ("scripts/melee/d", ".txt", '"weapon"\n{\n\t"viewmodel" "%s"\n\t"damage" "3"\n}\n', [r"replace(v, '\', '/')"]),
    "x_missions": ("missions/d", ".txt", '"mission"\n{\n\t"modes"\n\t{\n\t\t"coop"\n\t\t{\n\t\t\t"1"\n\t\t\t{\n\t\t\t\t"Map" "%s"\n\t\t\t}\n\t\t}\n\t}\n}\n', []),
    "x_weapon": ("scripts/weapon_d", ".txt", '"WeaponData"\n{\n\t"playermodel" "%s"\n\t"sound_single" "%s"\n\t"texture" "%s"\n}\n', [r"replace(v, '\', '/')", _SOUND, _led(_TEXTURE, "materials/")]),
    "x_texture_list": ("scripts/hud_textures.txt", "", '"list" "%s"\n', []),
    "x_sound_list": ("maps/d", "_sound_prefetch.txt", "// head\n%s\n", [rf"CASE WHEN regexp_matches({_strip('v')}, '^(//|#)') OR {_strip('v')} = '' THEN '' ELSE {_led(_slashes('v'), 'sound/')} END"]),
    "x_mixers": ("scripts/soundmixers.txt", "", '"mix" "%s" "1.0"\n', []),
}


def _contents(spark: SparkSession, sf_dir: str, path: Column, text: Column) -> DataFrame:
    d = table(spark, sf_dir, "dependencies").withColumn("v", _quotable(F.col("to_path"))).filter("v <> ''")
    return d.select(path.alias("virtual_path"), F.encode(text, "UTF-8").alias("content"))


def _quotable(c: Column) -> Column:
    """Without quotes and line breaks, which no quoted value of these formats can hold."""
    return F.regexp_replace(c, r"[\"\n\x0B\f\r\x1C-\x1E\u0085\u2028\u2029]", "")


def _filled(template: str) -> Column:
    parts = template.split("%s")
    return F.concat(*[x for i, p in enumerate(parts) for x in ([F.col("v")] * (i > 0) + [F.lit(p)])])


def extracted(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, template, _ = FORMATS[name]
    path = F.concat(F.lit(before), F.col("dep_id").cast("string"), F.lit(after)) if after else F.lit(before)
    if name == "x_missions":
        template = template.replace('"mission"\n{\n', "").removesuffix("}\n")
    return X.extract_edges(_contents(spark, sf_dir, path, _filled(template)))


_V = r"""d AS (SELECT * FROM (SELECT dep_id, regexp_replace(to_path, '["\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]', '', 'g') AS v FROM dependencies) WHERE v <> '')"""


def _extracted_sql(name: str) -> str:
    before, after, _, wanted = FORMATS[name]
    wanted = {"x_missions": ["'maps/' || v || '.bsp'"], "x_texture_list": [_led(_TEXTURE, "materials/")], "x_mixers": [rf"CASE WHEN regexp_matches({_slashes('v')}, '(?i)\.wav$') THEN {_led(_slashes('v'), 'sound/')} WHEN regexp_matches({_slashes('v')}, '(?i)\.phy$') THEN {_slashes('v')} ELSE '' END"]}.get(name, wanted)
    src = f"'{before}' || dep_id || '{after}'" if after else f"'{before}'"
    return f"WITH {_V} SELECT DISTINCT * FROM ({' UNION '.join(f'SELECT {src} AS src, {w} AS dst FROM d' for w in wanted)}) WHERE dst <> ''"


def x_vmt_values(spark, sf_dir):
    d = _contents(spark, sf_dir, F.col("dep_id"), _filled('$detail "%s" $envmap "%s"\n$scale "2"')).withColumnRenamed("virtual_path", "dep_id")
    return d.select("dep_id", F.explode(X.material_values(F.decode("content", "UTF-8"))).alias("value"))


def map_file(files: dict[str, str]) -> bytes:
    """A map that holds nothing but an archive of ``files``."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, d in files.items():
            z.writestr(zipfile.ZipInfo(n), d)
    head = bytearray(8 + 16 * 64)
    head[:4] = b"VBSP"
    struct.pack_into("<ii", head, 8 + 16 * X.PAK_LUMP, len(head), len(buf.getvalue()))
    return bytes(head) + buf.getvalue()


@F.pandas_udf(BinaryType())
def _maps(v: pd.Series) -> pd.Series:
    return v.map(lambda x: map_file({"maps/in.nut": f'IncludeScript("{x}")\nPrecacheSound("{x}")', "cfg/in.cfg": "exec server\n"}))


def x_bsp_pak(spark, sf_dir):
    d = table(spark, sf_dir, "dependencies").withColumn("v", _quotable(F.col("to_path"))).filter("v <> ''")
    return X.extract_edges(d.select(F.concat(F.lit("maps/d"), F.col("dep_id"), F.lit(".bsp")).alias("virtual_path"), _maps(F.col("v")).alias("content")))


def x_keyvalues(spark, sf_dir):
    """Leaves of nested texts, with repeated keys, comments and an unclosed block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, ".".join(p), v) for i, t in zip(b["dep_id"], b["text"]) for p, v in leaves(t)]
            yield pd.DataFrame(rows, columns=["dep_id", "key", "value"])

    d = _contents(spark, sf_dir, F.col("dep_id"), _filled('; c\n"Root" {\n "Name" "%s"\n // "x" "y"\n "Sub" { KEY "%s" key 2 }\n "open" {')).withColumnRenamed("virtual_path", "dep_id")
    return d.select("dep_id", F.decode("content", "UTF-8").alias("text")).mapInPandas(run, "dep_id long, key string, value string")


def x_normalisers(spark, sf_dir):
    d = table(spark, sf_dir, "dependencies").filter("to_path is not null")
    return d.select("dep_id", X.sound_path(F.col("to_path")).alias("sound"), X.texture_path(F.col("to_path")).alias("texture"), X.script_path(F.col("to_path")).alias("script"))


def x_addoninfo(spark, sf_dir):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [X.addon_info(t) for t in b["text"]]
            yield pd.DataFrame({"addon_row": b["addon_row"], "title": [g["title"] for g in got], "needs": [",".join(g["dependencies"]) for g in got]})

    a = table(spark, sf_dir, "addons").filter("not contains(name, '\"') and not contains(name, chr(10))")
    text = F.concat(F.lit('"AddonInfo"\n{\n\taddonTitle "'), F.col("name"), F.lit('"\n\taddonDependencies\n\t{\n\t\t"'), F.col("addon_id"), F.lit('.vpk" "1"\n\t}\n}\n'))
    return a.select("addon_row", text.alias("text")).mapInPandas(run, "addon_row long, title string, needs string")


def text_decoding(spark, sf_dir):
    """Texts of nations and parts written in UTF-8 with a mark, in a Western encoding, and in UTF-8, read again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", F.md5(F.encode(X._decoded(raw), "UTF-8")).alias("hash"))


# --- Readers and writers ----------------------------------------------------------------------------------------------


def archive_bytes(rows: list[tuple[str, int, int]]) -> bytes:
    """A version 1 archive directory of (path, checksum, size). Its format has no names that end in a point."""
    tree = b""
    for path, crc, size in rows:
        place, _, name = path.rpartition("/")
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, ext) if dot else (name, "")
        tree += b"".join((x or " ").encode() + b"\0" for x in (ext, place, stem)) + archives.ENTRY.pack(crc, 0, 0, 0, size, 0xFFFF) + b"\0\0"
    return struct.pack("<III", archives.SIGNATURE, 1, len(tree) + 1) + tree + b"\0"


def _stock(spark, sf_dir) -> tuple[str, DataFrame]:
    """The stock packages, a table of fixed size, as one archive each."""
    at = folder(spark, "stock")
    packages: dict[str, list] = {}
    for r in table(spark, sf_dir, "external_files").filter("virtual_path <> ''").collect():
        packages.setdefault(r.ext_source_name, []).append((r.virtual_path, int(r.ext_file_hash or "0", 16), r.ext_file_size))
    for name, rows in packages.items():
        put(spark, f"{at}/{name.replace(':', '_')}_dir.vpk", archive_bytes(rows))
    return at, archives.scan_archives(spark, at, "*_dir.vpk")


def archive_scan(spark, sf_dir):
    return _stock(spark, sf_dir)[1].select(F.regexp_extract("archive", r"([^/]*)_dir\.vpk$", 1).alias("archive"), "virtual_path", "file_size", "file_hash")


def external_reference(spark, sf_dir):
    return archives.reference_files(_stock(spark, sf_dir)[1], "stock")


def folder_scan(spark, sf_dir):
    at = folder(spark, "game")
    for r in table(spark, sf_dir, "nation").collect():
        put(spark, f"{at}/maps/{r.n_name.lower()}.bsp", r.n_name.encode())
        put(spark, f"{at}/bin/{r.n_nationkey}.dll", b"skipped")
    return archives.scan_folder(spark, at, 100).select("virtual_path", "source_name", "source_type", "priority", "file_size")


def archive_marks(spark, sf_dir):
    at = folder(spark, "marks")
    for r in table(spark, sf_dir, "nation").collect():
        put(spark, f"{at}/{r.n_nationkey}.{'vpk' if r.n_nationkey % 5 else 'txt'}", r.n_name.encode())
    return archives.fingerprint(spark, at).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "size")


def addon_list(spark, sf_dir):
    rows = table(spark, sf_dir, "addons").orderBy("addon_row").select("addon_id", "enabled").toLocalIterator()
    text = '"AddonList"\n{\n' + "".join(f'\t"workshop\\{r.addon_id}.vpk"\t\t"{int(bool(r.enabled))}"\n' for r in rows) + "}\n"
    return spark.createDataFrame(settings.addon_list(text), "name string, enabled boolean, place int")


def addon_priorities(spark, sf_dir):
    a = table(spark, sf_dir, "addons").groupBy(F.col("addon_id").alias("name")).agg(F.min(F.when(F.col("enabled"), F.col("addon_row"))).cast("int").alias("listed_order"))
    return prioritise(a).select("name", "priority")


def game_settings(spark, sf_dir):
    r = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    text = '"GameInfo"\n{\n\tgame "G"\n\tFileSystem\n\t{\n\t\tSearchPaths\n\t\t{\n' + "".join(f'\t\t\t{"Game" if x.r_regionkey % 2 else "game_addonroot"} "{x.r_name}"\n' for x in r) + "\t\t}\n\t}\n}\n"
    info = settings.game_info(text)
    return spark.createDataFrame([("dir", x) for x in info.game_dirs] + [("root", x) for x in info.addon_roots], "kind string, path string")


def config_file(spark, sf_dir):
    at = folder(spark, "config").removeprefix("file:").replace("//", "/")
    n = table(spark, sf_dir, "nation").count()
    put(spark, f"{at}/own.toml", f'[paths]\ngame_dir = "g"\n[run]\nmax_maps = {n}\nrun_impact = true\nnothing = 1\n'.encode())
    c = settings.load_config(f"{at}/own.toml")
    return spark.createDataFrame([(c.game_dir, c.max_maps, c.run_impact, c.report_format)], "game_dir string, max_maps int, run_impact boolean, report_format string")


def whitelist_file(spark, sf_dir):
    """Files that a whitelist allows, its patterns being read from its text."""
    text = 'whitelist\n{\n\t// c\n\tmaterials/... from_steam\n\t"sound/*.wav" "any"\n\tscripts/vscripts/a*.nut # x\n}\n'
    patterns = [p.split()[0] for p in settings.whitelist(text)]
    return A.pure_allowed(table(spark, sf_dir, "files"), patterns).select("file_id", "is_pure_allowed")


def what_if_overlay(spark, sf_dir):
    """Paths that stock packages would win at a priority of 300."""
    key = F.lower(F.translate("virtual_path", "\\", "/"))
    x = table(spark, sf_dir, "external_files").filter("virtual_path is not null").groupBy(key.alias("virtual_path")).agg(F.min("ext_source_name").alias("source_name"))
    f = table(spark, sf_dir, "files").select("file_id", "virtual_path", "source_name", "priority", "is_enabled", "is_dead")
    return what_if(f, x, "file_id", 300).filter("is_winner and source_name like 'ref:%'").select("virtual_path", "source_name")


def cache_round_trip(spark, sf_dir):
    """Files and links written to a cache that is valid for its archives, and read again."""
    at, index = _stock(spark, sf_dir)
    where, marks = folder(spark, "cache"), archives.fingerprint(spark, at)
    cache.save(where, table(spark, sf_dir, "files").select("file_id", "virtual_path", "source_name"), table(spark, sf_dir, "dependencies").select("from_path", "to_path"), marks)
    if not cache.is_valid(spark, where, marks):
        raise RuntimeError("the cache is not valid for the archives it was made from")
    files, edges = cache.load(spark, where)
    return files.select(F.lit("file").alias("kind"), F.col("virtual_path").alias("a"), F.col("source_name").alias("b")).unionByName(edges.select(F.lit("link").alias("kind"), F.col("from_path").alias("a"), F.col("to_path").alias("b")))


def _small(spark, sf_dir) -> Catalog:
    return Catalog(spark, {n: table(spark, sf_dir, n).drop("entry_id", "addon_row", "seen_at") for n in ("entry_points", "addons")})


def report_json(spark, sf_dir):
    at = folder(spark, "report").removeprefix("file:").replace("//", "/")
    path = reports.write_report(_small(spark, sf_dir), at, "json", ["entry_points", "addons"])
    c = settings.load_report(spark, path)
    return c["entry_points"].select(F.col("virtual_path").alias("a"), F.col("source_type").alias("b")).unionAll(c["addons"].select("addon_id", "name"))


def report_csv(spark, sf_dir):
    at = folder(spark, "report").removeprefix("file:").replace("//", "/")
    path = reports.write_report(_small(spark, sf_dir), at, "csv", ["entry_points"])
    with open(path, encoding="utf-8", newline="") as f:
        rows = [(r["virtual_path"], r["source_type"]) for r in csv.DictReader(x for x in islice(f, 1, None))]
    return spark.createDataFrame(rows, "virtual_path string, source_type string").filter("source_type is not null")


def report_text(spark, sf_dir):
    at = folder(spark, "report").removeprefix("file:").replace("//", "/")
    c = _small(spark, sf_dir).with_relation("files", table(spark, sf_dir, "nation").select("n_name", "n_regionkey"))
    path = reports.write_report(c, at, "text", ["files"])
    rows = spark.read.text(f"file:{path}").filter("startswith(value, '| ') and not contains(value, 'n_name')").select(F.split("value", r"\|").alias("c"))
    return rows.select(F.trim(F.col("c")[1]).alias("n_name"), F.trim(F.col("c")[2]).cast("int").alias("n_regionkey"))


def report_html(spark, sf_dir):
    at = folder(spark, "report").removeprefix("file:").replace("//", "/")
    c = _small(spark, sf_dir).with_relation("files", table(spark, sf_dir, "addons").select("addon_id"))
    path = reports.write_report(c, at, "html", ["files"])
    return spark.read.text(f"file:{path}").select(F.regexp_extract("value", "^<tr><td>(.*)</td></tr>$", 1).alias("addon_id")).filter("addon_id <> ''")


def relation_rows(spark, sf_dir):
    """Rows, dictionaries and a pandas table of one relation."""
    r = Relation(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "nation")
    p = r.to_pandas()
    rows = [("rows", *x) for x in r.to_rows()] + [("dicts", d["n_nationkey"], d["n_name"]) for d in r.to_dicts()] + [("pandas", int(a), b) for a, b in zip(p.n_nationkey, p.n_name)]
    return spark.createDataFrame(rows, "kind string, n_nationkey int, n_name string")


def graph_counts(spark, sf_dir):
    e = G.edge_set(table(spark, sf_dir, "dependencies").select(F.col("from_path").alias("src"), F.col("to_path").alias("dst")))
    return G.nodes_of(e).agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("n_links")))


def summary_counts(spark, sf_dir):
    c = Catalog(spark, {"files": table(spark, sf_dir, "files"), "isolated": A.isolated_packages(table(spark, sf_dir, "files"))})
    return spark.createDataFrame(list(reports.summary(c).items()), "name string, n long")


def addon_needs(spark, sf_dir):
    """Declared needs of add-ons for which there are no files."""
    m = table(spark, sf_dir, "addon_manifests").select(F.concat(F.lit("addons/"), F.col("addon_id"), F.lit("/addoninfo.txt")).alias("virtual_path"), F.col("addon_id").alias("source_name"), F.concat(F.lit("ws"), F.lpad(F.col("priority").cast("string"), 9, "1")).alias("workshop_id"))
    return A.addon_dependency_conflicts(m.filter("workshop_id is not null").distinct(), table(spark, sf_dir, "files"))


def folder_catalogue(spark, sf_dir):
    """Stock packages as folders of one game, mounted in order of their names: every record, and which are active."""
    from ..sources import game

    at = folder(spark, "steam").removeprefix("file:").replace("//", "/")
    key = F.lower(F.translate("virtual_path", "\\", "/"))
    packages: dict[str, list] = {}
    x = table(spark, sf_dir, "external_files").filter("virtual_path <> ''").groupBy("ext_source_name", key.alias("k")).agg(F.min("virtual_path").alias("p"))
    for r in x.orderBy("ext_source_name", "p").collect():  # a table of fixed size
        packages.setdefault(r.ext_source_name.replace(":", "_"), []).append((r.p, 1, 1))
    for name, rows in packages.items():
        put(spark, f"{at}/{name}/{name}_dir.vpk", archive_bytes(rows))
    paths = "".join(f'\t\t\tGame "{n}"\n' for n in packages)
    put(spark, f"{at}/game/gameinfo.txt", f'"GameInfo"\n{{\n\tFileSystem\n\t{{\n\t\tSearchPaths\n\t\t{{\n{paths}\t\t}}\n\t}}\n}}\n'.encode())
    c, engine = game.build_catalog(spark, f"{at}/game", "l4d2")
    if engine.errors:
        raise RuntimeError(str(engine.errors))
    return c["files"].filter("source_type = 'vpk'").select("virtual_path", "source_name", "priority", "is_active")


PY = [
    x_vmt_values, x_bsp_pak, x_keyvalues, x_normalisers, x_addoninfo, text_decoding, archive_scan, external_reference, folder_scan, archive_marks, addon_list, addon_priorities, game_settings,
    config_file, whitelist_file, what_if_overlay, cache_round_trip, report_json, report_csv, report_text, report_html, relation_rows, graph_counts, summary_counts, addon_needs, folder_catalogue,
]

QUERIES = {**{n: partial(extracted, n) for n in FORMATS}, **{f.__name__: f for f in PY}}

_OVER = r"lower(replace(virtual_path, '\', '/'))"
ORACLE = {
    **{n: _extracted_sql(n) for n in FORMATS},
    "x_vmt_values": f"WITH {_V} SELECT dep_id, v AS value FROM d UNION SELECT dep_id, '2' FROM d",
    "x_bsp_pak": f"WITH {_V}, s AS (SELECT 'maps/d' || dep_id || '.bsp' AS src, v FROM d) SELECT * FROM (SELECT src, {_SCRIPT} AS dst FROM s UNION SELECT src, {_SOUND} FROM s UNION SELECT src, unnest(['maps/in.nut', 'cfg/in.cfg', 'cfg/server.cfg']) FROM s) WHERE dst <> ''",
    "x_keyvalues": f"WITH {_V} SELECT dep_id, 'root.name' AS key, v AS value FROM d UNION ALL SELECT dep_id, 'root.sub.key', v FROM d UNION ALL SELECT dep_id, 'root.sub.key', '2' FROM d",
    "x_normalisers": f"WITH d AS (SELECT dep_id, to_path AS v FROM dependencies WHERE to_path IS NOT NULL) SELECT dep_id, {_SOUND} AS sound, {_led(_ended(_slashes('v'), 'vtf|vmt|png|ttf|tga', '.vtf'), 'materials/', 'resource/')} AS texture, {_SCRIPT} AS script FROM d",
    "x_addoninfo": "SELECT addon_row, name AS title, addon_id AS needs FROM addons WHERE NOT contains(name, '\"') AND NOT contains(name, chr(10))",
    "text_decoding": "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '^\\x{FEFF}', '') END) AS hash FROM documents WHERE text IS NOT NULL",
    "archive_scan": "SELECT replace(ext_source_name, ':', '_') AS archive, regexp_replace(virtual_path, '\\.$', '') AS virtual_path, ext_file_size AS file_size, ext_file_hash AS file_hash FROM external_files WHERE virtual_path <> ''",
    "external_reference": "SELECT regexp_replace(virtual_path, '\\.$', '') AS virtual_path, 'ref:stock' AS ext_source_name, 2000 AS ext_priority, ext_file_hash, ext_file_size FROM external_files WHERE virtual_path <> ''",
    "folder_scan": "SELECT 'maps/' || lower(n_name) || '.bsp' AS virtual_path, 'base' AS source_name, 'game' AS source_type, 100 AS priority, strlen(n_name) AS file_size FROM nation",
    "archive_marks": "SELECT n_nationkey || '.vpk' AS name, strlen(n_name) AS size FROM nation WHERE n_nationkey % 5 <> 0",
    "addon_list": "SELECT addon_id || '.vpk' AS name, enabled, (row_number() OVER (ORDER BY addon_row) - 1)::INT AS place FROM (SELECT DISTINCT ON (addon_id) addon_id, coalesce(enabled, false) AS enabled, addon_row FROM addons ORDER BY addon_id, addon_row)",
    "addon_priorities": "WITH a AS (SELECT addon_id AS name, min(addon_row) FILTER (enabled)::INT AS listed_order FROM addons GROUP BY 1) SELECT name, (1000 + count(*) OVER () - row_number() OVER (ORDER BY listed_order IS NULL, listed_order, lower(name) DESC, name) + 1)::INT AS priority FROM a",
    "game_settings": "SELECT 'dir' AS kind, r_name AS path FROM region UNION ALL SELECT 'root', r_name FROM region WHERE r_regionkey % 2 = 0",
    "config_file": "SELECT 'g' AS game_dir, count(*)::INT AS max_maps, true AS run_impact, 'json' AS report_format FROM nation",
    "whitelist_file": "SELECT file_id, coalesce(lower(virtual_path) GLOB 'materials/*' OR lower(virtual_path) GLOB 'sound/*.wav' OR lower(virtual_path) GLOB 'scripts/vscripts/a*.nut', false) AS is_pure_allowed FROM files",
    "what_if_overlay": f"WITH f AS (SELECT {_OVER} AS k, max(priority) AS p FROM files WHERE is_enabled AND NOT coalesce(is_dead, false) GROUP BY 1), x AS (SELECT {_OVER} AS k, min(ext_source_name) AS source_name FROM external_files WHERE virtual_path IS NOT NULL GROUP BY 1) SELECT x.k AS virtual_path, source_name FROM x LEFT JOIN f ON f.k = x.k WHERE p IS NULL OR p < 300",
    "cache_round_trip": "SELECT 'file' AS kind, virtual_path AS a, source_name AS b FROM files UNION ALL SELECT 'link', from_path, to_path FROM dependencies",
    "report_json": "SELECT virtual_path AS a, source_type AS b FROM entry_points UNION ALL SELECT addon_id, name FROM addons",
    "report_csv": "SELECT coalesce(virtual_path, '') AS virtual_path, coalesce(source_type, '') AS source_type FROM entry_points",
    "report_text": "SELECT n_name, n_regionkey FROM nation",
    "report_html": "SELECT addon_id FROM addons",
    "relation_rows": "SELECT unnest(['rows', 'dicts', 'pandas']) AS kind, n_nationkey, n_name FROM nation",
    "graph_counts": "WITH e AS (SELECT DISTINCT from_path AS a, to_path AS b FROM dependencies WHERE from_path IS NOT NULL AND to_path IS NOT NULL) SELECT (SELECT count(*) FROM (SELECT a FROM e UNION SELECT b FROM e)) AS n_nodes, (SELECT count(*) FROM e) AS n_links",
    "summary_counts": """SELECT 'redundancy' AS name, count(*) FILTER (is_redundant) AS n FROM files UNION ALL SELECT 'dead_files', count(*) FILTER (is_dead) FROM files UNION ALL SELECT unnest(['hash_conflicts', 'dep_conflicts', 'impact']), 0
      UNION ALL SELECT 'isolated', count(*) FROM (SELECT source_name FROM files GROUP BY source_name HAVING count(*) FILTER (is_dead OR is_redundant) > 0)""",
    "folder_catalogue": rf"""WITH x AS (SELECT replace(ext_source_name, ':', '_') AS n, {_OVER} AS k, min(virtual_path) AS p FROM external_files WHERE virtual_path <> '' GROUP BY 1, 2),
      o AS (SELECT n, (101 - row_number() OVER (ORDER BY n))::INT AS priority FROM (SELECT DISTINCT n FROM x)), r AS (SELECT regexp_replace(p, '\.$', '') AS virtual_path, n || '_dir.vpk' AS source_name, priority FROM x JOIN o USING (n))
      SELECT virtual_path, source_name, priority, priority = max(priority) OVER (PARTITION BY {_OVER}) AS is_active FROM r""",
    "addon_needs": """WITH m AS (SELECT DISTINCT 'addons/' || addon_id || '/addoninfo.txt' AS from_path, 'ws' || lpad(priority::VARCHAR, 9, '1') AS to_path, addon_id AS expected_source FROM addon_manifests WHERE priority IS NOT NULL)
      SELECT *, 'MISSING' AS actual_source FROM m WHERE to_path NOT IN (SELECT source_name FROM files WHERE source_name IS NOT NULL)""",
}
