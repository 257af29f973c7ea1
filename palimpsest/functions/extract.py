"""From file contents to dependency edges: which files a file names.

Line- and pattern-shaped formats are read by built-in regular expressions inside the JVM. KeyValues formats and binary ones go
through one Arrow UDF that flattens each text once. An unreadable content names nothing; no extractor raises.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .ice import decrypt
from .keyvalues import leaves

# --- Path normalisers -------------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def slashes(c: Column) -> Column:
    return F.translate(strip(c), "\\", "/")


def _led(c: Column, prefix: str, *others: str) -> Column:
    has = F.lit(False)
    for p in (prefix, *others):
        has = has | F.lower(c).startswith(p)
    return F.when(has, c).otherwise(F.concat(F.lit(prefix), c))


def _ended(c: Column, ends: tuple[str, ...], default: str) -> Column:
    return F.when(c.rlike(r"\.(?:" + "|".join(e.lstrip(".") for e in ends) + r")\z"), c).otherwise(F.concat(c, F.lit(default)))


def sound_path(c: Column) -> Column:
    """Under ``sound/``."""
    return _led(slashes(c), "sound/")


def texture_path(c: Column) -> Column:
    """With an extension, by default .vtf, under ``materials/`` or ``resource/``."""
    return _led(_ended(slashes(c), (".vtf", ".vmt", ".png", ".ttf", ".tga"), ".vtf"), "materials/", "resource/")


def material_texture_path(c: Column) -> Column:
    t = _ended(slashes(c), (".vtf", ".vmt", ".png", ".jpg", ".tga"), ".vtf")
    return F.when(t.startswith("materials/"), t).otherwise(F.concat(F.lit("materials/"), t))


def script_path(c: Column) -> Column:
    """With .nut; a bare name lies in the folder of scripts."""
    s = _ended(slashes(c), (".nut",), ".nut")
    return F.when(s.contains("/"), s).otherwise(F.concat(F.lit("scripts/vscripts/"), s))


# --- Pattern formats, inside the JVM. Keys, calls and endings that the formats use ----------------------------------------------------------------------------------


def _all(text: Column, pattern: str, shape: Callable[[Column], Column] = lambda c: c, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), shape)


def material_links(text: Column) -> Column:
    return _all(text, r'(?i)(?:"\$(?:basetexture|bumpmap|normalmap)"|\$(?:basetexture|bumpmap|normalmap))\s+"([^"]+)"', material_texture_path)


def material_values(text: Column) -> Column:
    """Values of all ``$key "value"`` pairs."""
    return F.array_distinct(_all(text, r'\$(\w+)\s+"([^"]+)"', group=2))


#: Calls that name a file, and what kind of file.
CALLS = {"IncludeScript": "nut", "PrecacheModel": "", "PrecacheSound": "sound"}


def call_pattern(call: str) -> str:
    return rf'{call}\s*\(\s*"([^"]+)"\s*\)'


def script_links(text: Column) -> Column:
    shape = {"nut": script_path, "": lambda c: c, "sound": sound_path}
    return F.concat(*[_all(text, call_pattern(call), shape[kind]) for call, kind in CALLS.items()])


def soundscape_links(text: Column) -> Column:
    return _all(text, r'"wave"\s+"([^"]+)"', sound_path)


def animation_links(text: Column) -> Column:
    return F.filter(_all(text, r'(?i)"model"\s+"([^"]+)"', lambda c: F.lower(F.translate(c, "\\", "/"))), lambda c: c.endswith(".mdl"))


def list_lines(text: Column, prefix: str = "") -> Column:
    """Lines that are neither empty nor comments (``//``, ``#``), stripped."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), strip)
    kept = F.filter(lines, lambda c: (c != "") & ~c.startswith("//") & ~c.startswith("#"))
    return F.transform(kept, lambda c: _led(F.translate(c, "\\", "/"), prefix)) if prefix else kept


def mixer_links(text: Column) -> Column:
    """Quoted names of sounds and physics files."""
    lines = F.filter(list_lines(text), lambda c: ~c.startswith("{"))
    tokens = F.flatten(F.transform(lines, lambda c: F.transform(F.split(c, '"'), slashes)))
    hits = F.filter(tokens, lambda c: F.lower(c).rlike(r"\.(?:wav|phy)\z"))
    return F.transform(hits, lambda c: F.when(F.lower(c).endswith(".wav"), _led(c, "sound/")).otherwise(c))


# --- KeyValues and binary formats, as Arrow batches -------------------------------------------------------------------

# Models of the classes that are not called like their class.
CLASS_MODELS = {"tank": "hulk"}


def _sound(v: str) -> str:
    v = v.strip().replace("\\", "/")
    return v if v.lower().startswith("sound/") else "sound/" + v


def _under_materials(v: str, ends: tuple[str, ...], also: tuple[str, ...] = ()) -> str:
    v = v.strip().replace("\\", "/")
    v = v if v.lower().endswith(ends) else v + ".vtf"
    return v if v.lower().startswith(("materials/", *also)) else "materials/" + v


def _game_sound(p, v):
    wave = len(p) == 2 and p[1] in ("wave", "rndwave") or len(p) == 3 and p[1:] == ("rndwave", "wave")
    return _sound(v) if wave else None


def _level_sound(p, v):
    return _sound(v) if len(p) == 2 and p[1] == "sound" else None


def _population(p, v):
    return f"models/infected/{CLASS_MODELS.get(v.lower(), v.lower())}.mdl" if len(p) == 2 and p[1] == "zombie_class" else None


def _melee(p, v):
    return v.replace("\\", "/") if len(p) == 2 and p[1] in ("viewmodel", "worldmodel") and v else None


def _mission(p, v):
    return f"maps/{v}.bsp" if len(p) == 4 and p[0] == "modes" and p[3] == "map" else None


def _weapon(p, v):
    if len(p) != 1 and not (len(p) == 2 and p[0] == "weapondata"):
        return None
    k = p[-1]
    if k in ("viewmodel", "playermodel", "worldmodel"):
        return v.replace("\\", "/")
    if k.startswith("sound_"):
        return _sound(v)
    return _under_materials(v, (".vtf", ".vmt", ".png")) if k == "texture" else None


def _texture_list(p, v):
    return _under_materials(v, (".vtf", ".vmt", ".png")) if len(p) == 1 else None


def _resource(p, v):
    return _under_materials(v, (".vtf", ".vmt", ".png", ".ttf", ".tga"), ("resource/",)) if p[-1] in ("image", "font") else None


KV_RULES = {"game_sounds": _game_sound, "level_sounds": _level_sound, "population": _population, "melee": _melee, "missions": _mission, "weapon": _weapon, "texture_list": _texture_list, "res": _resource}


def kv_links(text: str | None, rule: str) -> list[str]:
    take = KV_RULES[rule]
    return sorted({d for p, v in leaves(text) if (d := take(p, v))})


_PCF_PATH = re.compile(rb'materials[/\\][^\x00"]+\.vmt', re.I)
_PCF_BARE = re.compile(rb"(?:material|texture)\x00+([^\x00]+)", re.I)


def particle_links(raw: bytes) -> list[str]:
    """Materials named in a particle file, with their path or bare."""
    show = lambda b: b.decode("ascii", "replace").replace("\\", "/")
    out = {show(m.group()) for m in _PCF_PATH.finditer(raw)}
    for m in _PCF_BARE.finditer(raw):
        v = show(m.group(1))
        v = v if v.lower().endswith((".vmt", ".vtf")) else v + ".vmt"
        out.add(v if v.lower().startswith("materials/") else "materials/" + v)
    return sorted(out)


#: Place of the embedded archive among the lumps of a map file.
PAK_LUMP = 40


def map_archive(raw: bytes) -> dict[str, bytes]:
    """Files embedded in a map: the zip archive in one of its lumps. Empty if there is none or it is damaged."""
    try:
        if raw[:4] != b"VBSP":
            return {}
        at, size = struct.unpack_from("<ii", raw, 8 + 16 * PAK_LUMP)
        with zipfile.ZipFile(io.BytesIO(raw[at : at + size])) as z:
            return {n: z.read(n) for n in z.namelist()}
    except (struct.error, zipfile.BadZipFile, OSError, ValueError):
        return {}


def script_names(text: str) -> set[str]:
    out = set()
    for call, kind in CALLS.items():
        for v in re.findall(call_pattern(call), text):
            if kind == "nut":
                v = v.strip().replace("\\", "/")
                v = v if v.endswith(".nut") else v + ".nut"
                v = v if "/" in v else "scripts/vscripts/" + v
            elif kind == "sound":
                v = _sound(v)
            out.add(v)
    return out


# Places of lumps in a map file, and of fields in the head of a model.
ENTITIES, GAME_LUMP, TEXTURE_NAMES, TEXTURE_TABLE = 0, 35, 43, 44
STATIC_PROPS, PROP_NAME = 0x73707270, 128
MODEL_TEXTURES, MODEL_FOLDERS, MODEL_TEXTURE_SIZE = 204, 212, 64
# Keys of encrypted scripts, by game.
SCRIPT_KEYS = {"l4d2": "SDhfi878", "css": "d7NSuLq2", "csgo": "d7NSuLq2", "tf2": "E2NcUkG2", "dods": "Wl0u5B3F", "hl2": "x9Ke0BY7", "portal2": "x9Ke0BY7"}


def _lump(raw: bytes, i: int) -> bytes:
    at, size = struct.unpack_from("<ii", raw, 8 + 16 * i)
    return raw[at : at + size]


def _word(raw: bytes, at: int) -> str:
    return raw[at : raw.index(b"\0", at)].decode("utf-8", "replace")


def map_content_links(raw: bytes) -> set[str]:
    """Textures, static models and the configurations that server commands run; empty for what is no map."""
    out: set[str] = set()
    if raw[:4] != b"VBSP":
        return out
    names, table = _lump(raw, TEXTURE_NAMES), _lump(raw, TEXTURE_TABLE)
    out |= {f"materials/{t}.vmt" for (at,) in struct.iter_unpack("<i", table[: len(table) // 4 * 4]) if (t := _word(names, at))}
    games = _lump(raw, GAME_LUMP)
    for i in range(struct.unpack_from("<i", games)[0] if games else 0):
        kind, _, _, at, size = struct.unpack_from("<iHHii", games, 4 + 16 * i)
        if kind == STATIC_PROPS and size >= 4:
            (n,) = struct.unpack_from("<i", raw, at)
            out |= {raw[x : x + PROP_NAME].split(b"\0")[0].decode("utf-8", "replace") for x in range(at + 4, at + 4 + n * PROP_NAME, PROP_NAME)}
    for block in re.findall(r"\{([^{}]*)\}", _lump(raw, ENTITIES).decode("utf-8", "replace")):
        pairs = [(k.lower(), v) for k, v in re.findall(r'"([^"]*)"\s+"([^"]*)"', block)]
        if ("classname", "point_servercommand") in [(k, v.strip().lower()) for k, v in pairs]:
            for target in (t for k, v in pairs if k == "command" for t in re.findall(r"\bexec\s+([^\s;]+)", v)):
                target = target.replace("\\", "/")
                target = target if target.endswith(".cfg") else target + ".cfg"
                out.add(target if "/" in target else "cfg/" + target)
    return out - {""}


def model_links(raw: bytes) -> list[str]:
    """Materials of a model: each of its textures in each of its folders; which of them exists the model does not tell."""
    if raw[:4] != b"IDST":
        return []
    textures, at = struct.unpack_from("<ii", raw, MODEL_TEXTURES)
    folders, listed = struct.unpack_from("<ii", raw, MODEL_FOLDERS)
    names = [_word(raw, x + struct.unpack_from("<i", raw, x)[0]) for x in range(at, at + textures * MODEL_TEXTURE_SIZE, MODEL_TEXTURE_SIZE)]
    places = [_word(raw, x) for (x,) in struct.iter_unpack("<i", raw[listed : listed + 4 * folders])]
    clean = lambda s: s.replace("\\", "/").strip("/")
    return sorted({"/".join(x for x in ("materials", clean(p), clean(n)) if x) + ".vmt" for p in places or [""] for n in names if n})


def encrypted_links(raw: bytes, key: str) -> list[str]:
    """What an encrypted script names; compiled ones and those without a key name nothing."""
    if not key or raw[:2] == b"\xfa\xfa":
        return []
    return sorted(script_names(decrypt(raw, key.encode("ascii")).decode("utf-8", "replace")))


def map_links(raw: bytes) -> list[str]:
    """What a map names, what the scripts and configurations embedded in it name, and the embedded files themselves."""
    try:
        out = map_content_links(raw)
    except (struct.error, ValueError):
        out = set()
    for name, data in map_archive(raw).items():
        out.add(name.replace("\\", "/"))
        text = data.decode("utf-8", "replace")
        if name.lower().endswith(".nut"):
            out |= script_names(text)
        elif name.lower().endswith(".cfg"):
            out |= {"cfg/" + (v if v.endswith(".cfg") else v + ".cfg") for v in re.findall(r"^\s*exec\s+\"?([^\s\";]+)", text, re.M)}
    return sorted(out)


def decode_text(raw: bytes | None) -> str:
    """UTF-8, else Western, else Japanese, else every byte as it is."""
    if raw is None:
        return ""
    for enc in ("utf-8-sig", "cp1252", "shift_jis"):
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


#: Further readers by extension, for formats that need a parser of their own: bytes to names.
PLUGINS: dict[str, Callable[[bytes], list[str]]] = {}


def file_kind(path: Column, game: str = "") -> Column:
    """Which extractor reads a file; null for a leaf. For .txt files the first rule that fits. ``game`` has the key of
    encrypted scripts."""
    p = F.lower(path)
    txt = (
        F.when(p.contains("manifest"), "manifest").when(p.contains("game_sounds"), "game_sounds").when(p.contains("soundscapes"), "soundscapes")
        .when(p.endswith("_level_sounds.txt"), "level_sounds").when(p.endswith("population.txt"), "population").when(p.startswith("missions/"), "missions")
        .when(p.startswith("scripts/melee/"), "melee").when(p.startswith("scripts/weapon_"), "weapon").when(p.isin("scripts/hud_textures.txt", "scripts/mod_textures.txt"), "texture_list")
        .when(p.endswith("sound_prefetch.txt"), "sound_list").when(p.endswith("level_sounds_general.txt"), "level_sounds").when(p.isin("scripts/soundmixers.txt", "scripts/propdata.txt"), "mixers")
    )
    ext = F.regexp_extract(p, r"\.([^./]+)$", 1)
    known = {"vmt": "vmt", "nut": "nut", "ani": "ani", "res": "res", "pcf": "pcf", "bsp": "bsp", "mdl": "mdl", "nuc": f"nuc:{SCRIPT_KEYS.get(game.lower(), '')}", **{e.lstrip("."): f"plugin:{e}" for e in PLUGINS}}
    out = F.when(ext == "txt", txt)
    for e, k in known.items():
        out = out.when(ext == e, k)
    return out


NATIVE = {"vmt": material_links, "nut": script_links, "ani": animation_links, "soundscapes": soundscape_links, "manifest": list_lines, "sound_list": lambda c: list_lines(c, "sound/"), "mixers": mixer_links}


def extract_edges(contents: DataFrame, game: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst), distinct, from ``contents``: virtual_path, content (BINARY); columns to ``keep`` come first. Null contents
    and unknown kinds name nothing."""
    rows = contents.select(*keep, "virtual_path", "content", file_kind(F.col("virtual_path"), game).alias("kind")).filter("kind is not null and content is not null")
    native = rows.filter(F.col("kind").isin(list(NATIVE)) & (F.hex(F.substring("content", 1, 2)) != "FAFA"))
    text = native.withColumn("text", _decoded(F.col("content")))
    named = F.coalesce(*[F.when(F.col("kind") == kind, links(F.col("text"))) for kind, links in NATIVE.items()])
    native = text.select(*keep, F.col("virtual_path").alias("src"), F.explode(named).alias("dst"))
    other = rows.filter(~F.col("kind").isin(list(NATIVE))).select(*keep, F.col("virtual_path").alias("src"), F.explode(_other_links(F.col("kind"), F.col("content"))).alias("dst"))
    return native.unionByName(other).filter("dst <> ''").distinct()


@F.pandas_udf(StringType())
def _decoded(raw: pd.Series) -> pd.Series:
    return raw.map(decode_text)


@F.pandas_udf(ArrayType(StringType()))
def _other_links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for kind, raw in batches:
        yield pd.Series([_links(k, r) for k, r in zip(kind, raw)])


def _links(kind: str, raw: bytes) -> list[str]:
    try:
        if kind == "pcf":
            return particle_links(raw)
        if kind == "bsp":
            return map_links(raw)
        if kind == "mdl":
            return model_links(raw)
        if kind.startswith("nuc:"):
            return encrypted_links(raw, kind[4:])
        if kind.startswith("plugin:"):
            return sorted(set(PLUGINS[kind[7:]](raw)))
        return kv_links(decode_text(raw), kind)
    except Exception:  # noqa: BLE001 - a file that cannot be read names nothing
        return []


def addon_info(text: str | None) -> dict[str, object]:
    """Title, author, version and needs of an add-on's description file."""
    flat = leaves(text)
    one = lambda k: next((v for p, v in flat if p[-1] == k), None)
    needs = [re.sub(r"\.vpk$", "", p[-1] if not v or v in "01" else v) for p, v in flat if len(p) >= 2 and "dependencies" in p[-2]]
    return {"title": one("addontitle"), "author": one("addonauthor"), "version": one("addonversion"), "dependencies": needs}
