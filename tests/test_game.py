"""From a game's folder to an analysed catalogue, by the functions and by the command line."""

import json
import struct

import pytest

from palimpsest.cli import checked, main, pages, parser
from palimpsest.functions import extract as X
from palimpsest.functions import ice
from palimpsest.operators import analyzers as A
from palimpsest.sources import archives, game


def archive(files, numbered=None):
    """A version 1 archive: (bytes of the directory, bytes of its first numbered file). Names in ``numbered`` lie there."""
    tree, own, other = b"", b"", b""
    for path, data in files.items():
        folder, _, name = path.rpartition("/")
        stem, _, ext = name.rpartition(".")
        away = path in (numbered or ())
        head, rest = data[:3], data[3:]
        entry = archives.ENTRY.pack(len(data), len(head), 0 if away else archives.OWN, len(other if away else own), len(rest), 0xFFFF)
        tree += ext.encode() + b"\0" + (folder or " ").encode() + b"\0" + stem.encode() + b"\0" + entry + head + b"\0\0"
        if away:
            other += rest
        else:
            own += rest
    tree += b"\0"
    return struct.pack("<III", archives.SIGNATURE, 1, len(tree)) + tree + own, other


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("steam") / "game"
    (r / "addons" / "workshop").mkdir(parents=True)
    (r / "addons" / "disable").mkdir()
    (r / "maps").mkdir()
    (r / "bin").mkdir()
    (r / "gameinfo.txt").write_text('"GameInfo"\n{\n\tgame "G"\n\tFileSystem\n\t{\n\t\tSearchPaths\n\t\t{\n\t\t\tGame |gameinfo_path|.\n\t\t\tGame update\n\t\t}\n\t}\n}\n')
    (r.parent / "update").mkdir()
    (r / "maps" / "m1.bsp").write_bytes(b"loose")
    (r / "bin" / "x.dll").write_bytes(b"no")
    (r / "addonlist.txt").write_text('"AddonList"\n{\n\t"b.vpk"\t\t"1"\n\t"c.vpk"\t\t"0"\n}\n')
    secret = ice.encrypt(b'IncludeScript("deep")   ', X.SCRIPT_KEYS["l4d2"].encode())
    first, rest = archive({
        "scripts/soundscapes_manifest.txt": b"scripts/soundscapes_m1.txt\n", "scripts/soundscapes_m1.txt": b'"s" { "wave" "amb/w.wav" }', "sound/amb/w.wav": b"RIFF", "scripts/vscripts/start.nut": b'IncludeScript("more")',
        "scripts/vscripts/more.nut": b'PrecacheModel("models/a.mdl")', "models/a.mdl": b"IDST", "models/a.phy": b"x", "unused.vtf": b"v", "scripts/vscripts/deep.nut": b"",
    }, {"scripts/vscripts/more.nut", "scripts/vscripts/start.nut"})
    (r / "pak01_dir.vpk").write_bytes(first)
    (r / "pak01_000.vpk").write_bytes(rest)
    (r.parent / "update" / "up_dir.vpk").write_bytes(archive({"unused.vtf": b"newer?"})[0])
    (r / "addons" / "b.vpk").write_bytes(archive({"models/a.mdl": b"other", "addoninfo.txt": b'"AddonInfo" { addonTitle "Bee" addonDependencies { "ghost" "1" } }', "scripts/vscripts/s.nuc": secret})[0])
    (r / "addons" / "c.vpk").write_bytes(archive({"unused.vtf": b"off"})[0])
    (r / "addons" / "workshop" / "d.vpk").write_bytes(archive({"models/a.mdl": b"third"})[0])
    (r / "addons" / "disable" / "e.vpk").write_bytes(archive({"lost.txt": b"z"})[0])
    (r / "addons" / "bad.vpk").write_bytes(b"no archive")
    return r


def test_plan(spark, root):
    plan = game.plan_sources(spark, root)
    got = {r.name: (r.priority, r.source_type, r.enabled, r.disabled) for r in plan.archives.collect()}
    assert got["pak01_dir.vpk"] == (100, "vpk", True, False) and got["up_dir.vpk"] == (99, "vpk", True, False) and got["e.vpk"] == (-1000, "addon", False, True)
    assert got["b.vpk"][0] == 1004 and got["c.vpk"] == (1003, "addon", False, True) and got["d.vpk"][0] == 1002 and got["bad.vpk"][0] == 1001
    assert [(p.name, n) for p, n in plan.loose] == [("game", 100)]


def test_catalogue(spark, root, tmp_path):
    c, engine = game.build_catalog(spark, root, "l4d2", with_impact=True, cache_dir=str(tmp_path / "c"))
    assert not engine.errors
    files = {(r.virtual_path, r.source_name): r for r in c["files"].collect()}
    assert files["models/a.mdl", "b.vpk"].is_active and files["models/a.mdl", "pak01_dir.vpk"].is_redundant and files["unused.vtf", "c.vpk"].is_disabled_addon
    assert ("maps/m1.bsp", "base") in files and not any("x.dll" in p for p, _ in files)
    links = {(r.from_path, r.to_path) for r in c["dependencies"].collect()}
    assert {("scripts/soundscapes_manifest.txt", "scripts/soundscapes_m1.txt"), ("scripts/vscripts/start.nut", "scripts/vscripts/more.nut"), ("scripts/vscripts/more.nut", "models/a.mdl"), ("models/a.mdl", "models/a.phy"), ("maps/m1.bsp", "scripts/soundscapes_m1.txt"), ("scripts/vscripts/s.nuc", "scripts/vscripts/deep.nut")} <= links
    entries = {r.virtual_path: r.source_type for r in c["entry_points"].collect()}
    assert entries == {"scripts/soundscapes_manifest.txt": "manifest", "scripts/soundscapes_m1.txt": "soundscape", "scripts/vscripts/start.nut": "script", "scripts/vscripts/more.nut": "script"}
    dead = {r.virtual_path for r in c["files"].filter("is_dead").collect()}
    assert {"unused.vtf", "maps/m1.bsp"} <= dead and not dead & {"sound/amb/w.wav", "models/a.phy", "models/a.mdl"}
    assert {r.addon_id: r.name for r in c["addons"].collect()}["b.vpk"] == "Bee"
    assert any(r.to_path == "ghost" and r.actual_source == "MISSING" for r in c["dep_conflicts"].collect())
    again, _ = game.build_catalog(spark, root, "l4d2", cache_dir=str(tmp_path / "c"), strategy="mtime", maps=["m1"])
    assert {(r.from_path, r.to_path) for r in again["dependencies"].collect()} == links
    assert "maps/m1.bsp" in {r.virtual_path for r in again["entry_points"].collect()}
    own, _ = game.build_catalog(spark, root, entry_points=["scripts/vscripts/start.nut", "nowhere"])
    assert {r.virtual_path for r in own["entry_points"].collect()} == {"scripts/vscripts/start.nut"}


def test_command_line_over_a_folder(spark, root, tmp_path, capsys):
    (tmp_path / "white.txt").write_text("whitelist\n{\n\tmodels/...\n}\n")
    base = ["--game-root", str(root), "--game", "l4d2", "--report-dir", str(tmp_path)]
    assert main([*base, "--analyze", "--check-models", "--sv-pure", str(tmp_path / "white.txt"), "--graphviz", str(tmp_path / "g.dot"), "--query", '{"select": ["virtual_path", "is_pure_allowed"], "from": "files"}', "--format", "csv"]) == 0
    text = capsys.readouterr().out
    assert "hash_conflicts: 1" in text and "models/a.mdl,True" in text and "unused.vtf,False" in text and (tmp_path / "g.dot").read_text().startswith("digraph")
    assert main([*base, "--external", "addons/workshop/d.vpk", "--vpk-priority", "highest"]) == 0
    report = json.loads(next(tmp_path.glob("external_d_*.json")).read_text())
    assert report["total_files"] == 1 and report["priority"] == 2000 and report["external_overrides"][0]["virtual_path"] == "models/a.mdl" and report["external_new_files"] == []
    capsys.readouterr()
    assert main([*base, "--compare-maps", str(root / "pak01_dir.vpk"), "--query", "hash_conflicts"]) == 0
    assert main([*base, "--external", "nothing.vpk"]) == 1 and main([]) == 2
    assert {x for x in ("--cpu", "--nolimit", "--clean-cache", "--check-manifests", "--ref-query")} <= {o for a in parser()._actions for o in a.option_strings}


def test_pages():
    lines = [str(i) for i in range(7)]
    asked = []
    assert list(pages(lines, 3, lambda _: asked.append(1) or "")) == lines and len(asked) == 2
    assert list(pages(lines, 3, lambda _: "q")) == lines[:3] and list(pages(lines, 0)) == lines


def test_cipher():
    """The published test vector of the cipher's smallest level, and blocks that are not full."""
    key, plain = bytes.fromhex("deadbeef01234567"), bytes.fromhex("fedcba9876543210")
    assert ice.encrypt(plain, key).hex() == "de240d83a00a9cc0"
    for n in range(20):
        assert ice.decrypt(ice.encrypt(bytes(range(n)), key), key) == bytes(range(n))


def test_models_and_maps():
    head = bytearray(300)
    head[:4] = b"IDST"
    struct.pack_into("<ii", head, X.MODEL_TEXTURES, 2, 300)
    struct.pack_into("<ii", head, X.MODEL_FOLDERS, 1, 428)
    body = bytearray(128)
    struct.pack_into("<i", body, 0, 132 + 10)
    struct.pack_into("<i", body, 64, 68 + 14)
    raw = bytes(head) + bytes(body) + struct.pack("<i", 450) + b"\0" * 10 + b"one\0two\0models\\a\\\0"
    assert X.model_links(raw) == ["materials/models/a/one.vmt", "materials/models/a/two.vmt"] and X.model_links(b"nope") == []
    lumps = {X.ENTITIES: b'{ "classname" "point_servercommand" "Command" "exec own; say x" }\n{ "classname" "light" "command" "exec no" }\0', X.TEXTURE_NAMES: b"brick/a\0tile\0", X.TEXTURE_TABLE: struct.pack("<ii", 0, 8)}
    at, out, data = 8 + 16 * 64, bytearray(8 + 16 * 64), b""
    out[:4] = b"VBSP"
    for i, d in lumps.items():
        struct.pack_into("<ii", out, 8 + 16 * i, at + len(data), len(d))
        data += d
    props = at + len(data) + 20
    struct.pack_into("<ii", out, 8 + 16 * X.GAME_LUMP, at + len(data), 20)
    data += struct.pack("<i", 1) + struct.pack("<iHHii", X.STATIC_PROPS, 0, 5, props, 132) + struct.pack("<i", 1) + b"models/p.mdl".ljust(X.PROP_NAME, b"\0")
    assert X.map_links(bytes(out) + data) == ["cfg/own.cfg", "materials/brick/a.vmt", "materials/tile.vmt", "models/p.mdl"]
    assert X.map_links(b"VBSP") == []


def test_known_entry_points():
    assert A.known_entry_points("") == [] and "scripts/melee/melee_manifest.txt" in A.known_entry_points("L4D2") and "scripts/melee/melee_manifest.txt" not in A.known_entry_points("hl2")


def test_checks_filter_conflicts(spark):
    from palimpsest.catalog import SCHEMAS, Catalog

    c = Catalog(spark, {"dep_conflicts": spark.createDataFrame([("a.vmt", "b.mdl", "s", "t"), ("c.nut", "d.nut", "s", "t")], SCHEMAS["dep_conflicts"])})
    assert [r.from_path for r in checked(c, {".mdl"})["dep_conflicts"].collect()] == ["a.vmt"]


def test_a_failing_action_is_its_analyzers_own(spark):
    from pyspark.sql import functions as F

    from palimpsest.catalog import Catalog

    lazy = lambda c: {"x": spark.range(1).select(F.raise_error(F.lit("late")).alias("e"))}
    engine = A.Engine([("late", lazy), ("fine", lambda c: {"y": spark.range(2)})])
    c = engine.run(Catalog(spark))
    assert set(engine.errors) == {"late"} and c["y"].count() == 2 and "x" not in c.relations
