"""Graph, overlay, analyzers, extraction, sources and sinks on small fixtures."""

import io
import json
import random
import struct
import tracemalloc
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.catalog import Catalog
from palimpsest.functions import extract as X
from palimpsest.functions.keyvalues import leaves
from palimpsest.operators import analyzers as A
from palimpsest.operators import graph as G
from palimpsest.operators.overlay import prioritise, resolve, what_if
from palimpsest.operators.relation import Relation
from palimpsest.plans import refqueries
from palimpsest.sinks import cache, reports
from palimpsest.sources import archives, settings as cfg


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


GRAPH = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("d", "e"), ("a", "b"), (None, "z"), ("q", None)]


def below(pairs, n):
    """Strict descendants by plain search."""
    seen, todo = set(), [n]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen - {n}


@pytest.mark.parametrize("bound", [G.STRIPPED_BY_ONE, 0])
def test_closures_against_a_plain_search(spark, monkeypatch, bound):
    monkeypatch.setattr(G, "STRIPPED_BY_ONE", bound)
    e = edges(spark, GRAPH)
    pairs = [p for p in GRAPH if None not in p]
    g = {x for p in pairs for x in p}
    for n in ("a", "d", "e", "x"):
        assert {r.id for r in G.descendants_of(e, n).collect()} == below(pairs, n), n
    assert {r.id for r in G.ancestors_of(e, "e").collect()} == below([(b, a) for a, b in pairs], "e")
    assert G.has_path(e, "a", "e") and not G.has_path(e, "e", "a") and G.has_path(e, "x", "x") and not G.has_path(e, "nobody", "a")
    got = {(tuple(r.cycle), r.length) for r in G.elementary_cycles(e).collect()}
    assert got == {(("a", "b", "c"), 3), (("x",), 1)}
    assert {(r.id, r.impact_count) for r in G.impact_counts(e).collect()} == {(n, len(below(pairs, n))) for n in g}


@pytest.mark.parametrize("bound", [G.LINKS_BY_ONE, 0])
def test_impact_counts_against_a_plain_search(spark, bound):
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(70)] + [(f"d{i}", f"d{j}") for i in range(14) for j in range(i)] + [("d0", "n1"), ("s", "s")]
    got = {r.id: r.impact_count for r in G.impact_counts(edges(spark, pairs), links_by_one=bound).collect()}
    assert got == {n: len(below(pairs, n)) for n in {x for p in pairs for x in p}}
    assert G.impact_counts(edges(spark, pairs).limit(0), links_by_one=bound).count() == 0


def tiers(n, loops=1):
    """Nodes above a hub, a loop, and below it, with links past it and some further loops: most pairs run over the hub."""
    rnd = random.Random(n)
    hub = [(f"h{i}", f"h{(i + 1) % 5}") for i in range(5)]
    up = [(f"u{i}", f"u{rnd.randrange(i)}" if i % 3 else f"h{i % 5}") for i in range(n)]
    down = [(f"h{i % 5}" if i % 3 == 0 else f"d{rnd.randrange(i)}", f"d{i}") for i in range(n)]
    past = [(f"u{rnd.randrange(n)}", f"x{rnd.randrange(9)}") for _ in range(n // 4)] + [(f"x{rnd.randrange(9)}", f"d{rnd.randrange(n)}") for _ in range(9)]
    return hub + up + down + past + [(f"u{i}", f"u{i + 3}") for i in range(0, 9 * loops, 3)] + [("x1", "x2"), ("x2", "x1"), ("y", "y")]


@pytest.mark.parametrize("most", [0, 400, 3000, G.MOST_PAIRS])
def test_counts_below_hubs_in_one_task(most):
    pairs = tiers(60) + [(f"{a}'", f"{b}'") for a, b in tiers(40)]
    names = sorted({x for p in pairs for x in p})
    a, b = (np.array([names.index(p[i]) for p in pairs]) for i in (0, 1))
    comp, size, up, down, height = G._condensed(a, b, len(names))
    counts = size - 1
    done = G._add_below(up, down, height, size, np.ones(len(size), bool), counts, most)
    assert done == (most > 0)
    if done:
        assert dict(zip(names, counts[comp].tolist())) == {n: len(below(pairs, n)) for n in names}


def test_counts_below_hubs_of_graphs_that_share_sinks(spark, monkeypatch):
    """Many graphs, each with a hub, that only a blank reference links with one another: still one task, and no sweeps."""
    monkeypatch.setattr(G, "_sweep", lambda parts: pytest.fail("swept"))
    pairs = [(f"{a}.{k}", f"{b}.{k}") for k in range(12) for a, b in tiers(40)] + [(f"u{i}.{k}", to) for k in range(12) for i in range(0, 40, 3) for to in ("", " ")]
    pairs += [("", "loop"), ("loop", "")]
    got = {r.id: r.impact_count for r in G.impact_counts(edges(spark, pairs), most=3000).collect()}
    assert got == {n: len(below(pairs, n)) for n in {x for p in pairs for x in p}}


def test_counts_of_random_graphs_divided_to_the_end(monkeypatch):
    """Small lists and no bound on links: every way through the division, against plain searches."""
    rnd = random.Random(8)
    for n, links in ((9, 12), (40, 70), (150, 300), (300, 500)):
        for most in (1, 30, 2000):
            pairs = sorted({(rnd.randrange(n), rnd.randrange(n) if rnd.random() < 0.1 else rnd.randrange(max(1, n // 8))) for _ in range(links)} | {(i, i + 1) for i in range(n)})
            pairs = [(a, b) for a, b in pairs if a < b or rnd.random() < 0.1]
            names = sorted({x for p in pairs for x in p})
            a, b = (np.array([names.index(p[i]) for p in pairs]) for i in (0, 1))
            comp, size, up, down, height = G._condensed(a, b, len(names))
            counts = size - 1
            if G._add_below(up, down, height, size, np.ones(len(size), bool), counts, most):
                assert dict(zip(names, counts[comp].tolist())) == {x: len(below(pairs, x)) for x in names}
            else:
                assert most < 2000


def test_ends_of_links_are_numbered_in_little_memory(monkeypatch):
    monkeypatch.setattr(G, "ENDS_AT_ONCE", 20_000, raising=False)
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(-(1 << 62), 1 << 62, 9_000)[rnd.integers(0, 9_000, (2, 400_000))]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 10_000]) for x in (a, b)], ["a", "b"]) for i in range(0, len(a), 10_000)]
    tracemalloc.start()
    ids, x, y = G._ends(iter(batches))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ids[1:] > ids[:-1]).all() and (ids[x] == a).all() and (ids[y] == b).all()
    assert most < 36 * len(a), most / len(a)


def test_strong_components_number_links_downwards():
    rnd = random.Random(6)
    for n, links in ((1, 1), (30, 25), (60, 80), (200, 260)):
        pairs = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(links)} | {(i + 1, i) for i in range(0, n - 1, 3)})
        comp = G.strong_components(*np.array(pairs).T, n)
        reach = {x: below(pairs, x) for x in range(n)}
        assert all((comp[x] == comp[y]) == (x == y or (y in reach[x] and x in reach[y])) for x in range(n) for y in range(n))
        assert all(comp[x] >= comp[y] for x, y in pairs) and set(comp) == set(range(max(comp) + 1))


def test_impact_counts_by_sweeps_where_pairs_are_too_many(spark):
    pairs = tiers(60)
    got = {r.id: r.impact_count for r in G.impact_counts(edges(spark, pairs), most=0).collect()}
    assert got == {n: len(below(pairs, n)) for n in {x for p in pairs for x in p}}


def test_impact_counts_part_nodes_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(G, "_hash", lambda column, seed: F.xxhash64(F.col(column), F.lit(seed)) if seed > 1 else F.pmod(F.xxhash64(column), F.lit(7)))
    pairs = tiers(20)
    got = {r.id: r.impact_count for r in G.impact_counts(edges(spark, pairs)).collect()}
    assert got == {n: len(below(pairs, n)) for n in {x for p in pairs for x in p}}


def test_top_impact_takes_no_copies_of_the_links(spark, monkeypatch):
    """The counts of a graph whose pairs run over a hub come from one task, without a copy of the links for every task."""
    swept = []
    monkeypatch.setattr(G, "_sweep", lambda parts: swept.append(parts))
    pairs = tiers(60)
    files = spark.createDataFrame([(n, "s", True) for n in ("u5", "u1", "d59", "none")], "virtual_path string, source_name string, is_winner boolean")
    got = [tuple(r) for r in A.impact(files, edges(spark, pairs), 3).collect()]
    counts = {n: len(below(pairs, n)) for n in ("u5", "u1", "d59", "none")}
    assert got == [(n, "s", c) for n, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:3]
    assert not swept


def test_sweeps_over_many_blocks(spark, monkeypatch):
    """A long chain with side branches, over more components than one sweep holds, on several tasks."""
    n = 5000
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(n)] + [(f"c{i}", f"x{i}") for i in range(0, n, 7)] + [("c10", "c9"), ("x14", "c14")]
    got = {r.id: r.impact_count for r in G.impact_counts(edges(spark, pairs)).collect()}
    for node in ("c0", "c9", "c10", "x14", "x7", f"c{n}", f"c{n - 8}", "c2500"):
        assert got[node] == len(below_fast(pairs, node)), node
    assert len(got) == len({x for p in pairs for x in p})


def below_fast(pairs, n):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    seen, todo = set(), [n]
    while todo:
        for b in out.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen - {n}


@pytest.mark.parametrize("bound", [G.STRIPPED_BY_ONE, 0])
def test_reached_by_other(spark, monkeypatch, bound):
    monkeypatch.setattr(G, "STRIPPED_BY_ONE", bound)
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(48)]
    few = {"n1", "n5", "n9", "n30", "absent"}
    want = {b for b in {x for p in pairs for x in p} for a in few - {b} if b in below(pairs, a)}
    assert {r.id for r in G.reached_by_other(edges(spark, pairs), spark.createDataFrame([(x,) for x in few], "id string")).collect()} == want
    assert {r.id for r in G.reachable(edges(spark, pairs), spark.createDataFrame([("n1",), ("n1",), (None,)], "id string")).collect()} - {"n1"} == below(pairs, "n1")
    assert G.reached_by_other(edges(spark, pairs).limit(0), edges(spark, pairs).select(F.col("src").alias("id"))).count() == 0
    e = edges(spark, [("s", "a"), ("a", "s"), ("t", "s"), ("u", "u")])
    seeds = spark.createDataFrame([("s",), ("u",), ("t",)], "id string")
    assert {r.id for r in G.reached_by_other(e, seeds).collect()} == {"a", "s"}  # t has no way in, u only reaches itself


def nodes(spark, rows):
    return spark.createDataFrame(rows, "ordinal long, virtual_path string, source_name string, priority int, file_hash string, is_enabled boolean")


def test_overlay(spark):
    rows = [(1, "A\\x", "s1", 5, "h1", True), (2, "a/X", "s2", 5, "h2", True), (3, "a/x", "s3", 9, "h3", False), (4, "b", "s1", None, None, True), (5, "c", "s1", 1, "h", False), (6, None, "s", 1, "h", True), (7, "b", "s2", -4, "h", None)]
    got = {r.ordinal: (r.is_winner, r.is_redundant) for r in resolve(nodes(spark, rows), "ordinal").collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, True), 4: (True, False), 5: (False, False), 6: (False, False), 7: (False, True)}
    more = what_if(nodes(spark, rows), nodes(spark, [(1, "a/x", "ref", 0, "z", True)]), "ordinal", 2000)
    assert {r.source_name for r in more.filter("is_winner and lower(virtual_path) like 'a%'").collect()} == {"ref"}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-2, 2), st.booleans()), min_size=1, max_size=12))
def test_overlay_against_a_loop(spark, specs):
    rows = [(i, p, "s", pr, "h", en) for i, (p, pr, en) in enumerate(specs)]
    got = {r.ordinal for r in resolve(nodes(spark, rows), "ordinal").filter("is_winner").collect()}
    want = set()
    for p in {r[1] for r in rows}:
        ok = [r for r in rows if r[1] == p and r[5]]
        if ok:
            want.add(max(ok, key=lambda r: (r[3], -r[0]))[0])
    assert got == want


def test_assemble_runs_all_analyzers(spark):
    rows = [(1, "maps/m.bsp", "mod", 9, "h1", True), (2, "maps/m.bsp", "base", 1, "h2", True), (3, "maps/m.bsp", "x_dir", 0, "h3", True), (4, "models/a.mdl", "mod", 1, "h", True), (5, "scripts/g.nut", "s", 1, "h", True), (6, "lost.txt", "s", 1, "h", True), (7, "models/a.phy", "base", 1, "h", True)]
    records = nodes(spark, rows).withColumn("source_type", F.lit("vpk")).withColumn("file_size", F.lit(1).cast("long"))
    c = Catalog(spark, {"entry_points": spark.createDataFrame([("maps/m.bsp", "map")], "virtual_path string, source_type string")}, edges(spark, [("maps/m.bsp", "MODELS/a.mdl"), ("maps/m.bsp", "scripts/g.nut"), ("maps/m.bsp", "gone.vmt"), ("scripts/g.nut", "maps/m.bsp")]))
    c, engine = A.assemble(c, records, "ordinal", with_impact=True)
    assert not engine.errors
    assert {r.virtual_path for r in c["files"].filter("is_dead").collect()} == {"models/a.mdl", "lost.txt", "models/a.phy"}
    assert {(r.loser_source, r.severity) for r in c["hash_conflicts"].collect()} == {("base", "info"), ("x_dir", "info")}
    assert {(r.to_path, r.actual_source) for r in c["dep_conflicts"].collect()} == {("gone.vmt", "MISSING"), ("scripts/g.nut", "s"), ("maps/m.bsp", "mod")}
    assert c["cascade_overrides"].first().chain_sources == ["mod", "base", "x_dir"]
    assert {(r.dependent_addon, r.provider_addon) for r in c["implicit_deps"].collect()} == {("mod", "s"), ("s", "mod")}
    assert {r.source_name: r.mod_type for r in c["mod_types"].collect()}["mod"] == "map"
    assert c["impact"].first().virtual_path in ("maps/m.bsp", "scripts/g.nut")
    assert {(r.src, r.dst) for r in A.synthetic_edges(c["nodes"]).collect()} == {("models/a.mdl", "models/a.phy")}
    s = reports.summary(c)
    assert s["dead_files"] == 3 and s["redundancy"] == 2
    bad = A.Engine([("broken", lambda c: 1 / 0), ("fine", lambda c: {"x": c["files"]})])
    assert "x" in bad.run(c).relations and "broken" in bad.errors


def test_prioritise(spark):
    rows = [("b", None), ("a", None), ("z", 1), ("y", 0)]
    df = spark.createDataFrame(rows, "name string, listed_order int")
    assert {r.name: r.priority for r in prioritise(df).collect()} == {"y": 1004, "z": 1003, "b": 1002, "a": 1001}
    assert {r.name: r.priority for r in prioritise(df, False).collect()} == {"y": 1000, "z": 999, "a": 998, "b": 997}


def test_keyvalues():
    text = '// c\n"A" { "k" "1" "k" "2" b { x y } }\n} "top" "v" { unclosed'
    assert leaves(text) == [(("a", "k"), "1"), (("a", "k"), "2"), (("a", "b", "x"), "y"), (("top",), "v")]
    assert leaves(None) == [] and leaves("") == []


def bsp(files):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, d in files.items():
            z.writestr(n, d)
    head = bytearray(8 + 16 * 64)
    head[:4] = b"VBSP"
    struct.pack_into("<ii", head, 8 + 16 * X.PAK_LUMP, len(head), len(buf.getvalue()))
    return bytes(head) + buf.getvalue()


CONTENTS = {
    "m.vmt": (b'"$basetexture" "brick\\w1"\n$BUMPMAP "materials/n.vtf" "$other" "no"', {"materials/brick/w1.vtf", "materials/n.vtf"}),
    "s.nut": (b'IncludeScript( "a" ) PrecacheModel("m.mdl") PrecacheSound("x\\y.wav") IncludeScript("d/e.nut")', {"scripts/vscripts/a.nut", "m.mdl", "sound/x/y.wav", "d/e.nut"}),
    "binary.nut": (b'\xfa\xfaIncludeScript("a")', set()),
    "scripts/soundscapes_manifest.txt": (b"// c\n\n# d\n scripts/a.txt \r\n\"b\"", {"scripts/a.txt", '"b"'}),
    "scripts/game_sounds_x.txt": (b'"S" { "wave" "a.wav" "rndwave" { "wave" "b.wav" "wave" "sound/c.wav" } }', {"sound/a.wav", "sound/b.wav", "sound/c.wav"}),
    "scripts/soundscapes_m.txt": (b'"x" { "rndwave" { "wave" "amb/a.wav" } }', {"sound/amb/a.wav"}),
    "maps/m_level_sounds.txt": (b'"e" { "sound" "q.wav" }', {"sound/q.wav"}),
    "scripts/population.txt": (b'"g" { "zombie_class" "Tank" } "h" { "zombie_class" "Odd" }', {"models/infected/hulk.mdl", "models/infected/odd.mdl"}),
    "missions/c.txt": (b'"modes" { "coop" { "1" { "Map" "c1" } } }', {"maps/c1.bsp"}),
    "scripts/melee/axe.txt": (b'"w" { "viewmodel" "models\\v.mdl" "other" "x" }', {"models/v.mdl"}),
    "scripts/weapon_x.txt": (b'"WeaponData" { "playermodel" "p.mdl" "sound_fire" "f.wav" "texture" "t" "x" { "viewmodel" "no.mdl" } }', {"p.mdl", "sound/f.wav", "materials/t.vtf"}),
    "scripts/hud_textures.txt": (b'"a" "hud\\x" "b" "materials/y.vmt"', {"materials/hud/x.vtf", "materials/y.vmt"}),
    "m_sound_prefetch.txt": (b"a.wav\nsound/b.wav\n", {"sound/a.wav", "sound/b.wav"}),
    "scripts/soundmixers.txt": (b'"x" "m.wav" "p.PHY"\n{ "n.wav"', {"sound/m.wav", "p.PHY"}),
    "a.ani": (b'"MODEL" "Models\\A.MDL" "model" "b.txt"', {"models/a.mdl"}),
    "u.res": (b'"r" { "p" { "image" "i/x" "font" "resource/f.ttf" } }', {"materials/i/x.vtf", "resource/f.ttf"}),
    "p.pcf": (b'\x00materials\\e.vmt\x00material\x00\x00glow\x00', {"materials/e.vmt", "materials/glow.vmt"}),
    "maps/m.bsp": (bsp({"a.nut": 'IncludeScript("z")', "b.cfg": "exec c\n"}), {"a.nut", "b.cfg", "scripts/vscripts/z.nut", "cfg/c.cfg"}),
    "broken.bsp": (b"VBSP", set()),
    "leaf.wav": (b"data", set()),
    "empty.vmt": (b"", set()),
}


def test_extractors(spark):
    rows = [(p, bytearray(b)) for p, (b, _) in CONTENTS.items()] + [("null.vmt", None), (None, bytearray(b"x"))]
    got: dict = {}
    for r in X.extract_edges(spark.createDataFrame(rows, "virtual_path string, content binary")).collect():
        got.setdefault(r.src, set()).add(r.dst)
    assert got == {p: w for p, (_, w) in CONTENTS.items() if w}


def test_addon_info_and_decoding():
    info = X.addon_info('"AddonInfo" { "addonTitle" "T" "dependencies" { "123" "1" "x" "456.vpk" } }')
    assert info["title"] == "T" and info["dependencies"] == ["123", "456"]
    assert X.decode_text("ü".encode()) == "ü" and X.decode_text("ü".encode("cp1252")) == "ü" and X.decode_text(None) == ""


def vpk(files):
    tree = b""
    for path, (crc, size) in files.items():
        folder, _, name = path.rpartition("/")
        stem, _, ext = name.rpartition(".")
        tree += ext.encode() + b"\0" + (folder or " ").encode() + b"\0" + stem.encode() + b"\0" + struct.pack("<IHHIIH", crc, 0, 0, 0, size, 0xFFFF) + b"\0\0"
    tree += b"\0"
    return struct.pack("<III", archives.SIGNATURE, 1, len(tree)) + tree


def test_archives_and_cache(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a_dir.vpk").write_bytes(vpk({"maps/x.bsp": (0xABC, 10), "r.txt": (0, 3)}))
    (tmp_path / "d" / "bad.vpk").write_bytes(b"no")
    idx = archives.scan_archives(spark, str(tmp_path / "d"))
    assert {(r.virtual_path, r.file_size, r.file_hash) for r in idx.collect()} == {("maps/x.bsp", 10, "00000abc"), ("r.txt", 3, None)}
    assert archives.reference_files(idx, "n").columns[0] == "virtual_path"
    loose = archives.scan_folder(spark, str(tmp_path / "d"), 100)
    assert {r.virtual_path for r in loose.collect()} == {"a_dir.vpk", "bad.vpk"}
    marks = archives.fingerprint(spark, str(tmp_path / "d"))
    where = str(tmp_path / "cache")
    assert not cache.is_valid(spark, where, marks)
    cache.save(where, idx, edges(spark, [("a", "b")]), marks)
    assert cache.is_valid(spark, where, marks) and cache.load(spark, where)[1].count() == 1
    (tmp_path / "d" / "a_dir.vpk").write_bytes(vpk({"maps/x.bsp": (0xABC, 10)}))
    assert not cache.is_valid(spark, where, archives.fingerprint(spark, str(tmp_path / "d")))


def test_settings(tmp_path, spark):
    assert cfg.addon_list('﻿"AddonList"\n{\n\t"workshop\\\\a.vpk"\t\t"1"\n\t"b.vpk" "0"\n}') == [("a.vpk", True, 0), ("b.vpk", False, 1)]
    info = cfg.game_info('"GameInfo" { game "G" FileSystem { SearchPaths { Game update Game|x hl2 addonroot my_addons } } }')
    assert info.title == "G" and "update" in info.game_dirs and info.addon_roots == ["my_addons"]
    assert cfg.whitelist('whitelist\n{\n // c\n materials\\... "from_steam"\n sound/x.wav # y\n}') == ['materials\\** "from_steam"'.split('"')[0].strip(), "sound/x.wav"]
    (tmp_path / "c.toml").write_text("[a]\nmax_maps = 3\nunknown = 1\n")
    assert cfg.load_config(tmp_path / "c.toml").max_maps == 3 and cfg.load_config(None).max_maps == 0


def test_reports(spark, tmp_path):
    c = Catalog(spark)
    c.relations["isolated"] = spark.createDataFrame([("<s>", 2, ["p"])], "source_name string, dead_file_count int, example_paths array<string>")
    for fmt in reports.WRITERS:
        path = reports.write_report(c, tmp_path / fmt, fmt)
        assert path.exists()
        if fmt == "html":
            assert "&lt;s&gt;" in path.read_text()
    back = cfg.load_report(spark, reports.write_report(c, tmp_path, "json"))
    assert back["isolated"].first().dead_file_count == 2 and back["files"].count() == 0
    reports.write_relations(c, str(tmp_path / "out"), ["isolated"], "csv")
    text = reports.dot(edges(spark, [("a.bsp", 'b".vmt'), ("a.bsp", "c.x")]), most=2)
    assert text.startswith("digraph") and '\\"' in text and text.count("->") <= 2
    assert reports.table([]) == "Empty set." and "NULL" in reports.table([{"a": None}]) and "a: 1" in reports.vertical([{"a": 1}])


def test_reports_and_saved_shells_are_whole(spark, tmp_path):
    """More rows than a page of any kind: every row is in every report, and a saved shell loads as it was."""
    n = 100_100
    files = spark.range(n).select(*[(F.concat(F.lit("p"), F.col("id")) if i == 0 else F.lit(None)).cast(t.split()[1]).alias(t.split()[0]) for i, t in enumerate(cfg._columns("files"))])
    c = Catalog(spark, {"files": files})
    back = cfg.load_report(spark, reports.write_report(c, tmp_path, "json", ["files"]))
    assert back["files"].select("virtual_path").distinct().count() == n
    for fmt in ("csv", "text", "html"):
        text = reports.write_report(c, tmp_path / fmt, fmt, ["files"]).read_text()
        assert f"p{n - 1}" in text and text.count("p100") >= 101 and text.count("\n") >= n
    from palimpsest.repl import Shell

    sh = Shell(c, io.StringIO())
    sh.loop([f".save {tmp_path}/s.json", f".load {tmp_path}/s.json"])
    assert sh.catalog["files"].count() == n


def test_command_line_and_shell(spark, tmp_path, capsys):
    from palimpsest.cli import main
    from palimpsest.repl import Shell

    base = "/root/testdata/sf0.001"
    assert main(["--data", base, "--query", "file_count_by_source", "--limit", "3", "--format", "json"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 3
    assert main(["--data", base, "--query", '{"select": ["x"], "from": "files"}']) == 1
    out = io.StringIO()
    sh = Shell(Catalog.from_parquet(spark, base), out)
    sh.loop(["# c", ".tables", ".mode csv", "entry_point_types", '{"select": 1}', "nope", ".schema files", ".history", ".bogus", ".help", ".stores", f".save {tmp_path}/s.json", f".load {tmp_path}/s.json", ".echo on", ".print x", ".exit", ".never"])
    text = out.getvalue()
    assert "source_type,cnt" in text and "parse error" in text and "unknown command" in text and "never" not in text


def test_relation_algebra(spark):
    a = Relation(spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "id int, v string"), "a")
    b = Relation(spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "id int, v string"), "b")
    assert sorted(a.project("v").to_rows()) == [("x",), ("y",)] and len(a) == 3
    assert a.join(b, "id").columns == ("id", "v", "v_right") and len(a.join(b, "id")) == 2
    assert len(a.join_full(b, "id")) == 5 and a.join_right(b, "id").columns == ("id", "v_right", "v")
    assert len(a.join_theta(b, lambda l, r: l("id") < r("id"))) == 2
    assert a.distinct_count("id") == 2 and a.select_by("id", None).to_dicts() == [{"id": None, "v": "y"}]
    out, n = a.update(F.col("id") == 1, "v", "z")
    assert n == 2 and {r[1] for r in out.to_rows()} == {"z", "y"}
    assert len(a.select_where(lambda r: r["v"] == "x")) == 2 and len(a.minus(b)) == 2 and len(a.intersect(a)) == 2
    assert a.group_by(["v"], n=F.count(F.lit(1))).order_by("n", True).limit(1).to_rows() == [("x", 2)]
    with pytest.raises(KeyError):
        a.project("nope")


def test_shortest_cycles_are_exact(spark):
    pairs = [(f"n{a}", f"n{b}") for a in range(4) for b in range(4) if a != b] + [("n0", "n0"), ("n3", "t"), ("t", "u")]
    every = sorted((r.length, r.cycle) for r in G.elementary_cycles(edges(spark, pairs)).collect())
    assert [n for n, _ in every] == [1] + [2] * 6 + [3] * 8 + [4] * 6
    got = sorted((r.length, r.cycle) for r in G.elementary_cycles(edges(spark, pairs), at_least=4).collect())
    assert got == every[:7]


def test_core_is_the_same_at_every_size(spark, monkeypatch):
    e = edges(spark, GRAPH)
    core = {tuple(r) for r in G.cyclic_core(e).collect()}
    monkeypatch.setattr(G, "STRIPPED_BY_ONE", 0)
    assert core == {tuple(r) for r in G.cyclic_core(e).collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")}


def test_cycle_preset_reads_all_links(spark, monkeypatch):
    rows = [("a", "b", "include"), ("b", "a", "include"), ("m", "t", "material"), ("t", "m", "texture"), ("b", "m", "model"), ("s", "s", "sound"), ("t", "a", None), ("a", "", "include"), (None, "m", "model")]
    c = Catalog(spark, {"dependencies": spark.createDataFrame(rows, "from_path string, to_path string, dep_kind string")})
    monkeypatch.setattr(refqueries, "catalog", lambda spark, sf_dir: c)
    got = [(r.cycle, r.length) for r in refqueries.QUERIES["preset_dependency_cycles"](spark, "").collect()]
    assert sorted(got) == [("a>b", 2), ("a>b>m>t", 4), ("m>t", 2), ("s", 1)]
