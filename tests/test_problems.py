"""Hierarchies, orphan references, heavy keys: brute force on small fixtures with nulls, ties, repeats and empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.pathkey import fold_text, is_blank, path_key
from palimpsest.operators import skew
from palimpsest.operators.components import connected_components
from palimpsest.operators.hierarchy import descendants, extra_links, hierarchy, loops
from palimpsest.operators.orphans import orphan_counts, orphan_references
from palimpsest.operators.skew import pack, per_key_stats, skew_join
from palimpsest.scratch import scratch_root

T = dt.datetime


def test_path_key(spark):
    same = ["Scripts\\Ünter/A b.NUT", "scripts/ünter/ab.nut", "ｓcripts//ünt​er_a-b.nut", "SCRIPTS ÜNTER AB NUT"]
    other = ["scripts/unter/ab.nut", "scripts/ünter/ab2.nut"]
    blank = [None, "", "  ", "　 \t"]
    rows = [(i, p) for i, p in enumerate(same + other + blank + ["///"])]
    got = [r.k for r in spark.createDataFrame(rows, "i int, p string").orderBy("i").select(path_key(F.col("p")).alias("k")).collect()]
    assert len(set(got[:4])) == 1 and got[0] == fold_text(same[0]) and len(set(got[:6])) == 3
    assert got[6:10] == [None] * 4 and got[10] == ""
    assert spark.range(1).select(is_blank(F.lit(None).cast("string"))).first()[0] is True


def test_scratch_folder(spark):
    assert scratch_root(spark).startswith("file:") or scratch_root(spark).startswith("/")


def links(spark, pairs):
    return spark.createDataFrame([(*p, 1) for p in pairs], "parent string, child string, path int")


PAIRS = [("r", "a"), ("r", "a"), ("a", "b"), ("b", "c"), ("r", "d"), ("y", "x"), ("x", "y"), ("y", "u"), ("u", "v"), ("s", "s"), ("s", "t"), (None, "n"), ("m", None), ("é", "ж"), ("Z", "é")]
WANT = {
    "r": ("r", 0, ["r"]), "a": ("r", 1, ["r", "a"]), "b": ("r", 2, ["r", "a", "b"]), "c": ("r", 3, ["r", "a", "b", "c"]), "d": ("r", 1, ["r", "d"]),
    "x": ("x", -1, ["x", "y"]), "y": ("x", -1, ["x", "y"]), "u": ("x", -2, ["x", "y", "u"]), "v": ("x", -2, ["x", "y", "u", "v"]), "s": ("s", -1, ["s"]), "t": ("s", -2, ["s", "t"]),
    "Z": ("Z", 0, ["Z"]), "é": ("Z", 1, ["Z", "é"]), "ж": ("Z", 2, ["Z", "é", "ж"]),
}


@pytest.mark.parametrize("bound", [500_000, 1])
def test_hierarchy(spark, bound):
    h = hierarchy(links(spark, PAIRS), local_bound=bound)
    got = {r.node: (r.root, r.depth, r.path) for r in h.collect()}
    want = WANT if bound > 1 else {n: (r, d, p if d >= 0 or n in "st" else None) for n, (r, d, p) in WANT.items()}
    if bound == 1:  # components above the bound give no path on or below loops
        want = {n: (r, d, None if d < 0 else p) for n, (r, d, p) in WANT.items()}
        got = {n: (r, d, None if d < 0 else p) for n, (r, d, p) in got.items()}
    assert got == want


def test_hierarchy_views(spark):
    h = hierarchy(links(spark, PAIRS))
    below = {(r.node, r.descendant) for r in descendants(h).collect()}
    assert {d for n, d in below if n == "r"} == {"a", "b", "c", "d"} and {d for n, d in below if n == "y"} == {"x", "u", "v"} and ("s", "s") not in below
    assert {(r.root, r.length) for r in loops(h).collect()} == {("x", 2), ("s", 1)}
    several = links(spark, [("p", "c"), ("q", "c"), ("q", "c")])
    assert {(r.parent, r.child) for r in extra_links(several).collect()} == {("q", "c")}
    assert {r.node: r.depth for r in hierarchy(several, with_path=False).collect()} == {"p": 0, "c": 1}
    assert hierarchy(links(spark, []).limit(0)).count() == 0


def test_long_chain_and_components(spark):
    n = 700
    chain = spark.range(n).select(F.concat(F.lit("n"), F.format_string("%05d", "id")).alias("parent"), F.concat(F.lit("n"), F.format_string("%05d", F.col("id") + 1)).alias("child"))
    got = {r.node: r.depth for r in hierarchy(chain, with_path=False).collect()}
    assert got == {f"n{i:05d}": i for i in range(n + 1)}
    pairs = [(random.Random(i).randrange(60), random.Random(i + 1000).randrange(60)) for i in range(40)]
    comp = {r.id: r.component for r in connected_components(spark.createDataFrame([*pairs, (None, 3)], "u int, v int")).collect()}
    parent = {x: x for p in pairs for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert comp == {x: top(x) for x in parent}


def brute_orphans(refs, parents, always):
    out = set()
    for tab, i, k, t in refs:
        if k is None or k in always:
            continue
        at = t or T.max
        own = [(a or T.max, b or T.max) for key, a, b in parents if key == k]
        begun = [b for a, b in own if a <= at and not (a == T.max and t)]
        state = "missing" if not own else "later" if not begun else None if any(b > at or (b == T.max) for b in begun) else "removed"
        if state:
            out.add((tab, i, t.strftime("%Y-%m") if t else None, state))
    return out


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    when = lambda: T(2024, rnd.randrange(1, 13), rnd.randrange(1, 4), rnd.randrange(0, 3))
    parents = [(rnd.choice("abcdefg"), s := when(), rnd.choice([None, s + dt.timedelta(days=rnd.randrange(0, 60))])) for _ in range(40)]
    parents += [("h", None, None), (None, when(), None), ("i", T(2024, 3, 1), T(2024, 5, 1)), ("i", T(2024, 3, 1), T(2024, 5, 1))]
    refs = [("t", i, rnd.choice("abcdefghij"), when()) for i in range(300)] + [("u", 1, "i", T(2024, 4, 30, 23, 59, 59, 999999)), ("u", 2, "i", T(2024, 5, 1)), ("u", 3, "i", T(2024, 3, 1)), ("u", 4, None, when()), ("u", 5, "z", None), ("u", 6, "i", None), ("u", 7, "ext", when())]
    r = spark.createDataFrame(refs, "tab string, ref_id long, key string, t timestamp_ntz").withColumn("p", F.lit("clash")).withColumn("id", F.lit(1))
    p = spark.createDataFrame(parents, "key string, t_from timestamp_ntz, t_to timestamp_ntz").withColumn("w", F.lit(0))
    x = spark.createDataFrame([("ext",), (None,)], "key string")
    got = [tuple(row) for row in orphan_references(r, p, x).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_orphans(refs, parents, {"ext"})
    counts = orphan_counts(orphan_references(r, p, x)).agg(F.sum("n")).first()[0]
    assert counts == len(got)
    assert orphan_references(r.limit(0), p, x).count() == 0
    assert {row.state for row in orphan_references(r, p.limit(0)).collect()} == {"missing"}
    far = spark.createDataFrame([("t", i, "k", T(1990 + i, 1, 1)) for i in range(20)], "tab string, ref_id long, key string, t timestamp_ntz")  # 19 years: several masks
    alive = spark.createDataFrame([("k", T(1995, 1, 1), T(2001, 6, 1))], "key string, t_from timestamp_ntz, t_to timestamp_ntz")
    assert {(row.ref_id, row.state) for row in orphan_references(far, alive).collect()} == {(i, "later") for i in range(5)} | {(i, "removed") for i in range(12, 20)}


@pytest.mark.parametrize("hot", [0, 1_000_000])
def test_orphans_of_a_key_that_holds_most_rows_of_one_day(spark, monkeypatch, hot):
    """A hot key on a single day, with lives that begin and end within it: cut over partitions, judged as by brute force."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rnd = random.Random(21)
    at = lambda: T(2024, 5, 7, 0, 0, 0) + dt.timedelta(seconds=rnd.randrange(0, 3000))
    parents = [("hot", s := at(), s + dt.timedelta(seconds=rnd.randrange(1, 25))) for _ in range(60)] + [("cold", T(2024, 5, 7), None)]
    refs = [("t", i, "hot", at()) for i in range(1500)] + [("t", 5000 + i, "hot", T(2024, 5, 7, 0, 10)) for i in range(200)] + [("u", i, rnd.choice(["cold", "gone"]), at()) for i in range(100)]
    r = spark.createDataFrame(refs, "tab string, ref_id long, key string, t timestamp_ntz").withColumn("part", F.lit("clash"))
    p = spark.createDataFrame(parents, "key string, t_from timestamp_ntz, t_to timestamp_ntz")
    got = [tuple(row) for row in orphan_references(r, p).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_orphans(refs, parents, set())


def test_heavy_keys_against_plain_grouping(spark):
    rnd = random.Random(5)
    rows = [("hot", rnd.choice(["v", None, "w"]), T(2024, 1, 1 + i % 9)) for i in range(400)] + [("hot", "same", T(2024, 2, 1))] * 300 + [(rnd.choice("abcdefgh"), str(rnd.randrange(5)), None) for _ in range(200)] + [(None, "n", T(2023, 1, 1))] * 150
    df = spark.createDataFrame(rows, "k string, v string, t timestamp_ntz").withColumn("_bin", F.lit(9)).withColumn("n", F.lit(0))
    p = pack(df, "k")
    assert set(p.heavy) == {"hot", None} and p.total == len(rows) and max(p.loads) <= 2 * p.total / p.tasks
    got = {tuple(r) for r in per_key_stats(df, "k", "v", "t", packing=p).collect()}
    want = {tuple(r) for r in df.groupBy("k").agg(F.count(F.lit(1)), F.countDistinct("v"), F.min("t"), F.max("t")).collect()}
    assert got == want
    assert per_key_stats(df.limit(0), "k", "v", "t").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(200)] + [("a", 1), ("b", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("hot", "p"), ("hot", "q"), ("a", "r"), (None, "s"), ("zz", "t")], "k string, y string")
    assert sorted(map(str, skew_join(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    with pytest.raises(ValueError):
        skew_join(left, right, "k", "full")


def test_registry_is_whole():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p2_found", "p5_found", "p6_found"} <= set(e.queries())


def test_hierarchy_is_the_same_above_the_bound(spark):
    rnd = random.Random(7)
    ring = [(f"k{(i * 7) % 11:02d}", f"k{((i + 1) * 7) % 11:02d}") for i in range(11)]  # order on the loop is not that of the names
    below = [(f"k{rnd.randrange(11):02d}" if i < 5 else f"b{rnd.randrange(i):02d}", f"b{i:02d}") for i in range(30)]
    e = links(spark, PAIRS + ring + below)
    far, near = hierarchy(e, local_bound=1), hierarchy(e)
    got, want = ({r.node: (r.root, r.depth, r.path) for r in h.collect()} for h in (far, near))
    assert got == want and {n: got[n] for n in WANT} == WANT
    assert sorted(map(tuple, descendants(far).collect())) == sorted(map(tuple, descendants(near).collect()))
    assert {(r.root, r.length) for r in loops(far).collect()} == {("x", 2), ("s", 1), ("k00", 11)}


def test_hot_centres_of_components(spark, monkeypatch):
    """Stars whose centres are joined by themselves give the components that plain joins give."""
    from palimpsest.operators import components

    pairs = [(1, i) for i in range(2, 120)] + [(200, i) for i in range(201, 260)] + [(259, 400), (400, 401), (500, 501)]
    e = spark.createDataFrame(pairs, "u int, v int")
    want = {tuple(r) for r in connected_components(e).collect()}
    monkeypatch.setattr(components, "HOT", 10)
    assert {tuple(r) for r in connected_components(e).collect()} == want and {c for _, c in want} == {1, 200, 500}


def test_deep_chains_and_bushy_loops():
    """Walks keep one open line; a loop with trees below each of its nodes."""
    from palimpsest.operators.hierarchy import traverse, traverse_flat

    chain = {f"n{i + 1}": f"n{i}" for i in range(3000)}
    got = {n: (d, len(p), p[0]) for n, _, d, p in traverse(chain)}
    assert got == {f"n{i}": (i, i + 1, "n0") for i in range(3001)}
    rnd = random.Random(31)
    loop = {"b": "a", "c": "b", "a": "c"} | {f"x{i}": rnd.choice(["a", "b", "c"] + [f"x{j}" for j in range(i)]) for i in range(60)} | {"s": "s", "t": "s"}
    rows = list(traverse(loop))
    assert len(rows) == len({r[0] for r in rows}) == 65
    assert {(n, r, d) for n, r, d, _ in rows} == set(traverse_flat(loop))
    for n, r, d, p in rows:
        assert p[0] == r and (d == -1 or p[-1] == n and (p[-2] == loop[n] or p[-2] == p[len(p) - 2] and loop[n] in p[:3]))


def test_scratch_scope(spark):
    from palimpsest import scratch

    kept = scratch.materialize(spark.range(3).toDF("id"), "kept")
    with scratch.scope():
        gone = scratch.materialize(spark.range(3).toDF("id"), "gone")
        assert gone.count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone._scratch_path).count()
