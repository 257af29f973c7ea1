"""The text operators against brute force, an exact round trip and known cases."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import collapse as C
from palimpsest.llm import encodings as N
from palimpsest.llm import garbled, mixing, sentences, tokens, truth


# --- 3 ---


@pytest.mark.parametrize("partitions", [1, 7])
def test_collapse_against_a_dictionary(spark, partitions):
    rnd = random.Random(partitions)
    rows = [("hot", i) for i in range(0, 300)] + [(rnd.choice("abcdefghijk") * rnd.randrange(1, 3), 300 + i) for i in range(200)] + [("", 900), ("", 901), (None, 950), (None, 951), ("x" * 100_000, 960), ("x" * 100_000, 961), ("x" * 99_999, 962)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, id long").withColumn("first", F.lit(1)).repartition(5)
    copies, groups = C.collapse(df, partitions)
    by: dict = {}
    for k, i in rows:
        if k is not None:
            by.setdefault(k, []).append(i)
    assert sorted(tuple(r) for r in copies.collect()) == sorted((min(v), i) for v in by.values() for i in v if i != min(v))
    assert sorted(tuple(r) for r in groups.collect()) == sorted((min(v), len(v)) for v in by.values() if len(v) > 1)
    assert C.collapse(df.limit(0), 3)[0].count() == 0


def test_canonical_keys_do_not_meet(spark):
    rows = [("a", "b"), ("a1:b", None), (None, "b"), ("-", "b"), ("ab", ""), ("", "ab"), ("a", "b")]
    df = spark.createDataFrame(rows, "x string, y string").select(C.canonical(F.col("x"), F.col("y")).alias("k"))
    assert df.distinct().count() == 6


LINES = [
    '{"virtual_path": "a/B.vmt", "source_name": "ws1", "priority": 7, "file_hash": "AB12"}',
    '  "File_Hash"\t"ab12" "PRIORITY" "7" "source_name" "WS1" "virtual_path" "A\\\\b.vmt" ',
    "virtual_path= a//b.vmt; source_name= ws1; priority= 7; file_hash= ab12;",
    "priority:7|file_hash:ab12|source_name:ws1|virtual_path:\\a\\b.vmt\r",
    '{ "virtual_path" "a/ｂ.vmt" "source_name" "ws1" "priority" "7" "file_hash" "ab12" }',
]


def test_line_notations(spark):
    df = spark.createDataFrame([(x,) for x in [*LINES, "virtual_path: a/c.vmt | priority: 7", "no fields", "", None]], "raw string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in C.line_fields(F.col("raw")).items()]).collect()]
    assert got[:5] == [("abvmt", "ws1", "7", "ab12")] * 5
    assert got[5] == ("acvmt", None, "7", None) and got[6:] == [(None,) * 4] * 3


# --- 4 ---


def test_ranked_representatives(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abcdef") if i % 9 else None, i, rnd.choice(["s", "t", "u", None]), rnd.choice([None, 1, 2]), rnd.choice([None, 5, 6]), rnd.choice([True, False, None]), rnd.random() < 0.5) for i in range(1, 90)] + [("solo", 200, "s", 1, 1, True, True), ("off", 201, "s", 1, 1, False, True), ("off", 202, "s", 1, 1, None, True)]
    df = spark.createDataFrame(rows, "grp string, id long, src string, pri int, seen int, eligible boolean, named boolean")
    df = df.withColumn("rank", F.struct("pri", "seen", (-F.col("id")).alias("o"))).withColumn("value", F.lit("clash"))
    want = set()
    for g in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == g]
        ok = sorted((r for r in own if r[5]), key=lambda r: (-(r[3] if r[3] is not None else -99), -(r[4] if r[4] is not None else -99), r[1]))
        if len(own) > 1 and ok:
            want.add((min(r[1] for r in own), ok[0][1], next((r[1] for r in ok if r[6]), 0)))
    assert {tuple(r) for r in truth.ranked_representatives(df).collect()} == want
    assert truth.ranked_representatives(df.limit(0)).count() == 0


def test_truth_finds_the_reliable_source(spark):
    """Two of three sources agree on most groups; where the third stands with one of them, learned trust decides."""
    rnd = random.Random(2)
    rows = []
    for g in range(120):
        rows += [(f"g{g}", "good1", f"v{g}"), (f"g{g}", "good2", f"v{g}" if rnd.random() < 0.9 else f"z{g}"), (f"g{g}", "bad", f"w{g}" if rnd.random() < 0.8 else f"v{g}")]
    rows += [("tie", "good1", "right"), ("tie", "bad", "wrong"), ("empty", "bad", None), ("empty", "good1", " "), (None, "bad", "x")]
    df = spark.createDataFrame(rows + rows[:50], "g string, s string, v string")
    out, sources = truth.merge_groups(df, "g", "s", ["v"])
    got = {r.g: r.v for r in out.collect()}
    assert got["tie"] == "right" and got["empty"] is None and len(got) == 122
    assert sum(got[f"g{g}"] == f"v{g}" for g in range(120)) >= 100  # where all three differ nothing tells the good ones apart
    trust = {r.src: r.reliability for r in sources.collect()}
    assert min(trust["good1"], trust["good2"]) > trust["bad"] + 0.3


BOUNDS = [{}, {"group_claims": 6}, {"weight_bytes": 0}]


def test_truth_is_the_same_within_any_bounds(spark):
    """Groups in one row or weighed by aggregations, weights sent or joined: the same survivors and reliabilities."""
    rnd = random.Random(13)
    rows = [(f"g{rnd.randrange(25)}" if rnd.random() < 0.6 else "hot", rnd.choice("stuvw") if i % 11 else None, rnd.choice(["a", "b", "c", None, " "]), rnd.choice([1, 2, None])) for i in range(700)]
    df = spark.createDataFrame([*rows, ("none", "s", None, None)], "g string, s string, v string, p int")
    got = []
    for bounds in BOUNDS:
        out, sources = truth.merge_groups(df, "g", "s", ["v", "p"], **bounds)
        got.append((sorted(map(str, out.collect())), sorted((r.src, round(r.reliability, 9), r.n_claims) for r in sources.collect())))
    assert got[0] == got[1] == got[2] and len(got[0][0]) == len({r[0] for r in rows}) + 1
    assert sum(r.n_records for r in truth.merge_groups(df, "g", "s", ["v"], group_claims=6)[0].collect()) == 701
    ranked = spark.createDataFrame([(g, i, s, p, i % 3 > 0, i % 2 > 0) for i, (g, s, _, p) in enumerate(rows)], "grp string, id long, src string, pri int, eligible boolean, named boolean").withColumn("rank", F.struct("pri", (-F.col("id")).alias("o")))
    won = [sorted(map(str, truth.ranked_representatives(ranked, **b).collect())) for b in BOUNDS]
    assert won[0] == won[1] == won[2] and won[0]
    assert truth.merge_groups(df.limit(0), "g", "s", ["v"])[0].count() == 0


def test_planted_reliabilities(spark):
    """Sources that tell the truth with known shares: the shares are found, and the survivors are truer than a vote."""
    rnd = random.Random(14)
    true_share = {"a": 0.95, "b": 0.85, "c": 0.5, "d": 0.45, "e": 0.4}
    rows, vote = [], 0
    for g in range(800):
        said = {s: "yes" if rnd.random() < p else f"no{rnd.randrange(3)}" for s, p in true_share.items()}
        rows += [(f"g{g}", s, v) for s, v in said.items()]
        tally = {v: sum(x == v for x in said.values()) for v in said.values()}
        vote += max(tally, key=lambda v: (tally[v], v != "yes")) == "yes"
    out, sources = truth.merge_groups(spark.createDataFrame(rows, "g string, s string, v string"), "g", "s", ["v"])
    right = sum(r.v == "yes" for r in out.collect())
    assert right >= 0.93 * 800 and right > vote
    assert all(abs(r.reliability - true_share[r.src]) < 0.06 for r in sources.collect())


# --- 7 ---


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(4)
    odd = "aé漢字😀́ \t\n\r 　'’\"0٣½_-.<|endoftext|>"
    rows = [(i, "".join(rnd.choice(odd) for _ in range(rnd.randrange(0, 60)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "aaaa" * 300), (1003, "I'll we're DON'T don't 's  x   "), (1004, "日本語の長い文章" * 40), (1005, "<|endoftext|>"), (1006, "x y " * 20_000)]
    return rows


@pytest.mark.parametrize("cache", [tokens.CACHE_WORDS, 10, 0])
def test_ids_against_the_public_library(spark, texts, cache):
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("words", F.lit(1)).repartition(3)
    ids = tokens.encode_documents(df, "doc_id", "text", cache=cache)
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in texts}
    if cache == 10:
        n = {r.doc_id: r.n_tokens for r in tokens.encode_documents(df, "doc_id", "text", cache=cache, counts_only=True).collect()}
        assert n == {i: len(v) for i, v in got.items()}
        back = ids.select("doc_id", tokens.decode_ids(F.col("ids")).alias("b")).collect()
        assert {r.doc_id: bytes(r.b).decode() for r in back} == {i: t or "" for i, t in texts}
        assert tokens.encode_documents(df.limit(0), "doc_id", "text").count() == 0


def test_long_words_against_the_public_library(spark):
    """Words of any length and make-up: one letter, random letters, joined words, periods, a script without spaces."""
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(12)
    low, parts = "abcdefghijklmnopqrstuvwxyz", ["the", "volcano", "public", "clothing", "James", "reduce", "charge", "scattering", "Capital", "cannon", "aa", "OK"]
    made = ["a" * 160_000, "-=" * 700 + "=" * 999, "aab" * 300 + "aaaba" * 90, "".join(rnd.choice(low) for _ in range(20_000)), "".join(rnd.choice(parts) for _ in range(2000)), "".join(rnd.choice("的一是不了人我在有他") for _ in range(3000))]
    made += ["".join(rnd.choice(parts) for _ in range(rnd.randrange(6, 40))) for _ in range(60)] + ["".join(rnd.choice("aeiou-") for _ in range(n)) for n in range(40, 60)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: list(r.ids) for r in tokens.encode_documents(df, "doc_id", "text", cache=0).collect()} == {i: enc.encode_ordinary(t) for i, t in enumerate(made)}


# --- 8 ---


def test_mix(spark):
    rnd = random.Random(6)
    docs = [(i, s, rnd.randrange(1, 200)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["small"] * 80 + ["other"] * 50)]
    docs += [(9000, None, 5), (9001, "mid", None), (9002, "mid", 0)]
    want = [("big", 50.0, 1), ("mid", 30.0, 2), ("small", 5.0, 4), ("gone", 15.0, 3), ("zero", 0.0, 1), (None, 3.0, 1)]
    d = spark.createDataFrame(docs, "key long, source string, size long").withColumn("rate", F.lit(1)).withColumn("bucket", F.lit(1))
    t = spark.createDataFrame(want, "source string, target_weight double, max_repeats int")
    rows, shares = mixing.mix(d, t)
    used = rows.toPandas()
    assert used.duplicated(["key", "copy_no"]).sum() == 0
    for s, w, cap in want[:3]:
        own = used[used.source == s]
        assert own.key.value_counts().max() <= cap
        assert abs(own["size"].sum() / used["size"].sum() - w / 85) < 0.01
    assert set(used.source) == {"big", "mid", "small"}
    got = {r.source: r for r in shares.collect()}
    assert got["other"].target_share is None and got["other"].used == 0 and got["gone"].have == 0 and abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    assert all(got[s].aimed_share is None for s in ("other", "gone", "zero")) and abs(got["big"].aimed_share - 50 / 85) < 1e-9 and abs(got["big"].target_share - 0.5) < 1e-9
    again = mixing.mix(d.repartition(7), t)[0].toPandas()
    assert set(zip(again.key, again.copy_no)) == set(zip(used.key, used.copy_no))
    over = mixing.mix(d, t, total=10**9)[0].toPandas()  # more than there is: every document at its cap
    assert over[over.source == "small"].key.value_counts().eq(4).all() and over[over.source == "big"].shape[0] == 3000
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[0].count() == 0


# --- 1 ---

CLEAN = ["Über den Dächern", "Montaña pequeña", "Тихая гавань", "Ночной город", "夜晚的工厂", "Déjà Vu Corridor", "Źródło mocy", "Yıldız Şehri", "NIÑOS", "Âncora Perdida", "100% Loot §2", "Rooftops… Reloaded", "Μικρό φως", "★ Star ★"]


def damage(s, w, r):
    try:
        return s.encode(w).decode(r)
    except UnicodeError:
        return s


def test_garbled_names(spark):
    rnd = random.Random(8)
    chains = [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1251", "cp1252"), ("gbk", "cp1252"), ("cp1250", "cp1252"), ("koi8_r", "cp1251")]
    rows, bad = [], {}
    for i in range(1200):
        name, source = CLEAN[i % len(CLEAN)], f"a{i // 3}"
        n = f"{name} {i % 7}" if i % 2 else name
        if rnd.random() < 0.15:
            w, r = rnd.choice(chains)
            if (d := damage(n, w, r)) != n:
                bad[i], n = (f"{name} {i % 7}" if i % 2 else name), d
        rows.append(("t", i, source if i % 50 else None, n))
    rows += [("t", 5000, "x", None), ("t", 5001, "x", "  "), ("t", 5002, "x", "Caf&eacute; \\u00e9 plain"), ("t", 5003, "x", "Lost � name"), ("t", 5004, "x", "é" * 20_000), ("t", 5005, "y", "�")]
    df = spark.createDataFrame(rows, "field string, row_key long, source string, name string").withColumn("text", F.lit("clash"))
    got = {r.row_key: r for r in garbled.find_garbled(df).collect()}
    found = set(got) - {5003, 5005}
    assert {5003, 5005} <= set(got) and got[5003].restored is None
    assert len(found & set(bad)) >= 0.95 * len(bad) and len(found - set(bad)) <= 0.05 * len(bad)
    right = [i for i in found & set(bad) if got[i].restored == bad[i]]
    assert len(right) >= 0.9 * len(bad)
    assert garbled.find_garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, want", [("Ãœber", "Über"), ("CafÃƒÂ©", "Café"), ("├£ber den Dächern", "Über den Dächern"), ("Êàðòà", "Карта"), ("Карта МЕУ", "Карта лес"), ("Ò¹Íí", "夜晚")])
def test_chains_are_undone(text, want):
    assert want in [t for _, t in N.repairs(text)]


def test_undoing_keeps_places():
    text = "aÃ¼b"
    got, spans = N.undo_utf8(text, "cp1252")
    assert got == "aüb" and spans == [(0, 1), (1, 3), (3, 4)]
    assert N.undo_utf8("plain", "cp1252") is None and N.repairs("plain") == []


# --- 9 ---

UNITS = [
    ["Dr. No met J. K. Smith at 6 p.m. on Jan. 5.", "It cost $3.14, i.e. less."],
    ["He wrote, \"Stop. Wait.\" and left.", "Did it move?!", "(It is optional.)", "Yes."],
    ["The sign reads 'Keep out! Danger.' in red.", "All come from the U.S.", "Why?"],
    ["Am 3. Juli öffnet die Tür.", "„Halt. Nicht weiter.“ steht da.", "Das kostet 5 Mio. Taler."],
    ["« Non ! » cria le Dr Ormeval.", "Où est la porte ?", "Il y a env. 3 fichiers, etc.", "Fin."],
    ["Файл лежит на ул. Лампадной, д. 5.", "«Готова?» — спросил г-н Лозовец.", "Это 12 с.", "Ну… да."],
    ["Πού είναι η πόρτα;", "Χθες ο κ. Βαρδαλής έφτιαξε π.χ. μια σκάλα."],
    ["नक्शा कहाँ है?", "डॉ. वनराज बोले, \"रुको। जाओ।\" और चले गए।"],
    ["أين الباب؟", "قال د. الوادياني: «قف. ارجع.» ثم مضى."],
    ["ไม่ควรลบสะพานนี้", "วาง MOD ไว้ข้างกล่อง", "มี 12 ไฟล์อยู่ในบันได"],
    ["v1.2에서 문이 고쳐졌습니다.", "\"문이 안전한가요?\"라고 물었다.", "사라졌어요!"],
    ["1. Unpack the bridge.", "2. Copy skin.v2.vmt into it."],
]


@pytest.mark.parametrize("want", UNITS)
def test_sentences(want):
    for sep in (" ", "\n", "  "):
        text = f"  {sep.join(want)}\n \n{want[0]}\n\n\nHome | Maps"
        assert [text[a:b] for a, b in sentences.units(text)] == [*want, want[0], "Home | Maps"]


def test_unspaced_scripts_and_damage():
    zh = ["他说：“为什么？”然后离开了工厂。", "牌子上写着“停下。回去。”几个字。", "v2.0.1修复了工厂；更快了。", "真的吗？！", "唉……不见了。"]
    text = "".join(zh)
    assert [text[a:b] for a, b in sentences.units(text)] == zh
    broken = text.encode().decode("latin-1")
    got = [broken[a:b].encode("latin-1").decode() for a, b in sentences.units(broken)]
    assert got == zh
    ru = "Файл лежит на ул. Лампадной, д. 5. Это дверь. Где тут башня?"
    shown = ru.encode("cp1251").decode("cp1252")
    assert sentences.units(shown) == sentences.units(ru)
    assert sentences.units("") == [] and sentences.units(" \n\t") == []


def test_sentence_rows(spark):
    rows = [(1, "Abc. Cde."), (1, "Abc. Cde."), (None, "x"), (2, None), (3, " "), (4, "w" * 300_000), (5, "Ja! " * 20_000)]
    got = sentences.sentence_units(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")), "doc_id", "text")
    rows = [tuple(r) for r in got.collect()]
    assert rows.count((1, 0, 4)) == 2 and (None, 0, 1) in rows and (4, 0, 300_000) in rows and sum(r[0] == 5 for r in rows) == 20_000 and len(rows) == 20_006
    assert sentences.sentence_units(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_quotations_bind_at_any_length():
    """The same sentence with a quotation of some hundred characters or many thousand is one unit, and so is a nested one."""
    for n in (3, 12, 30, 400):
        said = "Stop here. Wait there. Go on. " * n
        text = f"He wrote, \"{said.strip()}\" and left. Then he came."
        assert [text[a:b] for a, b in sentences.units(text)] == [text[: -len(" Then he came.")], "Then he came."]
        nested = f"She said: «He wrote “{said.strip()}” ({'(' * n}so.{')' * n}) again.» It was late."
        assert len(sentences.units(nested)) == 2
    deep = "(" * 50_000 + "a. B" + ")" * 40_000 + " End. More."
    assert sentences.units(deep)[-1] == (len(deep) - 5, len(deep))


def brute_cut(s):
    """Every beginning tried against every end."""
    S = sentences
    cands = S._candidates(s)
    starts, ends, gains = [0, *[c[1] for c in cands]], [*[c[0] for c in cands], len(s)], [*[c[2] for c in cands], 0.0]
    best = [0.0]
    for j, e in enumerate(ends):
        best.append(max(best[i] + gains[j] + S.NO_WORD * (e - starts[i] < S.WORD_AT and not any(c.isalpha() for c in s[starts[i] : e])) + S.LONG * max(0, e - starts[i] - S.LONG_AT) for i in range(j + 1)))
    return best[-1], starts, ends, gains


def test_cuts_are_the_best_of_all():
    rnd = random.Random(9)
    for _ in range(300):
        s = "".join(rnd.choice(["Ab cd", "x", ". ", "! ", '." ', "1", ' "', " (", ") ", "? 1. ", "etc. ", "Long words stand here without an end " * 4, ", ", "e.g. ", "No. "]) for _ in range(rnd.randrange(1, 90))).strip() or "x"
        top, starts, ends, gains = brute_cut(s)
        score = 0.0
        for a, e in sentences._cut(s):
            score += gains[ends.index(e)] + sentences.NO_WORD * (e - a < sentences.WORD_AT and not any(c.isalpha() for c in s[a:e])) + sentences.LONG * max(0, e - a - sentences.LONG_AT)
        assert abs(score - top) < 1e-6


# --- 1, runs of words and cut sources ---


@pytest.mark.parametrize("n", [3, 8, 9, 40])
def test_a_damaged_run_is_found_among_any_number_of_words(n):
    """The dynamic programme finds the run that is best of all listed ones, however many words the name has."""
    good = ["Über", "große", "Türme", "für", "später"] * 8
    parts = good[:n]
    parts[1:3] = [w.encode("cp1250").decode("cp852") for w in ("große", "Türme")]
    fixed = [N._undo_word(p, "cp1250", "cp852") for p in parts]
    right = set(good)
    gain = lambda given, undone: (undone in right) - (given in right)
    runs = N._damaged_runs(parts, fixed, gain)
    assert (1, 2) in runs and set(runs) <= set(N._damaged_runs(parts, fixed, None)) and len(runs) <= 2
    assert " ".join(good[:n]) in [t for _, t in N.repairs(" ".join(parts), gain)]


def test_hot_names_and_words_are_joined_alike(spark, texts, monkeypatch):
    """Names, words and sources that are spread over many tasks give what plain joins give."""
    from palimpsest.operators import skew

    names = spark.createDataFrame([("t", i, f"s{i % 90}", damage(CLEAN[i % 3], "utf-8", "cp1252") if i % 7 == 0 else CLEAN[i % 3]) for i in range(400)], "field string, row_key long, source string, name string")
    docs = spark.createDataFrame(texts[:60], "doc_id long, text string")
    facts = spark.createDataFrame([(f"g{i % 40}", "hot" if i % 3 else f"s{i}", f"v{i % 5}") for i in range(300)], "g string, s string, v string")

    def all_three():
        got = garbled.find_garbled(names), tokens.encode_documents(docs, "doc_id", "text", cache=5), truth.merge_groups(facts, "g", "s", ["v"])[0]
        return [sorted(map(str, d.collect())) for d in got]

    plain = all_three()
    monkeypatch.setattr(skew, "HOT_ROWS", 0)
    monkeypatch.setattr(truth, "DICTIONARY_BYTES", 0)
    assert all_three() == plain and all(plain)


def test_cut_sources_are_judged_alike(spark):
    """A source whose names lie in many rows is judged as one whose names lie in one, and names restored are right."""
    rnd = random.Random(11)
    rows, bad = [], {}
    for i in range(600):
        n = f"{CLEAN[i % len(CLEAN)]} {i}"
        if i % 4 == 0 and (d := damage(n, "utf-8", rnd.choice(["cp1252", "cp437"]))) != n:
            bad[i], n = n, d
        rows.append(("t", i, "one" if i % 3 else f"s{i % 40}", n))
    df = spark.createDataFrame(rows, "field string, row_key long, source string, name string")
    near, cut = ({r.row_key: r.restored for r in garbled.find_garbled(df, source_names=m).collect()} for m in (garbled.SOURCE_NAMES, 20))
    assert near == cut and set(near) <= set(bad) and len(near) >= 0.85 * len(bad)  # "Â§" alone is too weak a sign here
    assert sum(near[i] == bad[i] for i in near) >= 0.97 * len(near)
