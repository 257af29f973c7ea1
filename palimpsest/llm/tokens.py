"""Encoding a corpus with a public byte-level BPE tokenizer, inside the JVM.

Ranked merges are folded by Spark higher-order functions over the byte arrays of distinct words; the ranks are a literal map,
laid out as a cuckoo table so that a lookup reads two array cells. Texts are cut into words once. Words found in a
bounded literal cache of frequent words take their ids from it in place; all others go through the distinct-word
table and are joined back. The cache only saves time: the ids are the same with any cache, or none.
"""

from __future__ import annotations

import base64
import json
import random
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..scratch import materialize

#: Where the public vocabularies lie; a parameter of every function that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed: the tokenizer's word pattern, with white space as the Unicode property.
SPACE = r"\p{IsWhite_Space}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?[^{SPACE}\p{{L}}\p{{N}}]++|{SPACE}+(?![^{SPACE}])|{SPACE}+"

#: Frequent words cached as a literal (about 60 bytes each), and the documents sampled to choose them.
CACHE_WORDS = 4096
CACHE_SAMPLE = 4000
CACHE_BUCKETS = 8192


@dataclass(frozen=True)
class Vocabulary:
    bytes_of: tuple[bytes, ...]
    byte_ids: tuple[int, ...]
    #: Slots of (left id << 34 | right id << 17 | merged id) + 1, 0 if free; merged id is the rank.
    table: tuple[int, ...]
    seeds: tuple[int, int]
    #: Bit ``first << 8 | second``, in words of 32 bits: whether the two bytes stand side by side in any piece.
    beside: tuple[int, ...]


#: Odd multipliers of 28 bits: with pairs of 34 bits no product overflows a BIGINT.
_MULT = (0x9E3779B, 0x85EBCA7)


def _slot(pair: int, mult: int, seed: int, mask: int) -> int:
    return ((pair ^ seed) * mult >> 24) & mask


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> Vocabulary:
    """Read a rank file and lay out its merges. A merge is any two known pieces whose join is known."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs: dict[int, int] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                pairs[left << 17 | right] = rank
    size = 1
    while size < 2.2 * len(pairs):
        size *= 2
    rng = random.Random(1)
    while True:
        seeds = (rng.getrandbits(30), rng.getrandbits(30))
        table = _cuckoo(pairs, seeds, size)
        if table:
            break
    by_id = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece
    beside = [0] * 2048
    for a, b in {(p[i], p[i + 1]) for p in ranks for i in range(len(p) - 1)}:
        beside[a << 3 | b >> 5] |= 1 << (b & 31)
    return Vocabulary(tuple(by_id), tuple(ranks[bytes([i])] for i in range(256)), tuple(table), seeds, tuple(beside))


def _cuckoo(pairs: dict[int, int], seeds: tuple[int, int], size: int) -> list[int] | None:
    table, mask = [0] * size, size - 1
    for pair, rank in pairs.items():
        entry, at = (pair << 17 | rank) + 1, _slot(pair, _MULT[0], seeds[0], mask)
        for _ in range(200):
            entry, table[at] = table[at], entry
            if not entry:
                break
            p = (entry - 1) >> 17
            a, b = _slot(p, _MULT[0], seeds[0], mask), _slot(p, _MULT[1], seeds[1], mask)
            at = b if at == a else a
        else:
            return None
    return table


def _longs(values) -> Column:
    """A literal array: a split of a constant string, which the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, inside a higher-order function."""
    return F.transform(F.array(value), body)[0]


def _ranker(v: Vocabulary, table: Column):
    mask = len(v.table) - 1

    def cell(pair: Column, i: int) -> Column:
        h = pair.bitwiseXOR(F.lit(v.seeds[i])) * F.lit(_MULT[i])
        return table[F.call_function("shiftright", h, F.lit(24)).bitwiseAND(F.lit(mask)).cast("int")] - 1

    def rank(left: Column, right: Column) -> Column:
        """Rank of joining two pieces, which is also the id of the piece they become; null if they don't join."""
        pair = F.call_function("shiftleft", left.cast("long"), F.lit(17)).bitwiseOR(right.cast("long"))
        found = lambda i: let(cell(pair, i), lambda c: F.when(F.call_function("shiftright", c, F.lit(17)) == pair, c.bitwiseAND(F.lit((1 << 17) - 1)).cast("int")))
        return F.coalesce(found(0), found(1))

    return rank


def encode_word(word: Column, v: Vocabulary) -> Column:
    """Ids of one word by folding ranked merges over its bytes: the leftmost pair of least rank joins at each step.

    All pairs of least rank join in one step where that gives the same as one after the other: where no pair that
    arises on the way ranks lower. A long word is first cut between bytes that stand side by side in no piece, which no
    merge can cross. Both keep the work on words of any length near to linear and change no id.
    """
    return let(_longs(v.table), lambda table: _encode_word(word, v, table))  # the literal stands in the plan once


#: Words of more bytes are cut where no merge crosses, and their equal pairs join together. Speed only.
LONG_WORD = 48


def _encode_word(word: Column, v: Vocabulary, table: Column) -> Column:
    rank = _ranker(v, table)
    byte_ids = _longs(v.byte_ids)
    chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    bytes_ = F.transform(chars, lambda c: F.ascii(c))
    none = F.array().cast("array<int>")

    def ranks_of(ids: Column) -> Column:
        n = F.size(ids)
        return F.zip_with(F.slice(ids, 1, n - 1), F.slice(ids, 2, n - 1), rank)

    def state(ids: Column, ranks: Column) -> Column:
        """Ids, ranks of their pairs, and the least rank, null if nothing joins any more."""
        return let(F.struct(ids.alias("ids"), ranks.alias("ranks")), lambda x: F.struct(x["ids"].alias("ids"), x["ranks"].alias("ranks"), F.array_min(x["ranks"]).alias("m")))

    def join_one(acc: Column) -> Column:
        m = acc["m"]
        return let(
            F.struct(F.array_position(acc["ranks"], m).cast("int").alias("i"), F.size(acc["ids"]).alias("n")),
            lambda x: state(
                F.concat(F.slice(acc["ids"], 1, x["i"] - 1), F.array(m), F.slice(acc["ids"], x["i"] + 2, x["n"])),
                F.concat(
                    F.when(x["i"] > 1, F.concat(F.slice(acc["ranks"], 1, F.greatest(x["i"] - 2, F.lit(0))), F.array(rank(acc["ids"][x["i"] - 2], m)))).otherwise(none),
                    F.when(x["i"] + 1 < x["n"], F.array(rank(m, acc["ids"][x["i"] + 1]))).otherwise(none),
                    F.slice(acc["ranks"], x["i"] + 2, x["n"]),
                ),
            ),
        )

    def join_all(acc: Column) -> Column:
        """Every pair of least rank at once, overlapping ones from the left; null where that might differ."""
        m, ids = acc["m"], acc["ids"]
        shown = F.array_join(F.transform(acc["ranks"], lambda r: F.when(r == m, "1").otherwise("0")), "")
        marks = F.split(F.regexp_replace(shown, "11", "1x"), "")

        def joined(marks: Column) -> Column:
            here = lambda i: F.get(marks, i) == "1"
            new = F.filter(F.transform(ids, lambda x, i: F.when(here(i), m).when(here(i - 1), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
            passing = F.transform(marks, lambda k, i: F.when(k == "1", rank(m, F.get(ids, i + 2))))
            lower = F.exists(passing, lambda r: F.coalesce(r < m, F.lit(False)))
            return let(let(new, lambda n: state(n, ranks_of(n))), lambda x: F.when(~lower & F.coalesce(x["m"] > m, F.lit(True)), x))

        return let(marks, joined)

    def step(acc: Column, _: Column) -> Column:
        many = (F.size(acc["ids"]) > LONG_WORD) & (F.size(F.filter(acc["ranks"], lambda r: r == acc["m"])) > 1)
        return F.when(acc["m"].isNull(), acc).otherwise(F.coalesce(F.when(many, join_all(acc)), join_one(acc)))

    def fold(ids: Column) -> Column:
        """At most one step for each byte, in rounds of as many steps as there are rounds: a fold copies what it carries
        at every step, so once nothing joins any more whole rounds are passed over."""
        rounds = lambda k: F.aggregate(F.sequence(F.lit(1), k), state(ids, ranks_of(ids)), lambda acc, _: F.when(acc["m"].isNull(), acc).otherwise(F.aggregate(F.sequence(F.lit(1), k), acc, step)))["ids"]
        return F.when(F.size(ids) > 1, let(F.ceil(F.sqrt(F.size(ids))).cast("int"), rounds)).otherwise(ids)

    def parts(b: Column, ids: Column) -> Column:
        beside = _longs(v.beside)
        apart = lambda x, y: F.call_function("shiftright", beside[x * 8 + F.call_function("shiftright", y, F.lit(5))], y % 32).bitwiseAND(F.lit(1)) == 0
        cuts = F.filter(F.sequence(F.lit(2), F.size(b)), lambda i: apart(b[i - 2], b[i - 1]))
        starts = F.concat(F.array(F.lit(1)), cuts)
        return let(starts, lambda at: F.transform(at, lambda s, k: F.slice(ids, s, F.coalesce(F.get(at, k + 1), F.size(ids) + 1) - s)))

    def whole(b: Column) -> Column:
        ids = F.transform(b, lambda x: byte_ids[x].cast("int"))
        return let(ids, lambda i: F.flatten(F.transform(F.when(F.size(i) > LONG_WORD, parts(b, i)).otherwise(F.array(i)), fold)))

    return let(bytes_, whole)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def word_cache(documents: DataFrame, text: str, v: Vocabulary, n: int = CACHE_WORDS, sample: int = CACHE_SAMPLE) -> list:
    """(bucket, word, ids) of frequent words of a bounded sample; at most ``n`` rows come to the driver."""
    if n <= 0:
        return []
    some = documents.select(F.explode(words_of(F.col(text))).alias("word")) if sample <= 0 else documents.select(text).limit(sample).select(F.explode(words_of(F.col(text))).alias("word"))
    top = some.groupBy("word").count().filter(F.octet_length("word") <= 64).orderBy(F.desc("count"), "word").limit(n)
    return top.select(F.pmod(F.xxhash64("word"), F.lit(CACHE_BUCKETS)).cast("int").alias("b"), "word", encode_word(F.col("word"), v).alias("ids")).collect()


def _cache_literal(rows: list, as_count: bool) -> Column:
    buckets: list[dict] = [{} for _ in range(CACHE_BUCKETS)]
    for r in rows:
        buckets[r.b][r.word] = len(r.ids) if as_count else list(r.ids)
    kind = "int" if as_count else "array<int>"
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), f"array<map<string,{kind}>>")


def _cached(word: Column, literal: Column) -> Column:
    return literal[F.pmod(F.xxhash64(word), F.lit(CACHE_BUCKETS)).cast("int")][word]


def encode_documents(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, cache: int = CACHE_WORDS, counts_only: bool = False) -> DataFrame:
    """(key, ids) for every row, or (key, n_tokens) with ``counts_only``; no special tokens are added or recognised.

    An empty and a null text both have the empty list of ids (0 tokens). ``key`` must be unique and not null. The whole
    text is encoded, however long; strings of special tokens are ordinary text. Other columns are not read.
    """
    v = load(vocabulary)
    docs = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    literal = _cache_literal(word_cache(docs, "text", v, cache), counts_only)
    got = lambda w: _cached(w, literal)
    words = docs.select("key", words_of(F.col("text")).alias("words"))
    if counts_only:
        parts = words.select("key", "words", F.transform("words", got).alias("parts"))
        rest = F.filter("words", lambda w, i: F.get("parts", i).isNull())
        known = F.aggregate("parts", F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0)))
        first = materialize(parts.select("key", known.alias("known"), rest.alias("rest")), "counted")
    else:
        parts = words.select("key", "words", F.transform("words", got).alias("parts"))
        holes = F.exists("parts", lambda p: p.isNull())
        first = parts.select(
            "key",
            F.when(~holes, F.flatten("parts")).alias("ids"),
            F.when(holes, F.col("parts")).alias("parts"),
            F.when(holes, F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("word"))), lambda x: F.get("parts", x["i"]).isNull())).alias("rest"),
        )
        first = materialize(first, "encoded")

    if counts_only:
        rare = first.select("key", F.explode("rest").alias("word"))
        more = _with_ids(rare.groupBy("key", "word").count(), _distinct_words(rare, v)).select("key", "count", F.size("ids").alias("n")).groupBy("key").agg(F.sum(F.col("n") * F.col("count")).alias("n"))
        return first.join(more, "key", "left").select(F.col("key").alias(key), (F.col("known") + F.coalesce("n", F.lit(0))).cast("long").alias("n_tokens"))
    rare = first.filter("rest is not null").select("key", F.inline("rest"))
    found = _with_ids(rare, _distinct_words(rare, v)).groupBy("key").agg(F.collect_list(F.struct("i", "ids")).alias("found"))
    open_ = first.filter("rest is not null").select("key", "parts").join(found, "key")
    known = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), p.alias("ids"))), lambda x: x["ids"].isNotNull())
    filled = open_.select("key", F.flatten(F.transform(F.array_sort(F.concat(known, "found")), lambda x: x["ids"])).alias("ids"))
    done = first.filter("ids is not null").select("key", "ids")
    return done.unionByName(filled).select(F.col("key").alias(key), "ids")


def _distinct_words(rare: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, n, ids): each rare word once, with its occurrences, encoded once, and written down before it is joined back."""
    words = rare.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return materialize(words.select("word", "n", encode_word(F.col("word"), v).alias("ids")), "words")


def _with_ids(rare: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of ``rare`` with the ids of their word. A word that the cache lacks may still be in most documents: its rows
    are spread, and its ids copied to each of their places."""
    return spread_join(rare, words.select("word", "ids"), "word", words.select(F.col("word").alias("k"), "n"))


def decode_ids(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The bytes that ids stand for, by concatenating binary pieces; an unknown id gives null."""
    v = load(vocabulary)
    pieces = F.split(F.lit(",".join(p.hex() for p in v.bytes_of)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))
