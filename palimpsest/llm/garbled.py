"""Garbled text from wrong character encoding: expectation-maximisation over latent encoding chains.

Every name was written and read through some unknown chain of encodings, mostly none. For each name the chains that can
be undone are listed with what they would give. The E-step weighs them by the chain's frequency in the name's source and
field, by how well the text before the damage fits the language of all names (frequencies of character pairs), and by whether
that text also stands in other records of the same source. The frequencies of a source's field are a Dirichlet mixture:
the expected chains of its other names, shrunk to the frequencies of the field. The M-step re-estimates the field's
frequencies and the character pairs from the weights. Only parameters of bounded size travel between the rounds: chains by
field, hashed character pairs, and chains of the few sources that are too large for one row.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..scratch import discard, materialize
from .collapse import canonical
from .encodings import CHAINS, LOST, REPLACED, repairs

#: Hashed character pairs, and what is added to each count.
PAIRS, SMOOTH = 1 << 17, 0.02
#: Added to each pair's log frequency, so that usual pairs cost about nothing: a text is not better for being shorter.
PER_PAIR = 6.5
#: Share of names taken to be undamaged before anything is known.
CLEAN = 0.85
#: Log probability that a writer puts U+FFFD in a name; readers put it for bytes that they cannot read.
WRITTEN_LOST = -25.0
#: What writers seldom put, which the folded character pairs do not show, with its log probability: a capital right after
#: a small letter, and a no-break space.
ODD, WRITTEN_ODD = regex.compile(r"(?<=\p{Ll})\p{Lu}|\u00a0"), -4.0
#: Names' worth of the field's frequencies in those of a source's field.
SHRINK = 4.0
#: The rounds end when no chain's frequency moves by more than this, at the latest after so many.
TOLERANCE, ROUNDS = 1e-3, 20
#: Names of a source that are weighed together in one row; a source with more is cut into rows of about this size.
SOURCE_NAMES = 10_000


def fold_name(s: str) -> str:
    return " ".join(unicodedata.normalize("NFC", s).casefold().split())


@lru_cache(maxsize=200_000)
def _pair_id(two: str) -> int:
    return zlib.crc32(two.encode("utf-8", "surrogatepass")) % PAIRS


def pair_ids(text: str) -> list[int]:
    t = " " + fold_name(text) + " "
    return [_pair_id(t[i : i + 2]) for i in range(len(t) - 1) if not (t[i] < "\x80" and t[i + 1] < "\x80")]


def support(there: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log weight of ``there`` records of the source that hold the repaired text, against ``own`` with the given one."""
    ratio = np.log2(np.maximum(there, 1) / np.maximum(own, 1))
    return np.where(there > 0, np.maximum(0.0, 4 + 3 * np.minimum(1.0, ratio)), 0.0)


def _log_pairs(pairs: np.ndarray) -> np.ndarray:
    return np.log((pairs + SMOOTH) / (pairs.sum() + SMOOTH * PAIRS)) + PER_PAIR


def _candidates(log_pairs: np.ndarray):
    """Lists the candidates of each name: the name as it is, what every chain gives, and U+FFFD as a chain of its own.

    Where words of a name are damaged and others not, the run of damaged words is chosen by the character pairs of all
    names as they are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=100_000)
        def fit(word: str) -> float:
            return float(log_pairs[pair_ids(word)].sum()) + WRITTEN_ODD * len(ODD.findall(word))

        def gain(given: str, undone: str) -> float:
            return fit(undone) - fit(given)

        for b in batches:
            names, chains, texts, sizes = b.column(0), [], [], [0]
            for name in names.to_pylist():
                for chain, text in [(0, name), *repairs(name, gain), *[(REPLACED, name)] * (LOST in name)]:
                    chains.append(chain)
                    texts.append(text)
                sizes.append(len(chains))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(chains, pa.int32()), pa.array(texts, pa.string())], ["chain", "text"]))
            yield pa.RecordBatch.from_arrays([names, lists], ["name", "cands"])

    return run


def _with_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows (source, uses) what the rounds need of the candidates' texts: the sizes of their lists of character
    pairs, these lists one after the other, and twice the number of odd places plus one where U+FFFD is left."""
    for b in batches:
        uses = b.column(1)
        cands = uses.flatten().field("cands")
        texts = cands.flatten().field("text").to_pylist()
        ids = [pair_ids(t) for t in texts]
        first = cands.offsets.to_numpy()
        ends = (first - first[0])[(uses.offsets.to_numpy() - uses.offsets[0].as_py())]  # of the rows, in candidates
        sizes = np.array([len(x) for x in ids], np.int32)
        pair_ends = np.concatenate([[0], np.cumsum(sizes)])[ends].astype(np.int32)
        marks = np.array([2 * len(ODD.findall(t)) + (LOST in t) for t in texts], np.int32)
        rows = pa.array(ends.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.ListArray.from_arrays(rows, pa.array(sizes)), pa.ListArray.from_arrays(pa.array(pair_ends), pa.array(np.array([i for x in ids for i in x], np.int32))), pa.ListArray.from_arrays(rows, pa.array(marks))],
            ["source", "uses", "sizes", "pairs", "marks"],
        )


class Groups:
    """A batch of rows (source, uses, sizes, pairs, marks), a use being (field, name, n, cands), as flat arrays."""

    def __init__(self, b: pa.RecordBatch, fields: list[str]):
        self.source = b.column(0).to_pylist()
        uses = b.column(1)
        of_group = np.diff(uses.offsets.to_numpy())
        u = uses.flatten()
        self.uses = u
        self.group = np.repeat(np.arange(len(of_group)), of_group)
        number = {f: i for i, f in enumerate(fields)}
        self.field = np.array([number[f] for f in u.field("field").to_pylist()], np.int64)
        self.n = u.field("n").to_numpy()
        cands = u.field("cands")
        ends = cands.offsets.to_numpy()
        self.starts, self.sizes = ends[:-1] - ends[0], np.diff(ends)
        c = cands.flatten()
        self.use = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.chain, hit = c.field("chain").to_numpy(), c.field("hit").to_numpy()
        self.texts = c.field("text")
        own = hit[self.starts][self.use]  # the first candidate of a name is the name as it is
        self.pair_sizes, self.pairs, marks = (b.column(i).flatten().to_numpy() for i in (2, 3, 4))
        lost, odd = (marks & 1) > 0, marks >> 1
        self.given = np.where(self.chain > 0, support(hit, own), 0.0) + np.where(lost & (self.chain != REPLACED), WRITTEN_LOST, 0.0) + WRITTEN_ODD * odd


class Model:
    """Parameters of one round: chain frequencies by field, log frequencies of character pairs, and the expected chain
    counts of the sources that are cut, by source and field."""

    def __init__(self, fields: list[str], prior: np.ndarray, log_pairs: np.ndarray, cut: dict[tuple[str, int], np.ndarray]):
        self.fields, self.prior, self.log_pairs, self.cut = fields, prior, log_pairs, cut

    def weigh(self, g: Groups) -> np.ndarray:
        """Posterior of every candidate; those of one use add up to 1.

        Within a source's field the weights and the chain counts they give are refined in turn until they agree. A use
        does not count for itself.
        """
        if not len(g.chain):
            return np.zeros(0)
        fit = np.concatenate([[0.0], np.cumsum(self.log_pairs[g.pairs])])
        at = np.concatenate([[0], np.cumsum(g.pair_sizes)])
        lp = fit[at[1:]] - fit[at[:-1]] + g.given
        field, n = g.field[g.use], g.n[g.use]
        base = self.prior[field, g.chain]
        place = g.group[g.use] * len(self.fields) + field
        key, of_key = np.unique(place * len(CHAINS) + g.chain, return_inverse=True)
        mine, of_mine = np.unique(g.use * len(CHAINS) + g.chain, return_inverse=True)  # a chain may give a use two candidates
        total = np.bincount(g.group * len(self.fields) + g.field, g.n, len(g.source) * len(self.fields))[place]
        shares = [self.cut.get((s, f)) for s in g.source for f in range(len(self.fields))]
        fixed = np.array([x is not None for x in shares])[place]
        if fixed.any():
            rows = np.flatnonzero(fixed)
            total = total.astype(float)
            total[rows] = [shares[p].sum() for p in place[rows]]
            whole = np.array([shares[p][c] for p, c in zip(place[rows], g.chain[rows])])
        w = _normal(lp + np.log(base), g)
        for _ in range(12):
            counts = np.bincount(of_key, w * n, len(key))[of_key]
            if fixed.any():
                counts[rows] = whole
            own = np.bincount(of_mine, w, len(mine))[of_mine] * n
            prior = (np.maximum(counts - own, 0.0) + SHRINK * base) / (np.maximum(total - n, 0.0) + SHRINK)
            new = _normal(lp + np.log(prior), g)
            moved = np.abs(new - w).max()
            w = new
            if moved < 1e-3:
                break
        return w


def _normal(lp: np.ndarray, g: Groups) -> np.ndarray:
    lp = np.exp(lp - np.maximum.reduceat(lp, g.starts)[g.use])
    return lp / np.add.reduceat(lp, g.starts)[g.use]


def _e_step(model: Model, cut: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = np.zeros((len(model.fields), len(CHAINS)))
        pairs = np.zeros(PAIRS)
        large: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            g = Groups(b, model.fields)
            w = model.weigh(g) * g.n[g.use]
            pairs += np.bincount(g.pairs, np.repeat(w, g.pair_sizes), PAIRS)
            np.add.at(chains, (g.field[g.use], g.chain), w)
            for i, s in enumerate(g.source):
                if s in cut:
                    rows = g.group[g.use] == i
                    for f in np.unique(g.field[g.use[rows]]):
                        own = rows & (g.field[g.use] == f)
                        large[s, int(f)] = large.get((s, int(f)), 0) + np.bincount(g.chain[own], w[own], len(CHAINS))
        rows = [(None, -1, i, pairs[i]) for i in np.flatnonzero(pairs)] + [(None, f, c, chains[f, c]) for f, c in zip(*np.nonzero(chains))]
        rows += [(s, f, c, v[c]) for (s, f), v in large.items() for c in np.flatnonzero(v)]
        if rows:
            s, f, i, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(np.array(f, np.int32)), pa.array(np.array(i, np.int32)), pa.array(np.array(v, float))], ["source", "field", "i", "v"])

    return run


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(PAIRS)
    for b in batches:
        for name, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            np.add.at(total, pair_ids(name), n)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.array(at, np.int32)), pa.array(total[at])], ["i", "v"])


def _counted(names: DataFrame) -> np.ndarray:
    """Pair counts of (name, n): at most PAIRS numbers come to the driver."""
    out = np.zeros(PAIRS)
    got = names.select("name", F.col("n").cast("double")).mapInArrow(_pair_counts, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out[got.i] = got.v
    return out


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = Groups(b, model.fields)
            w = model.weigh(g)
            clean = np.bincount(g.use, np.where(g.chain == 0, w, 0.0), len(g.starts))
            hit = np.flatnonzero(clean <= 0.5)
            alone = np.where(g.chain > 0, w, -1.0)
            best = [int(g.starts[u]) + int(np.argmax(alone[g.starts[u] : g.starts[u] + g.sizes[u]])) for u in hit]
            take = pa.array(np.array(best, np.int64))
            source = pa.array([g.source[i] for i in g.group[hit]], pa.string())
            uses = g.uses.take(pa.array(hit))
            out = [uses.field("field"), source, uses.field("name"), pa.array([CHAINS[c] for c in g.chain[best]] if len(best) else [], pa.string()), g.texts.take(take), pa.array(1 - clean[hit], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, ["field", "source", "name", "chain", "text", "damaged"])

    return run


def _low(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"(?U)\s+", " "))


def find_garbled(records: DataFrame, rounds: int = ROUNDS, source_names: int = SOURCE_NAMES) -> DataFrame:
    """(field, row_key, name, damaged, chain, restored) of every record whose name, or part of it, was wrongly decoded.

    ``records``: field, row_key, source, name. ``damaged`` is the posterior probability of damage, 0.5 or more; chain is
    the likeliest one, ``?>utf-8`` for names with U+FFFD of which no more is known. restored is null where the name can
    no longer be known. Null and blank names are no cases; plain ASCII names never are. Repeated rows come out each. An
    empty table gives an empty result. A null source shares no evidence.
    """
    spark = records.sparkSession
    named = records.select("field", "row_key", "source", "name").filter(F.col("name").rlike(r"(?U)\S") & (F.octet_length("name") > F.char_length("name")))
    uses = materialize(named.groupBy("field", "source", "name").agg(F.count(F.lit(1)).alias("n")), "uses")
    fields = sorted(r.field for r in uses.select("field").distinct().collect())
    if not fields:
        return records.select("field", "row_key", "name", F.lit(1.0).alias("damaged"), F.lit("").alias("chain"), F.col("name").alias("restored")).limit(0)
    given = _log_pairs(_counted(uses.select("name", "n")))
    # A fixed number of partitions: few bytes here mean much work, and small partitions must not be merged.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cands = uses.select("name").repartition(parts, "name").distinct().mapInArrow(_candidates(given), "name string, cands array<struct<chain:int,text:string>>")
    cands = materialize(cands, "candidates")
    open_ = cands.filter(F.size("cands") > 1)

    # Where what a chain gives also stands elsewhere in the source. Both sides are distinct, and the key is the pair of
    # source and text: a source with a third of all records is no hot key.
    there = records.select("source", _low(F.col("name")).alias("low")).filter("source is not null and low is not null").groupBy("source", "low").agg(F.count(F.lit(1)).alias("hit"))
    loads = uses.groupBy(F.col("name").alias("k")).agg(F.count(F.lit(1)).alias("n"))  # a name may stand in most sources
    tried = spread_join(uses, open_, "name", loads).select("field", "source", "name", "n", F.posexplode("cands").alias("k", "c"))
    tried = tried.select("field", "source", "name", "n", "k", "c.chain", "c.text", _low(F.col("c.text")).alias("low")).join(there, ["source", "low"], "left")
    cand = F.struct("k", "chain", "text", F.coalesce("hit", F.lit(0)).alias("hit"))
    tried = tried.groupBy("field", "source", "name").agg(F.max("n").cast("double").alias("n"), F.sort_array(F.collect_list(cand)).alias("cands"))
    # Names without an alternative speak for the language, for their field and for their source, in sum.
    plain = materialize(spread_join(uses, open_.select("name"), "name", loads, "left_anti"), "plain")
    as_is = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("chain"), F.lit("").alias("text"), F.lit(0).cast("long").alias("hit")))
    sums = plain.groupBy("field", "source").agg(F.sum("n").cast("double").alias("n")).select("field", "source", F.lit("").alias("name"), "n", as_is.alias("cands"))
    tried = tried.unionByName(sums)
    # One row for each source, a source with very many names being cut. A null source has a row for each name.
    sizes = uses.filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("m"))
    bound = max(source_names, sizes.agg(F.sum("m")).first()[0] // 1000 if source_names == SOURCE_NAMES else 0)
    large = {r.source: -(-r.m // bound) for r in sizes.filter(F.col("m") > bound).collect()}  # at most a thousand
    salt = F.pmod(F.xxhash64("name"), F.lit(max(large.values(), default=1)))
    salt = F.when(F.col("source").isNull(), F.xxhash64("field", "name")).when(F.col("source").isin(list(large)), salt).otherwise(0)
    tried = tried.groupBy("source", salt.alias("salt")).agg(F.collect_list(F.struct("field", "name", "n", "cands")).alias("uses"))
    tried = tried.select("source", "uses").repartition(parts)
    tried = materialize(tried.mapInArrow(_with_pairs, f"source string, uses {tried.schema['uses'].dataType.simpleString()}, sizes array<int>, pairs array<int>, marks array<int>"), "tried")

    base = _counted(plain.select("name", "n"))
    prior = np.full((len(fields), len(CHAINS)), (1 - CLEAN) / (len(CHAINS) - 1))
    prior[:, 0] = CLEAN
    model = Model(fields, prior, given, {})
    for _ in range(rounds):
        step = tried.mapInArrow(_e_step(model, set(large)), "source string, field int, i int, v double")
        got = step.groupBy("source", "field", "i").agg(F.sum("v").alias("v")).toPandas()  # PAIRS + chains x (fields + cut sources) at most
        pairs, prior, cut = base.copy(), np.full((len(fields), len(CHAINS)), 0.02), {}
        language, by_field = got[got.field < 0], got[(got.field >= 0) & got.source.isna()]
        pairs[language.i] += language.v
        prior[by_field.field, by_field.i] += by_field.v
        for r in got[got.source.notna()].itertuples():
            cut.setdefault((r.source, r.field), np.zeros(len(CHAINS)))[r.i] += r.v
        prior /= prior.sum(axis=1, keepdims=True)
        moved = np.abs(prior - model.prior).max()
        model = Model(fields, prior, _log_pairs(pairs), cut)
        if moved <= TOLERANCE:
            break
    judged = materialize(tried.mapInArrow(_judge(model), "field string, source string, name string, chain string, text string, damaged double").filter("damaged >= 0.5 and name <> ''"), "judged")
    for t in (cands, plain, tried):
        discard(t)
    # A source's (field, name) is judged once; its records are found again by equality, however many they are.
    key = canonical(F.col("field"), F.col("source"), F.col("name"))
    clear = ~F.col("text").contains(LOST)
    found = judged.select(key.alias("key"), "damaged", "chain", F.when(clear, F.col("text")).alias("restored"))
    rows = spread_join(named.select(key.alias("key"), "field", "row_key", "name"), found, "key", uses.select(key.alias("k"), "n"))
    return rows.select("field", "row_key", "name", "damaged", "chain", "restored")
