"""Best representative of each duplicate group by iterative truth discovery.

Sources and values judge each other in turn: a value's support is the summed weight of the sources that claim it, a
source's reliability the share of its claims that currently win, smoothed by a Beta prior; the two steps repeat until no
reliability moves by more than a tolerance. All claims of a group are brought together once, as one row with arrays of
numbers, and written down: a round reads these numbers where they lie, weighs whole batches of groups at once, and
exchanges one partial row per source and task. Only groups of very many claims, which no task should hold, are weighed by
aggregations instead, with the same result.

A declared order of trust may be given as the ``rank`` of each claim. It is compared before the support, which then decides
among claims of equal rank: reliabilities learned from agreement never overrule what is declared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..operators.skew import spread_join
from ..scratch import discard, materialize

#: Bytes of weights that travel to every task (8 a source); with more sources the weights are joined by shuffle.
WEIGHT_BYTES = 64 << 20
#: Bytes of the table of sources up to which it is broadcast while their numbers are given out.
DICTIONARY_BYTES = 32 << 20
#: Claims of a group that one row holds.
GROUP_CLAIMS = 20_000
#: Beta prior of a source's reliability: as if it had won and lost so many claims before.
PRIOR_WON, PRIOR_LOST = 2.0, 2.0
#: Reliabilities are kept off 1 so that weights stay finite.
CEILING = 0.999
UNIT = 1_000_000
START = PRIOR_WON / (PRIOR_WON + PRIOR_LOST)


def _weights(r: np.ndarray) -> np.ndarray:
    """-ln(1 - reliability) in whole millionths: integer sums do not depend on their order."""
    return np.round(-np.log(1 - np.minimum(r, CEILING)) * UNIT).astype(np.int64)


def _sources(facts: DataFrame) -> DataFrame:
    """(src, n_facts, s): every source with a number from 0 on, without gaps."""
    return numbered(facts.groupBy("src").agg(F.count(F.lit(1)).alias("n_facts")), "s")


def _flags(first: bool | Column, *changed: Column) -> Column:
    out = F.lit(0)
    for i, c in enumerate(changed):
        out = out + F.when(first | c, 1 << i).otherwise(0)
    return out


def _group_rows(facts: DataFrame) -> DataFrame:
    """(grp, low, n, c): one row per group. c holds its distinct claims in order of field, value and source, each with its
    place in the order of ranks and flags for a new value (1) and a new field (2); what begins a new rank has flag 4."""
    own = F.transform("claims", lambda c: F.struct(c["rank"].alias("rank"), c["field"].alias("field"), c["value"].alias("value"), F.col("s").alias("s")))
    g = facts.groupBy("grp").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.flatten(F.collect_list(own)).alias("c"))
    by_rank = F.transform(F.sort_array(F.array_distinct("c")), lambda x, i: F.struct(x["field"].alias("field"), x["value"].alias("value"), x["s"].alias("s"), i.alias("ro"), x["rank"].alias("rank")))
    g = g.withColumn("c", by_rank)
    ranked = F.transform("c", lambda x, i: F.struct(x["field"].alias("field"), x["value"].alias("value"), x["s"].alias("s"), x["ro"].alias("ro"), _flags(i == 0, ~x["rank"].eqNullSafe(F.get("c", i - 1)["rank"])).alias("nr")))
    g = g.withColumn("c", F.sort_array(ranked))

    def shown(x: Column, i: Column) -> Column:
        before = F.get("c", i - 1)
        field = x["field"] != before["field"]
        return F.struct(x["s"].alias("s"), x["ro"].alias("ro"), (_flags(i == 0, field | (x["value"] != before["value"]), field) + x["nr"] * 4).alias("flags"), x["field"].alias("field"), x["value"].alias("value"))

    return g.withColumn("c", F.transform("c", shown))


class _Batch:
    """Claims of a batch of groups as flat arrays, and the winners among their values."""

    def __init__(self, s: pa.ListArray, ro: pa.ListArray, flags: pa.ListArray, w: np.ndarray):
        self.sizes = np.diff(s.offsets.to_numpy())
        self.s = s.flatten().to_numpy()
        marks, place = flags.flatten().to_numpy(), ro.flatten().to_numpy()
        starts = np.cumsum(self.sizes) - self.sizes
        place = place + np.repeat(starts, self.sizes)
        by_rank = np.empty(len(marks), np.int64)
        by_rank[place] = marks >> 2 & 1  # a claim's flag of a new rank, in the order of ranks
        rank = np.cumsum(by_rank)[place]
        self.values = np.flatnonzero(marks & 1)
        self.support = np.add.reduceat(w[self.s], self.values) if len(self.values) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(rank, self.values) if len(self.values) else rank
        self.cell = np.cumsum(marks >> 1 & 1)[self.values]
        order = np.lexsort((self.support, top, self.cell))  # stable: of equals the greater value comes last
        last = np.flatnonzero(np.diff(np.append(self.cell[order], -1)) != 0)
        self.winners = order[last]

    def won(self) -> np.ndarray:
        """Whether each claim's value wins."""
        hit = np.zeros(len(self.values), bool)
        hit[self.winners] = True
        return np.repeat(hit, np.diff(np.append(self.values, len(self.s))))


def _tally(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        won, n = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for b in batches:
            x = _Batch(*b.columns, w)
            won += np.bincount(x.s[x.won()], minlength=len(w))
            n += np.bincount(x.s, minlength=len(w))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(won[at]), pa.array(n[at])], ["s", "won", "n"])

    return run


CELLS = "array<struct<field:int,value:string,support:bigint,n_values:bigint>>"


def _choose(w: np.ndarray):
    """(grp, low, n, s, ro, flags, field, value) to (grp, low, n, cells) with the winner of each field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Batch(*b.columns[3:6], w)
            at = pa.array(x.values[x.winners])
            field, value = (b.column(i).flatten().take(at) for i in (6, 7))
            many = np.bincount(x.cell, minlength=1)[x.cell[x.winners]]
            cells = pa.StructArray.from_arrays([field, value, pa.array(x.support[x.winners]), pa.array(many.astype(np.int64))], ["field", "value", "support", "n_values"])
            group = np.repeat(np.arange(len(x.sizes)), x.sizes)[x.values[x.winners]]
            ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(x.sizes)))])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), cells)], ["grp", "low", "n", "cells"])

    return run


def _add(column: str, values: np.ndarray):
    """Adds to rows (..., s) the number of their source as a last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(b.schema.get_field_index("s")).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values[s])], [*b.schema.names, column])

    return run


def _schema(df: DataFrame, column: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {column}"


def _best(claims: DataFrame, trust: np.ndarray | DataFrame) -> DataFrame:
    """(grp, field, best, n_values) by aggregations combined before they are moved: no task holds a whole group."""
    if isinstance(trust, np.ndarray):
        judged = claims.mapInArrow(_add("w", _weights(trust)), _schema(claims, "w bigint"))
    else:
        w = F.round(-F.log(1 - F.least(F.coalesce("reliability", F.lit(START)), F.lit(CEILING))) * UNIT).cast("long")
        judged = claims.join(trust, "s", "left").withColumn("w", w)
    votes = judged.groupBy("grp", "field", "value").agg(F.sum("w").alias("support"), F.max("rank").alias("rank"))
    return votes.groupBy("grp", "field").agg(F.max(F.struct("rank", "support", "value")).alias("best"), F.count(F.lit(1)).alias("n_values"))


def discover(facts: DataFrame, max_rounds: int = 12, tolerance: float = 0.005, group_claims: int = GROUP_CLAIMS, weight_bytes: int = WEIGHT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(groups, sources) from ``facts``: grp, src, low, n, claims ARRAY<STRUCT<field INT, value STRING, rank>>.

    groups: grp, low (the least), n (summed), cells: for each claimed field its value, support (in millionths) and n_values.
    sources: src, reliability, n_claims. A null value is no claim; rank may be null. A null src is one anonymous source.
    A source that claims a value repeatedly in one group counts once. Ties in rank and support go to the greater value
    in string order. A group without claims has no cells; empty facts give empty results. The last two parameters bound
    memory only: the result is the same with any.
    """
    facts = facts.select("grp", F.coalesce("src", F.lit("")).alias("src"), "low", "n", F.filter("claims", lambda c: c["value"].isNotNull()).alias("claims"))
    facts = materialize(facts, "facts")
    sources = _sources(facts)
    size = sources.agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("src") + 16).alias("b")).first()
    if size.b is not None and size.b <= DICTIONARY_BYTES:
        coded = facts.join(F.broadcast(sources.select("src", "s")), "src").drop("src")
    else:
        coded = spread_join(facts, sources.select("src", "s"), "src", sources.select(F.col("src").alias("k"), F.col("n_facts").alias("n"))).drop("src")
    dense = size.m * 8 <= weight_bytes
    # Groups that are too large for one row, and all of them where the weights are.
    many = coded.groupBy("grp").agg(F.sum(F.size("claims")).alias("m")).filter(F.col("m") > (group_claims if dense else -1)).select("grp")
    many = materialize(many, "many")
    none = many.isEmpty()
    rows = large = None
    if dense:
        rows = materialize(_group_rows(coded if none else coded.join(many, "grp", "left_anti")), "claims")
    if not none:
        large = materialize(coded.join(many, "grp", "left_semi"), "large")
        claims = large.select("grp", "s", F.inline("claims")).groupBy("grp", "field", "value", "s").agg(F.max("rank").alias("rank"))
        claims = materialize(claims, "large_claims")
    trust: np.ndarray | DataFrame = np.full(max(size.m, 1), START)
    counts = np.zeros(max(size.m, 1), np.int64)
    if not dense:
        trust = materialize(sources.select("s", F.lit(START).alias("reliability"), F.lit(0).cast("long").alias("n_claims")), "trust")
    for _ in range(max_rounds if size.m else 0):
        parts = []
        if rows is not None:
            parts.append(rows.select("c.s", "c.ro", "c.flags").mapInArrow(_tally(_weights(trust)), "s int, won bigint, n bigint"))
        if large is not None:
            best = _best(claims, trust).select("grp", "field", F.col("best.value").alias("top"))
            parts.append(claims.join(best, ["grp", "field"]).groupBy("s").agg(F.count_if(F.col("value") == F.col("top")).alias("won"), F.count(F.lit(1)).alias("n")))
        tally = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        tally = tally.groupBy("s").agg(F.sum("won").alias("won"), F.sum("n").alias("n"))
        if dense:
            got = tally.toPandas()  # one row per source, of which there are at most weight_bytes / 8
            new = np.full(len(trust), START)
            new[got.s] = (got.won + PRIOR_WON) / (got.n + PRIOR_WON + PRIOR_LOST)
            counts[got.s] = got.n
            moved = np.abs(new - trust).max()
        else:
            new = materialize(tally.select("s", ((F.col("won") + PRIOR_WON) / (F.col("n") + PRIOR_WON + PRIOR_LOST)).alias("reliability"), F.col("n").alias("n_claims")), "trust")
            moved = new.join(trust.select("s", F.col("reliability").alias("was")), "s").agg(F.max(F.abs(F.col("reliability") - F.col("was")))).first()[0] or 0.0
            discard(trust)
        trust = new
        if moved <= tolerance:
            break
    out = []
    if rows is not None:
        flat = rows.select("grp", "low", "n", "c.s", "c.ro", "c.flags", "c.field", "c.value")
        out.append(flat.mapInArrow(_choose(_weights(trust)), f"grp {facts.schema['grp'].dataType.simpleString()}, low {facts.schema['low'].dataType.simpleString()}, n bigint, cells {CELLS}"))
    if large is not None:
        cells = _best(claims, trust).groupBy("grp").agg(F.collect_list(F.struct("field", "best.value", F.col("best.support").alias("support"), "n_values")).alias("cells"))
        whole = large.groupBy("grp").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
        out.append(whole.join(cells, "grp", "left").select("grp", "low", "n", F.coalesce("cells", F.array().cast(CELLS)).alias("cells")))
    groups = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    if dense:
        numbered = sources.select("src", "s")
        numbered = numbered.mapInArrow(_add("reliability", trust), _schema(numbered, "reliability double"))
        known = numbered.mapInArrow(_add("n_claims", counts), _schema(numbered, "n_claims bigint"))
    else:
        known = sources.select("src", "s").join(trust, "s")
    return groups, known.select("src", "reliability", "n_claims").filter("n_claims > 0")


def cell(field: int, of: str = "value") -> Column:
    """A field's winner among a group's cells; null if nobody claims the field."""
    return F.get(F.filter("cells", lambda c: c["field"] == field), F.lit(0))[of]


def merge_groups(
    records: DataFrame,
    group: str,
    source: str,
    fields: list[str],
    blank_is_null: bool = True,
    max_rounds: int = 12,
    **bounds: int,
) -> tuple[DataFrame, DataFrame]:
    """Build one survivor per group, field by field: (group, one column per field as STRING, n_records), and the sources.

    A null (or, for strings, blank) value is no claim, so a filled field beats an empty one; a field nobody fills is null.
    Null groups are dropped; a group of one record survives as it is. Repeated records do not add weight.
    """
    cols = [F.col(f).cast("string") for f in fields]
    if blank_is_null:
        cols = [F.when(c.rlike(r"(?U)\S"), c) for c in cols]
    # A source's equal records are combined before anything is moved by group.
    names = [f"f{i}" for i in range(len(fields))]
    facts = records.filter(F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(source).cast("string").alias("src"), *[c.alias(n) for n, c in zip(names, cols)])
    facts = facts.groupBy("grp", "src", *names).agg(F.count(F.lit(1)).alias("n"))
    claims = F.array(*[F.struct(F.lit(i).alias("field"), F.col(n).alias("value"), F.lit(None).cast("int").alias("rank")) for i, n in enumerate(names)])
    groups, sources = discover(facts.select("grp", "src", F.lit(0).alias("low"), "n", claims.alias("claims")), max_rounds=max_rounds, **bounds)
    return groups.select(F.col("grp").alias(group), *[cell(i).alias(f) for i, f in enumerate(fields)], F.col("n").alias("n_records")), sources


def ranked_representatives(records: DataFrame, **bounds: int) -> DataFrame:
    """(group_id, win_id, name_id) from ``records``: grp, id BIGINT, src, rank (struct), eligible BOOLEAN, named BOOLEAN.

    Groups with two or more records, one of them eligible. group_id is the smallest id; win_id the winner of field
    ``win``, for which every eligible record claims itself; name_id likewise of field ``name``, claimed by eligible named
    records only, 0 if nobody claims it. A source speaks once per group and field, through its highest-ranked record.
    Null groups are dropped; a null eligible or named is false.
    """
    ok, named = F.coalesce("eligible", F.lit(False)), F.coalesce("named", F.lit(False))
    claim = F.struct("rank", F.col("id").alias("value"))
    facts = records.filter("grp is not null").groupBy("grp", F.coalesce("src", F.lit("")).alias("src")).agg(
        F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.max(F.when(ok, claim)).alias("win"), F.max(F.when(ok & named, claim)).alias("name")
    )
    claims = F.array(*[F.struct(F.lit(i).alias("field"), F.col(c)["value"].cast("string").alias("value"), F.col(c)["rank"].alias("rank")) for i, c in enumerate(("win", "name"))])
    groups, _ = discover(facts.select("grp", "src", "low", "n", claims.alias("claims")), **bounds)
    out = groups.filter("n >= 2").select(F.col("low").alias("group_id"), cell(0).cast("long").alias("win_id"), F.coalesce(cell(1).cast("long"), F.lit(0).cast("long")).alias("name_id"))
    return out.filter("win_id is not null")
