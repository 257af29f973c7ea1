"""Validation against the catalogue and compilation of queries to lazy DataFrames. Optimising is left to Catalyst."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from ..operators import graph as G
from ..operators import predicates as P
from .dsl import GRAPH, RANGES, STRINGS, Join, Pred, Query, QueryParseError, QueryValidationError, Ref, Source, parse, walk

PATH = "virtual_path"


@dataclass
class Table:
    """A DataFrame whose columns have unique names, and what each is called: (relation, column, unique name)."""

    df: DataFrame
    scope: list[tuple[str | None, str, str]]

    def find(self, ref: Ref) -> str | None:
        """A qualified name is exact; a bare one is the leftmost of its name."""
        for relation, name, real in self.scope:
            if name == ref.name and ref.relation in (None, relation):
                return real
        if ref.relation is None:
            return next((real for _, _, real in self.scope if real == ref.name), None)
        dotted = f"{ref.relation}.{ref.name}"
        return next((real for _, name, real in self.scope if name == dotted), None)

    def kind(self, real: str) -> DataType:
        return self.df.schema[real].dataType

    def col(self, ref: Ref) -> Column:
        real = self.find(ref)
        if real is None:
            raise QueryValidationError([f"Column not found: {ref}"])
        return F.col(f"`{real}`")


def run(catalog, spec, tiebreak: list[str] | None = None) -> DataFrame:
    query = spec if isinstance(spec, Query) else parse(spec)
    errors = validate(catalog, query)
    if errors:
        raise QueryValidationError(errors)
    return compile_query(catalog, query, tiebreak).df


# --- Validation -------------------------------------------------------------------------------------------------------


def validate(catalog, q: Query) -> list[str]:
    """All that keeps ``q`` from running: unknown relations and columns, ill-typed predicates, stray select columns."""
    errors: list[str] = []
    base = _source_table(catalog, q.source, errors)
    if base is None:
        return errors
    table = base
    for j in q.joins:
        right = _source_table(catalog, j.source, errors)
        if right is None:
            return errors
        table = _joined_scope(table, right)
        _check(catalog, table, j.on, errors)
        if j.how == "full":
            warnings.warn("full join: both sides are kept whole", stacklevel=3)
    if q.where is not None:
        _check(catalog, table, q.where, errors)
    if q.keys is not None:
        for k in q.keys:
            if table.find(k) is None:
                errors.append(f"Group column not found: {k}")
        for a in q.aggs.values():
            if a.column is not None and table.find(a.column) is None:
                errors.append(f"Column not found: {a.column}")
            if a.where is not None:
                _check(catalog, table, a.where, errors)
        if errors:
            return errors
        names = [k.name for k in q.keys] + list(q.aggs)
        for c in q.select or ():
            if c.name not in names and str(c) not in names:
                errors.append(f"Selected column is neither a group column nor an aggregate: {c}")
        if q.having is not None:
            grouped = _group(_Shape(catalog), table, q)
            _check(catalog, grouped, q.having, errors)
        if q.order is not None and q.order[0].name not in names:
            errors.append(f"Column not found: {q.order[0]}")
        return errors
    for c in [*(q.select or ()), *([q.order[0]] if q.order else [])]:
        if table.find(c) is None:
            errors.append(f"Column not found: {c}")
    return errors


class _Shape:
    """A catalogue of which only names and types are asked: closures, which run when they are built, are left out."""

    def __init__(self, catalog):
        self.catalog = catalog

    def __contains__(self, name: str) -> bool:
        return name in self.catalog

    def __getitem__(self, name: str) -> DataFrame:
        return self.catalog[name]


def _source_table(catalog, s: Source, errors: list[str]) -> Table | None:
    if s.query is not None:
        inner = validate(catalog, s.query)
        errors += inner
        return None if inner else compile_query(_Shape(catalog), s.query, None)
    name = s.relation or ("dependency_cycles" if s.graph == "find_cycles" else "files")
    if name not in catalog:
        errors.append(f"Relation not found: {name}")
        return None
    df = catalog[name]
    return Table(df, [(name, c, c) for c in df.columns])


def _joined_scope(left: Table, right: Table) -> Table:
    """Both sides as one table without joining them: enough to look up names and types."""
    named = _unique(right, {real for _, _, real in left.scope})
    fields = [*left.df.schema.fields, *named.df.schema.fields]
    empty = left.df.sparkSession.createDataFrame([], left.df.schema.__class__(fields))
    return Table(empty, left.scope + named.scope)


def _check(catalog, t: Table, p: Pred, errors: list[str]) -> None:
    for x in walk(p):
        if x.column is None:
            continue
        real = t.find(x.column)
        if real is None:
            errors.append(f"Column not found: {x.column}")
            continue
        kind = t.kind(real)
        if isinstance(x.value, Ref):
            other = t.find(x.value)
            if other is None:
                errors.append(f"Column not found: {x.value}")
        if x.op in RANGES and not isinstance(kind, NumericType):
            errors.append(f"'{x.op}' needs a numeric column: {x.column} is {kind.simpleString()}")
        if x.op in RANGES and not isinstance(x.value, (int, float, Ref, type(None))):
            errors.append(f"'{x.op}' needs a number: {x.value!r}")
        if (x.op == "like" or x.op in STRINGS or x.op in GRAPH) and not isinstance(kind, StringType):
            errors.append(f"'{x.op}' needs a string column: {x.column} is {kind.simpleString()}")
        if x.op.endswith("exists_in"):
            relation, column = x.value
            if not isinstance(relation, str) or relation not in catalog:
                errors.append(f"Relation not found: {relation}")
            elif column not in catalog[relation].columns:
                errors.append(f"Column not found: {relation}.{column}")


# --- Compilation ------------------------------------------------------------------------------------------------------


def compile_query(catalog, q: Query, tiebreak: list[str] | None = None) -> Table:
    """source, joins, where, group_by, having, order_by, limit and offset, select (distinct unless ``*``), in this order."""
    t = _scan(catalog, q.source)
    for j in q.joins:
        t = _join(catalog, t, _scan(catalog, j.source), j)
    if q.where is not None:
        t = _filter(catalog, t, q.where)
    if q.keys is not None:
        t = _group(catalog, t, q)
        if q.having is not None:
            t = _filter(catalog, t, q.having)
    if q.order is not None:
        by, down = q.order
        keys = [t.col(by).desc_nulls_last() if down else t.col(by).asc_nulls_last()]
        keys += [F.col(f"`{c}`").asc_nulls_last() for c in tiebreak or [] if c in t.df.columns]
        t = Table(t.df.orderBy(*keys), t.scope)
    if q.offset:
        t = Table(t.df.offset(q.offset), t.scope)
    if q.limit is not None:
        t = Table(t.df.limit(q.limit), t.scope)
    if q.select is None:
        return t
    reals = [t.find(c) for c in q.select]
    names = _names([c.name for c in q.select])
    df = t.df.select(*[F.col(f"`{r}`").alias(n) for r, n in zip(reals, names)])
    ordered = q.order is not None and q.limit is None and not q.offset
    df = df.distinct()
    if ordered and (at := next((n for r, n in zip(reals, names) if r == t.find(q.order[0])), None)):
        df = df.orderBy(F.col(f"`{at}`").desc_nulls_last() if q.order[1] else F.col(f"`{at}`").asc_nulls_last())
    return Table(df, [(None, n, n) for n in names])


def _names(wanted: list[str]) -> list[str]:
    out: list[str] = []
    for n in wanted:
        while n in out:
            n += "_right"
        out.append(n)
    return out


def _scan(catalog, s: Source) -> Table:
    if s.query is not None:
        return compile_query(catalog, s.query)
    if s.graph == "find_cycles":
        df, name = catalog["dependency_cycles"], "dependency_cycles"
    elif s.graph:
        name = "files"
        if isinstance(catalog, _Shape):
            return Table(catalog[name], [(name, c, c) for c in catalog[name].columns])
        near = G.descendants_of(catalog.edges, s.start) if s.graph == "descendants_of" else G.ancestors_of(catalog.edges, s.start)
        files = catalog["files"]
        df = files.join(near, files[PATH] == near["id"], "left_semi")
    else:
        df, name = catalog[s.relation], s.relation
    return Table(df, [(name, c, c) for c in df.columns])


def _unique(t: Table, taken: set[str]) -> Table:
    """The same table with columns that clash with none of ``taken``."""
    new, scope = {}, []
    used = set(taken) | set(t.df.columns)
    for relation, name, real in t.scope:
        n = real
        if n in taken:
            while n in used:
                n += "_right"
            new[real] = n
            used.add(n)
        scope.append((relation, name, n))
    return Table(t.df.withColumnsRenamed(new) if new else t.df, scope)


def _equi(left: Table, right: Table, p: Pred) -> list[tuple[str, str]]:
    """Pairs of (left, right) columns that the conjuncts of ``p`` set equal, whichever side each is written on."""
    conjuncts = p.parts if p.op == "and" else (p,)
    out = []
    for c in conjuncts:
        if c.op == "and":
            out += _equi(left, right, c)
        elif c.op == "eq" and isinstance(c.value, Ref):
            a, b = left.find(c.column), right.find(c.value)
            if a is None or b is None or c.column == c.value and c.column.relation is not None:
                a, b = left.find(c.value), right.find(c.column)
            if a is not None and b is not None:
                out.append((a, b))
    return out


def _join(catalog, left: Table, right: Table, j: Join) -> Table:
    pairs = _equi(left, right, j.on)
    r = _unique(right, {real for _, _, real in left.scope})
    renamed = {old[2]: new[2] for old, new in zip(right.scope, r.scope)}
    pairs = [(a, renamed[b]) for a, b in pairs]
    both = Table(left.df, left.scope + r.scope)
    rest = _rest(left, right, j.on)
    l_df, r_df, flags = left.df, r.df, {}
    for x in {x: None for c in rest for x in walk(c) if _asks_catalog(x)}:  # told on the side that has the column, before the join
        real = both.find(x.column)
        flags[x] = f"__on{len(flags)}"
        if real in left.df.columns:
            l_df = _mark(l_df, F.col(f"`{real}`"), _keys_of(catalog, x), flags[x])
        else:
            r_df = _mark(r_df, F.col(f"`{real}`"), _keys_of(catalog, x), flags[x])
    on = F.lit(True)
    for a, b in pairs:  # plain equality: null keys never match
        on = on & (F.col(f"`{a}`") == F.col(f"`{b}`"))
    for c in rest:
        on = on & _on_column(both, r, c, flags)
    df = l_df.join(r_df, on, {"inner": "inner", "left": "left", "right": "right", "full": "full"}[j.how]).drop(*flags.values())
    drop: list[str] = []
    shared = [(a, b) for a, b in pairs if _plain(left, a) == _plain(r, b)]
    for a, b in shared:  # one column for a key of one name, taken from the side that has it
        if j.how in ("right", "full"):
            df = df.withColumn(a, F.coalesce(F.col(f"`{a}`"), F.col(f"`{b}`")))
        drop.append(b)
    df = df.drop(*drop)
    merged = dict((b, a) for a, b in shared)
    lscope = left.scope
    rscope = [(rel, name, merged.get(real, real)) for rel, name, real in r.scope]
    if j.how == "right":
        order = list(dict.fromkeys([x[2] for x in rscope] + [x[2] for x in lscope]))
        return Table(df.select(*[f"`{c}`" for c in order]), lscope + rscope)
    return Table(df, lscope + rscope)


def _plain(t: Table, real: str) -> str:
    return next(name for _, name, x in t.scope if x == real)


def _rest(left: Table, right: Table, p: Pred) -> list[Pred]:
    if p.op == "and":
        return [x for c in p.parts for x in _rest(left, right, c)]
    return [] if p.op == "eq" and isinstance(p.value, Ref) and _equi(left, right, p) else [p]


def _on_column(both: Table, right: Table, p: Pred, flags: dict[Pred, str]) -> Column:
    """A residual ON condition. A bare name on the left of a comparison is the left table's, on the right the right's."""
    if p.op in ("and", "or", "not"):
        parts = [_on_column(both, right, x, flags) for x in p.parts]
        return _boolean(p.op, parts)
    if p in flags:
        hit = F.coalesce(F.col(flags[p]), F.lit(False))
        return ~hit if p.op.startswith("not") else hit
    real = both.find(p.column)
    kinds = {f.name: f.dataType for f in [*both.df.schema.fields, *right.df.schema.fields]}
    if isinstance(p.value, Ref):
        other = right.find(p.value) if p.value.relation is None and right.find(p.value) else both.find(p.value)
        a, b = F.col(f"`{real}`"), F.col(f"`{other}`")
        if p.op in RANGES:
            return P.compare(a, p.op, b)
        return a.eqNullSafe(b) if p.op == "eq" else ~a.eqNullSafe(b)
    return _value_test(F.col(f"`{real}`"), p, kinds[real])


def _boolean(op: str, parts: list[Column]) -> Column:
    if op == "not":
        return ~parts[0]
    out = parts[0]
    for c in parts[1:]:
        out = out & c if op == "and" else out | c
    return out


def _value_test(c: Column, p: Pred, kind: DataType) -> Column:
    if p.op in ("eq", "neq"):
        hit = P.equals(c, p.value, kind)
        return hit if p.op == "eq" else ~hit
    if p.op in RANGES:
        return P.compare_literal(c, p.op, p.value, kind)
    if p.op == "like":
        return P.like(c, p.value)
    if p.op in ("in", "not_in"):
        hit = P.member(c, p.value, kind)
        return hit if p.op == "in" else ~hit
    if p.op in STRINGS:
        return P.text_test(c, p.op, p.value)
    if p.op in ("is_null", "is_not_null"):
        return c.isNull() if p.op == "is_null" else c.isNotNull()
    raise QueryParseError(f"Unknown predicate: {p.op}")


def _asks_catalog(p: Pred) -> bool:
    """Whether the predicate depends on other rows than its own: memberships and tests of the graph."""
    return p.op.endswith("exists_in") or p.op in GRAPH


def _keys_of(catalog, p: Pred) -> DataFrame:
    """(__k) of the values for which such a predicate, or the one that it negates, holds."""
    if p.op.endswith("exists_in"):
        relation, column = p.value
        return catalog[relation].select(F.col(f"`{column}`").alias("__k")).distinct()
    edges = catalog.edges
    nodes = G.nodes_of(edges)
    if p.op == "ancestor_is_map":
        near = G.reached_by_other(edges, G.ending_with(nodes, [".bsp"], False))
    else:
        ends = [".nut"] if p.op == "descendant_is_script" else list(p.value)
        near = G.reached_by_other(G.reverse(edges), G.ending_with(nodes, ends, p.op == "descendant_is_any"))
    return near.select(F.col("id").alias("__k"))


def _filter(catalog, t: Table, p: Pred) -> Table:
    """Filter; memberships among the top conjuncts become semi and anti joins, others flags joined to the rows."""
    conjuncts = list(p.parts) if p.op == "and" else [p]
    later = []
    for c in conjuncts:
        if c.op.endswith("exists_in"):
            relation, column = c.value
            there = catalog[relation].select(F.col(f"`{column}`").alias("__there")).distinct()
            how = "left_anti" if c.op.startswith("not") else "left_semi"
            t = Table(t.df.join(there, t.col(c.column).eqNullSafe(F.col("__there")), how), t.scope)
        else:
            later.append(c)
    if not later:
        return t
    keep = t.df.columns
    conds = []
    for c in later:
        t, cond = _condition(catalog, t, c)
        conds.append(cond)
    return Table(t.df.filter(_boolean("and", conds)).select(*[f"`{c}`" for c in keep]), t.scope)


def _condition(catalog, t: Table, p: Pred) -> tuple[Table, Column]:
    if p.op in ("and", "or", "not"):
        parts = []
        for x in p.parts:
            t, c = _condition(catalog, t, x)
            parts.append(c)
        return t, _boolean(p.op, parts)
    c = t.col(p.column)
    if isinstance(p.value, Ref):
        other = t.col(p.value)
        if p.op in RANGES:
            return t, P.compare(c, p.op, other)
        return t, c.eqNullSafe(other) if p.op == "eq" else ~c.eqNullSafe(other)
    if _asks_catalog(p):
        if isinstance(catalog, _Shape):
            return t, F.lit(False)
        name = f"__f{sum(x.startswith('__f') for x in t.df.columns)}"
        hit = F.coalesce(F.col(name), F.lit(False))
        return Table(_mark(t.df, c, _keys_of(catalog, p), name), t.scope), ~hit if p.op.startswith("not") else hit
    return t, _value_test(c, p, t.kind(t.find(p.column)))


def _mark(df: DataFrame, c: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that is true where ``c`` is among the keys (__k, distinct), null elsewhere."""
    keys = keys.select(F.col("__k").alias(f"{name}k"), F.lit(True).alias(name))
    return df.join(keys, c.eqNullSafe(F.col(f"{name}k")), "left").drop(f"{name}k")


def _group(catalog, t: Table, q: Query) -> Table:
    aggs = []
    for name, a in q.aggs.items():
        if a.kind == "count":
            c = F.count(F.lit(1))
        elif a.kind == "count_where":
            t, cond = _condition(catalog, t, a.where)
            c = F.count_if(cond)
        else:
            v = t.col(a.column)
            if a.kind in ("sum", "avg"):
                v = (v.cast("int") if isinstance(t.kind(t.find(a.column)), BooleanType) else v).cast("double")
            c = {"sum": lambda v=v: F.coalesce(F.sum(v), F.lit(0.0)), "avg": lambda v=v: F.avg(v), "min": lambda v=v: F.min(v), "max": lambda v=v: F.max(v)}[a.kind]()
        aggs.append(c.alias(name))
    keys = [t.col(k).alias(k.name) for k in q.keys]
    names = [k.name for k in q.keys] + list(q.aggs)
    if not keys:
        # A global group of no rows is no group.
        df = t.df.agg(F.count(F.lit(1)).alias("__n"), *aggs).filter("__n > 0").drop("__n")
    elif not aggs:
        df = t.df.select(*keys).distinct()
    else:
        df = t.df.groupBy(*keys).agg(*aggs)
    relations = {k.name: next((rel for rel, n, real in t.scope if real == t.find(k)), None) for k in q.keys}
    return Table(df, [(relations.get(n), n, n) for n in names])


__all__ = ["QueryParseError", "QueryValidationError", "compile_query", "run", "validate"]
