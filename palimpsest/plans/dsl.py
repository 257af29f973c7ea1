"""The JSON query language: abstract syntax and parser."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

RANGES = ("gt", "gte", "lt", "lte")
STRINGS = ("starts_with", "ends_with", "contains", "not_contains")
GRAPH = ("ancestor_is_map", "descendant_is_script", "descendant_is_any")
JOINS = ("inner", "left", "right", "full")


class QueryParseError(ValueError):
    """The query text is not a query."""


class QueryValidationError(ValueError):
    """The query does not fit the catalogue; ``errors`` lists all that is wrong."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Ref:
    name: str
    relation: str | None = None

    def __str__(self) -> str:
        return f"{self.relation}.{self.name}" if self.relation else self.name


@dataclass(frozen=True)
class Pred:
    """``op`` with a column and a value, or with sub-predicates for and, or, not."""

    op: str
    column: Ref | None = None
    value: Any = None
    parts: tuple[Pred, ...] = ()


@dataclass(frozen=True)
class Source:
    relation: str | None = None
    query: Query | None = None
    graph: str | None = None
    start: str | None = None


@dataclass(frozen=True)
class Join:
    how: str
    source: Source
    on: Pred


@dataclass(frozen=True)
class Agg:
    kind: str
    column: Ref | None = None
    where: Pred | None = None


@dataclass(frozen=True)
class Query:
    source: Source
    select: tuple[Ref, ...] | None = None  # None: all columns, duplicates kept
    where: Pred | None = None
    joins: tuple[Join, ...] = ()
    keys: tuple[Ref, ...] | None = None
    aggs: dict[str, Agg] = field(default_factory=dict)
    having: Pred | None = None
    order: tuple[Ref, bool] | None = None  # column, descending
    limit: int | None = None
    offset: int = 0


def _need(ok: bool, text: str) -> None:
    if not ok:
        raise QueryParseError(f"Failed to parse query: {text}")


def parse(spec: str | dict) -> Query:
    """A query from JSON text or its decoded form. Unknown top-level keys are comments."""
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except json.JSONDecodeError as e:
            raise QueryParseError(f"Failed to parse query: {e}") from e
    _need(isinstance(spec, dict), "a query is an object")
    _need("from" in spec, "missing key 'from'")
    _need("select" in spec, "missing key 'select'")
    _need(not ("join" in spec and "joins" in spec), "use either 'join' or 'joins'")
    joins = spec.get("joins", [spec["join"]] if "join" in spec else [])
    _need(isinstance(joins, list), "'joins' is a list")
    keys, aggs = None, {}
    if (g := spec.get("group_by")) is not None:
        _need(isinstance(g, dict) and isinstance(g.get("by"), list), "'group_by' needs a list 'by'")
        keys = tuple(_ref(c) for c in g["by"])
        aggs = {str(k): _agg(v) for k, v in g.get("agg", {}).items()}
    return Query(
        source=_source(spec["from"]),
        select=_select(spec["select"]),
        where=predicate(spec["where"]) if spec.get("where") is not None else None,
        joins=tuple(_join(j) for j in joins),
        keys=keys,
        aggs=aggs,
        having=predicate(spec["having"]) if spec.get("having") is not None else None,
        order=_order(spec["order_by"]) if spec.get("order_by") is not None else None,
        limit=_count(spec["limit"], "limit") if spec.get("limit") is not None else None,
        offset=_count(spec.get("offset") or 0, "offset"),
    )


def _count(v: Any, what: str) -> int:
    _need(isinstance(v, int) and not isinstance(v, bool), f"'{what}' must be an integer")
    _need(v >= 0, f"'{what}' must not be negative")
    return v


def _select(v: Any) -> tuple[Ref, ...] | None:
    _need(isinstance(v, list) and bool(v), "'select' is a list of columns")
    return None if v == ["*"] else tuple(_ref(c) for c in v)


def _ref(v: Any) -> Ref:
    if isinstance(v, str) and v:
        relation, dot, name = v.partition(".")
        return Ref(name, relation) if dot and relation and name else Ref(v)
    _need(isinstance(v, list) and len(v) in (1, 2) and all(isinstance(x, str) for x in v), f"not a column: {v!r}")
    return Ref(v[0]) if len(v) == 1 else Ref(v[1], v[0])


def _source(v: Any) -> Source:
    if isinstance(v, str):
        return Source(relation=v)
    _need(isinstance(v, dict) and len(v) == 1, f"not a source: {v!r}")
    kind, arg = next(iter(v.items()))
    if kind == "query":
        return Source(query=parse(arg))
    if kind in ("descendants_of", "ancestors_of"):
        _need(isinstance(arg, str) and bool(arg), f"'{kind}' needs a path")
        return Source(graph=kind, start=arg)
    _need(kind == "find_cycles", f"unknown source: {kind}")
    _need(arg is True, "'find_cycles' takes true")
    return Source(graph=kind)


def _join(v: Any) -> Join:
    _need(isinstance(v, dict) and "with" in v and "on" in v, "a join needs 'with' and 'on'")
    how = v.get("type", "inner")
    _need(how in JOINS, f"unknown join type: {how!r}")
    return Join(how, _source(v["with"]), predicate(v["on"]))


def _agg(v: Any) -> Agg:
    if v == "count":
        return Agg("count")
    if isinstance(v, dict) and set(v) == {"count_where"}:
        return Agg("count_where", where=predicate(v["count_where"]))
    _need(isinstance(v, list) and len(v) == 2 and v[0] in ("sum", "avg", "min", "max"), f"unknown aggregate: {v!r}")
    return Agg(v[0], _ref(v[1]))


def _order(v: Any) -> tuple[Ref, bool]:
    _need(isinstance(v, dict) and "by" in v, "'order_by' needs 'by'")
    _need(v.get("dir", "asc") in ("asc", "desc"), f"unknown direction: {v.get('dir')!r}")
    return _ref(v["by"]), v.get("dir") == "desc"


def predicate(v: Any) -> Pred:
    """One predicate: an object with exactly one operator."""
    _need(isinstance(v, dict) and len(v) == 1, "a predicate is an object with one operator")
    op, arg = next(iter(v.items()))
    if op in ("and", "or"):
        _need(isinstance(arg, list) and len(arg) >= 2, f"'{op}' needs two or more predicates")
        return Pred(op, parts=tuple(map(predicate, arg)))
    if op == "not":
        return Pred(op, parts=(predicate(arg),))
    if op in ("is_null", "is_not_null", "ancestor_is_map", "descendant_is_script"):
        return Pred(op, _ref(arg))
    if op == "descendant_is_any":
        _need(isinstance(arg, dict) and "column" in arg, "'descendant_is_any' needs a column")
        params = arg.get("params", {})
        ends = params.get("extensions", params.get("exts", [".nut"]))
        return Pred(op, _ref(arg["column"]), tuple(str(e).lower() for e in ends))
    known = ("eq", "neq", *RANGES, "like", "in", "not_in", *STRINGS, "exists_in", "not_exists_in")
    if op not in known:
        raise QueryParseError(f"Unknown predicate: {op}")
    _need(isinstance(arg, list) and len(arg) in ((2, 3) if op.endswith("exists_in") else (2,)), f"'{op}' takes a column and a value")
    if op in ("in", "not_in"):
        _need(isinstance(arg[1], list), f"'{op}' takes a list")
        return Pred(op, _ref(arg[0]), tuple(arg[1]))
    if op.endswith("exists_in"):
        return Pred(op, _ref(arg[0]), (arg[1], arg[2] if len(arg) == 3 else "virtual_path"))
    if op == "like" or op in STRINGS:
        return Pred(op, _ref(arg[0]), str(arg[1]))
    return Pred(op, _ref(arg[0]), _ref(arg[1]) if isinstance(arg[1], list) else arg[1])


def walk(p: Pred):
    yield p
    for x in p.parts:
        yield from walk(x)
