"""Two-valued predicates as columns: every builder returns a column that is never null, so ``~`` is plain negation."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType



def certain(c: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(c, F.lit(False))


def glob_regex(glob: str) -> str:
    """A Java pattern for a shell glob (``*``, ``?``, ``[seq]``, ``[!seq]``) over a whole string, line breaks included."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i : i + 1] == "!" else i + 1)
            if end < 0:
                out.append(r"\[")
                continue
            body = glob[i:end]
            i = end + 1
            negate = body.startswith("!")
            inner = re.sub(r"([\\\[\]&~^])", r"\\\1", body[1:] if negate else body)
            out.append(f"[{'^' if negate else ''}{inner}]")
        else:
            out.append(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", c))
    return rf"(?s)\A{''.join(out)}\z"


def fit_literal(value: Any, kind: DataType) -> Any:
    """``value`` as the column's type if nothing is lost, else NotImplemented: such a value equals nothing."""
    if value is None:
        return None
    if isinstance(kind, BooleanType):
        if isinstance(value, bool):
            return value
        return bool(value) if isinstance(value, (int, float)) and value in (0, 1) else NotImplemented
    if isinstance(kind, NumericType):
        if isinstance(value, bool):
            return int(value)
        return value if isinstance(value, (int, float)) else NotImplemented
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else NotImplemented
    return value


def equals(c: Column, value: Any, kind: DataType) -> Column:
    v = fit_literal(value, kind)
    return F.lit(False) if v is NotImplemented else c.eqNullSafe(F.lit(v))


def compare(c: Column, op: str, other: Column) -> Column:
    both = {"gt": c > other, "gte": c >= other, "lt": c < other, "lte": c <= other}
    return certain(both[op])


def compare_literal(c: Column, op: str, value: Any, kind: DataType) -> Column:
    v = fit_literal(value, kind)
    return F.lit(False) if v is NotImplemented or v is None else compare(c, op, F.lit(v))


def like(c: Column, glob: str) -> Column:
    return certain(c.rlike(glob_regex(glob)))


def member(c: Column, values: Iterable[Any], kind: DataType) -> Column:
    fitted = [fit_literal(v, kind) for v in values]
    real = [v for v in fitted if v is not None and v is not NotImplemented]
    hit = certain(c.isin(real)) if real else F.lit(False)
    return hit | c.isNull() if any(v is None for v in fitted) else hit


def text_test(c: Column, op: str, s: str) -> Column:
    t = c.cast("string")
    if op == "starts_with":
        return certain(t.startswith(s))
    if op == "ends_with":
        return certain(t.endswith(s))
    if op == "contains":
        return certain(t.contains(s))
    return certain(~t.contains(s))  # not_contains: a null contains nothing, and does not count as "not containing" either
