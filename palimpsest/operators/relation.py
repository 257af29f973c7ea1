"""A fluent relational algebra over lazy DataFrames, for use from Python; the JSON language has the same semantics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


class Relation:
    """A DataFrame with set-minded operators. Nothing runs before one of the ``to_`` methods, ``len`` or iteration."""

    def __init__(self, df: DataFrame, name: str = ""):
        self.df, self.name = df, name

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.df.columns)

    def _with(self, df: DataFrame) -> Relation:
        return Relation(df, self.name)

    def _known(self, *names: str) -> None:
        missing = [n for n in names if n not in self.df.columns]
        if missing:
            raise KeyError(f"no such column: {', '.join(missing)}")

    def select(self, condition: Column) -> Relation:
        """Rows for which the condition holds; unknown counts as false."""
        return self._with(self.df.filter(F.coalesce(condition, F.lit(False))))

    def select_by(self, column: str, value) -> Relation:
        self._known(column)
        return self._with(self.df.filter(F.col(column).eqNullSafe(F.lit(value))))

    def select_where(self, test: Callable[[dict], bool]) -> Relation:
        """Rows for which a Python function of the row holds. Slow: prefer ``select``. Works on Arrow batches."""
        @F.pandas_udf(BooleanType())
        def holds(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([bool(test(r)) for r in rows.to_dict("records")])

        return self._with(self.df.filter(holds(F.struct(*self.df.columns))))

    def project(self, *names: str) -> Relation:
        """The columns, without repeated rows."""
        self._known(*names)
        return self._with(self.df.select(*names).distinct())

    def rename(self, names: dict[str, str]) -> Relation:
        return self._with(self.df.withColumnsRenamed(names))

    def update(self, condition: Column, column: str, value) -> tuple[Relation, int]:
        """A relation with ``column`` set where the condition holds, and the number of those rows."""
        self._known(column)
        hit = F.coalesce(condition, F.lit(False))
        kind = self.df.schema[column].dataType
        out = self.df.withColumn(column, F.when(hit, F.lit(value).cast(kind)).otherwise(F.col(column)))
        return self._with(out), self.df.filter(hit).count()

    def _other(self, other: Relation, keep: set[str]) -> DataFrame:
        taken = set(self.df.columns)
        return other.df.withColumnsRenamed({c: f"{c}_right" for c in other.df.columns if c in taken and c not in keep})

    def join(self, other: Relation, on: str | list[str], how: str = "inner") -> Relation:
        """Equi-join on equally named columns; null keys never match. Right columns that clash get ``_right``; a right
        join lists the right side's columns first."""
        keys = [on] if isinstance(on, str) else list(on)
        self._known(*keys)
        other._known(*keys)
        r = self._other(other, set(keys))
        out = self.df.join(r, keys, how)
        first = r.columns if how == "right" else self.df.columns
        rest = [c for c in out.columns if c not in first]
        return self._with(out.select(*[f"`{c}`" for c in [*first, *rest]]))

    def join_left(self, other: Relation, on) -> Relation:
        return self.join(other, on, "left")

    def join_right(self, other: Relation, on) -> Relation:
        return self.join(other, on, "right")

    def join_full(self, other: Relation, on) -> Relation:
        return self.join(other, on, "full")

    def join_theta(self, other: Relation, condition: Callable[[Callable, Callable], Column], how: str = "inner") -> Relation:
        """Join on any condition, given as a function of two column getters: ``lambda l, r: l("a") < r("b")``. An
        inequality costs the product of the sides: give it an equality too where there is one."""
        r = self._other(other, set())
        left, right = self.df.alias("l"), r.alias("r")
        real = dict(zip(other.df.columns, r.columns))
        cond = condition(lambda c: F.col(f"l.`{c}`"), lambda c: F.col(f"r.`{real[c]}`"))
        out = left.join(right, F.coalesce(cond, F.lit(False)), how)
        order = [*r.columns, *self.df.columns] if how == "right" else [*self.df.columns, *r.columns]
        return self._with(out.select(*[f"`{c}`" for c in order]))

    def group_by(self, keys: list[str], **aggs: Column) -> Relation:
        self._known(*keys)
        if not aggs:
            return self.project(*keys)
        return self._with(self.df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]))

    def distinct_count(self, column: str) -> int:
        """Exact number of values, null being one of them."""
        self._known(column)
        row = self.df.agg(F.countDistinct(column).alias("n"), F.max(F.col(column).isNull().cast("int")).alias("null")).first()
        return row.n + (row.null or 0)

    def union_all(self, other: Relation) -> Relation:
        return self._with(self.df.unionByName(other.df))

    def union(self, other: Relation) -> Relation:
        return self._with(self.df.unionByName(other.df).distinct())

    def minus(self, other: Relation) -> Relation:
        return self._with(self.df.select(*self.columns).subtract(other.df.select(*self.columns)))

    def intersect(self, other: Relation) -> Relation:
        return self._with(self.df.select(*self.columns).intersect(other.df.select(*self.columns)))

    def order_by(self, column: str, descending: bool = False) -> Relation:
        self._known(column)
        c = F.col(column)
        return self._with(self.df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last()))

    def limit(self, n: int, offset: int = 0) -> Relation:
        return self._with(self.df.offset(offset).limit(n))

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self):
        return self.df.toLocalIterator()

    def to_rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()]

    def to_dicts(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def to_pandas(self):
        return self.df.toPandas()
