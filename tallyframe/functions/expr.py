"""Column helpers: missing values, finite arithmetic, and a predicate sugar."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN and NULL are one kind of missing; NULL is the one the engine works with."""
    wanted = set(df.columns if columns is None else columns)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS) and f.name in wanted}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in sorted(floats)}) if floats else df


def finite(column: Column) -> Column:
    """The value as a double if finite, else NULL."""
    value = column.cast("double")
    return F.when(F.abs(value) < F.lit(math.inf), value)


def divide(top: Column, bottom: Column) -> Column:
    """A finite quotient or NULL, never an ANSI error."""
    return finite(F.try_divide(top.cast("double"), bottom.cast("double")))


def guarded(column: Column, bad: Column, message: str) -> Column:
    """``column``, failing the job at the first row where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(column)


def is_missing(value: Any) -> bool:
    return value is None or (isinstance(value, float) and math.isnan(value))


def _literal(value: Any) -> Any:
    if is_missing(value):
        raise ValueError("compare with isna() or notna(), not with a missing literal")
    hash(value)
    return value


class Predicate:
    """A condition on rows, with SQL's three-valued logic."""

    def column(self) -> Column:
        raise NotImplementedError

    def required_columns(self) -> tuple[str, ...]:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return _Both("&", self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return _Both("|", self, other)

    def __invert__(self) -> Predicate:
        return _Not(self)

    def __bool__(self) -> bool:
        raise TypeError("combine predicates with & | ~")


@dataclass(frozen=True, eq=False)
class _Test(Predicate):
    name: str
    op: str
    value: Any = None

    def required_columns(self) -> tuple[str, ...]:
        return (self.name,)

    def column(self) -> Column:
        c = F.col(self.name)
        match self.op:
            case "isna":
                return c.isNull()
            case "notna":
                return c.isNotNull()
            case "isin":
                return c.isin(*self.value) if self.value else F.when(c.isNotNull(), F.lit(False))
            case "==":
                return c == F.lit(self.value)
            case "!=":
                return c != F.lit(self.value)
            case ">":
                return c > F.lit(self.value)
            case ">=":
                return c >= F.lit(self.value)
            case "<":
                return c < F.lit(self.value)
        return c <= F.lit(self.value)


@dataclass(frozen=True, eq=False)
class _Both(Predicate):
    op: str
    left: Predicate
    right: Predicate

    def __post_init__(self) -> None:
        if not isinstance(self.left, Predicate) or not isinstance(self.right, Predicate):
            raise TypeError("both sides must be predicates")

    def required_columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.left.required_columns(), *self.right.required_columns())))

    def column(self) -> Column:
        a, b = self.left.column(), self.right.column()
        return a & b if self.op == "&" else a | b


@dataclass(frozen=True, eq=False)
class _Not(Predicate):
    inner: Predicate

    def required_columns(self) -> tuple[str, ...]:
        return self.inner.required_columns()

    def column(self) -> Column:
        return ~self.inner.column()


class Col:
    """``Col("x") > 3`` and friends build predicates."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, name: str):
        if not isinstance(name, str) or not name:
            raise ValueError("a column name is needed")
        self.name = name

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return _Test(self.name, "==", _literal(value))

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return _Test(self.name, "!=", _literal(value))

    def __gt__(self, value: Any) -> Predicate:
        return _Test(self.name, ">", _literal(value))

    def __ge__(self, value: Any) -> Predicate:
        return _Test(self.name, ">=", _literal(value))

    def __lt__(self, value: Any) -> Predicate:
        return _Test(self.name, "<", _literal(value))

    def __le__(self, value: Any) -> Predicate:
        return _Test(self.name, "<=", _literal(value))

    def isin(self, values: Sequence[Any]) -> Predicate:
        if isinstance(values, (str, bytes)):
            raise TypeError("isin takes a sequence of values")
        return _Test(self.name, "isin", tuple(_literal(v) for v in values))

    def isna(self) -> Predicate:
        return _Test(self.name, "isna")

    def notna(self) -> Predicate:
        return _Test(self.name, "notna")


def score_slice(score: Column) -> Column:
    """A non-decreasing function of the score with some hundred values."""
    size = F.floor((F.log2(F.greatest(F.abs(score), F.lit(1e-300))) + 1100) * 32)
    return F.when(score == 0, F.lit(0)).when(score > 0, size).otherwise(-size).cast("long")
