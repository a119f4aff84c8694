"""Grouping keys: raw columns and fitted bins, global or per stratum."""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionError, NotFittedError
from ..functions.quantiles import grouped_quantiles
from .binning import BaseTransformer, EdgeBinner, FixedBinner, QuantileBinner

RESERVED = ("metric", "value")
BROADCAST_STRATA = 10_000


class BaseDimension:
    """``output_name`` and a column of keys; may learn from a reference."""

    output_name: str
    fit_by: tuple[str, ...] = ()

    def required_columns(self) -> tuple[str, ...]:
        raise NotImplementedError

    def fit_columns(self) -> tuple[str, ...]:
        return ()

    @property
    def is_fitted(self) -> bool:
        return True

    def fit(self, df: DataFrame) -> BaseDimension:
        return self

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the key in a new column ``name``."""
        return df.withColumn(name, self.transform(F.col))

    def transform(self, col) -> Column:
        raise NotImplementedError

    def domain(self) -> list[Any] | None:
        return None


class ColumnDimension(BaseDimension):
    """A raw column; ``categories`` declares an ordered domain, unused values included."""

    def __init__(self, column: str, name: str | None = None, categories: Sequence[Any] | None = None):
        if not isinstance(column, str) or not column:
            raise DimensionError("a column name is needed")
        self.column, self.output_name = column, name or column
        self.categories = list(categories) if categories is not None else None

    def required_columns(self) -> tuple[str, ...]:
        return (self.column,)

    def transform(self, col) -> Column:
        return col(self.column)

    def domain(self) -> list[Any] | None:
        return self.categories


class BinDimension(BaseDimension):
    """Bins of ``column`` with edges learned from ``fit_field``, per ``fit_by`` stratum if given."""

    def __init__(self, column: str, transformer: BaseTransformer, name: str | None = None, fit_field: str | None = None, fit_by: Sequence[str] | str | None = None):
        self.column, self.transformer = column, copy.deepcopy(transformer)
        self.output_name, self.fit_field = name or f"{column}_bin", fit_field or column
        self.fit_by = (fit_by,) if isinstance(fit_by, str) else tuple(fit_by or ())
        self.strata_: dict[tuple, BaseTransformer] | None = None
        if self.fit_by and not isinstance(transformer, EdgeBinner):
            raise DimensionError("fit_by needs a binner with edges")

    def required_columns(self) -> tuple[str, ...]:
        return (self.column, *self.fit_by)

    def fit_columns(self) -> tuple[str, ...]:
        return (self.fit_field, *self.fit_by)

    @property
    def is_fitted(self) -> bool:
        return self.strata_ is not None if self.fit_by else self.transformer.is_fitted

    def fit(self, df: DataFrame) -> BinDimension:
        if not self.fit_by:
            self.transformer.fit(df, self.fit_field)
            return self
        if isinstance(self.transformer, QuantileBinner):
            self.strata_ = {}
            for stratum, points in grouped_quantiles(df, self.fit_field, self.fit_by, self.transformer.probabilities()).items():
                self.strata_[stratum] = copy.deepcopy(self.transformer)
                self.strata_[stratum].finish(points)
            return self
        aggs = self.transformer.fit_columns()  # type: ignore[attr-defined]
        rows = df.groupBy(*self.fit_by).agg(*[make(F.col(self.fit_field)).alias("__points") for make in aggs]).collect() if aggs else df.select(*self.fit_by).distinct().collect()
        strata = {}
        for row in rows:
            own = copy.deepcopy(self.transformer)
            if not isinstance(own, FixedBinner):
                own.finish(row["__points"])  # type: ignore[attr-defined]
            strata[tuple(row[c] for c in self.fit_by)] = own
        self.strata_ = strata
        return self

    def transform(self, col) -> Column:
        if not self.is_fitted:
            raise NotFittedError(f"{self.output_name} is not fitted")
        return self.transformer.transform(col(self.column))

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        """Strata look their edges up by a null-safe join; unseen ones fail the job."""
        if not self.fit_by:
            return super().attach(df, name)
        if self.strata_ is None:
            raise NotFittedError(f"{self.output_name} is not fitted")
        first = next(iter(self.strata_.values()), None)
        if first is None:
            raise NotFittedError("the reference had no strata")
        keys = [f"{name}k{i}" for i in range(len(self.fit_by))]
        fields = {f.name: f.dataType for f in df.schema.fields}
        schema = ", ".join(f"{k} {fields[c].simpleString()}" for k, c in zip(keys, self.fit_by, strict=True)) + f", {name}e array<double>, {name}l array<string>"
        rows = [(*stratum, [float(e) for e in b.edges_], [str(x) for x in b.domain()]) for stratum, b in self.strata_.items()]
        edges = df.sparkSession.createDataFrame(rows, schema)
        if len(rows) <= BROADCAST_STRATA:
            edges = F.broadcast(edges)
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(self.fit_by, keys, strict=True)]
        joined = df.join(edges, same, "left")
        x, e = F.col(self.column).cast("double"), F.col(f"{name}e")
        n = F.size(e)
        inner = F.size(F.filter(F.slice(e, 2, F.greatest(n - 2, F.lit(0))), lambda edge: edge < x))
        outside = x.isNull() | F.isnan(x) | (x < F.element_at(e, 1)) | (x > F.element_at(e, -1))
        if not first.include_lowest:
            outside = outside | (x == F.element_at(e, 1))
        unseen = F.raise_error(F.concat(F.lit(f"{self.output_name}: stratum not seen in the reference: "), F.to_json(F.struct(*[F.col(c) for c in self.fit_by]))))
        label = F.when(e.isNull(), unseen.cast("string")).when(outside, F.lit(None)).otherwise(F.get(F.col(f"{name}l"), inner))
        return joined.withColumn(name, label).drop(*keys, f"{name}e", f"{name}l")

    def domain(self) -> list[Any] | None:
        if not self.fit_by:
            return self.transformer.domain() if self.is_fitted else None
        out: dict[Any, None] = {}
        for own in sorted((b.domain() for b in (self.strata_ or {}).values()), key=len, reverse=True):
            out.update(dict.fromkeys(own))
        return list(out)

    def interval(self, stratum: tuple, label: Any) -> str | None:
        own = self.strata_[stratum] if self.fit_by else self.transformer  # type: ignore[index]
        names = own.domain()
        return own.metadata()["intervals"][names.index(label)] if label in names else None


def natural_key(value: Any) -> tuple:
    """Ascending order over mixed values, missing last."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (2, "", 0)
    if isinstance(value, (bool, int, float)):
        return (0, "", value)
    return (1, str(value), 0)
