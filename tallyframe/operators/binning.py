"""Right-closed binning: edges learned by one aggregate, applied as a column."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFittedError, TransformError
from ..functions.expr import finite, is_missing
from ..functions.quantiles import exact_quantiles


def interval_labels(edges: Sequence[float], precision: int = 6, include_lowest: bool = True) -> list[str]:
    """Interval texts, with as many decimals as tell all edges apart."""
    inner = [e for e in edges if math.isfinite(e)]
    digits = precision
    while digits < 324 and len({round(e, digits) for e in inner}) < len(set(inner)):
        digits += 1

    def show(e: float) -> str:
        if math.isinf(e):
            return "-inf" if e < 0 else "inf"
        text = f"{e:.{digits}f}".rstrip("0").rstrip(".")
        return "0" if text in ("-0", "") else text

    out = [f"({show(a)}, {show(b)}]" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if include_lowest and math.isfinite(edges[0]):
        out[0] = "[" + out[0][1:]
    return out


class BaseTransformer:
    """Learns state from a reference column; maps a column to a label column."""

    supervised = False

    def fit(self, df: DataFrame, column: str, target: str | None = None) -> BaseTransformer:
        return self

    @property
    def is_fitted(self) -> bool:
        raise NotImplementedError

    def transform(self, column: Column) -> Column:
        raise NotImplementedError

    def domain(self) -> list[Any] | None:
        """Labels in order, or None where only data can tell."""
        return None


class EdgeBinner(BaseTransformer):
    """Bins between strictly increasing edges."""

    def __init__(self, labels: Sequence[Any] | None = None, include_lowest: bool = True, precision: int = 6):
        if labels is not None:
            labels = list(labels)
            if len(set(labels)) != len(labels) or any(is_missing(x) for x in labels):
                raise TransformError("labels must be distinct and not missing")
        self.labels, self.include_lowest, self.precision = labels, include_lowest, precision
        self.edges_: list[float] | None = None
        self.reference_range_: tuple[float, float] | None = None

    @property
    def is_fitted(self) -> bool:
        return self.edges_ is not None

    def _learn(self, edges: Sequence[float]) -> None:
        if self.labels is not None and len(self.labels) != len(edges) - 1:
            raise TransformError(f"{len(self.labels)} labels for {len(edges) - 1} bins")
        self.edges_ = list(edges)

    @property
    def n_bins_(self) -> int:
        return len(self._edges()) - 1

    def _edges(self) -> list[float]:
        if self.edges_ is None:
            raise NotFittedError("the binner is not fitted")
        return self.edges_

    def domain(self) -> list[Any]:
        return list(self.labels) if self.labels is not None else [f"B{i}" for i in range(1, self.n_bins_ + 1)]

    def code(self, column: Column) -> Column:
        """Zero-based bin, NULL for missing and out-of-range values."""
        x, edges = column.cast("double"), self._edges()
        out = F.when(x.isNull() | F.isnan(x), F.lit(None))
        out = out.when(x < edges[0], F.lit(None))
        if not self.include_lowest:
            out = out.when(x == edges[0], F.lit(None))
        for i, edge in enumerate(edges[1:]):
            out = out.when(x <= F.lit(float(edge)), F.lit(i))
        return out.cast("int")

    def transform(self, column: Column) -> Column:
        x, edges, names = column.cast("double"), self._edges(), self.domain()
        out = F.when(x.isNull() | F.isnan(x) | (x < edges[0]), F.lit(None))
        if not self.include_lowest:
            out = out.when(x == edges[0], F.lit(None))
        for edge, name in zip(edges[1:], names, strict=True):
            out = out.when(x <= F.lit(float(edge)), F.lit(name))
        return out

    def metadata(self) -> dict[str, Any]:
        edges = self._edges()
        return {"bin_edges": edges, "labels": self.domain(), "n_bins": self.n_bins_, "include_lowest": self.include_lowest, "intervals": interval_labels(edges, self.precision, self.include_lowest), "reference_range": self.reference_range_}


def outer_open(points: Sequence[float]) -> list[float]:
    """Distinct edges with the outer two thrown open; one bin for a constant."""
    distinct = sorted(set(points))
    if len(distinct) <= 2:
        return [-math.inf, math.inf] if len(distinct) == 1 else [-math.inf, *distinct[1:-1], math.inf]
    return [-math.inf, *distinct[1:-1], math.inf]


class QuantileBinner(EdgeBinner):
    def __init__(self, n_bins: int = 5, duplicates: str = "drop", labels: Sequence[Any] | None = None, include_lowest: bool = True, precision: int = 6):
        super().__init__(labels, include_lowest, precision)
        if n_bins < 1 or duplicates not in ("drop", "raise"):
            raise TransformError("n_bins must be positive and duplicates 'drop' or 'raise'")
        self.n_bins, self.duplicates = n_bins, duplicates

    def probabilities(self) -> list[float]:
        return [i / self.n_bins for i in range(self.n_bins + 1)]

    def finish(self, points: Sequence[float] | None) -> None:
        if points is None:
            raise TransformError("no finite values to learn quantiles from")
        if self.duplicates == "raise" and len(set(points)) != len(points):
            raise TransformError("quantile edges are not unique")
        self._learn(outer_open(points))
        self.reference_range_ = (points[0], points[-1])

    def fit(self, df: DataFrame, column: str, target: str | None = None) -> QuantileBinner:
        self.finish(exact_quantiles(df, column, self.probabilities()))
        return self

    def fit_columns(self) -> list:
        """The aggregate behind ``finish`` for fits within groups."""
        return [lambda c: F.percentile(finite(c), F.array(*[F.lit(p) for p in self.probabilities()]))]


class EqualWidthBinner(EdgeBinner):
    def __init__(self, n_bins: int = 5, labels: Sequence[Any] | None = None, include_lowest: bool = True, precision: int = 6):
        super().__init__(labels, include_lowest, precision)
        if n_bins < 1:
            raise TransformError("n_bins must be positive")
        self.n_bins = n_bins

    def finish(self, points: Sequence[float] | None) -> None:
        if points is None or points[0] is None:
            raise TransformError("no finite values to learn a range from")
        lo, hi = points
        steps = [lo + (hi - lo) * i / self.n_bins for i in range(1, self.n_bins)] if lo < hi else []
        self._learn([-math.inf, *steps, math.inf])
        self.reference_range_ = (lo, hi)

    def fit(self, df: DataFrame, column: str, target: str | None = None) -> EqualWidthBinner:
        x = finite(F.col(column))
        self.finish(tuple(df.agg(F.min(x), F.max(x)).first()))
        return self

    def fit_columns(self) -> list:
        return [lambda c: F.array(F.min(finite(c)), F.max(finite(c)))]


class FixedBinner(EdgeBinner):
    def __init__(self, edges: Sequence[float], labels: Sequence[Any] | None = None, include_lowest: bool = True, precision: int = 6):
        super().__init__(labels, include_lowest, precision)
        edges = [float(e) for e in edges]
        if len(edges) < 2 or any(math.isnan(e) for e in edges) or any(a >= b for a, b in zip(edges[:-1], edges[1:], strict=True)):
            raise TransformError("edges must increase strictly")
        self._learn(edges)

    def fit(self, df: DataFrame, column: str, target: str | None = None) -> FixedBinner:
        return self

    def fit_columns(self) -> list:
        return []
