"""Measures: what to compute in each cell.

A measure compiles to aggregate columns that all share one reduction, plus a
projection over them; rank statistics name the sub-plan that computes them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MeasureError
from ..functions.expr import Col, Predicate, divide, finite, guarded
from .binning import BaseTransformer, QuantileBinner


@dataclass(frozen=True)
class AnalysisContext:
    """Defaults for measures that name no target or weight of their own."""

    target: str | None = None
    weight: str | None = None


@dataclass
class Compiled:
    """``aggregates`` by stable key; ``finish`` reads them by that key."""

    name: str
    aggregates: dict[str, Column] = field(default_factory=dict)
    finish: Callable[[Callable[[str], Column]], Column] | None = None
    empty_value: float | None = None
    rank: tuple[str, str, str | None, str] | None = None  # score, target, weight, kind
    needs: tuple[str, ...] = ()  # other measures, by name
    invalid_when_null: bool = True
    helpers: dict[str, str] = field(default_factory=dict)  # reason -> aggregate key


def _selected(where: Predicate | None) -> tuple[Column, str]:
    if where is None:
        return F.lit(True), ""
    return F.coalesce(where.column(), F.lit(False)), f"|{where!r}"


class BaseMeasure:
    mode = "single"
    name: str

    def compile(self, context: AnalysisContext) -> Compiled:
        raise NotImplementedError

    def required_columns(self, context: AnalysisContext) -> tuple[str, ...]:
        return ()


class SingleSampleMeasure(BaseMeasure):
    pass


class ComparativeMeasure(BaseMeasure):
    mode = "comparative"


class Count(SingleSampleMeasure):
    """Rows, or rows where a condition holds; never weighted."""

    def __init__(self, name: str | None = None, *, where: Predicate | None = None):
        self.name, self.where = name or "count", where

    def required_columns(self, context):
        return self.where.required_columns() if self.where is not None else ()

    def compile(self, context):
        chosen, tag = _selected(self.where)
        key = f"count{tag}"
        made = F.count(F.lit(1)) if self.where is None else F.count_if(chosen)
        return Compiled(self.name, {key: made}, lambda a: a(key).cast("double"), 0.0)


class Share(SingleSampleMeasure):
    """A cell's rows over all analysed rows."""

    def __init__(self, denominator: str = "all", name: str | None = None):
        if denominator != "all":
            raise MeasureError("Share knows the denominator 'all'")
        self.name = name or "share"

    def compile(self, context):
        return Compiled(self.name, {"count": F.count(F.lit(1))}, lambda a: divide(a("count"), a("population")), 0.0)


class EventRate(SingleSampleMeasure):
    """Weighted share of rows whose target has the event value, among known targets."""

    def __init__(self, target: str | None = None, event_value: Any = 1, weight: str | None = None, name: str | None = None):
        self.target, self.event_value, self.weight = target, event_value, weight
        self._name = name

    @property
    def name(self) -> str:  # type: ignore[override]
        return self._name or f"event_rate__{self.target}__{self.event_value}"

    def _resolved(self, context):
        target = self.target or context.target
        if target is None:
            raise MeasureError("EventRate needs a target")
        return target, self.weight or context.weight

    def required_columns(self, context):
        return tuple(c for c in self._resolved(context) if c)

    def compile(self, context):
        target, weight = self._resolved(context)
        t = F.col(target)
        w = valid_weight(weight) if weight else F.lit(1.0)
        top, bottom = f"event|{target}|{self.event_value!r}|{weight}", f"valid|{target}|{weight}"
        name = self._name or f"event_rate__{target}__{self.event_value}"
        aggregates = {top: F.sum(F.when(t == F.lit(self.event_value), w).otherwise(0.0)), bottom: F.sum(F.when(t.isNotNull(), w).otherwise(0.0))}
        return Compiled(name, aggregates, lambda a: divide(a(top), a(bottom)), None)


def valid_weight(name: str) -> Column:
    """The weight as a double; a missing, negative or infinite one fails the job."""
    w = F.col(name).cast("double")
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == F.lit(math.inf))
    return guarded(w, bad, f"weight {name} must be finite and not negative")


class Sum(SingleSampleMeasure):
    """Sum of a column over selected rows.

    ``missing='propagate'`` leaves a cell without value if any selected row is
    missing; ``'zero'`` counts missing as 0.  An infinite selected value fails
    the job; a sum past the largest double has no value.
    """

    def __init__(self, column: str, name: str | None = None, missing: str = "propagate", *, where: Predicate | None = None):
        if missing not in ("propagate", "zero"):
            raise MeasureError("missing is 'propagate' or 'zero'")
        self.column, self.name, self.missing, self.where = column, name or f"sum__{column}", missing, where

    def required_columns(self, context):
        return (self.column, *(self.where.required_columns() if self.where is not None else ()))

    def compile(self, context):
        chosen, tag = _selected(self.where)
        x = F.col(self.column).cast("double")
        x = guarded(x, chosen & (F.abs(x) == F.lit(math.inf)), f"infinite value in {self.column}")
        total, lost = f"sum|{self.column}{tag}", f"lost|{self.column}{tag}"
        aggregates = {total: F.coalesce(F.sum(F.when(chosen, F.coalesce(x, F.lit(0.0))).otherwise(0.0)), F.lit(0.0)), lost: F.count_if(chosen & F.col(self.column).isNull())}
        if self.missing == "zero":
            return Compiled(self.name, aggregates, lambda a: finite(a(total)), 0.0)
        return Compiled(self.name, aggregates, lambda a: F.when(a(lost) == 0, finite(a(total))), 0.0, helpers={"missing_propagated": lost})


class Ratio(SingleSampleMeasure):
    """One measure over another, by name; ratios of ratios are fine."""

    def __init__(self, numerator: str, denominator: str, name: str | None = None):
        self.numerator, self.denominator = numerator, denominator
        self.name = name or f"ratio__{numerator}__{denominator}"

    def compile(self, context):
        return Compiled(self.name, {}, lambda a: divide(a(self.numerator), a(self.denominator)), None, needs=(self.numerator, self.denominator))


class _Rank(SingleSampleMeasure):
    kind = ""

    def __init__(self, score: str, target: str | None = None, weight: str | None = None, name: str | None = None):
        self.score, self.target, self.weight = score, target, weight
        self.name = name or f"{self.kind}__{score}"

    def required_columns(self, context):
        return tuple(c for c in (self.score, self.target or context.target, self.weight or context.weight) if c)

    def compile(self, context):
        target = self.target or context.target
        if target is None:
            raise MeasureError(f"{self.name} needs a target")
        return Compiled(self.name, rank=(self.score, target, self.weight or context.weight, self.kind))


class AUC(_Rank):
    """Area under the ROC curve; ties count one half."""

    kind = "auc"


class KS(_Rank):
    """Largest gap between true and false positive rate over all thresholds."""

    kind = "ks"


class PSI(ComparativeMeasure):
    """Population stability of a field between a reference and a current sample.

    With a binner, its edges come from all reference rows once; without, values
    are categories.  ``missing='bucket'`` gives missing values a bin of their
    own if any occur; ``min_samples`` is what a cell needs on either side.
    """

    def __init__(self, field: str, binner: BaseTransformer | None | str = "default", epsilon: float = 1e-8, name: str | None = None, missing: str = "bucket", min_samples: int = 1):
        if missing not in ("bucket", "drop") or not epsilon > 0 or min_samples < 1:
            raise MeasureError("missing is 'bucket' or 'drop'; epsilon and min_samples are positive")
        self.field, self.epsilon, self.missing, self.min_samples = field, float(epsilon), missing, min_samples
        self.binner = QuantileBinner(10) if binner == "default" else binner
        self.name = name or f"psi__{field}"

    def required_columns(self, context):
        return (self.field,)


class ComparativeCalculation(ComparativeMeasure):
    """Own two-sample measures: ``evaluate`` gives one value for each group.

    It gets both prepared samples and the key columns, and returns a frame with
    those keys and a double column ``value``.
    """

    def evaluate(self, reference, current, keys: Sequence[str]):
        raise NotImplementedError


@dataclass(frozen=True)
class Stage:
    """A funnel step: a column to sum, or a condition to count."""

    name: str
    column: str | None = None
    where: Predicate | None = None


@dataclass(frozen=True)
class Transition:
    source: str
    target: str
    name: str | None = None


@dataclass(frozen=True)
class Funnel:
    """Expands to quantities of stages and rates between them.

    A stage may be the plain name of the column that it sums or counts.
    """

    stages: Sequence[Stage | str]
    aggregation: str = "sum"
    rates: str | Sequence[Transition] = "adjacent"
    quantity_name: str = "{stage}_count"
    rate_name: str = "{source}_to_{target}_rate"

    def stage(self, given: Stage | str) -> Stage:
        """A plain name counts where the column is known, or sums it."""
        if not isinstance(given, str):
            return given
        return Stage(given, where=Col(given).notna()) if self.aggregation == "count" else Stage(given)

    def measures(self) -> tuple[BaseMeasure, ...]:
        stages = [self.stage(s) for s in self.stages]
        names = [s.name for s in stages]
        if len(names) < 2 or len(set(names)) != len(names):
            raise MeasureError("a funnel has two stages or more, with distinct names")
        if self.aggregation not in ("sum", "count"):
            raise MeasureError("aggregation is 'sum' or 'count'")
        quantity = {n: self.quantity_name.format(stage=n) for n in names}
        out: list[BaseMeasure] = []
        for s in stages:
            if self.aggregation == "sum":
                out.append(Sum(s.column or s.name, quantity[s.name], where=s.where))
            else:
                out.append(Count(quantity[s.name], where=s.where))
        adjacent = list(zip(names[:-1], names[1:], strict=True))
        from_first = [(names[0], n) for n in names[1:]]
        if isinstance(self.rates, str):
            if self.rates not in ("adjacent", "from_first", "both"):
                raise MeasureError("rates are 'adjacent', 'from_first', 'both' or transitions")
            edges = {"adjacent": adjacent, "from_first": from_first, "both": list(dict.fromkeys([*adjacent, *from_first]))}[self.rates]
            wanted = [Transition(a, b) for a, b in edges]
        else:
            wanted = list(self.rates)
        seen = set()
        for t in wanted:
            if t.source not in names or t.target not in names or names.index(t.source) >= names.index(t.target):
                raise MeasureError(f"transition {t.source} -> {t.target} must go forward between stages")
            if (t.source, t.target) in seen:
                raise MeasureError(f"transition {t.source} -> {t.target} twice")
            seen.add((t.source, t.target))
            out.append(Ratio(quantity[t.target], quantity[t.source], t.name or self.rate_name.format(source=t.source, target=t.target)))
        if len({m.name for m in out}) != len(out):
            raise MeasureError("funnel output names must be distinct")
        return tuple(out)
