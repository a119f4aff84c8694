"""The cube: dimensions x measures as one lazy plan.

``fit`` learns edges; ``compute`` builds one shared aggregation for all additive
measures and totals, joins rank statistics by key, and returns a lazy canonical
frame ``dimensions..., metric, value``.
"""

from __future__ import annotations

import copy
import logging
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CubeError, DimensionError, EngineError, InvalidMetricError, LayoutError, MeasureError, NotFittedError
from ..functions.expr import Predicate, nan_to_null
from ..operators.dimensions import RESERVED, BaseDimension, BinDimension, ColumnDimension, natural_key
from ..operators.measures import AnalysisContext, BaseMeasure, Compiled, Count, Funnel
from ..operators.rank import histogram, rank_statistics

log = logging.getLogger(__name__)
MAX_GROUPING_SETS = 64
MAX_CELLS = 1_000_000


@dataclass(frozen=True)
class MissingPolicy:
    dimension: str = "drop"

    def __post_init__(self) -> None:
        if self.dimension not in ("drop", "keep"):
            raise ValueError("dimension policy is 'drop' or 'keep'")


@dataclass(frozen=True)
class ComputePolicy:
    """``on_invalid`` other than ``nan`` costs one extra action at compute."""

    missing: MissingPolicy = field(default_factory=MissingPolicy)
    on_invalid: str = "nan"

    def __post_init__(self) -> None:
        if self.on_invalid not in ("nan", "warn", "raise"):
            raise ValueError("on_invalid is 'nan', 'warn' or 'raise'")


@dataclass(frozen=True)
class CubePlan:
    """What will run: dimensions, measures in evaluation order, shared aggregates."""

    dimensions: tuple[BaseDimension, ...]
    measures: tuple[Compiled, ...]
    order: tuple[int, ...]
    aggregates: dict[str, Column]
    grouping_sets: tuple[tuple[int, ...], ...]
    required: tuple[str, ...]
    context: AnalysisContext


class Cube:
    def __init__(self, dimensions: Sequence[str | BaseDimension] = (), measures: Sequence[BaseMeasure | Funnel] | None = None, filters: Sequence[Any] = (), *, policy: ComputePolicy | None = None):
        if isinstance(dimensions, str):
            raise CubeError("dimensions is a sequence, such as ['dt']")
        self.dimensions = tuple(ColumnDimension(d) if isinstance(d, str) else copy.deepcopy(d) for d in dimensions)
        if not all(isinstance(d, BaseDimension) for d in self.dimensions):
            raise DimensionError("dimensions are column names or dimension objects")
        names = [d.output_name for d in self.dimensions]
        if len({n.lower() for n in names}) != len(names) or {n.lower() for n in names} & set(RESERVED):
            raise DimensionError(f"dimension names must be distinct and not {RESERVED}: {names}")
        raw = {d.column for d in self.dimensions if isinstance(d, ColumnDimension) and d.output_name == d.column}
        for d in self.dimensions:
            if set(d.fit_by) - raw:
                raise DimensionError(f"{d.output_name}: fit_by fields must also be dimensions under their own names")
        expanded: list[BaseMeasure] = []
        for m in [Count()] if measures is None else measures:
            expanded += m.measures() if isinstance(m, Funnel) else [copy.deepcopy(m)]
        if not expanded or not all(isinstance(m, BaseMeasure) for m in expanded):
            raise MeasureError("at least one measure is needed")
        if len({m.mode for m in expanded}) != 1:
            raise MeasureError("single-sample and comparative measures can't be mixed")
        self.measures, self.mode = tuple(expanded), expanded[0].mode
        if any(not callable(f) and not isinstance(f, Predicate) for f in filters):
            raise CubeError("filters are predicates or functions from a frame to a boolean column")
        self.filters, self.policy = tuple(filters), policy or ComputePolicy()
        self.dimensions_: tuple[BaseDimension, ...] | None = None

    # -- fitting -----------------------------------------------------------

    @property
    def is_fitted(self) -> bool:
        return self.dimensions_ is not None or all(d.is_fitted for d in self.dimensions)

    def _active(self) -> tuple[BaseDimension, ...]:
        active = self.dimensions_ or self.dimensions
        for d in active:
            if not d.is_fitted:
                raise NotFittedError(f"{d.output_name} is not fitted; call fit first")
        return active

    def _filtered(self, df: DataFrame) -> DataFrame:
        df = nan_to_null(df)
        for f in self.filters:
            mask = f.column() if isinstance(f, Predicate) else f(df)
            if not isinstance(mask, Column):
                raise CubeError("a filter must give a boolean column")
            df = df.filter(mask)
        return df

    def fit(self, reference: DataFrame) -> Cube:
        """Learn every dimension on the filtered reference; all or none."""
        self._check_columns(reference, {c for d in self.dimensions for c in d.fit_columns()})
        df = self._filtered(reference)
        learned = []
        for d in self.dimensions:
            own = copy.deepcopy(d)
            source = df.dropna(subset=list(d.fit_by)) if d.fit_by and self.policy.missing.dimension == "drop" else df
            learned.append(own.fit(source))
        self.dimensions_ = tuple(learned)
        self._hint()
        return self

    def _hint(self) -> None:
        bins = [d.output_name for d in self.dimensions if isinstance(d, BinDimension) and not d.fit_by and d.transformer.__class__.__name__ != "FixedBinner"]
        raw = [d.output_name for d in self.dimensions if isinstance(d, ColumnDimension)]
        if bins and raw:
            log.info("bins of %s are learned over all of %s; use fit_by for edges of each", bins, raw)

    @staticmethod
    def _check_columns(df: DataFrame, wanted: set[str]) -> None:
        if len({c.lower() for c in df.columns}) != len(df.columns):
            raise EngineError("column names must differ by more than case")
        lost = sorted(wanted - set(df.columns))
        if lost:
            raise EngineError(f"missing columns: {lost}")

    # -- planning ----------------------------------------------------------

    def plan(self, context: AnalysisContext | None = None, *, totals: bool = False) -> CubePlan:
        context = context or AnalysisContext()
        dims = self._active()
        made = [m.compile(context) for m in self.measures] if self.mode == "single" else []
        names = [c.name for c in made]
        if len(set(names)) != len(names):
            raise MeasureError(f"measure names must be distinct: {names}")
        order: list[int] = []
        done: set[str] = set()
        waiting = list(range(len(made)))
        for c in made:
            for n in c.needs:
                if n not in names:
                    raise MeasureError(f"{c.name} refers to {n}, which is not a measure")
        while waiting:
            ready = [i for i in waiting if set(made[i].needs) <= done]
            if not ready:
                raise MeasureError(f"measures refer to each other in a circle: {[names[i] for i in waiting]}")
            order += ready
            done |= {names[i] for i in ready}
            waiting = [i for i in waiting if i not in ready]
        aggregates: dict[str, Column] = {"count": F.count(F.lit(1))}
        for c in made:
            aggregates |= c.aggregates
        full = tuple(range(len(dims)))
        sets = [full]
        if totals:
            if 2 ** len(dims) > MAX_GROUPING_SETS:
                raise EngineError(f"totals over {len(dims)} dimensions need more than {MAX_GROUPING_SETS} grouping sets")
            named = {d.output_name: i for i, d in enumerate(dims)}
            for size in range(len(dims) - 1, -1, -1):
                for keep in combinations(full, size):
                    if all({named[f] for f in dims[i].fit_by} <= set(keep) for i in keep):
                        sets.append(keep)
        required = {c for d in dims for c in d.required_columns()} | {c for m in self.measures for c in m.required_columns(context)} | {c for f in self.filters if isinstance(f, Predicate) for c in f.required_columns()}
        return CubePlan(dims, tuple(made), tuple(order), aggregates, tuple(sets), tuple(sorted(required)), context)

    def _prepare(self, df: DataFrame, plan: CubePlan) -> DataFrame:
        self._check_columns(df, set(plan.required))
        df = self._filtered(df)
        keys = [f"__d{i}" for i in range(len(plan.dimensions))]
        for key, d in zip(keys, plan.dimensions, strict=True):
            df = d.attach(df, key)
        return df.dropna(subset=keys) if keys and self.policy.missing.dimension == "drop" else df

    # -- computing ---------------------------------------------------------

    def compute(self, df: DataFrame, context: AnalysisContext | None = None, *, totals: bool = False) -> CubeResult:
        if self.mode != "single":
            raise CubeError("comparative measures need compute_comparison")
        plan = self.plan(context, totals=totals)
        rows = self._prepare(df, plan)
        keys = [f"__d{i}" for i in range(len(plan.dimensions))]
        wide = _aggregate(rows, keys, plan)
        for number, shared in enumerate(dict.fromkeys((c.rank[0], c.rank[1], c.rank[2]) for c in plan.measures if c.rank)):
            wide = _join_rank(wide, rows, keys, plan, shared, number)
        position = {c.name: i for i, c in enumerate(plan.measures)}
        at = {key: f"__a{i}" for i, key in enumerate(plan.aggregates)}
        ranks = list(dict.fromkeys((c.rank[0], c.rank[1], c.rank[2]) for c in plan.measures if c.rank))

        def aggregate(key: str) -> Column:
            return F.col("__population") if key == "population" else F.col(at[key])

        def measure(name: str) -> Column:
            return F.col(f"__m{position[name]}")

        for i in plan.order:
            c = plan.measures[i]
            made = F.col(f"__r{ranks.index(c.rank[:3])}_{c.rank[3]}") if c.rank else c.finish(measure if c.needs else aggregate)
            wide = wide.withColumn(f"__m{i}", made)
        result = CubeResult(plan, wide, df.sparkSession, self.policy)
        if self.policy.on_invalid != "nan":
            bad = wide.agg(*[F.count_if(F.col(f"__m{i}").isNull()).alias(f"n{i}") for i in range(len(plan.measures))]).first()
            lost = {c.name: n for c, n in zip(plan.measures, bad, strict=True) if n}
            if lost and self.policy.on_invalid == "raise":
                raise InvalidMetricError(f"cells without a valid value: {lost}")
            if lost:
                warnings.warn(f"cells without a valid value: {lost}", RuntimeWarning, stacklevel=2)
        return result

    def fit_compute(self, df: DataFrame, context: AnalysisContext | None = None, *, totals: bool = False) -> CubeResult:
        return self.fit(df).compute(df, context, totals=totals)

    def compute_comparison(self, reference: DataFrame, current: DataFrame, context: AnalysisContext | None = None) -> CubeResult:
        from .comparison import compare

        if self.mode != "comparative":
            raise CubeError("single-sample measures need compute")
        if context is not None and context.weight is not None:
            raise MeasureError("comparative measures are not weighted")
        plan = self.plan(context)
        wide = compare(self, plan, reference, current)
        result = CubeResult(plan, wide, reference.sparkSession, self.policy, tuple(m.name for m in self.measures))
        if self.policy.on_invalid != "nan":
            lost = wide.filter(reduce(lambda a, b: a | b, [F.col(f"__m{i}").isNull() for i in range(len(self.measures))])).count()
            if lost and self.policy.on_invalid == "raise":
                raise InvalidMetricError(f"{lost} cells without a valid value")
            if lost:
                warnings.warn(f"{lost} cells without a valid value", RuntimeWarning, stacklevel=2)
        return result

    def explain(self, context: AnalysisContext | None = None, *, totals: bool = False, format: str = "table") -> list[tuple[str, str, str]] | str:
        """Rows of section, item and description, or the same as lines of text."""
        if format not in ("table", "text"):
            raise ValueError("format is 'table' or 'text'")
        rows = self._explained(context, totals)
        if format == "table":
            return rows
        wide = [max(len(r[i]) for r in rows) for i in (0, 1)]
        return "\n".join(f"{a:<{wide[0]}}  {b:<{wide[1]}}  {c}".rstrip() for a, b, c in rows)

    def _explained(self, context: AnalysisContext | None, totals: bool) -> list[tuple[str, str, str]]:
        plan = self.plan(context, totals=totals)
        out = [("dimension", d.output_name, f"{type(d).__name__} over {', '.join(d.required_columns())}" + (f", edges for each {d.fit_by}" if d.fit_by else "")) for d in plan.dimensions]
        out += [("filter", str(i), type(f).__name__) for i, f in enumerate(self.filters)]
        out += [("measure", m.name, type(m).__name__) for m in self.measures]
        out += [("aggregate", key, "shared") for key in plan.aggregates]
        names = [d.output_name for d in plan.dimensions]
        out += [("grouping set", ", ".join(names[i] for i in s) or "()", "total" if len(s) < len(names) else "cells") for s in plan.grouping_sets]
        return [*out, ("policy", "missing dimension", self.policy.missing.dimension), ("policy", "on invalid", self.policy.on_invalid)]


def _gid(keep: Sequence[int], n: int) -> int:
    """Spark's grouping_id: a bit for each key that is totalled over."""
    return sum(1 << (n - 1 - i) for i in range(n) if i not in keep)


def _aggregate(rows: DataFrame, keys: list[str], plan: CubePlan) -> DataFrame:
    made = [c.alias(f"__a{i}") for i, c in enumerate(plan.aggregates.values())]
    if not keys:
        return rows.agg(*made).withColumns({"__gid": F.lit(0).cast("long"), "__population": F.col("__a0")})
    if len(plan.grouping_sets) == 1:
        wide = rows.groupBy(*keys).agg(*made).withColumn("__gid", F.lit(0).cast("long"))
    else:
        sets = [[keys[i] for i in s] for s in plan.grouping_sets if s]
        wide = rows.groupingSets(sets, *keys).agg(F.grouping_id().alias("__gid"), *made)
        if () in plan.grouping_sets:  # a row even for no input, which grouping sets don't give
            top = rows.agg(*made).select(*[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys], F.lit(_gid((), len(keys))).cast("long").alias("__gid"), *[f"__a{i}" for i in range(len(made))])
            wide = wide.unionByName(top)
    return wide.withColumn("__population", F.sum("__a0").over(Window.partitionBy("__gid"))) if any("population" in _reads(c) for c in plan.measures) else wide.withColumn("__population", F.lit(None).cast("long"))


def _reads(c: Compiled) -> set[str]:
    seen: set[str] = set()
    if c.finish is not None and not c.needs:
        c.finish(lambda key: (seen.add(key), F.lit(1.0))[1])
    return seen


def _join_rank(wide: DataFrame, rows: DataFrame, keys: list[str], plan: CubePlan, shared: tuple, number: int) -> DataFrame:
    """Rank statistics of all grouping sets from one histogram at the full grain."""
    hist = histogram(rows, keys, *shared)
    names = [f"__k{i}" for i in range(len(keys))]
    parts = []
    for keep in plan.grouping_sets:
        own = [names[i] if i in keep else None for i in range(len(keys))]
        base = hist.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "s", "pos", "neg", "odd")
        kept = [n for n in own if n]
        if len(kept) < len(keys):
            base = base.groupBy(*kept, "s").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "odd")])
        ranked = rank_statistics(base, kept)
        for i, n in enumerate(names):
            if n not in kept:
                ranked = ranked.withColumn(n, F.lit(None).cast(rows.schema[keys[i]].dataType))
        parts.append(ranked.select(*names, F.lit(_gid(keep, len(keys))).cast("long").alias("__kg"), F.col("auc").alias(f"__r{number}_auc"), F.col("ks").alias(f"__r{number}_ks")))
    ranked = reduce(DataFrame.unionByName, parts)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("__gid") == F.col("__kg")]
    return wide.join(ranked, same, "left").drop(*names, "__kg")


class CubeResult:
    """A lazy canonical frame with its totals, axes, diagnostics and layouts."""

    def __init__(self, plan: CubePlan, wide: DataFrame, spark, policy: ComputePolicy, names: tuple[str, ...] | None = None, gid: int = 0):
        self.plan, self.wide, self.spark, self.policy, self.gid = plan, wide, spark, policy, gid
        self.names = names or tuple(c.name for c in plan.measures)
        self.dims = [d.output_name for d in plan.dimensions]

    def _grain(self) -> list[int]:
        n = len(self.dims)
        return [i for i in range(n) if not self.gid >> (n - 1 - i) & 1]

    def _long(self, wide: DataFrame, dims: list[int], extra: Sequence[str] = ()) -> DataFrame:
        cols = [F.col(f"__d{i}").alias(self.dims[i]) for i in dims]
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"__m{i}").cast("double").alias("value")) for i, n in enumerate(self.names)]))
        return wide.select(*extra, *cols, cells.alias("__cell")).select(*extra, *[self.dims[i] for i in dims], "__cell.metric", "__cell.value")

    @property
    def data_(self) -> DataFrame:
        """``dimensions..., metric, value``, NULL where there is no valid value."""
        return self._long(self.wide.filter(F.col("__gid") == self.gid), self._grain())

    def with_totals(self) -> DataFrame:
        """Cells and totals in one frame; ``grouping_id`` tells a total's NULL from a key's."""
        return self._long(self.wide.withColumnRenamed("__gid", "grouping_id"), list(range(len(self.dims))), ["grouping_id"])

    def pivoted(self) -> DataFrame:
        """One column for each measure."""
        dims = [F.col(f"__d{i}").alias(self.dims[i]) for i in self._grain()]
        return self.wide.filter(F.col("__gid") == self.gid).select(*dims, *[F.col(f"__m{i}").cast("double").alias(n) for i, n in enumerate(self.names)])

    def total(self, over: Sequence[str]) -> CubeResult:
        """The pooled result with the dimensions ``over`` totalled away."""
        unknown = [d for d in over if d not in self.dims]
        if unknown:
            raise CubeError(f"not dimensions: {unknown}")
        keep = tuple(i for i in self._grain() if self.dims[i] not in over)
        if keep not in self.plan.grouping_sets:
            raise CubeError("that total was not computed; use totals=True, and keep fit_by fields of bins")
        return CubeResult(self.plan, self.wide, self.spark, self.policy, self.names, _gid(keep, len(self.dims)))

    def axes(self, most: int = MAX_CELLS) -> dict[str, list[Any]]:
        """Ordered domains: declared or fitted labels, else values in natural order."""
        out: dict[str, list[Any]] = {}
        cells = self.wide.filter(F.col("__gid") == self.gid)
        for i in self._grain():
            seen = [r[0] for r in cells.select(f"__d{i}").distinct().limit(most + 1).collect()]
            if len(seen) > most:
                raise LayoutError(f"{self.dims[i]} has more than {most} values")
            known = self.plan.dimensions[i].domain()
            domain = list(known) if known is not None else []
            domain += sorted((v for v in seen if v is not None and v not in domain), key=natural_key)
            out[self.dims[i]] = domain + [None] * (None in seen)
        out["metric"] = list(self.names)
        return out

    @property
    def metadata_(self) -> dict[str, Any]:
        return {"dimensions": self.dims, "measures": list(self.names), "shared_aggregates": len(self.plan.aggregates), "total_grouping_sets": len(self.plan.grouping_sets), "result_rows": self.wide.filter(F.col("__gid") == self.gid).count()}

    def diagnostics(self) -> DataFrame:
        """A reason for every cell without a value."""
        at = {key: f"__a{i}" for i, key in enumerate(self.plan.aggregates)}
        position = {c.name: i for i, c in enumerate(self.plan.measures)}
        found = []
        for i, c in enumerate(self.plan.measures):
            reason, field_, hit, rest = F.lit("reason_not_recorded"), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("string")
            if "missing_propagated" in c.helpers:
                key = c.helpers["missing_propagated"]
                reason = F.when(F.col(at[key]) > 0, "missing_propagated").otherwise(reason)
                field_, hit = F.lit(key.split("|")[1]), F.col(at[key]).cast("long")
            if c.needs:
                top, bottom = (F.col(f"__m{position[n]}") for n in c.needs)
                lost = F.when(top.isNull(), F.lit(c.needs[0])).when(bottom.isNull(), F.lit(c.needs[1]))
                reason = F.when(lost.isNotNull(), "upstream_missing").when(bottom == 0, "zero_denominator").otherwise(reason)
                rest = F.coalesce(lost, F.when(bottom == 0, F.lit(c.needs[1])))
            found.append(F.when(F.col(f"__m{i}").isNull(), F.struct(F.lit(c.name).alias("metric"), reason.alias("reason"), field_.alias("field"), F.col("__a0").cast("long").alias("input_rows"), hit.alias("affected_rows"), rest.alias("dependency"))))
        dims = self._grain()
        rows = self.wide.filter(F.col("__gid") == self.gid).select(*[F.col(f"__d{i}").alias(self.dims[i]) for i in dims], F.explode(F.array_compact(F.array(*found))).alias("__x"))
        return rows.select(*[self.dims[i] for i in dims], "__x.*")

    def layout(self, rows: Sequence[str] | None = None, columns: Sequence[str] | None = None, *, max_cells: int = MAX_CELLS, totals: bool = False, total_label: str = "Total", bin_labels: str = "code") -> DataFrame:
        """A dense table: every cell of the domains, empty ones with the measure's empty value.

        Column headings are domain values joined by ``|``; ``__order`` keeps the
        row order.  Totals add a ``total_label`` to each axis.  With
        ``bin_labels='interval'`` bins show as intervals; stratified ones differ
        by stratum, so their intervals are united and only valid cells filled.
        """
        axes = self.axes(max_cells)
        names = [self.dims[i] for i in self._grain()]
        if rows is None and columns is None:
            rows, columns = names, ["metric"]
        rows = list(rows) if rows is not None else [a for a in axes if a not in (columns or [])]
        columns = list(columns) if columns is not None else [a for a in axes if a not in rows]
        if sorted([*rows, *columns]) != sorted(axes):
            raise LayoutError(f"every axis must be placed once: {list(axes)}")
        if bin_labels not in ("code", "interval"):
            raise LayoutError("bin_labels is 'code' or 'interval'")
        if totals and any(total_label in axes[n] for n in names):
            raise LayoutError(f"{total_label!r} is a value of an axis")
        grain = self._grain()
        shown = {n: [*axes[n], *([total_label] if totals else [])] for n in names} | {"metric": axes["metric"]}
        if math.prod(len(v) for v in shown.values()) > max_cells:
            raise LayoutError(f"more than {max_cells} cells")
        wanted = [self.gid] if not totals else [_gid(s, len(self.dims)) for s in self.plan.grouping_sets if set(s) <= set(grain)]
        cells: dict[tuple, float | None] = {}
        n = len(self.dims)
        for r in self.wide.filter(F.col("__gid").isin(wanted)).select("__gid", *[f"__d{i}" for i in grain], *[f"__m{i}" for i in range(len(self.names))]).collect():
            key = tuple(total_label if r["__gid"] >> (n - 1 - i) & 1 else r[f"__d{i}"] for i in grain)
            for i, name in enumerate(self.names):
                cells[(*key, name)] = r[f"__m{i}"]
        empty = dict(zip(self.names, [c.empty_value for c in self.plan.measures] or [None] * len(self.names), strict=True))
        cells, shown, valid = self._intervals(cells, shown, names) if bin_labels == "interval" else (cells, shown, None)
        order = [*names, "metric"]

        def product(axis_names: Sequence[str]) -> list[tuple]:
            out: list[tuple] = [()]
            for a in axis_names:
                out = [(*t, v) for t in out for v in shown[a]]
            return out

        heads = product(columns)
        table = []
        for at, row in enumerate(product(rows)):
            values = []
            for head in heads:
                place = dict(zip([*rows, *columns], [*row, *head], strict=True))
                key = tuple(place[a] for a in order)
                blank = empty[place["metric"]] if valid is None or key[:-1] in valid else None
                values.append(cells[key] if key in cells else blank)
            table.append((at, *[None if v is None else str(v) for v in row], *[None if v is None else float(v) for v in values]))
        titles = ["|".join("" if v is None else str(v) for v in h) or "value" for h in heads]
        schema = ", ".join(["__order int", *[f"`{r}` string" for r in rows], *[f"`{t}` double" for t in titles]])
        return self.spark.createDataFrame(table, schema)

    def _intervals(self, cells, shown, names):
        """Codes become interval texts; cells whose interval a stratum lacks stay out."""
        grain = self._grain()
        bins = {names.index(self.dims[i]): self.plan.dimensions[i] for i in grain if isinstance(self.plan.dimensions[i], BinDimension)}

        def rename(key: tuple) -> tuple:
            out = list(key)
            for at, d in bins.items():
                stratum = tuple(key[names.index(f)] for f in d.fit_by)
                if key[at] is not None and (not d.fit_by or stratum in (d.strata_ or {})):
                    out[at] = d.interval(stratum, key[at]) or key[at]
            return tuple(out)

        renamed = {rename(k): v for k, v in cells.items()}
        stratified = any(d.fit_by for d in bins.values())
        for at, d in bins.items():
            own = {d.interval(s, v): None for s in (d.strata_ or {()}) for v in (d.strata_[s] if d.fit_by else d.transformer).domain()} if d.fit_by else {d.interval((), v): None for v in d.domain()}
            rest = [v for v in shown[names[at]] if v is None or v not in (d.domain() or [])]
            shown[names[at]] = [*own, *rest]
        return renamed, shown, ({k[:-1] for k in renamed} if stratified else None)

