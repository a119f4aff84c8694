"""Row-preserving column steps: fitted by one aggregate, applied as projections."""

from __future__ import annotations

import json
import math
import os
import re
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArtifactError, DataPrepError, NotFittedError
from ..functions.expr import finite, nan_to_null, score_slice
from ..functions.quantiles import exact_quantiles
from .quality import missing, to_double

#: Strftime directives and the datetime pattern letters they mean.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%z": "xx"}


def _names(columns: Sequence[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


class BasePrepStep:
    """``project`` gives new columns; state, if any, is plain values in ``state``."""

    fitted_step = False

    def __init__(self) -> None:
        self.state: dict[str, Any] | None = None

    @property
    def name(self) -> str:
        return type(self).__name__

    def inputs(self) -> list[str]:
        raise NotImplementedError

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {}

    def learn(self, df: DataFrame, got: dict[str, Any]) -> dict[str, Any]:
        return got

    def project(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def audit(self, df: DataFrame) -> dict[str, Column]:
        """Counts for the audit, as aggregates over the input."""
        return {}

    def fit(self, df: DataFrame) -> BasePrepStep:
        self._check(df)
        made = self.aggregates(df)
        row = df.agg(*[c.alias(f"p{i}") for i, c in enumerate(made.values())]).first() if made else ()
        self.state = self.learn(df, dict(zip(made, row, strict=True)))
        return self

    def _check(self, df: DataFrame) -> None:
        lost = [c for c in self.inputs() if c not in df.columns]
        if lost:
            raise DataPrepError(f"{self.name}: missing columns {lost}")

    def transform(self, df: DataFrame) -> DataFrame:
        if self.fitted_step and self.state is None:
            raise NotFittedError(f"{self.name} is not fitted")
        self._check(df)
        return df.withColumns(self.project(df))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def params(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if k != "state"}

    def _numeric(self, df: DataFrame, names: Sequence[str]) -> None:
        for c in names:
            if not isinstance(df.schema[c].dataType, T.NumericType):
                raise DataPrepError(f"{self.name}: {c} is not numeric")


class ToNumeric(BasePrepStep):
    """Texts to doubles; with ``errors='raise'`` a text that isn't one fails the job."""

    def __init__(self, columns, errors: str = "raise"):
        super().__init__()
        if errors not in ("raise", "coerce"):
            raise DataPrepError("errors is 'raise' or 'coerce'")
        self.columns, self.errors = _names(columns), errors

    def inputs(self):
        return self.columns

    def project(self, df):
        out = {}
        for c in self.columns:
            if isinstance(df.schema[c].dataType, T.NumericType):
                out[c] = F.col(c)
                continue
            value = to_double(F.col(c).cast("string"))
            if self.errors == "raise":
                words = F.lower(F.btrim(F.col(c).cast("string"))).isin("nan")
                bad = F.col(c).isNotNull() & value.isNull() & ~words
                value = F.when(bad, F.raise_error(F.concat(F.lit(f"{c} is not numeric: "), F.col(c).cast("string"))).cast("double")).otherwise(value)
            out[c] = value
        return out

    def audit(self, df):
        return {f"{c}.failed": F.count_if(F.col(c).isNotNull() & to_double(F.col(c).cast("string")).isNull()) for c in self.columns}


class ToDatetime(BasePrepStep):
    def __init__(self, columns, errors: str = "raise", format: str | None = None, utc: bool = False):
        super().__init__()
        if errors not in ("raise", "coerce"):
            raise DataPrepError("errors is 'raise' or 'coerce'")
        self.columns, self.errors, self.format, self.utc = _names(columns), errors, format, utc

    def inputs(self):
        return self.columns

    def pattern(self) -> str | None:
        """The strftime format as a datetime pattern, literal letters quoted."""
        if self.format is None:
            return None
        out = []
        for directive, letters, rest in re.findall(r"(%.?)|([A-Za-z]+)|([^%A-Za-z]+)", self.format):
            if directive and directive not in DIRECTIVES:
                raise DataPrepError(f"unknown directive {directive}")
            out.append(DIRECTIVES[directive] if directive else f"'{letters}'" if letters else rest)
        return "".join(out)

    def project(self, df):
        pattern, out = self.pattern(), {}
        for c in self.columns:
            args = (F.col(c).cast("string"), F.lit(pattern)) if pattern else (F.col(c).cast("string"),)
            value = F.try_to_timestamp(*args)
            if self.errors == "raise":
                bad = F.col(c).isNotNull() & value.isNull()
                value = F.when(bad, F.raise_error(F.concat(F.lit(f"{c} is not a datetime: "), F.col(c).cast("string"))).cast("timestamp")).otherwise(value)
            out[c] = F.to_utc_timestamp(value, F.current_timezone()) if self.utc else value
        return out


class ValueMapper(BasePrepStep):
    """Values by a mapping; NULL stays NULL, unknown values as told."""

    def __init__(self, column: str, mapping: dict[Any, Any], handle_unknown: str = "error", unknown_value: Any = None):
        super().__init__()
        if handle_unknown not in ("error", "keep", "value"):
            raise DataPrepError("handle_unknown is 'error', 'keep' or 'value'")
        self.column, self.mapping, self.handle_unknown, self.unknown_value = column, dict(mapping), handle_unknown, unknown_value

    def inputs(self):
        return [self.column]

    def project(self, df):
        c = F.col(self.column)
        target = type(next(iter(self.mapping.values()), ""))
        kind = {str: "string", int: "long", float: "double", bool: "boolean"}.get(target, "string")
        pairs = F.create_map(*[F.lit(x) for k, v in self.mapping.items() for x in (k, v)])
        known = c.isin(*self.mapping)
        if self.handle_unknown == "error":
            rest = F.raise_error(F.concat(F.lit(f"{self.column} has no mapping for "), c.cast("string"))).cast(kind)
        elif self.handle_unknown == "keep":
            rest = c.cast(kind) if kind != dict(df.dtypes)[self.column] else c
        else:
            rest = F.lit(self.unknown_value).cast(kind)
        return {self.column: F.when(c.isNull(), F.lit(None)).when(known, F.element_at(pairs, c)).otherwise(rest)}

    def audit(self, df):
        return {f"{self.column}.unknown": F.count_if(F.col(self.column).isNotNull() & ~F.col(self.column).isin(*self.mapping))}


class Clip(BasePrepStep):
    """Values into bounds; NULL stays, whole numbers stay whole under whole bounds."""

    def __init__(self, columns, lower: float | None = None, upper: float | None = None):
        super().__init__()
        if lower is not None and upper is not None and lower > upper:
            raise DataPrepError("lower exceeds upper")
        self.columns, self.lower, self.upper = _names(columns), lower, upper

    def inputs(self):
        return self.columns

    def project(self, df):
        self._numeric(df, self.columns)
        out = {}
        whole = all(b is None or float(b).is_integer() for b in (self.lower, self.upper))
        for c in self.columns:
            integral = isinstance(df.schema[c].dataType, T.IntegralType)
            x = F.col(c) if integral and whole or not integral else F.col(c).cast("double")
            kind = (lambda b: F.lit(int(b))) if integral and whole else (lambda b: F.lit(float(b)))
            y = F.when(x.isNull(), x)
            if self.lower is not None:
                y = y.when(x < kind(self.lower), kind(self.lower))
            if self.upper is not None:
                y = y.when(x > kind(self.upper), kind(self.upper))
            out[c] = y.otherwise(x)
        return out

    def audit(self, df):
        out = {}
        for c in self.columns:
            low = F.col(c) < self.lower if self.lower is not None else F.lit(False)
            high = F.col(c) > self.upper if self.upper is not None else F.lit(False)
            out |= {f"{c}.clipped": F.count_if(low | high)}
        return out


class LogTransform(BasePrepStep):
    """Natural logarithm; a value of 0 or less fails the job."""

    def __init__(self, column: str, output_column: str | None = None):
        super().__init__()
        self.column, self.output_column = column, output_column or column

    def inputs(self):
        return [self.column]

    def project(self, df):
        self._numeric(df, [self.column])
        x = F.col(self.column).cast("double")
        return {self.output_column: F.when(x <= 0, F.raise_error(F.lit(f"{self.column} must be positive")).cast("double")).otherwise(F.ln(x))}


class LogitTransform(BasePrepStep):
    def __init__(self, column: str, output_column: str | None = None, eps: float = 1e-6):
        super().__init__()
        if not 0 < eps < 0.5:
            raise DataPrepError("eps lies between 0 and 0.5")
        self.column, self.output_column, self.eps = column, output_column or column, eps

    def inputs(self):
        return [self.column]

    def project(self, df):
        self._numeric(df, [self.column])
        x = F.col(self.column).cast("double")
        x = F.when(x < self.eps, self.eps).when(x > 1 - self.eps, 1 - self.eps).otherwise(x)
        return {self.output_column: F.ln(x) - F.log1p(-x)}


class _Fitted(BasePrepStep):
    fitted_step = True

    def __init__(self, columns, output: str = "replace", output_columns: Sequence[str] | None = None, suffix: str = ""):
        super().__init__()
        if output not in ("replace", "append"):
            raise DataPrepError("output is 'replace' or 'append'")
        self.columns, self.output, self.output_columns, self.suffix = _names(columns), output, list(output_columns) if output_columns else None, suffix
        if self.output_columns and len(self.output_columns) != len(self.columns):
            raise DataPrepError("an output name for each column is needed")

    def inputs(self):
        return self.columns

    def target(self, c: str) -> str:
        if self.output_columns:
            return self.output_columns[self.columns.index(c)]
        return c if self.output == "replace" else f"{c}{self.suffix}"


class MissingImputer(_Fitted):
    """Mean, median, most frequent (smallest on ties) or a constant for missing values.

    ``strategy`` may also be a function from the column of known values to an
    aggregate, such as ``F.max``.  ``missing_values`` names one more value that
    counts as missing.  Medians come from exact quantiles that don't gather a
    column in one task.
    """

    def __init__(self, columns, strategy: str | Callable[[Column], Column] = "median", fill_value: Any = None, add_indicator: bool = False, keep_empty_features: bool = True, output: str = "replace", output_columns=None, missing_values: Any = None):
        super().__init__(columns, output, output_columns, "_imputed")
        if not callable(strategy) and strategy not in ("mean", "median", "most_frequent", "constant"):
            raise DataPrepError(f"unknown strategy {strategy}")
        self.strategy, self.fill_value, self.add_indicator, self.keep_empty_features, self.missing_values = strategy, fill_value, add_indicator, keep_empty_features, missing_values

    def lost(self, df, c):
        absent = missing(df, c)
        return absent if self.missing_values is None else absent | F.col(c).eqNullSafe(F.lit(self.missing_values))

    def aggregates(self, df):
        out = {f"{c}|missing": F.count_if(self.lost(df, c)) for c in self.columns}
        for c in self.columns:
            known = F.when(~self.lost(df, c), F.col(c))
            if callable(self.strategy):
                out[c] = self.strategy(known)
            elif self.strategy == "mean":
                out[c] = F.avg(known.cast("double"))
            elif self.strategy == "most_frequent":
                out[c] = F.mode(known, True)
        return out

    def learn(self, df, got):
        if self.strategy == "median":
            known = df.select(*[F.when(~self.lost(df, c), F.col(c).cast("double")).alias(c) for c in self.columns])
            got = got | {c: (exact_quantiles(known, c, [0.5]) or [None])[0] for c in self.columns}
        fills = {c: self.fill_value if self.strategy == "constant" else got[c] for c in self.columns}
        for c, v in fills.items():
            if v is None and self.strategy != "constant" and self.keep_empty_features:
                fills[c] = 0 if isinstance(df.schema[c].dataType, T.NumericType) else ""
        return {"fills": fills, "had_missing": [c for c in self.columns if got[f"{c}|missing"]]}

    def project(self, df):
        out = {}
        for c in self.columns:
            fill = self.state["fills"][c]
            if fill is None:
                continue
            kind = df.schema[c].dataType
            base = F.col(c).cast("double") if isinstance(kind, T.IntegralType) and isinstance(fill, float) and not fill.is_integer() else F.col(c)
            known = F.when(~self.lost(df, c), base)
            out[self.target(c)] = F.coalesce(known, F.lit(fill))
        if self.add_indicator:
            out |= {f"{c}_missing": self.lost(df, c).cast("int") for c in self.state["had_missing"]}
        return out

    def audit(self, df):
        return {f"{c}.imputed": F.count_if(self.lost(df, c)) for c in self.columns}


class StandardScaler(_Fitted):
    """(x - mean) / population standard deviation; a constant column only moves."""

    def __init__(self, columns, output: str = "replace", output_columns=None):
        super().__init__(columns, output, output_columns, "_scaled")

    def aggregates(self, df):
        return {f"{c}|{n}": f(F.when(~missing(df, c), F.col(c).cast("double"))) for c in self.columns for n, f in (("center", F.avg), ("scale", F.stddev_pop))}

    def project(self, df):
        return {self.target(c): (F.col(c).cast("double") - F.lit(self.state[f"{c}|center"])) / F.lit(self.state[f"{c}|scale"] or 1.0) for c in self.columns}


class RobustScaler(StandardScaler):
    """(x - median) / interquartile range."""

    def aggregates(self, df):
        return {}

    def learn(self, df, got):
        out = {}
        for c in self.columns:
            lo, mid, hi = exact_quantiles(df, c, [0.25, 0.5, 0.75]) or (0.0, 0.0, 1.0)
            out |= {f"{c}|center": mid, f"{c}|scale": hi - lo}
        return out


class MinMaxScaler(StandardScaler):
    def aggregates(self, df):
        return {f"{c}|{n}": f(finite(F.col(c))) for c in self.columns for n, f in (("lo", F.min), ("hi", F.max))}

    def learn(self, df, got):
        return {f"{c}|{n}": v for c in self.columns for n, v in (("center", got[f"{c}|lo"] or 0.0), ("scale", (got[f"{c}|hi"] or 0.0) - (got[f"{c}|lo"] or 0.0)))}


MAX_CATEGORIES = 100_000


class _Categories(_Fitted):
    """Distinct values, ``MAX_CATEGORIES`` at most: each becomes a column or a code in the plan."""

    def learn(self, df, got):
        out = {}
        for c in self.columns:
            found = df.filter(F.col(c).isNotNull()).select(c).distinct().limit(MAX_CATEGORIES + 1).collect()
            if len(found) > MAX_CATEGORIES:
                raise DataPrepError(f"{c} has more than {MAX_CATEGORIES} categories")
            out[c] = sorted((r[0] for r in found), key=lambda v: (isinstance(v, str), v))
        return out


class OneHotEncoder(_Categories):
    """A 0/1 column for each known category; unknown values are 0 throughout."""

    def __init__(self, columns, output: str = "append"):
        super().__init__(columns, output)

    def project(self, df):
        return {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for c in self.columns for v in self.state[c]}

    def transform(self, df):
        out = super().transform(df)
        return out.drop(*self.columns) if self.output == "replace" else out


class OrdinalEncoder(_Categories):
    """Rank of the category in sorted order from 0; unknown -1, NULL stays."""

    def __init__(self, columns, output: str = "replace", output_columns=None):
        super().__init__(columns, output, output_columns, "_code")

    def project(self, df):
        out = {}
        for c in self.columns:
            pairs = F.create_map(*[F.lit(x) for i, v in enumerate(self.state[c]) for x in (v, i)]) if self.state[c] else F.create_map().cast("map<string,int>")
            out[self.target(c)] = F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.coalesce(F.try_element_at(pairs, F.col(c)), F.lit(-1)))
        return out


class KBins(_Fitted):
    """Left-closed bins with codes from 0; uniform, quantile or 1-d k-means edges.

    ``quantile_method`` is 'averaged_inverted_cdf' or 'linear'.  With
    ``subsample`` edges are learnt from about so many rows, drawn by
    ``random_state``; without it, the default, from all.
    """

    def __init__(self, columns, n_bins: int = 10, strategy: str = "quantile", encode: str = "ordinal", output: str = "replace", output_columns=None, quantile_method: str = "averaged_inverted_cdf", subsample: int | None = None, random_state: int = 0):
        super().__init__(columns, output, output_columns, "_bin")
        if strategy not in ("quantile", "uniform", "kmeans") or encode not in ("ordinal", "onehot", "onehot-dense") or n_bins < 2:
            raise DataPrepError("unknown strategy or encoding, or fewer than two bins")
        if quantile_method not in ("averaged_inverted_cdf", "linear"):
            raise DataPrepError(f"unknown quantile method {quantile_method}")
        self.n_bins, self.strategy, self.encode, self.quantile_method, self.subsample, self.random_state = n_bins, strategy, encode, quantile_method, subsample, random_state

    def fit(self, df):
        self._check(df)
        self.state = {}
        if self.subsample is not None and (n := df.count()) > self.subsample:
            df = df.sample(fraction=self.subsample / n, seed=self.random_state)
        for c in self.columns:
            x = df.select(finite(F.col(c)).alias("x")).filter("x is not null")
            if self.strategy == "quantile" and self.quantile_method == "linear":
                edges = exact_quantiles(x, "x", [i / self.n_bins for i in range(self.n_bins + 1)])
                if edges is None:
                    raise DataPrepError(f"{c} has no values")
            elif self.strategy == "quantile":
                edges = averaged_inverted_cdf(x, self.n_bins)
            else:
                lo, hi = x.agg(F.min("x"), F.max("x")).first()
                if lo is None:
                    raise DataPrepError(f"{c} has no values")
                edges = [lo + (hi - lo) * i / self.n_bins for i in range(self.n_bins + 1)]
                edges[-1] = hi
                if self.strategy == "kmeans":
                    edges = _kmeans_edges(x, edges, self.n_bins)
            kept = [edges[0]] + [e for a, e in zip(edges[:-1], edges[1:], strict=True) if e - a > 1e-8]
            self.state[c] = kept if len(kept) > 1 else [kept[0], kept[0]]
        return self

    def code(self, c: str) -> Column:
        x, out = F.col(c).cast("double"), F.when(F.col(c).isNull(), F.lit(None))
        inner = self.state[c][1:-1]
        for i, e in enumerate(inner):
            out = out.when(x < F.lit(e), F.lit(i))
        return out.otherwise(F.lit(len(inner))).cast("int")

    def project(self, df):
        if self.encode == "ordinal":
            return {self.target(c): self.code(c) for c in self.columns}
        return {f"{c}_{i}": F.coalesce((self.code(c) == i).cast("int"), F.lit(0)) for c in self.columns for i in range(len(self.state[c]) - 1)}

    def transform(self, df):
        out = super().transform(df)
        return out.drop(*self.columns) if self.encode != "ordinal" and self.output == "replace" else out


def averaged_inverted_cdf(values: DataFrame, n_bins: int) -> list[float]:
    """Quantiles that are data values, or the mean of two where a rank is whole.

    Distinct values are counted and only their running count is ordered, over
    monotone slices of the range, so no column is sorted in one task.
    """
    from pyspark.sql import Window

    counted = values.groupBy("x").count().withColumn("b", score_slice(F.col("x")))
    per = counted.groupBy("b").agg(F.sum("count").alias("n"))
    offsets = per.select(F.col("b").alias("ob"), (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("o"), F.sum("n").over(Window.partitionBy()).alias("all"))
    run = F.sum("count").over(Window.partitionBy("b").orderBy("x"))
    ranked = counted.join(offsets, F.col("b") == F.col("ob")).withColumn("hi", run + F.col("o")).withColumn("lo", F.col("hi") - F.col("count"))
    total = values.count()
    if not total:
        raise DataPrepError("no values to learn bins from")
    wanted = set()
    for i in range(n_bins + 1):
        place = total * i / n_bins
        j = math.ceil(place)
        wanted |= {max(1, j), min(total, j + 1)} if float(place).is_integer() else {max(1, j)}
    hits = ranked.select("x", F.explode(F.filter(F.array(*[F.lit(w) for w in sorted(wanted)]), lambda w: (w > F.col("lo")) & (w <= F.col("hi")))).alias("r")).collect()
    at = {r["r"]: r["x"] for r in hits}
    edges = []
    for i in range(n_bins + 1):
        place = total * i / n_bins
        j = math.ceil(place)
        edges.append((at[max(1, j)] + at[min(total, j + 1)]) / 2 if float(place).is_integer() and 0 < place < total else at[min(total, max(1, j))])
    return edges


def _kmeans_edges(values: DataFrame, start: list[float], k: int, rounds: int = 100) -> list[float]:
    """Lloyd's steps on the column itself: a step is one aggregate of sums by centre."""
    lo, hi = start[0], start[-1]
    if lo == hi:
        return [lo, hi]
    values = values.groupBy("x").count().cache()
    centers = [(a + b) / 2 for a, b in zip(start[:-1], start[1:], strict=True)]
    for _ in range(rounds):
        nearest = F.lit(k - 1)
        for i in reversed(range(k - 1)):
            nearest = F.when(F.col("x") <= F.lit((centers[i] + centers[i + 1]) / 2), F.lit(i)).otherwise(nearest)
        found = {r["i"]: r["s"] / r["n"] for r in values.groupBy(nearest.alias("i")).agg(F.sum(F.col("x") * F.col("count")).alias("s"), F.sum("count").alias("n")).collect()}
        moved = sorted(found.get(i, c) for i, c in enumerate(centers))
        still = max(abs(a - b) for a, b in zip(moved, centers, strict=True)) <= 1e-9 * (hi - lo)
        centers = moved
        if still:
            break
    values.unpersist()
    return [lo, *[(a + b) / 2 for a, b in zip(centers[:-1], centers[1:], strict=True)], hi]


class WoeBinning(_Fitted):
    """Supervised bins: quantile prebins, merged greedily, valued by weight of evidence.

    Prebins are counted once in the cluster; small and non-monotone neighbours
    then merge on the driver.  ``metric`` is 'woe', 'event_rate', 'indices' or
    'bins'.  An optimising solver may find other bins.
    """

    def __init__(self, column: str, target: str, metric: str = "woe", max_n_prebins: int = 20, min_bin_size: float = 0.05, monotonic: bool = True, edges: Sequence[float] | None = None, output_column: str | None = None, metric_missing: float = 0.0):
        super().__init__(column, "replace" if output_column is None else "append", None if output_column is None else [output_column])
        if metric not in ("woe", "event_rate", "indices", "bins"):
            raise DataPrepError(f"unknown metric {metric}")
        self.column, self.target_column, self.metric, self.max_n_prebins, self.min_bin_size, self.monotonic = column, target, metric, max_n_prebins, min_bin_size, monotonic
        self.edges, self.metric_missing = list(edges) if edges is not None else None, metric_missing

    def inputs(self):
        return [self.column]

    def fit(self, df):
        from .binning import EdgeBinner, QuantileBinner

        if self.edges is None:
            pre: EdgeBinner = QuantileBinner(self.max_n_prebins).fit(df, self.column)
        else:
            pre = EdgeBinner()
            pre._learn([-math.inf, *self.edges, math.inf])
        rows = df.filter(F.col(self.target_column).isNotNull()).groupBy(pre.code(F.col(self.column)).alias("b")).agg(F.count_if(F.col(self.target_column) == 1).alias("event"), F.count_if(F.col(self.target_column) == 0).alias("other")).collect()
        counts = {r["b"]: (r["event"], r["other"]) for r in rows}
        bins = [[pre.edges_[i + 1], *counts.get(i, (0, 0))] for i in range(pre.n_bins_)]
        bins = merge_bins(bins, self.min_bin_size if self.edges is None else 0.0, self.monotonic and self.edges is None)
        events, others = sum(b[1] for b in bins), sum(b[2] for b in bins)
        table = [{"upper": u, "event": e, "non_event": o, "event_rate": e / (e + o) if e + o else 0.0, "woe": math.log((max(o, 0.5) / max(others, 1)) / (max(e, 0.5) / max(events, 1)))} for u, e, o in bins]
        self.state = {"table": table, "missing": counts.get(None, (0, 0))}
        return self

    @property
    def iv(self) -> float:
        rows = self.state["table"]
        events, others = sum(r["event"] for r in rows) or 1, sum(r["non_event"] for r in rows) or 1
        return sum((r["non_event"] / others - r["event"] / events) * r["woe"] for r in rows)

    def project(self, df):
        rows, x = self.state["table"], F.col(self.column).cast("double")
        values = {"woe": [r["woe"] for r in rows], "event_rate": [r["event_rate"] for r in rows], "indices": list(range(len(rows))), "bins": [f"B{i + 1}" for i in range(len(rows))]}[self.metric]
        lost = F.lit("Missing") if self.metric == "bins" else F.lit(-1) if self.metric == "indices" else F.lit(float(self.metric_missing))
        out = F.when(x.isNull() | F.isnan(x), lost)
        for r, v in zip(rows[:-1], values[:-1], strict=True):
            out = out.when(x <= F.lit(r["upper"]), F.lit(v))
        return {self.target(self.column): out.otherwise(F.lit(values[-1]))}


def merge_bins(bins: list[list], min_share: float, monotonic: bool) -> list[list]:
    """Join neighbours until every bin is large enough, has both classes, and rates run one way."""
    bins = [list(b) for b in bins]
    total = sum(b[1] + b[2] for b in bins)

    def join(i: int) -> None:
        bins[i : i + 2] = [[bins[i + 1][0], bins[i][1] + bins[i + 1][1], bins[i][2] + bins[i + 1][2]]]

    def rate(b: list) -> float:
        return b[1] / (b[1] + b[2]) if b[1] + b[2] else 0.0

    while len(bins) > 1:
        small = [i for i, b in enumerate(bins) if b[1] + b[2] < max(1, min_share * total) or (min_share and 0 in b[1:])]
        if small:
            i = small[0]
            sides = [j for j in (i - 1, i) if 0 <= j < len(bins) - 1]
            join(min(sides, key=lambda j: abs(rate(bins[j]) - rate(bins[j + 1]))))
            continue
        rates = [rate(b) for b in bins]
        up = [i for i in range(len(bins) - 1) if rates[i + 1] < rates[i]]
        down = [i for i in range(len(bins) - 1) if rates[i + 1] > rates[i]]
        if not monotonic or not up or not down:
            break
        join(min(min(up, down, key=len), key=lambda j: abs(rates[j] - rates[j + 1])))
    return bins


class VocabularyEncoder(_Fitted):
    """Sorted distinct values to 1..n; missing and unseen are 0.

    Up to ``BROADCAST`` values are part of the step's state.  More need ``table``,
    a folder where the vocabulary is written as Parquet, numbered by partition
    and joined from there, so it never passes the driver.
    """

    BROADCAST = 100_000

    def __init__(self, column: str, output_column: str | None = None, table: str | None = None):
        super().__init__(column, "append" if output_column else "replace", [output_column] if output_column else None)
        self.column, self.table = column, table

    def fit(self, df):
        self._check(df)
        values = df.select(F.col(self.column).cast("string").alias("__v")).filter("__v is not null").distinct()
        if self.table is not None:
            self.state = {"table": self.table, "size": self._write(values)}
            return self
        found = values.limit(self.BROADCAST + 1).collect()
        if len(found) > self.BROADCAST:
            raise DataPrepError(f"{self.column} has more than {self.BROADCAST} values: name a table for the vocabulary")
        self.state = {"values": sorted((r[0] for r in found), key=lambda v: v.encode())}
        return self

    def _write(self, values: DataFrame) -> int:
        from pyspark.sql import Window

        spark, part = values.sparkSession, f"{self.table}-parts"
        placed = values.repartitionByRange("__v").sortWithinPartitions("__v").withColumn("__m", F.monotonically_increasing_id())
        placed.write.mode("overwrite").parquet(part)
        stored = spark.read.schema("__v string, __m long").parquet(part).withColumn("__p", F.shiftright("__m", 33))
        totals = stored.groupBy("__p").agg(F.count("*").alias("n"))  # a row for each partition
        offsets = totals.select(F.col("__p").alias("__q"), (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__o"))
        index = F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        stored.join(F.broadcast(offsets), F.col("__p") == F.col("__q")).select("__v", index.cast("int").alias("__i")).write.mode("overwrite").parquet(self.table)
        return spark.read.parquet(self.table).count()

    def transform(self, df):
        if self.state is None:
            raise NotFittedError("VocabularyEncoder is not fitted")
        if "table" in self.state:
            codes = df.sparkSession.read.schema("__v string, __i int").parquet(self.state["table"])
        else:
            codes = F.broadcast(df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(self.state["values"], 1)] or [("", 0)], "__v string, __i int"))
        return df.join(codes, F.col(self.column).cast("string") == F.col("__v"), "left").withColumn(self.target(self.column), F.coalesce("__i", F.lit(0))).drop("__v", "__i")


@dataclass(frozen=True)
class StepAudit:
    step: str
    before: dict[str, Any]
    after: dict[str, Any]
    details: dict[str, Any]


@dataclass(frozen=True)
class PrepResult:
    data: DataFrame
    audits: tuple[StepAudit, ...]

    def to_frame(self) -> DataFrame:
        rows = [(a.step, str(a.before), str(a.after), str(a.details)) for a in self.audits]
        return self.data.sparkSession.createDataFrame(rows, "step string, before string, after string, details string")


def snapshot(df: DataFrame) -> tuple[dict[str, Column], Any]:
    """Aggregates of a snapshot and how to read them."""
    made = {"rows": F.count(F.lit(1))}
    for c in df.columns:
        made |= {f"missing|{c}": F.count_if(missing(df, c)), f"nunique|{c}": F.count_distinct(F.col(c))}

    def read(got: dict[str, Any]) -> dict[str, Any]:
        return {"row_count": got["rows"], "dtypes": dict(df.dtypes), "missing": {c: got[f"missing|{c}"] for c in df.columns}, "nunique": {c: got[f"nunique|{c}"] for c in df.columns}}

    return made, read


def _measure(df: DataFrame, extra: dict[str, Column]) -> tuple[dict[str, Any], dict[str, Any]]:
    made, read = snapshot(df)
    wanted = made | {f"detail|{k}": c for k, c in extra.items()}
    got = dict(zip(wanted, df.agg(*[c.alias(f"s{i}") for i, c in enumerate(wanted.values())]).first(), strict=True))
    return read(got), {k: got[f"detail|{k}"] for k in extra}


class DataPrep:
    """Steps in order; each is fitted on what the ones before make of the data."""

    def __init__(self, steps: Sequence[BasePrepStep | tuple[str, BasePrepStep]]):
        self.steps = [s if isinstance(s, tuple) else (type(s).__name__.lower(), s) for s in steps]
        if not all(isinstance(s, BasePrepStep) for _, s in self.steps):
            raise DataPrepError("steps are BasePrepStep objects")
        self.schemas_: list[list[str]] | None = None

    def fit(self, df: DataFrame) -> DataPrep:
        return self.fit_transform(df) and self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        df, schemas = nan_to_null(df), [df.columns]
        for _, step in self.steps:
            if step.fitted_step:
                step.fit(df)
            df = step.transform(df)
            schemas.append(df.columns)
        self.schemas_ = schemas
        return df

    def _ready(self, df: DataFrame) -> DataFrame:
        if self.schemas_ is None:
            raise NotFittedError("the preparation is not fitted")
        if df.columns != self.schemas_[0]:
            raise DataPrepError(f"columns changed since fitting: {df.columns}")
        return nan_to_null(df)

    def transform(self, df: DataFrame) -> DataFrame:
        """Narrow projections only, so rows stay as they are."""
        df = self._ready(df)
        for _, step in self.steps:
            df = step.transform(df)
        return df

    def run(self, df: DataFrame) -> PrepResult:
        """Transform with a snapshot before and after every step."""
        df, audits = self._ready(df), []
        for name, step in self.steps:
            before, details = _measure(df, step.audit(df))
            df = step.transform(df)
            after, _ = _measure(df, {})
            audits.append(StepAudit(name, before, after, details))
        return PrepResult(df, tuple(audits))

    def save(self, path: str) -> None:
        save_artifact(path, {"schemas": self.schemas_, "steps": [{"name": n, "type": type(s).__name__, "params": {k: v for k, v in s.params().items()}, "state": s.state} for n, s in self.steps]})

    @classmethod
    def load(cls, path: str) -> DataPrep:
        found = load_artifact(path)
        kinds = {k.__name__: k for k in _all_steps(BasePrepStep)}
        steps = []
        for entry in found["steps"]:
            step = kinds[entry["type"]].__new__(kinds[entry["type"]])
            vars(step).update(entry["params"])
            step.state = entry["state"]
            steps.append((entry["name"], step))
        out = cls(steps)
        out.schemas_ = found["schemas"]
        return out


def _all_steps(kind: type) -> list[type]:
    return [kind, *[x for sub in kind.__subclasses__() for x in _all_steps(sub)]]


def save_artifact(path: str, body: dict[str, Any]) -> None:
    """JSON in a versioned envelope, replaced atomically."""
    import pyspark

    envelope = {"format": "tallyframe", "version": 1, "environment": {"pyspark": pyspark.__version__}, "body": body}
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w") as out:
        json.dump(envelope, out)
    os.replace(temporary, path)


def load_artifact(path: str) -> dict[str, Any]:
    with open(path) as file:
        try:
            envelope = json.load(file)
        except ValueError as error:
            raise ArtifactError(f"{path} is not an artifact") from error
    if not isinstance(envelope, dict) or envelope.get("format") != "tallyframe" or envelope.get("version") != 1:
        raise ArtifactError(f"{path} is not an artifact of version 1")
    return envelope["body"]
