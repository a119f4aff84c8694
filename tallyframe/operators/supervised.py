"""Supervised binning of several columns, and a step around any fitted transformer."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataPrepError, NotFittedError
from .binning import EdgeBinner, QuantileBinner
from .prep import BasePrepStep, _Fitted, _names, merge_bins
from .quality import missing

METRICS = ("woe", "event_rate", "indices", "bins")


def two_sample_p(a: Sequence[int], b: Sequence[int]) -> float:
    """Two-sided p-value that two bins' event rates are equal (pooled z test)."""
    n, m = sum(a), sum(b)
    if not n or not m:
        return 1.0
    pooled = (a[0] + b[0]) / (n + m)
    spread = pooled * (1 - pooled) * (1 / n + 1 / m)
    return 1.0 if spread == 0 else math.erfc(abs(a[0] / n - b[0] / m) / math.sqrt(2 * spread))


class OptBinning(_Fitted):
    """Supervised bins of many columns, each with a table of counts and values.

    A numeric column starts from quantile prebins (or ``user_splits``), a
    categorical one from its values in order of event rate, those under
    ``cat_cutoff`` of the rows together.  Each column is counted once in the
    cluster; on the driver neighbours merge until every bin has ``min_bin_size``
    of the rows, rates run one way (``monotonic``), neighbours differ at
    ``max_pvalue`` and at most ``max_n_bins`` are left.  A solver may find others.

    ``special_codes`` and missing values have bins of their own, valued by
    ``metric_special`` and ``metric_missing``: a number, or 'empirical'.
    """

    def __init__(self, columns, target: str, categorical_columns: Sequence[str] = (), metric: str = "woe", max_n_prebins: int = 20, min_bin_size: float = 0.05, max_n_bins: int | None = None, max_pvalue: float | None = None, monotonic: bool = True, special_codes: Sequence[float] = (), metric_special: float | str = 0.0, metric_missing: float | str = 0.0, cat_cutoff: float = 0.0, cat_unknown: float = 0.0, user_splits: dict[str, Sequence[float]] | None = None, max_categories: int = 1000, output: str = "replace", output_columns=None):
        super().__init__(columns, output, output_columns, f"_{metric}")
        if metric not in METRICS:
            raise DataPrepError(f"unknown metric {metric}")
        if set(categorical_columns) - set(self.columns):
            raise DataPrepError("categorical_columns are among columns")
        for value in (metric_special, metric_missing):
            if isinstance(value, str) and value != "empirical":
                raise DataPrepError("metric_special and metric_missing are numbers or 'empirical'")
        self.target_column, self.categorical_columns, self.metric = target, list(categorical_columns), metric
        self.max_n_prebins, self.min_bin_size, self.max_n_bins, self.max_pvalue, self.monotonic = max_n_prebins, min_bin_size, max_n_bins, max_pvalue, monotonic
        self.special_codes, self.metric_special, self.metric_missing = list(special_codes), metric_special, metric_missing
        self.cat_cutoff, self.cat_unknown, self.user_splits, self.max_categories = cat_cutoff, cat_unknown, dict(user_splits or {}), max_categories

    def inputs(self):
        return self.columns

    def special(self, c: str) -> Column:
        return F.col(c).isin(self.special_codes) if self.special_codes else F.lit(False)

    def counts(self, df: DataFrame, bin_: Column) -> dict[Any, tuple[int, int]]:
        y = F.col(self.target_column)
        rows = df.filter(y.isin(0, 1)).groupBy(bin_.alias("b")).agg(F.count_if(y == 1).alias("event"), F.count_if(y == 0).alias("other"))
        most = max(self.max_categories, self.max_n_prebins) + 2
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise DataPrepError(f"more than {self.max_categories} categories")
        return {r["b"]: (r["event"], r["other"]) for r in found}

    def fit(self, df):
        self._check(df)
        self.state = {}
        for c in self.columns:
            plain = df.filter(~missing(df, c) & ~self.special(c))
            apart = self.counts(df.filter(missing(df, c) | self.special(c)), F.when(missing(df, c), F.lit("missing")).otherwise(F.lit("special")))
            if c in self.categorical_columns:
                found = self.counts(plain, F.col(c).cast("string"))
                bins = self._categories(found)
            else:
                pre: EdgeBinner = EdgeBinner()
                if c in self.user_splits:
                    pre._learn([-math.inf, *self.user_splits[c], math.inf])
                else:
                    pre = QuantileBinner(self.max_n_prebins).fit(plain, c)
                found = self.counts(plain, pre.code(F.col(c)))
                bins = [[pre.edges_[i + 1], *found.get(i, (0, 0))] for i in range(pre.n_bins_)]
            if c not in self.user_splits:
                bins = self._merge(bins)
            self.state[c] = self._table(bins, apart)
        return self

    def _categories(self, found: dict[str, tuple[int, int]]) -> list[list]:
        total = sum(map(sum, found.values()))
        rare = [v for v, n in found.items() if sum(n) < self.cat_cutoff * total]
        groups = {(v,): n for v, n in found.items() if v not in rare}
        if rare:
            groups[tuple(sorted(rare))] = tuple(sum(found[v][i] for v in rare) for i in (0, 1))
        ordered = sorted(groups.items(), key=lambda g: (g[1][0] / max(1, sum(g[1])), g[0]))
        return [[values, *n] for values, n in ordered]

    def _merge(self, bins: list[list]) -> list[list]:
        def glue(a: Any, b: Any) -> Any:
            return (*a, *b) if isinstance(a, tuple) else b

        places = {i: b[0] for i, b in enumerate(bins)}
        merged = merge_bins([[i, *b[1:]] for i, b in enumerate(bins)], self.min_bin_size, self.monotonic)
        out, at = [], 0
        for last, event, other in merged:
            upper = places[at]
            for i in range(at + 1, last + 1):
                upper = glue(upper, places[i])
            out.append([upper, event, other])
            at = last + 1
        while len(out) > 1:
            p = [two_sample_p(a[1:], b[1:]) for a, b in zip(out[:-1], out[1:], strict=True)]
            i = max(range(len(p)), key=p.__getitem__)
            if not (self.max_pvalue is not None and p[i] > self.max_pvalue) and not (self.max_n_bins is not None and len(out) > self.max_n_bins):
                break
            out[i : i + 2] = [[glue(out[i][0], out[i + 1][0]), out[i][1] + out[i + 1][1], out[i][2] + out[i + 1][2]]]
        return out

    def _table(self, bins: list[list], apart: dict[str, tuple[int, int]]) -> list[dict[str, Any]]:
        every = [("bin", b[0], b[1], b[2]) for b in bins] + [(kind, None, *apart.get(kind, (0, 0))) for kind in ("special", "missing")]
        events, others = (max(1, sum(r[i] for r in every)) for i in (2, 3))
        out = []
        for number, (kind, key, e, o) in enumerate(every):
            woe = math.log((max(o, 0.5) / others) / (max(e, 0.5) / events)) if e + o else 0.0
            out.append({"kind": kind, "index": number, "upper": float(key) if kind == "bin" and not isinstance(key, tuple) else None, "values": list(key) if isinstance(key, tuple) else None, "count": e + o, "event": e, "non_event": o, "event_rate": e / (e + o) if e + o else 0.0, "woe": woe, "iv": (o / others - e / events) * woe if e + o else 0.0})
        return out

    def value(self, row: dict[str, Any]) -> Any:
        given = {"special": self.metric_special, "missing": self.metric_missing}.get(row["kind"], "empirical")
        if self.metric == "bins":
            return {"special": "Special", "missing": "Missing"}.get(row["kind"], f"B{row['index'] + 1}")
        if self.metric == "indices":
            return {"special": -2, "missing": -1}.get(row["kind"], row["index"])
        return row[self.metric] if given == "empirical" else float(given)

    def project(self, df):
        made = {}
        for c in self.columns:
            rows = self.state[c]
            bins, (special, lost) = rows[:-2], rows[-2:]
            out = F.when(missing(df, c), F.lit(self.value(lost))).when(self.special(c), F.lit(self.value(special)))
            for row in bins:
                hit = F.col(c).cast("string").isin(row["values"]) if row["values"] is not None else F.col(c).cast("double") <= F.lit(float(row["upper"]))
                out = out.when(hit, F.lit(self.value(row)))
            unknown = {"bins": "Unknown", "indices": -3}.get(self.metric, float(self.cat_unknown))
            made[self.target(c)] = out.otherwise(F.lit(unknown))
        return made

    def binning_table(self, spark, column: str | None = None) -> DataFrame:
        """A row for each bin of each column."""
        if self.state is None:
            raise NotFittedError("OptBinning is not fitted")
        rows = [(c, r["index"], r["kind"], r["upper"], r["values"], r["count"], r["event"], r["non_event"], r["event_rate"], r["woe"], r["iv"]) for c in self.columns if column in (None, c) for r in self.state[c]]
        return spark.createDataFrame(rows, "column string, index int, kind string, upper double, values array<string>, count long, event long, non_event long, event_rate double, woe double, iv double")

    def summary(self, spark) -> DataFrame:
        """A row for each column: its bins and information value."""
        rows = [(c, "categorical" if c in self.categorical_columns else "numerical", len(self.state[c]) - 2, sum(r["iv"] for r in self.state[c])) for c in self.columns]
        return spark.createDataFrame(rows, "column string, kind string, n_bins int, iv double")


class TransformerStep(BasePrepStep):
    """Any object that is fitted on a frame and then transforms one, such as a ``pyspark.ml`` stage.

    ``fit(df)`` may return the fitted model (an estimator) or the object itself.
    The columns it adds are the outputs: with 'append' they stand beside the
    inputs under ``output_columns``, with 'replace' the inputs go and, if there
    are as many outputs, their names and places are taken.
    """

    fitted_step = True

    def __init__(self, transformer: Any, columns, output: str = "append", output_columns: Sequence[str] | None = None):
        super().__init__()
        if not hasattr(transformer, "transform") and not hasattr(transformer, "fit"):
            raise DataPrepError("a transformer has fit or transform")
        if output not in ("replace", "append"):
            raise DataPrepError("output is 'replace' or 'append'")
        self.transformer, self.columns, self.output, self.output_columns = transformer, _names(columns), output, list(output_columns) if output_columns else None

    def inputs(self):
        return self.columns

    def fit(self, df):
        self._check(df)
        fitted = self.transformer.fit(df) if hasattr(self.transformer, "fit") else self.transformer
        self.model = fitted if hasattr(fitted, "transform") else self.transformer
        self.state = {"fitted": True}
        return self

    def project(self, df):
        raise DataPrepError("the transformer makes whole frames")

    def transform(self, df):
        if self.state is None:
            raise NotFittedError(f"{self.name} is not fitted")
        self._check(df)
        out = self.model.transform(df)
        lost = [c for c in df.columns if c not in out.columns and c not in self.columns]
        if lost:
            raise DataPrepError(f"the transformer lost columns {lost}")
        made = [c for c in out.columns if c not in df.columns]
        if self.output_columns:
            if len(self.output_columns) != len(made):
                raise DataPrepError(f"{len(made)} outputs need as many names")
            clash = set(self.output_columns) & (set(df.columns) - (set(self.columns) if self.output == "replace" else set()))
            if clash:
                raise DataPrepError(f"output names are taken: {sorted(clash)}")
        names = self.output_columns or made
        if self.output == "append":
            return out.select(*df.columns, *[F.col(f"`{a}`").alias(b) for a, b in zip(made, names, strict=True)])
        if not made:  # changed in place
            return out.select(*df.columns)
        if not self.output_columns and len(made) == len(self.columns):
            places = dict(zip(self.columns, made, strict=True))
            return out.select(*[F.col(f"`{places[c]}`").alias(c) if c in places else F.col(c) for c in df.columns])
        kept = [c for c in df.columns if c not in self.columns]
        return out.select(*kept, *[F.col(f"`{a}`").alias(b) for a, b in zip(made, names, strict=True)])
