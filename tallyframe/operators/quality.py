"""Reference-fitted data checks; all scalar checks of a frame share one aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataQualityError, NotFittedError
from ..functions.expr import FLOATS

BLANKS = " \t\n\r\f\x0b"
#: Texts that stand for a missing value.
MISSING_TEXTS = ("", "null", "none", "nan", "n/a")


class CheckStatus(str, Enum):
    SKIP = "SKIP"
    PASS = "PASS"
    WARN = "WARN"
    FAIL = "FAIL"


ORDER = [CheckStatus.SKIP, CheckStatus.PASS, CheckStatus.WARN, CheckStatus.FAIL]


def worst(statuses: Sequence[CheckStatus]) -> CheckStatus:
    return max(statuses, key=ORDER.index, default=CheckStatus.SKIP)


def severity(value: float | None, warn: float | None, fail: float | None) -> CheckStatus:
    if value is None:
        return CheckStatus.SKIP
    if fail is not None and value > fail:
        return CheckStatus.FAIL
    return CheckStatus.WARN if warn is not None and value > warn else CheckStatus.PASS


def relative(current: float, reference: float) -> float:
    if reference == 0:
        return 0.0 if current == 0 else math.inf
    return abs(current - reference) / abs(reference)


@dataclass(frozen=True)
class CheckResult:
    check: str
    status: CheckStatus
    columns: tuple[str, ...]
    observed: dict[str, Any]
    expected: dict[str, Any] = field(default_factory=dict)
    message: str = ""

    @property
    def passed(self) -> bool:
        return self.status in (CheckStatus.PASS, CheckStatus.SKIP)


@dataclass(frozen=True)
class QualityReport:
    results: tuple[CheckResult, ...]

    @property
    def status(self) -> CheckStatus:
        return worst([r.status for r in self.results])

    @property
    def passed(self) -> bool:
        return self.status is not CheckStatus.FAIL

    @property
    def failures(self) -> tuple[CheckResult, ...]:
        return tuple(r for r in self.results if r.status is CheckStatus.FAIL)

    @property
    def warnings(self) -> tuple[CheckResult, ...]:
        return tuple(r for r in self.results if r.status is CheckStatus.WARN)

    def rows(self) -> list[tuple]:
        return [(r.check, r.status.value, ", ".join(r.columns), str(r.observed), str(r.expected), r.message) for r in self.results]

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), "check string, status string, columns string, observed string, expected string, message string")

    def summary(self) -> dict[str, int]:
        return {s.value: sum(r.status is s for r in self.results) for s in ORDER}


def missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, FLOATS) else c.isNull()


class BaseQualityCheck:
    """A check asks for aggregates, may run a query of its own, then judges.

    ``metrics`` gives aggregate columns by name, fused with those of all other
    checks; ``query`` returns what a single aggregate row can't hold.
    """

    fitted = False

    def __init__(self, columns: Sequence[str] | str | None = None):
        self.columns = [columns] if isinstance(columns, str) else list(columns) if columns is not None else None

    @property
    def name(self) -> str:
        return type(self).__name__

    def of(self, df: DataFrame) -> list[str]:
        names = df.columns if self.columns is None else self.columns
        lost = [c for c in names if c not in df.columns]
        if lost:
            raise DataQualityError(f"{self.name}: missing columns {lost}")
        return list(names)

    def metrics(self, df: DataFrame) -> dict[str, Column]:
        return {}

    def query(self, df: DataFrame) -> dict[str, Any]:
        return {}

    def learn(self, df: DataFrame, got: dict[str, Any]) -> None:
        """Keep what ``judge`` compares with."""

    def judge(self, df: DataFrame, got: dict[str, Any]) -> CheckResult:
        raise NotImplementedError

    def result(self, df: DataFrame, observed: dict, statuses: Sequence[CheckStatus], expected: dict | None = None) -> CheckResult:
        status = worst(list(statuses))
        bad = [str(k) for k in observed] if status in (CheckStatus.WARN, CheckStatus.FAIL) else []
        return CheckResult(self.name, status, tuple(self.of(df)), observed, expected or {}, f"{status.value}: {', '.join(bad)}" if bad else status.value)


def _collect(df: DataFrame, checks: Sequence[BaseQualityCheck]) -> list[dict[str, Any]]:
    """Aggregates of all checks in one job."""
    wanted = [(i, k, c) for i, check in enumerate(checks) for k, c in check.metrics(df).items()]
    out: list[dict[str, Any]] = [{} for _ in checks]
    if wanted:
        row = df.agg(*[c.alias(f"q{n}") for n, (_, _, c) in enumerate(wanted)]).first()
        for n, (i, k, _) in enumerate(wanted):
            out[i][k] = row[n]
    return out


class DataQuality:
    """Named checks fitted on a reference and applied to later frames."""

    def __init__(self, checks: Sequence[BaseQualityCheck | tuple[str, BaseQualityCheck]]):
        self.checks: list[tuple[str, BaseQualityCheck]] = []
        used: dict[str, int] = {}
        for c in checks:
            name, check = c if isinstance(c, tuple) else (type(c).__name__.lower(), c)
            if not isinstance(check, BaseQualityCheck):
                raise DataQualityError("checks are BaseQualityCheck objects")
            used[name] = used.get(name, 0) + 1
            self.checks.append((name if used[name] == 1 else f"{name}-{used[name]}", check))
        self.profile_: DataProfile | None = None

    def fit(self, reference: DataFrame, profile: bool = False) -> DataQuality:
        objects = [c for _, c in self.checks]
        for check, got in zip(objects, _collect(reference, objects), strict=True):
            check.learn(reference, got | check.query(reference))
            check.fitted = True
        self.profile_ = DataProfile.from_frame(reference) if profile else None
        return self

    def validate(self, current: DataFrame) -> QualityReport:
        objects = [c for _, c in self.checks]
        if not all(c.fitted for c in objects):
            raise NotFittedError("fit the checks first")
        got = _collect(current, objects)
        return QualityReport(tuple(c.judge(current, g | c.query(current)) for c, g in zip(objects, got, strict=True)))

    def fit_validate(self, df: DataFrame) -> QualityReport:
        return self.fit(df).validate(df)


class SchemaCheck(BaseQualityCheck):
    """Names, types and order; reads no rows."""

    def __init__(self, columns: Sequence[str] | None = None, dtypes: dict[str, str] | None = None, allow_extra: bool = False, check_order: bool = True):
        super().__init__(columns)
        self.dtypes, self.allow_extra, self.check_order = dtypes, allow_extra, check_order

    def of(self, df):
        return [c for c in (self.columns or df.columns) if c in df.columns]

    def learn(self, df, got):
        types = dict(df.dtypes)
        self.names_ = list(self.columns or df.columns)
        self.types_ = dict(self.dtypes) if self.dtypes is not None else {c: types[c] for c in self.names_ if c in types}

    def judge(self, df, got):
        have = dict(df.dtypes)
        observed = {
            "missing": [c for c in self.names_ if c not in have],
            "extra": [] if self.allow_extra else [c for c in df.columns if c not in self.names_],
            "duplicate": sorted({c for c in df.columns if df.columns.count(c) > 1}),
            "changed": {c: [t, have[c]] for c, t in self.types_.items() if c in have and have[c] != t},
        }
        common = [c for c in df.columns if c in self.names_]
        observed["order"] = common if self.check_order and common != [c for c in self.names_ if c in have] else []
        found = {k: v for k, v in observed.items() if v}
        return self.result(df, found, [CheckStatus.FAIL if found else CheckStatus.PASS], {"columns": self.names_, "dtypes": self.types_})


class RowCountCheck(BaseQualityCheck):
    def __init__(self, min_rows: int | None = None, warn_relative_change: float | None = None, fail_relative_change: float | None = None):
        super().__init__([])
        self.min_rows, self.warn, self.fail = min_rows, warn_relative_change, fail_relative_change

    def metrics(self, df):
        return {"rows": F.count(F.lit(1))}

    def learn(self, df, got):
        self.rows_ = got["rows"]

    def judge(self, df, got):
        change = relative(got["rows"], self.rows_)
        short = self.min_rows is not None and got["rows"] < self.min_rows
        return self.result(df, {"rows": got["rows"], "relative_change": change}, [severity(change, self.warn, self.fail), CheckStatus.FAIL if short else CheckStatus.PASS], {"rows": self.rows_, "min_rows": self.min_rows})


class MissingRateCheck(BaseQualityCheck):
    def __init__(self, columns=None, max_rate: float | None = None, warn_delta: float | None = None, fail_delta: float | None = None):
        super().__init__(columns)
        self.max_rate, self.warn, self.fail = max_rate, warn_delta, fail_delta

    def metrics(self, df):
        return {"rows": F.count(F.lit(1))} | {c: F.count_if(missing(df, c)) for c in self.of(df)}

    def rates(self, df, got):
        return {c: got[c] / got["rows"] if got["rows"] else None for c in self.of(df)}

    def learn(self, df, got):
        self.rates_ = self.rates(df, got)

    def judge(self, df, got):
        rates, statuses, observed = self.rates(df, got), [], {}
        for c, rate in rates.items():
            before = self.rates_.get(c)
            delta = rate - before if rate is not None and before is not None else None
            observed[c] = {"rate": rate, "delta": delta}
            statuses.append(CheckStatus.SKIP if rate is None else worst([severity(delta, self.warn, self.fail), severity(rate, None, self.max_rate)]))
        return self.result(df, observed, statuses, {"rates": self.rates_, "max_rate": self.max_rate})


class MissingLikeCheck(BaseQualityCheck):
    """Texts that stand for a missing value, after trimming and lower-casing."""

    def __init__(self, columns=None, values: Sequence[str] | None = None, strip_strings: bool = True, case_insensitive: bool = True, max_rate: float | None = None):
        super().__init__(columns)
        self.values, self.strip, self.fold, self.max_rate = list(MISSING_TEXTS if values is None else values), strip_strings, case_insensitive, 0.0 if max_rate is None else max_rate

    def of(self, df):
        return [c for c in super().of(df) if isinstance(df.schema[c].dataType, T.StringType)]

    def _normal(self, c: Column) -> Column:
        c = F.btrim(c, F.lit(BLANKS)) if self.strip else c
        return F.lower(c) if self.fold else c

    def metrics(self, df):
        wanted = [(v.strip(BLANKS) if self.strip else v) for v in self.values]
        wanted = [v.lower() if self.fold else v for v in wanted]
        return {"rows": F.count(F.lit(1))} | {c: F.count_if(self._normal(F.col(c)).isin(*wanted)) for c in self.of(df)}

    def judge(self, df, got):
        rates = {c: got[c] / got["rows"] if got["rows"] else None for c in self.of(df)}
        return self.result(df, {c: {"count": got[c], "rate": r} for c, r in rates.items()}, [severity(r, None, self.max_rate) for r in rates.values()], {"max_rate": self.max_rate})


class UniqueCheck(BaseQualityCheck):
    """Rows in groups of equal keys; NULL keys are equal."""

    def __init__(self, columns, max_examples: int = 10):
        super().__init__(columns)
        self.max_examples = max_examples

    def query(self, df):
        keys = self.of(df)
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
        total = groups.agg(F.sum("__n"), F.count(F.lit(1))).first()
        examples = [r.asDict() for r in groups.orderBy(F.desc("__n"), *keys).limit(self.max_examples).collect()] if total[1] else []
        return {"rows": total[0] or 0, "groups": total[1], "examples": examples}

    def judge(self, df, got):
        return self.result(df, got, [CheckStatus.FAIL if got["rows"] else CheckStatus.PASS])


MAX_CATEGORIES = 1_000_000


class CategorySetCheck(BaseQualityCheck):
    def __init__(self, column: str, values: Sequence[Any] | None = None, check_new: bool = True, check_missing: bool = True):
        super().__init__(column)
        self.values, self.check_new, self.check_missing = values, check_new, check_missing

    def query(self, df):
        c = self.of(df)[0]
        found = df.filter(~missing(df, c)).select(c).distinct().limit(MAX_CATEGORIES + 1).collect()
        if len(found) > MAX_CATEGORIES:
            raise DataQualityError(f"{c} has more than {MAX_CATEGORIES} values: not a set of categories")
        return {"values": {r[0] for r in found}}

    def learn(self, df, got):
        self.values_ = set(self.values) if self.values is not None else got["values"]

    def judge(self, df, got):
        new = sorted(got["values"] - self.values_, key=str) if self.check_new else []
        gone = sorted(self.values_ - got["values"], key=str) if self.check_missing else []
        return self.result(df, {"new": new, "missing": gone}, [CheckStatus.FAIL if new or gone else CheckStatus.PASS], {"values": sorted(self.values_, key=str)})


class CardinalityCheck(BaseQualityCheck):
    def __init__(self, columns, warn_change: float | None = None, fail_change: float | None = None):
        super().__init__(columns)
        self.warn, self.fail = warn_change, fail_change

    def metrics(self, df):
        return {c: F.count_distinct(F.when(~missing(df, c), F.col(c))) for c in self.of(df)}

    def learn(self, df, got):
        self.counts_ = dict(got)

    def judge(self, df, got):
        changes = {c: relative(got[c], self.counts_[c]) for c in self.of(df)}
        return self.result(df, {c: {"distinct": got[c], "relative_change": x} for c, x in changes.items()}, [severity(x, self.warn, self.fail) for x in changes.values()], {"distinct": self.counts_})


class ConstantCheck(BaseQualityCheck):
    """Share of the most frequent value, missing counted as one."""

    def __init__(self, columns=None, max_dominant_rate: float = 1.0):
        super().__init__(columns)
        self.max_rate = max_dominant_rate

    def query(self, df):
        """All columns in one pass: unfolded to (column, value) and counted."""
        names = self.of(df)
        if not names:
            return {}
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.when(~missing(df, c), F.col(c).cast("string")).alias("v")) for c in names])).alias("x")
        counted = df.select(cells).groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.max("n").alias("top"), F.sum("n").alias("rows"))
        found = {r["c"]: r["top"] / r["rows"] for r in counted.collect()}
        return {c: found.get(c) for c in names}

    def judge(self, df, got):
        statuses = [CheckStatus.SKIP if r is None else CheckStatus.FAIL if r >= self.max_rate else CheckStatus.PASS for r in got.values()]
        return self.result(df, {c: {"dominant_rate": r} for c, r in got.items()}, statuses, {"max_dominant_rate": self.max_rate})


def to_double(c: Column) -> Column:
    """A text as a number, or NULL; Java's type suffixes are not numbers."""
    suffixed = c.rlike(r"(?i)[df]\s*$") & ~c.rlike(r"(?i)^\s*[+-]?inf\s*$")
    value = c.try_cast("double")
    return F.when(~suffixed & ~F.isnan(value), value)


class NumericConvertibleCheck(BaseQualityCheck):
    def __init__(self, columns, min_success_rate: float = 0.99, max_examples: int = 10):
        super().__init__(columns)
        self.min_rate, self.max_examples = min_success_rate, max_examples

    def metrics(self, df):
        out = {}
        for c in self.of(df):
            bad = F.col(c).isNotNull() & to_double(F.col(c).cast("string")).isNull()
            out |= {f"{c}|known": F.count(F.col(c)), f"{c}|bad": F.count_if(bad)}
        return out

    def judge(self, df, got):
        observed, statuses = {}, []
        for c in self.of(df):
            known, bad = got[f"{c}|known"], got[f"{c}|bad"]
            rate = (known - bad) / known if known else None
            examples = [r[0] for r in df.filter(F.col(c).isNotNull() & to_double(F.col(c).cast("string")).isNull()).select(c).limit(self.max_examples).collect()] if bad else []
            observed[c] = {"success_rate": rate, "failed": bad, "examples": examples}
            statuses.append(CheckStatus.SKIP if rate is None else CheckStatus.FAIL if rate < self.min_rate else CheckStatus.PASS)
        return self.result(df, observed, statuses, {"min_success_rate": self.min_rate})


class FiniteCheck(BaseQualityCheck):
    def __init__(self, columns, allow_nan: bool = True):
        super().__init__(columns)
        self.allow_nan = allow_nan

    def metrics(self, df):
        out = {}
        for c in self.of(df):
            x = F.col(c).cast("double")
            out |= {f"{c}|nan": F.count_if(x.isNull() | F.isnan(x)), f"{c}|inf": F.count_if(x == F.lit(math.inf)), f"{c}|-inf": F.count_if(x == F.lit(-math.inf))}
        return out

    def judge(self, df, got):
        observed = {c: {k: got[f"{c}|{k}"] for k in ("nan", "inf", "-inf")} for c in self.of(df)}
        bad = [CheckStatus.FAIL if o["inf"] or o["-inf"] or (o["nan"] and not self.allow_nan) else CheckStatus.PASS for o in observed.values()]
        return self.result(df, observed, bad)


class RangeCheck(BaseQualityCheck):
    def __init__(self, column: str, min_value: float | None = None, max_value: float | None = None, inclusive: str = "both"):
        super().__init__(column)
        if inclusive not in ("both", "left", "right", "neither"):
            raise DataQualityError("inclusive is 'both', 'left', 'right' or 'neither'")
        self.low, self.high, self.inclusive = min_value, max_value, inclusive

    def metrics(self, df):
        c = self.of(df)[0]
        x, out = F.when(~missing(df, c), F.col(c)), F.lit(False)
        if self.low is not None:
            out = out | ((x < self.low) if self.inclusive in ("both", "left") else (x <= self.low))
        if self.high is not None:
            out = out | ((x > self.high) if self.inclusive in ("both", "right") else (x >= self.high))
        return {"outside": F.count_if(out), "known": F.count(x)}

    def judge(self, df, got):
        status = CheckStatus.SKIP if not got["known"] else CheckStatus.FAIL if got["outside"] else CheckStatus.PASS
        return self.result(df, got, [status], {"min": self.low, "max": self.high, "inclusive": self.inclusive})


QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@dataclass(frozen=True)
class DataProfile:
    """Per-column statistics of a frame."""

    columns: dict[str, dict[str, Any]]

    @classmethod
    def from_frame(cls, df: DataFrame, max_top_values: int = 20) -> DataProfile:
        numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
        made: list[Column] = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(df.columns):
            made += [F.count_if(missing(df, c)).alias(f"m{i}"), F.count_distinct(F.when(~missing(df, c), F.col(c))).alias(f"u{i}")]
            if c in numeric:
                x = F.when(~missing(df, c), F.col(c).cast("double"))
                fin = F.when(F.abs(x) < F.lit(math.inf), x)
                made += [F.count_if(x == 0).alias(f"z{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(fin).alias(f"a{i}"), F.stddev_samp(fin).alias(f"s{i}"), F.percentile(fin, F.array(*[F.lit(q) for q in QUANTILES])).alias(f"q{i}")]
        row = df.agg(*made).first()
        out = {}
        for i, c in enumerate(df.columns):
            n = row["n"]
            stats = {"dtype": dict(df.dtypes)[c], "count": n - row[f"m{i}"], "missing": row[f"m{i}"], "missing_rate": row[f"m{i}"] / n if n else None, "nunique": row[f"u{i}"]}
            if c in numeric:
                qs = row[f"q{i}"] or [None] * len(QUANTILES)
                stats |= {"zero_count": row[f"z{i}"], "zero_rate": row[f"z{i}"] / n if n else None, "min": row[f"lo{i}"], "max": row[f"hi{i}"], "mean": row[f"a{i}"], "std": row[f"s{i}"]} | {f"q{round(q * 100):02d}": v for q, v in zip(QUANTILES, qs, strict=True)}
            else:
                top = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(max_top_values).collect()
                stats["top_values"] = [(r[0], r["count"]) for r in top]
            out[c] = stats
        return cls(out)
