"""Modelling declarations, and data splits that run.

A model plan says what is modelled and how; a data plan binds columns to roles
and features and says how to split.  Declarations hold no data and check each
other; ``SplitSpec.assign`` adds the partition as a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CompatibilityError, PlanError


def _columns(value: str | Sequence[str], what: str) -> tuple[str, ...]:
    out = (value,) if isinstance(value, str) else tuple(value)
    if not out or any(not isinstance(c, str) or not c for c in out) or len(set(out)) != len(out):
        raise PlanError(f"{what}: distinct column names are needed")
    return out


@dataclass(frozen=True)
class ModelingGoal:
    kind: str
    required_roles: tuple[str, ...]
    objectives: tuple[str, ...]
    optional_roles: tuple[str, ...] = ("weight", "sample_key", "time")
    objective_roles: dict[str, tuple[str, ...]] = field(default_factory=dict)  # what an objective asks for beyond

    def __post_init__(self) -> None:
        unknown = set(self.objective_roles) - set(self.objectives)
        if unknown:
            raise PlanError(f"roles for unknown objectives: {sorted(unknown)}")


def binary_classification(multitask: bool = False) -> ModelingGoal:
    return ModelingGoal("binary_classification", ("target",), ("log_loss", "focal_loss"))


def regression() -> ModelingGoal:
    return ModelingGoal("regression", ("target",), ("squared_error", "absolute_error", "quantile"))


def causal_effect() -> ModelingGoal:
    return ModelingGoal("causal_effect", ("target", "treatment"), ("uplift", "squared_error"))


def survival() -> ModelingGoal:
    return ModelingGoal("survival", ("duration", "event"), ("cox", "aft"))


@dataclass(frozen=True)
class ModelStrategy:
    kind: str
    goals: tuple[str, ...]
    objectives: tuple[str, ...]
    handles_missing: bool
    handles_categorical: bool
    needs_scaling: bool
    supports_weight: bool = True
    data_family: str = "tabular"


def gradient_boosting() -> ModelStrategy:
    return ModelStrategy("gradient_boosting", ("binary_classification", "regression", "causal_effect"), ("log_loss", "squared_error", "absolute_error", "quantile", "uplift"), True, True, False)


def multilayer_perceptron() -> ModelStrategy:
    return ModelStrategy("mlp", ("binary_classification", "regression", "causal_effect", "survival"), ("log_loss", "focal_loss", "squared_error", "cox", "uplift"), False, False, True)


@dataclass(frozen=True)
class ModelPlan:
    """A goal and a strategy; their common objectives are what may be optimised."""

    goal: ModelingGoal
    strategy: ModelStrategy
    objective: str | None = None

    def __post_init__(self) -> None:
        if self.goal.kind not in self.strategy.goals:
            raise CompatibilityError(f"{self.strategy.kind} doesn't model {self.goal.kind}")
        if not self.objectives:
            raise CompatibilityError(f"{self.strategy.kind} and {self.goal.kind} share no objective")
        if self.objective is not None and self.objective not in self.objectives:
            raise CompatibilityError(f"{self.objective} is not one of {self.objectives}")

        if "weight" in self.required_roles and not self.strategy.supports_weight:
            raise CompatibilityError(f"{self.goal.kind} needs a weight, which {self.strategy.kind} doesn't take")

    @property
    def objectives(self) -> tuple[str, ...]:
        """Common objectives; one that needs a weight is left out where none is taken."""
        weighted = {o for o, roles in self.goal.objective_roles.items() if "weight" in roles}
        return tuple(o for o in self.goal.objectives if o in self.strategy.objectives and (self.strategy.supports_weight or o not in weighted))

    @property
    def selected(self) -> str:
        return self.objective or self.objectives[0]

    @property
    def required_roles(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.goal.required_roles, *self.goal.objective_roles.get(self.selected, ())]))

    @property
    def optional_roles(self) -> tuple[str, ...]:
        return tuple(r for r in self.goal.optional_roles if r not in self.required_roles and (r != "weight" or self.strategy.supports_weight))

    def to_dict(self) -> dict[str, Any]:
        return {"goal": self.goal.kind, "strategy": self.strategy.kind, "objective": self.selected, "roles": list(self.required_roles)}


@dataclass(frozen=True)
class RoleSpec:
    """Columns by role; only ``sample_key`` may name several."""

    bindings: dict[str, tuple[str, ...]]

    def __init__(self, **roles: str | Sequence[str]):
        bound = {r: _columns(c, r) for r, c in roles.items() if c is not None}
        many = [r for r, c in bound.items() if len(c) > 1 and r != "sample_key"]
        if many:
            raise PlanError(f"roles with more than one column: {many}")
        object.__setattr__(self, "bindings", bound)


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        both = set(self.numeric) & set(self.categorical)
        if both or not (self.numeric or self.categorical):
            raise PlanError(f"feature lists must be disjoint and not all empty: {sorted(both)}")


@dataclass(frozen=True)
class PartitionSpec:
    """A share of rows, or the source values that make up the partition."""

    ratio: float | None = None
    values: tuple[Any, ...] | None = None

    def __post_init__(self) -> None:
        if (self.ratio is None) == (self.values is None):
            raise PlanError("a partition has a ratio or values")
        if self.ratio is not None and not 0 < self.ratio < 1:
            raise PlanError("a ratio lies between 0 and 1")


class BaseSplitter:
    mode = "ratios"

    def to_dict(self) -> dict[str, Any]:
        return {"type": type(self).__name__} | {k: list(v) if isinstance(v, tuple) else v for k, v in vars(self).items()}

    def position(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """A frame and a column in [0, 1) that orders rows into partitions."""
        raise NotImplementedError


@dataclass(frozen=True)
class HashSplitter(BaseSplitter):
    """By a digest of the key: stable across runs, engines and row order; no shuffle."""

    key: tuple[str, ...]
    random_state: int = 2026

    def position(self, df):
        text = F.concat_ws("\x1f", F.lit(str(self.random_state)), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _columns(self.key, "key")])
        return df, F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


@dataclass(frozen=True)
class RandomSplitter(BaseSplitter):
    """Seeded; with ``stratify`` each stratum is cut at exact shares of its rows.

    Stratified order is by a hash of the whole row, ties in any order; ranks are
    taken in slices of the hash, so no stratum is ordered in one task.
    """

    random_state: int = 2026
    stratify: str | None = None

    def position(self, df):
        if self.stratify is None:
            return df, F.rand(self.random_state)
        order = F.xxhash64(F.lit(self.random_state), *df.columns)
        sliced = df.withColumn("__h", order).withColumn("__b", F.shiftright("__h", 48))
        per = sliced.groupBy(F.col(self.stratify).alias("__s"), F.col("__b").alias("__ob")).agg(F.count(F.lit(1)).alias("__n"))
        whole = Window.partitionBy("__s")
        offsets = per.select("__s", "__ob", (F.sum("__n").over(whole.orderBy("__ob")) - F.col("__n")).alias("__o"), F.sum("__n").over(whole).alias("__all"))
        joined = sliced.join(offsets, F.col(self.stratify).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__ob")))
        rank = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h")) - 1 + F.col("__o")
        return joined.withColumn("__place", rank / F.col("__all")).drop("__h", "__b", "__s", "__ob", "__o", "__all"), F.col("__place")


@dataclass(frozen=True)
class ColumnSplitter(BaseSplitter):
    """By the values of a column; rows with other values get no partition."""

    column: str
    mode = "values"


@dataclass(frozen=True)
class TimeSplitter(BaseSplitter):
    """Earliest first; equal times stay together, in the earlier partition; rows without a time get none.

    Times are counted before they are ordered, so only distinct times meet.
    """

    time: str

    def position(self, df):
        counted = df.filter(F.col(self.time).isNotNull()).groupBy(F.col(self.time).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
        placed = counted.select("__t", (F.coalesce(before, F.lit(0)) / F.sum("__n").over(Window.partitionBy())).alias("__place"))
        return df.join(placed, F.col(self.time) == F.col("__t"), "left").drop("__t"), F.col("__place")


@dataclass(frozen=True)
class SplitSpec:
    splitter: BaseSplitter
    partitions: dict[str, PartitionSpec]

    def __post_init__(self) -> None:
        if "train" not in self.partitions:
            raise PlanError("a split has a train partition")
        if self.splitter.mode == "ratios":
            ratios = [p.ratio for p in self.partitions.values()]
            if None in ratios or abs(sum(ratios) - 1) > 1e-9:
                raise PlanError("ratios must add up to 1")
        else:
            values = [v for p in self.partitions.values() for v in (p.values or ())]
            if any(p.values is None for p in self.partitions.values()) or len(set(values)) != len(values):
                raise PlanError("partitions need distinct source values")

    def assign(self, df: DataFrame, name: str = "partition") -> DataFrame:
        """``df`` with each row's partition, NULL where none applies."""
        if self.splitter.mode == "values":
            c, out = F.col(self.splitter.column), F.when(F.lit(False), F.lit(""))  # type: ignore[attr-defined]
            for part, spec in self.partitions.items():
                out = out.when(c.isin(*spec.values), F.lit(part))
            return df.withColumn(name, out)
        placed, place = self.splitter.position(df)
        placed = placed.withColumn("__at", place)
        out, upto = F.when(F.col("__at").isNull(), F.lit(None)), 0.0
        parts = list(self.partitions.items())
        for part, spec in parts[:-1]:
            upto += spec.ratio
            out = out.when(F.col("__at") < F.lit(upto - 1e-12), F.lit(part))
        return placed.withColumn(name, out.otherwise(F.lit(parts[-1][0]))).drop("__at", "__place")


@dataclass(frozen=True)
class DataPlan:
    roles: RoleSpec
    features: FeatureSpec
    split: SplitSpec | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    data_family: str = "tabular"

    def validate_against(self, plan: ModelPlan, df: DataFrame | None = None) -> None:
        """All that is wrong, in one error."""
        errors = [f"role {r} is not bound" for r in plan.required_roles if r not in self.roles.bindings]
        known = {*plan.required_roles, *plan.optional_roles}
        errors += [f"role {r} means nothing to {plan.goal.kind}" for r in self.roles.bindings if r not in known]
        if plan.strategy.data_family != self.data_family:
            errors.append(f"{plan.strategy.kind} reads {plan.strategy.data_family} data, not {self.data_family}")
        if self.features.categorical and not plan.strategy.handles_categorical:
            errors.append(f"{plan.strategy.kind} takes no categorical features")
        used = {c for cs in self.roles.bindings.values() for c in cs}
        errors += [f"{c} is both a role and a feature" for c in sorted(used & {*self.features.numeric, *self.features.categorical})]
        if df is not None:
            errors += [f"no column {c}" for c in sorted((used | {*self.features.numeric, *self.features.categorical}) - set(df.columns))]
        if errors:
            raise PlanError("; ".join(errors))


def log_loss(df: DataFrame, target: str, probability: str, weight: str | None = None) -> float | None:
    """Weighted mean log loss over rows with both values."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col(target) * F.ln(p) + (1 - F.col(target)) * F.ln(1 - p))
    w = F.col(weight) if weight else F.lit(1.0)
    return df.agg(F.try_divide(F.sum(loss * w), F.sum(F.when(loss.isNotNull(), w)))).first()[0]
