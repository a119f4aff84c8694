"""Quality gates and preparation in one sequence."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..errors import DataWorkflowError, NotFittedError
from ..operators.prep import DataPrep, PrepResult, StepAudit
from ..operators.quality import DataQuality, QualityReport

POLICIES = ("raise", "warn", "continue")


def enforce(report: QualityReport, policy: str, name: str) -> None:
    if report.passed or policy == "continue":
        return
    text = f"{name}: {', '.join(r.check for r in report.failures)} failed"
    if policy == "raise":
        raise DataWorkflowError(text)
    warnings.warn(text, RuntimeWarning, stacklevel=3)


@dataclass(frozen=True)
class StageResult:
    name: str
    kind: str
    data: DataFrame
    quality_report: QualityReport | None = None
    prep_audits: tuple[StepAudit, ...] = ()


@dataclass(frozen=True)
class WorkflowResult:
    data: DataFrame
    stage_results: tuple[StageResult, ...]
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def quality_reports(self) -> dict[str, QualityReport]:
        return {s.name: s.quality_report for s in self.stage_results if s.quality_report is not None}

    @property
    def prep_audits(self) -> dict[str, tuple[StepAudit, ...]]:
        return {s.name: s.prep_audits for s in self.stage_results if s.prep_audits}

    def summary(self) -> list[tuple[str, str, str]]:
        return [(s.name, s.kind, s.quality_report.status.value if s.quality_report else f"{len(s.prep_audits)} steps") for s in self.stage_results]


class BaseWorkflowStage:
    name: str

    def fit_apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def run(self, df: DataFrame) -> StageResult:
        raise NotImplementedError


class QualityStage(BaseWorkflowStage):
    """A gate: one aggregate over the data, which then passes unchanged."""

    def __init__(self, name: str, quality: DataQuality, on_fail: str = "raise"):
        if on_fail not in POLICIES:
            raise DataWorkflowError(f"on_fail is one of {POLICIES}")
        self.name, self.quality, self.on_fail = name, quality, on_fail

    def fit_apply(self, df):
        enforce(self.quality.fit_validate(df), self.on_fail, self.name)
        return df

    def run(self, df):
        report = self.quality.validate(df)
        enforce(report, self.on_fail, self.name)
        return StageResult(self.name, "quality", df, report)


class PrepStage(BaseWorkflowStage):
    def __init__(self, name: str, prep: DataPrep):
        self.name, self.prep = name, prep

    def fit_apply(self, df):
        return self.prep.fit_transform(df)

    def run(self, df):
        result: PrepResult = self.prep.run(df)
        return StageResult(self.name, "prep", result.data, None, result.audits)


class DataWorkflow:
    """Stages in order; later gates are fitted on prepared training data."""

    def __init__(self, stages: Sequence[BaseWorkflowStage]):
        self.stages = list(stages)
        names = [s.name for s in self.stages]
        if len(set(names)) != len(names) or not all(names):
            raise DataWorkflowError("stage names must be distinct and not empty")
        self.fitted = False

    def fit(self, df: DataFrame) -> DataWorkflow:
        for stage in self.stages:
            df = stage.fit_apply(df)
        self.fitted = True
        return self

    def run(self, df: DataFrame) -> WorkflowResult:
        if not self.fitted:
            raise NotFittedError("the workflow is not fitted")
        results = []
        for stage in self.stages:
            results.append(stage.run(df))
            df = results[-1].data
        return WorkflowResult(df, tuple(results), {"stages": [s.name for s in self.stages]})

    def fit_run(self, df: DataFrame) -> WorkflowResult:
        return self.fit(df).run(df)
