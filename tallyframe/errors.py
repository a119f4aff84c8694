"""Exceptions of the analytics engine."""


class TallyError(Exception):
    """Base of all errors raised here."""


class AnalysisError(TallyError):
    pass


class CubeError(AnalysisError):
    pass


class DimensionError(AnalysisError):
    pass


class MeasureError(AnalysisError):
    pass


class TransformError(AnalysisError):
    pass


class NotFittedError(AnalysisError):
    pass


class LayoutError(AnalysisError):
    pass


class EngineError(AnalysisError):
    pass


class InvalidMetricError(TallyError, ValueError):
    """A metric has no valid value and the policy is to raise."""


class DataQualityError(TallyError):
    pass


class DataPrepError(TallyError):
    pass


class DataWorkflowError(TallyError):
    pass


class ArtifactError(TallyError):
    pass


class ModelingError(TallyError):
    pass


class PlanError(ModelingError):
    pass


class CompatibilityError(PlanError):
    pass


class ExperimentError(ModelingError):
    pass


class RunError(ExperimentError):
    pass
