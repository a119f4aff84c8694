"""Declarative cohort analytics on Spark DataFrames."""

from .functions.expr import Col, Predicate
from .operators.binning import BaseTransformer, EqualWidthBinner, FixedBinner, QuantileBinner
from .operators.dimensions import BaseDimension, BinDimension, ColumnDimension
from .operators.measures import AUC, KS, PSI, AnalysisContext, BaseMeasure, ComparativeCalculation, Count, EventRate, Funnel, Ratio, Share, Stage, Sum, Transition
from .plans.cube import ComputePolicy, Cube, CubeResult, MissingPolicy
from .plans.workflow import DataWorkflow, PrepStage, QualityStage

__all__ = [
    "AUC", "KS", "PSI", "AnalysisContext", "BaseDimension", "BaseMeasure", "BaseTransformer", "BinDimension", "Col", "ColumnDimension", "ComparativeCalculation", "ComputePolicy", "Count", "Cube",
    "CubeResult", "DataWorkflow", "EqualWidthBinner", "EventRate", "FixedBinner", "Funnel", "MissingPolicy", "Predicate", "PrepStage", "QualityStage", "QuantileBinner", "Ratio", "Share", "Stage", "Sum", "Transition",
]
