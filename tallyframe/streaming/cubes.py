"""Additive measures over event-time windows of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CubeError
from ..functions.expr import nan_to_null
from ..operators.measures import AnalysisContext, BaseMeasure


def windowed_cube(stream: DataFrame, time: str, window: str, dimensions: Sequence[str], measures: Sequence[BaseMeasure], *, slide: str | None = None, watermark: str = "10 minutes", context: AnalysisContext | None = None) -> DataFrame:
    """One row a window and key, a column a measure; late rows past the watermark are dropped.

    Works the same on a batch frame.  Measures that need ranks, the whole
    population or another measure are batch only.
    """
    made = [m.compile(context or AnalysisContext()) for m in measures]
    for c in made:
        if c.rank or c.needs or c.finish is None:
            raise CubeError(f"{c.name} can't be kept over a stream")
    aggregates: dict = {}
    for c in made:
        aggregates |= c.aggregates
    at = {key: f"__a{i}" for i, key in enumerate(aggregates)}
    span = F.window(time, window, slide) if slide else F.window(time, window)
    rows = nan_to_null(stream).withWatermark(time, watermark)
    grouped = rows.groupBy(span.alias("__w"), *dimensions).agg(*[c.alias(at[k]) for k, c in aggregates.items()])

    def read(key: str):
        if key == "population":
            raise CubeError("shares of a population can't be kept over a stream")
        return F.col(at[key])

    return grouped.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *dimensions, *[c.finish(read).alias(c.name) for c in made])
