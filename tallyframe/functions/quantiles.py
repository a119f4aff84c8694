"""Exact quantiles that don't gather a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .expr import finite, score_slice

DIRECT_ROWS = 2_000_000
COLUMNS_AT_ONCE, JOBS_AT_ONCE = 4, 8


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], direct_rows: int = DIRECT_ROWS) -> list[float] | None:
    """Linear-interpolated quantiles of the finite values; None without any.

    Up to ``direct_rows`` values one exact aggregate answers.  Beyond, an
    approximate pass brackets every wanted rank, a second counts what lies below
    each bracket, and only the brackets' values, a small share of the column,
    are ranked exactly.
    """
    values = df.select(finite(F.col(column)).alias("x")).filter("x is not null")
    n = values.count()
    if not n:
        return None
    if n <= direct_rows:
        return list(values.agg(F.percentile("x", F.array(*[F.lit(float(p)) for p in probabilities]))).first()[0])
    wanted = sorted({r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    slack, accuracy = 2e-4, 10_000
    points = [min(1.0, max(0.0, r / max(1, n - 1) + d)) for r in wanted for d in (-slack, slack)]
    edges = values.agg(F.percentile_approx("x", [float(p) for p in points], accuracy), F.min("x"), F.max("x")).first()
    spans = [(edges[1] if points[2 * i] == 0 else edges[0][2 * i], edges[2] if points[2 * i + 1] == 1 else edges[0][2 * i + 1]) for i in range(len(wanted))]
    merged: list[list[float]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    below = values.agg(*[F.count_if(F.col("x") < lo).alias(f"b{i}") for i, (lo, _) in enumerate(merged)]).first()
    bracket = F.coalesce(*[F.when(F.col("x").between(lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(merged)])
    counted = values.withColumn("i", bracket).filter("i is not null").groupBy("i", "x").count()
    up_to = F.sum("count").over(Window.partitionBy("i").orderBy("x"))
    ranked = counted.withColumn("hi", up_to + F.element_at(F.array(*[F.lit(b) for b in below]), F.col("i") + 1)).withColumn("lo", F.col("hi") - F.col("count"))
    hit = F.array(*[F.lit(r) for r in wanted])
    rows = ranked.withColumn("r", F.explode(F.filter(hit, lambda r: (r >= F.col("lo")) & (r < F.col("hi"))))).select("r", "x").collect()
    at = {row["r"]: row["x"] for row in rows}
    out = []
    for p in probabilities:
        place = p * (n - 1)
        lo, hi = at[math.floor(place)], at[math.ceil(place)]
        out.append(lo + (hi - lo) * (place - math.floor(place)))
    return out


def quantiles_of_columns(df: DataFrame, wanted: dict[str, Sequence[float]], direct_rows: int = DIRECT_ROWS) -> dict[str, list[float] | None]:
    """``exact_quantiles`` of several columns, in as few jobs as ``direct_rows`` values each allow."""
    at_once = min(COLUMNS_AT_ONCE, direct_rows // max(1, df.count()))
    if at_once < 2:
        return {c: exact_quantiles(df, c, p, direct_rows) for c, p in wanted.items()}

    def some(names: list[str]) -> dict[str, list[float] | None]:
        row = df.agg(*[F.percentile(finite(F.col(c)), F.array(*[F.lit(float(p)) for p in wanted[c]])).alias(f"q{i}") for i, c in enumerate(names)]).first()
        return {c: None if row[i] is None else list(row[i]) for i, c in enumerate(names)}

    names, out = list(wanted), {}
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:  # an exact percentile ends in one task, so jobs run side by side
        for found in pool.map(some, [names[lo : lo + at_once] for lo in range(0, len(names), at_once)]):
            out |= found
    return out


def grouped_quantiles(df: DataFrame, column: str, by: Sequence[str], probabilities: Sequence[float], direct_rows: int = DIRECT_ROWS) -> dict[tuple, list[float] | None]:
    """``exact_quantiles`` of every group; a group without finite values has None.

    Beyond ``direct_rows`` rows values are counted, and only running counts are
    ordered, over monotone slices of each group's range; what reaches the driver
    is two values a group and probability.
    """
    if df.count() <= direct_rows:
        made = F.percentile(finite(F.col(column)), F.array(*[F.lit(float(p)) for p in probabilities]))
        return {tuple(r)[:-1]: r[-1] for r in df.groupBy(*by).agg(made).collect()}
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], finite(F.col(column)).alias("x"))
    counted = rows.groupBy(*keys, "x").count().withColumn("b", score_slice(F.col("x")))
    known = counted.filter("x is not null")
    whole = Window.partitionBy(*keys)
    per = known.groupBy(*keys, "b").agg(F.sum("count").alias("n"))
    offsets = per.select(*[F.col(k).alias(f"{k}o") for k in keys], F.col("b").alias("ob"), (F.sum("n").over(whole.orderBy("b")) - F.col("n")).alias("o"), F.sum("n").over(whole).alias("all"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}o")) for k in keys] + [F.col("b") == F.col("ob")]
    up_to = F.sum("count").over(Window.partitionBy(*keys, "b").orderBy("x"))
    ranked = known.join(offsets, same).withColumn("hi", up_to + F.col("o")).withColumn("lo", F.col("hi") - F.col("count"))
    wanted = F.array_distinct(F.array(*[f(F.lit(float(p)) * (F.col("all") - 1)).cast("long") for p in probabilities for f in (F.floor, F.ceil)]))
    hits = ranked.withColumn("r", F.explode(F.filter(wanted, lambda r: (r >= F.col("lo")) & (r < F.col("hi"))))).select(*keys, "r", "x", "all").collect()
    groups: dict[tuple, list[float] | None] = {tuple(r): None for r in counted.select(*keys).distinct().collect()}
    at: dict[tuple, tuple[int, dict[int, float]]] = {}
    for h in hits:
        at.setdefault(tuple(h)[: len(keys)], (h["all"], {}))[1][h["r"]] = h["x"]
    for group, (n, x) in at.items():
        out = []
        for p in probabilities:
            place = float(p) * (n - 1)
            lo, hi = x[math.floor(place)], x[math.ceil(place)]
            out.append(lo + (hi - lo) * (place - math.floor(place)))
        groups[group] = out
    return groups
