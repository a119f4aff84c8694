"""AUC and KS as aggregates: a score histogram, then running sums.

Equal scores collapse first, so ties cost nothing and totals over fewer keys
come from the same histogram.  Running sums go in two steps, within monotone
slices of the score and over the slices' totals, so that a sample without keys
doesn't meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import divide, finite, score_slice
from .measures import valid_weight


def histogram(df: DataFrame, keys: Sequence[str], score: str, target: str, weight: str | None) -> DataFrame:
    """``keys, s, pos, neg, odd``: weight by class at each distinct score."""
    w = valid_weight(weight) if weight else F.lit(1.0)
    s, t = finite(F.col(score)), F.col(target).cast("double")
    rows = df.select(*keys, s.alias("s"), t.alias("t"), w.alias("w")).filter("s is not null and t is not null and w > 0")
    return rows.groupBy(*keys, "s").agg(F.sum(F.when(F.col("t") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("t") == 0, F.col("w")).otherwise(0.0)).alias("neg"), F.count_if(~F.col("t").isin(0.0, 1.0)).alias("odd"))


def rank_statistics(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, auc, ks``; NULL where a class is absent or a target isn't 0 or 1."""
    sliced = hist.withColumn("b", score_slice(F.col("s")))
    per = sliced.groupBy(*keys, "b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), F.sum("odd").alias("bo"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("b").alias("ob"), *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(n) for c, n in (("bp", "p0"), ("bn", "n0"))], F.sum("bp").over(whole).alias("tp"), F.sum("bn").over(whole).alias("tn"), F.sum("bo").over(whole).alias("to"))
    same = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys] + [F.col("b") == F.col("ob")]
    joined = sliced.join(offsets, same).drop(*[f"o_{k}" for k in keys], "ob")
    run = Window.partitionBy(*keys, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cp, cn = F.col("p0") + F.sum("pos").over(run), F.col("n0") + F.sum("neg").over(run)
    stepped = joined.withColumn("cp", cp).withColumn("cn", cn)
    pairs = F.sum(F.col("pos") * (F.col("cn") - F.col("neg") / 2))
    gap = F.max(F.abs(divide(F.col("cp"), F.col("tp")) - divide(F.col("cn"), F.col("tn"))))
    ok = (F.max("to") == 0) & (F.max("tp") > 0) & (F.max("tn") > 0)
    auc = divide(pairs, F.max("tp") * F.max("tn"))
    return stepped.groupBy(*keys).agg(F.when(ok, auc).alias("auc"), F.when(ok, gap).alias("ks"))


def auc_score(df: DataFrame, target: str, score: str, weight: str | None = None) -> float | None:
    return _one(df, target, score, weight, "auc")


def ks_score(df: DataFrame, target: str, score: str, weight: str | None = None) -> float | None:
    return _one(df, target, score, weight, "ks")


def _one(df: DataFrame, target: str, score: str, weight: str | None, kind: str) -> float | None:
    row = rank_statistics(histogram(df, [], score, target, weight), []).first()
    return row[kind] if row else None


def event_rate(df: DataFrame, target: str, event_value=1, weight: str | None = None) -> float | None:
    w = valid_weight(weight) if weight else F.lit(1.0)
    t = F.col(target)
    return df.agg(divide(F.sum(F.when(t == F.lit(event_value), w).otherwise(0.0)), F.sum(F.when(t.isNotNull(), w).otherwise(0.0)))).first()[0]


def psi_from_proportions(reference: Sequence[float], current: Sequence[float], epsilon: float = 1e-8) -> float | None:
    """PSI of two lists of proportions: clipped to ``epsilon``, renormalised, summed."""
    if not epsilon > 0:
        raise ValueError("epsilon must be positive")
    sides = [list(map(float, reference)), list(map(float, current))]
    if len(sides[0]) != len(sides[1]) or not sides[0]:
        raise ValueError("both sides need the same bins")
    for side in sides:
        if any(not math.isfinite(p) or p < 0 for p in side) or abs(sum(side) - 1) > 1e-6:
            return None
    p, q = ([max(x, epsilon) for x in side] for side in sides)
    sp, sq = sum(p), sum(q)
    return sum((b / sq - a / sp) * math.log((b / sq) / (a / sp)) for a, b in zip(p, q, strict=True))
