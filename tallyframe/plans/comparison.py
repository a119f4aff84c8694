"""Two samples, one shuffle: all PSI fields counted in a single aggregate.

Both sides are stacked with a side mark, every row unfolds to one (field, bin)
entry a PSI field, and one aggregation counts each side per key, field and bin.
Bins empty on both sides of a cell needn't exist as rows: clipped to epsilon
they add nothing to the sum, and to the renormalisation just epsilon each.
"""

from __future__ import annotations

import copy
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MeasureError, TransformError
from ..functions.expr import divide
from ..functions.quantiles import quantiles_of_columns
from ..operators.binning import QuantileBinner
from ..operators.measures import PSI, ComparativeCalculation

FITS_AT_ONCE, FIELDS_AT_ONCE = 8, 16


def compare(cube, plan, reference: DataFrame, current: DataFrame) -> DataFrame:
    """Wide result ``__d*, __m*, __gid, __a0`` keyed by the union of both sides' keys."""
    keys = [f"__d{i}" for i in range(len(plan.dimensions))]
    ref, cur = cube._prepare(reference, plan), cube._prepare(current, plan)
    stacked = [(i, m) for i, m in enumerate(cube.measures) if isinstance(m, PSI)]
    own = [(i, m) for i, m in enumerate(cube.measures) if isinstance(m, ComparativeCalculation)]
    if len(stacked) + len(own) != len(cube.measures):
        raise MeasureError("a comparative measure is a PSI or a ComparativeCalculation")
    counts = _key_counts(ref, cur, keys)
    wide = counts
    if stacked:
        wide = _join(wide, _psi(ref, cur, keys, stacked), keys)
    for i, m in own:
        found = m.evaluate(ref, cur, keys)
        wide = _join(wide, found.select(*keys, F.col("value").cast("double").alias(f"__m{i}")), keys)
    return wide.withColumn("__gid", F.lit(0).cast("long"))


def _key_counts(ref: DataFrame, cur: DataFrame, keys: list[str]) -> DataFrame:
    both = ref.select(*keys, F.lit(0).alias("__side")).unionByName(cur.select(*keys, F.lit(1).alias("__side")))
    made = [F.count(F.lit(1)).alias("__a0"), F.count_if(F.col("__side") == 0).alias("__ref"), F.count_if(F.col("__side") == 1).alias("__cur")]
    return both.groupBy(*keys).agg(*made) if keys else both.agg(*made)


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"{k}x") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"{k}x")) for k in keys]
    joined = left.join(renamed, same, "left") if keys else left.join(renamed, F.lit(True), "left")
    return joined.drop(*[f"{k}x" for k in keys])


def _fitted(ref: DataFrame, measures: list) -> dict[int, Any]:
    """Each measure's binner fitted on the reference, None where it has no values.

    Quantile binners of fields without a fit of their own are fitted together;
    other fits are jobs of their own and run side by side.
    """
    binners = {i: copy.deepcopy(m.binner) for i, m in measures}
    together = {i: m for i, m in measures if type(binners[i]) is QuantileBinner}
    points: dict[tuple[int, str], Any] = {}
    for n in {binners[i].n_bins for i in together}:
        fields = {m.field: binners[i].probabilities() for i, m in together.items() if binners[i].n_bins == n}
        points |= {(n, field): found for field, found in quantiles_of_columns(ref, fields).items()}

    def fit(entry):
        i, m = entry
        try:
            if i in together:
                binners[i].finish(points[binners[i].n_bins, m.field])
            else:
                binners[i].fit(ref, m.field)
        except TransformError:
            return i, None
        return i, binners[i]

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return dict(pool.map(fit, measures))


def _psi(ref: DataFrame, cur: DataFrame, keys: list[str], measures: list) -> DataFrame:
    bins, sizes, usable = {}, {}, {}
    fitted = _fitted(ref, [(i, m) for i, m in measures if m.binner is not None])
    for i, m in measures:
        if m.binner is None:
            bins[i] = F.col(m.field).cast("string")
        elif fitted[i] is None:  # nothing in the reference to learn from
            bins[i], sizes[i], usable[i] = F.lit(None).cast("string"), 0, False
        else:
            bins[i], sizes[i], usable[i] = fitted[i].transform(F.col(m.field)).cast("string"), len(fitted[i].domain()), True
    parts = []
    for lo in range(0, len(measures), FIELDS_AT_ONCE):  # each reads its own columns; more expressions than that don't compile
        own = [i for i, _ in measures[lo : lo + FIELDS_AT_ONCE]]
        made = [bins[i].alias(f"__b{i}") for i in own]
        both = ref.select(*keys, F.lit(0).alias("__side"), *made).unionByName(cur.select(*keys, F.lit(1).alias("__side"), *made))
        entries = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"__b{i}").alias("b")) for i in own])
        parts.append(both.select(*keys, "__side", F.explode(entries).alias("e")).select(*keys, "__side", "e.f", "e.b"))
    rows = reduce(DataFrame.unionAll, parts)
    dropped = [i for i, m in measures if m.missing == "drop"]
    if dropped:
        rows = rows.filter(~(F.col("f").isin(dropped) & F.col("b").isNull()))
    counted = rows.groupBy(*keys, "f", "b").agg(F.count_if(F.col("__side") == 0).alias("r"), F.count_if(F.col("__side") == 1).alias("c"))

    # one row a field: how many bins there are in all
    seen = counted.groupBy("f").agg((F.count_distinct("b") + F.max(F.col("b").isNull().cast("int"))).alias("seen"), F.max(F.col("b").isNull().cast("int")).alias("lost"))
    fixed = reduce(lambda a, x: a.when(F.col("f") == x[0], F.lit(x[1])), sizes.items(), F.when(F.lit(False), F.lit(0)))
    domain = F.broadcast(seen.select(F.col("f").alias("df"), F.coalesce(fixed + F.col("lost"), F.col("seen")).alias("k")))

    cell = Window.partitionBy(*keys, "f")
    epsilon = reduce(lambda a, x: a.when(F.col("f") == x[0], F.lit(x[1].epsilon)), measures, F.when(F.lit(False), F.lit(0.0)))
    shares = counted.withColumn("r_all", F.sum("r").over(cell)).withColumn("c_all", F.sum("c").over(cell)).withColumn("eps", epsilon)
    p = F.greatest(divide(F.col("r"), F.col("r_all")), F.col("eps"))
    q = F.greatest(divide(F.col("c"), F.col("c_all")), F.col("eps"))
    clipped = shares.withColumn("p", p).withColumn("q", q).withColumn("g", F.ln("q") - F.ln("p"))
    summed = clipped.groupBy(*keys, "f").agg(F.first("r_all").alias("r_cell"), F.first("c_all").alias("c_cell"), F.first("eps").alias("e0"), F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum(F.col("q") * F.col("g")).alias("a"), F.sum(F.col("p") * F.col("g")).alias("b"))
    rest = (F.col("k") - F.col("n")) * F.col("e0")
    value = divide(F.col("a"), F.col("sq") + rest) - divide(F.col("b"), F.col("sp") + rest)
    least = reduce(lambda a, x: a.when(F.col("f") == x[0], F.lit(x[1].min_samples)), measures, F.when(F.lit(False), F.lit(0)))
    ok = (F.col("r_cell") >= least) & (F.col("c_cell") >= least)
    bad = [i for i, good in usable.items() if not good]
    if bad:
        ok = ok & ~F.col("f").isin(bad)
    scored = summed.join(domain, F.col("f") == F.col("df")).select(*keys, "f", F.when(ok, value).alias("v"))
    picks = [F.max(F.when(F.col("f") == i, F.col("v"))).alias(f"__m{i}") for i, _ in measures]
    return scored.groupBy(*keys).agg(*picks) if keys else scored.agg(*picks)


def psi_against_fixed(reference: DataFrame, current: DataFrame, by: list[str], measures: list) -> DataFrame:
    """``by``, a column for each PSI: one pooled reference against every group of ``current``, in one pass.

    Each side is counted once.  Bins that a group lacks need no rows: what they
    add follows from the reference's totals less those of the bins it has.
    """
    bins, sizes = {}, {}
    for i, m in enumerate(measures):
        bins[i] = F.col(m.field).cast("string")
        if m.binner is not None:
            binner = copy.deepcopy(m.binner)
            binner.fit(reference, m.field)
            bins[i], sizes[i] = binner.transform(F.col(m.field)).cast("string"), len(binner.domain())
    entries = F.array(*[F.struct(F.lit(i).alias("f"), c.alias("b")) for i, c in bins.items()])
    dropped = [i for i, m in enumerate(measures) if m.missing == "drop"]

    def counted(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.f", "e.b")
        return (rows.filter(~(F.col("f").isin(dropped) & F.col("b").isNull())) if dropped else rows).groupBy(*keys, "f", "b").agg(F.count(F.lit(1)).alias("n"))

    eps = reduce(lambda a, x: a.when(F.col("f") == x[0], F.lit(x[1].epsilon)), enumerate(measures), F.when(F.lit(False), F.lit(0.0)))
    least = reduce(lambda a, x: a.when(F.col("f") == x[0], F.lit(x[1].min_samples)), enumerate(measures), F.when(F.lit(False), F.lit(0)))
    ref = counted(reference, []).withColumn("r_all", F.sum("n").over(Window.partitionBy("f")))
    ref = ref.select(F.col("f").alias("rf"), F.col("b").alias("rb"), "r_all", F.greatest(F.col("n") / F.col("r_all"), eps).alias("p"))
    cur = counted(current, by).withColumn("c_all", F.sum("n").over(Window.partitionBy(*by, "f")))
    cur = cur.withColumn("q", F.greatest(F.col("n") / F.col("c_all"), eps)).withColumn("eps", eps)
    met = cur.join(ref, (F.col("f") == F.col("rf")) & F.col("b").eqNullSafe(F.col("rb")), "left")
    extra = met.filter("rf is null").groupBy("f").agg((F.count_distinct("b") + F.max(F.col("b").isNull().cast("int"))).alias("extra"))
    fixed = reduce(lambda a, x: a.when(F.col("rf") == x[0], F.lit(x[1])), sizes.items(), F.when(F.lit(False), F.lit(0)))
    totals = ref.groupBy("rf").agg(F.sum("p").alias("tp"), F.sum(F.ln("p")).alias("tl"), F.sum(F.col("p") * F.ln("p")).alias("tpl"), F.count(F.lit(1)).alias("tn"), F.max("r_all").alias("r_cell"), F.max(F.col("rb").isNull().cast("int")).alias("lost"))
    # a row for each field
    totals = totals.join(extra, F.col("rf") == F.col("f"), "left").select("rf", "tp", "tl", "tpl", "tn", "r_cell", F.coalesce(F.greatest(fixed + F.col("lost"), F.col("tn") + F.coalesce("extra", F.lit(0))), F.col("tn") + F.coalesce("extra", F.lit(0))).alias("k")).withColumnRenamed("rf", "tf")
    known, p = F.col("rf").isNotNull(), F.coalesce("p", "eps")
    g = F.ln("q") - F.ln(p)
    summed = met.groupBy(*by, "f").agg(
        F.max("c_all").alias("c_cell"), F.first("eps").alias("e0"), F.count(F.lit(1)).alias("n"), F.sum("q").alias("sq"), F.sum(F.col("q") * g).alias("a"), F.sum(p * g).alias("b0"),
        F.count_if(known).alias("hn"), F.sum(F.when(known, F.col("p")).otherwise(0.0)).alias("hp"), F.sum(F.when(known, F.ln("p")).otherwise(0.0)).alias("hl"), F.sum(F.when(known, F.col("p") * F.ln("p")).otherwise(0.0)).alias("hpl"),
    )
    all_ = summed.join(F.broadcast(totals), F.col("f") == F.col("tf"))
    log_e, gone = F.ln("e0"), F.col("tn") - F.col("hn")
    a = F.col("a") + F.col("e0") * (gone * log_e - (F.col("tl") - F.col("hl")))
    b = F.col("b0") + log_e * (F.col("tp") - F.col("hp")) - (F.col("tpl") - F.col("hpl"))
    value = a / (F.col("sq") + (F.col("k") - F.col("n")) * F.col("e0")) - b / (F.col("tp") + (F.col("k") - F.col("tn")) * F.col("e0"))
    scored = all_.select(*by, "f", F.when((F.col("r_cell") >= least) & (F.col("c_cell") >= least), value).alias("v"))
    return scored.groupBy(*by).agg(*[F.max(F.when(F.col("f") == i, F.col("v"))).alias(m.name) for i, m in enumerate(measures)])
