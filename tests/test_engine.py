"""Golden values, brute force, metamorphic properties, policies and plan shapes."""

import itertools
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe import AUC, KS, PSI, BinDimension, Col, ColumnDimension, ComputePolicy, Count, Cube, EqualWidthBinner, EventRate, FixedBinner, Funnel, MissingPolicy, QuantileBinner, Ratio, Share, Stage, Sum, Transition
from tallyframe.errors import CubeError, DimensionError, EngineError, InvalidMetricError, LayoutError, MeasureError, NotFittedError, TransformError
from tallyframe.functions.quantiles import exact_quantiles
from tallyframe.operators.binning import interval_labels
from tallyframe.operators.rank import auc_score, event_rate, ks_score, psi_from_proportions

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    rows = [(["a", "b", "c", None][rng.integers(4)], int(rng.integers(0, 2)), float(rng.integers(0, 30)) / 10 - 1, float(rng.integers(0, 4))) for _ in range(600)]
    rows += [("a", None, 1.0, 1.0), ("a", 1, None, 1.0), ("a", 1, NAN, 1.0), ("b", 0, INF, 2.0)]
    return frame(spark, rows, "g string, y int, s double, w double").cache()


def brute_auc(rows):
    pos, neg = [(s, w) for y, s, w in rows if y == 1], [(s, w) for y, s, w in rows if y == 0]
    top = sum(a * b * (1.0 if s > t else 0.5 if s == t else 0.0) for (s, a), (t, b) in itertools.product(pos, neg))
    return top / (sum(w for _, w in pos) * sum(w for _, w in neg))


def brute_ks(rows):
    p, n = sum(w for y, _, w in rows if y == 1), sum(w for y, _, w in rows if y == 0)
    return max(abs(sum(w for y, s, w in rows if y == 1 and s <= t) / p - sum(w for y, s, w in rows if y == 0 and s <= t) / n) for t in {s for _, s, _ in rows})


def clean(rows):
    return [(r.y, r.s, r.w) for r in rows if r.y is not None and r.s is not None and math.isfinite(r.s) and r.w > 0]


def test_rank_statistics_equal_brute_force(scored):
    result = Cube(["g"], [AUC("s", "y", "w", "auc"), KS("s", "y", "w", "ks")], policy=ComputePolicy(MissingPolicy("keep"))).compute(scored, totals=True)
    rows = scored.collect()
    for r in result.pivoted().collect():
        own = clean([x for x in rows if x.g == r.g])
        assert r.auc == pytest.approx(brute_auc(own), abs=1e-12) and r.ks == pytest.approx(brute_ks(own), abs=1e-12)
    total = result.total(["g"]).pivoted().first()
    assert total.auc == pytest.approx(brute_auc(clean(rows)), abs=1e-12)
    assert auc_score(scored, "y", "s", "w") == pytest.approx(total.auc) and ks_score(scored, "y", "s", "w") == pytest.approx(total.ks)


def test_rank_edge_cases(spark):
    df = frame(spark, [("one", 1, 0.5), ("one", 1, 0.7), ("odd", 2, 0.1), ("odd", 1, 0.2), ("odd", 0, 0.1), ("ok", 0, 0.1), ("ok", 1, 0.9)], "g string, y int, s double")
    got = {r.g: r.auc for r in Cube(["g"], [AUC("s", "y", name="auc")]).compute(df).pivoted().collect()}
    assert got == {"one": None, "odd": None, "ok": 1.0}
    assert event_rate(df, "y") == pytest.approx(4 / 7)


def test_predicates_are_three_valued(spark):
    df = frame(spark, [(1.0, "x"), (5.0, None), (None, "x"), (NAN, "y")], "v double, t string")
    v, t = Col("v"), Col("t")
    cases = {v > 2: 1, ~(v > 2): 1, (v > 2) | (t == "x"): 3, (v > 2) & (t == "x"): 0, ~((v > 2) & (t == "x")): 2, v.isna(): 2, v.notna() & t.isna(): 1, v.isin([1.0, 9.0]): 1, ~v.isin([]): 2, v != 1.0: 1}
    names = [f"c{i}" for i in range(len(cases))]
    row = Cube([], [Count(n, where=p) for n, p in zip(names, cases, strict=True)]).compute(df).pivoted().first()
    assert [row[n] for n in names] == list(map(float, cases.values()))
    with pytest.raises(TypeError):
        bool(v > 2)
    with pytest.raises(ValueError):
        v == None  # noqa: B015, E711
    with pytest.raises(TypeError):
        v.isin("abc")


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.repeat(0.5, 500)])
    df = frame(spark, [(float(x),) for x in values] + [(None,), (NAN,), (INF,)], "x double")
    ps = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    want = np.quantile(values, ps)
    assert exact_quantiles(df, "x", ps) == pytest.approx(want)
    assert exact_quantiles(df, "x", ps, direct_rows=0) == pytest.approx(want)
    assert exact_quantiles(df.filter("x is null"), "x", ps) is None


def test_bin_assignment_golden(spark):
    df = frame(spark, [(x,) for x in (-INF, -1.0, 0.0, 1.0, 1.5, 2.0, 3.0, INF, NAN, None)], "x double")
    fixed = BinDimension("x", FixedBinner([0, 1, 2]), "b")
    got = [r[0] for r in fixed.attach(df, "b").select("b").collect()]
    assert got == [None, None, "B1", "B1", "B2", "B2", None, None, None, None]
    left_open = BinDimension("x", FixedBinner([0, 1, 2], include_lowest=False), "b")
    assert [r[0] for r in left_open.attach(df, "b").select("b").collect()][2] is None
    assert interval_labels([0, 1, 2]) == ["[0, 1]", "(1, 2]"] and interval_labels([-INF, 0.5, INF]) == ["(-inf, 0.5]", "(0.5, inf]"]
    assert len(set(interval_labels([1.0000001, 1.0000002, 1.0000003]))) == 2


def test_binner_edges(spark):
    df = frame(spark, [(float(x),) for x in range(1, 101)], "x double")
    assert QuantileBinner(4).fit(df, "x").edges_ == [-INF, 25.75, 50.5, 75.25, INF]
    assert EqualWidthBinner(3).fit(df, "x").edges_ == [-INF, 34.0, 67.0, INF]
    constant = df.select(F.lit(3.0).alias("x"))
    assert QuantileBinner(4).fit(constant, "x").edges_ == [-INF, INF] == EqualWidthBinner(3).fit(constant, "x").edges_
    for bad in (lambda: QuantileBinner(4, "raise").fit(constant, "x"), lambda: QuantileBinner(3).fit(df.limit(0), "x"), lambda: FixedBinner([1, 1]), lambda: QuantileBinner(4, labels=["a"]).fit(df, "x"), lambda: QuantileBinner(2, labels=["a", "a"])):
        with pytest.raises(TransformError):
            bad()


def test_stratified_bins_equal_cubes_of_each_stratum(spark, scored):
    df = scored.filter("s is not null and s < 100").fillna({"g": "none"})
    whole = Cube(["g", BinDimension("s", QuantileBinner(3), fit_by="g")], [Count()]).fit_compute(df).pivoted().collect()
    for g in {r.g for r in whole}:
        part = df.filter(F.col("g") == g)
        alone = {r.s_bin: r["count"] for r in Cube([BinDimension("s", QuantileBinner(3))]).fit_compute(part).pivoted().collect()}
        assert {r.s_bin: r["count"] for r in whole if r.g == g} == alone


def test_stratified_bins_null_and_unseen(spark, scored):
    cube = Cube(["g", BinDimension("s", QuantileBinner(2), fit_by="g")], policy=ComputePolicy(MissingPolicy("keep")))
    cube.fit(scored.filter("g is null or g <> 'c'"))
    assert any(r.g is None for r in cube.compute(scored.filter("g is null")).pivoted().collect())
    with pytest.raises(Exception, match="not seen"):
        cube.compute(scored).pivoted().collect()


def test_totals_share_and_empty(spark, scored):
    result = Cube(["g", "y"], [Count(), Share()]).compute(scored, totals=True)
    rows = result.with_totals().filter("metric = 'share'").groupBy("grouping_id").agg(F.sum("value").alias("s")).collect()
    assert len(rows) == 4 and all(r.s == pytest.approx(1) for r in rows)
    nothing = Cube(["g", "y"], [Count(), EventRate("y", name="r")]).compute(scored.limit(0), totals=True).total(["g", "y"]).pivoted().first()
    assert (nothing["count"], nothing.r) == (0.0, None)


def test_sum_policies(spark):
    df = frame(spark, [("a", 1.0), ("a", None), ("b", 2.0), ("c", 1e308), ("c", 1e308)], "g string, x double")
    got = {r.g: (r.p, r.z) for r in Cube(["g"], [Sum("x", "p"), Sum("x", "z", "zero")]).compute(df).pivoted().collect()}
    assert got == {"a": (None, 1.0), "b": (2.0, 2.0), "c": (None, None)}
    with pytest.raises(Exception, match="infinite"):
        Cube([], [Sum("x")]).compute(frame(spark, [(INF,)], "x double")).pivoted().collect()
    assert Cube([], [Sum("x", "s", where=Col("x") < 5)]).compute(frame(spark, [(INF,), (1.0,)], "x double")).pivoted().first().s == 1.0
    with pytest.raises(Exception, match="weight"):
        Cube([], [EventRate("y", weight="w", name="r")]).compute(frame(spark, [(1, -1.0)], "y int, w double")).pivoted().collect()


def test_on_invalid(spark):
    df = frame(spark, [("a", 1.0), ("a", None)], "g string, x double")
    with pytest.raises(InvalidMetricError):
        Cube(["g"], [Sum("x")], policy=ComputePolicy(on_invalid="raise")).compute(df)
    with pytest.warns(RuntimeWarning):
        Cube(["g"], [Sum("x")], policy=ComputePolicy(on_invalid="warn")).compute(df)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        Cube(["g"], [Sum("x")]).compute(df)


def test_errors(spark, scored):
    for wrong, bad in (
        (CubeError, lambda: Cube("g")),
        (DimensionError, lambda: Cube(["g", "g"])),
        (DimensionError, lambda: Cube(["metric"])),
        (DimensionError, lambda: Cube([BinDimension("s", QuantileBinner(2), fit_by="g")])),
        (MeasureError, lambda: Cube([], [])),
        (MeasureError, lambda: Cube([], [Count(), PSI("s")])),
        (MeasureError, lambda: Cube([], [Ratio("a", "b", "c")]).compute(scored)),
        (MeasureError, lambda: Cube([], [Ratio("b", "b", "a"), Ratio("a", "a", "b")]).compute(scored)),
        (MeasureError, lambda: Cube([], [Count(), Count()]).compute(scored)),
        (EngineError, lambda: Cube(["nowhere"]).compute(scored)),
        (EngineError, lambda: Cube(list("abcdefg")).compute(scored, totals=True)),
        (NotFittedError, lambda: Cube([BinDimension("s", QuantileBinner(2))]).compute(scored)),
        (CubeError, lambda: Cube(["g"]).compute(scored).total(["g"])),
        (CubeError, lambda: Cube(["g"]).compute_comparison(scored, scored)),
        (MeasureError, lambda: Funnel([Stage("a"), Stage("b")], rates=[Transition("b", "a")]).measures()),
        (MeasureError, lambda: Funnel([Stage("a"), Stage("a")]).measures()),
    ):
        with pytest.raises(wrong):
            bad()


def test_refit_is_all_or_nothing(spark, scored):
    cube = Cube([BinDimension("s", QuantileBinner(2)), BinDimension("s", QuantileBinner(2, "raise"), "v")]).fit(scored.filter("s < 100"))
    before = cube.dimensions_
    with pytest.raises(TransformError):
        cube.fit(scored.withColumn("s", F.lit(1.0)))
    assert cube.dimensions_ is before


def test_layout(spark, scored):
    df = scored.filter("g is not null and y is not null")
    result = Cube(["g", ColumnDimension("y", categories=[0, 1, 2])], [Count(), EventRate("w", 1.0, name="r")]).compute(df, totals=True)
    table = result.layout(["g"], ["y", "metric"], totals=True).orderBy("__order").collect()
    assert [r.g for r in table] == ["a", "b", "c", "Total"] and table[0]["2|count"] == 0.0 and table[0]["2|r"] is None
    assert table[3]["Total|count"] == df.count()
    assert result.layout(["metric", "y"], ["g"]).count() == 6
    for bad in (lambda: result.layout(["g"], ["y"]), lambda: result.layout(max_cells=3), lambda: result.layout(totals=True, total_label="a")):
        with pytest.raises(LayoutError):
            bad()


def test_interval_layout(spark, scored):
    df = scored.filter("g is not null and s < 100")
    cube = Cube(["g", BinDimension("s", QuantileBinner(2), fit_by="g")]).fit(df)
    table = cube.compute(df).layout(["s_bin"], ["g", "metric"], bin_labels="interval").collect()
    assert all(r.s_bin.startswith("(") for r in table) and sum(v or 0 for r in table for v in r[2:]) == df.count()


def psi_brute(ref, cur, epsilon=1e-8):
    domain = sorted(set(ref) | set(cur))
    return psi_from_proportions([ref.count(b) / len(ref) for b in domain], [cur.count(b) / len(cur) for b in domain], epsilon)


@pytest.mark.parametrize("epsilon", [1e-8, 0.01, 2.0])
def test_psi_over_all_bins(spark, epsilon):
    """Bins empty on both sides of a group still count in the renormalisation."""
    rng = np.random.default_rng(2)
    rows = [(int(side), g, "abcdefgh"[rng.integers(*((0, 4) if g == "x" else (2, 8)))]) for side in (0, 1) for g in "xy" for _ in range(50)]
    df = frame(spark, rows, "side int, g string, c string")
    got = {r.g: r.p for r in Cube(["g"], [PSI("c", None, epsilon, "p")]).compute_comparison(df.filter("side = 0"), df.filter("side = 1")).pivoted().collect()}
    domain = sorted({c for _, _, c in rows})
    for g in "xy":
        ref, cur = ([c for s, h, c in rows if s == side and h == g] for side in (0, 1))
        assert got[g] == pytest.approx(psi_from_proportions([ref.count(b) / len(ref) for b in domain], [cur.count(b) / len(cur) for b in domain], epsilon), abs=1e-12)


def test_psi_properties(spark, scored):
    same = Cube([], [PSI("s", name="p")]).compute_comparison(scored, scored).pivoted().first()
    assert same.p == pytest.approx(0, abs=1e-12)
    nothing = Cube([], [PSI("s", name="p")]).compute_comparison(scored.filter("s > 1e9 and s < 0"), scored).pivoted().first()
    assert nothing.p is None
    assert psi_from_proportions([0.5, 0.4], [0.5, 0.5]) is None
    assert psi_from_proportions([1, 0], [0.5, 0.5]) > 1


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_plan_shapes(spark, scored):
    """One shuffle for all additive measures and totals; PSI's don't grow with fields."""
    many = Cube(["g", "y"], [Count(), Sum("w", "a"), EventRate("y", name="b"), Sum("w", "c", where=Col("y") == 1), Ratio("a", "count")])
    assert exchanges(many.compute(scored).data_) == 1
    one = Cube(["g"], [PSI("s", name="p0")]).compute_comparison(scored, scored).data_
    three = Cube(["g"], [PSI("s", name="p0"), PSI("w", name="p1"), PSI("y", None, name="p2")]).compute_comparison(scored, scored).data_
    assert exchanges(one) == exchanges(three)
    assert len(many.plan().aggregates) == len({*many.plan().aggregates})


def test_explain_and_metadata(scored):
    cube = Cube(["g"], [Count(), Share()], [Col("y") == 1])
    assert ("policy", "on invalid", "nan") in cube.explain(totals=True)
    assert cube.compute(scored).metadata_["result_rows"] == 3
