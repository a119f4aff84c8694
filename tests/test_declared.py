"""Supervised bins, transformer steps, fixed-reference comparison, method spaces."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe import PSI, Col, Count, Cube, Funnel, QuantileBinner, Stage
from tallyframe.errors import DataPrepError, DataQualityError, ExperimentError, LayoutError
from tallyframe.functions.quantiles import grouped_quantiles
from tallyframe.operators import prep, quality, supervised
from tallyframe.operators.rank import psi_from_proportions
from tallyframe.plans.comparison import psi_against_fixed
from tallyframe.plans.modelplan import PartitionSpec, RandomSplitter, SplitSpec
from tallyframe.sources import methods
from tallyframe.sources.tables import read_csv, write_csv


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(float(i), "abcde"[i % 5] if i % 11 else None, int((i * 7919) % 100 < (80 - i // 10) * (1 if i % 5 else 0.3))) for i in range(600)]
    rows += [(None, "a", 1), (-1.0, "b", 0), (float("nan"), "c", 1)]
    return spark.createDataFrame(rows, "x double, k string, t int")


def test_opt_binning_bounds_and_order(spark, scored):
    step = supervised.OptBinning("x", "t", max_n_bins=3, max_pvalue=0.05, special_codes=[-1], metric="event_rate").fit(scored)
    table = [r for r in step.state["x"] if r["kind"] == "bin"]
    assert 1 < len(table) <= 3 and sum(r["count"] for r in step.state["x"]) == scored.count()
    rates = [r["event_rate"] for r in table]
    assert rates in (sorted(rates), sorted(rates, reverse=True))
    special, lost = step.state["x"][-2:]
    assert (special["count"], lost["count"]) == (1, 2)
    for a, b in zip(table[:-1], table[1:], strict=True):
        assert supervised.two_sample_p((a["event"], a["non_event"]), (b["event"], b["non_event"])) <= 0.05
    summary = step.summary(spark).first()
    assert summary.n_bins == len(table) and summary.iv == pytest.approx(sum(r["iv"] for r in step.state["x"]))


def test_opt_binning_categories(spark, scored):
    step = supervised.OptBinning(["k", "x"], "t", ["k"], "indices", min_bin_size=0.0, monotonic=False, metric_missing="empirical", output_columns=["kk", "xx"], output="append").fit(scored)
    values = [v for r in step.state["k"] if r["kind"] == "bin" for v in r["values"]]
    assert sorted(values) == list("abcde")
    out = step.transform(scored.unionByName(spark.createDataFrame([(5.0, "new", 1)], scored.schema)))
    assert {r.kk for r in out.filter("k = 'new'").collect()} == {-3} and {r.kk for r in out.filter("k is null").collect()} == {-1}
    with pytest.raises(DataPrepError):
        supervised.OptBinning("k", "t", ["k"], max_categories=2, max_n_prebins=1).fit(scored)


def test_transformer_step_names_and_merges(spark, scored):
    class Double:
        def fit(self, df):
            return self

        def transform(self, df):
            return df.withColumn("x2", F.col("x") * 2)

    assert supervised.TransformerStep(Double(), "x").fit_transform(scored).columns == ["x", "k", "t", "x2"]
    swapped = supervised.TransformerStep(Double(), "x", "replace").fit_transform(scored)
    assert swapped.columns == ["x", "k", "t"] and swapped.agg(F.max("x")).first()[0] is not None
    assert supervised.TransformerStep(Double(), "x", "replace", ["z"]).fit_transform(scored).columns == ["k", "t", "z"]
    for bad in (["a", "b"], ["t"]):
        with pytest.raises(DataPrepError):
            supervised.TransformerStep(Double(), "x", output_columns=bad).fit_transform(scored)


def test_fixed_reference_matches_the_formula(spark):
    ref = spark.createDataFrame([(c,) for c in "aaaabbc"] + [(None,)], "k string")
    cur = spark.createDataFrame([(1, c) for c in "aabd"] + [(2, c) for c in "ccc"] + [(2, None)], "day int, k string")
    bins = ["a", "b", "c", "d", None]

    def shares(values):
        return [values.count(b) / len(values) for b in bins]

    want = {1: psi_from_proportions(shares(list("aaaabbc") + [None]), shares(list("aabd"))), 2: psi_from_proportions(shares(list("aaaabbc") + [None]), shares([*"ccc", None]))}
    got = psi_against_fixed(ref, cur, ["day"], [PSI("k", None, name="psi", missing="bucket")])
    assert {r.day: r.psi for r in got.collect()} == pytest.approx(want)


def test_funnel_counts_plain_names(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, None)], "a int, b int")
    got = Cube([], [Funnel(["a", "b"], "count")]).compute(df).pivoted().first()
    assert (got.a_count, got.b_count, got.a_to_b_rate) == (2.0, 1.0, 0.5)
    assert Funnel([Stage("a", where=Col("a") > 0), "b"], "count").measures()[1].name == "b_count"


def test_imputer_and_bins_options(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(-9.0,), (None,)], "x double")
    step = prep.MissingImputer("x", lambda c: F.min(c) - 1, missing_values=-9.0)
    assert [r.x for r in step.fit_transform(df).filter("x < 0").collect()] == [-1.0, -1.0]
    few = prep.KBins("x", 4, subsample=40, random_state=3).fit(df.filter("x >= 0"))
    again = prep.KBins("x", 4, subsample=40, random_state=3).fit(df.filter("x >= 0"))
    assert few.state == again.state and few.state["x"] != prep.KBins("x", 4).fit(df.filter("x >= 0")).state["x"]
    tail = spark.createDataFrame([(x,) for x in (1.0, 1.1, 1.2, 5.0, 5.1, 1e6)], "x double")
    edges = prep.KBins("x", 2, "kmeans").fit(tail).state["x"]
    assert 5.1 < edges[1] < 1e6


def test_explain_as_text():
    cube = Cube(["a"], [Count()])
    assert len(cube.explain(format="text").splitlines()) == len(cube.explain())
    with pytest.raises(ValueError):
        cube.explain(format="html")


def test_method_spaces(spark, tmp_path):
    space = methods.initialize(tmp_path, "boosting", family="trees", baseline={"rate": 0.1}, comparison_partitions=["test"])
    assert space.reports_dir.is_dir() and space.baseline() == {"rate": 0.1}
    (space.config_dir / "baseline.yaml").write_text("rate: 0.3\n")
    assert methods.initialize(tmp_path, "boosting").baseline() == {"rate": 0.3}
    with space.start_run("one", config={"loss": math.sqrt, "n": 3}, task={"metric": max}) as run:
        run.log_metrics({"train": {"auc": 0.9}, "test": {"auc": 0.8}})
    opened = methods.open_method(tmp_path, "boosting")
    assert opened.compare(spark).columns == ["run_id", "name", "label", "status", "test.auc"]
    record = opened.resolve("one")
    assert record["model"]["family"] == "trees" and record["config"]["loss"]["name"] == "math.sqrt"
    (opened.root / "method.json").write_text("[]")
    with pytest.raises(ExperimentError):
        methods.open_method(tmp_path, "boosting")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.5), ('"q"', None)], "name string, gain double")
    write_csv(df, str(tmp_path / "i.csv"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "i.csv"), "name string, gain double").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_callable_identity_follows_the_source():
    def one(x):
        return x

    def two(x):
        return x + 1

    assert methods.callable_identity(one)["sha256"] != methods.callable_identity(two)["sha256"]
    assert QuantileBinner(2).probabilities() == [0.0, 0.5, 1.0]


def test_grouped_quantiles_by_slices_equal_direct_ones(spark):
    rows = [(g, None if i % 17 == 0 else float((i * 37) % 101) - 50) for g in ("a", "b", None) for i in range(200)] + [("void", None), ("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    p = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    direct, sliced = grouped_quantiles(df, "x", ["g"], p), grouped_quantiles(df, "x", ["g"], p, direct_rows=0)
    assert direct.keys() == sliced.keys() and sliced[("void",)] is None
    for key, points in direct.items():
        assert points is None or sliced[key] == pytest.approx(list(points))


def test_vocabulary_as_a_table(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", None, "B", "z"]], "w string").repartition(3)
    small = prep.VocabularyEncoder("w", "code").fit(df)
    monkeypatch.setattr(prep.VocabularyEncoder, "BROADCAST", 2)
    with pytest.raises(DataPrepError):
        prep.VocabularyEncoder("w", "code").fit(df)
    large = prep.VocabularyEncoder("w", "code", table=str(tmp_path / "v")).fit(df)
    assert large.state["size"] == 5
    assert sorted(map(tuple, large.transform(df).collect()), key=str) == sorted(map(tuple, small.transform(df).collect()), key=str)


def test_categories_are_bounded(spark, monkeypatch):
    df = spark.range(20).withColumn("k", F.col("id").cast("string"))
    monkeypatch.setattr(prep, "MAX_CATEGORIES", 10)
    monkeypatch.setattr(quality, "MAX_CATEGORIES", 10)
    with pytest.raises(DataPrepError):
        prep.OneHotEncoder("k").fit(df)
    with pytest.raises(DataQualityError):
        quality.DataQuality([quality.CategorySetCheck("k")]).fit(df)
    with pytest.raises(LayoutError):
        Cube(["k"], [Count()]).compute(df).layout(["k"], ["metric"], max_cells=5)


def test_stratified_split_orders_no_stratum_in_one_task(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 900, F.lit("big")).when(F.col("id") < 990, F.lit("small")))
    spec = SplitSpec(RandomSplitter(stratify="s"), {"train": PartitionSpec(0.7), "test": PartitionSpec(0.3)})
    out = spec.assign(df)
    assert out.columns == ["id", "s", "partition"]
    assert {(r.s, r.partition): r["count"] for r in out.groupBy("s", "partition").count().collect()} == {("big", "train"): 630, ("big", "test"): 270, ("small", "train"): 63, ("small", "test"): 27, (None, "train"): 7, (None, "test"): 3}
    assert "windowspecdefinition(s" not in out._jdf.queryExecution().optimizedPlan().toString()
