"""Checks, steps, workflows, declarations, registry and streams."""

import ast
import datetime
import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyframe import Count, Share, Sum
from tallyframe.errors import ArtifactError, CompatibilityError, CubeError, DataPrepError, DataQualityError, DataWorkflowError, ExperimentError, NotFittedError, PlanError, RunError
from tallyframe.operators import prep, quality
from tallyframe.operators.quality import CheckStatus
from tallyframe.plans import modelplan as mp
from tallyframe.plans.workflow import DataWorkflow, PrepStage, QualityStage
from tallyframe.sources.registry import Registry, importance_ranks
from tallyframe.sources.tables import read, write
from tallyframe.streaming.cubes import windowed_cube

NAN = float("nan")


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame([(i, float(i % 10), "ab"[i % 2], " NULL " if i == 3 else str(i)) for i in range(100)], "id long, x double, c string, t string")


@pytest.fixture(scope="module")
def bad(spark):
    rows = [(i, None if i < 30 else NAN if i < 40 else 1e9, "abc"[i % 3], "1d" if i % 2 else "2") for i in range(100)] + [(5, 1.0, "a", "3")]
    return spark.createDataFrame(rows, "id long, x double, c string, t string")


def status(check, reference, current):
    return quality.DataQuality([check]).fit(reference).validate(current).results[0].status


def test_each_check_passes_and_fails(spark, ref, bad):
    cases = [
        (quality.RowCountCheck(min_rows=50), quality.RowCountCheck(min_rows=500)),
        (quality.MissingRateCheck(["x"], max_rate=0.5), quality.MissingRateCheck(["x"], fail_delta=0.1)),
        (quality.UniqueCheck(["id", "x"]), quality.UniqueCheck("id")),
        (quality.CategorySetCheck("c", check_new=False), quality.CategorySetCheck("c")),
        (quality.CardinalityCheck(["c"], fail_change=0.6), quality.CardinalityCheck(["c"], fail_change=0.4)),
        (quality.ConstantCheck(["c"]), quality.ConstantCheck(["x"], 0.4)),
        (quality.NumericConvertibleCheck(["t"], 0.4), quality.NumericConvertibleCheck(["t"])),
        (quality.FiniteCheck(["x"]), quality.FiniteCheck(["x"], allow_nan=False)),
        (quality.RangeCheck("x", 0), quality.RangeCheck("x", 0, 10)),
        (quality.MissingLikeCheck(["c"]), quality.MissingLikeCheck(["c"], ["A"])),
        (quality.SchemaCheck(), quality.SchemaCheck(dtypes={"id": "int"})),
    ]
    passing, failing = [a for a, _ in cases], [b for _, b in cases]
    assert {r.status for r in quality.DataQuality(passing).fit(ref).validate(bad).results} == {CheckStatus.PASS}
    report = quality.DataQuality(failing).fit(ref).validate(bad)
    assert {r.check: r.status for r in report.results if r.status is not CheckStatus.FAIL} == {}
    assert report.status is CheckStatus.FAIL and len(report.failures) == len(cases) and report.to_frame(spark).count() == len(cases)
    assert status(quality.MissingLikeCheck(["t"]), ref, ref) is CheckStatus.FAIL
    assert status(quality.RowCountCheck(warn_relative_change=0.001, fail_relative_change=0.5), ref, bad) is CheckStatus.WARN


def test_empty_current_is_skipped(ref):
    none = ref.limit(0)
    for check in (quality.MissingRateCheck(["x"]), quality.RangeCheck("x", 0), quality.NumericConvertibleCheck(["t"]), quality.ConstantCheck(["c"]), quality.MissingLikeCheck(["c"])):
        assert status(check, ref, none) is CheckStatus.SKIP
    with pytest.raises(NotFittedError):
        quality.DataQuality([quality.RangeCheck("x", 0)]).validate(ref)
    with pytest.raises(DataQualityError):
        quality.DataQuality([quality.RangeCheck("nowhere", 0)]).fit(ref)


def test_relative_change_from_zero():
    assert quality.relative(0, 0) == 0 and math.isinf(quality.relative(1, 0))


def test_profile(ref, bad):
    x = quality.DataProfile.from_frame(ref).columns["x"]
    assert (x["count"], x["missing"], x["nunique"], x["zero_count"], x["q50"], x["mean"]) == (100, 0, 10, 10, 4.5, 4.5)
    y = quality.DataProfile.from_frame(bad).columns
    assert y["x"]["missing"] == 40 and y["c"]["top_values"][0] == ("a", 35)
    one = quality.DataProfile.from_frame(ref.limit(1)).columns["x"]
    assert one["std"] is None


def test_conversions(spark):
    df = spark.createDataFrame([(" 12 ",), ("1e3",), ("nan",), ("1f",), (None,), (".5",), ("-inf",)], "t string")
    assert [r[0] for r in prep.ToNumeric("t", "coerce").transform(df).collect()] == [12.0, 1000.0, None, None, None, 0.5, -math.inf]
    with pytest.raises(Exception, match="not numeric"):
        prep.ToNumeric("t").transform(df).collect()
    dates = spark.createDataFrame([("2024-02-03 at 04h",), ("x",), (None,)], "d string")
    got = prep.ToDatetime("d", "coerce", "%Y-%m-%d at %Hh").transform(dates).collect()
    assert [r[0] for r in got] == [datetime.datetime(2024, 2, 3, 4), None, None]
    with pytest.raises(DataPrepError):
        prep.ToDatetime("d", format="%Q").transform(dates)


def test_stateless_steps(spark):
    df = spark.createDataFrame([(1, 0.0), (50, 0.5), (None, None)], "i int, p double")
    out = prep.Clip("i", 10, 40).transform(df)
    assert dict(out.dtypes)["i"] == "int" and [r.i for r in out.collect()] == [10, 40, None]
    assert [r.i for r in prep.Clip("i", 1.5).transform(df).collect()] == [1.5, 50.0, None]
    logit = [r.p for r in prep.LogitTransform("p", eps=0.1).transform(df).collect()]
    assert logit[0] == pytest.approx(math.log(0.1 / 0.9)) and logit[1:] == [0.0, None]
    with pytest.raises(Exception, match="positive"):
        prep.LogTransform("p").transform(df).collect()
    with pytest.raises(Exception, match="no mapping"):
        prep.ValueMapper("i", {1: "one"}).transform(df).collect()
    kept = prep.ValueMapper("i", {1: "one"}, "keep").transform(df).collect()
    assert [r.i for r in kept] == ["one", "50", None]
    with pytest.raises(DataPrepError):
        prep.Clip("t").transform(spark.createDataFrame([("a",)], "t string"))


def test_imputer(spark):
    df = spark.createDataFrame([(1.0, "b", None), (NAN, None, None), (3.0, "a", None)], "x double, c string, e double")
    for strategy, x, c in (("median", 2.0, None), ("mean", 2.0, None), ("most_frequent", 1.0, "a")):
        step = prep.MissingImputer(["x", "e"] if c is None else ["x", "c"], strategy, add_indicator=True)
        row = step.fit_transform(df).collect()[1]
        assert row.x == x and row.x_missing == 1 and (row.e == 0.0 if c is None else row.c == c)
    out = prep.MissingImputer("x", "mean", output="append").fit_transform(df)
    assert "x_imputed" in out.columns and dict(out.dtypes)["x"] == "double"


def test_kbins_and_woe(spark):
    df = spark.createDataFrame([(float(i), int(i > 60 or i % 7 == 0)) for i in range(1, 101)], "x double, y int")
    assert prep.KBins("x", 4).fit(df).state["x"] == [1.0, 25.5, 50.5, 75.5, 100.0]
    groups = spark.createDataFrame([(v + d,) for v in (0.0, 50.0, 100.0) for d in (0.0, 0.1, 0.2)], "x double")
    codes = [r.x for r in prep.KBins("x", 3, "kmeans").fit_transform(groups).collect()]
    assert codes == [0] * 3 + [1] * 3 + [2] * 3
    woe = prep.WoeBinning("x", "y", max_n_prebins=10, output_column="w").fit(df)
    rates = [r["event_rate"] for r in woe.state["table"]]
    assert rates == sorted(rates) and woe.iv > 0.5
    assert {r.w for r in woe.transform(df).collect()} == {r["woe"] for r in woe.state["table"]}


def test_unknown_categories(spark):
    train, later = spark.createDataFrame([("b",), ("a",), (None,)], "c string"), spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [tuple(r) for r in prep.OneHotEncoder("c", "replace").fit(train).transform(later).collect()] == [(1, 0), (0, 0), (0, 0)]
    assert [r.c for r in prep.OrdinalEncoder("c").fit(train).transform(later).collect()] == [0, -1, None]
    assert sorted(r.c for r in prep.VocabularyEncoder("c").fit(train).transform(later).collect()) == [0, 0, 1]


def test_prep_lifecycle_and_artifacts(spark, ref, tmp_path):
    flow = prep.DataPrep([prep.Clip("x", upper=5), prep.StandardScaler("x"), prep.KBins("x", 3, "uniform", output="append")])
    with pytest.raises(NotFittedError):
        flow.transform(ref)
    want = flow.fit(ref).transform(ref).collect()
    path = str(tmp_path / "prep.json")
    flow.save(path)
    assert prep.DataPrep.load(path).transform(ref).collect() == want
    assert json.loads(Path(path).read_text())["version"] == 1
    with pytest.raises(DataPrepError):
        flow.transform(ref.drop("t"))
    Path(path).write_text("{}")
    with pytest.raises(ArtifactError):
        prep.DataPrep.load(path)
    result = flow.run(ref)
    assert result.audits[0].details["x.clipped"] == 40 and result.to_frame().count() == 3


def test_workflow(spark, ref, bad):
    def build(on_fail):
        return DataWorkflow([QualityStage("gate", quality.DataQuality([quality.MissingRateCheck(["x"], max_rate=0.1)]), on_fail), PrepStage("prep", prep.DataPrep([prep.MissingImputer("x")])), QualityStage("after", quality.DataQuality([quality.FiniteCheck(["x"], False)]))])

    with pytest.raises(DataWorkflowError):
        build("raise").fit(ref).run(bad)
    with pytest.warns(RuntimeWarning):
        build("warn").fit(ref).run(bad)
    result = build("continue").fit(ref).run(bad)
    assert result.data.count() == bad.count() and set(result.quality_reports) == {"gate", "after"} and list(result.prep_audits) == ["prep"]
    assert not result.quality_reports["gate"].passed and result.summary()[2][2] == "PASS"


def test_declarations(ref):
    plan = mp.ModelPlan(mp.binary_classification(), mp.gradient_boosting())
    assert plan.objectives == ("log_loss",) and plan.to_dict()["roles"] == ["target"]
    with pytest.raises(CompatibilityError):
        mp.ModelPlan(mp.survival(), mp.gradient_boosting())
    with pytest.raises(PlanError, match="not bound.*nowhere"):
        mp.DataPlan(mp.RoleSpec(weight="x"), mp.FeatureSpec(("nowhere",))).validate_against(plan, ref)
    mp.DataPlan(mp.RoleSpec(target="c", sample_key=["id", "t"]), mp.FeatureSpec(("x",))).validate_against(plan, ref)
    for wrong in (lambda: mp.RoleSpec(target=["a", "b"]), lambda: mp.FeatureSpec(("a",), ("a",)), lambda: mp.SplitSpec(mp.HashSplitter(("id",)), {"train": mp.PartitionSpec(0.5)}), lambda: mp.PartitionSpec()):
        with pytest.raises(PlanError):
            wrong()


def test_splits(spark, ref):
    three = {"train": mp.PartitionSpec(0.5), "valid": mp.PartitionSpec(0.25), "test": mp.PartitionSpec(0.25)}
    a = mp.SplitSpec(mp.HashSplitter(("id",)), three).assign(ref)
    assert sorted(a.collect()) == sorted(mp.SplitSpec(mp.HashSplitter(("id",)), three).assign(ref.repartition(7)).collect())
    by = mp.SplitSpec(mp.RandomSplitter(stratify="c"), three).assign(ref).groupBy("c", "partition").count().collect()
    assert {r.partition: r["count"] for r in by if r.c == "a"} == {"train": 25, "valid": 13, "test": 12}
    timed = mp.SplitSpec(mp.TimeSplitter("x"), three).assign(ref)
    assert timed.filter("partition = 'train'").agg(F.max("x")).first()[0] < timed.filter("partition = 'test'").agg(F.min("x")).first()[0]


def test_registry(spark, tmp_path):
    registry = Registry(tmp_path)
    with registry.start_run("one", label="best", config={"a": {"b": 1}}) as run:
        run.log_metrics({"test": {"auc": 0.5}})
        run.log_json("notes", {"k": 1})
        with pytest.raises(RunError):
            run.log_metrics({"test": {"auc": 0.6}})
    with pytest.raises(ZeroDivisionError), registry.start_run("two", config={"a": {"b": 2}, "c": 3}):
        1 / 0
    with pytest.raises(RunError):
        run.log_params({})
    assert [(r.name, r.status) for r in registry.runs(spark).collect()] == [("one", "completed"), ("two", "failed")]
    assert registry.runs(spark, "failed").count() == 1 and registry.read_json("best", "notes") == {"k": 1}
    assert [r["test.auc"] for r in registry.compare(spark).orderBy("run_id").collect()] == [0.5, None]
    assert {r.key: r.change for r in registry.compare_params(spark, "one", "two").collect()} == {"a.b": "modified", "c": "added"}
    registry.verify("best")
    (tmp_path / "runs" / run.run_id / "artifacts" / "notes.json").write_text("0")
    with pytest.raises(RunError):
        registry.verify("best")
    with registry.start_run("one"):
        pass
    with pytest.raises(ExperimentError):
        registry.resolve("one")


def test_stream_equals_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(base + datetime.timedelta(minutes=i), "ab"[i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    write(df, str(tmp_path / "in.parquet"))
    measures = [Count(), Sum("v", "total")]
    stream = windowed_cube(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in.parquet")), "ts", "10 minutes", ["k"], measures)
    job = stream.writeStream.outputMode("complete").format("memory").queryName("cells").start()
    job.processAllAvailable()
    job.stop()
    batch = windowed_cube(read(spark, str(tmp_path), "in"), "ts", "10 minutes", ["k"], measures)
    assert sorted(spark.table("cells").collect()) == sorted(batch.collect()) and batch.count() == 12
    with pytest.raises(CubeError):
        windowed_cube(df, "ts", "1 hour", [], [Share()])


def test_importance_ranks_order_no_column_in_one_task(spark):
    values = [None, NAN, NAN, math.inf, -math.inf, 0.0, -0.0, 1e-310, -2.5, 7.0, 7.0, None, *[float(i % 37) for i in range(300)]]
    df = spark.createDataFrame([(i, v, i % 5) for i, v in enumerate(values)], "id long, gain double, split int").repartition(4)
    out = importance_ranks(df)
    assert out.columns == ["id", "gain", "split", "gain_rank", "split_rank"]
    place = [(0,) if v is None else (2,) if math.isnan(v) else (1, v) for v in values]
    want = {i: (1 + sum(p > q for p in place), 1 + sum(j % 5 > i % 5 for j in range(len(values)))) for i, q in enumerate(place)}
    assert {r.id: (r.gain_rank, r.split_rank) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(__b" in plan and not any(f"windowspecdefinition({c}#" in plan for c in ("gain", "split", "__v"))


def test_importance_ranks_cover_every_part(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("needs the sample tables")
    got = entry.queries()["importance_ranks"](spark, folder)
    assert got.count() == read(spark, folder, "part").count() > 199


def test_only_the_entry_knows_the_corpus_package():
    root = Path(__file__).resolve().parent.parent / "tallyframe"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
