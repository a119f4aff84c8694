"""Registered queries over declarations, reports, records and classes of the user's own."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from . import PSI, BaseDimension, BaseMeasure, BaseTransformer, BinDimension, ColumnDimension, Count, Cube, EqualWidthBinner, FixedBinner, Funnel, QuantileBinner, Share
from .operators import prep, quality, supervised
from .operators.measures import Compiled
from .operators.rank import psi_from_proportions
from .plans import modelplan as mp
from .plans.comparison import psi_against_fixed
from .plans.workflow import BaseWorkflowStage, DataWorkflow, PrepStage, QualityStage, StageResult
from .queries import EDGES, GAPPY, HALF, bins, gappy_events, halves, prepared, psi, query, ranked_parts
from .sources import methods
from .sources.registry import Registry
from .sources.tables import read, read_csv, write_csv


def values_sql(names: str, rows: list[tuple]) -> str:
    """Rows that are the same whatever the tables hold."""

    def show(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else f"{v}::DOUBLE"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


def raised(cases: dict) -> list[tuple[str, str]]:
    """Each case with the class of the error it ends in."""
    out = []
    for name, call in cases.items():
        try:
            call()
            out.append((name, "none"))
        except Exception as error:  # noqa: BLE001  the class is the result
            out.append((name, type(error).__name__))
    return out


# -- cubes and bins ----------------------------------------------------------

TWO = "(SELECT quantile_cont(o_totalprice, [0.0, 0.5, 1.0])[2] AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"
CENTS = "rtrim(rtrim(printf('%.2f', {}), '0'), '.')"


@query("cube_interval_layout", f"""SELECT (b - 1)::INT AS __order, CASE b WHEN 1 THEN '(-inf, ' || {CENTS.format('m')} || ']' ELSE '(' || {CENTS.format('m')} || ', inf]' END AS price, n AS "count"
FROM (SELECT CASE WHEN o_totalprice <= m THEN 1 ELSE 2 END AS b, m, count(*)::DOUBLE AS n FROM orders, {TWO} GROUP BY 1, 2)""")
def cube_interval_layout(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return Cube([BinDimension("o_totalprice", QuantileBinner(2, precision=2), "price")]).fit_compute(df).layout(["price"], ["metric"], bin_labels="interval")


@query("cube_stratified_interval_layout", f"""WITH q AS (SELECT o_orderstatus AS s, quantile_cont(o_totalprice, [0.0, 0.5, 1.0])[2] AS m FROM orders GROUP BY 1),
r AS (SELECT o_orderstatus, CASE WHEN o_totalprice <= m THEN 1 ELSE 2 END AS b, m, count(*)::DOUBLE AS n FROM orders JOIN q ON s = o_orderstatus GROUP BY 1, 2, 3)
SELECT o_orderstatus, CASE b WHEN 1 THEN '(-inf, ' || {CENTS.format('m')} || ']' ELSE '(' || {CENTS.format('m')} || ', inf]' END AS price, n AS "count" FROM r""")
def cube_stratified_interval_layout(spark, sf_dir):
    cube = Cube(["o_orderstatus", BinDimension("o_totalprice", QuantileBinner(2, precision=2), "price", fit_by="o_orderstatus")])
    table = cube.fit_compute(read(spark, sf_dir, "orders")).layout(["o_orderstatus", "price"], ["metric"], bin_labels="interval")
    return table.filter(F.col("count").isNotNull()).drop("__order")


@query("cube_bin_metadata", f"""SELECT unnest([-1, 0, 1])::BIGINT AS bin, unnest([NULL, 'low', 'high']) AS label, unnest([round(lo, 2), NULL, round(m, 2)]) AS lower_edge FROM {TWO}""")
def cube_bin_metadata(spark, sf_dir):
    """Bin -1 carries the least value of the reference; the first bin is open below."""
    binner = QuantileBinner(2, labels=["low", "high"]).fit(read(spark, sf_dir, "orders"), "o_totalprice")
    facts = binner.metadata()
    rows = [(-1, None, round(float(facts["reference_range"][0]), 2))]
    rows += [(i, label, None if edge == float("-inf") else round(edge, 2)) for i, (label, edge) in enumerate(zip(facts["labels"], facts["bin_edges"][:-1], strict=True))]
    return spark.createDataFrame(rows, "bin long, label string, lower_edge double")


BIN_ERRORS = [("fewer labels than bins", "TransformError"), ("repeated labels", "TransformError"), ("missing label", "TransformError"), ("no bins", "TransformError"), ("fitting labels", "none")]


@query("cube_bin_labels_checked", values_sql('"case", error', BIN_ERRORS))
def cube_bin_labels_checked(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    cases = {
        "fewer labels than bins": lambda: QuantileBinner(3, labels=["a"]).fit(df, "o_totalprice"), "repeated labels": lambda: FixedBinner([1, 2], labels=["a", "a"]),
        "missing label": lambda: EqualWidthBinner(2, labels=["a", None]), "no bins": lambda: QuantileBinner(0), "fitting labels": lambda: EqualWidthBinner(2, labels=["a", "b"]).fit(df, "o_totalprice"),
    }
    return spark.createDataFrame(raised(cases), "case string, error string")


@query("cube_declared_order", """SELECT unnest([0, 1, 2, 3])::INT AS __order, unnest(['P', 'none', 'F', 'O']) AS o_orderstatus,
  unnest([(SELECT count(*) FROM orders WHERE o_orderstatus = 'P'), 0, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')])::DOUBLE AS "count" """)
def cube_declared_order(spark, sf_dir):
    cube = Cube([ColumnDimension("o_orderstatus", categories=["P", "none", "F", "O"])])
    return cube.compute(read(spark, sf_dir, "orders")).layout(["o_orderstatus"], ["metric"])


@query("cube_total_labels", """WITH x AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'Total' ELSE o_orderstatus END AS s FROM orders)
SELECT (row_number() OVER (ORDER BY t, s) - 1)::INT AS __order, label, n AS "count" FROM (
  SELECT 0 AS t, s, s AS label, count(*)::DOUBLE AS n FROM x GROUP BY s UNION ALL SELECT 1, NULL, 'All', count(*)::DOUBLE FROM x)""")
def cube_total_labels(spark, sf_dir):
    """A value that reads like a total's label is told apart by another label."""
    df = read(spark, sf_dir, "orders").withColumn("label", F.when(F.col("o_orderstatus") == "P", "Total").otherwise(F.col("o_orderstatus")))
    return Cube(["label"]).compute(df, totals=True).layout(["label"], ["metric"], totals=True, total_label="All")


@query("cube_explain", values_sql("section, item, description", [
    ("dimension", "o_orderstatus", "ColumnDimension over o_orderstatus"), ("measure", "count", "Count"), ("measure", "share", "Share"), ("aggregate", "count", "shared"),
    ("grouping set", "o_orderstatus", "cells"), ("grouping set", "()", "total"), ("policy", "missing dimension", "drop"), ("policy", "on invalid", "nan")]))
def cube_explain(spark, sf_dir):
    return spark.createDataFrame(Cube(["o_orderstatus"], [Count(), Share()]).explain(totals=True), "section string, item string, description string")


class Initial(BaseDimension):
    """The first letters of a column."""

    def __init__(self, column: str, n: int):
        self.column, self.n, self.output_name = column, n, "initial"

    def required_columns(self):
        return (self.column,)

    def transform(self, col):
        return F.substring(col(self.column), 1, self.n)


class Spread(BaseMeasure):
    """Largest less smallest value."""

    def __init__(self, column: str):
        self.column, self.name = column, "spread"

    def required_columns(self, context):
        return (self.column,)

    def compile(self, context):
        return Compiled(self.name, {"spread_hi": F.max(self.column), "spread_lo": F.min(self.column)}, lambda a: a("spread_hi") - a("spread_lo"), None)


class Sign(BaseTransformer):
    """Above or below a mean learnt from the reference."""

    mean = None

    @property
    def is_fitted(self):
        return self.mean is not None

    def fit(self, df, column, target=None):
        self.mean = df.agg(F.avg(column)).first()[0]
        return self

    def transform(self, column):
        return F.when(column > self.mean, "above").when(column <= self.mean, "below")

    def domain(self):
        return ["below", "above"]


@query("cube_own_classes", """SELECT o_orderpriority[1:1] AS initial, CASE WHEN o_totalprice > m THEN 'above' ELSE 'below' END AS side, round(max(o_totalprice) - min(o_totalprice), 4) AS spread
FROM orders, (SELECT avg(o_totalprice) AS m FROM orders) GROUP BY 1, 2""")
def cube_own_classes(spark, sf_dir):
    cube = Cube([Initial("o_orderpriority", 1), BinDimension("o_totalprice", Sign(), "side")], [Spread("o_totalprice")])
    return cube.fit_compute(read(spark, sf_dir, "orders")).pivoted()


# -- funnels and comparisons -------------------------------------------------


@query("funnel_plain_columns", """SELECT d AS "day", sum(views)::DOUBLE AS views_count, sum(clicks)::DOUBLE AS clicks_count, sum(buys)::DOUBLE AS buys_count, round(sum(clicks) / sum(views), 4) AS views_to_clicks_rate, round(sum(buys) / sum(clicks), 4) AS clicks_to_buys_rate
FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, (event_type = 'view')::INT AS views, (event_type = 'click')::INT AS clicks, (event_type = 'purchase')::INT AS buys FROM events) GROUP BY 1""")
def funnel_plain_columns(spark, sf_dir):
    """Stages by column name, over counts aggregated by day and user beforehand."""
    e = read(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    daily = e.groupBy("day", "user_id").agg(*[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in (("views", "view"), ("clicks", "click"), ("buys", "purchase"))])
    return Cube(["day"], [Funnel(["views", "clicks", "buys"])]).compute(daily).pivoted()


def plain_psi(groups: str, days: str) -> str:
    return f"""WITH e AS {EDGES}, r AS (SELECT {groups} AS g, {HALF} AS side, {bins('o_totalprice', 'e', 10)} AS b FROM orders, e),
ref AS (SELECT b, count(*) / sum(count(*)) OVER () AS p FROM r WHERE side = 0 GROUP BY 1), c AS (SELECT g, b, count(*) AS n FROM r WHERE side = 1 GROUP BY 1, 2),
k AS (SELECT DISTINCT g FROM c), x AS (SELECT k.g, ref.b, greatest(p, 1e-8) AS p, coalesce(n, 0) AS n FROM k CROSS JOIN ref LEFT JOIN c ON c.g = k.g AND c.b = ref.b),
q AS (SELECT g, p, greatest(n / sum(n) OVER (PARTITION BY g), 1e-8) AS q FROM x), z AS (SELECT g, p / sum(p) OVER (PARTITION BY g) AS p, q / sum(q) OVER (PARTITION BY g) AS q FROM q)
SELECT g AS {days}, round(sum((q - p) * (ln(q) - ln(p))), 4) AS psi FROM z GROUP BY 1"""


@query("psi_fixed_reference_each_month", plain_psi("strftime(o_orderdate, '%Y-%m')", '"month"'))
def psi_fixed_reference_each_month(spark, sf_dir):
    """One pooled reference against every month, each side counted once."""
    ref, cur = halves(spark, sf_dir)
    return psi_against_fixed(ref, cur.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["month"], [PSI("o_totalprice", QuantileBinner(10), name="psi")])


@query("psi_from_proportions", f"""WITH s AS (SELECT o_orderpriority AS b, count(*) FILTER (WHERE {HALF} = 0) / sum(count(*) FILTER (WHERE {HALF} = 0)) OVER () AS p, count(*) FILTER (WHERE {HALF} = 1) / sum(count(*) FILTER (WHERE {HALF} = 1)) OVER () AS q FROM orders GROUP BY 1)
SELECT round(sum((q - p) * ln(q / p)), 4) AS psi, NULL::DOUBLE AS of_bad_sums FROM s""")
def psi_of_proportions(spark, sf_dir):
    sides = []
    for df in halves(spark, sf_dir):
        n = dict(df.groupBy("o_orderpriority").count().collect())
        sides.append([n[k] / sum(n.values()) for k in sorted(n)])
    return spark.createDataFrame([(psi_from_proportions(*sides), psi_from_proportions([0.5, 0.6], [0.5, 0.5]))], "psi double, of_bad_sums double")


@query("psi_no_reference", "SELECT o_orderstatus, NULL::DOUBLE AS psi FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1")
def psi_no_reference(spark, sf_dir):
    """Where the reference has nothing to learn from there is no value, and no error."""
    ref, cur = halves(spark, sf_dir)
    return Cube(["o_orderstatus"], [PSI("o_totalprice", QuantileBinner(10), name="psi")]).compute_comparison(ref.filter("o_totalprice < 0"), cur).pivoted()


@query("compare_restrictions", values_sql('"case", refused', [("single-sample measure in compare", True), ("comparative measure in compute", True), ("distribution shares beside it", True), ("a comparison", False)]))
def compare_restrictions(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    one, two = Cube(["o_orderstatus"], [Count()]), Cube(["o_orderstatus"], [PSI("o_totalprice", QuantileBinner(4))])
    mixed = lambda: Cube(["o_orderstatus"], [Count(), PSI("o_totalprice", QuantileBinner(4))]).compute_comparison(ref, cur)
    cases = {"single-sample measure in compare": lambda: one.compute_comparison(ref, cur), "comparative measure in compute": lambda: two.compute(cur), "distribution shares beside it": mixed, "a comparison": lambda: two.compute_comparison(ref, cur)}
    return spark.createDataFrame([(c, e != "none") for c, e in raised(cases)], "case string, refused boolean")


# -- quality, preparation, workflows -----------------------------------------


class EvenCheck(quality.BaseQualityCheck):
    """Every value is even."""

    def metrics(self, df):
        return {c: F.count_if(F.col(c) % 2 != 0) for c in self.of(df)}

    def judge(self, df, got):
        return self.result(df, got, [quality.CheckStatus.FAIL if n else quality.CheckStatus.PASS for n in got.values()])


@query("dq_composite_report", """SELECT unnest(['RowCountCheck', 'MissingRateCheck', 'RangeCheck', 'EvenCheck']) AS "check",
  unnest(['PASS', CASE WHEN (SELECT count(*) FROM events WHERE event_id % 7 = 0) > 0 THEN 'FAIL' ELSE 'PASS' END, 'PASS', CASE WHEN (SELECT count(*) FROM events WHERE event_id % 2 <> 0) > 0 THEN 'FAIL' ELSE 'PASS' END]) AS status""")
def dq_composite_report(spark, sf_dir):
    """Several checks, one of the user's own, in one report."""
    df = gappy_events(spark, sf_dir)
    checks = [quality.RowCountCheck(), quality.MissingRateCheck(["value"], max_rate=0.0), ("range", quality.RangeCheck("event_id", 0)), EvenCheck(["event_id"])]
    return quality.DataQuality(checks).fit_validate(df).to_frame(spark).select("check", "status")


@query("dq_report_summary", """SELECT unnest(['FAIL', 'PASS', 'SKIP', 'WARN']) AS status, unnest([n, 2 - n, 0, 0])::BIGINT AS checks, n = 0 AS passed FROM (SELECT (count(*) > 0)::INT AS n FROM events WHERE event_id % 7 = 0)""")
def dq_report_summary(spark, sf_dir):
    found = quality.DataQuality([quality.RowCountCheck(), quality.MissingRateCheck(["value"], max_rate=0.0)]).fit_validate(gappy_events(spark, sf_dir))
    known = found.summary()
    return spark.createDataFrame([(s, int(known.get(s, 0)), found.passed) for s in ("FAIL", "PASS", "SKIP", "WARN")], "status string, checks long, passed boolean")


@query("prep_impute_callable", f"SELECT event_id, coalesce(v, (SELECT max(v) FROM {GAPPY})) AS value FROM {GAPPY}")
def prep_impute_callable(spark, sf_dir):
    return prepared(prep.MissingImputer("value", F.max), gappy_events(spark, sf_dir), ["event_id", "value"])


@query("prep_impute_sentinel", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 50 THEN m ELSE l_quantity END AS l_quantity, (l_quantity = 50)::INT AS l_quantity_missing FROM lineitem, (SELECT median(l_quantity) AS m FROM lineitem WHERE l_quantity <> 50)")
def prep_impute_sentinel(spark, sf_dir):
    """A value that stands for missing."""
    step = prep.MissingImputer("l_quantity", "median", missing_values=50, add_indicator=True)
    return prepared(step, read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_quantity_missing"])


@query("prep_kbins_linear", """SELECT o_orderkey, CASE WHEN o_totalprice < e[2] THEN 0 WHEN o_totalprice < e[3] THEN 1 WHEN o_totalprice < e[4] THEN 2 ELSE 3 END::INT AS o_totalprice_bin FROM orders, (SELECT quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM orders)""")
def prep_kbins_linear(spark, sf_dir):
    return prepared(prep.KBins("o_totalprice", 4, quantile_method="linear", output="append"), read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice_bin"])


@query("prep_kbins_kmeans", """WITH RECURSIVE s(i, c) AS (
  SELECT 0, [min(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) / 4, min(o_totalprice) + 3 * (max(o_totalprice) - min(o_totalprice)) / 4] FROM orders
  UNION ALL SELECT i + 1, [(SELECT avg(o_totalprice) FROM orders WHERE o_totalprice <= (c[1] + c[2]) / 2), (SELECT avg(o_totalprice) FROM orders WHERE o_totalprice > (c[1] + c[2]) / 2)] FROM s WHERE i < 100)
SELECT o_orderkey, (o_totalprice >= (c[1] + c[2]) / 2)::INT AS o_totalprice_bin FROM orders, s WHERE i = 100""")
def prep_kbins_kmeans(spark, sf_dir):
    return prepared(prep.KBins("o_totalprice", 2, "kmeans", output="append"), read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice_bin"])


def flagged(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").withColumn("t", (F.col("l_linestatus") == "F").cast("int"))


OPT = """WITH x AS (SELECT *, (l_linestatus = 'F')::INT AS t FROM lineitem), n AS (
  SELECT CASE WHEN l_quantity IN (1, 2) THEN 4 WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 35 THEN 2 ELSE 3 END AS b, sum(t) AS e, sum(1 - t) AS o FROM x GROUP BY 1),
w AS (SELECT *, ln((o / (SELECT sum(o) FROM n)) / (e / (SELECT sum(e) FROM n))) AS woe FROM n)"""


@query("prep_opt_binning", OPT + """SELECT l_orderkey, l_linenumber, l_partkey, round(woe, 4) AS l_quantity_woe FROM x JOIN w ON b = CASE WHEN l_quantity IN (1, 2) THEN 4 WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 35 THEN 2 ELSE 3 END""")
def prep_opt_binning(spark, sf_dir):
    """Given splits, with special codes valued by their own rate."""
    step = supervised.OptBinning("l_quantity", "t", user_splits={"l_quantity": [15, 35]}, special_codes=[1, 2], metric_special="empirical", output="append")
    return prepared(step, flagged(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity_woe"])


@query("prep_opt_binning_table", OPT + """SELECT b::INT - 1 AS "index", CASE b WHEN 4 THEN 'special' ELSE 'bin' END AS kind, (e + o)::BIGINT AS "count", e::BIGINT AS event, round(woe, 4) AS woe, round((o / (SELECT sum(o) FROM n) - e / (SELECT sum(e) FROM n)) * woe, 4) AS iv FROM w
UNION ALL SELECT 4, 'missing', 0, 0, 0.0, 0.0""")
def prep_opt_binning_table(spark, sf_dir):
    step = supervised.OptBinning("l_quantity", "t", user_splits={"l_quantity": [15, 35]}, special_codes=[1, 2]).fit(flagged(spark, sf_dir))
    return step.binning_table(spark).select("index", "kind", "count", "event", "woe", "iv")


@query("prep_opt_binning_categorical", """WITH x AS (SELECT *, (l_linestatus = 'F')::INT AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(avg(t) OVER (PARTITION BY l_returnflag), 4) AS l_returnflag_event_rate FROM x""")
def prep_opt_binning_categorical(spark, sf_dir):
    step = supervised.OptBinning("l_returnflag", "t", ["l_returnflag"], "event_rate", min_bin_size=0.0, output="append")
    return prepared(step, flagged(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag_event_rate"])


@query("prep_any_transformer", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sqrt(l_quantity * l_quantity + l_tax * l_tax), 4) AS quantity, round(l_tax / sqrt(l_quantity * l_quantity + l_tax * l_tax), 4) AS tax FROM lineitem")
def prep_any_transformer(spark, sf_dir):
    """A step around an SQL transformer of the machine-learning library."""
    from pyspark.ml.feature import SQLTransformer

    made = SQLTransformer(statement="SELECT *, l_quantity / sqrt(l_quantity * l_quantity + l_tax * l_tax) AS a, l_tax / sqrt(l_quantity * l_quantity + l_tax * l_tax) AS b FROM __THIS__")
    step = supervised.TransformerStep(made, ["l_quantity", "l_tax"], output_columns=["quantity", "tax"])
    return prepared(step, read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "quantity", "tax"])


@query("prep_save_load", "SELECT o_orderkey, round((least(o_totalprice, 400000) - m) / s, 4) AS o_totalprice FROM orders, (SELECT avg(least(o_totalprice, 400000)) AS m, stddev_pop(least(o_totalprice, 400000)) AS s FROM orders)")
def prep_save_load(spark, sf_dir):
    """Fitted, saved, read back and applied."""
    df = read(spark, sf_dir, "orders")
    with tempfile.TemporaryDirectory() as folder:
        prep.DataPrep([prep.Clip("o_totalprice", upper=400000), prep.StandardScaler("o_totalprice")]).fit(df).save(f"{folder}/prep.json")
        loaded = prep.DataPrep.load(f"{folder}/prep.json")
    return loaded.transform(df).select("o_orderkey", "o_totalprice")


class Halve(prep.BasePrepStep):
    """A step of the user's own."""

    def inputs(self):
        return ["o_totalprice"]

    def project(self, df):
        return {"o_totalprice": F.col("o_totalprice") / 2}


class KeepOpen(BaseWorkflowStage):
    """A stage of the user's own."""

    name = "keep-open"

    def fit_apply(self, df):
        return df.filter("o_orderstatus = 'O'")

    def run(self, df):
        return StageResult(self.name, "filter", self.fit_apply(df), None)


@query("workflow_result", "SELECT unnest(['keep-open', 'halve', 'gate']) AS stage, unnest(['filter', 'prep', 'quality']) AS kind, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS \"rows\", (SELECT round(sum(o_totalprice) / 2, 2) FROM orders WHERE o_orderstatus = 'O') AS total")
def workflow_result(spark, sf_dir):
    flow = DataWorkflow([KeepOpen(), PrepStage("halve", prep.DataPrep([Halve()])), QualityStage("gate", quality.DataQuality([quality.RangeCheck("o_totalprice", 0)]))])
    result = flow.fit_run(read(spark, sf_dir, "orders"))
    n, total = result.data.agg(F.count("*"), F.round(F.sum("o_totalprice"), 2)).first()
    return spark.createDataFrame([(s.name, s.kind, n, total) for s in result.stage_results], "stage string, kind string, rows long, total double")


# -- plans -------------------------------------------------------------------


@query("plan_objectives", values_sql("goal, strategy, objectives, roles", [
    ("binary_classification", "gradient_boosting", "log_loss", "target"), ("binary_classification", "mlp", "log_loss,focal_loss", "target"),
    ("regression", "gradient_boosting", "squared_error,absolute_error,quantile", "target"), ("regression", "mlp", "squared_error", "target"),
    ("causal_effect", "gradient_boosting", "uplift,squared_error", "target,treatment"), ("causal_effect", "mlp", "uplift,squared_error", "target,treatment"), ("survival", "mlp", "cox", "duration,event")]))
def plan_objectives(spark, sf_dir):
    """Every goal with every strategy that models it."""
    rows = []
    for goal in (mp.binary_classification(), mp.regression(), mp.causal_effect(), mp.survival()):
        for strategy in (mp.gradient_boosting(), mp.multilayer_perceptron()):
            if goal.kind in strategy.goals:
                plan = mp.ModelPlan(goal, strategy)
                rows.append((goal.kind, strategy.kind, ",".join(plan.objectives), ",".join(plan.required_roles)))
    return spark.createDataFrame(rows, "goal string, strategy string, objectives string, roles string")


WEIGHTED = mp.ModelingGoal("regression", ("target",), ("tweedie", "squared_error"), objective_roles={"tweedie": ("weight",)})
LIGHT = mp.ModelStrategy("linear", ("regression",), ("tweedie", "squared_error"), False, False, True, supports_weight=False)
HEAVY = mp.ModelStrategy("linear", ("regression",), ("tweedie", "squared_error"), False, False, True)


@query("plan_objective_roles", values_sql("supports_weight, selected, required, optional", [(True, "tweedie", "target,weight", "sample_key,time"), (False, "squared_error", "target", "sample_key,time")]))
def plan_objective_roles(spark, sf_dir):
    rows = []
    for strategy in (HEAVY, LIGHT):
        plan = mp.ModelPlan(WEIGHTED, strategy)
        rows.append((strategy.supports_weight, plan.selected, ",".join(plan.required_roles), ",".join(plan.optional_roles)))
    return spark.createDataFrame(rows, "supports_weight boolean, selected string, required string, optional string")


PLAN_ERRORS = [("goal the strategy doesn't model", "CompatibilityError"), ("objective of neither", "CompatibilityError"), ("role unbound", "PlanError"), ("role unknown", "PlanError"), ("categorical features for a network", "PlanError"), ("another data family", "PlanError"), ("column missing", "PlanError"), ("two targets", "PlanError"), ("feature twice", "PlanError"), ("ratios short of one", "PlanError"), ("no train part", "PlanError"), ("ratio and values", "PlanError"), ("all in order", "none")]


@query("plan_checks", values_sql('"case", error', PLAN_ERRORS))
def plan_checks(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    boost, net = mp.ModelPlan(mp.binary_classification(), mp.gradient_boosting()), mp.ModelPlan(mp.binary_classification(), mp.multilayer_perceptron())
    numeric, target = mp.FeatureSpec(("o_totalprice",)), mp.RoleSpec(target="o_orderstatus")
    thirds = {"train": mp.PartitionSpec(0.6), "test": mp.PartitionSpec(0.3)}
    cases = {
        "goal the strategy doesn't model": lambda: mp.ModelPlan(mp.survival(), mp.gradient_boosting()), "objective of neither": lambda: mp.ModelPlan(mp.regression(), mp.gradient_boosting(), "cox"),
        "role unbound": lambda: mp.DataPlan(mp.RoleSpec(time="o_orderdate"), numeric).validate_against(boost), "role unknown": lambda: mp.DataPlan(mp.RoleSpec(target="o_orderstatus", treatment="o_custkey"), numeric).validate_against(boost),
        "categorical features for a network": lambda: mp.DataPlan(target, mp.FeatureSpec(("o_totalprice",), ("o_orderpriority",))).validate_against(net), "another data family": lambda: mp.DataPlan(target, numeric, data_family="sequence").validate_against(boost),
        "column missing": lambda: mp.DataPlan(target, mp.FeatureSpec(("nothing",))).validate_against(boost, df), "two targets": lambda: mp.RoleSpec(target=("a", "b")), "feature twice": lambda: mp.FeatureSpec(("a",), ("a",)),
        "ratios short of one": lambda: mp.SplitSpec(mp.RandomSplitter(), thirds), "no train part": lambda: mp.SplitSpec(mp.RandomSplitter(), {"test": mp.PartitionSpec(0.5)}), "ratio and values": lambda: mp.PartitionSpec(0.5, ("a",)),
        "all in order": lambda: mp.DataPlan(target, mp.FeatureSpec(("o_totalprice",), ("o_orderpriority",)), mp.SplitSpec(mp.HashSplitter(("o_custkey",)), {"train": mp.PartitionSpec(0.7), "test": mp.PartitionSpec(0.3)})).validate_against(boost, df),
    }
    return spark.createDataFrame(raised(cases), "case string, error string")


# -- runs, methods, files ----------------------------------------------------


@query("registry_runs", values_sql("number, name, label, status, error", [(1, "base", "first", "completed", None), (2, "broken", None, "failed", "ValueError: no data"), (3, "tuned", None, "completed", None)]))
def registry_runs(spark, sf_dir):
    with tempfile.TemporaryDirectory() as root:
        registry = Registry(root)
        with registry.start_run("base", label="first"):
            pass
        try:
            with registry.start_run("broken"):
                raise ValueError("no data")
        except ValueError:
            pass
        with registry.start_run("tuned"):
            pass
        return registry.runs(spark).select(F.substring("run_id", 1, 4).cast("long").alias("number"), "name", "label", "status", "error")


@query("registry_records", values_sql('"case", error', [("by label", "none"), ("by name", "none"), ("unknown", "ExperimentError"), ("two of a name", "ExperimentError"), ("metrics twice", "RunError"), ("after the end", "RunError"), ("artifact outside", "RunError"), ("artifact changed", "RunError"), ("record damaged", "ExperimentError")]))
def registry_records(spark, sf_dir):
    """How runs are found, and what a record refuses."""
    with tempfile.TemporaryDirectory() as root:
        registry = Registry(root)
        with registry.start_run("a", label="x") as run:
            run.log_metrics({"train": {"auc": 0.5}})
            twice = raised({"metrics twice": lambda: run.log_metrics({"train": {"auc": 0.6}}), "artifact outside": lambda: run.log_artifact("bad", "../bad", lambda p: p.write_text("")), "": lambda: run.log_json("facts", {"n": 1})})[:2]
        for _ in range(2):
            with registry.start_run("b"):
                pass
        (run.path / "artifacts" / "facts.json").write_text("{}")
        rows = twice + raised({"by label": lambda: registry.resolve("x"), "by name": lambda: registry.resolve("a"), "unknown": lambda: registry.resolve("c"), "two of a name": lambda: registry.resolve("b"), "after the end": lambda: run.log_params({"a": 1}), "artifact changed": lambda: registry.verify("a")})
        (run.path / "run.json").write_text('{"status": "odd"}')
        rows += raised({"record damaged": lambda: registry.resolve("a")})
    return spark.createDataFrame(rows, "case string, error string")


@query("method_spaces", values_sql("method, family, runs, rate, deep", [("boosting", "trees", 2, 0.05, 3), ("linear", "linear", 0, None, None)]))
def method_spaces(spark, sf_dir):
    """Spaces are made once and opened later; a run's configuration is composed over the baseline."""
    with tempfile.TemporaryDirectory() as project:
        methods.initialize(project, "boosting", family="trees", baseline={"rate": 0.1, "deep": {"a": 1}})
        methods.initialize(project, "linear")
        methods.initialize(project, "boosting")  # again: nothing changes
        rows = []
        for name in methods.methods(project):
            space = methods.open_method(project, name)
            if name == "boosting":
                for override in ("rate=0.1", "rate=0.05"):
                    with space.start_run("r", config=methods.compose(space.baseline(), {"deep": {"b": 2}}, overrides=[override])) as run:
                        run.log_metrics({"test": {"auc": 0.5}})
            records = space._records()
            config = records[-1]["config"] if records else {}
            rows.append((name, space.manifest["family"], len(records), config.get("rate"), sum(config["deep"].values()) if config else None))
    return spark.createDataFrame(rows, "method string, family string, runs long, rate double, deep long")


@query("config_sources", values_sql('"key", "value"', [("a", "1"), ("b.c", "[2, 3]"), ("b.d", '"x"'), ("f.name", '"tallyframe.sources.methods.compose"')]))
def config_sources(spark, sf_dir):
    """A YAML file, a mapping and overrides, merged and recorded; a function by its identity."""
    from .sources.registry import flatten

    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "base.yaml").write_text("a: 0\nb: {c: [1], d: y}\n")
        made = methods.compose(Path(folder, "base.yaml"), {"b": {"c": [2, 3]}, "f": methods.compose}, overrides=["a=1", "b.d=x"])
    rows = [(k, v) for k, v in sorted(flatten(methods.snapshot(made)).items()) if k != "f.sha256"]
    return spark.createDataFrame(rows, "key string, value string")


@query("method_checks", values_sql('"case", error', [("not initialised", "ExperimentError"), ("baseline given again", "ExperimentError"), ("another family", "ExperimentError"), ("odd name", "ExperimentError"), ("override without a value", "ExperimentError"), ("unrecordable value", "ExperimentError")]))
def method_checks(spark, sf_dir):
    with tempfile.TemporaryDirectory() as project:
        methods.initialize(project, "linear", baseline={"a": 1})
        rows = raised({
            "not initialised": lambda: methods.open_method(project, "other"), "baseline given again": lambda: methods.initialize(project, "linear", baseline={"a": 2}), "another family": lambda: methods.initialize(project, "linear", family="trees"),
            "odd name": lambda: methods.initialize(project, "../x"), "override without a value": lambda: methods.compose({}, overrides=["a"]), "unrecordable value": lambda: methods.snapshot({"a": object()}),
        })
    return spark.createDataFrame(rows, "case string, error string")


@query("importance_csv", "SELECT p_partkey, rank() OVER (ORDER BY p_retailprice DESC)::INT AS gain_rank, rank() OVER (ORDER BY p_size DESC)::INT AS split_rank FROM part")
def importance_csv(spark, sf_dir):
    """Importances written as CSV, read back and ranked."""
    from .sources.tables import scratch_folder

    path = f"{scratch_folder(spark)}/importances.csv"
    write_csv(read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("gain"), F.col("p_size").alias("split")), path, "overwrite")
    return ranked_parts(read_csv(spark, path, "p_partkey long, gain double, split long"))
