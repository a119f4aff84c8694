"""Registered queries over the sample tables, each with its DuckDB counterpart.

Sums and rates are rounded on both sides: engines add doubles in other orders.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import AUC, KS, PSI, BinDimension, Col, ColumnDimension, ComparativeCalculation, ComputePolicy, Count, Cube, EqualWidthBinner, EventRate, FixedBinner, Funnel, MissingPolicy, QuantileBinner, Ratio, Share, Stage, Sum, Transition
from .operators import prep, quality
from .plans.modelplan import ColumnSplitter, HashSplitter, PartitionSpec, RandomSplitter, SplitSpec, TimeSplitter, log_loss
from .plans.workflow import DataWorkflow, PrepStage, QualityStage
from .sources.registry import Registry, importance_ranks
from .sources.tables import read
from .streaming.cubes import windowed_cube

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


def bins(x: str, edges: str, n: int, first: int = 1) -> str:
    """SQL for right-closed bins over a list of edges whose inner ones start at ``first + 1``."""
    cases = "".join(f" WHEN {x} <= {edges}[{first + i}] THEN 'B{i}'" for i in range(1, n))
    return f"CASE WHEN {x} IS NULL THEN NULL{cases} ELSE 'B{n}' END"


def five(table: str, x: str, where: str = "true") -> str:
    return f"(SELECT quantile_cont({x}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM {table} WHERE {where})"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    cut = F.lit("1998-01-01").cast("timestamp")
    return orders.filter(F.col("o_orderdate") < cut), orders.filter(F.col("o_orderdate") >= cut)


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing values planted, of which the tables have none."""
    e = read(spark, sf_dir, "events")
    return e.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value"))).withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))


GAPPY = "(SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events)"


# -- cubes -------------------------------------------------------------------


@query(
    "cube_flagship",
    f"""WITH q AS {five("lineitem", "l_extendedprice")}, r AS (
  SELECT l_returnflag, {bins("l_extendedprice", "e", 5)} AS b, l_quantity, l_linestatus FROM lineitem, q)
SELECT grouping(l_returnflag, b)::BIGINT AS grouping_id, l_returnflag, b AS l_extendedprice_bin, count(*)::DOUBLE AS "count",
  round(count(*) / (SELECT count(*) FROM lineitem), 4) AS share, round(sum(l_quantity), 4) AS sum__l_quantity,
  round(avg((l_linestatus = 'F')::INT), 4) AS event_rate__l_linestatus__F
FROM r GROUP BY GROUPING SETS ((l_returnflag, b), (l_returnflag), (b), ())""",
)
def cube_flagship(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem", ["l_returnflag", "l_extendedprice", "l_quantity", "l_linestatus"])
    cube = Cube(["l_returnflag", BinDimension("l_extendedprice", QuantileBinner(5))], [Count(), Share(), Sum("l_quantity"), EventRate("l_linestatus", "F")])
    result = cube.fit(df).compute(df, totals=True)
    names = [F.col(f"__d{i}").alias(n) for i, n in enumerate(result.dims)] + [F.col(f"__m{i}").alias(n) for i, n in enumerate(result.names)]
    return result.wide.select(F.col("__gid").alias("grouping_id"), *names)


@query(
    "cube_canonical",
    """SELECT o_orderstatus, metric, value FROM (
  SELECT o_orderstatus, count(*)::DOUBLE AS "count", round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1)
UNPIVOT INCLUDE NULLS (value FOR metric IN ("count", total))""",
)
def cube_canonical(spark, sf_dir):
    return Cube(["o_orderstatus"], [Count(), Sum("o_totalprice", "total")]).compute(read(spark, sf_dir, "orders")).data_


@query("cube_global", 'SELECT count(*)::DOUBLE AS "count", round(sum(o_totalprice), 4) AS sum__o_totalprice FROM orders')
def cube_global(spark, sf_dir):
    return Cube([], [Count(), Sum("o_totalprice")]).compute(read(spark, sf_dir, "orders")).pivoted()


@query("cube_global_empty", 'SELECT 0.0::DOUBLE AS "count", 0.0::DOUBLE AS total, NULL::DOUBLE AS rate')
def cube_global_empty(spark, sf_dir):
    cube = Cube([], [Count(), Sum("o_totalprice", "total"), EventRate("o_orderstatus", "F", name="rate")], [Col("o_totalprice") < 0])
    return cube.compute(read(spark, sf_dir, "orders")).pivoted()


@query("cube_two_dims", 'SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS "count", round(count(*) / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1, 2')
def cube_two_dims(spark, sf_dir):
    return Cube(["o_orderstatus", "o_orderpriority"], [Count(), Share()]).compute(read(spark, sf_dir, "orders")).pivoted()


@query(
    "cube_where_measures",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000)::DOUBLE AS dear,
  coalesce(round(sum(o_totalprice) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')), 4), 0) AS urgent_total,
  count(*) FILTER (WHERE NOT (o_totalprice >= 100000) OR o_orderpriority = '5-LOW')::DOUBLE AS cheap_or_low,
  count(*) FILTER (WHERE o_orderpriority IS NOT NULL)::DOUBLE AS known FROM orders GROUP BY 1""",
)
def cube_where_measures(spark, sf_dir):
    p, price = Col("o_orderpriority"), Col("o_totalprice")
    measures = [Count("dear", where=price > 200000), Sum("o_totalprice", "urgent_total", where=p.isin(["1-URGENT", "2-HIGH"])), Count("cheap_or_low", where=~(price >= 100000) | (p == "5-LOW")), Count("known", where=p.notna())]
    return Cube(["o_orderstatus"], measures).compute(read(spark, sf_dir, "orders")).pivoted()


@query("cube_filters_sequential", """SELECT l_returnflag, count(*)::DOUBLE AS "count", round(sum(l_quantity), 4) AS sum__l_quantity FROM lineitem WHERE l_discount > 0.02 AND l_quantity <= 30 GROUP BY 1""")
def cube_filters_sequential(spark, sf_dir):
    return Cube(["l_returnflag"], [Count(), Sum("l_quantity")], [Col("l_discount") > 0.02, lambda df: F.col("l_quantity") <= 30]).compute(read(spark, sf_dir, "lineitem")).pivoted()


@query("cube_predicates_unknown", f"SELECT count(*) FILTER (WHERE v > 50)::DOUBLE AS high, count(*) FILTER (WHERE NOT (v > 50))::DOUBLE AS low, count(*) FILTER (WHERE v IS NULL)::DOUBLE AS unknown, count(*) FILTER (WHERE v <> 0 AND kind <> 'click')::DOUBLE AS both_ FROM {GAPPY}")
def cube_predicates_unknown(spark, sf_dir):
    v = Col("value")
    return Cube([], [Count("high", where=v > 50), Count("low", where=~(v > 50)), Count("unknown", where=v.isna()), Count("both_", where=(v != 0) & (Col("kind") != "click"))]).compute(gappy_events(spark, sf_dir)).pivoted()


@query("cube_missing_drop", f'SELECT kind, count(*)::DOUBLE AS "count" FROM {GAPPY} WHERE kind IS NOT NULL GROUP BY 1')
def cube_missing_drop(spark, sf_dir):
    return Cube(["kind"]).compute(gappy_events(spark, sf_dir)).pivoted()


@query("cube_missing_keep", f'SELECT kind, count(*)::DOUBLE AS "count", round(count(*) / (SELECT count(*) FROM events), 4) AS share FROM {GAPPY} GROUP BY 1')
def cube_missing_keep(spark, sf_dir):
    return Cube(["kind"], [Count(), Share()], policy=ComputePolicy(MissingPolicy("keep"))).compute(gappy_events(spark, sf_dir)).pivoted()


@query("cube_sum_propagate", f"SELECT user_id, CASE WHEN count(*) FILTER (WHERE v IS NULL) = 0 THEN round(sum(v), 4) END AS sum__value FROM {GAPPY} GROUP BY 1")
def cube_sum_propagate(spark, sf_dir):
    return Cube(["user_id"], [Sum("value")]).compute(gappy_events(spark, sf_dir)).pivoted()


@query("cube_sum_zero", f"SELECT user_id, round(coalesce(sum(v), 0), 4) AS sum__value FROM {GAPPY} GROUP BY 1")
def cube_sum_zero(spark, sf_dir):
    return Cube(["user_id"], [Sum("value", missing="zero")]).compute(gappy_events(spark, sf_dir)).pivoted()


@query("cube_event_rate_weighted", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F') / sum(l_quantity), 4) AS rate FROM lineitem GROUP BY 1")
def cube_event_rate_weighted(spark, sf_dir):
    return Cube(["l_returnflag"], [EventRate("l_linestatus", "F", "l_quantity", "rate")]).compute(read(spark, sf_dir, "lineitem")).pivoted()


@query("cube_ratio_nested", """WITH a AS (SELECT o_orderstatus, sum(o_totalprice) AS total, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS dear FROM orders GROUP BY 1)
SELECT o_orderstatus, round(total, 4) AS total, n::DOUBLE AS "count", dear::DOUBLE AS dear, round(total / n, 4) AS mean, round(total / n / dear, 4) AS mean_per_dear FROM a""")
def cube_ratio_nested(spark, sf_dir):
    measures = [Ratio("mean", "dear", "mean_per_dear"), Sum("o_totalprice", "total"), Count(), Count("dear", where=Col("o_totalprice") > 200000), Ratio("total", "count", "mean")]
    return Cube(["o_orderstatus"], measures).compute(read(spark, sf_dir, "orders")).pivoted()


RANKED = """h AS (SELECT {k}, s, sum(w) FILTER (WHERE t = 1) AS p0, sum(w) FILTER (WHERE t = 0) AS n0 FROM x GROUP BY {k}, s),
c AS (SELECT {k}, s, coalesce(p0, 0) AS p, coalesce(n0, 0) AS n,
  sum(coalesce(p0, 0)) OVER (PARTITION BY {k} ORDER BY s) AS cp, sum(coalesce(n0, 0)) OVER (PARTITION BY {k} ORDER BY s) AS cn,
  sum(coalesce(p0, 0)) OVER (PARTITION BY {k}) AS tp, sum(coalesce(n0, 0)) OVER (PARTITION BY {k}) AS tn FROM h),
ranked AS (SELECT {k}, round(sum(p * (cn - n / 2)) / nullif(max(tp) * max(tn), 0), 4) AS auc, round(max(abs(cp / nullif(tp, 0) - cn / nullif(tn, 0))), 4) AS ks FROM c GROUP BY {k})"""


@query("cube_auc", f"WITH x AS (SELECT o_orderpriority, o_totalprice AS s, (o_orderstatus = 'F')::INT AS t, 1.0::DOUBLE AS w FROM orders), {RANKED.format(k='o_orderpriority')} SELECT o_orderpriority, auc, ks FROM ranked")
def cube_auc(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("t", (F.col("o_orderstatus") == "F").cast("int"))
    return Cube(["o_orderpriority"], [AUC("o_totalprice", "t", name="auc"), KS("o_totalprice", "t", name="ks")]).compute(df).pivoted()


@query("cube_auc_weighted", f"WITH x AS (SELECT l_returnflag, l_discount AS s, (l_linestatus = 'F')::INT AS t, l_quantity AS w FROM lineitem), {RANKED.format(k='l_returnflag')} SELECT l_returnflag, auc, ks FROM ranked")
def cube_auc_weighted(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("t", (F.col("l_linestatus") == "F").cast("int"))
    return Cube(["l_returnflag"], [AUC("l_discount", "t", "l_quantity", "auc"), KS("l_discount", "t", "l_quantity", "ks")]).compute(df).pivoted()


@query("cube_ks_global", f"WITH x AS (SELECT 1 AS g, o_totalprice AS s, (o_orderstatus = 'F')::INT AS t, 1.0::DOUBLE AS w FROM orders), {RANKED.format(k='g')} SELECT auc, ks FROM ranked")
def cube_ks_global(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("t", (F.col("o_orderstatus") == "F").cast("int"))
    return Cube([], [AUC("o_totalprice", "t", name="auc"), KS("o_totalprice", "t", name="ks")]).compute(df).pivoted()


_AUC_SETS = " UNION ALL ".join(
    f"(WITH x AS (SELECT {a} AS a, {b} AS b, l_discount AS s, (l_linestatus = 'F')::INT AS t, 1.0::DOUBLE AS w FROM lineitem), {RANKED.format(k='a, b')} SELECT {g} AS grouping_id, a AS l_returnflag, b AS l_linenumber, auc FROM ranked)"
    for g, a, b in (("0::BIGINT", "l_returnflag", "l_linenumber"), ("1::BIGINT", "l_returnflag", "NULL::INT"), ("2::BIGINT", "NULL::VARCHAR", "l_linenumber"), ("3::BIGINT", "NULL::VARCHAR", "NULL::INT"))
)


@query("cube_auc_totals", _AUC_SETS)
def cube_auc_totals(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("t", (F.col("l_linestatus") == "F").cast("int"))
    result = Cube(["l_returnflag", "l_linenumber"], [AUC("l_discount", "t", name="auc")]).compute(df, totals=True)
    return result.with_totals().withColumnRenamed("value", "auc").drop("metric")


@query("cube_quality_score_auc", f"WITH x AS (SELECT lang, n_chars::DOUBLE AS s, quality AS t, 1.0::DOUBLE AS w FROM documents JOIN labels USING (doc_id)), {RANKED.format(k='lang')} SELECT lang, auc FROM ranked")
def cube_quality_score_auc(spark, sf_dir):
    df = read(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"]).join(read(spark, sf_dir, "labels"), "doc_id")
    return Cube(["lang"], [AUC("n_chars", "quality", name="auc")]).compute(df).pivoted()


@query("cube_bins_equal_width", """WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), e AS (SELECT [lo, lo + (hi - lo) * 1 / 4, lo + (hi - lo) * 2 / 4, lo + (hi - lo) * 3 / 4, hi] AS e FROM m)
SELECT """ + bins("c_acctbal", "e", 4) + """ AS c_acctbal_bin, count(*)::DOUBLE AS "count" FROM customer, e GROUP BY 1""")
def cube_bins_equal_width(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    return Cube([BinDimension("c_acctbal", EqualWidthBinner(4))]).fit_compute(df).pivoted()


FIXED = "CASE WHEN o_totalprice < 100000 THEN NULL WHEN o_totalprice <= 200000 THEN 'low' WHEN o_totalprice <= 300000 THEN 'mid' WHEN o_totalprice <= 400000 THEN 'high' END"


@query("cube_bins_fixed", f'SELECT {FIXED} AS band, count(*)::DOUBLE AS "count" FROM orders WHERE o_totalprice BETWEEN 100000 AND 400000 GROUP BY 1')
def cube_bins_fixed(spark, sf_dir):
    band = BinDimension("o_totalprice", FixedBinner([100000, 200000, 300000, 400000], ["low", "mid", "high"]), "band")
    return Cube([band]).compute(read(spark, sf_dir, "orders")).pivoted()


@query("cube_bins_fixed_out_of_range", f'SELECT {FIXED} AS band, count(*)::DOUBLE AS "count" FROM orders GROUP BY 1')
def cube_bins_fixed_out_of_range(spark, sf_dir):
    band = BinDimension("o_totalprice", FixedBinner([100000, 200000, 300000, 400000], ["low", "mid", "high"]), "band")
    return Cube([band], policy=ComputePolicy(MissingPolicy("keep"))).compute(read(spark, sf_dir, "orders")).pivoted()


@query("cube_bins_fit_field", f"""WITH q AS {five("lineitem", "l_extendedprice")} SELECT {bins("(l_quantity * 2000)", "e", 5)} AS x_bin, count(*)::DOUBLE AS "count" FROM lineitem, q GROUP BY 1""")
def cube_bins_fit_field(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") * 2000)
    return Cube([BinDimension("x", QuantileBinner(5), fit_field="l_extendedprice")]).fit_compute(df).pivoted()


@query("cube_bins_reference_current", f"""WITH q AS {five("orders", "o_totalprice", "o_orderdate < '1998-01-01'")} SELECT {bins("o_totalprice", "e", 5)} AS o_totalprice_bin, count(*)::DOUBLE AS "count" FROM orders, q WHERE o_orderdate >= '1998-01-01' GROUP BY 1""")
def cube_bins_reference_current(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    return Cube([BinDimension("o_totalprice", QuantileBinner(5))]).fit(ref).compute(cur).pivoted()


@query("cube_bins_fit_by", f"""WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM orders GROUP BY 1)
SELECT o_orderpriority, {bins("o_totalprice", "e", 4)} AS o_totalprice_bin, count(*)::DOUBLE AS "count" FROM orders JOIN q ON g = o_orderpriority GROUP BY 1, 2""")
def cube_bins_fit_by(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return Cube(["o_orderpriority", BinDimension("o_totalprice", QuantileBinner(4), fit_by="o_orderpriority")]).fit_compute(df).pivoted()


@query("cube_cross_bins", f"""WITH a AS {five("lineitem", "l_extendedprice")}, b AS (SELECT quantile_cont(l_tax, [0.0, 0.5, 1.0]) AS f FROM lineitem)
SELECT {bins("l_extendedprice", "e", 5)} AS price, {bins("l_tax", "f", 2)} AS tax, count(*)::DOUBLE AS "count" FROM lineitem, a, b GROUP BY 1, 2""")
def cube_cross_bins(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return Cube([BinDimension("l_extendedprice", QuantileBinner(5), "price"), BinDimension("l_tax", QuantileBinner(2), "tax")]).fit_compute(df).pivoted()


@query("cube_total_over", """SELECT o_orderstatus, count(*)::DOUBLE AS "count", round(count(*) / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1""")
def cube_total_over(spark, sf_dir):
    result = Cube(["o_orderstatus", "o_orderpriority"], [Count(), Share()]).compute(read(spark, sf_dir, "orders"), totals=True)
    return result.total(["o_orderpriority"]).pivoted()


@query("cube_layout_pivot", """SELECT (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS __order, o_orderpriority,
  count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS "F|count", count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE AS "O|count", count(*) FILTER (WHERE o_orderstatus = 'P')::DOUBLE AS "P|count" FROM orders GROUP BY 2""")
def cube_layout_pivot(spark, sf_dir):
    return Cube(["o_orderpriority", "o_orderstatus"]).compute(read(spark, sf_dir, "orders")).layout(["o_orderpriority"], ["o_orderstatus", "metric"])


@query("cube_layout_empty_cells", """WITH x AS (SELECT * FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority = '5-LOW')
SELECT (row_number() OVER (ORDER BY o_orderstatus) - 1)::INT AS __order, o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '5-LOW')::DOUBLE AS "5-LOW|count", count(*) FILTER (WHERE o_orderpriority = 'none')::DOUBLE AS "none|count",
  count(*) FILTER (WHERE o_orderpriority IN ('5-LOW', 'none'))::DOUBLE AS "Total|count" FROM x WHERE o_orderpriority IN ('5-LOW', 'none') GROUP BY 2""")
def cube_layout_empty_cells(spark, sf_dir):
    df = read(spark, sf_dir, "orders").filter("(o_orderstatus <> 'F' OR o_orderpriority = '5-LOW') AND o_orderpriority = '5-LOW'")
    cube = Cube(["o_orderstatus", ColumnDimension("o_orderpriority", categories=["5-LOW", "none"])])
    return cube.compute(df, totals=True).layout(["o_orderstatus"], ["o_orderpriority", "metric"], totals=True).filter("o_orderstatus <> 'Total'")


@query("cube_diagnostics", f"""SELECT kind, 'sum__value' AS metric, 'missing_propagated' AS reason, 'value' AS field, count(*) AS input_rows, count(*) FILTER (WHERE v IS NULL) AS affected_rows, NULL::VARCHAR AS dependency FROM {GAPPY} WHERE kind IS NOT NULL GROUP BY 1
UNION ALL SELECT kind, 'mean', 'upstream_missing', NULL, count(*), NULL, 'sum__value' FROM {GAPPY} WHERE kind IS NOT NULL GROUP BY 1
UNION ALL SELECT kind, 'none_rate', 'zero_denominator', NULL, count(*), NULL, 'none' FROM {GAPPY} WHERE kind IS NOT NULL GROUP BY 1""")
def cube_diagnostics(spark, sf_dir):
    measures = [Sum("value"), Count(), Ratio("sum__value", "count", "mean"), Count("none", where=Col("kind") == "nothing"), Ratio("count", "none", "none_rate")]
    return Cube(["kind"], measures).compute(gappy_events(spark, sf_dir)).diagnostics()


# -- funnels -----------------------------------------------------------------

STEPS = ["view", "click", "signup", "purchase"]


def funnel(spark, sf_dir, rates):
    e = read(spark, sf_dir, "events").withColumn("third", (F.col("user_id") % 3).cast("long"))
    stages = [Stage(s, where=Col("event_type") == s) for s in STEPS]
    return Cube(["third"], [Funnel(stages, "count", rates)]).compute(e).pivoted()


def funnel_sql(edges) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE event_type = '{s}')::DOUBLE AS {s}_count" for s in STEPS)
    rates = "".join(f", round({b}_count / {a}_count, 4) AS {a}_to_{b}_rate" for a, b in edges)
    return f"WITH a AS (SELECT user_id % 3 AS third, {counts} FROM events GROUP BY 1) SELECT third, {', '.join(f'{s}_count' for s in STEPS)}{rates} FROM a"


ADJACENT = list(zip(STEPS[:-1], STEPS[1:], strict=True))
FROM_FIRST = [(STEPS[0], s) for s in STEPS[1:]]
query("funnel_adjacent", funnel_sql(ADJACENT))(lambda spark, d: funnel(spark, d, "adjacent"))
query("funnel_from_first", funnel_sql(FROM_FIRST))(lambda spark, d: funnel(spark, d, "from_first"))
query("funnel_both", funnel_sql(list(dict.fromkeys([*ADJACENT, *FROM_FIRST]))))(lambda spark, d: funnel(spark, d, "both"))
query("funnel_transition", funnel_sql([("view", "purchase")]))(lambda spark, d: funnel(spark, d, [Transition("view", "purchase")]))


# -- comparisons -------------------------------------------------------------


def psi_sql(source: str, key: str, label: str, domain: str | None = None, least: int = 1) -> str:
    """PSI over rows ``side, key, label`` by the textbook formula over every bin."""
    return f"""WITH rows AS ({source}), k AS (SELECT DISTINCT {key} AS g FROM rows), b AS ({domain or f'SELECT DISTINCT {label} AS b FROM rows'}),
n AS (SELECT g, b.b, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS c FROM k CROSS JOIN b LEFT JOIN rows ON rows.{key} = k.g AND rows.{label} IS NOT DISTINCT FROM b.b GROUP BY 1, 2),
p AS (SELECT *, sum(r) OVER (PARTITION BY g) AS rr, sum(c) OVER (PARTITION BY g) AS cc FROM n),
e AS (SELECT *, greatest(r / nullif(rr, 0), 1e-8) AS p, greatest(c / nullif(cc, 0), 1e-8) AS q FROM p),
z AS (SELECT *, p / sum(p) OVER (PARTITION BY g) AS pp, q / sum(q) OVER (PARTITION BY g) AS qq FROM e)
SELECT g AS {key}, CASE WHEN max(rr) >= {least} AND max(cc) >= {least} THEN round(sum((qq - pp) * (ln(qq) - ln(pp))), 4) END AS psi FROM z GROUP BY 1"""


HALF = "(o_orderdate >= '1998-01-01')::INT"
TENTHS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
EDGES = f"(SELECT quantile_cont(o_totalprice, {TENTHS}) AS e FROM orders WHERE o_orderdate < '1998-01-01')"
TEN = "SELECT unnest(['B1', 'B2', 'B3', 'B4', 'B5', 'B6', 'B7', 'B8', 'B9', 'B10']) AS b"


def psi(spark, sf_dir, dims, measures, prepare=lambda df: df):
    ref, cur = halves(spark, sf_dir)
    return Cube(dims, measures).compute_comparison(prepare(ref), prepare(cur)).pivoted()


@query("psi_numeric", "SELECT psi FROM (" + psi_sql(f"SELECT {HALF} AS side, 1 AS one, {bins('o_totalprice', 'e', 10)} AS label FROM orders, {EDGES}", "one", "label", TEN) + ")")
def psi_numeric(spark, sf_dir):
    return psi(spark, sf_dir, [], [PSI("o_totalprice", name="psi")])


@query("psi_by_group", psi_sql(f"SELECT {HALF} AS side, o_orderpriority, {bins('o_totalprice', 'e', 10)} AS label FROM orders, {EDGES}", "o_orderpriority", "label", TEN))
def psi_by_group(spark, sf_dir):
    return psi(spark, sf_dir, ["o_orderpriority"], [PSI("o_totalprice", name="psi")])


@query("psi_categorical", psi_sql(f"SELECT {HALF} AS side, o_orderpriority, o_orderstatus AS label FROM orders", "o_orderpriority", "label"))
def psi_categorical(spark, sf_dir):
    return psi(spark, sf_dir, ["o_orderpriority"], [PSI("o_orderstatus", None, name="psi")])


def holes(df):
    return df.withColumn("x", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))


HOLED = f"(SELECT quantile_cont(o_totalprice, {TENTHS}) AS e FROM orders WHERE o_orderdate < '1998-01-01' AND o_orderkey % 5 <> 0)"
HOLE = "(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END)"


@query("psi_missing_bucket", psi_sql(f"SELECT {HALF} AS side, o_orderstatus, {bins(HOLE, 'e', 10)} AS label FROM orders, {HOLED}", "o_orderstatus", "label", TEN + " UNION ALL SELECT NULL"))
def psi_missing_bucket(spark, sf_dir):
    return psi(spark, sf_dir, ["o_orderstatus"], [PSI("x", name="psi")], holes)


@query("psi_missing_drop", psi_sql(f"SELECT {HALF} AS side, o_orderstatus, {bins(HOLE, 'e', 10)} AS label FROM orders, {HOLED} WHERE o_orderkey % 5 <> 0", "o_orderstatus", "label", TEN))
def psi_missing_drop(spark, sf_dir):
    return psi(spark, sf_dir, ["o_orderstatus"], [PSI("x", missing="drop", name="psi")], holes)


@query("psi_min_samples", psi_sql(f"SELECT {HALF} AS side, o_custkey % 50 AS g50, o_orderstatus AS label FROM orders", "g50", "label", least=155))
def psi_min_samples(spark, sf_dir):
    return psi(spark, sf_dir, ["g50"], [PSI("o_orderstatus", None, name="psi", min_samples=155)], lambda df: df.withColumn("g50", F.col("o_custkey") % 50))


@query("psi_one_sided_groups", psi_sql(f"SELECT {HALF} AS side, year(o_orderdate) AS y, o_orderstatus AS label FROM orders", "y", "label"))
def psi_one_sided_groups(spark, sf_dir):
    return psi(spark, sf_dir, ["y"], [PSI("o_orderstatus", None, name="psi")], lambda df: df.withColumn("y", F.year("o_orderdate").cast("long")))


@query("psi_multi_field", "SELECT o_orderstatus, a.psi AS price, b.psi AS priority FROM (" + psi_sql(f"SELECT {HALF} AS side, o_orderstatus, {bins('o_totalprice', 'e', 10)} AS label FROM orders, {EDGES}", "o_orderstatus", "label", TEN) + ") a JOIN (" + psi_sql(f"SELECT {HALF} AS side, o_orderstatus, o_orderpriority AS label FROM orders", "o_orderstatus", "label") + ") b USING (o_orderstatus)")
def psi_multi_field(spark, sf_dir):
    return psi(spark, sf_dir, ["o_orderstatus"], [PSI("o_totalprice", name="price"), PSI("o_orderpriority", None, name="priority")])


class RowDelta(ComparativeCalculation):
    """Current rows minus reference rows."""

    name = "row_delta"

    def evaluate(self, reference, current, keys):
        both = reference.select(*keys, F.lit(-1).alias("n")).unionByName(current.select(*keys, F.lit(1).alias("n")))
        return both.groupBy(*keys).agg(F.sum("n").cast("double").alias("value"))


@query("compare_row_delta", f"SELECT o_orderstatus, sum(2 * {HALF} - 1)::DOUBLE AS row_delta FROM orders GROUP BY 1")
def compare_row_delta(spark, sf_dir):
    return psi(spark, sf_dir, ["o_orderstatus"], [RowDelta()])


# -- data quality ------------------------------------------------------------


SCHEMA_SQL = "SELECT 'FAIL' AS status, unnest(['missing', 'extra', 'changed.o_totalprice']) AS item, unnest([1.0, 1.0, 2.0])::DOUBLE AS value"


def report(spark, checks, reference, current) -> DataFrame:
    """Check, status and a number or two worth comparing."""
    found = quality.DataQuality(checks).fit(reference).validate(current)
    rows = []
    for r in found.results:
        for key, value in r.observed.items():
            for inner, x in value.items() if isinstance(value, dict) else [("", value)]:
                if isinstance(x, (list, set, tuple)):
                    x = len(x)
                if x is None or isinstance(x, (int, float)):
                    rows.append((r.status.value, f"{key}.{inner}".rstrip("."), None if x is None else float(x)))
    return spark.createDataFrame(rows, "status string, item string, value double")


@query("dq_schema", SCHEMA_SQL)
def dq_schema(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return report(spark, [quality.SchemaCheck()], df, df.drop("o_custkey").withColumn("o_totalprice", F.col("o_totalprice").cast("string")).withColumn("extra", F.lit(1)))


@query("dq_row_count", f"WITH n AS (SELECT count(*) FILTER (WHERE {HALF} = 0) AS r, count(*) FILTER (WHERE {HALF} = 1) AS c FROM orders) SELECT CASE WHEN abs(c - r) / r > 0.1 THEN 'FAIL' ELSE 'PASS' END AS status, unnest(['rows', 'relative_change']) AS item, unnest([c::DOUBLE, round(abs(c - r) / r, 4)]) AS value FROM n")
def dq_row_count(spark, sf_dir):
    return report(spark, [quality.RowCountCheck(fail_relative_change=0.1)], *halves(spark, sf_dir))


@query("dq_missing_rate", f"WITH n AS (SELECT avg((v IS NULL)::INT) AS a, avg((kind IS NULL)::INT) AS b FROM {GAPPY}) SELECT 'FAIL' AS status, unnest(['value.rate', 'value.delta', 'kind.rate', 'kind.delta']) AS item, unnest([round(a, 4), round(a, 4), round(b, 4), round(b, 4)]) AS value FROM n")
def dq_missing_rate(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("kind", F.col("event_type"))
    return report(spark, [quality.MissingRateCheck(["value", "kind"], max_rate=0.15)], events, gappy_events(spark, sf_dir))


@query("dq_missing_like", "SELECT 'FAIL' AS status, unnest(['t.count', 't.rate']) AS item, unnest([n::DOUBLE, round(n / m, 4)]) AS value FROM (SELECT count(*) FILTER (WHERE event_id % 10 = 0) AS n, count(*) AS m FROM events)")
def dq_missing_like(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, " N/A\t").otherwise(F.col("event_type")).alias("t"))
    return report(spark, [quality.MissingLikeCheck(["t"])], df, df)


@query("dq_unique", """WITH g AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'FAIL' AS status, unnest(['rows', 'groups', 'examples']) AS item, unnest([sum(n)::DOUBLE, count(*)::DOUBLE, least(count(*), 10)::DOUBLE]) AS value FROM g""")
def dq_unique(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return report(spark, [quality.UniqueCheck(["o_custkey", "o_orderstatus"])], df, df)


@query("dq_category_set", "SELECT 'FAIL' AS status, unnest(['new', 'missing']) AS item, unnest([(SELECT count(DISTINCT event_type) FROM events WHERE event_type = 'error'), 0])::DOUBLE AS value")
def dq_category_set(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return report(spark, [quality.CategorySetCheck("event_type")], df.filter("event_type <> 'error'"), df)


@query("dq_cardinality", f"WITH n AS (SELECT count(DISTINCT o_custkey) FILTER (WHERE {HALF} = 0) AS r, count(DISTINCT o_custkey) FILTER (WHERE {HALF} = 1) AS c FROM orders) SELECT CASE WHEN abs(c - r) / r > 0.5 THEN 'FAIL' ELSE 'PASS' END AS status, unnest(['o_custkey.distinct', 'o_custkey.relative_change']) AS item, unnest([c::DOUBLE, round(abs(c - r) / r, 4)]) AS value FROM n")
def dq_cardinality(spark, sf_dir):
    return report(spark, [quality.CardinalityCheck(["o_custkey"], fail_change=0.5)], *halves(spark, sf_dir))


@query("dq_constant", """SELECT 'PASS' AS status, unnest(['o_orderstatus.dominant_rate', 'o_orderpriority.dominant_rate']) AS item,
  unnest([(SELECT round(max(n) / sum(n), 4) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)), (SELECT round(max(n) / sum(n), 4) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))]) AS value""")
def dq_constant(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return report(spark, [quality.ConstantCheck(["o_orderstatus", "o_orderpriority"], 0.9)], df, df)


@query("dq_numeric_convertible", "SELECT 'FAIL' AS status, unnest(['t.success_rate', 't.failed', 't.examples']) AS item, unnest([round(1 - n / m, 4), n::DOUBLE, least(n, 10)::DOUBLE]) AS value FROM (SELECT count(*) FILTER (WHERE event_id % 4 = 0) AS n, count(*) AS m FROM events)")
def dq_numeric_convertible(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 == 0, "1d").otherwise(F.col("value").cast("string")).alias("t"))
    return report(spark, [quality.NumericConvertibleCheck(["t"])], df, df)


@query("dq_finite", "SELECT 'FAIL' AS status, unnest(['x.nan', 'x.inf', 'x.-inf']) AS item, unnest([count(*) FILTER (WHERE event_id % 4 = 0), count(*) FILTER (WHERE event_id % 4 = 1), count(*) FILTER (WHERE event_id % 4 = 2)])::DOUBLE AS value FROM events")
def dq_finite(spark, sf_dir):
    m = F.col("event_id") % 4
    df = read(spark, sf_dir, "events").select(F.when(m == 0, float("nan")).when(m == 1, float("inf")).when(m == 2, float("-inf")).otherwise(F.col("value")).alias("x"))
    return report(spark, [quality.FiniteCheck(["x"])], df, df)


@query("dq_range", "SELECT 'FAIL' AS status, unnest(['outside', 'known']) AS item, unnest([count(*) FILTER (WHERE l_quantity < 5 OR l_quantity >= 50), count(*)])::DOUBLE AS value FROM lineitem")
def dq_range(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return report(spark, [quality.RangeCheck("l_quantity", 5, 50, "left")], df, df)


@query("dq_profile", """WITH s AS (SELECT count(*)::DOUBLE AS count, count(DISTINCT c_acctbal)::DOUBLE AS nunique, min(c_acctbal) AS min, max(c_acctbal) AS max, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std,
  quantile_cont(c_acctbal, 0.01) AS q01, quantile_cont(c_acctbal, 0.5) AS q50, quantile_cont(c_acctbal, 0.99) AS q99, count(*) FILTER (WHERE c_acctbal = 0)::DOUBLE AS zero_count, 0.0::DOUBLE AS missing FROM customer)
SELECT item, round(value, 4) AS value FROM s UNPIVOT (value FOR item IN (count, nunique, min, max, mean, std, q01, q50, q99, zero_count, missing))""")
def dq_profile(spark, sf_dir):
    stats = quality.DataProfile.from_frame(read(spark, sf_dir, "customer")).columns["c_acctbal"]
    wanted = ("count", "nunique", "min", "max", "mean", "std", "q01", "q50", "q99", "zero_count", "missing")
    return spark.createDataFrame([(k, float(stats[k])) for k in wanted], "item string, value double")


# -- preparation -------------------------------------------------------------


def prepared(step, df, keep) -> DataFrame:
    return prep.DataPrep([step]).fit_transform(df).select(*keep)


@query("prep_to_numeric", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round(value, 4) END AS t FROM events")
def prep_to_numeric(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("t"))
    return prepared(prep.ToNumeric("t", "coerce"), df, ["event_id", "t"])


@query("prep_to_datetime", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def prep_to_datetime(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    return prepared(prep.ToDatetime("d", format="%d/%m/%Y"), df, ["o_orderkey", "d"]).withColumn("d", F.date_format("d", "yyyy-MM-dd"))


@query("prep_value_mapper", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS o_orderstatus FROM orders")
def prep_value_mapper(spark, sf_dir):
    return prepared(prep.ValueMapper("o_orderstatus", {"F": "final", "O": "open"}, "value", "other"), read(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"])


@query("prep_clip", "SELECT p_partkey, least(greatest(p_size, 10), 40) AS p_size, round(least(p_retailprice, 1200.5), 4) AS p_retailprice FROM part")
def prep_clip(spark, sf_dir):
    df = prep.Clip("p_size", 10, 40).transform(read(spark, sf_dir, "part"))
    return prep.Clip("p_retailprice", upper=1200.5).transform(df).select("p_partkey", "p_size", "p_retailprice")


@query("prep_log", "SELECT o_orderkey, round(ln(o_totalprice), 4) AS logged FROM orders")
def prep_log(spark, sf_dir):
    return prepared(prep.LogTransform("o_totalprice", "logged"), read(spark, sf_dir, "orders").filter("o_totalprice > 0"), ["o_orderkey", "logged"])


@query("prep_logit", "WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_discount, 0.001), 0.999) AS p FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(ln(p) - ln(1 - p), 4) AS l_discount FROM c")
def prep_logit(spark, sf_dir):
    return prepared(prep.LogitTransform("l_discount", eps=0.001), read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_discount"])


def impute(name: str, strategy: str, fill_sql: str, **options) -> None:
    indicator = ", (v IS NULL)::INT AS value_missing" if options.get("add_indicator") else ""
    keep = ["event_id", "value"] + (["value_missing"] if indicator else [])
    query(name, f"SELECT event_id, round(coalesce(v, {fill_sql}), 4) AS value{indicator} FROM {GAPPY}")(lambda spark, d: prepared(prep.MissingImputer("value", strategy, **options), gappy_events(spark, d), keep))


impute("prep_impute_mean", "mean", f"(SELECT avg(v) FROM {GAPPY})")
impute("prep_impute_median", "median", f"(SELECT median(v) FROM {GAPPY})")
impute("prep_impute_mode", "most_frequent", f"(SELECT v FROM {GAPPY} WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)")
impute("prep_impute_constant", "constant", "-1.5", fill_value=-1.5)
impute("prep_impute_indicator", "mean", f"(SELECT avg(v) FROM {GAPPY})", add_indicator=True)


@query("prep_kbins_quantile", """WITH r AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) AS i, count(*) OVER () AS n FROM customer),
e AS (SELECT k, CASE WHEN (max(n) * k) % 4 = 0 AND k < 4 THEN (max(x) FILTER (WHERE i = n * k // 4) + max(x) FILTER (WHERE i = n * k // 4 + 1)) / 2 ELSE max(x) FILTER (WHERE i = ceil(n * k / 4.0)) END AS e FROM r, (SELECT unnest([1, 2, 3]) AS k) GROUP BY k)
SELECT c_custkey, (SELECT count(*) FROM e WHERE e.e <= c_acctbal)::INT AS c_acctbal FROM customer""")
def prep_kbins_quantile(spark, sf_dir):
    return prepared(prep.KBins("c_acctbal", 4), read(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal"])


@query("prep_kbins_uniform", """WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, (CASE WHEN c_acctbal < lo + (hi - lo) * 1 / 3 THEN 0 WHEN c_acctbal < lo + (hi - lo) * 2 / 3 THEN 1 ELSE 2 END)::INT AS c_acctbal FROM customer, m""")
def prep_kbins_uniform(spark, sf_dir):
    return prepared(prep.KBins("c_acctbal", 3, "uniform"), read(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal"])


@query("prep_kbins_onehot", """WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, (c_acctbal < lo + (hi - lo) * 1 / 2)::INT AS c_acctbal_0, (c_acctbal >= lo + (hi - lo) * 1 / 2)::INT AS c_acctbal_1 FROM customer, m""")
def prep_kbins_onehot(spark, sf_dir):
    return prepared(prep.KBins("c_acctbal", 2, "uniform", "onehot"), read(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal_0", "c_acctbal_1"])


@query("prep_standard_scale", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 4) AS p_retailprice FROM part")
def prep_standard_scale(spark, sf_dir):
    return prepared(prep.StandardScaler("p_retailprice"), read(spark, sf_dir, "part"), ["p_partkey", "p_retailprice"])


@query("prep_robust_scale", "WITH q AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part) SELECT p_partkey, round((p_retailprice - q[2]) / (q[3] - q[1]), 4) AS p_retailprice FROM part, q")
def prep_robust_scale(spark, sf_dir):
    return prepared(prep.RobustScaler("p_retailprice"), read(spark, sf_dir, "part"), ["p_partkey", "p_retailprice"])


@query("prep_minmax", "WITH q AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 4) AS p_retailprice FROM part, q")
def prep_minmax(spark, sf_dir):
    return prepared(prep.MinMaxScaler("p_retailprice"), read(spark, sf_dir, "part"), ["p_partkey", "p_retailprice"])


@query("prep_onehot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders")
def prep_onehot(spark, sf_dir):
    return prepared(prep.OneHotEncoder("o_orderstatus"), read(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P"])


@query("prep_ordinal", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS o_orderpriority FROM orders")
def prep_ordinal(spark, sf_dir):
    return prepared(prep.OrdinalEncoder("o_orderpriority"), read(spark, sf_dir, "orders"), ["o_orderkey", "o_orderpriority"])


@query("prep_vocabulary", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type))::INT AS code FROM part")
def prep_vocabulary(spark, sf_dir):
    return prepared(prep.VocabularyEncoder("p_type", "code"), read(spark, sf_dir, "part"), ["p_partkey", "code"])


@query("prep_woe", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 35 THEN 2 ELSE 3 END AS b, (l_linestatus = 'F')::INT AS t FROM lineitem),
c AS (SELECT b, sum(t) AS e, sum(1 - t) AS o FROM b GROUP BY 1), w AS (SELECT b, ln((o / (SELECT sum(o) FROM c)) / (e / (SELECT sum(e) FROM c))) AS w FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round(w, 4) AS woe FROM b JOIN w USING (b)""")
def prep_woe(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("t", (F.col("l_linestatus") == "F").cast("int"))
    return prepared(prep.WoeBinning("l_quantity", "t", edges=[15, 35], output_column="woe"), df, ["l_orderkey", "l_linenumber", "l_partkey", "woe"])


@query("prep_pipeline", f"""WITH f AS (SELECT event_id, coalesce(v, (SELECT avg(v) FROM {GAPPY})) AS x, coalesce(kind, 'none') AS kind FROM {GAPPY}), c AS (SELECT event_id, kind, least(x, 60) AS x FROM f), m AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM c)
SELECT event_id, kind, round((x - m) / s, 4) AS value FROM c, m""")
def prep_pipeline(spark, sf_dir):
    steps = [prep.MissingImputer("value", "mean"), prep.MissingImputer("kind", "constant", "none"), prep.Clip("value", upper=60), prep.StandardScaler("value")]
    return prep.DataPrep(steps).fit_transform(gappy_events(spark, sf_dir)).select("event_id", "kind", "value")


@query("prep_audit", f"SELECT 'missingimputer' AS step, count(*) FILTER (WHERE v IS NULL) AS missing_before, 0::BIGINT AS missing_after, count(*) FILTER (WHERE v IS NULL) AS imputed FROM {GAPPY}")
def prep_audit(spark, sf_dir):
    df = gappy_events(spark, sf_dir)
    audit = prep.DataPrep([prep.MissingImputer("value", "mean")]).fit(df).run(df).audits[0]
    return spark.createDataFrame([(audit.step, audit.before["missing"]["value"], audit.after["missing"]["value"], audit.details["value.imputed"])], "step string, missing_before long, missing_after long, imputed long")


@query("workflow_run", """WITH m AS (SELECT avg(least(o_totalprice, 400000)) AS m, stddev_pop(least(o_totalprice, 400000)) AS s FROM orders WHERE o_orderdate < '1998-01-01')
SELECT o_orderkey, round((least(o_totalprice, 400000) - m) / s, 4) AS o_totalprice FROM orders, m WHERE o_orderdate >= '1998-01-01'""")
def workflow_run(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    flow = DataWorkflow([
        QualityStage("raw", quality.DataQuality([quality.SchemaCheck(), quality.MissingRateCheck(max_rate=0.0), quality.RangeCheck("o_totalprice", 0)])),
        PrepStage("prepare", prep.DataPrep([prep.Clip("o_totalprice", upper=400000), prep.StandardScaler("o_totalprice")])),
        QualityStage("prepared", quality.DataQuality([quality.FiniteCheck(["o_totalprice"])]), "warn"),
    ])
    return flow.fit(ref).run(cur).data.select("o_orderkey", "o_totalprice")


# -- splits, registry, evaluation, streams -----------------------------------

THREE = {"train": PartitionSpec(0.6), "valid": PartitionSpec(0.2), "test": PartitionSpec(0.2)}


@query("split_hash", """WITH h AS (SELECT o_orderkey, ('0x' || substr(sha256('2026' || chr(31) || o_custkey::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS p FROM orders)
SELECT o_orderkey, CASE WHEN p < 0.6 - 1e-12 THEN 'train' WHEN p < 0.8 - 1e-12 THEN 'valid' ELSE 'test' END AS "partition" FROM h""")
def split_hash(spark, sf_dir):
    return SplitSpec(HashSplitter(("o_custkey",)), THREE).assign(read(spark, sf_dir, "orders")).select("o_orderkey", "partition")


@query("split_column", """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'train' WHEN o_orderstatus = 'P' THEN 'test' END AS "partition" FROM orders""")
def split_column(spark, sf_dir):
    spec = SplitSpec(ColumnSplitter("o_orderstatus"), {"train": PartitionSpec(values=("F", "O")), "test": PartitionSpec(values=("P",))})
    return spec.assign(read(spark, sf_dir, "orders")).select("o_orderkey", "partition")


@query("split_time", """WITH r AS (SELECT o_orderkey, (rank() OVER (ORDER BY o_orderdate) - 1) / count(*) OVER () AS p FROM orders)
SELECT o_orderkey, CASE WHEN p < 0.6 - 1e-12 THEN 'train' WHEN p < 0.8 - 1e-12 THEN 'valid' ELSE 'test' END AS "partition" FROM r""")
def split_time(spark, sf_dir):
    return SplitSpec(TimeSplitter("o_orderdate"), THREE).assign(read(spark, sf_dir, "orders")).select("o_orderkey", "partition")


@query("split_random_stratified", """WITH s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderstatus, ceil(round(n * 0.6, 6))::BIGINT AS train, (ceil(round(n * 0.8, 6)) - ceil(round(n * 0.6, 6)))::BIGINT AS valid, (n - ceil(round(n * 0.8, 6)))::BIGINT AS test FROM s""")
def split_random_stratified(spark, sf_dir):
    split = SplitSpec(RandomSplitter(stratify="o_orderstatus"), THREE).assign(read(spark, sf_dir, "orders"))
    return split.groupBy("o_orderstatus").agg(*[F.count_if(F.col("partition") == p).alias(p) for p in THREE])


@query("eval_log_loss", "SELECT round(-avg(CASE WHEN o_orderstatus = 'F' THEN ln(p) ELSE ln(1 - p) END), 4) AS log_loss FROM (SELECT o_orderstatus, least(greatest(o_totalprice / 1000000, 1e-15), 1 - 1e-15) AS p FROM orders)")
def eval_log_loss(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("t"), (F.col("o_totalprice") / 1000000).alias("p"))
    return spark.createDataFrame([(log_loss(df, "t", "p"),)], "log_loss double")


@query("importance_ranks", "SELECT p_partkey, rank() OVER (ORDER BY p_retailprice DESC)::INT AS gain_rank, rank() OVER (ORDER BY p_size DESC)::INT AS split_rank FROM part")
def importance(spark, sf_dir):
    return ranked_parts(read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("gain"), F.col("p_size").alias("split")))


def ranked_parts(df):
    return importance_ranks(df).select("p_partkey", F.col("gain_rank").cast("int"), F.col("split_rank").cast("int"))


def sample_registry(root: str, sf_dir: str, spark: SparkSession) -> Registry:
    registry = Registry(root)
    n = read(spark, sf_dir, "orders").count()
    for name, config, auc in (("base", {"rate": 0.1, "deep": {"a": 1}}, 0.6), ("tuned", {"rate": 0.05, "deep": {"a": 1, "b": 2}}, 0.7)):
        with registry.start_run(name, config=config) as run:
            run.log_metrics({"train": {"auc": auc}, "test": {"auc": auc - 0.05, "rows": n}})
    return registry


@query("registry_compare", """SELECT unnest(['base', 'tuned']) AS name, 'completed' AS status, unnest([0.55, 0.65]) AS test_auc, (SELECT count(*) FROM orders)::DOUBLE AS test_rows, unnest([0.6, 0.7]) AS train_auc""")
def registry_compare(spark, sf_dir):
    with tempfile.TemporaryDirectory() as root:
        out = sample_registry(root, sf_dir, spark).compare(spark)
    return out.select("name", "status", F.col("`test.auc`").alias("test_auc"), F.col("`test.rows`").alias("test_rows"), F.col("`train.auc`").alias("train_auc"))


@query("registry_compare_params", """SELECT unnest(['deep.b', 'rate']) AS "key", unnest([NULL, '0.1']) AS "left", unnest(['2', '0.05']) AS "right", unnest([false, true]) AS in_left, true AS in_right, unnest(['added', 'modified']) AS change""")
def registry_compare_params(spark, sf_dir):
    with tempfile.TemporaryDirectory() as root:
        return sample_registry(root, sf_dir, spark).compare_params(spark, "base", "tuned")


@query("stream_windowed_cube", """SELECT time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, event_type, count(*)::DOUBLE AS "count", round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windowed_cube(spark, sf_dir):
    """The windows a stream would emit, over the whole table at once."""
    out = windowed_cube(read(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], [Count(), Sum("value", "total")])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "count", "total")


from . import queries_declared  # noqa: E402, F401  registers the rest
