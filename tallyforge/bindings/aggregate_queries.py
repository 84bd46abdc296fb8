"""Aggregates, conditional aggregates, pivots, KPIs, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import ranking, rows, scenario
from .common import LINES, SALES, lines, rounded, sales, stacked, table

BINDINGS = {}


def summarize_flags(spark, d):
    big = rows.apply_filters(
        table(spark, d, "lineitem"), [{"field": "l_quantity", "operator": "gte", "value": 10}]
    )
    out = agg.summarize(big, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"total": "sum"})
    return rounded(out, "total")


BINDINGS["summarize_flags"] = (
    summarize_flags,
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total
       FROM lineitem WHERE l_quantity >= 10 GROUP BY 1, 2""",
)


def summarize_metrics(spark, d):
    metrics = {
        "total": "sum", "mean": "average", "n": "count", "low": "min", "high": "max",
        "middle": "median",
    }
    out = agg.summarize(sales(spark, d), ["c_mktsegment", "o_orderstatus"], "o_totalprice", metrics, 12)
    return rounded(out, "total", "mean", "middle", digits=3)


BINDINGS["summarize_metrics"] = (
    summarize_metrics,
    f"""WITH {SALES} SELECT c_mktsegment, o_orderstatus, round(sum(o_totalprice), 3) AS total,
          round(avg(o_totalprice), 3) AS mean, count(o_totalprice) AS n, min(o_totalprice) AS low,
          max(o_totalprice) AS high, round(median(o_totalprice), 3) AS middle
        FROM sales GROUP BY 1, 2 ORDER BY sum(o_totalprice) DESC, 1, 2 LIMIT 12""",
)


def agg_metrics(spark, d):
    names = ["sum", "average", "count", "counta", "min", "max", "median", "variance"]
    out = agg.aggregate(table(spark, d, "orders"), "o_totalprice", names)
    scaled = F.when(F.col("metric") == "variance", F.col("value") / 1e6).otherwise(F.col("value"))
    return out.select("metric", F.round(scaled, 2).alias("value"))


BINDINGS["agg_metrics"] = (
    agg_metrics,
    stacked(
        """WITH a AS (SELECT sum(o_totalprice) s, avg(o_totalprice) m, count(o_totalprice) n,
             min(o_totalprice) lo, max(o_totalprice) hi, median(o_totalprice) md,
             var_pop(o_totalprice) / 1e6 v FROM orders)""",
        "metric", "value",
        {"sum": "round(s, 2)", "average": "round(m, 2)", "count": "n", "counta": "n", "min": "lo",
         "max": "hi", "median": "round(md, 2)", "variance": "round(v, 2)"},
        "a",
    ),
)

BINDINGS["agg_grouped_median"] = (
    lambda spark, d: rounded(
        agg.calculate(table(spark, d, "lineitem"), "l_extendedprice", "median", "l_suppkey"),
        "median", digits=3,
    ),
    """SELECT l_suppkey, round(median(l_extendedprice), 3) AS median
       FROM lineitem GROUP BY 1""",
)

BINDINGS["agg_grouped_variance"] = (
    lambda spark, d: rounded(
        agg.calculate(table(spark, d, "lineitem"), "l_quantity", "variance", "l_returnflag"),
        "variance", digits=4,
    ),
    """SELECT l_returnflag, round(var_pop(l_quantity), 4) AS variance
       FROM lineitem GROUP BY 1""",
)

BINDINGS["agg_distinct"] = (
    lambda spark, d: agg.summarize(
        table(spark, d, "orders"), "o_orderstatus", "o_custkey", {"customers": "nunique"}
    ),
    "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
)


def two_column_metrics(spark, d):
    return rounded(agg.two_column_metrics(lines(spark, d), "revenue", "cost"),
                   "difference", "percentage", "growth")


BINDINGS["two_column_metrics"] = (
    two_column_metrics,
    f"""WITH {LINES} SELECT round(sum(revenue - cost), 2) AS difference,
          round(100 * sum(revenue) / sum(cost), 2) AS percentage,
          round(100 * (sum(revenue) - sum(cost)) / abs(sum(cost)), 2) AS growth FROM lines""",
)

BINDINGS["contribution"] = (
    lambda spark, d: rounded(
        agg.contribution(table(spark, d, "orders"), "o_totalprice", "o_orderpriority"),
        "sum", "contribution_pct",
    ),
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum,
              round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 2) AS contribution_pct
       FROM orders GROUP BY 1""",
)

BINDINGS["compare_groups"] = (
    lambda spark, d: rounded(
        agg.compare(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "average"),
        "average", digits=4,
    ),
    """SELECT o_orderstatus, round(avg(o_totalprice), 4) AS average FROM orders GROUP BY 1""",
)


def compare_values(spark, d):
    out = agg.compare_values(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return rounded(out, *out.columns)


BINDINGS["compare_values"] = (
    compare_values,
    """WITH s AS (SELECT sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS l,
                         sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS r FROM orders)
       SELECT round(l, 2) AS left_value, round(r, 2) AS right_value, round(l - r, 2) AS absolute,
              round(100 * (l - r) / abs(r), 2) AS percentage,
              round(100 * (l - r) / abs(r), 2) AS growth_pct, round(l / r, 2) AS ratio FROM s""",
)

BINDINGS["sumif"] = (
    lambda spark, d: rounded(
        agg.sumif(table(spark, d, "lineitem"), "l_returnflag", "r", "l_extendedprice"), "value"
    ),
    """SELECT round(sum(l_extendedprice), 2) AS value, count(*) AS matched_rows
       FROM lineitem WHERE lower(l_returnflag) = 'r'""",
)

BINDINGS["sumifs"] = (
    lambda spark, d: rounded(
        agg.sumifs(
            table(spark, d, "lineitem"), "l_extendedprice",
            [{"column": "l_returnflag", "value": "A"},
             {"column": "l_quantity", "op": ">", "value": 30}],
        ),
        "value",
    ),
    """SELECT round(sum(l_extendedprice), 2) AS value, count(*) AS matched_rows
       FROM lineitem WHERE lower(l_returnflag) = 'a' AND l_quantity > 30""",
)

BINDINGS["countif"] = (
    lambda spark, d: agg.countif(table(spark, d, "part"), "p_name", "widget", "contains"),
    """SELECT count(*) AS value, count(*) AS matched_rows FROM part
       WHERE regexp_matches(p_name, 'widget', 'i')""",
)

BINDINGS["countifs"] = (
    lambda spark, d: agg.countifs(
        table(spark, d, "lineitem"),
        [{"column": "l_linestatus", "value": "o"}, {"column": "l_discount", "op": "<=", "value": 0.03}],
    ),
    """SELECT count(*) AS value, count(*) AS matched_rows FROM lineitem
       WHERE lower(l_linestatus) = 'o' AND l_discount <= 0.03""",
)

BINDINGS["averageif"] = (
    lambda spark, d: rounded(
        agg.averageif(table(spark, d, "lineitem"), "l_quantity", 40, "l_extendedprice", "<"), "value", digits=3
    ),
    """SELECT round(avg(l_extendedprice), 3) AS value, count(*) AS matched_rows
       FROM lineitem WHERE l_quantity < 40""",
)


def conditional_board(spark, d):
    li = table(spark, d, "lineitem")
    cases = {
        "returned_value": (F.col("l_returnflag") == "R", "l_extendedprice", "sum"),
        "open_lines": (F.col("l_linestatus") == "O", None, "count"),
        "bulk_discount": (F.col("l_quantity") > 40, "l_discount", "average"),
    }
    return rounded(agg.conditional_board(li, cases), "value", digits=4)


BINDINGS["conditional_board"] = (
    conditional_board,
    stacked(
        """WITH a AS (SELECT sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R') x,
             count(*) FILTER (WHERE l_linestatus = 'O') y,
             avg(l_discount) FILTER (WHERE l_quantity > 40) z FROM lineitem)""",
        "name", "value",
        {"returned_value": "round(x, 4)", "open_lines": "y", "bulk_discount": "round(z, 4)"}, "a",
    ),
)


def pivot_status_priority(spark, d):
    out = agg.pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return rounded(out, "F", "O", "P")


BINDINGS["pivot_status_priority"] = (
    pivot_status_priority,
    """SELECT o_orderpriority,
         round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS "F",
         round(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0), 2) AS "O",
         round(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0), 2) AS "P"
       FROM orders GROUP BY 1""",
)


def pivot_median(spark, d):
    out = agg.pivot(
        table(spark, d, "lineitem"), "l_linenumber", ["l_returnflag", "l_linestatus"],
        "l_extendedprice", "median",
    )
    return rounded(out, *out.columns[1:], digits=3)


def _cell(flag: str, status: str) -> str:
    test = f"l_returnflag = '{flag}' AND l_linestatus = '{status}'"
    return (
        f"round(coalesce(median(CASE WHEN {test} THEN l_extendedprice END), 0), 3)"
        f' AS "{flag}_{status}"'
    )


BINDINGS["pivot_median"] = (
    pivot_median,
    "SELECT l_linenumber, "
    + ", ".join(_cell(f, s) for f in "ANR" for s in "FO")
    + " FROM lineitem GROUP BY 1",
)

BINDINGS["pivot_rows_only"] = (
    lambda spark, d: rounded(
        agg.pivot(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], None, "o_totalprice", "mean"),
        "mean", digits=3,
    ),
    """SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 3) AS mean
       FROM orders GROUP BY 1, 2""",
)

BINDINGS["chart_top_segments"] = (
    lambda spark, d: rounded(
        ranking.chart_series(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "sum", 3), "sum"
    ),
    """SELECT c_mktsegment, round(sum(c_acctbal), 2) AS sum FROM customer
       GROUP BY 1 ORDER BY sum(c_acctbal) DESC, 1 LIMIT 3""",
)

BINDINGS["kpi_cards"] = (
    lambda spark, d: rounded(
        agg.kpis(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), "value", digits=3
    ),
    stacked(
        """WITH a AS (SELECT count(*) n, sum(l_quantity) q, avg(l_quantity) aq,
             sum(l_extendedprice) p, avg(l_extendedprice) ap FROM lineitem)""",
        "kpi", "value",
        {"Records": "n", "Total l_quantity": "q", "Avg l_quantity": "round(aq, 3)",
         "Total l_extendedprice": "round(p, 3)", "Avg l_extendedprice": "round(ap, 3)"}, "a",
    ),
)


def _key_metric(table_name: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", round(sum({column}), 2) AS total,"
        f" round(avg({column}), 3) AS average, round(median({column}), 3) AS median,"
        f" CAST(min({column}) AS double) AS min, CAST(max({column}) AS double) AS max"
        f" FROM {table_name}"
    )


LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)


def key_metrics(spark, d):
    out = agg.key_metrics(table(spark, d, "lineitem"))
    return rounded(rounded(out, "total"), "average", "median", digits=3)


BINDINGS["key_metrics"] = (
    key_metrics,
    "\nUNION ALL ".join(
        _key_metric("lineitem", c) for c in LINE_NUMBERS
    ),
)


def descriptive(spark, d):
    out = agg.descriptive(table(spark, d, "lineitem"), "l_extendedprice")
    scaled = F.when(F.col("statistic") == "variance", F.col("value") / 1e6).otherwise(F.col("value"))
    return out.select("statistic", F.round(scaled, 3).alias("value"))


BINDINGS["descriptive"] = (
    descriptive,
    stacked(
        """WITH a AS (SELECT count(l_extendedprice) n, avg(l_extendedprice) m,
             median(l_extendedprice) md, min(l_extendedprice) lo, max(l_extendedprice) hi,
             stddev_samp(l_extendedprice) sd, var_samp(l_extendedprice) / 1e6 v,
             quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3
             FROM lineitem)""",
        "statistic", "value",
        {"count": "n", "mean": "round(m, 3)", "median": "round(md, 3)", "min": "lo", "max": "hi",
         "std": "round(sd, 3)", "variance": "round(v, 3)", "q1": "round(q1, 3)",
         "q3": "round(q3, 3)", "range": "round(hi - lo, 3)"}, "a",
    ),
)

BINDINGS["correlation"] = (
    lambda spark, d: agg.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"),
    """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
       SELECT 'l_quantity' AS field_a, 'l_extendedprice' AS field_b, round(r, 4) AS correlation,
              CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
                   ELSE 'weak' END AS strength,
              CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM c""",
)

BINDINGS["unique_values"] = (
    lambda spark, d: agg.unique_values(table(spark, d, "part"), "p_type"),
    "SELECT p_type, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY 1",
)

BINDINGS["scenario"] = (
    lambda spark, d: scenario.scenario(
        table(spark, d, "orders"), "o_totalprice", 7, group_by="o_orderstatus"
    ),
    """WITH b AS (SELECT o_orderstatus, sum(o_totalprice) AS base FROM orders GROUP BY 1)
       SELECT o_orderstatus, format('{:+d}%', CAST(p AS bigint)) AS scenario,
              CAST(p AS double) AS change_pct, round(base * (1 + p / 100.0), 2) AS value,
              round(base * (1 + p / 100.0) - base, 2) AS difference,
              CAST(p AS double) AS difference_pct
       FROM b CROSS JOIN (VALUES (-10), (-5), (0), (5), (7), (10)) AS s(p)""",
)


def actual_vs_target(spark, d):
    orders = sales(spark, d)
    this_year = orders.filter((F.year("o_orderdate") == 1998))
    last_year = orders.filter((F.year("o_orderdate") == 1997)).withColumn(
        "goal", F.col("o_totalprice") * 1.05
    )
    out = scenario.actual_vs_target(this_year, last_year, "c_mktsegment", "o_totalprice", "goal")
    return rounded(out, "actual", "target", "variance")


BINDINGS["actual_vs_target"] = (
    actual_vs_target,
    f"""WITH {SALES},
       a AS (SELECT c_mktsegment, sum(o_totalprice) AS actual FROM sales
             WHERE year(o_orderdate) = 1998 GROUP BY 1),
       t AS (SELECT c_mktsegment, sum(o_totalprice * 1.05) AS target FROM sales
             WHERE year(o_orderdate) = 1997 GROUP BY 1),
       j AS (SELECT a.c_mktsegment, actual, coalesce(target, 0.0) AS target
             FROM a LEFT JOIN t USING (c_mktsegment))
       SELECT c_mktsegment, round(actual, 2) AS actual, round(target, 2) AS target,
              round(actual - target, 2) AS variance,
              round(coalesce(100 * (actual - target) / nullif(abs(target), 0), 0), 2) AS variance_pct,
              round(coalesce(100 * actual / nullif(target, 0), 0), 2) AS achievement_pct,
              CASE WHEN 100 * actual / nullif(target, 0) >= 100 THEN 'Excellent'
                   WHEN 100 * actual / nullif(target, 0) >= 90 THEN 'On Track'
                   WHEN 100 * actual / nullif(target, 0) >= 75 THEN 'Watch'
                   ELSE 'Critical' END AS status FROM j""",
)

PNL_SQL = stacked(
    f"WITH {LINES}, a AS (SELECT sum(revenue) r, sum(cost) c FROM lines)",
    "metric", "value",
    {"Revenue": "round(r, 2)", "Cost": "round(c, 2)", "Gross Profit": "round(r - c, 2)",
     "Gross Margin %": "round(100 * (r - c) / r, 2)"}, "a",
)

BINDINGS["pnl"] = (
    lambda spark, d: rounded(scenario.pnl(lines(spark, d), "revenue", "cost"), "value"),
    PNL_SQL,
)


def variance_rows(spark, d):
    out = scenario.variance_rows(lines(spark, d), "revenue", "cost")
    out = out.select("l_orderkey", "l_linenumber", "variance", "variance_pct")
    return rounded(out, "variance", digits=4)


VARIANCE_SQL = f"""WITH {LINES} SELECT l_orderkey, l_linenumber,
    round(revenue - cost, 4) AS variance,
    round(100 * (revenue - cost) / nullif(abs(cost), 0), 2) AS variance_pct FROM lines"""

BINDINGS["variance_rows"] = (variance_rows, VARIANCE_SQL)

BINDINGS["variance_total"] = (
    lambda spark, d: rounded(
        scenario.variance_total(lines(spark, d), "revenue", "cost"), "total_variance"
    ),
    f"WITH {LINES} SELECT round(sum(revenue - cost), 2) AS total_variance FROM lines",
)

ROLES = {"revenue": "revenue", "cost": "cost", "discount": "discount"}


def derived_measures(spark, d):
    out = agg.derived_measures(lines(spark, d), ROLES, group_by="l_returnflag")
    return rounded(rounded(out, "profit", "aov"), "profit_margin", "discount_pct", digits=6)


BINDINGS["derived_measures"] = (
    derived_measures,
    f"""WITH {LINES} SELECT l_returnflag, round(sum(revenue - cost), 2) AS profit,
          round(sum(revenue - cost) / sum(revenue), 6) AS profit_margin,
          round(sum(revenue) / count(*), 2) AS aov, CAST(count(*) AS double) AS orders,
          round(sum(discount) / sum(revenue), 6) AS discount_pct FROM lines GROUP BY 1""",
)


def derived_rows(spark, d):
    li = lines(spark, d)
    names = ["profit", "profit_margin", "aov", "discount_pct"]
    cols = [agg.measure_column(li, n, ROLES).alias(n) for n in names]
    return rounded(li.select("l_orderkey", "l_linenumber", *cols), *names, digits=4)


BINDINGS["derived_rows"] = (
    derived_rows,
    f"""WITH {LINES} SELECT l_orderkey, l_linenumber, round(revenue - cost, 4) AS profit,
          round((revenue - cost) / nullif(revenue, 0), 4) AS profit_margin,
          round(revenue, 4) AS aov, round(discount / nullif(revenue, 0), 4) AS discount_pct
        FROM lines""",
)
