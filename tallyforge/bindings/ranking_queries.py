"""Rankings, Pareto, running totals, periods, growth, year-to-date, outliers."""

from __future__ import annotations

from ..operators import outliers as out_ops
from ..operators import ranking, timeseries
from .common import SALES, rounded, sales, table

BINDINGS = {}

BINDINGS["running_total"] = (
    lambda spark, d: rounded(
        ranking.running_total(table(spark, d, "lineitem"), "l_extendedprice", "l_suppkey"),
        "sum", "running_total",
    ),
    """WITH g AS (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1)
       SELECT l_suppkey, round(v, 2) AS sum,
              round(sum(v) OVER (ORDER BY v, l_suppkey ROWS UNBOUNDED PRECEDING), 2) AS running_total
       FROM g""",
)


def ranked_sql(source: str, key: str, value: str, direction: str, n: int, name: str, agg="sum") -> str:
    return f"""WITH g AS (SELECT {key}, {agg}({value}) AS v FROM {source} GROUP BY 1
                          ORDER BY v {direction}, {key} LIMIT {n})
       SELECT {key}, round(v, 2) AS {name},
              CAST(row_number() OVER (ORDER BY v {direction}, {key}) AS integer) AS rank,
              round(100 * v / sum(v) OVER (), 2) AS contribution_pct FROM g"""


BINDINGS["top_n"] = (
    lambda spark, d: rounded(
        ranking.top_n(table(spark, d, "orders"), "o_totalprice", "o_custkey", 10), "o_totalprice"
    ),
    ranked_sql("orders", "o_custkey", "o_totalprice", "DESC", 10, "o_totalprice"),
)

BINDINGS["bottom_n"] = (
    lambda spark, d: rounded(
        ranking.top_n(table(spark, d, "orders"), "o_totalprice", "o_custkey", 10, ascending=True),
        "o_totalprice",
    ),
    ranked_sql("orders", "o_custkey", "o_totalprice", "ASC", 10, "o_totalprice"),
)

BINDINGS["top_n_average"] = (
    lambda spark, d: rounded(
        ranking.top_n(table(spark, d, "lineitem"), "l_quantity", "l_partkey", 15, metric="average"),
        "l_quantity",
    ),
    ranked_sql("lineitem", "l_partkey", "l_quantity", "DESC", 15, "l_quantity", "avg"),
)


def pareto_sql(source: str, key: str, value: str) -> str:
    return f"""g AS (SELECT {key}, sum({value}) AS v FROM {source} GROUP BY 1),
       p AS (SELECT *, round(100 * v / sum(v) OVER (), 2) AS pct FROM g),
       c AS (SELECT *, round(sum(pct) OVER (ORDER BY v DESC, {key} ROWS UNBOUNDED PRECEDING), 2) AS cum
             FROM p),
       pareto AS (SELECT {key}, round(v, 2) AS {value}, pct AS contribution_pct, cum AS cumulative_pct,
              CASE WHEN cum <= 80 THEN 'A' WHEN cum <= 95 THEN 'B' ELSE 'C' END AS segment FROM c)"""


def _pareto(spark, d):
    return ranking.pareto(table(spark, d, "lineitem"), "l_extendedprice", "l_partkey")


BINDINGS["pareto"] = (
    lambda spark, d: rounded(_pareto(spark, d), "l_extendedprice"),
    f"WITH {pareto_sql('lineitem', 'l_partkey', 'l_extendedprice')} SELECT * FROM pareto",
)

BINDINGS["pareto_summary"] = (
    lambda spark, d: rounded(ranking.pareto_summary(_pareto(spark, d)), "a_share"),
    f"""WITH {pareto_sql("lineitem", "l_partkey", "l_extendedprice")}
        SELECT count(*) FILTER (WHERE segment = 'A') AS a_groups,
               round(sum(contribution_pct) FILTER (WHERE segment = 'A'), 2) AS a_share FROM pareto""",
)

BINDINGS["top_rows"] = (
    lambda spark, d: ranking.top_rows(
        table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        "o_totalprice", 20, tie_break=["o_orderkey"],
    ),
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
)

BINDINGS["top_labels"] = (
    lambda spark, d: rounded(
        ranking.top_labels(table(spark, d, "customer"), "c_acctbal", "c_name", 12), "c_acctbal"
    ),
    """SELECT c_name, round(sum(c_acctbal), 2) AS c_acctbal FROM customer
       GROUP BY 1 ORDER BY sum(c_acctbal) DESC, 1 LIMIT 12""",
)

# DuckDB labels of each grain, given the first day of the period.
LABELS = {
    "month": "strftime(p, '%Y-%m')",
    "quarter": "concat(year(p), 'Q', quarter(p))",
    "year": "strftime(p, '%Y')",
    "week": "concat(strftime(p, '%Y-%m-%d'), '/', strftime(p + INTERVAL 6 DAY, '%Y-%m-%d'))",
    "day": "strftime(p, '%Y-%m-%d')",
}


def growth_sql(source: str, date: str, value: str, grain: str) -> str:
    return f"""per AS (SELECT date_trunc('{grain}', {date}) AS p, sum({value}) AS v FROM {source} GROUP BY 1),
       growth AS (SELECT {LABELS[grain]} AS "Period", round(v, 2) AS {value},
              round(100 * (v - lag(v) OVER (ORDER BY p)) / nullif(abs(lag(v) OVER (ORDER BY p)), 0), 2)
                AS growth_pct FROM per)"""


def _growth(grain):
    def run(spark, d):
        return rounded(
            timeseries.period_growth(table(spark, d, "orders"), "o_orderdate", "o_totalprice", grain),
            "o_totalprice",
        )

    return run


for _grain in LABELS:
    BINDINGS[f"period_growth_{_grain}"] = (
        _growth(_grain),
        f"WITH {growth_sql('orders', 'o_orderdate', 'o_totalprice', _grain)} SELECT * FROM growth",
    )

BINDINGS["latest_growth"] = (
    lambda spark, d: timeseries.latest_growth(
        table(spark, d, "orders"), "o_orderdate", "o_totalprice"
    ),
    f"""WITH {growth_sql("orders", "o_orderdate", "o_totalprice", "month")}
        SELECT max("Period") AS period, arg_max(growth_pct, "Period") AS growth_pct,
               count(*) AS periods FROM growth""",
)


def enrich_dates(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return timeseries.enrich_dates(orders, "o_orderdate").drop("o_orderdate")


BINDINGS["enrich_dates"] = (
    enrich_dates,
    """SELECT o_orderkey, CAST(day(o_orderdate) AS integer) AS "o_orderdate_Day",
         CAST(week(o_orderdate) AS integer) AS "o_orderdate_Week",
         CAST(month(o_orderdate) AS integer) AS "o_orderdate_Month",
         monthname(o_orderdate) AS "o_orderdate_MonthName",
         CAST(quarter(o_orderdate) AS integer) AS "o_orderdate_Quarter",
         CAST(year(o_orderdate) AS integer) AS "o_orderdate_Year",
         CAST(CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) + 1
                   ELSE year(o_orderdate) END AS integer) AS "o_orderdate_FY",
         strftime(o_orderdate, '%Y-%m') AS "o_orderdate_Period" FROM orders""",
)

BINDINGS["ytd"] = (
    lambda spark, d: rounded(
        timeseries.ytd_total(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "1998-06-30"),
        "ytd_total",
    ),
    """SELECT 1998 AS year, '1998-06-30' AS as_of, round(sum(o_totalprice), 2) AS ytd_total
       FROM orders WHERE year(o_orderdate) = 1998 AND o_orderdate <= TIMESTAMP '1998-06-30'""",
)

BINDINGS["ytd_latest"] = (
    lambda spark, d: rounded(
        timeseries.ytd_total(table(spark, d, "orders"), "o_orderdate", "o_totalprice"), "ytd_total"
    ),
    """WITH m AS (SELECT max(o_orderdate) AS m FROM orders)
       SELECT CAST(year(m) AS integer) AS year, strftime(m, '%Y-%m-%d') AS as_of,
              (SELECT round(sum(o_totalprice), 2) FROM orders WHERE year(o_orderdate) = year(m)) AS ytd_total
       FROM m""",
)

BINDINGS["ytd_full_year"] = (
    lambda spark, d: rounded(
        timeseries.ytd_total(
            table(spark, d, "orders"), "o_orderdate", "o_totalprice", "1997-03-31", full_year=True
        ),
        "ytd_total",
    ),
    """SELECT 1997 AS year, '1997-03-31' AS as_of, round(sum(o_totalprice), 2) AS ytd_total
       FROM orders WHERE year(o_orderdate) = 1997""",
)

DECLINE = """per AS (SELECT c_mktsegment, date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v
                     FROM sales GROUP BY 1, 2),
       steps AS (SELECT *, lag(v) OVER (PARTITION BY c_mktsegment ORDER BY p) AS prev,
                        row_number() OVER (PARTITION BY c_mktsegment ORDER BY p DESC) AS back,
                        sum(v) OVER (PARTITION BY c_mktsegment) AS total FROM per),
       decline AS (SELECT c_mktsegment, strftime(p, '%Y-%m') AS "Period", round(prev, 2) AS previous,
              round(v, 2) AS current,
              CASE WHEN prev <> 0 THEN round(100 * (v - prev) / abs(prev), 2) END AS change_pct,
              coalesce(prev <> 0 AND v < prev, false) AS declined,
              row_number() OVER (ORDER BY total DESC, c_mktsegment) = 1 AS "leading"
       FROM steps WHERE back = 1)"""

BINDINGS["segment_decline"] = (
    lambda spark, d: rounded(
        timeseries.segment_decline(sales(spark, d), "o_orderdate", "c_mktsegment", "o_totalprice"),
        "previous", "current",
    ),
    f"WITH {SALES}, {DECLINE} SELECT * FROM decline",
)


def fence_sql(source: str, value: str, method: str = "iqr") -> str:
    if method == "iqr":
        low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    else:
        low, high = "m - 3 * s", "m + 3 * s"
    return f"""q AS (SELECT count({value}) AS n, quantile_cont({value}, 0.25) AS q1,
                       quantile_cont({value}, 0.75) AS q3, median({value}) AS md,
                       avg({value}) AS m, stddev_samp({value}) AS s FROM {source}),
       f AS (SELECT n, md, {low} AS lo, {high} AS hi FROM q)"""


def outlier_sql(method: str) -> str:
    return f"""WITH {fence_sql("events", "value", method)}
       SELECT events.*, round(lo, 3) AS expected_low, round(hi, 3) AS expected_high,
              format('{{:,.2f}} – {{:,.2f}}', lo, hi) AS expected_range,
              CASE WHEN md = 0 OR abs(value) > 5 * abs(md) THEN 'high' ELSE 'medium' END AS severity
       FROM events, f WHERE n >= 4 AND (value < lo OR value > hi)"""


def _outliers(method):
    def run(spark, d):
        hits = out_ops.outliers(table(spark, d, "events"), "value", method)
        return rounded(hits, "expected_low", "expected_high", digits=3)

    return run


BINDINGS["outliers_iqr"] = (_outliers("iqr"), outlier_sql("iqr"))
BINDINGS["outliers_z"] = (_outliers("zscore"), outlier_sql("zscore"))
