"""Composite analyses, dashboards, tasks and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as out_ops
from ..plans import reports, templates
from .common import DIRTY, LINES, SALES, dirty_customer, lines, rounded, sales, table
from .aggregate_queries import PNL_SQL, VARIANCE_SQL
from .quality_queries import DESCRIBED, ISSUES
from .ranking_queries import DECLINE, fence_sql, growth_sql, pareto_sql

BINDINGS = {}


def _numbers_sql(source: str, columns, key: str = "subject") -> str:
    """metric_* findings of the given columns."""
    stats = {"total": "sum", "average": "avg", "median": "median", "min": "min", "max": "max"}
    return "\nUNION ALL ".join(
        f"SELECT 'metric_{name}' AS kind, '{c}' AS {key}, CAST({fn}({c}) AS double) AS value,"
        f" 'info' AS severity FROM {source}"
        for c in columns
        for name, fn in stats.items()
    )


def findings_sql(source: str, columns, measure: str, category: str, n_columns: int, declining: bool) -> str:
    """CTEs ending in ``f`` = the findings of a table without gaps."""
    decline = (
        """UNION ALL SELECT 'decline', c_mktsegment, change_pct, 'alert' FROM decline
             WHERE "leading" AND declined"""
        if declining
        else ""
    )
    return f"""reps AS (SELECT (SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS n),
       g AS (SELECT {category} AS k, sum({measure}) AS v FROM {source} GROUP BY 1),
       t AS (SELECT k, v, 100 * v / (SELECT sum(v) FROM g) AS share FROM g ORDER BY v DESC, k LIMIT 1),
       f AS (SELECT 'rows' AS kind, CAST(NULL AS varchar) AS subject, CAST(count(*) AS double) AS value,
                    'info' AS severity FROM {source}
         UNION ALL SELECT 'columns', NULL, {n_columns}, 'info'
         UNION ALL SELECT 'duplicate_rows', NULL, n, CASE WHEN n > 0 THEN 'alert' ELSE 'info' END FROM reps
         UNION ALL SELECT 'clean_duplicates', NULL, n, 'recommendation' FROM reps WHERE n > 0
         UNION ALL SELECT 'missing_cells', NULL, 0, 'info'
         UNION ALL SELECT 'missing_pct', NULL, 0, 'info'
         UNION ALL {_numbers_sql(source, columns)}
         UNION ALL SELECT 'top_category', k, v, 'info' FROM t
         UNION ALL SELECT 'top_share', k, round(share, 2), 'info' FROM t
         UNION ALL SELECT 'concentration', k, round(share, 2), 'recommendation' FROM t WHERE share > 30
         {decline})"""


SALES_NUMBERS = ("o_orderkey", "o_totalprice", "c_nationkey")

BINDINGS["analyze_findings"] = (
    lambda spark, d: rounded(
        reports.analyze(sales(spark, d), "o_totalprice", "c_mktsegment", "o_orderdate"), "value"
    ),
    f"""WITH {SALES}, {DECLINE},
        {findings_sql("sales", SALES_NUMBERS, "o_totalprice", "c_mktsegment", 7, True)}
        SELECT kind, subject, round(value, 2) AS value, severity FROM f""",
)


def analyze_dirty(spark, d):
    """A table with repeats and gaps."""
    dirty = dirty_customer(spark, d)
    size = reports.table_size(dirty)
    return size.select("rows", "columns", "missing_cells", "missing_pct")


BINDINGS["table_size"] = (
    analyze_dirty,
    f"""WITH {DIRTY} SELECT count(*) AS rows, CAST(7 AS bigint) AS columns,
          count(*) FILTER (WHERE segment IS NULL) AS missing_cells,
          round(100 * count(*) FILTER (WHERE segment IS NULL) / (7.0 * count(*)), 2) AS missing_pct
        FROM dirty""",
)

BINDINGS["report_top5"] = (
    lambda spark, d: rounded(
        reports.report(sales(spark, d), "o_totalprice", "c_mktsegment", "o_orderdate", 5), "value"
    ),
    f"""WITH {SALES}, {DECLINE},
        {findings_sql("sales", SALES_NUMBERS, "o_totalprice", "c_mktsegment", 7, True)}
        SELECT kind, subject, round(value, 2) AS value, severity FROM f
        ORDER BY CASE severity WHEN 'alert' THEN 1 WHEN 'recommendation' THEN 2 ELSE 3 END,
                 kind, subject NULLS LAST LIMIT 5""",
)


def _panel_top(source: str, panel: str, key: str, measure: str, n: int = 10) -> str:
    return f"""UNION ALL (SELECT '{panel}' AS panel, CAST({key} AS varchar) AS label,
         round(sum({measure}), 2) AS value FROM {source} GROUP BY {key}
         ORDER BY sum({measure}) DESC, {key} LIMIT {n})"""


def dashboard_sql(ctes: str, source: str, measure: str, date: str | None, panels: dict[str, str],
                  total: str, orders: bool) -> str:
    trend = f", {growth_sql(source, date, measure, 'month')}" if date else ""
    trend_rows = (
        f"""UNION ALL SELECT 'trend', "Period", {measure} FROM growth
            UNION ALL SELECT 'kpi', 'MoM Growth %', arg_max(growth_pct, "Period") FROM growth"""
        if date
        else ""
    )
    order_rows = (
        f"""UNION ALL SELECT 'kpi', 'Orders', count(*) FROM {source}
            UNION ALL SELECT 'kpi', 'AOV', round(sum({measure}) / count(*), 2) FROM {source}"""
        if orders
        else ""
    )
    tops = "\n".join(_panel_top(source, p, k, measure) for p, k in panels.items())
    return f"""WITH {ctes}{trend}
       SELECT 'kpi' AS panel, '{total}' AS label, round(sum({measure}), 2) AS value FROM {source}
       UNION ALL SELECT 'kpi', 'Average', round(avg({measure}), 2) FROM {source}
       UNION ALL SELECT 'kpi', 'Records', count(*) FROM {source}
       {order_rows} {trend_rows} {tops}"""


BINDINGS["dashboard_sales"] = (
    lambda spark, d: rounded(
        reports.dashboard(
            sales(spark, d), "o_totalprice", "o_orderdate", "o_orderpriority", "c_nationkey", "c_mktsegment"
        ),
        "value",
    ),
    dashboard_sql(
        SALES, "sales", "o_totalprice", "o_orderdate",
        {"top_products": "o_orderpriority", "by_region": "c_nationkey", "by_category": "c_mktsegment"},
        "Revenue", True,
    ),
)

PARTS = "parts AS (SELECT * FROM part)"


def dashboard_inventory(spark, d):
    parts = table(spark, d, "part")
    return rounded(templates.report("stock_dashboard", parts, "p_retailprice", None, "p_brand", "p_type"), "value")


BINDINGS["dashboard_inventory"] = (
    dashboard_inventory,
    dashboard_sql(
        PARTS, "parts", "p_retailprice", None,
        {"top_products": "p_brand", "by_region": "p_type", "by_category": "p_brand"}, "Total", False,
    ),
)

BOARD = {
    "kpis": ("kpi", "value"),
    "trend": ("Period", "o_totalprice"),
    "ranking": ("o_custkey", "o_totalprice"),
    "pareto": ("o_custkey", "cumulative_pct"),
    "descriptive": ("statistic", "value"),
}


def in_millions(board):
    """A board with its variances in millions."""
    return board.withColumn("value", F.when(F.col("label") == "variance", F.col("value") / 1e6).otherwise(F.col("value")))


def dashboard_board(spark, d):
    """All rows of all six frames; the variance in millions, as sums of squares differ in the last digits."""
    frames = reports.board(table(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderdate")
    parts = {name: (frames[name], *columns) for name, columns in BOARD.items()}
    named = frames["outliers"].withColumn("label", F.concat_ws(" ", "severity", "o_orderkey", "expected_range"))
    parts["outliers"] = (named, "label", "o_totalprice")
    return rounded(in_millions(reports.long_board(parts)), "value")


BINDINGS["dashboard_board"] = (
    dashboard_board,
    f"""WITH {growth_sql("orders", "o_orderdate", "o_totalprice", "month")},
       {pareto_sql("orders", "o_custkey", "o_totalprice")},
       {fence_sql("orders", "o_totalprice")},
       hits AS (SELECT concat_ws(' ', CASE WHEN md = 0 OR abs(o_totalprice) > 5 * abs(md) THEN 'high' ELSE 'medium' END, o_orderkey,
                       format('{{:,.2f}} – {{:,.2f}}', lo, hi)) AS s, o_totalprice
                FROM orders, f WHERE n >= 4 AND (o_totalprice < lo OR o_totalprice > hi)),
       best AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1 ORDER BY v DESC, 1 LIMIT 10),
       ends AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       SELECT 'kpis' AS panel, 'Records' AS label, CAST(count(*) AS double) AS value FROM orders
       UNION ALL SELECT 'kpis', 'Total o_totalprice', round(sum(o_totalprice), 2) FROM orders
       UNION ALL SELECT 'kpis', 'Avg o_totalprice', round(avg(o_totalprice), 2) FROM orders
       UNION ALL SELECT 'trend', "Period", o_totalprice FROM growth
       UNION ALL SELECT 'ranking', CAST(o_custkey AS varchar), round(v, 2) FROM best
       UNION ALL SELECT 'pareto', CAST(o_custkey AS varchar), cumulative_pct FROM pareto
       UNION ALL SELECT 'outliers', s, o_totalprice FROM hits
       UNION ALL SELECT 'descriptive', 'count', n FROM q
       UNION ALL SELECT 'descriptive', 'mean', round(m, 2) FROM q
       UNION ALL SELECT 'descriptive', 'median', round(md, 2) FROM q
       UNION ALL SELECT 'descriptive', 'min', lo FROM ends
       UNION ALL SELECT 'descriptive', 'max', hi FROM ends
       UNION ALL SELECT 'descriptive', 'range', round(hi - lo, 2) FROM ends
       UNION ALL SELECT 'descriptive', 'std', round(s, 2) FROM q
       UNION ALL SELECT 'descriptive', 'variance', round(s * s / 1e6, 2) FROM q
       UNION ALL SELECT 'descriptive', 'q1', round(q1, 2) FROM q
       UNION ALL SELECT 'descriptive', 'q3', round(q3, 2) FROM q""",
)


def _task(task: str, columns: dict[str, tuple[str, str]], **options):
    def run(spark, d):
        frames = reports.task_frames(task, sales(spark, d), "o_totalprice", **options)
        return rounded(
            reports.long_board({n: (frames[n], *columns[n]) for n in columns}), "value"
        )

    return run


_SUMMARY = """SELECT 'summary' AS panel, c_mktsegment AS label, round(sum(o_totalprice), 2) AS value
              FROM sales GROUP BY 2"""

BINDINGS["task_summarize"] = (
    _task(
        "summarize",
        {"summary": ("c_mktsegment", "sum"), "pareto": ("c_mktsegment", "cumulative_pct")},
        group_by="c_mktsegment",
    ),
    f"""WITH {SALES}, {pareto_sql("sales", "c_mktsegment", "o_totalprice")} {_SUMMARY}
        UNION ALL SELECT 'pareto', c_mktsegment, cumulative_pct FROM pareto""",
)

BINDINGS["task_compare"] = (
    _task(
        "compare",
        {"summary": ("c_mktsegment", "sum"), "trend": ("Period", "o_totalprice")},
        group_by="c_mktsegment", date="o_orderdate", grain="quarter",
    ),
    f"""WITH {SALES}, {growth_sql("sales", "o_orderdate", "o_totalprice", "quarter")} {_SUMMARY}
        UNION ALL SELECT 'trend', "Period", o_totalprice FROM growth""",
)

BINDINGS["task_trend"] = (
    lambda spark, d: rounded(
        in_millions(
            reports.long_board(
                {
                    name: (frame, *columns)
                    for name, columns in {"trend": ("Period", "growth_pct"), "descriptive": ("statistic", "value")}.items()
                    for frame in [reports.task_frames("monthly_trend", sales(spark, d), "o_totalprice", date="o_orderdate")[name]]
                }
            )
        ),
        "value",
    ),
    f"""WITH {SALES}, {growth_sql("sales", "o_orderdate", "o_totalprice", "month")},
       q AS (SELECT count(*) n, avg(o_totalprice) m, median(o_totalprice) md, min(o_totalprice) lo,
               max(o_totalprice) hi, stddev_samp(o_totalprice) s, quantile_cont(o_totalprice, 0.25) a,
               quantile_cont(o_totalprice, 0.75) b FROM sales)
       SELECT 'trend' AS panel, "Period" AS label, growth_pct AS value FROM growth
       UNION ALL SELECT 'descriptive', 'count', n FROM q
       UNION ALL SELECT 'descriptive', 'mean', round(m, 2) FROM q
       UNION ALL SELECT 'descriptive', 'median', round(md, 2) FROM q
       UNION ALL SELECT 'descriptive', 'min', lo FROM q
       UNION ALL SELECT 'descriptive', 'max', hi FROM q
       UNION ALL SELECT 'descriptive', 'std', round(s, 2) FROM q
       UNION ALL SELECT 'descriptive', 'variance', round(s * s / 1e6, 2) FROM q
       UNION ALL SELECT 'descriptive', 'q1', round(a, 2) FROM q
       UNION ALL SELECT 'descriptive', 'q3', round(b, 2) FROM q
       UNION ALL SELECT 'descriptive', 'range', round(hi - lo, 2) FROM q""",
)

BINDINGS["task_overview"] = (
    _task("other", {"kpis": ("kpi", "value"), "summary": ("c_mktsegment", "sum")}, group_by="c_mktsegment"),
    f"""WITH {SALES} {_SUMMARY}
        UNION ALL SELECT 'kpis', 'Records', count(*) FROM sales
        UNION ALL SELECT 'kpis', 'Total o_totalprice', round(sum(o_totalprice), 2) FROM sales
        UNION ALL SELECT 'kpis', 'Avg o_totalprice', round(avg(o_totalprice), 2) FROM sales""",
)

BINDINGS["findings"] = (
    lambda spark, d: rounded(reports.findings(dirty_customer(spark, d), "qty", "segment"), "value"),
    f"""{DESCRIBED}, {ISSUES},
       k AS (SELECT count(*) AS n FROM found),
       l AS (SELECT segment, sum(qty) AS v FROM dirty GROUP BY 1 ORDER BY v DESC, 1 NULLS LAST LIMIT 1)
       SELECT 'rows' AS kind, CAST(NULL AS varchar) AS subject, CAST(count(*) AS double) AS value,
              'info' AS severity FROM dirty
       UNION ALL SELECT 'columns', NULL, 7, 'info'
       UNION ALL SELECT 'quality_issues', NULL, n, 'alert' FROM k WHERE n > 0
       UNION ALL SELECT 'clean_first', NULL, n, 'recommendation' FROM k WHERE n > 0
       UNION ALL SELECT 'leading_segment', segment, v, 'info' FROM l""",
)


# Templates ------------------------------------------------------------------------
def _ranked(source: str, key: str, measure: str, n: int | None, direction: str, name: str, ctes: str = "") -> str:
    limit = "" if n is None else f"LIMIT {n}"
    return f"""{f"WITH {ctes}" if ctes else ""} SELECT {key}, round(sum({measure}), 2) AS {name}
       FROM {source} GROUP BY 1 ORDER BY sum({measure}) {direction}, 1 {limit}"""


def _join(spark, d, left, right, on_left, on_right):
    return table(spark, d, left).join(table(spark, d, right), F.col(on_left) == F.col(on_right))


BINDINGS["tpl_sales_dashboard"] = (
    lambda spark, d: rounded(
        templates.report(
            "sales_dashboard", sales(spark, d), "o_totalprice", "o_orderdate", "c_mktsegment", "o_orderpriority"
        ),
        "value",
    ),
    dashboard_sql(
        SALES, "sales", "o_totalprice", "o_orderdate",
        {"top_products": "c_mktsegment", "by_region": "o_orderpriority", "by_category": "c_mktsegment"},
        "Revenue", True,
    ),
)

BINDINGS["tpl_sales_person"] = (
    lambda spark, d: rounded(
        templates.report(
            "salesperson_performance", _join(spark, d, "lineitem", "supplier", "l_suppkey", "s_suppkey"), "s_name", "l_extendedprice"
        ),
        "sum",
    ),
    _ranked("lineitem JOIN supplier ON l_suppkey = s_suppkey", "s_name", "l_extendedprice", None, "DESC", "sum"),
)

BINDINGS["tpl_sales_product"] = (
    lambda spark, d: rounded(
        templates.report(
            "product_performance", _join(spark, d, "lineitem", "part", "l_partkey", "p_partkey"), "p_brand", "l_extendedprice"
        ),
        "sum",
    ),
    _ranked("lineitem JOIN part ON l_partkey = p_partkey", "p_brand", "l_extendedprice", None, "DESC", "sum"),
)

BINDINGS["tpl_sales_customer"] = (
    lambda spark, d: rounded(
        templates.report(
            "customer_analysis", _join(spark, d, "orders", "customer", "o_custkey", "c_custkey"), "c_name", "o_totalprice"
        ),
        "sum",
    ),
    _ranked("orders JOIN customer ON o_custkey = c_custkey", "c_name", "o_totalprice", None, "DESC", "sum"),
)

BINDINGS["tpl_sales_trend"] = (
    lambda spark, d: rounded(
        templates.report("monthly_trend", table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice"),
        "l_extendedprice",
    ),
    f"WITH {growth_sql('lineitem', 'l_shipdate', 'l_extendedprice', 'month')} SELECT * FROM growth",
)

BINDINGS["tpl_inventory_stock"] = (
    lambda spark, d: rounded(
        templates.report("stock_dashboard", table(spark, d, "lineitem"), "l_quantity", "l_shipdate", "l_partkey", "l_suppkey"), "value"
    ),
    dashboard_sql(
        "stock AS (SELECT * FROM lineitem)", "stock", "l_quantity", "l_shipdate",
        {"top_products": "l_partkey", "by_region": "l_suppkey", "by_category": "l_partkey"}, "Total", True,
    ),
)

for _name, _template, _key in (("low", "low_stock", "l_partkey"), ("dead", "dead_stock", "l_suppkey")):
    BINDINGS[f"tpl_inventory_{_name}"] = (
        lambda spark, d, run=_template, key=_key: rounded(
            templates.report(run, table(spark, d, "lineitem"), key, "l_quantity"), "l_quantity"
        ),
        _ranked("lineitem", _key, "l_quantity", None, "ASC", "l_quantity"),
    )

BINDINGS["tpl_finance_expense"] = (
    lambda spark, d: rounded(
        templates.report(
            "expense_analysis", _join(spark, d, "lineitem", "part", "l_partkey", "p_partkey"), "p_type", "l_extendedprice"
        ),
        "sum",
    ),
    _ranked("lineitem JOIN part ON l_partkey = p_partkey", "p_type", "l_extendedprice", None, "DESC", "sum"),
)

BINDINGS["tpl_finance_variance"] = (
    lambda spark, d: rounded(
        templates.report("variance_analysis", lines(spark, d), "revenue", "cost").select(
            "l_orderkey", "l_linenumber", "variance", "variance_pct"
        ),
        "variance", digits=4,
    ),
    VARIANCE_SQL,
)

BINDINGS["tpl_finance_pnl"] = (
    lambda spark, d: rounded(templates.report("pnl_summary", lines(spark, d), "revenue", "cost"), "value"),
    PNL_SQL,
)

BINDINGS["tpl_hr_employee"] = (
    lambda spark, d: rounded(
        templates.report("employee_performance", table(spark, d, "supplier"), "s_name", "s_acctbal"), "sum"
    ),
    _ranked("supplier", "s_name", "s_acctbal", None, "DESC", "sum"),
)

EVENT_NUMBERS, EVENT_COLUMNS = ("event_id", "user_id", "value"), 6

BINDINGS["tpl_hr_attendance"] = (
    lambda spark, d: rounded(
        templates.report(
            "attendance_summary", table(spark, d, "events"), "value", "event_type"
        ),
        "value",
    ),
    f"""WITH {findings_sql("events", EVENT_NUMBERS, "value", "event_type", EVENT_COLUMNS, False)}
        SELECT kind, subject, round(value, 2) AS value, severity FROM f""",
)

BINDINGS["tpl_crm_leads"] = (
    lambda spark, d: rounded(
        templates.report(
            "lead_analysis", table(spark, d, "orders"), "o_totalprice", "o_orderstatus"
        ),
        "value",
    ),
    f"""WITH
        {findings_sql("orders", ("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_orderstatus", 6, False)}
        SELECT kind, subject, round(value, 2) AS value, severity FROM f""",
)

BINDINGS["tpl_crm_pipeline"] = (
    lambda spark, d: rounded(
        templates.report("pipeline_analysis", table(spark, d, "orders"), "o_orderstatus", "o_totalprice"), "sum"
    ),
    _ranked("orders", "o_orderstatus", "o_totalprice", None, "DESC", "sum"),
)

BINDINGS["tpl_ecommerce_orders"] = (
    lambda spark, d: rounded(
        templates.report("order_analysis", sales(spark, d), "o_totalprice", "o_orderdate", "c_mktsegment"), "value"
    ),
    dashboard_sql(
        SALES, "sales", "o_totalprice", "o_orderdate",
        {"top_products": "c_mktsegment", "by_category": "c_mktsegment"}, "Revenue", True,
    ),
)

BINDINGS["tpl_ecommerce_sku"] = (
    lambda spark, d: rounded(
        templates.report("sku_performance", table(spark, d, "part"), "p_name", "p_retailprice"), "sum"
    ),
    _ranked("part", "p_name", "p_retailprice", None, "DESC", "sum"),
)


def tpl_ecommerce_returns(spark, d):
    returned = lines(spark, d).filter(F.col("l_returnflag") == "R")
    return templates.report("returns_overview", returned, "discount")


BINDINGS["tpl_ecommerce_returns"] = (
    tpl_ecommerce_returns,
    f"""WITH {LINES}, r AS (SELECT * FROM lines WHERE l_returnflag = 'R'),
       {fence_sql("r", "discount")},
       groups AS (SELECT count(*) AS n FROM r GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
                  l_quantity, l_returnflag, revenue, cost, discount HAVING count(*) > 1),
       p AS (SELECT 'duplicate_rows' AS issue, CAST(NULL AS varchar) AS "column",
               CAST((SELECT coalesce(sum(n), 0) FROM groups) AS bigint) AS count
             UNION ALL SELECT 'outlier', 'discount', count(*) FROM r, f
               WHERE n >= 4 AND (discount < lo OR discount > hi))
       SELECT * FROM p WHERE count > 0""",
)


def outlier_ranges(spark, d):
    return rounded(out_ops.fences(table(spark, d, "events"), "value"), "median", "low", "high", digits=3)


BINDINGS["outlier_fences"] = (
    outlier_ranges,
    f"""WITH {fence_sql("events", "value")} SELECT n, round(md, 3) AS median, round(lo, 3) AS low,
        round(hi, 3) AS high FROM f""",
)
