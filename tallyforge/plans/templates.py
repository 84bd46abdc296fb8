"""Ready-made reports per business area: each is an operator with its columns chosen by role.

Grouped reports return all groups, or the first ``n``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.aggregate import summarize
from ..operators.profile import find_problems
from ..operators.ranking import chart_series, top_labels
from ..operators.scenario import pnl, variance_rows
from ..operators.timeseries import period_growth
from .reports import analyze, dashboard


def _board(kind: str) -> Callable[..., DataFrame]:
    def board(df, measure, date=None, item=None, place=None):
        return dashboard(df, measure, date, item, place, item, kind)

    return board


def _totals(df, group, measure, n=None):
    return summarize(df, group, measure, "sum", n)


def _chart(df, group, measure, n=None):
    return chart_series(df, group, measure, "sum", n)


def _lowest(df, group, measure, n=None):
    return top_labels(df, measure, group, n, ascending=True)


def _growth(df, date, measure):
    return period_growth(df, date, measure, "month")


#: Report name, and what makes it of a table and its columns.
REPORTS: dict[str, Callable[..., DataFrame]] = {
    "sales_dashboard": _board("sales"),
    "order_analysis": _board("sales"),
    "stock_dashboard": _board("inventory"),
    **dict.fromkeys(("salesperson_performance", "customer_analysis", "expense_analysis", "employee_performance"), _totals),
    **dict.fromkeys(("product_performance", "pipeline_analysis", "sku_performance"), _chart),
    **dict.fromkeys(("low_stock", "dead_stock"), _lowest),
    **dict.fromkeys(("attendance_summary", "lead_analysis"), lambda df, measure, group: analyze(df, measure, group)),
    "monthly_trend": _growth,
    "variance_analysis": variance_rows,
    "pnl_summary": pnl,
    "returns_overview": find_problems,
}


def report(name: str, df: DataFrame, *columns: str | None, **options) -> DataFrame:
    """The named report over the given columns, in the order in which its operator takes them."""
    if name not in REPORTS:
        raise ValueError(f"Unknown report: {name}")
    return REPORTS[name](df, *columns, **options)
