"""What-if tables, targets, profit and loss, budget variance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import half_up, to_number
from ..functions.columns import (
    as_list,
    key_values,
    null_safe_equal,
    qualified,
    ref,
    require_columns,
)
from .aggregate import group_metrics

# Changes always shown, and the achievement limits.
DEFAULT_CHANGES = (-10, -5, 0, 5, 10)
TARGET_STATUS = (("Excellent", 100), ("On Track", 90), ("Watch", 75))


def scenario(
    df: DataFrame,
    measure: str,
    change_pct: float = 10.0,
    scenarios: Sequence[float] | None = None,
    group_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Total of a measure under each change, overall or per group.

    The list of changes is exploded on every total, so nothing is joined.
    """
    keys = as_list(group_by)
    require_columns(df, keys)
    changes = sorted({float(p) for p in (scenarios or [*DEFAULT_CHANGES, change_pct])})
    base = group_metrics(df, keys, to_number(df, measure), {"base": "sum"})
    rows = base.select(
        *[ref(k) for k in keys],
        "base",
        F.explode(F.array(*[F.lit(p) for p in changes])).alias("change_pct"),
    )
    value = F.col("base") * (1 + F.col("change_pct") / 100)
    return rows.select(
        *[ref(k) for k in keys],
        F.format_string("%+.0f%%", F.col("change_pct")).alias("scenario"),
        "change_pct",
        half_up(value, 2).alias("value"),
        half_up(value - F.col("base"), 2).alias("difference"),
        F.col("change_pct").alias("difference_pct"),
    )


def target_columns(actual: Column, target: Column) -> dict[str, Column]:
    """Variance, its %, achievement % and status; a zero target gives 0 %."""
    variance = actual - target
    achieved = F.coalesce(F.try_divide(100 * actual, target), F.lit(0.0))
    status = F.lit("Critical")
    for label, limit in reversed(TARGET_STATUS):
        status = F.when(achieved >= limit, F.lit(label)).otherwise(status)
    share = F.coalesce(F.try_divide(100 * variance, F.abs(target)), F.lit(0.0))
    return {
        "variance": variance,
        "variance_pct": half_up(share, 2),
        "achievement_pct": half_up(achieved, 2),
        "status": status,
    }


def actual_vs_target(
    actuals: DataFrame,
    targets: DataFrame,
    key: str,
    actual: str,
    target: str,
    target_key: str | None = None,
) -> DataFrame:
    """Totals per key set against the target of that key; no target counts as 0."""
    other = target_key or key
    require_columns(actuals, key, actual)
    require_columns(targets, other, target)
    a = group_metrics(actuals, [key], to_number(actuals, actual), {"actual": "sum"})
    t = group_metrics(targets, [other], to_number(targets, target), {"target": "sum"})
    joined = a.alias("a").join(
        t.alias("t"), null_safe_equal([qualified("a", key)], [qualified("t", other)]), "left"
    )
    base = joined.select(
        qualified("a", key), "actual", F.coalesce(F.col("target"), F.lit(0.0)).alias("target")
    )
    measures = target_columns(F.col("actual"), F.col("target"))
    return base.select("*", *[c.alias(n) for n, c in measures.items()])


def pnl(df: DataFrame, revenue: str, cost: str) -> DataFrame:
    """(metric, value): Revenue, Cost, Gross Profit, Gross Margin %."""
    totals = df.agg(
        F.coalesce(F.sum(to_number(df, revenue)), F.lit(0.0)).alias("r"),
        F.coalesce(F.sum(to_number(df, cost)), F.lit(0.0)).alias("c"),
    )
    profit = F.col("r") - F.col("c")
    margin = F.coalesce(F.try_divide(100 * profit, F.col("r")), F.lit(0.0))
    named = totals.select(
        F.col("r").alias("Revenue"),
        F.col("c").alias("Cost"),
        profit.alias("Gross Profit"),
        half_up(margin, 2).alias("Gross Margin %"),
    )
    return key_values(named, "metric", "value")


def variance_rows(df: DataFrame, actual: str, budget: str) -> DataFrame:
    """Every row with its variance and variance % of the budget's size."""
    a, b = to_number(df, actual), to_number(df, budget)
    share = half_up(F.try_divide(100 * (a - b), F.abs(b)), 2)
    return df.withColumns({"variance": a - b, "variance_pct": share})


def variance_total(df: DataFrame, actual: str, budget: str) -> DataFrame:
    """One row: sum of the row variances."""
    gap = to_number(df, actual) - to_number(df, budget)
    return df.agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("total_variance"))
