"""Rankings, Pareto segments, running totals, chart series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import half_up, to_number
from ..functions.columns import TEMP, is_sortable, order_keys, ref, require_columns
from .aggregate import group_metrics, summarize
from .ordered import prefix_sum


def top_n(
    df: DataFrame,
    measure: str,
    group_by: str,
    n: int = 10,
    ascending: bool = False,
    metric: str = "sum",
    output: str | None = None,
) -> DataFrame:
    """The n best (or worst) groups with rank and share of the listed rows."""
    name = output or measure
    listed = summarize(df, group_by, measure, {name: metric}, n, ascending)
    # Only the n listed rows reach these unpartitioned windows.
    order = Window.orderBy(*order_keys([name], ascending), *order_keys([group_by]))
    total = F.sum(ref(name)).over(Window.partitionBy())
    share = F.when(total != 0, half_up(100 * ref(name) / total, 2))
    return listed.select(
        ref(group_by),
        ref(name),
        F.row_number().over(order).alias("rank"),
        share.alias("contribution_pct"),
    )


def chart_series(
    df: DataFrame, category: str, measure: str, metric: str = "sum", n: int | None = 10
) -> DataFrame:
    """(category, metric) points of the n largest categories, or of all."""
    return summarize(df, category, measure, {metric: metric}, n)


def running_total(df: DataFrame, measure: str, group_by: str) -> DataFrame:
    """Group sums in ascending order of the sum with their running total."""
    sums = group_metrics(df, [group_by], to_number(df, measure), {"sum": "sum"})
    return prefix_sum(
        sums, "sum", [ref("sum").asc(), ref(group_by).asc_nulls_last()], "running_total"
    )


def pareto(df: DataFrame, measure: str | Column, group_by: str, threshold: float = 80.0,
           output: str | None = None) -> DataFrame:
    """Groups by falling sum with share, cumulative share and ABC segment.

    The cumulative share adds up the shares already rounded to two digits, as
    whole hundredths, so the result does not depend on how rows are spread.
    """
    require_columns(df, group_by)
    name = output or (measure if isinstance(measure, str) else "value")
    value = to_number(df, measure) if isinstance(measure, str) else measure
    sums = group_metrics(df, [group_by], value, {name: "sum"})
    total = sums.agg(F.sum(ref(name)).alias("total")).scalar()
    base = F.when(total != 0, total).otherwise(F.lit(1.0))
    points = TEMP + "points"
    shares = sums.withColumn("contribution_pct", half_up(100 * ref(name) / base, 2)).withColumn(
        points, F.round(ref("contribution_pct") * 100, 0).cast("bigint")
    )
    run = TEMP + "run"
    ranked = prefix_sum(
        shares, points, [ref(name).desc_nulls_last(), ref(group_by).asc_nulls_last()], run
    )
    cumulative = ref(run) / F.lit(100.0)
    segment = (
        F.when(cumulative <= threshold, "A").when(cumulative <= 95, "B").otherwise("C")
    )
    return ranked.select(
        ref(group_by),
        ref(name),
        "contribution_pct",
        cumulative.alias("cumulative_pct"),
        segment.alias("segment"),
    )


def pareto_summary(ranked: DataFrame) -> DataFrame:
    """One row: number of A groups and their joint share."""
    in_a = F.col("segment") == "A"
    return ranked.agg(
        F.count_if(in_a).alias("a_groups"),
        F.coalesce(F.sum(F.when(in_a, F.col("contribution_pct"))), F.lit(0.0)).alias("a_share"),
    )


def top_rows(
    df: DataFrame,
    column: str,
    n: int = 10,
    ascending: bool = False,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """The n rows with the largest (or smallest) readable number in a column."""
    require_columns(df, column, tie_break)
    v = TEMP + "v"
    rest = list(tie_break) if tie_break is not None else [
        c for c in df.columns if c != column and is_sortable(df, c)
    ]
    rows = df.withColumn(v, to_number(df, column)).filter(ref(v).isNotNull())
    return rows.orderBy(*order_keys([v], ascending), *order_keys(rest)).limit(n).drop(v)


def top_labels(
    df: DataFrame, column: str, label: str, n: int | None = 10, ascending: bool = False
) -> DataFrame:
    """Sums per label, then the n largest (or smallest), or all."""
    return summarize(df, label, column, {column: "sum"}, n, ascending)
