"""Automatic analysis, dashboards, reports and task boards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_date, to_number
from ..functions.columns import TEMP, as_list, numeric_columns, order_keys, ref, require_columns
from ..functions.periods import period_start
from ..operators.aggregate import (
    aggregate,
    descriptive,
    kpis,
    metric_name,
    metrics_row,
    summarize,
    with_share,
)
from ..operators.duplicates import duplicate_row_count
from ..operators.outliers import outliers
from ..operators.profile import quality_issues
from ..operators.ranking import pareto, top_n
from ..operators.timeseries import START, growth_series, latest_of, period_growth, segment_decline

CONCENTRATION_PCT = 30.0

# Findings are listed by severity in this order.
SEVERITIES = ("alert", "recommendation", "info")

DASHBOARDS = (
    "sales", "inventory", "finance", "crm", "marketing", "hr", "operations", "custom",
)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _finding_rows(df: DataFrame, *findings: tuple) -> DataFrame:
    """(kind, subject, value, severity) rows out of each row, read once; a NULL value
    means the finding does not apply."""

    def column(x):
        return F.lit(x) if isinstance(x, str) or x is None else x

    entries = [
        F.struct(
            F.lit(kind).alias("kind"),
            column(subject).cast("string").alias("subject"),
            value.cast("double").alias("value"),
            column(severity).alias("severity"),
        )
        for kind, subject, value, severity in findings
    ]
    return df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())


def _size(df: DataFrame) -> dict[str, Column]:
    """Aggregates for the number of rows and of missing cells."""
    blanks = [F.sum(ref(c).isNull().cast("bigint")) for c in df.columns]
    missing = reduce(lambda a, b: a + b, [F.coalesce(b, F.lit(0)) for b in blanks])
    return {"rows": F.count(F.lit(1)), "missing_cells": missing}


def _missing_share(df: DataFrame) -> Column:
    cells = F.col("rows") * len(df.columns)
    return F.round(F.coalesce(F.try_divide(100 * F.col("missing_cells"), cells), F.lit(0.0)), 2)


def table_size(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, share of missing cells."""
    return df.agg(*[c.alias(n) for n, c in _size(df).items()]).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "missing_cells",
        _missing_share(df).alias("missing_pct"),
    )


def analyze(
    df: DataFrame,
    measure: str,
    category: str | None = None,
    date: str | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """(kind, subject, value, severity) findings about a table.

    Size, repeats and gaps; totals of the measure; leading category with its share
    and a concentration warning; decline of the leader; key figures per column.
    """
    require_columns(df, measure, category, date)
    repeated, missing = F.col("duplicate_rows"), F.col("missing_cells")
    names = numeric_columns(df)
    names = names if measure in names else [*names, measure]
    figures = [
        (f"metric_{kind}", F.lit(name), ref(metric_name(kind, i)), "info")
        for i, name in enumerate(names)
        for kind in ("total", "average", "median", "min", "max")
    ]
    parts = [
        # Size and figures of all columns come from one row of aggregates.
        _finding_rows(
            metrics_row(df, names, accuracy, _size(df)),
            ("rows", None, F.col("rows"), "info"),
            ("columns", None, F.lit(len(df.columns)), "info"),
            ("missing_cells", None, missing, F.when(missing > 0, "alert").otherwise("info")),
            ("missing_pct", None, _missing_share(df), "info"),
            *figures,
        ),
        _finding_rows(
            duplicate_row_count(df),
            ("duplicate_rows", None, repeated, F.when(repeated > 0, "alert").otherwise("info")),
            ("clean_duplicates", None, F.when(repeated > 0, repeated), "recommendation"),
        ),
    ]
    if category is not None:
        sums = summarize(df, category, measure, {"total": "sum"}, sort=False)
        leader = with_share(sums, "total", "share").orderBy(
            F.col("total").desc_nulls_last(), ref(category).asc_nulls_last()
        ).limit(1)
        share = F.round("share", 2)
        parts.append(
            _finding_rows(
                leader,
                ("top_category", ref(category), F.col("total"), "info"),
                ("top_share", ref(category), share, "info"),
                ("concentration", ref(category),
                 F.when(F.col("share") > CONCENTRATION_PCT, share), "recommendation"),
            )
        )
        if date is not None:
            falling = segment_decline(df, date, category, measure).filter(
                F.col("leading") & F.col("declined")
            )
            parts.append(
                _finding_rows(falling, ("decline", ref(category), F.col("change_pct"), "alert"))
            )
    return _union(parts)


def report(
    df: DataFrame,
    measure: str,
    category: str | None = None,
    date: str | None = None,
    limit: int = 5,
) -> DataFrame:
    """The first findings of :func:`analyze`, most severe first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    found = analyze(df, measure, category, date)
    return found.orderBy(rank, F.col("kind"), F.col("subject").asc_nulls_last()).limit(limit)


def _panel(df: DataFrame, panel: str, label, value) -> DataFrame:
    return df.select(
        F.lit(panel).alias("panel"),
        label.cast("string").alias("label"),
        value.cast("double").alias("value"),
    )


def dashboard(
    df: DataFrame,
    measure: str,
    date: str | None = None,
    product: str | None = None,
    region: str | None = None,
    category: str | None = None,
    kind: str = "sales",
    top: int = 10,
) -> DataFrame:
    """(panel, label, value): KPIs, monthly trend and the largest products, regions
    and categories."""
    if kind not in DASHBOARDS:
        raise ValueError(f"Unknown dashboard: {kind}")
    require_columns(df, measure, date, product, region, category)
    panels = {"top_products": product, "by_region": region, "by_category": category}
    keys = {panel: ref(column) for panel, column in panels.items() if column is not None}
    if date is not None:
        keys[START] = period_start(to_date(df, date), "month")
    sums = _sums_by_each(df.select(to_number(df, measure).alias(AMOUNT), *[c.alias(k) for k, c in keys.items()]), list(keys))
    rows = F.coalesce(F.max("rows"), F.lit(0)).cast("double")
    cards = {
        "Revenue" if kind == "sales" else "Total": F.coalesce(F.max("total"), F.lit(0.0)),
        "Average": F.coalesce(F.max("mean"), F.lit(0.0)),
        "Records": rows,
    }
    if kind == "sales" or any("order" in c.lower() for c in df.columns):
        cards["Orders"] = rows
        cards["AOV"] = F.try_divide(F.max("total"), rows)
    wide = sums(None).agg(*[c.alias(n) for n, c in cards.items()])
    pairs = F.array(
        *[F.struct(F.lit(n).alias("label"), ref(n).alias("value")) for n in cards]
    )
    long = wide.select(F.inline(pairs)).filter(F.col("value").isNotNull())
    parts = [_panel(long, "kpi", F.col("label"), F.col("value"))]
    filled = F.coalesce(F.col("total"), F.lit(0.0)).alias("total")
    if date is not None:
        # Told by the start and the count together, so that this test stays behind the shared shuffle too.
        dated = F.concat_ws(" ", "rows", ref(START).cast("string")).contains(" ")
        trend = growth_series(sums(START).filter(dated).select(ref(START), filled), "total")
        parts.append(_panel(trend, "trend", F.col("Period"), F.col("total")))
        growth = latest_of(trend).filter(F.col("growth_pct").isNotNull())
        parts.append(_panel(growth, "kpi", F.lit("MoM Growth %"), F.col("growth_pct")))
    for panel in panels:
        if panel in keys:
            largest = sums(panel).select(ref(panel), filled).orderBy(*order_keys(["total"], False), *order_keys([panel]))
            parts.append(_panel(largest.limit(top), panel, ref(panel), F.col("total")))
    return _union(parts)


AMOUNT = TEMP + "amount"


def _sums_by_each(df: DataFrame, keys: Sequence[str]):
    """Totals of the amount over all rows and by each key, in one pass over ``df``.

    The result gives the frame for a key (None: all rows). These frames share one
    aggregation: which rows a frame takes is told by a column that is only known after
    it, so the choice does not move into the scan and the shuffle is used again.
    """
    x, kinds = ref(AMOUNT), {k: df.schema[k].dataType for k in keys}
    sets = [
        F.struct(F.lit(at).alias("set"), *[(ref(k) if k == key else F.lit(None).cast(kinds[k])).alias(k) for k in keys])
        for at, key in enumerate([None, *keys])
    ]
    each = df.select(x, F.inline(F.array(*sets)))
    aggs = [F.sum(x).alias("total"), F.avg(x).alias("mean"), F.count(F.lit(1)).alias("rows")]
    table = each.groupBy("set", *map(ref, keys)).agg(*aggs)

    def frame(key: str | None) -> DataFrame:
        known = (F.col("rows") > 0) | (F.col("mean") > F.col("total"))  # always true, but needs all aggregates
        return table.filter(F.when(known, F.col("set")) == [None, *keys].index(key))

    return frame


def board(
    df: DataFrame,
    measure: str,
    group_by: str,
    date: str,
    grain: str = "month",
    n: int = 10,
    health: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The six frames of an overview: KPIs, trend, ranking, Pareto, outliers and
    descriptive statistics, over the columns they need."""
    require_columns(df, measure, group_by, date)
    return {
        "kpis": kpis(df, measure, health),
        "trend": period_growth(df, date, measure, grain),
        "ranking": top_n(df, measure, group_by, n),
        "pareto": pareto(df, measure, group_by),
        "outliers": outliers(df, measure),
        "descriptive": descriptive(df, measure),
    }


def long_board(frames: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Stack frames as (panel, label, value), given each one's label and value column."""
    return _union(
        [_panel(f, panel, ref(label), ref(value)) for panel, (f, label, value) in frames.items()]
    )


def task_frames(
    task: str,
    df: DataFrame,
    measure: str,
    group_by: str | None = None,
    date: str | None = None,
    metric: str = "sum",
    grain: str = "month",
    n: int = 10,
) -> dict[str, DataFrame]:
    """The frames a named task consists of."""
    if task == "monthly_trend":
        require_columns(df, date)
        return {
            "trend": period_growth(df, date, measure, grain),
            "descriptive": descriptive(df, measure),
        }
    if task in ("calculate", "pivot") and group_by is None:
        return {"summary": aggregate(df, measure, metric)}
    require_columns(df, group_by)
    if task == "top_n":
        return {"ranking": top_n(df, measure, group_by, n, metric=metric)}
    summary = summarize(df, group_by, measure, {metric: metric})
    if task in ("charts", "calculate", "pivot"):
        return {"summary": summary}
    if task == "compare":
        frames = {"summary": summary}
        if date is not None:
            frames["trend"] = period_growth(df, date, measure, grain)
        return frames
    if task == "summarize":
        return {"summary": summary, "pareto": pareto(df, measure, group_by)}
    return {"kpis": kpis(df, measure), "summary": summary}


def findings(
    df: DataFrame,
    measure: str,
    group_by: str | Sequence[str],
    metric: str = "sum",
    issues: DataFrame | None = None,
) -> DataFrame:
    """(kind, subject, value, severity): size, number of quality issues, leader."""
    keys = as_list(group_by)
    size = df.agg(F.count(F.lit(1)).alias("rows"))
    checked = quality_issues(df) if issues is None else issues
    flagged = checked.agg(F.count(F.lit(1)).alias("n"))
    leader = summarize(df, keys, measure, {metric: metric}, 1)
    count = F.when(F.col("n") > 0, F.col("n"))
    return _union(
        [
            _finding_rows(
                size,
                ("rows", None, F.col("rows"), "info"),
                ("columns", None, F.lit(len(df.columns)), "info"),
            ),
            _finding_rows(
                flagged,
                ("quality_issues", None, count, "alert"),
                ("clean_first", None, count, "recommendation"),
            ),
            _finding_rows(leader, ("leading_segment", ref(keys[0]), ref(metric), "info")),
        ]
    )
