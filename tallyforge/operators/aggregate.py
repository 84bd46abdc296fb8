"""Totals, grouped aggregates, conditional aggregates, pivots and KPIs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import finite, half_up, to_number
from ..functions.columns import (
    TEMP,
    as_list,
    key_values,
    numbered,
    numeric_columns,
    order_keys,
    raw_value,
    ref,
    require_columns,
)
from ..functions.predicates import criteria, flag
from .ordered import exact_percentiles, with_percentiles

VALUE, RAW = TEMP + "value", TEMP + "raw"

# Accepted spellings of each metric.
METRIC_NAMES = {
    "sum": ("sum", "total"),
    "average": ("average", "avg", "mean"),
    "count": ("count", "counta"),
    "min": ("min",),
    "max": ("max",),
    "median": ("median",),
    "variance": ("variance",),
    "distinct_count": ("distinct_count", "nunique", "distinct"),
}

_CANONICAL = {alias: name for name, aliases in METRIC_NAMES.items() for alias in aliases}


def canonical_metric(metric: str) -> str:
    key = metric.strip().lower()
    if key not in _CANONICAL:
        raise ValueError(f"Unsupported metric: {metric}")
    return _CANONICAL[key]


def metric_column(metric: str, x: Column, approx: bool = False) -> Column:
    """Aggregate expression for every metric except the median."""
    name = canonical_metric(metric)
    if name == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if name == "average":
        return F.avg(x)
    if name == "count":
        return F.count(x)
    if name == "min":
        return F.min(x)
    if name == "max":
        return F.max(x)
    if name == "variance":
        return F.var_pop(x)
    if name == "distinct_count":
        return F.approx_count_distinct(x) if approx else F.count_distinct(x)
    raise ValueError(f"'{metric}' is not a plain aggregate.")


def group_metrics(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    metrics: Mapping[str, str],
    approx: bool = False,
    accuracy: int | None = None,
    raw: Column | None = None,
) -> DataFrame:
    """``keys`` plus one column per ``{output: metric}``; NULL keys form a group.

    Distinct values are counted in ``raw``, the value before it was read as a number.
    """
    if clash := {k.lower() for k in keys} & {o.lower() for o in metrics}:
        raise ValueError(f"Outputs named like keys: {', '.join(sorted(clash))}")
    raw = value if raw is None else raw
    work = df.select(*[ref(k) for k in keys], value.alias(VALUE), raw.alias(RAW))
    aggs, medians = {}, []
    for output, metric in metrics.items():
        name = canonical_metric(metric)
        if name == "median":
            medians.append(output)
        else:
            aggs[output] = metric_column(metric, ref(RAW if name == "distinct_count" else VALUE), approx)
    if accuracy is not None:
        aggs |= {o: F.percentile_approx(ref(VALUE), 0.5, accuracy).cast("double") for o in medians}
        medians = []
    if not medians:
        return work.groupBy(*[ref(k) for k in keys]).agg(*[aggs[o].alias(o) for o in metrics])
    middle = medians[0]
    out = with_percentiles(work, VALUE, [0.5], [middle], keys, aggs)
    return out.select(*[ref(k) for k in keys], *[ref(middle if o in medians else o).alias(o) for o in metrics])


def aggregate(
    df: DataFrame, measure: str, metrics: str | Sequence[str] = "sum", accuracy: int | None = None
) -> DataFrame:
    """(metric, value) rows over the readable numbers of one column; nothing → 0."""
    names = as_list(metrics)
    wide = group_metrics(
        df, [], to_number(df, measure), {n: n for n in names}, accuracy=accuracy, raw=raw_value(df, measure)
    )
    filled = wide.select(
        *[F.coalesce(ref(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    )
    return key_values(filled, "metric", "value", names)


def summarize(
    df: DataFrame,
    group_by: str | Sequence[str],
    measure: str,
    metrics: str | Sequence[str] | Mapping[str, str] = "sum",
    top_n: int | None = None,
    ascending: bool = False,
    sort: bool = True,
    approx: bool = False,
    accuracy: int | None = None,
) -> DataFrame:
    """Grouped aggregates, ordered by the first metric, then by the keys."""
    keys = as_list(group_by)
    require_columns(df, keys, measure)
    outputs = (
        dict(metrics) if isinstance(metrics, Mapping) else {m: m for m in as_list(metrics)}
    )
    out = group_metrics(df, keys, to_number(df, measure), outputs, approx, accuracy, raw_value(df, measure))
    if sort or top_n:
        first = next(iter(outputs))
        out = out.orderBy(*order_keys([first], ascending), *order_keys(keys))
    return out.limit(top_n) if top_n else out


def calculate(
    df: DataFrame,
    measure: str,
    metric: str = "sum",
    group_by: str | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """One metric, overall (metric, value) or per group (group, metric)."""
    if group_by is None:
        return aggregate(df, measure, metric, accuracy)
    return summarize(df, group_by, measure, metric, accuracy=accuracy)


def two_column_metrics(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: sum of differences, left as % of right, growth of left over right."""
    a, b = to_number(df, left), to_number(df, right)
    sums = df.select(a.alias("a"), b.alias("b")).agg(
        F.coalesce(F.sum(F.col("a") - F.col("b")), F.lit(0.0)).alias("difference"),
        F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"),
        F.coalesce(F.sum("b"), F.lit(0.0)).alias("b"),
    )
    return sums.select(
        "difference",
        F.coalesce(F.try_divide(100 * F.col("a"), F.col("b")), F.lit(0.0)).alias("percentage"),
        F.coalesce(
            F.try_divide(100 * (F.col("a") - F.col("b")), F.abs(F.col("b"))), F.lit(0.0)
        ).alias("growth"),
    )


def with_share(
    grouped: DataFrame, value: str, output: str, digits: int | None = None
) -> DataFrame:
    """Add the percentage of the column total; a zero total gives 0.

    The total is a scalar subquery over the grouped rows, not a window, so the
    groups stay spread over the cluster.
    """
    total = grouped.agg(F.sum(ref(value)).cast("double").alias("total")).scalar()
    share = F.coalesce(F.try_divide(100 * ref(value), total), F.lit(0.0))
    return grouped.withColumn(output, share if digits is None else half_up(share, digits))


def contribution(df: DataFrame, measure: str, group_by: str) -> DataFrame:
    """Group sums and their share of the total, largest first."""
    sums = summarize(df, group_by, measure, {"sum": "sum"}, sort=False)
    return with_share(sums, "sum", "contribution_pct").orderBy(
        *order_keys(["sum"], False), *order_keys([group_by])
    )


def compare(df: DataFrame, measure: str, dimension: str, metric: str = "sum") -> DataFrame:
    """Metric per value of a dimension, largest first."""
    return summarize(df, dimension, measure, {metric: metric})


def compare_values(
    df: DataFrame, measure: str, dimension: str, left: object, right: object, metric: str = "sum"
) -> DataFrame:
    """One row setting two values of a dimension side by side.

    Keys match exactly. A missing value counts 0; a zero right side leaves growth,
    percentage and ratio NULL.
    """
    require_columns(df, measure, dimension)
    sides = df.filter(ref(dimension).cast("string").isin(str(left), str(right)))
    grouped = group_metrics(
        sides.withColumn(TEMP + "side", ref(dimension).cast("string")),
        [TEMP + "side"],
        to_number(df, measure),
        {"m": metric},
    )

    def side(value: object) -> Column:
        hit = F.max(F.when(ref(TEMP + "side") == F.lit(str(value)), F.col("m").cast("double")))
        return F.coalesce(hit, F.lit(0.0))

    both = grouped.agg(side(left).alias("left_value"), side(right).alias("right_value"))
    change = F.col("left_value") - F.col("right_value")
    relative = F.try_divide(100 * change, F.abs(F.col("right_value")))
    return both.select(
        "left_value",
        "right_value",
        change.alias("absolute"),
        relative.alias("percentage"),
        relative.alias("growth_pct"),
        F.try_divide(F.col("left_value"), F.col("right_value")).alias("ratio"),
    )


def conditional_aggregate(
    df: DataFrame,
    conditions: Sequence[Mapping[str, object]],
    measure: str | None = None,
    metric: str = "sum",
) -> DataFrame:
    """One row (value, matched_rows) over the rows meeting all conditions.

    The conditions are a plain filter, so the scan skips what it can.
    """
    require_columns(df, [str(c["column"]) for c in conditions], measure)
    rows = df.filter(criteria(df, conditions))
    matched = F.count(F.lit(1)).alias("matched_rows")
    if measure is None:
        return rows.agg(F.count(F.lit(1)).alias("value"), matched)
    value = metric_column(metric, to_number(df, measure))
    return rows.agg(F.coalesce(value, F.lit(0.0)).alias("value"), matched)


def sumif(df: DataFrame, column: str, value: object, measure: str, op: str = "=") -> DataFrame:
    return conditional_aggregate(df, [{"column": column, "op": op, "value": value}], measure)


def sumifs(df: DataFrame, measure: str, conditions: Sequence[Mapping[str, object]]) -> DataFrame:
    return conditional_aggregate(df, conditions, measure)


def countif(df: DataFrame, column: str, value: object, op: str = "=") -> DataFrame:
    return conditional_aggregate(df, [{"column": column, "op": op, "value": value}])


def countifs(df: DataFrame, conditions: Sequence[Mapping[str, object]]) -> DataFrame:
    return conditional_aggregate(df, conditions)


def averageif(df: DataFrame, column: str, value: object, measure: str, op: str = "=") -> DataFrame:
    return conditional_aggregate(
        df, [{"column": column, "op": op, "value": value}], measure, "average"
    )


def conditional_board(
    df: DataFrame, cases: Mapping[str, tuple[Column, str | None, str]]
) -> DataFrame:
    """Several conditional aggregates in one pass: ``{name: (test, measure, metric)}``."""
    aggs = []
    for name, (test, measure, metric) in cases.items():
        x = F.lit(1.0) if measure is None else to_number(df, measure)
        picked = metric_column(metric, F.when(flag(test), x))
        aggs.append(F.coalesce(picked.cast("double"), F.lit(0.0)).alias(name))
    return key_values(df.agg(*aggs), "name", "value", list(cases))


def pivot_values(df: DataFrame, columns: Sequence[str], max_columns: int = 10000) -> list[tuple[str, ...]]:
    """Keys, as text, that a pivot has a column for, in order; more than ``max_columns`` is an error.

    Column names are schema, so they are read here; at most ``max_columns + 1``
    short rows come to the driver.
    """
    texts = [ref(c).cast("string") for c in columns]
    found = df.filter(_all_present(columns)).select(*texts).distinct().limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError(f"The pivot would have more than {max_columns} columns.")
    return sorted(map(tuple, found), key=lambda key: ("_".join(key), key))


def _all_present(names: Sequence[str]) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & ref(n).isNotNull()
    return test


def pivot(
    df: DataFrame,
    rows: str | Sequence[str] | None,
    columns: str | Sequence[str] | None,
    measure: str,
    metric: str = "sum",
    values: Sequence[str] | Sequence[Sequence] | None = None,
    max_columns: int = 10000,
    accuracy: int | None = None,
) -> DataFrame:
    """Cross-tabulation; empty cells are 0 and NULL keys are left out.

    Cells belong to the key columns themselves, and a cell's column is named after its
    keys, joined by ``_``; a name that is taken already (ignoring case) gets a number.
    ``values`` gives the keys (a tuple each, or a value if there is one column) and saves
    the pass that looks for them.
    """
    rows, columns = as_list(rows), as_list(columns)
    require_columns(df, rows, columns, measure)
    canonical_metric(metric)
    if not rows and not columns:
        return aggregate(df, measure, metric, accuracy)
    kept = df.filter(_all_present([*rows, *columns]))
    value, raw = to_number(df, measure), raw_value(df, measure)
    if not columns:
        out = group_metrics(kept, rows, value, {VALUE: metric}, accuracy=accuracy, raw=raw)
        name = numbered([*rows, metric])[-1]
        return out.select(*map(ref, rows), F.coalesce(ref(VALUE), F.lit(0)).alias(name))

    if values is None:
        keys = pivot_values(kept, columns, max_columns)
    else:
        keys = [tuple(map(str, v)) if isinstance(v, (list, tuple)) else (str(v),) for v in values]
    names = numbered([*rows, *map("_".join, keys)])[len(rows) :]
    cells = group_metrics(kept, [*rows, *columns], value, {VALUE: metric}, accuracy=accuracy, raw=raw)
    texts = [json.dumps(k, ensure_ascii=False, separators=(",", ":")) for k in keys]
    cell = TEMP + "cell"
    keyed = cells.withColumn(cell, _key_text([ref(c).cast("string") for c in columns]))
    # Cells are unique per row and key by now, so picking one value is enough.
    table = keyed.groupBy(*map(ref, rows)).pivot(cell, texts).agg(F.first(ref(VALUE), ignorenulls=True))
    table = table.toDF(*rows, *names)
    return table.select(*map(ref, rows), *[F.coalesce(ref(n), F.lit(0)).alias(n) for n in names])


def _key_text(parts: Sequence[Column]) -> Column:
    """The values of a key as one text that tells them apart, as ``json.dumps`` writes it."""
    return F.to_json(F.array(*parts))


def kpis(
    df: DataFrame, measures: str | Sequence[str] | None = None, health: DataFrame | None = None
) -> DataFrame:
    """(kpi, value): record count, then total and average per measure.

    Without ``measures`` all numeric columns are used. ``health`` is a
    one-row frame with a ``score`` column.
    """
    names = as_list(measures) or numeric_columns(df)
    aggs = [F.count(F.lit(1)).cast("double").alias("Records")]
    for n in names:
        x = to_number(df, n)
        aggs.append(F.coalesce(F.sum(x), F.lit(0.0)).alias(f"Total {n}"))
        aggs.append(F.coalesce(F.avg(x), F.lit(0.0)).alias(f"Avg {n}"))
    cards = key_values(df.agg(*aggs), "kpi", "value")
    if health is None:
        return cards
    return cards.unionByName(
        health.select(F.lit("Data Health").alias("kpi"), F.col("score").cast("double").alias("value"))
    )


def key_metrics(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """total, average, median, min, max of the numeric columns, or of those named; columns without values are left out.

    All columns are aggregated side by side, medians as in :func:`exact_percentiles`.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        raise ValueError("No numeric columns.")
    require_columns(df, names)
    figures = metrics_row(df, names, accuracy)
    each = [F.struct(F.lit(n).alias("column"), *[ref(metric_name(k, i)).alias(k) for k in METRIC_KINDS]) for i, n in enumerate(names)]
    return figures.select(F.inline(F.array(*each))).filter("n > 0").drop("n")


METRIC_KINDS = ("total", "average", "median", "min", "max", "n")


def metric_name(kind: str, place: int) -> str:
    """The column of ``metrics_row`` with a figure of the column at a place."""
    return f"{TEMP}{kind}{place}"


def metrics_row(
    df: DataFrame, names: Sequence[str], accuracy: int | None = None, aggs: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row with the figures of ``METRIC_KINDS`` of every column and the aggregates ``aggs`` of ``df`` beside them."""
    values = {metric_name("value", i): to_number(df, n) for i, n in enumerate(names)}
    wide = df.withColumns(values) if values else df
    plain = {"total": F.sum, "average": F.avg, "min": F.min, "max": F.max, "n": F.count}
    aggs = dict(aggs or {}) | {metric_name(kind, i): make(v) for i, v in enumerate(values) for kind, make in plain.items()}
    medians = {metric_name("median", i): v for i, v in enumerate(values)}
    if accuracy is not None:
        aggs |= {output: F.percentile_approx(v, 0.5, accuracy).cast("double") for output, v in medians.items()}
        return wide.agg(*[c.alias(n) for n, c in aggs.items()])
    return exact_percentiles(wide, [(v, 0.5, output) for output, v in medians.items()], aggs)


def descriptive(df: DataFrame, measure: str, accuracy: int | None = None) -> DataFrame:
    """(statistic, value): count, mean, median, min, max, sample std and variance,
    quartiles, range. One value alone has no spread (0)."""
    work = df.select(to_number(df, measure).alias(VALUE))
    x = ref(VALUE)
    aggs = {
        "count": F.count(x),
        "mean": F.avg(x),
        "min": F.min(x),
        "max": F.max(x),
        "std": F.coalesce(finite(F.stddev_samp(x)), F.lit(0.0)),
        "variance": F.coalesce(finite(F.var_samp(x)), F.lit(0.0)),
    }
    places, quartiles = [0.25, 0.5, 0.75], ["q1", "median", "q3"]
    if accuracy is not None:
        sketched = [F.percentile_approx(x, p, accuracy).cast("double").alias(q) for p, q in zip(places, quartiles)]
        figures = work.agg(*[c.alias(n) for n, c in aggs.items()], *sketched)
    else:
        figures = with_percentiles(work, VALUE, places, quartiles, aggs=aggs)
    stats = figures.select(
        "count", "mean", "median", "min", "max", "std", "variance", "q1", "q3",
        (F.col("max") - F.col("min")).alias("range"),
    )
    return key_values(stats, "statistic", "value")


def correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: Pearson coefficient over complete pairs, strength and direction."""
    pairs = df.select(to_number(df, left).alias("a"), to_number(df, right).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    stats = pairs.agg(
        F.count("a").alias("n"),
        finite(F.corr(F.when(both, F.col("a")), F.when(both, F.col("b")))).alias("r"),
    )
    r = F.when(F.col("n") > 2, F.col("r")).otherwise(F.lit(0.0))
    size = F.abs(F.col("correlation"))
    return stats.select(r.alias("correlation")).select(
        F.lit(left).alias("field_a"),
        F.lit(right).alias("field_b"),
        half_up(F.col("correlation"), 4).alias("correlation"),
        F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").otherwise("weak").alias("strength"),
        F.when(F.col("correlation") >= 0, "positive").otherwise("negative").alias("direction"),
    )


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values with their row counts, most frequent first."""
    require_columns(df, column)
    counts = df.filter(ref(column).isNotNull()).groupBy(ref(column)).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.orderBy(F.col("count").desc(), ref(column).asc())


# Business measures and the inputs each one needs.
DERIVED_MEASURES = {
    "profit": ("revenue", "cost"),
    "profit_margin": ("revenue", "cost"),
    "aov": ("revenue",),
    "orders": (),
    "discount_pct": ("discount", "revenue"),
}


def _inputs(measure: str, mapping: Mapping[str, str]) -> list[str]:
    if measure not in DERIVED_MEASURES:
        raise ValueError(f"Unknown measure: {measure}")
    missing = [m for m in DERIVED_MEASURES[measure] if m not in mapping]
    if missing:
        raise ValueError(f"Measure '{measure}' needs a column for {', '.join(missing)}.")
    return [mapping[m] for m in DERIVED_MEASURES[measure]]


def measure_column(df: DataFrame, measure: str, mapping: Mapping[str, str]) -> Column:
    """Row-level value of a derived measure (``aov`` is the row's revenue)."""
    cols = [to_number(df, c) for c in _inputs(measure, mapping)]
    if measure == "profit":
        return cols[0] - cols[1]
    if measure == "profit_margin":
        return F.try_divide(cols[0] - cols[1], cols[0])
    if measure == "aov":
        return cols[0]
    if measure == "discount_pct":
        return F.try_divide(cols[0], cols[1])
    return F.lit(1.0)


def derived_measures(
    df: DataFrame,
    mapping: Mapping[str, str],
    measures: Sequence[str] | None = None,
    group_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Business measures, overall or per group; ratios are ratios of sums."""
    names = list(measures) if measures is not None else list(DERIVED_MEASURES)
    keys = as_list(group_by)
    require_columns(df, keys)
    sources = {role for n in names if _inputs(n, mapping) is not None for role in DERIVED_MEASURES[n]}
    work = df.select(
        *[ref(k) for k in keys], *[to_number(df, mapping[r]).alias(TEMP + r) for r in sorted(sources)]
    )

    def total(role: str) -> Column:
        return F.coalesce(F.sum(ref(TEMP + role)), F.lit(0.0))

    aggs = []
    for n in names:
        if n == "profit":
            # Rows lacking either side have no profit.
            out = F.coalesce(F.sum(ref(TEMP + "revenue") - ref(TEMP + "cost")), F.lit(0.0))
        elif n == "profit_margin":
            # Of rows with both sides only.
            both = F.when(ref(TEMP + "cost").isNotNull(), ref(TEMP + "revenue"))
            out = F.try_divide(F.sum(both - ref(TEMP + "cost")), F.coalesce(F.sum(both), F.lit(0.0)))
        elif n == "aov":
            out = F.try_divide(total("revenue"), F.count(F.lit(1)).cast("double"))
        elif n == "discount_pct":
            out = F.try_divide(total("discount"), total("revenue"))
        else:
            out = F.count(F.lit(1)).cast("double")
        aggs.append(out.alias(n))
    return work.groupBy(*[ref(k) for k in keys]).agg(*aggs)
