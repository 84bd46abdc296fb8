"""Outlier rows by quartile fences or z-score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_number
from ..functions.columns import TEMP, is_numeric, ref, require_columns
from .ordered import with_percentiles

V = TEMP + "v"


def fences(df: DataFrame, measure: str, method: str = "iqr", accuracy: int | None = None) -> DataFrame:
    """One row: number of values, median, and the range values are expected in."""
    if method not in ("iqr", "zscore"):
        raise ValueError(f"Unsupported outlier method: {method}")
    work = df.select(to_number(df, measure).alias(V))
    x = ref(V)
    aggs = {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x)}
    places = {"q1": 0.25, "median": 0.5, "q3": 0.75} if method == "iqr" else {"median": 0.5}
    if accuracy is None:
        base = with_percentiles(work, V, list(places.values()), list(places), aggs=aggs)
    else:
        aggs |= {q: F.percentile_approx(x, p, accuracy).cast("double") for q, p in places.items()}
        base = work.agg(*[c.alias(name) for name, c in aggs.items()])
    if method == "iqr":
        spread = 1.5 * (F.col("q3") - F.col("q1"))
        low, high = F.col("q1") - spread, F.col("q3") + spread
    else:
        # A constant column has no fences.
        spread = F.when(F.col("std") > 0, 3 * F.col("std"))
        low, high = F.col("mean") - spread, F.col("mean") + spread
    return base.select("n", "median", low.alias("low"), high.alias("high"))


def outliers(
    df: DataFrame, measure: str, method: str = "iqr", accuracy: int | None = None
) -> DataFrame:
    """Rows outside the expected range, with that range and a severity.

    High means more than five times the median in size (or a zero median). Fewer
    than four values give no outliers. The four numbers of the fences are read
    first: as constants they let the file scan skip whatever lies inside.
    """
    require_columns(df, measure)
    found = fences(df, measure, method, accuracy).first()
    fenced = found.n >= 4 and found.low is not None
    low, high, median = (F.lit(x).cast("double") for x in (found.low, found.high, found.median))
    rows = df if fenced else df.limit(0)
    if is_numeric(df, measure):
        rows = rows.filter((ref(measure) < low) | (ref(measure) > high))
    v = ref(V)
    hits = rows.withColumn(V, to_number(df, measure)).filter((v < low) | (v > high))
    large = (median == 0) | (F.abs(v) > 5 * F.abs(median))
    return hits.select(
        *[ref(c) for c in df.columns],
        low.alias("expected_low"),
        high.alias("expected_high"),
        F.format_string("%,.2f – %,.2f", low, high).alias("expected_range"),
        F.when(large, "high").otherwise("medium").alias("severity"),
    )
