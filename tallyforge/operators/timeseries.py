"""Period labels, growth, year-to-date totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import half_up, to_date, to_number
from ..functions.columns import TEMP, ref, require_columns
from ..functions.periods import fiscal_year, label_of_start, period_label, period_start

START = TEMP + "start"


def enrich_dates(df: DataFrame, date: str, fiscal_start: int = 4) -> DataFrame:
    """Add day, ISO week, month, month name, quarter, year, fiscal year and period."""
    when = to_date(df, date)
    parts = {
        "Day": F.day(when),
        "Week": F.weekofyear(when),
        "Month": F.month(when),
        "MonthName": F.date_format(when, "MMMM"),
        "Quarter": F.quarter(when),
        "Year": F.year(when),
        "FY": fiscal_year(when, fiscal_start),
        "Period": period_label(when, "month"),
    }
    return df.withColumns({f"{date}_{name}": column for name, column in parts.items()})


def growth_pct(value: Column, previous: Column) -> Column:
    """Change against the previous value in percent of its size; NULL against 0."""
    return half_up(F.try_divide(100 * (value - previous), F.abs(previous)), 2)


def _by_period(df: DataFrame, date: str, measure: str, grain: str, *keys: str) -> DataFrame:
    dated = df.select(
        *[ref(k) for k in keys],
        period_start(to_date(df, date), grain).alias(START),
        to_number(df, measure).alias(measure),
    )
    return (
        dated.filter(ref(START).isNotNull())
        .groupBy(*[ref(k) for k in keys], ref(START))
        .agg(F.coalesce(F.sum(ref(measure)), F.lit(0.0)).alias(measure))
    )


def period_growth(df: DataFrame, date: str, measure: str, grain: str = "month") -> DataFrame:
    """(Period, measure, growth_pct) for the periods present in the data.

    The window is not partitioned, but it sees one row per calendar period.
    """
    return growth_series(_by_period(df, date, measure, grain), measure, grain)


def growth_series(sums: DataFrame, measure: str, grain: str = "month") -> DataFrame:
    """(Period, measure, growth_pct), given a sum for each period's start."""
    previous = F.lag(ref(measure)).over(Window.orderBy(ref(START)))
    return sums.select(
        label_of_start(ref(START), grain).alias("Period"),
        ref(measure),
        growth_pct(ref(measure), previous).alias("growth_pct"),
    )


def latest_growth(df: DataFrame, date: str, measure: str, grain: str = "month") -> DataFrame:
    """One row: growth between the last two periods, NULL with fewer than two."""
    return latest_of(period_growth(df, date, measure, grain))


def latest_of(series: DataFrame) -> DataFrame:
    return series.agg(
        F.max("Period").alias("period"),
        F.max_by("growth_pct", "Period").alias("growth_pct"),
        F.count(F.lit(1)).alias("periods"),
    )


def ytd_total(
    df: DataFrame, date: str, measure: str, as_of: object | None = None, full_year: bool = False
) -> DataFrame:
    """One row (year, as_of, ytd_total) up to ``as_of`` or the latest date.

    ``full_year`` sums the whole year of the reference date. Without ``as_of`` the
    years are summed in one pass and the last one is kept.
    """
    when = to_date(df, date)
    dated = df.select(when.alias(START), to_number(df, measure).alias(measure)).filter(
        ref(START).isNotNull()
    )
    total = F.coalesce(F.sum(ref(measure)), F.lit(0.0))
    if as_of is None:
        years = dated.groupBy(F.year(ref(START)).alias("year")).agg(
            F.date_format(F.max(ref(START)), "yyyy-MM-dd").alias("as_of"), total.alias("ytd_total")
        )
        return years.agg(
            F.max("year").alias("year"),
            F.max_by("as_of", "year").alias("as_of"),
            F.coalesce(F.max_by("ytd_total", "year"), F.lit(0.0)).alias("ytd_total"),
        )
    end = F.lit(str(as_of)).cast("timestamp_ntz")
    first = F.trunc(end.cast("date"), "year")
    in_year = ref(START) >= first.cast("timestamp_ntz")
    until = (
        ref(START) < F.add_months(first, 12).cast("timestamp_ntz") if full_year else ref(START) <= end
    )
    return dated.filter(in_year & until).agg(
        F.lit(int(str(as_of)[:4])).alias("year"),
        F.lit(str(as_of)[:10]).alias("as_of"),
        total.alias("ytd_total"),
    )


def segment_decline(
    df: DataFrame, date: str, category: str, measure: str, grain: str = "month"
) -> DataFrame:
    """Last two periods of every category and whether the later one fell short.

    ``leading`` marks the category with the largest total. A category has one row
    per period here, so its window stays small.
    """
    require_columns(df, category)
    sums = _by_period(df, date, measure, grain, category)
    window = Window.partitionBy(ref(category)).orderBy(ref(START))
    previous = F.lag(ref(measure)).over(window)
    steps = sums.select(
        ref(category),
        ref(START),
        ref(measure).alias("current"),
        previous.alias("previous"),
    )
    last = steps.groupBy(ref(category)).agg(
        F.max_by(F.struct(ref(START), "current", "previous"), ref(START)).alias("last"),
        F.sum("current").alias("total"),
    )
    # Largest total first, first label on ties.
    leader = last.agg(
        F.min_by(F.struct(ref(category).alias("k")), F.struct((-F.col("total")).alias("t"), ref(category).alias("k")))
        .alias("leader")
    ).scalar()
    current, before = F.col("last.current"), F.col("last.previous")
    return last.select(
        ref(category),
        label_of_start(F.col(f"last.{START}"), grain).alias("Period"),
        before.alias("previous"),
        current.alias("current"),
        F.when(before != 0, growth_pct(current, before)).alias("change_pct"),
        F.coalesce((before != 0) & (current < before), F.lit(False)).alias("declined"),
        ref(category).eqNullSafe(leader["k"]).alias("leading"),
    )
