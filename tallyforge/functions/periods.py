"""Calendar labels and date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = {
    "day": "day", "d": "day",
    "week": "week", "w": "week",
    "month": "month", "m": "month",
    "quarter": "quarter", "q": "quarter",
    "year": "year", "y": "year", "a": "year",
}


def canonical_grain(grain: str) -> str:
    key = grain.strip().lower()
    if key not in GRAINS:
        raise ValueError(f"Unsupported date grain: {grain}")
    return GRAINS[key]


def period_start(date: Column, grain: str) -> Column:
    """First day of the period, as a date (weeks start on Monday)."""
    grain, day = canonical_grain(grain), date.cast("date")
    return day if grain == "day" else F.trunc(day, grain)


def label_of_start(start: Column, grain: str) -> Column:
    """Text label of a period given its first day."""
    grain = canonical_grain(grain)
    if grain == "day":
        return F.date_format(start, "yyyy-MM-dd")
    if grain == "week":
        return F.concat(
            F.date_format(start, "yyyy-MM-dd"),
            F.lit("/"),
            F.date_format(F.date_add(start, 6), "yyyy-MM-dd"),
        )
    if grain == "quarter":
        return F.concat(F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string"))
    return F.date_format(start, "yyyy" if grain == "year" else "yyyy-MM")


def period_label(date: Column, grain: str = "month") -> Column:
    """``2024-05-07``, ``2024-12-30/2025-01-05``, ``2024-05``, ``2025Q1`` or ``2024``."""
    return label_of_start(period_start(date, grain), grain)


def fiscal_year(date: Column, first_month: int = 4) -> Column:
    """Year in which the fiscal year (April start by default) ends."""
    return F.year(date) + F.when(F.month(date) >= first_month, 1).otherwise(0)
