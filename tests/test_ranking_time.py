from __future__ import annotations

import pytest

from tallyforge.operators import outliers as o
from tallyforge.operators import ranking as r
from tallyforge.operators import timeseries as t

from helpers import plan, rows


def test_top_n(shop):
    got = [tuple(x) for x in r.top_n(shop, "revenue", "product", 2).collect()]
    assert got == [("Coffee", 390.0, 1, 56.52), ("Tea", 300.0, 2, 43.48)]
    low = [tuple(x) for x in r.top_n(shop, "revenue", "product", 1, True, "average").collect()]
    assert low == [("Cake", 75.0, 1, 100.0)]
    nothing = r.top_n(shop.filter("revenue is null"), "revenue", "product").collect()
    assert nothing[0].contribution_pct is None
    assert "TakeOrderedAndProject" in plan(r.top_n(shop, "revenue", "product", 2))


def test_running_total(shop):
    got = sorted(tuple(x) for x in r.running_total(shop, "revenue", "product").collect())
    assert got == [("Cake", 150.0, 150.0), ("Coffee", 390.0, 840.0), ("Tea", 300.0, 450.0)]


def test_pareto(spark, shop):
    data = [("a", 70.0), ("b", 15.0), ("c", 12.0), ("d", 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = rows(r.pareto(df, "v", "k"))
    assert got == [("a", 70.0, 70.0, 70.0, "A"), ("b", 15.0, 15.0, 85.0, "B"),
                   ("c", 12.0, 12.0, 97.0, "C"), ("d", 3.0, 3.0, 100.0, "C")]
    assert rows(r.pareto_summary(r.pareto(df, "v", "k", 85))) == [(2, 85.0)]
    single = r.pareto(df.filter("k = 'a'"), "v", "k").first()
    assert (single.contribution_pct, single.segment) == (100.0, "C")
    zero = r.pareto(df.selectExpr("k", "0.0 v"), "v", "k").collect()
    assert {x.contribution_pct for x in zero} == {0.0} and {x.segment for x in zero} == {"A"}


def test_pareto_adds_rounded_shares(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(3)], "k int, v double")
    assert [x.cumulative_pct for x in r.pareto(df, "v", "k").orderBy("k").collect()] == [33.33, 66.66, 99.99]


def test_top_rows(shop):
    assert [x.id for x in r.top_rows(shop, "revenue", 3).collect()] == ["S-6", "S-3", "S-1"]
    assert [x.id for x in r.top_rows(shop, "revenue", 1, True).collect()] == ["S-2"]
    assert [x["product"] for x in r.top_labels(shop, "revenue", "product", 1).collect()] == ["Coffee"]
    assert [tuple(x) for x in r.chart_series(shop, "product", "units", "count", 1).collect()] == [("Cake", 2)]


def test_growth(shop):
    got = rows(t.period_growth(shop, "day", "revenue"))
    assert got == [("2025-01", 150.0, None), ("2025-02", 290.0, 93.33),
                   ("2025-03", 400.0, 37.93), ("2025-04", 0.0, -100.0)]
    last = t.latest_growth(shop, "day", "revenue", "Q").first()
    assert tuple(last) == ("2025Q2", -100.0, 2)
    assert t.latest_growth(shop.limit(1), "day", "revenue").first().growth_pct is None


def test_growth_over_zero_is_null(spark):
    df = spark.createDataFrame([("2024-01-01", 0.0), ("2024-02-01", 5.0), ("bad", 9.0)], "d string, v double")
    assert rows(t.period_growth(df, "d", "v")) == [("2024-01", 0.0, None), ("2024-02", 5.0, None)]


def test_enrich(shop):
    got = t.enrich_dates(shop, "day").filter("id = 'S-7'").first()
    assert (got.day_Day, got.day_Week, got.day_Month, got.day_MonthName) == (1, 14, 4, "April")
    assert (got.day_Quarter, got.day_Year, got.day_FY, got.day_Period) == (2, 2025, 2026, "2025-04")


def test_ytd(spark, shop):
    assert tuple(t.ytd_total(shop, "day", "revenue").first()) == (2025, "2025-04-01", 840.0)
    assert tuple(t.ytd_total(shop, "day", "revenue", "2025-02-10").first()) == (2025, "2025-02-10", 350.0)
    assert t.ytd_total(shop, "day", "revenue", "2025-02-10", full_year=True).first().ytd_total == 840.0
    old = spark.createDataFrame([("2023-05-05", 1.0), ("2024-01-01", 2.0)], "d string, v double")
    assert tuple(t.ytd_total(old, "d", "v").first()) == (2024, "2024-01-01", 2.0)
    assert t.ytd_total(old.filter("v > 9"), "d", "v").first().ytd_total == 0.0


def test_segment_decline(shop):
    got = {x["product"]: x for x in t.segment_decline(shop, "day", "product", "revenue").collect()}
    assert got["Tea"].declined and got["Tea"].change_pct == -100.0 and not got["Tea"].leading
    assert got["Coffee"].leading and not got["Coffee"].declined and got["Coffee"].previous == 90.0
    assert got["Cake"].Period == "2025-03"


def test_outliers(spark):
    values = [10.0] * 5 + [11.0, 12.0, 13.0, 100.0, None, -50.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {x.i: x for x in o.outliers(df, "v").collect()}
    assert set(got) == {8, 10} and got[8].severity == "high" and got[10].severity == "medium"
    assert got[8].expected_range == "7.38 – 14.38"
    assert o.outliers(df.limit(3), "v").count() == 0
    assert o.outliers(df.limit(5), "v", "zscore").count() == 0
    many = spark.createDataFrame([(float(i % 3),) for i in range(60)] + [(99.0,)], "v double")
    assert [x.v for x in o.outliers(many, "v", "zscore").collect()] == [99.0]
    zero = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)], "v double")
    assert [x.severity for x in o.outliers(zero, "v").collect()] == ["high"]
    with pytest.raises(ValueError):
        o.outliers(df, "v", "magic")


def test_outlier_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(100).selectExpr("cast(id as double) v").unionByName(
        spark.sql("SELECT 1e6D v UNION ALL SELECT double('NaN')")
    ).write.parquet(path)
    hits = o.outliers(spark.read.parquet(path), "v")
    assert [x.v for x in hits.collect()] == [1e6]
    assert "Or(LessThan(v," in plan(hits)
