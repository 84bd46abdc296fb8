from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import aggregate as a
from tallyforge.operators import scenario as s

from helpers import pairs, plan, rows

REVENUE = [100, 50, 200, 90, 100, 300]


def test_metrics(shop):
    got = pairs(a.aggregate(shop, "revenue", ["sum", "avg", "count", "min", "max", "median", "variance", "nunique"]))
    assert got["sum"] == 840 and got["count"] == 6 and got["min"] == 50 and got["max"] == 300
    assert got["avg"] == 140 and got["median"] == 100 and got["nunique"] == 5
    assert got["variance"] == pytest.approx(statistics.pvariance(REVENUE))


def test_metrics_of_nothing_are_zero(shop):
    got = pairs(a.aggregate(shop.filter("id = 'x'"), "revenue", ["sum", "average", "min", "median"]))
    assert set(got.values()) == {0.0}
    with pytest.raises(ValueError, match="Unsupported metric"):
        a.aggregate(shop, "revenue", "mode")


def test_text_is_not_a_number(shop):
    assert pairs(a.aggregate(shop, "region", ["sum", "count"])) == {"sum": 0.0, "count": 0.0}


def test_groups_keep_nulls_and_order(shop):
    out = a.summarize(shop, "region", "revenue", {"total": "sum", "mean": "average", "middle": "median", "n": "count"})
    assert [tuple(r) for r in out.collect()] == [
        ("South", 300.0, 150.0, 150.0, 2),
        ("West", 300.0, 300.0, 300.0, 1),
        ("North", 150.0, 75.0, 75.0, 2),
        ("north ", 90.0, 90.0, 90.0, 1),
        (None, 0.0, None, None, 0),
    ]
    first = a.summarize(shop, ["region", "product"], "revenue", "max", top_n=1).collect()
    assert [tuple(r) for r in first] == [("West", "Coffee", 300.0)]


def test_ties_break_on_the_key(shop):
    assert [r.region for r in a.summarize(shop, "region", "revenue", top_n=2).collect()] == ["South", "West"]


def test_top_n_is_a_top_k_plan(shop):
    assert "TakeOrderedAndProject" in plan(a.summarize(shop, "region", "revenue", top_n=2))


def test_two_columns(shop):
    got = a.two_column_metrics(shop, "revenue", "cost").first()
    assert got.difference == 840 - 435
    assert got.percentage == pytest.approx(100 * 840 / 440)
    assert got.growth == pytest.approx(100 * 400 / 440)
    empty = a.two_column_metrics(shop.filter("id = 'x'"), "revenue", "cost").first()
    assert tuple(empty) == (0.0, 0.0, 0.0)


def test_contribution(shop):
    got = {r.region: r.contribution_pct for r in a.contribution(shop, "revenue", "region").collect()}
    assert got["South"] == pytest.approx(100 * 300 / 840) and got[None] == 0.0
    none = a.contribution(shop.filter("revenue is null"), "revenue", "region").collect()
    assert [r.contribution_pct for r in none] == [0.0]


def test_compare_values(shop):
    got = a.compare_values(shop, "revenue", "region", "South", "North").first()
    assert (got.left_value, got.right_value, got.absolute) == (300, 150, 150)
    assert got.growth_pct == got.percentage == 100 and got.ratio == 2
    exact = a.compare_values(shop, "revenue", "region", "South", "NORTH").first()
    assert exact.right_value == 0 and exact.growth_pct is None and exact.ratio is None


def test_conditionals(shop):
    assert tuple(a.sumif(shop, "region", "north", "revenue").first()) == (240.0, 3)
    both = [{"column": "region", "value": "north"}, {"column": "units", "op": ">", "value": 1}]
    assert tuple(a.sumifs(shop, "revenue", both).first()) == (190.0, 2)
    assert tuple(a.countif(shop, "product", "ea", "contains").first()) == (3, 3)
    assert tuple(a.countifs(shop, both).first()) == (2, 2)
    assert tuple(a.averageif(shop, "region", "south", "revenue").first()) == (150.0, 2)
    assert tuple(a.averageif(shop, "region", "east", "revenue").first()) == (0.0, 0)


def test_conditional_board(shop):
    tea = F.col("product") == "Tea"
    got = a.conditional_board(shop, {"n": (tea, None, "count"), "avg": (tea, "revenue", "average"),
                                     "none": (F.lit(None).cast("boolean"), "revenue", "sum")})
    assert pairs(got) == {"n": 3.0, "avg": 150.0, "none": 0.0}


def test_pivot(shop):
    out = a.pivot(shop, "product", "region", "revenue")
    assert out.columns == ["product", "North", "South", "West", "north "]
    got = {r["product"]: (r["North"], r["South"], r["West"]) for r in out.collect()}
    assert got == {"Tea": (100.0, 200.0, 0.0), "Cake": (50.0, 100.0, 0.0), "Coffee": (0.0, 0.0, 300.0)}
    median = a.pivot(shop, "product", None, "revenue", "median")
    assert pairs(median) == {"Tea": 150.0, "Cake": 75.0, "Coffee": 195.0}
    one = a.pivot(shop, None, "product", "revenue", "count", values=["Tea", "Milk"])
    assert rows(one, "Tea", "Milk") == [(2, 0)]
    assert pairs(a.pivot(shop, None, None, "revenue", "max")) == {"max": 300.0}
    dotted = a.pivot(shop, "product", "cost", "revenue").filter("product = 'Cake'")
    assert dotted.select("`20.0`", "`60.0`").first() == (50.0, 0.0)
    with pytest.raises(ValueError, match="more than 2"):
        a.pivot(shop, "product", "region", "revenue", max_columns=2)


def test_kpis_and_key_metrics(shop):
    got = pairs(a.kpis(shop, "revenue"))
    assert got == {"Records": 7.0, "Total revenue": 840.0, "Avg revenue": 140.0}
    assert len(pairs(a.kpis(shop))) == 7
    health = shop.limit(1).select(F.lit(88).alias("score"))
    assert pairs(a.kpis(shop, "revenue", health))["Data Health"] == 88.0
    figures = {r["column"]: r for r in a.key_metrics(shop).collect()}
    assert figures["units"].median == 2.5 and figures["cost"].total == 440.0


def test_descriptive(shop):
    got = pairs(a.descriptive(shop, "revenue"))
    assert got["std"] == pytest.approx(statistics.stdev(REVENUE))
    assert got["q1"] == 92.5 and got["q3"] == 175.0 and got["range"] == 250.0
    single = pairs(a.descriptive(shop.filter("id = 'S-1'"), "revenue"))
    assert single["std"] == 0.0 and single["variance"] == 0.0


def test_correlation(shop):
    got = a.correlation(shop, "revenue", "cost").first()
    assert (got.strength, got.direction) == ("strong", "positive")
    few = a.correlation(shop.limit(2), "revenue", "cost").first()
    assert few.correlation == 0.0 and few.strength == "weak"


def test_unique_values(shop):
    assert [tuple(r) for r in a.unique_values(shop, "product").collect()] == [
        ("Tea", 3), ("Cake", 2), ("Coffee", 2)]
    assert a.unique_values(shop, "region").count() == 4


def test_derived_measures(shop):
    roles = {"revenue": "revenue", "cost": "cost"}
    got = a.derived_measures(shop, roles, ["profit", "profit_margin", "aov", "orders"]).first()
    assert got.profit == 405 and got.profit_margin == pytest.approx(405 / 840)
    assert got.aov == 120 and got.orders == 7
    with pytest.raises(ValueError, match="Unknown measure"):
        a.derived_measures(shop, roles, ["magic"])
    with pytest.raises(ValueError, match="needs a column for discount"):
        a.derived_measures(shop, roles, ["discount_pct"])


def test_scenario(shop):
    got = {r.scenario: (r.value, r.difference) for r in s.scenario(shop, "revenue").collect()}
    assert len(got) == 5 and got["+10%"] == (924.0, 84.0) and got["-5%"] == (798.0, -42.0)
    assert s.scenario(shop, "revenue", scenarios=[3], group_by="product").count() == 3


def test_targets(spark, shop):
    goals = spark.createDataFrame([("Tea", 290.0), ("Cake", 200.0), ("Coffee", 420.0)], "product string, goal double")
    got = {r["product"]: (r.variance, r.achievement_pct, r.status) for r in
           s.actual_vs_target(shop, goals, "product", "revenue", "goal").collect()}
    assert got["Tea"] == (10.0, 103.45, "Excellent")
    assert got["Cake"] == (-50.0, 75.0, "Watch")
    assert got["Coffee"] == (-30.0, 92.86, "On Track")
    none = s.actual_vs_target(shop, goals.filter("goal = 0"), "product", "revenue", "goal").first()
    assert (none.achievement_pct, none.status, none.variance_pct) == (0.0, "Critical", 0.0)


def test_pnl_and_variance(shop):
    got = pairs(s.pnl(shop, "revenue", "cost"))
    assert got["Gross Profit"] == 400.0 and got["Gross Margin %"] == 47.62
    assert pairs(s.pnl(shop.filter("id = 'x'"), "revenue", "cost"))["Gross Margin %"] == 0.0
    rows_ = {r.id: (r.variance, r.variance_pct) for r in s.variance_rows(shop, "revenue", "cost").collect()}
    assert rows_["S-1"] == (40.0, 66.67) and rows_["S-7"] == (None, None)
    assert s.variance_total(shop, "revenue", "cost").first()[0] == 405.0


def test_pivot_computes_what_it_names(spark):
    df = spark.createDataFrame([("a", 5, "u"), ("a", 9, "v"), ("b", 3, "u"), ("b", 3, "u")], "k string, x int, t string")
    assert pairs(a.pivot(df, "k", None, "x", "variance")) == {"a": 4.0, "b": 0.0}
    assert pairs(a.pivot(df, "k", None, "t", "distinct_count")) == {"a": 2, "b": 1}
    assert rows(a.pivot(df, None, "k", "x", "variance"), "a", "b") == [(4.0, 0.0)]


def test_pivot_keeps_keys_apart(spark):
    df = spark.createDataFrame(
        [("r", "a_b", "c", 1), ("r", "a", "b_c", 10), ("r", "x", "y", 2), ("r", "X", "y", 4), ("r", "q", 'o"\\é', 8)],
        "x_y string, k string, l string, v int",
    )
    out = a.pivot(df, "x_y", ["k", "l"], "v")
    assert len(set(c.lower() for c in out.columns)) == len(out.columns) == 6
    assert sorted(out.first()[1:]) == [1.0, 2.0, 4.0, 8.0, 10.0]
    assert rows(a.pivot(df, "x_y", "k", "v", values=["q", "x"]), "q", "x") == [(8.0, 2.0)]


def test_text_is_counted_by_distinct_values(spark):
    df = spark.createDataFrame([("n", "Ann"), ("n", "Bob"), ("s", "Ann"), ("s", None)], "region string, name string")
    assert pairs(a.summarize(df, "region", "name", "distinct_count")) == {"n": 2, "s": 1}
    with pytest.raises(ValueError):
        a.summarize(df, "region", "name", {"region": "count"})


def test_key_metrics_of_many_columns(spark):
    df = spark.range(5).selectExpr(*[f"id * {i} AS c{i}" for i in range(1, 12)])
    figures = {r["column"]: r for r in a.key_metrics(df).collect()}
    assert len(figures) == 11 and figures["c11"]["median"] == 22.0
    assert len(pairs(a.kpis(df))) == 23


def test_margin_of_rows_with_both_sides(spark):
    df = spark.createDataFrame([(100.0, 60.0), (100.0, None)], "revenue double, cost double")
    got = a.derived_measures(df, {"revenue": "revenue", "cost": "cost"}, ["profit_margin"]).first()
    assert got.profit_margin == pytest.approx(0.4)
