from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyforge.operators import rows as r

from helpers import pairs, rows


def test_filter_and_counts(shop):
    assert r.filter_rows(shop, "region", "=", "north").count() == 3
    assert rows(r.match_count(shop, "revenue", ">", 95)) == [(4, 7)]
    assert r.apply_filter(shop, None, "x") is shop
    assert r.apply_filter(shop, "nowhere", "x") is shop
    assert r.apply_filters(shop, []) is shop


def test_math(shop):
    out = r.math_expression(shop, "revenue", "-", "cost", "profit")
    assert pairs(out.select("id", "profit"))["S-3"] == 80.0
    assert pairs(out.select("id", "profit"))["S-7"] is None
    zero = r.math_expression(shop, "revenue", "div", 0, "q")
    assert {x.q for x in zero.collect()} == {None}
    pct = r.math_expression(shop, "cost", "%", "revenue", "q")
    assert pairs(pct.select("id", "q"))["S-1"] == 60.0
    with pytest.raises(ValueError):
        r.math_expression(shop, "cost", "^", 2)


def test_flag(shop):
    flagged = r.logical_flag(shop, "revenue", ">", 95, "big", "small", "size")
    assert pairs(r.flag_counts(flagged, "size")) == {"big": 4, "small": 3}


def test_multi_lookup(shop):
    out = r.multi_condition_lookup(
        shop, [{"column": "region", "value": "north"}, {"column": "product", "value": "TEA"}], ["id", "nope"]
    )
    assert rows(out) == [("S-1",)]
    with pytest.raises(ValueError):
        r.multi_condition_lookup(shop, [{"column": "nope", "value": 1}])


def test_unpivot(shop):
    out = r.unpivot_fields(shop.filter("id = 'S-1'"), "id", ["region", "revenue"])
    assert rows(out) == [("S-1", "region", "North"), ("S-1", "revenue", "100")]


def test_date_range(shop):
    assert r.date_range(shop, "day", "all") is shop
    assert {x.id for x in r.date_range(shop, "day", "last_30").collect()} == {"S-5", "S-6", "S-7"}
    assert {x.id for x in r.date_range(shop, "day", "this_month", "2025-02-10").collect()} == {"S-3"}
    assert r.date_range(shop, "day", "this_year").count() == 7
    with pytest.raises(ValueError):
        r.date_range(shop, "day", "someday")


def test_sort_puts_nulls_last(shop):
    up = [x.id for x in r.sort_rows(shop, "revenue").collect()]
    down = [x.id for x in r.sort_rows(shop, "revenue", False).collect()]
    assert up == ["S-2", "S-4", "S-1", "S-5", "S-3", "S-6", "S-7"]
    assert down == ["S-6", "S-3", "S-1", "S-5", "S-4", "S-2", "S-7"]
    assert r.limit_rows(shop, "0") is shop and r.limit_rows(shop, "2").count() == 2


def test_search_pages(shop):
    columns = ["id", "region", "product"]
    assert rows(r.search_total(shop, "TEA", columns)) == [(3, 1)]
    shallow = [x.id for x in r.search_rows(shop, "e", columns, "id", False, 1, 3).collect()]
    assert shallow == ["S-6", "S-5", "S-4"]
    deep = [x.id for x in r.search_rows(shop, "e", columns, "id", False, 1, 3, deep=True).collect()]
    assert deep == shallow
    assert r.search_rows(shop, "t.a", columns, regex=True).count() == 3
    assert r.search_rows(shop, "t.a", columns).count() == 0


def test_deep_page_keeps_equal_rows(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)], "x string")
    assert [x.x for x in r.search_rows(df, "", offset=3, limit=3, deep=True).collect()] == ["a", "a", "b"]


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("by", ["word", "x", "day", "flag", None])
def test_far_pages_are_those_of_the_sorted_table(spark, monkeypatch, by, ascending):
    monkeypatch.setattr(r, "PAGE_ROWS", 20)
    monkeypatch.setattr(r, "PAGE_BOUNDS", 5)
    rnd = random.Random(2)
    data = []
    for i in range(600):
        hot = rnd.random() < 0.4
        data.append((
            "hot" if hot else rnd.choice([None, *"abcdefé"]), None if i % 9 == 0 else 7.0 if hot else float(rnd.randrange(-40, 40)),
            None if i % 11 == 0 else dt.datetime(2024, 1, 1 + rnd.randrange(28), 5), rnd.choice([True, False, None]), 1 if hot else i % 50,
        ))
    df = spark.createDataFrame(data, "word string, x double, day timestamp_ntz, flag boolean, i int").repartition(4)
    asked = []
    page_of = r._page_of
    monkeypatch.setattr(r, "_page_of", lambda rows, n, *rest: asked.append(n) or page_of(rows, n, *rest))
    whole = [tuple(x) for x in r.search_rows(df, sort_by=by, ascending=ascending, limit=1000, deep=False).collect()]
    for offset in (0, 37, 290, 590, 700):
        got = [tuple(x) for x in r.search_rows(df, sort_by=by, ascending=ascending, offset=offset, limit=25).collect()]
        assert got == whole[offset : offset + 25]
    assert min(asked) <= 20


def test_page_size_is_taken_as_asked(spark):
    df = spark.range(1000).withColumnRenamed("id", "x")
    assert r.search_rows(df, limit=500).count() == 500
    assert rows(r.search_total(df, "", page_size=400)) == [(1000, 3)]
    with pytest.raises(ValueError):
        r.search_rows(df, limit=0)
