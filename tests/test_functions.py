from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import coerce, periods, predicates
from tallyforge.sources.tables import header_names

from helpers import plan, rows


def test_number_text(spark):
    texts = ["12", " 3.5 ", "-1e3", ".5", "5.", "5d", "1,000", "inf", "NaN", "", "1e999", "0x10", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(coerce.to_number(df, "t")).collect()]
    assert got == [12.0, 3.5, -1000.0, 0.5, 5.0] + [None] * 8
    marked = df.select(coerce.to_number(df, "t", [","])).collect()[6][0]
    assert marked == 1000.0


def test_nan_and_infinity_are_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(coerce.to_number(df, "x")).collect()] == [None, None, 2.0]


def test_dates(spark):
    texts = ["2024-02-29", "2024-02-30", "2024-1-5 10:30:00", "2024/1/5", "1/5/2024", "5-JAN-2024",
             "5 Jan 2024", "Jan 5, 2024", "2024", "12:30", "unknown", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(coerce.to_date(df, "t")).collect()]
    fifth = dt.datetime(2024, 1, 5)
    assert got == [dt.datetime(2024, 2, 29), None, dt.datetime(2024, 1, 5, 10, 30)] + [fifth] * 5 + [None] * 4
    numbers = spark.createDataFrame([(20240105,)], "n int")
    assert numbers.select(coerce.to_date(numbers, "n")).first()[0] is None


def test_title_case_like_python(spark):
    texts = ["O'BRIEN a-b 3rd", "ord-1001", "", "x", "élan vital", "a1b2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(coerce.title_case(F.col("t"))).collect()] == [t.title() for t in texts]


def test_strip_like_python(spark):
    texts = ["\t a \n", " b　", "c d", "   "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(coerce.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_headers():
    names = [" a ", "", None, "A", "a", "a_2", "Unnamed: 6"]
    got = header_names(names)
    assert got[:3] == ["a", "Column_2", "Column_3"]
    assert len({n.lower() for n in got}) == len(names)
    assert got[6] == "Column_7"
    assert header_names(["x", "x", "x"]) == ["x", "x_2", "x_3"]


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [
        ("=", " NORTH", {"S-1", "S-2", "S-4"}),
        ("is not", "north", {"S-3", "S-5", "S-6", "S-7"}),
        ("contains", "^so", {"S-3", "S-5"}),
        ("like", "t", {"S-1", "S-2", "S-3", "S-4", "S-5", "S-6"}),
    ],
)
def test_text_predicates(shop, op, value, expected):
    found = shop.filter(predicates.predicate(shop, "region", op, value))
    assert {r.id for r in found.collect()} == expected


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [
        ("at least", "100", {"S-1", "S-3", "S-5", "S-6"}),
        (">", 100, {"S-3", "S-6"}),
        ("lt", 90, {"S-2"}),
        ("<=", 90.0, {"S-2", "S-4"}),
        ("equals", "100", {"S-1", "S-5"}),
        ("ne", 100, {"S-2", "S-3", "S-4", "S-6", "S-7"}),
    ],
)
def test_number_predicates(shop, op, value, expected):
    found = shop.filter(predicates.predicate(shop, "revenue", op, value))
    assert {r.id for r in found.collect()} == expected


def test_unknown_operator_and_column(shop):
    with pytest.raises(ValueError, match="Unsupported operator"):
        predicates.predicate(shop, "region", "~", "x")
    with pytest.raises(ValueError, match="not found"):
        predicates.predicate(shop, "nowhere", "=", "x")
    with pytest.raises(ValueError, match="not a number"):
        predicates.predicate(shop, "revenue", ">", "many")


def test_nan_is_not_greater(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,)], "x double")
    assert df.filter(predicates.predicate(df, "x", ">", 1)).count() == 1


def test_numeric_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id as double) x").write.parquet(path)
    df = spark.read.parquet(path)
    condition = predicates.combined_filter(
        df, [{"field": "x", "operator": "gte", "value": 90}, {"field": "id", "value": "95"}]
    )
    text = plan(df.filter(condition))
    assert "GreaterThanOrEqual(x,90" in text and "EqualTo(id,95" in text


def test_or_joins_left_to_right(shop):
    filters = [
        {"field": "product", "value": "tea"},
        {"field": "product", "value": "cake", "join": "or"},
        {"field": "revenue", "operator": "gt", "value": 90},
        {"field": "region", "value": ""},
    ]
    found = shop.filter(predicates.combined_filter(shop, filters))
    assert {r.id for r in found.collect()} == {"S-1", "S-3", "S-5"}


def test_period_labels(spark):
    df = spark.createDataFrame([("2025-01-01",), ("2024-12-29",)], "d string").select(
        F.to_timestamp_ntz("d").alias("d")
    )
    labels = [periods.period_label(F.col("d"), g).alias(g) for g in ("day", "W", "month", "Q", "year")]
    got = rows(df.select(*labels))
    assert got == [
        ("2024-12-29", "2024-12-23/2024-12-29", "2024-12", "2024Q4", "2024"),
        ("2025-01-01", "2024-12-30/2025-01-05", "2025-01", "2025Q1", "2025"),
    ]
    with pytest.raises(ValueError, match="grain"):
        periods.canonical_grain("century")


def test_dates_with_zones_and_months(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-03-01T10:00:00+02:00", "2024-03-01 10:00-0530", "2024-01", "2024-13", "2024-01-01T00:00+xx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [str(r[0]) for r in df.orderBy("i").select(coerce.parse_date(F.col("t"))).collect()]
    assert got == ["2024-01-01 00:00:00", "2024-03-01 08:00:00", "2024-03-01 15:30:00", "2024-01-01 00:00:00", "None", "None"]


def test_title_case_cuts_only_where_a_capital_may_follow(spark):
    """Digits and signs of ASCII begin no word of their own; other signs that have capitals do."""
    assert "(?=" in str(coerce.title_case(F.col("x")))
    texts = {"customer#000000001": "Customer#000000001", "o'brien a-b 3rd": "O'Brien A-B 3Rd", "ⓐ ⅰⅰx.": "Ⓐ ⅠⅠX.", "": "", "  a ": "  A "}
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert {r.x: r.t for r in df.withColumn("t", coerce.title_case(F.col("x"))).collect()} == texts
