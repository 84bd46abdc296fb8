from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyforge.operators import cleaning as c
from tallyforge.operators import ordered
from tallyforge.operators import profile as p

from helpers import pairs, plan, rows


@pytest.fixture(scope="module")
def messy(spark):
    data = [
        (" ann ", "1,200", "2024-01-05", "a@x.org", 3, "Red"),
        ("BOB", "15", "2024-02-05", "b@x.org", -1, "red"),
        ("bob", "7%", "2024-03-05", "c@x.org", 5, "Blue"),
        ("cy", "n/a", "soon", "nobody", 4, None),
        ("dee", "3", "2024-05-05", "e@x.org", 2, "Blue"),
        ("dee", "3", "2024-05-05", "e@x.org", 2, "Blue"),
    ]
    return spark.createDataFrame(
        data, "name string, amount string, `Join Date` string, mail string, qty int, color string"
    )


def test_single_steps(messy):
    assert rows(c.trim_spaces(messy), "name")[0] == ("BOB",)
    assert {r.name for r in c.normalize_case(messy, "lower").collect()} == {" ann ", "bob", "cy", "dee"}
    assert {r.name for r in c.normalize_case(messy).collect()} == {" Ann ", "Bob", "Cy", "Dee"}
    with pytest.raises(ValueError):
        c.normalize_case(messy, "wavy")
    assert c.numbers_as_text(messy).schema["amount"].dataType.typeName() == "string"  # 4 of 6
    loose = c.numbers_as_text(messy, 0.6)
    assert sorted(r.amount for r in loose.collect() if r.amount is not None) == [3.0, 3.0, 15.0, 1200.0]
    dated = c.fix_dates(messy)
    assert dated.schema["Join Date"].dataType.typeName() == "timestamp_ntz"
    assert {r[0] for r in dated.select("Join Date").collect()} == {
        None, *[dt.datetime(2024, m, 5) for m in (1, 2, 3, 5)]
    }


def test_fill(spark):
    df = spark.createDataFrame(
        [(None, None, None, None), (1, 2.5, "x", dt.datetime(2024, 1, 1))], "i int, d double, s string, t timestamp_ntz"
    )
    first = c.fill_blanks(df).orderBy("i").first()
    assert tuple(first) == (0, 0.0, "Unknown", None)
    assert tuple(c.fill_blanks(df, "7").orderBy("i").collect()[1])[:3] == (7, 7.0, "7")
    assert tuple(c.fill_blanks(df, "none").filter("s = 'none'").first())[:3] == (None, None, "none")
    assert c.drop_blanks(df).count() == 1


def test_all_steps_in_order(messy):
    out = c.clean(messy, number_threshold=0.6)
    assert out.count() == 4
    assert sorted(r.name for r in out.collect()) == ["Ann", "Bob", "Bob", "Dee"]
    log = c.clean_log(messy, out).first()
    assert (log.rows_before, log.rows_after, log.duplicate_rows_before) == (6, 4, 1)
    assert log.retyped_columns == "amount, Join Date" and log.missing_after == 0
    with pytest.raises(ValueError, match="Unknown cleaning action"):
        c.clean(messy, ["polish"])


@pytest.mark.parametrize("actions", ["all", ["trim_spaces", "fill_blanks"], "drop_blanks"])
def test_a_log_kept_while_cleaning(messy, actions):
    stored, log = c.clean_with_log(messy, actions, number_threshold=0.6)
    after = c.clean(messy, actions, number_threshold=0.6)
    assert rows(stored) == rows(after) and stored.columns == after.columns
    assert tuple(log.first()) == tuple(c.clean_log(messy, after).first())
    _, empty = c.clean_with_log(messy.limit(0), actions)
    assert tuple(empty.first())[:5] == (0, 0, 0, 0, 0)


def test_types_and_roles(messy):
    types = {r["column"]: (r.data_type, r.type_confidence) for r in p.detect_types(messy).collect()}
    assert types["mail"] == ("email", 0.9)
    assert types["Join Date"] == ("date", round(0.6 + 0.35 * 5 / 6, 3))
    assert types["amount"] == ("currency", 0.9)  # 5 of 6 read as numbers
    assert types["qty"] == ("integer", 0.95)
    roles = {r["column"]: r.role for r in p.detect_roles(messy).collect()}
    assert roles == {"name": "dimension", "amount": "measure", "Join Date": "date_dimension",
                     "mail": "contact", "qty": "measure", "color": "dimension"}


@pytest.mark.parametrize(
    ("name", "values", "kind"),
    [
        ("x", [None, None], "unknown"),
        ("ok", ["Yes", "no ", "YES"], "boolean"),
        ("ok", [0, 1, 1], "boolean"),
        ("site", ["http://a", "HTTPS://b", "http://c"], "url"),
        ("tel", ["+1 555 123 4567", "(02) 123-4567", "1234567"], "phone"),
        ("sku", ["A1", "B2"], "identifier"),
        ("order_id", [10, 11, 12], "identifier"),
        ("tax_rate", [5, 7], "percentage"),
        ("x", [0.1, 0.2, 0.95], "percentage"),
        ("price", [10.5, 20.0], "currency"),
        ("x", ["1.5", "2,000", "AED 7"], "decimal"),
        ("when", ["2024-01-01 10:00:00", "2024-01-02"], "datetime"),
        ("year", [2023, 2024], "integer"),
        ("x", ["a", "b"], "category"),
    ],
)
def test_type_cascade(spark, name, values, kind):
    sample = next((v for v in values if v is not None), "")
    sql = {int: "int", float: "double", str: "string"}[type(sample)]
    df = spark.createDataFrame([(v,) for v in values], f"{name} {sql}")
    assert p.detect_types(df).first().data_type == kind


def test_many_distinct_texts_are_text(spark):
    df = spark.range(40).selectExpr("concat('word ', id, ' x') x")
    assert p.detect_types(df).first().data_type == "text"
    assert p.detect_roles(df).first().role == "dimension"


def test_profile(messy):
    got = {r["column"]: r for r in p.profile_columns(messy).collect()}
    assert [r.position for r in sorted(got.values(), key=lambda r: r.position)] == list(range(6))
    assert got["qty"].median == 2.5 and got["qty"].sum == 15 and got["qty"].min == -1
    assert got["amount"].max == 1200 and got["amount"].average == pytest.approx(1228 / 5)
    assert got["Join Date"].min_date == "2024-01-05T00:00:00" and got["Join Date"].date_range_days == 121
    assert got["color"].null_pct == 16.67 and got["color"].duplicate_values == 2
    assert got["color"].sample_values == "Blue | Red | red"
    top = [r for r in p.top_values(messy, 1).collect() if r["column"] == "color"]
    assert [(r.value, r["count"]) for r in top] == [("Blue", 3)]


def test_profile_of_an_empty_table(messy):
    got = p.profile_columns(messy.limit(0)).collect()
    assert {r.data_type for r in got} == {"unknown"} and len(got) == 6
    assert p.quality_issues(messy.limit(0)).count() == 0
    assert p.health_score(messy.limit(0)).first().completeness == 100.0


def test_issues(messy):
    got = {(r.issue, r["column"]): (r.severity, r["count"]) for r in p.quality_issues(messy, number_threshold=0.8).collect()}
    assert got == {
        ("missing", "color"): ("high", 1),
        ("duplicate_rows", None): ("warning", 1),
        ("spaces", "name"): ("info", 1),
        ("capitalization", "name"): ("warning", 1),
        ("capitalization", "color"): ("warning", 1),
        ("numeric_text", "amount"): ("info", 5),
        ("invalid_email", "mail"): ("warning", 1),
        ("negative_quantity", "qty"): ("warning", 1),
    }
    some = {(r.issue, r["column"]) for r in p.detect_issues(messy).collect()}
    assert some == {("missing", "color"), ("spaces", "name"), ("duplicate_rows", None)}
    assert rows(p.missing_summary(messy)) == [("color", 1, 16.67)]


def test_health(messy):
    got = p.health_score(messy).first()
    assert got.completeness == round(100 * 35 / 36, 1)
    assert got.uniqueness == round(100 * (1 - 2 / 6), 1)
    assert got.validity == 100 - 3 * 8  # one high, two validity issues
    assert got.consistency == 100 - 3 * 5
    assert 0 < got.score < 100
    shared = p.described_columns(messy)
    assert p.health_score(messy, shared).first() == got


def test_problems_and_model(messy):
    got = {(r.issue, r["column"]): r["count"] for r in p.find_problems(messy).collect()}
    assert got == {("duplicate_rows", None): 2, ("missing", "color"): 1, ("outlier", "qty"): 1}
    lists = rows(p.semantic_model(messy))
    assert ("measures", "qty") in lists and ("dates", "Join Date") in lists and ("contacts", "mail") in lists


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "x double")
    assert pairs(p.missing_summary(df)) == {"x": 1}
    assert p.profile_columns(df).first().null_count == 1


def test_a_profile_reads_the_table_twice_and_stores_nothing(spark, tmp_path, monkeypatch):
    rows_ = [(i, f"{'abcd' * 30 if i % 2 else 'ABCD' * 30} {i % 40}", i % 11 / 2, "yes" if i % 3 else "No ") for i in range(600)]
    spark.createDataFrame(rows_, "n int, words string, x double, flag string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    first = p._plain_facts(df, None)
    second = p._distinct_facts(df, first, None)
    second.collect()
    text = plan(second).split("+- == Initial Plan ==")[0]
    assert text.count("FileScan") - text.count("ReusedExchange") <= 1
    assert {r.position: r.unique_count for r in second.collect() if r.position < 4} == {0: 600, 1: 40, 2: 11, 3: 2}
    got = {r["column"]: r for r in p.described_columns(df).collect()}
    assert (got["words"].n_case, got["x"].median, got["flag"].low_values, got["flag"].data_type) == (0, 2.5, 2, "boolean")
    assert got["n"].sample_values == "0 | 1 | 10 | 100 | 101"
    monkeypatch.setattr(ordered, "durable", None)  # nothing is stored
    assert p.profile_columns(df).count() == 4


@pytest.mark.parametrize("residue", [1, 20_000])
def test_medians_of_a_profile(spark, monkeypatch, residue):
    monkeypatch.setattr(p, "RESIDUE", residue)
    rng = random.Random(4)
    columns = {
        "a": [rng.gauss(0, 9) for _ in range(5001)], "b": [float(rng.randrange(3)) for _ in range(5001)],
        "c": [7.0 if rng.random() < 0.6 else rng.random() for _ in range(5001)], "d": [float(i) for i in range(5001)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), "a double, b double, c double, d double").limit(5000).repartition(4)
    got = {r["column"]: r.median for r in p.profile_columns(df.union(df)).collect()}
    seen = df.toPandas()
    assert got == {c: pytest.approx(seen[c].median()) for c in columns}


def test_capitalisation_is_checked_whatever_the_number_of_values(spark):
    for n in (41, 61, 400):
        df = spark.createDataFrame([(f"value {i}",) for i in range(n)] + [("VALUE 1",)], "t string")
        found = {(r.issue, r["count"]) for r in p.quality_issues(df).collect()}
        assert ("capitalization", 1) in found


def test_a_profile_reads_typed_columns_without_parsing_text(spark, monkeypatch):
    """Numbers, dates and truth values are what they are; before, each of their cells went through the tests of texts."""
    df = spark.range(90).selectExpr("id n", "id / 4 x", "cast(id as decimal(9,0)) d", "timestamp_millis(id * 43200000) t", "id % 3 = 0 b")
    for name in ("parse_number", "parse_date", "strip"):
        monkeypatch.setattr(p, name, None)
    got = p._plain_facts(df, None)
    assert [(r.non_null, r.n_number, r.n_boolean, r.n_timed) for r in got] == [(90, 90, 2, 0), (90, 90, 0, 0), (90, 90, 2, 0), (90, 0, 0, 45), (90, 0, 90, 0)]


def test_a_profile_tests_equal_short_texts_once(spark):
    """Equal texts are combined before they are parsed; before, each cell was parsed where it was read."""
    df = spark.range(3000).selectExpr("concat('v', id % 3) t")
    seen = []
    real = p._word_facts
    p._word_facts = lambda v, *a: seen.append(v) or real(v, *a)
    try:
        facts = p._short_word_facts(df, [0], None)
    finally:
        p._word_facts = real
    assert len(seen) == 1 and str(seen[0]) == "Column<'text'>" and facts[0]["non_null"] == 3000


def test_long_and_short_texts_of_one_column(spark):
    """What long texts say is told by rows and by digests, and added to what short ones say."""
    number, word = "0" * 70, "w" * 80
    values = [number + "5", number + "5", "2", " 9 ", "2024-01-02", "2024-01-02 00:00:00." + "0" * 60, word, word.upper(), "Yes", None]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = p.column_facts(df).first()
    assert (got.non_null, got.null_count, got.unique_count, got.n_case) == (9, 1, 8, 1)
    assert (got.n_number, got["sum"], got.median, got["min"], got["max"]) == (4, 21.0, 5.0, 2.0, 9.0)
    assert (got.n_spaced, got.n_boolean, got.n_plain) == (1, 1, 4)
    assert got.sample_values.split(" | ")[:2] == [" 9 ", number + "5"]
    mixed = spark.createDataFrame([("yes",)] * 60 + [("No ",)] * 30 + [("maybe",), (" MAYBE",), (word,), (None,)], "t string")
    assert p.column_facts(mixed).first().low_values == 4


def test_a_profile_of_empty_columns(spark):
    df = spark.createDataFrame([(None, None, None, None)] * 3, "t string, n int, d timestamp, a array<int>")
    got = p.profile_columns(df).collect()
    assert [(r.data_type, r.non_null, r.null_count, r.unique_count, r.sample_values) for r in got] == [("unknown", 0, 3, 0, None)] * 4


def test_cleaning_does_not_follow_the_files(spark):
    """Rows that one task reads are cleaned by many."""
    df = spark.range(0, 400, 1, 1).selectExpr("concat(' word ', id) t", "cast(id as string) n")
    cleaned = c.clean(df, ["trim_spaces", "normalize_case", "numbers_as_text"])
    assert "RoundRobinPartitioning" in plan(cleaned)
    assert cleaned.count() == 400 and {(r.t, r.n) for r in cleaned.collect()} == {(f"Word {i}", float(i)) for i in range(400)}
