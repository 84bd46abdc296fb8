from __future__ import annotations

import pytest

from tallyforge.plans import reports, templates
from tallyforge.sources import tables as t

from helpers import pairs, rows


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


def test_csv_types_and_headers(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        ' id ,Amount,amount,,flag,day,note\n1,2.5,x,7,true,2024-01-05,"a, ""b"""\n2,NA,y,,False,2024-02-05,n/a\n',
    )
    df = t.read_csv(spark, path)
    assert df.columns == ["id", "Amount", "amount_2", "Column_4", "flag", "day", "note"]
    kinds = [f.dataType.typeName() for f in df.schema.fields]
    assert kinds == ["long", "double", "string", "long", "boolean", "timestamp_ntz", "string"]
    first, second = sorted(df.collect(), key=lambda r: r.id)
    assert first.note == 'a, "b"' and second.note is None and second.Amount is None
    assert second.Column_4 is None and first.flag is True


def test_csv_latin1_fallback_and_schema(spark, tmp_path):
    path = write(tmp_path / "l.csv", "city,n\nMálaga,1\n", "latin-1")
    assert t.read_csv(spark, path).first().city == "Málaga"
    given = t.read_csv(spark, path, schema="city string, n double", encoding="ISO-8859-1")
    assert tuple(given.first()) == ("Málaga", 1.0)


def test_csv_of_several_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        write(folder / f"{i}.csv", f"k,v\n{i},{i}.5\n")
    assert rows(t.read_csv(spark, str(folder))) == [(0, 0.5), (1, 1.5), (2, 2.5)]


def test_round_trips(spark, shop, tmp_path):
    path = str(tmp_path / "p")
    t.write_table(shop, path, partition_by=["product"])
    assert rows(t.read_table(spark, path).select(*shop.columns)) == rows(shop)
    with pytest.raises(Exception, match="exists"):
        t.write_table(shop, path)
    for fmt in ("parquet", "csv", "json"):
        t.export_result({"a": shop.select("id"), "b": shop.select("revenue")}, str(tmp_path / fmt), fmt)
        reader = spark.read.format(fmt).option("header", True)
        assert reader.load(str(tmp_path / fmt / "a")).count() == 7
    with pytest.raises(ValueError):
        t.export_result({}, path, "xlsx")


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (1.0, 2)], "x double, y int")
    assert rows(t.nan_to_null(df)) == [(1.0, 2), (None, 1)]


def test_analyze(shop):
    got = {(r.kind, r.subject): (r.value, r.severity) for r in
           reports.analyze(shop, "revenue", "product", "day").collect()}
    assert got[("rows", None)] == (7.0, "info") and got[("missing_cells", None)] == (3.0, "alert")
    assert got[("top_category", "Coffee")][0] == 390.0
    assert got[("concentration", "Coffee")] == (46.43, "recommendation")
    assert ("decline", "Tea") not in got and ("clean_duplicates", None) not in got
    assert got[("metric_median", "revenue")][0] == 100.0
    twice = shop.unionByName(shop)
    assert ("clean_duplicates", None) in {(r.kind, r.subject) for r in reports.analyze(twice, "cost").collect()}
    falling = reports.analyze(shop.filter("product = 'Tea'"), "revenue", "product", "day")
    assert {r.value for r in falling.filter("kind = 'decline'").collect()} == {-100.0}


def test_report_is_most_severe_first(shop):
    got = reports.report(shop, "revenue", "product", "day", 3).collect()
    assert [r.severity for r in got] == ["alert", "recommendation", "info"]


def test_dashboard(shop):
    got = {(r.panel, r.label): r.value for r in reports.dashboard(
        shop, "revenue", "day", "product", "region").collect()}
    assert got[("kpi", "Revenue")] == 840.0 and got[("kpi", "AOV")] == 120.0
    assert got[("kpi", "MoM Growth %")] == -100.0 and got[("trend", "2025-02")] == 290.0
    assert got[("top_products", "Tea")] == 300.0 and ("by_region", None) in got
    plain = pairs(reports.dashboard(shop, "revenue", kind="custom").select("label", "value"))
    assert set(plain) == {"Total", "Average", "Records"}
    with pytest.raises(ValueError):
        reports.dashboard(shop, "revenue", kind="weather")


def test_board_and_tasks(shop):
    frames = reports.board(shop, "revenue", "product", "day")
    assert set(frames) == {"kpis", "trend", "ranking", "pareto", "outliers", "descriptive"}
    assert frames["ranking"].count() == 3 and frames["outliers"].columns[-1] == "severity"
    expected = {"monthly_trend": {"trend", "descriptive"}, "top_n": {"ranking"}, "charts": {"summary"},
                "compare": {"summary", "trend"}, "summarize": {"summary", "pareto"}, "other": {"kpis", "summary"}}
    for task, names in expected.items():
        assert set(reports.task_frames(task, shop, "revenue", "product", "day")) == names
    assert pairs(reports.task_frames("calculate", shop, "revenue")["summary"]) == {"sum": 840.0}


def test_findings(shop):
    got = {(r.kind, r.subject): r.value for r in reports.findings(shop, "revenue", "product").collect()}
    assert got[("leading_segment", "Coffee")] == 390.0 and got[("rows", None)] == 7.0
    assert ("quality_issues", None) in got


def test_templates(shop):
    assert templates.report("salesperson_performance", shop, "product", "revenue").count() == 3
    assert templates.report("low_stock", shop, "product", "units").first()["product"] == "Cake"
    assert templates.report("pnl_summary", shop, "revenue", "cost").count() == 4
    assert templates.report("monthly_trend", shop, "day", "revenue").count() == 4
    assert {(r.issue, r["column"]) for r in templates.report("returns_overview", shop, "revenue").collect()} == {
        ("missing", "region"), ("missing", "units"), ("missing", "revenue"), ("outlier", "revenue")
    }


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.BINDINGS) <= set(entry.oracle_sql())


def test_no_python_in_plans(spark, shop):
    from helpers import plan

    for df in (reports.analyze(shop, "revenue", "product", "day"), reports.findings(shop, "revenue", "product")):
        text = plan(df)
        assert "PythonUDF" not in text and "BatchEvalPython" not in text and "ArrowEval" not in text


def test_csv_keeps_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,amount\n1,"two\nlines",5\n2,plain,6\n')
    df = t.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r.id, r.note, r.amount) for r in df.collect()) == [(1, "two\nlines", 5), (2, "plain", 6)]
    assert t.read_csv(spark, str(tmp_path / "a.csv"), multi_line=False).count() == 3


def test_templates_return_all_groups(spark):
    df = spark.range(50).selectExpr("id AS person", "id * 2 AS pay")
    assert templates.report("employee_performance", df, "person", "pay").count() == 50
    assert templates.report("employee_performance", df, "person", "pay", n=3).count() == 3
    with pytest.raises(ValueError):
        templates.report("none", df)


def test_dashboard_reads_its_input_once(spark, shop, tmp_path):
    shop.write.parquet(str(tmp_path / "shop"))
    df = reports.dashboard(spark.read.parquet(str(tmp_path / "shop")), "revenue", "day", "product", "region", "product")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    empty = reports.dashboard(shop.limit(0), "revenue", "day", "product").collect()
    assert {(r.label, r.value) for r in empty} >= {("Revenue", 0.0), ("Records", 0.0)}
