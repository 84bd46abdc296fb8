from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import duplicates as d
from tallyforge.operators import joins as j
from tallyforge.operators import relationships as rel

from helpers import plan, rows


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "m")], "k int, v string")
    return left, right


def test_xlookup(shop):
    assert rows(j.xlookup(shop, " s-1", "id", "revenue"), "id") == [("S-1",)]
    assert tuple(j.xlookup_first(shop, "s-1", "id", "revenue").first()) == (1, 100)
    assert tuple(j.xlookup_first(shop, "e", "product", "id", False, "day").first()) == (7, "S-1")
    assert tuple(j.xlookup_first(shop, "none", "id", "revenue").first()) == (0, None)


def test_first_value_may_be_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5)], "k string, o int, v int")
    assert tuple(j.xlookup_first(df, "a", "k", "v", order_by="o").first()) == (2, None)


def test_lookup_join(spark, sides):
    left, right = sides
    out = j.lookup_join(left, right, "k", ["v"])
    assert rows(out) == sorted([(1, "a", "x"), (1, "b", "x"), (2, "c", None), (None, "n", None)], key=repr)
    assert out.columns == ["k", "v", "v_right"]


def test_reconcile(sides):
    left, right = sides
    out = j.reconcile(left, right, "k", "k", null_keys_match=True)
    assert out.columns == ["k", "v_left", "v_right", "_merge"]
    expected = [(1, "a", "x", "both"), (1, "a", "y", "both"), (1, "b", "x", "both"), (1, "b", "y", "both"),
                (None, "n", "m", "both"), (2, "c", None, "left_only"), (3, None, "z", "right_only")]
    assert rows(out) == sorted(expected, key=repr)
    assert tuple(j.reconcile_counts(left, right, "k", "k").first()) == (5, 1, 1, 2)
    apart = j.reconcile(left, right, "k", "k")
    assert apart.filter("_merge = 'both'").count() == 4 and apart.count() == 8
    assert tuple(j.reconcile_counts(left, right, "k", "k", False).first()) == (4, 2, 2, 4)
    for how, n in (("inner", 5), ("left", 6), ("right", 6)):
        assert j.reconcile(left, right, "k", "k", how, null_keys_match=True).count() == n
    with pytest.raises(ValueError):
        j.reconcile(left, right, "k", "k", "cross")


def test_outer_merge_has_no_outer_join(sides):
    assert "FullOuter" not in plan(j.reconcile(*sides, "k", "k"))


def test_match(sides):
    left, right = sides
    assert j.match_datasets(left, right, "k").count() == 4
    assert j.match_datasets(left, right, "k", null_keys_match=True).count() == 5
    lone = j.match_datasets(left, right, "k", "non_matching", null_keys_match=True)
    assert rows(lone) == sorted([(2, "c", None, "left_only"), (3, None, "z", "right_only")], key=repr)
    assert j.match_datasets(left, right, "k", "non_matching").count() == 4
    assert j.match_datasets(left, right, "k", "full", null_keys_match=True).count() == 7
    renamed = right.toDF("other_id", "w")
    assert j.match_datasets(left, renamed, "k").columns == ["k", "v", "other_id", "w"]
    with pytest.raises(ValueError, match="No common"):
        j.match_datasets(left, right.toDF("q", "w"), "k")


def test_unmatched_and_normalized(spark, sides):
    left, right = sides
    assert rows(j.find_unmatched(left, right, "k")) == sorted([(2, "c"), (None, "n")], key=repr)
    a = spark.createDataFrame([(" Ab",), ("cd",)], "x string")
    b = spark.createDataFrame([("AB\t", 1), ("zz", 2)], "y string, n int")
    assert rows(j.match_normalized(a, b, "x", "y"), "x", "n") == [(" Ab", 1)]


def test_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "c"), (None, "c"), (3, None)], "k int, v string"
    )
    whole = [(1, "a"), (1, "a"), (None, "c"), (None, "c")]
    assert rows(d.find_duplicates(df)) == sorted(whole, key=repr)
    assert d.find_duplicates(df, "k").count() == 5
    either = d.find_duplicates(df, ["k", "v"], "any")
    assert rows(either) == sorted([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "c"), (None, "c")], key=repr)
    assert d.duplicate_row_count(df).first()[0] == 2
    assert d.drop_duplicates(df).count() == 5
    assert d.duplicate_row_count(df.limit(0)).first()[0] == 0


def test_duplicates_use_no_window(shop):
    text = plan(d.find_duplicates(shop, ["region", "product"]))
    assert "Window" not in text and "LeftSemi" in text


def test_relationships(spark):
    people = spark.createDataFrame([(i, i % 4, "x") for i in range(20)], "person_id int, team_id int, note string")
    teams = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "team_id int, name string")
    got = rel.detect_relationships([("people", people), ("teams", teams)])
    best = got.first()
    assert (best.left_column, best.right_column, best.confidence) == ("team_id", "team_id", 100)
    # All team ids occur among the person ids too, but 65 is not enough.
    assert got.count() == 1
    every = rel.detect_relationships([("people", people), ("teams", teams)], min_confidence=0.0, top=None)
    assert {(r.left_column, r.right_column): r.confidence for r in every.collect()}[("person_id", "team_id")] == 65
    with pytest.raises(ValueError):
        rel.detect_relationships([("people", people)])


def test_name_scores():
    assert rel.name_words("orderID2_x Größe") == ["order", "id", "2", "x", "gr", "öß", "e"]
    assert rel.name_score("Order ID", "orderid") == rel.name_score("OrderId", "order_id") == 0.55
    assert rel.name_score("customer", "customer_id") == rel.name_score("customer_id", "customer") == 0.35
    assert rel.name_score("cust_id", "old_cust_id") == 0.4
    assert rel.name_score("id", "cust_id") == rel.name_score("a", "b") == rel.name_score("", "_") == 0.0
    assert rel.name_score("cust", "custom") == 0.0  # no word of it
    assert rel.id_boost("sku", "x") == 0.1 and rel.id_boost("x", "sku") == 0.1 and rel.id_boost("paid", "x") == 0.0


@pytest.mark.parametrize("size", [16, 12])
def test_relationships_by_sketch_or_by_values(spark, monkeypatch, size):
    """With small sketches the large columns are left to the comparison of values, which gives the same."""
    monkeypatch.setattr(rel, "SKETCH_SIZE", size)
    compared = []
    counts = rel._holder_counts
    monkeypatch.setattr(rel, "_holder_counts", lambda values, n: compared.append({r.id for r in values.select("id").distinct().collect()}) or counts(values, n))
    left = spark.range(4000).selectExpr("id user_id", "id + 9000000 other_id", "id % 3 kind")
    right = spark.range(4000).selectExpr("id * 2 user_id", "id other_id", "id % 4 kind")
    got = rel.detect_relationships([("left", left), ("right", right)]).collect()
    assert [(r.left_column, r.right_column, r.confidence) for r in got] == [("kind", "kind", 100), ("user_id", "user_id", 92)]
    # Columns 1 and 4 share nothing and are pruned in any case.
    assert compared == ([] if size == 16 else [{0, 3}])


def test_many_columns_span_several_masks(spark):
    wide = spark.range(3).select(*[(F.col("id") + i * 10).alias(f"c{i}") for i in range(70)])
    other = spark.range(3).select((F.col("id") + 690).alias("c69"))
    got = rel.detect_relationships([("wide", wide), ("other", other)])
    assert [(r.left_column, r.right_column, r.confidence) for r in got.collect()] == [("c69", "c69", 100)]


def test_keyless_rows_are_not_multiplied(spark):
    left = spark.createDataFrame([(None, i) for i in range(300)], "k int, x int")
    right = spark.createDataFrame([(None, i) for i in range(300)], "k int, y int")
    assert j.reconcile(left, right, "k", "k").count() == 600
    assert j.match_datasets(left, right, "k", "full").count() == 600
    assert j.match_datasets(left, right, "k").count() == 0
    assert j.match_datasets(left, right, "k", null_keys_match=True).count() == 90_000


def test_merged_names_do_not_clash(spark):
    left = spark.createDataFrame([(1, 2, 3)], "k int, x int, x_left int")
    right = spark.createDataFrame([(1, 4)], "k int, X int")
    out = j.reconcile(left, right, "k", "k")
    assert out.columns == ["k", "x_left_left", "x_left", "X_right", "_merge"]
    assert rows(out) == [(1, 2, 3, 4, "both")]
