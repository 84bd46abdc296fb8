"""Running sums and percentiles against brute force, with one dominating group."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ordered
from tallyforge.operators.aggregate import key_metrics
from tallyforge.operators.ordered import RANGE, _ranges, percentiles, prefix_sum, row_index

from helpers import plan, rows


@pytest.fixture(scope="module", autouse=True)
def several_ranges(spark):
    """Keep small data from being coalesced into a single range."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", i, rng.randrange(100)) for i in range(900)]
    data += [(None, 900 + i, i) for i in range(5)]
    return data, spark.createDataFrame(data, "k string, i int, v int")


def test_rows_lie_in_several_ranges(skewed):
    _, df = skewed
    ranged, _ = _ranges(df, "v", [F.col("i").asc()], ["k"])
    assert ranged.select(RANGE).distinct().count() == 4
    assert ranged.filter("k = 'hot'").select(RANGE).distinct().count() > 1


def test_prefix_sum_over_everything(skewed):
    data, df = skewed
    got = prefix_sum(df, "v", [F.col("v").desc(), F.col("i").asc()], "run").collect()
    run, expected = 0, {}
    for _, i, v in sorted(data, key=lambda r: (-r[2], r[1])):
        run += v
        expected[i] = run
    assert {r.i: r.run for r in got} == expected


def test_prefix_sum_per_group_with_total(skewed):
    data, df = skewed
    got = prefix_sum(df, "v", [F.col("i").asc()], "run", ["k"], "all").collect()
    runs, expected = {}, {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        runs[k] = runs.get(k, 0) + v
        expected[i] = runs[k]
    assert {r.i: r.run for r in got} == expected
    assert all(r["all"] == runs[r.k] for r in got)


def test_row_index(skewed):
    data, df = skewed
    got = row_index(df, [F.col("i").desc()], "at").collect()
    assert {r.i: r["at"] for r in got} == {i: len(data) - i for _, i, _ in data}


def test_percentiles_match_numpy(skewed):
    data, df = skewed
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = ["p0", "p1", "p2", "p3", "p4"]
    got = percentiles(df, "v", probs, names, ["k"]).collect()
    groups = {}
    for k, _, v in data:
        groups.setdefault(k, []).append(v)
    assert len(got) == len(groups)
    for r in got:
        assert [r[n] for n in names] == pytest.approx(list(np.quantile(groups[r.k], probs)))
    overall = percentiles(df, "v", probs, names).first()
    assert [overall[n] for n in names] == pytest.approx(list(np.quantile([v for _, _, v in data], probs)))


def test_percentiles_weighted_and_empty(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (None, 9)], "v double, n long")
    assert percentiles(df, "v", [0.5], ["m"], frequency="n").first().m == 1.0
    none = percentiles(df.filter("v > 5"), "v", [0.5], ["m"]).collect()
    assert [r.m for r in none] == [None]
    assert percentiles(df.filter("v > 5"), "v", [0.5], ["m"], ["n"]).collect() == []


def test_sketch(skewed):
    _, df = skewed
    exact = percentiles(df, "v", [0.5], ["m"]).first().m
    assert percentiles(df, "v", [0.5], ["m"], accuracy=10_000).first().m == pytest.approx(exact, abs=1)


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "`a b.c` int, `x,y` int")
    assert rows(prefix_sum(df, "x,y", [F.col("`a b.c`").asc()], "run")) == [(1, 2, 2), (2, 3, 5)]


def test_a_bracket_is_narrowed_until_few_values_are_left(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RESIDUE", 3)
    rng = np.random.default_rng(5)
    n = 200_000
    wide = {
        "even": np.arange(n, dtype=float),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 3, n)),
        "few": rng.integers(0, 3, n).astype(float),
        "heavy": rng.pareto(0.5, n),
    }
    df = spark.createDataFrame(pd.DataFrame(wide)).repartition(8)
    passes = []
    narrowed = ordered.narrowed
    monkeypatch.setattr(ordered, "narrowed", lambda df, open_: passes.append(1) or narrowed(df, open_))
    probs = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    wanted = [(c, p, f"{c}{p}") for c in wide for p in probs]
    got = ordered.exact_percentiles(df, wanted, {"n": F.count("*")}).first()
    assert got["n"] == n and passes
    for c, p, output in wanted:
        assert got[output] == pytest.approx(np.quantile(wide[c], p)), output


def test_percentiles_of_columns_need_two_scans_and_no_row_is_shuffled(spark, tmp_path):
    spark.range(0, 5000, 1, 4).selectExpr("id a", "id % 7 b", "double(id) c", "cast(null as int) d").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = key_metrics(df)
    text = plan(out)
    assert text.count("FileScan") == 1  # the other scan ran for the brackets
    assert "Expand" not in text and "Window" not in text and "hashpartitioning" not in text
    assert rows(out, "column", "median") == [("a", 2499.5), ("b", 3.0), ("c", 2499.5)]
