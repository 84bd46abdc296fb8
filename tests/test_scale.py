"""Plans under skew: one key holds much of the rows."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import duplicates, joins, ordered, profile, ranking
from tallyforge.plans import reports

from helpers import plan

# Small enough for test data to count as skewed and large.
TIGHT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in TIGHT}
    for k, v in TIGHT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, n, share=0.5):
    """Keys 1…n, except that the first ``share`` of the rows all have key 0."""
    key = F.when(F.col("id") < n * share, F.lit(0)).otherwise(F.col("id"))
    payload = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(0, n, 1, 8).select(key.alias("k"), payload.alias("pad"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    n = df.count()
    df.collect()
    return n, plan(df)


def test_lookup_splits_a_hot_key(tight):
    table = tight.range(0, 20000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    n, text = final_plan(joins.lookup_join(hot(tight, 20000), table, "k", ["twice"]))
    assert n == 20000 and "skew" in text.lower()


def test_reconcile_splits_a_hot_key(tight):
    right = tight.range(10000, 20000).select(F.col("id").alias("k"), F.lit(1).alias("one"))
    right = right.unionByName(tight.range(1).select(F.col("id").alias("k"), F.lit(1).alias("one")))
    n, text = final_plan(joins.reconcile(hot(tight, 20000), right, "k", "k"))
    assert n == 20000 and "skew" in text.lower() and "FullOuter" not in text


def largest_part(df):
    """Rows of the largest partition of a result, of which every column is read."""
    marked = df.select(F.spark_partition_id().alias("p"), F.xxhash64(*df.columns).alias("h"))
    parts = marked.groupBy("p").agg(F.count("h").alias("n"), F.bit_xor("h").alias("h"))
    return parts.agg(F.max("n"), F.bit_xor("h")).first()[0]


@pytest.mark.parametrize("hot_key", [None, 0])
def test_rows_without_partner_are_spread(tight, hot_key):
    """Half of the rows have no key, or one that the other side lacks."""
    left = hot(tight, 20000).withColumn("k", F.when(F.col("k") != 0, F.col("k")).otherwise(F.lit(hot_key)))
    right = tight.range(10000).select((F.col("id") + 10000).alias("k"), F.lit(1).alias("one"))
    for out in (
        joins.reconcile(left, right, "k", "k"),
        joins.reconcile(right, left, "k", "k"),
        joins.match_datasets(left, right, "k", "full"),
        joins.find_unmatched(left, right, "k"),
    ):
        n, _ = final_plan(out)
        assert n == (10000 if "one" not in out.columns else 20000)
        assert largest_part(out) < 5000


def test_merge_counts_keys_apart_from_the_join(tight):
    """No task holds the aggregate of the keys beside the rows it sorts."""
    left = tight.range(5000).select((F.col("id") * 3).alias("k"), F.lit(1).alias("one"))
    right = tight.range(7000).select((F.col("id") * 3 + 6000).alias("k"), F.lit(2).alias("two"))
    n, text = final_plan(joins.reconcile(left, right, "k", "k"))
    final = re.sub(r"[^\w\n]", " ", text[: text.index("== Initial Plan ==")])
    assert n == 9000 and final.count("SortMergeJoin") == 3
    assert not re.search(r"Sort .*\n\s+\d* *HashAggregate", final)


def test_duplicates_split_a_hot_key(tight):
    n, text = final_plan(duplicates.find_duplicates(hot(tight, 20000), "k"))
    assert n == 10000 and "skew" in text.lower()


def test_whole_rows_are_shuffled_only_where_their_hash_repeats(tight):
    """Rows that occur once take part in a shuffle of hashes, and no further."""
    rows = tight.range(0, 20000, 1, 8).selectExpr("id % 19990 k", "repeat(sha2(cast(id % 19990 as string), 256), 4) pad", "double(null) x")
    found = duplicates.repeated_keys(rows, rows.columns)
    assert {(r.k, r.x, r["rows"]) for r in found.collect()} == {(k, None, 2) for k in range(10)}
    assert duplicates.duplicate_row_count(rows).first()[0] == 10
    text = plan(found)
    assert "LeftSemi" in text and text.index("LeftSemi") > text.index("partial_count")
    narrow = plan(duplicates.repeated_keys(rows, ["k"]))
    assert "LeftSemi" not in narrow


def test_equal_rows_have_equal_hashes(spark):
    odd = spark.createDataFrame([(0.0, None), (-0.0, None), (float("nan"), "a"), (float("nan"), "a"), (1.0, "")], "x double, s string")
    assert {(str(r.x), r.s, r["rows"]) for r in duplicates.repeated_keys(odd, ["x", "s"]).collect()} == {("0.0", None, 2), ("nan", "a", 2)}


def test_a_hot_group_spans_many_ranges(tight):
    rows = hot(tight, 4000).withColumn("v", F.monotonically_increasing_id())
    ranged, offsets = ordered._ranges(rows.withColumn("one", F.lit(1)), "one", [F.col("v").asc()], ["k"])
    assert ranged.filter("k = 0").select(ordered.RANGE).distinct().count() > 1
    largest = ranged.groupBy(ordered.RANGE).count().agg(F.max("count")).first()[0]
    assert largest < 2000
    assert offsets.filter("k = 0").agg(F.max(ordered.TOTAL)).first()[0] == 2000


def test_durable_uses_the_checkpoint_folder(spark):
    folder = ordered.checkpoint_folder(spark)
    df = ordered.durable(spark.range(5))
    assert df.count() == 5
    path = folder.removeprefix("file:") + "/tallyforge"
    assert os.path.isdir(path)
    assert any(path in f for f in df.inputFiles())


def test_top_values_limits_before_the_shuffle(spark):
    text = plan(profile.top_values(hot(spark, 100)))
    assert text.count("WindowGroupLimit") == 2


def test_value_counts_combine_before_the_shuffle(spark):
    counts = profile.value_counts(hot(spark, 1000).select("k"))
    assert counts.filter("value = '0'").first()["count"] == 500


def test_pareto_has_no_window_over_all_groups(shop):
    # The only unpartitioned window sees one row per range.
    text = plan(ranking.pareto(shop, "revenue", "product"))
    assert "partial_sum" in text and "__tf_range" in text


def test_findings_read_the_table_once_per_question(shop):
    text = plan(reports.analyze(shop, "revenue"))
    assert text.count("Scan ExistingRDD") == 3  # size and figures, hashes of rows, rows whose hash repeats
    assert "CartesianProduct" not in text and "NestedLoop" not in text
