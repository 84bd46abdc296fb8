"""Key pairs that probably relate two tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ref
from .ordered import durable

# Weights of name and content.
SAME_NAME, PART_OF_NAME, SHARED_ID_NAME = 0.55, 0.35, 0.40
OVERLAP_WEIGHT, ID_BOOST = 0.55, 0.10
MIN_OVERLAP, STRONG_NAME, MIN_CONFIDENCE = 0.05, 0.50, 0.70


# Words that mark a column as a key.
KEY_WORDS = frozenset(("id", "code", "sku"))

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_a-zA-Z]+")


def name_words(name: str) -> list[str]:
    """The words of a column name in lower case: ``orderId``, ``order_id`` and ``Order ID`` have the same."""
    return [word.lower() for word in _WORD.findall(name)]


def name_score(left: str, right: str) -> float:
    """What the names alone say for a relation.

    Most if they have the same words, written together or apart. Less if all words of one are among the other's:
    something more then if both are names of keys.
    """
    one, two = sorted((name_words(left), name_words(right)), key=len)
    if not one or "".join(one) == "".join(two):
        return SAME_NAME if one else 0.0
    if not set(one) - KEY_WORDS or not set(one) <= set(two):
        return 0.0
    return SHARED_ID_NAME if one[-1] in KEY_WORDS and two[-1] in KEY_WORDS else PART_OF_NAME


def id_boost(left: str, right: str) -> float:
    """Something more if a word of either name marks a key."""
    return ID_BOOST if KEY_WORDS & {*name_words(left), *name_words(right)} else 0.0


BITS = 63  # columns per mask


def _column_values(df: DataFrame, ids: Mapping[str, int]) -> DataFrame:
    """(column id, value) of every filled cell of the given columns, values as text."""
    names = [str(i) for i in ids.values()]
    texts = df.select(*[ref(c).cast("string").alias(n) for c, n in zip(ids, names)])
    long = texts.unpivot([], names, "id", "value").filter(F.col("value").isNotNull())
    return long.select(F.col("id").cast("int").alias("id"), "value")


def _is_set(mask: str):
    return lambda place: F.getbit(F.col(mask), place) == 1


def _shifted(block: int):
    return lambda place: place + block * BITS


def _holder_counts(values: DataFrame, columns: int) -> DataFrame:
    """(ids, n): sets of columns and how many values occur in exactly these.

    A value's set is a bit mask per 63 columns, merged before the shuffle.
    """
    blocks = range((columns + BITS - 1) // BITS)
    bit = F.expr(f"shiftleft(bigint(1), id % {BITS})")
    block = F.floor(F.col("id") / BITS)
    masks = [f"m{b}" for b in blocks]
    holders = values.groupBy("value").agg(
        *[F.bit_or(F.when(block == b, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{b}") for b in blocks]
    )
    sets = holders.groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))
    places = F.sequence(F.lit(0), F.lit(BITS - 1))
    members = [
        F.transform(F.filter(places, _is_set(m)), _shifted(b)) for b, m in zip(blocks, masks)
    ]
    return sets.select(F.concat(*members).alias("ids"), "n")


#: A sketch of a column keeps the hashes of up to 2 ** SKETCH_SIZE distinct values, half a megabyte; up to half as many
#: distinct values it is exact.
SKETCH_SIZE = 16

#: Standard errors that an estimate of a large column may be off.
SURE = 6


def _sketched(tables: Sequence[tuple[str, DataFrame]], ids: Sequence[Mapping[str, int]]) -> DataFrame:
    """(id, sketch) of the given columns of every table; one pass over each table, in which nothing is shuffled but
    sketches."""
    parts = []
    for (_, df), own in zip(tables, ids, strict=True):
        if own:
            wide = df.agg(*[F.theta_sketch_agg(ref(c).cast("string"), SKETCH_SIZE).alias(f"s{i}") for c, i in own.items()])
            rows = [F.struct(F.lit(i).alias("id"), F.col(f"s{i}").alias("sketch")) for i in own.values()]
            parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def _estimates(sketches: DataFrame, pairs: Sequence[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Sizes and number of common values of pairs of columns, by their sketches. Both have a row for each pair at most."""
    wanted = sketches.sparkSession.createDataFrame(pairs, "left_id int, right_id int")
    left = sketches.select(F.col("id").alias("left_id"), F.col("sketch").alias("a"))
    right = sketches.select(F.col("id").alias("right_id"), F.col("sketch").alias("b"))
    both = wanted.join(left, "left_id").join(right, "right_id")
    found = both.select(
        "left_id", "right_id", F.theta_sketch_estimate("a").alias("n"), F.theta_sketch_estimate("b").alias("m"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("common"),
    )
    return {(r.left_id, r.right_id): (r.n, r.m, r.common) for r in found.collect()}


def most_overlap(n: int, m: int, common: int) -> float:
    """The largest overlap that two columns can be taken to have, given what their sketches say."""
    kept = min(1.0, 2 ** (SKETCH_SIZE - 1) / max(n, m, 1))  # share of the values that both sketches know
    if kept == 1.0:
        return common / max(min(n, m), 1)
    reach = common + SURE * sqrt(common / kept) + SURE * SURE / kept
    least = min(n, m) * max(1 - SURE / sqrt(2 ** (SKETCH_SIZE - 1)), 0.0)
    return min(1.0, reach / least) if least else 1.0


def detect_relationships(
    tables: Sequence[tuple[str, DataFrame]],
    min_confidence: float = MIN_CONFIDENCE,
    top: int | None = None,
) -> DataFrame:
    """Column pairs of different tables, scored by name and by shared values.

    Pairs whose names cannot reach ``min_confidence`` even with all values shared are dropped first, and only columns
    left in some pair are read. One pass over each table makes mergeable sketches of them. For columns of up to
    2 ** (SKETCH_SIZE - 1) distinct values these tell sizes and common values as they are; for larger ones they
    bound the overlap, and pairs that stay below ``min_confidence`` go. Only values of the columns that are then left
    are compared: each is reduced to the set of columns it occurs in and equal sets are counted, so pairs are formed
    between columns only, never between rows. The passes over sketches run while the plan is built.
    """
    if len(tables) < 2:
        raise ValueError("At least two tables are needed.")
    spark = tables[0][1].sparkSession
    columns = [(position, name, c) for position, (name, df) in enumerate(tables) for c in df.columns]
    # One row per pair of columns: schema, not data.
    pairs = [
        (i, j, *left[1:], *right[1:], name_score(left[2], right[2]), id_boost(left[2], right[2]))
        for (i, left), (j, right) in combinations(enumerate(columns), 2)
        if left[0] != right[0]
    ]
    pairs = [p for p in pairs if p[6] + OVERLAP_WEIGHT + p[7] >= min_confidence]

    def ids_of(wanted: set[int]) -> list[dict[str, int]]:
        return [{c: i for i, (at, _, c) in enumerate(columns) if at == position and i in wanted} for position in range(len(tables))]

    known, open_ = [], []
    told = _estimates(durable(_sketched(tables, ids_of({i for p in pairs for i in p[:2]}))), [p[:2] for p in pairs]) if pairs else {}
    for p in pairs:
        n, m, common = told[p[:2]]
        if max(n, m) <= 2 ** (SKETCH_SIZE - 1):
            known.append((*p, n or None, m or None, common))
        elif p[6] + OVERLAP_WEIGHT * most_overlap(n, m, common) + p[7] >= min_confidence:
            open_.append(p)

    schema = (
        "left_id int, right_id int, left_table string, left_column string, "
        "right_table string, right_column string, name_score double, boost double"
    )
    sized = spark.createDataFrame(known, schema + ", left_size long, right_size long, common long")
    if open_:
        parts = [_column_values(df, own) for (_, df), own in zip(tables, ids_of({i for p in open_ for i in p[:2]})) if own]
        sets = _holder_counts(reduce(DataFrame.unionByName, parts), len(columns))
        # A column shares all its values with itself, which gives its size.
        common = (
            sets.select(F.explode("ids").alias("left_id"), "ids", "n")
            .select("left_id", F.explode("ids").alias("right_id"), "n")
            .filter(F.col("left_id") <= F.col("right_id"))
            .groupBy("left_id", "right_id")
            .agg(F.sum("n").alias("common"))
        )
        sizes = common.filter("left_id = right_id")
        counted = (
            spark.createDataFrame(open_, schema)
            .join(sizes.select("left_id", F.col("common").alias("left_size")), "left_id", "left")
            .join(sizes.select("right_id", F.col("common").alias("right_size")), "right_id", "left")
            .join(common.filter("left_id < right_id"), ["left_id", "right_id"], "left")
        )
        sized = sized.unionByName(counted)
    overlap = F.coalesce(F.col("common"), F.lit(0)) / F.least("left_size", "right_size")
    score = F.least(
        F.lit(1.0), F.col("name_score") + OVERLAP_WEIGHT * F.col("overlap") + F.col("boost")
    )
    confidence = (
        F.when(F.col("overlap").isNull(), F.col("name_score") * 0.5)
        .when((F.col("overlap") < MIN_OVERLAP) & (F.col("name_score") < STRONG_NAME), F.lit(0.0))
        .otherwise(score)
    )
    both_filled = F.col("left_size").isNotNull() & F.col("right_size").isNotNull()
    scored = (
        sized.withColumn("overlap", F.when(both_filled, overlap))
        .withColumn("score", confidence)
        .filter(F.col("score") >= min_confidence)
        .select(
            "left_table", "left_column", "right_table", "right_column",
            F.bround(F.col("score") * 100, 0).cast("int").alias("confidence"),
            F.lit("suggested").alias("status"),
        )
        .orderBy(
            F.col("confidence").desc(), "left_table", "left_column", "right_table", "right_column"
        )
    )
    return scored.limit(top) if top else scored
