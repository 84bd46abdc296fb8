"""Mixing of sources to target weights, by repeating whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import durable, prefix_sum, row_index
from .common import WORD, free_name, need

#: Weights that sources get in turn, in the order of their names.
WEIGHTS = (5, 2, 1)

#: Size of the mix, as a share of all documents, and how often a source may be repeated at most.
SHARE, MOST = 1.5, 2.0

SEED = "mix"

#: Hex digits of a digest that make a number from 0 to 1.
DIGITS = 13


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target) for sources and their sizes.

    Targets in proportion to the weights add up to ``share`` of all sizes and stop at ``most`` times a source's size;
    what is cut off goes to the others by weight. Weights go round in the order of the sources, NULL last.

    As a level rises, sources meet their caps in the order of size by weight. The level at which the rest is used up
    follows from running sums in that order, which are summed by ranges: any number of sources will do.
    """
    placed = row_index(durable(sizes.select("source", "source_size")), [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = placed.withColumn("weight", weight).withColumn("capped_at", most * F.col("source_size") / F.col("weight"))
    order = [F.col("capped_at").asc(), F.col("place").asc()]
    ranked = prefix_sum(prefix_sum(weighed, "source_size", order, "sizes"), "weight", order, "weights")
    ranked = durable(ranked)
    total = ranked.agg(F.struct(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).alias("t")).scalar()
    left = share * total["size"] - most * (F.col("sizes") - F.col("source_size"))
    level = left / (total["weight"] - (F.col("weights") - F.col("weight")))
    rank = F.struct("capped_at", "place")
    first = ranked.withColumn("level", level).filter(F.col("level") * F.col("weight") <= most * F.col("source_size"))
    first = first.agg(F.min(F.struct(rank.alias("rank"), "level")).alias("first")).scalar()
    target = F.when(rank >= first["rank"], first["level"] * F.col("weight")).otherwise(most * F.col("source_size"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(docs_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the seed and the id alone (on the text where there is no id)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(docs_id.cast("string"), F.md5(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``copies``: how often the mix takes a document.

    Sources are ordered by code point, NULL last, and get the weights in turn. A source's
    rate is its target by its size; a document is taken floor(rate) times, and once more
    with a probability of the rest, decided by a digest of the seed and its id, so reruns
    agree and rows with the same id fare alike. Documents without words have size 0.
    Columns of these four names are replaced. Runs jobs while the plan is built; the driver gets no sources.
    """
    need(docs, id_column, text_column, source_column)
    sizes = docs.groupBy(F.col(source_column).alias("source")).agg(F.sum(word_count(F.col(text_column))).alias("source_size"))
    of, rate = free_name(docs, "__source"), free_name(docs, "__rate")
    table = durable(source_targets(sizes, weights, share, most)).withColumnRenamed("source", of)
    size, target = F.col("source_size"), F.col("target")
    table = table.withColumn(rate, F.when(size > 0, F.least(target / size, F.lit(float(most)))).otherwise(0.0))
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(*names, word_count(F.col(text_column)).alias("size"))
    rated = sized.join(table, F.col(source_column).eqNullSafe(F.col(of)))
    whole = F.floor(rate)
    more = chance(F.col(id_column), F.col(text_column), seed) < F.col(rate) - whole
    copies = (whole + more.cast("int")).cast("long")
    return rated.select(*names, "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeated; the options are those of ``mix_plan``."""
    plan = mix_plan(docs, **options).filter("copies > 0")
    repeated = plan.withColumn(free_name(plan, "__copy"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*docs.columns)
