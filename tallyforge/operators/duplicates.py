"""Duplicate rows and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    TEMP,
    any_true,
    as_list,
    is_boolean,
    is_numeric,
    is_temporal,
    null_safe_equal,
    qualified,
    ref,
    require_columns,
)


#: Bytes of a key up to which it is shuffled as it is; a wider one only where its hash occurs twice.
NARROW = 16

HASH, COUNT = TEMP + "hash", TEMP + "count"


def _is_narrow(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether keys are numbers, dates and the like of ``NARROW`` bytes together."""
    fixed = all(is_numeric(df, k) or is_temporal(df, k) or is_boolean(df, k) for k in keys)
    return fixed and 8 * len(keys) <= NARROW


def _suspected(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose keys may occur twice: all that do, and very few others.

    Only a 64-bit hash of each row is shuffled to find them, and combined before; the rows themselves follow their
    number. Keys that agree have the same hash, NULLs and all.
    """
    hashed = df.withColumn(HASH, F.xxhash64(*[ref(k) for k in keys]))
    twice = hashed.groupBy(HASH).agg(F.count(F.lit(1)).alias(COUNT)).filter(ref(COUNT) > 1).select(HASH)
    return hashed.join(twice, HASH, "left_semi").drop(HASH)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key groups with more than one row, and how many rows each has."""
    rows = df.select(*[ref(k) for k in keys])
    suspects = rows if _is_narrow(df, keys) else _suspected(rows, keys)
    counts = suspects.groupBy(*[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"))
    return counts.filter(F.col("rows") > 1)


def find_duplicates(
    df: DataFrame, keys: str | Sequence[str] | None = None, mode: str = "all"
) -> DataFrame:
    """Every row that shares its keys with another row.

    Keys default to the whole row. ``all`` compares the keys together, NULLs equal;
    ``any`` flags a row repeating any single key, NULLs apart. Repeats are counted
    per key first and the rows then semi-joined to the repeated keys: unlike a
    window over the key, that lets a key with very many rows be split.
    """
    names = as_list(keys) or df.columns
    require_columns(df, names)
    if mode == "all":
        repeated = repeated_keys(df, names).select(*[ref(k) for k in names])
        test = null_safe_equal([qualified("l", k) for k in names], [qualified("r", k) for k in names])
        return df.alias("l").join(repeated.alias("r"), test, "left_semi")
    if mode != "any":
        raise ValueError(f"Unsupported duplicate mode: {mode}")
    out, marks = df, []
    for i, k in enumerate(names):
        key, mark = f"{TEMP}k{i}", f"{TEMP}m{i}"
        marks.append(mark)
        repeated = repeated_keys(df.filter(ref(k).isNotNull()), [k]).select(
            ref(k).alias(key), F.lit(True).alias(mark)
        )
        out = out.join(repeated, ref(k) == ref(key), "left").drop(key)
    return out.filter(any_true([F.coalesce(ref(m), F.lit(False)) for m in marks])).drop(*marks)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows."""
    return df.dropDuplicates()


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier equal row."""
    extra = F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).cast("bigint")
    return repeated_keys(df, df.columns).agg(extra.alias("duplicate_rows"))
