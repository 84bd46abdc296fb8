"""Lookups, reconciliation and matching between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import norm_text
from ..functions.columns import (
    TEMP,
    as_list,
    is_sortable,
    null_safe_equal,
    qualified,
    ref,
    require_columns,
)
from ..functions.predicates import contains, equals

KEY = TEMP + "key"


def xlookup(
    df: DataFrame, value: object, lookup_column: str, return_column: str, exact: bool = True
) -> DataFrame:
    """All rows whose lookup column equals (or contains) the value."""
    require_columns(df, lookup_column, return_column)
    test = equals if exact else contains
    return df.filter(test(df, lookup_column, value))


def _order_struct(df: DataFrame, order_by: Sequence[str]) -> Column:
    """Comparable form of a row that puts NULLs last in each field."""
    fields = []
    for i, name in enumerate(order_by):
        fields.append(ref(name).isNull().alias(f"n{i}"))
        fields.append(ref(name).alias(f"v{i}"))
    return F.struct(*fields)


def _default_order(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_sortable(df, c)]


def xlookup_first(
    df: DataFrame,
    value: object,
    lookup_column: str,
    return_column: str,
    exact: bool = True,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """One row: number of matches and the first match's return value in ``order_by``."""
    hits = xlookup(df, value, lookup_column, return_column, exact)
    order = as_list(order_by) or _default_order(df)
    require_columns(df, order)
    return hits.agg(
        F.count(F.lit(1)).alias("matches"),
        F.min_by(F.struct(ref(return_column).alias("v")), _order_struct(df, order))["v"].alias("first_value"),
    )


def first_per_key(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """``keys`` and ``columns`` of the first row of each key.

    A minimum is combined before the shuffle, so a key with very many rows costs
    one candidate per input partition.
    """
    first = TEMP + "first"
    picked = df.groupBy(*[ref(k) for k in keys]).agg(
        F.min_by(F.struct(*[ref(c) for c in columns]), _order_struct(df, order_by)).alias(first)
    )
    return picked.select(
        *[ref(k) for k in keys], *[F.col(first).getField(c).alias(c) for c in columns]
    )


def _free_name(name: str, taken: set[str], suffix: str) -> str:
    while name.lower() in taken:
        name += suffix
    return name


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: str,
    return_columns: Sequence[str],
    table_on: str | None = None,
    order_by: str | Sequence[str] | None = None,
    normalized: bool = False,
) -> DataFrame:
    """Every row of ``df`` with columns of its first match in ``table``."""
    right_on = table_on or on
    require_columns(df, on)
    order = as_list(order_by) or _default_order(table)
    require_columns(table, right_on, return_columns, order)
    keyed = table.withColumn(KEY, norm_text(ref(right_on)) if normalized else ref(right_on))
    keyed = keyed.filter(ref(KEY).isNotNull())
    firsts = first_per_key(keyed, [KEY], list(return_columns), order)
    left = df.withColumn(KEY, norm_text(ref(on)) if normalized else ref(on))
    joined = left.alias("l").join(
        firsts.alias("r"), qualified("l", KEY) == qualified("r", KEY), "left"
    )
    taken = {c.lower() for c in df.columns}
    added = []
    for c in return_columns:
        name = _free_name(c, taken, "_right")
        taken.add(name.lower())
        added.append(qualified("r", c).alias(name))
    return joined.select(*[qualified("l", c) for c in df.columns], *added)


def _merged_names(
    left: Sequence[str], right: Sequence[str], shared_key: str | None, suffixes: tuple[str, str]
) -> tuple[list[str], list[str]]:
    """Output names of both sides; only columns found on both sides get suffixes, and a
    name that is then taken gets its suffix once more."""
    common = {c.lower() for c in left} & {c.lower() for c in right}
    if shared_key:
        common.discard(shared_key.lower())
    taken = {c.lower() for c in [*left, *right] if c.lower() not in common} | {"_merge"}
    sides = []
    for names, suffix in zip((left, right), suffixes):
        own = []
        for c in names:
            if c.lower() in common:
                c = _free_name(c + suffix, taken, suffix or "_")
                taken.add(c.lower())
            own.append(c)
        sides.append(own)
    return sides[0], sides[1]


def _key_test(null_keys_match: bool) -> Column:
    a, b = qualified("l", KEY), qualified("r", KEY)
    return a.eqNullSafe(b) if null_keys_match else a == b


def _distinct_keys(df: DataFrame, key: Column) -> DataFrame:
    """The keys of a table as ``KEY``, once each.

    They are grouped inside a struct, so that a join shuffles them once more. If it took
    them as the aggregate leaves them, adaptive execution could not split a hot key of the
    other side, and one task would hold the aggregate's table beside both sorts.
    """
    keys = df.select(F.struct(key.alias("v")).alias(KEY)).distinct()
    return keys.select(ref(KEY).getField("v").alias(KEY))


def _without_partner(rows: DataFrame, keys: DataFrame, null_keys_match: bool) -> DataFrame:
    """Rows whose ``KEY`` is not among the distinct ``keys``.

    Rows without a key would meet in one task. If they have no partner anyway they skip
    the join, for which ``rows`` are read a second time.
    """
    test = _key_test(null_keys_match)
    if null_keys_match:
        return rows.alias("l").join(keys.alias("r"), test, "left_anti")
    keyed = rows.filter(ref(KEY).isNotNull()).alias("l")
    lone = keyed.join(keys.filter(ref(KEY).isNotNull()).alias("r"), test, "left_anti")
    return lone.union(rows.filter(ref(KEY).isNull()))


def reconcile(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "outer",
    null_keys_match: bool = False,
    suffixes: tuple[str, str] = ("_left", "_right"),
    normalized: bool = False,
) -> DataFrame:
    """Merge two tables and tell for each row on which side it was found.

    ``_merge`` is ``both``, ``left_only`` or ``right_only``. Rows without a key have no
    partner unless ``null_keys_match``, which pairs each with all on the other side. An
    outer merge is built
    from the inner join and the unmatched rows of each side: unlike an outer join,
    each of these can be split when one key holds much of either table.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"Unsupported join type: {how}")
    require_columns(left, left_on)
    require_columns(right, right_on)

    def key(column: str) -> Column:
        return norm_text(ref(column)) if normalized else ref(column)

    shared = left_on if left_on == right_on else None
    left_names, right_names = _merged_names(left.columns, right.columns, shared, suffixes)
    a = left.toDF(*left_names).withColumn(KEY, key(left_names[left.columns.index(left_on)]))
    b = right.toDF(*right_names).withColumn(KEY, key(right_names[right.columns.index(right_on)]))
    right_names = [c for c in right_names if c != shared]

    def part(joined: DataFrame, sides: str, merge: str) -> DataFrame:
        """The merged columns, NULL where they belong to a missing side."""
        cols = []
        for c in left_names:
            side = "l" if "l" in sides else "r" if c == shared else None
            cols.append(_cell(a, side, c))
        cols += [_cell(b, "r" if "r" in sides else None, c) for c in right_names]
        return joined.select(*cols, F.lit(merge).alias("_merge"))

    def unmatched(side: str) -> DataFrame:
        # The other side's distinct keys are enough to tell what has no partner.
        rows, other = (a, b) if side == "l" else (b, a)
        return _without_partner(rows, _distinct_keys(other, ref(KEY)), null_keys_match).alias(side)

    pairs = a.alias("l").join(b.alias("r"), _key_test(null_keys_match), "inner")
    out = part(pairs, "lr", "both")
    if how in ("left", "outer"):
        out = out.unionByName(part(unmatched("l"), "l", "left_only"))
    if how in ("right", "outer"):
        out = out.unionByName(part(unmatched("r"), "r", "right_only"))
    return out


def _cell(df: DataFrame, side: str | None, name: str) -> Column:
    if side is None:
        return F.lit(None).cast(df.schema[name].dataType).alias(name)
    return qualified(side, name)


def reconcile_counts(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    null_keys_match: bool = True,
    normalized: bool = False,
) -> DataFrame:
    """One row: merged rows found on both sides, left only, right only, unmatched.

    Both tables are counted per key first, so the pairs are multiplied out as
    numbers and never built.
    """
    require_columns(left, left_on)
    require_columns(right, right_on)

    def counts(df: DataFrame, column: str, name: str) -> DataFrame:
        key = norm_text(ref(column)) if normalized else ref(column)
        return df.groupBy(key.alias(KEY)).agg(F.count(F.lit(1)).alias(name))

    both = counts(left, left_on, "n_left").alias("l").join(
        counts(right, right_on, "n_right").alias("r"), _key_test(null_keys_match), "full_outer"
    )
    n_left, n_right = F.col("n_left"), F.col("n_right")

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    left_only = total(F.when(n_right.isNull(), n_left))
    right_only = total(F.when(n_left.isNull(), n_right))
    return both.agg(
        total(n_left * n_right).alias("both"),
        left_only.alias("left_only"),
        right_only.alias("right_only"),
        (left_only + right_only).alias("unmatched"),
    )


def matching_key(other: DataFrame, key: str) -> str:
    """Key column of the second table: the same name, else the first holding 'id'."""
    if key in other.columns:
        return key
    for name in other.columns:
        if "id" in name.lower():
            return name
    raise ValueError("No common match field on second dataset.")


def match_datasets(
    df: DataFrame,
    other: DataFrame,
    key: str,
    output_mode: str = "matching_only",
    other_key: str | None = None,
    normalized: bool = False,
    null_keys_match: bool = False,
) -> DataFrame:
    """Rows of two tables put together on one key.

    ``matching_only``, ``non_matching`` (rows of either side without partner) or
    ``full`` (everything).
    """
    right_on = other_key or matching_key(other, key)
    options = {"suffixes": ("", "_right"), "normalized": normalized, "null_keys_match": null_keys_match}
    if output_mode == "matching_only":
        return reconcile(df, other, key, right_on, "inner", **options).drop("_merge")
    if output_mode == "full":
        return reconcile(df, other, key, right_on, "outer", **options)
    if output_mode != "non_matching":
        raise ValueError(f"Unsupported output mode: {output_mode}")
    # Only keys decide, so each side meets the other's distinct keys, no pair is built.
    lone_left = find_unmatched(df, other, key, right_on, null_keys_match, normalized)
    lone_right = find_unmatched(other, df, right_on, key, null_keys_match, normalized)
    left_side = reconcile(lone_left, other.limit(0), key, right_on, "left", **options)
    right_side = reconcile(df.limit(0), lone_right, key, right_on, "right", **options)
    return left_side.unionByName(right_side)


def find_unmatched(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str | None = None,
    null_keys_match: bool = False,
    normalized: bool = False,
) -> DataFrame:
    """Rows of the left table whose key the right table lacks."""
    other = right_on or left_on
    require_columns(left, left_on)
    require_columns(right, other)

    def key(column: str) -> Column:
        return norm_text(ref(column)) if normalized else ref(column)

    keyed = left.withColumn(KEY, key(left_on))
    return _without_partner(keyed, _distinct_keys(right, key(other)), null_keys_match).drop(KEY)


def match_normalized(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner"
) -> DataFrame:
    """Merge on keys that agree apart from case and surrounding space."""
    return reconcile(left, right, left_on, right_on, how, null_keys_match=False, normalized=True)
