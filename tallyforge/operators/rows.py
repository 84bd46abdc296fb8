"""Row-wise operators: filters, computed columns, reshaping, sorting, paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_date, to_number
from ..functions.columns import (
    TEMP,
    any_true,
    as_list,
    data_type,
    is_sortable,
    order_keys,
    ref,
    require_columns,
)
from ..functions.predicates import combined_filter, criteria, equals, flag, predicate


def filter_rows(
    df: DataFrame, column: str, op: str, value: object, regex: bool = True
) -> DataFrame:
    """Rows meeting one test."""
    return df.filter(predicate(df, column, op, value, regex))


def apply_filter(df: DataFrame, column: str | None, value: object) -> DataFrame:
    """Optional equality filter: no column or value, no change."""
    if not column or value is None or column not in df.columns:
        return df
    return df.filter(equals(df, column, value))


def apply_filters(df: DataFrame, filters: Sequence[Mapping[str, object]]) -> DataFrame:
    """Rows meeting a list of ``{field, operator, value, join}`` entries."""
    condition = combined_filter(df, filters)
    return df if condition is None else df.filter(condition)


def match_count(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """One row: matching rows and all rows."""
    test = flag(predicate(df, column, op, value))
    return df.agg(
        F.count_if(test).alias("matched_rows"), F.count(F.lit(1)).alias("total_rows")
    )


# Accepted spellings of the arithmetic operators.
MATH_NAMES = {
    "+": ("+", "add"),
    "-": ("-", "sub"),
    "*": ("*", "mul"),
    "/": ("/", "div"),
    "%": ("%", "pct"),
}

_MATH = {alias: name for name, aliases in MATH_NAMES.items() for alias in aliases}


def math_column(left: Column, op: str, right: Column) -> Column:
    """Arithmetic on doubles; dividing by zero gives NULL, ``%`` is left as % of right."""
    name = _MATH.get(op.strip().lower())
    if name is None:
        raise ValueError(f"Unsupported operator: {op}")
    if name == "+":
        return left + right
    if name == "-":
        return left - right
    if name == "*":
        return left * right
    quotient = F.try_divide(left, right)
    return quotient if name == "/" else quotient * 100


def math_expression(
    df: DataFrame, left: str, op: str, right: str | float, result_name: str = "Result"
) -> DataFrame:
    """Add ``result_name`` = left op right, right being a column or a constant."""
    a = to_number(df, left)
    b = to_number(df, right) if isinstance(right, str) else F.lit(float(right))
    return df.withColumn(result_name, math_column(a, op, b))


def column_total(df: DataFrame, name: str = "Result") -> DataFrame:
    """One row: sum of a computed column."""
    return df.agg(F.coalesce(F.sum(to_number(df, name)), F.lit(0.0)).alias("total"))


def logical_flag(
    df: DataFrame,
    column: str,
    op: str,
    value: object,
    true_label: str = "Yes",
    false_label: str = "No",
    name: str = "Flag",
) -> DataFrame:
    """Add a two-label column telling whether the test holds."""
    test = flag(predicate(df, column, op, value))
    return df.withColumn(name, F.when(test, F.lit(true_label)).otherwise(F.lit(false_label)))


def flag_counts(flagged: DataFrame, name: str = "Flag") -> DataFrame:
    """Rows per label of a flag column."""
    return flagged.groupBy(ref(name)).agg(F.count(F.lit(1)).alias("count"))


def multi_condition_lookup(
    df: DataFrame,
    conditions: Sequence[Mapping[str, object]],
    return_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows meeting all equality conditions; unknown return columns are left out."""
    require_columns(df, [str(c["column"]) for c in conditions])
    wanted = [c for c in (return_columns or df.columns) if c in df.columns]
    rows = df.filter(
        criteria(df, [{"column": c["column"], "value": c["value"]} for c in conditions])
    )
    return rows.select(*[ref(c) for c in wanted])


def unpivot_fields(
    df: DataFrame, ids: str | Sequence[str], fields: Sequence[str] | None = None
) -> DataFrame:
    """Wide to long: one (ids…, field, value) row per cell, values as text."""
    ids = as_list(ids)
    require_columns(df, ids, fields)
    names = list(fields) if fields is not None else [c for c in df.columns if c not in ids]
    texts = df.select(*[ref(c) for c in ids], *[ref(c).cast("string").alias(c) for c in names])
    return texts.unpivot([ref(c) for c in ids], [ref(c) for c in names], "field", "value")


def date_range(
    df: DataFrame, date: str, span: str = "all", as_of: object | None = None, days: int = 30
) -> DataFrame:
    """Rows of a span ending at ``as_of`` (the latest date by default).

    Spans: ``all``, ``last_30`` (the last ``days`` days), ``this_month``,
    ``this_year``.
    """
    require_columns(df, date)
    if span == "all":
        return df
    when = to_date(df, date)
    if as_of is None:
        end = df.agg(F.max(when).cast("timestamp_ntz").alias("end")).scalar()
    else:
        end = F.lit(str(as_of)).cast("timestamp_ntz")
    if span == "last_30":
        start = end - F.make_dt_interval(days=F.lit(days))
    elif span == "this_month":
        start = F.trunc(end.cast("date"), "month").cast("timestamp_ntz")
    elif span == "this_year":
        start = F.trunc(end.cast("date"), "year").cast("timestamp_ntz")
    else:
        raise ValueError(f"Unsupported date range: {span}")
    return df.filter((when >= start) & (when <= end))


def sort_rows(
    df: DataFrame,
    by: str | Sequence[str],
    ascending: bool | Sequence[bool] = True,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """Total order by the given columns, NULLs last.

    The remaining columns break ties unless ``tie_break`` says which: the order is
    then repeatable, and rows sharing a sort key can be split over many ranges.
    """
    by = as_list(by)
    require_columns(df, by, tie_break)
    rest = (
        [c for c in df.columns if c not in by and is_sortable(df, c)]
        if tie_break is None
        else list(tie_break)
    )
    return df.orderBy(*order_keys(by, ascending), *order_keys(rest))


def limit_rows(df: DataFrame, n: int | str | None) -> DataFrame:
    """First ``n`` rows of an ordered frame; 0 or nothing means all."""
    count = int(n or 0)
    return df.limit(count) if count > 0 else df


def search_filter(
    df: DataFrame, search: str, columns: Sequence[str] | None = None, regex: bool = False
) -> DataFrame:
    """Rows in which any column contains the text, ignoring case."""
    if not search:
        return df
    names = list(columns) if columns is not None else df.columns
    require_columns(df, names)
    cells = [F.lower(ref(c).cast("string")) for c in names]
    if regex:
        hits = [cell.rlike("(?i)" + search) for cell in cells]
    else:
        hits = [cell.contains(search.lower()) for cell in cells]
    return df.filter(any_true([flag(h) for h in hits]))


def _page_size(size: int) -> int:
    if int(size) < 1:
        raise ValueError("A page has at least one row.")
    return int(size)


def search_total(
    df: DataFrame, search: str, columns: Sequence[str] | None = None, page_size: int = 50
) -> DataFrame:
    """One row: number of rows found and of pages they fill."""
    found = search_filter(df, search, columns).agg(F.count(F.lit(1)).alias("total_rows"))
    size = _page_size(page_size)
    return found.withColumn(
        "total_pages", F.greatest(F.ceil(F.col("total_rows") / F.lit(size)), F.lit(1)).cast("bigint")
    )


#: Rows that are ordered for a page, at most: further ones are left out by counting ranges. Bounds that a pass counts
#: rows between, and rows sampled to choose them.
PAGE_ROWS, PAGE_BOUNDS, PAGE_SAMPLE = 50_000, 100, 1_000


def _bounds(rows: DataFrame, key: str, n: int) -> list:
    """Some values of a column, in order, that part its rows about evenly. Which are chosen changes no result."""
    value, kind = ref(key), data_type(rows, key).typeName()
    if kind in ("array", "struct", "interval", "void"):
        return []
    usable = value.isNotNull() & ~F.isnan(value) if kind in ("double", "float") else value.isNotNull()
    if kind == "timestamp_ntz":
        value = value.cast("string")  # a datetime would be taken for one with a zone
    sampled = rows.select(value.alias("b")).filter(usable).sample(min(1.0, PAGE_SAMPLE / n), seed=1)
    found = sorted({r.b for r in sampled.limit(2 * PAGE_SAMPLE).collect()})
    return found[:: max(len(found) // PAGE_BOUNDS, 1)]


def _page_of(rows: DataFrame, n: int, keys: Sequence[tuple[str, bool]], start: int, size: int) -> DataFrame:
    """``size`` rows from place ``start`` on among the ``n`` rows, ordered by the (column, ascending) keys.

    One pass counts the rows at and between some values of the first key. Only those that hold the page are looked at
    further; where all have the same value, by the next key.
    """
    if not keys:
        return rows.limit(size)  # all equal
    key, up = keys[0]
    bounds = _bounds(rows, key, n) if n > PAGE_ROWS else []
    if not bounds:
        order = [o for k, asc in keys for o in order_keys([k], asc)]
        return rows.orderBy(*order).offset(start).limit(size)
    value, last = ref(key), 2 * len(bounds) + 1
    listed = F.array(*map(F.lit, bounds)).cast(f"array<{data_type(rows, key).simpleString()}>")
    below, up_to = (F.size(F.filter(listed, test)) for test in (lambda b: b < value, lambda b: b <= value))
    # Even: between two bounds; odd: at a bound. NULL comes last either way.
    place = below + up_to if up else last - 1 - below - up_to
    counted = rows.groupBy(F.when(value.isNull(), last).otherwise(place).alias("at")).agg(F.count("*").alias("n"))
    parts, passed = [], 0
    for at, held in sorted(map(tuple, counted.collect())):
        first, end = max(start - passed, 0), min(start + size - passed, held)
        passed += held
        if first >= end:
            continue
        i, same = divmod(at if up or at == last else last - 1 - at, 2)
        if at == last:
            inside, rest = value.isNull(), keys[1:]
        elif same:
            inside, rest = value == listed[i], keys[1:]
        else:
            inside, rest = (value > listed[i - 1]) if i else value.isNotNull(), keys
            inside = inside & (value < listed[i]) if i < len(bounds) else inside
        parts.append(_page_of(rows.filter(inside), held, rest, first, end - first))
    return reduce(DataFrame.unionByName, parts) if parts else rows.limit(0)


def search_rows(
    df: DataFrame,
    search: str = "",
    columns: Sequence[str] | None = None,
    sort_by: str | None = None,
    ascending: bool = True,
    offset: int = 0,
    limit: int = 50,
    regex: bool = False,
    deep: bool | None = None,
) -> DataFrame:
    """One page of the sorted rows that contain the text in any shown column.

    A page near the beginning is a plain top-k, for which every task keeps all rows before it. For pages from
    ``PAGE_ROWS`` rows on, or with ``deep``, passes that run while the plan is built count rows by ranges of the
    order, each narrowing the range that holds the page by a factor of about ``PAGE_BOUNDS``, until no more than
    ``PAGE_ROWS`` rows have to be ordered. Nothing is stored.
    """
    names = list(columns) if columns is not None else df.columns
    require_columns(df, names, sort_by)
    size = _page_size(limit)
    found = search_filter(df.select(*[ref(c) for c in names]), search, names, regex)
    rest = [c for c in names if c != sort_by and is_sortable(found, c)]
    order = [*order_keys([sort_by] if sort_by else [], ascending), *order_keys(rest)]
    far = offset + size > PAGE_ROWS if deep is None else deep
    if not far:
        return found.orderBy(*order).offset(offset).limit(size)
    keys = [*([(sort_by, ascending)] if sort_by else []), *((c, True) for c in rest)]
    page = _page_of(found, found.count(), keys, offset, size)
    return page.orderBy(*order).select(*[ref(c) for c in names])
