"""Row predicates: equality on normalised text, numeric comparison, containment."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import norm_literal, norm_text, text, to_number
from .columns import all_true, is_numeric, ref, require_columns

# The spellings each operator accepts.
OPERATOR_NAMES = {
    "eq": ("=", "==", "eq", "equals", "is", ""),
    "ne": ("!=", "<>", "ne", "not", "is not"),
    "gt": (">", "gt", "greater than"),
    "gte": (">=", "gte", "at least"),
    "lt": ("<", "lt", "less than"),
    "lte": ("<=", "lte", "at most"),
    "contains": ("contains", "like"),
}

_CANONICAL = {alias: name for name, aliases in OPERATOR_NAMES.items() for alias in aliases}
_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")


def canonical_operator(op: str | None) -> str:
    key = (op or "").strip().lower()
    if key not in _CANONICAL:
        raise ValueError(f"Unsupported operator: {op}")
    return _CANONICAL[key]


def literal_number(value: object) -> float | int | None:
    """Number behind a literal, or None; whole numbers stay whole."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return value
    if isinstance(value, str) and _NUMBER.fullmatch(value):
        try:
            return int(value)
        except ValueError:
            return float(value)
    return None


def equals(df: DataFrame, column: str, value: object) -> Column:
    """Stripped, case-blind equality. Numeric columns compare as numbers, so the
    test reaches the file scan; NULL equals nothing."""
    require_columns(df, column)
    number = literal_number(value)
    if number is not None and is_numeric(df, column):
        return ref(column) == F.lit(number)
    return norm_text(ref(column)) == F.lit(norm_literal(value))


def not_equals(df: DataFrame, column: str, value: object) -> Column:
    """Negated equality; rows without a value are kept."""
    require_columns(df, column)
    number = literal_number(value)
    if number is not None and is_numeric(df, column):
        return ~ref(column).eqNullSafe(F.lit(number))
    return ~norm_text(ref(column)).eqNullSafe(F.lit(norm_literal(value)))


def compares(df: DataFrame, column: str, op: str, value: object) -> Column:
    require_columns(df, column)
    number = literal_number(value)
    if number is None:
        raise ValueError(f"'{value}' is not a number.")
    bound = F.lit(number)
    # Typed columns stay bare for pushdown. NaN sorts above every number in Spark,
    # so the upper-open tests exclude it by name.
    typed = is_numeric(df, column)
    left = ref(column) if typed else to_number(df, column)
    if op in ("gt", "gte"):
        test = left > bound if op == "gt" else left >= bound
        return test & ~F.isnan(left) if typed and _is_floating(df, column) else test
    return left < bound if op == "lt" else left <= bound


def _is_floating(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("double", "float")


def contains(df: DataFrame, column: str, value: object, regex: bool = True) -> Column:
    """Case-blind search, as a regular expression unless ``regex`` is off."""
    require_columns(df, column)
    if regex:
        return text(ref(column)).rlike("(?i)" + str(value))
    return F.lower(text(ref(column))).contains(str(value).lower())


def predicate(df: DataFrame, column: str, op: str | None, value: object, regex: bool = True) -> Column:
    """One test on one column. May be NULL, which a filter reads as false;
    wrap it in :func:`flag` where a definite answer is needed."""
    name = canonical_operator(op)
    if name == "eq":
        return equals(df, column, value)
    if name == "ne":
        return not_equals(df, column, value)
    if name == "contains":
        return contains(df, column, value, regex)
    return compares(df, column, name, value)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def criteria(df: DataFrame, conditions: Sequence[Mapping[str, object]]) -> Column:
    """Conjunction of ``{column, value, op}`` entries (``op`` defaults to equality)."""
    return all_true(
        [
            predicate(df, str(c["column"]), c.get("op", c.get("operator", "=")), c["value"])
            for c in conditions
        ]
    )


def combined_filter(df: DataFrame, filters: Sequence[Mapping[str, object]]) -> Column | None:
    """Left-to-right combination of ``{field, operator, value, join}`` entries.

    Entries without field or value are skipped; ``join`` is AND (default) or OR
    and ties an entry to everything before it. Tests stay bare (NULL counts as
    false in a filter), so plain conjuncts reach the file scan.
    """
    out: Column | None = None
    for entry in filters:
        field, value = entry.get("field"), entry.get("value")
        if not field or value is None or value == "":
            continue
        test = predicate(df, str(field), entry.get("operator") or "eq", value)
        join = str(entry.get("join") or "AND").upper()
        if join not in ("AND", "OR"):
            raise ValueError(f"Unsupported join: {join}")
        if out is None:
            out = test
        else:
            out = out | test if join == "OR" else out & test
    return out
