"""Column lookup helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefix of every column an operator adds for its own use and drops again.
TEMP = "__tf_"


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def require_columns(df: DataFrame, *names: str | Iterable[str] | None) -> None:
    """Raise ``ValueError`` before any plan is built if a column is missing."""
    known = set(df.columns)
    for group in names:
        for name in as_list(group):
            if name not in known:
                raise ValueError(f"Column '{name}' not found.")


def ref(name: str) -> Column:
    """Column reference that also works for names holding dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def qualified(alias: str, name: str) -> Column:
    return F.col(f"{alias}.`" + name.replace("`", "``") + "`")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.StringType, T.CharType, T.VarcharType))


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_boolean(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.BooleanType)


def is_sortable(df: DataFrame, name: str) -> bool:
    return not isinstance(data_type(df, name), (T.MapType, T.VariantType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def string_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_string(df, c)]


def order_keys(names: Sequence[str], ascending: bool | Sequence[bool] = True) -> list[Column]:
    """Sort expressions with NULLs last in both directions."""
    flags = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if len(flags) != len(names):
        raise ValueError("'ascending' needs one flag per sort column.")
    return [
        ref(n).asc_nulls_last() if up else ref(n).desc_nulls_last()
        for n, up in zip(names, flags)
    ]


def null_safe_equal(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equi-join condition under which NULL keys meet each other."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & a.eqNullSafe(b)
    return cond


def all_true(conditions: Sequence[Column]) -> Column:
    out = None
    for cond in conditions:
        out = cond if out is None else out & cond
    return F.lit(True) if out is None else out


def any_true(conditions: Sequence[Column]) -> Column:
    out = None
    for cond in conditions:
        out = cond if out is None else out | cond
    return F.lit(False) if out is None else out


def key_values(row: DataFrame, key: str, value: str, names: Sequence[str] | None = None) -> DataFrame:
    """Turn a one-row frame of numbers into (key, value) rows."""
    names = list(names or row.columns)
    pairs = [
        F.struct(F.lit(n).alias(key), ref(n).cast("double").alias(value)) for n in names
    ]
    return row.select(F.inline(F.array(*pairs)))


def numbered(names: Sequence[str]) -> list[str]:
    """Names with repeats numbered. Names differing only in case count as repeats, since
    Spark resolves columns without regard to case."""
    used: set[str] = set()
    seen: dict[str, int] = {}
    out = []
    for base in names:
        key, name = base.lower(), base
        seen[key] = seen.get(key, 0) + 1
        if seen[key] > 1:
            name = f"{base}_{seen[key]}"
        while name.lower() in used:
            seen[key] += 1
            name = f"{base}_{seen[key]}"
        used.add(name.lower())
        out.append(name)
    return out


def header_names(names: Sequence[str | None]) -> list[str]:
    """Usable column names: stripped, blanks named by position, repeats numbered."""
    bare = ["" if raw is None else str(raw).strip() for raw in names]
    unnamed = (f"Column_{i + 1}" for i in range(len(bare)))
    return numbered([u if not n or n.startswith("Unnamed") else n for n, u in zip(bare, unnamed)])


def raw_value(df: DataFrame, name: str) -> Column:
    """A column as it is, but NaN as NULL."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return F.when(~F.isnan(ref(name)), ref(name)) if floating else ref(name)
