"""Coercion rules: every value that cannot be read becomes NULL, never an error."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import (
    data_type,
    is_boolean,
    is_numeric,
    is_string,
    is_temporal,
    ref,
    require_columns,
)

# What str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Plain or exponent notation only; a bare cast would also take '5d', '1f' and 'inf'.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

ISO_DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"

# A date and time with a zone: UTC or an offset in hours and minutes.
ZONED_PATTERN = r"^(\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?) ?(?:[Zz]|([+-])(\d{2}):?(\d{2})?)$"

MONTH_PATTERN = r"^\d{4}-\d{1,2}$"

# Tried after ISO text, month before day where the text leaves it open.
DATE_FORMATS = (
    "yyyy/M/d",
    "M/d/yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
)


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITESPACE))


def text(column: Column) -> Column:
    return column.cast("string")


def norm_text(column: Column) -> Column:
    """Text form used by every equality test: stripped and lower-cased."""
    return F.lower(strip(text(column)))


def norm_literal(value: object) -> str:
    return str(value).strip().lower()


def without(column: Column, marks: Sequence[str]) -> Column:
    """Drop every occurrence of the given marks."""
    for mark in marks:
        column = F.replace(column, F.lit(mark), F.lit(""))
    return column


def parse_number(column: Column) -> Column:
    """Strictly read number text; infinities become NULL."""
    cleaned = strip(column)
    parsed = F.when(cleaned.rlike(NUMBER_PATTERN), cleaned.try_cast("double"))
    # Most other texts are told by their first character.
    maybe = F.instr(F.lit("0123456789+-."), F.substring(cleaned, 1, 1)) > 0
    return F.when(maybe & (F.abs(parsed) < F.lit(float("inf"))), parsed)


def finite(column: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.abs(column) < F.lit(float("inf")), column)


def to_number(df: DataFrame, name: str, drop: Sequence[str] = ()) -> Column:
    """``name`` as double; ``drop`` lists marks such as ',' to ignore in text."""
    require_columns(df, name)
    column, kind = ref(name), data_type(df, name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(column.cast("double"))
    if is_numeric(df, name) or is_boolean(df, name):
        return column.cast("double")
    if is_string(df, name):
        return parse_number(without(column, drop))
    return F.lit(None).cast("double")


def format_shape(fmt: str) -> str:
    """Regular expression of the texts a date format can read at all."""
    shape = ""
    for run in re.findall(r"(y+|M+|d+|.)", fmt):
        if run[0] == "y":
            shape += r"\d{4}"
        elif run[0] == "M" and len(run) > 2:
            shape += "[A-Za-z]{3}" if len(run) == 3 else "[A-Za-z]+"
        elif run[0] in "Md":
            shape += r"\d{1,2}"
        else:
            shape += re.escape(run)
    return f"^{shape}$"


def _zoned(cleaned: Column) -> Column:
    """Text with a zone as the time it is in UTC."""
    local, sign, hours, minutes = (F.regexp_extract(cleaned, ZONED_PATTERN, i) for i in range(1, 5))
    ahead = 60 * F.coalesce(hours.try_cast("int"), F.lit(0)) + F.coalesce(minutes.try_cast("int"), F.lit(0))
    shift = F.when(sign == "-", ahead).otherwise(-ahead)
    zero = F.lit(0)
    moved = local.try_cast("timestamp_ntz") + F.make_dt_interval(zero, zero, shift, zero.cast("decimal(18,6)"))
    return F.when(cleaned.rlike(ZONED_PATTERN), moved)


def parse_date(column: Column, formats: Sequence[str] | None = None) -> Column:
    """Date text as a zone-less timestamp; the first format that reads it wins.

    ISO text comes first, with a zone (read as UTC) or without, then a year and month.

    A text is handed to a parser only if its shape fits, since failing parsers are
    slow, and shapes that begin with a digit are tried only on texts that do. Month names
    may be in any case.
    """
    cleaned = strip(column)
    month = F.concat(cleaned, F.lit("-01")).try_cast("timestamp_ntz")
    attempts = [
        (True, F.when(cleaned.rlike(ISO_DATE_PATTERN), cleaned.try_cast("timestamp_ntz"))),
        (True, F.when(cleaned.rlike(MONTH_PATTERN), month)),
        (True, _zoned(cleaned)),
    ]
    for fmt in DATE_FORMATS if formats is None else formats:
        words = F.initcap(cleaned) if "MMM" in fmt else cleaned
        parsed = F.try_to_date(words, fmt).cast("timestamp_ntz")
        shape = format_shape(fmt)
        attempts.append((shape.startswith(r"^\d"), F.when(cleaned.rlike(shape), parsed)))
    head = F.substring(cleaned, 1, 1)
    runs = []
    for digit_first, run in groupby(attempts, key=lambda a: a[0]):
        found = F.coalesce(*[attempt for _, attempt in run])
        runs.append(F.when(head.between("0", "9"), found) if digit_first else found)
    return F.coalesce(*runs)


def to_date(df: DataFrame, name: str, formats: Sequence[str] | None = None) -> Column:
    """``name`` as a timestamp; typed columns as they are, numbers are never dates."""
    require_columns(df, name)
    if is_temporal(df, name):
        return ref(name)
    if is_string(df, name):
        return parse_date(ref(name), formats)
    return F.lit(None).cast("timestamp_ntz")


def title_case(column: Column) -> Column:
    """Capital after every non-letter, the rest lower (``O'Brien A-B 3Rd``)."""
    # Signs, digits and blanks of ASCII have no capitals, so no word begins at them.
    words = F.split(F.lower(column), r"(?<=[^\p{L}])(?=[^\x00-@\[-`{-\x7F])")
    capital = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    )
    return F.array_join(capital, "")


def clean_number(df: DataFrame, name: str) -> Column:
    """Numeric column with NaN and infinities read as NULL, type kept."""
    column = ref(name)
    if isinstance(data_type(df, name), (T.DoubleType, T.FloatType)):
        return finite(column)
    return column


def half_up(column: Column, digits: int = 2, half_even: bool = False) -> Column:
    return F.bround(column, digits) if half_even else F.round(column, digits)
