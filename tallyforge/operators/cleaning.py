"""Cleaning steps, always applied in the same order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.coerce import parse_date, parse_number, strip, title_case, without
from ..functions.columns import TEMP, is_numeric, is_string, is_temporal, ref, string_columns
from ..functions.predicates import literal_number
from .duplicates import drop_duplicates, duplicate_row_count
from .ordered import durable

# The steps in the order they run.
ACTIONS = (
    "trim_spaces",
    "normalize_case",
    "numbers_as_text",
    "fix_dates",
    "fill_blanks",
    "drop_blanks",
    "drop_duplicates",
)


def _map_strings(df: DataFrame, change) -> DataFrame:
    names = string_columns(df)
    return df.withColumns({c: change(ref(c)) for c in names}) if names else df


def trim_spaces(df: DataFrame) -> DataFrame:
    """Strip every text column."""
    return _map_strings(df, strip)


def normalize_case(df: DataFrame, mode: str = "title") -> DataFrame:
    """Lower, upper or title case for every text column."""
    changes = {"lower": F.lower, "upper": F.upper, "title": title_case}
    if mode not in changes:
        raise ValueError(f"Unsupported case mode: {mode}")
    return _map_strings(df, changes[mode])


def _number(column: Column) -> Column:
    return parse_number(without(column, [","]))


def parse_shares(df: DataFrame, formats: Sequence[str] | None = None) -> DataFrame:
    """One row: per text column the share of all rows that read as number or date."""
    aggs = []
    for i, c in enumerate(string_columns(df)):
        aggs.append(F.avg(_number(ref(c)).isNotNull().cast("double")).alias(f"number_{i}"))
        aggs.append(F.avg(parse_date(ref(c), formats).isNotNull().cast("double")).alias(f"date_{i}"))
    return df.agg(*aggs)


def _convert(
    df: DataFrame,
    numbers: bool,
    dates: bool,
    number_threshold: float,
    date_threshold: float,
    formats: Sequence[str] | None,
) -> DataFrame:
    """Retype text columns. The new schema depends on the data, so one pass for all
    columns measures the shares; a single row of ratios comes to the driver."""
    names = string_columns(df)
    if not names:
        return df
    shares = parse_shares(df, formats).first()
    changes = {}
    for i, c in enumerate(names):
        if numbers and (shares[f"number_{i}"] or 0.0) > number_threshold:
            changes[c] = _number(ref(c))
        elif dates and (shares[f"date_{i}"] or 0.0) > date_threshold:
            changes[c] = parse_date(ref(c), formats)
    return df.withColumns(changes) if changes else df


def numbers_as_text(df: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Text columns mostly holding numbers become numeric; the rest turns NULL."""
    return _convert(df, True, False, threshold, 1.0, None)


def fix_dates(
    df: DataFrame, threshold: float = 0.60, formats: Sequence[str] | None = None
) -> DataFrame:
    """Text columns mostly holding dates become timestamps; the rest turns NULL."""
    return _convert(df, False, True, 1.0, threshold, formats)


def fill_blanks(df: DataFrame, fill_value: object | None = None) -> DataFrame:
    """NULL becomes 0 or the fill in numbers, 'Unknown' or the fill in text."""
    number = 0 if fill_value is None else literal_number(fill_value)
    word = "Unknown" if fill_value in (None, "") else str(fill_value)
    changes = {}
    for c in df.columns:
        if is_numeric(df, c) and number is not None:
            kind = df.schema[c].dataType
            filled = F.lit(number)
            # A fractional fill widens whole-number columns.
            changes[c] = F.coalesce(ref(c), filled.cast(kind) if isinstance(number, int) else filled)
        elif is_string(df, c):
            changes[c] = F.coalesce(ref(c), F.lit(word))
    return df.withColumns(changes) if changes else df


def drop_blanks(df: DataFrame) -> DataFrame:
    """Rows without any NULL."""
    return df.na.drop("any")


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly. Reading texts costs far more than a shuffle, and a file of few row groups would
    leave it to few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def clean(
    df: DataFrame,
    actions: str | Sequence[str] = "all",
    fill_value: object | None = None,
    case_mode: str = "title",
    number_threshold: float = 0.80,
    date_threshold: float = 0.60,
    formats: Sequence[str] | None = None,
    spread: bool = True,
) -> DataFrame:
    """The chosen steps (or all) in their fixed order. Rows are dealt out first if texts are read, unless ``spread`` is
    false, for rows that a shuffle has dealt out already."""
    wanted = set(ACTIONS) if actions == "all" else {actions} if isinstance(actions, str) else set(actions)
    if "all" in wanted:
        wanted = set(ACTIONS)
    unknown = wanted - set(ACTIONS)
    if unknown:
        raise ValueError(f"Unknown cleaning action: {sorted(unknown)[0]}")
    out = _spread(df) if spread and wanted & {"normalize_case", "numbers_as_text", "fix_dates"} else df
    if "trim_spaces" in wanted:
        out = trim_spaces(out)
    if "normalize_case" in wanted:
        out = normalize_case(out, case_mode)
    if wanted & {"numbers_as_text", "fix_dates"}:
        out = _convert(
            out, "numbers_as_text" in wanted, "fix_dates" in wanted,
            number_threshold, date_threshold, formats,
        )
    if "fill_blanks" in wanted:
        out = fill_blanks(out, fill_value)
    if "drop_blanks" in wanted:
        out = drop_blanks(out)
    if "drop_duplicates" in wanted:
        out = drop_duplicates(out)
    return out


def _missing(df: DataFrame) -> DataFrame:
    blanks = [F.count_if(ref(c).isNull()) for c in df.columns]
    total = blanks[0]
    for b in blanks[1:]:
        total = total + b
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("missing_cells"))


def _retyped(before: DataFrame, after: DataFrame) -> str:
    turned = [
        c for c in after.columns
        if c in before.columns and is_string(before, c) and (is_numeric(after, c) or is_temporal(after, c))
    ]
    return ", ".join(turned)


def clean_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counts around a cleaning run, plus the columns it retyped. Reads both tables;
    :func:`clean_with_log` counts while it cleans."""
    b = _missing(before).select(F.struct("rows", "missing_cells").alias("s")).scalar()
    d = duplicate_row_count(before).scalar()
    return _missing(after).select(
        b["rows"].alias("rows_before"),
        F.col("rows").alias("rows_after"),
        b["missing_cells"].alias("missing_before"),
        F.col("missing_cells").alias("missing_after"),
        d.alias("duplicate_rows_before"),
        F.lit(_retyped(before, after)).alias("retyped_columns"),
    )


def _blank_cells(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [ref(c).isNull().cast("bigint") for c in df.columns])


def clean_with_log(df: DataFrame, actions: str | Sequence[str] = "all", **options) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, stored, and the log of its cleaning as in :func:`clean_log`; options are those of ``clean``.

    Equal rows are brought together first, with their number, which tells the repeats. Rows, gaps and repeats before
    are observed there and those after while the result is written, so the log reads nothing again. Runs these jobs
    at once.
    """
    count = TEMP + "count"
    together = df.groupBy(*[ref(c) for c in df.columns]).agg(F.count("*").alias(count))
    before, after = Observation(), Observation()
    n = ref(count)
    seen = together.observe(
        before,
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(n * _blank_cells(df)), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("repeats"),
    )
    # Dealt out again, as some steps go by shares of the rows.
    rows = seen.withColumn(count, F.explode(F.sequence(F.lit(1), n))).drop(count)
    cleaned = clean(rows, actions, **({"spread": False} | options))
    blanks = F.coalesce(F.sum(_blank_cells(cleaned)), F.lit(0))
    stored = durable(cleaned.observe(after, F.count("*").alias("rows"), blanks.alias("missing")))
    b, a = before.get, after.get
    kinds = "rows_before long, rows_after long, missing_before long, missing_after long, duplicate_rows_before long, retyped_columns string"
    line = (b["rows"], a["rows"], b["missing"], a["missing"], b["repeats"], _retyped(df, cleaned))
    return stored, df.sparkSession.createDataFrame([line], kinds)
