"""CSV and Parquet input, Parquet/CSV/JSON output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import ISO_DATE_PATTERN, parse_number, strip
from ..functions.columns import header_names, ref, string_columns

# Cell texts that mean "no value".
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

WHOLE_PATTERN = r"^[+-]?\d{1,18}$"


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*header_names(df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, the only missing value used here."""
    changes = {
        f.name: F.when(~F.isnan(ref(f.name)), ref(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(changes) if changes else df


def _fits(column: Column) -> dict[str, Column]:
    filled = column.isNotNull()
    return {
        "bigint": filled & column.rlike(WHOLE_PATTERN),
        "double": filled & parse_number(column).isNotNull(),
        "boolean": filled & F.lower(column).isin("true", "false"),
        "timestamp_ntz": filled
        & column.rlike(ISO_DATE_PATTERN)
        & column.try_cast("timestamp_ntz").isNotNull(),
    }


def infer_types(df: DataFrame) -> DataFrame:
    """Retype the text columns whose every value fits a narrower type.

    One pass counts the fits of all columns; a single row comes to the driver.
    """
    names = string_columns(df)
    if not names:
        return df
    aggs = []
    for i, name in enumerate(names):
        cell = strip(ref(name))
        aggs.append(F.count(cell).alias(f"n_{i}"))
        aggs += [F.count_if(fit).alias(f"{kind}_{i}") for kind, fit in _fits(cell).items()]
    found = df.agg(*aggs).first()
    changes = {}
    for i, name in enumerate(names):
        for kind in ("bigint", "double", "boolean", "timestamp_ntz"):
            if found[f"n_{i}"] and found[f"{kind}_{i}"] == found[f"n_{i}"]:
                changes[name] = strip(ref(name)).try_cast(kind)
                break
    return df.withColumns(changes) if changes else df


def _encoding(spark: SparkSession, path: str | list[str]) -> str:
    """UTF-8 unless a line holds bytes that are not, then Latin-1."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return "ISO-8859-1" if broken.count() else "UTF-8"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
    separator: str = ",",
    multi_line: bool = True,
) -> DataFrame:
    """CSV or text file with a header line.

    Without ``schema`` types are inferred in one pass; without ``encoding`` another
    pass looks for non-UTF-8 bytes. Give both for large inputs. Quoted cells may hold
    line breaks, so each file is read by one task; say ``multi_line=False`` for large
    files in which every line is a record, and Spark splits them.
    """
    encoding = encoding or _encoding(spark, path)
    options = {
        "encoding": encoding, "sep": separator, "quote": '"', "escape": '"', "multiLine": multi_line,
    }
    if schema is not None:
        typed = spark.read.options(**options).option("header", True).schema(schema).csv(path)
        return nan_to_null(normalize_headers(typed))
    first = spark.read.options(**options).option("header", False).csv(path).first()
    if first is None:
        return spark.createDataFrame([], T.StructType([]))
    names = header_names(list(first))
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (
        spark.read.options(**options)
        .option("header", True)
        .option("enforceSchema", True)
        .schema(text)
        .csv(path)
    )
    cells = {n: F.when(~strip(ref(n)).isin(*NULL_TEXTS), ref(n)) for n in names}
    return infer_types(raw.withColumns(cells))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table. It stays bare, so filters and column choices reach the files;
    the operators read NaN as missing by themselves."""
    return spark.read.parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partition_by: Sequence[str] | None = None,
) -> None:
    """Parquet table, optionally laid out by partition columns."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def export_result(
    tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write each result table to its own folder below ``path``."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"Unsupported format: {fmt}")
    for name, df in tables.items():
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        writer.save(f"{path.rstrip('/')}/{name}")
