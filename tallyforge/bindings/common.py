"""Inputs shared by the bound queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    """Round for comparison: float sums depend on the order of addition."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the market segment and nation of their customer."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        "c_mktsegment", "c_nationkey",
    )


SALES = """sales AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
         c_mktsegment, c_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with revenue, discount and cost."""
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
        price.alias("revenue"),
        (price * (1 - F.col("l_discount"))).alias("cost"),
        (price * F.col("l_discount")).alias("discount"),
    )


LINES = """lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag,
         l_extendedprice AS revenue, l_extendedprice * (1 - l_discount) AS cost,
         l_extendedprice * l_discount AS discount
  FROM lineitem)"""

_DIRTY = """
  SELECT concat('C-', CAST(c_custkey % 1400 AS {text})) AS id_code,
         CASE WHEN c_custkey % 5 = 0 THEN concat('  ', c_name, ' ') ELSE c_name END AS name_txt,
         CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment)
              WHEN c_custkey % 20 = 1 THEN NULL ELSE c_mktsegment END AS segment,
         CASE WHEN c_custkey % 25 = 0 THEN 'n/a'
              WHEN x >= 1000 THEN concat(CAST(CAST(floor(x / 1000) AS bigint) AS {text}), ',',
                                         lpad(CAST(x % 1000 AS {text}), 3, '0'))
              ELSE CAST(x AS {text}) END AS amount_txt,
         CASE WHEN c_custkey % 10 = 0 THEN 'unknown'
              ELSE concat('2024-', lpad(CAST(c_custkey % 12 + 1 AS {text}), 2, '0'), '-15') END AS join_date,
         c_custkey % 40 - 1 AS qty,
         CASE WHEN c_custkey % 8 = 0 THEN 'bad address'
              ELSE concat('u', CAST(c_custkey AS {text}), '@x.org') END AS email
  FROM (SELECT c_custkey, c_name, c_mktsegment, CAST(floor(abs(c_acctbal)) AS bigint) AS x
        FROM {source}) AS c"""


def dirty_customer(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with stray spaces, mixed case, gaps, text numbers and repeated rows."""
    customer = table(spark, folder, "customer")
    twice = customer.unionByName(customer.filter("c_custkey % 100 = 0"))
    return spark.sql(_DIRTY.format(text="string", source="{src}"), src=twice)


DIRTY = "dirty AS (" + _DIRTY.format(
    text="varchar",
    source="(SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 100 = 0)",
) + ")"

# Text stripped of blanks and tabs, the only padding in the test tables.
NUMERIC_SQL = r"regexp_full_match({x}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')"


def number_sql(column: str) -> str:
    """DuckDB reading of number text with thousands marks."""
    bare = f"trim(replace({column}, ',', ''))"
    return f"CASE WHEN {NUMERIC_SQL.format(x=bare)} THEN TRY_CAST({bare} AS double) END"


def stacked(cte: str, key: str, value: str, items: dict[str, str], row: str) -> str:
    """UNION ALL of (key, value) rows, each picking one expression from ``row``."""
    selects = [
        f"SELECT '{name}' AS {key}, CAST({expr} AS double) AS {value} FROM {row}"
        for name, expr in items.items()
    ]
    return cte + " " + "\nUNION ALL ".join(selects)
