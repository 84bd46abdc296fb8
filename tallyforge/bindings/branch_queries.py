"""Sources and sinks read back, and the branches of operators that no other query takes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import cleaning, joins, rows
from ..operators.ordered import checkpoint_folder
from ..plans import reports
from ..sources import tables
from .common import DIRTY, SALES, dirty_customer, rounded, sales, table

BINDINGS = {}


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/tallyforge/{uuid.uuid4().hex}"


# Sources and sinks ---------------------------------------------------------------
def csv_round_trip(spark, d):
    """Customers written as CSV with padded and missing headers and line breaks in cells."""
    path = _folder(spark)
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", '))
    customer = table(spark, d, "customer").select(
        F.col("c_custkey").alias("  c_custkey "), F.col("c_acctbal").alias("Unnamed: 1"), note.alias("note")
    )
    customer.write.options(header=True, escape='"', ignoreTrailingWhiteSpace=False).csv(path)
    return tables.read_csv(spark, path)


BINDINGS["csv_round_trip"] = (
    csv_round_trip,
    """SELECT CAST(c_custkey AS bigint) AS c_custkey, c_acctbal AS "Column_2",
              concat(c_name, chr(10), '"', c_mktsegment, '", ') AS note FROM customer""",
)


def table_round_trip(spark, d):
    path = _folder(spark)
    tables.write_table(table(spark, d, "orders"), path, partition_by=["o_orderstatus"])
    return tables.read_table(spark, path)


BINDINGS["table_round_trip"] = (table_round_trip, "SELECT * FROM orders")


def export_round_trip(spark, d):
    path = _folder(spark)
    totals = agg.summarize(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", {"n": "count"}, sort=False)
    tables.export_result({"nations": table(spark, d, "nation"), "totals": totals}, path, "json")
    found = spark.read.schema("c_mktsegment string, n long").json(f"{path}/totals")
    names = spark.read.schema("n_nationkey long, n_name string").json(f"{path}/nations")
    return found.unionByName(names.select(F.col("n_name").alias("c_mktsegment"), F.col("n_nationkey").alias("n")))


BINDINGS["export_round_trip"] = (
    export_round_trip,
    """SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1
       UNION ALL SELECT n_name, n_nationkey FROM nation""",
)


# Pivots --------------------------------------------------------------------------
BINDINGS["pivot_variance"] = (
    lambda spark, d: rounded(
        agg.pivot(table(spark, d, "lineitem"), "l_returnflag", None, "l_quantity", "variance"), "variance", digits=4
    ),
    "SELECT l_returnflag, round(var_pop(l_quantity), 4) AS variance FROM lineitem GROUP BY 1",
)

BINDINGS["pivot_distinct"] = (
    lambda spark, d: agg.pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_custkey", "distinct_count"),
    """SELECT o_orderpriority, """
    + ", ".join(f"count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP")
    + " FROM orders GROUP BY 1",
)

BINDINGS["pivot_columns_only"] = (
    lambda spark, d: rounded(agg.pivot(table(spark, d, "lineitem"), None, "l_returnflag", "l_quantity"), "A", "N", "R"),
    "SELECT "
    + ", ".join(f"round(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 2) AS \"{f}\"" for f in "ANR")
    + " FROM lineitem",
)

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

BINDINGS["pivot_case_labels"] = (
    lambda spark, d: agg.pivot(dirty_customer(spark, d), "id_code", "segment", "qty", "count"),
    f"WITH {DIRTY} SELECT id_code, "
    + ", ".join(
        f"count(*) FILTER (WHERE segment = '{label}') AS \"{label}{mark}\""
        for s in _SEGMENTS
        for label, mark in ((s, ""), (s.lower(), "_2"))
    )
    + " FROM dirty WHERE segment IS NOT NULL GROUP BY 1",
)

BINDINGS["agg_distinct_text"] = (
    lambda spark, d: agg.summarize(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", {"kinds": "distinct_count"}),
    "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS kinds FROM customer GROUP BY 1",
)


# Joins ---------------------------------------------------------------------------
def _sides(spark, d):
    """Orders, and the lines of two in three of them; some keys of either side are missing."""
    orders = table(spark, d, "orders").selectExpr(
        "IF(o_orderkey % 50 = 0, NULL, o_orderkey) AS k", "o_totalprice AS price", "o_custkey AS price_left"
    )
    lines = table(spark, d, "lineitem").filter("l_linenumber = 1 AND l_orderkey % 3 < 2")
    return orders, lines.selectExpr("IF(l_orderkey % 40 = 0, NULL, l_orderkey) AS k", "l_extendedprice AS price")


_SIDES = """a AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS k, o_totalprice AS price,
                         o_custkey AS price_left FROM orders),
  b AS (SELECT CASE WHEN l_orderkey % 40 <> 0 THEN l_orderkey END AS k, l_extendedprice AS price
        FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 < 2)"""

for _how in ("inner", "left", "right", "outer"):
    BINDINGS[f"reconcile_{_how}"] = (
        lambda spark, d, how=_how: joins.reconcile(*_sides(spark, d), "k", "k", how),
        f"""WITH {_SIDES}, m AS (
              SELECT coalesce(a.k, b.k) AS k, a.price AS price_left_left, a.price_left, b.price AS price_right,
                     CASE WHEN b.price IS NULL THEN 'left_only' WHEN a.price IS NULL THEN 'right_only'
                          ELSE 'both' END AS _merge
              FROM a {"FULL" if _how == "outer" else _how.upper()} JOIN b ON a.k = b.k)
            SELECT * FROM m""",
    )

BINDINGS["match_full"] = (
    lambda spark, d: joins.match_datasets(*_sides(spark, d), "k", "full"),
    f"""WITH {_SIDES}
        SELECT coalesce(a.k, b.k) AS k, a.price, a.price_left, b.price AS price_right,
               CASE WHEN b.price IS NULL THEN 'left_only' WHEN a.price IS NULL THEN 'right_only' ELSE 'both' END AS _merge
        FROM a FULL JOIN b ON a.k = b.k""",
)


# Rows, cleaning, tasks -----------------------------------------------------------
BINDINGS["date_range_year"] = (
    lambda spark, d: rows.date_range(table(spark, d, "orders"), "o_orderdate", "this_year", "1996-06-20").select("o_orderkey"),
    """SELECT o_orderkey FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-06-20'""",
)

BINDINGS["search_large_page"] = (
    lambda spark, d: rows.search_rows(table(spark, d, "part"), "e", ["p_partkey", "p_name"], "p_name", offset=5, limit=500),
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') OR contains(CAST(p_partkey AS varchar), 'e')
       ORDER BY p_name NULLS LAST, p_partkey LIMIT 500 OFFSET 5""",
)

#: Far beyond what a top-k would keep: lines are found by counting ranges of their ship date, then of the other columns.
BINDINGS["search_far_page"] = (
    lambda spark, d: rows.search_rows(
        table(spark, d, "lineitem"), "", ["l_orderkey", "l_partkey", "l_shipdate", "l_returnflag"], "l_returnflag", False, offset=55_000, limit=300
    ),
    """SELECT l_orderkey, l_partkey, l_shipdate, l_returnflag FROM lineitem
       ORDER BY l_returnflag DESC NULLS LAST, l_orderkey, l_partkey, l_shipdate LIMIT 300 OFFSET 55000""",
)

BINDINGS["clean_case_lower"] = (
    lambda spark, d: cleaning.clean(dirty_customer(spark, d), "normalize_case", case_mode="lower").select("name_txt", "segment"),
    f"WITH {DIRTY} SELECT lower(name_txt) AS name_txt, lower(segment) AS segment FROM dirty",
)


def clean_zoned_dates(spark, d):
    """Order times as text with zones and as months."""
    text = """SELECT o_orderkey, concat(date_format(o_orderdate, 'yyyy-MM-dd'),
                IF(o_orderkey % 2 = 0, 'T10:30:00Z', 'T10:30:00+02:00')) AS zoned,
                date_format(o_orderdate, 'yyyy-MM') AS month FROM {o}"""
    return cleaning.fix_dates(spark.sql(text, o=table(spark, d, "orders")))


BINDINGS["clean_zoned_dates"] = (
    clean_zoned_dates,
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS date) AS timestamp)
                + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 630 MINUTE ELSE INTERVAL 510 MINUTE END AS zoned,
              CAST(date_trunc('month', o_orderdate) AS timestamp) AS month FROM orders""",
)


def task_branches(spark, d):
    """The frames of the tasks calculate, pivot, charts and top_n, one under the other."""
    source, parts = sales(spark, d), []
    for task, name in (("calculate", "summary"), ("pivot", "summary"), ("charts", "summary"), ("top_n", "ranking")):
        frame = reports.task_frames(task, source, "o_totalprice", "c_mktsegment", n=3)[name]
        value = "sum" if name == "summary" else "o_totalprice"
        parts.append(frame.select(F.lit(task).alias("task"), "c_mktsegment", F.round(value, 2).alias("value")))
    total = reports.task_frames("calculate", source, "o_totalprice")["summary"]
    parts.append(total.select(F.lit("total").alias("task"), F.col("metric").alias("c_mktsegment"), F.round("value", 2).alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


BINDINGS["task_branches"] = (
    task_branches,
    f"""WITH {SALES}, s AS (SELECT c_mktsegment, sum(o_totalprice) AS v FROM sales GROUP BY 1)
        SELECT task, c_mktsegment, round(v, 2) AS value
        FROM s, (VALUES ('calculate'), ('pivot'), ('charts')) AS t(task)
        UNION ALL SELECT * FROM (SELECT 'top_n', c_mktsegment, round(v, 2) FROM s ORDER BY v DESC LIMIT 3)
        UNION ALL SELECT 'total', 'sum', round(sum(o_totalprice), 2) FROM sales""",
)


# Row arithmetic and conditions by the library's own operators ----------------------
def math_columns(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    out = rows.math_expression(line, "l_extendedprice", "*", "l_discount", "off")
    out = rows.math_expression(out, "l_quantity", "-", 25, "gap")
    out = rows.math_expression(out, "off", "%", "l_extendedprice", "rate")
    return rounded(out.select("l_orderkey", "l_linenumber", "off", "gap", "rate"), "off", "rate", digits=4)


BINDINGS["math_columns"] = (
    math_columns,
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS off, l_quantity - 25.0 AS gap,
              round(100 * (l_extendedprice * l_discount / nullif(l_extendedprice, 0)), 4) AS rate FROM lineitem""",
)


def condition_counts(spark, d):
    line = rows.logical_flag(table(spark, d, "lineitem"), "l_quantity", "gte", 40, "Bulk", "Loose", "size")
    return rows.flag_counts(line, "size")


BINDINGS["condition_counts"] = (
    condition_counts,
    """SELECT CASE WHEN l_quantity >= 40 THEN 'Bulk' ELSE 'Loose' END AS size, count(*) AS count
       FROM lineitem GROUP BY 1""",
)
