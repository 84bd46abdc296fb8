"""Filters, computed columns, reshaping, sorting, paging, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coerce import strip, title_case
from ..operators import rows
from .common import DIRTY, dirty_customer, lines, rounded, table

BINDINGS = {}


def filter_eq(spark, d):
    return rows.filter_rows(table(spark, d, "customer"), "c_mktsegment", "equals", "  building ").select(
        "c_custkey", "c_name", "c_mktsegment"
    )


BINDINGS["filter_eq"] = (
    filter_eq,
    """SELECT c_custkey, c_name, c_mktsegment FROM customer
       WHERE lower(trim(c_mktsegment)) = 'building'""",
)


def filter_ne(spark, d):
    return rows.filter_rows(dirty_customer(spark, d), "segment", "!=", "Building").select(
        "id_code", "segment"
    )


BINDINGS["filter_ne"] = (
    filter_ne,
    f"""WITH {DIRTY} SELECT id_code, segment FROM dirty
        WHERE segment IS NULL OR lower(trim(segment)) <> 'building'""",
)


def filter_compare(spark, d):
    found = rows.filter_rows(table(spark, d, "lineitem"), "l_quantity", ">=", 45)
    return found.select("l_orderkey", "l_linenumber", "l_quantity")


BINDINGS["filter_compare"] = (
    filter_compare,
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45",
)


def filter_contains(spark, d):
    return rows.filter_rows(table(spark, d, "part"), "p_name", "contains", "RING|bolt").select(
        "p_partkey", "p_name"
    )


BINDINGS["filter_contains"] = (
    filter_contains,
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring|bolt', 'i')",
)


def filter_or(spark, d):
    filters = [
        {"field": "l_returnflag", "operator": "is", "value": "r"},
        {"field": "l_quantity", "operator": "at least", "value": 49, "join": "OR"},
        {"field": "l_discount", "operator": "lt", "value": "0.05"},
        {"field": "", "operator": "eq", "value": "ignored"},
    ]
    found = rows.apply_filters(table(spark, d, "lineitem"), filters)
    return found.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


BINDINGS["filter_or"] = (
    filter_or,
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
       WHERE (lower(l_returnflag) = 'r' OR l_quantity >= 49) AND l_discount < 0.05""",
)


def filter_optional(spark, d):
    orders = table(spark, d, "orders")
    kept = rows.apply_filter(rows.apply_filter(orders, "o_orderstatus", "f"), None, "x")
    return kept.select("o_orderkey", "o_orderstatus")


BINDINGS["filter_optional"] = (
    filter_optional,
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE lower(trim(o_orderstatus)) = 'f'",
)

BINDINGS["filter_match_count"] = (
    lambda spark, d: rows.match_count(table(spark, d, "orders"), "o_totalprice", "gt", 300000),
    """SELECT count(*) FILTER (WHERE o_totalprice > 300000) AS matched_rows,
              count(*) AS total_rows FROM orders""",
)


def math_expr(spark, d):
    out = rows.math_expression(table(spark, d, "lineitem"), "l_extendedprice", "/", "l_quantity", "unit")
    out = rows.math_expression(out, "l_discount", "pct", "l_tax", "share")
    out = rows.math_expression(out, "l_quantity", "mul", 2, "twice")
    return out.select("l_orderkey", "l_linenumber", "unit", "share", "twice")


BINDINGS["math_expr"] = (
    math_expr,
    """SELECT l_orderkey, l_linenumber,
              l_extendedprice / nullif(l_quantity, 0) AS unit,
              l_discount / nullif(l_tax, 0) * 100 AS share,
              l_quantity * 2 AS twice
       FROM lineitem""",
)


def math_total(spark, d):
    out = rows.math_expression(table(spark, d, "lineitem"), "l_extendedprice", "-", "l_tax", "net")
    return rounded(rows.column_total(out, "net"), "total")


BINDINGS["math_total"] = (
    math_total,
    "SELECT round(sum(l_extendedprice - l_tax), 2) AS total FROM lineitem",
)


def if_flag(spark, d):
    flagged = rows.logical_flag(table(spark, d, "orders"), "o_totalprice", ">", 250000, "Large", "Small", "size")
    return flagged.select("o_orderkey", "size")


BINDINGS["if_flag"] = (
    if_flag,
    """SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'Large' ELSE 'Small' END AS size
       FROM orders""",
)

BINDINGS["if_flag_counts"] = (
    lambda spark, d: rows.flag_counts(
        rows.logical_flag(table(spark, d, "orders"), "o_orderpriority", "contains", "urgent")
    ),
    """SELECT CASE WHEN regexp_matches(o_orderpriority, 'urgent', 'i') THEN 'Yes' ELSE 'No' END AS "Flag",
              count(*) AS count FROM orders GROUP BY 1""",
)


def multi_lookup(spark, d):
    conditions = [
        {"column": "o_orderstatus", "value": "f"},
        {"column": "o_orderpriority", "value": " 2-high"},
    ]
    return rows.multi_condition_lookup(
        table(spark, d, "orders"), conditions, ["o_orderkey", "o_custkey", "not_there"]
    )


BINDINGS["multi_lookup"] = (
    multi_lookup,
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE lower(o_orderstatus) = 'f' AND lower(o_orderpriority) = '2-high'""",
)

BINDINGS["unpivot_fields"] = (
    lambda spark, d: rows.unpivot_fields(
        table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey"
    ),
    """SELECT p_partkey, 'p_name' AS field, p_name AS value FROM part
       UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part
       UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS varchar) FROM part""",
)


def date_range_last30(spark, d):
    events = rows.date_range(table(spark, d, "events"), "ts", "last_30")
    return events.select("event_id", "event_type")


BINDINGS["date_range_last30"] = (
    date_range_last30,
    """SELECT event_id, event_type FROM events
       WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY""",
)


def date_range_month(spark, d):
    orders = rows.date_range(table(spark, d, "orders"), "o_orderdate", "this_month", "1998-06-20")
    return orders.select("o_orderkey")


BINDINGS["date_range_month"] = (
    date_range_month,
    """SELECT o_orderkey FROM orders
       WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate <= TIMESTAMP '1998-06-20'""",
)


def search_page(spark, d):
    part = table(spark, d, "part")
    columns = ["p_partkey", "p_name", "p_brand", "p_type"]
    return rows.search_rows(part, "Red", columns, "p_name", False, offset=20, limit=25)


BINDINGS["search_page"] = (
    search_page,
    """SELECT p_partkey, p_name, p_brand, p_type FROM part
       WHERE contains(lower(CAST(p_partkey AS varchar)), 'red') OR contains(lower(p_name), 'red')
          OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')
       ORDER BY p_name DESC, p_partkey, p_brand, p_type LIMIT 25 OFFSET 20""",
)

BINDINGS["search_total"] = (
    lambda spark, d: rows.search_total(table(spark, d, "part"), "bolt", ["p_name", "p_brand"]),
    """SELECT count(*) AS total_rows, CAST(greatest(ceil(count(*) / 50.0), 1) AS bigint) AS total_pages
       FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt')""",
)


def sort_rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rows.sort_rows(orders, ["o_orderstatus", "o_totalprice"], [True, False])


BINDINGS["sort_rows"] = (
    sort_rows,
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey""",
)


def limit_rows(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.limit_rows(rows.sort_rows(customer, "c_mktsegment", tie_break=["c_custkey"]), 100)


BINDINGS["limit_rows"] = (
    limit_rows,
    """SELECT c_custkey, c_name, c_mktsegment FROM customer
       ORDER BY c_mktsegment, c_custkey LIMIT 100""",
)


def string_ops(spark, d):
    dirty = dirty_customer(spark, d)
    return dirty.select(
        "id_code",
        strip(F.col("name_txt")).alias("stripped"),
        F.lower("segment").alias("lowered"),
        F.upper("segment").alias("uppered"),
        title_case(F.col("segment")).alias("titled"),
        F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$").alias("is_email"),
        F.regexp_replace("amount_txt", ",", "").alias("unmarked"),
    )


BINDINGS["string_ops"] = (
    string_ops,
    f"""WITH {DIRTY} SELECT id_code, trim(name_txt) AS stripped, lower(segment) AS lowered,
          upper(segment) AS uppered, upper(segment[1]) || lower(segment[2:]) AS titled,
          regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS is_email,
          replace(amount_txt, ',', '') AS unmarked
        FROM dirty""",
)


def math_ops(spark, d):
    return rounded(
        lines(spark, d).select(
            "l_orderkey",
            "l_linenumber",
            (F.col("revenue") - F.col("discount")).alias("net"),
            F.abs(F.col("l_quantity") - 25).alias("gap"),
            (F.col("l_quantity") % 1 == 0).alias("is_whole"),
            F.try_divide(F.col("discount"), F.col("revenue")).alias("rate"),
        ),
        "net", "rate", digits=4,
    )


BINDINGS["math_ops"] = (
    math_ops,
    """SELECT l_orderkey, l_linenumber,
              round(l_extendedprice - l_extendedprice * l_discount, 4) AS net,
              abs(l_quantity - 25) AS gap, l_quantity % 1 = 0 AS is_whole,
              round(l_extendedprice * l_discount / nullif(l_extendedprice, 0), 4) AS rate
       FROM lineitem""",
)


def case_ops(spark, d):
    q = F.col("l_quantity")
    ladder = F.when(q >= 40, "Bulk").when(q >= 20, "Medium").when(q >= 5, "Small").otherwise("Single")
    return table(spark, d, "lineitem").groupBy(ladder.alias("band")).agg(
        F.count(F.lit(1)).alias("rows")
    )


BINDINGS["case_ops"] = (
    case_ops,
    """SELECT CASE WHEN l_quantity >= 40 THEN 'Bulk' WHEN l_quantity >= 20 THEN 'Medium'
                   WHEN l_quantity >= 5 THEN 'Small' ELSE 'Single' END AS band,
              count(*) AS rows FROM lineitem GROUP BY 1""",
)
