"""Lookups, reconciliation, matching, duplicates, relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplicates, joins, relationships
from .common import table

BINDINGS = {}


def xlookup(spark, d):
    return joins.xlookup(table(spark, d, "part"), "brand#7", "p_brand", "p_name").select(
        "p_partkey", "p_brand", "p_name"
    )


BINDINGS["xlookup"] = (
    xlookup,
    "SELECT p_partkey, p_brand, p_name FROM part WHERE lower(trim(p_brand)) = 'brand#7'",
)

BINDINGS["xlookup_first"] = (
    lambda spark, d: joins.xlookup_first(
        table(spark, d, "nation"), "nation_1", "n_name", "n_nationkey", False, "n_nationkey"
    ),
    """SELECT count(*) AS matches, arg_min(n_nationkey, n_nationkey) AS first_value
       FROM nation WHERE regexp_matches(n_name, 'nation_1', 'i')""",
)


def lookup_join(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return joins.lookup_join(
        customer, table(spark, d, "nation"), "c_nationkey", ["n_name", "n_regionkey"], "n_nationkey",
    )


BINDINGS["lookup_join"] = (
    lookup_join,
    """SELECT c_custkey, c_nationkey, n_name, n_regionkey
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)


def lookup_join_first(spark, d):
    """Many order lines per order: only the first by line number is looked up."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return joins.lookup_join(
        orders, table(spark, d, "lineitem"), "o_orderkey", ["l_partkey", "l_quantity"], "l_orderkey",
        ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    )


BINDINGS["lookup_join_first"] = (
    lookup_join_first,
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
                  FROM lineitem)
       SELECT o_orderkey, o_orderstatus, l_partkey, l_quantity
       FROM orders LEFT JOIN r ON o_orderkey = l_orderkey AND rn = 1""",
)


def _order_keys(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ordered = table(spark, d, "lineitem").select("l_orderkey").distinct()
    return orders, ordered


def reconcile_orders(spark, d):
    return joins.reconcile(*_order_keys(spark, d), "o_orderkey", "l_orderkey")


BINDINGS["reconcile_orders"] = (
    reconcile_orders,
    """SELECT o_orderkey, o_custkey, l_orderkey,
              CASE WHEN l_orderkey IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only'
                   ELSE 'both' END AS _merge
       FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey""",
)

BINDINGS["reconcile_counts"] = (
    lambda spark, d: joins.reconcile_counts(
        table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey"
    ),
    """SELECT count(*) FILTER (WHERE o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL) AS "both",
              count(*) FILTER (WHERE l_orderkey IS NULL) AS left_only,
              count(*) FILTER (WHERE o_orderkey IS NULL) AS right_only,
              count(*) FILTER (WHERE o_orderkey IS NULL OR l_orderkey IS NULL) AS unmatched
       FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey""",
)


def match_only(spark, d):
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation_id"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    return joins.match_datasets(supplier, nation, "nation_id")


BINDINGS["match_only"] = (
    match_only,
    """SELECT s_suppkey, s_nationkey AS nation_id, n_nationkey AS id, n_name
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)


def match_non(spark, d):
    orders, ordered = _order_keys(spark, d)
    return joins.match_datasets(orders, ordered, "o_orderkey", "non_matching", "l_orderkey")


BINDINGS["match_non"] = (
    match_non,
    """SELECT o_orderkey, o_custkey, l_orderkey,
              CASE WHEN l_orderkey IS NULL THEN 'left_only' ELSE 'right_only' END AS _merge
       FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey
       WHERE o_orderkey IS NULL OR l_orderkey IS NULL""",
)

BINDINGS["unmatched"] = (
    lambda spark, d: joins.find_unmatched(
        table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey"
    ).select("o_orderkey", "o_totalprice"),
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)


def match_normalized(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    shouted = customer.groupBy(
        F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("\t")).alias("segment")
    ).agg(F.count(F.lit(1)).alias("members"))
    return joins.match_normalized(customer, shouted, "c_mktsegment", "segment")


BINDINGS["match_normalized"] = (
    match_normalized,
    """SELECT c_custkey, c_mktsegment, concat(' ', segment, chr(9)) AS segment, members, 'both' AS _merge FROM customer
       JOIN (SELECT lower(c_mktsegment) AS segment, count(*) AS members FROM customer GROUP BY 1)
         ON lower(trim(c_mktsegment)) = segment""",
)

BINDINGS["dup_rows"] = (
    lambda spark, d: duplicates.find_duplicates(
        table(spark, d, "orders"), ["o_custkey", "o_orderdate"]
    ).select("o_orderkey", "o_custkey"),
    """SELECT o_orderkey, o_custkey FROM
         (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders) WHERE n > 1""",
)

BINDINGS["dup_any"] = (
    lambda spark, d: duplicates.find_duplicates(
        table(spark, d, "events"), ["event_id", "value"], "any"
    ).select("event_id", "value"),
    """SELECT event_id, value FROM
         (SELECT *, count(*) OVER (PARTITION BY event_id) AS a,
                 count(*) OVER (PARTITION BY value) AS b FROM events) WHERE a > 1 OR b > 1""",
)

#: Every column of every table, without the letter that the tables put before their columns.
RELATED = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "region": ("r_regionkey", "r_name"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "labels": ("doc_id", "quality", "toxic"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


def _speaking(column: str) -> str:
    return column[2:] if column[1] == "_" else column


def related(spark, d):
    tables = []
    for name, columns in RELATED.items():
        df = table(spark, d, name)
        tables.append((name, df.select(*[F.col(c).alias(_speaking(c)) for c in columns])))
    return relationships.detect_relationships(tables)


_VALUES = "\nUNION ALL ".join(
    f"SELECT DISTINCT {i} AS pos, '{t}' AS t, '{_speaking(c)}' AS c, CAST({c} AS varchar) AS v FROM {t}"
    for i, (t, columns) in enumerate(RELATED.items())
    for c in columns
)

_KEYS = "['id', 'code', 'sku']"

BINDINGS["relationships"] = (
    related,
    f"""WITH vals AS ({_VALUES}),
       sizes AS (SELECT pos, t, c, count(*) AS n, string_split(c, '_') AS w FROM vals GROUP BY 1, 2, 3),
       common AS (SELECT a.t AS lt, a.c AS lc, b.t AS rt, b.c AS rc, count(*) AS n
                  FROM vals a JOIN vals b ON a.v = b.v AND a.pos < b.pos GROUP BY 1, 2, 3, 4),
       pairs AS (SELECT a.t AS lt, a.c AS lc, b.t AS rt, b.c AS rc,
                   CASE WHEN a.c = b.c THEN 0.55
                        WHEN NOT ((list_has_all(a.w, b.w) AND len(list_filter(b.w, lambda x: NOT list_contains({_KEYS}, x))) > 0)
                               OR (list_has_all(b.w, a.w) AND len(list_filter(a.w, lambda x: NOT list_contains({_KEYS}, x))) > 0)) THEN 0.0
                        WHEN list_contains({_KEYS}, a.w[-1]) AND list_contains({_KEYS}, b.w[-1]) THEN 0.4 ELSE 0.35 END AS name_score,
                   CASE WHEN list_has_any(a.w, {_KEYS}) OR list_has_any(b.w, {_KEYS}) THEN 0.1 ELSE 0.0 END AS boost,
                   coalesce(m.n, 0) / least(a.n, b.n) AS overlap
                 FROM sizes a JOIN sizes b ON a.pos < b.pos
                 LEFT JOIN common m ON m.lt = a.t AND m.lc = a.c AND m.rt = b.t AND m.rc = b.c),
       scored AS (SELECT *, CASE WHEN overlap < 0.05 AND name_score < 0.5 THEN 0.0
                    ELSE least(1.0, CAST(name_score AS double) + CAST(0.55 AS double) * overlap
                                    + CAST(boost AS double)) END AS score FROM pairs)
       SELECT lt AS left_table, lc AS left_column, rt AS right_table, rc AS right_column,
              CAST(round_even(score * 100, 0) AS integer) AS confidence, 'suggested' AS status
       FROM scored WHERE score >= 0.7""",
)
