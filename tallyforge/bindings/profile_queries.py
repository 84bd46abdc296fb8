"""Profiles of whole tables: every column of every row of the result is compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coerce import WHITESPACE
from ..operators import profile
from .common import DIRTY, NUMERIC_SQL, dirty_customer, rounded, table

BINDINGS = {}

DIRTY_KINDS = {c: "text" for c in ("id_code", "name_txt", "segment", "amount_txt", "join_date", "qty", "email")} | {"qty": "numeric"}

_ISO = r"\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?"
_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _number(v: str, marks: tuple[str, ...]) -> str:
    for mark in marks:
        v = f"replace({v}, '{mark}', '')"
    bare = f"trim({v}, '{WHITESPACE}')"
    return f"CASE WHEN {NUMERIC_SQL.format(x=bare)} THEN TRY_CAST({bare} AS double) END"


def _column(source: str, position: int, name: str, kind: str) -> str:
    """Everything a profile tells about one column, from all its cells."""
    is_text = "true" if kind == "text" else "false"
    if kind == "text":
        loose, num = _number("v", (",", "%", "$", "AED")), _number("v", (",", "%"))
        day = f"CASE WHEN regexp_full_match(s, '{_ISO}') THEN TRY_CAST(s AS timestamp) END"
    else:
        loose = num = f"CAST({name} AS double)" if kind == "numeric" else "CAST(NULL AS double)"
        day = f"CAST({name} AS timestamp)" if kind == "temporal" else "CAST(NULL AS timestamp)"
    return f"""SELECT {position} AS position, '{name}' AS col, '{kind}' AS kind, count(*) AS n_rows,
      count(v) AS non_null, count(DISTINCT v) AS nuniq,
      count(*) FILTER (WHERE low IN ('true','false','yes','no','y','n','0','1')) AS n_bool, count(DISTINCT low) AS lows,
      count(day) AS n_date, count(*) FILTER (WHERE day <> date_trunc('day', day)) AS n_timed,
      count(*) FILTER (WHERE {is_text} AND regexp_matches(s, '{_EMAIL}')) AS n_email,
      count(*) FILTER (WHERE {is_text} AND regexp_matches(s, '^https?://', 'i')) AS n_url,
      count(*) FILTER (WHERE {is_text} AND NOT regexp_matches(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND regexp_full_match(s, '[\\d\\s\\-\\+\\(\\)\\.]{{7,20}}')
                       AND length(regexp_replace(v, '\\D', '', 'g')) BETWEEN 7 AND 15) AS n_phone,
      count(loose) AS n_loose, count(*) FILTER (WHERE loose BETWEEN 0 AND 1) AS n_unit,
      count(*) FILTER (WHERE loose % 1 = 0) AS n_whole, max(loose) AS top, count(num) AS n_num,
      sum(num) AS sum, avg(num) AS average, median(num) AS median, min(num) AS min, max(num) AS max,
      coalesce(stddev_samp(num), CASE WHEN count(num) > 0 THEN 0 END) AS std,
      min(day) AS a, max(day) AS b, count(DISTINCT day) AS days, count(*) FILTER (WHERE s = '') AS n_blank,
      (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT CAST({name} AS varchar) AS v FROM {source}
       WHERE {name} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values
      FROM (SELECT *, {loose} AS loose, {num} AS num, {day} AS day, lower(s) AS low
            FROM (SELECT *, CAST({name} AS varchar) AS v, trim(CAST({name} AS varchar), '{WHITESPACE}') AS s FROM {source}))"""


def _named(pattern: str) -> str:
    return f"regexp_matches(col, '({pattern})', 'i')"


_ID = _named(r"^id$|_id$|uuid|sku|code|order.?id|customer.?id|emp|invoice.?no")
_MONEY = _named("amount|revenue|sales|price|cost|profit|margin|total|fee|salary|budget")
_DATED = _named("date|time|day|month|year|period|dob")
_PCT = _named("pct|percent|percentage|rate|ratio")
_NUMERIC = "(kind = 'numeric' OR n_loose > 0.8 * non_null)"
_DATE_SHARE = f"(kind = 'text' AND n_date > (CASE WHEN {_DATED} THEN 0.6 ELSE 0.75 END) * non_null)"
_FEW = "(nuniq <= 0.15 * non_null OR nuniq <= greatest(20, floor(non_null * 0.05)))"
_SURE = "0.7 + 0.25 * n_loose / non_null"
_DATE_SURE = "least(0.95, 0.6 + 0.35 * n_date / non_null)"

TYPE_LADDER = (
    ("non_null = 0", "unknown", "0.2"),
    ("kind = 'boolean'", "boolean", "0.95"),
    ("n_bool > 0.95 * non_null AND lows <= 4", "boolean", "0.85"),
    ("kind = 'temporal'", "datetime", "0.95"),
    (f"{_DATE_SHARE} AND n_timed > 0", "datetime", _DATE_SURE),
    (_DATE_SHARE, "date", _DATE_SURE),
    ("n_email > 0.7 * non_null", "email", "0.9"),
    ("n_url > 0.7 * non_null", "url", "0.9"),
    ("n_phone > 0.7 * non_null", "phone", "0.75"),
    (f"{_NUMERIC} AND {_ID}", "identifier", "0.88"),
    (f"{_NUMERIC} AND ({_PCT} OR (n_loose > 0 AND n_unit > 0.9 * n_loose AND top <= 1))", "percentage", "0.8"),
    (f"{_NUMERIC} AND {_MONEY}", "currency", "0.9"),
    (f"{_NUMERIC} AND n_whole > 0.98 * n_loose", "integer", _SURE),
    (f"{_NUMERIC} AND n_loose > 0", "decimal", _SURE),
    (_NUMERIC, "number", _SURE),
    (_ID, "identifier", "0.8"),
    (_FEW, "category", "0.82"),
    ("true", "text", "0.65"),
)

_MEASURE = _named("amount|revenue|sales|price|cost|profit|margin|total|qty|quantity|units|fee|discount|salary|budget|value")
_DIMENSION = _named(
    "region|country|city|category|product|customer|client|salesperson|employee|segment|channel|brand|store|location|market"
)
_MEASURED = f"(data_type IN ('number', 'integer', 'decimal', 'currency', 'percentage') OR {_MEASURE})"
_GROUPED = "Summarize, Compare, Charts"

ROLE_LADDER = (
    (f"data_type IN ('email', 'phone', 'url') OR {_named('email|phone|mobile|address|contact')}", "contact", "0.9",
     "Clean Data, Lookup / Match"),
    (f"data_type IN ('date', 'datetime') OR {_named('date|time|period|dob|timestamp')}", "date_dimension", "0.92",
     "Compare, Summarize, Charts, Dashboard"),
    (f"data_type = 'identifier' OR {_named('^id$|_id$|uuid|sku|code|order.?id|customer.?id|employee.?id|invoice|ref')}",
     "identifier", "0.9", "Lookup / Match, Find Duplicates"),
    (_named("status|state|stage|phase|flag"), "status", "0.8", _GROUPED),
    (f"{_MEASURED} AND data_type = 'integer' AND nuniq <= 20 AND NOT {_MEASURE}", "dimension", "0.6", _GROUPED),
    (_MEASURED, "measure", f"CASE WHEN {_MEASURE} THEN 0.88 ELSE 0.75 END", "Calculate, Compare, Summarize, Charts, Dashboard"),
    (f"data_type = 'category' OR {_DIMENSION}", "dimension", f"CASE WHEN {_DIMENSION} THEN 0.85 ELSE 0.7 END",
     "Summarize, Compare, Charts, Pivot Table"),
    ("data_type = 'boolean'", "status", "0.7", "Summarize, Filter"),
    ("n_rows > 0 AND nuniq < 0.2 * n_rows", "dimension", "0.65", "Summarize, Charts"),
    ("nuniq < greatest(50, n_rows * 0.3)", "dimension", "0.5", "Clean Data, Lookup / Match"),
    ("true", "text_attribute", "0.5", "Clean Data, Lookup / Match"),
)


def _ladder(rungs, at: int, quote: bool = True) -> str:
    values = (f"'{r[at]}'" if quote else r[at] for r in rungs)
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {v}" for r, v in zip(rungs, values)) + " END"


def described_sql(source: str, kinds: dict[str, str]) -> str:
    facts = "\nUNION ALL ".join(_column(source, i, c, kind) for i, (c, kind) in enumerate(kinds.items()))
    return f"""facts AS ({facts}),
       typed AS (SELECT *, {_ladder(TYPE_LADDER, 1)} AS data_type, CAST({_ladder(TYPE_LADDER, 2, False)} AS double) AS sure FROM facts),
       described AS (SELECT *, {_ladder(ROLE_LADDER, 1)} AS role, CAST({_ladder(ROLE_LADDER, 2, False)} AS double) AS role_confidence,
                            {_ladder(ROLE_LADDER, 3)} AS suggested_uses,
                            data_type IN ('number', 'integer', 'decimal', 'currency', 'percentage') OR kind = 'numeric' AS is_number
                     FROM typed),
       told AS (SELECT *, NOT is_number AND data_type IN ('date', 'datetime') AS is_date FROM described)"""


def profile_sql(source: str, kinds: dict[str, str], before: str = "") -> str:
    iso = "'%Y-%m-%dT%H:%M:%S'"
    other = "NOT is_number AND NOT is_date AND non_null > 0"
    return f"""WITH {before} {described_sql(source, kinds)}
       SELECT CAST(position AS integer) AS position, col AS "column", data_type, round(sure, 3) AS type_confidence, role,
         role_confidence, suggested_uses, non_null, n_rows - non_null AS null_count,
         round(100 * (n_rows - non_null) / n_rows, 2) AS null_pct, nuniq AS unique_count,
         CASE WHEN is_date THEN strftime(a, {iso}) END AS min_date, CASE WHEN is_date THEN strftime(b, {iso}) END AS max_date,
         CASE WHEN is_date THEN days END AS unique_dates,
         CAST(CASE WHEN is_date THEN date_diff('day', a, b) END AS integer) AS date_range_days,
         CASE WHEN {other} THEN n_blank END AS blank_like, CASE WHEN {other} THEN non_null - nuniq END AS duplicate_values,
         sample_values, {", ".join(f"CASE WHEN is_number AND n_num > 0 THEN round({c}, 3) END AS {c}" for c in ("sum", "average", "median", "min", "max", "std"))}
       FROM told"""


def profiled(df):
    return rounded(profile.profile_columns(df), "sum", "average", "median", "min", "max", "std", digits=3)


BINDINGS["profile_columns"] = (
    lambda spark, d: profiled(dirty_customer(spark, d)),
    profile_sql("dirty", DIRTY_KINDS, f"{DIRTY}, "),
)

BINDINGS["detect_roles"] = (
    lambda spark, d: profile.detect_roles(dirty_customer(spark, d)),
    f"""WITH {DIRTY}, {described_sql("dirty", DIRTY_KINDS)}
        SELECT col AS "column", data_type, role, role_confidence, suggested_uses FROM told""",
)

#: Whole tables and the kinds of their columns; orders with a flag and a column that is empty.
TABLES = {
    "orders": {
        "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "text", "o_totalprice": "numeric",
        "o_orderdate": "temporal", "o_orderpriority": "text", "is_large": "boolean", "remark": "text",
    },
    "events": {
        "event_id": "numeric", "ts": "temporal", "user_id": "numeric", "event_type": "text", "value": "numeric", "props": "text",
    },
    "lineitem": {
        "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
        "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
        "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "temporal",
    },
    "pages": {"page_id": "numeric", "url": "text", "html": "text"},
    "documents": {"doc_id": "numeric", "text": "text", "lang": "text", "source": "text", "n_chars": "numeric"},
}


def _whole(name: str, kinds: dict[str, str]):
    def run(spark, d):
        df = table(spark, d, name)
        if name == "orders":
            df = df.withColumns({"is_large": F.col("o_totalprice") > 100_000, "remark": F.lit(None).cast("string")})
        return profiled(df.select(*kinds))

    return run


_LARGE = "(SELECT *, o_totalprice > 100000 AS is_large, CAST(NULL AS varchar) AS remark FROM orders)"

for _name, _kinds in TABLES.items():
    BINDINGS[f"profile_{_name}"] = (_whole(_name, _kinds), profile_sql(_LARGE if _name == "orders" else _name, _kinds))
