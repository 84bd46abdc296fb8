"""Cleaning, profiling, types, roles, quality, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, duplicates, profile
from .common import DIRTY, NUMERIC_SQL, dirty_customer, number_sql

BINDINGS = {}

COLUMNS = ("id_code", "name_txt", "segment", "amount_txt", "join_date", "qty", "email")
TEXT = tuple(c for c in COLUMNS if c != "qty")


# Cleaning -----------------------------------------------------------------------
def _select(**changes: str) -> str:
    return ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in COLUMNS)


def _title_sql(column: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, length({column}) + 1), lambda i: CASE WHEN i = 1 OR"
        f" NOT regexp_matches({column}[i - 1], '[A-Za-z]') THEN upper({column}[i])"
        f" ELSE lower({column}[i]) END), '')"
    )


BINDINGS["clean_trim"] = (
    lambda spark, d: cleaning.clean(dirty_customer(spark, d), "trim_spaces"),
    f"WITH {DIRTY} SELECT {_select(**{c: f'trim({c})' for c in TEXT})} FROM dirty",
)

BINDINGS["clean_case_title"] = (
    lambda spark, d: cleaning.clean(dirty_customer(spark, d), "normalize_case"),
    f"""WITH {DIRTY} SELECT {
        _select(**{c: f"CASE WHEN {c} IS NOT NULL THEN {_title_sql(c)} END" for c in TEXT})
    } FROM dirty""",
)

BINDINGS["clean_case_upper"] = (
    lambda spark, d: cleaning.clean(dirty_customer(spark, d), "normalize_case", case_mode="upper"),
    f"WITH {DIRTY} SELECT {_select(**{c: f'upper({c})' for c in TEXT})} FROM dirty",
)

BINDINGS["clean_numbers"] = (
    lambda spark, d: cleaning.clean(dirty_customer(spark, d), "numbers_as_text"),
    f"WITH {DIRTY} SELECT {_select(amount_txt=number_sql('amount_txt'))} FROM dirty",
)


def _dates_as_text(df):
    return df.withColumn("join_date", F.date_format("join_date", "yyyy-MM-dd"))


_DATE = "strftime(TRY_CAST(join_date AS timestamp), '%Y-%m-%d')"

BINDINGS["clean_dates"] = (
    lambda spark, d: _dates_as_text(cleaning.clean(dirty_customer(spark, d), "fix_dates")),
    f"WITH {DIRTY} SELECT {_select(join_date=_DATE)} FROM dirty",
)

BINDINGS["clean_fill"] = (
    lambda spark, d: cleaning.clean(dirty_customer(spark, d), "fill_blanks"),
    f"""WITH {DIRTY} SELECT {_select(segment="coalesce(segment, 'Unknown')")} FROM dirty""",
)

BINDINGS["clean_drop_blanks"] = (
    lambda spark, d: cleaning.clean(dirty_customer(spark, d), "drop_blanks"),
    f"WITH {DIRTY} SELECT * FROM dirty WHERE segment IS NOT NULL",
)

BINDINGS["clean_duplicates"] = (
    lambda spark, d: duplicates.drop_duplicates(dirty_customer(spark, d)),
    f"WITH {DIRTY} SELECT DISTINCT * FROM dirty",
)

_TRIMMED = {c: _title_sql(f"trim({c})") for c in TEXT}
_ALL = _select(
    **{
        **_TRIMMED,
        "segment": f"CASE WHEN segment IS NULL THEN 'Unknown' ELSE {_TRIMMED['segment']} END",
        "amount_txt": f"coalesce({number_sql('amount_txt')}, 0)",
        "join_date": _DATE,
    }
)

BINDINGS["clean_all"] = (
    lambda spark, d: _dates_as_text(cleaning.clean(dirty_customer(spark, d))),
    f"""WITH {DIRTY}, cleaned AS (SELECT {_ALL} FROM dirty)
        SELECT DISTINCT * FROM cleaned WHERE join_date IS NOT NULL""",
)


BINDINGS["clean_log"] = (
    lambda spark, d: cleaning.clean_with_log(dirty_customer(spark, d))[1],
    f"""WITH {DIRTY}, cleaned AS (SELECT {_ALL} FROM dirty)
        SELECT (SELECT count(*) FROM dirty) AS rows_before,
               (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned WHERE join_date IS NOT NULL)) AS rows_after,
               (SELECT count(*) FROM dirty WHERE segment IS NULL) AS missing_before,
               CAST(0 AS bigint) AS missing_after,
               (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))
                 AS duplicate_rows_before,
               'amount_txt, join_date' AS retyped_columns""",
)

# Profiling ----------------------------------------------------------------------
_LOOSE = "trim(replace(replace(replace(replace({c}, ',', ''), '%', ''), '$', ''), 'AED', ''))"


def _facts(position: int, c: str) -> str:
    """Counts behind type detection for one column, all rows and whole texts."""
    v = f"CAST({c} AS varchar)"
    loose = _LOOSE.format(c=v)
    num = f"CASE WHEN {NUMERIC_SQL.format(x=loose)} THEN CAST({loose} AS double) END"
    kind = "numeric" if c == "qty" else "text"
    is_text = "true" if c != "qty" else "false"
    return f"""SELECT {position} AS position, '{c}' AS col, '{kind}' AS kind, count(*) AS n_rows,
      count(v) AS non_null, count(DISTINCT v) AS nuniq,
      count(*) FILTER (WHERE lower(trim(v)) IN ('true','false','yes','no','y','n','0','1')) AS n_bool,
      count(DISTINCT lower(trim(v))) AS lows,
      count(*) FILTER (WHERE {is_text} AND TRY_CAST(v AS timestamp) IS NOT NULL) AS n_date,
      count(*) FILTER (WHERE {is_text} AND regexp_matches(trim(v), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS n_email,
      count(*) FILTER (WHERE {is_text} AND regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS ok_email,
      count(num) AS n_num, count(*) FILTER (WHERE num BETWEEN 0 AND 1) AS n_unit,
      count(*) FILTER (WHERE num % 1 = 0) AS n_whole, max(num) AS top,
      count(*) FILTER (WHERE num < 0) AS n_neg,
      count(*) FILTER (WHERE {is_text} AND v <> trim(v)) AS n_spaced,
      count(*) FILTER (WHERE trim(v) = '') AS n_blank
      FROM (SELECT {v} AS v, {num} AS num FROM dirty)"""


FACTS = "facts AS (" + "\nUNION ALL ".join(_facts(i, c) for i, c in enumerate(COLUMNS)) + ")"

_ID = "regexp_matches(col, '(^id$|_id$|uuid|sku|code|order.?id|customer.?id|emp|invoice.?no)', 'i')"
_MONEY = (
    "regexp_matches(col, '(amount|revenue|sales|price|cost|profit|margin|total|fee|salary|budget)', 'i')"
)
_DATED = "regexp_matches(col, '(date|time|day|month|year|period|dob)', 'i')"
_NUMERIC = "(kind = 'numeric' OR n_num > 0.8 * non_null)"
_FEW = "(nuniq <= 0.15 * non_null OR nuniq <= greatest(20, floor(non_null * 0.05)))"

TYPES = f"""typed AS (SELECT *,
   CASE WHEN non_null = 0 THEN 'unknown' WHEN n_bool > 0.95 * non_null AND lows <= 4 THEN 'boolean'
        WHEN kind = 'text' AND n_date > (CASE WHEN {_DATED} THEN 0.6 ELSE 0.75 END) * non_null THEN 'date'
        WHEN n_email > 0.7 * non_null THEN 'email'
        WHEN {_NUMERIC} AND {_ID} THEN 'identifier'
        WHEN {_NUMERIC} AND n_unit > 0.9 * n_num AND top <= 1 THEN 'percentage'
        WHEN {_NUMERIC} AND {_MONEY} THEN 'currency'
        WHEN {_NUMERIC} AND n_whole > 0.98 * n_num THEN 'integer' WHEN {_NUMERIC} THEN 'decimal'
        WHEN {_ID} THEN 'identifier' WHEN {_FEW} THEN 'category' ELSE 'text' END AS data_type FROM facts),
 sure AS (SELECT *,
   CASE data_type WHEN 'unknown' THEN 0.2 WHEN 'boolean' THEN 0.85
        WHEN 'date' THEN least(0.95, 0.6 + 0.35 * n_date / non_null) WHEN 'email' THEN 0.9
        WHEN 'percentage' THEN 0.8 WHEN 'currency' THEN 0.9
        WHEN 'identifier' THEN CASE WHEN {_NUMERIC} THEN 0.88 ELSE 0.8 END
        WHEN 'integer' THEN 0.7 + 0.25 * n_num / non_null
        WHEN 'decimal' THEN 0.7 + 0.25 * n_num / non_null
        WHEN 'category' THEN 0.82 ELSE 0.65 END AS conf FROM typed),
 roles AS (SELECT *,
   CASE WHEN data_type IN ('email', 'phone', 'url') OR regexp_matches(col, '(email|phone|mobile|address|contact)') THEN 'contact'
        WHEN data_type IN ('date', 'datetime') OR regexp_matches(col, '(date|time|period|dob|timestamp)') THEN 'date_dimension'
        WHEN data_type = 'identifier' OR regexp_matches(col, '(^id$|_id$|uuid|sku|code|invoice|ref)') THEN 'identifier'
        WHEN regexp_matches(col, '(status|state|stage|phase|flag)') THEN 'status'
        WHEN data_type IN ('currency', 'integer', 'decimal', 'percentage')
             OR regexp_matches(col, '(amount|price|cost|total|qty|quantity|units|value)') THEN 'measure'
        WHEN data_type = 'category' OR regexp_matches(col, '(region|segment|category|product)') THEN 'dimension'
        WHEN data_type = 'boolean' THEN 'status'
        WHEN nuniq < 0.2 * n_rows OR nuniq < greatest(50, n_rows * 0.3) THEN 'dimension'
        ELSE 'text_attribute' END AS role FROM sure)"""

DESCRIBED = f"WITH {DIRTY}, {FACTS}, {TYPES}"

BINDINGS["detect_types"] = (
    lambda spark, d: profile.detect_types(dirty_customer(spark, d)),
    f"""{DESCRIBED} SELECT col AS "column", data_type, round(CAST(conf AS double), 3) AS type_confidence
        FROM sure""",
)

BINDINGS["semantic_model"] = (
    lambda spark, d: profile.semantic_model(dirty_customer(spark, d)),
    f"""{DESCRIBED}
        SELECT 'measures' AS list, col AS "column" FROM roles
          WHERE role = 'measure' OR data_type IN ('currency', 'number', 'integer', 'decimal', 'percentage')
        UNION ALL SELECT 'dimensions', col FROM roles
          WHERE role IN ('dimension', 'status') OR data_type = 'category'
        UNION ALL SELECT 'dates', col FROM roles WHERE role = 'date_dimension' OR data_type IN ('date', 'datetime')
        UNION ALL SELECT 'identifiers', col FROM roles WHERE role = 'identifier' OR data_type = 'identifier'
        UNION ALL SELECT 'contacts', col FROM roles WHERE role = 'contact' OR data_type IN ('email', 'phone')""",
)


def _counted(c: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST({c} AS varchar) AS value, count(*) AS count
       FROM dirty WHERE {c} IS NOT NULL GROUP BY 2"""


BINDINGS["top_values"] = (
    lambda spark, d: profile.top_values(dirty_customer(spark, d)),
    f"""WITH {DIRTY}, vc AS ({" UNION ALL ".join(_counted(c) for c in COLUMNS)}),
       r AS (SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS integer)
                    AS rank, value, count FROM vc)
       SELECT * FROM r WHERE rank <= 5""",
)

BINDINGS["missing_summary"] = (
    lambda spark, d: profile.missing_summary(dirty_customer(spark, d)),
    f"""WITH {DIRTY} SELECT 'segment' AS "column", count(*) AS missing,
          round(100 * count(*) / (SELECT count(*) FROM dirty), 2) AS pct
        FROM dirty WHERE segment IS NULL""",
)

_REPEATS = "(SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))"

ISSUES = f"""issues AS (
   SELECT CASE WHEN n_rows - non_null < 0.1 * n_rows THEN 'warning' ELSE 'high' END AS severity,
          'missing' AS category, 'missing' AS issue, col AS "column", n_rows - non_null AS count FROM roles
   UNION ALL SELECT 'high', 'duplicate', 'duplicate_identifier', col, non_null - nuniq FROM roles
     WHERE role = 'identifier' OR data_type = 'identifier'
   UNION ALL SELECT 'info', 'formatting', 'spaces', col, n_spaced FROM roles
   UNION ALL SELECT 'info', 'formatting', 'numeric_text', col, n_num FROM roles
     WHERE kind = 'text' AND n_num > 0.85 * non_null
   UNION ALL SELECT 'warning', 'validity', 'invalid_email', col, non_null - ok_email FROM roles
     WHERE data_type = 'email'
   UNION ALL SELECT 'warning', 'validity', 'negative_quantity', col, n_neg FROM roles
     WHERE role = 'measure' AND regexp_matches(col, '(qty|quantity|units)')
   UNION ALL SELECT 'warning', 'consistency', 'capitalization', 'segment', count(*) FROM
     (SELECT lower(segment) FROM dirty WHERE segment IS NOT NULL GROUP BY 1 HAVING count(DISTINCT segment) > 1)
   UNION ALL SELECT 'warning', 'duplicate', 'duplicate_rows', NULL, {_REPEATS}),
 found AS (SELECT * FROM issues WHERE count > 0)"""

BINDINGS["quality_issues"] = (
    lambda spark, d: profile.quality_issues(dirty_customer(spark, d)),
    f"{DESCRIBED}, {ISSUES} SELECT * FROM found",
)

BINDINGS["health_score"] = (
    lambda spark, d: profile.health_score(dirty_customer(spark, d)),
    f"""{DESCRIBED}, {ISSUES},
       parts AS (SELECT 100 * (1 - (SELECT sum(n_rows - non_null) FROM roles) / (SELECT sum(n_rows) FROM roles)) AS a,
         greatest(0, 100 - 8.0 * (SELECT count(*) FROM found WHERE category = 'validity' OR severity = 'high')) AS b,
         greatest(0, 100 * (1 - least(1, 2 * ({_REPEATS}) / (SELECT count(*) FROM dirty)))) AS c,
         greatest(0, 100 - 5.0 * (SELECT count(*) FROM found WHERE category IN ('consistency', 'formatting'))) AS e,
         100 * (SELECT avg(conf) FROM roles) AS f)
       SELECT CAST(round_even(0.30 * a + 0.20 * b + 0.20 * c + 0.15 * e + 0.15 * f, 0) AS integer) AS score,
         round(CAST(a AS double), 1) AS completeness, round(CAST(b AS double), 1) AS validity,
         round(CAST(c AS double), 1) AS uniqueness, round(CAST(e AS double), 1) AS consistency,
         round(CAST(f AS double), 1) AS type_confidence FROM parts""",
)

BINDINGS["detect_issues"] = (
    lambda spark, d: profile.detect_issues(dirty_customer(spark, d)),
    f"""WITH {DIRTY}, {FACTS}
        SELECT 'missing' AS issue, col AS "column", n_rows - non_null AS count,
               round(100 * (n_rows - non_null) / n_rows, 1) AS pct FROM facts WHERE n_rows > non_null
        UNION ALL SELECT 'spaces', col, n_spaced, round(100 * n_spaced / non_null, 1) FROM facts WHERE n_spaced > 0
        UNION ALL SELECT 'numeric_text', col, n_num, round(100 * n_num / non_null, 1) FROM facts
          WHERE kind = 'text' AND n_num > 0.8 * non_null
        UNION ALL SELECT 'duplicate_rows', NULL, {_REPEATS},
          round(100 * ({_REPEATS}) / (SELECT count(*) FROM dirty), 1)""",
)

BINDINGS["find_problems"] = (
    lambda spark, d: profile.find_problems(dirty_customer(spark, d), "qty"),
    f"""WITH {DIRTY},
       q AS (SELECT quantile_cont(qty, 0.25) AS a, quantile_cont(qty, 0.75) AS b FROM dirty),
       p AS (SELECT 'duplicate_rows' AS issue, CAST(NULL AS varchar) AS "column",
               CAST((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM dirty GROUP BY id_code, name_txt, segment, amount_txt, join_date, qty, email HAVING count(*) > 1))
                    AS bigint) AS count
             UNION ALL SELECT 'missing', 'segment', count(*) FROM dirty WHERE segment IS NULL
             UNION ALL SELECT 'outlier', 'qty', count(*) FROM dirty, q
               WHERE qty < a - 1.5 * (b - a) OR qty > b + 1.5 * (b - a))
       SELECT * FROM p WHERE count > 0""",
)
