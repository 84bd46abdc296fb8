"""Column profiles, types, roles, quality issues and a health score.

A profile takes two passes. The first counts, per column, what can be told from each cell
by itself (short texts by value, each tested once), brackets the medians, and takes the
smallest values of a few buckets, which bound the first values in text order. The second counts distinct values: cells are combined
by value before the shuffle, and long texts travel as digests. Nothing is stored.

What comes back has one row for each column of the table, which the driver holds. The
functions below that take a table run these jobs while their plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import clean_number, parse_date, parse_number, strip, to_date, to_number, without
from ..functions.columns import (
    data_type,
    is_boolean,
    is_numeric,
    is_string,
    is_temporal,
    numeric_columns,
    ref,
    require_columns,
)
from .duplicates import duplicate_row_count, repeated_keys
from .ordered import MARGIN, RESIDUE, SKETCH, Bracket, narrowed
from .outliers import outliers

# Patterns on values ------------------------------------------------
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"^[\d\s\-\+\(\)\.]{7,20}$"
URL = r"(?i)^https?://"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "0", "1")
NUMBER_MARKS = (",", "%", "$", "AED")

# Patterns on column names, for types ---------------------------------
TYPE_NAMES = {
    "id": r"(?i)(^id$|_id$|uuid|sku|code|order.?id|customer.?id|emp|invoice.?no)",
    "date": r"(?i)(date|time|day|month|year|period|dob)",
    "money": r"(?i)(amount|revenue|sales|price|cost|profit|margin|total|fee|salary|budget)",
    "pct": r"(?i)(pct|percent|percentage|rate|ratio)",
}

# Patterns on column names, for roles ---------------------------------
ROLE_NAMES = {
    "contact": r"(?i)(email|phone|mobile|address|contact)",
    "date": r"(?i)(date|time|period|dob|timestamp)",
    "id": r"(?i)(^id$|_id$|uuid|sku|code|order.?id|customer.?id|employee.?id|invoice|ref)",
    "status": r"(?i)(status|state|stage|phase|flag)",
    "measure": (
        r"(?i)(amount|revenue|sales|price|cost|profit|margin|total|qty|quantity|units|fee"
        r"|discount|salary|budget|value)"
    ),
    "dimension": (
        r"(?i)(region|country|city|category|product|customer|client|salesperson|employee"
        r"|segment|channel|brand|store|location|market)"
    ),
    "quantity": r"(?i)(qty|quantity|units)",
}

NUMERIC_TYPES = ("number", "integer", "decimal", "currency", "percentage")
DATE_TYPES = ("date", "datetime")



def _kind(df: DataFrame, name: str) -> str:
    if is_boolean(df, name):
        return "boolean"
    if is_temporal(df, name):
        return "temporal"
    if is_numeric(df, name):
        return "numeric"
    return "text" if is_string(df, name) else "other"


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count) with values as text; NULL is counted like a value.

    Counting starts before the shuffle, which then carries distinct values only.
    """
    names = list(columns) if columns is not None else df.columns
    require_columns(df, names)
    texts = df.select(*[clean_number(df, c).cast("string").alias(c) for c in names])
    long = texts.unpivot([], [ref(c) for c in names], "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


#: Buckets of values by hash whose smallest members are kept, and how many sample values a profile shows.
BUCKETS, SAMPLES = 6, 5

#: Texts of more code points are counted by a digest of 128 bits and their length.
LONG_TEXT = 64

#: What the first pass counts in some columns.
PLAIN_COUNTS = (
    "non_null", "n_boolean", "n_date", "n_timed", "n_email", "n_valid_email", "n_url", "n_phone", "n_loose", "n_unit", "n_whole", "n_number",
    "n_plain", "n_negative", "blank_like", "n_spaced", "n_long",
)

#: Numbers of cells that are counted apart from the column's own: days of dates, and values without case and blanks.
DAY_CELLS, LOW_CELLS = 1_000_000, 2_000_000


#: Columns that one aggregate of the first pass takes, each column by one. Spark compiles the code of some columns well, and
#: runs that of very many several times slower.
ABREAST = 4

#: Values of numbers and dates are looked at for the bound of the first ones if their hash says so, one of so many.
SHOWN = 8

#: The first characters of a text that may be a number under ``NUMBER_MARKS``.
NUMBER_HEADS = "0123456789+-.,%$A"


def _text(df: DataFrame, name: str) -> Column:
    return clean_number(df, name).cast("string")


def _is_wordy(df: DataFrame, name: str) -> bool:
    """Whether all that is known of a cell is its text."""
    return _kind(df, name) in ("text", "other")


def _smallest(value: Column, text: Column, of: int) -> Column:
    bucket = F.pmod(F.hash(value), F.lit(BUCKETS * of))
    return F.array(*[F.min(F.when(bucket == b, text)) for b in range(BUCKETS)])


def _number_facts(num: Column) -> dict[str, Column]:
    edges = F.array(F.lit(0.5 - MARGIN), F.lit(0.5 + MARGIN))
    return {
        "sum": F.sum(num),
        "average": F.avg(num),
        "min": F.min(num),
        "max": F.max(num),
        "std": F.stddev_samp(num),
        "edges": F.percentile_approx(num, edges, SKETCH),
    }


def _day_facts(day: Column, count) -> dict[str, Column]:
    """Dates carry their number of days, as texts of years alone do not tell which comes first."""
    ends = {}
    for name, end in (("min_date", F.min(day)), ("max_date", F.max(day))):
        at = F.struct(F.unix_date(end.cast("date")).alias("day"), F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss").alias("text"))
        ends[name] = F.when(end.isNotNull(), at)
    return {"n_date": count(day.isNotNull()), "n_timed": count(day != F.date_trunc("day", day).cast("timestamp_ntz"))} | ends


def _typed_facts(df: DataFrame, name: str) -> dict[str, Column]:
    """The facts about a column of numbers, dates or truth values. What Spark prints for these has no blanks around it
    and is no address, so that only its own tests are left."""
    kind, value = _kind(df, name), clean_number(df, name)
    facts = {"rows": F.count("*"), "non_null": F.count(value), "smallest": _smallest(value, _text(df, name), SHOWN)}
    if kind == "boolean":
        return facts | {"n_boolean": F.count(value)}
    if kind == "temporal":
        return facts | _day_facts(ref(name).cast("timestamp_ntz"), F.count_if)
    # Only whole types print a bare 0 or 1.
    whole = isinstance(data_type(df, name), T.IntegralType) or getattr(data_type(df, name), "scale", 1) == 0
    num = value.cast("double")
    return facts | _number_facts(num) | {
        "n_boolean": F.count_if(value.isin(0, 1)) if whole else F.lit(0),
        "n_loose": F.count(num),
        "n_unit": F.count_if(num.between(0, 1)),
        "n_whole": F.count_if(num % 1 == 0),
        "loose_max": F.max(num),
        "n_negative": F.count_if(num < 0),
    }


def _word_facts(v: Column, is_text: Column, count, formats: Sequence[str] | None) -> dict[str, Column]:
    """The facts that texts tell; ``count`` counts the rows for which a test holds."""
    s = strip(v)
    maybe = is_text & (F.instr(F.lit(NUMBER_HEADS), F.substring(s, 1, 1)) > 0)
    loose, num, plain, strict = (
        F.when(maybe, parse_number(without(v, marks))) for marks in (NUMBER_MARKS, (",", "%"), (",",), ())
    )
    low = F.lower(s)
    boolean, address = low.isin(*BOOLEAN_WORDS), is_text & F.contains(v, F.lit("@"))
    digits = F.length(F.regexp_replace(v, r"\D", ""))
    return _day_facts(F.when(is_text, parse_date(v, formats)), count) | {
        "non_null": count(v.isNotNull()),
        "n_boolean": count(boolean),
        "words": F.collect_set(F.when(boolean, low)),
        "n_email": count(address & s.rlike(EMAIL)),
        "n_valid_email": count(address & v.rlike(EMAIL)),
        "n_url": count(is_text & s.rlike(URL)),
        "n_phone": count(is_text & s.rlike(PHONE) & ~s.rlike(ISO_DATE) & digits.between(7, 15)),
        "n_loose": count(loose.isNotNull()),
        "n_unit": count(loose.between(0, 1)),
        "n_whole": count(loose % 1 == 0),
        "loose_max": F.max(loose),
        "n_number": count(num.isNotNull()),
        "n_plain": count(plain.isNotNull()),
        "n_negative": count(strict < 0),
        "blank_like": count(s == ""),
        "n_spaced": count(v != s),
        "smallest": _smallest(v, v, 1),
    }


def _long(v: Column) -> Column:
    return F.when(F.length(v) > LONG_TEXT, v)


def _abreast(df: DataFrame, facts: dict[int, dict[str, Column]]) -> dict[int, dict]:
    """The facts of each column, from one row of aggregates for some columns at a time."""
    found, positions = {}, list(facts)
    for start in range(0, len(positions), ABREAST):
        some = positions[start : start + ABREAST]
        row = df.agg(*[F.struct(*[c.alias(n) for n, c in facts[i].items()]).alias(f"c{i}") for i in some]).first()
        found |= {i: row[f"c{i}"].asDict() for i in some}
    return found


def _short_word_facts(df: DataFrame, wordy: Sequence[int], formats: Sequence[str] | None) -> dict[int, dict]:
    """The facts of texts up to ``LONG_TEXT``: equal ones are counted first, and each is then tested once."""
    if not wordy:
        return {}
    names = [df.columns[i] for i in wordy]
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(is_string(df, c)).alias("textual"), _text(df, c).alias("text")) for i, c in zip(wordy, names)
    ]
    short = df.select(F.inline(F.array(*cells))).filter(F.length("text") <= LONG_TEXT)
    groups = short.groupBy("position", "textual", "text").agg(F.count("*").alias("n"))
    n = F.col("n")

    def count(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    facts = _word_facts(F.col("text"), F.col("textual"), count, formats)
    found = groups.groupBy("position").agg(*[c.alias(name) for name, c in facts.items()]).collect()
    return {r.position: r.asDict() for r in found}


def _merged(a: dict, b: dict) -> dict:
    """The facts of two parts of a column's values."""
    out = a | {k: v for k, v in b.items() if a.get(k) is None}
    for k in a.keys() & b.keys():
        if a[k] is None or b[k] is None:
            continue
        if k in ("smallest", "words"):
            out[k] = [*a[k], *b[k]]
        elif k in ("loose_max", "max_date"):
            out[k] = max(a[k], b[k])
        else:
            out[k] = min(a[k], b[k]) if k == "min_date" else a[k] + b[k]
    return out


def _plain_facts(df: DataFrame, formats: Sequence[str] | None) -> list[Row]:
    """What the first pass tells, one row per column that has a row.

    Typed columns and long texts are told row by row, short texts once for each value. Columns of text that hold
    numbers are read once more for their figures.
    """
    wordy = [i for i, c in enumerate(df.columns) if _is_wordy(df, c)]
    long = {i: _long(_text(df, df.columns[i])) for i in wordy}
    sizes = {i: {"rows": F.count("*"), "n_long": F.count(v)} for i, v in long.items()}
    found = _abreast(df, {i: sizes[i] if i in sizes else _typed_facts(df, c) for i, c in enumerate(df.columns)})
    if not found or not found[0]["rows"]:
        return []
    tests = {i: _word_facts(v, F.lit(is_string(df, df.columns[i])), F.count_if, formats) for i, v in long.items() if found[i]["n_long"]}
    for i, told in _abreast(df, tests).items():
        found[i] |= told
    for i, short in _short_word_facts(df, wordy, formats).items():
        found[i] = _merged(found[i], short)
    numbers = {i: _number_facts(to_number(df, df.columns[i], (",", "%"))) for i in wordy if found[i].get("n_number")}
    for i, figures in _abreast(df, numbers).items():
        found[i] |= figures
    return [_plain_row(i, found[i]) for i in range(len(df.columns))]


def _plain_row(position: int, found: dict) -> Row:
    empty = dict.fromkeys(PLAIN_COUNTS, 0) | dict.fromkeys(("loose_max", "sum", "average", "min", "max", "std", "edges"))
    row = empty | {"words": [], "smallest": []} | found | {"position": position}
    first, last = found.get("min_date"), found.get("max_date")
    row |= {"min_date": first and first["text"], "max_date": last and last["text"], "date_range_days": first and last["day"] - first["day"]}
    if "n_plain" not in found:  # a typed column reads as a number in one way only
        row |= dict.fromkeys(("n_number", "n_plain"), row["n_loose"])
    return Row(**row)


def _digest(text: Column) -> Column:
    """A text itself, or for a long one its length and 128 bits of it."""
    halves = (F.hex(F.xxhash64(text)), F.hex(F.xxhash64(text, F.lit(1))))
    return F.when(F.length(text) > LONG_TEXT, F.concat_ws(":", F.length(text).cast("string"), *halves)).otherwise(text)


def _median_brackets(df: DataFrame, plain: Sequence[Row]) -> dict[int, Bracket]:
    """A bracket of each numeric column's median; passes over ``df`` narrow those that hold very many values."""
    brackets = {
        r.position: Bracket(*r.edges, r.n_number * 2 * (MARGIN + 1 / SKETCH)) for r in plain if r.n_number
    }
    n = {r.position: r.n_number for r in plain}
    while wide := {p: b for p, b in brackets.items() if b.high > b.low and b.inside > RESIDUE}:
        columns = {f"v{p}": to_number(df, df.columns[p], (",", "%")) for p in wide}
        numbers = df.select(*[c.alias(o) for o, c in columns.items()])
        open_ = {f"v{p}": (F.col(f"v{p}"), b, (n[p] - 1) // 2, n[p] // 2) for p, b in wide.items()}
        brackets |= {int(o[1:]): b for o, b in narrowed(numbers, open_).items()}
    return brackets


def _distinct_cells(df: DataFrame, plain: Sequence[Row], formats: Sequence[str] | None) -> DataFrame:
    """(position, value) of each cell. Where a table has long texts, what has to be known of these comes with their
    digests; it follows from the text, so it makes no further groups."""
    some_long = any(r.n_long for r in plain)
    cells = []
    for r in plain:
        name = df.columns[r.position]
        text = _text(df, name)
        fields = {"position": F.lit(r.position), "value": _digest(text) if r.n_long else text}
        if some_long:
            long = _long(text) if r.n_long else F.lit(None).cast("string")
            is_text = is_string(df, name) and r.n_long
            fields |= {
                "long": long.isNotNull(),
                "long_lower": _digest(F.lower(long)) if is_text else F.lit(None).cast("string"),
                "long_low": _digest(F.lower(strip(long))) if _has_lows(r) else F.lit(None).cast("string"),
                "long_day": parse_date(long, formats) if is_text and r.n_date else F.lit(None).cast("timestamp_ntz"),
                "long_num": parse_number(without(long, (",", "%"))) if is_text and r.n_number else F.lit(None).cast("double"),
                "long_sample": F.when(long <= _bound(r), long) if _bound(r) is not None else long,
            }
        cells.append(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


def _bound(r: Row) -> str | None:
    """A text that the first values in text order do not exceed."""
    first = sorted({v for v in r.smallest if v is not None})
    return first[SAMPLES - 1] if len(first) >= SAMPLES else None


def _has_lows(r: Row) -> bool:
    """Whether a column nearly holds truth values only, while some are other texts."""
    return r.non_null > r.n_boolean > 0.95 * r.non_null


def _distinct_facts(df: DataFrame, plain: Sequence[Row], formats: Sequence[str] | None) -> DataFrame:
    """What the second pass tells: (position, unique_count, n_case, sample_values, median)."""
    brackets = _median_brackets(df, plain)
    facts = []
    for r in plain:
        name, bracket = df.columns[r.position], brackets.get(r.position)
        ends = (bracket.low, bracket.high) if bracket else (None, None)
        textual = is_string(df, name)
        dated = textual and r.n_date > 0
        facts.append((r.position, textual, dated, _has_lows(r), data_type(df, name).typeName() == "float", _bound(r), *ends))
    spark = df.sparkSession
    # One row per column of the table.
    kinds = "position int, textual boolean, dated boolean, lows boolean, single boolean, bound string, low double, high double"
    facts = F.broadcast(spark.createDataFrame(facts, kinds))
    cells = _distinct_cells(df, plain, formats)
    groups = cells.groupBy(*cells.columns).agg(F.count("*").alias("n")).join(facts, "position")
    value, bound = F.col("value"), F.col("bound")

    def told(column: Column, of_long: str) -> Column:
        """What follows from a short text, and from a long one came with its digest."""
        return F.when(F.col("long"), F.col(of_long)).otherwise(column) if "long" in cells.columns else column

    def when(test: str, column: Column, of_long: str) -> Column:
        return F.when(F.col(test), told(column, of_long))

    keys = [F.struct("position", when("textual", F.lower(value), "long_lower").alias("key"))]
    if any(r.n_date and is_string(df, df.columns[r.position]) for r in plain):
        day = when("dated", parse_date(value, formats), "long_day").cast("string")
        keys.append(F.when(day.isNotNull(), F.struct((F.col("position") + DAY_CELLS).alias("position"), day.alias("key"))))
    if any(map(_has_lows, plain)):
        low = when("lows", F.lower(strip(value)), "long_low")
        keys.append(F.when(low.isNotNull(), F.struct((F.col("position") + LOW_CELLS).alias("position"), low.alias("key"))))
    keyed = groups.select("n", F.inline(F.array_compact(F.array(*keys)))) if len(keys) > 1 else groups.select("n", F.col("position"), keys[0]["key"].alias("key"))
    spelled = keyed.groupBy("position", "key").agg(F.count("*").alias("spellings"), F.sum("n").alias("n"))
    counts = spelled.groupBy("position").agg(
        F.sum(F.when(F.col("position") < DAY_CELLS, F.col("spellings")).otherwise(1)).alias("unique_count"),
        F.count_if(F.expr("key IS NOT NULL AND spellings > 1")).alias("n_case"), F.sum("n").alias("n"),
    )
    sample = told(F.when(F.coalesce(value <= bound, F.lit(True)), value), "long_sample")
    place = F.row_number().over(Window.partitionBy("position").orderBy("sample"))
    shown = groups.withColumn("sample", sample).filter(_counted("sample"))
    first = shown.select("position", "sample", place.alias("place")).filter(F.col("place") <= SAMPLES)
    samples = first.groupBy("position").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sample"))), lambda x: x["sample"]), " | ").alias("sample_values")
    )
    maybe = F.instr(F.lit(NUMBER_HEADS), F.substring(strip(value), 1, 1)) > 0
    read = F.when(maybe, parse_number(without(value, (",", "%"))))
    typed = F.when(F.col("single"), value.try_cast("float").cast("double")).otherwise(value.try_cast("double"))
    num = F.when(F.col("low").isNotNull(), told(F.when(F.col("textual"), read).otherwise(typed), "long_num"))
    medians = _medians(groups.withColumn("num", num))
    return counts.join(samples, "position", "left").join(medians, "position", "left")


def _counted(name: str) -> Column:
    """Test that a key of counted groups is not NULL. It names the count, or the optimizer would test before counting
    and so count once for each test instead of reusing the groups."""
    return F.when(F.col("n") > 0, F.col(name)).isNotNull()


def _medians(groups: DataFrame) -> DataFrame:
    """(position, median) from counted numbers and the bracket that holds the median."""
    num, low, high, n = (F.col(c) for c in ("num", "low", "high", "n"))
    between = (num > low) & (num < high)
    inside = F.sort_array(F.collect_list(F.when(between, F.struct("num", "n"))))
    cells = groups.filter(_counted("num") & _counted("low")).groupBy("position").agg(
        F.first("low").alias("low"), F.first("high").alias("high"), F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(num < low, n)), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(num == low, n)), F.lit(0)).alias("at_low"),
        F.coalesce(F.sum(F.when((num == high) & (high > low), n)), F.lit(0)).alias("at_high"),
        F.max(F.when(num < low, num)).alias("last_below"), F.min(F.when(num > high, num)).alias("first_above"),
        inside.alias("inside"),
    )
    held = F.aggregate("inside", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["n"])

    def at(place: Column) -> Column:
        start = place - F.col("below")
        inner = start - F.col("at_low")
        nothing = F.struct(F.lit(0).cast("bigint").alias("passed"), F.lit(None).cast("double").alias("found"))

        def step(a: Column, x: Column) -> Column:
            hit = (a["passed"] <= inner) & (inner < a["passed"] + x["n"])
            return F.struct((a["passed"] + x["n"]).alias("passed"), F.when(hit, x["num"]).otherwise(a["found"]).alias("found"))

        top = inner - held
        outside = F.raise_error(F.lit("A median lies outside its bracket")).cast("double")
        return (
            F.when(start == -1, F.col("last_below")).when((start >= 0) & (inner < 0), low)
            .when((inner >= 0) & (top < 0), F.aggregate("inside", nothing, step)["found"])
            .when((top >= 0) & (top < F.col("at_high")), high).when(top == F.col("at_high"), F.col("first_above"))
            .otherwise(outside)
        )

    first, last = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return cells.select("position", ((at(first) + at(last)) / 2).alias("median"))


#: The facts about a column, in the order of ``column_facts``.
FACTS = pa.schema(
    [("position", pa.int32()), ("column", pa.string()), ("kind", pa.string()), ("sample_values", pa.string())]
    + [(c, pa.int64()) for c in (
        "rows", "non_null", "null_count", "unique_count", "unique_dates", "low_values", "n_case", "n_boolean", "n_date", "n_timed",
        "n_email", "n_valid_email", "n_url", "n_phone", "n_loose", "n_unit", "n_whole", "n_number", "n_plain", "n_negative",
        "blank_like", "n_spaced",
    )]
    + [(c, pa.float64()) for c in ("loose_max", "sum", "average", "median", "min", "max", "std")]
    + [("min_date", pa.string()), ("max_date", pa.string()), ("date_range_days", pa.int32())]
)


def column_facts(df: DataFrame, formats: Sequence[str] | None = None) -> DataFrame:
    """One row per column: row counts, pattern counts, distinct values, samples and number/date figures.

    Runs the two passes of a profile; the rows are local.
    """
    plain = _plain_facts(df, formats) if df.columns else []
    distinct = {r.position: r for r in _distinct_facts(df, plain, formats).collect()} if plain else {}
    by_position = {r.position: r for r in plain}
    rows = []
    for i, name in enumerate(df.columns):
        facts = {f.name: 0 for f in FACTS if pa.types.is_int64(f.type)}
        facts |= {"position": i, "column": name, "kind": _kind(df, name)}
        if i in by_position:
            own = by_position[i].asDict()
            facts |= {k: v for k, v in own.items() if k in FACTS.names}
            facts["low_values"] = len(set(own["words"])) if own["n_boolean"] > 0.95 * own["non_null"] else 0
            facts["null_count"] = own["rows"] - own["non_null"]
            if own["n_number"] and own["std"] is None:
                facts["std"] = 0.0
        if i in distinct:
            facts |= {k: distinct[i][k] for k in ("unique_count", "n_case", "sample_values", "median")}
            if is_temporal(df, name):  # a date or time has one text
                facts["unique_dates"] = facts["unique_count"]
            elif not _is_wordy(df, name) and by_position[i].n_boolean > 0.95 * by_position[i].non_null:
                facts["low_values"] = facts["unique_count"]
        for start, output in ((DAY_CELLS, "unique_dates"), (LOW_CELLS, "low_values")):
            if start + i in distinct:
                facts[output] = distinct[start + i].unique_count
        rows.append(facts)
    return df.sparkSession.createDataFrame(pa.Table.from_pylist(rows, FACTS))


def with_types(facts: DataFrame) -> DataFrame:
    """Add ``data_type`` and ``type_confidence`` to the column facts."""
    name, kind = F.col("column"), F.col("kind")
    filled = F.col("non_null")

    def share(count: str) -> Column:
        return F.coalesce(F.try_divide(F.col(count), filled), F.lit(0.0))

    def of_numbers(count: str) -> Column:
        return F.coalesce(F.try_divide(F.col(count), F.col("n_loose")), F.lit(0.0))

    text = kind == "text"
    date_like = name.rlike(TYPE_NAMES["date"])
    date_share = share("n_date")
    is_date = text & (date_share > F.when(date_like, 0.6).otherwise(0.75))
    numeric = (kind == "numeric") | (share("n_loose") > 0.8)
    id_like = name.rlike(TYPE_NAMES["id"])
    unit = (F.col("n_loose") > 0) & (of_numbers("n_unit") > 0.9) & (F.col("loose_max") <= 1)
    few = (F.try_divide(F.col("unique_count"), filled) <= 0.15) | (
        F.col("unique_count") <= F.greatest(F.lit(20), F.floor(filled * 0.05))
    )
    number_confidence = 0.7 + 0.25 * share("n_loose")
    cascade = [
        (filled == 0, "unknown", F.lit(0.2)),
        (kind == "boolean", "boolean", F.lit(0.95)),
        ((share("n_boolean") > 0.95) & (F.col("low_values") <= 4), "boolean", F.lit(0.85)),
        (kind == "temporal", "datetime", F.lit(0.95)),
        (is_date & (F.col("n_timed") > 0), "datetime", F.least(F.lit(0.95), 0.6 + date_share * 0.35)),
        (is_date, "date", F.least(F.lit(0.95), 0.6 + date_share * 0.35)),
        (share("n_email") > 0.7, "email", F.lit(0.9)),
        (share("n_url") > 0.7, "url", F.lit(0.9)),
        (share("n_phone") > 0.7, "phone", F.lit(0.75)),
        (numeric & id_like, "identifier", F.lit(0.88)),
        (numeric & (name.rlike(TYPE_NAMES["pct"]) | unit), "percentage", F.lit(0.8)),
        (numeric & name.rlike(TYPE_NAMES["money"]), "currency", F.lit(0.9)),
        (numeric & (of_numbers("n_whole") > 0.98), "integer", number_confidence),
        (numeric & (F.col("n_loose") > 0), "decimal", number_confidence),
        (numeric, "number", number_confidence),
        (id_like, "identifier", F.lit(0.8)),
        (few, "category", F.lit(0.82)),
    ]
    label, confidence = F.lit("text"), F.lit(0.65)
    for test, kind_name, sure in reversed(cascade):
        label = F.when(test, F.lit(kind_name)).otherwise(label)
        confidence = F.when(test, sure).otherwise(confidence)
    return facts.withColumns({"data_type": label, "type_confidence": confidence})


def with_roles(typed: DataFrame) -> DataFrame:
    """Add ``role``, ``role_confidence`` and ``suggested_uses``."""
    kind, values, rows = F.col("data_type"), F.col("unique_count"), F.col("rows")

    def named(role: str) -> Column:
        return F.col("column").rlike(ROLE_NAMES[role])

    measure_like = kind.isin(*NUMERIC_TYPES) | named("measure")
    code_like = (kind == "integer") & (values <= 20) & ~named("measure")
    sparse = (rows > 0) & (F.try_divide(values, rows) < 0.2)
    ladder = [
        (kind.isin("email", "phone", "url") | named("contact"), "contact", F.lit(0.9),
         "Clean Data, Lookup / Match"),
        (kind.isin(*DATE_TYPES) | named("date"), "date_dimension", F.lit(0.92),
         "Compare, Summarize, Charts, Dashboard"),
        ((kind == "identifier") | named("id"), "identifier", F.lit(0.9),
         "Lookup / Match, Find Duplicates"),
        (named("status"), "status", F.lit(0.8), "Summarize, Compare, Charts"),
        (measure_like & code_like, "dimension", F.lit(0.6), "Summarize, Compare, Charts"),
        (measure_like, "measure", F.when(named("measure"), 0.88).otherwise(0.75),
         "Calculate, Compare, Summarize, Charts, Dashboard"),
        ((kind == "category") | named("dimension"), "dimension",
         F.when(named("dimension"), 0.85).otherwise(0.7),
         "Summarize, Compare, Charts, Pivot Table"),
        (kind == "boolean", "status", F.lit(0.7), "Summarize, Filter"),
        (sparse, "dimension", F.lit(0.65), "Summarize, Charts"),
        (values < F.greatest(F.lit(50.0), rows * 0.3), "dimension", F.lit(0.5),
         "Clean Data, Lookup / Match"),
    ]
    role, confidence = F.lit("text_attribute"), F.lit(0.5)
    uses = F.lit("Clean Data, Lookup / Match")
    for test, label, sure, use in reversed(ladder):
        role = F.when(test, F.lit(label)).otherwise(role)
        confidence = F.when(test, sure).otherwise(confidence)
        uses = F.when(test, F.lit(use)).otherwise(uses)
    return typed.withColumns(
        {"role": role, "role_confidence": confidence, "suggested_uses": uses}
    )


def described_columns(df: DataFrame, formats: Sequence[str] | None = None) -> DataFrame:
    """Column facts with types and roles; several reports can share them as ``described``."""
    return with_roles(with_types(column_facts(df, formats)))


def detect_types(df: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """(column, data_type, confidence)."""
    typed = with_types(column_facts(df)) if described is None else described
    return typed.select(
        "column", "data_type", F.round("type_confidence", 3).alias("type_confidence")
    )


def detect_roles(df: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """(column, data_type, role, confidence, suggested uses)."""
    found = described_columns(df) if described is None else described
    return found.select("column", "data_type", "role", "role_confidence", "suggested_uses")


def profile_columns(
    df: DataFrame, described: DataFrame | None = None, formats: Sequence[str] | None = None
) -> DataFrame:
    """One row per column: type, role, counts, samples and type-specific statistics.

    Sample values are the first ``SAMPLES`` distinct ones in text order.
    """
    described = described_columns(df, formats) if described is None else described
    is_number = F.col("data_type").isin(*NUMERIC_TYPES) | (F.col("kind") == "numeric")
    is_date = ~is_number & F.col("data_type").isin(*DATE_TYPES)
    other = ~is_number & ~is_date & (F.col("non_null") > 0)
    counted = is_number & (F.col("n_number") > 0)
    return described.select(
        "position", "column", "data_type",
        F.round("type_confidence", 3).alias("type_confidence"),
        "role", "role_confidence", "suggested_uses", "non_null", "null_count",
        F.round(F.coalesce(F.try_divide(100 * F.col("null_count"), F.col("rows")), F.lit(0.0)), 2).alias("null_pct"),
        "unique_count",
        *[F.when(is_date, F.col(c)).alias(c) for c in ("min_date", "max_date", "unique_dates", "date_range_days")],
        F.when(other, F.col("blank_like")).alias("blank_like"),
        F.when(other, F.col("non_null") - F.col("unique_count")).alias("duplicate_values"),
        "sample_values",
        *[F.when(counted, F.col(c)).alias(c) for c in ("sum", "average", "median", "min", "max", "std")],
    )


def top_values(df: DataFrame, n: int = 5) -> DataFrame:
    """(column, rank, value, count) of the most frequent values of each column.

    The rank test limits every task's rows per column before the shuffle.
    """
    counts = value_counts(df)
    order = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    ranked = counts.filter(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).select("column", "rank", "value", "count")


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing, pct) of the columns with missing values, in one pass."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(clean_number(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"))
        for i, c in enumerate(df.columns)
    ]
    long = wide.select("rows", F.inline(F.array(*cells)))
    return long.filter(F.col("missing") > 0).select(
        "column", "missing", F.round(100 * F.col("missing") / F.col("rows"), 2).alias("pct")
    )


ISSUE_SCHEMA = ("severity", "category", "issue", "column", "count")


def quality_issues(
    df: DataFrame, described: DataFrame | None = None, number_threshold: float = 0.85
) -> DataFrame:
    """(severity, category, issue, column, count) of everything suspicious."""
    facts = described_columns(df) if described is None else described
    text = F.col("kind") == "text"
    identifier = (F.col("role") == "identifier") | (F.col("data_type") == "identifier")
    repeats = F.col("non_null") - F.col("unique_count")
    numeric_text = text & (F.try_divide(F.col("n_number"), F.col("non_null")) > number_threshold)
    bad_email = F.col("non_null") - F.col("n_valid_email")
    negative = (F.col("role") == "measure") & F.col("column").rlike(ROLE_NAMES["quantity"])
    zero = F.lit(0)
    missing_severity = F.when(F.try_divide(F.col("null_count"), F.col("rows")) < 0.1, "warning")
    cases = [
        (F.coalesce(missing_severity, F.lit("high")), "missing", "missing", F.col("null_count")),
        (F.lit("high"), "duplicate", "duplicate_identifier", F.when(identifier, repeats)),
        (F.lit("info"), "formatting", "spaces", F.when(text, F.col("n_spaced"))),
        (F.lit("warning"), "consistency", "capitalization", F.col("n_case")),
        (F.lit("info"), "formatting", "numeric_text", F.when(numeric_text, F.col("n_number"))),
        (F.lit("warning"), "validity", "invalid_email",
         F.when(F.col("data_type") == "email", bad_email)),
        (F.lit("warning"), "validity", "negative_quantity", F.when(negative, F.col("n_negative"))),
    ]
    found = F.array(
        *[
            F.struct(
                severity.alias("severity"),
                F.lit(category).alias("category"),
                F.lit(issue).alias("issue"),
                F.col("column").alias("column"),
                F.coalesce(count, zero).cast("bigint").alias("count"),
            )
            for severity, category, issue, count in cases
        ]
    )
    per_column = facts.select(F.inline(found)).filter(F.col("count") > 0)
    rows = duplicate_row_count(df).filter(F.col("duplicate_rows") > 0).select(
        F.lit("warning").alias("severity"),
        F.lit("duplicate").alias("category"),
        F.lit("duplicate_rows").alias("issue"),
        F.lit(None).cast("string").alias("column"),
        F.col("duplicate_rows").alias("count"),
    )
    return per_column.unionByName(rows)


def detect_issues(df: DataFrame, number_threshold: float = 0.80) -> DataFrame:
    """(issue, column, count, pct): repeats, gaps, stray spaces, numbers kept as text."""
    facts = column_facts(df)
    text, filled = F.col("kind") == "text", F.col("non_null")
    as_text = text & (F.try_divide(F.col("n_plain"), filled) > number_threshold)
    cases = [
        ("missing", F.col("null_count"), F.col("rows")),
        ("spaces", F.when(text, F.col("n_spaced")), filled),
        ("numeric_text", F.when(as_text, F.col("n_plain")), filled),
    ]
    found = F.array(
        *[
            F.struct(
                F.lit(issue).alias("issue"),
                F.col("column").alias("column"),
                F.coalesce(count, F.lit(0)).cast("bigint").alias("count"),
                F.round(F.try_divide(100.0 * count, base), 1).alias("pct"),
            )
            for issue, count, base in cases
        ]
    )
    per_column = facts.select(F.inline(found)).filter(F.col("count") > 0)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = duplicate_row_count(df).filter(F.col("duplicate_rows") > 0).select(
        F.lit("duplicate_rows").alias("issue"),
        F.lit(None).cast("string").alias("column"),
        F.col("duplicate_rows").alias("count"),
        F.round(F.try_divide(100.0 * F.col("duplicate_rows"), total), 1).alias("pct"),
    )
    return per_column.unionByName(rows)


def health_score(df: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """One row: overall score 0-100 and its five components."""
    described = described_columns(df) if described is None else described
    issues = quality_issues(df, described)
    hits = issues.agg(
        F.count_if((F.col("category") == "validity") | (F.col("severity") == "high")).alias("valid"),
        F.count_if(F.col("category").isin("consistency", "formatting")).alias("consistent"),
        F.coalesce(F.max(F.when(F.col("issue") == "duplicate_rows", F.col("count"))), F.lit(0)).alias("dups"),
    )
    h = hits.select(F.struct("valid", "consistent", "dups").alias("h")).scalar()
    rows = F.max("rows")
    missing = F.coalesce(F.try_divide(F.sum("null_count"), rows * F.count(F.lit(1))), F.lit(0.0))
    parts = described.agg(
        F.greatest(F.lit(0.0), 100 * (1 - missing)).alias("completeness"),
        (100 * F.avg("type_confidence")).alias("type_confidence"),
        rows.alias("rows"),
    )
    repeated = F.coalesce(F.try_divide(h["dups"], F.col("rows")), F.lit(0.0))
    scored = parts.select(
        "completeness",
        F.greatest(F.lit(0.0), 100.0 - 8 * h["valid"]).alias("validity"),
        F.greatest(F.lit(0.0), 100 * (1 - F.least(2 * repeated, F.lit(1.0)))).alias("uniqueness"),
        F.greatest(F.lit(0.0), 100.0 - 5 * h["consistent"]).alias("consistency"),
        "type_confidence",
    )
    # The weight of each component.
    weights = {
        "completeness": 0.30,
        "validity": 0.20,
        "uniqueness": 0.20,
        "consistency": 0.15,
        "type_confidence": 0.15,
    }
    overall = F.lit(0.0)
    for name, weight in weights.items():
        overall = overall + weight * F.col(name)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(overall, 0)))
    return scored.select(
        bounded.cast("int").alias("score"),
        *[F.round(F.col(name), 1).alias(name) for name in weights],
    )


def semantic_model(df: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """(list, column): which columns serve as measures, dimensions, dates and so on."""
    role, kind = F.col("role"), F.col("data_type")
    # What puts a column on each list; a column may be on several.
    lists = {
        "measures": (role == "measure") | kind.isin(*NUMERIC_TYPES),
        "dimensions": role.isin("dimension", "status") | (kind == "category"),
        "dates": (role == "date_dimension") | kind.isin(*DATE_TYPES),
        "identifiers": (role == "identifier") | (kind == "identifier"),
        "contacts": (role == "contact") | kind.isin("email", "phone"),
    }
    entries = F.array(*[F.when(test, F.lit(name)) for name, test in lists.items()])
    listed = detect_roles(df, described).select(F.explode(entries).alias("list"), "column")
    return listed.filter(F.col("list").isNotNull())


def find_problems(df: DataFrame, measure: str | None = None) -> DataFrame:
    """(issue, column, count): rows in duplicate groups, missing cells, outliers.

    Outliers are looked for in ``measure``, or in every numeric column.
    """
    label = F.lit(None).cast("string")
    in_groups = repeated_keys(df, df.columns).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("count")
    )
    parts = in_groups.select(F.lit("duplicate_rows").alias("issue"), label.alias("column"), "count")
    gaps = missing_summary(df).select(F.lit("missing").alias("issue"), "column", F.col("missing").alias("count"))
    parts = parts.unionByName(gaps)
    for target in [measure] if measure else numeric_columns(df):
        hits = outliers(df.select(ref(target)), target).agg(F.count(F.lit(1)).alias("count"))
        parts = parts.unionByName(
            hits.select(F.lit("outlier").alias("issue"), F.lit(target).alias("column"), "count")
        )
    return parts.filter(F.col("count") > 0)
