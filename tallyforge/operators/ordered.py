"""Order-dependent primitives that never bring a group into one task.

A window without partitions, or partitioned by a key that holds much of the
data, runs in a single task. Here the rows are range-partitioned on the order
itself, each range is summed on its own, and the short list of range totals
gives every range its starting offset.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import TEMP, as_list, null_safe_equal, qualified, ref, require_columns

RANGE = TEMP + "range"
BEFORE = TEMP + "before"
TOTAL = TEMP + "total"
IS_ROW = TEMP + "is_row"
STEP = TEMP + "step"

CHECKPOINT_SETTING = "spark.checkpoint.dir"


_own_folders: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; in local mode, where one machine is all there is, a private
    one for the application if it names none."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a shared folder.")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="tallyforge-")
    return _own_folders[context.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back.

    Later steps then start from shared storage, survive the loss of executors and
    see one fixed assignment of rows to ranges. Columns are stored under plain
    names, so any header is fine.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/tallyforge/{uuid.uuid4().hex}"
    stored = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    stored.write.parquet(path)
    return df.sparkSession.read.schema(stored.schema).parquet(path).toDF(*df.columns)


def _ranges(
    df: DataFrame, value: str, order: Sequence[Column], keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``df`` laid out by ``keys`` and ``order`` in numbered ranges, and per
    (keys, range) its sum, what comes before it and the total of the group.

    The second frame has as many rows as there are groups plus ranges.
    """
    group = [ref(k) for k in keys]
    placed = [g.asc_nulls_first() for g in group] + list(order)
    ranged = durable(df.repartitionByRange(*placed).withColumn(RANGE, F.spark_partition_id()))
    sums = ranged.groupBy(*group, ref(RANGE)).agg(F.sum(ref(value)).alias(STEP))
    earlier = Window.partitionBy(*group).orderBy(ref(RANGE))
    before = F.sum(STEP).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(
        *group,
        ref(RANGE),
        ref(STEP),
        F.coalesce(before, _zero(df, value)).alias(BEFORE),
        F.sum(STEP).over(Window.partitionBy(*group)).alias(TOTAL),
    )
    return ranged, offsets


def _zero(df: DataFrame, value: str) -> Column:
    return F.lit(0).cast(df.schema[value].dataType)


def _running(
    ranged: DataFrame,
    offsets: DataFrame,
    value: str,
    order: Sequence[Column],
    output: str,
    keys: Sequence[str],
    group_total: str | None,
) -> DataFrame:
    """Running sums from ranges and their offsets.

    ``order`` must put the offset before the rows of its range; the offset row has
    NULL in every other column. One shuffle then serves both.
    """
    lead = offsets.select(
        *[ref(k) for k in keys], ref(RANGE), ref(BEFORE).alias(STEP), ref(TOTAL),
        F.lit(False).alias(IS_ROW),
    )
    rows = ranged.withColumns(
        {STEP: F.coalesce(ref(value), _zero(ranged, value)), TOTAL: F.lit(None), IS_ROW: F.lit(True)}
    )
    local = (
        Window.partitionBy(*[ref(k) for k in keys], ref(RANGE))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    extra = [F.first(ref(TOTAL)).over(local).alias(group_total)] if group_total else []
    kept = [c for c in ranged.columns if c != RANGE]
    summed = rows.unionByName(lead, allowMissingColumns=True).select(
        *[ref(c) for c in kept], ref(IS_ROW), F.sum(ref(STEP)).over(local).alias(output), *extra
    )
    return summed.filter(ref(IS_ROW)).drop(IS_ROW)


def prefix_sum(
    df: DataFrame,
    value: str,
    order: Sequence[Column],
    output: str,
    keys: str | Sequence[str] | None = None,
    group_total: str | None = None,
) -> DataFrame:
    """Add ``output`` = running sum of ``value`` in ``order`` (within ``keys``).

    ``order`` must be total: together with ``keys`` it identifies a row.
    ``group_total`` names an optional column for the sum over the whole group.
    """
    keys = as_list(keys)
    require_columns(df, value, keys)
    ranged, offsets = _ranges(df, value, order, keys)
    led = [ref(IS_ROW).asc(), *order]
    return _running(ranged, offsets, value, led, output, keys, group_total)


def row_index(df: DataFrame, order: Sequence[Column], output: str) -> DataFrame:
    """Add the 1-based position of each row in a total order."""
    one = TEMP + "one"
    return prefix_sum(df.withColumn(one, F.lit(1).cast("bigint")), one, order, output).drop(one)


#: Size of the sketch that brackets a percentile, and how far the bracket reaches on both sides:
#: the sketch errs by one part in SKETCH at most.
SKETCH = 10_000
MARGIN = 2 / SKETCH

EDGES, FACTS, COUNT = TEMP + "edges", TEMP + "facts", TEMP + "count"
LEAST, MOST, RANK = TEMP + "least", TEMP + "most", TEMP + "rank"


#: Values strictly inside a bracket up to which they are gathered in one row; more are bracketed again.
RESIDUE = 20_000

#: Parts that a pass over a bracket cuts it into.
GRID = 500


@dataclass(frozen=True)
class Bracket:
    """Where a percentile of a column lies: at or between two of its values. ``inside`` bounds the values
    strictly between them."""

    low: float
    high: float
    inside: float

    def counts(self, x: Column) -> list[Column]:
        """How many values lie below, at the lower and at the upper end, and the test for those between."""
        at_high = F.count_if(x == self.high) if self.high > self.low else F.lit(0).cast("bigint")
        return [F.count_if(x < self.low), F.count_if(x == self.low), at_high, (x > self.low) & (x < self.high)]


def narrowed(df: DataFrame, open_: Mapping[str, tuple[Column, Bracket, float, float]]) -> dict[str, Bracket]:
    """Brackets a few parts of ``GRID`` wide around the two places of each output, from one pass over ``df``."""
    steps = F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))
    facts = {}
    for output, (x, bracket, _, _) in open_.items():
        below, at_low, _, between = bracket.counts(x)
        grid = F.percentile_approx(F.when(between, x), steps, SKETCH)
        facts[output] = F.struct((below + at_low).alias("before"), F.count_if(between).alias("n"), grid.alias("grid"))
    row = df.agg(*[f.alias(o) for o, f in facts.items()]).first()
    found = {}
    for output, (_, bracket, first, last) in open_.items():
        before, n, grid = row[output]
        low, high, reach = bracket.low, bracket.high, n
        if n:
            left, right = ((place - before) / n * GRID for place in (first, last))
            low = grid[int(left) - 2] if left >= 2 else low
            high = grid[int(right) + 3] if right < GRID - 3 else high
            reach = n * 8 / GRID
        found[output] = Bracket(low, high, reach)
    return found


def exact_percentiles(
    df: DataFrame, wanted: Sequence[tuple[str, float, str]], aggs: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row: the aggregates ``aggs`` of ``df`` and, for each (column, probability, output) of ``wanted``, the
    interpolated percentile as a double; NULL for a column without values. NULLs are left out.

    All columns are worked on side by side. One pass sketches brackets for all places at once. The last pass counts
    what lies below a bracket and at its ends, and gathers the values strictly between them, which tells the value
    at any place inside; the counts prove that the place is there. Values that recur very often become ends of a
    bracket, so that a bracket holds a share of the rows that depends on the sketch alone. Where that may be more
    than ``RESIDUE`` values, further passes narrow the brackets first, each by a factor of ``GRID`` / 8: what one row
    gathers is bounded, whatever the size of ``df``. No row is shuffled or sorted.

    The first passes run while the plan is built and bring one row of numbers to the driver.
    """
    aggs = dict(aggs or {})
    columns = list(dict.fromkeys(c for c, _, _ in wanted))
    require_columns(df, columns)
    x = {c: ref(c).cast("double") for c in columns}
    edges = {c: sorted({min(max(p + m, 0.0), 1.0) for w, p, _ in wanted if w == c for m in (-MARGIN, MARGIN)}) for c in columns}
    sketches = [
        F.struct(F.count(x[c]).alias("n"), F.percentile_approx(x[c], F.array(*map(F.lit, edges[c])), SKETCH).alias("edges")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    seen = dict(zip(columns, df.agg(*sketches).first() if columns else []))
    brackets, places = {}, {}
    for c, p, output in wanted:
        n, found = seen[c]
        if n:
            low, high = (found[edges[c].index(min(max(p + m, 0.0), 1.0))] for m in (-MARGIN, MARGIN))
            places[output] = p * (n - 1)
            brackets[output] = Bracket(low, high, n * 2 * (MARGIN + 1 / SKETCH))
    column_of = {output: x[c] for c, _, output in wanted}
    while open_ := {
        o: (column_of[o], b, floor(places[o]), ceil(places[o])) for o, b in brackets.items() if b.high > b.low and b.inside > RESIDUE
    }:
        brackets |= narrowed(df, open_)

    cells = {}
    for output, bracket in brackets.items():
        value = column_of[output]
        below, at_low, at_high, between = bracket.counts(value)
        inside = F.sort_array(F.collect_list(F.when(between, value)))
        cells[output] = F.struct(
            below.alias("below"), at_low.alias("at_low"), at_high.alias("at_high"), inside.alias("inside"),
            F.max(F.when(value < bracket.low, value)).alias("last_below"), F.min(F.when(value > bracket.high, value)).alias("first_above"),
        )
    counted = [cell.alias(f"{TEMP}p{i}") for i, cell in enumerate(cells.values())]
    gathered = df.agg(*[c.alias(n) for n, c in aggs.items()], *counted) if aggs or counted else df.sparkSession.range(1)
    picks = []
    for _, _, output in wanted:
        if output not in brackets:
            picks.append(F.lit(None).cast("double").alias(output))
            continue
        cell, bracket, place = F.col(f"{TEMP}p{list(cells).index(output)}"), brackets[output], places[output]
        low, high = (_value_at(cell, bracket, at) for at in (floor(place), ceil(place)))
        picks.append((low + (high - low) * F.lit(place - floor(place))).alias(output))
    return gathered.select(*map(ref, aggs), *picks)


def _value_at(cell: Column, bracket: Bracket, place: int) -> Column:
    """The value at a place (from 0) of the whole column, given what was counted for its bracket."""
    at = F.lit(place) - cell["below"]
    inner = at - cell["at_low"]
    outside = F.raise_error(F.lit("A percentile lies outside its bracket")).cast("double")
    found = F.when((at >= 0) & (inner < 0), F.lit(bracket.low))
    found = found.when((inner >= 0) & (inner < F.size(cell["inside"])), F.get(cell["inside"], inner.cast("int")))
    top = inner - F.size(cell["inside"])
    found = found.when((top >= 0) & (top < cell["at_high"]), F.lit(bracket.high))
    # A percentile between two values may have one of them right outside.
    return found.when(at == -1, cell["last_below"]).when(top == cell["at_high"], cell["first_above"]).otherwise(outside)


def with_percentiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    outputs: Sequence[str],
    keys: str | Sequence[str] | None = None,
    aggs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``keys``, the aggregates ``aggs`` and exact interpolated percentiles per group.

    Without keys see :func:`exact_percentiles`. With them, one pass computes the aggregates and sketches a bracket around each wanted place.
    The second pass counts the values inside the brackets one by one and all others in
    lumps between them, so that little is left to order, and checks by the counts that
    every place lies inside its bracket. Groups without values have NULL percentiles.
    """
    keys, aggs = as_list(keys), dict(aggs or {})
    require_columns(df, value, keys)
    if len(probabilities) != len(outputs):
        raise ValueError("One output name per probability is needed.")
    if not keys:
        return exact_percentiles(df, [(value, p, o) for p, o in zip(probabilities, outputs)], aggs)
    group = [ref(k) for k in keys]
    edges = [min(max(p + m, 0.0), 1.0) for p in probabilities for m in (-MARGIN, MARGIN)]
    sketch = F.percentile_approx(ref(value), F.array(*map(F.lit, edges)), SKETCH)
    facts = F.struct(sketch.alias(EDGES), *[c.alias(n) for n, c in aggs.items()])
    first = df.groupBy(*group).agg(facts.alias(FACTS))
    pairs = null_safe_equal([qualified("a", k) for k in keys], [qualified("b", k) for k in keys])
    bracketed = df.alias("a").join(first.alias("b"), pairs).select(
        *[qualified("a", k) for k in keys], qualified("a", value), qualified("b", FACTS)[EDGES].alias(EDGES)
    )
    v, inside, passed = ref(value), F.lit(False), F.lit(0)
    for i in range(len(probabilities)):
        low, high = F.get(ref(EDGES), F.lit(2 * i)), F.get(ref(EDGES), F.lit(2 * i + 1))
        inside = inside | ((low <= v) & (v <= high))
        passed = passed + (v > high).cast("int")
    lumps = bracketed.select(*group, v, passed.alias(RANGE), F.when(inside, v).alias(STEP))
    cells = lumps.groupBy(*group, ref(RANGE), ref(STEP)).agg(
        F.count(v).alias(COUNT), F.min(v).alias(LEAST), F.max(v).alias(MOST)
    )
    all_of = Window.partitionBy(*group)
    ranked = cells.withColumns({
        RANK: F.sum(COUNT).over(all_of.orderBy(ref(LEAST).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)),
        TOTAL: F.sum(COUNT).over(all_of),
    })
    start = ref(RANK) - ref(COUNT)

    def at(place: Column) -> Column:
        """The value at a place, for the cell that holds it."""
        outside = F.raise_error(F.lit("A percentile lies outside its bracket")).cast("double")
        found = F.when((place == start) | (ref(LEAST) == ref(MOST)), ref(LEAST).cast("double"))
        found = found.when(place == ref(RANK) - 1, ref(MOST).cast("double")).otherwise(outside)
        return F.max(F.when(_within(place, start, ref(RANK)), found))

    picks = []
    for p, output in zip(probabilities, outputs):
        place, low, high = _places(p)
        picks.append((at(low) + (at(high) - at(low)) * F.max(place - low)).alias(output))
    picked = ranked.groupBy(*group).agg(*picks)
    if not aggs:
        return picked
    return first.alias("a").join(picked.alias("b"), pairs).select(
        *[qualified("a", k) for k in keys],
        *[qualified("a", FACTS)[n].alias(n) for n in aggs],
        *[qualified("b", o) for o in outputs],
    )


def percentiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    outputs: Sequence[str],
    keys: str | Sequence[str] | None = None,
    frequency: str | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Interpolated percentiles of ``value`` per group, NULLs left out.

    Exact by default, see :func:`with_percentiles`. Values with a ``frequency`` column
    are laid out in ranges instead, as a sketch knows no frequencies. ``accuracy``
    switches to the bounded sketch of ``percentile_approx``. Groups without values give
    no row, except that an ungrouped call always returns one.
    """
    keys = as_list(keys)
    require_columns(df, value, keys, frequency)
    if len(probabilities) != len(outputs):
        raise ValueError("One output name per probability is needed.")
    present = df.filter(ref(value).isNotNull())
    group = [ref(k) for k in keys]

    if accuracy is not None:
        if frequency:
            raise ValueError("'accuracy' and 'frequency' exclude each other.")
        return present.groupBy(*group).agg(
            *[
                F.percentile_approx(ref(value), p, accuracy).cast("double").alias(o)
                for p, o in zip(probabilities, outputs)
            ]
        )
    if frequency is None:
        return with_percentiles(present, value, probabilities, outputs, keys)

    histogram = present.groupBy(*group, ref(value)).agg(F.sum(ref(frequency)).cast("bigint").alias(COUNT))
    ranged, offsets = _ranges(histogram, COUNT, [ref(value).asc()], keys)
    needed = _ranges_holding(offsets, probabilities)
    ranged, offsets = ranged.filter(needed), offsets.filter(needed)
    return _picked(ranged, offsets, value, COUNT, probabilities, outputs, keys)


def _places(p: float) -> tuple[Column, Column, Column]:
    """Exact 0-based place of a percentile, and the whole places around it."""
    place = F.lit(float(p)) * (ref(TOTAL) - 1)
    return place, F.floor(place), F.ceil(place)


def _within(place: Column, start: Column, end: Column) -> Column:
    return (start <= place) & (place < end)


def _ranges_holding(offsets: DataFrame, probabilities: Sequence[float]) -> Column:
    """Test for the ranges that hold a wanted place of some group.

    Reads the range numbers, at most one per range, so that all other files of the
    laid-out table are skipped.
    """
    inside = F.lit(False)
    for p in probabilities:
        for place in _places(p)[1:]:
            inside = inside | _within(place, ref(BEFORE), ref(BEFORE) + ref(STEP))
    numbers = offsets.filter(inside).select(ref(RANGE)).distinct().collect()
    return ref(RANGE).isin([r[0] for r in numbers])


def _picked(
    ranged: DataFrame,
    offsets: DataFrame,
    value: str,
    count: str,
    probabilities: Sequence[float],
    outputs: Sequence[str],
    keys: Sequence[str],
) -> DataFrame:
    """The values at the wanted places, interpolated."""
    rank = TEMP + "rank"
    # Counted values are never NULL, so the offset comes first.
    order = [ref(value).asc_nulls_first()]
    ranked = _running(ranged, offsets, count, order, rank, keys, TOTAL)
    picks, wanted = [], F.lit(False)
    for p, output in zip(probabilities, outputs):
        place, low, high = _places(p)
        holds_low = _within(low, ref(rank) - ref(count), ref(rank))
        holds_high = _within(high, ref(rank) - ref(count), ref(rank))
        wanted = wanted | holds_low | holds_high
        lower = F.max(F.when(holds_low, ref(value).cast("double")))
        upper = F.max(F.when(holds_high, ref(value).cast("double")))
        picks.append((lower + (upper - lower) * F.max(place - low)).alias(output))
    return ranked.filter(wanted).groupBy(*[ref(k) for k in keys]).agg(*picks)
