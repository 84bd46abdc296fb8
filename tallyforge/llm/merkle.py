"""A Merkle manifest of a table: leaves, a tree for each group, and a tree over the groups' roots.

Every row is a leaf. In each group (a source) leaves stand in order; ``FANOUT`` consecutive
nodes have one parent, until one node is left. The roots of the groups, in order of the
groups, are the leaves of the top tree.

Levels are pivoted by slot: a parent's children are spread into ``FANOUT`` columns by
conditional aggregates. The columns concatenated are what the parent hashes, and without
a child's own column they are its siblings. So each level is one aggregate, whose groups
have ``FANOUT`` rows at most, and paths come from unfolding the same rows again from the
top; leaves are never joined with the levels above them.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ref, require_columns
from ..operators.ordered import durable

FANOUT = 16

SLOTS = [f"slot{i}" for i in range(FANOUT)]

#: A stored row's number is its partition's number times this, plus its place in the partition.
PART_BITS = 33

OUTPUT = ("leaf", "subroot", "root", "path")

PATH = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings, concatenated."""
    return F.sha2(F.concat_ws("", *parts), 256)


def marked(value: Column) -> Column:
    """A value so that none can be taken for another or run into the next: ``-`` for NULL, else its number of
    UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def unmarked(value: Column) -> Column:
    """The string that was marked."""
    return F.when(value != "-", F.substring(value, F.instr(value, ":") + 1, F.length(value)))


def leaf_of(values: Sequence[Column]) -> Column:
    return hashed(*map(marked, values))


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf to the root, left to right."""
    return hashed(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda made, step: hashed(step["left"], made, step["right"]))


def _placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Stored ``rows`` with ``place`` (from 0) in the order within their ``tree``, and ``n``, the rows of the tree.

    Rows are laid out by ranges, numbered where they lie, and moved up by what the ranges before hold: a tree may
    fill any number of tasks. The table of moves has a row for each tree and range.
    """
    laid = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    laid = durable(laid.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", PART_BITS)
    held = laid.groupBy("tree", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("from"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moves = held.select(
        "tree", "part", (F.coalesce(before, F.lit(0)) - F.col("from")).alias("move"), F.sum("rows").over(tree).alias("n")
    )
    joined = laid.withColumn("part", part).join(durable(moves), ["tree", "part"])
    return joined.select(*rows.columns, (F.col("at") + F.col("move")).alias("place"), "n")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, place, n, child with a field ``digest``), lowest first.

    A level has tree, place, n, the children in the slots, and their parent's own child struct. Trees that have come
    to one node have no parent.
    """
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1:
        slot = F.pmod("place", F.lit(FANOUT))
        spread = [F.first(F.when(slot == i, F.col("child")), ignorenulls=True).alias(s) for i, s in enumerate(SLOTS)]
        above = (F.floor(F.col("place") / FANOUT).alias("place"), F.ceil(F.col("n") / FANOUT).alias("n"))
        parents = nodes.filter("n > 1").groupBy("tree", *above).agg(*spread)
        digest = hashed(*(F.col(s)["digest"] for s in SLOTS))
        levels.append(durable(parents.withColumn("child", F.struct(digest.alias("digest")))))
        nodes, most = levels[-1].select("tree", "place", "n", "child"), ceil(most / FANOUT)
    return levels


def _unfolded(parents: DataFrame) -> DataFrame:
    """(tree, place, child, path, subroot) of the children of parents that know their path."""
    digests = [F.coalesce(F.col(s)["digest"], F.lit("")) for s in SLOTS]
    steps = [F.struct(F.concat_ws("", *digests[:i]).alias("left"), F.concat_ws("", *digests[i + 1 :]).alias("right")) for i in range(FANOUT)]
    children = F.array(*[
        F.struct((F.col("place") * FANOUT + i).alias("place"), F.col(s).alias("child"), steps[i].alias("step"))
        for i, s in enumerate(SLOTS)
    ])
    each = parents.select("tree", "path", "subroot", F.explode(children).alias("of")).filter("of.child IS NOT NULL")
    return each.select("tree", "of.place", "of.child", F.concat(F.array("of.step"), "path").alias("path"), "subroot")


def _descended(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, child, path, subroot) of all ``nodes``, given path and subroot of each tree's top node in ``tops``."""
    from_above = None
    for level in reversed(levels):
        # A tree has one top node, on one level.
        known = level.filter("n = 1").join(tops, "tree")
        if from_above is not None:
            known = known.unionByName(level.filter("n > 1").join(from_above.drop("child"), ["tree", "place"]))
        from_above = _unfolded(known)
    alone = nodes.filter("n = 1").join(tops, "tree").select("tree", "child", "path", "subroot")
    return alone if from_above is None else alone.unionByName(from_above.drop("place"))


def _top_nodes(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    ends = nodes.filter("n = 1").select("tree", F.col("child.digest").alias("digest"))
    for level in levels:
        ends = ends.unionByName(level.filter("n = 1").select("tree", F.col("child.digest").alias("digest")))
    return ends


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "source",
    order: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(``order``, the columns ``keep``, leaf, subroot, root, path) of every row of ``docs``.

    ``leaf`` is the digest of ``columns``, ``subroot`` that of the row's group and ``root`` that of the table, all
    lowercase hex. ``path`` has, level by level up to the root, the siblings left and right of the row's node, as
    digests run together; a node without siblings has a step of empty strings. See ``folded`` and ``proof``.

    Leaves of a group stand by ``order``, NULL first, rows that agree in it by leaf. Groups stand by their value as a
    string in UTF-8, NULL first, which is a group of its own. NULL, an empty text and any other are told apart.
    Repeated rows are leaves each. A table without rows has none and no root. Other columns are not read. Runs jobs
    while the plan is built: it stores digests, ``order`` and ``keep``, never the columns that only go into the leaves.
    """
    require_columns(docs, columns, group, order, keep)
    kept = [c for c in keep if c not in (*OUTPUT, order)]
    child = F.struct(leaf_of([ref(c) for c in columns]).alias("digest"), ref(order).alias("order"), *(ref(c).alias(f"k{i}") for i, c in enumerate(kept)))
    leaves = durable(docs.select(marked(ref(group)).alias("tree"), child.alias("child")))
    nodes = _placed(leaves, [F.col("child.order").asc_nulls_first(), F.col("child.digest").asc()])
    nodes = nodes.select("tree", "place", "n", "child")
    levels = _levels(nodes)

    ends = _top_nodes(nodes, levels).select(F.lit("").alias("tree"), F.struct("digest", F.col("tree").alias("group")).alias("child"))
    groups = durable(_placed(ends, [unmarked(F.col("child.group")).asc_nulls_first()]))
    top = _levels(groups)
    root = _top_nodes(groups, top).select("digest").scalar()
    start = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    tops = _descended(groups, top, start).select(
        F.col("child.group").alias("tree"), "path", F.col("child.digest").alias("subroot")
    )
    found = _descended(nodes, levels, durable(tops))
    return found.select(
        F.col("child.order").alias(order),
        *(F.col(f"child.k{i}").alias(c) for i, c in enumerate(kept)),
        F.col("child.digest").alias("leaf"), "subroot", root.alias("root"), "path",
    )
