"""SpotSigs fingerprints.

A spot is a common word (an anchor) with the next ``CHAIN`` content words after it. A
text's fingerprint is the set of its spots' hashes, and two fingerprints are as alike as
their Jaccard similarity. Navigation and boilerplate have few anchors, so running text
decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import durable
from . import blocks
from .common import PLAIN, mapped, need, word_pieces
from .components import components

CHAIN = 2

# Articles and other very common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an the is are was be of to in and that "
    "der die das ein eine ist den dem und zu von mit "
    "le la les un une est des du et que dans "
    "el los las una es de y en por con".encode().split()
)

# Further words that carry little content; anchors carry none either.
STOPWORDS = ANCHORS | frozenset(
    "it its this these those he she they we you i his her their our or but not no on at by for from as with has have had "
    "will would can could do does did which who what when where there been were if than then so "
    "sich nicht auf für im am an als auch es er sie wir ihr aus bei nach um oder aber wie wenn sind war wird hat haben "
    "ce cette ces il elle ils elles nous vous je ne pas sur pour par plus ou mais avec au aux sont était a ont se sa son "
    "no al lo se su sus más pero como o para este esta estos son fue ha han ser".encode().split()
)

#: Fingerprints as alike as this are near-duplicates.
THRESHOLD = 0.8

#: Hex digits of a spot's hash in a fingerprint.
DIGITS = 8


def spots(text: str) -> frozenset[int]:
    """Hashes of the spots of a text. One without any has a single one, of all its words in order,
    so that equal texts agree and others do not."""
    data = text.encode().translate(PLAIN)
    found, content, waiting = set(), [], []
    for piece in word_pieces(data):
        for word in piece:
            if word not in STOPWORDS:
                content.append(word)
                while waiting and waiting[0][1] + CHAIN <= len(content):
                    anchor, at = waiting.pop(0)
                    found.add(xxhash.xxh32_intdigest(b" ".join([anchor, *content[at : at + CHAIN]])))
            if word in ANCHORS:
                waiting.append((word, len(content)))
        drop = waiting[0][1] if waiting else len(content)
        content, waiting = content[drop:], [(a, at - drop) for a, at in waiting]
    return frozenset(found or {xxhash.xxh32_intdigest(b" ".join(data.split()))})


def likeness(a: frozenset[int], b: frozenset[int], at_least: float = 0.0) -> float:
    """Jaccard similarity; 0 if the sizes alone keep it below ``at_least``."""
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def written(signatures: frozenset[int]) -> str:
    """A fingerprint as text: its hashes in hex, in order."""
    return "".join(f"{s:0{DIGITS}x}" for s in sorted(signatures))


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text; a NULL text is an empty one."""

    @F.arrow_udf(returnType="string")
    def look(text: pa.Array) -> pa.Array:
        return mapped(text, lambda t: (written(spots(t or "")),), pa.string())[0]

    return look(text.cast("string"))


# --- a text, its edited form and its neighbour ---------------------------------------

#: Id ranges for each shuffle partition; ranges of even size are hashed to partitions.
RANGES_PER_PARTITION = 4

COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the one after it. Ranges come one after the other and end with the row that follows them."""
    waiting = None
    for batch in batches:
        for start in range(0, len(batch), 200):
            part, rows = batch.slice(start, 200), []
            for bucket, helper, id_, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                text = text or ""
                now = (bucket, id_, text, spots(text))
                if waiting and waiting[0] == bucket:
                    _, own_id, own, own_spots = waiting
                    changed = edited(own, text)
                    other = spots(changed)
                    sha = hashlib.sha256(changed.encode()).hexdigest()
                    near = (likeness(own_spots, other), likeness(own_spots, now[3]))
                    rows.append((own_id, len(own), sha, written(own_spots), written(other), *near))
                waiting = None if helper else now
            if rows:
                kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *(c.split()[0] for c in COMPARED.split(", "))])


def compare_edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_chars``, and how its fingerprint survives an edit.

    In the edited text the last half (rounded down) is replaced by the beginning of the next
    document's text, in descending order of ids, the first after the last. ``near_edited``
    and ``near_next`` are the likeness of the fingerprint to the edited text's and the next
    document's. Ids are integers; equal ids are ordered by a hash of the text and NULL ids
    come last, ordered likewise; a NULL text is empty.

    Rows are shuffled once, by id ranges that are chosen from the ids alone; the first row of
    a range also goes to the range before it, so that each range can be read through on its
    own. The driver gets one id per range.
    """
    need(docs, id_column, text_column)
    spark, key = docs.sparkSession, F.xxhash64("text")
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    cuts = plain.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 4 * ranges)))).first()[0] or []
    below = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<long>"), lambda cut: cut < F.col("id")))
    placed = plain.withColumn("bucket", F.when(F.col("id").isNull(), -1).otherwise(below))
    firsts = placed.filter("id IS NOT NULL").groupBy("bucket").agg(F.max("id")).collect()
    firsts = [(bucket, first) for bucket, first in sorted(firsts, reverse=True)]
    unnamed = placed.filter("id IS NULL").agg(F.min(key)).first()[0]
    order = [bucket for bucket, _ in firsts] + ([-1] if unnamed is not None else [])
    before = dict(zip(order, order[-1:] + order[:-1], strict=True))
    ids = F.array(*(F.lit(first) for _, first in firsts)).cast("array<long>")
    targets = F.array(*(F.lit(before[bucket]) for bucket, _ in firsts)).cast("array<int>")
    target = F.get(targets, F.array_position(ids, F.col("id")).cast("int") - 1)
    if unnamed is not None:
        target = F.when(F.col("id").isNull() & (key == unnamed), before[-1]).otherwise(target)
    both = F.array(F.struct(F.col("bucket"), F.lit(0).alias("helper")), F.struct(target.alias("bucket"), F.lit(1).alias("helper")))
    spread = placed.select(F.inline(both), "id", "text").filter("bucket IS NOT NULL")
    sorted_rows = spread.repartition("bucket").sortWithinPartitions("bucket", "helper", F.desc_nulls_last("id"), key)
    kind = docs.schema[id_column].dataType.simpleString()
    found = sorted_rows.select("bucket", "helper", "id", "text").mapInArrow(_compared, f"id long, {COMPARED}")
    return found.select(F.col("id").cast(kind).alias(id_column), *(c.split()[0] for c in COMPARED.split(", ")))


# --- near-duplicates ------------------------------------------------------------------


def _linked(threshold: float):
    """Links within groups of (sizes, nodes, sets); groups come one after the other."""

    def links(group: list[tuple[int, frozenset]]) -> Iterator[tuple[int, int]]:
        # What is reached once is not compared again, so alike members give one link each.
        left = sorted(group, key=lambda m: (len(m[1]), m[0]))
        while left:
            front = [left.pop(0)]
            while front and left:
                node, own = front.pop()
                hits = {n for n, other in left if likeness(own, other, threshold) >= threshold}
                front += [m for m in left if m[0] in hits]
                left = [m for m in left if m[0] not in hits]
                yield from ((node, hit) for hit in hits)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(rows, key=lambda row: row[:4]):
            members = {node: frozenset(tokens) for *_, node, tokens in group}
            found = list(links(list(members.items()))) if len(members) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return verify


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row of ``docs`` its id, ``fingerprint`` and ``component_id``, the smallest id that can be reached over
    pairs whose fingerprints are at least ``threshold`` alike.

    Equal fingerprints are one set. Sets are partitioned by length so that sets that can be
    alike lie in the same partition or the next. In a partition, sets meet under the rarest
    of their spots, as many as must share one, and are compared with the length bound first.
    NULL ids and texts are treated as in ``simhash.near_duplicates``.
    """
    need(docs, id_column, text_column)
    rows = docs.select(F.col(id_column).alias("id"), fingerprints(F.col(text_column)).alias("fingerprint"))
    rows = durable(rows)
    numbers = F.expr(f"transform(sequence(0, int(length(fingerprint) / {DIGITS}) - 1), i -> bigint(conv(substring(fingerprint, i * {DIGITS} + 1, {DIGITS}), 16, 10)))")
    distinct = rows.groupBy("fingerprint").agg(F.min("id").alias("first"))
    distinct = durable(distinct.select("*", F.monotonically_increasing_id().alias("node"), numbers.alias("tokens")))
    each = distinct.select("node", F.explode("tokens").alias("token"))
    counts = durable(each.groupBy("token").agg(F.count("*").alias("uses")))
    own = F.sort_array(F.collect_list(F.struct("uses", "token")))
    ranked = durable(each.join(counts.filter("uses > 1"), "token").groupBy("node").agg(own.alias("common")))
    # Spots of a single text are the rarest and match nothing: they only take up room in the prefix.
    size = F.size("tokens")
    room = size - F.ceil(F.lit(threshold) * size - F.lit(1e-9)).cast("int") + 1 - (size - F.size("common"))
    part = F.floor(F.log(size.cast("double")) / log(1 / threshold) + F.lit(1e-9)).cast("int")
    kept = distinct.join(ranked, "node").filter(room > 0)
    keyed = kept.select("node", "tokens", part.alias("part"), F.explode(F.slice("common", F.lit(1), room)["token"]).alias("token"))
    placed = durable(keyed.select("token", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "node", "tokens"))
    group = ["token", "part", *blocks.PAIR]
    dealt = blocks.paired_blocks(placed, ["token", "part"], "node").repartition(*group).sortWithinPartitions(*group)
    found = durable(dealt.select(*group, "node", "tokens").mapInArrow(_linked(threshold), "a long, b long"))
    roots = durable(components(found))
    rooted = distinct.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    rooted = durable(rooted.select("fingerprint", "first", F.coalesce("root", "node").alias("root")))
    names = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = durable(rooted.join(names, "root").select("fingerprint", "component_id"))
    return rows.join(named, "fingerprint").select(F.col("id").alias(id_column), "fingerprint", "component_id")
