"""SimHash near-duplicates, found by the general pigeonhole principle.

A text's fingerprint has 64 bits; two fingerprints link if at most ``DISTANCE`` bits
differ. The bits are dealt to parts, correlated bits to the same part. If the parts'
thresholds (-1 and up) add up to ``DISTANCE`` less the number of parts plus one, linked
fingerprints agree within the threshold in some part. Bits that say little for one part
alone make it worth skipping (-1) and another worth probing further, so thresholds are
chosen by dynamic programming on the rows they ship and the candidates they make.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import durable
from . import blocks
from .common import SLICE, need, signed, texts, word_pieces
from .components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42

#: Numbers of parts that are weighed against each other.
PARTS = (2, 3, 4)

#: Cost of a comparison, if a row that is shuffled and grouped costs 1.
PAIR_COST = 1 / 200


def _votes(data: bytes) -> tuple[np.ndarray, int]:
    """How many shingle hashes set each bit, and the number of shingles."""
    votes, total, carry, few = np.zeros(BITS, np.int64), 0, [], True
    for piece in word_pieces(data.lower()):
        words = carry + piece
        if len(words) >= SHINGLE:
            joined = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
            n = len(words) - SHINGLE + 1
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
            votes, total, few = votes + bits.sum(axis=0, dtype=np.int64), total + n, False
        carry = words[1 - SHINGLE :]
    if few and carry:
        one = np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)
        votes, total = np.unpackbits(one.view(np.uint8), bitorder="little").astype(np.int64), 1
    return votes, total


def fingerprint(data: bytes) -> int:
    """The fingerprint of one text, unsigned; 0 if it has no word."""
    votes, total = _votes(data)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(returnType=T.LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    """SimHash of each text as a long. Arrow hands over batches of texts; nothing is kept between them."""
    slices = (texts(text.slice(start, SLICE)) for start in range(0, len(text), SLICE))
    return pa.array([signed(fingerprint(data)) for part in slices for data in part], pa.int64())


def hexadecimal(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


# --- choosing parts and thresholds -------------------------------------------------


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of bits, in how many fingerprints of the task both are set."""
    both = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += (bits.T @ bits).astype(np.int64)
    i, j = np.nonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j])], names=["i", "j", "n"])


@dataclass(frozen=True)
class Part:
    """Bits that are matched together, and how many of them may differ (-1: part not used)."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    @property
    def flips(self) -> list[int]:
        reach = range(self.threshold + 1)
        return [signed(sum(1 << b for b in chosen)) for k in reach for chosen in combinations(self.bits, k)]


def group_bits(both: np.ndarray, n: int, parts: int) -> list[tuple[int, ...]]:
    """Deal the bits to ``parts`` parts of even size; each grows by the bit most correlated with it."""
    share = np.diag(both) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs((both / n - np.outer(share, share)) / np.outer(spread, spread))
    free, dealt = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        part = [max(free, key=lambda b: (tied[b, free].sum() - tied[b, b], -b))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (tied[b, part].sum(), -b)))
            free.remove(part[-1])
        dealt.append(tuple(sorted(part)))
    return dealt


def _costs(bits: tuple[int, ...], share: np.ndarray, n: int, equal: float) -> list[float]:
    """Cost of a part for thresholds -1 to DISTANCE: rows shipped, and estimated candidates.

    ``equal`` is the number of pairs that agree on the part. How many more come within a
    distance is taken from the bits' own shares, as if they were independent.
    """
    within = np.zeros(DISTANCE + 1)
    within[0] = 1
    for q in 2 * share[list(bits)] * (1 - share[list(bits)]):
        within[1:], within[0] = within[1:] * (1 - q) + within[:-1] * q, within[0] * (1 - q)
    reach = np.cumsum(within) / max(within[0], 1e-300)
    rows = np.cumsum([comb(len(bits), t) for t in range(DISTANCE + 1)])
    return [0.0, *(n * rows + PAIR_COST * equal * rows * reach).tolist()]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least cost, and the index chosen in each list, if the indices must add up to ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k in range(min(len(own) - 1, total - used) + 1):
                offer = (cost + own[k], [*chosen, k])
                if used + k not in step or offer < step[used + k]:
                    step[used + k] = offer
        best = step
    return best[total]


def plan_parts(distinct: DataFrame) -> list[Part]:
    """Parts and thresholds for the distinct fingerprints in column ``fp``.

    Bit shares, correlations and the pairs that agree on each part are counted over all
    of them; the driver gets one number per pair of bits and one per part.
    """
    both = np.zeros((BITS, BITS))
    sums = distinct.select("fp").mapInArrow(_together, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n"))
    for i, j, count in sums.collect():
        both[i, j] = count
    n = max(distinct.count(), 1)
    plans = {m: group_bits(both, n, m) for m in PARTS}
    every = [(m, k) for m in PARTS for k in range(m)]
    keys = [
        F.struct(F.lit(at).alias("at"), F.col("fp").bitwiseAND(F.lit(Part(plans[m][k], 0).mask)).alias("key"))
        for at, (m, k) in enumerate(every)
    ]
    counts = distinct.select(F.inline(F.array(*keys))).groupBy("at", "key").count()
    pairs = dict(counts.groupBy("at").agg(F.sum(F.expr("count * (count - 1) / 2D"))).collect())
    share, offers = np.diag(both) / n, []
    for m in PARTS:
        own = [_costs(bits, share, n, pairs.get(every.index((m, k)), 0.0)) for k, bits in enumerate(plans[m])]
        cost, chosen = allocate(own, DISTANCE + 1)
        offers.append((cost, -m, [Part(bits, k - 1) for bits, k in zip(plans[m], chosen, strict=True)]))
    return min(offers)[2]


# --- probing and verifying ---------------------------------------------------------


def _probes(distinct: DataFrame, parts: list[Part]) -> DataFrame:
    """(part, key, fp): each fingerprint under its own value in each part and all values within the threshold."""
    used = []
    for at, part in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(part.mask))
        keys = [F.struct(F.lit(at).alias("part"), own.bitwiseXOR(F.lit(flip)).alias("key")) for flip in part.flips]
        used += [F.array(*keys)] if keys else []
    return distinct.select("fp", F.inline(F.concat(*used))).select("part", "key", "fp")


def _close(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE


def spanning_links(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in a group of distinct fingerprints: one fewer than members at most."""
    left, a, b = group, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = _close(left, at)
            found, left = left[hit], left[~hit]
            a.append(np.full(len(found), at))
            b.append(found)
            front.extend(found)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


SMALL = 24


def _links_of(bounds: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    """Links within groups; bounds: where each group starts, and the end."""
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    a, b = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=0)))):
        hit = np.flatnonzero((of[step:] == of[:-step]) & small[step:])
        hit = hit[_close(fps[hit], fps[hit + step])]
        a.append(fps[hit])
        b.append(fps[hit + step])
    for k in np.flatnonzero(sizes > SMALL):
        x, y = spanning_links(fps[bounds[k] : bounds[k + 1]])
        a.append(x)
        b.append(y)
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([empty, *a])), pa.array(np.concatenate([empty, *b]))], names=["a", "b"]
    )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints of the same group; groups come one after the other.

    A batch's last group may go on in the next batch, so it waits for that. A group has
    two blocks at most, which bounds what is held.
    """
    rest = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        if not rows.shape[1]:
            continue
        starts = np.concatenate([[0], 1 + np.flatnonzero((rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0))])
        rest = rows[:, starts[-1] :]
        yield _links_of(starts, rows[-1, : starts[-1]])
    if rest is not None:
        yield _links_of(np.array([0, rest.shape[1]]), rest[-1])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect all that links connect.

    Among fingerprints that are close to each other only enough links are made to hold
    them together, never all pairs.
    """
    probes = durable(_probes(distinct, plan_parts(distinct)))
    group = ["part", "key", *blocks.PAIR]
    dealt = blocks.paired_blocks(probes, ["part", "key"], "fp").repartition(*group).sortWithinPartitions(*group)
    return dealt.select(*group, "fp").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs`` its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    component_id is the smallest id whose fingerprint can be reached over links, itself
    included. NULL and blank texts have fingerprint zero and link like any other; rows
    with a NULL id get a component too, but are never its name, which is NULL if no
    member has an id. Repeated rows stay. Other columns are neither read nor returned.
    """
    need(docs, id_column, text_column)
    rows = docs.select(F.col(id_column).alias("id"), fingerprints(F.col(text_column)).alias("fp"))
    rows = durable(rows)
    distinct = durable(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = durable(components(durable(fingerprint_links(distinct))))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = durable(rooted)
    names = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = durable(rooted.join(names, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(
        F.col("id").alias(id_column), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id"
    )
