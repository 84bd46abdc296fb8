"""Benchmark passages in documents: a prefix-filtered set join of item windows with document windows.

A window is ``WINDOW`` consecutive words of an item, or all of a shorter one; its set are its
shingles of ``SHINGLE`` words. It occurs in a document where a window of the same length has
at least ``share`` of its shingles in their places (all of them by default, which is word for
word). Shingles are ordered by how often all documents use them, rarest first. A document
window that has enough of them must have one of the first (size - needed + 1), so only these
prefix shingles are looked for. Where one is found, its place in the window tells where the
window would begin: that must lie within the document (positional filter) and leave room for
the window's length (length filter). What passes is verified word by word.

Documents are never shuffled. Windows go to the tasks in blocks of a bounded size, so that
benchmarks of any size take a pass for each block.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import durable
from .common import PLAIN, SLICE, free_name, need, texts, word_pieces

WINDOW, SHINGLE = 10, 3

#: Bytes of windows and item ids that are sent to all tasks at a time.
BLOCK_BYTES = 64 << 20

#: Candidates that are verified at a time.
CHUNK = 1 << 16

FOUND = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>>"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def item_windows(data: bytes, window: int = WINDOW) -> list[bytes]:
    """The distinct windows of an item, words joined by blanks."""
    words = data.translate(PLAIN).split()
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i : i + window]) for i in range(max(len(words) - window, 0) + 1)))


def _keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each shingle of ``size`` words along the last axis. Others may share it, which costs candidates only."""
    n = ids.shape[-1] - size + 1
    made = np.full((*ids.shape[:-1], n), size, np.uint64)
    for i in range(size):
        made = (made + ids[..., i : i + n].astype(np.uint64)) * _MIX
        made ^= made >> np.uint64(29)
    return made


@dataclass
class Windows:
    """A block of distinct windows: ``ids`` has the words of each by number, from 1, filled up with -1."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @staticmethod
    def of(rows: list[tuple[bytes, list[str]]], window: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        ids = np.full((len(rows), window), -1, np.int32)
        lengths = np.zeros(len(rows), np.int64)
        for at, (text, _) in enumerate(rows):
            own = [vocabulary.setdefault(word, len(vocabulary) + 1) for word in text.split()]
            ids[at, : len(own)], lengths[at] = own, len(own)
        return Windows(vocabulary, ids, lengths, [items for _, items in rows])

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in it, key) of all shingles. Windows shorter than a shingle have one of their own length."""
        of, places, keys = [], [], []
        for length in np.unique(self.lengths):
            chosen = np.flatnonzero(self.lengths == length)
            made = _keys(self.ids[chosen, :length], min(SHINGLE, int(length)))
            of.append(np.repeat(chosen, made.shape[1]))
            places.append(np.tile(np.arange(made.shape[1]), len(chosen)))
            keys.append(made.reshape(-1))
        return np.concatenate(of), np.concatenate(places), np.concatenate(keys)

    def sizes(self) -> list[int]:
        """The lengths of shingles that occur."""
        return sorted({min(SHINGLE, int(n)) for n in np.unique(self.lengths)})

    def words(self, data: bytes) -> np.ndarray:
        """The words of a text by number, 0 for those of no window."""
        known = self.vocabulary.get
        parts = [np.fromiter(map(known, piece, repeat(0)), np.int32, len(piece)) for piece in word_pieces(data.translate(PLAIN))]
        return np.concatenate(parts)


def _hits(own: np.ndarray, sizes: list[int], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into the sorted keys ``wanted``, place) of the shingles of a text that are wanted."""
    ats, places = [], []
    for size in sizes:
        if len(own) < size or not len(wanted):
            continue
        keys = _keys(own, size)
        known = own > 0
        inside = known[: len(keys)].copy()
        for i in range(1, size):
            inside &= known[i : i + len(keys)]
        place = np.flatnonzero(inside)
        keys = keys[place]
        at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        hit = wanted[at] == keys
        ats.append(at[hit])
        places.append(place[hit])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *ats]), np.concatenate([empty, *places])


@dataclass
class Index:
    """Windows with their prefix shingles: ``keys``, sorted, and for each the windows and places it stands for,
    from ``starts[i]`` to ``starts[i + 1]`` in ``of`` and ``places``."""

    windows: Windows
    needed: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    of: np.ndarray
    places: np.ndarray

    @staticmethod
    def of_counts(windows: Windows, counts: np.ndarray, share: float) -> Index:
        """``counts``: uses of each distinct shingle key in all documents, in the order of the keys."""
        of, places, keys = windows.shingles()
        distinct = np.unique(keys)
        used = counts[np.searchsorted(distinct, keys)]
        sizes = np.maximum(windows.lengths - SHINGLE, 0) + 1
        needed = np.ceil(share * sizes - 1e-9).astype(np.int64)
        order = np.lexsort((places, keys, used, of))
        rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        prefix = order[rank < (sizes - needed + 1)[of[order]]]
        prefix = prefix[np.argsort(keys[prefix], kind="stable")]
        chosen, starts = np.unique(keys[prefix], return_index=True)
        return Index(windows, needed, chosen, np.append(starts, len(prefix)), of[prefix], places[prefix])

    def occurrences(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence in a text given by word numbers."""
        at, place = _hits(own, self.windows.sizes(), self.keys)
        many = self.starts[at + 1] - self.starts[at]
        found_of, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        for low in range(0, total, CHUNK):  # candidates low to low + CHUNK
            which = np.arange(low, min(low + CHUNK, total))
            hit = np.searchsorted(ends, which, side="right")
            entry = self.starts[at[hit]] + which - (ends[hit] - many[hit])
            window = self.of[entry]
            begin = place[hit] - self.places[entry]
            fits = (begin >= 0) & (begin + self.windows.lengths[window] <= len(own))
            window, begin = window[fits], begin[fits]
            enough = self._shared(own, window, begin) >= self.needed[window]
            found_of.append(window[enough])
            found_at.append(begin[enough])
        return np.concatenate(found_of), np.concatenate(found_at)

    def _shared(self, own: np.ndarray, window: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many shingles of each window stand in their places, if it begins at the given word."""
        width = self.windows.ids.shape[1]
        reach = np.minimum(begin[:, None] + np.arange(width), max(len(own) - 1, 0))
        same = own[reach] == self.windows.ids[window]
        shared = np.zeros(len(window), np.int64)
        for length in np.unique(self.windows.lengths[window]):
            size, chosen = min(SHINGLE, int(length)), self.windows.lengths[window] == length
            part = same[chosen, :length]
            whole = part[:, : length - size + 1].copy()
            for i in range(1, size):
                whole &= part[:, i : i + whole.shape[1]]
            shared[chosen] = whole.sum(axis=1)
        return shared

    def find(self, data: bytes, before: dict | None = None) -> tuple[int, list[dict], list[str]]:
        """Number of words, spans of words that windows hit, and the items of these, joined with those found before."""
        own = self.windows.words(data)
        window, begin = self.occurrences(own)
        before = before or {"spans": [], "items": []}
        if not len(window):
            return len(own), before["spans"], before["items"]
        marks = np.zeros(len(own) + 1, np.int64)
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + self.windows.lengths[window], -1)
        for span in before["spans"]:
            marks[span["start"]] += 1
            marks[span["end"]] -= 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]]).astype(np.int8)))
        spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
        items = set(before["items"]).union(*(self.windows.items[i] for i in np.unique(window)))
        return len(own), spans, sorted(items)


def _counts(docs: DataFrame, windows: Windows) -> np.ndarray:
    """How often all documents use each distinct shingle of the windows. Tasks send one sum for each they have seen."""
    keys = np.unique(windows.shingles()[2])
    sent = docs.sparkSession.sparkContext.broadcast((windows.vocabulary, keys, windows.sizes()))

    def count(batches):
        vocabulary, wanted, sizes = sent.value
        block = Windows(vocabulary, np.zeros((0, 0), np.int32), np.zeros(0, np.int64), [])
        sums = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for data in texts(batch.column(0).slice(start, SLICE)):
                    np.add.at(sums, _hits(block.words(data), sizes, wanted)[0], 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    counts = np.zeros(len(keys), np.int64)
    parts = docs.mapInArrow(count, "at long, n long")
    for at, n in parts.groupBy("at").agg(F.sum("n")).collect():
        counts[at] = n
    return counts


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _look(spark, index: Index):
    sent = spark.sparkContext.broadcast(index)

    @F.arrow_udf(returnType=FOUND)
    def look(text: pa.Array, before: pa.Array) -> pa.Array:
        parts = [[pa.array([], kind)] for kind in (pa.int64(), _SPANS, pa.list_(pa.string()))]
        for start in range(0, len(text), SLICE):
            earlier = before.slice(start, SLICE).to_pylist()
            made = [sent.value.find(data, old) for data, old in zip(texts(text.slice(start, SLICE)), earlier, strict=True)]
            for part, values in zip(parts, zip(*made, strict=True), strict=True):
                part.append(pa.array(values, part[0].type))
        return pa.StructArray.from_arrays([pa.concat_arrays(p) for p in parts], names=["n_words", "spans", "items"])

    return look


def _windows_of(items: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """(window, items): distinct windows with the ids of the items that have them, as sorted strings."""

    def cut(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = item_windows(data, window)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own, pa.binary())], names=["item", "window"])

    plain = items.select(F.col(id_column).cast("string"), F.col(text_column).cast("string"))
    cuts = plain.mapInArrow(cut, "item string, window binary")
    return cuts.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    share: float = 1.0,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (start, end) of words that windows of items hit, and ``items``, the ids of
    the items that windows were found of, as strings in order.

    Words are runs of letters and digits (and all beyond ASCII), A-Z lowered. Spans neither touch nor overlap, and
    leave out their end. A NULL or empty text has no words. An item without words has no window; one without an id
    hits words but is not named; rows with the same item id are one item. Repeated documents are looked at one by
    one. Columns of these three names are replaced, all others kept.

    Runs jobs while the plan is built: windows are collected in blocks of about ``block_bytes`` (a window shared by
    many items counts with all their ids), each of which takes a pass to count its shingles and one to find them.
    ``docs`` is stored between blocks.
    """
    need(docs, text_column)
    need(items, item_column, item_text_column)
    if not 0 < share <= 1 or window < 1:
        raise ValueError("The share must be above 0 and up to 1, and windows need a word")
    windows = durable(_windows_of(items, item_column, item_text_column, window))
    ids = F.coalesce(F.aggregate("items", F.lit(0), lambda sum_, item: sum_ + F.octet_length(item) + 8), F.lit(0))
    total = windows.agg(F.sum(F.octet_length("window") + ids)).first()[0] or 0
    blocks = max(ceil(total / block_bytes), 1)
    made, text = ("n_words", "spans", "items"), F.col(text_column).cast("string")
    names, found = [c for c in docs.columns if c not in made], free_name(docs, "found")
    now = docs.select(*names, F.lit(None).cast(FOUND).alias(found))
    for block in range(blocks):
        if block:
            now = durable(now)
        rows = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).orderBy("window").collect()
        own = Windows.of([(bytes(r.window), r["items"]) for r in rows], window)
        counts = _counts(docs.select(text), own) if rows else np.zeros(0, np.int64)
        index = Index.of_counts(own, counts, share) if rows else _nothing(window)
        now = now.select(*names, _look(docs.sparkSession, index)(text, F.col(found)).alias(found))
    return now.select(*names, *(F.col(found)[c].alias(c) for c in made))


def _nothing(window: int) -> Index:
    none = np.zeros(0, np.int64)
    return Index(Windows.of([], window), none, none.astype(np.uint64), np.zeros(1, np.int64), none, none)
