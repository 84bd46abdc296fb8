"""Removal of repeated passages by hashing the units of a text.

A text is cut into units of a few words where the words themselves say so: after two words
whose joint hash is divisible by ``CUT_EVERY``, but not before ``LEAST_UNIT`` words and always
after ``MOST_UNIT``. Copies of a passage then fall in step within a few words, wherever they
begin and whatever their punctuation and line breaks are.

Each unit is hashed; digests are grouped over all documents, and the document with the
smallest id keeps its unit. In the others, units that an earlier document holds are joined
to runs, and runs of ``MIN_WORDS`` words or more are passages to remove. Only digests, ids
and places are shuffled, never text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import durable
from .common import PLAIN, SLICE, free_name, need

#: Runs of fewer words are left: a few words in a row recur by chance.
MIN_WORDS = 25

#: Words of a unit, least and most, and what the hash of two words must be divisible by to end one between them.
LEAST_UNIT, MOST_UNIT, CUT_EVERY = 2, 10, 3

#: Bytes of text that are cut at a time, so that a huge text needs no huge lists, and units that a task gathers.
PIECE, FLUSH = 1 << 20, 50_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, remembered as words recur. Forgets all at ``most`` words to stay small."""

    most = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


#: One for each worker process.
_HASHES = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _words(text: str):
    """(hash, start, end) of the words of a text by pieces, as arrays; places are in code points."""
    raw = text.encode()
    data = raw.translate(PLAIN)
    at = passed = 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE)
        stop = len(data) if cut < 0 else cut
        part = data[at:stop]
        words = part.split()
        filled = np.frombuffer(part, np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate([[False], filled, [False]]).astype(np.int8)))
        places = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8, stop - at, at) & 0xC0) != 0x80)])
        hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        yield hashes, passed + places[edges[::2]], passed + places[edges[1::2]]
        at, passed = stop, passed + int(places[-1])


def _ends(hashes: np.ndarray, last: bool) -> list[int]:
    """Where units end: each is the place after its last word. Words after the last end are still open."""
    joint = _mixed(hashes[:-1] * _ODD + hashes[1:])
    wanted = np.flatnonzero((joint % np.uint64(CUT_EVERY)) == 0) + 1  # a unit may end before this word
    ends, start = [], 0
    for end in [*wanted.tolist(), len(hashes)]:
        while end - start > MOST_UNIT:
            start += MOST_UNIT
            ends.append(start)
        if end - start >= LEAST_UNIT and end < len(hashes):
            ends.append(end)
            start = end
    if last and start < len(hashes):
        ends.append(len(hashes))
    return ends


def units(text: str):
    """(digests, starts, ends, words) of the units of a text by pieces, as arrays; starts and ends are in code points."""
    none = np.zeros(0, np.int64)
    open_ = (none.astype(np.uint64), none, none)
    pieces = _words(text)
    now = next(pieces, None)
    while now is not None:
        following = next(pieces, None)
        hashes, starts, ends = (np.concatenate(pair) for pair in zip(open_, now, strict=True))
        cuts = np.array(_ends(hashes, following is None), np.int64)
        if len(cuts):
            firsts = np.concatenate([[0], cuts[:-1]])
            sizes = cuts - firsts
            inside = np.arange(cuts[-1]) - np.repeat(firsts, sizes)
            digests = np.add.reduceat(_mixed(hashes[: cuts[-1]] + inside.astype(np.uint64) * _ODD), firsts)
            yield digests.view(np.int64), starts[firsts], ends[cuts - 1], sizes
            open_ = (hashes[cuts[-1] :], starts[cuts[-1] :], ends[cuts[-1] :])
        else:
            open_ = (hashes, starts, ends)
        now = following


#: A unit's number in its text, its words and if it stood there before are shuffled as one number: the last bit tells
#: the latter, the other bits below WORD_BITS the words.
WORD_BITS = 8


def _gathered(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    ids, versions, numbers, *arrays, again = zip(*rows, strict=True)
    sizes = [len(a) for a in again]
    named = {"id": pa.array(ids, kind).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))}
    named["version"] = pa.array(np.repeat(versions, sizes))
    h, start, end, words = (np.concatenate(parts) for parts in arrays)
    place = np.concatenate(numbers) << WORD_BITS | words << 1 | np.concatenate(again)
    for name, values in (("h", h), ("place", place), ("start", start), ("end", end)):
        named[name] = pa.array(values, pa.int64())
    return pa.RecordBatch.from_arrays(list(named.values()), names=list(named))


def _cut(batches):
    """The units of every text, with their number in it and if they stood there before."""
    for batch in batches:
        kind = batch.schema.field(0).type
        for low in range(0, batch.num_rows, SLICE):
            rows, held = [], 0
            for id_, version, text in zip(*(c.to_pylist() for c in batch.slice(low, SLICE).columns), strict=True):
                seen, number = np.zeros(0, np.int64), 0
                for digests, starts, ends, sizes in units(text):
                    _, first = np.unique(digests, return_index=True)
                    again = np.ones(len(digests), bool)
                    again[first] = np.isin(digests[first], seen)
                    seen = np.union1d(seen, digests)
                    rows.append((id_, version, np.arange(number, number + len(digests)), digests, starts, ends, sizes, again))
                    number, held = number + len(digests), held + len(digests)
                    if held >= FLUSH:
                        yield _gathered(kind, rows)
                        rows, held = [], 0
            if rows:
                yield _gathered(kind, rows)


def repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """(id, version, start, end, n_words, kept_ids): every passage to remove, in code points of the original text.

    ``kept_ids`` are the ids of the documents that keep its units, the smallest that hold
    them; a document that repeats itself keeps its first occurrence. ``version`` tells
    apart different texts of one id (a hash of the text); rows with the same id are never
    compared with each other, and equal ones give their passages once. Rows with a NULL id
    or text give none and count for no other. Words are compared without case and ASCII punctuation; a passage is
    found but for a part of a unit at each end, if what is left has ``min_words`` words. Other columns are not read.

    Units are cut twice, once to group digests and once to find those that repeat, so only the digests that repeat
    are stored, while the plan is built. 64 bits stand for a unit: a run needs several in a row, so a chance hit
    removes nothing by itself.
    """
    need(docs, id_column, text_column)
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    plain = plain.filter("id IS NOT NULL AND text IS NOT NULL").select("id", F.xxhash64("text").alias("version"), "text")
    kind = docs.schema[id_column].dataType.simpleString()
    made = f"id {kind}, version long, h long, place long, start long, end long"
    cut = plain.mapInArrow(_cut, made)
    again = F.col("place") % 2 == 1
    firsts = cut.groupBy("h").agg(F.min("id").alias("kept"), F.max("id").alias("last"), F.max(again).alias("within"))
    # Stored, so that the join shuffles both sides by itself and a unit that very many texts hold can be split.
    firsts = durable(firsts.filter("kept < last OR within").select("h", "kept"))
    repeats = cut.join(firsts, "h").filter((F.col("id") > F.col("kept")) | again).drop("h")
    unit, words = F.shiftright("place", WORD_BITS), F.shiftright("place", 1).bitwiseAND(F.lit((1 << WORD_BITS - 1) - 1))
    document = Window.partitionBy("id", "version").orderBy("place")
    # Equal rows of an id give each unit as often as there are rows, one after the other; only the first counts.
    fresh = F.coalesce(F.lag("place").over(document) != F.col("place"), F.lit(True))
    numbered = repeats.withColumn("fresh", fresh).filter("fresh").withColumn("run", unit - F.row_number().over(document))
    whole = numbered.groupBy("id", "version", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum(words).alias("n_words"),
        F.sort_array(F.collect_set("kept")).alias("kept_ids"),
    )
    return whole.filter(F.col("n_words") >= min_words).drop("run")


KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())])


@F.arrow_udf(returnType=KEPT)
def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    kept = []
    for whole, own in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        at, left = 0, []
        for span in own or []:
            left.append(whole[at : span["start"]])
            at = span["end"]
        kept.append(whole if not own else "".join([*left, whole[at:]]))
    counts = [len(own or []) for own in spans.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(counts, pa.int64())], names=KEPT.names)


def drop_repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` without repeated passages, with ``removed``: their places in the original text, as an
    array of (start, end, kept_ids), empty if there are none. A column of that name is replaced; NULL texts stay NULL."""
    found = repeated_passages(docs, id_column, text_column, min_words)
    id_, version, own, made = (free_name(docs, n) for n in ("__id", "__version", "__spans", "__made"))
    spans = F.sort_array(F.collect_list(F.struct("start", "end", "kept_ids"))).alias(own)
    spans = found.groupBy(F.col("id").alias(id_), F.col("version").alias(version)).agg(spans)
    names = [c for c in docs.columns if c != "removed"]
    text = F.col(text_column).cast("string")
    same = (F.col(id_column) == F.col(id_)) & (F.xxhash64(text) == F.col(version))
    joined = docs.select(*names).join(spans, same, "left").withColumn(made, _without(text, F.col(own)))
    kept = [F.col(made)["text"].alias(c) if c == text_column else F.col(c) for c in names]
    nothing = F.array().cast(spans.schema[own].dataType)
    return joined.select(*kept, F.coalesce(own, nothing).alias("removed"))
