"""Removal of lines that stand in several documents, by two Bloom filters.

One pass fills a filter with the hashes seen once and another with those seen twice. Only
lines that the second filter knows are suspected of repeating; their digests alone are
shuffled, to confirm the repeats exactly and to choose the first document of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import durable
from .common import free_name, need, texts

#: Keys shorter than this, in code points, are never dropped.
MIN_LENGTH = 10

#: Cells of a filter: so many for each line, rounded up to a power of two within these limits
#: (2 ** 30 cells are 128 MB). Beyond, more lines are suspected, and results stay the same.
CELLS_PER_LINE, LEAST_CELLS, MOST_CELLS = 24, 1 << 16, 1 << 30
PROBES = 3

#: A filter is merged in chunks of so many cells.
CHUNK = 1 << 16

#: Hashes after which a task hands on what it has gathered.
FLUSH = 1 << 20


def line_key(line: bytes, min_length: int = MIN_LENGTH) -> bytes | None:
    """What a line is compared by: blanks at both ends stripped, A-Z lowered; None if too short."""
    key = line.strip().lower()
    if len(key) < min_length or (len(key) < 4 * min_length and len(key.decode()) < min_length):
        return None
    return key


def digests(data: bytes, min_length: int) -> set[bytes]:
    """Digests of the distinct keys of a text. 128 bits stand for a key: at 10^12 keys two agree by
    chance with a probability of about 10^-15."""
    keys = {line_key(line, min_length) for line in data.split(b"\n")}
    return {xxhash.xxh3_128_digest(key) for key in keys if key is not None}


def _cells(found: list[bytes], cells: int) -> np.ndarray:
    """PROBES cells for each digest, one row each."""
    halves = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((halves[:, 0] + steps * (halves[:, 1] | np.uint64(1))) & np.uint64(cells - 1)).astype(np.int64)


def _chunks(found: list[bytes], cells: int) -> pa.RecordBatch:
    """Per chunk the cells seen once or more, and those seen twice or more, as 16-bit offsets."""
    own = np.sort(_cells(found, cells), axis=0)
    first = np.ones(own.shape, bool)  # a digest counts once for a cell that it hits twice
    first[1:] = own[1:] != own[:-1]
    at, n = np.unique(own[first], return_counts=True)
    chunk, cut = np.unique(at // CHUNK, return_index=True)
    once = np.split((at % CHUNK).astype(np.uint16), cut[1:])
    many = np.split(n > 1, cut[1:])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(chunk, pa.int64()),
            pa.array([o.tobytes() for o in once], pa.binary()),
            pa.array([o[m].tobytes() for o, m in zip(once, many, strict=True)], pa.binary()),
        ],
        names=["chunk", "once", "twice"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmap of the cells seen twice, per chunk; the parts of a chunk come one after the other."""
    now, seen = None, None

    def result():
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int64()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())],
            names=["chunk", "bits"],
        )

    for batch in batches:
        for chunk, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk != now:
                if now is not None:
                    yield result()
                now, seen = chunk, np.zeros(CHUNK, np.uint8)
            seen[np.frombuffer(once, np.uint16)] += 1
            seen[np.frombuffer(twice, np.uint16)] += 1
            np.minimum(seen, 2, out=seen)
    if now is not None:
        yield result()


def _seen_twice(docs: DataFrame, min_length: int) -> np.ndarray:
    """The filter of hashes that two documents or more may hold, as bits."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0
    cells = min(max(1 << ceil(log2(CELLS_PER_LINE * lines + 1)), LEAST_CELLS), MOST_CELLS)

    def fill(batches):
        found: list[bytes] = []
        for batch in batches:
            for data in texts(batch.column(0)):
                found.extend(digests(data, min_length))
                if len(found) >= FLUSH:
                    yield _chunks(found, cells)
                    found = []
        if found:
            yield _chunks(found, cells)

    parts = docs.select("text").mapInArrow(fill, "chunk long, once binary, twice binary")
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merged, "chunk long, bits binary")
    bits = np.zeros((cells // CHUNK, CHUNK // 8), np.uint8)
    for chunk, own in merged.toLocalIterator():
        bits[chunk] = np.frombuffer(own, np.uint8)
    return bits.reshape(-1)


def _suspects(docs: DataFrame, min_length: int) -> DataFrame:
    """(id, digest) of lines that the filter has seen twice. It is bounded by MOST_CELLS, so it can be sent to all tasks."""
    twice = docs.sparkSession.sparkContext.broadcast(_seen_twice(docs, min_length))

    def look(batches):
        bits = twice.value
        for batch in batches:
            ids, found = [], []
            for key, data in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = digests(data, min_length)
                found.extend(own)
                ids.extend([key] * len(own))
            if found:
                at = _cells(found, 8 * len(bits))
                hit = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
                arrays = [pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "digest"]).filter(pa.array(hit))

    kind = docs.schema["id"].dataType.simpleString()
    return docs.filter("id IS NOT NULL").select("id", "text").mapInArrow(look, f"id {kind}, digest binary")


def repeated_lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, digest) of every line to drop from a document, for ``docs`` with the columns id and text."""
    suspects = durable(_suspects(docs, min_length))
    firsts = suspects.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    firsts = durable(firsts.filter("first < last").select("digest", "first"))
    return suspects.join(firsts, "digest").filter("id <> first").select("id", "digest")


def _remover(min_length: int):
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    @F.arrow_udf(returnType=kind)
    def remove(text: pa.Array, drops: pa.Array) -> pa.Array:
        rows = []
        for data, drop in zip(text.cast(pa.large_binary()).to_pylist(), drops.to_pylist(), strict=True):
            if not drop:
                rows.append({"text": data, "n_lines": (data or b"").count(b"\n") + 1, "n_dropped": 0})
                continue
            gone, lines = set(drop), (data or b"").split(b"\n")
            keys = (line_key(line, min_length) for line in lines)
            kept = [line for line, key in zip(lines, keys, strict=True) if key is None or xxhash.xxh3_128_digest(key) not in gone]
            rows.append({"text": b"\n".join(kept), "n_lines": len(lines), "n_dropped": len(lines) - len(kept)})
        fields = [("text", pa.binary()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]
        made = pa.array(rows, pa.struct(fields))
        return pa.StructArray.from_arrays([made.field(0).cast(pa.string()), made.field(1), made.field(2)], names=[n for n, _ in fields])

    return remove


def drop_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = MIN_LENGTH
) -> DataFrame:
    """``docs`` without the lines that a document with a smaller id holds too, plus ``n_lines`` and ``n_dropped``.

    Lines are compared with blanks at both ends stripped and A-Z lowered, if that leaves
    ``min_length`` code points or more. All other lines stay, joined by line feeds; n_lines
    counts lines before dropping. A NULL text stays NULL and has one line. Rows with the
    same id are one document; rows with a NULL id are left as they are and count for no
    other. Columns called n_lines or n_dropped are replaced, all others kept.
    """
    need(docs, id_column, text_column)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    drops = durable(repeated_lines(plain, min_length).groupBy("id").agg(F.collect_list("digest").alias("drops")))
    of, gone, made = (free_name(docs, n) for n in ("__id", "__drops", "__made"))
    joined = docs.select(*names).join(drops.toDF(of, gone), F.col(id_column) == F.col(of), "left")
    done = joined.withColumn(made, _remover(min_length)(F.col(text_column), F.col(gone)))
    kept = [F.col(f"{made}.text").alias(c) if c == text_column else F.col(c) for c in names]
    return done.select(*kept, f"{made}.n_lines", f"{made}.n_dropped")
