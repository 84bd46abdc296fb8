"""Helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that part words: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A-Z lowered, ASCII but letters and digits made blank: splitting then gives words without punctuation.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)

_BLANK = re.compile(rb"[ \t-\r]")
PIECE = 1 << 20


def texts(column: pa.Array) -> list[bytes]:
    """Arrow strings as UTF-8 bytes; null is empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of about a megabyte, so that a huge text needs no huge list.

    ``bytes.split`` parts words at exactly the characters in ``BLANKS``.
    """
    start = 0
    while len(data) - start > PIECE:
        cut = _BLANK.search(data, start + PIECE)
        if cut is None:
            break
        yield data[start : cut.start()].split()
        start = cut.end()
    yield (data[start:] if start else data).split()


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(column, UPPER, LOWER)


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, by appending underscores; case does not count."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def signed(value: int) -> int:
    """An unsigned 64-bit number as the long with the same bits."""
    return value - (1 << 64) if value >> 63 else value


#: Rows that are turned into Python values at a time; an Arrow batch may hold many more.
SLICE = 200


def mapped(column: pa.Array, make: Callable, *kinds: pa.DataType) -> list[pa.Array]:
    """``make`` of each value, which gives a tuple with a value for each of ``kinds``; one array for each."""
    parts: list[list[pa.Array]] = [[pa.array([], kind)] for kind in kinds]
    for start in range(0, len(column), SLICE):
        made = list(zip(*map(make, column.slice(start, SLICE).to_pylist()), strict=True))
        for part, values, kind in zip(parts, made, kinds, strict=True):
            part.append(pa.array(values, kind))
    return [pa.concat_arrays(part) for part in parts]
