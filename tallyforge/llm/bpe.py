"""Byte-level BPE of whole texts, long ones in halves that are joined exactly.

A long text is halved until the parts are small, the parts are encoded by any tasks, and
then joined two by two like the branches of a tree. At each join a window of tokens on
both sides is encoded anew and grown until its first and its last token are the ones that
stood there before: every neighbouring pair of tokens then stands as in the encoding of
the whole, which makes the joined sequence that encoding.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import durable
from .common import free_name, mapped, need

#: Code points up to which a text is encoded in one go.
LEAF = 1 << 15

# How byte-level BPE parts a text before merging (public pattern of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: How far, in code points, the pattern looks past an apostrophe.
REACH = 3


def _alphabet() -> dict[str, int]:
    """The byte that each character of the vocabulary's alphabet stands for: printable Latin-1 characters
    stand for their own codes, the characters from 256 on for the other bytes in turn."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def codec(path: str) -> tiktoken.Encoding:
    """The encoder for a byte-level BPE file in the format of the tokenizers library.

    Each process reads the file once. Ids must rise with the order of merges, as in the public files.
    """
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    alphabet, special = _alphabet(), {t["content"]: t["id"] for t in data["added_tokens"]}
    vocabulary = data["model"]["vocab"]
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    merges = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
    made = [vocabulary[a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode_leaf(text: str, coder: tiktoken.Encoding) -> np.ndarray:
    return coder.encode_to_numpy(text, allowed_special="all").astype("<u4")


def _may_cut(text: str, at: int, special: list[str]) -> bool:
    """Whether the pattern's parts on both sides, but those that touch the cut, are parts of the whole text."""
    around = text[max(0, at - REACH) : at + REACH]
    blank = [c.isspace() for c in around]
    if not blank[min(at, REACH)] or blank[min(at, REACH) - 1]:  # else it is before a blank after a word: always an end
        if "'" in around or (any(blank) and not all(blank)):
            return False
    return all(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) < 0 for s in special)


def _cut_near(text: str, start: int, end: int, special: list[str]) -> int | None:
    """A place to cut in the middle half of text[start:end], best before a blank and near the middle."""
    middle, reach = (start + end) // 2, (end - start) // 4
    for at in (text.rfind(" ", middle - reach, middle), text.find(" ", middle, middle + reach)):
        if at > start and not text[at - 1].isspace() and _may_cut(text, at, special):
            return at
    for step in range(reach):
        for at in (middle - step, middle + step + 1):
            if _may_cut(text, at, special):
                return at
    return None


def leaves(text: str, special: list[str], leaf: int = LEAF) -> list[str]:
    """The text in parts of ``leaf`` code points at most, or larger where no place to cut is safe."""
    done, todo = [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        cut = _cut_near(text, start, end, special) if end - start > leaf else None
        if cut is None:
            done.append(text[start:end])
        else:
            todo += [(cut, end), (start, cut)]
    return done


def _whole_start(data: bytes) -> bool:
    return not data or data[0] & 0xC0 != 0x80


def join(left: np.ndarray, right: np.ndarray, coder: tiktoken.Encoding) -> np.ndarray:
    """Ids of two neighbouring texts as ids of their concatenation."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    width = 1
    while True:
        a, b = left[-width:], right[:width]
        first, last = len(a) == len(left), len(b) == len(right)
        text = coder.decode_bytes([*a.tolist(), *b.tolist()])
        after = b"" if last else coder.decode_single_token_bytes(int(right[len(b)]))
        if _whole_start(text) and _whole_start(after):
            made = encode_leaf(text.decode(), coder)
            if (first or made[0] == a[0]) and (last or made[-1] == b[-1]):
                return np.concatenate([left[: len(left) - len(a)], made, right[len(b) :]])
        width *= 2


def concatenate(parts: list[np.ndarray], coder: tiktoken.Encoding) -> np.ndarray:
    """Join neighbours two by two until one sequence is left."""
    while len(parts) > 1:
        pairs = [join(a, b, coder) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = pairs + parts[2 * len(pairs) :]
    return parts[0]


def decode_ids(ids: np.ndarray, coder: tiktoken.Encoding) -> str:
    return coder.decode_bytes(ids.tolist()).decode("utf-8", "replace")


CODED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def _struct(columns: list[pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays(columns, names=CODED.names)


def _results(ids: np.ndarray, coder: tiktoken.Encoding, back: bool) -> tuple[bytes, str | None]:
    return ids.tobytes(), decode_ids(ids, coder) if back else None


def _coded(path: str, back: bool):
    @F.arrow_udf(returnType=CODED)
    def encode(text: pa.Array) -> pa.Array:
        coder = codec(path)
        return _struct(mapped(text, lambda t: _results(encode_leaf(t or "", coder), coder, back), pa.binary(), pa.string()))

    return encode.asNondeterministic()  # else the optimizer encodes anew for each use of the result


def _leaved(path: str, leaf: int):
    @F.arrow_udf(returnType=T.ArrayType(T.StringType()))
    def cut(text: pa.Array) -> pa.Array:
        special = sorted(codec(path).special_tokens_set)
        return mapped(text, lambda t: (leaves(t or "", special, leaf),), pa.list_(pa.string()))[0]

    return cut


def _concatenated(path: str, back: bool):
    @F.arrow_udf(returnType=CODED)
    def tree(parts: pa.Array) -> pa.Array:
        coder = codec(path)

        def whole(row: list[bytes]) -> tuple[bytes, str | None]:
            return _results(concatenate([np.frombuffer(p, "<u4") for p in row], coder), coder, back)

        return _struct(mapped(parts, whole, pa.binary(), pa.string()))

    return tree.asNondeterministic()


def decoded(ids: Column, path: str) -> Column:
    """The text of a column of ids as made by ``encode``; NULL where that is NULL, bytes that are no UTF-8 replaced."""

    @F.arrow_udf(returnType=T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        coder = codec(path)
        return mapped(ids, lambda v: (None if v is None else decode_ids(np.frombuffer(v, "<u4"), coder),), pa.string())[0]

    return decode(ids)


def encode(
    docs: DataFrame, path: str, text_column: str = "text", leaf: int = LEAF, round_trip: bool = False
) -> DataFrame:
    """``docs`` with ``ids``: the ids of each whole text as little-endian unsigned 32-bit numbers.

    They are those of the tokenizers library for the file at ``path``, which all executors
    must be able to read: no special tokens are added, and those that stand in a text are
    recognised. With ``round_trip`` the ids are decoded again into a column ``decoded``. A
    NULL text is empty and has no ids. Columns of these names are replaced.
    Texts of more than ``leaf`` code points are stored once, with a number for each row,
    and their parts are spread over the tasks; repeated rows and ids do no harm.
    """
    need(docs, text_column)
    made = ["ids", "decoded"] if round_trip else ["ids"]
    names = [c for c in docs.columns if c not in made]
    size = F.coalesce(F.length(text_column), F.lit(0))
    coded, row, of = (free_name(docs, n) for n in ("__coded", "__row", "__of"))
    short = docs.filter(size <= leaf).select(*names, _coded(path, round_trip)(F.col(text_column)).alias(coded))
    long = docs.filter(size > leaf).select(*names, F.monotonically_increasing_id().alias(row))
    long = durable(long)
    parts = long.select(F.col(row).alias("row"), F.posexplode(_leaved(path, leaf)(F.col(text_column))).alias("part", "text"))
    spread = parts.repartition("row", "part").select("row", "part", _coded(path, False)(F.col("text"))["ids"].alias("ids"))
    ordered = spread.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    tree = _concatenated(path, round_trip)(F.col("parts.ids"))
    whole = ordered.select(F.col("row").alias(of), tree.alias(coded))
    joined = long.join(whole, F.col(row) == F.col(of)).select(*names, coded)
    return short.unionByName(joined).select(*names, *(f"{coded}.{c}" for c in made))
