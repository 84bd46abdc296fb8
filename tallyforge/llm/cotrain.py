"""Quality classifier by co-training.

One naive Bayes classifier reads what a text says (its words, their shapes and how shapes
follow each other), another what kind of page it is (language, source, length, lines,
shares of symbols, capitals and repeated words). Each round they mark the unlabelled
documents they are sure of for each other. The two views, calibrated on labelled documents
held out from training, are then combined to score all documents.

Training counts features over all labelled and all unlabelled documents; nothing is
sampled. The driver holds the models, whose size is fixed by ``TEXT_SPACE``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from math import exp, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import durable
from .common import SLICE, free_name, need, texts, word_pieces

#: Numbers of features of the text view and of the page view; names are hashed into them.
TEXT_SPACE, PAGE_SPACE = 1 << 14, 1 << 10

ROUNDS = 2

#: A view marks documents of which it is surer than this.
SURE = 0.95

#: Every so manieth labelled document is held out for calibration.
HELD_OUT = 4

#: Scores are counted in so many bins to calibrate them, so the counts are small however many documents there are.
BINS, EDGE = 2000, 20.0

_SHIFT = TEXT_SPACE.bit_length() - 1
_RUN = re.compile(rb"([aA0u])\1+")
_SIGNS = bytes(
    ord("u") if b >= 128 else ord("0") if 48 <= b <= 57 else ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 else b
    for b in range(256)
)


def _shape(word: bytes) -> bytes:
    """A word with runs of letters and digits cut to one sign each: ``The,`` is ``Aa,``."""
    if word.isalpha() and word.islower():
        return b"a"
    return _RUN.sub(rb"\1", word.translate(_SIGNS))[-6:]


class _Words(dict):
    """Features of words, as one number for the word and its shape, remembered as words recur.
    Forgets all at ``most`` words to stay small."""

    most = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        shape = xxhash.xxh32_intdigest(_shape(word)) % TEXT_SPACE
        got = self[word] = (xxhash.xxh32_intdigest(word.lower(), 1) % TEXT_SPACE) << _SHIFT | shape
        return got


#: One for each worker process.
_WORDS = _Words()


def _kind(byte: int) -> int:
    sign = bytes([byte])
    if sign.isspace():
        return ord(" ")
    if sign.isalpha() or byte >= 128:
        return ord("A" if sign.isupper() else "a")
    return ord("0" if sign.isdigit() else "." if sign in b".,;:?'\"()-" else "#")


KINDS = bytes(map(_kind, range(256)))


def _level(share: float) -> int:
    """A share as a whole number: 0 for none, then one more for each doubling."""
    return int(log2(share * 1024) + 1) if share >= 1 / 1024 else 0


def _page(marks: Sequence[str]) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh64_intdigest(m.encode()) % PAGE_SPACE for m in marks], np.uint16))


def features(data: bytes, metadata: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Features of the text view and of the page view, as distinct numbers."""
    found, distinct, n_words, same, last = np.zeros(TEXT_SPACE, bool), set(), 0, 0, -1
    for piece in word_pieces(data):
        if not piece:
            continue
        own = np.fromiter(map(_WORDS.__getitem__, piece), np.int64, len(piece))
        words, shapes = own >> _SHIFT, own & (TEXT_SPACE - 1)
        found[words] = True
        found[shapes] = True
        found[(shapes[:-1] * 31 + shapes[1:]) & (TEXT_SPACE - 1)] = True
        distinct.update(piece)
        n_words += len(piece)
        same += int(np.count_nonzero(words[1:] == words[:-1])) + int(last == words[0])
        last = words[-1]
    text = np.flatnonzero(found)
    kinds = data.translate(KINDS)
    visible = max(len(kinds) - kinds.count(b" "), 1)
    lines = data.count(b"\n") + 1
    marks = [f"meta{i}={value}" for i, value in enumerate(metadata)]
    marks += [f"{sign}{_level(kinds.count(sign.encode()) / visible)}" for sign in "A0.#"]
    marks += [f"size{len(data).bit_length()}", f"lines{lines.bit_length()}", f"long{(n_words // lines).bit_length()}"]
    marks += [f"new{int(10 * len(distinct) / max(n_words, 1))}", f"same{_level(same / max(n_words, 1))}"]
    return text.astype(np.uint16), _page(marks)


def packed(found: np.ndarray) -> bytes:
    """Rising numbers as the gaps between them, a byte each; a zero byte stands for 255 to be added to the gap."""
    gaps = np.diff(found.astype(np.int64), prepend=-1) - 1
    out = np.zeros(len(gaps) + int((gaps // 255).sum()), np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255 + 1
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return (np.cumsum(np.where(gaps == 0, 255, gaps), dtype=np.int64) - 1)[gaps != 0]


# --- models ------------------------------------------------------------------------


@dataclass(frozen=True)
class View:
    """Log-odds of each feature, and the line that turns their sum or mean into calibrated log-odds."""

    odds: np.ndarray
    mean: bool
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, found: np.ndarray) -> float:
        if not len(found):
            return 0.0
        own = self.odds[found]
        return float(10 * own.mean() if self.mean else own.sum())

    def logit(self, found: np.ndarray) -> float:
        return self.slope * self.raw(found) + self.offset


@dataclass(frozen=True)
class Model:
    """Both views and the calibration of their sum; ``text`` is None if the labels teach nothing."""

    text: View | None
    page: View | None
    prior: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def together(self, text: np.ndarray, page: np.ndarray) -> tuple[float, float, float]:
        a, b = self.text.logit(text), self.page.logit(page)
        return a, b, a + b - self.prior


def sigmoid(x: float) -> float:
    return 1 / (1 + exp(-max(min(x, 40.0), -40.0)))


def fit_line(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Logistic regression of quality on one score, given counts per score, by Newton's method."""
    weights, both = np.zeros(2), good + bad
    rows = np.stack([bins, np.ones_like(bins)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(weights @ rows, -40, 40)))
        slope = rows @ (good - both * p) - 1e-3 * weights
        curve = (rows * (both * p * (1 - p))) @ rows.T + 1e-3 * np.eye(2)
        weights = weights + np.clip(np.linalg.solve(curve, slope), -5, 5)
    return float(weights[0]), float(weights[1])


def _odds(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Naive Bayes log-odds: the share of good documents that have a feature by that of bad ones."""
    share = (counts + 0.5) / (docs[:, None] + 1)
    return np.log(share[1]) - np.log(share[0])


# --- training ----------------------------------------------------------------------


def _sliced(text: pa.Array, meta: Sequence[pa.Array]):
    """(texts, metadata) of a few rows at a time, as an Arrow batch may hold thousands."""
    for start in range(0, len(text), SLICE):
        own = [m.slice(start, SLICE).to_pylist() for m in meta]
        data = texts(text.slice(start, SLICE))
        yield data, list(zip(*own, strict=True)) or [()] * len(data)


def _featured(metadata: int):
    kind = T.StructType([T.StructField(c, T.BinaryType()) for c in ("text", "page")])

    @F.arrow_udf(returnType=kind)
    def look(text: pa.Array, *meta: pa.Array) -> pa.Array:
        parts = [[pa.array([], pa.binary())] for _ in range(2)]
        for data, own in _sliced(text, meta[:metadata]):
            rows = [tuple(map(packed, features(d, o))) for d, o in zip(data, own, strict=True)]
            for part, values in zip(parts, zip(*rows, strict=True), strict=True):
                part.append(pa.array(values, pa.binary()))
        return pa.StructArray.from_arrays([pa.concat_arrays(p) for p in parts], names=["text", "page"])

    return look


def _rows(batch: pa.RecordBatch):
    for text, page, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        yield unpacked(text), unpacked(page), y


def _counted(frame: DataFrame, marks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of text features, of page features, and of documents for either, by class.

    ``marks(text, page, y)`` gives the class that a document has for each view, or None.
    """

    def count(batches):
        sums = [np.zeros((2, TEXT_SPACE + 1), np.int64), np.zeros((2, PAGE_SPACE + 1), np.int64)]
        for batch in batches:
            for text, page, y in _rows(batch):
                for own, found, mark in zip(sums, (text, page), marks(text, page, y), strict=True):
                    if mark is not None:
                        own[mark, found] += 1
                        own[mark, -1] += 1
        for view, own in enumerate(sums):
            mark, at = np.nonzero(own)
            arrays = [np.full(len(at), view), mark, at, own[mark, at]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["view", "mark", "at", "n"])

    parts = frame.select("text", "page", "y").mapInArrow(count, "view long, mark long, at long, n long")
    sums = [np.zeros((2, TEXT_SPACE + 1)), np.zeros((2, PAGE_SPACE + 1))]
    for view, mark, at, n in parts.groupBy("view", "mark", "at").agg(F.sum("n")).collect():
        sums[view][mark, at] = n
    return sums[0][:, :-1], sums[1][:, :-1], sums[0][:, -1], sums[1][:, -1]


def _histogram(frame: DataFrame, score) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, good, bad): labelled documents by score, per ``score(text, page)`` value; one row per score."""

    def count(batches):
        sums: np.ndarray | None = None
        for batch in batches:
            for text, page, y in _rows(batch):
                values = np.clip(np.array(score(text, page)), -EDGE, EDGE)
                sums = np.zeros((len(values), 2, BINS + 1), np.int64) if sums is None else sums
                sums[np.arange(len(values)), y, ((values + EDGE) * BINS / (2 * EDGE)).astype(int)] += 1
        if sums is not None:
            which, y, at = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (which, y, at, sums[which, y, at])], names=["w", "y", "at", "n"])

    parts = frame.select("text", "page", "y").mapInArrow(count, "w long, y long, at long, n long")
    rows = parts.groupBy("w", "y", "at").agg(F.sum("n")).collect()
    sums = np.zeros((1 + max([r[0] for r in rows], default=0), 2, BINS + 1))
    for which, y, at, n in rows:
        sums[which, y, at] = n
    return np.arange(BINS + 1) * (2 * EDGE / BINS) - EDGE, sums[:, 1], sums[:, 0]


def _calibrated(held: DataFrame, text: View, page: View) -> tuple[View, View]:
    bins, good, bad = _histogram(held, lambda t, p: (text.raw(t), page.raw(p)))
    lines = [fit_line(bins, good[i], bad[i]) for i in (0, 1)]
    return View(text.odds, text.mean, *lines[0]), View(page.odds, page.mean, *lines[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    metadata: Sequence[str] = ("lang", "source"),
    rounds: int = ROUNDS,
    sure: float = SURE,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> Model:
    """Train on all of ``docs``, with ``labels`` (id, quality 0 or 1) for some of them.

    Contradicting labels of an id count for nothing, repeated ones once per row of docs.
    Without good and bad documents among both the training and the held-out labels, the
    model is empty.
    """
    need(docs, id_column, text_column, *metadata)
    need(labels, id_column, label_column)
    quality = F.col(label_column)
    known = labels.filter(F.col(id_column).isNotNull() & quality.isin(0, 1)).groupBy(F.col(id_column).alias("__id"))
    known = known.agg(F.min(quality).cast("int").alias("y"), F.max(quality).alias("__most")).filter("y = __most")
    known = durable(known.select("__id", "y"))
    look = _featured(len(metadata))(F.col(text_column), *(F.col(c).cast("string") for c in metadata), F.lit(""))
    seen = docs.select(F.col(id_column).alias("id"), look.alias("f")).select("id", "f.text", "f.page")
    frame = seen.join(known, F.col("id") == F.col("__id"), "left")
    held_out = F.col("y").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0)
    frame = durable(frame.select("text", "page", "y", held_out.alias("held")))
    held, gold = frame.filter("held"), frame.filter("NOT held AND y IS NOT NULL")
    shares = {r[0]: r[1] for r in held.groupBy("y").count().collect()}
    text_gold, page_gold, docs_gold, _ = _counted(gold, lambda text, page, y: (y, y))
    if len(shares) < 2 or not docs_gold.all():
        return Model(None, None)
    prior = log(shares[1] / shares[0])
    text, page = View(_odds(text_gold, docs_gold), True), View(_odds(page_gold, docs_gold), False)
    text, page = _calibrated(held, text, page)
    edge = log(sure / (1 - sure))

    def mark(logit: float) -> int | None:
        return 1 if logit >= edge else 0 if logit <= -edge else None

    for _ in range(rounds):
        now = (text, page)
        offers = _counted(
            frame.filter("y IS NULL"), lambda t, p, y, now=now: (mark(now[1].logit(p)), mark(now[0].logit(t)))
        )
        odds = []
        for own, gained, extra in ((text_gold, offers[0], offers[2]), (page_gold, offers[1], offers[3])):
            weight = np.minimum(1.0, docs_gold / np.maximum(extra, 1))  # marks never outweigh true labels
            odds.append(_odds(own + weight[:, None] * gained, docs_gold + weight * extra))
        text, page = _calibrated(held, View(odds[0], True), View(odds[1], False))
    model = Model(text, page, prior)
    bins, good, bad = _histogram(held, lambda t, p: model.together(t, p)[2:])
    return Model(text, page, prior, *fit_line(bins, good[0], bad[0]))


def score(
    docs: DataFrame,
    model: Model,
    metadata: Sequence[str] = ("lang", "source"),
    text_column: str = "text",
    keep_from: float = 0.5,
) -> DataFrame:
    """``docs`` with the probabilities of good quality ``text_score`` and ``page_score`` by each view and ``score``
    by both, and ``kept`` (score of ``keep_from`` or more).

    A NULL text is scored as an empty one, NULL metadata as a value of its own. With an
    empty model all scores are NULL and all documents are kept. Columns of these names
    are replaced.
    """
    need(docs, text_column, *metadata)
    names = ("text_score", "page_score", "score")
    kind = T.StructType([T.StructField(c, T.DoubleType()) for c in names])

    @F.arrow_udf(returnType=kind)
    def judge(text: pa.Array, *meta: pa.Array) -> pa.Array:
        rows = []
        for part, values in _sliced(text, meta[:-1]):
            for data, own in zip(part, values, strict=True):
                a, b, both = model.together(*features(data, own))
                rows.append((sigmoid(a), sigmoid(b), sigmoid(model.slope * both + model.offset)))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(3)], names=names)

    rest = [c for c in docs.columns if c not in (*names, "kept")]
    if model.text is None:
        nothing = [F.lit(None).cast("double").alias(c) for c in names]
        return docs.select(*rest, *nothing, F.lit(True).alias("kept"))
    found = judge(F.col(text_column), *(F.col(c).cast("string") for c in metadata), F.lit(""))
    own = free_name(docs, "__found")
    made = docs.select(*rest, found.alias(own))
    return made.select(*rest, *(f"{own}.{c}" for c in names), (F.col(f"{own}.score") >= keep_from).alias("kept"))
