"""Quality rules as a short-circuit cascade.

Each rule's cost and the share of documents that it rejects are measured on a sample. The
rules are then asked in the order of rejections per cost, as the branches of one CASE
expression: a document that one rule rejects costs the later rules nothing. The order
never changes which documents are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import durable
from .common import BLANKS, need

#: Rows of the sample on which rules are timed. It bears on the order of rules only.
SAMPLE_ROWS = 1000

WINDOW = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, none for NULL."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _repeated(words: Column) -> Column:
    """How many words stand in windows of WINDOW words that are found twice or more."""

    def hashed(first: Column, at: Column) -> Column:
        return F.xxhash64(first, *(F.get(words, at + k) for k in range(1, WINDOW)))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, i - 1))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def twice(pairs: Column) -> Column:
        """Starts of the windows whose hash a neighbour in sorted order shares."""
        alike = F.filter(
            pairs,
            lambda e, i: F.coalesce(e["h"] == F.get(pairs, i - 1)["h"], F.lit(False))
            | F.coalesce(e["h"] == F.get(pairs, i + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(alike, lambda e: e["i"]))

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(found, _let(_let(pairs, twice), covered)).otherwise(0)

    windows = F.transform(F.slice(words, F.lit(1), F.size(words) - (WINDOW - 1)), hashed)
    return F.when(F.size(words) >= WINDOW, _let(windows, counted)).otherwise(0)


def _stutters(words: Column) -> Column:
    """How many words are the same as the one before."""
    return F.size(F.filter(words, lambda word, i: F.coalesce(word == F.get(words, i - 1), F.lit(False))))


def measures(text: Column) -> dict[str, Column]:
    """What rules look at, each as an expression of its own that is computed only where it is used."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": _let(lines, lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("long"),
        "n_repeat_words": _let(words_of(text), _repeated).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_stutters": _let(words_of(text), _stutters).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """A document fails if ``fails``, given the measures by name, is true."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


BASE_RULES = (
    Rule("short", lambda m: m["n_words"] < 10),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
)

RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("short words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("repeated lines", lambda m: (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    Rule("stutters", lambda m: 5 * m["n_stutters"] > m["n_words"]),
    Rule("capitals", lambda m: 10 * m["n_capitals"] > 4 * m["word_chars"]),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measure_rules(
    docs: DataFrame,
    rules: Sequence[Rule],
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    known: Mapping[str, Column] | None = None,
) -> list[Measured]:
    """Each rule's seconds and share of rejected rows on the first ``sample_rows`` rows, most rejections per second first.

    The sample is stored with the columns that ``docs`` has, and ``known`` measures are read from these as they will
    be by the cascade. A rule runs alone, twice; the faster run counts, less the time that any job takes. Only the
    partitions that hold the first rows are read, and the driver gets an answer for each.
    """
    sample = durable(docs.limit(sample_rows))

    def timed(condition: Column) -> tuple[float, float]:
        runs, hits = [], []
        for _ in range(2):
            start = time.perf_counter()
            hits = sample.select(F.coalesce(condition, F.lit(False)).alias("hit")).collect()
            runs.append(time.perf_counter() - start)
        return min(runs), sum(r.hit for r in hits) / max(len(hits), 1)

    idle, _ = timed(F.col(text_column).isNull())
    look, found = measures(F.col(text_column)) | dict(known or {}), []
    for rule in rules:
        seconds, share = timed(rule.fails(look))
        found.append(Measured(rule, max(seconds - idle, 0.0), share))
    return sorted(found, key=lambda m: -m.worth)


def cascade(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    known: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``docs`` with ``failed_rule``, the first rule in the order of the cascade that a document fails, and ``kept``.

    ``known`` gives measures that stand in columns already. A rule that yields NULL is not
    failed; a NULL text is one without words. Which rule is named may change from run to
    run where several are failed, as it depends on measured times; ``kept`` does not.
    Columns of these two names are replaced.
    """
    need(docs, text_column)
    order = measure_rules(docs, rules, text_column, sample_rows, known)
    look = measures(F.col(text_column)) | dict(known or {})
    failed = F.lit(None).cast("string")
    for found in reversed(order):
        failed = F.when(found.rule.fails(look), found.rule.name).otherwise(failed)
    names = [c for c in docs.columns if c not in ("failed_rule", "kept")]
    judged = docs.select(*names, failed.alias("failed_rule"))
    return judged.select("*", F.col("failed_rule").isNull().alias("kept"))


def with_measures(docs: DataFrame, names: Sequence[str], text_column: str = "text") -> DataFrame:
    """``docs`` with the named measures as columns."""
    look = measures(F.col(text_column))
    return docs.select(*(c for c in docs.columns if c not in names), *(look[n].alias(n) for n in names))
