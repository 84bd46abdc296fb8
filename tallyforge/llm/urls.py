"""URL filtering by a cascade of Bloom filters.

Rules name a host and the start of a path. A page's host ends and path starts give the keys
that could be rules. The first filter of a cascade holds the listed keys, the second those
keys of the corpus that the first lets through by mistake, the third the listed keys that
the second lets through, and so on until none is left. Over the keys from which it was
built, which are all that the pages have, the cascade answers exactly, and pages are judged
by expressions alone, with no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import durable
from .common import free_name, lower_ascii, need

ALLOW, BLOCK = "allow", "block"

#: Share of mistakes of all filters but the first, whose share is chosen so that about as many other
#: keys pass it as are listed.
LATER = 0.5

WORD_BITS = 64


@dataclass(frozen=True)
class UrlRule:
    """Verdict for a host with its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


def checked(rules: Sequence[UrlRule]) -> list[UrlRule]:
    """The rules, if each has a known verdict, a host without a slash, a path with one in front, and no twin."""
    for rule in rules:
        if rule.verdict not in (ALLOW, BLOCK) or not rule.host or "/" in rule.host or rule.path[:1] != "/":
            raise ValueError(f"Not a rule: {rule}")
    if len({r.key for r in rules}) < len(rules):
        raise ValueError("Two rules for the same host and path")
    return list(rules)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without ``://`` or for NULL."""
    parts = r"://([^/?#]*)([^?#]*)"
    empty = F.lit("")
    return (
        lower_ascii(F.coalesce(F.regexp_extract(url, parts, 1), empty)),
        F.coalesce(F.regexp_extract(url, parts, 2), empty),
    )


def candidate_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> list[Column]:
    """For each shape (labels of the host, length of the path) the key of a page, NULL if it is too short.

    Only shapes that some rule has can match, so there are as many keys as shapes.
    """
    labels = F.size(F.split(host, r"\."))
    return [
        F.when(
            (labels >= n) & (F.length(path) >= length),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, length)),
        )
        for n, length in shapes
    ]


def _bits(key: Column, level: int, probes: int, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(words * WORD_BITS)) for i in range(probes)]


@dataclass(frozen=True)
class Bloom:
    """A filter as one row with an array of 64-bit words."""

    level: int
    probes: int
    words: int
    table: DataFrame

    def holds(self, key: Column) -> Column:
        words, found = self.table.scalar(), F.lit(True)
        for bit in _bits(key, self.level, self.probes, self.words):
            word = F.get(words, F.floor(bit / WORD_BITS).cast("int"))
            found &= F.getbit(word, F.pmod(bit, F.lit(WORD_BITS)).cast("int")) == 1
        return found


def build_bloom(keys: DataFrame, n: int, mistakes: float, level: int) -> Bloom:
    """A filter of the ``n`` keys in column ``key``; its bits are set by tasks and gathered as one row."""
    probes = max(1, round(log2(1 / mistakes)))
    words = max(1, ceil(n * probes / log(2) / WORD_BITS))
    bit = F.explode(F.array(*_bits(F.col("key"), level, probes, words))).alias("bit")
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(WORD_BITS)).cast("int"))
    found = keys.select(bit).groupBy(F.floor(F.col("bit") / WORD_BITS).alias("id")).agg(F.bit_or(own).alias("word"))
    every = keys.sparkSession.range(words).join(found, "id", "left")
    pairs = F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
    return Bloom(level, probes, words, durable(every.agg(pairs["word"].alias("words"))))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first filter without it decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for at in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[at].holds(key), F.lit(at % 2 == 1)).otherwise(answer)
        return F.coalesce(answer, F.lit(False))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Filters that tell the listed keys from all others in ``universe`` (both: distinct keys in column ``key``).

    Their size follows the number of listed keys, times the logarithm of how many more keys
    the universe has, and so is bounded by the list of rules.
    """
    n, everything = listed.count(), universe.count()
    if not n:
        return Cascade(())
    levels = [build_bloom(listed, n, min(LATER, n / max(everything, 1)), 0)]
    passed = universe.filter(levels[0].holds(F.col("key"))).join(listed, "key", "left_anti")
    sets = [listed, durable(passed)]
    while n := sets[-1].count():
        levels.append(build_bloom(sets[-1], n, LATER, len(levels)))
        sets.append(durable(sets[-2].filter(levels[-1].holds(F.col("key")))))
    return Cascade(tuple(levels))


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule], url_column: str = "url", otherwise: str = ALLOW
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the key of the longest rule that fits, else NULL) and ``verdict``.

    ``verdict`` is the rule's, or ``otherwise`` where none fits. A NULL url, or one without
    ``://``, has an empty host and path and no rule. Repeated rows are judged alike.
    Columns of these four names are replaced.
    """
    need(pages, url_column)
    rules = checked(rules)
    shapes = sorted({r.shape for r in rules})
    host, path = split_url(F.col(url_column).cast("string"))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*names, host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    nothing = F.array().cast("array<struct<n:int,key:string,verdict:string>>")
    fits = [nothing]
    if rules:
        universe = split.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct()
        universe = durable(universe)
        for verdict in (ALLOW, BLOCK):
            own = [F.struct(F.lit(r.key).alias("key")) for r in rules if r.verdict == verdict]
            if own:
                one = pages.sparkSession.range(1)
                cascade = build_cascade(durable(one.select(F.inline(F.array(*own)))), universe)
                fits += [
                    F.when(cascade.holds(k), F.array(F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict"))))
                    .otherwise(nothing)
                    for k in keys
                ]
    best = F.array_max(F.concat(*fits))
    found = free_name(pages, "__best")
    judged = split.select("*", best.alias(found))
    verdict = F.coalesce(f"{found}.verdict", F.lit(otherwise)).alias("verdict")
    return judged.select(*names, "host", "path", F.col(f"{found}.key").alias("rule"), verdict)
