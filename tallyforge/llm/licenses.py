"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a run of one to ``MOST_LINES`` neighbouring lines that all have words, so a notice
wrapped over lines is found and no block reaches over an empty line. It is found for a template
if it contains at least ``THRESHOLD`` of the template's distinct words and all words that tell
the template from its likes. Words are ordered by how often all documents use them, rarest
first. A block that contains enough must contain one of the template's first (size - needed + 1)
words (prefix filter), have at least as many known words as needed (length filter), and at every
shared word have enough words left on both sides (positional filter). What passes is verified,
so the result is that of comparing every block with every template. Of blocks within each
other the smallest are reported, since every block around them contains the template too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, SLICE, free_name, mapped, need, texts, word_pieces

THRESHOLD = 0.8
MOST_LINES = 3

# Phrases that are looked for word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Customary notices of well-known licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "Licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

# Words without which a block is another license or another version of it.
REQUIRED = {
    "apache-2.0": "apache 2",
    "bsd": "redistribution binary",
    "cc-by-nc-4.0": "nc 4",
    "cc-by-sa-4.0": "sa 4",
    "gpl-3.0": "general public 3",
    "mit": "mit",
    "mit-text": "permission granted",
    "mpl-2.0": "mozilla 2",
}

#: Templates go to every task, so their text is bounded.
MOST_TEMPLATE_BYTES = 1 << 20


def words_of(data: bytes) -> list[bytes]:
    return data.translate(PLAIN).split()


@dataclass(frozen=True)
class Index:
    """Templates as ranked words, and for each word of a prefix the templates it may lead to."""

    rank: dict[bytes, int]
    templates: dict[str, tuple[int, ...]]
    needed: dict[str, int]
    required: dict[str, set[bytes]]
    prefixes: dict[bytes, tuple[str, ...]]
    phrases: tuple[tuple[tuple[bytes, ...], str], ...]

    def matches(self, known: set[bytes]) -> Iterator[tuple[str, float]]:
        """(template, containment) of the templates that a block's distinct known words contain."""
        candidates = {name for word in known & self.prefixes.keys() for name in self.prefixes[word]}
        if not candidates:
            return
        own = sorted(self.rank[word] for word in known)
        for name in sorted(candidates):
            wanted, needed = self.templates[name], self.needed[name]
            if not self.required[name] <= known:
                continue
            if len(own) >= needed and (shared := _overlap(wanted, own, needed)) >= needed:
                yield name, shared / len(wanted)


def _overlap(wanted: Sequence[int], own: Sequence[int], needed: int) -> int:
    """Shared words of two sorted lists; stops once too few are left to reach ``needed``."""
    i = j = shared = 0
    while i < len(wanted) and j < len(own):
        if shared + min(len(wanted) - i, len(own) - j) < needed:
            break
        if wanted[i] == own[j]:
            i, j, shared = i + 1, j + 1, shared + 1
        elif wanted[i] < own[j]:
            i += 1
        else:
            j += 1
    return shared


def build_index(
    templates: Mapping[str, str],
    phrases: Mapping[str, str],
    counts: Mapping[bytes, int],
    threshold: float,
    required: Mapping[str, str] = REQUIRED,
) -> Index:
    """The index for the given counts of words in the corpus; equal counts are ordered by word."""
    sets = {name: set(words_of(text.encode())) for name, text in templates.items()}
    if not all(sets.values()) or not 0 < threshold <= 1:
        raise ValueError("Templates must have words, and the threshold must be above 0 and up to 1")
    musts = {name: set(words_of(required.get(name, "").encode())) for name in sets}
    order = sorted(set().union(*sets.values(), *musts.values()), key=lambda w: (counts.get(w, 0), w))
    rank = {word: i for i, word in enumerate(order)}
    ranked = {name: tuple(sorted(rank[w] for w in own)) for name, own in sets.items()}
    needed = {name: ceil(threshold * len(own) - 1e-9) for name, own in ranked.items()}
    prefixes: dict[bytes, tuple[str, ...]] = {}
    for name, own in ranked.items():
        for at in own[: len(own) - needed[name] + 1]:
            prefixes[order[at]] = (*prefixes.get(order[at], ()), name)
    split = tuple((tuple(words_of(phrase.encode())), label) for phrase, label in phrases.items())
    return Index(rank, ranked, needed, musts, prefixes, split)


def _places(words: Sequence[bytes], index: Index, start: int, skip: int) -> Iterator[tuple[str, int]]:
    """(label, place) of the phrases among ``words``, which begin at word ``start`` of the text, but those
    that end within the first ``skip`` words, which were seen before."""
    there = set(words)
    for phrase, label in index.phrases:
        if not there.issuperset(phrase):
            continue
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(words[at : at + len(phrase)]) == phrase and at + len(phrase) > skip:
                yield label, start + at


def _blocks(data: bytes, index: Index, most_lines: int) -> Iterator[tuple[str, int, int, int, int, float]]:
    """(template, first line, lines, first word, words, containment) of the smallest blocks found."""
    # What the blocks of 1, 2, ... lines that end at the line before contain.
    at, lines, before = 0, [], []
    for number, line in enumerate(data.split(b"\n")):
        n, known = 0, set()
        for piece in word_pieces(line.translate(PLAIN)):
            n += len(piece)
            known.update(index.rank.keys() & piece)
        if not n:
            lines, before = [], []
            continue
        lines = [*lines, (number, at, known)][-most_lines:]
        at += n
        if not known:
            before = [{}, *before][: len(lines)]
            continue
        here, union = [], set()
        for first, word, words in reversed(lines):
            union |= words
            here.append(dict(index.matches(union)))
            shorter = here[-2].keys() | before[len(here) - 2].keys() if len(here) > 1 else ()
            for name, share in here[-1].items():
                if name not in shorter:
                    yield name, first, len(here), word, at - word, share
        before = here


def scan(data: bytes, index: Index, most_lines: int = MOST_LINES) -> tuple[int, list, list]:
    """Number of words, phrases as (label, place), and blocks as ``_blocks`` gives them."""
    reach = max((len(p) for p, _ in index.phrases), default=1) - 1
    places, total, carry, seen = [], 0, [], False
    wanted = index.prefixes.keys()
    for piece in word_pieces(data.translate(PLAIN)):
        words = carry + piece
        places.extend(_places(words, index, total - len(carry), len(carry)))
        seen = seen or not wanted.isdisjoint(piece)
        total, carry = total + len(piece), words[len(words) - reach :] if reach else []
    found = list(_blocks(data, index, most_lines)) if seen else []
    return total, sorted(places, key=lambda p: (p[1], p[0])), found


def word_counts(docs: DataFrame, words: set[bytes], text_column: str = "text") -> dict[bytes, int]:
    """How often each of the given words stands in all documents."""

    def count(batches):
        sums: Counter[bytes] = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for data in texts(batch.column(0).slice(start, SLICE)):
                    for piece in word_pieces(data.translate(PLAIN)):
                        sums.update(w for w in piece if w in words)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(text_column).cast("string")).mapInArrow(count, "word binary, n long")
    return {bytes(w): n for w, n in parts.groupBy("word").agg(F.sum("n")).collect()}


PLACE = ("label", "word")
BLOCK = ("template", "line", "n_lines", "word", "n_words", "containment")
SCANNED = (
    "n_words long, places array<struct<label:string,word:long>>, "
    "blocks array<struct<template:string,line:long,n_lines:long,word:long,n_words:long,containment:double>>"
)


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    text_column: str = "text",
    required: Mapping[str, str] = REQUIRED,
    most_lines: int = MOST_LINES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (phrases and the word they start at, from 0) and ``blocks``.

    ``blocks`` has every block of up to ``most_lines`` lines that contains at least ``threshold``
    of a template's words and all words that ``required`` names for it, unless a smaller block in
    it does: the number of its first line and of its lines, its first word, its length in words
    and the share contained. A NULL or empty text has no words and nothing is found. Columns of
    these three names are replaced. One job counts the templates' words when this is called.
    """
    need(docs, text_column)
    if most_lines < 1:
        raise ValueError("A block has at least one line")
    if sum(len(t.encode()) for t in (*templates.values(), *phrases)) > MOST_TEMPLATE_BYTES:
        raise ValueError(f"Templates of more than {MOST_TEMPLATE_BYTES} bytes")
    vocabulary = {word for text in templates.values() for word in words_of(text.encode())}
    index = build_index(templates, phrases, word_counts(docs, vocabulary, text_column), threshold, required)
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block = pa.list_(pa.struct([("template", pa.string()), *((c, pa.int64()) for c in BLOCK[1:-1]), ("containment", pa.float64())]))

    def looked(data: bytes | None) -> tuple[int, list[dict], list[dict]]:
        total, places, found = scan(data or b"", index, most_lines)
        return total, [dict(zip(PLACE, p, strict=True)) for p in places], [dict(zip(BLOCK, b, strict=True)) for b in found]

    @F.arrow_udf(returnType=SCANNED)
    def look(text: pa.Array) -> pa.Array:
        columns = mapped(text.cast(pa.large_binary()), looked, pa.int64(), place, block)
        return pa.StructArray.from_arrays(columns, names=["n_words", "places", "blocks"])

    made = ("n_words", "places", "blocks")
    names = [c for c in docs.columns if c not in made]
    found = free_name(docs, "__found")
    looked_at = docs.select(*names, look(F.col(text_column).cast("string")).alias(found))
    return looked_at.select(*names, *(f"{found}.{c}" for c in made))
