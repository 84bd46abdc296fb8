"""The text operators against plain Python, with odd rows: NULLs, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import blocks, bpe, common, cotrain, licenses, linededup, mixture, passages, rules, simhash, spots, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["ba", "ne", "ti", "ro", "lu", "é", "st"]) for _ in range(rnd.randint(1, 3))) for _ in range(n)]
    for i in range(0, n, 4):
        words[i] = rnd.choice(["the", "of", "and", "der", "la"])
    ends = [w + (rnd.choice([".", ".\n", ","]) if rnd.random() < 0.2 else "") for w in words]
    return " ".join(ends)


LONG = prose(1, 40_000)

ODD_ROWS = [
    (1, prose(2, 60), "en", "a", 1),
    (2, prose(2, 60), "en", "a", 1),
    (2, prose(2, 60), "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n \x0b\x0c\r\n", "de", None, 3),
    (None, prose(2, 60), None, "b", None),
    (None, None, None, None, None),
    (6, LONG, "en", "a", 9),
    (7, "one", "", "", 3),
    (8, "'s 's're <|endoftext|> ê🙂 \u00a0 x" + "a" * 300, "fr", "c", 7),
    (9, prose(2, 60) + "\n" + prose(3, 80), "en", "a", 1),
]

CLASHES = (
    "fingerprint", "component_id", "n_lines", "n_dropped", "size", "target", "copies", "source_size", "ids", "decoded",
    "kept", "score", "failed_rule", "places", "lines", "n_words", "removed", "digest", "id", "fp", "h", "version", "unit",
    "word", "bucket", "host", "path", "rule", "verdict", "first", "key", "page", "y", "held", "count",
    "blocks", "__found", "__id", "__drops", "__made", "__coded", "__row", "__of", "__best", "__source", "__rate", "__copy",
)


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD_ROWS, SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


# --- SimHash ---------------------------------------------------------------------------


def near_by_hand(pairs):
    """Components over all pairs of rows, for rows (id, fingerprint)."""
    labels = list(range(len(pairs)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(pairs):
            for j, (_, b) in enumerate(pairs):
                if (a ^ b).bit_count() <= 3 and labels[i] != labels[j]:
                    labels[i] = labels[j] = min(labels[i], labels[j])
                    changed = True
    least = {}
    for (id_, _), label in zip(pairs, labels, strict=True):
        known = [x for x in (id_, least.get(label)) if x is not None]
        least[label] = min(known) if known else None
    return [(id_, f"{fp:016x}", least[label]) for (id_, fp), label in zip(pairs, labels, strict=True)]


def test_fingerprint_is_the_majority_of_shingle_hashes():
    import xxhash

    data = b"The  quick brown\tFox jumps"
    shingles = [b"the quick brown", b"quick brown fox", b"brown fox jumps"]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint(data) == want
    assert simhash.fingerprint(b" Two\nwords ") == xxhash.xxh64_intdigest(b"two words", seed=42)
    assert simhash.fingerprint(b" \n") == 0


def test_fingerprint_of_pieces(monkeypatch):
    whole = simhash.fingerprint(LONG.encode())
    monkeypatch.setattr("tallyforge.llm.common.PIECE", 64)
    assert simhash.fingerprint(LONG.encode()) == whole


def test_near_duplicates_with_odd_rows(odd):
    got = by_id(simhash.near_duplicates(odd).collect(), "doc_id", "fingerprint", "component_id")
    want = near_by_hand([(r[0], simhash.fingerprint((r[1] or "").encode())) for r in ODD_ROWS])
    assert got == sorted(want, key=repr)


def test_near_duplicates_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_every_close_pair_shares_a_probe(parts):
    rnd = random.Random(parts)
    dealt = simhash.group_bits(np.eye(64) * 50, 100, parts)
    thresholds = {2: [1, 1], 3: [1, 0, 0], 4: [1, -1, 0, 0]}[parts]
    used = [simhash.Part(bits, t) for bits, t in zip(dealt, thresholds, strict=True)]
    assert sorted(b for p in used for b in p.bits) == list(range(64))
    for _ in range(200):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), 3):
            y ^= 1 << b
        keys = [
            {(at, (v & p.mask) ^ f) for at, p in enumerate(used) if p.threshold >= 0 for f in p.flips}
            for v in map(simhash.signed, (x, y))
        ]
        assert keys[0] & keys[1]


def test_allocation_is_the_cheapest():
    from itertools import product

    rnd = random.Random(4)
    for _ in range(20):
        costs = [[0.0, *sorted(rnd.random() * 10 for _ in range(4))] for _ in range(4)]
        want = min(sum(c[k] for c, k in zip(costs, ks, strict=True)) for ks in product(range(5), repeat=4) if sum(ks) == 4)
        cost, chosen = simhash.allocate(costs, 4)
        assert cost == pytest.approx(want) and sum(chosen) == 4


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_LEAST", 16)
    monkeypatch.setattr(blocks, "BLOCK_MOST", 16)
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    near = {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)}
    far = {rnd.getrandbits(64) for _ in range(300)}
    fps = sorted(simhash.signed(v) for v in near | far)
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in fps], "fp long")).collect()
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 3 for a, b in links)
    roots = {v: v for v in fps}

    def find(v):
        while roots[v] != v:
            v = roots[v]
        return v

    for a, b in links:
        roots[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for v in fps:
        groups.setdefault(find(v), set()).add(v)
    want = near_by_hand([(v, v & mask) for v in fps])
    by_hand = {}
    for id_, _, least in want:
        by_hand.setdefault(least, set()).add(id_)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by_hand.values()))


def test_components_of_a_long_chain(spark):
    from tallyforge.llm.components import components

    chain = [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(100)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- line dedup ------------------------------------------------------------------------


def lines_by_hand(rows):
    held = {}
    for id_, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = linededup.line_key(line.encode())
            if id_ is not None and key is not None:
                held.setdefault(key, set()).add(id_)
    out = []
    for id_, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if id_ is None or (k := linededup.line_key(x.encode())) is None or min(held[k]) == id_
        ]
        out.append((id_, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_with_odd_rows(odd):
    got = linededup.drop_repeated_lines(odd)
    assert set(got.columns) == set(odd.columns)
    assert by_id(got.collect(), "doc_id", "text", "n_lines", "n_dropped") == lines_by_hand(ODD_ROWS)


def test_line_keys():
    assert linededup.line_key(b" \t ABC defghi \r") == b"abc defghi"
    assert linededup.line_key(b"  123456789  ") is None
    assert linededup.line_key("éééééééé".encode()) is None
    assert linededup.line_key("ÉÉÉÉÉÉÉÉÉÉ".encode()) == "ÉÉÉÉÉÉÉÉÉÉ".encode()


def test_line_dedup_does_not_hang_on_the_filter(spark, monkeypatch):
    """A filter that is far too small suspects all lines and changes nothing."""
    monkeypatch.setattr(linededup, "LEAST_CELLS", linededup.CHUNK)
    monkeypatch.setattr(linededup, "MOST_CELLS", linededup.CHUNK)
    monkeypatch.setattr(linededup, "FLUSH", 10)
    rnd = random.Random(3)
    rows = [(i, "\n".join(f"this is line {rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 9)))) for i in range(120)]
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_id(got.collect(), "doc_id", "text", "n_lines", "n_dropped") == lines_by_hand(rows)


def test_line_dedup_of_nothing(nothing):
    assert linededup.drop_repeated_lines(nothing).collect() == []


# --- mixing ----------------------------------------------------------------------------


def filled_by_hand(sizes, weights, share=1.5, most=2.0):
    """Targets by weight; whoever is over the cap gets the cap, until nobody is."""
    capped, targets = set(), [0.0] * len(sizes)
    while True:
        left = share * sum(sizes) - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        total = sum(weights[i] for i in free)
        targets = [most * sizes[i] if i in capped else left * weights[i] / total for i in range(len(sizes))]
        over = {i for i in free if targets[i] > most * sizes[i] * (1 + 1e-12)}
        if not over:
            return targets
        capped |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000], [0, 0], [], [10, 20, 30, 40, 50], [(i * 7919) % 997 for i in range(300)]])
def test_targets_fill_up(spark, sizes):
    names = [f"s{i:03}" for i in range(len(sizes) - 1)] + [None] * bool(sizes)
    table = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long").repartition(3)
    got = {r.source: r.target for r in mixture.source_targets(table).collect()}
    weights = [mixture.WEIGHTS[i % 3] for i in range(len(sizes))]
    assert got == {n: pytest.approx(t) for n, t in zip(names, filled_by_hand(sizes, weights))}


def test_mix_with_odd_rows(odd):
    plan = mixture.mix_plan(odd).collect()
    assert len(plan) == len(ODD_ROWS)
    assert by_id(plan, "doc_id", "size") == sorted(((r[0], len((r[1] or "").encode().split())) for r in ODD_ROWS), key=repr)
    assert all(r.copies <= 2 for r in plan) and len({(r.source, r.target) for r in plan}) == len({r[3] for r in ODD_ROWS})
    mixed = mixture.mix(odd)
    assert mixed.columns == odd.columns
    assert by_id(mixed.collect(), "doc_id", "text") == sorted(
        ((r.doc_id, r.text) for r in plan for _ in range(r.copies)), key=repr
    )
    assert by_id(mixture.mix_plan(odd).collect(), "doc_id", "copies") == by_id(plan, "doc_id", "copies")


def test_mix_keeps_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, 8, 9)], "doc_id long, text string, source string, __source int, __rate int, __copy int")
    assert [tuple(r) for r in mixture.mix(docs).distinct().collect()] == [(1, "a b", "x", 7, 8, 9)]


def test_mix_of_nothing(nothing):
    assert mixture.mix(nothing).collect() == []


# --- BPE -------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_with_odd_rows(odd):
    coded = bpe.encode(odd, PATH, leaf=200, round_trip=True)
    assert set(coded.columns) == set(odd.columns)
    library = Tokenizer.from_file(PATH)
    want = []
    for id_, text, *_ in ODD_ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((id_, bytes(np.array(ids, "<u4").tobytes()), library.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, bytes(r.ids), r.decoded) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    back = coded.select(bpe.decoded(F.col("ids"), PATH).alias("again"), "decoded").collect()
    assert all(r.again == r.decoded for r in back)


def test_bpe_of_nothing(nothing):
    assert bpe.encode(nothing, PATH).collect() == []


def test_joined_halves_are_the_whole():
    coder, library, rnd = bpe.codec(PATH), Tokenizer.from_file(PATH), random.Random(11)
    kinds = ["abcdefgh", "ab", "  \n\t", "'s trelvmd", "'", "!?.", "aé ß世界🙂", "12345", "the and of"]
    for _ in range(600):
        own = "".join(rnd.sample(kinds, rnd.randint(1, 3)))
        parts = (rnd.choice(own) * rnd.randint(1, 4) if rnd.random() < 0.9 else "<|endoftext|>" for _ in range(rnd.randint(0, 90)))
        text = "".join(parts)
        cut = bpe.leaves(text, ["<|endoftext|>"], rnd.choice([4, 8, 30]))
        assert "".join(cut) == text
        ids = bpe.concatenate([bpe.encode_leaf(c, coder) for c in cut], coder).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


# --- quality classifier -----------------------------------------------------------------


def quality_rows():
    good = [(i, prose(i, 80), "en", f"s{i % 3}", 0) for i in range(160)]
    junk = [(1000 + i, " ".join(f"{w}###" for w in prose(i, 60).split()), "en", f"s{i % 3}", 0) for i in range(80)]
    return good + junk


def test_classifier_tells_good_from_junk(spark):
    rows = quality_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    scored = cotrain.score(docs, cotrain.fit(docs, labels)).collect()
    assert sum(r.kept == (r.doc_id < 1000) for r in scored) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in scored)


def test_classifier_with_odd_rows_and_labels(spark, odd):
    rows = quality_rows()
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd.select(*SCHEMA_NAMES))
    odd_labels = [(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (3, 7, 0), (4, 1, 0), (4, 1, 0)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows if r[0] > 20] + odd_labels, "doc_id long, quality int, toxic int")
    model = cotrain.fit(docs, labels)
    scored = cotrain.score(odd, model)
    assert set(scored.columns) == set(odd.columns) | {"text_score", "page_score"}
    assert scored.count() == len(ODD_ROWS)
    assert cotrain.score(docs, model, metadata=("lang", "source")).filter("score IS NULL").count() == 0


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_classifier_without_labels_keeps_all(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = cotrain.score(odd, cotrain.fit(odd, labels)).collect()
    assert len(rows) == len(ODD_ROWS) and all(r.kept and r.score is None for r in rows)
    assert cotrain.score(nothing, cotrain.fit(nothing, labels)).collect() == []


def test_calibration_line():
    bins = np.array([-2.0, -1.0, 1.0, 2.0])
    slope, offset = cotrain.fit_line(bins, np.array([1.0, 10.0, 30.0, 40.0]), np.array([40.0, 30.0, 10.0, 1.0]))
    assert slope > 0.5 and abs(offset) < 0.05


# --- rules -----------------------------------------------------------------------------


def measured_by_hand(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 1000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def test_measures(spark, odd):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters"]
    extra = [(20, "a b c d e f a b c d e x a b c d e f", None, None, 0), (21, "x x x x x x x", None, None, 0), (22, "l\n\nl\n k\nl", None, None, 0)]
    docs = odd.select(*SCHEMA_NAMES).filter("doc_id IS NULL OR doc_id NOT IN (6, 8)").unionByName(spark.createDataFrame(extra, SCHEMA))
    got = by_id(rules.with_measures(docs, names).collect(), "doc_id", *names)
    want = [(r[0], *measured_by_hand(r[1])) for r in ODD_ROWS + extra if r[0] not in (6, 8)]
    assert got == sorted(want, key=repr)


def test_cascade_order_changes_nothing(odd):
    kept = by_id(rules.cascade(odd).collect(), "doc_id", "kept")
    assert kept == by_id(rules.cascade(odd, tuple(reversed(rules.RULES)), sample_rows=1).collect(), "doc_id", "kept")
    look = rules.measures(F.col("text"))
    plain = odd.select("doc_id", (~F.greatest(*(rule.fails(look) for rule in rules.RULES))).alias("kept"))
    assert kept == by_id(plain.collect(), "doc_id", "kept")


def test_cascade_asks_for_rejections_per_second():
    order = [rules.Measured(rules.RULES[0], s, r).worth for s, r in ((0.1, 0.1), (0.1, 0.2), (0.4, 0.2))]
    assert order[1] > order[0] > order[2]


def test_rules_are_timed_on_known_measures(spark):
    docs = rules.with_measures(spark.createDataFrame([(i, "one two " * i) for i in range(30)], "doc_id long, text string"), ["n_words"])
    seen = []
    asked = rules.Rule("asked", lambda m: seen.append(str(m["n_words"])) or m["n_words"] < 10)
    rules.measure_rules(docs, [asked], known={"n_words": F.col("n_words")})
    assert seen == ["Column<'n_words'>"]


def test_rules_of_nothing(nothing):
    assert rules.cascade(nothing).collect() == []


# --- licenses --------------------------------------------------------------------------


def test_licenses_against_all_pairs(spark, odd):
    texts = [
        "x All rights\nreserved. cc-by CC  BY cc by",
        "Released under MIT license terms\nredistribution and use in source or binary forms, with or without modification, are permitted",
        "licensed under the apache license version 2 0 and the gnu general public license version 3",
        "all rights reserved all rights reserved",
        "released under the",
        "a\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted\n\nb",
        "// This Source Code Form is subject to\n// the terms of the Mozilla Public\n// License, v. 2.0.\n// more",
        "Released under\n\nthe MIT License",
        "released\nunder\nthe MIT License released under the MIT license\nthe MIT License\nreleased under",
    ]
    rows = [(100 + i, t, None, None, 0) for i, t in enumerate(texts)]
    docs = odd.unionByName(spark.createDataFrame(rows, SCHEMA), allowMissingColumns=True)
    got = {}
    for r in licenses.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    sets = {name: set(licenses.words_of(t.encode())) for name, t in licenses.TEMPLATES.items()}
    for id_, text, *_ in ODD_ROWS + rows:
        r = got[id_][0] if id_ is not None else None
        if r is None:
            continue
        words = licenses.words_of((text or "").encode())
        places = [
            (label, i)
            for phrase, label in licenses.PHRASES.items()
            for i in range(len(words))
            if b" ".join(words[i : i + len(phrase.split())]) == phrase.encode()
        ]
        assert r.n_words == len(words) and sorted((p.label, p.word) for p in r.places) == sorted(places)
        lines = [licenses.words_of(line.encode()) for line in (text or "").split("\n")]
        full = set()
        for name, own in sets.items():
            must = set(licenses.words_of(licenses.REQUIRED[name].encode()))
            for a in range(len(lines)):
                for b in range(a + 1, min(a + licenses.MOST_LINES, len(lines)) + 1):
                    words = set().union(*lines[a:b])
                    if all(lines[a:b]) and must <= words and len(own & words) >= 0.8 * len(own):
                        full.add((name, a, b, len(own & words) / len(own)))
        want = {
            (name, a, b - a, sum(map(len, lines[:a])), sum(map(len, lines[a:b])), share)
            for name, a, b, share in full
            if not any(other == name and a <= c and d <= b and (c, d) != (a, b) for other, c, d, _ in full)
        }
        assert {tuple(x) for x in r.blocks} == want and len(r.blocks) == len(want)
    assert [p.word for p in got[100][0].places] == [1, 4, 6, 8]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided", {"bsd"}),
        ("This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0.", {"mpl-2.0"}),
        ("This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 1.1.", set()),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("Licensed under CC BY-NC 3.0.", set()),
        ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-4.0"}),
        ("Licensed under CC BY 4.0.", set()),
        ("Released under the terms of the BSD License", set()),
        ("Licensed under the GNU General Public License, version 2", set()),
        ("Licensed under the GNU General Public License,\nversion 3", {"gpl-3.0"}),
    ],
)
def test_licenses_told_apart(text, names):
    index = licenses.build_index(licenses.TEMPLATES, licenses.PHRASES, {}, licenses.THRESHOLD)
    assert {block[0] for block in licenses.scan(text.encode(), index)[2]} == names


def test_license_scan_in_pieces(monkeypatch):
    text = ("word " * 30 + "all rights reserved cc by ") * 20
    index = licenses.build_index(licenses.TEMPLATES, licenses.PHRASES, {}, 0.8)
    whole = licenses.scan(text.encode(), index)
    monkeypatch.setattr("tallyforge.llm.common.PIECE", 16)
    assert licenses.scan(text.encode(), index) == whole and len(whole[1]) == 40


def test_licenses_of_nothing(nothing):
    assert licenses.scan_licenses(nothing).collect() == []


# --- passages --------------------------------------------------------------------------


def plain_words(text):
    """(word, start, end) of each word, in code points."""
    return [(m.group().encode().translate(common.PLAIN), m.start(), m.end()) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]


def units_by_hand(text):
    """(words, start, end) of each unit, cut word by word."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & mask
        return x ^ (x >> 29)

    out, own = [], []
    words = plain_words(text)
    for i, word in enumerate(words):
        if own:
            joint = mixed((xxhash.xxh3_64_intdigest(words[i - 1][0]) * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(word[0])) & mask)
            if len(own) == passages.MOST_UNIT or (len(own) >= passages.LEAST_UNIT and joint % passages.CUT_EVERY == 0):
                out.append(own)
                own = []
        own.append(word)
    out += [own] if own else []
    return [(tuple(w for w, _, _ in u), u[0][1], u[-1][2]) for u in out]


def passages_by_hand(rows, min_words):
    """(id, start, end, words, kept ids) for rows with distinct ids."""
    kept, found = {}, []
    for id_, text in sorted(rows):
        seen, run, runs = set(), [], []
        for words, start, end in units_by_hand(text):
            if kept.get(words, id_) < id_ or words in seen:
                run.append((start, end, len(words), kept.get(words, id_)))
            elif run:
                runs.append(run)
                run = []
            seen.add(words)
        for run in [*runs, run]:
            if sum(u[2] for u in run) >= min_words:
                found.append((id_, run[0][0], run[-1][1], sum(u[2] for u in run), tuple(sorted({u[3] for u in run}))))
        for words in seen:
            kept.setdefault(words, id_)
    return sorted(found)


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_passages_are_those_of_plain_python(spark, monkeypatch, piece):
    monkeypatch.setattr(passages, "PIECE", piece)
    rnd = random.Random(piece)
    shared = [prose(1000 + i, rnd.randint(55, 150)) for i in range(6)] + ["é " * 90, "the same one " * 40]
    rows = []
    for i in range(40):
        parts = [prose(2000 + 10 * i + k, rnd.randint(0, 60)) for k in range(3)]
        rows.append((i, f"\n{parts[0]} {rnd.choice(shared)} {parts[1]}\t{rnd.choice(shared).upper() if i % 3 else ''} {parts[2]}"))
    rows += [(50, ""), (51, "  \n"), (52, "one"), (53, "one two " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = passages.repeated_passages(docs).collect()
    got = sorted((r.id, r.start, r.end, r.n_words, tuple(r.kept_ids)) for r in found)
    assert got == passages_by_hand(rows, passages.MIN_WORDS) and len(got) > 30


def test_whole_passages_go_and_little_else(spark):
    """Windows of 50 words that a smaller id holds are covered but for part of a unit at their ends."""
    rnd = random.Random(9)
    shared = [prose(3000 + i, 60 + 5 * i) for i in range(8)]
    rows = [(i, f"{prose(4000 + i, 80)} {rnd.choice(shared)}, {prose(5000 + i, 70)}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {i: set() for i, _ in rows}
    for r in passages.repeated_passages(docs).collect():
        gone[r.id].update(range(r.start, r.end))
    earlier, spans, kept_clean = {}, [], 0
    for i, text in rows:
        words = plain_words(text)
        keys = [tuple(w for w, _, _ in words[k : k + 50]) for k in range(len(words) - 49)]
        held = {k + j for k, key in enumerate(keys) if earlier.get(key, i) < i for j in range(50)}
        for key in keys:
            earlier.setdefault(key, i)
        covered = [all(c in gone[i] for c in range(s, e)) for _, s, e in words]
        if held:
            spans.append(sum(covered[k] for k in held) / len(held))
        kept_clean += sum(covered[k] for k in range(len(words)) if k not in held)
    assert len(spans) > 15 and sum(s >= 0.8 for s in spans) / len(spans) > 0.95 and min(spans) > 0.6
    assert kept_clean <= 2 * passages.MOST_UNIT


def test_passages_of_odd_rows(spark, odd):
    shared = prose(6000, 70)
    rows = [(1, f"Alpha. {shared} Omega."), (2, shared), (4, None), (None, shared), (5, ""), (5, shared), (5, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("removed", "__id", "__spans", "kept", "h")))
    found = passages.repeated_passages(docs).collect()
    assert sorted({(r.id, tuple(r.kept_ids)) for r in found}) == [(2, (1,)), (5, (1, 2))]  # the last unit of text 1 goes on
    kept = passages.drop_repeated_passages(docs).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "removed", "__id", "__spans", "kept", "h"}
    lengths = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, len((r.text or "").split()) < 25) for r in kept)
    assert lengths == [(False, 1, False, False), (False, 2, False, True), (False, 4, True, True), *[(False, 5, False, True)] * 3, (True, 0, False, False)]
    assert passages.repeated_passages(docs.limit(0)).collect() == []
    assert passages.drop_repeated_passages(odd).count() == len(ODD_ROWS)


# --- spots -----------------------------------------------------------------------------


def test_spots():
    same = spots.spots("The cat sat on the mat. A dog was there.")
    assert same == spots.spots("the CAT sat, on the mat! a dog WAS there")
    import xxhash

    chains = [b"the cat sat", b"the mat dog"]
    assert {xxhash.xxh32_intdigest(c) for c in chains} <= same
    assert len(spots.spots("")) == 1 and spots.spots("") != spots.spots("plain")
    assert spots.likeness(frozenset({1, 2, 3}), frozenset({2, 3, 4})) == 0.5
    assert spots.likeness(frozenset({1}), frozenset({1, 2, 3}), 0.8) == 0.0


def test_edited_neighbours(spark, monkeypatch):
    monkeypatch.setattr(spots, "RANGES_PER_PARTITION", 3)
    rows = [(i * 7 % 101, prose(i, 5 + i % 50)) for i in range(100)] + [(200, ""), (201, None), (50, prose(500, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = spots.compare_edited(docs).collect()
    assert len(got) == len(rows)
    order = sorted({r[0] for r in rows}, reverse=True)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        at = order.index(r.doc_id)
        if r.doc_id == 50 or order[(at + 1) % len(order)] == 50:
            continue
        own, after = texts[r.doc_id], texts[order[(at + 1) % len(order)]]
        changed = spots.edited(own, after)
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = map(spots.spots, (own, changed, after))
        assert (r.fingerprint, r.edited_fingerprint) == (spots.written(a), spots.written(b))
        assert (r.near_edited, r.near_next) == (spots.likeness(a, b), spots.likeness(a, c))


def test_edited_neighbours_of_odd_rows(odd, nothing, spark):
    assert spots.compare_edited(odd).count() == len(ODD_ROWS)
    assert spots.compare_edited(nothing).collect() == []
    one = spots.compare_edited(spark.createDataFrame([(None, "abcd")], "doc_id long, text string")).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abab").hexdigest()]


# --- urls ------------------------------------------------------------------------------


def test_urls_against_plain_rules(spark):
    listed = [urls.UrlRule("block", f"h{i}.example.com", "/") for i in range(0, 300, 3)]
    listed += [urls.UrlRule("allow", f"h{i}.example.com", "/ok/") for i in range(0, 300, 6)]
    listed += [urls.UrlRule("block", "net", "/"), urls.UrlRule("allow", "a.net", "/x"), urls.UrlRule("block", "com", "/bad/")]
    rnd = random.Random(2)
    pages = [
        f"{rnd.choice(['http', 'HTTPS'])}://{rnd.choice(['', 'www.', 'W.'])}{rnd.choice([f'h{rnd.randint(0, 320)}.Example.com', 'a.net', 'b.a.net', 'ea.net', 'net', 'Éx.net'])}"
        f"{rnd.choice(['', '/', '/ok/', '/ok', '/x/y', '/bad/', '?q=/ok/', '#/x'])}{rnd.choice(['', 'z', '?a://b/', '#c'])}"
        for _ in range(1500)
    ] + [None, "", "no scheme", "http://", "://net/", "http:///bad/"]
    docs = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string").withColumn("host", F.lit(1))
    got = urls.judge_urls(docs, listed).collect()
    assert len(got) == len(pages)
    for r in got:
        rest = (r.url or "").partition("://")[2] if "://" in (r.url or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [x for x in listed if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.key), default=None)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((best.key, best.verdict) if best else (None, "allow"))


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in urls.judge_urls(pages, [], otherwise="block").collect()] == ["block"]
    rule = [urls.UrlRule("block", "net", "/")]
    assert urls.judge_urls(pages.limit(0), rule).collect() == []
    assert [r.rule for r in urls.judge_urls(pages, rule).collect()] == ["net/"]
    with pytest.raises(ValueError):
        urls.judge_urls(pages, [urls.UrlRule("block", "net", "x")])


def test_packed_features_come_back():
    rnd = random.Random(8)
    for n in (0, 1, 5, 300):
        found = np.array(sorted(rnd.sample(range(cotrain.TEXT_SPACE), n)), np.int64)
        assert cotrain.unpacked(cotrain.packed(found)).tolist() == found.tolist()
    edges = np.array([0, 254, 255, 256, 765, 8191])
    assert cotrain.unpacked(cotrain.packed(edges)).tolist() == edges.tolist()


def test_spot_classes_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_LEAST", 8)
    monkeypatch.setattr(blocks, "BLOCK_MOST", 8)
    rnd, rows = random.Random(21), []
    for family in range(4):
        base = prose(900 + family, 160).split()
        for k in range(14):
            words = list(base)
            for _ in range(k % 5):
                words[rnd.randrange(len(words))] = f"new{rnd.randrange(999)}"
            rows.append((100 * family + k, " ".join(words[: len(words) - k])))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, rows[0][1])]
    got = {(r.doc_id, r.component_id) for r in spots.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(id_, spots.spots(text or "")) for id_, text in rows]
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if label[i] != label[j] and spots.likeness(a, b) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (id_, _), at in zip(sets, label, strict=True):
        if id_ is not None:
            least[at] = min(id_, least.get(at, id_))
    assert got == {(id_, least[at]) for (id_, _), at in zip(sets, label, strict=True)}
    assert len(set(least.values())) > 4


# --- pipeline ---------------------------------------------------------------------------


def test_pipeline_drops_rows_not_ids(spark):
    a, b, c, d = (prose(s, 60) for s in (81, 82, 83, 84))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c), (None, a), (None, d), (None, d), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert by_id(kept, "doc_id", "text") == sorted([(1, a), (2, b), (3, c), (None, d), (5, None)], key=repr)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder with labels: long prose is good, a few shouted signs are bad."""
    folder = tmp_path_factory.mktemp("labelled")
    good = [(100 + i, prose(7000 + i, 80), "en", "a", 0) for i in range(40)]
    bad = [(200 + i, "BUY $$$ NOW!!! " * 6 + str(i), "xx", "z", 0) for i in range(40)]
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), good, bad


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_rows_and_empty_tables(spark, odd, nothing, labelled, stage):
    """Every stage but the last returns the columns it got; none fails on NULLs, repeats or clashing names."""
    name, run = stage
    folder, good, bad = labelled
    docs = odd.unionByName(spark.createDataFrame(good + bad, SCHEMA), allowMissingColumns=True)
    out = run(spark, docs, folder)
    kept = out.collect()
    assert run(spark, nothing, folder).collect() == []
    if name == "bpe":
        assert out.columns == ["doc_id", "source", "text", "ids", "n_tokens"]
        assert len(kept) == docs.count() and all(r.n_tokens == 0 for r in kept if not r.text)
        return
    assert out.columns == docs.columns
    ids = {r.doc_id for r in kept}
    if name == "quality classifier":
        assert {r[0] for r in good} <= ids and not {r[0] for r in bad} & ids
    elif name == "line dedup":
        assert len(kept) == docs.count() and all(r.n_chars == len(r.text) for r in kept if r.text)
    elif name == "simhash near-dedup":
        prints = [simhash.fingerprint((r.text or "").encode()) for r in kept]
        assert len(set(prints)) == len(prints) and {r[0] for r in good} <= ids
    else:
        assert {r[0] for r in bad} <= ids


def test_the_pipeline_is_its_stages(spark, labelled, tmp_path):
    folder, good, bad = labelled
    rows = [*good, *bad, (300, good[0][1], "en", "a", 0), (301, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    got = by_id(corpus_pipeline.run(spark, str(tmp_path)).collect(), "doc_id", "source", "text", "ids", "n_tokens")
    assert got == by_id(docs.collect(), "doc_id", "source", "text", "ids", "n_tokens")
    ids = {r[0] for r in got}
    assert ids <= {r[0] for r in good} | {300, 301} and len(ids) > 30
    # The copy lost the lines that it shares, so no more than those too short to count are left of it.
    assert all(len(r[2] or "") < 100 for r in got if r[0] in (300, 301))
    coder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for _, _, text, coded, n in got:
        want = coder.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(coded, "<u4").tolist() == want and n == len(want)
