"""Manifest, decontamination and spelling variants against plain Python, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bindings, decontaminate, merkle, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD_ROWS = [
    (1, "Alpha beta", "en", "a", 1),
    (1, "Alpha beta", "en", "a", 1),
    (1, "other", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n \x0b", "de", None, 3),
    (None, "Alpha beta", None, "b", None),
    (None, None, None, None, None),
    (6, "word " * 30_000, "en", "a", 9),
    (7, "-", "-", "-", 0),
    (8, "ê🙂 x", "", "", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    clashes = ("leaf", "root", "path", "tree", "place", "n", "child", "spans", "items", "n_words", "found", "window", "word", "form", "key")
    return spark.createDataFrame(ODD_ROWS, SCHEMA).select("*", *(F.lit("clash").alias(c) for c in clashes))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- manifest --------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def marked(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """(root, path of each leaf) by folding runs of 16."""
    if len(leaves) == 1:
        return leaves[0], [[]]
    runs = [leaves[i : i + 16] for i in range(0, len(leaves), 16)]
    root, above = tree([sha(*run) for run in runs])
    paths = []
    for r, run in enumerate(runs):
        for i in range(len(run)):
            paths.append([("".join(run[:i]), "".join(run[i + 1 :])), *above[r]])
    return root, paths


def manifest_by_hand(rows):
    leaves = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = sha(*map(marked, (doc_id, source, lang, n_chars, text)))
        leaves.setdefault(source, []).append((doc_id, leaf))
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for source in order:
        own = sorted(leaves[source], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[source] = (own, *tree([leaf for _, leaf in own]))
    root, above = tree([built[s][1] for s in order])
    out = []
    for source, top in zip(order, above):
        own, subroot, paths = built[source]
        out += [(doc_id, leaf, subroot, root, tuple(path + top)) for (doc_id, leaf), path in zip(own, paths)]
    return sorted(out, key=repr)


def manifest_rows(df):
    return sorted(
        ((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in df.collect()), key=repr
    )


def test_manifest_with_odd_rows(odd):
    assert manifest_rows(merkle.manifest(odd)) == manifest_by_hand(ODD_ROWS)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [257, 1, 33], [300] + [2] * 20])
def test_manifest_of_trees_of_any_height(spark, sizes):
    rnd = random.Random(len(sizes))
    rows = [(i, f"text {rnd.random()}", "en", f"s{k}", i) for k, size in enumerate(sizes) for i in range(1000 * k, 1000 * k + size)]
    rnd.shuffle(rows)
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert manifest_rows(found) == manifest_by_hand(rows)
    folded = found.select("root", merkle.folded(F.col("path"), F.col("leaf")).alias("own"), merkle.folded(F.col("path"), F.lit("x")).alias("other"))
    assert folded.filter("own = root AND other <> root").count() == len(rows)


def test_manifest_keeps_columns_but_not_over_its_own(odd, nothing):
    found = merkle.manifest(odd, keep=["lang", "leaf", "doc_id"])
    assert found.columns == ["doc_id", "lang", "leaf", "subroot", "root", "path"]
    assert found.filter("leaf = 'clash'").count() == 0
    assert merkle.manifest(nothing).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(odd, keep=["nowhere"])


def test_tampered_rows_are_told(spark, tmp_path):
    rows = [(i, f"Text {i}" if i % 3 else f"text {i}", "en", "ab"[i % 2], i) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.verified for r in bindings.op11_manifest(spark, str(tmp_path)).collect()}
    assert got == {i: not (zlib.crc32(str(i).encode()) % 5 == 0 and i % 3) for i in range(200)}


# --- decontamination -------------------------------------------------------------------

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def find_by_hand(texts, items, window=10, share=1.0):
    """(n_words, hit words, items) of each text, by comparing every window with every place."""
    out = []
    for text in texts:
        own, hit, names = words_of(text), set(), set()
        for name, item in items:
            its = words_of(item)
            size = min(window, len(its))
            for i in range(len(its) - size + 1 if its else 0):
                win = its[i : i + size]
                k = min(3, size)
                needed = int(np.ceil(share * (size - k + 1) - 1e-9))
                for at in range(len(own) - size + 1):
                    here = own[at : at + size]
                    if sum(here[j : j + k] == win[j : j + k] for j in range(size - k + 1)) >= needed:
                        hit.update(range(at, at + size))
                        names.update([str(name)] if name is not None else [])
        out.append((len(own), sorted(hit), sorted(names)))
    return out


def found_rows(df):
    return [
        (r["n_words"], [w for s in r["spans"] for w in range(s.start, s.end)], list(r["items"])) for r in df.orderBy("doc_id").collect()
    ]


def passages_and_items(seed, alphabet):
    rnd = random.Random(seed)

    def prose(n):
        return " ".join(rnd.choice(alphabet) for _ in range(n))

    items = [(10, prose(25)), (2, prose(10)), (3, prose(4)), (30, prose(2)), (4, prose(1)), (5, ""), (6, None), (None, prose(12)), (2, prose(14))]
    items.append((7, items[0][1]))
    texts = ["", None, "...", prose(3)]
    for _ in range(40):
        parts = [prose(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            cut = words_of(rnd.choice(items)[1])
            start = rnd.randrange(max(len(cut) - 9, 1))
            chosen = cut[start : start + rnd.randrange(8, 16)]
            if chosen and rnd.random() < 0.4:
                chosen[rnd.randrange(len(chosen))] = "changed"
            parts += [" ".join(chosen).upper(), prose(rnd.randrange(12))]
        texts.append(rnd.choice([" ", "\n", ", "]).join(parts))
    return texts, items


@pytest.mark.parametrize("share", [1.0, 0.6])
@pytest.mark.parametrize("few", [True, False])
def test_items_are_found_where_brute_force_finds_them(spark, share, few):
    alphabet = ["a", "bé", "c"] if few else [f"w{i}" for i in range(60)]
    texts, items = passages_and_items(3, alphabet)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = found_rows(decontaminate.find_items(docs, table, share=share))
    assert got == find_by_hand(texts, items, share=share)
    assert any(n for _, n, _ in got)


def test_blocks_of_windows_and_candidates_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 7)
    texts, items = passages_and_items(4, [f"w{i}" for i in range(9)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = found_rows(decontaminate.find_items(docs, table, block_bytes=400))
    assert got == find_by_hand(texts, items)


def test_only_rare_shingles_are_looked_for():
    rows = [(b"a b c d e", ["1"]), (b"c d e f g", ["2"])]
    windows = decontaminate.Windows.of(rows, 5)
    keys = np.unique(windows.shingles()[2])
    counts = np.arange(len(keys)) + 1
    index = decontaminate.Index.of_counts(windows, counts, 1.0)
    assert len(index.of) == 2  # one shingle for each window
    assert len(decontaminate.Index.of_counts(windows, counts, 0.5).of) == 4  # two of three needed: two are looked for


def test_decontamination_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "word word"), (2, "alpha BETA")], "item_id int, text string")
    found = decontaminate.find_items(odd, items)
    assert set(found.columns) == set(odd.columns)
    assert found.filter("found = 'clash'").count() == len(ODD_ROWS)
    got = sorted((r.n_words, list(r["items"])) for r in found.collect() if r["items"])
    assert got == [(2, ["2"])] * 3 + [(30_000, ["1"])]
    assert decontaminate.find_items(nothing, items).collect() == []
    none = decontaminate.find_items(odd, items.limit(0))
    assert none.filter("size(spans) > 0 OR size(items) > 0").count() == 0 and none.count() == len(ODD_ROWS)


# --- spelling --------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = sorted((a, b), key=len, reverse=True)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(words, ratio=5):
    forms, out = {}, {}
    for word, n in words.items():
        close = [(m, other) for other, m in words.items() if near(word, other)]
        best = min(close, key=lambda c: (-c[0], c[1])) if close else None
        forms[word] = best[1] if best and best[0] >= ratio * n else None
        out[word] = (n, len(close), best[0] if forms[word] else None)
    rows = []
    for word, (n, count, form_n) in out.items():
        root = word
        while forms[root]:
            root = forms[root]
        rows.append((word, forms[word], root, n, count, form_n))
    return sorted(rows)


def variant_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("letters", ["ab", "abcdeé🙂"])
def test_variants_are_those_of_all_pairs(spark, letters):
    rnd = random.Random(len(letters))
    words = {}
    while len(words) < 150:
        words["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6)))] = rnd.choice([1, 1, 2, 5, 5, 25, 125, 700, 5000])
        if len(letters) == 2 and len(words) > 100:
            break
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert variant_rows(spelling.group_variants(df)) == variants_by_hand(words)


def test_a_long_chain_of_forms(spark):
    words = {"a" * (i + 1): 6**i for i in range(18)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r.word: r.root for r in spelling.group_variants(df).collect()} == dict.fromkeys(words, "a" * 18)


def test_many_words_differ_in_one_place(spark):
    words = {chr(0x4E00 + i) + "same": 10 + i % 7 for i in range(3000)} | {"same": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.group_variants(df, ratio=1.5)
    got = {r.word: (r.n_near, r.form) for r in found.collect()}
    best = chr(0x4E00 + 6) + "same"
    assert got["same"] == (3000, best) and got[chr(0x4E00) + "same"] == (3000, best)
    assert got[best] == (3000, None)


def test_spelling_of_odd_rows(spark, odd, nothing):
    assert sorted(r.word for r in spelling.runs(odd).filter("id < 6").collect()) == sorted(["alpha", "beta"] * 2 + ["other"])
    assert spelling.group_variants(spelling.counted(spelling.runs(nothing))).collect() == []
    counts = spelling.counted(spelling.runs(odd), 4, 3)
    assert {r.word: r.n for r in counts.collect()} == {"alpha": 3, "beta": 3, "word": 30_000}
    with_end = spark.createDataFrame([("a\0b", 9), ("a\0", 1), ("ab", 90)], "word string, n long")
    assert [r.n_near for r in spelling.group_variants(with_end).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        spelling.group_variants(counts, ratio=1)


def test_slips_of_the_query(spark, tmp_path):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdeéÉX×") for _ in range(rnd.randint(4, 9))) for _ in range(40)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(900)) for _ in range(30)] + [None, ""]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert variant_rows(bindings.op13_spelling(spark, str(tmp_path))) == variants_by_hand(words)
