"""Groups of spelling variants: words that one replaced, inserted or deleted code point parts.

Words are marked with a terminator and rotated (permuterm). If two words differ in one
place, the rotations that begin right behind that place agree up to the edited code point,
which stands last in them. So each rotation is filed under what stands before its last
code point (the edit skipped) and under itself (nothing skipped). In the sorted rotations,
those under one key are one range: words filed by a skipped code point are replacements of
each other, and the word filed whole is theirs with the code point deleted.

A range has at most one word for each code point there is, plus one. It is scanned in
order of use, and says for each member how many neighbours the others are and which is the
most used, so that nothing grows with the square of a range.
"""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..operators.ordered import durable
from .common import lower_ascii, need

LETTERS = r"[A-Za-zÀ-ÿ]+"

#: Ends a word in its rotations. No word may hold it.
END = "\0"

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, word): every maximal run of letters of every text, A-Z lowered. A NULL text has none."""
    need(docs, id_column, text_column)
    found = F.regexp_extract_all(F.col(text_column).cast("string"), F.lit(LETTERS), 0)
    each = docs.select(F.col(id_column).alias("id"), F.explode(found).alias("word"))
    return each.select("id", lower_ascii(F.col("word")).alias("word"))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the values of ``word`` that are long and frequent enough; NULL is no word."""
    long = words.filter(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, skips, first): the keys under which words are filed.

    ``skips`` tells if the key leaves out a code point of the word. Leaving out either of two equal neighbours gives
    the same word, so only the ``first`` of a run of equal code points stands for a deletion.
    """
    word, at = F.col("word"), F.col("at")
    before, after = F.substr(word, F.lit(1), at), F.substr(word, at + 2)
    own = F.substr(word, at + 1, F.lit(1))
    first = (at == 0) | (own != F.substr(word, at, F.lit(1)))
    placed = words.filter(~F.contains("word", F.lit(END))).select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    whole = F.struct(F.concat(F.substr(word, at + 1), F.lit(END), before).alias("key"), F.lit(False).alias("skips"), F.lit(True).alias("first"))
    skipping = F.struct(F.concat(after, F.lit(END), before).alias("key"), F.lit(True).alias("skips"), first.alias("first"))
    both = F.when(at < F.length("word"), F.array(whole, skipping)).otherwise(F.array(whole))
    return placed.select("word", "n", F.inline(both)).select("key", "word", "n", "skips", "first")


def _better(a: Column, b: Column) -> Column:
    """The more used of two words (n, word), on ties the smaller in code-point order. Either may be NULL."""
    wins = b.isNull() | (a["n"] > b["n"]) | ((a["n"] == b["n"]) & (a["word"] < b["word"]))
    return F.when(a.isNotNull() & wins, a).otherwise(b)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words (distinct, with their ``n``) that have near words; ``best`` is the most used
    of these, as (n, word)."""
    sorted_range = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    whole_range = sorted_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me, skips, first = F.struct("n", "word"), F.col("skips"), F.col("skips") & F.col("first")
    scanned = rotations(words).withColumns({
        "skipping": F.count_if(skips).over(whole_range),
        "longer": F.count_if(first).over(whole_range),
        "whole": F.first(F.when(~skips, me), ignorenulls=True).over(whole_range),
        "one": F.nth_value(F.when(skips, me), 1, ignoreNulls=True).over(whole_range),
        "two": F.nth_value(F.when(skips, me), 2, ignoreNulls=True).over(whole_range),
        "longest": F.first(F.when(first, me), ignorenulls=True).over(whole_range),
    })
    replaced = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))
    shorter = F.when(first, F.col("whole"))
    n_near = F.when(skips, F.col("skipping") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("longer"))
    best = F.when(skips, _better(replaced, shorter)).otherwise(F.col("longest"))
    near = scanned.select("word", n_near.alias("n_near"), best.alias("best")).filter("n_near > 0")
    # Smallest of (-n, word) is the most used and on ties the smallest word.
    order = F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word"))
    found = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("best"))
    return found.select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root) of the words with a ``form``: where forms lead in up to 2 ** ``rounds`` steps.

    Every round doubles the steps. A form of many words is a hot key on one side only, which is split.
    """
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        now = durable(now)
        further = now.select(F.col("word").alias("of"), F.col("root").alias("further"))
        joined = now.join(further, F.col("root") == F.col("of"), "left")
        now = joined.select("word", F.coalesce("further", "root").alias("root"))
    return now


def group_variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words with their number of uses ``n``.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts the
    near words of a word. Its ``form`` is the one with the largest n (on ties the smallest in code-point order), if
    that is at least ``ratio`` (over 1) times its own; else NULL, as ``form_n``. ``root`` follows forms to the last
    and is the word itself without one. Rows with a NULL or repeated word must be dropped before; a word that holds
    ``END`` has no near words. Other columns are not read. Runs jobs while the plan is built.
    """
    require_columns(words, "word", "n")
    if ratio <= 1:
        raise ValueError("The ratio must be above 1, or forms might lead in circles")
    own = durable(words.select("word", F.col("n").cast("long").alias("n")))
    near = own.join(neighbours(own), "word", "left")
    fits = F.col("best.n") >= ratio * F.col("n")
    formed = durable(
        near.select(
            "word", F.when(fits, F.col("best.word")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.n")).alias("form_n"),
        )
    )
    # n grows by the ratio with every step, so this many steps reach the last form.
    most = formed.agg(F.max("form_n")).first()[0] or 1
    rounds = ceil(log2(max(log(most) / log(ratio), 1))) + 1
    found = roots(formed.filter("form IS NOT NULL"), rounds)
    return formed.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
