"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by itself: *punctuation* (symbols or exclamation marks in place of
prose), *navigation* (separators, or a stub of a few words without a closing mark) and *boilerplate*
(site and licence phrases). Failing lines are removed; a document that loses too much of its text that
way, or fails the base counts, is rejected.

Nothing is shuffled: each row is judged where it was read. The only super-linear step is the sort of
one text's own three-word windows.

Defined cases: a null text counts as empty; an empty text has no words and fails the base rule; rows
with equal ids or texts are judged one by one; other columns pass through and may have any name,
because the working columns live in one struct.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Base rule: too few words, or more than this share of words in repeated three-word windows.
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: A line fails from this many symbols, or separators, in a hundred words on.
SYMBOLS_PERCENT = 30
SEPARATORS_PERCENT = 25
#: Lines of so many words or fewer need a closing mark, else they are menu entries.
STUB_WORDS = 3
#: A line is boilerplate if it holds one of its phrases in so many characters: a long line of prose that
#: mentions one in passing is not.
BOILERPLATE_CHARS = 300
#: A document stays while its failing lines hold at most this share of its text.
MOST_LOST_PERCENT = 40

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
CLOSING = r"[.!?…:;。！？؟।\"'”’»)\]]\s*$"
BOILERPLATE = ("all rights reserved|terms of (use|service)|privacy policy|cookie(s| policy| settings)|"
               "click here|enable javascript|sign (in|up) (to|for|with)|log ?in to|subscribe to our|"
               "share (this|on) |powered by|back to top|lorem ipsum|licensed under|released under the")


def count_of(text: Column, chars: str) -> Column:
    """How many of a text's characters are among ``chars``; texts without any are only searched."""
    some = text.contains(chars) if len(chars) == 1 else text.rlike(f"[{chars}]")
    without = F.replace(text, F.lit(chars), F.lit("")) if len(chars) == 1 else F.translate(text, chars, "")
    return F.when(some, F.length(text) - F.length(without)).otherwise(0)


def measured(line: Column) -> Column:
    """A line with what the rules need of it. Its words are counted as its spaces tell: cheap, and alike in
    every engine."""
    return F.struct(line.alias("line"), F.length(line).alias("chars"),
                    (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"),
                    count_of(line, SYMBOLS).alias("symbols"))


def bad_punctuation(x: Column) -> Column:
    return ((x["symbols"] * 100 >= x["words"] * SYMBOLS_PERCENT)
            | ((x["words"] >= 10) & (count_of(x["line"], "!") * 100 >= x["words"] * 50)))


def is_navigation(x: Column) -> Column:
    marks = count_of(x["line"], SEPARATORS)
    return (((x["words"] <= STUB_WORDS) & ~x["line"].rlike(CLOSING))
            | ((marks >= 3) & (marks * 100 >= x["words"] * SEPARATORS_PERCENT)))


def is_boilerplate(x: Column) -> Column:
    low = F.lower(x["line"])
    # most places are passed over by the letter a phrase may start with
    return low.rlike(f"(?=[{''.join(sorted({p[0] for p in re.sub(r'[(][^)]*[)]', '', BOILERPLATE).split('|')}))}])"
                     f"(?:{BOILERPLATE})") & ((x["chars"] <= BOILERPLATE_CHARS) | (
        F.regexp_count(low, F.lit(BOILERPLATE)) * BOILERPLATE_CHARS >= x["chars"]))


def failing(judged: Column, kind: str) -> Column:
    return F.size(F.filter(judged, lambda x: x[kind])).cast("long")


def window_hashes(words: Column) -> Column:
    """The hash of each three-word window, in text order, from ``words`` as hashes."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                       lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def places_by_hash(hashes: Column) -> Column:
    """Hash and place of each window in one number, sorted: the place takes as many low bits as it needs."""
    bits = F.length(F.bin(F.size(hashes)))
    return F.sort_array(F.transform(hashes, lambda h, i: F.call_function(
        "shiftleft", F.call_function("shiftright", h, bits), bits).bitwiseOR(i.cast("long"))))


def repeated_words(sorted_: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first included."""
    bits = F.length(F.bin(F.size(sorted_)))
    top = lambda e: F.call_function("shiftright", e, bits)
    alike = F.filter(sorted_, lambda e, k: (top(F.get(sorted_, k + 1)) == top(e))
                     | ((k > 0) & (top(F.get(sorted_, k - 1)) == top(e))))
    places = F.sort_array(F.transform(alike, lambda e: e.bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)))
    # each window adds the words that the one before it does not cover
    return F.aggregate(places, F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
                       lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
                       lambda a: a["n"])


def judge(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: the base counts, ``kept``, the cleaned text and how many
    lines of each kind went. ``text`` itself stays as it is."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines = F.col(out)["words"], F.col(out)["lines"]
    parts = docs.withColumn(out, F.struct(
        F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.split(t, "\n").alias("lines")))
    split = parts.withColumn(out, F.struct(words.alias("words"), lines.alias("lines"),
                                           F.transform(words, lambda w: F.xxhash64(w)).alias("hashes")))
    filled = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = split.withColumn(out, F.struct(words.alias("words"), F.transform(filled, measured).alias("lines"),
                                            window_hashes(F.col(out)["hashes"]).alias("windows")))
    windows = F.col(out)["windows"]
    sorted_ = hashed.withColumn(out, F.struct(words.alias("words"), lines.alias("lines"), F.when(
        F.size(windows) > F.size(F.array_distinct(windows)), places_by_hash(windows)).alias("windows")))
    judged = F.transform(lines, lambda x: F.struct(
        x["line"].alias("line"), x["chars"].alias("chars"), bad_punctuation(x).alias("punctuation"),
        is_navigation(x).alias("navigation"), is_boilerplate(x).alias("boilerplate")))
    counted = sorted_.withColumn(out, F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["symbols"]).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines["line"]))).cast("long").alias("n_dup_lines"),
        F.when(windows.isNull(), 0).otherwise(repeated_words(windows)).cast("long").alias("n_repeat_words"),
        judged.alias("judged")))
    q = F.col(out)
    good = F.filter(q["judged"], lambda x: ~(x["punctuation"] | x["navigation"] | x["boilerplate"]))
    passed = counted.withColumn(out, F.struct(
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.aggregate(q["judged"], F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("all_chars"),
        F.transform(good, lambda x: x["line"]).alias("good"),
        F.size(q["judged"]).cast("long").alias("n_lines"),
        *[failing(q["judged"], kind).alias(f"n_{kind}") for kind in ("punctuation", "navigation", "boilerplate")]))
    n, lost = q["n_words"], q["all_chars"] - F.aggregate(
        q["good"], F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    base_failed = (n < MIN_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED_PERCENT * n)
    return passed.withColumn(out, F.struct(
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"),
        (~base_failed & (100 * lost <= MOST_LOST_PERCENT * q["all_chars"])).alias("kept"),
        *[q[c].alias(c) for c in ("n_lines", "n_punctuation", "n_navigation", "n_boilerplate")],
        lost.cast("long").alias("lost_chars"),
        # a text that loses no line is returned as it came, blank lines included
        F.when(F.size(q["good"]) == q["n_lines"], t)
        .otherwise(F.array_join(q["good"], "\n")).alias("text")))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their failing lines removed, in the columns they came with."""
    out = free_name("quality", docs)
    judged = judge(docs, text, out)
    # exploding a list of one or none drops rows like a filter, but is not pushed below the judging, where
    # it would be worked out again for every part of it
    one = F.explode(F.when(F.col(out)["kept"], F.array(F.col(out)["text"]))).alias(out)
    return judged.select(*docs.columns, one).select(
        *[F.col(out).alias(c) if c == text else F.col(c) for c in docs.columns])
