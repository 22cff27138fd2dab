"""The worst verdict within groups of forms that all resemble one of them.

Such a group may be large: a hundred thousand spellings of one address. All pairs of a group are never laid out
in one key, and most are not laid out at all:

* **What a group has in common.** Words that every address of a group holds, and the beginning that every name
  has, already make two forms similar if they are long enough for them: an address whose words are at most four
  thirds of the common ones resembles any other, and so do two names no longer than ten ninths of their common
  beginning. This needs counts by token and the first and last name, no pair. Where forms hold different numbers
  it is not used, as numbers decide before.
* **Pivots.** Each form meets a few forms of its group (the shortest, the first, the last, two by hash): one
  DIFFERENT settles a group.
* **Cells.** What is left is dealt into blocks of ``BLOCK`` forms, and each pair of blocks is a key of its own, so
  a group's pairs spread over as many tasks as they need.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.skew import attach

#: Forms of a block, and up to how many forms of a group meet without pivots.
BLOCK, FEW = 128, 64
SIDE = ("form", "lo", "hi", "at")


def _paired(rows: DataFrame, keys, a: str, b: str) -> DataFrame:
    return rows.select(*keys, "matcher", *[F.col(f"{s}.{c}").alias(p if c == "form" else f"{p}_{c}")
                                           for s, p in ((a, "a"), (b, "b")) for c in SIDE])


def _common_start(x: Column, y: Column) -> Column:
    """How many letters two texts have in common at their beginning."""
    return F.size(F.filter(F.sequence(F.lit(0), F.least(F.length(x), F.length(y))), lambda i: (i > 0) & (
        F.left(x, i) == F.left(y, i))))


def _unsafe(forms: DataFrame, keys) -> DataFrame:
    """``forms`` with ``safe``: it resembles every other safe form of its group, as an address every other."""
    words = F.array_distinct(F.array_remove(F.split("form", " "), ""))
    forms = forms.withColumn("__words", F.when(F.col("matcher") == "address", words))
    groups = forms.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.min("form").alias("__first"), F.max("form").alias("__last"),
        F.min(t.number_key("form")).alias("__low"), F.max(t.number_key("form")).alias("__high"))
    core = forms.select(*keys, F.explode("__words").alias("__w")).groupBy(*keys, "__w").agg(F.count("*").alias("__c"))
    core = core.join(groups.select(*keys, "__n"), keys).where(F.col("__c") == F.col("__n")).groupBy(*keys).agg(
        F.count("*").alias("__core"))
    groups = groups.join(core, keys, "left").withColumn("__start", _common_start(F.col("__first"), F.col("__last")))
    known = attach(forms, groups.drop("__first", "__last"), keys)
    alike = F.col("__low") == F.col("__high")
    # of names of 200 letters on similarity leaves out frequent letters, so that a common beginning says less
    safe = (F.when(F.col("matcher") == "address", (F.size("__words") > 0) & (
        4 * F.coalesce("__core", F.lit(0)) >= 3 * F.size("__words")))
            .when(F.col("matcher") == "business", (F.length("form") < 200) & (
                10 * F.col("__start") >= 9 * F.length("form"))).otherwise(False))
    return known.withColumn("safe", alike & safe).select(*forms.columns, "safe").drop("__words")


def worst_within(forms: DataFrame, keys, pair_rank: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """``keys`` and ``rest``: the worst rank of two forms of a group. ``forms`` has the keys, ``matcher``,
    ``form``, ``lo``, ``hi``, ``at`` and ``likely``, whether rank 1 is known for the group already: then only
    rank 2 is looked for, and forms that cannot have it are passed over."""
    keys = list(keys)
    marked = _unsafe(forms, keys).withColumn("safe", F.col("safe") & F.col("likely"))
    side = F.struct(*SIDE)
    stats = marked.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.sum(F.when(~F.col("safe"), 1).otherwise(0)).alias("__open"),
        F.min_by(side, F.struct(F.length("form"), "form")).alias("__p0"), F.min_by(side, "form").alias("__p1"),
        F.max_by(side, "form").alias("__p2"), F.min_by(side, F.xxhash64("form")).alias("__p3"),
        F.max_by(side, F.xxhash64("form")).alias("__p4"))
    left = attach(marked, stats.where((F.col("__open") > 0) & (F.col("__n") > 1)), keys).where(F.col("__n").isNotNull())

    pivots = left.where(F.col("__n") > FEW).select(
        *keys, "matcher", side.alias("x"), F.explode(F.array(*[F.col(f"__p{k}") for k in range(5)])).alias("y")).where(
        F.col("x.form") != F.col("y.form"))
    settled = pair_rank(_paired(pivots, keys, "x", "y")).groupBy(*keys).agg(F.max("worst").alias("rest"))
    left = attach(left, settled, keys)
    open_ = left.where(F.coalesce("rest", F.lit(0)) < 2)

    # an address that is safe resembles all; a safe name resembles safe names only, and meets the others
    meets = open_.where(~F.col("safe") | (F.col("matcher") != "address"))
    blocks = meets.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("__blocks"))
    dealt = attach(meets, blocks, keys).withColumn("__b", F.pmod(F.xxhash64("form"), F.col("__blocks")))
    last = F.col("__blocks") - 1
    low = dealt.select(*keys, "matcher", "safe", side.alias("x"), F.col("__b").alias("__low"),
                       F.explode(F.sequence(F.col("__b"), last)).alias("__high"))
    high = dealt.select(*keys, F.col("safe").alias("__too"), side.alias("y"), F.col("__b").alias("__high"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("__b"))).alias("__low"))
    pairs = low.join(high, [*keys, "__low", "__high"]).where(
        ((F.col("__low") < F.col("__high")) | (F.col("x.form") < F.col("y.form"))) & ~(F.col("safe") & F.col("__too")))
    rest = pair_rank(_paired(pairs, keys, "x", "y")).groupBy(*keys).agg(F.max("worst").alias("rest"))
    return settled.union(rest).groupBy(*keys).agg(F.max("rest").alias("rest"))
