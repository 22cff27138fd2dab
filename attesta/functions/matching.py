"""Do two values mean the same? A value is first brought to its *form*, a string that holds all a
matcher looks at, so a verdict only needs two forms and equal values can be merged beforehand."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t
from attesta.functions.similarity import similarity

SAME, LIKELY, DIFFERENT = "SAME", "LIKELY_SAME", "DIFFERENT"


# Fixed value: letters and digits are split where they meet
def _tokens(x: Column) -> Column:
    spaced = F.regexp_replace(F.translate(F.upper(x), "Ñ", "N"),
                              r"(?<=[A-Z])(?=\d)|(?<=\d)(?=[A-Z])", " ")
    return F.regexp_extract_all(spaced, F.lit("([A-Z0-9]+)"), F.lit(1))


def address_tokens(x) -> Column:
    """Words of an address: regions folded, abbreviations spelled out, fillers dropped."""
    x = F.upper(t._c(x))
    for pattern, word in rules.REGION_ALIASES:
        x = F.regexp_replace(x, pattern, word)
    names = t.lookup(rules.ADDRESS_ABBREVIATIONS)
    words = F.transform(_tokens(x), lambda w: F.coalesce(F.try_element_at(names, w), w))
    return F.filter(words, lambda w: ~w.isin(rules.ADDRESS_FILLERS))


def person_tokens(x) -> Column:
    return F.filter(_tokens(F.translate(t._c(x), ",", " ")),
                    lambda w: (F.length(w) > 1) & ~w.isin(rules.NAME_SUFFIXES))


ALL_KINDS = ("person", "business", "address", "tin", "tin_branch", "email", "phone",
             "business_form", "name")


def form(kind, x, kinds=ALL_KINDS) -> Column:
    """The form of a value for its matcher; null when the matcher cannot use it. ``kind`` may be a
    column; naming the ``kinds`` it can hold keeps the expression small."""
    kind, x = t._c(kind), t._c(x)
    person = F.array_join(F.array_sort(F.array_distinct(person_tokens(x))), " ")
    forms = {
        "person": F.nullif(person, F.lit("")),
        "business": t.alnum(t.business_key(x)),
        "address": F.array_join(address_tokens(x), " "),
        "tin": t.let(t.digits(x), lambda d: F.when(F.length(d) >= 9, F.substring(d, 1, 9))),
        "tin_branch": t.let(t.digits(x), lambda d: F.when(F.length(d) >= 9, F.concat_ws(
            "-", F.substring(d, 1, 9), F.regexp_replace(F.substring(d, 10, 99), "^0+", "")))),
        "email": F.lower(t.strip(x)),
        "phone": t.phone_key(x),
        "business_form": t.business_form(x, F.lit(None)),
        "name": t.normalize_name(x),
    }
    out = F.lit(None).cast("string")
    for k in kinds:
        out = F.when(kind == k, forms[k]).otherwise(out)
    return F.when(~t.blank(x), out)


def _words(f: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(f, " "), ""))


def _person(a: Column, b: Column) -> Column:
    wa, wb = _words(a), _words(b)
    nested = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    return F.when(nested & (F.least(F.size(wa), F.size(wb)) >= 2), LIKELY).otherwise(DIFFERENT)


def _address(a: Column, b: Column, clash: Column) -> Column:
    def overlap(wa, wb):
        common = F.size(F.array_intersect(wa, wb))
        small = F.least(F.size(wa), F.size(wb))
        return (F.when((small > 0) & (common == small), SAME)
                .when(common / F.greatest(small, F.lit(1)) >= 0.75, LIKELY)
                .otherwise(DIFFERENT))
    return F.when(clash, DIFFERENT).otherwise(t.let(_words(a), lambda wa: t.let(
        _words(b), lambda wb: overlap(wa, wb))))


_UNDECIDED = "?"


def _business(a: Column, b: Column, clash: Column) -> Column:
    la, lb = F.length(a), F.length(b)
    in_reach = 2.0 * F.least(la, lb) / F.greatest(la + lb, F.lit(1)) >= 0.9
    return (F.when(a.contains(b) | b.contains(a), LIKELY)
            .when(~in_reach | clash, DIFFERENT)
            .otherwise(_UNDECIDED))


def same_person(a, b) -> Column:
    """Two person forms hold the same words."""
    return F.coalesce(t._c(a) == t._c(b), F.lit(False))


def with_verdict(df, kind, a, b, name: str = "verdict", kinds=ALL_KINDS):
    """Add the verdict of two form columns. Plain expressions decide nearly all; similarity is
    computed for undecided business names only and the Python side sees null for all others."""
    kind, a, b = t._c(kind), t._c(a), t._c(b)
    texts = [k for k in ("address", "business") if k in kinds]
    clash = F.lit(False)
    if texts:
        df = df.withColumn("__clash", F.when(kind.isin(texts), t.numbers_conflict(a, b)))
        clash = F.col("__clash")
    verdict = F.lit(DIFFERENT)
    if "business" in kinds:
        verdict = F.when(kind == "business", _business(a, b, clash)).otherwise(verdict)
    if "person" in kinds:
        verdict = F.when(kind == "person", _person(a, b)).otherwise(verdict)
    verdict = F.when(a == b, SAME).otherwise(verdict)
    if "address" in kinds:
        verdict = F.when(kind == "address", _address(a, b, clash)).otherwise(verdict)
    df = df.withColumn(name, F.when(a.isNotNull() & b.isNotNull(), verdict))
    if "business" in kinds:
        open_ = F.col(name) == _UNDECIDED
        df = df.withColumn("__ratio", similarity(F.when(open_, a), F.when(open_, b)))
        df = df.withColumn(name, F.when(~open_, F.col(name)).when(
            F.col("__ratio") >= 0.9, LIKELY).when(open_, DIFFERENT)).drop("__ratio")
    return df.drop("__clash")


def agrees(verdict) -> Column:
    """SAME or LIKELY_SAME; a null verdict does not agree."""
    return F.coalesce(t._c(verdict).isin(SAME, LIKELY), F.lit(False))


RANK = {SAME: 0, LIKELY: 1, DIFFERENT: 2}


def rank(verdict) -> Column:
    """How bad a verdict is; a null verdict counts as SAME."""
    v = t._c(verdict)
    return F.when(v == DIFFERENT, 2).when(v == LIKELY, 1).otherwise(0)
