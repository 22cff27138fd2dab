"""Facts: many sources per attribute of an account, checked against each other, one best value.

A fact row: account_id, attribute, rank, doc_pos, seq (its place), value, doc_id, file_name,
document_type, source_field, grounding, confidence, normalized.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import matching as m
from attesta.functions import text as t
from attesta.operators.resemble import worst_within
from attesta.session import keep
from attesta.skew import attach

PLACE = ["rank", "doc_pos", "seq"]
FACT = ["account_id", "attribute", *PLACE, "value", "doc_id", "file_name", "document_type",
        "source_field", "grounding", "confidence", "normalized"]
GROUP = ["account_id", "attribute"]
_OTHER_RANK = 1000   # items outside the field list come after all listed sources


def collect_facts(docs: DataFrame, fields: DataFrame,
                  source_rules: Sequence = rules.SOURCE_RULES) -> DataFrame:
    """E1. Long facts from the fields of all documents, with their preference rank. A taxpayer name
    is an owner only for sole proprietors, a form's contact only when the position says owner;
    e-mail and phone are also taken from other labelled items.

    Fields are filtered to the needed names and met with their document once; the rules are a
    small broadcast table.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(a, i, d, f) for i, (a, d, f) in enumerate(source_rules)],
        "attribute string, rank int, document_type string, source_field string")
    names = sorted({f for _, _, f in source_rules})
    head = docs.select("account_id", "doc_id", "doc_pos", "file_name", "document_type")
    held = fields.where(F.col("name").isin(names) & ~t.blank("value")).select(
        "doc_id", F.col("name").alias("source_field"), "value", "normalized", "grounding",
        "confidence")
    facts = held.join(head, "doc_id").join(
        F.broadcast(table), ["document_type", "source_field"]).withColumn("seq", F.lit(0))

    form_owner = fields.where((F.col("name") == "contact_position")
                              & F.upper("value").contains("OWNER")).select(
        "doc_id", F.lit(True).alias("__owner")).distinct()
    facts = facts.join(form_owner, "doc_id", "left").where(
        ~((F.col("attribute") == "owner_name") & (F.col("document_type") == rules.FORM_TYPE)
          & F.col("__owner").isNull())).drop("__owner")

    corporate = _corporate_accounts(head, fields).select(
        "account_id", F.lit("owner_name").alias("attribute"),
        F.lit("BIR_2303").alias("document_type"))
    facts = facts.join(corporate, ["account_id", "attribute", "document_type"], "left_anti")

    if "other_fields" in docs.columns:
        facts = facts.select(FACT).unionByName(_other_facts(docs).select(FACT))
    return facts.select(FACT)


def _corporate_accounts(head: DataFrame, fields: DataFrame) -> DataFrame:
    """Accounts whose first registration certificate names no proprietor or individual."""
    kind = fields.where(F.col("name") == "taxpayer_type").select(
        "doc_id", F.upper("value").alias("__type"))
    first = head.where(F.col("document_type") == "BIR_2303").join(kind, "doc_id", "left") \
        .groupBy("account_id").agg(F.min_by(F.struct("__type"), "doc_pos").alias("f"))
    text = F.coalesce("f.__type", F.lit(""))
    return first.where(~(text.contains("PROPRIETOR") | text.contains("INDIVIDUAL")))


def _other_facts(docs: DataFrame) -> DataFrame:
    items = docs.select("account_id", "doc_id", "doc_pos", "file_name", "document_type",
                        F.posexplode("other_fields").alias("seq", "o"))
    label = F.coalesce("o.label", F.lit(""))
    value = t.strip(F.coalesce("o.value", F.lit("")))
    attribute = (F.when(label.rlike(rules.EMAIL_LABEL) & value.contains("@"), "email")
                 .when(label.rlike(rules.PHONE_LABEL) & (t.phone_key(value) != ""), "phone"))
    none = F.lit(None).cast("string")
    return items.withColumn("attribute", attribute).where(F.col("attribute").isNotNull()).select(
        "account_id", "attribute", F.lit(_OTHER_RANK).alias("rank"), "doc_pos", "seq",
        value.alias("value"), "doc_id", "file_name", "document_type",
        F.concat(F.lit("other: "), label).alias("source_field"), none.alias("grounding"),
        F.lit(rules.OTHER_FIELD_CONFIDENCE).alias("confidence"), none.alias("normalized"))


def _matcher(table: dict) -> Column:
    return F.try_element_at(t.lookup(table), F.col("attribute"))


# ---------------------------------------------------------------- E2
def match_pairs(pairs: DataFrame, kind, a: str = "a", b: str = "b") -> DataFrame:
    """E2. Adds ``verdict`` SAME / LIKELY_SAME / DIFFERENT / null for two value columns. ``kind``
    (a name or a column): person, business, address, tin (branch ignored), tin_branch, email,
    phone."""
    kinds = (kind,) if isinstance(kind, str) else m.ALL_KINDS
    kind = F.lit(kind) if isinstance(kind, str) else kind
    df = pairs.withColumn("__a", m.form(kind, a, kinds)).withColumn(
        "__b", m.form(kind, b, kinds))
    return m.with_verdict(df, kind, "__a", "__b", kinds=kinds).drop("__a", "__b")


# ---------------------------------------------------------------- E3
def distinct_forms(facts: DataFrame, matchers: dict) -> DataFrame:
    """Facts of the compared attributes merged to their distinct forms, with the first and last
    document, the first place and the number of facts of each."""
    df = facts.withColumn("matcher", _matcher(matchers)).where(F.col("matcher").isNotNull())
    df = df.withColumn("form", m.form(F.col("matcher"), "value", set(matchers.values())))
    return df.groupBy(*GROUP, "matcher", "form").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        F.min(F.struct(*PLACE)).alias("at"), F.count("*").alias("n"))


_EQUALITY = ["tin", "tin_branch", "email", "phone"]


def _one_document(lo, hi, other_lo, other_hi) -> Column:
    lo, hi, other_lo, other_hi = map(t._c, (lo, hi, other_lo, other_hi))
    return (lo == hi) & (other_lo == other_hi) & (lo == other_lo)


def _pair_rank(df: DataFrame) -> DataFrame:
    """Rank of the verdict of forms a and b, the earlier one first as similarity is not symmetric;
    null when both come from one and the same document only."""
    early = F.col("a_at") <= F.col("b_at")
    df = df.withColumn("__x", F.when(early, F.col("a")).otherwise(F.col("b"))) \
        .withColumn("__y", F.when(early, F.col("b")).otherwise(F.col("a")))
    df = m.with_verdict(df, F.col("matcher"), "__x", "__y",
                        kinds=("person", "business", "address"))
    return df.withColumn("worst", F.when(
        ~_one_document("a_lo", "a_hi", "b_lo", "b_hi"), m.rank("verdict")))


def cross_check(facts: DataFrame, attributes: dict = rules.CHECKED_ATTRIBUTES) -> DataFrame:
    """E3. Do the documents of an account agree on an attribute? The verdict is the worst over all
    pairs of facts from different documents: CONSISTENT, LIKELY_CONSISTENT, CONFLICT, or DIFFERS
    where the attribute may differ. One row per account and attribute with two documents or more.

    The pairs are never laid out. Equal forms are merged first. For attributes compared by
    equality two forms from different documents are a conflict. For the others each form is compared with the group's
    longest one; most groups are settled by that, since one DIFFERENT is the worst verdict. Groups whose
    forms all resemble that one are looked into by ``resemble.worst_within``, without a key that holds all
    pairs of a group.
    """
    forms = keep(distinct_forms(facts, {a: spec[1] for a, spec in attributes.items()}), "forms")
    forms = forms.withColumn("__own", F.when(   # equal forms of different documents
        (F.col("matcher") == "address") & (F.col("form") == "") & (F.col("lo") != F.col("hi")),
        2).otherwise(0))
    groups = forms.groupBy(*GROUP).agg(
        F.min("lo").alias("g_lo"), F.max("hi").alias("g_hi"), F.sum("n").alias("n_values"),
        F.count("form").alias("n_forms"),
        F.min(F.when(F.col("form").isNotNull(), F.col("lo"))).alias("f_lo"),
        F.max(F.when(F.col("form").isNotNull(), F.col("hi"))).alias("f_hi"),
        F.max("__own").alias("__own_worst"), F.max("matcher").alias("g_matcher"),
        F.max_by(F.struct("form", "lo", "hi", "at"), F.struct(F.length("form"), "form"))
        .alias("top"))
    groups = groups.where(F.col("g_lo") != F.col("g_hi"))
    equal = F.col("g_matcher").isin(_EQUALITY)
    fuzzy = forms.where(~F.col("matcher").isin(_EQUALITY) & F.col("form").isNotNull()).drop(
        "__own")

    pivot = groups.where(~equal & (F.col("n_forms") >= 2)).select(*GROUP, "top")
    star = attach(fuzzy, pivot, GROUP).where(
        F.col("top").isNotNull() & (F.col("form") != F.col("top.form")))
    star = _pair_rank(star.select(
        *GROUP, "matcher", F.col("form").alias("a"), F.col("lo").alias("a_lo"),
        F.col("hi").alias("a_hi"), F.col("at").alias("a_at"), F.col("top.form").alias("b"),
        F.col("top.lo").alias("b_lo"), F.col("top.hi").alias("b_hi"),
        F.col("top.at").alias("b_at")))
    worst = star.groupBy(*GROUP).agg(F.max("worst").alias("worst"),
                                     F.count("*").alias("__others"), F.first("b").alias("__top"))

    open_ = worst.where((F.coalesce("worst", F.lit(0)) < 2) & (F.col("__others") >= 2))
    left = fuzzy.join(open_.select(*GROUP, "__top", (F.coalesce("worst", F.lit(0)) == 1).alias("likely")), GROUP) \
        .where(F.col("form") != F.col("__top"))

    rest = worst_within(left, GROUP, _pair_rank)

    out = groups.join(worst.select(*GROUP, "worst"), GROUP, "left").join(rest, GROUP, "left")
    # two forms are a conflict unless one document alone holds all of them
    apart = (F.col("n_forms") >= 2) & (F.col("f_lo") != F.col("f_hi"))
    rank = F.when(equal, F.when(apart, 2).otherwise(0)).otherwise(F.greatest(
        F.coalesce("worst", F.lit(0)), F.coalesce("rest", F.lit(0)), F.col("__own_worst")))
    severity = _matcher({a: spec[2] for a, spec in attributes.items()})
    notes = {a: spec[3] for a, spec in attributes.items() if spec[3]}
    note = _matcher(notes) if notes else F.lit(None).cast("string")
    out = out.withColumn("__rank", rank).withColumn("__sev", severity)
    status = (F.when(F.col("__rank") == 0, "CONSISTENT")
              .when(F.col("__rank") == 1, "LIKELY_CONSISTENT")
              .when(F.col("__sev") == "INFO", "DIFFERS").otherwise("CONFLICT"))
    return out.select(
        *GROUP, _matcher({a: spec[0] for a, spec in attributes.items()}).alias("attribute_pos"),
        status.alias("status"),
        F.when(status == "CONFLICT", F.col("__sev")).otherwise("INFO").alias("severity"),
        "n_values", "n_forms", F.when(F.col("__rank") == 2, note).alias("note"))


def conflict_texts(facts: DataFrame, checks: DataFrame) -> DataFrame:
    """One message per critical conflict that names the values. Facts of an account are bounded by
    the request limits (at most 500 attachments and 500 notes)."""
    critical = checks.where((F.col("status") == "CONFLICT") & (F.col("severity") == "CRITICAL"))
    shown = F.concat(F.col("value"), F.lit(" ("), F.col("document_type"), F.lit(")"))
    values = facts.join(critical.select(*GROUP, "attribute_pos"), GROUP).groupBy(
        *GROUP, "attribute_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct(*PLACE, shown.alias("s")))), lambda x: x["s"]), " vs ").alias("v"))
    return values.select(*GROUP, "attribute_pos", F.concat(
        F.lit("Documents disagree on "), F.col("attribute"), F.lit(": "), F.col("v"))
        .alias("message"))


# ---------------------------------------------------------------- E4
def compare_values(pairs: DataFrame, kind: str = "kind", a: str = "a", b: str = "b") -> DataFrame:
    """E4. Adds ``verdict`` SAME / MINOR_DIFF / DIFFERENT for two values of a field of this kind,
    null when either is empty. Small differences never pass for numbers, codes and dates."""
    from attesta.functions.similarity import similarity
    k, x, y = F.col(kind), F.col(a), F.col(b)
    nx, ny = t.normalize(k, x), t.normalize(k, y)
    code = t.alnum(t.strip_code_label(x)) == t.alnum(t.strip_code_label(y))
    name = (k == "name") & ((t.name_key(x) == t.name_key(y))
                            | (t.business_key(x) == t.business_key(y)))
    ax, ay = t.alnum(x), t.alnum(y)
    reach = 2.0 * F.least(F.length(ax), F.length(ay)) / (F.length(ax) + F.length(ay)) >= 0.9
    first = F.when(~t.blank(a) & ~t.blank(b), (
        F.when(k.isin("date", "tin", "money", "choice"),
               F.when(nx == ny, "SAME").otherwise("DIFFERENT"))
        .when(k.isin("code", "number"), F.when(code, "SAME").otherwise("DIFFERENT"))
        .when(name | (ax == ay), "SAME")
        .when(t.numbers_conflict(x, y) | ~reach, "DIFFERENT").otherwise("?")))
    df = pairs.withColumn("verdict", first)
    open_ = F.col("verdict") == "?"
    df = df.withColumn("__ratio", similarity(F.when(open_, ax), F.when(open_, ay)))
    return df.withColumn("verdict", F.when(~open_, F.col("verdict")).when(
        F.col("__ratio") >= 0.9, "MINOR_DIFF").when(open_, "DIFFERENT")).drop("__ratio")


# ---------------------------------------------------------------- F1, F2, E5
# How agreement with the chosen value is judged; attributes not listed (address, line
# of business) count no agreeing documents
AGREE_BY = {"owner_name": "person", "business_name": "business", "registered_name": "business",
            "tin": "tin_branch", "taxpayer_type": "business_form", "email": "email",
            "phone": "phone"}


def choose_best(facts: DataFrame, min_confidence: float = rules.MIN_CONFIDENCE,
                keys: Sequence[str] = GROUP) -> DataFrame:
    """F1. The golden value per account and attribute: the first in preference order with enough
    confidence, else the first of any. ``n_facts`` tells how many there were."""
    weak = ~F.coalesce(F.col("confidence") >= min_confidence, F.lit(False))
    values = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(
        F.min_by(F.struct(*values), F.struct(weak, *[F.col(c) for c in PLACE])).alias("b"),
        F.count("*").alias("n_facts")).select(*keys, *[f"b.{c}" for c in values], "n_facts")


def agreeing_documents(chosen: DataFrame, facts: DataFrame, matchers: dict = AGREE_BY) -> DataFrame:
    """E5. Per chosen value the number of facts from other documents that match it. Facts are merged
    to their distinct forms before they are compared."""
    kinds = set(matchers.values())
    pick = chosen.withColumn("__m", _matcher(matchers)).where(F.col("__m").isNotNull()).select(
        *GROUP, F.struct(m.form(F.col("__m"), "value", kinds).alias("form"),
                         F.col("doc_id").alias("doc"), F.col("__m").alias("matcher"))
        .alias("__c"))
    df = attach(facts.select(*GROUP, "value", "doc_id"), pick, GROUP).where(F.col("doc_id") != F.col("__c.doc"))
    forms = df.groupBy(*GROUP, F.col("__c.matcher").alias("matcher"),
                       F.col("__c.form").alias("mine"),
                       m.form(F.col("__c.matcher"), "value", kinds).alias("form")).agg(
        F.count("*").alias("n"))
    judged = m.with_verdict(forms, F.col("matcher"), "mine", "form", kinds=kinds)
    found = judged.where(m.agrees("verdict")).groupBy(*GROUP).agg(F.sum("n").alias("agreeing"))
    return chosen.select(*GROUP).join(found, GROUP, "left").select(
        *GROUP, F.coalesce("agreeing", F.lit(0)).alias("agreeing"))


def consensus_confidence(chosen: DataFrame, agreeing: DataFrame) -> DataFrame:
    """F2. Adds agreeing and consensus: 0.05 per agreeing document on top of the chosen value's
    confidence (0.5 when it has none), at most 0.98."""
    base = F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(0.5))
    df = chosen.join(agreeing, GROUP, "left").withColumn(
        "agreeing", F.coalesce("agreeing", F.lit(0)))
    return df.withColumn("consensus", F.round(
        F.least(F.lit(0.98), base + 0.05 * F.col("agreeing")), 2))


def account_forms(accounts: DataFrame, chosen: DataFrame) -> DataFrame:
    """F3. business_form per account: from the chosen taxpayer type, else from the account."""
    kind = chosen.where(F.col("attribute") == "taxpayer_type").select(
        "account_id", F.col("value").alias("__type"))
    own = (F.col("Type_of_Business_Organization")
           if "Type_of_Business_Organization" in accounts.columns else F.lit(None))
    return accounts.join(kind, "account_id", "left").select(
        *accounts.columns, t.business_form("__type", own).alias("business_form"))
