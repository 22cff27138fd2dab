"""Decisions per account: proposed changes, requirements, checks, recommendation, update plan.

Everything is long and keyed by account_id; an account has at most one row per target field,
required document or check in these frames.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import matching as m
from attesta.functions import text as t
from attesta.operators.facts import GROUP

PROPOSAL = ["account_id", "target_field", "pos", "attribute", "current_value", "proposed_value",
            "action", "confidence", "grounding", "agreeing_documents", "needs_attention", "reason"]

# Attribute -> (target field, place, matcher against the account, may be corrected)
TARGETS = {
    "owner_name": ("Owner_Name", 1, "person", True),
    "tin": ("Tax_Identification_Number_TIN", 2, "tin_branch", True),
    "taxpayer_type": ("Type_of_Business_Organization", 3, "business_form", True),
    "business_name": ("Invoice_Company_Name", 4, "business", True),
    "registered_name": ("Invoice_Company_Name", 4, "business", True),
    "line_of_business": ("Business_Style", 5, "name", False),
    "address": ("Billing_Street", 6, "address", False),
    "email": ("Email", 7, "email", False),
    "phone": ("Phone", 8, "phone", False),
}


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else _none()


def _by_attribute(table: dict) -> Column:
    return F.try_element_at(t.lookup(table), F.col("attribute"))


def _corporate(form) -> Column:
    return t._c(form).isin("CORPORATION", "PARTNERSHIP")


# ---------------------------------------------------------------- F4, F5, F7, F8
def propose_changes(chosen: DataFrame, accounts: DataFrame, checks: DataFrame,
                    system: str = "CRM", targets: dict = TARGETS,
                    min_confidence: float = rules.MIN_CONFIDENCE) -> DataFrame:
    """F4. Compare the golden values with the master table: FILL, MATCH, CORRECT, DIFFERS,
    REVIEW_CONFLICT or NO_PICKLIST_VALUE per target field, with confidence and reason.

    ``chosen``: choose_best with consensus_confidence; ``accounts``: with business_form. One join
    on the account; the master fields stay wide and each row picks its own.
    """
    fields = list(dict.fromkeys(spec[0] for spec in targets.values()))
    owner = (F.col("Owner.name") if "Owner" in accounts.columns else _none())
    wide = accounts.select(
        "account_id", "business_form", owner.alias("__record_owner"),
        *[_field(accounts, f).alias(f"__cur_{f}") for f in fields])
    conflict = checks.where((F.col("status") == "CONFLICT")
                            & F.col("severity").isin("CRITICAL", "WARNING")).select(
        *GROUP, F.lit(True).alias("__conflict"))
    df = chosen.where(F.col("attribute").isin(list(targets))).join(wide, "account_id") \
        .join(conflict, GROUP, "left")
    names = ("business_name", "registered_name")
    right_name = F.when(_corporate("business_form"), names[1]).otherwise(names[0])
    df = df.where(~F.col("attribute").isin(*names) | (F.col("attribute") == right_name))
    checked = F.col("attribute").isin("owner_name", "tin", *names)

    value, attribute = F.col("value"), F.col("attribute")
    df = df.withColumn("target_field", _by_attribute({a: s[0] for a, s in targets.items()}))
    current = F.lit(None).cast("string")
    for f in fields:
        current = F.when(F.col("target_field") == f, F.col(f"__cur_{f}")).otherwise(current)
    kind_form = t.business_form(value, _none())
    proposed = (F.when(attribute == "owner_name", t.natural_person_name(value))
                .when(attribute == "tin", F.coalesce("normalized", value))
                .when(attribute == "taxpayer_type",
                      F.try_element_at(t.lookup(rules.FORM_TO_PICKLIST), kind_form))
                .when(attribute.isin(*names), t.collapse(value)).otherwise(value))
    df = df.withColumn("current_value", current).withColumn("__proposed", proposed) \
        .withColumn("matcher", _by_attribute({a: s[2] for a, s in targets.items()}))
    no_value = (attribute == "taxpayer_type") & F.col("__proposed").isNull()
    df = df.where(no_value | ~t.blank("__proposed"))
    kinds = {s[2] for s in targets.values()}
    df = df.withColumn("__f1", m.form(F.col("matcher"), "current_value", kinds)).withColumn(
        "__f2", m.form(F.col("matcher"), "__proposed", kinds)).withColumn(
        "__f3", m.form(F.lit("person"), "__record_owner", ("person",)))
    df = m.with_verdict(df, F.col("matcher"), "__f1", "__f2", kinds=kinds)
    sales_rep = (attribute == "owner_name") & m.same_person("__f1", "__f3")
    may_correct = _by_attribute({a: s[3] for a, s in targets.items()})
    clash = checked & F.coalesce("__conflict", F.lit(False))
    action = (F.when(no_value, "NO_PICKLIST_VALUE").when(clash, "REVIEW_CONFLICT")
              .when(t.blank("current_value"), "FILL").when(m.agrees("verdict"), "MATCH")
              .when(may_correct, "CORRECT").otherwise("DIFFERS"))
    df = df.withColumn("action", action)
    action = F.col("action")
    scored = action.isin("FILL", "MATCH", "CORRECT", "DIFFERS")
    low = F.col("consensus") < min_confidence
    differs = F.lit(f"{system} differs from the documents")
    reason = (
        F.when(action == "NO_PICKLIST_VALUE", F.concat(
            F.lit("Documents say "), value,
            F.lit(f"; the {system} picklist has no matching value.")))
        .when(action == "REVIEW_CONFLICT",
              "Documents disagree on this value; the reviewer must choose.")
        .when(action == "FILL", f"{system} is empty; value found on documents.")
        .when(action == "MATCH", F.when(
            F.col("verdict") == "SAME", f"{system} matches the documents.").otherwise(
            f"{system} matches the documents (minor wording difference)."))
        .when(action == "DIFFERS", F.concat(
            differs, F.lit("; not changed automatically. "), F.when(
                attribute == "address",
                f"Addresses are split into several {system} fields.").otherwise("")))
        .otherwise(F.concat(differs, F.lit("."), F.when(sales_rep, F.concat(
            F.lit(f" {system} Owner_Name equals the CRM record owner ("),
            F.col("__record_owner"),
            F.lit("), the sales rep, not the business owner."))).otherwise(""))))
    return df.select(
        "account_id", "target_field",
        _by_attribute({a: s[1] for a, s in targets.items()}).alias("pos"), "attribute",
        "current_value",
        F.when(action.isin("FILL", "CORRECT"), F.col("__proposed"))
        .when(action == "MATCH", F.col("current_value")).alias("proposed_value"),
        "action", F.when(scored, F.col("consensus")).alias("confidence"),
        F.when(scored, F.col("grounding")).alias("grounding"),
        F.when(scored, F.col("agreeing") + 1).otherwise(0).cast("long")
        .alias("agreeing_documents"),
        (F.when(action == "MATCH", False)
         .when(action.isin("REVIEW_CONFLICT", "NO_PICKLIST_VALUE", "DIFFERS"), True)
         .otherwise(low)).alias("needs_attention"), reason.alias("reason"))


def compare_account_name(accounts: DataFrame, facts: DataFrame) -> DataFrame:
    """F5. The account's name against all business and registered names of its documents: the best
    verdict, shown only (MATCH or DIFFERS). Names are merged to their forms before comparing."""
    names = facts.where(F.col("attribute").isin("business_name", "registered_name")).select(
        "account_id", m.form(F.lit("business"), "value", ("business",)).alias("b")).distinct()
    own = accounts.where(~t.blank("Account_Name")).select(
        "account_id", "Account_Name",
        m.form(F.lit("business"), "Account_Name", ("business",)).alias("a"))
    judged = m.with_verdict(own.join(names, "account_id"), F.lit("business"), "a", "b",
                            kinds=("business",))
    best = judged.groupBy("account_id").agg(
        F.first("Account_Name").alias("current_value"),
        F.max(m.agrees("verdict")).alias("ok"))
    action = F.when(F.col("ok"), "MATCH").otherwise("DIFFERS")
    return best.select(
        "account_id", F.lit("Account_Name").alias("target_field"), F.lit(9).alias("pos"),
        _none().alias("attribute"), "current_value", _none().alias("proposed_value"),
        action.alias("action"), _none("double").alias("confidence"), _none().alias("grounding"),
        F.lit(0).cast("long").alias("agreeing_documents"), (~F.col("ok")).alias("needs_attention"),
        F.when(F.col("ok"), "Account name matches a name on the documents.").otherwise(
            "Account name differs from the names on the documents (brand vs registered name, or "
            "documents of another business?). Not changed automatically.").alias("reason"))


def valid_until_source(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """F11. Adds where a document's expiry date comes from, in plain words."""
    by_type = rules.EXPIRY_FIELDS
    printed = fields.where(F.col("name").isin(list(by_type.values())) & ~t.blank("value"))
    printed = printed.select("doc_id", F.col("name").alias("__field"),
                             F.col("value").alias("__printed"))
    df = docs.withColumn("__field", F.try_element_at(t.lookup(by_type), F.col("document_type")))
    df = df.join(printed, ["doc_id", "__field"], "left")
    derived = F.filter("issues", lambda i: i["code"] == "VALIDITY_DERIVED")
    source = (F.when(F.exists("issues", lambda i: i["code"] == "NO_EXPIRY_PRINTED"),
                     "no expiry date printed on this document")
              .when((F.col("validity_status") == "NO_EXPIRY") | F.col("document_type").isin(
                  "BIR_2303", rules.FORM_TYPE), "no expiry for this document type")
              .when(F.size(derived) > 0, F.concat(F.lit("derived: "),
                                                  F.get(derived, F.lit(0))["message"]))
              .when(F.col("__printed").isNotNull(), F.concat(
                  F.col("__field"), F.lit(" as printed: "), F.col("__printed"))))
    return df.select(*docs.columns, source.alias("valid_until_source"))


def _until(docs: DataFrame) -> Column:
    return F.coalesce(F.col("valid_until").cast("string"), F.lit(""))


def check_requirements(docs: DataFrame, accounts: DataFrame,
                       required: dict = rules.REQUIRED_DOCUMENTS) -> DataFrame:
    """F6. Per account and required document type the best candidate (valid first, then the latest
    expiry, then the first) or MISSING. ``accounts`` carry business_form."""
    table = docs.sparkSession.createDataFrame(
        [(f, i, d) for f, types in required.items() for i, d in enumerate(types)],
        "business_form string, rule_pos int, document_type string")
    wanted = accounts.select("account_id", "business_form").join(
        F.broadcast(table), "business_form").select("account_id", "rule_pos", "document_type")
    source = (F.col("valid_until_source") if "valid_until_source" in docs.columns else _none())
    types = sorted({d for ds in required.values() for d in ds})
    valid = F.coalesce(F.col("validity_status").isin("VALID", "NO_EXPIRY"), F.lit(False))
    best = docs.where(F.col("document_type").isin(types)).groupBy(
        "account_id", "document_type").agg(F.max_by(
            F.struct(F.coalesce("validity_status", F.lit("UNKNOWN")).alias("status"),
                     F.col("file_name").alias("file"),
                     F.col("valid_until").cast("string").alias("valid_until"),
                     source.alias("valid_until_source")),
            F.struct(valid, _until(docs), -F.col("doc_pos"))).alias("b"))
    return wanted.join(best, ["account_id", "document_type"], "left").select(
        "account_id", "rule_pos", "document_type",
        F.coalesce("b.status", F.lit("MISSING")).alias("status"), "b.file", "b.valid_until",
        "b.valid_until_source")


def propose_attachments(docs: DataFrame, accounts: DataFrame,
                        file_rules: Sequence = rules.FILE_RULES) -> DataFrame:
    """F7. Latest valid or undated document for each empty file field of the account. Two rules may
    fill one field and then give two proposals. File fields are arrays (or text) on accounts."""
    table = docs.sparkSession.createDataFrame(
        [(i, d, f) for i, (d, f) in enumerate(file_rules)],
        "file_pos int, document_type string, target_field string")
    usable = docs.where(F.col("validity_status").isin("VALID", "NO_EXPIRY", "UNKNOWN")
                        & F.col("document_type").isin([d for d, _ in file_rules]))
    best = usable.groupBy("account_id", "document_type").agg(F.max_by(
        "file_name", F.struct(_until(docs), -F.col("doc_pos"))).alias("file"))
    kinds = dict(accounts.dtypes)

    def empty(f):
        if f not in kinds:
            return F.lit(True)
        if kinds[f].startswith("array"):
            return F.coalesce(F.size(f) <= 0, F.lit(True))
        return t.blank(F.col(f).cast("string"))
    targets = list(dict.fromkeys(f for _, f in file_rules))
    room = accounts.select("account_id", t.present(*[
        F.when(empty(f), F.lit(f)) for f in targets]).alias("__room"))
    df = best.join(F.broadcast(table), "document_type").join(room, "account_id").where(
        F.array_contains("__room", F.col("target_field")))
    return df.select(
        "account_id", "target_field", (F.col("file_pos") + 10).alias("pos"),
        _none().alias("attribute"), _none().alias("current_value"),
        F.col("file").alias("proposed_value"), F.lit("ATTACH").alias("action"),
        _none("double").alias("confidence"), _none().alias("grounding"),
        F.lit(0).cast("long").alias("agreeing_documents"), F.lit(False).alias("needs_attention"),
        F.concat(F.lit("Attach the "), F.initcap(F.translate("document_type", "_", " ")),
                 F.lit(" to this field.")).alias("reason"))


def hold_conflicted(proposals: DataFrame, checks: DataFrame) -> DataFrame:
    """F8. While documents disagree on who the customer is, FILL, CORRECT and ATTACH of that account
    become HOLD and say why. Must run before the activation checks."""
    held = checks.where((F.col("status") == "CONFLICT") & (F.col("severity") == "CRITICAL")) \
        .groupBy("account_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("attribute_pos", "attribute"))), lambda x: x["attribute"]), ", ")
        .alias("__on"))
    df = proposals.join(held, "account_id", "left")
    hold = F.col("__on").isNotNull() & F.col("action").isin("FILL", "CORRECT", "ATTACH")
    return df.withColumn("reason", F.when(hold, F.concat(
        F.lit("On hold: documents disagree on "), F.col("__on"), F.lit(
            ". Confirm which documents belong to this customer first. "), F.col("reason")))
        .otherwise(F.col("reason"))).withColumn(
        "needs_attention", hold | F.col("needs_attention")).withColumn(
        "action", F.when(hold, "HOLD").otherwise(F.col("action"))).select(*proposals.columns)


# ---------------------------------------------------------------- F9
CHECK = ["account_id", "pos", "key", "label", "status", "target_field", "detail"]
# The five activation checks
_LABELS = {
    "payment_terms": "Payment Terms is COD",
    "accounting_contact": "Accounting or primary contact (name, PH mobile, email)",
    "tin": "TIN matches the BIR 2303",
    "invoice_name": "Invoice Company Name matches the documents",
    "billing_address": "Billing Address matches the documents",
}


def activation_checks(accounts: DataFrame, contacts: DataFrame, chosen: DataFrame,
                      proposals: DataFrame, system: str = "CRM") -> DataFrame:
    """F9. The five checks of an account that may become active: PASS, AFTER_UPDATE (a change of the
    field is proposed) or FAIL. ``accounts`` carry business_form and may carry contacts_read (false
    when the contacts could not be read)."""
    terms = _field(accounts, "Credit_Terms")
    pay = accounts.select(
        "account_id", F.when(t.is_cod(terms), "PASS").otherwise("FAIL").alias("status"),
        F.lit("Credit_Terms").alias("target_field"),
        F.concat(F.lit("Payment Terms: "), F.coalesce(F.when(terms != "", terms),
                                                      F.lit("empty"))).alias("detail"))
    parts = [_check(pay, 0, "payment_terms"),
             _check(_contact_check(accounts, contacts), 1, "accounting_contact")]
    street = _address_line(accounts)
    for pos, key, target, matcher, attributes, current in (
            (2, "tin", "Tax_Identification_Number_TIN", "tin_branch", ("tin",), None),
            (3, "invoice_name", "Invoice_Company_Name", "business", None, None),
            (4, "billing_address", "Billing_Street", "address", ("address",), street)):
        now = _field(accounts, target) if current is None else current
        base = accounts.select("account_id", "business_form", now.alias("__now"))
        best = _best_of(chosen, base, attributes)
        parts.append(_check(_document_check(best, proposals, target, matcher, system), pos, key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _check(df: DataFrame, pos: int, key: str) -> DataFrame:
    return df.withColumn("pos", F.lit(pos)).withColumn("key", F.lit(key)).withColumn(
        "label", F.lit(_LABELS[key])).select(CHECK)


def _best_of(chosen: DataFrame, base: DataFrame, attributes) -> DataFrame:
    """The golden value to check an account against; for the invoice name the registered name of
    corporations (else the business name)."""
    wanted = attributes or ("business_name", "registered_name")
    picks = chosen.where(F.col("attribute").isin(*wanted)).groupBy("account_id").agg(*[
        F.max(F.when(F.col("attribute") == a, F.struct("value", "document_type"))).alias(a)
        for a in wanted])
    df = base.join(picks, "account_id", "left")
    if attributes:
        best = F.col(wanted[0])
    else:
        best = F.when(_corporate("business_form"), F.coalesce(
            "registered_name", "business_name")).otherwise(F.col("business_name"))
    return df.select("account_id", "__now", best["value"].alias("__value"),
                     best["document_type"].alias("__type"))


def _document_check(best: DataFrame, proposals: DataFrame, target: str, matcher: str,
                    system: str) -> DataFrame:
    change = proposals.where(F.col("target_field") == target).select(
        "account_id", F.col("action").alias("__action"),
        F.col("proposed_value").alias("__proposed"))
    df = best.join(change, "account_id", "left").withColumn(
        "__f1", m.form(F.lit(matcher), "__now", (matcher,))).withColumn(
        "__f2", m.form(F.lit(matcher), "__value", (matcher,)))
    df = m.with_verdict(df, F.lit(matcher), "__f1", "__f2", kinds=(matcher,))
    gone, empty = F.col("__value").isNull(), t.blank("__now")
    ok = ~empty & m.agrees("verdict")
    coming = F.coalesce(F.col("__action").isin("FILL", "CORRECT"), F.lit(False))
    status = (F.when(gone, "FAIL").when(ok, "PASS").when(coming, "AFTER_UPDATE")
              .otherwise("FAIL"))
    detail = (
        F.when(gone, "not found on the documents")
        .when(ok, F.concat(F.lit("matches "), F.col("__type"), F.lit(": "), F.col("__value")))
        .when(coming, F.concat(
            F.when(empty, "empty").otherwise(t.quoted("__now")), F.lit(" - to be "),
            F.when(F.col("__action") == "FILL", "filled").otherwise("corrected"),
            F.lit(" with "), F.col("__proposed")))
        .when(empty, f"empty in {system}")
        .otherwise(F.concat(F.lit(f"{system} has "), F.col("__now"),
                            F.lit(", documents say "), F.col("__value"))))
    return df.select("account_id", status.alias("status"), F.lit(target).alias("target_field"),
                     detail.alias("detail"))


def _address_line(accounts: DataFrame) -> Column:
    city = _field(accounts, "Billing_City")
    city = F.when(~t.blank(city), city)
    if "Billing_City1" in accounts.columns:
        kind = dict(accounts.dtypes)["Billing_City1"]
        if kind.startswith("struct"):
            city = F.coalesce(city, F.col("Billing_City1.name"))

    def shown(c):
        return F.when(~t.blank(c) & (c != "-None-"), c)
    province = _field(accounts, "Billing_Province")
    province = F.coalesce(F.when(~t.blank(province), province), _field(accounts, "Billing_State"))
    line = F.concat_ws(", ", shown(_field(accounts, "Billing_Street")), shown(city),
                       shown(province), shown(_field(accounts, "Billing_Code")))
    return F.when(line != "", line)


def _contact_check(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    raw = F.coalesce(F.when(F.col("mobile") != "", F.col("mobile")), F.col("phone"))
    accounting = F.exists(F.map_values("roles"), lambda v: F.upper(v).contains(
        rules.ACCOUNTING_ROLES[0]) | F.upper(v).contains(rules.ACCOUNTING_ROLES[1]))
    c = contacts.where(F.coalesce("primary", F.lit(False))
                       | F.coalesce(accounting, F.lit(False))).withColumn(
        "__raw", raw).withColumn("__mobile", t.ph_mobile(raw)).withColumn(
        "__named", ~t.blank("name")).withColumn("__mail", t.email_ok("email"))
    complete = F.col("__named") & F.col("__mobile").isNotNull() & F.col("__mail")
    first = c.groupBy("account_id").agg(F.min_by(
        F.struct("name", "email", "primary", "__raw", "__mobile", "__named", "__mail",
                 complete.alias("ok")), F.struct(~complete, F.col("contact_pos"))).alias("c"))
    df = accounts.select("account_id", (F.col("contacts_read") if "contacts_read"
                                        in accounts.columns else F.lit(True)).alias("__read"))
    df = df.join(first, "account_id", "left")
    raw_shown = F.coalesce(F.when(F.col("c.__raw") != "", F.col("c.__raw")), F.lit("none"))
    mail_shown = F.coalesce(F.when(F.col("c.email") != "", F.col("c.email")), F.lit("none"))
    missing = t.present(
        F.when(~F.col("c.__named"), "a name"),
        F.when(F.col("c.__mobile").isNull(), F.concat(
            F.lit("a mobile number in Philippine format, e.g. 0917 123 4567 (has "), raw_shown,
            F.lit(")"))),
        F.when(~F.col("c.__mail"), F.concat(
            F.lit("an email in a valid format, e.g. name@company.com (has "), mail_shown,
            F.lit(")"))))
    detail = (
        F.when(~F.col("__read"), "Contacts could not be read")
        .when(F.col("c").isNull(), "no Contact with Contact of = Accounting or marked as the "
                                   "primary contact")
        .when(F.col("c.ok"), F.concat(
            F.col("c.name"), F.lit(", "), F.col("c.__mobile"), F.lit(", "), t.strip("c.email"),
            F.when(F.col("c.primary"), " (primary contact)").otherwise(" (Accounting)")))
        .otherwise(F.concat(
            F.coalesce(F.when(F.col("c.__named"), F.col("c.name")), F.lit("The contact")),
            F.lit(" needs "), F.array_join(missing, " and "))))
    ok = F.col("__read") & F.coalesce("c.ok", F.lit(False))
    return df.select("account_id", F.when(ok, "PASS").otherwise("FAIL").alias("status"),
                     _none().alias("target_field"), detail.alias("detail"))


# ---------------------------------------------------------------- F10
def document_problems(docs: DataFrame) -> DataFrame:
    """Critical document issues other than an expired date, one row each."""
    return docs.select("account_id", "doc_id", "doc_pos", "file_name", "document_type",
                       F.posexplode("issues").alias("issue_pos", "i")).where(
        (F.col("i.severity") == "CRITICAL") & (F.col("i.code") != "EXPIRED")).select(
        "account_id", "doc_id", "doc_pos", "file_name", "document_type", "issue_pos", "i.code",
        "i.message")


def recommend(accounts: DataFrame, conflict_texts: DataFrame, requirements: DataFrame,
              problems: DataFrame, activation: DataFrame,
              expired: str = rules.EXPIRED_REQUIRED_DOCUMENT) -> DataFrame:
    """F10. MANUAL_REVIEW before INACTIVE before ACTIVE, with the reasons in order; ACTIVE is demoted
    when an activation check fails."""
    def reasons(df, stage, pos, level, message):
        return df.select("account_id", F.struct(
            level.alias("level"), F.lit(stage).alias("stage"), pos.alias("pos"),
            message.alias("message")).alias("r"))

    review = F.lit(0)
    rows = reasons(conflict_texts, 0, F.struct(F.col("attribute_pos").alias("a"),
                                               F.lit(0).alias("b")), review, F.col("message"))
    status, kind = F.col("status"), F.col("document_type")
    message = (
        F.when(status == "MISSING", F.concat(F.lit("Required document missing: "), kind))
        .when((status == "UNKNOWN") & kind.isin(rules.EXPIRING_DOCUMENTS), F.concat(
            F.lit("Validity of required document could not be determined: "), kind,
            F.lit(" (check its expiry date)")))
        .when(status == "EXPIRED", F.concat(
            F.lit("Required document expired: "), kind, F.lit(" (until "),
            F.coalesce("valid_until", F.lit("None")), F.lit(")"))))
    late = F.when((status == "EXPIRED") & F.lit(expired == "INACTIVE"), 1).otherwise(0)
    rows = rows.unionByName(reasons(
        requirements.withColumn("__m", message).where(F.col("__m").isNotNull()), 1,
        F.struct(F.col("rule_pos").alias("a"), F.lit(0).alias("b")), late, F.col("__m")))
    rows = rows.unionByName(reasons(
        problems, 2, F.struct(F.col("doc_pos").alias("a"), F.col("issue_pos").alias("b")), review,
        F.concat(F.col("file_name"), F.lit(": "), F.col("code"), F.lit(" - "),
                 F.col("message"))))
    rows = rows.unionByName(reasons(
        activation.where(F.col("status") == "FAIL"), 3,
        F.struct(F.col("pos").alias("a"), F.lit(0).alias("b")), F.lit(2), F.concat(
            F.lit("Activation check not met: "), F.col("label"), F.lit(" - "),
            F.col("detail"))))
    per = rows.groupBy("account_id").agg(F.min("r.level").alias("lead"),
                                         F.array_sort(F.collect_list("r")).alias("all"))
    lead = F.coalesce("lead", F.lit(3))
    # review and inactive reasons are listed together; failed checks only when they are alone
    shown = F.filter("all", lambda r: F.when(lead == 2, r["level"] == 2).otherwise(
        r["level"] < 2))
    fine = F.array(F.lit("All required documents present and valid; documents agree."))
    return accounts.select("account_id", "business_form").join(per, "account_id", "left").select(
        "account_id", "business_form",
        F.when(lead.isin(0, 2), "MANUAL_REVIEW").when(lead == 1, "INACTIVE")
        .otherwise("ACTIVE").alias("recommendation"),
        F.when(lead == 3, fine).otherwise(F.transform(shown, lambda r: r["message"]))
        .alias("reasons"))


# ---------------------------------------------------------------- F12, F13
def document_data(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """F12. Everything read from every file, nested per account for export. A file has at most the
    fields of its type and 80 other items; an account at most the files a request may list."""
    read = fields.where(~t.blank("value")).groupBy("doc_id").agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))
    other = (F.transform("other_fields", lambda o: F.struct(o["label"], o["value"]))
             if "other_fields" in docs.columns else
             F.array().cast("array<struct<label:string,value:string>>"))
    source = (F.col("valid_until_source") if "valid_until_source" in docs.columns else _none())
    row = F.struct(
        "doc_pos", F.col("file_name").alias("file"), F.col("document_type").alias("type"),
        F.col("validity_status").alias("validity"),
        F.col("valid_until").cast("string").alias("valid_until"),
        source.alias("valid_until_source"), "fields", other.alias("other_fields"))
    # maps cannot be ordered: sort by the position alone
    packed = docs.join(read, "doc_id", "left").select("account_id", row.alias("d"))
    ordered = F.array_sort(F.collect_list("d"), lambda a, b: F.when(
        a["doc_pos"] < b["doc_pos"], -1).when(a["doc_pos"] > b["doc_pos"], 1).otherwise(0))
    return packed.groupBy("account_id").agg(ordered.alias("documents"))


def unusable_documents(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """F13. Stored documents without an extraction (with its error), and skipped documents.
    ``docs``: account_id, doc_id, doc_pos, file_name, sha256, status, status_detail."""
    result = extractions.select("sha256", F.col("status").alias("__s"),
                                F.col("error").alias("__e"))
    stored = docs.where(F.col("status") == "STORED").join(result, "sha256", "left").where(
        F.coalesce("__s", F.lit("MISSING")) != "EXTRACTED")
    lost = stored.select("account_id", "doc_id", "doc_pos", "file_name",
                         F.coalesce("__s", F.lit("MISSING")).alias("status"),
                         F.col("__e").alias("detail"), F.lit("not_extracted").alias("list"))
    skipped = docs.where(F.col("status") != "STORED").select(
        "account_id", "doc_id", "doc_pos", "file_name", "status",
        F.col("status_detail").alias("detail"),
        F.lit("skipped").alias("list"))
    return lost.unionByName(skipped)


# ---------------------------------------------------------------- F14, F15, F16
def blocking_problems(checks: DataFrame, problems: DataFrame) -> DataFrame:
    """F14. Critical problems that stop every automatic update of an account: conflicts, and critical
    document issues other than an expired date."""
    c = checks.where((F.col("status") == "CONFLICT") & (F.col("severity") == "CRITICAL")).select(
        "account_id", F.struct(F.lit(0).alias("stage"), F.col("attribute_pos").alias("a"),
                               F.lit(0).alias("b")).alias("pos"),
        F.concat(F.lit("documents disagree on "), F.col("attribute")).alias("problem"))
    d = problems.select(
        "account_id", F.struct(F.lit(1).alias("stage"), F.col("doc_pos").alias("a"),
                               F.col("issue_pos").alias("b")).alias("pos"),
        F.concat(F.col("file_name"), F.lit(": "), F.col("code")).alias("problem"))
    return c.unionByName(d)


def _joined_problems(blockers: DataFrame) -> DataFrame:
    return blockers.groupBy("account_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("pos", "problem"))), lambda x: x["problem"]), "; ")
        .alias("__problems"))


def plan_updates(proposals: DataFrame, blockers: DataFrame,
                 update_rules: Sequence = rules.UPDATE_RULES,
                 threshold: float = rules.AUTO_THRESHOLD,
                 groundings: Sequence[str] = tuple(rules.AUTO_GROUNDINGS)) -> DataFrame:
    """F15. AUTO or REVIEW per FILL and CORRECT, with the first gate that fails: rule, blockers,
    attention, confidence, grounding, agreement, value."""
    needed = F.try_element_at(
        t.lookup({f"{f}|{a}": n for f, a, n in update_rules}),
        F.concat_ws("|", "target_field", "action"))
    df = proposals.where(F.col("action").isin("FILL", "CORRECT")).join(
        _joined_problems(blockers), "account_id", "left").withColumn("__needed", needed)
    conf = F.coalesce("confidence", F.lit(0.0))
    conf_text = F.when(conf == 0, "0").otherwise(conf.cast("string"))
    grounding = F.coalesce("grounding", F.lit("None"))
    confirmed = F.coalesce(F.col("grounding").isin(list(groundings)), F.lit(False))
    fail = F.coalesce(
        F.when(F.col("__needed").isNull(), F.concat(
            F.col("action"), F.lit(" on "), F.col("target_field"),
            F.lit(" always goes to review"))),
        F.when(F.col("__problems").isNotNull(), F.concat(
            F.lit("account has critical problems: "), F.col("__problems"))),
        F.when(F.col("needs_attention"), F.lit("proposal needs attention")),
        F.when(conf < threshold, F.concat(
            F.lit("confidence "), conf_text, F.lit(f" below threshold {threshold}"))),
        F.when(~confirmed, F.concat(F.lit("value not confirmed by OCR (grounding "), grounding,
                                    F.lit(")"))),
        F.when(F.col("agreeing_documents") < F.col("__needed"), F.concat(
            F.col("action"), F.lit(" needs "), F.col("__needed").cast("string"),
            F.lit(" agreeing documents"))),
        F.when(t.blank("proposed_value"), F.lit("no value to write")))
    good = F.concat(F.lit("confidence "), conf_text, F.lit(", "), grounding, F.lit(", "),
                    F.col("agreeing_documents").cast("string"), F.lit(" document(s) agree"))
    return df.select(
        "account_id", "target_field", "pos", "action", "current_value",
        F.col("proposed_value").alias("new_value"), "confidence", "grounding",
        "agreeing_documents", F.when(fail.isNull(), "AUTO").otherwise("REVIEW").alias("decision"),
        F.coalesce(fail, good).alias("reason"))


def status_decision(recommendations: DataFrame, accounts: DataFrame, proposals: DataFrame,
                    facts: DataFrame, activation: DataFrame, plan: DataFrame,
                    threshold: float = rules.AUTO_THRESHOLD, system: str = "CRM") -> DataFrame:
    """F16. ACTIVATE, ALREADY_ACTIVE or NO_CHANGE per account with the first reason that stands in
    the way. It never deactivates."""
    blocked = proposals.groupBy("account_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("action").isin("HOLD", "REVIEW_CONFLICT"), F.struct("pos", "target_field")))),
            lambda x: x["target_field"]), ", ").alias("__blocked"),
        *[F.max(F.when(F.col("action") == "MATCH", F.col("target_field") == f)).alias(f"__m_{a}")
          for a, f in (("owner_name", "Owner_Name"), ("registered_name", "Invoice_Company_Name"),
                       ("tin", "Tax_Identification_Number_TIN"))])
    known = facts.where(F.col("attribute").isin("owner_name", "registered_name", "tin")).groupBy(
        "account_id").agg(*[F.max(F.when(F.col("attribute") == a, F.coalesce(
            "confidence", F.lit(0.0)))).alias(f"__c_{a}")
            for a in ("owner_name", "registered_name", "tin")])
    why = plan.select("account_id", "target_field", F.col("decision").alias("__d"),
                      F.col("reason").alias("__w"))
    late = activation.where(F.col("status") != "PASS").join(
        why, ["account_id", "target_field"], "left")
    text = (F.when(F.col("status") == "FAIL", F.concat(F.col("label"), F.lit(": "),
                                                      F.col("detail")))
            .when(F.coalesce("__d", F.lit("")) != "AUTO", F.concat(
                F.col("label"), F.lit(": "), F.col("detail"),
                F.lit("; not updated automatically ("), F.coalesce("__w", F.lit("no proposal")),
                F.lit("), a person must approve it."))))
    stopped = late.withColumn("__t", text).where(F.col("__t").isNotNull()).groupBy(
        "account_id").agg(F.min_by("__t", "pos").alias("__check"))
    df = recommendations.join(accounts.select("account_id", _field(
        accounts, "Customer_Status").alias("__status")), "account_id", "left")
    for other in (blocked, known, stopped):
        df = df.join(other, "account_id", "left")
    active = F.lower(t.strip(F.coalesce("__status", F.lit("")))) == rules.ACTIVE_VALUE.lower()
    rec = F.col("recommendation")

    def unconfirmed(attribute):
        best = F.col(f"__c_{attribute}")
        shown = F.when(best == 0, "0").otherwise(best.cast("string"))
        return (F.when(best.isNull(), F.lit(
            f"No {attribute} found on the documents; a person must check."))
            .when((best < threshold) & ~F.coalesce(f"__m_{attribute}", F.lit(False)), F.concat(
                F.lit(f"{attribute} not confirmed (confidence "), shown,
                F.lit(f" < {threshold} and {system} has no matching value); a person must "
                      "check."))))
    why_not = F.coalesce(
        F.when((rec != "ACTIVE") & active, F.concat(
            F.lit("Recommendation is "), rec, F.lit(
                f" but the account is Active in {system}. Not deactivated automatically: a "
                "person must decide."))),
        F.when(rec != "ACTIVE", F.concat(F.lit("Recommendation is "), rec, F.lit(
            "; status is not changed automatically."))),
        F.when(F.col("__blocked") != "", F.concat(
            F.lit("Unresolved document conflicts on: "), F.col("__blocked"))),
        F.when(_corporate("business_form"), unconfirmed("registered_name")).otherwise(
            unconfirmed("owner_name")),
        unconfirmed("tin"), F.col("__check"))
    done = F.when(active, "Documents complete and valid; account already Active.").otherwise(
        "All required documents present, valid and consistent; owner and TIN confirmed; COD, "
        "Accounting contact, TIN, invoice name and billing address checked.")
    return df.select(
        "account_id", "recommendation",
        F.when(why_not.isNotNull(), "NO_CHANGE").when(active, "ALREADY_ACTIVE")
        .otherwise("ACTIVATE").alias("decision"), F.coalesce(why_not, done).alias("reason"),
        active.alias("is_active"))
