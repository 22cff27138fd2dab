"""Whole-account scenarios: facts, checks, proposals, recommendation, plan, alerts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t
from attesta.operators import decide as d
from attesta.operators import facts as fa
from attesta.plans import verify

TODAY = date(2026, 10, 1)
DOCS = ("account_id string, doc_id string, doc_pos int, file_name string, document_type string, "
        "validity_status string, valid_until date, issues " + t.ISSUES +
        ", other_fields array<struct<label:string,value:string,page:int>>")
FIELDS = ("doc_id string, name string, kind string, value string, normalized string, "
          "grounding string, confidence double")
ACCOUNTS = ("account_id string, Account_Name string, Invoice_Company_Name string, "
            "Owner_Name string, Owner struct<name:string,id:string,email:string>, "
            "Customer_Status string, Credit_Terms string, Tax_Identification_Number_TIN string, "
            "Type_of_Business_Organization string, Business_Style string, Billing_Street string, "
            "Billing_City string, Billing_Province string, Billing_Code string, Email string, "
            "Phone string, Business_Permit array<struct<attachment_Id:string>>")
CONTACTS = ("account_id string, contact_pos int, id string, name string, email string, "
            "mobile string, phone string, primary boolean, roles map<string,string>")


def account(aid, **kw):
    names = [c.split(" ")[0] for c in ACCOUNTS.replace("struct<name:string,id:string,email:string>",
             "struct").replace("array<struct<attachment_Id:string>>", "array").split(", ")]
    base = dict.fromkeys(names)
    base.update(account_id=aid, Account_Name="Sol Grill", Credit_Terms="COD")
    base.update(kw)
    return tuple(base[n] for n in names)


def sole_prop(aid, **over):
    """Three documents of a sole proprietor that agree with each other."""
    fields = {
        "BIR_2303": {"tin": "234-567-890-00000", "taxpayer_name": "REYES, ANA LUNA",
                     "trade_name": "SOL GRILL", "registered_address": "5 RIZAL STREET, PASIG",
                     "taxpayer_type": "SINGLE PROPRIETORSHIP", "line_of_business": "RESTAURANT"},
        "DTI_BN_CERT": {"business_name": "SOL GRILL", "owner_name": "ANA LUNA REYES"},
        "MAYORS_PERMIT": {"business_name": "SOL GRILL", "owner_name": "ANA LUNA REYES",
                          "business_address": "5 RIZAL ST, PASIG CITY"}}
    for key, value in over.items():
        doc, field = key.split("__")
        fields[doc][field] = value
    return {k: {n: v for n, v in f.items() if v is not None} for k, f in fields.items()}


def frames(spark, accounts, documents, contacts=(), validity=None, conf=0.95, issues=None):
    docs, fields = [], []
    for aid, per in documents.items():
        for pos, (kind, values) in enumerate(per.items()):
            did = f"{aid}-{kind}"
            status, until = (validity or {}).get(did, (
                ("VALID", None) if kind == "BIR_2303" else ("VALID", date(2028, 6, 29))))
            docs.append((aid, did, pos, f"{kind.lower()}.pdf", kind, status, until,
                         (issues or {}).get(did, []), []))
            for n, v in values.items():
                fields.append((did, n, "tin" if n == "tin" else "text", v,
                               v if n == "tin" else v.upper(), "EXACT", conf))
    return (spark.createDataFrame(accounts, ACCOUNTS), spark.createDataFrame(
        list(contacts), CONTACTS), spark.createDataFrame(docs, DOCS),
        spark.createDataFrame(fields, FIELDS))


def contact(aid, pos=0, **kw):
    base = dict(account_id=aid, contact_pos=pos, id="c", name="Lia Cruz", email="lia@sol.ph",
                mobile="09171234567", phone=None, primary=False,
                roles={"Contact_of": "Accounting"})
    base.update(kw)
    return tuple(base.values())


NO_FILES = ("account_id string, doc_id string, doc_pos int, file_name string, status string, "
            "detail string, list string")


@pytest.fixture(scope="module")
def world(spark):
    """Several accounts assessed together, so that accounts cannot leak into each other."""
    full = dict(Owner_Name="ANA LUNA REYES", Tax_Identification_Number_TIN="234567890",
                Invoice_Company_Name="Sol Grill", Billing_Street="5 Rizal St", Billing_City="Pasig",
                Type_of_Business_Organization="Single Proprietorship",
                Business_Style="Restaurant")
    accounts = [account("empty"), account("full", **full),
                account("person", **full), account("tins"), account("corp", Owner_Name="X"),
                account("rep", Owner_Name="Max Sales", Owner=("Max Sales", "9", "m@s.ph")),
                account("noterms", Credit_Terms="30 days", **full), account("none"),
                account("expired", Customer_Status="Active", **full),
                account("weak")]
    documents = {
        "empty": sole_prop("empty"), "full": sole_prop("full"),
        "person": sole_prop("person", DTI_BN_CERT__owner_name="BEN CRUZ"),
        "tins": {**sole_prop("tins"), "GOVERNMENT_ID": {"tin": "999-567-890",
                                                        "full_name": "REYES, ANA LUNA"}},
        "corp": {"BIR_2303": {"tin": "111-222-333-00000", "taxpayer_name": "LUNA FOODS INC.",
                              "taxpayer_type": "DOMESTIC CORPORATION"},
                 "SEC_CERT": {}, "MAYORS_PERMIT": {"business_name": "LUNA FOODS"}},
        "rep": sole_prop("rep"), "noterms": sole_prop("noterms"),
        "expired": sole_prop("expired"),
        "weak": {"BIR_2303": sole_prop("weak")["BIR_2303"]}}
    f = frames(spark, accounts, documents,
               contacts=[contact(a[0]) for a in accounts],
               validity={"expired-MAYORS_PERMIT": ("EXPIRED", date(2025, 12, 31))},
               issues={"expired-MAYORS_PERMIT": [("EXPIRED", "Expired", None, "CRITICAL")]})
    out = verify.assess(*f)
    unusable = spark.createDataFrame([("none", "n-1", 0, "blur.jpg", "SKIPPED", "x",
                                       "not_extracted")], NO_FILES)
    out.update(verify.act(out, unusable, TODAY))
    return out


def of(df, account_id, key):
    return {r[key]: r.asDict(recursive=True) for r in df.where(
        F.col("account_id") == account_id).collect()}


def test_consistent_documents_fill_an_empty_account(world):
    p = of(world["proposals"], "empty", "target_field")
    assert {f: p[f]["action"] for f in p} == {
        "Owner_Name": "FILL", "Tax_Identification_Number_TIN": "FILL",
        "Type_of_Business_Organization": "FILL", "Invoice_Company_Name": "FILL",
        "Business_Style": "FILL", "Billing_Street": "FILL", "Account_Name": "MATCH",
        "Business_Permit": "ATTACH", "BIR_Registration_COR": "ATTACH",
        "Business_registration": "ATTACH"}
    assert p["Owner_Name"]["proposed_value"] == "ANA LUNA REYES"
    assert p["Owner_Name"]["confidence"] == 0.98 and p["Owner_Name"]["agreeing_documents"] == 3
    assert p["Tax_Identification_Number_TIN"]["proposed_value"] == "234-567-890-00000"
    assert p["Business_Style"]["confidence"] == 0.95
    assert p["Business_Style"]["agreeing_documents"] == 1
    assert p["Business_Permit"]["reason"] == "Attach the Mayors Permit to this field."
    c = of(world["checks"], "empty", "attribute")
    assert {a: c[a]["status"] for a in c} == {
        "owner_name": "CONSISTENT", "business_name": "CONSISTENT", "address": "CONSISTENT"}
    plan = of(world["plan"], "empty", "target_field")
    assert plan["Owner_Name"]["decision"] == "AUTO"
    assert plan["Owner_Name"]["reason"] == "confidence 0.98, EXACT, 3 document(s) agree"


def test_matching_account_is_activated(world):
    p = of(world["proposals"], "full", "target_field")
    assert {p[f]["action"] for f in list(p) if p[f]["pos"] < 9} == {"MATCH"}
    a = of(world["activation"], "full", "key")
    assert {k: a[k]["status"] for k in a} == dict.fromkeys(rules.CHECK_SHORT, "PASS")
    assert a["accounting_contact"]["detail"] == \
        "Lia Cruz, +63 917 123 4567, lia@sol.ph (Accounting)"
    r = of(world["recommendations"], "full", "account_id")["full"]
    assert r["recommendation"] == "ACTIVE"
    assert r["reasons"] == ["All required documents present and valid; documents agree."]
    s = of(world["decisions"], "full", "account_id")["full"]
    assert s["decision"] == "ACTIVATE"
    assert of(world["updates"], "full", "target_field")["Customer_Status"]["status"] == "SHADOW"


def test_other_person_holds_everything(world):
    c = of(world["checks"], "person", "attribute")["owner_name"]
    assert (c["status"], c["severity"]) == ("CONFLICT", "CRITICAL")
    p = of(world["proposals"], "person", "target_field")
    assert p["Owner_Name"]["action"] == "REVIEW_CONFLICT" and p["Owner_Name"]["confidence"] is None
    assert p["Business_Permit"]["action"] == "HOLD" and p["Business_Permit"]["needs_attention"]
    assert p["Business_Permit"]["reason"].startswith("On hold: documents disagree on owner_name.")
    r = of(world["recommendations"], "person", "account_id")["person"]
    assert r["recommendation"] == "MANUAL_REVIEW"
    assert r["reasons"] == ["Documents disagree on owner_name: BEN CRUZ (DTI_BN_CERT) vs ANA LUNA "
                            "REYES (MAYORS_PERMIT) vs REYES, ANA LUNA (BIR_2303)"]
    alert = of(world["alerts"], "person", "code")
    assert set(alert) == {"DOCUMENT_CONFLICT", "FIELDS_NEED_REVIEW"}


def test_tin_conflict_and_held_fill_fails_the_check(world):
    assert of(world["checks"], "tins", "attribute")["tin"]["status"] == "CONFLICT"
    p = of(world["proposals"], "tins", "target_field")
    assert p["Tax_Identification_Number_TIN"]["action"] == "REVIEW_CONFLICT"
    assert p["Invoice_Company_Name"]["action"] == "HOLD"
    a = of(world["activation"], "tins", "key")
    assert a["invoice_name"]["status"] == "FAIL"      # held, so not AFTER_UPDATE
    assert of(world["activation"], "empty", "key")["invoice_name"]["status"] == "AFTER_UPDATE"


def test_corporation(world):
    p = of(world["proposals"], "corp", "target_field")
    assert "Owner_Name" not in p
    assert p["Type_of_Business_Organization"]["proposed_value"] == "Corporation"
    assert p["Invoice_Company_Name"]["proposed_value"] == "LUNA FOODS INC."
    req = of(world["requirements"], "corp", "document_type")
    assert set(req) == {"BIR_2303", "SEC_CERT", "MAYORS_PERMIT"}


def test_sales_rep_as_owner_is_explained(world):
    p = of(world["proposals"], "rep", "target_field")["Owner_Name"]
    assert p["action"] == "CORRECT"
    assert "the sales rep, not the business owner" in p["reason"]


def test_terms_demote_active(world):
    r = of(world["recommendations"], "noterms", "account_id")["noterms"]
    assert r["recommendation"] == "MANUAL_REVIEW"
    assert r["reasons"] == ["Activation check not met: Payment Terms is COD - Payment Terms: "
                            "30 days"]


def test_expired_and_active(world):
    r = of(world["recommendations"], "expired", "account_id")["expired"]
    assert r["recommendation"] == "INACTIVE"
    assert r["reasons"] == ["Required document expired: MAYORS_PERMIT (until 2025-12-31)"]
    s = of(world["decisions"], "expired", "account_id")["expired"]
    assert s["decision"] == "NO_CHANGE" and "Not deactivated automatically" in s["reason"]
    a = of(world["alerts"], "expired", "code")
    assert a["EXPIRED_DOCUMENT"]["message"].endswith("expired on 2025-12-31 (274 days ago)")
    assert "ACTIVE_WITH_PROBLEMS" in a
    sig = of(world["signatures"], "expired", "account_id")["expired"]["signature"]
    assert sig == "ACTIVE_WITH_PROBLEMS:None|EXPIRED_DOCUMENT:MAYORS_PERMIT"


def test_missing_documents(world):
    req = of(world["requirements"], "weak", "document_type")
    assert {k: v["status"] for k, v in req.items()} == {
        "BIR_2303": "VALID", "DTI_BN_CERT": "MISSING", "MAYORS_PERMIT": "MISSING"}
    assert of(world["recommendations"], "weak", "account_id")["weak"]["recommendation"] == \
        "MANUAL_REVIEW"
    none = of(world["alerts"], "none", "code")
    assert none["UNREADABLE_DOCUMENT"]["message"] == "Could not read blur.jpg (SKIPPED)"


def test_review_rows_and_status(world):
    rows = of(world["review_rows"], "full", "target_field")
    assert rows["Owner_Name"]["decision"] is None and rows["Owner_Name"]["auto_applied"] == "No"
    assert rows["Business_Permit"]["decision"] == "Pending"
    assert rows["Owner_Name"]["evidence"].splitlines()[0] == \
        "DTI_BN_CERT dti_bn_cert.pdf: ANA LUNA REYES (EXACT 0.95)"
    first = min(rows.values(), key=lambda r: r["row_pos"])
    assert first["action"] in rules.NEEDS_DECISION
    s = of(world["review_status"], "full", "account_id")["full"]
    assert s["review_status"] == "Pending Review"


GATE = ("account_id string, target_field string, pos int, attribute string, current_value string, "
        "proposed_value string, action string, confidence double, grounding string, "
        "agreeing_documents long, needs_attention boolean, reason string")


def test_each_gate_alone(spark):
    base = dict(account_id="a", target_field="Owner_Name", pos=1, attribute="owner_name",
                current_value=None, proposed_value="ANA", action="FILL", confidence=0.97,
                grounding="EXACT", agreeing_documents=1, needs_attention=False, reason="")
    cases = [({}, "AUTO", "confidence 0.97, EXACT, 1 document(s) agree"),
             ({"target_field": "Email"}, "REVIEW", "FILL on Email always goes to review"),
             ({"account_id": "b"}, "REVIEW", "account has critical problems: documents disagree "
                                             "on tin; x.pdf: BRANCH_MISMATCH"),
             ({"needs_attention": True}, "REVIEW", "proposal needs attention"),
             ({"confidence": 0.9}, "REVIEW", "confidence 0.9 below threshold 0.95"),
             ({"confidence": None}, "REVIEW", "confidence 0 below threshold 0.95"),
             ({"grounding": "FUZZY"}, "REVIEW", "value not confirmed by OCR (grounding FUZZY)"),
             ({"action": "CORRECT"}, "REVIEW", "CORRECT needs 2 agreeing documents"),
             ({"proposed_value": ""}, "REVIEW", "no value to write")]
    df = spark.createDataFrame([tuple({**base, **c, "pos": i}.values())
                                for i, (c, _, _) in enumerate(cases)], GATE)
    checks = spark.createDataFrame([("b", "tin", 3, "CONFLICT", "CRITICAL")],
                                   "account_id string, attribute string, attribute_pos int, "
                                   "status string, severity string")
    problems = spark.createDataFrame([("b", "d", 0, "x.pdf", "T", 0, "BRANCH_MISMATCH", "m")],
                                     "account_id string, doc_id string, doc_pos int, file_name "
                                     "string, document_type string, issue_pos int, code string, "
                                     "message string")
    got = {r.pos: r for r in d.plan_updates(df, d.blocking_problems(checks, problems)).collect()}
    for i, (_, decision, reason) in enumerate(cases):
        assert (got[i].decision, got[i].reason) == (decision, reason)


FACTS = ("account_id string, attribute string, rank int, doc_pos int, seq int, value string, "
         "doc_id string, file_name string, document_type string, source_field string, "
         "grounding string, confidence double, normalized string")


def facts_of(spark, items):
    return spark.createDataFrame([(a, at, i, i, 0, v, doc, doc, "T", "f", "EXACT", c, None)
                                  for i, (a, at, v, doc, c) in enumerate(items)], FACTS)


def test_cross_check_equals_all_pairs(spark):
    """The verdict without pairs equals the worst verdict over all pairs, on random groups."""
    import random
    from itertools import combinations
    rnd = random.Random(11)
    words = ["ANA", "LUNA", "REYES", "CRUZ"]
    pools = {
        "owner_name": [" ".join(rnd.sample(words, k)) for k in (1, 2, 2, 3, 3, 4) for _ in "ab"],
        "business_name": ["SOL", "SOL GRILL", "SOL GRILL HOUSE", "SOL GRILS HOUSE",
                          "SAL GRILL HOUSE", "MAR BAR", "SOL GRILL HOUSE 2"],
        "address": ["5 RIZAL ST", "5 RIZAL STREET PASIG", "RIZAL STREET PASIG", "6 RIZAL ST",
                    "5 RIZAL ST TAGUIG", "CITY OF", "RIZAL"],
        "tin": ["234567890", "234-567-890-001", "12", "999999999"],
        "email": ["a@b.ph", "A@b.ph", "c@d.ph"], "phone": ["09171234567", "639171234567", "8123"]}
    items = []
    for g in range(240):
        attribute = rnd.choice(list(pools))
        for _ in range(rnd.randint(1, 5)):
            items.append((f"g{g}", attribute, rnd.choice(pools[attribute]),
                          f"d{rnd.randint(0, 3)}", 0.9))
    facts = facts_of(spark, items)
    got = {(r.account_id, r.attribute): r.status for r in fa.cross_check(
        facts).collect()}
    matcher = {a: s[1] for a, s in rules.CHECKED_ATTRIBUTES.items()}
    groups, pairs = {}, []
    for a, at, v, doc, _ in items:
        groups.setdefault((a, at), []).append((v, doc))
    for key, vs in groups.items():
        for (v1, d1), (v2, d2) in combinations(vs, 2):
            if d1 != d2:
                pairs.append((*key, matcher[key[1]], v1, v2))
    df = fa.match_pairs(spark.createDataFrame(
        pairs, "account_id string, attribute string, kind string, a string, b string"),
        F.col("kind"))
    worst = {}
    for r in df.collect():
        key = (r.account_id, r.attribute)
        worst[key] = max(worst.get(key, 0), {"DIFFERENT": 2, "LIKELY_SAME": 1}.get(r.verdict, 0))
    want = {k: ["CONSISTENT", "LIKELY_CONSISTENT", "DIFFERS" if rules.CHECKED_ATTRIBUTES[k[1]][2]
                == "INFO" else "CONFLICT"][w] for k, w in worst.items()}
    assert got == want
    assert {"CONSISTENT", "LIKELY_CONSISTENT", "DIFFERS", "CONFLICT"} <= set(want.values())


def test_best_value_prefers_confident_source(spark, rows):
    facts = facts_of(spark, [("a", "tin", "1", "d1", 0.3), ("a", "tin", "2", "d2", 0.7),
                             ("a", "tin", "3", "d3", 0.9), ("b", "tin", "4", "d4", 0.1),
                             ("b", "tin", "5", "d5", None)])
    assert [(r["account_id"], r["value"], r["n_facts"]) for r in rows(
        fa.choose_best(facts), "account_id")] == [("a", "2", 3), ("b", "4", 2)]


def test_other_items_and_form_owner(spark, rows):
    docs = spark.createDataFrame([
        ("a", "f", 0, "f.xlsx", "CUSTOMER_INFO_SHEET", None, None, [], [
            ("Tel. No.", "0917 123 4567", 1), ("E-mail", "none", 1), ("E-mail", "x@y.ph", 1)]),
        ("b", "g", 0, "g.xlsx", "CUSTOMER_INFO_SHEET", None, None, [], [])], DOCS)
    fields = spark.createDataFrame([
        ("f", "contact_person", "name", "Lia", None, None, 0.9),
        ("f", "contact_position", "text", "Owner / Manager", None, None, 0.9),
        ("g", "contact_person", "name", "Max", None, None, 0.9),
        ("g", "contact_position", "text", "Clerk", None, None, 0.9)], FIELDS)
    got = {(r["account_id"], r["attribute"], r["value"]) for r in rows(
        fa.collect_facts(docs, fields))}
    assert got == {("a", "owner_name", "Lia"), ("a", "contact_person", "Lia"),
                   ("b", "contact_person", "Max"), ("a", "phone", "0917 123 4567"),
                   ("a", "email", "x@y.ph")}


def test_contact_check_details(spark, rows):
    accounts = spark.createDataFrame([account(a) for a in "pqrst"], ACCOUNTS)
    contacts = spark.createDataFrame([
        contact("p", 0, roles={"Contact_of": "Sales"}, primary=True),
        contact("q", 0, mobile=None, phone="02 8123", email="bad"),
        contact("r", 0, name=None), contact("r", 1, name="Second"),
        contact("s", 0, roles={"Contact_of": "Accouting"})], CONTACTS)
    got = {r["account_id"]: (r["status"], r["detail"]) for r in rows(
        d._contact_check(accounts, contacts))}
    assert got["p"] == ("PASS", "Lia Cruz, +63 917 123 4567, lia@sol.ph (primary contact)")
    assert got["q"] == ("FAIL", "Lia Cruz needs a mobile number in Philippine format, e.g. 0917 "
                                "123 4567 (has 02 8123) and an email in a valid format, e.g. "
                                "name@company.com (has bad)")
    assert got["r"][1].startswith("Second, ")
    assert got["s"][0] == "PASS"
    assert got["t"] == ("FAIL", "no Contact with Contact of = Accounting or marked as the primary "
                                "contact")


def test_agreeing_of_a_large_group(spark, rows):
    from attesta.session import keep
    facts = facts_of(spark, [("a", "business_name", f"SOL GRILL {'X' * (i % 3)}", f"d{i}", 0.9)
                             for i in range(30)] + [("b", "tin", "234567890", "d1", 0.9),
                                                    ("b", "tin", "234-567-890-000", "d2", 0.9)])
    facts = keep(facts, "facts")
    best = fa.choose_best(facts)
    got = rows(fa.agreeing_documents(best, facts), "account_id")
    assert [r["agreeing"] for r in got] == [29, 1]
