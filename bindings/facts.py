"""Facts, checks, best values and decisions per account over customer and orders."""

from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.operators import decide as d
from attesta.operators import facts as fa
from attesta.session import keep
from bindings import register

# ---------------------------------------------------------------- shared input frames
# an account per customer
ACCOUNTS = ("SELECT cast(c_custkey AS string) AS account_id, c_name AS Account_Name, "
            "CASE c_nationkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Inactive' END AS Customer_Status, "
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'COD' WHEN 'MACHINERY' THEN 'Cash-On-Delivery' WHEN "
            "'FURNITURE' THEN NULL ELSE '30 days' END AS Credit_Terms, "
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'Single Proprietorship' WHEN 'FURNITURE' THEN "
            "'Corporation' WHEN 'MACHINERY' THEN 'Parnership' END AS Type_of_Business_Organization, "
            "CASE c_custkey % 4 WHEN 0 THEN 'Ana Reyes' WHEN 1 THEN '' WHEN 2 THEN 'Ben Cruz' END AS "
            "Owner_Name, CASE c_custkey % 3 WHEN 0 THEN '234567890' WHEN 1 THEN '999888777-001' END AS "
            "Tax_Identification_Number_TIN, CASE c_custkey % 5 WHEN 0 THEN 'ana@sol.ph' WHEN 1 THEN "
            "'x@y.ph' END AS Email, CASE WHEN c_custkey % 6 = 0 THEN 'SOL GRILL' WHEN c_custkey % 6 = 1 "
            "THEN 'BIG WAREHOUSE OF THE NORTH' END AS Invoice_Company_Name FROM {customer}")
_FORM = ("CASE Type_of_Business_Organization WHEN 'Single Proprietorship' THEN 'SOLE_PROPRIETORSHIP' "
         "WHEN 'Corporation' THEN 'CORPORATION' WHEN 'Parnership' THEN 'PARTNERSHIP' ELSE 'UNKNOWN' END")

# a fact per order: the priority tells the attribute, the key which of a few values
FACTS = ("SELECT cast(o_custkey AS string) AS account_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'tin' "
         "WHEN '2-HIGH' THEN 'owner_name' WHEN '3-MEDIUM' THEN 'email' WHEN '4-NOT SPECIFIED' THEN 'phone' "
         "ELSE 'business_name' END AS attribute, o_orderkey % 3 AS rank, o_orderkey AS doc_pos, 0 AS seq, "
         "CASE o_orderpriority "
         "WHEN '1-URGENT' THEN CASE WHEN o_orderkey % 5 < 3 THEN '234-567-890-00000' WHEN o_orderkey % 5 = 3 "
         "THEN '234567890' ELSE '999-888-777-001' END "
         "WHEN '2-HIGH' THEN CASE o_orderkey % 8 WHEN 0 THEN 'ANA LUNA REYES' WHEN 1 THEN 'BEN CRUZ' WHEN 2 "
         "THEN 'ANA REYES' ELSE 'REYES, ANA' END "
         "WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Ana@Sol.ph' ELSE 'ana@sol.ph' END "
         "WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 6 = 0 THEN '0917 123 4567' WHEN o_orderkey % 6 "
         "= 1 THEN '8123' ELSE '+63 917 123 4567' END "
         "ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'SOL GRILL HOUSE' WHEN o_orderkey % 21 = 1 THEN "
         "'BIG WAREHOUSE OF THE NORTH' ELSE 'Sol Grill' END END AS value, "
         "concat(cast(o_custkey AS string), '-', cast(o_orderkey % 4 AS string)) AS doc_id, "
         "concat('f', cast(o_orderkey AS string)) AS file_name, o_orderstatus AS document_type, "
         "'field' AS source_field, CASE WHEN o_orderkey % 2 = 0 THEN 'EXACT' ELSE 'FUZZY' END AS grounding, "
         "CASE WHEN o_totalprice < 150000 THEN 0.5 WHEN o_totalprice < 300000 THEN 0.8 ELSE 0.95 END AS "
         "confidence, CASE WHEN o_orderpriority = '1-URGENT' THEN '234-567-890-00000' END AS normalized "
         "FROM {orders}")
FACTS = FACTS.replace("0.5 WHEN", "cast(0.5 AS double) WHEN").replace(
    "0.8 WHEN", "cast(0.8 AS double) WHEN").replace("0.95 END", "cast(0.95 AS double) END")
# what the matchers see of those values, and how two of them compare
_FORMS = """
    , fv AS (SELECT *, CASE attribute
        WHEN 'tin' THEN substr(regexp_replace(value, '[^0-9]', '', 'g'), 1, 9)
        WHEN 'owner_name' THEN CASE value WHEN 'REYES, ANA' THEN 'ANA REYES' ELSE value END
        WHEN 'email' THEN lower(value)
        WHEN 'phone' THEN CASE value WHEN '8123' THEN '8123' ELSE '9171234567' END
        ELSE upper(value) END AS form FROM facts),
    v(x, y, verdict) AS (VALUES ('ANA REYES', 'ANA LUNA REYES', 1), ('ANA LUNA REYES', 'ANA REYES', 1),
        ('SOL GRILL', 'SOL GRILL HOUSE', 1), ('SOL GRILL HOUSE', 'SOL GRILL', 1))"""
_CHECKS = _FORMS + """
    , prs AS (SELECT a.account_id, a.attribute, CASE WHEN a.form = b.form THEN 0 ELSE
            coalesce(verdict, 2) END AS r
        FROM fv a JOIN fv b ON a.account_id = b.account_id AND a.attribute = b.attribute
            AND a.doc_pos < b.doc_pos AND a.doc_id <> b.doc_id
        LEFT JOIN v ON x = a.form AND y = b.form),
    checks AS (SELECT account_id, attribute, CASE max(r) WHEN 0 THEN 'CONSISTENT' WHEN 1 THEN
            'LIKELY_CONSISTENT' ELSE CASE WHEN attribute IN ('email', 'phone') THEN 'DIFFERS' ELSE
            'CONFLICT' END END AS status,
        CASE WHEN max(r) = 2 AND attribute IN ('tin', 'owner_name') THEN 'CRITICAL' WHEN max(r) = 2 AND
            attribute = 'business_name' THEN 'WARNING' ELSE 'INFO' END AS severity
        FROM prs GROUP BY account_id, attribute)"""

# ---------------------------------------------------------------- E1
FIELD_DOCS = ("SELECT cast(o_custkey AS string) AS account_id, cast(o_orderkey AS string) AS doc_id, "
              "o_orderkey AS doc_pos, concat('f', cast(o_orderkey AS string)) AS file_name, "
              "CASE o_orderpriority WHEN '1-URGENT' THEN 'BIR_2303' WHEN '2-HIGH' THEN 'DTI_BN_CERT' WHEN "
              "'3-MEDIUM' THEN 'MAYORS_PERMIT' ELSE 'CUSTOMER_INFO_SHEET' END AS document_type FROM {orders}")
FIELDS = ("SELECT cast(o_orderkey AS string) AS doc_id, 'taxpayer_type' AS name, CASE o_custkey % 3 WHEN 0 THEN "
          "'Domestic Corporation' ELSE 'Single Proprietorship' END AS value FROM {orders} UNION ALL "
          "SELECT cast(o_orderkey AS string), 'taxpayer_name', concat('P', cast(o_orderkey AS string)) FROM "
          "{orders} UNION ALL SELECT cast(o_orderkey AS string), 'owner_name', concat('O', "
          "cast(o_orderkey AS string)) FROM {orders} UNION ALL SELECT cast(o_orderkey AS string), "
          "'contact_person', concat('C', cast(o_orderkey AS string)) FROM {orders} UNION ALL SELECT "
          "cast(o_orderkey AS string), 'contact_position', CASE WHEN o_orderkey % 4 = 0 THEN 'Co-Owner' ELSE "
          "'Clerk' END FROM {orders}")


def _fields(fields):
    none = F.lit(None).cast("string")
    return fields.withColumns({"normalized": none, "grounding": F.lit("EXACT"),
                               "confidence": F.lit(0.9)})


def _collect(docs, fields):
    other = F.when(F.col("doc_pos") % 5 == 0, F.array(F.struct(
        F.lit("Mobile no").alias("label"), F.concat(F.lit("0917"), "doc_id").alias("value"))))
    return fa.collect_facts(docs.withColumn("other_fields", other), _fields(fields)).select(
        "account_id", "attribute", "value", "doc_id", "source_field")


register("collect_facts", {"docs": FIELD_DOCS, "flds": FIELDS},
    lambda docs, flds: _collect(docs, flds),
    """
    , b AS (SELECT account_id, arg_min(value, doc_pos) AS kind FROM docs JOIN flds USING (doc_id) WHERE
            document_type = 'BIR_2303' AND name = 'taxpayer_type' GROUP BY account_id),
    r(attribute, document_type, name) AS (VALUES ('owner_name', 'DTI_BN_CERT', 'owner_name'),
        ('owner_name', 'MAYORS_PERMIT', 'owner_name'), ('owner_name', 'BIR_2303', 'taxpayer_name'),
        ('owner_name', 'CUSTOMER_INFO_SHEET', 'contact_person'),
        ('registered_name', 'BIR_2303', 'taxpayer_name'), ('taxpayer_type', 'BIR_2303', 'taxpayer_type'),
        ('contact_person', 'CUSTOMER_INFO_SHEET', 'contact_person'))
    SELECT d.account_id, r.attribute, f.value, d.doc_id, f.name AS source_field
    FROM docs d JOIN flds f USING (doc_id) JOIN r ON r.document_type = d.document_type AND r.name = f.name
        LEFT JOIN b ON b.account_id = d.account_id
    WHERE NOT (attribute = 'owner_name' AND d.document_type = 'BIR_2303' AND kind = 'Domestic Corporation')
        AND NOT (attribute = 'owner_name' AND d.document_type = 'CUSTOMER_INFO_SHEET' AND doc_pos % 4 <> 0)
    UNION ALL SELECT account_id, 'phone', '0917' || doc_id, doc_id, 'other: Mobile no' FROM docs
    WHERE doc_pos % 5 = 0
    """)

# ---------------------------------------------------------------- E2-E5, F1-F3
register("match_pairs", {"customers": "SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN concat('the ', "
                         "c_name) WHEN 1 THEN concat(c_name, ' Corp.') ELSE 'another name altogether here' "
                         "END AS other FROM {customer}"},
    lambda customers: fa.match_pairs(customers, "business", "c_name", "other").select(
        "c_custkey", "verdict"),
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'LIKELY_SAME' WHEN 1 THEN 'SAME' ELSE 'DIFFERENT'
       END AS verdict FROM customers""")
register("match_people", {"sups": "SELECT s_suppkey, concat('Cruz, Ana ', CASE WHEN s_suppkey % 2 = 0 THEN "
                          "'Luna' ELSE 'B.' END) AS a, CASE WHEN s_suppkey % 3 = 0 THEN 'Ana Cruz' ELSE "
                          "'Ben Cruz' END AS b FROM {supplier}"},
    lambda sups: fa.match_pairs(sups, "person").select("s_suppkey", "verdict"),
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'DIFFERENT' WHEN s_suppkey % 2 = 0 THEN
       'LIKELY_SAME' ELSE 'SAME' END AS verdict FROM sups""")
# similarity proper: names with one letter or with seven letters misread
register("match_similar", {"names": "SELECT c_custkey, concat('General Merchandise ', c_name) AS a, concat(CASE WHEN "
                           "c_custkey % 2 = 0 THEN 'Genexal Merchandise ' ELSE 'Gxnxrxl Mxrchxndxsx ' END, c_name) AS b "
                           "FROM {customer}"},
    lambda names: fa.match_pairs(names, "business").select("c_custkey", "verdict"),
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'LIKELY_SAME' ELSE 'DIFFERENT' END AS verdict
       FROM names""")

register("facts_cross_check", {"facts": FACTS},
    lambda facts: fa.cross_check(facts).select("account_id", "attribute", "status", "severity"),
    _CHECKS + " SELECT account_id, attribute, status, severity FROM checks")

register("conflict_texts", {"facts": FACTS},
    lambda facts: fa.conflict_texts(facts, fa.cross_check(facts)).select(
        "account_id", "attribute", "message"),
    _CHECKS + """ SELECT account_id, attribute, 'Documents disagree on ' || attribute || ': ' ||
        string_agg(value || ' (' || document_type || ')', ' vs ' ORDER BY rank, doc_pos) AS message
    FROM facts JOIN checks USING (account_id, attribute) WHERE severity = 'CRITICAL'
    GROUP BY account_id, attribute""")

register("compare_values", {"docs": "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'date' WHEN 1 THEN "
                            "'code' WHEN 2 THEN 'tin' ELSE 'address' END AS kind, CASE o_orderkey % 4 WHEN 0 "
                            "THEN cast(cast(o_orderdate AS date) AS string) WHEN 1 THEN cast(o_custkey AS "
                            "string) WHEN 2 THEN cast(100000000 + o_custkey AS string) ELSE concat('BLOCK ', "
                            "cast(o_custkey % 5 AS string), ' RIZAL') END AS a, CASE o_orderkey % 4 WHEN 0 THEN "
                            "concat(cast(month(o_orderdate) AS string), '/', cast(day(o_orderdate) AS string), "
                            "'/', cast(year(o_orderdate) AS string)) WHEN 1 THEN concat('No. ', "
                            "cast(o_custkey % 700 AS string)) WHEN 2 THEN concat(cast(100000000 + o_custkey AS "
                            "string), '-000') ELSE CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Block ', "
                            "cast(o_orderkey % 5 AS string), ', Rizal') END END AS b FROM {orders}"},
    lambda docs: fa.compare_values(docs).select("id", "kind", "verdict"),
    """SELECT id, kind, CASE WHEN b = '' THEN NULL WHEN kind = 'tin' THEN 'SAME'
        WHEN kind = 'date' THEN CASE WHEN cast(split_part(b, '/', 1) AS int) > 12 THEN 'x' ELSE 'SAME' END
        WHEN kind = 'code' THEN CASE WHEN 'No. ' || a = b THEN 'SAME' ELSE 'DIFFERENT' END
        WHEN replace(upper(b), ',', '') = a THEN 'SAME' ELSE 'DIFFERENT' END AS verdict FROM docs""")

_CHOSEN = """
    , w AS (SELECT *, row_number() OVER (PARTITION BY account_id, attribute
            ORDER BY CASE WHEN confidence >= 0.6 THEN 0 ELSE 1 END, rank, doc_pos) AS rn,
            count(*) OVER (PARTITION BY account_id, attribute) AS n_facts FROM fv),
    chosen AS (SELECT * FROM w WHERE rn = 1)"""
_AGREE = _CHOSEN + """
    , agree AS (SELECT c.account_id, c.attribute, count(*) FILTER (f.doc_id <> c.doc_id AND CASE
            WHEN c.attribute = 'tin' THEN replace(replace(f.value, '-', ''), '00000', '') =
                replace(replace(c.value, '-', ''), '00000', '')
            ELSE f.form = c.form OR verdict IS NOT NULL END) AS agreeing
        FROM chosen c JOIN fv f USING (account_id, attribute)
        LEFT JOIN v ON x = c.form AND y = f.form GROUP BY ALL)"""


def _chosen(facts):
    best = fa.choose_best(facts)
    return fa.consensus_confidence(best, fa.agreeing_documents(best, facts))


register("best_value", {"facts": FACTS},
    lambda facts: fa.choose_best(facts).select(
        "account_id", "attribute", "value", "doc_id", "confidence", "n_facts"),
    _FORMS + _CHOSEN + """ SELECT account_id, attribute, value, doc_id, confidence, n_facts
    FROM chosen""")
register("agreeing", {"facts": FACTS},
    lambda facts: fa.agreeing_documents(fa.choose_best(facts), facts),
    _FORMS + _AGREE + " SELECT account_id, attribute, agreeing FROM agree")
register("consensus", {"facts": FACTS},
    lambda facts: _chosen(facts).select("account_id", "attribute", "agreeing", "consensus"),
    _FORMS + _AGREE + """ SELECT account_id, attribute, agreeing,
        round(least(0.98, confidence + 0.05::double * agreeing), 2) AS consensus
    FROM agree JOIN chosen USING (account_id, attribute)""")

register("business_form", {"accounts": ACCOUNTS, "types": "SELECT DISTINCT cast(o_custkey AS string) AS "
                           "account_id, 'taxpayer_type' AS attribute, 'SOLE PROPRIETOR' AS value FROM {orders} "
                           "WHERE o_totalprice > 480000"},
    lambda accounts, types: fa.account_forms(accounts, types).select("account_id", "business_form"),
    f"""SELECT account_id, CASE WHEN t.value IS NOT NULL THEN 'SOLE_PROPRIETORSHIP' ELSE {_FORM} END AS
        business_form FROM accounts LEFT JOIN types t USING (account_id)""")

# ---------------------------------------------------------------- F4, F5, F8
_PROPOSED = _CHECKS + _AGREE + f"""
    , ac AS (SELECT *, {_FORM} AS business_form FROM accounts),
    p0 AS (SELECT c.account_id, c.attribute, c.value, c.grounding, agreeing, normalized, business_form,
            round(least(0.98, c.confidence + 0.05::double * agreeing), 2) AS conf,
            CASE c.attribute WHEN 'tin' THEN Tax_Identification_Number_TIN WHEN 'owner_name' THEN Owner_Name
                WHEN 'email' THEN Email WHEN 'business_name' THEN Invoice_Company_Name END AS cur,
            CASE c.attribute WHEN 'tin' THEN normalized WHEN 'owner_name' THEN
                CASE c.value WHEN 'REYES, ANA' THEN 'ANA REYES' ELSE c.value END ELSE c.value END AS prop,
            coalesce(k.status = 'CONFLICT', false) AS clash
        FROM chosen c JOIN agree USING (account_id, attribute) JOIN ac USING (account_id)
        LEFT JOIN checks k USING (account_id, attribute)
        WHERE c.attribute <> 'business_name' OR business_form NOT IN ('CORPORATION', 'PARTNERSHIP')),
    p1 AS (SELECT *, CASE WHEN clash AND attribute NOT IN ('email', 'phone') THEN 'REVIEW_CONFLICT'
            WHEN cur IS NULL OR cur = '' THEN 'FILL'
            WHEN CASE attribute WHEN 'tin' THEN cur = '234567890' WHEN 'owner_name' THEN
                (cur = 'Ana Reyes' AND prop LIKE 'ANA%') OR (cur = 'Ben Cruz' AND prop = 'BEN CRUZ')
                WHEN 'email' THEN cur = lower(prop) ELSE upper(cur) = upper(prop) OR
                contains(upper(prop), upper(cur)) END THEN 'MATCH'
            WHEN attribute IN ('email', 'phone') THEN 'DIFFERS' ELSE 'CORRECT' END AS action FROM p0),
    props AS (SELECT account_id, CASE attribute WHEN 'tin' THEN 'Tax_Identification_Number_TIN' WHEN
            'owner_name' THEN 'Owner_Name' WHEN 'email' THEN 'Email' WHEN 'phone' THEN 'Phone' ELSE
            'Invoice_Company_Name' END AS target_field, cur AS current_value,
        CASE WHEN action IN ('FILL', 'CORRECT') THEN prop WHEN action = 'MATCH' THEN cur END AS
            proposed_value, action, CASE WHEN action <> 'REVIEW_CONFLICT' THEN conf END AS confidence,
        CASE WHEN action <> 'REVIEW_CONFLICT' THEN grounding END AS grounding,
        CASE WHEN action <> 'REVIEW_CONFLICT' THEN agreeing + 1 ELSE 0 END AS agreeing_documents,
        CASE WHEN action = 'MATCH' THEN false WHEN action IN ('REVIEW_CONFLICT', 'DIFFERS') THEN true
            ELSE conf < 0.6 END AS needs_attention FROM p1)"""
_PCOLS = ("account_id", "target_field", "current_value", "proposed_value", "action", "confidence",
          "grounding", "agreeing_documents", "needs_attention")


def _propose(accounts, facts):
    chosen = keep(_chosen(facts), "chosen")
    formed = fa.account_forms(accounts, chosen)
    checks = fa.cross_check(facts)
    return d.propose_changes(chosen, formed, checks), checks


register("propose", {"accounts": ACCOUNTS, "facts": FACTS},
    lambda accounts, facts: _propose(accounts, facts)[0].select(*_PCOLS),
    _PROPOSED + f" SELECT {', '.join(_PCOLS)} FROM props")

register("account_name", {"accounts": "SELECT cast(c_custkey AS string) AS account_id, CASE WHEN c_nationkey % 2 "
                          "= 0 THEN 'SOL' WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'Warehouse of the North' END "
                          "AS Account_Name FROM {customer}", "facts": FACTS},
    lambda accounts, facts: d.compare_account_name(accounts, facts).select(
        "account_id", "current_value", "action", "needs_attention"),
    """SELECT a.account_id, Account_Name AS current_value,
        CASE WHEN bool_or(contains(upper(value), upper(Account_Name))) THEN 'MATCH' ELSE 'DIFFERS' END AS
            action, NOT bool_or(contains(upper(value), upper(Account_Name))) AS needs_attention
    FROM accounts a JOIN facts f ON f.account_id = a.account_id AND attribute = 'business_name'
    WHERE Account_Name IS NOT NULL GROUP BY ALL""")

PROPOSALS = ("SELECT cast(o_custkey AS string) AS account_id, CASE o_orderpriority WHEN '1-URGENT' THEN "
             "'Tax_Identification_Number_TIN' WHEN '2-HIGH' THEN 'Owner_Name' WHEN '3-MEDIUM' THEN 'Email' WHEN "
             "'4-NOT SPECIFIED' THEN 'Business_Style' ELSE 'Invoice_Company_Name' END AS target_field, "
             "cast(min(o_orderkey) AS int) AS pos, 'attr' AS attribute, cast(NULL AS string) AS current_value, "
             "CASE WHEN min(o_orderkey) % 13 = 0 THEN '' ELSE concat('new', cast(min(o_orderkey) AS string)) END "
             "AS proposed_value, CASE min(o_orderkey) % 4 WHEN 0 THEN 'FILL' WHEN 1 THEN 'CORRECT' WHEN 2 THEN "
             "'MATCH' ELSE 'DIFFERS' END AS action, CASE WHEN min(o_orderkey) % 7 = 0 THEN cast(NULL AS double) "
             "WHEN min(o_orderkey) % 7 < 4 THEN cast(0.98 AS double) ELSE cast(0.9 AS double) END AS confidence, "
             "CASE WHEN min(o_orderkey) % 5 = 0 THEN 'FUZZY' ELSE 'EXACT' END AS grounding, count(*) AS "
             "agreeing_documents, min(o_orderkey) % 11 = 0 AS needs_attention, 'why.' AS reason FROM {orders} "
             "GROUP BY o_custkey, o_orderpriority")
CRITICAL = ("SELECT cast(c_custkey AS string) AS account_id, 'tin' AS attribute, 3 AS attribute_pos, 'CONFLICT' AS "
            "status, CASE WHEN c_custkey % 4 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM {customer} "
            "WHERE c_acctbal > 4000 UNION ALL SELECT cast(c_custkey AS string), 'owner_name', 0, 'CONFLICT', "
            "'CRITICAL' FROM {customer} WHERE c_acctbal > 9000")
_HELD = """
    , held AS (SELECT account_id, string_agg(attribute, ', ' ORDER BY attribute_pos) AS h FROM crit
               WHERE severity = 'CRITICAL' GROUP BY account_id)"""
register("hold", {"props": PROPOSALS, "crit": CRITICAL},
    lambda props, crit: d.hold_conflicted(props, crit).select(
        "account_id", "target_field", "action", "needs_attention", "reason"),
    _HELD + """ SELECT account_id, target_field,
        CASE WHEN h IS NOT NULL AND action IN ('FILL', 'CORRECT') THEN 'HOLD' ELSE action END AS action,
        needs_attention OR (h IS NOT NULL AND action IN ('FILL', 'CORRECT')) AS needs_attention,
        CASE WHEN h IS NOT NULL AND action IN ('FILL', 'CORRECT') THEN 'On hold: documents disagree on ' ||
            h || '. Confirm which documents belong to this customer first. ' || reason ELSE reason END AS
            reason
    FROM props LEFT JOIN held USING (account_id)""")

# ---------------------------------------------------------------- F6, F7, F11-F13
DOCS = ("SELECT cast(o_custkey AS string) AS account_id, cast(o_orderkey AS string) AS doc_id, o_orderkey AS "
        "doc_pos, concat('f', cast(o_orderkey AS string)) AS file_name, CASE o_orderpriority WHEN '1-URGENT' THEN "
        "'BIR_2303' WHEN '2-HIGH' THEN 'DTI_BN_CERT' WHEN '3-MEDIUM' THEN 'MAYORS_PERMIT' WHEN '4-NOT SPECIFIED' "
        "THEN 'SEC_CERT' ELSE 'GIS' END AS document_type, CASE o_orderkey % 5 WHEN 0 THEN 'VALID' WHEN 1 THEN "
        "'EXPIRED' WHEN 2 THEN 'NO_EXPIRY' WHEN 3 THEN 'UNKNOWN' END AS validity_status, CASE WHEN o_orderkey % 5 "
        "< 2 THEN cast(cast(o_orderdate AS date) AS string) END AS valid_until FROM {orders}")
_FORMED = ("SELECT cast(c_custkey AS string) AS account_id, CASE c_mktsegment WHEN 'BUILDING' THEN "
           "'SOLE_PROPRIETORSHIP' WHEN 'FURNITURE' THEN 'CORPORATION' WHEN 'MACHINERY' THEN 'PARTNERSHIP' ELSE "
           "'UNKNOWN' END AS business_form, c_nationkey, c_custkey, c_acctbal FROM {customer}")
_REQ = """
    , rq(business_form, rule_pos, document_type) AS (VALUES
        ('SOLE_PROPRIETORSHIP', 0, 'BIR_2303'), ('SOLE_PROPRIETORSHIP', 1, 'DTI_BN_CERT'),
        ('SOLE_PROPRIETORSHIP', 2, 'MAYORS_PERMIT'), ('CORPORATION', 0, 'BIR_2303'),
        ('CORPORATION', 1, 'SEC_CERT'), ('CORPORATION', 2, 'MAYORS_PERMIT'),
        ('PARTNERSHIP', 0, 'BIR_2303'), ('PARTNERSHIP', 1, 'SEC_CERT'), ('PARTNERSHIP', 2, 'MAYORS_PERMIT'),
        ('UNKNOWN', 0, 'BIR_2303'), ('UNKNOWN', 1, 'MAYORS_PERMIT')),
    cand AS (SELECT *, row_number() OVER (PARTITION BY account_id, document_type ORDER BY
        CASE WHEN validity_status IN ('VALID', 'NO_EXPIRY') THEN 0 ELSE 1 END,
        coalesce(valid_until, '') DESC, doc_pos) AS rn FROM docs),
    reqs AS (SELECT f.account_id, rule_pos, document_type,
        CASE WHEN doc_id IS NULL THEN 'MISSING' ELSE coalesce(validity_status, 'UNKNOWN') END AS status,
        file_name AS file, valid_until
        FROM formed f JOIN rq USING (business_form)
        LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c USING (account_id, document_type))"""
register("requirements", {"docs": DOCS, "formed": _FORMED},
    lambda docs, formed: d.check_requirements(docs, formed).drop("valid_until_source", "rule_pos"),
    _REQ + " SELECT account_id, document_type, status, file, valid_until FROM reqs")

register("attachments", {"docs": DOCS, "formed": _FORMED},
    lambda docs, formed: d.propose_attachments(docs, formed.withColumn(
        "Business_Permit", F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("x"))))).select(
        "account_id", "target_field", "proposed_value", "reason"),
    """
    , r(document_type, target_field, title) AS (VALUES ('MAYORS_PERMIT', 'Business_Permit', 'Mayors Permit'),
        ('BIR_2303', 'BIR_Registration_COR', 'Bir 2303'), ('DTI_BN_CERT', 'Business_registration',
        'Dti Bn Cert'), ('SEC_CERT', 'Business_registration', 'Sec Cert'),
        ('GIS', 'General_Information_Sheet', 'Gis')),
    c AS (SELECT *, row_number() OVER (PARTITION BY account_id, document_type ORDER BY
          coalesce(valid_until, '') DESC, doc_pos) AS rn FROM docs
          WHERE validity_status IN ('VALID', 'NO_EXPIRY', 'UNKNOWN'))
    SELECT account_id, target_field, file_name AS proposed_value,
        'Attach the ' || title || ' to this field.' AS reason
    FROM c JOIN r USING (document_type) JOIN formed USING (account_id)
    WHERE rn = 1 AND NOT (target_field = 'Business_Permit' AND c_nationkey % 2 = 0)
    """)



def _issues():
    pos = F.col("doc_pos") % 10
    return F.when(pos == 0, F.array(
        t.issue("BRANCH_MISMATCH", "office", "tin", "CRITICAL"),
        t.issue("EXPIRED", "old", None, "CRITICAL"))).when(
        pos == 4, F.array(t.issue("VALIDITY_DERIVED", "Dec 31"))).otherwise(
        F.array().cast(t.ISSUES))


PRINTED = ("SELECT cast(o_orderkey AS string) AS doc_id, CASE WHEN o_orderpriority = '2-HIGH' THEN 'valid_to' ELSE "
           "'valid_until' END AS name, cast(cast(o_orderdate AS date) AS string) AS value FROM {orders} WHERE "
           "o_orderkey % 3 > 0")
register("until_source", {"docs": DOCS, "printed": PRINTED},
    lambda docs, printed: d.valid_until_source(docs.withColumn("issues", _issues()), printed).select(
        "doc_id", "valid_until_source"),
    """SELECT doc_id, CASE WHEN validity_status = 'NO_EXPIRY' OR document_type = 'BIR_2303' THEN
        'no expiry for this document type' WHEN doc_pos % 10 = 4 THEN 'derived: Dec 31'
        WHEN document_type IN ('DTI_BN_CERT', 'MAYORS_PERMIT') AND value IS NOT NULL THEN
            name || ' as printed: ' || value END AS valid_until_source
    FROM docs LEFT JOIN printed USING (doc_id)""")

register("document_data", {"docs": DOCS, "printed": PRINTED},
    lambda docs, printed: d.document_data(docs, printed).select(
        "account_id", F.array_join(F.transform("documents", lambda x: F.concat_ws(
            "|", x["file"], x["type"], x["validity"], F.map_values(x["fields"]))), "; ")
        .alias("data")),
    """SELECT account_id, string_agg(concat_ws('|', file_name, document_type, validity_status, value), '; '
       ORDER BY doc_pos) AS data FROM docs LEFT JOIN printed USING (doc_id) GROUP BY account_id""")

STORED = ("SELECT cast(o_custkey AS string) AS account_id, cast(o_orderkey AS string) AS doc_id, o_orderkey AS "
          "doc_pos, concat('f', cast(o_orderkey AS string)) AS file_name, cast(o_orderkey AS string) AS sha256, "
          "CASE o_orderkey % 6 WHEN 0 THEN 'DUPLICATE' WHEN 1 THEN 'REJECTED' ELSE 'STORED' END AS status, "
          "CASE WHEN o_orderkey % 6 < 2 THEN 'why' END AS status_detail FROM {orders}")
EXTRACTED = ("SELECT cast(o_orderkey AS string) AS sha256, CASE WHEN o_orderkey % 5 = 0 THEN 'FAILED' ELSE "
             "'EXTRACTED' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' END AS error FROM {orders} "
             "WHERE o_totalprice > 60000")
_UNUSABLE = """SELECT account_id, doc_id, doc_pos, file_name, coalesce(x.status, 'MISSING') AS status,
        error AS detail, 'not_extracted' AS list FROM stored d LEFT JOIN extracted x USING (sha256)
    WHERE d.status = 'STORED' AND coalesce(x.status, 'MISSING') <> 'EXTRACTED'
    UNION ALL SELECT account_id, doc_id, doc_pos, file_name, status, status_detail, 'skipped' FROM stored
    WHERE status <> 'STORED'"""
register("unusable", {"stored": STORED, "extracted": EXTRACTED},
    lambda stored, extracted: d.unusable_documents(stored, extracted), _UNUSABLE)

# ---------------------------------------------------------------- F9, F10
CONTACTS = ("SELECT cast(o_custkey AS string) AS account_id, o_orderkey AS contact_pos, CASE WHEN o_orderkey % 4 > 0 "
            "THEN concat('N', cast(o_orderkey AS string)) END AS name, CASE WHEN o_orderkey % 3 > 0 THEN 'a@b.ph' "
            "ELSE 'bad' END AS email, CASE WHEN o_orderkey % 5 > 0 THEN '0917 123 4567' END AS mobile, '8123' AS "
            "phone, o_orderkey % 6 = 0 AS prim, CASE WHEN o_orderkey % 5 = 1 THEN 'Accounting' ELSE 'Sales' END AS "
            "role FROM {orders}")


def _activation(accounts, facts, people):
    chosen = keep(_chosen(facts), "chosen")
    formed = fa.account_forms(accounts, chosen)
    proposals = keep(d.propose_changes(chosen, formed, fa.cross_check(facts)), "proposals")
    contacts = people.withColumn("primary", F.col("prim")).withColumn(
        "roles", F.create_map(F.lit("Contact_of"), F.col("role")))
    return d.activation_checks(formed, contacts, chosen, proposals)


register("activation", {"accounts": ACCOUNTS, "facts": FACTS, "people": CONTACTS},
    lambda accounts, facts, people: _activation(accounts, facts, people).where(
        F.col("key") != "billing_address").select("account_id", "key", "status", "detail"),
    _PROPOSED + """
    , el AS (SELECT *, name IS NOT NULL AND mobile IS NOT NULL AND email <> 'bad' AS ok FROM people
             WHERE prim OR role = 'Accounting'),
    fc AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY CASE WHEN ok THEN 0 ELSE 1 END,
           contact_pos) AS rn FROM el)
    SELECT account_id, 'payment_terms' AS key, CASE WHEN Credit_Terms IN ('COD', 'Cash-On-Delivery') THEN
        'PASS' ELSE 'FAIL' END AS status, 'Payment Terms: ' || coalesce(Credit_Terms, 'empty') AS detail
    FROM accounts
    UNION ALL SELECT a.account_id, 'accounting_contact', CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END,
        CASE WHEN c.account_id IS NULL THEN
            'no Contact with Contact of = Accounting or marked as the primary contact'
        WHEN ok THEN name || ', +63 917 123 4567, a@b.ph' || CASE WHEN prim THEN ' (primary contact)' ELSE
            ' (Accounting)' END
        ELSE coalesce(c.name, 'The contact') || ' needs ' || concat_ws(' and ',
            CASE WHEN c.name IS NULL THEN 'a name' END, CASE WHEN mobile IS NULL THEN
            'a mobile number in Philippine format, e.g. 0917 123 4567 (has 8123)' END, CASE WHEN c.email =
            'bad' THEN 'an email in a valid format, e.g. name@company.com (has bad)' END) END
    FROM accounts a LEFT JOIN (SELECT * FROM fc WHERE rn = 1) c USING (account_id)
    UNION ALL SELECT a.account_id, k.key, CASE WHEN c.value IS NULL THEN 'FAIL' WHEN ok THEN 'PASS' WHEN
            p.action IN ('FILL', 'CORRECT') THEN 'AFTER_UPDATE' ELSE 'FAIL' END,
        CASE WHEN c.value IS NULL THEN 'not found on the documents'
        WHEN ok THEN 'matches ' || document_type || ': ' || c.value
        WHEN p.action IN ('FILL', 'CORRECT') THEN CASE WHEN cur = '' THEN 'empty' ELSE '''' || cur || ''''
            END || ' - to be ' || CASE p.action WHEN 'FILL' THEN 'filled' ELSE 'corrected' END || ' with ' ||
            p.proposed_value
        WHEN cur = '' THEN 'empty in CRM' ELSE 'CRM has ' || cur || ', documents say ' || c.value END
    FROM (SELECT *, coalesce(Tax_Identification_Number_TIN, '') AS tin_, coalesce(Invoice_Company_Name, '')
          AS inv_ FROM ac) a
    CROSS JOIN (VALUES ('tin', 'tin', 'Tax_Identification_Number_TIN'),
        ('invoice_name', 'business_name', 'Invoice_Company_Name')) k(key, attribute, target_field)
    LEFT JOIN chosen c ON c.account_id = a.account_id AND c.attribute = k.attribute
    LEFT JOIN props p ON p.account_id = a.account_id AND p.target_field = k.target_field,
    LATERAL (SELECT CASE k.key WHEN 'tin' THEN tin_ ELSE inv_ END AS cur) l1,
    LATERAL (SELECT cur <> '' AND CASE k.key WHEN 'tin' THEN
        replace(replace(c.value, '-', ''), '00000', '') = replace(cur, '-', '')
        ELSE upper(cur) = upper(c.value) OR contains(upper(c.value), upper(cur)) OR
             contains(upper(cur), upper(c.value)) END AS ok) l2
    """)

# the fifth check: a street like the documents', another one, a city alone, nothing
STREETS = ("SELECT cast(c_custkey AS string) AS account_id, CASE c_custkey % 3 WHEN 0 THEN concat('Unit ', "
           "cast(c_custkey AS string), ' Rizal Street') WHEN 1 THEN 'Somewhere else altogether' END AS Billing_Street, "
           "CASE WHEN c_custkey % 2 = 0 THEN 'Pasig' END AS Billing_City, 'UNKNOWN' AS business_form FROM {customer}")
PLACES = ("SELECT cast(c_custkey AS string) AS account_id, 'address' AS attribute, CASE WHEN c_custkey % 5 = 0 THEN "
          "'BLOCK 9 NOWHERE' ELSE concat('UNIT ', cast(c_custkey AS string), ' RIZAL STREET, PASIG') END AS value, "
          "'BIR_2303' AS document_type FROM {customer} WHERE c_custkey % 7 > 0")
MOVES = ("SELECT cast(c_custkey AS string) AS account_id, 'Billing_Street' AS target_field, CASE WHEN c_custkey % 8 = 0 "
         "THEN 'FILL' ELSE 'CORRECT' END AS action, 'the new street' AS proposed_value FROM {customer} WHERE c_custkey % 4 = 0")
register("activation_address", {"accounts": STREETS, "chosen": PLACES, "moves": MOVES, "people": CONTACTS},
    lambda accounts, chosen, moves, people: d.activation_checks(
        accounts, people.withColumn("primary", F.col("prim")).withColumn(
            "roles", F.create_map(F.lit("Contact_of"), F.col("role"))).where("account_id IS NULL"), chosen, moves).select(
        "account_id", "key", "status", "detail"),
    """
    , x AS (SELECT a.account_id, nullif(concat_ws(', ', Billing_Street, Billing_City), '') AS now, value, document_type, action,
        proposed_value, Billing_Street FROM accounts a LEFT JOIN chosen USING (account_id) LEFT JOIN moves USING (account_id)),
    y AS (SELECT *, now IS NOT NULL AND NOT starts_with(value, 'BLOCK') AND coalesce(Billing_Street, '') NOT LIKE 'Some%' AS ok FROM x)
    SELECT account_id, 'billing_address' AS key, CASE WHEN value IS NULL THEN 'FAIL' WHEN ok THEN 'PASS' WHEN action IS NOT NULL
        THEN 'AFTER_UPDATE' ELSE 'FAIL' END AS status, CASE WHEN value IS NULL THEN 'not found on the documents'
        WHEN ok THEN 'matches ' || document_type || ': ' || value WHEN action IS NOT NULL THEN coalesce(chr(39) || now || chr(39), 'empty') ||
        ' - to be ' || CASE action WHEN 'FILL' THEN 'filled' ELSE 'corrected' END || ' with ' || proposed_value
        WHEN now IS NULL THEN 'empty in CRM' ELSE 'CRM has ' || now || ', documents say ' || value END AS detail FROM y
    UNION ALL SELECT account_id, key, 'FAIL', detail FROM accounts CROSS JOIN (VALUES ('payment_terms', 'Payment Terms: empty'),
        ('accounting_contact', 'no Contact with Contact of = Accounting or marked as the primary contact'),
        ('tin', 'not found on the documents'), ('invoice_name', 'not found on the documents')) v(key, detail)
    """)

TEXTS = ("SELECT account_id, attribute_pos, concat('Documents disagree on ', attribute) AS message FROM (" +
         CRITICAL + ") x WHERE severity = 'CRITICAL'")
ACTS = ("SELECT cast(c_custkey AS string) AS account_id, 1 AS pos, 'key' AS key, 'Label' AS label, CASE WHEN "
        "c_custkey % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, 'Email' AS target_field, 'detail' AS detail FROM "
        "{customer}")


def _recommend(docs, formed, texts, acts):
    problems = d.document_problems(docs.withColumn("issues", F.when(
        F.col("doc_pos") % 40 == 0, F.array(t.issue("BRANCH_MISMATCH", "office", "tin", "CRITICAL"),
                                            t.issue("EXPIRED", "old", None, "CRITICAL")))))
    return d.recommend(formed, texts, d.check_requirements(docs, formed), problems, acts)


_RECOMMEND = _REQ + """
    , rs AS (
        SELECT account_id, 0 AS lvl, 0 AS st, attribute_pos AS p, message AS m FROM texts
        UNION ALL SELECT account_id, CASE status WHEN 'EXPIRED' THEN 1 ELSE 0 END, 1, rule_pos,
            CASE status WHEN 'MISSING' THEN 'Required document missing: ' || document_type
            WHEN 'EXPIRED' THEN 'Required document expired: ' || document_type || ' (until ' || valid_until || ')'
            ELSE 'Validity of required document could not be determined: ' || document_type ||
                ' (check its expiry date)' END FROM reqs
        WHERE status IN ('MISSING', 'EXPIRED') OR (status = 'UNKNOWN' AND
            document_type IN ('MAYORS_PERMIT', 'DTI_BN_CERT'))
        UNION ALL SELECT account_id, 0, 2, doc_pos, file_name || ': BRANCH_MISMATCH - office' FROM docs
        WHERE doc_pos % 40 = 0
        UNION ALL SELECT account_id, 2, 3, 1, 'Activation check not met: Label - detail' FROM acts
        WHERE status = 'FAIL'),
    lead_ AS (SELECT account_id, min(lvl) AS l FROM rs GROUP BY account_id),
    recs AS (SELECT f.account_id, CASE WHEN l IN (0, 2) THEN 'MANUAL_REVIEW' WHEN l = 1 THEN 'INACTIVE' ELSE 'ACTIVE'
        END AS recommendation, coalesce((SELECT string_agg(m, '; ' ORDER BY lvl, st, p) FROM rs WHERE
            rs.account_id = f.account_id AND CASE WHEN l = 2 THEN lvl = 2 ELSE lvl < 2 END),
            'All required documents present and valid; documents agree.') AS reasons
        FROM formed f LEFT JOIN lead_ USING (account_id))"""
register("recommend", {"docs": DOCS, "formed": _FORMED, "texts": TEXTS, "acts": ACTS},
    lambda docs, formed, texts, acts: _recommend(docs, formed, texts, acts).select(
        "account_id", "recommendation", F.array_join("reasons", "; ").alias("reasons")),
    _RECOMMEND + " SELECT account_id, recommendation, reasons FROM recs")

# ---------------------------------------------------------------- F14-F16
PROBLEMS = ("SELECT cast(o_custkey AS string) AS account_id, cast(o_orderkey AS string) AS doc_id, o_orderkey AS "
            "doc_pos, concat('f', cast(o_orderkey AS string)) AS file_name, 'GIS' AS document_type, 0 AS "
            "issue_pos, 'BRANCH_MISMATCH' AS code, 'm' AS message FROM {orders} WHERE o_totalprice > 485000")
_BLOCK = """
    , bl AS (SELECT account_id, 0 AS st, attribute_pos AS p, 'documents disagree on ' || attribute AS problem
             FROM crit WHERE severity = 'CRITICAL'
        UNION ALL SELECT account_id, 1, doc_pos, file_name || ': BRANCH_MISMATCH' FROM problems)"""
register("blockers", {"crit": CRITICAL, "problems": PROBLEMS},
    lambda crit, problems: d.blocking_problems(crit, problems).select("account_id", "problem"),
    _BLOCK + " SELECT account_id, problem FROM bl")

_PLAN = _BLOCK + """
    , bp AS (SELECT account_id, string_agg(problem, '; ' ORDER BY st, p) AS b FROM bl GROUP BY account_id),
    nd(target_field, action, need) AS (VALUES ('Tax_Identification_Number_TIN', 'FILL', 1),
        ('Tax_Identification_Number_TIN', 'CORRECT', 2), ('Business_Style', 'FILL', 1),
        ('Owner_Name', 'FILL', 1), ('Owner_Name', 'CORRECT', 2), ('Invoice_Company_Name', 'FILL', 1),
        ('Invoice_Company_Name', 'CORRECT', 2)),
    pl AS (SELECT p.*, coalesce(confidence, 0) AS c, CASE
        WHEN need IS NULL THEN p.action || ' on ' || p.target_field || ' always goes to review'
        WHEN b IS NOT NULL THEN 'account has critical problems: ' || b
        WHEN needs_attention THEN 'proposal needs attention'
        WHEN coalesce(confidence, 0) < 0.95 THEN 'confidence ' || CASE WHEN confidence IS NULL THEN '0' ELSE
            cast(confidence AS string) END || ' below threshold 0.95'
        WHEN grounding <> 'EXACT' THEN 'value not confirmed by OCR (grounding ' || grounding || ')'
        WHEN agreeing_documents < need THEN p.action || ' needs ' || need || ' agreeing documents'
        WHEN proposed_value = '' THEN 'no value to write' END AS fail
        FROM props p LEFT JOIN nd USING (target_field, action) LEFT JOIN bp USING (account_id)
        WHERE p.action IN ('FILL', 'CORRECT')),
    plan AS (SELECT account_id, target_field, action, proposed_value AS new_value,
        CASE WHEN fail IS NULL THEN 'AUTO' ELSE 'REVIEW' END AS decision,
        coalesce(fail, 'confidence ' || cast(c AS string) || ', ' || grounding || ', ' ||
            agreeing_documents || ' document(s) agree') AS reason FROM pl)"""
register("plan", {"props": PROPOSALS, "crit": CRITICAL, "problems": PROBLEMS},
    lambda props, crit, problems: d.plan_updates(props, d.blocking_problems(crit, problems)).select(
        "account_id", "target_field", "action", "new_value", "decision", "reason"),
    _PLAN + " SELECT account_id, target_field, action, new_value, decision, reason FROM plan")

RECS = ("SELECT cast(c_custkey AS string) AS account_id, CASE WHEN c_custkey % 2 = 0 THEN 'SOLE_PROPRIETORSHIP' ELSE "
        "'CORPORATION' END AS business_form, CASE WHEN c_custkey % 7 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS "
        "recommendation FROM {customer}")
KNOWN = ("SELECT cast(c_custkey AS string) AS account_id, 'tin' AS attribute, CASE WHEN c_custkey % 3 = 0 THEN "
         "cast(0.5 AS double) ELSE cast(0.96 AS double) END AS confidence FROM {customer} WHERE c_acctbal > 0 "
         "UNION ALL SELECT cast(c_custkey AS string), CASE WHEN c_custkey % 2 = 0 THEN 'owner_name' ELSE "
         "'registered_name' END, cast(0.97 AS double) FROM {customer}")
SETTLED = ("SELECT cast(c_custkey AS string) AS account_id, 1 AS pos, CASE WHEN c_custkey % 6 = 0 THEN "
           "'Tax_Identification_Number_TIN' ELSE 'Email' END AS target_field, CASE WHEN c_custkey % 13 = 0 THEN "
           "'HOLD' ELSE 'MATCH' END AS action FROM {customer}")
STEPS = ("SELECT cast(c_custkey AS string) AS account_id, 'Email' AS target_field, CASE WHEN c_custkey % 4 = 0 THEN "
         "'AUTO' ELSE 'REVIEW' END AS decision, 'gate' AS reason FROM {customer} WHERE c_acctbal > 2000")
LATE = ("SELECT cast(c_custkey AS string) AS account_id, 1 AS pos, 'k' AS key, 'Label' AS label, CASE c_custkey % 10 "
        "WHEN 1 THEN 'FAIL' WHEN 2 THEN 'AFTER_UPDATE' WHEN 4 THEN 'AFTER_UPDATE' ELSE 'PASS' END AS status, 'Email' "
        "AS target_field, 'detail' AS detail FROM {customer}")
register("status_decision", {"recs": RECS, "accounts": ACCOUNTS, "settled": SETTLED, "known": KNOWN, "late": LATE,
                             "steps": STEPS},
    lambda recs, accounts, settled, known, late, steps: d.status_decision(
        recs, accounts, settled, known, late, steps).select(
        "account_id", "decision", "reason", "is_active"),
    """
    , x AS (SELECT r.account_id, recommendation AS rec, business_form, coalesce(Customer_Status = 'Active', false)
            AS act, s.action = 'HOLD' AS hold, s.target_field AS hf, k.confidence AS tc,
            l.status AS ls, st.decision AS sd, s.action = 'MATCH' AND s.target_field =
            'Tax_Identification_Number_TIN' AS tm
        FROM recs r JOIN accounts USING (account_id) JOIN settled s USING (account_id)
        LEFT JOIN known k ON k.account_id = r.account_id AND k.attribute = 'tin'
        JOIN late l ON l.account_id = r.account_id LEFT JOIN steps st ON st.account_id = r.account_id),
    y AS (SELECT *, CASE WHEN rec <> 'ACTIVE' AND act THEN 'Recommendation is ' || rec ||
            ' but the account is Active in CRM. Not deactivated automatically: a person must decide.'
        WHEN rec <> 'ACTIVE' THEN 'Recommendation is ' || rec || '; status is not changed automatically.'
        WHEN hold THEN 'Unresolved document conflicts on: ' || hf
        WHEN tc IS NULL THEN 'No tin found on the documents; a person must check.'
        WHEN tc < 0.95 AND NOT tm THEN 'tin not confirmed (confidence 0.5 < 0.95 and CRM has no matching value); '
            || 'a person must check.'
        WHEN ls = 'FAIL' THEN 'Label: detail'
        WHEN ls = 'AFTER_UPDATE' AND coalesce(sd, '') <> 'AUTO' THEN 'Label: detail; not updated automatically ('
            || CASE WHEN sd IS NULL THEN 'no proposal' ELSE 'gate' END || '), a person must approve it.' END AS why
        FROM x)
    SELECT account_id, CASE WHEN why IS NOT NULL THEN 'NO_CHANGE' WHEN act THEN 'ALREADY_ACTIVE' ELSE 'ACTIVATE' END
        AS decision, coalesce(why, CASE WHEN act THEN 'Documents complete and valid; account already Active.' ELSE
        'All required documents present, valid and consistent; owner and TIN confirmed; COD, Accounting contact, '
        || 'TIN, invoice name and billing address checked.' END) AS reason, act AS is_active FROM y
    """)
