"""Reviews, write-back, requests and measurement over orders, customer, events, documents."""

from pyspark.sql import functions as F

from attesta.operators import measure as me
from attesta.operators import requests as rq
from attesta.operators import reviews as rv
from attesta.operators.reading import classify_documents
from bindings import register
from bindings.facts import DOCS, FACTS, PROPOSALS, _FORMED, _REQ
from attesta.operators import decide as d

# ---------------------------------------------------------------- H1-H3
EVIDENCE = FACTS.replace("'field' AS source_field", "'attr' AS attr, 'field' AS source_field")
register("review_rows", {"props": PROPOSALS, "facts": EVIDENCE},
    lambda props, facts: rv.build_review_rows(props, rv.evidence_lines(
        facts.withColumn("attribute", F.lit("attr")))).select(
        "account_id", "row_pos", "target_field", "field_label", "proposed_value", "action",
        "ocr_check", "auto_applied", "decision", "evidence"),
    """
    , ev AS (SELECT account_id, string_agg(document_type || ' ' || file_name || ': ' || value || ' (' ||
             concat_ws(' ', grounding, cast(confidence AS varchar)) || ')', chr(10) ORDER BY rank, doc_pos, seq) AS e
             FROM facts GROUP BY account_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY CASE WHEN action IN ('FILL', 'CORRECT',
          'DIFFERS') THEN 0 ELSE 1 END, target_field) AS row_pos FROM props),
    x AS (SELECT *, concat_ws(chr(10), e, reason) AS txt FROM n LEFT JOIN ev USING (account_id))
    SELECT account_id, row_pos, target_field, CASE target_field WHEN 'Tax_Identification_Number_TIN' THEN 'TIN' ELSE
        replace(target_field, '_', ' ') END AS field_label, nullif(proposed_value, '') AS proposed_value, action,
        grounding AS ocr_check, 'No' AS auto_applied, CASE WHEN action <> 'MATCH' THEN 'Pending' END AS decision,
        txt AS evidence
    FROM x WHERE row_pos <= 25
    """)

register("review_status", {"formed": _FORMED, "docs": DOCS, "props": PROPOSALS},
    lambda formed, docs, props: rv.review_status(
        formed, props.withColumn("auto_apply_status", F.when(
            F.col("agreeing_documents") < 3, "APPLIED")), d.check_requirements(docs, formed)),
    _REQ + """
    , o AS (SELECT account_id, bool_or(action <> 'MATCH' AND agreeing_documents >= 3) AS o FROM props GROUP BY account_id),
    w AS (SELECT account_id, bool_or(status IN ('MISSING', 'EXPIRED')) AS w FROM reqs GROUP BY account_id),
    s AS (SELECT f.account_id, CASE WHEN o THEN 'Pending Review' WHEN w THEN 'Waiting for Documents' ELSE 'Applied' END
          AS review_status FROM formed f LEFT JOIN o USING (account_id) LEFT JOIN w USING (account_id))
    SELECT account_id, review_status, replace(review_status, 'Applied', 'No Action') AS stored_status FROM s""")

SUM_ALERTS = ("SELECT cast(o_custkey AS string) AS account_id, o_orderkey AS pos, 'WARNING' AS severity, "
              "'MISSING_DOCUMENT' AS code, 'BIR_2303' AS document_type, 'm' AS message, 'a' AS action FROM {orders} "
              "WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT cast(o_custkey AS string), o_orderkey, 'CRITICAL', "
              "'EXPIRED_DOCUMENT', 'MAYORS_PERMIT', 'Mayor expired on 2000-01-31 (5 days ago)', 'a' FROM {orders} WHERE "
              "o_orderpriority = '2-HIGH'")
SUM_RECS = ("SELECT cast(c_custkey AS string) AS account_id, 'MANUAL_REVIEW' AS recommendation, concat('Required document "
            "expired: DTI_BN_CERT (until 2000-0', cast(1 + c_custkey % 9 AS string), '-15)') AS r1, CASE WHEN c_custkey % 2 "
            "= 0 THEN 'Documents disagree on tin: 1 (BIR_2303) vs 2 (GIS)' ELSE 'Required document missing: SEC_CERT' END AS "
            "r2, 'Recommendation is MANUAL_REVIEW; status' AS reason, 'NO_CHANGE' AS decision FROM {customer}")
SUM_ACTS = ("SELECT cast(c_custkey AS string) AS account_id, 0 AS pos, 'payment_terms' AS key, 'L' AS label, CASE WHEN "
            "c_custkey % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, 'Payment Terms: empty' AS detail FROM {customer}")
register("review_summary", {"alerts": SUM_ALERTS, "recs": SUM_RECS, "acts": SUM_ACTS, "formed": _FORMED, "docs": DOCS,
                            "props": PROPOSALS},
    lambda alerts, recs, acts, formed, docs, props: rv.review_summary(
        recs.withColumn("reasons", F.array("r1", "r2")), alerts, d.check_requirements(docs, formed), acts, props,
        recs, docs.groupBy("account_id").agg(F.count("*").alias("n"))).select(
        "account_id", "recommendation_reasons", "alerts", "documents_found", "lowest_confidence"),
    """
    , a AS (SELECT account_id, string_agg(n || '. ' || t, chr(10) ORDER BY pos) AS alerts FROM (SELECT account_id, pos,
            row_number() OVER (PARTITION BY account_id ORDER BY pos) AS n, CASE severity WHEN 'WARNING' THEN
            'ATTENTION: BIR 2303 missing. Collect it from the customer.' ELSE
            'URGENT: Mayor''s permit expired on 31 Jan 2000 (5 days ago). Collect the renewed one.' END AS t FROM alerts)
            GROUP BY account_id),
    l AS (SELECT account_id, min(confidence) AS lowest FROM props WHERE action IN ('FILL', 'CORRECT') GROUP BY account_id),
    c AS (SELECT account_id, count(*) AS n FROM docs GROUP BY account_id)
    SELECT r.account_id, 'MANUAL REVIEW because:' || chr(10) || '- DTI certificate expired on 15 ' || CASE
        1 + cast(r.account_id AS int) % 9 WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5
        THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' ELSE 'Sep' END || ' 2000' || chr(10) || '- ' ||
        CASE WHEN cast(r.account_id AS int) % 2 = 0 THEN
            'TIN differs between documents: 1 (BIR 2303) vs 2 (General Information Sheet)'
            ELSE 'SEC certificate missing' END || chr(10) || chr(10) ||
        CASE status WHEN 'FAIL' THEN 'Activation checks: 0 of 1 met' || chr(10) || '  ✗ COD: Payment Terms: empty' ELSE
            'Activation checks: 1 of 1 met' || chr(10) || '  ✓ COD' END || chr(10) || chr(10) ||
        'Customer Status: not changed - a reviewer decides.' AS recommendation_reasons,
        alerts,
        coalesce(n, 0) AS documents_found, lowest AS lowest_confidence
    FROM recs r JOIN acts USING (account_id) LEFT JOIN a USING (account_id) LEFT JOIN l USING (account_id)
        LEFT JOIN c USING (account_id)
    """)

# ---------------------------------------------------------------- H4-H9
REVIEWS = ("SELECT cast(o_orderkey AS string) AS review_id, cast(o_custkey AS string) AS account_id, CASE o_orderstatus "
           "WHEN 'F' THEN 'Applied' WHEN 'O' THEN 'Pending Review' ELSE 'In Review' END AS status, o_orderdate AS "
           "created_at, CASE WHEN o_orderkey % 4 = 0 THEN 'Lia' END AS reviewer, cast(NULL AS string) AS reviewer_notes, "
           "cast(NULL AS timestamp) AS closed_at FROM {orders}")
ROWS = ("SELECT cast(l_orderkey AS string) AS review_id, cast(l_linenumber AS string) AS row_id, 'Pending' AS decision, "
        "cast(NULL AS string) AS edited_value, cast(NULL AS string) AS comment, CASE WHEN min(l_partkey) % 3 = 0 THEN "
        "'MATCH' ELSE 'FILL' END AS action, min(l_partkey) AS part FROM {lineitem} GROUP BY l_orderkey, l_linenumber")
DECISIONS = ("SELECT cast(l_orderkey AS string) AS review_id, cast(CASE WHEN l_suppkey % 11 = 0 THEN 99 ELSE l_linenumber "
             "END AS string) AS row_id, CASE l_partkey % 4 WHEN 0 THEN 'Approve' WHEN 1 THEN 'Edit' WHEN 2 THEN 'Reject' "
             "ELSE 'Maybe' END AS decision, CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE concat(' v', cast(l_partkey AS "
             "string)) END AS value, cast(l_suppkey AS string) AS comment, concat('r', cast(l_suppkey % 5 AS string)) AS "
             "reviewer, l_shipdate AS ts, l_partkey * 1000000 + cast(l_extendedprice AS bigint) AS decision_id "
             "FROM {lineitem}").replace("cast(l_extendedprice AS bigint)", "cast(floor(l_extendedprice) AS bigint)")
_FOLD = """
    , j AS (SELECT d.*, r.status, k.row_id IS NOT NULL AS known FROM decisions d LEFT JOIN reviews r USING (review_id)
            LEFT JOIN review_rows k ON k.review_id = d.review_id AND k.row_id = d.row_id),
    p AS (SELECT *, CASE WHEN status = 'Applied' THEN 'Review is Applied; it can no longer change' WHEN status IS NULL
        THEN 'Review not found' WHEN decision = 'Maybe' THEN 'Decision must be one of Pending, Approve, Edit, Reject'
        WHEN NOT known THEN 'Row ' || row_id || ' not found' WHEN decision = 'Edit' AND trim(value) = '' THEN
        'Edit needs the corrected value' END AS problem FROM j),
    g AS (SELECT * FROM p WHERE problem IS NULL)"""
_FOLDED = {"reviews": REVIEWS, "review_rows": ROWS, "decisions": DECISIONS}
register("fold_decisions", _FOLDED,
    lambda reviews, review_rows, decisions: rv.fold_decisions(reviews, review_rows, decisions)[1].select(
        "review_id", "row_id", "decision", "edited_value", "comment"),
    _FOLD + """
    , l AS (SELECT *, row_number() OVER (PARTITION BY review_id, row_id ORDER BY ts DESC, decision_id DESC) AS rn FROM g)
    SELECT r.review_id, r.row_id, coalesce(l.decision, r.decision) AS decision, CASE WHEN l.decision = 'Edit' THEN
        trim(l.value) END AS edited_value, l.comment FROM review_rows r LEFT JOIN (SELECT * FROM l WHERE rn = 1) l
        ON l.review_id = r.review_id AND l.row_id = r.row_id""")
register("fold_reviews", _FOLDED,
    lambda reviews, review_rows, decisions: rv.fold_decisions(reviews, review_rows, decisions)[0].select(
        "review_id", "status", "reviewer"),
    _FOLD + """
    , f AS (SELECT review_id, arg_min(reviewer, (ts, decision_id)) AS who FROM g GROUP BY review_id)
    SELECT review_id, CASE WHEN who IS NOT NULL AND status = 'Pending Review' THEN 'In Review' ELSE status END AS status,
        coalesce(reviewer, who) AS reviewer FROM reviews LEFT JOIN f USING (review_id)""")
register("fold_rejects", _FOLDED,
    lambda reviews, review_rows, decisions: rv.fold_decisions(reviews, review_rows, decisions)[2].select(
        "decision_id", "problem"),
    _FOLD + " SELECT decision_id, problem FROM p WHERE problem IS NOT NULL")

CLOSINGS = ("SELECT cast(o_orderkey AS string) AS review_id, CASE o_orderkey % 3 WHEN 0 THEN 'Rejected' WHEN 1 THEN "
            "'Approved' ELSE 'Waiting for Documents' END AS status, 'Max' AS reviewer, CASE WHEN o_orderkey % 5 > 1 THEN "
            "'note' ELSE ' ' END AS notes, o_orderkey % 2 = 0 AS values_compared, o_orderdate AS ts FROM {orders} UNION ALL "
            "SELECT cast(o_orderkey AS string), 'Rejected', 'Zoe', 'late', true, o_orderdate + INTERVAL '1' DAY FROM "
            "{orders} WHERE o_totalprice > 420000")
register("close_reviews", {"reviews": REVIEWS, "closings": CLOSINGS},
    lambda reviews, closings: rv.close_reviews(reviews, closings)[0].select(
        "review_id", "status", "reviewer", "reviewer_notes"),
    """
    , ok AS (SELECT c.* FROM closings c JOIN reviews r USING (review_id) WHERE r.status <> 'Applied' AND CASE c.status
        WHEN 'Approved' THEN values_compared ELSE trim(notes) <> '' END),
    w AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ts) AS rn FROM ok)
    SELECT r.review_id, coalesce(w.status, r.status) AS status, coalesce(w.reviewer, r.reviewer) AS reviewer,
        trim(w.notes) AS reviewer_notes FROM reviews r LEFT JOIN (SELECT * FROM w WHERE rn = 1) w USING (review_id)
    """)

register("list_reviews", {"reviews": REVIEWS},
    lambda reviews: rv.list_reviews(reviews, "open", limit=50, offset=10).select("review_id", "status"),
    """SELECT review_id, status FROM reviews WHERE status <> 'Applied' ORDER BY created_at DESC, review_id DESC
       LIMIT 50 OFFSET 10""")
register("review_counts", {"reviews": REVIEWS, "review_rows": ROWS},
    lambda reviews, review_rows: rv.review_counts(reviews, review_rows, review_rows.select(
        "review_id", F.when(F.col("part") % 2 == 0, "PASS").otherwise("FAIL").alias("status"))).select(
        "review_id", "checks_met", "rows_to_decide"),
    """SELECT review_id, max(m) AS checks_met, coalesce(max(t), 0) AS rows_to_decide FROM reviews LEFT JOIN (SELECT
        review_id, count(*) FILTER (part % 2 = 0) || '/' || count(*) AS m, count(*) FILTER (action = 'FILL') AS t
        FROM review_rows GROUP BY review_id) USING (review_id) GROUP BY review_id""")
register("number_reviews", {"fresh": "SELECT cast(o_orderkey AS string) AS job_id, o_orderdate AS created_at FROM {orders}",
                            "held": "SELECT cast(c_custkey AS string) AS job_id, c_custkey + 100 AS number FROM {customer}"},
    lambda fresh, held: rv.number_reviews(fresh, held).select("job_id", "number"),
    """SELECT job_id, (SELECT max(number) FROM held) + row_number() OVER (ORDER BY created_at, job_id) AS number
       FROM fresh WHERE job_id NOT IN (SELECT job_id FROM held)""")

# ---------------------------------------------------------------- H10-H12
NOW = ("SELECT cast(c_custkey AS string) AS account_id, c_name AS Account_Name, CASE WHEN c_custkey % 7 = 0 THEN 'changed "
       "meanwhile' ELSE upper(c_mktsegment) END AS Business_Style, cast(NULL AS string) AS Email FROM {customer}")
PLANNED = ("SELECT cast(o_custkey AS string) AS account_id, o_orderkey AS row_pos, CASE o_orderkey % 4 WHEN 0 THEN "
           "'Account_Name' WHEN 1 THEN 'Business_Style' WHEN 2 THEN 'Email' ELSE 'Business_Permit' END AS target_field, "
           "CASE o_orderkey % 3 WHEN 0 THEN 'Approve' WHEN 1 THEN 'Edit' ELSE 'Reject' END AS decision, CASE o_orderkey % 4 "
           "WHEN 0 THEN c_name WHEN 1 THEN concat(' ', lower(c_mktsegment)) END AS current_value, concat('p', "
           "cast(o_orderkey AS string)) AS proposed_value, CASE WHEN o_orderkey % 5 > 0 THEN concat('e', cast(o_orderkey AS "
           "string)) END AS edited_value FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
_OUT = """
    , o AS (SELECT p.*, CASE decision WHEN 'Edit' THEN edited_value ELSE proposed_value END AS value,
        CASE p.target_field WHEN 'Account_Name' THEN Account_Name WHEN 'Business_Style' THEN Business_Style END AS now_value
        FROM planned p JOIN cur USING (account_id)),
    outc AS (SELECT *, CASE WHEN decision = 'Reject' THEN 'NOT_APPROVED' WHEN target_field = 'Business_Permit' THEN
        'UNSUPPORTED' WHEN value IS NULL THEN 'NO_VALUE' WHEN upper(trim(coalesce(now_value, ''))) <>
        upper(trim(coalesce(current_value, ''))) THEN 'CONFLICT' ELSE 'APPLIED' END AS outcome FROM o)"""
register("apply_rows", {"cur": NOW, "planned": PLANNED},
    lambda cur, planned: rv.apply_rows(planned, cur).select(
        "account_id", "row_pos", "value", "outcome", "detail"),
    _OUT + """ SELECT account_id, row_pos, value, outcome, CASE outcome WHEN 'NOT_APPROVED' THEN
        'Decision Reject: not written' WHEN 'UNSUPPORTED' THEN 'Business_Permit is not written automatically' WHEN
        'NO_VALUE' THEN 'Approved but Proposed Value is empty' WHEN 'CONFLICT' THEN 'Account now has ''' || now_value ||
        ''', review expected ''' || current_value || '''' ELSE 'Written to the Account' END AS detail FROM outc""")
register("next_accounts", {"cur": NOW, "planned": PLANNED},
    lambda cur, planned: rv.next_accounts(cur, rv.apply_rows(planned, cur)),
    _OUT + """
    , n AS (SELECT account_id, arg_max(value, row_pos) FILTER (target_field = 'Account_Name') AS a,
        arg_max(value, row_pos) FILTER (target_field = 'Business_Style') AS b,
        arg_max(value, row_pos) FILTER (target_field = 'Email') AS e FROM outc WHERE outcome = 'APPLIED' GROUP BY account_id)
    SELECT account_id, coalesce(a, Account_Name) AS Account_Name, coalesce(b, Business_Style) AS Business_Style,
        coalesce(e, Email) AS Email FROM cur LEFT JOIN n USING (account_id)""")
register("record_updates", {"cur": NOW, "planned": PLANNED},
    lambda cur, planned: rv.record_updates(rv.apply_rows(planned, cur).withColumns({
        "job_id": F.col("account_id"), "created_at": F.lit("x")})).select(
        "account_id", "target_field", "action", "old_value", "new_value", "status"),
    _OUT + """ SELECT account_id, target_field, 'REVIEW_' || upper(decision) AS action, current_value AS old_value,
        value AS new_value, CASE outcome WHEN 'CONFLICT' THEN 'SKIPPED_CHANGED' ELSE outcome END AS status
    FROM outc WHERE outcome IN ('APPLIED', 'CONFLICT')""")
AUTO = ("SELECT account_id, row_pos AS pos, target_field, 'FILL' AS action, current_value, proposed_value AS new_value, "
        "cast(NULL AS double) AS confidence, 'EXACT' AS grounding, CASE decision WHEN 'Reject' THEN 'REVIEW' ELSE 'AUTO' END "
        "AS decision, 'why' AS reason FROM (" + PLANNED + ") x WHERE target_field <> 'Business_Permit'")
register("auto_updates", {"cur": NOW, "items": AUTO},
    lambda cur, items: rv.apply_auto_updates(items, cur, "on").select(
        "account_id", "target_field", "new_value", "status", "detail"),
    """
    , o AS (SELECT i.*, CASE target_field WHEN 'Account_Name' THEN Account_Name WHEN 'Business_Style' THEN Business_Style
            END AS now_value FROM items i JOIN cur USING (account_id) WHERE decision = 'AUTO'),
    s AS (SELECT *, upper(trim(coalesce(now_value, ''))) = upper(trim(coalesce(current_value, ''))) AS same FROM o)
    SELECT account_id, target_field, new_value, CASE WHEN same THEN 'APPLIED' ELSE 'SKIPPED_CHANGED' END AS status,
        CASE WHEN same THEN 'why' ELSE 'Changed in the account since the job started (now ''' || now_value ||
        '''); left for review' END AS detail FROM s""")
register("activate_reviewed", {"reviews": "SELECT cast(o_orderkey AS string) AS review_id, o_orderkey % 2 = 0 AS "
                               "activate_account FROM {orders}",
                               "written": "SELECT cast(l_orderkey AS string) AS review_id, CASE l_linenumber WHEN 1 THEN "
                               "'FAILED' WHEN 2 THEN 'CONFLICT' ELSE 'APPLIED' END AS outcome FROM {lineitem}"},
    lambda reviews, written: rv.activate_reviewed(reviews, written).drop("note"),
    """SELECT review_id, activate_account, CASE WHEN f THEN 'Failed' WHEN c THEN 'Conflict' ELSE 'Applied' END AS
        write_status, CASE WHEN activate_account THEN NOT coalesce(f, false) END AS activated FROM reviews LEFT JOIN
        (SELECT review_id, bool_or(outcome = 'FAILED') AS f, bool_or(outcome = 'CONFLICT') AS c FROM written
         GROUP BY review_id) USING (review_id)""")

_LOGGED = {"reviews": "SELECT cast(o_orderkey AS string) AS review_id, o_orderkey AS number, cast(o_custkey AS string) AS "
           "account_id, '' AS account_name, CASE o_orderkey % 5 WHEN 0 THEN 'Applied' WHEN 1 THEN 'Conflict' WHEN 2 THEN "
           "'Failed' WHEN 3 THEN 'Rejected' ELSE 'In Review' END AS status, 'Lia' AS reviewer, 'bad' AS reviewer_notes, "
           "o_orderkey % 10 = 0 AS activated, o_orderdate AS closed_at FROM {orders}",
           "lines": "SELECT cast(l_orderkey AS string) AS review_id, l_partkey * 1000 + l_suppkey AS row_pos, 'Email' AS "
           "target_field, '' AS current_value, cast(l_partkey AS string) AS proposed_value, 'ed' AS edited_value, CASE "
           "l_partkey % 3 WHEN 0 THEN 'Approve' WHEN 1 THEN 'Edit' ELSE 'Reject' END AS decision, CASE l_partkey % 4 WHEN 0 "
           "THEN 'CONFLICT' ELSE 'APPLIED' END AS outcome, cast(NULL AS double) AS confidence FROM {lineitem}",
           "ledger": "SELECT 'review' AS kind, concat('engine:', cast(o_orderkey AS string), ':Applied') AS ref FROM {orders} "
           "WHERE o_totalprice > 450000"}
_CLOSED = """
    , cl AS (SELECT *, closed_at < TIMESTAMP '1999-01-01' - INTERVAL 3 DAY AS silent FROM reviews WHERE status <> 'In Review'
             AND NOT (status = 'Applied' AND review_id IN (SELECT split_part(ref, ':', 2) FROM ledger)))"""
def _review_log(i):
    from attesta.operators.alerts import review_log
    return lambda reviews, lines, ledger: review_log(reviews, lines, ledger, "1999-01-01 00:00:00")[i]


register("review_log", _LOGGED, _review_log(0),
    _CLOSED + """
    , n AS (SELECT review_id, count(*) FILTER (outcome = 'APPLIED') AS a, count(*) FILTER (outcome = 'CONFLICT') AS c,
            string_agg('Email', ', ') FILTER (outcome = 'APPLIED') AS l FROM lines WHERE decision <> 'Reject' GROUP BY 1)
    SELECT review_id, account_id, 'engine:' || review_id || ':' || status AS ref, CASE WHEN NOT silent THEN
        CASE status WHEN 'Rejected' THEN '🚫 DV-' || number || ' for ' || account_id || ': rejected by Lia. bad'
        WHEN 'Failed' THEN '❌ DV-' || number || ' for ' || account_id ||
            ': the write-back failed. See the review in the dashboard.'
        ELSE '👍 DV-' || number || ' approved by Lia for ' || account_id || ': ' || coalesce(a, 0) || ' field(s) updated' ||
            CASE WHEN l IS NOT NULL THEN ' (' || l || ')' ELSE '' END || CASE WHEN coalesce(c, 0) > 0 THEN '; ' || c ||
            ' not written (the Account had changed: Conflict)' ELSE '' END END ||
        CASE WHEN activated THEN chr(10) || 'Customer Status → Active (reviewer decision)' ELSE '' END END AS message
    FROM cl LEFT JOIN n USING (review_id)""")
register("review_log_rows", _LOGGED, lambda **f: _review_log(1)(**f).drop("confidence"),
    _CLOSED + """ SELECT review_id, 'DV-' || number AS dv_number, account_id AS account, account_id, 'Email' AS field,
        '' AS old_value, CASE decision WHEN 'Edit' THEN 'ed' ELSE proposed_value END AS new_value, 'Approved by Lia' AS how,
        CASE outcome WHEN 'APPLIED' THEN 'Applied' ELSE 'Conflict' END AS result
    FROM lines JOIN cl USING (review_id) WHERE decision <> 'Reject' AND NOT silent""")

# ---------------------------------------------------------------- I
RAW = ("SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE concat(' 10000', lpad(cast(o_orderkey AS string), 9, '0'), ' ') "
       "END AS account_id, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE cast(o_custkey AS string) END AS customer_number, "
       "o_orderpriority AS reason, CASE o_orderstatus WHEN 'P' THEN 'MAYBE' WHEN 'F' THEN 'YES' ELSE 'NO' END AS "
       "document_status, CASE o_orderkey % 4 WHEN 0 THEN '501' WHEN 1 THEN '3' WHEN 2 THEN 'x' END AS attachment_count, "
       "concat(cast(o_custkey AS string), '|a', cast(o_custkey AS string), '@b.ph') AS requested_by, "
       "concat(cast(cast(o_orderdate AS date) AS string), CASE WHEN o_orderkey % 2 = 0 THEN 'T10:00:00' ELSE "
       "'T10:00:00+00:00' END) AS requested_at, '' AS source FROM {orders}")
register("clean_requests", {"raw": RAW},
    lambda raw: rq.clean_requests(raw)[0].withColumn(
        "requested_at", F.date_format("requested_at", "yyyy-MM-dd HH:mm")).withColumn(
        "attachment_count", F.col("attachment_count").cast("long")),
    """SELECT trim(account_id) AS account_id, nullif(customer_number, '') AS customer_number, reason, document_status,
        cast(attachment_count AS bigint) AS attachment_count, split_part(requested_by, '|', 1) AS requested_by_id,
        split_part(requested_by, '|', 2) AS requested_by_email, substr(requested_at, 1, 10) ||
        CASE WHEN requested_at LIKE '%+00:00' THEN ' 10:00' ELSE ' 02:00' END AS requested_at, 'crm_button' AS source
    FROM raw WHERE account_id <> 'bad' AND document_status <> 'MAYBE' AND coalesce(attachment_count, '3') = '3'""")
register("rejected_requests", {"raw": RAW},
    lambda raw: rq.clean_requests(raw)[1].select("account_id", "requested_by", "problem"),
    """SELECT trim(account_id) AS account_id, requested_by, concat_ws('; ', CASE WHEN account_id = 'bad' THEN
        'account_id must be 10 to 25 digits' END, CASE WHEN document_status = 'MAYBE' THEN
        'document_status must be YES or NO' END, CASE WHEN attachment_count <> '3' THEN
        'attachment_count must be 0 to 500' END) AS problem FROM raw
    WHERE account_id = 'bad' OR document_status = 'MAYBE' OR attachment_count <> '3'""")
register("one_active_job", {"reqs": "SELECT cast(user_id AS string) AS account_id, event_id AS request_id, ts AS requested_at "
                            "FROM {events} WHERE event_type IN ('signup', 'purchase')",
                            "jobs": "SELECT cast(user_id AS string) AS account_id, concat('j', cast(event_id AS string)) AS "
                            "job_id, CASE event_type WHEN 'error' THEN 'READING' ELSE 'READ' END AS status FROM {events} "
                            "WHERE value > 90"},
    lambda reqs, jobs: rq.one_active_job(reqs, jobs).select("request_id", "job_id", "created"),
    """
    , a AS (SELECT account_id, min(job_id) AS act FROM jobs WHERE status = 'READING' GROUP BY account_id),
    f AS (SELECT *, first_value(request_id) OVER (PARTITION BY account_id ORDER BY requested_at, request_id) AS first_
          FROM reqs)
    SELECT request_id, coalesce(act, sha256(account_id || '|' || first_)) AS job_id,
        act IS NULL AND request_id = first_ AS created FROM f LEFT JOIN a USING (account_id)""")
register("flagged", {"accts": "SELECT CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE cast(c_custkey AS string) END AS account_id, "
                     "c_nationkey % 2 = 0 AS DV_Requested, c_name AS Inventory_Customer_Number, c_mktsegment AS "
                     "DV_Request_Reason, CASE c_custkey % 4 WHEN 0 THEN 'COD' WHEN 1 THEN 'cash on  delivery' ELSE 'CODE' END "
                     "AS Credit_Terms FROM {customer}"},
    lambda accts: rq.flagged_accounts(accts, cod_only=True).select(
        "account_id", "customer_number", "reason", "document_status", "source"),
    """SELECT account_id, Inventory_Customer_Number AS customer_number, DV_Request_Reason AS reason, 'YES' AS
       document_status, 'crm_button' AS source FROM accts WHERE DV_Requested AND account_id <> 'x'
       AND Credit_Terms <> 'CODE'""")
register("reconcile", {"reqs": "SELECT cast(c_custkey AS string) AS account_id, CASE WHEN c_custkey % 2 = 0 THEN 'YES' ELSE "
                       "'NO' END AS document_status, cast(c_custkey % 12 AS int) AS attachment_count, cast(c_custkey % 100 AS "
                       "string) AS customer_number FROM {customer}",
                       "refs": "SELECT cast(o_custkey AS string) AS account_id, CASE WHEN o_orderkey % 3 = 0 THEN 'FILE_FIELD' "
                       "ELSE 'ATTACHMENT' END AS source FROM {orders} WHERE o_orderstatus <> 'P'",
                       "accts": "SELECT cast(c_custkey AS string) AS account_id, cast(c_custkey AS string) AS "
                       "Inventory_Customer_Number FROM {customer}"},
    lambda reqs, refs, accts: rq.reconcile_reported(reqs, refs, accts).select(
        "account_id", "code", "found_total", "found_attachments"),
    """
    , c AS (SELECT r.*, coalesce(t, 0) AS found_total, coalesce(a, 0) AS found_attachments FROM reqs r LEFT JOIN (SELECT
            account_id, count(*) AS t, count(*) FILTER (source = 'ATTACHMENT') AS a FROM refs GROUP BY 1) USING (account_id))
    SELECT account_id, 'ATTACHMENT_COUNT_MISMATCH' AS code, found_total, found_attachments FROM c WHERE
        attachment_count NOT IN (found_total, found_attachments)
    UNION ALL SELECT account_id, 'DOCUMENT_STATUS_MISMATCH', found_total, found_attachments FROM c WHERE
        (document_status = 'NO') = (found_total > 0)
    UNION ALL SELECT account_id, 'CUSTOMER_NUMBER_MISMATCH', found_total, found_attachments FROM c WHERE
        customer_number <> account_id""")
register("collection_summary", {"jobs": "SELECT cast(c_custkey AS string) AS job_id FROM {customer}",
                                "docs": "SELECT cast(o_custkey AS string) AS job_id, CASE WHEN o_custkey % 7 = 0 THEN "
                                "'DOWNLOAD_FAILED' WHEN o_custkey % 11 = 0 THEN 'REJECTED' WHEN o_orderkey % 3 = 0 THEN "
                                "'DUPLICATE' ELSE 'STORED' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'FILE_FIELD' ELSE "
                                "'ATTACHMENT' END AS source FROM {orders}"},
    lambda jobs, docs: rq.collection_summary(jobs, docs),
    """SELECT job_id, count(*) FILTER (status = 'STORED') AS stored, count(*) FILTER (status = 'DUPLICATE') AS duplicate,
        count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (status = 'DOWNLOAD_FAILED') AS download_failed,
        count(*) FILTER (source = 'ATTACHMENT') AS attachment, count(*) FILTER (source = 'FILE_FIELD') AS file_field,
        cast(0 AS bigint) AS note_attachment, CASE WHEN count(*) FILTER (status = 'STORED') > 0 THEN 'COLLECTED' WHEN
        count(*) FILTER (status = 'DOWNLOAD_FAILED') > 0 THEN 'FAILED' ELSE 'NO_DOCUMENTS' END AS job_status
    FROM jobs LEFT JOIN docs USING (job_id) GROUP BY job_id""")

# ---------------------------------------------------------------- J
# gold: a document's quality label against a rule on its length
SCORES = {"gold": "SELECT doc_id, 'quality' AS field, cast(quality AS string) AS accepted_1, CASE WHEN toxic = 1 THEN '1' ELSE "
          "'7' END AS accepted_2 FROM {labels}",
          "flds": "SELECT doc_id, 'quality' AS name, 'code' AS kind, CASE WHEN n_chars % 10 = 0 THEN NULL WHEN n_chars > 1500 "
          "THEN '1' ELSE '0' END AS value, CASE WHEN n_chars % 3 = 0 THEN 'EXACT' WHEN n_chars % 3 = 1 THEN 'CONFLICT' ELSE "
          "'FUZZY' END AS grounding, CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS model FROM {documents}"}
_JUDGED = """
    , j AS (SELECT doc_id, value, grounding, model, CASE WHEN value IS NULL THEN 'MISSED' WHEN value IN (accepted_1,
            accepted_2) THEN 'CORRECT' ELSE 'WRONG' END AS result FROM gold JOIN flds USING (doc_id))"""


def _judged(gold, flds):
    return me.judge_fields(gold.withColumn("accepted", F.array("accepted_1", "accepted_2")), flds)


register("judge_fields", SCORES, lambda gold, flds: _judged(gold, flds),
    _JUDGED + " SELECT doc_id, 'quality' AS field, value, grounding, result FROM j")
_TOTALS = """count(*) AS fields_total, count(*) FILTER (result = 'CORRECT') AS correct,
    count(*) FILTER (result = 'WRONG') AS wrong, count(*) FILTER (result = 'MISSED') AS missed,
    count(*) FILTER (result = 'WRONG' AND grounding <> 'CONFLICT') AS wrong_but_looked_confirmed,
    round(count(*) FILTER (result = 'CORRECT') / count(*), 3) AS field_accuracy"""
_SHOWN = ["fields_total", "correct", "wrong", "missed", "wrong_but_looked_confirmed",
          "field_accuracy"]
register("score_extraction", SCORES,
    lambda gold, flds: me.score_extraction(_judged(gold, flds)).select(*_SHOWN),
    _JUDGED + f" SELECT {_TOTALS} FROM j")
register("compare_models", SCORES,
    lambda gold, flds: me.compare_models(
        _judged(gold, flds).join(flds.select("doc_id", "model"), "doc_id").withColumn("version", F.lit("v")),
        flds.select("model", F.lit("v").alias("version"), F.lit(10).alias("input_tokens"), F.lit(2).alias(
            "output_tokens"), F.lit(1).alias("calls"), F.lit(0.5).alias("seconds"))).select(
        "model", *_SHOWN, "documents", "input_tokens", "calls", "seconds"),
    _JUDGED + f""" SELECT *, documents * 10 AS input_tokens, documents AS calls, documents * 0.5::double AS seconds
    FROM (SELECT model, {_TOTALS} FROM j GROUP BY model) JOIN (SELECT model, count(*) AS documents FROM flds GROUP BY model)
        USING (model)""")

_RULES = [("SECRET", "TOKEN", 3.0), ("LICENSE", "LICENSE", 3.0)]
READ = {"docs": "SELECT doc_id, text, source FROM {documents}",
        "bench": "SELECT d.doc_id, b.text AS passage, CASE WHEN d.source = 'src0' THEN 'SECRET' ELSE 'OTHER' END AS "
        "expected_type FROM {documents} d JOIN {benchmark} b ON d.doc_id % 40 = b.item_id"}
_SQT = "regexp_replace(translate(upper({0}), 'Ñ', 'N'), '[^A-Z0-9]', '', 'g')"
_READ = f"""
    , x AS (SELECT doc_id, expected_type, CASE WHEN contains(s, 'TOKEN') THEN 'SECRET' WHEN contains(s, 'LICENSE') THEN
            'LICENSE' ELSE 'OTHER' END AS predicted_type, contains(s, {_SQT.format('passage')}) AS hit
            FROM (SELECT *, {_SQT.format('text')} AS s FROM docs) JOIN bench USING (doc_id))"""


def _read(docs, bench):
    texts = classify_documents(docs, _RULES, (), name=None).drop("type_confidence", "type_signals")
    return me.score_reading(bench.select("doc_id", "expected_type"), bench.select(
        "doc_id", F.lit("passage").alias("field"), F.array("passage").alias("accepted")), texts)


register("score_reading", READ,
    lambda docs, bench: _read(docs, bench).select(
        "doc_id", "expected_type", "predicted_type", "type_correct", "fields_found", "fields_total"),
    _READ + """ SELECT doc_id, expected_type, predicted_type, expected_type = predicted_type AS type_correct,
        cast(hit AS bigint) AS fields_found, cast(1 AS bigint) AS fields_total FROM x""")
register("reading_totals", READ, lambda docs, bench: me.reading_totals(_read(docs, bench)),
    _READ + """ SELECT count(*) AS documents, round(count(*) FILTER (expected_type = predicted_type) / count(*), 3) AS
        classification_accuracy, count(*) FILTER (hit) AS fields_found, count(*) AS fields_total,
        round(count(*) FILTER (hit) / count(*), 3) AS grounding_recall FROM x""")

register("mask", {"docs": "SELECT doc_id, text FROM {documents}"},
    lambda docs: me.mask_sensitive(docs, ["text"]).select("doc_id", F.sha2("text", 256).alias("masked")),
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text,
        '(\w+-oauthtoken\s+)\S+', '\1***', 'gi'),
        '((?:access_token|refresh_token|client_secret|api_key)["'']?\s*[:=]\s*["'']?)[^"''\s,&}]+', '\1***', 'gi'),
        '\b\d{3}[- ]?\d{3}[- ]?(?:\d{3}[- ]?\d{0,2})?(\d{3})\b', '***\1', 'g')) AS masked FROM docs""")
register("mask_ids", {"calls": "SELECT o_orderkey, concat('TIN ', lpad(cast(o_orderkey AS string), 9, '7'), CASE WHEN o_orderkey "
                      "% 2 = 0 THEN '-00123' ELSE '' END, ' api_key=k', cast(o_custkey AS string), ', done') AS line "
                      "FROM {orders}"},
    lambda calls: me.mask_sensitive(calls, ["line"]),
    """SELECT o_orderkey, 'TIN ***' || CASE WHEN o_orderkey % 2 = 0 THEN '123' ELSE
       right(lpad(cast(o_orderkey AS string), 9, '7'), 3) END || ' api_key=***, done' AS line FROM calls""")
