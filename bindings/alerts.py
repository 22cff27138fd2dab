"""Alerts, repeats, reminders and logs over events, orders and customer."""

import datetime

from pyspark.sql import functions as F

from attesta.operators import alerts as al
from bindings import TODAY, register
from bindings.facts import (
    _REQ,
    DOCS,
    _FORMED,
    EXTRACTED,
    PROBLEMS,
    PROPOSALS,
    STORED,
    TEXTS,
    _UNUSABLE,
)
from attesta.operators import decide as d

DAY = datetime.date.fromisoformat(TODAY)
_LABELS = """
    , lb(document_type, name, short) AS (VALUES ('BIR_2303', 'BIR Form 2303 (Certificate of Registration)',
        'BIR 2303'), ('DTI_BN_CERT', 'DTI Business Name Certificate', 'DTI certificate'),
        ('MAYORS_PERMIT', 'Mayor''s / Business Permit', 'Mayor''s permit'),
        ('SEC_CERT', 'SEC Certificate of Registration', 'SEC certificate'))"""


def _build(docs, formed, texts, problems, stored, extracted, props):
    return al.build_alerts(d.check_requirements(docs, formed), texts, problems,
                           d.unusable_documents(stored, extracted), props, DAY)


_FRAMES = {"docs": DOCS, "formed": _FORMED, "texts": TEXTS, "problems": PROBLEMS, "stored": STORED,
           "extracted": EXTRACTED, "props": PROPOSALS}
_ALERTS = _REQ + _LABELS + f"""
    , lft AS (SELECT *, date_diff('day', DATE '{TODAY}', cast(valid_until AS date)) AS days
              FROM reqs JOIN lb USING (document_type)),
    alerts AS (
        SELECT account_id, 1 AS st, rule_pos AS p, 'WARNING' AS severity, 'MISSING_DOCUMENT' AS code, document_type,
            'Missing required document: ' || name AS message, 'Collect the customer''s ' || name AS action
        FROM lft WHERE status = 'MISSING'
        UNION ALL SELECT account_id, 1, rule_pos, 'CRITICAL', 'EXPIRED_DOCUMENT', document_type, name ||
            ' expired on ' || valid_until || ' (' || (-days) || ' days ago)', 'Collect the renewed ' || name
        FROM lft WHERE status = 'EXPIRED'
        UNION ALL SELECT account_id, 1, rule_pos, 'WARNING', 'EXPIRING_SOON', document_type, name ||
            ' expires on ' || valid_until || ' (in ' || days || ' days)',
            'Remind the customer to renew the ' || name
        FROM lft WHERE status = 'VALID' AND days BETWEEN 0 AND 30
        UNION ALL SELECT account_id, 2, attribute_pos, 'CRITICAL', 'DOCUMENT_CONFLICT', NULL, message,
            'Check whether these documents belong to this customer' FROM texts
        UNION ALL SELECT account_id, 3, doc_pos, 'CRITICAL', code, document_type, file_name || ': ' || code,
            'Check the document' FROM problems
        UNION ALL SELECT account_id, 4, doc_pos + CASE list WHEN 'skipped' THEN 1000000000 ELSE 0 END, 'WARNING',
            'UNREADABLE_DOCUMENT', NULL, 'Could not read ' || file_name || ' (' || status || ')',
            'Ask for a clearer photo or a supported file type' FROM ({_UNUSABLE}) u
        UNION ALL SELECT account_id, 5, 0, 'INFO', 'FIELDS_NEED_REVIEW', NULL, 'Fields needing a person''s check: '
            || string_agg(target_field, ', ' ORDER BY pos, target_field), NULL FROM props
        WHERE action = 'DIFFERS' OR (action IN ('FILL', 'CORRECT') AND needs_attention) GROUP BY account_id)"""
_COLS = ["account_id", "severity", "code", "document_type", "message", "action"]
register("alerts", _FRAMES, lambda **f: _build(**f).select(*_COLS),
         _ALERTS + f" SELECT {', '.join(_COLS)} FROM alerts")

DECIDED = ("SELECT cast(c_custkey AS string) AS account_id, CASE c_custkey % 3 WHEN 0 THEN 'INACTIVE' ELSE 'ACTIVE' END "
           "AS recommendation, CASE c_custkey % 3 WHEN 2 THEN 'ACTIVATE' ELSE 'NO_CHANGE' END AS decision, 'why' AS "
           "reason, c_custkey % 2 = 0 AS is_active FROM {customer}")
register("active_alert", {"dec": DECIDED, "texts": TEXTS, "problems": PROBLEMS},
    lambda dec, texts, problems: al.alert_active_with_problems(
        _critical(texts, problems), dec).select("account_id", "code", "message"),
    """SELECT account_id, 'ACTIVE_WITH_PROBLEMS' AS code, 'why' AS message FROM dec
       WHERE recommendation = 'INACTIVE' AND is_active
    UNION ALL SELECT account_id, 'DOCUMENT_CONFLICT', message FROM texts
    UNION ALL SELECT account_id, code, file_name || ': ' || code FROM problems""")


def _critical(texts, problems):
    pos = F.struct(F.lit(2).alias("stage"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    none = F.lit(None).cast("string")
    return texts.select("account_id", pos.alias("pos"), F.lit("CRITICAL").alias("severity"),
                        F.lit("DOCUMENT_CONFLICT").alias("code"), none.alias("document_type"),
                        "message", none.alias("action")).unionByName(problems.select(
        "account_id", pos.alias("pos"), F.lit("CRITICAL").alias("severity"), "code",
        "document_type", F.concat("file_name", F.lit(": "), "code").alias("message"),
        none.alias("action")))


# an event is an alert of its user; errors are critical, purchases warnings
EVENT_ALERTS = ("SELECT cast(user_id AS string) AS account_id, event_id AS pos, CASE event_type WHEN 'error' THEN "
                "'CRITICAL' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity, event_type AS code, CASE WHEN "
                "event_id % 3 > 0 THEN cast(event_id % 3 AS string) END AS document_type, event_type AS message, "
                "concat('do ', cast(event_id AS string)) AS action FROM {events}")
register("signature", {"alerts": EVENT_ALERTS}, lambda alerts: al.alert_signature(alerts),
    """SELECT account_id, string_agg(code || ':' || coalesce(document_type, 'None'), '|' ORDER BY code || ':' ||
       coalesce(document_type, 'None')) AS signature FROM alerts WHERE severity IN ('CRITICAL', 'WARNING')
       GROUP BY account_id""")

RUNS = ("SELECT cast(user_id AS string) AS account_id, cast(event_id - event_id % 2 AS string) AS job_id, "
        "CASE WHEN event_id % 4 < 2 THEN 'a' ELSE 'b' END AS signature, ts AS created_at, CASE event_type WHEN 'error' "
        "THEN 'CREATED' WHEN 'click' THEN 'SHADOW' ELSE 'SKIPPED' END AS task_status, event_id FROM {events}")
register("suppress", {"runs": RUNS},
    lambda runs: al.suppress_repeats(runs.drop("task_status"), runs, 1).select("event_id", "repeat"),
    """SELECT event_id, EXISTS (SELECT 1 FROM runs h WHERE h.account_id = r.account_id AND h.signature = r.signature
        AND h.job_id <> r.job_id AND h.task_status IN ('CREATED', 'SHADOW') AND h.created_at <= r.created_at
        AND h.created_at >= r.created_at - INTERVAL 1 DAY) AS "repeat" FROM runs r""")

register("note", {"alerts": EVENT_ALERTS, "decided": "SELECT DISTINCT cast(user_id AS string) AS account_id, 'ACTIVE' AS "
                  "recommendation, 'ACTIVATE' AS decision, 'fine' AS reason FROM {events}",
                  "reqs": "SELECT DISTINCT cast(user_id AS string) AS account_id, 0 AS rule_pos, 'GIS' AS "
                  "document_type, 'VALID' AS status FROM {events} WHERE event_type = 'signup' AND value > 50",
                  "applied": "SELECT DISTINCT cast(user_id AS string) AS account_id, 1 AS pos, 'Email' AS target_field, "
                  "'SHADOW' AS status FROM {events} WHERE event_type = 'purchase' AND value > 60"},
    lambda alerts, decided, reqs, applied: al.render_note(
        alerts, decided, decided, reqs, applied, DAY),
    f"""
    , i AS (SELECT account_id, string_agg('- [' || severity || '] ' || message || ' -> ' || action, chr(10) ORDER BY
            pos) AS txt, max(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS w FROM alerts
            GROUP BY account_id)
    SELECT account_id, 'Document verification: ACTIVE' || CASE w WHEN 2 THEN ' - CRITICAL' WHEN 1 THEN ' - WARNING'
        ELSE '' END AS title,
        concat_ws(chr(10), 'Recommendation: ACTIVE (checked {TODAY}, rules rules-1.2)', 'Status: ACTIVATE - fine', '',
            'Issues:' || chr(10) || txt || chr(10), CASE WHEN a.account_id IS NOT NULL THEN
            'Updated automatically: Email (SHADOW)' END, 'Required documents: ' || CASE WHEN r.account_id IS NOT NULL
            THEN 'GIS VALID' ELSE '' END) AS content
    FROM decided LEFT JOIN i USING (account_id) LEFT JOIN reqs r USING (account_id)
        LEFT JOIN applied a USING (account_id)
    """)

register("tasks", {"alerts": EVENT_ALERTS, "accounts": "SELECT DISTINCT cast(user_id AS string) AS account_id FROM "
                   "{events}"},
    lambda alerts, accounts: al.task_rows(alerts, accounts, DAY).select(
        "account_id", "subject", F.col("due_date").cast("string").alias("due_date")),
    """SELECT account_id, 'Documents: ' || CASE WHEN count(*) = 1 THEN arg_min(action, pos) ELSE count(*) ||
       ' issues to resolve' END AS subject, '2000-07-03' AS due_date FROM alerts
       WHERE severity IN ('CRITICAL', 'WARNING') GROUP BY account_id""")

NOTICES = ("SELECT event_type AS kind, cast(user_id AS string) AS ref, event_id, ts AS created_at FROM {events}")
register("once_only", {"notices": NOTICES, "ledger": "SELECT 'expiry' AS kind, 'x' AS ref FROM {nation} UNION ALL SELECT "
                       "'error', cast(n_nationkey AS string) FROM {nation}"},
    lambda notices, ledger: al.once_only(notices, ledger, ["created_at", "event_id"]).select(
        "kind", "ref", "event_id"),
    """
    , f AS (SELECT *, row_number() OVER (PARTITION BY kind, ref ORDER BY created_at, event_id) AS rn FROM notices n
            WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.kind = n.kind AND l.ref = n.ref))
    SELECT kind, ref, event_id FROM f WHERE rn = 1
    """)

ASSESSED = ("SELECT cast(o_custkey AS string) AS account_id, o_orderkey, o_orderdate AS created_at, o_orderpriority AS "
            "document_type, CASE o_orderstatus WHEN 'F' THEN 'MISSING' WHEN 'O' THEN 'EXPIRED' ELSE 'VALID' END AS "
            "status, cast(cast(o_orderdate AS date) + cast(o_orderkey % 900 AS int) AS string) AS valid_until "
            "FROM {orders}")
_LATEST = """
    , mx AS (SELECT account_id, max(created_at) AS created_at FROM assessed GROUP BY account_id),
    latest AS (SELECT a.* FROM assessed a JOIN mx USING (account_id, created_at))"""
register("latest", {"assessed": ASSESSED},
    lambda assessed: al.latest_per_account(assessed).select("account_id", "o_orderkey"),
    _LATEST + " SELECT account_id, o_orderkey FROM latest")

LEDGER = ("SELECT 'expiry' AS kind, concat_ws('|', cast(o_custkey AS string), o_orderpriority, "
          "cast(cast(o_orderdate AS date) + cast(o_orderkey % 900 AS int) AS string), CASE WHEN o_orderkey % 2 = 0 THEN "
          "'expired' ELSE '30 days' END) AS ref FROM {orders} WHERE o_orderstatus = 'F' UNION ALL SELECT 'renewed', "
          "concat_ws('|', cast(o_custkey AS string), o_orderpriority, cast(cast(o_orderdate AS date) + cast(o_orderkey % "
          "900 AS int) AS string)) FROM {orders} WHERE o_totalprice > 420000")
_DUE = _LATEST + f"""
    , dd AS (SELECT *, date_diff('day', DATE '{TODAY}', cast(valid_until AS date)) AS days_left FROM latest
             WHERE status <> 'MISSING'),
    lv AS (SELECT *, CASE WHEN days_left < 0 THEN 'expired' WHEN days_left = 0 THEN 'today' WHEN days_left <= 7 THEN
           '7 days' WHEN days_left <= 300 THEN '300 days' END AS level FROM dd),
    due AS (SELECT * FROM lv WHERE level IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.kind = 'expiry'
        AND l.ref = concat_ws('|', account_id, document_type, valid_until, level)))"""


def _due(assessed, ledger):
    return al.expiry_reminders(al.latest_per_account(assessed), ledger, DAY, [0, 7, 300])


register("expiry", {"assessed": ASSESSED, "ledger": LEDGER},
    lambda assessed, ledger: al.reminder_text(_due(assessed, ledger).withColumn(
        "number", F.lit("")), "account_id", "number").select(
        "account_id", "o_orderkey", "days_left", "level", "message"),
    _DUE + """ SELECT account_id, o_orderkey, days_left, level, '⚠️ ' || replace(document_type, '_', ' ') || ' of '
        || account_id || ' ' || CASE level WHEN 'expired' THEN 'expired on ' || dt || ' (' || (-days_left) ||
        ' days ago)' WHEN 'today' THEN 'expires today (' || dt || ')' ELSE 'expires on ' || dt || ' (in ' ||
        days_left || ' days)' END || '. Please collect the renewed ' || document_type ||
        ' and attach it to the Account.' AS message
    FROM (SELECT *, strftime(cast(valid_until AS date), '%-d %b %Y') AS dt FROM due)""")

UPLOADS = ("SELECT cast(o_custkey AS string) AS account_id, max(o_orderdate) + INTERVAL '5' DAY AS Created_Time FROM "
           "{orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey")
register("recheck", {"assessed": ASSESSED, "ledger": LEDGER, "uploads": UPLOADS},
    lambda assessed, ledger, uploads: _recheck(assessed, ledger, uploads),
    _DUE + """
    , fresh AS (SELECT DISTINCT l.account_id FROM latest l JOIN uploads u ON u.account_id = l.account_id
                AND u.Created_Time > l.created_at)
    SELECT DISTINCT account_id, 'verify' AS what, 0 AS n FROM due WHERE account_id IN (SELECT account_id FROM fresh)
    UNION ALL SELECT account_id, 'remind', o_orderkey FROM due WHERE account_id NOT IN (SELECT account_id FROM fresh)""")


def _recheck(assessed, ledger, uploads):
    again, remind = al.recheck_before_reminder(_due(assessed, ledger), uploads,
                                               al.latest_per_account(assessed))
    return again.select("account_id", F.lit("verify").alias("what"), F.lit(0).cast("long")
                        .alias("n")).unionByName(remind.select(
        "account_id", F.lit("remind").alias("what"), F.col("o_orderkey").alias("n")))


register("renewals", {"assessed": ASSESSED, "ledger": LEDGER},
    lambda assessed, ledger: al.renewals(assessed, ledger).select(
        "account_id", "o_orderkey", "valid_until"),
    """
    , old AS (SELECT split_part(ref, '|', 1) AS account_id, split_part(ref, '|', 2) AS document_type,
              split_part(ref, '|', 3) AS u FROM ledger WHERE kind = 'expiry')
    SELECT account_id, o_orderkey, valid_until FROM assessed a WHERE status = 'VALID' AND EXISTS (SELECT 1 FROM old o
        WHERE o.account_id = a.account_id AND o.document_type = a.document_type AND o.u < a.valid_until)
        AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.kind = 'renewed' AND
            l.ref = concat_ws('|', a.account_id, a.document_type, a.valid_until))
    """)

UPDATES = ("SELECT cast(c_custkey AS string) AS account_id, 1 AS pos, 'Email' AS target_field, CASE WHEN c_custkey % 2 = "
           "0 THEN 'APPLIED' ELSE 'SHADOW' END AS status FROM {customer} UNION ALL SELECT cast(c_custkey AS string), 9, "
           "'Customer_Status', 'APPLIED' FROM {customer} WHERE c_acctbal > 7000")
ACTS = ("SELECT cast(c_custkey AS string) AS account_id, 0 AS pos, 'payment_terms' AS key, 'L' AS label, CASE WHEN "
        "c_custkey % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, 'd' AS detail FROM {customer} UNION ALL SELECT "
        "cast(c_custkey AS string), 1, 'tin', 'L', CASE WHEN c_custkey % 4 = 0 THEN 'AFTER_UPDATE' ELSE 'FAIL' END, 'd' "
        "FROM {customer}")
register("verification_log", {"formed": _FORMED, "docs": DOCS, "acts": ACTS, "updates": UPDATES,
                              "found": "SELECT cast(o_custkey AS string) AS account_id, count(*) AS n FROM {orders} "
                              "GROUP BY o_custkey"},
    lambda formed, docs, acts, updates, found: al.verification_log(
        formed, formed.withColumn("recommendation", F.lit("MANUAL_REVIEW")),
        d.check_requirements(docs, formed), acts, updates, found),
    _REQ + _LABELS + """
    , g AS (SELECT account_id, string_agg(short || ' ' || lower(status), ', ' ORDER BY rule_pos) AS gaps
            FROM reqs JOIN lb USING (document_type) WHERE status IN ('MISSING', 'EXPIRED') GROUP BY account_id)
    SELECT f.account_id, 'MANUAL REVIEW' AS recommendation, CASE WHEN c_custkey % 3 = 0 THEN '0/2' ELSE '1/2' END AS
        checks_met, concat_ws(', ', gaps, CASE WHEN c_custkey % 3 = 0 THEN 'COD' END, CASE WHEN c_custkey % 4 > 0 THEN
        'TIN' END) AS missing, CASE WHEN c_custkey % 2 = 0 THEN 'Email' ELSE '' END AS applied,
        CASE WHEN c_custkey % 2 = 1 THEN 'Email' ELSE '' END AS shadow, coalesce(n, 0) AS documents_found,
        CASE WHEN c_acctbal > 7000 THEN 'Active (automatic)' ELSE 'not changed' END AS customer_status
    FROM formed f LEFT JOIN g USING (account_id) LEFT JOIN found USING (account_id)""")
