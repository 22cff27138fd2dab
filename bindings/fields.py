"""Form cells, field values, grounding, validity over orders, lineitem, customer, benchmark."""

import datetime

from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t
from attesta.operators import cells as ce
from attesta.operators import fields as fi
from bindings import TODAY, register

DAY = datetime.date.fromisoformat(TODAY)

# ---------------------------------------------------------------- D1-D3
# a sheet row per order, a cell per line number; odd parts hold text
CELLS = ("SELECT 'book' AS workbook, cast(l_orderkey % 100 AS string) AS sheet, l_orderkey AS row, "
         "l_linenumber AS col, max(CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 2 = 1 THEN "
         "concat('Label ', cast(l_partkey % 7 AS string), ':') ELSE cast(l_partkey AS string) END) "
         "AS value, max(l_partkey % 2) = 1 AS is_text FROM {lineitem} GROUP BY l_orderkey, "
         "l_linenumber")
_PAIRS = """
    , filled AS (SELECT * FROM cells WHERE value IS NOT NULL AND value <> ''),
    isl AS (SELECT *, col - row_number() OVER (PARTITION BY sheet, "row" ORDER BY col) AS i FROM filled),
    run AS (SELECT sheet, "row", max(n) AS longest FROM (SELECT sheet, "row", i, count(*) AS n FROM isl
            GROUP BY ALL) GROUP BY ALL),
    pr AS (SELECT a.workbook, a.sheet, a."row", b.col, a.value AS label, b.value AS value
           FROM filled a JOIN filled b ON a.sheet = b.sheet AND a."row" = b."row" AND b.col = a.col + 1
           JOIN run ON run.sheet = a.sheet AND run."row" = a."row"
           WHERE a.is_text AND longest < 5)"""
register("form_pairs", {"cells": CELLS}, lambda cells: ce.label_value_pairs(cells),
    _PAIRS + """ SELECT workbook, sheet, "row", col, chr(cast(64 + col AS int)) || "row" AS cell, label,
    value FROM pr""")

register("form_sheets", {"cells": "SELECT concat('book', cast(doc_id AS string)) AS workbook, "
                         "'s' AS sheet, doc_id % 12 AS row, 1 AS col, text AS value, lang <> 'de' "
                         "AS is_text FROM {documents}"},
    lambda cells: ce.find_form_sheets(cells, "LICENSE"),
    """SELECT DISTINCT workbook FROM cells WHERE is_text AND "row" <= 6
       AND contains(upper(value), 'LICENSE')""")

LABELS = {"label 1": "phone", "label 3": "tin", "label 5": "company_name"}


def map_form(cells):
    fields, others = ce.map_labels(ce.label_value_pairs(
        cells.withColumn("workbook", F.col("sheet"))), LABELS)
    return fields.select("workbook", "name", "kind", "value", "evidence")


register("map_labels", {"cells": CELLS}, map_form,
    _PAIRS + """
    , k AS (SELECT *, CASE label WHEN 'Label 1:' THEN 'phone' WHEN 'Label 3:' THEN 'tin'
            WHEN 'Label 5:' THEN 'company_name' END AS name FROM pr),
    r AS (SELECT *, row_number() OVER (PARTITION BY sheet, name ORDER BY "row" DESC, col DESC) AS rn
          FROM k WHERE name IS NOT NULL)
    SELECT sheet AS workbook, name, CASE name WHEN 'phone' THEN 'code' WHEN 'tin' THEN 'tin' ELSE
        'name' END AS kind, value,
        label || ' (' || sheet || '!' || chr(cast(64 + col AS int)) || "row" || ')' AS evidence
    FROM r WHERE rn = 1
    """)
register("unmapped_labels", {"cells": CELLS},
    lambda cells: ce.map_labels(ce.label_value_pairs(cells), LABELS)[1],
    _PAIRS + """ SELECT workbook, label, value,
        sheet || '!' || chr(cast(64 + col AS int)) || "row" AS location FROM pr
        WHERE label NOT IN ('Label 1:', 'Label 3:', 'Label 5:')""")

# ---------------------------------------------------------------- D4
VALUES = ("SELECT 'name' AS kind, c_custkey AS id, concat(' ', c_name, ' & Co. ') AS value "
          "FROM {customer} UNION ALL SELECT 'tin', c_custkey, concat('TIN ', cast(c_custkey + "
          "100000000 AS string), CASE WHEN c_nationkey % 3 = 0 THEN '-012' WHEN c_nationkey % 3 = 1 "
          "THEN '' ELSE '7' END) FROM {customer} UNION ALL SELECT 'money', s_suppkey, concat('PHP ', "
          "cast(s_suppkey AS string), ',', '250.', cast(s_nationkey % 10 AS string)) FROM {supplier} "
          "UNION ALL SELECT 'code', s_suppkey, concat('No. ', cast(s_suppkey AS string), ' a') FROM "
          "{supplier} UNION ALL SELECT 'email', s_suppkey, concat(' Info@', s_name, '.Ph') FROM "
          "{supplier} UNION ALL SELECT 'date', o_orderkey, concat(cast(month(o_orderdate) AS string),"
          " '/', cast(day(o_orderdate) AS string), '/', cast(year(o_orderdate) AS string)) FROM "
          "{orders} UNION ALL SELECT 'date', o_orderkey, concat(cast(day(o_orderdate) AS string), "
          "CASE WHEN day(o_orderdate) = 1 THEN 'st' ELSE 'th' END, ' day of July ', "
          "cast(year(o_orderdate) AS string)) FROM {orders}")
register("normalize", {"vals": VALUES}, lambda vals: fi.normalize_fields(vals),
    """
    SELECT kind, id, value, CASE kind
        WHEN 'name' THEN trim(regexp_replace(regexp_replace(upper(value), '[^A-Z0-9&'' ]', ' ', 'g'),
                                             ' +', ' ', 'g'))
        WHEN 'tin' THEN (SELECT CASE WHEN length(d) IN (9, 12) THEN substr(d, 1, 3) || '-' ||
            substr(d, 4, 3) || '-' || substr(d, 7, 3) || '-' || lpad(substr(d, 10), 5, '0') END
            FROM (SELECT regexp_replace(value, '[^0-9]', '', 'g') AS d))
        WHEN 'money' THEN cast(cast(regexp_replace(value, '[^0-9.]', '', 'g') AS decimal(18, 2)) AS string)
        WHEN 'code' THEN upper(substr(value, 5))
        WHEN 'email' THEN lower(trim(value))
        ELSE CASE WHEN value LIKE '%July%' THEN strftime(make_date(
                cast(right(value, 4) AS int), 7, cast(regexp_extract(value, '^([0-9]+)', 1) AS int)),
                '%Y-%m-%d')
            ELSE strftime(make_date(cast(split_part(value, '/', 3) AS int),
                CASE WHEN cast(split_part(value, '/', 1) AS int) > 12 THEN
                    cast(split_part(value, '/', 2) AS int) ELSE
                    cast(split_part(value, '/', 1) AS int) END,
                CASE WHEN cast(split_part(value, '/', 1) AS int) > 12 THEN
                    cast(split_part(value, '/', 1) AS int) ELSE
                    cast(split_part(value, '/', 2) AS int) END), '%Y-%m-%d') END
        END AS normalized FROM vals
    """)

# ---------------------------------------------------------------- D5
# each document is asked for its own first line, a line that no text has, a number and a box
ASKED = ("SELECT cast(d.doc_id AS string) AS sha256, 'v1' AS version, 'own' AS name, 'text' AS kind, "
         "split_part(d.text, chr(10), 1) AS value, 1 AS page FROM {documents} d "
         "UNION ALL SELECT cast(d.doc_id AS string), 'v1', 'absent', 'text', concat('ZQXJ WVKZ QJXZ ', "
         "cast(d.doc_id AS string), ' KZQXJ VVKZQ'), 1 FROM {documents} d "
         "UNION ALL SELECT cast(d.doc_id AS string), 'v1', 'box', 'choice', 'X', 1 FROM {documents} d "
         "UNION ALL SELECT cast(d.doc_id AS string), 'v1', 'short', 'code', "
         "cast(d.doc_id % 1000 AS string), 2 FROM {documents} d")
TEXTS = ("SELECT cast(doc_id AS string) AS sha256, 'v1' AS version, 1 AS page_number, "
         "text AS grounding_text, CASE WHEN n_chars < 500 THEN 'POOR' ELSE 'GOOD' END AS "
         "quality_label FROM {documents}")
_ALNUM = "regexp_replace(upper(replace({0}, 'ñ', 'Ñ')), '[^A-Z0-9]', '', 'g')"
# upper case of a sharp s is two letters
_SQ = ("regexp_replace(translate(upper(replace({0}, 'ß', 'SS')), 'Ñ', 'N'), '[^A-Z0-9]', '', 'g')")


register("ground", {"asked": ASKED, "texts": TEXTS},
    lambda asked, texts: fi.ground_fields(asked, texts).select(
        "sha256", "name", "grounding", "score", "page_quality",
        F.sha2("ocr_match", 256).alias("match_hash")),
    f"""
    , j AS (SELECT *, {_SQ.format('value')} AS v, coalesce({_SQ.format('grounding_text')}, '') AS t FROM asked JOIN texts USING (sha256)),
    g AS (SELECT *, CASE WHEN value IS NULL OR trim(value, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN NULL
        WHEN kind = 'choice' THEN 'UNVERIFIABLE'
        WHEN v <> '' AND contains(t, v) THEN 'EXACT' ELSE 'NOT_FOUND' END AS grounding FROM j)
    SELECT sha256, name, grounding, cast(CASE WHEN grounding = 'EXACT' THEN 1 ELSE 0 END AS double) AS score,
        quality_label AS page_quality, CASE WHEN grounding = 'EXACT' THEN sha256(value) END AS match_hash
    FROM g
    """)

# one letter of each document's own first letters replaced, as a text and as a code: the window search
# must find it, as similar (FUZZY), or as contradicting the text (CONFLICT: codes, and other numbers)
FUZZY = ("SELECT cast(doc_id AS string) AS sha256, 'v1' AS version, k.kind AS name, k.kind, "
         "concat(substring(text, 1, 12), 'Q', substring(text, 14, 12)) AS value, 1 AS page "
         "FROM {documents} CROSS JOIN (SELECT 'text' AS kind UNION ALL SELECT 'code') k")
_NUMBERS = "regexp_replace(regexp_replace({0}, '([0-9]+)', ';\\1;', 'g'), '[A-Z]+', '', 'g')"
register("ground_fuzzy", {"asked": FUZZY, "texts": TEXTS},
    lambda asked, texts: fi.ground_fields(asked, texts).select(
        "sha256", "name", "grounding", "score", F.when(F.col("grounding") != "EXACT", F.col("ocr_match")).alias("ocr_match")),
    # the letters replaced are window o, of as many letters as the needle or, where no letter was replaced, one less
    f"""
    , j AS (SELECT sha256, name, kind, value, {_SQ.format('value')} AS v, coalesce({_SQ.format('grounding_text')}, '') AS t,
        {_SQ.format('substring(grounding_text, 1, 25)')} AS o FROM asked JOIN texts USING (sha256)),
    w AS (SELECT *, CASE WHEN length(v) >= 4 AND length(t) >= length(v) AND NOT contains(t, v) THEN
        2.0 * (length(v) - 1) / (length(v) + length(o)) END AS ratio, {_NUMBERS.format('v')} AS nv, {_NUMBERS.format('o')} AS no FROM j),
    g AS (SELECT *, CASE WHEN value IS NULL OR trim(value, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN NULL
        WHEN v <> '' AND contains(t, v) THEN 'EXACT' WHEN ratio IS NULL OR ratio < {rules.FUZZY_MIN_RATIO} THEN 'NOT_FOUND'
        WHEN kind = 'code' OR NOT (nv LIKE '%' || replace(no, ';;', ';%;') || '%' OR no LIKE '%' || replace(nv, ';;', ';%;') || '%')
        THEN 'CONFLICT' ELSE 'FUZZY' END AS grounding FROM w)
    SELECT sha256, name, grounding, cast(CASE WHEN grounding = 'EXACT' THEN 1 WHEN grounding IN ('FUZZY', 'CONFLICT')
        THEN round(ratio, 3) ELSE 0 END AS double) AS score, CASE WHEN grounding IN ('FUZZY', 'CONFLICT') THEN o END AS ocr_match
    FROM g
    """)

# ---------------------------------------------------------------- D6, D7
SCORED = ("SELECT cast(o_orderkey AS string) AS sha256, 'v1' AS version, 0 AS spec_pos, 'f' AS name, "
          "CASE o_orderkey % 4 WHEN 0 THEN 'tin' WHEN 1 THEN 'date' WHEN 2 THEN 'code' ELSE 'text' "
          "END AS kind, CASE WHEN o_orderkey % 11 > 0 THEN cast(o_custkey AS string) END AS value, "
          "CASE WHEN o_orderkey % 3 > 0 THEN cast(o_custkey AS string) END AS normalized, "
          "CASE o_orderkey % 5 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'FUZZY' WHEN 2 THEN 'CONFLICT' WHEN 3 "
          "THEN 'NOT_FOUND' ELSE 'UNVERIFIABLE' END AS grounding, "
          "CASE o_orderkey % 7 WHEN 0 THEN 'FAIR' WHEN 1 THEN 'POOR' WHEN 2 THEN 'UNREADABLE' WHEN 3 "
          "THEN 'odd' ELSE 'GOOD' END AS page_quality, "
          "CASE WHEN o_orderkey % 4 = 2 THEN '[0-9]{{3}}' END AS pattern, 'seen' AS ocr_match, "
          "o_orderkey % 2 = 0 AS required FROM {orders}")
register("confidence", {"scored": SCORED},
    lambda scored: fi.score_confidence(scored).select("sha256", "grounding", "confidence"),
    """
    , c(g, q, v) AS (VALUES ('EXACT', 'GOOD', 0.95), ('EXACT', 'FAIR', 0.85), ('EXACT', 'POOR', 0.71),
        ('EXACT', 'UNREADABLE', 0.57), ('FUZZY', 'GOOD', 0.8), ('FUZZY', 'FAIR', 0.72),
        ('FUZZY', 'POOR', 0.6), ('FUZZY', 'UNREADABLE', 0.48), ('NOT_FOUND', 'GOOD', 0.5),
        ('NOT_FOUND', 'FAIR', 0.45), ('NOT_FOUND', 'POOR', 0.38), ('NOT_FOUND', 'UNREADABLE', 0.3),
        ('CONFLICT', 'GOOD', 0.3), ('CONFLICT', 'FAIR', 0.27), ('CONFLICT', 'POOR', 0.22),
        ('CONFLICT', 'UNREADABLE', 0.18))
    SELECT sha256, grounding, cast(CASE WHEN value IS NULL THEN NULL
        WHEN kind IN ('tin', 'date') AND normalized IS NULL THEN 0.2
        WHEN pattern IS NOT NULL AND NOT regexp_full_match(value, '[0-9]{3}') THEN 0.2
        ELSE v END AS double) AS confidence
    FROM scored JOIN c ON q = CASE page_quality WHEN 'odd' THEN 'UNREADABLE' ELSE page_quality END
        AND g = CASE grounding WHEN 'UNVERIFIABLE' THEN 'NOT_FOUND' ELSE grounding END
    """)

register("field_issues", {"scored": SCORED},
    lambda scored: fi.field_issues(scored, ["sha256"]).drop("spec_pos"),
    """
    SELECT sha256, 'document' AS scope, 'MISSING_REQUIRED' AS code,
        'f not found on the document' AS message, 'f' AS field, 'WARNING' AS severity
    FROM scored WHERE value IS NULL AND required
    UNION ALL SELECT sha256, 'document', 'INVALID_' || upper(kind),
        'f ''' || value || ''' is not a valid ' || kind, 'f',
        CASE kind WHEN 'tin' THEN 'CRITICAL' ELSE 'WARNING' END FROM scored
    WHERE value IS NOT NULL AND normalized IS NULL AND kind IN ('tin', 'date')
    UNION ALL SELECT sha256, 'field', 'INVALID_FORMAT',
        '''' || value || ''' does not have the expected format', 'f', 'WARNING' FROM scored
    WHERE pattern IS NOT NULL AND NOT regexp_full_match(value, '[0-9]{3}')
    UNION ALL SELECT sha256, 'field', CASE grounding WHEN 'CONFLICT' THEN 'OCR_CONFLICT' WHEN
        'NOT_FOUND' THEN 'NOT_IN_OCR_TEXT' ELSE 'CHECKBOX_NOT_VERIFIED' END,
        CASE grounding WHEN 'CONFLICT' THEN 'OCR read ''seen'' near this value; check the image'
        WHEN 'NOT_FOUND' THEN 'Value could not be confirmed by OCR; check the image' ELSE
        'Checkbox: confirm which box is marked on the image' END, 'f',
        CASE grounding WHEN 'CONFLICT' THEN 'WARNING' ELSE 'INFO' END FROM scored
    WHERE value IS NOT NULL AND grounding IN ('CONFLICT', 'NOT_FOUND', 'UNVERIFIABLE')
    """)

# ---------------------------------------------------------------- D8, D9
_TYPES = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'BIR_2303' WHEN '2-HIGH' THEN 'DTI_BN_CERT' WHEN "
          "'3-MEDIUM' THEN 'MAYORS_PERMIT' WHEN '4-NOT SPECIFIED' THEN 'GOVERNMENT_ID' ELSE 'OTHER' "
          "END")
_START = "CASE WHEN o_orderkey % 6 > 0 THEN cast(cast(o_orderdate AS date) AS string) END"
_END = ("CASE WHEN o_orderkey % 5 > 0 THEN cast(cast(o_orderdate AS date) + cast(1700 + o_custkey % 300 "
        "AS int) AS string) END")
DATED = (f"SELECT cast(o_orderkey AS string) AS doc_id, {_TYPES} AS document_type, {_START} AS "
         f"valid_from, {_END} AS valid_to, {_START} AS date_issued, {_END} AS printed_until, "
         f"{_START} AS issue_date, {_END} AS expiry_date, CASE WHEN o_orderkey % 2 = 0 THEN 'BIR TIN ID' "
         "ELSE 'PASSPORT' END AS id_type, CASE WHEN o_orderkey % 9 > 0 THEN '1' END AS tin "
         "FROM {orders}")
_VALID = f"""
    , v AS (SELECT *, cast(valid_from AS date) AS s, cast(valid_to AS date) AS e,
            DATE '{TODAY}' AS today, document_type IN ('DTI_BN_CERT', 'MAYORS_PERMIT',
            'GOVERNMENT_ID') AS timed FROM dated),
    w9 AS (SELECT *, CASE WHEN document_type = 'BIR_2303' THEN CASE WHEN tin IS NULL THEN 'UNKNOWN' ELSE
            'VALID' END WHEN NOT timed THEN 'UNKNOWN' WHEN e IS NULL THEN 'NO_EXPIRY' WHEN e < today THEN
            'EXPIRED' WHEN s > today THEN 'NOT_YET_VALID' ELSE 'VALID' END AS validity_status,
        CASE WHEN timed THEN strftime(e, '%Y-%m-%d') END AS valid_until,
        concat_ws(',', CASE WHEN document_type = 'DTI_BN_CERT' AND NOT ((e - s) / 365.25 BETWEEN 4.9 AND
            5.1) THEN 'UNUSUAL_VALIDITY_PERIOD' END,
            CASE WHEN timed AND e IS NULL AND NOT (document_type = 'GOVERNMENT_ID' AND
                contains(id_type, 'TIN')) THEN 'NO_EXPIRY_PRINTED' END,
            CASE WHEN timed AND e < today THEN 'EXPIRED:Expired on ' || strftime(e, '%Y-%m-%d') || ' (' ||
                (today - e) || ' days ago)' END,
            CASE WHEN timed AND e >= today AND s > today THEN 'NOT_YET_VALID' END) AS issues FROM v)"""


def _codes(issues):
    return F.array_join(F.transform(issues, lambda i: F.when(i["code"] == "EXPIRED", F.concat_ws(
        ":", i["code"], i["message"])).otherwise(i["code"])), ",")


def _validity(dated):
    return fi.check_validity(dated, DAY)


def _shown(df, issues):
    return df.select("doc_id", "document_type", "validity_status",
                     F.col("valid_until").cast("string").alias("valid_until"),
                     _codes(issues).alias("issues"))


register("validity", {"dated": DATED},
    lambda dated: _shown(_validity(dated), "validity_issues"),
    _VALID + " SELECT doc_id, document_type, validity_status, valid_until, issues FROM w9")

register("revalidate", {"dated": DATED},
    lambda dated: _shown(fi.revalidate(
        dated.withColumns({
            "issues": F.array(t.issue("EXPIRED", "old"), t.issue("KEPT", "kept")),
            "validity_status": F.lit("OLD"), "valid_until": F.lit(None).cast("date")}), DAY),
        "issues"),
    _VALID + """ SELECT doc_id, document_type,
        CASE WHEN document_type = 'OTHER' THEN 'OLD' ELSE validity_status END AS validity_status,
        CASE WHEN document_type = 'OTHER' THEN NULL ELSE valid_until END AS valid_until,
        CASE WHEN document_type = 'OTHER' THEN 'EXPIRED:old,KEPT' WHEN issues = '' THEN 'KEPT'
             ELSE 'KEPT,' || issues END AS issues FROM w9""")

# ---------------------------------------------------------------- D10-D12
REGISTERED = ("SELECT cast(o_orderkey AS string) AS sha256, 'BIR_2303' AS document_type, 'tin' AS name, "
              "'x' AS value, CASE WHEN o_orderkey % 3 = 0 THEN '123-456-789-00000' ELSE "
              "'123-456-789-00012' END AS normalized, 'EXACT' AS grounding, 0.95 AS confidence FROM "
              "{orders} UNION ALL SELECT cast(o_orderkey AS string), 'BIR_2303', 'registering_office', "
              "'Box', CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'HEAD OFFICE' "
              "ELSE 'BRANCH' END, 'UNVERIFIABLE', 0.5 FROM {orders} UNION ALL SELECT "
              "cast(o_orderkey AS string), 'BIR_2303', 'ocn', concat('056', 'RC', "
              "lpad(cast(o_orderkey AS string), 14, '0')), 'n', 'EXACT', 0.95 FROM {orders} UNION ALL "
              "SELECT cast(o_orderkey AS string), 'BIR_2303', 'rdo_code', CASE WHEN o_custkey % 2 = 0 "
              "THEN 'RDO 56' ELSE '43' END, 'n', 'EXACT', 0.95 FROM {orders}")
_CROSS = """
    , w AS (SELECT sha256, max(normalized) FILTER (name = 'tin') AS tin,
        max(normalized) FILTER (name = 'registering_office') AS office,
        max(value) FILTER (name = 'rdo_code') AS rdo FROM reg GROUP BY sha256),
    e AS (SELECT *, CASE WHEN right(tin, 5) = '00000' THEN 'HEAD OFFICE' ELSE 'BRANCH' END AS expected
          FROM w)"""
register("cross_fields", {"reg": REGISTERED},
    lambda reg: fi.cross_field_rules(reg, ["sha256"])[0].select("sha256", "name", "grounding", "confidence"),
    _CROSS + """ SELECT sha256, name, CASE WHEN name <> 'registering_office' OR office IS NULL THEN r.grounding
        WHEN office = expected THEN 'CROSS_CHECKED' ELSE 'CONFLICT' END AS grounding,
        cast(CASE WHEN name <> 'registering_office' OR office IS NULL THEN r.confidence
        WHEN office = expected THEN 0.9 ELSE 0.2 END AS double) AS confidence FROM reg r JOIN e USING (sha256)""")
register("cross_field_issues", {"reg": REGISTERED},
    lambda reg: fi.cross_field_rules(reg, ["sha256"])[1].drop("pos"),
    _CROSS + """ SELECT sha256, 'BRANCH_MISMATCH' AS code, 'TIN branch code ' || right(tin, 5) || ' means '
        || CASE WHEN right(tin, 5) = '00000' THEN 'Head Office' ELSE 'Branch' END ||
        ', but the ''Box'' box was read as marked' AS message, 'registering_office' AS field,
        'CRITICAL' AS severity FROM e WHERE office <> expected
    UNION ALL SELECT sha256, 'OCN_RDO_MISMATCH', 'OCN starts with 056 but the RDO is 043', 'ocn',
        'WARNING' FROM e WHERE rdo = '43'""")

MISMATCH = ("SELECT cast(o_orderkey AS string) AS sha256, CASE o_orderstatus WHEN 'F' THEN 'BIR_2303' WHEN "
            "'O' THEN 'GIS' ELSE 'OTHER' END AS expected_type, CASE o_orderkey % 3 WHEN 0 THEN 'BIR_2303' "
            "WHEN 1 THEN 'GIS' ELSE 'MAYORS_PERMIT' END AS model_type FROM {orders}")
register("type_mismatch", {"docs": MISMATCH},
    lambda docs: fi.type_disagreement(docs).select(
        "sha256", "extract_again", F.col("issue.message").alias("message")),
    """SELECT sha256, model_type <> 'GIS' AS extract_again, 'OCR classified ' || expected_type ||
       ', the vision model says ' || model_type AS message FROM docs
       WHERE expected_type <> model_type""")


def _document_issues(docs, reg, scored, dated):
    key = ["sha256"]
    valid = _validity(dated).withColumnRenamed("doc_id", "sha256")
    notes = docs.select("sha256", F.when(F.col("model_type") == "GIS", F.lit("blurry"))
                        .alias("legibility_notes"))
    out = fi.document_issues(key, fi.type_disagreement(docs),
                             fi.cross_field_rules(reg, key)[1], fi.field_issues(scored, key),
                             valid, notes)
    return out.select("sha256", F.array_join(F.transform("issues", lambda i: i["code"]), ",")
                      .alias("codes"))


register("document_issues", {"docs": MISMATCH, "reg": REGISTERED, "scored": SCORED, "dated": DATED},
    _document_issues,
    _CROSS + _VALID + """
    , parts AS (
        SELECT sha256, 0 AS p, 'TYPE_MISMATCH' AS c FROM docs WHERE expected_type <> model_type
        UNION ALL SELECT sha256, 1, 'BRANCH_MISMATCH' FROM e WHERE office <> expected
        UNION ALL SELECT sha256, 2, 'OCN_RDO_MISMATCH' FROM e WHERE rdo = '43'
        UNION ALL SELECT sha256, 3, 'MISSING_REQUIRED' FROM scored WHERE value IS NULL AND required
        UNION ALL SELECT sha256, 4, 'INVALID_' || upper(kind) FROM scored WHERE value IS NOT NULL
            AND normalized IS NULL AND kind IN ('tin', 'date')
        UNION ALL SELECT doc_id, 5, regexp_replace(issues, ':[^,]*', '') FROM w9 WHERE issues <> ''
        UNION ALL SELECT sha256, 6, 'LEGIBILITY_NOTE' FROM docs WHERE model_type = 'GIS')
    SELECT sha256, string_agg(c, ',' ORDER BY p) AS codes FROM parts GROUP BY sha256
    """)
