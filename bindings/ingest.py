"""Sources, content addressing and reading over documents, conversations, orders."""

import uuid

from pyspark.sql import functions as F

from attesta import rules
from attesta.operators import dedupe as dd
from attesta.operators import reading as rd
from attesta.session import checkpoint_ready
from attesta.sources import accounts as acc
from attesta.sources import files as fl
from attesta.sources import logs
from attesta.sources import model_outputs as mo
from bindings import QUERIES, register

DOCS = ("SELECT source AS job_id, doc_id, doc_id AS pos, text AS content, "
        "'doc_' || cast(doc_id AS string) || '.txt' AS file_name FROM {documents}")

# ---------------------------------------------------------------- A
QUERIES["scan_files"] = lambda spark, sf: fl.scan_files(spark, sf, "*.parquet").select(
    "file_name", "size", "sha256")

register("source_refs", {
    "orders_": "SELECT * FROM {orders}", "customers": "SELECT * FROM {customer}",
    "events_": "SELECT * FROM {events}"},
    lambda orders_, customers, events_: acc.discover_source_refs(
        customers.select(
            F.col("c_custkey").cast("string").alias("account_id"),
            *[F.when(F.col("c_custkey") % n == 0, F.array(F.struct(
                F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(f"a{n}-"), "c_custkey"))
                .alias("attachment_Id"),
                F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(f"f{n}-"), "c_custkey"))
                .alias("File_Id__s"), F.col("c_name").alias("File_Name__s")))).alias(f)
              for n, f in ((1, "Business_Permit"), (5, "Business_registration"))]),
        orders_.select(
            F.col("o_custkey").cast("string").alias("account_id"),
            F.col("o_orderkey").cast("string").alias("id"),
            F.col("o_orderpriority").alias("File_Name"), F.col("o_orderdate").alias(
                "Created_Time"),
            F.struct(F.col("o_orderstatus").alias("name"), F.lit(None).cast("string")
                     .alias("email")).alias("Created_By")),
        events_.select(
            F.col("user_id").cast("string").alias("account_id"),
            F.col("event_id").cast("string").alias("id"),
            F.when(F.col("event_type") != "error", F.array(F.struct(
                F.concat(F.lit("n"), "event_id").alias("id"), F.col("event_type").alias(
                    "File_Name"), F.col("ts").alias("Created_Time")))).alias("attachments")),
        ["Business_Permit", "Business_registration"]).drop("created_time"),
    """
    SELECT cast(o_custkey AS string) AS account_id, 'ATTACHMENT' AS source, NULL AS source_field,
        NULL AS parent_id, cast(o_orderkey AS string) AS file_ref, o_orderpriority AS file_name,
        o_orderstatus AS uploaded_by FROM orders_
    UNION ALL SELECT cast(user_id AS string), 'NOTE_ATTACHMENT', NULL, cast(event_id AS string),
        'n' || event_id, event_type, NULL FROM events_ WHERE event_type <> 'error'
    UNION ALL SELECT cast(c_custkey AS string), 'FILE_FIELD', f, NULL,
        CASE WHEN c_custkey % 2 = 0 THEN 'a' || n || '-' || c_custkey
             ELSE 'f' || n || '-' || c_custkey END, c_name, NULL
    FROM customers, (VALUES (1, 'Business_Permit'), (5, 'Business_registration')) v(n, f)
    WHERE c_custkey % n = 0 AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0)
    """)

# file kinds by document number: real text behind the first bytes of some format
_HEADS = {0: "25504446", 1: "FFD8FFE0", 2: "89504E470D0A1A0A", 3: "D0CF11E0A1B11AE1", 4: "424D",
          5: "504B0304", 6: ""}
register("check_files", {"docs": DOCS},
    lambda docs: fl.check_files(docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 9 == 3, F.concat(F.lit("d"), "doc_id", F.lit(".doc")))
        .otherwise(F.concat(F.lit("d"), "doc_id")).alias("file_name"),
        F.when(F.col("doc_id") % 9 == 8, F.lit(b"")).otherwise(F.concat(
            F.coalesce(*[F.when(F.col("doc_id") % 9 == k, F.unhex(F.lit(h)))
                         for k, h in _HEADS.items()], F.lit(b"")),
            F.encode("content", "UTF-8"))).alias("content")), 12000).drop("content"),
    """
    , sized AS (SELECT doc_id, doc_id % 9 AS k, CASE WHEN doc_id % 9 = 8 THEN 0 ELSE
        strlen(content) + CASE doc_id % 9 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 8
        WHEN 4 THEN 2 WHEN 5 THEN 4 ELSE 0 END END AS size,
        'd' || doc_id || CASE WHEN doc_id % 9 = 3 THEN '.doc' ELSE '' END AS file_name FROM docs),
    kinds AS (SELECT *, CASE WHEN size = 0 OR size > 12000 THEN NULL ELSE CASE k WHEN 0 THEN 'pdf'
        WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'doc' WHEN 4 THEN 'bmp' END END
        AS extension FROM sized)
    SELECT doc_id, file_name, extension IS NOT NULL AS ok, extension,
        CASE extension WHEN 'pdf' THEN 'application/pdf' WHEN 'jpg' THEN 'image/jpeg'
            WHEN 'png' THEN 'image/png' WHEN 'doc' THEN 'application/msword'
            WHEN 'bmp' THEN 'image/bmp' END AS mime_type,
        CASE WHEN size = 0 THEN 'File is empty'
             WHEN size > 12000 THEN 'File is ' || size || ' bytes; limit is 12000'
             WHEN extension IS NULL THEN 'Unsupported file type (detected=' || CASE k WHEN 5 THEN
                'zip' ELSE 'unknown' END || ', name=''' || file_name || ''')' END AS reason
    FROM kinds
    """)

OUTPUTS = ("SELECT 'h' || cast(o_orderkey AS string) AS sha256, 'v1' AS version, "
           "CASE WHEN o_orderpriority = '1-URGENT' THEN 'BIR_2303' "
           "WHEN o_orderpriority = '2-HIGH' THEN 'DTI_BN_CERT' ELSE 'OTHER' END AS expected_type, "
           "concat('{{\"document_type\": \"', CASE WHEN o_orderkey % 7 = 0 THEN 'DTI_BN_CERT' "
           "WHEN o_orderpriority = '1-URGENT' THEN 'BIR_2303' "
           "WHEN o_orderpriority = '2-HIGH' THEN 'DTI_BN_CERT' ELSE 'OTHER' END, "
           "'\", \"fields\": {{\"tin\": {{\"value\": \" ', cast(o_custkey AS string), "
           "' \", \"evidence\": \"\", \"page\": 1}}, \"bn_number\": {{\"value\": \"', "
           "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'BN' || cast(o_orderkey AS string) END, "
           "'\", \"evidence\": \"BN\", \"page\": \"x\"}}, \"document_title\": {{\"value\": null, "
           "\"evidence\": null, \"page\": null}}}}, \"other_fields\": [{{\"label\": \" Tel \", "
           "\"value\": \"', cast(o_orderkey AS string), '\", \"page\": 2}}, {{\"label\": \"\", "
           "\"value\": \"x\", \"page\": null}}], \"legibility_notes\": null}}') AS json, "
           "o_orderkey, o_custkey, o_orderpriority FROM {orders}")
_TYPE = ("CASE WHEN o_orderkey % 7 = 0 THEN 'DTI_BN_CERT' WHEN o_orderpriority = '1-URGENT' THEN "
         "'BIR_2303' WHEN o_orderpriority = '2-HIGH' THEN 'DTI_BN_CERT' ELSE 'OTHER' END")
_SPECS = ", ".join(f"('{kind}', '{name}', '{field}')" for kind, fields in rules.FIELD_SPECS.items()
                   for name, field, *_ in fields)
register("model_output", {"outputs": OUTPUTS},
    lambda outputs: mo.explode_model_output(outputs).select(
        "sha256", "document_type", "name", "kind", "value", "evidence", "page"),
    f"""
    , typed AS (SELECT sha256, o_orderkey, o_custkey, {_TYPE} AS document_type FROM outputs),
    specs(list, name, kind) AS (VALUES {_SPECS})
    SELECT sha256, t.document_type, name, kind,
        CASE WHEN name = 'tin' THEN cast(o_custkey AS string)
             WHEN name = 'bn_number' AND o_orderkey % 3 <> 0 THEN 'BN' || o_orderkey END AS value,
        CASE WHEN name = 'bn_number' THEN 'BN' END AS evidence,
        CASE WHEN name = 'tin' THEN 1 END AS page
    FROM typed t JOIN specs ON list = CASE WHEN document_type IN (SELECT list FROM specs) THEN document_type ELSE '*' END
    """)

register("other_fields", {"outputs": OUTPUTS},
    lambda outputs: mo.clean_other_fields(mo.parse_outputs(outputs)).select(
        "sha256", "label", "value", "page"),
    "SELECT sha256, 'Tel' AS label, cast(o_orderkey AS string) AS value, 2 AS page FROM outputs")

register("snapshot", {"customers": "SELECT cast(c_custkey AS string) AS account_id, c_name AS "
                      "Account_Name, c_mktsegment AS Business_Style FROM {customer}"},
    lambda customers: acc.snapshot_accounts(
        customers, ["Account_Name", "Business_Style", "Email"]),
    "SELECT account_id, Account_Name, Business_Style, cast(NULL AS string) AS Email "
    "FROM customers")

register("contacts", {"people": "SELECT cast(s_nationkey AS string) AS account_id, s_suppkey AS "
                      "id, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS Full_Name, 'Sup' AS "
                      "First_Name, CASE WHEN s_suppkey % 2 = 0 THEN cast(s_suppkey AS string) "
                      "ELSE '' END AS Last_Name, s_suppkey % 5 = 0 AS Primary_Contact, "
                      "CASE WHEN s_suppkey % 4 = 0 THEN 'Accounting' ELSE '' END AS Department "
                      "FROM {supplier}"},
    lambda people: acc.summarise_contacts(people).select(
        "account_id", "id", "name", "primary",
        F.try_element_at("roles", F.lit("Department")).alias("department")),
    """SELECT account_id, cast(id AS string) AS id, CASE WHEN Full_Name IS NOT NULL THEN Full_Name
        WHEN Last_Name <> '' THEN 'Sup ' || Last_Name ELSE 'Sup' END AS name,
        Primary_Contact AS "primary", nullif(Department, '') AS department FROM people""")

register("logs", {"updates": "SELECT cast(o_custkey AS string) AS account_id, o_orderpriority AS "
                  "field, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS old_value, "
                  "cast(o_orderkey AS string) AS new_value FROM {orders}"},
    lambda updates: logs.log_rows(updates, "Field Updates").select(
        "account_id", "field", "old_value", "new_value", "how"),
    "SELECT account_id, field, coalesce(old_value, '') AS old_value, new_value, '' AS how "
    "FROM updates")



def _written(**frames):
    """All four logs and the audit events: written by a run, by the same run again, and by another one."""
    names = {"Verifications": "asked", "Field Updates": "updates", "Activations": "active", "Document Expiry": "expiring"}
    held = {log: frames[f] for log, f in names.items()} | {"Audit": logs.audit_events(
        frames["seen"], "READ", F.concat(F.lit("Read "), F.col("job_id")), ["event", "n"])}
    spark = frames["seen"].sparkSession
    checkpoint_ready(spark, required=True)
    path = f"{spark.sparkContext.getCheckpointDir()}/logs-{uuid.uuid4().hex}"
    for day, run in (("2026-09-01", "one"), ("2026-09-01", "one"), ("2026-09-02", "two")):
        logs.write_logs(held, path, day, run)
    shown = {"Verifications": "reason", "Field Updates": "old_value", "Activations": "dv_number", "Document Expiry": "level",
             "Audit": "payload"}
    out = None
    for log, column in shown.items():
        rows = logs.read_logs(spark, path, log)
        rows = rows.select(F.lit(log).alias("log"), F.col("job_id" if log == "Audit" else "account_id").alias("id"),
                           F.col(column).alias("shown"), F.col("log_date").cast("string").alias("log_date"), "run")
        out = rows if out is None else out.unionByName(rows)
    return out


register("logs_written", {
    "asked": "SELECT cast(o_orderkey AS string) AS account_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS reason FROM {orders}",
    "updates": "SELECT cast(o_orderkey AS string) AS account_id, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS old_value FROM {orders}",
    "active": "SELECT cast(c_custkey AS string) AS account_id FROM {customer}",
    "expiring": "SELECT cast(s_suppkey AS string) AS account_id, '30 days' AS level FROM {supplier}",
    "seen": "SELECT cast(event_id AS string) AS job_id, event_type AS event, event_id % 7 AS n, ts AS created_at FROM {events}"},
    _written,
    """
    , l AS (SELECT 'Verifications' AS log, account_id AS id, coalesce(reason, '') AS shown FROM asked
        UNION ALL SELECT 'Field Updates', account_id, coalesce(old_value, '') FROM updates
        UNION ALL SELECT 'Activations', account_id, '' FROM active UNION ALL SELECT 'Document Expiry', account_id, level FROM expiring
        UNION ALL SELECT 'Audit', job_id, '{"event":"' || event || '","n":' || n || '}' FROM seen)
    SELECT log, id, shown, log_date, run FROM l CROSS JOIN (VALUES ('2026-09-01', 'one'), ('2026-09-02', 'two')) r(log_date, run)
    """)

# ---------------------------------------------------------------- B
register("duplicates", {"docs": DOCS},
    lambda docs: dd.mark_duplicates(docs).select(
        "job_id", "doc_id", "sha256", "status", "duplicate_of", "status_detail"),
    """
    , h AS (SELECT *, sha256(content) AS sha FROM docs),
    f AS (SELECT *, first_value(doc_id) OVER w AS f, first_value(file_name) OVER w AS n FROM h
          WINDOW w AS (PARTITION BY job_id, sha ORDER BY pos, doc_id))
    SELECT job_id, doc_id, sha AS sha256,
        CASE WHEN f = doc_id THEN 'STORED' ELSE 'DUPLICATE' END AS status,
        CASE WHEN f <> doc_id THEN f END AS duplicate_of,
        CASE WHEN f <> doc_id THEN 'Same content as ' || n END AS status_detail FROM f
    """)

_HASHED = ("SELECT doc_id, source, sha2(text, 256) AS sha256, n_chars AS size, lang AS mime_type, "
           "'txt' AS extension FROM {documents}")


def _hashed(name, run, oracle, **more):
    """Spark calls the hash sha2, the oracle sha256: the frame is the same otherwise."""
    register(name, {"docs": _HASHED, **more}, run)
    from bindings import ORACLES, duck
    ctes = ", ".join(f"{n} AS ({duck(q).replace('sha2(text, 256)', 'sha256(text)')})"
                     for n, q in {"docs": _HASHED, **more}.items())
    ORACLES[name] = f"WITH {ctes} {oracle.strip()}"


_hashed("new_contents", lambda docs, held: dd.new_contents(docs, held),
    """
    , one AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS rn FROM docs
              WHERE sha256 NOT IN (SELECT sha256 FROM held))
    SELECT sha256, size, mime_type, extension,
        'originals/' || substr(sha256, 1, 2) || '/' || sha256 || '.txt' AS storage_key
    FROM one WHERE rn = 1
    """, held="SELECT sha2(text, 256) AS sha256 FROM {documents} WHERE lang = 'en'")

_hashed("pending_work", lambda docs, done: dd.pending_work(
        docs.select("sha256").distinct(), done, "read-1.1", "EXTRACTED"),
    """SELECT DISTINCT sha256, 'read-1.1' AS version FROM docs WHERE sha256 NOT IN (
        SELECT sha256 FROM done WHERE version = 'read-1.1' AND status = 'EXTRACTED')""",
    done="SELECT sha2(text, 256) AS sha256, CASE WHEN lang = 'fr' THEN 'read-1.0' ELSE 'read-1.1' "
         "END AS version, CASE WHEN n_chars > 2000 THEN 'EXTRACTED' ELSE 'FAILED' END AS status "
         "FROM {documents}")

_hashed("reuse_results", lambda docs, results: dd.reuse_results(
        docs, results, "v1").select("doc_id", "sha256", "chars", "first_doc"),
    """SELECT doc_id, d.sha256, chars, first_doc FROM docs d LEFT JOIN results r
       ON d.sha256 = r.sha256""",
    results="SELECT sha2(text, 256) AS sha256, 'v1' AS version, max(n_chars) AS chars, "
            "min(doc_id) AS first_doc FROM {documents} WHERE lang <> 'de' GROUP BY 1, 2")

_hashed("purgeable", lambda docs, jobs: dd.purgeable_contents(
        docs.withColumnRenamed("source", "job_id"), jobs,
        jobs.where(F.col("status") == "ASSESSED")),
    """
    , p AS (SELECT DISTINCT source AS job_id, sha256 FROM docs),
    used AS (SELECT p.sha256 FROM p JOIN jobs USING (job_id) WHERE status = 'READING')
    SELECT p.job_id, p.sha256, p.sha256 NOT IN (SELECT sha256 FROM used) AS purge
    FROM p JOIN jobs USING (job_id) WHERE status = 'ASSESSED'
    """, jobs="SELECT DISTINCT source AS job_id, CASE WHEN source IN ('src0', 'src3', 'src7') THEN "
              "'READING' ELSE 'ASSESSED' END AS status FROM {documents}")

register("purge_totals", {"docs": "SELECT DISTINCT source AS job_id, text AS sha256 FROM "
                          "{documents}", "jobs": "SELECT DISTINCT source AS job_id, CASE WHEN "
                          "source IN ('src0', 'src3') THEN 'QUEUED' ELSE 'READ' END AS status "
                          "FROM {documents}"},
    lambda docs, jobs: dd.purge_summary(dd.purgeable_contents(
        docs, jobs, jobs.where(F.col("status") == "READ"))),
    """
    , used AS (SELECT sha256 FROM docs JOIN jobs USING (job_id) WHERE status = 'QUEUED')
    SELECT job_id, count(*) FILTER (u IS NULL) AS files_deleted,
        count(*) FILTER (u IS NOT NULL) AS kept_for_other_jobs
    FROM docs JOIN jobs USING (job_id) LEFT JOIN (SELECT DISTINCT sha256 AS u FROM used) ON
        u = sha256 WHERE status = 'READ' GROUP BY job_id
    """)

register("expired_copies", {"reviews": "SELECT o_orderkey AS review_id, CASE WHEN o_orderstatus <> "
                            "'O' THEN o_orderdate END AS closed_at, o_orderkey % 5 = 0 AS "
                            "images_purged, o_orderpriority FROM {orders}"},
    lambda reviews: dd.expired_review_copies(reviews.withColumn("pages", F.split(
        "o_orderpriority", "-")), 30, "2000-06-30 00:00:00").select("review_id", "page_key"),
    """SELECT review_id, unnest(string_split(o_orderpriority, '-')) AS page_key FROM reviews
       WHERE closed_at < TIMESTAMP '2000-06-30' - INTERVAL 30 DAY AND NOT images_purged""")

register("canonical_match", {
    "files": "SELECT concat('/in/attachment_', cast(o_orderkey AS string), '_Part ', "
             "cast(o_custkey AS string), CASE WHEN o_orderkey % 11 = 0 THEN '.json' ELSE '.PNG' "
             "END) AS path FROM {orders}",
    "gold": "SELECT concat('part_', cast(c_custkey AS string), '.png') AS file_name "
            "FROM {customer}"},
    lambda files, gold: dd.match_by_canonical_name(files, gold),
    """
    , k AS (SELECT path, lower(regexp_replace(regexp_replace(path, '^/in/attachment_[0-9]+_', ''),
                               '[^A-Za-z0-9]', '', 'g')) AS k FROM files WHERE path NOT LIKE '%.json'),
    f AS (SELECT k, min(path) AS matched_path FROM k GROUP BY k)
    SELECT file_name, matched_path FROM gold LEFT JOIN f ON
        replace(replace(file_name, '_', ''), '.', '') = k
    """)

register("missing_at_target", {
    "files": "SELECT cast(doc_id % 700 AS string) AS file_name, doc_id AS pos, lang FROM "
             "{documents}", "target": "SELECT cast(doc_id AS string) AS file_name FROM {labels}"},
    lambda files, target: dd.missing_at_target(files, target),
    """
    , r AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY pos) AS rn FROM files)
    SELECT file_name, pos, lang FROM r WHERE rn = 1
        AND file_name NOT IN (SELECT file_name FROM target)
    """)

# ---------------------------------------------------------------- C
WORDS = ("SELECT cast(l_orderkey AS string) AS sha256, 1 AS page_number, 'ocr' AS pass, 1 AS block, "
         "1 AS par, l_linenumber AS line, l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity "
         "AS int) AS pos, CASE WHEN l_partkey % 13 = 0 THEN ' ' ELSE concat(l_returnflag, "
         "CASE WHEN l_partkey % 2 = 0 THEN 'word' ELSE cast(l_partkey AS string) END) END AS text, "
         "CASE WHEN l_partkey % 17 = 0 THEN -1.0 ELSE cast(l_quantity AS int) * 2.0 END AS conf, "
         "l_extendedprice FROM {lineitem}")
register("page_text", {"words": WORDS.replace(", l_extendedprice FROM", " FROM")},
    lambda words: rd.assemble_page_text(words),
    """
    , kept AS (SELECT * FROM words WHERE trim(text) <> '' AND conf >= 0),
    lines AS (SELECT sha256, page_number, "pass", line,
              string_agg(text, ' ' ORDER BY pos, text) AS t, sum(conf) AS c, count(*) AS n,
              count(*) FILTER (conf >= 70 AND regexp_full_match(text, '[A-Za-z]{3,}')) AS r
              FROM kept GROUP BY ALL),
    p AS (SELECT sha256, string_agg(t, chr(10) ORDER BY line) AS text, sum(c) / sum(n) AS m,
          sum(n) AS n, sum(r) AS r FROM lines GROUP BY sha256)
    SELECT w.sha256, 1 AS page_number, 'ocr' AS "pass", coalesce(p.text, '') AS text,
        cast(round(cast(coalesce(m, 0) AS decimal(18, 8)), 1) AS double) AS mean_conf,
        cast(coalesce(n, 0) AS bigint) AS word_count, cast(coalesce(r, 0) AS bigint) AS readable
    FROM (SELECT DISTINCT sha256 FROM words) w LEFT JOIN p USING (sha256)
    """)

# one reading per page and pass: the first document of each
READINGS = ("SELECT cast(page AS string) AS sha256, 1 AS page_number, pass, min(text) AS text, "
            "50.5 AS mean_conf, max(n_chars) AS word_count, max(n_chars) % 4 AS readable FROM ("
            "SELECT doc_id - doc_id % 3 AS page, CASE doc_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'ink' "
            "ELSE 'adaptive' END AS pass, text, n_chars FROM {documents}) x GROUP BY page, pass")
register("best_reading", {"readings": READINGS},
    lambda readings: rd.choose_best_reading(readings).select(
        "sha256", "page_number", F.sha2("text", 256).alias("text_hash"), "word_count", "readable",
        F.sha2("grounding_text", 256).alias("grounding_hash"), "text_method"),
    """
    , r AS (SELECT *, CASE "pass" WHEN 'ocr' THEN 1 WHEN 'ink' THEN 2 ELSE 3 END AS place FROM readings),
    b AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY readable DESC, place) AS rn,
          count(*) OVER (PARTITION BY sha256) AS n FROM r),
    g AS (SELECT sha256, string_agg(text, chr(10) ORDER BY place) AS g FROM r GROUP BY sha256)
    SELECT sha256, page_number, sha256(text) AS text_hash, word_count, readable,
        sha256(g) AS grounding_hash, CASE WHEN n = 1 THEN "pass" WHEN "pass" = 'ocr' THEN 'ocr+ink'
        ELSE 'ocr+' || "pass" END AS text_method
    FROM b JOIN g USING (sha256) WHERE rn = 1
    """)

PAGES = ("SELECT cast(o_custkey AS string) AS sha256, 'v1' AS version, o_orderkey AS page_number, "
         "cast(floor(o_totalprice / 5000) AS int) AS conf_i, cast(floor(o_totalprice / 5000) AS int) * 1.0 AS "
         "ocr_conf, cast(floor(o_totalprice / 5000) AS int) * 1.0 AS mean_conf, "
         "cast(o_orderkey % 90 AS int) AS word_count, cast(o_orderkey % 400 AS int) * 1.0 AS "
         "sharpness, cast(o_orderkey % 2500 AS int) AS resolution, o_orderkey % 19 = 0 AS "
         "text_layer, o_orderpriority AS document_type, o_totalprice AS type_confidence "
         "FROM {orders}")
_LABEL = """CASE WHEN text_layer THEN 'GOOD' WHEN word_count < 15 OR ocr_conf < 40 THEN 'UNREADABLE'
    WHEN score >= 0.7 THEN 'GOOD' WHEN score >= 0.5 THEN 'FAIR' ELSE 'POOR' END"""
_SCORED = f"""
    , s AS (SELECT *, CASE WHEN text_layer THEN 1.0 ELSE cast(round(cast(
        0.6 * greatest(0, least(1, (ocr_conf - 40) / 50.0)) + 0.25 * greatest(0, least(1,
        sharpness / 300.0)) + 0.15 * greatest(0, least(1, resolution / 2000.0)) AS double), 2)
        AS double) END AS score FROM pages),
    q AS (SELECT *, {_LABEL} AS quality_label FROM s)"""
register("second_pass", {"pages": PAGES},
    lambda pages: rd.flag_second_pass(pages).select(
        "sha256", "page_number", F.array_join("second_passes", "+").alias("passes")),
    """SELECT sha256, page_number, CASE WHEN word_count < 40 THEN 'ink+adaptive' ELSE 'ink' END AS
       passes FROM pages WHERE mean_conf < 80 OR word_count < 40""")

register("route_pages", {"docs": "SELECT doc_id, text FROM {documents}"},
    lambda docs: rd.route_pages(docs, 1500).select("doc_id", "source", "text_layer"),
    """SELECT doc_id, CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) >= 1500 THEN
       'pdf_text' ELSE 'pdf_scan' END AS source,
       length(regexp_replace(text, '\\s', '', 'g')) >= 1500 AS text_layer FROM docs""")

register("top_pages", {"docs": "SELECT doc_id, source, n_chars FROM {documents}"},
    lambda docs: rd.limit_pages(docs, 2, ["source"], ["doc_id"]),
    """SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER
       BY doc_id) AS rn FROM docs) WHERE rn <= 2""")

register("quality", {"pages": PAGES},
    lambda pages: rd.score_page_quality(pages).select(
        "sha256", "page_number", F.col("quality_label"),
        F.array_join("quality_reasons", "; ").alias("reasons")),
    _SCORED + """
    SELECT sha256, page_number, quality_label, CASE WHEN text_layer THEN 'digital PDF text layer'
        ELSE concat_ws('; ',
            CASE WHEN resolution < 1000 THEN 'low resolution (' || resolution || 'px long side)' END,
            CASE WHEN sharpness < 60 THEN 'blurry' END,
            CASE WHEN word_count < 15 THEN 'very little readable text' END) END AS reasons FROM q
    """)

register("rollup_readings", {"pages": PAGES},
    lambda pages: rd.rollup_readings(rd.score_page_quality(pages)),
    _SCORED + """
    SELECT sha256, version, CASE WHEN bool_and(quality_label = 'UNREADABLE') THEN 'UNREADABLE' ELSE
        'READ' END AS status, CASE WHEN bool_and(quality_label = 'UNREADABLE') THEN
        'No readable text (blurry, dark or not a document)' END AS error,
        count(*) AS page_count, arg_min(document_type, page_number) AS document_type,
        arg_min(type_confidence, page_number) AS type_confidence FROM q GROUP BY sha256, version
    """)

register("readable_pages", {"pages": PAGES},
    lambda pages: rd.readable_pages(rd.score_page_quality(pages)).select(
        "sha256", "page_number", "quality_label"),
    _SCORED + " SELECT sha256, page_number, quality_label FROM q "
              "WHERE quality_label <> 'UNREADABLE'")

RULES = [("LICENSE", "LICENSED UNDER THE APACHE LICENSE", 4.0), ("LICENSE", "MIT LICENSE", 3.5),
         ("LICENSE", "RIGHTS RESERVED", 1.5), ("SECRET", "TOKEN", 3.0), ("SECRET", "API KEY", 2.0),
         ("CONTACT", "EXAMPLE COM", 3.0), ("CONTACT", "555", 1.0), ("CONTACT", "MAIL", 1.5)]
HINTS = [("LICENSE", "SRC"), ("PLAIN", "SRC1")]


def classify(docs):
    """Documents by license, secret and contact phrases."""
    return rd.classify_documents(docs, RULES, HINTS, name="source")


_PHRASES = ", ".join(f"({i}, '{d}', '{''.join(p.split())}', {w})"
                     for i, (d, p, w) in enumerate(RULES))
CLASSIFY_SQL = f"""
    , sq AS (SELECT doc_id, source, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS t FROM docs),
    r(i, type, phrase, weight) AS (VALUES {_PHRASES}),
    hit AS (SELECT doc_id, type, min(i) AS pos, sum(weight) AS score FROM sq, r
            WHERE contains(t, phrase) GROUP BY doc_id, type
        UNION ALL SELECT doc_id, 'LICENSE', 100, 1.0 FROM sq
            WHERE regexp_matches(upper(source), '(^|[^A-Z])SRC([^A-Z]|$)')
        UNION ALL SELECT doc_id, 'PLAIN', 101, 1.0 FROM sq
            WHERE regexp_matches(upper(source), '(^|[^A-Z])SRC1([^A-Z]|$)')),
    sc AS (SELECT doc_id, type, min(pos) AS pos, sum(score) AS score FROM hit GROUP BY doc_id, type),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM sc),
    top AS (SELECT a.doc_id, a.type, cast(a.score AS double) AS s,
            cast(coalesce(b.score, 0) AS double) AS s2
            FROM rk a LEFT JOIN rk b ON a.doc_id = b.doc_id AND b.rn = 2 WHERE a.rn = 1),
    cls AS (SELECT d.doc_id, d.source, CASE WHEN s >= 3 THEN type ELSE 'OTHER' END AS document_type,
        CASE WHEN s >= 3 THEN least(1.0, round(least(1.0, s / 10) * (1 - s2 / (s + s2)) * 2, 2))
        ELSE 0.0 END AS type_confidence FROM docs d LEFT JOIN top USING (doc_id))"""
CLASS_DOCS = "SELECT doc_id, source, text FROM {documents}"
register("classify", {"docs": CLASS_DOCS},
    lambda docs: classify(docs).select("doc_id", "document_type", "type_confidence"),
    CLASSIFY_SQL + " SELECT doc_id, document_type, type_confidence FROM cls")


def classify_by_source(docs):
    """Flagship: documents and mean confidence per source and type."""
    return classify(docs).groupBy("source", "document_type").agg(
        F.count("*").alias("documents"),
        F.round(F.avg("type_confidence"), 4).alias("mean_confidence"))


register("classify_by_source", {"docs": CLASS_DOCS}, classify_by_source,
    CLASSIFY_SQL + """ SELECT source, document_type, count(*) AS documents,
        round(avg(type_confidence), 4) AS mean_confidence FROM cls GROUP BY ALL""")
