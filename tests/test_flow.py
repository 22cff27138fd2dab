"""Alerts, reminders, reviews, write-back, requests, measurement."""

from datetime import date, datetime

from pyspark.sql import functions as F

from attesta.operators import alerts as al
from attesta.operators import measure as me
from attesta.operators import requests as rq
from attesta.operators import reviews as rv

TODAY = date(2026, 10, 1)
RUN = "account_id string, job_id string, signature string, created_at timestamp, task_status string"


def at(day, hour=0):
    return datetime(2026, 9, day, hour)


def test_repeats_against_history(spark, rows):
    history = spark.createDataFrame([
        ("a", "j1", "s", at(1), "CREATED"), ("a", "j2", "s", at(5), "SKIPPED"),
        ("b", "j3", "s", at(1), "FAILED"), ("c", "j4", "s", at(1), "SHADOW")], RUN)
    new = spark.createDataFrame([
        ("a", "n1", "s", at(8), ""), ("a", "n2", "s", at(8, 1), ""), ("a", "n3", "t", at(3), ""),
        ("b", "n4", "s", at(2), ""), ("c", "j4", "s", at(2), ""), ("c", "n6", "s", at(2), "")],
        RUN).drop("task_status")
    got = {r["job_id"]: r["repeat"] for r in rows(al.suppress_repeats(new, history))}
    assert got == {"n1": True, "n2": False, "n3": False, "n4": False, "j4": False, "n6": True}


def test_signature_keeps_repeats(spark, rows):
    alerts = spark.createDataFrame(
        [("a", "WARNING", "X", "T"), ("a", "WARNING", "X", "T"), ("a", "CRITICAL", "A", None),
         ("a", "INFO", "Z", None), ("b", "INFO", "Z", None)],
        "account_id string, severity string, code string, document_type string")
    assert rows(al.alert_signature(alerts)) == [{"account_id": "a", "signature": "A:None|X:T|X:T"}]


def test_reminders_recheck_and_renewal(spark, rows):
    req = spark.createDataFrame([
        ("a", "MAYORS_PERMIT", "VALID", "2026-10-25", "f"), ("b", "MAYORS_PERMIT", "VALID", "2026-10-06", "f"),
        ("c", "MAYORS_PERMIT", "EXPIRED", "2026-09-30", "f"), ("d", "MAYORS_PERMIT", "VALID", "2026-10-01", "f"),
        ("e", "MAYORS_PERMIT", "VALID", "2027-10-01", "f"), ("f", "MAYORS_PERMIT", "MISSING", None, None)],
        "account_id string, document_type string, status string, valid_until string, file string")
    ledger = spark.createDataFrame([
        ("expiry", "b|MAYORS_PERMIT|2026-10-06|30 days"), ("expiry", "d|MAYORS_PERMIT|2026-10-01|today"),
        ("expiry", "e|MAYORS_PERMIT|2026-09-15|30 days")], "kind string, ref string")
    due = al.expiry_reminders(req, ledger, TODAY)
    assert {(r["account_id"], r["level"]) for r in rows(due)} == {
        ("a", "30 days"), ("b", "7 days"), ("c", "expired")}
    text = {r["account_id"]: r["message"] for r in rows(al.reminder_text(
        due.withColumns({"account_name": F.lit("Sol"), "customer_number": F.lit("C-1")})))}
    assert text["c"] == ("⚠️ Mayor's permit of Sol (C-1) expired on 30 Sep 2026 (1 days ago). Please "
                         "collect the renewed Mayor's permit and attach it to the Account.")
    files = spark.createDataFrame([("a", at(20)), ("b", at(2))],
                                  "account_id string, Created_Time timestamp")
    latest = spark.createDataFrame([(x, at(10)) for x in "abc"],
                                   "account_id string, created_at timestamp")
    again, remind = al.recheck_before_reminder(due, files, latest)
    assert [r["account_id"] for r in rows(again)] == ["a"]
    assert {r["account_id"] for r in rows(remind)} == {"b", "c"}
    new = al.renewals(req, ledger)
    assert [(r["account_id"], r["ref"]) for r in rows(new)] == [("e", "e|MAYORS_PERMIT|2027-10-01")]
    told = ledger.unionByName(new.select(F.lit("renewed").alias("kind"), "ref"))
    assert al.renewals(req, told).count() == 0


def test_latest_keeps_ties_and_once_only(spark, rows):
    a = spark.createDataFrame([("a", 1, at(1)), ("a", 2, at(2)), ("a", 3, at(2)), ("b", 4, at(1))],
                              "account_id string, n int, created_at timestamp")
    assert {r["n"] for r in rows(al.latest_per_account(a))} == {2, 3, 4}
    events = spark.createDataFrame(
        [("k", "r" * 310, 1, at(2)), ("k", "r" * 305, 2, at(1)), ("k", "s", 3, at(1))],
        "kind string, ref string, n int, created_at timestamp")
    ledger = spark.createDataFrame([("k", "s")], "kind string, ref string")
    assert [(r["n"], len(r["ref"])) for r in rows(al.once_only(events, ledger), "n")] == [(1, 310), (2, 305)]


REVIEW = ("review_id string, status string, reviewer string, reviewer_notes string, "
          "closed_at timestamp")


def test_decisions_and_closing(spark, rows):
    reviews = spark.createDataFrame([
        ("1", "Pending Review", None, None, None), ("2", "Applied", "x", None, None),
        ("3", "In Review", "first", None, None)], REVIEW)
    lines = spark.createDataFrame([("1", "1", "Pending", None, None), ("1", "2", "Pending", None, "old"),
                                   ("2", "1", "Pending", None, None), ("3", "1", "Pending", None, None)],
                                  "review_id string, row_id string, decision string, "
                                  "edited_value string, comment string")
    made = spark.createDataFrame([
        ("1", "1", "Approve", None, "why", "Lia", at(1)), ("1", "1", "Edit", " new ", None, "Max", at(2)),
        ("1", "2", "Edit", " ", None, "Max", at(3)), ("1", "9", "Approve", None, None, "Max", at(3)),
        ("2", "1", "Approve", None, None, "Max", at(3)), ("3", "1", "Reject", "x", None, "Max", at(3)),
        ("1", "2", "Maybe", None, None, "Max", at(4))],
        "review_id string, row_id string, decision string, value string, comment string, "
        "reviewer string, ts timestamp")
    out, out_rows, rejects = rv.fold_decisions(reviews, lines, made)
    assert {r["review_id"]: (r["status"], r["reviewer"]) for r in rows(out)} == {
        "1": ("In Review", "Lia"), "2": ("Applied", "x"), "3": ("In Review", "first")}
    assert {(r["review_id"], r["row_id"]): (r["decision"], r["edited_value"], r["comment"])
            for r in rows(out_rows)} == {
        ("1", "1"): ("Edit", "new", "why"), ("1", "2"): ("Pending", None, "old"),
        ("2", "1"): ("Pending", None, None), ("3", "1"): ("Reject", None, None)}
    assert {r["problem"] for r in rows(rejects)} == {
        "Edit needs the corrected value", "Row 9 not found",
        "Review is Applied; it can no longer change",
        "Decision must be one of Pending, Approve, Edit, Reject"}
    closings = spark.createDataFrame([
        ("1", "Rejected", "Lia", " ", True, at(1)), ("1", "Approved", "Lia", None, False, at(2)),
        ("1", "Waiting for Documents", "Lia", "need permit", None, at(3)),
        ("1", "Rejected", "Max", "no", None, at(4)), ("2", "Rejected", "Max", "no", None, at(4)),
        ("3", "Approved", "Max", None, True, at(5))],
        "review_id string, status string, reviewer string, notes string, values_compared boolean, "
        "ts timestamp")
    closed, bad = rv.close_reviews(reviews, closings)
    assert {r["review_id"]: r["status"] for r in rows(closed)} == {
        "1": "Waiting for Documents", "2": "Applied", "3": "Approved"}
    assert bad.count() == 4


def test_write_back(spark, rows):
    accounts = spark.createDataFrame([("a", "Old  name", "x@y.ph", None), ("b", "B", None, None)],
                                     "account_id string, Owner_Name string, Email string, "
                                     "Business_Permit string")
    lines = spark.createDataFrame([
        ("a", 1, "Owner_Name", "Approve", "OLD NAME", "Ana", None),
        ("a", 2, "Email", "Edit", "other@y.ph", "p@q.ph", "e@q.ph"),
        ("a", 3, "Owner_Name", "Edit", "old name", "Ana", "Ana M"),
        ("a", 4, "Business_Permit", "Approve", None, "f.pdf", None),
        ("a", 5, "Email", "Reject", "x@y.ph", "z", None), ("b", 6, "Email", "Approve", None, "", None),
        ("b", 7, "Owner_Name", None, "B", "C", None)],
        "account_id string, row_pos int, target_field string, decision string, "
        "current_value string, proposed_value string, edited_value string")
    out = rv.apply_rows(lines, accounts)
    got = {r["row_pos"]: (r["outcome"], r["detail"]) for r in rows(out)}
    assert {k: v[0] for k, v in got.items()} == {
        1: "APPLIED", 2: "CONFLICT", 3: "APPLIED", 4: "UNSUPPORTED", 5: "NOT_APPROVED",
        6: "NO_VALUE", 7: "NOT_APPROVED"}
    assert got[2][1] == "Account now has 'x@y.ph', review expected 'other@y.ph'"
    assert got[7][1] == "Decision empty: not written"
    new = {r["account_id"]: r for r in rows(rv.next_accounts(accounts, out))}
    assert new["a"]["Owner_Name"] == "Ana M" and new["a"]["Email"] == "x@y.ph"
    assert {r["row_pos"]: r["outcome"] for r in rows(rv.apply_rows(
        lines, accounts, dry_run=True))}[1] == "WRITE"
    audit = rv.record_updates(out.withColumns({"job_id": F.lit("j"), "created_at": F.lit(1)}))
    assert {r["status"] for r in rows(rv.updates_of(audit, "j"))} == {"APPLIED",
                                                                     "SKIPPED_CHANGED"}
    plan = lines.select("account_id", F.col("row_pos").alias("pos"), "target_field", F.lit("FILL").alias("action"),
                        "current_value", F.col("proposed_value").alias("new_value"),
                        F.lit(0.9).alias("confidence"), F.lit("EXACT").alias("grounding"),
                        F.lit("AUTO").alias("decision"), F.lit("why").alias("reason"))
    assert {r["status"] for r in rows(rv.apply_auto_updates(plan, accounts))} == {"SHADOW"}
    on = {r["pos"]: r["status"] for r in rows(rv.apply_auto_updates(plan, accounts, "on"))}
    assert on[1] == "APPLIED" and on[2] == "SKIPPED_CHANGED"
    reviews = spark.createDataFrame([("1", True), ("2", True), ("3", False)],
                                    "review_id string, activate_account boolean")
    done = spark.createDataFrame([("1", "FAILED"), ("2", "CONFLICT"), ("2", "APPLIED")],
                                 "review_id string, outcome string")
    assert [(r["write_status"], r["activated"]) for r in rows(rv.activate_reviewed(reviews, done),
                                                              "review_id")] == [
        ("Failed", False), ("Conflict", True), ("Applied", None)]


def test_numbers_are_dense_and_lists_page(spark, rows):
    new = spark.range(500).select(F.concat(F.lit("j"), "id").alias("job_id"),
                                  (F.col("id") % 7).alias("created_at"))
    held = spark.createDataFrame([("j3", 41)], "job_id string, number long")
    got = rows(rv.number_reviews(new, held), "number")
    assert [r["number"] for r in got] == list(range(42, 42 + 499))
    order = [(r["created_at"], r["job_id"]) for r in got]
    assert order == sorted(order)
    reviews = spark.createDataFrame([(f"{i}", "a", s, at(1 + i)) for i, s in enumerate(
        ["Applied", "In Review", "Pending Review", "Pending Review"])],
        "review_id string, account_id string, status string, created_at timestamp")
    assert [r["review_id"] for r in rv.list_reviews(reviews, "open", limit=2).collect()] == ["3", "2"]
    assert [r["review_id"] for r in rv.list_reviews(reviews, "open", limit=2, offset=2).collect()
            ] == ["1"]


RAW = ("account_id string, customer_number string, reason string, document_status string, "
       "attachment_count string, requested_by string, requested_at string, source string")


def test_requests(spark, rows):
    raw = spark.createDataFrame([
        (" 1000000000000001 ", "C-1", "x", "YES", "3", "1000000000000003 lia@sol.ph",
         "2026-10-05T15:36:00+08:00", "crm_button"),
        ("1000000000000002", "", None, "NO", None, None, "2026-10-05T15:36:00", None),
        ("123", "", "", "YES", "", "", "", ""), ("1000000000000003", "", "", "MAYBE", "501", "", "x", "web")], RAW)
    good, bad = rq.clean_requests(raw)
    got = rows(good, "account_id")
    assert got[0]["requested_by_email"] == "lia@sol.ph" and got[0]["requested_by_id"] == "1000000000000003"
    assert got[0]["requested_at"] == got[1]["requested_at"] == datetime(2026, 10, 5, 7, 36)
    assert got[1]["customer_number"] is None and got[1]["source"] == "crm_button"
    problems = {r["account_id"]: r["problem"] for r in rows(bad)}
    assert problems["123"] == "account_id must be 10 to 25 digits"
    assert problems["1000000000000003"].count(";") == 3


def test_active_jobs_flags_and_reconciliation(spark, rows):
    req = spark.createDataFrame([("a", 1, at(1)), ("a", 2, at(2)), ("b", 3, at(1)), ("c", 4, at(1))],
                                "account_id string, request_id int, requested_at timestamp")
    jobs = spark.createDataFrame([("b", "jb", "READING"), ("c", "jc", "READ")],
                                 "account_id string, job_id string, status string")
    got = {r["request_id"]: r for r in rows(rq.one_active_job(req, jobs))}
    assert [got[i]["created"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[1]["job_id"] == got[2]["job_id"] and got[3]["job_id"] == "jb"
    accounts = spark.createDataFrame([("1", True, "COD"), ("2", False, "COD"), ("x", True, "COD"),
                                      ("4", True, "30 days")],
                                     "account_id string, DV_Requested boolean, Credit_Terms string")
    assert rq.flagged_accounts(accounts).count() == 2
    assert [r["account_id"] for r in rows(rq.flagged_accounts(accounts, cod_only=True))] == ["1"]
    asked = spark.createDataFrame([("a", "YES", 2, "N1"), ("b", "YES", None, None), ("c", "NO", 1, "N3")],
                                  "account_id string, document_status string, attachment_count int, "
                                  "customer_number string")
    refs = spark.createDataFrame([("a", "ATTACHMENT"), ("a", "FILE_FIELD"), ("c", "ATTACHMENT")],
                                 "account_id string, source string")
    held = spark.createDataFrame([("a", "N2"), ("c", "N3")],
                                 "account_id string, Inventory_Customer_Number string")
    assert {(r["account_id"], r["code"]) for r in rows(rq.reconcile_reported(asked, refs, held))} == {
        ("a", "CUSTOMER_NUMBER_MISMATCH"), ("b", "DOCUMENT_STATUS_MISMATCH"),
        ("c", "DOCUMENT_STATUS_MISMATCH")}
    docs = spark.createDataFrame([("1", "STORED", "ATTACHMENT"), ("2", "DOWNLOAD_FAILED", "FILE_FIELD"),
                                  ("3", "REJECTED", "ATTACHMENT")],
                                 "job_id string, status string, source string")
    got = rows(rq.collection_summary(spark.createDataFrame([(x,) for x in "1234"], "job_id string"),
                                     docs), "job_id")
    assert [r["job_status"] for r in got] == ["COLLECTED", "FAILED", "NO_DOCUMENTS",
                                              "NO_DOCUMENTS"]


def test_scores(spark, rows):
    gold = spark.createDataFrame([
        ("d", "tin", ["234567890"]), ("d", "owner", ["ANA REYES", "REYES ANA LUNA"]),
        ("d", "address", ["5 RIZAL STREET POBLACION TAGUIG"]), ("d", "date", ["2026-01-01"]),
        ("d", "code", ["12"]), ("d", "unknown", ["x"])], "doc_id string, field string, accepted array<string>")
    fields = spark.createDataFrame([
        ("d", "tin", "tin", "234-567-890", "EXACT"), ("d", "owner", "name", "Reyes, Ana Luna", "FUZZY"),
        ("d", "address", "address", "5 RIZAL STREET POBLACION TAGUIJ", "EXACT"),
        ("d", "date", "date", None, None), ("d", "code", "code", "13", "EXACT")],
        "doc_id string, name string, kind string, value string, grounding string")
    judged = me.judge_fields(gold, fields)
    assert {r["field"]: r["result"] for r in rows(judged)} == {
        "tin": "CORRECT", "owner": "CORRECT", "address": "MINOR_DIFF", "date": "MISSED",
        "code": "WRONG"}
    total = rows(me.score_extraction(judged))[0]
    assert (total["fields_total"], total["field_accuracy"], total["wrong_but_looked_confirmed"],
            total["wrong_exact"]) == (5, 0.4, 1, 1)
    texts = spark.createDataFrame([("d", "TIN 234-567-890 ok", "BIR_2303")],
                                  "doc_id string, text string, document_type string")
    types = spark.createDataFrame([("d", "BIR_2303")], "doc_id string, expected_type string")
    got = rows(me.score_reading(types, gold.where("field in ('tin', 'owner')"), texts))[0]
    assert (got["type_correct"], got["fields_found"], got["missing"]) == (True, 1, ["owner"])
