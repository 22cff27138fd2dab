"""Review rows, audit rows and requests hold whole texts; only the export step cuts."""

from pyspark.sql import functions as F

from attesta.operators import fields as fi
from attesta.operators import requests as rq
from attesta.operators import reviews as rv

PROPOSALS = ("account_id string, attribute string, target_field string, pos int, current_value string, "
             "proposed_value string, action string, confidence double, grounding string, reason string")


def test_write_back_gets_the_whole_value(spark):
    old, new, why = "Old " + "x" * 300, "Unit 5 " + "y" * 400, "because " + "z" * 3000
    proposals = spark.createDataFrame([("a", "address", "Owner_Name", 1, old, new, "CORRECT", 0.9, "EXACT", why)], PROPOSALS)
    evidence = spark.createDataFrame([("a", "address", "e" * 2500)], "account_id string, attribute string, evidence string")
    rows = rv.build_review_rows(proposals, evidence)
    accounts = spark.createDataFrame([("a", old)], "account_id string, Owner_Name string")
    decided = rows.withColumns({"decision": F.lit("Approve"), "edited_value": F.lit(None).cast("string")})
    out = rv.apply_rows(decided, accounts).first()
    assert (out["outcome"], out["value"], out["current_value"]) == ("APPLIED", new, old)
    assert out["evidence"] == "e" * 2500 + "\n" + why
    cut = rv.for_record(rows, 255, 2000).first()
    assert cut["proposed_value"] == new[:254] + "…" and cut["evidence"] == "e" * 1999 + "…"
    assert rv.for_record(rows).first() == rows.first()


def test_audit_details_and_reasons_are_whole(spark):
    outcomes = spark.createDataFrame(
        [("j", "a", "Email", "Approve", "o", "v", "FAILED", "d" * 1500, 1)],
        "job_id string, account_id string, target_field string, decision string, current_value string, value string, "
        "outcome string, detail string, created_at int")
    assert rv.record_updates(outcomes).first()["detail"] == "d" * 1500
    accounts = spark.createDataFrame([("1", True, "r" * 900)], "account_id string, DV_Requested boolean, DV_Request_Reason string")
    assert rq.flagged_accounts(accounts).first()["reason"] == "r" * 900


def test_legibility_notes_are_whole(spark):
    docs = spark.createDataFrame([("s", "n" * 700)], "sha256 string, legibility_notes string")
    item = "struct<code:string,message:string,field:string,severity:string>"
    none = spark.createDataFrame([], "sha256 string, pos int, code string, message string, field string, severity string, "
                                     f"scope string, spec_pos int, issue {item}, validity_issues array<{item}>")
    out = fi.document_issues(["sha256"], none, none, none, none, docs).first()
    assert [i["message"] for i in out["issues"]] == ["n" * 700]
