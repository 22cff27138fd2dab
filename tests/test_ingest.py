"""Sources, dedupe, reading, form cells, fields."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t
from attesta.operators import cells as ce
from attesta.operators import dedupe as dd
from attesta.operators import fields as fi
from attesta.operators import reading as rd
from attesta.plans import verify
from attesta.sources import accounts as acc
from attesta.sources import files as fl
from attesta.sources import logs
from attesta.sources import model_outputs as mo

TODAY = date(2026, 10, 1)


def office(folder):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(f"{folder}/x.xml", "x")
    return data.getvalue()


def test_scan_and_check_files(spark, rows, tmp_path):
    items = {"a.pdf": b"%PDF-1.7 x", "b.png": b"\x89PNG\r\n\x1a\nx", "empty.pdf": b"",
             "big.pdf": b"%PDF" + b"x" * 5000, "c.xlsx": office("xl"), "d.docx": office("word"),
             "e.zip": office("other"), "f.doc": bytes.fromhex("D0CF11E0A1B11AE1") + b"x",
             "g.txt": b"plain", "h.bin": bytes.fromhex("D0CF11E0A1B11AE1"),
             "i.heic": b"\x00\x00\x00\x18ftypheicxxxx", "j.jpeg": b"\xff\xd8\xff\xe0x",
             "k.zip": b"PK\x03\x04broken"}
    for name, data in items.items():
        (tmp_path / name).write_bytes(data)
    files = fl.scan_files(spark, str(tmp_path))
    held = {r["file_name"]: (r["size"], bytes(r["content"])) for r in rows(files)}
    assert held == {name: (len(data), data) for name, data in items.items()}       # the empty file as well
    got = {r["file_name"]: r for r in rows(fl.check_files(files, 3000))}
    assert {n: r["extension"] for n, r in got.items() if r["ok"]} == {
        "a.pdf": "pdf", "b.png": "png", "c.xlsx": "xlsx", "d.docx": "docx", "f.doc": "doc",
        "i.heic": "heic", "j.jpeg": "jpg"}
    assert got["empty.pdf"]["reason"] == "File is empty"
    assert got["big.pdf"]["reason"] == "File is 5004 bytes; limit is 3000"
    assert got["e.zip"]["reason"] == "Unsupported file type (detected=zip, name='e.zip')"
    assert got["g.txt"]["reason"] == "Unsupported file type (detected=unknown, name='g.txt')"
    assert got["c.xlsx"]["mime_type"] == rules.FILE_TYPES["xlsx"]


def test_source_refs_contacts_snapshot(spark, rows):
    accounts = spark.createDataFrame(
        [("a", [("1", None, "p.pdf"), (None, None, "none")], None)],
        "account_id string, Business_Permit array<struct<attachment_Id:string,File_Id__s:string,"
        "File_Name__s:string>>, BIR_Registration_COR array<struct<attachment_Id:string,"
        "File_Id__s:string,File_Name__s:string>>")
    attachments = spark.createDataFrame(
        [("a", "9", "x.pdf", None, ("Lia", None))],
        "account_id string, id string, File_Name string, Created_Time timestamp, "
        "Created_By struct<name:string,email:string>")
    notes = spark.createDataFrame(
        [("a", "n1", [("5", "y.pdf", None)]), ("a", "n2", None)],
        "account_id string, id string, attachments array<struct<id:string,File_Name:string,"
        "Created_Time:timestamp>>")
    got = rows(acc.discover_source_refs(accounts, attachments, notes, [
        "Business_Permit", "BIR_Registration_COR"]), "source")
    assert [(r["source"], r["source_field"], r["parent_id"], r["file_ref"], r["uploaded_by"])
            for r in got] == [("ATTACHMENT", None, None, "9", "Lia"),
                              ("FILE_FIELD", "Business_Permit", None, "1", None),
                              ("NOTE_ATTACHMENT", None, "n1", "5", None)]
    people = spark.createDataFrame(
        [("a", "1", None, "Ana", "Reyes", "true", ["Accounting", "Sales"], ""),
         ("a", "2", "Ben Cruz", "x", "y", None, None, "Head")],
        "account_id string, id string, Full_Name string, First_Name string, Last_Name string, "
        "Account_Primary_Contact string, Contact_of array<string>, Department string")
    got = rows(acc.summarise_contacts(people), "id")
    assert [(r["name"], r["primary"], r["roles"]) for r in got] == [
        ("Ana Reyes", True, {"Contact_of": "Accounting, Sales"}),
        ("Ben Cruz", False, {"Department": "Head"})]
    snap = acc.snapshot_accounts(accounts)
    assert set(snap.columns) == {"account_id", *rules.SNAPSHOT_FIELDS}


def test_logs(spark, rows, tmp_path):
    frame = spark.createDataFrame([("a", None, 0.9)], "account_id string, old_value string, "
                                                      "confidence double")
    audit = logs.audit_events(spark.createDataFrame([("j", 3, "now")], "job_id string, n int, "
                                                    "created_at string"),
                              "READING_FINISHED", F.lit("3 files"), ["n"])
    for _ in "ab":
        where = logs.write_logs({"Field Updates": frame, "Audit": audit}, str(tmp_path),
                                "2026-10-01")
    back = rows(spark.read.parquet(where["Field Updates"]))
    assert len(back) == 2 and back[0]["old_value"] == "" and back[0]["confidence"] == "0.9"
    assert rows(spark.read.parquet(where["Audit"]))[0]["payload"] == '{"n":3}'


def test_odd_file_names_and_empty_files(spark, rows, tmp_path):
    items = {"a b.txt": b"x", "ü+%20.txt": b"y", "empty one.txt": b"", "e+2.txt": b"", "other.bin": b""}
    (tmp_path / "deep er").mkdir()
    for name, data in items.items():
        (tmp_path / "deep er" / name).write_bytes(data)
    got = rows(fl.scan_files(spark, str(tmp_path), "*.txt"))
    assert sorted((r["size"], bytes(r["content"])) for r in got) == [(0, b""), (0, b""), (1, b"x"), (1, b"y")]


def test_a_run_of_the_logs_shows_whole_and_once(spark, rows, tmp_path):
    frames = lambda n: {"Field Updates": spark.range(n).select(F.col("id").cast("string").alias("account_id")),
                        "Activations": spark.range(2).select(F.col("id").cast("string").alias("account_id"))}
    for n, day, run in ((5, "2026-10-01", "one"), (3, "2026-10-01", "one"), (4, "2026-10-02", "two")):
        logs.write_logs(frames(n), str(tmp_path), day, run)
    # a run that broke off before it was listed
    logs.log_rows(frames(7)["Field Updates"], "Field Updates").write.parquet(str(tmp_path / "field_updates/log_date=2026-10-03/run=three"))
    got = logs.read_logs(spark, str(tmp_path), "Field Updates").groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in got} == {"one": 3, "two": 4}
    assert logs.read_logs(spark, str(tmp_path), "Activations").count() == 4


def test_duplicates_with_one_hot_content(spark, rows):
    docs = spark.range(3000).select(
        F.lit("j").alias("job_id"), F.col("id").alias("doc_id"), (-F.col("id")).alias("pos"),
        F.concat(F.lit("f"), "id").alias("file_name"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("content"))
    got = rows(dd.mark_duplicates(docs), "doc_id")
    assert sum(r["status"] == "DUPLICATE" for r in got) == 999
    assert {r["duplicate_of"] for r in got if r["status"] == "DUPLICATE"} == {2997}
    assert got[0]["status_detail"] == "Same content as f2997"


def test_contents_work_and_purge(spark, rows):
    docs = spark.createDataFrame(
        [("j1", "d1", "aa1", 5), ("j1", "d2", "bb2", 6), ("j2", "d3", "bb2", 6),
         ("j3", "d4", "aa1", 5), ("j1", "d5", None, 0)],
        "job_id string, doc_id string, sha256 string, size int").withColumns(
        {"mime_type": F.lit("m"), "extension": F.lit("pdf")})
    held = spark.createDataFrame([("aa1",)], "sha256 string")
    assert rows(dd.new_contents(docs, held)) == [
        {"sha256": "bb2", "size": 6, "mime_type": "m", "extension": "pdf",
         "storage_key": "originals/bb/bb2.pdf"}]
    done = spark.createDataFrame([("aa1", "v1", "FAILED"), ("bb2", "v0", "EXTRACTED")],
                                 "sha256 string, version string, status string")
    work = docs.select("sha256").dropna().distinct()
    assert [r["sha256"] for r in rows(dd.pending_work(work, done, "v1"))] == ["bb2"]
    assert len(rows(dd.pending_work(work, done, "v1", "EXTRACTED"))) == 2
    jobs = spark.createDataFrame([("j1", "ASSESSED"), ("j2", "READING"), ("j3", "READ")],
                                 "job_id string, status string")
    finished = jobs.where("job_id = 'j1'")
    got = {r["sha256"]: r["purge"] for r in rows(dd.purgeable_contents(docs, jobs, finished))}
    assert got == {"aa1": True, "bb2": False}          # READ is not an active status
    assert rows(dd.purge_summary(dd.purgeable_contents(docs, jobs, finished))) == [
        {"job_id": "j1", "files_deleted": 1, "kept_for_other_jobs": 1}]
    files = spark.createDataFrame([("/s/attachment_9_BIR 2303 - X.png",), ("/s/b/BIR_2303_-_X.png",),
                                   ("/s/manifest.json",)], "path string")
    gold = spark.createDataFrame([("BIR_2303_-_X.png",), ("other.png",)], "file_name string")
    assert [r["matched_path"] for r in rows(dd.match_by_canonical_name(files, gold), "file_name")
            ] == ["/s/attachment_9_BIR 2303 - X.png", None]


def test_page_text_and_best_reading(spark, rows):
    words = spark.createDataFrame(
        [("s", 1, "ocr", 1, 1, 2, 2, "World", 80.0), ("s", 1, "ocr", 1, 1, 2, 1, "Hello", 90.0),
         ("s", 1, "ocr", 1, 1, 1, 1, " Top ", 70.0), ("s", 1, "ocr", 1, 1, 1, 2, " ", 99.0),
         ("s", 1, "ocr", 1, 1, 1, 3, "bad", -1.0), ("s", 1, "ink", 1, 1, 1, 1, "Ink", 75.0),
         ("s", 2, "ocr", 1, 1, 1, 1, "", -1.0)],
        "sha256 string, page_number int, pass string, block int, par int, line int, pos int, "
        "text string, conf double")
    pages = rd.assemble_page_text(words)
    got = {(r["page_number"], r["pass"]): r for r in rows(pages)}
    assert got[1, "ocr"]["text"] == "Top\nHello World" and got[1, "ocr"]["mean_conf"] == 80.0
    assert (got[2, "ocr"]["text"], got[2, "ocr"]["mean_conf"]) == ("", 0.0)
    best = {r["page_number"]: r for r in rows(rd.choose_best_reading(pages))}
    assert best[1]["text_method"] == "ocr+ink" and best[1]["text"] == "Top\nHello World"
    assert best[1]["grounding_text"] == "Top\nHello World\nInk"
    assert best[2]["text_method"] == "ocr"


CLASSES = [
    ("CERTIFICATE OF REGISTRATION\nTIN Branch Code ... BIR Form 2303", None, "BIR_2303"),
    ("certificateofregistration nameoftaxpayer", None, "BIR_2303"),
    ("Certificate of Business Name Registration  Act 3883", None, "DTI_BN_CERT"),
    ("OFFICE OF THE CITY MAYOR  MAYOR'S PERMIT  Line of Business", None, "MAYORS_PERMIT"),
    ("Securities and Exchange Commission", None, "SEC_CERT"),
    ("GENERAL INFORMATION SHEET", None, "GIS"), ("Republic: Driver's License", None,
                                                "GOVERNMENT_ID"),
    ("some text", "BIR_2303.png", "OTHER"), ("", None, "OTHER"),
    ("BIR FORM", "2303_scan.pdf", "BIR_2303"), ("BIR FORM", "x2303y.pdf", "OTHER")]


def test_classification(spark, rows):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CLASSES)],
                               "i int, text string, file_name string, want string")
    got = rows(rd.classify_documents(df), "i")
    for r in got:
        assert r["document_type"] == r["want"], r
    assert got[7]["type_confidence"] == 0.0 and got[7]["type_signals"] == []
    assert got[9]["type_signals"] == ["BIR FORM", "file name: 2303_SCAN.PDF"]
    # 4 for the SEC certificate alone: 0.4 * 1 * 2
    assert got[4]["type_confidence"] == 0.8


def test_quality_routing_limits(spark, rows):
    pages = spark.createDataFrame(
        [("s", "v", 1, 95.0, 400.0, 2400, 200, False, "x" * 90, "A", .9),
         ("s", "v", 2, 60.0, 50.0, 900, 30, False, "y", "B", .8),
         ("s", "v", 3, 30.0, 100.0, 1200, 5, False, "z", "C", .7),
         ("s", "v", 4, 0.0, 0.0, 10, 0, True, "w" * 80, "D", .6)],
        "sha256 string, version string, page_number int, ocr_conf double, sharpness double, "
        "resolution int, word_count int, text_layer boolean, text string, document_type string, "
        "type_confidence double")
    got = rows(rd.score_page_quality(pages), "page_number")
    assert [(r["quality_label"], r["quality_score"]) for r in got] == [
        ("GOOD", 1.0), ("POOR", 0.35), ("UNREADABLE", 0.17), ("GOOD", 1.0)]
    assert got[1]["quality_reasons"] == ["low resolution (900px long side)", "blurry"]
    assert got[3]["quality_reasons"] == ["digital PDF text layer"]
    scored = rd.score_page_quality(pages)
    assert rd.readable_pages(scored).count() == 3
    assert rows(rd.rollup_readings(scored))[0]["document_type"] == "A"
    assert [r["source"] for r in rows(rd.route_pages(pages), "page_number")] == [
        "pdf_text", "pdf_scan", "pdf_scan", "pdf_text"]
    assert [r["page_number"] for r in rows(rd.limit_pages(pages, 2), "page_number")] == [1, 2]
    weak = rd.flag_second_pass(pages.withColumn("mean_conf", F.col("ocr_conf")))
    assert [r["second_passes"] for r in rows(weak, "page_number")] == [
        ["ink", "adaptive"]] * 3


def test_form_cells(spark, rows):
    cells = spark.createDataFrame(
        [("w", "S", 1, 2, "CUSTOMER INFORMATION SHEET", True),
         ("w", "S", 3, 2, "TIN (incl. Branch Code)*:", True), ("w", "S", 3, 3, "234-567-890", True),
         ("w", "S", 3, 5, "Mobile / Landline (multiple)", True), ("w", "S", 3, 6, "9171234567", False),
         ("w", "S", 4, 2, "Favourite  colour", True), ("w", "S", 4, 3, "blue", True),
         ("w", "S", 5, 2, "Lonely", True), ("w", "S", 5, 4, "x", True),
         *[("w", "S", 7, c, f"h{c}", True) for c in range(2, 7)],
         ("w", "T", 1, 2, "Email Address", True), ("w", "T", 1, 3, "A@B.ph", True),
         ("w", "T", 2, 2, "Email Address", True), ("w", "T", 2, 3, "c@d.ph", True)],
        "workbook string, sheet string, row int, col int, value string, is_text boolean")
    assert rows(ce.find_form_sheets(cells)) == [{"workbook": "w"}]
    pairs = ce.label_value_pairs(cells)
    assert {(r["label"], r["value"], r["cell"]) for r in rows(pairs)} == {
        ("TIN (incl. Branch Code)*:", "234-567-890", "C3"),
        ("Mobile / Landline (multiple)", "9171234567", "F3"), ("Favourite colour", "blue", "C4"),
        ("Email Address", "A@B.ph", "C1"), ("Email Address", "c@d.ph", "C2")}
    fields, others = ce.map_labels(pairs)
    got = {r["name"]: r for r in rows(fields)}
    assert got["tin"]["normalized"] == "234-567-890-00000"
    assert got["phone"]["value"] == "09171234567" and got["email"]["value"] == "c@d.ph"
    assert got["tin"]["evidence"] == "TIN (incl. Branch Code)*: (S!C3)"
    assert [r["label"] for r in rows(others)] == ["Favourite colour"]


GROUND = [("text", "RIZAL STREET", 1, "EXACT"), ("date", "June 30, 2028", 1, "EXACT"),
          ("name", "GABRIELLA SANTOS", 1, "FUZZY"), ("tin", "234-567-891", 1, "CONFLICT"),
          ("text", "ABSENT VALUE HERE", 1, "NOT_FOUND"), ("code", "99", 1, "NOT_FOUND"),
          ("choice", "Branch", 1, "UNVERIFIABLE"), ("text", None, 1, None),
          ("text", "SECOND PAGE TEXT", 1, "EXACT"), ("text", "SECOND PAGE TEXT", None, "EXACT"),
          ("address", "BLOCK 21 SAMPAGUITA", 1, "CONFLICT"), ("text", "RIZAL STREET", 9, "EXACT")]


def test_grounding_confidence_issues(spark, rows):
    pages = spark.createDataFrame(
        [("s", "v", 1, "12 Rizal Street  valid 30 June 2028 GABRIELA SANTOS TIN 234-567-890 "
                       "Block 23 Sampaguita", "GOOD"),
         ("s", "v", 2, "second page text", "POOR")],
        "sha256 string, version string, page_number int, grounding_text string, "
        "quality_label string")
    fields = spark.createDataFrame(
        [("s", "v", i, f"f{i}", k, v, p, True, None) for i, (k, v, p, _) in enumerate(GROUND)],
        "sha256 string, version string, spec_pos int, name string, kind string, value string, "
        "page int, required boolean, pattern string")
    grounded = fi.ground_fields(fi.normalize_fields(fields), pages)
    got = rows(fi.score_confidence(grounded), "spec_pos")
    for r, (*_, want) in zip(got, GROUND, strict=True):
        assert r["grounding"] == want, r
    assert got[1]["ocr_match"] == "30 June 2028" and got[0]["confidence"] == 0.95
    assert got[2]["confidence"] == 0.8 and got[2]["ocr_match"] == "GABRIELASANTOS"
    assert got[9]["confidence"] == 0.71            # no page stated: the worst page's quality
    assert got[11]["confidence"] == 0.71 and got[7]["confidence"] is None
    codes = {(r["field"], r["code"]) for r in rows(fi.field_issues(
        fi.score_confidence(grounded)))}
    assert {("f7", "MISSING_REQUIRED"), ("f3", "OCR_CONFLICT"), ("f4", "NOT_IN_OCR_TEXT"),
            ("f6", "CHECKBOX_NOT_VERIFIED")} <= codes


VALID = [
    ("DTI_BN_CERT", {"valid_from": "2023-06-30", "valid_to": "2028-06-29"}, "VALID", []),
    ("DTI_BN_CERT", {"valid_from": "2023-06-30", "valid_to": "2027-06-29"}, "VALID",
     ["UNUSUAL_VALIDITY_PERIOD"]),
    ("MAYORS_PERMIT", {"printed_until": "2025-12-31"}, "EXPIRED", ["EXPIRED"]),
    ("MAYORS_PERMIT", {"permit_year": "2026"}, "NO_EXPIRY", ["NO_EXPIRY_PRINTED"]),
    ("MAYORS_PERMIT", {"date_issued": "2026-12-01", "printed_until": "2027-12-31"},
     "NOT_YET_VALID", ["NOT_YET_VALID"]),
    ("GOVERNMENT_ID", {"id_type": "BIR TIN ID"}, "NO_EXPIRY", []),
    ("GOVERNMENT_ID", {"expiry_date": "2030-01-01"}, "VALID", []),
    ("BIR_2303", {"tin": "x"}, "VALID", []), ("BIR_2303", {}, "UNKNOWN", []),
    ("OTHER", {}, "UNKNOWN", []), (None, {}, "UNKNOWN", [])]


def test_validity(spark, rows):
    cols = list(fi.VALIDITY_FIELDS.values())
    df = spark.createDataFrame([(i, k, *[v.get(c) for c in cols]) for i, (k, v, *_) in
                                enumerate(VALID)], "i int, document_type string, " + ", ".join(
        f"{c} string" for c in cols))
    for r, (_, _, status, codes) in zip(rows(fi.check_validity(df, TODAY), "i"), VALID,
                                        strict=True):
        assert (r["validity_status"], [x["code"] for x in r["validity_issues"]]) == (status, codes)
    rule = {"MAYORS_PERMIT": "DEC_31_OF_ISSUE_YEAR"}
    r = rows(fi.check_validity(df, TODAY, rule), "i")[3]
    assert r["valid_until"] == date(2026, 12, 31) and r["validity_status"] == "VALID"
    assert r["validity_issues"][0]["message"] == (
        "No expiry printed; valid until 2026-12-31 (Dec 31 of the permit year, rule book)")


def test_extraction_from_model_output(spark, rows):
    reg = ('{"document_type": "BIR_2303", "fields": {"tin": {"value": "234-567-890-00012", "page": 1},'
           '"registering_office": {"value": "Head Office", "page": 1}, "ocn": {"value": '
           '"041RC20250000001234", "page": 1.5}, "rdo_code": {"value": "56", "page": null},'
           '"taxpayer_name": {"value": "  ", "page": 1}}, "other_fields": [{"label": "Tel",'
           '"value": "8123", "page": 1}], "legibility_notes": "stamp"}')
    outputs = spark.createDataFrame([("s", "v", "MAYORS_PERMIT", reg)],
                                    "sha256 string, version string, expected_type string, "
                                    "json string")
    pages = spark.createDataFrame([("s", "v", 1, "TIN 234 567 890 00012 OCN 041RC20250000001234",
                                    "FAIR")], "sha256 string, version string, page_number int, "
                                              "grounding_text string, quality_label string")
    out = verify.extract(outputs, pages, TODAY)
    f = {r["name"]: r for r in rows(out["fields"])}
    assert len(f) == len(rules.FIELD_SPECS["BIR_2303"]) and f["taxpayer_name"]["value"] is None
    assert f["tin"]["confidence"] == 0.85 and f["ocn"]["page"] is None
    assert (f["registering_office"]["grounding"], f["registering_office"]["confidence"]) == (
        "CONFLICT", 0.2)
    doc = rows(out["documents"])[0]
    assert doc["validity_status"] == "VALID"
    assert [i["code"] for i in doc["issues"]] == [
        "TYPE_MISMATCH", "BRANCH_MISMATCH", "OCN_RDO_MISMATCH", *["MISSING_REQUIRED"] * 3,
        "LEGIBILITY_NOTE"]
    assert rows(out["other_fields"])[0]["value"] == "8123"


def test_revalidate_keeps_other_issues(spark, rows):
    df = spark.createDataFrame(
        [("DTI_BN_CERT", "2026-01-01", "VALID", None), ("SEC_CERT", None, "UNKNOWN", None)],
        "document_type string, valid_to string, validity_status string, valid_until date"
    ).withColumn("issues", F.array(t.issue("NO_EXPIRY_PRINTED", "x"), t.issue("KEPT", "y")))
    got = rows(fi.revalidate(df, TODAY), "document_type")
    assert [i["code"] for i in got[0]["issues"]] == ["KEPT", "EXPIRED"]
    assert got[0]["validity_status"] == "EXPIRED"
    assert [i["code"] for i in got[1]["issues"]] == ["NO_EXPIRY_PRINTED", "KEPT"]


@pytest.mark.parametrize("n, want", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (703, "AAA")])
def test_column_letters(spark, n, want):
    assert spark.range(1).select(ce._letters(F.lit(n))).first()[0] == want
