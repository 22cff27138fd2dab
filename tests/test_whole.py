"""Nothing is cut, dropped or keyed by a prefix."""

from datetime import datetime

from pyspark.sql import functions as F

from attesta.operators import alerts as al
from attesta.operators import facts as fa
from attesta.operators import fields as fi
from attesta.operators import reviews as rv
from attesta.sources import model_outputs as mo
from attesta.streaming import streams as st

NOW = datetime(2026, 1, 1)
FACT = ("account_id string, attribute string, rank int, doc_pos int, seq int, value string, doc_id string, "
        "file_name string, document_type string, source_field string, grounding string, confidence double, "
        "normalized string")


def fact(account, doc, value, attribute="tin", rank=0, seq=0):
    return (account, attribute, rank, int(doc[1:]), seq, value, doc, f"{doc}.pdf", "BIR_2303", attribute, "EXACT", 0.95, value)


def test_refs_that_share_300_characters_are_two_notices(spark):
    events = spark.createDataFrame([("k", "r" * 300 + "a", NOW), ("k", "r" * 300 + "b", NOW), ("k", "r" * 300 + "b", NOW)],
                                   "kind string, ref string, created_at timestamp")
    ledger = spark.createDataFrame([("k", "r" * 300)], "kind string, ref string")
    assert {r["ref"][-1] for r in al.once_only(events, ledger).collect()} == {"a", "b"}


def test_two_numbers_in_one_document_are_no_conflict(spark):
    rows = [fact("a", "d1", "123-456-789-000"), fact("a", "d1", "987-654-321-000", seq=1), fact("a", "d2", "none"),
            fact("b", "d1", "123-456-789-000"), fact("b", "d2", "987-654-321-000"),
            fact("c", "d1", "123-456-789-000"), fact("c", "d2", "123-456-789-000"), fact("c", "d1", "987-654-321-000", seq=1)]
    got = {r["account_id"]: r["status"] for r in fa.cross_check(spark.createDataFrame(rows, FACT)).collect()}
    assert got["a"] == "CONSISTENT" and got["b"] == "CONFLICT" and got["c"] == "CONFLICT"


def test_a_value_on_page_six_is_found(spark):
    pages = spark.createDataFrame([("s", "v", p, f"page {p} " + ("number ABCD1234" if p == 6 else "nothing"), "GOOD") for p in range(1, 8)],
                                  "sha256 string, version string, page_number int, grounding_text string, quality_label string")
    fields = spark.createDataFrame([("s", "v", "ref", "text", "ABCD1234", None)],
                                   "sha256 string, version string, name string, kind string, value string, page int")
    assert [r["grounding"] for r in fi.ground_fields(fields, pages).collect()] == ["EXACT"]


def test_all_evidence_lines_and_items_are_kept(spark):
    facts = spark.createDataFrame([fact("a", f"d{k}", f"value {k}", seq=k) for k in range(1200)], FACT)
    assert rv.evidence_lines(facts).first()["evidence"].count("\n") == 1199
    items = spark.range(1).select(F.lit("s").alias("sha256"), F.lit("v").alias("version"), F.transform(
        F.sequence(F.lit(1), F.lit(200)), lambda k: F.struct(F.repeat(F.lit("l"), 200).alias("label"), F.repeat(
            F.lit("x"), 900).alias("value"), k.cast("long").alias("page"))).alias("other_fields"))
    got = mo.clean_other_fields(items)
    assert got.count() == 200 and got.agg(F.min(F.length("value")), F.min(F.length("label"))).first()[:] == (900, 200)


def test_a_new_checkpoint_keeps_the_ledger(spark, tmp_path):
    for run, refs in (("one", "xy"), ("two", "yz")):
        folder = str(tmp_path / f"in-{run}")
        spark.createDataFrame([("k", r, NOW) for r in refs], "kind string, ref string, created_at timestamp").write.parquet(folder)
        events = spark.readStream.schema("kind string, ref string, created_at timestamp").parquet(folder)
        st.write_once(events, str(tmp_path / "ledger"), str(tmp_path / run)).awaitTermination()
    assert sorted(r["ref"] for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == ["x", "y", "z"]
