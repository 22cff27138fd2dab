"""Streams against plain folds, and plan checks over the queries."""

import hashlib
import os
import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attesta.streaming import streams as st
from bindings.streams import drained

START = datetime(2026, 9, 1)


def as_stream(spark, tmp_path, df):
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def batches(spark, tmp_path, schema, parts):
    """A stream that reads each list of rows as one micro-batch, in turn."""
    base = tmp_path / "parts"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(base / f"p{k}"))
        for f in sorted((base / f"p{k}").glob("*.parquet")):
            stamp = 1_700_000_000 + k
            os.utime(f, (stamp, stamp))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet")
            .option("recursiveFileLookup", "true").parquet(str(base)))


def finished(spark, tmp_path, stream):
    """All rows of a stream that has read everything, and the rows left in its state."""
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    states = [p["stateOperators"] for p in q.recentProgress if p["stateOperators"]]
    return [r.asDict() for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()], states[-1][0]["numRowsTotal"]


END = ("zz", None, None, START + timedelta(days=400))      # moves the watermark past everything


def job_of(account, request):
    return hashlib.sha256(f"{account}|{request}".encode()).hexdigest()


def test_active_jobs_whatever_the_order_of_arrival(spark, tmp_path):
    """Requests and completions shuffled over six micro-batches, against a plain fold; state ends empty."""
    rng = random.Random(4)
    items = []
    for account in "abcdefgh":
        hour, active = 0, None
        for k in range(25):
            hour += rng.randint(1, 9)
            if rng.random() < 0.4 and active:
                items.append((account, None, active if rng.random() < 0.8 else "another", hour))
                active = None if items[-1][2] == active else active
            else:
                items.append((account, f"r{k:02d}", None, hour))
                active = active or job_of(account, f"r{k:02d}")
        if active:
            items.append((account, None, active, hour + 1))
    want, active = {}, {}
    for account, request, done, hour in sorted(items, key=lambda r: (r[0], r[3], r[1] is not None)):
        if request is None:
            active[account] = None if active.get(account) == done else active.get(account)
        else:
            created = not active.get(account)
            active[account] = active.get(account) or job_of(account, request)
            want[account, request] = (active[account], created)
    rng.shuffle(items)
    rows = [(a, r, d, START + timedelta(hours=h)) for a, r, d, h in items]
    schema = "account_id string, request_id string, job_id string, ts timestamp"
    s = batches(spark, tmp_path, schema, [*(rows[k::6] for k in range(6)), [END], [(*END[:3], END[3] + timedelta(1))]])
    out, left = finished(spark, tmp_path, st.stream_active_jobs(
        s.where("request_id is not null"), s.where("request_id is null").select("account_id", "job_id", "ts"), "30 days"))
    assert {(r["account_id"], r["request_id"]): (r["job_id"], r["created"]) for r in out} == want and len(out) == len(want)
    assert left == 2       # the rows of zz that still wait


def test_suppression_whatever_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(5)
    days = {(a, s): sorted(rng.sample(range(60), 14)) for a in "ab" for s in "st"} | {("c", "s"): [0, 3, 6, 8, 10, 16, 30]}
    want, rows = {}, []
    for (a, s), ds in days.items():
        raised = None
        for d in ds:
            want[a, s, f"j{d:02d}"] = raised is not None and d - raised <= 7
            raised = raised if want[a, s, f"j{d:02d}"] else d
            rows.append((a, f"j{d:02d}", s, START + timedelta(days=d)))
    assert [d for d in days["c", "s"] if not want["c", "s", f"j{d:02d}"]] == [0, 8, 16, 30]
    rng.shuffle(rows)
    schema = "account_id string, job_id string, signature string, created_at timestamp"
    s = batches(spark, tmp_path, schema, [*(rows[k::5] for k in range(5)), [END], [(*END[:3], END[3] + timedelta(1))]])
    out, left = finished(spark, tmp_path, st.stream_suppress_alerts(s, 7, "70 days"))
    assert {(r["account_id"], r["signature"], r["job_id"]): r["repeat"] for r in out} == want and len(out) == len(want)
    assert left == 2


def test_late_rows_are_dropped_and_answers_stay(spark, tmp_path):
    at = lambda d: START + timedelta(days=d)
    schema = "account_id string, job_id string, signature string, created_at timestamp"
    s = batches(spark, tmp_path, schema, [[("a", "j2", "s", at(2))], [("a", "j9", "s", at(20))], [("a", "j1", "s", at(1)), ("a", None, "s", None)],
                                          [("zz", None, None, at(99))], [("zz", None, None, at(100))]])
    out, _ = finished(spark, tmp_path, st.stream_suppress_alerts(s, 7, "1 day"))
    assert {r["job_id"]: r["repeat"] for r in out if r["account_id"] == "a"} == {"j2": False, "j9": False}


def test_reviews_are_forgotten_after_closing(spark, tmp_path):
    schema = "review_id string, kind string, row_id string, decision string, value string, reviewer string, status string, ts timestamp"
    at = lambda h: START + timedelta(hours=h)
    rows = [("v", "decision", "0", "Approve", None, "Lia", None, at(0)), ("v", "opened", None, None, None, None, None, at(1)),
            ("v", "decision", "1", "Edit", " x ", "Lia", None, at(2)), ("v", "decision", "2", "Edit", "", "Max", None, at(3)),
            ("v", "decision", "3", "Maybe", None, "Max", None, at(4)), ("v", "closed", None, None, None, None, "Applied", at(5)),
            ("v", "decision", "4", "Approve", None, "Max", None, at(6)), ("v", "decision", "5", "Approve", None, "Max", None, at(24 * 9))]
    end = [("zz", "opened", None, None, None, None, None, at(24 * k)) for k in (300, 301)]
    s = batches(spark, tmp_path, schema, [rows[::-2], rows[-2::-2], end[:1], end[1:]])
    out, left = finished(spark, tmp_path, st.stream_fold_decisions(s, "20 days", keep_days=3))
    got = {r["row_id"]: (r["problem"], r["status"], r["reviewer"], r["edited_value"]) for r in out}
    assert got == {"0": ("Review not found", None, None, None), "1": (None, "In Review", "Lia", "x"),
                   "2": ("Edit needs the corrected value", "In Review", "Lia", None),
                   "3": ("Decision must be one of Pending, Approve, Edit, Reject", "In Review", "Lia", None),
                   "4": ("Review is Applied; it can no longer change", "Applied", "Lia", None),
                   "5": ("Review not found", None, None, None)}
    assert left == 2       # the two rows of zz that still wait


def test_expiry_timers(spark, tmp_path, rows):
    docs = [("a", "2026-10-15", 0), ("b", "2026-09-01", 0), ("c", "2027-09-01", 0), ("a", "2026-10-15", 5), ("d", "no date", 1),
            ("e", "2026-10-15", 2), ("e", "2026-12-24", 20)]
    ticks = [(None, None, d) for d in range(0, 130)]
    schema = "account_id string, valid_until string, at timestamp"
    parts = [[(a, u, START + timedelta(days=d)) for a, u, d in x] for x in (docs, ticks[:40], ticks[40:80], ticks[80:], [(None, None, 131)])]
    s = batches(spark, tmp_path, schema, parts)
    out, left = finished(spark, tmp_path, st.stream_expiry(
        s.where("account_id is not null").withColumn("document_type", F.lit("P")),
        s.where("account_id is null").select("at"), watermark="30 days"))
    got = sorted((r["account_id"], r["valid_until"][5:], r["level"]) for r in out)
    # a's repeated row changes nothing; e is renewed after its first reminder; the watermark ends on day 101
    assert got == sorted([("a", "10-15", "30 days"), ("a", "10-15", "7 days"), ("a", "10-15", "today"), ("a", "10-15", "expired"),
                          ("b", "09-01", "today"), ("b", "09-01", "expired"), ("e", "10-15", "30 days"), ("e", "12-24", "30 days")])
    assert left > 0        # c is not due yet


def test_ledger_write_is_idempotent(spark, tmp_path, rows):
    df = spark.createDataFrame([("k", "x", START), ("k", "x", START), ("k", "y", START)],
                               "kind string, ref string, created_at timestamp")
    s = as_stream(spark, tmp_path, df)
    for run in ("one", "two"):      # the same batch run again writes its folder again
        st.write_once(s, str(tmp_path / "ledger"), str(tmp_path / run)).awaitTermination()
        got = rows(spark.read.parquet(str(tmp_path / "ledger")))
        assert sorted(r["ref"] for r in got) == ["x", "y"]


ROOT = Path(__file__).resolve().parent.parent


def test_library_never_collects():
    for path in (ROOT / "attesta").rglob("*.py"):
        text = path.read_text(encoding="utf-8")
        assert not re.search(r"\.(collect|toPandas|toLocalIterator|rdd|localCheckpoint|crossJoin)\b",
                             text), path


@pytest.mark.parametrize("name", ["classify", "duplicates", "facts_cross_check", "requirements",
                                  "plan", "suppress", "fold_decisions", "recommend"])
def test_plans_have_no_pair_products(spark, name):
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name == "classify":
        assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string" in plan


def test_results_do_not_depend_on_partitions(spark, rows):
    import __spark_entry__ as entry
    names, seen = ["best_value", "duplicates", "facts_cross_check"], {}
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for name in names:
            df = entry.queries()[name](spark, "/root/testdata/sf0.001")
            got = sorted(map(str, rows(df)))
            assert seen.setdefault(name, got) == got
    spark.conf.set("spark.sql.shuffle.partitions", "4")
