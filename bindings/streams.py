"""The streaming operators over the events table, each run to the end of what is there."""

import uuid

from pyspark.sql import functions as F

from attesta.session import checkpoint_ready
from attesta.streaming import streams as st
from bindings import ORACLES, QUERIES, table


def source(spark, sf_dir):
    """The events table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))


def drained(spark, stream):
    """Run a stream over all files that are there; its output as a table in the shared folder."""
    checkpoint_ready(spark, required=True)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _account(df):
    return df.withColumn("account_id", F.col("user_id").cast("string"))


def active_jobs(spark, sf_dir):
    """Signups and purchases ask for a job; a job ends two days after the request that made it."""
    events = _account(source(spark, sf_dir)).where(F.col("event_type").isin("signup", "purchase"))
    requests = events.select("account_id", F.format_string("%020d", "event_id").alias("request_id"), "ts")
    done = requests.select("account_id", F.sha2(F.concat_ws("|", "account_id", "request_id"), 256).alias("job_id"),
                           (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    return drained(spark, st.stream_active_jobs(requests, done, "0 seconds")).select(
        F.col("request_id").cast("long").alias("request_id"), "job_id", "created")


QUERIES["stream_active_jobs"] = active_jobs
# jobs by recursion: the first request of a user, then the first one two days or more after a job's first
ORACLES["stream_active_jobs"] = """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms FROM events
        WHERE event_type IN ('signup', 'purchase')),
    j AS (SELECT user_id, min(ms) AS ms FROM e GROUP BY user_id
        UNION ALL SELECT j.user_id, (SELECT min(e.ms) FROM e WHERE e.user_id = j.user_id AND
            e.ms >= j.ms + 172800000) FROM j WHERE j.ms IS NOT NULL),
    f AS (SELECT e.user_id, e.ms, min(event_id) AS f FROM e JOIN j USING (user_id, ms) GROUP BY ALL),
    g AS (SELECT e.*, max(f.ms) AS job_ms FROM e JOIN f ON f.user_id = e.user_id AND f.ms <= e.ms GROUP BY ALL)
    SELECT event_id AS request_id, sha256(g.user_id || '|' || lpad(cast(f AS string), 20, '0')) AS job_id,
        event_id = f AS created FROM g JOIN f ON f.user_id = g.user_id AND f.ms = g.job_ms"""


def suppress(spark, sf_dir):
    """Every event is an alert run of its user; its type is the signature."""
    events = _account(source(spark, sf_dir))
    alerts = events.select("account_id", F.format_string("%020d", "event_id").alias("job_id"),
                           F.col("event_type").alias("signature"), F.col("ts").alias("created_at"))
    return drained(spark, st.stream_suppress_alerts(alerts, 7, "0 seconds")).select(
        F.col("job_id").cast("long").alias("job_id"), "signature", "repeat")


QUERIES["stream_suppress"] = suppress
# raised runs by recursion: the first run of a user's signature, then the first one more than 7 days later
ORACLES["stream_suppress"] = """
    WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_ms(ts) AS ms FROM events),
    raised AS (SELECT user_id, event_type, min(ms) AS ms FROM e GROUP BY ALL
        UNION ALL SELECT user_id, event_type, (SELECT min(e.ms) FROM e WHERE e.user_id = r.user_id AND
            e.event_type = r.event_type AND e.ms - r.ms > 604800000) FROM raised r WHERE r.ms IS NOT NULL),
    f AS (SELECT user_id, event_type, ms, min(event_id) AS event_id FROM e JOIN raised USING (user_id, event_type, ms)
        GROUP BY ALL)
    SELECT e.event_id AS job_id, event_type AS signature, f.event_id IS NULL AS "repeat"
    FROM e LEFT JOIN f USING (user_id, event_type, ms, event_id)"""


def once(spark, sf_dir):
    notices = source(spark, sf_dir).select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("ref"),
        F.col("ts").alias("created_at"))
    return drained(spark, st.stream_once(notices)).select("kind", "ref")


QUERIES["stream_once"] = once
ORACLES["stream_once"] = ("SELECT DISTINCT event_type AS kind, cast(user_id AS string) AS ref "
                          "FROM events")


def ledger(spark, sf_dir):
    """Notices once for all time: the stream is run, and then started anew with nothing left to add."""
    checkpoint_ready(spark, required=True)
    base = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    notices = source(spark, sf_dir).select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("ref"), F.col("ts").alias("created_at"))
    for start in ("first", "second"):
        st.write_once(notices, f"{base}/ledger", f"{base}/{start}").awaitTermination()
    return spark.read.parquet(f"{base}/ledger").select("kind", "ref", "created_at")


QUERIES["stream_ledger"] = ledger
ORACLES["stream_ledger"] = ("SELECT event_type AS kind, cast(user_id AS string) AS ref, min(ts) AS created_at "
                            "FROM events GROUP BY ALL")


def audit_counts(spark, sf_dir):
    counts = st.stream_audit_counts(source(spark, sf_dir), at="ts")
    return drained(spark, counts).select(
        F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events")


QUERIES["stream_audit_counts"] = audit_counts
ORACLES["stream_audit_counts"] = """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS events
    FROM events GROUP BY ALL HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <=
        (SELECT max(ts) - INTERVAL 1 DAY FROM events)"""


def fold(spark, sf_dir):
    """A user is a review: a signup opens it, an error closes it, everything else decides."""
    events = source(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "opened").when(
        F.col("event_type") == "error", "closed").otherwise("decision")
    rows = events.select(
        F.col("user_id").cast("string").alias("review_id"), kind.alias("kind"),
        F.col("event_id").cast("string").alias("row_id"),
        F.when(F.col("event_type") == "click", "Approve").when(
            F.col("event_type") == "view", "Edit").otherwise("Maybe").alias("decision"),
        F.get_json_object("props", "$.k").alias("value"), F.lit("Lia").alias("reviewer"),
        F.when(F.col("event_type") == "error", "Rejected").alias("status"), "ts")
    return drained(spark, st.stream_fold_decisions(rows, "0 seconds")).select("row_id", "status", "problem")


QUERIES["stream_fold"] = fold
ORACLES["stream_fold"] = """
    WITH b AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS o FROM events GROUP BY user_id),
    c AS (SELECT e.user_id, min(ts) AS c FROM events e JOIN b USING (user_id) WHERE event_type = 'error' AND
          ts > o GROUP BY e.user_id),
    d AS (SELECT e.*, o, c, CASE WHEN o IS NULL OR ts < o THEN 'Review not found' WHEN c IS NOT NULL AND ts > c THEN
        'Review is Rejected; it can no longer change' WHEN event_type = 'purchase' THEN
        'Decision must be one of Pending, Approve, Edit, Reject' END AS problem
        FROM events e JOIN b USING (user_id) LEFT JOIN c USING (user_id)
        WHERE event_type NOT IN ('signup', 'error')),
    f AS (SELECT user_id, min(ts) AS f FROM d WHERE problem IS NULL GROUP BY user_id)
    SELECT cast(event_id AS string) AS row_id, CASE WHEN problem = 'Review not found' THEN NULL WHEN c IS NOT NULL AND
        ts > c THEN 'Rejected' WHEN f IS NOT NULL AND ts >= f THEN 'In Review' ELSE 'Pending Review' END AS status,
        problem FROM d LEFT JOIN f USING (user_id)"""


def expiry(spark, sf_dir):
    """A purchase gives its user a document valid for some days; every event is a clock tick."""
    events = source(spark, sf_dir)
    day = F.expr("cast(date_add(to_date(ts), cast(event_id % 40 as int)) as string)")
    docs = events.where("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("account_id"), F.lit("PERMIT").alias(
            "document_type"), day.alias("valid_until"), F.col("ts").alias("at"))
    return drained(spark, st.stream_expiry(docs, events.select(F.col("ts").alias("at"))))


QUERIES["stream_expiry"] = expiry
# a run of equal dates is one document; it is reminded of the level it has reached, then of each as it comes
ORACLES["stream_expiry"] = """
    WITH d AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, cast(ts AS date) + cast(event_id % 40 AS int) AS until
        FROM events WHERE event_type = 'purchase'),
    o AS (SELECT *, lag(until) OVER w AS before FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ms, cast(until AS string))),
    s AS (SELECT user_id, until, ms, epoch_ms(until::timestamp) AS e,
        coalesce(lead(ms) OVER (PARTITION BY user_id ORDER BY ms, cast(until AS string)), 9e18) AS next
        FROM o WHERE before IS DISTINCT FROM until),
    l AS (SELECT * FROM (VALUES (1, '30 days', 30), (2, '7 days', 7), (3, 'today', 0), (4, 'expired', -1)) v(k, level, days)),
    a AS (SELECT s.*, k, level, e - days * 86400000::BIGINT AS due FROM s, l),
    r AS (SELECT user_id, until, ms, next, k, level, due,
        max(CASE WHEN due <= ms THEN k END) OVER (PARTITION BY user_id, until, ms) AS reached FROM a)
    SELECT cast(user_id AS string) AS account_id, 'PERMIT' AS document_type, cast(until AS string) AS valid_until, level
    FROM r WHERE next > ms AND (k = reached OR due > ms AND due < next AND due <= (SELECT epoch_ms(max(ts)) FROM events))"""
