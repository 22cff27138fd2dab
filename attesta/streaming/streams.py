"""Streaming forms of the stateful operators.

S1, S2, S4 and S5 fold the rows of a key in the order of their time. A row waits in the key's state until the
watermark has passed it; a timer then takes it out. So rows that arrive out of order, in one micro-batch or over
several, give the same answers, and an answer once given never changes. Rows wait in pieces of up to ``PIECE``, each
ordered by time, with one timer at its first row: a task holds the pieces of one key that overlap in time, never all
rows of a key, and each piece, not each row, costs calls to the state. Rows later than the watermark are dropped, as are
rows without a time. State that can no longer matter is cleared, by a completion or by a timer.

The state lies in RocksDB, beside the task, with its log in the query's checkpoint.
"""

import heapq
import json
from collections.abc import Sequence
from itertools import count, groupby
from threading import Event

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from attesta import rules

WATERMARK = "1 day"
#: Rows of a piece of state, and rows that are ordered together before they are cut into pieces.
PIECE, TOGETHER = 500, 10_000
#: Results in one row of output.
PACKED = 1_000
_DAY_MS = 86_400_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _turn(row) -> tuple:
    """Order of rows: by time, then by the columns that wait, nulls first."""
    return row[0], [(v is not None, v or "") for v in row[1:]]


class InOrder(StatefulProcessor):
    """Folds a key's rows by time, and those of one millisecond by their ``waits`` columns in turn (nulls
    first). A subclass names the columns that wait and what it ``holds`` for a key, and yields results from
    ``fold`` (the rows of one time) and ``due`` (what time alone brings about, up to a time). Both find the key's
    state in ``now`` (None: none) and replace it there; it is read and written once each time a key is taken up.
    ``due`` is called at the time last asked for by ``wake``; times that the watermark has passed are made up for at
    once."""

    waits: tuple[str, ...] = ()
    holds: StructType

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState(
            "waiting", StructType([StructField("at", LongType()), StructField("n", LongType())]), _strings("rows"))
        self.state = handle.getValueState("state", self.holds)

    def fold(self, key, at: int, rows):
        yield from ()

    def due(self, key, upto: int):
        yield from ()

    def wake(self, at: int) -> None:
        self.alarm = at

    def wait(self, rows: list) -> None:
        """Put rows into the state, in pieces without a gap, with a timer at the first row of each."""
        rows.sort(key=lambda r: r[0])
        for lo in range(0, len(rows), PIECE):
            piece = rows[lo:lo + PIECE]
            at = piece[0][0]
            n = next(n for n in count() if not self.waiting.containsKey((at, n)))
            self.waiting.updateValue((at, n), (json.dumps(piece, ensure_ascii=False, separators=(",", ":")),))
            if n == 0:
                self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        some = []
        for r in rows:
            if r["__ms"] is not None:
                some.append((r["__ms"], *[r[c] for c in self.waits]))
            if len(some) >= TOGETHER:
                self.wait(some)
                some = []
        self.wait(some)
        yield from ()

    def passed(self, upto: int):
        """The rows that wait up to a time, in order; they leave the state."""
        ready, rest = [], []
        for piece in sorted(tuple(k) for k in self.waiting.keys() if k[0] <= upto):
            while ready and ready[0][0][0] < piece[0]:
                yield heapq.heappop(ready)[2]
            for row in json.loads(self.waiting.getValue(piece)[0]):
                if row[0] <= upto:
                    heapq.heappush(ready, (_turn(row), id(row), row))
                else:
                    rest.append(row)
            self.waiting.removeKey(piece)
            if len(rest) >= TOGETHER:
                self.wait(rest)
                rest = []
        while ready:
            yield heapq.heappop(ready)[2]
        self.wait(rest)

    def results(self, key, upto: int):
        for at, rows in groupby(self.passed(upto), lambda r: r[0]):
            yield from self.due(key, at - 1)
            yield from self.fold(key, at, [tuple(r[1:]) for r in rows])
        yield from self.due(key, upto)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before, self.alarm = self.state.get(), None
        self.now = before = None if before is None else tuple(before)
        out, upto = [], timerValues.getCurrentWatermarkInMs()
        for result in self.results(key, upto):
            out.append(result)
            if len(out) >= PACKED:
                yield Row(key=tuple(key), results=out)
                out = []
        if out:
            yield Row(key=tuple(key), results=out)
        if self.now is None and before is not None:
            self.state.clear()
        elif self.now != before:
            self.state.update(self.now)
        if self.alarm is not None and self.alarm > upto:
            self.handle.registerTimer(self.alarm)

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, at: str, watermark: str | None, keys: Sequence[str], processor: InOrder,
            result: str) -> DataFrame:
    """Rows folded per key; ``processor`` sees ``__ms``, the time in milliseconds, and what waits as text.
    Gives the keys and the columns of ``result``."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    marked = rows.withWatermark(at, watermark) if watermark else rows      # or it was marked before
    held = marked.select(
        *keys, at, F.unix_millis(at).alias("__ms"), *[F.col(c).cast("string").alias(c) for c in processor.waits])
    key = ", ".join(f"{k}: string" for k in keys)
    return held.groupBy(*keys).transformWithState(
        processor, StructType.fromDDL(f"key struct<{key}>, results array<struct<{result}>>"), "Append", "EventTime").select(
        "key.*", F.inline("results"))


# ---------------------------------------------------------------- S1
class ActiveJob(InOrder):
    """The active job of an account, from a request to its completion."""

    waits = ("done", "request", "job")
    holds = _strings("job")

    def fold(self, key, at, rows):
        # completions first: rows without a request sort behind the null of ``done``, so by hand
        active = self.now[0] if self.now else None
        for done, request, job in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] or "")):
            if done is not None:
                active = None if active == done else active
                continue
            created = active is None
            active = job if created else active
            yield request, active, created
        self.now = None if active is None else (active,)


def stream_active_jobs(requests: DataFrame, completions: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """S1. The job of each request while jobs come and go: an account has one active job, a request
    during it joins it, a completion ends it (at the same time: before the request). ``requests``: account_id,
    request_id, ts; ``completions``: account_id, job_id, ts. A new job's id comes from its first request.
    An account without an active job has no state."""
    none = F.lit(None).cast("string")
    rows = requests.select("account_id", "ts", F.col("request_id").cast("string").alias("request"),
                           none.alias("done")).unionByName(completions.select(
        "account_id", "ts", none.alias("request"), F.col("job_id").alias("done")))
    rows = rows.withColumn("job", F.sha2(F.concat_ws("|", "account_id", "request"), 256))
    return _folded(rows, "ts", watermark, ["account_id"], ActiveJob(),
                   "request_id: string, job_id: string, created: boolean")


# ---------------------------------------------------------------- S2
class Suppressed(InOrder):
    """The run that last raised a task, for as long as it suppresses others."""

    waits = ("job_id",)
    holds = StructType([StructField("at", LongType()), StructField("job", StringType())])

    def __init__(self, window: int):
        self.window = window

    def fold(self, key, at, rows):
        raised, job = self.now or (None, None)
        for (run,) in rows:
            repeat = raised is not None and job != run and at - raised <= self.window
            if not repeat:
                raised, job = self.now = at, run
                self.wake(at + self.window + 1)      # no run after that is a repeat of this one
            yield run, at, repeat

    def due(self, key, upto):
        if self.now and self.now[0] + self.window < upto:
            self.now = None
        yield from ()


def stream_suppress_alerts(alerts: DataFrame, days: int = 7,
                           watermark: str = WATERMARK) -> DataFrame:
    """S2. ``repeat`` for every alert run: the same signature of the account was raised by another
    job within ``days``. Only runs that raised a task count, so suppressed runs do not extend the
    window. ``alerts``: account_id, job_id, signature, created_at."""
    out = _folded(alerts, "created_at", watermark, ["account_id", "signature"], Suppressed(days * _DAY_MS),
                  "job_id: string, at: long, repeat: boolean")
    return out.select("account_id", "job_id", "signature", F.timestamp_millis("at").alias("created_at"), "repeat")


# ---------------------------------------------------------------- S3
def stream_once(events: DataFrame, at: str = "created_at", watermark: str = WATERMARK) -> DataFrame:
    """S3. Each (kind, ref) once within the watermark."""
    return events.withWatermark(
        at, watermark).dropDuplicatesWithinWatermark(["kind", "ref"])


def write_once(events: DataFrame, ledger: str, checkpoint: str, at: str = "created_at"):
    """S3 for all time: every micro-batch drops what the ledger table holds and appends the rest.
    A batch writes a folder of its own, named after its query and its number, and overwrites it when
    it is run again, so a restart neither loses nor repeats a notice, nor does a new checkpoint,
    whose batches count from 0 again but belong to another query. Returns the started query."""
    from attesta.operators.alerts import once_only

    def batch(rows: DataFrame, batch_id: int):
        spark = rows.sparkSession
        started.wait()
        run = str(queries[0].id)
        try:
            held = spark.read.parquet(ledger).where(
                (F.col("run") != run) | (F.col("batch_id") != batch_id)).select("kind", "ref")
        except AnalysisException as missing:   # the first batch of all finds no ledger
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            held = rows.select("kind", "ref").limit(0)
        fresh = once_only(rows, held, (at,))
        fresh.write.mode("overwrite").parquet(f"{ledger}/run={run}/batch_id={batch_id}")

    started, queries = Event(), []
    queries.append(events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start())
    started.set()   # a batch waits until its query, and with it the id, is known
    return queries[0]


# ---------------------------------------------------------------- S4
class Expiry(InOrder):
    """The newest expiry date of a document and how many of its reminders were sent."""

    waits = ("valid_until",)
    holds = StructType([StructField("until", StringType()), StructField("end", LongType()), StructField("n", LongType())])

    def __init__(self, levels, keep_days: int):
        self.levels, self.keep = levels, keep_days * _DAY_MS

    def plan(self, end):
        """When each reminder is due; the last one a day after the end."""
        return [*(end - level * _DAY_MS for level in self.levels), end + _DAY_MS]

    def reminder(self, until, k):
        level = self.levels[k] if k < len(self.levels) else None
        return until, "expired" if level is None else "today" if level == 0 else f"{level} days"

    def fold(self, key, at, rows):
        for (until,) in rows:
            end = _midnight(until)
            if end is not None and (self.now is None or self.now[0] != until):
                reached = sum(1 for due in self.plan(end) if due <= at)
                if reached:
                    yield self.reminder(until, reached - 1)
                self.now = until, end, reached

    def due(self, key, upto):
        if self.now is None:
            return
        until, end, n = self.now
        plan = self.plan(end)
        while n < len(plan) and plan[n] <= upto:
            yield self.reminder(until, n)
            n += 1
        later = plan[n] if n < len(plan) else plan[-1] + self.keep
        if later <= upto:
            self.now = None
            return
        self.now = until, end, n
        self.wake(later)


def _midnight(until: str | None) -> int | None:
    """The start of a day in ISO text, in milliseconds; None for other texts."""
    from datetime import UTC, datetime
    try:
        return int(datetime.fromisoformat(until).replace(tzinfo=UTC).timestamp()) * 1000 if until else None
    except ValueError:
        return None


def stream_expiry(requirements: DataFrame, clock: DataFrame,
                  levels: Sequence[int] = tuple(rules.EXPIRY_LEVELS),
                  watermark: str = "0 seconds", keep_days: int = 30) -> DataFrame:
    """S4. Expiry reminders from a clock: per account and document type a timer for each level of
    the newest expiry date, sent once. ``requirements``: account_id, document_type, valid_until
    (ISO text), at; ``clock``: at, whose ticks move the watermark on. A document first seen after
    a level is reminded at the level it has reached; a renewed one starts anew. What was sent is
    forgotten ``keep_days`` after the last level."""
    none = F.lit(None).cast("string")
    rows = requirements.select("account_id", "document_type", "valid_until", "at").unionByName(
        clock.select(none.alias("account_id"), none.alias("document_type"),
                     none.alias("valid_until"), "at")).withWatermark("at", watermark)
    # ticks have moved the watermark on and end here; a condition on the event time stays above it
    rows = rows.where(F.coalesce(F.when(F.col("at").isNotNull(), F.col("account_id").isNotNull()), F.lit(False)))
    return _folded(rows, "at", None, ["account_id", "document_type"],
                   Expiry(sorted(levels, reverse=True), keep_days),
                   "valid_until: string, level: string")


# ---------------------------------------------------------------- S5
class Review(InOrder):
    """Status and first reviewer of a review, until some days after it was closed."""

    waits = ("kind", "row_id", "decision", "value", "reviewer", "status")
    holds = StructType([*_strings("status", "reviewer").fields, StructField("until", LongType())])

    def __init__(self, keep_days: int):
        self.keep = keep_days * _DAY_MS

    def fold(self, key, at, rows):
        open_states = tuple(rules.REVIEW_OPEN)
        status, reviewer, until = self.now or (None, None, None)
        if until is not None and until <= at:      # forgotten by now
            self.now = status = reviewer = until = None
        # an opening comes before, a closing after the decisions of the same time
        turn = {"opened": 0, "closed": 2}
        for kind, row_id, decision, value, by, said in sorted(rows, key=lambda r: turn.get(r[0], 1)):
            if kind == "opened":
                status = status or said or "Pending Review"
            elif kind == "closed":
                status = said if status in open_states else status
            else:
                value = (value or "").strip()
                problem = self.problem(status, decision, value)
                if problem is None:
                    status, reviewer = "In Review", reviewer or by or None
                yield (row_id, decision, value if problem is None and decision == "Edit" else None,
                       reviewer, status, problem)
        if status is not None:
            if status not in open_states and until is None:
                until = at + self.keep
                self.wake(until)
            self.now = status, reviewer, until

    def due(self, key, upto):
        if self.now and self.now[2] is not None and self.now[2] <= upto:
            self.now = None
        yield from ()

    @staticmethod
    def problem(status, decision, value) -> str | None:
        if status is None:
            return "Review not found"
        if status not in rules.REVIEW_OPEN:
            return f"Review is {status}; it can no longer change"
        if decision not in rules.DECISIONS:
            return "Decision must be one of " + ", ".join(rules.DECISIONS)
        return "Edit needs the corrected value" if decision == "Edit" and not value else None


def stream_fold_decisions(events: DataFrame, watermark: str = WATERMARK, keep_days: int = 3650) -> DataFrame:
    """S5. The review state machine: (opened | decision | closed) events of a review in time order.
    Emits one row per decision with its problem (null when accepted), the review's status after
    it and its first reviewer. ``events``: review_id, kind, row_id, decision, value, reviewer,
    status, ts. A review is forgotten ``keep_days`` after it was closed. Row ids are checked by the batch
    form, which knows the rows."""
    return _folded(events, "ts", watermark, ["review_id"], Review(keep_days),
                   "row_id: string, decision: string, edited_value: string, reviewer: string, status: string, problem: string")


# ---------------------------------------------------------------- S6
def stream_audit_counts(events: DataFrame, window: str = "1 hour", watermark: str = WATERMARK,
                        at: str = "created_at", kind: Column | str = "event_type") -> DataFrame:
    """S6. Audit events per type and tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark(at, watermark).groupBy(
        F.window(at, window).alias("w"), F.col(kind) if isinstance(kind, str) else kind).agg(
        F.count("*").alias("events")).select("w.start", "w.end", kind, "events")
