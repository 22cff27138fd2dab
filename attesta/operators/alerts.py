"""Alerts, repeats, once-only notices, expiry reminders and log rows."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t

ALERT = ["account_id", "pos", "severity", "code", "document_type", "message", "action"]
ACTIONABLE = ["CRITICAL", "WARNING"]


def _alert(df: DataFrame, stage: int, pos: Sequence, severity: str, code, kind, message,
           action) -> DataFrame:
    a, b = [*pos, F.lit(0)][:2]
    none = F.lit(None).cast("string")

    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "account_id", F.struct(F.lit(stage).alias("stage"), a.cast("int").alias("a"),
                               b.cast("int").alias("b")).alias("pos"),
        F.lit(severity).alias("severity"), lit(code).alias("code"),
        (none if kind is None else F.col(kind)).alias("document_type"),
        lit(message).alias("message"), (none if action is None else lit(action)).alias("action"))


def build_alerts(requirements: DataFrame, conflict_texts: DataFrame, problems: DataFrame,
                 unusable: DataFrame, proposals: DataFrame, today: date,
                 soon_days: int = 30) -> DataFrame:
    """G1. The alerts of every account in reading order: requirements (missing, expired, expiring
    soon), conflicts, critical document issues, unreadable files, fields for a person to check."""
    until = F.try_to_date("valid_until", "yyyy-MM-dd")
    name = t.document_label("document_type")
    left = F.datediff(until, F.lit(today))
    req = requirements.withColumn("__left", left).withColumn("__name", name)
    doc = F.col("__name")
    ago = F.when(F.col("__left").isNotNull(), F.concat(
        F.lit(" ("), (-F.col("__left")).cast("string"), F.lit(" days ago)"))).otherwise("")
    shown = F.coalesce("valid_until", F.lit("None"))
    pos = [F.col("rule_pos")]
    parts = [
        _alert(req.where(F.col("status") == "MISSING"), 1, pos, "WARNING", "MISSING_DOCUMENT",
               "document_type", F.concat(F.lit("Missing required document: "), doc),
               F.concat(F.lit("Collect the customer's "), doc)),
        _alert(req.where(F.col("status") == "EXPIRED"), 1, pos, "CRITICAL", "EXPIRED_DOCUMENT",
               "document_type", F.concat(doc, F.lit(" expired on "), shown, ago),
               F.concat(F.lit("Collect the renewed "), doc)),
        _alert(req.where((F.col("status") == "VALID") & F.col("__left").between(0, soon_days)), 1,
               pos, "WARNING", "EXPIRING_SOON", "document_type",
               F.concat(doc, F.lit(" expires on "), shown, F.lit(" (in "),
                        F.col("__left").cast("string"), F.lit(" days)")),
               F.concat(F.lit("Remind the customer to renew the "), doc)),
        _alert(conflict_texts, 2, [F.col("attribute_pos")], "CRITICAL", "DOCUMENT_CONFLICT", None,
               F.col("message"), "Check whether these documents belong to this customer"),
        _alert(problems, 3, [F.col("doc_pos"), F.col("issue_pos")], "CRITICAL", F.col("code"),
               "document_type", F.concat(F.col("file_name"), F.lit(": "), F.col("code")),
               "Check the document"),
        _alert(unusable.withColumn("__first", F.when(F.col("list") == "not_extracted", 0)
                                   .otherwise(1)), 4,
               [F.col("__first"), F.col("doc_pos")], "WARNING",
               "UNREADABLE_DOCUMENT", None,
               F.concat(F.lit("Could not read "), F.coalesce("file_name", F.lit("None")),
                        F.lit(" ("), F.col("status"), F.lit(")")),
               "Ask for a clearer photo or a supported file type"),
    ]
    check = F.col("action").isin("HOLD", "REVIEW_CONFLICT", "NO_PICKLIST_VALUE", "DIFFERS") | (
        F.col("action").isin("FILL", "CORRECT") & F.col("needs_attention"))
    fields = proposals.where(check).groupBy("account_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "target_field"))),
        lambda x: x["target_field"]), ", ").alias("__fields"))
    parts.append(_alert(fields, 5, [F.lit(0)], "INFO", "FIELDS_NEED_REVIEW", None, F.concat(
        F.lit("Fields needing a person's check: "), F.col("__fields")), None))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alert_active_with_problems(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """G2. A first, critical alert for accounts that are active though not recommended to be."""
    odd = decisions.where((F.col("decision") == "NO_CHANGE") & F.col("is_active")
                          & (F.col("recommendation") != "ACTIVE"))
    first = _alert(odd, 0, [F.lit(0)], "CRITICAL", "ACTIVE_WITH_PROBLEMS", None, F.col("reason"),
                   "Decide whether this account should stay Active")
    return first.unionByName(alerts)


def alert_signature(alerts: DataFrame, by: Sequence[str] = ("account_id",)) -> DataFrame:
    """G3. The sorted codes and document types of the actionable alerts of each account, repeats
    kept; accounts without any have no row. Equal keys are counted before they are collected, so an
    account with very many alerts of a few kinds stays small."""
    key = F.concat(F.col("code"), F.lit(":"), F.coalesce("document_type", F.lit("None")))
    counted = alerts.where(F.col("severity").isin(ACTIONABLE)).groupBy(
        *by, key.alias("__k")).agg(F.count("*").cast("int").alias("__n"))
    repeated = F.transform(F.array_sort(F.collect_list(F.struct("__k", "__n"))),
                           lambda x: F.array_repeat(x["__k"], x["__n"]))
    return counted.groupBy(*by).agg(F.array_join(F.flatten(repeated), "|").alias("signature"))


def suppress_repeats(runs: DataFrame, history: DataFrame, days: int = 7) -> DataFrame:
    """G4. ``repeat`` is true for a run when another run of the account raised the same signature
    within ``days`` before it and its task was created. Suppressed runs do not count.

    ``runs`` and ``history``: account_id, job_id, signature, created_at (history also task_status).
    History is merged to day buckets that keep the two latest and two earliest jobs, enough to
    find one that is not the run itself; a run only meets the days its window touches. So a busy
    signature is never compared run by run.
    """
    span = F.make_interval(days=F.lit(days))
    keys = ["account_id", "signature", "__day"]
    raised = history.where(F.col("task_status").isin("CREATED", "SHADOW"))
    jobs = raised.groupBy(*keys[:2], F.to_date("created_at").alias("__day"), "job_id").agg(
        F.max("created_at").alias("__last"), F.min("created_at").alias("__first"))
    ends = jobs.groupBy(*keys).agg(
        F.max(F.struct("__last", "job_id")).alias("last1"),
        F.min(F.struct("__first", "job_id")).alias("first1"))
    second = jobs.join(ends, keys).groupBy(*keys).agg(
        F.max(F.when(F.col("job_id") != F.col("last1.job_id"), F.col("__last"))).alias("last2"),
        F.min(F.when(F.col("job_id") != F.col("first1.job_id"), F.col("__first")))
        .alias("first2"),
        F.first("last1").alias("last1"), F.first("first1").alias("first1"))
    own_day = F.to_date("created_at")
    touched = runs.withColumn("__day", F.explode(F.sequence(
        F.to_date(F.col("created_at") - span), own_day)))
    met = touched.join(second, keys)
    last = F.when(F.col("last1.job_id") == F.col("job_id"), F.col("last2")).otherwise(
        F.col("last1.__last"))
    first = F.when(F.col("first1.job_id") == F.col("job_id"), F.col("first2")).otherwise(
        F.col("first1.__first"))
    within = F.when(F.col("__day") == own_day, first <= F.col("created_at")).otherwise(
        last >= F.col("created_at") - span)
    hits = met.where(within).select("account_id", "job_id", "signature", "created_at").distinct()
    on = ["account_id", "job_id", "signature", "created_at"]
    return runs.join(hits.withColumn("__hit", F.lit(True)), on, "left").select(
        *runs.columns, F.coalesce("__hit", F.lit(False)).alias("repeat"))


def render_note(alerts: DataFrame, recommendations: DataFrame, decisions: DataFrame,
                requirements: DataFrame, applied: DataFrame, assessed_on: date,
                rules_version: str = rules.RULES_VERSION) -> DataFrame:
    """G5. Title (recommendation and worst severity) and text of each account's note. ``applied``:
    account_id, pos, target_field, status of the automatic updates."""
    def listed(df, pos, text, sep):
        return df.groupBy("account_id").agg(F.array_join(F.transform(F.array_sort(
            F.collect_list(F.struct(F.col(pos).alias("p"), text.alias("x")))),
            lambda r: r["x"]), sep).alias("v"))

    line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("message"), F.when(
        F.col("action").isNotNull(), F.concat(F.lit(" -> "), F.col("action"))).otherwise(""))
    issues = listed(alerts, "pos", line, "\n").withColumnRenamed("v", "__issues")
    worst = alerts.groupBy("account_id").agg(F.max(
        F.when(F.col("severity") == "CRITICAL", 2).when(F.col("severity") == "WARNING", 1)
        .otherwise(0)).alias("__worst"))
    needs = listed(requirements, "rule_pos", F.concat_ws(" ", "document_type", "status"),
                   ", ").withColumnRenamed("v", "__needs")
    done = listed(applied, "pos", F.concat(F.col("target_field"), F.lit(" ("), F.col("status"),
                                           F.lit(")")), ", ").withColumnRenamed("v", "__done")
    df = recommendations.select("account_id", "recommendation").join(
        decisions.select("account_id", "decision", "reason"), "account_id", "left")
    for other in (issues, worst, needs, done):
        df = df.join(other, "account_id", "left")
    rec = F.col("recommendation")
    title = F.concat(F.lit("Document verification: "), rec, F.when(
        F.col("__worst") == 2, " - CRITICAL").when(F.col("__worst") == 1, " - WARNING")
        .otherwise(""))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Recommendation: "), rec, F.lit(
            f" (checked {assessed_on.isoformat()}, rules {rules_version})")),
        F.concat(F.lit("Status: "), F.col("decision"), F.lit(" - "), F.col("reason")), F.lit(""),
        F.concat(F.lit("Issues:\n"), F.col("__issues"), F.lit("\n")),
        F.concat(F.lit("Updated automatically: "), F.col("__done")),
        F.concat(F.lit("Required documents: "), F.coalesce("__needs", F.lit(""))))
    return df.select("account_id", title.alias("title"), text.alias("content"))


def task_rows(alerts: DataFrame, accounts: DataFrame, today: date,
              due_days: int = 3) -> DataFrame:
    """G6. One task per account with actionable alerts: the single action or their number as the
    subject, due date, owner."""
    owner = F.col("Owner.id") if "Owner" in accounts.columns else F.lit(None).cast("string")
    per = alerts.where(F.col("severity").isin(ACTIONABLE)).groupBy("account_id").agg(
        F.count("*").alias("n"), F.min_by("action", "pos").alias("__first"))
    return per.join(accounts.select("account_id", owner.alias("owner_id")), "account_id",
                    "left").select(
        "account_id", F.when(F.col("n") == 1, F.concat(F.lit("Documents: "), F.col("__first")))
        .otherwise(F.concat(F.lit("Documents: "), F.col("n").cast("string"),
                            F.lit(" issues to resolve"))).alias("subject"),
        F.date_add(F.lit(today), due_days).alias("due_date"), "owner_id")


def once_only(events: DataFrame, ledger: DataFrame, order: Sequence[str] = ("created_at",)
              ) -> DataFrame:
    """G7. Events not announced before, each (kind, ref) once: the earliest.
    Repeats are merged by aggregation before they meet the ledger."""
    values = [c for c in events.columns if c not in ("kind", "ref")]
    first = events.groupBy("kind", "ref").agg(F.min_by(
        F.struct(*values), F.struct(*order)).alias("e"))
    fresh = first.join(ledger.select("kind", "ref").distinct(), ["kind", "ref"], "left_anti")
    return fresh.select(*[F.col(c) if c in ("kind", "ref") else F.col(f"e.{c}")
                          for c in events.columns])


def latest_per_account(assessments: DataFrame, key: str = "account_id",
                       at: str = "created_at") -> DataFrame:
    """G8. The newest assessment of each account; all of them when several share the newest time.
    The newest time per account is found first and joined back."""
    newest = assessments.groupBy(key).agg(F.max(at).alias(at))
    return assessments.join(newest, [key, at], "left_semi")


def expiry_level(days_left: Column, levels: Sequence[int]) -> Column:
    """The smallest level the days left have reached: '30 days', '7 days', 'today', 'expired'."""
    out = F.lit(None).cast("string")
    for level in sorted(levels, reverse=True):
        out = F.when(days_left <= level, "today" if level == 0 else f"{level} days") \
            .otherwise(out)
    return F.when(days_left < 0, "expired").otherwise(out)


def expiry_reminders(latest: DataFrame, ledger: DataFrame, today: date,
                     levels: Sequence[int] = tuple(rules.EXPIRY_LEVELS)) -> DataFrame:
    """G9. Documents of the latest assessments that reached a reminder level, once per account,
    document type, expiry date and level. ``latest``: account_id, document_type, status,
    valid_until (ISO text), file and what else should be carried."""
    due = latest.where(F.col("status").isin("VALID", "EXPIRED") & ~t.blank("valid_until"))
    due = due.withColumn("days_left", F.datediff(
        F.try_to_date("valid_until", "yyyy-MM-dd"), F.lit(today)))
    due = due.withColumn("level", expiry_level(F.col("days_left"), levels)).where(
        F.col("level").isNotNull()).withColumn("ref", F.concat_ws(
            "|", "account_id", "document_type", "valid_until", "level"))
    sent = ledger.where(F.col("kind") == "expiry").select("ref")
    return due.join(sent, "ref", "left_anti").select(*latest.columns, "days_left", "level", "ref")


def reminder_text(due: DataFrame, name: str = "account_name",
                  number: str = "customer_number") -> DataFrame:
    """Adds the reminder's message."""
    doc = t.short_document("document_type")
    day = t.printed_date("valid_until")
    when = (F.when(F.col("level") == "expired", F.concat(
        F.lit("expired on "), day, F.lit(" ("), (-F.col("days_left")).cast("string"),
        F.lit(" days ago)")))
        .when(F.col("level") == "today", F.concat(F.lit("expires today ("), day, F.lit(")")))
        .otherwise(F.concat(F.lit("expires on "), day, F.lit(" (in "),
                            F.col("days_left").cast("string"), F.lit(" days)"))))
    who = F.concat(F.col(name), F.when(~t.blank(number), F.concat(
        F.lit(" ("), F.col(number), F.lit(")"))).otherwise(""))
    return due.withColumn("message", F.concat(
        F.lit("⚠️ "), doc, F.lit(" of "), who, F.lit(" "), when,
        F.lit(". Please collect the renewed "), doc, F.lit(" and attach it to the Account.")))


def recheck_before_reminder(due: DataFrame, attachments: DataFrame, latest: DataFrame
                            ) -> tuple[DataFrame, DataFrame]:
    """G10. Accounts with files newer than their assessment are verified again instead of reminded:
    (requests, reminders to send). ``latest``: account_id, created_at."""
    newest = attachments.groupBy("account_id").agg(F.max("Created_Time").alias("__newest"))
    fresh = latest.select("account_id", "created_at").join(newest, "account_id").where(
        F.col("__newest") > F.col("created_at")).select("account_id").distinct()
    again = due.select("account_id").distinct().join(fresh, "account_id", "left_semi").select(
        "account_id", F.lit("New documents found before an expiry reminder").alias("reason"),
        F.lit("YES").alias("document_status"), F.lit("schedule").alias("source"))
    return again, due.join(fresh, "account_id", "left_anti")


def renewals(requirements: DataFrame, ledger: DataFrame) -> DataFrame:
    """G11. Documents reminded of earlier that are now valid to a later date, announced once. Dates
    compare as ISO text. The earliest reminded date per account and type decides."""
    parts = F.split("ref", r"\|")
    old = ledger.where(F.col("kind") == "expiry").select(
        F.get(parts, F.lit(0)).alias("account_id"), F.get(parts, F.lit(1)).alias("document_type"),
        F.get(parts, F.lit(2)).alias("__old")).groupBy("account_id", "document_type").agg(
        F.min("__old").alias("__old"))
    now = requirements.where((F.col("status") == "VALID") & ~t.blank("valid_until"))
    df = now.join(old, ["account_id", "document_type"]).where(
        F.col("__old") < F.col("valid_until")).withColumn("ref", F.concat_ws(
            "|", "account_id", "document_type", "valid_until"))
    told = ledger.where(F.col("kind") == "renewed").select("ref")
    return df.join(told, "ref", "left_anti").select(*requirements.columns, "ref")


def verification_log(accounts: DataFrame, recommendations: DataFrame, requirements: DataFrame,
                     activation: DataFrame, updates: DataFrame, documents: DataFrame) -> DataFrame:
    """G12. One log row per verified account: checks met, what is missing, fields updated or would be
    (shadow), whether it was activated. ``updates``: account_id, pos, target_field, status;
    ``documents``: account_id, n."""
    short = F.coalesce(F.try_element_at(t.lookup(rules.CHECK_SHORT), F.col("key")),
                       F.col("label"))
    gaps = requirements.where(F.col("status").isin("MISSING", "EXPIRED")).select(
        "account_id", F.struct(F.lit(0).alias("s"), F.col("rule_pos").alias("p"), F.concat(
            t.short_document("document_type"), F.lit(" "), F.lower("status")).alias("x"))
        .alias("g")).unionByName(activation.where(F.col("status") == "FAIL").select(
            "account_id", F.struct(F.lit(1).alias("s"), F.col("pos").alias("p"),
                                   short.alias("x")).alias("g")))
    gaps = gaps.groupBy("account_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list("g")), lambda g: g["x"]), ", ").alias("missing"))
    met = activation.groupBy("account_id").agg(F.concat(
        F.count_if(F.col("status") == "PASS").cast("string"), F.lit("/"),
        F.count("*").cast("string")).alias("checks_met"))

    def fields(status):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            (F.col("target_field") != "Customer_Status") & (F.col("status") == status),
            F.struct("pos", t.field_label("target_field").alias("x"))))), lambda r: r["x"]), ", ")
    did = updates.groupBy("account_id").agg(
        fields("APPLIED").alias("applied"), fields("SHADOW").alias("shadow"),
        F.max((F.col("target_field") == "Customer_Status") & (F.col("status") == "APPLIED"))
        .alias("__active"))
    df = recommendations.select("account_id", "recommendation").join(
        accounts.select("account_id"), "account_id")
    for other in (met, gaps, did, documents.select("account_id", "n")):
        df = df.join(other, "account_id", "left")
    return df.select(
        "account_id", F.translate("recommendation", "_", " ").alias("recommendation"),
        F.coalesce("checks_met", F.lit("")).alias("checks_met"),
        F.coalesce("missing", F.lit("")).alias("missing"),
        F.coalesce("applied", F.lit("")).alias("applied"),
        F.coalesce("shadow", F.lit("")).alias("shadow"),
        F.coalesce("n", F.lit(0)).alias("documents_found"),
        F.when(F.col("__active"), "Active (automatic)").otherwise("not changed")
        .alias("customer_status"))


def review_log(reviews: DataFrame, rows: DataFrame, ledger: DataFrame, now,
               max_age_days: int = 3) -> tuple[DataFrame, DataFrame]:
    """G13. Closed reviews not announced yet: (one message per review, one log row per written or
    skipped field). Reviews closed more than ``max_age_days`` ago are marked silently: they are in
    the first frame with a null message.

    ``reviews``: review_id, number, account_id, account_name, status, reviewer, reviewer_notes,
    activated, closed_at; ``rows``: review_id, row_pos, target_field, current_value,
    proposed_value, edited_value, decision, outcome, confidence.
    """
    closed = reviews.where(F.col("status").isin(
        "Applied", "Conflict", "Failed", "Rejected", "Waiting for Documents")).withColumn(
        "ref", F.concat_ws(":", F.lit("engine"), "review_id", "status"))
    told = ledger.where(F.col("kind") == "review").select("ref")
    closed = closed.join(told, "ref", "left_anti")
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(max_age_days))
    closed = closed.withColumn("__silent", F.coalesce(F.col("closed_at") < cutoff, F.lit(False)))

    decided = rows.where(F.col("decision").isin("Approve", "Edit")).withColumn(
        "__label", t.field_label("target_field"))
    per = decided.groupBy("review_id").agg(
        F.count_if(F.col("outcome") == "APPLIED").alias("n_applied"),
        F.count_if(F.col("outcome").isin("CONFLICT", "FAILED")).alias("n_skipped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("outcome") == "APPLIED", F.struct("row_pos", "__label")))),
            lambda r: r["__label"]), ", ").alias("labels"))
    df = closed.join(per, "review_id", "left")
    who = F.coalesce(F.when(F.col("reviewer") != "", F.col("reviewer")), F.lit("the reviewer"))
    name = F.coalesce(F.when(F.col("account_name") != "", F.col("account_name")),
                      F.col("account_id"))
    dv = F.concat(F.lit("DV-"), F.col("number").cast("string"))
    n_applied = F.coalesce("n_applied", F.lit(0)).cast("string")
    n_skipped = F.coalesce("n_skipped", F.lit(0))
    status = F.col("status")
    text = (
        F.when(status.isin("Rejected", "Waiting for Documents"), t.strip(F.concat(
            F.when(status == "Rejected", "🚫").otherwise("📄"), F.lit(" "), dv, F.lit(" for "),
            name, F.lit(": "), F.lower(status), F.lit(" by "), who, F.lit(". "),
            F.coalesce("reviewer_notes", F.lit("")))))
        .when(status == "Failed", F.concat(
            F.lit("❌ "), dv, F.lit(" for "), name,
            F.lit(": the write-back failed. See the review in the dashboard.")))
        .otherwise(F.concat(
            F.lit("👍 "), dv, F.lit(" approved by "), who, F.lit(" for "), name, F.lit(": "),
            n_applied, F.lit(" field(s) updated"),
            F.when(F.coalesce("labels", F.lit("")) != "", F.concat(
                F.lit(" ("), F.col("labels"), F.lit(")"))).otherwise(""),
            F.when(n_skipped > 0, F.concat(
                F.lit("; "), n_skipped.cast("string"),
                F.lit(" not written (the Account had changed: Conflict)"))).otherwise(""))))
    text = F.concat(text, F.when(F.coalesce("activated", F.lit(False)), F.lit(
        "\nCustomer Status → Active (reviewer decision)")).otherwise(""))
    messages = df.select("review_id", "account_id", "ref",
                         F.when(~F.col("__silent"), text).alias("message"))
    logged = decided.where(F.col("outcome").isin("APPLIED", "CONFLICT", "FAILED")).join(
        closed.where(~F.col("__silent")).select(
            "review_id", "account_id", dv.alias("dv_number"), name.alias("account"),
            F.concat(F.lit("Approved by "), who).alias("how")), "review_id")
    value = F.when(F.col("decision") == "Edit", F.col("edited_value")).otherwise(
        F.col("proposed_value"))
    return messages, logged.select(
        "review_id", "dv_number", "account", "account_id", F.col("__label").alias("field"),
        F.coalesce("current_value", F.lit("")).alias("old_value"),
        F.coalesce(value, F.lit("")).alias("new_value"), "confidence", "how",
        F.when(F.col("outcome") == "APPLIED", "Applied").when(
            F.col("outcome") == "CONFLICT", "Conflict").otherwise("Failed").alias("result"))
