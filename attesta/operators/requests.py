"""Verification requests: validation, one active job per account, reconciliation."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t
from attesta.skew import attach

# What a request may say
SOURCES = ["crm_button", "manual", "schedule", "api"]


def clean_requests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I1. (valid requests, rejects with the reason). Text is trimmed; requester text like
    '<id> <email>' is taken apart; a requested_at without zone is Manila time.

    ``raw`` (all text): account_id, customer_number, reason, document_status, attachment_count,
    requested_by, requested_at, source."""
    df = raw
    for c in raw.columns:
        df = df.withColumn(c, t.strip(c))
    count = F.col("attachment_count").try_cast("int")
    parts = F.split(t.collapse(F.translate(F.coalesce("requested_by", F.lit("")), "|,", "  ")),
                    " ")
    email = F.get(F.filter(parts, lambda p: p.contains("@")), F.lit(0))
    user = F.get(F.filter(parts, lambda p: p.rlike(r"^\d+$")), F.lit(0))
    zoned = F.col("requested_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    text = F.regexp_replace("requested_at", "T", " ")
    at = F.when(zoned, F.try_to_timestamp("requested_at")).otherwise(
        F.try_to_timestamp(F.concat(text, F.lit("+08:00"))))
    source = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("crm_button"))
    given_count = ~t.blank("attachment_count")
    problem = F.concat_ws(
        "; ",
        F.when(~F.coalesce(F.col("account_id").rlike(r"^\d{10,25}$"), F.lit(False)),
               "account_id must be 10 to 25 digits"),
        F.when(F.length("customer_number") > 64, "customer_number is longer than 64"),
        F.when(F.length("reason") > 500, "reason is longer than 500"),
        F.when(~F.coalesce(F.col("document_status").isin("YES", "NO"), F.lit(False)),
               "document_status must be YES or NO"),
        F.when(given_count & ~F.coalesce(count.between(0, 500), F.lit(False)),
               "attachment_count must be 0 to 500"),
        F.when(F.length(user) > 32, "requested_by id is longer than 32"),
        F.when(F.length(email) > 255, "requested_by email is longer than 255"),
        F.when(~t.blank("requested_at") & at.isNull(), "requested_at is not a time"),
        F.when(~source.isin(SOURCES), "source is not known"))
    df = df.withColumn("problem", problem)
    good = df.where(F.col("problem") == "").select(
        "account_id", F.when(F.col("customer_number") != "", F.col("customer_number"))
        .alias("customer_number"), F.coalesce("reason", F.lit("")).alias("reason"),
        "document_status", count.alias("attachment_count"), user.alias("requested_by_id"),
        email.alias("requested_by_email"), at.alias("requested_at"), source.alias("source"))
    return good, df.where(F.col("problem") != "")


def one_active_job(requests: DataFrame, jobs: DataFrame,
                   order: Sequence[str] = ("requested_at", "request_id")) -> DataFrame:
    """I2. The job each request belongs to: the account's active job, else a new one made by its
    first request. Adds job_id and created. ``requests`` are those that arrived together; the first
    of an account is found by aggregation and met again by key."""
    active = jobs.where(F.col("status").isin(rules.ACTIVE_JOB_STATUSES)).groupBy(
        "account_id").agg(F.min("job_id").alias("__active"))
    first = requests.groupBy("account_id").agg(
        F.min_by("request_id", F.struct(*order)).alias("__first"))
    per = first.join(active, "account_id", "left")
    df = attach(requests, per, ["account_id"])
    new = F.sha2(F.concat_ws("|", "account_id", F.col("__first").cast("string")), 256)
    return df.select(
        *requests.columns, F.coalesce("__active", new).alias("job_id"),
        (F.col("__active").isNull() & (F.col("request_id") == F.col("__first")))
        .alias("created"))


def flagged_accounts(accounts: DataFrame, flag: str = "DV_Requested",
                     cod_only: bool = False) -> DataFrame:
    """I3. Accounts whose request flag is set and whose id is a number, as requests; with
    ``cod_only`` only those paying cash on delivery."""
    held = set(accounts.columns)

    def col(name):
        return F.col(name).cast("string") if name in held else F.lit(None).cast("string")

    df = accounts.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
                        & F.col("account_id").rlike(r"^\d+$"))
    if cod_only:
        df = df.where(t.is_cod("Credit_Terms"))
    return df.select(
        "account_id", col("Inventory_Customer_Number").alias("customer_number"),
        F.coalesce(col("DV_Request_Reason"), F.lit("")).alias("reason"),
        F.lit("YES").alias("document_status"),
        F.when(col("DV_Requested_By") != "", col("DV_Requested_By")).alias("requested_by_email"),
        F.when(col("DV_Requested_At") != "", col("DV_Requested_At")).alias("requested_at"),
        F.lit("crm_button").alias("source"))


def reconcile_reported(requests: DataFrame, refs: DataFrame, accounts: DataFrame) -> DataFrame:
    """I4. Warnings where a request reported something else than was found: number of files,
    documents or none, customer number. ``requests``: account_id, document_status,
    attachment_count, customer_number."""
    found = refs.groupBy("account_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("source") == "ATTACHMENT").alias("attached"))
    number = accounts.select("account_id", F.col("Inventory_Customer_Number").alias("__number"))
    df = requests.join(found, "account_id", "left").join(number, "account_id", "left")
    total = F.coalesce("total", F.lit(0))
    attached = F.coalesce("attached", F.lit(0))
    reported = F.col("attachment_count")
    items = t.present(
        F.when((reported != attached) & (reported != total), F.struct(
            F.lit("ATTACHMENT_COUNT_MISMATCH").alias("code"),
            F.lit("Button counted a different number of files than the engine found; files may "
                  "have been added or removed after the click.").alias("message"))),
        F.when((F.col("document_status") == "NO") & (total > 0), F.struct(
            F.lit("DOCUMENT_STATUS_MISMATCH").alias("code"),
            F.lit("Button reported no documents, but the engine found some.").alias("message"))),
        F.when((F.col("document_status") == "YES") & (total == 0), F.struct(
            F.lit("DOCUMENT_STATUS_MISMATCH").alias("code"),
            F.lit("Button reported documents, but the engine found none.").alias("message"))),
        F.when(~t.blank("customer_number") & ~t.blank("__number")
               & (F.col("customer_number") != F.col("__number")), F.struct(
            F.lit("CUSTOMER_NUMBER_MISMATCH").alias("code"),
            F.lit("The reported customer number differs from the account's.")
            .alias("message"))))
    ids = [c for c in ("request_id", "job_id") if c in requests.columns]
    return df.select(*ids, "account_id", total.alias("found_total"),
                     attached.alias("found_attachments"), F.explode(items).alias("w")).select(
        *ids, "account_id", "w.code", "w.message", "found_total", "found_attachments")


def collection_summary(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """I5. Per job the documents by status and by source, and the job's status: COLLECTED when
    something is stored, FAILED when files only failed to download, else NO_DOCUMENTS."""
    states = ["STORED", "DUPLICATE", "REJECTED", "DOWNLOAD_FAILED"]
    sources = ["ATTACHMENT", "FILE_FIELD", "NOTE_ATTACHMENT"]
    per = docs.groupBy("job_id").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in states],
        *[F.count_if(F.col("source") == s).alias(s.lower()) for s in sources])
    counts = [s.lower() for s in states + sources]
    df = jobs.select("job_id").join(per, "job_id", "left").select(
        "job_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return df.withColumn("job_status", F.when(F.col("stored") > 0, "COLLECTED").when(
        F.col("download_failed") > 0, "FAILED").otherwise("NO_DOCUMENTS"))
