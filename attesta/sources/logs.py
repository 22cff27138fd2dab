"""Append-only logs: the four activity logs and the audit events."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of each log
LOGS = {
    "Verifications": ["logged_at", "dv_number", "account", "account_id", "customer_number",
                      "requested_by", "reason", "recommendation", "activation_checks", "missing",
                      "documents_found", "customer_status"],
    "Field Updates": ["logged_at", "dv_number", "account", "account_id", "field", "old_value",
                      "new_value", "confidence", "how", "result"],
    "Activations": ["logged_at", "account", "account_id", "customer_number", "activated_by",
                    "dv_number"],
    "Document Expiry": ["logged_at", "account", "account_id", "customer_number", "document",
                        "file", "valid_until", "days_left", "level", "status"],
}


def log_rows(frame: DataFrame, log: str) -> DataFrame:
    """The log's columns as text, null as ''. Columns the frame lacks are ''."""
    held = set(frame.columns)
    return frame.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in held
                          else F.lit("").alias(c) for c in LOGS[log]])


def audit_events(frame: DataFrame, event_type: str, message, payload_columns) -> DataFrame:
    """Audit rows: job_id, event_type, message, JSON payload of the named columns, created_at."""
    return frame.select("job_id", F.lit(event_type).alias("event_type"),
                        message.alias("message"),
                        F.to_json(F.struct(*payload_columns)).alias("payload"), "created_at")


def _folder(log: str) -> str:
    return log.lower().replace(" ", "_")


def write_logs(frames: dict[str, DataFrame], path: str, log_date: str, run: str | None = None) -> dict[str, str]:
    """A8. Append each log below ``path``; returns where each went.

    A run writes a folder of its own in each log and enters itself in the list of runs when all of them are
    complete. Readers (``read_logs``) see listed runs only, so a run shows whole or not at all; run again
    under the same name it replaces its folders, so it adds nothing. Without a name it is a run of its own."""
    run = run or uuid.uuid4().hex
    where = {log: f"{path}/{_folder(log)}" for log in frames}
    for log, frame in frames.items():
        rows = frame if log == "Audit" else log_rows(frame, log)
        rows.write.mode("overwrite").parquet(f"{where[log]}/log_date={log_date}/run={run}")
    spark = next(iter(frames.values())).sparkSession
    (spark.createDataFrame([(log_date, sorted(frames))], "log_date string, logs array<string>")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/run={run}"))
    return where


def read_logs(spark: SparkSession, path: str, log: str) -> DataFrame:
    """The rows of a log from complete runs, with ``log_date`` and ``run``."""
    text = spark.read.option("inferSchema", "false")
    runs = text.parquet(f"{path}/runs").where(F.array_contains("logs", log)).select(
        F.col("run").cast("string").alias("run"))
    rows = text.parquet(f"{path}/{_folder(log)}").withColumn("run", F.col("run").cast("string"))
    return rows.join(runs, "run", "left_semi")
