"""Content addressing: mark repeats, find new contents, pending work and what may be purged."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t
from attesta.skew import attach, ordered


def mark_duplicates(docs: DataFrame, by: Sequence[str] = ("job_id",), content: str = "content",
                    doc_id: str = "doc_id", order: Sequence[str] = ("pos",),
                    name: str = "file_name") -> DataFrame:
    """B1. Per ``by``, the first document of equal content is STORED and later ones are DUPLICATE
    of it. The first is found by aggregation (combined before the shuffle) and attached to its
    copies, so a content with very many copies is never one task's work."""
    hashed = docs if "sha256" in docs.columns else docs.withColumn(
        "sha256", F.sha2(F.col(content), 256))
    keys = [*by, "sha256"]
    first = hashed.where(F.col("sha256").isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(F.col(doc_id).alias("id"), F.col(name).alias("name")),
                 ordered([*order, doc_id])).alias("__first"))
    out = attach(hashed, first, keys)
    copy = F.col("__first.id") != F.col(doc_id)
    return out.select(
        *hashed.columns,
        F.when(F.col("sha256").isNotNull(), F.when(copy, "DUPLICATE").otherwise("STORED"))
        .alias("status"),
        F.when(copy, F.col("__first.id")).alias("duplicate_of"),
        F.when(copy, F.concat(F.lit("Same content as "), F.col("__first.name").cast("string")))
        .alias("status_detail"))


def storage_key(sha256, extension) -> Column:
    sha, ext = t._c(sha256), t._c(extension)
    return F.concat(F.lit("originals/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit("."), ext)


def new_contents(docs: DataFrame, contents: DataFrame,
                 order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """B2. Contents not held yet, one row each (the earliest document tells size and type), with
    the key to store them under. ``docs``: sha256, size, mime_type, extension."""
    one = docs.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min_by(
        F.struct("size", "mime_type", "extension"), ordered(order)).alias("f"))
    fresh = one.join(contents.select("sha256"), "sha256", "left_anti")
    return fresh.select("sha256", "f.size", "f.mime_type", "f.extension",
                        storage_key("sha256", "f.extension").alias("storage_key"))


def pending_work(contents: DataFrame, done: DataFrame, version: str,
                 done_status: str | None = None) -> DataFrame:
    """B3. Contents without a result for this version. Any row counts as done, or only those with
    ``done_status`` (extraction: EXTRACTED). Re-running a finished job is then a no-op."""
    held = done.where(F.col("version") == version)
    if done_status is not None:
        held = held.where(F.col("status") == done_status)
    return contents.join(held.select("sha256"), "sha256", "left_anti").withColumn(
        "version", F.lit(version))


def reuse_results(docs: DataFrame, results: DataFrame, version: str) -> DataFrame:
    """B4. Attach the cached result of each document's content, whichever account it came from.
    ``results`` holds one row per sha256 and version."""
    values = [c for c in results.columns if c not in ("sha256", "version")]
    return attach(docs, results.where(F.col("version") == version).select("sha256", *values), ["sha256"])


def purgeable_contents(docs: DataFrame, jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """B5. Contents of the finished jobs: ``purge`` is false while another active job uses them.
    Per content the lowest and highest active job are enough to tell whether another one exists."""
    pairs = docs.where(F.col("sha256").isNotNull()).select("job_id", "sha256").distinct()
    done = pairs.join(finished.select("job_id").distinct(), "job_id", "left_semi")
    active = jobs.where(F.col("status").isin(rules.ACTIVE_JOB_STATUSES)).select("job_id")
    users = pairs.join(active, "job_id", "left_semi").groupBy("sha256").agg(
        F.min("job_id").alias("__lo"), F.max("job_id").alias("__hi"))
    used = F.col("__lo").isNotNull() & ~((F.col("__lo") == F.col("job_id"))
                                         & (F.col("__hi") == F.col("job_id")))
    return done.join(users, "sha256", "left").select("job_id", "sha256", (~used).alias("purge"))


def purge_summary(purgeable: DataFrame) -> DataFrame:
    """Per finished job: contents to delete, and contents kept for other jobs."""
    return purgeable.groupBy("job_id").agg(
        F.count_if("purge").alias("files_deleted"),
        F.count_if(~F.col("purge")).alias("kept_for_other_jobs"))


def expired_review_copies(reviews: DataFrame, days: int, now) -> DataFrame:
    """B6. Page copies of reviews closed more than ``days`` ago and not purged yet; a review
    without pages gives one row with a null page."""
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    old = reviews.where((F.col("closed_at") < cutoff) & ~F.col("images_purged"))
    return old.select("review_id", "closed_at", F.explode_outer("pages").alias("page_key"))


def canonical_name(path) -> Column:
    """File name without folder, fetch prefix, case and punctuation."""
    name = F.regexp_extract(t._c(path), r"([^/]*)$", 1)
    # Fixed value: prefixes that fetching adds
    bare = F.regexp_replace(name, r"(?i)^(attachment|file_field|note_attachment)_[0-9A-Za-z]+_",
                            "")
    return F.regexp_replace(F.lower(bare), "[^a-z0-9]", "")


def match_by_canonical_name(files: DataFrame, gold: DataFrame, path: str = "path",
                            name: str = "file_name") -> DataFrame:
    """B7. The file of each gold entry, matched on the canonical name; the first path wins and
    JSON files are ignored. Gold entries without a file keep a null path."""
    index = files.where(~F.col(path).endswith(".json")).groupBy(
        canonical_name(path).alias("__key")).agg(F.min(path).alias("matched_path"))
    keyed = gold.withColumn("__key", canonical_name(name))
    return keyed.join(index, "__key", "left").select(*gold.columns, "matched_path")


def missing_at_target(files: DataFrame, target: DataFrame, name: str = "file_name",
                      target_name: str = "file_name",
                      order: Sequence[str] = ("pos",)) -> DataFrame:
    """B8. Files the target does not hold by name, each name once (the first)."""
    values = [c for c in files.columns if c != name]
    first = files.groupBy(name).agg(F.min_by(F.struct(*values), ordered(order)).alias("__f"))
    held = target.select(F.col(target_name).alias(name))
    return first.join(held, name, "left_anti").select(
        *[F.col(name) if c == name else F.col(f"__f.{c}") for c in files.columns])
