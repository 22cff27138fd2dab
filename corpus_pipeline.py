"""From documents to training sequences: quality rules, near-duplicates, repeated passages, benchmark
passages, packing. Each stage works on all that the one before kept."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontaminate, order_minhash, packing, quality_lines, suffix_dedup
from attesta.llm.common import keep, prepared, read
from attesta.session import drop_kept, kept_tables

#: Working tables of stages that have run. A stage's result is written before the next stage starts, which
#: then deletes them, unless the documents it is given still read them.
_LEFT: list[str] = []


def _staged(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_kept(spark, list(_LEFT), but=docs)
        before = set(kept_tables())
        _LEFT[:] = [path for path in _LEFT if path in before]
        out = stage(prepared(spark), docs, sf_dir)
        _LEFT.extend(path for path in kept_tables() if path not in before)
        return out
    return run_stage


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that were cut."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without the lines that fail them."""
    return _counted(quality_lines.clean(docs))


@_staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id."""
    return order_minhash.keep_one(docs)


@_staged
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller document holds; those wholly repeated go."""
    return _counted(suffix_dedup.remove(docs))


@_staged
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without single benchmark passages."""
    return _counted(decontaminate.remove(docs, read(spark, sf_dir, "benchmark")))


@_staged
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("suffix_dedup", repeats),
          ("decontamination", decontamination), ("packing", sequences)]

#: A tokenizer and byte strings that cross words are beyond SQL: the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    prepared(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
