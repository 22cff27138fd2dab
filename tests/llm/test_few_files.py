"""Small working tables are a few files, however many partitions a shuffle has."""

import glob
import random

import pytest

from attesta.llm import order_minhash
from attesta.llm.common import files_for, prepared
from attesta.session import kept_tables


@pytest.fixture
def many_partitions(spark):
    prepared(spark)
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_tables_of_near_duplicates(spark, many_partitions):
    rng = random.Random(5)
    texts = []
    for _ in range(250):   # a text, one with another last word, and a copy
        body = [f"w{rng.randrange(100_000)}" for _ in range(40)]
        texts += [" ".join(body), " ".join([*body[:-1], "other"]), " ".join(body)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = set(kept_tables())
    kept = order_minhash.keep_one(docs)
    most = 2 * spark.sparkContext.defaultParallelism
    assert kept.rdd.getNumPartitions() <= most
    assert {r["doc_id"] for r in kept.collect()} == set(range(0, 750, 3))
    tables = [p.removeprefix("file:") for p in kept_tables() if p not in before]
    assert len(tables) >= 12
    assert all(0 < len(glob.glob(f"{p}/part-*.parquet")) <= most for p in tables)


def test_files_grow_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert files_for(spark.range(0), 10) == files_for(spark.range(20 * cores), 10) == 2 * cores
    assert files_for(spark.range(50 * cores + 1), 10) == 5 * cores + 1
