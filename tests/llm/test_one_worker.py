"""A stage of the pipeline asks for one Python worker for each task: what follows a Python step without a shuffle
in between belongs to that step."""

import pytest

from attesta.llm import decontaminate, order_minhash, packing, suffix_dedup
from attesta.llm.common import prepared


def python_steps(df):
    """The most Python steps in one stage of a plan."""
    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        below = [walk(node.children().apply(k)) for k in range(node.children().size())]
        here = max((n for n, _ in below), default=0) + ("Arrow" in name or "Pandas" in name or "Python" in name)
        most = max([here, *(m for _, m in below)])
        return (0 if "Exchange" in name else here), most
    return walk(df._jdf.queryExecution().executedPlan())[1]


@pytest.fixture
def tables(spark):
    prepared(spark)
    passage = " ".join(f"word{k}" for k in range(30))
    texts = [(1, f"first {passage} end"), (2, f"second {passage}"), (2, f"second {passage}"), (3, passage),
             (None, f"none {passage} x"), (4, None), (5, ""), (6, "é" + passage + "ü")]
    docs = spark.createDataFrame([("x", d, n) for n, d in texts], "lang string, text string, doc_id long")
    items = [("a", "alpha beta gamma"), ("b", "word3 word4"), (None, " ".join(f"word{k}" for k in range(13)))]
    return docs, spark.createDataFrame(items, "item_id string, text string")


def test_repeats(tables):
    docs, _ = tables
    out = suffix_dedup.remove(docs)
    assert out.schema.names == docs.schema.names and python_steps(out) == 1
    passage = " ".join(f"word{k}" for k in range(30))
    assert sorted(((r["doc_id"] or 99), r["text"]) for r in out.collect() if r["doc_id"] != 4) == [
        (1, f"first {passage} end"), (2, "second"), (2, "second"), (5, ""), (6, "éü"), (99, "nonex")]
    assert [r["text"] for r in out.where("doc_id = 4").collect()] == [None]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 100])
def test_benchmark(tables, block):
    docs, bench = tables
    out = decontaminate.remove(docs, bench, block_bytes=block)
    assert out.schema.names == docs.schema.names
    if block > 100:
        assert python_steps(out) == 1
    found = decontaminate.verdict(decontaminate.find(docs, bench, block_bytes=block))
    assert sorted((r["doc_id"] or 99) for r in out.collect()) == sorted(
        (r["doc_id"] or 99) for r in found.where("not contaminated").collect()) == [4, 5]


def test_other_stages(tables):
    docs, _ = tables
    assert python_steps(order_minhash.keep_one(docs)) <= 1 and python_steps(packing.packed(docs)) <= 1
