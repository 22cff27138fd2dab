"""The pipeline's stages keep their contract on a small table with nulls, copies and passages."""

import random

import pytest

import corpus_pipeline
from attesta.llm.common import prepared


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    prepared(spark)
    rng = random.Random(1)
    text = lambda n: "\n".join(" ".join(f"word{rng.randrange(4000)}" for _ in range(12)) + "." for _ in range(n))
    bench = " ".join(f"bench{k}" for k in range(20))
    passage = text(6)
    base = text(20)
    rows = [(0, base), (1, base), (2, base.replace("word1 ", "changed ")), (3, text(9) + "\n" + passage), (4, passage + "\n" + text(9)),
            (5, text(10) + "\n" + bench + "."), (6, "junk### " * 80), (7, None), (8, ""), (9, text(30)), (10, "too short.")]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", None, len(t) if t else None) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows), passage


def test_stages(spark, tables, tmp_path):
    path, texts, passage = tables
    docs, columns, kept = spark.read.parquet(f"{path}/documents.parquet"), None, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        columns = columns or before.columns
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert set(kept[0]) == {0, 1, 2, 3, 4, 5, 9}
    assert set(kept[1]) == {0, 3, 4, 5, 9}
    assert kept[2][3] == texts[3] and passage[:60] not in kept[2][4] and set(kept[2]) == set(kept[1])
    assert set(kept[3]) == {0, 3, 4, 9}
    assert {r["doc_id"] for r in docs.collect()} == {0, 3, 4, 9}
    assert corpus_pipeline.run(spark, path).count() == docs.count()


def test_stages_on_no_rows(spark, tables):
    path, _, _ = tables
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0
