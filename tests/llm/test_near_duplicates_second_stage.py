"""The second candidate stage of near duplicates by itself: nothing meets in a star."""

import random

from attesta.llm import order_minhash
from attesta.llm.common import keep, prepared


def words_text(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def test_second_stage_equals_brute_force(spark, monkeypatch):
    prepared(spark)
    rng = random.Random(3)
    texts = []
    for _ in range(12):   # a line three times, once, and other text around the same passage
        body, line = words_text(rng, 100), words_text(rng, 20)
        texts += [body + 3 * line, body + line, body[:60] + line + words_text(rng, 40)]
    for _ in range(150):   # short texts that differ in the last word
        body = words_text(rng, rng.randint(13, 14))
        texts += [body, body[:-1] + ["other"], body[:7] + words_text(rng, 6)]
    texts = [" ".join(t) for t in texts]
    hashes = order_minhash.WordHashes()
    words = [hashes.of(t.encode()) for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a // 3 * 3, a):
            if want[a] == a and order_minhash.alike(words[a], words[b]):
                want[a] = want[b]
    assert sum(k != c for k, c in enumerate(want)) > 150
    spark_docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark_docs).collect()} == dict(enumerate(want))
    # without the stars, pairs of a bucket of two meet as smallest and largest
    monkeypatch.setattr(order_minhash, "keep", lambda df, name: keep(df.limit(0) if name == "stars" else df, name))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark_docs).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    linked = [i for i, c in enumerate(want) if c != i]
    assert sum(got[i] == want[i] for i in linked) > 0.9 * len(linked)
