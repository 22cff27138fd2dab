"""Near duplicates in buckets that a common passage fills: every candidate pair is settled."""

import itertools
import random

import numpy as np

from attesta.llm import order_minhash as om
from attesta.llm.common import prepared


def test_all_pairs_of_a_common_passage(spark, monkeypatch):
    """Pairs just above 0.8 among texts that share a passage, against all pairs that share a sketch; small blocks."""
    prepared(spark)
    monkeypatch.setattr(om, "BLOCK_NODES", 40, raising=False)
    rng = random.Random(8)
    passage, texts = [f"p{k}" for k in range(24)], []
    for _ in range(200):
        body = [f"w{rng.randrange(100_000)}" for _ in range(rng.randint(40, 90))]
        other = list(body)
        for k in rng.sample(range(len(body)), round(0.19 * (len(body) + 24))):
            other[k] = f"x{rng.randrange(100_000)}"
        texts += [" ".join(passage + body), " ".join(passage + other)]
    rng.shuffle(texts)
    words = [om.WordHashes().of(t.encode()) for t in texts]
    sketches = [om.sketch_of(om.labelled(om.shingles(w))) for w in words]
    want = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (sketches[a] == sketches[b]).any() and om.alike(words[a], words[b]):
            old, new = max(want[a], want[b]), min(want[a], want[b])
            want = [new if x == old else x for x in want]
    assert sum(k != c for k, c in enumerate(want)) > 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in om.near_duplicates(docs).collect()} == dict(enumerate(want))


def test_words_rule_out_no_near_duplicates(monkeypatch):
    monkeypatch.setattr(om, "BINS", 64)
    rng = random.Random(9)
    words = [om.WordHashes().of(" ".join(sorted(rng.choices("abcde", k=rng.randint(5, 30)))).encode()) for _ in range(120)]
    n = np.array([len(w) for w in words])
    none = np.zeros(len(words), bool)
    found = om.possible(np.arange(120), np.arange(120), n, none, none.astype(np.int32), np.stack([om.word_counts(w) for w in words]))
    met = {(u, v) for u, vs in found for v in vs.tolist()}
    like = {(a, b) for a, b in itertools.combinations(range(120), 2) if om.alike(words[a], words[b])}
    assert like and like <= met
    assert (om.word_counts(np.zeros(70_000, np.uint64)) == 2**16 - 1).all()
