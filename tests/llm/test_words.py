"""Packing's ids against the tokenizer itself on odd texts, and toxic terms wherever they stand in a word."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import packing, toxicity
from attesta.llm.common import fold, prepared


def test_word_ids_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 200_000)      # several turnovers
    tokenizer, ids = Tokenizer.from_file(packing.vocabulary_path()), packing.WordIds(packing.vocabulary_path())
    rng = random.Random(21)
    letters = list("aBz'.,!@-_09 \n\t") + ["İ", "I", "ı", "ß", "Σ", "ς", "é", "é", "ǆ", "ﬁ", "日", "한", "ก", "े", "́", "\U0001F600",
                                          "<|endoftext|>", "ẞ", "Å", "Ω", "\xa0", "　", "'s", "'LL", "ŉ", "x" * 70]
    for at in range(0, 6000, 50):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(50)]
        for t, got in zip(texts, ids.texts(texts)):
            want = np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            assert got == want, repr(t)


def test_a_word_is_remembered_once_whatever_its_case_and_marks():
    ids = packing.WordIds(packing.vocabulary_path())
    marks = ["", ".", ",", "!", "!!", "?", "...", "$$$", "###", "%%%"]
    words = [f"{w}{m}" for w in ("plain", "Plain", "PLAIN", "pläin") for m in marks]
    texts = [" ".join(words), None, "", "  plain\n\nplain.  ", "<|endoftext|>. İ. H̱. don't. x" + "y" * 100]
    want = [np.array(ids.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts]
    raw, at = ids.column(pa.array(texts), np.array([2], "<u4").tobytes())
    assert [raw.to_pybytes()[a:b] for a, b in zip(at, at[1:], strict=False)] == want
    assert {w for w in ids if w[:2] == "pl"} == {"plain", "pläin"}    # one entry for each form before
    assert set(marks) - {""} < set(ids)


def test_pieces_of_long_texts_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", 3)
    prepared(spark)
    texts = ["one two, three. " * 9, "", None, "a b c d e f g h", "a b c d e f g"]   # one ends at a multiple of 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    got = {}
    for r in sorted(packing.pieces(docs, sequence=8).collect()):
        ids = np.array(tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2], "<u4")
        assert r["start"] == got.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
        assert r["length"] == min(8, len(ids) - r["start"])
        assert bytes(r["ids"]) == ids[r["start"]:r["start"] + 8].tobytes()
        got[r["doc_id"]] = r["start"] + r["length"]
    assert got == {0: 46, 1: 1, 2: 1, 3: 9, 4: 8}


def test_null_and_repeated_ids_spread_over_groups(spark):
    prepared(spark)
    rows = [(None, "one two three")] * 400 + [(7, "one two three")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("__row"))
    parts = packing.pieces(docs).withColumn("__row", F.lit(1))
    packed = packing.pack(parts, group_pieces=50).collect()
    assert len(packed) == 800
    groups = {}
    for r in packed:
        groups.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(groups) == 16 and max(map(len, groups.values())) < 100
    seen = {}
    for r in packed:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_words_behind_marks_are_words():
    words = lambda t: [toxicity.core_of(w) for w in toxicity.words_of(t, toxicity.split_stretch)]
    assert words("him,fool (and/or) wait") == ["him", "fool", "and", "or", "wait"]
    assert words("him—fool|fool;fool") == ["him", "fool", "fool", "fool"]
    assert words("'quoted' word") == ["quoted", "word"]
    assert words("") == [] and words("--- !!!") == ["", ""]
    assert toxicity.cores_of("stop.fool") == ["stop.fool", "stop", "fool"]
    assert "".join(toxicity.words_of("a,b;c!", toxicity.split_stretch)) == "a,b;c!"


def test_terms_are_found_behind_marks(spark):
    prepared(spark)
    rng = random.Random(16)
    rows, labels = [], []
    for k in range(400):
        words = [f"w{rng.randrange(2000)}" for _ in range(30)]
        if k % 4 == 0:
            words[5:5] = ["nitwit", "dunderhead", "blockhead"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    plain = " ".join(f"w{k}" for k in range(30))
    toxic = ["stop,nitwit", "him—dunderhead", "wait...blockhead", "stop.nitwit", "and/or/nitwit", "a-nitwit", "x_dunderhead", "(nitwit)", "w1,w2,w3,nitwit,w4"]
    rows += [(1000 + k, f"{plain} {t} {t}") for k, t in enumerate(toxic)]
    rows.append((2000, "，".join([plain.replace(" ", ","), "nitwit", "dunderhead"])))
    rows += [(3000 + k, t) for k, t in enumerate([plain, plain.replace(" ", ","), "a" * 100_000, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, marks, fold(3, 1), ~fold(3, 1)).collect()}
    assert all(got[1000 + k] == 1 for k in range(len(toxic))) and got[2000] == 1
    assert all(got[3000 + k] == 0 for k in range(5))
    empty = docs.limit(0)
    assert toxicity.score(empty, marks, fold(3, 1), ~fold(3, 1)).count() == 0
