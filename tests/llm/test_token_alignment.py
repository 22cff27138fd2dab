"""Alignment against tokenizers run on whole texts and plain loops over all offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attesta.llm import token_alignment
from attesta.llm.common import prepared

RANKS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokens():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = dict(zip([chr(c) for c in shown], shown)) | {
        chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def both(text):
        one = a.encode(" " + text, add_special_tokens=False)
        two = b.encode(text)
        names = [b.id_to_piece(i) for i in two]
        return (one.ids, [bytes(byte_of[c] for c in t) for t in one.tokens], two,
                [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode()
                 for i, n in zip(two, names)])
    return both


def brute_groups(text, tokens):
    if not text:
        return None
    a, one, b, two = tokens(text)
    whole = (" " + text).encode()
    if b"".join(one) != whole or b"".join(two) != whole:
        return None
    ends = []
    for parts in (one, two):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        ends.append(out)
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for cut in shared:
        groups.append(([i for i, e in zip(a, ends[0]) if low < e <= cut], [i for i, e in zip(b, ends[1]) if low < e <= cut]))
        low = cut
    return groups


def brute(texts, tokens):
    found = [brute_groups(t, tokens) for t in texts]
    linked = [Counter((a, b) for g in gs or [] for a in g[0] for b in g[1]) for gs in found]
    counts = Counter(p for pairs in linked for p in pairs)
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for gs, pairs in zip(found, linked):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs or [])
        out.append((sum(len(a) for a, _ in gs or []), sum(len(b) for _, b in gs or []), len(gs or []), sum(pairs.values()),
                    sum(n for p, n in pairs.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in pairs.items()),
                    hashlib.sha256(said.encode()).hexdigest() if gs else ""))
    return out


ODD = [None, "", " ", "  ", "\n", "a", "a▁b", "<|endoftext|> <s> <0x0A>", "▁", "x" * 3000, "=" * 999, "\U0001F600 \U0001F468‍\U0001F469", "中文" * 300,
       "a  b   c\t\td \n e", "can't won't I'LL", "tab\x1c sep\x85 nb\xa0sp 　wide", "caf\xe9 é İstanbul", "\x00 nul", "ภาษาไทย" * 40]
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def fuzz(rng):
    letters = "ab the ing \xe9中\U0001F600\n\t.'0İ 　\xa0\x1c\x85<>_-=(){}"
    return "".join(rng.choice(letters) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(1, 60)))


def test_alignment_equals_whole_texts(spark, tokens, monkeypatch):
    prepared(spark)
    rng = random.Random(12)
    texts = ODD + ["the same text"] * 3 + [fuzz(rng) for _ in range(400)]
    docs = spark.createDataFrame([(k if k % 7 else None, t, "x") for k, t in enumerate(texts)],
                                 "doc_id long, text string, code string")
    want = Counter(zip([k if k % 7 else None for k in range(len(texts))], brute(texts, tokens)))
    got = token_alignment.align(docs, RANKS, MODEL).collect()
    assert Counter((r["doc_id"], tuple(r[c] for c in NAMES)) for r in got) == want
    listed = token_alignment.links(docs.where("doc_id is not null"), RANKS, MODEL).collect()
    for r in listed:
        gs = brute_groups(texts[r["doc_id"]], tokens)
        assert (r["groups"] or None) == (None if gs is None else [(a, b) for a, b in gs])


def test_segments_and_large_groups_give_the_same(tokens, monkeypatch):
    monkeypatch.setattr(token_alignment, "LARGE", 2)
    pair = token_alignment.Pair(RANKS, MODEL)
    rng = random.Random(3)
    for _ in range(60):
        texts = [fuzz(rng) for _ in range(rng.randint(1, 9))]
        for t in texts:
            segments = list(dict.fromkeys(pair.segments(t)))
            solved = token_alignment.Solved(pair, segments)
            groups = [solved.groups[segments.index(s)] for s in pair.segments(t)]
            gs = brute_groups(t, tokens)
            assert (gs is None) == (None in groups)
            if gs is not None:
                assert b"".join(groups)[:-1].decode() == ";".join(
                    f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
                got = Counter()
                for s in pair.segments(t):
                    i = segments.index(s)
                    for c, n in zip(solved.pairs[solved.starts[i]:solved.starts[i + 1]], solved.links[solved.starts[i]:solved.starts[i + 1]]):
                        got[int(c) // token_alignment.B_IDS, int(c) % token_alignment.B_IDS] += int(n)
                assert got == Counter((a, b) for g in gs for a in g[0] for b in g[1])


def test_cuts_of_uneven_intervals():
    def cuts(a, b, first=(0,), last=None):
        x, y = token_alignment.shared_cuts(np.array(a), np.array(b), first, last or [len(a)])
        assert [a[i] for i in x] == [b[i] for i in y]
        return [a[i] for i in x]
    assert cuts([1, 5, 9], [2, 5, 9]) == [5, 9]
    assert cuts([9], [9]) == [9]
    a = [1, 2, 3, *range(10, 2000, 2), 2001]
    b = [1, 2, 3, *range(11, 2001, 2), 2001]
    assert cuts(a, b) == [1, 2, 3, 2001]
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([*sorted(rng.sample(range(1, 40), rng.randint(0, 30))), 40] for _ in range(2))
        assert cuts(a, b) == sorted(set(a) & set(b))
        k = rng.randint(0, len(a))
        assert cuts(a, b, [0, k], [k, len(a)]) == sorted(set(a) & set(b))


def test_empty_table(spark):
    prepared(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(docs, RANKS, MODEL).collect() == []
