"""The operators against brute force, and on nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import (components, context_mixing, decontaminate, deep_shallow, html_density, language_id,
                         order_minhash, packing, quality_lines, suffix_dedup, token_counts, toxicity)
from attesta.llm.common import fold, prepared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def make(spark):
    prepared(spark)

    def frame(texts, ids=None, lang="en"):
        ids = ids or range(len(texts))
        return spark.createDataFrame(
            [(i, t, lang, None, len(t) if t else None) for i, t in zip(ids, texts, strict=True)], DOCS)
    return frame


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t", "a", "one two three four", "x" * 3000, "é" * 60, "\U0001F600 smile", "Word, " * 400]


# quality rules

def brute_quality(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit))


def test_quality_counts_equal_brute_force(make):
    rng = random.Random(1)
    texts = ODD + [words_text(rng, n, v) + "\nsame line.\nsame line." for n in (5, 60, 300) for v in (3, 40, 4000)]
    got = {r["doc_id"]: r["quality"] for r in quality_lines.judge(make(texts)).collect()}
    for k, t in enumerate(texts):
        q = got[k]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute_quality(t)


def test_quality_lines_go_and_documents_with_them(make):
    rng = random.Random(0)
    prose = "\n".join(f"{words_text(rng, 12, 3000)}." for _ in range(12))
    menu = "\n".join("Home | News | Sports | Contact | About" for _ in range(40)) + "\n"
    marked = prose + "\nAll rights reserved.\nHome | News | Shop | Contact"
    out = {r["doc_id"]: r for r in quality_lines.clean(make([prose, menu + prose, marked, None, ""])).collect()}
    assert set(out) == {0, 2}
    assert out[0]["text"] == prose and out[2]["text"] == prose


def test_quality_with_clashing_names_and_no_rows(make, spark):
    df = make(["word " * 3]).withColumn("quality", F.lit(1)).withColumn("QUALITY_", F.lit(2))
    assert quality_lines.clean(df).columns == df.columns and quality_lines.clean(df).count() == 0
    assert quality_lines.judge(make([])).count() == 0


# html

PARAGRAPH = "A long sentence with many words in it, as a real article would surely have. " * 3


@pytest.mark.parametrize("page", [
    "<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{p}</p><p>{p}</p></article><footer>end</footer></body>",
    "<body><div id=menu><a>a</a><a>b</a></div><div class=content><h1>Title</h1><div><p>{p}</p></div><div><p>{p}</p>"
    "</div></div><div class='comments'><p>what a nice post this was</p></div></body>",
    "<html><body><form id=f><div class=sidebar>{p}</div><article><h1>Title<p><b>{p}<br><p>{p}</article></form>",
])
def test_html_main_text(page):
    p = " ".join(PARAGRAPH.split())
    assert html_density.main_text(page.replace("{p}", PARAGRAPH)) == f"Title\n{p}\n{p}"


def test_html_references_raw_and_cut_pages():
    assert html_density.main_text("<p>a&amp;b &lt;i&gt; &#233;&nbsp;x<script>if(a<b)'<p>no</p>'</script> end") == "a&b <i> é x end"
    for page in ("", None, "<p", "<!--", "<a href='", "</p></div>", "<p>" * 5000):
        assert html_density.main_text(page) == ""


def test_html_frame(spark, make):
    prepared(spark)
    pages = spark.createDataFrame([(1, "u", "<p>Hi there</p>", "x"), (2, None, None, "y"), (1, "u", "<p>Hi there</p>", "x")],
                                  "page_id long, url string, html string, text string")
    got = html_density.extract(pages).select("page_id", "extracted.text", "extracted.n_chars").collect()
    assert sorted(map(tuple, got)) == [(1, "Hi there", 8), (1, "Hi there", 8), (2, "", 0)]
    assert html_density.extract(pages.limit(0)).count() == 0


# packing

def test_packing_holds_every_id_once(make):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rng = random.Random(2)
    texts = ODD + ["It's o'clock İx ΣΑΣ. don't", words_text(rng, 9000), words_text(rng, 700)]
    rows = packing.packed(make(texts)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for k, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            part = ids[at:at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQUENCE


def test_first_fit_decreasing_equals_plain_search():
    rng = random.Random(3)
    for n in (0, 1, 7, 300):
        lengths = [rng.randint(1, 100) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(np.array(lengths), 100)
        used, want = [], {}
        for k in sorted(range(n), key=lambda k: -lengths[k]):
            b = next((b for b, u in enumerate(used) if u + lengths[k] <= 100), len(used))
            used += [0] * (b == len(used))
            want[k] = (b, used[b])
            used[b] += lengths[k]
        assert {k: (int(bins[k]), int(offsets[k])) for k in range(n)} == want


def test_packing_nothing(make):
    assert packing.packed(make([])).count() == 0


# suffix dedup

def brute_repeats(texts, ids):
    first = {}
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: x[0]):
        raw = (t or "").encode()
        for j in range(len(raw) - 49):
            first.setdefault(raw[j:j + 50], i)
    out = {}
    for i, t in zip(ids, texts, strict=True):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for j in range(len(raw) - 49):
            if first[raw[j:j + 50]] < i:
                gone[j:j + 50] = [True] * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(make):
    rng = random.Random(4)
    shared = [words_text(rng, 30, 50) for _ in range(6)]
    texts = list(ODD) + ["x" * 49, "x" * 50, "ab" * 40, "ab" * 200, "é" * 60]
    for _ in range(60):
        t = words_text(rng, rng.randint(0, 40), 60)
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, len(s))
            t += rng.choice(["", " ", "é"]) + s[:cut] + rng.choice(["", "Q"]) + s[cut:] + words_text(rng, rng.randint(0, 9), 60)
        texts.append(t)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = suffix_dedup.digest(suffix_dedup.find_repeats(make(texts, ids))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repeats(texts, ids)


def test_repeats_of_a_text_longer_than_a_chunk(make, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rng = random.Random(5)
    texts = [words_text(rng, 600, 3000) for _ in range(3)]
    texts.append(texts[0][900:2500] + texts[1][:400])
    found = []
    for parts in suffix_dedup.parts_of([t.encode() for t in texts]):
        found.append(suffix_dedup.Anchors().find(parts))
    k, p, g, e = map(np.concatenate, zip(*found, strict=True))
    monkeypatch.undo()
    whole = suffix_dedup.Anchors().find(next(suffix_dedup.parts_of([t.encode() for t in texts])))
    assert set(zip(k.tolist(), p.tolist(), g.tolist(), e.tolist(), strict=True)) == set(zip(*[x.tolist() for x in whole], strict=True))


def test_repeats_edge_cases(make, spark):
    text = "A passage that is repeated in several documents, and which has well over fifty bytes."
    df = make([text, text, "short", None], [None, 7, 7, 8]).withColumn("kept", F.lit(1)).withColumn("removed", F.lit(2))
    out = suffix_dedup.remove(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect() if r["text"] != "short") == [(7, text), (8, None)]
    assert suffix_dedup.find_repeats(make([])).count() == 0


def test_repeats_of_rows_that_share_an_id(make):
    rng = random.Random(6)
    shared = [words_text(rng, 30, 50) for _ in range(4)]
    texts, ids = [], []
    for i in (None, None, None, None, 7, 7, 7, 3, 5):
        t = words_text(rng, rng.randint(0, 30), 3000)
        for s in rng.sample(shared, 2):
            t += " " + s[rng.randint(0, 20):] + " " + words_text(rng, 20, 3000)
        texts.append(t)
        ids.append(i)
    texts += [texts[4], texts[0], shared[0]]   # equal rows, and a short text beside long ones
    ids += [7, None, None]
    ranks = [suffix_dedup.LAST_ID if i is None else i for i in ids]
    want = []
    for i, t in zip(ranks, texts, strict=True):
        raw, gone = t.encode(), [False] * len(t.encode())
        smaller = [o.encode() for j, o in zip(ranks, texts, strict=True) if j < i]
        for j in range(len(raw) - 49):
            if any(raw[j:j + 50] in o for o in smaller):
                gone[j:j + 50] = [True] * 50
        want.append((i, t, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    got = suffix_dedup.find_repeats(make(texts, ids)).collect()
    assert sorted((suffix_dedup.LAST_ID if r["doc_id"] is None else r["doc_id"], r["text"], bytes(r["kept"]))
                  for r in got) == sorted(want)
    assert any(len(k) < len(t) for _, t, k in want) and any(len(k) == len(t) for _, t, k in want)
    raw = [t.encode() for t in texts]
    numbers = suffix_dedup.numbers_of(np.full(len(raw), suffix_dedup.LAST_ID), raw)
    assert len(set(suffix_dedup.slots_of(numbers, 1000).tolist())) > len(raw) // 2


def test_deep_shallow_order(make):
    rng = random.Random(6)
    rows = [bytes(rng.choice(b"ab") for _ in range(50)) for _ in range(300)]
    rows += [b"c" * 30 + bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(300)] + [b"d" * 50] * 80
    rng.shuffle(rows)
    order = deep_shallow.suffix_order(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 50))
    assert sorted(order.tolist()) == list(range(len(rows)))
    assert [rows[k] for k in order] == sorted(rows)


# decontamination

def brute_contamination(texts, items):
    import re
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, seen = split(t), set(), set()
        for window, names in windows.items():
            n = len(window)
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) == window:
                    hit.update(range(k, k + n))
                    seen |= names
        named = sorted(str(x) for x in seen if x is not None)
        out.append((len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_contamination_equals_brute_force(make, spark, block):
    rng = random.Random(7)
    items = [(k, words_text(rng, n, 30)) for k, n in enumerate([0, 1, 5, 12, 13, 14, 40, 40])]
    items += [(7, "Other Text-with 7 words: and marks"), (None, words_text(rng, 20, 30)), (9, None)]
    texts = list(ODD) + [words_text(rng, 200, 5000), "OTHER text with 7 words and marks!"]
    texts += [words_text(rng, 20, 900) + " " + t.upper() + "-" + words_text(rng, 30, 900) for _, t in items if t]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make(texts).withColumn("contamination_", F.lit(1))
    got = sorted(map(tuple, decontaminate.verdict(decontaminate.find(docs, bench, block_bytes=block)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    assert [g[1:] for g in got] == brute_contamination(texts, items)


def test_contamination_removal(make, spark):
    passage = " ".join(f"b{k}" for k in range(13))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long = " ".join(f"c{k}" for k in range(600))
    docs = make([passage, long, f"{long} {passage}, tail", None]).withColumn("contamination", F.lit(3))
    out = decontaminate.remove(docs, bench)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: long, 2: f"{long} , tail", 3: None}
    assert decontaminate.remove(docs, bench.limit(0)).count() == 4
    assert decontaminate.remove(docs.limit(0), bench).count() == 0


# token counts

def test_token_counts_equal_plain_dynamic_programming(make):
    scores = token_counts.unigram_scores(token_counts.vocabulary_path())
    lowest = min(scores.values()) - 10

    def plain(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            options = [(best[i - 1][0] + size * lowest, -best[i - 1][1] - size)]
            options += [(best[j][0] + scores[word[j:i]], -best[j][1] - 1) for j in range(i) if word[j:i] in scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    texts = list(ODD) + ["The unigram model counts pieces; naïve façade 日本語"]
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(make(texts)).collect()}
    for k, t in enumerate(texts):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
        assert got[k] == (len(words), sum(plain("▁" + w) for w in words))


# near duplicates

def similarity(a, b):
    """1 - insertions and deletions of words / words of both, by the plain table of all prefixes."""
    a, b = a.lower().split(), np.array(b.lower().split())
    row = np.zeros(len(b) + 1, int)
    for w in a:
        row[1:] = np.maximum.accumulate(np.where(b == w, row[:-1] + 1, row[1:]))
    return 2 * row[-1] / max(1, len(a) + len(b))


def brute_classes(texts):
    """Classes by alignment of all pairs, and the linked pairs of different texts."""
    label, links = list(range(len(texts))), []
    bags = [Counter((t or "").lower().split()) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = texts[a] or "", texts[b] or ""
        if not x.split() or not y.split():
            continue
        possible = 2 * (bags[a] & bags[b]).total() >= 0.8 * (bags[a].total() + bags[b].total())
        if x == y or possible and min(len(x.split()), len(y.split())) >= 5 and similarity(x, y) >= 0.8:
            links.append((a, b))
            low, high = sorted((label[a], label[b]))
            label = [low if n == high else n for n in label]
    return label, links


def test_near_duplicates_equal_brute_force(make):
    rng = random.Random(8)
    texts = list(ODD) + ["one two three four", "One two  three four five six"]
    for _ in range(12):
        base = words_text(rng, rng.randint(60, 300), 5000).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 9, 0.05, 0.1):
            copy = base[:]
            for _ in range(int(edits if edits >= 1 else edits * len(base))):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base[len(base) // 2:] + base[:len(base) // 2]))        # the other way round: not linked
        texts.append(" ".join(base[:20] + words_text(rng, 150, 90_000).split()))     # a passage in common: not linked
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(make(texts)).collect()}
    label, _ = brute_classes(texts)
    assert got == dict(enumerate(label))


def test_near_duplicates_recall_by_similarity(make):
    """Pairs by themselves, so that nothing else joins them: words replaced, dropped and inserted at random."""
    rng = random.Random(18)
    for share, least in ((0.025, 1.0), (0.05, 0.99), (0.1, 0.98), (0.15, 0.95), (0.19, 0.7)):
        texts = []
        for _ in range(150):
            base = words_text(rng, rng.randint(150, 400), 90_000).split()
            copy = base[:]
            for k in rng.sample(range(len(base)), int(share * len(base))):
                copy[k] = rng.choice([f"n{rng.random()}", f"n{rng.random()}", "", f"{copy[k]} n{rng.random()}"])
            texts += [" ".join(base), " ".join(copy)]
        got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(make(texts)).collect()}
        _, links = brute_classes(texts)
        assert len(links) == 150
        found = sum(got[a] == got[b] for a, b in links)
        assert found >= least * len(links), (share, found)
        assert len(set(got.values())) >= len(texts) - len(links)


def test_near_duplicates_of_one_large_group(make):
    rng = random.Random(9)
    base = words_text(rng, 150, 9000).split()
    texts = []
    for k in range(400):
        copy = base[:]
        copy[rng.randrange(150)] = f"n{k}"
        texts.append(" ".join(copy))
    got = order_minhash.near_duplicates(make(texts + texts[:50], [*range(400), *range(50)])).collect()
    assert len(got) == 450 and {r["class_id"] for r in got} == {0}
    assert order_minhash.near_duplicates(make([])).count() == 0


def test_alignment_in_a_band(monkeypatch):
    rng = random.Random(10)
    for whole in (2048, 0):
        monkeypatch.setattr(order_minhash, "WHOLE", whole)
        monkeypatch.setattr(order_minhash, "BAND", 2)
        for _ in range(1500):
            letters = rng.choice([2, 6, 40])
            a = [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
            b = [rng.randrange(letters) for _ in range(rng.randint(0, 30))] if rng.random() < 0.5 else [
                w for w in a for w in rng.choice([[w], [w], [w], [], [w, rng.randrange(letters)]])]
            share = rng.choice([0.3, 0.5, 0.8, 0.9, 1.0])
            want = similarity(" ".join(map(str, a)), " ".join(map(str, b))) >= share - 1e-12
            x, y = np.array(a, np.uint64), np.array(b, np.uint64)
            if a and b:
                assert order_minhash.edit_similarity_reaches(x, y, share) == want, (a, b, share)


def test_keep_one_by_row(make, spark):
    base = " ".join(f"w{k}" for k in range(60))
    near, other = base.replace("w30", "x"), " ".join(f"v{k}" for k in range(60))
    ids = [1, 7, 7, None, None, 3, 3, 5, None, None]
    texts = [base, other, near, base, "alone in the world of words", other, other, None, "", "alone in the world of words"]
    kept = order_minhash.keep_one(make(texts, ids)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(
        [(1, base), (3, other), (5, None), (None, ""), (None, "alone in the world of words")], key=str)
    assert order_minhash.keep_one(make([])).count() == 0
    clashing = make(texts, ids).withColumnRenamed("lang", "label").withColumnRenamed("source", "__s")
    assert order_minhash.keep_one(clashing).columns == clashing.columns and order_minhash.keep_one(clashing).count() == 5


def test_components(spark):
    prepared(spark)
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for u, v in edges:
        if u != v:
            low, high = sorted((label[u], label[v]))
            label = {n: low if x == high else x for n, x in label.items()}
    assert got == label


# language

def test_language_network_gradients():
    network = language_id.Network(3, seed=1)
    rng = np.random.default_rng(0)
    data, labels = rng.integers(97, 110, (7, 5)), rng.integers(0, 3, 5)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    _, grads = network.gradients(data, labels)
    for key in ("hl", "hr", "out", "xl"):
        at = np.unravel_index(np.abs(grads[key]).argmax(), grads[key].shape)
        network.weights[key][at] += 1e-2
        up = network.gradients(data, labels)[0]
        network.weights[key][at] -= 2e-2
        down = network.gradients(data, labels)[0]
        network.weights[key][at] += 1e-2
        assert abs((up - down) / 2e-2 - grads[key][at]) < 0.02 * abs(grads[key][at]) + 1e-4


def test_language_on_held_out_texts(spark):
    prepared(spark)
    rng = random.Random(12)
    sounds = {"aa": ["ba", "lo", "ki", "tu"], "bb": ["sch", "ung", "ei", "ach"], "cc": ["ção", "ñe", "lh", "os"]}
    rows = []
    for k in range(150):
        lang = rng.choice(list(sounds))
        text = " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randint(20, 120)))
        rows.append((k, text, lang))
    rows += [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "", None), (1003, rows[0][1], None), (1003, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, fold(3, 1), ~fold(3, 1)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i]["lang_pred"] == "und" for i in (1000, 1001, 1002))
    held = [(by_id[i]["lang_pred"], lang) for i, _, lang in rows[:150] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language_id.identify(df, fold(3, 1), F.lit(False)).collect()} == {"und"}


# language model

def test_scores_equal_their_definition(make):
    rng = random.Random(13)
    texts = list(ODD) + [words_text(rng, rng.randint(0, 60), 80).replace("w1", "W1") for _ in range(60)]
    got = {r["doc_id"]: r for r in context_mixing.score(make(texts), fold(10, 0)).collect()}
    tokens = {k: (t or "").encode().lower().split() + [b""] for k, t in enumerate(texts)}
    out = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    counts = Counter(w for k, ws in tokens.items() if not out[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in tokens.items():
        r = got[k]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[k], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] <= 0


def test_spelling_is_a_probability():
    counts = [np.zeros((n, 2), np.int64) for n in context_mixing.TABLES]
    words = [b"ab", b"ba", b"abab", b""]
    for _, bit, slots in context_mixing.Spelling(words).bits():
        for c, s in zip(counts, slots, strict=True):
            np.add.at(c, (s, bit), 1)
    model = context_mixing.Model(counts).train(counts, words)
    # all strings of at most one byte, and what lies behind the first byte
    single = [bytes([b]) for b in range(256) if b not in b" \t\n\x0b\x0c\r"]
    total = np.exp(model.spell([b"", *single])).sum()
    assert 0 < total <= 1 + 1e-6
    assert model.spell([b"abab"])[0] > model.spell([b"zqzq"])[0]


def test_mixer_learns_from_all_training_words(make):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["ab", "cde", "f"]) for _ in range(60))  # noqa: E731  (over 64 bytes)
    texts = [" ".join(word() for _ in range(5)) if zlib.crc32(str(k).encode()) % 10 else word() for k in range(60)]
    out = [k for k in range(60) if zlib.crc32(str(k).encode()) % 10 == 0]
    known = sorted({w for k, t in enumerate(texts) if k not in out for w in t.encode().split()} | {b""})
    counts = [np.zeros((n, 2), np.int64) for n in context_mixing.TABLES]
    for _, bit, slots in context_mixing.Spelling(known).bits():
        for c, s in zip(counts, slots, strict=True):
            np.add.at(c, (s, bit), 1)
    spelt = context_mixing.Model(counts).train(counts, context_mixing.word_order(known)[0]).spell(
        [texts[k].encode() for k in out])
    for partitions in (1, 5):
        got = {r["doc_id"]: r["score"] for r in context_mixing.score(make(texts).repartition(partitions), fold(10, 0)).collect()}
        for k, x in zip(out, spelt, strict=True):   # one unknown word each: the rest of the scores is the same
            assert math.isclose(got[k] - got[out[0]], (x - spelt[0]) / math.log(10), rel_tol=1e-4, abs_tol=1e-3)


def test_a_byte_met_often_counts_as_often():
    rng = random.Random(32)
    words = [b"", *{"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode() for _ in range(300)}]
    whole, once = context_mixing.Spelling(words), context_mixing.Spelling(words).distinct()
    assert len(once.data) < len(whole.data) == once.times.sum()
    for (_, bit, slots), (_, bit_once, slots_once) in zip(whole.bits(), once.bits(), strict=True):
        assert (bit == bit_once[once.which]).all()
        assert all((s == o[once.which]).all() for s, o in zip(slots, slots_once, strict=True))
    counts = [np.full((n, 2), 3, np.int64) for n in context_mixing.TABLES]
    model = context_mixing.Model(counts).train(counts, words)
    assert model.met.sum() == 8 * len(whole.data) and math.isclose(model.near.sum(), model.met.sum(), rel_tol=1e-4)


def test_scores_without_training_rows(make):
    rows = context_mixing.score(make(["a b", None]), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in rows)
    assert context_mixing.score(make([]), fold(10, 0)).count() == 0


# toxicity

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_equal_edit_distance():
    rng = random.Random(14)
    terms = ["abcde", "abc", "bcdeab", "aabbccddee", "edcbaabcde"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0))
    for _ in range(800):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            word[rng.randrange(len(word)):rng.randrange(len(word) + 1)] = rng.choice(["", "a", "e", "x"])
            word = word or ["a"]
        word = "".join(word)
        allowed = [(edit_distance(t, word), t) for t in terms]
        allowed = [(d, t) for d, t in allowed if d <= (2 if len(t) >= 10 else 1 if len(t) >= 5 else 0)]
        got = lexicon.find(word)
        assert (got is None) == (not allowed), word
        if got:
            assert got[1] == min(allowed)[0]


def test_toxicity_on_held_out_rows(spark):
    prepared(spark)
    rng = random.Random(15)
    rows, labels = [], []
    for k in range(400):
        words = words_text(rng, rng.randint(20, 80), 3000).split()
        toxic = int(k % 4 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "dunderhead", "blockhaed"]))
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    rows += [(1000, None), (1001, ""), (1002, "you blokhead and nittwit"), (1002, "you blokhead and nittwit")]
    labels += [(5, 0), (9999, 1), (None, 1), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, marks, fold(3, 1), ~fold(3, 1)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(by_id[k] == int(k % 4 == 0) for k in held) >= 0.97 * len(held)
    assert by_id[1000] == by_id[1001] == 0 and by_id[1002] == 1
    none = toxicity.score(docs, marks.limit(0), fold(3, 1), ~fold(3, 1))
    assert {r["score"] for r in none.collect()} == {0.0}
