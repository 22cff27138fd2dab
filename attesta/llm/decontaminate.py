"""Benchmark decontamination: a broadcast hash set of test n-grams meets every training window.

The benchmark is normalised, cut into windows of thirteen words (an item of fewer is one window) and
broadcast as sorted arrays, after its size was checked: a benchmark larger than ``BLOCK_BYTES`` is dealt
into blocks of about that size, and the documents, with what was found so far, pass all blocks in turn.
Words outside the benchmark cannot lie in a hit, so only stretches of benchmark words are hashed. A hash
hit is verified word by word. No document is shuffled.

Defined cases: null texts have no words, on either side; an item without words has no window; items
with an equal id are one item, an item without an id hits but is not named; repeated document rows are
judged each; other columns of the documents pass through.
"""

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, text_batches

WINDOW = 13
#: Bytes of benchmark text that are broadcast at once (their arrays take a few times as much).
BLOCK_BYTES = 16_000_000

#: Letters, digits and everything beyond ASCII, of text already in lower case.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = "hits array<long>, items array<string>, n_words long"


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a text: ``bytes.lower`` touches A-Z alone."""
    return WORD.findall(text.lower())


class WindowSet:
    """All windows of a block of items: by length, their hashes in order, their words and items."""

    def __init__(self, items, window: int = WINDOW):
        self.words, found = {}, {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1)
                   for w in words_of((text or "").encode("utf-8", "surrogatepass"))]
            length = min(window, len(ids))
            for at in range(len(ids) - length + 1 if length else 0):
                found.setdefault(length, {}).setdefault(tuple(ids[at:at + length]), set()).add(item)
        rng = np.random.default_rng(13)
        self.mix = rng.integers(1, 2**63, window, dtype=np.uint64) | np.uint64(1)
        self.by_length = {}
        for length, windows in sorted(found.items()):
            ids = np.array(list(windows), np.int64)
            hashes = self.hashed(ids)
            order = np.argsort(hashes, kind="stable")
            names = [sorted(x for x in s if x is not None) for s in windows.values()]
            self.by_length[length] = hashes[order], ids[order], [names[i] for i in order]

    def hashed(self, ids):
        mixed = ids.astype(np.uint64) * self.mix[:ids.shape[1]]
        mixed ^= mixed >> np.uint64(29)
        return (mixed * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64)

    def search(self, ids):
        """Where windows start in ``ids`` (0: no benchmark word): (start, length, items) of each hit."""
        outside = np.flatnonzero(ids == 0)
        edges = np.concatenate(([-1], outside, [len(ids)]))
        starts, room = edges[:-1] + 1, np.diff(edges) - 1
        for length, (hashes, windows, names) in self.by_length.items():
            enough = room >= length
            first, n = starts[enough], room[enough] - length + 1
            if not len(first):
                continue
            at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            for some in np.array_split(at, len(at) // 100_000 + 1):
                seen = ids[some[:, None] + np.arange(length)]
                h = self.hashed(seen)
                lo = np.searchsorted(hashes, h)
                # equal hashes of different windows stand side by side; nearly always there is one
                while True:
                    open_ = (lo < len(hashes)) & (hashes[np.minimum(lo, len(hashes) - 1)] == h)
                    if not open_.any():
                        break
                    k = np.flatnonzero(open_)
                    same = (windows[lo[k]] == seen[k]).all(axis=1)
                    for i, w in zip(some[k[same]].tolist(), lo[k[same]].tolist(), strict=True):
                        yield i, length, names[w]
                    lo = np.where(open_, lo + 1, len(hashes))


def merged(spans):
    """Sorted, disjoint, flattened [start, end) pairs of possibly overlapping spans."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int):
    """The benchmark in blocks of about ``most`` bytes, one at a time on the driver, and whether it is the last."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where(
        F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most) or 1
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in block.toArrow().to_pylist()], k == n - 1


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
         out: str = "contamination", then=None) -> DataFrame:
    """``docs`` with a struct ``out``: ``hits`` (word positions, flattened [start, end) pairs),
    ``items`` (ids as text, sorted) and ``n_words``. ``then``: what becomes of the Arrow batches of these rows
    before they leave their task, and the schema that gives. As a step behind this one it would hold a second Python
    worker for every task."""
    spark = docs.sparkSession
    struct = T.StructType.fromDDL(FOUND)
    name, out = out, docs.withColumn(out, F.struct(
        F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("long").alias("n_words")))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, struct)])
    arrow = pa.struct([("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("n_words", pa.int64())])
    for items, last in _blocks(benchmark, item_id, item_text, block_bytes):
        known = spark.sparkContext.broadcast(WindowSet(items, window))

        def scan(batches, known=known):
            windows = known.value
            for batch, texts in text_batches(batches, text):
                rows = [words_of(t) for t in texts]
                sizes = [len(r) for r in rows]
                # a 0 closes each document, so that no window runs on into the next
                ids = np.fromiter(map(windows.words.get, chain.from_iterable(
                    chain(r, (None,)) for r in rows), repeat(0)), np.int64, sum(sizes) + len(rows))
                ends = np.cumsum(np.array(sizes, np.int64) + 1)
                found = {}
                for at, length, names in windows.search(ids):
                    k = int(np.searchsorted(ends, at, side="right"))
                    spans, seen = found.setdefault(k, (set(), set()))
                    base = at - int(ends[k]) + sizes[k] + 1
                    spans.add((base, base + length))
                    seen.update(map(str, names))
                at = batch.schema.get_field_index(name)
                before = batch.column(at).to_pylist()
                now = []
                for k, (old, n) in enumerate(zip(before, sizes, strict=True)):
                    spans, seen = found.get(k, ((), ()))
                    kept = zip(old["hits"][::2], old["hits"][1::2], strict=True)
                    now.append({"hits": merged([*kept, *spans]), "items": sorted({*old["items"], *seen}), "n_words": n})
                columns = [*batch.columns[:at], pa.array(now, arrow), *batch.columns[at + 1:]]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        if last and then is not None:
            made, schema = then
            out = out.mapInArrow(lambda batches, scan=scan: made(scan(batches)), schema)
        else:
            out = out.mapInArrow(scan, schema)
    return out


def verdict(found: DataFrame) -> DataFrame:
    """The counts of ``find`` as columns, and the rule: contaminated if at least a twentieth is hit."""
    c = F.col("contamination")
    hit = F.aggregate(F.sequence(F.lit(1), F.size(c["hits"]), F.lit(2)), F.lit(0).cast("long"),
                      lambda a, i: a + F.get(c["hits"], i) - F.get(c["hits"], i - 1))
    n_hit = F.when(F.size(c["hits"]) == 0, 0).otherwise(hit).cast("long")
    return found.select(
        *[F.col(x) for x in found.columns if x != "contamination"], c["n_words"].alias("n_words"),
        n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= c["n_words"])).alias("contaminated"))


def cut_spans(text: str, hits) -> str:
    """A text without the words of ``hits`` and what lies between the words of one hit."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for a, b in zip(hits[::2], hits[1::2], strict=True):
        out.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with the spans of single hits cut out of their text."""
    name = free_name("contamination", docs)

    def cut(batches):
        for batch in batches:
            at, c = batch.schema.get_field_index(text), batch.schema.get_field_index(name)   # the last column
            kept, texts = [], []
            for i, (t, found) in enumerate(zip(batch.column(at).to_pylist(), batch.column(c).to_pylist(), strict=True)):
                hits = found["hits"]
                n_hit = sum(hits[1::2]) - sum(hits[::2])
                if n_hit and 20 * n_hit >= found["n_words"]:
                    continue
                kept.append(i)
                texts.append(cut_spans(t, hits) if hits else t)
            out = batch.drop_columns([name]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*out.columns[:at], pa.array(texts, out.column(at).type), *out.columns[at + 1:]],
                names=out.schema.names)

    return find(docs, benchmark, text, out=name, then=(cut, docs.schema), **options)
