"""Removing repeated byte strings across documents, on a sparse suffix array.

A byte goes if it is covered by a ``LENGTH``-byte string that also starts in a document with a smaller
id. Any such string holds an *anchor*: the start of its ``GRAM``-byte gram with the smallest hash (the
leftmost one). Equal strings have their anchor at the same place, so it is enough to compare anchored
suffixes, one in about fifteen.

1. Every document's anchors go to a bucket of their gram's hash, with a hash of their *surroundings*:
   all strings that hold the anchor lie in it. Surroundings seen in a smaller document are removed whole.
   Of equal surroundings only the smallest document's stay, and only if the gram has others: these are
   the ends of repeats and chance hits, a few in a hundred anchors.
2. For those, the surroundings themselves are fetched and their suffixes from the anchor on are ordered
   by deep-shallow sorting. Suffixes with a common prefix then stand together, and for each of the
   possible starts of a string around the anchor the smallest document with that string is found.
3. The spans of both steps meet their document, which is cut once.

Rows between the steps are packed arrays: a row per sender and receiver, not one per anchor. Texts are
compressed for their two trips. Buckets and slots grow in number with the input, so their sizes do not.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` bytes stay whole; a null id counts as
larger than all others (the largest 64-bit id counts as null); of rows with the same id, or without one,
none is smaller than another, and each is cut by its own text: rows are told apart by a hash of id and
text, ids only compare; other columns pass through. Rows equal in id and text meet in one slot.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, keep
from .deep_shallow import common_prefixes, suffix_order

LENGTH = 50
GRAM = 20
#: Grams of a string, and how far an anchor can lie from the start of its string.
WINDOWS = LENGTH - GRAM + 1
REACH = WINDOWS - 1
#: Bytes of text for a bucket and for a slot, on average.
BUCKET_BYTES = 8_000_000
SLOT_BYTES = 8_000_000
#: Bytes that are hashed at once, and anchors a sender gathers before it sends.
CHUNK = 1_000_000
GATHERED = 2_000_000
#: A null document id.
LAST_ID = 2**63 - 1

_BASE = 0xD6E8FEB86659FD93
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(x):
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def packed(*arrays) -> bytes:
    """Arrays as bytes, 16-bit planes apart, so that small numbers compress."""
    out = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        out.append(a.tobytes() if a.itemsize == 1 else
                   np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint16).reshape(len(a), -1).T).tobytes())
    return b"".join(out)


def unpacked(data: bytes, *kinds):
    sizes = np.frombuffer(data, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        kind = np.dtype(kind)
        raw = np.frombuffer(data, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        out.append(raw.view(kind) if kind.itemsize == 1 else
                   np.ascontiguousarray(raw.view(np.uint16).reshape(-1, n).T).view(kind).reshape(n))
    return out


def numbers_of(ids, texts):
    """A number of each row, from its id and text: ids may be null or repeat with other texts."""
    out = []
    for i, text in zip(ids.tolist(), texts, strict=True):
        h = hashlib.blake2b(i.to_bytes(8, "little", signed=True), digest_size=8)
        h.update(text or b"")
        out.append(int.from_bytes(h.digest(), "little", signed=True))
    return np.array(out, np.int64)


def slots_of(numbers, slots: int):
    """The slot a row's number belongs to."""
    return (_mixed(np.asarray(numbers, np.int64).view(np.uint64)) % np.uint64(slots)).astype(np.int64)


def _own(whose, numbers, i, number):
    """Where, in marks sorted by ``numbers``, those of one row are."""
    lo, hi = np.searchsorted(numbers, number, "left"), np.searchsorted(numbers, number, "right")
    return lo + np.flatnonzero(whose[lo:hi] == i)


class Anchors:
    """Finds anchors of many texts in one go; keeps the powers of the hash's base."""

    def __init__(self, most: int = CHUNK + 400):
        self.power = self.inverse = None
        self.grow(most)

    def grow(self, n):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(n, _BASE, np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(_BASE, -1, 2**64), np.uint64))

    def find(self, parts):
        """Of parts (document number, text, first and end window start): document, place, gram hash and
        surroundings hash of each anchor, in text order."""
        lows, offsets, firsts, ends, tops, raw, at = [], [], [], [], [], [], 0
        for _, text, first, end in parts:
            low = max(0, first - REACH)
            high = min(len(text), end + LENGTH + REACH)
            raw.append(text[low:high])
            lows.append(low)
            offsets.append(at)
            firsts.append(at + first - low)
            ends.append(at + end - low)
            at += high - low
            tops.append(at)
        n = at
        if n > len(self.power):
            self.grow(n)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(7)) * self.power[:n], out=sums[1:])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * self.inverse[:n - GRAM + 1])
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        least, size = key, 1
        while 2 * size <= WINDOWS:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        starts = len(grams) - WINDOWS + 1
        least = np.minimum(least[:starts], least[WINDOWS - size:WINDOWS - size + starts])
        inside = np.zeros(starts + 1, np.int32)
        np.add.at(inside, firsts, 1)
        np.add.at(inside, ends, -1)
        place = (least[np.cumsum(inside[:-1]) > 0] & _LOW).astype(np.int64)
        place = place[np.append(True, place[1:] != place[:-1])]
        part = np.searchsorted(np.array(offsets), place, side="right") - 1
        low = np.maximum(np.array(offsets)[part], place - REACH)
        high = np.minimum(np.array(tops)[part], place + LENGTH)
        around = _mixed((sums[high] - sums[low]) * self.inverse[low]
                        + (high - low).astype(np.uint64) * _ODD + (place - low).astype(np.uint64))
        documents = np.array([p[0] for p in parts])[part]
        return documents, place - np.array(offsets)[part] + np.array(lows)[part], grams[place], around


def parts_of(texts):
    """Chunks of (number, text, first, end) with about ``CHUNK`` window starts; long texts are split."""
    chunk, size = [], 0
    for k, text in enumerate(texts):
        for first in range(0, len(text) - LENGTH + 1, CHUNK):
            end = min(first + CHUNK, len(text) - LENGTH + 1)
            if chunk and size + end - first > CHUNK:
                yield chunk
                chunk, size = [], 0
            chunk.append((k, text, first, end))
            size += end - first + LENGTH
    if chunk:
        yield chunk


def _send(buckets, ids, numbers, places, grams, around):
    """Gathered anchors as one row per bucket: runs of a document, then place steps and hashes."""
    bucket = ((grams & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        k = order[lo:hi]
        i, r, p, g, e = ids[k], numbers[k], places[k], grams[k] >> np.uint64(24), around[k]
        new = np.append(True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (p[1:] < p[:-1]))
        run = np.flatnonzero(new)
        step = p.copy()
        step[1:] -= p[:-1]
        step[run] = p[run]
        yield int(bucket[lo]), packed(
            np.diff(i[run], prepend=np.int64(0)), r[run], np.diff(np.append(run, len(k))).astype(np.uint32),
            step.astype(np.uint64), (g & _LOW).astype(np.uint32), (g >> np.uint64(32)).astype(np.uint8),
            (e & _LOW).astype(np.uint32), (e >> np.uint64(48)).astype(np.uint16))


def _received(rows):
    """Document, row number, place, gram and surroundings of all anchors sent to a bucket."""
    out = []
    for data in rows:
        ids, numbers, counts, step, g_low, g_high, e_low, e_high = unpacked(
            data, np.int64, np.int64, np.uint32, np.uint64, np.uint32, np.uint8, np.uint32, np.uint16)
        counts = counts.astype(np.int64)
        total = np.cumsum(step.astype(np.int64))
        first = np.cumsum(counts) - counts
        base = total[first] - step[first].astype(np.int64)
        out.append((np.repeat(np.cumsum(ids), counts), np.repeat(numbers, counts), total - np.repeat(base, counts),
                    g_low.astype(np.uint64) | (g_high.astype(np.uint64) << np.uint64(32)),
                    e_low.astype(np.uint64) | (e_high.astype(np.uint64) << np.uint64(32))))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def judge_anchors(ids, numbers, places, grams, around):
    """Anchors to act on: (id, row number, place, whole), whole where a smaller document has the surroundings."""
    order = np.lexsort((ids, around, grams))
    ids, numbers, places, grams, around = ids[order], numbers[order], places[order], grams[order], around[order]
    new_gram = np.append(True, grams[1:] != grams[:-1])
    new = new_gram | np.append(True, around[1:] != around[:-1])
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    group = np.cumsum(new_gram) - 1
    several = np.bincount(group[new])[group] > 1
    whole = ids > least
    acted = whole | several
    return ids[acted], numbers[acted], places[acted], whole[acted]


def judge_suffixes(ids, numbers, places, before, after, around):
    """Spans (id, row number, start, end) that a smaller document has, from anchors with their surroundings."""
    left, right = around[:, :REACH], around[:, REACH:]
    order = suffix_order(np.ascontiguousarray(right))
    lcp = common_prefixes(right, order)
    ids, numbers, places, before, after, left = (x[order] for x in (ids, numbers, places, before, after, left))
    smallest = np.full(len(ids), LENGTH, np.int64)   # shift of the first and the last string to go
    largest = np.full(len(ids), -1, np.int64)
    behind = np.zeros(len(ids), np.uint64)
    for shift in range(REACH + 1):   # strings that start ``shift`` bytes before the anchor
        if shift:
            behind = _mixed(behind + left[:, REACH - shift].astype(np.uint64) + np.uint64(shift * int(_ODD) % 2**64))
        at = np.flatnonzero((before >= shift) & (after >= LENGTH - shift))
        if not len(at):
            continue
        group = np.cumsum(lcp < LENGTH - shift)[at]
        by = np.lexsort((ids[at], behind[at], group))
        at, group = at[by], group[by]
        new = np.append(True, (group[1:] != group[:-1]) | (behind[at[1:]] != behind[at[:-1]]))
        least = ids[at[np.flatnonzero(new)]][np.cumsum(new) - 1]
        gone = at[ids[at] > least]
        smallest[gone] = np.minimum(smallest[gone], shift)
        largest[gone] = shift
    gone = largest >= 0
    return ids[gone], numbers[gone], places[gone] - largest[gone], places[gone] + LENGTH - smallest[gone]


def _by_slot(slots, ids, numbers, *arrays):
    if not len(ids):
        return
    slot = slots_of(numbers, slots)
    order = np.lexsort((numbers, ids, slot))
    slot, ids, numbers = slot[order], ids[order], numbers[order]
    arrays = [a[order] for a in arrays]
    edges = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    for lo, hi in zip(edges, [*edges[1:], len(slot)], strict=True):
        yield int(slot[lo]), packed(ids[lo:hi], numbers[lo:hi], *[a[lo:hi] for a in arrays])


_SENT = pa.schema([("to", pa.int64()), ("whole", pa.bool_()), ("data", pa.binary())])
_SENT_DDL = "to long, whole boolean, data binary"


def _sent(rows):
    rows = list(rows)
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(_SENT.types)], schema=_SENT)


def _ids(column):
    return np.array([LAST_ID if i is None else i for i in column.to_pylist()], np.int64)


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: str = "kept",
                 removed: str = "removed", then=None) -> DataFrame:
    """``docs`` with the remaining bytes as ``kept``, and ``removed`` (flattened [start, end) byte places).
    ``then``: what becomes of each Arrow table of these rows before it leaves its task, and the schema that gives. As
    a step behind this one it would hold a second Python worker for every task."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, slots = -(-size // BUCKET_BYTES) or 1, -(-size // SLOT_BYTES) or 1
    columns = docs.columns
    at_id, at_text = columns.index(doc_id), columns.index(text)

    def send_anchors(batches):
        finder, gathered, n = Anchors(), [], 0
        for batch in batches:
            ids = _ids(batch.column(0))
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            numbers = numbers_of(ids, texts)
            for parts in parts_of(texts):
                k, *found = finder.find(parts)
                gathered.append((ids[k], numbers[k], *found))
                n += len(k)
                if n >= GATHERED:
                    yield from _sent((b, False, d) for b, d in _send(
                        buckets, *map(np.concatenate, zip(*gathered, strict=True)))).to_batches()
                    gathered, n = [], 0
        if gathered:
            yield from _sent((b, False, d) for b, d in _send(
                buckets, *map(np.concatenate, zip(*gathered, strict=True)))).to_batches()

    def judge_bucket(table):
        ids, numbers, places, whole = judge_anchors(*_received(table.column("data").to_pylist()))
        return _sent((s, w, d) for w in (True, False)
                     for s, d in _by_slot(slots, ids[whole == w], numbers[whole == w], places[whole == w]))

    def compressed(batches):
        for batch in batches:
            raw = [t if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column(at_text).to_pylist()]
            texts = [pa.compress(t, "zstd", asbytes=True) if t else b"" for t in raw]
            sizes = [t if t is None else len(t) for t in raw]
            numbers = numbers_of(_ids(batch.column(at_id).cast(pa.int64())), raw)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(slots_of(numbers, slots)), pa.array(numbers), pa.array(sizes, pa.int64()),
                 pa.array(texts, pa.binary())], names=[*columns, "__slot", "__number", "__size", "__bytes"]).drop_columns([text])

    def texts_of(table):
        for k, (n, data) in enumerate(zip(table.column("__size").to_pylist(), table.column("__bytes").to_pylist(), strict=True)):
            yield k, pa.decompress(data, n, "zstd", asbytes=True) if n else b""

    def fetch(docs, marks):
        ids, numbers = _ids(docs.column(doc_id).cast(pa.int64())), docs.column("__number").to_numpy()
        marked = [unpacked(d, np.int64, np.int64, np.int64) for d in marks.column("data").to_pylist()]
        if not marked or not len(ids):
            return _sent(())
        whose, which, places = map(np.concatenate, zip(*marked, strict=True))
        order = np.argsort(which, kind="stable")
        whose, which, places = whose[order], which[order], places[order]
        out, seen = [], set()
        for k, raw in texts_of(docs):
            own = _own(whose, which, ids[k], numbers[k])
            if not len(own) or (ids[k], numbers[k]) in seen:
                continue
            seen.add((ids[k], numbers[k]))
            p, n = places[own], len(raw)
            reach = p[:, None] + np.arange(-REACH, LENGTH)
            around = np.frombuffer(raw, np.uint8)[np.clip(reach, 0, n - 1)]
            around[(reach < 0) | (reach >= n)] = 0
            out.append((whose[own], which[own], p, np.minimum(p, REACH).astype(np.uint8),
                        np.minimum(n - p, LENGTH).astype(np.uint8), around))
        if not out:
            return _sent(())
        i, r, p, before, after, around = map(np.concatenate, zip(*out, strict=True))
        gram = np.zeros(len(i), np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(_BASE) + around[:, REACH + k].astype(np.uint64) + np.uint64(1)
        bucket = (_mixed(gram) % np.uint64(buckets)).astype(np.int64)
        rows = []
        for b in np.unique(bucket).tolist():
            k = np.flatnonzero(bucket == b)
            rows.append((b, False, packed(i[k], r[k], p[k], before[k], after[k], around[k].reshape(-1))))
        return _sent(rows)

    def order_bucket(table):
        got = [unpacked(d, np.int64, np.int64, np.int64, np.uint8, np.uint8, np.uint8) for d in table.column("data").to_pylist()]
        i, r, p, before, after, around = map(np.concatenate, zip(*got, strict=True))
        ids, numbers, starts, ends = judge_suffixes(i, r, p, before.astype(np.int64), after.astype(np.int64),
                                           around.reshape(len(i), REACH + LENGTH))
        return _sent((s, False, d) for s, d in _by_slot(slots, ids, numbers, starts, ends))

    result = T.StructType([*docs.schema.fields, T.StructField(kept, T.BinaryType()),
                           T.StructField(removed, T.ArrayType(T.LongType()))])

    def cut(docs, marks):
        spans = []
        for whole, data in zip(marks.column("whole").to_pylist(), marks.column("data").to_pylist(), strict=True):
            if whole:
                i, r, p = unpacked(data, np.int64, np.int64, np.int64)
                spans.append((i, r, p - REACH, p + LENGTH))
            else:
                spans.append(unpacked(data, np.int64, np.int64, np.int64, np.int64))
        whose, which, starts, ends = (map(np.concatenate, zip(*spans, strict=True)) if spans
                                      else (np.empty(0, np.int64),) * 4)
        order = np.argsort(which, kind="stable")
        whose, which, starts, ends = whose[order], which[order], starts[order], ends[order]
        ids, numbers = _ids(docs.column(doc_id).cast(pa.int64())), docs.column("__number").to_numpy()
        left, gone_at, texts, sizes = [], [], [], docs.column("__size").to_pylist()
        for k, raw in texts_of(docs):
            own = _own(whose, which, ids[k], numbers[k])
            texts.append(None if sizes[k] is None else raw.decode("utf-8", "surrogatepass"))
            if not len(own):
                left.append(raw)
                gone_at.append([])
                continue
            depth = np.zeros(len(raw) + 1, np.int32)
            np.add.at(depth, np.clip(starts[own], 0, len(raw)), 1)
            np.add.at(depth, np.clip(ends[own], 0, len(raw)), -1)
            gone = np.cumsum(depth[:-1]) > 0
            left.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            gone_at.append(edge.tolist())
        whole = {c: docs.column(c) for c in columns if c != text}
        whole[text] = pa.chunked_array([pa.array(texts, pa.string())])
        return pa.table([*[whole[c] for c in columns], pa.array(left, pa.binary()), pa.array(gone_at, pa.list_(pa.int64()))],
                        names=[*columns, kept, removed])

    slotted = T.StructType([*[f for f in docs.schema.fields if f.name != text], T.StructField("__slot", T.LongType()),
                            T.StructField("__number", T.LongType()), T.StructField("__size", T.LongType()), T.StructField("__bytes", T.BinaryType())])
    dealt = docs.mapInArrow(compressed, slotted)
    anchors = narrow.mapInArrow(send_anchors, _SENT_DDL)
    marks = keep(anchors.groupBy("to").applyInArrow(judge_bucket, _SENT_DDL), "marks")
    open_ = marks.where("NOT whole").groupBy("to")
    around = dealt.groupBy("__slot").cogroup(open_).applyInArrow(fetch, _SENT_DDL)
    ends = around.groupBy("to").applyInArrow(order_bucket, _SENT_DDL)
    spans = marks.where("whole").union(ends)
    slot = dealt.groupBy("__slot").cogroup(spans.groupBy("to"))
    if then is None:
        return slot.applyInArrow(cut, result)
    made, schema = then
    return slot.applyInArrow(lambda docs, marks: made(cut(docs, marks)), schema)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """What ``find_repeats`` did to each document, in numbers."""
    cuts = F.size("removed")
    gone = F.aggregate(F.sequence(F.lit(1), cuts, F.lit(2)), F.lit(0).cast("long"),
                       lambda a, i: a + F.get("removed", i) - F.get("removed", i - 1))
    gone = F.when(cuts == 0, 0).otherwise(gone).cast("long")
    return found.select(doc_id, (F.octet_length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"),
                        (cuts / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the remaining text; a document that is repeated whole goes. A character of which
    only some bytes remain goes too."""
    kept, removed = free_name("kept", docs), free_name("removed", docs)
    columns = docs.columns

    def decode(table):
        at, left, cuts = (table.column(c).to_pylist() for c in (text, kept, removed))
        rows = [k for k, (b, r) in enumerate(zip(left, cuts, strict=True)) if b or not r]
        texts = [at[k] if not cuts[k] else left[k].decode("utf-8", "ignore") for k in rows]
        others = table.drop_columns([text, kept, removed]).take(pa.array(rows, pa.int64()))
        return pa.table([pa.array(texts, pa.string()) if c == text else others.column(c) for c in columns], names=columns)

    return find_repeats(docs, doc_id, text, kept, removed, then=(decode, docs.schema))
