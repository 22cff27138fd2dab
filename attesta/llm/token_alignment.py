"""Cross-tokenizer alignment by divide and conquer at shared cuts.

A text is cut into tokens by two tokenizers, A (byte-level BPE) and B (pieces with byte fallback). Byte
offsets where tokens of both end are shared cuts; between neighbouring cuts lies a group, and every A token
of a group is linked with every B token of it.

* **Divide.** Both tokenizers end a token before a single space between two visible characters: A's pattern
  starts a pre-token there, and no piece of B goes on past a space (checked when the model is loaded; a
  model for which that fails is not divided so). The text falls into segments there, and equal segments of a
  chunk are one subproblem.
* **Conquer.** Within a segment, a shared end near the middle is located by bisecting B's ends for A's,
  outward from the middle; both halves are treated alike, and what was searched in vain is not searched
  again. An interval without a shared end is a leaf: one group. The intervals of all segments of a chunk go
  down together, level by level.

How often a pair of ids is linked is counted over all documents. A *chunk* of documents (``CHUNK_BYTES`` of
text; a longer text is a chunk of its own) is written with its distinct pairs, so that each chunk asks for the
count of a pair once and what travels is pairs by chunk, not links. The counts come back to the chunk by
its number.

Defined cases: null and empty texts, and texts whose tokens don't join to space + text in either tokenizer
(such as those that hold U+2581), have no tokens: zeros and ``''``. Rows with equal or null ids are
documents of their own. An empty table gives an empty result. Other columns are not carried.
"""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Text bytes whose pairs are asked for together.
CHUNK_BYTES = 4 << 20
#: A group with more links than this is counted by its distinct ids.
LARGE = 4096
#: A pair of ids as one number: A's times this, plus B's.
B_IDS = 1 << 15

#: Segments given to a tokenizer in one string.
AT_ONCE = 250

_SPLIT, _DOUBLE = re.compile(r"(?<=\S)(?= \S)"), re.compile(r"\s\s")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def shared_cuts(a, b, first, last):
    """Places in ``a`` and in ``b`` (rising end offsets) of shared ends, in order, within the intervals
    ``first`` to ``last`` (places in ``a``, the last one excluded); all intervals are halved together."""
    found, i, j = [], np.asarray(first, np.int64), np.asarray(last, np.int64)

    def shared(at):
        y = np.minimum(np.searchsorted(b, a[at]), len(b) - 1)
        return b[y] == a[at]

    keep_ = i < j
    i, j = i[keep_], j[keep_]
    left = (i + j) // 2
    right = left + 1
    while len(i):
        hit_left = left >= i
        hit_left[hit_left] = shared(left[hit_left])
        hit_right = ~hit_left & (right < j)
        hit_right[hit_right] = shared(right[hit_right])
        found += [left[hit_left], right[hit_right]]
        # a cut leaves two intervals; what lies between left and right is known to hold none
        new_i = np.concatenate((i[hit_left], right[hit_left], i[hit_right], right[hit_right] + 1))
        new_j = np.concatenate((left[hit_left], j[hit_left], left[hit_right], j[hit_right]))
        go_on = ~hit_left & ~hit_right
        left, right = left[go_on] - 1, right[go_on] + 1
        i, j = i[go_on], j[go_on]
        on = (left >= i) | (right < j)
        keep_ = new_i < new_j
        new_i, new_j = new_i[keep_], new_j[keep_]
        middle = (new_i + new_j) // 2
        i, j = np.concatenate((i[on], new_i)), np.concatenate((j[on], new_j))
        left, right = np.concatenate((left[on], middle)), np.concatenate((right[on], middle + 1))
    cuts = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    return cuts, np.searchsorted(b, a[cuts])


class Pair:
    """The two tokenizers, and their tokens as bytes."""

    def __init__(self, byte_bpe: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(byte_bpe, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.a_bytes[r] = t
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(names) > B_IDS or len(self.a_bytes) * B_IDS >= 2**31:
            raise ValueError("pairs of ids don't fit 31 bits")
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode()
                        for i, n in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.divided = not any("▁" in n.lstrip("▁") for n in names)
        # an id of A, then of B, each as written within its side of a group and as its last
        self.written = [f"{i}{mark}".encode() for ids, marks in ((len(self.a_bytes), ",|"), (len(names), ",;"))
                        for i in range(ids) for mark in marks]

    def segments(self, text: str) -> list[str]:
        """The segments of space + text, each without the space it starts with."""
        if not self.divided:
            return [text]
        if text[0].isspace() or text[-1] == " " or _DOUBLE.search(text):
            return [s[1:] for s in _SPLIT.split(" " + text)]
        return text.split(" ")      # every space stands between two visible characters

    def tokens(self, texts: list[str]):
        """Ids of A and B over several texts, each with a space put before it (B adds it by itself), or None if
        they don't join to that."""
        a = [i for t in texts for i in self.a.encode_ordinary(" " + t)]
        b = [i for ids in self.b.encode(texts, num_threads=1) for i in ids]
        whole = "".join([" " + t for t in texts]).encode("utf-8", "surrogatepass")
        joined = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if joined else None


def _distinct(x, count=False):
    """The distinct values of ``x``, sorted, and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return (x[first], np.diff(first, append=len(x))) if count else x[first]


def _spread(starts, rows):
    """The places of all entries of the given rows of a table stored as starts, one row after the other."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - (ends - sizes), sizes), sizes


def _starts(sizes):
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


class Solved:
    """Distinct segments, aligned: ``totals`` (tokens of A, of B, groups, links) of each, ``groups`` as text
    (None if the tokens don't join to it), and its distinct ``pairs`` with their ``links`` from ``starts`` on."""

    def __init__(self, pair: Pair, segments: list[str]):
        # those that read the same when put one after the other are read in one go
        plain = [i for i, s in enumerate(segments) if s and not s[0].isspace() and not s[-1].isspace()
                 and "▁" not in s] if pair.divided else []
        read = pair.tokens([" ".join([segments[i] for i in plain[k:k + AT_ONCE]])
                            for k in range(0, len(plain), AT_ONCE)]) if plain else None
        if read is None:
            plain, read = [], ([], [])
        alone, failed, taken = [], [], set(plain)
        a, b = [np.array(read[0], np.int64)], [np.array(read[1], np.int64)]
        for i, s in enumerate(segments):
            if i not in taken:
                found = pair.tokens([s])
                if found is None:
                    failed.append(i)
                else:
                    alone.append(i)
                    a.append(np.array(found[0], np.int64))
                    b.append(np.array(found[1], np.int64))
        order = np.array(plain + alone, np.int64)
        a, b = np.concatenate(a), np.concatenate(b)
        a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
        ends = np.cumsum([1 + len(segments[i].encode("utf-8", "surrogatepass")) for i in order.tolist()], dtype=np.int64)
        a_last, b_last = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        a_first, b_first = _starts(np.diff(a_last + 1, prepend=0)), _starts(np.diff(b_last + 1, prepend=0))
        cut_a, cut_b = shared_cuts(a_ends, b_ends, a_first[:-1], a_last)
        group_a, group_b = np.union1d(cut_a, a_last), np.union1d(cut_b, b_last)      # last tokens of groups
        n_a, n_b = np.diff(group_a + 1, prepend=0), np.diff(group_b + 1, prepend=0)
        of = np.searchsorted(a_last, group_a)                                        # group -> place in order
        self._links(a, b, group_a + 1 - n_a, group_b + 1 - n_b, n_a, n_b, order[of], len(segments))
        self.totals = np.zeros((len(segments), 4), np.int64)
        self.totals[order] = np.stack([np.diff(a_first), np.diff(b_first), np.bincount(of, minlength=len(order)),
                                       np.bincount(of, n_a * n_b, len(order)).astype(np.int64)], 1)
        # written out: the A tokens of a group, then its B tokens
        places = np.empty(len(a) + len(b), np.int64)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[group_a], ends_b[group_b] = 1, 1
        places[np.arange(len(a)) + np.repeat(group_b + 1 - n_b, n_a)] = 2 * a + ends_a
        places[np.arange(len(b)) + np.repeat(group_a + 1, n_b)] = 2 * (len(pair.a_bytes) + b) + ends_b
        words = list(map(pair.written.__getitem__, places.tolist()))
        cuts = (a_first + b_first).tolist()
        self.groups = [None] * len(segments)
        for k, i in enumerate(order.tolist()):
            self.groups[i] = b"".join(words[cuts[k]:cuts[k + 1]])

    def _links(self, a, b, from_a, from_b, n_a, n_b, segment, segments):
        sizes = n_a * n_b
        large = np.flatnonzero(sizes > LARGE)
        sizes[large] = 0
        group = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = a[from_a[group] + within // n_b[group]] * B_IDS + b[from_b[group] + within % n_b[group]]
        keys, links = _distinct(segment[group] << 32 | codes, count=True)
        more = Counter()
        for g in large.tolist():
            y = Counter(b[from_b[g]:from_b[g] + n_b[g]].tolist()).items()
            for p, n in Counter(a[from_a[g]:from_a[g] + n_a[g]].tolist()).items():
                for q, m in y:
                    more[int(segment[g]) << 32 | p * B_IDS + q] += n * m
        if more:
            keys = np.concatenate((keys, np.fromiter(more, np.int64, len(more))))
            links = np.concatenate((links, np.fromiter(more.values(), np.int64, len(more))))
            keys, at = np.unique(keys, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, links)
            links = total
        self.pairs, self.links = keys & 0xFFFFFFFF, links
        self.starts = np.searchsorted(keys, np.arange(segments + 1) << 32)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(byte_bpe: str, pieces: str) -> Pair:
    """The tokenizers of this worker: loaded once, as a worker runs many tasks."""
    if (byte_bpe, pieces) not in _PAIRS:
        _PAIRS[byte_bpe, pieces] = Pair(byte_bpe, pieces)
    return _PAIRS[byte_bpe, pieces]


CHUNK = ("chunk long, codes array<int>, holding array<int>, doc_id array<long>, lengths array<long>, counts binary, "
         "groups binary, segment_at binary, segment_pairs binary, segment_links binary, doc_at binary, "
         "doc_segments binary, doc_times binary")
_CHUNK = pa.schema([("chunk", pa.int64()), ("codes", pa.list_(pa.int32())), ("holding", pa.list_(pa.int32())),
                    ("doc_id", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                    *[(c, pa.binary()) for c in ("counts", "groups", "segment_at", "segment_pairs", "segment_links",
                                                 "doc_at", "doc_segments", "doc_times")]])


class Numbers(dict):
    """The distinct segments of a chunk, numbered as they come."""

    def __missing__(self, segment):
        self[segment] = number = len(self)
        return number


def _packed(x) -> bytes:
    """Whole numbers, as differences and compressed."""
    return pa.compress(np.diff(x, prepend=0).astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, size: int):
    return np.cumsum(np.frombuffer(pa.decompress(x, 8 * size, codec="zstd", asbytes=True), np.int64))


def _chunk(number: int, ids, texts, pair: Pair):
    """One chunk as a row: its distinct pairs with the number of its documents that hold them, its segments
    by their pairs, its documents by their segments."""
    numbers = Numbers()
    lists = [np.fromiter(map(numbers.__getitem__, pair.segments(t)), np.int64) if t else np.empty(0, np.int64)
             for t in texts]
    solved = Solved(pair, list(numbers))
    groups = solved.groups
    failed = {i for i, g in enumerate(groups) if g is None}
    if failed:
        lists = [x[:0] if not failed.isdisjoint(x.tolist()) else x for x in lists]
    shas = b"".join(hashlib.sha256(b"".join([groups[i] for i in x.tolist()])[:-1]).digest() if len(x) else bytes(32)
                    for x in lists)
    sizes = np.array([len(x) for x in lists], np.int64)
    of = np.repeat(np.arange(len(lists)), sizes)
    every = np.concatenate(lists) if lists else np.empty(0, np.int64)
    counts = np.stack([np.bincount(of, solved.totals[every, c], len(lists)) for c in range(4)], 1).astype(np.int64)
    keys, times = _distinct(of << 32 | every, count=True)
    doc, segment = keys >> 32, keys & 0xFFFFFFFF
    places, sizes = _spread(solved.starts, segment)
    held = _distinct(np.repeat(doc, sizes) << 32 | solved.pairs[places]) & 0xFFFFFFFF
    codes, holding = _distinct(held, count=True)
    # pairs by their place among the chunk's codes (those of texts left out have none that is used)
    at = np.searchsorted(codes, solved.pairs)
    lengths = [len(solved.starts), len(at), len(lists) + 1, len(segment)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([codes.astype(np.int32)], pa.list_(pa.int32())),
         pa.array([holding.astype(np.int32)], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64())),
         pa.array([lengths], pa.list_(pa.int64())), pa.array([counts.tobytes()]), pa.array([shas]),
         *[pa.array([_packed(x)]) for x in (solved.starts, at, solved.links,
                                            _starts(np.bincount(doc, minlength=len(lists))), segment, times)]], schema=_CHUNK)


def chunks(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """``docs`` (doc_id, text) in chunks of aligned documents."""
    def aligned(batches):
        pair, ids, texts, size = pair_of(byte_bpe, pieces), [], [], 0
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and size + len(t or "") > CHUNK_BYTES:
                    yield _chunk(number, ids, texts, pair)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield _chunk(number, ids, texts, pair)

    return docs.select("doc_id", "text").mapInArrow(aligned, CHUNK)


def _digest(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one chunk, from the counts of its pairs."""
    order = np.argsort(answers["code"].to_numpy())          # the chunk's codes, in its own order
    count = np.append(answers["count"].to_numpy()[order], 0)
    best = np.append(answers["best"].to_numpy()[order], -1)
    row = {c: chunk[c][0].as_py() for c in chunk.column_names}
    ids, (n_starts, n_pairs, n_docs, n_segments) = row["doc_id"], row["lengths"]
    starts = _unpacked(row["segment_at"], n_starts)
    pairs, links = _unpacked(row["segment_pairs"], n_pairs), _unpacked(row["segment_links"], n_pairs)
    sums = np.concatenate(([0], np.cumsum(links * count[pairs])))
    tops = np.concatenate(([0], np.cumsum(links * (count[pairs] == best[pairs]))))
    by_segment = np.stack([np.diff(tops[starts]), np.diff(sums[starts])], 1)
    segment, times = _unpacked(row["doc_segments"], n_segments), _unpacked(row["doc_times"], n_segments)
    running = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(by_segment[segment] * times[:, None], 0)))
    found = np.diff(running[_unpacked(row["doc_at"], n_docs)], axis=0)
    counts, shas = np.frombuffer(row["counts"], np.int64).reshape(-1, 4), row["groups"]
    hexes = [shas[32 * i:32 * i + 32].hex() if counts[i, 0] else "" for i in range(len(ids))]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), **{c: counts[:, k] for k, c in enumerate(_COUNTS)},
                     "n_best": found[:, 0], "count_sum": found[:, 1], "groups_sha256": pa.array(hexes, pa.string())})


def pair_counts(kept: DataFrame) -> DataFrame:
    """``code``, ``count`` (documents that hold the pair linked) and ``best``, the highest count of its A id."""
    counts = (kept.select(F.explode(F.arrays_zip("codes", "holding")).alias("p"))
              .groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.holding").alias("count"))
              .withColumn("a", F.floor(F.col("code") / B_IDS)))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    return counts.join(best, "a").select("code", "count", "best")


def align(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): tokens, groups, links and what their counts add up to.

    ``byte_bpe`` is a ranks file of A, ``pieces`` a model file of B, both at the same place on every executor."""
    kept = keep(chunks(docs, byte_bpe, pieces), "chunks")
    counts = keep(pair_counts(kept), "pairs")
    asked = kept.select(F.col("chunk").alias("asking"), F.explode("codes").alias("code")).join(counts, "code").select(
        "asking", "code", "count", "best")
    return kept.drop("codes", "holding").groupBy("chunk").cogroup(asked.groupBy("asking")).applyInArrow(
        _digest, RESULT)


def links(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """The alignment itself, one row per document: ``doc_id`` and ``groups`` of (``a``, ``b``) ids, null if
    the tokens don't join to the text."""
    def aligned(batches):
        pair = pair_of(byte_bpe, pieces)
        for batch in batches:
            texts, numbers, out = batch.column(1).to_pylist(), Numbers(), []
            lists = [[numbers[s] for s in pair.segments(t)] if t else [] for t in texts]
            groups = Solved(pair, list(numbers)).groups
            for x in lists:
                parts = [groups[i] for i in x]
                out.append(None if None in parts else [
                    {"a": list(map(int, a.split(b","))), "b": list(map(int, b.split(b",")))}
                    for part in parts for a, b in (g.split(b"|") for g in part[:-1].split(b";"))])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.struct([("a", ints), ("b", ints)])))],
                names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(
        aligned, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")
