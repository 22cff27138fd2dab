"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's k-mers are its five-word shingles (words between white space, A-Z in lower case), each labelled
with its occurrence. Each of ``FUNCTIONS`` hash functions takes the two smallest labelled k-mers and keeps
them in text order, so texts that hold the same shingles in another order differ. Texts that share one such
sketch fall into one bucket and are candidates.

A candidate pair is linked if an alignment of its words finds an edit similarity of at least 0.8: one less
the share of words to insert or delete among the words of both. The alignment is banded: only words at most so far
apart in the two texts are matched, and the band widens until it decides. Classes are the connected components
of the links and of equal texts.

What is kept bounded:

* equal texts are one node, by an aggregate combined before the shuffle; from then on nodes are numbers;
* in each bucket every node meets one of them, the smallest: as many pairs as rows, and few distinct ones, as a
  cluster's smallest node is the same in all its buckets;
* in buckets that still hold several components, nodes meet the largest one as well, and those that agree in another
  sketch too, which joins most of what belongs together;
* in buckets that hold several components even then, as those of a passage that unrelated texts share, every two nodes
  of different components are compared. Lengths, and words counted by hash, rule out nearly all such pairs without their
  texts. Large buckets are dealt in blocks, each pair of blocks to a task, so memory is bounded; time is quadratic in
  the number of components that share one passage;
* pairs whose lengths rule out 0.8 are dropped before texts are read; a pair's texts travel once.

Candidates come by chance of the sketches: with words replaced at random a pair shares each sketch with the
square of its shingles' Jaccard similarity: at an edit similarity of 0.9 with about one sketch in six, at 0.8 with one
in 26. Tests ask for 98 % of single pairs at 0.9 and 70 % at 0.81.
Texts that share no five words in a row are not found. Texts whose paragraphs are reordered are not linked:
that is what the order is for.

Defined cases: null, empty and one- to four-word texts are linked to equal texts only, texts without a
word to none. A row is told apart by id and text: rows with one id and different texts are different documents;
in ``keep_one`` one of several rows equal in both stays. Null ids are larger than all others. Other columns
are not carried (``near_duplicates``) or come along under their names (``keep_one``).
"""

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, kept_tables
from .common import files_for, free_name, keep, text_batches
from .components import EDGES, components

SHINGLE = 5
SIMILARITY = 0.8
FUNCTIONS, MINIMA = 64, 2
#: In how many other sketches the nodes of a mixed bucket may agree.
COMPANIONS = 2
#: Bytes of words a worker remembers the hashes of, and the longest word remembered.
REMEMBERED_BYTES, SHORT = 16 << 20, 64
#: Hash values computed at once.
BLOCK = 200_000
#: Texts up to this length are aligned in one band; the first band of longer ones.
WHOLE, BAND = 2048, 128

#: Texts or sketches of a written file, and pairs that one task aligns.
TEXTS, PAIRS = 5_000, 1_000
#: Nodes, or words, of a block whose pairs are compared together, and into how many counts a text's words go.
BLOCK_NODES, BLOCK_WORDS, BINS = 16_000, 4_000_000, 256
#: Base of the classes of lengths: two near duplicates are of one class or of two that follow each other.
LENGTHS = 1.51

#: In place of the number of words of a text without one.
NO_WORDS = -1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(7)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FLIP = _RNG.integers(0, 2**32, FUNCTIONS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(x):
    x = x ^ (x >> np.uint64(31))
    x = x * _ODD
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """Hashes of words; short ones are remembered up to a number of bytes."""

    size = 0

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= SHORT:
            self.size += len(word) + 160
            if self.size > REMEMBERED_BYTES:
                self.clear()
                self.size = len(word) + 160
            self[word] = h
        return h

    def of(self, text: bytes):
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words):
    """Hashes of a text's shingles in text order: none for fewer than five words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += words[k:k + n] * _PLACE[k]
    return _mixed(out)


def labelled(kmers):
    """K-mers with their occurrence worked in: the second of two equal ones is another value."""
    order = np.argsort(kmers, kind="stable")
    again = np.flatnonzero(kmers[order[1:]] == kmers[order[:-1]]) + 1
    if not len(again):
        return kmers
    occurrence = np.zeros(len(kmers), np.uint64)
    run = np.ones(len(kmers), bool)
    run[again] = False
    first = np.maximum.accumulate(np.where(run, np.arange(len(kmers)), 0))
    occurrence[order] = np.arange(len(kmers)) - first
    return np.where(occurrence > 0, _mixed(kmers + occurrence * _ODD), kmers)   # first ones as in a text without repeats


def sketch_of(kmers):
    """The sketches of a text, from its labelled k-mers."""
    n = len(kmers)
    sketch = np.empty(FUNCTIONS, np.uint64)
    if n < MINIMA:
        sketch[:] = kmers[0]
    else:
        short = (kmers >> np.uint64(32)).astype(np.uint32)
        step = max(1, BLOCK // n)
        for at in range(0, FUNCTIONS, step):
            h = (short ^ _FLIP[at:at + step, None]) * _TIMES[at:at + step, None]
            rows = np.arange(len(h))
            one = h.argmin(axis=1)
            h[rows, one] = np.uint32(0xFFFFFFFF)
            two = h.argmin(axis=1)
            sketch[at:at + step] = _mixed(kmers[np.minimum(one, two)] * _PLACE[0]
                                          + kmers[np.maximum(one, two)] * _PLACE[1])
    return _mixed(sketch + np.arange(FUNCTIONS, dtype=np.uint64)).view(np.int64)


def _places(a) -> dict[int, list[int]]:
    places = {}
    for i, w in enumerate(a.tolist()):
        places.setdefault(w, []).append(i)
    return places


def _common(a, b) -> int:
    """The most words of ``a`` and ``b`` that can be matched in order, by one bit for each word of ``a``."""
    masks = {w: sum(1 << i for i in at) for w, at in _places(a).items()}
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        met = row & masks.get(w, 0)
        if met:
            row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _common_in_band(a, b, band: int) -> int:
    """The same for matches at most ``band`` places apart: the bits of a window that moves along."""
    places, n = _places(a), len(a)
    full = (1 << (2 * band + 1)) - 1
    row, matched = full, 0              # bit k stands for the word j - band + k of a
    for j, w in enumerate(b.tolist()):
        if j:
            low = j - 1 - band          # the word that leaves the window keeps what it has
            if low >= 0 and not row & 1:
                matched += 1
            row = (row >> 1) | (1 << (2 * band))
        at, met = places.get(w), 0
        if at:
            for k in range(bisect_left(at, j - band), len(at)):
                if at[k] > j + band:
                    break
                met |= 1 << (at[k] - j + band)
        met &= row
        if met:
            row = ((row + met) | (row - met)) & full
    low = len(b) - 1 - band
    inside = row >> max(0, -low)
    return matched + max(0, min(n - max(low, 0), 2 * band + 1 - max(0, -low))) - (
        inside & ((1 << max(0, n - max(low, 0))) - 1)).bit_count()


def edit_similarity_reaches(a, b, similarity: float = SIMILARITY) -> bool:
    """Whether ``1 - d / (len(a) + len(b))`` is at least ``similarity``, with d insertions and deletions."""
    total = len(a) + len(b)
    need = int(np.ceil(similarity * total / 2 - 1e-9))        # words matched in order
    if min(len(a), len(b)) < need:
        return False
    head = min(len(a), len(b))
    differ = np.flatnonzero(a[:head] != b[:head])
    start = int(differ[0]) if len(differ) else head
    a, b = a[start:], b[start:]
    tail = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - tail:][::-1] != b[len(b) - tail:][::-1])
    end = int(differ[0]) if len(differ) else tail
    a, b = a[:len(a) - end], b[:len(b) - end]
    need -= start + end
    if need <= 0:
        return True
    # no more than the words that both hold, in whatever order
    one, n = np.unique(a, return_counts=True)
    two, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    if int(np.minimum(n[i], m[j]).sum()) < need:
        return False
    if len(a) <= WHOLE or len(b) <= WHOLE:
        return (_common(a, b) if len(a) <= len(b) else _common(b, a)) >= need
    most = len(a) + len(b) - 2 * need        # an alignment with so many edits stays within as many places
    band = min(most, max(BAND, 2 * abs(len(a) - len(b))))
    while True:
        if _common_in_band(a, b, band) >= need:
            return True
        if band >= most:
            return False
        band = min(most, 4 * band)


def alike(a, b, similarity: float = SIMILARITY) -> bool:
    """Whether two texts, as word hashes, are near duplicates."""
    return len(a) > 0 and len(b) > 0 and edit_similarity_reaches(a, b, similarity)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``node`` (which text), ``n`` words and ``sketch`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int64()),
                        ("sketch", pa.list_(pa.int64()))])

    def sketched(batches):
        hashes = WordHashes()
        for batch, texts in text_batches(batches):
            sizes, found = [], []
            for t in texts:
                words = hashes.of(t)
                kmers = shingles(words)
                sizes.append(len(words) or NO_WORDS)
                found.append(sketch_of(labelled(kmers)) if len(kmers) else ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return docs.select("doc_id", "node", "text").mapInArrow(
        sketched, "doc_id long, node binary, n long, sketch array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are near duplicates."""
    joined = (pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
              .join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
              .select("u", "v", "a", "b"))

    def verify(batches):
        hashes, last, words = WordHashes(), None, None
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a = a.as_py()
                if a != last:
                    last, words = a, hashes.of(a.encode("utf-8", "surrogatepass"))
                good.append(alike(words, hashes.of(b.as_py().encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(verify, "u long, v long")


def word_counts(words):
    """How many words' hashes fall into each of ``BINS``. If a count is too large, no pair is ruled out."""
    counts = np.bincount((words & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return np.full(BINS, 2**16 - 1, np.uint16) if counts.max() >= 2**16 else counts.astype(np.uint16)


def possible(ids, labels, n, guests, blocks, counts):
    """The pairs of nodes that may be near duplicates by their lengths and words: not of one label, not of two guests,
    and of different blocks where there are two. Yields the place of a node and those of its partners after it."""
    two = blocks.min() != blocks.max()
    wide = counts.astype(np.int32)
    for k in range(len(ids) - 1):
        m = n[k + 1:]
        fits = (labels[k + 1:] != labels[k]) & (np.minimum(m, n[k]) >= SIMILARITY * (m + n[k]) / 2 - 1e-9)
        if two:
            fits &= blocks[k + 1:] != blocks[k]
        if guests[k]:
            fits &= ~guests[k + 1:]
        at = np.flatnonzero(fits) + k + 1
        if len(at):
            shared = np.minimum(wide[at], wide[k]).sum(axis=1)
            at = at[shared >= SIMILARITY * (n[at] + n[k]) / 2 - 1e-9]
            if len(at):
                yield k, at


def links_of(ids, labels, n, guests, blocks, places, sketches, words):
    """Links (u, v) that join what is alike among the nodes of a bucket, as many as it takes: nodes joined already need
    no further one. A pair that shares several buckets is aligned in the first of them alone."""
    root = {x: x for x in labels.tolist()}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, at in possible(ids, labels, n, guests, blocks, np.stack([word_counts(w) for w in words])):
        first = (sketches[at] == sketches[k]).argmax(axis=1) == places[k]
        for j in at[first].tolist():
            one, two = top(int(labels[k])), top(int(labels[j]))
            if one != two and alike(words[k], words[j]):
                root[one] = two
                yield min(ids[k], ids[j]), max(ids[k], ids[j])


def _groups(batches, keys: int):
    """The rows of each group, equal in the first ``keys`` columns, of sorted batches, as one table."""
    parts, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)], axis=1)
        edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if parts and last != at[lo].tolist():
                yield pa.Table.from_batches(parts)
                parts = []
            last = at[lo].tolist()
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts)


def _linked_in_buckets(placed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between nodes of different labels that meet in a bucket, of ``placed`` (bucket, place, id, label, n):
    every such pair is settled, by what bounds its similarity or by alignment."""
    # a node meets those of its class of lengths, and as a guest those of the next one
    size = F.floor(F.log(LENGTHS, F.col("n"))).cast("int")
    rows = placed.select("bucket", "place", "id", "label", "n", F.explode(F.array(
        F.struct(size.alias("size"), F.lit(False).alias("guest")), F.struct((size + 1).alias("size"), F.lit(True).alias("guest")))).alias("c")).select(
        "bucket", "place", "id", "label", "n", "c.size", "c.guest")
    groups = rows.groupBy("bucket", "size").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_WORDS).alias("all"),
        F.min("guest").alias("guests")).where("lo <> hi and not guests").select("bucket", "size", F.ceil("all").cast("int").alias("blocks"))
    rows = rows.join(groups, ["bucket", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(
        "bucket", "size", "place", "id", "label", "n", "guest", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", "size", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "id", "label", "n", "guest", "block", "place")
    rows = keep(rows, "blocks")
    key = ["bucket", "size", "one", "two"]

    def of(rows):
        """Their nodes' texts."""
        return texts.join(rows.select(F.col("id").alias("i")).distinct(), F.col("id") == F.col("i"), "left_semi").select("id", "text")

    def counted(batches):
        hashes = WordHashes()
        for batch, some in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([word_counts(hashes.of(t)).tobytes() for t in some], pa.binary())],
                                             names=["i", "counts"])

    def numbers(group):
        return [group.column(c).to_numpy() for c in range(4, 9)]

    def marked(batches):
        """The rows, with whether they may be like another one of their group."""
        for group in _groups(batches, len(key)):
            counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint16).reshape(-1, BINS)
            may = np.zeros(len(group), bool)
            for k, at in possible(*numbers(group), counts):
                may[k] = may[at] = True
            yield from group.drop_columns(["i", "counts"]).append_column("may", pa.array(may)).to_batches()

    words = of(rows).mapInArrow(counted, "i long, counts binary")
    left = keep(rows.join(words, F.col("id") == F.col("i")).select(*rows.columns, "i", "counts").repartition(*key).sortWithinPartitions(*key)
                .mapInArrow(marked, rows.schema.add("may", "boolean")).where("may").drop("may"), "left")

    def aligned(batches):
        hashes = WordHashes()
        for group in _groups(batches, len(key)):
            if len(group) > 1:
                sketches = np.array(group.column("sketch").to_pylist(), np.int64)
                found = list(links_of(*numbers(group), group.column("place").to_numpy(), sketches,
                                      [hashes.of(t.encode("utf-8", "surrogatepass")) for t in group.column("text").to_pylist()]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

    return (left.join(of(left).toDF("i", "text"), F.col("id") == F.col("i"))
            .join(nodes.select(F.col("id").alias("j"), "sketch"), F.col("id") == F.col("j")).select(*left.columns, "sketch", "text")
            .repartition(*key).sortWithinPartitions(*key).mapInArrow(aligned, "u long, v long").distinct())


def _node(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``node`` and ``label`` (a number of the class; null: a class of its own) of every row of
    ``docs`` (doc_id, text without nulls, node)."""
    rows = keep(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    ids = keep(rows.where("n > 0").groupBy("node").agg(F.min("row").alias("id")).coalesce(files_for(rows, EDGES)), "ids")
    nodes = keep(rows.where("size(sketch) > 0").join(ids.select(F.col("id").alias("row")), "row", "left_semi")
                 .select(F.col("row").alias("id"), "n", "sketch").coalesce(files_for(rows, TEXTS)), "nodes")
    # the sketches are in ``nodes`` now
    wide, rows = kept_tables()[-3], keep(rows.select("doc_id", "node", "n"), "rows")
    drop_kept(docs.sparkSession, [wide])
    # one exchange by bucket serves the counts, the centres and the members
    banded = nodes.select("id", F.posexplode("sketch").alias("place", "value")).select(
        F.xxhash64("place", "value").alias("bucket"), "id", F.col("place").cast("smallint").alias("place")).repartition("bucket")
    centres = banded.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("other")).where("centre <> other")
    members = keep(banded.join(centres, "bucket").coalesce(files_for(rows, EDGES // FUNCTIONS)), "members")
    few = files_for(members, EDGES)
    long_enough = F.expr(f"least(n, m) >= {SIMILARITY} * (n + m) / 2")

    def lengths(pairs):
        return (pairs.join(nodes.select(F.col("id").alias("u"), "n"), "u")
                .join(nodes.select(F.col("id").alias("v"), F.col("n").alias("m")), "v").where(long_enough).select("u", "v"))

    stars = keep(lengths(members.where("id <> centre").select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct()).coalesce(few), "stars")
    candidates = members.select("id").distinct().join(ids, "id").select("id", F.col("node").alias("of"))
    texts = keep(docs.join(candidates, F.col("node") == F.col("of")).groupBy("id").agg(
        F.any_value("text").alias("text")).coalesce(files_for(rows, TEXTS)), "texts")
    links = keep(_verified(stars, texts).coalesce(files_for(stars, PAIRS)), "links")
    labels = keep(components(links, few).coalesce(few), "labels")

    # buckets that still hold several components
    placed = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("label", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    placed = keep(placed.join(mixed.select("bucket"), "bucket", "left_semi").coalesce(few), "mixed")
    to_largest = placed.where("id <> other").select(F.col("other").alias("u"), F.col("id").alias("v"))
    agreeing = placed.select("bucket", "id", "label", "place").join(nodes.select("id", "sketch"), "id").select(
        "id", "label", F.explode(F.array(*[F.xxhash64("bucket", F.lit(k), F.expr(
            f"sketch[(place + {k * (FUNCTIONS // 4 + 1)}) % {FUNCTIONS}]")) for k in range(1, COMPANIONS + 1)])).alias("key"))
    agreeing = agreeing.repartition("key")
    stays = agreeing.groupBy("key").agg(F.min("id").alias("u"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    again = agreeing.join(stays, "key").where("id <> u").select("u", F.col("id").alias("v"))
    sides = labels.select(F.col("node").alias("i"), "label")
    rest = (to_largest.union(again).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
            .join(stars, ["u", "v"], "left_anti")
            .join(sides.toDF("u", "a"), "u", "left").join(sides.toDF("v", "b"), "v", "left")
            .where("coalesce(a, u) <> coalesce(b, v)").select("u", "v"))
    rest = keep(lengths(rest).coalesce(few), "pairs")
    more = keep(_verified(rest, texts).coalesce(files_for(rest, PAIRS)), "links")
    if not more.isEmpty():
        links = links.union(more)
        labels = keep(components(links, few).coalesce(few), "labels")

    # buckets that hold several components even then: all pairs of different ones
    placed = placed.drop("label").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("label", "id"))
    # (in those of three or fewer all have met the smallest and the largest)
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("all")).where("lo <> hi and all > 3")
    placed = keep(placed.join(mixed.select("bucket"), "bucket", "left_semi").join(nodes.select("id", "n"), "id")
                  .select("bucket", "place", "id", "label", "n").coalesce(few), "mixed")
    more = keep(_linked_in_buckets(placed, nodes, texts).coalesce(few), "links")
    if not more.isEmpty():
        labels = keep(components(links.union(more), few).coalesce(few), "labels")

    placed = rows.select("doc_id", F.col("node").alias("of"), "n").join(ids, F.col("of") == F.col("node"), "left").join(
        labels.select(F.col("node").alias("i"), "label"), F.col("id") == F.col("i"), "left")
    return placed.select("doc_id", F.col("of").alias("node"), F.coalesce("label", "id").alias("label")).coalesce(
        files_for(rows, EDGES))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), _node(t).alias("node"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``class_id`` of every row: the smallest id among the texts it is linked to."""
    placed = _classes(_keyed(docs, doc_id, text))
    least = placed.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return placed.join(least, "label", "left").select(
        "doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id, of several texts with that id the one
    with the smallest hash. Rows without a word all stay."""
    placed = keep(_classes(_keyed(docs, doc_id, text)).where("label IS NOT NULL"), "placed")
    # per id and text of a class; null ids last
    kinds = placed.groupBy("label", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("doc_id").isNull().alias("none"),
                           F.hex("node").alias("node")).agg(F.count("*").alias("rows"))
    first = kinds.groupBy("label").agg(F.min(F.struct("none", "id", "node")).alias("f"))
    judged = kinds.join(first, "label").select("id", "none", "node", "rows", (F.struct("none", "id", "node") == F.col("f")).alias("stays"))
    # only rows that go, or that have equal ones, need a word: the others are not looked up
    odd = judged.where("not stays or rows > 1").select(
        F.col("id").alias("__i"), F.col("none").alias("__o"), F.col("node").alias("__n"), F.col("stays").alias("__s"))
    names = [free_name(n, docs) for n in ("__i", "__o", "__n", "__s")]
    odd = odd.toDF(*names)
    i, o, n, s = map(F.col, names)
    t = F.coalesce(F.col(text), F.lit(""))
    same = ((F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)) == i) & (F.col(doc_id).isNull() == o) & (F.hex(_node(t)) == n))
    met = docs.join(odd, same, "left")
    alone = met.where(s.isNull()).select(docs.columns)
    several = met.where(s).select(*docs.columns, *names[:3]).dropDuplicates(names[:3]).select(docs.columns)
    return alone.unionAll(several).coalesce(files_for(placed, TEXTS))
