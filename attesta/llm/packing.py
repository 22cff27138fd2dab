"""Packing tokenised documents into sequences: first-fit decreasing in randomised groups.

``pieces`` tokenises whole texts and cuts them at multiples of the sequence length, where they were
read. ``pack`` deals the narrow piece rows into groups by a hash of their row number, so that a group has a
bounded number of rows whatever the table holds: null or repeated ids and long documents spread over all.
In a group the pieces go, longest first, into the leftmost bin with room, found in a tournament tree of
free capacities.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed once each; other
columns are not carried (ids and places are enough to join them back).
"""

from itertools import chain
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, keep, run_groups

SEQUENCE = 4096
END_ID = 2
#: Pieces in a group: enough for a good fit, few enough for one task.
GROUP_PIECES = 20_000
#: Bytes of words a worker remembers the ids of (as many again from before), and the longest word remembered.
REMEMBERED_BYTES, SHORT = 48 << 20, 64
#: Words encoded in one call.
TOGETHER = 200
#: Pieces handed back in one batch.
AT_ONCE = 1000

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def vocabulary_path() -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of a space-free stretch of text as little-endian bytes, computed once.

    The tokenizer drops white space and no piece of it spans a space, so a text's ids are those of its
    stretches in turn; nor does one span the end of a run of letters (as the tokenizer normalises them), so
    ASCII marks behind a word are looked up apart. Texts are cut, and their ids put together, a column at a
    time in Arrow; only the different runs of a batch are looked up one by one. Short ones used since the last
    turnover are remembered, the rest forgotten; long ones are encoded each time."""

    def __init__(self, path):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer, self.old, self.used = Tokenizer.from_file(path), {}, 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def learn(self, words):
        """Ids of new words. Lower-case ASCII letters reach the tokenizer's model as they are, which is asked for
        them at once; other runs of letters are encoded many at a time: a call costs more than a word."""
        found, known, plain, some = {}, self.old.get, [], []
        for word in words:
            ids = known(word)
            if ids is not None:
                found[word] = ids
            elif len(word) <= SHORT and word.isalpha():
                (plain if word.isascii() and word.islower() else some).append(word)
        ids = [[token.id for token in tokens] for tokens in map(self.tokenizer.model.tokenize, plain)]
        found.update(_cut(plain, np.array(list(chain.from_iterable(ids)), "<u4"), np.cumsum(list(map(len, ids)))))
        for at in range(0, len(some), TOGETHER):
            few = some[at:at + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(few), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(few):   # each is one run of letters after the tokenizer's normalising too
                found.update(_cut(few, ids, ends))
        for word in words:
            if word not in found:
                found[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            if len(word) <= SHORT:
                self[word] = ids = found[word]
                self.used += len(word) + len(ids) + 200
        return found

    def of(self, words):
        """An array of the ids of each of an array of different words."""
        words = words.to_numpy(zero_copy_only=False).tolist()
        if self.used > REMEMBERED_BYTES:
            self.old, self.used = dict(self), 0
            self.clear()
        out = list(map(self.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        learnt = self.learn([words[k] for k in new])
        for k in new:
            out[k] = learnt[words[k]]
        return pa.array(out, pa.large_binary())

    def column(self, texts, end=b""):
        """The ids of a column of texts in one buffer, each text's closed by ``end``, and where each begins."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = split.values.dictionary_encode()
        core, marks = (part.dictionary_encode() for part in _parts(words.dictionary))
        ids = pc.binary_join_element_wise(self.of(core.dictionary).take(core.indices),
                                          self.of(marks.dictionary).take(marks.indices), pa.scalar(b"", pa.large_binary()))
        ids = pa.concat_arrays([ids, pa.array([end], pa.large_binary())])
        after = split.offsets.to_numpy()[1:]
        flat = ids.take(pa.array(np.insert(words.indices.to_numpy(), after, len(ids) - 1)))
        at = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)
        return flat.buffers()[2], at[np.concatenate([[0], after + np.arange(1, len(after) + 1)])]

    def texts(self, texts):
        ids, at = self.column(pa.array(texts, pa.string()))
        ids = b"" if ids is None else ids.to_pybytes()
        return [ids[a:b] for a, b in zip(at, at[1:])]  # noqa: B905


def _cut(words, ids, ends):
    """The ids of each word, which end at ``ends``, as bytes."""
    raw, ends = ids.tobytes(), (4 * ends).tolist()
    return zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)])  # noqa: B905


def _parts(words):
    """The letters of each word (ASCII in lower case) and the ASCII marks behind them. Only what is letters
    throughout in lower case too is taken apart: a capital I with a dot ends in a mark then."""
    core = pc.ascii_rtrim(words, _MARKS)
    plain = pc.ascii_is_alpha(core)
    other = pc.and_not(pc.not_equal(core, words), pc.or_(plain, pc.string_is_ascii(core)))
    apart = plain.to_numpy(zero_copy_only=False).copy()
    at = np.flatnonzero(other.to_numpy(zero_copy_only=False))
    apart[at] = [w.isalpha() and normalize("NFC", w).lower().isalpha() for w in core.take(pa.array(at)).to_pylist()]
    marked = pa.array(apart & pc.not_equal(core, words).to_numpy(zero_copy_only=False))
    marks = pc.replace_with_mask(pa.repeat(pa.scalar("", words.type), len(words)), marked, pc.replace_substring_regex(
        words.filter(marked), f"^.*[^{_BETWEEN}]", ""))
    return pc.if_else(plain, pc.ascii_lower(core), pc.if_else(pa.array(apart), core, words)), marks


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BETWEEN = r"!-/:-@\[-`{-~"   # the same, as ranges
_WORD_IDS = {}


def word_ids(path) -> WordIds:
    """This worker's memory of word ids: it outlives a task."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document's ids: at most ``sequence`` of them, as 32-bit integers."""
    path = tokenizer or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        words = word_ids(path)
        for batch in batches:
            if not len(batch):
                continue
            ids, at = words.column(batch.column(1), end)
            tokens = np.diff(at) // 4
            each = -(-tokens // sequence)
            doc = np.repeat(np.arange(len(tokens)), each)
            start = sequence * (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each))
            tokens = tokens[doc]
            length = np.minimum(sequence, tokens - start)
            begin = at[doc] + 4 * start
            docs = batch.column(0).take(pa.array(doc))
            for k in range(0, len(doc), AT_ONCE):   # ids of a batch may not fit 32-bit offsets
                few = slice(k, k + AT_ONCE)
                offsets = np.append(begin[few], begin[few][-1] + 4 * length[few][-1]) - begin[k]
                raw = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
                    None, pa.py_buffer(offsets.astype(np.int32)), ids.slice(begin[k], offsets[-1])])
                yield pa.RecordBatch.from_arrays(
                    [docs[few], pa.array(start[few]), pa.array(length[few]), pa.array(tokens[few]), raw], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(cut, PIECES)


def first_fit_decreasing(lengths, capacity: int):
    """Bin and offset of each length: longest first, each into the leftmost bin with room."""
    n = len(lengths)
    width = 1
    while width < max(1, n):
        width *= 2
    room = [capacity] * (2 * width)   # room[1] is the root: the most room of any bin
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need, at = int(lengths[k]), 1
        while at < width:
            at *= 2
            if room[at] < need:
                at += 1
        bins[k], offsets[k] = at - width, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def pack(parts: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Piece rows with ``sequence_id`` and ``offset``; offsets of a sequence have no gaps."""
    columns, row = parts.columns, free_name("__row", parts)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    # numbered as written: the same rows make the same groups whenever a task is run again
    parts = keep(parts.withColumn(row, F.monotonically_increasing_id()), "pieces")
    groups = run_groups(parts.count(), group_pieces)
    group = free_name("__group", parts)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        # the order must not hang on how the rows arrived
        pdf = pdf.sort_values(["doc_id", "start", row], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), sequence)
        return pdf.assign(sequence_id=pdf[group].to_numpy("int64") * 2**32 + bins,
                          offset=offsets)[[*columns, "sequence_id", "offset"]]

    grouped = parts.withColumn(group, F.pmod(F.xxhash64(row), F.lit(groups)))
    return grouped.groupBy(group).applyInPandas(fit, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, **options) -> DataFrame:
    """The query's result: every piece with the checksum of its ids in place of the ids."""
    cut = pieces(docs, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(cut)
