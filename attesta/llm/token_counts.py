"""Token counts of a unigram model by dynamic programming over a trie.

Distinct pre-tokens (the words between white space, with the mark of a word start) are inserted in a
trie. A node stands for a prefix; its best forward score and the number of pieces on that path are
computed once, from its ancestors, when it is first made, and every word with that prefix shares them.
At a terminal node the count is the word's answer. A document's count is the sum over its words.

A worker keeps its trie over all rows it sees and starts a new one at a bounded number of nodes, which
changes no result. No row moves: there is no shuffle.

The vocabulary file gives the pieces in order of frequency, not their probabilities. The unigram score
is Zipf's: minus the logarithm of the place. A character outside the vocabulary costs one piece per UTF-8 byte.

Defined cases: a null or empty text has no pre-token and no token; repeated rows are counted each.
"""

import math
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

WORD_START = "▁"
#: Nodes a worker's trie may have before it starts a new one.
MOST_NODES = 800_000
#: Words a worker remembers the counts of.
REMEMBERED = 400_000


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_scores(path: str) -> dict[str, float]:
    """Pieces of the vocabulary and their scores, without control and byte pieces."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    usable = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    return {model.id_to_piece(i): -math.log(place + 1) for place, i in enumerate(usable, 1)}


class Trie:
    """A node is a number; ``after`` leads from (node, character) to the next one. ``best`` and
    ``pieces`` are the forward score of a node and the pieces of its best path; 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        lengths = {}
        for piece in scores:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        #: Lengths of the pieces that end in a character.
        self.lengths = {char: sorted(found) for char, found in lengths.items()}
        self.clear()

    def clear(self):
        self.after, self.best, self.pieces = {}, array("d", [0.0]), array("q", [0])

    def count(self, word: str) -> int:
        """Pieces of the best path of a word; ties go to fewer pieces."""
        if len(self.best) > MOST_NODES:
            self.clear()
        after, path, node = self.after, [0], 0
        for at, char in enumerate(word, 1):
            edge = node << 21 | ord(char)
            node = after.get(edge)
            if node is None:
                node = after[edge] = len(self.best)
                self._forward(word, at, char, path)
            path.append(node)
        return self.pieces[node]

    def _forward(self, word, at, char, path):
        best, pieces, score_of = self.best, self.pieces, self.scores.get
        size = len(char.encode("utf-8", "surrogatepass"))
        most, fewest = best[path[-1]] + size * self.byte_score, pieces[path[-1]] + size
        for length in self.lengths.get(char, ()):
            if length > at:
                break
            score = score_of(word[at - length:at])
            if score is not None:
                before = path[at - length]
                total, n = best[before] + score, pieces[before] + 1
                if total > most or total == most and n < fewest:
                    most, fewest = total, n
        best.append(most)
        pieces.append(fewest)


class Counts(dict):
    """Counts of the words met so far; those not used since the last turnover are forgotten."""

    def __init__(self, trie):
        super().__init__()
        self.trie, self.old = trie, {}

    def __missing__(self, word):
        n = self.old.get(word)
        if n is None:
            n = self.trie.count(WORD_START + word)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = n
        return n


_COUNTS = {}


def word_counts(path: str) -> Counts:
    """This worker's counts: they outlive a task."""
    if path not in _COUNTS:
        _COUNTS[path] = Counts(Trie(unigram_scores(path)))
    return _COUNTS[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` of every row."""
    path = tokenizer or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches):
        counts = word_counts(path)
        for batch, texts in text_batches(batches):
            words = [t.translate(_SPACES).decode("utf-8", "surrogatepass").split(" ") for t in texts]
            words = [[w for w in ws if w] for ws in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, words), pa.int64()),
                 pa.array([sum(map(counts.__getitem__, ws)) for ws in words], pa.int64())], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")


#: Tab to carriage return become spaces.
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
