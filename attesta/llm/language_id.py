"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads chunks of ``CHUNK`` bytes from both ends and labels every position; a document's
probabilities pool its positions. It is trained in numpy by backpropagation through time, on slices of
at most ``MOST_ROWS`` labelled rows for each language and ``SLICE`` bytes of each, the first by a hash of
the id. That bounds what reaches the driver; the network itself has a few thousand numbers.

Every text is labelled whole, where it was read, many chunks at a time.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; without a row to learn
from every text is; rows with a null label are not learnt from; repeated rows are labelled each; other
columns are not carried.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

UNKNOWN = "und"
#: Bound of the training sample: rows for each language, and bytes of each.
MOST_ROWS, SLICE = 400, 512
CHUNK, HIDDEN = 128, 8
#: Chunks labelled at once.
TOGETHER = 4096
STEPS, BATCH, SPAN, RATE = 500, 96, 48, 0.02


class Network:
    """Two gated recurrent layers of ``HIDDEN`` units, one from each end, and a softmax per position.

    All arrays are (units, batch). The first third of a gate's rows is the update gate, the second the
    reset gate, the last the candidate; a gate is (1 + tanh(x / 2)) / 2, with the half in the weights."""

    def __init__(self, classes: int, seed: int = 8):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.weights = {}
        for end in ("l", "r"):
            self.weights[f"x{end}"] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.weights[f"h{end}"] = rng.normal(0, 0.3, (3 * h, h)).astype(np.float32)
        self.weights["out"] = rng.normal(0, 0.3, (classes, 2 * h)).astype(np.float32)
        self.weights["bias"] = np.zeros((classes, 1), np.float32)

    def run(self, data, end, record=None):
        """States (steps, units, batch) of one direction over bytes (steps, batch)."""
        w, u, h = self.weights[f"x{end}"], self.weights[f"h{end}"], HIDDEN
        steps, batch = data.shape
        states = np.empty((steps, h, batch), np.float32)
        state = np.zeros((h, batch), np.float32)
        for t in (range(steps) if end == "l" else range(steps - 1, -1, -1)):
            x = w.take(data[t], axis=1)
            a = u @ state
            gates = np.tanh(x[:2 * h] + a[:2 * h])
            gates += 1
            gates *= 0.5
            z, r = gates[:h], gates[h:]
            n = np.tanh(x[2 * h:] + r * a[2 * h:])
            if record is not None:
                record.append((t, state, z, r, n, a[2 * h:]))
            state = n + z * (state - n)
            states[t] = state
        return states

    def probabilities(self, data):
        """(steps, classes, batch) label probabilities of every position."""
        both = np.concatenate([self.run(data, "l"), self.run(data, "r")], axis=1)
        logits = self.weights["out"] @ both + self.weights["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, data, labels):
        """Mean loss per position and its gradients, by backpropagation through time."""
        records = {"l": [], "r": []}
        left, right = self.run(data, "l", records["l"]), self.run(data, "r", records["r"])
        both = np.concatenate([left, right], axis=1)
        steps, _, batch = both.shape
        logits = self.weights["out"] @ both + self.weights["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        columns = np.arange(batch)
        loss = -np.log(p[:, labels, columns] + 1e-9).mean()
        p[:, labels, columns] -= 1
        p /= steps * batch
        grads = {"out": np.einsum("tcb,thb->ch", p, both), "bias": p.sum(axis=(0, 2))[:, None]}
        back = self.weights["out"].T @ p
        h = HIDDEN
        for end, part in (("l", back[:, :h]), ("r", back[:, h:])):
            u = self.weights[f"h{end}"]
            gx, gu = np.zeros_like(self.weights[f"x{end}"]), np.zeros_like(u)
            ahead = np.zeros((h, batch), np.float32)
            for t, state, z, r, n, a in reversed(records[end]):
                d = part[t] + ahead
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (state - n) * 2 * z * (1 - z)
                dr = dn * a * 2 * r * (1 - r)
                dx = np.concatenate([dz, dr, dn])
                da = np.concatenate([dz, dr, dn * r])
                np.add.at(gx.T, data[t], dx.T)
                gu += da @ state.T
                ahead = d * z + u.T @ da
            grads[f"x{end}"], grads[f"h{end}"] = gx, gu
        return loss, grads

    def train(self, data, labels, seed: int = 8):
        """Adam over random spans of the training slices, languages drawn alike often."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        by_class = [np.flatnonzero(labels == c) for c in range(int(labels.max()) + 1)]
        for step in range(1, STEPS + 1):
            pick = np.array([by_class[c][rng.integers(len(by_class[c]))] for c in rng.integers(0, len(by_class), BATCH)])
            spans = []
            for k in pick:
                start = rng.integers(0, max(1, len(data[k]) - SPAN + 1))
                span = data[k][start:start + SPAN]
                spans.append(np.resize(span, SPAN))
            _, grads = self.gradients(np.array(spans).T, labels[pick])
            rate = RATE * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                self.weights[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def sample_of(docs: DataFrame, learnt: Column) -> DataFrame:
    """A slice of at most ``MOST_ROWS`` rows for each language: ``lang`` and ``text``."""
    rows = docs.where(learnt & F.col("lang").isNotNull() & F.col("text").isNotNull())
    pick = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - SLICE)).cast("int") + 1
    ranked = rows.select("lang", "doc_id", F.substring("text", pick, F.lit(SLICE)).alias("text")).where(F.length("text") > 20)
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return ranked.withColumn("k", F.row_number().over(by)).where(F.col("k") <= MOST_ROWS).select("lang", "doc_id", "text")


def fit(docs: DataFrame, learnt: Column):
    """The languages and the network, or None if there is nothing to learn from."""
    rows = sample_of(docs, learnt).toArrow().to_pylist()
    rows = sorted(((r["lang"], r["doc_id"] or 0, r["text"]) for r in rows))
    names = sorted({r[0] for r in rows})
    if not rows:
        return names, None
    data = [np.frombuffer(r[2].encode("utf-8", "surrogatepass"), np.uint8) for r in rows]
    labels = np.array([names.index(r[0]) for r in rows])
    return names, Network(len(names)).train(data, labels)


def pooled(network: Network, texts):
    """Mean label probabilities of each text over all its positions."""
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    sizes = np.array([len(a) for a in arrays], np.int64)
    counts = -(-sizes // CHUNK)
    whose = np.repeat(np.arange(len(texts)), counts)
    total = np.zeros((len(network.weights["bias"]), len(texts)))
    # the chunks of a text share its length about evenly, so that little of a chunk is padding
    data = np.zeros((len(whose), CHUNK), np.uint8)
    filled = np.zeros(len(whose), np.int64)
    at = 0
    for a, n in zip(arrays, counts.tolist(), strict=True):
        if n:
            padded = np.zeros(n * CHUNK, np.uint8)
            padded[:len(a)] = a
            padded[len(a):] = 32
            data[at:at + n] = padded.reshape(n, CHUNK)
            filled[at:at + n] = CHUNK
            filled[at + n - 1] = len(a) - (n - 1) * CHUNK
            at += n
    for lo in range(0, len(whose), TOGETHER):
        part = slice(lo, lo + TOGETHER)
        p = network.probabilities(np.ascontiguousarray(data[part].T))
        inside = np.arange(CHUNK)[:, None] < filled[part]
        sums = (p * inside[:, None, :]).sum(axis=0, dtype=np.float64)
        for c in range(len(total)):
            total[c] += np.bincount(whose[part], sums[c], len(texts))
    return total / np.maximum(1, sizes)


def identify(docs: DataFrame, held_out: Column, learnt: Column) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = docs.sparkSession.sparkContext.broadcast(fit(narrow, learnt))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        names, network = known.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if network is not None:
                some = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                p = pooled(network, [texts[k].encode("utf-8", "surrogatepass") for k in some])
                for k, column in zip(some, p.T, strict=True):
                    best = int(column.argmax())
                    labels[k], scores[k] = names[best], float(min(1.0, column[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(labels), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return narrow.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, schema)
