"""Toxicity by a learnt lexicon: Levenshtein automata run over a trie of its terms.

*Lexicon.* Words and word beginnings that stand out in toxic documents are learnt from labelled rows,
greedily, each for the toxic documents that no term so far explains; so the rare words of one document
that was copied many times do not get in.

*Match.* A word's Levenshtein automaton walks the trie of terms; where both accept, the word is the term
or a misspelling of it. Words that clean documents use as well are no misspellings.

*Context.* The words and quotation marks around a hit have learnt weights, which tell quotation from
abuse; with no evidence they are neutral, but for a small prior against terms in quotation marks.

*Score.* A logistic function of the strongest hit, of how many distinct hits there are and of their share.

The model is fitted on at most ``MOST_TOXIC`` toxic and ``MOST_CLEAN`` clean labelled rows, the first by a
hash of the id. All traits of these rows with enough evidence are candidates; a term explains three toxic
rows at least and a row takes three explanations, so there are no more terms than twice the toxic rows, and
context words occur ten times around hits: what is broadcast is bounded by the sample. Every text is scored
whole, where it was read.

Defined cases: a null or empty text scores as one without hits; without a toxic and a clean row to learn
from every score is 0; labels that are null are not learnt from; of several labels of a document the
largest holds; repeated rows are scored each; other columns are not carried.
"""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, text_batches

MOST_TOXIC, MOST_CLEAN = 4_000, 12_000
#: Lengths of word beginnings that may be terms, and the least length of a term.
STEMS, SHORTEST = range(3, 9), 3
#: A term is in so many toxic documents, and at this ratio of rates.
SUPPORT, RATIO = 3, 8.0
#: The documents of a term speak for it by so many nats, so that no trait gets in by chance.
EVIDENCE = 16.0
#: Terms from these lengths on are found with one, or two, letters wrong.
ONE_ERROR, TWO_ERRORS = 5, 10
#: Words on either side of a hit that are its context.
AROUND = 4
THRESHOLD = 0.7
#: Bytes of words a worker remembers (as many again from before), and the longest word remembered.
REMEMBERED_BYTES, SHORT = 80 << 20, 64

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\W_]+(?:['’@$!*.\-_]?[^\W_]+)*")
QUOTES = "\"'“”„‘’«»‹›`"


RUN = re.compile(r"[^\W_]+")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def core_of(word: str) -> str:
    """A word in lower case without the marks around it."""
    m = LETTERS.search(word)
    return m[0].lower() if m else ""


def cores_of(word: str) -> list[str]:
    """The core of a word, and its runs of letters where marks join several: ``stop.it`` may be one word
    in disguise or two."""
    core = core_of(word)
    runs = RUN.findall(core)
    return [core, *runs] if len(runs) > 1 else [core]


def words_of(text: str, split) -> list[str]:
    """The words of a text. What stands between white space may hold several (``him,fool``): each goes on to
    the end of its letters, the last one to the end. ``split`` takes one such stretch apart."""
    out = []
    for stretch in WORD.findall(text):
        # letters with marks around them only are one word
        found = None if stretch.isalnum() or stretch.strip(MARKS).isalnum() else split(stretch)
        if found is None:
            out.append(stretch)
        else:
            out += found
    return out


def split_stretch(stretch: str) -> list[str] | None:
    """The words of a stretch without white space; None where it is one."""
    ends = [m.end() for m in LETTERS.finditer(stretch)]
    if len(ends) < 2:
        return None
    ends[-1] = len(stretch)
    return [stretch[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


class Remembered:
    """Results by word, those used since the last turnover and the ones before, bounded by their bytes."""

    def __init__(self, work):
        self.work, self.now, self.old, self.used = work, {}, {}, 0

    def __call__(self, word):
        found = self.now.get(word, 0)
        if found != 0:
            return found
        found = self.old.get(word, 0)
        if found == 0:
            found = self.work(word)
        if len(word) <= SHORT:
            self.used += len(word) + 250
            if self.used > REMEMBERED_BYTES:
                self.now, self.old, self.used = {}, self.now, 0
            self.now[word] = found
        return found


class Lexicon:
    """A trie of terms, walked by Levenshtein automata. A term that ends in ``*`` is a word beginning."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.root = weights, {}
        for term in weights:
            node = self.root
            for char in term.rstrip("*"):
                node = node.setdefault(char, {})
            node.setdefault("", []).append(term)
        whole = [t for t in weights if len(t.rstrip("*")) >= ONE_ERROR]
        #: Every word within the allowed errors holds one of these parts of a term unchanged.
        parts = {part for t in whole for part in _parts(t.rstrip("*"))} | {t.rstrip("*") for t in weights}
        self.may_hold = re.compile("|".join(sorted(map(re.escape, parts)))) if parts else None

    def find(self, word: str):
        """The best (term, errors) for a word, or None: fewest errors, then the heaviest term."""
        if not self.may_hold or not self.may_hold.search(word):
            return None
        size = len(word)
        seen = {}
        for i, char in enumerate(word):
            seen[char] = seen.get(char, 0) | (1 << (i + 1))
        errors = 2 if size >= TWO_ERRORS - 2 else 1 if size >= ONE_ERROR - 1 else 0
        # bit i of state[e]: i letters of the word were read with e errors
        start = [1]
        for _ in range(errors):
            start.append(start[-1] | start[-1] << 1)
        full = (1 << (size + 1)) - 1
        best, stack = None, [(self.root, start)]
        while stack:
            node, state = stack.pop()
            for char, child in node.items():
                if char == "":
                    for term in child:
                        found = self._accepts(term, state, size)
                        if found is not None:
                            rank = (found, -self.weights[term], term)
                            if best is None or rank < best:
                                best = rank
                    continue
                letter = seen.get(char, 0)
                after = [state[0] << 1 & letter]
                for e in range(1, len(state)):
                    after.append((state[e] << 1 & letter | state[e - 1] | state[e - 1] << 1 | after[e - 1] << 1) & full)
                if after[-1]:
                    stack.append((child, after))
        return (best[2], best[0]) if best else None

    @staticmethod
    def _accepts(term, state, size):
        length = len(term.rstrip("*"))
        most = 2 if length >= TWO_ERRORS else 1 if length >= ONE_ERROR else 0
        if term.endswith("*"):   # the rest of the word is free; short beginnings must be exact
            if state[0] >> length & 1:
                return 0
            return next((e for e in range(1, min(most if length >= 7 else 0, len(state) - 1) + 1)
                         if state[e] >> (length - 1) & 1 or state[e] >> length & 1), None)
        return next((e for e in range(min(most, len(state) - 1) + 1) if state[e] >> size & 1), None)


def _parts(term):
    n = 3 if len(term) >= TWO_ERRORS else 2
    return [term[k * len(term) // n:(k + 1) * len(term) // n] for k in range(n)]


class Model:
    """The fitted scorer; ``None`` fields mean there was nothing to learn from."""

    def __init__(self, weights, known, context, logistic):
        self.lexicon, self.known, self.context, self.logistic = Lexicon(weights), known, context, logistic
        self.match, self.split = Remembered(self._match), Remembered(split_stretch)

    def _match(self, word):
        best = None
        for core in cores_of(word):
            hit = self.lexicon.find(core) if len(core) >= SHORTEST else None
            if hit and core in self.known and (hit[1] or hit[0].endswith("*")):
                hit = None
            if hit and (best is None or (hit[1], -self.lexicon.weights[hit[0]]) < (best[1], -self.lexicon.weights[best[0]])):
                best = hit
        return best

    def hits(self, words):
        """(place, term, errors) of all matches in a text's words."""
        match, out = self.match, []
        for i, word in enumerate(words):
            hit = match.now.get(word, 0)
            if hit == 0:
                hit = match(word)
            if hit:
                out.append((i, *hit))
        return out

    def features(self, words):
        hits = self.hits(words)
        strength = {}   # of each distinct word that hit, however often
        for i, term, errors in hits:
            w, core = self.lexicon.weights[term] - 0.7 * errors + sum(
                self.context.get(c, 0.0) for c in context_of(words, i)), core_of(words[i])
            strength[core] = max(w, strength.get(core, -9.0))
        return features_of(strength.values(), len(hits), len(words))

    def score(self, text: str) -> float:
        if self.logistic is None:
            return 0.0
        z = float(self.features(words_of(text, self.split)) @ self.logistic)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def features_of(strengths, hits, words):
    strong = [s for s in strengths if s > 0]
    if not strong:
        return np.array([1.0, 0.0, 0.0, 0.0])
    return np.array([1.0, min(max(strong), 6.0), math.log1p(sum(strong)), math.log1p(1000.0 * hits / words)])


def context_of(words, i):
    """The words around a hit, and whether it stands in quotation marks."""
    near = words[max(0, i - AROUND):i] + words[i + 1:i + 1 + AROUND]
    out = {core_of(w) for w in near} - {""}
    before, after = "".join(words[max(0, i - AROUND):i + 1]), "".join(words[i:i + 1 + AROUND])
    if any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
        out.add("“”")
    return out


def sample_of(docs: DataFrame, labels: DataFrame, learnt: Column) -> DataFrame:
    """A bounded sample of labelled rows: ``toxic`` and ``text``, equal texts once."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("toxic")).where(learnt)
    picked = ids.where("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_TOXIC).union(
        ids.where("NOT toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_CLEAN))
    # at most MOST_TOXIC + MOST_CLEAN ids: that is the bound of this broadcast
    return docs.join(F.broadcast(picked), "doc_id").where("text IS NOT NULL").groupBy(F.sha2("text", 256)).agg(
        F.max("toxic").alias("toxic"), F.any_value("text").alias("text")).select("toxic", "text")


def _traits(words):
    cores = {c for w in words for c in cores_of(w)}
    out = {c for c in cores if len(c) >= SHORTEST}
    return out | {c[:n] + "*" for c in out for n in STEMS if len(c) > n}


def learn_terms(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Terms and their log odds. Traits are counted on the executors; only those over the ratio come
    back, with the toxic documents of the sample that hold them."""
    if not toxic or not clean:
        return {}

    def spread(batches):
        for batch, texts in text_batches(batches):
            counts, held = Counter(), {}
            for k, (bad, raw) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                text = raw.decode("utf-8", "surrogatepass")
                doc = hash_of(raw)
                for trait in _traits(words_of(text, split_stretch)):
                    counts[trait, bad] += 1
                    if bad:
                        held.setdefault(trait, []).append(doc)
            rows = [(t, bad, n, held.get(t, []) if bad else []) for (t, bad), n in counts.items()]
            yield pa.RecordBatch.from_pylist(
                [{"trait": t, "toxic": b, "n": n, "docs": d} for t, b, n, d in rows],
                schema=pa.schema([("trait", pa.string()), ("toxic", pa.bool_()), ("n", pa.int64()), ("docs", pa.list_(pa.int64()))]))

    counted = sample.mapInArrow(spread, "trait string, toxic boolean, n long, docs array<long>")
    enough = F.when(F.length("trait") <= 4, 4 * RATIO).otherwise(RATIO)   # three letters and the star
    rate = (F.col("bad") + 0.0) / toxic / ((F.col("good") + 0.5) / clean)
    found = counted.groupBy("trait").agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("good"),
        F.flatten(F.collect_list("docs")).alias("docs")).where((F.col("bad") >= SUPPORT) & (rate >= F.least(enough, F.lit(clean))))
    share, n = toxic / (toxic + clean), F.col("bad") + F.col("good")
    speaks = F.col("bad") * F.ln(F.col("bad") / n / share) + F.when(
        F.col("good") > 0, F.col("good") * F.ln(F.col("good") / n / (1 - share))).otherwise(0.0)
    telling = keep(found.where(speaks >= EVIDENCE - 1e-6), "traits")
    rows = telling.head(max(1, telling.count()))      # traits of the bounded sample
    return choose_terms([(r["trait"], r["bad"], r["good"], r["docs"]) for r in rows], toxic, clean)


def hash_of(raw: bytes) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(raw) >> 1


def choose_terms(candidates, toxic, clean):
    """Greedy cover: the term that explains most toxic documents not yet explained three times."""
    left = {}   # toxic document -> explanations it can still take
    holds = {t: set(d) for t, _, _, d in candidates}
    counts = {t: (bad, good) for t, bad, good, _ in candidates}
    for docs in holds.values():
        left.update(dict.fromkeys(docs, 3))
    terms = {}
    gains = {t: len(d) for t, d in holds.items()}
    while gains:
        best = None
        # gains only fall, so a stale gain is an upper bound
        for term in sorted(gains, key=lambda t: (-gains[t], t.endswith("*"), -len(t), t)):
            if best is not None and gains[term] < best[0]:
                break
            gain = sum(left[d] > 0 for d in holds[term])
            gains[term] = gain
            if best is None or (gain, not term.endswith("*"), len(term)) > (best[0], not best[1].endswith("*"), len(best[1])):
                best = gain, term
        gain, term = best
        if gain < SUPPORT:
            break
        share = toxic / (toxic + clean)
        del gains[term]
        if evidence(*counts[term], share) < EVIDENCE:
            continue
        stem = term.rstrip("*")
        if term != stem:   # its most frequent word as well: misspellings are looked for near whole words
            words = [t for t in gains if t[-1] != "*" and t.startswith(stem) and evidence(*counts[t], share) >= EVIDENCE]
            words = [max(words, key=lambda t: (counts[t][0], t))] if words else []
        for t in [term, *words] if term != stem else [term]:
            bad, good = counts[t]
            terms[t] = math.log((bad + 0.5) / (toxic + 1) * (clean + 1) / (good + 0.5))
        for t in [t for t in gains if t.rstrip("*").startswith(stem) or stem.startswith(t.rstrip("*"))]:
            del gains[t]   # longer and shorter forms say the same again
        for d in holds[term]:
            left[d] -= 1
    return terms


def evidence(bad, good, share):
    """Log likelihood ratio of the toxic share among ``bad + good`` documents against ``share``."""
    n = bad + good
    return bad * math.log(bad / n / share) + (good * math.log(good / n / (1 - share)) if good else 0.0)


def fit(docs: DataFrame, labels: DataFrame, learnt: Column) -> Model:
    """Terms, words that are no misspellings, context weights and the logistic function."""
    sample = keep(sample_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                            labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), learnt), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().head(2)}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    weights = learn_terms(sample, toxic, clean)
    if not toxic or not clean:
        return Model({}, frozenset(), {}, None)
    plain = Model(weights, frozenset(), {}, None)

    def survey(batches):   # what each sampled document has to say: hits, contexts, misspellings
        import pickle
        for batch, texts in text_batches(batches):
            out = []
            for bad, raw in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = words_of(raw.decode("utf-8", "surrogatepass"), plain.split)
                hits = [(t, e, core_of(words[i]), sorted(context_of(words, i))) for i, t, e in plain.hits(words)]
                out.append(pickle.dumps((bad, len(words), hits)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["seen"])

    import pickle
    # a row for each sampled document: bounded like the sample
    seen = [pickle.loads(r["seen"]) for r in sample.mapInArrow(survey, "seen binary").head(MOST_TOXIC + MOST_CLEAN)]
    # clean words: near a term or with its beginning, but not telling
    loose = {side: Counter(w for bad, _, hits in seen if bad is side for w in {h[2] for h in hits if h[1] or h[0][-1] == "*"})
             for side in (True, False)}
    known = frozenset(w for w, n in loose[False].items() if n * RATIO / clean * toxic > loose[True][w])
    seen = [(bad, n, [h for h in hits if h[2] not in known or not h[1] and h[0][-1] != "*"]) for bad, n, hits in seen]
    around = {side: Counter(c for bad, _, hits in seen if bad is side for h in hits for c in h[3]) for side in (True, False)}
    totals = {side: sum(len(hits) for bad, _, hits in seen if bad is side) for side in (True, False)}
    context = {}
    trust = totals[False] / (totals[False] + 20)   # few clean hits say little about their surroundings
    for word, n in (around[True] + around[False]).items():
        if n >= 10:
            odds = math.log((around[True][word] + 1) / (totals[True] + 2) * (totals[False] + 2) / (around[False][word] + 1))
            context[word] = trust * max(-2.0, min(2.0, odds)) / 2
    context["“”"] = context.get("“”", 0.0) - 0.5
    model = Model(weights, known, context, None)
    x, y = [], []
    for bad, n, hits in seen:
        strength = {}
        for term, errors, core, near in hits:
            w = weights[term] - 0.7 * errors + sum(context.get(c, 0.0) for c in near)
            strength[core] = max(w, strength.get(core, -9.0))
        x.append(features_of(strength.values(), len(hits), n))
        y.append(float(bad))
    model.logistic = logistic_fit(np.array(x), np.array(y), clean, toxic)
    return model


def logistic_fit(x, y, clean, toxic):
    """Newton's method with a small penalty; toxic rows are weighted up where they are few."""
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, min(2.0, max(1.0, clean / toxic / 4)), 1.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.01 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def score(docs: DataFrame, labels: DataFrame, held_out: Column, learnt: Column) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(fit(docs, labels, learnt))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        model = known.value
        for batch, texts in text_batches(batches):
            scores = [model.score(t.decode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    scored = narrow.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
