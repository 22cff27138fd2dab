"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Every entry c becomes the integer ``floor(64 * c) + 1000000``. Sums per dimension are exact, so rows are
centred by exact integers before anything is multiplied. Each block of centred rows is reduced to its
triangular factor R (QR of the factor so far above the next rows); the factors of all tasks are merged a few
at a time in rounds, and the last few on the driver: each is as large as dimension x dimension, whatever the
number of rows. ``bidiagonal.eigen`` takes the principal directions from R; the model is dimension x 32
numbers. How far the whitened rows' covariance is from the identity is measured over all rows.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped, as are those with
an entry of 2**46 or more in size (its integer would not be exact) and those whose length is not the most
frequent one (of equally frequent ones the longest): a covariance needs one dimension. Components without
variance (a singular value below ``LEAST`` of the largest) have no whitened value and are left out; so a table
of one distinct vector, or an empty one, gives no rows. A deviation beyond a long is null. Rows with equal or
null ids are rows of their own; other columns are not carried.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bidiagonal
from .common import keep

SCALE, OFFSET, MOST = 64, 1_000_000, 32
#: Singular values below this share of the largest one count as none.
LEAST = 1e-10
#: Matrices merged at a time.
FAN_IN = 32
_LONG = 2**63 - 1
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _integers(batch):
    """The vectors of a batch as rows of exact integers."""
    flat = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat.astype(float)) + OFFSET).astype(np.int64).reshape(batch.num_rows, -1)


def _deviations(x, n: int, sums):
    """``n * x - sums``, exact: in longs where they fit, in Python's integers else."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most + max(map(abs, sums), default=0) <= _LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(deviations) -> list[int | None]:
    most = int(np.abs(deviations).max(initial=0))
    if most * most * deviations.shape[1] > _LONG:
        deviations = deviations.astype(object)
    total = (deviations * deviations).sum(1).tolist()
    return [t if t <= _LONG else None for t in total]


def _centred(x, n, sums):
    return _deviations(x, n, sums).astype(float) / n


def _triangle(above, rows):
    return np.linalg.qr(rows if above is None else np.concatenate((above, rows)), mode="r")


def _gathered(parts: DataFrame, merge) -> list[bytes]:
    """The matrices of all tasks (``part``, ``matrix``), merged in rounds until few are left."""
    parts = keep(parts, "matrices")
    left = parts.count()

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"part": table["part"].slice(0, 1), "matrix": pa.array([merge(table["matrix"].to_pylist())], pa.binary())})

    while left > FAN_IN:
        left = math.ceil(left / FAN_IN)
        parts = keep(parts.select(F.pmod("part", F.lit(left)).alias("part"), "matrix").groupBy("part")
                     .applyInArrow(merged, "part long, matrix binary"), "matrices")
    return [r["matrix"] for r in parts.head(FAN_IN)]


def _by_task(rows: DataFrame, reduce) -> DataFrame:
    """One matrix of each task that has rows: ``reduce`` takes its blocks of integers."""
    def run(batches):
        found = reduce(_integers(b) for b in batches if b.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "matrix": [found]},
                                             pa.schema([("part", pa.int64()), ("matrix", pa.binary())]))
    return rows.select("vector").mapInArrow(run, "part long, matrix binary")


def merge_triangles(matrices: list[bytes], dimension: int) -> bytes:
    r = None
    for m in matrices:
        r = _triangle(r, np.frombuffer(m).reshape(-1, dimension))
    return r.tobytes()


def merge_moments(moments: list[bytes], width: int) -> bytes:
    """Count, means and centred products of several sets of rows as those of all (merged in pairs of sums,
    never by squares of uncentred values)."""
    n, mean, products = 0.0, np.zeros(width), np.zeros((width, width))
    for m in moments:
        m = np.frombuffer(m)
        k, also, more = m[0], m[1:width + 1], m[width + 1:].reshape(width, width)
        if k:
            apart = also - mean
            products = products + more + np.outer(apart, apart) * (n * k / (n + k))
            mean = mean + apart * (k / (n + k))
            n += k
    return np.concatenate(([n], mean, products.ravel())).tobytes()


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """``vec_id`` and ``vector`` of the rows that take part, how many they are, and their dimension."""
    v = F.col(vector).cast("array<double>")
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**46))
    rows = rows.where(F.col("vector").isNotNull() & ~bad)
    length = F.size("vector")
    top = rows.groupBy(length.alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    n, d = (top["n"], top["d"]) if top else (0, 0)
    return rows.where(length == d), n, d


def sums_of(rows: DataFrame, dimension: int) -> list[int]:
    """Exact sums of the integers per dimension."""
    def summed(batches):
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch)
                fits = int(np.abs(x).max(initial=0)) * len(x) <= _LONG
                totals = (x if fits else x.astype(object)).sum(0).tolist()
                yield pa.RecordBatch.from_pydict({"at": list(range(len(totals))), "total": [str(t) for t in totals]})

    found = (rows.select("vector").mapInArrow(summed, "at long, total string")
             .groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).head(dimension))
    return [int(r["total"]) for r in sorted(found, key=lambda r: r["at"])]


class Whitening:
    """What was learnt: ``n``, ``sums``, ``directions`` (dimension x components, each over the root of its
    eigenvalue), ``explained`` and ``identity_error``."""

    def __init__(self, n, sums, directions, explained, identity_error=None):
        self.n, self.sums, self.directions = n, sums, directions
        self.explained, self.identity_error = explained, identity_error


def fit(rows: DataFrame, n: int, dimension: int, most: int = MOST) -> Whitening | None:
    """Learn the whitening of ``rows`` (of ``usable``); None where no direction has variance."""
    if not n or not dimension:
        return None
    sums = sums_of(rows, dimension)

    def triangle(blocks):
        r = None
        for x in blocks:
            r = _triangle(r, _centred(x, n, sums))
        return None if r is None else r.tobytes()

    def merged(matrices):
        return merge_triangles(matrices, dimension)

    r = np.frombuffer(merged(_gathered(_by_task(rows, triangle), merged))).reshape(-1, dimension)
    r = np.concatenate((r, np.zeros((dimension - len(r), dimension))))
    values, directions = bidiagonal.eigen(r)
    good = min(most, int((values > LEAST**2 * values[0]).sum())) if values[0] > 0 else 0
    if not good:
        return None
    model = Whitening(n, sums, directions[:, :good] / np.sqrt(values[:good] / n), values[:good] / values.sum())

    def moments(blocks):
        def one(x):
            w = _centred(x, n, sums) @ model.directions
            apart = w - w.mean(0)
            return np.concatenate(([len(w)], w.mean(0), (apart.T @ apart).ravel())).tobytes()
        found = [one(x) for x in blocks]
        return merge_moments(found, good) if found else None

    def merged_moments(found):
        return merge_moments(found, good)

    total = np.frombuffer(merged_moments(_gathered(_by_task(rows, moments), merged_moments)))
    covariance = total[good + 1:].reshape(good, good) / total[0]
    model.identity_error = float(np.abs(covariance - np.eye(good)).max())
    return model


def whiten(embeddings: DataFrame, most: int = MOST) -> DataFrame:
    """Each usable row of ``embeddings`` (vec_id, embedding) on each of the ``most`` first components."""
    rows, n, dimension = usable(embeddings)
    model = fit(rows, n, dimension, most)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    k = len(model.explained)

    def projected(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            off = _deviations(_integers(batch), n, model.sums)
            whitened = (off.astype(float) / n) @ model.directions
            rows_ = batch.num_rows
            repeat = np.repeat(np.arange(rows_), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(repeat)),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows_),
                "n": np.full(rows_ * k, n, np.int64),
                "deviation": pa.array(_squares(off), pa.int64()).take(pa.array(repeat)),
                "whitened": whitened.ravel(),
                "explained": np.tile(model.explained, rows_),
                "identity_error": np.full(rows_ * k, model.identity_error)})

    return rows.select("vec_id", "vector").mapInArrow(projected, RESULT)
