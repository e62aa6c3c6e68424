"""Toxicity by a factorization machine over hashed terms.

Terms are words (ASCII letters, digits, all non-ASCII) and their byte prefixes, hashed into 2**20
buckets. At most ``most_rows`` labelled rows of each label are used, those of smallest hash of their
id; the rest is made up for by weights. Among their buckets the ``features`` of highest chi-square are
kept, and the machine (bias, weights and pairwise factors over present buckets) is fitted on them.
Scoring is one pass without a shuffle over all texts.

Null and empty texts have no terms and get the score of the bias alone. Labels that are null or name
no document are ignored; a document with several label rows counts once for each. Without labelled
rows every score is 0 to fifteen digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._tables import own_columns, stash

BITS = 20
PREFIXES = (4, 5, 6, 7, 8)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each term; a term of a row may come more than once."""
    data = _text.LOWER[data]
    starts, ends, rows = _text.spans(data, offsets, _text.ALNUM)
    hasher, found, of = _text.Hasher(data), [], []
    for length in (0, *PREFIXES):
        some = np.flatnonzero(ends - starts > length) if length else slice(None)
        s, e = starts[some], ends[some]
        found.append(_text.mix(hasher(s, s + length if length else e) + np.uint64(length)) >> np.uint64(64 - BITS))
        of.append(rows[some])
    return np.concatenate(of), np.concatenate(found).astype(np.int64)


def present(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, bucket) pairs in order; with ``known``, buckets are given by their place in it."""
    rows, buckets = terms(data, offsets)
    if known is not None:
        place = known[buckets]
        rows, buckets = rows[place >= 0], place[place >= 0]
    pairs = np.unique((rows << np.int64(BITS)) | buckets)
    return pairs >> np.int64(BITS), pairs & np.int64((1 << BITS) - 1)


class Machine(NamedTuple):
    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def places(self) -> np.ndarray:
        known = np.full(1 << BITS, -1, np.int64)
        known[self.buckets] = np.arange(len(self.buckets))
        return known

    def score(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of ``n`` rows with the given present features."""
        total = self.bias + np.bincount(rows, self.weights[places], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[places, k]
            total += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(rows: np.ndarray, places: np.ndarray, y: np.ndarray, weight: np.ndarray, buckets: np.ndarray, rank: int = 8, epochs: int = 400, rate: float = 0.05, l2: float = 1e-4) -> Machine:
    """Weighted logistic loss, minimised by Adam over all the rows at once."""
    n, d = len(y), len(buckets)
    x = np.zeros((n, d), np.float32)
    x[rows, places] = 1
    weight = (weight / weight.sum()).astype(np.float32)
    random = np.random.default_rng(7)
    w, v, b = np.zeros(d, np.float32), random.normal(0, 0.05, (d, rank)).astype(np.float32), np.float32(0)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, np.zeros(1, np.float32))]
    for step in range(1, epochs + 1):
        xv = x @ v
        z = b + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gx = x.T @ g
        grads = gx + l2 * w, x.T @ (g[:, None] * xv) - v * gx[:, None] + l2 * v, np.array([g.sum()], np.float32)
        moves = []
        for (m, s), grad in zip(state, grads, strict=True):
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8))
        w, v, b = w - moves[0], v - moves[1], b - moves[2][0]
    return Machine(buckets, float(b), w.astype(np.float64), v.astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", features: int = 1024, most_rows: int = 10_000, rank: int = 8, epochs: int = 400) -> Machine:
    """A machine fitted to ``label`` (0 or 1) of ``labels``, found in ``docs`` by ``id``.

    ``most_rows`` bounds the labelled rows of each label; with the ids so bounded, they are broadcast
    to the documents, whose texts never move.
    """
    labels = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    totals = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = [labels.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most_rows) for y in (0, 1)]
    known = stash(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        for batch in _text.slices(batches, "text"):
            y = batch.column("y").to_numpy(zero_copy_only=False)
            rows, buckets = present(*_text.utf8(batch.column("text")))
            for k in (0, 1):
                sums[k] += np.bincount(buckets[y[rows] == k], minlength=1 << BITS).astype(np.int32)
        found = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[0, found].astype(np.int64)), pa.array(sums[1, found].astype(np.int64))], ["bucket", "n0", "n1"])

    sampled = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sampled.get(0, 0), sampled.get(1, 0)
    if not n0 + n1:
        return Machine(np.zeros(0, np.int64), -35.0, np.zeros(0), np.zeros((0, rank)))
    df, off = F.col("n0") + F.col("n1"), F.col("n1") * F.lit(n0) - F.col("n0") * F.lit(n1)
    chi = off.cast("double") * off / (df * (F.lit(n0 + n1) - df) + 1.0)
    best = known.mapInArrow(counted, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(df >= 3).orderBy(chi.desc(), "bucket").limit(features)
    buckets = np.array(sorted(r["bucket"] for r in best.collect()), np.int64)
    place = Machine(buckets, 0.0, buckets, buckets[:, None]).places()

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "text"):
            rows, places = present(*_text.utf8(batch.column("text")), place)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), _text.lists(places, np.bincount(rows, minlength=batch.num_rows), pa.int32())], ["id", "y", "x"])

    schema = T.StructType([known.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.IntegerType()))])
    got = known.mapInArrow(selected, schema).orderBy(F.xxhash64("id"), "id", "y").toArrow()
    x, y = got.column("x").combine_chunks(), got.column("y").to_numpy().astype(np.float32)
    counts = np.diff(x.offsets.to_numpy())
    weight = np.where(y == 1, totals.get(1, 0) / max(1, n1), totals.get(0, 0) / max(1, n0))
    return fit(np.repeat(np.arange(len(counts)), counts), x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), y, weight, buckets, rank, epochs)


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with a double column ``toxicity`` (prefixed if there is such a column), from 0 to 1."""
    name = own_columns(docs, "toxicity")["toxicity"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = machine.places()
        for batch in _text.slices(batches, text):
            rows, places = present(*_text.utf8(batch.column(text)), place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(machine.score(rows, places, batch.num_rows))], [*batch.schema.names, name])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
