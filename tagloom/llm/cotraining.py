"""Quality by co-training of two views: what a text says, and what is known about its page.

The content view has counts and shares of the text alone and its words, hashed to ``WORDS`` buckets; the metadata view has
source, language and recorded length. Each view gets a logistic regression, fitted by Spark over all its labelled rows. In each of ``rounds`` rounds
either classifier labels unlabelled rows it is surest of, and these join the other view's training
rows with ``pseudo_weight``. A row counts as sure when its score passes the quantile of
unlabelled scores that leaves ``share`` of them, on both ends. At last, each
view is calibrated by a logistic fit on labelled rows of a fold it was not trained on, and the calibrated log odds
of both are combined by one more such fit. All documents are scored.

Null texts are empty; null metadata is a value of its own. With labels of one kind only, every score
is the share of that kind (0 or 1); without any label it is 0.5. Labels name documents by id; each row of
``docs`` gives one row, also when ids repeat or are null (a null id has no label). Labels of one id are averaged, and a tie rounds up. Texts
of any length are read whole; other columns of ``docs``, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._tables import stash

CONTENT = ("length", "words", "letters", "digits", "marks", "capitals", "mean_word", "mean_line", "repeats", "short", "ends", "odd", "distinct")
BUCKETS, WORDS = 16, 64
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#$%&*<>{}[]~^|\\=_", ".!?", ",;:'\"()-", " \t\r", "\n")
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _k


def content_features(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text: what ``CONTENT`` names, then the shares of its words in the buckets."""
    data, offsets = _text.utf8(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * (len(_CLASSES) + 1) + _CLASS[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1).astype(float)
    capitals, lower, digits, odd, ends, marks, gaps, lines = kinds.T[:-1]
    length = np.bincount(row, (data & 0xC0) != 0x80, n)
    twice = np.zeros(len(data))
    twice[3:] = (data[3:] == data[1:-2]) & (data[2:-1] == data[:-3]) & (row[3:] == row[:-3])
    starts, stops, of = _text.spans(data, offsets, _text.PLAIN)
    hashes = _text.Hasher(data)(starts, stops)
    words = np.bincount(of, minlength=n).astype(float)
    order = np.lexsort((hashes, of))
    new = np.ones(len(of), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    shares = np.bincount(of * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, -1)
    some, all_ = np.maximum(words, 1), np.maximum(length, 1)
    out = [
        np.log1p(length), np.log1p(words), (capitals + lower) / all_, digits / all_, marks / all_, capitals / (capitals + lower + 1),
        (length - gaps - lines) / some / 10, np.log1p(length / (lines + 1)), np.bincount(row, twice, n) / all_, np.bincount(of, stops - starts <= 3, n) / some, ends / some, odd / all_,
        np.bincount(of[order], new, n) / some,
    ]
    return np.concatenate([np.stack(out, 1), shares / some[:, None]], 1)


def _viewed(docs: DataFrame, id: str, text: str, meta: Column) -> DataFrame:
    """id and both views of each row."""
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL("content array<double>, meta array<double>").fields])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "text"):
            found = content_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), _text.lists(found.reshape(-1), np.full(len(found), found.shape[1]), pa.float64()), batch.column("meta")], schema.fieldNames())

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), meta.alias("meta")).mapInArrow(seen, schema)


def metadata_features(source: Column, lang: Column, n_chars: Column) -> Column:
    """Hashed source, language by bucket and the recorded length."""
    one = lambda c, salt: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: (F.pmod(F.xxhash64(F.lit(salt), F.coalesce(c, F.lit(""))), F.lit(BUCKETS)) == k).cast("double"))
    size = F.log1p(F.greatest(F.coalesce(n_chars, F.lit(0)), F.lit(0)).cast("double"))
    return F.concat(one(source, 1), one(lang, 2), F.array(size, size * size / 10, n_chars.isNull().cast("double")))


def _fit(rows: DataFrame, features: str, prior: float = 1e-3):
    model = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=prior, maxIter=30)
    return model.fit(rows.select(array_to_vector(features).alias("v"), F.col("y").cast("double").alias("y"), "w"))


def _odds(model, features: str) -> Column:
    """The model's log odds as an expression of an array column: short, as the driver compiles it anew for each fit."""
    terms = F.zip_with(features, F.lit(model.coefficients.toArray()), lambda x, a: a * x)
    return F.aggregate(terms, F.lit(float(model.intercept)), lambda z, x: z + x)


def quality_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", label: str = "quality", rounds: int = 2, share: float = 0.1, pseudo_weight: float = 0.3) -> DataFrame:
    """id, content_score, metadata_score and score (all 0 to 1) of every row of ``docs``."""
    keys = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("id")).agg(F.round(F.avg(label)).cast("int").alias("y"))
    views = _viewed(docs, id, text, metadata_features(F.col(source), F.col(lang), F.col(n_chars)))
    rows = stash(views.join(keys, "id", "left").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5))))
    named = lambda c, m, s: rows.select(F.col("id").alias(id), c.alias("content_score"), m.alias("metadata_score"), s.alias("score"))
    kinds = {r["y"]: r["count"] for r in rows.where("y is not null").groupBy("y").count().collect()}
    if len(kinds) < 2:
        only = F.lit(float(next(iter(kinds)))) if kinds else F.lit(0.5)
        return named(only, only, only)
    train = rows.where("y is not null and fold != 0").withColumn("w", F.lit(1.0))
    check = rows.where("y is not null and fold = 0").withColumn("w", F.lit(1.0))
    if min(train.agg(F.min("y"), F.max("y")).first()[:]) == train.agg(F.max("y")).first()[0] or check.isEmpty() or check.select("y").distinct().count() < 2:
        train = check = rows.where("y is not null").withColumn("w", F.lit(1.0))  # too few labels to set some apart
    free = rows.where("y is null")
    sets = {"content": train, "meta": train}
    models = {view: _fit(sets[view], view) for view in sets}
    for _ in range(rounds):
        sets = {}
        for giver, taker in (("content", "meta"), ("meta", "content")):
            z = _odds(models[giver], giver)
            low, high = free.agg(F.percentile_approx(z, [share, 1 - share], 1000)).first()[0] or (None, None)
            if low is None:
                sets[taker] = train
                continue
            # only what the giver truly believes: its surest rows, on the side of their label
            sure = free.withColumn("z", z).where(((F.col("z") >= high) & (F.col("z") > 0)) | ((F.col("z") <= low) & (F.col("z") < 0)))
            sets[taker] = train.unionByName(sure.withColumn("y", (F.col("z") > 0).cast("int")).withColumn("w", F.lit(float(pseudo_weight))).drop("z"))
        models = {view: _fit(sets[view], view) for view in sets}
    odds = {view: _odds(models[view], view) for view in models}
    calibrated = {}
    for view in odds:
        platt = _fit(check.withColumn("x", F.array(odds[view])), "x")
        calibrated[view] = F.lit(float(platt.intercept)) + F.lit(float(platt.coefficients[0])) * odds[view]
    both = _fit(check.withColumn("x", F.array(calibrated["content"], calibrated["meta"])), "x")
    z = F.lit(float(both.intercept)) + F.lit(float(both.coefficients[0])) * calibrated["content"] + F.lit(float(both.coefficients[1])) * calibrated["meta"]
    p = lambda x: 1 / (1 + F.exp(-x))
    return named(p(calibrated["content"]), p(calibrated["meta"]), p(z))
