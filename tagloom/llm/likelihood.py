"""Language-model scores by subword lattices: a document's probability over all its segmentations.

The pieces of an existing vocabulary spell each word (with a space in front) in many ways; its scores weight
all of them, and a forward recursion in log space adds them up. No piece
spans two words, so a document's probability is the product over its words and one end symbol, and
each distinct word's lattice is solved once for the whole corpus.

The vocabulary's own scores are the prior: ``rounds`` of expectation-maximisation over the training documents' lattices
add the pieces' expected uses to pseudo-counts that follow those scores and weigh ``prior`` times as much as all uses together.
With ``rounds = 0`` the vocabulary's scores stand alone.

1. Tasks count the distinct words of what they read; Spark adds up the counts of the training rows.
2. Lattices of the distinct words give expected piece counts (as many numbers as the vocabulary has
   pieces, whatever the corpus), for ``rounds`` rounds, and then each word's log probability.
3. Rows are dealt into blocks of bounded size in the order in which tasks read them, so repeated rows fill many
   blocks; a block asks for its distinct words' values and scores its documents with them.

A base score, with add-one word probabilities, comes along. Null and empty texts have just the end
symbol. Each row of ``docs`` gives one row, also when ids repeat or are null; rows for which ``training`` is null are not
learned from and are held out. Words are told apart by 64-bit hashes within a block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._pieces import TOKENIZER, Vocabulary, expected, forward
from ._tables import stash
from .sentencepiece_codec import _vocabulary

#: Bytes of text in a block, and distinct words a task holds before it passes their counts on.
BLOCK_BYTES, HELD = 8 << 20, 1 << 19


class _Words:
    """Counts by word of what has been added, with the words' bytes; one entry per hash."""

    def __init__(self) -> None:
        self.hashes, self.counts, self.spelled, self.waiting = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), [], 0
        self.parts: list[tuple] = []

    def add(self, data: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> None:
        data = _text.LOWER[data]
        starts, ends, rows = _text.spans(data, offsets, _text.PLAIN)
        hashes, at, which = np.unique(_text.Hasher(data)(starts, ends), return_index=True, return_inverse=True)
        packed, bounds = _text.gather(data, starts[at], ends[at])
        self.parts.append((hashes, np.bincount(which, weight[rows], len(hashes)).astype(np.int64), packed, bounds))
        self.waiting += len(hashes)

    def drain(self) -> tuple[pa.Array, pa.Array]:
        """Words and counts, distinct."""
        hashes = np.concatenate([p[0] for p in self.parts])
        counts = np.concatenate([p[1] for p in self.parts])
        packed = np.concatenate([p[2] for p in self.parts])
        sizes = np.concatenate([np.diff(p[3]) for p in self.parts])
        ends = np.cumsum(sizes)
        _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        self.parts, self.waiting = [], 0
        return _text.strings(packed, (ends - sizes)[at], ends[at]), pa.array(np.bincount(which, counts, len(at)).astype(np.int64))


def word_counts(dealt: DataFrame) -> DataFrame:
    """word and c (its tokens in training rows) for every distinct word of all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in _text.slices(batches, "text"):
            words.add(*_text.utf8(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
            if words.waiting > 4 * HELD:
                yield pa.RecordBatch.from_arrays(list(words.drain()), ["word", "c"])
        if words.parts:
            yield pa.RecordBatch.from_arrays(list(words.drain()), ["word", "c"])

    found = dealt.select("text", (~F.col("held")).alias("t")).mapInArrow(counted, "word string, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


def _units(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words with a space in front of each."""
    data, offsets = _text.utf8(words)
    bounds = offsets + np.arange(len(offsets))
    out = np.full(bounds[-1], 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[bounds[:-1]] = False
    out[keep] = data
    return out, bounds


def dealt_rows(docs: DataFrame, training: Column, id: str, text: str) -> DataFrame:
    """block, id, text and held of each row; a block's rows lie together and hold some ``BLOCK_BYTES`` of text, or one row."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL("text string, held boolean").fields])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = uuid.uuid4().int >> 65, 0
        for batch in _text.slices(batches, "text"):
            size = pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if held and held + size > BLOCK_BYTES:
                block, held = uuid.uuid4().int >> 65, 0
            held += size + batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), *batch.columns], schema.fieldNames())

    held = ~F.coalesce(training, F.lit(False))
    return stash(docs.select(F.col(id).alias("id"), F.col(text).alias("text"), held.alias("held")).mapInArrow(dealt, schema))


def score_likelihood(docs: DataFrame, training: Column, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, rounds: int = 4, prior: float = 1.0) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row.

    ``training`` is a condition that marks the rows to learn from.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(tokenizer)
    sent, key = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    dealt = dealt_rows(docs, training, id, text)
    ends = dealt.where("not held").count()
    words = stash(word_counts(dealt))
    total = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (total["n"] or 0) + ends, total["v"] + (1 if ends else 0)

    given = np.exp(vocabulary.logp)
    p_end = (ends + 1) / (n + 2)
    logp = vocabulary.logp + math.log1p(-p_end)
    for _ in range(rounds):
        start = logp

        def uses(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            vocabulary, found = _vocabulary(key, sent), np.zeros(len(start))
            for batch in _text.slices(batches, "word", 1 << 18):
                found += expected(vocabulary.lattice(*_units(batch.column(0))), start, batch.column(1).to_numpy().astype(np.float64))
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["piece", "uses"])

        counts = np.zeros(len(logp))
        for r in words.where("c > 0").mapInArrow(uses, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            counts[r["piece"]] = r["uses"]
        whole = (counts.sum() or 1.0) * (1 + prior)
        p_end = (ends + 1) / (whole + ends + 1)
        with np.errstate(divide="ignore"):
            logp = np.log((counts + given * (whole - counts.sum())) / (whole + ends + 1))
    final = logp

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(key, sent)
        for batch in _text.slices(batches, "word", 1 << 18):
            lattice = vocabulary.lattice(*_units(batch.column(0)))
            value = forward(lattice, final)[lattice.base[1:] - 1] / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], ["word", "c", "p"])

    values = stash(words.mapInArrow(valued, "word string, c long, p double"))
    schema = T.StructType([docs.schema[id], *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each block, or of each part of a block that a task reads."""
        words, now = _Words(), None

        def out() -> pa.RecordBatch:
            found, _ = words.drain()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), now)), found], ["block", "word"])

        for whole in batches:
            block = whole.column(0).to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else block
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if block[a] != now and words.parts:
                    yield out()
                now = int(block[a])
                for batch in _text.slices(iter([whole.slice(a, b - a)]), "text"):
                    words.add(*_text.utf8(batch.column("text")), np.zeros(batch.num_rows))
        if words.parts:
            yield out()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        data, offsets = _text.utf8(right.column("word"))
        hashes = _text.Hasher(data)(offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        hashes, c, p = hashes[order], right.column("c").to_numpy()[order], right.column("p").to_numpy()[order]
        base = np.log10((c + 1) / (n + v + 1))
        last = math.log10((ends + 1) / (n + v + 1)), math.log10(p_end)
        out = []
        for batch in _text.slices(iter(left.to_batches()), "text"):
            rows = batch.num_rows
            data, offsets = _text.utf8(batch.column("text"))
            data = _text.LOWER[data]
            starts, stops, of = _text.spans(data, offsets, _text.PLAIN)
            if len(hashes):
                at = np.searchsorted(hashes, _text.Hasher(data)(starts, stops))
            else:
                at = np.zeros(0, np.int64)
            tokens = np.bincount(of, minlength=rows)
            known = np.bincount(of, c[at] > 0, rows).astype(np.int64)
            out.append(pa.table([batch.column("id"), batch.column("held"), pa.array(tokens + 1), pa.array(known + (ends > 0)), pa.array(np.full(rows, n)), pa.array(np.bincount(of, base[at], rows) + last[0]), pa.array(np.bincount(of, p[at], rows) + last[1])], schema.fieldNames()))
        return pa.concat_tables(out)

    wanted = dealt.select("block", "text").mapInArrow(asked, "block long, word string")
    answers = wanted.join(values, "word").select("block", "word", "c", "p")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)
