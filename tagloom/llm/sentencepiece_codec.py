"""SentencePiece-style encoding as a max-plus scan, and its exact decoding.

A text's encoding is the sequence of vocabulary pieces of greatest total score that spells a space and
then the text; characters outside the vocabulary are spelled in byte pieces, so decoding gives back
every text. Scores follow the order of the model's own scores (see ``Vocabulary``); the model file that
is at hand was made for merging, so ids can differ from those of its merge procedure.

Texts up to ``chunk`` bytes are encoded where they lie. Longer ones are cut into chunks wherever that
falls. A path crosses a cut by a piece that reaches d bytes into the next chunk, so a chunk is a
max-plus matrix from d at its start to d at its end. Matrices are found for each chunk alone,
combined associatively, by prefix scans over ``fan`` of a document's matrices in a row, then over their products, and so on; with the states at its cuts
known each chunk is traced back alone.

Null and empty texts have no pieces and decode to the empty text. Repeated rows are encoded alike;
input columns are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._pieces import TOKENIZER, Vocabulary, best, trace
from ._tables import own_columns, stash

CHUNK = 1 << 15
#: Bytes of text whose distinct units are encoded together.
TOGETHER = 1 << 20
_kept: dict = {}


def _vocabulary(key: str, sent) -> Vocabulary:
    if key not in _kept:
        _kept.clear()
        _kept[key] = sent.value
    return _kept[key]


def encode_ranges(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of each byte range, and how many each has; equal units are encoded once."""
    cuts = vocabulary.cuts(data)
    begin = np.searchsorted(cuts, starts, "right")
    stop = np.searchsorted(cuts, ends, "left")
    inner = stop - begin
    inner[ends <= starts] = -1
    per = inner + 1  # units of each range
    unit_range = np.repeat(np.arange(len(starts)), per)
    nth = np.arange(len(unit_range)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    padded = np.append(cuts, 0)
    a = np.where(nth == 0, starts[unit_range], padded[np.minimum(begin[unit_range] + nth - 1, len(cuts))])
    b = np.where(nth == per[unit_range] - 1, ends[unit_range], padded[np.minimum(begin[unit_range] + nth, len(cuts))])
    hashes = _text.Hasher(data)(a, b)
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    lattice = vocabulary.lattice(*_text.gather(data, a[at], b[at]))
    value = best(lattice, vocabulary.logp)
    pieces, counts = trace(lattice, value, vocabulary.logp, lattice.base[1:] - 1)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out, _ = _text.gather(pieces, offsets[which], offsets[which + 1])
    return out, np.bincount(unit_range, counts[which], len(starts)).astype(np.int64)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space in front of each that is not empty."""
    sizes = np.diff(offsets)
    more = (sizes > 0).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + more)])
    out = np.full(bounds[-1], 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[bounds[:-1][more > 0]] = False
    out[keep] = data
    return out, bounds


def transfer(vocabulary: Vocabulary, chunk: bytes, size: int) -> np.ndarray:
    """The matrix of best scores from offset i of a chunk to ``size`` + j, by pieces in ``chunk`` (which looks ahead)."""
    states = vocabulary.longest
    data = np.frombuffer(chunk, np.uint8)
    out = np.full((states, states), -np.inf)
    cuts = vocabulary.cuts(data)
    cuts = cuts[cuts <= size]
    reach = min(states, len(data) - size + 1)

    def tails(begin: int) -> np.ndarray:
        lattice = vocabulary.lattice(data[begin:], np.array([0, len(data) - begin]))
        return best(lattice, vocabulary.logp)[size - begin : size - begin + reach]

    if not len(cuts):
        for i in range(min(states, size + 1)):
            if i == len(data) or (data[i] & 0xC0) != 0x80 or i == 0:
                out[i, :reach] = tails(i) if i < len(data) else [0.0]
        return out
    first, last = int(cuts[0]), int(cuts[-1])
    heads = np.arange(min(states, first + 1))
    # texts from each possible start to the first cut, as units side by side
    packed, offsets = _text.gather(data, heads, np.full(len(heads), first))
    lattice = vocabulary.lattice(packed, offsets)
    to_first = best(lattice, vocabulary.logp)[lattice.base[1:] - 1]
    to_first[(heads > 0) & ((data[np.minimum(heads, len(data) - 1)] & 0xC0) == 0x80)] = -np.inf
    middle = np.concatenate([cuts[:-1][:, None], cuts[1:][:, None]], 1)
    _, at, which = np.unique(_text.Hasher(data)(middle[:, 0], middle[:, 1]), return_index=True, return_inverse=True)
    if len(middle):
        lattice = vocabulary.lattice(*_text.gather(data, middle[at, 0], middle[at, 1]))
        inner = best(lattice, vocabulary.logp)[lattice.base[1:] - 1][which].sum()
    else:
        inner = 0.0
    end = tails(last) if last < len(data) else np.zeros(1)
    out[heads, :reach] = to_first[:, None] + inner + end[None, :reach]
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    out = np.full(a.shape, -np.inf)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., k, None, :], out=out)
    return out


def products(matrices: np.ndarray) -> np.ndarray:
    """The product of the matrices up to and with each, by doubling."""
    ahead, step = matrices.copy(), 1
    while step < len(ahead):
        ahead[step:] = product(ahead[:-step], ahead[step:])
        step *= 2
    return ahead


def boundaries(matrices: np.ndarray, enter: int = 0, leave: int = 0) -> np.ndarray:
    """The state before each chunk and after the last, of the best path from state ``enter`` to state ``leave``."""
    ahead = products(matrices)
    states = np.zeros(len(matrices) + 1, np.int64)
    states[0], states[-1] = enter, leave
    for k in range(len(matrices) - 1, 0, -1):
        states[k] = np.argmax(ahead[k - 1][enter] + matrices[k][:, states[k + 1]])
    return states


#: Matrices that a task combines at once.
FAN = 64


def chunk_states(matrices: DataFrame, chunks: int, longest: int, fan: int = FAN) -> DataFrame:
    """k1, k2, n, enter and leave of every chunk, from its matrix (columns k1, k2, n, matrix); no text has more than ``chunks``.

    Each ``fan`` matrices in a row become one, and so on until a text has ``fan`` at most; from there the states at the
    cuts are handed down. So no task has all matrices of a giant text.
    """
    kind = "k1 long, k2 long, n int, enter int, leave int"

    def stacked(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
        group = group.sort_by("n")
        return group, np.stack([np.frombuffer(m.as_py()).reshape(longest, longest) for m in group.column("matrix")])

    def folded(group: pa.Table) -> pa.Table:
        group, found = stacked(group)
        return pa.table({"k1": group["k1"][:1], "k2": group["k2"][:1], "n": group["above"][:1], "matrix": pa.array([products(found)[-1].tobytes()], pa.binary())})

    def joined(group: pa.Table) -> pa.Table:
        group, found = stacked(group)
        states = boundaries(found, group["first"][0].as_py(), group["last"][0].as_py())
        return pa.table({"k1": group["k1"], "k2": group["k2"], "n": group["n"], "enter": pa.array(states[:-1].astype(np.int32)), "leave": pa.array(states[1:].astype(np.int32))})

    above = matrices.withColumn("above", F.expr(f"cast(n div {fan} as int)"))
    if chunks <= fan:
        return above.withColumn("first", F.lit(0)).withColumn("last", F.lit(0)).groupBy("k1", "k2").applyInArrow(joined, kind)
    fewer = stash(above.groupBy("k1", "k2", "above").applyInArrow(folded, "k1 long, k2 long, n int, matrix binary"))
    states = chunk_states(fewer, -(-chunks // fan), longest, fan).select("k1", "k2", F.col("n").alias("above"), F.col("enter").alias("first"), F.col("leave").alias("last"))
    return above.join(states, ["k1", "k2", "above"]).groupBy("k1", "k2", "above").applyInArrow(joined, kind)


def encode(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int; prefixed if there is such a column)."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(tokenizer)
    sent, key = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    name = own_columns(docs, "ids")["ids"]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    longest = vocabulary.longest

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(key, sent)
        for batch in _text.slices(batches, text, TOGETHER):
            data, offsets = spaced(*_text.utf8(batch.column(text)))
            pieces, counts = encode_ranges(v, data, offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, _text.lists(pieces, counts, pa.int32())], [*batch.schema.names, name])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("size", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            for value in batch.column(0):
                data = b" " + value.as_py().encode()
                k1, k2 = (int(x) for x in _both(data))
                for n, at in enumerate(range(0, len(data), chunk)):
                    yield pa.RecordBatch.from_pylist([{"k1": k1, "k2": k2, "n": n, "size": min(chunk, len(data) - at), "bytes": data[at : at + chunk + longest - 1]}], arrow)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(key, sent)
        for batch in batches:
            found = [transfer(v, b.as_py(), s.as_py()).tobytes() for b, s in zip(batch.column("bytes"), batch.column("size"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "n")), pa.array(found, pa.binary())], ["k1", "k2", "n", "matrix"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(key, sent)
        for batch in _text.slices(batches, "bytes", TOGETHER):
            data, offsets = _text.utf8(batch.column("bytes"))
            enter, leave, size = (batch.column(c).to_numpy().astype(np.int64) for c in ("enter", "leave", "size"))
            pieces, counts = encode_ranges(v, data, offsets[:-1] + enter, offsets[:-1] + size + leave)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "n")), _text.lists(pieces, counts, pa.int32())], ["k1", "k2", "n", "ids"])

    size = F.coalesce(F.octet_length(text), F.lit(0))
    small = docs.where(size < chunk).mapInArrow(encoded, schema)
    giant = docs.where(size >= chunk)
    # rows of one text share its chunks
    chunks = stash(giant.select(text).distinct().mapInArrow(cut, "k1 long, k2 long, n int, size int, bytes binary"))
    most = (chunks.agg(F.max("n")).first()[0] or 0) + 1
    matrices = chunks.mapInArrow(scored, "k1 long, k2 long, n int, matrix binary")
    cuts = chunk_states(stash(matrices) if most > fan else matrices, most, longest, fan)
    parts = chunks.join(cuts, ["k1", "k2", "n"]).select("k1", "k2", "n", "size", "enter", "leave", "bytes").mapInArrow(traced, "k1 long, k2 long, n int, ids array<int>")
    whole = parts.groupBy("k1", "k2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("found"))
    k = own_columns(docs, "k1", "k2", "found")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([_both(b" " + x.as_py().encode()) for x in batch.column(text)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], [*batch.schema.names, k["k1"], k["k2"]])

    long = giant.mapInArrow(marked, T.StructType([*docs.schema.fields, T.StructField(k["k1"], T.LongType()), T.StructField(k["k2"], T.LongType())]))
    long = long.join(whole.select(F.col("k1").alias(k["k1"]), F.col("k2").alias(k["k2"]), F.col("found").alias(k["found"])), [k["k1"], k["k2"]], "left").select(*docs.columns, F.col(k["found"]).alias(name))
    return small.unionByName(long)


def _both(data: bytes) -> np.ndarray:
    import hashlib

    return np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64)


def decode(encoded: DataFrame, ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``encoded`` with a string column ``decoded`` (prefixed if there is such a column)."""
    sent, key = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer)), uuid.uuid4().hex
    name = own_columns(encoded, "decoded")["decoded"]

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(key, sent)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = []
                for row in batch.column(ids):
                    out.append(v.spell(row.values.to_numpy().astype(np.int64))[1:].tobytes().decode() if row.is_valid and len(row) else "")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return encoded.mapInArrow(spelled, T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())]))


def codec_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """id, n_tokens, ids_sha256 (ids joined by commas), decoded_sha256 and exact (the round trip gave the text back)."""
    both = decode(encode(docs.select(id, text), text, tokenizer, chunk, fan), "ids", tokenizer)
    return both.select(id, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce(text, F.lit(""))).alias("exact"))
