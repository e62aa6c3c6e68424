"""Exact Jaccard join of word 5-gram sets by universe partition and pigeonhole.

A document's set are the distinct hashes of its 5-word shingles; fewer words are one shingle. Two sets
link when ``100 * |x & y| >= 75 * |x | y|``. Equal sets are one class, whose smallest id stands for it.

1. Shared shingles. A link needs three quarters of each set's shingles in common, so under the order of
   hashes at least k of the first ``n - ceil(0.75 n) + k`` of both sets. Classes with fewer prefix
   shingles that another class has too can have no link: most documents end here, and their texts are
   never moved. The same count over all shingles of what remains, of which three quarters must be
   shared, then drops documents that only quote a common passage.
2. Signatures. Sizes fall in bands of ratio 4/3. In a band whose sets are below ``top``, linked sets
   differ in at most ``d = 2 * (top - 1) // 7`` shingles. Shingles are hashed into d + 1 segments, so
   two linked sets agree in one segment at least (threshold 0). An empty segment would agree with very
   many, so it is skipped (threshold -1) and paid for by a non-trivial segment of a reserve, whose
   one-deletion neighbourhood is indexed too (threshold 1). A set whose empty segments outnumber its
   usable reserve keeps them as signatures. Each set is indexed in its band and, as the smaller
   partner, in the next one.
3. Verification. Candidate pairs are checked exactly on their texts; see ``bucket_components`` for how
   connected groups avoid all pairs.

Null and empty texts have no set and are alone. Rows of one id are one document, whose texts are linked
under that id, and so are rows whose id is null; their component is the smallest id that is not null, or
null. Shingles are hashed to 64 bits, and classes are told apart by such sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _packed, _text
from ._components import bucket_components, connected
from ._tables import scratch, stash

SIZE = 5
SHARE = 75
RESERVE = 16
_I64 = np.int64


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, in order of row and hash."""
    data, offsets = _text.utf8(column)
    data = _text.LOWER[data]
    starts, ends, rows = _text.spans(data, offsets, _text.PLAIN)
    hashes = _text.Hasher(data)(starts, ends)
    first, found = _text.windows(hashes, rows, SIZE)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    of = rows[first]
    short = np.flatnonzero((counts > 0) & (counts < SIZE))
    if len(short):
        begin = np.searchsorted(rows, short)
        total = np.zeros(len(short), np.uint64)
        for k in range(SIZE - 1):
            more = counts[short] > k
            total[more] = _text.mix(total[more] * np.uint64(31) + hashes[begin[more] + k] + np.uint64(k + 1))
        of, found = np.concatenate([of, short]), np.concatenate([found, _text.mix(total + np.uint64(1))])
        order = np.argsort(of, kind="stable")
        of, found = of[order], found[order]
    found = _text.sort_within(of, found)
    keep = np.ones(len(of), bool)
    keep[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
    return of[keep], found[keep]


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Wrapping sums of 64-bit values by row."""
    ends = np.searchsorted(of, np.arange(n + 1))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def _classes(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each shingle of a batch, and the set size and class of each row."""
    of, found = shingles(batch.column(text))
    return of, found, np.bincount(of, minlength=batch.num_rows), _sums(of, _text.mix(found + np.uint64(1)), batch.num_rows)


def class_keys(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc, n (set size) and node (the class' hash) of each row."""
    schema = T.StructType([T.StructField("doc", docs.schema[id].dataType), *T.StructType.fromDDL("n long, node long").fields])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, text):
            _, _, n, node = _classes(batch, text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node.view(_I64))], schema.fieldNames())

    return docs.select(id, text).mapInArrow(keyed, schema)


def needed(n):
    """Shingles that any link of a set of ``n`` needs in common."""
    return (n * SHARE + 99) // 100


def shingle_counts(texts: DataFrame, shingles: int, prefix: bool) -> DataFrame:
    """node and k: how many shingles of a class, or of its prefix, another class has too; ``shingles`` tells how many there are."""
    ranges = _packed.ranges_for(shingles)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[_packed.Pairs]:
        for batch in _text.slices(batches, "text"):
            of, found, n, node = _classes(batch, "text")
            begin = np.concatenate([[0], np.cumsum(n)])
            length = np.where(n > 2, n - needed(n) + np.maximum(1, n // 20) if prefix else n, 0)
            some = np.arange(len(of)) - begin[of] < length[of]
            yield found[some], node[of[some]]

    return _packed.shared_counts(texts.mapInArrow(lambda batches: _packed.pack(pairs(batches), ranges), _packed.SCHEMA), "node")


def bands(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of each size and the first size above the band: tops are 4, 6, 8, 11, ... (ratio 4/3)."""
    tops = [4]
    while tops[-1] <= n.max(initial=0):
        tops.append(-(-tops[-1] * 4 // 3))
    tops.append(-(-tops[-1] * 4 // 3))
    tops = np.array(tops, np.int64)
    return np.searchsorted(tops, n, "right"), tops


def signatures(of: np.ndarray, found: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every signature of the rows' sets, which come in order of row."""
    n = np.bincount(of, minlength=rows)
    band, tops = bands(n)
    out_rows, out_keys = [], []
    for ahead in (0, 1):
        b = band + ahead
        b[n < 3] = 0  # sets that only link with equal ones; a set of 3 links with sets of 4, as the smaller partner
        parts = 2 * (tops[np.minimum(b, len(tops) - 1)] - 1) // 7 + 1
        some = b[of] > 0
        o, h = of[some], found[some]
        segment = (_text.mix(h + np.uint64(0x51ED)) % parts[o].astype(np.uint64)).astype(_I64)
        begin = np.concatenate([[0], np.cumsum(np.where(b > 0, parts, 0))])
        place = begin[o] + segment
        total = begin[-1]
        owner = np.repeat(np.arange(rows), np.diff(begin))
        index = np.arange(total) - begin[owner]
        filled = np.bincount(place, minlength=total)
        value = _text.mix(h + np.uint64(0x77))
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, place, value)
        key = lambda where, s: _text.mix(_text.mix((b[owner[where]].astype(np.uint64) << np.uint64(40)) + index[where].astype(np.uint64)) + s)  # noqa: E731, B023
        full = np.flatnonzero(filled)
        out_rows.append(owner[full])
        out_keys.append(key(full, sums[full]))
        reserve = (index < RESERVE) & (filled >= 2)
        drop = np.flatnonzero(reserve[place])
        out_rows.append(o[drop])
        out_keys.append(key(place[drop], sums[place[drop]] - value[drop]))
        short = np.bincount(owner, filled == 0, rows) > np.bincount(owner, reserve, rows)
        empty = np.flatnonzero((filled == 0) & short[owner])
        out_rows.append(owner[empty])
        out_keys.append(key(empty, np.zeros(len(empty), np.uint64)))
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _shared(texts: DataFrame, shingles: int) -> DataFrame:
    """bucket and node of the classes that share a signature with another."""
    ranges = _packed.ranges_for(2 * shingles)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[_packed.Pairs]:
        for batch in _text.slices(batches, "text", _text.SLICE_BYTES // 2):
            of, found, _, node = _classes(batch, "text")
            rows, keys = signatures(of, found, batch.num_rows)
            yield keys, node[rows]

    return _packed.shared_pairs(texts.select("text").mapInArrow(lambda batches: _packed.pack(pairs(batches), ranges), _packed.SCHEMA))


def _sets(texts: DataFrame):
    """The shingles of classes, as (node, items)."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "text"):
            of, found = shingles(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), _text.lists(found.view(_I64), np.bincount(of, minlength=batch.num_rows), pa.int64())], ["node", "items"])

    return lambda nodes: texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(told, "node long, items array<long>")


#: Bits of a set's outline for each of its shingles, at least; a power of two in all.
OUTLINE = 4


def outlines(of: np.ndarray, found: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each row's set, for each part of the universe, whether an odd number of its shingles falls in it: two outlines differ in no more bits than their sets do in shingles."""
    bits = 1 << np.ceil(np.log2(np.maximum(n * OUTLINE, 64))).astype(_I64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    cell = (_text.mix(found + np.uint64(9)) & (bits[of] - 1).astype(np.uint64)).astype(_I64)
    packed = np.packbits((np.bincount(begin[of] + cell, minlength=begin[-1]) & 1).astype(np.uint8))
    return [packed[a:b].tobytes() for a, b in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist(), strict=True)]


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two outlines differ; the longer one is folded."""
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _verifier(texts: DataFrame):
    schema = "a long, b long"

    def drawn_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "text"):
            of, found, n, _ = _classes(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n), pa.array(outlines(of, found, n), pa.binary())], ["node", "n", "outline"])

    drawn = stash(texts.select("node", "text").mapInArrow(drawn_, "node long, n long, outline binary"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(x).to_numpy() for x in ("na", "nb"))
            least = np.array([apart(a, b) for a, b in zip(batch.column("oa").to_pylist(), batch.column("ob").to_pylist(), strict=True)], _I64)
            # overlap is at most (na + nb - least) / 2
            yield batch.select(["a", "b"]).filter(pa.array(100 * (na + nb - least) >= SHARE * (na + nb + least)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "ta", _text.SLICE_BYTES // 4):
            n = batch.num_rows
            common, union = _text.overlaps(*shingles(batch.column("ta")), *shingles(batch.column("tb")), n)
            linked = (100 * common >= SHARE * union) & (common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x: drawn.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("outline").alias(f"o{x}"))
        few = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "oa", "ob").mapInArrow(near, schema)
        ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return few.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(kept, schema)

    return verify


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles and component_id (smallest id that links reach) of each distinct id."""
    keys = stash(class_keys(docs, id, text))
    with scratch(docs.sparkSession):
        classes = keys.where("n > 0").groupBy("node").agg(F.min("doc").alias("rep"), F.first("n").alias("n"))
        total = keys.agg(F.sum("n")).first()[0] or 0
        seen = shingle_counts(docs.select(F.col(text).alias("text")), total * 3 // 10, True)
        least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * SHARE / 100) / 20))
        alive = stash(classes.where("n > 2").join(seen, "node").where(F.col("k") >= least).select("node", "rep", "n"))

        def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _text.slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_classes(batch, "text")[3].view(_I64)), batch.column("text")], ["node", "text"])

        # an id may have several texts: those of its rows that are alive count
        own = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("doc"), F.col(text).alias("text"))
        reps = alive.select("rep").distinct()
        # the list of ids grows with the corpus, and is not to be sent to all tasks at any size
        some = own.join(reps.hint("merge"), own["doc"].eqNullSafe(reps["rep"]), "left_semi").select("text").mapInArrow(classed, "node long, text string")
        some = stash(some.join(alive.select("node", "n"), "node").dropDuplicates(["node"]).select("node", "n", "text"))
        total = some.agg(F.sum("n")).first()[0] or 0
        seen = shingle_counts(some.select("text"), total, False)
        alive = some.select("node", "n").join(seen, "node").where(F.col("k") * 100 >= F.col("n") * SHARE).select("node")
        texts = stash(some.join(alive, "node", "left_semi").select("node", "text"))
        component = stash(bucket_components(stash(_shared(texts, total)), _verifier(texts), _sets(texts), SHARE), keep=True)

    # texts of one id are linked
    several = keys.where("n > 0").groupBy("doc").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high").drop("high")
    if not several.isEmpty():
        tied = keys.where("n > 0").alias("k").join(several.alias("s"), F.col("k.doc").eqNullSafe(F.col("s.doc"))).select(F.col("node").alias("a"), "b")
        component = connected(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(tied))
    placed = classes.join(component, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least_of = placed.groupBy("component").agg(F.min("rep").alias("least"))
    found = keys.where("n > 0").join(placed.join(least_of, "component").select("node", "least"), "node").select("doc", "n", "least")
    bare = keys.where("n = 0").select("doc", "n", F.lit(None).cast(keys.schema["doc"].dataType).alias("least"))
    whole = found.unionByName(bare).groupBy("doc").agg(F.max("n").alias("n_shingles"), F.min("least").alias("least"))
    return whole.select(F.col("doc").alias(id), "n_shingles", F.coalesce("least", "doc").alias("component_id"))
