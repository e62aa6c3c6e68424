"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, components.

Lines are what newlines separate, stripped of outer spaces, tabs and returns; blank lines are never
touched. Equal lines are one node (a hash). A line's set are the distinct hashes of its ``SHINGLE``
consecutive characters (a shorter line is one shingle). ``BANDS`` bands of ``ROWS`` MinHash values give candidates: two lines at
the threshold of 0.75 share a band with probability 0.9995. Candidates are verified exactly, links give components
by distributed union-find, and the first line of a component (by document id, text and line) is kept.

Lines that share a band by chance, a phrase mostly, are many more than near copies, and grow faster than the corpus. So a line leaves a
bucket in which no other agrees with it in ``AGREE`` of all MinHash values, as far as ``NIBBLE`` bits of each tell; of two lines at the threshold
with a common band that is so with a probability of 2e-11. Buckets of over ``MANY`` lines are left as they are.

Null and empty texts have no lines. A null id comes before all others. Rows that repeat a document's id and text are one document and
are cut alike; an id with several texts is several documents, in the order of their texts' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _packed, _text
from ._components import bucket_components
from ._tables import own_columns, scratch, stash

SHINGLE, BANDS, ROWS, SHARE = 8, 14, 3, 75
#: Minima in which near copies agree at least, bits of each that are compared, lines of the largest bucket in which they are, and pairs compared at once.
AGREE, NIBBLE, MANY, PAIRS = 14, 4, 4096, 1 << 18
_INK = _text.byte_class((0x20, 0x20), (0x09, 0x0D))
_I64 = np.int64


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number within the row (empty lines count) of each line with ink, stripped."""
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([breaks, offsets[1:]])
    starts.sort()
    ends.sort()
    some = starts < ends
    starts, ends = starts[some], ends[some]
    rows = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[rows])
    wide = np.flatnonzero(~_INK[data[starts]] | ~_INK[data[ends - 1]])
    if len(wide):
        at, sizes = starts[wide], ends[wide] - starts[wide]
        of = np.repeat(np.arange(len(wide)), sizes)
        place = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(of))
        ink = _INK[data[place]]
        of, place = of[ink], place[ink]
        low, high = np.searchsorted(of, np.arange(len(wide))), np.searchsorted(of, np.arange(len(wide)), "right")
        some = low < high
        starts[wide[some]], ends[wide[some]] = place[low[some]], place[high[some] - 1] + 1
        some = np.delete(np.arange(len(starts)), wide[~some])
        starts, ends, rows, number = starts[some], ends[some], rows[some], number[some]
    return starts, ends, rows, number


def char_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: _text.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Number of the line and hash of each of its SHINGLE-character shingles, in order of line; shorter lines have one, empty ones none."""
    begins = (data & 0xC0) != 0x80
    if plain := bool(begins.all()):
        first, per, n = starts, ends - starts, len(data)
    else:
        chars = np.append(np.flatnonzero(begins), len(data))
        first = np.searchsorted(chars, starts)
        per, n = np.searchsorted(chars, ends) - first, len(chars) - 1
    count = np.maximum(per - SHINGLE + 1, np.minimum(per, 1))
    of = np.repeat(np.arange(len(starts)), count)
    windows = max(0, n - SHINGLE + 1)
    if plain:
        whole = hasher.eights(windows)
    else:
        whole = hasher.eights(len(data))[begins][:windows]
        inner = np.flatnonzero(~begins)
        marked = np.zeros(len(data), bool)  # windows that reach over a character of several bytes
        for k in range(1, SHINGLE + 1):
            marked[inner[np.searchsorted(inner, k) :] - k] = True
        wide = np.flatnonzero(marked[begins][:windows])
        whole[wide] = hasher(chars[wide], chars[wide + SHINGLE])
    whole = np.append(whole, np.zeros(SHINGLE, np.uint64))
    found = np.concatenate([whole[:0], *(whole[a : a + k] for a, k in zip(first.tolist(), count.tolist(), strict=True))])
    short = np.flatnonzero((per > 0) & (per < SHINGLE))
    found[(np.cumsum(count) - count)[short]] = hasher(starts[short], ends[short])
    return of, found


def minhashes(of: np.ndarray, found: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of each row that has shingles, one column a row; 16 bits of each."""
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    x = (found >> np.uint64(32)).astype(np.uint32)
    random = np.random.default_rng(11)
    out, v = np.empty((BANDS * ROWS, len(begin)), np.uint32), np.empty_like(x)
    for k, a in enumerate(random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)):
        np.multiply(x, a | np.uint32(1), out=v)  # a permutation of the 32-bit hashes
        np.minimum.reduceat(v, begin, out=out[k])
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)  # all bits of a minimum count, low as it is


def line_table(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row per line with ink: doc, h (its text's hash), line number, node (the line's hash), in the first of a document n_lines (how many it has) and, where a task sees the line first, its minima."""
    schema = T.StructType([T.StructField("doc", docs.schema[id].dataType), *T.StructType.fromDDL("h long, line int, node long, n_lines long, minima binary").fields])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, text, _text.SLICE_BYTES // 4):
            data, offsets = _text.utf8(batch.column(1))
            hasher = _text.Hasher(data)
            starts, ends, rows, number = line_spans(data, offsets)
            whole, lines = hasher(offsets[:-1], offsets[1:]), hasher(starts, ends)
            nodes, at = np.unique(lines, return_index=True)
            keys = np.full(len(lines), None)
            if len(nodes):
                of, found = char_shingles(data, starts[at], ends[at], hasher)
                keys[at] = [k.tobytes() for k in minhashes(of, found).T]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(whole[rows].view(_I64)), pa.array(number.astype(np.int32)), pa.array(lines.view(_I64)), pa.array(np.bincount(rows)[rows], pa.int64(), mask=np.diff(rows, prepend=-1) == 0), pa.array(keys, pa.binary())], schema.fieldNames())

    return docs.select(id, text).mapInArrow(listed, schema)


def buckets(minima: np.ndarray) -> np.ndarray:
    """The BANDS bucket numbers of each row of ``minima``."""
    rows = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(16 * ROWS) | rows[:, :, 0]
    for k in range(1, ROWS):
        out |= rows[:, :, k] << np.uint64(16 * k)
    return out


def _minima(column: pa.Array) -> np.ndarray:
    return _text.utf8(column)[0].view(np.uint16).reshape(-1, BANDS * ROWS)


def _shared(lines: DataFrame) -> DataFrame:
    """bucket and node of the lines that share a bucket with another."""
    ranges = _packed.ranges_for(lines.where("minima is not null").count() * BANDS)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((buckets(_minima(b.column(0))).ravel(), np.repeat(b.column(1).to_numpy().view(np.uint64), BANDS)) for b in batches)
        return _packed.pack(pairs, ranges)

    return _packed.shared_pairs(lines.where("minima is not null").select("minima", "node").mapInArrow(signed, _packed.SCHEMA))


#: Words that hold the compared bits of a line's minima, and how many minima are in each.
WORDS, IN_WORD = -(-BANDS * ROWS * NIBBLE // 64), 64 // NIBBLE
_LOW = np.uint64(sum(1 << k for k in range(0, 64, NIBBLE)))


def sketches(minima: np.ndarray) -> np.ndarray:
    """NIBBLE bits of each of the minima, one row of WORDS numbers for each row."""
    out = np.zeros((len(minima), WORDS), np.uint64)
    for k in range(BANDS * ROWS):
        out[:, k // IN_WORD] |= (minima[:, k].astype(np.uint64) & np.uint64((1 << NIBBLE) - 1)) << np.uint64(k % IN_WORD * NIBBLE)
    return out


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many minima the sketches of each row agree."""
    x = left ^ right
    for k in (NIBBLE >> 1, NIBBLE >> 2):
        x |= x >> np.uint64(k)
    return BANDS * ROWS - np.bitwise_count(x & _LOW).sum(axis=1, dtype=_I64)


def near_some(edges: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which rows of ``told`` (sketches) agree enough with another of their bucket; each bucket ends at one of the ``edges``."""
    near = np.zeros(len(told), bool)
    place = np.arange(len(told))
    count = np.repeat(edges, np.diff(edges, prepend=0)) - place - 1
    ends, low = np.cumsum(count), 0
    while low < len(told):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        i = np.repeat(place[low:high], count[low:high])
        j = i + 1 + np.arange(len(i)) - (np.cumsum(count[low:high]) - count[low:high])[i - low]
        some = agreeing(told[i], told[j]) >= AGREE
        near[i[some]] = near[j[some]] = True
        low = high
    return near


def _thinned(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """``shared`` without the lines that agree with no other of a bucket."""
    names = [f"s{k}" for k in range(WORDS)]
    sent = lines.sparkSession.sparkContext.broadcast(_filter(shared.select("node")))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(_passes(sent.value, batch.column(1).to_numpy().view(np.uint64)))
            batch = batch.take(pa.array(some))
            found = sketches(_minima(batch.column(0))).view(_I64)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(np.ascontiguousarray(x)) for x in found.T)], ["node", *names])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [x.to_numpy() for x in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            edges = np.flatnonzero(np.diff(columns[0])) + 1
            whole = int(edges[-1]) if len(edges) else 0  # the last bucket may go on
            held = [x[whole:] for x in columns]
            if whole:
                yield out([x[:whole] for x in columns], edges)
        if held is not None and len(held[0]):
            yield out(held, np.array([len(held[0])]))

    def out(columns: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
        near = np.flatnonzero(near_some(edges, np.stack(columns[2:], axis=1).view(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(x[near]) for x in columns[:2]], ["bucket", "node"])

    of = lines.where("minima is not null").select("minima", "node").mapInArrow(told, ", ".join(f"{x} long" for x in ("node", *names)))
    of = of.groupBy("node").agg(*(F.max(x).alias(x) for x in names))
    # such buckets are few: MANY rows of shared are one here
    large = F.broadcast(stash(shared.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > MANY).select("bucket")))
    met_ = shared.join(large, "bucket", "left_anti").join(of, "node").select("bucket", "node", *names)
    met_ = met_.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, "bucket long, node long")
    return met_.unionByName(shared.join(large, "bucket", "left_semi").select("bucket", "node"))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Bytes, starts, ends and hashes of the distinct lines of each slice."""
    for batch in _text.slices(batches, "text", _text.SLICE_BYTES // 4):
        data, offsets = _text.utf8(batch.column(0))
        starts, ends, _, _ = line_spans(data, offsets)
        nodes, at = np.unique(_text.Hasher(data)(starts, ends), return_index=True)
        yield data, starts[at], ends[at], nodes


#: Bits of the filter for each node, about, and in all at most; with more nodes it lets more others pass, which a join drops.
FILTER, MOST = 16, 1 << 26


def _filter(nodes: DataFrame) -> np.ndarray:
    """Bits, one of which is set for each of the hashes in the column ``node``; of bounded size."""
    bits = 1 << max(16, min(MOST, FILTER * nodes.count()).bit_length() - 1)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(bits, np.uint8)
        for batch in batches:
            marked[_text.mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)] = 1
        parts = np.packbits(marked).reshape(-1, 1 << 13)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                parts[k] = parts[k] | x if k in parts else x
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["part", "bits"])

    schema, out = "part int, bits binary", np.zeros((bits >> 16, 1 << 13), np.uint8)
    for k, x in nodes.mapInArrow(told, schema).repartition("part").mapInArrow(joined, schema).collect():
        out[k] = np.frombuffer(x, np.uint8)
    return out.ravel()


def _passes(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = _text.mix(nodes) & np.uint64(8 * len(bits) - 1)
    return bits[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8) & 128 != 0


def _texts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """node, line, n (shingles, repeats count) and outline of the lines of ``shared``."""
    nodes = shared.select("node")
    sent = docs.sparkSession.sparkContext.broadcast(_filter(nodes))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, starts, ends, nodes in _once(batches):
            some = np.flatnonzero(_passes(sent.value, nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some].view(_I64)), _text.strings(data, starts[some], ends[some])], ["node", "line"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "line", _text.SLICE_BYTES // 4):
            data, offsets = _text.utf8(batch.column("line"))
            n, told = outlines(*char_shingles(data, offsets[:-1], offsets[1:], _text.Hasher(data)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(told, pa.binary())], ["node", "line", "n", "outline"])

    found = docs.mapInArrow(written, "node long, line string").join(nodes.distinct(), "node", "left_semi").dropDuplicates(["node"])
    return found.mapInArrow(drawn, "node long, line string, n long, outline binary")


#: Bits of an outline for each shingle, at least; a power of two in all.
OUTLINE = 2


def outlines(of: np.ndarray, found: np.ndarray, rows: int) -> tuple[np.ndarray, list[bytes]]:
    """Of each row: how many shingles it has, repeats too, and for each part of the universe whether one falls in it. Two outlines differ in no more bits than their sets do in shingles."""
    n = np.bincount(of, minlength=rows)
    bits = 1 << np.ceil(np.log2(np.maximum(n * OUTLINE, 64))).astype(_I64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    marked = np.zeros(begin[-1], np.uint8)
    marked[begin[of] + (found & (bits[of] - 1).astype(np.uint64)).astype(_I64)] = 1
    packed = np.packbits(marked).tobytes()
    return n, [packed[a:b] for a, b in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist(), strict=True)]


def apart(left: pa.Array, right: pa.Array) -> np.ndarray:
    """In how many bits the outlines of each row differ; the longer one is folded."""
    sizes = [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(_I64) for x in (left, right)]
    out, kinds = np.zeros(len(left), _I64), sizes[0] << 32 | sizes[1]
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        sides = []
        for column, size in zip((left, right), (int(kind) >> 32, int(kind) & 0xFFFFFFFF), strict=True):
            x = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), size // 8)
            while size > min(int(kind) >> 32, int(kind) & 0xFFFFFFFF):
                size //= 2
                x = x[:, : size // 8] | x[:, size // 8 :]
            sides.append(x)
        out[at] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
    return out


def _verifier(texts: DataFrame):
    """Keeps the pairs of lines whose shingle sets are similar enough."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            least = apart(batch.column("oa"), batch.column("ob"))
            # the union is at most half of what both have and what tells them apart
            yield batch.select(["a", "b"]).filter(pa.array(200 * least <= (100 - SHARE) * (both + least)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "ta", _text.SLICE_BYTES // 4):
            n = batch.num_rows
            sides = []
            for name in ("ta", "tb"):
                data, offsets = _text.utf8(batch.column(name))
                sides += char_shingles(data, offsets[:-1], offsets[1:], _text.Hasher(data))
            common, union = _text.overlaps(*sides, n)
            linked = (100 * common >= SHARE * union) & (common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    def verify(pairs: DataFrame) -> DataFrame:
        oa, ob = (texts.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("outline").alias(f"o{x}")) for x in "ab")
        ta, tb = (texts.select(F.col("node").alias(x), F.col("line").alias(f"t{x}")) for x in "ab")
        few = pairs.join(ob, "b").join(oa, "a").select("a", "b", "na", "nb", "oa", "ob").mapInArrow(near, "a long, b long")
        return few.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(kept, "a long, b long")

    return verify


def _sets(texts: DataFrame):
    """The shingles of lines, as (node, items)."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "line", _text.SLICE_BYTES // 4):
            data, offsets = _text.utf8(batch.column("line"))
            of, found = char_shingles(data, offsets[:-1], offsets[1:], _text.Hasher(data))
            found = _text.sort_within(of, found)
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("node"), _text.lists(found[new].view(_I64), np.bincount(of[new], minlength=batch.num_rows), pa.int64())], ["node", "items"])

    return lambda nodes: texts.join(nodes, "node", "left_semi").select("node", "line").mapInArrow(told, "node long, items array<long>")


def removed_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All lines with ink (doc, h, line, node), and doc, h, removed (sorted numbers) of documents that lose some."""
    spark = docs.sparkSession
    lines = stash(line_table(docs, id, text))
    at = F.struct("doc", "h", "line")
    with scratch(spark):
        with scratch(spark):
            shared = stash(_thinned(lines, stash(_shared(lines))), keep=True)
        texts = stash(_texts(docs.select(F.col(text).alias("text")), shared))
        component = bucket_components(shared, _verifier(texts), _sets(texts), SHARE)
        # a line that comes once and has no links is not looked at again
        often = lines.groupBy("node").agg(F.count("*").alias("often")).join(component, "node", "left").where("often > 1 or component is not null")
        placed = stash(lines.join(often.select("node", F.coalesce("component", "node").alias("component")), "node").select("component", at.alias("at")), keep=True)
    keepers = placed.groupBy("component").agg(F.min("at").alias("keep"), F.max("at").alias("last")).where("keep != last").select("component", "keep")
    gone = placed.join(keepers, "component").where("at != keep")
    lost = gone.groupBy("at.doc", "at.h").agg(F.array_sort(F.collect_set("at.line")).alias("removed"))
    return lines, lost


def line_dedup_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_lines (with ink), n_removed and removed_lines (numbers from 0, by newlines)."""
    lines, lost = removed_lines(docs, id, text)
    counts = lines.where("n_lines is not null").groupBy("doc", "h").agg(F.first("n_lines").alias("n_lines"))
    lost = lost.select(F.col("doc").alias("d"), F.col("h").alias("g"), "removed")
    found = counts.join(lost, F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select(F.col("doc").alias(id), "n_lines", F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed_lines"))
    have = counts.select(F.col("doc").alias("d"))
    bare = docs.select(id).distinct().join(have, F.col(id).eqNullSafe(F.col("d")), "left_anti")
    found = found.unionByName(bare.select(id, F.lit(0).cast("long").alias("n_lines"), F.expr("cast(array() as array<int>)").alias("removed_lines")))
    return found.select(id, "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``; documents left without ink are dropped if they lost lines."""
    with scratch(docs.sparkSession):
        lost = stash(removed_lines(docs, id, text)[1], keep=True)
    columns, schema = docs.columns, docs.schema
    hidden, other = own_columns(docs, "removed", "other_id").values()
    hidden = [hidden]
    # the join is by id; h tells the texts of a repeated id apart
    lost = lost.groupBy(F.col("doc").alias(other)).agg(F.map_from_entries(F.collect_list(F.struct("h", "removed"))).alias(hidden[0]))
    both = docs.join(lost, F.col(id).eqNullSafe(F.col(other)), "left").select(*columns, *hidden)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, text):
            data, offsets = _text.utf8(batch.column(text))
            whole = _text.Hasher(data)(offsets[:-1], offsets[1:]).view(_I64)
            column, out, keep = batch.column(text), [], []
            for k, removed in enumerate(batch.column(hidden[0])):
                gone = dict(removed.as_py() or []).get(int(whole[k])) if removed.is_valid else None
                value = column[k].as_py()
                if gone:
                    gone = set(gone)
                    value = "\n".join(x for n, x in enumerate(value.split("\n")) if n not in gone)
                out.append(value)
                keep.append(not gone or bool(value.strip(" \t\r\n\v\f")))
            kept = [pa.array(out, c.type) if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in hidden]
            yield pa.RecordBatch.from_arrays(kept, columns).filter(pa.array(keep))

    return both.mapInArrow(cut, schema)
