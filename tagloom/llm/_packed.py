"""Which keys have several nodes: shuffles of (key, node) pairs as packed arrays, one row for thousands of pairs.

Keys fall in ranges of their hash. A task that packs pairs settles what it can by itself: where a key has
several nodes in what it holds, all are known to share it, and one alone goes to the key's range to meet
those of other tasks. The others travel by their own hash. So however many nodes a key has, its range gets
one from each piece of input, and no task has a hot key's nodes in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

SCHEMA = "range int, keys binary, nodes binary, known binary"
#: Pairs that a range gets on average, pairs that a task packs together, and pairs in a row.
RANGE, HELD, ROW = 1 << 17, 1 << 21, 1 << 15
#: Bits of a node's hash that tell where its counts are added up.
SUMS = 10
Pairs = tuple[np.ndarray, np.ndarray]


def ranges_for(pairs: int) -> int:
    return max(1, pairs // RANGE)


def _in_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((_text.mix(hashes) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _distinct(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) pairs in order, each with the greatest of its marks."""
    keys, nodes, known = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    some = np.flatnonzero(_several(keys[order]))  # most keys come once
    order[some] = order[some][np.lexsort((nodes[order[some]], keys[order[some]]))]
    keys, nodes, known = keys[order], nodes[order], known[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    first = np.flatnonzero(new)
    return keys[first], nodes[first], np.maximum.reduceat(known, first) if len(first) else known


def _several(keys: np.ndarray) -> np.ndarray:
    """Which of the sorted ``keys`` come more than once."""
    same = keys[1:] == keys[:-1]
    several = np.zeros(len(keys), bool)
    several[1:] |= same
    several[:-1] |= same
    return several


def pack(pairs: Iterator[Pairs], ranges: int) -> Iterator[pa.RecordBatch]:
    """The pairs (uint64 arrays) as rows of ``SCHEMA``; known: 0 sent to be compared, 2 the same but known to be shared, 1 just handed on."""

    def flush(parts: list) -> pa.RecordBatch:
        keys, nodes, _ = _distinct(parts)
        several = _several(keys)
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        known = np.where(several, np.where(first, 2, 1), 0).astype(np.uint8)
        at = np.where(known == 1, _in_range(nodes ^ np.uint64(0x5BD1E995), ranges), _in_range(keys, ranges))
        order = np.argsort(at, kind="stable")
        keys, nodes, known, at = keys[order], nodes[order], known[order], at[order]
        rows = []
        edges = np.append(np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1)), len(at))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for a in range(low, high, ROW):
                b = min(a + ROW, high)
                rows.append((int(at[a]), keys[a:b].tobytes(), nodes[a:b].tobytes(), known[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["range", "keys", "nodes", "known"])

    parts, held = [], 0
    for keys, nodes in pairs:
        if len(keys):
            parts.append((keys, nodes, np.zeros(len(keys), np.uint8)))
            held += len(keys)
        if held > HELD:
            yield flush(parts)
            parts, held = [], 0
    if held:
        yield flush(parts)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[Pairs]:
    """The pairs whose key has several nodes, from rows that come in order of range; a pair may come more than once."""
    now, parts, held, kept = None, [], 0, 0

    def told() -> Pairs:
        keys, nodes, known = _distinct(parts)
        group = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)
        some = _several(keys) | (np.bincount(group, known)[group] > 0)
        return keys[some], nodes[some]

    for batch in batches:
        for at, *binaries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys, nodes, known = (np.frombuffer(x, t) for x, t in zip(binaries, (np.uint64, np.uint64, np.uint8), strict=True))
            handed = known == 1
            if handed.any():
                yield keys[handed], nodes[handed]
                keys, nodes, known = keys[~handed], nodes[~handed], known[~handed]
            if at != now and parts:
                yield told()
                parts, held, kept = [], 0, 0
            now = at
            if len(keys):
                parts.append((keys, nodes, known))
                held += len(keys)
                if held > 2 * kept + (1 << 20):
                    parts = [_distinct(parts)]
                    held = kept = len(parts[0][0])
    if parts:
        yield told()


def _by_range(packed: DataFrame) -> DataFrame:
    return packed.repartition("range").sortWithinPartitions("range")


def shared_pairs(packed: DataFrame, key: str = "bucket", node: str = "node") -> DataFrame:
    """The distinct pairs of ``packed`` (by ``pack``) whose key has several nodes."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes in _met(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes.view(np.int64))], [key, node])

    return _by_range(packed).mapInArrow(listed, f"{key} long, {node} long").distinct()


def shared_counts(packed: DataFrame, node: str) -> DataFrame:
    """``node`` and k: of its keys, how many have other nodes too. A pair that several tasks pack may count for each: k is never too small.

    Counts go on packed as well, by ranges of the nodes.
    """

    def added(parts: list[Pairs]) -> Pairs:
        nodes, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, which = np.unique(nodes, return_inverse=True)
        return nodes, np.bincount(which, k, len(nodes)).astype(np.uint64)

    def sent(nodes: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        at = (_text.mix(nodes) >> np.uint64(64 - SUMS)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        nodes, k, at = nodes[order], k[order], at[order]
        edges = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at)).tolist()
        rows = [(int(at[a]), nodes[a:b].tobytes(), k[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "nodes", "k"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, kept = [], 0, 0
        for _, nodes in _met(batches):
            nodes, k = np.unique(nodes, return_counts=True)
            parts.append((nodes, k.astype(np.uint64)))
            held += len(nodes)
            if held > 2 * kept + HELD:
                parts = [added(parts)]
                held = kept = len(parts[0][0])
                if kept > 2 * HELD:
                    yield sent(*parts[0])
                    parts, held, kept = [], 0, 0
        if held:
            yield sent(*added(parts))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out() -> pa.RecordBatch:
            nodes, k = added(parts)
            return pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(k.astype(np.int64))], [node, "k"])

        for batch in batches:
            for at, *binaries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now and parts:
                    yield out()
                    parts = []
                now = at
                parts.append(tuple(np.frombuffer(x, np.uint64) for x in binaries))
        if parts:
            yield out()

    counts = _by_range(packed).mapInArrow(counted, "range int, nodes binary, k binary")
    return _by_range(counts).mapInArrow(summed, f"{node} long, k long")
