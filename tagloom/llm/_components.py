"""Connected components over DataFrames: of given links, and of links hidden in buckets of candidates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._tables import stash

_I64 = np.int64


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a over b) has one edge up at most, to a node without any: then all is settled."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``links`` (columns a, b).

    Large-star and small-star steps alternate until only stars are left, in some log of the
    diameter rounds. Each step is an aggregation and a join; no neighbourhood is gathered.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        edges = stash(edges)
        if _stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = small.distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _pairs(left: str = "a", right: str = "b"):
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def bucket_components(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], share: int = 75, small: int = 24) -> DataFrame:
    """Components of the graph whose links are those pairs sharing a bucket that ``verify`` keeps.

    ``shared`` has distinct rows bucket and node, of buckets with several nodes; ``verify`` takes pairs (a, b) and
    returns the linked ones; ``sets`` gives the distinct items of each node of a table, as (node, item) or as arrays (node, items), and a
    link needs at least ``share`` % of the union of two sets in common.

    1. Every node meets its bucket's head, the node that meets most others in its buckets: of a group of near copies that is
       the text they come from, or one close to it, and nearly all the group gets into one component by a pair a member.
    2. Buckets in one component are done. In the others no pair within a component is needed, and none between
       components is left out: in buckets of up to ``small`` nodes all such pairs meet.
    3. Nodes of larger buckets fall in groups, those that heads tie together; nodes of a group meet where they share items that
       are rare in it, see ``rare_pairs``.
    """
    size = shared.groupBy("bucket").agg(F.count("*").alias("size"))
    weight = shared.join(size, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))
    # how many others it meets, then a hash, in one number
    rank = F.shiftleft(F.least("weight", F.lit((1 << 33) - 1)), 30).bitwiseOR(F.xxhash64("node").bitwiseAND(F.lit((1 << 30) - 1)))
    head = shared.join(weight, "node").groupBy("bucket").agg(F.max_by("node", rank).alias("head"))
    ranked = stash(shared.join(head, "bucket"))
    star = ranked.where("node != head").select(*_pairs("node", "head")).distinct()
    component = connected(stash(verify(star)))

    now = ranked.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("bucket", "size")
    still = stash(now.join(split, "bucket"))
    few = still.where((F.col("size") <= small) & (F.col("node") != F.col("head"))).select("bucket", "node", "component")
    other = few.select("bucket", F.col("node").alias("to"), F.col("component").alias("of"))
    met = few.join(other, "bucket").where("node < to and component != of").select(*_pairs("node", "to"))
    large = stash(still.where(F.col("size") > small).select("node", "head", "component").distinct())
    group = connected(large.select(F.col("node").alias("a"), F.col("head").alias("b"))).select("node", F.col("component").alias("group"))
    more = stash(verify(met.unionByName(rare_pairs(large.select("node", "component").distinct().join(group, "node"), sets, share)).distinct()))
    if more.isEmpty():
        return component
    return connected(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")))


#: Items of a set, before one at which it meets others, that are looked at to see whether they have met.
RECENT = 4
#: Items that a task packs together, and that a range of keys gets on average.
PIECE, RANGE = 1 << 20, 1 << 18
#: Pairs that a task holds at once.
PAIRS = 1 << 20


def _cut(ranges: np.ndarray) -> list[tuple[int, int, int]]:
    """Range, start and end of each run of equal numbers."""
    edges = np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(ranges)).tolist()
    return [(int(ranges[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _in_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(_I64)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """The rows of each number in the first column, which come one after another."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows


def _of(binary: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(binary, kind)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, group, component, items) packed by some ``PIECE`` items; a key tells an item of a group."""
    parts, held = [], 0

    def packed() -> pa.RecordBatch:
        nodes, groups, components, n, items = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys = _text.mix(items.view(np.uint64) ^ np.repeat(_text.mix(groups.view(np.uint64) + np.uint64(3)), n))
        return _batch([(uuid.uuid4().int >> 65, len(keys), *(x.tobytes() for x in (nodes, components, n, keys)))], [pa.int64(), pa.int64(), *[pa.binary()] * 4], ["piece", "size", "nodes", "components", "n", "keys"])

    for whole in batches:
        ends = np.cumsum(whole.column(3).value_lengths().to_numpy(zero_copy_only=False), dtype=_I64)
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            batch, at = whole.slice(at, to - at), to
            parts.append((*(batch.column(k).to_numpy() for k in range(3)), batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(_I64), batch.column(3).flatten().to_numpy()))
            held += len(parts[-1][-1])
            if held >= PIECE:
                yield packed()
                parts, held = [], 0
    if parts:
        yield packed()


def rare_pairs(groups: DataFrame, sets: Callable[[DataFrame], DataFrame], share: int) -> DataFrame:
    """Pairs (a, b) of nodes of one group and different components (``groups``: group, node, component): all those whose sets have ``share`` % of their union in common, and few others.

    Items are ordered from the rarest in the group on. Two such sets share one of the first few items of each:
    what stands before, in the smaller and in the larger set, would leave too few in common. So a passage that very many
    nodes hold brings none of them together unless it makes up most of two sets; where the first common item stands
    bounds what two sets can have in common, and drops the rest. A pair that has met at one of the ``RECENT`` items before does not come again.

    Sets travel packed, in pieces of many: a piece sends its keys to their ranges, gets back how often those that others have too
    come in all, and sends the first ones of each set to the ranges, where they meet.
    """
    groups, found = stash(groups), sets(groups.select("node"))
    if "item" in found.columns:
        found = found.groupBy("node").agg(F.collect_list("item").alias("items"))
    whole = stash(found.join(groups, "node").select("node", "group", "component", "items").mapInArrow(_pieces, "piece long, size long, nodes binary, components binary, n binary, keys binary"))
    ranges = max(1, (whole.agg(F.sum("size")).first()[0] or 0) // RANGE)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, often = np.unique(_of(keys), return_counts=True)
                rows = [(k, piece, keys[a:b].tobytes(), often[a:b].astype(_I64).tobytes()) for k, a, b in _cut(_in_range(keys, ranges))]
                if rows:
                    yield _batch(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["range", "piece", "keys", "often"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            keys, which = np.unique(np.concatenate([_of(x[1]) for x in rows]), return_inverse=True)
            often = np.bincount(which, np.concatenate([_of(x[2], _I64) for x in rows]), len(keys)).astype(_I64)
            at = 0
            for piece, own, _ in rows:
                here = which[at : at + len(own) // 8]
                at += len(here)
                here = here[often[here] > 1]
                if len(here):
                    yield _batch([(piece, 0, keys[here].tobytes(), often[here].tobytes(), None, None)], kinds, names)

    kinds, names = [pa.int64(), pa.int32(), *[pa.binary()] * 4], ["piece", "kind", "one", "two", "three", "four"]
    told = whole.select("piece", "keys").mapInArrow(sent, "range int, piece long, keys binary, often binary").repartition("range").sortWithinPartitions("range")
    told = told.mapInArrow(counted, "piece long, kind int, one binary, two binary, three binary, four binary")
    least = lambda of, union: (of * share + union - 1) // union  # noqa: E731  smallest count of at least share % of union parts
    # with another of its size or more, a set shares 2 * share / (100 + share) of itself; with any other, share %
    near, far = (lambda n: n - least(2 * n, 100 + share) + 1), (lambda n: n - least(n, 100) + 1)

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            known, often = (np.concatenate([np.zeros(0, t), *(_of(x[k], t) for x in rows if not x[0])]) for k, t in ((1, np.uint64), (2, _I64)))
            order = np.argsort(known)
            known, often = known[order], often[order]
            for _, nodes, components, n, keys in (x for x in rows if x[0]):
                nodes, components, n, keys = _of(nodes, _I64), _of(components, _I64), _of(n, _I64), _of(keys)
                of = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                count = np.where(known[at] == keys, often[at], 1) if len(known) else np.ones(len(keys), _I64)
                order = np.lexsort((keys, count, of))
                keys, count = keys[order], count[order]
                at = np.arange(len(keys)) - (np.cumsum(n) - n)[of]
                some = np.flatnonzero((count > 1) & (at < far(n)[of]))
                keys, of, at = keys[some], of[some], at[some]
                before = np.zeros((len(some), RECENT), np.uint64)
                for k in range(RECENT):
                    before[k + 1 :, k] = np.where(of[k + 1 :] == of[: -k - 1], keys[: -k - 1], 0)
                into = _in_range(keys, ranges)
                order = np.argsort(into, kind="stable")
                into, columns = into[order], [x[order] for x in (keys, nodes[of], components[of], n[of], at, before)]
                rows = [(k, *(x[a:b].tobytes() for x in columns)) for k, a, b in _cut(into)]
                if rows:
                    yield _batch(rows, [pa.int32(), *[pa.binary()] * 6], ["range", "keys", "nodes", "components", "n", "at", "before"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            keys, nodes, components, n, at, before = (np.concatenate([_of(x[k], t) for x in rows]) for k, t in enumerate((np.uint64, _I64, _I64, _I64, _I64, np.uint64)))
            before = before.reshape(-1, RECENT)
            order = np.lexsort((nodes, n, keys))
            keys, nodes, components, n, at, before = (x[order] for x in (keys, nodes, components, n, at, before))
            # of each, those after it that are not too large; sets of a key and size are in one place
            place = (np.cumsum(np.diff(keys, prepend=keys[:1]) != 0) << 32) + n
            last = np.searchsorted(place, place - n + n * 100 // share, "right")
            count = np.where(at < near(n), last - np.arange(len(n)) - 1, 0)
            ends, low = np.cumsum(count), 0
            out = []
            while low < len(n):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
                i = np.repeat(np.arange(low, high), count[low:high])
                j = i + 1 + np.arange(len(i)) - (np.cumsum(count[low:high]) - count[low:high])[i - low]
                # so many items at most are in common, and so many are needed
                able = (components[i] != components[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) * (100 + share) >= (n[i] + n[j]) * share)
                i, j = i[able], j[able]
                new = np.ones(len(i), bool)
                for x in range(RECENT):
                    for y in range(RECENT):
                        new &= (before[i, x] != before[j, y]) | (before[i, x] == 0)
                i, j = nodes[i[new]], nodes[j[new]]
                out.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))
                low = high
                if sum(map(len, out)) > PAIRS or low >= len(n):
                    pairs = np.concatenate(out)
                    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
                    out = []
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    own = whole.select("piece", F.lit(1).alias("kind"), F.col("nodes").alias("one"), F.col("components").alias("two"), F.col("n").alias("three"), F.col("keys").alias("four"))
    both = told.unionByName(own).repartition("piece").sortWithinPartitions("piece", "kind")
    ahead = both.mapInArrow(fronts, "range int, keys binary, nodes binary, components binary, n binary, at binary, before binary")
    return ahead.repartition("range").sortWithinPartitions("range").mapInArrow(met, "a long, b long")
