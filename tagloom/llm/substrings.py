"""Substring deduplication with suffix automata of reference shards.

A word goes when a window of ``WINDOW`` words over it also starts in a document with a smaller id.
Every window is named by its anchor, the smallest hash among its ``GRAM``-word parts, so equal windows
have equal anchors.

1. Anchors that occur in one row only are dropped: their windows are unique. Anchors of very many rows are split
   by their windows' next smallest hash.
2. Where shared anchors lie, documents are cut into passages (windows in a row with one anchor). Equal
   passages become one with the smallest document id that has it: the reference. It is
   dealt by anchor into shards of bounded size, so all places of a window meet in one shard.
3. Each shard's reference becomes one suffix automaton over words, whose states carry the smallest
   document of their occurrences; the shard's passages are streamed through it for matching
   statistics, and every window reads its smallest document.
4. The answers go back to the places, and maximal spans are removed.

Automata go to the passages of their shard and not to all documents: a broadcast of the whole corpus'
automata would grow with the corpus. Null and empty texts have no words and lose none; rows that
repeat an id never remove each other's words; rows without an id lose none and remove none. Very long texts are cut like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _packed, _text
from ._tables import stash

WINDOW, GRAM = 13, 5
#: Words of reference in one automaton, unless a single anchor has more.
SHARD_WORDS = 40_000
#: Rows with an anchor above which it is split.
HOT = 512
_I64 = np.int64


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words (start, end, row), and for each window its first word, its anchor and its second anchor, the next smallest hash of its parts."""
    starts, ends, rows = _text.spans(data, offsets, _text.PLAIN)
    hashes = _text.Hasher(data)(starts, ends)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return starts, ends, rows, np.zeros(0, _I64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    gram = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        gram = _text.mix(gram * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(gram)])
    least, second = gram[:n].copy(), np.full(n, np.iinfo(np.uint64).max)
    for k in range(1, WINDOW - GRAM + 1):
        other = gram[k : k + n]
        np.minimum(second, np.where(other == least, second, np.maximum(least, other)), out=second)
        np.minimum(least, other, out=least)
    first = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :])
    return starts, ends, rows, first, least[first], second[first]


def shared_anchors(source: DataFrame) -> DataFrame:
    """anchor and node of the rows of ``source`` (text, node) whose anchors another node has too."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = _packed.ranges_for(size // 32)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[_packed.Pairs]:
        for batch in _text.slices(batches, "text"):
            _, _, rows, first, anchor, _ = anchored(*_text.utf8(batch.column(0)))
            yield anchor, batch.column(1).to_numpy().view(np.uint64)[rows[first]]

    return _packed.shared_pairs(source.select("text", "node").mapInArrow(lambda batches: _packed.pack(pairs(batches), ranges), _packed.SCHEMA), "anchor")


def passages(docs: DataFrame) -> DataFrame:
    """anchor, doc, h, first word and text of each passage; ``docs`` has doc, text and its shared ``anchors`` and ``hot`` ones, which are split by their windows' second anchors."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), docs.schema["doc"], *T.StructType.fromDDL("h long, first int, passage string").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "text"):
            data, offsets = _text.utf8(batch.column("text"))
            starts, ends, rows, first, anchor, second = anchored(data, offsets)
            salt, of = _text.mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1)), rows[first]

            def among(name: str) -> np.ndarray:
                """Which windows have an anchor that their row lists in column ``name``."""
                wanted = batch.column(name)  # noqa: B023
                per = np.array([len(x) if x.is_valid else 0 for x in wanted])
                return np.isin(_text.mix(anchor + salt[of]), _text.mix(wanted.flatten().to_numpy().view(np.uint64) + np.repeat(salt, per)))  # noqa: B023

            anchor = np.where(among("hot"), _text.mix(anchor ^ _text.mix(second)), np.where(among("anchors"), anchor, np.uint64(0)))
            shared = np.flatnonzero(anchor)
            first, anchor, of = first[shared], anchor[shared], of[shared]
            if not len(first):
                continue
            new = np.ones(len(first), bool)
            new[1:] = (first[1:] != first[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(first)) - 1
            zero = np.searchsorted(rows, np.arange(batch.num_rows))
            a, b, row = first[begin], first[last] + WINDOW - 1, of[begin]
            whole = _text.Hasher(data)(offsets[:-1], offsets[1:]).view(_I64)
            # words joined by one space: passages that differ in white space only are equal
            sizes = b - a + 1
            word = np.repeat(a - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            chars = ends[word] - starts[word] + 1
            packed, _ = _text.gather(np.append(data, np.uint8(32)), starts[word], ends[word] + 1)
            packed[np.cumsum(chars) - 1] = 32
            bounds = np.concatenate([[0], np.cumsum(chars)])[np.concatenate([[0], np.cumsum(sizes)])]
            text = _text.strings(packed, bounds[:-1], bounds[1:] - 1)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[begin].view(_I64)), batch.column("doc").take(pa.array(row)), pa.array(whole[row]), pa.array((a - zero[row]).astype(np.int32)), text], ["anchor", "doc", "h", "first", "passage"])

    return docs.mapInArrow(cut, schema)


class SuffixAutomaton:
    """Over words of several passages; states carry the smallest document of their occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.doc = [-1], [0], [None]

    def add(self, words: list[str], doc) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            if self.doc[last] is None or doc < self.doc[last]:
                self.doc[last] = doc

    def _extend(self, last: int, word: str) -> int:
        nexts, link, length = self.next, self.link, self.length
        if word in nexts[last]:  # the prefix is known from another passage
            q = nexts[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, q, word)
        state = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
        return state

    def _state(self, nexts: dict, link: int, length: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(None)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, word: str) -> int:
        nexts, link = self.next, self.link
        clone = self._state(dict(nexts[q]), link[q], self.length[p] + 1)
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def settle(self) -> None:
        """Hands documents up the suffix links, longest states first."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, doc = self.link[state], self.doc[state]
            if up > 0 and doc is not None and (self.doc[up] is None or doc < self.doc[up]):
                self.doc[up] = doc

    def firsts(self, words: list[str], window: int) -> list:
        """The smallest document of each window of ``words``, None where the reference lacks it."""
        state, matched, out = 0, 0, []
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = min(matched, self.length[state])
            if k >= window - 1:
                out.append(self.doc[state] if matched >= window else None)
        return out


def first_documents(reference: DataFrame) -> DataFrame:
    """The ``firsts`` of each reference passage (columns anchor, passage, doc), by the automaton of its shard."""
    kind = reference.schema["doc"].dataType
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("key", T.LongType()), T.StructField("check", T.LongType()), T.StructField("firsts", T.ArrayType(kind))])

    def answered(shard: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        for _, _, _, words, doc in shard:
            automaton.add(words, doc)
        automaton.settle()
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in shard], pa.int64()) for k in range(3)), pa.array([automaton.firsts(r[3], WINDOW) for r in shard], arrow.field("firsts").type)], schema=arrow)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, now, arrow = [], 0, None, None
        for batch in batches:
            arrow = arrow or pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("firsts", pa.list_(batch.schema.field("doc").type))])
            for anchor, passage, doc, key, check in zip(*(batch.column(c).to_pylist() for c in ("anchor", "passage", "doc", "key", "check")), strict=True):
                if anchor != now and held > SHARD_WORDS:
                    yield answered(shard, arrow)
                    shard, held = [], 0
                now = anchor
                words = passage.split(" ")
                shard.append((anchor, key, check, words, doc))
                held += len(words)
        if shard:
            yield answered(shard, arrow)

    keyed = reference.select("anchor", "passage", "doc", *_keys())
    return keyed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(streamed, schema)


def _keys() -> list:
    return [F.xxhash64("passage").alias("key"), F.xxhash64(F.lit(1), "passage").alias("check")]


def removed_ranges(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, h and ranges: first words of windows to remove, for rows that lose some."""
    source = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("doc"), F.col(text).alias("text"), F.xxhash64(id, text).alias("node"))
    shared = stash(shared_anchors(source))
    often = shared.groupBy("anchor").agg((F.count("*") > HOT).alias("much"))
    of = lambda much: F.collect_list(F.when(F.col("much") == much, F.col("anchor")))
    wanted = shared.join(often, "anchor").groupBy("node").agg(of(False).alias("anchors"), of(True).alias("hot"))
    places = stash(passages(source.join(wanted, "node").select("doc", "text", "anchors", "hot")))
    reference = places.groupBy("anchor", "passage").agg(F.min("doc").alias("doc"))
    answers = first_documents(reference)
    found = places.select("anchor", "doc", "h", "first", *_keys()).join(answers, ["anchor", "key", "check"])
    late = F.filter(F.transform("firsts", lambda d, k: F.when(d < F.col("doc"), F.col("first") + k)), lambda k: k.isNotNull())
    return found.select("doc", "h", late.alias("late")).where(F.size("late") > 0).groupBy("doc", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("late")))).alias("late"))


def _kept_words(text: str | None, late: list[int] | None) -> tuple[list[str], np.ndarray]:
    words = [w for w in (text or "").translate(_BLANKS).split(" ") if w]
    edges = np.zeros(len(words) + 1, np.int64)
    if late:
        at = np.array(late)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + WINDOW, -1)
    return words, np.cumsum(edges[:-1]) == 0


_BLANKS = {c: " " for c in range(9, 14)}


def remove_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept (the kept words joined by spaces) of every row of ``docs``."""
    ranges = stash(removed_ranges(docs, id, text))
    late = ranges.groupBy(F.col("doc").alias(id)).agg(F.map_from_entries(F.collect_list(F.struct("h", "late"))).alias("late"))
    schema = T.StructType([docs.schema[id], *T.StructType.fromDDL("n_words long, n_removed long, kept string").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, text):
            data, offsets = _text.utf8(batch.column(1))
            whole = _text.Hasher(data)(offsets[:-1], offsets[1:]).view(_I64)
            out = []
            for k, value in enumerate(batch.column(1)):
                at = batch.column(2)[k]
                words, keep = _kept_words(value.as_py(), dict(at.as_py()).get(int(whole[k])) if at.is_valid else None)
                out.append((len(words), len(words) - int(keep.sum()), " ".join(w for w, x in zip(words, keep, strict=True) if x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], schema.fieldNames())

    return docs.select(id, text).join(late, id, "left").mapInArrow(cut, schema)


def substring_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    return remove_substrings(docs, id, text).select(id, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
