"""Benchmark decontamination with one Aho-Corasick automaton over the items' windows of words.

Texts are normalised byte for byte (ASCII letters lower-cased, every other ASCII character that is
not a digit or letter made a space), so words are found by splitting. A window is ``window``
consecutive words of an item; an item of fewer words is one window. The automaton holds each distinct
window once, between spaces, and reads each document once. Documents are only scanned, never moved.

Null and empty texts have no words and are never contaminated; items without words are ignored; an
empty benchmark marks nothing; documents may repeat and carry any other columns, which are kept. Very long
texts are scanned in one piece, in memory of some times their size; very long items only add windows.

An automaton's memory goes with the characters of its windows, which are counted first: those of more than ``most_chars``
fall by hash into parts of about so many, one automaton each, and documents are read once for each part.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import own_columns, stash

WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


def item_windows(items: list[tuple], window: int) -> Iterator[tuple[str, int, object]]:
    """Each window of each item as it stands between spaces, its number of words, and the item."""
    for item, text in items:
        words = normalised(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            part = words[k : k + window]
            yield f" {b' '.join(part).decode('latin-1')} ", len(part), item


def window_table(benchmark: DataFrame, window: int, item: str, text: str) -> DataFrame:
    """Distinct windows (in the encoding that the automaton reads), their numbers of words and the items that have them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                rows = list(item_windows([(batch.column(0)[one].as_py(), batch.column(1)[one].as_py())], window))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], ["window", "n", "item"])

    found = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").mapInArrow(cut, "window string, n int, item string")
    return found.groupBy("window", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))


_built: dict[str, ahocorasick.Automaton] = {}


def automaton_of(windows: list[tuple[str, int, list]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for text, n, items in windows:
        automaton.add_word(text, (n, items))
    automaton.make_automaton()
    return automaton


def _kept(key: str, sent: Broadcast) -> ahocorasick.Automaton:
    """The worker's automaton, built once for all its tasks."""
    if key not in _built:
        _built.clear()
        _built[key] = automaton_of(sent.value)
    return _built[key]


def scan(automaton: ahocorasick.Automaton, text: str | None) -> tuple[int, np.ndarray, list]:
    """Number of words, the indexes of those inside a window, and the items whose windows occur."""
    words = normalised(text)
    if not words or not len(automaton):
        return len(words), np.zeros(0, np.int64), []
    line = f" {b' '.join(words).decode('latin-1')} "
    hits = list(automaton.iter(line))
    if not hits:
        return len(words), np.zeros(0, np.int64), []
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(gaps, [end for end, _ in hits])
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, ends - np.array([n for _, (n, _) in hits]), 1)
    np.add.at(edges, ends, -1)
    return len(words), np.flatnonzero(np.cumsum(edges[:-1]) > 0), sorted({i for _, (_, items) in hits for i in items})


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """The hit words as maximal spans of code points of the text as it came."""
    at = [m.span() for m in WORD.finditer(text)]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []
    return [{"start": at[r[0]][0], "end": at[r[-1]][1]} for r in runs]


#: Characters of windows in one automaton, which takes some 40 bytes for each that no other window begins with.
MOST_CHARS = 6 << 20


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text: str = "text", item: str = "item_id", item_text: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """``docs`` with struct ``contamination``: n_words, n_hit, items (ids as strings, sorted), spans, contaminated.

    A document is contaminated when some words are hit and ``share`` times those are at least all its words.
    """
    windows = stash(window_table(benchmark, window, item, item_text))
    parts = max(1, -(-(windows.agg(F.sum(F.length("window"))).first()[0] or 0) // most_chars))
    names = own_columns(docs, "contamination", "hit_words", "hit_items")
    columns, out = docs.schema, docs
    for k in range(parts):
        # a part's size is bounded, whatever the benchmark's
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k).collect()
        out = _scanned(out, columns, names, [tuple(r) for r in part], text, share, k > 0, k == parts - 1)
        if k < parts - 1:
            out = stash(out)
    return out


def _scanned(docs: DataFrame, columns: T.StructType, names: dict[str, str], windows: list[tuple], text: str, share: int, more: bool, last: bool) -> DataFrame:
    """One part's scan: adds to the hits of the parts before, if there are ``more``, and after the ``last`` says what they come to."""
    sent, key = docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex
    told = T.StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, contaminated boolean")
    hits = [T.StructField(names["hit_words"], T.ArrayType(T.IntegerType())), T.StructField(names["hit_items"], T.ArrayType(T.StringType()))]
    schema = T.StructType([*columns.fields, *([T.StructField(names["contamination"], told)] if last else hits)])
    width = len(columns.fields)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _kept(key, sent)
        arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("contaminated", pa.bool_())])
        for batch in batches:
            out, words, found = [], [], []
            for row, value in enumerate(batch.column(columns.fieldNames().index(text))):
                value = value.as_py()
                n, hit, items = scan(automaton, value)
                if more and batch.column(width)[row].as_py():
                    hit = np.union1d(hit, np.array(batch.column(width)[row].as_py(), np.int64))
                    items = sorted({*items, *batch.column(width + 1)[row].as_py()})
                if last:
                    out.append({"n_words": n, "n_hit": len(hit), "items": items, "spans": original_spans(value, hit) if len(hit) else [], "contaminated": 0 < len(hit) and share * len(hit) >= n})
                else:
                    words.append(hit.tolist())
                    found.append(items)
            added = [pa.array(out, arrow)] if last else [pa.array(words, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], schema.fieldNames())

    return docs.mapInArrow(scanned, schema)
