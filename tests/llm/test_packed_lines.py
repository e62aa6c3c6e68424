"""What is sent and fetched of lines and of sets in large buckets."""

import os

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import _components, _text, jaccard, lines
from tagloom.session import shared_folder

from . import brute


def _sets(rng, n, drop):
    x = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
    return x, np.unique(np.concatenate([x[drop:], rng.integers(1, 1 << 62, drop).astype(np.uint64)]))


def test_outlines_differ_in_no_more_than_their_sets():
    rng = np.random.default_rng(1)
    pairs = [_sets(rng, n, n // part) for n in (1, 9, 31, 33, 200, 900) for part in (1, 2, 7, 20) if n // part < n] + [(_sets(rng, 20, 0)[0], _sets(rng, 300, 0)[0])]
    told = [[lines.outlines(np.zeros(len(x), np.int64), x, 1)[1][0] for x in side] for side in zip(*pairs, strict=True)]
    least = lines.apart(*(pa.array(x, pa.binary()) for x in told))
    assert (least <= [len(np.setxor1d(a, b)) for a, b in pairs]).all()
    apart = [k for k, (a, b) in enumerate(pairs) if not len(np.intersect1d(a, b)) and len(a) > 100]
    assert all(8 * least[k] > len(pairs[k][0]) + len(pairs[k][1]) + least[k] for k in apart)


def test_texts_are_fetched_only_of_lines_that_others_share(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "\n".join(f"{k} {x} line of its own" for x in range(200))) for k in range(5)], "doc_id long, text string")
    data, offsets = _text.utf8(pa.array(["3 7 line of its own"]))
    node = int(_text.Hasher(data)(offsets[:-1], offsets[1:]).view(np.int64)[0])
    shared = spark.createDataFrame([(1, node), (2, node)], "bucket long, node long")
    assert int(np.unpackbits(lines._filter(shared.select("node"))).sum()) == 1
    assert [tuple(r) for r in lines._texts(docs.select("text"), shared).select("node", "line", "n").collect()] == [(node, "3 7 line of its own", 12)]


def test_rare_items_in_many_pieces(spark, monkeypatch):
    """All links of a group whose sets are spread over many pieces and ranges, and few other pairs."""
    monkeypatch.setattr(_components, "PIECE", 300)
    monkeypatch.setattr(_components, "RANGE", 40)
    rng = np.random.default_rng(4)
    sets = {}
    for k in range(0, 80, 2):
        own = {int(x) for x in rng.integers(1 << 40, 1 << 60, 40)}
        sets[k], sets[k + 1] = set(range(60)) | own, set(range(k % 9, 60)) | own
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "node long, items array<long>")
    groups = spark.createDataFrame([(k % 4 // 2, k, k) for k in sets], "group long, node long, component long")
    found = [tuple(r) for r in _components.rare_pairs(groups, lambda nodes: rows.join(nodes, "node", "left_semi"), 75).collect()]
    linked = {(a, b) for a in sets for b in sets if a < b and a % 4 // 2 == b % 4 // 2 and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert len(linked) >= 40 and linked <= set(found) and len(found) < 3 * len(linked)


def test_hashes_of_shingles():
    texts = ["plain words, plain words", "é", "naïve façade déjà vu\nou là", "日本語日本語日本語 abc", "short", "", "12345678", "x1234567é"]
    for some in (texts, texts[:1], ["12345678"]):
        data, offsets = _text.utf8(pa.array(some))
        starts, ends, _, _ = lines.line_spans(data, offsets)
        hasher = _text.Hasher(data)
        of, found = lines.char_shingles(data, starts, ends, hasher)
        assert (hasher.eights(max(0, len(data) - 7)) == hasher(np.arange(max(0, len(data) - 7)), np.arange(8, max(8, len(data) + 1)))).all()
        want = []
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            line = bytes(data[a:b]).decode()
            for x in range(max(1, len(line) - lines.SHINGLE + 1)):
                one, ends_ = _text.utf8(pa.array([line[x : x + lines.SHINGLE]]))
                want.append((k, int(_text.Hasher(one)(ends_[:-1], ends_[1:])[0])))
        assert list(zip(of.tolist(), found.tolist(), strict=True)) == want


def test_spans_of_lines():
    texts = ["  a \n\t\n b\n\n", "", "\n", "x\n", "\v\fa b\r\n é \nz", None, "a\n b"]
    data, offsets = _text.utf8(pa.array(texts))
    starts, ends, rows, number = lines.line_spans(data, offsets)
    found = [(r, k, bytes(data[a:b]).decode()) for a, b, r, k in zip(starts.tolist(), ends.tolist(), rows.tolist(), number.tolist(), strict=True)]
    assert found == [(r, k, x.strip(" \t\r\n\v\f")) for r, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\n\v\f")]


def _phrased(n, near):
    """Documents of a line each: all have a phrase, and ``near`` of them nearly a whole line, in common with another."""
    rng = np.random.default_rng(7)
    word = lambda k: "".join(chr(97 + x) for x in rng.integers(0, 26, k))
    texts = [f"{word(22)} few words of all {word(22)}" for _ in range(n)]
    return dict(enumerate(texts + [x[:-1] for x in texts[:near]]))


@pytest.mark.parametrize(("many", "most"), [(4096, 70), (5, 921)])
def test_lines_that_meet_by_chance_are_not_fetched(spark, monkeypatch, many, most):
    texts, fetched, real = _phrased(900, 20), [], lines._texts
    monkeypatch.setattr(lines, "MANY", many, raising=False)
    monkeypatch.setattr(lines, "_texts", lambda docs, shared: fetched.append(shared.select("node").distinct().count()) or real(docs, shared))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: set(r["removed_lines"]) for r in lines.line_dedup_digest(docs).collect()} == brute.lines(texts)
    assert 40 <= fetched[0] < most


def test_tables_in_between_go(spark):
    docs = spark.createDataFrame(list(_phrased(50, 5).items()), "doc_id long, text string")
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = lines.dedup_lines(docs)
    assert len(set(os.listdir(folder)) - before) == 1
    assert found.count() == 50


def test_tables_in_between_go_of_documents(spark):
    words = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, words), (2, f"{words} more"), (3, "others altogether " * 9)], "doc_id long, text string")
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = jaccard.jaccard_components(docs)
    assert len(set(os.listdir(folder)) - before) == 2  # keys and components
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3}


def test_near_copies_agree():
    rng = np.random.default_rng(5)
    for n in (4, 5, 8, 13, 40, 200, 900):
        common = rng.integers(1, 1 << 62, (200, n)).astype(np.uint64)
        sides = []
        for _ in range(2):  # 100 * n >= 75 * (n + 2 * own)
            found = np.concatenate([common, rng.integers(1, 1 << 62, (200, n // 6)).astype(np.uint64)], axis=1)
            sides.append(lines.minhashes(np.repeat(np.arange(200), found.shape[1]), found.ravel()).T)
        told = lines.agreeing(*(lines.sketches(x) for x in sides))
        assert (told >= (sides[0] == sides[1]).sum(axis=1)).all() and told.min() >= lines.AGREE
        assert (lines.agreeing(lines.sketches(sides[0]), lines.sketches(np.roll(sides[1], 1, axis=0))) < lines.AGREE).mean() > 0.99


def test_buckets_are_compared_whole():
    told = np.random.default_rng(6).integers(0, 1 << 62, (400, lines.WORDS)).astype(np.uint64)
    told[7], told[390], told[120] = told[3], told[200], told[50]
    edges = np.array([100, 110, 200, 400])
    assert np.flatnonzero(lines.near_some(edges, told)).tolist() == [3, 7, 200, 390]
