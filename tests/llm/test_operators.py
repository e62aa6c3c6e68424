"""The operators of the corpus subpackage against plain versions, on odd and on given texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import _text, cotraining, decontaminate, jaccard, likelihood, lines, media, pii, sentencepiece_codec, substrings, toxicity
from tagloom.llm._components import bucket_components, connected
from tagloom.llm._pieces import Vocabulary, best

from . import brute

BASE = " ".join(f"w{k % 37}x{k % 11}" for k in range(60))
ODD = {
    1: BASE, 2: BASE, 3: BASE + " tail one", 4: None, 5: "", 6: "  \n\t ", 7: "a b", 8: "a b", 9: "A B", 10: BASE.upper(), 11: "one two three four", 12: BASE + "\n" + BASE,
    13: "x" * 30000, 14: "y " * 20000, 15: "é ü 日本 " * 40, 16: "line one is long enough\nline one is long enough\nline one is long enougg\n\nshort", 17: BASE.replace("w3x3", "zz"), 18: "日本語" * 50,
}


@pytest.fixture(scope="module")
def odd(spark):
    # an extra column whose name clashes with the operators' own
    rows = [(k, v, "n", 1.0, "q") for k, v in ODD.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, toxicity double, ids string").repartition(3)


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.fixture(params=["odd", "given", "empty"], scope="module")
def docs(request):
    return request.getfixturevalue(request.param)


def test_hashes_of_patterns():
    """Words in a pattern that cancels out of polynomial hashes, and their complements; ranges of all lengths."""
    ab = np.array([bin(k).count("1") % 2 for k in range(1024)], np.uint8)
    data = np.concatenate([ab + 97, 98 - ab])
    for n in (16, 64, 256, 1024):
        h = _text.Hasher(data)(np.array([0, 1024]), np.array([n, 1024 + n]))
        assert h[0] != h[1]
    same = np.concatenate([data, data])
    ends = np.arange(1, 200)
    assert (_text.Hasher(same)(np.zeros(199, np.int64), ends) == _text.Hasher(same)(np.full(199, 2048), ends + 2048)).all()
    assert len(set(_text.Hasher(data)(np.zeros(199, np.int64), ends).tolist())) == 199


def test_words():
    data, offsets = _text.utf8(pa.array(["the cat  é", None, "", "on\nthe "]))
    starts, ends, rows = _text.spans(data, offsets, _text.PLAIN)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["the", "cat", "é", "on", "the"] and rows.tolist() == [0, 0, 0, 3, 3]
    h = _text.Hasher(data)(starts, ends)
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    assert sum(x.num_rows for x in _text.slices(iter([pa.record_batch([pa.array(["ab"] * 9)], ["t"])]), "t", 3)) == 9


def test_connected(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 6), (8, 7), (20, 10)] + [(k, k + 1) for k in range(100, 160)]
    found = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == brute.components({x for p in links for x in p}, links)


@pytest.mark.parametrize("size", [4, 60])
def test_buckets_with_an_unlinked_head(spark, size):
    """In a small and in a large bucket: pairs that are linked, and all others that share much but not enough."""
    rng = np.random.default_rng(size)
    sets = {}
    for k in range(0, size, 2):
        own = {int(x) for x in rng.integers(1 << 40, 1 << 60, 40)}
        sets[k], sets[k + 1] = set(range(60)) | own, set(range(57)) | own
    items = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "node long, item long")
    members = spark.createDataFrame([(3, k) for k in sets], "bucket long, node long")
    asked = []

    def verify(pairs):
        rows = [tuple(r) for r in pairs.collect()]
        asked.extend(rows)
        return spark.createDataFrame([(a, b) for a, b in rows if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], "a long, b long")

    found = {r["node"]: r["component"] for r in bucket_components(members, verify, lambda nodes: items.join(nodes, "node", "left_semi")).collect()}
    assert found == {k: k // 2 * 2 for k in sets}
    assert len(asked) < (3 * size if size > 24 else size * size)


def test_jaccard(docs):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert found == brute.jaccard(texts(docs))


def test_jaccard_group_of_near_copies(spark):
    """Copies that each differ from a base in some places: linked to one another by chains, not all to the first."""
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(120, 3, replace=False):
            words[at] = f"r{k}_{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()} == brute.jaccard(dict(rows))


def test_jaccard_of_three_in_four(spark):
    """Documents of 7 words that are one of 8 words less its first or last: 3 shingles of 4."""
    words = [f"s{k}" for k in range(8)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:7])), (3, " ".join(words[1:])), (4, " ".join(words[:6])), (5, "a b c d e f g"), (6, "b c d e f g"), (7, "c d e f g"), (8, "z a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert found == brute.jaccard(dict(rows)) and found[2] == found[3] == (3, 1)


def test_signatures_of_three_in_four():
    rng = np.random.default_rng(6)
    for _ in range(200):
        y = np.unique(rng.integers(1, 1 << 62, 4).astype(np.uint64))
        x = np.delete(y, rng.integers(0, 4))
        rows, keys = jaccard.signatures(np.array([0] * 3 + [1] * 4), np.concatenate([x, y]), 2)
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_signatures_miss_no_link():
    """Any two sets within the threshold share a signature."""
    rng = np.random.default_rng(5)
    for n in (4, 5, 8, 13, 40, 150):
        for _ in range(30):
            x = rng.integers(1, 1 << 62, n).astype(np.uint64)
            drop = rng.integers(0, max(1, n // 7 + 1))
            y = np.concatenate([x[drop:], rng.integers(1, 1 << 62, rng.integers(0, max(1, n // 8 + 1))).astype(np.uint64)])
            x, y = np.unique(x), np.unique(y)
            common = len(np.intersect1d(x, y))
            if 100 * common >= 75 * (len(x) + len(y) - common) and len(x) + len(y) > 2 * common:
                rows, keys = jaccard.signatures(np.concatenate([np.zeros(len(x), np.int64), np.ones(len(y), np.int64)]), np.concatenate([x, y]), 2)
                assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_lines(docs):
    found = {r["doc_id"]: set(r["removed_lines"]) for r in lines.line_dedup_digest(docs).collect()}
    assert found == brute.lines(texts(docs))


def test_lines_cut(odd):
    gone, have = brute.lines(ODD), {r["doc_id"]: r["text"] for r in lines.dedup_lines(odd).collect()}
    for k, text in ODD.items():
        left = "\n".join(x for n, x in enumerate((text or "").split("\n")) if n not in gone[k])
        assert have.get(k) == (text if not gone[k] else left if left.strip() else None)


def test_substrings(docs):
    found = {r["doc_id"]: tuple(r)[1:] for r in substrings.substring_digest(docs).collect()}
    assert found == brute.substrings(texts(docs))


def test_suffix_automaton():
    automaton = substrings.SuffixAutomaton()
    rng = np.random.default_rng(1)
    seqs = [[str(x) for x in rng.integers(0, 3, 30)] for _ in range(12)]
    for k, s in enumerate(seqs):
        automaton.add(s, 100 - k)
    automaton.settle()
    for s in [*seqs, ["0"] * 20, ["9", "0", "1"] * 5]:
        want = [min((100 - k for k, t in enumerate(seqs) for j in range(len(t) - 4) if t[j : j + 5] == s[i : i + 5]), default=None) for i in range(len(s) - 4)]
        assert automaton.firsts(s, 5) == want


def test_contamination(spark, docs):
    items = [(1, BASE), (2, "one TWO three"), (3, None), (4, ""), (5, "a b"), (6, BASE[:80])]
    known = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(docs, known).select("doc_id", "text", "contamination").collect()
    want = brute.contamination(texts(docs), items)
    for r in rows:
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], len(c["items"]), brute.sha(",".join(c["items"])), c["contaminated"]) == want[r["doc_id"]]
        assert sum(len(decontaminate.normalised(r["text"][s["start"] : s["end"]])) for s in c["spans"]) == c["n_hit"]
    assert decontaminate.decontaminate(docs, known.limit(0)).where("contamination.contaminated").count() == 0
    many = decontaminate.decontaminate(docs, known, most_chars=500).select("doc_id", "text", "contamination").collect()
    assert sorted(map(str, many)) == sorted(map(str, rows))


def test_pii(spark, docs):
    extra = {-3: "a@b.c_d@e.f and a..b@c.d..e x@y.z.. 1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.4 write to bob at host dot com, call (555) 123-4567 4111 1111 1111 1111. +1 (988) 555-2485. é +1 2 3", -4: "1 " * 9000 + "a." * 9000 + "a@" + "b." * 900 + "c 9" * 3000, -5: "4111-1111-1111-1111 x 4111111111111112"}
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in pii.pii_digest(both).collect()}
    for k, text in texts(both).items():
        want = brute.pii(text)
        assert rows[k]["base_sha256"] == brute.sha(want)
        assert set(filter(None, want.split(","))) <= set(rows[k]["spans"].split(","))
        assert [rows[k][f"n_{x}"] for x in pii.BASE_KINDS] == [want.count(f"{x}:") for x in pii.BASE_KINDS]
    assert "email:83:102" in rows[-3]["spans"]
    plan = pii.pii_digest(both)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_mask(spark):
    df = spark.createDataFrame([(1, "é me@x.org or 10.1.2.3!"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.mask_pii(df).orderBy("doc_id").collect()] == ["é [email] or [ip]!", ""]


def test_pii_mask_honours_the_threshold(spark):
    rows = [(k, f"write to bob{k} at host dot com, or to ann{k}@host.org") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["text"] for r in pii.mask_pii(df).collect()} == {"write to [email], or to [email]"}
    assert {r["text"] for r in pii.mask_pii(df, threshold=1.1).collect()} == {f"write to bob{k} at host dot com, or to [email]" for k in range(30)}


def test_pii_added_spans(spark):
    """Precision and recall of what the method adds to the base: of each kind some cases, and others that only look like them."""
    good, bad = [], []
    for k in range(40):
        digest = brute.sha(str(k))[:40]
        good += [(f'api config token = "{digest}" ok', f"secret:20:60"), (f"please mail eve{k} at site{k} dot org today", f"email:12:{len(f'please mail eve{k} at site{k} dot org')}"), (f"call me: (555) 2{k:02d}-4567 now", "phone:9:23")]
        bad += [f"see commit {digest} of the tree", f"order 4111 1111 1111 {1112 + 10 * k} shipped", f"we met at noon and part 10{k:02d}-22 dot it", f"the key: something{'x' * (k % 5)} else"]
    base = [(f"mail me{k}@x.org or +1 (988) 555-24{k:02d} or 10.0.0.{k}", None) for k in range(40)]
    texts_ = [t for t, _ in good] + bad + [t for t, _ in base]
    rows = {r["doc_id"]: r for r in pii.pii_digest(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).collect()}
    found = {(k, x) for k, r in rows.items() if k < len(good) + len(bad) for x in r["spans"].split(",") if x and x not in brute.pii(texts_[k]).split(",")}
    want = {(k, x) for k, (_, x) in enumerate(good)}
    assert len(found & want) >= 0.95 * len(want) and len(found & want) >= 0.95 * len(found)
    assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) for r in rows.values())


def test_reliabilities():
    """A labeler that agrees with the others is trusted over one that does not."""
    counts = [((1, 1, 1, 1, -1), 40.0), ((-1, -1, -1, -1, 1), 40.0), ((1, 1, 1, 1, 1), 40.0), ((-1, -1, -1, -1, -1), 40.0)]
    prior, table, posterior = pii.reliabilities(counts)
    assert 0.4 < prior < 0.6 and table[0][1, 1] > 0.9 > table[4][1, 1]
    assert posterior[0] > 0.9 and posterior[1] < 0.1


def vocabulary_score(v, text):
    """Best score by trying every piece at every place."""
    b = text.encode()
    pieces = {x: k for k, x in enumerate(v.bytes_of) if x and k not in set(v.byte_ids.tolist())}
    value = [0.0] + [-math.inf] * len(b)
    for i in range(len(b)):
        if value[i] == -math.inf:
            continue
        size = 1
        while i + size < len(b) and b[i + size] & 0xC0 == 0x80:
            size += 1
        if b[i] & 0xC0 == 0x80 or b[i : i + size] not in pieces:
            value[i + 1] = max(value[i + 1], value[i] + v.logp[v.byte_ids[b[i]]])
        if b[i] & 0xC0 != 0x80:
            for n in range(1, v.longest + 1):
                if i + n <= len(b) and b[i : i + n] in pieces:
                    value[i + n] = max(value[i + n], value[i] + v.logp[pieces[b[i : i + n]]])
    return value[-1]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary()


TEXTS = ["Hello world\n  x ▁ é 日本語 \U0001f600 the cat", "a", "   ", "\n\n tab\t", "abcdefg" * 40, "日本" * 40, BASE]


def test_encoding_is_best(vocabulary):
    data, offsets = sentencepiece_codec.spaced(*_text.utf8(pa.array(TEXTS)))
    pieces, counts = sentencepiece_codec.encode_ranges(vocabulary, data, offsets[:-1], offsets[1:])
    for text, ids in zip(TEXTS, np.split(pieces, np.cumsum(counts)[:-1]), strict=True):
        assert vocabulary.spell(ids).tobytes() == b" " + text.encode()
        assert vocabulary.logp[ids].sum() == pytest.approx(vocabulary_score(vocabulary, " " + text))


@pytest.mark.parametrize("size", [16, 37, 64])
def test_chunks_agree(vocabulary, size):
    for text in [*TEXTS[4:], TEXTS[0] * 9, "é" * 300 + " x"]:
        b = b" " + text.encode()
        cuts = range(0, len(b), size)
        states = sentencepiece_codec.boundaries(np.stack([sentencepiece_codec.transfer(vocabulary, b[a : a + size + vocabulary.longest - 1], min(size, len(b) - a)) for a in cuts]))
        ids = []
        for n, a in enumerate(cuts):
            d = np.frombuffer(b[a : a + size + vocabulary.longest - 1], np.uint8)
            ids += sentencepiece_codec.encode_ranges(vocabulary, d, np.array([states[n]]), np.array([min(size, len(b) - a) + states[n + 1]]))[0].tolist()
        assert vocabulary.spell(np.array(ids)).tobytes() == b
        assert vocabulary.logp[ids].sum() == pytest.approx(vocabulary_score(vocabulary, b.decode()))


def test_products_are_associative():
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(size=(3, 1, 5, 5))
    assert np.allclose(sentencepiece_codec.product(sentencepiece_codec.product(a, b), c), sentencepiece_codec.product(a, sentencepiece_codec.product(b, c)))


@pytest.mark.parametrize("chunk", [500, 1 << 15])
def test_codec_round_trip(docs, chunk):
    rows = sentencepiece_codec.codec_digest(docs, chunk=chunk).collect()
    want = texts(docs)
    assert len(rows) == len(want)
    for r in rows:
        assert r["exact"] and r["decoded_sha256"] == brute.sha(want[r["doc_id"]] or "") and (r["n_tokens"] == 0) == (not want[r["doc_id"]])


def test_codec_chunks_do_not_matter(odd):
    one, many, tree = ({r["doc_id"]: r["n_tokens"] for r in sentencepiece_codec.codec_digest(odd, chunk=c, fan=f).collect()} for c, f in ((1 << 20, 64), (300, 64), (300, 4)))
    assert one == many == tree


def test_encode_keeps_columns(odd):
    out = sentencepiece_codec.encode(odd)
    assert out.columns == [*odd.columns, "_ids"] and out.count() == len(ODD)


def test_lattice_adds_up_all_segmentations(vocabulary):
    word = " thanedble"
    data = np.frombuffer(word.encode(), np.uint8)
    lattice = vocabulary.lattice(data, np.array([0, len(data)]))
    total = likelihood.forward(lattice, vocabulary.logp)[-1]
    edges = list(zip(lattice.start.tolist(), lattice.end.tolist(), vocabulary.logp[lattice.piece], strict=True))

    def paths(at):
        return 1.0 if at == len(data) else sum(math.exp(w) * paths(b) for a, b, w in edges if a == at)

    assert total == pytest.approx(math.log(paths(0)))
    assert best(lattice, vocabulary.logp)[-1] <= total
    uses = likelihood.expected(lattice, vocabulary.logp, np.array([2.0]))
    sizes = np.array([len(x) for x in vocabulary.bytes_of])
    assert (uses * sizes).sum() == pytest.approx(2 * len(data))


def test_likelihood(docs):
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    rows = likelihood.score_likelihood(docs, training).collect()
    want = {k: brute.plain(brute.lower(v)) for k, v in texts(docs).items()}
    counts = Counter()
    for k, w in want.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(want)
    for r in rows:
        w = [*want[r["doc_id"]], None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_likelihood_of_documents(spark, vocabulary):
    """The score adds up, word by word, every way to spell it by pieces of the vocabulary."""
    rows = [(1, "the cat sat"), (2, "The\tCAT\n日本 thanedble"), (3, None), (4, "the cat sat"), (4, "the cat sat"), (None, "a cat"), (5, "x" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = likelihood.score_likelihood(df, F.col("doc_id") % 2 == 0, rounds=0).collect()
    assert [(r["doc_id"], r["held_out"]) for r in sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == [(1, True), (2, False), (3, True), (4, False), (4, False), (5, True), (None, True)]
    pieces = {x: vocabulary.logp[k] for k, x in enumerate(vocabulary.bytes_of) if x and k not in set(vocabulary.byte_ids.tolist())}
    ends, n = 3, sum(len(brute.plain(t)) for _, t in (rows[1], rows[3], rows[4])) + 3
    p_end = (ends + 1) / (n + 2)

    def spelled(word):
        b = (" " + word).encode()
        p = [1.0] + [0.0] * len(b)
        for i in range(len(b)):
            if b[i] & 0xC0 == 0x80 and p[i] == 0:
                continue
            size = 1
            while i + size < len(b) and b[i + size] & 0xC0 == 0x80:
                size += 1
            if b[i] & 0xC0 != 0x80 and b[i : i + size] not in pieces:
                p[i + size] += p[i] * math.exp(sum(vocabulary.logp[vocabulary.byte_ids[x]] + math.log1p(-p_end) for x in b[i : i + size]))
            for m in range(1, vocabulary.longest + 1):
                if i + m <= len(b) and b[i : i + m] in pieces:
                    p[i + m] += p[i] * math.exp(pieces[b[i : i + m]] + math.log1p(-p_end))
        return math.log10(p[-1])

    for r in found:
        text = dict((k, t) for k, t in rows)[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(spelled(w) for w in brute.plain(brute.lower(text))) + math.log10(p_end))


def test_likelihood_prefers_the_language(given):
    training = F.col("doc_id") % 2 == 0
    shuffled = given.select("doc_id", F.reverse(F.lower("text")).alias("text")).where("doc_id % 2 = 1")
    both = given.where("doc_id % 2 = 0").unionByName(given.where("doc_id % 2 = 1")).unionByName(shuffled.withColumn("doc_id", F.col("doc_id") + 1_000_001 - F.lit(1) + F.col("doc_id") % 2))
    rows = likelihood.score_likelihood(both, (F.col("doc_id") < 1_000_000) & training).where("n_tokens > 50").collect()
    rate = lambda keep: np.mean([r["score"] / r["n_tokens"] for r in rows if keep(r)])
    assert rate(lambda r: r["held_out"] and r["doc_id"] < 1_000_000) > rate(lambda r: r["doc_id"] > 1_000_000)


def test_audio(docs):
    rows = {r["doc_id"]: r for r in media.audio_digest(docs).collect()}
    for k, text in texts(docs).items():
        data = (text or "").encode()
        padded = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(padded), zlib.crc32(padded[-16:]))
        assert r["payload_sha256"] == __import__("hashlib").sha256(padded).hexdigest() and r["media_bytes"] == len(padded) + 44
    if rows:
        same = [k for k in (1, 2) if k in rows]
        assert len({rows[k]["feature"] for k in same}) <= len({texts(docs)[k] for k in same})


def test_audio_parts(odd):
    stored = media.store_audio(odd.select("doc_id", "text"))
    blocks = media.mel_blocks(stored).collect()
    assert {r["id"] for r in blocks} == set(ODD) and all(len(r["mel"]) == media.BLOCK * media.MELS for r in blocks)
    tensor = pa.ExtensionArray.from_storage(media.tensor_type(), pa.array([r["mel"] for r in blocks], pa.list_(pa.float32(), media.BLOCK * media.MELS)))
    assert tensor.to_numpy_ndarray().shape == (len(blocks), media.BLOCK, media.MELS)
    x = np.sin(np.arange(4000) * 2 * np.pi * 440 / 8000).astype(np.float32)
    y = media.resample(x, 1, 2)
    assert len(y) == 2000 and np.abs(y[100:-100] - x[::2][100:-100]).max() < 0.02
    assert media.segments(np.array([-1, 0, 5, 3, 5, 0, -1, 6, 6, -2.0])).tolist() == [[2, 6], [7, 9]]
    assert media.samples_of(media.wav(b"abc")) == b"abc"
    with pytest.raises(ValueError, match="WAV"):
        media.samples_of(b"nope")


def test_resampling_by_phases():
    """Against interpolation of every sample by the whole filter, for ratios with several phases."""
    x = np.random.default_rng(4).normal(size=500).astype(np.float32)
    for up, down in ((2, 3), (3, 2), (1, 2), (5, 4)):
        width = max(up, down)
        k = np.arange(-8 * width, 8 * width + 1)
        taps = np.sinc(k / width) * np.hamming(len(k)) * up / width
        spread = np.zeros(len(x) * up)
        spread[::up] = x
        want = np.convolve(spread, taps)[8 * width :][:: down][: -(-len(x) * up // down)]
        assert np.abs(media.resample(x, up, down) - want).max() < 1e-4


def test_features_by_definition():
    """Log-mel rows from the discrete Fourier sums themselves."""
    x = np.random.default_rng(5).normal(size=media.FRAME + media.HOP).astype(np.float32)
    found, rate = media.log_mel(x, 5000.0), 5000.0
    bank = media.mel_bank(rate, 129)
    for row in range(2):
        frame = x[row * media.HOP :][: media.FRAME] * np.hanning(media.FRAME)
        t = np.arange(media.FRAME)
        power = [abs(np.sum(frame * np.exp(-2j * np.pi * f * t / 256))) ** 2 for f in range(129)]
        assert np.abs(found[row] - np.log(np.array(power) @ bank + 1e-5)).max() < 1e-2


@pytest.mark.parametrize("k", range(1, 12))
def test_audio_hears_the_end(k):
    """The last word counts at every length, as every sample is in a frame."""
    heard = [media.features(media.wav(("some words " * 300)[: 192 * k - 5].encode() + last))[0] for last in (b" tail", b" town")]
    assert len(heard[0]) == 1 + max(0, -(-(128 * k - media.FRAME) // media.HOP)) and not np.array_equal(np.rint(heard[0] * 100), np.rint(heard[1] * 100))


def test_audio_digest_is_of_the_blocks(spark):
    rows = [(1, "some words " * 90 + "tail"), (2, "some words " * 90 + "town"), (3, None), (4, "x" * 70000), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = media.audio_digest(df).collect()
    assert [r["doc_id"] for r in found] == [1, 2, 3, 4, 1] and found[0]["feature"] != found[1]["feature"]
    blocks = media.mel_blocks(media.store_audio(df.where("doc_id = 4"))).orderBy("block").collect()
    says = dict(x.split("=") for x in found[3]["feature"].split(";"))
    assert int(says["frames"]) * media.MS == blocks[-1]["end_ms"] and int(says["active_ms"]) == sum(r["active"] for r in blocks) * media.MS
    mel = np.array([r["mel"] for r in blocks], np.float32).reshape(-1, media.MELS)[: int(says["frames"])]
    assert says["crc"] == f"{zlib.crc32(np.rint(mel * 100).astype('<i4').tobytes()):08x}"


def test_machine_learns_interactions():
    """Toxic only where both terms meet, which no sum of weights can say."""
    rng = np.random.default_rng(0)
    x = rng.random((600, 6)) < 0.4
    y = (x[:, 0] & x[:, 1]).astype(np.float32)
    rows, places = np.nonzero(x)
    machine = toxicity.fit(rows, places, y, np.ones(600), np.arange(6), epochs=300)
    score = machine.score(rows, places, 600)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.98


def test_toxicity(spark, odd, empty):
    bad = [(100 + k, f"{'vile scum group' if k % 2 else 'nice group day'} {BASE[k:k + 60]}") for k in range(80)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(bad, "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2) for k, _ in bad] + [(5, 0), (None, 1), (6, None), (999, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, machine).collect()}
    assert all((found[k] >= 0.7) == bool(k % 2) for k, _ in bad) and found[4] == found[5] < 0.7
    assert toxicity.score_toxicity(empty, machine).count() == 0
    assert toxicity.score_toxicity(odd, machine).columns == [*odd.columns, "_toxicity"]
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, none).where("toxicity > 0.01").count() == 0


def test_toxicity_fit_is_the_machines_own():
    """Scores are the factorization machine's formula, pair by pair."""
    rng = np.random.default_rng(8)
    machine = toxicity.Machine(np.arange(5), -0.3, rng.normal(size=5).astype(np.float32), rng.normal(size=(5, 3)).astype(np.float32))
    for size in range(6):
        x = rng.choice(5, size, replace=False)
        z = machine.bias + sum(machine.weights[i] for i in x) + sum(float(machine.factors[i] @ machine.factors[j]) for a, i in enumerate(x) for j in x[a + 1 :])
        assert machine.score(np.zeros(size, np.int64), x, 1)[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_quality_features():
    """The content view against counts in plain Python."""
    texts_ = ["Ab ab. XYZ 12! of the", None, "", "a\nb\n\nlonger line, here; #tag abab", "é Ü ß é"]
    found = cotraining.content_features(pa.array(texts_))
    assert found.shape == (5, len(cotraining.CONTENT) + cotraining.WORDS)
    for row, t in zip(found, texts_, strict=True):
        t = t or ""
        count, w, some = lambda chars, t=t: sum(c in chars for c in t), brute.plain(t), max(len(t), 1)
        letters = count("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
        want = [math.log1p(len(t)), math.log1p(len(w)), letters / some, count("0123456789") / some, count(",;:'\"()-") / some, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / (letters + 1), (len(t) - count(" \t\r\n")) / max(len(w), 1) / 10]
        want += [math.log1p(len(t) / (count("\n") + 1)), None, sum(len(x.encode()) <= 3 for x in w) / max(len(w), 1), count(".!?") / max(len(w), 1), count("#$%&*<>{}[]~^|\\=_") / some, len(set(w)) / max(len(w), 1)]
        assert all(a == pytest.approx(b) for a, b in zip(row, want, strict=False) if b is not None)
        assert row[len(want) :].sum() == pytest.approx(1 if w else 0)


def test_quality_exchange_helps(spark):
    """Few labels, on pages of a few sources: the metadata view learns the other sources from what the texts say."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(1200):
        good, source = k % 2, int(rng.integers(0, 12)) * 2 + k % 2
        words = rng.choice(["alpha", "beta", "gamma", "delta"] if good else ["spam", "junk", "click", "buy"], 12).tolist() + rng.choice(["the", "of", "and", "to"], 12).tolist()
        rows.append((k, " ".join(rng.permutation(words)), f"s{source}", "x", 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k, _, source, *_ in rows if source in ("s0", "s1", "s2", "s3")][:120], "doc_id long, quality int")

    def accuracy(rounds):
        found = cotraining.quality_scores(docs, labels, rounds=rounds).join(labels, "doc_id", "left_anti").collect()
        return tuple(np.mean([(r[c] >= 0.5) == (r["doc_id"] % 2 == 1) for r in found]) for c in ("metadata_score", "score"))

    (alone, _), (together, both) = accuracy(0), accuracy(2)
    assert together > alone + 0.05 and both > 0.95


def test_quality(spark, sf_dir, empty):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    scores = cotraining.quality_scores(docs, labels.where(~test))
    assert scores.count() == docs.count() and scores.where("score is null or score < 0 or score > 1").count() == 0
    rows = scores.join(labels.where(test), "doc_id").select("score", "quality").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.85
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "s", "l", -5)], docs.select("doc_id", "text", "source", "lang", "n_chars").schema)
    assert cotraining.quality_scores(odd, labels.limit(0)).where("score = 0.5").count() == 2
    assert cotraining.quality_scores(empty, labels).count() == 0


def test_repeated_rows(spark):
    """Rows that repeat an id: with the same text, and with another."""
    rows = [(1, BASE), (1, BASE), (2, "other text here"), (2, BASE), (3, BASE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert found == {1: 1, 2: 1, 3: 1}
    assert sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(df).collect()) == [(1, BASE), (1, BASE), (2, "other text here")]
    cut = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.substring_digest(df).collect())
    assert cut == [(1, 60, 0), (1, 60, 0), (2, 3, 0), (2, 60, 60), (3, 60, 60)]
    codes = sentencepiece_codec.codec_digest(df).collect()
    assert len(codes) == 5 and all(r["exact"] for r in codes) and len({r["ids_sha256"] for r in codes}) == 2


def test_null_ids(spark):
    """Rows without an id are one document, whose component is the smallest id that it reaches."""
    rows = [(None, BASE), (7, BASE), (None, "alone at all"), (8, "x"), (9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert found == {None: 7, 7: 7, 8: 8, 9: 8}
    assert {r["doc_id"]: r["n_removed"] for r in lines.line_dedup_digest(df).collect()} == {None: 0, 7: 1, 8: 0, 9: 1}
