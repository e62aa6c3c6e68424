"""Each stage of the pipeline against a plain version of it, and the whole over the smallest tables."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from tagloom.llm._tables import stash, table

from . import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = [table(spark, sf_dir, "documents")]
    for _, stage in P.STAGES:
        docs.append(stash(stage(spark, docs[-1], sf_dir)))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1]) and stages[-1].columns == ["doc_id", "ids", "n_tokens"]


def test_toxicity(spark, sf_dir, stages):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    gone = set(texts(stages[0])) - set(texts(stages[1]))
    toxic = {k for k, v in labels.items() if v == 1}
    assert len(gone & toxic) >= 0.9 * len(toxic) and not gone & {k for k, v in labels.items() if v == 0}


def test_lines(stages):
    before, after = texts(stages[1]), texts(stages[2])
    gone = brute.lines(before)
    for k, text in before.items():
        left = "\n".join(x for n, x in enumerate((text or "").split("\n")) if n not in gone[k])
        assert after.get(k) == (text if not gone[k] else left if left.strip() else None)


def test_near_duplicates(stages):
    found = brute.jaccard(texts(stages[2]))
    assert set(texts(stages[3])) == {k for k, (_, c) in found.items() if c == k}


def test_decontamination(spark, sf_dir, stages):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    found = brute.contamination(texts(stages[3]), items)
    assert set(texts(stages[4])) == {k for k, v in found.items() if not v[-1]}


def test_encoding(stages):
    rows = {r["doc_id"]: r["n_tokens"] for r in stages[5].collect()}
    assert set(rows) == set(texts(stages[4])) and all(rows[k] > 0 for k, v in texts(stages[4]).items() if v)
