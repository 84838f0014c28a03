"""Ranked search against a brute-force version over every item and document."""

import math
import random
import re
from collections import Counter

import pytest

from dealscope.llm import op11_ranked_search as op

ITEMS, DOCS = "item_id bigint, text string", "doc_id bigint, text string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(items, docs, k):
    have = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    have = [x for x in have if x[2]]
    n, total = len(have), sum(x[2] for x in have)
    df = Counter(t for _, c, _ in have for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in {t for _, x in items for t in terms(x)} | set(df)}
    out = []
    for item, text in items:
        scored = []
        for ident, c, size in have:
            m = 75 + 25 * size * n // total
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, ident is None, ident))
        out += [(item, r + 1, ident, -s) for r, (s, _, ident) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def table(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "ß", "naïve", "42"]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, odds, k=rng.choice([1, 3, 20, 200])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!"), (None, docs[0][1]), (3, docs[3][1]), (7, "W1-w2_W3 É\x00é"), (n + 3, "w1 " * 200_000 + "w50")]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(9)] + [(None, "w1 w1 w2"), (0, "w5"), (20, None), (21, "unheard of"), (22, "W1 É")]
    return items, docs


@pytest.mark.parametrize("block_terms", [op.BLOCK_TERMS, 50])
def test_against_brute_force(spark, block_terms, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 64)
    items, docs = table(700, 5)
    got = op.search(spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS).repartition(3), k=20, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(items, docs, 20)


def test_buckets_skip_most_vectors():
    """The bounds leave few vectors for the integer scores where one document holds the item."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    corpus = op.Corpus(5000, 5000 * 30, np.full(400, 300))
    terms_of = [np.sort(rng.choice(400, 30, replace=False)) for _ in range(5000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(5000), pa.int64()), pa.array([30] * 5000, pa.int64()), pa.array(terms_of, pa.list_(pa.int32())), pa.array([[1] * 30] * 5000, pa.list_(pa.int32()))],
        names=["_id", "_n", "_terms", "_tfs"])
    v = op.Vectors(corpus, [batch])
    items = op.Items([(terms_of[17].tolist(), [1] * 30)], corpus)
    floor = int(0.9 * 30 * corpus.weight[0] * v.p[0])
    scored = []

    class Counted(op.Best):
        def add(self, scores, ids, null):
            scored.extend(ids.tolist())
            super().add(scores, ids, null)

    best = [Counted(1, floor)]
    op.search_chunk(v, np.arange(5000), items, np.array([0]), best, 400)
    assert best[0].ids.tolist() == [17] and len(scored) < 10


def test_long_texts_are_cut_into_terms_by_slices(monkeypatch):
    text = ("Ab-c é9 " * 50 + "x" * 300).encode()
    whole = op.term_counts(text)
    monkeypatch.setattr(op, "SLICE_BYTES", 7)
    assert op.term_counts(text) == whole and whole[0] == 151


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2.0)], DOCS + ", _id string, score double")
    items = spark.createDataFrame([(5, "b", "y")], ITEMS + ", rank string")
    assert [tuple(r) for r in op.search(items, docs).collect()] == [(5, 1, 1, 287 * (10**9 // 2200))]
    assert op.search(items.limit(0), docs).count() == 0
    assert op.search(items, docs.limit(0)).count() == 0
    assert op.search(spark.createDataFrame([(1, None)], ITEMS), docs).count() == 0
