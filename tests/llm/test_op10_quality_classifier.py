"""Held-out accuracy, defined results, and fitting only on the training fold."""

import zlib

import numpy as np
import pyarrow as pa

from dealscope.llm import op10_quality_classifier as op
from dealscope.llm import text as T

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op.op10_quality_classifier(spark, DIR).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([(s >= 0.3) == y for s, y in held]) >= 0.93
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_held_out_labels_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    flipped = labels.withColumn("quality", op.F.when(op.fold(labels.doc_id) == 0, 1 - labels.quality).otherwise(labels.quality))
    (p, a), (_, b) = op.fit(docs, labels, max_train=200), op.fit(docs, flipped, max_train=200)
    assert all(np.array_equal(x, y) for x, y in zip(a.w, b.w)) and a.temperature == b.temperature


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, "fine words here. And more."), (2, None), (3, ""), (None, "x"), (1, "fine words here. And more.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0), (2, 0, 0), (77, 1, 0), (3, 5, 0)], "doc_id bigint, quality int, toxic int")
    rows = op.score(docs, op.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r._score <= 1 for r in rows)
    scores = [r._score for r in rows if r.doc_id == 1]
    assert scores[0] == scores[1]
    none = op.fit(docs, labels.limit(0))
    assert {r._score for r in op.score(docs, none).collect()} == {0.5}
    assert op.score(docs.limit(0), none).collect() == []


def test_scores_do_not_depend_on_blocks():
    texts = ["The first text. It has words!", "", "SECOND!! TEXT!! HERE!!", "a | b | c", "same same same same", "é ü 日本 \t x"]
    pool = op.Pooler(np.random.default_rng(1).integers(-5, 5, (op.WORDS, op.DIM)))
    together = np.concatenate([pool(d, o) for _, d, o in T.blocks(pa.array(texts))])
    alone = np.concatenate([pool(d, o) for t in texts for _, d, o in T.blocks(pa.array([t]))])
    assert np.allclose(together, alone, atol=1e-6)


def test_context_sums_against_brute_force():
    texts = ["a b c a b", "c", "", "a a"]
    index = op.index_vectors(op.WORDS, op.SEED)
    got = op.context_sums(T.blocks(pa.array(texts)), index)
    want = np.zeros_like(got)
    for t in texts:
        buckets = [int(op.tokens(*T.raw(pa.array([w])))[0][0]) for w in t.split()]
        for i, b in enumerate(buckets):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(buckets):
                    want[b] += index[buckets[j]]
    assert np.array_equal(got, want)


def test_keep_good_drops_rejected_and_keeps_columns(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    out = op.keep_good(docs, labels)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
