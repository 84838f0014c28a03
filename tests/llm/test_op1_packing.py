"""Packing: exact round trip against the tokenizers library; the dynamic
programme against brute force."""

import functools
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from dealscope.llm import op1_packing as op

TEXTS = [
    (3, "A first one. And a second sentence!\nA third"), (1, None), (2, ""), (7, "word " * 9000), (8, "x" * 30000),
    (9, "dots. " * 5000), (4, "same. text"), (4, "same. text"), (None, "no id."), (10, "naïve café    日本語 🙂 <|endoftext|> é\x85 y"),
]


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def reference_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    return by


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, 5, "a") for i, t in TEXTS], "doc_id bigint, text string, start bigint, ids string").coalesce(1)
    rows = op.pack(df, ranks_file=str(op.vocabulary())).collect()
    check_sequences(rows)
    got = defaultdict(list)
    for r in rows:
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length
        got[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for ident in {i for i, _ in TEXTS}:
        texts = [t for i, t in TEXTS if i == ident]
        want = reference_ids(texts[0])
        assert sum(len(p[1]) for p in got[ident]) == len(want) * len(texts)
        seen = defaultdict(list)
        for start, ids, n in got[ident]:
            assert n == len(want)
            assert want[start:start + len(ids)] == ids
            seen[start].append(len(ids))
        if len(texts) == 1:
            assert sorted(i for s, ids, _ in got[ident] for i in range(s, s + len(ids))) == list(range(len(want)))


def test_ids_equal_on_odd_strings():
    encode, _ = op.encoder(str(op.vocabulary()))
    rng = random.Random(5)
    alphabet = "ab Z09.,'\n\t\r\x0b\x1c\x85    éßñ日🙂́_-<|>​﻿\u0000"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        assert encode(text).tolist() + [1] == reference_ids(text), repr(text)


def test_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(200):
        steps = [rng.randrange(1, 7) for _ in range(rng.randrange(1, 10))]
        pos, cost = list(itertools.accumulate(steps)), [rng.choice([0, 1, 4]) for _ in steps]
        best = None
        for mask in itertools.product([0, 1], repeat=len(pos) - 1):
            cuts = [p for p, m in zip(pos, (*mask, 1)) if m]
            if all(b - a <= 8 for a, b in zip([0, *cuts], cuts)):
                total = 8 * len(cuts) + sum(c for p, c in zip(pos, cost) if p in cuts)
                best = total if best is None else min(best, total)
        got = op.best_cuts(pos, cost, 8)
        assert got[-1] == pos[-1] and all(b - a <= 8 for a, b in zip([0, *got], got))
        assert 8 * len(got) + sum(c for p, c in zip(pos, cost) if p in got) == best


def test_query_covers_documents_with_little_padding(spark):
    rows = op.op1_packing(spark, "/root/testdata/sf0.01").collect()
    by = check_sequences(rows)
    total = sum(r.length for r in rows)
    assert 1 - total / (2048 * len(by)) < 0.02
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == docs.keys()
    for ident in sorted(docs)[::37]:
        want, at = reference_ids(docs[ident]), 0
        for r in sorted(pieces[ident], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(want[at:at + r.length]) and r.doc_tokens == len(want)
            at += r.length
        assert at == len(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert op.pack(df, ranks_file=str(op.vocabulary())).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 200, 5000])
def test_cut_points_are_dense(n):
    ids = np.append(np.full(n, 11), 1)
    at, cost = op.cut_points(ids, np.zeros(60000, bool))
    assert at[-1] == n + 1 and cost[-1] == 0 and np.all(np.diff(np.concatenate(([0], at))) > 0) and np.diff(np.concatenate(([0], at))).max() <= 2 * op.STRIDE
