"""Exact dedup against brute force; the trie against a dictionary."""

import hashlib
import random
import re

import pytest

from dealscope.llm import op7_exact_dedup as op


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def order(i):
    return (i is None, i or 0)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min(ids, key=order)
        for n, i in enumerate(sorted(ids, key=order)):
            out.append((i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(4)
    texts = ["", " ", "a b", "a  b", "a\tb", "a\nb ", "ab", "é", "é ", "x" * 5000, "x" * 4999 + "y", "w " * 300, "w  " * 300, " "]
    out = [(i, rng.choice(texts)) for i in range(120)] + [(i, "hot copy of one text") for i in range(1000, 1700)]
    out += [(5, "twice"), (5, "twice"), (6, None), (None, "a b"), (None, "only without id"), (None, "only without id"), (8, "twice"), (9, "unique")]
    rng.shuffle(out)
    return out


@pytest.fixture(params=[op.HOT, 7])
def hot(request, monkeypatch):
    monkeypatch.setattr(op, "HOT", request.param)
    monkeypatch.setattr(op, "SUBTREE_BYTES", 1 << 12)


def frame(spark):
    data = [(i, t, "x", 3, n) for n, (i, t) in enumerate(rows())]
    return spark.createDataFrame(data, "doc_id bigint, text string, _sha string, _len int, n int").repartition(5)


def test_against_brute_force(spark, hot):
    got = [(r._id, r._keep, r._n, r._kept, bytes(r._sha).hex()) for r in op.exact_groups(frame(spark)).collect()]
    assert sorted(got, key=str) == brute(rows())


def test_stage_keeps_one_row_and_all_columns(spark, hot):
    out = op.drop_copies(frame(spark))
    assert out.columns == ["doc_id", "text", "_sha", "_len", "n"]
    got = sorted(((r.doc_id, norm(r.text)) for r in out.collect()), key=str)
    by = {}
    for i, t in rows():
        by.setdefault(norm(t), []).append(i)
    assert got == sorted(((min(ids, key=order), t) for t, ids in by.items()), key=str)


def test_trie():
    rng = random.Random(2)
    trie, want, terminals = op.RadixTrie(), {}, {}
    for n in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9)))
        ident = rng.choice([None, rng.randrange(100)])
        terminals[key] = trie.insert(key, ident)
        old = want.get(key)
        want[key] = ident if key not in want or old is None else old if ident is None else min(old, ident)
        assert terminals[key][0] == want[key]
    assert all(trie.insert(k, None)[0] == v for k, v in want.items())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert op.exact_groups(df).collect() == [] and op.drop_copies(df).collect() == []
