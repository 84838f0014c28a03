"""Mixing against a small brute-force version."""

import hashlib
import math
import re

import pytest

from dealscope.llm import op9_mixing as op

ROWS = [(1, "a b c", "s1"), (2, None, "s1"), (3, "", "s2"), (4, "x " * 100, "s2"), (5, "one", None), (6, "two words", None),
        (7, "q " * 1000, "S"), (7, "q " * 1000, "S"), (None, "no id here", "é"), (8, "", "empty"), (9, "big " * 5000, "z")]


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: op.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    whole = {s: math.floor(target[s] / total[s]) if total[s] else 0 for s in total}
    u = lambda i: int(hashlib.md5(f"{op.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16)
    extra = set()
    for s in total:
        need = target[s] - whole[s] * total[s]
        for n in range(op.ROUNDS):
            groups = {}
            for k, (i, t, x) in enumerate(rows):
                if x == s and size(t) and k not in extra and (n == 0 or size(t) <= need):
                    groups.setdefault(u(i), []).append(k)
            got = 0
            for h in sorted(groups):
                words = sum(size(rows[k][1]) for k in groups[h])
                if got + words > need:
                    break
                got += words
                extra |= set(groups[h])
            need -= got
    out = [(i, size(t), total[s], round(target[s], 6), (whole[s] + (k in extra)) * size(t)) for k, (i, t, s) in enumerate(rows)]
    return sorted(out, key=str), target


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id bigint, text string, source string, size int, _w string")


def test_against_brute_force(spark):
    want, target = brute(ROWS)
    got = sorted(((r.doc_id, r._size, r._source_size, round(r._target, 6), r._copies * r._size) for r in op.mix(frame(spark)).collect()), key=str)
    assert got == want
    assert abs(sum(target.values()) - 1.5 * sum(r[1] for r in want)) < 1e-6


def test_expand_repeats_rows(spark):
    out = op.expand(frame(spark))
    assert out.columns == ["doc_id", "text", "source", "size", "_w"]
    copies = {}
    for r in op.mix(frame(spark)).collect():
        copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), 0) + r._copies
    got = {}
    for r in out.collect():
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
    assert got == {k: v for k, v in copies.items() if v}


@pytest.mark.parametrize("sf, near", [("0.01", 0.03), ("0.1", 0.002)])
def test_taken_is_near_each_source_target(spark, sf, near):
    got = op.mix(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")).selectExpr("source", "_size", "_target", "_copies * _size as taken").collect()
    assert all(r.taken <= 2 * r._size for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        taken, target = sum(r.taken for r in own), own[0]._target
        assert (1 - near) * target <= taken <= target


def test_hash_ranges_of_any_width_give_one_threshold(spark, monkeypatch):
    rows = [(i, "w " * (1 + i * 7919 % 60), f"s{i % 3}") for i in range(400)]
    want, _ = brute(rows)
    for bits in (1, 20):
        monkeypatch.setattr(op, "BIN_BITS", bits)
        got = op.mix(frame(spark, rows)).selectExpr("doc_id", "_size", "_source_size", "round(_target, 6)", "_copies * _size").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_empty_table(spark):
    assert op.mix(frame(spark, [])).collect() == []
    assert op.expand(frame(spark, [])).collect() == []


def test_all_empty_texts(spark):
    assert [(r._size, r._target, r._copies) for r in op.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()] == [(0, 0.0, 0)] * 2
