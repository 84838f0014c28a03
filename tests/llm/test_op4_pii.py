"""Base patterns against the literal regular expressions; message passing
against exact enumeration; consistency of repeated tokens."""

import hashlib
import itertools
import random
import re
import sys

import numpy as np

from dealscope.llm import op4_pii as op


def literal(text):
    text = text or ""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def samples():
    rng = random.Random(7)
    parts = ["a@b.co", "x.y+z@mail-1.example.com", "@", ".", "1.2.3.4", "300.1.1.1", "10.0.0.255", "4111 1111 1111 1111", "4041894974608795", "4041894974608796",
             "+1 (386) 555-3733", "+", "555-3733", " ", "-", "é🙂", "word", "\n", "007", "1", "(", ")", "a@b@c.d.e"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + ["9" * 3000, "1." * 2000, "a" * 3000 + "@", "+1" + " " * 2000]


def test_base_spans():
    for text in samples():
        assert op.base_spans(text) == literal(text), text


def test_digit_runs_of_any_length():
    runs = ["0" * 5001 + ".1.2.3", "1.2.3." + "0" * 9000 + "255", "9" * 5001 + ".1.2.3", "1." * 9 + "7" * 6000, "+" + "1" * 7000, "0" * 5000]
    wanted = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        for text in runs:
            assert op.base_spans(text) == literal(text)
    finally:
        sys.set_int_max_str_digits(wanted)
    assert op.base_spans(runs[0]) == [(1, 0, 5007)]


def pairwise(marginal_of, unary, edges, tables, n):
    total = np.zeros((len(unary), n))
    for labels in itertools.product(range(n), repeat=len(unary)):
        w = np.exp(sum(unary[i, a] for i, a in enumerate(labels)) + sum(t[labels[i], labels[j]] for (i, j), t in zip(edges, tables)))
        for i, a in enumerate(labels):
            total[i, a] += w
    return total / total.sum(1, keepdims=True)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(3)
    model = op.Model([], np.zeros((5, 5)), 0, 0)
    model.weights = rng.normal(0, 0.5, model.weights.shape)
    model.chain = rng.normal(0, 0.4, (5, 5))
    model.skip = 2.0
    text = "alpha1 4111 2222a 99999"
    found = [(0, 6, 0), (7, 11, 0), (12, 17, 0), (18, 23, 0)]
    unary = np.array([op.features(text, s, e) for s, e, _ in found]) @ model.weights
    edges = [(0, 1), (1, 2), (2, 3)]
    want = pairwise(None, unary, edges, [model.chain] * 3, 5)
    assert np.allclose(model.marginals(text, found, []), want, atol=1e-4)


def model():
    found = []
    for kind, text in ((1, "jane.42@mail.example.com"), (2, "10.20.30.40"), (3, "4111111111111111"), (4, "+1 (386) 555-3733")):
        found += [(op.features(text, 0, len(text)), kind)] * 40
    for text in ("version 2.0", "1999", "x86_64"):
        found += [(op.features(text, 0, len(text)), 0)] * 40
    return op.Model(found, np.ones((5, 5)), 60, 0)


def spans(text, m=None):
    return op.render(op.all_spans(text, m or model())[1])


def test_repeats_follow_their_entity():
    text = "Call +1 (386) 555-3733 now.\n" + "Plain prose stands here. " * 40 + "Again: (386) 555-3733, in 1999."
    a, b = text.index("+1"), text.rindex("(386)")
    assert spans(text) == f"phone:{a}:{a + 17},phone:{b}:{b + 14}"
    assert spans("Call (386) 555-3733 now, in 1999.") == ""
    assert spans("Version 2.0 of 1999 has 12345678 lines.") == ""
    text = "jane.42@mail.example.com wrote; jane.42 signed."
    assert spans(text) == f"email:0:24,email:{text.rindex('jane')}:{text.rindex('jane') + 7}"


def test_letter_only_addresses():
    prose = "Plain prose stands here. " * 40
    for again in ("john.smith", "John.Smith", "john.smith@corp"):
        text = f"Mail john.smith@corp.com now. {prose}Ask {again}, not john or smith."
        a, b = text.index("john"), text.index(f"{again},")
        assert spans(text) == f"email:{a}:{a + 19},email:{b}:{b + len(again)}", again
    text = "bob@corp.com wrote.\nSigned: bob."
    assert spans(text) == f"email:0:12,email:{len(text) - 4}:{len(text) - 1}"
    text = "jane.42@mail.example.com wrote; ask jane.42@mail."
    assert spans(text) == f"email:0:24,email:{text.rindex('jane')}:{len(text) - 1}"
    assert spans("john.smith and john.smith@corp wrote.") == ""
    assert spans("a@b.co wrote a letter, éjohn john.") == "email:0:6"
    assert spans("x1y2@b@c.d.e has x1y2") == "email:5:12"


def test_letter_only_addresses_with_fitted_weights(spark):
    names = ["ann.lee", "john.smith", "mary.jones", "bob.brown"]
    docs = spark.createDataFrame([(i, f"Mail {n}@corp.com at 10.20.30.{i}. Plain prose, version 2.0. {n}@corp.com signed as {n}.") for i, n in enumerate(names * 30)], "doc_id bigint, text string")
    for r in op.find(docs, op.fit(docs)).collect():
        n = names[r.doc_id % 4]
        assert f"email:{r.text.rindex(n)}:{len(r.text) - 1}" in r._pii.spans.split(",")


def test_base_spans_always_stay():
    m = model()
    for text in samples()[:800]:
        base, every = op.all_spans(text, m)
        assert base == literal(text) and set(base) <= set(every)
        flat = sorted((s, e) for _, s, e in set(every) - set(base))
        assert all(e <= b or s >= f for s, e in flat for _, b, f in base)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op.op4_pii(spark, d).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = literal(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(op.render(base).encode()).hexdigest()
        assert base or r.spans == ""
        assert set(filter(None, op.render(base).split(","))) <= set(r.spans.split(","))


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (3, "a@b.co", "x"), (3, "a@b.co", "x")], "doc_id bigint, text string, _pii_old string")
    got = sorted(((r.doc_id or 0, r._pii.n_email, r._pii.spans) for r in op.find(docs, op.fit(docs)).collect()))
    assert got == [(0, 1, "email:0:6"), (1, 0, ""), (2, 0, ""), (3, 1, "email:0:6"), (3, 1, "email:0:6")]
    none = docs.limit(0)
    assert op.find(none, op.fit(none)).collect() == []
