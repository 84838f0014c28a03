"""License phrases and the set-similarity join against brute force."""

import math
import random
import re
import textwrap

from dealscope.llm import op3_license_scan as op


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words(text)
    places = [(i, label) for p, label in op.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    labels, best = {label for _, label in places}, 0.0
    for line in (text or "").split("\n"):
        have = set(words(line))
        for label, t in op.TEMPLATES:
            need = set(op._template_words(t))
            part = len(have & need)
            if part >= math.ceil(op.CONTAINMENT * len(need) - 1e-9) and part:
                labels.add(label)
                best = max(best, part / len(need))
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)),
            1.0 if places else best)


def texts():
    rng = random.Random(5)
    vocabulary = sorted({w for _, t in op.TEMPLATES for w in op._template_words(t)}) + ["plain", "prose", "MIT", "License", "é", "mit", "license"]
    out = [None, "", " ", "MIT License", "mit\nlicense", "mit-license apache  License General.Public\nLicense", "mitlicense", "xmit license", "MIT licenses",
           "mit mit license license", "general public", "license", "KKelvin mitK license", "İmit license", "émit license", "a" * 50 + " mit license"]
    for _, t in op.TEMPLATES:
        out += [t, t.upper(), "Some prose. " + t + " More prose.", t.replace(" ", "\n"), " ".join(t.split()[: -len(t.split()) // 3])]
        out.append(" ".join(w for w in t.split() if rng.random() > 0.12))
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return out + ["\n".join(rng.sample([x for x in out if x], 6)) for _ in range(20)]


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(None, "mit license", "x", 1), (0, None, "x", 1)],
                               "doc_id bigint, text string, _label string, _n int").repartition(3)
    got = {}
    for r in op.scan(df).collect():
        got.setdefault(r._id, []).append(r)
    assert len(got[0]) == 2 and got[None][0]._labels == ["mit"]
    for i, t in rows:
        r = got[i][0]
        at = r._places
        assert (r._n, len(at), min(at, default=None), max(at, default=None), ",".join(r._base_labels), ",".join(r._labels), r._score) == brute(t), t


def test_empty_table(spark):
    assert op.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = op.op3_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def unbroken(text):
    """Labels and score of the lines and of every run of consecutive words, line breaks ignored."""
    *_, base, labels, score = brute(text)
    labels, w = set(filter(None, labels.split(","))), words(text)
    for label, t in op.TEMPLATES:
        need, reach = set(op._template_words(t)), math.ceil(len(words(t)) / op.CONTAINMENT - 1e-9)
        for i in range(len(w)):
            part = len(set(w[i:i + reach]) & need)
            if part >= math.ceil(op.CONTAINMENT * len(need) - 1e-9):
                labels.add(label)
                score = max(score, part / len(need))
    return sorted(labels), score


def wrapped_texts():
    out, wrap = [], lambda t: textwrap.wrap(t, 72)
    for _, t in op.TEMPLATES:
        prose = "Some plain prose stands here and there. "
        out += ["\n".join(wrap(t)), t.replace(" ", "\n"), "\r\n".join("# " + x for x in wrap(t)), "\n *\n".join(" * " + x for x in wrap(prose + t + " " + prose))]
    return out


def test_wrapped_templates(spark):
    rows = list(enumerate(wrapped_texts() + texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r._id: r for r in op.scan(df, wrapped=True).collect()}
    for i, t in rows:
        assert (got[i]._labels, got[i]._score) == unbroken(t), t
    for k, (label, _) in enumerate(op.TEMPLATES):
        for i in range(4 * k, 4 * k + 4):
            assert label in got[i]._labels and got[i]._score == 1.0, rows[i]


def test_query_reads_wrapped_lines(spark, tmp_path):
    rows = list(enumerate(wrapped_texts()))
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.labels, r.score) for r in op.op3_license_scan(spark, str(tmp_path)).collect()}
    for i, t in rows:
        labels, score = unbroken(t)
        assert got[i] == (",".join(labels), score), t
