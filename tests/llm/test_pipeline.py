"""The corpus pipeline, stage by stage against brute force, on a small table
with nulls, empty and repeated rows, and clashing column names."""

import random

import corpus_pipeline
from tests.llm.test_op1_packing import check_sequences, reference_ids
from tests.llm.test_op2_ngram_jaccard import brute as components
from tests.llm.test_op7_exact_dedup import norm
from tests.llm.test_op9_mixing import brute as mixed

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, _id int, _score double, size int"


def documents():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, prose(rng.randrange(1, 90)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, "\n".join([rows[i][1], ""]), "s0") for i in range(10)]  # near copies
    rows += [(200 + i, rows[20 + i][1].replace(" ", "  "), "s1") for i in range(10)]  # equal after normalising
    rows += [(300 + i, " ".join(f"{w}***" for w in prose(30).split()), "s2") for i in range(20)]  # junk
    rows += [(400, None, "s0"), (401, "", None), (402, None, None), (5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (None, prose(12), "s1")]
    return [(i, t, "en", s, len(t or ""), "r", 1, 0.5, 2) for i, t, s in rows]


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(not 300 <= r[0] < 320), 0) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def stages(spark, path):
    """(name, rows in, rows out) of every stage, each written and read again."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, path).write.parquet(f"{path}/out{n}")
        docs = spark.read.parquet(f"{path}/out{n}")
        if n < 4:
            assert docs.columns == before.columns
        yield name, before.collect(), docs.collect()


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_stages(spark, tmp_path):
    seen = {name: (a, b) for name, a, b in stages(spark, write(spark, tmp_path, documents()))}
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    before, after = seen["quality classifier"]
    good = [r for r in before if r.doc_id is not None and r.doc_id < 60]
    assert set(after) <= set(before) and sum(r in after for r in good) >= 0.9 * len(good)

    before, after = seen["exact dedup"]
    first = {}
    for r in before:
        if norm(r.text) not in first or key(r) < key(first[norm(r.text)]):
            first[norm(r.text)] = r
    assert sorted(map(str, after)) == sorted(map(str, first.values()))

    before, after = seen["n-gram Jaccard join"]
    root = {i: c for i, _, c in components([(r.doc_id, r.text) for r in before])}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r.doc_id is None or root[r.doc_id] == r.doc_id)

    before, after = seen["mixing"]
    want = {}
    for i, size, _, _, taken in mixed([(r.doc_id, r.text, r.source) for r in before])[0]:
        want[i] = taken // size if size else 0
    got = {}
    for r in after:
        if (r.text or "").split():  # a copy of an empty text takes no words
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}

    before, pieces = seen["packing"]
    check_sequences(pieces)
    texts = {r.doc_id: r.text for r in before}
    for i, text in texts.items():
        ids = reference_ids(text)
        mine = [p for p in pieces if p.doc_id == i]
        assert all(ids[p.start:p.start + p.length] == p.ids for p in mine)
        assert sum(p.length for p in mine) == len(ids) * sum(r.doc_id == i for r in before)


def test_run_and_empty_table(spark, tmp_path):
    path = write(spark, tmp_path / "a", documents())
    assert corpus_pipeline.run(spark, path).count() > 0
    path = write(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, path).collect() == []
