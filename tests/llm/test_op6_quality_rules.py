"""Base counts against brute force; line rules."""

import random
import re
from collections import Counter

from dealscope.llm import op6_quality_rules as op

PROSE = "The first sentence of this text is plain prose, and it goes on. A second one follows it at once. "


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    n, rep = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 10 or 100 * rep > 20 * n


def test_counts(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "one", "a b c d e a b c d e", "x\nx\n\nx \n", "é ß 日本 🙂 #*$%&|<>", PROSE * 40, "\x1c\x85 z"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 80))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["l one", "l two", "", " ", "# x"]) for _ in range(9)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, 1, False) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int, kept boolean")
    for r in op.judge(df).collect():
        q = r._quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (q.base_failed and q.kept)


def kept(spark, *texts):
    return [r._quality.kept for r in op.judge(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]


def test_verdicts(spark):
    unique = " ".join(f"word{i}" for i in range(60))
    good = "\n".join(" ".join(f"{w}{i}" for w in "A line tells something of its own, as prose does. It ends some words later.".split()) + "." for i in range(8))
    symbols = " ".join(f"w{i}{'*#$%'[i % 4] * 3}" for i in range(80))
    menu = "\n".join(f"Home{i} | About{i} | Contact{i} | Login{i} | Help{i}" for i in range(12))
    loud = " ".join(f"WORD{i}!!" for i in range(80))
    assert kept(spark, good, unique[:120] + ". And it goes on.", good + "\n" + menu[:200]) == [True, True, True]
    assert kept(spark, symbols, menu, loud, unique, "too short.") == [False] * 5


def test_clean_text(spark):
    df = spark.createDataFrame([("A plain line stands here.\nHome\nWe use cookies here.\nA plain line stands here.\n\nThe end of it.",), (None,)], "text string")
    assert [r[0] for r in df.select(op.clean_text(df.text)).collect()] == ["A plain line stands here.\n\nThe end of it.", ""]


def test_empty_table(spark):
    assert op.judge(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(r.kept, r.base_failed, labels[r.doc_id]) for r in op.op6_quality_rules(spark, d).collect() if r.doc_id in labels]
    clean = [k for k, failed, q in got if q and not failed]
    junk = [k for k, _, q in got if not q]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)
