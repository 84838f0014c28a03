"""Alignment against a plain version with the contract's own tokenizer calls."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dealscope.llm import op12_token_alignment as op

SCHEMA = "doc_id bigint, text string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_level():
    """The byte of each character of the byte-level alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def tokens():
    a = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    back = byte_level()

    def cut(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        want = b" " + text.encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return [], []
        return [list(zip(i, s)) for i, s in ((ids_a, bytes_a), (ids_b, bytes_b))]

    return cut


def ranges(tokens):
    out, at = [], 0
    for i, s in tokens:
        out.append((i, at, at + len(s)))
        at += len(s)
    return out


def brute(docs, cut):
    links, groups, sizes = [], [], []
    for _, text in docs:
        a, b = (ranges(x) for x in cut(text or ""))
        links.append([(i, j) for i, s, e in a for j, t, f in b if s < f and t < e])
        ends = sorted({e for _, _, e in a} & {f for _, _, f in b})
        parts = ["|".join(",".join(str(i) for i, s, e in x if lo < e <= hi) for x in (a, b)) for lo, hi in zip([0, *ends], ends)]
        groups.append(";".join(parts))
        sizes.append((len(a), len(b), len(ends)))
    count = Counter(p for x in links for p in x)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((i, *s, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for (i, _), x, g, s in zip(docs, links, groups, sizes)), key=str)


def table():
    rng = random.Random(3)
    words = ["the", "thion", "Straße", "naïve", "12.5%", "<|endoftext|>", "<s>", "日本語", "🙂", "\n", "\t", "erthat", "don't", "a" * 40, "  ", "▁x", "ﬁ"]
    docs = [(i, " ".join(rng.choices(words[:13], k=rng.choice([1, 4, 30, 150])))) for i in range(40)]
    docs += [(40, None), (41, ""), (42, " "), (43, "a▁b"), (44, "\x00 nul"), (45, words[-1]), (None, docs[0][1]), (5, docs[5][1]), (46, "<0x41>")]
    docs += [(100 + i, "hot copy of a text") for i in range(30)]
    docs += [(150 + i, "hot ﬁ without tokens ▁") for i in range(30)]
    docs += [(200, " ".join(rng.choices(words, k=400)))]
    return docs


@pytest.mark.parametrize("run, hot, block", [(op.RUN, op.HOT, op.BLOCK_BYTES), (64, 8, 600)])
def test_against_brute_force(spark, tokens, run, hot, block, monkeypatch):
    monkeypatch.setattr(op, "HOT_SHARE", 20)
    docs = table()
    if block < 1000:
        monkeypatch.setattr(op, "RUN", 128)
    monkeypatch.setattr(op, "BLOCK_BYTES", block)
    got = op.align(spark.createDataFrame(docs, SCHEMA).repartition(4), run=run, hot=hot, **op.vocabularies())
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, tokens)


def test_blocks_give_the_same_as_single_texts(tokens):
    texts = [t for _, t in table() if t]
    both = op.tokenizers_of(*op.vocabularies().values())
    unit = op.align_block(texts, [1] * len(texts), both)
    alone = [op.align_block([t], [1], both) for t in texts]
    assert unit["_groups"] == b"".join(u["_groups"] for u in alone)
    assert unit["_shas"] == b"".join(u["_shas"] for u in sorted(alone, key=lambda u: not u["_groups"]))


def test_very_long_text_matches_its_tokenizers(tokens):
    text = "The erthat of 3.5 naïve thions.\n" * 6000
    unit = op.align_block([text], [1], op.tokenizers_of(*op.vocabularies().values()))
    import numpy as np
    import pyarrow as pa

    four = op.unpacked(pa.scalar(unit["_measures"], pa.binary()), np.int64)
    a, b = tokens(text)
    ends = len({e for _, _, e in ranges(a)} & {e for _, _, e in ranges(b)})
    assert four.tolist() == [len(a), len(b), ends, len(a) + len(b) - ends]


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3.0)], SCHEMA + ", _sha string, n_a double")
    assert op.align(docs.limit(0), **op.vocabularies()).count() == 0
    assert op.align(docs, **op.vocabularies()).columns == COLUMNS
    assert [tuple(r)[1:] for r in op.align(spark.createDataFrame([(1, None), (2, "")], SCHEMA), **op.vocabularies()).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
