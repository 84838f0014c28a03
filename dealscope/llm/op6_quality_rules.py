r"""Quality rules, line first.

Every line is judged alone: a punctuation rule (symbol-ridden, shouting or
long without any sentence punctuation), a navigation rule (separator lists,
menu phrases) and a boilerplate rule (notices, or an exact repeat of an
earlier line).  Failing lines are removed; a document that loses more than
``MAX_LOSS`` of its words is rejected, as is one that fails the base rules.

One scalar Arrow UDF per row block: rows stay where they are, nothing is
shuffled, and counts are taken on byte arrays of about ``BLOCK_BYTES``.

Defined results: null and empty text have no words and fail the base rules
(fewer than ten words); repeated rows are judged alike; an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from dealscope.llm import text as T

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MAX_LOSS = 0.5
BLANK = " \t\n\x0b\x0c\r"

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True

#: Phrases of notices and menus (compared in lower case).
NOTICES = ("all rights reserved", "cookie policy", "we use cookies", "accept cookies", "privacy policy", "terms of use",
           "terms of service", "enable javascript", "javascript is disabled", "subscribe to our newsletter", "lorem ipsum")
MENUS = ("home", "about", "about us", "contact", "contact us", "login", "log in", "sign in", "sign up", "register", "search",
         "menu", "next", "previous", "next page", "previous page", "back to top", "read more", "click here", "share", "share this",
         "skip to content", "sitemap")

_SEPARATORS = re.compile(r" [|»›>·•/] ")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”»)\]]*(?:\s|$)")
_LOUD = re.compile(r"!{2,}|\?{3,}")


def line_fails(line: str, words: int) -> bool:
    """Punctuation, navigation and phrase rules of one stripped line."""
    if words >= 3:
        if 5 * sum(map(line.count, "#*$%&|<>")) > 2 * words:
            return True
        if 10 * len(_LOUD.findall(line)) > 3 * words:
            return True
    if 4 * len(_SEPARATORS.findall(line)) > words:
        return True
    if words >= 40 and not _SENTENCE.search(line) and line.count(",") * 40 < words:
        return True
    if words <= 25:
        low = line.lower()
        return low.strip(" .:>»|") in MENUS or any(p in low for p in NOTICES)
    return False


def _words(line: str) -> int:
    return len(line.encode().split())


def clean_lines(text: str, fails=line_fails) -> tuple[str, int, int]:
    """(kept lines, words kept, lines that repeat an earlier one)."""
    seen, kept, words, repeats = set(), [], 0, 0
    for line in text.split("\n"):
        body = line.strip(BLANK)
        if not body:
            kept.append(line)
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        if again:
            continue
        n = _words(body)
        if not fails(body, n):
            kept.append(line)
            words += n
    return "\n".join(kept), words, repeats


def base_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_repeat_words of every row of a block."""
    n = len(off) - 1
    starts, ends, rows = T.words(data, off)
    n_words = T.per_row(rows, n)
    letters = ~T._SPACE[data] & ((data & 0xC0) != 0x80)
    chars, symbols = T.span_sums(letters, off), T.span_sums(_symbol[data], off)
    repeat = np.zeros(n, np.int64)
    hashes, first = T.windows(T.span_hash(data, starts, ends), rows)
    if len(first):
        own = T.mix(hashes ^ T.mix(rows[first].astype(np.uint64) + np.uint64(1)))
        _, back, count = np.unique(own, return_inverse=True, return_counts=True)
        hit = first[count[back] > 1]
        edge = np.zeros(len(rows) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + 5, -1)
        repeat = T.per_row(rows[np.cumsum(edge[:-1]) > 0], n)
    return n_words, chars, symbols, repeat


_FIELDS = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                     ("n_repeat_words", pa.int64()), ("n_kept_words", pa.int64())])
_DDL = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_kept_words bigint"


def _measure(text: pa.Array) -> pa.Array:
    parts = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*(base_counts(d, o) for _, d, o in T.blocks(text)))] or [np.zeros(0, np.int64)] * 4
    kept, dup = [], []
    for t in text:
        _, words, repeats = clean_lines(t.as_py())
        kept.append(words)
        dup.append(repeats)
    n_words, chars, symbols, repeat = (pa.array(p, pa.int64()) for p in parts)
    return pa.StructArray.from_arrays([n_words, chars, symbols, pa.array(dup, pa.int64()), repeat, pa.array(kept, pa.int64())], fields=list(_FIELDS))


def _clean(text: pa.Array) -> pa.Array:
    return pa.array([clean_lines(t.as_py())[0] for t in text], pa.string())


def clean_text(text) -> F.Column:
    """The text without its failing lines."""
    return arrow_udf(_clean, "string")(F.coalesce(text, F.lit("")))


def judge(docs: DataFrame, *, text_col="text", max_loss=MAX_LOSS) -> DataFrame:
    """``docs`` with struct ``_quality``: the counts, ``base_failed`` and ``kept``."""
    m = arrow_udf(_measure, _DDL)(F.coalesce(F.col(text_col), F.lit("")))
    base = (F.col("_quality.n_words") < MIN_WORDS) | (100 * F.col("_quality.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_quality.n_words"))
    lost = F.col("_quality.n_words") - F.col("_quality.n_kept_words")
    return docs.withColumn("_quality", m).withColumn(
        "_quality", F.col("_quality").withField("base_failed", base).withField("kept", ~base & (lost <= max_loss * F.col("_quality.n_words"))))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs).select("doc_id", *(F.col(f"_quality.{c}").alias(c) for c in names))


def _oracle() -> str:
    quoted = lambda xs: ", ".join("'" + x + "'" for x in xs)
    notices = " OR ".join(f"contains(low, '{p}')" for p in NOTICES)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
v AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS win FROM g),
r AS (SELECT doc_id, win FROM v GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM v JOIN r USING (doc_id, win)) GROUP BY doc_id),
p AS (SELECT doc_id, string_split(x, chr(10)) AS ls FROM w),
l0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM p),
l1 AS (
  SELECT doc_id, line, no, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l0
), l2 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY no) > 1 AS again, lower(body) AS low FROM l1 WHERE n > 0
), l3 AS (
  SELECT *, (n >= 3 AND (5 * len(regexp_extract_all(body, '[#*$%&|<>]')) > 2 * n OR 10 * len(regexp_extract_all(body, '!{{2,}}|[?]{{3,}}')) > 3 * n))
    OR 4 * len(regexp_extract_all(body, ' [|»›>·•/] ')) > n
    OR (n >= 40 AND NOT regexp_matches(body, '[.!?…。！？]["''”»)\]]*(\s|$)') AND len(regexp_extract_all(body, ',')) * 40 < n)
    OR (n <= 25 AND (trim(low, ' .:>»|') IN ({quoted(MENUS)}) OR {notices})) AS fails FROM l2
), k AS (SELECT doc_id, sum(again::INT) AS dup, coalesce(sum(n) FILTER (NOT again AND NOT fails), 0) AS kept FROM l3 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(k.kept, 0) AS kept_words
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_words - kept_words <= {MAX_LOSS} * n_words AS kept
FROM m
"""


ORACLE = _oracle()
