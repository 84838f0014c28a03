r"""Ranked lexical search: norm buckets over impact vectors.

Every item (query) asks for the ``k`` documents of greatest integer score

    sum over the item's terms, repeats included, of  w * p,
    w = floor(1000 ln((2N+2)/(2df+1))),  p = (10^9 tf) div (1000 tf + 12 m)

A document is the vector of its impacts ``sqrt(w) p``, an item the vector of
``sqrt(w) * repeats``; their product is the score.  The work is done in
three passes that never shuffle a text or a vector:

1. terms: a task cuts each whole text into terms, and keeps those that some
   item of the block asks for, with their counts (a table in the shared
   folder).  N, L and the document frequencies are sums over that table.
2. lengths: the quantiles of the vectors' lengths are the bucket bounds.  The
   bucket of the longest vectors is searched first; its k-th best score per
   item is a threshold that every later task starts from.
3. all other buckets: a task orders its vectors by length and goes down the
   buckets.  By Cauchy-Schwarz no vector of a bucket beats
   ``|item| * longest``, so the items whose threshold lies above skip the
   bucket.  Inside a bucket the item's strongest coordinates are summed over
   their posting lists; what the other coordinates can add at most is bounded
   by the product of the remaining lengths and by the greatest impacts of the
   bucket.  Vectors whose bound reaches the threshold are scored again in
   64-bit integers, and the k best raise the threshold.

Bounds are widened by a relative ``SLACK``, so rounding never drops a
vector; what they let through is decided by the integers.  A task hands on
at most k rows an item; the last step ranks these per item.

Items are taken in blocks of at most ``BLOCK_TERMS`` term places (one larger
item makes a block of its own), the only thing that the driver and each task
hold of them; a block is one such run over all documents.

Defined results: null text has no terms; an item without a scoring document
gives no row; every row of ``documents`` and of the items stands for itself,
repeated rows and ids too; equal scores rank by id, null ids last; an empty
table gives no row; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealscope.llm.rows import written

K = 20
BLOCK_TERMS = 1 << 18
SLICE_BYTES = 1 << 20  # of a text that are cut into terms at once
HELD_POSTINGS = 1 << 22  # vectors ordered by length at once, in a task
CHUNK = 4096  # vectors of a bucket that are compared at once
BOUNDS = [0.99, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]  # quantiles of length between the buckets
SLACK = 1e-9

#: Term bytes: digits, letters and everything beyond ASCII; A-Z lower-cased, the rest becomes a space.
_TERM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

VECTORS = "_id bigint, _n bigint, _terms array<int>, _tfs array<int>"


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, some ``SLICE_BYTES`` of it at a time."""
    flat = text.translate(_TERM)
    lo = 0
    while lo < len(flat):
        hi = flat.find(b" ", lo + SLICE_BYTES)
        hi = len(flat) if hi < 0 else hi
        yield flat[lo:hi].split()
        lo = hi


def term_counts(text: bytes) -> tuple[int, Counter]:
    n, counts = 0, Counter()
    for terms in term_slices(text):
        n += len(terms)
        counts.update(terms)
    return n, counts


def to_vectors(vocabulary: dict[bytes, int]) -> Callable:
    """Arrow task: (_id, _text) -> one row a document with a term: its length, the vocabulary's terms in it, their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, ptr, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(batch.column(1)):
                n, counts = term_counts(text.as_buffer().to_pybytes())
                if n:
                    found = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                    keep.append(i)
                    sizes.append(n)
                    terms += [t for t, _ in found]
                    tfs += [c for _, c in found]
                    ptr.append(len(terms))
            offsets = pa.array(ptr, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))],
                names=["_id", "_n", "_terms", "_tfs"])

    return run


def term_frequencies(size: int) -> Callable:
    """Arrow task: (_terms) -> (_term, _df), summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat, minlength=size)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(total[have])], names=["_term", "_df"])

    return run


class Corpus:
    """What scores need besides a vector: N, L and the weight of every vocabulary term."""

    def __init__(self, n: int, total: int, df: np.ndarray):
        self.n, self.total = n, total
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        self.root = np.sqrt(self.weight.astype(np.float64))

    def impacts(self, sizes: np.ndarray, tfs: np.ndarray, per: np.ndarray) -> np.ndarray:
        """The integers p of all postings; ``per``: postings of each document."""
        m = 100 - 25 + (25 * sizes * self.n) // max(self.total, 1)
        return (1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, per))


class Vectors:
    """Some documents' vectors: ids, postings in document order, lengths."""

    def __init__(self, corpus: Corpus, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        sizes, terms, tfs = (table[c].chunk(0) for c in ("_n", "_terms", "_tfs"))
        ids = table["_id"].chunk(0)
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.per = np.diff(terms.offsets.to_numpy()).astype(np.int64)
        self.ptr = np.concatenate(([0], np.cumsum(self.per)))
        self.terms = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.p = corpus.impacts(sizes.to_numpy(), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), self.per)
        self.u = corpus.root[self.terms] * self.p
        self.squares = np.bincount(np.repeat(np.arange(len(self.per)), self.per), self.u * self.u, len(self.per))

    def postings(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of ``docs``, and which of them each belongs to."""
        per = self.per[docs]
        own = np.repeat(np.arange(len(docs)), per)
        return np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.ptr[docs], per), own


def held(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[Vectors]:
    """The task's vectors, at most about ``HELD_POSTINGS`` postings at a time."""
    have, n = [], 0
    for batch in batches:
        if batch.num_rows:
            have.append(batch)
            n += len(batch.column(2).flatten())
        if n >= HELD_POSTINGS:
            yield Vectors(corpus, have)
            have, n = [], 0
    if have:
        yield Vectors(corpus, have)


def lengths(corpus: Corpus) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in held(batches, corpus):
            yield pa.RecordBatch.from_arrays([pa.array(np.sqrt(v.squares))], names=["_length"])

    return run


class Best:
    """One item's k best (score, id) so far, and the score that a further one has to reach."""

    __slots__ = ("k", "floor", "scores", "ids", "null")

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(1, floor)
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        ok = scores >= self.floor
        if ok.any():
            s, i, z = (np.concatenate(x) for x in ((self.scores, scores[ok]), (self.ids, ids[ok]), (self.null, null[ok])))
            top = np.lexsort((i, -s))[:self.k]
            self.scores, self.ids, self.null = s[top], i[top], z[top]
            if len(top) == self.k:
                self.floor = max(self.floor, int(self.scores[-1]))


class Items:
    """A block's items: distinct terms, their weights and coordinates."""

    def __init__(self, items: list[tuple[list[int], list[int]]], corpus: Corpus):
        self.terms = [np.array(t, np.int64) for t, _ in items]
        self.whole = [np.array(c, np.int64) * corpus.weight[t] for t, (_, c) in zip(self.terms, items)]
        self.q = [np.array(c, np.float64) * corpus.root[t] for t, (_, c) in zip(self.terms, items)]
        self.length = np.array([math.sqrt(float((q * q).sum())) for q in self.q])


def search_chunk(v: Vectors, docs: np.ndarray, items: Items, alive: np.ndarray, best: list[Best], size: int) -> None:
    """Compares the vectors ``docs`` (of one bucket) with the items ``alive``."""
    at, own = v.postings(docs)
    by = np.argsort(v.terms[at], kind="stable")
    terms, posted, u = v.terms[at][by], own[by], v.u[at][by]
    have, first = np.unique(terms, return_index=True)
    lo, hi = np.zeros(size, np.int64), np.zeros(size, np.int64)
    lo[have], hi[have] = first, np.append(first[1:], len(terms))
    most = np.zeros(size)
    most[have] = np.maximum.reduceat(u, first) if len(first) else 0
    squares = v.squares[docs]
    weights = np.zeros(size, np.int64)
    for j in alive:
        t, q = items.terms[j], items.q[j]
        reach = q * most[t]
        floor = best[j].floor * (1 - SLACK)
        if reach.sum() < floor:
            continue
        order = np.argsort(-reach, kind="stable")
        order = order[reach[order] > 0]
        rest = reach[order].sum() - np.cumsum(reach[order])
        # the coordinates summed: at least those without which nothing reaches the threshold
        focus = order[:max(int(np.searchsorted(-rest, -floor / 4)) + 1, (len(order) + 1) // 2)]
        per = hi[t[focus]] - lo[t[focus]]
        place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(lo[t[focus]], per)
        which, value = posted[place], u[place]
        partial = np.bincount(which, value * np.repeat(q[focus], per), len(docs))
        left = np.maximum(squares - np.bincount(which, value * value, len(docs)), 0)
        other = math.sqrt(max(float((q * q).sum() - (q[focus] ** 2).sum()), 0) * (1 + SLACK))
        box = float(rest[len(focus) - 1]) if len(focus) else 0.0
        passed = np.flatnonzero((partial + np.minimum(other * np.sqrt(left * (1 + SLACK)), box)) * (1 + SLACK) >= floor)
        if len(passed):
            weights[t] = items.whole[j]
            places, row = v.postings(docs[passed])
            scores = np.zeros(len(passed), np.int64)
            np.add.at(scores, row, weights[v.terms[places]] * v.p[places])
            weights[t] = 0
            best[j].add(scores, v.ids[docs[passed]], v.null[docs[passed]])


def searcher(items: list, corpus: Corpus, floors: list[int], bounds: list[float], first: bool, k: int) -> Callable:
    """Arrow task: vectors -> (_item, _id, _score), the task's k best an item;
    ``first``: of the bucket of the longest vectors, else of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Items(items, corpus)
        best = [Best(k, f) for f in floors]
        for v in held(batches, corpus):
            length = np.sqrt(v.squares)
            bucket = np.searchsorted(-np.array(bounds), -length, "left")  # 0: longer than every bound
            order = np.argsort(-length, kind="stable")
            order = order[(bucket[order] == 0) == first]
            for b in np.unique(bucket[order]):
                mine = order[bucket[order] == b]
                for lo in range(0, len(mine), CHUNK):
                    docs = mine[lo:lo + CHUNK]
                    reach = wanted.length * float(length[docs[0]]) * (1 + SLACK)
                    alive = np.flatnonzero(reach >= np.array([x.floor for x in best]))
                    if not len(alive):
                        break
                    search_chunk(v, docs, wanted, alive, best, len(corpus.weight))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), [len(x.ids) for x in best]).astype(np.int32)),
             pa.array(np.concatenate([x.ids for x in best]), mask=np.concatenate([x.null for x in best])),
             pa.array(np.concatenate([x.scores for x in best]))],
            names=["_item", "_id", "_score"])

    return run


def item_blocks(items: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_TERMS) -> Iterator[list[tuple]]:
    """The items as (id, [(term, repeats)]), in blocks of at most ``limit`` distinct terms summed over items."""
    block, size = [], 0
    for ident, text in items.select(item_col, text_col).toLocalIterator():
        counts = sorted(term_counts((text or "").encode())[1].items())
        if block and size + len(counts) > limit:
            yield block
            block, size = [], 0
        block.append((ident, counts))
        size += len(counts)
    if block:
        yield block


TOP = "_item int, _id bigint, _score bigint"


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("_item").orderBy(F.col("_score").desc(), F.col("_id").asc_nulls_last())
    return rows.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)


def _search_block(spark: SparkSession, block: list[tuple], docs: DataFrame, k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in block for t, _ in counts}))}
    items = [([vocabulary[t] for t, _ in counts], [c for _, c in counts]) for _, counts in block]
    vectors = written(docs.mapInArrow(to_vectors(vocabulary), VECTORS))
    n, total = vectors.agg(F.count(F.lit(1)), F.sum("_n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    counted = vectors.select("_terms").mapInArrow(term_frequencies(len(vocabulary)), "_term int, _df bigint")
    for t, c in counted.groupBy("_term").agg(F.sum("_df")).collect():  # at most the block's vocabulary
        df[t] = c
    corpus = Corpus(n, total or 0, df)
    quantiles = vectors.mapInArrow(lengths(corpus), "_length double").agg(F.percentile_approx("_length", F.array(*map(F.lit, BOUNDS)))).first()[0]
    bounds = sorted(set(quantiles or [0.0]), reverse=True)
    none = [0] * len(items)
    longest = written(_ranked(vectors.mapInArrow(searcher(items, corpus, none, bounds, True, k), TOP), k))
    floors = list(none)
    for item, score in longest.filter(F.col("_rank") == k).select("_item", "_score").collect():  # at most one row an item
        floors[item] = score
    others = vectors.mapInArrow(searcher(items, corpus, floors, bounds, False, k), TOP)
    top = _ranked(longest.drop("_rank").unionByName(others), k)
    names = spark.createDataFrame([(i, ident) for i, (ident, _) in enumerate(block)], "_item int, item_id bigint")
    # the block's items, at most BLOCK_TERMS rows besides those without terms
    return top.join(names, "_item").select("item_id", F.col("_rank").alias("rank"), F.col("_id").alias("doc_id"), F.col("_score").alias("score"))


def search(items: DataFrame, docs: DataFrame, *, item_col="item_id", item_text="text", id_col="doc_id", text_col="text", k=K,
           block_terms=BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    asked = items.select(F.col(item_col).cast("bigint").alias("_i"), F.col(item_text).alias("_t"))
    for block in item_blocks(asked, "_i", "_t", block_terms):
        if any(counts for _, counts in block):
            out = out.unionByName(_search_block(spark, block, rows, k))
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(items, docs)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, nn),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), c AS (SELECT item_id, term, count(*)::BIGINT AS c FROM q GROUP BY ALL),
r AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM c JOIN w USING (term) JOIN tf USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20
"""
