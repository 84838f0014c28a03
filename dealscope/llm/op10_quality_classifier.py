r"""Quality classifier: random-indexing word vectors, pooled per document,
then a two-layer numpy network with temperature-calibrated probabilities.

A word is hashed to one of ``WORDS`` buckets and to one of ``SHAPES`` shape
classes (case, symbols, end punctuation, repeats of the word before).  Every
bucket has a sparse ternary index vector.  A word's vector is the sum of the
index vectors of its neighbours over the training sample (integers, so the
sum does not depend on task order), scaled to length one.  A document is the
mean of its word vectors, the mean of its shape vectors and its length.

Fitting takes at most ``MAX_TRAIN`` labelled rows (those with the smallest
hash of their id; a documented bound), never rows of the held-out fold.  The
word vectors and the pooled rows are made by executors; the driver gets a
bucket-by-dimension table and ``MAX_TRAIN`` short rows, trains the network,
fits the temperature on a fifth of them and ships the weights (about 1 MB).
Scoring is one Arrow UDF over every whole text, in bounded blocks; nothing
is shuffled.

Defined results: null and empty text give zero vectors and still a score;
rows without a usable label or id are no training rows; a null id counts as
the empty string for the fold; repeated rows score alike; without any
training row every score is 0.5; an empty table gives an empty result;
label, language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from dealscope.llm import text as T
from dealscope.llm.rows import held, released

WORDS, SHAPES, DIM, NONZERO = 4096, 1024, 32, 4
MAX_TRAIN = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
THRESHOLD = 0.3
SEED = 11

_FLAGS = np.zeros((6, 256), np.int32)
_FLAGS[0, 65:91] = 1  # A-Z
_FLAGS[1, 97:123] = 1  # a-z
_FLAGS[2, list(b"#*$%&|<>=~^_{}\\")] = 1
_FLAGS[3, list(b"!?")] = 1
_FLAGS[4, 48:58] = 1
_FLAGS[5, list(b",;:")] = 1


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: ``NONZERO`` entries of +-1 in ``DIM``."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.int8)
    place = rng.permuted(np.tile(np.arange(DIM), (n, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.int8), place.shape), axis=1)
    return out


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, shape class and row of every word of a block."""
    starts, ends, rows = T.words(data, off)
    if not len(starts):
        return starts, starts, rows
    h = T.span_hash(T.lower(data), starts, ends)
    n = (ends - starts).astype(np.int32)
    c = [np.add.reduceat(np.append(f[data], np.int32(0)), np.column_stack((starts, ends)).ravel())[::2] for f in _FLAGS]
    upper, lower, symbol, loud, digit, comma = c
    first, last = data[starts], data[ends - 1]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    shape = (
        (upper > 0).astype(np.int64) + 2 * (lower > 0) + 4 * ((symbol > 0) & (n > symbol)) + 8 * (symbol == n)
        + 16 * (loud > 1) + 32 * (digit > 0) + 64 * same + 128 * (last == 46) + 256 * ((upper > 1) & (lower == 0)) + 512 * (comma > 0)
    )
    return (h % np.uint64(WORDS)).astype(np.int64), shape, rows


def context_sums(blocks: Iterator[tuple], index: np.ndarray) -> np.ndarray:
    """Per word bucket, the sum of its neighbours' index vectors (two each side)."""
    out = np.zeros((WORDS, DIM), np.int64)
    for _, data, off in blocks:
        bucket, _, rows = tokens(data, off)
        for gap in (1, 2):
            if len(bucket) > gap:
                near = rows[gap:] == rows[:-gap]
                a, b = bucket[:-gap][near], bucket[gap:][near]
                at, k = np.unique(a * WORDS + b, return_counts=True)
                left, right, k = at // WORDS, at % WORDS, k[:, None]
                np.add.at(out, left, k * index[right])
                np.add.at(out, right, k * index[left])
    return out


class Pooler:
    """Turns a block of texts into document vectors."""

    def __init__(self, sums: np.ndarray):
        length = np.sqrt((sums.astype(np.float64) ** 2).sum(1, keepdims=True))
        self.word = (sums / np.maximum(length, 1)).astype(np.float32)
        self.shape = index_vectors(SHAPES, SEED + 1).astype(np.float32)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        bucket, shape, rows = tokens(data, off)
        out = np.zeros((n, 2 * DIM + 1), np.float32)
        count = T.per_row(rows, n)
        has = count > 0
        if len(rows):
            first = np.searchsorted(rows, np.flatnonzero(has))
            mean = count[has][:, None]
            out[has, :DIM] = np.add.reduceat(self.word[bucket], first) / mean
            shapes = np.bincount(rows * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
            out[:, DIM:2 * DIM] = (shapes.astype(np.float32) @ self.shape) / np.maximum(count, 1)[:, None]
        out[:, -1] = np.log1p(count)
        return out


class Network:
    """Two layers (tanh, logistic), Adam on cross-entropy, then a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        x, y = x.astype(np.float64), y.astype(np.float64)
        self.ready = len(y) > 0
        if not self.ready:
            return
        rng = np.random.default_rng(SEED + 2)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        cal, fit = (order[: len(y) // 5], order[len(y) // 5:]) if len(y) >= 50 else (order, order)
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            perm = rng.permutation(fit)
            for lo in range(0, len(perm), BATCH):
                rows = perm[lo:lo + BATCH]
                hidden = np.tanh(x[rows] @ w[0] + w[1])
                d = (self._logistic(hidden @ w[2] + w[3]) - y[rows]) / len(rows)
                back = np.outer(d, w[2]) * (1 - hidden ** 2)
                grads = [x[rows].T @ back + DECAY * w[0], back.sum(0), hidden.T @ d + DECAY * w[2], d.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        logit, target = self._logit(x[cal]), y[cal]
        loss = [(np.mean(np.logaddexp(0, logit / t) - target * logit / t), t) for t in np.geomspace(0.25, 8, 61)]
        self.temperature = float(min(loss)[1])

    @staticmethod
    def _logistic(z):
        return 0.5 * (1 + np.tanh(z / 2))

    def _logit(self, x):
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        return self._logistic(self._logit((x - self.mean) / self.scale) / self.temperature)


def fold(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", max_train=MAX_TRAIN):
    """(pooler, network) from at most ``max_train`` labelled rows outside the held-out fold."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    usable = usable.filter(fold(F.col("_id")) != 0).groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(max_train)  # at most max_train rows: broadcast below is bounded
    sample = docs.select(F.col(id_col).alias("_did"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(
        F.broadcast(chosen), F.col("_did") == F.col("_id")).select("_id", "_y", "_text")
    index = index_vectors(WORDS, SEED)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORDS, DIM), np.int64)
        for batch in batches:
            total += context_sums(T.blocks(batch.column(2), 1 << 18), index)
        at = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, i]) for i in range(DIM))], names=["b", *(f"v{i}" for i in range(DIM))])

    parts = sample.mapInArrow(sums, "b int, " + ", ".join(f"v{i} bigint" for i in range(DIM)))
    table = parts.groupBy("b").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM))).toArrow()
    total = np.zeros((WORDS, DIM), np.int64)
    if table.num_rows:
        total[table["b"].to_numpy()] = np.column_stack([table[f"v{i}"].to_numpy() for i in range(DIM)])
    pool = Pooler(total)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pool(data, off) for _, data, off in T.blocks(batch.column(2))]
            flat = [r.tobytes() for block in x for r in block]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.binary())], names=["_id", "_y", "_x"])

    schema = f"_id {dict(sample.dtypes)['_id']}, _y int, _x binary"
    rows = sorted((r["_id"], r["_y"], bytes(r["_x"])) for r in sample.mapInArrow(vectors, schema).collect())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), 2 * DIM + 1)
    return pool, Network(x, np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model, *, text_col="text") -> DataFrame:
    """``docs`` with ``_score`` (probability of label 1)."""
    pool, network = model

    @arrow_udf("double")
    def predict(text: pa.Array) -> pa.Array:
        parts = [network(pool(data, off).astype(np.float64)) for _, data, off in T.blocks(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn("_score", predict(F.coalesce(F.col(text_col), F.lit(""))))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold=THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold; columns as they are."""
    rows = held(docs, _words=F.col("text"))
    return released(score(rows, fit(docs, labels), text_col="_words").filter(F.col("_score") >= threshold))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
