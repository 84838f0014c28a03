"""Packing: order-preserving dynamic programming over window cuts.

Each partition's documents, in the order the scan gives them, form one token
stream.  Windows of at most ``seq_len`` tokens are cut from it; a cut may
fall after a document (free), after a sentence (penalty ``SENTENCE``) or, in
runs of text without a sentence end, after every ``STRIDE`` tokens (penalty
``INSIDE``).  With K(j) = padding up to cut j plus its position, the
recurrence is K(j) = min K(i) + seq_len + penalty(j) over the cuts i within
``seq_len`` tokens before j: a sliding-window minimum, kept in a monotone
queue, so the whole optimisation is linear in the number of cuts.

No shuffle: a partition is packed where it is read, in document order, and
its last window may be short (less than one window of padding a partition).
Memory: tokens are held for one chunk of about ``CHUNK`` tokens; the best
path of a chunk is emitted but for its last window, which is carried over.
A task that runs again over the same split gives the same windows.

Defined results: null text is empty; a document always ends with id 1, so
an empty one has one token; repeated rows are packed once each; an empty
table gives no piece; the vocabulary file is a parameter and must be present
on every machine.  Token ids are those of the byte-level BPE file; they are
computed through ``tiktoken`` from the ranks file of the same vocabulary
(four times faster, equal ids; tests compare it with ``tokenizers``).
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQ_LEN = 2048
END_ID = 1
SENTENCE, INSIDE = 24, 64
STRIDE = 64
CHUNK = 1 << 19

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>")

_encoders: dict[str, tuple] = {}


def encoder(ranks_file: str):
    """(encode text to uint32 ids, table of ids that end a sentence), per process."""
    if ranks_file not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": 50256}
        e = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        ends = np.zeros(max(max(ranks.values()), 50256) + 1, bool)
        for piece, i in ranks.items():
            ends[i] = b"\n" in piece or piece.rstrip(b"\"')]") [-1:] in (b".", b"!", b"?")
        _encoders[ranks_file] = (lambda text: e.encode_to_numpy(text, allowed_special="all"), ends)
    return _encoders[ranks_file]


def cut_points(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in 1..len(ids) where a window may end, and their penalties."""
    n = len(ids)
    marks = np.flatnonzero(ends[ids[:-1]]) + 1 if n > 1 else np.zeros(0, np.int64)
    bounds = np.concatenate(([0], marks, [n]))
    gaps = np.diff(bounds)
    if gaps.max(initial=0) <= STRIDE:
        at, cost = bounds[1:], np.full(len(bounds) - 1, SENTENCE)
    else:
        steps = np.arange(STRIDE, n, STRIDE)
        lone = steps[steps - bounds[np.searchsorted(bounds, steps, "right") - 1] >= STRIDE // 2]
        lone = lone[~np.isin(lone, bounds)]
        at = np.concatenate((bounds[1:], lone))
        cost = np.concatenate((np.full(len(bounds) - 1, SENTENCE), np.full(len(lone), INSIDE)))
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    cost[-1] = 0
    return at, cost


def best_cuts(positions: list[int], penalties: list[int], seq_len: int = SEQ_LEN) -> list[int]:
    """Cut positions (from 0, ascending, the last included) of least padding
    plus penalty.  Consecutive positions differ by at most ``seq_len``."""
    key, place, index = deque([0]), deque([0]), deque([-1])
    back = [0] * len(positions)
    for j, p in enumerate(positions):
        while place[0] < p - seq_len:
            key.popleft()
            place.popleft()
            index.popleft()
        back[j] = index[0]
        k = key[0] + seq_len + penalties[j]
        while key and key[-1] >= k:
            key.pop()
            place.pop()
            index.pop()
        key.append(k)
        place.append(p)
        index.append(j)
    path, j = [], len(positions) - 1
    while j >= 0:
        path.append(positions[j])
        j = back[j]
    return path[::-1]


class Packer:
    """Feeds documents into chunks, optimises a chunk, emits its pieces."""

    def __init__(self, first_sequence: int, seq_len: int, keep_ids: bool):
        self.sequence, self.seq_len, self.keep_ids = first_sequence, seq_len, keep_ids
        self.docs: list[list] = []  # [id, ids, tokens already emitted, cut positions, penalties]
        self.size = 0

    def add(self, ident, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        at, cost = cut_points(ids, ends)
        self.docs.append([ident, ids, 0, at, cost])
        self.size += len(ids)
        if self.size >= CHUNK:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        positions, penalties, base = [], [], 0
        for _, ids, done, at, cost in self.docs:
            positions.append(at + (base - done))
            penalties.append(cost)
            base += len(ids) - done
        cuts = best_cuts(np.concatenate(positions).tolist(), np.concatenate(penalties).tolist(), self.seq_len)
        if not last and len(cuts) > 1:
            cuts.pop()  # the last window may still grow
        base = begin = 0
        todo = iter(cuts)
        cut = next(todo)
        rest = []
        for n, (ident, ids, done, at, cost) in enumerate(self.docs):
            end = base + len(ids) - done
            while cut is not None and base < end:
                stop = min(cut, end)
                piece = ids[done:done + stop - base]
                yield (ident, done, len(piece), zlib.crc32(piece.astype("<u4", copy=False).data), len(ids), self.sequence, base - begin,
                       piece if self.keep_ids else None)
                done += stop - base
                base = stop
                if base == cut:
                    self.sequence += 1
                    begin, cut = cut, next(todo, None)
            if base < end:
                later = at > done
                rest.append([ident, ids, done, at[later], cost[later]])
                base = end
        self.docs = rest
        self.size = sum(len(d[1]) - d[2] for d in rest)


def packer(ranks_file: str, seq_len: int, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, ends = encoder(ranks_file)
        pack = Packer(TaskContext.get().partitionId() << 40, seq_len, keep_ids)
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*held))
            held.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[7], pa.list_(pa.int32()))], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                tokens = np.append(encode(text.as_py()), np.uint32(END_ID))
                held.extend(pack.add(ids[i], tokens, ends))
                if len(held) >= 20000 or (keep_ids and len(held) >= 512):
                    yield out()
        held.extend(pack.flush(True))
        if held:
            yield out()

    return run


def pack(docs: DataFrame, *, ranks_file: str, id_col="doc_id", text_col="text", seq_len=SEQ_LEN, keep_ids=True) -> DataFrame:
    """One row per piece; ``ids`` holds its token ids (null unless ``keep_ids``)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(packer(ranks_file, seq_len, keep_ids), SCHEMA)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, ranks_file=str(vocabulary()), keep_ids=False).drop("ids")
