"""Shuffling very many small entries as packed blocks.

An entry is a 64-bit hash and a payload.  Making each a row would cost Spark
some 40 bytes and a codegen round trip apiece; here an Arrow task packs its
entries into one binary row per bucket (bucket = hash modulo ``buckets``),
Spark shuffles and sorts the rows by bucket, and a task gets one bucket's
rows at a time.  The number of buckets follows from the number of entries,
so a bucket stays at about ``ENTRIES`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ENTRIES = 1 << 21


def buckets_for(entries: int, each: int = ENTRIES) -> int:
    return max(1, -(-int(entries) // each))


def split(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the entries by bucket, the buckets that occur, their bounds in that order."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    have, first = np.unique(bucket[order], return_index=True)
    return order, have, np.append(first, len(order))


def by_bucket(rows: DataFrame, buckets: int, *order: str) -> DataFrame:
    """Rows (``_bucket``, ...) dealt and sorted so that a task sees bucket after bucket."""
    parts = max(1, min(buckets, 20_000))
    return rows.repartition(parts, "_bucket").sortWithinPartitions("_bucket", *order)


def per_bucket(work: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]]) -> Callable:
    """An Arrow task that calls ``work`` with the rows of one bucket after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(batch.num_rows) for row in (_row(batch, i),))
        row = next(rows, None)
        while row is not None:
            bucket, ahead = row["_bucket"], [row]

            def mine() -> Iterator[dict]:
                while ahead and ahead[0] is not None and ahead[0]["_bucket"] == bucket:
                    now = ahead.pop()
                    ahead.append(next(rows, None))
                    yield now

            it = mine()
            yield from work(it)
            for _ in it:  # what the work left unread
                pass
            row = ahead[0]

    return run


def _row(batch: pa.RecordBatch, i: int) -> dict:
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        value = column[i]
        out[name] = value.as_buffer() if pa.types.is_binary(column.type) and value.is_valid else value.as_py()
    return out
