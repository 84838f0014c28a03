"""Carrying whole rows through an operator without name clashes, and tables between its steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.session import materialize_table


def held(docs: DataFrame, **columns: Column) -> DataFrame:
    """``_row`` (a struct of all columns of ``docs``) beside the named columns."""
    names = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*names).alias("_row"), *(c.alias(n) for n, c in columns.items()))


def released(rows: DataFrame) -> DataFrame:
    """The rows that ``held`` took, with their own columns only."""
    return rows.select("_row.*")


#: While a table is written: its shuffle files go with its execution, and Arrow
#: batches of whole texts stay small (the default of 10,000 rows is held several
#: times over, in the JVM's buffers and in the Python worker).
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder; the shuffle files of
    its execution are removed once it is written."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            conf.set(k, v)
        return materialize_table(df)
    finally:
        for k, v in before.items():
            conf.set(k, v)


FILTER_BITS = 16  # per key, up to FILTER_BYTES in all
FILTER_BYTES = 64 << 20
_CHUNK = 1 << 15


class KeyFilter:
    """A bit table of the hashes of some keys, for telling rows without such a
    key from the others where they are scanned, ahead of any shuffle.

    It never misses a key; of other rows it takes one in ``FILTER_BITS``, more
    where the keys outgrow ``FILTER_BYTES``.  Its chunks of 4 kB are built by
    an aggregation and broadcast: at most ``FILTER_BYTES``, a proven bound."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.bits = min(8 * FILTER_BYTES, max(1, -(-n * FILTER_BITS // _CHUNK)) * _CHUNK)
        at = keys.select(self._at(*(F.col(c) for c in keys.columns)).alias("_at"))
        chunk = F.floor(F.col("_at") / _CHUNK)
        self.table = written(at.groupBy(chunk.alias("_chunk")).agg(F.bitmap_construct_agg(F.col("_at") % _CHUNK).alias("_bits")))

    def _at(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.bits))

    def mark(self, rows: DataFrame, *key: Column, name: str = "_may") -> DataFrame:
        """``rows`` with the boolean column ``name``: false only where the key is none of the keys."""
        kept = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]
        asked = rows.select("*", self._at(*key).alias("_filter_at"))
        j = asked.join(F.broadcast(self.table), F.floor(F.col("_filter_at") / _CHUNK) == F.col("_chunk"), "left")
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_filter_at") % _CHUNK / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.getbit(byte, (F.col("_filter_at") % 8).cast("int"))
        return j.select(*kept, F.coalesce(bit == 1, F.lit(False)).alias(name))
