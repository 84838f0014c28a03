"""Clean once, analyse many times: the typed boards as a partitioned table.

Cleaning is the bulk of every operator's work (dozens of text expressions
per row).  At scale the cleaned boards are written once as parquet,
partitioned by the compare form of the sector (X1) and, where asked, by the
month of a date column, and the operators read that table: each scan then
reads only the columns it needs, a sector filter (F3) or a period filter
(F4) becomes a partition filter, and null counts (Q1) come from the
footers alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X

WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"
WRITERS = 16  # files a task keeps open; what further partition values it meets is sorted
SECTOR_KEY = "sector_key"
MONTH_KEY = "month_of_"  # followed by the date column's name


def write_cleaned(df: DataFrame, path: str, mode: str = "overwrite",
                  max_records_per_file: int = 5_000_000, month_of: str | None = None) -> None:
    """Write a cleaned board partitioned by ``sector_key`` = X1(sector).

    With ``month_of`` (a date column) the first day of its month is a second
    partition column, ``month_of_<column>``.  Before writing, a rebalance on
    the partition columns gathers small partitions into few files; AQE
    splits a hot one by size, so a sector holding a third of all rows is not
    one task.  Without ``month_of`` each task writes one file per sector it
    holds, all open at once: Spark would sort its whole rows by the sector
    otherwise, which spills more than the board's size.  Files are capped at ``max_records_per_file`` rows.  Null and
    blank sectors, like null dates, share the default partition (read back
    as null); F3 and F4 never select them.  NaN is stored as null: Q1 counts
    both as missing.
    """
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    named = [F.col(f"`{c}`") for c in df.columns]
    out = df.select(*[F.nanvl(v, F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floats else v
                      for c, v in zip(df.columns, named)])
    keys = [SECTOR_KEY]
    out = out.withColumn(SECTOR_KEY, X.text_norm("sector") if "sector" in df.columns else F.lit(""))
    if month_of is not None:
        keys.append(MONTH_KEY + month_of)
        out = out.withColumn(keys[1], F.trunc(F.col(month_of).cast("date"), "month")).hint("rebalance", *keys)
    conf = df.sparkSession.conf
    before = conf.get(WRITERS_CONF)
    conf.set(WRITERS_CONF, str(max(int(before), WRITERS)))
    try:
        (out.write.mode(mode).option("maxRecordsPerFile", max_records_per_file).partitionBy(*keys).parquet(path))
    finally:
        conf.set(WRITERS_CONF, before)


def read_cleaned(spark: SparkSession, path: str, board: T.StructType | None = None) -> DataFrame:
    """Read a table written by ``write_cleaned``; ``sector_key`` stays text, a month key a date.

    Partition values are type-inferred by default (a sector named ``2024``
    would come back as a number), so the schema is read once from the
    footers and the keys' types declared.  A board that may be empty leaves
    no footers: its columns are given as ``board`` (the schema of the
    frame written without ``month_of``).
    """
    if board is not None:
        return spark.read.schema(T.StructType([*board.fields, T.StructField(SECTOR_KEY, T.StringType())])).parquet(path)
    inferred = spark.read.parquet(path).schema
    keys = {SECTOR_KEY: T.StringType()}
    keys.update({f.name: T.DateType() for f in inferred.fields if f.name.startswith(MONTH_KEY)})
    fields = [T.StructField(f.name, keys.get(f.name, f.dataType), True) for f in inferred.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def is_key(column: str) -> bool:
    """Whether a column of a stored board is a partition key, not a board column."""
    return column == SECTOR_KEY or column.startswith(MONTH_KEY)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that answers counts from Parquet footers.

    Aggregates are pushed down only into the version 2 Parquet source.
    """
    s = spark.newSession()
    s.conf.set("spark.sql.sources.useV1SourceList", "")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return s
