"""The key filter never misses a key and takes few other rows."""

from dealscope.llm import rows as R
from pyspark.sql import functions as F


def test_filter(spark):
    keys = spark.range(0, 90_000, 3).select(F.col("id").alias("k"), (F.col("id") % 7).alias("j"))
    f = R.KeyFilter(keys)
    marked = f.mark(spark.range(90_000).withColumn("x.y", F.lit(1)), F.col("id"), F.col("id") % 7)
    assert marked.columns == ["id", "x.y", "_may"]
    got = marked.groupBy((F.col("id") % 3 == 0).alias("key"), "_may").count().collect()
    count = {(r["key"], r["_may"]): r["count"] for r in got}
    assert count[True, True] == 30_000 and (True, False) not in count
    assert 0 < count[False, True] < 60_000 / 8


def test_filter_of_nothing_and_beyond_its_bytes(spark, monkeypatch):
    none = R.KeyFilter(spark.range(0))
    assert none.mark(spark.range(5), F.col("id")).filter("_may").count() == 0
    monkeypatch.setattr(R, "FILTER_BYTES", 4096)
    small = R.KeyFilter(spark.range(100_000))
    assert small.bits == 1 << 15
    assert small.mark(spark.range(100_000), F.col("id")).filter("not _may").count() == 0


def test_null_keys(spark):
    f = R.KeyFilter(spark.createDataFrame([(None,), (4,)], "k bigint"))
    got = f.mark(spark.createDataFrame([(None,), (4,), (5,)], "id bigint"), F.col("id")).collect()
    assert [r["_may"] for r in got if r["id"] in (None, 4)] == [True, True]
