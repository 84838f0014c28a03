"""Clean once, analyse many times: the partitioned cleaned table."""

import tempfile

from pyspark.sql import functions as F

from dealscope.operators import operations, sales
from dealscope.operators.filters import sector_filter
from dealscope.plans import catalog
from dealscope.sources.cleaned import SECTOR_KEY, read_cleaned, write_cleaned
from tests.conftest import SF_SMOKE, rows


def _roundtrip(spark, df):
    path = tempfile.mkdtemp(prefix="dealscope-cleaned-") + "/t"
    write_cleaned(df, path)
    return read_cleaned(spark, path)


def test_sector_filter_prunes_partitions_and_matches(spark):
    wo = catalog.work_orders(spark, SF_SMOKE)
    stored = _roundtrip(spark, wo)
    assert dict(stored.dtypes)[SECTOR_KEY] == "string"
    a = sector_filter(stored, " MINING ").select("__item_id")
    b = sector_filter(wo, " MINING ").select("__item_id")
    assert sorted(rows(a)) == sorted(rows(b)) and a.count() > 0
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sector_key" in plan and "= mining" in plan
    # Operators give the same answers on the stored table.
    for fn in (lambda w: operations.work_order_summary(w, "mining"),
               lambda w: operations.financial_summary(w, "Dsp"),
               operations.work_orders_by_sector):
        assert sorted(rows(fn(stored))) == sorted(rows(fn(wo)))


def test_blank_and_null_sectors_survive(spark):
    deals = catalog.deals(spark, SF_SMOKE)
    stored = _roundtrip(spark, deals)
    cnt = lambda d: rows(d.agg(F.count_if(F.col("sector").isNull()), F.count_if(F.col("sector") == "")))
    assert cnt(stored) == cnt(deals)
    assert sorted(rows(sales.pipeline_by_sector(stored))) == sorted(rows(sales.pipeline_by_sector(deals)))
    ps = lambda d: rows(sales.pipeline_summary(d, "Mining").drop(SECTOR_KEY))
    assert ps(stored) == ps(deals)


def test_materialize_table_keeps_odd_headers_and_values(spark):
    from dealscope.session import materialize_table

    df = spark.createDataFrame([("a", None, -0.0), ("", "x", float("nan"))],
                               "`Amount (Incl. GST), Rs` string, `col;x` string, d double")
    back = materialize_table(df)
    assert back.columns == df.columns
    assert sorted(map(str, rows(back))) == sorted(map(str, rows(df)))


def test_numeric_looking_sector_stays_text(spark):
    df = spark.createDataFrame([("2024", 1), (" 2024 ", 2), ("007", 3), (None, 4)], "sector string, v int")
    stored = _roundtrip(spark, df)
    assert dict(stored.dtypes)[SECTOR_KEY] == "string"
    got = sorted(r["v"] for r in sector_filter(stored, "007").collect())
    assert got == [3]
    assert sorted(r["v"] for r in sector_filter(stored, "2024").collect()) == [1, 2]


def test_period_filter_reads_only_its_months(spark):
    from dealscope.operators.filters import period_filter

    deals = catalog.deals(spark, SF_SMOKE)
    path = tempfile.mkdtemp(prefix="dealscope-cleaned-") + "/t"
    write_cleaned(deals, path, month_of="tentative_close_date")
    stored = read_cleaned(spark, path)
    assert dict(stored.dtypes)["month_of_tentative_close_date"] == "date"
    for kind in ("quarter", "month", "year"):
        a, b = (period_filter(d, "tentative_close_date", f"this {kind}", catalog.AS_OF).select("__item_id")
                for d in (stored, deals))
        assert sorted(rows(a)) == sorted(rows(b)) and a.count() > 0
        plan = a._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(month_of_tentative_close_date" in plan
        read = a.select(F.input_file_name().alias("f")).distinct().count()
        assert read < stored.select(F.input_file_name().alias("f")).distinct().count() / 2
    assert stored.count() == deals.count()


def test_null_counts_come_from_the_footers(spark):
    from dealscope.operators.quality import missing_profile, missing_profile_stored

    df = spark.createDataFrame(
        [("a", None, float("nan"), None), ("", "x", 1.0, 2), (None, "y", None, 3)], "`sector` string, `b;c` string, d double, e int")
    path = tempfile.mkdtemp(prefix="dealscope-cleaned-") + "/t"
    write_cleaned(df, path)
    got = missing_profile_stored(spark, path, "T")
    assert sorted(rows(got)) == sorted(rows(missing_profile(df, "T")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(sector)" in plan
    # The counts of the scan are all that is read.
    assert "ReadSchema: struct<count(*):bigint" in plan
    empty = tempfile.mkdtemp(prefix="dealscope-cleaned-") + "/e"
    write_cleaned(df.limit(0), empty)
    assert [r["missing_pct"] for r in missing_profile_stored(spark, empty, "T", df.schema).collect()] == [0.0] * 4


def test_partitioned_write_does_not_sort_rows(spark):
    """Rows of many sectors go to open files as they come: a sort of whole rows spills at scale."""
    from dealscope.sources.cleaned import WRITERS, WRITERS_CONF

    plans, before = [], spark.conf.get(WRITERS_CONF)
    n = WRITERS * 2 + 1  # more sectors than open files: all are written
    df = spark.range(n * 3).selectExpr(f"concat('s', id % {n}) AS sector", "id").coalesce(1)
    path = tempfile.mkdtemp(prefix="dealscope-cleaned-") + "/t"
    write = type(df.write).parquet
    type(df.write).parquet = lambda w, p: plans.append(spark.conf.get(WRITERS_CONF)) or write(w, p)
    try:
        write_cleaned(df, path)
    finally:
        type(df.write).parquet = write
    assert plans == [str(WRITERS)] and spark.conf.get(WRITERS_CONF) == before
    back = read_cleaned(spark, path)
    assert back.count() == n * 3 and back.select(SECTOR_KEY).distinct().count() == n
    assert back.filter(F.col(SECTOR_KEY) != F.col("sector")).isEmpty()
