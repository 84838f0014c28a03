"""Hot keys: one sector / one duplicated row holding a third of all rows.

Results must stay whole and exact (checked against a brute-force pandas
computation), and the plans must pre-aggregate before shuffling.
"""


import pandas as pd
from pyspark.sql import functions as F

from dealscope.operators import clean, quality, sales
from dealscope.session import checkpoint_dir


def _skewed_raw_deals(spark, n=30000):
    ids = spark.range(n)
    hot = F.col("id") % 3 == 0  # a third of all deals share one sector
    sector = F.when(hot, F.lit("mining")).otherwise(F.concat(F.lit("sector "), (F.col("id") % 50).cast("string")))
    return ids.select(
        F.col("id").cast("string").alias("Deal Name"),
        F.when(F.col("id") % 5 == 0, F.lit("Won")).otherwise(F.lit("open")).alias("Deal Status"),
        (F.col("id") % 1000).cast("string").alias("Masked Deal value"),
        F.lit("High").alias("Closure Probability"),
        sector.alias("Sector/service"),
    )


def test_hot_sector_exact(spark):
    raw = _skewed_raw_deals(spark)
    deals = clean.clean_deals(raw)
    got = {r["sector"]: (r["deals"], r["pipeline"]) for r in sales.pipeline_by_sector(deals).collect()}
    pdf = raw.toPandas()
    pdf = pdf[pdf["Deal Status"] == "open"]
    pdf["sector"] = pdf["Sector/service"].str.strip().map(lambda s: "Mining" if s == "mining" else s.title())
    exp = pdf.groupby("sector").agg(deals=("Deal Name", "size"),
                                    pipeline=("Masked Deal value", lambda v: v.astype(int).sum()))
    assert len(got) == len(exp) == 41  # sectors whose deals are all Won drop out
    for sector, row in exp.iterrows():
        assert got[sector] == (row["deals"], float(int(row["pipeline"])))
    plan = sales.pipeline_by_sector(deals)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_sum" in plan


def test_hot_duplicate_row_exact(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.lit(None)).alias("v"))
    got = quality.duplicate_rows(df, "x").first()
    pdf = df.toPandas()
    assert got["rows"] == n
    assert got["duplicate_rows"] == int(pdf.duplicated().sum()) == n // 3 - 1


def test_checkpoint_dir_keeps_existing_directory(spark, tmp_path):
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(str(tmp_path / "shared"))
    existing = sc.getCheckpointDir()
    assert checkpoint_dir(spark) == existing


def _brute_dups(pdf):
    return int(pdf.astype(object).where(pdf.notna(), "<null>").duplicated().sum())


def test_duplicates_null_positions_and_signed_zero(spark):
    df = spark.createDataFrame(
        [("a", None, 0.0), (None, "a", 0.0), ("a", None, -0.0), (None, None, float("nan")),
         (None, None, float("nan")), ("b", "b", None), ("b", "b", None)],
        "x string, y string, z double")
    got = quality.duplicate_rows(df, "x").first()
    # (a,null,0.0) = (a,null,-0.0) as grouping compares them; NaN rows equal; (a,null) != (null,a)
    assert (got["rows"], got["duplicate_rows"]) == (7, 3)


def test_duplicates_exact_under_total_fingerprint_collision(spark, monkeypatch):
    # Every row gets the same fingerprint: phase 2 must still count exactly.
    monkeypatch.setattr(quality, "_fingerprint", lambda vals: (F.lit(7).cast("bigint"), F.lit(7).cast("bigint")))
    df = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.lit("v").alias("v"))
    got = quality.duplicate_rows(df, "x").first()
    assert (got["rows"], got["duplicate_rows"]) == (3000, 2000)


def test_many_duplicate_groups(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("k"),
                                  F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit("v")).alias("v"))
    got = quality.duplicate_rows(df, "x").first()
    assert (got["rows"], got["duplicate_rows"]) == (5000, 5000 - 700)  # 700 even: k fixes v
    assert got["duplicate_rows"] == _brute_dups(df.toPandas())


def test_quality_report_counts_match_brute_force(spark):
    df = spark.range(4000).select(
        (F.col("id") % 1500).alias("k"),
        F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise((F.col("id") % 1500).cast("string")).alias("s"),
        F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5)).alias("d"))
    rep = quality.quality_report(df, df.limit(0)).collect()
    pdf = df.toPandas()
    by = {r["dataset"]: r for r in rep}
    assert by["Deals"]["rows"] == 4000
    assert by["Deals"]["duplicate_rows"] == _brute_dups(pdf)
    assert any(i.startswith("s: 1000 missing (25.0%)") for i in by["Deals"]["issues"])
    assert any(i.startswith("d: 445 missing (11.1%)") for i in by["Deals"]["issues"])
    assert by["Work Orders"]["rows"] == 0


def test_hot_sector_answer_grid_exact(spark):
    from dealscope.operators import answers

    deals = clean.clean_deals(_skewed_raw_deals(spark))
    grid = {(r["grid_sector"], r["grid_period"]): r.asDict()
            for r in answers.pipeline_summary_grid(deals).collect()}
    for s in (None, "Mining", "Tender"):
        exp = sales.pipeline_summary(deals, s, None).first().asDict()
        assert {k: grid[(s, None)][k] for k in exp} == exp
    assert grid[("Mining", None)]["open_deals"] == 8000  # the hot third, less its Won rows


def _jobs(spark, build):
    """How many jobs ``build`` starts, and its result."""
    sc = spark.sparkContext
    group = f"jobs-{id(build)}"
    sc.setJobGroup(group, "count of jobs")
    try:
        out = build()
        return len(sc.statusTracker().getJobIdsForGroup(group)), out
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_quality_runs_no_job_while_it_is_built(spark):
    df = spark.range(1000).select((F.col("id") % 400).alias("k"), F.lit(None).cast("string").alias("v"))
    jobs, rep = _jobs(spark, lambda: quality.quality_report(df, df.limit(0)))
    assert jobs == 0
    jobs, dups = _jobs(spark, lambda: quality.duplicate_rows(df, "x"))
    assert jobs == 0
    assert dups.first()["duplicate_rows"] == 600
    assert {r["dataset"]: r["duplicate_rows"] for r in rep.collect()} == {"Deals": 600, "Work Orders": 0}


def test_duplicates_exact_when_the_table_of_repeats_is_full(spark, monkeypatch):
    # 64 bits for 2,000 repeated fingerprints: every row is taken, the exact grouping decides.
    monkeypatch.setattr(quality, "REPEAT_BITS", 6)
    df = spark.range(9000).select(F.when(F.col("id") < 4000, F.col("id") % 2000).otherwise(F.col("id")).alias("k"))
    assert quality.duplicate_rows(df, "x").first()["duplicate_rows"] == 2000


def test_only_rows_that_may_repeat_are_grouped_in_full(spark):
    df = spark.range(20000).select(F.when(F.col("id") < 10, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    groups, _ = quality._fingerprint_groups(df, ["k"])
    bits = df.sparkSession.range(1).select(quality._repeat_table(groups).alias("bits")).first()["bits"]
    assert len(bits) == 1 << (quality.REPEAT_BITS - 6)
    assert sum(bin(b & (2 ** 64 - 1)).count("1") for b in bits) == 1


def test_line_items_are_joined_once_at_scale(spark):
    """Orders take their customer first, so line items are never shuffled by the customer key."""
    from dealscope.plans import catalog
    from tests.conftest import SF_SMOKE

    plan = catalog.raw_work_orders(spark, SF_SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert len(joins) == 2 and "l_orderkey" in joins[0] and "o_custkey" in joins[1]
