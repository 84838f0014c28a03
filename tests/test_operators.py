"""Operators on small literal boards: branches, empty inputs, invariants."""


import pytest

from dealscope.operators import briefing, clean, cross, leadership, operations, quality, routing, sales

DEAL_COLS = ("`Deal Name` string, `Deal Status` string, `Masked Deal value` string, "
             "`Closure Probability` string, `Sector/service` string, `Deal Stage` string, "
             "`Tentative Close Date` string")
DEALS = [
    ("A", " open ", "₹ 1,000", "High", "mining", "Proposal", "2001-05-10"),
    ("B", "On Hold", "2000", "70%", "Mining", "Proposal", "2001-04-02"),
    ("C", "ON  HOLD", "", "", "railway", "", "2001-02-01"),
    ("D", "Won", "9999", "low", "mining", "Won", "2001-05-01"),
    (" Deal Name ", "open", "5", "low", "mining", "x", "2001-05-01"),
    (None, "open", "n/a", "medium", None, "Negotiation", "TBD"),
    ("E", "open", "500", "0.5%", "", "Negotiation", "2000-12-31"),
]
WO_COLS = ("`Deal name masked` string, `Execution Status` string, `Sector` string, "
           "`Billed Value in Rupees (Incl. of GST.) (Masked)` string, "
           "`Collected Amount in Rupees (Incl. of GST.) (Masked)` string, "
           "`Amount to be billed in Rs. (Incl. of GST) (Masked)` string, `Amount Receivable (Masked)` string")
WOS = [
    ("W1", "Ongoing", "Mining", "100", "60", "10", "40"),
    ("W2", " completed", "mining", "200", "200", "0", "0"),
    ("W3", "Partial  Completed", "dsp", "300", "", "30", ""),
    ("W4", "", "", "400", "100", "40", "300"),
]


@pytest.fixture(scope="module")
def deals(spark):
    return clean.clean_deals(spark.createDataFrame(DEALS, DEAL_COLS)).cache()


@pytest.fixture(scope="module")
def wos(spark):
    return clean.clean_work_orders(spark.createDataFrame(WOS, WO_COLS)).cache()


def test_clean_deals_drops_header_keeps_null_name(deals):
    names = sorted((r[0] or "<null>") for r in deals.select("deal_name").collect())
    assert names == ["<null>", "A", "B", "C", "D", "E"]
    assert deals.schema["deal_value"].dataType.simpleString() == "double"
    assert "probability_numeric" in deals.columns


def test_pipeline_summary_all(deals):
    r = sales.pipeline_summary(deals).first().asDict()
    assert r["open_deals"] == 5
    assert r["gross_pipeline"] == float("3500.00")
    assert r["weighted_pipeline"] == float("2450.000000")  # '0.5%' reads as 0.5 (only > 1 is divided)
    assert r["deals_missing_value"] == 2
    assert r["deals_without_probability"] == 1
    assert r["unknown_sector_deals"] == 2
    assert r["top_sector_concentration_pct"] == round(3000 / 3500 * 100, 2)
    assert r["value_coverage_pct"] == 60.0 and r["probability_coverage_pct"] == 80.0
    assert r["period_warning"] is None and r["message"] is None


def test_pipeline_summary_sector_and_period(deals):
    r = sales.pipeline_summary(deals, "MINING", "this quarter", as_of="2001-05-15").first().asDict()
    assert (r["open_deals_before_filters"], r["after_sector_filter"], r["open_deals"]) == (5, 2, 2)
    assert r["top_sector_concentration_pct"] == 100.0
    assert r["period_warning"].startswith("Quarter filtering")
    r = sales.pipeline_summary(deals, None, "mtd", as_of="2001-05-15").first().asDict()
    assert r["open_deals"] == 1 and r["period_warning"] == sales.WARN_MONTH
    r = sales.pipeline_summary(deals, "Energy", None).first().asDict()
    assert r["open_deals"] == 0 and "exact sector 'Energy'" in r["message"]
    r = sales.pipeline_summary(deals, None, "last quarter", as_of="2001-05-15").first().asDict()
    assert r["open_deals"] == 2  # "last quarter" acts as this quarter


def test_pipeline_summary_degraded(spark, deals):
    r = sales.pipeline_summary(deals.drop("sector"), "Mining").first().asDict()
    assert r["message"] == sales.MSG_NO_SECTOR_COLUMN and r["open_deals"] == 0
    r = sales.pipeline_summary(deals.drop("deal_value")).first().asDict()
    assert r["message"] == sales.MSG_NO_VALUE_COLUMN and r["open_deals"] == 5
    r = sales.pipeline_summary(deals.drop("tentative_close_date"), None, "this quarter").first().asDict()
    assert r["period_warning"] == sales.WARN_QUARTER_MISSING and r["open_deals"] == 5
    r = sales.pipeline_summary(deals.limit(0)).first().asDict()
    assert r["open_deals"] == 0 and r["gross_pipeline"] == float("0.00")


def test_pipeline_by_sector_and_invariants(deals):
    rows = [r.asDict() for r in sales.pipeline_by_sector(deals).collect()]
    assert [r["sector"] for r in rows] == ["Mining", "Unknown / Unclassified", "Railways"]
    assert [r["deals"] for r in rows] == [2, 2, 1]
    gross = sales.pipeline_summary(deals).first()["gross_pipeline"]
    assert sum(r["pipeline"] for r in rows) == gross
    stages = sales.pipeline_by_stage(deals).collect()
    assert sum(r["pipeline"] for r in stages) == gross
    assert sales.pipeline_by_sector(deals.limit(0)).count() == 0
    no_sector = sales.pipeline_by_sector(deals.drop("sector")).collect()
    assert len(no_sector) == 1 and no_sector[0]["pipeline_share_pct"] is None


def test_work_orders(wos):
    s = operations.work_order_summary(wos).first().asDict()
    assert (s["total_work_orders"], s["active_work_orders"], s["completed_work_orders"]) == (4, 2, 1)
    assert s["active_share_pct"] == 50.0
    f = operations.financial_summary(wos).first().asDict()
    assert f["billed_value"] == float("1000.00") and f["collected_amount"] == float("360.00")
    assert f["collection_rate_pct"] == 36.0 and f["billing_backlog_ratio_pct"] == round(80 / 1080 * 100, 2)
    st = {r["status"]: r["work_orders"] for r in operations.status_breakdown(wos).collect()}
    assert st == {"Ongoing": 1, "Completed": 1, "Partial  Completed": 1, "Unknown / Unclassified": 1}
    ms = operations.work_order_summary(wos, "MINING").first()
    assert ms["total_work_orders"] == 2 and ms["sector"] == "MINING"


def test_cross_board_outer_and_totals(deals, wos):
    cb = [r.asDict() for r in cross.cross_board(deals, wos).collect()]
    by = {r["sector"]: r for r in cb}
    assert set(by) == {"Mining", "Railways", "Unknown / Unclassified", "Dsp"}
    assert by["Dsp"]["deals"] == 0 and by["Dsp"]["pipeline_display"] == "₹0"
    assert by["Railways"]["total_work_orders"] == 0
    assert sum(r["total_work_orders"] for r in cb) == 4
    assert sum(r["pipeline"] for r in cb) == float("3500.00")
    top = cross.top_backlog_sectors(deals, wos, 2).collect()
    assert [r["sector"] for r in top] == ["Unknown / Unclassified", "Dsp"]


def test_quality(spark, deals, wos):
    prof = {r["column_name"]: r for r in quality.missing_profile(deals, "Deals").collect()}
    assert prof["deal_value"]["missing"] == 2 and prof["deal_value"]["reported"]
    dup = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "k int, v string")
    assert quality.duplicate_rows(dup, "x").first()["duplicate_rows"] == 2
    rep = {r["dataset"]: r for r in quality.quality_report(deals, dup).collect()}
    assert "2 duplicate rows detected." in rep["Work Orders"]["issues"]
    empty = quality.quality_report(deals.limit(0), wos.limit(0)).collect()
    assert all(r["issues"] == [quality.EMPTY_ISSUE] and r["columns"] == 0 for r in empty)
    gaps = quality.known_gaps(deals).collect()
    assert [g["count"] for g in gaps] == [2, 1, 2]


def test_signals_radar_snapshot(spark, deals, wos):
    sig = [r.asDict() for r in leadership.leadership_signals(deals, wos).collect()]
    assert [s["type"] for s in sig] == ["pipeline_concentration", "receivables", "billing_backlog",
                                        "forecast_quality", "commercial_data_quality"]
    assert sig[0]["severity"] == "high" and sig[0]["sector"] == "Mining"
    radar = leadership.decision_radar(deals, wos).collect()
    assert [r["signal"] for r in radar][0] == "Pipeline concentration" and len(radar) == 4
    snaps = spark.createDataFrame(
        [("2001-01-01", float("100"), float("50"), 3, 2, float("10")),
         ("2001-02-01", float("40000000"), float("50"), 1, 2, float("5"))],
        "snapshot_date string, gross_pipeline double, weighted_pipeline double, "
        "open_deals long, active_work_orders long, receivable double")
    d = leadership.snapshot_delta(snaps).orderBy("snapshot_date").collect()
    assert d[0]["gross_pipeline_change"] is None
    assert d[1]["gross_pipeline_change_display"] == "+₹4.00 Cr"
    assert d[1]["open_deals_change_display"] == "−2"
    assert d[1]["weighted_pipeline_change_display"] == "₹0"
    assert d[1]["receivable_change_display"] == "−₹5"


def test_scenarios(deals, wos):
    sc = {r["sector"]: r for r in sales.scenario_remove_sector(deals).collect()}
    assert sc["Mining"]["is_largest"] and sc["Mining"]["scenario_pipeline"] == float("500.00")
    col = operations.scenario_collection(wos).collect()
    assert len(col) == 51
    default = [r for r in col if r["is_default"]]
    assert len(default) == 1 and default[0]["target_collection_pct"] == 50  # int(36.0) + 10 -> clamp 50
    t100 = [r for r in col if r["target_collection_pct"] == 100][0]
    assert t100["additional_cash"] == 640.0 and t100["current_gap"] == 640.0


QUESTIONS = [
    ("How is the Mining pipeline this quarter?", "pipeline_summary", "Mining", "this quarter"),
    ("Which sectors have both pipeline and operational pressure?", "work_order_summary", None, None),
    ("Which sectors have the largest execution workload?", "work_order_summary", None, None),
    ("Where is our biggest business risk?", "pipeline_summary", None, None),
    ("renewable energy collections", "financial_summary", "Energy", None),
    ("determining the pipeline", "pipeline_summary", "Mining", None),
    ("determining the funnel", "pipeline_by_stage", None, None),
    ("", "pipeline_summary", None, None),
    ("Compare sales pipeline with execution in mining", "cross_board", "Mining", None),
    ("Prepare a leadership update for mining this year", "leadership_update", None, None),
    ("What data quality issues should I know about?", "data_quality", None, None),
    ("Which sector is strongest? security and surveillance ytd", "pipeline_by_sector", None, None),
    ("pipeline for security and surveillance ytd", "pipeline_summary", "Security And Surveillance", "this year"),
    ("month to date pipeline", "pipeline_summary", None, "this month"),
]


def test_route_questions(spark):
    df = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUESTIONS)], "question_id int, question string")
    got = [(r["tool"], r["sector"], r["period"])
           for r in routing.route_questions(df).orderBy("question_id").collect()]
    assert got == [q[1:] for q in QUESTIONS]


def test_execute_tool_dispatch(deals, wos):
    assert routing.execute_tool("pipeline_by_stage", deals, wos).count() == 3
    bundle = routing.execute_tool("leadership_update", deals, wos)
    assert set(bundle) >= {"pipeline", "cross_board", "leadership_signals", "quality"}
    with pytest.raises(ValueError):
        routing.execute_tool("nope", deals, wos)


def test_narratives(deals, wos):
    lines = [r["line"] for r in routing.sector_narrative(sales.pipeline_by_sector(deals)).collect()]
    assert lines[0] == "- **Mining** — ₹3,000 across 2 deals (85.71% of pipeline)"
    cb = routing.cross_board_narrative(cross.cross_board(deals, wos)).collect()
    assert any("active WOs, billing backlog" in r["line"] for r in cb)


def test_leadership_update_reuse_checkpoints(deals, wos):
    plain = briefing.leadership_update(deals, wos)
    reused = briefing.leadership_update(deals, wos, reuse=True)
    assert set(plain) == set(reused)
    for k in ("pipeline", "cross_board", "leadership_signals"):
        assert sorted(map(tuple, plain[k].collect())) == sorted(map(tuple, reused[k].collect()))


def test_briefing_parts_equal_the_operators(spark, deals, wos):
    def same(got, want):
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    whole = (deals, wos)
    for d, w in (whole, (deals.limit(0), wos.limit(0)), (deals.drop("sector"), wos.drop("sector")),
                 (deals.drop("deal_value"), wos.drop("execution_status")),
                 (deals.drop("deal_stage", "probability_numeric"), wos)):
        parts = briefing.leadership_update(d, w)
        same(parts["pipeline"], sales.pipeline_summary(d))
        same(parts["top_sectors"], sales.top_sectors(d))
        same(parts["pipeline_stages"], sales.top_stages(d))
        same(parts["operations"], operations.work_order_summary(w))
        same(parts["status_breakdown"], operations.status_breakdown(w))
        same(parts["financials"], operations.financial_summary(w))
        same(parts["cross_board"], cross.cross_board(d, w))
        same(parts["top_billing_backlog_sectors"], cross.top_backlog_sectors(d, w))
        same(parts["top_execution_sectors"], cross.top_execution_sectors(d, w))
        same(parts["leadership_signals"], leadership.leadership_signals(d, w))


def test_bundle_scans_the_cells_only(deals, wos):
    out = briefing.leadership_bundle(deals, wos)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation [Deal" not in plan and "Relation [sector" in plan
    got = {(r["part"], r["position"], r["label"], r["metric"]): r["value"] for r in out.collect()}
    assert got[("top_sectors", 1, "Mining", "pipeline")] == 3000.0


def test_two_29_digit_amounts_in_every_summing_operator(spark):
    from dealscope.operators import answers, clean, cross, leadership, operations, sales

    big = "9" * 29
    raw_d = spark.createDataFrame([("1", "Deal 1", "open", big, "High", "Mining"), ("2", "Deal 2", "open", big, "50%", "Mining"), ("3", "Deal 3", "open", "0.000000000001", "1", "Energy")],
                                  "`__item_id` string, `Deal Name` string, `Deal Status` string, `Masked Deal value` string, `Closure Probability` string, `Sector/service` string")
    raw_w = spark.createDataFrame([("1", "Ongoing", "Mining", big), ("2", "Completed", "Mining", big)],
                                  "`__item_id` string, `Execution Status` string, Sector string, `Amount Receivable (Masked)` string")
    d, w = clean.clean_deals(raw_d), clean.clean_work_orders(raw_w)
    assert sales.pipeline_summary(d).first()["gross_pipeline"] == 2e29
    assert sales.pipeline_summary(d, "Energy").first()["gross_pipeline"] == 1e-12
    assert {r["sector"]: r["pipeline"] for r in sales.pipeline_by_sector(d).collect()} == {"Mining": 2e29, "Energy": 1e-12}
    assert {r["label"]: r["pipeline"] for r in leadership.leadership_deals_sets(d).collect() if r["grouping"] == "sector"} == {"Mining": 2e29, "Energy": 1e-12}
    assert {r["sector"]: r["scenario_pipeline"] for r in sales.scenario_remove_sector(d).collect()}["Energy"] == 2e29
    assert sales.sector_concentration(d).first()["gross_pipeline"] == 2e29
    if "amount_receivable" in w.columns:
        assert operations.financial_summary(w).first()["amount_receivable"] == 2e29
        assert leadership.kpi_snapshot(d, w).first()["receivable"] == 2e29
    assert leadership.kpi_snapshot(d, w).first()["gross_pipeline"] == 2e29
    assert cross.cross_board(d, w).first()["pipeline"] == 2e29
    grid = {(r["grid_sector"], r["grid_period"]): r["gross_pipeline"] for r in answers.pipeline_summary_grid(d).collect()}
    assert grid[None, None] == 2e29 and grid["Energy", None] == 1e-12


def _series(spark, keys, kind):
    def row(k):
        return (k, float(int(k) % 7), None if int(k) % 11 == 3 else 1.5 * (int(k) % 5), int(k) % 4, 1, 0.0)
    return spark.createDataFrame([row(k) if kind != "string" else (f"export-{k:09d}", *row(k)[1:]) for k in keys],
                                 f"k {kind}, gross_pipeline double, weighted_pipeline double, open_deals bigint, "
                                 "active_work_orders bigint, receivable double")


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("n, ranges", [(0, 4), (1, 4), (3, 8), (500, 1), (500, 7), (500, 600)])
def test_snapshot_changes_equal_one_window(spark, n, ranges, kind):
    df = _series(spark, [(i * 37) % 1009 for i in range(n)], kind).repartition(5)
    got = leadership.snapshot_changes(df, "k", ranges)
    want = leadership.snapshot_delta(df, "k")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_snapshot_changes_never_gather_the_series(spark):
    import re

    df = _series(spark, range(50), "bigint")
    plan = leadership.snapshot_changes(df, "k")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if re.search(r"\bWindow \[", line)]
    assert windows and not any(re.search(r"\], \[\], \[", line) for line in windows)
