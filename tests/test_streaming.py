"""Refresh stream: two landed exports -> two KPI snapshots -> one delta."""

import json

from dealscope.streaming import refresh


def _page(export_id, ts, board_name, items):
    return {"export_id": export_id, "exported_at": ts, "board": board_name, "cursor": None, "items": items}


def _deal(i, status, value):
    return {"id": str(i), "name": f"D{i}", "created_at": "", "updated_at": "", "column_values": [
        {"id": "d1", "text": status, "value": None}, {"id": "d2", "text": value, "value": None},
        {"id": "d3", "text": "High", "value": None}, {"id": "d4", "text": "Mining", "value": None}]}


def _wo(i, status, receivable):
    return {"id": f"w{i}", "name": f"W{i}", "created_at": "", "updated_at": "", "column_values": [
        {"id": "w1", "text": status, "value": None}, {"id": "w2", "text": receivable, "value": None}]}


def test_refresh_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    e1 = [_page("e1", "2024-01-01T00:00:00", "deals", [_deal(1, "Open", "100"), _deal(2, "Won", "50")]),
          _page("e1", "2024-01-01T00:00:00", "work_orders", [_wo(1, "Ongoing", "10")])]
    e2 = [_page("e2", "2024-01-02T00:00:00", "deals", [_deal(1, "Open", "300"), _deal(3, "On Hold", "20")]),
          _page("e2", "2024-01-02T00:00:00", "work_orders", [_wo(1, "Completed", "4"), _wo(2, "Ongoing", "1")])]
    for n, p in enumerate(e1 + e2):
        (landing / f"p{n}.json").write_text(json.dumps(p) + "\n")
    dcols = spark.createDataFrame([("d1", "Deal Status", "status"), ("d2", "Masked Deal value", "text"),
                                   ("d3", "Closure Probability", "text"), ("d4", "Sector/service", "text")],
                                  "column_id string, title string, type string")
    wcols = spark.createDataFrame([("w1", "Execution Status", "status"), ("w2", "Amount Receivable (Masked)", "text")],
                                  "column_id string, title string, type string")
    snap_path = str(tmp_path / "snapshots")
    q = refresh.start_refresh(spark, str(landing), dcols, wcols, snap_path, str(tmp_path / "ckpt"),
                              available_now=True)
    q.awaitTermination(120)
    ch = {r["export_id"]: r.asDict() for r in refresh.snapshot_changes(spark, snap_path).collect()}
    assert ch["e1"]["open_deals"] == 1 and ch["e1"]["gross_pipeline"] == 100
    assert ch["e2"]["open_deals"] == 2 and ch["e2"]["open_deals_change"] == 1
    assert ch["e2"]["gross_pipeline_change_display"] == "+₹220"
    assert ch["e2"]["active_work_orders_change"] == 0
    assert ch["e2"]["receivable_change_display"] == "−₹5"


def test_snapshots_by_equals_kpi_snapshot_per_group(spark):
    from pyspark.sql import functions as F

    from dealscope.operators import leadership
    from dealscope.plans import catalog
    from tests.conftest import SF_SMOKE

    deals, wos = catalog.deals(spark, SF_SMOKE), catalog.work_orders(spark, SF_SMOKE)
    # Two groups per board, keyed by the parity of the client / customer code.
    g_d = deals.withColumn("g", (F.col("client_code").cast("bigint") % 2).cast("string"))
    g_w = wos.withColumn("g", (F.col("customer_code").cast("bigint") % 2).cast("string"))
    got = {r["g"]: r.asDict() for r in leadership.snapshots_by(g_d, g_w, ["g"]).collect()}
    assert set(got) == {"0", "1"}
    for g in ("0", "1"):
        exp = leadership.kpi_snapshot(g_d.filter(F.col("g") == g), g_w.filter(F.col("g") == g)).first().asDict()
        assert {k: got[g][k] for k in exp} == exp


def test_refresh_stream_exports_in_separate_batches(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    dcols = spark.createDataFrame([("d1", "Deal Status", "status"), ("d2", "Masked Deal value", "text"),
                                   ("d3", "Closure Probability", "text"), ("d4", "Sector/service", "text")],
                                  "column_id string, title string, type string")
    wcols = spark.createDataFrame([("w1", "Execution Status", "status"), ("w2", "Amount Receivable (Masked)", "text")],
                                  "column_id string, title string, type string")
    snap_path, ckpt = str(tmp_path / "snapshots"), str(tmp_path / "ckpt")

    def run():
        q = refresh.start_refresh(spark, str(landing), dcols, wcols, snap_path, ckpt, available_now=True)
        q.awaitTermination(120)

    (landing / "a.json").write_text(json.dumps(
        _page("e1", "2024-01-01T00:00:00", "deals", [_deal(1, "Open", "100")])) + "\n")
    run()
    # The second export arrives later: its batch must not overwrite the first export's partition.
    (landing / "b.json").write_text(json.dumps(
        _page("e2", "2024-01-02T00:00:00", "deals", [_deal(1, "Open", "150"), _deal(2, "Open", "5")])) + "\n")
    (landing / "c.json").write_text(json.dumps(
        _page("e2", "2024-01-02T00:00:00", "work_orders", [_wo(1, "Ongoing", "7")])) + "\n")
    run()
    ch = {r["export_id"]: r.asDict() for r in refresh.snapshot_changes(spark, snap_path).collect()}
    assert set(ch) == {"e1", "e2"}
    assert ch["e1"]["active_work_orders"] == 0 and ch["e1"]["receivable"] == 0
    assert ch["e2"]["open_deals_change"] == 1 and ch["e2"]["gross_pipeline_change_display"] == "+₹55"
    assert ch["e2"]["active_work_orders_change"] == 1


def test_one_export_over_several_batches_adds_up(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    dcols = spark.createDataFrame([("d1", "Deal Status", "status"), ("d2", "Masked Deal value", "text"),
                                   ("d3", "Closure Probability", "text"), ("d4", "Sector/service", "text")],
                                  "column_id string, title string, type string")
    wcols = spark.createDataFrame([("w1", "Execution Status", "status"), ("w2", "Amount Receivable (Masked)", "text")],
                                  "column_id string, title string, type string")
    snap_path, ckpt = str(tmp_path / "snapshots"), str(tmp_path / "ckpt")
    pages = {"a": [_deal(1, "Open", "100"), _deal(2, "Open", "200")], "b": [_deal(3, "Open", "5")]}
    for name, deals in pages.items():
        (landing / f"{name}.json").write_text(json.dumps(_page("e1", "2024-01-01T00:00:00", "deals", deals)) + "\n")
        refresh.start_refresh(spark, str(landing), dcols, wcols, snap_path, ckpt, available_now=True).awaitTermination(120)
    row = refresh.snapshots(spark, snap_path).first()
    assert row["open_deals"] == 3 and row["gross_pipeline"] == 305
    # a replay of the second batch rewrites its own part only
    for commit in (tmp_path / "ckpt" / "commits").glob("*1*"):
        commit.unlink()
    refresh.start_refresh(spark, str(landing), dcols, wcols, snap_path, ckpt, available_now=True).awaitTermination(120)
    row = refresh.snapshots(spark, snap_path).first()
    assert row["open_deals"] == 3 and row["gross_pipeline"] == 305
