"""Board ingestion (S1-S4): landed JSON pages and metadata -> wide table."""

import json

from pyspark.sql import functions as F

from dealscope.sources import board


def _write_pages(path, pages):
    path.mkdir(parents=True, exist_ok=True)
    for i, p in enumerate(pages):
        (path / f"page-{i}.json").write_text(json.dumps(p) + "\n")


def test_pages_to_table(spark, tmp_path):
    meta = {"id": "1", "name": "Deals", "state": "active", "columns": [
        {"id": "c1", "title": "Deal Name", "type": "text"},
        {"id": "c2", "title": "Sector/service", "type": "status"},
        {"id": "c3", "title": "Sector/service", "type": "text"},
    ]}
    item = lambda i, cvs: {"id": str(i), "name": f"Item {i}", "created_at": "2024-01-01",
                           "updated_at": None, "column_values": cvs}
    pages = [
        {"cursor": "abc", "items": [item(1, [{"id": "c1", "text": "Deal 1", "value": None},
                                             {"id": "c2", "text": "Mining", "value": None},
                                             {"id": "c3", "text": "Energy", "value": None},
                                             {"id": "zz", "text": "extra", "value": None}])]},
        {"cursor": None, "items": [item(2, [{"id": "c1", "text": None, "value": None}]),
                                   item(1, [{"id": "c1", "text": "Deal 1 again", "value": None}])]},
    ]
    _write_pages(tmp_path / "pages", pages)
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "board.json").write_text(json.dumps(meta) + "\n")
    items = board.read_board_pages(spark, str(tmp_path / "pages"))
    assert items.count() == 3  # pages are concatenated, not de-duplicated
    cols = board.read_board_columns(spark, str(tmp_path / "meta"))
    t = board.board_items_to_table(items, cols)
    assert t.columns == ["__item_id", "__item_name", "__created_at", "__updated_at", "Deal Name",
                         "Sector/service", "__other"]
    t = t.select("*", t["__other"]["zz"].alias("zz"))
    got = {(r["__item_id"], r["Deal Name"]): r.asDict() for r in t.collect()}
    r1 = got[("1", "Deal 1")]
    assert r1["Sector/service"] == "Energy"  # later id with the same title wins
    assert r1["zz"] == "extra" and r1["__updated_at"] is None
    r2 = got[("2", "")]  # null text becomes ''
    assert r2["Sector/service"] is None and r2["zz"] is None  # titles the item lacks are null


def test_source_coverage(spark):
    d = spark.range(3)
    w = spark.range(5)
    got = {r["dataset"]: r["records"] for r in board.source_coverage(d, w).collect()}
    assert got == {"Deals": 3, "Work Orders": 5}


def test_unknown_ids_stay_in_the_map_without_a_job(spark):
    items = spark.createDataFrame(
        [("1", "n", None, None, [("u", "first", None), ("c1", "A", None), ("u", "last", None), ("v", None, None), (None, "x", None)]),
         ("2", "n", None, None, []), ("3", "n", None, None, None)], board.ITEM)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    t = board.board_items_to_table(items, [("c1", "Name")])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    assert [(r["__item_id"], r["Name"], r["__other"]) for r in t.collect()] == [("1", "A", {"u": "last", "v": ""}), ("2", None, {}), ("3", None, {})]
    assert board.board_items_to_table(items, [("c1", "Name")], other=None).columns[-1] == "Name"
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("reverse(") == 2


def test_discovered_columns(spark):
    items = spark.createDataFrame(
        [("1", "n", None, None, [("a", " 12.5 ", None), ("b", "2024-01-31", None), ("a", "7", None), ("c", "", None), ("d", "x", None)]),
         ("2", "n", None, None, [("b", None, None), ("a", "", None), ("d", "3", None), (None, "y", None)]), ("3", "n", None, None, None)], board.ITEM)
    meta = spark.createDataFrame([("a", "Value", "numbers"), ("z", "Unused", "text")], "column_id string, title string, type string")
    got = {r["column_id"]: tuple(r)[1:] for r in board.discover_columns(items, meta).collect()}
    assert got == {"a": ("Value", "numbers", "numbers", 2, 2, 0), "b": ("b", None, "date", 2, 1, 0), "c": ("c", None, "empty", 1, 0, 3),
                   "d": ("d", None, "text", 2, 2, 2)}
    assert {r["title"] for r in board.discover_columns(items).collect()} == {"a", "b", "c", "d"}


def test_page_size_is_clamped(spark):
    items = spark.range(1200).selectExpr("cast(id as string) id", "'n' name", "'' created_at", "'' updated_at", "id as k").withColumn(
        "column_values", F.array().cast("array<struct<id:string,text:string,value:string>>"))
    sizes = lambda n: {r[0] for r in board.items_to_pages(items, "k", n).selectExpr("size(items)").collect()}
    assert sizes(9000) == {500, 200} and sizes(0) == {1}


def test_last_value_of_a_repeated_id_wins(spark):
    from dealscope.sources import board

    items = spark.createDataFrame(
        [("1", "n", None, None, [("c1", "first", None), ("c2", "other", None), ("c1", "last", None)])], board.ITEM)
    cols = spark.createDataFrame([("c1", "A", "text"), ("c2", "B", "text")], "column_id string, title string, type string")
    row = board.board_items_to_table(items, cols).first()
    assert (row["A"], row["B"]) == ("last", "other")
