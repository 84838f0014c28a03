"""Page chains by pointer jumping against following the cursors one by one."""

import random

from dealscope.sources.pages import chained_items, page_chain

SCHEMA = "board string, request_cursor string, cursor string, items array<struct<id:string>>"


def frame(spark, rows):
    return spark.createDataFrame([(b, r, c, [(f"{b}:{r}:{i}",) for i in range(2)]) for b, r, c in rows], SCHEMA)


def chain(spark, rows):
    return {(r["board"], r["request_cursor"]): (r["position"], r["copies"], r["problems"]) for r in page_chain(frame(spark, rows)).collect()}


def test_long_chain_with_a_removed_page(spark):
    n = 300
    rows = [("x", str(i) if i else None, str(i + 1) if i < n - 1 else "") for i in range(n)]
    random.Random(1).shuffle(rows)
    got = chain(spark, [r for r in rows if r[1] != "200"])
    for i in range(n):
        if i != 200:
            want = (i + 1 if i < 200 else None, 1, "missing next" if i == 199 else "" if i < 200 else "unreachable")
            assert got["x", str(i) if i else None] == want
    assert len(got) == n - 1


def test_every_fault_by_name(spark):
    rows = [("a", None, "1"), ("a", "1", "2"), ("a", "1", "2"), ("a", "2", None),  # a page twice
            ("b", None, "1"), ("b", "1", "2"), ("b", "2", "1"),  # back into the chain
            ("c", "1", "2"), ("c", "2", "1"), ("c", "3", "3"),  # circles without a first page
            ("d", "", "5"), ("d", "4", "5"), ("d", "5", None),  # two pages lead to 5
            (None, None, "gone"), ("e", "9", None)]
    assert chain(spark, rows) == {
        ("a", None): (1, 1, ""), ("a", "1"): (2, 2, "repeated"), ("a", "2"): (3, 1, ""),
        ("b", None): (1, 1, ""), ("b", "1"): (2, 1, ""), ("b", "2"): (3, 1, "loop"),
        ("c", "1"): (None, 1, "loop"), ("c", "2"): (None, 1, "loop"), ("c", "3"): (None, 1, "loop"),
        ("d", None): (1, 1, ""), ("d", "4"): (None, 1, "shared next,unreachable"), ("d", "5"): (2, 1, ""),
        (None, None): (1, 1, "missing next"), ("e", "9"): (None, 1, "unreachable")}
    items = chained_items(frame(spark, rows)).collect()
    assert sorted((r["board"] or "", r["position"], r["id"]) for r in items if r["board"] == "a") == sorted(
        ("a", p, f"a:{k}:{i}") for p, k in ((1, None), (2, "1"), (3, "2")) for i in range(2))
    assert {r["board"] for r in items} == {"a", "b", "d", None}


def test_no_pages(spark):
    assert page_chain(frame(spark, [])).count() == 0


def test_landed_pages_are_compressed(spark):
    import glob

    from dealscope.plans import catalog
    from dealscope.sources import board

    df = spark.range(50).selectExpr("string(id) AS request_cursor", "string(id + 1) AS cursor", "cast(null AS string) AS name")
    path = catalog._landed(df)
    local = path.removeprefix("file:")
    assert glob.glob(f"{local}/*.json.gz") and not glob.glob(f"{local}/*.json")
    assert spark.read.schema(board.PAGE).json(path).select("request_cursor").distinct().count() == 50
