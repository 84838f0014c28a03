"""Header resolution (P1-P3): plan-time, by position."""

from dealscope.functions import vocab
from dealscope.plans.schema import canonical_columns, header_key, resolve_headers


def test_header_key():
    assert header_key("  Close Date (A) ") == "close date a"
    assert header_key("Serial #") == "serial"
    assert header_key("__item_name") == "item name"
    assert header_key(None) == ""


def test_exact_before_containment_and_alias_order():
    mapping = {"close_date": ["Close Date (A)", "Close Date A", "Close Date"]}
    assert resolve_headers(["Tentative Close Date", "Close Date (A)"], mapping) == ["Tentative Close Date", "close_date"]
    assert resolve_headers(["Tentative Close Date"], mapping) == ["close_date"]
    assert resolve_headers(["x"], mapping) == ["x"]
    assert resolve_headers(["b x", "a x"], {"n": ["x"]}) == ["n", "a x"]


def test_later_header_wins_on_collision():
    assert resolve_headers(["Deal Name", "deal-name"], {"deal_name": ["Deal Name"]}) == ["Deal Name", "deal_name"]


def test_item_name_is_claimed_as_deal_name_when_no_deal_name():
    assert resolve_headers(["__item_id", "__item_name", "Sector"], vocab.DEAL_MAPPING) == ["__item_id", "deal_name", "sector"]


def test_platform_header_matched_by_tail():
    header = "Is any in-house software platform part of the client deliverables in this deal?"
    assert resolve_headers([header, "Sector"], vocab.WORK_ORDER_MAPPING) == ["software_platform", "sector"]


def test_titles_that_differ_in_case_only(spark):
    df = spark.createDataFrame([("a", "b", "c")], "x string, y string, z string").toDF("Sector/service", "sector/service", "Deal Name")
    out = canonical_columns(df, vocab.DEAL_MAPPING)
    assert out.columns == ["Sector/service", "sector", "deal_name"] and tuple(out.first()) == ("a", "b", "c")
    same = df.toDF("Extra", "extra", "Deal Name")
    assert tuple(canonical_columns(same, vocab.DEAL_MAPPING).first()) == ("b", "c")
