"""Scalar expressions (X1-X19) on literal edge rows; expectations from the spec."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealscope.functions import expr as X
from dealscope.functions import vocab


def _one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_money_parse(spark):
    vals = ["₹ 1,23,456.50", "Rs. 5,000", "68.82 Cr", "(500)", "5-10", "-", "n/a", "", None, "-250", "12345.67"]
    exp = [float("123456.50"), float("0.50"), float("68.82"), float("500.00"), None, None, None,
           None, None, float("-250.00"), float("12345.67")]
    assert _one_col(spark, vals, X.money_parse) == exp


def test_probability_parse(spark):
    vals = ["Very High", " low ", "70%", "70 %", "0.35", "1%", "0.5%", "-5", "150000", "inf", "nan", "1d",
            "0x1p3", "", None, "High", "medium ", "very low"]
    exp = [0.9, 0.2, 0.7, 0.7, 0.35, 1.0, 0.5, None, None, None, None, None, None, None, None, 0.8, 0.5, 0.1]
    assert _one_col(spark, vals, X.probability_parse) == exp


def test_title_case(spark):
    vals = ["o'neil 3d-map / x", "dsp", "a  b", "PARTIAL  completed", "", None, "oil-and gas"]
    exp = ["O'Neil 3D-Map / X", "Dsp", "A  B", "Partial  Completed", "", None, "Oil-And Gas"]
    assert _one_col(spark, vals, X.title_case) == exp


def test_sector_norm(spark):
    vals = ["Renewable Energy", "energy sector", "power line", "", None, " Mining ", "Railway", "dsp",
            "security and surveillance", "oil-and gas"]
    exp = ["Renewables", "Energy", "Powerline", "", None, "Mining", "Railways", "Dsp",
           "Security and Surveillance", "Oil-And Gas"]
    assert _one_col(spark, vals, X.sector_norm) == exp


def test_status_norm_keeps_inner_spaces(spark):
    assert _one_col(spark, [" completed", "Partial  Completed", None, "pause / struck"], X.status_norm) == [
        "Completed", "Partial  Completed", None, "Pause / Struck"]


def test_text_norm_and_display(spark):
    vals = ["  ON \t HOLD ", None, "", "Open", "a  b"]
    assert _one_col(spark, vals, X.text_norm) == ["on hold", "", "", "open", "a b"]
    assert _one_col(spark, vals, X.text_display) == [
        "ON \t HOLD", "Unknown / Unclassified", "Unknown / Unclassified", "Open", "a  b"]


def test_safe_pct(spark):
    df = spark.createDataFrame([(1, 3), (1, 800), (3, 800), (5, 0), (5, None), (0, 7)], "n long, d long")
    got = [r[0] for r in df.select(X.safe_pct("n", "d")).collect()]
    assert got == [33.33, 0.12, 0.38, 0.0, 0.0, 0.0]


def test_py_round_half_even_on_binary(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (2.675,), (12.25,)], "x double")
    got = [r[0] for r in df.select(X.py_round("x", 2)).collect()]
    assert got == [round(0.125, 2), round(1.005, 2), round(2.675, 2), round(12.25, 2)]


def test_money_display(spark):
    vals = [688152293.0, 2560000.0, 50000.0, 9999999.0, -12345678.0, None, 1234.5]
    assert _one_col(spark, vals, X.money_display, "double") == [
        "₹68.82 Cr", "₹25.60 L", "₹50,000", "₹100.00 L", "₹-1.23 Cr", "₹0", "₹1,234"]
    assert _one_col(spark, vals, X.money_display_signed, "double") == [
        "₹68.82 Cr", "₹25.60 L", "₹50,000", "₹100.00 L", "₹-12,345,678", "₹0", "₹1,234"]


def test_date_parse(spark):
    vals = ["2001-05-15", " 2001-05-15 ", "2001-05-15 10:11:12", "2001/05/15", "05/15/2001", "TBD", "", None]
    d = dt.date(2001, 5, 15)
    assert _one_col(spark, vals, X.date_parse) == [d, d, d, d, d, None, None, None]


@pytest.mark.parametrize("day,start,end", [
    ("2025-11-30", dt.date(2025, 10, 1), dt.date(2026, 1, 1)),
    ("2001-05-15", dt.date(2001, 4, 1), dt.date(2001, 7, 1)),
])
def test_quarter_bounds(spark, day, start, end):
    df = spark.createDataFrame([(day,)], "d string").select(F.col("d").cast("date").alias("d"))
    r = df.select(X.quarter_start("d"), X.quarter_end("d")).first()
    assert (r[0], r[1]) == (start, end)


def test_bands_and_confidence(spark):
    df = spark.createDataFrame([(60.0, 59.9, 50.0, 85.0, 0.0, 0.0), (40.0, 79.9, 30.0, 70.0, 80.0, 91.0),
                                (39.9, 80.0, 29.9, 69.9, 90.55, 90.6)],
                               "c double, col double, b double, conf double, vc double, pc double")
    got = df.select(X.band_concentration("c"), X.band_collection("col"), X.band_backlog("b"),
                    X.band_confidence("conf"), X.confidence("vc", "pc")).collect()
    assert [tuple(r) for r in got] == [
        ("HIGH", "HIGH", "HIGH", "GOOD", 0.0),
        ("WATCH", "WATCH", "WATCH", "WATCH", 85.5),
        ("GOOD", "GOOD", "GOOD", "HIGH", round((90.55 + 90.6) / 2, 1)),
    ]


def test_date_parse_iso_fast_path_rejects_impossible_dates(spark):
    vals = ["2001-02-30", "2001-13-01", "2000-02-29", "20010-5-15", "2001-5-15x"]
    assert _one_col(spark, vals, X.date_parse) == [None, None, dt.date(2000, 2, 29), None, None]


def test_safe_casts_and_display_pick(spark):
    df = spark.createDataFrame([("12.9", None, 2560000.0), ("x", "₹1 L", None), (None, None, None)],
                               "v string, disp string, num double")
    got = [tuple(r) for r in df.select(X.safe_float("v"), X.safe_int("v"),
                                       X.display_or_money("disp", "num")).collect()]
    assert got == [(12.9, 12, "₹25.60 L"), (0.0, 0, "₹1 L"), (0.0, 0, "₹0")]


def test_money_keeps_every_digit(spark):

    texts = ["12345678901234567890", "1.239", "0.004", "₹ 1,234.5", "Rs. 5,000", "abc", "", None, "-7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.money_parse("t")).collect()]
    want = ["12345678901234567890", "1.239", "0.004", "1234.5", "0.5", None, None, None, "-7"]
    assert got == [None if w is None else float(w) for w in want]


def test_money_numbers_pass_through(spark):
    df = spark.createDataFrame([(10_000_000.0, 7, 688_152_293.0), (25_000_000.5, None, float("nan"))], "d double, i int, e double")
    d, i, e = zip(*[tuple(r) for r in df.select(X.money_parse("d"), X.money_parse("i"), X.money_parse("e")).collect()])
    assert [float(x) for x in d] == [10_000_000.0, 25_000_000.5] and i == (7, None) and e[0] == 688_152_293 and e[1] is None


def test_probability_is_not_cut(spark):
    from dealscope.operators import clean, sales

    raw = spark.createDataFrame([("a", "Open", "33.3333%", 1_000_000_000.0)], ["Deal Name", "Deal Status", "Closure Probability", "Masked Deal value"])
    row = sales.pipeline_summary(clean.clean_deals(raw)).first()
    assert row["gross_pipeline"] == 1_000_000_000 and row["weighted_pipeline"] == 333_333_000


def test_more_date_shapes(spark):
    texts = ["Jan 5, 2024", "5-Jan-2024", "5 Jan 2024", "2024-01-05T10:00:00Z", "2024-01-05T10:00:00.500+00:00", "2024-01-05 10:00:00.123",
             "2024-01-05 10:00", "20240105", "2024-01-05", "01/05/2024", "2024/01/05"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {str(r[0]) for r in df.select(X.date_parse("t")).collect()} == {"2024-01-05"}
    bad = spark.createDataFrame([("TBD",), ("",), (None,), ("Mars 5, 2024",), ("2024-13-45",)], "t string")
    assert {r[0] for r in bad.select(X.date_parse("t")).collect()} == {None}


def test_cleaners_take_formats(spark):
    from dealscope.operators import clean

    raw = spark.createDataFrame([("a", "05.01.2024")], ["Deal Name", "Created Date"])
    assert clean.clean_deals(raw).first()["created_date"] is None
    assert str(clean.clean_deals(raw, formats=("dd.MM.yyyy",)).first()["created_date"]) == "2024-01-05"


def test_money_sums_are_exact_in_any_order(spark):
    """Totals are the exact sum rounded once, however rows are dealt out and whatever their size."""
    import random
    from fractions import Fraction

    rng = random.Random(4)
    values = [9.9999999999999e28, 9.9999999999999e28, 0.1, 0.2, -0.3, 0.00000012345, 1.0000000019, 1e15, 1e15 + 0.125, -1e22, 3e17, 2.0**50, -(2.0**50) - 0.25]
    values += [round(rng.uniform(-1e7, 1e7), 2) for _ in range(500)]
    small = [v for v in values if abs(v) < 1e9]
    for some in (values, small, [0.00000012345, 1.0000000019], ["9" * 29, "9" * 29], [0.1] * 10, []):
        want = float(sum(Fraction(str(v)) if abs(float(v)) < 2**50 else Fraction(float(v)) for v in some))
        for parts in (1, 7):
            df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(rng.sample(some, len(some)))], "v double, g int").repartition(parts)
            got = df.agg(X.money_sum("v")).first()[0]
            twice = df.groupBy("g").agg(X.money_part("v").alias("p")).agg(X.money_value(X.money_join("p"))).first()[0]
            assert got == twice and abs(got - want) <= abs(want) * 2**-52
            if some is not values:
                assert got == want
    assert want == 0.0


def test_garbage_amounts_never_end_a_sum(spark):
    texts = ["9" * 29, "9" * 29, "9" * 400, "7" * 34, "1.000000000001", "1.2.3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.money_parse("t").alias("v"))
    assert [r[0] for r in df.collect()] == [1e29, 1e29, None, None, 1.000000000001, None]
    assert df.filter("v > 10").agg(X.money_sum("v")).first()[0] == 2e29
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (2.5,)], "v double")
    assert odd.agg(X.money_sum("v")).first()[0] == 2.5


def test_one_parse_a_cell_whatever_the_formats(spark):
    texts = {"2024-01-05 10:11:12": 5, "1/5/2024": 5, "January 5, 2024": 5, "5 January 2024": 5, "5-Jan-2024": 5,
             "2024-01-05T10:11:12.123-05:30": 5, "20240105": 5, "May 5, 2024": 5, "13/45/2024": None, "5 Foo 2024": None,
             "2024-01-05T25:00:00": None, "2024-01-05 and more": None}
    got = _one_col(spark, list(texts), X.date_parse)
    assert [d and d.day for d in got] == list(texts.values())
    df = spark.createDataFrame([("x",)], "t string").select(X.date_parse("t").alias("d"))
    assert df._jdf.queryExecution().analyzed().toString().count("try_to_timestamp") == 1


def test_formats_of_one_shape_are_tried_in_order(spark):
    both = lambda c: X.date_parse(c, ("MM/dd/yyyy", "dd/MM/yyyy"))
    assert _one_col(spark, ["01/02/2024", "13/02/2024", "13/13/2024"], both) == [
        dt.date(2024, 1, 2), dt.date(2024, 2, 13), None]


def test_shapes_of_formats():
    assert X.date_shapes("MMM d, yyyy") == ["AAA 9, 9999", "AAA 99, 9999"]
    assert X.date_shapes("yyyy-MM-dd'T'HH:mm") == ["9999-99-99A99:99"]
    assert X.date_shapes("yy/Q") == []  # no fixed shape: tried as it is


def test_each_cell_is_evaluated_once_where_it_is_plain(spark):
    """A pushed-down filter repeats what it is made of: no alias table, amount or date may multiply its input."""
    df = spark.createDataFrame([("Mining",)], "t string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(X.sector_norm("t")).count("btrim") <= 6
    assert "translate" not in plan(X.money_parse("t"))
    assert plan(X.date_parse("t")).count("translate") == 1  # the shape of a text that is no ISO date


def test_text_forms_on_odd_text(spark):
    vals = ["İSTANBUL", "a b ", "a\n", "x  ", " ", "a\tb", "A-1 b"]
    assert _one_col(spark, vals, X.text_norm) == ["i̇stanbul", "a b", "a", "x", "", "a b", "a-1 b"]
    assert _one_col(spark, ["abc\n", "MINING\n", "é b"], X.title_case) == ["Abc\n", "Mining\n", "É B"]
    money = ["9" * 32, "9" * 33, "9" * 34, "1\n", "-", ".", "١٢"]
    assert _one_col(spark, money, X.money_parse) == [float("9" * 32), None, None, 1.0, None, None, None]
    assert _one_col(spark, ["2001-05-15\n", "२००१-०५-१५", "0000-01-01x"], X.date_parse) == [dt.date(2001, 5, 15), None, None]


def test_ascii_strip_is_python_strip(spark):
    vals = ["", " ", "   ", "a", " a ", "  a  b ", "\ta", "a\n", " \ta\x1f ", " a", "a　 ", " é ", "\x7fa\x7f", "!", " ~ ", "a\x00", None, " "]
    exp = [None if v is None else v.strip() for v in vals]
    assert _one_col(spark, vals, X._ascii_strip) == exp
    assert _one_col(spark, vals, X.text_display) == [v or vocab.UNKNOWN_LABEL for v in exp]
