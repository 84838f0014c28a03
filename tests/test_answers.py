"""Batch answers (R3): the grid results equal the one-call operators."""

import pytest
from pyspark.sql import functions as F

from dealscope.operators import answers, briefing, narrative, operations, routing, sales
from dealscope.plans import catalog
from tests.conftest import SF_SMOKE

AS_OF = catalog.AS_OF


@pytest.fixture(scope="module")
def boards(spark):
    return catalog.deals(spark, SF_SMOKE).cache(), catalog.work_orders(spark, SF_SMOKE).cache()


def test_pipeline_summary_grid_equals_single_calls(boards):
    deals, _ = boards
    grid = {(r["grid_sector"], r["grid_period"]): r.asDict()
            for r in answers.pipeline_summary_grid(deals, AS_OF).collect()}
    assert len(grid) == len(answers.GRID_SECTORS) * len(answers.GRID_PERIODS)
    for (s, p), got in grid.items():
        exp = sales.pipeline_summary(deals, s, p, AS_OF).first().asDict()
        assert {k: got[k] for k in exp} == exp, (s, p)


def test_work_order_grid_equals_single_calls(boards):
    _, wo = boards
    g = answers.work_order_grid(wo)
    label = F.coalesce(F.col("grid_sector"), F.lit("All sectors"))
    summ = {r["grid_sector"]: r.asDict() for r in g.select("grid_sector", *operations.summary_columns(label)).collect()}
    fin = {r["grid_sector"]: r.asDict() for r in g.select("grid_sector", *operations.financial_columns(label)).collect()}
    for s in answers.GRID_SECTORS:
        e1 = operations.work_order_summary(wo, s).first().asDict()
        e2 = operations.financial_summary(wo, s).first().asDict()
        assert {k: summ[s][k] for k in e1} == e1, s
        assert {k: fin[s][k] for k in e2} == e2, s


def test_answer_questions(spark, boards):
    deals, wo = boards
    qs = spark.createDataFrame([
        (1, "What is our pipeline this quarter in mining?"),
        (2, "Give me a leadership update"),
        (3, "How many work orders are active for railways?"),
        (4, "Show pipeline by sector"),
        (5, "Any data quality issues?"),
    ], "question_id long, question string")
    out = {r["question_id"]: r.asDict() for r in
           answers.answer_questions(routing.route_questions(qs), deals, wo, AS_OF).collect()}
    assert len(out) == 5 and all(r["answer"] for r in out.values())
    exp1 = narrative.pipeline_summary_text(
        sales.pipeline_summary(deals, out[1]["sector"], out[1]["period"], AS_OF)).first()["text"]
    assert out[1]["answer"] == exp1
    assert out[2]["answer"] == narrative.leadership_text(deals, wo).first()["text"]
    assert out[5]["answer"] == narrative.data_quality_text(deals, wo).first()["text"]


def test_answer_questions_without_reuse_is_identical(spark, boards):
    deals, wo = boards
    qs = routing.route_questions(catalog._questions(spark, SF_SMOKE))
    a = answers.answer_questions(qs, deals, wo, AS_OF)
    b = answers.answer_questions(qs, deals, wo, AS_OF, reuse=False)
    ra = sorted(tuple(r) for r in a.collect())
    assert ra == sorted(tuple(r) for r in b.collect())
    assert len(ra) == qs.count() and all(r[-1] for r in ra)  # every question answered


def test_answer_join_keeps_questions_in_place(spark, boards):
    deals, wo = boards
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        qs = routing.route_questions(catalog._questions(spark, SF_SMOKE))
        plan = answers.answer_questions(qs, deals, wo, AS_OF, reuse=False)._jdf.queryExecution() \
            .executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    outer = [ln for ln in plan.split("\n") if "LeftOuter" in ln]
    assert outer and all("BroadcastHashJoin" in ln and "BuildRight" in ln for ln in outer), outer


def test_by_sector_answer_lists_eight_rows_with_heading_and_closing(spark):
    from dealscope.operators import clean

    raw = spark.createDataFrame([(f"d{i}", "Open", f"Sector {i}", str(100 * (i + 1))) for i in range(9)],
                                ["Deal Name", "Deal Status", "Sector/service", "Masked Deal value"])
    text = answers.sector_answer(clean.clean_deals(raw)).first()["text"]
    assert text.startswith("### Pipeline by sector\n\n- **Sector 8** — ₹900 across 1 deals (20.0% of pipeline)\n")
    assert text.count("\n- **") == 8 and "Sector 0" not in text
    assert text.endswith("conversion confidence.")
    empty = clean.clean_deals(raw.limit(0))
    assert answers.sector_answer(empty).first()["text"] == (
        "### Pipeline by sector\n\nNo sector-level pipeline data is currently available.")
    assert answers.stage_answer(empty).first()["text"].endswith("No pipeline-stage data is currently available.")


def test_cells_form_labels_once_a_group(spark, boards):
    """Rows are grouped by their texts as they are; display and compare forms come after the first aggregation."""
    _, wo = boards
    cells = answers.work_order_grid_cells(wo)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in plan.split("\n") if "Aggregate [" in line]
    assert len(keys) == 2  # over the labels, and below it over the texts alone
    assert keys[1].split("Aggregate [")[1].split("]")[0].count("#") == 2


def test_answers_read_no_copy_of_the_boards(spark, boards, monkeypatch):
    """Only the two tables of cells are written, never a whole board."""
    from dealscope.operators import answers as A
    from dealscope.session import materialize_table

    widths = []
    monkeypatch.setattr(A, "materialize_table", lambda df: widths.append(set(df.columns)) or materialize_table(df))
    qs = spark.createDataFrame([("q1", "pipeline_summary", None, None)], "q string, tool string, sector string, period string")
    A.answer_questions(qs, *boards, AS_OF).collect()
    assert len(widths) == 2 and all("_ns" in w and "__item_id" not in w for w in widths)


def test_cells_of_boards_without_rows_or_keys(spark, boards):
    """An empty board has no cells, also without the text columns that are their keys."""
    deals, wo = boards
    for empty in (wo.limit(0), wo.limit(0).drop("sector", "execution_status")):
        assert briefing.work_order_cells(empty).count() == 0
    assert briefing.deal_cells(deals.limit(0).drop("sector", "deal_stage")).count() == 0
    one = briefing.work_order_cells(wo.drop("sector", "execution_status")).collect()
    assert [r["total_work_orders"] for r in one] == [wo.count()]
