"""Batch question routing (R1-R3) and row narratives.

Routing is a ``CASE WHEN contains(...)`` ladder over a normalized text
column: plain column expressions, code-generated, no UDF, and
embarrassingly parallel over any number of questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import vocab

QUESTION_TEMPLATES = vocab.QUESTION_TEMPLATES


def questions_from_conversations(conversations: DataFrame) -> DataFrame:
    """One question per user turn: template ``(conv_id * 7 + turn) % n``."""
    n = len(QUESTION_TEMPLATES)
    templates = F.array(*[F.lit(t) for t in QUESTION_TEMPLATES])
    idx = ((F.col("conv_id") * 7 + F.col("turn")) % n).cast("int")
    return conversations.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        F.element_at(templates, idx + 1).alias("question"),
    )


def route_questions(questions: DataFrame, text_column: str = "question") -> DataFrame:
    """Add ``tool``, ``sector``, ``period`` (first matching term list wins)."""
    # normalized once; a projection of its own keeps it from being repeated at every term
    normal = questions.select("*", X.text_norm(text_column).alias("_normal"))
    q = F.col("_normal")
    tool = None
    keeps_sector = None
    for name, terms, keep in vocab.ROUTES:
        hit = X._contains_any(q, terms)
        tool = F.when(hit, F.lit(name)) if tool is None else tool.when(hit, F.lit(name))
        keeps_sector = (F.when(hit, F.lit(keep)) if keeps_sector is None
                        else keeps_sector.when(hit, F.lit(keep)))
    tool = tool.otherwise(F.lit(vocab.DEFAULT_TOOL))
    keeps_sector = keeps_sector.otherwise(F.lit(True))
    is_default = tool == F.lit(vocab.DEFAULT_TOOL)
    return normal.select(
        *(F.col(f"`{c}`") for c in questions.columns),
        tool.alias("tool"),
        F.when(keeps_sector, X.extract_sector(q)).alias("sector"),
        F.when(is_default, X.extract_period(q)).alias("period"),
    )


def route_counts(routed: DataFrame) -> DataFrame:
    """R2: question volume per (tool, sector, period)."""
    return routed.groupBy("tool", "sector", "period").agg(F.count(F.lit(1)).alias("questions"))


def execute_tool(name: str, deals: DataFrame, work_orders: DataFrame,
                 sector: str | None = None, period: str | None = None, as_of=None):
    """Tool name -> DataFrame (or dict of DataFrames for the bundle).

    Only builds plans on the driver; arguments a tool does not take are
    ignored, an unknown name raises ``ValueError``.
    """
    from . import briefing, cross, leadership, operations, quality, sales

    tools: dict[str, Callable[[], object]] = {
        "pipeline_summary": lambda: sales.pipeline_summary(deals, sector, period, as_of),
        "pipeline_by_sector": lambda: sales.pipeline_by_sector(deals),
        "pipeline_by_stage": lambda: sales.pipeline_by_stage(deals),
        "work_order_summary": lambda: operations.work_order_summary(work_orders, sector),
        "financial_summary": lambda: operations.financial_summary(work_orders, sector),
        "cross_board": lambda: cross.cross_board(deals, work_orders),
        "leadership_update": lambda: briefing.leadership_update(deals, work_orders),
        "data_quality": lambda: quality.quality_report(deals, work_orders),
    }
    if name not in tools:
        raise ValueError(f"Unknown analytics tool: {name}")
    return tools[name]()


# ---------------------------------------------------------------------------
# narratives
# ---------------------------------------------------------------------------
def sector_narrative(by_sector: DataFrame) -> DataFrame:
    """One markdown line per pipeline-by-sector row."""
    line = F.concat(
        F.lit("- **"), F.col("sector"), F.lit("** — "), F.col("pipeline_display"),
        F.lit(" across "), F.col("deals").cast("string"), F.lit(" deals ("),
        F.coalesce(X.py_str_float("pipeline_share_pct"), F.lit("0")), F.lit("% of pipeline)"))
    return by_sector.select("sector", "pipeline", line.alias("line"))


def stage_narrative(by_stage: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- **"), F.col("stage"), F.lit("** — "), F.col("pipeline_display"),
                    F.lit(" ("), F.col("deals").cast("string"), F.lit(" deals)"))
    return by_stage.select("stage", "pipeline", line.alias("line"))


def cross_board_line() -> Column:
    return F.concat(
        F.lit("- **"), F.col("sector"), F.lit("** — pipeline "), F.col("pipeline_display"),
        F.lit(", "), F.col("active_work_orders").cast("string"), F.lit(" active WOs, billing backlog "),
        F.col("billing_backlog_display"))


def cross_board_narrative(cross_rows: DataFrame) -> DataFrame:
    """One markdown line per cross-board row."""
    return cross_rows.select("sector", "billing_backlog", cross_board_line().alias("line"))
