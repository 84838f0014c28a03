"""Deterministic text answers for one-row results (markdown, one row).

Each function takes the DataFrame produced by the matching operator and
adds one ``text`` column built with ``concat``.  Signal numbering is
computed with running counts of the fired conditions, so no lambda or
aggregation is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from . import leadership, quality


def _s(c: Column) -> Column:
    return c.cast("string")


def pipeline_summary_text(summary: DataFrame) -> DataFrame:
    """Executive view of A1: totals, leading-sector share and data caveats."""
    return summary.select(pipeline_summary_text_col().alias("text"))


def pipeline_summary_text_col() -> Column:
    """The A1 answer text over a row of A1 columns."""
    msg = F.col("message")
    caveats = F.concat_ws(
        "\n",
        F.when(F.col("deals_without_probability") > 0,
               F.concat(F.lit("- "), _s(F.col("deals_without_probability")),
                        F.lit(" deals lack a usable closure probability."))),
        F.when(F.col("deals_missing_value") > 0,
               F.concat(F.lit("- "), _s(F.col("deals_missing_value")), F.lit(" deals are missing deal value."))),
    )
    body = F.concat(
        F.lit("### Executive view\n\nThe current open pipeline is **"), F.col("gross_pipeline_display"),
        F.lit(" gross** and **"), F.col("weighted_pipeline_display"), F.lit(" weighted** across **"),
        _s(F.col("open_deals")), F.lit(" open deals**."),
        F.lit("\n\n### What stands out\n\n- The largest sector represents **"),
        X.py_str_float("top_sector_concentration_pct"), F.lit("%** of gross pipeline."),
        F.when(caveats != "", F.concat(F.lit("\n\n### Data caveat\n\n"), caveats)).otherwise(F.lit("")),
    )
    with_msg = F.concat(F.lit("### Executive view\n\n"), msg,
                        F.lit("\n\n### Data caveat\n\nThe result is based on the exact sector "
                              "classification in the source board."))
    return F.when(msg.isNotNull() & (msg != ""), with_msg).otherwise(body)


def work_order_text(summary: DataFrame) -> DataFrame:
    """Operational view of A5."""
    return summary.select(work_order_text_col().alias("text"))


def work_order_text_col() -> Column:
    return F.concat(
        F.lit("### Operational view\n\nThere are **"), _s(F.col("total_work_orders")),
        F.lit(" work orders**, with **"), _s(F.col("active_work_orders")), F.lit(" active** and **"),
        _s(F.col("completed_work_orders")),
        F.lit(" completed**.\n\n### Leadership attention\n\nFocus on active execution, billing "
              "backlog, and collection dependencies."))


def financial_text(fin: DataFrame) -> DataFrame:
    """Financial view of A7."""
    return fin.select(financial_text_col().alias("text"))


def financial_text_col() -> Column:
    return F.concat(
        F.lit("### Financial view\n\n- Billed: **"), F.col("billed_value_display"),
        F.lit("**\n- Collected: **"), F.col("collected_amount_display"),
        F.lit("**\n- Yet to be billed: **"), F.col("amount_to_be_billed_display"),
        F.lit("**\n- Receivables: **"), F.col("amount_receivable_display"),
        F.lit("**\n- Collection rate: **"), X.py_str_float("collection_rate_pct"),
        F.lit("%**\n\n### Leadership attention\n\nReceivables and the amount still to be billed are "
              "the immediate working-capital areas to review."))


def leadership_text(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Leadership update: headline KPIs plus the numbered signal messages."""
    return leadership_text_of(leadership.kpi_row(deals, work_orders))


def leadership_text_of(k: DataFrame) -> DataFrame:
    """The leadership update over the row of KPIs."""
    conds_msgs = leadership.signal_conditions()
    lines, running = [], F.lit(0)
    for cond, message in conds_msgs:
        running = running + F.when(cond, F.lit(1)).otherwise(F.lit(0))
        lines.append(F.when(cond, F.concat(_s(running), F.lit(f". {message}\n"))))
    signals = F.concat_ws("", *lines)
    head = F.concat(
        F.lit("### Leadership update\n\n**Pipeline:** "), X.money_display("gross_pipeline"), F.lit(" gross / "),
        X.money_display("weighted_pipeline"), F.lit(" weighted across "), _s(F.col("open_deals")),
        F.lit(" open deals.\n\n**Operations:** "), _s(F.col("active_work_orders")),
        F.lit(" active work orders out of "), _s(F.col("total_work_orders")),
        F.lit(".\n\n**Cash & billing:** "), F.col("amount_receivable_display"), F.lit(" receivable and "),
        F.col("amount_to_be_billed_display"), F.lit(" yet to be billed."))
    return k.select(F.concat(head, F.when(signals != "", F.concat(
        F.lit("\n\n### Leadership attention\n\n"), signals)).otherwise(F.lit(""))).alias("text"))


def data_quality_text(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Data-quality overview: rows per dataset and its first five issues."""
    rep = quality.quality_report(deals, work_orders)
    key = X.title_case(F.regexp_replace(F.lower("dataset"), " ", "_"))
    first5 = F.slice("issues", 1, 5)
    block = F.concat(
        F.lit("**"), key, F.lit("** — "), _s(F.col("rows")), F.lit(" rows\n"),
        F.when(F.size(first5) > 0, F.concat(F.lit("- "), F.array_join(first5, "\n- "), F.lit("\n")))
        .otherwise(F.lit("")))
    order = F.when(F.col("dataset") == "Deals", F.lit(1)).otherwise(F.lit(2))
    per = rep.select(order.alias("o"), block.alias("block"))
    # Two rows (one per dataset) are folded into the single answer.
    return per.agg(F.concat(F.lit("### Data quality overview\n\n"),
                            F.array_join(F.array_sort(F.collect_list(F.struct("o", "block")))["block"], ""))
                   .alias("text"))

