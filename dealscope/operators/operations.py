"""Work-order operators: A5 summary, A6 status breakdown, A7 financial
summary, A8 rollup by sector, G4 collection scenario, G7 operational table.

All are single aggregations with conditional aggregates: partial
aggregation map-side, then one small shuffle (or none for global ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import vocab
from .filters import sector_filter


def active_flag(df: DataFrame) -> Column:
    """normalized status is one of the active statuses (False without a column)."""
    if "execution_status" not in df.columns:
        return F.lit(False)
    return X.text_norm("execution_status").isin(*vocab.ACTIVE_WORK_ORDER_STATUSES)


def completed_flag(df: DataFrame) -> Column:
    if "execution_status" not in df.columns:
        return F.lit(False)
    return X.text_norm("execution_status") == F.lit(vocab.COMPLETED_STATUS)


def money_or_zero(df: DataFrame, column: str) -> Column:
    """A money column with unusable values as 0 (missing column = 0)."""
    if column not in df.columns:
        return F.lit(0).cast(X.MONEY_TYPE)
    return F.coalesce(F.col(column).try_cast(X.MONEY_TYPE), F.lit(0).cast(X.MONEY_TYPE))


def wo_kpi_aggs(df: DataFrame, money=X.money_sum) -> list[Column]:
    """Counts and money sums shared by A5, A7, G5 and G7 (one pass).

    ``money``: ``X.money_part`` where the sums are added up again."""
    return [
        F.count(F.lit(1)).alias("total_work_orders"),
        F.count_if(active_flag(df)).alias("active_work_orders"),
        F.count_if(completed_flag(df)).alias("completed_work_orders"),
        money(money_or_zero(df, "billed_value_incl")).alias("billed_value"),
        money(money_or_zero(df, "collected_amount")).alias("collected_amount"),
        money(money_or_zero(df, "amount_to_be_billed_incl")).alias("amount_to_be_billed"),
        money(money_or_zero(df, "amount_receivable")).alias("amount_receivable"),
    ]


def _sector_label(sector) -> Column:
    return sector if isinstance(sector, Column) else F.lit(sector or vocab.ALL_SECTORS)


def summary_columns(sector: str | Column | None) -> list[Column]:
    return [
        F.lit(vocab.METRIC_WORK_ORDERS).alias("metric"),
        _sector_label(sector).alias("sector"),
        F.col("total_work_orders"),
        F.col("active_work_orders"),
        F.col("completed_work_orders"),
        X.safe_pct("active_work_orders", "total_work_orders").alias("active_share_pct"),
        X.safe_pct("completed_work_orders", "total_work_orders").alias("completion_share_pct"),
    ]


def financial_columns(sector: str | Column | None) -> list[Column]:
    billed, tbb = F.col("billed_value"), F.col("amount_to_be_billed")
    return [
        F.lit(vocab.METRIC_FINANCIAL).alias("metric"),
        _sector_label(sector).alias("sector"),
        billed,
        X.money_display(billed).alias("billed_value_display"),
        F.col("collected_amount"),
        X.money_display("collected_amount").alias("collected_amount_display"),
        tbb,
        X.money_display(tbb).alias("amount_to_be_billed_display"),
        F.col("amount_receivable"),
        X.money_display("amount_receivable").alias("amount_receivable_display"),
        X.safe_pct("collected_amount", billed).alias("collection_rate_pct"),
        X.safe_pct("amount_receivable", billed).alias("receivable_as_pct_of_billed"),
        X.safe_pct(tbb, billed.cast("double") + tbb.cast("double")).alias("billing_backlog_ratio_pct"),
    ]


def work_order_summary(work_orders: DataFrame, sector: str | None = None) -> DataFrame:
    """A5: totals, active and completed counts and their shares."""
    df = sector_filter(work_orders, sector)
    return df.agg(*wo_kpi_aggs(df)).select(*summary_columns(sector))


def status_breakdown(work_orders: DataFrame, sector: str | None = None) -> DataFrame:
    """Work orders per stripped status (blank -> Unknown), count descending."""
    df = sector_filter(work_orders, sector)
    if "execution_status" not in df.columns:
        return df.limit(0).select(F.lit(None).cast("string").alias("status"),
                                  F.lit(None).cast("bigint").alias("work_orders"))
    g = df.groupBy(X.text_display("execution_status").alias("status")).agg(
        F.count(F.lit(1)).alias("work_orders"))
    return g.orderBy(F.col("work_orders").desc(), F.col("status").asc())


def financial_summary(work_orders: DataFrame, sector: str | None = None) -> DataFrame:
    """Billed / collected / to-be-billed / receivable sums and three ratios."""
    df = sector_filter(work_orders, sector)
    return df.agg(*wo_kpi_aggs(df)).select(*financial_columns(sector))


def work_orders_by_sector_unordered(work_orders: DataFrame) -> DataFrame:
    df = work_orders
    backlog = money_or_zero(df, "amount_to_be_billed_incl") if "amount_to_be_billed_incl" in df.columns \
        else F.lit(0).cast(X.MONEY_TYPE)
    if "sector" not in df.columns:
        agg = df.agg(F.count(F.lit(1)).alias("total_work_orders"))
        return agg.filter(F.col("total_work_orders") > 0).select(
            F.lit(vocab.UNKNOWN_LABEL).alias("sector"),
            F.lit(0).cast("bigint").alias("active_work_orders"),
            "total_work_orders",
            F.lit(0).cast(X.SUM_MONEY_TYPE).alias("billing_backlog"),
        )
    return df.groupBy(X.text_display("sector").alias("sector")).agg(
        F.count_if(active_flag(df)).alias("active_work_orders"),
        F.count(F.lit(1)).alias("total_work_orders"),
        X.money_sum(backlog).alias("billing_backlog"),
    )


def work_orders_by_sector(work_orders: DataFrame) -> DataFrame:
    """Active count, total and billing backlog per display sector."""
    g = work_orders_by_sector_unordered(work_orders)
    return g.select("*", X.money_display("billing_backlog").alias("billing_backlog_display")).orderBy(
        F.col("billing_backlog").desc(), F.col("sector").asc())


def scenario_collection(work_orders: DataFrame, low: int = 50, high: int = 100) -> DataFrame:
    """G4 as a sensitivity table: one row per target collection rate low..high.

    ``is_default`` marks the dashboard's starting target,
    clamp(int(current rate) + 10, 50, 100).
    """
    fin = financial_summary(work_orders)
    billed = F.col("billed_value").cast("double")
    collected = F.col("collected_amount").cast("double")
    default = F.least(F.greatest(F.col("collection_rate_pct").cast("int") + 10, F.lit(50)), F.lit(100))
    t = F.col("target_collection_pct")
    target_amt = billed * t / 100
    return fin.select(
        "billed_value", "collected_amount", "collection_rate_pct",
        F.explode(F.sequence(F.lit(low), F.lit(high))).alias("target_collection_pct"),
    ).select(
        "target_collection_pct",
        (t == default).alias("is_default"),
        "billed_value", "collected_amount", "collection_rate_pct",
        target_amt.alias("target_collected"),
        F.greatest(target_amt - collected, F.lit(0.0)).alias("additional_cash"),
        F.greatest(billed - collected, F.lit(0.0)).alias("current_gap"),
    )


def operational_snapshot(work_orders: DataFrame) -> DataFrame:
    """The six (metric, value) text rows of the operations panel (one pass)."""
    kpis = work_orders.agg(*wo_kpi_aggs(work_orders))
    both = kpis.select(*summary_columns(None),
                       X.money_display("amount_to_be_billed").alias("tbb_display"))
    row = lambda pos, metric, value: F.struct(
        F.lit(pos).alias("position"), F.lit(metric).alias("metric"), value.alias("value"))
    rows = F.array(
        row(1, vocab.OPERATIONAL_METRICS[0], F.col("total_work_orders").cast("string")),
        row(2, vocab.OPERATIONAL_METRICS[1], F.col("active_work_orders").cast("string")),
        row(3, vocab.OPERATIONAL_METRICS[2], F.col("completed_work_orders").cast("string")),
        row(4, vocab.OPERATIONAL_METRICS[3], F.concat(X.py_str_float("active_share_pct"), F.lit("%"))),
        row(5, vocab.OPERATIONAL_METRICS[4], F.concat(X.py_str_float("completion_share_pct"), F.lit("%"))),
        row(6, vocab.OPERATIONAL_METRICS[5], F.col("tbb_display")),
    )
    return both.select(F.inline(rows))
