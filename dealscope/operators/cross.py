"""Cross-board sector view (J1) and its top-k cuts.

Aggregate first, then join: both sides are reduced to one row per display
sector before the full outer join, and both come out of their aggregation
hash-partitioned on ``sector``, so the join needs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .operations import work_orders_by_sector_unordered
from .sales import _grouped_pipeline

CROSS_COLUMNS = [
    "sector", "deals", "pipeline", "pipeline_display", "pipeline_share_pct",
    "active_work_orders", "total_work_orders", "billing_backlog", "billing_backlog_display",
]


def cross_board_unordered(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    a3 = _grouped_pipeline(deals, "sector", "sector").drop("pipeline_display")
    return join_sectors(a3, work_orders_by_sector_unordered(work_orders))


def join_sectors(a3: DataFrame, a8: DataFrame) -> DataFrame:
    """J1 over the two per-sector aggregates (A3 without its display, A8 without its display)."""
    j = a3.join(a8, "sector", "full_outer")
    pipeline = F.coalesce(F.col("pipeline"), F.lit(0)).cast(X.SUM_MONEY_TYPE)
    backlog = F.coalesce(F.col("billing_backlog"), F.lit(0)).cast(X.SUM_MONEY_TYPE)
    return j.select(
        X.text_display("sector").alias("sector"),
        F.coalesce(F.col("deals"), F.lit(0)).cast("bigint").alias("deals"),
        pipeline.alias("pipeline"),
        X.money_display(pipeline).alias("pipeline_display"),
        F.coalesce(F.col("pipeline_share_pct"), F.lit(0.0)).alias("pipeline_share_pct"),
        F.coalesce(F.col("active_work_orders"), F.lit(0)).cast("bigint").alias("active_work_orders"),
        F.coalesce(F.col("total_work_orders"), F.lit(0)).cast("bigint").alias("total_work_orders"),
        backlog.alias("billing_backlog"),
        X.money_display(backlog).alias("billing_backlog_display"),
    )


def cross_board(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Pipeline and execution per sector; desc by (pipeline, backlog)."""
    return cross_order(cross_board_unordered(deals, work_orders))


def cross_order(j: DataFrame) -> DataFrame:
    return j.orderBy(F.col("pipeline").desc(), F.col("billing_backlog").desc(), F.col("sector").asc())


def backlog_order(j: DataFrame) -> DataFrame:
    return j.orderBy(F.col("billing_backlog").desc(), F.col("pipeline").desc(), F.col("sector").asc())


def execution_order(j: DataFrame) -> DataFrame:
    return j.orderBy(F.col("active_work_orders").desc(), F.col("pipeline").desc(),
                     F.col("billing_backlog").desc(), F.col("sector").asc())


def top_backlog_sectors(deals: DataFrame, work_orders: DataFrame, k: int = 5) -> DataFrame:
    """Sectors with the largest billing backlog (stable over the J1 order)."""
    return backlog_order(cross_board_unordered(deals, work_orders)).limit(k)


def top_execution_sectors(deals: DataFrame, work_orders: DataFrame, k: int = 5) -> DataFrame:
    """Sectors with the most active work orders (stable over the J1 order)."""
    return execution_order(cross_board_unordered(deals, work_orders)).limit(k)
