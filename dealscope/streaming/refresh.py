"""Board refresh as a stream: landed exports -> KPI snapshots -> deltas.

The dashboard re-pulls both boards periodically and reports what changed
since the previous refresh.  Here every refresh is an *export*: its page
files (JSON, the landed page shape plus ``export_id``, ``exported_at`` and
``board``) arrive in a landing folder.  A file-source stream picks them up;
``foreachBatch`` turns every export in the micro-batch into one KPI
snapshot row (G5) with one grouped job (the KPIs are aggregated per
``export_id``; no loop over exports on the driver) and writes the rows to a
snapshot table partitioned by ``export_id`` and ``batch_id`` with dynamic
partition overwrite.  The five KPIs add up, so the pages of one export may
arrive in several micro-batches: each leaves its part, a replayed batch
rewrites only its own, and ``snapshots`` sums the parts of an export.
Change detection (G6) is a ``lag`` over these sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import expr as X
from ..operators import clean, leadership
from ..sources import board

EXPORT_PAGE = T.StructType(
    [T.StructField("export_id", T.StringType()), T.StructField("exported_at", T.TimestampType()),
     T.StructField("board", T.StringType())] + list(board.PAGE.fields)
)
DEALS_BOARD, WORK_ORDERS_BOARD = "deals", "work_orders"


EXPORT_KEY = ("export_id",)


def _board_items(pages: DataFrame, board_name: str) -> DataFrame:
    return (pages.filter(F.col("board") == board_name)
            .select("export_id", F.explode("items").alias("i")).select("export_id", "i.*"))


def export_snapshots(pages: DataFrame, deal_columns: DataFrame, wo_columns: DataFrame) -> DataFrame:
    """KPI snapshot per export in ``pages`` (both boards), one row per export.

    Items keep their ``export_id`` through ingestion and cleaning; the five
    KPIs are aggregated per export (G5 per group).  An export whose boards
    hold no items still gets its row, with zero KPIs.
    """
    deals = clean.clean_deals(board.board_items_to_table(
        _board_items(pages, DEALS_BOARD), deal_columns, other=None, keep=EXPORT_KEY), keep=EXPORT_KEY)
    wos = clean.clean_work_orders(board.board_items_to_table(
        _board_items(pages, WORK_ORDERS_BOARD), wo_columns, other=None, keep=EXPORT_KEY), keep=EXPORT_KEY)
    kpis = leadership.snapshots_by(deals, wos, list(EXPORT_KEY))
    exports = pages.groupBy("export_id").agg(F.max("exported_at").alias("exported_at"))
    zero = {"gross_pipeline": X.SUM_MONEY_TYPE, "weighted_pipeline": X.WEIGHTED_TYPE, "open_deals": "bigint",
            "active_work_orders": "bigint", "receivable": X.SUM_MONEY_TYPE}
    return exports.join(kpis, "export_id", "left").select(
        "exported_at", *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in zero.items()],
        "export_id")


def start_refresh(
    spark: SparkSession,
    landing_dir: str,
    deal_columns: DataFrame,
    wo_columns: DataFrame,
    snapshot_path: str,
    checkpoint_path: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the refresh stream; returns the running query."""
    deal_columns = deal_columns.select("column_id", "title").cache()
    wo_columns = wo_columns.select("column_id", "title").cache()

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by both boards' branches and the export list
        try:
            part = export_snapshots(batch, deal_columns, wo_columns).withColumn("batch_id", F.lit(batch_id))
            (part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("export_id", "batch_id").parquet(snapshot_path))
        finally:
            batch.unpersist()

    reader = spark.readStream.schema(EXPORT_PAGE).json(landing_dir)
    writer = reader.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 seconds")
    return writer.start()


def snapshots(spark: SparkSession, snapshot_path: str) -> DataFrame:
    """One KPI row per export: the sum of the parts its micro-batches left."""
    parts = spark.read.parquet(snapshot_path)
    kpis = [c for c in parts.columns if c not in ("exported_at", "export_id", "batch_id")]
    types = dict(parts.dtypes)
    return parts.groupBy("export_id").agg(
        F.max("exported_at").alias("exported_at"), *((X.money_sum(c) if types[c] == "double" else F.sum(c).cast(types[c])).alias(c) for c in kpis))


def snapshot_changes(spark: SparkSession, snapshot_path: str) -> DataFrame:
    """G6 over the snapshot table: change since the previous export, range by range."""
    return leadership.snapshot_changes(snapshots(spark, snapshot_path), order_by="exported_at")
