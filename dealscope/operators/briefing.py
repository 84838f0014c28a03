"""The leadership bundle (A9) from one pass over each board.

Open deals are aggregated by (sector, stage) and work orders by (sector,
status), with partial aggregation on the map side, and these two small
tables of cells are written into the shared folder.  Every part of the
briefing is a projection or a further grouping of the cells, so each board
is scanned once, whatever the number of parts; money stays an exact part
(``money_part``) until a part of the briefing rounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import vocab
from ..session import checkpoint_dir, materialize_table, run_concurrently
from .cross import backlog_order, cross_order, execution_order, join_sectors
from .filters import open_deals
from .leadership import kpis_of, signals_of
from .operations import active_flag, completed_flag, financial_columns, summary_columns, wo_kpi_aggs
from .quality import quality_report
from .sales import (
    SUMMARY_COLUMNS, deal_value, ordered, pipeline_summary_with_leader, summary_select, summary_totals,
    usable_probability, with_shares,
)

TOP_SECTORS, TOP_STAGES = 5, 8  # fixed lengths of the briefing's lists


def _label(df: DataFrame, column: str) -> Column:
    return X.text_display(column) if column in df.columns else F.lit(vocab.UNKNOWN_LABEL)


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _norm_key(df: DataFrame, norm: bool) -> list[Column]:
    return [(X.text_norm("sector") if "sector" in df.columns else F.lit("")).alias("_ns")] if norm else []


def deal_cells(deals: DataFrame, flags: tuple[Column, ...] = (), norm: bool = False) -> DataFrame:
    """Open deals by display sector and stage: counts, gross and weighted pipeline as exact parts.

    Without a value, probability or sector column its counts are 0.  Rows are
    grouped by the texts as they are; labels are formed once a group.
    ``flags``: further keys; ``norm``: the normalized sector as a key, ``_ns``.
    """
    od = open_deals(deals)
    v = deal_value(od)
    v = F.lit(None).cast(X.MONEY_TYPE) if v is None else v
    p, ok = usable_probability(od) or (F.lit(None).cast("double"), F.lit(False))
    weighted = ok & v.isNotNull()
    texts = [F.col(c) for c in ("sector", "deal_stage") if c in od.columns]
    rows = od.groupBy(*texts, *flags).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("n_value"), F.count_if(ok).alias("n_prob"), F.count_if(weighted).alias("n_weighted"),
        X.money_part(v).alias("gross"), X.money_part(F.when(weighted, v * p)).alias("weighted"))
    rows = rows.filter(F.col("n") > 0)  # no keys at all: one row even for an empty board
    own = [F.col(c) for c in rows.columns if c.startswith("_f")]
    unknown = (X.text_norm("sector") == "") if "sector" in od.columns else F.lit(False)
    n = F.col("n")
    return rows.groupBy(_label(rows, "sector").alias("sector"), _label(rows, "deal_stage").alias("stage"), *_norm_key(rows, norm), *own).agg(
        *[_sum(n).alias(c) for c in ("n", "n_open", "n_sector")], *[_sum(F.col(c)).alias(c) for c in ("n_value", "n_prob", "n_weighted")],
        _sum(F.when(unknown, n)).alias("n_unknown"), *[X.money_join(c).alias(c) for c in ("gross", "weighted")])


def work_order_cells(work_orders: DataFrame, norm: bool = False) -> DataFrame:
    """Work orders by display sector and status: counts and money as exact parts (``norm``: see ``deal_cells``)."""
    texts = [F.col(c) for c in ("sector", "execution_status") if c in work_orders.columns]
    kpis = wo_kpi_aggs(work_orders, X.money_part)
    rows = work_orders.groupBy(*texts).agg(kpis[0], *kpis[len(COUNTS):]).filter(F.col("total_work_orders") > 0)
    n = F.col("total_work_orders")
    return rows.groupBy(_label(rows, "sector").alias("sector"), _label(rows, "execution_status").alias("status"), *_norm_key(rows, norm)).agg(
        _sum(n).alias("total_work_orders"), _sum(F.when(active_flag(rows), n)).alias("active_work_orders"),
        _sum(F.when(completed_flag(rows), n)).alias("completed_work_orders"), *[X.money_join(c).alias(c) for c in MONEY])


COUNTS = ("total_work_orders", "active_work_orders", "completed_work_orders")
MONEY = ("billed_value", "collected_amount", "amount_to_be_billed", "amount_receivable")


def frames_of(deal_rows: DataFrame, wo_rows: DataFrame, deals: DataFrame, work_orders: DataFrame) -> dict[str, DataFrame]:
    """What the briefing and the batch answers are made of, from the two boards' cells (unordered).

    Of the boards only the columns are looked at, but for the summary of
    deals without a value column, which has another form.
    """
    has_value, has_sector = "deal_value" in deals.columns, "sector" in deals.columns

    def pipeline_by(label, present=True, has_key=True):
        g = with_shares(deal_rows.groupBy(label).agg(
            F.sum("n").cast("bigint").alias("deals"), X.money_value(X.money_join("gross")).alias("pipeline")), label, has_key)
        return g if present and has_value else g.limit(0)

    per_sector = deal_rows.withColumnRenamed("sector", "_group")
    groups = per_sector.groupBy("_group").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_open", "n_sector", "n_value", "n_prob", "n_weighted", "n_unknown")],
        *[X.money_join(c).alias(c) for c in ("gross", "weighted")])
    summary = summary_select(summary_totals(groups), F.lit(vocab.ALL_SECTORS), F.lit(vocab.ALL_PERIODS), F.lit(None), F.lit(None),
                             has_sector, leader=True) if has_value else pipeline_summary_with_leader(deals)
    work = wo_rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
                       *[X.money_value(X.money_join(c)).alias(c) for c in MONEY])
    sectors = pipeline_by("sector", has_key=has_sector)
    stages = pipeline_by("stage", "deal_stage" in deals.columns)
    known = F.lit("sector" in work_orders.columns)
    by_sector = wo_rows.groupBy("sector").agg(
        F.sum(F.when(known, F.col("active_work_orders")).otherwise(0)).cast("bigint").alias("active_work_orders"),
        F.sum("total_work_orders").cast("bigint").alias("total_work_orders"),
        F.when(known, X.money_value(X.money_join("amount_to_be_billed"))).otherwise(0.0).alias("billing_backlog"))
    statuses = wo_rows.groupBy("status").agg(F.sum("total_work_orders").cast("bigint").alias("work_orders"))
    return {
        "summary": summary, "work": work, "sectors": sectors, "stages": stages,
        "statuses": statuses if "execution_status" in work_orders.columns else statuses.limit(0),
        "both": join_sectors(sectors.drop("pipeline_display"), by_sector),
    }


def briefing_of(deal_rows: DataFrame, wo_rows: DataFrame, deals: DataFrame, work_orders: DataFrame) -> dict[str, DataFrame]:
    """The parts of the briefing from the two boards' cells."""
    f = frames_of(deal_rows, wo_rows, deals, work_orders)
    return {
        "pipeline": f["summary"].select(*SUMMARY_COLUMNS),
        "top_sectors": ordered(f["sectors"], "pipeline", "sector").limit(TOP_SECTORS),
        "pipeline_stages": ordered(f["stages"], "pipeline", "stage").limit(TOP_STAGES),
        "operations": f["work"].select(*summary_columns(None)),
        "status_breakdown": ordered(f["statuses"], "work_orders", "status"),
        "financials": f["work"].select(*financial_columns(None)),
        "cross_board": cross_order(f["both"]),
        "top_billing_backlog_sectors": backlog_order(f["both"]).limit(TOP_SECTORS),
        "top_execution_sectors": execution_order(f["both"]).limit(TOP_SECTORS),
        "leadership_signals": signals_of(kpis_of(f["summary"], f["work"])),
    }


def _parts(deals: DataFrame, work_orders: DataFrame) -> dict[str, DataFrame]:
    checkpoint_dir(deals.sparkSession)
    cells = run_concurrently(lambda: materialize_table(deal_cells(deals)), lambda: materialize_table(work_order_cells(work_orders)))
    return briefing_of(*cells, deals, work_orders)


def leadership_update(deals: DataFrame, work_orders: DataFrame, reuse: bool = False) -> dict[str, DataFrame]:
    """The whole briefing as named DataFrames, the quality report included.

    Two jobs run while the plans are built: each board's cells.  With
    ``reuse=True`` the two cleaned boards are written into the shared folder
    first, for the quality report reads them again.
    """
    if reuse:
        deals, work_orders = materialize_table(deals), materialize_table(work_orders)
    return {**_parts(deals, work_orders), "quality": quality_report(deals, work_orders)}


# Lists of the briefing: label, and the order that numbers their rows (none: unnumbered).
LISTS = {
    "top_sectors": ("sector", (("pipeline", -1), ("sector", 1))),
    "pipeline_stages": ("stage", (("pipeline", -1), ("stage", 1))),
    "status_breakdown": ("status", None),
    "cross_board": ("sector", None),
    "top_billing_backlog_sectors": ("sector", (("billing_backlog", -1), ("pipeline", -1), ("sector", 1))),
    "top_execution_sectors": ("sector", (("active_work_orders", -1), ("pipeline", -1), ("billing_backlog", -1), ("sector", 1))),
    "leadership_signals": ("type", (("signal_order", 1),)),
}


def _long(part: str, df: DataFrame) -> DataFrame:
    """A part of the briefing in long form; a numbered list has at most eight rows."""
    label, order = LISTS.get(part, (None, None))
    position = F.lit(None).cast("int")
    if order:
        keys = [(F.col(c) if way > 0 else -F.col(c)).alias(f"_o{i}") for i, (c, way) in enumerate(order)]
        listed = df.agg(F.sort_array(F.collect_list(F.struct(*keys, *[F.col(c) for c in df.columns]))).alias("rows"))
        df = listed.select(F.posexplode("rows").alias("_p", "_r")).select((F.col("_p") + 1).alias("_p"), "_r.*").drop(
            *[f"_o{i}" for i in range(len(order))])
        position = F.col("_p")
    metrics = []
    for f in df.schema.fields:
        if f.name in ("_p", label):
            continue
        text = isinstance(f.dataType, T.StringType)
        metrics.append(F.struct(F.lit(f.name).alias("metric"), (F.lit(None) if text else F.col(f.name)).cast("double").alias("value"),
                                (F.col(f.name) if text else F.lit(None)).cast("string").alias("text")))
    return df.select(F.lit(part).alias("part"), position.alias("position"),
                     (F.col(label) if label else F.lit(None)).cast("string").alias("label"), F.inline(F.array(*metrics)))


def leadership_bundle(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """A9 as one table: part, position in its list, label, metric and its value or text.

    Each board is scanned once.  The quality report, which the briefing only
    carries along, is left to ``quality_report``.
    """
    parts = [_long(name, df) for name, df in _parts(deals, work_orders).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
