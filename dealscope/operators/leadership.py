"""Grouping sets of the leadership bundle (A9; the bundle itself: ``briefing``), signals (G1), decision radar (G2), KPI snapshot
(G5) and snapshot change detection (G6).

A9 reads each table once: open deals are first aggregated by
(sector, stage) and work orders by (sector, status), with partial
aggregation map-side; the GROUPING SETS ((x), (y), ()) roll-up then runs
over those few combination rows instead of expanding every input row.  One-row results are combined by union + global
aggregate (no join), and signals are a filtered ``inline`` of a struct
array on that single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import vocab
from ..functions.vocab import (
    MSG_BACKLOG, MSG_COMMERCIAL, MSG_CONC_HIGH, MSG_CONC_MEDIUM, MSG_FORECAST, MSG_RECEIVABLES,
    SNAPSHOT_KPIS,
)
from .filters import open_deals
from .operations import active_flag, completed_flag, financial_columns, money_or_zero, wo_kpi_aggs
from .sales import deal_value, pipeline_summary_with_leader, usable_probability


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row (union + max)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in u.columns])


# ---------------------------------------------------------------------------
# Grouping-set passes
# ---------------------------------------------------------------------------
def leadership_deals_sets(deals: DataFrame) -> DataFrame:
    """Open deals aggregated by sector, by stage and in total, in one pass."""
    od = open_deals(deals)
    v = deal_value(od)
    if v is None:
        v = F.lit(None).cast(X.MONEY_TYPE)
    prob = usable_probability(od)
    ok = prob[1] if prob else F.lit(False)
    pr = prob[0] if prob else F.lit(None).cast("double")
    sector = X.text_display("sector") if "sector" in od.columns else F.lit(vocab.UNKNOWN_LABEL)
    stage = X.text_display("deal_stage") if "deal_stage" in od.columns else F.lit(vocab.UNKNOWN_LABEL)
    base = od.select(sector.alias("sector"), stage.alias("stage"), v.alias("v"),
                     ok.alias("ok"), pr.alias("pr"))
    pairs = base.groupBy("sector", "stage").agg(
        F.count(F.lit(1)).alias("deals"),
        X.money_part("v").alias("pipeline"),
        F.count_if(F.col("v").isNotNull()).alias("deals_with_value"),
        F.count_if(F.col("ok")).alias("deals_with_probability"),
        X.money_part(F.when(F.col("ok"), F.col("v") * F.col("pr"))).alias("weighted_pipeline"),
    )
    g = pairs.groupingSets([["sector"], ["stage"], []], "sector", "stage").agg(
        F.grouping_id().alias("gid"),
        F.sum("deals").cast("bigint").alias("deals"),
        X.money_value(X.money_join("pipeline")).alias("pipeline"),
        F.sum("deals_with_value").cast("bigint").alias("deals_with_value"),
        F.sum("deals_with_probability").cast("bigint").alias("deals_with_probability"),
        X.money_value(X.money_join("weighted_pipeline")).alias("weighted_pipeline"),
    )
    level = F.when(F.col("gid") == 1, "sector").when(F.col("gid") == 2, "stage").otherwise("total")
    return g.select(level.alias("grouping"), F.coalesce("sector", "stage").alias("label"),
                    "deals", "pipeline", "deals_with_value", "deals_with_probability",
                    "weighted_pipeline")


def leadership_wo_sets(work_orders: DataFrame) -> DataFrame:
    """Work orders aggregated by sector, by status and in total, in one pass."""
    df = work_orders
    sector = X.text_display("sector") if "sector" in df.columns else F.lit(vocab.UNKNOWN_LABEL)
    status = X.text_display("execution_status") if "execution_status" in df.columns \
        else F.lit(vocab.UNKNOWN_LABEL)
    base = df.select(sector.alias("sector"), status.alias("status"),
                     active_flag(df).alias("active"), completed_flag(df).alias("completed"),
                     money_or_zero(df, "billed_value_incl").alias("billed"),
                     money_or_zero(df, "collected_amount").alias("collected"),
                     money_or_zero(df, "amount_to_be_billed_incl").alias("tbb"),
                     money_or_zero(df, "amount_receivable").alias("receivable"))
    pairs = base.groupBy("sector", "status").agg(
        F.count(F.lit(1)).alias("work_orders"),
        F.count_if("active").alias("active_work_orders"),
        F.count_if("completed").alias("completed_work_orders"),
        X.money_part("billed").alias("billed_value"),
        X.money_part("collected").alias("collected_amount"),
        X.money_part("tbb").alias("amount_to_be_billed"),
        X.money_part("receivable").alias("amount_receivable"),
    )
    g = pairs.groupingSets([["sector"], ["status"], []], "sector", "status").agg(
        F.grouping_id().alias("gid"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("work_orders", "active_work_orders", "completed_work_orders")],
        *[X.money_value(X.money_join(c)).alias(c) for c in ("billed_value", "collected_amount", "amount_to_be_billed", "amount_receivable")],
    )
    level = F.when(F.col("gid") == 1, "sector").when(F.col("gid") == 2, "status").otherwise("total")
    return g.select(level.alias("grouping"), F.coalesce("sector", "status").alias("label"),
                    "work_orders", "active_work_orders", "completed_work_orders", "billed_value",
                    "collected_amount", "amount_to_be_billed", "amount_receivable")


# ---------------------------------------------------------------------------
# G1: leadership signals
# ---------------------------------------------------------------------------
def kpi_row(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """One row: A1 totals with the leading sector's share (A3 row 1) from one
    pass over deals, and A5/A7 totals from one pass over work orders."""
    return kpis_of(pipeline_summary_with_leader(deals), work_orders.agg(*wo_kpi_aggs(work_orders)))


def kpis_of(summary: DataFrame, wo_totals: DataFrame) -> DataFrame:
    """The KPI row from A1 with its leader and the totals of the work orders."""
    ps = summary.select(
        "gross_pipeline", "weighted_pipeline", "open_deals", "deals_without_probability",
        "deals_missing_value", "top_sector_concentration_pct", "value_coverage_pct",
        "probability_coverage_pct", "top_sector", "top_share_pct")
    fin = wo_totals.select(
        *financial_columns(None), "active_work_orders", "total_work_orders").select(
        "billed_value", "collected_amount", "amount_to_be_billed", "amount_to_be_billed_display",
        "amount_receivable", "amount_receivable_display", "collection_rate_pct",
        "billing_backlog_ratio_pct", "active_work_orders", "total_work_orders")
    return combine_rows(ps, fin)




def signal_conditions() -> list[tuple[Column, str]]:
    """(condition, message) of each G1 signal, in the fixed order, over the KPI row."""
    share = F.coalesce(F.col("top_share_pct"), F.lit(0.0))
    has_top = F.col("top_sector").isNotNull()
    return [
        (has_top & (share >= 50), MSG_CONC_HIGH),
        (has_top & (share < 50) & (share >= 30), MSG_CONC_MEDIUM),
        (F.col("amount_receivable") > 0, MSG_RECEIVABLES),
        (F.col("amount_to_be_billed") > 0, MSG_BACKLOG),
        (F.col("deals_without_probability") > 0, MSG_FORECAST),
        (F.col("deals_missing_value") > 0, MSG_COMMERCIAL),
    ]


def _signal(order: int, cond: Column, typ: str, severity: str, message: str, *,
            sector: Column | None = None, share: Column | None = None,
            amount: Column | None = None, amount_display: Column | None = None,
            deals: Column | None = None) -> Column:
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    return F.when(cond, F.struct(
        F.lit(order).alias("signal_order"),
        F.lit(typ).alias("type"),
        F.lit(severity).alias("severity"),
        (sector if sector is not None else none_s).alias("sector"),
        (share if share is not None else none_d).alias("share_pct"),
        (amount if amount is not None else F.lit(None).cast(X.SUM_MONEY_TYPE)).alias("amount"),
        (amount_display if amount_display is not None else none_s).alias("amount_display"),
        (deals if deals is not None else F.lit(None).cast("bigint")).alias("deals"),
        F.lit(message).alias("message"),
    ))


def leadership_signals(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """G1: concentration, receivables, backlog and data-quality signals in fixed order."""
    return signals_of(kpi_row(deals, work_orders))


def signals_of(k: DataFrame) -> DataFrame:
    """G1 over the KPI row."""
    share = F.coalesce(F.col("top_share_pct"), F.lit(0.0))
    (c_high, _), (c_med, _), (c_rec, _), (c_tbb, _), (c_fc, _), (c_com, _) = signal_conditions()
    sigs = F.array(
        _signal(1, c_high, "pipeline_concentration", "high", MSG_CONC_HIGH,
                sector=F.col("top_sector"), share=share),
        _signal(1, c_med, "pipeline_concentration", "medium", MSG_CONC_MEDIUM,
                sector=F.col("top_sector"), share=share),
        _signal(2, c_rec, "receivables", "medium", MSG_RECEIVABLES,
                amount=F.col("amount_receivable"), amount_display=F.col("amount_receivable_display")),
        _signal(3, c_tbb, "billing_backlog", "medium", MSG_BACKLOG,
                amount=F.col("amount_to_be_billed"), amount_display=F.col("amount_to_be_billed_display")),
        _signal(4, c_fc, "forecast_quality", "medium", MSG_FORECAST, deals=F.col("deals_without_probability")),
        _signal(5, c_com, "commercial_data_quality", "medium", MSG_COMMERCIAL,
                deals=F.col("deals_missing_value")),
    )
    return k.select(F.inline(F.array_compact(sigs)))


# ---------------------------------------------------------------------------
# Radar and KPI snapshot
# ---------------------------------------------------------------------------
def _radar(pos: int, signal: str, value: Column, status: Column) -> Column:
    return F.struct(F.lit(pos).alias("position"), F.lit(signal).alias("signal"),
                    value.alias("value"), status.alias("status"))


def decision_radar(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Four signals with value and band."""
    k = kpi_row(deals, work_orders)
    conf = X.confidence("value_coverage_pct", "probability_coverage_pct")
    rows = F.array(
        _radar(1, vocab.RADAR_SIGNALS[0], X.safe_float("top_sector_concentration_pct"),
               X.band_concentration("top_sector_concentration_pct")),
        _radar(2, vocab.RADAR_SIGNALS[1], X.safe_float("collection_rate_pct"),
               X.band_collection("collection_rate_pct")),
        _radar(3, vocab.RADAR_SIGNALS[2], X.safe_float("billing_backlog_ratio_pct"),
               X.band_backlog("billing_backlog_ratio_pct")),
        _radar(4, vocab.RADAR_SIGNALS[3], conf, X.band_confidence(conf)),
    )
    return k.select(F.inline(rows))


def kpi_snapshot(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """The five KPIs kept for change detection."""
    return kpi_row(deals, work_orders).select(
        "gross_pipeline", "weighted_pipeline", "open_deals", "active_work_orders",
        F.col("amount_receivable").alias("receivable"))


# ---------------------------------------------------------------------------
# Change detection over a snapshots table
# ---------------------------------------------------------------------------
def _change_display(delta: Column, is_money: bool) -> Column:
    mag = F.abs(delta.cast("double"))
    body = X.money_display_signed(mag) if is_money else F.format_number(mag, 0)
    prefix = F.when(delta > 0, F.lit("+")).when(delta < 0, F.lit(vocab.MINUS_SIGN)).otherwise(F.lit(""))
    return F.concat(prefix, body)


def snapshot_delta(snapshots: DataFrame, order_by: str = "snapshot_date",
                   partition_by: list[str] | None = None) -> DataFrame:
    """Current minus previous snapshot for the five KPIs, per dimension.

    ``lag`` runs over a window partitioned by the dimension columns, so each
    series is processed by its own task.
    """
    w = Window.partitionBy(*(partition_by or [])).orderBy(order_by)
    return _with_changes(snapshots, snapshots, lambda k: F.lag(k).over(w))


def _with_changes(df: DataFrame, snapshots: DataFrame, previous) -> DataFrame:
    """The columns of ``snapshots`` and each KPI's change against ``previous(kpi)``, over ``df``."""
    out = [F.col(f"`{c}`") for c in snapshots.columns]
    types = dict(snapshots.dtypes)
    for kpi, label, is_money in SNAPSHOT_KPIS:
        prev = previous(kpi)
        delta = (F.col(kpi) - prev).cast(types[kpi])
        out.append(delta.alias(f"{kpi}_change"))
        out.append(F.when(prev.isNotNull(), _change_display(delta, is_money)).alias(f"{kpi}_change_display"))
    return df.select(*out)


def _order_key(column: Column, dtype: T.DataType) -> Column:
    """A number or date that never falls where ``column`` rises; texts by their first seven bytes."""
    if isinstance(dtype, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("decimal(20,0)").cast("bigint")
    return column


def snapshot_changes(snapshots: DataFrame, order_by: str, ranges: int = 200) -> DataFrame:
    """G6 over one long series without dimensions, spread over all tasks.

    The columns and values of ``snapshot_delta``.  The series is cut into at
    most ``ranges`` ranges of ``order_by`` at its approximate quantiles;
    ``lag`` runs inside each range, and a range's first snapshot takes its
    predecessor from the last rows of the ranges before it (one row a range,
    so at most ``ranges`` rows are gathered).  ``order_by`` (number, date,
    time or text) identifies a snapshot; null comes first, as in a sort, and
    among equal values the order is open.  ``snapshots`` is read three times:
    give it as a stored table where it is costly.
    """
    key = _order_key(F.col(order_by), snapshots.schema[order_by].dataType)
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = snapshots.agg(F.percentile_approx(key, steps, F.lit(100 * ranges))).scalar()
    # A key's first place among the sorted cuts numbers its range.
    number = F.array_position(F.sort_array(F.array_append(cuts, key)), key)
    ranged = snapshots.withColumn("_range", F.when(F.col(order_by).isNull(), F.lit(0)).otherwise(number))
    kpis = F.struct(*[F.col(k) for k, _, _ in SNAPSHOT_KPIS])
    last = ranged.groupBy("_range").agg(F.max_by(kpis, F.struct(F.col(order_by))).alias("_last"))
    ends = last.agg(F.sort_array(F.collect_list(F.struct("_range", "_last"))).alias("e")).scalar()
    place = F.array_position(ends["_range"], F.col("_range"))
    before = F.get(ends["_last"], (place - 2).cast("int"))
    w = Window.partitionBy("_range").orderBy(order_by)
    prev = F.coalesce(F.lag(kpis).over(w), before)
    return _with_changes(ranged.withColumn("_prev", prev), snapshots, lambda k: F.col("_prev")[k])


def _kpis_by(deals: DataFrame, deal_keys: list[Column], work_orders: DataFrame,
             wo_keys: list[Column], names: list[str]) -> DataFrame:
    """The five G5 KPIs per group: one aggregation per board (partial
    aggregation, so a hot group is as cheap as any), then a full outer join
    of the two aggregates on the group columns."""
    od = open_deals(deals)
    v = deal_value(od)
    if v is None:
        v = F.lit(None).cast(X.MONEY_TYPE)
    prob = usable_probability(od)
    ok, pr = (prob[1], prob[0]) if prob else (F.lit(False), F.lit(None).cast("double"))
    d = od.groupBy(*[k.alias(n) for k, n in zip(deal_keys, names)]).agg(
        X.money_sum(v).alias("gross_pipeline"),
        X.money_sum(F.when(ok, v * pr)).alias("weighted_pipeline"),
        F.count(F.lit(1)).alias("open_deals"))
    wo = work_orders
    w = wo.groupBy(*[k.alias(n) for k, n in zip(wo_keys, names)]).agg(
        F.count_if(active_flag(wo)).alias("active_work_orders"),
        X.money_sum(money_or_zero(wo, "amount_receivable")).alias("receivable"))
    j = d.join(w, names, "full_outer")
    return j.select(
        *names,
        F.coalesce("gross_pipeline", F.lit(0).cast(X.SUM_MONEY_TYPE)).alias("gross_pipeline"),
        F.coalesce("weighted_pipeline", F.lit(0).cast(X.WEIGHTED_TYPE)).alias("weighted_pipeline"),
        F.coalesce("open_deals", F.lit(0).cast("bigint")).alias("open_deals"),
        F.coalesce("active_work_orders", F.lit(0).cast("bigint")).alias("active_work_orders"),
        F.coalesce("receivable", F.lit(0).cast(X.SUM_MONEY_TYPE)).alias("receivable"),
    )


def monthly_snapshots(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Monthly KPI series per sector derived from the boards.

    Deal KPIs by month of ``created_date`` (open deals), work-order KPIs by
    month of ``po_date``; both are aggregated before a full outer join on
    (sector, month).
    """
    j = _kpis_by(deals, [X.text_display("sector"), F.trunc("created_date", "month")],
                 work_orders, [X.text_display("sector"), F.trunc("po_date", "month")],
                 ["sector", "snapshot_date"])
    return j.filter(F.col("snapshot_date").isNotNull())


def snapshots_by(deals: DataFrame, work_orders: DataFrame, keys: list[str]) -> DataFrame:
    """G5 for many snapshots at once: the five KPIs per value of ``keys``
    (e.g. one row per export), equal to ``kpi_snapshot`` of each group."""
    return _kpis_by(deals, [F.col(k) for k in keys], work_orders, [F.col(k) for k in keys], keys)
