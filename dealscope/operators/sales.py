"""Sales-pipeline operators: A1 summary, A2 concentration, A3/A4 grouped
pipeline, G3 remove-a-sector scenario, T3/T5 top-k.

Every operator is one aggregation over the deals table with conditional
aggregates (``count_if`` / ``sum(when)``), so the table is scanned once
and pre-aggregated map-side before the shuffle; a hot sector holding a
third of all rows collapses to one partial row per task.  Totals that a
grouped row must be divided by come from a scalar subquery (a global,
partially-aggregated sum) instead of an unpartitioned window.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import vocab
from ..functions.vocab import (
    MSG_NO_SECTOR_COLUMN, MSG_NO_SECTOR_MATCH, MSG_NO_VALUE_COLUMN, WARN_MONTH, WARN_QUARTER,
    WARN_QUARTER_MISSING, WARN_YEAR,
)
from ..plans.scalars import leader, scalar
from .filters import TRUE, open_deals, period_kind, period_predicate, sector_predicate


SUMMARY_COLUMNS = [
    "metric", "sector", "period", "open_deals", "gross_pipeline", "gross_pipeline_display",
    "weighted_pipeline", "weighted_pipeline_display", "deals_without_probability",
    "deals_missing_value", "unknown_sector_deals", "weighted_deal_count",
    "top_sector_concentration_pct", "open_deals_before_filters", "after_sector_filter",
    "deals_after_filters", "deals_with_value", "deals_used_for_weighted_pipeline",
    "value_coverage_pct", "probability_coverage_pct", "period_warning", "message",
]


def deal_value(df: DataFrame) -> Column | None:
    if "deal_value" not in df.columns:
        return None
    return F.col("deal_value").try_cast(X.MONEY_TYPE)


def usable_probability(df: DataFrame) -> tuple[Column, Column] | None:
    """(probability rescaled to 0..1, availability flag) or None."""
    if "probability_numeric" not in df.columns:
        return None
    p0 = F.col("probability_numeric").try_cast("double")
    p = F.when(p0 <= 1, p0).otherwise(p0 / 100)
    return p, (p.isNotNull() & p.between(0, 1))


def _lit_str(v: str | None) -> Column:
    return F.lit(v).cast("string")


def _sum0(c: Column, typ: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(typ)


def pipeline_summary(
    deals: DataFrame,
    sector: str | None = None,
    period: str | None = None,
    as_of: _dt.date | str | None = None,
) -> DataFrame:
    """A1: one-row KPI set over open deals after sector and period filters.

    The three filter stages are counted with nested predicates in the same
    pass, so the table is read once.
    """
    return _summary(deals, sector, period, as_of, leader=False)


def pipeline_summary_with_leader(deals: DataFrame) -> DataFrame:
    """A1 (unfiltered) plus the leading sector and its share of pipeline
    (row 1 of A3), from the same single pass."""
    return _summary(deals, None, None, None, leader=True)


def _summary(deals, sector, period, as_of, leader: bool) -> DataFrame:
    cols = deals.columns
    od = open_deals(deals)
    has_sector = "sector" in cols
    sector_label = _lit_str(sector or vocab.ALL_SECTORS)
    period_label = _lit_str(period or vocab.ALL_PERIODS)

    no_leader = [F.lit(None).cast("string").alias("top_sector"),
                 F.lit(None).cast("double").alias("top_share_pct")] if leader else []
    if sector and not has_sector:
        return od.agg(F.count(F.lit(1)).alias("open_deals_before_filters")).select(
            *_short_result(sector_label, period_label, F.lit(0).cast("bigint"),
                           None, MSG_NO_SECTOR_COLUMN, F.col("open_deals_before_filters")),
            *no_leader)

    s = sector_predicate(od, sector)
    kind = period_kind(period)
    warning = None
    p = TRUE()
    if kind is not None:
        if "tentative_close_date" in cols:
            p = period_predicate(od, "tentative_close_date", period, as_of)
            warning = {"quarter": WARN_QUARTER, "month": WARN_MONTH, "year": WARN_YEAR}[kind]
        elif kind == "quarter":
            warning = WARN_QUARTER_MISSING
    f = s & p

    v = deal_value(od)
    if v is None:
        agg = od.agg(F.count_if(f).alias("n"), F.count(F.lit(1)).alias("n_open"))
        return agg.select(*_short_result(sector_label, period_label, F.col("n"), warning,
                                         MSG_NO_VALUE_COLUMN, F.col("n_open")), *no_leader)

    prob = usable_probability(od)
    vnn = v.isNotNull()
    key = X.text_display("sector") if has_sector else F.lit(vocab.UNKNOWN_LABEL)
    level1 = [
        F.count(F.lit(1)).alias("n_open"),
        F.count_if(s).alias("n_sector"),
        F.count_if(f).alias("n"),
        F.count_if(f & vnn).alias("n_value"),
        X.money_part(F.when(f, v)).alias("gross"),
    ]
    if prob is not None:
        pr, ok = prob
        w = f & ok & vnn
        level1 += [
            F.count_if(f & ok).alias("n_prob"),
            F.count_if(w).alias("n_weighted"),
            X.money_part(F.when(w, v * pr)).alias("weighted"),
        ]
    else:
        level1 += [F.lit(0).cast("bigint").alias("n_prob"), F.lit(0).cast("bigint").alias("n_weighted"),
                   F.lit(None).cast(X.PART_TYPE).alias("weighted")]
    if has_sector:
        level1.append(F.count_if(f & (X.text_norm("sector") == "")).alias("n_unknown"))
    else:
        level1.append(F.lit(0).cast("bigint").alias("n_unknown"))

    per_group = od.groupBy(key.alias("_group")).agg(*level1)
    tot = summary_totals(per_group)
    message = (F.when(F.col("n") == 0, F.lit(MSG_NO_SECTOR_MATCH.format(sector=sector)))
               if sector else F.lit(None))
    return summary_select(tot, sector_label, period_label, _lit_str(warning), message, has_sector, leader)


def summary_totals(per_group: DataFrame) -> DataFrame:
    """A1's totals row over one row a sector (``_group``, counts, ``gross`` and ``weighted`` as parts)."""
    gross = X.money_value(F.col("gross"))
    return per_group.agg(
        *[_sum0(F.col(c), "bigint").alias(c)
          for c in ("n_open", "n_sector", "n", "n_value", "n_prob", "n_weighted", "n_unknown")],
        X.money_value(X.money_join("gross")).alias("gross"),
        X.money_value(X.money_join("weighted")).alias("weighted"),
        F.max(gross).alias("top_group"),
        F.min_by(F.col("_group"), F.struct((-gross).alias("v"), F.col("_group").alias("g"))).alias("top_group_label"),
    )


def summary_select(tot: DataFrame, sector_label: Column, period_label: Column, warning: Column,
                   message: Column, has_sector: bool, leader: bool = False) -> DataFrame:
    """A1's output columns over the totals row(s) (``n``, ``gross``, ... ``top_group``)."""
    n = F.col("n")
    gross = F.col("gross")
    conc = (F.when((gross > 0) & F.lit(has_sector), X.safe_pct(F.col("top_group"), gross))
            .otherwise(F.lit(0.0)))
    return tot.select(
        F.lit(vocab.METRIC_PIPELINE).alias("metric"),
        sector_label.alias("sector"),
        period_label.alias("period"),
        n.alias("open_deals"),
        gross.alias("gross_pipeline"),
        X.money_display(gross).alias("gross_pipeline_display"),
        F.col("weighted").alias("weighted_pipeline"),
        X.money_display(F.col("weighted")).alias("weighted_pipeline_display"),
        (n - F.col("n_prob")).alias("deals_without_probability"),
        (n - F.col("n_value")).alias("deals_missing_value"),
        F.col("n_unknown").alias("unknown_sector_deals"),
        F.col("n_weighted").alias("weighted_deal_count"),
        conc.alias("top_sector_concentration_pct"),
        F.col("n_open").alias("open_deals_before_filters"),
        F.col("n_sector").alias("after_sector_filter"),
        n.alias("deals_after_filters"),
        F.col("n_value").alias("deals_with_value"),
        F.col("n_weighted").alias("deals_used_for_weighted_pipeline"),
        X.safe_pct(F.col("n_value"), n).alias("value_coverage_pct"),
        X.safe_pct(F.col("n_prob"), n).alias("probability_coverage_pct"),
        warning.cast("string").alias("period_warning"),
        message.cast("string").alias("message"),
        *([F.col("top_group_label").alias("top_sector"),
           (X.safe_pct(F.col("top_group"), gross) if has_sector else F.lit(None).cast("double"))
           .alias("top_share_pct")] if leader else []),
        *[F.col(c) for c in tot.columns if c.startswith("grid_")],
    )


def _short_result(sector_label, period_label, n, warning, message, n_open):
    """Fixed-schema form of the reference's shortened results (ledger L9/L10)."""
    zero_l = F.lit(0).cast("bigint")
    return [
        F.lit(vocab.METRIC_PIPELINE).alias("metric"),
        sector_label.alias("sector"),
        period_label.alias("period"),
        n.cast("bigint").alias("open_deals"),
        F.lit(0).cast(X.SUM_MONEY_TYPE).alias("gross_pipeline"),
        F.lit(vocab.RUPEE + "0").alias("gross_pipeline_display"),
        F.lit(0).cast(X.WEIGHTED_TYPE).alias("weighted_pipeline"),
        F.lit(vocab.RUPEE + "0").alias("weighted_pipeline_display"),
        n.cast("bigint").alias("deals_without_probability"),
        n.cast("bigint").alias("deals_missing_value"),
        zero_l.alias("unknown_sector_deals"),
        zero_l.alias("weighted_deal_count"),
        F.lit(0.0).alias("top_sector_concentration_pct"),
        n_open.cast("bigint").alias("open_deals_before_filters"),
        n.cast("bigint").alias("after_sector_filter"),
        n.cast("bigint").alias("deals_after_filters"),
        zero_l.alias("deals_with_value"),
        zero_l.alias("deals_used_for_weighted_pipeline"),
        F.lit(0.0).alias("value_coverage_pct"),
        F.lit(0.0).alias("probability_coverage_pct"),
        _lit_str(warning).alias("period_warning"),
        _lit_str(message).alias("message"),
    ]


# ---------------------------------------------------------------------------
# A3 / A4: grouped pipeline
# ---------------------------------------------------------------------------
def _grouped_pipeline(deals: DataFrame, key_column: str, label: str) -> DataFrame:
    od = open_deals(deals)
    v = deal_value(od)
    if v is None or (label == "stage" and key_column not in od.columns):
        return _empty_grouped(deals, label)
    has_key = key_column in od.columns
    key = X.text_display(key_column) if has_key else F.lit(vocab.UNKNOWN_LABEL)
    g = od.groupBy(key.alias(label)).agg(
        F.count(F.lit(1)).alias("deals"),
        X.money_sum(v).alias("pipeline"),
    )
    return with_shares(g, label, has_key)


def with_shares(g: DataFrame, label: str, has_key: bool = True) -> DataFrame:
    """A3's and A4's output columns over ``label``, ``deals`` and ``pipeline``, one row a group."""
    total = scalar(g, X.money_sum("pipeline"))
    share = X.safe_pct(F.col("pipeline"), total) if has_key else F.lit(None).cast("double")
    return g.select(
        label, "deals", "pipeline",
        X.money_display("pipeline").alias("pipeline_display"),
        share.alias("pipeline_share_pct"),
    )


def _empty_grouped(deals: DataFrame, label: str) -> DataFrame:
    return deals.limit(0).select(
        F.lit(None).cast("string").alias(label),
        F.lit(None).cast("bigint").alias("deals"),
        F.lit(None).cast(X.SUM_MONEY_TYPE).alias("pipeline"),
        F.lit(None).cast("string").alias("pipeline_display"),
        F.lit(None).cast("double").alias("pipeline_share_pct"),
    )


def ordered(df: DataFrame, value: str, label: str) -> DataFrame:
    """T4 ordering: value descending, ties by label ascending (ledger L13)."""
    return df.orderBy(F.col(value).desc(), F.col(label).asc())


def pipeline_by_sector(deals: DataFrame) -> DataFrame:
    """A3: open deals per display sector (value-less deals count, add 0)."""
    return ordered(_grouped_pipeline(deals, "sector", "sector"), "pipeline", "sector")


def pipeline_by_stage(deals: DataFrame) -> DataFrame:
    """A4: open deals per display stage."""
    return ordered(_grouped_pipeline(deals, "deal_stage", "stage"), "pipeline", "stage")


def top_sectors(deals: DataFrame, k: int = 5) -> DataFrame:
    """The leading sectors by pipeline (top-k report)."""
    return pipeline_by_sector(deals).limit(k)


def top_stages(deals: DataFrame, k: int = 8) -> DataFrame:
    """The leading stages by pipeline (top-k report)."""
    return pipeline_by_stage(deals).limit(k)


def largest_sector(deals: DataFrame) -> DataFrame:
    """T5: the first row of the sector ranking."""
    return pipeline_by_sector(deals).limit(1)


def sector_concentration(deals: DataFrame) -> DataFrame:
    """A2: the top sector's share of gross open pipeline (0 when gross <= 0)."""
    g = _grouped_pipeline(deals, "sector", "sector")
    return g.agg(
        F.min_by(F.col("sector"), F.struct((-F.col("pipeline")).alias("v"), F.col("sector"))).alias("top_sector"),
        F.max("pipeline").alias("top_sector_pipeline"),
        X.money_sum("pipeline").alias("gross_pipeline"),
    ).select(
        "top_sector", "top_sector_pipeline", "gross_pipeline",
        F.when(F.col("gross_pipeline") > 0,
               X.safe_pct(F.col("top_sector_pipeline"), F.col("gross_pipeline")))
        .otherwise(F.lit(0.0)).alias("concentration_pct"),
    )


def scenario_remove_sector(deals: DataFrame) -> DataFrame:
    """G3 generalized: for every sector, gross pipeline with that sector removed."""
    g = _grouped_pipeline(deals, "sector", "sector")
    total = scalar(g, X.money_sum("pipeline"))
    top = leader(g, "pipeline", "sector")
    remaining = (total - F.col("pipeline")).cast(X.SUM_MONEY_TYPE)
    share = F.when(total != 0, remaining.cast("double") / total.cast("double") * 100).otherwise(F.lit(0.0))
    out = g.select(
        "sector",
        total.alias("current_pipeline"),
        F.col("pipeline").alias("pipeline_removed"),
        remaining.alias("scenario_pipeline"),
        share.alias("scenario_share_pct"),
        (F.col("sector") == top).alias("is_largest"),
        X.money_display_signed(total).alias("current_pipeline_display"),
        X.money_display_signed(remaining).alias("scenario_pipeline_display"),
        X.money_display_signed("pipeline").alias("pipeline_removed_display"),
    )
    return ordered(out, "pipeline_removed", "sector")
