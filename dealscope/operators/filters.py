"""Row filters F2-F5 as Column predicates (all pushable into one stage)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import vocab
from ..sources.cleaned import MONTH_KEY, SECTOR_KEY

def TRUE() -> Column:
    return F.lit(True)


def open_deal_predicate(df: DataFrame) -> Column:
    """normalized status is open / on hold; no status column -> all rows."""
    if "deal_status" not in df.columns:
        return TRUE()
    return X.text_norm("deal_status").isin(*vocab.OPEN_DEAL_STATUSES)


def open_deals(df: DataFrame) -> DataFrame:
    return df.filter(open_deal_predicate(df))


def sector_predicate(df: DataFrame, sector: str | None) -> Column:
    """exact match on normalized sector; no-op for empty arg or no column."""
    if not sector or "sector" not in df.columns:
        return TRUE()
    requested = " ".join(str(sector).strip().lower().split())
    if SECTOR_KEY in df.columns:  # a table from write_cleaned: a partition filter
        return F.col(SECTOR_KEY) == F.lit(requested)
    return X.text_norm("sector") == F.lit(requested)


def sector_filter(df: DataFrame, sector: str | None) -> DataFrame:
    return df.filter(sector_predicate(df, sector))


def period_kind(period: str | None) -> str | None:
    """Which window a period text selects: 'quarter', 'month', 'year' or None."""
    if not period:
        return None
    p = " ".join(str(period).strip().lower().split())
    if p in vocab.PERIOD_ALL:
        return None
    if any(t in p for t in vocab.PERIOD_QUARTER_TERMS):
        return "quarter"
    if any(t in p for t in vocab.PERIOD_MONTH_TERMS):
        return "month"
    if any(t in p for t in vocab.PERIOD_YEAR_TERMS):
        return "year"
    return None


@dataclass(frozen=True)
class PeriodBounds:
    start: Column
    end: Column
    end_inclusive: bool


def period_bounds(kind: str, as_of: _dt.date | str | None) -> PeriodBounds:
    """F4 bounds: whole quarter [start, end); month / year from start to as_of."""
    today = X.as_of_col(as_of)
    if kind == "quarter":
        return PeriodBounds(X.quarter_start(today), X.quarter_end(today), False)
    if kind == "month":
        return PeriodBounds(F.trunc(today, "month"), today, True)
    return PeriodBounds(F.trunc(today, "year"), today, True)


def period_predicate(
    df: DataFrame, date_column: str, period: str | None, as_of: _dt.date | str | None = None
) -> Column:
    """rows whose date falls in the period; unparseable dates drop out.

    On a table from ``write_cleaned(month_of=date_column)`` the bounds also
    restrict the months read (a partition filter).
    """
    kind = period_kind(period)
    if kind is None or date_column not in df.columns:
        return TRUE()
    b = period_bounds(kind, as_of)
    d = F.col(date_column).cast("date")
    upper = (d <= b.end) if b.end_inclusive else (d < b.end)
    inside = (d >= b.start) & upper
    key = MONTH_KEY + date_column
    if key in df.columns:
        month = F.col(key)
        inside = (month >= F.trunc(b.start, "month")) & ((month <= b.end) if b.end_inclusive else (month < b.end)) & inside
    return inside


def period_filter(
    df: DataFrame, date_column: str, period: str | None, as_of: _dt.date | str | None = None
) -> DataFrame:
    return df.filter(period_predicate(df, date_column, period, as_of))
