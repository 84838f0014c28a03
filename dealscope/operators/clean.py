"""Table cleaning (C1, C2, F1): one narrow projection per table, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import vocab
from ..plans import schema


def _project(df: DataFrame, transforms: dict[str, Column], extra: dict[str, Column]) -> DataFrame:
    """Rewrite columns in place (order kept), then append ``extra`` columns."""
    cols = []
    for name in df.columns:
        if name in transforms:
            cols.append(transforms[name].alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    cols += [c.alias(n) for n, c in extra.items()]
    return df.select(*cols)


def drop_header_rows(df: DataFrame, column: str = "deal_name", header: str = "deal name") -> DataFrame:
    """drop rows whose name is a stray header; null names are kept."""
    if column not in df.columns:
        return df
    name = F.lower(X.py_strip(F.col(column)))
    return df.filter(~name.eqNullSafe(F.lit(header)))


def clean_deals(raw: DataFrame, keep: tuple[str, ...] = (),
                formats: tuple[str, ...] = vocab.DATE_FORMATS) -> DataFrame:
    """Canonical names -> header filter -> typed sector/status/value/prob/dates.

    ``keep``: key columns carried through unchanged (not header-matched).
    ``formats``: the date formats to try, in order.
    """
    df = schema.deal_columns(raw, keep)
    if "deal_name" not in df.columns and "__item_name" in df.columns:
        df = df.withColumn("deal_name", F.col("__item_name"))
    df = drop_header_rows(df)
    t: dict[str, Column] = {}
    if "sector" in df.columns:
        t["sector"] = X.sector_norm("sector")
    if "deal_status" in df.columns:
        t["deal_status"] = X.status_norm("deal_status")
    if "deal_value" in df.columns:
        t["deal_value"] = X.money_parse("deal_value")
    for c in vocab.DEAL_DATE_COLUMNS:
        if c in df.columns:
            t[c] = X.date_parse(c, formats)
    extra = {}
    if "closure_probability" in df.columns:
        extra["probability_numeric"] = X.probability_parse("closure_probability")
    return _project(df, t, extra)


def clean_work_orders(raw: DataFrame, keep: tuple[str, ...] = (),
                      formats: tuple[str, ...] = vocab.DATE_FORMATS) -> DataFrame:
    """Canonical names -> typed sector/status/8 money/6 date columns."""
    df = schema.work_order_columns(raw, keep)
    if "deal_name" not in df.columns and "__item_name" in df.columns:
        df = df.withColumn("deal_name", F.col("__item_name"))
    t: dict[str, Column] = {}
    if "sector" in df.columns:
        t["sector"] = X.sector_norm("sector")
    if "execution_status" in df.columns:
        t["execution_status"] = X.status_norm("execution_status")
    for c in vocab.WORK_ORDER_MONEY_COLUMNS:
        if c in df.columns:
            t[c] = X.money_parse(c)
    for c in vocab.WORK_ORDER_DATE_COLUMNS:
        if c in df.columns:
            t[c] = X.date_parse(c, formats)
    return _project(df, t, {})
