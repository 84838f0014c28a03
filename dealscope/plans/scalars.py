"""Scalar subqueries over an aggregated DataFrame, without a second scan.

A grouped result often needs one global figure (its total, its leader).
Taking it as a scalar subquery keeps the work distributed (partial
aggregation, no single-partition window).  The subquery reads every
column of the grouped frame, so column pruning leaves its aggregate
identical to the main query's and the exchange is reused
(``ReusedExchange``): the source is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalars(g: DataFrame, **aggs: Column) -> dict[str, Column]:
    keep = [F.count(F.col(f"`{c}`")).alias(f"_keep{i}") for i, c in enumerate(g.columns)]
    named = [e.alias(k) for k, e in aggs.items()]
    s = g.agg(F.struct(*named, *keep).alias("s")).scalar()
    return {k: s.getField(k) for k in aggs}


def scalar(g: DataFrame, agg: Column) -> Column:
    return scalars(g, v=agg)["v"]


def leader(g: DataFrame, value: str, label: str) -> Column:
    """Label of the largest ``value`` (ties: smallest label)."""
    order = F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))
    return scalar(g, F.min_by(F.col(label), order))
