"""Data-quality operators: Q1 missing profile, Q2 duplicates, Q3 report,
Q4 coverage, Q5 known gaps.

Q1 is one global aggregation (a ``count_if(isnull)`` per column, partial
aggregation per task) unpivoted afterwards.  Q2 is exact without shuffling
rows: a 128-bit fingerprint and missing bitmap per row is shuffled
(partially aggregated, so a row repeated across a third of the table
collapses map-side), the repeated fingerprints become a bit table of fixed
size, and only rows that it takes are compared in full.  Q3 takes its null
counts from the same fingerprint groups.  Both are one lazy plan: no job
runs while they are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructType

from ..functions import expr as X
from ..functions.vocab import DUPLICATE_ISSUE, EMPTY_ISSUE, GAP_ROWS
from ..sources.cleaned import footer_session, is_key, read_cleaned
from .sales import pipeline_summary


def _missing(df: DataFrame, name: str, blank: bool = False) -> Column:
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    if blank and isinstance(dtype, StringType):
        return c.isNull() | (X.py_strip(c) == "")
    return c.isNull()


def _profile_row(df: DataFrame, blank: bool = False) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(_missing(df, n, blank)).alias(f"m{i}") for i, n in enumerate(df.columns)]
    return df.agg(*aggs)


def missing_profile(df: DataFrame, dataset: str, blank_is_missing: bool = False) -> DataFrame:
    """Q1: per column (in order) null count, pct (1 dp), and whether it is reported (>= 10).

    With ``blank_is_missing`` blank texts count as missing, too (L1).
    """
    return _profile_long(_profile_row(df, blank_is_missing), df.columns, dataset)


def missing_profile_stored(spark: SparkSession, path: str, dataset: str, board: StructType | None = None) -> DataFrame:
    """Q1 over a board stored by ``write_cleaned``, from the Parquet footers alone.

    Every count is pushed into the scan (``PushedAggregation``), so no column
    data is read, whatever the size of the board.  ``board``: see ``read_cleaned``.
    """
    df = read_cleaned(footer_session(spark), path, board)
    names = [c for c in df.columns if not is_key(c)]
    counts = {"rows": F.count(F.lit(1)), **{f"n{i}": F.count(F.col(f"`{c}`")) for i, c in enumerate(names)}}
    pushed = df.agg(*[v.alias(k) for k, v in counts.items()])
    # A board without files has no footer to add up, and its pushed counts are null; a row of zeros makes them 0.
    zeros = df.sparkSession.range(1).select(*[F.lit(0).cast("bigint").alias(k) for k in counts])
    counted = pushed.unionByName(zeros).agg(*[F.max(k).alias(k) for k in counts])
    row = counted.select("rows", *[(F.col("rows") - F.col(f"n{i}")).alias(f"m{i}") for i in range(len(names))])
    return _profile_long(row, names, dataset)


def _profile_long(row: DataFrame, names: list[str], dataset: str) -> DataFrame:
    """Q1's rows from the one row of counts (``rows``, ``m0``, ``m1``, ...)."""
    rows = F.col("rows")
    entries = F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("column_name"),
                 F.col(f"m{i}").alias("missing"))
        for i, n in enumerate(names)
    ])
    long = row.select(rows, F.inline(entries))
    pct = F.when(rows == 0, F.lit(0.0)).otherwise(X.py_round(F.col("missing") / rows * 100, 1))
    return long.select(
        F.lit(dataset).alias("dataset"), "position", "column_name", "missing",
        pct.alias("missing_pct"),
        ((F.col("missing") > 0) & (pct >= 10)).alias("reported"),
    )


_FP_SALT = "dealscope-row-fingerprint"
_MASK_BITS = 62


def _nested_float(dt) -> bool:
    if isinstance(dt, ArrayType):
        return isinstance(dt.elementType, (DoubleType, FloatType)) or _nested_float(dt.elementType)
    if isinstance(dt, StructType):
        return any(isinstance(f.dataType, (DoubleType, FloatType)) or _nested_float(f.dataType)
                   for f in dt.fields)
    return False


def _masks(df: DataFrame, names: list[str]) -> list[Column]:
    """Missing-value bitmaps (62 columns per long): bit j of ``_mk`` is column 62k+j."""
    out = []
    for k in range(0, max(len(names), 1), _MASK_BITS):
        bits = [F.when(_missing(df, c), F.lit(1 << j)).otherwise(F.lit(0)).cast("bigint")
                for j, c in enumerate(names[k:k + _MASK_BITS])]
        m = bits[0] if bits else F.lit(0).cast("bigint")
        for b in bits[1:]:
            m = m + b
        out.append(m.alias(f"_m{k // _MASK_BITS}"))
    return out


def _fingerprint(vals: list[Column]) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hash chains over the values."""
    return F.xxhash64(*vals), F.xxhash64(F.lit(_FP_SALT), *vals)


def _mask_bit(i: int) -> Column:
    return (F.col(f"_m{i // _MASK_BITS}").bitwiseAND(F.lit(1 << (i % _MASK_BITS))) != 0)


def _fingerprint_groups(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """One row a distinct fingerprint: its missing bitmaps and how many rows have it (``_n``).

    Rows are grouped on a 128-bit fingerprint (two independently seeded
    ``xxhash64`` chains over the key columns) plus the key columns' missing
    bitmaps, ~24 bytes shuffled per row.  Spark's hash skips nulls, so the
    bitmaps keep ``(a, null)`` and ``(null, a)`` apart; like grouping, it
    hashes -0.0 as 0.0 and every NaN alike, so rows that group together
    share a fingerprint.  All uses of the groups share one exchange.
    """
    vals = [F.col(f"`{c}`") for c in keys]
    masks = _masks(df, keys)
    mnames = [f"_m{i}" for i in range(len(masks))]
    h1, h2 = _fingerprint(vals)
    g = (df.select(h1.alias("_h1"), h2.alias("_h2"), *masks)
         .groupBy("_h1", "_h2", *mnames).agg(F.count(F.lit(1)).alias("_n")))
    return g, mnames


# Bits of the table of repeated fingerprints: 2 MB, whatever the data.
REPEAT_BITS = 24
_BIT = "shiftleft(1L, CAST(_h1 & 63 AS INT))"


def _word_no() -> Column:
    return F.expr(f"shiftright(_h1 & {(1 << REPEAT_BITS) - 1}L, 6)")


def _repeat_table(groups: DataFrame) -> Column:
    """The repeated fingerprints as a bit table of fixed size: an array of longs, as a scalar subquery.

    A row whose bit is unset has no copy.  A set bit proves nothing, so more
    repeated fingerprints than bits cost a larger shuffle, never a result.
    """
    words = 1 << (REPEAT_BITS - 6)
    zeros = groups.sparkSession.range(words).select(F.col("id").alias("_w"), F.lit(0).cast("bigint").alias("_b"))
    ones = groups.filter(F.col("_n") > 1).select(_word_no().alias("_w"), F.expr(_BIT).alias("_b"))
    table = ones.unionByName(zeros).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    return table.agg(F.sort_array(F.collect_list(F.struct("_w", "_b")))["_b"].alias("bits")).scalar()


def _exact_duplicates(df: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """Exact row equality, only for rows that the table of repeated fingerprints takes.

    Returns one row ``_dups`` (sum over identical-row groups of n - 1).  All
    other rows are grouped as null and collapse map-side, as copies do, so
    only candidate rows are shuffled.  The join with the residues of the
    repeated fingerprints (at most 64 rows) is there for boards without
    copies: its empty side lets AQE drop the second reading of the board.
    """
    cols = [F.col(f"`{c}`") for c in keys]
    h1, _ = _fingerprint(cols)
    hit = _repeat_table(groups)[_word_no().cast("int")].bitwiseAND(F.expr(_BIT)) != 0
    row = F.when(hit, F.struct(*[c.alias(f"f{i}") for i, c in enumerate(cols)]))
    residue = F.expr("_h1 & 63").alias("_residue")
    some = groups.filter(F.col("_n") > 1).select(residue).distinct()
    rows = df.select(*cols, h1.alias("_h1")).select("*", residue).join(F.broadcast(some), "_residue")
    g = rows.select(row.alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    copies = F.sum(F.when(F.col("_row").isNotNull(), F.col("_n") - 1))
    return g.agg(F.coalesce(copies, F.lit(0)).cast("bigint").alias("_dups"))


def _fingerprintable(df: DataFrame, keys: list[str]) -> bool:
    # Top-level floats hash the way grouping compares them; floats nested in
    # arrays or structs are left to the plain all-column grouping.
    return not any(_nested_float(df.schema[c].dataType) for c in keys)


def _dup_count(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(groups of rows with their counts, exact duplicate frame)."""
    if _fingerprintable(df, keys):
        groups, _ = _fingerprint_groups(df, keys)
        return groups, _exact_duplicates(df, keys, groups)
    g = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return g, g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("_dups"))


def _combine(totals: DataFrame, dups: DataFrame) -> DataFrame:
    """One row: ``rows`` and the other totals, plus ``_dups``.

    Both inputs are one-row aggregates; they are merged with a union and a
    global aggregate, so no join is needed.
    """
    t = totals.withColumn("_dups", F.lit(0).cast("bigint"))
    fill = [F.lit(None).cast(t.schema[c].dataType).alias(c) for c in totals.columns]
    t = t.unionByName(dups.select(*fill, "_dups"))
    return t.agg(*[F.max(c).alias(c) for c in totals.columns], F.sum("_dups").alias("_dups"))


def duplicate_rows(df: DataFrame, dataset: str, subset: list[str] | None = None) -> DataFrame:
    """Q2: rows minus distinct rows over all (or ``subset``) columns; nulls equal.

    Exact: a 128-bit fingerprint per row is shuffled instead of the row, and
    only rows whose fingerprint may repeat are compared in full.
    """
    keys = list(subset or df.columns)
    base, dups = _dup_count(df, keys)
    totals = base.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"))
    out = _combine(totals, dups)
    return out.select(F.lit(dataset).alias("dataset"), F.col("rows"),
                      F.coalesce(F.col("_dups"), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def _issues_row(df: DataFrame, dataset: str, subset: list[str] | None = None) -> DataFrame:
    """One row: dataset, rows, columns, duplicate_rows, issues (ordered array).

    With duplicates over all columns, one shuffle serves both halves: the
    fingerprint groups carry the missing bitmaps, so per-column null
    counts are sums over them.  With a ``subset``, nulls are counted by a
    map-side global aggregate and duplicates separately.
    """
    names = df.columns
    n = F.col("_n")
    if subset is None and _fingerprintable(df, names):
        groups, _ = _fingerprint_groups(df, names)
        dups = _exact_duplicates(df, names, groups)
        aggs = [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("rows")]
        aggs += [F.coalesce(F.sum(F.when(_mask_bit(i), n)), F.lit(0)).cast("bigint").alias(f"m{i}")
                 for i in range(len(names))]
        prof = _combine(groups.agg(*aggs), dups)
    else:
        _, dups = _dup_count(df, list(subset or names))
        prof = _combine(_profile_row(df), dups)
    dups = F.coalesce(F.col("_dups"), F.lit(0)).cast("bigint")
    rows = F.col("rows")
    msgs = []
    for i, c in enumerate(names):
        m = F.col(f"m{i}")
        pct = X.py_round(m / rows * 100, 1)
        msgs.append(F.when((rows > 0) & (m > 0) & (pct >= 10),
                           F.concat(F.lit(f"{c}: "), m.cast("string"), F.lit(" missing ("),
                                    pct.cast("string"), F.lit("%)"))))
    msgs.append(F.when(dups > 0, F.concat(dups.cast("string"), F.lit(DUPLICATE_ISSUE))))
    issues = F.when(rows == 0, F.array(F.lit(EMPTY_ISSUE))).otherwise(F.array_compact(F.array(*msgs)))
    return prof.select(
        F.lit(dataset).alias("dataset"),
        rows.alias("rows"),
        F.when(rows == 0, F.lit(0)).otherwise(F.lit(len(names))).alias("columns"),
        F.when(rows == 0, F.lit(0).cast("bigint")).otherwise(dups).alias("duplicate_rows"),
        issues.alias("issues"),
    )


def quality_report(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Q3: one row per dataset with its issue list (column order, then duplicates); one lazy plan."""
    return _issues_row(deals, "Deals").unionByName(_issues_row(work_orders, "Work Orders"))


def quality_issues(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Q3 in long form: (dataset, issue_no, issue)."""
    rep = quality_report(deals, work_orders)
    return rep.select("dataset", F.posexplode("issues").alias("pos", "issue")).select(
        "dataset", (F.col("pos") + 1).alias("issue_no"), "issue")


def coverage(deals: DataFrame, sector: str | None = None, period: str | None = None,
             as_of=None) -> DataFrame:
    """Q4: the coverage block of the pipeline summary."""
    return pipeline_summary(deals, sector, period, as_of).select(
        "open_deals_before_filters", "after_sector_filter", "deals_after_filters",
        "deals_with_value", "deals_used_for_weighted_pipeline", "value_coverage_pct",
        "probability_coverage_pct", "unknown_sector_deals")


def known_gaps(deals: DataFrame) -> DataFrame:
    """Q5: three (label, count, description) rows from the unfiltered summary."""
    ps = pipeline_summary(deals)
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("gap_no"), F.lit(label).alias("label"),
                 F.col(col).alias("count"), F.lit(desc).alias("description"))
        for i, (label, col, desc) in enumerate(GAP_ROWS)
    ])
    return ps.select(F.inline(rows))
