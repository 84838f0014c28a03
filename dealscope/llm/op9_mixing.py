"""Mixing sources to target weights.

Tokens (words) are aggregated per source, every source gets a target by
weight, capped at ``max_epochs`` times its size with the excess reshared, and
``target / size`` is its repetition rate.  A document is taken
``floor(rate)`` times, plus once more by a seeded draw: when a hash of its id
falls below its source's threshold.

The threshold is near the rate's fraction, the draw's probability, but read
off the source's own cumulated sizes: the documents below it, in order of
their hash, hold as many words as the target still lacks, and no more.  What
the first document beyond it leaves open is filled in ``ROUNDS`` - 1 further
draws of the same kind among the documents not taken that still fit.  So a
source's taken words stay below its target by less than a small document,
and reruns agree.

Everything runs as DataFrame operations on a narrow table (source, hash,
size), written once.  A threshold is found in two steps: sums per source and
``BINS`` ranges of the hash, then the documents of the one range in which the
need is met.  No source is gathered: a task gets at most ``BINS`` sums of it,
then a ``BINS``-th of its documents.  Only two sums per resharing round and a
count per range of sources come to the driver.

Defined results: null or empty text has size 0 and is taken 0 words; a null
source is a source of its own, after all others; a source of size 0 has
target 0; a null id is hashed as the empty string; repeated rows share one
decision; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.llm.rows import held, released, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
BITS, BIN_BITS = 52, 16
BINS = 1 << BIN_BITS
ROUNDS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``_rank`` (from 0, by code point, null last) without gathering the
    table: ranges are ranked alone, then shifted by the counts before them
    (one row a range on the driver)."""
    order = [F.col("_source").asc_nulls_last()]
    parts = written(
        sources.repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    )
    before, shift = 0, []
    for r in sorted(parts.groupBy("_part").count().collect()):
        shift += [F.lit(r["_part"]), F.lit(before)]
        before += r["count"]
    offset = F.create_map(*shift)[F.col("_part")] if shift else F.lit(0)
    return parts.withColumn("_rank", offset + F.col("_place") - 1).drop("_part", "_place")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """``sizes(_source, _size)`` -> one row per source: ``_source, _source_size, _target``."""
    sources = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = written(_ranked(sources).withColumn("_w", w))
    total = table.agg(F.sum("_source_size")).first()[0] or 0
    cap = F.col("_source_size") * max_epochs
    level, at_cap = 0.0, -1
    while True:  # each round caps at least one more source; few rounds in practice
        full = F.lit(level) * F.col("_w") >= cap
        r = table.agg(
            F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_w"))), F.count_if(full)
        ).first()
        if r[2] == at_cap or not r[1]:
            break
        at_cap = r[2]
        level = (share * total - r[0]) / r[1]
    full = F.lit(level) * F.col("_w") >= cap
    return table.select(
        "_source", "_source_size", F.when(full, cap.cast("double")).otherwise(F.lit(level) * F.col("_w")).alias("_target")
    )


def draw(key: Column, seed: str = SEED) -> Column:
    """Uniform below 2^52: the first ``BITS`` bits of an md5 over seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _below(rows: DataFrame, needs: DataFrame, n: int) -> DataFrame:
    """``needs`` with ``_t{n}``, the hash below which the ``rows(_source, _u,
    _size)`` hold at most ``_need`` words, and ``_need`` less these words."""
    own = F.col("r._source").eqNullSafe(F.col("s._source"))
    by = Window.partitionBy("_source")
    so_far = F.sum("_size").over(by.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))

    def first_beyond(sums: DataFrame, before: Column) -> DataFrame:
        """Per source: the first ``_at`` whose running sum passes the need, the sum before it, the sum of all."""
        running = sums.withColumn("_sum", so_far + before)
        past = F.col("_sum") > F.col("_need")
        return running.groupBy("_source").agg(
            F.min(F.when(past, F.col("_at"))).alias("_first"), F.max(F.when(~past, F.col("_sum"))).alias("_got"), F.max(F.col("_need")).alias("_n"))

    sums = rows.groupBy("_source", F.shiftright("_u", BITS - BIN_BITS).alias("_at")).agg(F.sum("_size").alias("_size"))
    sums = sums.alias("r").join(needs.select("_source", "_need").alias("s"), own).select("r.*", "s._need")
    coarse = first_beyond(sums, F.lit(0)).select("_source", F.col("_first").alias("_bin"), F.coalesce("_got", F.lit(0)).alias("_before"), F.col("_n").alias("_need"))
    at_edge = own & (F.shiftright("r._u", BITS - BIN_BITS) == F.col("s._bin"))
    edge = rows.alias("r").join(coarse.filter("_bin is not null").alias("s"), at_edge).select("r.*", "s._need", "s._before")
    edge = edge.groupBy("_source", F.col("_u").alias("_at"), "_need", "_before").agg(F.sum("_size").alias("_size"))
    fine = first_beyond(edge, F.col("_before")).select(F.col("_source").alias("_of"), F.col("_first").alias("_t"), "_got")
    found = coarse.join(fine, F.col("_source").eqNullSafe(F.col("_of")), "left").select(
        F.col("_source").alias("_of"), F.coalesce("_t", F.lit(1 << BITS)).alias(f"_t{n}"), F.coalesce("_got", "_before").alias("_got"))
    out = needs.join(found, F.col("_source").eqNullSafe(F.col("_of")), "left")
    left = F.col("_need") - F.coalesce("_got", F.lit(0))
    return written(out.withColumns({f"_t{n}": F.coalesce(f"_t{n}", F.lit(0)), f"_need{n}": F.col("_need"), "_need": left}).drop("_of", "_got"))


def _drawn(rounds: int) -> Column:
    """Whether one of the rounds' draws takes a row with its ``_u`` and ``_size``."""
    taken = F.lit(False)
    for n in range(rounds):
        taken = taken | (F.col("_u") < F.col(f"_t{n}")) & (F.col("_size") <= F.col(f"_need{n}"))
    return taken


def thresholds(rows: DataFrame, targets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``targets`` with what the rounds' draws need: thresholds ``_t{n}`` and
    the words open before each, ``_need{n}`` (the first round takes any size)."""
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    whole = F.floor(rate)
    found = targets.withColumn("_whole", whole).withColumn("_need", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    for n in range(rounds):
        if n:
            known = found.select(F.col("_source").alias("_of"), F.col("_need").alias("_open"), *(f"_{x}{i}" for i in range(n) for x in ("t", "need")))
            left = rows.join(known, F.col("_source").eqNullSafe(F.col("_of"))).filter(~_drawn(n) & (F.col("_size") <= F.col("_open")))
            found = _below(left.select("_source", "_u", "_size"), found, n)
        else:
            found = _below(rows, found, 0).withColumn("_need0", F.lit(float("inf")))
    return found.drop("_need")


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS,
        share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED, rounds=ROUNDS) -> DataFrame:
    """``docs`` with ``_size, _source_size, _target, _copies`` for every row.

    The table of sources is joined by Spark's own size check (broadcast when
    measured small, else a sort-merge join whose hot sources AQE splits).
    """
    sized = docs.withColumns({"_size": word_count(F.col(text_col)), "_u": draw(F.col(id_col), seed)})
    rows = written(sized.select(F.col(source_col).alias("_source"), "_u", "_size"))
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_size"))
    found = thresholds(rows.filter("_size > 0"), written(source_targets(written(sizes), weights, share, max_epochs)), rounds)
    return (
        sized.join(found, F.col(source_col).eqNullSafe(F.col("_source")), "inner")
        .withColumn("_copies", F.col("_whole") + _drawn(rounds).cast("long"))
        .drop("_source", "_whole", "_u", *(f"_{x}{n}" for n in range(rounds) for x in ("t", "need")))
    )


def expand(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mixed corpus: each document as many times as it is taken."""
    rows = held(docs, _id=F.col(id_col), _text=F.col(text_col), _from=F.col(source_col))
    out = mix(rows, id_col="_id", text_col="_text", source_col="_from", **options).filter(F.col("_copies") > 0)
    return released(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_value(3, 1, 2)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS w
  FROM d GROUP BY source
), fill(step, level, at_cap) AS (
  SELECT 0, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s)::DOUBLE, 0::BIGINT
  UNION ALL
  SELECT step + 1,
    (SELECT (1.5::DOUBLE * sum(source_size)::DOUBLE - coalesce(sum(2 * source_size) FILTER (f.level * w >= 2 * source_size), 0)::DOUBLE)
            / (sum(w) FILTER (NOT f.level * w >= 2 * source_size))::DOUBLE FROM s),
    (SELECT count(*) FILTER (f.level * w >= 2 * source_size) FROM s)
  FROM fill f
  WHERE step < 100 AND (SELECT count(*) FILTER (f.level * w >= 2 * source_size) FROM s) <> at_cap
), l AS (SELECT max_by(level, step) AS level FROM fill),
t AS (
  SELECT source, source_size,
         CASE WHEN level * w >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE level * w END AS target FROM s, l
), r0 AS (
  SELECT doc_id, size, d.source, source_size, target, floor(CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END)::BIGINT AS whole,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u, false AS extra
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c0 AS (
  SELECT *, target - whole * source_size - coalesce(sum(size) FILTER (extra) OVER (PARTITION BY source), 0) AS need FROM r0
), m0 AS (
  SELECT *, NOT extra AND true AS fits FROM c0
), s0 AS (
  SELECT *, coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source ORDER BY u RANGE UNBOUNDED PRECEDING), 0) AS so_far FROM m0
), e0 AS (
  SELECT *, coalesce(min(u) FILTER (fits AND size > 0 AND so_far > need) OVER (PARTITION BY source), 4503599627370496) AS edge FROM s0
), r1 AS (SELECT doc_id, size, source, source_size, target, whole, u, extra OR (fits AND u < edge) AS extra FROM e0), c1 AS (
  SELECT *, target - whole * source_size - coalesce(sum(size) FILTER (extra) OVER (PARTITION BY source), 0) AS need FROM r1
), m1 AS (
  SELECT *, NOT extra AND size <= need AS fits FROM c1
), s1 AS (
  SELECT *, coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source ORDER BY u RANGE UNBOUNDED PRECEDING), 0) AS so_far FROM m1
), e1 AS (
  SELECT *, coalesce(min(u) FILTER (fits AND size > 0 AND so_far > need) OVER (PARTITION BY source), 4503599627370496) AS edge FROM s1
), r2 AS (SELECT doc_id, size, source, source_size, target, whole, u, extra OR (fits AND u < edge) AS extra FROM e1), c2 AS (
  SELECT *, target - whole * source_size - coalesce(sum(size) FILTER (extra) OVER (PARTITION BY source), 0) AS need FROM r2
), m2 AS (
  SELECT *, NOT extra AND size <= need AS fits FROM c2
), s2 AS (
  SELECT *, coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source ORDER BY u RANGE UNBOUNDED PRECEDING), 0) AS so_far FROM m2
), e2 AS (
  SELECT *, coalesce(min(u) FILTER (fits AND size > 0 AND so_far > need) OVER (PARTITION BY source), 4503599627370496) AS edge FROM s2
), r3 AS (SELECT doc_id, size, source, source_size, target, whole, u, extra OR (fits AND u < edge) AS extra FROM e2)
SELECT doc_id, size, source_size, target, (whole + extra::BIGINT) * size AS taken FROM r3
"""
