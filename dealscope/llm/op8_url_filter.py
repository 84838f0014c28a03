"""URL filters: rules, then empirical-Bayes host reputation.

Every url is split into host and path.  The longest fitting rule decides.
Pages that no rule judges get a verdict from the reputation of their host:
labelled page outcomes (1 good, 0 bad) are counted per host, registered
domain (last two labels) and suffix (last label), and beta-binomial priors
are shrunk downwards: the suffix's prior is centred on the overall rate, the
domain's on the suffix's posterior mean, the host's on the domain's, each
time without the lower group's own pages, so that no page counts twice.  Each
level's prior strength is a method-of-moments estimate from the spread of
its groups' rates.  A host is blocked only when the upper bound of its
posterior (mean plus ``z`` standard deviations) stays below ``threshold``:
unknown hosts and hosts with mixed evidence pass.

All work is grouped aggregation and equi-joins; only three overall rows
(one prior strength per level) are single rows.  Counts are pre-aggregated
per host before anything is joined, so a host with a third of all pages is
one row there; the final join takes the host table by Spark's size check
(AQE splits a hot host otherwise).

Defined results: a null url, or one without ``://``, has empty host and path
and no rule, and is judged like an unknown host; repeated rows are kept;
empty tables give empty results; with no outcomes at all everything passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the registered query: (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
THRESHOLD = 0.5
Z = 1.6448536269514722
MAX_STRENGTH = 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null when none fits.

    The rules are a short fixed list, so they fold into one CASE, longest
    text first (equal lengths: as listed).
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _prior(groups: DataFrame) -> Column:
    """Strength ``m`` and overall rate ``p`` of one level (a scalar subquery), by moments: with binomial counts (n, k)
    around mean p, the spread of the rates beyond sampling noise gives the
    strength; no excess spread gives ``MAX_STRENGTH``."""
    sums = groups.agg(
        F.sum("_k").alias("k"), F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_n")).alias("nn"),
        F.count_if(F.col("_n") > 0).alias("g"),
        F.sum(F.when(F.col("_n") > 0, F.col("_k") * F.col("_k") / F.col("_n"))).alias("kk"),
    )
    p = F.col("k") / F.col("n")
    between = F.col("kk") - F.col("n") * p * p
    noise = (F.col("g") - 1) * p * (1 - p)
    scale = (F.col("n") - F.col("nn") / F.col("n")) * p * (1 - p)
    rho = F.when(scale > 0, (between - noise) / scale).otherwise(0.0)
    rho = F.least(F.greatest(rho, F.lit(1.0 / (MAX_STRENGTH + 1))), F.lit(0.5))
    seen = F.coalesce(F.col("n"), F.lit(0)) > 0
    return sums.select(F.struct(
        F.when(seen, (1 - rho) / rho).otherwise(1.0).alias("m"), F.when(seen, p).otherwise(1.0).alias("p"),
    )).scalar()


def host_reputation(pages: DataFrame, *, host="_host", outcome="_outcome", z=Z) -> DataFrame:
    """One row per host: ``_host, _mean, _upper`` of its shrunk posterior.

    ``pages`` has one row per page: its host and its outcome (1, 0 or null).
    """
    hosts = (
        pages.groupBy(F.col(host).alias("_h"))
        .agg(F.count(outcome).alias("_n"), F.coalesce(F.sum(F.col(outcome).cast("long")), F.lit(0)).alias("_k"))
        .withColumn("_suffix", F.substring_index("_h", ".", -1))
        .withColumn("_domain", F.substring_index("_h", ".", -2))
    )
    domains = hosts.groupBy("_domain", "_suffix").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))
    suffixes = domains.groupBy("_suffix").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))

    def level(groups: DataFrame, mark: str) -> DataFrame:
        return groups.withColumn("_prior" + mark, _prior(groups))

    def without(k, n, own_k, own_n, prior, centre):
        """Posterior mean of a group without one member's own counts."""
        m = F.col(prior + ".m")
        return (F.col(k) - F.col(own_k) + m * centre) / (F.col(n) - F.col(own_n) + m)

    s = level(suffixes, "s").withColumnsRenamed({"_n": "_sn", "_k": "_sk"})
    d = level(domains, "d").join(s, "_suffix").withColumn("_above", without("_sk", "_sn", "_k", "_n", "_priors", F.col("_priors.p")))
    d = d.select("_domain", F.col("_n").alias("_dn"), F.col("_k").alias("_dk"), "_priord", "_above")
    h = level(hosts, "h").join(d, "_domain").withColumn("_centre", without("_dk", "_dn", "_k", "_n", "_priord", F.col("_above")))
    m = F.col("_priorh.m")
    h = h.withColumn("_mean", (F.col("_k") + m * F.col("_centre")) / (F.col("_n") + m))
    n, mean = F.col("_n") + F.col("_priorh.m"), F.col("_mean")
    return h.select(F.col("_h").alias("_host"), mean.alias("_mean"),
                    (mean + F.lit(z) * F.sqrt(mean * (1 - mean) / (n + 1))).alias("_upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame | None = None, *, id_col="page_id", url_col="url", rules=RULES,
                threshold=THRESHOLD, z=Z) -> DataFrame:
    """``id, host, path, rule, verdict`` of every page.

    ``outcomes`` (id, ``outcome`` 0/1) are the labelled pages.  Without it the
    pages that a rule judges are the labelled ones: allowed 1, blocked 0.
    """
    split = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    rule, verdict = rule_match(F.col("_host"), F.col("_path"), rules)
    judged = split.select("*", rule.alias("_rule"), verdict.alias("_verdict"))
    if outcomes is None:
        labelled = judged.withColumn("_outcome", F.when(F.col("_verdict") == "allow", 1).when(F.col("_verdict") == "block", 0))
    else:
        labelled = judged.join(outcomes.select(F.col(id_col).alias("_oid"), F.col("outcome").alias("_outcome")),
                               F.col("_id") == F.col("_oid"), "left")
    bad = host_reputation(labelled, z=z).filter(F.col("_upper") < threshold).select("_host", F.lit("block").alias("_learned"))
    return judged.join(bad, "_host", "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_verdict", "_learned", F.lit("allow")).alias("verdict"),
    )


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), j AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
), v AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS good FROM j
), h AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k, list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') AS domain,
         string_split(host, '.')[-1] AS suffix FROM v GROUP BY host
), d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
g AS (
  SELECT lvl, sum(k)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn, count(*) FILTER (n > 0) AS g,
         sum(CASE WHEN n > 0 THEN (k * k)::DOUBLE / n END) AS kk
  FROM (SELECT 'h' AS lvl, n, k FROM h UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s) GROUP BY lvl
), r AS (
  SELECT lvl, n, k / n AS p,
         least(greatest(CASE WHEN (n - nn / n) * (k / n) * (1 - k / n) > 0
           THEN (kk - n * (k / n) * (k / n) - (g - 1) * (k / n) * (1 - k / n)) / ((n - nn / n) * (k / n) * (1 - k / n)) ELSE 0 END,
           1.0 / 1001), 0.5) AS rho FROM g
), m AS (SELECT lvl, CASE WHEN n > 0 THEN (1 - rho) / rho ELSE 1 END AS m, CASE WHEN n > 0 THEN p ELSE 1 END AS p FROM r),
sm AS (SELECT d.domain, d.n, d.k, (s.k - d.k + m.m * m.p) / (s.n - d.n + m.m) AS mean FROM d JOIN s USING (suffix), m WHERE lvl = 's'),
dm AS (SELECT h.host, h.n, h.k, (sm.k - h.k + m.m * sm.mean) / (sm.n - h.n + m.m) AS mean FROM h JOIN sm USING (domain), m WHERE lvl = 'd'),
hm AS (SELECT host, (k + m.m * mean) / (n + m.m) AS mean, n + m.m AS n FROM dm, m WHERE lvl = 'h'),
b AS (SELECT host, mean + 1.6448536269514722 * sqrt(mean * (1 - mean) / (n + 1)) < 0.5 AS bad FROM hm)
SELECT page_id, v.host, path, rule, CASE WHEN good = 1 THEN 'allow' WHEN good = 0 THEN 'block' WHEN bad THEN 'block' ELSE 'allow' END AS verdict
FROM v JOIN b USING (host)
"""
