"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every source s has a target share w_s of ``epochs`` times the rows of the input, so a document of it is to
be repeated ``rate = w_s * epochs * N / n_s`` times on average.  Each document draws a uniform number from a
hash of its id and the seed and inverts the Poisson distribution with that mean: the count is a function of
(id, seed, rate) alone, so a lost executor, another partitioning or a second run gives the same result.
A rate over ``MAX_RATE`` is split: a Poisson number with mean r is the sum of k independent ones with mean r / k,
each from a uniform number of its own, so no rate is cut and the distribution stays short.
The rows are exploded by their counts and dealt to partitions by a hash of (id, replica, seed), and sorted by
it within each: a global shuffle with one exchange, without the sampling pass of a range partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import common

#: Bytes of distributions that go to every executor, by their summed lengths; beyond that they are joined by a shuffle
#: (which AQE splits where skewed).
BROADCAST_BYTES = 32 << 20
#: The largest mean that is drawn at once, so that the thresholds of a distribution are few; more is drawn in parts.
MAX_RATE = 2000.0
#: Replicas that one row is exploded into at once.
REPLICAS = 1000


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """(source, rate): the counts of all rows by source, and the mean number of repetitions.

    Without ``weights`` a source's weight is its count to the power ``alpha``.  Weights are divided by their
    sum.  A source that ``weights`` does not name gets rate 0: its target share is nothing.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("__source")).agg(F.count("*").alias("n"))
    if weights is not None:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights are not negative")
        fields = T.StructType([T.StructField("__name", T.StringType()), T.StructField("w", T.DoubleType())])
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], fields)
        sizes = sizes.join(F.broadcast(given) if sum(len(k) + 64 for k in weights) <= BROADCAST_BYTES else given, F.col("__source").eqNullSafe(F.col("__name")), "left")
        sizes = sizes.select("__source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    else:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    # 1e12ths of a unit make the sum independent of its order
    total = sizes.agg(F.sum("n").alias("rows"), F.sum("w").alias("all_w"))
    rate = F.col("w") / F.col("all_w") * F.lit(epochs) * F.col("rows") / F.col("n")
    return sizes.crossJoin(F.broadcast(total)).select("__source", F.when(F.col("all_w") > 0, rate).otherwise(0.0).alias("rate"))


def last_count(rate: F.Column) -> F.Column:
    """The largest count that the distribution with mean ``rate`` lists."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")


def thresholds(rate: F.Column) -> F.Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below the smallest step of the uniform numbers."""
    last = last_count(rate)
    start = F.struct((-rate).alias("l"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(a: F.Column, k: F.Column) -> F.Column:
        mass = a["l"] + F.log(rate / k)
        return F.struct(mass.alias("l"), (a["c"] + F.exp(mass)).alias("c"), F.array_append(a["all"], a["c"] + F.exp(mass)).alias("all"))

    grown = F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]
    return F.when(rate > 0, grown).otherwise(F.array(F.lit(2.0)))


def uniform(id_col: F.Column, seed: int, part: F.Column) -> F.Column:
    """52 bits of the MD5 of seed, part and id, as a number in [0, 1); part 0 is left out."""
    label = F.concat(F.lit(str(seed)), F.when(part == 0, "").otherwise(F.concat(F.lit("/"), part.cast("string"))), F.lit(":"))
    return F.conv(F.substring(F.md5(F.concat(label, F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_mix(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 7,
    id_col: str = "doc_id", source_col: str = "source", replica_col: str = "replica",
) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a global random order; adds ``replica_col`` (from 0).

    A column of ``docs`` with that name is replaced; other names cannot clash, as columns are numbered in between.  A null
    source is a source of its own.  Rows with the same id get the same count; a null id counts as the id of empty text.
    A uniform number equal to a threshold falls above it.  Texts are not read.  An empty table stays empty.
    """
    if not (math.isfinite(epochs) and epochs >= 0):
        raise ValueError("epochs is finite and not negative")
    rates = source_rates(docs, source_col, weights, alpha, epochs)
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int"))).withColumn("mean", F.col("rate") / F.col("parts"))
    rates = common.written(rates.select("__source", "parts", "mean"), "rates")
    size = rates.agg(F.sum(8 * (last_count(F.col("mean")) + 1) + 64 + F.coalesce(F.length("__source"), F.lit(0)))).first()[0] or 0
    rates = rates.select("__source", "parts", thresholds(F.col("mean")).alias("cdf"))
    # numbered names in between
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    kept = [c for c in docs.columns if c != replica_col]
    held = [name[c] for c in kept]
    base = docs.toDF(*name.values()).select(*held, F.col(name[id_col]).alias("id"), F.col(name[source_col]).cast("string").alias("source"))
    met = base.join(F.broadcast(rates) if size <= BROADCAST_BYTES else rates, F.col("source").eqNullSafe(F.col("__source")))
    drawn = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: uniform(F.col("id"), seed, k))
    total = F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    count = F.when(F.element_at("cdf", 1) > 1, 0).otherwise(total)
    counted = met.select(*held, "id", count.alias("n")).filter("n > 0")
    # in two steps, so that no row holds the numbers of all its replicas
    rows = counted.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(REPLICAS))))
    rows = rows.select(*held, "id", F.explode(F.sequence("from", F.least(F.col("from") + (REPLICAS - 1), F.col("n") - 1))).alias("replica"))
    rows = rows.select(*held, "replica", F.xxhash64(F.lit(seed), "id", "replica").alias("key")).repartition("key").sortWithinPartitions("key")
    return rows.select(*(F.col(name[c]).alias(c) for c in kept), F.col("replica").alias(replica_col))


def op3(spark, sf_dir: str) -> DataFrame:
    return poisson_mix(common.read(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM sizes) * 1.0 * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
parts AS (SELECT source, greatest(1, ceil(rate / 2000.0))::INTEGER AS parts, rate / greatest(1, ceil(rate / 2000.0)) AS mean FROM rates),
cdf AS (
  SELECT source, mean, 0 AS k, -mean AS l, exp(-mean) AS c FROM parts
  UNION ALL
  SELECT source, mean, k + 1, l + ln(mean / (k + 1)), c + exp(l + ln(mean / (k + 1))) FROM cdf
  WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
ids AS (SELECT DISTINCT doc_id, source FROM documents),
draws AS (
  SELECT i.doc_id, i.source, ('0x' || substr(md5('7' || CASE WHEN p.k = 0 THEN '' ELSE '/' || p.k END || ':' || coalesce(CAST(i.doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM ids i JOIN parts ON parts.source IS NOT DISTINCT FROM i.source, LATERAL (SELECT unnest(range(0, parts.parts)) AS k) p),
counted AS (
  SELECT d.doc_id, d.source, count(*) AS n FROM draws d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source WHERE cdf.c <= d.u GROUP BY d.doc_id, d.source)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.replica::INTEGER AS replica
FROM documents d JOIN counted c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(range(0, c.n)) AS replica) r
"""
