"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's mean repetition rate is its target weight times the budget, over the size of the source. For each
document a uniform number comes from a hash of (seed, doc_id, text) and is looked up in the inverted Poisson
distribution of that mean: the count is the number of values of the cumulative distribution below it. A
document is exploded by its count, and all copies are dealt out and sorted by a seeded hash of document, copy and
the row's number in the table, which shuffles them globally, equal rows too. The number is that of the row in its
partition: where a task may run again on rows in another order, as after a shuffle, write the table first.

Without given weights, source s of size n_s weighs n_s ** temperature (0.7), as in multilingual mixing. The
budget is the size of the whole table unless given. Sizes are rows or UTF-8 bytes.

The table of sources is broadcast up to `MAX_BROADCAST` sources, counted first; beyond that it is an ordinary
join, whose hot sources Spark splits. The cumulative
distribution is held to 12 standard deviations above the mean, where what is left is below 1e-15. Means above
500 are split: the whole number part above 500 repeats outright and the rest is drawn.

Edge cases: null sources are a source of their own. Null, empty and very long texts are documents like any
other. Equal rows draw equal counts, and their copies lie apart in the global order. A weight of 0, or a source without a weight when weights are given, gives
no copies. An empty table gives an empty result. Columns of the input pass through; `copy`, `rate` and
`shuffle_key` replace input columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, utf8_bytes

SEED = 1234
TEMPERATURE = 0.7
LARGE = 500.0
MAX_BROADCAST = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson distribution, to 12 standard deviations above the mean."""
    top = F.ceil(mean + 12.0 * F.sqrt(mean) + 12.0).cast("int")
    first = F.exp(-mean)
    steps = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(first.alias("term"), F.array(first).alias("cdf")),
        lambda a, k: F.struct((a["term"] * mean / k).alias("term"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["term"] * mean / k)).alias("cdf")),
    )
    return steps["cdf"]


def rates(docs: DataFrame, source: str = "source", weights: dict | None = None, budget: float | None = None, size: Column | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """A row for each source: its size, its weight, and the mean repetition rate that meets the weight."""
    of = docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size if size is not None else F.lit(1)).cast("double").alias("mix_size"))
    if weights is None:
        of = of.withColumn("mix_weight", F.pow("mix_size", F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], f"k {dict(docs.dtypes)[source]}, mix_weight double")
        of = of.join(given, F.col("mix_source").eqNullSafe(F.col("k")), "left").drop("k").fillna(0.0, ["mix_weight"])
    all_size, all_weight = of.agg(F.sum("mix_size"), F.sum("mix_weight")).first()
    if not all_weight:
        return of.withColumn("rate", F.lit(0.0))
    goal = float(all_size if budget is None else budget)
    return of.withColumn("rate", F.when(F.col("mix_size") > 0, F.col("mix_weight") / F.lit(all_weight) * F.lit(goal) / F.col("mix_size")).otherwise(0.0))


def mix(
    docs: DataFrame, source: str = "source", key: str = "doc_id", text_col: str = "text", weights: dict | None = None,
    budget: float | None = None, size: Column | None = None, temperature: float = TEMPERATURE, seed: int = SEED, shuffle: bool = True,
) -> DataFrame:
    """`docs`, each row `copy` times from 1 on, with its source's `rate` and the `shuffle_key` of the global order."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"copy", "rate", "shuffle_key"}])
    columns, cdf, whole, u, row = docs.columns, *(free_name(docs, c) for c in ("cdf", "whole", "u", "row"))
    of = (
        rates(docs, source, weights, budget, size, temperature)
        .withColumn(whole, F.when(F.col("rate") > LARGE, F.floor(F.col("rate") - LARGE)).otherwise(0).cast("int"))
        .withColumn(cdf, cumulative(F.col("rate") - F.col(whole)))
    )
    # Drawn below the join, so that it is computed once a document and not once a value of the distribution.
    drawn = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(u, uniform(F.lit(str(seed)), F.col(key).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    n = F.col(whole) + F.size(F.filter(F.col(cdf), lambda c: c <= F.col(u)))
    if of.count() <= MAX_BROADCAST:  # rows of about 300 bytes
        of = F.broadcast(of)
    out = (
        drawn.join(of, drawn[source].eqNullSafe(of["mix_source"]))
        .where(F.col("rate") > 0)
        .select(*columns, row, "rate", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("copy"))
        .withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col(key), F.col(row), F.col("copy")))
        .drop(row)
    )
    return out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key") if shuffle else out


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), F.round("rate", 9).alias("rate"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP3_SQL = """
WITH s AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, 0.7) / (SELECT sum(pow(n, 0.7)) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
k AS (SELECT r.source, r.rate, unnest(range(0, CAST(ceil(r.rate + 12 * sqrt(r.rate) + 12) AS INT) + 1)) AS k FROM r),
c AS (SELECT source, rate, k, sum(exp(-rate) * pow(rate, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT d.doc_id, d.source, d.text, CAST('0x' || substr(md5('1234:' || d.doc_id || ':' || md5(coalesce(d.text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents d),
n AS (SELECT u.doc_id, u.source, u.text, c.rate, count(*) FILTER (WHERE c.cdf <= u.u) AS n
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, CAST(unnest(range(1, n + 1)) AS INT) AS copy, round(rate, 9) AS rate, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM n
"""
