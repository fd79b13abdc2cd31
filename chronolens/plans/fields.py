"""Queries of derived fields, small joins, tallies and look-ups, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import audit, ranks
from ..sources import views as V
from .registry import query
from .tables import r6

S = V.SCORED
UNIFORM = "CAST('0x' || substr(md5('{0}:' || {1}), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(f"WITH {S} SELECT item_id, round(greatest(s1, s2, s3, s4, s5), 6) AS most, round(least(s1, s2, s3, s4, s5), 6) AS least FROM scored")
def q_row_extremes(spark, d):
    """The highest and the lowest of an item's scores."""
    return V.scored(spark, d).select("item_id", r6(F.greatest(*V.SCORES)).alias("most"), r6(F.least(*V.SCORES)).alias("least"))


@query(f"SELECT o_orderkey, round(ln(o_totalprice) + 0.05 * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * w), 6) AS jittered FROM (SELECT o_orderkey, o_totalprice, {UNIFORM.format(7, 'o_orderkey')} AS u, {UNIFORM.format(8, 'o_orderkey')} AS w FROM orders)")
def q_log_jitter(spark, d):
    """The logarithm of a value with normal noise that depends on seed and key alone."""
    o = V.read(spark, d, "orders")
    return o.select("o_orderkey", r6(F.log("o_totalprice") + 0.05 * X.md5_normal(7, 8, F.col("o_orderkey"))).alias("jittered"))


@query(f"WITH {V.GENERATORS}, r AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY n) + (count(*) OVER (PARTITION BY family, n) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY family) AS m FROM generators) SELECT family, generator, round((k - 1) / greatest(1, m - 1), 6) AS scaled FROM r")
def q_rank_scaled(spark, d):
    """A covariate by its rank within the family, from 0 to 1."""
    g = ranks.with_ranks(V.generators(spark, d), ["n"], ["family"])
    m = g.groupBy("family").agg(F.count("*").alias("m"))
    return g.join(F.broadcast(m), "family").select("family", "generator", r6((F.col("rank_n") - 1) / F.greatest(F.lit(1), F.col("m") - 1)).alias("scaled"))


@query("""SELECT p_partkey, '/made/' || p_type AS path, split_part(p_type, '_', 1) AS origin, 'http://images/' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || '.jpg' AS url,
 TRY_CAST('20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-06-31' AS DATE) AS never, TRY_CAST('20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-06-30' AS DATE) AS day,
 CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE 'unknown' END AS value, CASE WHEN p_size % 3 = 0 THEN 'importer' WHEN p_size % 3 = 1 THEN 'origin' ELSE 'unknown' END AS basis FROM part""")
def q_text_fields(spark, d):
    """Paths, urls and dates from text, and a value with the basis it rests on."""
    p = V.read(spark, d, "part")
    day = lambda end: F.concat(F.lit("20"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(end))
    path = F.concat(F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("p_type"))
    value, basis = X.recorded(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 1, F.col("p_type")))
    return p.select("p_partkey", X.replaced_segment(path, "Brand[^/]*", "made").alias("path"), X.origin_source(F.col("p_type")).alias("origin"), X.padded_url(F.col("p_partkey")).alias("url"), X.parsed_date(day("-06-31")).alias("never"), X.parsed_date(day("-06-30")).alias("day"), value, basis)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(x, lambda a: a * a)), 5) AS own, round(1 + 2 * x[1] - 3 * x[2], 5) AS line, round(list_sum(x[33:64]) / 32 - list_sum(x[1:32]) / 32, 5) AS logit,
 round(list_sum(list_transform(range(1, 33), lambda i: abs((x[i] + x[i + 32]) / 2))), 5) AS mean_block, round(list_sum(list_transform(range(1, 33), lambda i: 2 * abs(x[i] - x[i + 32]) / 2)), 5) AS apart_block, round(list_sum(list_transform(range(0, 32), lambda i: x[2 * i + 2])), 5) AS odd_block FROM v""")
def q_vector_fields(spark, d):
    """Products, linear scores, the mean difference of two channels, and blocks of a vector of two planes."""
    v = V.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumns({"x1": F.col("x")[0], "x2": F.col("x")[1]})
    total = lambda a, f=lambda x: x: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x)), 5)
    blocks = X.phi_blocks("x", 2, 32)
    two = F.array(F.slice("x", 1, 32), F.slice("x", 33, 32))
    return v.select("vec_id", F.round(X.dot(F.col("x"), F.col("x")), 5).alias("own"), F.round(X.linear(["x1", "x2"], [2.0, -3.0], 1.0), 5).alias("line"), F.round(X.logit_difference(two), 5).alias("logit"), total(blocks["mean"], F.abs).alias("mean_block"), total(blocks["deviation"], F.abs).alias("apart_block"), total(blocks["odd"]).alias("odd_block"))


@query(f"WITH {S}, k AS (SELECT user_id % 500 AS item_id, min(event_type) AS kind FROM events GROUP BY 1) SELECT item_id, source, coalesce(kind, 'none') AS kind, split FROM scored LEFT JOIN k USING (item_id)")
def q_attach_columns(spark, d):
    """Items with the columns of another table that they lack, and none that they have."""
    other = V.read(spark, d, "events").groupBy((F.col("user_id") % 500).alias("item_id")).agg(F.min("event_type").alias("kind"), F.lit("other").alias("split"))
    items = V.scored(spark, d).select("item_id", "source", "split")
    return audit.with_missing(items, other, "item_id").select("item_id", "source", F.coalesce("kind", F.lit("none")).alias("kind"), "split")


@query(f"WITH {S}, g AS (SELECT generator FROM scored WHERE label = 1 GROUP BY generator HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM scored WHERE label = 1 GROUP BY generator))) SELECT item_id // 64 AS shard, count(*) AS n, min(item_id) AS first_item FROM scored WHERE generator IN (SELECT generator FROM g) AND item_id // 64 IN (SELECT o_orderkey // 64 FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def q_rows_by_shard(spark, d):
    """Rows of selected shards and of groups that qualify by their size, gathered by shard."""
    m = V.scored(spark, d).where("label = 1").withColumn("shard", F.expr("item_id DIV 64"))
    sizes = m.groupBy("generator").agg(F.count("*").alias("n"))
    large = sizes.join(F.broadcast(sizes.agg(F.avg("n").alias("mean")))).where("n > mean").select("generator")
    shards = V.read(spark, d, "orders").where("o_totalprice > 200000").select(F.expr("o_orderkey DIV 64").alias("shard")).distinct()
    return m.join(F.broadcast(large), "generator", "left_semi").join(shards, "shard", "left_semi").groupBy("shard").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


@query(f"WITH {S}, t AS (SELECT quantile_cont(s1, 0.95) AS t FROM scored WHERE source = '1-URGENT') SELECT family, count(*) AS n, round(avg(CAST(s1 > t AS INT)), 6) AS tpr, round(avg(CAST(abs(s1 - t) <= 1000 AS INT)), 6) AS boundary FROM scored, t WHERE label = 1 GROUP BY family")
def q_threshold_tpr(spark, d):
    """Detection rate of each family at the threshold that a twentieth of one source exceeds, and the share within 1,000 of it."""
    m = V.scored(spark, d)
    t = m.where("source = '1-URGENT'").agg(F.percentile("s1", 0.95).alias("t"))
    over, near = F.col("s1") > F.col("t"), F.abs(F.col("s1") - F.col("t")) <= 1000
    return m.where("label = 1").join(F.broadcast(t)).groupBy("family").agg(F.count("*").alias("n"), r6(F.avg(over.cast("int"))).alias("tpr"), r6(F.avg(near.cast("int"))).alias("boundary"))


@query(f"WITH {S}, p AS (SELECT family, split, source_width % 4 AS kind, round(avg(s1) - floor(avg(s1)), 6) / 10 AS p FROM scored WHERE label = 1 GROUP BY ALL) SELECT family, kind, count(*) AS tests, count(*) FILTER (WHERE p <= 0.05) AS found, round(avg(CAST(p <= 0.05 AS INT)), 6) AS share FROM p GROUP BY ALL")
def q_share_significant(spark, d):
    """How many tests of each family and kind are significant."""
    p = V.scored(spark, d).where("label = 1").groupBy("family", "split", (F.col("source_width") % 4).alias("kind")).agg((F.round(F.avg("s1") - F.floor(F.avg("s1")), 6) / 10).alias("p"))
    return p.groupBy("family", "kind").agg(F.count("*").alias("tests"), F.count_if(F.col("p") <= 0.05).alias("found"), r6(F.avg((F.col("p") <= 0.05).cast("int"))).alias("share"))


@query(f"WITH {S} SELECT source, split, count(*) AS n, count(*) FILTER (WHERE s2 < 0) AS negative, count(*) FILTER (WHERE s3 = 0) AS empty, count(DISTINCT s3) AS levels, count(*) - count(DISTINCT s3) AS tied FROM scored GROUP BY ALL")
def q_tallies(spark, d):
    """Rows and outcomes of each source and split, distinct levels of a score, and rows tied with another."""
    return V.scored(spark, d).groupBy("source", "split").agg(F.count("*").alias("n"), F.count_if(F.col("s2") < 0).alias("negative"), F.count_if(F.col("s3") == 0).alias("empty"), F.count_distinct("s3").alias("levels"), (F.count("*") - F.count_distinct("s3")).alias("tied"))


@query(f"WITH {S}, r AS (SELECT avg(s4) AS m, stddev_samp(s4) AS d FROM scored WHERE label = 0), k AS (SELECT item_id, family, round((s4 - m) / d, 6) AS z FROM scored, r) SELECT item_id, family, z, source_width, source_height FROM k JOIN scored USING (item_id, family) ORDER BY z DESC, item_id LIMIT 25")
def q_largest_with_metadata(spark, d):
    """The 25 items farthest above the authentic mean, with their metadata (a report of the largest)."""
    m = V.scored(spark, d)
    r = m.where("label = 0").agg(F.avg("s4").alias("m"), F.stddev_samp("s4").alias("d"))
    return m.join(F.broadcast(r)).select("item_id", "family", r6((F.col("s4") - F.col("m")) / F.col("d")).alias("z"), "source_width", "source_height").orderBy(F.desc("z"), "item_id").limit(25)


@query(f"WITH {S} SELECT item_id, family, split, s1, s2, s3, s4, s5 FROM scored WHERE item_id = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F')")
def q_lookup(spark, d):
    """One item by its key, with all scores."""
    key = V.read(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.max("o_orderkey").alias("item_id"))
    return V.scored(spark, d).join(F.broadcast(key), "item_id").select("item_id", "family", "split", *V.SCORES)


@query(f"WITH {S}, n AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE split = 'train') AS t FROM scored GROUP BY family) SELECT family, n, round(t / n, 6) AS share, abs(2 * t - n) <= 1 AS exact, n < 200 AS short FROM n")
def q_balance(spark, d):
    """Share of each family in train, whether it is half to the row, and whether the family is short of 200 rows."""
    m = V.scored(spark, d)
    short = audit.short_strata(m, "family", 200).select("family", F.lit(True).alias("short"))
    return audit.fractions(m, "family", "split", "train", 0.5).join(short, "family", "left").select("family", "n", r6("share").alias("share"), "exact", F.coalesce("short", F.lit(False)).alias("short"))


@query("SELECT k AS position, a.p_partkey AS left_key, b.p_partkey AS right_key FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS k, p_partkey FROM part) a FULL JOIN (SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS k, p_partkey FROM part) b USING (k) WHERE a.p_partkey IS DISTINCT FROM b.p_partkey")
def q_same_sequence(spark, d):
    """Positions at which two orders of the parts hold different keys."""
    p = V.read(spark, d, "part").select("p_partkey", "p_size")
    a = ranks.positions(p.select("p_partkey"), [], ["p_partkey"], "position")
    b = ranks.positions(p.select("p_size", "p_partkey"), [], ["p_size", "p_partkey"], "position")
    return audit.same_sequence(a, b.select("position", "p_partkey"), "position", "p_partkey")


@query(f"WITH {S}, b AS (SELECT item_id, source_width, source_height, CAST(floor(source_width / 3.0) AS BIGINT) AS crop_left, 0 AS crop_top, 1500 AS crop_width, 200 AS crop_height FROM scored) SELECT item_id, crop_left, source_width FROM b WHERE crop_left + crop_width > source_width OR crop_top + crop_height > source_height")
def q_geometry_drift(spark, d):
    """Items whose recorded box doesn't fit into the size that was measured."""
    b = V.scored(spark, d).withColumns({"crop_left": F.floor(F.col("source_width") / 3), "crop_top": F.lit(0), "crop_width": F.lit(1500), "crop_height": F.lit(200)})
    return audit.geometry_drift(b).select("item_id", "crop_left", "source_width")
