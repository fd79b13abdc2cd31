"""Further summaries, draws, trends and fields, with their DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import audit, ranks, sampling, vectors
from ..sources import views as V
from .registry import query
from .tables import RANK, r6

S = V.SCORED


@query(f"WITH {S} SELECT label, count(*) AS n, round(avg(CAST(least(source_width, source_height) <= 1.001 * 200 AS INT)), 6) AS uncropped, round(avg(CAST(40000.0 / (source_width * source_height) >= 0.25 AS INT)), 6) AS quarter FROM scored GROUP BY label")
def q_uncropped_share(spark, d):
    """The share of items of each class whose short side is not cropped, and of those of whose area a quarter is left."""
    side, area = X.short_side(F.col("source_width"), F.col("source_height")), X.area_fraction(F.col("source_width"), F.col("source_height"), 200)
    return V.scored(spark, d).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg((side <= 1.001 * 200).cast("int"))).alias("uncropped"), r6(F.avg((area >= 0.25).cast("int"))).alias("quarter"))


@query(f"WITH {V.VECTORS}, c AS (SELECT generator, origin, count(*) AS n FROM vectors GROUP BY ALL HAVING count(*) >= 10) SELECT generator, origin, n, count(*) OVER (PARTITION BY generator) AS cells FROM c")
def q_cells_kept(spark, d):
    """Cells of generator and origin with ten rows or more, and how many of a generator's are kept."""
    c = V.vectors(spark, d).groupBy("generator", "origin").agg(F.count("*").alias("n")).where("n >= 10")
    return c.join(F.broadcast(c.groupBy("generator").agg(F.count("*").alias("cells"))), "generator").select("generator", "origin", "n", "cells")  # a row a cell


@query(f"""WITH {S}, g AS (SELECT family, generator, date_diff('day', DATE '1970-01-01', release_date) AS t, median(least(source_width, source_height)) AS m FROM scored WHERE label = 1 GROUP BY ALL),
k AS (SELECT family, {RANK.format(by='PARTITION BY family', by2='PARTITION BY family, ', c='t')} AS a, {RANK.format(by='PARTITION BY family', by2='PARTITION BY family, ', c='m')} AS b FROM g)
SELECT family, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY family""")
def q_size_trend(spark, d):
    """Rank correlation of the median short side of a family's generators with their release dates."""
    side = X.short_side(F.col("source_width"), F.col("source_height")).cast("double")
    g = V.scored(spark, d).where("label = 1").groupBy("family", "generator", F.unix_date("release_date").alias("t")).agg(F.median(side).alias("m"))
    k = ranks.with_ranks(g, ["t", "m"], ["family"])  # a row a generator
    return k.groupBy("family").agg(F.count("*").alias("n"), r6(X.corr("rank_t", "rank_m")).alias("rho"))


@query(f"""WITH {S} SELECT source, count(*) AS count, round(avg(source_width), 6) AS mean, round(stddev_samp(source_width), 6) AS std, CAST(min(source_width) AS BIGINT) AS min, round(quantile_cont(source_width, 0.25), 6) AS q25,
 round(quantile_cont(source_width, 0.5), 6) AS q50, round(quantile_cont(source_width, 0.75), 6) AS q75, CAST(max(source_width) AS BIGINT) AS max FROM scored GROUP BY source""")
def q_describe(spark, d):
    """Count, mean, deviation and quantiles of a size by format."""
    w = F.col("source_width").cast("double")
    q = F.percentile(w, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = V.scored(spark, d).groupBy("source").agg(F.count("*").alias("count"), r6(F.avg(w)).alias("mean"), r6(F.stddev_samp(w)).alias("std"), F.min(w).cast("long").alias("min"), q.alias("q"), F.max(w).cast("long").alias("max"))
    return g.select("source", "count", "mean", "std", "min", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


@query(f"WITH {S}, r AS (SELECT {', '.join(f'avg({c}) AS m{c}, stddev_samp({c}) AS d{c}' for c in V.SCORES)} FROM scored WHERE label = 0) SELECT item_id, {', '.join(f'round(({c} - m{c}) / CASE WHEN d{c} > 0 THEN d{c} ELSE 1 END, 6) AS z{c}' for c in V.SCORES)} FROM scored, r")
def q_zscore_all(spark, d):
    """Scores on the scale of all authentic items, mean and deviation, whatever their half."""
    m = V.scored(spark, d)
    ref = m.where("label = 0").agg(*[f(c).alias(f"{p}{c}") for c in V.SCORES for p, f in (("m", F.avg), ("d", F.stddev_samp))])
    return m.join(F.broadcast(ref)).select("item_id", *[r6((F.col(c) - F.col(f"m{c}")) / F.when(F.col(f"d{c}") > 0, F.col(f"d{c}")).otherwise(1)).alias(f"z{c}") for c in V.SCORES])


@query(f"WITH {S}, g AS (SELECT DISTINCT generator, release_date FROM scored WHERE label = 1) SELECT generator, release_date, row_number() OVER (ORDER BY release_date, generator) AS position FROM g")
def q_stable_order(spark, d):
    """Generators in order of date, then name."""
    g = V.scored(spark, d).where("label = 1").select("generator", "release_date").distinct()
    return ranks.positions(g, [], ["release_date", "generator"], "position")


@query(f"WITH {S}, x AS (SELECT item_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('1234:' || source || ':' || item_id), item_id) AS k FROM scored) SELECT item_id, source, row_number() OVER (PARTITION BY source ORDER BY item_id) AS place FROM x WHERE k <= 40")
def q_seeded_n(spark, d):
    """Forty items of each source by seed, in the order that they had."""
    return sampling.seeded_n(V.scored(spark, d).select("item_id", "source"), ["source"], "item_id", 40)


#: Names for reports.
DISPLAY = {"s1": "total price", "s2": "balance", "s3": "lines", "s4": "extended price", "s5": "discount"}


@query(f"WITH {S} SELECT CASE detector " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY.items()) + " END AS detector, round(avg(score), 6) AS mean FROM (UNPIVOT (SELECT s1, s2, s3, s4, s5 FROM scored) ON s1, s2, s3, s4, s5 INTO NAME detector VALUE score) GROUP BY 1")
def q_display_names(spark, d):
    """Means of the scores under their names for reports."""
    names = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])
    return V.scored(spark, d).unpivot([], V.SCORES, "detector", "score").groupBy("detector").agg(r6(F.avg("score")).alias("mean")).select(F.coalesce(names[F.col("detector")], F.col("detector")).alias("detector"), "mean")


_TREND = " UNION ALL ".join(f"SELECT '{c}' AS detector, generator, date_diff('day', DATE '1970-01-01', release_date) AS t, median({c}) AS m FROM scored WHERE label = 1 GROUP BY ALL" for c in V.SCORES)


@query(f"""WITH {S}, g AS ({_TREND}), k AS (SELECT *, {RANK.format(by='PARTITION BY detector', by2='PARTITION BY detector, ', c='t')} AS rt, {RANK.format(by='PARTITION BY detector', by2='PARTITION BY detector, ', c='m')} AS rm,
 row_number() OVER (PARTITION BY detector ORDER BY generator) AS slot, count(*) OVER (PARTITION BY detector, m) AS same FROM g),
p AS (SELECT detector, perm, generator, rm, row_number() OVER (PARTITION BY detector, perm ORDER BY md5('0:' || perm || ':' || generator), generator) AS slot FROM k, range(1, 1001) t(perm)),
n AS (SELECT p.detector, perm, corr(p.rm, k.rt) AS rho FROM p JOIN k USING (detector, slot) GROUP BY ALL), o AS (SELECT detector, corr(rt, rm) AS rho, count(*) - count(DISTINCT m) AS ties FROM k GROUP BY detector),
q AS (SELECT detector, any_value(o.rho) AS rho, any_value(ties) AS ties, (1 + count(*) FILTER (WHERE abs(n.rho) >= abs(o.rho) - 1e-12)) / (1.0 + count(*)) AS p FROM n JOIN o USING (detector) WHERE isfinite(o.rho) GROUP BY detector),
h AS (SELECT *, row_number() OVER (ORDER BY p, detector) AS k, count(*) OVER () AS m FROM q), z AS (SELECT detector, rho, ties, p, least(1.0, max((m - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS holm FROM h)
SELECT detector, round(rho, 6) AS rho, ties, round(p, 6) AS p, round(holm, 6) AS holm, CASE WHEN holm < 0.05 THEN 'trend' ELSE 'no trend shown' END AS verdict FROM z""")
def q_trend_tests(spark, d):
    """The trend of every score's generator medians with release date: permutation p, Holm over scores, verdict. Constant scores have no rank correlation and stay out."""
    m = V.scored(spark, d).where("label = 1").withColumn("t", F.unix_date("release_date"))
    g = m.groupBy("generator", "t").agg(*[F.median(c).alias(c) for c in V.SCORES]).unpivot(["generator", "t"], V.SCORES, "detector", "m")  # a row a generator and score
    k = ranks.with_ranks(g, ["t", "m"], ["detector"])
    null = ranks.permuted(k, "generator", "rank_t", ["detector"], 1000).join(k.select("detector", "generator", "rank_m"), ["detector", "generator"]).groupBy("detector", "perm").agg(X.corr("rank_m", "shuffled").alias("null"))
    seen = k.groupBy("detector").agg(X.corr("rank_t", "rank_m").alias("rho"), (F.count("*") - F.count_distinct("m")).alias("ties")).where("rho IS NOT NULL AND NOT isnan(rho)")
    p = null.join(F.broadcast(seen), "detector").groupBy("detector").agg(F.first("rho").alias("rho"), F.first("ties").alias("ties"), ((1 + F.count_if(F.abs("null") >= F.abs("rho") - 1e-12)) / (1.0 + F.count("*"))).alias("p"))
    h = ranks.holm(p.withColumn("all", F.lit(1)).select("all", "detector", "rho", "ties", "p"), "p", ["all"])
    return h.select("detector", r6("rho").alias("rho"), "ties", r6("p").alias("p"), r6("holm").alias("holm"), F.when(F.col("holm") < 0.05, "trend").otherwise("no trend shown").alias("verdict"))


@query()
def q_explained(spark, d):
    """The share of variance of each component of the centred vectors, and of all components up to it."""
    _, share = vectors.pca(vectors.centre(V.vectors(spark, d), ["family", "origin"]), 64)
    rows = [(k, round(float(s), 6), round(float(c), 6)) for k, (s, c) in enumerate(zip(share, np.cumsum(share), strict=True), 1)]
    return spark.createDataFrame(rows, "component int, share double, cumulative double")


_OFF = [(i - 1, j - 1) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
_PICK = lambda f: "[" + ", ".join(f"m[{k + 1}]" for k, o in enumerate(_OFF) if f(o)) + "]"
_SUM = lambda a: f"round(coalesce(list_sum({a}), 0), 5)"


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), w AS (SELECT vec_id, x, list_transform(range(1, 9), lambda i: ({' + '.join(f'x[i + {8 * k}]' for k in range(8))}) / 8) AS m FROM v)
SELECT vec_id, {_SUM('m')} AS mean, round(list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - m[(i - 1) % 8 + 1]))), 5) AS deviations, {_SUM(_PICK(lambda o: True))} AS ring_1, 0.0::DOUBLE AS ring_2,
 0.0::DOUBLE AS even, {_SUM(_PICK(lambda o: o[0] % 2 or o[1] % 2))} AS odd FROM w""")
def q_ring_blocks(spark, d):
    """Sums over blocks of a vector of eight channels about a centre (a square of three has one ring)."""
    b = X.ring_blocks(F.col("embedding").cast("array<double>"), 8, 3)
    total = lambda a, f=lambda x: x: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x)), 5)
    return V.read(spark, d, "embeddings").select("vec_id", total(b["mean"]).alias("mean"), total(b["deviations"], F.abs).alias("deviations"), *[total(b[k]).alias(n) for k, n in (("ring 1", "ring_1"), ("ring 2", "ring_2"), ("even", "even"), ("odd", "odd"))])


_PRINT = "count(*) AS n, " + ", ".join(f"CAST(sum(CAST('0x' || substr(md5({{0}}), {a}, 7) AS BIGINT)) AS BIGINT) AS h{k}" for k, a in ((1, 1), (2, 8), (3, 15)))
_WHOLE, _PART = "o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority", "o_orderkey || '|' || o_custkey"


@query(f"""WITH w AS (SELECT {_PRINT.format(_WHOLE)} FROM orders), p AS (SELECT {_PRINT.format(_PART)} FROM orders), r AS (SELECT 'panel' AS name, * FROM w UNION ALL SELECT 'older', * FROM p UNION ALL SELECT 'other', n, h1 + 1, h2, h3 FROM w)
SELECT name, CASE WHEN (n, h1, h2, h3) IN (SELECT * FROM w) THEN 'whole' WHEN (n, h1, h2, h3) IN (SELECT * FROM p) THEN 'subset' ELSE 'neither' END AS matches FROM r""")
def q_recorded_match(spark, d):
    """Recorded fingerprints against a table: whole, as it was before columns were added, or neither."""
    o, whole, part = V.read(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], ["o_custkey"]
    w, p = audit.provenance(o, "o_orderkey", whole), audit.provenance(o, "o_orderkey", part)
    recorded = w.withColumn("name", F.lit("panel")).unionByName(p.withColumn("name", F.lit("older"))).unionByName(w.withColumn("h1", F.col("h1") + 1).withColumn("name", F.lit("other")))
    return audit.recorded_as(o, "o_orderkey", whole, part, recorded)


@query()
def q_draw_whole(spark, d):
    """Rows of each label and source of a draw of equal groups that keeps one source whole."""
    m = V.scored(spark, d)
    n = m.where("label = 1").groupBy("generator").count().agg(F.min("count")).first()[0]
    least = m.where("label = 0").groupBy("source").count().orderBy("count", "source").first()
    got = sampling.draw_keeping_whole(m, "label", "generator", "split", "source", "item_id", n, [least.source])
    return got.groupBy("label", "source").agg(F.count("*").alias("n"), F.lit(least.source).alias("whole"))
