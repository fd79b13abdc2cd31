"""Queries of tables, audits, sampling and ranks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import audit, ranks, sampling
from ..sources import views as V
from .registry import query

S = V.SCORED


def r6(c):
    return F.round(c, 6)


@query(f"WITH {S} SELECT item_id, detector, round(score, 8) AS score FROM (UNPIVOT (SELECT item_id, s1, s2, s3, s4, s5 FROM scored) ON s1, s2, s3, s4, s5 INTO NAME detector VALUE score)")
def q_score_join(spark, d):
    wide = V.scored(spark, d)
    long = wide.unpivot("item_id", V.SCORES, "detector", "score")
    return audit.one_to_one(wide.select("item_id"), long.groupBy("item_id").pivot("detector", V.SCORES).agg(F.first("score")), "item_id").unpivot("item_id", V.SCORES, "detector", "score").select("item_id", "detector", F.round("score", 8).alias("score"))


@query(f"""WITH {S}, r AS (SELECT {', '.join(f"avg({c}) AS m{c}, stddev_samp({c}) AS d{c}" for c in V.SCORES)} FROM scored WHERE label = 0 AND split = 'train')
SELECT item_id, {', '.join(f"round(({c} - m{c}) / CASE WHEN d{c} > 0 THEN d{c} ELSE 1 END, 6) AS z{c}" for c in V.SCORES)} FROM scored, r""")
def q_zscore_reference(spark, d):
    m = V.scored(spark, d)
    ref = m.where("label = 0 AND split = 'train'").agg(*[f(c).alias(f"{p}{c}") for c in V.SCORES for p, f in (("m", F.avg), ("d", F.stddev_samp))])
    return m.join(F.broadcast(ref)).select("item_id", *[r6((F.col(c) - F.col(f"m{c}")) / F.when(F.col(f"d{c}") > 0, F.col(f"d{c}")).otherwise(1)).alias(f"z{c}") for c in V.SCORES])


@query(f"""WITH {S} SELECT detector, round(avg(score) FILTER (WHERE split = 'train'), 6) AS mean_train, round(avg(score), 6) AS mean_all,
 round(abs(avg(score) FILTER (WHERE split = 'train') - avg(score)) / stddev_samp(score) FILTER (WHERE split = 'train'), 6) AS shift
 FROM (UNPIVOT (SELECT split, s1, s2, s3, s4, s5 FROM scored WHERE label = 0) ON s1, s2, s3, s4, s5 INTO NAME detector VALUE score) GROUP BY detector""")
def q_rescale_shift(spark, d):
    long = V.scored(spark, d).where("label = 0").unpivot("split", V.SCORES, "detector", "score")
    train = F.when(F.col("split") == "train", F.col("score"))
    return long.groupBy("detector").agg(r6(F.avg(train)).alias("mean_train"), r6(F.avg("score")).alias("mean_all"), r6(F.abs(F.avg(train) - F.avg("score")) / F.stddev_samp(train)).alias("shift"))


@query(f"WITH {S} SELECT family, count(*) AS n, count(DISTINCT generator) AS n_generators, min(release_date) AS available FROM scored WHERE label = 1 GROUP BY family")
def q_family_registry(spark, d):
    return V.scored(spark, d).where("label = 1").groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("generator").alias("n_generators"), F.min("release_date").alias("available"))


@query(f"WITH {V.GENERATORS} SELECT generator, family, release_date, n FROM generators")
def q_generator_registry(spark, d):
    return V.generators(spark, d).select("generator", "family", "release_date", "n")


@query(f"WITH {S} SELECT family, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, least(count(*) FILTER (WHERE split = 'train'), count(*) FILTER (WHERE split = 'val')) > 0 AS covered FROM scored GROUP BY family")
def q_coverage_pivot(spark, d):
    return audit.coverage(V.scored(spark, d), "family", "split", ["train", "val"])


@query(f"WITH {S} SELECT family, split, source, count(*) AS n FROM scored GROUP BY GROUPING SETS ((family), (split), (source), (family, split), ())")
def q_composition_sets(spark, d):
    V.scored(spark, d).createOrReplaceTempView("composition_input")
    return spark.sql("SELECT family, split, source, count(*) AS n FROM composition_input GROUP BY GROUPING SETS ((family), (split), (source), (family, split), ())")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_audit_unique(spark, d):
    return audit.duplicate_keys(V.read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5")
def q_audit_offenders(spark, d):
    return audit.first_offenders(audit.duplicate_keys(V.read(spark, d, "lineitem"), "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def q_audit_dictionary(spark, d):
    """Customers of orders that a dictionary of those with a positive balance lacks."""
    known = V.read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return audit.not_in_dimension(V.read(spark, d, "orders"), known, "o_custkey")


@query("SELECT user_id FROM events WHERE event_id % 2 = 0 INTERSECT SELECT user_id FROM events WHERE event_id % 2 = 1")
def q_split_disjoint(spark, d):
    """Users on both sides of a split of their events: a split by event isn't one by user."""
    e = V.read(spark, d, "events")
    return audit.overlap(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id")


@query("WITH l AS (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND source <> 'src3'), r AS (SELECT DISTINCT source FROM documents WHERE lang = 'fr' AND source <> 'src5') SELECT source, 'left' AS side FROM l WHERE source NOT IN (SELECT source FROM r) UNION ALL SELECT source, 'right' FROM r WHERE source NOT IN (SELECT source FROM l)")
def q_fingerprint_parity(spark, d):
    """Sources that only one of two halves of the documents has: each half is drawn without one of them."""
    docs = V.read(spark, d, "documents")
    return audit.value_parity(docs.where("lang = 'en' AND source <> 'src3'"), docs.where("lang = 'fr' AND source <> 'src5'"), "source")


@query(f"WITH {S} SELECT \"column\", n_rows, n_missing FROM (SELECT 'generator' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE generator IS NULL) AS n_missing FROM scored UNION ALL SELECT 's1', count(*), count(*) FILTER (WHERE s1 IS NULL) FROM scored UNION ALL SELECT 'release_date', count(*), count(*) FILTER (WHERE release_date IS NULL) FROM scored)")
def q_completeness(spark, d):
    return audit.completeness(V.scored(spark, d), ["generator", "s1", "release_date"])


@query(f"WITH {S} SELECT \"column\", round(stddev_samp(score), 6) AS std, stddev_samp(score) <= 1e-6 AS degenerate FROM (UNPIVOT (SELECT s1, s2, s3, s4, s5 FROM scored) ON s1, s2, s3, s4, s5 INTO NAME \"column\" VALUE score) GROUP BY \"column\"")
def q_degenerate(spark, d):
    return audit.spread(V.scored(spark, d), V.SCORES).withColumn("std", r6("std"))


@query("SELECT o_orderpriority, count(*) AS n_rows FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL GROUP BY o_orderpriority")
def q_domain(spark, d):
    return audit.outside_domain(V.read(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT p_partkey, flat, n_same FROM (SELECT p_partkey, replace(p_brand || '/' || p_type || '/' || p_size, '/', '_') AS flat, count(*) OVER (PARTITION BY replace(p_brand || '/' || p_type || '/' || p_size, '/', '_')) AS n_same FROM part) WHERE n_same > 1")
def q_key_collision(spark, d):
    part = V.read(spark, d, "part")
    return audit.collisions(part, X.flat_key(F.concat_ws("/", "p_brand", "p_type", "p_size")), "flat").select("p_partkey", "flat", "n_same")


@query("SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 7) AS BIGINT)) AS BIGINT) AS h1, CAST(sum(CAST('0x' || substr(h, 8, 7) AS BIGINT)) AS BIGINT) AS h2, CAST(sum(CAST('0x' || substr(h, 15, 7) AS BIGINT)) AS BIGINT) AS h3 FROM (SELECT md5(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) AS h FROM orders)")
def q_provenance(spark, d):
    return audit.provenance(V.read(spark, d, "orders"), "o_orderkey", ["o_custkey", "o_orderpriority"])


@query("SELECT 'o_orderstatus' AS \"column\", count(DISTINCT o_orderstatus) AS n_values, count(DISTINCT o_orderstatus) = 1 AS single FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority) = 1 FROM orders")
def q_single_valued(spark, d):
    return audit.single_valued(V.read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT CAST(r AS BIGINT) AS shard FROM range(0, 200) t(r) WHERE r NOT IN (SELECT user_id FROM events)")
def q_missing_shards(spark, d):
    return audit.missing_shards(V.read(spark, d, "events").select(F.col("user_id").alias("shard")).distinct(), "shard", 200)


@query("SELECT family, min(n) = max(n) AS equal_sizes, coalesce(min(gap) > 0, true) AS increasing FROM (SELECT family, n, date_diff('day', lag(release_date) OVER (PARTITION BY family ORDER BY release_date), release_date) AS gap FROM (WITH " + V.GENERATORS + " SELECT * FROM generators)) GROUP BY family")
def q_balanced_groups(spark, d):
    return audit.balanced_groups(V.generators(spark, d), "family", "release_date", "n")


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS BOOLEAN) AS finite FROM embeddings")
def q_finite_vectors(spark, d):
    return V.read(spark, d, "embeddings").select("vec_id", audit.finite("embedding").alias("finite"))


@query("SELECT vec_id, round(10 * log10(65025.0 / (list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)) / len(embedding))), 4) AS psnr FROM embeddings")
def q_psnr(spark, d):
    e = V.read(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.round(audit.psnr(F.col("embedding"), F.reverse("embedding")), 4).alias("psnr"))


@query("SELECT p_partkey, CASE WHEN p_size * 40 <= 256 THEN '<=256' WHEN p_size * 40 <= 512 THEN '257-512' WHEN p_size * 40 <= 1024 THEN '513-1024' ELSE '>1024' END AS bucket FROM part")
def q_size_bucket(spark, d):
    return V.read(spark, d, "part").select("p_partkey", X.size_bucket(F.col("p_size") * 40).alias("bucket"))


@query(f"WITH {S} SELECT rule, count(*) AS n FROM (SELECT 'origin=fake' AS rule FROM scored WHERE source = 'fake' UNION ALL SELECT 'origin!=fake' FROM scored WHERE source <> 'fake' UNION ALL SELECT 'short<=512' FROM scored WHERE least(source_width, source_height) <= 512 UNION ALL SELECT 'short>=1024' FROM scored WHERE least(source_width, source_height) >= 1024 UNION ALL SELECT 'all' FROM scored) GROUP BY rule")
def q_subset_predicate(spark, d):
    rules = ["origin=fake", "origin!=fake", "short<=512", "short>=1024", "all"]
    hit = [F.when(X.subset(r, "source", X.short_side(F.col("source_width"), F.col("source_height"))), r) for r in rules]
    return V.scored(spark, d).select(F.explode(F.array_compact(F.array(*hit))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {S} SELECT item_id, CAST(floor(floor((source_width - 200) / 2.0) / 8) * 8 AS BIGINT) AS crop_left, CAST(floor(floor((source_height - 200) / 2.0) / 8) * 8 AS BIGINT) AS crop_top, round(log10(40000.0 / (source_width * source_height)), 6) AS log_fraction, 'crops/native_200_align8/' || item_id || '.png' AS path FROM scored")
def q_box_geometry(spark, d):
    m = V.scored(spark, d)
    return m.select(
        "item_id", X.centre_box(F.col("source_width"), 200, 8).alias("crop_left"), X.centre_box(F.col("source_height"), 200, 8).alias("crop_top"),
        r6(F.log10(X.area_fraction(F.col("source_width"), F.col("source_height"), 200))).alias("log_fraction"), X.crop_path(F.col("item_id").cast("string"), X.crop_policy(200, 8)).alias("path"),
    )


DRAW = "row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}:' || {parts} || ':' || {key}), {key})"


@query(f"""WITH {S}, f AS (SELECT * FROM scored WHERE label = 1), z AS (SELECT generator, count(*) AS n FROM f GROUP BY generator),
q AS (SELECT generator, n // 2 + CASE WHEN n % 2 = 1 AND coalesce(sum(n % 2) OVER (ORDER BY generator ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 THEN 1 ELSE 0 END AS n_train FROM z),
r AS (SELECT item_id, generator, {DRAW.format(by='generator', seed=1234, parts='generator', key='item_id')} AS draw FROM f)
SELECT item_id, generator, CASE WHEN draw <= n_train THEN 'train' ELSE 'val' END AS half FROM r JOIN q USING (generator)""")
def q_stratified_split(spark, d):
    return sampling.stratified_split(V.scored(spark, d).where("label = 1"), "generator", "item_id").select("item_id", "generator", "half")


ALLOCATE = """e AS (SELECT {by}{part}, n, {total} * n / sum(n) OVER ({over}) AS exact, sum(n) OVER ({over}) AS grand FROM z), a AS (SELECT *, floor(exact) AS fl FROM e),
b AS (SELECT *, row_number() OVER ({over} ORDER BY round(exact - fl, 9) DESC, {part} DESC) AS o, {total} - sum(fl) OVER ({over}) AS short FROM a),
q AS (SELECT {by}{part}, CAST(CASE WHEN {total} >= grand THEN n ELSE fl + CASE WHEN o <= short THEN 1 ELSE 0 END END AS BIGINT) AS share FROM b)"""


@query(f"WITH {S}, z AS (SELECT source, count(*) AS n FROM scored WHERE label = 0 GROUP BY source), {ALLOCATE.format(by='', part='source', total=1001, over='')} SELECT source, share FROM q")
def q_allocate(spark, d):
    sizes = V.scored(spark, d).where("label = 0").groupBy("source").agg(F.count("*").alias("size"))
    return sampling.allocate(sizes, "source", "size", F.lit(1001)).select("source", "share")


@query(f"""WITH {S}, f AS (SELECT * FROM scored WHERE label = 1), z AS (SELECT generator, split, count(*) AS n FROM f GROUP BY ALL),
{ALLOCATE.format(by='generator, ', part='split', total=7, over='PARTITION BY generator')},
r AS (SELECT item_id, generator, split, {DRAW.format(by='generator, split', seed=1234, parts="generator || ':' || split", key='item_id')} AS draw FROM f),
ones AS (SELECT item_id, 1 AS label, generator, split FROM r JOIN q USING (generator, split) WHERE draw <= share),
zs AS (SELECT source, count(*) AS n FROM scored WHERE label = 0 GROUP BY source), es AS (SELECT source, n, t * n / sum(n) OVER () AS exact, t FROM zs, (SELECT count(*) AS t FROM ones)),
bs AS (SELECT *, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, source DESC) AS o, t - sum(floor(exact)) OVER () AS short, sum(n) OVER () AS grand FROM es),
qs AS (SELECT source, CASE WHEN t >= grand THEN n ELSE floor(exact) + CASE WHEN o <= short THEN 1 ELSE 0 END END AS share FROM bs),
rs AS (SELECT item_id, source, split, {DRAW.format(by='source', seed=1234, parts='source', key='item_id')} AS draw FROM scored WHERE label = 0)
SELECT item_id, label, generator, split FROM ones UNION ALL SELECT item_id, 0, NULL, split FROM rs JOIN qs USING (source) WHERE draw <= share""")
def q_draw_matched(spark, d):
    m = V.scored(spark, d)
    return sampling.draw_matched(m, "label", "generator", "split", "source", "item_id", 7).select("item_id", "label", "generator", "split")


@query(f"WITH {S} SELECT item_id, label, CAST(({DRAW.format(by='label, source', seed=0, parts="label || ':' || source", key='item_id')} - 1) % 5 AS INT) AS fold FROM scored")
def q_kfolds(spark, d):
    return sampling.kfolds(V.scored(spark, d), ["label", "source"], "item_id").select("item_id", "label", "fold")


@query(f"WITH {S} SELECT item_id, generator FROM (SELECT item_id, generator, row_number() OVER (PARTITION BY generator ORDER BY item_id) AS r FROM scored WHERE label = 1) WHERE r <= 3")
def q_first_n(spark, d):
    return sampling.first_n(V.scored(spark, d).where("label = 1"), ["generator"], ["item_id"], 3).select("item_id", "generator")


@query("""WITH c AS (SELECT event_type, event_id // 100 AS block, count(*) AS c FROM events GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY block) AS have FROM c)
SELECT event_type, min(block) FILTER (WHERE have >= 50) AS reached, CAST(max(have) AS BIGINT) AS total, least(coalesce(min(block) FILTER (WHERE have >= 50), 40), 40) AS taken FROM r GROUP BY event_type""")
def q_row_group_prefix(spark, d):
    return sampling.prefix_until(V.read(spark, d, "events").withColumn("block", F.expr("event_id DIV 100")), "block", "event_type", 50, 40)


RANK = "(rank() OVER ({by} ORDER BY {c}) + (count(*) OVER ({by2}{c}) - 1) / 2.0)"


@query(f"""WITH {S}, f AS (SELECT DISTINCT family FROM scored WHERE label = 1), x AS (SELECT f.family, s.label, s.s1 FROM scored s JOIN f ON s.label = 0 OR s.family = f.family),
k AS (SELECT family, label, {RANK.format(by='PARTITION BY family', by2='PARTITION BY family, ', c='s1')} AS r FROM x)
SELECT family, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auroc FROM k GROUP BY family""")
def q_auroc_by_family(spark, d):
    m = V.scored(spark, d)
    families = m.where("label = 1").select(F.col("family").alias("of")).distinct()
    rows = m.join(F.broadcast(families), (m.label == 0) | (m.family == families.of)).select(F.col("of").alias("family"), "label", "s1")
    return ranks.auroc(rows, "s1", "label", ["family"]).withColumn("auroc", r6("auroc"))


@query(f"""WITH {S}, f AS (SELECT family, {', '.join(f"{RANK.format(by='PARTITION BY family', by2='PARTITION BY family, ', c=c)} AS r{c}" for c in V.SCORES)} FROM scored WHERE label = 1)
{' UNION ALL '.join(f"SELECT family, '{a}' AS a, '{b}' AS b, round(corr(r{a}, r{b}), 6) AS rho FROM f GROUP BY family" for i, a in enumerate(V.SCORES) for b in V.SCORES[i + 1 :])}""")
def q_spearman_matrix(spark, d):
    return ranks.spearman_matrix(V.scored(spark, d).where("label = 1"), V.SCORES, ["family"]).withColumn("rho", r6("rho"))


@query(f"WITH {S} SELECT generator, release_date, {', '.join(f'round(median({c}), 6) AS median_{c}' for c in V.SCORES)} FROM scored WHERE label = 1 GROUP BY ALL")
def q_median_by_generator(spark, d):
    return V.scored(spark, d).where("label = 1").groupBy("generator", "release_date").agg(*[r6(F.median(c)).alias(f"median_{c}") for c in V.SCORES])


@query(f"WITH {S}, g AS (SELECT family, generator, release_date, median(s1) AS m FROM scored WHERE label = 1 GROUP BY ALL) SELECT family, round(regr_slope(m, date_diff('day', DATE '1970-01-01', release_date)) * 365, 4) AS slope_per_year, count(*) AS n FROM g GROUP BY family")
def q_trend_slope(spark, d):
    g = V.scored(spark, d).where("label = 1").groupBy("family", "generator", "release_date").agg(F.median("s1").alias("m"))
    return g.groupBy("family").agg(F.round(F.regr_slope("m", F.unix_date("release_date").cast("double")) * 365, 4).alias("slope_per_year"), F.count("*").alias("n"))


@query(f"""WITH {S}, t AS (SELECT quantile_cont(s1, 0.95) AS t FROM scored WHERE source = '1-URGENT')
SELECT source, count(*) AS n, round(avg(CAST(s1 > t AS INT)), 6) AS exceed FROM scored, t GROUP BY source""")
def q_threshold_fpr(spark, d):
    m = V.scored(spark, d)
    t = m.where("source = '1-URGENT'").agg(F.percentile("s1", 0.95).alias("t"))
    return m.join(F.broadcast(t)).groupBy("source").agg(F.count("*").alias("n"), r6(F.avg((F.col("s1") > F.col("t")).cast("int"))).alias("exceed"))


@query(f"""WITH {S}, b AS (SELECT *, CASE WHEN source_width < 1000 THEN 'narrow' WHEN source_width < 2000 THEN 'middle' ELSE 'wide' END AS band FROM scored),
k AS (SELECT band, label, {RANK.format(by='PARTITION BY band', by2='PARTITION BY band, ', c='s4')} AS r FROM b)
SELECT band, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auroc FROM k GROUP BY band""")
def q_band_auroc(spark, d):
    band = F.when(F.col("source_width") < 1000, "narrow").when(F.col("source_width") < 2000, "middle").otherwise("wide")
    return ranks.auroc(V.scored(spark, d).withColumn("band", band), "s4", "label", ["band"]).withColumn("auroc", r6("auroc"))


@query(f"""WITH {S}, a AS (SELECT log10(40000.0 / (source_width * source_height)) AS f, s1, s2, s3, s4, s5 FROM scored WHERE label = 0)
SELECT detector, round(regr_slope(score, f), 4) AS slope, round(corr(f, score), 6) AS rho, CASE WHEN regr_slope(score, f) < 0 THEN 'helps' ELSE 'hurts' END AS residual
FROM (UNPIVOT a ON s1, s2, s3, s4, s5 INTO NAME detector VALUE score) GROUP BY detector""")
def q_residual_slopes(spark, d):
    a = V.scored(spark, d).where("label = 0").withColumn("f", F.log10(X.area_fraction(F.col("source_width"), F.col("source_height"), 200)))
    g = a.unpivot("f", V.SCORES, "detector", "score").groupBy("detector").agg(F.regr_slope("score", "f").alias("b"), X.corr("f", "score").alias("rho"))
    return g.select("detector", F.round("b", 4).alias("slope"), r6("rho").alias("rho"), F.when(F.col("b") < 0, "helps").otherwise("hurts").alias("residual"))


@query(f"WITH {S} SELECT item_id, round(s1, 4) AS score FROM scored WHERE label = 0 ORDER BY s1 DESC, item_id LIMIT 20")
def q_top_false_positives(spark, d):
    return V.scored(spark, d).where("label = 0").orderBy(F.desc("s1"), "item_id").limit(20).select("item_id", F.round("s1", 4).alias("score"))


@query(f"WITH {S} SELECT item_id FROM scored WHERE item_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def q_resume(spark, d):
    done = V.read(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("item_id"))
    return V.scored(spark, d).select("item_id").join(done, "item_id", "left_anti")


@query("""WITH o AS (SELECT event_type AS key, CAST(count(*) AS VARCHAR) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT event_type AS key, CAST(count(*) AS VARCHAR) AS v FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1)
SELECT key, o.v AS old, n.v AS new FROM o FULL JOIN n USING (key) WHERE o.v IS DISTINCT FROM n.v""")
def q_config_drift(spark, d):
    e = V.read(spark, d, "events")
    rec = lambda x: x.groupBy(F.col("event_type").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return audit.drift(rec(e.where("event_id % 2 = 0")), rec(e.where("event_id % 2 = 1 AND event_type <> 'view'")), "key", "value")


@query(f"""WITH {S}, g AS (SELECT family, split, avg(s1) AS m FROM scored WHERE label = 1 GROUP BY ALL), p AS (SELECT family, split, round(m - floor(m), 6) / 20 AS p FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY p, family) AS k, count(*) OVER (PARTITION BY split) AS m FROM p)
SELECT family, split, round(p, 6) AS p, round(least(1.0, max((m - k + 1) * p) OVER (PARTITION BY split ORDER BY k ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM r""")
def q_holm(spark, d):
    g = V.scored(spark, d).where("label = 1").groupBy("family", "split").agg(F.avg("s1").alias("m"))
    p = g.select("family", "split", (F.round(F.col("m") - F.floor("m"), 6) / 20).alias("p"))
    return ranks.holm(p, "p", ["split"]).select("family", "split", r6("p").alias("p"), r6("holm").alias("holm"))


@query(f"""WITH {S}, g AS (SELECT generator, date_diff('day', DATE '1970-01-01', release_date) AS t, median(s1) AS m FROM scored WHERE label = 1 GROUP BY ALL),
k AS (SELECT *, {RANK.format(by='', by2='PARTITION BY ', c='t')} AS rt, {RANK.format(by='', by2='PARTITION BY ', c='m')} AS rm, row_number() OVER (ORDER BY generator) AS slot FROM g),
p AS (SELECT perm, generator, rm, row_number() OVER (PARTITION BY perm ORDER BY md5('0:' || perm || ':' || generator), generator) AS slot FROM k, range(1, 201) t(perm)),
n AS (SELECT perm, corr(p.rm, k.rt) AS rho FROM p JOIN k USING (slot) GROUP BY perm), o AS (SELECT corr(rt, rm) AS rho FROM k)
SELECT round(any_value(o.rho), 6) AS rho, round(avg(n.rho), 6) AS null_mean, round((1 + count(*) FILTER (WHERE abs(n.rho) >= abs(o.rho) - 1e-12)) / (1.0 + count(*)), 6) AS p, round(quantile_cont(abs(n.rho), 0.95), 6) AS critical FROM n, o""")
def q_spearman_perm(spark, d):
    g = V.scored(spark, d).where("label = 1").groupBy("generator", "release_date").agg(F.median("s1").alias("m")).withColumn("t", F.unix_date("release_date"))
    k = ranks.with_ranks(g.withColumn("one", F.lit(1)), ["t", "m"], ["one"])  # a row for each generator
    null = ranks.permuted(k, "generator", "rank_t", ["one"], 200).join(k.select("generator", "rank_m"), "generator").groupBy("perm").agg(X.corr("rank_m", "shuffled").alias("null"))
    observed = k.agg(X.corr("rank_t", "rank_m").alias("rho"))
    both = null.join(F.broadcast(observed))
    return both.agg(
        r6(F.first("rho")).alias("rho"), r6(F.avg("null")).alias("null_mean"), r6((1 + F.count_if(F.abs("null") >= F.abs("rho") - 1e-12)) / (1.0 + F.count("*"))).alias("p"), r6(F.percentile(F.abs("null"), 0.95)).alias("critical")
    )


@query(f"""WITH {S}, x AS (SELECT split, label, s4 FROM scored), n AS (SELECT split, label, s4, count(*) AS c FROM x GROUP BY ALL)
SELECT split, label, s4, round(sum(c) OVER (PARTITION BY split, label ORDER BY s4) / sum(c) OVER (PARTITION BY split, label), 6) AS share FROM n""")
def q_ecdf(spark, d):
    return ranks.ecdf(V.scored(spark, d), "s4", ["split", "label"]).withColumn("share", r6("share"))


@query(f"WITH {S} SELECT source, label, count(*) AS n, round(median(s1), 6) AS median_s1, round(quantile_cont(s1, 0.25), 6) AS q25, round(quantile_cont(s1, 0.75), 6) AS q75, round(var_samp(s1), 2) AS var FROM scored GROUP BY ALL")
def q_group_stats(spark, d):
    return V.scored(spark, d).groupBy("source", "label").agg(F.count("*").alias("n"), r6(F.median("s1")).alias("median_s1"), r6(F.percentile("s1", 0.25)).alias("q25"), r6(F.percentile("s1", 0.75)).alias("q75"), F.round(F.var_samp("s1"), 2).alias("var"))


@query(f"""WITH {S}, o AS (SELECT family, label, s1 FROM scored), a AS (SELECT DISTINCT family FROM scored WHERE label = 1)
SELECT coalesce(a.family, 'all') AS family, count(*) AS n, round(avg(s1), 6) AS mean FROM o JOIN a ON o.label = 0 OR o.family = a.family GROUP BY GROUPING SETS ((a.family)) UNION ALL SELECT 'all', count(*), round(avg(s1), 6) FROM o""")
def q_overall_and_family(spark, d):
    m = V.scored(spark, d)
    fam = m.where("label = 1").select(F.col("family").alias("of")).distinct()
    stat = [F.count("*").alias("n"), r6(F.avg("s1")).alias("mean")]
    each = m.join(F.broadcast(fam), (m.label == 0) | (m.family == fam.of)).groupBy(F.col("of").alias("family")).agg(*stat)
    return each.unionByName(m.agg(*stat).select(F.lit("all").alias("family"), "n", "mean"))


@query("SELECT a.doc_id, a.lang FROM documents a WHERE a.source IN ('src1', 'src3') UNION ALL SELECT b.doc_id, b.lang FROM documents b WHERE b.source = 'src5'")
def q_union_halves(spark, d):
    docs = V.read(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.where(F.col("source").isin("src1", "src3")).unionByName(docs.where("source = 'src5'"), allowMissingColumns=True).select("doc_id", "lang")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_deduplicate(spark, d):
    return V.read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(list_sort(list(value))[CAST(floor(0.5 * (count(*) - 1)) AS INT) + 1], 6) AS p50, round(list_sort(list(value))[CAST(floor(0.9 * (count(*) - 1)) AS INT) + 1], 6) AS p90 FROM events GROUP BY event_type")
def q_timing_percentiles(spark, d):
    e = V.read(spark, d, "events").select("event_type", "value")
    sizes = e.groupBy("event_type").agg((F.count("*") - 1).alias("m"))
    e = ranks.positions(e, ["event_type"], ["value"], "place").withColumn("place", F.col("place") - 1).join(F.broadcast(sizes), "event_type")
    at = lambda q: r6(F.max(F.when(F.col("place") == F.floor(F.lit(q) * F.col("m")), F.col("value"))))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"))
