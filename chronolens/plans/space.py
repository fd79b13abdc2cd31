"""Queries on feature vectors and release time, with their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import attribution, mixture, ranks, regress, specs, temporal, vectors
from ..operators.lineage import written
from ..sources import views as V
from .registry import query
from .tables import r6

VV = V.VECTORS
LONG = "l AS (SELECT v.vec_id, v.generator, v.family, v.origin, v.release_date, i, CAST(v.x[i + 1] AS DOUBLE) AS v FROM vectors v, range(0, 64) t(i))"


@query(f"WITH {VV}, {LONG}, q AS (SELECT i, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM l GROUP BY i) SELECT vec_id, CAST(i AS INT) AS i, round((v - m) / CASE WHEN b > a THEN b - a ELSE 1 END, 5) AS v FROM l JOIN q USING (i)")
def q_robust_scale(spark, d):
    return vectors.long(vectors.scale(V.vectors(spark, d)), ["vec_id"]).withColumn("v", F.round("v", 5))


@query(f"WITH {VV}, {LONG} SELECT vec_id, CAST(i AS INT) AS i, round(v - avg(v) OVER (PARTITION BY family, origin, i), 6) AS v FROM l")
def q_group_centre(spark, d):
    v = V.vectors(spark, d)
    return vectors.long(vectors.centre(v, ["family", "origin"]), ["vec_id"]).withColumn("v", r6("v"))


@query(f"WITH {VV}, {LONG}, g AS (SELECT i, generator, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY ALL), t AS (SELECT sum(n * s) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM g GROUP BY i) SELECT round(sum(b) / (sum(b) + sum(w)), 6) AS share FROM t")
def q_between_share(spark, d):
    return vectors.between_share(V.vectors(spark, d), ["generator"]).select(r6("share").alias("share"))


@query(f"WITH {VV}, {LONG} SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.v * b.v), 4) AS xx FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def q_gram(spark, d):
    return vectors.gram(V.vectors(spark, d)).select("i", "j", F.round("xx", 4).alias("xx"))


@query()
def q_pca_scores(spark, d):
    scored, share = vectors.pca(vectors.centre(V.vectors(spark, d), ["family"]), 5)
    return scored.select("vec_id", *[F.round(F.col("scores")[k], 4).alias(f"pc{k + 1}") for k in range(5)], *[F.lit(round(float(s), 6)).alias(f"share{k + 1}") for k, s in enumerate(share)])


#: The five nearest other vectors of every vector.
NEAR = """p AS (SELECT a.vec_id, b.vec_id AS other, round(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) ** 2)), 9) AS d2 FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id {on}),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) AS rank FROM p QUALIFY rank <= 5)"""


@query(f"WITH {VV}, {NEAR.format(on='')}, v AS (SELECT n.vec_id, o.generator AS voted, count(*) AS c, min(rank) AS f FROM n JOIN vectors o ON o.vec_id = n.other GROUP BY ALL), b AS (SELECT vec_id, arg_min(voted, f - 100 * c) AS predicted FROM v GROUP BY vec_id), r AS (SELECT m.generator AS truth, avg(CAST(predicted = m.generator AS INT)) AS recall FROM b JOIN vectors m USING (vec_id) GROUP BY ALL) SELECT round(avg(recall), 6) AS accuracy FROM r")
def q_knn_accuracy(spark, d):
    v = V.vectors(spark, d)
    return vectors.balanced_accuracy(vectors.votes(vectors.neighbours(v, "vec_id", "x", 5), v, "vec_id", "generator")).select(r6("accuracy").alias("accuracy"))


@query(f"WITH {VV}, {NEAR.format(on='AND a.family = b.family AND a.origin = b.origin')}, v AS (SELECT n.vec_id, o.generator AS voted, count(*) AS c, min(rank) AS f FROM n JOIN vectors o ON o.vec_id = n.other GROUP BY ALL), b AS (SELECT vec_id, arg_min(voted, f - 100 * c) AS predicted FROM v GROUP BY vec_id), r AS (SELECT m.family, m.origin, m.generator AS truth, avg(CAST(predicted = m.generator AS INT)) AS recall, count(*) AS n FROM b JOIN vectors m USING (vec_id) GROUP BY ALL) SELECT family, origin, CAST(sum(n) AS BIGINT) AS n, count(*) AS labels, round(avg(recall), 6) AS accuracy FROM r GROUP BY ALL")
def q_stratified_knn(spark, d):
    v = V.vectors(spark, d)
    near = vectors.neighbours(v, "vec_id", "x", 5, ["family", "origin"])
    p = vectors.votes(near, v, "vec_id", "generator").join(v.select("vec_id", "family", "origin"), "vec_id")
    n = p.groupBy("family", "origin").agg(F.count("*").alias("n"), F.count_distinct("truth").alias("labels"))
    return vectors.balanced_accuracy(p, ["family", "origin"]).join(n, ["family", "origin"]).select("family", "origin", "n", "labels", r6("accuracy").alias("accuracy"))


@query()
def q_knn_null(spark, d):
    """Neighbours once, labels shuffled within families: accuracy, null mean and p."""
    v = V.vectors(spark, d)
    near = vectors.neighbours(v, "vec_id", "x", 5).persist()
    seen = vectors.balanced_accuracy(vectors.votes(near, v, "vec_id", "generator")).first()["accuracy"]
    dealt = vectors.shuffled_labels(v, "vec_id", "generator", 20, ["family"])
    null = vectors.balanced_accuracy(vectors.votes(near, dealt, "vec_id", "generator", ["perm"]), ["perm"])
    return null.agg(F.lit(round(seen, 6)).alias("accuracy"), r6(F.avg("accuracy")).alias("null_mean"), r6((1 + F.count_if(F.col("accuracy") >= seen)) / (1.0 + F.count("*"))).alias("p"))


@query(f"""WITH {VV}, t AS (SELECT generator AS a, origin AS b, count(*) AS n FROM vectors GROUP BY ALL), x AS (SELECT sum(n) AS m FROM t GROUP BY a), y AS (SELECT sum(n) AS m FROM t GROUP BY b),
s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS n, sum(n * ln(n)) AS h FROM t), xa AS (SELECT sum(m * (m - 1) / 2.0) AS s, sum(m * ln(m)) AS h FROM x), ya AS (SELECT sum(m * (m - 1) / 2.0) AS s, sum(m * ln(m)) AS h FROM y)
SELECT round((s.s - xa.s * ya.s / (n * (n - 1) / 2.0)) / ((xa.s + ya.s) / 2 - xa.s * ya.s / (n * (n - 1) / 2.0)), 6) AS ari, round(2 * (ln(n) + (s.h - xa.h - ya.h) / n) / (2 * ln(n) - (xa.h + ya.h) / n), 6) AS nmi FROM s, xa, ya""")
def q_ari_nmi(spark, d):
    return vectors.agreement(V.vectors(spark, d), "generator", "origin").select(r6("ari").alias("ari"), r6("nmi").alias("nmi"))


@query(f"WITH {VV}, {LONG}, g AS (SELECT i, generator, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY ALL), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * s) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM g GROUP BY i) SELECT round(sum(b) / (max(k) - 1) / (sum(w) / (max(n) - max(k))), 4) AS ch FROM t")
def q_calinski(spark, d):
    return vectors.calinski_harabasz(V.vectors(spark, d), "generator").select(F.round("ch", 4).alias("ch"))


@query(f"""WITH {V.GENERATORS}, g AS (SELECT *, CASE WHEN date_diff('day', lag(release_date) OVER (PARTITION BY family ORDER BY release_date, generator), release_date) > 7 THEN 1 ELSE 0 END AS new FROM generators),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY family ORDER BY release_date, generator) AS INT) AS grp FROM g) SELECT family, generator, release_date, grp, min(release_date) OVER (PARTITION BY family, grp) AS group_date FROM r""")
def q_release_groups(spark, d):
    return temporal.release_groups(V.generators(spark, d), ["family"]).select("family", "generator", "release_date", "grp", "group_date")


@query(f"""WITH {V.GENERATORS}, g AS (SELECT *, CASE WHEN date_diff('day', lag(release_date) OVER (ORDER BY release_date, generator), release_date) > 7 THEN 1 ELSE 0 END AS new FROM generators),
r AS (SELECT *, CAST(sum(new) OVER (ORDER BY release_date, generator) AS INT) AS grp FROM g), z AS (SELECT grp, min(release_date) AS group_date FROM r GROUP BY grp)
SELECT grp, group_date, CAST(least(2, floor((row_number() OVER (ORDER BY group_date, grp) - 1) * 3 / count(*) OVER ())) AS INT) AS bin FROM z""")
def q_time_bins(spark, d):
    g = temporal.release_groups(V.generators(spark, d).withColumn("all", F.lit(1)), ["all"])
    return temporal.time_bins(g.groupBy("all", "grp").agg(F.min("group_date").alias("group_date")), ["all"], 3).select("grp", "group_date", "bin")


def cells(spark, d):
    v = V.vectors(spark, d)
    g = temporal.release_groups(v.select("family", "generator", "release_date").distinct(), ["family"])
    m = vectors.group_means(v, ["family", "generator", "origin"])
    return m.join(F.broadcast(g), ["family", "generator"]).withColumn("cell", F.col("generator") * 10 + F.col("origin"))


PAIRS = f"""{VV}, {LONG}, m AS (SELECT family, generator, origin, release_date, i, avg(v) AS v FROM l GROUP BY ALL),
pairs AS (SELECT a.family, a.generator * 10 + a.origin AS cell_a, b.generator * 10 + b.origin AS cell_b, any_value(a.generator) AS ga, any_value(b.generator) AS gb, abs(any_value(date_diff('day', a.release_date, b.release_date))) AS gap_days, any_value(a.origin = b.origin) AS same_origin, sum((a.v - b.v) ** 2) AS divergence
 FROM m a JOIN m b ON a.family = b.family AND a.i = b.i AND a.generator * 10 + a.origin < b.generator * 10 + b.origin AND a.generator <> b.generator GROUP BY 1, 2, 3)"""


@query(f"WITH {PAIRS} SELECT family, cell_a, cell_b, CAST(gap_days AS INT) AS gap_days, same_origin, round(divergence, 6) AS divergence FROM pairs")
def q_pairs_gap(spark, d):
    return temporal.pair_gaps(cells(spark, d)).withColumn("divergence", r6("divergence"))


@query(f"""WITH {PAIRS}, k AS (SELECT family, rank() OVER (PARTITION BY family ORDER BY round(divergence, 9)) + (count(*) OVER (PARTITION BY family, round(divergence, 9)) - 1) / 2.0 AS y, rank() OVER (PARTITION BY family ORDER BY gap_days) + (count(*) OVER (PARTITION BY family, gap_days) - 1) / 2.0 AS b,
 CAST((cell_a // 10) % 4 <> (cell_b // 10) % 4 AS DOUBLE) AS a FROM pairs WHERE (cell_a // 10) % 4 <> 3 AND (cell_b // 10) % 4 <> 3)
SELECT family, count(*) AS n, round((covar_pop(y, a) * var_pop(b) - covar_pop(y, b) * covar_pop(a, b)) / CASE WHEN abs(var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2) > 1e-12 THEN (var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2) END, 5) AS b_lineage, round((covar_pop(y, b) * var_pop(a) - covar_pop(y, a) * covar_pop(a, b)) / CASE WHEN abs(var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2) > 1e-12 THEN (var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2) END, 5) AS b_gap FROM k GROUP BY family""")
def q_lineage_regression(spark, d):
    lineage = lambda c: F.floor(F.col(c) / 10) % 4
    p = temporal.pair_gaps(cells(spark, d)).where((lineage("cell_a") != 3) & (lineage("cell_b") != 3)).withColumn("divergence", F.round("divergence", 9))
    k = ranks.with_ranks(p, ["divergence", "gap_days"], ["family"]).withColumn("a", (lineage("cell_a") != lineage("cell_b")).cast("double"))
    b = temporal.two_regressors("rank_divergence", "a", "rank_gap_days")
    return k.groupBy("family").agg(F.count("*").alias("n"), *b).select("family", "n", F.round("b_a", 5).alias("b_lineage"), F.round("b_b", 5).alias("b_gap"))


@query(f"WITH {VV}, g AS (SELECT DISTINCT family, generator, generator % 4 AS lineage FROM vectors WHERE generator % 4 <> 3) SELECT family, lineage, count(DISTINCT generator) AS n_groups FROM g GROUP BY ALL HAVING count(DISTINCT generator) >= 2")
def q_lineage_classes(spark, d):
    v = V.vectors(spark, d)
    g = temporal.release_groups(v.select("family", "generator", "release_date").distinct(), ["family"]).withColumn("lineage", F.col("generator") % 4).where("lineage <> 3")
    return g.groupBy("family", "lineage").agg(F.count_distinct("grp").alias("n_groups")).where("n_groups >= 2")


def stats_of(spark, d):
    return temporal.moments(V.vectors(spark, d), ["generator"]).persist()


@query(f"""WITH {VV}, {LONG}, s AS (SELECT generator, i, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM l GROUP BY ALL), c AS (SELECT generator, generator % 2 AS class FROM s GROUP BY generator),
m AS (SELECT h.generator AS held, c.class AS model, s.i, sum(s.n) AS m, sum(s.s) / sum(s.n) AS mu, greatest(0, sum(s.q) / sum(s.n) - (sum(s.s) / sum(s.n)) ** 2) + 0.001 AS var FROM c h, s JOIN c USING (generator) WHERE s.generator <> h.generator GROUP BY ALL),
ll AS (SELECT s.generator, m.model, sum(-0.5 * (ln(2 * pi() * var) + (s.q - 2 * mu * s.s + s.n * mu * mu) / s.n / var)) AS ll FROM s JOIN m ON m.held = s.generator AND m.i = s.i GROUP BY ALL)
SELECT generator, CAST(any_value(c.class) AS INT) AS truth, CAST(arg_max(model, ll) AS INT) AS predicted, round(max(ll) FILTER (WHERE model = c.class) - avg(ll) FILTER (WHERE model <> c.class), 5) AS llr FROM ll JOIN c USING (generator) GROUP BY generator""")
def q_logo_attribution(spark, d):
    g = V.vectors(spark, d).select("generator").distinct().select("generator", F.col("generator").alias("grp"), (F.col("generator") % 2).alias("class"), F.lit(1).alias("all"))
    return temporal.attribution(stats_of(spark, d), g, ["all"]).select("generator", "truth", "predicted", F.round("llr", 5).alias("llr"))


def dated(v):
    """{family: [(generator, date)]} of vectors, a registry."""
    out = {}
    for r in v.select("family", "generator", "release_date").distinct().orderBy("family", "generator").collect():
        out.setdefault(r.family, []).append((r.generator, r.release_date))
    return out


TESTED = "family long, n_groups int, n_generators int, perms int, " + ", ".join(f"{c} double" for c in ("acc", "mae", "llr", "null_acc", "null_llr", "null_mae", "p_acc", "p_llr", "p_mae")) + ", not_testable string"


def tested(spark, rows, first: str = ""):
    """Results of tests as rows, statistics to six decimals."""
    names = [c.strip().split(" ")[0] for c in (first + TESTED).split(",")]
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return spark.createDataFrame([tuple(value(r.get(c)) for c in names) for r in rows], first + TESTED)


@query()
def q_t1(spark, d):
    """Generators dated by mixtures of those of other release groups, against 1,000 orders of the groups."""
    v = reduced(spark, d)
    return tested(spark, attribution.time_test(v, dated(v), n_bins=2))


@query()
def q_planted_power(spark, d):
    """The same test on vectors moved in step with release time by four strengths, in five directions, 99 orders each: p, and the share found."""
    v = reduced(spark, d)
    registry = dated(v)
    shifts, variants = attribution.planted_shifts(v, registry, [0.5, 1.0, 2.0, 4.0], 5)
    rows = attribution.time_test(v, registry, n_bins=2, perms=99, shifts=shifts)
    rows = [r | {"delta": variants[r["variant"]][0], "rep": variants[r["variant"]][1]} for r in rows if "acc" in r]
    out = tested(spark, rows, "delta double, rep int, ").drop("not_testable")
    return out.withColumn("power", r6(F.avg((F.col("p_llr") <= 0.05).cast("int")).over(Window.partitionBy("family", "delta"))))  # a row for each variant


@query(f"""WITH {VV} SELECT generator, count(*) AS n, {', '.join(f"round(sum(CAST(x[{i + 1}] AS DOUBLE) * CAST(x[{j + 1}] AS DOUBLE)), 5) AS x{i}x{j}" for i in range(1, 8) for j in range(i, 8))},
{', '.join(f"round(sum(CAST(x[1] AS DOUBLE) * CAST(x[{i + 1}] AS DOUBLE)), 5) AS yx{i}" for i in range(1, 8))} FROM vectors GROUP BY generator""")
def q_normal_equations(spark, d):
    """Sums of products of seven elements with one another and with the first, for each generator."""
    v, names = V.vectors(spark, d), [f"e{i}" for i in range(8)]
    sums = regress.normal_equations(v.select("generator", *[F.col("x")[i].cast("double").alias(c) for i, c in enumerate(names)]), ["generator"], ["e0"], names[1:])
    at = {ij: k for k, ij in enumerate((i, j) for i in range(8) for j in range(i, 8))}
    return sums.select("generator", "n", *[F.round(F.col("xx")[at[i, j]], 5).alias(f"x{i}x{j}") for i in range(1, 8) for j in range(i, 8)], *[F.round(F.col("xy")[i], 5).alias(f"yx{i}") for i in range(1, 8)])


@query(f"""WITH {VV}, {LONG}, g AS (SELECT generator, i, CAST(vec_id % 100 AS DOUBLE) AS z, v FROM l) SELECT generator, CAST(i AS INT) AS i, count(*) AS n, round(regr_slope(v, z), 7) AS slope, round(regr_intercept(v, z), 6) AS intercept, round(regr_r2(v, z), 6) AS r2 FROM g GROUP BY generator, i""")
def q_regressions(spark, d):
    """A line for each generator and element, all solved in the tasks."""
    rows = vectors.long(V.vectors(spark, d), ["vec_id", "generator"]).withColumn("z", (F.col("vec_id") % 100).cast("double"))
    f = regress.fit(rows, ["generator", "i"], ["v"], ["z"])
    return f.select("generator", "i", "n", F.round("b_z", 7).alias("slope"), r6("intercept").alias("intercept"), r6("r2").alias("r2"))


@query()
def q_size_tests(spark, d):
    """Is the dating only size? The test on log size alone, on the reduced vectors, and on what log size and its square leave of them in each family."""
    v = reduced(spark, d).withColumn("z", F.log(F.lit(20.0) + F.col("vec_id") % 100 + F.datediff("release_date", F.lit("2017-01-01")) / 50)).withColumn("w", F.col("z") * F.col("z"))
    names = [f"e{i}" for i in range(4)]
    wide = written(v.select("vec_id", "family", "generator", "release_date", "z", "w", *[F.col("x")[i].alias(c) for i, c in enumerate(names)]), "sizes")
    f = regress.fit(wide, ["family"], names, ["z", "w"])
    models = f.groupBy("family").pivot("target", names).agg(F.first(F.struct("intercept", "b_z", "b_w")))  # a row for each family
    rest = wide.join(F.broadcast(models.select(F.col("family"), *[F.col(c).alias(f"m_{c}") for c in names])), "family")
    rest = rest.select("family", "generator", "release_date", F.array(*[F.col(c) - regress.fitted(f"m_{c}", ["z", "w"]) for c in names]).alias("x"))
    share = {r.family: r.r2 for r in f.groupBy("family").agg((1 - F.sum("rss") / F.sum(F.when(F.col("r2") < 1, F.col("rss") / (1 - F.col("r2"))))).alias("r2")).collect()}
    jitter = wide.select("family", "generator", "release_date", F.array(F.col("z") + 0.02 * X.probit(X.clip(X.md5_uniform(F.lit(11), F.col("vec_id")), 1e-9, 1 - 1e-9))).alias("x"))
    arms = {"size": jitter, "vectors": v, "residuals": rest}
    rows = [r | {"arm": arm, "size_r2": share.get(r["family"]) if arm == "residuals" else None} for arm, df in arms.items() for r in attribution.time_test(df, dated(v), n_bins=2)]
    return tested(spark, rows, "arm string, size_r2 double, ")


@query(f"""WITH {VV}, {LONG}, s AS (SELECT vec_id, i, v, CAST(vec_id % 100 AS DOUBLE) AS z FROM l), b AS (SELECT i, covar_pop(v, z) AS cyz, covar_pop(v, z * z) AS cyw, var_pop(z) AS zz, var_pop(z * z) AS ww, covar_pop(z, z * z) AS zw, avg(v) AS mv, avg(z) AS mz, avg(z * z) AS mw FROM s GROUP BY i)
SELECT vec_id, CAST(i AS INT) AS i, round(v - mv - (cyz * ww - cyw * zw) / (zz * ww - zw * zw) * (z - mz) - (cyw * zz - cyz * zw) / (zz * ww - zw * zw) * (z * z - mw), 5) AS residual FROM s JOIN b USING (i)""")
def q_size_check(spark, d):
    """Vectors with size and its square regressed out, element by element."""
    rows = vectors.long(V.vectors(spark, d), ["vec_id"]).withColumn("z", (F.col("vec_id") % 100).cast("double")).withColumn("w", F.col("z") * F.col("z"))
    b = rows.groupBy("i").agg(*temporal.two_regressors("v", "z", "w"), F.avg("v").alias("mv"), F.avg("z").alias("mz"), F.avg("w").alias("mw"))
    residual = F.col("v") - F.col("mv") - F.col("b_a") * (F.col("z") - F.col("mz")) - F.col("b_b") * (F.col("w") - F.col("mw"))
    return rows.join(F.broadcast(b), "i").select("vec_id", "i", F.round(residual, 5).alias("residual"))


DRIFT = f"""{VV}, {LONG}, g AS (SELECT family, generator, i, any_value(release_date) AS dt, avg(v) AS v FROM l GROUP BY ALL), r AS (SELECT family, min(dt) AS a, max(dt) AS b FROM g GROUP BY family),
t AS (SELECT g.family, generator, i, v, date_diff('day', a, dt) / CAST(date_diff('day', a, b) AS DOUBLE) AS t FROM g JOIN r USING (family))"""


def group_times(spark, d):
    v = V.vectors(spark, d)
    m = vectors.long(v, ["family", "generator"]).groupBy("family", "generator", "i").agg(F.avg("v").alias("v"))
    g = temporal.release_groups(v.select("family", "generator", "release_date").distinct(), ["family"])
    w = Window.partitionBy("family")
    g = g.withColumn("t", F.datediff("group_date", F.min("group_date").over(w)) / F.datediff(F.max("group_date").over(w), F.min("group_date").over(w)))
    return m.join(F.broadcast(g.select("family", "generator", "grp", "t")), ["family", "generator"])


@query(f"WITH {DRIFT} SELECT family, round(sqrt(sum(b * b)), 6) AS delta FROM (SELECT family, i, regr_slope(v, t) AS b FROM t GROUP BY ALL) GROUP BY family")
def q_drift(spark, d):
    return temporal.drift(group_times(spark, d), ["family"]).select("family", r6("delta").alias("delta"))


@query(f"""WITH {DRIFT}, u AS (SELECT DISTINCT family, generator, t FROM t), s AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY generator) AS slot FROM u),
p AS (SELECT family, perm, generator, row_number() OVER (PARTITION BY family, perm ORDER BY md5('0:' || perm || ':' || generator), generator) AS slot FROM s, range(1, 101) q(perm)),
n AS (SELECT family, perm, sqrt(sum(b * b)) AS delta FROM (SELECT t.family, p.perm, t.i, regr_slope(t.v, s.t) AS b FROM t JOIN p ON p.family = t.family AND p.generator = t.generator JOIN s ON s.family = p.family AND s.slot = p.slot GROUP BY ALL) GROUP BY ALL),
o AS (SELECT family, sqrt(sum(b * b)) AS delta FROM (SELECT family, i, regr_slope(v, t) AS b FROM t GROUP BY ALL) GROUP BY family)
SELECT family, round(any_value(o.delta), 6) AS delta, round(avg(n.delta), 6) AS null_mean, round((1 + count(*) FILTER (WHERE n.delta >= o.delta - 1e-9)) / (1.0 + count(*)), 6) AS p FROM n JOIN o USING (family) GROUP BY family""")
def q_drift_null(spark, d):
    m = group_times(spark, d).persist()
    dealt = ranks.permuted(m.select("family", "generator", "t").distinct(), "generator", "t", ["family"], 100)
    null = temporal.drift(m.drop("t").join(dealt.withColumnRenamed("shuffled", "t"), ["family", "generator"]), ["family", "perm"])
    seen = temporal.drift(m, ["family"]).select("family", F.col("delta").alias("seen"))
    return null.join(F.broadcast(seen), "family").groupBy("family").agg(r6(F.first("seen")).alias("delta"), r6(F.avg("delta")).alias("null_mean"), r6((1 + F.count_if(F.col("delta") >= F.col("seen") - 1e-9)) / (1.0 + F.count("*"))).alias("p"))


@query()
def q_drift_power(spark, d):
    """How many release groups a drift needs: residuals about each family's line, resampled to N groups with a planted slope."""
    m = group_times(spark, d)
    line = m.groupBy("family", "i").agg(F.regr_slope("v", "t").alias("b"), F.regr_intercept("v", "t").alias("a"))
    resid = m.join(F.broadcast(line), ["family", "i"]).select("family", "i", F.row_number().over(Window.partitionBy("family", "i").orderBy("generator")).alias("slot"), (F.col("v") - F.col("a") - F.col("b") * F.col("t")).alias("e"))
    n = resid.groupBy("family").agg(F.max("slot").alias("n"))
    grid = spark.createDataFrame([(g, s) for g in (8, 16) for s in (0.0, 0.5)], "groups int, planted double")
    sim = n.join(F.broadcast(grid)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("groups"))))
    sim = sim.withColumn("slot", (F.floor(X.md5_uniform(F.lit(3), F.col("family"), F.col("groups"), F.col("rep"), F.col("k")) * F.col("n")) + 1).cast("int")).withColumn("t", (F.col("k") - 1) / (F.col("groups") - 1))
    rows = sim.join(resid, ["family", "slot"]).withColumn("v", F.col("e") + F.when(F.col("i") == 0, F.col("planted") * F.col("t")).otherwise(0.0))
    return temporal.drift(rows, ["family", "groups", "planted", "rep"]).groupBy("family", "groups", "planted").agg(r6(F.avg("delta")).alias("mean_delta"), r6(F.percentile("delta", 0.95)).alias("q95"))


def reduced(spark, d, k=4):
    """Vectors centred on family and origin, on their first components."""
    scored, _ = vectors.pca(vectors.centre(V.vectors(spark, d), ["family", "origin"]), k)
    return scored.drop("x").withColumnRenamed("scores", "x").persist()


@query()
def q_generator_components(spark, d):
    """How many diagonal components each generator's vectors ask for, and how many of them have members."""
    v = reduced(spark, d)
    models = mixture.fit(v.select(F.col("generator").alias("model"), "x"))
    member = mixture.score(v.select(F.col("generator").alias("model"), "origin", "x"), models.select("model", "components"), ["model"])
    shares = member.groupBy("model").agg(F.count_distinct("component").alias("used"))
    return models.join(shares, "model").select(F.col("model").alias("generator"), "k", "n", "used", r6("bic").alias("bic"))


@query()
def q_bin_components(spark, d):
    """Shares of a family's mixture components in each time bin."""
    v = reduced(spark, d)
    g = temporal.release_groups(v.select("family", "generator", "release_date").distinct(), ["family"])
    bins = temporal.time_bins(g.groupBy("family", "grp").agg(F.min("group_date").alias("group_date")), ["family"], 2)
    of = g.join(bins.select("family", "grp", "bin"), ["family", "grp"]).select("family", "generator", "bin")
    models = mixture.fit(v.select(F.col("family").alias("model"), "x"), most=8)
    member = mixture.score(v.select(F.col("family").alias("model"), "generator", "x"), models.select("model", "components"), ["model"]).join(F.broadcast(of), "generator")
    return member.groupBy("family", "bin", "component").agg(F.count("*").alias("n")).withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("family", "bin"))))


@query()
def q_cell_divergence(spark, d):
    """Held-out divergence of (generator, origin) cells against their gap in release date, over all pairs and over those that share an
    origin, which origin can't explain: rank correlation, and p by the same permuted dates for both."""
    v = reduced(spark, d).withColumn("cell", F.col("generator") * 10 + F.col("origin"))
    pairs = mixture.divergence(v, "vec_id", "cell", ["family"]).withColumn("a", F.floor(F.col("cell_a") / 10).cast("int")).withColumn("b", F.floor(F.col("cell_b") / 10).cast("int")).where("a <> b").persist()
    days = v.select("family", "generator", "release_date").distinct().withColumn("day", F.unix_date("release_date"))
    dealt = days.withColumn("perm", F.lit(0)).select("perm", "family", "generator", F.col("day").alias("shuffled")).unionByName(ranks.permuted(days, "generator", "day", ["family"], 1000))
    a, b = (dealt.select("perm", "family", F.col("generator").alias(s), F.col("shuffled").alias(f"day_{s}")) for s in "ab")
    gaps = pairs.join(F.broadcast(a), ["family", "a"]).join(F.broadcast(b), ["perm", "family", "b"]).withColumn("gap", F.abs(F.col("day_a") - F.col("day_b")))
    arms = F.filter(F.array(F.lit("all"), F.when(F.col("cell_a") % 10 == F.col("cell_b") % 10, "same origin")), lambda x: x.isNotNull())
    by = ["perm", "family", "pairs"]
    rho = ranks.with_ranks(gaps.withColumn("pairs", F.explode(arms)), ["divergence", "gap"], by).groupBy(*by).agg(X.corr("rank_divergence", "rank_gap").alias("rho"), F.count("*").alias("n_pairs"))
    rho = rho.withColumn("rho", F.when((F.col("n_pairs") >= 4) & ~F.isnan("rho"), F.col("rho")))  # pairs of cells, a row for each pair and order
    seen = rho.where("perm = 0").select("family", "pairs", "n_pairs", F.col("rho").alias("spearman"))
    null = rho.where("perm > 0").select("family", "pairs", "rho").join(F.broadcast(seen), ["family", "pairs"]).groupBy("family", "pairs")
    p = F.when(F.first("spearman").isNotNull(), (1 + F.count_if(F.col("rho") >= F.col("spearman") - 1e-12)) / (1.0 + F.count("*")))
    return null.agg(F.first("n_pairs").alias("n_pairs"), r6(F.first("spearman")).alias("spearman"), r6(F.avg("rho")).alias("null_mean"), r6(F.percentile("rho", 0.95)).alias("null_q95"), r6(p).alias("p"))


def registry_of(v):
    return v.select("family", "generator", "release_date").distinct()


@query()
def q_drift_whitened(spark, d):
    """The drift of release groups in deviations within a generator: its null, the bootstrap's 95 % point, and the scatter about the line."""
    v = V.vectors(spark, d)
    t = temporal.drift_test(written(temporal.whitened_group_means(v, registry_of(v), ["family"]), "means"), ["family"])
    return t.select("family", "n_groups", *[r6(c).alias(c) for c in ("delta", "null_mean", "null_q95", "p", "boot_q95", "tau")], "not_testable")


@query()
def q_lineage_test(spark, d):
    """Held-out release groups attributed to lineage classes by mixtures, against 200 valid orders of the lineages."""
    v = reduced(spark, d)
    members = sorted((g, day) for of in dated(v).values() for g, day in of)
    rows = attribution.lineage_test(v, {0: [(g, day, g % 2 if g % 3 != 2 else None) for g, day in members]})
    return tested(spark, rows, "n_classes int, chance double, ").drop("n_groups", "mae", "null_mae", "p_mae", "family")


@query()
def q_lineage_null(spark, d):
    """Does divergence follow lineage or date, each net of the other? Slopes of ranks, with lineages dealt anew among generators for the one
    and dates among generators for the other."""
    p = written(temporal.pair_gaps(cells(spark, d)).withColumn("divergence", F.round("divergence", 9)).select("family", *[F.floor(F.col(f"cell_{s}") / 10).cast("int").alias(s) for s in "ab"], "divergence"), "pairs")
    g = registry_of(V.vectors(spark, d)).select("family", "generator", (F.col("generator") % 4).alias("lineage"), F.unix_date("release_date").alias("day")).where("lineage <> 3")
    seen = g.withColumn("perm", F.lit(0)).withColumn("kind", F.lit("seen"))
    columns = ["kind", "perm", "family", "generator", "lineage", "day"]
    dealt = seen.select(*columns)
    for kind, c, other in (("lineage", "lineage", "day"), ("date", "day", "lineage")):
        dealt = dealt.unionByName(ranks.permuted(g, "generator", c, ["family"], 200).join(g.select("family", "generator", other), ["family", "generator"]).withColumn("kind", F.lit(kind)).withColumnRenamed("shuffled", c).select(*columns))
    a, b = (dealt.select("kind", "perm", "family", F.col("generator").alias(s), F.col("lineage").alias(f"lineage_{s}"), F.col("day").alias(f"day_{s}")) for s in "ab")
    rows = p.join(F.broadcast(a), ["family", "a"]).join(F.broadcast(b), ["kind", "perm", "family", "b"])
    rows = rows.select("kind", "perm", "family", "divergence", (F.col("lineage_a") != F.col("lineage_b")).cast("double").alias("apart"), F.abs(F.col("day_a") - F.col("day_b")).alias("gap"))
    k = ranks.with_ranks(rows, ["divergence", "gap"], ["kind", "perm", "family"])  # pairs of cells, a row for each pair and order
    slopes = k.groupBy("kind", "perm", "family").agg(F.count("*").alias("n"), *temporal.two_regressors("rank_divergence", "apart", "rank_gap"))
    scaled = slopes.select("kind", "perm", "family", "n", (F.col("b_a") / F.col("n")).alias("b_lineage"), F.col("b_b").alias("b_date"))
    own = scaled.where("kind = 'seen'").select("family", "n", F.col("b_lineage").alias("seen_lineage"), F.col("b_date").alias("seen_date"))
    null = scaled.where("kind <> 'seen'").drop("n").join(F.broadcast(own), "family")
    p_of = lambda kind: F.when(F.first(f"seen_{kind}").isNotNull(), (1 + F.count_if((F.col("kind") == kind) & (F.col(f"b_{kind}") >= F.col(f"seen_{kind}") - 1e-12))) / (1.0 + F.count_if(F.col("kind") == kind))).alias(f"p_{kind}")
    out = null.groupBy("family").agg(F.first("n").alias("n"), F.first("seen_lineage").alias("b_lineage"), F.first("seen_date").alias("b_date"), p_of("lineage"), p_of("date"))
    return out.select("family", "n", *[r6(c).alias(c) for c in ("b_lineage", "p_lineage", "b_date", "p_date")])


@query()
def q_stratified_null(spark, d):
    """Generators told apart by neighbours inside strata of family and origin, against labels dealt anew there."""
    t = vectors.stratified_accuracy(V.vectors(spark, d), "vec_id", "generator", ["family", "origin"])
    return t.select("strata", "n", *[r6(c).alias(c) for c in ("chance", "accuracy", "null_mean", "null_q95", "p")])


@query()
def q_kmeans_agreement(spark, d):
    """How k-means clusters of the reduced vectors agree with the generators, and how far generators lie apart."""
    v = reduced(spark, d)
    k = v.select("generator").distinct().count()
    both = vectors.agreement(vectors.clusters(v, k), "generator", "cluster")
    return both.join(vectors.calinski_harabasz(v, "generator")).select(F.lit(k).alias("k"), r6("ari").alias("ari"), r6("nmi").alias("nmi"), F.round("ch", 4).alias("ch"))


@query()
def q_component_origin(spark, d):
    """How the mixture components of each generator's vectors agree with the origin."""
    v = reduced(spark, d)
    models = mixture.fit(v.select(F.col("generator").alias("model"), "x"))
    member = mixture.score(v.select(F.col("generator").alias("model"), "origin", "x"), models.select("model", "components"), ["model"]).select("model", "origin", "component")
    t = vectors.agreements(written(member, "members"), "model", "origin", "component")
    return t.select(F.col("model").alias("generator"), r6("ari").alias("ari"), r6("nmi").alias("nmi"))


@query()
def q_granularity(spark, d):
    """How well neighbours tell generators apart on 1, 2, 4 and 8 components of centred and of raw vectors, and on all elements, in each family."""
    v, parts = V.vectors(spark, d), []
    for arm, base in (("centred", vectors.centre(v, ["family", "origin"])), ("raw", v)):
        scored = written(vectors.pca(base, 8)[0].select("vec_id", "family", "generator", F.col("scores").alias("x")), arm)
        near = vectors.neighbours(scored, "vec_id", "x", 5, ["family"], prefixes=[1, 2, 4, 8])
        parts.append(vectors.balanced_accuracy(vectors.votes(near, scored, "vec_id", "generator", ["family"], ["g"]), ["family", "g"]).withColumn("arm", F.lit(arm)))
    full = vectors.votes(vectors.neighbours(v, "vec_id", "x", 5, ["family"]), v, "vec_id", "generator", ["family"])
    parts.append(vectors.balanced_accuracy(full, ["family"]).select("family", F.lit(64).alias("g"), "accuracy", F.lit("full").alias("arm")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("arm", "family", "g", r6("accuracy").alias("accuracy"))


@query()
def q_pseudo_replication(spark, d):
    """The trend of each score with release date over generators and over items, each with a permutation null of its own grain: the second
    counts items as independent and shows how far that overstates."""
    m = written(V.scored(spark, d).where("label = 1").select("generator", F.unix_date("release_date").alias("day"), *V.SCORES), "items")
    out = []
    for c in V.SCORES:
        g = m.groupBy("generator", "day").agg(F.median(c).alias("m"))
        parts = [ranks.row_grain_null(g, "day", "m", 1000), ranks.row_grain_null(m, "day", c, 1000)]
        p = [(1 + int((np.abs(null) >= abs(rho) - 1e-12).sum())) / (1 + len(null)) if rho == rho else rho for rho, null in parts]
        out.append((c, *[round(rho, 6) for rho, _ in parts], *[round(x, 6) for x in p], *[round(float(np.quantile(np.abs(null), 0.95)), 6) for _, null in parts]))
    return spark.createDataFrame(out, "detector string, rho_generators double, rho_items double, p_generators double, p_items double, critical_generators double, critical_items double")


def grid():
    """Specifications about a primary one: other bins, components, centrings, scalings, blocks and single origins."""
    base = {"block": (0, 64), "centring": ("family", "origin")}
    out = [specs.Spec("primary", **base)]
    out += [specs.Spec(f"components {g}", **base, g=g) for g in (1, 2, 8)]
    out += [specs.Spec(f"scaling {s}", **base, scaling=s) for s in ("standard", "none")]
    out += [specs.Spec(f"centring {n}", (0, 64), centring=c) for n, c in (("family", ("family",)), ("none", ()))]
    out += [specs.Spec(f"block {a}", (a, a + 16), centring=base["centring"]) for a in (0, 16, 32, 48)]
    out += [specs.Spec(f"origin {o}", (0, 64), centring=("family",), rows=f"origin = {o}") for o in range(4)]
    return out


@query()
def q_spec_grid(spark, d):
    """Every specification's dating test in each family, 200 orders each, one job for all: the log likelihood ratio, its excess over the
    null, and p."""
    v = V.vectors(spark, d)
    rows = specs.time_tests(v, dated(v), grid())
    return tested(spark, [r | {"excess": r["llr"] - r["null_llr"] if "llr" in r else None} for r in rows], "spec string, excess double, ")


@query()
def q_share_found(spark, d):
    """The share of specifications of each kind that find the dates, by family, and their mean excess over the null."""
    g = q_spec_grid(spark, d).where("spec <> 'primary' AND p_llr IS NOT NULL AND NOT isnan(p_llr)")
    return g.groupBy(F.split_part("spec", F.lit(" "), F.lit(1)).alias("kind"), "family").agg(F.count("*").alias("tests"), r6(F.avg((F.col("p_llr") <= 0.05).cast("int"))).alias("found"), r6(F.avg("excess")).alias("excess"))


@query()
def q_spec_patterns(spark, d):
    """The rank correlation of each specification's excess over families and statistics with that of the primary one."""
    g = q_spec_grid(spark, d).select("spec", F.inline(F.array(*[F.struct(F.concat_ws("|", "family", F.lit(s)).alias("cell"), (F.col(s) - F.col(f"null_{s}")).alias("v")) for s in ("acc", "llr", "mae")]))).where("v IS NOT NULL AND NOT isnan(v)")
    both = written(g, "excess")
    pairs = both.join(both.where("spec = 'primary'").select("cell", F.col("v").alias("primary")), "cell")  # a row a specification and cell
    k = ranks.with_ranks(pairs, ["v", "primary"], ["spec"])
    return k.groupBy("spec").agg(F.count("*").alias("cells"), r6(X.corr("rank_v", "rank_primary")).alias("rho"))
