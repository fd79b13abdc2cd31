"""Queries of calibration, bounds and evidence over time, with their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregate, blocks, bounds, calibrate, panel, ranks, sampling
from ..operators.lineage import written
from ..sources import views as V
from .registry import query
from .tables import r6

THETAS = [1.0, 2.0, 10.0]
C = V.CURVES
#: For the event curves: odd items are of class 1; an item's own family is the (item % 5)-th by name.
TRUTH = "f AS (SELECT DISTINCT family, date FROM curves), k AS (SELECT family, date, row_number() OVER (ORDER BY family) - 1 AS k FROM f), truth AS (SELECT DISTINCT c.item, c.item % 2 AS y, k.family AS own, k.date AS true_date FROM curves c JOIN k ON c.item % 5 = k.k)"
AGG = f"""{C}, {TRUTH}, a AS (SELECT t.date AS T, f.family FROM f t JOIN f ON f.date <= t.date), n AS (SELECT T, count(*) AS n_out FROM a GROUP BY T),
agg AS (SELECT item, c.T, n_out, max(lr) AS max, max(lr) / (SELECT count(*) FROM f) AS max_over_all, max(lr) / n_out AS max_over_out, sum(lr) / n_out AS mixture FROM (SELECT * FROM curves JOIN a USING (family)) c JOIN n ON n.T = c.T GROUP BY item, c.T, n_out)"""


def truth(spark, d):
    names = sorted(V.CURVE_DATES)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("item") % 5 + 1).cast("int"))
    items = V.curves(spark, d).select("item").distinct()
    return items.select("item", (F.col("item") % 2).alias("y"), pick(names).alias("own"), pick([V.CURVE_DATES[n] for n in names]).cast("date").alias("true_date"))


def agg(spark, d):
    c = V.curves(spark, d)
    families = c.select("family", "date").distinct()
    return aggregate.aggregators(c, families, families.select(F.col("date").alias("T")))


@query(f"WITH {AGG} SELECT item, T, n_out, round(max, 6) AS max, round(max_over_all, 6) AS max_over_all, round(max_over_out, 6) AS max_over_out, round(mixture, 6) AS mixture FROM agg")
def q_aggregators(spark, d):
    return agg(spark, d).select("item", "T", "n_out", *[r6(c).alias(c) for c in ("max", "max_over_all", "max_over_out", "mixture")])


@query(f"WITH {AGG} SELECT name, count(*) FILTER (WHERE step < -1e-12) AS violations, count(step) AS steps FROM (SELECT name, v - lag(v) OVER (PARTITION BY name, item ORDER BY T) AS step FROM (UNPIVOT (SELECT item, T, max, max_over_out FROM agg) ON max, max_over_out INTO NAME name VALUE v)) GROUP BY name")
def q_monotone(spark, d):
    a = agg(spark, d)
    parts = [aggregate.monotone_violations(a, c).withColumn("name", F.lit(c)) for c in ("max", "max_over_out")]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {AGG}, t AS (SELECT item, theta, min(T) FILTER (WHERE max >= theta) AS tstar FROM agg, (VALUES (1.0), (2.0), (10.0)) v(theta) GROUP BY ALL),
j AS (SELECT CAST(theta AS DOUBLE) AS theta, y, tstar, CASE WHEN y = 1 THEN date_diff('day', true_date, tstar) END AS err FROM t JOIN truth USING (item))
SELECT theta, round(avg(CAST(tstar IS NOT NULL AS INT)) FILTER (WHERE y = 1), 6) AS cross_fake, round(avg(CAST(tstar IS NOT NULL AS INT)) FILTER (WHERE y = 0), 6) AS cross_authentic,
 median(date_diff('day', DATE '1970-01-01', tstar)) FILTER (WHERE y = 1) AS median_day, median(err) AS median_error, round(avg(CAST(err < 0 AS INT)), 6) AS share_early, round(median(abs(err)) / 365.25, 6) AS median_years FROM j GROUP BY theta""")
def q_tstar(spark, d):
    t = aggregate.tstar_table(aggregate.crossing(agg(spark, d), "max", THETAS), truth(spark, d))
    return t.select("theta", r6("cross_fake").alias("cross_fake"), r6("cross_authentic").alias("cross_authentic"), "median_day", "median_error", r6("share_early").alias("share_early"), r6("median_years").alias("median_years"))


@query(f"WITH {AGG} SELECT item, T, round(max(max_over_out) OVER (PARTITION BY item ORDER BY T ROWS UNBOUNDED PRECEDING), 6) AS running FROM agg")
def q_running_max(spark, d):
    return aggregate.running_max(agg(spark, d), "max_over_out").select("item", "T", r6("running").alias("running"))


@query(f"WITH {AGG} SELECT item, arg_min(max, T) = arg_max(max, T) AS flat, count(DISTINCT round(max, 10)) AS levels FROM agg GROUP BY item")
def q_flat_curves(spark, d):
    return agg(spark, d).groupBy("item").agg((F.min_by("max", "T") == F.max_by("max", "T")).alias("flat"), F.count_distinct(F.round("max", 10)).alias("levels"))


@query(f"""WITH {AGG}, d AS (SELECT a.T, a.max, row_number() OVER (PARTITION BY a.T ORDER BY a.item) - 1 AS slot FROM agg a JOIN truth USING (item) WHERE y = 0),
z AS (SELECT T, count(*) AS n, avg(max) AS mean FROM d GROUP BY T),
p AS (SELECT T, rep, CAST(floor(CAST('0x' || substr(md5('0:' || date_diff('day', DATE '1970-01-01', T) || ':' || rep || ':' || k), 1, 13) AS BIGINT) / 4503599627370496.0 * n) AS INT) AS slot FROM z, range(1, 41) r(rep), range(1, 100000) q(k) WHERE k <= n),
b AS (SELECT T, rep, avg(max) AS b FROM p JOIN d USING (T, slot) GROUP BY ALL)
SELECT T, n, round(mean, 6) AS mean, round(quantile_cont(b, 0.025), 6) AS lo95, round(quantile_cont(b, 0.975), 6) AS hi95 FROM b JOIN z USING (T) GROUP BY ALL""")
def q_multiplicity(spark, d):
    m = aggregate.multiplicity(agg(spark, d), truth(spark, d), 40)
    return m.select("T", "n", *[r6(c).alias(c) for c in ("mean", "lo95", "hi95")])


@query(f"WITH {C}, h AS (SELECT item % 2 AS y, lr FROM curves), g AS (SELECT pow(10.0, (i - 20) / 10.0) AS x FROM range(0, 41) t(i)) SELECT round(x, 9) AS x, y, round(avg(CAST(lr >= x AS INT)), 6) AS share FROM h, g GROUP BY x, y")
def q_tippett(spark, d):
    c = V.curves(spark, d).withColumn("y", F.col("item") % 2)
    return aggregate.tippett(c, "lr", "y", [10.0 ** ((i - 20) / 10.0) for i in range(41)]).select(F.round("x", 9).alias("x"), "y", r6("share").alias("share"))


@query()
def q_det(spark, d):
    """Miss and false alarm rates at each distinct ratio of a family, and their probits."""
    c = ranks.running_counts(V.curves(spark, d).withColumn("y", F.col("item") % 2), "lr", ["family"], {"p": F.sum("y"), "d": F.sum(1 - F.col("y"))})
    n = c.groupBy("family").agg(F.sum("p").alias("n_p"), F.sum("d").alias("n_d"))
    c = c.join(F.broadcast(n), "family").select("family", "lr", (F.col("p_below") / F.col("n_p")).alias("miss"), (1 - F.col("d_below") / F.col("n_d")).alias("alarm"), (0.5 / F.greatest("n_p", "n_d")).alias("e"))
    return c.select("family", r6("lr").alias("lr"), r6("miss").alias("miss"), r6("alarm").alias("alarm"), *[r6(X.probit(X.clip(F.col(x), F.col("e"), 1 - F.col("e")))).alias(f"{x}_probit") for x in ("miss", "alarm")])


@query(f"""WITH {C} SELECT family, count(*) FILTER (WHERE item % 2 = 1) AS n_p, count(DISTINCT lr) AS distinct_lr, round(avg(CAST(lr >= 1 AS INT)) FILTER (WHERE item % 2 = 0), 6) AS rme_d_1,
 round(avg(CAST(lr >= 4 AS INT)) FILTER (WHERE item % 2 = 0), 6) AS rme_d_4, round(avg(CAST(lr >= 10 AS INT)) FILTER (WHERE item % 2 = 0), 6) AS rme_d_10, round(avg(CAST(lr <= 1 AS INT)) FILTER (WHERE item % 2 = 1), 6) AS rme_p FROM curves GROUP BY family""")
def q_rme(spark, d):
    t = calibrate.rates_misleading(V.curves(spark, d).withColumn("y", F.col("item") % 2), "lr", "y", ["family"])
    return t.select("family", "n_p", "distinct_lr", *[r6(c).alias(c) for c in ("rme_d_1", "rme_d_4", "rme_d_10", "rme_p")])


@query(f"WITH {C}, {TRUTH} SELECT own, family, count(*) AS n, round(exp(avg(ln(greatest(lr, 1e-12)))), 6) AS gmean FROM curves JOIN truth USING (item) GROUP BY ALL")
def q_leakage(spark, d):
    j = V.curves(spark, d).join(truth(spark, d), "item")
    return j.groupBy("own", "family").agg(F.count("*").alias("n"), r6(aggregate.geometric_mean(F.col("lr"))).alias("gmean"))


@query(f"WITH {C}, {TRUTH}, g AS (SELECT own, family, exp(avg(ln(greatest(lr, 1e-12)))) AS gm FROM curves JOIN truth USING (item) GROUP BY ALL) SELECT own, arg_max(family, gm) AS best, arg_max(family, gm) = own AS own_wins, max(gm) FILTER (WHERE family = own) > 1 AS above_one FROM g GROUP BY own")
def q_blind_diagnosis(spark, d):
    g = V.curves(spark, d).join(truth(spark, d), "item").groupBy("own", "family").agg(aggregate.geometric_mean(F.col("lr")).alias("gm"))
    return g.groupBy("own").agg(F.max_by("family", "gm").alias("best"), (F.max_by("family", "gm") == F.col("own")).alias("own_wins"), (F.max(F.when(F.col("family") == F.col("own"), F.col("gm"))) > 1).alias("above_one"))


@query(f"""WITH {C}, q AS (SELECT family, 0.05 AS fpr, quantile_cont(lr, 0.95) AS lr FROM curves WHERE item % 2 = 0 GROUP BY family UNION ALL SELECT family, 0.1, quantile_cont(lr, 0.9) FROM curves WHERE item % 2 = 0 GROUP BY family
 UNION ALL SELECT family, 0.25, quantile_cont(lr, 0.75) FROM curves WHERE item % 2 = 0 GROUP BY family UNION ALL SELECT family, 0.5, quantile_cont(lr, 0.5) FROM curves WHERE item % 2 = 0 GROUP BY family)
SELECT family, round(max(lr), 6) AS max_lr, CAST(min(fpr) FILTER (WHERE lr >= 2) AS DOUBLE) AS fpr_2, CAST(max(fpr) FILTER (WHERE lr >= 2) AS DOUBLE) AS fpr_2_last FROM q GROUP BY family""")
def q_cost(spark, d):
    grid = [0.05, 0.1, 0.25, 0.5]
    t = V.curves(spark, d).where("item % 2 = 0").groupBy("family").agg(F.percentile("lr", F.array(*[F.lit(1 - f) for f in grid])).alias("t"))
    rows = t.select("family", F.inline(F.arrays_zip(F.col("t").alias("lr"), F.array(*[F.lit(f) for f in grid]).alias("fpr")))).toDF("family", "lr", "fpr")
    ok = F.when(F.col("lr") >= 2, F.col("fpr"))
    return rows.groupBy("family").agg(r6(F.max("lr")).alias("max_lr"), F.min(ok).alias("fpr_2"), F.max(ok).alias("fpr_2_last"))


@query(f"WITH {C} SELECT family, round(0.5 * (avg(log2(1 + 1 / lr)) FILTER (WHERE item % 2 = 1) + avg(log2(1 + lr)) FILTER (WHERE item % 2 = 0)), 6) AS cllr, count(*) FILTER (WHERE item % 2 = 1) AS n_p, count(*) FILTER (WHERE item % 2 = 0) AS n_d FROM curves GROUP BY family")
def q_cllr(spark, d):
    return calibrate.cllr(V.curves(spark, d).withColumn("y", F.col("item") % 2), "lr", "y", ["family"]).withColumn("cllr", r6("cllr"))


@query(f"""WITH {C}, r AS (SELECT family, item % 2 AS y, lr AS t FROM curves UNION ALL SELECT DISTINCT family, 1, 1e-6 FROM curves UNION ALL SELECT DISTINCT family, 0, 1e6 FROM curves),
j AS (SELECT DISTINCT family, t FROM r UNION SELECT DISTINCT family, 1.0 FROM r), g AS (SELECT family, t FROM j UNION SELECT family, t * (1 - 1e-12) FROM j UNION SELECT family, t * (1 + 1e-12) FROM j),
e AS (SELECT g.family, g.t, avg(CAST(r.t <= g.t AS INT)) FILTER (WHERE y = 1) AS miss, avg(CAST(r.t > g.t AS INT)) FILTER (WHERE y = 0) AS fa FROM g JOIN r USING (family) GROUP BY ALL)
SELECT family, round(max(CASE WHEN t >= 1 THEN miss + t * fa ELSE miss / t + fa END), 4) AS nbe FROM e GROUP BY family""")
def q_nbe(spark, d):
    return bounds.nbe(V.curves(spark, d).withColumn("y", F.col("item") % 2), "lr", "y", ["family"]).select("family", F.round("nbe", 4).alias("nbe"))


@query(f"""WITH {C}, n AS (SELECT family, count(*) FILTER (WHERE item % 2 = 1) AS n_p, count(*) FILTER (WHERE item % 2 = 0) AS n_d, count(DISTINCT item % 7) AS n_gen FROM curves GROUP BY family)
SELECT family, round(greatest(1.0 / n_p, 1.0 / n_gen), 6) AS lower, CAST(least(n_d, n_gen) AS DOUBLE) AS upper FROM n""")
def q_bounds(spark, d):
    n = V.curves(spark, d).groupBy("family").agg(F.count_if(F.col("item") % 2 == 1).alias("n_p"), F.count_if(F.col("item") % 2 == 0).alias("n_d"), F.count_distinct(F.col("item") % 7).alias("n_gen"))
    lower, upper = bounds.adopt(bounds.count_bound(F.col("n_p"), F.col("n_d")), bounds.source_bound(F.col("n_gen")))
    return n.select("family", r6(lower).alias("lower"), upper.alias("upper"))


@query(f"""WITH {C}, c AS (SELECT family, lr AS v, count(*) FILTER (WHERE item % 2 = 1) AS p, count(*) FILTER (WHERE item % 2 = 0) AS d FROM curves GROUP BY ALL),
w AS (SELECT family, v, sum(p) OVER (PARTITION BY family ORDER BY v) AS pv, sum(d) OVER (PARTITION BY family ORDER BY v) AS dv, sum(p) OVER (PARTITION BY family) AS np, sum(d) OVER (PARTITION BY family) AS nd,
 coalesce(lead(v) OVER (PARTITION BY family ORDER BY v), 1e300) AS nxt, min(v) OVER (PARTITION BY family) AS first FROM c),
m AS (SELECT *, (pv + 1) / (np + 1) AS miss, (nd - dv + 1) / (nd + 1) AS alarm FROM w),
s AS (SELECT family, first, greatest(1.0, v, (1 - miss) / alarm) AS starts, nxt, v, CASE WHEN alarm < 1 THEN miss / (1 - alarm) ELSE 1e300 END AS low FROM m),
b AS (SELECT family, CASE WHEN any_value(first) > 1 THEN 1.0 ELSE least(1e6, coalesce(min(starts) FILTER (WHERE starts < nxt), 1e6)) END AS upper,
 greatest(1e-6, least(1.0, any_value(first)), coalesce(max(least(1.0, nxt, low)) FILTER (WHERE v < 1 AND low > v), 0)) AS lower FROM s GROUP BY family)
SELECT family, round(lower, 6) AS lower, round(upper, 6) AS upper, round(log10(upper / lower), 6) AS span FROM b""")
def q_elub(spark, d):
    e = bounds.elub(V.curves(spark, d).withColumn("y", F.col("item") % 2), "lr", "y", ["family"])
    return e.select("family", r6("lower").alias("lower"), r6("upper").alias("upper"), r6(F.log10(F.col("upper") / F.col("lower"))).alias("span"))


def calibrated(spark, d):
    s = V.doc_scores(spark, d)
    return calibrate.pav_lr(calibrate.pav(s, "score", "y"), s, "score")


@query()
def q_pav_lr(spark, d):
    return calibrated(spark, d).select("doc_id", "y", r6("score").alias("score"), r6("lr").alias("lr"))


@query()
def q_pav_identity(spark, d):
    """E[LR | 0] = 1 - P(LR = inf | 1) and E[1 / LR | 1] = 1 - P(LR = 0 | 0), exactly, on the fitted rows."""
    c, one, zero = calibrated(spark, d), F.col("y") == 1, F.col("y") == 0
    return c.agg(
        r6(F.avg(F.when(zero, F.col("lr")))).alias("e_lr_d"), r6(1 - F.avg(F.when(one, (F.col("lr") == X.INF).cast("int")))).alias("finite_p"),
        r6(F.avg(F.when(one, X.inverse(F.col("lr"))))).alias("e_inv_p"), r6(1 - F.avg(F.when(zero, (F.col("lr") == 0).cast("int")))).alias("positive_d"),
    )


@query()
def q_cllr_min(spark, d):
    s = V.doc_scores(spark, d).withColumn("lr", F.exp(F.col("score") - 7))
    total = calibrate.cllr(s, "lr", "y", []).first()["cllr"]
    least = calibrate.cllr_min(s, "lr", "y")
    return spark.createDataFrame([(round(total, 6), round(least, 6), round(total - least, 6))], "cllr double, cllr_min double, cllr_cal double")


Z = [f"z{c}" for c in V.SCORES]
INPUTS = ("orders", "customer", "nation", "region", "lineitem")


def standardised(spark, d):
    m = V.scored(spark, d)
    ref = m.where("label = 0 AND split = 'train'").agg(*[f(c).alias(f"{p}{c}") for c in V.SCORES for p, f in (("m", F.avg), ("d", F.stddev_samp))])
    return m.join(F.broadcast(ref)).select("item_id", "label", "family", "generator", "release_date", "source", "split", F.log10(X.area_fraction(F.col("source_width"), F.col("source_height"), 200)).alias("area"), *[((F.col(c) - F.col(f"m{c}")) / F.when(F.col(f"d{c}") > 0, F.col(f"d{c}")).otherwise(1)).alias(f"z{c}") for c in V.SCORES])


def kept(spark, d, name, build, **params):
    """A result that several queries rest on, as a block by content: computed by the first, read by the others."""
    return blocks.block(spark, name, params, [f"{d}/{t}.parquet" for t in INPUTS], [sys.modules[__name__], panel, calibrate, bounds, sampling, V], build)


def panel_rows(spark, d):
    """The scored items once, narrow: item_id, label, y, family, generator, release_date, split, area, the scores on the reference's scale,
    source_no (0 for authentic, else the generator's number) and fold (five, dealt within each source or generator)."""

    def build():
        rows = panel.numbered(standardised(spark, d), "label", "generator")[0].withColumn("y", F.col("label"))
        stratum = F.when(F.col("label") == 0, F.concat(F.lit("source:"), "source")).otherwise(F.concat(F.lit("generator:"), "generator"))
        return sampling.kfolds(rows.withColumn("stratum", stratum), ["split", "stratum"], "item_id").drop("source", "stratum")

    return kept(spark, d, "panel", build)


class Registry:
    """Generators in the order of their numbers with family and date, and what models of families learn from; a row a generator."""

    def __init__(self, rows):
        found = rows.where("label = 1").groupBy("source_no", "generator", "family").agg(F.min("release_date").alias("date")).orderBy("source_no").collect()
        self.names, self.of, self.dates = ([r[c] for r in found] for c in ("generator", "family", "date"))
        self.families = sorted(set(self.of))

    def keep(self, chosen):
        """What a model learns from that takes all of label 0 and the generators for which `chosen` (of name, family, date) holds."""
        return [True, *[bool(chosen(*g)) for g in zip(self.names, self.of, self.dates, strict=True)]]

    def family(self, f):
        return self.keep(lambda _, of, __: of == f)


def train(rows):
    return rows.where("split = 'train'")


#: The ridge strengths to choose from.
L2_GRID = (0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0)
FOLDS = 5


def strengths(spark, d):
    """(of, l2, cost): for each family and strength the mean over folds of the cost of ratios that didn't see the fold, within the
    count bound of the rows that were seen."""
    rows = train(panel_rows(spark, d))
    r = Registry(rows)
    specs = [(f, x, k) for f in r.families for x in L2_GRID for k in range(FOLDS)]
    models = panel.Models([r.family(f) for f, _, _ in specs], [k for *_, k in specs], [x for _, x, _ in specs])
    beta, n0, n1 = panel.fit(rows, models, Z)
    table = written(panel.blocks(rows, models, beta, Z, n0, n1), "strengths")
    places = [[i for i, s in enumerate(specs) if s[2] == k] for k in range(FOLDS)]
    if table.limit(panel.KNOTS + 1).count() <= panel.KNOTS:
        ends = np.column_stack([1 / np.maximum(1, n1), n0])
        cost = panel.costs(rows, models, beta, panel.knots_of(table, len(specs)), Z, ends, places).where("cllr IS NOT NULL")
        names = spark.createDataFrame([(i, f, x) for i, (f, x, _) in enumerate(specs)], "model int, of string, l2 double")
        return cost.join(F.broadcast(names), "model").groupBy("of", "l2").agg(F.avg("cllr").alias("cost"))
    lrs = panel.ratios(rows, "item_id", table, beta, Z, of_fold=places)
    seen = F.array(*[F.array(*[F.struct(F.lit(specs[i][0]).alias("of"), F.lit(specs[i][1]).alias("l2"), F.lit(float(1 / max(1, n1[i]))).alias("lower"), F.lit(float(n0[i])).alias("upper")) for i in p]) for p in places])
    long = lrs.select("y", "family", "fold", F.posexplode("lr").alias("place", "lr")).withColumn("m", F.get(F.get(seen, F.col("fold")), F.col("place")))
    long = long.where((F.col("y") == 0) | (F.col("family") == F.col("m.of"))).select("y", "fold", "m.of", "m.l2", X.clip(F.col("lr"), F.col("m.lower"), F.col("m.upper")).alias("lr"))
    return calibrate.cllr(long, "lr", "y", ["of", "l2", "fold"]).where("cllr IS NOT NULL").groupBy("of", "l2").agg(F.avg("cllr").alias("cost"))


def chosen(spark, d):
    """(of, l2, cllr): the strength of least cost for each family, the smaller of equal ones."""
    return kept(spark, d, "chosen", lambda: strengths(spark, d).groupBy("of").agg(F.min_by("l2", F.struct("cost", "l2")).alias("l2"), F.min("cost").alias("cllr")))


def fitted(rows, learned, models, of_fold=None, name="lr"):
    """(`rows` with an array of ratios, coefficients) of models fitted and calibrated on the rows `learned`."""
    beta, n0, n1 = panel.fit(learned, models, Z)
    table = written(panel.blocks(learned, models, beta, Z, n0, n1), "blocks")
    return panel.ratios(rows, "item_id", table, beta, Z, of_fold=of_fold, name=name), beta


def family_models(spark, d):
    r = Registry(panel_rows(spark, d))
    l2 = {x.of: x.l2 for x in chosen(spark, d).collect()}
    return r, panel.Models([r.family(f) for f in r.families], l2=[l2[f] for f in r.families])


def family_panel(spark, d):
    """(registry, items with `lr`, the ratios under every family's model in order of the families' names, whatever their own family)."""
    r, models = family_models(spark, d)
    rows = panel_rows(spark, d)
    return r, kept(spark, d, "families", lambda: fitted(rows, train(rows), models)[0])


def own(lrs, names, name="lr"):
    """(of, ..., lr): each item under the models that it can count for, all of them for label 0 and its own family's for label 1."""
    return panel.long(lrs, names, name).where((F.col("y") == 0) | (F.col("family") == F.col("of")))


def family_ratios(spark, d):
    r, lrs = family_panel(spark, d)
    return own(lrs, r.families)


def family_bounds(spark, d):
    """(of, lower, upper): the bounds of each family's ratios on the rows it learned from."""
    return kept(spark, d, "bounds", lambda: bounds.elub(train(family_ratios(spark, d)), "lr", "y", ["of"]))


def bounded_panel(spark, d):
    """(registry, items with `lr` within the bounds of each model)."""
    r, lrs = family_panel(spark, d)
    e = {x.of: (x.lower, x.upper) for x in family_bounds(spark, d).collect()}
    ends = F.array(*[F.struct(F.lit(e[f][0]).alias("lower"), F.lit(e[f][1]).alias("upper")) for f in r.families])
    return r, lrs.withColumn("lr", F.zip_with("lr", ends, lambda x, b: X.clip(x, b["lower"], b["upper"])))


@query()
def q_fuse_ridge(spark, d):
    rows = train(panel_rows(spark, d))
    r = Registry(rows)
    beta, _, _ = panel.fit(rows, panel.Models([r.family(f) for f in r.families]), Z)
    return spark.createDataFrame([(f, *[round(float(x), 6) for x in b]) for f, b in zip(r.families, beta, strict=True)], ", ".join(["family string", "intercept double", *[f"b_{z} double" for z in Z]]))


def span(lower: str, upper: str):
    return r6(F.log10(F.col(upper) / F.col(lower))).alias("span")


def clipped(lrs, e, keys):
    """Ratios within the bounds (keys, lower, upper) of their model."""
    return lrs.join(F.broadcast(e), keys).withColumn("lr", X.clip(F.col("lr"), F.col("lower"), F.col("upper"))).drop("lower", "upper")


@query()
def q_pick_l2(spark, d):
    """The ridge strength of least out-of-fold cost for each family; ratios are clipped to the count bound of the rows that were seen."""
    return chosen(spark, d).select(F.col("of").alias("family"), "l2", r6("cllr").alias("cllr"))


#: Models given as fixed values, for the query that SQL can check: (intercept, weights), calibrator as (score, share of label 1), bounds.
GIVEN = {
    "AFRICA": ((0.1, 0.5, -0.25, 0.125, 0.0, 0.25), ((-2.0, 0.1), (0.0, 0.4), (1.5, 0.9)), (0.2, 5.0)),
    "AMERICA": ((0.0, -0.5, 0.5, 0.0, 0.25, 0.0), ((-1.0, 0.2), (0.5, 0.5), (2.0, 0.8)), (0.125, 8.0)),
    "ASIA": ((-0.25, 0.25, 0.25, 0.25, 0.25, 0.25), ((-3.0, 0.05), (-1.0, 0.3), (3.0, 0.95)), (0.1, 10.0)),
    "EUROPE": ((0.5, 0.0, 0.0, -1.0, 0.5, 0.125), ((-1.5, 0.25), (0.25, 0.45), (1.0, 0.7)), (0.25, 4.0)),
    "MIDDLE EAST": ((0.0, 1.0, 0.0, 0.0, 0.0, -0.5), ((-0.5, 0.35), (0.0, 0.5), (0.5, 0.65)), (0.5, 2.0)),
}
_GIVEN_SQL = " UNION ALL ".join(
    f"SELECT item_id, own, '{f}' AS family, least({hi!r}, greatest({lo!r}, p / (1 - p))) AS lr FROM (SELECT item_id, own, CASE WHEN s <= {k[0][0]!r} THEN {k[0][1]!r} "
    + " ".join(f"WHEN s <= {b[0]!r} THEN {a[1]!r} + ({b[1]!r} - {a[1]!r}) / ({b[0]!r} - {a[0]!r}) * (s - ({a[0]!r}))" for a, b in zip(k, k[1:], strict=False))
    + f" ELSE {k[-1][1]!r} END AS p FROM (SELECT item_id, own, {w[0]!r} + {' + '.join(f'{b!r} * z{c}' for b, c in zip(w[1:], V.SCORES, strict=True))} AS s FROM zz))"
    for f, (w, k, (lo, hi)) in GIVEN.items()
)


@query(f"""WITH {V.SCORED}, r AS (SELECT {', '.join(f"avg({c}) AS m{c}, stddev_samp({c}) AS d{c}" for c in V.SCORES)} FROM scored WHERE label = 0 AND split = 'train'),
zz AS (SELECT item_id, family AS own, {', '.join(f"({c} - m{c}) / CASE WHEN d{c} > 0 THEN d{c} ELSE 1 END AS z{c}" for c in V.SCORES)} FROM scored, r) SELECT item_id, own, family, round(lr, 6) AS lr FROM ({_GIVEN_SQL})""")
def q_lr_matrix(spark, d):
    """The ratio of every item under every family's model, those of other families too, for given models: one pass, an array, no copy of a row."""
    beta = np.array([w for w, _, _ in GIVEN.values()])
    knots = [tuple(np.array(x) for x in zip(*k, strict=True)) for _, k, _ in GIVEN.values()]
    lrs = panel.apply(standardised(spark, d), beta, knots, Z, bounds=np.array([b for *_, b in GIVEN.values()]))
    return panel.long(lrs.select("item_id", F.col("family").alias("own"), "lr"), list(GIVEN), of="family").select("item_id", "own", "family", r6("lr").alias("lr"))


@query()
def q_panel_leakage(spark, d):
    """Geometric mean of the ratios of the other half under each model (rows) by the items' own family (columns): what models see of families not theirs."""
    r, lrs = bounded_panel(spark, d)
    return panel.long(lrs.where("split = 'val'"), r.families).groupBy(F.col("family").alias("own"), F.col("of").alias("family")).agg(F.count("*").alias("n"), r6(aggregate.geometric_mean(F.col("lr"))).alias("gmean"))


def panel_agg(spark, d):
    """The aggregators over the families out by each date, for the items of the other half; and their own family's date."""
    r, lrs = bounded_panel(spark, d)
    first = {f: min(x for x, of in zip(r.dates, r.of, strict=True) if of == f) for f in r.families}
    families = spark.createDataFrame(list(first.items()), "family string, date date")
    val = panel.long(lrs.where("split = 'val'").select(F.col("item_id").alias("item"), "y", F.col("release_date").alias("true_date"), "lr"), r.families, of="family")
    a = aggregate.aggregators(val.select("item", "family", "lr"), families, families.select(F.col("date").alias("T")).distinct())
    return a, lrs.where("split = 'val'").select(F.col("item_id").alias("item"), "y", F.col("family").alias("own"), F.col("release_date").alias("true_date"))


@query()
def q_panel_tstar(spark, d):
    """When the largest ratio over the families out first crosses each threshold, on the fitted panel."""
    a, t = panel_agg(spark, d)
    t = aggregate.tstar_table(aggregate.crossing(a, "max", THETAS), t)
    return t.select("theta", r6("cross_fake").alias("cross_fake"), r6("cross_authentic").alias("cross_authentic"), "median_day", "median_error", r6("share_early").alias("share_early"), r6("median_years").alias("median_years"))


@query()
def q_panel_multiplicity(spark, d):
    """The mean of the largest ratio of authentic items as families come out, with bootstrap limits, on the fitted panel."""
    a, t = panel_agg(spark, d)
    m = aggregate.multiplicity(a, t, 40)
    return m.select("T", "n", *[r6(c).alias(c) for c in ("mean", "lo95", "hi95")])


def crossfit(spark, d):
    """(registry, items with `lr` under the models of all families that didn't see the item's fold)."""
    rows = panel_rows(spark, d)
    r, one = family_models(spark, d)
    specs = [(j, k) for k in range(FOLDS) for j in range(len(r.families))]
    models = panel.Models([one.keep[j] for j, _ in specs], [k for _, k in specs], [one.l2[j] for j, _ in specs])
    places = [[i for i, s in enumerate(specs) if s[1] == k] for k in range(FOLDS)]
    return r, kept(spark, d, "crossfit", lambda: fitted(rows, rows, models, of_fold=places)[0])


def crossfit_cost(spark, d):
    r, lrs = crossfit(spark, d)
    lrs = own(lrs, r.families)
    e = bounds.elub(lrs, "lr", "y", ["of"])
    return calibrate.decomposition(clipped(lrs, e, ["of"]), "lr", "y", ["of"]), e


@query()
def q_crossfit(spark, d):
    """For each family: ratios of models that didn't see the row's fold, at the chosen strength, their bounds and cost, beside those of the fixed split."""
    c, e = crossfit_cost(spark, d)
    split = split_cost(spark, d).select("of", F.col("cllr").alias("cllr_split"), F.col("cllr_cal").alias("cllr_cal_split"))
    return c.join(e, "of").join(split, "of").select(F.col("of").alias("family"), "n_p", "n_d", *[r6(x).alias(x) for x in ("cllr", "cllr_min", "cllr_cal")], span("lower", "upper"), r6("cllr_split").alias("cllr_split"), r6("cllr_cal_split").alias("cllr_cal_split"))


def truncated(spark, d):
    """(registry, specs, items with `lr`, bounds): a model for each family and number of generators released, of the family's strength;
    every item under every one of them. specs: (family, j, date from which the model is in force), in order."""
    rows = panel_rows(spark, d)
    r, one = family_models(spark, d)
    specs, keeps, l2 = [], [], []
    for f, x in zip(r.families, one.l2, strict=True):
        members = sorted((date, n) for n, of, date in zip(r.names, r.of, r.dates, strict=True) if of == f)
        for j, (date, _) in enumerate(members, 1):
            out = {n for _, n in members[:j]}
            specs.append((f, j, date))
            keeps.append(r.keep(lambda n, *_, out=out: n in out))
            l2.append(x)
    models = panel.Models(keeps, l2=l2)
    lrs = kept(spark, d, "truncated", lambda: fitted(rows, train(rows), models)[0])
    learns = F.array(*[F.array(*[F.lit(bool(k)) for k in m]) for m in models.keep])
    long = panel.long(train(lrs), list(range(len(specs))), of="m").where(F.get(F.get(learns, F.col("m")), F.col("source_no")))
    return r, specs, lrs, kept(spark, d, "truncated_bounds", lambda: bounds.elub(long, "lr", "y", ["m"]))


@query()
def q_truncated(spark, d):
    """Cost and bounds of each truncated model, on all of the family's rows of the other half."""
    r, specs, lrs, e = truncated(spark, d)
    table = spark.createDataFrame([(m, *s) for m, s in enumerate(specs)], "m int, of string, j int, by date")
    val = panel.long(lrs.where("split = 'val'"), list(range(len(specs))), of="m").join(F.broadcast(table), "m").where("y = 0 OR family = of")
    c = calibrate.cllr(clipped(val, e, ["m"]), "lr", "y", ["m"])
    return c.join(F.broadcast(table), "m").join(F.broadcast(e), "m").select(F.col("of").alias("family"), "j", "by", "n_p", "n_d", r6("cllr").alias("cllr"), span("lower", "upper"))


def in_force(specs, dates):
    """For each date the numbers of the models in force: of each family the one with all of its generators released by then."""
    out = []
    for t in dates:
        last = {f: m for m, (f, _, by) in enumerate(specs) if by <= t}
        out.append(sorted(last.values()))
    return out


def running(lr, ends, force):
    """For each date in order: the greatest so far of the ratios `lr`, within the bounds `ends` of their models, that were in force at a date.

    Which models those are doesn't depend on the row, so each date has its list of all models up to then. Ratios are clipped where they
    are taken: Spark puts an expression in place of a name, and would make a clipped array anew for each element taken from it."""
    lower, upper = (F.array(*[F.lit(e[k]) for e in ends]) for k in (0, 1))
    upto = F.array(*[F.array(*[F.lit(m) for m in sorted(set().union(*force[: k + 1]))]) for k in range(len(force))])
    within = lambda m: X.clip(F.get(lr, m), F.get(lower, m), F.get(upper, m))
    return F.transform(upto, lambda ms: F.array_max(F.transform(ms, within)))


@query()
def q_truncated_curve(spark, d):
    """For each date and class: the mean running maximum over families of every item's ratios under the models that could be fitted by then."""
    _, specs, lrs, e = truncated(spark, d)
    ends = {x.m: (x.lower, x.upper) for x in e.collect()}
    dates = sorted({by for *_, by in specs})
    lrs = lrs.where("split = 'val'")
    run = lrs.select("label", F.posexplode(running("lr", [ends[m] for m in range(len(specs))], in_force(specs, dates))).alias("k", "running"))
    names = F.array(*[F.lit(t) for t in dates])
    return run.groupBy(F.get(names, F.col("k")).alias("T"), "label").agg(F.count("*").alias("n"), r6(F.avg("running")).alias("mean_running"), r6(F.avg((F.col("running") >= 2).cast("int"))).alias("share_2"))


def on_halves(lrs, keys):
    """(cost, bounds): the bounds of the ratios of the one half, and the cost of the other within them."""
    e = bounds.elub(lrs.where("split = 'train'"), "lr", "y", keys)
    return calibrate.decomposition(clipped(lrs.where("split = 'val'"), e, keys), "lr", "y", keys), e


def split_cost(spark, d):
    return calibrate.decomposition(clipped(family_ratios(spark, d).where("split = 'val'"), family_bounds(spark, d), ["of"]), "lr", "y", ["of"])


def floor_of(spark, d):
    """(registry, items with `lr`): the same calibration from one field of metadata, whose own value is the score of all models."""
    rows = panel_rows(spark, d)
    r = Registry(rows)
    models = panel.Models([r.family(f) for f in r.families])

    def build():
        n = {(x.source_no, x.split): x["count"] for x in rows.groupBy("source_no", "split").count().collect()}
        n0 = np.full(len(r.families), float(n.get((0, "train"), 0)))
        n1 = np.array([sum(c for (s, half), c in n.items() if s and half == "train" and m[s]) for m in models.keep], "float64")
        beta = np.tile([0.0, 1.0], (len(r.families), 1))
        table = written(panel.blocks(train(rows), models, beta, ["area"], n0, n1), "floor")
        return panel.ratios(rows, "item_id", table, beta, ["area"])

    return r, kept(spark, d, "floor", build)


def floor_cost(spark, d):
    r, lrs = floor_of(spark, d)
    return on_halves(own(lrs, r.families), ["of"])


@query()
def q_floor(spark, d):
    """The same calibration, bounds and cost from one field of metadata, the share of the area that is cropped: what the panel must beat."""
    c, e = floor_cost(spark, d)
    return c.join(e, "of").select(F.col("of").alias("family"), "n_p", "n_d", *[r6(x).alias(x) for x in ("lower", "upper", "cllr", "cllr_min", "cllr_cal")])


def learned_from(spark, d):
    """(of, t_p, t_d, n_gen): the rows of both labels and the generators that each family's model learned from."""
    rows = train(panel_rows(spark, d)).groupBy("family").agg(F.count("*").alias("t_p"), F.count_distinct("generator").alias("n_gen"), F.first("label").alias("label"))
    zero = rows.where("label = 0").select(F.col("t_p").alias("t_d"))
    return rows.where("label = 1").join(F.broadcast(zero)).select(F.col("family").alias("of"), "t_p", "t_d", "n_gen")


def all_bounds(spark, d):
    """Each family's three bounds and the tightest."""
    e = family_bounds(spark, d).join(learned_from(spark, d), "of")
    count, source = bounds.count_bound(F.col("t_p"), F.col("t_d")), bounds.source_bound(F.col("n_gen"))
    lower, upper = bounds.adopt([F.col("lower"), F.col("upper")], count, source)
    return e.select("*", *[c.alias(f"{name}_{side}") for name, pair in (("count", count), ("source", source)) for side, c in zip(("lower", "upper"), pair, strict=True)], lower.alias("lo"), upper.alias("hi"))


@query()
def q_family_table(spark, d):
    """For each family: fusion on train at the chosen strength, isotonic calibration, three bounds and the tightest, cost on the other half, and the floor."""
    floor = floor_cost(spark, d)[0].select("of", F.col("cllr").alias("cllr_floor"))
    return split_cost(spark, d).join(all_bounds(spark, d), "of").join(chosen(spark, d).select("of", "l2"), "of").join(floor, "of").select(
        F.col("of").alias("family"), "n_gen", "t_p", "n_p", "n_d", "l2", r6("lower").alias("elub_lower"), r6("upper").alias("elub_upper"), *[r6(c).alias(c) for c in ("count_lower", "count_upper", "source_lower", "source_upper")],
        r6("lo").alias("lower"), r6("hi").alias("upper"), *[r6(c).alias(c) for c in ("cllr", "cllr_min", "cllr_cal", "cllr_floor")], span("lower", "upper"),
    )


@query()
def q_calibrators(spark, d):
    """Isotonic against logistic calibration of the same fused score: cost and span of bounds of each family."""
    r, models = family_models(spark, d)
    rows = panel_rows(spark, d)
    beta, _, _ = panel.fit(train(rows), models, Z)
    fused = rows.select("y", "family", "split", F.array(*[sum((F.lit(float(w)) * F.col(z) for w, z in zip(b[1:], Z, strict=True)), F.lit(float(b[0]))) for b in beta]).alias("fused"))
    scores = written(own(fused, r.families, "fused"), "scores")
    line = calibrate.logistic(train(scores), "fused", "y", ["of"])
    other = scores.join(F.broadcast(line), "of").withColumn("lr", F.exp(calibrate.fused_score(["fused"]))).select("of", "y", "split", "lr")
    parts = []
    for name, of in (("pav", family_ratios(spark, d)), ("logistic", written(other, "logistic"))):
        c, e = on_halves(of, ["of"])
        parts.append(c.join(e, "of").select(F.col("of").alias("family"), F.lit(name).alias("calibrator"), r6("cllr").alias("cllr"), r6("cllr_cal").alias("cllr_cal"), span("lower", "upper")))
    return parts[0].unionByName(parts[1])


@query()
def q_global_fusion(spark, d):
    """One fusion for all families with a calibrator for each, against a fusion for each family."""
    rows = panel_rows(spark, d)
    r = Registry(rows)
    beta, _, _ = panel.fit(train(rows), panel.Models([r.keep(lambda *_: True)]), Z)
    beta, models = np.repeat(beta, len(r.families), 0), panel.Models([r.family(f) for f in r.families])
    n = learned_from(spark, d).collect()
    n0, n1 = (np.array([next(float(x[c]) for x in n if x.of == f) for f in r.families]) for c in ("t_d", "t_p"))
    table = written(panel.blocks(train(rows), models, beta, Z, n0, n1), "global")
    c, e = on_halves(own(written(panel.ratios(rows, "item_id", table, beta, Z), "ratios"), r.families), ["of"])
    alone = split_cost(spark, d).select("of", F.col("cllr").alias("cllr_own"))
    return c.join(e, "of").join(alone, "of").select(F.col("of").alias("family"), "n_p", r6("cllr").alias("cllr"), r6("cllr_cal").alias("cllr_cal"), r6("cllr_own").alias("cllr_own"), span("lower", "upper"))


@query()
def q_generator_models(spark, d):
    """A model for each generator at a fixed strength, against that of its family: finer dates, fewer sources, less evidence."""
    rows = panel_rows(spark, d)
    r = Registry(rows)
    models = panel.Models([r.keep(lambda n, *_, g=g: n == g) for g in r.names])
    lrs = kept(spark, d, "generators", lambda: fitted(rows, train(rows), models)[0])
    c, e = on_halves(panel.long(lrs, r.names).where((F.col("y") == 0) | (F.col("generator") == F.col("of"))), ["of"])
    families = spark.createDataFrame(list(zip(r.names, r.of, strict=True)), "of string, of_family string")
    alone = split_cost(spark, d).select(F.col("of").alias("of_family"), F.col("cllr").alias("cllr_family"))
    return c.join(e, "of").join(F.broadcast(families), "of").join(F.broadcast(alone), "of_family").select(F.col("of").alias("generator"), F.col("of_family").alias("family"), "n_p", r6("cllr").alias("cllr"), r6("cllr_family").alias("cllr_family"), span("lower", "upper"), F.lit(1.0).alias("source_bound"))


@query()
def q_bound_choice(spark, d):
    """The cost of each family's ratios within four choices of bounds: those of the error rate, of counts, of sources, and the tightest."""
    choices = {"elub": ("lower", "upper"), "count": ("count_lower", "count_upper"), "source": ("source_lower", "source_upper"), "adopted": ("lo", "hi")}
    rows = all_bounds(spark, d).select("of", F.inline(F.array(*[F.struct(F.lit(k).alias("bound"), F.col(a).alias("lo"), F.col(b).alias("hi")) for k, (a, b) in choices.items()])))
    val = family_ratios(spark, d).where("split = 'val'").join(F.broadcast(rows), "of").withColumn("lr", X.clip(F.col("lr"), F.col("lo"), F.col("hi")))
    c = calibrate.cllr(val, "lr", "y", ["of", "bound"])
    return c.join(rows, ["of", "bound"]).select(F.col("of").alias("family"), "bound", r6("cllr").alias("cllr"), span("lo", "hi"))


@query()
def q_identity_table(spark, d):
    """The two identities of the isotonic ratios of each family on the rows they were fitted to (see q_pav_identity)."""
    one, zero = F.col("y") == 1, F.col("y") == 0
    return train(family_ratios(spark, d)).groupBy(F.col("of").alias("family")).agg(
        r6(F.avg(F.when(zero, F.col("lr")))).alias("e_lr_d"), r6(1 - F.avg(F.when(one, (F.col("lr") == X.INF).cast("int")))).alias("finite_p"),
        r6(F.avg(F.when(one, X.inverse(F.col("lr"))))).alias("e_inv_p"), r6(1 - F.avg(F.when(zero, (F.col("lr") == 0).cast("int")))).alias("positive_d"),
    )


@query()
def q_lr_rank_matrix(spark, d):
    """Rank correlation of the ratios of each pair of families over the authentic items of the other half; least and median of all pairs."""
    r, lrs = bounded_panel(spark, d)
    safe = [f"lr_{i}" for i in range(len(r.families))]
    wide = lrs.where("split = 'val' AND label = 0").select(F.lit(1).alias("one"), *[F.get("lr", F.lit(i)).alias(s) for i, s in enumerate(safe)])
    m = ranks.spearman_matrix(wide, safe, ["one"])
    ends = m.agg(F.min("rho").alias("least"), F.median("rho").alias("middle"))
    name = F.create_map(*[F.lit(x) for s, n in zip(safe, r.families, strict=True) for x in (s, n)])
    return m.join(F.broadcast(ends)).select(name[F.col("a")].alias("a"), name[F.col("b")].alias("b"), *[r6(c).alias(c) for c in ("rho", "least", "middle")])


def blind(spark, d):
    """(of, n_gen, lower, upper, cllr_min, null_median, p, support) of each family."""
    e = family_bounds(spark, d)
    val = written(clipped(family_ratios(spark, d).where("split = 'val'"), e, ["of"]).select("of", "y", "lr"), "val")
    seen = calibrate.block_cost(calibrate.pav_table(val, "lr", "y", ["of"]), ["of"]).withColumnRenamed("cllr_min", "observed")
    null = calibrate.permuted_cost(val, "lr", "y", ["of"], 2000).join(F.broadcast(seen), "of")
    p = null.groupBy("of").agg(F.first("observed").alias("cllr_min"), F.median("cllr_min").alias("null_median"), ((1 + F.count_if(F.col("cllr_min") <= F.col("observed") + 1e-12)) / (1.0 + F.count("*"))).alias("p"))
    rows = panel_rows(spark, d)
    ends = rows.where("y = 0").agg(F.percentile("area", 0.01).alias("lo"), F.percentile("area", 0.99).alias("hi"))
    support = rows.where("y = 1").join(F.broadcast(ends)).groupBy(F.col("family").alias("of")).agg(F.avg(F.col("area").between(F.col("lo"), F.col("hi")).cast("int")).alias("support"), F.count_distinct("generator").alias("n_gen"))
    return p.join(support, "of").join(e, "of")


@query()
def q_blind_battery(spark, d):
    """Four ways to see nothing of a family: no span of bounds, no order in its ratios against permuted labels, one source, no common support of the covariate."""
    return blind(spark, d).select(
        F.col("of").alias("family"), "n_gen", span("lower", "upper"), r6("cllr_min").alias("cllr_min"), r6("null_median").alias("null_median"), r6("p").alias("p"), (F.col("p") > 0.05).alias("panel_blind"),
        (F.col("n_gen") == 1).alias("registry_blind"), r6("support").alias("support"), (F.col("support") == 0).alias("confound_blind"),
    )


@query()
def q_summary_table(spark, d):
    """The panel on one page: for each family its date, what it can't see, the widest ratio that can be stated, and its cost split, cross-fitted and from the floor."""
    date = panel_rows(spark, d).where("y = 1").groupBy(F.col("family").alias("of")).agg(F.min("release_date").alias("available"))
    cost = lambda df, name: df.select("of", r6("cllr").alias(name))
    b = blind(spark, d).select("of", "n_gen", (F.col("p") > 0.05).alias("panel_blind"), (F.col("n_gen") == 1).alias("registry_blind"), (F.col("support") == 0).alias("confound_blind"))
    out = b.join(date, "of").join(all_bounds(spark, d).select("of", span("lower", "upper"), r6("hi").alias("most")), "of")
    for part in (cost(split_cost(spark, d), "cllr_split"), cost(crossfit_cost(spark, d)[0], "cllr_crossfit"), cost(floor_cost(spark, d)[0], "cllr_floor")):
        out = out.join(part, "of")
    return out.withColumnRenamed("of", "family")
