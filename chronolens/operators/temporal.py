"""Tests of change over release time, with release groups as the independent units.

Class models here are diagonal normal distributions from each generator's (n, sum, sum of squares), so holding out a group is a
subtraction; `attribution` has the tests with mixtures and their permutations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import md5_uniform
from .ranks import permuted
from .vectors import centre, covariance, group_means, long, project

WINDOW_DAYS = 7
RIDGE = 1e-3


def release_groups(generators: DataFrame, by: list[str], date: str = "release_date", window: int = WINDOW_DAYS) -> DataFrame:
    """`generators` with grp (a new one after a gap of more than `window` days) and group_date (its first date)."""
    w = Window.partitionBy(*by).orderBy(date, "generator")
    new = F.coalesce((F.datediff(date, F.lag(date).over(w)) > window).cast("int"), F.lit(0))
    g = generators.withColumn("new", new).withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")
    return g.withColumn("group_date", F.min(date).over(Window.partitionBy(*by, "grp")))


def time_bins(groups: DataFrame, by: list[str], n_bins: int, date: str = "group_date") -> DataFrame:
    """`groups` (by, grp, date) with bin: as many groups in each, in order of date."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(date, "grp")) - 1
    return groups.withColumn("bin", F.least(F.lit(n_bins - 1), F.floor(rank * n_bins / F.count("*").over(w))).cast("int"))


def moments(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    return long(df, keys, x).groupBy(*keys, "i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


def attribution(stats: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """Leave-one-release-group-out attribution of generators to classes.

    stats: generator, i, n, s, q. classes: by, generator, grp, class. Each generator is scored, by its mean log
    likelihood a row, under each class's model from the generators of other groups; a row for each (by, generator):
    truth, predicted (ties to the first class), llr (true class less the mean of the others)."""
    of = stats.join(F.broadcast(classes), "generator")
    whole = of.groupBy(*by, "class", "i").agg(*[F.sum(c).alias(f"t_{c}") for c in "nsq"])
    held = of.groupBy(*by, F.col("grp").alias("held"), "class", "i").agg(*[F.sum(c).alias(f"h_{c}") for c in "nsq"])
    groups = classes.select(*by, F.col("grp").alias("held")).distinct()
    rest = whole.join(F.broadcast(groups), by).join(held, [*by, "held", "class", "i"], "left") if by else whole.crossJoin(F.broadcast(groups)).join(held, ["held", "class", "i"], "left")
    left = lambda c: F.col(f"t_{c}") - F.coalesce(F.col(f"h_{c}"), F.lit(0))
    model = rest.select(*by, F.col("held").alias("grp"), F.col("class").alias("model"), "i", left("n").alias("m"), (left("s") / F.nullif(left("n"), F.lit(0))).alias("mu"), left("q").alias("sq")).where("m > 0")
    model = model.withColumn("var", F.greatest(F.lit(0.0), F.col("sq") / F.col("m") - F.col("mu") * F.col("mu")) + RIDGE)
    mean_square = (F.col("q") - 2 * F.col("mu") * F.col("s") + F.col("n") * F.col("mu") * F.col("mu")) / F.col("n")
    ll = F.sum(-0.5 * (F.log(2 * F.pi() * F.col("var")) + mean_square / F.col("var")))
    scores = of.join(model, [*by, "grp", "i"]).groupBy(*by, "generator", "grp", F.col("class").alias("truth"), "model").agg(ll.alias("ll"))
    best = F.min_by("model", F.struct(-F.round("ll", 9), F.col("model")))
    true = F.max(F.when(F.col("model") == F.col("truth"), F.col("ll")))
    others = F.avg(F.when(F.col("model") != F.col("truth"), F.col("ll")))
    return scores.groupBy(*by, "generator", "grp", "truth").agg(best.alias("predicted"), (true - others).alias("llr"))


def pair_gaps(cells: DataFrame) -> DataFrame:
    """Pairs of cells of different release groups within a family: day gap and whether they share an origin.

    cells: family, cell, grp, group_date, origin, and `mean`, the cell's mean vector; divergence is the squared distance of means."""
    from .vectors import squared_distance

    a, b = (cells.select("family", *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "grp", "group_date", "origin", "mean")]) for s in "ab")
    j = a.join(b, "family").where((F.col("cell_a") < F.col("cell_b")) & (F.col("grp_a") != F.col("grp_b")))
    return j.select("family", "cell_a", "cell_b", F.abs(F.datediff("group_date_a", "group_date_b")).alias("gap_days"), (F.col("origin_a") == F.col("origin_b")).alias("same_origin"), squared_distance(F.col("mean_a"), F.col("mean_b")).alias("divergence"))


def two_regressors(y: str, a: str, b: str) -> list[Column]:
    """Least-squares slopes of y on a and b from covariances."""
    caa, cbb, cab = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)
    cya, cyb = F.covar_pop(y, a), F.covar_pop(y, b)
    det = caa * cbb - cab * cab
    safe = F.when(F.abs(det) > 1e-12, det)
    return [((cya * cbb - cyb * cab) / safe).alias("b_a"), ((cyb * caa - cya * cab) / safe).alias("b_b")]


def drift(means: DataFrame, by: list[str]) -> DataFrame:
    """The norm of the slopes of each dimension on time in [0, 1]: rows are (by, grp, t, i, v)."""
    return means.groupBy(*by, "i").agg(F.regr_slope("v", "t").alias("slope")).groupBy(*by).agg(F.sqrt(F.sum(F.col("slope") * F.col("slope"))).alias("delta"))


def whitening(df: DataFrame, by: list[str], x: str = "x") -> np.ndarray:
    """A matrix that turns vectors into uncorrelated elements of unit spread within groups: the transposed inverse of the Cholesky factor
    of the pooled covariance, to whose diagonal a millionth of a millionth of its mean is added.

    The covariance is one aggregation; the factor, as wide as a vector, is the driver's."""
    _, cov = covariance(centre(df, by, x), x)
    width = len(cov)
    factor = np.linalg.cholesky(cov + np.eye(width) * max(1e-12 * np.trace(cov) / width, 1e-300))
    return np.linalg.solve(factor, np.eye(width)).T


def whitened_group_means(df: DataFrame, generators: DataFrame, family: list[str], x: str = "x") -> DataFrame:
    """(family, grp, t, i, v): the mean of each release group's generator means, in deviations within a generator, and its time in [0, 1].

    generators: family, generator, release_date."""
    q = whitening(df, ["generator"], x)
    means = group_means(df, [*family, "generator"], x)
    means = means.select(*family, "generator", project(F.col("mean"), np.zeros(len(q)), q).alias("mean"))  # a row for each generator
    g = release_groups(generators, family)
    w = Window.partitionBy(*family)
    days = F.greatest(F.lit(1), F.datediff(F.max("group_date").over(w), F.min("group_date").over(w)))
    g = g.withColumn("t", F.datediff("group_date", F.min("group_date").over(w)) / days)
    return long(means.join(F.broadcast(g), [*family, "generator"]), [*family, "grp", "t"], "mean").groupBy(*family, "grp", "t", "i").agg(F.avg("v").alias("v"))


def drift_test(means: DataFrame, family: list[str], perms: int = 1000, boot: int = 1000, seed: int = 0, least: int = 4) -> DataFrame:
    """The length of the slopes on time of a family's release groups, element by element. means: whitened_group_means().

    Beside it: the same with the groups' times dealt anew (mean, 95 % point, p), its 95 % point when groups are drawn with replacement,
    and tau, the root mean square of what the lines leave over. Families of fewer than `least` groups get no test."""
    groups = means.select(*family, "grp", "t").distinct()
    n = groups.groupBy(*family).agg(F.count("*").alias("n_groups"))
    fit = groups.join(F.broadcast(n.where(F.col("n_groups") >= least)), family)
    seen = drift(means, family)
    dealt = permuted(fit.drop("n_groups"), "grp", "t", family, perms, seed).select("perm", *family, "grp", F.col("shuffled").alias("t"))
    null = drift(means.drop("t").join(F.broadcast(dealt), [*family, "grp"]), [*family, "perm"]).select(*family, F.col("delta").alias("null"))
    slots = fit.withColumn("slot", F.row_number().over(Window.partitionBy(*family).orderBy("grp")))
    picks = fit.groupBy(*family).agg(F.first("n_groups").alias("n_groups")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(boot)))).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_groups"))))
    picks = picks.withColumn("slot", (F.floor(md5_uniform(F.lit(seed), *[F.col(c) for c in family], F.col("rep"), F.col("k")) * F.col("n_groups")) + 1).cast("int"))
    boots = drift(means.drop("t").join(F.broadcast(picks.join(slots.drop("n_groups"), [*family, "slot"]).select(*family, "rep", "grp", "t")), [*family, "grp"]), [*family, "rep"])
    boots = boots.where("delta IS NOT NULL").groupBy(*family).agg(F.percentile("delta", 0.95).alias("boot_q95"))
    line = means.groupBy(*family, "i").agg(F.regr_sxx("v", "t").alias("xx"), F.regr_sxy("v", "t").alias("xy"), F.regr_syy("v", "t").alias("yy"), F.count("*").alias("n"))
    tau = line.groupBy(*family).agg(F.sqrt(F.sum(F.greatest(F.lit(0.0), F.col("yy") - F.col("xy") * F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0)))) / F.nullif((F.first("n") - 2) * F.count("*"), F.lit(0))).alias("tau"))
    tests = null.join(F.broadcast(seen), family).groupBy(*family).agg(
        F.first("delta").alias("delta"), F.avg("null").alias("null_mean"), F.percentile("null", 0.95).alias("null_q95"), ((1 + F.count_if(F.col("null") >= F.col("delta") - 1e-9)) / (1.0 + F.count("*"))).alias("p")
    ).join(boots, family).join(tau, family)
    return n.join(tests, family, "left").withColumn("not_testable", F.when(F.col("n_groups") < least, F.format_string(f"{least} release groups are needed, %d are there", "n_groups")))
