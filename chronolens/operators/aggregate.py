"""Evidence over the families available by each date: curves, crossings and their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import md5_uniform
from .ranks import positions

DRAWS = 10_000


def availability(families: DataFrame, dates: DataFrame) -> DataFrame:
    """(T, family) for each date T of the grid and each family out by then; both tables are registries."""
    return dates.join(F.broadcast(families.select("family", "date")), F.col("date") <= F.col("T")).select("T", "family")


def aggregators(lrs: DataFrame, families: DataFrame, dates: DataFrame) -> DataFrame:
    """For each item and date: the number of families out, the maximum of their ratios as it is, over all families
    and over those out, and their uniform mixture."""
    n_all = families.count()
    avail = availability(families, dates)
    of = F.broadcast(avail.groupBy("T").agg(F.count("*").alias("n_out")))
    c = lrs.join(F.broadcast(avail), "family").groupBy("item", "T").agg(F.max("lr").alias("max"), F.sum("lr").alias("sum")).join(of, "T")
    return c.select("item", "T", "n_out", "max", (F.col("max") / n_all).alias("max_over_all"), (F.col("max") / F.col("n_out")).alias("max_over_out"), (F.col("sum") / F.col("n_out")).alias("mixture"))


def monotone_violations(curve: DataFrame, value: str, tol: float = 1e-12) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy("item").orderBy("T"))
    return curve.withColumn("step", F.col(value) - before).agg(F.count_if(F.col("step") < -tol).alias("violations"), F.count("step").alias("steps"))


def running_max(curve: DataFrame, value: str) -> DataFrame:
    return curve.withColumn("running", F.max(value).over(Window.partitionBy("item").orderBy("T").rowsBetween(Window.unboundedPreceding, 0)))


def crossing(curve: DataFrame, value: str, thetas: list[float]) -> DataFrame:
    """(item, theta, tstar): the first date at which the curve reaches theta, null if it never does."""
    wide = curve.groupBy("item").agg(*[F.min(F.when(F.col(value) >= t, F.col("T"))).alias(f"t{i}") for i, t in enumerate(thetas)])
    return wide.select("item", F.inline(F.array(*[F.struct(F.lit(float(t)).alias("theta"), F.col(f"t{i}").alias("tstar")) for i, t in enumerate(thetas)])))


def tstar_table(tstar: DataFrame, truth: DataFrame) -> DataFrame:
    """For each theta: crossing rates by class, median date and median days early or late, share early. truth: item, y, true_date."""
    j = tstar.join(truth, "item")
    fake = F.col("y") == 1
    err = F.when(fake, F.datediff("tstar", "true_date"))
    return j.groupBy("theta").agg(
        F.avg(F.when(fake, F.col("tstar").isNotNull().cast("int"))).alias("cross_fake"), F.avg(F.when(~fake, F.col("tstar").isNotNull().cast("int"))).alias("cross_authentic"),
        F.median(F.when(fake, F.unix_date("tstar"))).alias("median_day"), F.median(err).alias("median_error"), F.avg((err < 0).cast("int")).alias("share_early"), (F.median(F.abs(err)) / 365.25).alias("median_years"),
    )


def multiplicity(curve: DataFrame, truth: DataFrame, boot: int, seed: int = 0) -> DataFrame:
    """For each date: the mean of the maximum over authentic items, with 2.5 and 97.5 % points of a bootstrap over items.

    Draws are made where they are used, `DRAWS` in a row of work. Spark takes them for as few rows as there are dates and would send
    them through the driver as a broadcast, so the join is one of sorted sides."""
    d = curve.join(truth.where("y = 0"), "item")
    d = positions(d.select("T", "item", "max"), ["T"], ["item"], "slot").withColumn("slot", F.col("slot") - 1)
    n = d.groupBy("T").agg(F.count("*").alias("n"), F.avg("max").alias("mean"))
    pick = F.floor(md5_uniform(F.lit(seed), F.unix_date("T"), F.col("rep"), F.col("k")) * F.col("n")).cast("int")
    reps = n.select("T", "n", F.explode(F.sequence(F.lit(1), F.lit(boot))).alias("rep"))
    parts = reps.select("T", "n", "rep", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"), F.lit(DRAWS))).alias("first"))
    parts = parts.repartition(4 * d.sparkSession.sparkContext.defaultParallelism, "T", "rep", "first")  # a row for each DRAWS draws
    draws = parts.select("T", "n", "rep", F.explode(F.sequence("first", F.least(F.col("first") + DRAWS - 1, F.col("n").cast("int")))).alias("k")).select("T", "rep", pick.alias("slot"))
    means = draws.join(d.select("T", "slot", "max").hint("merge"), ["T", "slot"]).groupBy("T", "rep").agg(F.avg("max").alias("b"))
    ends = means.groupBy("T").agg(F.percentile("b", 0.025).alias("lo95"), F.percentile("b", 0.975).alias("hi95"))
    return n.join(ends, "T")


def geometric_mean(x: Column, floor: float = 1e-12) -> Column:
    return F.exp(F.avg(F.log(F.greatest(x, F.lit(floor)))))


def tippett(df: DataFrame, lr: str, y: str, grid: list[float]) -> DataFrame:
    """(x, y, share of class y with a ratio of at least x), from the counts of distinct ratios."""
    hist = df.groupBy(y, lr).agg(F.count("*").alias("n"))
    x = df.sparkSession.createDataFrame([(float(v),) for v in grid], "x double")
    return hist.join(F.broadcast(x)).groupBy("x", y).agg((F.sum(F.when(F.col(lr) >= F.col("x"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
