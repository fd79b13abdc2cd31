"""Reproducible sampling: order by an md5 of (seed, stratum, key), so strata don't depend on one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import positions


def draw_order(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def ranked(df: DataFrame, stratum: list[str], key: str, seed: int, name: str = "draw") -> DataFrame:
    return positions(df.withColumn("order_", draw_order(seed, *stratum, key)), stratum, ["order_", key], name).drop("order_")


def first_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def stratified_split(df: DataFrame, stratum: str, key: str, seed: int = 1234) -> DataFrame:
    """Half of each stratum to train; odd strata, in order of name, alternate where the spare row goes."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    odd_before = F.sum(F.col("size") % 2).over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1))  # a row for each stratum
    spare = F.when((F.col("size") % 2 == 1) & (F.coalesce(odd_before, F.lit(0)) % 2 == 0), 1).otherwise(0)
    quota = sizes.select(stratum, (F.floor(F.col("size") / 2) + spare).alias("n_train"))
    return ranked(df, [stratum], key, seed).join(F.broadcast(quota), stratum).withColumn("half", F.when(F.col("draw") <= F.col("n_train"), "train").otherwise("val")).drop("n_train", "draw")


def allocate(sizes: DataFrame, key: str, size: str, total: Column, within: list[str] | None = None) -> DataFrame:
    """Shares of `total` in proportion to `size`, summing to it by largest remainders (ties to the later key), capped by size.

    One pass after the floors meets the total unless a cap binds; a second pass deals out what the caps left over."""
    of = Window.partitionBy(*(within or [F.lit(0)]))
    exact = total * F.col(size) / F.sum(size).over(of)
    out = sizes.withColumn("exact", exact).withColumn("share", F.least(F.floor("exact"), F.col(size)))
    for _ in range(2):
        room = F.when(F.col("share") < F.col(size), 1).otherwise(0)
        order = F.row_number().over(of.orderBy(F.desc("room"), F.desc(F.round(F.col("exact") - F.col("share"), 9)), F.desc(key)))
        out = out.withColumn("room", room).withColumn("order", order).withColumn("left", F.least(total, F.sum(size).over(of)) - F.sum("share").over(of))
        out = out.withColumn("share", F.col("share") + F.when((F.col("order") <= F.col("left")) & (F.col("room") == 1), 1).otherwise(0)).drop("room", "order", "left")
    return out.drop("exact").withColumn("share", F.col("share").cast("long"))


def draw(df: DataFrame, group: str, part: str, key: str, n: Column, seed: int = 1234) -> DataFrame:
    """`n` rows of each group, in the proportions of its parts."""
    sizes = df.groupBy(group, part).agg(F.count("*").alias("size"))
    quota = allocate(sizes, part, "size", n, [group])
    return ranked(df, [group, part], key, seed).join(quota.select(group, part, "share"), [group, part]).where(F.col("draw") <= F.col("share")).drop("draw", "share")


def draw_matched(df: DataFrame, label: str, group: str, part: str, source: str, key: str, per_group: int, seed: int = 1234) -> DataFrame:
    """`per_group` rows of each group of label 1, and as many rows of label 0 in all, dealt over sources."""
    ones = draw(df.where(F.col(label) == 1), group, part, key, F.lit(per_group), seed)
    n = ones.count()
    zeros = df.where(F.col(label) == 0)
    quota = allocate(zeros.groupBy(source).agg(F.count("*").alias("size")), source, "size", F.lit(n))
    picked = ranked(zeros, [source], key, seed).join(F.broadcast(quota.select(source, "share")), source).where(F.col("draw") <= F.col("share")).drop("draw", "share")
    return ones.unionByName(picked)


def draw_keeping_whole(df: DataFrame, label: str, group: str, part: str, source: str, key: str, per_group: int, whole: list[str], seed: int = 1234) -> DataFrame:
    """`per_group` rows of each group of label 1, and as many rows of label 0 in all: the sources in `whole` with all their rows, the
    others in proportion for what is left.

    Before anything is drawn, groups that are short of `per_group` rows, and whole sources that hold more rows than are needed, are a
    ValueError that lists them. The counts are tables with a row for each group and source."""
    ones, zeros = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    sizes = ones.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).collect()
    if short := [f"{r[group]} ({r.n})" for r in sizes if r.n < per_group]:
        raise ValueError(f"fewer than {per_group} rows: {', '.join(short)}")
    target = per_group * len(sizes)
    undivided = zeros.where(F.col(source).isin(whole)) if whole else zeros.limit(0)
    held = undivided.groupBy(source).agg(F.count("*").alias("n")).orderBy(source).collect()
    left = target - sum(r.n for r in held)
    if left < 0:
        raise ValueError(f"{target} rows are needed, whole sources hold more: {', '.join(f'{r[source]} ({r.n})' for r in held)}")
    rest = zeros.where(~F.coalesce(F.col(source).isin(whole), F.lit(False))) if whole else zeros
    quota = allocate(rest.groupBy(source).agg(F.count("*").alias("size")), source, "size", F.lit(left))
    quota = quota.select(F.col(source).alias("source_"), "share")
    some = ranked(rest, [source], key, seed).join(F.broadcast(quota), F.col(source).eqNullSafe(F.col("source_"))).where(F.col("draw") <= F.col("share")).drop("draw", "share", "source_")
    return draw(ones, group, part, key, F.lit(per_group), seed).unionByName(undivided).unionByName(some)


def seeded_n(df: DataFrame, group: list[str], key: str, n: int, seed: int = 1234) -> DataFrame:
    """`n` rows of each group by seed, with `place`, their order by key within the group: the order that they had before the draw."""
    drawn = ranked(df, group, key, seed).where(F.col("draw") <= n).drop("draw")
    return drawn.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(key)))  # n rows a group


def kfolds(df: DataFrame, stratum: list[str], key: str, k: int = 5, seed: int = 0) -> DataFrame:
    return ranked(df, stratum, key, seed).withColumn("fold", ((F.col("draw") - 1) % k).cast("int")).drop("draw")


def prefix_until(df: DataFrame, order: str, group: str, n: int, cap: int) -> DataFrame:
    """The shortest prefix of blocks, at most `cap`, after which every group has `n` rows: (group, block, enough)."""
    counts = df.groupBy(group, order).agg(F.count("*").alias("c"))
    running = counts.withColumn("have", F.sum("c").over(Window.partitionBy(group).orderBy(order)))
    return running.groupBy(group).agg(F.min(F.when(F.col("have") >= n, F.col(order))).alias("reached"), F.max("have").alias("total")).withColumn("taken", F.least(F.coalesce(F.col("reached"), F.lit(cap)), F.lit(cap)))
