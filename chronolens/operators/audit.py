"""Integrity and audit operators. Each returns a table of violations or findings; `require` raises on violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raise with the first few violations if there are any."""
    if found := violations.limit(show).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def first_offenders(violations: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return violations.orderBy(*order).limit(n)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`left` with the columns of `right`, after checking that the key is unique on both sides."""
    for df, side in ((left, "left"), (right, "right")):
        require(duplicate_keys(df, key), f"{side} key {key} repeats")
    return left.join(right, key, "left")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: how many rows lack it."""
    wide = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot("n_rows", columns, "column", "n_missing")


def spread(df: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """Sample standard deviation of each column, and whether the distribution is degenerate."""
    return df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).unpivot([], columns, "column", "std").withColumn("degenerate", F.coalesce(F.col("std") <= least, F.lit(True)))


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).groupBy(column).agg(F.count("*").alias("n_rows"))


def coverage(df: DataFrame, group: str, side: str, sides: list[str]) -> DataFrame:
    """Rows of each group on each side, and whether the group is on all sides."""
    counts = df.groupBy(group).agg(*[F.count_if(F.col(side) == s).alias(f"n_{s}") for s in sides])
    return counts.withColumn("covered", F.least(*[F.col(f"n_{s}") for s in sides]) > 0)


def not_in_dimension(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return fact.where(F.col(key).isNotNull()).join(dimension, key, "left_anti").groupBy(key).agg(F.count("*").alias("n_rows"))


def collisions(df: DataFrame, derived: Column, name: str) -> DataFrame:
    """All rows whose derived key another row has too. Keys are counted first, so a frequent one is no task of its own."""
    rows = df.withColumn(name, derived)
    often = rows.groupBy(F.col(name).alias("same_key_")).agg(F.count("*").alias("n_same")).where("n_same > 1")
    return rows.join(often, F.col(name).eqNullSafe(F.col("same_key_"))).drop("same_key_")


def provenance(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A fingerprint of the table that doesn't depend on the order of rows: rows, and sums of parts of each row's md5."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in [key, *columns]]))
    part = lambda a: F.sum(F.conv(F.substring(row, a, 7), 16, 10).cast("long"))
    return df.agg(F.count("*").alias("n_rows"), part(1).alias("h1"), part(8).alias("h2"), part(15).alias("h3"))


def recorded_as(df: DataFrame, key: str, columns: list[str], scored: list[str], recorded: DataFrame) -> DataFrame:
    """For each recorded fingerprint (name, n_rows, h1, h2, h3) what of the table it matches: `whole` (all `columns`), `subset` (the
    columns `scored`, if others were added since), or `neither`: then the table changed under what was recorded."""
    both = [provenance(df, key, c).select(F.lit(kind).alias("kind"), "n_rows", "h1", "h2", "h3") for kind, c in (("whole", columns), ("subset", scored))]
    match = recorded.join(F.broadcast(both[0].unionByName(both[1])), ["n_rows", "h1", "h2", "h3"], "left")
    return match.groupBy("name").agg(F.coalesce(F.max("kind"), F.lit("neither")).alias("matches"))


def value_parity(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values that only one side has."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def missing_shards(done: DataFrame, shard: str, n: int) -> DataFrame:
    return done.sparkSession.range(n).select(F.col("id").alias(shard)).join(done, shard, "left_anti")


def single_valued(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "n_values").withColumn("single", F.col("n_values") == 1)


def same_sequence(left: DataFrame, right: DataFrame, position: str, key: str) -> DataFrame:
    """Positions at which two tables hold different keys."""
    a, b = left.select(position, F.col(key).alias("left_key")), right.select(position, F.col(key).alias("right_key"))
    return a.join(b, position, "full_outer").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def short_strata(df: DataFrame, stratum: str, least: int) -> DataFrame:
    return df.groupBy(stratum).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") < least)


def fractions(df: DataFrame, group: str, side: str, of: str, share: float) -> DataFrame:
    """Rows of each group, the share of them on one side, and whether it is `share` to the row."""
    n = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(side) == of).alias("n_of"))
    return n.select(group, "n", (F.col("n_of") / F.col("n")).alias("share"), (F.abs(F.col("n_of") - share * F.col("n")) <= 0.5).alias("exact"))


def with_missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`left` with those columns of `right` that it lacks, by a key unique in `right`."""
    more = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(key, *more), key, "left")


def drift(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Entries of two (key, value) records that differ."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    return a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def balanced_groups(groups: DataFrame, group: str, date: str, n: str) -> DataFrame:
    """Whether all groups of a class have the same size, and whether dates strictly increase within it."""
    before = F.lag(date).over(Window.partitionBy(group).orderBy(date))
    return groups.withColumn("gap", F.datediff(date, before)).groupBy(group).agg((F.min(n) == F.max(n)).alias("equal_sizes"), F.coalesce(F.min("gap") > 0, F.lit(True)).alias("increasing"))


def finite(column: str) -> Column:
    """Whether a vector has no NaN and no infinity."""
    return F.forall(column, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def psnr(a: Column, b: Column) -> Column:
    """10 log10(255 ** 2 / mse) of two arrays; infinite when they are equal."""
    mse = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / mse))


def geometry_drift(df: DataFrame) -> DataFrame:
    """Rows whose recorded box doesn't fit in the measured size."""
    return df.where((F.col("crop_left") + F.col("crop_width") > F.col("source_width")) | (F.col("crop_top") + F.col("crop_height") > F.col("source_height")) | (F.col("crop_left") < 0) | (F.col("crop_top") < 0))
