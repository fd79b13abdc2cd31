"""Ranks with ties, rank statistics and curves, without a window over a whole table.

A global order over facts goes through the table of distinct values: values are dealt out by range, summed in
each range, and each range's offset is the sum of those before it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import corr
from .lineage import written


def running_counts(df: DataFrame, value: str, by: list[str], sums: dict[str, Column], following: str | None = None) -> DataFrame:
    """For each distinct (by, value): the sums over its rows, and over all smaller values (`<name>_below`); with `following`
    also the next larger value, null for the largest, in a column of that name.

    Values meet in ranges; a range's offset comes from a table with a row for each key and range. Values are written with
    the range they were dealt to, so both sides of the join see the same ranges whatever runs again."""
    counts = df.groupBy(*by, value).agg(*[c.alias(n) for n, c in sums.items()])
    counts = written(counts.repartitionByRange(*[F.col(c) for c in [*by, value]]).withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy(*by, "range").agg(F.min(value).alias("least"), *[F.sum(n).alias(f"{n}_t") for n in sums])
    ranges = Window.partitionBy(*(by or [F.lit(0)])).orderBy("range")  # a row for each key and range
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(*by, "range", F.lead("least").over(ranges).alias("beyond"), *[F.coalesce(F.sum(f"{n}_t").over(before), F.lit(0)).alias(f"{n}_o") for n in sums])
    after = [F.lead(value).over(Window.partitionBy("range", *by).orderBy(value)).alias("after")] if following else []
    counts = counts.select("*", *after, *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_in") for n in sums])
    joined = counts.join(F.broadcast(offsets), [*by, "range"])
    more = [F.coalesce("after", "beyond").alias(following)] if following else []
    return joined.select(*by, value, *sums, *[(F.col(f"{n}_in") + F.col(f"{n}_o")).alias(f"{n}_below") for n in sums], *more)


def positions(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with each row's place (from 1) in the order of the columns `order` within `by`; no task holds a whole group.

    Rows are dealt out by range and written with their range; a row's place is that in its range plus the rows of the ranges before."""
    rows = written(df.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("range_", F.spark_partition_id()), "positions")
    inside = F.row_number().over(Window.partitionBy("range_", *by).orderBy(*order))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and range
    offsets = rows.groupBy(*by, "range_").agg(F.count("*").alias("n_")).select(*[F.col(c).alias(f"key_{c}_") for c in by], F.col("range_").alias("key_range_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    on = F.col("range_") == F.col("key_range_")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"key_{c}_"))
    return rows.withColumn(name, inside).join(F.broadcast(offsets), on).withColumn(name, (F.col(name) + F.col("offset_")).cast("long")).select(*df.columns, name)


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, rank): the average rank of each distinct value; join it back on value."""
    c = running_counts(df, value, by, {"n": F.count("*")})
    return c.select(*by, value, (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank"))


def auroc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve of label 1 over label 0; ties count half."""
    c = running_counts(df, score, by, {"pos": F.sum(label), "neg": F.sum(1 - F.col(label))})
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    out = c.groupBy(*by).agg(wins.alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / F.greatest(F.lit(1), F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def with_ranks(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """`df` with average ranks within `by`, by windows: for tables of groups or of their pairs (see ranked_columns)."""
    out = df
    for c in columns:
        r = F.rank().over(Window.partitionBy(*by).orderBy(c))
        n = F.count("*").over(Window.partitionBy(*by, c))
        out = out.withColumn(f"rank_{c}", r + (n - 1) / 2)
    return out


def ranked_columns(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """`df` with average ranks within `by`, by a join with the ranks of each column's distinct values: for tables of facts."""
    out = df
    for c in columns:
        out = out.join(average_ranks(df.select(*by, c), c, by).withColumnRenamed("rank", f"rank_{c}"), [*by, c])
    return out


def spearman_matrix(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, a, b, rho) for each pair of columns, from ranks within `by`; rows with a null in one of them stay out."""
    ranks = ranked_columns(written(df.select(*by, *columns).dropna(subset=columns), "ranked"), columns, by)
    pairs = list(combinations(columns, 2))
    wide = ranks.groupBy(*by).agg(*[corr(f"rank_{a}", f"rank_{b}").alias(f"{a}~{b}") for a, b in pairs])
    long = wide.unpivot(by, [f"{a}~{b}" for a, b in pairs], "pair", "rho")
    return long.select(*by, F.split_part("pair", F.lit("~"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("~"), F.lit(2)).alias("b"), "rho")


def holm(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Step-down adjusted p values within `by`."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(p, *[c for c in df.columns if c not in (p, *by)]))
    out = df.withColumn("place", place).withColumn("m", F.count("*").over(w))
    return out.withColumn("holm", F.least(F.lit(1.0), F.max((F.col("m") - F.col("place") + 1) * F.col(p)).over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))).drop("place", "m")


def permuted(df: DataFrame, key: str, value: str, by: list[str], perms: int, seed: int = 0) -> DataFrame:
    """`df` for each permutation 1..perms, with `shuffled`: the values of `by` dealt anew to its keys by an md5 order.

    Meant for tables of groups (tens of rows), where the statistic factors through them."""
    slots = df.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    many = slots.select(*by, key, "slot", F.explode(F.sequence(F.lit(1), F.lit(perms))).alias("perm"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col(key).cast("string")))
    dealt = many.withColumn("from_slot", F.row_number().over(Window.partitionBy("perm", *by).orderBy(order, key)))
    values = slots.select(*by, F.col("slot").alias("from_slot"), F.col(value).alias("shuffled"))
    return dealt.join(values, [*by, "from_slot"]).select("perm", *by, key, "shuffled")


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, share of rows at most value) for each distinct value."""
    c = running_counts(df, value, by, {"n": F.count("*")})
    total = c.groupBy(*by).agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total), by).select(*by, value, ((F.col("n_below") + F.col("n")) / F.col("total")).alias("share"))


def dealt_out(rng: np.random.Generator, left: np.ndarray, rows: int) -> np.ndarray:
    """For each line of `left` (what is left of each group), how many of each group are among so many rows: a multivariate hypergeometric
    draw, group after group, for all lines at once."""
    out, rest, need = np.zeros_like(left), left.sum(axis=1), np.full(len(left), rows, left.dtype)
    for g in range(left.shape[1] - 1):
        rest = rest - left[:, g]
        out[:, g] = rng.hypergeometric(left[:, g], rest, need)
        need = need - out[:, g]
    out[:, -1] = need
    return out


def row_grain_null(df: DataFrame, group: str, value: str, perms: int, seed: int = 0, range_rows: int = 5000, many_rows: int = 1000) -> tuple[float, np.ndarray]:
    """The rank correlation of `group` (few distinct values, such as dates) and `value` over rows, and its null with the rows' values dealt
    anew, without a row for each permutation.

    Ranks with ties are those of distinct values. The statistic needs, of each group, the sum of the ranks that it gets. Ranks are cut
    into ranges of about `range_rows` rows; how many rows of a range each group gets is a multivariate hypergeometric draw for each
    permutation, on the driver: ranges x groups numbers, at most 256 ranges. Given these, ranges are independent, and each is a task: it deals
    its own ranks out and returns a sum for each permutation. Rows of one value have one rank, so of a value with many rows only the number
    that each group gets is drawn. Rows with a null in either stay out; a constant column gives NaN.
    Rows meet their ranks by value, so both columns are written first: a sum of doubles computed again can differ in its last bits."""
    spark, rows = df.sparkSession, written(df.select(group, value).dropna(), "rows")
    sizes = {r[0]: r[1] for r in rows.groupBy(group).count().orderBy(group).collect()}
    names, counts = list(sizes), np.array(list(sizes.values()), "int64")
    n = int(counts.sum())
    if not n:
        return float("nan"), np.full(perms, np.nan)
    group_rank = np.cumsum(counts) - counts + (counts + 1) / 2
    c = written(running_counts(rows.select(value), value, [], {"n": F.count("*")}).withColumn("rank", F.col("n_below") + (F.col("n") + 1) / 2), "ranks")
    per_range = max(range_rows, -(-n // 256))
    c = c.withColumn("part", F.floor(F.col("n_below") / per_range).cast("int"))
    totals = {r.part: (r.rows, r.sum, r.square) for r in c.groupBy("part").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("rank")).alias("sum"), F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("square")).collect()}
    mean = (n + 1) / 2
    spread = np.sqrt(float((counts * group_rank**2).sum() - n * mean**2)) * np.sqrt(max(0.0, sum(t[2] for t in totals.values()) - n * mean**2))
    seen = {r[0]: r[1] for r in rows.join(c.select(F.col(value).alias("v_"), "rank"), F.col(value) == F.col("v_")).groupBy(group).agg(F.sum("rank").alias("s")).collect()}
    rho = lambda weighted: (weighted - n * mean**2) / spread if spread > 0 else weighted * np.nan
    observed = rho(np.float64(sum(g * seen[k] for g, k in zip(group_rank.tolist(), names, strict=True))))
    rng, parts = np.random.default_rng([seed, n]), sorted(totals)
    given, left = np.zeros((len(parts), perms, len(names)), "int64"), np.tile(counts, (perms, 1))
    for j, part in enumerate(parts):
        given[j] = dealt_out(rng, left, totals[part][0])
        left = left - given[j]
    table = spark.createDataFrame([(part, given[j].tobytes()) for j, part in enumerate(parts)], "part int, given binary")

    def deal(values: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        part = int(draws["part"].iloc[0])
        left = np.frombuffer(draws["given"].iloc[0], "int64").reshape(perms, -1)
        own = values.sort_values("rank")
        rng, out, many = np.random.default_rng([seed, n, part]), np.zeros(perms), own["n"] >= many_rows
        for r in own[many].itertuples():
            of = dealt_out(rng, left, r.n)
            left = left - of
            out += r.rank * (of @ group_rank)
        ranks = np.repeat(own["rank"][~many].to_numpy(), own["n"][~many].to_numpy())
        for p in range(perms if len(ranks) else 0):
            dealt = np.repeat(group_rank, left[p])
            rng.shuffle(dealt)
            out[p] += dealt @ ranks
        return pd.DataFrame({"perm": np.arange(perms), "weighted": out})

    # a task a range: ranges are a few bytes for much work, and would be put together by their size
    sides = (side.repartition(len(parts), "part").groupBy("part") for side in (c.select("part", "rank", "n"), table))
    sums = next(sides).cogroup(next(sides)).applyInPandas(deal, "perm long, weighted double")
    null = np.zeros(perms)
    for r in sums.groupBy("perm").agg(F.sum("weighted").alias("w")).collect():
        null[r.perm] = r.w
    return float(observed), rho(null)
