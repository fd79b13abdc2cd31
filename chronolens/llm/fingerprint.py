"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions alone.

A paragraph is a line with something other than white space, trimmed; its digest is a 64-bit hash. A document is
the set of its paragraphs' digests. A sketch has three subtables; a digest falls into one cell of each. A cell
holds how many digests fell into it, their exclusive or, and the exclusive or of a check hash of each. A fingerprint
is the sketch as a string: for each cell in use, in order, its number, count, digest and check, all in hex.

Sketches of two versions subtract cell by cell, which leaves only the digests that differ. Peeling then takes
one subtable at a time: a cell of count 1 or -1 whose check fits its digest gives that digest away, which
leaves its other two cells. A pair of versions whose cells don't all empty in `ROUNDS` rounds has failed and is
tried again with sketches `GROWTH` times as large, until none is left; a pair that fails even with 64 cells a digest
(digests that agree in all cells) is compared digest by digest. Within one subtable no digest is in
two cells, so a round never removes a digest twice. Each round is an explode and an aggregation on pair and cell:
small sketches are dealt out by pair and peel without a shuffle for a few rounds, in partitions sized by their cells, and are
written then (see peeled_wholly); those of `WIDE` cells and more are dealt out by cell in each round, so that one long document is
the work of many tasks.

Likeness is the Jaccard likeness of the two sets, from the sketches alone: the counts of a subtable add up to the size
of a set, and peeling gives the digests on either side. Two empty sets are alike (1.0); an empty set and another aren't (0.0).

Edge cases of the query: null text is the empty text, whose fingerprint is the empty string; very long texts are
sketched and compared whole. Rows are in order of doc_id (a whole number), nulls first, and rows of equal
doc_id in order of a hash of the text; repeated rows are rows of their own, so a copy's next may be its copy.
The last row's next is the first. A table of one document is its own next. An empty table gives an empty result.
Columns beside doc_id and text are left aside.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialize, release, remove, table

CELLS = 8
GROWTH = 8
ROUNDS = 5
STAGE_STEPS = 3  # aggregations in one stage: a task is promised memory for about four to eight of them
SUBTABLES = 3
WIDE = 4096
CELL_ROWS = 250_000
BUCKET_BYTES = 16 << 20
SPANS = 4096
SKETCH = "array<struct<cell:bigint,n:bigint,x:bigint,c:bigint>>"


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def check(digest: Column) -> Column:
    return F.xxhash64(F.lit(77), digest)


def place(digest: Column, subtable: int, cells: int) -> Column:
    """The cell of a digest in a subtable, numbered through all subtables."""
    return F.pmod(F.xxhash64(F.lit(subtable), digest), F.lit(cells).cast("long")) + F.lit(subtable * cells).cast("long")


def _sum(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "cell", "found").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))


def cells_of(df: DataFrame, keys: list[str], digests: str, cells: int = CELLS) -> DataFrame:
    """A row (keys, cell, n, x, c) for each cell in use of the sketch of each row's `digests`; keys identify rows."""
    d, none = F.col("d"), F.lit(None).cast("long")
    spread = F.array(*[F.struct(place(d, j, cells).alias("cell"), none.alias("found"), F.lit(1).cast("long").alias("n"), d.alias("x"), check(d).alias("c")) for j in range(SUBTABLES)])
    return _sum(df.select(*keys, F.explode(digests).alias("d")).select(*keys, F.inline(spread)), keys).drop("found")


def packed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sketch): the cells of each sketch as an array in order of the cell; an empty set has no row."""
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "n", "x", "c"))).alias("sketch"))


def serialized(sketch: Column) -> Column:
    """A sketch as a string, cells divided by `;` and their numbers by `:`, so that no two sketches share one."""
    part = lambda s: F.concat_ws(":", *[F.lower(F.hex(s[c])) for c in ("cell", "n", "x", "c")])
    return F.array_join(F.transform(sketch, part), ";")


def size_of(sketch: Column, cells: int = CELLS) -> Column:
    """How many digests a sketch holds: each is in one cell of the first subtable."""
    return F.aggregate(F.filter(sketch, lambda s: s["cell"] < cells), F.lit(0).cast("long"), lambda a, s: a + s["n"])


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, cell, found, n, x, c) of the sketches `a` minus those of `b`, both as rows of cells; cells that empty stay out."""
    both = a.select(*keys, "cell", "n", "x", "c").unionByName(b.select(*keys, "cell", (-F.col("n")).alias("n"), "x", "c"))
    return _sum(both.withColumn("found", F.lit(None).cast("long")), keys).where("n <> 0 OR x <> 0 OR c <> 0")


def peel(df: DataFrame, keys: list[str], cells: int, steps: range) -> DataFrame:
    """Cells after some steps of peeling, a subtable a step in turn: rows with `found` hold a digest recovered, n tells its side (1 or -1);
    other rows are cells that didn't empty. A step is one aggregation."""
    for r in steps:
        j = r % SUBTABLES
        pure = F.col("found").isNull() & F.col("cell").between(j * cells, (j + 1) * cells - 1) & (F.abs("n") == 1) & (F.col("c") == check(F.col("x"))) & (F.col("cell") == place(F.col("x"), j, cells))
        struct = lambda cell, found, n, x, c: F.struct(cell.cast("long").alias("cell"), found.alias("found"), n.alias("n"), x.alias("x"), c.alias("c"))
        none = F.lit(None).cast("long")
        out = [struct(place(F.col("x"), i, cells), none, -F.col("n"), F.col("x"), F.col("c")) for i in range(SUBTABLES) if i != j]
        peeled = F.array(struct(F.lit(-1), F.col("x"), F.col("n"), F.lit(0).cast("long"), F.lit(0).cast("long")), *out)
        kept = F.array(struct(F.col("cell"), F.col("found"), F.col("n"), F.col("x"), F.col("c")))
        df = _sum(df.select(*keys, F.inline(F.when(pure, peeled).otherwise(kept))), keys).where("found IS NOT NULL OR n <> 0 OR x <> 0 OR c <> 0")
    return df


def peeled_wholly(difference: DataFrame, keys: list[str], cells: int, rounds: int = ROUNDS) -> DataFrame:
    """(keys, found, n): the digests recovered from each pair's difference, and rows without `found` for cells that didn't empty.

    Each round is a job of its own, so that a stage holds few aggregations at once however many rounds there are, and needs as few
    pages of a task's memory. What a round recovered is set aside, and the next goes on with the cells of those pairs that it
    recovered something of: the others are stuck, and those without cells are done."""
    spark, live, parts, stuck, begin = difference.sparkSession, difference, [], [], 0
    for end in range(1, rounds * SUBTABLES + STAGE_STEPS, STAGE_STEPS):  # the first stage makes the cells and subtracts them, too
        now = materialize(peel(live, keys, cells, range(begin, end)), "peeling")
        found, rest = now.where("found IS NOT NULL AND n <> 0"), now.where("found IS NULL")
        parts.append(found.select(*keys, "found", "n"))
        if rest.isEmpty():
            break
        if begin:  # all subtables had their turn
            moved = found.select(*keys).distinct()
            stuck.append(rest.join(moved, keys, "left_anti").select(*keys).distinct())
            rest = rest.join(moved, keys, "left_semi")
        live, begin = rest, end
    else:
        stuck.append(live.select(*keys).distinct())
    release(spark)
    none = F.lit(None).cast("long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    for part in stuck:
        out = out.unionByName(part.select(*keys, none.alias("found"), none.alias("n")))
    return out.groupBy(*keys, "found").agg(F.sum("n").alias("n")).where("found IS NULL OR n <> 0")


def tally(peeled: DataFrame, keys: list[str]) -> DataFrame:
    """For each pair: a_only and b_only, the numbers of digests recovered on either side, and left, the cells that didn't empty."""
    of_side = lambda s: F.count_if(F.col("found").isNotNull() & (F.col("n") == s)).alias("a_only" if s > 0 else "b_only")
    return peeled.groupBy(*keys).agg(of_side(1), of_side(-1), F.count_if(F.col("found").isNull()).alias("left"))


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """`df` in partitions by `keys`, of about CELL_ROWS of the `rows` rows that it is going to have."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // CELL_ROWS)), *keys)


def differences(pairs: DataFrame, keys: list[str], a: str, b: str, a_sketch: str | None = None, b_sketch: str | None = None, cells: int = CELLS, growth: int = GROWTH) -> DataFrame:
    """For each row of `pairs` (keys identify it; a and b are sets of digests): a_only and b_only, from the smallest
    sketches that peel wholly. The first are taken from the columns a_sketch and b_sketch, where given.

    Retries are written to the shared folder, so each works on what failed before and on nothing else. Tables that the peeling
    wrote are deleted once they are counted."""
    spark, todo, done, given, retry = pairs.sparkSession, pairs, None, a_sketch is not None, None
    while True:
        sizes = [F.size(c) for c in (a_sketch, b_sketch)] if given else [SUBTABLES * F.size(c) for c in (a, b)]
        rows, largest = todo.agg(F.sum(sizes[0] + sizes[1]), F.max(F.greatest(F.size(a), F.size(b)))).first()
        if cells > 64 * max(CELLS, largest or 0):
            last = todo.select(*keys, *[F.size(F.array_except(x, y)).cast("long").alias(n) for x, y, n in ((a, b, "a_only"), (b, a, "b_only"))])
            return last if done is None else done.unionByName(last)
        todo = dealt(todo, keys, rows or 0) if cells * SUBTABLES < WIDE else todo
        if given:
            sides = [todo.select(*keys, F.inline(c)) for c in (a_sketch, b_sketch)]
        else:
            sides = [cells_of(todo, keys, c, cells) for c in (a, b)]
        counts = tally(peeled_wholly(subtract(*sides, keys), keys, cells), keys)
        tried = materialize(todo.select(*keys).join(counts, keys, "left").fillna(0, ["a_only", "b_only", "left"]), "peeled")
        remove(spark, counts, *([retry] if retry is not None else []))  # what peeling wrote
        release(spark)
        good = tried.where("left = 0").drop("left")
        done = good if done is None else done.unionByName(good)
        bad = tried.where("left > 0").select(*keys)
        if bad.isEmpty():
            return done
        retry = materialize(pairs.select(*keys, a, b).join(bad, keys, "left_semi"), "retry")
        todo, cells, given = retry, cells * growth, False


def likeness(a_size: Column, b_size: Column, a_only: Column, b_only: Column) -> Column:
    same = (a_size - a_only).cast("double")
    return F.when(a_size + b_size == 0, F.lit(1.0)).otherwise(same / (same + a_only + b_only))


def with_next(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`docs` with next_text, the text of the next row in order of (id, hash of the text), the first after the last.

    Rows go to buckets of ascending ids of about `bucket_bytes` of text: approximate quantiles of the id, each cut
    into equal ranges. Null ids, which come first, and an id that holds two quantiles are cut by the hash. A row finds
    its next in its bucket; the last of a bucket finds it in a table of the first row of each bucket. The text is
    shuffled once. next_text replaces an input column of that name."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "next_text"])
    h, bucket, ahead, last = (free_name(docs, c) for c in ("h", "bucket", "ahead", "last"))
    i, text = F.col(id_col), F.col(text_col)
    total, least, most = docs.agg(F.sum(F.octet_length(text)), F.min(i), F.max(i)).first()
    found = [int(c) for c in docs.select(id_col).where(i.isNotNull()).approxQuantile(id_col, [k / 64 for k in range(1, 64)], 0.005)] if most is not None else []
    hot = [c for c, n in Counter(found).items() if n > 1]
    cuts = sorted({*found, *[c + 1 for c in hot]})
    lows, highs = [least or 0, *cuts], [*cuts, (most or 0) + 1]
    parts = min(SPANS, max(1, -(-(total or 0) // (bucket_bytes * min(len(lows), 64)))))
    longs = lambda x: F.array(*[F.lit(c).cast("long") for c in x]) if x else F.array().cast("array<long>")
    at = F.size(F.filter(longs(cuts), lambda c: c <= i))
    low, high = (F.element_at(longs(x), at + 1) for x in (lows, highs))
    by_id = F.least(F.lit(parts - 1), F.floor((i - low) / F.greatest(F.lit(1), high - low) * parts))
    by_hash = F.shiftright(F.col(h), 52) + SPANS // 2  # in the order of the hash
    within = F.when(i.isNull() | F.array_contains(longs(hot), i.cast("long")), by_hash).otherwise(by_id).cast("long")
    rows = docs.withColumn(h, F.xxhash64(text)).withColumn(bucket, F.when(i.isNull(), F.lit(0)).otherwise(at + 1).cast("long") * SPANS + within)
    place = F.struct(F.coalesce(i, F.lit(0)).alias("i"), F.col(h).alias("h"))
    first = materialize(rows.groupBy(F.col(bucket).alias("b")).agg(F.min_by(text, place).alias("first_text")), "firsts")
    # The bucket after each: the next of its span, or the first of the next span; spans are a few dozen.
    numbers = first.select("b", F.floor(F.col("b") / SPANS).alias("span"))
    heads = numbers.groupBy("span").agg(F.min("b").alias("head"))
    heads = heads.select("span", F.coalesce(F.lead("head").over(Window.orderBy("span")), F.min("head").over(Window.partitionBy())).alias("head"))
    after = numbers.withColumn("a", F.lead("b").over(Window.partitionBy("span").orderBy("b"))).join(heads, "span").select(F.coalesce("a", "head").alias("a"), F.col("b").alias(last))
    after = after.join(first.withColumnRenamed("b", "a"), "a").select(last, "first_text")
    w = Window.partitionBy(bucket).orderBy(i.asc_nulls_first(), h)
    rows = rows.withColumn(ahead, F.lead(F.struct(text.alias("t"))).over(w))
    out = rows.join(after, (F.col(bucket) == F.col(last)) & F.col(ahead).isNull(), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col(ahead).isNull(), F.col("first_text")).otherwise(F.col(ahead)["t"]).alias("next_text"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.expr("CAST(length(text) DIV 2 AS INT)")
    rows = with_next(docs, "doc_id", "text").withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[paragraphs(F.col(c)).alias(v) for c, v in (("text", "own"), ("edited", "edited"), ("next_text", "next"))])
    rows = digests = materialize(rows.withColumn("k", F.monotonically_increasing_id()), "digests")
    release(spark)  # the texts' shuffle: digests are all that is read from here on
    sets = ["own", "edited", "next"]
    total = rows.agg(F.sum(sum((F.size(c) for c in sets), F.lit(0)))).first()[0] or 0
    versions = dealt(rows.select("k", *sets), ["k"], SUBTABLES * total).select("k", F.inline(F.array(*[F.struct(F.lit(v).alias("v"), F.col(v).alias("set")) for v in sets])))
    sketches = packed(cells_of(versions, ["k", "v"], "set"), ["k", "v"]).groupBy("k").agg(*[F.max(F.when(F.col("v") == v, F.col("sketch"))).alias(f"{v}_sketch") for v in sets])
    none = F.array().cast(SKETCH)
    rows = rows.join(sketches, "k", "left").withColumns({f"{v}_sketch": F.coalesce(f"{v}_sketch", none) for v in sets})
    rows = materialize(rows, "sketches")
    remove(spark, digests)
    del digests, versions, sketches
    release(spark)
    pairs = rows.select("k", "own", "own_sketch", F.inline(F.array(*[F.struct(F.lit(v).alias("p"), F.col(v).alias("other"), F.col(f"{v}_sketch").alias("other_sketch")) for v in sets[1:]])))
    near = differences(pairs, ["k", "p"], "own", "other", "own_sketch", "other_sketch").groupBy("k").agg(*[F.max(F.when(F.col("p") == v, F.struct("a_only", "b_only"))).alias(f"d_{v}") for v in sets[1:]])
    size = {v: size_of(F.col(f"{v}_sketch")) for v in sets}
    like = lambda v: likeness(size["own"], size[v], F.col(f"d_{v}.a_only"), F.col(f"d_{v}.b_only"))
    return rows.join(near, "k").select(
        "doc_id", "n_chars", "edited_sha256", serialized(F.col("own_sketch")).alias("fingerprint"), serialized(F.col("edited_sketch")).alias("edited_fingerprint"),
        like("edited").alias("near_edited"), like("next").alias("near_next"),
    )
