"""Character n-gram language models: interpolated modified Kneser-Ney, counted, estimated and applied in Spark.

Tokens are code points, each for itself. Code point 1, repeated, begins a text. An n-gram of up to six tokens is two
longs of 21 bits a token: `lo` has its last three tokens, `hi` those before. All models share one vocabulary size,
over which the lowest order is uniform.

Counting sums in each task over blocks of text and then by shuffle. Estimation is joins of tables of n-grams,
each sharded by the n-gram: a lower order's counts are the numbers of distinct left neighbours, discounts come
from counts of counts, and each probability joins its context's sums and its suffix's probability. A model is a
table (order, hi, lo, logp, backoff): the log probability of a seen n-gram and the log weight of its backoff as
a context. Tables that led to a model are deleted.

Scoring joins the n-grams of the texts with the model. Texts are dealt by a hash into buckets of about `BUCKET_BYTES`,
compressed for the shuffle; a task lists the distinct n-grams of each. The distinct n-grams of all buckets look up their log probabilities and backoffs in
the model by joins, one n-gram a row; the results are joined to the lists and meet the texts of their bucket, where
the texts' sums are taken; there an n-gram is known by a 64-bit hash. An n-gram comes up once a bucket at most, so no key of a join is frequent, and no part of a
model passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, release, remove, row_hash, utf8_bytes

BITS = 21
HALF = 3  # tokens in a long
BEGIN = 1
VOCABULARY = 4096
CODE_POINTS = 0x110000
BUCKET_BYTES = 24_000_000
_CHUNK = 1 << 20
_MERGE = 4_000_000
_MASK = (1 << BITS) - 1


def _codes(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the texts, each after order - 1 begins; which n-grams end at a character of a text; and the lengths."""
    pad = chr(BEGIN) * (order - 1)
    n = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(pad + (t or "") for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = np.ones(len(codes), bool)
    begin = np.cumsum(n + order - 1) - n - (order - 1)
    for j in range(order - 1):
        keep[begin + j] = False
    return codes, keep[order - 1 :], n


def _packed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of n-grams given as the array of their first tokens, that of their second tokens and so on."""
    hi, lo = np.zeros(len(parts[0]), np.int64), np.zeros(len(parts[0]), np.int64)
    for j, part in enumerate(parts):
        to = hi if j < len(parts) - HALF else lo
        to <<= BITS
        to |= part
    return hi, lo


def encode(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams (hi, lo) of `order` tokens ending at each character of the texts, and the number of characters of each text."""
    codes, keep, n = _codes(texts, order)
    codes, size = codes.astype(np.int64), max(0, len(codes) - order + 1)
    hi, lo = _packed([codes[j : j + size] for j in range(order)])
    return hi[keep], lo[keep], n


def counted(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts and how often each comes up.

    N-grams are sorted as numbers to the base of how many code points these texts have, where those fit in 64 bits."""
    codes, keep, _ = _codes(texts, order)
    seen = np.zeros(CODE_POINTS, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    base, size = max(2, len(alphabet)), max(0, len(codes) - order + 1)
    if base**order >= 1 << 64:
        return distinct(*encode(texts, order)[:2])
    digit = np.zeros(CODE_POINTS, np.uint64)
    digit[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    digits, key = digit[codes], np.zeros(size, np.uint64)
    for j in range(order):
        key *= np.uint64(base)
        key += digits[j : j + size]
    key = np.sort(key[keep])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    c, key, parts = np.diff(np.append(first, len(key))), key[first], []
    for _ in range(order):
        key, part = np.divmod(key, np.uint64(base))
        parts.append(alphabet[part.astype(np.int64)] if len(part) else part.astype(np.int64))
    return *_packed(parts[::-1]), c


def mixed(hi: np.ndarray, lo: np.ndarray, turn: int) -> np.ndarray:
    """One number for each n-gram; `turn` chooses among several ways to mix."""
    a, b = np.uint64(0x9E3779B97F4A7C15 + 2 * turn), np.uint64(0xC2B2AE3D27D4EB4F + 6 * turn)
    x = hi.astype(np.uint64) * a + lo.astype(np.uint64) * b
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def hashed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The number that xxhash64(hi, lo) gives in Spark."""
    a, b, c, d, e = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of the hash
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(hi), 42, np.uint64)
    for x in (hi, lo):
        h = turned((h + e + np.uint64(8)) ^ (turned(x.astype(np.uint64) * b, 31) * a), 27) * a + d
        h = (h ^ (h >> np.uint64(33))) * b
        h = (h ^ (h >> np.uint64(29))) * c
        h ^= h >> np.uint64(32)
    return h


def distinct(hi: np.ndarray, lo: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams and how often each comes up (or the sum of `c`)."""
    if not len(hi):
        return hi, lo, np.zeros(0, np.int64)
    turn = 0
    while True:
        key = mixed(hi, lo, turn)
        by = np.argsort(key)
        key, a, b = key[by], hi[by], lo[by]
        new = key[1:] != key[:-1]
        if np.array_equal(new, (a[1:] != a[:-1]) | (b[1:] != b[:-1])):  # no two share a number
            first = np.flatnonzero(np.concatenate([[True], new]))
            return a[first], b[first], np.diff(np.append(first, len(key))) if c is None else np.add.reduceat(c[by], first)
        turn += 1


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in runs of about _CHUNK characters, with the place of the first."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t) if t else 0
        if size > _CHUNK:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


def _summed(texts: Iterator[list[str | None]], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct n-grams of the texts with counts, in parts of bounded size."""
    none = np.zeros(0, np.int64)
    held, rows = [(none, none, none)], 0
    for batch in texts:
        for _, part in chunks(batch):
            held.append(counted(part, order))
            rows += len(held[-1][0])
            if rows > _MERGE:
                held = [distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                rows = len(held[0][0])
                if rows > _MERGE // 2:
                    yield held[0]
                    held, rows = [(none, none, none)], 0
    yield distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))


def count(texts: DataFrame, text_col: str, order: int) -> DataFrame:
    """(hi, lo, c): how often each n-gram of `order` tokens ends at a character of the texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for hi, lo, c in _summed((b["t"].tolist() for b in batches), order):
            yield pd.DataFrame({"hi": hi, "lo": lo, "c": c})

    return texts.select(F.col(text_col).alias("t")).mapInPandas(counted, "hi long, lo long, c long").groupBy("hi", "lo").agg(F.sum("c").alias("c"))


def suffix(k: int) -> tuple[Column, Column]:
    """The last `k` tokens of an n-gram (hi, lo)."""
    low, high = min(k, HALF), max(0, k - HALF)
    return F.col("hi").bitwiseAND((1 << BITS * high) - 1), F.col("lo").bitwiseAND((1 << BITS * low) - 1)


def context(hi: Column, lo: Column) -> tuple[Column, Column]:
    """An n-gram without its last token."""
    return F.shiftright(hi, BITS), F.shiftright(lo, BITS).bitwiseOR(F.shiftleft(hi.bitwiseAND(_MASK), BITS * (HALF - 1)))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of 1, 2, and 3 or more."""
    n1, n2, n3, n4 = (max(1, x or 0) for x in counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first())
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def estimate(top: DataFrame, order: int, vocabulary: int = VOCABULARY) -> DataFrame:
    """The model of the counts of order `order`: (order, hi, lo, logp, backoff)."""
    counts = {order: materialize(top, "counts")}
    for k in range(order - 1, 0, -1):  # each distinct (k + 1)-gram is a left neighbour of its last k tokens
        hi, lo = suffix(k)
        counts[k] = materialize(counts[k + 1].groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("c")), "counts")
    lower, model, probabilities = None, None, []
    for k in range(1, order + 1):
        d = discounts(counts[k])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        c_hi, c_lo = context(F.col("hi"), F.col("lo"))
        of = counts[k].withColumns({"c_hi": c_hi, "c_lo": c_lo})
        sums = of.groupBy("c_hi", "c_lo").agg(F.sum("c").alias("total"), F.sum(off).alias("freed"))
        joined = of.join(sums, ["c_hi", "c_lo"]).withColumn("weight", F.col("freed") / F.col("total"))
        below = F.lit(1.0 / vocabulary)
        if lower is not None:
            s_hi, s_lo = suffix(k - 1)
            joined = joined.withColumns({"s_hi": s_hi, "s_lo": s_lo}).join(lower.select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), F.col("p").alias("below")), ["s_hi", "s_lo"])
            below = F.col("below")
        p = materialize(joined.select("hi", "lo", ((F.col("c") - off) / F.col("total") + F.col("weight") * below).alias("p")), "probabilities")
        rows = p.select(F.lit(k).alias("order"), "hi", "lo", F.log("p").alias("logp"))
        contexts = sums.select(F.lit(k - 1).alias("order"), F.col("c_hi").alias("hi"), F.col("c_lo").alias("lo"), F.log(F.col("freed") / F.col("total")).alias("backoff"))
        part = rows.withColumn("backoff", F.lit(None).cast("double")).unionByName(contexts.withColumn("logp", F.lit(None).cast("double")))
        model = part if model is None else model.unionByName(part)
        lower = p
        probabilities.append(p)
    model = materialize(model.groupBy("order", "hi", "lo").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff")), "model")
    remove(top.sparkSession, *counts.values(), *probabilities)
    release(top.sparkSession)
    return model


def looked_up(grams: DataFrame, model: DataFrame, name: str, order: int, vocabulary: int) -> DataFrame:
    """`grams` (hi, lo, ...) with the log probability of the last token of each: that of its longest suffix seen, with
    the backoff weights of the contexts left behind. A context never seen weighs 1."""
    out = grams.withColumns({"sum_": F.lit(0.0), "done_": F.lit(False)})
    for k in range(order, 0, -1):
        hi, lo = suffix(k)
        c_hi, c_lo = context(hi, lo)
        seen = model.where((F.col("order") == k) & F.col("logp").isNotNull()).select(F.col("hi").alias("k_hi"), F.col("lo").alias("k_lo"), "logp")
        left = model.where((F.col("order") == k - 1) & F.col("backoff").isNotNull()).select(F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), "backoff")
        out = out.withColumns({"k_hi": hi, "k_lo": lo, "c_hi": c_hi, "c_lo": c_lo}).join(seen, ["k_hi", "k_lo"], "left").join(left, ["c_hi", "c_lo"], "left")
        add = F.when(F.col("done_"), 0.0).otherwise(F.coalesce("logp", "backoff", F.lit(0.0)))
        out = out.withColumns({"sum_": F.col("sum_") + add, "done_": F.col("done_") | F.col("logp").isNotNull()}).select(*grams.columns, "sum_", "done_")
    return out.select(*grams.columns, (F.col("sum_") - F.when(F.col("done_"), 0.0).otherwise(math.log(vocabulary))).alias(name))


def score(docs: DataFrame, text_col: str, models: dict[str, DataFrame], order: int, bucket_bytes: int = BUCKET_BYTES, vocabulary: int = VOCABULARY) -> DataFrame:
    """`docs` with n_tokens and, for each model, its sum of log probabilities over all characters of the text; these replace
    input columns of their names."""
    spark, names = docs.sparkSession, list(models)
    buckets = max(1, -(-(docs.agg(F.sum(utf8_bytes(F.col(text_col)))).first()[0] or 0) // bucket_bytes))
    bucket = free_name(docs, "bucket")
    of_bucket = F.pmod(row_hash(docs), F.lit(buckets)).alias(bucket)

    def listed(texts: pa.Table) -> pa.Table:
        at = texts.column("bucket")[0].as_py()
        parts = list(_summed((unpacked(p).column(text_col).to_pylist() for p in texts.column("payload")), order))
        hi, lo, _ = distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        by = np.lexsort((lo, hi))  # in order, they take less room
        return pa.table({"bucket": pa.array(np.full(len(hi), at, np.int64)), "hi": hi[by], "lo": lo[by]})

    texts = packed(docs.select(text_col, of_bucket).where(F.length(text_col) > 0), bucket)
    lists = materialize(texts.groupBy("bucket").applyInArrow(listed, "bucket long, hi long, lo long"), "grams")
    release(spark)  # the texts' shuffle has done its work
    found = lists.select("hi", "lo").distinct()
    for name in names:
        before, found = found, materialize(looked_up(found, models[name], name, order, vocabulary), "looked_up")
        if name != names[0]:
            remove(spark, before)
    release(spark)
    rows = lists.join(found, ["hi", "lo"]).select("bucket", F.xxhash64("hi", "lo").alias("key"), *[F.col(name).cast("float").alias(name) for name in names])
    rows = materialize(rows, "values")
    remove(spark, lists, found)
    release(spark)
    out = docs.withColumn("n_tokens", F.coalesce(F.length(text_col), F.lit(0)).cast("long")).withColumns({name: F.lit(0.0) for name in names})

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        return _sums(pa.concat_tables([unpacked(p) for p in left.column("payload")]).drop_columns([bucket]), right, text_col, names, order)

    texts = packed(out.select(*out.columns, of_bucket), bucket)
    return texts.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(summed, out.schema)


def packed(rows: DataFrame, bucket: str) -> DataFrame:
    """(bucket, payload): the rows of each batch and bucket as one compressed block, half as large in a shuffle as the rows themselves."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.schema.get_field_index(bucket)).to_numpy()
            by = np.argsort(key, kind="stable")
            rows, key = pa.Table.from_batches([batch]).take(by), key[by]
            edges = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *edges], [*edges, len(key)], strict=True):
                if a < b:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                        to.write_table(rows.slice(a, b - a).combine_chunks())
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(key[a])], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return rows.mapInArrow(blocks, "bucket long, payload binary")


def unpacked(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_py()).read_all()


class Table:
    """Where each of some distinct numbers is: hashed to four times as many places, those whose place is taken again in a next table."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.levels = numbers, []
        left = np.arange(len(numbers), dtype=np.int32)
        while len(left):
            table = np.full(1 << (4 * len(left)).bit_length(), -1, np.int32)
            place = self._place(numbers[left], len(table))
            table[place] = left
            self.levels.append(table)
            left = left[table[place] != left]

    def _place(self, numbers: np.ndarray, size: int) -> np.ndarray:
        shift = np.uint64(64 - size.bit_length() + 1)
        return ((numbers * np.uint64(0x9E3779B97F4A7C15 + 2 * (len(bin(size)) << 20))) >> shift).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each of `numbers`, all of which are in the table."""
        out, todo = np.zeros(len(numbers), np.int64), np.arange(len(numbers))
        for table in self.levels:
            at = table[self._place(numbers[todo], len(table))]
            ok = self.numbers[at] == numbers[todo]
            out[todo[ok]] = at[ok]
            todo = todo[~ok]
        return out


def _sums(docs: pa.Table, grams: pa.Table, text_col: str, names: list[str], order: int) -> pa.Table:
    known, values = Table(grams.column("key").to_numpy().view(np.uint64)), [grams.column(n).to_numpy().astype(float) for n in names]
    texts = docs.column(text_col).to_pylist()
    sums = np.zeros((len(names), len(texts)))
    for at, part in chunks(texts):
        *gram, lengths = encode(part, order)
        where = known.find(hashed(*gram))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        for j, v in enumerate(values):
            sums[j, at : at + len(part)] = np.diff(np.concatenate([[0], np.cumsum(v[where])])[bounds])
    for j, n in enumerate(names):
        docs = docs.set_column(docs.schema.get_field_index(n), n, pa.array(sums[j]))
    return docs
