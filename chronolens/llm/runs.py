"""Periodic runs of words by recompression.

The words of a bounded number of documents become one sequence of numbers with a number of its own after each document. A
run-length grammar is built over it, level by level: block compression names each maximal block of one symbol, pair
compression deals the symbols to two sides by a hash and names each pair that goes from one side to the other. Both look at
symbols alone, so equal stretches are parsed alike but for their ends, and names are exact: equal pairs share one, others don't.

How far two places agree (the longest common extension) is read off the grammar: climb while both places begin a symbol of
the next level, after at most one step inside a level; from the first difference go down again, one step a level at most. The
other direction reads the mirrored levels. All pairs of places climb and descend together, as arrays.

Candidates come from a harmonic grid: a run of period p and at least max(min_words, repeats * p) words holds that many less p
consecutive places which agree with the place p further on, so for each p a grid of that spacing can't miss it. Over all p
that is about n log n / 2 places for n words. Those that agree in one word are extended both ways exactly. Stretches are maximal
then; of equal stretches the smallest period stays, which is the period of the run.

Words are what lies between the bytes 0x20 and 0x09-0x0D. A word is dropped if it lies in any run after that run's first period.

Edge cases: null text has no words, no runs, and its collapsed text is empty; so has one without words. Very long texts are
taken whole, as a sequence of their own. Repeated rows are rows of their own, with equal results. An empty table gives an empty
result. Columns of the input pass through; n_words, runs and collapsed replace input columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MIN_WORDS = 24
REPEATS = 3
SEQUENCE_WORDS = 250_000
RESULTS = ("n_words", "runs", "collapsed")
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
WORD = r"[^\x20\x09-\x0D]+"


class Level:
    """A level of the grammar: its symbols, and for the next one the parent of each symbol and the first child of each parent.

    Each array has one more place for the end of the sequence, whose symbol is like no other."""

    def __init__(self, sym: np.ndarray, first: np.ndarray | None = None, blocks: bool = False):
        self.n, self.blocks, self.first = len(sym), blocks, first
        self.sym = np.append(sym, -1)
        if first is not None:
            begins = np.zeros(self.n + 1, "int64")
            begins[first] = 1
            self.up = np.cumsum(begins) - 1

    def mirrored(self) -> Level:
        return Level(self.sym[:-1][::-1], None if self.first is None else self.n - self.first[::-1], self.blocks)


def grammar(sym: np.ndarray) -> list[Level]:
    """The levels over `sym`, whose numbers begin at 0; the last has one symbol."""
    levels, fresh, seed = [], int(sym.max()) + 1 if len(sym) else 0, 0
    while len(sym) > 1:
        heads = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
        if len(heads) < len(sym):
            first = np.append(heads, len(sym))
            length, base = np.diff(first), sym[heads]
            levels.append(Level(sym, first, blocks=True))
            sym, long = base.copy(), length > 1
            names, _ = pd.factorize(base[long] << 32 | length[long])
            sym[long] = names + fresh
            fresh += int(names.max()) + 1
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
        seed += 1
        side = (sym.astype("uint64") * odd) >> np.uint64(41) & np.uint64(1)
        step = np.diff(side.astype("int8"))
        way = 1 if np.count_nonzero(step == 1) >= np.count_nonzero(step == -1) else -1
        pair = np.flatnonzero(step == way)
        if not len(pair):
            continue
        names, _ = pd.factorize(sym[pair] << 32 | sym[pair + 1])
        keep = np.ones(len(sym), bool)
        keep[pair + 1] = False
        first = np.append(np.flatnonzero(keep), len(sym))
        levels.append(Level(sym, first))
        sym = sym.copy()
        sym[pair] = names + fresh
        sym, fresh = sym[keep], fresh + int(names.max()) + 1
    return [*levels, Level(sym)]


def extension(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from a and from b on agree, for places a < b (b may be the end)."""
    out, at = np.zeros(len(a), "int64"), np.arange(len(a))
    start, stopped = a, []
    for level in levels:  # climb
        if level.first is None:
            stopped.append((at, a, b))
            break
        inside = (level.first[level.up[a]] != a) | (level.first[level.up[b]] != b)
        equal = level.sym[a] == level.sym[b]
        go = inside & equal
        if level.blocks:
            ends = np.minimum(level.up + 1, len(level.first) - 1)
            left = [level.first[ends[x[go]]] - x[go] for x in (a, b)]
            step, on = np.zeros(len(a), "int64"), ~inside
            step[go] = np.minimum(*left)
            on[go] = left[0] == left[1]
        else:
            step, on = go.astype("int64"), ~inside | equal
        a, b = a + step, b + step
        stopped.append((at[~on], a[~on], b[~on]))
        at, a, b = at[on], level.up[a[on]], level.up[b[on]]
    at, a, b = stopped.pop()
    for level, (more, c, d) in zip(levels[len(stopped) - 1 :: -1] if stopped else [], stopped[::-1], strict=True):  # descend
        a, b = level.first[a], level.first[b]
        equal = level.sym[a] == level.sym[b]
        if level.blocks:
            step, ends = np.zeros(len(a), "int64"), np.minimum(level.up + 1, len(level.first) - 1)
            step[equal] = np.minimum(*[level.first[ends[x[equal]]] - x[equal] for x in (a, b)])
        else:
            step = equal.astype("int64")
        at, a, b = np.concatenate([at, more]), np.concatenate([a + step, c]), np.concatenate([b + step, d])
    out[at] = a - start[at]
    return out


def runs_of(sym: np.ndarray, starts: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in a sequence of documents of ascending lengths, each followed by a symbol of its own."""
    places, periods = [], []
    for p in range(1, int(lengths[-1]) // repeats + 1 if len(lengths) else 1):
        k = np.searchsorted(lengths, max(min_words, repeats * p))
        if k == len(lengths):
            break
        i = np.arange(starts[k], len(sym) - p, max((repeats - 1) * p, min_words - p))
        i = i[sym[i] == sym[i + p]]
        if len(i):
            places.append(i)
            periods.append(np.full(len(i), p))
    if not places:
        return (np.zeros(0, "int64"),) * 3
    i, p = np.concatenate(places), np.concatenate(periods)
    levels, n = grammar(sym), len(sym)
    ahead = extension(levels, i, i + p)
    behind = extension([level.mirrored() for level in levels], n - i - p, n - i)
    length = ahead + behind + p
    keep = length >= np.maximum(min_words, repeats * p)
    start, length, p = (i - behind)[keep], length[keep], p[keep]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    return start[new], length[new], p[new]


def solve(texts: list[list[bytes]], min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words: (start, length, period) in order of start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((k for k, w in enumerate(texts) if len(w) >= max(min_words, repeats)), key=lambda k: len(texts[k]))
    if not order:
        return out
    names: dict[bytes, int] = {}
    name = names.setdefault
    lengths = np.array([len(texts[k]) for k in order])
    starts = np.append(0, np.cumsum(lengths + 1))[:-1]
    sym = np.full(int(starts[-1] + lengths[-1] + 1), -1, "int64")
    for s, k in zip(starts.tolist(), order, strict=True):
        sym[s : s + len(texts[k])] = [name(w, len(names)) for w in texts[k]]
    sym[starts + lengths] = len(names) + np.arange(len(order))
    start, length, period = runs_of(sym, starts, lengths, min_words, repeats)
    of = np.searchsorted(starts, start, side="right") - 1
    by = np.lexsort((period, start))
    for d, s, n, p in zip(of[by].tolist(), (start - starts[of])[by].tolist(), length[by].tolist(), period[by].tolist(), strict=True):
        out[order[d]].append((s, n, p))
    return out


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside what repeats: a run drops all but its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, "int32")
    for s, n, p in runs:
        edge[s + p] += 1
        edge[s + n] -= 1
    return [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c]


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, repeats: int = REPEATS, sequence_words: int = SEQUENCE_WORDS) -> DataFrame:
    """`docs` with n_words, runs (structs of start, length and period, in order of start, then period) and collapsed (the words kept,
    joined by one space). `sequence_words` bounds how many words of documents share a sequence; a longer text is one alone."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(RUN)), T.StructField("collapsed", T.StringType())])
    place = [f.name for f in docs.schema.fields].index(text_col)
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def answer(rows: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = solve(texts, min_words, repeats)
        runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], run_type)
        collapsed = pa.array([b" ".join(kept(w, r)).decode() for w, r in zip(texts, found, strict=True)], pa.string())
        columns = [*rows.columns, pa.array([len(w) for w in texts], pa.int64()), runs, collapsed]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, size = [], 0, 0
            for k, text in enumerate(batch.column(place)):
                words = (text.as_py() or "").encode().split()  # bytes are split at 0x20 and 0x09-0x0D alone
                if texts and size + len(words) > sequence_words:
                    yield answer(batch.slice(begin, k - begin), texts)
                    texts, begin, size = [], k, 0
                texts.append(words)
                size += len(words)
            if texts:
                yield answer(batch.slice(begin), texts)

    return docs.mapInArrow(each, schema)


def planted(text: Column, key: Column) -> Column:
    """`text` with a repeat for one key in ten: with h the key's crc32 and g = floor(h / 10), from word a = g % n on the next
    p = 1 + floor((n - a) / (3 + g % 8)) words come again and again. Other texts, null keys and texts without words stay."""
    h = F.crc32(key.cast("string").cast("binary"))
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def again(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")

    # A lambda's variable is computed once; the expression itself would be split anew for each word.
    return F.when((h % 10 == 0) & (F.size(found) > 0), F.transform(F.array(found), again)[0]).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id plants nothing; its text is taken as it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs.withColumn("text", planted(F.col("text"), F.col("doc_id"))))
    # The greatest exact ratio length / period: products of whole numbers compare exactly; runs are in order of start, then period.
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    b = F.col("best")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def brute(rows: list[tuple], min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[tuple]:
    """The rows of op11_runs from (doc_id, text) by comparing words at all distances, for tests."""
    import hashlib
    import re
    import zlib

    out = []
    for doc_id, text in rows:
        w = re.findall(WORD, text or "")
        n = len(w)
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, seen = [], set()
        for p in range(1, n // repeats + 1):
            i = 0
            while i < n - p:
                j = i
                while j < n - p and w[j] == w[j + p]:
                    j += 1
                if j - i + p >= max(min_words, repeats * p) and (i, j + p) not in seen:
                    seen.add((i, j + p))
                    runs.append((i, j + p - i, p))
                i = max(j, i) + 1
        runs.sort(key=lambda r: (r[0], r[2]))
        drop = {i for s, m, p in runs for i in range(s + p, s + m)}
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return out
