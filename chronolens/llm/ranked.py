"""Ranked lexical search: posting lists in geometric blocks, skipped by exact bounds.

Terms are maximal stretches of letters and digits of ASCII and of all other code points beyond it, A-Z lower-cased. A first pass
counts, for each document, its terms and those of them that the queries have; from its table come the numbers of documents and
terms and, by a sum over rows of document and term, each query term's document frequency.

The second pass reads that table (terms and counts, no texts). A task takes a part of its documents at a time, bounded by its
postings and by documents x terms, and indexes it: each document is a vector of impacts, each term has a posting list. A list is
clustered by likeness of its documents (cosine of signed projections, nearest of some of its own documents) and cut into blocks
of at most `BLOCK` documents; a block's summary is the coordinatewise maximum of its documents over the terms that come
up beside the list's term in a query. Summary times query bounds the score of every document in the block, as no weight or
impact is below 0. For each query the blocks of its lists are taken in order of their bounds, and their documents are scored
exactly; the first bound below the score of the k-th document found so far ends it, as no block after it can hold a document of
the result. What a task has found for a query goes on to its next parts as the score to beat. A task so returns k rows a query
at most, and the best of all tasks are the result, exact ties included.

Queries come in blocks of at most `QUERY_TERMS` terms (or one larger query), which are sent to all tasks; each block reads the
documents once.

Edge cases: null texts and texts without terms aren't counted as documents and are found by nothing. A query without terms, or
none of whose terms occur, has no rows. Very long texts are one vector of their terms. Of equal scores the smaller id comes first,
null last; repeated rows are documents of their own, each with a rank; queries with equal ids are queries of their own, told apart
by query_no. Empty tables give an empty result. Columns beside ids and texts are left aside.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, remove, table

K = 10
BLOCK = 32
PART_POSTINGS = 200_000
PART_CELLS = 12_000_000
QUERY_TERMS = 1_000_000
DIMENSIONS = 32
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: its UTF-8 bytes with A-Z lowered and other ASCII than letters and digits blanked, split at blanks."""
    return text.encode().translate(_LETTERS).split() if text else []


def query_blocks(queries: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, object, Counter]]]:
    """(number, id, counts of terms) of the queries, in blocks of at most `most` terms or of one query."""
    size, block = 0, []
    for no, row in enumerate(queries.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator()):
        counts = Counter(terms(row.t))
        if block and size + len(counts) > most:
            yield block
            size, block = 0, []
        if counts:
            block.append((no, row.i, counts))
            size += len(counts)
    if block:
        yield block


def vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): each document's number of terms, and the numbers and counts of those in the vocabulary."""
    field = docs.schema[id_col]
    schema = T.StructType([T.StructField("doc_id", field.dataType), *T._parse_datatype_string("n bigint, term array<int>, tf array<int>").fields])
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            n, of, tf, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms(text.as_py())
                found = {number[w]: c for w, c in Counter(words).items() if w in number}
                n.append(len(words))
                of.extend(found)
                tf.extend(found.values())
                ends.append(len(of))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (of, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(each, schema)


class Queries:
    """A block of queries as numbers: each one's terms and weights, and for each term the terms beside it."""

    def __init__(self, block: list, vocabulary: dict[bytes, int], weight: np.ndarray):
        self.ids = [(no, i) for no, i, _ in block]
        self.terms = [np.sort(np.array([vocabulary[w] for w in c], "int64")) for _, _, c in block]
        times = [{vocabulary[w]: m for w, m in c.items()} for _, _, c in block]
        self.weights = [np.array([m[t] * weight[t] for t in q.tolist()], "int64") for q, m in zip(self.terms, times, strict=True)]
        near: list[list[np.ndarray]] = [[] for _ in vocabulary]
        for q in self.terms:
            for t in q.tolist():
                near[t].append(q)
        self.near = [np.unique(np.concatenate(x)) if x else np.zeros(0, "int64") for x in near]
        self.at = [[np.searchsorted(self.near[t], q) for t in q.tolist()] for q in self.terms]


class Part:
    """The index of some documents: impacts (documents x terms), and for each term its blocks of documents with their summaries."""

    def __init__(self, ids: list, n: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], queries: Queries, mean: tuple[int, int]):
        self.ids = ids
        total, length = mean
        m = 25 + 75 * n * total // max(length, 1)
        rows = np.repeat(np.arange(len(ids)), [len(t) for t, _ in lists])
        t, tf = (np.concatenate([x[j] for x in lists]).astype("int64") for j in (0, 1))
        self.used, column = np.unique(t, return_inverse=True)
        self.column = np.full(len(queries.near) + 1, len(self.used), "int64")  # terms that no document of the part has: a column of zeros
        self.column[self.used] = np.arange(len(self.used))
        self.impact = np.zeros((len(ids), len(self.used) + 1), "int32")
        self.impact[rows, column] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows])
        spots = self._projected(rows, t, column)
        order = np.lexsort((rows, column))
        edges = np.append(np.flatnonzero(np.append(True, np.diff(column[order]) > 0)), len(order))
        self.blocks: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        for term, a, b in zip(self.used.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            docs = rows[order[a:b]]
            docs, starts = self._clustered(docs, spots)
            summary = np.maximum.reduceat(self.impact[np.ix_(docs, self.column[queries.near[term]])], starts, axis=0)
            self.blocks[term] = (np.split(docs, starts[1:]), summary)

    def _projected(self, rows: np.ndarray, t: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Documents as unit vectors of a few signed sums of their impacts, the signs from a hash of the term: close where impacts are."""
        bits = (self.used.astype("uint64") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        signs = np.where((bits[:, None] >> np.arange(64 - DIMENSIONS, 64, dtype="uint64")) & np.uint64(1), 1.0, -1.0).astype("float32")
        spots = self.impact[:, :-1].astype("float32") @ signs
        return spots / np.maximum(np.linalg.norm(spots, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _clustered(docs: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A list's documents ordered by cluster, and where its blocks begin: at each cluster, and after each BLOCK documents of one."""
        if len(docs) <= BLOCK:
            return docs, np.zeros(1, "int64")
        heads = docs[::BLOCK]
        of = np.argmax(spots[docs] @ spots[heads].T, axis=1)
        order = np.argsort(of, kind="stable")
        docs, of = docs[order], of[order]
        begins = np.flatnonzero(np.append(True, np.diff(of) > 0))
        within = np.arange(len(docs)) - np.repeat(begins, np.diff(np.append(begins, len(docs))))
        return docs, np.flatnonzero(within % BLOCK == 0)

    def search(self, queries: Queries, q: int, best: list[tuple], k: int) -> tuple[list[tuple], int]:
        """`best`, k at most of (-score, id is null, id), with the documents of this part; and the number of blocks whose documents were scored."""
        weights, columns = queries.weights[q], self.column[queries.terms[q]]
        bounds, blocks = [], []
        for t, at in zip(queries.terms[q].tolist(), queries.at[q], strict=True):
            if t in self.blocks:
                docs, summary = self.blocks[t]
                bounds.append(summary[:, at].astype("int64") @ weights)
                blocks.extend(docs)
        if not blocks:
            return best, 0
        bound = np.concatenate(bounds)
        order = np.argsort(-bound, kind="stable")
        seen, taken = np.zeros(len(self.ids), bool), 0
        while taken < len(order):
            beat = -best[-1][0] if len(best) == k else 1
            step = order[taken : taken + 8]
            step = step[bound[step] >= beat]  # in order of bounds, so those that stay are the first
            if not len(step):
                break
            taken += len(step)
            docs = np.unique(np.concatenate([blocks[x] for x in step.tolist()]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            score = self.impact[np.ix_(docs, columns)].astype("int64") @ weights
            good = score >= beat
            if good.any():
                new = [(-s, self.ids[d] is None, self.ids[d]) for s, d in zip(score[good].tolist(), docs[good].tolist(), strict=True)]
                best = sorted([*best, *new])[:k]
        return best, taken


def parts(batches: Iterator[pa.RecordBatch], postings: int, cells: int, width: int) -> Iterator[tuple[list, np.ndarray, list]]:
    """Documents with a query term, in parts of at most `postings` postings and `cells` cells, or of one document."""
    ids, n, lists, size = [], [], [], 0
    for batch in batches:
        starts, (t, tf) = batch.column(2).offsets.to_numpy(), (batch.column(c).values.to_numpy() for c in (2, 3))
        for k, i in enumerate(batch.column(0).to_pylist()):
            a, b = starts[k], starts[k + 1]
            if a == b:
                continue
            if ids and (size + b - a > postings or (len(ids) + 1) * min(width, size + b - a) > cells):
                yield ids, np.array(n), lists
                ids, n, lists, size = [], [], [], 0
            ids.append(i)
            n.append(batch.column(1)[k].as_py())
            lists.append((t[a:b], tf[a:b]))
            size += b - a
    if ids:
        yield ids, np.array(n), lists


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text",
           k: int = K, query_terms: int = QUERY_TERMS, postings: int = PART_POSTINGS, cells: int = PART_CELLS) -> DataFrame:
    """(query_no, item_id, rank, doc_id, score): the k best documents of each query whose score is above 0."""
    found = None
    kinds = [docs.schema[id_col].dataType, queries.schema[query_id].dataType]
    schema = T.StructType([T.StructField("query_no", T.LongType()), T.StructField("item_id", kinds[1]), T.StructField("doc_id", kinds[0]), T.StructField("score", T.LongType())])
    for block in query_blocks(queries, query_id, query_text, query_terms):
        read, best = _searched(docs, block, id_col, text_col, k, postings, cells, schema)
        best = materialize(best, "ranked")
        remove(docs.sparkSession, read)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    first = Window.partitionBy("query_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_no", "item_id", "rank", "doc_id", "score")


def _searched(docs: DataFrame, block: list, id_col: str, text_col: str, k: int, postings: int, cells: int, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The written table of the documents' terms, and the best documents that each task finds in it for the queries of a block."""
    spark = docs.sparkSession
    vocabulary = {w: t for t, w in enumerate(sorted({w for *_, c in block for w in c}))}
    read = materialize(vectors(docs, id_col, text_col, vocabulary), "vectors")
    total, length = read.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), "int64")
    for r in read.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # a row for each term of the block at most
        df[r.t] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], "int64")
    sent = spark.sparkContext.broadcast((block, vocabulary, weight))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(*sent.value)
        best: list[list[tuple]] = [[] for _ in queries.ids]
        for ids, n, lists in parts(batches, postings, cells, len(vocabulary)):
            part = Part(ids, n, lists, queries, (total, length))
            for q in range(len(best)):
                best[q], _ = part.search(queries, q, best[q], k)
        rows = [(*queries.ids[q], i, -s) for q, top in enumerate(best) for s, _, i in top]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=arrow)

    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])
    return read, read.select("doc_id", "n", "term", "tf").mapInArrow(each, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), "score")


def brute(docs: list[tuple], queries: list[tuple], k: int = K) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every query, for tests."""
    import re

    found = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    read = [(i, found.findall(lower(t))) for i, t in docs]
    total, length = sum(bool(w) for _, w in read), sum(len(w) for _, w in read)
    df = Counter(t for _, w in read for t in set(w))
    out = []
    for item, text in queries:
        scored = []
        for i, w in read:
            tf, score = Counter(w), 0
            m = 100 - 75 + 75 * len(w) * total // max(length, 1)
            for t in found.findall(lower(text)):
                if t in tf:
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
bt AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
dt AS (SELECT k, doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT k, doc_id, w, unnest(w) AS t FROM d) GROUP BY k, doc_id, w, t),
tw AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM dt, s GROUP BY t),
sc AS (SELECT q, item_id, k, doc_id, CAST(sum(times * wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM bt JOIN dt USING (t) JOIN tw USING (t), s GROUP BY q, item_id, k, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, score FROM r WHERE rank <= 10
"""
