"""N-gram Jaccard join by grouped prefixes: classes of documents connected by links of high similarity.

A document's set holds its distinct shingles of `k` words (a shorter document's whole sequence as one; without
words, nothing). Two documents link when den * intersection >= num * union.

1. Documents with equal sets collapse into a node, by a 128-bit digest of the set.
2. Shingles are ordered by a hash, but those that often come first in sets come last (at most `MAX_HOT` of them,
   1.6 MB in each task; which they are steers cost and no result). A set's prefix is its first n - ceil(n * num / den) + 1 shingles; linked sets
   share a shingle of their prefixes. Nodes with identical prefix and size collapse into a group, and groups meet
   in postings of prefix shingles.
3. A posting of more than `CROWD` nodes is set aside: its shingle is too frequent to tell texts apart. The nodes
   of such postings are ordered anew among themselves, by how many of them have a shingle, rare ones first, and
   meet in the postings of their new prefixes. Two linked nodes share a posting that was kept, or are both in
   postings set aside and then share one of the new ones, so no link is missed.
4. Group pairs of a posting pass a test of size and of the places of the shared shingle, and then one of how many
   shingles of their prefixes they share: links of 0.9 share about half. What passes expands to pairs of members.
5. Pairs are verified on the whole texts where they can still join classes. First come the pair of each node with
   its first partner, and in the new postings that of each node with the heaviest of its posting and size band; the
   links found make classes. Then all pairs left whose members are of different classes are verified. What is
   never compared is already in one class; a group of thousands of near copies costs about as many comparisons
   as it has members, not their square.

Edge cases: null or empty text, or text of white space, has 0 shingles and is a class of its own. Repeated rows
are in one class. A null id never names a class while the class has another id. Ties of ids are equal ids. A very long
text has as many shingles as it has; it is compared whole. An empty table gives an empty result. Other columns pass through
keep_one() as they are, whatever their names; link() reads none of them. Of rows equal in id and text one stays (keep_one says which).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, give_back, materialize, most_frequent, release, remove, row_hash, table

CROWD = 32
HOT = 24
MAX_HOT = 200_000
_CHUNK = 1 << 18
_U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _CHUNK + (1 << 16))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def sets_of(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; about _CHUNK bytes of texts are hashed at a time."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t.encode("utf-8", "replace") if t else b"")
        size += len(held[-1]) + 1
        if size > _CHUNK:
            yield from _sets(held, k)
            held, size = [], 0
    if held:
        yield from _sets(held, k)


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    starts_of = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    powers, inverse = _powers(len(raw) + 1)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((_FOLD[raw].astype(_U) + _U(1)) * powers[: len(raw)])])
    word = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U))
    first = np.searchsorted(start, starts_of)  # the number of each text's first word
    rolled = np.zeros(max(0, len(word) - k + 1), _U)
    for j in range(k):
        rolled = _mix(rolled + word[j : j + len(rolled)] * _U(2 * j + 3))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1].view(np.int64)))
        elif b > a:  # fewer words than a shingle has
            h = np.full(1, b - a, _U)
            for x in word[a:b]:
                h = _mix(h * _U(31) + x)
            out.append(h.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def row_key(id_: Column, text: Column) -> Column:
    """16 bytes for a row's id and text, so that copies of a text under other ids meet in no join; a null id differs from all others."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.concat(F.lit("v"), id_.cast("string")), F.lit("n")), F.md5(F.coalesce(text, F.lit(""))))))


def with_sum(rows: DataFrame, key: str, name: str, value: Column | None = None) -> DataFrame:
    """`rows` with the sum of `value`, or the number of rows, of their key, where it is over 1.

    Tasks sum before the shuffle and the join splits frequent keys, so no key is one task's work as in a window."""
    sums = rows.groupBy(key).agg(F.sum(value if value is not None else F.lit(1)).alias(name)).where(F.col(name) > 1)
    return rows.join(sums, key)


def frequent(docs: DataFrame, text_col: str, k: int, num: int, den: int, hot: int = HOT, max_hot: int = MAX_HOT) -> np.ndarray:
    """The shingles that come up in the first parts of most sets, a prefix and a quarter long, counted over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            give_back()
            firsts = [s[: prefix_length(len(s), num, den) * 5 // 4 + 1].copy() for s in sets_of(b["t"], k) if len(s)]
            if firsts:
                token, c = np.unique(np.concatenate(firsts), return_counts=True)
                yield pd.DataFrame({"token": token, "c": c})

    counts = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= hot)
    top = most_frequent(materialize(counts, "frequent"), "c", max_hot).select("token").toPandas()
    return np.sort(top["token"].to_numpy(dtype=np.int64))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """For each document: id, rk (of id and text), n, digest of the set, and its prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    @F.arrow_udf("n int, digest binary, prefix array<long>")
    def sign(text: pa.Array) -> pa.Array:
        give_back()
        often, sizes, digests, prefixes = sent.value, [], [], [np.zeros(0, np.int64)]
        for s in sets_of((t.as_py() for t in text), k):
            sizes.append(len(s))
            if not len(s):
                digests.append(None)
                prefixes.append(s)
                continue
            order = s
            if len(often):
                is_hot = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                order = np.concatenate([s[~is_hot], s[is_hot]])
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            prefixes.append(order[: prefix_length(len(s), num, den)].copy())
        ends = np.cumsum([len(p) for p in prefixes], dtype=np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), prefix], ["n", "digest", "prefix"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("rk"), sign(text).alias("s")).select("id", "rk", "s.n", "s.digest", "s.prefix")


def rare_first(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Prefix postings (token, gid, node, n, pos) of nodes (node, text), ordered by how many of these nodes have a shingle."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            give_back()
            for at in range(0, len(b), 500):
                sets = list(sets_of(b["text"].iloc[at : at + 500], k))
                n = np.array([len(s) for s in sets], dtype=np.int32)
                yield pd.DataFrame({"node": np.repeat(b["node"].iloc[at : at + 500].to_numpy(), n), "n": np.repeat(n, n), "token": np.concatenate(sets)})

    rows = materialize(texts.select("node", "text").mapInPandas(shingles, "node long, n int, token long"), "shingles")
    counted = rows.join(rows.groupBy("token").agg(F.count("*").alias("df")), "token")
    placed = counted.withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("df", "token")) - 1)
    length = F.col("n") - F.expr(f"(n * {num} + {den} - 1) DIV {den}") + 1
    return placed.where((F.col("pos") < length) & (F.col("df") > 1)).select("token", F.col("node").alias("gid"), "n", "pos")


def postings_of(rows: DataFrame) -> DataFrame:
    """Postings with weight (how many nodes its shingles bring a group together with) and before (its shared shingles before this one)."""
    of_group = Window.partitionBy("gid")
    return rows.withColumn("weight", F.sum("of").over(of_group)).withColumn("before", F.row_number().over(of_group.orderBy("pos")) - 1)


def near_size(a, b, num: int, den: int):
    return (a * den >= b * num) & (b * den >= a * num)


def star_pairs(postings: DataFrame, num: int, den: int) -> DataFrame:
    """In each posting and size band: one representative with one group of each other class.

    postings: token, gid, node (a member of the group), comp (its class), n, weight. The heaviest represents the
    posting: of a text and its edited copies, that is the text."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).alias("band")
    heaviest = F.struct((-F.col("weight")).alias("o"), F.col("node"), F.col("n"))
    one = postings.groupBy("token", band, "comp").agg(F.min(heaviest).alias("m"))
    rep = postings.groupBy("token", band).agg(F.min(F.struct(heaviest.alias("m"), F.col("comp"))).alias("r"))
    pairs = one.join(rep, ["token", "band"]).where(F.col("r.comp") != F.col("comp"))
    return pairs.where(near_size(F.col("m.n"), F.col("r.m.n"), num, den)).select(F.least("m.node", "r.m.node").alias("a"), F.greatest("m.node", "r.m.node").alias("b")).distinct()


def group_pairs(postings: DataFrame, num: int, den: int, first: bool = False) -> DataFrame:
    """(x_gid, x_comp, y_gid, y_comp) of different classes that share postings and pass the tests of size, place and number.

    With `first`, every shared prefix shingle must be in the postings; a pair then passes by its first one alone,
    before which nothing is shared, and is not counted at the others.

    postings: token, gid, comp, n, pos, before (shared shingles before this one), aside (prefix shingles in postings set aside)."""
    tokens = postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    mixed = postings.join(tokens, "token", "left_semi")
    x, y = (mixed.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("gid", "comp", "n", "pos", "before", "aside")]) for s in "xy")
    need = F.ceil((F.col("x_n") + F.col("y_n")) * F.lit(num) / F.lit(num + den) - 1e-9)
    # Of the shingles before a shared one, only those in postings can be shared too; after it, as many as the smaller rest.
    rest = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    can = rest if first else F.least("x_before", "y_before") + rest
    near = x.join(y, "token").where((F.col("x_comp") < F.col("y_comp")) & near_size(F.col("x_n"), F.col("y_n"), num, den) & (can >= need))
    if first:
        return near.select("x_gid", "x_comp", "y_gid", "y_comp").distinct()
    pairs = near.groupBy("x_gid", "x_comp", "y_gid", "y_comp").agg(F.count("*").alias("common"), F.max(need).alias("need"), *[F.max(f"{s}_{c}").alias(f"{s}_{c}") for s in "xy" for c in ("n", "aside")])
    # What is shared is in both prefixes, or after the end of the one that ends first.
    after = F.greatest(*[F.col(f"{s}_n") - (F.col(f"{s}_n") - F.expr(f"({s}_n * {num} + {den} - 1) DIV {den}") + 1) for s in "xy"])
    return pairs.where(F.col("common") + F.least("x_aside", "y_aside") + after >= F.col("need")).select("x_gid", "x_comp", "y_gid", "y_comp")


def members_of(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (a, b) of members of pairs of (group, class); of: gid, comp, node."""
    x, y = (of.select(F.col("gid").alias(f"{s}_gid"), F.col("comp").alias(f"{s}_comp"), F.col("node").alias(s)) for s in "xy")
    return pairs.join(x, ["x_gid", "x_comp"]).join(y, ["y_gid", "y_comp"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            give_back()
            left, right = sets_of(b["ta"], k), sets_of(b["tb"], k)
            keep = []
            for s, t in zip(left, right, strict=True):
                inter = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                keep.append(den * inter >= num * (len(s) + len(t) - inter))
            yield b.loc[keep, ["a", "b"]]

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of an edge: comp is the smallest node it reaches. Labels spread to neighbours and
    then jump to their label's label, until none changes; each round is a written table."""
    both = materialize(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("comp")), "labels")
    while True:
        spread = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        spread = spread.join(labels, "node").select("node", F.col("comp").alias("old"), F.least("near", "comp").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = materialize(spread.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        labels = after.select("node", "comp")
        if after.where("comp <> old").isEmpty():
            return labels


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100, crowd: int = CROWD) -> DataFrame:
    """A row for each document: id, rk, n_shingles, component_id (the smallest id of its class) and node (the class, null without words)."""
    spark = docs.sparkSession
    signed = materialize(signatures(docs, id_col, text_col, k, num, den, frequent(docs, text_col, k, num, den)), "signatures")
    found = materialize(signed.select("id", "rk", "n", "digest"), "documents")
    of_set = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rk"))).alias("r")
    nodes = signed.where("n > 0").groupBy("digest").agg(of_set, F.first("n").alias("n"), F.first("prefix").alias("prefix")).select("digest", "r.id", "r.rk", "n", "prefix")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("gk", F.unhex(F.md5(F.concat_ws(",", "n", F.col("prefix").cast("array<string>"))))), "prefixes")
    remove(spark, signed)
    release(spark)
    groups = materialize(nodes.groupBy("gk").agg(F.min("node").alias("gid"), F.count("*").alias("members")), "groups")
    met = nodes.select(F.col("node").alias("gid"), "n", "prefix").join(groups.select("gid", "members"), "gid").select("gid", "n", "members", F.posexplode("prefix").alias("pos", "token"))
    met = materialize(with_sum(met, "token", "of", F.col("members")).drop("members"), "met")
    prefixes, nodes = nodes, materialize(nodes.select("digest", "id", "rk", "n", "node", "gk"), "nodes")
    remove(spark, prefixes)
    release(spark)

    aside = F.count_if(F.col("of") > crowd).over(Window.partitionBy("gid"))
    met = materialize(postings_of(met).withColumn("aside", aside), "postings")
    gids = met.groupBy("gid").agg((F.max("aside") > 0).alias("crowded"))  # also groups of several members alone in their postings
    members = materialize(nodes.join(groups.select("gk", "gid"), "gk").join(gids, "gid").select("gid", "node", "rk", "crowded"), "members")
    of_group = members.withColumn("comp", F.col("gid"))
    pairs = members_of(group_pairs(met.where(F.col("of") <= crowd).withColumn("comp", F.col("gid")), num, den), of_group)
    small = members.join(groups.where((F.col("members") > 1) & (F.col("members") <= crowd)).select("gid"), "gid", "left_semi")
    inside = small.select("gid", F.col("node").alias("a")).join(small.select("gid", F.col("node").alias("b")), "gid").where("a < b").select("a", "b")
    pairs = materialize(pairs.union(inside).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.where("crowded").select("node")).distinct()
    whole = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
    texts = whole.join(members.join(wanted, "node").select("rk", "node", "crowded"), "rk")  # one row of each set, but for repeated rows
    texts = materialize(texts.groupBy("rk").agg(*[F.first(c).alias(c) for c in ("node", "text", "crowded")]).drop("rk"), "texts")
    release(spark)

    rare = with_sum(materialize(rare_first(texts.where("crowded"), k, num, den), "rare"), "token", "of")
    rare = materialize(postings_of(rare).withColumn("aside", F.lit(0)).withColumn("node", F.col("gid")), "postings")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(star_pairs(rare.withColumn("comp", F.col("node")), num, den)).distinct()
    edges = materialize(verify(first, texts, k, num, den), "links")
    labels = components(edges)
    release(spark)
    comp = lambda df, node: df.join(labels.select(F.col("node").alias(node), F.col("comp").alias(f"{node}_of")), node, "left").withColumn(f"{node}_of", F.coalesce(f"{node}_of", node))
    left = comp(comp(pairs, "a"), "b").where("a_of <> b_of").select("a", "b")
    rare = comp(rare, "node").withColumnRenamed("node_of", "comp")
    crossing = group_pairs(rare, num, den, first=True).select(F.least("x_gid", "y_gid").alias("a"), F.greatest("x_gid", "y_gid").alias("b"))
    labels = components(edges.unionByName(materialize(verify(left.union(crossing).distinct(), texts, k, num, den), "links")))

    of_node = nodes.select("digest", "node", "id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = of_node.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = of_node.join(names, "comp").select("digest", F.col("comp").alias("node"), "component_id")
    return found.join(named, "digest", "left").select(
        "id", "rk", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "node"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each class: that with the smallest id (nulls last), then the smallest hash of id and text, then of all
    columns; documents without words stay."""
    key, bare, tie, kept_row = (free_name(docs, c) for c in ("row_key", "bare", "tie", "kept_row"))
    classes = materialize(link(docs, id_col, text_col, **options).select("id", "rk", "node"), "membership")
    first = classes.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rk"))).alias("f")).select("f.rk")
    kept = first.withColumn(bare, F.lit(False)).union(classes.where("node IS NULL").select("rk").distinct().withColumn(bare, F.lit(True))).withColumnRenamed("rk", key)
    joined = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col))).join(kept, key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = joined.where(~F.col(bare)).withColumn(tie, row_hash(docs)).groupBy(key).agg(F.min_by(F.struct(*columns), tie).alias(kept_row))
    return one.select(f"{kept_row}.*").unionByName(joined.where(bare).select(*columns))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def brute(rows: list[tuple], k: int, num: int, den: int) -> list[tuple]:
    """The same classes from all pairs, for tests: (id, n_shingles, component_id)."""
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and den * len(s & sets[j]) >= num * len(s | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [(x, len(sets[i]), least.get(find(i)) if sets[i] else x) for i, (x, _) in enumerate(rows)]


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.m = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
