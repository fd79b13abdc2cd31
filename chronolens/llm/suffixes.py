"""Removal of repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if it is covered by a string of n bytes that starts anywhere else too. Suffixes are sorted at anchors, not at each
byte: of the k-grams (k = n / 2) of each string of n bytes the one of the smallest hash is an anchor, which depends on the string
alone, so both occurrences of a repeated string have an anchor at the same offset. Anchors whose k-gram's hash comes up once can't
be in a repeated string and are left out before anything is sorted (a count by hash, as prefix doubling does for prefixes).

Sort. An anchor's key string is its k-gram, what follows it up to n bytes and what precedes it, read backwards, up to n - k bytes;
0xFF, which UTF-8 doesn't have, stands for what lies beyond the ends of a document. A task sorts the strings of its documents in
runs, cuts each run at splitters taken from a sample, and front-codes each slice: the length of the prefix shared with the string
before, and the rest. Slices travel to the task of their range, which merges them with a loser tree: a string enters with the
prefix it shares with the last winner, strings with a longer one win unseen, and only those that share equally much are compared,
from there on. The merged order comes with the common prefix of neighbours. A string ends in its place, so strings are distinct,
and equal texts, however many, are dealt over many ranges.

Reading. Neighbours in this order tell how far an anchor's right side is repeated (r, at most), and with the left sides of the
neighbours compared, which strings of n bytes around it certainly are: those of a pair with l bytes equal on the left and r on
the right, if l + r >= n. One of each class of equal key strings, and all that are alone, are then sorted a second time, left side
first, which tells the most that the left side is repeated and gives certain strings too. What could still be repeated by both
bounds, isn't certain, and isn't within what goes already is settled by a third sort, of those strings of n bytes themselves with
all distinct ones that have the same k-gram at the same offset and that their bounds leave possible. An anchor at the edge of a
range whose neighbour lies in another one takes the highest bound instead. So each byte's fate is exact, and every decision is an
equality of bytes, not of hashes.

The splitters are at most `MAX_PARTS` strings on the driver; ranges hold about `PART_STRINGS` strings up to that and grow beyond.

Edge cases: null text is empty, has 0 bytes and keeps none; texts under n bytes keep all. Very long texts are read in pieces that
overlap by n - 1 bytes, and their strings sorted like all others. Repeated rows repeat each other, so their texts of n bytes and
more go whole. Cuts may fall inside a character, so `kept` is binary. An empty table gives an empty result. Columns of the input
but the text pass through; n_bytes, removed (byte ranges) and kept replace input columns of that name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, release, remove, table

BYTES = 200
PIECE = 1_000_000
RUN_STRINGS = 60_000
PART_STRINGS = 100_000
MAX_PARTS = 10_000
PER_SPLITTER = 16
HOT, HOT_ANCHORS = 1000, 10_000
SENT = 500_000
RESULTS = ("n_bytes", "removed", "kept")
_BASE = 0x9E3779B97F4A7C15
_PAD = 0xFF
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 1 to n of the base of the rolling hash and of its inverse, modulo 2 ** 64."""
    if n not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            _POWERS[n] = tuple(np.cumprod(np.full(n, b, "uint64"), dtype="uint64") for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
    return _POWERS[n]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-gram of `data`."""
    up, down = (p[: len(data)] for p in _powers(max(PIECE + 4096, len(data))))
    with np.errstate(over="ignore"):
        s = np.append(np.uint64(0), np.cumsum((data.astype("uint64") + np.uint64(1)) * up, dtype="uint64"))
        return _mixed((s[k:] - s[:-k]) * down[: len(data) - k + 1])


def core_hashes(cores: np.ndarray) -> np.ndarray:
    """The same hash of the rows of a matrix."""
    up = np.append(np.uint64(1), _powers(PIECE + 4096)[0][: cores.shape[1] - 1])
    with np.errstate(over="ignore"):
        return _mixed(((cores.astype("uint64") + np.uint64(1)) * up).sum(1, dtype="uint64"))


def sliding(x: np.ndarray, w: int, best: np.ufunc, worst: int) -> np.ndarray:
    """The least or greatest of each w neighbours: of each two blocks of w, the end of one and the begin of the other."""
    y = np.append(x, np.full(-len(x) % w, worst, x.dtype)).reshape(-1, w)
    ahead, behind = best.accumulate(y, 1).ravel(), best.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return best(behind[: len(x) - w + 1], ahead[w - 1 : len(x)])


def anchors(data: np.ndarray, ends: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that lie one after the other in `data`, to `ends`."""
    if len(data) < n:
        return np.zeros(0, "int64"), np.zeros(0, "uint64")
    h, w, most = gram_hashes(data, k), n - k + 1, np.iinfo("uint64").max
    least = sliding(h, w, np.minimum, most)
    inside = np.ones(len(least) + n, bool)  # strings of n bytes that lie in one text
    for e in ends.tolist():
        inside[max(0, e - n + 1) : e] = False
    least[~inside[: len(least)]] = 0
    none = np.zeros(w - 1, "uint64")
    at = np.flatnonzero((sliding(np.concatenate([none, least, none]), w, np.maximum, 0) == h) & (h > 0))
    return at, h[at]


def pieces(batch: pa.RecordBatch, n: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """The texts (columns key, n_bytes, z) in portions of about PIECE bytes: (key, offset) of each piece, all bytes, and the pieces' ends."""
    of, data, size = [], [], 0

    def portion():
        return of, np.concatenate(data), np.cumsum([len(d) for d in data])

    for key, length, z in zip(*(batch.column(c).to_pylist() for c in ("key", "n_bytes", "z")), strict=True):
        if length < n:
            continue
        text = np.frombuffer(pa.decompress(z, length, "zstd", asbytes=True), "uint8")
        for at in range(0, length - n + 1, PIECE):
            piece = text[at : at + PIECE + n - 1]
            if of and size + len(piece) > PIECE:
                yield portion()
                of, data, size = [], [], 0
            of.append((key, at))
            data.append(piece)
            size += len(piece)
    if of:
        yield portion()


def anchor_rows(texts: DataFrame, n: int, k: int) -> DataFrame:
    """(h, key, at): a row for each anchor."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, known = None, np.zeros(0, "int64")
            for of, data, ends in pieces(batch, n):
                at, h = anchors(data, ends, n, k)
                which = np.searchsorted(ends, at, side="right")
                keys, offsets = (np.array(x, "int64") for x in zip(*of, strict=True))
                place = at - np.append(0, ends[:-1])[which] + offsets[which]
                if of[0][0] == last:  # pieces of one text overlap; each of them is the first or the last of its portion
                    new = (which > 0) | ~np.isin(place, known)
                    which, place, h = which[new], place[new], h[new]
                last, known = of[-1][0], place[which == len(of) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(h.view("int64")), pa.array(keys[which]), pa.array(place)], names=["h", "key", "at"])

    return texts.mapInArrow(each, "h bigint, key bigint, at bigint")


class Form:
    """How a string is cut out of a text and laid out: `before` and `after` say how many bytes around a place, `order` their order.

    Rows with the same `core`, the first bytes of that number, belong together. Behind the string come the key (8 bytes), the
    place (8) and `extra` bytes of the caller's."""

    def __init__(self, before: int, after: int, order: np.ndarray, core: int, extra: int = 0):
        self.before, self.after, self.order, self.core, self.extra = before, after, order, core, extra
        self.size = len(order)
        self.width = self.size + 16 + extra

    def of(self, contexts: np.ndarray, keys: np.ndarray, at: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
        """The strings as rows of a matrix."""
        out = np.empty((len(contexts), self.width), "uint8")
        out[:, : self.size] = contexts[:, self.order]
        out[:, self.size : self.size + 8] = keys.astype(">i8").view("uint8").reshape(-1, 8)
        out[:, self.size + 8 : self.size + 16] = at.astype(">i8").view("uint8").reshape(-1, 8)
        if self.extra:
            out[:, self.size + 16 :] = extra
        return out

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.ascontiguousarray(rows[:, self.size + j : self.size + j + 8]).view(">i8").ravel().astype("int64") for j in (0, 8))


def right_form(n: int, k: int) -> Form:
    """From the anchor on to the right, then from it to the left; the context begins n - k bytes before it."""
    m = n - k
    return Form(m, n, np.concatenate([np.arange(m, m + n), np.arange(m - 1, -1, -1)]), k)


def left_form(n: int, k: int) -> Form:
    """The k-gram, what is left of it backwards, what is right of it; behind, the bounds found so far."""
    m = n - k
    return Form(m, n, np.concatenate([np.arange(m, n), np.arange(m - 1, -1, -1), np.arange(n, n + m)]), k, extra=6)


def contexts(batches: Iterator[pa.RecordBatch], before: int, after: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, places, contexts) of the places wanted (columns key, n_bytes, z, at), `most` at a time, padded beyond a text's ends."""
    keys, ats, found, size = [], [], [], 0
    for batch in batches:
        at = batch.column("at")
        starts, values = at.offsets.to_numpy(), at.values.to_numpy()
        for j, (key, length, z) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "n_bytes", "z")), strict=True)):
            data = np.full(before + length + after, _PAD, "uint8")
            data[before : before + length] = np.frombuffer(pa.decompress(z, length, "zstd", asbytes=True), "uint8")
            view = np.lib.stride_tricks.sliding_window_view(data, before + after)
            wanted = values[starts[j] : starts[j + 1]]
            for a in range(0, len(wanted), most):
                part = wanted[a : a + most]
                if size and size + len(part) > most:
                    yield np.concatenate(keys), np.concatenate(ats), np.concatenate(found)
                    keys, ats, found, size = [], [], [], 0
                keys.append(np.full(len(part), key, "int64"))
                ats.append(part)
                found.append(view[part])
                size += len(part)
    if size:
        yield np.concatenate(keys), np.concatenate(ats), np.concatenate(found)


def shared(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), "int64")
    for a in range(1, len(rows), 8192):
        differ = rows[a : a + 8192] != rows[a - 1 : min(a + 8192, len(rows)) - 1]
        first = differ.argmax(1)
        out[a : a + 8192] = np.where(differ[np.arange(len(first)), first], first, rows.shape[1])
    return out


def sliced(rows: np.ndarray, splitters: list[bytes]) -> Iterator[dict]:
    """A run: the rows sorted, cut at the splitters, each slice front-coded."""
    width = rows.shape[1]
    rows = rows[np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")]
    lcp = shared(rows)
    flat = rows.view(f"S{width}").ravel()
    cuts = np.concatenate([[0], np.searchsorted(flat, np.array(splitters, f"S{width}")) if splitters else [], [len(rows)]]).astype("int64")
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[part]), int(cuts[part + 1])
        lcp[a] = 0
        rest = rows[a:b][np.arange(width) >= lcp[a:b, None]]
        raw = lcp[a:b].astype("<u2").tobytes() + rest.tobytes()
        yield {"part": part, "n": b - a, "size": len(raw), "slice": pa.compress(raw, "zstd", asbytes=True)}


def opened(n: int, size: int, packed: bytes, width: int) -> Iterator[tuple[bytes, int]]:
    """The strings of a slice, each with the length of the prefix that it shares with the one before."""
    raw = pa.decompress(packed, size, "zstd", asbytes=True)
    at, s = 2 * n, b""
    for lcp in np.frombuffer(raw, "<u2", n).tolist():
        s = s[:lcp] + raw[at : at + width - lcp]
        at += width - lcp
        yield s, lcp


def merged(slices: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int]]:
    """The strings of sorted slices in order, each with the prefix shared with the one before, by a loser tree.

    lcp[i] is what the next string of slice i shares with the last winner. The greater wins, as it goes on like the winner for
    longer; equals are compared behind it, and the loser's lcp becomes what it shares with the one that beat it."""
    size = 1 << max(0, (len(slices) - 1).bit_length())
    sources = [s.__next__ for s in slices]
    head, lcp = [b""] * size, [-1] * size  # -1: nothing is left
    for i, s in enumerate(slices):
        head[i], lcp[i] = next(s)[0], 0
    tree = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b, which share equally much with the last winner; sets the loser's lcp."""
        at = lcp[a]
        if at < 0:
            return True
        x, y = head[a], head[b]
        while at < len(x):
            p, q = x[at : at + 48], y[at : at + 48]
            if p != q:
                at += len(p) - ((int.from_bytes(p) ^ int.from_bytes(q)).bit_length() + 7) // 8
                first = x[at] < y[at]
                lcp[b if first else a] = at
                return first
            at += 48
        return True

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        won = lcp[a] > lcp[b] or (lcp[a] == lcp[b] and beats(a, b))
        tree[node] = b if won else a
        return a if won else b

    win = build(1) if size > 1 else 0
    while lcp[win] >= 0:
        yield head[win], lcp[win]
        try:
            head[win], lcp[win] = sources[win]()
        except StopIteration:
            lcp[win] = -1
        node = (win + size) >> 1
        while node:
            other = tree[node]
            a, b = lcp[win], lcp[other]
            if b > a or (a == b and not beats(win, other)):
                tree[node], win = win, other
            node >>= 1


def merged_rows(group: pa.Table, width: int, most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The merged order of a range's slices: (rows, shared prefixes), `most` rows at a time, each portion after the first begins with the last row of the one before."""
    slices = [opened(*r, width) for r in zip(*(group.column(c).to_pylist() for c in ("n", "size", "slice")), strict=True)]
    strings, lcps, fresh = [], [], 0
    for s, lcp in merged(slices):
        strings.append(s)
        lcps.append(lcp)
        fresh += 1
        if fresh == most:
            yield np.frombuffer(b"".join(strings), "uint8").reshape(-1, width), np.array(lcps)
            strings, lcps, fresh = strings[-1:], lcps[-1:], 0
    if fresh:
        yield np.frombuffer(b"".join(strings), "uint8").reshape(-1, width), np.array(lcps)


class Pairs:
    """What neighbours in a range's order tell about each of its rows.

    l and r: the most that is certain on the left and, with the k-gram, on the right of the anchor, from pairs that share n bytes
    around it; most_l and most_r: the most that either side shares with any row of its k-gram as far as this order can tell."""

    def __init__(self, group: pa.Table, part: int, form: Form, n: int, k: int, right: bool, splitters: list[bytes]):
        portions = list(merged_rows(group, form.width))
        self.rows = rows = np.concatenate([r if j == 0 else r[1:] for j, (r, _) in enumerate(portions)])
        lcp = np.concatenate([x if j == 0 else x[1:] for j, (_, x) in enumerate(portions)])
        m = n - k
        sides = (rows[:, n : n + m], rows[:, k:n]) if right else (rows[:, k:n], rows[:, n : n + m])
        ends = tuple((s != _PAD).sum(1) for s in sides)  # to the ends of the text, in bytes
        self.same = lcp >= k  # of the same k-gram as the row before
        self.same[0] = False
        own, other = np.minimum(lcp - k, m), shared(rows[:, n : n + m])
        l, r = (np.where(self.same, np.minimum(x, e), 0) for x, e in zip((other, own) if right else (own, other), ends, strict=True))
        r += np.where(self.same, k, 0)
        certain = l + r >= n
        after = lambda x: np.append(x[1:], 0)
        self.most_l, self.most_r = np.maximum(l, after(l)), np.maximum(r, after(r))
        l, r = np.where(certain, l, 0), np.where(certain, r, 0)
        self.l, self.r = np.maximum(l, after(l)), np.maximum(r, after(r))
        self.like_before = self.same & (lcp >= n + m)
        self.edge = np.zeros(len(rows), bool)
        for row, cut in ((0, part - 1), (-1, part)):  # rows of its k-gram are in the next range too
            if 0 <= cut < len(splitters) and rows[row, :k].tobytes() == splitters[cut][:k]:
                self.edge[row], self.most_l[row], self.most_r[row] = True, ends[0][row], ends[1][row] + k


_KINDS = {"part": pa.int32(), "n": pa.int32(), "size": pa.int32(), "slice": pa.binary(), "key": pa.int64(), "low": pa.int64(), "high": pa.int64(), "at": pa.int64(), "h": pa.int64(), "least": pa.int32(), "most": pa.int32(), "offset": pa.list_(pa.int32())}
FOUND = "part int, n int, size int, slice binary, key bigint, low bigint, high bigint, at bigint, h bigint, least int, most int, offset array<int>"


def _found(**columns) -> pa.Table:
    rows = len(next(iter(columns.values())))
    return pa.table({c: pa.array(columns[c], kind) if c in columns else pa.nulls(rows, kind) for c, kind in _KINDS.items()})


def _slices(rows: list[dict]) -> pa.Table:
    return _found(**{c: [r[c] for r in rows] for c in ("part", "n", "size", "slice")})


def right_order(part: int, group: pa.Table, right: Form, left: Form, n: int, k: int, cuts: list[list[bytes]]) -> pa.Table:
    """Byte ranges that go for certain, and the slices of the second sort: one row of each class of equal ones, where its k-gram has
    several, with the bounds found here behind it."""
    p = Pairs(group, part, right, n, k, True, cuts[0])
    keys, at = right.ids(p.rows)
    sure = p.r > 0
    first = ~p.like_before
    of = np.cumsum(~p.same) - 1
    several = np.bincount(of, first)[of] > 1
    several |= (np.bincount(of, p.edge)[of] > 0)
    next_ = np.flatnonzero(first & several)
    rows, m = p.rows[next_], n - k
    bounds = np.stack([p.most_r[next_], p.l[next_], p.r[next_]], 1).astype("<u2").view("uint8")
    context = np.concatenate([rows[:, n : n + m][:, ::-1], rows[:, :n]], 1)
    again = left.of(context, keys[next_], at[next_], bounds)
    return pa.concat_tables([_found(key=keys[sure], low=(at - p.l)[sure], high=(at + p.r)[sure]), _slices(list(sliced(again, cuts[1])) if len(again) else [])])


def left_order(part: int, group: pa.Table, left: Form, n: int, k: int, cuts: list[bytes]) -> pa.Table:
    """Further byte ranges that go for certain, and for each anchor the hash of its k-gram, the least and greatest offset of strings that
    both bounds leave possible, and the offsets of those among them that aren't certain."""
    p = Pairs(group, part, left, n, k, False, cuts)
    keys, at = left.ids(p.rows)
    bounds = np.ascontiguousarray(p.rows[:, left.size + 16 :]).view("<u2").astype("int64")
    most_r, l, r = np.minimum(bounds[:, 0], n), np.maximum(bounds[:, 1], p.l), np.maximum(bounds[:, 2], p.r)
    sure = p.r > 0
    low, high = np.maximum(n - most_r, 0), p.most_l
    may = np.flatnonzero(low <= high)
    offsets: list[list[int]] = []
    for a, b, x, y in zip(*(c[may].tolist() for c in (low, high, l, r)), strict=True):
        offsets.append([o for o in range(a, b + 1) if o > x or n - o > y] if b > x or n - a > y else [])
    found = _found(key=keys[may], at=at[may], h=core_hashes(p.rows[may, :k]).view("int64"), least=low[may], most=high[may], offset=[o or None for o in offsets])
    return pa.concat_tables([_found(key=keys[sure], low=(at - l)[sure], high=(at + r)[sure]), found])


def whole_order(part: int, group: pa.Table, whole: Form, n: int, cuts: list[bytes]) -> pa.Table:
    """The strings of n bytes that come up more than once. A cut inside a class of equal strings has members on both sides."""
    portions = list(merged_rows(group, whole.width))
    rows = np.concatenate([r if j == 0 else r[1:] for j, (r, _) in enumerate(portions)])
    like = np.concatenate([x if j == 0 else x[1:] for j, (_, x) in enumerate(portions)]) >= n
    like[0] = False
    twice = like | np.append(like[1:], False)
    for row, cut in ((0, part - 1), (-1, part)):
        if 0 < cut < len(cuts) and cuts[cut - 1][:n] == cuts[cut][:n] == rows[row, :n].tobytes():
            twice[row] = True
    keys, at = whole.ids(rows)
    return _found(key=keys[twice], low=at[twice], high=at[twice] + n)


def _ordered(slices: DataFrame, answer: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """The answer of each range of slices."""

    def each(key: tuple, group: pa.Table) -> pa.Table:
        return answer(key[0].as_py(), group)

    return slices.select("part", "n", "size", "slice").groupBy("part").applyInArrow(each, FOUND)


def _packed(docs: DataFrame, text_col: str, key: str, z: str) -> DataFrame:
    """The columns but the text, and key, n_bytes and the compressed text."""
    rest = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(key, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField(z, T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(len(rest) + 1)]
            packed = pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest) + 1], pa.array([len(t) for t in texts], pa.int64()), packed], names=schema.names)

    named = [F.col(f"`{c}`") for c in rest]
    return docs.select(*named, F.monotonically_increasing_id().alias(key), F.col(text_col)).mapInArrow(each, schema)


def _splitters(texts: DataFrame, wanted: DataFrame, forms: list[Form], part_strings: int) -> list[list[bytes]]:
    """For each form the strings at which its ranges begin, from a sample of about PER_SPLITTER strings a range."""
    total = wanted.count()
    parts = min(MAX_PARTS, -(-total // part_strings))
    if parts < 2:
        return [[] for _ in forms]
    most = 1 << 40
    drawn = wanted.where(F.pmod(F.xxhash64("key", "at"), F.lit(most)) < int(most * min(1.0, parts * PER_SPLITTER / total)))
    places = drawn.groupBy("key").agg(F.collect_list("at").alias("at"))  # at most MAX_PARTS * PER_SPLITTER places, in expectation

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, at, found in contexts(batches, forms[0].before, forms[0].after, 1000):
            for j, form in enumerate(forms):
                strings = form.of(found, keys, at, np.zeros((len(at), form.extra), "uint8"))
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(at), pa.int32()), pa.array([s.tobytes() for s in strings], pa.binary())], names=["form", "string"])

    strings: list[list[bytes]] = [[] for _ in forms]
    for r in texts.join(F.broadcast(places), "key").mapInArrow(each, "form int, string binary").collect():
        strings[r.form].append(bytes(r.string))
    cuts = []
    for form, found in zip(forms, strings, strict=True):
        found.sort()
        cut = sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []
        # A cut is before the first row of its core, unless the cut before it has that core, too: only the most frequent lie in two ranges.
        cuts.append([s if j and cut[j - 1][: form.core] == s[: form.core] else s[: form.core] + bytes(form.width - form.core) for j, s in enumerate(cut)])
    return cuts


def _runs(texts: DataFrame, wanted: DataFrame, form: Form, cuts: list[bytes], run_strings: int) -> DataFrame:
    """Front-coded slices of sorted runs of the strings wanted. Up to SENT places go to the texts, beyond that both meet by a shuffle."""
    places = wanted.groupBy("key").agg(F.collect_list("at").alias("at"))
    places = F.broadcast(places) if wanted.limit(SENT + 1).count() <= SENT else places.hint("merge")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, at, found in contexts(batches, form.before, form.after, run_strings):
            rows = list(sliced(form.of(found, keys, at), cuts))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, _KINDS[c]) for c in ("part", "n", "size", "slice")]))

    return texts.join(places, "key").mapInArrow(each, "part int, n int, size int, slice binary")


def _spans(ranges: DataFrame, undecided: DataFrame | None, n: int) -> DataFrame:
    """(key, spans, open): each text's ranges united, and the undecided strings that aren't within them, as (h, offset)."""
    rows = ranges.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"))
    if undecided is not None:
        rows = rows.join(undecided.groupBy("key").agg(F.collect_list(F.struct("at", "h", "offset")).alias("undecided")), "key", "full")
    else:
        rows = rows.withColumn("undecided", F.lit(None).cast("array<struct<at:bigint,h:bigint,offset:array<int>>>"))
    span, open_ = (pa.list_(pa.struct([(a, pa.int64()), (b, kind)])) for a, b, kind in (("start", "end", pa.int64()), ("h", "offset", pa.int32())))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, left = [], []
            for found, todo in zip(batch.column("ranges"), batch.column("undecided"), strict=True):
                low, high = (found.values.field(c).to_numpy() if found.is_valid else np.zeros(0, "int64") for c in ("low", "high"))
                reach = np.maximum.accumulate(high) if len(high) else high
                new = np.flatnonzero(np.append(True, low[1:] > reach[:-1])[: len(low)])
                start, end = low[new], np.append(reach[new[1:] - 1], reach[-1:])
                spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                more = []
                for u in todo.as_py() or []:
                    p = u["at"] - np.array(u["offset"], "int64")
                    j = np.searchsorted(start, p, side="right") - 1
                    within = (j >= 0) & (end[j] >= p + n) if len(end) else np.zeros(len(p), bool)
                    more += [{"h": u["h"], "offset": u["at"] - x} for x in p[~within].tolist()]
                left.append(more)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, span), pa.array(left, open_)], names=["key", "spans", "open"])

    return rows.select("key", "ranges", "undecided").mapInArrow(each, "key bigint, spans array<struct<start:bigint,end:bigint>>, open array<struct<h:bigint,offset:int>>")


def _kept(keyed: DataFrame, spans: DataFrame, rest: list[str], key: str, z: str) -> DataFrame:
    """The columns passed through, n_bytes, removed and kept."""
    span = "array<struct<start:bigint,end:bigint>>"
    schema = T.StructType([*[keyed.schema[c] for c in rest], *T._parse_datatype_string(f"n_bytes bigint, removed {span}, kept binary").fields])
    of, found = free_name(keyed, "of"), free_name(keyed, "spans")
    rows = keyed.join(spans.select(F.col("key").alias(of), F.col("spans").alias(found)).hint("merge"), F.col(f"`{key}`") == F.col(of), "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in rest], "n_bytes", F.coalesce(F.col(found), F.array().cast(span)).alias("removed"), z)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for length, cuts, packed in zip(*(batch.column(len(rest) + j) for j in range(3)), strict=True):
                text, at, out = pa.decompress(packed.as_py(), length.as_py(), "zstd", asbytes=True), 0, []
                for c in cuts.as_py():
                    out.append(text[at : c["start"]])
                    at = c["end"]
                kept.append(b"".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest) + 2], pa.array(kept, pa.binary())], names=schema.names)

    return rows.mapInArrow(each, schema)


def _repeated(places: DataFrame) -> DataFrame:
    """The anchors whose hash comes up more than once. Hashes that come up very often, HOT at most, are dealt over several tasks."""
    counts = materialize(places.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "counts")
    often = max(HOT_ANCHORS, (counts.agg(F.sum("times")).first()[0] or 0) // HOT)
    hot = counts.where(F.col("times") > often).select("h", F.ceil(F.col("times") / often).cast("int").alias("salts"))  # fewer than HOT rows
    salt = lambda n: F.pmod(F.xxhash64("key", "at"), n).cast("int")
    dealt = places.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(salt(F.col("salts"))))
    found = counts.join(F.broadcast(hot), "h", "left").select("h", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return dealt.join(found, ["h", "salt"], "left_semi").select("h", "key", "at")


def removed(docs: DataFrame, text_col: str = "text", n: int = BYTES, part_strings: int = PART_STRINGS, run_strings: int = RUN_STRINGS) -> DataFrame:
    """`docs` without the text, with n_bytes, removed (structs of start and end, byte ranges in order) and kept (the other bytes)."""
    spark, k = docs.sparkSession, n // 2
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS and c != text_col])
    rest, key, z = [c for c in docs.columns if c != text_col], free_name(docs, "key"), free_name(docs, "z")
    keyed = materialize(_packed(docs, text_col, key, z), "texts")
    texts = keyed.select(F.col(key).alias("key"), "n_bytes", F.col(z).alias("z"))

    places = anchor_rows(texts, n, k)
    wanted = materialize(_repeated(places), "anchors")
    release(spark)
    right, left = right_form(n, k), left_form(n, k)
    cuts = _splitters(texts, wanted, [right, left], part_strings)
    first = materialize(_ordered(_runs(texts, wanted, right, cuts[0], run_strings), lambda part, g: right_order(part, g, right, left, n, k, cuts)), "right")
    release(spark)
    second = materialize(_ordered(first.where("slice IS NOT NULL"), lambda part, g: left_order(part, g, left, n, k, cuts[1])), "left")
    release(spark)
    sure = [f.where("low IS NOT NULL").select("key", "low", "high") for f in (first, second)]
    spans = materialize(_spans(sure[0].unionByName(sure[1]), second.where("offset IS NOT NULL"), n), "spans")
    undecided = spans.select(F.inline("open")).distinct()
    if not undecided.isEmpty():
        # All distinct strings of that k-gram and offset: one for each class of equal surroundings, where its own bounds leave it possible.
        members = second.where("h IS NOT NULL").select("h", "key", "at", "least", "most").join(undecided, "h").where("offset BETWEEN least AND most")
        again = materialize(members.select("key", (F.col("at") - F.col("offset")).alias("at")).distinct(), "strings")
        whole = Form(0, n, np.arange(n), n)
        cut = _splitters(texts, again, [whole], part_strings)[0]
        third = _ordered(_runs(texts, again, whole, cut, run_strings), lambda part, g: whole_order(part, g, whole, n, cut))
        known = spans.select("key", F.inline("spans")).select("key", F.col("start").alias("low"), F.col("end").alias("high"))
        before, spans = spans, materialize(_spans(known.unionByName(third.select("key", "low", "high")), None, n), "spans")
        remove(spark, again, before)
    remove(spark, wanted, first, second)
    release(spark)
    return _kept(keyed, spans, rest, key, z)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple], n: int = BYTES) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from a count of all strings of n bytes, for tests."""
    import hashlib
    from collections import Counter

    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(t[a : a + n] for _, t in texts for a in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - n + 1):
            if times[t[a : a + n]] > 1:
                gone[a : a + n] = b"\1" * n
        spans = sum(g and not (a and gone[a - 1]) for a, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
