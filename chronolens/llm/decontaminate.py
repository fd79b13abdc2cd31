"""Benchmark decontamination: one Aho-Corasick automaton over windows of benchmark words.

Texts are normalised alike on both sides: A-Z is lower-cased, and words are runs of digits, letters and
non-ASCII characters. A window is `n` consecutive words of an item (an item of fewer words, but not none,
is one window). The automaton holds every distinct window, between word breaks, and each text is scanned
once; a match's place in the normalised text maps back to word numbers and to code-point offsets in the
original text.

The automaton goes to the executors only up to `max_bytes` of windows. A larger benchmark is dealt into
blocks of whole items below that size, each with an automaton of its own. The texts pass through the
blocks one after the other without a shuffle and are written with what was found after each, so that a worker holds
one automaton and the driver one block at a time; the result doesn't depend on the number of blocks.

Edge cases: null or empty text, or text without words, has no words, no hit and no items. An item
without words, or null, never matches. Items that repeat an item_id count once. Repeated rows each get
their own result. A very long text is scanned whole, in one pass. Empty documents give an empty result. Columns of the input
pass through; result columns replace input columns of that name.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, materialize, remove, table

WINDOW = 10
MAX_BYTES = 64 << 20
#: ASCII to itself in lower case where it belongs to a word, else to a space; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or chr(b).islower() else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

_LOWER = {c: c + 32 for c in range(65, 91)}

#: Automatons of this Python worker, by block: tasks of one worker build it once.
_BUILT: dict = {}

STATE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def windows(text: str | None, n: int = WINDOW) -> set[bytes]:
    w = words(text)
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def automaton(owner: dict[bytes, list[int]]):
    """Patterns are held as Latin-1 strings of their UTF-8 bytes, with a space at either end."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for window, ids in owner.items():
        found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, ids))
    if owner:
        found.make_automaton()
    return found


def scan(text: str | None, machine, any_patterns: bool = True) -> tuple[int, list[int], set[int]]:
    """Words of the text, the numbers of those hit, and the items that occur."""
    w = words(text)
    if not w or not any_patterns:
        return len(w), [], set()
    line = f" {b' '.join(w).decode('latin-1')} "
    spans, items = [], set()
    for end, (length, ids) in machine.iter(line):
        spans.append((end, length))
        items.update(ids)
    hit: set[int] = set()
    done_end, done_words = 0, 0
    for end, length in spans:  # in order of their ends, so the breaks before an end are counted on from the last one
        done_words += line.count(" ", done_end, end)
        done_end = end
        hit.update(range(done_words - length, done_words))
    return len(w), sorted(hit), items


def spans_in_original(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Code-point ranges [start, end) of runs of hit words."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out: list[tuple[int, int]] = []
    for a in hit:
        if out and last == a - 1:
            out[-1] = (out[-1][0], at[a][1])
        else:
            out.append(at[a])
        last = a
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """(item_id, text) of whole items, in blocks of at most `max_bytes` of text (or a single larger item)."""
    size, block = 0, []
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    for r in rows.toLocalIterator():
        if block and size + len(r.t) * 12 > max_bytes:  # a word is in as many windows as a window has words
            yield block
            size, block = 0, []
        block.append((r.i, r.t))
        size += len(r.t) * 12
    if block:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = WINDOW, max_bytes: int = MAX_BYTES, spans: bool = False,
) -> DataFrame:
    """`docs` with n_words, n_hit, n_items (long), items (sorted strings), contaminated, and with `spans` also
    hit_spans, the code-point ranges of the hits in the original text."""
    spark, state = docs.sparkSession, free_name(docs, "state")
    found = docs.drop(*[c for c in docs.columns if c.lower() in {"n_words", "n_hit", "n_items", "items", "contaminated", "hit_spans"} and c != text_col])
    columns = found.columns
    found = found.withColumn(state, F.lit(None).cast(STATE))
    rest = blocks(benchmark, item_id, item_text, max_bytes)
    block, written = next(rest, []), None
    while block is not None:
        found, block = _pass(spark, found, block, text_col, state, n), next(rest, None)
        if block is not None:  # the next block's automaton meets the texts in tasks of its own
            found, done = materialize(found, "scanned"), written
            written = found
            if done is not None:
                remove(spark, done)
    s = F.col(state)
    out = found.select(*columns, s["n_words"].alias("n_words"), F.size(s["hit"]).cast("long").alias("n_hit"), F.size(s["items"]).cast("long").alias("n_items"), s["items"].alias("items"), (F.size(s["hit"]) > 0).alias("contaminated"), *([s["hit"].alias(state)] if spans else []))
    if spans:
        @F.pandas_udf("array<struct<start:int,end:int>>")
        def place(text: pd.Series, hit: pd.Series) -> pd.Series:
            return pd.Series([[{"start": a, "end": b} for a, b in spans_in_original(t, list(h))] if t is not None and len(h) else [] for t, h in zip(text, hit, strict=True)])

        out = out.withColumn("hit_spans", place(F.col(text_col), F.col(state))).drop(state)
    return out


def _pass(spark: SparkSession, df: DataFrame, block: list, text_col: str, state: str, n: int) -> DataFrame:
    """Add the hits and items of one block of the benchmark to `state`."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

    @F.pandas_udf(STATE)
    def step(text: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        if name not in _BUILT:
            _BUILT.clear()
            owner: dict[bytes, list] = {}
            for item, item_text in sent.value:
                for window in windows(item_text, n):
                    owner.setdefault(window, []).append(item)
            _BUILT[name] = (automaton(owner), bool(owner))
        machine, some = _BUILT[name]
        give_back()
        rows = []
        for t, hit0, items0 in zip(text, before["hit"], before["items"], strict=True):
            n_words, hit, items = scan(t, machine, some)
            hit = hit if hit0 is None else sorted({*hit0, *hit})
            items = items if items0 is None else items | set(items0)
            rows.append((n_words, hit, sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "hit", "items"])

    return df.withColumn(state, step(F.col(text_col), F.col(state)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def brute(docs: list[tuple], items: list[tuple], n: int = WINDOW) -> list[tuple]:
    """The same rows from plain loops over words, for tests."""
    out = []
    owned = [(str(i), [w.decode() for w in words(t)]) for i, t in items if i is not None and t is not None]
    for doc_id, text in docs:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in _WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))]
        hit, which = set(), set()
        for i, iw in owned:
            m = min(n, len(iw))
            for a in range(len(iw) - m + 1 if m else 0):
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == iw[a : a + m]:
                        hit.update(range(b, b + m))
                        which.add(i)
        out.append((doc_id, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit)))
    return out


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bm AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bm) WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, m, i FROM dw JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
