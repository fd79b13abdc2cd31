"""Language identification by words, backing off to character n-grams for words never seen.

Fitting. A word is a run of letters and marks, lower-cased. Words and their character n-grams (1 to 4, over the word with
a blank at either end) of labelled texts are counted per language; counts are summed in each task before the shuffle. The
fit reads a bounded sample of labelled documents, chosen by a hash: about `fit_docs` of each language, and about `FIT_TOTAL`
in all, shared equally where there are many languages, so no language is left out. Every word and n-gram of the sample is
in the model, unless `max_words` asks for the most frequent of each language alone. A word or n-gram is known by a
64-bit hash, so the model is arrays of numbers: for each word and n-gram, the languages that have it and their log frequencies.

Scoring. A known word scores its log relative frequency in each language. An unknown word scores by its
longest n-grams of which any is known: the mean log relative frequency of those n-grams. A language that
lacks the word or n-gram gets a floor, the same for all languages. A document adds its words' scores; the prediction is the best language
and the score its share in a softmax of the mean score per word over at most `EVIDENCE` words. Scoring covers
every word of the whole text, in pieces of about 250,000 characters; texts of a batch are taken out of it piece by piece.

Edge cases: null text, empty text and text without a letter are `und` with score 0. Ties go to the language
that sorts first. Without any labelled row every text is `und`, and without texts there is no row. Null labels aren't
learned from. Repeated rows get equal results. Very long texts are read whole. Columns of the input pass through; lang_pred
and score replace input columns of that name.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, give_back, row_hash, table

FIT_DOCS = 8_000
FIT_TOTAL = 64_000
ORDERS = (4, 3, 2, 1)
EVIDENCE = 30
MAX_BROADCAST = 20_000  # languages whose shares are sent to the tasks; of more, the join is an ordinary one
UND = "und"
_PIECE = 1 << 18
_HELD = 400_000  # rows of counts that a task of the fit holds before it adds them up
_BREAK = re.compile(r"[\s\d]")
_U = np.uint64
_MODELS: dict = {}


@cache
def _classes() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark, else 0."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def pieces(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in lower case as code points, about _PIECE at a time, with the number of the text of each; texts end in a line break."""
    held, of, size = [], [], 0
    for i, t in enumerate(texts):
        at, t = 0, t.lower() if t else ""
        while at < len(t):
            end = len(t)
            if end - at > _PIECE and (cut := _BREAK.search(t, at + _PIECE)):
                end = cut.start() + 1
            held.append(t[at:end] + "\n")
            of.append(i)
            size += end - at + 1
            at = end
            if size > _PIECE:
                yield _joined(held, of)
                held, of, size = [], [], 0
    if held:
        yield _joined(held, of)


def _joined(held: list[str], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.repeat(np.array(of), [len(t) for t in held])


class Words:
    """The words of a piece: the text of each, its hash, and its place among the code points."""

    def __init__(self, codes: np.ndarray, of: np.ndarray):
        kind = _classes()[codes]
        edge = np.diff(np.concatenate([[0], (kind > 0).view(np.int8), [0]]).astype(np.int8))
        self.codes, self.start, self.end = codes, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.of = of[self.start]
        self.lettered = np.unique(of[kind == 2])
        n = self.end - self.start
        spread, at = _ranges(n)
        h = np.zeros(len(n), _U)
        place = _mix(codes[self.start[spread] + at].astype(_U) + (at.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        if len(n):
            h = np.add.reduceat(place, np.concatenate([[0], np.cumsum(n)[:-1]]))
        self.hash = _mix(h + n.astype(_U))

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the n-grams of the words `which`; with blanks at either end, but for single characters."""
        pad = int(n > 1)
        length = self.end[which] - self.start[which] + 2 * pad
        count = np.maximum(0, length - n + 1)
        word, at = _ranges(count)
        h = np.zeros(len(word), _U)
        for j in range(n):
            k = self.start[which][word] + at + j - pad
            inside = (k >= self.start[which][word]) & (k < self.end[which][word])
            h = _mix(h + np.where(inside, self.codes[np.where(inside, k, 0)], 32).astype(_U) * _U(2 * j + 3))
        return word, h


def _ranges(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0..n[0]-1, 0..n[1]-1, ... in one array, and before it the number of the range of each."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _counted(texts: list[str]) -> Iterator[pd.DataFrame]:
    """(n, token, c) of the words (n is 0) and n-grams of texts of one language, in parts."""
    for piece in pieces(texts):
        words = Words(*piece)
        words_in = np.isin(words.of, words.lettered)
        token, first, c = np.unique(words.hash[words_in], return_index=True, return_counts=True)
        first = np.flatnonzero(words_in)[first]
        yield pd.DataFrame({"n": 0, "token": token.view(np.int64), "c": c})
        for n in ORDERS:
            word, h = words.grams(first, n)
            token, of = np.unique(h, return_inverse=True)
            yield pd.DataFrame({"n": n, "token": token.view(np.int64), "c": np.bincount(of, c[word], len(token)).astype(np.int64)})


class Model(NamedTuple):
    """A row for each language and each word (n is 0) or n-gram of length n in it: the language's number, n, the hash and the count."""

    langs: list[str]
    lang: np.ndarray
    n: np.ndarray
    token: np.ndarray
    c: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, max_words: int | None = None, total: int = FIT_TOTAL) -> Model:
    """The model of a sample of labelled documents. What reaches the driver is its rows, as arrays of numbers, and the languages' names."""
    pick = F.pmod(row_hash(docs), F.lit(1_000_003))
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), pick.alias("pick"))
    sizes = {r.lang: r.size_ for r in docs.groupBy("lang").agg(F.count("*").alias("size_")).collect()}  # a row for each language
    langs = sorted(sizes)
    number = {x: i for i, x in enumerate(langs)}
    each = max(1, min(fit_docs, total // max(1, len(langs))))
    shares = docs.sparkSession.createDataFrame([(x, each / n) for x, n in sizes.items()], "lang string, share double")
    if len(langs) <= MAX_BROADCAST:
        shares = F.broadcast(shares)
    chosen = docs.join(shares, "lang").where(F.col("pick") < F.col("share") * 1_000_003).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            for lang, texts in b.groupby("lang", sort=False)["text"]:
                for part in _counted(texts.tolist()):
                    held.append(part.assign(lang=number[lang]))
                    if sum(map(len, held)) > _HELD:
                        held = [pd.concat(held).groupby(["lang", "n", "token"], as_index=False)["c"].sum()]
                        if len(held[0]) > _HELD // 2:
                            yield held.pop()[["lang", "n", "token", "c"]]
        if held:
            yield pd.concat(held).groupby(["lang", "n", "token"], as_index=False)["c"].sum()[["lang", "n", "token", "c"]]
        held.clear()
        give_back()

    sums = chosen.mapInPandas(count, "lang int, n int, token long, c long").groupBy("lang", "n", "token").agg(F.sum("c").alias("c"))
    if max_words is not None:
        kind = (F.col("n") > 0).alias("grams")
        order = Window.partitionBy("lang", kind).orderBy(F.desc("c"), "n", "token")
        sums = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_words).drop("rank")
    rows = sums.select("lang", F.col("n").cast("byte").alias("n"), "token", F.col("c").cast("int").alias("c")).toArrow()  # bounded by the sample
    return Model(langs, *(rows.column(c).to_numpy() for c in ("lang", "n", "token", "c")))


class Scorer:
    """The model in a task: for each length, sorted hashes, and for each of them the languages that have it with their log
    frequency above the floor. The floor itself, the same for all languages, changes no prediction and no score."""

    def __init__(self, model: Model):
        self.langs, self.levels = model.langs if len(model.lang) else [], []
        for n in range(5):
            of = model.n == n
            lang, c = model.lang[of], model.c[of].astype(float)
            totals = np.bincount(lang, c, minlength=len(self.langs)) + 1.0
            above = np.log(c / totals[lang]) - np.log(0.5 / totals.max(initial=1.0))
            token = model.token[of].view(_U)
            by = np.lexsort((lang, token))
            key, first = np.unique(token[by], return_index=True)
            self.levels.append((key, np.append(first, len(by)), lang[by].astype(np.int32), above[by].astype(np.float32)))

    def _found(self, n: int, h: np.ndarray) -> np.ndarray:
        """The place of each hash among those known, or -1."""
        key = self.levels[n][0]
        if not len(key):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(key, h), len(key) - 1)
        return np.where(key[k] == h, k, -1)

    def _entries(self, n: int, which: np.ndarray, place: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, language, value) for each language of each known token."""
        _, first, lang, above = self.levels[n]
        part, at = _ranges(first[place + 1] - first[place])
        k = first[place][part] + at
        return which[part], lang[k], above[k] * weight[part]

    def _rows(self, words: Words, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of distinct words with hash h, each given by the number of its first occurrence."""
        place = self._found(0, h)
        known = np.flatnonzero(place >= 0)
        out, left = [self._entries(0, known, place[known], np.ones(len(known)))], np.flatnonzero(place < 0)
        for n in ORDERS:
            if not len(left):
                break
            word, g = words.grams(first[left], n)
            place = self._found(n, g)
            seen = place >= 0
            m = np.bincount(word[seen], minlength=len(left))
            out.append(self._entries(n, left[word[seen]], place[seen], 1.0 / m[word[seen]]))
            left = left[m == 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def score(self, texts: Iterable[str | None], size: int | None = None) -> tuple[list[str], np.ndarray]:
        """Prediction and score of each text; `size` says how many there are where they have no length."""
        size = len(texts) if size is None else size
        langs = max(1, len(self.langs))
        total, n, lettered = np.zeros((size, langs)), np.zeros(size), np.zeros(size, bool)
        for piece in pieces(texts):
            words = Words(*piece)
            lettered[words.lettered] = True
            if not len(words.hash) or not self.langs:
                continue
            h, first, of = np.unique(words.hash, return_index=True, return_inverse=True)
            which, lang, value = self._rows(words, first, h)
            by = np.argsort(which, kind="stable")
            begin = np.searchsorted(which[by], np.arange(len(h) + 1))
            part, at = _ranges(begin[of + 1] - begin[of])
            k = by[begin[of][part] + at]
            low, texts_in = words.of[0], words.of[-1] - words.of[0] + 1
            total[low : low + texts_in] += np.bincount((words.of[part] - low) * langs + lang[k], value[k], texts_in * langs).reshape(texts_in, langs)
            n[low : low + texts_in] += np.bincount(words.of - low, minlength=texts_in)
        x = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
        best = x.argmax(axis=1)
        share = 1.0 / np.exp(x - x[np.arange(size), best][:, None]).sum(axis=1)
        given = lettered & (n > 0) & bool(self.langs)
        return [self.langs[b] if g else UND for b, g in zip(best, given, strict=True)], np.where(given, share, 0.0)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Scorer(sent.value)
        give_back()
        lang, score = _MODELS[name].score((t.as_py() for t in text), len(text))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"lang_pred", "score"}])
    found = free_name(docs, "found")
    return docs.withColumn(found, predict(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{found}`.lang_pred").alias("lang_pred"), F.col(f"`{found}`.score").alias("score"))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the doc_id as text, modulo 4, is 2. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
