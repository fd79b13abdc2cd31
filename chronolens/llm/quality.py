"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, held against quantiles by language.

Trusted documents are those labelled of quality 1 and not toxic in all their labels. Four fifths of them, dealt by a
hash of doc_id, fit the model, however many there are; the other fifth, which the model didn't see, sets the thresholds. A language's threshold is a quantile of the perplexities of its trusted documents
outside the fit; a language with fewer than `LEAST` of them takes that of all languages together. The quantile is the
same for all languages: that of `QUANTILES` for which the share of these trusted documents kept exceeds the share
of documents labelled of quality 0 kept by most (the highest of equal ones). A document is kept when its perplexity is at most its threshold.

Edge cases: null or empty text has no perplexity and isn't kept. A null lang counts as `und`. Without any trusted
document outside the fit there is no threshold and every document with text is kept. Repeated rows get equal results. Very long texts are
scored whole. Empty documents give an empty result; with empty labels there is no model but the uniform one, and no threshold.
Columns beside doc_id, text and lang are left aside, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram
from .common import materialize, table

ORDER = 5
FIT_SHARE = 0.8
QUANTILES = (0.8, 0.85, 0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.985, 0.99, 0.995, 1.0)
LEAST = 30


def judged_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted, junk) of every labelled document; trusted: quality 1 and not toxic in all labels, junk: quality 0 in one."""
    of = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return of.select("doc_id", F.expr("coalesce(q = 1 AND t = 0, false)").alias("trusted"), F.expr("coalesce(q = 0, false)").alias("junk"))


def trusted_ids(labels: DataFrame, fit_docs: int | None = None) -> DataFrame:
    """(doc_id, fit) of every trusted document; `fit` holds for four fifths of them, and for about `fit_docs` at most if that is given."""
    of = judged_ids(labels).where("trusted").select("doc_id")
    share = FIT_SHARE if fit_docs is None else min(FIT_SHARE, fit_docs / max(1, of.count()))
    return of.withColumn("fit", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1_000_003)) < share * 1_000_003)


def thresholds(held: DataFrame, junk: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> tuple[DataFrame, float | None]:
    """(lang, threshold), and the threshold of other languages, from (lang, perplexity) of trusted and of junk documents."""
    q = F.percentile_approx("perplexity", F.lit(list(quantiles)), F.lit(10_000))
    of_all = held.agg(q).first()[0]
    of_lang = materialize(held.groupBy("lang").agg(q.alias("at"), F.count("*").alias("n")).where(F.col("n") >= LEAST).select("lang", "at"), "quantiles")
    if of_all is None:
        return of_lang.select("lang", F.col("at")[0].alias("threshold")), None
    rest = F.array(*[F.lit(float(x)) for x in of_all])

    def kept(rows: DataFrame) -> list[float]:
        at = rows.join(of_lang, "lang", "left").withColumn("at", F.coalesce("at", rest))
        return [x or 0.0 for x in at.agg(*[F.avg((F.col("perplexity") <= F.col("at")[k]).cast("double")) for k in range(len(quantiles))]).first()]

    gain = [a - b for a, b in zip(kept(held), kept(junk), strict=True)]
    best = max(range(len(quantiles)), key=lambda k: (gain[k], quantiles[k]))
    return of_lang.select("lang", F.col("at")[best].alias("threshold")), float(of_all[best])


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, fit_docs: int | None = None) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold and keep of each document (doc_id, text, lang)."""
    ids = materialize(trusted_ids(labels, fit_docs), "trusted")
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit("und")).alias("lang"))
    fit = docs.join(F.broadcast(ids.where("fit")), "doc_id", "left_semi")
    model = ngram.estimate(ngram.count(fit, "text", order), order, ngram.CODE_POINTS)
    scored = ngram.score(docs, "text", {"logp": model}, order, vocabulary=ngram.CODE_POINTS).select("doc_id", "lang", "n_tokens", F.when(F.col("n_tokens") > 0, F.exp(-F.col("logp") / F.col("n_tokens"))).alias("perplexity"))
    scored = materialize(scored, "perplexities")
    judged = scored.where("perplexity IS NOT NULL")
    of_lang, rest = thresholds(judged.join(ids.where("NOT fit"), "doc_id", "left_semi"), judged.join(judged_ids(labels).where("junk"), "doc_id", "left_semi"))
    out = scored.join(of_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(rest).cast("double")))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", keep.alias("keep"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
