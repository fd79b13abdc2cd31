"""Language-model scoring by cross-entropy difference (Moore and Lewis).

The target model is of every trusted document, the background model of every document of the corpus. Both are
character models of the same order and vocabulary, all code points, with the same smoothing, so their losses compare
token by token. A document's score is its mean loss per token under the target model less that under the background
model; lower is nearer to the target.

Edge cases: null or empty text has no tokens, and null losses and score. Without target documents the target
model is uniform over the vocabulary. Repeated rows get equal results; they count as often as they come in
the background. Very long texts are scored whole. An empty table gives an empty result. Columns of the input pass through;
n_tokens, target_loss, background_loss and score replace input columns of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram
from .common import table
from .quality import trusted_ids

ORDER = 5


def difference(docs: DataFrame, target: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """`docs` with n_tokens, target_loss, background_loss (nats per token) and score."""
    models = {name: ngram.estimate(ngram.count(of, text_col, order), order, ngram.CODE_POINTS) for name, of in (("target_loss", target), ("background_loss", docs))}
    out = ngram.score(docs.drop("n_tokens", "score", *models), text_col, models, order, vocabulary=ngram.CODE_POINTS)
    for name in models:
        out = out.withColumn(name, F.when(F.col("n_tokens") > 0, -F.col(name) / F.col("n_tokens")))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = docs.join(trusted_ids(table(spark, sf_dir, "labels")), "doc_id", "left_semi")
    return difference(docs, target).select("doc_id", "n_tokens", "target_loss", "background_loss", "score")
