"""The corpus pipeline: documents to shuffled shards in five stages, each an operator of chronolens.llm.

1. language_id: a language is predicted for every text; `und` and predictions below `MIN_SCORE` go.
2. near_duplicates: classes by shingles of five words and a Jaccard likeness of 0.8; the row with the smallest
   doc_id of each class stays.
3. decontaminate: documents that hold a window of ten words of a benchmark item go.
4. mix: sources are mixed to weights size ** 0.7 by Poisson replication; a document comes out 0, 1 or more times.
5. shard: eight shards, shuffled; adds shard, slot and grown_shard.

A stage gets the documents that the one before it wrote, decides over all of them, and returns their columns;
the last adds its own. Stages but the fourth keep all clean documents.

Edge cases, for every stage: an empty table gives an empty table of the same columns; columns beside those that a stage
reads (doc_id, text, lang, source) pass through, whatever their names; very long texts are read whole. Each stage says what
it does with nulls, ties and repeated rows. Tables between stages are deleted once the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.llm import decontaminate, jaccard, langid, mixing, sharding
from chronolens.llm.common import materialize, remove, table

MIN_SCORE = 0.35
#: Shards are shuffled in smaller buckets than by default: an executor that ran the stages before has less memory left.
BUCKET_BYTES = 8 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts and texts without a letter go. A null lang isn't learned from; without any lang every text is `und`
    and goes. Ties go to the language that sorts first. Repeated rows are decided alike and all stay or go."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words stay, all of them. Of equal smallest ids, the row with the smaller hash of id and text stays; of rows equal
    in both, that with the smallest hash of all columns. A row with a null doc_id stays only where its class has no other id."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without words hold no window and stay. Without benchmark items all stay. Repeated rows are decided alike."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null sources are a source. Equal rows (doc_id and text) come out equally often. A null doc_id or text draws like any other value."""
    return mixing.mix(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null doc_id hashes like a value, a null text is empty. Equal ids share a shard; repeated rows get slots of their own."""
    return sharding.shard(docs, bucket_bytes=BUCKET_BYTES)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: Language scores, hashed shuffles and classes of connected documents aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if k:  # the first reads the given table
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
