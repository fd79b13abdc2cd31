"""The input shapes of the reference-side operators, as DataFrames over the given tables, with the same in SQL.

`scored` is a manifest with five score columns, `generators` its registry, `curves` likelihood ratios by item
and family, `vectors` feature vectors with group columns, `doc_scores` a small labelled score table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = ["s1", "s2", "s3", "s4", "s5"]
#: Release dates of the families of `curves`.
CURVE_DATES = {"click": "2017-03-30", "error": "2018-06-10", "purchase": "2019-01-01", "signup": "2020-12-17", "view": "2021-07-01"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r, lines = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region", "lineitem"))
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))
    places = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey))  # 25 rows
    joined = o.join(c, o.o_custkey == c.c_custkey).join(places, c.c_nationkey == places.n_nationkey).join(per_order, "o_orderkey", "left")
    real = F.col("o_orderstatus") == "O"
    days = (F.col("n_nationkey") - F.col("n_nationkey") % 2) * 48 + (F.col("n_nationkey") % 2) * 3
    zero = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    return joined.select(
        F.col("o_orderkey").alias("item_id"), F.when(real, 0).otherwise(1).alias("label"), F.when(real, "authentic").otherwise(F.col("r_name")).alias("family"),
        F.when(~real, F.col("n_name")).alias("generator"), F.when(~real, F.date_add(F.lit("2017-01-01").cast("date"), days)).alias("release_date"),
        F.when(real, F.col("o_orderpriority")).otherwise("fake").alias("source"),
        F.when(F.substring(F.md5(F.concat(F.lit("1234:"), F.col("o_orderkey").cast("string"))), 1, 1) < "8", "train").otherwise("val").alias("split"),
        (200 + F.col("o_custkey") % 3000).alias("source_width"), (200 + F.col("o_orderkey") % 2000).alias("source_height"),
        F.col("o_totalprice").alias("s1"), F.col("c_acctbal").alias("s2"), zero("lines").alias("s3"), zero("price").alias("s4"), zero("discount").alias("s5"),
    )


SCORED = """per_order AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS price, avg(l_discount) AS discount FROM lineitem GROUP BY l_orderkey),
scored AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS label, CASE WHEN o_orderstatus = 'O' THEN 'authentic' ELSE r_name END AS family,
  CASE WHEN o_orderstatus <> 'O' THEN n_name END AS generator,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(DATE '2017-01-01' + CAST((n_nationkey - n_nationkey % 2) * 48 + (n_nationkey % 2) * 3 AS INTEGER) AS DATE) END AS release_date,
  CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'fake' END AS source, CASE WHEN substr(md5('1234:' || o_orderkey), 1, 1) < '8' THEN 'train' ELSE 'val' END AS split,
  200 + o_custkey % 3000 AS source_width, 200 + o_orderkey % 2000 AS source_height, o_totalprice AS s1, c_acctbal AS s2,
  CAST(coalesce(n_lines, 0) AS DOUBLE) AS s3, coalesce(price, 0) AS s4, coalesce(discount, 0) AS s5
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN per_order ON l_orderkey = o_orderkey)"""


def generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("label = 1").groupBy("generator", "family", "release_date").agg(F.count("*").alias("n"))


GENERATORS = SCORED + ", generators AS (SELECT generator, family, release_date, count(*) AS n FROM scored WHERE label = 1 GROUP BY ALL)"


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    lr = F.avg(F.exp(F.col("value") / 100 - 1)).alias("lr")
    dates = F.create_map(*[F.lit(x) for kv in CURVE_DATES.items() for x in kv])
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("family")).agg(lr).withColumn("date", dates[F.col("family")].cast("date"))


CURVES = (
    "curves AS (SELECT user_id AS item, event_type AS family, avg(exp(value / 100 - 1)) AS lr, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN DATE '{v}'" for k, v in CURVE_DATES.items())
    + " END AS date FROM events GROUP BY ALL)"
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.col("embedding").alias("x"), F.col("label").alias("generator"), (F.col("label") % 2).alias("family"), (F.col("vec_id") % 4).cast("int").alias("origin"),
        F.date_add(F.lit("2018-01-01").cast("date"), F.col("label") * 120).alias("release_date"),
    )


VECTORS = "vectors AS (SELECT vec_id, embedding AS x, label AS generator, label % 2 AS family, CAST(vec_id % 4 AS INTEGER) AS origin, CAST(DATE '2018-01-01' + label * 120 AS DATE) AS release_date FROM embeddings)"


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", F.log(1.0 + F.col("n_chars")).alias("score"), F.col("quality").alias("y"), "toxic", "lang", "source")


DOC_SCORES = "doc_scores AS (SELECT doc_id, ln(1.0 + n_chars) AS score, quality AS y, toxic, lang, source FROM documents JOIN labels USING (doc_id))"
