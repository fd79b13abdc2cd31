"""What the quality model learns from."""

from chronolens.llm import quality


def test_the_fit_takes_four_fifths_of_any_number_of_trusted_documents(spark):
    labels = spark.range(200_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    ids = quality.trusted_ids(labels)
    assert ids.count() == 200_000 and 158_000 < ids.where("fit").count() < 162_000
