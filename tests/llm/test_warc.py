"""Archives: records that are read alone in a batch."""

import hashlib

from chronolens.llm import warc


def test_record_without_payload_alone_in_a_batch(spark, tmp_path):
    """A batch is full behind a payload of more than 4 MB; the metadata record after it is the file's last, without digest or payload."""
    html = "é" * (5 << 20)
    spark.createDataFrame([(7, "http://a/b", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op10_warc(spark, str(tmp_path)).collect()
    payload = html.encode()
    assert [tuple(r) for r in got] == [(7, len(payload), hashlib.sha256(payload).hexdigest(), "response", None, "http://a/b", True)]
