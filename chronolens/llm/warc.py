"""WARC archives: write captures as records, read them back, assemble transactions.

Writing. A page becomes three records: a request and a metadata record that name the capture's main record in
WARC-Concurrent-To, and the main record itself. Of pages with equal payloads of at least `min_bytes` bytes,
the one with the smallest (page_id, url) is a response; the others are revisits that name it in
WARC-Refers-To and carry HTTP headers without the payload. Record ids are made from page_id, url, payload
digest and the number of the copy, so a task that runs again writes the same records. A record is one row of
Spark's text sink with the record terminator as line separator: Spark's commit protocol and any file system
that it writes to serve for archives too. Files are gzip and hold about `file_bytes` of payload.

Reading. Archives are read as binary files and parsed by Content-Length in a stream, so payloads may hold
anything; payload digest and length are computed anew and a mismatch with the header raises an error.

Assembly. Request, response (or revisit) and metadata records meet by their concurrent-to identifier in one
shuffle, in any order and from any files; a capture is one nested row.

Edge cases: null html is an empty payload. Null page_id or url stays null. Rows with a null page_id sort after
all others; they can be a response only where no row has a page_id. Repeated rows are captures of their own:
the first copy may be the response, further copies revisit it. Payloads under `min_bytes` are responses. An
empty table gives an empty folder of archives and no captures. A payload is one value of a row, so it has to be below 2 GB.
Columns beside page_id, url and html aren't written.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, new_folder, table

MIN_BYTES = 100
FILE_BYTES = 24 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "digest")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.StringType()), T.StructField("fields", T.StringType())]
)


def _key(page_id: Column, url: Column, digest: Column) -> Column:
    """32 hex digits for a page's id, url and payload; nulls differ from every value."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))
    return F.md5(F.concat_ws("\n", part(page_id), digest, part(url)))


def _urn(kind: str, key: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), key, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A whole record without its terminator; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value)) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, length), F.lit(CRLF * 2), block)


def roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """A row for each distinct (page_id, url, payload): its key and the key of the response, null where it is the response."""
    narrow = pages.select("page_id", "url", "digest", "bytes", "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "digest", "bytes")], F.count("*").alias("copies"))
    order = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    firsts = narrow.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(order).alias("f"), F.sum("copies").alias("n")).where("n > 1")
    firsts = firsts.select("digest", _key(F.col("f.page_id"), F.col("f.url"), F.col("digest")).alias("first_key"))
    return narrow.select("key", "digest").join(firsts, "digest").select("key", "first_key")


def records(pages: DataFrame, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The text of each record, in partitions of about `file_bytes` of payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("digest"))
    pages = pages.withColumn("key", _key(F.col("page_id"), F.col("url"), F.col("digest")))
    total = pages.agg(F.sum("bytes")).first()[0] or 0
    dealt = pages.repartition(max(1, -(-total // file_bytes)), "key")
    joined = dealt.join(roles(pages, min_bytes), "key", "left").withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    revisit = F.col("first_key").isNotNull() & ((F.col("first_key") != F.col("key")) | (F.col("copy") > 1))
    c = joined.select(
        "page_id", "url", "html", "bytes", "digest", revisit.alias("revisit"), _urn("main", F.col("key"), F.col("copy")).alias("id"),
        _urn("request", F.col("key"), F.col("copy")).alias("request_id"), _urn("metadata", F.col("key"), F.col("copy")).alias("metadata_id"),
        F.when(revisit, _urn("main", F.col("first_key"), F.lit(1))).alias("refers_to"),
        F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20").alias("uri"),
    )
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), "^[a-z]+://([^/?#]*)", 1)
    request = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract(F.coalesce("uri", F.lit("")), "^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    common = [("WARC-Target-URI", F.col("uri")), ("WARC-Date", DATE)]
    main = _record(
        [("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("id")), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))), ("WARC-Refers-To", F.col("refers_to")), ("Content-Type", "application/http;msgtype=response")],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))),
    )
    asked = _record([("WARC-Type", "request"), ("WARC-Record-ID", F.col("request_id")), ("WARC-Concurrent-To", F.col("id")), *common, ("Content-Type", "application/http;msgtype=request")], request)
    about = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", F.col("metadata_id")), ("WARC-Concurrent-To", F.col("id")), *common, ("Content-Type", "application/json")], F.to_json(F.struct("page_id", "url")))
    return c.select(F.explode(F.array(asked, main, about)).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    records(pages, min_bytes, file_bytes).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parse(stream) -> Iterator[dict]:
    """The records of one archive, uncompressed, one at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record where one should begin: {line[:60]!r}")
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        kind = headers["warc-type"]
        row = {c: headers.get(h) for c, h in (("record_id", "warc-record-id"), ("concurrent_to", "warc-concurrent-to"), ("refers_to", "warc-refers-to"), ("target_uri", "warc-target-uri"), ("date", "warc-date"))} | {"type": kind}
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            stated = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split(CRLF)[1:])}
            digest = headers["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or int(stated["content-length"]) != len(payload)):
                raise ValueError(f"payload of {row['record_id']} isn't the one that was written")
            row |= {"digest": digest, "payload_bytes": int(stated["content-length"]), "payload": payload.decode("utf-8") if kind == "response" else None}
        elif kind == "metadata":
            row["fields"] = block.decode("utf-8")
        yield row


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in a folder.

    Batches have about 4 MB of payload, so one may hold a single request or metadata record. Its types are stated and not found from
    the rows: a column without a value would count as doubles."""
    schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in RECORD.names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column("content"):
                held, size = [], 0
                for row in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)):
                    held.append(row)
                    size += len(row.get("payload") or "")
                    if size > 4 << 20 or len(held) == 10000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(rows, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """A nested row for each capture: its main record, its request and its metadata. `payload` may have been dropped."""
    of = [c for c in found.columns if c not in ("concurrent_to", "fields")]
    pick = lambda kinds, cols: F.first(F.when(F.col("type").isin(*kinds), F.struct(*cols)), ignorenulls=True)
    return found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        pick(["response", "revisit"], of).alias("main"), pick(["request"], ["record_id", "target_uri", "date"]).alias("request"), pick(["metadata"], ["record_id", "fields"]).alias("metadata"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    meta = F.from_json("metadata.fields", "page_id long, url string")
    captures = materialize(
        assemble(read_records(spark, path).drop("payload")).select(
            "capture_id", meta["page_id"].alias("page_id"), meta["url"].alias("url"), F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.digest").alias("payload_digest"),
            F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("to"), (F.col("request.record_id").isNotNull()).alias("has_request"),
        ),
        "captures",
    )
    targets = captures.where("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    # Only revisits have a target to look up; a join of all captures would deal those without one to one task.
    found = captures.where("to IS NOT NULL").join(targets, "to", "left").unionByName(captures.where("to IS NULL").withColumn("refers_to", F.lit(None).cast(captures.schema["page_id"].dataType)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "has_request")


OP10_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to,
       url, true AS has_request
FROM f
"""

