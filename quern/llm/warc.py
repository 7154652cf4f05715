"""Content-addressed web archive: payloads once by digest, record headers apart, records rebuilt by joins (all in the JVM).

An archive is a folder with two Parquet tables. `payloads` has each distinct
payload once, under its SHA-256; `records` has the exact header block of every
WARC/1.1 record with the digest of its payload. The record bytes are header,
payload (responses only) and two line ends, so any record is rebuilt bit by bit
by a join on the digest. Reading verifies every payload against its digest and
fails on a difference.

Of the records with equal payloads of at least min_revisit bytes, that with the
largest id is a response and the others are revisits that refer to it; smaller
payloads are always responses. A response's payload is joined once per digest,
and revisits carry none, so a payload shared by a third of all records costs
small rows only. The largest id per digest is a partial aggregate.

Defined cases: null html is the empty payload; a null url is the empty target; a
null id counts as smaller than any other; rows that agree in id and payload are
all responses when theirs is the largest id; an empty table gives an archive
without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import stored, text_of

EOL = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex digest whose length is a multiple of ten: ten hex digits are eight of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS32, _BASE32)


def _utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _record_id(id_: Column) -> Column:
    h = F.md5(F.concat(F.lit("quern-record:"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row per page: page_id, type, refers_to, header, sha256, bytes. No payload moves: rows are cut down to digests before the join."""
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), text_of(url).alias("url"), _utf8(text_of(html)).alias("payload"))
    df = df.select("page_id", "url", F.unhex(F.sha2("payload", 256)).alias("sha256"), base32(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    df = stored(df, "digests")
    last = df.groupBy("sha256").agg(F.max("page_id").alias("last"))
    df = df.join(last, "sha256")
    response = (F.col("bytes") < min_revisit) | F.col("page_id").eqNullSafe(F.col("last"))
    df = df.withColumn("type", F.when(response, "response").otherwise("revisit")).withColumn("refers_to", F.when(~response, F.col("last")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=UTF-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL * 2))
    lines = [
        F.concat(F.lit("WARC/1.1" + EOL + "WARC-Type: "), F.col("type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))),
        F.when(F.col("type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(f"{EOL}WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"), F.lit(f"{EOL}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(F.col("type") == "response", F.col("bytes")).otherwise(0)).cast("string")),
    ]
    header = F.concat(F.concat_ws(EOL, *lines), F.lit(EOL * 2), http)
    return df.select("page_id", "type", "refers_to", _utf8(header).alias("header"), "sha256", "bytes")


def write_archive(pages: DataFrame, path: str, **options: object) -> None:
    """Writes the two tables of an archive into the folder."""
    html = str(options.get("html", "html"))
    payloads = pages.select(_utf8(text_of(html)).alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    payloads.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    records(pages, **options).write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, type, refers_to, header, sha256 and payload (null in revisits). A payload that differs from its digest is an error."""
    blobs = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("sha256"))).cast("binary"))
    blobs = blobs.select(F.col("sha256").alias("key"), checked.alias("payload"))
    recs = spark.read.parquet(f"{path}/records")
    # a null key finds no payload: revisits need none
    recs = recs.withColumn("key", F.when(F.col("type") == "response", F.col("sha256")))
    return recs.join(blobs, "key", "left").drop("key")


def record_bytes(archive: DataFrame) -> DataFrame:
    """read_archive() with record: the exact bytes of the WARC record."""
    return archive.withColumn("record", F.concat(F.col("header"), F.coalesce("payload", F.lit(b"")), F.lit((EOL * 2).encode())))


def field(header: Column, name: str) -> Column:
    """A field of a header block; null if it isn't there."""
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found == "", F.lit(None)).otherwise(found)


def parsed(archive: DataFrame) -> DataFrame:
    """What the records say, read from their bytes: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    The payload of a response is cut out of the record again and must have the digest that the header names.
    """
    df = record_bytes(archive)
    head = F.decode(F.col("header"), "UTF-8")
    df = df.select(
        "record",
        F.octet_length("header").alias("skip"),
        field(head, "WARC-Page-ID").alias("id"),
        field(head, "WARC-Type").alias("record_type"),
        F.regexp_extract(head, "WARC-Payload-Digest: sha1:([A-Z2-7]+)", 1).alias("payload_digest"),
        F.element_at(F.regexp_extract_all(head, F.lit("\r\nContent-Length: ([0-9]+)"), 1), -1).cast("long").alias("payload_bytes"),
        field(head, "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        field(head, "WARC-Target-URI").alias("target_uri"),
    )
    body = F.substring("record", F.col("skip") + 1, F.octet_length("record") - F.col("skip") - 4)
    right = (F.col("record_type") == "revisit") | (base32(F.sha1(body)) == F.col("payload_digest"))
    digest = F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("record differs from its payload digest")).cast("string"))
    return df.select(F.when(F.col("id") != "null", F.col("id")).cast("long").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "target_uri")
