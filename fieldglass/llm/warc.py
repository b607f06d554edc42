"""A content-addressed WARC archive as two tables.

`payloads` holds each distinct payload once under its SHA-256, `records` the exact header of every record: the WARC header and, of a response, the HTTP header
before the payload. A WARC file is the records' headers, each followed by its payload, in record order; joining the tables on the digest gives any record's bytes back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import shared_dir, staged

LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
#: Parts that the records of one digest are dealt out to where they meet its payload or size.
SALTS = 16
CLOSE = b"\r\n\r\n"


def _header(kind: str) -> Column:
    """The header of a response, or of a revisit to the record of `first_id`."""
    own = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    # line ends in a target would end its header line
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", F.concat(F.lit("WARC-Record-ID: "), own("page_id")), f"WARC-Date: {DATE}", F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", F.concat(F.lit("WARC-Refers-To: "), own("first_id")), "Content-Length: 0", "", ""]
    else:
        http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
        lines += ["Content-Type: application/http; msgtype=response", F.concat(F.lit("Content-Length: "), (F.length(http) + F.col("size")).cast("string")), "", http]
    return F.concat_ws("\r\n", *(F.lit(x) if isinstance(x, str) else x for x in lines)).cast("binary")


def write_archive(pages: DataFrame, path: str | None = None) -> str:
    """Write the archive of pages (page_id, url, html) and return its folder.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest page_id are responses and the others revisit them;
    rows with smaller payloads are all responses. A null html is an empty payload. A null page_id is no smallest one: such a row is a response only if all ids of its payload are null.
    Repeated rows give a record each. Other columns of pages play no part.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/archive-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    heads = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    # of each payload the smallest id, and how many rows have both
    rows_of = heads.groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "n")).alias("s")
    first = staged(rows_of.groupBy("digest").agg(least).select("digest", F.col("s.page_id").alias("first_id"), F.col("s.n").alias("n")), "firsts")
    known = heads.join(first, "digest")
    again = (F.col("size") >= LEAST_REVISIT) & F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    known.select("page_id", "digest", F.when(again, _header("revisit")).otherwise(_header("response")).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    # only the rows with a payload's smallest id carry it over the network
    hashed = rows.select("page_id", "payload", F.sha2("payload", 256).alias("digest"))
    lead = first.select(F.col("digest").alias("its"), "first_id", "n")
    stored = hashed.join(lead, (F.col("digest") == F.col("its")) & F.col("page_id").eqNullSafe(F.col("first_id")))
    if not first.where("n > 1").isEmpty():  # rows that repeat both id and payload
        stored = stored.where("n = 1").select("digest", "payload").unionAll(stored.where("n > 1").select("digest", "payload").dropDuplicates(["digest"]))
    stored = stored.select("digest", "payload")
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_records(spark, path: str) -> DataFrame:
    """Header fields of each record, parsed from its header: page_id, digest, record_type, refers_to, header."""
    text = F.col("header").cast("string")
    field = lambda name, pattern: F.regexp_extract(text, rf"\r\n{name}: {pattern}\r\n", 1)
    number = lambda c: F.when(c.rlike("^-?[0-9]+$"), c.cast("long"))
    return spark.read.parquet(f"{path}/records").select(
        number(field("WARC-Record-ID", "<urn:page:([^>]*)>")).alias("page_id"), field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"), number(field("WARC-Refers-To", "<urn:page:([^>]*)>")).alias("refers_to"), "header",
    )


def read_payloads(spark, path: str) -> DataFrame:
    """The stored payloads, each checked against the digest it is stored under."""
    rows = spark.read.parquet(f"{path}/payloads").withColumn("read", F.sha2("payload", 256))
    return rows.select("payload", F.when(F.col("read") == F.col("digest"), F.col("read")).otherwise(F.raise_error(F.lit("payload differs from its digest")).cast("string")).alias("digest"))


def _salted(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """records with their payloads' columns; a digest of very many records is dealt out to SALTS parts."""
    parts = payloads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return records.withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int")).join(parts, ["digest", "salt"]).drop("salt")


def rebuilt(spark, path: str) -> DataFrame:
    """page_id, digest, record_type, refers_to, and the original record bytes: header, payload (none in a revisit) and the closing line ends."""
    records, payloads = read_records(spark, path), read_payloads(spark, path)
    names = ("page_id", "digest", "record_type", "refers_to")
    # a payload that may have many responses is short
    long_ = F.octet_length("payload") >= LEAST_REVISIT
    responses = records.where("record_type = 'response'")
    joined = responses.join(payloads.where(long_), "digest").unionByName(_salted(responses, payloads.where(~long_)))
    whole = joined.select(*names, F.concat("header", "payload", F.lit(CLOSE)).alias("record"))
    return whole.unionAll(records.where("record_type = 'revisit'").select(*names, F.concat("header", F.lit(CLOSE)).alias("record")))


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as an archive, rebuild its records and read these: page_id, payload_bytes, payload_digest, record_type, refers_to for each row.

    A response's payload is what follows its HTTP header, and its digest is computed anew; a revisit has the size of the payload stored under its
    digest. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = write_archive(pages, path)
    records = rebuilt(spark, path)
    # a response is its WARC header, a blank line, its HTTP header, a blank line, the payload and the closing line ends
    text = F.decode("record", "ISO-8859-1")  # a character a byte
    gap = lambda after: F.expr(rf"locate('\r\n\r\n', text, {after})")
    responses = records.where("record_type = 'response'").withColumn("text", text).withColumn("head", gap("1")).withColumn("http", gap("head + 4"))
    payload = F.expr("substring(record, http + 4, octet_length(record) - http - 7)")
    read = responses.select("page_id", "digest", "record_type", "refers_to", payload.alias("payload")).withColumn("again", F.sha2("payload", 256))
    same = F.when(F.col("again") == F.col("digest"), F.col("again")).otherwise(F.raise_error(F.lit("payload differs from its digest")).cast("string"))
    own = read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), same.alias("payload_digest"), "record_type", "refers_to")
    sizes = read_payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    again = _salted(read_records(spark, path).where("record_type = 'revisit'"), sizes)
    return own.unionAll(again.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"))
