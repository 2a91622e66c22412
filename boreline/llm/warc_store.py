"""Content-addressed WARC archive: two Parquet tables under one folder.

`payloads` (content, payload) holds every payload once, by its SHA-256.  `records` (content, head) holds for each
record its exact header bytes: WARC header, blank line and HTTP header.  A record is head, payload (none in a revisit)
and two line ends; `read_records` puts it together again by a join on the digest and verifies both digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"
#: Equal payloads from this size on are stored as one response and revisits.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "<urn:page:"


def _one_line(c: Column) -> Column:
    """A header value keeps to its line: line ends are percent-encoded."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _verified(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("binary"))


def _head(date: str) -> Column:
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.col("n").cast("string"), F.lit(END + END))
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    return F.encode(F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: {RECORD}"), page, F.lit(">"),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Refers-To: {RECORD}"), F.col("refers_to").cast("string"),
                                 F.lit(f">{END}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.coalesce(F.concat(F.lit(f"{END}WARC-Target-URI: "), _one_line(F.col("url"))), F.lit("")),
        F.lit(f"{END}WARC-Date: {date}{END}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "), size.cast("string"),
        F.lit(END + END), http), "UTF-8")


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive page_id, url, html (payload: its UTF-8 bytes).

    Of the records with equal payloads of REVISIT_BYTES or more, that with the largest page_id is a response and the
    others are revisits of it; repeated rows of that page_id are responses too.  Null html: empty payload.  Null url: no
    target line.  Null page_id: "null" in the record's id; it never is what others refer to.  Other columns are ignored."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"),
        F.unhex(F.sha2("payload", 256)).alias("content"))
    # copies of a payload meet in the map tasks first, so one of any number of copies is shuffled per task
    stored = rows.groupBy("content").agg(F.first("payload").alias("payload"), F.min("n").alias("n"), F.max("n").alias("n1"),
                                         F.min("sha1").alias("s"), F.max("sha1").alias("s1"))
    stored.select("content", _verified((F.col("n") == F.col("n1")) & (F.col("s") == F.col("s1")), F.col("payload"),
                                       "two payloads share a SHA-256 digest").alias("payload")) \
        .write.option("compression", "zstd").parquet(f"{path}/payloads")
    facts = rows.drop("payload")
    newest = facts.filter(F.col("n") >= REVISIT_BYTES).groupBy("content").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("c")) \
        .filter(F.col("c") > 1).drop("c")
    facts.join(newest, "content", "left") \
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))) \
        .select("content", _head(date).alias("head")) \
        .write.option("compression", "zstd").parquet(f"{path}/records")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("text"), f"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _page(name: str) -> Column:
    return F.regexp_extract(_field(name), f"^{RECORD}(-?[0-9]+)>$", 1).try_cast("long")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (that of the response for revisits) and record, the exact bytes.
    Fails when a payload does not have the SHA-256 it is stored by or the SHA-1 its header names."""
    payloads = spark.read.schema("content binary, payload binary").parquet(f"{path}/payloads")
    records = spark.read.schema("content binary, head binary").parquet(f"{path}/records")
    payloads = payloads.withColumn("payload", _verified(F.unhex(F.sha2("payload", 256)) == F.col("content"), F.col("payload"),
                                                        "a stored payload does not match its digest"))
    both = records.join(payloads, "content").withColumn("text", F.decode("head", "UTF-8"))
    both = both.withColumn("payload", _verified(F.sha1("payload") == F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1),
                                                F.col("payload"), "a payload does not match the digest in its header"))
    both = both.withColumn("record_type", _field("WARC-Type"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select(_page("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"), "record_type",
                       _page("WARC-Refers-To").alias("refers_to"), "payload",
                       F.concat("head", body, F.lit((END + END).encode())).alias("record"))


def export_warc(records: DataFrame, path: str) -> None:
    """Write the records as .warc text files; for payloads that are UTF-8, as those of `write_archive`."""
    records.select(F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "UTF-8").alias("value")) \
        .write.option("lineSep", END + END).text(path)
