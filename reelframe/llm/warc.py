"""WARC records over a content-addressed store: payload bytes once per verified digest, exact record headers apart, joined when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, each as eight digits of five bits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def record_id(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))


def header(page: Column, url: Column, size: Column, sha1: Column, first: Column, revisit: Column, date: str) -> Column:
    """WARC header block up to and with its empty line; a revisit has an empty block and names the record that holds the payload."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(EOL))
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", record_id(page)), line("WARC-Date", F.lit(date)),
        F.when(url.isNull(), F.lit("")).otherwise(line("WARC-Target-URI", clean)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(first)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")), F.lit(EOL))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write `path`/payloads (address, payload) and `path`/headers (address, header), a header per input row.

    Null html is an empty payload, a null url gives no target line; line ends in a url are percent-encoded. Of records whose payload of at least `least_bytes` bytes is the same, the
    one with the largest id is the response and the others revisit it; records that repeat that id are responses too. Null ids lose to any id; payloads
    under null ids only are responses. The address is SHA-256; the payload itself is in the grouping key, so equal addresses with
    different payloads would show as two rows, which is an error. Copies are combined in each map task before the shuffle.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("address", F.coalesce(F.sha2("payload", 256), F.lit("")))
    store = rows.groupBy("address", "payload").agg(F.max("page").alias("first"), F.max(base32_sha1(F.col("payload"))).alias("sha1"))
    store.write.parquet(f"{path}/payloads")
    held = spark.read.parquet(f"{path}/payloads")
    if not held.groupBy("address").count().filter("count > 1").isEmpty():
        raise ValueError("two payloads share a digest")
    named = rows.select("page", "url", "address", F.octet_length("payload").alias("size")).join(held.select("address", "first", "sha1"), "address")
    revisit = (F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    heads = named.select("address", header(F.col("page"), F.col("url"), F.col("size"), F.col("sha1"), F.col("first"), revisit, date).alias("header"))
    heads.write.parquet(f"{path}/headers")


def field(c: Column, name: str) -> Column:
    """Value of a header line; null where there is none."""
    value = F.regexp_extract(c, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(c, F.lit(f"{EOL}{name}: ")), value)


def page_of(c: Column) -> Column:
    return F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload (for revisits that of the record they refer to), stated_digest, record (its exact bytes).

    Headers and payloads meet by address. A stored payload that no longer has its address is an error.
    """
    store = spark.read.parquet(f"{path}/payloads").select("address", "payload")
    true = F.sha2("payload", 256) == F.col("address")
    store = store.withColumn("payload", F.when(true, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload changed under "), F.col("address"))).cast("binary")))
    rows = spark.read.parquet(f"{path}/headers").join(store, "address")
    h = F.col("header")
    block = F.when(field(h, "Content-Length") == "0", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return rows.select(page_of(field(h, "WARC-Record-ID")).alias("page_id"), field(h, "WARC-Target-URI").alias("url"), field(h, "WARC-Type").alias("record_type"), page_of(field(h, "WARC-Refers-To")).alias("refers_to"),
                       "payload", F.substring(field(h, "WARC-Payload-Digest"), 6, 32).alias("stated_digest"), F.concat(h.cast("binary"), block, F.lit(EOL * 2).cast("binary")).alias("record"))


def record_table(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (both of the payload as read back), record_type, refers_to; a digest unlike the stated one is an error."""
    sha1 = base32_sha1(F.col("payload"))
    sure = F.when(sha1 == F.col("stated_digest"), sha1).otherwise(F.raise_error(F.lit("payload unlike its stated digest")).cast("string"))
    return archive.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sure.alias("payload_digest"), "record_type", "refers_to")


def write_files(archive: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """The records as gzip-compressed WARC text files; payloads must be UTF-8, as those of write_archive are."""
    body = F.col("record").cast("string")
    body = F.substring(body, F.lit(1), F.length(body) - 4)  # the writer puts the end of a record back
    archive.select(body.alias("value")).write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
