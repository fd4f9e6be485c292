"""Content-addressed web archive.

``write_archive`` turns rows into WARC/1.1 records and stores them as two tables below one
folder: ``payloads`` holds the bytes of every distinct payload once, under its SHA-256;
``headers`` holds the exact header block of every record (WARC header and, for responses and
revisits alike, the HTTP head) and the digest of its payload. ``records`` joins the two and
gives back whole records byte for byte; ``export_warc`` writes those as plain WARC files.

Equal payloads are found by an aggregate on the digest whose map side keeps one payload per
task, so a payload shared by a third of all pages costs no more than any other. A digest under
which two different payloads meet stops the write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def with_sha1_base32(df: DataFrame, data: str, name: str) -> DataFrame:
    """Adds the upper-case base32 of the SHA-1 of a column (160 bits: 32 characters, no padding).
    The digest is a column of its own, so it is computed once and not once per character."""
    chars = []
    for i in range(0, 40, 5):                                # 5 hex digits = 20 bits = 4 characters
        bits = F.conv(F.substring("__sha1", i + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), (F.shiftright(bits, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return df.withColumn("__sha1", F.sha1(data)).withColumn(name, F.concat(*chars)).drop("__sha1")


def _uuid(text: Column) -> Column:
    h = F.md5(text.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, p, n) for p, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes one record per row of ``pages`` below ``path`` and returns ``path``.

    Of the records with equal payloads of at least ``min_bytes`` bytes, those with the smallest
    id are responses and the others revisit it; smaller payloads are responses all. A null
    payload is empty, a null URI becomes ``urn:record:<id>``, line breaks in a URI are
    percent-encoded. Rows with a null id come after all ids (responses only where no id has
    the payload). Repeated rows give repeated records. Other columns are ignored; an empty
    table gives empty tables.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    check = F.xxhash64("payload")
    (rows.groupBy("sha256")
     .agg(F.first("payload").alias("payload"), F.min(check).alias("lo"), F.max(check).alias("hi"),
          F.min(F.octet_length("payload")).alias("n"), F.max(F.octet_length("payload")).alias("m"))
     .where(F.when((F.col("lo") == F.col("hi")) & (F.col("n") == F.col("m")), F.lit(True))
            .otherwise(F.raise_error(F.lit("two payloads under one SHA-256"))))
     .select("sha256", "payload").write.parquet(f"{path}/payloads"))

    narrow = with_sha1_base32(rows, "payload", "sha1").select(
        "id", "uri", "sha256", "sha1", F.octet_length("payload").cast("long").alias("n_bytes"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", F.coalesce("uri", F.lit("")).alias("uri"))
    first = narrow.groupBy("sha256").agg(F.min(order).alias("first")).select(
        F.col("sha256").alias("first_sha256"), F.col("first.id").alias("first_id"), F.col("first.uri").alias("first_uri"))
    joined = narrow.join(first, F.col("sha256") == F.col("first_sha256"))
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    text_id = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    uri = lambda u, i: F.when(F.coalesce(F.col(u), F.lit("")) == "", F.concat(F.lit("urn:record:"), text_id(i))).otherwise(
        F.regexp_replace(F.regexp_replace(F.col(u), "\r", "%0D"), "\n", "%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
                    _line("Content-Length", F.col("n_bytes").cast("string")), F.lit(CRLF))
    stored = F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _uuid(F.concat_ws("|", text_id("id"), "uri"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri("uri", "id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                 _line("WARC-Refers-To", _uuid(F.concat_ws("|", text_id("first_id"), F.nullif(F.col("first_uri"), F.lit(""))))),
                                 _line("WARC-Refers-To-Target-URI", uri("first_uri", "first_id")))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", (F.octet_length(http) + stored).cast("string")),
        F.lit(CRLF), http)
    (joined.select("id", F.when(revisit, F.col("first_id")).alias("refers_to_id"), "sha256", header.alias("header"))
     .write.parquet(f"{path}/headers"))
    return path


def header_field(name: str) -> Column:
    """A field of the header block (null where it is missing)."""
    found = F.regexp_extract(F.substring_index("header", CRLF * 2, 1), rf"\r\n{name}: ([^\r]*)", 1)
    return F.nullif(found, F.lit(""))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; a payload that does not have its digest stops the read."""
    df = spark.read.parquet(f"{path}/payloads")
    return df.where(F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.lit(True))
                    .otherwise(F.raise_error(F.lit("a stored payload does not match its SHA-256"))))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record: ``id``, ``header`` (exact text), ``record`` (its bytes, without the closing
    blank lines) and ``payload`` (for revisits that of the record they refer to)."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "sha256", "left")
    own = F.when(header_field("WARC-Type") == "revisit", F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    return joined.select("id", "refers_to_id", "header", F.concat(F.col("header").cast("binary"), own).alias("record"), "payload")


def export_warc(spark: SparkSession, path: str, out: str, records_per_file: int = 20_000, compression: str = "gzip") -> None:
    """Writes all records as WARC files (UTF-8 payloads, each record closed by two line breaks)."""
    (records(spark, path).select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", CRLF * 2).option("compression", compression)
     .option("maxRecordsPerFile", records_per_file).text(out))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each record, its payload hashed anew. Stored payloads are
    reduced to length and digest before the join, so a payload shared by many records is
    hashed once and its bytes are not copied to each of them."""
    short = with_sha1_base32(read_payloads(spark, path), "payload", "payload_digest").select(
        "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest")
    joined = read_headers(spark, path).join(short, "sha256")
    kept = F.when(header_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a header names another digest than its payload has")))
    return joined.select("id", "payload_bytes", kept.alias("payload_digest"), header_field("WARC-Type").alias("record_type"), "refers_to_id")
