"""Content-addressed WARC archive: payloads stored once by SHA-256, exact record headers kept beside them.

``write_archive`` makes two tables in the archive's folder: ``payloads`` (digest, payload), where each
distinct payload stands once, and ``headers`` (digest, header), with the header bytes of every record just as
they would stand in a WARC file. ``read_archive`` parses the headers, checks each stored payload against its
digest, and joins the two, which gives back every record byte for byte.

Of records with equal payloads of at least ``min_revisit_bytes``, the one with the smallest page_id is a
response, the others are revisits of it; shorter payloads are always responses. The smallest page_id comes
from an aggregate that is combined before its shuffle, and a payload that very many pages share is one row of
``payloads``, so a hot payload only makes one side of a sort-merge join uneven, which Spark splits.

Cases: null html is an empty payload; a null url has no WARC-Target-URI, and CR or LF in a url is written
%0D or %0A so that it can't end the header. Rows repeated with the very page_id that is the response are
responses too. A null page_id is written without a record number and comes back null. Other columns of
``pages`` aren't archived. An empty table gives an empty archive.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_dir

MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
PAYLOADS, HEADERS = "payload_digest string, payload binary", "payload_digest string, header binary"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def header_of(page_id: Column, url: Column, digest: Column, size: Column, revisits: Column) -> Column:
    """The bytes of a record's header; ``revisits`` is the page_id of the response, or null for a response."""
    is_revisit = revisits.isNotNull()
    safe_url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(page_id)),
        _line("WARC-Target-URI", safe_url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Refers-To", _urn(revisits)),
        _line("WARC-Profile", F.when(is_revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(is_revisit, F.lit(0)).otherwise(size).cast("string")),
        F.lit(CRLF),
    )
    return F.encode(head, "UTF-8")


def write_archive(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Archive page_id, url and html of ``pages`` below ``path`` (the shared folder if none); return the path."""
    path = path or shared_dir(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))

    rows.groupBy("payload_digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    small = rows.select("page_id", "url", "payload_digest", F.octet_length("payload").cast("long").alias("size"))
    first = small.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"))
    revisits = F.when((F.col("size") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    headers = small.join(first, "payload_digest").select("payload_digest", header_of(F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("size"), revisits).alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page_id, url, record_type, refers_to, payload_digest, payload, and its exact bytes as ``record``."""
    text = F.decode("header", "UTF-8")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))

    def number(name: str) -> Column:
        return F.regexp_extract(F.coalesce(field(name), F.lit("")), r"<urn:page:(-?\d+)>", 1)

    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    checked = F.when(F.sha2("payload", 256) == F.col("payload_digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("payload_digest"))).cast("binary"))
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads").select("payload_digest", checked.alias("payload"))
    parsed = headers.select(
        "payload_digest",
        "header",
        F.nullif(number("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        F.nullif(number("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
    )
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.lit((CRLF * 2).encode())
    return parsed.join(payloads, "payload_digest").select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload", F.concat("header", block, end).alias("record"))
