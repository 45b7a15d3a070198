"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers apart, joined on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html",
    smallest: int = 1000, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write ``folder/payloads`` (sha256, payload) and ``folder/headers`` (record_header, sha256), one header per row.

    Of rows with equal payloads of at least ``smallest`` bytes the one with the largest id becomes a response record, the
    others revisit it; smaller ones are all responses.  A null payload is empty; a null id counts as the smallest and its
    record has an empty id.  Repeated rows (same id and payload) each get a header, all of one type.  Line breaks and
    blanks in urls are percent-encoded so that a header stays one line per field.

    Only digests and ids are grouped and joined to find revisits; payload bytes are shuffled once, to be stored once."""
    body = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("body")
    ).withColumns({"sha256": F.unhex(F.sha2("body", 256)), "n": F.octet_length("body")})
    rows.groupBy("sha256").agg(F.first("body").alias("payload"), F.max("n").alias("length")) \
        .write.option("compression", "zstd").parquet(f"{folder}/payloads")
    facts = rows.select("id", "url", "sha256", "n", F.sha1("body").alias("sha1"))
    # Groups of one are told by their count; a hot payload meets one row per digest here.
    firsts = facts.where(F.col("n") >= smallest).groupBy("sha256").agg(F.max("id").alias("first"), F.count("*").alias("copies")) \
        .where("copies > 1").select("sha256", "first")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    safe = F.replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", urn(F.col("id"))), _field("WARC-Target-URI", safe), _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_field("WARC-Refers-To", urn(F.col("first"))), _field("WARC-Profile", F.lit(_REVISIT)))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, "0").otherwise(F.col("n").cast("string"))), F.lit("\r\n"),
    )
    facts.join(firsts, "sha256", "left").select(F.encode(header, "UTF-8").alias("record_header"), "sha256") \
        .write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, verified, payload, record.

    ``payload_*`` are measured on the stored bytes, not taken from the header; ``verified`` says that these bytes have the
    digest they are stored under and the one in the header.  ``record`` is the WARC record: header, block (a revisit has
    none) and two line ends.  Columns that are not selected cost nothing: without ``payload`` and ``record`` no payload is
    shuffled.  A header whose payload is missing keeps its row, with nulls and ``verified`` false."""
    store = spark.read.schema("sha256 binary, payload binary, length int").parquet(f"{folder}/payloads").select(
        "sha256", "payload", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        (F.unhex(F.sha2("payload", 256)) == F.col("sha256")).alias("_same"))
    heads = spark.read.schema("record_header binary, sha256 binary").parquet(f"{folder}/headers")
    text = F.decode("record_header", "UTF-8")
    get = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    number = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1), F.lit("")).cast("bigint")
    heads = heads.select(
        "record_header", "sha256", number(get("WARC-Record-ID")).alias("page_id"), get("WARC-Target-URI").alias("url"),
        get("WARC-Type").alias("record_type"), number(get("WARC-Refers-To")).alias("refers_to"), get("WARC-Payload-Digest").alias("_said"))
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return heads.join(store, "sha256", "left").select(
        "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest",
        F.coalesce(F.col("_same") & (F.col("_said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.lit(False)).alias("verified"),
        "payload", F.concat("record_header", block, F.lit(b"\r\n\r\n")).alias("record"))
