"""WARC archives without repeated payloads, and back.

Only headers - id, digest and size of a payload - are shuffled by digest to find the
record that the others with the same payload revisit. Archives are written by Spark's
text writer, whose separator is the end of a record, so that any file system, retry
and commit protocol of Spark will do; reading goes by the lengths in the headers.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.common import if_small, text_of

# Fixed values of the format.
_VERSION = "WARC/1.1"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

#: Revisits that are handed to every task; more are joined by shuffle.
_HANDED_OUT = 100_000


@dataclass(frozen=True)
class Archive:
    """Parameters.

    ``least``    bytes from which a payload is worth a revisit; smaller ones repeat
    ``records``  records per file at most, so that a file fits a reader's memory
    ``date``     capture date of all records
    """

    least: int = 0
    records: int = 2000
    date: str = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits are four base32 digits."""
    hexadecimal = F.sha1(payload)
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda g: F.lpad(F.conv(F.substring(hexadecimal, g * 5 + 1, F.lit(5)), 16, 32), 4, "0"),
    )
    return F.translate(F.array_join(groups, ""), *_BASE32)


def resolved(headers: DataFrame, config: Archive = Archive()) -> DataFrame:
    """Revisits among ``headers`` (``page_id``, ``digest``, ``bytes``).

    One row ``(page_id, digest, original)`` for each distinct page and payload that
    revisits another one: ``original`` is the largest page id with that payload. A null
    page id revisits any other one; payloads whose pages all have no id are not revisited.
    """
    large = headers.where(F.col("bytes") >= config.least)
    originals = large.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    originals = originals.where("n > 1 AND original IS NOT NULL").drop("n")
    return large.join(originals, "digest").where("NOT page_id <=> original").select(
        "page_id", "digest", "original"
    ).distinct()


def write_archives(
    pages: DataFrame,
    path: str,
    config: Archive = Archive(),
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
) -> None:
    """One record per row of ``pages`` under ``path``, gzipped.

    A payload is the UTF-8 text of ``payload_column``, empty for null. Records whose
    payload a record with a larger id has too are revisits of the largest one; rows
    repeated with that id are all responses. A null id or url is left out of the
    headers; signs that would break a header line are percent-encoded. Other columns
    are not read, an empty table makes an archive without records.
    """
    payload = text_of(F.col(f"`{payload_column}`").cast("string"))
    rows = pages.select(
        F.col(f"`{id_column}`").cast("bigint").alias("page_id"),
        F.col(f"`{url_column}`").cast("string").alias("url"),
        payload.alias("payload"),
        base32_sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("bytes"),
    )
    revisits = if_small(resolved(rows.select("page_id", "digest", "bytes"), config), _HANDED_OUT).toDF(
        "of", "same", "original"
    )
    known = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    records = known.select(_record(config).alias("value"))
    writer = records.write.option("lineSep", _END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", config.records).text(path)


def _record(config: Archive) -> Column:
    revisit = F.col("same").isNotNull()
    # What a server would have said: the payload's length stays there when the payload goes.
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "bytes", F.lit(_END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    escaped = F.col("url")
    for sign in ("\r", "\n"):
        escaped = F.replace(escaped, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    lines = F.concat_ws(
        "\r\n",
        F.lit(_VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {config.date}"),
        F.concat(F.lit("WARC-Target-URI: "), escaped),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("original")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(lines, F.lit(_END), block)


def _record_id(page: Column) -> Column:
    """A name that depends on page and payload alone, so that a retried task repeats it."""
    name = F.md5(F.concat_ws("|", page.cast("string"), F.col("digest")).cast("binary"))
    parts = [F.substring(name, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records under ``path``.

    ``record_id``, ``record_type``, ``page_id``, ``url``, ``payload_digest``,
    ``payload_bytes``, ``refers_to_record`` and, unless ``payloads`` is false, ``payload``
    (null for revisits). Lengths come from the headers, so payloads may hold anything. A
    response whose payload does not fit its digest, and a broken record, stop the job.
    """
    names = ["record_id", "record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to_record"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    if payloads:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for record in _records(zlib.decompress(content.as_buffer(), 31) if len(content.as_buffer()) else b""):
                    rows.append(record if payloads else record[:-1])
                    if len(rows) == 500:
                        yield _batch(rows, names, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    schema = ", ".join(f"{n} {'bigint' if k == pa.int64() else k}" for n, k in zip(names, kinds))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _records(data: bytes) -> Iterator[tuple]:
    """The records of one uncompressed archive."""
    at, end = 0, _END.encode()
    while at < len(data):
        stop = data.index(end, at)
        version, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if version != _VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = stop + len(end)
        at = start + int(fields["Content-Length"])
        block = data[start:at]
        if data[at : at + len(end)] != end:
            raise ValueError(f"a record has no end at byte {at}")
        at += len(end)
        http, _, payload = block.partition(end)
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        response = fields["WARC-Type"] == "response"
        if response and (
            len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
        ):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not fit its header")
        page = fields.get("X-Page-ID")
        yield (
            fields["WARC-Record-ID"],
            fields["WARC-Type"],
            int(page) if page else None,
            fields.get("WARC-Target-URI"),
            digest,
            size,
            fields.get("WARC-Refers-To"),
            payload if response else None,
        )


def with_originals(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``, the page id of the response a revisit refers to."""
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("original"), F.col("page_id").alias("refers_to")
    )
    return records.join(responses.distinct(), F.col("refers_to_record") == F.col("original"), "left").drop("original")
