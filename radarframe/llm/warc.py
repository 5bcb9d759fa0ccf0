"""WARC archives, Zstandard-compressed record by record with a shared dictionary.

Each file opens with a skippable frame that holds the dictionary, then has one frame a record. Workers put records together
to files of about ``FILE_BYTES`` of payload, or one record that is larger, and Spark's text sink writes each as a line of its
own, so commits, retries and any Hadoop store work as for other tables: the line separator is an empty skippable
frame, which readers of the format pass over. So a writer and a reader hold one file at a time, whatever the pages' sizes.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes, that with the smallest page_id is the
response and the others are revisits. The dictionary is built from a bounded sample of whole records (``SAMPLE`` of them or
``SAMPLE_BYTES``), which decides only how well the others compress.

Defined cases: a null html is empty; a null url gives no target; null page_ids never come first in their
group unless all are null, in which case all are responses; repeated rows of the smallest page_id are
all responses. A very long page ends its file. An empty table writes an archive without records. Other
columns are not archived, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 100
#: Payload in a file, before compression, beyond which another begins.
FILE_BYTES = 16_000_000
DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES = 65_536, 1500, 32_000_000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Magic numbers of the format: the frame of a dictionary, and an empty skippable frame (all ASCII).
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
SEPARATOR = "\x50\x2a\x4d\x18\x00\x00\x00\x00"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. The page's id and its payload's length have headers of their own."""

    def urn(k: int | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{k}')}>"

    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []), "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []), f"X-Payload-Bytes: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; a response's are those of its payload."""
    import hashlib

    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    page = fields.get("X-Page-Id")
    page_id = None if page is None else int(page)
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Bytes"])
    if fields["WARC-Type"] == "revisit":
        return page_id, size, digest, "revisit", int(fields["X-Refers-To-Page"])
    block = rest[: int(fields["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {page_id} doesn't have its digest")
    return page_id, len(payload), digest, "response", None


def frames(data: bytes):
    """(magic, content or frame) of each frame of an archive file, found by their block headers."""
    import zstandard

    view, at = memoryview(data), 0
    while at < len(data):
        magic = int.from_bytes(view[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            yield magic, bytes(view[at + 8 : at + 8 + size])
            at += 8 + size
            continue
        end = at + zstandard.frame_header_size(view[at : at + 18])
        while True:
            block = int.from_bytes(view[end : end + 3], "little")
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        end += 4 * (view[at + 4] >> 2 & 1)
        yield magic, bytes(view[at:end])
        at = end


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to of each row of ``pages``; refers_to is null for responses.

    Groups are counted on narrow rows; the html is shuffled once, by page_id, so a hot payload doesn't gather.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html"), 256))
    narrow = common.staged(rows.where(F.octet_length("html") >= LEAST_BYTES).select("page_id", "digest"), "payloads")
    several = narrow.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("refers_to")).where("n > 1 and refers_to is not null")
    revisits = common.spread_join(narrow, several, ["digest"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct()
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def trained(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of records, ``SAMPLE`` of them about."""
    import zstandard

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    few = common.bounded_sample(rows, F.xxhash64("page_id", "url", "html"), F.octet_length("html"), SAMPLE, SAMPLE_BYTES)
    texts = [record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), "0" * 64, None, False) for r in few]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too few records to choose from: a template is the dictionary
        return record(0, "http://example.org/", b"<!DOCTYPE html><html><head></head><body></body></html>", "0" * 64, None, False)


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` under ``path``."""
    common.small_batches(pages.sparkSession)
    raw = trained(pages)
    typed = with_types(pages).select("page_id", "url", "html", "digest", "refers_to")

    def compress(batches):
        import pyarrow as pa
        import zstandard

        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
        opening = DICTIONARY_FRAME + len(raw).to_bytes(4, "little") + raw
        held, size = [opening], 0

        def file():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["frames"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                held.append(made.compress(record(page_id, url, payload, digest, refers_to, refers_to is not None)))
                size += len(payload)
                if size > FILE_BYTES:
                    yield file()
                    held, size = [opening], 0
        if len(held) > 1:
            yield file()

    lines = typed.mapInArrow(compress, "frames binary").select(F.col("frames").cast("string").alias("value"))
    lines.write.mode("append").option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record under ``path``."""

    def read(batches):
        import pyarrow as pa
        import zstandard

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for data in batch.column(0).to_pylist():
                out, opener = [], zstandard.ZstdDecompressor()
                for magic, content in frames(data):
                    if magic == int.from_bytes(DICTIONARY_FRAME, "little"):
                        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                    elif magic == 0xFD2FB528:
                        out.append(parsed(opener.decompress(content)))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    # a task's files come to spark.sql.files.maxPartitionBytes at most, or are one file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to the shared folder as archives and reads them back."""
    path = common.temporary(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
