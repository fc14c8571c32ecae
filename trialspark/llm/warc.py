"""WARC archives in Zstandard: one frame per record, a dictionary in the leading skippable frame.

Archives are written by Spark's text writer, one file per task: each row is a frame as it stands, and the line
separator is an empty skippable frame, which every Zstandard decoder passes over. So files reach any store that
Spark can write to, and the committer guards against lost tasks. They are read as binary files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # skippable frame of no bytes
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

DATE = "2024-01-01T00:00:00Z"  # of all records, a parameter, so that reruns agree
DICTIONARY_BYTES = 16_384
TRAIN_BYTES = 1_000_000  # the first records of an archive, up to so many bytes, train its dictionary
LEVEL = 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page: object) -> str:
    return f"urn:x-page:{'null' if page is None else page}"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """Record of a page: a response, or a revisit of the page refers_to, without the payload."""
    uri = quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else _id(page)
    revisit = refers_to is not None
    block = HTTP % len(payload) + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_id(page)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
        ("WARC-Block-Digest", "sha1:" + payload_digest(block)), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_id(refers_to)}>")]
    return record(fields, block)


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained dictionary; None where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8)
    except zstandard.ZstdError:
        return None


def archive_frames(records: Iterator[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """Frames of an archive; the dictionary's skippable frame leads the first one."""
    first: list[bytes] = []
    size = 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    if not first:
        return
    known = _dictionary(first)
    lead = b"" if known is None else struct.pack("<II", DICTIONARY_FRAME, len(known.as_bytes())) + known.as_bytes()
    press = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    for r in first:
        yield lead + press.compress(r)
        lead = b""
    for r in records:
        yield press.compress(r)


def _frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame that begins at `at`: its blocks are walked by their headers."""
    head = data[at:at + 18]
    end = at + zstandard.frame_header_size(head)
    checksum = zstandard.get_frame_parameters(head).has_checksum
    while True:
        if end + 3 > len(data):
            raise ValueError("archive ends within a frame")
        block = int.from_bytes(data[end:end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * checksum
    if end > len(data):
        raise ValueError("archive ends within a frame")
    return end


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record; raises ValueError for what does not fit the formats."""
    data, at, unpack = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("archive ends within a frame")
        magic, length = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + length > len(data):
                raise ValueError("archive ends within a skippable frame")
            if magic == DICTIONARY_FRAME:
                if at:
                    raise ValueError("the dictionary does not lead the archive")
                held = bytes(data[8:8 + length])
                if held[:4] == struct.pack("<I", FRAME):  # a dictionary may itself be compressed
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + length
        elif magic == FRAME:
            end = _frame_end(data, at)
            yield parse_record(unpack.decompressobj().decompress(data[at:end]))
            at = end
        else:
            raise ValueError(f"unknown frame {magic:#x}")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, with its length and digests held against it."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    length = fields["content-length"]
    if not length.isdigit() or rest[int(length):] != b"\r\n\r\n":
        raise ValueError("the block has another length than its header says")
    block = rest[:int(length)]
    if fields.get("warc-block-digest", "sha1:" + payload_digest(block)) != "sha1:" + payload_digest(block):
        raise ValueError("the block has another digest than its header says")
    return fields, block


def parse_page(fields: dict[str, str], block: bytes) -> dict[str, object]:
    """Page of a response or revisit record; a response's payload is held against length and digest."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    size = next((int(line[15:]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")), None)
    if not sep or size is None:
        raise ValueError("no HTTP header")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("the payload is not the one its header tells of")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


def _page(record_id: str) -> int | None:
    name = record_id.strip("<>").removeprefix("urn:x-page:")
    return None if name == "null" else int(name)


def with_targets(pages: DataFrame, key: str, text: str, url: str, least: int = 0) -> DataFrame:
    """page, url, payload, refers_to: of equal payloads the one with the smallest key is kept, others refer to it.

    Payloads are equal if SHA-256 and length are; only payloads that occur more than once take part in the join.
    """
    rows = pages.select(
        F.col(key).alias("page"), F.col(url).alias("url"),
        F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    many = (
        rows.where(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    )
    return rows.join(many, "digest", "left").select(
        "page", "url", "payload",
        F.when(F.col("page").isNull() | (F.col("page") != F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", text: str = "html", least: int = 0, date: str = DATE
) -> None:
    """Write one record per page to archives under path, one archive for each task.

    A null text is an empty payload, a null or empty url is the page's name. Of equal payloads of at least `least`
    bytes the page with the smallest key is the response and the others revisit it; rows that repeat that key are
    responses too; a page without key revisits, or is a response if no page with that payload has a key. An empty
    table writes no archive; other columns are not read. An archive is as large as the partition it is made of.
    """
    rows = with_targets(pages, key, text, url, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, uri, payload, target in zip(*(c for c in batch.columns)):
                    yield page_record(page.as_py(), uri.as_py(), payload.as_py(), target.as_py(), date)

        held: list[bytes] = []
        size = 0
        for frame in archive_frames(records()):
            held.append(frame)
            size += len(frame)
            if size >= 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    frames = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all archives under path: page_id, url, payload (null for revisits), payload_bytes, payload_digest,
    record_type, refers_to. Records that break the formats raise an error."""
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[dict[str, object]] = []
                size = 0
                for fields, block in read_records(content.as_py()):
                    if fields["warc-type"] in ("response", "revisit"):
                        held.append(parse_page(fields, block))
                        size += len(block)
                    if size >= 16_000_000:
                        yield pa.RecordBatch.from_pylist(held, pa.schema(kinds))
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, pa.schema(kinds))

    return files.mapInArrow(
        run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
