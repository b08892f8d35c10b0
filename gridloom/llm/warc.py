"""WARC archives as seekable Zstandard bundles.

Records (WARC/1.1) are grouped into independent Zstandard frames of about FRAME_BYTES; a bundle of frames ends with two
skippable frames: the record index, which maps each record identifier to (frame, offset in the frame, length), and the
public seekable format's seek table. So any record is read by decompressing one frame. Of pages with equal payloads the
one with the largest page_id is a response and the others are revisits of it; which, is found by an aggregation of
digests, so no group of copies meets in one task.

Defined results: null html is the empty payload, null url the empty URI; control characters of a URL are written as
percent codes. A null page_id is below all others and is written as an identifier without number. Of repeated rows
(page_id and payload) all with the largest page_id are responses. Payloads of fewer than `least` bytes are all
responses. Other columns are not archived. An empty table gives an archive folder with no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import shared_folder, tune
from gridloom.llm.files import read_files, write_files

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 24
#: Up to so many revisits are sent to all executors; more are joined by a shuffle.
BROADCAST_REVISITS = 50_000
# Fixed values of the seekable format.
SEEK_MAGIC, SEEK_FRAME, INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
_NAME = "urn:gridloom:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None) -> tuple[bytes, bytes]:
    """Identifier and bytes of one record."""
    name = f"{_NAME}{'' if page_id is None else page_id}".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
    more = b""
    if refers_to is not None:
        more = b"WARC-Refers-To: <%s%d>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" % (_NAME.encode(), refers_to)
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: %s\r\nWARC-Payload-Digest: sha1:%s\r\n%sContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n"
    return name, head % (b"response" if refers_to is None else b"revisit", name, target.encode(), sha1.encode(), more, len(block)) + block + b"\r\n\r\n"


class Bundle:
    """Frames of records, closed to one file image."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.open: list[bytes] = []
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self.filled = self.raw = 0

    def add(self, name: bytes, data: bytes) -> None:
        if self.filled and self.filled + len(data) > FRAME_BYTES:
            self.cut()
        self.index.append((name, len(self.frames), self.filled, len(data)))
        self.open.append(data)
        self.filled += len(data)
        self.raw += len(data)

    def cut(self) -> None:
        if self.open:
            self.frames.append((self.packer.compress(b"".join(self.open)), self.filled))
            self.open, self.filled = [], 0

    def close(self) -> bytes:
        self.cut()
        rows = b"".join(struct.pack("<HIIQ", len(n), f, o, s) + n for n, f, o, s in self.index)
        table = b"".join(struct.pack("<II", len(d), n) for d, n in self.frames) + struct.pack("<II", 8 + len(rows), 0)
        table += struct.pack("<IBI", len(self.frames) + 1, 0, SEEK_MAGIC)
        return b"".join([*(d for d, _ in self.frames), struct.pack("<II", INDEX_FRAME, len(rows)), rows, struct.pack("<II", SEEK_FRAME, len(table)), table])


class BundleReader:
    """Random access to the records of a bundle's image."""

    def __init__(self, image: bytes) -> None:
        self.image, self.unpacker = image, zstandard.ZstdDecompressor()
        count, _, magic = struct.unpack("<IBI", image[-9:])
        if magic != SEEK_MAGIC:
            raise ValueError("not a seekable bundle")
        table = image[-9 - 8 * count : -9]
        self.at, place = [], 0
        for packed, raw in struct.iter_unpack("<II", table):
            self.at.append((place, packed, raw))
            place += packed
        place, packed, _ = self.at.pop()
        rows, k = image[place + 8 : place + packed], 0
        self.index: list[tuple[bytes, int, int, int]] = []
        while k < len(rows):
            size, frame, offset, length = struct.unpack_from("<HIIQ", rows, k)
            self.index.append((rows[k + 18 : k + 18 + size], frame, offset, length))
            k += 18 + size

    def frame(self, k: int) -> bytes:
        place, packed, raw = self.at[k]
        return self.unpacker.decompress(self.image[place : place + packed], max_output_size=raw)

    def records(self) -> Iterator[bytes]:
        held, data = -1, b""
        for _, frame, offset, length in self.index:
            if frame != held:
                held, data = frame, self.frame(frame)
            yield data[offset : offset + length]

    def find(self, name: bytes) -> bytes | None:
        """The record with an identifier, by decompressing its frame alone."""
        for n, frame, offset, length in self.index:
            if n == name:
                return self.frame(frame)[offset : offset + length]
        return None


def parse(data: bytes) -> dict[str, str | bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    out: dict[str, str | bytes] = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b": ")
        out[k.decode().lower()] = v.decode()
    out["block"] = rest[: int(out["content-length"])]
    return out


def _number(name: str) -> int | None:
    tail = name.strip("<>").removeprefix(_NAME)
    return int(tail) if tail else None


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write bundles of page_id, url, html below path."""
    tune(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    key = rows.select("page_id", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= least)
    newest = key.groupBy("sha").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("sha", "newest")
    # the one with the largest id stays; a null id is below all others
    revisits = key.join(newest, "sha").where("newest is not null and not page_id <=> newest").select("page_id", "sha", "newest").distinct()
    revisits_path = f"{path}-revisits"
    revisits.write.parquet(revisits_path)
    found = pages.sparkSession.read.schema(revisits.schema).parquet(revisits_path)
    few = found.count() <= BROADCAST_REVISITS
    found = found.withColumnRenamed("page_id", "page").withColumnRenamed("sha", "digest")
    sha = F.unhex(F.sha1("html"))
    full = rows.join(F.broadcast(found) if few else found.hint("shuffle_merge"), F.col("page_id").eqNullSafe(F.col("page")) & (sha == F.col("digest")), "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle()
        image = lambda b: pa.RecordBatch.from_pydict({"image": pa.array([b.close()[:-1]], pa.binary())})
        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle.add(*record(page, url, payload, digest(payload), refers))
                if bundle.raw >= BUNDLE_BYTES:
                    yield image(bundle)
                    bundle = Bundle()
        if bundle.index:
            yield image(bundle)

    images = full.select("page_id", "url", "html", "newest").mapInArrow(pack, "image binary")
    write_files(images, "image", SEEK_MAGIC >> 24, path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records below path."""
    tune(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column(batch.schema.get_field_index("content")):
                out: list[tuple] = []
                for data in BundleReader(image.as_py()).records():
                    r = parse(data)
                    http, _, payload = r["block"].partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if r["warc-type"] == "response":
                        out.append((_number(r["warc-record-id"]), len(payload), digest(payload), "response", None))
                    else:
                        out.append((_number(r["warc-record-id"]), size, r["warc-payload-digest"].removeprefix("sha1:"), "revisit", _number(r["warc-refers-to"])))
                kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))
                yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(kinds)})

    return read_files(spark, path).select("content").mapInArrow(unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}-warc"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path)


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN newest IS NULL OR page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM p
"""
