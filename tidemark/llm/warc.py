"""WARC archives as seekable Zstandard bundles.

A bundle is the concatenation of independent Zstandard frames, each a group of WARC records, and a
footer in a skippable frame: the seek table, with every frame's compressed and plain size. A record
is addressed by its bundle, its frame and its offset in the plain frame; only that frame is read for it.

Bundles are files that plain tools open. A task writes its bundles beside the archive, under names of their own, and
returns where; that table is written with Spark's commit protocol, and only what it names is moved into place,
so a task that is run again, or twice at one time, leaves each record in one bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import in_arrow, map_column
from tidemark.llm.storage import small, stored
from tidemark.sources.tables import Folder, passing_path

#: Plain bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 16 << 20
#: Magic numbers of the seekable format: fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed date, for archives that depend on their rows only.
DATE = "2000-01-01T00:00:00Z"
_INDEX = "array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"


@dataclass(frozen=True)
class Archive:
    """A folder of bundles, and a row for each: (bundle, bytes, index), index an array of record addresses."""

    folder: str
    bundles: DataFrame


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(record_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(record_id))}>"


def _clean(value: object) -> str:
    return "" if value is None else "".join(" " if c in "\r\n" else c for c in str(value))


def write_record(record_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """A response record, or a revisit without a payload if ``refers_to`` names the record it repeats."""
    block = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(record_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Payload-Length: {len(payload)}",
        f"Record-Key: {_clean(record_id)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_uri(refers_to)}",
            f"Refers-To-Key: {_clean(refers_to)}",
        ]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def read_records(plain: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record in a plain frame. Broken records raise ValueError."""
    at = 0
    while at < len(plain):
        head_end = plain.find(b"\r\n\r\n", at)
        if head_end < 0 or not plain.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at {at}")
        lines = plain[at:head_end].decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        block = plain[head_end + 4 : head_end + 4 + length]
        if plain[head_end + 4 + length : head_end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        yield at, headers, block
        at = head_end + 8 + length


class Bundle:
    """Collects records into frames; ``finish`` adds the seek table."""

    def __init__(self, level: int = 3) -> None:
        self._pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._open, self._frames, self._sizes, self.index, self.bytes, self._plain = [], [], [], [], 0, 0

    def add(self, record_id: object, record: bytes) -> None:
        self.index.append((None if record_id is None else str(record_id), len(self._frames), self._plain, len(record)))
        self._open.append(record)
        self._plain += len(record)
        if self._plain >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self._open:
            frame = self._pack.compress(b"".join(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), self._plain))
            self.bytes += len(frame)
            self._open, self._plain = [], 0

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, SEEKABLE)
        return b"".join(self._frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, read from the footer."""
    if len(content) < 17:
        raise ValueError("too short for a seek table")
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    entry = 12 if flags & 0x80 else 8
    size = count * entry + 9
    if magic != SEEKABLE or struct.unpack("<II", content[-size - 8 : -size]) != (SKIPPABLE, size):
        raise ValueError("no seek table")
    found, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", content, len(content) - size + i * entry)
        found.append((at, packed, plain))
        at += packed
    return found


def read_frame(content: bytes, frame: int) -> bytes:
    start, packed, plain = seek_table(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=plain)


def read_record(content: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its address: only its frame is decompressed."""
    _, headers, block = next(read_records(read_frame(content, frame)[offset:]))
    return headers, block


def revisits(pages: DataFrame, min_bytes: int, record_id: str, payload: str) -> DataFrame:
    """``pages`` with digest, payload_bytes and refers_to: the largest id of the rows with an equal payload.

    refers_to is null for that row itself, for payloads under ``min_bytes``, and where no row of the
    payload has an id. Rows with a null id, and repeated rows of the largest id, are responses.
    The largest id is aggregated per digest before the shuffle, and only digests of two rows or more
    are joined back, broadcast if counted small; the payloads themselves are not shuffled for that.
    """

    def make(values: list[bytes | None]) -> dict:
        return {
            "digest": pa.array([payload_digest(v or b"") for v in values], pa.string()),
            "payload_bytes": pa.array([len(v or b"") for v in values], pa.int64()),
        }

    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    marked = map_column(pages, pages.columns, raw, make, "digest string, payload_bytes bigint")
    again = stored(
        marked.groupBy("digest", "payload_bytes")
        .agg(F.max(record_id).alias("largest"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & (F.col("payload_bytes") >= min_bytes))
        .select(F.col("digest").alias("again"), F.col("payload_bytes").alias("again_bytes"), "largest"),
        "repeated-payloads",
    )
    same = (F.col("digest") == F.col("again")) & (F.col("payload_bytes") == F.col("again_bytes"))
    refers = F.when(F.col(record_id) != F.col("largest"), F.col("largest"))
    return marked.join(small(again), same, "left").withColumn("refers_to", refers).drop("again", "again_bytes", "largest")


def write_archive(
    pages: DataFrame, min_bytes: int = 0, record_id: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None
) -> Archive:
    """The archive of ``pages``: ``.warc.zst`` files in ``folder``, or in one that passes if none is given.

    Every row becomes one record; a null payload is empty, a null url an empty target. Line breaks in a
    url become blanks in its header. Other columns are not archived. No rows give no bundles. The folder must
    be one that the executors reach, of a file system that pyarrow opens; bundles in it stay, those of equal names are replaced.
    """
    spark = pages.sparkSession
    folder = (folder or passing_path(spark, "archive")).rstrip("/")
    writing = f"{folder}/_writing-{uuid.uuid4().hex}"
    Folder(spark, writing).make()
    rows = revisits(pages.select(record_id, url, payload), min_bytes, record_id, payload)
    rows = rows.select(
        F.col(record_id).alias("record_id"),
        F.col(url).alias("url"),
        F.col(payload).cast("binary").alias("payload"),
        "digest",
        "refers_to",
        F.spark_partition_id().alias("part"),
    )
    out = pa.schema([
        ("bundle", pa.string()),
        ("beside", pa.string()),
        ("bytes", pa.int64()),
        ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
    ])

    def ended(bundle: Bundle, part: int, number: int) -> pa.RecordBatch:
        addresses = [dict(zip(("record_id", "frame", "offset", "length"), x, strict=True)) for x in bundle.index]
        content, beside = bundle.finish(), uuid.uuid4().hex
        files, place = fs.FileSystem.from_uri(writing)
        with files.open_output_stream(f"{place}/{beside}") as stream:
            stream.write(content)
        row = {"bundle": f"part-{part:06d}-{number:06d}.warc.zst", "beside": beside, "bytes": len(content), "index": addresses}
        return pa.RecordBatch.from_pylist([row], out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, number, part = Bundle(), 0, 0
        for batch in batches:
            for row in zip(*[c for c in batch.columns], strict=True):
                key, link, body, digest, refers, part = (v.as_py() for v in row)
                bundle.add(key, write_record(key, link, body or b"", digest, refers))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield ended(bundle, part, number)
                    bundle, number = Bundle(), number + 1
        if bundle.index:
            yield ended(bundle, part, number)

    written = stored(in_arrow(rows, work, f"bundle string, beside string, bytes bigint, index {_INDEX}"), "bundles")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = fs.FileSystem.from_uri(writing)
        for batch in batches:
            for bundle, beside in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if files.get_file_info(f"{place}/{beside}").type != fs.FileType.NotFound:  # else a run before this moved it
                    files.move(f"{place}/{beside}", f"{place.rsplit('/', 1)[0]}/{bundle}")
            yield batch

    moved = in_arrow(written.select("bundle", "beside"), move, "bundle string, beside string")
    moved.write.format("noop").mode("overwrite").save()
    Folder(spark, writing).remove("")
    return Archive(folder, written.drop("beside"))


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, content) of the bundles in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("bundle"), "content")


def read_archive(archive: Archive) -> DataFrame:
    """Every record of an archive: bundle, frame, offset, record_key, url, record_type, payload_digest,
    payload_bytes, refers_to, payload (null for revisits).

    Digest and length of responses are computed from the payload read and must be those of the header.
    """
    out = pa.schema([
        ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("record_key", pa.string()), ("url", pa.string()),
        ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()),
        ("payload", pa.binary()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                held = content.as_py()
                for frame in range(len(seek_table(held))):
                    rows = []
                    for offset, h, block in read_records(read_frame(held, frame)):
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["Payload-Length"])
                        whole = h["WARC-Type"] == "response"
                        if whole and (payload_digest(block) != digest or len(block) != size):
                            raise ValueError(f"{name}: the payload of {h['Record-Key']} is damaged")
                        rows.append((
                            name.as_py(), frame, offset, h["Record-Key"] or None, h["WARC-Target-URI"] or None,
                            h["WARC-Type"], digest, size, h.get("Refers-To-Key"), block if whole else None,
                        ))
                    yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in rows], out)

    schema = (
        "bundle string, frame int, offset bigint, record_key string, url string, record_type string, "
        "payload_digest string, payload_bytes bigint, refers_to string, payload binary"
    )
    return in_arrow(bundle_files(archive.bundles.sparkSession, archive.folder), work, schema)


def locate(archive: Archive) -> DataFrame:
    """The archive's index: record_id -> bundle, frame, offset, length."""
    return archive.bundles.select("bundle", F.explode("index").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")
