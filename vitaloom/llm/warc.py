"""WARC archives with Zstandard: a dictionary in a leading skippable frame, a frame a record.

Writing: the digest of each payload is taken in the JVM; of equal payloads of LEAST_PAYLOAD
bytes or more the least id is the response and the others revisit it, settled by one partial
aggregate and a join on the digest. Each task then streams its rows into archives of about
ARCHIVE_BYTES. An archive is written under a name of the attempt and takes its final name,
which depends on the task only, when it is whole; a repeated task replaces it.

Reading: every archive is one row of Spark's binary file source. The reader takes the
dictionary from the skippable frame, decodes one frame for each record, and checks version
line, named headers, length and digest. What does not hold is told in `error`, record by
record, and the rest is still read. An archive whose frames cannot be found at all gives one
row with its error.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm.common import batches_of, scratch

LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 8 << 20
# The first records of an archive, from which its dictionary is trained.
SAMPLE_RECORDS = 200
DICTIONARY_BYTES = 16 << 10

# Fixed values of the archive formats.
_SKIPPABLE = 0x184D2A5D
_FRAME = b"\x28\xb5\x2f\xfd"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP headers only, and its payload's length."""
    revisit = refers_to is not None
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        headers[1:1] = [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the first record itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return samples[0][:DICTIONARY_BYTES]


def _as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    """Raw bytes serve as well as a trained dictionary, which its magic number tells."""
    return zstandard.ZstdCompressionDict(data)


def archive_head(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(dictionary)
    return struct.pack("<II", _SKIPPABLE, len(packed)) + packed


class _Writer:
    """Writes records to archives in one folder; memory holds the sample and one record."""

    def __init__(self, folder: str, task: int) -> None:
        self.fs, self.root = arrow_fs.FileSystem.from_uri(folder)
        self.task, self.made, self.out, self.size = task, 0, None, 0
        self.samples: list[bytes] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.samples.append(data)
            if len(self.samples) < SAMPLE_RECORDS and sum(map(len, self.samples)) < ARCHIVE_BYTES:
                return
            self._start()
        else:
            self._write(data)
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _start(self) -> None:
        dictionary = _dictionary(self.samples)
        self.packer = zstandard.ZstdCompressor(
            level=3, dict_data=_as_dictionary(dictionary), write_content_size=True, write_checksum=True
        )
        self.path = f"{self.root}/part-{self.task:06d}-{self.made:04d}.warc.zst"
        self.open_path = f"{self.root}/_{uuid.uuid4().hex}.open"
        self.out, self.size = self.fs.open_output_stream(self.open_path), 0
        self.out.write(archive_head(dictionary))
        for held in self.samples:
            self._write(held)
        self.samples = []

    def _write(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is None and self.samples:
            self._start()
        if self.out is not None:
            self.out.close()
            # Not every store lets a move replace what an earlier attempt has left.
            if self.fs.get_file_info(self.path).type != arrow_fs.FileType.NotFound:
                self.fs.delete_file(self.path)
            self.fs.move(self.open_path, self.path)
            self.out, self.made, self.size = None, self.made + 1, 0


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every row; a null payload is empty."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.length("payload") >= LEAST_PAYLOAD
    firsts = (
        rows.where(large & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first < last")
        .select("digest", "first")
    )
    return rows.join(firsts, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> int:
    """Writes a record for every row into archives below `folder`; returns their number.

    `folder` must be one that all executors reach and that pyarrow can write to (a shared
    mount, hdfs, s3, gs). Null payloads are empty, null addresses and ids are empty headers;
    rows that repeat an id are each a record. Of rows that share id and payload all are
    responses, since none comes after the other.
    """
    rows = with_revisits(pages, id_col, url_col, payload_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, TaskContext.get().partitionId())
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(record(*values))
        writer.close()
        yield pa.record_batch([pa.array([writer.made], pa.int32())], names=["archives"])

    file_system, root = arrow_fs.FileSystem.from_uri(folder)
    file_system.create_dir(root, recursive=True)
    return rows.mapInArrow(run, "archives int").agg(F.coalesce(F.sum("archives"), F.lit(0))).first()[0]


# --- reading -------------------------------------------------------------------------------

_RECORD = pa.schema(
    [
        ("archive", pa.string()),
        ("record", pa.int64()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)
_RECORD_DDL = (
    "archive string, record bigint, record_type string, page_id bigint, url string,"
    " refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, error string"
)


# Compressed bytes that go to the decoder at a time.
_CHUNK = 1 << 14


def frames(content: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """(decoded frame, error) for each frame behind the dictionary."""
    start, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == _SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        data, start = content[8 : 8 + size], 8 + size
        if len(data) < size:
            yield None, "the dictionary frame is cut short"
            return
        if data[:4] == _FRAME:
            data = zstandard.ZstdDecompressor().decompress(data)
        dictionary = _as_dictionary(data)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(content)
    while start < len(content):
        one, parts, at = reader.decompressobj(), [], start
        try:
            # In chunks: what a frame does not use of its last chunk is copied, not the whole rest.
            while at < len(content) and not one.eof:
                parts.append(one.decompress(view[at : at + _CHUNK]))
                at += _CHUNK
        except zstandard.ZstdError as error:
            yield None, f"the frame cannot be decoded: {error}"
            # The frame's length is lost with it; go on at the next frame mark.
            start = content.find(_FRAME, start + 4)
            if start < 0:
                return
            continue
        if not one.eof:
            yield None, "the last frame is cut short"
            return
        start = min(at, len(content)) - len(one.unused_data)
        yield b"".join(parts), None


def parsed(data: bytes) -> dict:
    """The fields of one record; `error` tells the first thing that does not hold."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return {"error": "no WARC version line and headers"}
    named: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return {"error": f"no header line: {line[:40]}"}
        named[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in named:
            return {"error": f"header {name} is missing"}
    size = named["content-length"]
    if not size.isdecimal() or rest[int(size) :] != b"\r\n\r\n":
        return {"error": "Content-Length does not fit the block"}
    block = rest[: int(size)]
    payload = block.partition(b"\r\n\r\n")[2]
    kind = named["warc-type"]
    digest = named.get("warc-payload-digest", "").removeprefix("sha256:")
    length = named.get("x-payload-length", "")
    found = {
        "record_type": kind,
        "page_id": int(named["x-page-id"]) if named.get("x-page-id") else None,
        "url": named.get("warc-target-uri"),
        "refers_to": int(named["x-refers-to-page"]) if named.get("x-refers-to-page") else None,
        "payload_digest": digest or hashlib.sha256(payload).hexdigest(),
        "payload_bytes": len(payload) if kind != "revisit" else int(length) if length.isdecimal() else None,
        "payload": payload if kind != "revisit" else None,
    }
    own = named.get("warc-block-digest", "").removeprefix("sha256:")
    if own and own != hashlib.sha256(block).hexdigest():
        found["error"] = "the block does not have its digest"
    elif kind != "revisit" and digest and digest != hashlib.sha256(payload).hexdigest():
        found["error"] = "the payload does not have its digest"
    return found


def _read(with_payload: bool):
    names = _RECORD.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    path = batch.column(0)[i].as_py()
                    for number, (data, error) in enumerate(frames(batch.column(1)[i].as_py())):
                        found = {"error": error} if data is None else parsed(data)
                        if not with_payload:
                            found.pop("payload", None)
                        found |= {"archive": path, "record": number}
                        yield tuple(found.get(n) for n in names)

        yield from batches_of(rows(), _RECORD, 200)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives (*.warc.zst) below `folder`, and what does not hold.

    archive, record (its number), record_type, page_id, url, refers_to, payload_bytes,
    payload_digest, payload (null for revisits), error (null for a sound record). A revisit's
    length and digest are those of the whole payload it stands for. A folder without archives
    gives no rows.
    """
    files = (
        spark.read.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.warc.zst")
        .load(folder)
    )
    return files.select("path", "content").mapInArrow(_read(with_payload), _RECORD_DDL)


def round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Writes all rows to archives in the shared folder and reads the archives back.

    A null payload is written as an empty one; rows without an id or with a repeated one are
    records like others; an empty table gives no archive and no record. An archive is one row
    when it is read, so a payload near 2 GB cannot be read back.
    """
    folder = scratch(pages.sparkSession, "warc")
    if not re.match(r"\w+:", folder):
        folder = f"file://{folder}"
    write_archives(pages, folder, id_col, url_col, payload_col)
    return read_archives(pages.sparkSession, folder)
