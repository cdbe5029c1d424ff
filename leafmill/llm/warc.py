"""WARC archives of Zstandard frames: one writer, one reader.

An archive is a leading skippable frame that holds the dictionary, then one frame per record. Each task of the
writer makes archives of about ``ARCHIVE_BYTES`` and trains the dictionary of each on its first records. An
archive is written under a name of its own and renamed to ``<task>-<number>`` when complete; a task that runs
again writes the same names, so a lost executor leaves no half and no second archive.

Payloads that repeat are written once: of the records with equal payloads of at least ``REVISIT_BYTES``, the one
with the largest page id is a ``response`` and the others are ``revisit`` records that refer to it. Equality is
that of SHA-256; the table of repeated payloads is a map-side combined aggregate that is written first, so that its size
decides the join: a small one is broadcast and no page is shuffled, a large one meets the pages in a join that adaptive
execution may split.

The reader takes the dictionary from the skippable frame, decodes frame by frame, and checks each record: version
line, type, required headers, block length, the HTTP message's length, and the digest of a payload that is there. Where
payloads are not asked for they are checked all the same, but stay in the task.
A damaged record is reported in ``error`` and reading goes on with the next frame; a frame that cannot be
decoded ends its archive with a row that says so.

Defined results: null html is an empty payload; a null page id is written as none and comes back null; repeated
rows give a record each, and rows with equal id and payload are all the response if their id is the largest;
pages without address get an empty one; an empty table makes no archive and gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.shared import settle

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 48 << 20
TRAIN_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
#: An archive is handed to the decoder in pieces: what is left of a piece after a frame is copied.
PIECE_BYTES = 16 << 10
LEVEL = 3
#: The fixed values of the format: the magic number of its dictionary frame, the profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_ID = "urn:page:"

RECORD = (
    "archive string, record int, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary, error string"
)
_SCHEMA = pa.schema([
    ("archive", pa.string()), ("record", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
])


def _digest(hex_: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_)).decode()


def _id(page: int | None) -> str:
    return f"<{_ID}{'' if page is None else page}>"


def record_bytes(page: int | None, url: str, payload: bytes | None, size: int, digest: str, refers: int | None) -> bytes:
    """A response record, or a revisit where ``payload`` is None."""
    revisit = payload is None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: {_digest(digest)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def trained(samples: list[bytes]) -> bytes:
    """A dictionary for records like these; their own beginning where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def archives(records: Iterator[bytes]) -> Iterator[bytes]:
    """Records gathered into archives. What is held: one archive."""
    out = bytearray()
    waiting: list[bytes] = []
    size = 0
    packer: zstandard.ZstdCompressor | None = None

    def start() -> None:
        nonlocal packer
        dictionary = trained(waiting)
        out.extend(dictionary_frame(dictionary))
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        for record in waiting:
            out.extend(packer.compress(record))
        waiting.clear()

    for record in records:
        if packer is None:
            waiting.append(record)
            size += len(record)
            if size >= TRAIN_BYTES:
                start()
        else:
            out.extend(packer.compress(record))
        if len(out) >= ARCHIVE_BYTES:
            yield bytes(out)
            out.clear()
            packer, size = None, 0
    if waiting:
        start()
    if out:
        yield bytes(out)


def planned(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The records to write: (page, url, size, sha1, refers, html), html null in a revisit."""
    html = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("page"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), html.alias("html"),
        F.octet_length(html).cast("bigint").alias("size"), F.sha1(html.cast("binary")).alias("sha1"), F.sha2(html, 256).alias("same"),
    )
    large = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("same").agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("_n"))
    known = rows.join(settle(large.filter("_n > 1").drop("_n"), "repeated"), "same", "left")
    refers = F.when((F.col("size") >= REVISIT_BYTES) & ~F.col("page").eqNullSafe(F.col("response")), F.col("response"))
    return known.withColumn("refers", refers).select(
        "page", "url", "size", "sha1", "refers", F.when(F.col("refers").isNull(), F.col("html")).alias("html")
    )


def write(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Archives of all ``pages`` under ``path``, a folder that driver and executors share."""
    plan = planned(pages, id_column, url_column, html_column)
    context = pages.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(target)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        task = TaskContext.get().partitionId()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, size, sha1, refers_to, text in zip(*[batch[c] for c in ("page", "url", "size", "sha1", "refers", "html")]):
                    body = text.as_py()
                    yield record_bytes(page.as_py(), url.as_py(), None if body is None else body.encode(), size.as_py(), sha1.as_py(), refers_to.as_py())

        for number, archive in enumerate(archives(records())):
            name = f"{folder}/{task:06d}-{number:04d}.warc.zst"
            part = f"{folder}/_{uuid.uuid4().hex}"
            with store.open_output_stream(part) as stream:
                stream.write(archive)
            try:
                store.move(part, name)
            except OSError:
                # Stores that do not overwrite: another run of this task has written the same archive.
                if store.get_file_info(name).type != pyarrow.fs.FileType.File:
                    raise
                store.delete_file(part)
            yield pa.record_batch([pa.array([name]), pa.array([len(archive)], pa.int64())], ["archive", "bytes"])

    plan.mapInArrow(save, "archive string, bytes bigint").write.format("noop").mode("overwrite").save()


class Damaged(ValueError):
    """A record that breaks the format."""


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    found: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged(f"header without colon: {line[:60]}")
        found[name.strip().lower()] = value.strip()
    return first, found


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not value.isdigit():
        raise Damaged(f"Content-Length: {value[:20]!r}")
    return int(value)


def _page(value: str) -> int | None:
    if not value.startswith(f"<{_ID}") or not value.endswith(">"):
        raise Damaged(f"record id {value[:60]!r}")
    number = value[len(_ID) + 1 : -1]
    return int(number) if number else None


def parsed(raw: bytes) -> dict:
    """One record's fields; raises ``Damaged``."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise Damaged("no end of headers")
    version, headers = _headers(head)
    if version != "WARC/1.1":
        raise Damaged(f"version {version[:20]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest"):
        if name not in headers:
            raise Damaged(f"{name} is missing")
    size = _length(headers)
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise Damaged(f"block of {len(rest) - 4} bytes, {size} announced")
    message, gap, payload = rest[:size].partition(b"\r\n\r\n")
    _, http = _headers(message)
    if not gap:
        raise Damaged("no end of HTTP headers")
    announced = _length(http)
    kind, digest = headers["warc-type"], headers["warc-payload-digest"]
    if not digest.startswith("sha1:"):
        raise Damaged(f"digest {digest[:20]!r}")
    sha1 = base64.b32decode(digest[5:]).hex()
    out = {"page_id": _page(headers["warc-record-id"]), "url": headers["warc-target-uri"], "record_type": kind, "refers_to": None, "payload_bytes": announced, "payload_digest": sha1, "payload": None}
    if kind == "response":
        if len(payload) != announced:
            raise Damaged(f"payload of {len(payload)} bytes, {announced} announced")
        if hashlib.sha1(payload).hexdigest() != sha1:
            raise Damaged("payload does not have its digest")
        out["payload"] = payload
    elif kind == "revisit":
        if payload:
            raise Damaged("revisit with a payload")
        out["refers_to"] = _page(headers.get("warc-refers-to", ""))
    else:
        raise Damaged(f"type {kind[:20]!r}")
    return out


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded records of an archive; raises ``Damaged`` where its frames do."""
    if len(archive) < 8:
        raise Damaged("no dictionary frame")
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME or len(archive) < 8 + size:
        raise Damaged("no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest, at = memoryview(archive), 8 + size
    while at < len(rest):
        unpacker = reader.decompressobj()
        out = []
        while not unpacker.eof:
            piece = rest[at : at + PIECE_BYTES]
            if not piece:
                raise Damaged("frame: cut off")
            try:
                out.append(unpacker.decompress(piece))
            except zstandard.ZstdError as error:
                raise Damaged(f"frame: {error}") from error
            at += len(piece)
        at -= len(unpacker.unused_data)
        yield b"".join(out)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``, with ``error`` where one breaks the format; without ``payloads`` that column is null."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                out: list[dict] = []
                number, held = -1, 0
                try:
                    for number, raw in enumerate(frames(content.as_py())):
                        try:
                            row = parsed(raw)
                        except (Damaged, ValueError) as error:
                            row = {"error": str(error)}
                        if not payloads:
                            row["payload"] = None
                        out.append({"archive": name, "record": number} | row)
                        held += len(raw) if payloads else 0
                        if held >= 2 << 20 or len(out) >= 10_000:
                            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                            out, held = [], 0
                except Damaged as error:
                    out.append({"archive": name, "record": number + 1, "error": str(error)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return found.mapInArrow(scan, RECORD)
