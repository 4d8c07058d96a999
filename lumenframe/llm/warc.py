"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing sorts each partition and names files by partition, so a task that runs again writes the same files; a file
appears under its name only when it is whole. The folder must be reachable from all executors. Reading takes any
folder that Spark can read, checks the dictionary frame, the version line, header syntax, required headers, lengths,
record ends and payload digests, and raises ``ValueError`` on the first that fails.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is the response, the others
revisit it; a revisit keeps the response's payload length (in its HTTP head) and digest.

Edge cases: null html is an empty payload. Rows without an id never are the smallest; if all of a payload's rows lack
one, each is a response. Rows that repeat the smallest id are responses too. Null urls give no target header; line
breaks in a url are percent-encoded. An empty table gives no archive and reads back as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.batches import Columns, map_columns
from lumenframe.plans.scratch import cut, scratch_path

DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
REQUIRED = ("warc-record-id", "warc-type", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes after which a new archive begins, records that a dictionary is made from, its bytes.
ROLL_BYTES, DICTIONARY_RECORDS, DICTIONARY_BYTES = 16 << 20, 64, 16 << 10
READ_SCHEMA = "record_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long"


def urn(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=page & (1 << 64) - 1) if page is not None else uuid.UUID(int=1 << 64)}>"


def from_urn(text: str) -> int | None:
    n = uuid.UUID(text.strip("<>").removeprefix("urn:uuid:")).int
    return None if n >> 64 else n - (1 << 64) if n >> 63 else n


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC-Type: " + ("revisit" if revisit else "response"), "WARC-Record-ID: " + urn(page), f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", "WARC-Refers-To: " + urn(refers_to)]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A leading dictionary frame and a frame per record. Where there is too little to train a dictionary on, the first
    record itself is one."""
    try:
        d = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:65536] for r in records[:DICTIONARY_RECORDS]])
    except zstandard.ZstdError:
        d = zstandard.ZstdCompressionDict(records[0][:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = d.as_bytes()
    c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw + b"".join(map(c.compress, records))


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, read off its header and its blocks' headers."""
    if bytes(data[at : at + 4]) != zstandard.FRAME_HEADER or at + 5 > len(data):
        raise ValueError(f"bad frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if end + 3 > len(data):
            raise ValueError(f"frame at byte {at} cut short")
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind = bool(head & 1), head >> 1 & 3
        end += 3 + (1 if kind == 1 else head >> 3)
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise ValueError(f"frame at byte {at} cut short")
    return end


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in time linear in its bytes."""
    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("dictionary frame cut short")
        if raw[:4] == zstandard.FRAME_HEADER:  # it may be compressed itself
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        known, at = zstandard.ZstdCompressionDict(raw), 8 + size
    z = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        end = frame_end(view, at)
        o = z.decompressobj()
        try:
            out = o.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"bad frame at byte {at}: {e}") from e
        if not o.eof or o.unused_data:
            raise ValueError(f"bad frame at byte {at}")
        at = end
        yield out


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and block."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or version != VERSION:
        raise ValueError(f"no WARC record: {raw[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name.lower() in headers:
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ValueError(f"headers missing: {missing}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"length of {headers['warc-record-id']} doesn't agree")
    return headers, rest[:-4]


def row(headers: dict[str, str], block: bytes) -> tuple[tuple, bytes | None]:
    """READ_SCHEMA's values and the payload (None: revisit)."""
    http, found, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers["warc-type"]
    if not found or size is None or kind not in ("response", "revisit"):
        raise ValueError(f"bad block or type in {headers['warc-record-id']}")
    if kind == "response" and (size != len(payload) or digest != digest_of(payload)):
        raise ValueError(f"payload of {headers['warc-record-id']} doesn't agree with its length or digest")
    if kind == "revisit" and (payload or len(digest) != 32 or "warc-refers-to" not in headers):
        raise ValueError(f"bad revisit {headers['warc-record-id']}")
    refers = from_urn(headers["warc-refers-to"]) if kind == "revisit" else None
    return (from_urn(headers["warc-record-id"]), kind, headers.get("warc-target-uri"), size, digest, refers), payload if kind == "response" else None


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes archives into ``folder``; the manifest (path, records, bytes)."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(firsts, "digest", "left").select("id", "url", "payload", "first", "digest").sortWithinPartitions("id", "digest", "url")

    def write(batches: Iterator[Columns]) -> Iterator[Columns]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Columns:
            name, data = f"part-{task:06d}-{at:05d}.warc.zst", archive(held)
            hidden = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden) as f:
                f.write(data)
            fs.move(hidden, f"{base}/{name}")
            return {"path": [f"{folder}/{name}"], "records": [len(held)], "bytes": [len(data)]}

        for b in batches:
            for i, u, p, first in zip(b["id"], b["url"], b["payload"], b["first"], strict=True):
                held.append(record(i, u, p, first, first is not None and i != first, date))
                size += len(p)
                if size >= roll_bytes:
                    yield flush()
                    at, held, size = at + 1, [], 0
        if held:
            yield flush()

    return cut(map_columns(rows, write, "path string, records long, bytes long"), "warc-manifest")


def read_warc(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of all archives in ``folder``."""

    def read(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            for data in b["content"]:
                names = ["record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload
                found = ((*r, p) if payload else r for r, p in (row(*parse(x)) for x in frames(data)))
                while part := [r for _, r in zip(range(256 if payload else 8192), found)]:
                    yield dict(zip(names, map(list, zip(*part, strict=True)), strict=True))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return map_columns(files.select("content"), read, READ_SCHEMA + ", payload binary" * payload)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` into archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    fs.create_dir(base, recursive=True)
    write_warc(pages, folder if "://" in folder else f"file://{folder}", min_bytes=min_bytes)
    return read_warc(spark, folder)
