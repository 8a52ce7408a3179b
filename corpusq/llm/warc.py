"""WARC archives compressed by Zstandard with a shared dictionary: writing and reading back."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.storage import scratch, written

#: The type of skippable frame that holds an archive's dictionary, and of Zstandard's own frames. Fixed values of the format.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
#: Records of an archive that its dictionary is made of, and the dictionary's most bytes.
DICTIONARY_FROM, DICTIONARY_BYTES = 64, 32 << 10
#: Payload bytes after which a task begins a new archive.
ARCHIVE_BYTES = 32 << 20
#: Tasks that read archives, where there are so many.
READ_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"


class CorruptArchive(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str | None = None, name: str = "") -> bytes:
    """A response with its payload or, with ``refers_to``, a revisit without one. A page without an id goes by ``name``."""
    body = b"" if refers_to is not None else payload
    head = [
        VERSION, b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), f"WARC-Record-ID: <urn:{f'page:{page_id}' if page_id is not None else f'unnamed:{name}'}>".encode(), b"WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or "").encode(), b"WARC-Date: " + DATE.encode(),
        f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}".encode(), f"X-Payload-Length: {len(payload)}".encode(),
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    return b"\r\n".join([*head, f"Content-Length: {len(body)}".encode(), b"", body, b"", b""])


def archive(records: list[bytes]) -> bytes:
    """A skippable frame with the dictionary, then a frame for each record."""
    text = b"".join(r[:4096] for r in records[:DICTIONARY_FROM])[-DICTIONARY_BYTES:]
    raw = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=3, dict_data=raw, write_checksum=True, write_content_size=True)
    stored = zstandard.ZstdCompressor(level=3).compress(text)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(stored)), stored, *map(pack.compress, records)])


def frames(data: bytes, at: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each frame from ``at`` on, by the sizes that its blocks name."""
    while at < len(data):
        begin = at
        try:
            (magic,) = struct.unpack_from("<I", data, at)
            if magic != ZSTD_FRAME:
                raise CorruptArchive(f"no frame at byte {begin}")
            flags = data[at + 4]
            single = flags >> 5 & 1
            at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = 0
            while not last:
                head = int.from_bytes(data[at : at + 3], "little")
                if at + 3 > len(data):
                    raise CorruptArchive(f"the frame at byte {begin} is cut off")
                last, kind, n = head & 1, head >> 1 & 3, head >> 3
                at += 3 + (1 if kind == 1 else n)
            at += 4 * (flags >> 2 & 1)
        except (struct.error, IndexError) as e:
            raise CorruptArchive(f"the frame at byte {begin} is cut off") from e
        if at > len(data):
            raise CorruptArchive(f"the frame at byte {begin} is cut off")
        yield begin, at


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and body of each record; raises CorruptArchive for what breaks the format."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        raise CorruptArchive("no dictionary in front")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise CorruptArchive("the dictionary is cut off")
    text = data[8 : 8 + size]
    try:
        if text[:4] == struct.pack("<I", ZSTD_FRAME):
            text = zstandard.ZstdDecompressor().decompress(text)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        for begin, end in frames(data, 8 + size):
            yield parsed(unpack.decompress(data[begin:end]))
    except zstandard.ZstdError as e:
        raise CorruptArchive(str(e)) from e


def parsed(own: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = own.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise CorruptArchive("no record header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise CorruptArchive(f"no header field: {line[:40]!r}")
        headers[name.strip().lower().decode()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise CorruptArchive(f"no {name}")
    n = headers["content-length"]
    if not n.isdigit() or len(rest) != int(n) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise CorruptArchive("the content has another length")
    body = rest[:-4]
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest") != f"sha1:{digest(body)}":
        raise CorruptArchive("the payload has another digest")
    return headers, body


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for each page to archives in ``folder``, which all executors can write to; returns path, n_records.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest id is a response and the
    others are revisits that refer to it; rows that repeat the largest id with the same payload are responses too. A
    null html is an empty payload. A row without an id is never referred to: it revisits the largest id of its payload,
    or is a response where its payload has none; its record is named by its archive and place.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # Only payloads of several rows lead to revisits: what occurs once needs no join.
    firsts = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    joined = rows.join(written(firsts, "repeated-payloads"), "sha", "left").withColumn("refers_to", F.when(~F.col("refers_to").eqNullSafe(F.col("page_id")), F.col("refers_to")))
    root, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    root.create_dir(base, recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        task, n, held, size = TaskContext.get(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held, size
            # An attempt has names of its own; what reads the archives takes the returned paths, not the folder.
            path = f"{base}/part-{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}.warc.zst"
            with fs.open_output_stream(path) as f:
                f.write(archive(held))
            out = pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(held)]})
            n, held, size = n + 1, [], 0
            return out

        for batch in batches:
            for i, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held.append(record(i, url, payload, refers_to, name=f"{task.partitionId()}-{n}-{len(held)}"))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return written(joined.select("page_id", "url", "payload", "refers_to").mapInArrow(save, "path string, n_records long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that ``archives`` lists: page_id, url, record_type, refers_to, payload_digest, payload_bytes and
    body. An archive that breaks the format, or has another number of records than listed, fails the job."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    data = f.read()
                out, found = [], 0
                for headers, body in read_archive(data):
                    found += 1
                    name, refers_to = headers["warc-record-id"], headers.get("warc-refers-to")
                    out.append(
                        {
                            "page_id": int(name[10:-1]) if name.startswith("<urn:page:") else None, "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"], "refers_to": int(refers_to[10:-1]) if refers_to else None,
                            "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": int(headers["x-payload-length"]), "body": body,
                        }
                    )
                    if len(out) == 500:
                        yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)
                        out = []
                if found != n:
                    raise CorruptArchive(f"{path} has {found} records, not {n}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)

    # Dealt out evenly by number: partitions that a key makes would be joined to few, as paths are few bytes.
    tasks = max(1, min(archives.count(), READ_TASKS))
    return archives.repartition(tasks).mapInArrow(load, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, body binary")


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("body", pa.binary())])


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in the shared folder and returns the records read back:
    page_id, payload_bytes, payload_digest (base32 SHA-1 of the full payload), record_type, refers_to, url. An empty
    table gives no archive and an empty table."""
    folder = scratch(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, least_bytes=least_bytes)
    return read_archives(pages.sparkSession, archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
