"""WARC archives of individually compressed records that share a Zstandard dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds its dictionary; then each record is a Zstandard
frame of its own. Archives are rows of a table (name, records, content), so that Spark's commit protocol writes and
repeats them; `export_archives` puts them on a mounted file system as .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sized, stored

DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_SCHEMA = "archive string, records long, content binary"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes], dictionary_bytes: int, sample_bytes: int, level: int) -> bytes:
    """The dictionary is trained on evenly spaced records of the archive itself (their first 64 KB), up to about sample_bytes of
    them. Where there are too few to train on, the dictionary is what the last of them hold, as raw content. Every archive
    begins with its dictionary; records are compressed whole."""
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    out, samples = io.BytesIO(), [r[:65536] for r in records[::step]]
    try:
        dictionary = zstandard.train_dictionary(dictionary_bytes, samples, k=256, d=8)
    except zstandard.ZstdError:
        dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[-dictionary_bytes:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    for r in records:
        out.write(compressor.compress(r))
    return out.getvalue()


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, in order."""
    dictionary, at = None, 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        dictionary, at = zstandard.ZstdCompressionDict(content[8 : 8 + size]), 8 + size
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content[at:]), read_across_frames=True), 1 << 16)
    while line := reader.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            headers[name] = value
        block = reader.read(int(headers["Content-Length"]))
        reader.read(4)
        yield headers, block


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of least_bytes or more, the one with the largest page_id is the response and the others revisit
    it. Rows that share that page_id are all responses; so are rows without a page_id if no row with one is there. Only
    digests that occur twice or more are joined back, as a stored table whose size decides on a broadcast.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumns(
        {"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(F.encode(body, "UTF-8"))}
    )
    big = F.col("payload_bytes") >= least_bytes
    groups = rows.filter(big).groupBy("payload_digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("first_id"))
    groups = stored(groups.filter((F.col("copies") > 1) & F.col("first_id").isNotNull()).select("payload_digest", "first_id"), "warc-groups")
    found = rows.join(sized(groups), "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select(
        "page_id", "url", "html", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, archive_bytes: int = 4 << 20, dictionary_bytes: int = 32 << 10, sample_bytes: int = 1 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """One record per page, in archives of about archive_bytes before compression; returns the stored archives.

    Each task writes the archives of its own rows, so that memory stays at one archive, or at one payload where that is longer.
    Null html is an empty payload, a null url writes no target, and other columns of pages are not looked at. Repeated rows are
    records of their own; an empty table gives no archive.
    """

    def pack(batches):
        part, n = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def archive():
            content = build_archive(held, dictionary_bytes, sample_bytes, level)
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{n:06d}.warc.zst"], "records": pa.array([len(held)], pa.int64()), "content": pa.array([content], pa.binary())})

        for batch in batches:
            for page_id, url, html, digest, kind, ref in zip(*(batch.column(i) for i in range(6))):
                r = _record(page_id.as_py(), url.as_py(), b"" if (b := html.as_py()) is None else b.encode(), digest.as_py(), kind.as_py(), ref.as_py(), date)
                held.append(r)
                size += len(r)
                if size >= archive_bytes:
                    yield archive()
                    held, size, n = [], 0, n + 1
        if held:
            yield archive()

    return stored(with_revisits(pages).mapInArrow(pack, ARCHIVE_SCHEMA), "warc")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of every archive; sizes and digests of responses are taken from the payload as it was read back,
    those of revisits from their headers. With payloads=False the payload column is null."""

    def unpack(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in read_archive(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, who = headers["WARC-Type"], headers["WARC-Record-ID"][len("<urn:page:") : -1]
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        digest = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                    ref = headers.get("WARC-Refers-To")
                    url = headers.get("WARC-Target-URI")
                    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    rows.append((int(who) if who else None, url, size, digest, kind, int(ref[len("<urn:page:") : -1]) if ref else None, payload if payloads and kind == "response" else None))
                if rows:
                    cols = list(zip(*rows))
                    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return archives.select("content").mapInArrow(unpack, RECORD_SCHEMA)


def export_archives(archives: DataFrame, folder: str) -> None:
    """Writes the archives as files into a folder that every executor has mounted."""

    def write(rows):
        for r in rows:
            at = Path(folder, r["archive"])
            part = at.with_suffix(f".{TaskContext.get().taskAttemptId()}.part")
            part.write_bytes(r["content"])
            part.rename(at)

    Path(folder).mkdir(parents=True, exist_ok=True)
    archives.foreachPartition(write)
