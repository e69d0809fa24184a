"""WARC archives with dictionary compression (operator 4): one record per page, each its own Zstandard frame.

An archive (.warc.zst) starts with a skippable frame that holds a dictionary trained on its own first records; every record follows as a
frame compressed with it, so any record can be read alone. Pages of equal payload are found by digest with one small row per page; the
page with the smallest id is written in full (response), the others refer to it (revisit). Tasks write archives of their own to a shared
folder, under names that carry the attempt, and return one manifest row per archive. Only archives in the manifest count, so a task that
runs again leaves a file that nobody reads.

Defined cases: a null html is an empty payload; a null url leaves the target out; equal ids of equal payload are both the response or both
revisits; a null id is a revisit of the smallest id with its payload, a response where there is none; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from mediagraph.session import checkpoint_dir, cut

DICTIONARY_FRAME = 0x184D2A5D
#: Size of a dictionary, and of the records it is trained on; size at which a task starts another archive.
DICTIONARY_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES = 64 << 10, 2 << 20, 1 << 30
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def with_targets(pages: DataFrame, id_col: str, url: str, html: str, least: int = 0) -> DataFrame:
    """(page_id, url, html, first): the page that holds the payload in full, for pages of at least `least` bytes."""
    rows = pages.select(F.col(id_col).cast(LongType()).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "html", "first")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    revisit = first is not None and first != page_id
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes]):
    """A dictionary from these records: trained, or their own bytes where there are too few to train on."""
    import zstandard

    sample, size = [], 0
    for r in records:
        sample.append(r[: 128 << 10])
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def place(path: str):
    """File system and path of a shared place."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives to `folder`; the manifest (path, records, bytes) is a written table."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page_id, target, text, first in zip(*batch.columns, strict=True):
                yield record_bytes(page_id.as_py(), target.as_py(), text.as_py().encode(), first.as_py(), date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task, source, number, ended = TaskContext.get(), records(batches), 0, False
        while not ended:
            first, size = [], 0
            for r in source:
                first.append(r)
                size += len(r)
                if size >= SAMPLE_BYTES:
                    break
            if not first:
                return
            dictionary = trained(first)
            press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
            path = f"{folder}/part-{task.partitionId():05d}-{number:03d}-{task.taskAttemptId()}.warc.zst"
            files, local = place(path)
            files.create_dir(local.rsplit("/", 1)[0], recursive=True)
            count = 0
            with files.open_output_stream(local, compression=None) as out:
                raw = dictionary.as_bytes()
                out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
                ended = True
                for r in (x for part in (first, source) for x in part):
                    out.write(press.compress(r))
                    count += 1
                    size += len(r)
                    if size >= ARCHIVE_BYTES:
                        ended = False
                        break
                written = out.tell()
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [written]})

    return cut(with_targets(pages, id_col, url, html).mapInArrow(run, MANIFEST))


def frames(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, one by one."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't start with its dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    rest = stream.read(block)
    while rest:
        one, parts = unpack.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data or stream.read(block)
                break
            rest = stream.read(block)
            if not rest:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def parsed(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, size, digest, number("WARC-Refers-To"), payload if kind == "response" else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives in `manifest`, their payloads checked against their digests. A revisit has no payload of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, local = place(path)
                rows, size = [], 0
                with files.open_input_stream(local, compression=None) as stream:
                    for record in frames(stream):
                        rows.append(parsed(record))
                        size += len(record)
                        if size > 8 << 20:
                            yield give(rows)
                            rows, size = [], 0
                if rows:
                    yield give(rows)

    spread = manifest.select("path").repartition(max(1, 2 * manifest.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(run, RECORD)


def archive_folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
