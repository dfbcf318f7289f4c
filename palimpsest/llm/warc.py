"""WARC archives: writing, and reading in sequence.

Each record is a gzip member of its own. Of pages with equal payloads of at least ``least`` bytes, the one with the
largest page_id is a response and the others are revisits that refer to it, without the payload; a revisit's HTTP
header keeps the payload's length. Smaller payloads are all responses.

The reader goes through an archive once, in blocks of constant size: it inflates member after member, splits the header,
takes as many bytes as Content-Length says, and compares block and payload digests; a broken archive raises.

A null html is empty; a null url leaves the target out; a null page_id has an id of its own kind and is read back as null. Repeated
rows have a record each; of rows with equal payload and the same largest page_id all are responses. An empty table
gives no rows. Columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Compressed bytes at which an archive is closed; bytes read at a time; zlib level.
ARCHIVE_BYTES, BLOCK, LEVEL = 256 << 20, 1 << 18, 6
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    name = urn[len("<urn:page:") : -1] if urn else "none"
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """A WARC/1.1 record; a revisit if it refers to a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"]),
        *([] if refers_to is None else [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member of ``stream``, its inflated blocks; each must be used up before the next."""
    held = b""
    while held or (held := stream.read(BLOCK)):
        inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)

        def blocks(inflate=inflate):
            nonlocal held
            while not inflate.eof:
                if not held and not (held := stream.read(BLOCK)):
                    raise ValueError("archive ends within a member")
                out = inflate.decompress(held, BLOCK)
                held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out

        yield blocks()


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:])}


def records(stream) -> Iterator[dict]:
    """Records of an archive, verified."""
    for blocks in members(stream):
        held = bytearray()
        for out in blocks:
            held += out
            if (at := held.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise ValueError("a record has no header")
        if not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _headers(bytes(held[:at]))
        length = int(head["content-length"])
        block = held[at + 4 :]
        for out in blocks:
            block += out
        if bytes(block[length:]) != b"\r\n\r\n":
            raise ValueError("Content-Length differs from the block")
        block = bytes(block[:length])
        if head["warc-block-digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
            raise ValueError("block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(_headers(http)["content-length"])
        if head["warc-type"] == "response" and (size != len(payload) or head["warc-payload-digest"] != "sha1:" + hashlib.sha1(payload).hexdigest()):
            raise ValueError("payload digest differs")
        yield {
            "page_id": _page(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "payload_bytes": size,
            "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": head["warc-type"],
            "refers_to": _page(head.get("warc-refers-to")),
            "payload": payload if head["warc-type"] == "response" else None,
        }


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, digest, refers_to.

    Which record a payload's copies refer to is settled on narrow rows, summed before they are shuffled. Only payloads
    that occur more than once are joined back, through page_ids, so a frequent payload is never a key of wide rows.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1("html"))
    narrow = pages.filter(F.octet_length("html") >= least).select("page_id", "digest")
    largest = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = narrow.join(largest, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "refers_to").distinct()
    # A null page_id finds itself by a key of its own.
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return pages.join(revisits, (key("page_id") == key("of")) & (F.col("digest") == F.col("of_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Writes archives under ``folder`` (a URI that executors share); one row (path, records) for each archive.

    A task streams its rows to files under a name of its own attempt; only the files of the attempts that
    succeed are named in the result, which is materialised, so a task that is run again leaves at most a file unused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.file_system(folder)
        fs.create_dir(root, recursive=True)
        out, path, count = None, None, 0
        for batch in common.slices(batches):
            for page_id, url, html, digest, refers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    path, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, zlib.MAX_WBITS | 16)
                out.write(packer.compress(record(page_id, url, html.encode(), refers, digest)) + packer.flush())
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return common.materialize(plan_records(pages, least).mapInArrow(run, "path string, records long"))


def read(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of archives, each streamed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.file_system(folder)
        names = RECORDS.split(", ")
        types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[n.split()[1]] for n in names]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n.split()[0]] for r in rows], t) for n, t in zip(names, types, strict=True)], names=[n.split()[0] for n in names])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=BLOCK) as stream:
                    for r in records(stream):
                        size += 200 + len(r["payload"] or b"") * payloads
                        rows.append(r if payloads else r | {"payload": None})
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    n = archives.count()
    return archives.select("path").repartition(max(1, min(n, 10_000)), "path").mapInArrow(run, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every page written to archives and read back."""
    folder = common.shared_dir(spark)
    back = read(write(common.read(spark, sf_dir, "pages"), folder), folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def parse(raw: bytes) -> list[dict]:
    """Records of an archive in memory."""
    return list(records(io.BytesIO(raw)))
