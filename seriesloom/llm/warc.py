"""Web archives in seekable Zstandard bundles.

Each record is a Zstandard frame of its own, so a bundle is a valid stream of frames. A bundle ends
with a seek table, a skippable frame that lists every frame's compressed and plain size, and the
manifest maps each record to its bundle and to the place of its frame in it. A record is read with
one seek; a bundle whose manifest is lost is read by its seek table.

Of pages with equal payloads the one with the smallest id is written as a response, the others as
revisits that name it. Equal means the same SHA-1 and length; the smallest id per payload is an
aggregate with partial sums, and the pages meet it by a join, so a payload that a third of all pages
share costs no task more than others.

Bundles are written by the tasks, straight to the shared folder, and closed once they reach
``BUNDLE_BYTES``. A file's name holds an id drawn by the attempt that wrote it. Only manifest rows of
attempts that ended are kept, so files of lost or repeated attempts are never read.

A null payload is empty and takes part as such. A null id is the smallest only where its payload has
no other. Repeated rows of the smallest id are responses all; a repeated row is a record of its own.
Null addresses are written as empty. Payloads of any length are taken whole. Other columns, whatever
their names, are left out. An empty table gives no bundles and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table
from .common import map_text

BUNDLE_BYTES = 32 << 20
LEVEL = 3
LEAST = 0
#: fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MANIFEST = "page_id long, bundle string, frame_at long, frame_bytes long, plain_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with the compressed and plain size of each frame, and the footer."""
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(raw: bytes) -> list[tuple[int, int, int]]:
    """``(place, compressed size, plain size)`` of each frame, from the end of a bundle."""
    count, _, magic = struct.unpack("<IBI", raw[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    body, out, at = raw[-9 - 8 * count : -9], [], 0
    for packed, plain in struct.iter_unpack("<II", body):
        out.append((at, packed, plain))
        at += packed
    return out


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its HTTP head and payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = head if revisit else head + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Head fields, HTTP head fields and payload of a record."""
    fields = lambda text: dict(line.split(": ", 1) for line in text.decode("utf-8").split("\r\n")[1:])
    head, rest = raw.split(b"\r\n\r\n", 1)
    record_fields = fields(head)
    block = rest[: int(record_fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return record_fields, fields(http), payload


def classified(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to, revisit``. Payloads under ``least`` bytes
    are responses always."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = base.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    firsts = keyed.select("sha1", "bytes", "page_id").groupBy("sha1", "bytes").agg(F.min("page_id").alias("least_id"), F.count(F.lit(1)).alias("m")).filter((F.col("m") > 1) & (F.col("bytes") >= least))
    same = keyed.join(firsts, ["sha1", "bytes"], "left")
    revisit = F.coalesce(F.col("least_id") != F.col("page_id"), F.col("least_id").isNotNull() & F.col("page_id").isNull())
    return same.select("page_id", "url", "payload", F.when(revisit, F.col("least_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes one record per page below ``folder`` and returns the stored manifest: ``page_id,
    bundle, frame_at, frame_bytes, plain_bytes``, one row per record."""
    names = [c.split(" ")[0] for c in MANIFEST.split(", ")]

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(f"{root}/bundles", recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        out, sizes, rows, at = None, [], [], 0

        def close():
            out.write(seek_table(sizes))
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                if out is None:
                    name = f"bundles/{uuid.uuid4().hex}.warc.zst"
                    out, sizes, rows, at = store.open_output_stream(f"{root}/{name}", compression=None), [], [], 0
                plain = record(page_id, url, payload, digest(payload), refers_to, revisit)
                frame = packer.compress(plain)
                out.write(frame)
                sizes.append((len(frame), len(plain)))
                rows.append((page_id, name, at, len(frame), len(plain)))
                at += len(frame)
                if at >= bundle_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    path = f"{folder}/manifest"
    map_text(classified(pages, least), run, MANIFEST).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Each record of the manifest, read from its frame: ``page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, payload`` (null for a revisit; digest and size are the full
    payload's, and a response's are taken from what was read)."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        opener, name, source = zstandard.ZstdDecompressor(), None, None
        number = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
        for batch in batches:
            rows, held = [], 0
            for bundle, at, size in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame_at", "frame_bytes"))):
                if bundle != name:
                    if source is not None:
                        source.close()
                    name, source = bundle, store.open_input_file(f"{root}/{bundle}")
                source.seek(at)
                head, http, payload = parse(opener.decompress(source.read(size)))
                full, revisit = int(http["Content-Length"]), head["WARC-Type"] == "revisit"
                sha1 = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and (digest(payload) != sha1 or len(payload) != full):
                    raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], number(head.get("WARC-Refers-To")), sha1, full, None if revisit else payload))
                held += len(payload)
                if held > BUNDLE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return map_text(manifest.select("bundle", "frame_at", "frame_bytes"), run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def op8_warc(spark, sf):
    folder = scratch_path(spark, "warc")
    manifest = write_archives(table(spark, sf, "pages"), folder)
    return read_records(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)"
ORACLES = {
    "op8_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS m FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, array_to_string([{_LETTER} FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM g"""
}
