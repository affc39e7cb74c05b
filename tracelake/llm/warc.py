"""WARC archives in seekable Zstandard bundles.

A bundle is a ``.warc.zst`` file: frames that decompress on their own, each with some records, then a
skippable frame with the seek table (compressed and plain size of every frame, and a footer with
their number and a magic), so any frame can be read without those before it. The index maps each
record id to (bundle, frame, offset in the frame's plain bytes, length).

Bundles travel as binary rows of a Parquet table, so any storage that Spark writes will do and a
lost executor costs one task; ``export_bundles`` puts them out as files.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, that with the largest id is the response and
the others revisit it. Defined results: null html is an empty payload; if several rows share the
largest id they all are responses; a null id is never the largest, and a group with null ids only
is all response; an empty table gives no bundle; extra columns are ignored. A record is held whole by
the task that writes or reads it, and a frame holds at least one record, however long.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import short_batches, store_address, store_of, stored

LEAST_REVISIT = 1000
BROADCAST_GROUPS = 200_000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
WHEN = "2024-01-01T00:00:00Z"
BUNDLES = "bundle_id string, archive binary, n_records bigint, index array<struct<page_id:bigint,frame:int,offset:int,length:int>>"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {WHEN}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    body = payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = b""
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse_records(plain: bytes):
    """(offset, headers, body) of every record of a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record starts here")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield at, head, plain[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, plain) sizes and the footer."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    sizes = np.frombuffer(archive, "<u4", 2 * count, len(archive) - 9 - 8 * count).reshape(-1, 2)
    starts = np.concatenate([[0], np.cumsum(sizes[:, 0], dtype=np.int64)])
    return [(int(starts[i]), int(sizes[i, 0]), int(sizes[i, 1])) for i in range(count)]


def read_frame(archive: bytes, frame: tuple[int, int, int]) -> bytes:
    start, size, plain = frame
    return zstandard.ZstdDecompressor().decompress(archive[start : start + size], max_output_size=plain)


def read_record(archive: bytes, frame: int, offset: int, length: int):
    """(headers, body) of one record: only its frame is decompressed."""
    plain = read_frame(archive, read_seek_table(archive)[frame])
    return next(parse_records(plain[offset : offset + length]))[1:]


class BundleWriter:
    """Collects records into frames and frames into bundles of bounded size."""

    def __init__(self, frame_bytes: int, bundle_bytes: int):
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.start()

    def start(self) -> None:
        self.parts, self.frames, self.index, self.plain = [], [], [], bytearray()
        self.size = 0

    def add(self, page_id, record: bytes) -> dict | None:
        if self.plain and len(self.plain) + len(record) > self.frame_bytes:
            self.end_frame()
        self.index.append({"page_id": page_id, "frame": len(self.frames), "offset": len(self.plain), "length": len(record)})
        self.plain += record
        return self.finish() if self.size + len(self.plain) >= self.bundle_bytes else None

    def end_frame(self) -> None:
        packed = self.pack.compress(bytes(self.plain))
        self.parts.append(packed)
        self.frames.append((len(packed), len(self.plain)))
        self.size += len(packed)
        self.plain = bytearray()

    def finish(self) -> dict | None:
        if not self.index:
            return None
        if self.plain:
            self.end_frame()
        archive = b"".join(self.parts) + seek_table(self.frames)
        out = {"bundle_id": hashlib.sha256(archive).hexdigest()[:32], "archive": archive, "n_records": len(self.index), "index": self.index}
        self.start()
        return out


_BUNDLE_KIND = pa.schema([("bundle_id", pa.string()), ("archive", pa.binary()), ("n_records", pa.int64()), ("index", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))])


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which rows revisit which.

    (digest, largest id) of repeated payloads is gathered first, with partial sums. If these are checked to be few,
    they go to all tasks and no payload is shuffled. Else payloads of frequent digests (at most
    ``broadcast_groups``) are matched where they are, and only the others are shuffled by digest; short payloads never are.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= least
    groups = stored(rows.where(long).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = groups if count <= broadcast_groups else groups.where(F.col("n") * broadcast_groups >= total)
    joined = rows.join(F.broadcast(often.drop("n")), "digest", "left")
    if count > broadcast_groups:
        open_rows, rare = joined.where(long & F.col("response").isNull()).drop("response"), groups.where(F.col("n") * broadcast_groups < total).drop("n")
        joined = joined.where(~long | F.col("response").isNotNull()).unionByName(open_rows.join(rare, "digest", "left"))
    refers = F.when(long & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """One row per bundle: (bundle_id, archive, n_records, index)."""

    def pack(batches):
        writer = BundleWriter(frame_bytes, bundle_bytes)
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                done = writer.add(page_id, _record(page_id, url, payload, digest, refers_to))
                if done:
                    yield pa.RecordBatch.from_pylist([done], _BUNDLE_KIND)
        done = writer.finish()
        if done:
            yield pa.RecordBatch.from_pylist([done], _BUNDLE_KIND)

    return with_revisits(short_batches(pages)).mapInArrow(pack, BUNDLES)


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, bundle_id string, frame int, frame_offset int"
_READ_KIND = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("bundle_id", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int32())])


def _id_of(urn: str | None) -> int | None:
    name = urn.strip("<>").rsplit(":", 1)[1] if urn else "null"
    return None if name == "null" else int(name)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row per record, read from the archives; a response's digest is recomputed and checked."""

    def unpack(batches):
        for batch in batches:
            for bundle_id, archive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for k, frame in enumerate(read_seek_table(archive)):
                    for at, head, body in parse_records(read_frame(archive, frame)):
                        digest = base64.b32decode(head["WARC-Payload-Digest"].split(":")[1]).hex()
                        kind, size = head["WARC-Type"], int(head["X-Payload-Length"])
                        if kind == "response" and (hashlib.sha1(body).hexdigest(), len(body)) != (digest, size):
                            raise ValueError(f"{bundle_id}: payload of {head['WARC-Record-ID']} differs from its digest")
                        rows.append({"page_id": _id_of(head["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _id_of(head.get("WARC-Refers-To")), "url": head["WARC-Target-URI"], "bundle_id": bundle_id, "frame": k, "frame_offset": at})
                yield pa.RecordBatch.from_pylist(rows, _READ_KIND)

    return bundles.select("bundle_id", "archive").mapInArrow(unpack, _READ)


def export_bundles(bundles: DataFrame, uri: str) -> None:
    """Write every bundle as ``<bundle_id>.warc.zst`` under ``uri`` (an address with a scheme)."""
    store_address(uri)

    def put(batches):
        store, root = store_of(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, archive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{root}/{name}.warc.zst", compression=None) as out:
                    out.write(archive)
        yield pa.RecordBatch.from_pylist([], pa.schema([("done", pa.int64())]))

    bundles.select("bundle_id", "archive").mapInArrow(put, "done bigint").count()
