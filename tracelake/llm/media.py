"""Media columns: lossless image archives behind a custom Spark data source.

Layout of an archive directory: ``<write>-<task>.arc`` files hold members one after another, each a
20-byte header (magic, key length, media length, CRC-32 of key and media) + key + PNG; the file ends with the
member offsets, their number and a closing magic. ``_committed-<write>.json`` names the archives of
a finished write, so files of failed or repeated tasks are never read.

Reading plans byte ranges over the committed archives, at most ``MOST_RANGES`` of them; a member belongs to the
range in which its header starts. Each member is read and checked on its own: after a failed read, or a
failure to open or close the archive, only that member is fetched again, by its offset, after a
growing pause. Member indexes and commit files are read the same way. Batches of bounded bytes go to Spark through Arrow.

Defined results: null text is stored as an empty payload (576 filler bytes); a null key stays null;
repeated keys are repeated members; an empty table gives an archive directory without members;
extra columns are ignored. Texts are stored whole, whatever their length: a task holds one member whole
(its text, its pixels and its PNG, some four times the text) besides the batch it stands in.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .scratch import new_path, short_batches, store_address, store_of
from .textbytes import utf8_list

WIDTH = 576
FILLER = b"\xff"
MAGIC = b"MEM1"
CLOSING = b"ARC1"
HEADER = struct.Struct("<4siqI")
FOOTER = struct.Struct("<q4s")
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
MOST_RANGES = 100_000
ATTEMPTS = 4
PAUSE_SECONDS = 0.2
PNG_START = b"\x89PNG\r\n\x1a\n"

SCHEMA = "doc_id bigint, archive string, member_offset bigint, media binary"


# ---- the lossless 8-bit form -------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """Filler bytes up to a positive multiple of the row width."""
    rows = max(1, -(-len(text) // WIDTH))
    return text + FILLER * (rows * WIDTH - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(payload: bytes) -> bytes:
    """An 8-bit grey PNG, 576 pixels wide, one pixel a byte."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(pixels), WIDTH + 1), np.uint8)
    lines[:, 1:] = pixels
    head = struct.pack(">IIBBBBB", WIDTH, len(pixels), 8, 0, 0, 0, 0)
    return PNG_START + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def pixels_of(media: bytes) -> np.ndarray:
    """The pixels of a PNG written by ``png_of`` (each chunk's CRC is checked)."""
    if media[:8] != PNG_START:
        raise ValueError("not a PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    return lines[:, 1:]


def feature_of(pixels: np.ndarray) -> str:
    """Mean, deviation and horizontal contrast of the grey values, and a 64-bit brightness hash."""
    flat = pixels.reshape(-1).astype(np.float64)
    contrast = np.abs(np.diff(pixels.astype(np.int16), axis=1)).mean()
    cells = np.array([x.mean() for x in np.array_split(flat, 64)])
    code = int("".join("1" if x else "0" for x in cells >= np.median(cells)), 2)
    return f"mean={flat.mean():.4f};std={flat.std():.4f};contrast={contrast:.4f};ahash={code:016x}"


# ---- the data source ---------------------------------------------------------------------------


@dataclass
class ByteRange(InputPartition):
    """Members of ``archive`` whose header starts in [start, end)."""

    archive: str
    start: int
    end: int
    index_at: int
    members: int

    def __init__(self, archive: str, start: int, end: int, index_at: int, members: int):
        self.archive, self.start, self.end, self.index_at, self.members = archive, start, end, index_at, members


@dataclass
class Wrote(WriterCommitMessage):
    archive: str
    index_at: int
    members: int


class Retried:
    """An open file whose reads are repeated: after any failure it is opened anew, after a pause that doubles."""

    def __init__(self, open_file, path: str, attempts: int = ATTEMPTS, pause: float = PAUSE_SECONDS):
        self.open_file, self.path, self.attempts, self.pause, self.file = open_file, path, attempts, pause, None

    def close(self) -> None:
        file, self.file = self.file, None
        try:
            if file is not None:
                file.close()
        except OSError:
            pass  # what was read is checked, so a failed close loses nothing

    def do(self, action, what: str):
        """``action(file)``; OSError, struct.error and ValueError lead to another attempt."""
        last: Exception | None = None
        for k in range(self.attempts):
            if k:
                time.sleep(self.pause * 2 ** (k - 1))
            try:
                if self.file is None:
                    self.file = self.open_file()
                return action(self.file)
            except (OSError, struct.error, ValueError) as e:
                last = e
                self.close()
        raise OSError(f"{self.path}: {what} can't be read after {self.attempts} attempts") from last


def read_exactly(file, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise OSError(f"{len(data)} bytes read where {size} are")
    return data


def read_member(archive: Retried, at: int) -> tuple[int | None, bytes]:
    """One member by its offset; a failed or damaged read is repeated for this member alone."""

    def once(file):
        magic, key_bytes, media_bytes, crc = HEADER.unpack(read_exactly(file, at, HEADER.size))
        if magic != MAGIC:
            raise OSError("no member starts here")
        body = read_exactly(file, at + HEADER.size, key_bytes + media_bytes)
        key, media = body[:key_bytes], body[key_bytes:]
        if zlib.crc32(media, zlib.crc32(key)) != crc:
            raise OSError("the member's checksum differs")
        return (int(key) if key else None), media

    return archive.do(once, f"member at {at}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))

    def partitions(self):
        import pyarrow.fs as fs

        store, root = store_of(self.path)
        archives = []
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("_committed-"):
                commit = Retried(lambda path=info.path: store.open_input_stream(path), info.path)
                archives += commit.do(lambda f: json.loads(f.read()), "commit")
                commit.close()
        size = max(self.range_bytes, -(-sum(index_at for _, index_at, _ in archives) // MOST_RANGES))
        out = [ByteRange(name, start, min(index_at, start + size), index_at, members) for name, index_at, members in archives for start in range(0, index_at, size)]
        return out or [ByteRange("", 0, 0, 0, 0)]

    def read(self, part):
        if not part.archive:
            return
        store, root = store_of(self.path)
        path = f"{root}/{part.archive}"
        archive = Retried(lambda: store.open_input_file(path), path)
        offsets = np.frombuffer(archive.do(lambda f: read_exactly(f, part.index_at, 8 * part.members), "index"), "<i8")
        mine = offsets[(offsets >= part.start) & (offsets < part.end)]
        names = ["doc_id", "archive", "member_offset", "media"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        size = 0
        for at in mine.tolist():
            key, media = read_member(archive, at)
            rows.append((key, part.archive, at, media))
            size += len(media)
            if size >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
        archive.close()


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes one archive; only those that the commit names count."""

    def __init__(self, options):
        self.path = options["path"]
        self.name = uuid.uuid4().hex

    def write(self, iterator):
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        archive = f"{self.name}-{uuid.uuid4().hex}.arc"
        offsets: list[int] = []
        at = 0
        with store.open_output_stream(f"{root}/{archive}", compression=None) as out:
            for batch in iterator:
                keys = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                medias = batch.column(batch.schema.get_field_index("media")).to_pylist()
                for key, media in zip(keys, medias):
                    name = b"" if key is None else str(key).encode()
                    out.write(HEADER.pack(MAGIC, len(name), len(media), zlib.crc32(media, zlib.crc32(name))) + name + media)
                    offsets.append(at)
                    at += HEADER.size + len(name) + len(media)
            out.write(np.array(offsets, "<i8").tobytes() + FOOTER.pack(len(offsets), CLOSING))
        return Wrote(archive, at, len(offsets))

    def commit(self, messages):
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        done = [[m.archive, m.index_at, m.members] for m in messages if m is not None]
        with store.open_output_stream(f"{root}/_committed-{self.name}.json") as out:
            out.write(json.dumps(done).encode())

    def abort(self, messages):
        store, root = store_of(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.archive}")


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(dir)`` and ``df.write.format("media_archive")``."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options)


# ---- the operator ------------------------------------------------------------------------------


@F.arrow_udf(T.BinaryType())
def _media(texts: pa.Array) -> pa.Array:
    return pa.array([png_of(padded(x)) for x in utf8_list(texts)], pa.binary())


_READ_BACK = T.StructType(
    [T.StructField(n, T.StringType() if n in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_bytes")]
)


@F.arrow_udf(_READ_BACK)
def _read_back(medias: pa.Array) -> pa.Array:
    rows = []
    for media in medias.to_pylist():
        pixels = pixels_of(media)
        payload = pixels.tobytes()
        rows.append(
            {
                "payload_bytes": len(payload),
                "payload_sha256": hashlib.sha256(payload).hexdigest(),
                "tail_crc32": zlib.crc32(payload[-32:]),
                "media_bytes": len(media),
                "media_sha256": hashlib.sha256(media).hexdigest(),
                "feature": feature_of(pixels),
                "n_bytes": unpadded(payload),
            }
        )
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_bytes", pa.int64())]
    return pa.array(rows, pa.struct(kinds))


def unpadded(payload: bytes) -> int:
    """Bytes before the filler: UTF-8 never holds byte 255."""
    return len(payload.rstrip(FILLER))


def write_media(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Store every whole text as a PNG member of the archive directory ``path``."""
    spark = documents.sparkSession
    store_address(path)
    spark.dataSource.register(MediaArchive)
    rows = short_batches(documents).select(F.col(key).cast("bigint").alias("doc_id"), _media(F.col(text)).alias("media"))
    rows.write.format("media_archive").option("path", path).mode("append").save()


def read_media(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, archive, member_offset, media) of a directory, by byte ranges."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangebytes", str(range_bytes)).load(path)


def media_columns(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Write the media archive of ``documents``, read it back and derive payload and feature columns."""
    spark = documents.sparkSession
    path = path or new_path(spark, "media")
    write_media(documents, path)
    return read_media(spark, path).withColumn("_m", _read_back("media")).select("doc_id", "archive", "member_offset", "_m.*")
