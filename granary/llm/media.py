"""Media columns: archives of lossless images, read by a data source of byte ranges.

``write_archives`` stores each text's bytes as an 8-bit grey PNG in zip archives;
the data source ``archive_media`` reads such archives; ``features`` decodes the
images that it returns.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

from .common import scratch, ship, stored
from .files import place, publish

#: Samples in a row of an image; payloads are filled up to whole rows.
ROW = 576
FILL = b"\xff"
#: An archive is closed from this size, a partition covers so many bytes, and a batch holds so many.
ARCHIVE_BYTES, SPLIT_BYTES, BATCH_BYTES = 1 << 25, 1 << 24, 1 << 22
TRIES = 4
# Fixed values of the PNG and zip formats.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ZIP_END = b"PK\x05\x06"
ZIP_MEMBER = b"PK\x03\x04"


def payload(data: bytes) -> bytes:
    return data + FILL * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey image with rows of ROW samples, unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> np.ndarray:
    """The samples of an image made by ``to_png``, by row."""
    if image[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG image")
    at, shape, data = 8, None, []
    while at < len(image):
        long, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + long]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + long)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            wide, high, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not an 8-bit grey image")
            shape = high, wide + 1
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + long
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("its rows are filtered")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean and deviation in thousandths, and 64 bits: which of 64 equal parts are brighter than the mean."""
    flat = samples.reshape(-1)
    cuts = np.arange(64) * len(flat) // 64
    parts = np.add.reduceat(flat, cuts, dtype=np.int64)
    long = np.diff(np.append(cuts, len(flat)))
    total = int(flat.sum(dtype=np.int64))
    counts = np.bincount(flat, minlength=256)
    mean = total / len(flat)
    spread = float(np.sqrt(max(0.0, float((counts * np.arange(256) ** 2).sum()) / len(flat) - mean * mean)))
    bits = "".join("1" if x else "0" for x in parts * len(flat) > total * long)
    return f"{samples.shape[1]}x{samples.shape[0]}:{round(mean * 1000)}:{round(spread * 1000)}:{int(bits, 2):016x}"


def _archiving(folder: str):
    def write(batches):
        part, n, members, size = TaskContext.get().partitionId(), 0, 0, 0
        held: io.BytesIO | None = None
        made = []

        def close():
            archive.close()
            name = f"{folder}/part-{part:06d}-{len(made):04d}.zip"
            publish(name, held.getvalue())
            made.append((name, members, size))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                if held is None:
                    held, members, size = io.BytesIO(), 0, 0
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                image = to_png(payload(text or b""))
                archive.writestr(zipfile.ZipInfo(f"{n}_{'' if doc_id is None else doc_id}.png"), image)
                n, members, size = n + 1, members + 1, size + len(image)
                if size >= ARCHIVE_BYTES:
                    close()
                    held = None
        if held is not None:
            close()
        if made:
            yield pa.record_batch([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "members", "bytes"])

    return write


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Stores the text of each row as a member of zip archives below ``folder``.

    Returns (path, members, bytes) for each archive. Names of archives come from
    the task's number and each is published whole, so a task that is run again
    leaves the same files.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_archiving(folder), "path string, members long, bytes long"), "archives")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveSource(DataSource):
    """``spark.read.format("archive_media").load(folder)``: a row for each member.

    Options: path, a folder of zip archives; splitBytes, the bytes of archive
    that a partition covers; onError, "fail" or "keep" (a null media column and
    the reason).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.split = int(options.get("splitBytes", options.get("splitbytes", SPLIT_BYTES)))
        self.keep = options.get("onError", options.get("onerror", "fail")) == "keep"

    def partitions(self) -> list[ByteRange]:
        """Byte ranges up to each archive's directory, whose place its last bytes tell."""
        from pyarrow import fs

        store, inner = place(self.folder)
        found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        ranges = []
        for info in sorted((i for i in found if i.path.endswith(".zip")), key=lambda i: i.path):
            with store.open_input_file(info.path) as f:
                end = _directory_at(f)
            ranges += [ByteRange(info.path, lo, min(lo + self.split, end)) for lo in range(0, end, self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """The members that begin in the range, each fetched, checked and tried again by its own offset."""
        if not partition.path:
            return
        store, _ = place(self.folder)
        with store.open_input_file(partition.path) as f:
            with zipfile.ZipFile(f) as archive:
                members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        rows, size = [], 0
        for m in members:
            data, error = self._member(store, partition.path, m)
            rows.append((partition.path, m.filename, m.header_offset, data, error))
            size += len(data or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _member(self, store, path: str, m: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        for tried in range(1, TRIES + 1):
            try:
                with store.open_input_file(path) as f:
                    return _fetch(f, m), None
            except (OSError, ValueError, zlib.error) as e:
                if tried == TRIES:
                    if self.keep:
                        return None, f"{type(e).__name__}: {e}"
                    raise
                time.sleep(0.05 * 4**tried)


def _directory_at(f) -> int:
    size = f.size()
    tail = f.read_at(min(22, size), max(0, size - 22))
    if tail[:4] == ZIP_END and struct.unpack_from("<I", tail, 16)[0] != 0xFFFFFFFF:
        return struct.unpack_from("<I", tail, 16)[0]
    f.seek(0)
    with zipfile.ZipFile(f) as archive:  # with a comment, or larger than 4 GB
        return archive.start_dir


def _fetch(f, m: zipfile.ZipInfo) -> bytes:
    head = f.read_at(30, m.header_offset)
    if head[:4] != ZIP_MEMBER:
        raise ValueError(f"no member begins at {m.header_offset}")
    names, extra = struct.unpack_from("<HH", head, 26)
    data = f.read_at(m.compress_size, m.header_offset + 30 + names + extra)
    if m.compress_type == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif m.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"compression {m.compress_type} of {m.filename} is unknown")
    if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
        raise ValueError(f"{m.filename} is damaged")
    return data


_MEMBERS = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MEMBERS)], schema=_MEMBERS)


def read_archives(spark, folder: str, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_media").options(**options).load(folder)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for member, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc_id = member.rpartition("_")[2].removesuffix(".png")
            samples = from_png(media)
            data = samples.tobytes()
            rows.append((int(doc_id) if doc_id else None, len(data.rstrip(FILL)), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def features(media: DataFrame) -> DataFrame:
    """What the images of ``read_archives`` hold, a row for each."""
    return media.where("error IS NULL").select("member", "media").mapInArrow(_described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores all texts as images, reads the archives back and describes them.

    Cases: null and empty texts are one row of fill; an empty table makes no
    archive and gives an empty result; a null doc_id stays null and repeated
    ones are members of their own. Other columns are not read. No text holds a
    byte 255, so the fill can be told from the text.
    """
    folder = folder or scratch(docs.sparkSession, "media")
    write_archives(docs, folder)
    return features(read_archives(docs.sparkSession, folder))
