"""Token ids of documents in seekable zstandard files.

A file is a row of independent zstandard frames, then a skippable frame with
the documents' ids and lengths, then the seek table of the zstandard seekable
format: compressed size, plain size and the low 32 bits of the plain data's
XXH64 for each frame. A reader of one document fetches the table and that
document's frame, and nothing else.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, scratch, ship, stored
from .files import place

# Fixed values of the zstandard seekable format.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
#: One of the magic numbers that are free for skippable frames.
INDEX_MAGIC = 0x184D2A50
#: Plain bytes in a frame, and in a file, from which a new one begins.
FRAME_BYTES, FILE_BYTES = 1 << 18, 1 << 26
#: Bytes of text that are encoded at once.
TEXT_BYTES = 1 << 22
#: Pieces of text whose ids a worker remembers, and their greatest length.
MOST_PIECES, LONGEST_PIECE = 200_000, 64
#: Marks that are cut from the end of a piece; not the apostrophe, with which words may begin.
MARKS = ".,;:!?#$%&*|()[]"


def _visible() -> list[str]:
    """The characters by which byte-level vocabularies write bytes: visible ones are themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Texts to packed ids, through a tokenizers file.

    Texts are cut at blanks, tabs and line feeds, and each distinct piece is
    encoded once. That is sound only for tokenizers that drop white space where
    words are cut, which the file tells; others get whole texts. A worker keeps its encoders from task to task, and their pieces during one.
    """

    _kept: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, end: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.end = b"" if end is None else np.array([end], self.width).tobytes()
        self.drops_space, self.plain = self._traits(path)
        self.code = "H" if self.width == "<u2" else "I"
        self.visible = {b: c for b, c in zip(range(256), _visible(), strict=True)}
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def kept(cls, path: str, end: int | None) -> Encoder:
        return cls._kept.get((path, end)) or cls._kept.setdefault((path, end), cls(path, end))

    @staticmethod
    def _traits(path: str) -> tuple[bool, bool]:
        """Whether white space is dropped; and whether words of letters may go to the model as they are.

        They may where runs of letters and of marks are words of their own, case
        is lost, and words reach the model byte by byte.
        """
        import json

        with open(path) as f:
            read = json.load(f)
        cut, normal = read.get("pre_tokenizer") or {}, read.get("normalizer") or {}
        steps = cut.get("pretokenizers") or [cut]
        words = str((steps[0].get("pattern") or {}).get("Regex", ""))
        drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert")) and "[^\\s" in words
        marks = words.endswith("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        kinds = [x.get("type") for x in normal.get("normalizers") or [normal]]
        bytewise = [x.get("type") for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space")
        return drops, drops and marks and bytewise and kinds == ["NFC", "Replace", "Lowercase"] and sys.byteorder == "little"

    def _word(self, letters: str) -> bytes:
        """The ids of a word of letters below 0x250, which no normalisation but that of case changes."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.visible)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Remembers pieces: letters and the marks behind them apart, if these are words of their own."""
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        if len(self.parts) > MOST_PIECES:
            self.parts.clear()
        parts, cut, rest = self.parts, [], []
        parts[""] = b""
        for piece in pieces:
            low = piece.rstrip(MARKS).lower() if self.plain else ""
            marks = piece[len(low) :]
            if low.isalpha() and (low.isascii() or max(low) < "\u0250"):
                if low not in parts:
                    parts[low] = self._word(low)
            else:
                low, marks = "", piece
            if marks not in parts:
                rest.append(marks)
            cut.append((piece, low, marks))
        if rest:
            rest = list(set(rest))
            parts.update(zip(rest, self._encode(rest), strict=True))
        self.pieces.update((p, parts[a] + parts[b]) for p, a, b in cut)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of each text, with the end's.

        Arrow cuts the texts and numbers the distinct pieces; Python sees each of
        these once, and numpy puts their ids in the texts' order.
        """
        if not self.drops_space:
            return [x + self.end for x in self._encode(texts.to_pylist())]
        for blank in ("\n", "\t"):
            texts = pc.replace_substring(texts, blank, " ")
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        pieces, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        found = list(map(self.pieces.get, pieces))
        if None in found:
            new = [p for p, x in zip(pieces, found, strict=True) if x is None]
            self._learn([p for p in new if len(p) <= LONGEST_PIECE])
            found = [x if x is not None else self.pieces.get(p) if len(p) <= LONGEST_PIECE else self._encode([p])[0] for p, x in zip(pieces, found, strict=True)]
            found = [x if x is not None else self._encode([p])[0] for p, x in zip(pieces, found, strict=True)]
        size = np.dtype(self.width).itemsize
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // size
        starts = np.cumsum(lengths) - lengths
        long = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(long)])
        at = np.repeat(starts[codes] - ends[:-1], long) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), self.width)[at].tobytes()
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        cuts = (ends[offsets] * size).tolist()
        return [ids[a:b] + self.end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes in a column, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Writer:
    """One file of frames; ``close`` returns its path, documents and ids."""

    def __init__(self, folder: str, name: str, width: str):
        self.store, inner = place(folder)
        self.store.create_dir(inner, recursive=True)
        # A name for this attempt alone: the manifest lists the files of the attempts that count.
        self.path = f"{inner}/{name}-{uuid.uuid4().hex[:12]}.zsk"
        self.out = self.store.open_output_stream(self.path)
        self.width, self.itemsize = width, np.dtype(width).itemsize
        self.zip = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // self.itemsize)
        self.open.append(ids)
        self.open_bytes += len(ids)
        self.bytes += len(ids)
        if self.open_bytes >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        plain = b"".join(self.open)
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.open, self.open_bytes = [], 0

    def close(self) -> tuple[str, int, int]:
        if self.open_bytes:
            self._frame()
        sink = pa.BufferOutputStream()
        index = pa.record_batch({"doc_id": pa.array(self.docs, pa.int64()), "n": pa.array(self.lengths, pa.int64())}).replace_schema_metadata({"width": self.width})
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_batch(index)
        packed = self.zip.compress(sink.getvalue().to_pybytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)
        self.out.close()
        return self.path, len(self.docs), sum(self.lengths)


class Reader:
    """Random access to a file's documents, by their place in it."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, kind, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not kind & HAS_CHECKSUMS:
            raise ValueError(f"{path} does not end with a seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        self.sums = table[:, 2]
        at = int(self.packed[-1])
        magic, long = struct.unpack("<II", self.file.read_at(8, at))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{path} has no index of documents")
        self.unzip = zstandard.ZstdDecompressor()
        with pa.ipc.open_stream(self.unzip.decompress(self.file.read_at(long, at + 8))) as stream:
            index = stream.read_next_batch()
        self.width = index.schema.metadata[b"width"].decode()
        self.docs, self.lengths = index.column(0), index.column(1).to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(self.lengths) * np.dtype(self.width).itemsize
        self._frame: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._frame[0] != k:
            long = int(self.plain[k + 1] - self.plain[k])
            data = self.unzip.decompress(self.file.read_at(int(self.packed[k + 1] - self.packed[k]), int(self.packed[k])), max_output_size=long)
            if len(data) != long or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self._frame = k, data
        return self._frame[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document; documents do not go beyond a frame."""
        end = int(self.ends[i])
        start = end - int(self.lengths[i]) * np.dtype(self.width).itemsize
        if start == end:
            return np.empty(0, self.width)
        k = int(np.searchsorted(self.plain, start, "right")) - 1
        at = int(self.plain[k])
        return np.frombuffer(self.frame(k)[start - at : end - at], self.width)


def _writing(folder: str, tokenizer: str, end: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches):
        part, files, writer = TaskContext.get().partitionId(), [], None
        encode = Encoder.kept(tokenizer, end)
        for batch in batches:
            for some in by_bytes(batch, 1, TEXT_BYTES):
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(pc.fill_null(some.column(1), "")), strict=True):
                    writer = writer or Writer(folder, f"part-{part:06d}-{len(files):04d}", encode.width)
                    writer.add(doc_id, ids)
                    if writer.bytes >= FILE_BYTES:
                        files.append(writer.close())
                        writer = None
        if writer:
            files.append(writer.close())
        encode.pieces.clear()
        encode.parts.clear()
        give_back()
        if files:
            yield pa.record_batch({"part": [part] * len(files), "file": list(range(len(files))), "path": [f[0] for f in files], "docs": [f[1] for f in files], "ids": [f[2] for f in files]}, schema=_MANIFEST)

    return write


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 2) -> DataFrame:
    """Writes the ids of all rows of ``docs`` below ``folder``, in order of doc_id.

    Returns the manifest: a row for each file, (part, file, path, docs, ids); in
    order of (part, file) the files hold ascending doc_ids, null first. Only
    doc_id and text are read; a null text is an empty one. Rows that share a
    doc_id are documents of their own, one after the other.
    """
    ship(docs.sparkSession)
    order = F.col("doc_id").asc_nulls_first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(order).sortWithinPartitions(order)
    return stored(rows.mapInArrow(_writing(folder, tokenizer, end), "part int, file int, path string, docs long, ids long"), "manifest")


def _reading(store_of: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches):
        store, _ = place(store_of)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(store, path)
                firsts = start + np.cumsum(reader.lengths) - reader.lengths
                for lo in range(0, len(reader.lengths), 10_000):
                    some = range(lo, min(lo + 10_000, len(reader.lengths)))
                    sums = [zlib.crc32(reader.ids(i).astype("<u4").tobytes()) for i in some]
                    yield pa.record_batch({"doc_id": reader.docs.slice(lo, len(some)), "start": pa.array(firsts[lo : lo + len(some)], pa.int64()), "n_tokens": pa.array(reader.lengths[lo : lo + len(some)], pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    return read


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    The driver adds up the ids of the files before each file: a number for each
    64 MB of ids.
    """
    spark = manifest.sparkSession
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r["part"], r["file"])):
        files.append((r["path"], start))
        start += r["ids"]
    rows = spark.createDataFrame(files, "path string, start long")
    return rows.repartition(max(1, len(files))).mapInArrow(_reading(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end: int | None = 2, folder: str | None = None) -> DataFrame:
    """Writes the files, to a scratch folder unless one is given, and reads them back.

    An empty table makes no file and gives an empty result.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_back(write(docs, folder, tokenizer, end), folder)
