"""Payloads stored as images in archives, and a data source that reads archives by byte range.

A task's archives count when its manifest rows are committed. What other attempts at it wrote has other names and is never read.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch_path

#: Samples in a row of an image; payloads are padded to a positive multiple of it.
WIDTH = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
#: Beside the archives: the table of those that count.
MANIFEST = "manifest"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """A greyscale image of 8-bit samples, WIDTH in a row, unfiltered."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made; ValueError if a byte of it is wrong."""
    at, width, data = len(_SIGNATURE), 0, []
    if image[:at] != _SIGNATURE:
        raise ValueError("not an image")
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered image")
    return rows[:, 1:].tobytes()


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Archives:
    """The archives of one partition, begun anew when one is full."""

    def __init__(self, folder: str, part: int, most: int):
        self.files, self.base = _files(folder)
        self.part, self.most, self.made, self.zip = part, most, [], None

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        if self.zip is None:
            # each attempt at a task has names of its own: what a dead one leaves is in no manifest
            self.name = f"{self.base}/part-{self.part:06d}-{TaskContext.get().taskAttemptId()}-{len(self.made):05d}.zip"
            self.out = self.files.open_output_stream(self.name)
            self.zip, self.size, self.count = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED), 0, 0
        image = to_png(payload(text))
        entry = zipfile.ZipInfo(f"{self.count}/{'' if doc_id is None else doc_id}/{len(text or b'')}.png")
        self.zip.writestr(entry, image)
        self.size += len(image)
        self.count += 1
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            size = self.out.tell()
            self.out.close()
            self.made.append((self.name, self.count, size))
            self.zip = None


def _archive(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    archives = _Archives(folder, TaskContext.get().partitionId(), most)
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):
            archives.add(doc_id.as_py(), text.as_py())
    archives.close()
    columns = zip(*archives.made, strict=True) if archives.made else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "members", "bytes"])


def store(docs: DataFrame, most: int = ARCHIVE_BYTES) -> str:
    """Write the texts of documents into archives in the shared folder, and a manifest of the archives that count beside them; gives the folder back."""
    folder = scratch_path(docs.sparkSession, "media")
    files, base = _files(folder if "://" in folder else f"file://{folder}")
    files.create_dir(base, recursive=True)
    uri = folder if "://" in folder else f"file://{folder}"
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _archive(it, uri, most), "archive string, members long, bytes long")
    made.write.parquet(f"{uri}/{MANIFEST}")
    return uri


@dataclass
class ByteRange(InputPartition):
    """Members whose entry starts in a range of an archive's bytes."""

    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.step = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        """Ranges from the manifest's archives and their sizes alone: their directories are read by the tasks."""
        from pyarrow import dataset

        files, base = _files(self.folder)
        found = dataset.dataset(f"{base}/{MANIFEST}", filesystem=files, format="parquet").to_table(["archive", "bytes"])
        archives = sorted(zip(found["archive"].to_pylist(), found["bytes"].to_pylist(), strict=True))
        return [ByteRange(p, at, min(at + self.step, size)) for p, size in archives for at in range(0, size, self.step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _files(self.folder)
        with files.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            members = [(i.header_offset, i.compress_size, i.CRC, i.filename) for i in archive.infolist() if partition.start <= i.header_offset < partition.end]
        rows, size = [], 0
        for offset, length, crc, name in members:
            _, doc_id, n_bytes = name.removesuffix(".png").split("/")
            image = self.member(files, partition.path, offset, length, crc)
            rows.append((int(doc_id) if doc_id else None, int(n_bytes), image))
            size += len(image)
            if size >= BATCH_BYTES:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)

    _open: tuple | None = None

    def member(self, files, path: str, offset: int, length: int, crc: int) -> bytes:
        """One member by its offset. A failed or damaged read is tried again for this member alone, from a new handle."""
        for left in reversed(range(TRIES)):
            try:
                if self._open is None or self._open[0] != path:
                    self._open = path, files.open_input_file(path)
                f = self._open[1]
                f.seek(offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError(f"no member at {offset} of {path}")
                f.seek(sum(struct.unpack_from("<HH", head, 26)), 1)
                data = f.read(length)
                if len(data) != length or zlib.crc32(data) != crc:
                    raise OSError(f"damaged member at {offset} of {path}")
                return data
            except OSError:
                self._open = None
                if not left:
                    raise
        raise AssertionError


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    d, n, m = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.binary())], ["doc_id", "n_bytes", "media"])


class MediaArchives(DataSource):
    """format("media_archives").load(folder): doc_id, n_bytes (of the text), media (the stored image)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def features(samples: bytes) -> str:
    """Mean, standard deviation, entropy in bits, and mean step between neighbours, of 8-bit samples."""
    a = np.frombuffer(samples, np.uint8)
    count = np.bincount(a, minlength=256)
    share = count / len(a)
    level = np.arange(256)
    mean = float(share @ level)
    spread = float(np.sqrt(max(0.0, share @ (level - mean) ** 2)))
    used = share[share > 0]
    step = float(np.abs(np.diff(a.astype(np.int16))).mean())
    return f"mean={mean:.4f};sd={spread:.4f};entropy={-float(used @ np.log2(used)):.4f};step={step:.4f}"


_SEEN = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SEEN.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _SEEN.split(", ")]
    for b in batches:
        rows = []
        for doc_id, n, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            image = media.as_py()
            samples = from_png(image)
            rows.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)


def media_columns(docs: DataFrame) -> DataFrame:
    """documents -> a row for each row: what is stored for its text, read back from the archives.

    Columns: doc_id (long), n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null and
    empty texts: a payload of WIDTH spaces. Rows with equal texts have equal values but for doc_id. An empty table: no rows.
    """
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    stored = spark.read.format("media_archives").load(store(docs))
    return stored.mapInArrow(_describe, _SEEN)
