"""Media columns: payloads in archive directories, read back by a data source that plans byte ranges.

A writer stores each payload losslessly as an 8-bit RGB PNG image, 64 pixels or 192 bytes a line, as a member of
a ZIP archive, named by a number, the text's bytes and the doc_id; tasks write archives of a bounded size into a folder that the cluster shares. The data source
plans byte ranges of the archives and gives each range to a task, which reads the archive's central
directory, takes the members that start in its range, reads each at its own offset, checks it, and retries
it alone if a read fails. Images go to Spark as Arrow batches of a bounded size.

A failed or repeated attempt of a writing task leaves an archive under its own name; the manifest, a table in the same folder
that a committed write makes, names the archives that count with their sizes, and the source reads no other. Ranges are
planned from the manifest's files; a task gets its own range and no list of archives.

Defined results: a null text is empty, and its payload is one line of blanks; a null doc_id stays null; repeated rows
are members each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loomtext.llm.runtime import fresh_dir

LINE = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 4
FIELDS = "archive string, member string, doc_id long, n_bytes long, media binary"


def png_of(payload: bytes, level: int = 6) -> bytes:
    """A payload of whole lines as a PNG image of 8-bit RGB samples, 64 pixels wide."""
    lines = len(payload) // LINE
    raw = np.zeros((lines, LINE + 1), np.uint8)  # each line after filter type 0
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(lines, LINE)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", LINE // 3, lines, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def payload_of(png: bytes) -> bytes:
    """The samples of an image that ``png_of`` made."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG image")
    at, data, width, lines = 8, [], 0, 0
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IHDR":
            width, lines = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(lines, width * 3 + 1)
    if raw[:, 0].any():
        raise ValueError("a filter is used that this reader has not")
    return raw[:, 1:].tobytes()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


class _Archives:
    """Appends members to archives of a bounded size in one folder."""

    def __init__(self, folder: str):
        self.fs, self.folder = _filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.zip: zipfile.ZipFile | None = None
        self.out: _Sequential | None = None
        self.name = ""
        self.n = self.members = 0
        self.written: list[tuple[str, int, int]] = []  # archive, members, bytes

    def add(self, doc_id: int | None, n_bytes: int, data: bytes) -> None:
        if self.zip is not None and self.out.tell() > ARCHIVE_BYTES:
            self.close()
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.zip"
            self.out = _Sequential(self.fs.open_output_stream(f"{self.folder}/{self.name}"))
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        # zipfile marks members of an unseekable stream with sizes after the data; the central directory has them
        self.zip.writestr(zipfile.ZipInfo(f"{self.n}_{n_bytes}_{'' if doc_id is None else doc_id}.png"), data)
        self.n, self.members = self.n + 1, self.members + 1

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.out.out.close()
            self.written.append((self.name, self.members, self.out.tell()))
            self.zip, self.members = None, 0


class _Sequential(io.RawIOBase):
    """A write-only stream whose place is counted, as object stores give it."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


def _writer(folder: str) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                size = max(1, -(-len(raw) // LINE)) * LINE
                archives.add(doc_id, len(raw), png_of(raw.ljust(size)))
        archives.close()
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in archives.written], kind) for k, kind in enumerate(kinds)], names=["archive", "members", "bytes"])

    return rows


def write_archives(docs: DataFrame, folder: str) -> str:
    """Stores each text as a media member of an archive under ``folder``; returns the manifest's path, a
    table with a row for each archive that counts."""
    docs.selectExpr("CAST(doc_id AS long)", "text").mapInArrow(_writer(f"{folder}/archives"), "archive string, members long, bytes long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaSource(DataSource):
    """``spark.read.format("media_archives").option("folder", ...)``: the members of ZIP archives. Options:
    ``manifest`` (the table of the archives that count; all if unset), ``range_bytes``, ``attempts``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["folder"]
        self.manifest = options.get("manifest")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of the archives. Their sizes come from the manifest, else from the folder; no archive is opened here."""
        ranges = [ByteRange(name, at, min(at + self.range_bytes, size)) for name, size in self._sizes() for at in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def _sizes(self) -> Iterator[tuple[str, int]]:
        if not self.manifest:
            fs, folder = _filesystem(self.folder)
            yield from ((f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".zip"))
            return
        fs, folder = _filesystem(self.manifest)
        for part in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet")):
            with fs.open_input_file(part) as file:
                own = pq.read_table(file, columns=["archive", "bytes"])
            yield from zip(own.column("archive").to_pylist(), own.column("bytes").to_pylist(), strict=True)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, folder = _filesystem(self.folder)
        path = f"{folder}/{partition.archive}"
        members = self._again(lambda: self._members(fs, path))
        columns: list[list] = [[] for _ in range(5)]
        size = 0
        for info in members:
            if not partition.start <= info.header_offset < partition.end:
                continue
            data = self._again(lambda info=info: self._member(fs, path, info))
            _, n_bytes, doc = info.filename.removesuffix(".png").split("_")
            for column, value in zip(columns, (partition.archive, info.filename, int(doc) if doc else None, int(n_bytes), data), strict=True):
                column.append(value)
            size += len(data)
            if size >= BATCH_BYTES:
                yield _batch(columns)
                columns, size = [[] for _ in range(5)], 0
        if columns[0]:
            yield _batch(columns)

    def _again(self, what: Callable):
        """``what()``, tried again after a pause if a read fails or gives damaged bytes."""
        for attempt in range(self.attempts):
            try:
                return what()
            except (OSError, zipfile.BadZipFile, ValueError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.1 * 2**attempt)

    @staticmethod
    def _members(fs: pafs.FileSystem, path: str) -> list[zipfile.ZipInfo]:
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            return archive.infolist()

    @staticmethod
    def _member(fs: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset: the local header tells where its bytes start."""
        with fs.open_input_file(path) as file:
            head = file.read_at(30, info.header_offset)
            if head[:4] != b"PK\x03\x04":
                raise zipfile.BadZipFile(f"no member at {info.header_offset}")
            start = info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26))
            data = file.read_at(info.file_size, start)
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise zipfile.BadZipFile(f"the member at {info.header_offset} is damaged")
        return data


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "member", "doc_id", "n_bytes", "media"])


def read_archives(spark: SparkSession, folder: str, manifest: str | None = None) -> DataFrame:
    """archive, member, doc_id, n_bytes, media for each member of the archives that the manifest names."""
    spark.dataSource.register(MediaSource)
    reader = spark.read.format("media_archives").option("folder", f"{folder}/archives")
    if manifest:
        reader = reader.option("manifest", manifest)
    return reader.load()


def feature_of(samples: np.ndarray) -> str:
    """An image's mean, contrast and an 8 by 8 average hash over equal parts of its samples."""
    cells = np.add.reduceat(samples.astype(np.int64), np.linspace(0, len(samples), 64, endpoint=False).astype(int)) / np.diff(np.append(np.linspace(0, len(samples), 64, endpoint=False).astype(int), len(samples)))
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"{samples.mean():.4f}:{samples.std():.4f}:{bits}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        for doc_id, n_bytes, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = stored.as_py()
            payload = payload_of(media)
            values = (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(np.frombuffer(payload, np.uint8)))
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=FEATURES)


FEATURES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_features(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all texts as media, reads the stored bytes back through the data source and digests them."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "media")
    manifest = write_archives(docs, folder)
    members = read_archives(spark, folder, manifest)
    return members.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
