"""Media columns: payloads as lossless images in archives, read by byte range.

``MediaArchive`` is a Spark data source.  Its writer streams Arrow batches into
tar archives with one PNG member per document and an offset index beside each.
Its reader plans partitions as byte ranges over the archive folder, streams the
members through Arrow, and retries each member alone, by its offset.

Defined results: a null text is the empty text and gives one block of padding;
a null id stays null; repeated rows give repeated members; an empty table gives
an archive folder without members; texts of any length are one member each, held
whole by the task that writes or reads it; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from . import files
from .common import scratch_path, whole_text

#: Bytes of a payload block: rows of 32 samples, 18 to a block.
BLOCK, WIDTH = 576, 32
PAD = 255
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded with 255 to a positive multiple of ``BLOCK``.

    UTF-8 never holds the byte 255, so the length can be read back.
    """
    return text + bytes([PAD]) * (-len(text) % BLOCK or (0 if text else BLOCK))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """8-bit grey PNG of ``WIDTH`` columns; each row with filter 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> bytes:
    """The samples of a grey PNG as written here; raises if a checksum fails."""
    if png[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], (0, 0)
    while at < len(png):
        size = struct.unpack_from(">I", png, at)[0]
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("checksum of a PNG chunk differs")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height = shape
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a row filter that is not written here")
    return lines[:, 1:].tobytes()


class _ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        part, name = files.new_name()
        store, path = files.open_store(self.uri)
        at, members, out, index = 0, 0, None, None
        for batch in iterator:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}.data", compression=None)
                    index = store.open_output_stream(f"{path}/{name}.index", compression=None)
                png = encode_png(payload_of((text.as_py() or "").encode()))
                info = tarfile.TarInfo(f"{members:09d}/{'null' if key.as_py() is None else key.as_py()}.png")
                info.size = len(png)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + png + bytes(-len(png) % 512))
                index.write(struct.pack("<qq", at, len(head) + len(png)))
                at += len(head) + len(png) + -len(png) % 512
                members += 1
        if out is None:
            return files.Written(part, "", {})
        out.write(bytes(1024))
        out.close()
        index.close()
        return files.Written(part, name, {"bytes": at, "members": members})

    def commit(self, messages) -> None:
        files.commit(self.uri, messages, {"kind": "media"})

    def abort(self, messages) -> None:
        files.abort(self.uri, messages)


class ByteRange(InputPartition):
    """Members of one archive whose headers start in [start, end)."""

    def __init__(self, name: str, start: int, end: int):
        super().__init__((name, start, end))
        self.name, self.start, self.end = name, start, end


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.split = int(options.get("splitBytes", 16 << 20))
        self.tries = int(options.get("tries", 4))
        self.batch = int(options.get("batchBytes", 4 << 20))

    def partitions(self) -> list[ByteRange]:
        found = [ByteRange(f["name"], s, s + self.split) for f in files.manifest(self.uri)["files"] for s in range(0, f["bytes"], self.split)]
        return found or [ByteRange("", 0, 0)]  # Spark wants one partition at least

    def _member(self, store, path: str, at: int, size: int) -> tuple[str, bytes]:
        """Name and checked bytes of the member at this offset, tried anew alone."""
        for left in reversed(range(self.tries)):
            try:
                with store.open_input_file(path) as f:
                    return self._parse(f.read_at(size, at), size)
            except (OSError, ValueError, tarfile.TarError):
                if not left:
                    raise
                time.sleep(0.1 * (self.tries - left))
        raise AssertionError("tries must be positive")

    @staticmethod
    def _parse(raw: bytes, size: int) -> tuple[str, bytes]:
        if len(raw) != size:
            raise OSError("a short read")
        head = tarfile.TarInfo.frombuf(raw[:512], "utf-8", "strict")  # checks the header's checksum
        png = raw[512 : 512 + head.size]
        return head.name, png

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, path = files.open_store(self.uri)
        with store.open_input_file(f"{path}/{partition.name}.index") as f:
            mine = files.records_between(f, partition.start, partition.end)
        data = f"{path}/{partition.name}.data"
        with store.open_input_file(data) as stream:
            rows, held = [], 0
            for at, size in mine.tolist():
                try:
                    name, png = self._parse(stream.read_at(size, at), size)
                except (OSError, ValueError, tarfile.TarError):
                    name, png = self._member(store, data, at, size)
                key = name.rpartition("/")[2].removesuffix(".png")
                rows.append((None if key == "null" else int(key), png))
                held += size
                if held >= self.batch:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        keys, pngs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pngs, pa.binary())], ["doc_id", "media"])


class MediaArchive(DataSource):
    """``format("lamina_media")``: option path; splitBytes, batchBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "lamina_media"

    def schema(self) -> str:
        return "doc_id bigint, media binary"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return _ArchiveWriter(self.options["path"])


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store each whole text as a PNG member of the archives in ``path``."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    rows.write.format("lamina_media").mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """(doc_id, media) of every member of the archives in ``path``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("lamina_media").options(**options).load(path)


_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _feature(payload: bytes) -> str:
    """Blocks, mean sample, entropy in bits, and shares of 8 sample bands."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / len(payload)
    seen = share[share > 0]
    bands = share.reshape(8, 32).sum(axis=1)
    return f"{len(payload) // BLOCK}|{share @ np.arange(256):.4f}|{-(seen @ np.log2(seen)):.4f}|" + ",".join(f"{x:.4f}" for x in bands)


def media_features(media: DataFrame) -> DataFrame:
    """Decode each member and describe its payload, in Arrow batches."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, png in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                png = png.as_py()
                payload = decode_png(png)
                size = len(payload.rstrip(bytes([PAD])))
                rows.append((key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), _feature(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], _NAMES)

    return media.select("doc_id", "media").mapInArrow(describe, _FEATURES)


_NAMES = [c.split()[0] for c in _FEATURES.split(", ")]
_ARROW = [pa.string() if c.endswith("string") else pa.int64() for c in _FEATURES.split(", ")]


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return media_features(read_media(spark, path))
