"""Token files: ids in the fewest bits the vocabulary allows.

Each file holds blocks of ``BLOCK`` ids, every id in the same number of bits;
its index holds the place of each block, the first id and length of each
document.  Any run of ids is unpacked with NumPy from the blocks that cover it.

Texts are encoded where they lie, into ids of two bytes (four, if the vocabulary
needs them), and at once dealt to their place in the order, by quantiles of the
doc_id found before; what is shuffled is these ids, once, and the writers only
join and pack them.

Defined results: a null text is empty and holds the end id alone; rows are in
ascending ``doc_id`` (nulls first; rows that share one in no particular order, so
an id that many rows share is dealt to many files); repeated rows are stored as often
as they occur; a text may be of any length, as a document may span blocks; an
empty table gives no file; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from . import files
from .common import scratch_path, whole_text
from .units import encoder, slices

#: Ids of a block; a multiple of 64, so that blocks end on whole words.
BLOCK = 1 << 14


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit stream; 64 ids fill ``bits`` words of 64 bits."""
    n = len(ids)
    if bits == 16:  # the same stream, as NumPy's own integers
        return np.pad(ids.astype("<u2"), (0, -n % 64)).tobytes()
    lanes = np.zeros((-(-n // 64), 64), np.uint64)
    lanes.reshape(-1)[:n] = ids
    words = np.zeros((len(lanes), bits), np.uint64)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        words[:, w] |= lanes[:, j] << np.uint64(s)
        if s + bits > 64:
            words[:, w + 1] |= lanes[:, j] >> np.uint64(64 - s)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes, as unsigned 32-bit integers."""
    if bits == 16:
        return np.frombuffer(data, "<u2")[:n].astype(np.uint32)
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        x = words[:, w] >> np.uint64(s)
        if s + bits > 64:
            x = x | (words[:, w + 1] << np.uint64(64 - s))
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


def id_type(vocabulary: int) -> str:
    """The NumPy type in which ids are stored before they are packed."""
    return "<u2" if bits_for(vocabulary) <= 16 else "<u4"


def encoded(docs: DataFrame, vocabulary: str, end_id: int, bounds: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, doc_id, turn, ids): each whole text's ids and the end id, in the type of ``id_type``.

    ``part`` is the row's range between ``bounds``.  Where bounds repeat an id,
    its rows are spread over the ranges between them in the order of ``turn``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        kind = id_type(codec.vocabulary_size())
        end, task, made = np.array([end_id], kind).tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            first = 0
            for part in slices(batch.column(1).to_pylist()):
                rows = codec.encode(part)
                if kind == "<u2":
                    rows = [np.frombuffer(ids, "<u4").astype(kind).tobytes() for ids in rows]
                ids = batch.column(0).slice(first, len(part))
                keys = ids.fill_null(LEAST).to_numpy()
                # Multiples of an odd number by 2**64: even over the range, and the same when a task is repeated.
                turn = (np.arange(made, made + len(part), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(task * 0xBF58476D1CE4E5B9 % (1 << 64))
                low, high = (np.searchsorted(bounds, keys, side) for side in ("left", "right"))
                place = low + np.minimum((turn / 2.0**64 * (high - low + 1)).astype(np.int64), high - low)
                turn = (turn ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), ids, pa.array(turn), pa.array([x + end for x in rows], pa.binary())], ["part", "doc_id", "turn", "ids"])
                first += len(part)
                made += len(part)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "part int, doc_id bigint, turn bigint, ids binary")


#: Stands for a null id, which comes first.
LEAST = -(1 << 63)


def range_bounds(docs: DataFrame, parts: int, id_col: str = "doc_id") -> np.ndarray:
    """Ids that cut the table into about even ranges; one may occur several times."""
    at = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST))
    found = docs.agg(F.percentile_approx(key, at, max(10_000, 4 * parts)).alias("b")).first()["b"] if parts > 1 else None
    return np.array(found or [], np.int64)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column one after the other, and their number in each row."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], "<i8" if wide else "<i4")[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data else np.zeros(0, kind)
    return flat, np.diff(offsets).astype(np.int64) // width


class _TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.vocabulary, self.size = options["path"], options["vocabulary"], int(options["size"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        part, name = files.new_name()
        store, path = files.open_store(self.uri)
        bits, kind = bits_for(self.size), id_type(self.size)
        keys, nulls, sizes, rest, out, total = [], [], [], np.zeros(0, kind), None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}.data", compression=None)
            ids = batch.column("doc_id")
            keys.append(ids.fill_null(0).to_numpy())
            nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
            flat, counts = _flat(batch.column("ids"), kind)
            sizes.append(counts)
            flat = np.concatenate([rest, flat])
            whole = len(flat) // BLOCK * BLOCK
            if whole:
                out.write(pack(flat[:whole], bits))
            total += whole
            rest = flat[whole:].copy()
        if out is None:
            return files.Written(part, "", {})
        out.write(pack(rest, bits))
        out.close()
        total += len(rest)
        keys, nulls, sizes = (np.concatenate(x) for x in (keys, nulls, sizes))
        blocks = np.arange(0, total, BLOCK) // 64 * bits * 8
        starts = np.concatenate([[0], np.cumsum(sizes)])
        with store.open_output_stream(f"{path}/{name}.index", compression=None) as f:
            for x in ([bits, BLOCK, len(keys), len(blocks), total], nulls, keys, starts, blocks):
                f.write(np.asarray(x).astype("<i8").tobytes())
        return files.Written(part, name, {"docs": len(keys), "ids": total})

    def commit(self, messages) -> None:
        files.commit(self.uri, messages, {"kind": "tokens", "vocabulary": self.vocabulary})

    def abort(self, messages) -> None:
        files.abort(self.uri, messages)


class DocRange(InputPartition):
    """Documents [first, last) of a file, ids counted from ``base``."""

    def __init__(self, name: str, first: int, last: int, base: int):
        super().__init__((name, first, last))
        self.name, self.first, self.last, self.base = name, first, last, base


class TokenFile:
    """Random access to one file: ids of documents [first, last) or of any run of ids.

    ``keys``, ``null`` and ``starts`` (one more, so the end of the last) are of these
    documents; only their part of the index is read, all of it if ``last`` is None.
    """

    def __init__(self, uri: str, name: str, first: int = 0, last: int | None = None):
        self.store, path = files.open_store(uri)
        self.index = self.store.open_input_file(f"{path}/{name}.index")
        self.bits, self.block, self.docs, self.blocks, self.total = files.integers(self.index, 0, 5).tolist()
        last = self.docs if last is None else last
        self.null, self.keys = (files.integers(self.index, 5 + k * self.docs + first, last - first) for k in range(2))
        self.starts = files.integers(self.index, 5 + 2 * self.docs + first, last - first + 1)
        self.file = self.store.open_input_file(f"{path}/{name}.data")

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        wanted = min(last + 2, self.blocks) - first
        places = files.integers(self.index, 6 + 3 * self.docs + first, wanted)
        at, stop = int(places[0]), int(places[-1]) if last + 1 < self.blocks else self.file.size()
        return unpack(self.file.read_at(stop - at, at), self.bits, end - first * self.block)[start - first * self.block :]

    def close(self) -> None:
        self.index.close()
        self.file.close()


class _TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.docs = options["path"], int(options.get("splitDocs", 20_000))

    def partitions(self) -> list[DocRange]:
        found = [DocRange(f["name"], d, min(d + self.docs, f["docs"]), f["ids_before"]) for f in files.manifest(self.uri)["files"] for d in range(0, f["docs"], self.docs)]
        return found or [DocRange("", 0, 0, 0)]  # Spark wants one partition at least

    def read(self, partition: DocRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        file = TokenFile(self.uri, partition.name, partition.first, partition.last)
        first, many = 0, partition.last - partition.first
        while first < many:  # a few blocks at a time, one document at least
            last = int(np.searchsorted(file.starts, file.starts[first] + 64 * BLOCK, "right")) - 1
            last = min(max(last, first + 1), many)
            low = int(file.starts[first])
            ids = file.ids(low, int(file.starts[last]))
            cut = (file.starts[first : last + 1] - low).tolist()
            keys = pa.array(file.keys[first:last], pa.int64(), mask=file.null[first:last].astype(bool))
            starts = pa.array(file.starts[first:last] + partition.base, pa.int64())
            yield pa.RecordBatch.from_arrays([keys, starts, pa.array([ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["doc_id", "start", "ids"])
            first = last
        file.close()


class TokenFiles(DataSource):
    """``format("lamina_tokens")``: options path, vocabulary, size; splitDocs."""

    @classmethod
    def name(cls) -> str:
        return "lamina_tokens"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return _TokenWriter(dict(self.options))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and store their ids, in ascending order of the id."""
    docs.sparkSession.dataSource.register(TokenFiles)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = encoded(docs, vocabulary, end_id, range_bounds(docs, parts, id_col), id_col, text_col)
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "turn")
    size = encoder(vocabulary).vocabulary_size()
    rows.select("doc_id", "ids").write.format("lamina_tokens").option("vocabulary", vocabulary).option("size", size).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, **options) -> DataFrame:
    """(doc_id, start, ids): ids as little-endian unsigned 32-bit integers."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("lamina_tokens").options(**options).load(path)


def token_digest(tokens: DataFrame) -> DataFrame:
    """Count and checksum of each document's ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x.as_buffer() for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array([x.size // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_digest(read_tokens(spark, path))
