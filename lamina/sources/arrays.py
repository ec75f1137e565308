"""Slabs of stored arrays and pages of images as Spark data sources.

``lamina_slabs`` reads chunked array files (HDF5, where h5py is installed, or whatever
``opener`` names): bounds on z, y and x in a query become the slices that tasks read.
``lamina_images`` reads folders of slices and multipage files: a partition is a run of
pages, found by the offsets in the file's own directory, so a task reads its pages only.

Files are opened where they are read, in any store that Arrow reaches; the driver reads
names, shapes and page offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .volumes import choose_dataset, parse_pgm

AXES = ("z", "y", "x")


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


class _Bounded(DataSourceReader):
    """A reader that turns comparisons of coordinates into [start, end) along each axis."""

    def __init__(self):
        self.bounds: dict[str, tuple[int, int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            axis = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if axis in AXES and isinstance(getattr(f, "value", None), int):
                low, high = self.bounds.get(axis, (0, 1 << 62))
                at = {EqualTo: (f.value, f.value + 1), GreaterThan: (f.value + 1, high), GreaterThanOrEqual: (f.value, high), LessThan: (low, f.value), LessThanOrEqual: (low, f.value + 1)}.get(type(f))
                if at:
                    self.bounds[axis] = max(low, at[0]), min(high, at[1])
            yield f  # Spark looks at the rows again

    def within(self, axis: str, size: int) -> tuple[int, int]:
        low, high = self.bounds.get(axis, (0, size))
        return max(0, low), min(size, high)


def rows_of(part: np.ndarray, names: list[str], values: list[str], first: tuple[int, int, int]) -> pa.RecordBatch:
    """A box of values as rows, after constant columns."""
    at = np.indices(part.shape)
    columns = [pa.repeat(v, part.size) for v in values] + [pa.array((i + f).ravel()) for i, f in zip(at, first, strict=True)] + [pa.array(part.ravel().astype(float))]
    return pa.RecordBatch.from_arrays(columns, [*names, *AXES, "raw"])


# ---- slabs ---------------------------------------------------------------


def open_hdf5(path: str):
    """(datasets by name, close) of an HDF5 file; needs h5py."""
    import h5py

    handle = h5py.File(path.removeprefix("file://"))
    found: dict = {}
    handle.visititems(lambda n, o: found.setdefault(n, o) and None if isinstance(o, h5py.Dataset) else None)
    return found, handle.close


def _opener(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


class Slab(InputPartition):
    def __init__(self, path: str, key: str, box: tuple[tuple[int, int], ...]):
        super().__init__((path, key, box))
        self.path, self.key, self.box = path, key, box


class _SlabReader(_Bounded):
    def __init__(self, options: dict):
        super().__init__()
        self.paths = [p for p in options["path"].split(",") if p]
        self.keys = tuple(k for k in options.get("keys", "").split(",") if k)
        self.depth = int(options.get("depth", 16))
        self.listing = options.get("listing", "false").lower() == "true"
        self.open = _opener(options.get("opener", f"{__name__}:open_hdf5"))

    def partitions(self) -> list[InputPartition]:
        if self.listing:
            return [Slab(p, "", ()) for p in self.paths]
        plan = []
        for p in self.paths:
            found, close = self.open(p)
            try:
                key = choose_dataset(list(found), self.keys)
                shape = found[key].shape
            finally:
                close()
            if len(shape) != 3:
                raise ValueError(f"{key} of {p} has {len(shape)} axes, not 3")
            (z0, z1), y, x = (self.within(a, n) for a, n in zip(AXES, shape, strict=True))
            plan += [Slab(p, key, ((z, min(z + self.depth, z1)), y, x)) for z in range(z0, z1, self.depth)]
        return plan or [Slab("", "", ())]

    def read(self, partition: Slab) -> Iterator:
        if not partition.path:
            return
        found, close = self.open(partition.path)
        try:
            if self.listing:
                for key, d in found.items():
                    chunks = getattr(d, "chunks", None)
                    yield partition.path, key, [int(n) for n in d.shape], str(d.dtype), [int(n) for n in chunks] if chunks else None
                return
            (z0, z1), (y0, y1), (x0, x1) = partition.box
            for z in range(z0, z1):  # a slice at a time
                yield rows_of(np.asarray(found[partition.key][z : z + 1, y0:y1, x0:x1]), ["path"], [partition.path], (z, y0, x0))
        finally:
            close()


class SlabSource(DataSource):
    """Options path (several with commas), keys, depth, opener; ``listing`` gives datasets instead of voxels."""

    @classmethod
    def name(cls) -> str:
        return "lamina_slabs"

    def schema(self) -> str:
        if self.options.get("listing", "false").lower() == "true":
            return "path string, key string, shape array<bigint>, dtype string, chunks array<bigint>"
        return "path string, z bigint, y bigint, x bigint, raw double"

    def reader(self, schema) -> DataSourceReader:
        return _SlabReader(dict(self.options))


# ---- pages ---------------------------------------------------------------

_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}


def _entries(stream, order: str, at: int) -> tuple[dict[int, tuple], int]:
    """Tags of a TIFF directory, and where the next one is."""
    (n,) = struct.unpack(order + "H", stream.read_at(2, at))
    raw = stream.read_at(12 * n + 4, at + 2)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, 12 * i)
        if kind not in _TYPES:
            continue
        size = struct.calcsize(order + _TYPES[kind]) * count
        body = raw[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else stream.read_at(size, struct.unpack_from(order + "I", raw, 12 * i + 8)[0])
        tags[tag] = struct.unpack(f"{order}{count}{_TYPES[kind]}", body)
    return tags, struct.unpack_from(order + "I", raw, 12 * n)[0]


def _order(stream) -> tuple[str, int]:
    head = stream.read_at(8, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    return order, struct.unpack(order + "I", head[4:8])[0]


def tiff_pages(stream) -> list[int]:
    """Offsets of a TIFF file's directories, one a page; pixels are not read."""
    order, at = _order(stream)
    out: list[int] = []
    while at:
        if at in out:
            raise ValueError("directories of a TIFF file go in a circle")
        out.append(at)
        (n,) = struct.unpack(order + "H", stream.read_at(2, at))
        (at,) = struct.unpack(order + "I", stream.read_at(4, at + 2 + 12 * n))
    return out


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def grey(samples: np.ndarray) -> np.ndarray:
    """Red, green and blue as luminance in whole numbers: 299, 587 and 114 thousandths."""
    weights = np.array([19595, 38470, 7471])  # of 65,536
    return ((samples[..., :3].astype(np.int64) @ weights + 32768) >> 16).astype(np.uint8)


def read_tiff_page(stream, at: int) -> np.ndarray:
    """A page of 8-bit grey or RGB strips: plain, PackBits or deflate."""
    order, _ = _order(stream)
    tags, _ = _entries(stream, order, at)
    w, h, packing, kind = (tags.get(t, (d,))[0] for t, d in ((256, 0), (257, 0), (259, 1), (262, 1)))
    n = tags.get(277, (1,))[0]
    if set(tags.get(258, (1,))) != {8} or 273 not in tags or kind not in (0, 1, 2) or tags.get(317, (1,))[0] != 1:
        raise ValueError("only strips of 8-bit grey or RGB samples are read")
    inflate = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}.get(packing)
    if inflate is None:
        raise ValueError(f"TIFF compression {packing} is not read")
    raw = b"".join(inflate(stream.read_at(size, start)) for start, size in zip(tags[273], tags[279], strict=True))
    image = np.frombuffer(raw, np.uint8, w * h * n).reshape(h, w, n)
    return grey(image) if n >= 3 else 255 - image[..., 0] if kind == 0 else image[..., 0]


def read_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG, grey or RGB, with or without alpha, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += size + 12
    w, h, depth, colour, _, _, interlaced = head
    n = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or n is None or interlaced:
        raise ValueError("only plain 8-bit grey and RGB PNG files are read")
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * n + 1)
    out = np.zeros((h + 1, w + 1, n), np.int64)  # a row and a column of zeros before the image
    for y in range(h):
        rule, row, above = lines[y, 0], lines[y, 1:].reshape(w, n).astype(np.int64), out[y]
        if rule in (0, 2):
            out[y + 1, 1:] = (row + (above[1:] if rule else 0)) & 255
            continue
        for x in range(w):
            a, b, c = out[y + 1, x], above[x + 1], above[x]
            if rule == 1:
                guess = a
            elif rule == 3:
                guess = (a + b) // 2
            else:
                pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
            out[y + 1, x + 1] = (row[x] + guess) & 255
    image = out[1:, 1:].astype(np.uint8)
    return grey(image) if n >= 3 else image[..., 0]


def _whole(decode: Callable[[bytes], np.ndarray]) -> tuple[Callable, Callable]:
    return lambda stream: [0], lambda stream, at: decode(stream.read_at(stream.size(), 0))


def read_jpeg(data: bytes) -> np.ndarray:
    from io import BytesIO

    from PIL import Image

    return np.asarray(Image.open(BytesIO(data)).convert("L"))


#: By suffix: page offsets of an open file, and the page at one of them.
DECODERS: dict[str, tuple[Callable, Callable]] = {
    ".tif": (tiff_pages, read_tiff_page), ".tiff": (tiff_pages, read_tiff_page), ".pgm": _whole(parse_pgm), ".png": _whole(read_png), ".jpg": _whole(read_jpeg), ".jpeg": _whole(read_jpeg),
}


def suffix_of(path: str) -> str:
    name = path.rpartition("/")[2]
    return name[name.rfind(".") :].lower() if "." in name else ""


class Pages(InputPartition):
    """A run of pages of one file: offsets, and the slice of the first."""

    def __init__(self, path: str, offsets: list[int], first: int):
        super().__init__((path, tuple(offsets), first))
        self.path, self.offsets, self.first = path, offsets, first


class _ImageReader(_Bounded):
    def __init__(self, options: dict):
        super().__init__()
        self.path, self.run = options["path"].rstrip("/"), int(options.get("pages", 8))

    def partitions(self) -> list[InputPartition]:
        store, path = store_of(self.path)
        if store.get_file_info(path).type == fs.FileType.Directory:
            files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if suffix_of(f.path) in DECODERS)
        else:
            files = [path]
        if not files:
            raise ValueError(f"no image files under {self.path}")
        low, high = self.bounds.get("z", (0, 1 << 62))
        plan, z = [], 0
        for f in files:
            if suffix_of(f) not in DECODERS:
                raise ValueError(f"no decoder for {f}")
            many = DECODERS[suffix_of(f)][0] is tiff_pages
            if many:
                with store.open_input_file(f) as stream:
                    offsets = tiff_pages(stream)
            else:
                offsets = [0]
            a, b = max(low - z, 0), min(high - z, len(offsets))
            plan += [Pages(f, offsets[i : min(i + self.run, b)], z + i) for i in range(a, b, self.run)]
            z += len(offsets)
        return plan or [Pages("", [], 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = store_of(self.path)
        with store.open_input_file(partition.path) as stream:
            for i, at in enumerate(partition.offsets):
                image = DECODERS[suffix_of(partition.path)][1](stream, at)
                (y0, y1), (x0, x1) = (self.within(a, n) for a, n in zip("yx", image.shape, strict=True))
                if y0 < y1 and x0 < x1:
                    yield rows_of(image[None, y0:y1, x0:x1], [], [], (partition.first + i, y0, x0))


class ImageSource(DataSource):
    """Options path (a folder is a stack of its files' pages in order of name, a file one of its pages) and pages (a partition's run)."""

    @classmethod
    def name(cls) -> str:
        return "lamina_images"

    def schema(self) -> str:
        return "z bigint, y bigint, x bigint, raw double"

    def reader(self, schema) -> DataSourceReader:
        return _ImageReader(dict(self.options))


def _reader(spark: SparkSession, source: type[DataSource]):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name())


def read_slabs(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """(path, z, y, x, raw) of one dataset of each file."""
    return _reader(spark, SlabSource).options(**options).load(",".join(paths))


def list_datasets(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """(path, key, shape, dtype, chunks) of every dataset; a task opens each file."""
    return _reader(spark, SlabSource).options(listing="true", **options).load(",".join(paths))


def read_images(spark: SparkSession, path: str, **options) -> DataFrame:
    """(z, y, x, raw) of a stack of images or of a file's pages."""
    return _reader(spark, ImageSource).options(**options).load(path)
