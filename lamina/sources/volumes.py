"""Reading and writing volumes: blocks in Parquet, image stacks, HDF5 where installed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.session import cut

#: Names under which a volume may be stored, best first.
RAW_KEYS = ("main", "raw", "image", "images", "data", "volumes/raw", "stack")
LABEL_KEYS = ("label", "labels", "gt", "volumes/labels/neuron_ids", "main")


def choose_dataset(names: list[str], preferred: tuple[str, ...] = (), strict: bool = False) -> str:
    """The first preferred name there is, else a usual one, else the first.

    ``strict`` admits preferred names only.
    """
    for key in (*preferred, *(() if strict else RAW_KEYS)):
        if key in names:
            return key
    if strict or not names:
        raise KeyError(f"none of {preferred or RAW_KEYS} in {names}")
    return names[0]


#: Places along each axis that a folder of stored blocks spans, if a block spans fewer.
FOLDER = (256, 256, 256)


def _in_folders(block: tuple[int, int, int]) -> dict[str, int]:
    """Blocks along each axis that share a folder, so that small blocks are no files of their own."""
    return {a: max(1, f // n) for a, f, n in zip("zyx", FOLDER, block, strict=True)}


#: Columns of stored blocks that are no values of a voxel: its folder, its block, and how many rows share its place.
_PLACED = (*(f"{k}{a}" for k in "fb" for a in "zyx"), "copies")


def write_blocks(vox: DataFrame, path: str, block: tuple[int, int, int] = (32, 256, 256), zone: int = 8) -> None:
    """Voxels as Parquet, sorted by blocks, in folders of neighbouring blocks, so that a crop reads its folders only.

    Ranges of blocks are written by a task each, so there are about as many files as tasks and folders.
    """
    placed = vox.withColumns({f"b{a}": F.expr(f"{a} div {n}") for a, n in zip("zyx", block, strict=True)})
    placed = placed.withColumns({f"f{a}": F.expr(f"b{a} div {n}") for a, n in _in_folders(block).items()})
    keys = ["sample", *_PLACED[:-1]]
    spread = placed.repartitionByRange(*keys).sortWithinPartitions(*keys, *"zyx")
    # The window finds its rows together and in order.
    counted = spread.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*keys, *"zyx")))
    counted.write.mode("overwrite").partitionBy("sample", "fz", "fy", "fx").parquet(path)


def read_crop(spark: SparkSession, path: str, bounds: dict[str, tuple[int, int]], block: tuple[int, int, int] = (32, 256, 256), sample: str | None = None) -> DataFrame:
    """A box of stored voxels; folders outside it are pruned, row groups and rows filtered in the scan."""
    df = spark.read.parquet(path)
    if sample is not None:
        df = df.where(F.col("sample") == sample)
    for (a, m), n in zip(_in_folders(block).items(), block, strict=True):
        if a in bounds:
            start, end = bounds[a]
            first, last = start // n, (end - 1) // n
            df = df.where((F.col(f"f{a}") >= first // m) & (F.col(f"f{a}") <= last // m) & (F.col(f"b{a}") >= first) & (F.col(f"b{a}") <= last) & (F.col(a) >= start) & (F.col(a) < end))
    return df.drop(*_PLACED)


def read_crops(spark: SparkSession, path: str, plan: DataFrame, size: tuple[int, int, int], block: tuple[int, int, int] = (32, 256, 256), labels: tuple[str, ...] = ("label",)) -> DataFrame:
    """(index, z, y, x, ...): the boxes that ``plan`` (index, sample, z0, y0, x0) asks for, counted from their corners.

    A crop is joined to the blocks it meets, so folders that no crop meets are pruned
    while the query runs.  Where a volume ends inside a crop, the crop is filled up at
    its end: raw values mirrored, labels (the columns named) by their last plane; of a
    crop with an axis of one voxel everything is filled up by the last plane.
    A voxel shows its own place as it is; only places filled up, whose values may come from
    two voxels, and rows that share a place are joined by place.
    """
    stored = spark.read.parquet(path)
    ends = stored.groupBy("sample").agg(*((F.max(a) + 1).alias(f"d{a}") for a in "zyx"))
    asked = plan.join(ends, "sample")
    asked = asked.withColumns({f"n{a}": F.least(F.lit(n), F.col(f"d{a}") - F.col(f"{a}0")) for a, n in zip("zyx", size, strict=True)})
    blocks = asked
    for a, b in zip("zyx", block, strict=True):
        blocks = blocks.withColumn(f"b{a}", F.explode(F.sequence(F.expr(f"{a}0 div {b}"), F.expr(f"({a}0 + n{a} - 1) div {b}"))))
    blocks = blocks.withColumns({f"f{a}": F.expr(f"cast(b{a} div {m} as int)") for a, m in _in_folders(block).items()})
    values = [c for c in stored.columns if c not in {"sample", *"zyx", *_PLACED}]
    # Written, so that Spark knows the size: a small list of blocks is broadcast and prunes the scan's folders
    # (which Spark does for a side with a condition), a large one is shuffled.
    blocks = cut(blocks.drop("dz", "dy", "dx")).where("bz >= 0 and by >= 0 and bx >= 0")
    met = stored.join(blocks, ["sample", *_PLACED[:-1]])
    for a in "zyx":
        met = met.where((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}0") + F.col(f"n{a}"))).withColumn(a, F.col(a) - F.col(f"{a}0"))
    kinds = {True: [c for c in values if c in labels], False: [c for c in values if c not in labels]}
    kinds = {label: cols for label, cols in kinds.items() if cols}
    place = ["index", "sample", "z", "y", "x"]
    own = met if len(kinds) == 1 else met.where("copies = 1")
    thin, filled = F.least("nz", "ny", "nx") < 2, None
    shorter = " or ".join(f"n{a} < {n}" for a, n in zip("zyx", size, strict=True))
    for label, cols in kinds.items():
        part = met.where(shorter if len(kinds) == 1 else f"copies > 1 or {shorter}").select(*place, "nz", "ny", "nx", "copies", *cols)
        for a, n in zip("zyx", size, strict=True):
            part = part.withColumn(a, F.explode(filled_places(F.col(a), F.col(f"n{a}"), n, F.lit(label) | thin)))
        beyond = "z >= nz or y >= ny or x >= nx"
        part = part.where(beyond if len(kinds) == 1 else f"copies > 1 or {beyond}").select(*place, *cols)
        filled = part if filled is None else filled.join(part, place)
    out = own.select(*place, *(c for cols in kinds.values() for c in cols))
    return out if filled is None else out.unionByName(filled)


def filled_places(at: Column, length: Column, size: int, edge: Column) -> Column:
    """The places of an axis of ``size`` that show place ``at`` of ``length``: itself, and in
    what is filled up its mirror images, or, with ``edge``, all places after the last."""
    last, period = F.lit(size - 1).cast("bigint"), (2 * (length - 1)).cast("bigint")

    def steps(first: Column) -> Column:
        return F.when(first <= last, F.sequence(first, last, F.greatest(period, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))

    here = at.cast("bigint")
    mirrored = F.array_distinct(F.concat(steps(here), steps(F.when(here == 0, here).otherwise(period - here))))
    behind = F.when(here == length - 1, F.sequence(here, last)).otherwise(F.array(here))
    return F.when(edge | (length == size), behind).otherwise(mirrored)


def read_grey_stack(spark: SparkSession, path: str, pattern: str = "*.pgm") -> DataFrame:
    """(z, y, x, raw) of a folder of binary PGM slices, in order of their names.

    Slices are decoded in Arrow batches, one after the other.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    # A stack has as many rows as slices; numbering them is small.
    names = files.select("path").withColumn("z", F.row_number().over(Window.orderBy("path")).cast("bigint") - 1)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, content in zip(batch.column("z").to_pylist(), batch.column("content"), strict=True):
                image = parse_pgm(content.as_py())
                y, x = np.indices(image.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(image.size, z)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(image.ravel().astype(float))], ["z", "y", "x", "raw"])

    return files.join(names, "path").select("z", "content").mapInArrow(decode, "z bigint, y bigint, x bigint, raw double")


def parse_pgm(data: bytes) -> np.ndarray:
    """An 8-bit grey image: magic, width, height, depth, then its samples."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    if fields[0] != b"P5" or int(fields[3]) > 255:
        raise ValueError("not a binary 8-bit PGM")
    w, h = int(fields[1]), int(fields[2])
    return np.frombuffer(data, np.uint8, w * h, at + 1).reshape(h, w)


def read_hdf5(spark: SparkSession, paths: list[str], keys: tuple[str, ...] = (), depth: int = 16) -> DataFrame:
    """(path, z, y, x, raw): slabs of ``depth`` slices, each a task's unit.  Needs h5py."""
    from .arrays import read_slabs

    return read_slabs(spark, paths, keys=",".join(keys), depth=str(depth))


def write_records(records: DataFrame, folder: str) -> None:
    """Sweep records as CSV with a header and as JSON lines."""
    records.write.mode("overwrite").option("header", "true").csv(f"{folder}/csv")
    records.write.mode("overwrite").json(f"{folder}/json")


def write_segmentation(vox: DataFrame, path: str, point: dict[str, str | float]) -> None:
    """Segments of one point of a sweep, in folders by sample and by the point's parameters.

    Coordinates are the volume's own, so a crop's bounds are those of its rows.
    Writing a point again replaces that point's folders and no others.
    """
    tagged = vox.select("sample", "z", "y", "x", F.col("segment").cast("bigint").alias("segment")).withColumns({k: F.lit(v) for k, v in point.items()})
    keys = ["sample", *point]
    tagged.repartition("sample", F.expr("z div 32")).sortWithinPartitions("sample", "z", "y", "x").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_summary(summary: DataFrame, folder: str) -> None:
    """A summary of few rows as one file of JSON lines, keys in order of name."""
    summary.select(sorted(summary.columns)).coalesce(1).write.mode("overwrite").json(folder)
