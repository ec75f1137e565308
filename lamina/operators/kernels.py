"""Watershed and prediction: the watershed takes a slice as its unit, prediction a block."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lamina.session import cut

from .agglomeration import hierarchical_agglomeration  # noqa: F401  callers know it from here
from .graph import relabel


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each place in the mask to the nearest outside it.

    Down the columns by running counts, then row by row the least sum of squares.
    """
    h, w = mask.shape
    far = float(h + w)
    down = np.empty((h, w))
    for step, rows in ((1, range(h)), (-1, range(h - 1, -1, -1))):
        run = np.full(w, far)
        for y in rows:
            run = np.where(mask[y], run + 1, 0.0)
            down[y] = run if step == 1 else np.minimum(down[y], run)
    apart = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    squares = np.array([(row[None, :] ** 2 + apart).min(axis=1) for row in down])
    return np.sqrt(np.minimum(squares, far**2))


def local_peaks(values: np.ndarray, radius: int) -> np.ndarray:
    """Places that no other within a square of ``radius`` exceeds."""
    h, w = values.shape
    padded = np.pad(values, radius, constant_values=-np.inf)
    top = np.max([padded[i : i + h, j : j + w] for i in range(2 * radius + 1) for j in range(2 * radius + 1)], axis=0)
    return values >= top


def regional_minima(values: np.ndarray) -> np.ndarray:
    """Level places, of touching equal values, that no lower place touches."""

    def near(a: np.ndarray, fill: float) -> list[np.ndarray]:
        p = np.pad(a, 1, constant_values=fill)
        return [p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]

    level = [n == values for n in near(values, np.nan)]
    low = np.all([n >= values for n in near(values, np.inf)], axis=0)
    while True:
        # A place beside an equal one that is not low is not low either.
        spoilt = low & np.any([e & (k == 0) for e, k in zip(level, near(low.astype(float), 1.0), strict=True)], axis=0)
        if not spoilt.any():
            return low
        low &= ~spoilt


def touching(mask: np.ndarray) -> np.ndarray:
    """Runs of touching places, numbered from 1 in scan order."""
    out, n = np.zeros(mask.shape, np.int64), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d]:
                    out[c, d] = n
                    todo.append((c, d))
    return out


def seeds(boundary: np.ndarray, method: str, distance: int, threshold: float, library: str = "mahotas") -> np.ndarray:
    """Seeds of a slice as one of two libraries sets them.

    ``mahotas``: regional minima of the boundary, or regional maxima of the inner
    distance, by method; ``scipy``: for every method but the grid, places inside that
    none within two steps exceeds.  A slice without such places gets the grid, which
    begins at its corner.
    """
    found = np.zeros(boundary.shape, np.int64)
    if library not in ("mahotas", "scipy"):
        raise ValueError(f"unknown watershed library {library!r}")
    if library == "scipy" and method != "grid":
        far = distance_to(boundary < threshold)
        found = touching(local_peaks(far, 2) & (far > 0))
    elif method == "minima":
        found = touching(regional_minima(boundary))
    elif method == "maxima_distance":
        found = touching(regional_minima(-distance_to(boundary < threshold)))
    elif method != "grid":
        raise ValueError(f"unknown seed method {method!r}")
    if not found.any():
        marks = np.zeros(boundary.shape, bool)
        marks[:: max(1, distance), :: max(1, distance)] = True
        found[marks] = np.arange(1, marks.sum() + 1)
    return found


def flood(boundary: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Seeded watershed: lowest place first, then the one reached first.

    Places are numbers in a flat list with a border, so that no neighbour has to be
    held against the slice's edges.
    """
    wide = boundary.shape[1] + 2
    level = np.pad(boundary, 1).ravel().tolist()
    framed = np.pad(marks, 1, constant_values=-1)
    out = framed.ravel().tolist()
    heap = [(level[i], n, i) for n, i in enumerate(np.flatnonzero(framed > 0).tolist())]
    order, push, pop = len(heap), heapq.heappush, heapq.heappop
    heapq.heapify(heap)
    while heap:
        i = pop(heap)[2]
        mark = out[i]
        for j in (i - wide, i + wide, i - 1, i + 1):
            if not out[j]:
                out[j] = mark
                push(heap, (level[j], order, j))
                order += 1
    return np.array(out).reshape(framed.shape)[1:-1, 1:-1]


def watershed_fragments(vox: DataFrame, method: str = "maxima_distance", distance: int = 12, threshold: float = 0.5, out: str = "fragment", library: str = "mahotas") -> DataFrame:
    """Adds fragment: a watershed of 1 - (y + x affinity) / 2 in each slice.

    Seeds are set as by ``library``; for ``scipy`` the boundary is flooded by 256
    levels.  Ids are dense over the sample, in order of slices.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["y"].max()) + 1, int(rows["x"].max()) + 1
        boundary = np.ones((h, w))
        y, x = rows["y"].to_numpy(int), rows["x"].to_numpy(int)
        boundary[y, x] = 1 - 0.5 * (rows["ay"].to_numpy() + rows["ax"].to_numpy())
        marks = seeds(boundary, method, distance, threshold, library)
        if library == "scipy":
            boundary = np.floor(np.clip(boundary * 255.0, 0, 255))
        return rows[["sample", "z", "y", "x"]].assign(local=flood(boundary, marks)[y, x])

    # Written, as it is read for the ids and for the voxels.
    local = cut(vox.select("sample", "z", "y", "x", "ay", "ax").groupBy("sample", "z").applyInPandas(one, "sample string, z bigint, y bigint, x bigint, local bigint"))
    wide = local.withColumn("__key", F.col("z") * (1 << 32) + F.col("local"))
    return vox.join(relabel(wide, "__key", out).select("sample", "z", "y", "x", out), ["sample", "z", "y", "x"])


def predict(blocks: DataFrame, model: Callable[[np.ndarray], np.ndarray], channels: int = 3) -> DataFrame:
    """Run a model on blocks (key, shape, data): adds logits, one array a channel.

    ``model`` takes [depth, height, width] and returns [channels, ...] of it; it
    is sent to the tasks and meets one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.asarray(model(np.array(d).reshape(s)), float).reshape(channels, -1).tolist() for s, d in zip(batch.column("shape").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.list_(pa.float64())))], [*batch.schema.names, "logits"])

    return blocks.mapInArrow(run, StructType([*blocks.schema.fields, StructField("logits", ArrayType(ArrayType(DoubleType())))]))
