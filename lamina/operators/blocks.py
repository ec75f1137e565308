"""Stencils by blocks: voxels meet their neighbourhood in one shuffle, all steps run inside.

A block is a dense array grown by a halo, so steps that follow one another (a change of
label, its growth, a mask) need no further shuffle, and gaps in a volume are gaps in the
array.  Blocks are found from a voxel's place, a voxel in a halo being sent to each
block that needs it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stencil import AXES

#: Values by column, and which places hold a voxel; gives new arrays of the same shape.
Kernel = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def map_blocks(vox: DataFrame, columns: Sequence[str], kernel: Kernel, adds: str, halo: tuple[int, int, int], block: tuple[int, int, int] = (16, 64, 64)) -> DataFrame:
    """Adds the columns named in the schema ``adds``, made by ``kernel`` from ``columns``.

    Places without voxel hold 0 (and False in the mask); ids stay 64-bit integers.
    """
    schema = StructType([*vox.schema.fields, *StructType.fromDDL(adds).fields])
    near = vox
    for a, n, h in zip(AXES, block, halo, strict=True):
        span = F.sequence(F.expr(f"greatest({a} - {h}, 0) div {n}"), F.expr(f"({a} + {h}) div {n}")) if h else F.array(F.expr(f"{a} div {n}"))
        near = near.withColumn(f"__b{a}", F.explode(span))
    shape = tuple(n + 2 * h for n, h in zip(block, halo, strict=True))

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = [b * n - h for b, n, h in zip(keys[1:], block, halo, strict=True)]
        at = tuple(rows[a].to_numpy() - f for a, f in zip(AXES, first, strict=True))
        core = np.logical_and.reduce([(i >= h) & (i < h + n) for i, n, h in zip(at, block, halo, strict=True)])
        if not core.any():
            return pd.DataFrame(columns=schema.names)
        present = np.zeros(shape, bool)
        present[at] = True
        values = {}
        for c in columns:
            values[c] = np.zeros(shape, rows[c].dtype)
            values[c][at] = rows[c].to_numpy()
        made = kernel(values, present)
        own = tuple(i[core] for i in at)
        return rows[core].assign(**{n: a[own] for n, a in made.items()})[schema.names]

    return near.groupBy("sample", *(f"__b{a}" for a in AXES)).applyInPandas(run, schema)


def shifted(values: np.ndarray, step: tuple[int, ...], fill=0) -> np.ndarray:
    """The value ``step`` places further on; ``fill`` beyond the array."""
    out = np.full_like(values, fill)
    to = tuple(slice(max(0, -s), n - max(0, s)) for s, n in zip(step, values.shape, strict=True))
    of = tuple(slice(max(0, s), n - max(0, -s)) for s, n in zip(step, values.shape, strict=True))
    out[to] = values[of]
    return out


def weighted_sum(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each place's neighbourhood by weights of odd sizes, with zeros outside."""
    reach = [n // 2 for n in weights.shape]
    out = np.zeros(values.shape)
    for place in np.argwhere(weights != 0):
        out += weights[tuple(place)] * shifted(values, tuple(int(p) - r for p, r in zip(place, reach, strict=True)))
    return out


def boundary_ignore(vox: DataFrame, xy: int = 1, z: int = 0, label: str = "label", ignore: int | None = 0, out: str = "masked", block: tuple[int, int, int] = (16, 64, 64)) -> DataFrame:
    """Labels near a change of label become ``ignore``; the voxels are shuffled once.

    Changes are seen from both sides, in the slice always and across slices only if
    ``z`` is above 0, then grown by the distances, axis by axis.
    """
    if ignore is None or (xy <= 0 and z <= 0):
        return vox.withColumn(out, F.col(label))
    xy, z = max(0, xy), max(0, z)

    def kernel(values: dict[str, np.ndarray], present: np.ndarray) -> dict[str, np.ndarray]:
        labels = values[label]
        edge = np.zeros(labels.shape, bool)
        for axis in (0, 1, 2) if z else (1, 2):
            for way in (1, -1):
                step = tuple(way * (a == axis) for a in range(3))
                edge |= present & shifted(present, step, False) & (labels != shifted(labels, step))
        for axis, reach in ((1, xy), (2, xy), (0, z)):
            edge = np.logical_or.reduce([shifted(edge, tuple(d * (a == axis) for a in range(3)), False) for d in range(-reach, reach + 1)]) & present
        return {out: np.where(edge, ignore, labels)}

    kind = vox.schema[label].dataType.simpleString()
    return map_blocks(vox, [label], kernel, f"{out} {kind}", (z + 1 if z else 0, xy + 1, xy + 1), block)


#: One step back on each axis.
NEAREST = ((-1, 0, 0), (0, -1, 0), (0, 0, -1))


def edge_targets(vox: DataFrame, offsets: Sequence[tuple[int, int, int]] | None = None, label: str = "label", replicate: bool = False, ignore: int | None = None, block: tuple[int, int, int] = (16, 64, 64)) -> DataFrame:
    """Adds t0, t1, ...: 1 where both ends of a channel's offset share a label above 0.

    ``offsets`` are one step back on each axis if None.  With ``ignore``, v0, v1, ... say
    whether both ends have another label than it.  ``replicate``: on the first plane of a
    channel that steps back by one, the voxel itself stands for the end outside.
    The voxels are shuffled once for all channels, as stencil.offset_affinities does not.
    """
    steps = [tuple(int(d) for d in o) for o in (NEAREST if offsets is None else offsets)]
    if not steps or any(len(o) != 3 or not any(o) for o in steps):
        raise ValueError("offsets are triplets (z, y, x) other than (0, 0, 0), one at least")

    def kernel(values: dict[str, np.ndarray], present: np.ndarray) -> dict[str, np.ndarray]:
        labels, made = values[label], {}
        inside = present & (labels > 0)
        counts = present & (labels != ignore) if ignore is not None else present
        for c, step in enumerate(steps):
            there = shifted(present, step, False)
            same = inside & there & (labels == shifted(labels, step))
            both = counts & shifted(counts, step, False)
            if replicate and step in NEAREST:
                first = values[AXES[NEAREST.index(step)]] == 0
                same, both = np.where(first, inside, same), np.where(first, counts, both)
            made[f"t{c}"] = same.astype(np.int32)
            if ignore is not None:
                made[f"v{c}"] = both.astype(np.int32)
        return made

    names = [f"{k}{c} int" for k in ("t", "v")[: 1 + (ignore is not None)] for c in range(len(steps))]
    halo = tuple(max(abs(o[a]) for o in steps) for a in range(3))
    return map_blocks(vox, [label, *AXES], kernel, ", ".join(names), halo, block)


def least_in_component(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``ids`` the least id it reaches over links between places ``a`` and ``b``."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root, a, b = np.arange(len(ids)), place[a], place[b]
    while len(a):
        high, low = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(root, high, low)
        while True:  # roots are no higher than their members, so jumps end
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return ids[order][root[place]]


def local_components(vox: DataFrame, columns: Sequence[str], links: Callable[[dict[str, np.ndarray]], list[np.ndarray]], steps: Sequence[tuple[int, int, int]], block: tuple[int, int, int] = (16, 64, 64)) -> DataFrame:
    """(sample, id, root, rim, over): components inside blocks by their least id, and what leads on.

    ``links`` says, for each of ``steps``, which voxels are linked to the one a step on.
    ``over`` are the ids beyond the block that a voxel is linked to; ``rim`` marks voxels
    of a block's outer layer, to which links from other blocks lead.
    """
    inner = (slice(1, -1),) * 3

    def kernel(values: dict[str, np.ndarray], present: np.ndarray) -> dict[str, np.ndarray]:
        ids, at = values["id"], np.arange(present.size).reshape(present.shape)
        core, deep = np.zeros(present.shape, bool), np.zeros(present.shape, bool)
        core[inner], deep[(slice(2, -2),) * 3] = True, True
        pairs, made = [], {}
        for i, (step, linked) in enumerate(zip(steps, links(values), strict=True)):
            both = linked & present & shifted(present, step, False) & core
            inside = shifted(core, step, False)
            here = both & inside
            pairs.append((at[here], shifted(at, step)[here]))
            made[f"__over{i}"] = np.where(both & ~inside, shifted(ids, step), ids)
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        flat = np.nonzero(core & present)
        rank = np.zeros(present.size, np.int64)
        rank[at[flat]] = np.arange(len(flat[0]))
        root = ids.copy()
        root[flat] = least_in_component(ids[flat], rank[a], rank[b])
        return made | {"root": root, "rim": core & ~deep}

    overs = [f"__over{i}" for i in range(len(steps))]
    adds = "root bigint, rim boolean, " + ", ".join(f"{o} bigint" for o in overs)
    made = map_blocks(vox.select("sample", "id", *AXES, *columns), ["id", *columns], kernel, adds, (1, 1, 1), block)
    return made.select("sample", "id", "root", "rim", F.array_except(F.array(*overs), F.array("id")).alias("over"))


def learned_calibration(vox: DataFrame, logits: Sequence[str], scale: Sequence[float], bias: Sequence[float], weights: Sequence[np.ndarray], residual: float, smooth: int = 3, outs: Sequence[str] | None = None, block: tuple[int, int, int] = (16, 64, 64)) -> DataFrame:
    """Adds calibrated logits: an affine part, and a learned sum over what smoothing takes away.

    Channel by channel: l = logit * max(scale, 0.001) + bias, p its probability, and
    p less its mean over a cube of ``smooth`` (zeros outside) is weighted by 3 x 3 x 3
    ``weights``, times the hyperbolic tangent of ``residual``.  A ``smooth`` of 1 or less
    leaves the affine part alone.
    """
    outs = list(outs or (f"cal_{c}" for c in logits))
    if not len(logits) == len(scale) == len(bias) == len(weights) == len(outs):
        raise ValueError("one scale, bias, weights and name for each channel")
    affine = {o: F.col(c) * max(float(s), 1e-3) + float(b) for o, c, s, b in zip(outs, logits, scale, bias, strict=True)}
    if smooth <= 1:
        return vox.withColumns(affine)
    arrays = [np.asarray(w, float) for w in weights]
    cube, gate = np.full((smooth,) * 3, 1.0 / smooth**3), float(np.tanh(residual))

    def kernel(values: dict[str, np.ndarray], present: np.ndarray) -> dict[str, np.ndarray]:
        made = {}
        for o, w in zip(outs, arrays, strict=True):
            p = np.where(present, 1 / (1 + np.exp(-values[f"__{o}"])), 0.0)
            made[o] = values[f"__{o}"] + gate * weighted_sum(np.where(present, p - weighted_sum(p, cube), 0.0), w)
        return made

    halo = smooth // 2 + max(w.shape[0] // 2 for w in arrays)
    held = vox.withColumns({f"__{o}": e for o, e in affine.items()})
    return map_blocks(held, [f"__{o}" for o in outs], kernel, ", ".join(f"{o} double" for o in outs), (halo,) * 3, block).drop(*(f"__{o}" for o in outs))


def resize(vox: DataFrame, size: tuple[int, int, int], col: str = "raw") -> DataFrame:
    """(sample, z, y, x, col): the volume on a grid of ``size``, by trilinear weights.

    Places are centres of cells: place o of n reads the axis of d places at
    (o + 0.5) * d / n - 0.5, not below 0, between the two voxels beside it.  A voxel is
    sent to the few places that read it, and the eight parts are added up; absent voxels
    count as 0.
    """
    dims = vox.groupBy("sample").agg(*((F.max(a) + 1).cast("double").alias(f"d{a}") for a in AXES))
    parts = vox.select("sample", *AXES, F.col(col).cast("double").alias("__v")).join(F.broadcast(dims), "sample")
    for a, n in zip(AXES, size, strict=True):
        d = F.col(f"d{a}")
        # Places that may read the voxel: those whose centre lies less than a voxel away, and one more on either side.
        low = F.greatest(F.floor((F.col(a) - 0.5) * n / d - 0.5) - 1, F.lit(0))
        high = F.least(F.ceil((F.col(a) + 1.5) * n / d - 0.5) + 1, F.lit(n - 1))
        parts = parts.withColumn(f"o{a}", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
        at = F.greatest((F.col(f"o{a}") + 0.5) * d / n - 0.5, F.lit(0.0))
        lower = F.floor(at)
        upper = F.least(lower + 1, d.cast("bigint") - 1)
        share = F.when(F.col(a) == lower, 1 - (at - lower)).otherwise(0.0) + F.when(F.col(a) == upper, at - lower).otherwise(0.0)
        parts = parts.withColumn(f"w{a}", share).where(F.col(f"w{a}") > 0)
    value = F.sum(F.col("__v") * F.col("wz") * F.col("wy") * F.col("wx"))
    return parts.groupBy("sample", *(F.col(f"o{a}").alias(a) for a in AXES)).agg(value.alias(col))
