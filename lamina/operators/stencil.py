"""Neighbour operators: what a voxel's value is next to its neighbours'.

Unit steps are windows along one axis (a row may be absent, so coordinates are
checked); arbitrary offsets are equi-joins on shifted keys; box filters are
separable windows, one axis after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import beside

AXES = ("z", "y", "x")


def along(axis: str, sample: str = "sample"):
    """Voxels of one line parallel to ``axis``, in order."""
    return Window.partitionBy(sample, *(a for a in AXES if a != axis)).orderBy(axis)


def before(axis: str, col: str | Column) -> Column:
    """The value one step back on ``axis``; null at the edge or after a gap."""
    w = along(axis)
    return F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(col).over(w))


def after(axis: str, col: str | Column) -> Column:
    w = along(axis)
    return F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(col).over(w))


def affinities(vox: DataFrame, label: str = "label", replicate: bool = False) -> DataFrame:
    """Adds tz, ty, tx: 1 where a voxel and the one before share a label above 0.

    At the first plane 0, or with ``replicate`` whether the voxel has a label.
    """
    for a in AXES:
        prior = before(a, label)
        edge = (F.col(label) > 0).cast("int") if replicate else F.lit(0)
        vox = vox.withColumn(f"t{a}", F.when(prior.isNull(), edge).otherwise(((prior == F.col(label)) & (F.col(label) > 0)).cast("int")))
    return vox


def _first_plane() -> Column:
    """Of a step (dz, dy, dx) back by one on one axis, to (nz, ny, nx) before the volume."""
    single = (F.col("dz") + F.col("dy") + F.col("dx") == -1) & (F.abs("dz") + F.abs("dy") + F.abs("dx") == 1)
    return single & (F.least("nz", "ny", "nx") < 0)


def offset_affinities(vox: DataFrame, offsets: list[tuple[int, int, int]], label: str = "label", replicate: bool = False) -> DataFrame:
    """(sample, c, z, y, x, t): the same for any offsets, one channel for each.

    ``replicate`` holds on the first plane of a channel that steps back by one on one
    axis; an edge that leaves the volume elsewhere is 0.
    """
    if any(o == (0, 0, 0) for o in offsets):
        raise ValueError("an offset must not be (0, 0, 0)")
    steps = F.array(*(F.struct(F.lit(c).alias("c"), *(F.lit(d).alias(f"d{a}") for d, a in zip(o, AXES, strict=True))) for c, o in enumerate(offsets)))
    here = vox.select("sample", *AXES, F.col(label).alias("label"))
    asked = here.withColumn("o", F.explode(steps)).select("sample", *AXES, "label", "o.*", *((F.col(a) + F.col(f"o.d{a}")).alias(f"n{a}") for a in AXES))
    there = here.select("sample", *(F.col(a).alias(f"n{a}") for a in AXES), F.col("label").alias("other"))
    same = ((F.col("other") == F.col("label")) & (F.col("label") > 0)).cast("int")
    outside = F.when(_first_plane() & F.lit(replicate), (F.col("label") > 0).cast("int")).otherwise(0)
    return asked.join(there, ["sample", "nz", "ny", "nx"], "left").select("sample", "c", *AXES, F.when(F.col("other").isNull(), outside).otherwise(same).alias("t"))


def valid_edges(vox: DataFrame, label: str = "label", ignore: int = 0, replicate: bool = False) -> DataFrame:
    """Adds vz, vy, vx: both ends have a label that counts."""
    for a in AXES:
        prior, here = before(a, label), F.col(label) != ignore
        vox = vox.withColumn(f"v{a}", F.when(prior.isNull(), here & F.lit(replicate)).otherwise(here & (prior != ignore)).cast("int"))
    return vox


def offset_valid(vox: DataFrame, offsets: list[tuple[int, int, int]], label: str = "label", ignore: int = 0, replicate: bool = False) -> DataFrame:
    """(sample, c, z, y, x, v): both ends of an edge have a label that counts.

    ``replicate`` lets the first plane of a channel count that steps back by one
    on one axis, where its own voxel does.
    """
    steps = F.array(*(F.struct(F.lit(c).alias("c"), *(F.lit(d).alias(f"d{a}") for d, a in zip(o, AXES, strict=True))) for c, o in enumerate(offsets)))
    here = vox.select("sample", *AXES, (F.col(label) != ignore).alias("here"))
    asked = here.withColumn("o", F.explode(steps)).select("sample", *AXES, "here", "o.*", *((F.col(a) + F.col(f"o.d{a}")).alias(f"n{a}") for a in AXES))
    there = here.select("sample", *(F.col(a).alias(f"n{a}") for a in AXES), F.col("here").alias("there"))
    both = F.when(_first_plane() & F.lit(replicate), F.col("here")).otherwise(F.col("here") & F.coalesce("there", F.lit(False)))
    return asked.join(there, ["sample", "nz", "ny", "nx"], "left").select("sample", "c", *AXES, both.cast("int").alias("v"))


def box(vox: DataFrame, col: str, radii: dict[str, int], how: str, out: str) -> DataFrame:
    """A min, max or sum over a box, cut at the volume's edges, axis by axis."""
    vox = vox.withColumn(out, F.col(col))
    for a, r in radii.items():
        if r > 0:  # a range frame keeps its reach where voxels are absent
            vox = vox.withColumn(out, getattr(F, how)(out).over(along(a).rangeBetween(-r, r)))
    return vox


def widen_boundaries(vox: DataFrame, radius: int = 1, label: str = "label", out: str = "widened") -> DataFrame:
    """0 where another label lies within ``radius`` in the slice.

    Background is raised above all labels for the least value only, so labels
    are not eaten away beside it.
    """
    top = F.max(label).over(Window.partitionBy("sample", "z")) + 1
    vox = vox.withColumn("__lifted", F.when(F.col(label) == 0, top).otherwise(F.col(label)))
    vox = box(vox, label, {"y": radius, "x": radius}, "max", "__high")
    vox = box(vox, "__lifted", {"y": radius, "x": radius}, "min", "__low")
    return vox.withColumn(out, F.when(F.col("__high") != F.col("__low"), 0).otherwise(F.col(label))).drop("__lifted", "__high", "__low")


def edge_map(vox: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), clip: float = 5.0, col: str = "raw", out: str = "edge") -> DataFrame:
    """Weighted absolute steps along the axes, over their sample's mean, clipped."""
    total = F.lit(0.0)
    for a, w in zip(AXES, weights, strict=True):
        if w > 0:
            vox = vox.withColumn(f"__d{a}", F.abs(F.col(col) - before(a, col)))
            total = total + F.lit(float(w)) * F.coalesce(f"__d{a}", F.lit(0.0))
    vox = beside(vox.withColumn("__sum", total), ("sample",), __mean=F.avg("__sum"))
    mean = F.greatest("__mean", F.lit(1e-6))
    return vox.withColumn(out, F.least(F.col("__sum") / mean, F.lit(float(clip)))).drop("__sum", "__mean", *(f"__d{a}" for a in AXES))


def gradient_loss(vox: DataFrame, pred: str, target: str, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(sample, loss): mean absolute difference of steps, weighted over the axes."""
    for a in AXES:
        vox = vox.withColumn(f"__l{a}", F.abs((F.col(pred) - before(a, pred)) - (F.col(target) - before(a, target))))
    used = [(a, float(w)) for a, w in zip(AXES, weights, strict=True) if w > 0]
    total = sum((F.lit(w) * F.coalesce(F.avg(f"__l{a}"), F.lit(0.0)) for a, w in used), F.lit(0.0))
    return vox.groupBy("sample").agg((total / sum(w for _, w in used)).alias("loss"))


def seam_mask(chunk: dict[str, int], dims: dict[str, Column], width: int) -> Column:
    """Whether a voxel lies within ``width`` of a chunk's boundary."""
    hit = F.lit(False)
    for a, size in chunk.items():
        r = F.col(a) % size
        low, high = F.col(a) - r, F.col(a) - r + size
        near = ((low > 0) & (r < width)) | ((high < dims[a]) & (size - r <= width))
        hit = hit | (F.lit(width > 0) & (dims[a] > size) & near)
    return hit


def shape_descriptors(vox: DataFrame, label: str = "label") -> DataFrame:
    """Adds fg and oz, oy, ox: the way from a voxel to its object's centroid.

    Coordinates run from -1 to 1 over the sample's extent; offsets are 0 outside
    objects and clipped to 1.
    """
    vox = beside(vox.withColumn("fg", (F.col(label) > 0).cast("int")), ("sample",), **{f"__last_{a}": F.max(a) for a in AXES})
    for a in AXES:
        last = F.col(f"__last_{a}")
        vox = vox.withColumn(f"__{a}", F.when(last == 0, F.lit(-1.0)).otherwise(-1 + 2 * F.col(a) / F.greatest(last, F.lit(1))))
    # Background has no centroid; it gets keys of its own that meet nothing, so that it doesn't come to one task.
    centroids = vox.where("fg = 1").groupBy("sample", F.col(label).cast("bigint").alias("__key")).agg(*(F.avg(f"__{a}").alias(f"__mean_{a}") for a in AXES))
    key = F.when(F.col("fg") == 1, F.col(label).cast("bigint")).otherwise(-1 - F.pmod(F.xxhash64(*AXES), F.lit(4096)))
    vox = vox.withColumn("__key", key).join(centroids, ["sample", "__key"], "left").drop("__key")
    for a in AXES:
        off = F.col(f"__mean_{a}") - F.col(f"__{a}")
        vox = vox.withColumn(f"o{a}", F.when(F.col("fg") == 1, F.least(F.greatest(off, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0))
    return vox.drop(*(f"__{k}{a}" for a in AXES for k in ("", "last_", "mean_")))


def average_pool(vox: DataFrame, size: int, col: str, out: str) -> DataFrame:
    """Mean over a cube of odd ``size``; places outside count as zeros."""
    return box(vox, col, dict.fromkeys(AXES, size // 2), "sum", out).withColumn(out, F.col(out) / float(size**3))


def pseudo_affinity(vox: DataFrame, temperature: float = 1.0, col: str = "raw", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Adds pz, py, px: exp(-T w |step| / mean step of the sample), clipped to 0..1."""
    for a in AXES:
        vox = vox.withColumn(f"__g{a}", F.coalesce(F.abs(F.col(col) - before(a, col)), F.lit(0.0)))
    vox = beside(vox, ("sample",), **{f"__mean_{a}": F.avg(f"__g{a}") for a in AXES})
    for a, w in zip(AXES, weights, strict=True):
        mean = F.greatest(f"__mean_{a}", F.lit(1e-6))
        vox = vox.withColumn(f"p{a}", F.least(F.greatest(F.exp(-temperature * w * F.col(f"__g{a}") / mean), F.lit(0.0)), F.lit(1.0)))
    return vox.drop(*(f"__{k}{a}" for a in AXES for k in ("g", "mean_")))
