"""Crops, windows and chunks: plans over the axes, and voxels dealt to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalar import sigmoid

from .ranking import ranks
from .stencil import AXES


def sliding_starts(dim: Column, window: int, stride: int) -> Column:
    """0, stride, ... and always the last place where the window fits."""
    last = dim - window
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)).cast("bigint"), F.lit(max(1, stride)).cast("bigint"))
    return F.when(dim <= window, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.array_append(steps, last.cast("bigint"))))


def chunk_starts(dim: Column, chunk: int) -> Column:
    return F.when(dim <= chunk, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), (dim - 1).cast("bigint"), F.lit(chunk).cast("bigint")))


def extents(vox: DataFrame) -> DataFrame:
    """(sample, dz, dy, dx): one row a volume."""
    return vox.groupBy("sample").agg(*((F.max(a) + 1).alias(f"d{a}") for a in AXES))


def with_extents(vox: DataFrame) -> DataFrame:
    """Adds dz, dy, dx; the row of each volume is sent to every task, so that its voxels don't meet in one."""
    return vox.join(F.broadcast(extents(vox)), "sample")


def chunk_plan(dims: DataFrame, chunk: tuple[int, int, int], halo: tuple[int, int, int]) -> DataFrame:
    """One row a chunk: its core [a0, a1) and, grown by the halo, [ea0, ea1)."""
    for a, c in zip(AXES, chunk, strict=True):
        dims = dims.withColumn(f"{a}0", F.explode(chunk_starts(F.col(f"d{a}"), c)))
    cols = []
    for a, c, h in zip(AXES, chunk, halo, strict=True):
        start, dim = F.col(f"{a}0"), F.col(f"d{a}")
        end = F.least(start + F.when(dim <= c, dim).otherwise(F.lit(c)), dim)
        cols += [start.alias(f"{a}0"), end.alias(f"{a}1"), F.greatest(start - h, F.lit(0)).alias(f"e{a}0"), F.least(end + h, dim).alias(f"e{a}1")]
    return dims.select("sample", *cols)


def deal_to_chunks(vox: DataFrame, chunk: tuple[int, int, int], halo: tuple[int, int, int]) -> DataFrame:
    """Each voxel in each chunk whose grown bounds hold it, with ``core``.

    The chunks of a voxel follow from its place, so none is looked up by range:
    per axis the chunk of a - h up to that of a + h.
    """
    core, vox = F.lit(True), with_extents(vox)
    for a, c, h in zip(AXES, chunk, halo, strict=True):
        low = F.expr(f"greatest({a} - {h}, 0) div {c}")
        high = F.expr(f"({a} + {h}) div {c}")
        vox = vox.withColumn(f"c{a}", F.explode(F.sequence(low, high)))
        core = core & (F.expr(f"{a} div {c}") == F.col(f"c{a}"))
    # Chunks beyond the volume hold nothing of their own.
    exists = [F.col(f"c{a}") * c < F.col(f"d{a}") for a, c in zip(AXES, chunk, strict=True)]
    inside = exists[0] & exists[1] & exists[2]
    return vox.where(inside).drop(*(f"d{a}" for a in AXES)).withColumn("core", core)


def stitch_windows(vox: DataFrame, dims: dict[str, int], window: tuple[int | None, int, int], stride: tuple[int | None, int, int], logit: Column) -> DataFrame:
    """(sample, z, y, x, n, p): mean logit over the windows on a voxel, as probability.

    ``logit`` may use the window's start (wz, wy, wx).  The starts along an axis
    are few and fixed, so a voxel is given its windows by a filter on them.  An axis
    whose window is None lies whole in each window, from 0 on, however long it is.
    """
    for a, w, s in zip(AXES, window, stride, strict=True):
        if w is None:
            vox = vox.withColumn(f"w{a}", F.lit(0))
            continue
        starts = [0] if dims[a] <= w else sorted({*range(0, dims[a] - w + 1, max(1, s)), dims[a] - w})
        hold = F.filter(F.array(*(F.lit(x) for x in starts)), _covers(a, w))
        vox = vox.withColumn(f"w{a}", F.explode(hold))
    agg = vox.withColumn("__l", logit).groupBy("sample", *AXES).agg(F.count(F.lit(1)).alias("n"), F.avg("__l").alias("l"))
    return agg.select("sample", *AXES, "n", sigmoid(F.col("l"), None).alias("p"))


def _covers(axis: str, window: int):
    return lambda s: (s <= F.col(axis)) & (F.col(axis) < s + window)


def centre_bounds(dim: int, crop: int) -> tuple[int, int]:
    """[start, end) of a centred crop; the whole axis if the crop is 0 or larger."""
    if crop <= 0 or crop >= dim:
        return 0, dim
    start = (dim - crop) // 2
    return start, start + crop


def crop(vox: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """A box of voxels, counted from its corner; the filters reach the scan."""
    for a, (start, end) in bounds.items():
        vox = vox.where((F.col(a) >= start) & (F.col(a) < end))
    return vox.withColumns({a: F.col(a) - start for a, (start, _) in bounds.items()})


def centre_crop(vox: DataFrame, size: dict[str, int]) -> DataFrame:
    """A box in the centre of each volume, counted from its corner; 0 or a larger size is the whole axis."""
    dims = extents(vox)
    for a, n in size.items():
        dim = F.col(f"d{a}")
        whole = (dim <= n) | F.lit(n <= 0)
        dims = dims.withColumns({f"s{a}": F.when(whole, 0).otherwise(F.floor((dim - n) / 2)), f"n{a}": F.when(whole, dim).otherwise(n)})
    out = vox.join(F.broadcast(dims), "sample")
    for a in size:
        out = out.where((F.col(a) >= F.col(f"s{a}")) & (F.col(a) < F.col(f"s{a}") + F.col(f"n{a}"))).withColumn(a, F.col(a) - F.col(f"s{a}"))
    return out.drop(*(f"{k}{a}" for k in "dsn" for a in AXES))


def paired_crop(raw: DataFrame, labels: DataFrame, bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Raw values beside labels, voxel by voxel; the bounds reach both scans.

    Volumes must hold the same voxels; one that lacks its partner stops the query.
    """
    sides = [crop(side, bounds) if bounds else side for side in (raw, labels)]
    keys = ["sample", *AXES]
    both = sides[0].withColumn("__raw", F.lit(1)).join(sides[1].withColumn("__label", F.lit(1)), keys, "full")
    matched = F.col("__raw").isNotNull() & F.col("__label").isNotNull()
    return both.where(F.when(matched, F.lit(True)).otherwise(F.raise_error(F.lit("volumes of unlike shape")).cast("boolean"))).drop("__raw", "__label")


def crop_size(crop: int, window: int) -> int:
    """0, the whole axis, stays; any other crop is as large as the model's window at least."""
    return 0 if crop <= 0 else max(crop, window)


def pad(vox: DataFrame, axis: str, size: int, target: int, mode: str = "reflect") -> DataFrame:
    """Grow an axis at its end from ``size`` to ``target``: mirrored, or its last plane.

    A voxel is sent to each place that shows it, so nothing is joined.
    """
    if mode == "reflect" and target - size > size - 1:
        raise ValueError("a mirror reaches one less than the axis")
    at = F.col(axis)
    if mode == "reflect":
        mirrored = 2 * (size - 1) - at
        places = F.filter(F.array(at, mirrored), lambda p: (p == at) | ((p >= size) & (p < target)))
        return vox.withColumn(axis, F.explode(F.array_distinct(places)))
    if mode != "edge":
        raise ValueError(f"unknown mode {mode!r}")
    places = F.when(at == size - 1, F.sequence(at, F.lit(target - 1).cast("bigint"))).otherwise(F.array(at))
    return vox.withColumn(axis, F.explode(places))


def crop_plan(dims: DataFrame, multiplier: int, size: tuple[int, int, int], seed: int) -> DataFrame:
    """(index, path, sample, z0, y0, x0): each volume ``multiplier`` times an epoch.

    Entry ``index`` takes the volume whose place in order of names, from 0, is index modulo
    their number; its corner is drawn from a hash of seed and index, so that the crop fits
    where the volume is large enough, and is 0 on an axis that is shorter.  ``dims``: see
    ``extents``.
    """
    many = dims.count()
    placed = ranks(dims.withColumn("__all", F.lit(0)), ("__all",), ("sample",), "path").withColumn("path", F.col("path") - 1)
    rounds = F.sequence(F.lit(0).cast("bigint"), F.lit(multiplier - 1).cast("bigint")) if multiplier > 0 else F.array().cast("array<bigint>")
    plan = placed.withColumn("__round", F.explode(rounds)).withColumn("index", F.col("__round") * many + F.col("path"))
    for a, n in zip(AXES, size, strict=True):
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(a), F.col("index").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
        plan = plan.withColumn(f"{a}0", draw % (F.greatest(F.col(f"d{a}") - n, F.lit(0)) + 1))
    return plan.select("index", "path", "sample", *(f"{a}0" for a in AXES))


def factor_grid(volumes: DataFrame, patches: str = "patches") -> DataFrame:
    """(sample, d, h, w) with d <= h <= w and d h w = ``patches``, the most even, z the least.

    Divisors are found row by row, the best pair of them by one aggregate.
    """
    n = F.col(patches)
    first = F.sequence(F.lit(1).cast("bigint"), F.round(F.pow(n, F.lit(1 / 3))).cast("bigint") + 7)
    d = volumes.where(n > 0).select("sample", n.alias("n"), F.explode(first).alias("a")).where("n % a = 0").withColumn("rest", F.expr("n div a"))
    h = d.withColumn("b", F.explode(F.expr("sequence(1L, cast(floor(sqrt(rest)) as bigint))"))).where("rest % b = 0")
    s = F.array_sort(F.array("a", "b", F.expr("rest div b")))
    score = (s[2] - s[1]) + 2 * (s[1] - s[0])
    best = h.groupBy("sample").agg(F.min_by(s, F.struct(score, "a", "b")).alias("s"))
    return best.select("sample", *(F.col("s")[i].alias(c) for i, c in enumerate("dhw")))
