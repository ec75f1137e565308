"""Column functions on voxels, logits and patches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sigmoid(logit: Column, limit: float | None = 50.0) -> Column:
    """1 / (1 + exp(-logit)); the logit is first held within ``limit``."""
    held = clamp(logit, -limit, limit) if limit is not None else logit
    return 1.0 / (1.0 + F.exp(-held))


def logit(p: Column, eps: float = 1e-6) -> Column:
    return F.ln(clamp(p, eps, 1 - eps) / clamp(1 - p, eps, 1.0))


def normalize_volume(vox: DataFrame, col: str = "raw", out: str = "norm", scope: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Values between their 1st and 99th percentile, as 0..1.

    Volumes brighter than 2 are divided by 255 first; where the percentiles are
    equal the values stay.  ``scope`` says what is one volume: a crop, a whole
    sample, or a chunk.  The statistics are counts with one row a volume at the end,
    joined back; the voxels themselves are not shuffled if that row is small.
    """
    from lamina.operators.quantiles import exact_quantiles

    stats = vox.groupBy(*scope).agg(F.max(col).alias("__top")).join(exact_quantiles(vox, scope, col, (0.01, 0.99), "__p"), list(scope))
    unit = F.when(F.col("__top") > 2, 255.0).otherwise(1.0)
    v, lo, hi = F.col(col) / unit, F.col("__p")[0] / unit, F.col("__p")[1] / unit
    joined = vox.join(stats, list(scope))
    return joined.withColumn(out, F.when(hi > lo, clamp((v - lo) / F.nullif(hi - lo, F.lit(0.0)))).otherwise(v)).drop("__top", "__p")


def calibrate(vox: DataFrame, variants: list[tuple[float, float, float, float]], cols: tuple[str, str, str] = ("lz", "ly", "lx")) -> DataFrame:
    """Each voxel under each (bias z, y, x, temperature): columns variant, pz, py, px.

    Variants are a short fixed list; those of one name (two decimals) count once,
    the first wins.
    """
    named: dict[str, tuple[float, float, float, float]] = {}
    for v in variants:
        named.setdefault("bias_z%+.2f_y%+.2f_x%+.2f_t%.2f" % tuple(v), v)
    table = F.array(*(F.struct(F.lit(n).alias("name"), *(F.lit(float(x)).alias(k) for k, x in zip("zyxt", v, strict=True))) for n, v in named.items()))
    each = vox.withColumn("__v", F.explode(table))
    for a, c in zip("zyx", cols, strict=True):
        each = each.withColumn(f"p{a}", sigmoid((F.col(c) + F.col(f"__v.{a}")) / F.greatest(F.col("__v.t"), F.lit(1e-6))))
    return each.withColumn("variant", F.col("__v.name")).drop("__v")


def gain_bias(c: Column, gain: Column | float, bias: Column | float) -> Column:
    return clamp(c * gain + bias)


def gamma(c: Column, g: Column | float) -> Column:
    return clamp(F.pow(clamp(c, 1e-4, 1.0), F.lit(g) if isinstance(g, int | float) else g))


def rotate_xy(vox: DataFrame, turns: int, size: int) -> DataFrame:
    """Square slices turned ``turns`` times by 90 degrees."""
    for _ in range(turns % 4):
        vox = vox.withColumns({"y": size - 1 - F.col("x"), "x": F.col("y")})
    return vox


def flip(vox: DataFrame, axis: str, size: int) -> DataFrame:
    return vox.withColumn(axis, size - 1 - F.col(axis))


def patchify(vox: DataFrame, patch: tuple[int, int, int], grid: tuple[int, int], col: str = "raw") -> DataFrame:
    """(sample, pid, vals): the voxels of each patch, in z, y, x order.

    ``grid`` is the number of patches on y and x, which must cover the volume
    (pad it before, or crop it); a patch has a fixed size, and where a volume ends
    inside one its places without voxel are null.
    """
    (pz, py, px), (gy, gx) = patch, grid
    pid = F.expr(f"((z div {pz}) * {gy} + y div {py}) * {gx} + x div {px}")
    place = (F.col("z") % pz * py + F.col("y") % py) * px + F.col("x") % px
    covered = (F.col("y") < gy * py) & (F.col("x") < gx * px)
    beyond = F.raise_error(F.lit(f"a voxel lies beyond the grid of {gy} x {gx} patches")).cast("bigint")
    rows = vox.groupBy("sample", F.when(covered, pid).otherwise(beyond).alias("pid")).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("at"), F.col(col).alias("v")))).alias("all"))
    return rows.select("sample", "pid", F.transform(F.sequence(F.lit(0), F.lit(pz * py * px - 1)), lambda i: F.element_at("all", i)).alias("vals"))


def unpatchify(patches: DataFrame, patch: tuple[int, int, int], grid: tuple[int, int], col: str = "raw") -> DataFrame:
    """The voxels of patches; places that held none give none."""
    (pz, py, px), (gy, gx) = patch, grid
    each = patches.select("sample", "pid", F.posexplode("vals").alias("at", col)).where(F.col(col).isNotNull())
    z = F.expr(f"cast(pid div {gy * gx} * {pz} + at div {py * px} as bigint)")
    y = F.expr(f"cast(pid div {gx} % {gy} * {py} + at div {px} % {py} as bigint)")
    x = F.expr(f"cast(pid % {gx} * {px} + at % {px} as bigint)")
    return each.select("sample", z.alias("z"), y.alias("y"), x.alias("x"), col)


def scale_01(rows: DataFrame, col: str, by: str = "sample", out: str = "scaled") -> DataFrame:
    """Adds ``out``: between a group's least and greatest value, the width 1e-6 at least."""
    ends = rows.groupBy(by).agg(F.min(col).alias("__low"), F.max(col).alias("__high"))
    scaled = (F.col(col) - F.col("__low")) / F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-6))
    return rows.join(ends, by).withColumn(out, scaled).drop("__low", "__high")


def channel_triplets(values: list[float]) -> list[tuple[float, float, float]]:
    """A flat list as (z, y, x) triplets."""
    if len(values) % 3:
        raise ValueError(f"{len(values)} values are no triplets")
    return [tuple(values[i : i + 3]) for i in range(0, len(values), 3)]


def choose_channels(rows: DataFrame, channels: tuple[int, ...], col: str = "c") -> DataFrame:
    """Three of a table's channels, renumbered 0, 1, 2 in the order given."""
    if len(channels) != 3:
        raise ValueError("exactly three channels")
    place = F.array_position(F.array(*map(F.lit, channels)), F.col(col)) - 1
    return rows.where(F.col(col).isin(*channels)).withColumn(col, place.cast("int"))


def safe_tag(name: Column) -> Column:
    """A name fit for files: other characters than letters, digits, . _ - become _."""
    return F.regexp_replace(name, "[^0-9A-Za-z._-]", "_")


def uniform(seed: str, *cols: str) -> Column:
    """A number in (0, 1) from a hash of the seed and the columns; equal in every engine that has MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in cols)).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << 32)


def gaussian(seed: str, *cols: str) -> Column:
    """A standard normal number from two hashed uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(seed + ":r", *cols))) * F.cos(2 * math.pi * uniform(seed + ":a", *cols))


def add_noise(vox: DataFrame, std: float, seed: str, col: str = "raw", keys: tuple[str, ...] = ("sample", "z", "y", "x")) -> DataFrame:
    """Gaussian noise, drawn from each voxel's place, held within 0..1."""
    return vox.withColumn(col, clamp(F.col(col) + std * gaussian(seed, *keys)))


def augment(vox: DataFrame, draws: dict[str, float], dims: dict[str, int], col: str = "raw", noise_std: float = 0.03, gamma_range: tuple[float, float] = (0.7, 1.5), seed: str = "0") -> DataFrame:
    """Turn, flip x, y, z, gain and bias, gamma, noise, in this order; labels move along.

    ``draws`` holds numbers in [0, 1): ``turn`` (none without it), ``flip_x``,
    ``flip_y``, ``flip_z``, ``gain`` with ``gain_by`` and ``bias_by``, ``gamma``
    with ``gamma_by`` (none without it), ``noise``; one at or above its step's
    probability leaves the step out.
    """
    if "turn" in draws:
        vox = rotate_xy(vox, int(draws["turn"] * 4), dims["y"])
    for axis, share in (("x", 0.5), ("y", 0.5), ("z", 0.2)):
        if draws[f"flip_{axis}"] < share:
            vox = flip(vox, axis, dims[axis])
    if draws["gain"] < 0.35:
        vox = vox.withColumn(col, gain_bias(F.col(col), 0.85 + 0.30 * draws["gain_by"], 0.10 * (draws["bias_by"] - 0.5)))
    if draws.get("gamma", 1.0) < 0.35:
        low, high = sorted(gamma_range)
        vox = vox.withColumn(col, gamma(F.col(col), low + (high - low) * draws["gamma_by"]))
    return add_noise(vox, noise_std, seed, col) if draws["noise"] < 0.25 else vox
