"""Segments as graphs: components, region adjacency, agglomeration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import cut

from .blocks import local_components, shifted
from .components import connected_components
from .quantiles import exact_quantiles
from .ranking import beside, ranks
from .stencil import AXES, before


def relabel(vox: DataFrame, label: str, out: str, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Labels as 1, 2, ... by size of their id; 0 stays 0 where it is the least."""
    ids = ranks(vox.select(*by, label).distinct(), by, (label,), "__rank")
    least = beside(ids, by, __least=F.min(label))
    return vox.join(least.select(*by, label, (F.col("__rank") - (F.col("__least") == 0).cast("int")).cast("bigint").alias(out)), [*by, label])


def drop_small(vox: DataFrame, label: str, min_size: int, out: str) -> DataFrame:
    """Labels of fewer voxels become 0, if ``min_size`` is above 1; 0 stays 0."""
    if min_size <= 1:
        return vox.withColumn(out, F.col(label))
    sizes = vox.groupBy("sample", label).agg(F.count(F.lit(1)).alias("__n"))
    return vox.join(sizes, ["sample", label]).withColumn(out, F.when(F.col("__n") < min_size, 0).otherwise(F.col(label))).drop("__n")


def _joined(vox: DataFrame, local: DataFrame, out: str) -> DataFrame:
    """Components inside blocks become whole ones: only what lies at a block's rim is joined in rounds."""
    local = cut(local)
    across = local.select("sample", F.col("root").alias("src"), F.explode("over").alias("dst"))
    rims = local.where("rim and root <> id").select("sample", F.col("root").alias("src"), F.col("id").alias("dst"))
    parts = connected_components(across.unionAll(rims), keys=("sample",)).select("sample", F.col("id").alias("root"), "component")
    whole = local.select("sample", "id", "root").join(parts, ["sample", "root"], "left").select("sample", "id", F.coalesce("component", "root").alias(out))
    return vox.join(whole, ["sample", "id"])


def affinity_components(vox: DataFrame, threshold: float | tuple[float, float, float], cols: tuple[str, str, str] = ("az", "ay", "ax"), out: str = "component", block: tuple[int, int, int] = (16, 64, 64)) -> DataFrame:
    """Each voxel's component over edges of enough affinity, by its least ``id``.

    The edge of a channel runs to the voxel before on that axis.
    """
    levels = (threshold,) * 3 if isinstance(threshold, int | float) else threshold
    if len(levels) != 3:
        raise ValueError("one threshold, or one for each axis")
    steps = [(-1, 0, 0), (0, -1, 0), (0, 0, -1)]
    return _joined(vox, local_components(vox, tuple(dict.fromkeys(cols)), lambda v: [v[c] >= t for c, t in zip(cols, levels, strict=True)], steps, block), out)


def mask_components(vox: DataFrame, mask: Column, connectivity: int = 6, out: str = "component", block: tuple[int, int, int] = (16, 64, 64)) -> DataFrame:
    """Components of the voxels in ``mask``; -1 elsewhere.

    6 neighbours share a face; 26 also an edge or a corner (13 forward steps).
    """
    steps = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    if connectivity == 26:
        steps = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    inside = vox.withColumn("__inside", F.coalesce(mask, F.lit(False)))
    linked = lambda v: [v["__inside"] & shifted(v["__inside"], s, False) for s in steps]
    parts = _joined(inside, local_components(inside, ("__inside",), linked, steps, block), out)
    return parts.withColumn(out, F.when(F.col("__inside"), F.col(out)).otherwise(-1)).drop("__inside")


def boundary_pairs(vox: DataFrame, segment: str, cols: tuple[str, str, str] = ("az", "ay", "ax")) -> DataFrame:
    """(sample, axis, lo, hi, w): faces between two segments, with the affinity there."""
    sets = []
    for k, (a, c) in enumerate(zip(AXES, cols, strict=True)):
        p = vox.select("sample", F.lit(k).alias("axis"), F.col(segment).alias("s"), before(a, segment).alias("p"), F.col(c).alias("w"))
        sets.append(p.where("s > 0 and p > 0 and s <> p").select("sample", "axis", F.least("s", "p").alias("lo"), F.greatest("s", "p").alias("hi"), "w"))
    return reduce(DataFrame.unionAll, sets)


def exact_mean(w: Column) -> Column:
    """The mean of values of moderate size by a sum that is rounded once, so that it doesn't depend on the rows' order.

    Multiples of 2^-26 and what is left of each value are summed up apart, both without rounding.
    """
    high = F.floor(w * 2.0**26) / 2.0**26
    return (F.sum(high) + F.sum(w - high)) / F.count(w)


QUANTILES = {"median": 0.5, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75}


def pair_scores(pairs: DataFrame, mode: str, quantile: float = 0.25, by: tuple[str, ...] = ("sample", "lo", "hi")) -> DataFrame:
    """(by, score, n): a pair's faces as one number; means are summed exactly, quantiles found from counts."""
    level = quantile if mode == "quantile" else QUANTILES.get(mode)
    if level is None and mode not in ("mean", "min", "max"):
        raise ValueError(f"unknown score mode {mode!r}")
    n = F.count(F.lit(1)).alias("n")
    if level is None:
        return pairs.groupBy(*by).agg({"mean": exact_mean, "min": F.min, "max": F.max}[mode](F.col("w")).alias("score"), n)
    found = exact_quantiles(pairs, by, "w", (level,), "q")
    return pairs.groupBy(*by).agg(n).join(found, list(by)).select(*by, F.col("q")[0].alias("score"), "n")


def rag_features(pairs: DataFrame, min_boundary: int = 1) -> DataFrame:
    """One row a pair: by axis mean, least, greatest and share; log1p of the faces."""
    total = F.count(F.lit(1))
    cols = []
    for k, a in enumerate(AXES):
        w = F.when(F.col("axis") == k, F.col("w"))
        cols += [F.coalesce(f(w), F.lit(0.0)).alias(f"{n}_{a}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
        cols.append((F.count(w) / total).alias(f"share_{a}"))
    return pairs.groupBy("sample", "lo", "hi").agg(total.alias("n"), *cols, F.log1p(total).alias("log_n")).where(F.col("n") >= min_boundary)


def majority_labels(vox: DataFrame, segment: str, label: str, ignore: int | None = 0) -> DataFrame:
    """(sample, segment, best, confidence): most frequent label, least if tied.

    Voxels without segment or label, or with the label ``ignore``, don't vote.
    """
    voters = vox.where((F.col(segment) > 0) & (F.col(label) > 0))
    if ignore is not None:
        voters = voters.where(F.col(label) != ignore)
    n = voters.groupBy("sample", F.col(segment).alias("segment"), F.col(label).alias("best")).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("sample", "segment").agg(F.max_by("best", F.struct("n", (-F.col("best")).alias("b"))).alias("best"), F.max("n").alias("top"), F.sum("n").alias("all"))
    return top.select("sample", "segment", "best", (F.col("top") / F.col("all")).alias("confidence"))


def pair_targets(pairs: DataFrame, majority: DataFrame, least: float = 0.5) -> DataFrame:
    """(sample, lo, hi, target): both ends have one label above 0, surely enough."""
    p = pairs.select("sample", "lo", "hi").distinct()
    ends = [majority.select("sample", F.col("segment").alias(e), F.col("best").alias(f"best_{e}"), F.col("confidence").alias(f"sure_{e}")) for e in ("lo", "hi")]
    both = p.join(ends[0], ["sample", "lo"], "left").join(ends[1], ["sample", "hi"], "left")
    same = (F.col("best_lo") == F.col("best_hi")) & (F.col("best_lo") > 0) & (F.least("sure_lo", "sure_hi") >= least)
    return both.select("sample", "lo", "hi", F.coalesce(same, F.lit(False)).cast("int").alias("target"))


def merge_segments(vox: DataFrame, segment: str, joins: DataFrame, out: str) -> DataFrame:
    """Segments that ``joins`` (sample, lo, hi) links become one, then relabelled."""
    roots = connected_components(joins, "lo", "hi", keys=("sample",)).withColumnRenamed("id", segment)
    ids = vox.select("sample", segment).distinct().join(roots, ["sample", segment], "left").select("sample", segment, F.coalesce("component", segment).alias("__root"))
    return vox.join(relabel(ids, "__root", out).drop("__root"), ["sample", segment])


def select_pairs(pairs: DataFrame, threshold: dict[int, float], min_boundary: int = 1, mode: str = "mean", quantile: float = 0.25) -> DataFrame:
    """Pairs that score enough on some axis; each axis is judged on its own faces."""
    level = F.lit(None).cast("double")
    for axis, t in threshold.items():
        level = F.when(F.col("axis") == axis, t).otherwise(level)
    scored = pair_scores(pairs, mode, quantile, ("sample", "lo", "hi", "axis"))
    return scored.where((F.col("score") >= level) & (F.col("n") >= min_boundary)).select("sample", "lo", "hi").distinct()


def agglomerate_by_scores(vox: DataFrame, segment: str, scores: DataFrame, threshold: float, out: str, score: str = "score") -> DataFrame:
    """Merge the pairs (sample, lo, hi) whose given score, a model's for instance, is enough."""
    return merge_segments(vox, segment, scores.where(F.col(score) >= threshold).select("sample", "lo", "hi"), out)


def agglomerate(vox: DataFrame, segment: str, threshold: float, out: str, z_threshold: float | None = None, xy_threshold: float | None = None, min_boundary: int = 1, mode: str = "mean", quantile: float = 0.25) -> DataFrame:
    """Merge segments whose shared faces score enough."""
    z, xy = (t if t is not None else threshold for t in (z_threshold, xy_threshold))
    return merge_segments(vox, segment, select_pairs(boundary_pairs(vox, segment), {0: z, 1: xy, 2: xy}, min_boundary, mode, quantile), out)


def grid_seeds(vox: DataFrame, distance: int, first: int = 1) -> DataFrame:
    """(sample, z, y, x, seed): every ``distance`` voxels on y and x from 0 on, numbered by place."""
    step = max(1, distance)
    chosen = vox.where((F.col("y") % step == 0) & (F.col("x") % step == 0)).select("sample", *AXES)
    return ranks(chosen, ("sample",), AXES, "__rank").select("sample", *AXES, (F.col("__rank") + first - 1).cast("bigint").alias("seed"))


def rag_stats(vox: DataFrame, segment: str, min_boundary: int = 1) -> DataFrame:
    """(sample, segments, pairs, mean_faces, pairs_per_mvoxel) of the region graph."""
    size = vox.groupBy("sample").agg(F.count(F.lit(1)).alias("voxels"), F.countDistinct(F.when(F.col(segment) > 0, F.col(segment))).alias("segments"))
    pairs = boundary_pairs(vox, segment).groupBy("sample", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_boundary)
    sums = pairs.groupBy("sample").agg(F.count(F.lit(1)).alias("pairs"), F.avg("n").alias("mean_faces"))
    out = size.join(sums, "sample", "left")
    return out.select("sample", "segments", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("mean_faces", F.lit(0.0)).alias("mean_faces"), (F.coalesce("pairs", F.lit(0)) / F.greatest(F.col("voxels") / 1e6, F.lit(1e-6))).alias("pairs_per_mvoxel"))
