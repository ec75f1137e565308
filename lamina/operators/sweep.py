"""Parameter sweeps: the grid of runs, and summaries of their records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranks

#: Parameters that each backend looks at; the others keep their first value.
USES = {
    "components": ("threshold",),
    "mean_components": ("threshold",),
    "agglomeration": ("threshold", "min_boundary", "score_mode"),
    "watershed": ("threshold", "seed_distance", "min_boundary", "score_mode"),
}


def sweep_grid(volumes: DataFrame, axes: dict[str, list], uses: dict[str, tuple[str, ...]] = USES) -> DataFrame:
    """Each row of ``volumes`` once a run: all backends by the parameters each of them looks at.

    The points are few and fixed, so rows are multiplied in place and nothing is joined.
    """
    grid = volumes.withColumn("backend", F.explode(F.array(*map(F.lit, uses))))
    for name, values in axes.items():
        own = F.col("backend").isin(*(b for b, names in uses.items() if name in names))
        every = F.array(*map(F.lit, values))
        grid = grid.withColumn(name, F.explode(F.when(own, every).otherwise(F.slice(every, 1, 1))))
    return grid


def first_samples(records: DataFrame, most: int, by: str = "sample") -> DataFrame:
    """Records of the first ``most`` samples in order of names; 0 means all."""
    if most <= 0:
        return records
    return records.join(records.select(by).distinct().orderBy(by).limit(most), by, "left_semi")


def group_means(records: DataFrame, keys: list[str], metrics: list[str], require_samples: int | None = None) -> DataFrame:
    """Mean of each metric and the number of records; incomplete groups may be left out."""
    out = records.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n"), F.countDistinct("sample").alias("__samples"))
    return (out.where(F.col("__samples") >= require_samples) if require_samples else out).drop("__samples")


def throughput(chunks: DataFrame, by: tuple[str, ...] = (), seconds: str = "seconds", voxels: str = "voxels", core: str = "core_voxels") -> DataFrame:
    """(by, chunks, seconds, voxels, core_voxels, voxels_per_sec) of a run's chunks.

    The rate is that of the core voxels, each of which belongs to one chunk.
    """
    sums = chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.sum(seconds).alias("seconds"), F.sum(voxels).alias("voxels"), F.sum(core).alias("core_voxels"))
    return sums.withColumn("voxels_per_sec", F.col("core_voxels") / F.greatest("seconds", F.lit(1e-6)))


def validation_summary(batches: DataFrame, metrics: list[str], size: str = "size", batch: str = "batch", most: int = 0) -> DataFrame:
    """One row: each metric's mean over the batches, weighted by their sizes.

    ``most`` batches count, the first by number; 0 means all.
    """
    if most > 0:
        batches = batches.where(F.col(batch) < most)
    total = F.greatest(F.sum(size).cast("double"), F.lit(1.0))
    return batches.agg(*((F.sum(F.col(m) * F.col(size)) / total).alias(m) for m in metrics), F.count(F.lit(1)).alias("batches"))


def best(groups: DataFrame, metric: str, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """The least of a metric; ties go to the first in order of the keys as text."""
    order = [F.col(metric), *(F.col(k).cast("string") for k in keys)]
    if not by:
        return groups.orderBy(*order).limit(1)
    return groups.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def split(items: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """Adds validation: min(n - 1, max(1, round(n * fraction))) items by hash.

    Ranks are counted by ranges, so the items may be many; only their number is known to
    the driver.
    """
    n = items.count()
    k = min(n - 1, max(1, round(n * fraction)))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    placed = ranks(items.withColumns({"__all": F.lit(0), "__drawn": drawn}), ("__all",), ("__drawn", key), "__rank")
    return placed.withColumn("validation", F.col("__rank") <= k).drop("__all", "__drawn", "__rank")
