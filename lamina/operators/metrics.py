"""How well a segmentation agrees with the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalar import sigmoid

from .quantiles import exact_quantiles


def contingency(vox: DataFrame, pred: str = "pred", truth: str = "label", by: tuple[str, ...] = ("sample",), ignore: int | None = 0) -> DataFrame:
    """(by, pred, gt, n): voxels of each pair; truth that is ignored is left out."""
    seen = vox if ignore is None else vox.where(F.col(truth) != ignore)
    return seen.groupBy(*by, F.col(pred).alias("pred"), F.col(truth).alias("gt")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return F.sum(n * (n - 1) / 2)


def _entropy(n: Column, total: Column) -> Column:
    p = n.cast("double") / total
    return F.sum(-p * F.log2(p))


def segmentation_metrics(vox: DataFrame, pred: str = "pred", truth: str = "label", by: tuple[str, ...] = ("sample",), ignore: int | None = 0, backend: str = "internal") -> DataFrame:
    """Adapted Rand and variation of information, one row a group.

    The contingency table is summed up once from the voxels; both marginals come
    from it, so the voxels are shuffled once, after partial counts.  A group all
    of whose truth is ignored has error 1 and zeros.

    Backend ``skimage`` follows that package's conventions: precision is the share of the
    truth's pairs and recall that of the prediction's, and what has no pairs or no
    voxels is NaN.
    """
    if backend not in ("internal", "skimage"):
        raise ValueError(f"unknown metric backend {backend!r}")
    by = list(by)
    table = contingency(vox, pred, truth, tuple(by), ignore)
    whole = table.groupBy(*by).agg(F.sum("n").cast("double").alias("total"))
    parts = []
    for name, key in (("both", None), ("pred", "pred"), ("gt", "gt")):
        part = table if key is None else table.groupBy(*by, key).agg(F.sum("n").alias("n"))
        parts.append(part.join(whole, by).groupBy(*by).agg(_pairs(F.col("n")).alias(f"pairs_{name}"), _entropy(F.col("n"), F.col("total")).alias(f"h_{name}"), F.count(F.lit(1)).alias(f"n_{name}")))
    out = vox.select(*by).distinct()
    for part in (whole, *parts):
        out = out.join(part, by, "left")
    precision = F.coalesce(F.col("pairs_both") / F.nullif("pairs_pred", F.lit(0.0)), F.lit(0.0))
    recall = F.coalesce(F.col("pairs_both") / F.nullif("pairs_gt", F.lit(0.0)), F.lit(0.0))
    f = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    split, merge = (F.coalesce(F.greatest(F.col("h_both") - F.col(f"h_{m}"), F.lit(0.0)), F.lit(0.0)) for m in ("gt", "pred"))
    if backend == "skimage":
        nan = F.lit(float("nan"))
        share = lambda top, bottom: F.coalesce(top / F.nullif(bottom, F.lit(0.0)), nan)
        precision, recall = (share(F.col("pairs_both"), F.col(f"pairs_{side}")) for side in ("gt", "pred"))
        f = share(2 * F.col("pairs_both"), F.col("pairs_pred") + F.col("pairs_gt"))
        split, merge = (F.when(F.col("total").isNull(), nan).otherwise(c) for c in (split, merge))
    count = [F.coalesce(c, F.lit(0)).cast("bigint").alias(a) for c, a in (("n_pred", "n_pred"), ("n_gt", "n_gt"), ("total", "n_voxels"))]
    return out.select(*by, (1 - f).alias("adapted_rand_error"), f.alias("rand_fscore"), precision.alias("rand_precision"), recall.alias("rand_recall"), split.alias("voi_split"), merge.alias("voi_merge"), (split + merge).alias("voi_sum"), *count)


def overlap(vox: DataFrame, logit: str, target: str, threshold: float = 0.5, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """(by, dice, iou) of thresholded probabilities; both 1 where nothing is there."""
    p, t = (sigmoid(F.col(logit)) >= threshold).cast("double"), (F.col(target) >= 0.5).cast("double")
    s = vox.groupBy(*by).agg(F.sum(p * t).alias("both"), F.sum(p).alias("p"), F.sum(t).alias("t"))
    either = F.col("p") + F.col("t") - F.col("both")
    dice = F.when(F.col("p") + F.col("t") == 0, 1.0).otherwise(2 * F.col("both") / F.nullif(F.col("p") + F.col("t"), F.lit(0.0)))
    return s.select(*by, dice.alias("dice"), F.when(either == 0, 1.0).otherwise(F.col("both") / F.nullif(either, F.lit(0.0))).alias("iou"))


def channel_stats(vox: DataFrame, cols: dict[str, str]) -> DataFrame:
    """(sample, channel, mean, std, p01, p05, p50, p95, p99), exact percentiles."""
    long = vox.select("sample", F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), F.col(c).alias("v")) for n, c in cols.items()))).alias("s")).select("sample", "s.*")
    levels = (1, 5, 50, 95, 99)
    s = long.groupBy("sample", "channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    s = s.join(exact_quantiles(long, ("sample", "channel"), "v", tuple(q / 100 for q in levels), "p"), ["sample", "channel"])
    return s.select("sample", "channel", "mean", "std", *(F.col("p")[i].alias(f"p{q:02d}") for i, q in enumerate(levels)))


def label_stats(vox: DataFrame, label: str = "label", ignore: int = 0) -> DataFrame:
    return vox.groupBy("sample").agg(F.countDistinct(label).alias("n_labels"), F.avg((F.col(label) == 0).cast("double")).alias("zero_share"), F.avg((F.col(label) == ignore).cast("double")).alias("ignore_share"))


def weighted_mean(table: DataFrame, value: str, weight: str, by: tuple[str, ...]) -> DataFrame:
    """A running average's end: sum(v * n) / max(1, sum(n))."""
    return table.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight).cast("double"), F.lit(1.0))).alias("mean"))
