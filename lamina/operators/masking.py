"""Which patches to hide: random, edge-led and mixed plans, and their terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import cut

from .ranking import beside, ranks


def noise(seed: str, *cols: str) -> Column:
    """A hash that orders rows at random; equal in every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in cols)).cast("binary"))


def random_mask(patches: DataFrame, ratio: float, seed: str = "0", by: str = "sample") -> DataFrame:
    """Adds masked: max(1, round half even(ratio * n)) patches of a sample."""
    out = ranks(beside(patches, (by,), __n=F.count(F.lit(1))), (by,), (noise(seed, by, "pid"), "pid"), "__r")
    return out.withColumn("masked", F.col("__r") <= F.greatest(F.lit(1), F.bround(F.lit(ratio) * F.col("__n")))).drop("__n", "__r")


def edge_mask(patches: DataFrame, ratio: float, fraction: float | str, edge: str = "edge", power: float = 1.0, seed: str = "0", by: str = "sample") -> DataFrame:
    """Adds masked: a fraction of the masked patches by edge score, the rest at random.

    ``fraction`` may name a column, with one value for a sample.
    """
    return _led(patches, lambda n: F.greatest(F.bround(F.lit(ratio) * n), F.lit(1)), fraction, edge, power, seed, by)


def mixed_mask(patches: DataFrame, ratio: float | str, fraction: float | str, edge: str = "edge", seed: str = "0", by: str = "sample") -> DataFrame:
    """The same with a ratio that may be a column too; the count is held within 1 and n - 1."""
    share = F.col(ratio) if isinstance(ratio, str) else F.lit(ratio)
    return _led(patches, lambda n: F.greatest(F.least(F.bround(share * n), n - 1), F.lit(1)), fraction, edge, 1.0, seed, by)


def _led(patches: DataFrame, count: Callable[[Column], Column], fraction: float | str, edge: str, power: float, seed: str, by: str) -> DataFrame:
    share = F.col(fraction) if isinstance(fraction, str) else F.lit(fraction)
    patches = cut(patches)  # counted, sampled for ranges and dealt: made once
    out = beside(patches, (by,), __n=F.count(F.lit(1))).withColumn("__k", count(F.col("__n")))
    out = out.withColumn("__led", F.greatest(F.least(F.bround(F.col("__k") * share), F.col("__k")), F.lit(0)))
    out = ranks(out, (by,), (F.pow(edge, F.lit(power)).desc(), F.col("pid")), "__r").withColumn("__top", F.col("__r") <= F.col("__led"))
    out = ranks(out, (by,), (F.col("__top"), noise(seed, by, "pid"), F.col("pid")), "__rest")
    return out.withColumn("masked", F.col("__top") | (F.col("__rest") <= F.col("__k") - F.col("__led"))).drop("__n", "__k", "__led", "__r", "__top", "__rest")


def enforce_ratio(patches: DataFrame, action: str, prob: str, least: float, most: float, by: str = "sample") -> DataFrame:
    """Adds masked: actions, with the likeliest added or the unlikeliest dropped."""
    out = beside(patches, (by,), __n=F.count(F.lit(1)), __chosen=F.sum(F.col(action).cast("int")))
    low, high = F.greatest(F.lit(1), F.bround(F.lit(least) * F.col("__n"))), F.least(F.col("__n") - 1, F.bround(F.lit(most) * F.col("__n")))
    want = F.least(F.greatest("__chosen", low), high)
    out = ranks(out, (by,), (F.col(action).desc(), F.col(prob).desc(), F.col("pid")), "__r")
    return out.withColumn("masked", F.col("__r") <= want).drop("__n", "__chosen", "__r")


def most_likely(choices: DataFrame, by: tuple[str, ...], value: str = "value", prob: str = "prob") -> DataFrame:
    """(by, value): the value of greatest probability, the least value if tied."""
    return choices.groupBy(*by).agg(F.max_by(value, F.struct(F.col(prob), -F.col(value))).alias(value))


def nearest_bin(value: Column, bins: list[float]) -> Column:
    """The number, from 0, of the bin nearest to a value; the first if tied."""
    if not bins:
        raise ValueError("no bins")
    far = F.array(*(F.struct(F.abs(value - F.lit(float(b))).alias("far"), F.lit(i).alias("i")) for i, b in enumerate(bins)))
    return F.array_min(far)["i"]


def mask_coverage(patches: DataFrame, edge: str = "edge", by: str = "sample") -> DataFrame:
    """(by, ratio, coverage, gain, mean, std, max, min) of a mask over edge scores."""
    m, e = F.col("masked").cast("double"), F.col(edge)
    cover = F.sum(m * e) / F.greatest(F.sum(e), F.lit(1e-6))
    return patches.groupBy(by).agg(F.avg(m).alias("ratio"), cover.alias("coverage"), (cover - F.avg(m)).alias("gain"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.max(e).alias("max"), F.min(e).alias("min"))
