"""Exact order statistics of groups of any size, by histograms that are refined.

Each pass counts the values of a range by ``BINS`` bins, keeps the bin that holds the
wanted rank, and goes on between that bin's own least and greatest value; where these
are equal, the value is found.  Bins are of equal width; where one of them still holds
much of its range, the next pass has bins of equal ratio, so that values of very unlike
size part as well.  Counts have partial results in every task, so no task holds a
group's values, nor all the distinct ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import cut, release

BINS = 2048


def at_ranks(rows: DataFrame, by: tuple[str, ...], value: str, ranks: DataFrame) -> DataFrame:
    """(by, rank, value): the value at each rank, from 0, of its group's values in order.

    ``ranks`` is (by, rank); ranks beyond the group are left out.  Null and NaN don't
    count.
    """
    by = list(by)
    v = F.col("__v")
    seen = rows.select(*by, F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    ends = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    start = (F.lit(0).cast("bigint").alias("__below"), F.lit(False).alias("__ratio"))
    wanted = cut(ranks.distinct().join(ends, by).where(F.col("rank") < F.col("__n")).select(*by, "rank", "__lo", "__hi", *start))
    span = ["__lo", "__hi", "__ratio"]
    while not wanted.where("__lo < __hi").isEmpty():
        ranges = wanted.where("__lo < __hi").select(*by, *span).distinct()
        inside = seen.join(ranges, by).where((v >= F.col("__lo")) & (v <= F.col("__hi")))
        bins = inside.groupBy(*by, *span, _place(v).alias("__bin")).agg(F.count(F.lit(1)).alias("__held"), F.min("__v").alias("__first"), F.max("__v").alias("__last"))
        group = Window.partitionBy(*by, *span)
        before = group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumns({"__start": F.coalesce(F.sum("__held").over(before), F.lit(0)), "__all": F.sum("__held").over(group)})
        at = F.col("rank") - F.col("__below")
        found = wanted.where("__lo < __hi").join(bins, [*by, *span]).where((at >= F.col("__start")) & (at < F.col("__start") + F.col("__held")))
        turn = ~F.col("__ratio") & (4 * F.col("__held") > F.col("__all"))
        next_ = found.select(*by, "rank", F.col("__first").alias("__lo"), F.col("__last").alias("__hi"), (F.col("__below") + F.col("__start")).alias("__below"), turn.alias("__ratio"))
        further = cut(wanted.where("__lo = __hi").unionByName(next_))
        release(wanted)
        wanted = further
    return wanted.select(*by, "rank", F.col("__lo").alias("value"))


def _place(v: Column) -> Column:
    """The bin of a value between __lo and __hi: of equal width, or of equal ratio."""

    def size(x: Column) -> Column:
        return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))  # no double is below 2^-1074

    lo, hi = F.col("__lo"), F.col("__hi")
    # Halved before they are subtracted, so that no range overflows.
    width = (v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    ratio = (size(v) - size(lo)) / F.nullif(size(hi) - size(lo), F.lit(0.0))
    return F.coalesce(F.least(F.floor(F.when(F.col("__ratio"), ratio).otherwise(width) * BINS), F.lit(BINS - 1)), F.lit(0))


def exact_quantiles(rows: DataFrame, by: tuple[str, ...], value: str, levels: tuple[float, ...], out: str = "quantiles") -> DataFrame:
    """(by, out): an array of quantiles, in line between the two values beside each.

    A group without values is not there.
    """
    by = list(by)
    v = F.col(value).cast("double")
    sizes = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    each = sizes.select(*by, F.posexplode(F.array(*(F.lit(float(q)) * (F.col("__n") - 1) for q in levels))).alias("level", "at")).withColumn("rank", F.floor("at"))
    ends = each.select(*by, "level", "at", "rank", F.ceil("at").alias("upper"))
    values = at_ranks(rows, tuple(by), value, ends.select(*by, F.explode(F.array("rank", "upper")).alias("rank")))
    low, high = values.withColumnRenamed("value", "low"), values.select(*by, F.col("rank").alias("upper"), F.col("value").alias("high"))
    met = ends.join(low, [*by, "rank"]).join(high, [*by, "upper"])
    # The sum of both shares, as Spark's own percentile adds them up.
    between = F.when(F.col("rank") == F.col("upper"), F.col("low")).otherwise((F.col("upper") - F.col("at")) * F.col("low") + (F.col("at") - F.col("rank")) * F.col("high"))
    return met.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", between.alias("q")))), lambda s: s["q"]).alias(out))


def least_of(rows: DataFrame, by: tuple[str, ...], most: int, order: Column) -> DataFrame:
    """Of each group the ``most`` rows of least ``order``, an integer below 2^53; rows that tie at the last all stay.

    The bound is found from counts, so a group's rows are never ranked or gathered.
    """
    keyed = rows.withColumn("__order", order.cast("double"))
    last = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select(*by, F.lit(most - 1).cast("bigint").alias("rank"))
    bound = at_ranks(keyed, by, "__order", last).select(*by, F.col("value").alias("__last"))
    kept = keyed.join(bound, list(by), "left").where(F.col("__last").isNull() | (F.col("__order") <= F.col("__last")))
    return kept.drop("__order", "__last")
