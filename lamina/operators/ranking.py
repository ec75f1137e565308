"""Ranks within groups of any size, and figures of a group beside its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import cut


def ranks(rows: DataFrame, by: tuple[str, ...], order: tuple[Column | str, ...], out: str) -> DataFrame:
    """Adds ``out``: a row's place, from 1, in the order of its group.

    Rows are dealt by ranges of group and order, numbered inside their range, and
    moved up by what the group's earlier ranges hold; so a group's rows never
    meet in one task.  ``order`` should tell rows of a group apart.
    """
    dealt = cut(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    placed = dealt.withColumn("__place", place).join(starts, [*by, "__range"])
    return placed.withColumn(out, F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


#: Groups by these columns alone are few: one a volume and channel.
FEW = {"sample", "c"}


def beside(rows: DataFrame, by: tuple[str, ...], **figures: Column) -> DataFrame:
    """Adds aggregates of a row's group: summed up with partial results, then joined.

    Those of whole volumes are sent to every task, so that a volume's rows don't meet in one.
    """
    sums = rows.groupBy(*by).agg(*(f.alias(n) for n, f in figures.items()))
    return rows.join(F.broadcast(sums) if FEW.issuperset(by) else sums, list(by))
