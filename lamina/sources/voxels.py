"""Voxel tables: a dense volume as rows of (sample, z, y, x) and channels.

``demo_voxels`` lays three star-schema tables out as small volumes of 20 x 20
slices, so that every operator can be tried, and checked by SQL, on any data
that holds those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("sample", "z", "y", "x")

_CHANNELS = """
select sample, id, z, y, x, raw,
  case when (id * 31 + m) % 17 = 0 then 0
       else (z {div} 4) * 100 + (y {div} 5) * 10 + (x {div} 5) + 1 end as label,
  (z {div} 4) * 100 + (y {div} 10) * 10 + (x {div} 5) + 1
    + case when (id * 13 + m) % 29 = 0 then 100000 else 0 end as pred,
  cast((id * 7919 + m * 104729 + 11) % 1000 as double) / cast(1000 as double) as az,
  cast((id * 6101 + m * 15485863 + 23) % 1000 as double) / cast(1000 as double) as ay,
  cast((id * 3571 + m * 32452843 + 37) % 1000 as double) / cast(1000 as double) as ax
from (select sample, id, m, id {div} 400 as z, (id {div} 20) % 20 as y, id % 20 as x,
             cast(cast(floor(v) as bigint) % 256 as double) as raw
      from {src})
"""
#: The same view for other engines: ``vox`` after ``with``.
VOX_SQL = (
    """with src as (
select 'A' as sample, event_id as id, cast(user_id as bigint) as m, value as v from events
union all select 'B', o_orderkey, cast(o_custkey as bigint), o_totalprice from orders
union all select 'C', p_partkey, cast(p_size as bigint), p_retailprice from part),
vox as ("""
    + _CHANNELS.format(div="//", src="src")
    + ")"
)


def demo_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, id, z, y, x, raw, label, pred, az, ay, ax)."""
    parts = [
        spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"'{s}' sample", f"cast({i} as bigint) id", f"cast({m} as bigint) m", f"cast({v} as double) v")
        for s, table, i, m, v in (("A", "events", "event_id", "user_id", "value"), ("B", "orders", "o_orderkey", "o_custkey", "o_totalprice"), ("C", "part", "p_partkey", "p_size", "p_retailprice"))
    ]
    src = parts[0].union(parts[1]).union(parts[2])
    return spark.sql(_CHANNELS.format(div="div", src="{src}"), src=src)


def synthetic_volumes(blobs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(sample, z, y, x, label, raw): volumes of ellipsoids, without noise.

    ``blobs``: (sample, num, cz, cy, cx, rz, ry, rx); a greater number covers a
    smaller one, and brightness falls off from the nearest centre.  Blobs go to the planes
    of their volume, and a plane's voxels are made and summed up where it lies, so
    that voxels are never shuffled.
    """
    d, h, w = shape
    planes = blobs.withColumn("z", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(d - 1).cast("bigint")))).repartition("sample", "z")
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(h * w - 1).cast("bigint"))
    each = planes.withColumn("__i", F.explode(places)).withColumns({"y": F.expr(f"__i div {w}"), "x": F.col("__i") % w})
    far = sum((F.pow((F.col(a) - F.col(f"c{a}")) / F.col(f"r{a}"), F.lit(2.0)) for a in "zyx"), F.lit(0.0))
    agg = each.withColumn("far", far).groupBy(*KEYS).agg(F.max(F.when(F.col("far") < 1, F.col("num"))).alias("top"), F.max(F.exp(-2.5 * F.col("far"))).alias("glow"))
    return agg.select(*KEYS, F.coalesce(F.col("top"), F.lit(0)).cast("bigint").alias("label"), F.least(F.greatest(0.15 + 0.75 * F.col("glow"), F.lit(0.0)), F.lit(1.0)).alias("raw"))
