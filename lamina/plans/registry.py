"""All registered queries over the demo volumes, and the SQL that says the same.

Floating results are rounded to six places: engines differ in the last bits.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import blocks, graph, grid, losses, masking, metrics, stencil, sweep
from lamina.session import cut
from lamina.sources.voxels import VOX_SQL, demo_voxels, synthetic_volumes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, volume: bool = True):
    """Register a function of the voxels (or of the session and folder).

    ``sql`` follows the volume's view; ``{r:expr}`` stands for a rounded double.
    """

    def register(f):
        name = f.__name__.lstrip("_")
        QUERIES[name] = (lambda spark, sf_dir: f(demo_voxels(spark, sf_dir))) if volume else f
        if sql is not None:
            ORACLE_SQL[name] = VOX_SQL + (", " if re.match(r"\s*\w+ as \(", sql) else " ") + sql if volume else sql
        return f

    return register


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """The columns named, as doubles rounded to six places."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def r96(df: DataFrame, *cols: str) -> DataFrame:
    """Rounded to six places, from midway up: for means that may lie midway between two sixth places."""
    return df.withColumns({c: F.round(F.round(F.col(c).cast("double"), 9) + 5e-10, 6) for c in cols})


def logits(vox: DataFrame) -> DataFrame:
    return vox.withColumns({f"l{a}": 8 * (F.col(f"a{a}") - 0.5) for a in "zyx"})


K = ["sample", "z", "y", "x"]
_LINES = {"z": "y, x", "y": "z, x", "x": "z, y"}


def _back(axis: str, col: str, table_cols: str = "sample") -> str:
    """SQL for the value one step back on an axis."""
    w = f"over (partition by sample, {_LINES[axis]} order by {axis})"
    return f"(case when lag({axis}) {w} = {axis} - 1 then lag({col}) {w} end)"


def _forth(axis: str, col: str) -> str:
    w = f"over (partition by sample, {_LINES[axis]} order by {axis})"
    return f"(case when lead({axis}) {w} = {axis} + 1 then lead({col}) {w} end)"


# ---- metrics -------------------------------------------------------------

_TABLES = """
t as (select sample, {truth} gt, pred, count(*) n from {src} where {truth} <> 0 group by all),
s as (select sample, cast(sum(n) as double) total from t group by 1),
bp as (select sample, sum(n) n from t group by sample, pred), bg as (select sample, sum(n) n from t group by sample, gt),
j as (select t.sample, sum(cast(n as double) * (n - 1) / 2) pr, sum(-(n / total) * log2(n / total)) h, any_value(total) total from t join s using (sample) group by 1),
mp as (select bp.sample, sum(cast(n as double) * (n - 1) / 2) pr, sum(-(n / total) * log2(n / total)) h, count(*) c from bp join s using (sample) group by 1),
mg as (select bg.sample, sum(cast(n as double) * (n - 1) / 2) pr, sum(-(n / total) * log2(n / total)) h, count(*) c from bg join s using (sample) group by 1),
m as (select j.sample, coalesce(j.pr / nullif(mp.pr, 0), 0) p, coalesce(j.pr / nullif(mg.pr, 0), 0) r, greatest(j.h - mg.h, 0) sp, greatest(j.h - mp.h, 0) me, mp.c np, mg.c ng, total
  from j join mp using (sample) join mg using (sample))"""
_SUMMARY = """
select sample, round(1 - 2 * p * r / (p + r), 6) adapted_rand_error, round(2 * p * r / (p + r), 6) rand_fscore, round({p}, 6) rand_precision, round({r}, 6) rand_recall,
  round(sp, 6) voi_split, round(me, 6) voi_merge, round(sp + me, 6) voi_sum, cast(np as bigint) n_pred, cast(ng as bigint) n_gt, cast(total as bigint) n_voxels from m
"""
_METRICS = _TABLES + _SUMMARY.format(p="p", r="r")
_SCORES = ["adapted_rand_error", "rand_fscore", "rand_precision", "rand_recall", "voi_split", "voi_merge", "voi_sum"]


@query(_METRICS.format(truth="label", src="vox"))
def segmentation_metrics(vox):
    return r6(metrics.segmentation_metrics(vox), *_SCORES)


@query(_TABLES.format(truth="label", src="vox") + _SUMMARY.format(p="r", r="p"))
def segmentation_metrics_swapped(vox):
    return r6(metrics.segmentation_metrics(vox, backend="skimage"), *_SCORES)


@query("select sample, pred, label as gt, count(*) n from vox where label <> 0 group by all")
def contingency(vox):
    return metrics.contingency(vox)


_IGNORED = f"""e as (select *, greatest(
    cast(coalesce({_back("y", "label")} <> label, false) as int), cast(coalesce({_back("x", "label")} <> label, false) as int),
    cast(coalesce({_forth("y", "label")} <> label, false) as int), cast(coalesce({_forth("x", "label")} <> label, false) as int)) edge from vox),
e1 as (select *, max(edge) over (partition by sample, z, x order by y range between 1 preceding and 1 following) ey from e),
e2 as (select *, max(ey) over (partition by sample, z, y order by x range between 1 preceding and 1 following) near from e1),
masked as (select *, case when near = 1 then 0 else label end masked from e2)"""


@query(_IGNORED + " select sample, z, y, x, cast(masked as bigint) masked from masked")
def boundary_ignore(vox):
    return blocks.boundary_ignore(vox).select(*K, F.col("masked").cast("bigint"))


@query(_IGNORED + ", " + _METRICS.strip().format(truth="masked", src="masked"))
def boundary_ignore_metrics(vox):
    return r6(metrics.segmentation_metrics(blocks.boundary_ignore(vox), truth="masked"), *_SCORES)


_SEAM = "(({a} - {a} % {c} > 0 and {a} % {c} < 2) or ({a} - {a} % {c} + {c} < d{a} and {c} - {a} % {c} <= 2))"
_SEAMS = " or ".join(f"(d{a} > {c} and {_SEAM.format(a=a, c=c)})" for a, c in (("z", 8), ("y", 10), ("x", 10)))
_REGION = f"t0 as (select *, max(z) over (partition by sample) + 1 dz, max(y) over (partition by sample) + 1 dy, max(x) over (partition by sample) + 1 dx from vox), sm as (select *, {_SEAMS} seam from t0)"


def _seamed(vox):
    return grid.with_extents(vox).withColumn("seam", stencil.seam_mask({"z": 8, "y": 10, "x": 10}, {a: F.col(f"d{a}") for a in "zyx"}, 2))


QUERIES["seam_mask"] = lambda spark, sf_dir: _seamed(demo_voxels(spark, sf_dir)).select(*K, "seam")
ORACLE_SQL["seam_mask"] = VOX_SQL + ", " + _REGION + " select sample, z, y, x, seam from sm"
QUERIES["seam_region_metrics"] = lambda spark, sf_dir: r6(metrics.segmentation_metrics(_seamed(demo_voxels(spark, sf_dir)).withColumn("label", F.when(F.col("seam"), F.col("label")).otherwise(0))), *_SCORES)
ORACLE_SQL["seam_region_metrics"] = VOX_SQL + ", " + _REGION + ", sl as (select sample, pred, case when seam then label else 0 end label from sm), " + _METRICS.strip().format(truth="label", src="sl")


@query("select sample, count(distinct label) n_labels, round(avg(case when label = 0 then 1.0::double else 0 end), 6) zero_share, round(avg(case when label = 0 then 1.0::double else 0 end), 6) ignore_share from vox group by 1")
def label_stats(vox):
    return r6(metrics.label_stats(vox), "zero_share", "ignore_share")


@query("""w as (select sample, unnest(['z', 'y', 'x']) channel, unnest([az, ay, ax]) v from vox)
select sample, channel, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, """ + ", ".join(f"round(quantile_cont(v, {q / 100}), 6) p{q:02d}" for q in (1, 5, 50, 95, 99)) + " from w group by 1, 2")
def affinity_stats(vox):
    return r6(metrics.channel_stats(vox, {a: f"a{a}" for a in "zyx"}), "mean", "std", "p01", "p05", "p50", "p95", "p99")


@query(f"""w as (select sample, 8 * (ax - 0.5::double) l, cast(coalesce({_back("x", "label")} = label and label > 0, false) as int) t from vox),
g as (select sample, sum(case when l >= 0 then t else 0 end) b, sum(case when l >= 0 then 1 else 0 end) p, sum(t) t from w group by 1)
select sample, round(2.0::double * b / (p + t), 6) dice, round(b / cast(p + t - b as double), 6) iou from g""")
def dice_iou(vox):
    return r6(metrics.overlap(stencil.affinities(logits(vox)), "lx", "tx"), "dice", "iou")


# ---- scalar functions ----------------------------------------------------

@query("""s as (select sample, max(raw) top, quantile_cont(raw, 0.01) lo, quantile_cont(raw, 0.99) hi from vox group by 1)
select sample, z, y, x, round(case when hi > lo then least(greatest((raw / 255 - lo / 255) / (hi / 255 - lo / 255), 0), 1) else raw / 255 end, 6) norm from vox join s using (sample)""")
def normalize_volume(vox):
    return r6(scalar.normalize_volume(vox).select(*K, "norm"), "norm")


_VARIANTS = [(0.0, 0.0, 0.0, 1.0), (0.2, -0.1, -0.1, 1.0), (0.2, -0.1, -0.1, 0.8), (0.001, 0.0, 0.0, 1.0)]


@query("""w as (select * from (values ('bias_z+0.00_y+0.00_x+0.00_t1.00', 0.0::double, 0.0::double, 0.0::double, 1.0::double),
  ('bias_z+0.20_y-0.10_x-0.10_t1.00', 0.2, -0.1, -0.1, 1.0), ('bias_z+0.20_y-0.10_x-0.10_t0.80', 0.2, -0.1, -0.1, 0.8)) v(variant, bz, b_y, bx, t))
select sample, variant, """ + ", ".join(f"round(avg(1 / (1 + exp(-((8 * (a{a} - 0.5::double) + {b}) / t)))), 6) m{a}" for a, b in (("z", "bz"), ("y", "b_y"), ("x", "bx"))) + " from vox, w group by 1, 2")
def calibrate_variants(vox):
    each = scalar.calibrate(logits(vox), _VARIANTS)
    return r6(each.groupBy("sample", "variant").agg(*(F.avg(f"p{a}").alias(f"m{a}") for a in "zyx")), "mz", "my", "mx")


@query("""select sample, z, y, x, round(ln(least(greatest(ax, 1e-6), 1 - 1e-6) / least(greatest(1 - ax, 1e-6), 1)), 6) l from vox""")
def logit_of_probability(vox):
    return r6(vox.select(*K, scalar.logit(F.col("ax")).alias("l")), "l")


@query("select sample, z, y, x, round(1 - 0.5 * (ay + ax), 6) boundary, (az + ay + ax) / 3 >= 0.5 as inside from vox")
def boundary_map(vox):
    return r6(vox.select(*K, (1 - 0.5 * (F.col("ay") + F.col("ax"))).alias("boundary"), ((F.col("az") + F.col("ay") + F.col("ax")) / 3 >= 0.5).alias("inside")), "boundary")


@query("""select sample, z, y, x, round(least(greatest(raw / 255 * 1.1 - 0.02, 0), 1), 6) gained,
round(least(greatest(pow(least(greatest(raw / 255, 1e-4), 1), 1.3), 0), 1), 6) gammaed from vox""")
def gamma_gain(vox):
    v = F.col("raw") / 255
    return r6(vox.select(*K, scalar.gain_bias(v, 1.1, -0.02).alias("gained"), scalar.gamma(v, 1.3).alias("gammaed")), "gained", "gammaed")


@query("select sample, z, 19 - x as y, 19 - y as x, raw from vox")
def rot90_flip(vox):
    turned = scalar.rotate_xy(vox, 1, 20)  # (y, x) -> (19 - x, y)
    return scalar.flip(turned, "x", 20).select(*K, "raw")


_DRAWS = {"turn": 0.3, "flip_x": 0.1, "flip_y": 0.9, "flip_z": 0.9, "gain": 0.2, "gain_by": 0.4, "bias_by": 0.7, "gamma": 0.1, "gamma_by": 0.5, "noise": 0.05}
_DRAW = "(cast('0x' || substr(md5('0:{}:' || sample || ':' || z || ':' || y || ':' || x), 1, 8) as bigint) + 0.5::double) / 4294967296::double"


@query(f"""w as (select sample, z, 19 - x as y, 19 - y as x, label, least(greatest(raw / 255 * (0.85::double + 0.30::double * 0.4::double) + 0.10::double * (0.7::double - 0.5::double), 0), 1) v from vox),
w1 as (select *, pow(least(greatest(v, 1e-4), 1), 1.1::double) g, sqrt(-2 * ln({_DRAW.format("r")})) * cos(2 * pi() * {_DRAW.format("a")}) n from w)
select sample, z, y, x, label, round(least(greatest(g + 0.03::double * n, 0), 1), 6) raw from w1""")
def augment_volume(vox):
    bright = vox.withColumn("raw", F.col("raw") / 255)
    return r6(scalar.augment(bright, _DRAWS, {"z": 1, "y": 20, "x": 20}).select(*K, "label", "raw"), "raw")


@query("select sample, z, y, x, c, round(v, 6) v from (select sample, z, y, x, unnest([0, 1, 2]) c, unnest([ax, ay, az]) v from vox)")
def choose_channels(vox):
    long = vox.select(*K, F.posexplode(F.array("az", "ay", "ax", "raw")).alias("c", "v"))
    return r6(scalar.choose_channels(long, (2, 1, 0)), "v")


@query("select p_partkey, regexp_replace(p_name, '[^0-9A-Za-z._-]', '_', 'g') tag from part", volume=False)
def safe_tag(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scalar.safe_tag(F.col("p_name")).alias("tag"))


@query("""p as (select sample, ((z // 2) * 2 + y // 10) * 2 + x // 10 pid, ((z % 2) * 10 + y % 10) * 10 + x % 10 place, raw from vox)
select sample, pid, cast(count(*) as bigint) n, round(sum(raw * (place + 1)), 6) digest from p group by 1, 2""")
def patchify(vox):
    p = scalar.patchify(vox, (2, 10, 10), (2, 2))
    digest = F.aggregate(F.transform("vals", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return r6(p.select("sample", "pid", F.size(F.array_compact("vals")).cast("bigint").alias("n"), digest.alias("digest")), "digest")


@query("select sample, z, y, x, raw from vox")
def unpatchify(vox):
    return scalar.unpatchify(scalar.patchify(vox, (2, 10, 10), (2, 2)), (2, 10, 10), (2, 2)).select(*K, "raw")


# ---- stencils ------------------------------------------------------------

def _aff(replicate: bool) -> str:
    edge = "cast(label > 0 as int)" if replicate else "0"
    cols = ", ".join(f"case when {_back(a, 'label')} is null then {edge} else cast({_back(a, 'label')} = label and label > 0 as int) end t{a}" for a in "zyx")
    return f"select sample, z, y, x, {cols} from vox"


@query(_aff(False))
def affinity_nn(vox):
    return stencil.affinities(vox).select(*K, "tz", "ty", "tx")


@query(_aff(True))
def affinity_replicate(vox):
    return stencil.affinities(vox, replicate=True).select(*K, "tz", "ty", "tx")


_OFFSETS = [(-1, 0, 0), (0, -3, 0), (0, 2, -2)]


@query("""w as (select * from (values (0, -1, 0, 0), (1, 0, -3, 0), (2, 0, 2, -2)) o(c, dz, dy, dx))
select a.sample, c, a.z, a.y, a.x, cast(coalesce(b.label = a.label and a.label > 0, false) as int) t
from vox a cross join w left join vox b on b.sample = a.sample and b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx""")
def affinity_offsets(vox):
    return stencil.offset_affinities(vox, _OFFSETS)


_FAR = [(-1, 0, 0), (0, -3, 0), (0, 2, -2), (0, 0, -1), (5, 0, 0)]


@query("w as (select * from (values " + ", ".join(f"({c}, {z}, {y}, {x})" for c, (z, y, x) in enumerate(_FAR)) + """) o(c, dz, dy, dx)),
e as (select a.sample, c, a.z, a.y, a.x, case when (c = 0 and a.z = 0) or (c = 3 and a.x = 0) then a.label > 0 else coalesce(b.label = a.label and a.label > 0, false) end t,
  a.label <> 0 and (coalesce(b.label <> 0, false) or (c = 0 and a.z = 0) or (c = 3 and a.x = 0)) v from vox a cross join w left join vox b on b.sample = a.sample and b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx)
select sample, z, y, x, """ + ", ".join(f"cast(max(case when c = {c} then {k}::int end) as int) {k}{c}" for k in "tv" for c in range(len(_FAR))) + " from e group by 1, 2, 3, 4")
def edge_targets(vox):
    return blocks.edge_targets(vox, _FAR, replicate=True, ignore=0).select(*K, *(f"{k}{c}" for k in "tv" for c in range(len(_FAR))))


@query("select sample, z, y, x, " + ", ".join(f"cast(coalesce(label <> 0 and {_back(a, 'label')} <> 0, false) as int) v{a}" for a in "zyx") + " from vox")
def valid_mask(vox):
    return stencil.valid_edges(vox).select(*K, "vz", "vy", "vx")


@query("""w as (select *, case when label = 0 then max(label) over (partition by sample, z) + 1 else label end lifted from vox),
w1 as (select *, max(label) over (partition by sample, z, x order by y range between 1 preceding and 1 following) h, min(lifted) over (partition by sample, z, x order by y range between 1 preceding and 1 following) l from w),
w2 as (select *, max(h) over (partition by sample, z, y order by x range between 1 preceding and 1 following) hh, min(l) over (partition by sample, z, y order by x range between 1 preceding and 1 following) ll from w1)
select sample, z, y, x, case when hh <> ll then 0 else label end widened from w2""")
def widen_border(vox):
    return stencil.widen_boundaries(vox).select(*K, "widened")


_STEP = "coalesce(abs(raw - {b}), 0)"


@query("w as (select *, " + " + ".join(f"{w} * " + _STEP.format(b=_back(a, "raw")) for a, w in (("z", 0.5), ("y", 1.0), ("x", 1.0))) + """ g from vox)
select sample, z, y, x, round(least(g / greatest(avg(g) over (partition by sample), 1e-6), 5), 6) edge from w""")
def edge_map(vox):
    return r6(stencil.edge_map(vox, (0.5, 1.0, 1.0)).select(*K, "edge"), "edge")


@query("w as (select *, " + ", ".join(f"abs((ax - {_back(a, 'ax')}) - (ay - {_back(a, 'ay')})) g{a}" for a in "zyx") + """ from vox)
select sample, round((coalesce(avg(gz), 0) + coalesce(avg(gy), 0) + coalesce(avg(gx), 0)) / 3, 6) loss from w group by 1""")
def gradient_loss(vox):
    return r6(stencil.gradient_loss(vox, "ax", "ay"), "loss")


@query("w as (select *, " + ", ".join(_STEP.format(b=_back(a, "raw")) + f" g{a}" for a in "zyx") + " from vox) select sample, z, y, x, " + ", ".join(f"round(exp(-g{a} / greatest(avg(g{a}) over (partition by sample), 1e-6)), 6) p{a}" for a in "zyx") + " from w")
def pseudo_affinity(vox):
    return r6(stencil.pseudo_affinity(vox).select(*K, "pz", "py", "px"), "pz", "py", "px")


_N = "case when max({a}) over (partition by sample) = 0 then -1.0::double else -1 + 2.0::double * {a} / max({a}) over (partition by sample) end"


@query("w as (select *, " + ", ".join(f"{_N.format(a=a)} n{a}" for a in "zyx") + " from vox) select sample, z, y, x, cast(label > 0 as int) fg, " + ", ".join(f"round(round(case when label > 0 then least(greatest(avg(n{a}) over (partition by sample, label) - n{a}, -1), 1) else 0 end, 9) + 5e-10::double, 6) + 0.0 o{a}" for a in "zyx") + " from w")
def lsd_targets(vox):
    out = r96(stencil.shape_descriptors(vox).select(*K, "fg", "oz", "oy", "ox"), "oz", "oy", "ox")
    return out.withColumns({f"o{a}": F.col(f"o{a}") + 0.0 for a in "zyx"})


@query("""w as (select *, sum(ax) over (partition by sample, y, x order by z range between 1 preceding and 1 following) a1 from vox),
w1 as (select *, sum(a1) over (partition by sample, z, x order by y range between 1 preceding and 1 following) a2 from w)
select sample, z, y, x, round(sum(a2) over (partition by sample, z, y order by x range between 1 preceding and 1 following) / 27, 6) pooled from w1""")
def average_pool(vox):
    return r6(stencil.average_pool(vox, 3, "ax", "pooled").select(*K, "pooled"), "pooled")


@query("""w as (select * from (values (0, -1, 0, 0), (1, 0, -3, 0), (2, 0, 2, -2)) o(c, dz, dy, dx))
select a.sample, c, a.z, a.y, a.x, cast(a.label <> 0 and (coalesce(b.label <> 0, false) or (c = 0 and a.z = 0)) as int) v
from vox a cross join w left join vox b on b.sample = a.sample and b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx""")
def offset_valid_mask(vox):
    return stencil.offset_valid(vox, _OFFSETS, replicate=True)


# ---- grids ---------------------------------------------------------------

_WINDOWS = ((8, 5), (16, 6), (64, 32), (7, 7))


@query("t as (select sample, " + ", ".join(f"max({a}) + 1 d{a}" for a in "zyx") + " from vox group by 1), u as (" + " union all ".join(f"select sample, '{a}' as axis, d{a} as dim from t" for a in "zyx") + """),
g as (select * from (values (8, 5), (16, 6), (64, 32), (7, 7)) v(win, stride))
select sample, axis, dim, win, stride, unnest(case when dim <= win then [0] else list_sort(list_distinct(list_append(range(0, dim - win + 1, stride), dim - win))) end) as start from u, g""")
def sliding_starts(vox):
    dims = grid.extents(vox).select("sample", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"d{a}").alias("dim")) for a in "zyx"))).alias("d")).select("sample", "d.*")
    plans = F.array(*(F.struct(F.lit(w).alias("win"), F.lit(s).alias("stride"), grid.sliding_starts(F.col("dim"), w, s).alias("starts")) for w, s in _WINDOWS))
    return dims.withColumn("p", F.explode(plans)).select("sample", "axis", "dim", "p.win", "p.stride", F.explode("p.starts").alias("start"))


_CHUNK, _HALO = (8, 10, 12), (2, 3, 4)
_PLAN = "t as (select sample, max(z) + 1 dz, max(y) + 1 dy, max(x) + 1 dx from vox group by 1), " + ", ".join(f"t{a} as (select sample, d{a}, unnest(case when d{a} <= {c} then [0] else range(0, d{a}, {c}) end) {a}0 from t)" for a, c in zip("zyx", _CHUNK, strict=True))


@query(_PLAN + " select sample, " + ", ".join(f"{a}0, least({a}0 + case when d{a} <= {c} then d{a} else {c} end, d{a}) {a}1, greatest({a}0 - {h}, 0) e{a}0, least(least({a}0 + case when d{a} <= {c} then d{a} else {c} end, d{a}) + {h}, d{a}) e{a}1" for a, c, h in zip("zyx", _CHUNK, _HALO, strict=True)) + " from tz join ty using (sample) join tx using (sample)")
def chunk_plan(vox):
    return grid.chunk_plan(grid.extents(vox), _CHUNK, _HALO)


@query(_PLAN + """ select v.sample, z0 // 8 cz, y0 // 10 cy, x0 // 12 cx, cast(count(*) as bigint) n, cast(sum(case when v.z // 8 = z0 // 8 and v.y // 10 = y0 // 10 and v.x // 12 = x0 // 12 then 1 else 0 end) as bigint) n_core
from vox v join tz using (sample) join ty using (sample) join tx using (sample)
where v.z >= z0 - 2 and v.z < z0 + 8 + 2 and v.y >= y0 - 3 and v.y < y0 + 10 + 3 and v.x >= x0 - 4 and v.x < x0 + 12 + 4 group by 1, 2, 3, 4""")
def chunk_halo_core(vox):
    return grid.deal_to_chunks(vox, _CHUNK, _HALO).groupBy("sample", "cz", "cy", "cx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("core").cast("bigint")).alias("n_core"))


@query("""w as (select * from (values (0), (5), (10), (12)) a(wy)), t as (select v.*, w.wy, u.wy wx from vox v join w on w.wy <= v.y and v.y < w.wy + 8 join w u on u.wy <= v.x and v.x < u.wy + 8)
select sample, z, y, x, count(*) n, round(1 / (1 + exp(-avg(8 * (ax - 0.5::double) + 0.01 * (wy - wx)))), 6) p from t group by 1, 2, 3, 4""")
def window_stitch(vox):
    logit = 8 * (F.col("ax") - 0.5) + 0.01 * (F.col("wy") - F.col("wx"))
    return r6(grid.stitch_windows(vox, {"y": 20, "x": 20}, (None, 8, 8), (None, 5, 5), logit), "p")


@query("t as (select sample, " + ", ".join(f"case when max({a}) + 1 > {n} then (max({a}) + 1 - {n}) // 2 else 0 end s{a}" for a, n in (("z", 3), ("y", 12), ("x", 16))) + """ from vox group by 1)
select sample, z - sz as z, y - sy as y, x - sx as x, raw, label from vox join t using (sample) where z >= sz and z < sz + 3 and y >= sy and y < sy + 12 and x >= sx and x < sx + 16""")
def center_crop(vox):
    return grid.centre_crop(vox, {"z": 3, "y": 12, "x": 16}).select(*K, "raw", "label")


@query("select sample, z - 1 as z, y - 4 as y, x, raw, label from vox where z >= 1 and z < 4 and y >= 4 and y < 16")
def paired_crop(vox):
    return grid.paired_crop(vox.select(*K, "raw"), vox.select(*K, "label"), {"z": (1, 4), "y": (4, 16)}).select(*K, "raw", "label")


@query("select sample, z, y, x, raw from vox union all select sample, z, 38 - y, x, raw from vox where 38 - y >= 20 and 38 - y < 26")
def pad_reflect(vox):
    return grid.pad(vox, "y", 20, 26).select(*K, "raw")


@query("t as (select sample, row_number() over (order by sample) - 1 as path, count(*) over () n, " + ", ".join(f"max({a}) + 1 d{a}" for a in "zyx") + """ from vox group by 1), u as (select sample, path, k * n + path as index, dz, dy, dx from t, (select unnest(range(0, 40)) k))
select index, path, sample, """ + ", ".join(f"cast(('0x' || substr(md5('7:{a}:' || index), 1, 8)) as bigint) % (greatest(d{a} - {m}, 0) + 1) as {a}0" for a, m in (("z", 8), ("y", 10), ("x", 16))) + " from u")
def crop_plan(vox):
    return grid.crop_plan(grid.extents(vox), 40, (8, 10, 16), 7)


# ---- graphs --------------------------------------------------------------

_CC_EDGES = " union all ".join(f"select sample, id a, {_back(a, 'id')} b from vox qualify a{a} >= 0.85 and b is not null" for a in "zyx")
_CLOSE = """rec as (select sample, a, b from ed union select sample, b, a from ed),
reach as (select sample, a, b from rec union select r.sample, r.a, e.b from reach r join rec e on e.sample = r.sample and e.a = r.b)"""


def _components_sql(edges: str, then: str) -> str:
    view = VOX_SQL.replace("with src", "with recursive src", 1)
    return view + f", ed as ({edges}), " + _CLOSE + ", cc as (select sample, a, least(a, min(b)) c from reach group by sample, a), part as (select v.*, coalesce(c, id) component from vox v left join cc on cc.sample = v.sample and cc.a = v.id) " + then


@query()
def connected_components(vox):
    return graph.affinity_components(vox, 0.85).select("sample", "id", "component")


ORACLE_SQL["connected_components"] = _components_sql(_CC_EDGES, "select sample, id, component from part")


@query()
def cc_min_size(vox):
    parts = graph.affinity_components(vox, 0.85)
    return graph.relabel(graph.drop_small(parts.withColumn("component", F.col("component") + 1), "component", 3, "big"), "big", "segment").select("sample", "id", "segment")


ORACLE_SQL["cc_min_size"] = _components_sql(_CC_EDGES, """, sz as (select *, case when count(*) over (partition by sample, component) < 3 then 0 else component + 1 end big from part)
select sample, id, cast(dense_rank() over (partition by sample order by big) - cast(min(big) over (partition by sample) = 0 as int) as bigint) segment from sz""")

_MASK = "(az + ay + ax) / 3 >= 0.62"


@query()
def mean_affinity_cc(vox):
    return graph.mask_components(vox, (F.col("az") + F.col("ay") + F.col("ax")) / 3 >= 0.62).select("sample", "id", "component")


ORACLE_SQL["mean_affinity_cc"] = _components_sql(
    " union all ".join(f"select v.sample, v.id a, u.id b from vox v join vox u on u.sample = v.sample and u.z = v.z + {z} and u.y = v.y + {y} and u.x = v.x + {x} where (v.az + v.ay + v.ax) / 3 >= 0.62 and (u.az + u.ay + u.ax) / 3 >= 0.62" for z, y, x in ((1, 0, 0), (0, 1, 0), (0, 0, 1))),
    f"select sample, id, case when {_MASK} then component else -1 end component from part",
)


@query()
def mask_cc_26(vox):
    return graph.mask_components(vox, (F.col("az") + F.col("ay") + F.col("ax")) / 3 >= 0.75, 26).select("sample", "id", "component")


ORACLE_SQL["mask_cc_26"] = _components_sql(
    "select v.sample, v.id a, u.id b from (select * from vox where (az + ay + ax) / 3 >= 0.75) v join (select * from vox where (az + ay + ax) / 3 >= 0.75) u on u.sample = v.sample and u.z between v.z - 1 and v.z + 1 and u.y between v.y - 1 and v.y + 1 and u.x between v.x - 1 and v.x + 1 and u.id > v.id",
    "select sample, id, case when (az + ay + ax) / 3 >= 0.75 then component else -1 end component from part",
)


@query("select sample, id, cast(dense_rank() over (partition by sample order by label) - cast(min(label) over (partition by sample) = 0 as int) as bigint) dense from vox")
def relabel(vox):
    return graph.relabel(vox, "label", "dense").select("sample", "id", "dense")


@query("select sample, z, y, x, row_number() over (partition by sample order by z, y, x) seed from vox where y % 5 = 0 and x % 5 = 0")
def grid_seeds(vox):
    return graph.grid_seeds(vox, 5)


_PAIRS = "p as (" + " union all ".join(f"select sample, {k} axis, least(s, q) lo, greatest(s, q) hi, w from (select sample, pred s, {_back(a, 'pred')} q, a{a} w from vox) where s > 0 and q > 0 and s <> q" for k, a in enumerate("zyx")) + ")"


@query(_PAIRS + " select sample, axis, lo, hi, count(*) n, round(sum(w), 6) total from p group by 1, 2, 3, 4")
def rag_pairs(vox):
    return r6(graph.boundary_pairs(vox, "pred").groupBy("sample", "axis", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total")), "total")


for _mode, _sql in (("mean", "avg(w)"), ("min", "min(w)"), ("max", "max(w)"), ("q25", "quantile_cont(w, 0.25)")):

    def _scores(vox, mode=_mode):
        return r96(graph.pair_scores(graph.boundary_pairs(vox, "pred"), mode), "score")

    _scores.__name__ = f"rag_scores_{_mode}"
    query(_PAIRS + f" select sample, lo, hi, round(round({_sql}, 9) + 5e-10::double, 6) score, count(*) n from p group by 1, 2, 3")(_scores)

_FEATURES = [f"{n}_{a}" for a in "zyx" for n in ("mean", "min", "max", "share")]


@query(_PAIRS + " select sample, lo, hi, count(*) n, " + ", ".join(f"round(round(coalesce({f}(case when axis = {k} then w end), 0), 9) + 5e-10::double, 6) {n}_{a}" for k, a in enumerate("zyx") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + ", " + ", ".join(f"round(round(count(case when axis = {k} then w end) / cast(count(*) as double), 9) + 5e-10::double, 6) share_{a}" for k, a in enumerate("zyx")) + ", round(round(ln(1 + count(*)), 9) + 5e-10::double, 6) log_n from p group by 1, 2, 3 having count(*) >= 2")
def rag_features(vox):
    return r96(graph.rag_features(graph.boundary_pairs(vox, "pred"), 2), *_FEATURES, "log_n")


_MAJORITY = "w as (select sample, pred segment, label best, count(*) n from vox where pred > 0 and label > 0 group by 1, 2, 3), mj as (select sample, segment, best, n / cast(sum(n) over (partition by sample, segment) as double) confidence from w qualify row_number() over (partition by sample, segment order by n desc, best) = 1)"


@query(_MAJORITY + " select sample, segment, best, round(confidence, 6) confidence from mj")
def rag_majority_labels(vox):
    return r6(graph.majority_labels(vox, "pred", "label"), "confidence")


@query(_MAJORITY + ", " + _PAIRS + """, e as (select distinct sample, lo, hi from p)
select e.sample, lo, hi, cast(coalesce(a.best = b.best and a.best > 0 and least(a.confidence, b.confidence) >= 0.5, false) as int) target
from e left join mj a on a.sample = e.sample and a.segment = lo left join mj b on b.sample = e.sample and b.segment = hi""")
def rag_pair_targets(vox):
    return graph.pair_targets(graph.boundary_pairs(vox, "pred"), graph.majority_labels(vox, "pred", "label"))


@query()
def agglomerate_scores(vox):
    scores = graph.rag_features(graph.boundary_pairs(vox, "pred")).select("sample", "lo", "hi", F.round(F.greatest("max_z", "max_y", "max_x"), 9).alias("score"))
    return graph.agglomerate_by_scores(vox, "pred", scores, 0.97, "segment").select("sample", "id", "segment")


_MERGED = """, cc as (select sample, a, least(a, min(b)) c from reach group by sample, a),
mg as (select v.sample, v.id, coalesce(c, pred) root from vox v left join cc on cc.sample = v.sample and cc.a = v.pred)
select sample, id, cast(dense_rank() over (partition by sample order by root) - cast(min(root) over (partition by sample) = 0 as int) as bigint) segment from mg"""
ORACLE_SQL["agglomerate_scores"] = VOX_SQL.replace("with src", "with recursive src", 1) + ", " + _PAIRS + ", ed as (select sample, lo a, hi b from p group by sample, lo, hi having round(max(w), 9) >= 0.97), " + _CLOSE + _MERGED


@query()
def agglomerate_affinity(vox):
    return graph.agglomerate(vox, "pred", 0.8, "segment", z_threshold=0.9, min_boundary=2).select("sample", "id", "segment")


ORACLE_SQL["agglomerate_affinity"] = VOX_SQL.replace("with src", "with recursive src", 1) + ", " + _PAIRS + """,
sel as (select sample, lo, hi from p group by sample, lo, hi, axis having avg(w) >= case when axis = 0 then 0.9 else 0.8 end and count(*) >= 2),
ed as (select distinct sample, lo a, hi b from sel), """ + _CLOSE + _MERGED


# ---- masks ---------------------------------------------------------------

def _patches(vox):
    p = scalar.patchify(vox, (1, 10, 10), (2, 2), "ax")
    held = F.array_compact("vals")
    return p.select("sample", "pid", (F.aggregate(held, F.lit(0.0), lambda s, v: s + v) / F.size(held)).alias("edge"))


_PATCH = "p as (select sample, (z * 2 + y // 10) * 2 + x // 10 pid, avg(ax) edge from vox group by 1, 2)"
_RANK = "md5('0:' || sample || ':' || pid), pid"


@query(_PATCH + f" select sample, pid, row_number() over (partition by sample order by {_RANK}) <= greatest(1, round_even(0.75 * count(*) over (partition by sample), 0)) masked from p")
def random_mask(vox):
    return masking.random_mask(_patches(vox), 0.75).select("sample", "pid", "masked")


_MASKED = """, w1 as (select *, least(round_even(k * f, 0), k) led, row_number() over (partition by sample order by round(edge, 9) desc, pid) r from w),
w2 as (select *, r <= led top from w1), mk as (select *, top or row_number() over (partition by sample order by top, """ + _RANK + """) <= k - led masked from w2)"""
_EDGED = _PATCH + ", w as (select *, 0.4::double f, greatest(round_even(0.5 * count(*) over (partition by sample), 0), 1) k from p)" + _MASKED


def _edged(vox):
    return masking.edge_mask(_patches(vox).withColumn("edge", F.round("edge", 9)), 0.5, 0.4)


QUERIES["edge_mask"] = lambda spark, sf_dir: _edged(demo_voxels(spark, sf_dir)).select("sample", "pid", "masked")
ORACLE_SQL["edge_mask"] = VOX_SQL + ", " + _EDGED + " select sample, pid, masked from mk"


@query(_EDGED + """, mc as (select sample, sum(cast(masked as int) * edge) / greatest(sum(edge), 1e-6) cov, avg(cast(masked as int)) ratio, avg(edge) mean, stddev_pop(edge) std, max(edge) max, min(edge) min from mk group by 1)
select sample, round(ratio, 6) ratio, round(cov, 6) coverage, round(cov - ratio, 6) gain, round(mean, 6) mean, round(std, 6) std, round(max, 6) max, round(min, 6) min from mc""")
def mask_coverage(vox):
    return r6(masking.mask_coverage(_edged(vox)), "ratio", "coverage", "gain", "mean", "std", "max", "min")


@query(_PATCH + """, w as (select *, case sample when 'A' then 0.4::double when 'B' then 0.6 else 0.2 end f,
greatest(least(round_even(case sample when 'A' then 0.75::double when 'B' then 0.5 else 0.25 end * count(*) over (partition by sample), 0), count(*) over (partition by sample) - 1), 1) k from p)""" + _MASKED + " select sample, pid, masked from mk")
def mixed_mask(vox):
    a, b = F.col("sample") == "A", F.col("sample") == "B"
    p = _patches(vox).withColumns({"edge": F.round("edge", 9), "share": F.when(a, 0.75).when(b, 0.5).otherwise(0.25), "led": F.when(a, 0.4).when(b, 0.6).otherwise(0.2)})
    return masking.mixed_mask(p, "share", "led").select("sample", "pid", "masked")


_ACTIONS = _PATCH + """, w as (select *, round(edge, 9) prob, round(edge, 9) > 0.5 act, count(*) over (partition by sample) n from p), w1 as (select *, sum(cast(act as int)) over (partition by sample) chosen from w)
select sample, pid, row_number() over (partition by sample order by act desc, prob desc, pid) <= least(greatest(chosen, greatest(1, round_even({least}::double * n, 0))), least(n - 1, round_even({most}::double * n, 0))) masked from w1"""


def _enforced(vox, least, most):
    p = _patches(vox).withColumns({"prob": F.round("edge", 9), "act": F.round("edge", 9) > 0.5})
    return masking.enforce_ratio(p, "act", "prob", least, most).select("sample", "pid", "masked")


@query(_ACTIONS.format(least=0.6, most=0.8))
def enforce_ratio(vox):
    return _enforced(vox, 0.6, 0.8)


@query(_ACTIONS.format(least=0.1, most=0.3))
def enforce_ratio_dropping(vox):
    return _enforced(vox, 0.1, 0.3)


@query("""w as (select sample, z, unnest(['0.25', '0.5', '0.75']) c, unnest([round(avg(az), 9), round(avg(ay), 9), round(avg(ax), 9)]) p from vox group by 1, 2),
m as (select sample, z, cast(c as double) v from w qualify row_number() over (partition by sample, z order by p desc, cast(c as double)) = 1)
select sample, z, v as value, case when v = 0.25 then 0 else 1 end bin from m""")
def policy_choice(vox):
    means = vox.groupBy("sample", "z").agg(*(F.round(F.avg(f"a{a}"), 9).alias(f"m{a}") for a in "zyx"))
    choices = means.select("sample", "z", F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"m{a}").alias("prob")) for v, a in ((0.25, "z"), (0.5, "y"), (0.75, "x"))))).alias("s")).select("sample", "z", "s.*")
    best = masking.most_likely(choices, ("sample", "z"))
    return best.withColumn("bin", masking.nearest_bin(F.col("value"), [0.2, 0.6]))


# ---- losses --------------------------------------------------------------

def _rows(vox):
    both = stencil.valid_edges(stencil.affinities(logits(vox)))
    return losses.long_channels(both, ("lz", "ly", "lx"), ("tz", "ty", "tx"), ("vz", "vy", "vx"))


_LONG = "w as (" + " union all ".join(f"select sample, '{a}' c, 8 * (a{a} - 0.5::double) l, cast(coalesce({_back(a, 'label')} = label and label > 0, false) as int)::double t, cast(coalesce(label <> 0 and {_back(a, 'label')} <> 0, false) as int)::double v from vox" for a in "zyx") + "), e as (select *, 1 / (1 + exp(-l)) p from w)"


@query(_LONG + " select sample, round(sum(v * (p - t) * (p - t)) / greatest(sum(v), 1), 6) loss from e group by 1")
def loss_mse(vox):
    return r6(losses.mean_loss(_rows(vox), losses.squared_error()), "loss")


_BALANCED = _LONG + """, b as (select *, least(greatest(avg(t) over (partition by sample, c), 0.05), 0.99) f from e),
b2 as (select *, (p - t) * (p - t) * case when t >= 0.5 then case when f > 0.5 then 1 else (1 - f) / f end else case when f > 0.5 then f / (1 - f) else 1 end end m from b)"""


@query(_BALANCED + " select sample, round(sum(v * m) / greatest(sum(v), 1), 6) loss from b2 group by 1")
def loss_mse_balanced(vox):
    return r6(losses.mean_loss(losses.ratio_weight(_rows(vox)), losses.squared_error() * F.col("balance")), "loss")


@query(_BALANCED + " select sample, round(sum(v * m) / greatest(count(*) / 3.0::double, 1), 6) loss from b2 group by 1")
def loss_mse_spatial(vox):
    return r6(losses.spatial_mse(_rows(vox)), "loss")


@query(_LONG + """, h as (select sample, sum(v * (greatest(l, 0) - l * t + ln(1 + exp(-abs(l))))) / greatest(sum(v), 1) a, sum(v * (p - t) * (p - t)) / greatest(sum(v), 1) b from e group by 1)
select sample, round(a + 0.5 * b, 6) loss from h""")
def loss_hybrid(vox):
    rows = _rows(vox)
    both = losses.mean_loss(rows, losses.cross_entropy(), name="a").join(losses.mean_loss(rows, losses.squared_error(), name="b"), "sample")
    return r6(both.select("sample", (F.col("a") + 0.5 * F.col("b")).alias("loss")), "loss")


@query(_LONG + """ select sample, round(sum(v * (greatest(l, 0) - l * t + ln(1 + exp(-abs(l)))) * case when t >= 0.5 then 1 else 2 end * pow(1 - (p * t + (1 - p) * (1 - t)), 2)) / greatest(sum(v), 1), 6) loss from e group by 1""")
def loss_bce_focal(vox):
    return r6(losses.mean_loss(_rows(vox), losses.cross_entropy(1.0, 2.0, 2.0)), "loss")


@query(_LONG + """ select sample, round(sum(v * (greatest(l, 0) - l * t + ln(1 + exp(-abs(l)))) * case when t > 0.5 then 1 - p else p * p end) / greatest(sum(v), 1), 6) loss from e group by 1""")
def loss_bce_two_exponents(vox):
    return r6(losses.mean_loss(_rows(vox), losses.cross_entropy(focus_positive=1.0, focus_negative=2.0)), "loss")


@query(_LONG + ", d as (select sample, c, 1 - (2 * sum((1 - p) * v * (1 - t) * v) + 1) / (sum((1 - p) * v) + sum((1 - t) * v) + 1) d from e group by 1, 2) select sample, round(avg(d), 6) loss from d group by 1")
def loss_boundary_dice(vox):
    return r6(losses.soft_dice(_rows(vox), boundary=True), "loss")


@query(_LONG + """, k as (select *, case c when 'z' then 2.0::double when 'y' then 1 else 0.5 end k from e),
mn as (select sample, sum(k * v * (greatest(l, 0) - l * t + ln(1 + exp(-abs(l)))) * case when t > 0.5 then 1 else 2 end) / greatest(sum(k * v), 1) main, avg(v) valid_fraction from k group by 1),
d as (select sample, c, any_value(k) k, 1 - (2 * sum(p * v * t * v) + 1) / (sum(p * v) + sum(t * v) + 1) d, 1 - (2 * sum((1 - p) * v * (1 - t) * v) + 1) / (sum((1 - p) * v) + sum((1 - t) * v) + 1) b,
  avg(case when t >= 0.75 and v > 0 then l end) hi, avg(case when t <= 0.25 and v > 0 then l end) lo, avg(case when v > 0 then l end) m from k group by 1, 2),
g as (select sample, sum(d * k) / greatest(sum(k), 1) dice, sum(b * k) / greatest(sum(k), 1) boundary_dice, coalesce(avg(ln(1 + exp(1 - hi + lo))), 0) rank_loss, case when count(m) = 3 then pow(avg(case when c = 'z' then m end) - avg(case when c <> 'z' then m end), 2) else 0 end calibration from d group by 1)
select sample, round(main, 6) main, round(dice, 6) dice, round(boundary_dice, 6) boundary_dice, round(rank_loss, 6) rank_loss, round(calibration, 6) calibration, round(valid_fraction, 6) valid_fraction,
  round(0.5 * main + 0.3 * dice + 0.2 * boundary_dice + 0.1 * rank_loss + 0.05 * calibration, 6) loss from mn join g using (sample)""")
def loss_objective(vox):
    out = losses.objective(_rows(vox), "bce", negative=2.0, channels=[2.0, 1.0, 0.5], main_weight=0.5, dice_weight=0.3, boundary_dice_weight=0.2, rank_weight=0.1, calibration_weight=0.05)
    return r6(out, *(c for c in out.columns if c != "sample"))


@query(_LONG + ", d as (select sample, c, 1 - (2 * sum(p * v * t * v) + 1) / (sum(p * v) + sum(t * v) + 1) d from e group by 1, 2) select sample, round(avg(d), 6) loss from d group by 1")
def loss_dice(vox):
    return r6(losses.soft_dice(_rows(vox)), "loss")


@query(_LONG + """, d as (select sample, c, avg(case when t >= 0.5 and v > 0 then l end) a, avg(case when t < 0.5 and v > 0 then l end) b, avg(case when v > 0 then l end) m from e group by 1, 2)
select sample, round(avg(ln(1 + exp(1 - a + b))), 6) rank_loss, round(case when count(m) = 3 then pow(avg(case when c = 'z' then m end) - avg(case when c <> 'z' then m end), 2) else 0 end, 6) calibration from d group by 1""")
def loss_bcar(vox):
    return r6(losses.ranking(_rows(vox)), "rank_loss", "calibration")


@query("w as (select *, " + " + ".join(_STEP.format(b=_back(a, "raw")) for a in "zyx") + """ g from vox), w1 as (select *, least(g / greatest(avg(g) over (partition by sample), 1e-6), 5) edge from w)
select sample, z, y, x, round((1 + 2 * edge) / greatest(avg(1 + 2 * edge) over (), 1e-6), 6) spatial from w1""")
def loss_membrane_weight(vox):
    return r6(losses.membrane_weight(stencil.edge_map(vox), 2.0).select(*K, "spatial"), "spatial")


@query(_PATCH.replace("avg(ax) edge", "avg((ax - ay) * (ax - ay)) err") + f""", w as (select *, row_number() over (partition by sample order by {_RANK}) <= greatest(1, round_even(0.75 * count(*) over (partition by sample), 0)) masked from p)
select sample, round(avg(err), 6) loss from w where masked group by 1""")
def loss_mae(vox):
    a, b = (scalar.patchify(vox, (1, 10, 10), (2, 2), c).withColumnRenamed("vals", c) for c in ("ax", "ay"))
    return r6(losses.reconstruction(masking.random_mask(a.join(b, ["sample", "pid"]), 0.75), "ax", "ay"), "loss")


_STEPS = "q as (select *, " + ", ".join(f"1 / (1 + exp(-8 * (a{a} - 0.5::double))) p{a}, cast(coalesce({_back(a, 'label')} = label and label > 0, false) as int)::double t{a}, cast(coalesce(label <> 0 and {_back(a, 'label')} <> 0, false) as int)::double v{a}" for a in "zyx") + " from vox), q2 as (select *, " + ", ".join(f"{_back(a, c + a)} {c}{a}0" for a in "zyx" for c in "ptv") + " from q)"


_CONNECTED = _LONG + ", " + _STEPS + """, s as (select sample, """ + ", ".join(f"sum(v{a} * v{a}0 * pow(p{a} * p{a}0 - t{a} * t{a}0, 2)) / greatest(sum(v{a} * v{a}0), 1) path{a}, sum(v{a} * v{a}0 * t{a} * t{a}0 * pow(p{a} - p{a}0, 2)) / greatest(sum(v{a} * v{a}0 * t{a} * t{a}0), 1) smooth{a}" for a in "zyx") + """ from q2 group by 1),
d as (select sample, c, avg(case when t >= 0.75 and v > 0 then l end) a, avg(case when t <= 0.25 and v > 0 then l end) b from e group by 1, 2),
k as (select sample, coalesce(avg(ln(1 + exp(0.05 - a + b))), 0) contrast from d group by 1),
r as (select sample, list_avg(list_filter([pathz, pathy, pathx], lambda x: x is not null)) path, list_avg(list_filter([smoothz, smoothy, smoothx], lambda x: x is not null)) smooth, contrast from s join k using (sample))"""


@query(_CONNECTED + """ select sample, round(path, 6) path, round(smooth, 6) smooth, round(contrast, 6) contrast, round(path + 0.15 * smooth + 0.25 * contrast, 6) loss from r""")
def loss_connectivity(vox):
    both = stencil.valid_edges(stencil.affinities(logits(vox)))
    return r6(losses.connectivity(both, ("lz", "ly", "lx"), ("tz", "ty", "tx"), ("vz", "vy", "vx")), "path", "smooth", "contrast", "loss")


_SHAPES = "w as (select *, " + ", ".join(f"{_N.format(a=a)} n{a}" for a in "zyx") + " from vox), f as (select *, cast(label > 0 as int)::double fg, 8 * (az - 0.5::double) l, " + ", ".join(f"case when label > 0 then abs((1 - 2 / (exp(2 * g{a}) + 1)) - least(greatest(avg(n{a}) over (partition by sample, label) - n{a}, -1), 1)) else 0 end d{a}" for a in "zyx").replace("gz", "(8 * (ay - 0.5::double))").replace("gy", "(8 * (ax - 0.5::double))").replace("gx", "(8 * (az - 0.5::double))") + """ from w),
h as (select sample, avg(greatest(l, 0) - l * fg + ln(1 + exp(-abs(l)))) fg_loss, sum(""" + " + ".join(f"case when d{a} < 1 then 0.5 * d{a} * d{a} else d{a} - 0.5 end" for a in "zyx") + """) / (greatest(sum(fg), 1) * 3) offset_loss from f group by 1)"""


@query(_SHAPES + """ select sample, round(fg_loss, 6) fg_loss, round(offset_loss, 6) offset_loss, round(0.25 * fg_loss + offset_loss, 6) loss from h""")
def loss_lsd(vox):
    return r6(losses.shape_loss(stencil.shape_descriptors(logits(vox)), ("lz", "ly", "lx", "lz")), "fg_loss", "offset_loss", "loss")


_EDGES = "w as (select *, " + " + ".join(_STEP.format(b=_back(a, "raw")) for a in "zyx") + " g, " + ", ".join(f"8 * (a{a} - 0.5::double) l{a}, cast(coalesce({_back(a, 'label')} = label and label > 0, false) as int)::double t{a}, cast(coalesce(label <> 0 and {_back(a, 'label')} <> 0, false) as int)::double v{a}" for a in "zyx") + """ from vox),
w1 as (select *, 1 + 2 * least(g / greatest(avg(g) over (partition by sample), 1e-6), 5) rawer, vz + vy + vx nv from w),
w2 as (select *, rawer / greatest(sum(rawer * nv) over (partition by sample) / greatest(sum(nv) over (partition by sample), 1), 1e-6) sp from w1),
e as (""" + " union all ".join(f"select sample, '{a}' c, l{a} l, t{a} t, v{a} v, sp, 1 / (1 + exp(-l{a})) p from w2" for a in "zyx") + """),
mn as (select sample, sum(v * sp * (greatest(l, 0) - l * t + ln(1 + exp(-abs(l))))) / greatest(sum(v * sp), 1) main, avg(v) valid_fraction, avg(sp) membrane_mean from e group by 1),
dc as (select sample, avg(d) dice from (select sample, c, 1 - (2 * sum(p * v * t * v) + 1) / (sum(p * v) + sum(t * v) + 1) d from e group by 1, 2) group by 1)"""


@query(f"""w0 as ({VOX_SQL}, {_CONNECTED} select sample, path + 0.15 * smooth + 0.25 * contrast connectivity from r), w3 as ({VOX_SQL}, {_SHAPES} select sample, fg_loss shape_fg, offset_loss shape_offset, 0.25 * fg_loss + offset_loss shape from h), {_EDGES}
select sample, round(main, 6) main, round(dice, 6) dice, 0.0::double boundary_dice, 0.0::double rank_loss, 0.0::double calibration, round(valid_fraction, 6) valid_fraction, round(membrane_mean, 6) membrane_mean,
  round(connectivity, 6) connectivity, round(shape_fg, 6) shape_fg, round(shape_offset, 6) shape_offset, round(shape, 6) shape, round(main + 0.4 * dice + 0.3 * connectivity + 0.5 * shape, 6) loss
from mn join dc using (sample) join w0 using (sample) join w3 using (sample)""")
def loss_finetune(vox):
    out = losses.finetune_objective(logits(vox), ("lz", "ly", "lx"), ignore=0, connectivity_weight=0.3, image="raw", membrane=2.0, shape_logits=("lz", "ly", "lx", "lz"), shape_weight=0.5, dice_weight=0.4)
    return r6(out, *(c for c in out.columns if c != "sample"))


@query(_PAIRS + """, n as (select sample, lo, hi, count(*) n from p group by 1, 2, 3), g as (select sample, count(*) pairs, avg(n) mean_faces from n group by 1), z as (select sample, count(*) voxels, count(distinct case when pred > 0 then pred end) segments from vox group by 1)
select sample, segments, coalesce(pairs, 0) pairs, round(coalesce(mean_faces, 0), 6) mean_faces, round(coalesce(pairs, 0) / (voxels / 1e6::double), 6) pairs_per_mvoxel from z left join g using (sample)""")
def rag_stats(vox):
    return r6(graph.rag_stats(vox, "pred"), "mean_faces", "pairs_per_mvoxel")


@query("""n as (select sample, ((max(z) + 1) * ((max(y) + 4) // 4) * ((max(x) + 4) // 4)) patches from vox group by 1),
d as (select sample, patches, a, patches // a rest from n, (select unnest(range(1, 1000)) a) where a < round(pow(patches, 1 / 3.0::double)) + 8 and patches % a = 0),
k as (select sample, a, rest, b from d, (select unnest(range(1, 10000)) b) where b * b <= rest and rest % b = 0), s as (select sample, a, b, list_sort([a, b, rest // b]) s from k)
select sample, s[1] d, s[2] h, s[3] w from s qualify row_number() over (partition by sample order by (s[3] - s[2]) + 2 * (s[2] - s[1]), a, b) = 1""")
def factor_grid(vox):
    patches = F.col("dz") * F.ceil(F.col("dy") / 4) * F.ceil(F.col("dx") / 4)
    return grid.factor_grid(grid.extents(vox).withColumn("patches", patches))


# ---- sweeps and manifests ------------------------------------------------

_AXES = {"threshold": [0.1, 0.25, 0.5], "seed_distance": [4, 10], "min_boundary": [1, 4], "score_mode": ["mean", "q25"]}


@query("""t as (select sample, count(*) voxels, backend from vox, (select unnest(['components', 'mean_components', 'agglomeration', 'watershed']) backend) group by sample, backend)
select sample, voxels, backend, threshold, seed_distance, min_boundary, score_mode from t,
(select unnest([0.1, 0.25, 0.5])::double threshold), (select unnest([4, 10]) seed_distance), (select unnest([1, 4]) min_boundary), (select unnest(['mean', 'q25']) score_mode)
where (seed_distance = 4 or backend = 'watershed') and (min_boundary = 1 or backend in ('agglomeration', 'watershed')) and (score_mode = 'mean' or backend in ('agglomeration', 'watershed'))""")
def sweep_grid(vox):
    return sweep.sweep_grid(vox.groupBy("sample").agg(F.count(F.lit(1)).alias("voxels")), _AXES)


@query("w as (select sample, count(*) n from vox group by 1) select sample, n from w order by sample limit 2")
def first_samples(vox):
    return sweep.first_samples(vox, 2).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


def _records(vox):
    rows = losses.long_channels(logits(vox), ("lz", "ly", "lx"), ("az", "ay", "ax"))
    each = rows.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in (0.1, 0.25, 0.5, 0.75)))))
    hit = (scalar.sigmoid(F.col("l"), None) >= F.col("threshold")).cast("double")
    return each.groupBy("sample", "c", "threshold").agg(F.round(F.avg(F.abs(hit - F.col("t"))), 9).alias("error"), F.round(F.avg(hit), 9).alias("share"))


_REC = "w as (" + " union all ".join(f"select sample, '{a}' c, a{a} t, 1 / (1 + exp(-8 * (a{a} - 0.5::double))) p from vox" for a in "zyx") + """),
rc as (select sample, c, threshold, round(avg(abs(cast(p >= threshold as int) - t)), 9) error, round(avg(cast(p >= threshold as int)), 9) share from w, (select unnest([0.1, 0.25, 0.5, 0.75])::double threshold) group by 1, 2, 3),
gm as (select c, threshold, avg(error) error, avg(share) share, count(*) n from rc group by 1, 2)"""


@query(_REC + " select c, threshold, round(error, 6) error, round(share, 6) share, n from gm")
def sweep_group_mean(vox):
    return r6(sweep.group_means(_records(vox), ["c", "threshold"], ["error", "share"], 3), "error", "share")


@query(_REC + " select threshold, round(avg(error), 6) error, count(*) n from rc group by 1")
def sweep_per_threshold(vox):
    return r6(sweep.group_means(_records(vox), ["threshold"], ["error"]), "error")


@query(_REC + ", b as (select *, case c when 'z' then 3 when 'y' then 2 else 1 end size from rc) select round(sum(error * size) / sum(size), 6) error, round(sum(share * size) / sum(size), 6) share, count(*) batches from b")
def validation_summary(vox):
    sized = _records(vox).withColumn("size", F.when(F.col("c") == "z", 3).when(F.col("c") == "y", 2).otherwise(1))
    return r6(sweep.validation_summary(sized, ["error", "share"]), "error", "share")


@query("""w as (select sample, z // 8 as chunk, count(*) voxels, round(sum(raw), 3) / 1000 as seconds from vox group by 1, 2)
select sample, count(*) chunks, round(sum(seconds), 6) as seconds, cast(sum(voxels) as bigint) voxels, cast(sum(voxels) as bigint) core_voxels, round(sum(voxels) / greatest(sum(seconds), 1e-6), 6) voxels_per_sec from w group by 1""")
def throughput(vox):
    chunks = vox.groupBy("sample", F.expr("z div 8").alias("chunk")).agg(F.count(F.lit(1)).alias("voxels"), (F.round(F.sum("raw"), 3) / 1000).alias("seconds"))
    return r6(sweep.throughput(chunks.withColumn("core_voxels", F.col("voxels")), ("sample",)), "seconds", "voxels_per_sec")


@query("""w as (select az recon, ay value, ln(ax + 0.001::double) lp, ax entropy, az - ay gain, ax / 10 pen, [az, ay] lg from vox),
r as (select *, least(greatest(-recon + 0.5 * gain - 0.2 * pen, -0.6), 0.6) rw from w), a as (select *, rw - value adv from r), n as (select *, (adv - avg(adv) over ()) / greatest(stddev_pop(adv) over (), 1e-6) ad, ln(exp(lg[1]) + exp(lg[2])) t from a)
, f as (select -avg(lp * ad) actor, avg((value - rw) * (value - rw)) critic, -avg(entropy) entropy, avg(exp(lg[1] - t) * (lg[1] - t - ln(0.25::double)) + exp(lg[2] - t) * (lg[2] - t - ln(0.75::double))) prior_kl from n)
select round(actor, 6) actor, round(critic, 6) critic, round(entropy, 6) entropy, round(prior_kl, 6) prior_kl, round(actor + 0.5 * critic + 0.01 * entropy + 0.1 * prior_kl, 6) loss from f""")
def policy_loss(vox):
    d = vox.select(F.col("az").alias("recon"), F.col("ay").alias("value"), F.ln(F.col("ax") + 0.001).alias("log_prob"), F.col("ax").alias("entropy"), (F.col("az") - F.col("ay")).alias("gain"), (F.col("ax") / 10).alias("ratio_penalty"), F.array("az", "ay").alias("logits"))
    out = losses.policy_loss(d, edge_reward=0.5, ratio_weight=0.2, clip=0.6, normalize=True, prior_weight=0.1, priors={"logits": [math.log(0.25), math.log(0.75)]})
    return r6(out, *out.columns)


@query(_REC + " select c, threshold, round(error, 6) error, n from gm order by round(error, 9), c, cast(threshold as varchar) limit 1")
def best_by_error(vox):
    groups = sweep.group_means(_records(vox), ["c", "threshold"], ["error"]).withColumn("rank_error", F.round("error", 9))
    return r6(sweep.best(groups, "rank_error", ["c", "threshold"]).drop("rank_error"), "error")


@query("select c_mktsegment as prefix, count(*) files, round(sum(c_acctbal), 4) size from customer where starts_with(c_name, 'Customer') group by 1", volume=False)
def manifest_select(spark, sf_dir):
    from lamina.sources.manifest import select_files

    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("path"), F.col("c_acctbal").alias("size"), F.col("c_mktsegment").alias("prefix"))
    return select_files(files, starts=["Customer"]).groupBy("prefix").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("size"), 4).alias("size"))


@query("select l_returnflag, round(sum(l_extendedprice * l_quantity) / greatest(sum(l_quantity), 1), 4) mean from lineitem group by 1", volume=False)
def weighted_meter(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return metrics.weighted_mean(rows, "l_extendedprice", "l_quantity", ("l_returnflag",)).withColumn("mean", F.round("mean", 4))


@query("""with n as (select n_nationkey, count(*) over () c, row_number() over (order by md5('3:' || n_nationkey), n_nationkey) r from nation)
select n_nationkey, r <= least(c - 1, greatest(1, round_even(c * 0.2, 0))) validation from n""", volume=False)
def train_val_split(spark, sf_dir):
    return sweep.split(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey"), "n_nationkey", 0.2, "3")


@query("select string_split(p_type, ' ')[1] as prefix, count(*) n from part group by 1", volume=False)
def prefix_counts(spark, sf_dir):
    from lamina.sources.manifest import prefix_counts as counts

    return counts(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_type", " ")


#: Ellipsoids of a supplier: six make a volume, from 0.
_BLOB = {"num": "s_suppkey % 6 + 1", "cz": "(s_suppkey * 5 + s_nationkey) % 8", "cy": "(s_suppkey * 7 + s_nationkey) % 16", "cx": "(s_suppkey * 11 + s_nationkey * 3) % 16", "rz": "s_nationkey % 2 + 2", "ry": "s_nationkey % 3 + 3", "rx": "s_suppkey % 3 + 3"}


@query("with b as (select s_suppkey // 6 as sample, " + ", ".join(f"{e} as {n}" for n, e in _BLOB.items()) + """ from supplier), g as (select i // 256 z, (i // 16) % 16 y, i % 16 x from range(0, 2048) t(i)),
f as (select sample, z, y, x, num, pow((z - cz) / rz::double, 2) + pow((y - cy) / ry::double, 2) + pow((x - cx) / rx::double, 2) far from b, g)
select sample, z, y, x, cast(coalesce(max(case when far < 1 then num end), 0) as bigint) "label", round(least(greatest(0.15 + 0.75 * max(exp(-2.5 * far)), 0), 1), 6) raw from f group by 1, 2, 3, 4""", volume=False)
def synthetic_em(spark, sf_dir):
    blobs = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey div 6 sample", *(f"{e} {n}" for n, e in _BLOB.items()))
    return r6(synthetic_volumes(blobs, (8, 16, 16)), "raw")


# ---- new grids, drawn edges, stored crops ----------------------------------

_KERNELS = {a: [round(((7 * i + 5 * k) % 11 - 5) / 20, 2) for i in range(27)] for k, a in enumerate("zyx")}
_PLACES = [(i // 9 - 1, i // 3 % 3 - 1, i % 3 - 1) for i in range(27)]
_AFFINE = {"z": (1.2, 0.1), "y": (0.9, -0.2), "x": (1.0, 0.05)}


@query("""w as (select sample, id, z, y, x, """ + ", ".join(f"8 * (a{a} - 0.5::double) * {s}::double + {b}::double l{a}" for a, (s, b) in _AFFINE.items()) + """ from vox),
o as (select * from (values """ + ", ".join(f"({d}, {e}, {f}, " + ", ".join(f"{_KERNELS[a][i]}::double" for a in "zyx") + ")" for i, (d, e, f) in enumerate(_PLACES)) + """) v(dz, dy, dx, kz, ky, kx)),
p as (select *, """ + ", ".join(f"1 / (1 + exp(-l{a})) p{a}" for a in "zyx") + """ from w),
m as (select a.sample, a.id, """ + ", ".join(f"any_value(a.p{a}) - sum(b.p{a}) / 27.0::double d{a}" for a in "zyx") + """ from p a cross join o join p b on b.sample = a.sample and b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx group by 1, 2),
q as (select p.*, dz, dy, dx from p join m using (sample, id)),
r as (select a.sample, a.id, """ + ", ".join(f"sum(o.k{a} * b.d{a}) r{a}" for a in "zyx") + """ from q a cross join o join q b on b.sample = a.sample and b.z = a.z + o.dz and b.y = a.y + o.dy and b.x = a.x + o.dx group by 1, 2)
select p.sample, p.z, p.y, p.x, """ + ", ".join(f"round(round(l{a} + tanh(0.4::double) * r{a}, 9) + 5e-10::double, 6) c{a}" for a in "zyx") + " from p join r using (sample, id)")
def learned_calibration(vox):
    weights = [np.array(_KERNELS[a]).reshape(3, 3, 3) for a in "zyx"]
    scale, bias = zip(*_AFFINE.values(), strict=True)
    out = blocks.learned_calibration(logits(vox), ("lz", "ly", "lx"), scale, bias, weights, 0.4, outs=("cz", "cy", "cx"))
    return r96(out.select(*K, "cz", "cy", "cx"), "cz", "cy", "cx")


_RESIZED = (9, 13, 31)


@query("t as (select sample, " + ", ".join(f"cast(max({a}) + 1 as double) d{a}" for a in "zyx") + " from vox group by 1), " + ", ".join(f"""g{a} as (select sample, o, greatest((o + 0.5::double) * d{a} / {n} - 0.5::double, 0) pos, d{a} d from t, (select unnest(range(0, {n})) o)),
e{a} as (select sample, o, cast(floor(pos) as bigint) i, 1 - (pos - floor(pos)) w from g{a} union all select sample, o, cast(least(floor(pos) + 1, d - 1) as bigint), pos - floor(pos) from g{a})""" for a, n in zip("zyx", _RESIZED, strict=True)) + """
select v.sample, ez.o z, ey.o y, ex.o x, round(round(sum(raw * ez.w * ey.w * ex.w), 9) + 5e-10::double, 6) raw
from ez join ey using (sample) join ex using (sample) join vox v on v.sample = ez.sample and v.z = ez.i and v.y = ey.i and v.x = ex.i where ez.w * ey.w * ex.w > 0 group by 1, 2, 3, 4""")
def resize_trilinear(vox):
    return r96(blocks.resize(vox, _RESIZED), "raw")


_DRAWN = 40


@query(_LONG.replace("select sample, '", "select sample, id, '") + f""", d as (select *, case when t >= 0.75 and v > 0 then 1 when t <= 0.25 and v > 0 then 0 end side from e),
k as (select * from d where side is not null qualify row_number() over (partition by sample, c, side order by substr(md5('5:' || c || ':' || id), 1, 13)) <= {_DRAWN}),
g as (select sample, c, ln(1 + exp(1 - avg(case when side = 1 then l end) + avg(case when side = 0 then l end))) soft from k group by 1, 2),
m as (select sample, c, avg(case when v > 0 then l end) m from e group by 1, 2)
select sample, round(coalesce(avg(soft), 0), 6) rank_loss, round(case when count(m) = 3 then pow(avg(case when c = 'z' then m end) - avg(case when c <> 'z' then m end), 2) else 0 end, 6) calibration from m left join g using (sample, c) group by 1""")
def loss_bcar_drawn(vox):
    # Written, as each pass of the draw reads the edges anew.
    both = cut(blocks.edge_targets(logits(vox).select(*K, "id", "label", "lz", "ly", "lx"), ignore=0).drop("label", *K[1:]))
    rows = losses.long_channels(both, ("lz", "ly", "lx"), ("t0", "t1", "t2"), ("v0", "v1", "v2"), keep=("sample", "id"))
    return r6(losses.ranking(rows, most=_DRAWN, keys=("id",), seed="5"), "rank_loss", "calibration")


_CROP, _BLOCK = (6, 12, 24), (4, 8, 8)


def crops_of(vox, every: int = 2):
    """(index, sample, z0, y0, x0): a crop for every second slice, its corner drawn by a hash."""
    dims = grid.extents(vox)
    plan = vox.select("sample", "z").distinct().where(F.col("z") % every == 0).join(F.broadcast(dims), "sample").withColumn("index", F.concat_ws(":", "sample", F.col("z").cast("string")))
    draw = lambda a: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("9"), F.lit(a), F.col("index")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return plan.select("index", "sample", *((draw(a) % (F.greatest(F.col(f"d{a}") - n, F.lit(0)) + 1)).alias(f"{a}0") for a, n in zip("zyx", _CROP, strict=True)))


def _filled(a: str, n: int) -> str:
    return f"""i{a} as (select index, sample, p, n{a} n, z0, y0, x0, {a}0 + case when {{edge}} or n{a} = {n} then least(p, n{a} - 1) when p % (2 * (n{a} - 1)) < n{a} then p % (2 * (n{a} - 1)) else 2 * (n{a} - 1) - p % (2 * (n{a} - 1)) end {a} from c, (select unnest(range(0, {n})) p))"""


def _stored_sql(name: str, edge: str) -> str:
    grown = ", ".join(_filled(a, n).replace("{edge}", edge).replace(f"i{a} as", f"{name}{a} as") for a, n in zip("zyx", _CROP, strict=True))
    return grown + f""", {name} as (select u.index, u.p z, v.p y, w.p x, {"label" if edge == "true" else "raw"} from {name}z u join {name}y v using (index) join {name}x w using (index) join vox on vox.sample = u.sample and vox.z = u.z and vox.y = v.y and vox.x = w.x)"""


@query("""t as (select sample, max(z) + 1 dz, max(y) + 1 dy, max(x) + 1 dx from vox group by 1),
q as (select distinct sample, z, sample || ':' || z as index from vox where z % 2 = 0),
a as (select q.index, sample, dz, dy, dx, """ + ", ".join(f"cast(('0x' || substr(md5('9:{a}:' || q.index), 1, 8)) as bigint) % (greatest(d{a} - {n}, 0) + 1) {a}0" for a, n in zip("zyx", _CROP, strict=True)) + """ from q join t using (sample)),
c as (select index, sample, z0, y0, x0, """ + ", ".join(f"least({n}, d{a} - {a}0) n{a}" for a, n in zip("zyx", _CROP, strict=True)) + " from a), " + _stored_sql("r", "least(nz, ny, nx) < 2") + ", " + _stored_sql("s", "true") + """
select index, z, y, x, raw, label from r join s using (index, z, y, x)""", volume=True)
def stored_crops(vox):
    from lamina.session import checkpoint_folder
    from lamina.sources import volumes

    path = f"{checkpoint_folder(vox.sparkSession).rstrip('/')}/lamina-blocks-{uuid.uuid4().hex}"
    volumes.write_blocks(vox.select(*K, "raw", "label"), path, _BLOCK)
    return volumes.read_crops(vox.sparkSession, path, crops_of(vox), _CROP, _BLOCK).select("index", "z", "y", "x", "raw", "label")


# ---- kernels: no SQL form; tests hold their invariants -------------------

@query()
def watershed_fragments(vox):
    from lamina.operators.kernels import watershed_fragments as fragments

    return fragments(vox, distance=5).select("sample", "id", "fragment")


@query()
def watershed_agglomeration(vox):
    from lamina.operators.kernels import watershed_fragments as fragments

    made = cut(fragments(vox, distance=5).select(*K, "id", "fragment", "az", "ay", "ax"))
    return graph.agglomerate(made, "fragment", 0.6, "segment", min_boundary=2).select("sample", "id", "segment")


@query()
def hierarchical_agglomeration(vox):
    from lamina.operators.kernels import hierarchical_agglomeration as merge

    return merge(vox, "pred", 0.4).select("sample", "id", "segment")
