"""Training losses as aggregates of (sample, channel, logit, target, valid, weight)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalar import clamp, sigmoid
from lamina.session import cut

from .masking import noise
from .quantiles import least_of
from .ranking import beside
from .stencil import AXES, before, edge_map, shape_descriptors


def long_channels(vox: DataFrame, logits: tuple[str, ...], targets: tuple[str, ...], valid: tuple[str, ...] | None = None, weight: str | None = None, names: tuple[str, ...] = ("z", "y", "x"), keep: tuple[str, ...] = ("sample",)) -> DataFrame:
    """One row a voxel and channel: c, l, t, v (counts or not), s (spatial weight)."""
    one = F.lit(1.0)
    rows = [F.struct(F.lit(n).alias("c"), F.col(a).cast("double").alias("l"), F.col(b).cast("double").alias("t"), (F.col(valid[i]).cast("double") if valid else one).alias("v"), (F.col(weight) if weight else one).alias("s")) for i, (n, a, b) in enumerate(zip(names, logits, targets, strict=True))]
    return vox.select(*keep, F.explode(F.array(*rows)).alias("__r")).select(*keep, "__r.*")


def channel_names(n: int) -> tuple[str, ...]:
    """z, y, x, then numbers: the first three are the axes in the losses that tell them apart."""
    return (*AXES, *(str(i) for i in range(3, n)))[:n]


def ratio_weight(rows: DataFrame, by: tuple[str, ...] = ("sample", "c"), alpha: float = 1.0, out: str = "balance") -> DataFrame:
    """Adds ``out``: the rarer class of a channel weighs more; the commoner keeps 1.

    A target above 0.5 is of the positive class.
    """
    rows = beside(rows, by, __share=F.avg((F.col("t") > 0.5).cast("double")))
    p = clamp(F.col("__share"), 0.05, 0.99)
    positive = F.when(p > 0.5, 1.0).otherwise(alpha * (1 - p) / p)
    negative = F.when(p > 0.5, alpha * p / (1 - p)).otherwise(1.0)
    return rows.withColumn(out, F.when(F.col("t") > 0.5, positive).otherwise(negative)).drop("__share")


def per_channel(value: float | list[float], names: tuple[str, ...] = ("z", "y", "x"), name: str = "value") -> Column:
    """One number for all channels, or a list with one for each."""
    if not isinstance(value, list | tuple):
        return F.lit(float(value))
    if len(value) != len(names):
        raise ValueError(f"{name} must have {len(names)} values, got {value}")
    out = F.lit(None).cast("double")
    for n, v in zip(names, value, strict=True):
        out = F.when(F.col("c") == n, float(v)).otherwise(out)
    return out


def mean_loss(rows: DataFrame, loss: Column, weight: Column | None = None, by: tuple[str, ...] = ("sample",), name: str = "loss") -> DataFrame:
    """Sum of loss x weight over the sum of weights, 1 at least."""
    w = F.col("v") * F.col("s") * (weight if weight is not None else F.lit(1.0))
    each = rows.withColumns({"__l": loss, "__w": w})
    return each.groupBy(*by).agg((F.sum(F.col("__l") * F.col("__w")) / F.greatest(F.sum("__w"), F.lit(1.0))).alias(name))


def squared_error() -> Column:
    return F.pow(sigmoid(F.col("l"), None) - F.col("t"), F.lit(2.0))


def cross_entropy(positive: float | Column = 1.0, negative: float | Column = 1.0, focus: float = 0.0, focus_positive: float | None = None, focus_negative: float | None = None) -> Column:
    """From logits, in the form that cannot overflow; ``focus`` dims the sure ones.

    Each class may have an exponent of its own; a probability counts as 0.0001 at least.
    """
    l, t = F.col("l"), F.col("t")
    bce = F.greatest(l, F.lit(0.0)) - l * t + F.log1p(F.exp(-F.abs(l)))
    up, down = (focus if f is None else f for f in (focus_positive, focus_negative))
    bce = bce * F.when(t > 0.5, positive).otherwise(negative)
    if max(up, down) <= 0:
        return bce
    p = sigmoid(l, None)
    dim = [F.pow(1 - clamp(sure, 1e-4, 1.0), F.lit(float(f))) for sure, f in ((p, up), (1 - p, down))]
    return bce * F.when(t > 0.5, dim[0]).otherwise(dim[1])


def soft_dice(rows: DataFrame, smooth: float = 1.0, boundary: bool = False, channel_weight: Column | None = None) -> DataFrame:
    """(sample, loss): 1 - soft Dice, mean over channels; of boundaries if asked."""
    p, t = sigmoid(F.col("l"), None), F.col("t")
    if boundary:
        p, t = 1 - p, 1 - t
    each = rows.withColumns({"__p": p * F.col("v"), "__t": t * F.col("v")})
    by_c = each.groupBy("sample", "c").agg((1 - (2 * F.sum(F.col("__p") * F.col("__t")) + smooth) / (F.sum("__p") + F.sum("__t") + smooth)).alias("d"))
    if channel_weight is None:
        return by_c.groupBy("sample").agg(F.avg("d").alias("loss"))
    k = channel_weight
    return by_c.groupBy("sample").agg((F.sum(F.col("d") * k) / F.greatest(F.sum(k), F.lit(1.0))).alias("loss"))


def _contrast(rows: DataFrame, margin: float) -> DataFrame:
    """(sample, c, soft, m): softplus of how little kept edges' mean logit exceeds
    cut edges' by the margin (null where either is missing); mean logit."""
    l, v = F.col("l"), F.col("v") > 0
    by_c = rows.groupBy("sample", "c").agg(F.avg(F.when((F.col("t") >= 0.75) & v, l)).alias("p"), F.avg(F.when((F.col("t") <= 0.25) & v, l)).alias("n"), F.avg(F.when(v, l)).alias("m"))
    return by_c.select("sample", "c", F.log1p(F.exp(F.lit(margin) - F.col("p") + F.col("n"))).alias("soft"), "m")


def sample_edges(rows: DataFrame, most: int, keys: tuple[str, ...], seed: str = "0", positive: float = 0.75, negative: float = 0.25) -> DataFrame:
    """Of each sample and channel at most ``most`` kept and ``most`` cut edges that count; adds ``side``.

    Those of the least hash of seed, channel and ``keys`` (which tell voxels apart) stay;
    a bound for each side is found from counts, so no side is ranked or gathered.
    """
    side = F.when((F.col("t") >= positive) & (F.col("v") > 0), 1).when((F.col("t") <= negative) & (F.col("v") > 0), 0)
    drawn = F.conv(F.substring(noise(seed, "c", *keys), 1, 13), 16, 10).cast("bigint")
    return least_of(rows.withColumn("side", side).where("side is not null"), ("sample", "c", "side"), most, drawn)


def ranking(rows: DataFrame, margin: float = 1.0, gap: float = 0.0, most: int = 0, keys: tuple[str, ...] = (), seed: str = "0") -> DataFrame:
    """(sample, rank_loss, calibration): kept edges above cut ones by a margin, and
    the z channel's mean logit ``gap`` below that of y and x if all three count.

    Means over all edges, or for the rank loss over ``most`` of each side, drawn by a
    hash of ``keys``.
    """
    z, yx = F.avg(F.when(F.col("c") == "z", F.col("m"))), F.avg(F.when(F.col("c") != "z", F.col("m")))
    apart = _contrast(rows, margin)
    if most > 0:
        drawn = _contrast(sample_edges(rows, most, keys, seed), margin).select("sample", "c", "soft")
        apart = apart.drop("soft").join(drawn, ["sample", "c"], "left")
    return apart.groupBy("sample").agg(F.coalesce(F.avg("soft"), F.lit(0.0)).alias("rank_loss"), F.when(F.count("m") == 3, F.pow(z - yx + gap, F.lit(2.0))).otherwise(0.0).alias("calibration"))


def connectivity(vox: DataFrame, logits: tuple[str, ...], targets: tuple[str, ...], valid: tuple[str, ...] | None = None, margin: float = 0.05, weights: tuple[float, float, float] = (1.0, 0.15, 0.25)) -> DataFrame:
    """(sample, path, smooth, contrast, loss): two steps along a channel's own axis
    should multiply like the targets, stay even within objects, and stand apart.

    The first three channels have the axes z, y and x; further ones only stand apart.
    """
    path = smooth = F.lit(0.0)
    cols, axes = [], F.lit(0)
    for i, a in enumerate(AXES[: len(logits)]):
        p, t = sigmoid(F.col(logits[i]), None), F.col(targets[i]).cast("double")
        m = F.col(valid[i]).cast("double") if valid else F.lit(1.0)
        names = {f"__p{a}": p, f"__t{a}": t, f"__m{a}": m}
        vox = vox.withColumns(names)
        vox = vox.withColumns({f"{n}0": before(a, n) for n in names})
        both = F.col(f"__m{a}") * F.col(f"__m{a}0")
        same = both * F.col(f"__t{a}") * F.col(f"__t{a}0")
        missed = F.pow(F.col(f"__p{a}") * F.col(f"__p{a}0") - F.col(f"__t{a}") * F.col(f"__t{a}0"), F.lit(2.0))
        uneven = F.pow(F.col(f"__p{a}0") - F.col(f"__p{a}"), F.lit(2.0))
        for n, x, w in (("path", missed, both), ("smooth", uneven, same)):
            cols.append((F.sum(x * w) / F.greatest(F.sum(w), F.lit(1.0))).alias(f"{n}_{a}"))
        path, smooth = path + F.coalesce(f"path_{a}", F.lit(0.0)), smooth + F.coalesce(f"smooth_{a}", F.lit(0.0))
        axes = axes + F.col(f"path_{a}").isNotNull().cast("int")
    sums = vox.groupBy("sample").agg(*cols).select("sample", (path / F.greatest(axes, F.lit(1))).alias("path"), (smooth / F.greatest(axes, F.lit(1))).alias("smooth"))
    apart = _contrast(long_channels(vox, logits, targets, valid, names=channel_names(len(logits))), margin).groupBy("sample").agg(F.coalesce(F.avg("soft"), F.lit(0.0)).alias("contrast"))
    total = weights[0] * F.col("path") + weights[1] * F.col("smooth") + weights[2] * F.col("contrast")
    return sums.join(apart, "sample").withColumn("loss", total)


def spatial_mse(rows: DataFrame, norm: str = "spatial", alpha: float = 1.0, channel_weight: Column | None = None) -> DataFrame:
    """(sample, loss): class-balanced squared error over the voxels, or the valid edges."""
    k = channel_weight if channel_weight is not None else F.lit(1.0)
    each = ratio_weight(rows, alpha=alpha).withColumn("__l", squared_error() * F.col("balance") * F.col("v") * F.col("s") * k)
    voxels = F.count(F.lit(1)) / F.countDistinct("c")
    base = F.sum("v") if norm == "valid" else voxels
    return each.groupBy("sample").agg((F.sum("__l") / F.greatest(base, F.lit(1.0))).alias("loss"))


def shape_loss(vox: DataFrame, logits: tuple[str, str, str, str], fg_weight: float = 0.25, offset_weight: float = 1.0) -> DataFrame:
    """(sample, fg_loss, offset_loss, loss) of shape descriptors fg, oz, oy, ox."""
    l, t = F.col(logits[0]), F.col("fg").cast("double")
    bce = F.greatest(l, F.lit(0.0)) - l * t + F.log1p(F.exp(-F.abs(l)))
    off = F.lit(0.0)
    for name, a in zip(logits[1:], AXES, strict=True):
        d = F.abs(F.tanh(F.col(name)) - F.col(f"o{a}")) * t
        off = off + F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)
    out = vox.groupBy("sample").agg(F.avg(bce).alias("fg_loss"), (F.sum(off) / (F.greatest(F.sum(t), F.lit(1.0)) * 3)).alias("offset_loss"))
    return out.withColumn("loss", fg_weight * F.col("fg_loss") + offset_weight * F.col("offset_loss"))


def policy_loss(decisions: DataFrame, value_weight: float = 0.5, entropy_weight: float = 0.01, edge_reward: float = 0.0, ratio_weight: float = 0.0, hard: bool = False, clip: float = 0.0, normalize: bool = False, prior_weight: float = 0.0, priors: dict[str, list[float]] | None = None) -> DataFrame:
    """(actor, critic, entropy, prior_kl, loss) over (recon, value, log_prob, entropy, gain, ratio_penalty).

    ``priors`` names columns that hold the logits of a choice, with the prior's log-probabilities.
    """
    reward = (F.col("recon") if hard else -F.col("recon")) + edge_reward * F.col("gain") - ratio_weight * F.col("ratio_penalty")
    if clip > 0:
        reward = clamp(reward, -clip, clip)
    each = decisions.withColumn("__r", reward).withColumn("__a", F.col("__r") - F.col("value"))
    if normalize:
        s = each.agg(F.avg("__a").alias("__m"), F.stddev_pop("__a").alias("__s"), F.count(F.lit(1)).alias("__n"))  # one row
        scaled = (F.col("__a") - F.col("__m")) / F.greatest("__s", F.lit(1e-6))
        each = each.crossJoin(s).withColumn("__a", F.when(F.col("__n") > 1, scaled).otherwise(F.col("__a")))
    kl = F.lit(0.0)
    for name, prior in (priors or {}).items() if prior_weight > 0 else ():
        kl = kl + F.avg(_divergence(F.col(name), prior))
    out = each.agg((-F.avg(F.col("log_prob") * F.col("__a"))).alias("actor"), F.avg(F.pow(F.col("value") - F.col("__r"), F.lit(2.0))).alias("critic"), (-F.avg("entropy")).alias("entropy"), kl.alias("prior_kl"))
    return out.withColumn("loss", F.col("actor") + value_weight * F.col("critic") + entropy_weight * F.col("entropy") + prior_weight * F.col("prior_kl"))


def _divergence(logits: Column, prior: list[float]) -> Column:
    """Of the softmax of ``logits`` from a prior given by its log-probabilities."""
    total = F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x)))
    parts = F.zip_with(logits, F.array(*(F.lit(float(p)) for p in prior)), lambda x, p: F.exp(x - total) * (x - total - p))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


SQUARED = ("mse", "weighted_mse", "superhuman_mse")
SPATIAL = ("superhuman_weighted_mse", "superhuman_weighted_mse_loss", "superhuman_wmse")
ENTROPY = ("bce", "weighted_bce")
HYBRID = ("bce_mse", "mse_bce", "hybrid_bce_mse", "hybrid_mse_bce", "weighted_bce_mse")
HYBRID_SPATIAL = ("bce_superhuman_mse", "hybrid_bce_superhuman_mse", "bce_shwmse")


def objective(
    rows: DataFrame, kind: str = "bce", names: tuple[str, ...] = ("z", "y", "x"), positive: float | list[float] = 1.0, negative: float | list[float] = 1.0, channels: float | list[float] = 1.0,
    focus: float = 0.0, focus_positive: float | None = None, focus_negative: float | None = None, alpha: float = 1.0, norm: str = "spatial", hybrid: tuple[float, float] = (1.0, 1.0),
    main_weight: float = 1.0, dice_weight: float = 0.0, boundary_dice_weight: float = 0.0, smooth: float = 1.0, rank_weight: float = 0.0, calibration_weight: float = 0.0, margin: float = 1.0, gap: float = 0.0,
) -> DataFrame:
    """(sample, main, dice, boundary_dice, rank_loss, calibration, valid_fraction, loss).

    ``rows`` are those of ``long_channels``; a sample is a batch.  A term of no
    weight is 0 and is not computed.
    """
    k = per_channel(channels, names, "channels")
    ends = [per_channel(v, names, n) for v, n in ((positive, "positive"), (negative, "negative"))]
    if kind in SQUARED:
        balanced = kind != "mse"
        main = mean_loss(ratio_weight(rows, alpha=alpha) if balanced else rows, squared_error() * (F.col("balance") if balanced else F.lit(1.0)), k, name="main")
    elif kind in SPATIAL:
        main = spatial_mse(rows, norm, alpha, k).withColumnRenamed("loss", "main")
    elif kind in ENTROPY:
        main = mean_loss(rows, cross_entropy(*ends, focus, focus_positive, focus_negative), k, name="main")
    elif kind in HYBRID + HYBRID_SPATIAL:
        first = mean_loss(rows.withColumn("s", F.lit(1.0)), cross_entropy(*ends), k, name="first")
        if kind in HYBRID_SPATIAL:
            second = spatial_mse(rows, norm, alpha, k).withColumnRenamed("loss", "second")
        else:
            balanced = kind == "weighted_bce_mse"
            second = mean_loss(ratio_weight(rows, alpha=alpha) if balanced else rows, squared_error() * (F.col("balance") if balanced else F.lit(1.0)), k, name="second")
        main = first.join(second, "sample").select("sample", (hybrid[0] * F.col("first") + hybrid[1] * F.col("second")).alias("main"))
    else:
        raise ValueError(f"unknown loss {kind!r}")
    out = main
    for name, weight, boundary in (("dice", dice_weight, False), ("boundary_dice", boundary_dice_weight, True)):
        out = out.join(soft_dice(rows, smooth, boundary, k).withColumnRenamed("loss", name), "sample") if weight > 0 else out.withColumn(name, F.lit(0.0))
    if rank_weight > 0 or calibration_weight > 0:
        out = out.join(ranking(rows, margin, gap), "sample")
    else:
        out = out.withColumns({"rank_loss": F.lit(0.0), "calibration": F.lit(0.0)})
    out = out.join(rows.groupBy("sample").agg(F.avg("v").alias("valid_fraction")), "sample")
    terms = (("main", main_weight), ("dice", dice_weight), ("boundary_dice", boundary_dice_weight), ("rank_loss", rank_weight), ("calibration", calibration_weight))
    return out.withColumn("loss", sum((w * F.col(n) for n, w in terms), F.lit(0.0))).select("sample", *(n for n, _ in terms), "valid_fraction", "loss")


def finetune_objective(
    vox: DataFrame, logits: tuple[str, ...], offsets: list[tuple[int, int, int]] | None = None, replicate: bool = False, ignore: int | None = None, label: str = "label",
    calibrated: tuple[str, ...] | None = None, connectivity_weight: float = 0.0, connectivity_margin: float = 0.05, connectivity_terms: tuple[float, float, float] = (1.0, 0.15, 0.25),
    image: str | None = None, membrane: float = 0.0, membrane_axes: tuple[float, float, float] = (1.0, 1.0, 1.0), membrane_clip: float = 5.0, membrane_normalize: bool = True,
    shape_logits: tuple[str, str, str, str] | None = None, shape_weight: float = 0.0, fg_weight: float = 0.25, offset_weight: float = 1.0, **objective_terms,
) -> DataFrame:
    """(sample, the columns of ``objective``, connectivity, shape_fg, shape_offset, shape, membrane_mean, loss).

    Targets come from labels, one channel for each offset (one step back on each axis if
    None); edges at an ``ignore`` label don't count, and all count if it is None.  A weight of
    connectivity above 0 has the ``calibrated`` logits supervised, where given.  The image's
    steps weigh the voxels if ``membrane`` is above 0.  ``shape_logits`` are those of
    foreground and offsets z, y, x.  A term of no weight is 0 and is not computed; a
    sample is a batch.
    """
    from .blocks import NEAREST, edge_targets

    n = len(offsets if offsets is not None else NEAREST)
    if len(logits) != n or (calibrated is not None and len(calibrated) != n):
        raise ValueError(f"{n} channels of targets, {len(logits)} of logits")
    if shape_weight > 0 and (shape_logits is None or len(shape_logits) != 4):
        raise ValueError("shape descriptors have four logits: foreground and three offsets")
    names = channel_names(n)
    targets = tuple(f"t{c}" for c in range(n))
    valid = tuple(f"v{c}" for c in range(n)) if ignore is not None else None
    weighed = image is not None and membrane > 0
    read = dict.fromkeys(("sample", *AXES, label, *logits, *(calibrated or ()), *((image,) if weighed else ())))
    # Written, as each term reads the voxels anew, and no more columns than the terms read.
    both = edge_targets(vox.select(*read), offsets, label, replicate, ignore)
    both = cut(edge_map(both, membrane_axes, membrane_clip, image, "__edge") if weighed else both)
    weight, mean = None, both.select("sample").distinct().withColumn("membrane_mean", F.lit(1.0))
    if weighed:
        counted = sum((F.col(v) for v in valid), F.lit(0)) if valid else None
        both = membrane_weight(both, membrane, "__edge", counted, "__spatial", ("sample",)) if membrane_normalize else both.withColumn("__spatial", 1 + F.lit(membrane) * F.col("__edge"))
        weight, mean = "__spatial", both.groupBy("sample").agg(F.avg("__spatial").alias("membrane_mean"))
    supervised = calibrated if calibrated is not None and connectivity_weight > 0 else logits
    out = objective(long_channels(both, supervised, targets, valid, weight, names), names=names, **objective_terms).withColumnRenamed("loss", "__loss").join(mean, "sample")
    if connectivity_weight > 0:
        term = connectivity(both, calibrated or logits, targets, valid, connectivity_margin, connectivity_terms)
        out = out.join(term.select("sample", F.col("loss").alias("connectivity")), "sample")
    if shape_weight > 0:
        term = shape_loss(shape_descriptors(vox, label), shape_logits, fg_weight, offset_weight)
        out = out.join(term.select("sample", F.col("fg_loss").alias("shape_fg"), F.col("offset_loss").alias("shape_offset"), F.col("loss").alias("shape")), "sample")
    out = out.withColumns({c: F.lit(0.0) for c in ("connectivity", "shape_fg", "shape_offset", "shape") if c not in out.columns})
    return out.withColumn("loss", F.col("__loss") + connectivity_weight * F.col("connectivity") + shape_weight * F.col("shape")).drop("__loss")


def prior_log_probs(bins: list[float], start: float | None, margin: float) -> list[float]:
    """Log-softmax with a margin at the bin nearest to ``start``."""
    raw = [0.0] * len(bins)
    if start is not None and margin > 0:
        raw[min(range(len(bins)), key=lambda i: abs(bins[i] - start))] = margin
    total = math.log(sum(map(math.exp, raw)))
    return [x - total for x in raw]


def membrane_weight(vox: DataFrame, weight: float, edge: str = "edge", valid: str | Column | None = None, out: str = "spatial", by: tuple[str, ...] = ()) -> DataFrame:
    """1 + weight x edge, over its mean where ``valid``; ``vox`` is the batch that has one
    mean, or each group of ``by`` is one.  ``valid`` may count a voxel's valid channels."""
    raw = 1 + F.lit(weight) * F.col(edge)
    v = (F.col(valid) if isinstance(valid, str) else valid).cast("double") if valid is not None else F.lit(1.0)
    mean = F.sum(raw * v) / F.greatest(F.sum(v), F.lit(1.0))
    if by:
        vox = beside(vox, by, __mean=mean)
        return vox.withColumn(out, raw / F.greatest("__mean", F.lit(1e-6))).drop("__mean")
    mean = vox.agg(mean.alias("mean")).scalar()
    return vox.withColumn(out, raw / F.greatest(F.coalesce(mean, F.lit(1e-6)), F.lit(1e-6)))


def reconstruction(patches: DataFrame, pred: str, target: str, weight: str | None = None) -> DataFrame:
    """(sample, loss): squared error of masked patches, patch by patch."""
    err = F.array_compact(F.zip_with(pred, target, lambda a, b: (a - b) * (a - b)))  # places without voxel don't count
    mean = F.aggregate(err, F.lit(0.0), lambda s, e: s + e) / F.size(err)
    w = F.col("masked").cast("double") * (F.col(weight) if weight else F.lit(1.0))
    return patches.withColumns({"__e": mean, "__w": w}).groupBy("sample").agg((F.sum(F.col("__e") * F.col("__w")) / F.greatest(F.sum("__w"), F.lit(1.0))).alias("loss"))
