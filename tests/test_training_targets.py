"""Targets of any offsets, the composed objective, listing rules and plans, by hand or by plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import blocks, grid, losses, metrics, stencil, sweep
from lamina.sources import manifest
from lamina.sources.voxels import synthetic_volumes

OFFSETS = [(-1, 0, 0), (0, 0, -1), (0, 3, -2), (-2, 0, 4)]


@pytest.fixture(scope="module")
def labels():
    return np.random.default_rng(5).integers(0, 3, (5, 9, 11))


@pytest.fixture(scope="module")
def vox(spark, labels):
    rng = np.random.default_rng(6)
    rows = [("s", *map(int, at), int(labels[at]), float(rng.uniform()), *map(float, rng.normal(size=8))) for at in np.ndindex(labels.shape)]
    return spark.createDataFrame(rows, "sample string, z bigint, y bigint, x bigint, label bigint, raw double, " + ", ".join(f"l{i} double" for i in range(8))).cache()


def edges(labels, offset, replicate, ignore):
    """Targets and validity of one offset, place by place."""
    t, v = np.zeros(labels.shape, int), np.zeros(labels.shape, int)
    for at in np.ndindex(labels.shape):
        to = tuple(a + d for a, d in zip(at, offset, strict=True))
        if all(0 <= i < n for i, n in zip(to, labels.shape, strict=True)):
            t[at] = labels[at] == labels[to] and labels[at] > 0
            v[at] = labels[at] != ignore and labels[to] != ignore
        elif replicate and sorted(offset) == [-1, 0, 0]:
            t[at], v[at] = labels[at] > 0, labels[at] != ignore
    return t, v


@pytest.mark.parametrize("replicate", [False, True])
def test_targets_across_blocks_equal_loops_and_joins(vox, labels, replicate):
    rows = blocks.edge_targets(vox, OFFSETS, replicate=replicate, ignore=2, block=(2, 4, 4)).collect()
    assert len(rows) == labels.size
    joined = {(r["c"], r["z"], r["y"], r["x"]): r["t"] for r in stencil.offset_affinities(vox, OFFSETS, replicate=replicate).collect()}
    for c, o in enumerate(OFFSETS):
        t, v = edges(labels, o, replicate, 2)
        for r in rows:
            at = r["z"], r["y"], r["x"]
            assert (r[f"t{c}"], r[f"v{c}"]) == (t[at], v[at]) and joined[(c, *at)] == t[at]
    with pytest.raises(ValueError):
        blocks.edge_targets(vox, [(0, 0, 0)])
    assert "v0" not in blocks.edge_targets(vox).columns


def test_finetune_objective_by_hand(vox, labels):
    names = tuple(f"l{i}" for i in range(4))
    out = losses.finetune_objective(vox, names, OFFSETS, replicate=True, ignore=0, calibrated=tuple(f"l{i}" for i in range(4, 8)), connectivity_weight=0.2, kind="bce", main_weight=2.0).first()
    t, v = (np.array([edges(labels, o, True, 0)[k] for o in OFFSETS], float) for k in (0, 1))
    held = {(r["z"], r["y"], r["x"]): r for r in vox.collect()}
    l = np.array([[held[at][f"l{i}"] for at in np.ndindex(labels.shape)] for i in range(4, 8)]).reshape(t.shape)
    bce = np.maximum(l, 0) - l * t + np.log1p(np.exp(-np.abs(l)))
    main = (bce * v).sum() / v.sum()
    p, path, smooth = 1 / (1 + np.exp(-l)), [], []
    for i in range(3):
        first, then = (tuple(slice(None) if a != i else s for a in range(3)) for s in (slice(None, -1), slice(1, None)))
        m = v[i][first] * v[i][then]
        path.append((m * (p[i][first] * p[i][then] - t[i][first] * t[i][then]) ** 2).sum() / max(m.sum(), 1))
        same = m * t[i][first] * t[i][then]
        smooth.append((same * (p[i][first] - p[i][then]) ** 2).sum() / max(same.sum(), 1))
    apart = [math.log1p(math.exp(0.05 - l[i][(t[i] == 1) & (v[i] > 0)].mean() + l[i][(t[i] == 0) & (v[i] > 0)].mean())) for i in range(4)]
    connected = np.mean(path) + 0.15 * np.mean(smooth) + 0.25 * np.mean(apart)
    assert out["main"] == pytest.approx(main) and out["connectivity"] == pytest.approx(connected)
    assert out["loss"] == pytest.approx(2 * main + 0.2 * connected) and out["membrane_mean"] == 1 and out["shape"] == 0
    with pytest.raises(ValueError):
        losses.finetune_objective(vox, names[:2], OFFSETS)
    with pytest.raises(ValueError):
        losses.finetune_objective(vox, names[:3], shape_weight=1.0)


def test_finetune_objective_without_ignored_label_counts_all_and_supervises_raw_logits(vox, labels):
    out = losses.finetune_objective(vox, ("l0", "l1", "l2"), calibrated=("l3", "l4", "l5"), image="raw", membrane=3.0, membrane_normalize=False).first()
    plain = losses.objective(losses.long_channels(stencil.affinities(stencil.edge_map(vox)).withColumn("s", 1 + 3 * F.col("edge")), ("l0", "l1", "l2"), ("tz", "ty", "tx"), None, "s")).first()
    assert out["valid_fraction"] == 1 and out["main"] == pytest.approx(plain["main"]) and out["loss"] == pytest.approx(plain["loss"])
    assert out["membrane_mean"] > 1


def test_other_conventions_of_metrics(spark):
    rows = [("a", 1, 1), ("a", 1, 1), ("a", 1, 2), ("a", 2, 2), ("b", 3, 0), ("c", 1, 1), ("c", 2, 2)]
    seg = spark.createDataFrame(rows, "sample string, pred bigint, label bigint")
    own, other = ({r["sample"]: r for r in metrics.segmentation_metrics(seg, backend=b).collect()} for b in ("internal", "skimage"))
    assert (other["a"]["rand_precision"], other["a"]["rand_recall"]) == (own["a"]["rand_recall"], own["a"]["rand_precision"]) == (0.5, pytest.approx(1 / 3))
    assert other["a"]["rand_fscore"] == pytest.approx(0.4) and other["a"]["voi_sum"] == pytest.approx(own["a"]["voi_sum"])
    assert all(math.isnan(other["b"][c]) for c in ("adapted_rand_error", "rand_precision", "voi_split", "voi_merge")) and other["b"]["n_voxels"] == 0
    assert math.isnan(other["c"]["rand_fscore"]) and other["c"]["voi_sum"] == 0 and own["c"]["rand_fscore"] == 0
    with pytest.raises(ValueError):
        metrics.segmentation_metrics(seg, backend="none")


def test_folders_of_volumes(spark, tmp_path):
    tree, stack, empty = tmp_path / "tree", tmp_path / "stack", tmp_path / "none"
    for folder in (tree / "deep", stack, empty):
        folder.mkdir(parents=True)
    for p in (tree / "b.HDF", tree / "deep" / "a.h5", tree / "deep" / "sample_Z_1.hdf", tree / "note.txt", stack / "0.pgm", tree / "h5"):
        p.write_bytes(b"x")
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(manifest.volumes_in(spark, str(tree), "sample_*_1.hdf")) == ["a.h5", "b.HDF", "sample_Z_1.hdf"]  # only deeper files match
    (tree / "sample_A_1.hdf").write_bytes(b"xy")
    assert names(manifest.volumes_in(spark, str(tree), "sample_*_1.hdf")) == ["sample_A_1.hdf"]
    with pytest.raises(FileNotFoundError):
        manifest.volumes_in(spark, str(stack))
    got = manifest.expand_paths(spark, [str(stack), str(tree), str(tree / "b.HDF")])
    assert [p.rsplit("/", 1)[1] for p in got] == ["stack", "b.HDF", "a.h5", "sample_Z_1.hdf", "sample_A_1.hdf", "b.HDF"]
    manifest.write_manifest(manifest.volumes_in(spark, str(tree)), str(tmp_path / "out"))
    assert {r["size"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {1, 2}


def test_lists_are_paired_by_order_of_names(spark):
    raw = spark.createDataFrame([(f"/r/{i:02d}",) for i in range(30, 0, -1)], "path string")
    lab = spark.createDataFrame([(f"/l/{i}",) for i in range(100, 130)], "path string")
    got = dict(manifest.pair_by_order(raw, lab).collect())
    assert len(got) == 30 and all(got[f"/r/{i:02d}"] == f"/l/{99 + i}" for i in range(1, 31))


def test_plans_of_odd_volumes(spark):
    dims = spark.createDataFrame([("b", 1, 5, 5), ("a", 30, 40, 50)], "sample string, dz bigint, dy bigint, dx bigint")
    rows = sorted(grid.crop_plan(dims, 3, (8, 10, 16), 1).collect())
    assert [(r["index"], r["path"], r["sample"]) for r in rows] == [(i, i % 2, "ab"[i % 2]) for i in range(6)]
    assert all(0 <= r["z0"] <= 22 and r["y0"] <= 30 and r["x0"] <= 34 if r["sample"] == "a" else (r["z0"], r["y0"], r["x0"]) == (0, 0, 0) for r in rows)
    assert grid.crop_plan(dims.limit(0), 3, (8, 10, 16), 1).count() == 0
    n = spark.createDataFrame([("a", 960), ("b", 1), ("c", 7), ("d", 0)], "sample string, patches bigint")
    assert sorted(map(tuple, grid.factor_grid(n).collect())) == [("a", 8, 10, 12), ("b", 1, 1, 1), ("c", 1, 1, 7)]


def test_first_samples_and_splits(spark):
    rows = spark.createDataFrame([(s, i) for s in "cab" for i in range(4)], "sample string, i bigint")
    assert {r["sample"] for r in sweep.first_samples(rows, 2).collect()} == {"a", "b"} and sweep.first_samples(rows, 0).count() == 12
    held = sweep.split(spark.range(1000), "id", 0.1, "s")
    assert held.where("validation").count() == 100 and held.count() == 1000
    assert [sweep.split(spark.range(n), "id", 0.9, "s").where("validation").count() for n in (1, 2, 3)] == [0, 1, 2]


def test_later_ellipsoids_cover_earlier_ones_and_planes_are_not_shuffled_again(spark):
    blobs = spark.createDataFrame([("s", 1, 1, 2, 2, 2, 3, 3), ("s", 2, 1, 2, 3, 1, 2, 2), ("t", 5, 0, 0, 0, 1, 1, 1)], "sample string, num int, cz int, cy int, cx int, rz int, ry int, rx int")
    made = synthetic_volumes(blobs, (3, 5, 6))
    got = {(r["sample"], r["z"], r["y"], r["x"]): r for r in made.collect()}
    assert len(got) == 180
    for (s, *at), r in got.items():
        own = [b for b in blobs.collect() if b["sample"] == s]
        far = {b["num"]: sum(((p - b[f"c{a}"]) / b[f"r{a}"]) ** 2 for p, a in zip(at, "zyx", strict=True)) for b in own}
        assert r["label"] == max((n for n, f in far.items() if f < 1), default=0)
        assert r["raw"] == pytest.approx(min(1, 0.15 + 0.75 * math.exp(-2.5 * min(far.values()))))
    unrun = synthetic_volumes(blobs, (3, 5, 6))  # a plan that has run is printed twice
    assert unrun._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
