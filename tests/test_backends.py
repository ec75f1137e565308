"""Back ends by name, ranks of large groups, and rules held to small volumes worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import graph, grid, losses, masking, metrics, stencil
from lamina.operators.backends import NAMES, Backends, Point, capabilities, run_sweep
from lamina.operators.ranking import ranks


@pytest.fixture(scope="module")
def vox(spark):
    rng = np.random.default_rng(5)
    rows = [("A", z * 64 + y * 8 + x, z, y, x, int(x // 4) + 1, *map(float, rng.integers(0, 1000, 3) / 1000)) for z in range(2) for y in range(8) for x in range(8)]
    return spark.createDataFrame(rows, "sample string, id bigint, z bigint, y bigint, x bigint, label bigint, az double, ay double, ax double").cache()


def test_ranks_of_a_group_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("'g' || (id % 2) as g", "(id * 7919) % 1000 as v")
    got = {(r["g"], r["v"]): r["r"] for r in ranks(rows, ("g",), ("v",), "r").collect()}
    for g in ("g0", "g1"):
        values = sorted(v for h, v in got if h == g)
        assert [got[g, v] for v in values] == list(range(1, len(values) + 1))
    assert ranks(rows.where("v < 0"), ("g",), ("v",), "r").count() == 0


def test_every_backend_gives_dense_segments(vox):
    backends = Backends(vox)
    for name in sorted(NAMES):
        rows = backends.run(Point(name, 0.6, seed_distance=4)).select("id", "segment").collect()
        assert len({r["id"] for r in rows}) == len(rows) == 128
        ids = sorted({r["segment"] for r in rows})
        assert ids[0] in (0, 1) and ids == list(range(ids[0], ids[0] + len(ids)))
    assert {k[0] for k in backends.fragments} == {"mahotas", "scipy"} and len(backends.fragments) == 2  # made once for all that share a library


def test_failing_points_are_noted_and_the_rest_goes_on(vox):
    points = [Point("graph_cc", 0.8), Point("nowhere"), Point("waterz", 0.4, scoring="mean")]
    records, failures = run_sweep(vox, points, lambda s: metrics.segmentation_metrics(s.withColumnRenamed("segment", "pred")))
    assert [r["backend"] for r in records] == ["graph_cc"] and [f["backend"] for f in failures] == ["nowhere", "waterz"]
    with pytest.raises(ValueError):
        run_sweep(vox, points[1:2], lambda s: s, stop=True)


def test_packages_are_probed(spark):
    assert {r["package"]: r["installed"] for r in capabilities(spark, ("numpy", "no_such_package")).collect()} == {"numpy": True, "no_such_package": False}


def test_grid_begins_at_the_corner(vox):
    got = sorted((r["z"], r["y"], r["x"], r["seed"]) for r in graph.grid_seeds(vox, 5).collect())
    assert got == [(0, 0, 0, 1), (0, 0, 5, 2), (0, 5, 0, 3), (0, 5, 5, 4), (1, 0, 0, 5), (1, 0, 5, 6), (1, 5, 0, 7), (1, 5, 5, 8)]


def test_background_does_not_vote(spark):
    rows = [("A", 1, 0)] * 5 + [("A", 1, 7)] * 2 + [("A", 1, 8)] + [("A", 2, 0)] * 3 + [("A", 0, 9)]
    got = graph.majority_labels(spark.createDataFrame(rows, "sample string, pred bigint, label bigint"), "pred", "label").collect()
    assert [(r["segment"], r["best"], round(r["confidence"], 9)) for r in got] == [(1, 7, round(2 / 3, 9))]
    pairs = spark.createDataFrame([("A", 1, 2)], "sample string, lo bigint, hi bigint")
    again = graph.majority_labels(spark.createDataFrame(rows, "sample string, pred bigint, label bigint"), "pred", "label")
    assert [r["target"] for r in graph.pair_targets(pairs, again).collect()] == [0]


def test_volumes_must_match(vox):
    raw, labels = vox.select("sample", "z", "y", "x", F.col("az").alias("raw")), vox.select("sample", "z", "y", "x", "label")
    assert grid.paired_crop(raw, labels).count() == 128
    with pytest.raises(Exception, match="unlike shape"):
        grid.paired_crop(raw, labels.where("x < 7")).collect()


def test_incomplete_patches_keep_their_voxels(vox):
    patches = scalar.patchify(vox, (2, 5, 8), (2, 1), "az")
    assert patches.count() == 2
    back = scalar.unpatchify(patches, (2, 5, 8), (2, 1), "az")
    assert sorted(map(tuple, back.collect())) == sorted((r["sample"], r["z"], r["y"], r["x"], r["az"]) for r in vox.collect())
    with pytest.raises(Exception, match="beyond the grid"):
        scalar.patchify(vox, (2, 5, 4), (2, 1), "az").collect()


def test_soft_targets_above_a_half_are_positive(spark):
    rows = spark.createDataFrame([("A", "z", 0.0, t, 1.0, 1.0) for t in (0.5, 0.5, 0.6, 0.0)], "sample string, c string, l double, t double, v double, s double")
    got = sorted((r["t"], r["balance"]) for r in losses.ratio_weight(rows).collect())
    assert got == [(0.0, 1.0), (0.5, 1.0), (0.5, 1.0), (0.6, 3.0)]  # a quarter is positive: (1 - 1/4) / (1/4)
    assert losses.objective(rows, "superhuman_wmse", names=("z",)).first()["valid_fraction"] == 1.0
    for kind in losses.SQUARED + losses.SPATIAL + losses.ENTROPY + losses.HYBRID + losses.HYBRID_SPATIAL:
        assert losses.objective(rows, kind, names=("z",)).first()["loss"] > 0
    with pytest.raises(ValueError):
        losses.objective(rows, "no such loss")
    with pytest.raises(ValueError):
        losses.objective(rows, channels=[1.0, 2.0])


def test_mixed_mask_leaves_one_patch(spark):
    p = spark.createDataFrame([("A", i, i / 10) for i in range(4)], "sample string, pid bigint, edge double")
    assert masking.mixed_mask(p, 1.0, 0.5).where("masked").count() == 3
    assert masking.edge_mask(p, 1.0, 1.0).where("masked").count() == 4


def test_triplets_channels_and_noise(spark, vox):
    assert scalar.channel_triplets([1, 2, 3, 4, 5, 6]) == [(1, 2, 3), (4, 5, 6)]
    with pytest.raises(ValueError):
        scalar.channel_triplets([1, 2])
    with pytest.raises(ValueError):
        scalar.choose_channels(vox, (0, 1))
    s = spark.range(20000).select(scalar.gaussian("1", "id").alias("g")).agg(F.avg("g"), F.stddev_pop("g")).first()
    assert abs(s[0]) < 0.03 and abs(s[1] - 1) < 0.03


def test_offset_edges_count_where_both_ends_do(vox):
    got = {(r["z"], r["y"], r["x"]): r["v"] for r in stencil.offset_valid(vox.withColumn("label", F.when(F.col("x") == 3, 0).otherwise(1)), [(0, 0, -1)], replicate=True).collect()}
    assert got[0, 0, 0] == 1 and got[0, 0, 3] == 0 and got[0, 0, 4] == 0 and got[0, 0, 5] == 1


def test_small_rules_by_hand(spark, tmp_path):
    import math

    from lamina.sources import volumes

    even, led = losses.prior_log_probs([0.25, 0.5, 0.75], None, 2.0), losses.prior_log_probs([0.25, 0.5, 0.75], 0.7, 2.0)
    assert even == pytest.approx([math.log(1 / 3)] * 3) and led[2] - led[0] == pytest.approx(2) and sum(map(math.exp, led)) == pytest.approx(1)
    assert losses.prior_log_probs([0.25, 0.5], 0.3, 0.0) == pytest.approx([math.log(0.5)] * 2)
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 5.0)], "sample string, v double")
    assert sorted((r["sample"], r["scaled"]) for r in scalar.scale_01(rows, "v").collect()) == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 0.0)]
    assert [grid.crop_size(c, 8) for c in (0, -1, 5, 8, 20)] == [0, 0, 8, 8, 20]
    volumes.write_records(rows, str(tmp_path))
    assert sorted(tuple(r) for r in spark.read.option("header", "true").csv(f"{tmp_path}/csv").collect()) == [("a", "1.0"), ("a", "2.0"), ("a", "3.0"), ("b", "5.0")]
    assert spark.read.json(f"{tmp_path}/json").count() == 4
