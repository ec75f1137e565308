"""Invariants and hand-made cases for what SQL does not cover."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import agglomeration, blocks, graph, grid, kernels, losses, masking, metrics, stencil, sweep
from lamina.operators.components import connected_components
from lamina.sources import manifest, volumes
from lamina.sources.voxels import demo_voxels
from lamina.streaming import logs

SF = "/root/testdata/sf0.001"


def volume(spark, labels, **more):
    """Voxels of a small array [z][y][x], with further arrays as columns."""
    a = np.array(labels)
    rows = []
    for i, (z, y, x) in enumerate(np.ndindex(a.shape)):
        rows.append(("s", i, z, y, x, int(a[z, y, x]), *(float(np.array(m)[z, y, x]) for m in more.values())))
    return spark.createDataFrame(rows, "sample string, id bigint, z bigint, y bigint, x bigint, label bigint" + "".join(f", {m} double" for m in more))


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.choice("ab"), rng.randrange(300), rng.randrange(300)) for _ in range(330)]
    edges += [("a", i, i + 1) for i in range(1000, 1040)] + [("a", 7, 7), ("b", None, 3)]
    df = spark.createDataFrame(edges, "k string, src bigint, dst bigint")
    got = {(r["k"], r["id"]): r["component"] for r in connected_components(df, keys=("k",)).collect()}
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for k, a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find((k, a)), find((k, b))))
            parent[y] = x
    assert got == {v: find(v)[1] for v in list(parent)}
    none = spark.createDataFrame([], df.schema)
    assert connected_components(none, keys=("k",)).collect() == []


def test_components_of_chains_take_few_tables(spark, monkeypatch):
    from lamina.operators import components

    made = []
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: made.append(0) or cut(df))
    up = spark.range(600).selectExpr("'up' k", "id src", "id + 1 dst")
    zigzag = spark.range(600).selectExpr("'zigzag' k", "(id * 7) % 601 src", "((id + 1) * 7) % 601 dst")
    got = connected_components(up.unionAll(zigzag), keys=("k",))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 2 * 601
    assert len(made) < 40


def test_metrics_of_equal_permuted_and_empty(spark):
    vox = demo_voxels(spark, SF)
    same = metrics.segmentation_metrics(vox.withColumn("pred", F.col("label") * 7 + 1)).collect()
    assert all(r["adapted_rand_error"] == pytest.approx(0) and r["voi_sum"] == pytest.approx(0) for r in same)
    nothing = metrics.segmentation_metrics(vox.withColumn("label", F.lit(0))).collect()
    assert {tuple(r)[1:] for r in nothing} == {(1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0, 0)}
    a = {r["sample"]: r for r in metrics.segmentation_metrics(vox, "pred", "label", ignore=None).collect()}
    b = {r["sample"]: r for r in metrics.segmentation_metrics(vox, "label", "pred", ignore=None).collect()}
    for s in a:
        assert a[s]["voi_split"] == pytest.approx(b[s]["voi_merge"])
        assert a[s]["adapted_rand_error"] == pytest.approx(b[s]["adapted_rand_error"])


def test_rand_is_the_count_over_all_pairs(spark):
    vox = volume(spark, [[[1, 1, 2], [2, 2, 0], [1, 3, 3]]], p=[[[1, 1, 1], [2, 2, 2], [5, 3, 1]]])
    r = metrics.segmentation_metrics(vox, "p").first()
    kept = [(v["label"], v["p"]) for v in vox.collect() if v["label"]]
    pairs = list(itertools.combinations(kept, 2))
    both = sum(a[0] == b[0] and a[1] == b[1] for a, b in pairs)
    assert r["rand_precision"] == pytest.approx(both / sum(a[1] == b[1] for a, b in pairs))
    assert r["rand_recall"] == pytest.approx(both / sum(a[0] == b[0] for a, b in pairs))


def test_boundaries_beside_background_stay(spark):
    vox = volume(spark, [[[0, 1, 1, 2, 2]]])
    assert [r["widened"] for r in stencil.widen_boundaries(vox).orderBy("x").collect()] == [0, 1, 0, 0, 2]
    masked = [r["masked"] for r in blocks.boundary_ignore(volume(spark, [[[1, 1, 1, 2, 2, 2]]]), xy=1).orderBy("x").collect()]
    assert masked == [1, 0, 0, 0, 0, 2]
    assert blocks.boundary_ignore(vox, xy=0, z=0).where("masked <> label").count() == 0
    with pytest.raises(ValueError):
        stencil.offset_affinities(vox, [(0, 0, 0)])


def test_turns_flips_and_patches_come_back(spark):
    vox = demo_voxels(spark, SF).where("z < 2 and sample = 'A'").select("sample", "z", "y", "x", "raw")
    want = sorted(map(tuple, vox.collect()))
    assert sorted(map(tuple, scalar.rotate_xy(vox, 4, 20).select(vox.columns).collect())) == want
    turned = vox
    for _ in range(4):
        turned = scalar.rotate_xy(turned, 1, 20)
    assert sorted(map(tuple, turned.select(vox.columns).collect())) == want
    assert sorted(map(tuple, scalar.flip(scalar.flip(vox, "y", 20), "y", 20).select(vox.columns).collect())) == want
    patches = scalar.patchify(vox, (2, 4, 5), (5, 4))
    assert sorted(map(tuple, scalar.unpatchify(patches, (2, 4, 5), (5, 4)).collect())) == want


def test_normalize_leaves_flat_volumes(spark):
    flat = volume(spark, [[[1, 1]]], raw=[[[7.0, 7.0]]])
    assert {r["norm"] for r in scalar.normalize_volume(flat).collect()} == {7.0 / 255}


def test_stitching_a_constant_gives_it(spark):
    vox = demo_voxels(spark, SF).where("sample = 'A'")
    got = grid.stitch_windows(vox, {"z": 3, "y": 20, "x": 20}, (2, 8, 8), (1, 5, 5), F.lit(0.7)).collect()
    assert len(got) == vox.count() and all(r["p"] == pytest.approx(1 / (1 + np.exp(-0.7))) for r in got)


def test_window_stitch_keeps_voxels_at_any_depth(spark):
    from lamina.plans.registry import window_stitch

    vox = demo_voxels(spark, SF).where("sample = 'C'")
    shown = lambda df: sorted(map(tuple, df.drop("z").collect()))
    deep = window_stitch(vox.withColumn("z", F.col("z") + (1 << 20)))
    assert vox.count() and shown(deep) == shown(window_stitch(vox))


@pytest.fixture
def no_guess(spark):
    """No side of a join is sent to all tasks unless the code says so."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


def voxels_meet(df):
    """Whether rows are joined by a shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def test_chunks_of_a_volume_do_not_meet_in_one_task(spark, no_guess):
    assert not voxels_meet(grid.deal_to_chunks(demo_voxels(spark, SF), (8, 10, 12), (2, 3, 4)))
    assert not voxels_meet(grid.centre_crop(demo_voxels(spark, SF), {"z": 3}))
    assert not voxels_meet(blocks.resize(demo_voxels(spark, SF), (3, 3, 3)))


def test_seams_are_marked_where_voxels_lie(spark, no_guess):
    from lamina.plans.registry import QUERIES

    assert not voxels_meet(QUERIES["seam_mask"](spark, SF))


def test_figures_of_a_volume_go_to_its_voxels(spark, no_guess):
    vox = demo_voxels(spark, SF)
    rows = losses.long_channels(vox.withColumn("one", F.lit(1.0)), ("az",), ("one",), names=("z",))
    for out in (stencil.edge_map(vox), stencil.pseudo_affinity(vox), losses.ratio_weight(rows), losses.membrane_weight(vox, 2.0, "raw", by=("sample",))):
        assert not voxels_meet(out)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        empty = stencil.shape_descriptors(vox.where("sample = 'A'").withColumn("label", F.col("id") * 0))
        assert len(empty.groupBy(F.spark_partition_id()).agg(F.sum("oz")).collect()) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_drawn_edges_are_shuffled_as_blocks_once(spark, monkeypatch):
    from lamina.plans import registry

    plans = []
    monkeypatch.setattr(registry, "cut", lambda df, cut=registry.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    out = registry.QUERIES["loss_bcar_drawn"](spark, SF)
    assert [p.count("Exchange") for p in plans] == [1]
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString() and "Window" not in plans[0]


def test_padding(spark):
    row = volume(spark, [[[1, 2, 3, 4]]])
    shown = lambda df: [r["label"] for r in df.orderBy("x").collect()]
    assert shown(grid.pad(row, "x", 4, 7)) == [1, 2, 3, 4, 3, 2, 1]
    assert shown(grid.pad(row, "x", 4, 7, "edge")) == [1, 2, 3, 4, 4, 4, 4]
    with pytest.raises(ValueError):
        grid.pad(row, "x", 4, 9)
    assert grid.centre_bounds(10, 0) == (0, 10) and grid.centre_bounds(10, 4) == (3, 7)


def test_watershed_is_made_once_for_ids_and_voxels(spark):
    plan = kernels.watershed_fragments(demo_voxels(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan


def test_watershed_covers_slices(spark):
    vox = demo_voxels(spark, SF).where("sample <> 'B'")
    out = kernels.watershed_fragments(vox, distance=5)
    assert out.count() == vox.count() and out.where("fragment < 1").count() == 0
    assert out.groupBy("sample", "fragment").agg(F.countDistinct("z").alias("n")).where("n > 1").count() == 0
    ids = out.where("sample = 'A'").select("fragment").distinct().orderBy("fragment").collect()
    assert [r[0] for r in ids] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("method", ["grid", "minima", "maxima_distance"])
def test_seeds_and_distances(method):
    rng = np.random.default_rng(2)
    b = rng.random((13, 11))
    marks = kernels.seeds(b, method, 4, 0.5)
    assert marks.max() >= 1 and (kernels.flood(b, marks) > 0).all()
    mask = b < 0.6
    out = [(y, x) for y, x in zip(*np.nonzero(~mask), strict=True)]
    want = [[min(np.hypot(y - a, x - c) for a, c in out) for x in range(11)] for y in range(13)]
    assert np.allclose(kernels.distance_to(mask), want)
    assert kernels.seeds(np.ones((3, 3)), "grid", 20, 0.5).max() == 1


def test_regional_minima_by_hand():
    v = np.array([[3, 3, 3, 5, 1], [3, 2, 3, 5, 1], [5, 5, 5, 5, 5], [4, 4, 4, 4, 0]], float)
    # The level of threes touches a two, that of fours a nought; the ones are a level of their own.
    assert kernels.regional_minima(v).astype(int).tolist() == [[0, 0, 0, 0, 1], [0, 1, 0, 0, 1], [0, 0, 0, 0, 0], [0, 0, 0, 0, 1]]
    assert kernels.seeds(v, "minima", 4, 0.5).tolist() == [[0, 0, 0, 0, 1], [0, 2, 0, 0, 1], [0, 0, 0, 0, 0], [0, 0, 0, 0, 3]]
    assert kernels.regional_minima(np.ones((2, 3))).all()


def test_flooding_by_hand():
    # From the nought first, then the ones; the ridge goes to whoever reaches each place first.
    b, marks = np.array([[0.0, 9, 1], [5, 9, 1]]), np.array([[1, 0, 2], [0, 0, 0]])
    assert kernels.flood(b, marks).tolist() == [[1, 1, 2], [1, 2, 2]]


def greedy_merges(faces, threshold, score):
    """The best pair first, one at a time: a plain list of faces (a, b, w)."""
    root = {i: i for a, b, _ in faces for i in (a, b)}
    while True:
        pairs = {}
        for a, b, w in faces:
            key = tuple(sorted((root[a], root[b])))
            if key[0] != key[1]:
                pairs.setdefault(key, []).append(w)
        best = max(((score(ws), k) for k, ws in pairs.items()), default=(-1, None))
        if best[0] < 1 - threshold:
            return root
        root = {i: best[1][0] if r == best[1][1] else r for i, r in root.items()}


@pytest.mark.parametrize(("scoring", "score"), [("min", min), ("max", max), ("hist_quantile_false", lambda ws: (int(sorted(ws)[(len(ws) + 1) // 2 - 1] * 256) + 0.5) / 256)])
def test_hierarchical_agglomeration_equals_greedy(spark, scoring, score):
    rng = np.random.default_rng(8)
    label = np.arange(1, 37).reshape(6, 6).repeat(2, axis=0).repeat(2, axis=1)[None]
    # A bin of its own for each face between segments, so no two pairs tie.
    own = (rng.permutation(256)[:120].reshape(2, 5, 12) + 0.5) / 256
    w, w2 = np.zeros((2, 1, 12, 12))
    w[0, 2::2], w2[0, :, 2::2] = own[0], own[1].T
    vox = volume(spark, label, az=w * 0, ay=w, ax=w2)
    faces = [(label[0, y, x], label[0, y - d, x - e], float(v[0, y, x])) for d, e, v in ((1, 0, w), (0, 1, w2)) for y in range(d, 12) for x in range(e, 12) if label[0, y, x] != label[0, y - d, x - e]]
    want = greedy_merges(faces, 0.45, score)
    got = {r["label"]: r["segment"] for r in kernels.hierarchical_agglomeration(vox, "label", 0.45, scoring).select("label", "segment").distinct().collect()}
    dense = {r: i for i, r in enumerate(sorted(set(want.values())), 1)}
    assert 1 < len(dense) < 36 and got == {k: dense[r] for k, r in want.items()}


def test_hierarchical_agglomeration_limits(spark):
    vox = volume(spark, [[[1, 1, 2, 3]]], az=[[[0, 0, 0, 0]]], ay=[[[0, 0, 0, 0]]], ax=[[[0, 1, 0.9, 0.2]]])
    ids = lambda df: [r["segment"] for r in df.orderBy("x").collect()]
    assert ids(kernels.hierarchical_agglomeration(vox, "label", 0.3, "min")) == [1, 1, 1, 2]
    assert ids(kernels.hierarchical_agglomeration(vox, "label", 0.0, "max")) == [1, 1, 2, 3]
    assert ids(kernels.hierarchical_agglomeration(vox, "label", 0.9)) == [1, 1, 1, 1]
    with pytest.raises(ValueError):
        kernels.hierarchical_agglomeration(vox, "label", 0.5, "mean")
    with pytest.raises(ValueError):
        graph.pair_scores(graph.boundary_pairs(vox, "label"), "mode")


def test_masks_hide_the_right_number(spark):
    p = spark.range(10).select(F.lit("s").alias("sample"), F.col("id").alias("pid"), (F.col("id") / 10).alias("edge"), (F.col("id") < 3).alias("act"))
    assert masking.random_mask(p, 0.25).where("masked").count() == 2  # half to even
    assert {r["pid"] for r in masking.edge_mask(p, 0.5, 1.0).where("masked").collect()} == {5, 6, 7, 8, 9}
    assert masking.edge_mask(p, 1.0, 0.3).where("masked").count() == 10  # only the mixed mask leaves one patch
    assert masking.mixed_mask(p, 1.0, 0.3).where("masked").count() == 9
    assert {r["pid"] for r in masking.enforce_ratio(p, "act", "edge", 0.5, 0.9).where("masked").collect()} == {0, 1, 2, 9, 8}
    assert {r["pid"] for r in masking.enforce_ratio(p, "act", "edge", 0.1, 0.2).where("masked").collect()} == {1, 2}


def test_losses_of_sure_logits(spark):
    vox = volume(spark, [[[1, 1]]], l=[[[50.0, -50.0]]], t=[[[1.0, 0.0]]])
    rows = losses.long_channels(vox, ("l",), ("t",), names=("x",))
    assert losses.mean_loss(rows, losses.cross_entropy()).first()["loss"] == pytest.approx(0, abs=1e-9)
    assert losses.mean_loss(rows, losses.squared_error()).first()["loss"] == pytest.approx(0, abs=1e-9)
    assert losses.soft_dice(rows).first()["loss"] == pytest.approx(0, abs=1e-6)
    assert metrics.overlap(vox.withColumn("t", F.lit(0.0)).withColumn("l", F.lit(-9.0)), "l", "t").first()["dice"] == 1.0


def test_incomplete_groups_can_be_left_out(spark):
    rec = spark.createDataFrame([("A", 1, 0.2), ("B", 1, 0.4), ("A", 2, 0.1)], "sample string, t int, voi double")
    assert {r["t"]: r["n"] for r in sweep.group_means(rec, ["t"], ["voi"]).collect()} == {1: 2, 2: 1}
    assert [r["t"] for r in sweep.group_means(rec, ["t"], ["voi"], require_samples=2).collect()] == [1]
    assert sweep.best(rec, "voi", ["t"]).first()["t"] == 2


def test_stored_blocks_prune_and_stacks_read(spark, tmp_path):
    vox = demo_voxels(spark, SF).select("sample", "z", "y", "x", "raw")
    path = str(tmp_path / "blocks")
    volumes.write_blocks(vox, path, (2, 10, 10))
    crop = volumes.read_crop(spark, path, {"z": (1, 2), "y": (3, 12), "x": (0, 5)}, (2, 10, 10), "A")
    assert sorted(map(tuple, crop.select(vox.columns).collect())) == sorted(map(tuple, vox.where("sample = 'A' and z = 1 and y between 3 and 11 and x < 5").collect()))
    plan = crop._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bz" in plan
    images = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "stack").mkdir()
    for i, image in enumerate(images):
        (tmp_path / "stack" / f"{i}.pgm").write_bytes(b"P5\n# made\n4 3\n255\n" + image.tobytes())
    stack = volumes.read_grey_stack(spark, str(tmp_path / "stack")).orderBy("z", "y", "x").collect()
    assert [r["raw"] for r in stack] == images.ravel().tolist()
    listed = manifest.list_folder(spark, str(tmp_path / "stack"))
    assert manifest.select_files(listed, ends=".pgm").count() == 2
    assert manifest.new_files(listed, listed.limit(1)).count() == 1
    with pytest.raises(ValueError):
        manifest.pair_by_order(listed, listed.limit(1))


def test_dataset_names():
    assert volumes.choose_dataset(["a", "raw"]) == "raw"
    assert volumes.choose_dataset(["a", "b"]) == "a"
    assert volumes.choose_dataset(["a", "raw"], ("a",), strict=True) == "a"
    with pytest.raises(KeyError):
        volumes.choose_dataset(["raw"], ("a",), strict=True)


def test_prediction_by_blocks(spark):
    blocks = spark.createDataFrame([(1, [1, 2, 2], [0.0, 1.0, 2.0, 3.0])], "key int, shape array<int>, data array<double>")
    out = kernels.predict(blocks, lambda v: np.stack([v, 2 * v, -v])).first()
    assert out["logits"][1] == [0.0, 2.0, 4.0, 6.0]


def test_log_stream(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([(0, 1, 0.5, 0.7), (0, 2, 0.3, 0.8), (1, 3, 0.1, 0.9)], "epoch bigint, step bigint, loss double, mask_ratio double")
    logs.append_log(rows, folder)
    stream = logs.running_means(logs.read_log(spark, folder))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    got = {r["epoch"]: (r["loss"], r["last_step"], r["n"]) for r in spark.table("means").collect()}
    assert got == {0: (pytest.approx(0.4), 2, 2), 1: (pytest.approx(0.1), 3, 1)}


def test_segmentations_and_summaries_are_stored(spark, tmp_path):
    vox = volume(spark, [[[1, 1, 2]]]).withColumn("segment", F.col("label"))
    path = str(tmp_path / "segments")
    volumes.write_segmentation(vox, path, {"variant": "a/b", "threshold": 0.5})
    volumes.write_segmentation(vox.withColumn("segment", F.lit(7)), path, {"variant": "a/b", "threshold": 0.25})
    volumes.write_segmentation(vox.where("x < 2"), path, {"variant": "a/b", "threshold": 0.5})
    rows = spark.read.parquet(path).orderBy("threshold", "x").select("sample", "variant", "threshold", "x", "segment").collect()
    assert [tuple(r) for r in rows] == [("s", "a/b", 0.25, x, 7) for x in range(3)] + [("s", "a/b", 0.5, x, 1) for x in range(2)]
    volumes.write_summary(spark.range(1).select(F.lit(2).alias("b"), F.lit(1).alias("a")), str(tmp_path / "summary"))
    (part,) = (tmp_path / "summary").glob("part-*.json")
    assert part.read_text() == '{"a":1,"b":2}\n'


def bucket_queue(faces, least, scoring):
    """One pair at a time from the lowest of 256 levels: a plain list of every living pair."""
    begin_with_greatest, _, score = agglomeration.SCORINGS[scoring]
    pairs = {}
    for r in faces:
        hist, low, high, tie = pairs.setdefault((r["lo"], r["hi"]), [{}, 9.0, -9.0, r["tie"]])
        hist[r["bin"]] = hist.get(r["bin"], 0) + r["n"]
        pairs[r["lo"], r["hi"]] = [hist, min(low, r["least"]), max(high, r["most"]), tie]
    root = {i: i for p in pairs for i in p}
    while True:
        scores = {p: score(*v[:3]) for p, v in pairs.items()}
        passing = [(-min(255, max(0, int(s * 256))), pairs[p][3], p) for p, s in scores.items() if s >= least]
        if not passing:
            return root
        a, b = min(passing)[2]
        root = {i: a if r == b else r for i, r in root.items()}
        joined = {}
        for (lo, hi), (hist, low, high, tie) in pairs.items():
            key = tuple(sorted((a if lo == b else lo, a if hi == b else hi)))
            if key[0] == key[1]:
                continue
            if key in joined:
                h, low0, high0, tie0 = joined[key]
                joined[key] = [{k: h.get(k, 0) + hist.get(k, 0) for k in h | hist}, min(low, low0), max(high, high0), max(tie, tie0)]
            else:
                joined[key] = [hist, low, high, tie]
        pairs = joined


@pytest.mark.parametrize("scoring", sorted(agglomeration.SCORINGS))
@pytest.mark.parametrize("block", [6, 100_000])
def test_merging_in_blocks_equals_a_bucket_queue(spark, scoring, block):
    rng = np.random.default_rng(4)
    label = (np.arange(1, 65).reshape(8, 8) * 7).repeat(3, axis=0).repeat(2, axis=1)[None]
    # Few distinct affinities, so levels are full of ties; one segment touches many others.
    label[0, 10:13, :] = 5000
    w, w2 = rng.integers(0, 12, (2, *label.shape)) / 12
    vox = volume(spark, label, az=w * 0, ay=w, ax=w2).cache()
    want = bucket_queue(agglomeration.pair_faces(vox, "label", scoring == "hist_quantile").collect(), 0.55, scoring)
    got = {r["label"]: r["segment"] for r in agglomeration.hierarchical_agglomeration(vox, "label", 0.45, scoring, block=block, most=24).select("label", "segment").distinct().collect()}
    dense = {r: i for i, r in enumerate(sorted(set(want.values())), 1)}
    assert 1 < len(dense) < len(want) and got == {k: dense[r] for k, r in want.items()}


def test_histograms_may_begin_with_the_greatest(spark):
    # Two faces of a pair: 0.9 and 0.1.  With all faces the median is the lower one, with the greatest alone it is 0.9.
    vox = volume(spark, [[[1, 2], [1, 2]]], az=[[[0, 0], [0, 0]]], ay=[[[0, 0], [0, 0]]], ax=[[[0, 0.9], [0, 0.1]]])
    count = lambda how: agglomeration.hierarchical_agglomeration(vox, "label", 0.5, how).select("segment").distinct().count()
    assert (count("hist_quantile"), count("hist_quantile_false")) == (1, 2)
    # Merged pairs add up what they began with: 1-3 (0.9) and 2-3 (0.2) have the median 0.2 once 1 and 2 are one.
    vox = volume(spark, [[[1, 2], [3, 3]]], az=[[[0, 0], [0, 0]]], ay=[[[0, 0], [0.9, 0.2]]], ax=[[[0, 0.95], [0, 0]]])
    assert [r["segment"] for r in agglomeration.hierarchical_agglomeration(vox, "label", 0.5).orderBy("y", "x").collect()] == [1, 1, 2, 2]


def test_a_rising_chain_takes_few_rounds(spark):
    n = 100
    vox = volume(spark, [[list(range(1, n + 1))]], az=[[[0] * n]], ay=[[[0] * n]], ax=[[[0.2 + 0.7 * i / n for i in range(n)]]])
    rounds = []
    out = agglomeration.hierarchical_agglomeration(vox, "label", 0.9, "max", block=10, report=rounds)
    assert out.select("segment").distinct().count() == 1 and len(rounds) <= 5
