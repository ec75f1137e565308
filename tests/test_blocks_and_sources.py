"""Blocks, exact quantiles, stored crops, slabs and images, beside NumPy and by hand."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import blocks, graph, kernels, losses, quantiles
from lamina.sources import arrays, volumes

from .test_operators import volume


def cube(df, shape, col):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[col]
    return out


# ---- blocks --------------------------------------------------------------


def test_learned_calibration_over_block_borders(spark):
    rng = np.random.default_rng(1)
    shape = (5, 9, 7)
    lz, lx = rng.normal(size=(2, *shape))
    w = [rng.normal(size=(3, 3, 3)) for _ in range(2)]
    vox = volume(spark, np.ones(shape, int), lz=lz, lx=lx)
    got = blocks.learned_calibration(vox, ("lz", "lx"), (1.5, 1e-9), (0.2, -0.1), w, -0.7, outs=("cz", "cx"), block=(2, 4, 3))
    assert got.columns == [*vox.columns, "cz", "cx"] and got.count() == vox.count()
    for raw, name, s, b, k in ((lz, "cz", 1.5, 0.2, w[0]), (lx, "cx", 1e-3, -0.1, w[1])):
        affine = raw * s + b
        p = np.pad(1 / (1 + np.exp(-affine)), 1)
        near = lambda a, y: a[tuple(slice(i, i + n) for i, n in zip(y, shape, strict=True))]
        d = np.pad(p[1:-1, 1:-1, 1:-1] - sum(near(p, y) for y in np.ndindex(3, 3, 3)) / 27, 1)
        want = affine + np.tanh(-0.7) * sum(k[y] * near(d, y) for y in np.ndindex(3, 3, 3))
        assert np.allclose(cube(got, shape, name), want)
    flat = blocks.learned_calibration(vox, ("lz",), (2.0,), (0.5,), (w[0],), 0.3, smooth=1)
    assert np.allclose(cube(flat, shape, "cal_lz"), 2 * lz + 0.5)
    with pytest.raises(ValueError):
        blocks.learned_calibration(vox, ("lz",), (1.0, 2.0), (0.0,), w, 0.1)


def test_boundaries_are_ignored_in_one_shuffle(spark):
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 3, (4, 10, 9))
    vox = volume(spark, labels).where("id % 11 <> 3")  # with gaps
    for xy, z in ((1, 0), (2, 1), (0, 1)):
        small, whole = (blocks.boundary_ignore(vox, xy, z, block=b) for b in ((2, 3, 4), (64, 64, 64)))
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect()))
    plan = blocks.boundary_ignore(vox)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_resizing_up_and_down(spark):
    rng = np.random.default_rng(3)
    raw = rng.random((4, 5, 3))
    vox = volume(spark, np.ones(raw.shape, int), raw=raw)

    def axis(a, k, n):
        d = a.shape[k]
        at = np.maximum((np.arange(n) + 0.5) * d / n - 0.5, 0)
        i = np.floor(at).astype(int)
        j, w = np.minimum(i + 1, d - 1), at - i
        w = w.reshape([-1 if q == k else 1 for q in range(3)])
        return np.take(a, i, k) * (1 - w) + np.take(a, j, k) * w

    for size in ((4, 5, 3), (7, 2, 10), (1, 1, 1), (2, 13, 3)):
        want = axis(axis(axis(raw, 0, size[0]), 1, size[1]), 2, size[2])
        assert np.allclose(cube(blocks.resize(vox, size), size, "raw"), want)


# ---- quantiles -----------------------------------------------------------


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"few": rng.integers(0, 4, 500).astype(float), "wide": np.r_[rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900), -1.7e308, 1.7e308], "one": np.array([3.5]), "flat": np.full(40, -2.0), "dense": 1 + rng.integers(0, 9000, 5000) * 2.0**-52}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "lo string, v double")
    levels = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    got = {r["lo"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ("lo",), "v", levels).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        ordered = np.sort(vs)
        for q, have in zip(levels, got[g], strict=True):
            at = q * (len(vs) - 1)
            i, share = int(np.floor(at)), at - np.floor(at)
            want = ordered[i] if share == 0 else ordered[i] * (1 - share) + ordered[i + 1] * share
            assert have == pytest.approx(want, rel=1e-12), (g, q)
    wanted = spark.createDataFrame([("dense", r) for r in (0, 17, 4999, 5000)], "lo string, rank bigint")
    assert {r["rank"]: r["value"] for r in quantiles.at_ranks(df, ("lo",), "v", wanted).collect()} == {r: np.sort(groups["dense"])[r] for r in (0, 17, 4999)}


def test_drawn_edges_are_the_least_hashes(spark):
    rows = spark.range(3000).selectExpr("'s' as sample", "id", "if(id % 3 = 0, 'z', 'x') as c", "cast(id % 7 as double) as l", "if(id % 2 = 0, 1.0D, 0.1D) as t", "if(id % 5 = 0, 0.0D, 1.0D) as v", "1.0D as s")
    kept = losses.sample_edges(rows, 50, ("id",), "3").select("c", "side", "id").collect()
    every = losses.sample_edges(rows, 10**6, ("id",), "3").withColumn("h", F.md5(F.concat_ws(":", F.lit("3"), "c", F.col("id").cast("string")).cast("binary"))).collect()
    for c in "zx":
        for side in (0, 1):
            mine = sorted((r["h"], r["id"]) for r in every if (r["c"], r["side"]) == (c, side))[:50]
            assert sorted(i for _, i in mine) == sorted(r["id"] for r in kept if (r["c"], r["side"]) == (c, side))
    assert losses.ranking(rows, most=10**6, keys=("id",)).first() == losses.ranking(rows).first()


def test_scores_of_pairs(spark):
    pairs = spark.createDataFrame([("s", 0, 1, 2, w) for w in (0.1, 0.4, 0.2)] + [("s", 1, 1, 3, 0.7)], "sample string, axis int, lo bigint, hi bigint, w double")
    for mode, want in (("median", 0.2), ("q75", 0.3), ("min", 0.1), ("max", 0.4), ("mean", 0.7 / 3)):
        got = {(r["lo"], r["hi"]): (r["score"], r["n"]) for r in graph.pair_scores(pairs, mode).collect()}
        assert got == {(1, 2): (pytest.approx(want), 3), (1, 3): (pytest.approx(0.7), 1)}


# ---- seeds ---------------------------------------------------------------


def test_mean_scores_do_not_depend_on_the_order_of_faces(spark):
    import itertools
    import math

    faces = [0.719, 0.881, 0.8]
    rows = [("s", 1, 2 + i, w) for i, order in enumerate(itertools.permutations(faces)) for w in order]
    table = spark.createDataFrame(rows, "sample string, lo bigint, hi bigint, w double").coalesce(1)
    assert {r["score"] for r in graph.pair_scores(table, "mean").collect()} == {math.fsum(faces) / 3}


def test_two_libraries_set_seeds_differently():
    # Inner distances: a ridge of twos and, five columns on, a one that touches nothing higher.
    b = np.ones((5, 11))
    b[1:4, 1:4] = 0
    b[2, 5] = 0
    first, second = (kernels.seeds(b, "maxima_distance", 4, 0.5, lib) for lib in ("mahotas", "scipy"))
    assert first[2, 2] == 1 and first[2, 5] == 2 and np.count_nonzero(first) == 2
    # The second looks two steps around, and the one at column 5 is three from the two.
    assert second.tolist() == first.tolist()
    b[2, 4] = 0  # now they touch: columns 4 and 5 lead up to the two
    first, second = (kernels.seeds(b, "maxima_distance", 4, 0.5, lib) for lib in ("mahotas", "scipy"))
    assert first.max() == 1
    # A level of equal distances is a maximum as a whole for the first, by its own window for the second.
    c = np.ones((3, 12))
    c[1, 1:11] = 0
    c[0:3, 6] = 0
    far = kernels.distance_to(c < 0.5)
    first, second = (kernels.seeds(c, "maxima_distance", 4, 0.5, lib) for lib in ("mahotas", "scipy"))
    assert (first > 0).tolist() == kernels.regional_minima(-far).tolist() and (second > 0).tolist() == (kernels.local_peaks(far, 2) & (far > 0)).tolist()
    # Minima: of the boundary itself, or, for the second, distances as ever.
    minima = [kernels.seeds(b, "minima", 4, 0.5, lib) for lib in ("mahotas", "scipy")]
    assert (minima[0] > 0).sum() == 11 and (minima[1] == kernels.seeds(b, "maxima_distance", 4, 0.5, "scipy")).all()
    # Nothing inside: one level is one seed for the first, the grid for the second.
    nothing = [kernels.seeds(np.ones((6, 6)), "maxima_distance", 4, 0.5, lib) for lib in ("mahotas", "scipy")]
    assert (nothing[0] == 1).all() and np.argwhere(nothing[1]).tolist() == [[0, 0], [0, 4], [4, 0], [4, 4]]
    for lib in ("mahotas", "scipy"):
        assert np.argwhere(kernels.seeds(b, "grid", 4, 0.5, lib)).tolist() == [[0, 0], [0, 4], [0, 8], [4, 0], [4, 4], [4, 8]]
    assert kernels.seeds(b, "anything", 4, 0.5, "scipy").any()
    for bad in (("anything", "mahotas"), ("grid", "other")):
        with pytest.raises(ValueError):
            kernels.seeds(b, bad[0], 4, 0.5, bad[1])


# ---- stored crops --------------------------------------------------------


def test_crops_are_read_by_block_and_filled_up(spark, tmp_path):
    rng = np.random.default_rng(5)
    shapes = {"a": (3, 7, 20), "b": (9, 16, 8), "thin": (1, 5, 9)}
    size, block = (4, 8, 16), (2, 8, 8)
    rows, kept = [], {}
    for s, shape in shapes.items():
        raw, label = rng.random(shape), rng.integers(0, 5, shape)
        kept[s] = raw, label
        rows += [(s, *map(int, at), float(raw[at]), int(label[at])) for at in np.ndindex(shape)]
    vox = spark.createDataFrame(rows, "sample string, z bigint, y bigint, x bigint, raw double, label bigint")
    path = str(tmp_path / "blocks")
    volumes.write_blocks(vox, path, block)
    plan = [("i", "a", 0, 0, 3), ("j", "b", 5, 6, 0), ("k", "thin", 0, 0, 0), ("l", "b", 5, 6, 0)]
    got = volumes.read_crops(spark, path, spark.createDataFrame(plan, "index string, sample string, z0 bigint, y0 bigint, x0 bigint"), size, block)
    rows = got.collect()
    assert len(rows) == 4 * np.prod(size)
    for index, s, z, y, x in plan:
        for col, a in zip(("raw", "label"), kept[s], strict=True):
            a = a[z : z + size[0], y : y + size[1], x : x + size[2]]
            pad = [(0, n - d) for n, d in zip(size, a.shape, strict=True)]
            want = np.pad(a, pad, mode="edge" if col == "label" or min(a.shape) < 2 else "reflect")
            have = np.zeros(size)
            for r in rows:
                if r["index"] == index:
                    have[r["z"], r["y"], r["x"]] = r[col]
            assert np.array_equal(have, want), (index, col)


def test_folders_no_crop_meets_are_pruned(spark, tmp_path):
    vox = spark.range(32 * 32).selectExpr("'s' as sample", "id div 256 as z", "(id div 16) % 16 as y", "id % 16 as x", "cast(id as double) as raw")
    path = str(tmp_path / "blocks")
    volumes.write_blocks(vox, path, (1, 4, 4))
    plan = spark.createDataFrame([("i", "s", 1, 5, 9)], "index string, sample string, z0 bigint, y0 bigint, x0 bigint")
    out = volumes.read_crops(spark, path, plan, (1, 2, 2), (1, 4, 4))
    assert sorted(r["raw"] for r in out.collect()) == [345.0, 346.0, 361.0, 362.0]
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()


def test_small_blocks_share_files(spark, tmp_path):
    vox = spark.range(40 * 400).selectExpr("'s' as sample", "id div 400 as z", "(id div 20) % 20 as y", "id % 20 as x", "cast(id as double) as raw", "id as label")
    path = tmp_path / "blocks"
    volumes.write_blocks(vox, str(path), (4, 8, 8))  # 90 blocks
    assert len(list(path.rglob("*.parquet"))) <= 8


def test_rows_that_share_a_place_meet_each_other(spark, tmp_path):
    rows = [("s", 0, 0, x, 10.0 * x + i, 10 * x + i) for x in range(3) for i in range(1 + (x == 1))]
    path = str(tmp_path / "blocks")
    volumes.write_blocks(spark.createDataFrame(rows, "sample string, z bigint, y bigint, x bigint, raw double, label bigint"), path, (1, 1, 2))
    plan = spark.createDataFrame([("i", "s", 0, 0, 0)], "index string, sample string, z0 bigint, y0 bigint, x0 bigint")
    got = volumes.read_crops(spark, path, plan, (1, 1, 4), (1, 1, 2)).collect()
    twice = [(1, float(a), b) for a in (10, 11) for b in (10, 11)]
    assert sorted((r["x"], r["raw"], r["label"]) for r in got) == [(0, 0.0, 0), *twice, (2, 20.0, 20), (3, 20.0, 20)]


# ---- slabs and images ----------------------------------------------------

OPENED = "slices.log"


class Watched:
    """A stand-in for a chunked dataset that notes which slices are read."""

    chunks = (2, 4, 4)

    def __init__(self, path, a):
        self.path, self.a, self.shape, self.dtype = path, a, a.shape, a.dtype

    def __getitem__(self, at):
        with open(f"{self.path}.{OPENED}", "a") as f:
            f.write(f"{at[0].start}:{at[1].start}-{at[1].stop}\n")
        return self.a[at]


def open_npz(path):
    with np.load(path) as f:
        return {k: Watched(path, f[k]) for k in f.files}, lambda: None


def test_slabs_read_what_a_query_asks_for(spark, tmp_path, monkeypatch):
    raw = np.arange(6 * 5 * 4).reshape(6, 5, 4)
    path = str(tmp_path / "v.npz")
    np.savez(path, raw=raw, other=np.zeros((2, 2, 2), np.uint8))
    options = {"opener": f"{__name__}:open_npz", "depth": "2"}
    df = arrays.read_slabs(spark, [path], **options).where("z >= 1 and z < 4 and y = 2")
    assert sorted((r["z"], r["y"], r["x"], r["raw"]) for r in df.collect()) == [(z, 2, x, float(raw[z, 2, x])) for z in (1, 2, 3) for x in range(4)]
    assert sorted((tmp_path / f"v.npz.{OPENED}").read_text().split()) == ["1:2-3", "2:2-3", "3:2-3"]
    assert arrays.read_slabs(spark, [path], **options).count() == raw.size
    assert arrays.read_slabs(spark, [path], **options).where("z > 99").count() == 0
    listed = {r["key"]: r for r in arrays.list_datasets(spark, [path], **options).collect()}
    assert listed["raw"]["shape"] == [6, 5, 4] and listed["other"]["dtype"] == "uint8" and listed["raw"]["chunks"] == [2, 4, 4]


def tiff(pages, order="<", packing=1, rows=2):
    """A small multipage TIFF of strips of ``rows`` rows."""
    pack = {1: bytes, 8: zlib.compress, 32773: lambda d: b"".join(bytes([0, x]) for x in d)}[packing]
    out, places = bytearray(8), []
    for p in pages:
        strips = []
        for y in range(0, p.shape[0], rows):
            strips.append((len(out), len(data := pack(p[y : y + rows].tobytes()))))
            out += data + b"\0" * (len(data) % 2)
        n = len(strips)
        tables = len(out)
        out += struct.pack(f"{order}{n}I", *(s for s, _ in strips)) + struct.pack(f"{order}{n}I", *(c for _, c in strips)) + struct.pack(f"{order}3H", 8, 8, 8) + b"\0\0"
        rgb = p.ndim == 3
        one = lambda v: struct.pack(order + "I", v)
        strip = [one(tables), one(tables + 4 * n)] if n > 1 else [one(strips[0][0]), one(strips[0][1])]
        short = lambda v: struct.pack(order + "HH", v, 0)
        tags = [(256, 4, 1, one(p.shape[1])), (257, 4, 1, one(p.shape[0])), (258, 3, 3 if rgb else 1, one(tables + 8 * n) if rgb else short(8)), (259, 3, 1, short(packing)), (262, 3, 1, short(2 if rgb else 1)), (273, 4, n, strip[0]), (277, 3, 1, short(3 if rgb else 1)), (278, 4, 1, one(rows)), (279, 4, n, strip[1])]
        places.append(len(out))
        out += struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHI", *t[:3]) + t[3] for t in tags) + bytes(4)
    out[:8] = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, places[0])
    for here, then in zip(places, places[1:], strict=False):
        (n,) = struct.unpack_from(order + "H", out, here)
        struct.pack_into(order + "I", out, here + 2 + 12 * n, then)
    return bytes(out)


def png(image, rules):
    lines, above = b"", np.zeros(image.shape[1], int)
    for row, rule in zip(image.astype(int), rules, strict=True):
        left, corner = np.r_[0, row[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, near][rule]
        lines += bytes([rule]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", *image.shape[::-1], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("order", "packing"), [("<", 1), (">", 8), ("<", 32773)])
def test_pages_of_a_tiff(spark, tmp_path, order, packing):
    rng = np.random.default_rng(6)
    pages = [rng.integers(0, 256, (5, 4), np.uint8) for _ in range(7)]
    (tmp_path / "v.tif").write_bytes(tiff(pages, order, packing))
    df = arrays.read_images(spark, str(tmp_path / "v.tif"), pages="3")
    assert df.rdd.getNumPartitions() == 3
    assert np.array_equal(cube(df, (7, 5, 4), "raw"), np.stack(pages))
    some = df.where("z = 5 and x >= 2")
    assert sorted((r["y"], r["x"], r["raw"]) for r in some.collect()) == [(y, x, float(pages[5][y, x])) for y in range(5) for x in (2, 3)]


def test_a_folder_is_a_stack_by_suffix(spark, tmp_path):
    rng = np.random.default_rng(7)
    grey = rng.integers(0, 256, (5, 6), np.uint8)
    colour = rng.integers(0, 256, (5, 6, 3), np.uint8)
    (tmp_path / "1.pgm").write_bytes(b"P5\n6 5\n255\n" + grey.tobytes())
    (tmp_path / "2.PNG").write_bytes(png(grey, (0, 1, 2, 3, 4)))
    (tmp_path / "3.tiff").write_bytes(tiff([grey, colour], rows=5))
    (tmp_path / "notes.txt").write_text("no image")
    got = cube(arrays.read_images(spark, str(tmp_path)), (4, 5, 6), "raw")
    luminance = colour @ np.array([0.299, 0.587, 0.114])
    assert np.array_equal(got[0], grey) and np.array_equal(got[1], grey) and np.array_equal(got[2], grey) and np.abs(got[3] - luminance).max() <= 1
    for bad in ("notes.txt", "absent"):
        (tmp_path / "absent").mkdir(exist_ok=True)
        with pytest.raises(Exception, match="decoder|no image"):
            arrays.read_images(spark, str(tmp_path / bad)).count()


# ---- components ----------------------------------------------------------


def test_components_across_small_blocks(spark):
    rng = np.random.default_rng(8)
    shape = (5, 8, 7)
    w = rng.random((3, *shape))
    vox = volume(spark, np.ones(shape, int), az=w[0], ay=w[1], ax=w[2]).withColumn("id", (F.col("id") * 37) % 1009 - 300).where("id % 10 <> 0")
    for run in (lambda b: graph.affinity_components(vox, 0.6, block=b), lambda b: graph.mask_components(vox, F.col("ax") > 0.88, 26, block=b), lambda b: graph.mask_components(vox, F.col("ax") > 0.6, block=b)):
        small, whole = (sorted((r["id"], r["component"]) for r in run(b).collect()) for b in ((2, 3, 2), (64, 64, 64)))
        assert small == whole and len({c for _, c in whole}) > 3
    ids = np.array([5, -3, 9, 2, 7])
    assert blocks.least_in_component(ids, np.array([0, 2, 0]), np.array([2, 4, 0])).tolist() == [5, -3, 5, 2, 5]
