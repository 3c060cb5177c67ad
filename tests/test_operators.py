"""Invariants, degenerate cases and brute force for operators that SQL doesn't check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.functions import geom
from geofold.operators import cluster, field, knn, mesh, ordering, quantiles, raster, runs, sampling, stats


def cloud(spark, p, first=0):
    return spark.createDataFrame([(i + first, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


@pytest.mark.parametrize("leaf", [2000, 9])
@pytest.mark.parametrize("kind", ["even", "clumped", "line", "equal", "one"])
def test_neighbours_are_exact(spark, monkeypatch, kind, leaf):
    rng = np.random.default_rng(3)
    p = {"even": rng.random((150, 3)), "clumped": np.r_[rng.normal(0, 1e-3, (100, 3)), rng.normal(50, 9, (40, 3))], "line": np.c_[rng.random(90), np.zeros((90, 2))], "equal": np.ones((30, 3)), "one": np.zeros((1, 3))}[kind]
    q = np.r_[p[:10], [[300.0, -300.0, 5.0]]]
    monkeypatch.setattr(knn, "LEAF", leaf)
    monkeypatch.setattr(knn, "PIECE", 16 if leaf < 100 else 8192)
    monkeypatch.setattr(knn, "VISITS", 2)
    got = {(r.i, r.rank): r.j for r in knn.knn(cloud(spark, p), 4, cloud(spark, q)).collect()}
    d = ((q[:, None] - p[None]) ** 2).sum(-1)
    for i in range(len(q)):
        order = sorted(range(len(p)), key=lambda j: (d[i, j], j))[:4]
        assert [got[i, r] for r in range(len(order))] == order


@pytest.mark.parametrize("kind", ["even", "clumped", "line", "copies"])
def test_neighbours_of_all_points_are_exact(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    p = {"even": rng.random((400, 3)), "clumped": np.r_[rng.normal(0, 1e-3, (300, 3)), rng.normal(50, 9, (60, 3)), [[900.0, 0, 0]]], "line": np.c_[rng.integers(0, 90, 200), np.zeros((200, 2))], "copies": np.r_[np.ones((60, 3)), rng.random((200, 3))]}[kind]
    monkeypatch.setattr(knn, "LEAF", 20)
    monkeypatch.setattr(knn, "CLOSE", 8)
    monkeypatch.setattr(knn, "NEAR_LEAVES", 5 if kind == "clumped" else 64)
    written, asked = [], []
    stash, rounds = knn.stash, knn.knn
    monkeypatch.setattr(knn, "stash", lambda df, name: written.append(name) or stash(df, name))
    monkeypatch.setattr(knn, "knn", lambda points, k, queries: asked.append(queries.count()) or rounds(points, k, queries))
    rows = knn.self_knn(cloud(spark, p).unionByName(spark.createDataFrame([(999, None, 0.0, 0.0)], "id long, x double, y double, z double")), 4)
    assert kind == "clumped" or not asked and set(written) == {"knn-leaves", "knn-needs"}  # no candidates
    got = {(r.i, r.rank): (r.j, r.d2) for r in rows.collect()}
    d = (p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2 + (p[:, None, 2] - p[None, :, 2]) ** 2
    want = {(i, r): (j, d[i, j]) for i in range(len(p)) for r, j in enumerate(np.lexsort((np.arange(len(p)), d[i]))[:4].tolist())}
    assert got == want and (kind != "clumped" or 0 < sum(asked) < len(p))


def test_neighbours_of_nothing(spark):
    assert knn.knn(cloud(spark, np.zeros((0, 3))), 3).collect() == []


def test_dbscan_against_plain_search(spark):
    rng = np.random.default_rng(5)
    p = np.r_[rng.normal(0, 0.1, (40, 3)), rng.normal(3, 0.1, (30, 3)), rng.uniform(-9, 9, (25, 3))]
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= 0.25**2
    core = near.sum(1) >= 6
    label = np.full(len(p), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = i
                    todo += [k for k in np.flatnonzero(near[j] & core) if label[k] < 0]
    for i in np.flatnonzero(~core):
        label[i] = min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)
    labels = cluster.dbscan(cloud(spark, p), 0.25, 6)
    assert {r.id: r.label for r in labels.collect()} == dict(enumerate(label.tolist()))
    noise = cluster.kept_clusters(labels.withColumn("label", F.lit(-1).cast("long")))
    assert noise.where("NOT kept").count() == 0
    assert {r.label for r in cluster.kept_clusters(labels, largest_only=True).where("kept").collect()} == {label[0]}


def test_face_components_and_fragments(spark):
    strip = [(i, i, i + 1, i + 2) for i in range(120)] + [(200 + i, 1000 + i, 1001 + i, 1002 + i) for i in range(5)] + [(300, 5000, 5001, 5002)]
    f = spark.createDataFrame(strip, "fid long, a long, b long, c long")
    got = {r.fid: r.component for r in mesh.face_components(f).collect()}
    assert {got[i] for i in range(120)} == {0} and {got[200 + i] for i in range(5)} == {200} and got[300] == 300
    s = mesh.fragment_stats(mesh.face_components(f)).first()
    assert (s.components, s.fragments, s.fragment_faces, s.faces) == (3, 2, 6, 126)


def test_point_triangle_distance_by_sampling(spark):
    rng = np.random.default_rng(7)
    t, p = rng.normal(size=(40, 3, 3)), rng.normal(size=(40, 3))
    names = [f"{k}{c}" for k in "abc" for c in "xyz"]
    rows = spark.createDataFrame([(i, *map(float, np.r_[p[i], t[i].ravel()])) for i in range(40)], "i long, " + ", ".join(f"{n} double" for n in ["x", "y", "z", *names]))
    got = {r.i: r.d for r in rows.select("i", F.sqrt(geom.point_triangle_squared(["x", "y", "z"], *([F.col(k + c) for c in "xyz"] for k in "abc"))).alias("d")).collect()}
    u = np.linspace(0, 1, 201)
    w = np.array([(a, b, 1 - a - b) for a in u for b in u if a + b <= 1])
    for i in range(40):
        dense = np.sqrt(((w @ t[i] - p[i]) ** 2).sum(1).min())
        assert got[i] <= dense + 1e-9 and dense - got[i] < 0.03


def test_rotations_keep_lengths_and_invert(spark):
    row = spark.createDataFrame([(0.3, -0.5, 0.7, 0.2)], "w double, i double, j double, k double")
    m = geom.quaternion_matrix(["w", "i", "j", "k"])
    same = geom.matmul(m, geom.transposed(m))
    r = row.select(*(same[a][b].alias(f"m{a}{b}") for a in range(3) for b in range(3)), *(v.alias(f"q{n}") for n, v in enumerate(geom.matrix_quaternion(m)))).first()
    assert np.allclose([r[f"m{a}{b}"] for a in range(3) for b in range(3)], np.eye(3).ravel())
    assert np.allclose([r[f"q{n}"] for n in range(4)], np.array([0.3, -0.5, 0.7, 0.2]) / np.linalg.norm([0.3, -0.5, 0.7, 0.2]))


def test_blending_stops_before_the_last_light(spark):
    alphas = [0.5, 0.002, 0.9, 0.99, 0.99, 0.5]
    rows = spark.createDataFrame([(0, i, a, 1.0) for i, a in enumerate(alphas)], "p int, o int, alpha double, f double")
    light, colour, n = 1.0, 0.0, 0
    for a in alphas:
        if a < 1 / 255:
            continue
        if light * (1 - a) < 1e-4:
            break
        colour, light, n = colour + a * light, light * (1 - a), n + 1
    got = raster.composited(rows, ["p"], ["o"], ["f"], background=2.0).first()
    assert got.f == pytest.approx(colour + 2 * light) and got.light == pytest.approx(light) and got.layers == n


@pytest.mark.parametrize("parts", [1, 7])
def test_tiles_are_blended_in_stretches(spark, parts):
    """A tile with most of the splats, in one stretch or in several, against blending splat by splat."""
    rng = np.random.default_rng(3)
    n = 500
    rows = [(i, float(rng.integers(0, 9)), *map(float, (rng.normal(8, 2) if i % 5 else rng.uniform(0, 40), rng.normal(8, 2) if i % 5 else rng.uniform(0, 24))), 0.4, 0.1, 0.5, float(rng.uniform(0, 0.6)), 6.0, float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, depth double, u double, v double, c0 double, c1 double, c2 double, opacity double, radius double, f double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.row, r.col): (r.f, r.depth, r.light, r.layers) for r in raster.rendered(raster.tiles(df, 40, 24), 40, 24, ["f", "depth"], background=0.5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tiled = raster.tiles(df, 40, 24).select("id", "tile").collect()
    of = {}
    for r in tiled:
        of.setdefault(r.tile, []).append(rows[r.id])
    want = {}
    for y in range(24):
        for x in range(40):
            light, out, depth, layers = 1.0, 0.0, 0.0, 0
            for _, z, u, v, c0, c1, c2, o, _, f in sorted(of.get(y // 16 * 3 + x // 16, []), key=lambda r: (r[1], r[0])):
                power = -0.5 * (c0 * (u - x) ** 2 + c2 * (v - y) ** 2) - c1 * (u - x) * (v - y)
                a = min(0.99, o * np.exp(power)) if power <= 0 else 0
                if a < 1 / 255:
                    continue
                if light * (1 - a) < 1e-4:
                    break
                out, depth, light, layers = out + f * a * light, depth + z * a * light, light * (1 - a), layers + 1
            if layers:
                want[y, x] = (out + light * 0.5, depth + light * 0.5, light, layers)
    assert got.keys() == want.keys() and min(w[2] for w in want.values()) < 2e-4
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_ssim_of_equal_and_noisy_images(spark):
    rng = np.random.default_rng(2)
    a = rng.random((16, 16))
    b = np.clip(a + rng.normal(0, 0.1, a.shape), 0, 1)
    frame = lambda v: spark.createDataFrame([(r, c, float(v[r, c])) for r in range(16) for c in range(16)], "row int, col int, value double")
    g = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    g /= g.sum()
    blur = lambda x: np.apply_along_axis(lambda r: np.convolve(r, g, "same"), 0, np.apply_along_axis(lambda r: np.convolve(r, g, "same"), 1, x))
    ma, mb = blur(a), blur(b)
    va, vb, vab = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    want = (((2 * ma * mb + 1e-4) * (2 * vab + 9e-4)) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4))).mean()
    assert raster.ssim(frame(a), frame(b), "value").first().ssim == pytest.approx(want)
    assert raster.ssim(frame(a), frame(a), "value").first().ssim == pytest.approx(1.0)


def test_numbering_and_prefix_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).cast("long").alias("v"))
    assert all(r.k == r.n for r in ordering.numbered(df, ["k"]).collect())
    assert all(r.s == 2 * (r.k + 1) for r in ordering.prefix_sum(df, ["k"], "v", "s").collect())
    assert ordering.numbered(df.limit(0), ["k"]).collect() == []


def test_samples_are_repeatable_and_in_proportion(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([0, 1, 3, 0, 6])], "id long, w double")
    a = sampling.weighted(df, ["id"], "w", 4000, seed=3)
    n = {r.id: r["count"] for r in a.groupBy("id").count().collect()}
    assert set(n) == {1, 2, 4} and sum(n.values()) == 4000 and abs(n[4] - 2400) < 150
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, sampling.weighted(df.repartition(3), ["id"], "w", 4000, seed=3).collect()))
    assert sampling.weighted(df.where("w < 0"), ["id"], "w", 5).count() == 0


def test_a_plane_has_its_gradient_everywhere(spark):
    grid = spark.createDataFrame([(0, r, c, 1.0 + 0.01 * r + 0.02 * c) for r in range(6) for c in range(6)], "img int, row int, col int, depth double")
    inner = raster.central_differences(grid, "depth", ["img"]).where("row BETWEEN 1 AND 4 AND col BETWEEN 1 AND 4").collect()
    assert all(r.d_col == pytest.approx(0.02) and r.d_row == pytest.approx(0.01) for r in inner)
    assert raster.valid_depth(grid, ["img"], 6, 6, F.lit(100.0), border=1).where("valid").count() == 16


def test_masked_mean_and_base_of_zero(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "n string, v double")
    assert stats.masked_mean(df, F.col("v"), F.lit(False)).first().loss == 0
    assert [r.percent for r in stats.relative_to(df, "v", F.col("n") == "a").collect()] == [None, None]
    assert [r.s for r in df.select(runs.shown("v", 1).alias("s")).collect()] == ["0.0", "2.0"]


def test_crossing_must_start_under_the_level(spark):
    rows = [(0, 0.0, 0.2), (0, 1.0, 0.6), (0, 2.0, 0.9), (1, 0.0, 0.7), (1, 1.0, 0.9), (2, 0.0, 0.1), (2, 1.0, 0.3)]
    got = field.first_crossing(spark.createDataFrame(rows, "ray int, t double, d double"), "ray", "t", "d", 0.5).collect()
    assert [(r.ray, round(r.t, 6)) for r in got] == [(0, 0.75)]


def test_level_surface_is_closed_and_faces_outward(spark):
    import random

    from geofold.operators import isosurface

    rng, n = random.Random(3), 7
    inner = lambda *p: all(0 < x < n - 1 for x in p)
    noise = [(i, j, k, rng.uniform(-1, 1) if inner(i, j, k) else -1.0) for i in range(n) for j in range(n) for k in range(n)]
    ball = [(i, j, k, 5.0 - (i - 3) ** 2 - (j - 3) ** 2 - (k - 3) ** 2) for i in range(n) for j in range(n) for k in range(n)]
    for grid in (noise, ball):
        v, f = isosurface.level_surface(spark.createDataFrame(grid, "i int, j int, k int, value double"), 0.0)
        place, faces = {r["vid"]: (r["x"], r["y"], r["z"]) for r in v.collect()}, [tuple(r) for r in f.collect()]
        assert len({x[0] for x in faces}) == len(faces) and {x for _, *t in faces for x in t} == set(place)
        value = {p[:3]: p[3] for p in grid}
        crossed = sum((value[p] > 0) != (value[q] > 0) for p in value for q in ((p[0] + 1, *p[1:]), (p[0], p[1] + 1, p[2]), (*p[:2], p[2] + 1)) if q in value)
        assert len(place) == crossed
        directed = {}
        for _, a, b, c in faces:
            for e in ((a, b), (b, c), (c, a)):
                directed[e] = directed.get(e, 0) + 1
        assert all(directed.get((b, a)) == m for (a, b), m in directed.items())
        volume = sum(sum(p[x] * (q[(x + 1) % 3] * r[(x + 2) % 3] - q[(x + 2) % 3] * r[(x + 1) % 3]) for x in range(3)) for p, q, r in (tuple(place[x] for x in t) for _, *t in faces)) / 6
        assert volume > 0
    assert 30 < volume < 47  # a ball of radius sqrt(5) has 46.8
    holed = [p for p in ball if p[:3] != (3, 3, 5)] + [(9, 9, 9, None)]
    assert 0 < isosurface.level_surface(spark.createDataFrame(holed, "i int, j int, k int, value double"), 0.0)[1].count() < len(faces)


def test_step_conditions():
    from geofold.operators.filters import step_runs

    on = {"a": True, "b": False}
    assert step_runs("${a} and not ${b}", on) and not step_runs("${b} or not ${a}", on) and step_runs("${b} is not ${a}", on)
    assert step_runs("not ${b} and ${a} or ${b}", on) and step_runs("${b} is ${b}", on)
    for bad in ("", "${a} and", "__import__('os')", "${c}", "${a} ${b}", "1"):
        with pytest.raises(ValueError):
            step_runs(bad, on)


def test_level_points_of_one_splat(spark):
    from geofold.operators import field

    rays = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (2, 0.0, 9.0, 0.0, 1.0, 0.0, 0.0, 1.0)], "i int, px double, py double, pz double, ux double, uy double, uz double, sd double")
    near = spark.createDataFrame([(i, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.9) for i in (1, 2)], ["i", *field.SPLAT])
    (got,) = field.level_points(rays, near, 0.3).collect()
    assert got["i"] == 1 and got["lx"] == pytest.approx(-np.sqrt(2 * np.log(3)), abs=0.02) and got["nx"] == pytest.approx(-1) and got["ny"] == pytest.approx(0)
    assert field.level_points(rays, near.where("false"), 0.3).collect() == []


def test_alignment_uses_the_deviation_along_the_line(spark):
    # two long splats, one along the line between them (turned by 90 degrees about z), one across it
    half = 0.5**0.5
    row = (0, 0.0, 0.0, 0.0, 3.0, 0.1, 0.1, 1.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 3.0, 0.2, 0.2, half, 0.0, 0.0, half)
    names = "i px py pz o0 o1 o2 p0 p1 p2 p3 x y z s0 s1 s2 q0 q1 q2 q3".split()
    df = spark.createDataFrame([row], ["i", *names[1:]])
    assert field.alignment(df).first().alignment == pytest.approx(abs(2 / (3.0 + 0.2) - 1))
    assert field.alignment(df, factor=2.0).first().alignment == pytest.approx(abs(2 / (2 * 3.2) - 1))
    # least axes: y of the first; the second's y axis is turned onto x
    assert field.alignment(df.withColumn("o2", F.lit(0.5)).withColumn("s2", F.lit(0.5)), by_normals=True).first().alignment == pytest.approx(0, abs=1e-12)


def test_depth_mask_by_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    h, w, far = 9, 11, 5.0
    depth = np.where(rng.random((h, w)) < 0.06, far, 2 + 0.08 * rng.random((h, w)).cumsum(axis=1))
    normal = rng.random((h, w))
    df = spark.createDataFrame([(0, r, c, float(depth[r, c]), float(normal[r, c])) for r in range(h) for c in range(w)], "img int, row int, col int, depth double, normal double")
    got = {(r.row, r.col) for r in raster.valid_depth(df, ["img"], h, w, 5.0, normal="normal", least_normal=0.2).where("valid").collect()}
    want = set()
    for r in range(2, h - 2):
        for c in range(2, w - 2):
            near = all(depth[r + a, c + b] < 0.98 * far for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)))
            steep = max(abs(depth[r, c + 1] - depth[r, c - 1]), abs(depth[r + 1, c] - depth[r - 1, c])) / 2
            if near and steep < 0.05 * depth[r, c] and normal[r, c] > 0.2:
                want.add((r, c))
    assert got == want and 0 < len(want) < (h - 4) * (w - 4)


def test_each_group_of_values_is_inherited_on_its_own(spark):
    rows = spark.createDataFrame([("p", 1.0, 2.0, 3.0), ("c", None, None, 5.0), ("d", None, 7.0, None), ("e", None, None, None), ("f", None, None, None)], "run string, psnr double, ssim double, loss double")
    parents = spark.createDataFrame([("c", "p"), ("d", "p"), ("e", "gone"), ("f", "e")], "run string, parent string")
    got = {r.run: tuple(r)[1:] for r in runs.inherited(rows, parents, {"render": ["psnr", "ssim"], "train": ["loss"]}).select("run", "psnr", "ssim", "render_source", "loss", "train_source").collect()}
    assert got["c"] == (1.0, 2.0, "inherited:p", 5.0, "own") and got["d"] == (None, 7.0, "own", 3.0, "inherited:p")
    assert got["e"] == got["f"] == (None, None, "missing", None, "missing") and got["p"] == (1.0, 2.0, "own", 3.0, "own")


def test_short_windows_and_slow_averages(spark):
    rows = [("a", i, float(v)) for i, v in enumerate((1, 4, 7))] + [("b", 0, 9.0)] + [("c", i, 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "run string, i int, v double")
    got = {(r.run, r.i): r.smooth for r in stats.moving_average(df, ["run"], ["i"], "v").collect()}
    assert [got["a", i] for i in range(3)] == pytest.approx([1, 2, 4]) and got["b", 0] == 9 and got["c", 399] == 1
    slow = {(r.run, r.i): r.ema for r in stats.ema(df, ["run"], ["i"], "v", weight=0.01).collect()}
    assert slow["c", 299] == pytest.approx(1 - 0.99**300) and slow["a", 2] == pytest.approx(0.01 * (7 + 4 * 0.99 + 0.99**2))
    assert stats.ema(df, ["run"], ["i"], "v", weight=1).where("run = 'a' AND i = 2").first().ema == 7


def test_parts_of_a_turned_splat_lie_along_its_axis(spark):
    half = 0.5**0.5
    df = spark.createDataFrame([(i, 0.0, 0.0, 0.0, 2.0, 1e-9, 1e-9, half, 0.0, 0.0, half) for i in range(60)], "id long, x double, y double, z double, s0 double, s1 double, s2 double, q0 double, q1 double, q2 double, q3 double")
    got = sampling.densified(df, F.lit(False), F.lit(True)).collect()
    assert len(got) == 120 and max(abs(r.x) + abs(r.z) for r in got) < 1e-6 and np.std([r.y for r in got]) == pytest.approx(2, rel=0.25)


def test_deformation_of_a_stretched_face(spark):
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3)], "fid long, a long, b long, c long")
    points = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 1.0, 1.0)]
    at = lambda k: spark.createDataFrame([(i, p[0], p[1], p[2] * k) for i, p in enumerate(points)], "vid long, x double, y double, z double")
    got = {r.fid: (r.ratio, r.kept) for r in mesh.deformation(faces, at(6.0), at(1.0)).collect()}
    tri = np.array(points[1:])
    span = lambda k: np.linalg.norm(tri * [1, 1, k] - (tri * [1, 1, k]).mean(axis=0), axis=1)
    assert got[0] == (pytest.approx(1), True) and got[1] == (pytest.approx((span(6) / span(1)).max()), False)


def test_quantiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = np.r_[rng.lognormal(0, 6, 700), -rng.lognormal(0, 6, 300), np.full(500, 3.25), 1.7e308, -1.7e308, 5e-324]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    qs = [0.0, 0.001, 0.1, 0.25, 0.5, 0.731, 0.9, 1.0]
    for blocks in (4096, 3):
        monkeypatch.setattr(quantiles, "BLOCKS", blocks)
        got = stats.quantiles(df, "v", qs)
        assert got == pytest.approx(np.quantile(values, qs).tolist(), rel=1e-12)
    assert stats.quantiles(df.limit(0), "v", [0.5]) == [None] and stats.quantiles(df.where("v = 3.25"), "v", [0.5]) == [3.25]
    assert stats.deciles(df.limit(0), "v").collect() == [] and stats.distribution(df.limit(0), "v").first().median is None


def test_quantiles_by_group_of_several_columns(spark):
    """One group of 90 % of the rows, one of copies, one of infinities, one without a value, a null group."""
    rng = np.random.default_rng(8)
    inf = float("inf")
    rows = [("hot", float(round(x, 2)), float(-x)) for x in rng.normal(size=45_000)] + [("copies", 2.5, None)] * 3000
    rows += [("ends", v, v) for v in (-inf, -inf, 1.0, inf, inf, inf)] + [("none", None, float("nan"))] * 3 + [(None, float(i), 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    qs = [0.0, 0.01, 0.3, 0.5, 0.9, 1.0]
    got = {(r.g, r.name, r.q): r.value for r in quantiles.quantile_rows(df, {"a": "a", "b": F.col("b") * 2}, qs, ["g"]).collect()}
    want = {}
    for g in ("hot", "copies", "ends", None):
        for name, k, times in (("a", 1, 1), ("b", 2, 2)):
            own = sorted(r[k] * times for r in rows if r[0] == g and r[k] is not None)
            for q in qs if own else ():
                p = q * (len(own) - 1)
                low, high = own[int(p)], own[min(int(p) + (p > int(p)), len(own) - 1)]
                want[g, name, q] = low if low == high else (1 - p % 1) * low + p % 1 * high
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, nan_ok=True) for k in want)
    summary = {r.g: r for r in stats.distribution(df, "a", ["g"]).collect()}
    assert summary["none"].median is None and summary["none"].n == 0 and summary[None].median == 4.5 and summary["copies"].p90 == 2.5
    ranges = {r.g: (r.low, r.high) for r in stats.robust_range(df, ["g"], "a", F.col("a") > 100).collect()}
    assert ranges == dict.fromkeys(["hot", "copies", "none", None], (0.0, 1.0)) | {"ends": (inf, inf)}


def test_quantiles_with_infinities_end(spark):
    df = spark.range(30_000).select(F.when(F.col("id") == 7, float("inf")).when(F.col("id") == 8, float("-inf")).otherwise(F.col("id").cast("double")).alias("v"))
    assert stats.quantiles(df, "v", [0.0, 0.5, 1.0]) == [float("-inf"), 15000.5, float("inf")]
    assert np.isnan(stats.quantiles(df.where("id IN (7, 8)"), "v", [0.5])[0])


def test_over_full_edges_lose_their_smallest_faces(spark):
    """Against dropping faces one by one, smallest first."""
    rng = np.random.default_rng(6)
    places = rng.normal(size=(14, 3))
    corners = sorted({tuple(sorted(rng.choice(14, 3, replace=False).tolist())) for _ in range(160)})
    size = [float(np.linalg.norm(np.cross(places[b] - places[a], places[c] - places[a])) / 2) for a, b, c in corners]
    uses = {}
    sides = lambda f: [tuple(sorted(e)) for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))]
    for f in corners:
        for e in sides(f):
            uses[e] = uses.get(e, 0) + 1
    over = sorted((e, n) for e, n in uses.items() if n > 2)
    kept = set(range(len(corners)))
    for i in sorted(range(len(corners)), key=lambda i: (size[i], i)):
        if any(uses[e] > 2 for e in sides(corners[i])):
            kept.discard(i)
            for e in sides(corners[i]):
                uses[e] -= 1
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "fid long, a long, b long, c long").repartition(3)
    assert {r.fid for r in mesh.manifold_faces(f, v).collect()} == kept and len(kept) < len(corners)
    assert sorted(((r.u, r.v), r.uses) for r in mesh.non_manifold_edges(f).collect()) == over
    assert mesh.non_manifold_edges(mesh.manifold_faces(f, v)).isEmpty()


def test_normals_of_a_cube_with_and_without_creases(spark):
    v = spark.createDataFrame([(i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)], "vid long, x double, y double, z double")
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    f = spark.createDataFrame([(2 * i + k, q[0], q[1 + k], q[2 + k]) for i, q in enumerate(quads) for k in range(2)], "fid long, a long, b long, c long")
    hard = mesh.smooth_normals(f, v, 30.0).collect()
    soft = mesh.smooth_normals(f, v, 100.0).collect()
    assert len(hard) == len(soft) == 36
    assert all(sorted(map(abs, (r.nx, r.ny, r.nz))) == [0, 0, 1] for r in hard)
    assert all(min(map(abs, (r.nx, r.ny, r.nz))) > 0.2 and (r.nx > 0) == bool(r.vid & 1) for r in soft) and len({(r.vid, round(r.nx, 9)) for r in soft}) == 8


def test_with_each_sends_blocks(spark):
    a, b = spark.range(7).withColumnRenamed("id", "a"), spark.range(11).withColumnRenamed("id", "b")
    got = {(r.a, r.b) for r in stats.with_each(a, b, most=3).collect()}
    assert len(got) == 77


def test_models_are_stored_and_read_in_the_present_form(spark, tmp_path):
    from geofold.operators import checkpoints

    old = spark.createDataFrame([(1, [0.0, 1.0, 2.0], [[9.0] * 3] * 4, [1.0, 0.0, 0.0, 0.0, 5.0, 6.0, 7.0])], "id long, points array<double>, sh_coordinates array<array<double>>, radiuses array<double>")
    checkpoints.save(old, f"file://{tmp_path}/model", {"levels": 3, "name": "a"})
    splats, settings = checkpoints.load(spark, f"file://{tmp_path}/model")
    r = splats.first()
    assert settings == {"levels": 3, "name": "a"} and r._points == [0, 1, 2] and len(r._sh_coordinates_dc) == 1 and len(r._sh_coordinates_rest) == 3
    assert r._quaternions == [1, 0, 0, 0] and r._scales == [5, 6, 7] and not {"points", "sh_coordinates", "radiuses"} & set(splats.columns)
    assert checkpoints.present_form(splats).columns == splats.columns


def test_harmonics_of_degree_four_are_orthonormal(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20_000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(v.tolist(), "x double, y double, z double")
    b = np.array(df.select(*(c.alias(f"b{k}") for k, c in enumerate(geom.sh_basis(["x", "y", "z"], 4)))).collect())
    assert np.abs(b.T @ b / len(b) * 4 * np.pi - np.eye(25)).max() < 0.12


def test_only_faces_beside_others_are_written_for_smooth_normals(spark, monkeypatch):
    """A strip of triangles, bent at two of its sides, and 500 lone faces."""
    rng = np.random.default_rng(4)
    places = [(float(i // 2), float(i % 2), float(i in (6, 7))) for i in range(12)] + rng.normal(size=(1500, 3)).tolist()
    corners = [(i, i + 1, i + 2) if i % 2 else (i + 1, i, i + 2) for i in range(10)] + [(12 + 3 * i, 13 + 3 * i, 14 + 3 * i) for i in range(500)]
    v = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "fid long, a long, b long, c long").repartition(3)
    written, stash = {}, mesh.stash
    monkeypatch.setattr(mesh, "stash", lambda df, name: written.setdefault(name, stash(df, name)))
    got = {(r.fid, r.corner): (r.vid, r.nx, r.ny, r.nz) for r in mesh.smooth_normals(f, v, 30.0).collect()}
    assert max(t.count() for t in written.values()) <= 10
    p = np.array(places)
    raw = np.array([np.cross(p[b] - p[a], p[c] - p[a]) for a, b, c in corners])
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    part = {(i, c): (i, c) for i, t in enumerate(corners) for c in range(3)}
    for i in range(9):  # neighbours along the strip
        if np.degrees(np.arccos(np.clip(unit[i] @ unit[i + 1], -1, 1))) <= 30:
            for vid in set(corners[i]) & set(corners[i + 1]):
                x, y = part[i, corners[i].index(vid)], part[i + 1, corners[i + 1].index(vid)]
                part = {k: x if r == y else r for k, r in part.items()}
    assert len(set(part.values())) < len(part) - 5
    for k, root in part.items():
        s = sum(raw[i] for (i, c), r in part.items() if r == root)
        assert got[k][0] == corners[k[0]][k[1]] and np.allclose(got[k][1:], s / np.linalg.norm(s))
    assert len(got) == len(part)
