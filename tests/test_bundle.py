"""Bundle files line by line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.operators import mesh
from geofold.sources import bundle

TEXT = """# Bundle file v0.3
2 3
500 0.1 -0.2
1 0 0
0 1 0
0 0 1
0.5 0 2
600.25 0 0
0 1 0
1 0 0
0 0 1
-1 0 0
1 2 3
255 0 7
2 0 5 0.5 -1.5 1 9 2 3
4 5 6
1 2 3
1 1 8 0 0
7 8 9
0 0 0
"""


def test_a_bundle_is_read_scaled_cut_and_saved(spark, tmp_path):
    (tmp_path / "b.out").write_text(TEXT)
    b = bundle.read(spark, f"{tmp_path}/b.out")
    cams = {r.camera: r for r in b.cameras.collect()}
    assert b.header == "# Bundle file v0.3" and b.points_stated == 3 and cams[1].focal == 600.25 and cams[1].rotation == [0, 1, 0, 1, 0, 0, 0, 0, 1] and cams[0].translation == [0.5, 0, 2] and cams[0].k2 == -0.2
    pts = {r.point: r for r in b.points.collect()}
    assert pts.keys() == {0, 1} and pts[0].r == 255 and [tuple(v) for v in pts[0].views] == [(0, 5, 0.5, -1.5), (1, 9, 2.0, 3.0)]  # the third has no views line
    less = bundle.excluded(bundle.scaled(b, 2.0), [0])
    assert [(r.camera, r.focal) for r in less.cameras.collect()] == [(0, 1200.5)]
    assert {r.point: [tuple(v) for v in r.views] for r in less.points.collect()} == {0: [(0, 9, 2.0, 3.0)], 1: [(0, 8, 0.0, 0.0)]}
    bundle.save(b, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == TEXT.splitlines()[:18]
    bundle.save(bundle.excluded(b, [1]), f"{tmp_path}/less")
    assert [r.value for r in spark.read.text(f"{tmp_path}/less").collect()] == ["# Bundle file v0.3", "1 3", *TEXT.splitlines()[2:7], "1 2 3", "255 0 7", "1 0 5 0.5 -1.5"]


def test_a_file_cut_into_ranges(spark, tmp_path):
    n = 3000
    lines = ["# B", f"1 {n}", "1 0 0", "1 0 0", "0 1 0", "0 0 1", "0 0 0"] + [x for i in range(n) for x in (f"{i} 0 0", "1 1 1", " ".join([str(i % 4), *("0 1 2 3" for _ in range(i % 4))]))]
    (tmp_path / "b.out").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        b = bundle.read(spark, f"{tmp_path}/b.out")
        got = sorted((r.point, r.x, len(r.views)) for r in b.points.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, float(i), i % 4) for i in range(n)]


def test_splats_are_carried_by_turned_and_stretched_faces(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(6, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    table = lambda p: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5)], "fid long, a long, b long, c long")
    bound = faces.select(F.col("fid").alias("sid"), "fid", *(F.lit(w).alias(f"b{i}") for i, w in enumerate((0.2, 0.5, 0.3))), F.lit(0.6).alias("re"), F.lit(0.8).alias("im"), F.lit(0.1).alias("s1"), F.lit(0.2).alias("s2"))
    frame = lambda rows: {r.sid: (np.array([[r[f"m{a}{b}"] for b in range(3)] for a in range(3)]), np.array([r.x, r.y, r.z]), r.s1, r.s2) for r in rows.collect()}
    still, moved, larger = (frame(mesh.carried(bound, faces, table(v), table(p))) for p in (v, v @ turn.T + 3, 2 * v))
    for i in (0, 1):
        assert np.allclose(still[i][0].T @ still[i][0], np.eye(3)) and still[i][2:] == pytest.approx((0.1, 0.2), rel=0.05)
        assert np.allclose(moved[i][0], turn @ still[i][0]) and np.allclose(moved[i][1], turn @ still[i][1] + 3) and moved[i][2:] == pytest.approx(still[i][2:])
        assert np.allclose(larger[i][0], still[i][0]) and np.allclose(larger[i][1], 2 * still[i][1]) and larger[i][2] > still[i][2] and larger[i][3] > still[i][3]


def test_splats_that_know_their_corners_are_not_dealt_by_face(spark):
    rng = np.random.default_rng(2)
    table = lambda p: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "vid long, x double, y double, z double")
    before, after = table(rng.normal(size=(9, 3))), table(rng.normal(size=(9, 3)))
    faces = spark.createDataFrame([(i, *map(int, rng.permutation(9)[:3])) for i in range(40)], "fid long, a long, b long, c long")
    bound = faces.select(F.col("fid").alias("sid"), "*", *(F.lit(w).alias(f"b{i}") for i, w in enumerate((0.2, 0.5, 0.3))), F.lit(0.6).alias("re"), F.lit(0.8).alias("im"), F.lit(0.1).alias("s1"), F.lit(0.2).alias("s2"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known, looked_up = mesh.carried(bound, None, before, after), mesh.carried(bound.drop("a", "b", "c"), faces, before, after)
        plan = spark._jvm.PythonSQLUtils.explainString(known._jdf.queryExecution(), "simple")
        joins = plan.count("BroadcastHashJoin")
        rows = [sorted(tuple(r) for r in x.collect()) for x in (known, looked_up)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert joins == 3 and len(rows[0]) == 40 and np.allclose(rows[0], rows[1], rtol=1e-12)
