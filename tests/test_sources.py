"""Readers and writers on generated bytes."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.sources import binary, sinks, text

POINTS = [(7, 1.0, 2.0, 3.0, 10, 20, 30, 0.5, [(1, 2), (3, 4), (5, 6)]), (9, -1.0, 0.0, 4.5, 1, 2, 3, 0.25, [])]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", len(POINTS)) + b"".join(struct.pack("<QdddBBBdQ", *head, len(track)) + b"".join(struct.pack("<ii", *t) for t in track) for *head, track in POINTS))
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 64, 48, 60, 61, 32, 24) + struct.pack("<iiQQ3d", 2, 0, 10, 20, 5, 5, 10))
    image = struct.pack("<i7di", 3, 1, 0, 0, 0, 0.1, 0.2, 0.3, 1) + b"a b.png\0" + struct.pack("<Q", 2) + struct.pack("<ddqddq", 1.5, 2.5, 7, 3.5, 4.5, -1)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 1) + image)
    return tmp_path


def test_sparse_points_and_cameras(spark, folder):
    got = sorted(map(tuple, binary.sparse_points(spark, f"{folder}/points3D.bin").collect()))
    assert got == [(*p[:8], len(p[8])) for p in POINTS]
    cams = {r.camera_id: r for r in text.with_fallback(spark, str(folder), "cameras").collect()}
    assert cams[1].model == "PINHOLE" and cams[1].params == [60, 61, 32, 24] and cams[2].params == [5, 5, 10]
    img = text.with_fallback(spark, str(folder), "images").first()
    assert img.name == "a b.png" and img.qvec == [1, 0, 0, 0] and [(p.x, p.y) for p in img.xys] == [(1.5, 2.5), (3.5, 4.5)] and img.point3d_ids == [7, -1]
    posed = text.posed_cameras(binary.extrinsics(spark, f"{folder}/images.bin"), binary.intrinsics(spark, f"{folder}/cameras.bin")).first()
    assert posed.fov_x == pytest.approx(2 * np.arctan(64 / 120)) and posed.fov_y == pytest.approx(2 * np.arctan(48 / 122))


def test_text_reconstruction(spark, tmp_path):
    (tmp_path / "points3D.txt").write_text("# header\n7 1.0 2.0 3.0 10 20 30 0.5 1 2 3 4 5 6\n9 -1 0 4.5 1 2 3 0.25\n")
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 64 48 60 61 32 24\n")
    (tmp_path / "images.txt").write_text("# i\n3 1 0 0 0 0.1 0.2 0.3 1 a.png\n1.5 2.5 7 3.5 4.5 -1\n4 1 0 0 0 0 0 0 1 b.png\n\n")
    got = sorted(map(tuple, text.with_fallback(spark, str(tmp_path), "points3D").collect()))
    assert got == [(*p[:8], len(p[8])) for p in POINTS]
    imgs = {r.name: r for r in text.with_fallback(spark, str(tmp_path), "images").collect()}
    assert imgs["a.png"].point3d_ids == [7, -1] and imgs["a.png"].tvec == [0.1, 0.2, 0.3] and imgs["b.png"].xys == []
    assert text.intrinsics(spark, f"{tmp_path}/cameras.txt").first().params == [60, 61, 32, 24]


def test_splat_file_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3)), rng.normal(size=3).tolist(), rng.normal(size=45).tolist(), float(rng.normal()), rng.normal(size=3).tolist(), rng.normal(size=4).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, f_dc array<double>, f_rest array<double>, opacity_logit double, log_scale array<double>, quat array<double>")
    sinks.write_splats(df.repartition(3), f"{tmp_path}/s.ply")
    back = binary.splat_cloud(spark, f"{tmp_path}/s.ply").orderBy("id").collect()
    for a, b in zip(rows, back, strict=True):
        assert np.allclose(np.hstack(a[1:]), np.hstack(list(b)[1:]), atol=1e-6)
    with pytest.raises(Exception, match="degree"):
        binary.splat_cloud(spark, f"{tmp_path}/s.ply", degree=2).collect()


def test_mesh_file(spark, tmp_path):
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<fffBBB", *v) for v in ((0, 0, 0, 255, 0, 0), (1, 0, 0, 0, 255, 0), (0, 1, 0, 0, 0, 51))) + struct.pack("<Biii", 3, 0, 1, 2)
    (tmp_path / "m.ply").write_bytes(head.encode() + body)
    v, f = binary.mesh_vertices(spark, f"{tmp_path}/m.ply"), binary.mesh_faces(spark, f"{tmp_path}/m.ply")
    assert [tuple(r) for r in v.orderBy("vid").collect()] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0)] and tuple(f.first()) == (0, 0, 1, 2)
    assert binary.point_cloud(spark, f"{tmp_path}/m.ply").orderBy("id").collect()[2].b == pytest.approx(0.2)
    sinks.write_obj(v, f, f"{tmp_path}/obj")
    assert [r.value for r in spark.read.text(f"{tmp_path}/obj").collect()][-1] == "f 1 2 3"


def test_dense_array_and_image_headers(spark, tmp_path):
    a = np.arange(6, dtype="<f4").reshape(2, 3)  # 2 columns, 3 rows
    (tmp_path / "d.bin").write_bytes(b"2&3&1&" + a.tobytes(order="F"))
    got = {(r.row, r.col): r.value for r in binary.dense_array(spark, f"{tmp_path}/d.bin").collect()}
    assert got == {(r, c): float(a[c, r]) for c in range(2) for r in range(3)}
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480))
    (tmp_path / "img/b.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 30, 40))
    (tmp_path / "img/c.txt").write_bytes(b"none")
    kinds = sorted((r.kind or "", r.width, r.height) for r in binary.image_headers(spark, f"{tmp_path}/img").collect())
    assert kinds == [("", None, None), ("JPEG", 40, 30), ("PNG", 640, 480)]


def test_json_sources(spark, tmp_path):
    cam = lambda n, w: {"id": 0, "img_name": n, "width": w, "height": 1, "position": [0, 0, 0], "rotation": [[1, 0, 0]], "fx": 1.0, "fy": 1.0}
    (tmp_path / "cameras.json").write_text(json.dumps([cam("b", 1), cam("a", 2), cam("b", 3), cam("c", 4)]))
    assert [(r.img_name, r.width) for r in text.camera_list(spark, f"{tmp_path}/cameras.json", removed=(3,)).collect()] == [("a", 2), ("b", 3)]
    (tmp_path / "transforms_train.json").write_text(json.dumps({"camera_angle_x": 0.5, "frames": [{"file_path": "r0", "transform_matrix": [[1, 2, 3, 4]]}]}))
    assert text.frame_transforms(spark, f"{tmp_path}/transforms_train.json").first().m == [[1, -2, -3, 4]]
    assert text.scene_kind(spark, str(tmp_path)) == "frames"
    (tmp_path / "scene.json").write_text(json.dumps({"meshes": [{"name": "m", "groups": [[0, 1], [2]], "weights": [[1.0, 3.0], [0.0]]}]}))
    assert sorted(map(tuple, text.scene_package(spark, f"{tmp_path}/scene.json").collect())) == [("m", 0, 0, 0.25), ("m", 0, 1, 0.75)]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/render_x.json").write_text('{"psnr": 20.5}')
    assert tuple(text.metric_documents(spark, f"{tmp_path}/runs").select("kind", "run", "psnr").first()) == ("render", "x", 20.5)


def test_logs_and_settings(spark, tmp_path):
    (tmp_path / "a.log").write_text("start\nloss: 0.25 [   50/7000] computed in 0.5 minutes.\n")
    assert tuple(text.training_log(spark, f"{tmp_path}/a.log").first())[1:] == (50, 7000, 0.25, 0.5)
    (tmp_path / "g.txt").write_text("# c\n\nT1 | 0 | p.pt | --x 1\nT2|1\n")
    assert [tuple(r) for r in text.grid_settings(spark, f"{tmp_path}/g.txt").collect()] == [("T1", "0", "p.pt", "--x 1"), ("T2", "1", "", "")]
    (tmp_path / "m.csv").write_text("name,v\n001,1.5\nb,x\n")
    rows = text.csv_rows(spark, f"{tmp_path}/m.csv", ["v"]).collect()
    assert rows[0].name == "001" and rows[0].v == 1.5 and np.isnan(rows[1].v)
    (tmp_path / "p.patch").write_text("--- a/f.py\n+++ b/f.py\n+x\n+y\n-z\n+++ b/g.py\n-q\n")
    assert sorted(map(tuple, text.patch_counts(spark, f"{tmp_path}/p.patch").collect())) == [("p.patch", "f.py", 2, 1), ("p.patch", "g.py", 0, 1)]
    names = spark.createDataFrame([("iteration_7000",), ("iteration_30000",), ("x",)], "name string")
    assert text.latest_iteration(names).first().iteration == 30000
    lines = sinks.markdown_lines(names.withColumn("v", F.lit(None).cast("int")), ["name"]).collect()
    assert [r.value for r in lines[:3]] == ["| name | v |", "|---|---|", "| iteration_30000 | NA |"]
