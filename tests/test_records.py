"""Record files: cut at offsets, written in parts."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.sources import records, sinks


@pytest.fixture(autouse=True)
def known(spark):
    records.register(spark)


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    n = 20_000
    rows = spark.range(n).select((F.col("id") * 0.5).alias("x"), F.col("id").cast("int").alias("k"))
    path = f"{tmp_path}/p.ply"
    rows.repartition(4).orderBy("k").write.format("ply").mode("overwrite").save(path)
    assert os.listdir(tmp_path) == ["p.ply"]  # no part is left
    back = spark.read.format("ply").option("bytes_per_task", 10_000).load(path)
    assert back.rdd.getNumPartitions() == -(-n // (10_000 // 12))
    assert back.agg(F.count("*"), F.sum((F.col("n") == F.col("k")).cast("int")), F.sum("x")).first()[:] == (n, n, n * (n - 1) / 4)
    assert spark.read.format("ply").load(str(tmp_path)).count() == n


def test_points_of_varying_size(spark, tmp_path, monkeypatch):
    """A track of 300,000 pairs is longer than a block; one reading pass finds where tasks begin."""
    rows = [(i, 0.5 * i, 1.0, 2.0, i % 256, 0, 255, 0.25, [(j, i) for j in range(300_000 if i == 700 else i % 5)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:int,point_index:int>>")
    path = f"{tmp_path}/points3D.bin"
    monkeypatch.setattr(records, "BLOCK", 1 << 14)
    sinks.write_sparse_points(df.repartition(5), path)
    whole = open(path, "rb").read()
    assert struct.unpack_from("<Q", whole) == (1000,) and len(whole) == 8 + 51 * 1000 + 8 * sum(len(r[-1]) for r in rows)
    back = spark.read.format("sparse_points").option("rows_per_task", 64).load(path)
    assert back.rdd.getNumPartitions() == 16
    got = {r.point_id: (r.x, r.r, len(r.track), r.track[-1][:] if r.track else None) for r in back.collect()}
    assert got == {r[0]: (r[1], r[4], len(r[-1]), r[-1][-1] if r[-1] else None) for r in rows}
    (tmp_path / "cut.bin").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="ends within a record"):
        spark.read.format("sparse_points").load(f"{tmp_path}/cut.bin").count()


def test_empty_tables_are_files_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id long, x double, y double, z double")
    sinks.write_points(none, f"{tmp_path}/p.ply")
    assert spark.read.format("ply").load(f"{tmp_path}/p.ply").count() == 0
    sinks.write_sparse_points(none.selectExpr("id AS point_id", "x", "y", "z", "1 AS r", "1 AS g", "1 AS b", "x AS error", "CAST(NULL AS array<struct<image_id:int,point_index:int>>) AS track"), f"{tmp_path}/p.bin")
    assert spark.read.format("sparse_points").load(f"{tmp_path}/p.bin").count() == 0


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.range(100).select(F.when(F.col("id") == 50, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("double")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format("ply").mode("overwrite").save(f"{tmp_path}/p.ply")
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="fit"):
        spark.range(300).select(F.col("id").alias("red")).write.format("ply").option("types", "red:uchar").mode("overwrite").save(f"{tmp_path}/q.ply")
    with pytest.raises(Exception, match="type"):
        spark.range(3).select(F.col("id").cast("string").alias("s")).write.format("ply").mode("overwrite").save(f"{tmp_path}/q.ply")
    assert os.listdir(tmp_path) == []


def test_lists_of_another_length_are_refused(spark, tmp_path):
    head = b"ply\nformat binary_big_endian 1.0\nelement vertex 2\nproperty double x\nelement face 2\nproperty list uchar int v\nend_header\n"
    body = struct.pack(">dd", 1.5, -2.0)
    (tmp_path / "good.ply").write_bytes(head + body + struct.pack(">BiiiBiii", 3, 0, 1, 1, 3, 1, 0, 0))
    (tmp_path / "bad.ply").write_bytes(head + body + struct.pack(">BiiiiBii", 4, 0, 1, 1, 0, 2, 1, 0))
    load = lambda name, element: spark.read.format("ply").option("element", element).load(f"{tmp_path}/{name}.ply").collect()
    assert [tuple(r) for r in load("good", "vertex")] == [(0, 1.5), (1, -2.0)] and [r.v for r in load("good", "face")] == [[0, 1, 1], [1, 0, 0]]
    with pytest.raises(Exception, match="triangle"):
        load("bad", "face")
    with pytest.raises(Exception, match="bad2"):
        spark.read.format("ply").load(f"{tmp_path}/bad2.ply").collect()


def test_arrays_must_be_full(spark, tmp_path):
    cells = spark.range(24).selectExpr("CAST(id DIV 4 % 3 AS int) AS row", "CAST(id % 4 AS int) AS col", "CAST(id DIV 12 AS int) AS channel", "id * 1.5 AS value")
    sinks.write_dense_array(cells.repartition(3), f"{tmp_path}/a.bin", 4, 3, 2)
    back = spark.read.format("dense_array").option("bytes_per_task", 20).load(f"{tmp_path}/a.bin")
    assert back.rdd.getNumPartitions() == 5
    assert {(r.row, r.col, r.channel, r.value) for r in back.collect()} == {(i // 4 % 3, i % 4, i // 12, i * 1.5) for i in range(24)}
    with pytest.raises(Exception, match="fill"):
        sinks.write_dense_array(cells, f"{tmp_path}/b.bin", 5, 3, 2)
    assert np.frombuffer(open(f"{tmp_path}/a.bin", "rb").read()[6:], "<f4").tolist() == [i * 1.5 for i in range(24)]


def test_cameras_and_images_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 1 << 12)
    models = {"SIMPLE_PINHOLE": 3, "OPENCV": 8}
    cams = [(i, list(models)[i % 2], 640, 480, [i + 0.5 * k for k in range(list(models.values())[i % 2])]) for i in range(100)]
    rows = [(i, [1.0, 0.0, 0.5, i], [0.25 * i, 0.0, 1.0], i % 100, "é" * (i % 9) + str(i), [(0.5 * j, 1.0 * i) for j in range(300 if i == 70 else i % 4)], [j - 1 for j in range(300 if i == 70 else i % 4)]) for i in range(1000)]
    sinks.write_cameras(spark.createDataFrame(cams, records.CameraSource.columns).repartition(3), f"{tmp_path}/cameras.bin")
    sinks.write_images(spark.createDataFrame([tuple([float(x) for x in v] if k in (1, 2) else v for k, v in enumerate(r)) for r in rows], records.ImageSource.columns).repartition(5), f"{tmp_path}/images.bin")
    load = lambda kind: spark.read.format(kind).option("rows_per_task", 64).load(f"{tmp_path}/{kind}.bin")
    assert [load(k).rdd.getNumPartitions() for k in ("cameras", "images")] == [2, 16]
    assert sorted(tuple(r) for r in load("cameras").collect()) == cams
    assert sorted((r[0], r[1], r[2], r[3], r[4], [tuple(p) for p in r[5]], r[6]) for r in load("images").collect()) == rows
    whole = open(f"{tmp_path}/images.bin", "rb").read()
    open(f"{tmp_path}/images.bin", "wb").write(whole[:-5])
    with pytest.raises(Exception, match="ends within a record"):
        load("images").count()
