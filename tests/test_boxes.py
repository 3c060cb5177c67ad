"""Distances to triangles against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geofold.functions.geom import point_triangle_squared
from geofold.operators import boxes

FACES = "fid long, " + ", ".join(f"{c} double" for c in boxes.CORNERS)


def made(rng, n):
    """Small triangles in clumps, a few very large ones, degenerate ones, copies."""
    mid = rng.normal(size=(n, 3)) * 3
    corners = np.stack([mid + rng.normal(size=(n, 3)) * 0.05 for _ in range(3)], axis=1)
    corners[:12] = rng.normal(size=(12, 3, 3)) * 8
    corners[12:16, 2] = corners[12:16, 1]
    corners[16:20] = corners[16:20, :1]
    corners[30:60] = corners[60:61]
    return corners


@pytest.mark.parametrize("leaf, piece, visits", [(1000, 4096, 16), (20, 4096, 2), (8, 30, 1)])
def test_nearest_triangles_are_those_of_all_pairs(spark, monkeypatch, leaf, piece, visits):
    for name, value in (("LEAF", leaf), ("PIECE", piece), ("VISITS", visits)):
        monkeypatch.setattr(boxes, name, value)
    rng = np.random.default_rng(3)
    corners, points = made(rng, 400), np.r_[rng.normal(size=(60, 3)) * 3, np.zeros((40, 3)), rng.normal(size=(5, 3)) * 1000]
    points[50:55] = corners[100:105, 0]
    faces = spark.createDataFrame([(i, *map(float, c.ravel())) for i, c in enumerate(corners)] + [(900, None, *[0.0] * 8), (901, float("nan"), *[0.0] * 8)], FACES).repartition(3)
    asked = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(900, None, 0.0, 0.0), (901, float("inf"), 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.i: (r.fid, r.d2) for r in boxes.triangle_distances(asked, faces).collect()}
    p, f = np.repeat(points, len(corners), axis=0), np.tile(corners, (len(points), 1, 1))
    d2 = boxes.point_triangle(p, f[:, 0], f[:, 1], f[:, 2]).reshape(len(points), -1)
    assert got.keys() == set(range(len(points)))
    for i, (fid, d) in got.items():
        assert d == pytest.approx(d2[i].min(), rel=1e-9, abs=1e-18) and d2[i, fid] == pytest.approx(d2[i].min(), rel=1e-9, abs=1e-18)
        assert not 30 < fid <= 60  # of equal ones the first


def test_both_formulas_of_the_distance_agree(spark):
    rng = np.random.default_rng(5)
    n = 500
    p, a, b, c = (rng.normal(size=(n, 3)) for _ in range(4))
    c[:5] = a[:5]
    p[10:20] = a[10:20]
    rows = spark.createDataFrame([tuple(map(float, np.r_[p[i], a[i], b[i], c[i]])) for i in range(n)], ", ".join(f"{k}{x} double" for k in "pabc" for x in "xyz"))
    place = lambda k: [F.col(k + x) for x in "xyz"]
    got = [r.d2 for r in rows.select(point_triangle_squared(*(place(k) for k in "pabc")).alias("d2")).collect()]
    assert np.allclose([x for x in got[5:]], boxes.point_triangle(p, a, b, c)[5:], rtol=1e-9, atol=1e-15)


def test_without_triangles_or_points(spark):
    none = spark.createDataFrame([], FACES)
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert boxes.triangle_distances(points, none).collect() == []
    one = spark.createDataFrame([(7, *[1.0] * 9)], FACES)
    assert boxes.triangle_distances(points.limit(0), one).collect() == []
    assert [tuple(r) for r in boxes.triangle_distances(points, one).collect()] == [(1, 7, 3.0)]


def test_large_triangles_have_few_leaves_and_blocks_hold_neighbours(spark, monkeypatch):
    """Triangles across all of space: leaves of ten would all be met by every point."""
    for name, value in (("LEAF", 10), ("PIECE", 300), ("POINTS", 50), ("BLOCK", 8)):
        monkeypatch.setattr(boxes, name, value)
    rng = np.random.default_rng(8)
    corners, points = rng.normal(size=(3000, 3, 3)), rng.normal(size=(120, 3))
    blocks = boxes._blocks(points)
    assert sorted(np.concatenate(blocks).tolist()) == list(range(120)) and max(map(len, blocks)) <= 8
    assert np.mean([np.ptp(points[b], axis=0).prod() for b in blocks]) < np.ptp(points, axis=0).prod() / 16
    leaves, forest = [], boxes.Forest
    monkeypatch.setattr(boxes, "Forest", lambda samples, n: leaves.append(sum(n.values())) or forest(samples, n))
    faces = spark.createDataFrame([(i, *map(float, c.ravel())) for i, c in enumerate(corners)], FACES)
    got = {r.i: (r.fid, r.d2) for r in boxes.triangle_distances(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double"), faces).collect()}
    p, f = np.repeat(points, len(corners), axis=0), np.tile(corners, (len(points), 1, 1))
    d2 = boxes.point_triangle(p, f[:, 0], f[:, 1], f[:, 2]).reshape(len(points), -1)
    assert all(got[i][0] == d2[i].argmin() and got[i][1] == pytest.approx(d2[i].min(), rel=1e-9) for i in range(len(points)))
    assert leaves[0] < 100


def test_wide_triangles_meet_points_in_chunks_without_leaves(spark, monkeypatch):
    """Triangles across all of space, away from the origin: every point would visit every leaf, so there is none."""
    for name, value in (("LEAF", 8), ("PIECE", 16), ("CHUNK", 400), ("SPREAD", 40), ("POINTS", 25), ("SAMPLES", (64, 8))):
        monkeypatch.setattr(boxes, name, value)
    rng = np.random.default_rng(9)
    corners, points = rng.normal(size=(3000, 3, 3)) + [0, 50, 0], np.r_[rng.normal(size=(90, 3)), rng.normal(size=(5, 3)) * 100] + [0, 50, 0]
    corners[:20, 2] = corners[:20, 1]  # sides
    corners[20:40, 2] = corners[20:40, 0] + (corners[20:40, 1] - corners[20:40, 0]) * (1 + 1e-9 * rng.normal(size=(20, 3)))  # slivers
    corners[40:60] = corners[60:61]
    points[:10] = corners[60, 0] + np.linspace(0, 1, 10)[:, None] * (corners[60, 1] - corners[60, 0])
    leaves, forest = [], boxes.Forest
    monkeypatch.setattr(boxes, "Forest", lambda samples, n: leaves.append(sum(n.values())) or forest(samples, n))
    faces = spark.createDataFrame([(i, *map(float, c.ravel())) for i, c in enumerate(corners)], FACES).repartition(3)
    got = {r.i: (r.fid, r.d2) for r in boxes.triangle_distances(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double"), faces).collect()}
    p, f = np.repeat(points, len(corners), axis=0), np.tile(corners, (len(points), 1, 1))
    d2 = boxes.point_triangle(p, f[:, 0], f[:, 1], f[:, 2]).reshape(len(points), -1)
    assert got.keys() == set(range(len(points)))
    for i, (fid, d) in got.items():
        assert d == pytest.approx(d2[i].min(), rel=1e-9, abs=1e-25) and d2[i, fid] == pytest.approx(d2[i].min(), rel=1e-9, abs=1e-25)
        assert not 40 < fid <= 60  # of equal ones the first
    assert leaves[0] < 16


def test_a_task_notes_the_leaves_of_few_points_at_once(monkeypatch):
    """1,000 leaves that all points would meet: pairs of 5,000 points and their leaves aren't held together."""
    rng = np.random.default_rng(10)
    monkeypatch.setattr(boxes, "NOTED", 50_000, raising=False)
    forest = boxes.Forest({0: rng.normal(size=(8000, 3))}, {0: 1000})
    forest.set_boxes(np.full((forest.leaves, 3), -9.0), np.full((forest.leaves, 3), 9.0))
    most, within = [], boxes.Forest.within
    monkeypatch.setattr(boxes.Forest, "within", lambda self, p, bound: most.append(len(p) * self.leaves) or within(self, p, bound))

    class Rows:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run  # noqa: E731, N815

    p = rng.normal(size=(5000, 3))
    batch = pa.RecordBatch.from_arrays([*(pa.array(p[:, k]) for k in range(3)), pa.array(np.full(5000, 3)), pa.array(np.full(5000, 4)), pa.array(np.full(5000, 1.0))], ["x", "y", "z", "home", "done", "bound"])
    out = pa.Table.from_batches(boxes._next_visits(Rows(), forest, 10)(iter([batch]))).to_pandas()
    assert max(most) <= 50_000
    assert len(out) == 50_000 and (out.groupby(["x", "y", "z"])["leaf"].nunique() == 10).all() and 3 not in set(out["leaf"])
