"""Density clusters against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.operators import cluster
from geofold.operators.components import connected_components

POINTS = "id long, x double, y double, z double"


def plain(ids, p, eps, least):
    near = ((p[:, None] - p) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(p), -1)
    for i in np.argsort(ids):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = ids[i]
                    todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
    for i in np.flatnonzero(~core):
        label[i] = min(label[near[i] & core], default=-1)
    return dict(zip(ids.tolist(), label.tolist(), strict=True))


@pytest.mark.parametrize("least, piece, few", [(6, 1 << 16, 1 << 20), (3, 4, 0), (1, 1 << 16, 1 << 20), (25, 10, 10)])
def test_labels_are_those_of_all_pairs(spark, monkeypatch, least, piece, few):
    monkeypatch.setattr(cluster, "PIECE", piece)
    monkeypatch.setattr(cluster, "FEW", few)
    rng = np.random.default_rng(7)
    p = np.r_[rng.normal(size=(150, 3)) * 3, rng.normal(size=(200, 3)) * 0.2, rng.normal(size=(80, 3)) * 0.1 + [1.1, 0, 0], np.full((30, 3), 5.0), np.linspace([-4, 4, 0], [4, 4, 0], 60), -1e6 + rng.normal(size=(40, 3)) * 0.3]
    ids = rng.permutation(len(p)) * 3
    rows = [(int(i), *map(float, x)) for i, x in zip(ids, p, strict=True)] + [(9001, None, 0.0, 0.0), (9002, float("nan"), 0.0, 0.0)]
    got = {r.id: r.label for r in cluster.dbscan(spark.createDataFrame(rows, POINTS).repartition(3), 0.5, least).collect()}
    assert got == plain(ids, p, 0.5, least) | {9001: -1, 9002: -1}


def test_a_very_full_cell_and_many_copies(spark):
    """Two clouds of 100,000 points within one cell each, 50,000 copies, and a chain that links the clouds."""
    n = 100_000
    cloud = spark.range(n).select("id", *(F.rand(k) * 0.04 for k in range(3))).toDF("id", "x", "y", "z")
    other = spark.range(n).select((F.col("id") + n).alias("id"), F.rand(4) * 0.04 + 0.5, F.rand(5) * 0.04, F.rand(6) * 0.04).toDF("id", "x", "y", "z")
    copies = spark.range(50_000).select((F.col("id") + 2 * n).alias("id"), F.lit(9.0), F.lit(9.0), F.lit(9.0)).toDF("id", "x", "y", "z")
    chain = spark.createDataFrame([(10**6 + i, 0.04 + 0.05 * i, 0.02, 0.02) for i in range(10)], POINTS)
    apart = {r.label: r["count"] for r in cluster.dbscan(cloud.unionByName(other).unionByName(copies), 0.1, 6).groupBy("label").count().collect()}
    assert apart == {0: n, n: n, 2 * n: 50_000}
    linked = {r.label: r["count"] for r in cluster.dbscan(cloud.unionByName(other).unionByName(chain), 0.1, 3).groupBy("label").count().collect()}
    assert linked == {0: 2 * n + 10}


def test_close_pairs_of_two_sets():
    rng = np.random.default_rng(1)
    for n in (1, 30, 3000):
        for gap in (0.05, 0.11, 0.2):
            a, b = rng.random((n, 3)) * [0.1, 1, 1], rng.random((n, 3)) * [0.1, 1, 1] + [0.1 + gap, 0, 0]
            want = min((((a[i] - b) ** 2).sum(1).min() for i in range(n))) <= 0.01
            assert cluster.close_pair(a, b, 0.1) == want


@pytest.mark.parametrize("stars", [False, True])
def test_components_end_alike(spark, stars):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), stars).collect()}
    root = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(50):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert connected_components(spark.createDataFrame([], "a long, b long"), stars).collect() == []
