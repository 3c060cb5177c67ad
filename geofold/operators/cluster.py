"""Density clustering without pairs of points, and the keep rules built on it.

Space is cut into cells in which any two points are neighbours, so a cell with enough points has cores only and is one node, whatever
it holds; copies of a place are one point with a count. Points of the other cells (fewer than ``min_samples`` each) are
compared with the points around them; what is kept of that is one row for each cell or thin point nearby. Two full cells are linked if their
outermost points are close, not if their boxes are too far apart; only pairs that neither decides and that nothing
else links yet are searched for a close pair of points, in halves, so a cell of n points costs about n.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofold.operators.components import connected_components
from geofold.operators.knn import XYZ
from geofold.operators.shared import stash, unstash

#: Places of a cell that one task compares; undecided cells' places that are searched without asking first what is linked otherwise.
PIECE, FEW = 1 << 16, 1 << 20
CELL = ("cx", "cy", "cz")


def _cell(width: float, step: tuple[int, ...] = (0, 0, 0), names=CELL) -> list[Column]:
    return [(F.floor(F.col(c) / width).cast("long") + d).alias(n) for c, d, n in zip(XYZ, step, names, strict=True)]


def _steps(reach: int) -> list[tuple[int, int, int]]:
    side = range(-reach, reach + 1)
    return [(a, b, c) for a in side for b in side for c in side]


def _stepped(rows: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """rows once for each step, their cell moved on by it."""
    moves = ", ".join(f"named_struct('cx', {a}L, 'cy', {b}L, 'cz', {c}L)" for a, b, c in steps)
    return rows.withColumn("__s", F.expr(f"explode(array({moves}))")).withColumns({n: F.col(n) + F.col(f"__s.{n}") for n in CELL}).drop("__s")


def _far(p, q) -> Column:
    return reduce(lambda a, b: a + b, ((x - y) * (x - y) for x, y in zip(p, q, strict=True)))


def _near_thin(thin: DataFrame, places: DataFrame, eps: float) -> DataFrame:
    """(i, node, full, w): how many points each thin point has within eps, itself included, by the full cell or the thin point that they are."""
    width = eps * 1.001
    right = places.select(*_cell(width), *(F.col(c).alias(f"p{c}") for c in XYZ), "w", F.coalesce("cell_node", "node").alias("node"), F.col("cell_node").isNotNull().alias("full"))
    left = _stepped(thin.select(F.col("node").alias("i"), *XYZ, *_cell(width)), _steps(1))
    keys = list(CELL)
    if places.count() > PIECE:  # else no cell has more
        crowded = stash(right.groupBy(*CELL).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).where("pieces > 1"), "cluster-crowded")
        pieces = F.coalesce("pieces", F.lit(1))
        right = right.join(crowded, list(CELL), "left").withColumn("piece", F.pmod(F.xxhash64("px", "py", "pz"), pieces).cast("int")).drop("pieces")
        left = left.join(crowded, list(CELL), "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
        keys.append("piece")
    close = _far([F.col(c) for c in XYZ], [F.col(f"p{c}") for c in XYZ]) <= eps * eps
    return left.join(right, keys).where(close).groupBy("i", "node", "full").agg(F.sum("w").alias("w"))


def close_pair(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a point of a (n, 3) and one of b are at most eps apart: the larger part is halved at its widest side's median; parts whose boxes are too far apart are dropped."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        away = np.maximum(np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)), 0)
        if (away * away).sum() > eps * eps:
            continue
        if len(a) * len(b) <= 1 << 12:
            if (((a[:, None] - b) ** 2).sum(2) <= eps * eps).any():
                return True
            continue
        if len(a) < len(b):
            a, b = b, a
        side = int(np.ptp(a, axis=0).argmax())
        order = np.argpartition(a[:, side], len(a) // 2)
        todo += [(a[order[: len(a) // 2]], b), (a[order[len(a) // 2 :]], b)]
    return False


def _links_of_full(full: DataFrame, places: DataFrame, sure: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Links (i, j) between full cells that outermost points show, and those that a search finds among the rest."""
    side = lambda k: full.select(*CELL, *(F.col(c).alias(f"{k}_{c}") for c in ("node", "low", "high", "outer", "total")))
    met = _stepped(side("a"), [s for s in _steps(2) if s > (0, 0, 0)]).join(side("b"), list(CELL))
    at = lambda p: [p["x"], p["y"], p["z"]]
    gap = reduce(lambda a, b: a + b, (F.pow(F.greatest(F.lit(0.0), F.col(f"a_low.{c}") - F.col(f"b_high.{c}"), F.col(f"b_low.{c}") - F.col(f"a_high.{c}")), F.lit(2)) for c in XYZ))
    met = met.where(gap <= eps * eps)
    linked = F.exists("a_outer", lambda p: F.exists("b_outer", lambda q: _far(at(p), at(q)) <= eps * eps))
    met = stash(met.select("a_node", "b_node", "a_low", "a_high", "b_low", "b_high", "a_total", "b_total", linked.alias("linked")), "cluster-cells")
    shown, rest = met.where("linked").select(F.col("a_node").alias("i"), F.col("b_node").alias("j")), met.where("NOT linked")
    work = rest.agg(F.sum(F.col("a_total") + F.col("b_total"))).first()[0] or 0
    if not work:
        return shown, shown.limit(0)
    if work > FEW:
        roots = stash(connected_components(sure.unionByName(shown), stars=True), "cluster-roots")
        for k in "ab":
            rest = rest.join(roots.select(F.col("node").alias(f"{k}_node"), F.col("root").alias(f"{k}_root")), f"{k}_node", "left")
        rest = rest.where("NOT coalesce(a_root = b_root, false)")
    rest = stash(rest.select("a_node", "b_node", *(F.col(f"{k}_{s}") for k in "ab" for s in ("low", "high")), *(F.ceil(F.col(f"{k}_total") / PIECE).cast("int").alias(f"{k}_pieces") for k in "ab")), "cluster-rest")

    def members(k: str, other: str) -> DataFrame:
        """Places of a side that lie within eps of the other side's box, dealt to pieces and to each piece of the other side."""
        own = places.where("cell_node IS NOT NULL").select(F.col("cell_node").alias(f"{k}_node"), *XYZ).join(rest, f"{k}_node")
        off = [F.greatest(F.lit(0.0), F.col(f"{other}_low.{c}") - F.col(c), F.col(c) - F.col(f"{other}_high.{c}")) for c in XYZ]
        near = own.where(reduce(lambda a, b: a + b, (o * o for o in off)) <= eps * eps)
        dealt = near.withColumn(f"{k}_piece", F.pmod(F.xxhash64(*XYZ), F.col(f"{k}_pieces"))).withColumn(f"{other}_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_pieces").cast("long") - 1)))
        return dealt.select("a_node", "b_node", "a_piece", "b_piece", *XYZ)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p, q = (np.column_stack([t[c].to_numpy() for c in XYZ]) for t in (left, right))
        some = left if len(left) else right
        found = 1 if close_pair(p, q, eps) else 0
        return pa.table([some[c].slice(0, found).cast(pa.int64()) for c in ("a_node", "b_node")], ["i", "j"])

    keys = ["a_node", "b_node", "a_piece", "b_piece"]
    left, right = members("a", "b"), members("b", "a")
    return shown, left.groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys)).applyInArrow(run, "i long, j long").distinct()


def dbscan(points: DataFrame, eps: float, min_samples: int = 6) -> DataFrame:
    """(id, label): clusters numbered by their smallest core id, -1 for noise.

    A core has min_samples points within eps, itself included; a border point joins the
    cluster with the smallest label among its cores. Points with null or non-finite places are noise.
    """
    own = points.select("id", *(F.col(c).cast("double").alias(c) for c in XYZ))
    finite = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in XYZ))
    width = eps / math.sqrt(3) * 0.999  # a little less, so that rounding puts no two far points in one cell
    single = stash(own.where(finite).groupBy(*XYZ).agg(F.min(F.col("id").cast("long")).alias("node"), F.count("*").alias("w")).select("*", *_cell(width)), "cluster-places")
    place = F.struct(*XYZ)
    cells = single.groupBy(*CELL).agg(F.sum("w").alias("total"), F.min("node").alias("node"), F.struct(*(F.min(c).alias(c) for c in XYZ)).alias("low"), F.struct(*(F.max(c).alias(c) for c in XYZ)).alias("high"), F.array(*(f(place, c) for f in (F.min_by, F.max_by) for c in XYZ)).alias("outer"))
    full = stash(cells.where(F.col("total") >= min_samples), "cluster-full")
    places = stash(single.join(full.select(*CELL, F.col("node").alias("cell_node")), list(CELL), "left").drop(*CELL), "cluster-placed")
    unstash(single)
    thin = places.where("cell_node IS NULL")
    near = stash(_near_thin(thin, places, eps), "cluster-near")
    cores = stash(near.groupBy("i").agg(F.sum("w").alias("n")).where(F.col("n") >= min_samples).select("i"), "cluster-cores")
    to_core = near.where("full").unionByName(near.where("NOT full").join(cores.select(F.col("i").alias("node")), "node", "left_semi").select(near.columns))
    sure = to_core.join(cores, "i", "left_semi").where("i != node").select("i", F.col("node").alias("j"))
    shown, found = _links_of_full(full, places, sure, eps)
    roots = connected_components(sure.unionByName(shown).unionByName(found), stars=True)
    core_nodes = cores.select(F.col("i").alias("node")).unionByName(full.select("node"))
    labels = core_nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"))
    border = to_core.join(cores, "i", "left_anti").join(labels, "node").groupBy(F.col("i").alias("node")).agg(F.min("label").alias("label"))
    labelled = places.withColumn("key", F.coalesce("cell_node", "node")).join(labels.unionByName(border).withColumnRenamed("node", "key"), "key").select(*XYZ, "label")
    return own.join(labelled, list(XYZ), "left").select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.where("label >= 0").groupBy("label").agg(F.count("*").alias("size"))


def kept_clusters(labels: DataFrame, least_share: float = 0.002, largest_only: bool = False) -> DataFrame:
    """(id, label, kept): members of clusters of at least that share of all rows; else of the largest one; all, if all is noise."""
    sizes = cluster_sizes(labels)
    n = labels.agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("size").alias("most"), F.min_by("label", F.struct(-F.col("size"), "label")).alias("first"))
    big = F.lit(False) if largest_only else F.col("size") >= least_share * F.col("n")
    judged = sizes.join(F.broadcast(n)).join(F.broadcast(most)).withColumn("big", big)
    any_big = judged.agg(F.coalesce(F.max("big"), F.lit(False)).alias("any_big"), F.count("*").alias("clusters"))
    good = judged.join(F.broadcast(any_big)).select("label", F.when(F.col("any_big"), F.col("big")).otherwise(F.col("label") == F.col("first")).alias("good"))
    return labels.join(good, "label", "left").join(F.broadcast(any_big.select("clusters"))).select("id", "label", F.when(F.col("clusters") == 0, True).otherwise(F.coalesce("good", F.lit(False))).alias("kept"))
