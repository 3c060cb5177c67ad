"""Exact nearest neighbours in space by a k-d partition.

Medians of a sample of the points cut space into leaves of about ``LEAF`` points, wherever the points are, so a dense
foreground in a huge background has leaves as full as an even cloud. A query is compared with its own leaf first, then
with the leaves whose boxes are nearer than its k-th distance, nearest boxes first, until none is left. The tree (at most ``MAX_LEAVES`` leaves)
and its boxes are all that the driver holds and sends.

Points of one place are as good as the k of them with the smallest ids, and queries of one place have one answer, so copies
never meet copies. What meets in a leaf is dealt to pieces of ``PIECE`` rows on both sides; a task compares one piece with
one, by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofold.operators.shared import stash, unstash

XYZ = ("x", "y", "z")
#: Points of a leaf, about, and the most leaves: beyond MAX_LEAVES * LEAF points leaves get fuller.
LEAF, MAX_LEAVES = 2000, 1 << 17
#: Sampled points for each leaf.
SAMPLED = 8
#: Rows of either side that one task compares.
PIECE = 8192
#: Leaves that a query visits in the first round after its own one; each further round twice as many.
VISITS = 8
BLOCK = 256


class Tree:
    """Splits at a sample's medians along the widest side; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.value, self.child = [], [], []  # of inner nodes; child: node number, or -1 - leaf
        self.leaves = 0
        self.root = self._grow(sample, leaves)
        self.dim, self.value, self.child = np.array(self.dim, np.int64), np.array(self.value, float), np.array(self.child, np.int64).reshape(-1, 2)
        self.low, self.high = np.full((self.leaves, 3), np.inf), np.full((self.leaves, 3), -np.inf)

    def _grow(self, p: np.ndarray, leaves: int) -> int:
        sides = np.ptp(p, axis=0) if len(p) else np.zeros(3)
        if leaves < 2 or len(p) < 2 or not sides.max() > 0:
            self.leaves += 1
            return -self.leaves
        d = int(sides.argmax())
        values = np.sort(p[:, d])
        cut = values[len(values) // 2]
        if cut == values[0]:  # more than half of them lie on the lower side
            cut = values[values > cut][0]
        under = p[:, d] < cut
        node = len(self.dim)
        self.dim.append(d)
        self.value.append(float(cut))
        self.child.append((0, 0))
        self.child[node] = (self._grow(p[under], leaves // 2), self._grow(p[~under], leaves - leaves // 2))
        return node

    def leaf_of(self, p: np.ndarray) -> np.ndarray:
        at = np.full(len(p), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = self.child[node, (p[inner, self.dim[node]] >= self.value[node]).astype(int)]
        return -1 - at

    def set_boxes(self, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes of the points that leaves hold (empty ones: inside out), and of inner nodes."""
        self.low, self.high = low, high
        self.node_low, self.node_high = np.full((len(self.dim), 3), np.inf), np.full((len(self.dim), 3), -np.inf)
        for node in range(len(self.dim) - 1, -1, -1):  # children have higher numbers
            for c in self.child[node]:
                lo, hi = (self.node_low[c], self.node_high[c]) if c >= 0 else (low[-1 - c], high[-1 - c])
                self.node_low[node], self.node_high[node] = np.minimum(self.node_low[node], lo), np.maximum(self.node_high[node], hi)

    def _distance(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        inner = (at >= 0)[:, None]
        lo = np.where(inner, self.node_low[np.maximum(at, 0)] if len(self.dim) else np.inf, self.low[np.maximum(-1 - at, 0)])
        hi = np.where(inner, self.node_high[np.maximum(at, 0)] if len(self.dim) else -np.inf, self.high[np.maximum(-1 - at, 0)])
        away = np.maximum(np.maximum(lo - p, p - hi), 0)
        return away[:, 0] ** 2 + away[:, 1] ** 2 + away[:, 2] ** 2

    def within(self, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, squared distance of the box) of all leaves not farther than the queries' bounds, by query, then distance."""
        query, at = np.arange(len(p)), np.full(len(p), self.root)
        found = []
        while len(query):
            d = self._distance(p[query], at)
            near = (d <= bound[query]) & (d < np.inf)
            query, at, d = query[near], at[near], d[near]
            leaf = at < 0
            found.append((query[leaf], -1 - at[leaf], d[leaf]))
            query, at = np.repeat(query[~leaf], 2), self.child[at[~leaf]].ravel()
        query, leaf, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((leaf, d, query))
        return query[order], leaf[order], d[order]


def _compare(k: int):
    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        columns = lambda t, *names: [t[c].to_numpy() for c in names]
        q = np.array(columns(queries, *XYZ)).reshape(3, -1)
        bound = columns(queries, "bound")[0]
        j, *p = columns(points, "j", *(f"p{c}" for c in XYZ))
        order = np.argsort(j, kind="stable")
        j, p = j[order], [c[order] for c in p]
        who, ids, far = [], [], []
        for at in range(0, q.shape[1] if len(j) else 0, BLOCK):
            own = q[:, at : at + BLOCK]
            d = (own[0][:, None] - p[0]) ** 2 + (own[1][:, None] - p[1]) ** 2 + (own[2][:, None] - p[2]) ** 2
            most = np.minimum(bound[at : at + BLOCK], np.partition(d, k - 1, axis=1)[:, k - 1] if len(j) > k else np.inf)
            for i in range(own.shape[1]):
                near = np.flatnonzero(d[i] <= most[i])
                near = near[np.argsort(d[i][near], kind="stable")][:k]
                who.append(np.full(len(near), at + i))
                ids.append(j[near])
                far.append(d[i][near])
        who = np.concatenate(who) if who else np.zeros(0, np.int64)
        return pa.table([*(pa.array(c[who], pa.float64()) for c in q), pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(np.concatenate(far) if far else [], pa.float64())], [*XYZ, "j", "d2"])

    return run


def piece_counts(rows: DataFrame, piece: int) -> DataFrame:
    """(leaf, pieces): into how many pieces of about ``piece`` rows each leaf's rows go; at most ``MAX_LEAVES`` rows."""
    return rows.groupBy("leaf").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))


def dealt(rows: DataFrame, by: tuple[str, ...], counts: DataFrame, side: str) -> DataFrame:
    """rows with the piece of their leaf that they are in."""
    return rows.join(F.broadcast(counts), "leaf").withColumn(side, F.pmod(F.xxhash64(*by), F.col("pieces")).cast("int")).drop("pieces")


def everywhere(rows: DataFrame, counts: DataFrame, side: str) -> DataFrame:
    """rows once for each piece of their leaf on the other side."""
    return rows.join(F.broadcast(counts), "leaf").withColumn(side, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")


def knn(points: DataFrame, k: int, queries: DataFrame | None = None, payload: tuple[str, ...] = ()) -> DataFrame:
    """(i, rank, j, d2[, payload of j]): the k points nearest to each query, rank from 0, ties by j.

    points and queries have id, x, y, z. Without queries, points are asked for their own
    neighbours and find themselves too. Rows with null or non-finite places take no part.
    """
    finite = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in XYZ))
    place = [F.col(c).cast("double").alias(c) for c in XYZ]
    all_ = points.where(finite)
    asked = (points if queries is None else queries).where(finite).select(F.col("id").alias("i"), *place)
    first = Window.partitionBy(*(f"p{c}" for c in XYZ)).orderBy("j")
    useful = all_.select(F.col("id").cast("long").alias("j"), *(c.alias(f"p{n}") for c, n in zip(place, XYZ, strict=True))).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k).drop("__n")
    useful = stash(useful, "knn-points")
    n = useful.count()
    leaves = max(1, min(MAX_LEAVES, n // LEAF))
    share = min(1.0, SAMPLED * leaves / max(n, 1))
    sample = useful.where(F.pmod(F.xxhash64("j"), F.lit(1 << 30)) < int(share * (1 << 30))).select(*(f"p{c}" for c in XYZ)).toArrow() if leaves > 1 else None
    tree = Tree(np.array([c.to_numpy() for c in sample.columns]).T if sample is not None else np.zeros((0, 3)), leaves)

    def leaf_udf(t: Tree):
        @F.pandas_udf("int")
        def leaf(x, y, z):
            import pandas as pd

            return pd.Series(t.leaf_of(np.column_stack([x, y, z])), dtype="int32")

        return leaf

    home = leaf_udf(tree) if tree.leaves > 1 else lambda *_: F.lit(0)
    leafed = stash(useful.withColumn("leaf", home(*(f"p{c}" for c in XYZ))), "knn-leaves") if tree.leaves > 1 else useful.withColumn("leaf", F.lit(0))
    boxes = leafed.groupBy("leaf").agg(F.count("*"), *(f(f"p{c}") for f in (F.min, F.max) for c in XYZ)).collect()
    held = piece_counts(leafed, PIECE)
    low, high = np.full((tree.leaves, 3), np.inf), np.full((tree.leaves, 3), -np.inf)
    for r in boxes:
        low[r[0]], high[r[0]] = r[2:5], r[5:8]
    tree.set_boxes(low, high)

    state = asked.select(*XYZ).distinct().withColumn("home", home(*XYZ)).withColumn("done", F.lit(0)).withColumn("bound", F.lit(float("inf")))
    state = stash(state, "knn-state")
    visits, best, turn = state.select(*XYZ, "bound", F.col("home").alias("leaf")), None, VISITS
    while True:
        visits = stash(visits, "knn-visits")
        if best is not None and visits.isEmpty():
            break
        counts = piece_counts(visits, PIECE)
        left = everywhere(dealt(visits, XYZ, counts, "qp"), held, "pp")
        right = everywhere(dealt(leafed, ("j",), held, "pp"), counts, "qp")
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)
        met = left.groupBy("leaf", "qp", "pp").cogroup(right.groupBy("leaf", "qp", "pp")).applyInArrow(_compare(k), "x double, y double, z double, j long, d2 double")
        ranked = (met if best is None else met.unionByName(best.select(*XYZ, "j", "d2"))).withColumn("rank", F.row_number().over(Window.partitionBy(*XYZ).orderBy("d2", "j")) - 1)
        after = stash(ranked.where(F.col("rank") < k), "knn")
        unstash(best)
        unstash(visits)
        best = after
        if tree.leaves == 1:
            break
        bounds = best.where(F.col("rank") == k - 1).select(*XYZ, F.col("d2").alias("now"))
        state = stash(state.drop("bound").join(bounds, list(XYZ), "left").withColumn("bound", F.coalesce("now", F.lit(float("inf")))).drop("now"), "knn-state")
        visits, state, turn = *_next_visits(state, tree, turn), turn * 2
    answers = asked.join(best, list(XYZ)).select("i", "rank", "j", "d2")
    return answers.join(all_.select(F.col("id").cast("long").alias("j"), *payload), "j").select("i", "rank", "j", "d2", *payload) if payload else answers


def _next_visits(state: DataFrame, tree: Tree, turn: int) -> tuple[DataFrame, DataFrame]:
    """The next leaves of each query that may hold nearer points, and the state after them. Leaves come in the order of their boxes, own ones aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, z, home, done, bound = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            query, leaf, _ = tree.within(np.column_stack([x, y, z]), bound)
            other = leaf != home[query]
            query, leaf = query[other], leaf[other]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            now = (place >= done[query]) & (place < done[query] + turn)
            query, leaf = query[now], leaf[now]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[query]) for c in (x, y, z, bound)), pa.array(leaf.astype(np.int32))], [*XYZ, "bound", "leaf"])

    visits = state.select(*XYZ, "home", "done", "bound").mapInArrow(run, "x double, y double, z double, bound double, leaf int")
    return visits, state.withColumn("done", F.col("done") + turn)


#: Other leaves up to which a point's neighbours are brought to its own leaf, and rows of needs up to which they are sent to all tasks.
NEAR_LEAVES, SENT = 64, 1 << 18
#: Points of a block of neighbours.
CLOSE = 128


def _blocks(p: np.ndarray) -> list[np.ndarray]:
    """Numbers of the points, neighbours together: halved along the widest side until a block is small."""
    done, left = [], [np.arange(len(p))] if len(p) else []
    while left:
        own = left.pop()
        if len(own) <= CLOSE:
            done.append(own)
            continue
        d = int(np.ptp(p[own], axis=0).argmax())
        own = own[np.argpartition(p[own, d], len(own) // 2)]
        left += [own[: len(own) // 2], own[len(own) // 2 :]]
    return done


def _squares(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (q[:, 0, None] - p[:, 0]) ** 2 + (q[:, 1, None] - p[:, 1]) ** 2 + (q[:, 2, None] - p[:, 2]) ** 2


def _block_nearest(q: np.ndarray, p: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block of queries, numbers of the points near it, squared distances, each query's k-th one); the first points are the queries. Infinite where points are fewer than k."""
    for block in _blocks(q):
        own = q[block]
        reach = np.sqrt(np.partition(_squares(own, own), k - 1, axis=1)[:, k - 1].max()) * (1 + 1e-9) if len(own) >= k else np.inf
        near = np.flatnonzero(((p >= own.min(0) - reach) & (p <= own.max(0) + reach)).all(axis=1))
        d = _squares(own, p[near])
        yield block, near, d, np.partition(d, k - 1, axis=1)[:, k - 1] if len(near) >= k else np.full(len(own), np.inf)


_PLACES = [f"p{c}" for c in XYZ]
_BOX = [f"{e}{c}" for e in ("lo", "hi") for c in XYZ]
_NEEDS = "leaf int, src int, j long, " + ", ".join(f"{c} double" for c in _BOX)


def _needs(tree: Tree, k: int):
    """What a leaf's points need of other leaves: a box of each. A point that may need very many leaves is named instead (leaf -1, its id and place)."""

    def run(t: pa.Table) -> pa.Table:
        src, j, p = t["leaf"][0].as_py(), t["j"].to_numpy(), np.column_stack([t[c].to_numpy() for c in _PLACES])
        who, other, far = [], [], np.zeros(len(p), bool)
        reach = np.zeros(len(p))
        for block, _, _, kth in _block_nearest(p, p, k):
            reach[block] = np.sqrt(kth) * (1 + 1e-9)
            some = block[np.isfinite(kth)]
            far[block] = ~np.isfinite(kth)
            query, leaf, _ = tree.within(p[some], reach[some] ** 2 * (1 + 1e-9))
            query, leaf = query[leaf != src], leaf[leaf != src]
            many = np.bincount(query, minlength=len(some)) > NEAR_LEAVES
            far[some] = many
            who.append(some[query[~many[query]]])
            other.append(leaf[~many[query]])
        who, other = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, other))
        order = np.argsort(other, kind="stable")
        who, other = who[order], other[order]
        starts = np.flatnonzero(np.r_[True, other[1:] != other[:-1]]) if len(other) else np.zeros(0, np.int64)
        low, high = p - reach[:, None], p + reach[:, None]
        boxes = [np.minimum.reduceat(low[who], starts), np.maximum.reduceat(high[who], starts)] if len(starts) else [np.zeros((0, 3))] * 2
        named = np.flatnonzero(far)
        leaf = np.r_[other[starts], np.full(len(named), -1)].astype(np.int32)
        numbers = np.r_[np.column_stack(boxes), np.column_stack([p[named], p[named]])]
        ids = np.r_[np.zeros(len(starts), np.int64), j[named]]
        return pa.table([pa.array(leaf), pa.array(np.full(len(leaf), src, np.int32)), pa.array(ids), *(pa.array(c) for c in numbers.T)], ["leaf", "src", "j", *_BOX])

    return run


def _answered(k: int):
    """(i, rank, j, d2) of a leaf's points; those named as far (their id and place) take no part as queries."""

    def run(own: pa.Table, brought: pa.Table) -> pa.Table:
        columns = lambda t: (t["j"].to_numpy(), np.column_stack([t[c].to_numpy() for c in _PLACES]))
        (i, q), (other, p), named = columns(own), columns(brought), brought["named"].to_numpy(zero_copy_only=False).astype(bool)
        key = lambda j, x: np.rec.fromarrays([j, *x.T])
        asked = ~np.isin(key(i, q), key(other[named], p[named])) if named.any() else np.ones(len(i), bool)
        ids, places = np.r_[i, other[~named]], np.r_[q, p[~named]]
        order = np.argsort(ids, kind="stable")
        ids, places = ids[order], places[order]
        i, q = i[asked], q[asked]
        out = []
        for block, near, d, kth in _block_nearest(q, places, k):
            row, column = np.nonzero(d <= kth[:, None])
            order = np.lexsort((near[column], d[row, column], row))  # near points are in order of their ids
            row, column = row[order], column[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, column, rank = row[rank < k], column[rank < k], rank[rank < k]
            out.append((i[block[row]], rank.astype(np.int32), ids[near[column]], d[row, column]))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(c) if out else [], t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, types, strict=True)], ["i", "rank", "j", "d2"])

    return run


def self_knn(points: DataFrame, k: int) -> DataFrame:
    """The same rows as ``knn(points, k)`` for many points, ids being different longs: what a leaf's points need of other leaves is brought there once.

    A point's k-th distance in its own leaf bounds what it needs; the points of other leaves in those bounds come to the leaf, which then answers. No
    candidates are written or merged, and the answer isn't written either: use it once. Points that may need more than
    ``NEAR_LEAVES`` leaves, and those of leaves with fewer than k points, are asked in rounds, as in ``knn``; copies of a place beyond k have their first one's answer.
    ``points`` is read four times: write it if it is dear.
    """
    finite = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in XYZ))
    all_ = points.where(finite).select(F.col("id").cast("long").alias("j"), *(F.col(c).cast("double").alias(f"p{c}") for c in XYZ))
    n = all_.count()
    leaves = max(1, min(MAX_LEAVES, n // LEAF))
    if leaves == 1:
        return knn(points, k)
    share = SAMPLED * leaves / n
    sample = all_.where(F.pmod(F.xxhash64("j"), F.lit(1 << 30)) < int(share * (1 << 30))).select(*_PLACES).toArrow()
    tree = Tree(np.array([c.to_numpy() for c in sample.columns]).T, leaves)

    @F.pandas_udf("int")
    def home(x, y, z):
        import pandas as pd

        return pd.Series(tree.leaf_of(np.column_stack([x, y, z])), dtype="int32")

    first = Window.partitionBy(*_PLACES).orderBy("j")
    placed = all_.withColumn("__n", F.row_number().over(first)).withColumn("first", F.when(F.col("__n") > k, F.first("j").over(first))).drop("__n")
    leafed = stash(placed.withColumn("leaf", home(*_PLACES)), "knn-leaves")
    copies, useful = leafed.where("first IS NOT NULL"), leafed.where("first IS NULL").select("leaf", "j", *_PLACES)
    low, high = np.full((tree.leaves, 3), np.inf), np.full((tree.leaves, 3), -np.inf)
    for r in useful.groupBy("leaf").agg(*(f(c) for f in (F.min, F.max) for c in _PLACES)).collect():
        low[r[0]], high[r[0]] = r[1:4], r[4:7]
    tree.set_boxes(low, high)
    needs = stash(useful.groupBy("leaf").applyInArrow(_needs(tree, k), _NEEDS), "knn-needs")
    boxes = needs.where("leaf >= 0").drop("j")
    if boxes.count() <= SENT:
        boxes = F.broadcast(boxes)
    inside = reduce(lambda a, b: a & b, (F.col(f"p{c}").between(F.col(f"lo{c}"), F.col(f"hi{c}")) for c in XYZ))
    named = needs.where("leaf < 0").select("src", "j", *(F.col(f"lo{c}").alias(f"p{c}") for c in XYZ))
    brought = useful.join(boxes, "leaf").where(inside).select("src", "j", *_PLACES, F.lit(False).alias("named")).unionByName(named.withColumn("named", F.lit(True)))
    left, right = useful.toDF("src", "j", *_PLACES), brought.toDF(*brought.columns)
    answers = left.groupBy("src").cogroup(right.groupBy("src")).applyInArrow(_answered(k), "i long, rank int, j long, d2 double")
    far = named.select(F.col("j").alias("id"), *(F.col(f"p{c}").alias(c) for c in XYZ))
    if not far.isEmpty():
        answers = answers.unionByName(knn(points, k, far))
    if not copies.isEmpty():
        again = answers.join(copies.select(F.col("first").alias("i"), F.col("j").alias("copy")), "i").select(F.col("copy").alias("i"), "rank", "j", "d2")
        answers = answers.unionByName(again)
    return answers


def mean_squared(neighbours: DataFrame, ranks: tuple[int, int]) -> DataFrame:
    """Mean squared distance over ranks first..last."""
    return neighbours.where(F.col("rank").between(*ranks)).groupBy("i").agg(F.avg("d2").alias("mean_d2"))


def local_variance(neighbours: DataFrame, value: str) -> DataFrame:
    """Mean squared deviation of a value from its neighbourhood's mean."""
    return neighbours.groupBy("i").agg(F.var_pop(value).alias("variance"))


def outliers_kept(neighbours: DataFrame, std_ratio: float) -> DataFrame:
    """(i, mean_d, kept): kept if the mean distance isn't over the mean by std_ratio deviations (sample deviation)."""
    each = neighbours.groupBy("i").agg(F.avg(F.sqrt("d2")).alias("mean_d"))
    limits = each.agg((F.avg("mean_d") + std_ratio * F.coalesce(F.stddev_samp("mean_d"), F.lit(0.0))).alias("most"))
    return each.join(F.broadcast(limits)).select("i", "mean_d", (F.col("mean_d") <= F.col("most")).alias("kept"))
