"""Exact distance of points to triangles, by a partition of the triangles' boxes.

Triangles are dealt to leaves by the place of their boxes' centres and by their size, so that a few large triangles don't widen the boxes
of many small ones: each class of sizes has a k-d tree of its own over a bounded sample of centres. A leaf's box holds
its triangles whole. A point meets the leaf nearest to it first; then, in rounds, those whose boxes are nearer than the nearest triangle
found so far, nearest boxes first, until none is left. The driver holds trees and boxes of at most ``MAX_LEAVES`` leaves, whatever the number of triangles.

Points of one place have one answer. What meets in a leaf is dealt to pieces on both sides; a task compares one piece with one. Its points
are cut into blocks of neighbours: a block keeps the triangles whose planes, boxes and sides come near its own box, then each of its points those whose planes
and boxes are nearer than its present best, and only these are measured.

Classes of triangles so large that a point would visit many of their leaves have no leaves: chunks of them meet blocks of points where they stand. Two
rounds over samples give bounds, the last one meets all triangles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofold.operators.knn import MAX_LEAVES, SAMPLED, XYZ, Tree, dealt, everywhere, piece_counts
from geofold.operators.shared import bounded_batches, stash, unstash

#: Triangles of a leaf, about; triangles and points that one task compares.
LEAF, PIECE, POINTS = 1000, 4096, 16384
#: Classes of sizes: a class reaches up to so many times the size of the next smaller one; the last takes all above.
STEP, CLASSES = 4.0, 16
#: Leaves that a point visits in the round after its first one; each further round four times as many.
VISITS = 16
#: Points of a block, compared at once; triangles that points meet first, where nothing is known of their distances.
BLOCK, FIRST = 128, 256
#: Blocks of a group; triangles that are held against a group's blocks at once.
GROUP, TILE = 16, 4096
#: Triangles of a class meet all points where a point would visit more than this share of the class's leaves; a task compares so many of them with so many points.
WIDE, CHUNK, SPREAD = 1 / 64, 1 << 16, 1 << 17
#: One in so many triangles gives a first bound, one in so many a second one.
SAMPLES = (1024, 32)
#: Leaves of points that a task notes at once.
NOTED = 1 << 20

CORNERS = [f"{k}{c}" for k in "abc" for c in XYZ]


def point_triangle(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of points to triangles, row by row (n, 3): to the plane's foot where that lies inside, else to the nearest side."""
    dot = lambda x, y: (x * y).sum(-1)

    def side(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        along = v - u
        size = dot(along, along)
        t = np.clip(np.divide(dot(p - u, along), size, where=size > 0, out=np.zeros(len(u))), 0, 1)
        off = p - u - t[:, None] * along
        return dot(off, off)

    out = np.minimum(np.minimum(side(a, b), side(b, c)), side(c, a))
    n = np.cross(b - a, c - a)
    size = dot(n, n)
    inside = (size > 0) & (dot(np.cross(b - a, p - a), n) >= 0) & (dot(np.cross(c - b, p - b), n) >= 0) & (dot(np.cross(a - c, p - c), n) >= 0)
    foot = np.divide(dot(p - a, n) ** 2, size, where=size > 0, out=np.full(len(out), np.inf))
    return np.where(inside, np.minimum(out, foot), out)


def _blocks(p: np.ndarray) -> list[np.ndarray]:
    """Numbers of the points, neighbours together: halved along the widest side until a block is small."""
    done, left = [], [np.arange(len(p))] if len(p) else []
    while left:
        own = left.pop()
        if len(own) <= BLOCK:
            done.append(own)
            continue
        d = int(np.ptp(p[own], axis=0).argmax())
        own = own[np.argpartition(p[own, d], len(own) // 2)]
        left += [own[: len(own) // 2], own[len(own) // 2 :]]
    return done


def _compared(p: np.ndarray, bound: np.ndarray, fid: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the point, fid, squared distance): the nearest of these triangles (9, n) to each point for which it may be the nearest of all; ties to the smallest fid.

    Groups of blocks, then blocks keep the triangles whose planes, boxes and sides come near their own boxes, then points those whose planes do. All this
    is in single precision around the block, with more slack than its rounding; what is left is measured in double precision.
    """
    if not len(p) or not len(fid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    known = bool(np.isfinite(bound).all())
    if not known:  # the first triangles shall be from anywhere
        order = np.random.default_rng(0).permutation(len(fid))
        fid, corners = fid[order], corners[:, order]
    a, b, c = corners[:3], corners[3:6], corners[6:]
    origin = p.mean(0)
    scale = max(np.abs(p - origin).max(), np.abs(corners.reshape(3, 3, -1) - origin[:, None]).max()) or 1.0
    p1, (a1, b1, c1) = (p - origin) / scale, ((x - origin[:, None]) / scale for x in (a, b, c))  # within 1 of the origin
    low, high = np.minimum(np.minimum(a1, b1), c1), np.maximum(np.maximum(a1, b1), c1)
    norm = lambda x: np.sqrt((x * x).sum(0))
    n = np.cross(b1 - a1, c1 - a1, axis=0)
    size = norm(n)
    flat = size > 1e-6 * norm(b1 - a1) * norm(c1 - a1)  # of slivers the plane isn't known well, and only the box counts
    n = np.divide(n, size, where=flat, out=np.zeros_like(n))
    inward = []
    for x, y in ((a1, b1), (b1, c1), (c1, a1)):
        e = np.cross(n, y - x, axis=0)
        inward.append(np.divide(e, norm(e), where=flat & (norm(e) > 0), out=np.zeros_like(e)))
    planes = np.vstack([n, -(n * a1).sum(0)]).T.copy()  # a triangle's numbers lie together
    rows = np.vstack([np.abs(n), (low + high) / 2, (high - low) / 2, *(np.vstack([e, -(e * x).sum(0)]) for e, x in zip(inward, (a1, b1, c1), strict=True))]).T.astype(np.float32, order="C")
    blocks = _blocks(p1)
    lows, highs = (np.array([f(p1[block], axis=0) for block in blocks]) for f in (np.min, np.max))
    least = bound.copy()
    if not known:
        for block in blocks:
            least[block] = np.minimum(least[block], sum((p[block, k, None] - corners[k::3, :FIRST].sum(0) / 3) ** 2 for k in range(3)).min(1))
    most = np.array([least[block].max() for block in blocks])
    near, far = np.full(len(p), np.iinfo(np.int64).max), np.full(len(p), np.inf)

    def met(lo: np.ndarray, hi: np.ndarray, reach: np.ndarray, planes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(box, triangle): whether the plane and the box of the triangle may come within reach of the box."""
        mid, half, reach = (lo + hi) / 2, ((hi - lo) / 2).astype(np.float32), (reach + 2e-6).astype(np.float32)[:, None]
        middle, out = mid.astype(np.float32), np.empty((len(lo), len(planes)), bool)
        for at in range(0, len(planes), TILE):
            tile = np.ascontiguousarray(rows[at : at + TILE, :9].T)
            plane = planes[at : at + TILE].T.astype(np.float32, order="C")
            off = middle @ plane[:3]
            off += plane[3]
            np.abs(off, out=off)
            off -= half @ tile[:3]
            keep = off <= reach
            for x in range(3):
                np.subtract(tile[3 + x], middle[:, x, None], out=off)
                np.abs(off, out=off)
                off -= tile[6 + x]
                keep &= off <= half[:, x, None] + reach
            out[:, at : at + TILE] = keep
        return out

    def candidates(k: int, planes: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, triangle) of a block."""
        lo, hi, block = lows[k], highs[k], blocks[k]
        mid, half, reach = (lo + hi) / 2, (hi - lo) / 2, np.float32(np.sqrt(most[k]) / scale + 2e-6)
        inside = np.ones(len(at), bool)
        for x in (9, 13, 17):
            e = rows[:, x : x + 3]
            inside &= e @ mid.astype(np.float32) + rows[:, x + 3] + np.abs(e) @ half.astype(np.float32) >= -reach
        inside = np.flatnonzero(inside)
        planes, at = planes.take(inside, axis=0), at[inside]
        own = p[block]
        reach = np.sqrt(least[block]) / scale * (1 + 1e-6) + 2e-6 * half.max() + 1e-8
        off = (p1[block] - mid).astype(np.float32) @ planes[:, :3].T.astype(np.float32, order="C")
        off += (planes[:, :3] @ mid + planes[:, 3]).astype(np.float32)
        np.abs(off, out=off)
        hits = np.flatnonzero((off <= reach[:, None].astype(np.float32)).ravel())
        i, j = np.divmod(hits, len(at))
        j, reach = at[j], reach * scale
        for x in range(3):
            boxed = (np.minimum(np.minimum(a[x, j], b[x, j]), c[x, j]) <= own[i, x] + reach[i]) & (np.maximum(np.maximum(a[x, j], b[x, j]), c[x, j]) >= own[i, x] - reach[i])
            i, j = i[boxed], j[boxed]
        return block[i], j

    def measure(i: np.ndarray, j: np.ndarray) -> None:
        d = point_triangle(p[i], a[:, j].T, b[:, j].T, c[:, j].T)
        best = np.lexsort((fid[j], d, i))
        best = best[np.r_[True, i[best[1:]] != i[best[:-1]]]]
        who, d, f = i[best], d[best], fid[j[best]]
        better = (d < far[who]) | ((d == far[who]) & (f < near[who]))
        far[who[better]], near[who[better]] = d[better], f[better]
        least[who] = np.minimum(least[who], d)

    starts = np.arange(0, len(blocks), GROUP)
    glow, ghigh = np.minimum.reduceat(lows, starts), np.maximum.reduceat(highs, starts)
    done = 0
    while done < len(fid):  # few triangles first, where nothing is known yet
        end = len(fid) if known else min(len(fid), max(4 * done, FIRST))
        grouped = met(glow, ghigh, np.sqrt(np.maximum.reduceat(most, starts)) / scale, planes[done:end], rows[done:end])
        for g, first in enumerate(starts):
            at = np.flatnonzero(grouped[g]) + done
            some_planes, some, own = planes.take(at, axis=0), rows.take(at, axis=0), slice(first, first + GROUP)
            found = []
            for k, keep in enumerate(met(lows[own], highs[own], np.sqrt(most[own]) / scale, some_planes, some), first):
                if len(kept := np.flatnonzero(keep)):
                    found.append(candidates(k, some_planes.take(kept, axis=0), some.take(kept, axis=0), at[kept]))
            if sum(len(i) for i, _ in found):
                measure(*(np.concatenate(x) for x in zip(*found, strict=True)))
                most[own] = [least[block].max() for block in blocks[own]]
        done = end
    who = np.flatnonzero((far <= bound * (1 + 1e-9)) & (far < np.inf))
    return who, near[who], far[who]


def _nearest(points: pa.Table, faces: pa.Table) -> pa.Table:
    """(x, y, z, fid, d2) of a piece of points and one of triangles."""
    p = np.column_stack([points[c].to_numpy() for c in XYZ])
    who, near, far = _compared(p, points["bound"].to_numpy(), faces["fid"].to_numpy(), np.array([faces[c].to_numpy() for c in CORNERS]).reshape(9, -1))
    return pa.table([*(pa.array(p[who, k]) for k in range(3)), pa.array(near), pa.array(far)], [*XYZ, "fid", "d2"])


class Forest:
    """A tree of leaves for each class of sizes; leaves are numbered on from class to class."""

    def __init__(self, samples: dict[int, np.ndarray], leaves: dict[int, int]):
        self.trees = {k: Tree(samples[k], leaves[k]) for k in sorted(samples)}
        self.first = dict(zip(self.trees, np.cumsum([0, *(t.leaves for t in self.trees.values())]).tolist(), strict=False))
        self.leaves = sum(t.leaves for t in self.trees.values())

    def leaf_of(self, kind: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(kind), np.int64)
        for k, tree in self.trees.items():
            own = kind == k
            out[own] = tree.leaf_of(p[own]) + self.first[k]
        return out

    def set_boxes(self, low: np.ndarray, high: np.ndarray) -> None:
        for k, tree in self.trees.items():
            own = slice(self.first[k], self.first[k] + tree.leaves)
            tree.set_boxes(low[own], high[own])

    def within(self, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves not farther than the points' bounds, by point, then distance."""
        found = [(q, leaf + self.first[k], d) for k, tree in self.trees.items() for q, leaf, d in [tree.within(p, bound)]]
        query, leaf, d = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((leaf, d, query))
        return query[order], leaf[order]

    def home(self, p: np.ndarray) -> np.ndarray:
        """A leaf with a triangle near each point: of the leaves that points fall into, the one with the nearest box."""
        best, out = np.full(len(p), np.inf), np.zeros(len(p), np.int64)
        for k, tree in self.trees.items():
            leaf = tree.leaf_of(p)
            away = np.maximum(np.maximum(tree.low[leaf] - p, p - tree.high[leaf]), 0)
            d = np.where(np.isfinite(tree.low[leaf, 0]), (away**2).sum(1), np.inf)
            out, best = np.where(d < best, leaf + self.first[k], out), np.minimum(d, best)
        return out


def _bounded(state: DataFrame, best: DataFrame) -> DataFrame:
    """state with bounds from the nearest triangles so far."""
    return state.drop("bound").join(best.select(*XYZ, (F.col("d2") * (1 + 1e-9)).alias("bound")), list(XYZ), "left").na.fill(float("inf"), ["bound"])


def _wide_distances(state: DataFrame, faces: DataFrame, n: int) -> DataFrame:
    """(x, y, z, fid, d2) of the nearest of n triangles that reach across much of space: chunks of them meet blocks of points where they stand, and nothing but answers is shuffled."""
    places, best = state.count(), None
    for one_in in (*(x for x in SAMPLES if n > x * LEAF), 1):
        some = faces if one_in == 1 else faces.where(F.pmod(F.xxhash64("fid"), F.lit(one_in)) == 0)
        first = best is None
        if first and one_in > 1:
            some = some.repartition(max(1, n // one_in // CHUNK))
        now = state if first else _bounded(state, best)
        blocks = places // (POINTS if first else SPREAD) + 1
        packed_points = stash(now.groupBy(F.pmod(F.xxhash64(*XYZ), F.lit(blocks)).alias("block")).applyInArrow(_points_packed, "points binary"), "boxes-points")

        def pack(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for b in batches:
                own = np.vstack([c.to_numpy(zero_copy_only=False).view(np.float64) for c in b.columns])  # fid's bits as they are
                for at in range(0, own.shape[1], chunk):
                    held.append(own[:, at : at + chunk])
                    if sum(x.shape[1] for x in held) >= chunk:
                        yield _binary("faces", np.hstack(held))
                        held = []
            if held:
                yield _binary("faces", np.hstack(held))

        with bounded_batches(state.sparkSession):
            met = some.select("fid", *CORNERS).mapInArrow(pack, "faces binary").crossJoin(packed_points.repartition(blocks) if first else packed_points).mapInArrow(_packed_nearest, "x double, y double, z double, fid long, d2 double")
            found = (met if first else met.unionByName(best)).groupBy(*XYZ).agg(F.min(F.struct("d2", "fid")).alias("f")).select(*XYZ, "f.fid", "f.d2")
            last, best = best, stash(found, "boxes-best")
        unstash(last)
        unstash(packed_points)
    return best


def _binary(name: str, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], [name])


def _points_packed(rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_binary("points", np.vstack([rows[c].to_numpy() for c in (*XYZ, "bound")]))])


def _packed_nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for faces, points in zip(*b.columns, strict=True):
            f, p = np.frombuffer(faces.as_buffer()).reshape(10, -1), np.frombuffer(points.as_buffer()).reshape(4, -1)
            who, near, far = _compared(p[:3].T, p[3], f[0].view(np.int64), f[1:])
            yield pa.RecordBatch.from_arrays([*(pa.array(p[k, who]) for k in range(3)), pa.array(near), pa.array(far)], [*XYZ, "fid", "d2"])


def triangle_distances(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(i, fid, d2): the triangle nearest to each point and its squared distance; ties to the smallest fid.

    points: id, x, y, z; faces: fid and the corners ax ... cz. Points and triangles with null or non-finite numbers take no part;
    without triangles there is no row. Degenerate triangles are sides or points.
    """
    finite = lambda columns: reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns))
    number = lambda columns: [F.col(c).cast("double").alias(c) for c in columns]
    low, high = ([f(*(f"{k}{x}" for k in "abc")) for x in XYZ] for f in (F.least, F.greatest))
    size = F.greatest(*(z - a for a, z in zip(low, high, strict=True)))
    whole = stash(faces.where(finite(CORNERS)).select(F.col("fid").cast("long").alias("fid"), *number(CORNERS)), "boxes-faces")
    # of whole triangles only what can't be computed again is written: corners are shared, middles aren't
    sized = whole.withColumns({"size": size} | {f"m{x}": (a + z) / 2 for x, a, z in zip(XYZ, low, high, strict=True)})
    n, most = sized.agg(F.count("*"), F.max("size")).first()
    asked = points.where(finite(XYZ)).select(F.col("id").alias("i"), *number(XYZ))
    if not n:
        return asked.limit(0).select("i", F.lit(0).cast("long").alias("fid"), F.lit(0.0).alias("d2"))
    kind: Column = F.when(F.col("size") > 0, F.least(F.floor(F.log(F.lit(float(most) or 1.0) / F.col("size")) / float(np.log(STEP))), F.lit(CLASSES - 1))).otherwise(CLASSES - 1).cast("int")
    sized = sized.withColumn("kind", kind)
    spans = [F.max(f"m{x}") - F.min(f"m{x}") for x in XYZ]
    kinds = {r[0]: r[1:] for r in sized.groupBy("kind").agg(F.count("*"), F.max("size"), *spans).collect()}  # at most CLASSES rows

    def leaves(c: int) -> int:
        return max(1, min(MAX_LEAVES * c // n, c // LEAF))

    def share(c: int, size: float, *span: float) -> float:
        """Of a class's leaves, about how many a point meets that lies among them."""
        return float(np.prod([min(1.0, (s / leaves(c) ** (1 / 3) + size) / max(s + size, 1e-300)) for s in span]))

    wide = sorted(k for k, (c, *extent) in kinds.items() if share(c, *extent) > WIDE)
    narrow = sorted(kinds.keys() - set(wide))
    state, best = stash(asked.select(*XYZ).distinct().withColumn("bound", F.lit(float("inf"))), "boxes-state"), None
    if wide:
        best = _wide_distances(state, sized.where(F.col("kind").isin(wide)).select("fid", *CORNERS), sum(kinds[k][0] for k in wide))
    sized, rows, of = sized.where(F.col("kind").isin(narrow)), sum(kinds[k][0] for k in narrow), {}
    if narrow:
        part = min(1.0, SAMPLED * min(MAX_LEAVES, rows // LEAF + 1) / rows)
        sample = sized.where(F.pmod(F.xxhash64("fid"), F.lit(1 << 30)) < int(part * (1 << 30))).select("kind", *(f"m{x}" for x in XYZ)).toPandas()
        of = {k: sample.loc[sample["kind"] == k, [f"m{x}" for x in XYZ]].to_numpy() for k in narrow}
    forest = Forest(of, {k: leaves(kinds[k][0]) for k in narrow})
    if not forest.leaves:
        return asked.join(best, list(XYZ)).select("i", "fid", "d2")

    @F.pandas_udf("int")
    def leaf(kind, x, y, z):
        import pandas as pd

        return pd.Series(forest.leaf_of(kind.to_numpy(), np.column_stack([x, y, z])), dtype="int32")

    held = stash(sized.withColumn("leaf", leaf("kind", *(f"m{x}" for x in XYZ))).select("leaf", "fid", *CORNERS), "boxes-leaves")
    boxes = held.groupBy("leaf").agg(*(F.min(a) for a in low), *(F.max(z) for z in high)).collect()
    lows, highs = np.full((forest.leaves, 3), np.inf), np.full((forest.leaves, 3), -np.inf)
    for r in boxes:
        lows[r[0]], highs[r[0]] = r[1:4], r[4:7]
    forest.set_boxes(lows, highs)

    @F.pandas_udf("int")
    def home(x, y, z):
        import pandas as pd

        return pd.Series(forest.home(np.column_stack([x, y, z])), dtype="int32")

    if best is None:  # the first round goes to the leaves around the points
        state = state.withColumn("home", home(*XYZ)).withColumn("done", F.lit(0))
        visits, turn = state.select(*XYZ, "bound", F.col("home").alias("leaf")), VISITS
    else:
        state = stash(_bounded(state.withColumn("home", F.lit(-1)).withColumn("done", F.lit(0)), best), "boxes-state")
        visits, state, turn = _next_visits(state, forest, VISITS), state.withColumn("done", F.lit(VISITS)), VISITS * 4
    face_pieces = stash(piece_counts(held, PIECE), "boxes-pieces")
    keys = ["leaf", "qp", "fp"]
    while True:
        visits = stash(visits, "boxes-visits")
        if best is not None and visits.isEmpty():
            break
        asked_pieces = stash(piece_counts(visits, POINTS), "boxes-pieces")
        left = everywhere(dealt(visits, XYZ, asked_pieces, "qp"), face_pieces, "fp")
        right = everywhere(dealt(held, ("fid",), face_pieces, "fp"), asked_pieces, "qp")
        met = left.toDF(*left.columns).groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys)).applyInArrow(_nearest, "x double, y double, z double, fid long, d2 double")
        found = (met if best is None else met.unionByName(best)).groupBy(*XYZ).agg(F.min(F.struct("d2", "fid")).alias("f")).select(*XYZ, "f.fid", "f.d2")
        last, best = best, stash(found, "boxes-best")
        unstash(last)
        unstash(visits)
        if forest.leaves == 1:
            break
        state = stash(_bounded(state, best), "boxes-state")
        visits, state, turn = _next_visits(state, forest, turn), state.withColumn("done", F.col("done") + turn), turn * 4
    return asked.join(best, list(XYZ)).select("i", "fid", "d2")


def _next_visits(state: DataFrame, forest: Forest, turn: int) -> DataFrame:
    """The next leaves of each point that may hold a nearer triangle, nearest boxes first, the first one visited aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, z, home, done, bound = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            step = max(1, NOTED // max(forest.leaves, turn))  # points that could meet every leaf
            for at in range(0, len(x), step):
                query, leaf = forest.within(np.column_stack([x, y, z])[at : at + step], bound[at : at + step])
                query += at
                other = leaf != home[query]
                query, leaf = query[other], leaf[other]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                now = (place >= done[query]) & (place < done[query] + turn)
                query, leaf = query[now], leaf[now]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[query]) for c in (x, y, z, bound)), pa.array(leaf.astype(np.int32))], [*XYZ, "bound", "leaf"])

    return state.select(*XYZ, "home", "done", "bound").mapInArrow(run, "x double, y double, z double, bound double, leaf int")
