"""Level surfaces of regular grids as triangle meshes: every cell looks up the triangles of its 256 possible cases.

The cases' table follows from one rule. On each side of a cell, each run of corners above the level is cut
off by a line from where the side's outline enters the run to where it leaves it. The lines close to
loops, and a loop is a fan of triangles. Both cells at a side draw the same lines, so the surface has no gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
#: Indexes of a grid go from 0 to below this.
SIDE = 1 << 19


def _sides() -> list[list[int]]:
    """Corners of each side, in turn as seen from outside; bit a of a corner is its place on axis a."""
    out = []
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        turn = [0, 1 << b, (1 << b) | (1 << c), 1 << c]
        out += [[x | (1 << a) for x in turn], turn[::-1]]
    return out


def case_triangles(case: int) -> list[tuple[int, int, int]]:
    """Triangles of a case (bit c: corner c is above the level), as edges: 3 * (corner at the edge's low end) + axis."""

    def edge(p: int, q: int) -> int:
        return 3 * (p & q) + (p ^ q).bit_length() - 1

    after: dict[int, int] = {}
    for turn in _sides():
        above = [case >> c & 1 for c in turn]
        for n in range(4):
            if above[n] and not above[n - 1]:
                last = n
                while above[(last + 1) % 4]:
                    last += 1
                last %= 4
                after[edge(turn[last], turn[(last + 1) % 4])] = edge(turn[n - 1], turn[n])
    out = []
    while after:
        first, at = after.popitem()
        loop = [first]
        while at != first:
            loop.append(at)
            at = after.pop(at)
        out += [(loop[0], loop[n + 1], loop[n]) for n in range(1, len(loop) - 1)]
    return out


def _cells(grid: DataFrame, level: float) -> DataFrame:
    """(i, j, k, v, case): the cells that the surface goes through; v holds the values of the 8 corners."""
    rows = grid.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*(F.col(a).cast("long").alias(a) for a in AXES), F.array(F.col("value").cast("double")).alias("v"))
    for axis in AXES:
        line = Window.partitionBy(*(a for a in AXES if a != axis)).orderBy(axis)
        ahead = rows.withColumn("__v", F.lead("v").over(line)).withColumn("__at", F.lead(axis).over(line))
        rows = ahead.where(F.col("__at") == F.col(axis) + 1).select(*AXES, F.concat("v", "__v").alias("v"))
    case = sum((F.when(F.col("v")[c] > level, 1 << c).otherwise(0) for c in range(8)), F.lit(0))
    return rows.withColumn("case", case).where("case NOT IN (0, 255)")


def level_surface(grid: DataFrame, level: float) -> tuple[DataFrame, DataFrame]:
    """Mesh of a grid (i, j, k, value): vertices (vid, x, y, z) in index units and faces (fid, a, b, c).

    Normals point to the lower side. A vertex lies on a grid edge, where the value goes through the level in a straight line.
    Points absent, null or NaN leave out the cells at them. Ids come from
    places in the grid, with gaps. Values at the level count as below.
    """
    spark = grid.sparkSession
    table = [(case, n, *t) for case in range(256) for n, t in enumerate(case_triangles(case))]
    # fixed size: the triangles of 256 cases
    cases = F.broadcast(spark.createDataFrame(table, "case int, n int, a int, b int, c int"))
    found = _cells(grid, level).join(cases, "case")
    place = lambda c: [F.col(axis) + F.floor(c / 3).bitwiseAND(F.lit(1 << n).cast("long")) / (1 << n) for n, axis in enumerate(AXES)]
    code = lambda i, j, k: i + SIDE * (j + SIDE * k)
    vid = lambda c: (3 * code(*(x.cast("long") for x in place(c))) + c % 3).cast("long")
    faces = found.select((16 * code(*(F.col(a) for a in AXES)) + F.col("n")).alias("fid"), *(vid(F.col(e)).alias(e) for e in "abc"))
    used = found.select(*AXES, "v", F.explode(F.array("a", "b", "c")).alias("e"))
    axis, low = F.col("e") % 3, F.floor(F.col("e") / 3).cast("int")
    v0 = F.element_at("v", low + 1)
    v1 = F.element_at("v", low + F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), axis + 1) + 1)
    share = (level - v0) / (v1 - v0)
    at = [(x + F.when(axis == n, share).otherwise(0.0)).alias(name) for n, (x, name) in enumerate(zip(place(F.col("e")), "xyz", strict=True))]
    return used.select(vid(F.col("e")).alias("vid"), *at).groupBy("vid").agg(*(F.min(c).alias(c) for c in "xyz")), faces
