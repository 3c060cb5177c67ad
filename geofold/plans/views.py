"""Camera transforms, harmonics of degree four, lattices, posed bones, filled textures and stored models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions import camera, geom
from geofold.functions.geom import r6
from geofold.operators import checkpoints, mesh, ordering, raster, sampling
from geofold.plans.book import Book, q6
from geofold.plans.fixtures import SPLATS, cameras, splats, table
from geofold.plans.measures import EXTENT, extent
from geofold.plans.neighbours import BOOK as NEIGHBOURS

BOOK = Book()
_MOVE, _FACTOR = (0.1, 0.2, 0.3), 2.0
_UNIT = "unit AS (SELECT *, q0 / n AS w, q1 / n AS i, q2 / n AS j, q3 / n AS k FROM (SELECT *, sqrt(q0 ** 2 + q1 ** 2 + q2 ** 2 + q3 ** 2) AS n FROM splats))"
_ROT = [
    ["1 - 2 * (j * j + k * k)", "2 * (i * j - w * k)", "2 * (i * k + w * j)"],
    ["2 * (i * j + w * k)", "1 - 2 * (i * i + k * k)", "2 * (j * k - w * i)"],
    ["2 * (i * k - w * j)", "2 * (j * k + w * i)", "1 - 2 * (i * i + j * j)"],
]
_TURNED = ", rot AS (SELECT id, x, y, z, f0, f1, f2, " + ", ".join(f"{_ROT[r][c]} AS r{r}{c}" for r in range(3) for c in range(3)) + " FROM unit), centre AS (SELECT *, " + ", ".join(f"(-(r{r}0 * x + r{r}1 * y + r{r}2 * z) + {_MOVE[r]}) * {_FACTOR} AS c{r}" for r in range(3)) + " FROM rot)"
VIEWS = f"{SPLATS}, {_UNIT}{_TURNED}, views AS (SELECT *, " + ", ".join(f"-(r0{c} * c0 + r1{c} * c1 + r2{c} * c2) AS t{c}" for c in range(3)) + " FROM centre)"


def _view(q=("q0", "q1", "q2", "q3")) -> list:
    return camera.world_to_view(geom.quaternion_matrix(list(q)), list("xyz"), _MOVE, _FACTOR)


@BOOK.query(f"WITH {VIEWS} SELECT id, " + ", ".join(q6(f"r{c}{r}", f"m{r}{c}") for r in range(3) for c in range(3)) + ", " + ", ".join(q6(f"t{r}", f"m{r}3") for r in range(3)) + " FROM views")
def world_view_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = _view()
    return splats(spark, d).select("id", *(r6(m[r][c]).alias(f"m{r}{c}") for r in range(3) for c in range(4)))


_NEAR, _FAR, _FX, _FY = 0.01, 100.0, 1.2, 0.9
_SEEN = VIEWS + ", seen AS (SELECT id, " + ", ".join(f"r0{r} * f0 + r1{r} * f1 + r2{r} * f2 + t{r} AS v{r}" for r in range(3)) + " FROM views)"


@BOOK.query(f"WITH {_SEEN} SELECT id, round(v0 / {math.tan(_FX / 2)!r} / (v2 + 1e-7), 4) + 0.0 AS u, round(v1 / {math.tan(_FY / 2)!r} / (v2 + 1e-7), 4) + 0.0 AS v, round((v2 * {_FAR / (_FAR - _NEAR)!r} - {_FAR * _NEAR / (_FAR - _NEAR)!r}) / (v2 + 1e-7), 4) + 0.0 AS depth FROM seen WHERE abs(v2) > 0.05")
def projected_places(spark: SparkSession, d: str) -> DataFrame:
    """Places (here: the splats' colours) seen from the splats' views through a perspective matrix."""
    place = ["f0", "f1", "f2"]
    m, p = _view(), camera.projection(F.lit(_NEAR), F.lit(_FAR), F.lit(_FX), F.lit(_FY))
    seen = [geom.dot(row[:3], place) + row[3] for row in m[:3]]
    rows = splats(spark, d).select("id", *(c.alias(f"v{k}") for k, c in enumerate(seen))).where(F.abs("v2") > 0.05)
    out = camera.transformed(["v0", "v1", "v2"], p)
    return rows.select("id", *(r6(c, 4).alias(n) for c, n in zip(out, ("u", "v", "depth"), strict=True)))


@BOOK.query(f"WITH p AS (SELECT ps_id AS id, ps_id % 40 AS u, ps_id % 30 AS v, 1 + n / 100.0 AS depth FROM (SELECT c_custkey AS ps_id, c_nationkey AS n FROM customer)) SELECT id, {q6('-(2 * (u + 0.5) / 40 - 1) * (40 / 30.0) * depth / 1.5 - 0.1 * depth / 1.5', 'x')}, {q6('-(2 * (v + 0.5) / 30 - 1) * depth / 1.25', 'y')}, {q6('depth', 'z')} FROM p")
def unproject_ndc(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("u"), (F.col("c_custkey") % 30).alias("v"), (1 + F.col("c_nationkey") / 100).alias("depth"))
    x, y, z = camera.unproject_ndc("u", "v", "depth", 40, 30, (F.lit(1.5), F.lit(1.25)), (F.lit(0.1), F.lit(0.0)))
    return p.select("id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


_C = [geom.SH_C0, -geom.SH_C1, geom.SH_C1, -geom.SH_C1, *geom.SH_C2, *geom.SH_C3, *geom.SH_C4]
_HARMONICS = ["1", "y", "z", "x", "x*y", "y*z", "2*z*z-x*x-y*y", "x*z", "x*x-y*y", "y*(3*x*x-y*y)", "x*y*z", "y*(4*z*z-x*x-y*y)", "z*(2*z*z-3*x*x-3*y*y)", "x*(4*z*z-x*x-y*y)", "z*(x*x-y*y)", "x*(x*x-3*y*y)",
    "x*y*(x*x-y*y)", "y*z*(3*x*x-y*y)", "x*y*(7*z*z-1)", "y*z*(7*z*z-3)", "z*z*(35*z*z-30)+3", "x*z*(7*z*z-3)", "(x*x-y*y)*(7*z*z-1)", "x*z*(x*x-3*y*y)", "x*x*(x*x-3*y*y)-y*y*(3*x*x-y*y)"]


def _sh4(channel: int) -> str:
    return "greatest(0.5 + " + " + ".join(f"{c!r} * ({t}) * CAST(embedding[{10 + 3 * (k % 15) + channel}] AS DOUBLE)" for k, (c, t) in enumerate(zip(_C, _HARMONICS, strict=True))) + ", 0)"


@BOOK.query("WITH u AS (SELECT vec_id AS id, embedding, a / n AS x, b / n AS y, c / n AS z FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (SELECT *, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings))) SELECT id, " + ", ".join(q6(_sh4(k), n) for k, n in enumerate(("red", "green", "blue"))) + " FROM u")
def sh_eval_degree4(spark: SparkSession, d: str) -> DataFrame:
    """All three channels, 25 coefficients each (numbers 9 to 53 of a vector, the first ten of each channel twice)."""
    e = lambda i: F.col("embedding")[i].cast("double")
    unit = geom.normalized([e(0), e(1), e(2)])
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", *(c.alias(n) for c, n in zip(unit, "xyz", strict=True)))
    value = lambda channel: geom.sh_value([e(9 + 3 * (k % 15) + channel) for k in range(25)], list("xyz"), 4)
    return rows.select(F.col("vec_id").alias("id"), *(r6(value(k)).alias(n) for k, n in enumerate(("red", "green", "blue"))))


@BOOK.query(f"WITH {EXTENT}, l AS (SELECT i + 1 AS id, -90 + (i // 20 + 1) / 11.0 * 180 AS e, 18.0 * (i % 20) AS a FROM range(200) t(i) UNION ALL SELECT 0, -89.9, 0 UNION ALL SELECT 201, 89.9, 0) SELECT CAST(l.id AS BIGINT) AS id, {q6('cx + radius * cos(radians(e)) * sin(radians(a))', 'x')}, {q6('cy + radius * sin(radians(e))', 'y')}, {q6('cz + radius * cos(radians(e)) * cos(radians(a))', 'z')} FROM l, extent")
def sphere_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Places around all cameras, on a sphere that holds them."""
    around = sampling.sphere_lattice(spark, poles=True).join(F.broadcast(extent(cameras(spark, d))))
    return around.select("id", *(r6(F.col(f"c{c}") + F.col("radius") * F.col(c)).alias(c) for c in "xyz"))


_CODES = NEIGHBOURS.sql["morton_order"].removeprefix("WITH ").replace(") SELECT id, CAST(", "), codes AS (SELECT id, CAST(", 1) + "), placed AS (SELECT id, x, y, z, row_number() OVER (ORDER BY code, id) AS n FROM codes JOIN splats USING (id)), near AS (SELECT p.id, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 AS d2, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2, q.id) AS r FROM placed p JOIN placed q ON q.n BETWEEN p.n - 3 AND p.n + 3 AND q.n <> p.n)"


@BOOK.query(f"WITH {_CODES} SELECT id, {q6('avg(d2)', 'mean_d2')} FROM near WHERE r <= 3 GROUP BY id")
def z_order_window(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the three least squared distances among the three rows before and after in Z-order."""
    codes = NEIGHBOURS.queries["morton_order"](spark, d).join(splats(spark, d).select("id", "x", "y", "z"), "id")
    pairs = ordering.around(codes, ["code", "id"], 3, ["id", "x", "y", "z"], ["id", "x", "y", "z"])
    d2 = geom.squared_distance(["x", "y", "z"], ["other_x", "other_y", "other_z"])
    three = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(d2)), 1, 3).alias("d"))
    return three.select("id", r6(F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")).alias("mean_d2"))


_BONE = lambda k: [[f"CASE WHEN {r} = {c} THEN 1.0 + bone / {10.0 + k} ELSE 0.0 END" if c < 3 and (r + c) % 2 == 0 else f"{0.05 * (r - c) * k} * (1 + bone)" for c in range(4)] for r in range(3)]


@BOOK.query(
    f"WITH {SPLATS}, b AS (SELECT n_regionkey AS bone FROM nation GROUP BY 1), m AS (SELECT bone, " + ", ".join(f"{_BONE(k)[r][c]} AS {n}{r}{c}" for n, k in (("p", 1), ("t", 2)) for r in range(3) for c in range(4)) + " FROM b), "
    + "det AS (SELECT *, t00 * (t11 * t22 - t12 * t21) - t01 * (t10 * t22 - t12 * t20) + t02 * (t10 * t21 - t11 * t20) AS det FROM m), "
    + "moved AS (SELECT s.id, det.*, s.x - t03 AS a, s.y - t13 AS b_, s.z - t23 AS c FROM splats s JOIN det ON det.bone = s.id % 5), "
    + "rest AS (SELECT *, ((t11 * t22 - t12 * t21) * a + (t02 * t21 - t01 * t22) * b_ + (t01 * t12 - t02 * t11) * c) / det AS x, ((t12 * t20 - t10 * t22) * a + (t00 * t22 - t02 * t20) * b_ + (t02 * t10 - t00 * t12) * c) / det AS y, ((t10 * t21 - t11 * t20) * a + (t01 * t20 - t00 * t21) * b_ + (t00 * t11 - t01 * t10) * c) / det AS z FROM moved) "
    + "SELECT id AS vid, " + ", ".join(q6(f"p{r}0 * x + p{r}1 * y + p{r}2 * z + p{r}3", n) for r, n in enumerate("xyz")) + " FROM rest"
)
def skinning_from_rest(spark: SparkSession, d: str) -> DataFrame:
    """Vertices moved by their bone's pose after the inverse of its rest."""
    bones = table(spark, d, "nation").select(F.col("n_regionkey").alias("bone")).distinct()
    cell = lambda r, c, k: F.lit(1.0 if r == c else 0.0) + (F.col("bone") / (10.0 + k) if r == c else 0.0) if c < 3 and (r + c) % 2 == 0 else 0.05 * (r - c) * k * (1 + F.col("bone"))
    bones = bones.select("bone", *(cell(r, c, k).alias(f"{n}{r}{c}") for n, k in (("p", 1), ("r", 2)) for r in range(3) for c in range(4)))
    vertices = splats(spark, d).select(F.col("id").alias("vid"), "x", "y", "z")
    weights = vertices.select("vid", (F.col("vid") % 5).alias("bone"), F.lit(0.7).alias("w"))
    return mesh.skinned(vertices, weights, mesh.pose_from_rest(bones)).select("vid", *(r6(c).alias(c) for c in "xyz"))


@BOOK.query(f"WITH hits AS (SELECT l_partkey % 20 AS tr, l_suppkey % 20 AS tc, l_partkey % 37 AS fid, l_linenumber AS cam, l_orderkey AS pixel, l_discount AS red FROM lineitem WHERE l_linenumber > 5), t AS (SELECT tr, tc, avg(red) AS red FROM (SELECT tr, tc, cam, arg_min(red, (pixel, red)) AS red FROM hits GROUP BY ALL) GROUP BY ALL), f AS (SELECT fid, avg(red) AS red FROM (SELECT fid, cam, arg_min(red, (pixel, red)) AS red FROM hits GROUP BY ALL) GROUP BY ALL), texels AS (SELECT r.i AS tr, c.i AS tc, (r.i * 20 + c.i) % 50 AS fid FROM range(20) r(i), range(20) c(i)) SELECT x.tr, x.tc, x.fid, {q6('coalesce(t.red, f.red, x.fid / 100.0)', 'red')} FROM texels x LEFT JOIN t ON t.tr = x.tr AND t.tc = x.tc LEFT JOIN f ON f.fid = x.fid")
def texture_filled(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").where("l_linenumber > 5").select((F.col("l_partkey") % 20).alias("tr"), (F.col("l_suppkey") % 20).alias("tc"), (F.col("l_partkey") % 37).alias("fid"), F.col("l_linenumber").alias("cam"), F.col("l_orderkey").alias("pixel"), F.col("l_discount").alias("red"))
    texels = spark.range(400).select(F.floor(F.col("id") / 20).alias("tr"), (F.col("id") % 20).alias("tc"), (F.col("id") % 50).alias("fid"))
    faces = spark.range(50).select(F.col("id").alias("fid"), (F.col("id") / 100).alias("red"))
    return raster.texture_filled(texels, hits, faces, ["tr", "tc"], "cam", ["pixel"], ["red"]).select("tr", "tc", "fid", r6("red").alias("red"))


@BOOK.query(f"SELECT vec_id AS id, {q6('CAST(embedding[2] AS DOUBLE)', 'y')}, {q6('CAST(embedding[7] AS DOUBLE)', 'dc')}, CAST(45 AS INTEGER) AS rest, {q6('CAST(embedding[59] AS DOUBLE)', 'q0')}, {q6('CAST(embedding[56] AS DOUBLE)', 's0')} FROM embeddings")
def checkpoint_evolved(spark: SparkSession, d: str) -> DataFrame:
    """A model of an older form, brought to the present one."""
    e = lambda i: F.col("embedding")[i].cast("double")
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(e(0), e(1), e(2)).alias("points"), F.array(e(6), *(e(9 + k) for k in range(45))).alias("sh_coordinates"), F.array(*(e(58 + k) for k in range(4)), *(e(55 + k) for k in range(3))).alias("radiuses"))
    now = checkpoints.present_form(old)
    return now.select("id", r6(F.col("_points")[1]).alias("y"), r6(F.col("_sh_coordinates_dc")[0]).alias("dc"), F.size("_sh_coordinates_rest").alias("rest"), r6(F.col("_quaternions")[0]).alias("q0"), r6(F.col("_scales")[0]).alias("s0"))
