"""Rotations, covariances, colours, cameras and other arithmetic on splats."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions import geom
from geofold.functions.geom import r6
from geofold.operators import mesh
from geofold.plans.book import Book, q6
from geofold.plans.fixtures import CORNERED, LOG, SPLATS, faces, log, splats, vertices


BOOK = Book()
Q = [f"q{k}" for k in range(4)]
S = [f"s{k}" for k in range(3)]
FOCAL, CENTRE, TAN = (60.0, 60.0), (32.0, 32.0), (0.5333, 0.5333)

UNIT = SPLATS + ", unit AS (SELECT *, q0 / n AS w, q1 / n AS i, q2 / n AS j, q3 / n AS k FROM (SELECT *, sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) AS n FROM splats))"
_ROT = [
    ["1 - 2 * (j * j + k * k)", "2 * (i * j - w * k)", "2 * (i * k + w * j)"],
    ["2 * (i * j + w * k)", "1 - 2 * (i * i + k * k)", "2 * (j * k - w * i)"],
    ["2 * (i * k - w * j)", "2 * (j * k + w * i)", "1 - 2 * (i * i + j * j)"],
]
ROT = UNIT + ", rot AS (SELECT *, " + ", ".join(f"{_ROT[a][b]} AS m{a}{b}" for a in range(3) for b in range(3)) + " FROM unit)"
_COV = {f"{a}{b}": " + ".join(f"m{a}{c} * s{c} * m{b}{c} * s{c}" for c in range(3)) for a in range(3) for b in range(a, 3)}
COV = ROT + ", cov AS (SELECT *, " + ", ".join(f"{e} AS v{n}" for n, e in _COV.items()) + " FROM rot)"


@BOOK.query(f"WITH {ROT} SELECT id, " + ", ".join(q6(f"m{a}{b}", f"m{a}{b}") for a in range(3) for b in range(3)) + " FROM rot")
def quat_to_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = geom.quaternion_matrix(Q)
    return splats(spark, d).select("id", *(r6(m[a][b]).alias(f"m{a}{b}") for a in range(3) for b in range(3)))


@BOOK.query(f"WITH {UNIT} SELECT id, " + ", ".join(q6(f"abs({c})", c) for c in "wijk") + " FROM unit")
def matrix_to_quat(spark: SparkSession, d: str) -> DataFrame:
    q = geom.matrix_quaternion(geom.quaternion_matrix(Q))
    return splats(spark, d).select("id", *(r6(F.abs(v)).alias(c) for v, c in zip(q, "wijk", strict=True)))


@BOOK.query(f"WITH {COV} SELECT id, " + ", ".join(q6(f"v{n}", f"v{n}") for n in _COV) + " FROM cov")
def covariance3d(spark: SparkSession, d: str) -> DataFrame:
    return splats(spark, d).select("id", *(r6(v).alias(f"v{n}") for v, n in zip(geom.covariance3d(Q, S), _COV, strict=True)))


_LIM = 1.3 * TAN[0]
EWA = COV + f""", cam AS (SELECT *, z + 1 AS zc FROM cov),
jac AS (SELECT *, {FOCAL[0]} / zc AS j00, -{FOCAL[0]} * least(greatest(x / zc, -{_LIM}), {_LIM}) / zc AS j02, {FOCAL[1]} / zc AS j11, -{FOCAL[1]} * least(greatest(y / zc, -{_LIM}), {_LIM}) / zc AS j12 FROM cam),
ewa AS (SELECT *, j00 * j00 * v00 + 2 * j00 * j02 * v02 + j02 * j02 * v22 + 0.3 AS a2, j00 * j11 * v01 + j00 * j12 * v02 + j02 * j11 * v12 + j02 * j12 * v22 AS b2, j11 * j11 * v11 + 2 * j11 * j12 * v12 + j12 * j12 * v22 + 0.3 AS c2 FROM jac),
conic AS (SELECT *, a2 * c2 - b2 * b2 AS det, (a2 + c2) / 2 AS mid FROM ewa),
screen AS (SELECT *, c2 / det AS k0, -b2 / det AS k1, a2 / det AS k2, ceil(3 * sqrt(mid + sqrt(greatest(0.1, mid * mid - det)))) AS radius, {FOCAL[0]} * x / zc + {CENTRE[0]} AS u, {FOCAL[1]} * y / zc + {CENTRE[1]} AS v FROM conic)"""


def screen(spark: SparkSession, d: str) -> DataFrame:
    """Splats seen by a camera one unit behind the origin: u, v, depth, conic c0..c2, radius."""
    p = [F.col("x"), F.col("y"), F.col("z") + 1]
    cov = geom.ewa_covariance(geom.covariance3d(Q, S), p, FOCAL, TAN)
    rows = splats(spark, d).select("*", *(v.alias(f"e{k}") for k, v in enumerate(cov)), *(v.alias(n) for v, n in zip(geom.project(p, FOCAL, CENTRE), "uv", strict=True)), p[2].alias("depth"))
    conic, radius = geom.conic_radius("e0", "e1", "e2")
    return rows.select("*", *(v.alias(f"c{k}") for k, v in enumerate(conic)), radius.cast("double").alias("radius"))


@BOOK.query(f"WITH {EWA} SELECT id, {q6('k0', 'c0')}, {q6('k1', 'c1')}, {q6('k2', 'c2')}, radius FROM screen")
def ewa_conic(spark: SparkSession, d: str) -> DataFrame:
    return screen(spark, d).select("id", *(r6(f"c{k}").alias(f"c{k}") for k in range(3)), "radius")


@BOOK.query(f"WITH {EWA} SELECT id, {q6('u', 'u')}, {q6('v', 'v')}, zc > 0.2 AS seen FROM screen")
def project_points(spark: SparkSession, d: str) -> DataFrame:
    return screen(spark, d).select("id", r6("u").alias("u"), r6("v").alias("v"), (F.col("depth") > 0.2).alias("seen"))


DIR = SPLATS + ", dir AS (SELECT *, x / n AS dx, y / n AS dy, z / n AS dz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM splats))"
_BASIS = [
    str(geom.SH_C0), f"-{geom.SH_C1} * dy", f"{geom.SH_C1} * dz", f"-{geom.SH_C1} * dx",
    f"{geom.SH_C2[0]} * dx * dy", f"{geom.SH_C2[1]} * dy * dz", f"{geom.SH_C2[2]} * (2 * dz * dz - dx * dx - dy * dy)", f"{geom.SH_C2[3]} * dx * dz", f"{geom.SH_C2[4]} * (dx * dx - dy * dy)",
    f"{geom.SH_C3[0]} * dy * (3 * dx * dx - dy * dy)", f"{geom.SH_C3[1]} * dx * dy * dz", f"{geom.SH_C3[2]} * dy * (4 * dz * dz - dx * dx - dy * dy)", f"{geom.SH_C3[3]} * dz * (2 * dz * dz - 3 * dx * dx - 3 * dy * dy)",
    f"{geom.SH_C3[4]} * dx * (4 * dz * dz - dx * dx - dy * dy)", f"{geom.SH_C3[5]} * dz * (dx * dx - dy * dy)", f"{geom.SH_C3[6]} * dx * (dx * dx - 3 * dy * dy)",
]
_SERIES = " + ".join(f"({b}) * {c}" for b, c in zip(_BASIS, ["f0", *(f"r{k}" for k in range(15))], strict=True))


@BOOK.query(f"WITH {DIR} SELECT id, {q6(f'greatest(0, {_SERIES} + 0.5)', 'red')} FROM dir")
def sh_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = splats(spark, d).select("*", *(v.alias(f"d{c}") for v, c in zip(geom.normalized(["x", "y", "z"]), "xyz", strict=True)))
    return rows.select("id", r6(geom.sh_value(["f0", *(f"r{k}" for k in range(15))], ["dx", "dy", "dz"], 3)).alias("red"))


@BOOK.query(f"WITH {SPLATS} SELECT id, {q6(f'f0 * {geom.SH_C0} + 0.5', 'rgb')}, {q6('f0', 'back')} FROM splats")
def rgb_sh_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rgb = geom.sh_to_rgb("f0")
    return splats(spark, d).select("id", r6(rgb).alias("rgb"), r6(geom.rgb_to_sh(rgb)).alias("back"))


@BOOK.query(f"WITH {DIR} SELECT id, {q6('asin(greatest(-1, least(1, dy)))', 'elevation')}, {q6('atan2(dx, dz)', 'azimuth')}, {q6('dx', 'back')} FROM dir")
def spherical_coords(spark: SparkSession, d: str) -> DataFrame:
    e, a = geom.to_spherical(geom.normalized(["x", "y", "z"]))
    rows = splats(spark, d).select("id", e.alias("e"), a.alias("a"))
    return rows.select("id", r6("e").alias("elevation"), r6("a").alias("azimuth"), r6(geom.from_spherical("e", "a")[0]).alias("back"))


@BOOK.query(f"WITH {EWA} SELECT id, {q6('x', 'x')}, {q6('y', 'y')}, {q6('zc', 'z')} FROM screen")
def unproject_grid(spark: SparkSession, d: str) -> DataFrame:
    p = geom.unproject("u", "v", "depth", FOCAL, CENTRE)
    return screen(spark, d).select("id", *(r6(v).alias(c) for v, c in zip(p, "xyz", strict=True)))


@BOOK.query(f"WITH {SPLATS} SELECT id, CAST(CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS INTEGER) AS axis, label FROM splats")
def smallest_axis(spark: SparkSession, d: str) -> DataFrame:
    s = F.array(*S)
    return splats(spark, d).select("id", (F.array_position(s, F.array_min(s)) - 1).cast("int").alias("axis"), "label")


@BOOK.query(f"WITH {LOG} SELECT event_id, {q6('exp(ln(0.00016) * (1 - least(iteration / 40.0, 1)) + ln(0.0000016) * least(iteration / 40.0, 1)) * (0.01 + 0.99 * sin(0.5 * pi() * least(iteration / 10.0, 1))) * 10000', 'rate')} FROM log")
def learning_rate(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("event_id", r6(geom.learning_rate("iteration", 1.6e-4, 1.6e-6, 40, 10, 0.01) * 10000).alias("rate"))


@BOOK.query(f"WITH {SPLATS}, r AS (SELECT id, CAST(least(greatest(floor((z + 0.5) * 256), 0), 255) AS INTEGER) AS rank FROM splats) SELECT id, rank, CAST(rank // 3 AS INTEGER) AS shade FROM r")
def colour_rank(spark: SparkSession, d: str) -> DataFrame:
    lut = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.floor(i / 3).cast("int"))
    rank = F.least(F.greatest(F.floor((F.col("z") + 0.5) * 256), F.lit(0)), F.lit(255)).cast("int")
    return splats(spark, d).select("id", rank.alias("rank")).select("id", "rank", F.element_at(lut, F.col("rank") + 1).alias("shade"))


@BOOK.query(f"WITH {UNIT} SELECT id, {q6('w * 0.6 - i * 0.8', 'w')}, {q6('w * 0.8 + i * 0.6', 'i')} FROM unit")
def sh_rotation_quaternion(spark: SparkSession, d: str) -> DataFrame:
    """A splat's rotation followed by an object's turn about x."""
    q = geom.quaternion_product(geom.normalized(Q), [0.6, 0.8, 0.0, 0.0])
    return splats(spark, d).select("id", r6(q[0]).alias("w"), r6(q[1]).alias("i"))


#: Places of one, three, four and six splats in a triangle, as weights of its corners.
BARYCENTRES = {
    1: [(1 / 3, 1 / 3, 1 / 3)],
    3: [(0.5, 0.25, 0.25), (0.25, 0.5, 0.25), (0.25, 0.25, 0.5)],
    4: [(1 / 3, 1 / 3, 1 / 3), (2 / 3, 1 / 6, 1 / 6), (1 / 6, 2 / 3, 1 / 6), (1 / 6, 1 / 6, 2 / 3)],
    6: [(2 / 3, 1 / 6, 1 / 6), (1 / 6, 2 / 3, 1 / 6), (1 / 6, 1 / 6, 2 / 3), (1 / 6, 5 / 12, 5 / 12), (5 / 12, 1 / 6, 5 / 12), (5 / 12, 5 / 12, 1 / 6)],
}


def bound_splats(cornered: DataFrame, per_face: int) -> DataFrame:
    """(fid, k, x, y, z): splats at fixed barycentric places of every face."""
    places = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(b, "abc", strict=True))) for b in BARYCENTRES[per_face]))
    rows = cornered.select("*", F.posexplode(places).alias("k", "bary"))
    return rows.select("fid", "k", *((F.col("bary.a") * F.col(f"a{c}") + F.col("bary.b") * F.col(f"b{c}") + F.col("bary.c") * F.col(f"c{c}")).alias(c) for c in "xyz"))


@BOOK.query(f"WITH {CORNERED}, w AS (SELECT * FROM (VALUES (0, 0.5, 0.25, 0.25), (1, 0.25, 0.5, 0.25), (2, 0.25, 0.25, 0.5)) t(k, wa, wb, wc)) SELECT fid, CAST(k AS INTEGER) AS k, {q6('CAST(wa AS DOUBLE) * ax + CAST(wb AS DOUBLE) * bx + CAST(wc AS DOUBLE) * cx', 'x')} FROM cornered, w")
def barycentric_binding(spark: SparkSession, d: str) -> DataFrame:
    corners = mesh.with_corners(faces(spark, d), vertices(spark, d))
    return bound_splats(corners, 3).select("fid", "k", r6("x").alias("x"))


@BOOK.query(f"WITH {CORNERED}, e AS (SELECT fid, bx - ax AS ux, by_ - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM cornered), n AS (SELECT fid, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz, ux / sqrt(ux * ux + uy * uy + uz * uz) AS tx, uy / sqrt(ux * ux + uy * uy + uz * uz) AS ty, uz / sqrt(ux * ux + uy * uy + uz * uz) AS tz FROM e), m AS (SELECT fid, nx / l AS nx, ny / l AS ny, nz / l AS nz, tx, ty, tz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM n)) SELECT fid, {q6('0.25 * (1 + nx + ty + (nx * ty - ny * tx))', 'w2')} FROM m")
def face_frame_quaternion(spark: SparkSession, d: str) -> DataFrame:
    """Squared first part of the rotation whose axes are a face's normal, its first edge and their product."""
    corners = mesh.with_corners(faces(spark, d), vertices(spark, d))
    a, b, c = (mesh.corner(k) for k in "abc")
    n, t = geom.face_normal(a, b, c), geom.sub(b, a)
    rows = corners.select("fid", *(v.alias(f"n{x}") for v, x in zip(n, "xyz", strict=True)), *(v.alias(f"t{x}") for v, x in zip(geom.normalized(t), "xyz", strict=True)))
    rows = rows.select("fid", *(v.alias(f"n{x}") for v, x in zip(geom.normalized(["nx", "ny", "nz"]), "xyz", strict=True)), "tx", "ty", "tz")
    third = geom.cross(["nx", "ny", "nz"], ["tx", "ty", "tz"])
    rows = rows.select("*", *(v.alias(f"o{x}") for v, x in zip(third, "xyz", strict=True)))
    columns = [[F.col(f"{v}{x}") for x in "xyz"] for v in "nto"]
    q = geom.matrix_quaternion(geom.transposed(columns))
    return rows.select("fid", r6(q[0] * q[0]).alias("w2"))


@BOOK.query(f"WITH {SPLATS}, c AS (SELECT * FROM (VALUES (0, 1.0, 0.0), (1, 0.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0)) t(corner, p, q)) SELECT id, CAST(corner AS INTEGER) AS corner, {q6('x + CAST(p AS DOUBLE) * s1', 'x')}, {q6('y + CAST(q AS DOUBLE) * s2', 'y')} FROM splats, c")
def primitive_corners(spark: SparkSession, d: str) -> DataFrame:
    """A diamond of four corners for each splat, in its plane before rotation."""
    diamond = F.array(*(F.struct(F.lit(i).alias("corner"), F.lit(p).alias("p"), F.lit(q).alias("q")) for i, (p, q) in enumerate(((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)))))
    rows = splats(spark, d).select("*", F.explode(diamond).alias("c"))
    return rows.select("id", "c.corner", r6(F.col("x") + F.col("c.p") * F.col("s1")).alias("x"), r6(F.col("y") + F.col("c.q") * F.col("s2")).alias("y"))


def atlas(face_rows: DataFrame, n: int, square: int) -> DataFrame:
    """face_rows with the atlas square of each pair of faces: u0, v0 in texels and which half is theirs."""
    side = math.ceil(math.sqrt(math.ceil(n / 2)))
    pair = F.floor(F.col("fid") / 2)
    return face_rows.select("*", (pair % side * square).cast("long").alias("u0"), (F.floor(pair / side) * square).cast("long").alias("v0"), (F.col("fid") % 2).cast("int").alias("half"))


@BOOK.query(f"WITH {CORNERED}, s AS (SELECT CAST(ceil(sqrt(ceil(count(*) / 2.0))) AS BIGINT) AS side FROM faces) SELECT fid, CAST((fid // 2) % side * 10 AS BIGINT) AS u0, CAST((fid // 2) // side * 10 AS BIGINT) AS v0, CAST(fid % 2 AS INTEGER) AS half FROM faces, s")
def uv_atlas(spark: SparkSession, d: str) -> DataFrame:
    f = faces(spark, d)
    return atlas(f, f.count(), 10).select("fid", "u0", "v0", "half")
