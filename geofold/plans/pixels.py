"""Tiles, compositing, rasters, maps, level crossings and image measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions.geom import r6
from geofold.operators import field, knn, losses, mesh, ordering, raster, stats
from geofold.operators.quantiles import quantile_columns
from geofold.operators.shared import stash
from geofold.plans.book import Book, q6
from geofold.plans.fixtures import CORNERED, IMAGE, LOG, SPLATS, faces, image, log, splats, table, vertices
from geofold.plans.neighbours import NEAR
from geofold.plans.geometry import CENTRE, EWA, FOCAL, screen

BOOK = Book()
W = H = 64
#: Side of the raster of triangles, many of which reach across it.
R = 16

TILED = EWA + f""", boxes AS (SELECT *, CAST(least({W // 16}, greatest(0, floor((u - radius) / 16))) AS INTEGER) AS x0, CAST(least({W // 16}, greatest(0, floor((u + radius + 15) / 16))) AS INTEGER) AS x1, CAST(least({H // 16}, greatest(0, floor((v - radius) / 16))) AS INTEGER) AS y0, CAST(least({H // 16}, greatest(0, floor((v + radius + 15) / 16))) AS INTEGER) AS y1 FROM screen WHERE zc > 0.2),
tiled AS (SELECT b.*, CAST(ty * {W // 16} + tx AS INTEGER) AS tile FROM boxes b, LATERAL (SELECT unnest(range(y0, y1)) AS ty) t1, LATERAL (SELECT unnest(range(x0, x1)) AS tx) t2)"""


def _screen(spark, d):
    """Written once: filters on places in the image would else be pushed into the long arithmetic behind them."""
    return stash(screen(spark, d), "screen")


def _tiled(spark, d):
    return raster.tiles(_screen(spark, d).where("depth > 0.2"), W, H)


@BOOK.query(f"WITH {TILED} SELECT id, tile FROM tiled")
def tile_expand(spark: SparkSession, d: str) -> DataFrame:
    return _tiled(spark, d).select("id", "tile")


@BOOK.query(f"WITH {TILED}, n AS (SELECT tile, row_number() OVER (ORDER BY tile, zc, id) - 1 AS n FROM tiled) SELECT tile, min(n) AS first, max(n) + 1 AS last FROM n GROUP BY tile")
def tile_ranges(spark: SparkSession, d: str) -> DataFrame:
    return ordering.run_ranges(_tiled(spark, d), ["tile"], ["depth", "id"])


PIXELS = TILED + f", pixels AS (SELECT t.*, row, col FROM tiled t, LATERAL (SELECT unnest(range(tile // {W // 16} * 16, least(tile // {W // 16} * 16 + 16, {H}))) AS row) a, LATERAL (SELECT unnest(range(tile % {W // 16} * 16, least(tile % {W // 16} * 16 + 16, {W}))) AS col) b), powers AS (SELECT *, -0.5 * (k0 * (u - col) ** 2 + k2 * (v - row) ** 2) - k1 * (u - col) * (v - row) AS power FROM pixels), alphas AS (SELECT *, least(0.99, opacity * exp(power)) AS alpha FROM powers WHERE power <= 0), lit AS (SELECT *, coalesce(exp(sum(ln(1 - alpha)) OVER (PARTITION BY row, col ORDER BY zc, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS t FROM alphas WHERE alpha >= 1 / 255.0), used AS (SELECT * FROM lit WHERE t * (1 - alpha) >= 1e-4)"


@BOOK.query(f"WITH {PIXELS} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(sum(f0 * alpha * t), 5) + 0.0 AS value, round(min(t * (1 - alpha)), 5) + 0.0 AS light, count(*) AS layers FROM used GROUP BY row, col")
def splat_render(spark: SparkSession, d: str) -> DataFrame:
    """Colour of every pixel, nearest splats first."""
    out = raster.rendered(_tiled(spark, d), W, H, ["f0"])
    return out.select("row", "col", r6("f0", 5).alias("value"), r6("light", 5).alias("light"), "layers")


def _depth_and_normals(spark, d):
    """(row, col, depth, nx, ny, nz): normals are turned to face the camera, and the third component follows from the other two."""
    facing = F.signum(-F.col("nx") * F.col("x") - F.col("ny") * F.col("y") - F.col("nz") * F.col("depth"))
    rows = _tiled(spark, d).withColumns({"nx": F.col("nx") * facing, "ny": F.col("ny") * facing})
    out = raster.rendered(rows, W, H, ["depth", "nx", "ny"])
    return out.select("row", "col", "depth", "nx", "ny", (-F.sqrt(1 - F.least(F.lit(1.0), F.col("nx") ** 2 + F.col("ny") ** 2))).alias("nz"))


_RENDER = "faced AS (SELECT row, col, zc, alpha * t AS w, nx * f AS nx, ny * f AS ny FROM (SELECT *, sign(-nx * x - ny * y - nz * zc) AS f FROM used)), summed AS (SELECT row, col, sum(zc * w) AS depth, sum(nx * w) AS nx, sum(ny * w) AS ny FROM faced GROUP BY row, col)"


@BOOK.query(f"WITH {PIXELS}, {_RENDER} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(depth, 5) + 0.0 AS depth, round(nx, 5) + 0.0 AS nx, round(ny, 5) + 0.0 AS ny, round(-sqrt(1 - least(1, nx * nx + ny * ny)), 5) + 0.0 AS nz FROM summed")
def depth_normal_render(spark: SparkSession, d: str) -> DataFrame:
    """Depth and normals by the same blending."""
    return _depth_and_normals(spark, d).select("row", "col", *(r6(c, 5).alias(c) for c in ("depth", "nx", "ny", "nz")))



@BOOK.query(
    f"WITH {PIXELS}, {_RENDER}, grid AS (SELECT r.i AS row, c.i AS col, coalesce(depth, 0) AS depth, coalesce(nx, 0) AS nx, coalesce(ny, 0) AS ny FROM range({H}) r(i) CROSS JOIN range({W}) c(i) LEFT JOIN summed ON summed.row = r.i AND summed.col = c.i), "
    f"places AS (SELECT *, -sqrt(1 - least(1, nx * nx + ny * ny)) AS nz, (col - {CENTRE[0]}) / {FOCAL[0]} * depth AS px, (row - {CENTRE[1]}) / {FOCAL[1]} * depth AS py, depth AS pz FROM grid), "
    f"steps AS (SELECT *, {', '.join(f'lead(p{c}) OVER d - lag(p{c}) OVER d AS d{c}, lead(p{c}) OVER a - lag(p{c}) OVER a AS a{c}' for c in 'xyz')} FROM places WINDOW d AS (PARTITION BY col ORDER BY row), a AS (PARTITION BY row ORDER BY col)), "
    "crossed AS (SELECT *, dy * az - dz * ay AS cx, dz * ax - dx * az AS cy, dx * ay - dy * ax AS cz FROM steps) "
    f"SELECT {q6(f'avg(1 - CASE WHEN row BETWEEN 1 AND {H - 2} AND col BETWEEN 1 AND {W - 2} THEN (nx * cx + ny * cy + nz * cz) / greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-12) ELSE 0 END)', 'loss')} FROM crossed"
)
def depth_normal_loss(spark: SparkSession, d: str) -> DataFrame:
    """Rendered normals against those that the rendered depth implies; pixels without a splat have depth 0 and face the camera."""
    seen = _depth_and_normals(spark, d)
    cells = spark.range(H * W).select(F.floor(F.col("id") / W).cast("int").alias("row"), (F.col("id") % W).cast("int").alias("col"))
    whole = cells.join(seen, ["row", "col"], "left").na.fill(0.0, ["depth", "nx", "ny"]).na.fill(-1.0, ["nz"])
    return losses.depth_normal_consistency(losses.depth_normals(whole, H, W, FOCAL, CENTRE)).select(r6("loss").alias("loss"))


@BOOK.query(f"WITH {LOG}, a AS (SELECT run, iteration, least(0.99, value / 300) AS alpha, value FROM log), lit AS (SELECT *, coalesce(exp(sum(ln(1 - alpha)) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS t FROM a WHERE alpha >= 1 / 255.0), used AS (SELECT * FROM lit WHERE t * (1 - alpha) >= 1e-4) SELECT run, round(sum(value * alpha * t) + min(t * (1 - alpha)), 5) AS value, count(*) AS layers FROM used GROUP BY run")
def alpha_composite(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).withColumn("alpha", F.least(F.lit(0.99), F.col("value") / 300))
    return raster.composited(rows, ["run"], ["iteration"], ["value"], background=1.0).select("run", F.round("value", 5).alias("value"), "layers")


def _flat(spark, d):
    corners = mesh.with_corners(faces(spark, d), vertices(spark, d))
    place = [((F.col(f"{k}{c}") + 0.5) * R).alias(f"{k}{n}") for k in "abc" for c, n in (("x", "u"), ("y", "v"))]
    return corners.select("fid", *place, *(F.col(f"{k}z") for k in "abc"))


FLAT = CORNERED + f", flat AS (SELECT fid, (ax + 0.5) * {R} AS au, (ay + 0.5) * {R} AS av, (bx + 0.5) * {R} AS bu, (by_ + 0.5) * {R} AS bv, (cx + 0.5) * {R} AS cu, (cy + 0.5) * {R} AS cv, az, bz, cz FROM cornered), " + f"centres AS (SELECT r.i AS row, c.i AS col, c.i + 0.5 AS x, r.i + 0.5 AS y FROM range({R}) r(i), range({R}) c(i))"
SIDES = FLAT + ", sides AS (SELECT row, col, fid, az, bz, cz, (cu - bu) * (y - bv) - (cv - bv) * (x - bu) AS e0, (au - cu) * (y - cv) - (av - cv) * (x - cu) AS e1, (bu - au) * (y - av) - (bv - av) * (x - au) AS e2 FROM flat JOIN centres ON x BETWEEN least(au, bu, cu) AND greatest(au, bu, cu) AND y BETWEEN least(av, bv, cv) AND greatest(av, bv, cv)), hits AS (SELECT row, col, fid, (e0 * az + e1 * bz + e2 * cz) / (e0 + e1 + e2) AS z FROM sides WHERE e0 + e1 + e2 <> 0 AND e0 * (e0 + e1 + e2) >= 0 AND e1 * (e0 + e1 + e2) >= 0 AND e2 * (e0 + e1 + e2) >= 0), nearest AS (SELECT row, col, min(z) AS z FROM hits GROUP BY row, col)"


@BOOK.query(f"WITH {SIDES} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, {q6('z', 'z')} FROM nearest")
def triangle_raster(spark: SparkSession, d: str) -> DataFrame:
    return raster.triangle_pixels(_flat(spark, d), R, R).select("row", "col", r6("z").alias("z"))


@BOOK.query(f"WITH {SIDES} SELECT {q6(f'(SELECT count(*) FROM nearest) / {R * R}', 'coverage')}, {q6('coalesce((SELECT quantile_cont(z, 0.01) FROM nearest), 0)', 'low')}, {q6('coalesce((SELECT quantile_cont(z, 0.99) FROM nearest), 1)', 'high')}")
def pixel_coverage(spark: SparkSession, d: str) -> DataFrame:
    hit = raster.triangle_pixels(_flat(spark, d), R, R)
    hit = stash(hit, "hits")  # read twice
    outer = quantile_columns(hit, {"low": ("z", 0.01), "high": ("z", 0.99)})
    return hit.agg(r6(F.count("*") / (R * R)).alias("coverage")).join(F.broadcast(outer)).select("coverage", r6(F.coalesce("low", F.lit(0.0))).alias("low"), r6(F.coalesce("high", F.lit(1.0))).alias("high"))


@BOOK.query(f"WITH {SIDES}, one AS (SELECT n.row, n.col, n.z, min(fid) AS fid FROM nearest n JOIN hits h ON h.row = n.row AND h.col = n.col AND h.z = n.z GROUP BY ALL) SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, {q6('f0', 'f0')} FROM one JOIN splats ON splats.id = fid // 2 % (SELECT count(*) FROM splats)")
def pixel_face_splat(spark: SparkSession, d: str) -> DataFrame:
    """Pixel to face to the splat bound to it."""
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    hit = raster.triangle_pixels(_flat(spark, d), R, R).join(F.broadcast(n)).withColumn("id", F.floor(F.col("fid") / 2) % F.col("n"))
    return hit.join(splats(spark, d).select("id", "f0"), "id").select("row", "col", r6("f0").alias("f0"))


@BOOK.query(f"WITH {IMAGE} SELECT img, row, col, {q6('coalesce((lead(value) OVER a - lag(value) OVER a) / 2, 0)', 'd_col')}, {q6('coalesce((lead(value) OVER b - lag(value) OVER b) / 2, 0)', 'd_row')} FROM image WINDOW a AS (PARTITION BY img, row ORDER BY col), b AS (PARTITION BY img, col ORDER BY row)")
def central_difference(spark: SparkSession, d: str) -> DataFrame:
    g = raster.central_differences(image(spark, d), "value", ["img"])
    return g.select("img", "row", "col", r6("d_col").alias("d_col"), r6("d_row").alias("d_row"))


#: Depths of pixels without a hit are the background's.
BACKGROUND = 4.0
DEPTH = IMAGE + f", depth AS (SELECT img, row, col, CASE WHEN value > -0.15 THEN 2 + value ELSE {BACKGROUND} END AS depth, 0.2 + value AS normal FROM image), g AS (SELECT *, lag(depth) OVER a AS l, lead(depth) OVER a AS r, lag(depth) OVER b AS u, lead(depth) OVER b AS o FROM depth WINDOW a AS (PARTITION BY img, row ORDER BY col), b AS (PARTITION BY img, col ORDER BY row)), mask AS (SELECT *, depth < 0.98 * {BACKGROUND} AND coalesce(l < 0.98 * {BACKGROUND} AND r < 0.98 * {BACKGROUND} AND u < 0.98 * {BACKGROUND} AND o < 0.98 * {BACKGROUND}, false) AND row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5 AND coalesce(greatest(abs(r - l), abs(o - u)) / 2 < 0.05 * abs(depth), false) AND normal > 0.1 AS valid FROM g)"


def _valid(spark, d):
    grid = image(spark, d).select("img", "row", "col", F.when(F.col("value") > -0.15, 2 + F.col("value")).otherwise(BACKGROUND).alias("depth"), (0.2 + F.col("value")).alias("normal"))
    return raster.valid_depth(grid, ["img"], 8, 8, F.lit(BACKGROUND), normal="normal")


@BOOK.query(f"WITH {DEPTH} SELECT img, row, col, valid FROM mask")
def dnc_mask(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d).select("img", "row", "col", "valid")


@BOOK.query(f"WITH {DEPTH} SELECT {q6('coalesce(sum((1 - abs(cos(depth))) * CAST(valid AS INTEGER)), 0) / greatest(coalesce(sum(CAST(valid AS INTEGER)), 0), 1)', 'loss')} FROM mask")
def masked_loss(spark: SparkSession, d: str) -> DataFrame:
    return stats.masked_mean(_valid(spark, d), 1 - F.abs(F.cos("depth")), F.col("valid")).select(r6("loss").alias("loss"))


@BOOK.query(f"WITH {IMAGE}, l AS (SELECT img, lag(value) OVER a + lead(value) OVER a + lag(value) OVER b + lead(value) OVER b - 4 * value AS lap FROM image WINDOW a AS (PARTITION BY img, row ORDER BY col), b AS (PARTITION BY img, col ORDER BY row)) SELECT img, {q6('var_pop(lap)', 'sharpness')} FROM l WHERE lap IS NOT NULL GROUP BY img")
def sharpness(spark: SparkSession, d: str) -> DataFrame:
    return raster.laplacian_variance(image(spark, d), "value", ["img"]).select("img", r6("sharpness").alias("sharpness"))


@BOOK.query(f"WITH {IMAGE}, e AS (SELECT a.value - b.value AS d FROM image a JOIN image b ON b.img = a.img AND b.row = a.col AND b.col = a.row) SELECT {q6('avg(abs(d))', 'l1')}, {q6('avg(d * d)', 'mse')}, {q6('-10 * log10(avg(d * d))', 'psnr')} FROM e")
def image_errors(spark: SparkSession, d: str) -> DataFrame:
    img = image(spark, d)
    e = raster.image_errors(img, img.select("img", F.col("col").alias("row"), F.col("row").alias("col"), "value"), ["img", "row", "col"], "value")
    return e.select(*(r6(c).alias(c) for c in ("l1", "mse", "psnr")))


def _ssim_sql() -> str:
    """Windows of 11 by 11, one axis after the other; pixels outside count as 0."""
    raw = [math.exp(-((k - 5) ** 2) / 4.5) for k in range(11)]
    taps = "taps AS (SELECT * FROM (VALUES " + ", ".join(f"({k - 5}, {x / sum(raw)!r}::DOUBLE)" for k, x in enumerate(raw)) + ") t(d, w))"
    names = ("x", "y", "xx", "yy", "xy")
    blurred = lambda name, of, along, across: f"{name} AS (SELECT {across}, {along} + d AS {along}, {', '.join(f'sum({n} * w) AS {n}' for n in names)} FROM {of}, taps GROUP BY {across}, {along} + d)"
    return f"""WITH {IMAGE}, {taps}, tall AS (SELECT img * 8 + row AS row, col, value AS x FROM image), pairs AS (SELECT a.row, a.col, a.x, b.x AS y, a.x * a.x AS xx, b.x * b.x AS yy, a.x * b.x AS xy FROM tall a JOIN tall b ON b.row = a.row AND b.col = 7 - a.col),
    {blurred('once', 'pairs', 'row', 'col')}, {blurred('twice', 'once', 'col', 'row')}, m AS (SELECT twice.* FROM twice JOIN tall USING (row, col))
    SELECT {q6('avg((2 * x * y + 0.0001) * (2 * (xy - x * y) + 0.0009) / ((x * x + y * y + 0.0001) * (xx - x * x + yy - y * y + 0.0009)))', 'ssim')} FROM m"""


@BOOK.query(_ssim_sql())
def image_ssim(spark: SparkSession, d: str) -> DataFrame:
    """Structural similarity of all vectors, seen as one tall image, with their mirror images."""
    tall = image(spark, d).select((F.col("img") * 8 + F.col("row")).cast("int").alias("row"), "col", F.col("value"))
    mirrored = tall.select("row", (7 - F.col("col")).alias("col"), "value")
    return raster.ssim(tall, mirrored, "value").select(r6("ssim").alias("ssim"))


@BOOK.query(f"WITH {IMAGE}, p AS (SELECT img % 10 AS cam, img % 7 AS texel, min((row, col, img, value)) AS m FROM image GROUP BY ALL) SELECT texel, {q6('avg(m[4])', 'value')}, count(*) AS n FROM p GROUP BY texel".replace("min((row, col, img, value)) AS m", "arg_min(value, (row, col, img)) AS m").replace("avg(m[4])", "avg(m)"))
def texture_average(spark: SparkSession, d: str) -> DataFrame:
    hits = image(spark, d).select((F.col("img") % 10).alias("cam"), (F.col("img") % 7).alias("texel"), "row", "col", "img", "value")
    return raster.texture_average(hits, ["texel"], "cam", ["row", "col", "img"], ["value"]).select("texel", r6("value").alias("value"), "n")


_ALONG = "(SELECT sqrt(" + " + ".join(f"((m0{k} * -x + m1{k} * -y + m2{k} * -zc) * s{k}) ** 2" for k in range(3)) + ") / sqrt(x * x + y * y + zc * zc))"


@BOOK.query(
    f"WITH {EWA}, {IMAGE}, mean AS (SELECT row, col, avg(value) + 1 AS depth FROM image GROUP BY ALL), places AS (SELECT *, least(greatest(u / 8, 0), 7) AS mu, least(greatest(v / 8, 0), 7) AS mv FROM screen), "
    "corners AS (SELECT *, CAST(least(floor(mv) + a.i, 7) AS INTEGER) AS row, CAST(least(floor(mu) + b.i, 7) AS INTEGER) AS col, (CASE WHEN a.i = 1 THEN mv - floor(mv) ELSE 1 - mv + floor(mv) END) * (CASE WHEN b.i = 1 THEN mu - floor(mu) ELSE 1 - mu + floor(mu) END) AS share FROM places, range(2) a(i), range(2) b(i)), "
    f"mapped AS (SELECT id, sum(share * depth) AS map_depth FROM corners JOIN mean USING (row, col) GROUP BY id) SELECT id FROM screen JOIN mapped USING (id) WHERE abs(map_depth - zc) < 3 * {_ALONG}"
)
def near_surface(spark: SparkSession, d: str) -> DataFrame:
    """Splats near the depth that the images' mean says, read between its pixels."""
    depth = image(spark, d).groupBy("row", "col").agg((F.avg("value") + 1).alias("map_depth"))
    rows = _screen(spark, d).withColumns({"u": F.col("u") / 8, "v": F.col("v") / 8})
    return field.near_surface(rows, depth, [F.lit(0.0), F.lit(0.0), F.lit(-1.0)], 8, 8).select("id")


@BOOK.query(f"WITH {LOG}, r AS (SELECT run, iteration, value, lag(value) OVER w AS v0, first(value) OVER w AS f FROM log WINDOW w AS (PARTITION BY run ORDER BY iteration)), c AS (SELECT run, arg_min((value, v0, iteration), iteration) AS c FROM r WHERE value > 60 AND v0 IS NOT NULL AND f < 60 GROUP BY run) SELECT run, {q6('c[3] - 1 + (60 - c[2]) / (c[1] - c[2])', 'at')} FROM c".replace("arg_min((value, v0, iteration), iteration) AS c", "arg_min(value, iteration) AS a, arg_min(v0, iteration) AS b, min(iteration) AS t").replace("c[3] - 1 + (60 - c[2]) / (c[1] - c[2])", "t - 1 + (60 - b) / (a - b)"))
def level_crossing(spark: SparkSession, d: str) -> DataFrame:
    return field.first_crossing(log(spark, d).select("run", F.col("iteration").cast("double").alias("at"), "value"), "run", "at", "value", 60.0).select("run", r6("at").alias("at"))


_SIDE = 8


@BOOK.query(f"WITH {SPLATS}, box AS (SELECT {', '.join(f'min({c}) AS lo{c}, max({c}) AS hi{c}' for c in 'xyz')} FROM splats), probes AS (SELECT a.i + {_SIDE} * b.i + {_SIDE**2} * c.i AS id, lox + (hix - lox) * a.i / {_SIDE - 1} AS x, loy + (hiy - loy) * b.i / {_SIDE - 1} AS y, loz + (hiz - loz) * c.i / {_SIDE - 1} AS z FROM box, range({_SIDE}) a(i), range({_SIDE}) b(i), range({_SIDE}) c(i)), {NEAR(1, 'splats', 'probes')} SELECT probes.id, {q6('x', 'x')}, {q6('y', 'y')}, {q6('z', 'z')}, j, {q6('d2', 'd2')} FROM probes JOIN near ON i = probes.id")
def probe_lattice(spark: SparkSession, d: str) -> DataFrame:
    """A lattice of probes through the splats' box, each with the splat nearest to it."""
    box = splats(spark, d).agg(*(f(c).alias(f"{k}{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"))
    step = lambda k: F.floor(F.col("id") / _SIDE**k) % _SIDE / (_SIDE - 1)
    probes = spark.range(_SIDE**3).join(F.broadcast(box)).select("id", *((F.col(f"lo{c}") + (F.col(f"hi{c}") - F.col(f"lo{c}")) * step(k)).alias(c) for k, c in enumerate("xyz")))
    near = knn.knn(splats(spark, d).select("id", *"xyz"), 1, probes).select(F.col("i").alias("id"), "j", "d2")
    return probes.join(near, "id").select("id", *(r6(c).alias(c) for c in "xyz"), "j", r6("d2").alias("d2"))
