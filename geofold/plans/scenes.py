"""Visible splats, regularisers, level points, camera poses and stacked scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions.geom import apply, norm, normalized, quaternion_matrix, r6, transposed
from geofold.operators import field, filters, isosurface, knn, losses, raster, sampling, stats
from geofold.operators.knn import XYZ
from geofold.operators.shared import stash
from geofold.plans.book import Book, q6
from geofold.plans.fixtures import EDGES, IMAGE, SPLATS, faces, image, splats, table, vertices
from geofold.plans.meshes import ANGLES
from geofold.plans.neighbours import _BACK, _OWN, _pairs, FIELD, NEAR
from geofold.plans.measures import BOXED, _boxed
from geofold.plans.pixels import R, SIDES, _flat
from geofold.sources.text import posed_cameras

BOOK = Book()

SEEN = SPLATS + ", seen AS (SELECT *, CASE WHEN z + 0.25 > 0.2 THEN ceil(300 * greatest(s0, s1, s2)) ELSE 0 END AS radius FROM splats)"


def _seen(spark, d):
    return splats(spark, d).withColumn("radius", F.when(F.col("z") + 0.25 > 0.2, F.ceil(300 * F.greatest("s0", "s1", "s2"))).otherwise(0))


@BOOK.query(f"WITH {SEEN} SELECT id, CAST(radius AS BIGINT) AS radius FROM seen WHERE radius > 0")
def visibility_filter(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).where(filters.visible()).select("id", F.col("radius").cast("long").alias("radius"))


@BOOK.query(f"WITH {SEEN} SELECT {q6('avg(-opacity * ln(opacity + 1e-10) - (1 - opacity) * ln(1 - opacity + 1e-10))', 'loss')} FROM seen WHERE radius > 0")
def entropy_loss(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).where(filters.visible()).agg(r6(F.avg(losses.entropy("opacity"))).alias("loss"))


_SDF = "beta * (sqrt(-2 * ln(greatest(least(density, 1), 1e-12))) - sqrt(2 * ln(2)))"


@BOOK.query(
    f"""WITH {FIELD} SELECT {q6(f'avg(least(abs({_SDF} - abs(s.z)) / s.s0, 30))', 'distance')}, {q6('avg(abs(density - exp(-0.5 * (s.z / beta) ** 2)))', 'density')},
    {q6('avg(least((s.z / s.s0) ** 2, 30))', 'surface')} FROM dens JOIN splats s ON s.id = i"""
)
def sdf_estimation_losses(spark: SparkSession, d: str) -> DataFrame:
    """The three misfits of the field at the splats' places, whose z stands for the estimated distance."""
    f = field.signed_distance(field.density(_pairs(spark, d, 8))).join(splats(spark, d).select(F.col("id").alias("i"), "z", "s0"), "i")
    return f.agg(
        r6(F.avg(losses.distance_misfit("sdf", "z", "s0", 30.0))).alias("distance"),
        r6(F.avg(losses.density_misfit("density", "beta", "z"))).alias("density"),
        r6(F.avg(losses.surface_misfit("z", "s0", 30.0, squared=True))).alias("surface"),
    )


@BOOK.query(f"WITH {ANGLES} SELECT count(*) AS pairs, {q6('avg(1 - cos(radians(raw)))', 'loss')} FROM angles")
def normal_consistency_loss(spark: SparkSession, d: str) -> DataFrame:
    return losses.normal_consistency(faces(spark, d), vertices(spark, d)).select("pairs", r6("loss").alias("loss"))


@BOOK.query(
    f"""WITH {EDGES}, {SPLATS}, pairs AS (SELECT DISTINCT u, v FROM edges), both_ AS (SELECT u AS vid, v AS o FROM pairs UNION ALL SELECT v, u FROM pairs),
    m AS (SELECT vid, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM both_ JOIN splats ON id = o GROUP BY vid)
    SELECT {q6('avg(sqrt(coalesce((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2, 0)))', 'loss')} FROM splats LEFT JOIN m ON vid = id"""
)
def laplacian_loss(spark: SparkSession, d: str) -> DataFrame:
    return losses.laplacian(vertices(spark, d), faces(spark, d)).select(r6("loss").alias("loss"))


@BOOK.query(f"WITH {IMAGE} SELECT img, {q6('coalesce(quantile_cont(value, 0.01) FILTER (value > 0.2), 0)', 'low')}, {q6('coalesce(quantile_cont(value, 0.99) FILTER (value > 0.2), 1)', 'high')} FROM image GROUP BY img")
def robust_depth_range(spark: SparkSession, d: str) -> DataFrame:
    return stats.robust_range(image(spark, d), ["img"], "value", F.col("value") > 0.2).select("img", r6("low").alias("low"), r6("high").alias("high"))


@BOOK.query(
    f"""WITH {BOXED}, picked AS (SELECT id, x, y, z FROM boxed WHERE NOT fg), {NEAR(2, "picked", "picked")},
    side AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM picked)
    SELECT CAST(least(floor(-log2(100 * quantile_cont(d2 / side, 0.1))), 10) AS INTEGER) AS depth, count(*) AS points FROM near, side WHERE rank = 1"""
)
def octree_depth_background(spark: SparkSession, d: str) -> DataFrame:
    """The octree's depth for the background's own points and box; null for fewer than two."""
    picked = _boxed(spark, d).where(~F.col("fg")).select("id", *XYZ)
    side = picked.agg(F.greatest(*(F.max(c) - F.min(c) for c in XYZ)).alias("side"))
    near = knn.knn(picked, 2).where("rank = 1").join(F.broadcast(side))
    (low,) = stats.quantiles(near, F.col("d2") / F.col("side"), [0.1])
    raw = -F.log2(100 * F.lit(low).cast("double"))
    return near.agg(F.least(F.floor(raw), F.lit(10)).cast("int").alias("depth"), F.count("*").alias("points"))


_FOV = "2 * atan(640 / (2 * ({})))"


@BOOK.query(
    f"""WITH c AS (SELECT n_nationkey AS camera_id, ['PINHOLE', 'SIMPLE_PINHOLE', 'OPENCV', 'RADIAL', 'PINHOLE'][n_regionkey + 1] AS model, 500.0 + n_nationkey AS f0, 400.0 + n_nationkey AS f1 FROM nation)
    SELECT c_custkey AS image_id, c_name AS name, {q6(_FOV.format('f0'), 'fov_x')}, {q6(_FOV.format("CASE WHEN model = 'PINHOLE' THEN f1 ELSE f0 END"), 'fov_y')}
    FROM customer JOIN c ON c_nationkey = camera_id WHERE model IN ('PINHOLE', 'SIMPLE_PINHOLE')"""
)
def posed_images(spark: SparkSession, d: str) -> DataFrame:
    """Customers as images of their nations' cameras."""
    model = F.array(*(F.lit(m) for m in ("PINHOLE", "SIMPLE_PINHOLE", "OPENCV", "RADIAL", "PINHOLE")))[F.col("n_regionkey")]
    cams = table(spark, d, "nation").select(F.col("n_nationkey").alias("camera_id"), model.alias("model"), F.lit(640).alias("width"), F.lit(640).alias("height"), F.array(500.0 + F.col("n_nationkey"), 400.0 + F.col("n_nationkey")).alias("params"))
    none = F.array().cast("array<double>")
    images = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("camera_id"), none.alias("qvec"), none.alias("tvec"))
    return posed_cameras(images, cams).select("image_id", "name", r6("fov_x").alias("fov_x"), r6("fov_y").alias("fov_y"))


@BOOK.query(f"WITH {SPLATS} SELECT CAST(label AS INTEGER) AS object, id, row_number() OVER (ORDER BY label, id) - 1 AS row, {q6('x + label', 'x')} FROM splats WHERE label IN (0, 1, 2)")
def scene_concat(spark: SparkSession, d: str) -> DataFrame:
    """Three objects, each moved to its place, in one table of rows."""
    parts = [splats(spark, d).where(F.col("label") == k).select("id", (F.col("x") + k).alias("x")) for k in range(3)]
    return sampling.stacked(parts, ["id"]).select("object", "id", "row", r6("x").alias("x"))


@BOOK.query("SELECT n_name, CAST(CASE WHEN n_regionkey > 1 OR n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS runs FROM nation")
def step_predicate(spark: SparkSession, d: str) -> DataFrame:
    """The 4 settings of two switches are judged once each; rows take the verdict of theirs."""
    verdict = {(a, b): filters.step_runs("${far} or not ${odd}", {"far": a, "odd": b}) for a in (False, True) for b in (False, True)}
    known = F.create_map(*(F.lit(x) for (a, b), v in verdict.items() for x in (f"{a}{b}".lower(), int(v))))
    key = F.concat((F.col("n_regionkey") > 1).cast("string"), (F.col("n_nationkey") % 2 == 1).cast("string"))
    return table(spark, d, "nation").select("n_name", known[key].alias("runs"))


@BOOK.query("SELECT CAST(e AS INTEGER) AS epoch, n_nationkey, row_number() OVER (PARTITION BY e ORDER BY md5(n_nationkey || '|' || e), n_nationkey) - 1 AS place FROM nation, range(3) t(e)")
def epoch_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Each epoch orders all cameras anew and leaves none out."""
    from functools import reduce

    epochs = [sampling.shuffled(table(spark, d, "nation").select("n_nationkey"), ["n_nationkey"], e).select(F.lit(e).alias("epoch"), "n_nationkey", "place") for e in range(3)]
    return reduce(DataFrame.unionByName, epochs)


_LEVEL = 0.3
_PAIRED = "s.s0, s.s1, s.s2, s.opacity, s.w_, s.i_, s.j_, s.k_"


_FAR = "far AS (SELECT *, sqrt(x ** 2 + y ** 2 + (z + 2) ** 2) AS far, sqrt(q0 ** 2 + q1 ** 2 + q2 ** 2 + q3 ** 2) AS qn FROM splats), turned AS (SELECT *, q0 / qn AS w_, q1 / qn AS i_, q2 / qn AS j_, q3 / qn AS k_, x / far AS dx, y / far AS dy, (z + 2) / far AS dz FROM far)"
_SD = f"sqrt((({_OWN[0]}) * s0) ** 2 + (({_OWN[1]}) * s1) ** 2 + (({_OWN[2]}) * s2) ** 2)"


def _surfaces(levels: list[float], of: str) -> str:
    """SQL from rays (id, x y z, ux uy uz, sd) to points with slopes; of: the rays' column that their splats are near to."""
    return f"""steps AS (SELECT *, sd * 3 * (2 * k / 20 - 1) AS t FROM rays, range(21) r(k)),
    shares AS (SELECT st.id AS i, st.t, st.x + t * ux - s.x AS dx, st.y + t * uy - s.y AS dy, st.z + t * uz - s.z AS dz, {_PAIRED} FROM steps st JOIN near n ON n.i = st.{of} JOIN turned s ON s.id = n.j),
    raw AS (SELECT i, t, sum(opacity * exp(-0.5 * least(1e8, (({_OWN[0]}) / s0) ** 2 + (({_OWN[1]}) / s1) ** 2 + (({_OWN[2]}) / s2) ** 2))) AS raw FROM shares GROUP BY i, t),
    held AS (SELECT i, t, CASE WHEN raw >= 1 THEN raw / (raw + 1e-12) ELSE raw END AS density FROM raw),
    lagged AS (SELECT *, lag(density) OVER w AS v0, lag(t) OVER w AS t0, first(density) OVER w AS f FROM held WINDOW w AS (PARTITION BY i ORDER BY t)),
    crossed AS (SELECT i, level, arg_min(t0 + (level - v0) / (density - v0) * (t - t0), t) AS t FROM lagged, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in levels)}]) AS level) WHERE density > level AND v0 IS NOT NULL AND f < level GROUP BY i, level),
    points AS (SELECT i, level, {of} AS of_, t, x + t * ux AS lx, y + t * uy AS ly, z + t * uz AS lz FROM crossed JOIN rays ON id = i),
    again AS (SELECT p.i, level, lx - s.x AS dx, ly - s.y AS dy, lz - s.z AS dz, {_PAIRED} FROM points p JOIN near n ON n.i = p.of_ JOIN turned s ON s.id = n.j),
    own AS (SELECT *, ({_OWN[0]}) / s0 AS o0, ({_OWN[1]}) / s1 AS o1, ({_OWN[2]}) / s2 AS o2 FROM again),
    v AS (SELECT *, o0 / s0 AS v0, o1 / s1 AS v1, o2 / s2 AS v2, opacity * exp(-0.5 * least(1e8, o0 ** 2 + o1 ** 2 + o2 ** 2)) AS w FROM own),
    slope AS (SELECT i, level, sum(-w * ({_BACK[0]})) AS gx, sum(-w * ({_BACK[1]})) AS gy, sum(-w * ({_BACK[2]})) AS gz FROM v GROUP BY i, level)
    SELECT p.i, level, {q6('lx', 'lx')}, {q6('ly', 'ly')}, {q6('lz', 'lz')}, {', '.join(q6(f'-g{c} / sqrt(gx * gx + gy * gy + gz * gz)', f'n{c}') for c in 'xyz')} FROM points p JOIN slope USING (i, level)"""


_NEEDED = ("nx_", "ny_", "nz_", "s0", "s1", "s2", "q0", "q1", "q2", "q3", "opacity")


def _near_splats(all_: DataFrame, k: int) -> DataFrame:
    return knn.knn(all_.withColumns({f"n{c}_": F.col(c) for c in XYZ}), k, payload=_NEEDED).withColumnsRenamed({f"n{c}_": c for c in XYZ}).select("i", *field.SPLAT)


@BOOK.query(f"WITH {SPLATS}, {NEAR(8)}, {_FAR}, rays AS (SELECT id, x, y, z, dx AS ux, dy AS uy, dz AS uz, {_SD} AS sd FROM turned), {_surfaces([_LEVEL], 'id')}".replace("GROUP BY i, level)\n    SELECT p.i, level,", "GROUP BY i, level)\n    SELECT p.i,"))
def level_points(spark: SparkSession, d: str) -> DataFrame:
    """Surface points and normals on rays from one camera through all splats."""
    all_ = splats(spark, d)
    u = normalized([F.col("x"), F.col("y"), F.col("z") + 2])
    own = apply(transposed(quaternion_matrix([f"q{k}" for k in range(4)])), u)
    sd = norm([v * F.col(f"s{k}") for k, v in enumerate(own)])
    rays = all_.select(F.col("id").alias("i"), *(F.col(c).alias(f"p{c}") for c in XYZ), *(v.alias(f"u{c}") for v, c in zip(u, XYZ, strict=True)), sd.alias("sd"))
    found = field.level_points(rays, _near_splats(all_, 8), _LEVEL)
    return found.select("i", *(r6(c).alias(c) for c in ("lx", "ly", "lz", "nx", "ny", "nz")))


_LEVELS = [0.1, 0.3, 0.5]
#: Pixels from which surfaces are sought.
_PIXELS = 120


@BOOK.query(
    f"WITH {SIDES.replace('WITH ', '')}, {NEAR(8)}, {_FAR}, one AS (SELECT n.row * {R} + n.col AS pixel, n.row, n.col, n.z, min(fid) // 2 % (SELECT count(*) FROM splats) AS owner FROM nearest n JOIN hits h ON h.row = n.row AND h.col = n.col AND h.z = n.z GROUP BY ALL), "
    f"picked AS (SELECT pixel AS id, owner, (col + 0.5) / {R} - 0.5 AS x, (row + 0.5) / {R} - 0.5 AS y, z FROM one ORDER BY md5(pixel || '|3'), pixel LIMIT {_PIXELS}), spread AS (SELECT id AS owner, {_SD} AS sd FROM turned), "
    f"rays AS (SELECT id, p.owner, x, y, z, x / f AS ux, y / f AS uy, (z + 2) / f AS uz, sd FROM (SELECT *, sqrt(x ** 2 + y ** 2 + (z + 2) ** 2) AS f FROM picked) p JOIN spread USING (owner)), {_surfaces(_LEVELS, 'owner')}"
)
def level_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces of three levels from a subsample of a raster's pixels: rays through the pixels' depths, densities of the splats around the one seen there."""
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    hit = raster.triangle_pixels(_flat(spark, d), R, R).join(F.broadcast(n))
    pixels = hit.select((F.col("row") * R + F.col("col")).cast("long").alias("i"), (F.floor(F.col("fid") / 2) % F.col("n")).alias("owner"), *(((F.col(k) + 0.5) / R - 0.5).alias(f"p{c}") for c, k in (("x", "col"), ("y", "row"))), F.col("z").alias("pz"))
    all_ = splats(spark, d)
    rays = stash(field.pixel_rays(sampling.subsample(pixels, ["i"], _PIXELS, seed=3), all_, [F.lit(0.0), F.lit(0.0), F.lit(-2.0)]), "rays")
    found = field.level_surfaces(rays, _near_splats(all_, 8).withColumnRenamed("i", "owner"), _LEVELS, by="owner")
    return found.select("i", "level", *(r6(c).alias(c) for c in ("lx", "ly", "lz", "nx", "ny", "nz")))


# ---- level surfaces: images stacked to a grid, image number by row by column

_GRID = IMAGE + ", grid AS (SELECT img AS i, row AS j, col AS k, value FROM image)"
_CUT = " UNION ALL ".join(
    f"SELECT {', '.join(f'p.{c} + ' + (f'(0.05 - p.value) / (q.value - p.value) AS {n}' if c == a else f'0.0 AS {n}') for c, n in zip('ijk', 'xyz', strict=True))} FROM grid p JOIN grid q ON "
    + " AND ".join(f"q.{c} = p.{c}" + (" + 1" if c == a else "") for c in "ijk")
    + " WHERE (p.value > 0.05) <> (q.value > 0.05)"
    for a in "ijk"
)


def _grid(spark, d):
    return image(spark, d).select(F.col("img").alias("i"), F.col("row").alias("j"), F.col("col").alias("k"), "value")


@BOOK.query(f"WITH {_GRID}, cut AS ({_CUT}) SELECT {q6('x', 'x')}, {q6('y', 'y')}, {q6('z', 'z')} FROM cut")
def isosurface_vertices(spark: SparkSession, d: str) -> DataFrame:
    return isosurface.level_surface(_grid(spark, d), 0.05)[0].select(*(r6(c).alias(c) for c in XYZ))


@BOOK.query()
def isosurface_faces(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of the level surface; the tests hold them against the surface's closedness."""
    return isosurface.level_surface(_grid(spark, d), 0.05)[1]
