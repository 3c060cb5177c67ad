"""Density fields of splats at sample points, their derived values, and level crossings along rays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofold.functions.geom import apply, dot, inverse_root, norm, normalized, quaternion_matrix, sub, transposed
from geofold.operators.raster import bilinear

#: Columns of a splat that the field needs, as payload of a neighbour join.
SPLAT = ("x", "y", "z", "s0", "s1", "s2", "q0", "q1", "q2", "q3", "opacity")
MOST = 1e8


def weights(pairs: DataFrame, density_factor: float = 1.0) -> DataFrame:
    """pairs (i, sample px py pz, splat columns) with m2, the splat's share ``w`` and its difference in its own frame."""
    d = sub(["px", "py", "pz"], ["x", "y", "z"])
    own = inverse_root([f"q{k}" for k in range(4)], ["s0", "s1", "s2"], d)
    m2 = F.least(dot(own, own), F.lit(MOST))
    return pairs.withColumn("m2", m2).withColumn("w", density_factor * F.col("opacity") * F.exp(-0.5 * F.col("m2")))


def density(pairs: DataFrame, density_factor: float = 1.0) -> DataFrame:
    """(i, density, beta): summed shares, those of 1 or more drawn back to just below 1; beta is the mean least scale of the splats near."""
    least = F.least("s0", "s1", "s2")
    summed = weights(pairs, density_factor).groupBy("i").agg(F.sum("w").alias("raw"), F.avg(least).alias("beta"), F.sum(F.col("w") * least).alias("weighted"))
    held = F.when(F.col("raw") >= 1, F.col("raw") / (F.col("raw") + 1e-12)).otherwise(F.col("raw"))
    return summed.select("i", held.alias("density"), "beta", (F.col("weighted") / F.greatest(F.col("raw"), F.lit(1e-12))).alias("weighted_beta"))


def signed_distance(field: DataFrame) -> DataFrame:
    """field with sdf = beta * (sqrt(-2 ln density) - sqrt(-2 ln 0.5))."""
    d = F.greatest(F.least("density", F.lit(1.0)), F.lit(1e-12))
    return field.withColumn("sdf", F.col("beta") * (F.sqrt(-2 * F.ln(d)) - F.sqrt(F.lit(-2 * -0.6931471805599453))))


def gradient(pairs: DataFrame, density_factor: float = 1.0) -> DataFrame:
    """(i, gx, gy, gz): the density's gradient."""
    rows = weights(pairs, density_factor)
    m = quaternion_matrix([f"q{k}" for k in range(4)])
    own = inverse_root([f"q{k}" for k in range(4)], ["s0", "s1", "s2"], sub(["px", "py", "pz"], ["x", "y", "z"]))
    scaled = [v / F.col(f"s{k}") for k, v in enumerate(own)]
    return rows.groupBy("i").agg(*(F.sum(-F.col("w") * v).alias(f"g{c}") for c, v in zip("xyz", apply(m, scaled), strict=True)))


def splat_normal(q: list[str], s: list[str]) -> list:
    """Direction of a splat's least axis (the first of equals)."""
    m = transposed(quaternion_matrix(q))
    least = F.least(*s)
    return [F.when(F.col(s[0]) == least, m[0][k]).when(F.col(s[1]) == least, m[1][k]).otherwise(m[2][k]) for k in range(3)]


def overlap(pairs: DataFrame, by_normals: bool = False) -> DataFrame:
    """(i, overlap): mean share of a splat's centre in its neighbours; by_normals weighs each by |cos| of the angle between both normals (own quaternion p0..p3, scales o0..o2)."""
    return weights(pairs.withColumn("opacity", F.lit(1.0))).groupBy("i").agg(F.avg(F.col("w") * _facing() if by_normals else F.col("w")).alias("overlap"))


def _facing():
    return F.abs(dot(splat_normal([f"p{k}" for k in range(4)], ["o0", "o1", "o2"]), splat_normal([f"q{k}" for k in range(4)], ["s0", "s1", "s2"])))


def alignment(pairs: DataFrame, factor: float = 1.0, by_normals: bool = False) -> DataFrame:
    """(i, alignment): mean of |distance / (factor * (own + other deviation)) - 1| over the neighbours.

    A splat's deviation is that along the line between both: the length of its scales times the line's
    direction in its own frame. Own scales are o0..o2, the own quaternion p0..p3; distance and the sum are 1e-8 at least.
    """
    shift = sub(["x", "y", "z"], ["px", "py", "pz"])
    dist = F.greatest(norm(shift), F.lit(1e-8))
    along = [c / dist for c in shift]
    deviation = lambda q, s: norm([c * F.col(k) for c, k in zip(apply(transposed(quaternion_matrix(q)), along), s, strict=True)])
    own, other = deviation([f"p{k}" for k in range(4)], ["o0", "o1", "o2"]), deviation([f"q{k}" for k in range(4)], ["s0", "s1", "s2"])
    value = F.abs(dist / F.greatest((own + other) * factor, F.lit(1e-8)) - 1)
    return pairs.groupBy("i").agg(F.avg(value * _facing() if by_normals else value).alias("alignment"))


def sdf_gradient(pairs: DataFrame, density_factor: float = 1.0, most: float = 10.0, least: float = 1e-16) -> DataFrame:
    """(i, gx, gy, gz): the signed distance's gradient, beta / (d * sqrt(-2 ln d)) times the density's falling slope, each part held within ``most``."""
    d = F.greatest("density", F.lit(least))
    factor = F.col("beta") / F.greatest(d * F.sqrt(-2 * F.ln(d)), F.lit(least))
    rows = gradient(pairs, density_factor).join(density(pairs, density_factor), "i")
    return rows.select("i", *(F.least(F.greatest(-factor * F.col(f"g{c}"), F.lit(-most)), F.lit(most)).alias(f"g{c}") for c in "xyz"))


def crossings(samples: DataFrame, ray: str, t: str, value: str, levels: list[float]) -> DataFrame:
    """(ray, level, t): where the value first goes over each level, having started under it; linear between samples. One pass for all levels."""
    w = Window.partitionBy(ray).orderBy(t)
    rows = samples.withColumn("__v0", F.lag(value).over(w)).withColumn("__t0", F.lag(t).over(w)).withColumn("__first", F.first(value).over(w))
    each = rows.where(F.col("__v0").isNotNull()).withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels))))
    over = each.where((F.col(value) > F.col("level")) & (F.col("__first") < F.col("level")))
    found = over.groupBy(ray, "level").agg(F.min_by(F.struct(t, value, "__v0", "__t0"), t).alias("c"))
    share = (F.col("level") - F.col("c.__v0")) / (F.col(f"c.{value}") - F.col("c.__v0"))
    return found.select(ray, "level", (F.col("c.__t0") + share * (F.col(f"c.{t}") - F.col("c.__t0"))).alias(t))


def first_crossing(samples: DataFrame, ray: str, t: str, value: str, level: float) -> DataFrame:
    """(ray, t): where the value first goes over the level, having started under it; linear between samples."""
    return crossings(samples, ray, t, value, [level]).select(ray, t)


def deviation_towards(centre: list) -> Column:
    """A splat's deviation along the line from it to the camera's centre."""
    own = apply(transposed(quaternion_matrix([f"q{k}" for k in range(4)])), normalized(sub(centre, ["x", "y", "z"])))
    return norm([v * F.col(f"s{k}") for k, v in enumerate(own)])


def near_surface(splats: DataFrame, depths: DataFrame, centre: list, height: int, width: int, most: float = 3.0) -> DataFrame:
    """splats (id, place, u, v in pixels of the depth map, depth, columns of ``SPLAT``) that lie within ``most`` deviations of the mapped depth.

    depths: (row, col, map_depth) of the whole map, read between pixels; the deviation is that along the line to the camera.
    """
    mapped = bilinear(depths, splats.select("id", "u", "v"), "map_depth", height, width)
    return splats.join(mapped, "id").where(F.abs(F.col("map_depth") - F.col("depth")) < most * deviation_towards(centre))


def pixel_rays(pixels: DataFrame, splats: DataFrame, centre: list) -> DataFrame:
    """(i, owner, px py pz, ux uy uz, sd): the ray through each pixel's place, away from the camera's centre.

    pixels: i, the place px py pz that its depth says and the splat seen there (owner); splats: id and the columns of ``SPLAT``.
    sd is the owner's deviation along the line from it to the camera.
    """
    away = normalized(sub(["px", "py", "pz"], centre))
    spread = splats.select(F.col("id").alias("owner"), deviation_towards(centre).alias("sd"))
    return pixels.join(spread, "owner").select("i", "owner", "px", "py", "pz", *(v.alias(f"u{c}") for v, c in zip(away, "xyz", strict=True)), "sd")


def level_points(rays: DataFrame, near: DataFrame, level: float, half: float = 3.0, steps: int = 21) -> DataFrame:
    """(i, t, lx ly lz, nx ny nz): ``level_surfaces`` of one level."""
    return level_surfaces(rays, near, [level], half, steps).drop("level")


def level_surfaces(rays: DataFrame, near: DataFrame, levels: list[float], half: float = 3.0, steps: int = 21, by: str = "i") -> DataFrame:
    """(i, level, t, lx ly lz, nx ny nz): where rays first go over each density level, with the outward normal there.

    rays: (i, place px py pz, direction ux uy uz, deviation sd), sampled at ``steps`` places within ``half``
    deviations of the place; densities are computed once for all levels. near: (by, splat columns), the splats whose shares are summed along the
    rays; ``by`` is the rays' column that names them: the ray itself, or the splat that its neighbours are near to.
    A ray without a crossing gives no row; neither does one whose density has no slope there.
    """
    along = [(F.col(f"p{c}") + F.col("t") * F.col(f"u{c}")).alias(f"p{c}") for c in "xyz"]
    splat = [F.col(c) for c in SPLAT]
    places = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.col("sd") * half * (2 * k / (steps - 1) - 1))
    samples = near.join(rays, by).withColumn("t", F.explode(places)).select("i", "t", *along, *splat)
    raw = weights(samples).groupBy("i", "t").agg(F.sum("w").alias("raw"))
    held = raw.select("i", "t", F.when(F.col("raw") >= 1, F.col("raw") / (F.col("raw") + 1e-12)).otherwise(F.col("raw")).alias("density"))
    points = crossings(held, "i", "t", "density", levels).join(rays, "i").select("i", "level", "t", *along, *([by] if by != "i" else []))
    named = points.withColumn("__ray", F.col("i")).withColumn("i", F.struct("i", "level"))
    slope = gradient(near.join(named, by) if by != "i" else near.withColumnRenamed("i", "__ray").join(named, "__ray"))
    steep = F.sqrt(dot(["gx", "gy", "gz"], ["gx", "gy", "gz"]))
    out = named.join(slope, "i").withColumn("__steep", steep).where("__steep > 0")
    return out.select("i.i", "i.level", "t", *(F.col(f"p{c}").alias(f"l{c}") for c in "xyz"), *((-F.col(f"g{c}") / F.col("__steep")).alias(f"n{c}") for c in "xyz"))
