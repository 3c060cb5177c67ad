"""Values of the regularisers: what a term comes to on given columns. There are no gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofold.functions.geom import col, cross, dot, norm, sub
from geofold.operators import field
from geofold.operators.mesh import dihedral_angles, smoothed

TINY = 1e-10


def entropy(opacity) -> Column:
    """Of an opacity; smallest at 0 and 1."""
    o = col(opacity)
    return -o * F.ln(o + TINY) - (1 - o) * F.ln(1 - o + TINY)


def distance_misfit(sdf, estimate, deviation, most, squared: bool = False) -> Column:
    """Signed distance against the size of its estimate, in deviations, at most ``most``."""
    off = (col(sdf) - F.abs(col(estimate))) / col(deviation)
    return F.least(off * off if squared else F.abs(off), col(most))


def density_misfit(density, beta, estimate, squared: bool = False) -> Column:
    """Density against that of a flat surface at the estimated distance."""
    off = col(density) - F.exp(-0.5 * (col(estimate) / col(beta)) ** 2)
    return off * off if squared else F.abs(off)


def surface_misfit(estimate, deviation, most, squared: bool = False) -> Column:
    """How far a sample is from the surface, in deviations, at most ``most``."""
    off = F.abs(col(estimate)) / col(deviation)
    return F.least(off * off if squared else off, col(most))


def normal_consistency(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pairs, loss): mean of 1 - cosine between normals over edges of exactly two faces; faces keep their orientation."""
    return dihedral_angles(faces, vertices).agg(F.count("*").alias("pairs"), F.avg(1 - F.cos(F.radians("raw"))).alias("loss"))


def laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(loss): mean distance from vertices to the mean of their neighbours; a vertex without any counts as 0."""
    moved = smoothed(vertices, faces, 1.0).select("vid", *(F.col(c).alias(f"m{c}") for c in "xyz"))
    off = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return vertices.join(moved, "vid").agg(F.avg(F.sqrt(off)).alias("loss"))


def depth_normals(pixels: DataFrame, height: int, width: int, focal: tuple[float, float], centre: tuple[float, float], by: tuple[str, ...] = ()) -> DataFrame:
    """pixels (row, col, depth) of whole images with dnx, dny, dnz: the normal that depth implies, from the places two rows and two columns apart; 0 in the outer ring."""
    place = [(F.col("col") - centre[0]) / focal[0] * F.col("depth"), (F.col("row") - centre[1]) / focal[1] * F.col("depth"), F.col("depth")]
    rows = pixels.withColumns({f"__p{c}": p for c, p in zip("xyz", place, strict=True)})
    down, across = Window.partitionBy(*by, "col").orderBy("row"), Window.partitionBy(*by, "row").orderBy("col")
    step = lambda w: [F.lead(f"__p{c}").over(w) - F.lag(f"__p{c}").over(w) for c in "xyz"]
    rows = rows.withColumns({f"__{k}{c}": x for k, w in (("d", down), ("a", across)) for c, x in zip("xyz", step(w), strict=True)})
    n = cross([f"__d{c}" for c in "xyz"], [f"__a{c}" for c in "xyz"])
    inside = F.col("row").between(1, height - 2) & F.col("col").between(1, width - 2)
    size = F.greatest(norm(n), F.lit(1e-12))
    keep = pixels.columns
    return rows.select(*keep, *(F.when(inside, x / size).otherwise(0.0).alias(f"dn{c}") for x, c in zip(n, "xyz", strict=True)))


def depth_normal_consistency(pixels: DataFrame) -> DataFrame:
    """(loss): mean of 1 - cosine between a pixel's normal (nx, ny, nz) and the one that depth implies (dnx, dny, dnz)."""
    return pixels.agg(F.avg(1 - dot(["nx", "ny", "nz"], ["dnx", "dny", "dnz"])).alias("loss"))


def better_normal(pairs: DataFrame, density_factor: float = 1.0) -> DataFrame:
    """(i, loss): squared difference of a splat's normal and the mean normal of the field around a sample in it.

    pairs: as for ``field.overlap``, with the sample px py pz, the splat's own quaternion p0..p3 and scales o0..o2. Normals near are turned to the
    own one's side; each weighs by its share, its distance along the normal and the inverse square of its least scale.
    """
    own, near = field.splat_normal([f"p{k}" for k in range(4)], ["o0", "o1", "o2"]), field.splat_normal([f"q{k}" for k in range(4)], ["s0", "s1", "s2"])
    rows = field.weights(pairs, density_factor).withColumns({f"__o{c}": x for c, x in zip("xyz", own, strict=True)} | {f"__n{c}": x for c, x in zip("xyz", near, strict=True)})
    along = F.abs(dot(sub(["px", "py", "pz"], ["x", "y", "z"]), ["__nx", "__ny", "__nz"]))
    rows = rows.withColumn("__side", F.signum(dot(["__ox", "__oy", "__oz"], ["__nx", "__ny", "__nz"]))).withColumn("__w", F.col("w") * along / F.greatest(F.least("s0", "s1", "s2"), F.lit(1e-6)) ** 2)
    sums = rows.groupBy("i").agg(F.greatest(F.sum("__w"), F.lit(1e-6)).alias("w"), *(F.first(f"__o{c}").alias(f"o{c}") for c in "xyz"), *(F.sum(F.col("__w") * F.col("__side") * F.col(f"__n{c}")).alias(f"m{c}") for c in "xyz"))
    off = [F.col(f"o{c}") - F.col(f"m{c}") / F.col("w") for c in "xyz"]
    return sums.select("i", dot(off, off).alias("loss"))
