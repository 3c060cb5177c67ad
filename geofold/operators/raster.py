"""Pixel tables: tiles, ordered compositing, triangle rasters, maps and image metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofold.operators.shared import stash

TILE = 16
#: Splats that are blended at once.
SPLATS = 64
LEAST_ALPHA, MOST_ALPHA, LEAST_LIGHT = 1 / 255, 0.99, 1e-4


def tiles(splats: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """splats (u, v, radius, ...) repeated for each tile that their square touches, with ``tile``."""
    across, down = -(-width // tile), -(-height // tile)

    def bound(c: str, shift: int, most: int) -> Column:
        edge = F.floor((F.col(c) - F.col("radius")) / tile) if shift < 0 else F.floor((F.col(c) + F.col("radius") + tile - 1) / tile)
        return F.least(F.lit(most), F.greatest(F.lit(0), edge)).cast("int")

    box = splats.withColumn("x0", bound("u", -1, across)).withColumn("x1", bound("u", 1, across)).withColumn("y0", bound("v", -1, down)).withColumn("y1", bound("v", 1, down))
    seen = box.where("x1 > x0 AND y1 > y0")
    return seen.withColumn("ty", F.explode(F.sequence("y0", F.col("y1") - 1))).withColumn("tx", F.explode(F.sequence("x0", F.col("x1") - 1))).withColumn("tile", F.col("ty") * across + F.col("tx")).drop("x0", "x1", "y0", "y1", "tx", "ty")


def composited(fragments: DataFrame, pixel: list[str], order: list[str], features: list[str], alpha: str = "alpha", background: float = 0.0) -> DataFrame:
    """Front-to-back blending; a pixel stops before the fragment that would take its light below the least.

    Light before a fragment is the product of what the ones in front let through, as the exponential of summed logarithms.
    """
    w = Window.partitionBy(*pixel).orderBy(*order)
    through = F.coalesce(F.exp(F.sum(F.log1p(-F.col(alpha))).over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(1.0))
    lit = fragments.where(F.col(alpha) >= LEAST_ALPHA).withColumn("__t", through).withColumn("__after", F.col("__t") * (1 - F.col(alpha)))
    used = lit.where(F.col("__after") >= LEAST_LIGHT)
    sums = used.groupBy(*pixel).agg(*(F.sum(F.col(f) * F.col(alpha) * F.col("__t")).alias(f) for f in features), F.min("__after").alias("light"), F.count("*").alias("layers"))
    return sums.select(*pixel, *((F.col(f) + F.col("light") * background).alias(f) for f in features), "light", "layers")


def _blended(rows: pa.Table, light: np.ndarray, features: list[str], across: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tile's splats, nearest first, over all its pixels at once, until all are dark: (row, col) of its pixels, sums of features, least light, layers; and the light that all splats let through."""
    get = lambda c: rows[c].to_numpy()
    order = np.lexsort((get("id"), get("depth")))
    u, v, c0, c1, c2, opacity = (get(c)[order] for c in ("u", "v", "c0", "c1", "c2", "opacity"))
    values = np.array([get(f)[order] for f in features]).reshape(len(features), len(order))
    at = rows["tile"][0].as_py()
    row, col = (x.ravel() for x in np.mgrid[0:tile, 0:tile])
    row, col = row + at // across * tile, col + at % across * tile
    now, least, layers = light.copy(), np.ones(tile * tile), np.zeros(tile * tile, np.int64)
    sums = np.zeros((len(features), tile * tile))
    for a in range(0, len(u), SPLATS):
        k = slice(a, a + SPLATS)
        dx, dy = u[k, None] - col, v[k, None] - row
        power = -0.5 * (c0[k, None] * dx * dx + c2[k, None] * dy * dy) - c1[k, None] * dx * dy
        alpha = np.minimum(MOST_ALPHA, opacity[k, None] * np.exp(np.minimum(power, 0)))
        alpha = np.where((power <= 0) & (alpha >= LEAST_ALPHA), alpha, 0)
        after = np.cumprod(1 - alpha, axis=0) * now
        used = (alpha > 0) & (after >= LEAST_LIGHT)
        sums += values[:, k] @ np.where(used, alpha * np.concatenate([now[None], after[:-1]]), 0)
        least = np.minimum(least, np.where(used, after, 1).min(0))
        layers += used.sum(0)
        now = after[-1]
        if (now < LEAST_LIGHT).all():
            break
    return np.array([row, col]), sums, least, layers, now


def rendered(tiled: DataFrame, width: int, height: int, features: list[str], background: float = 0.0, tile: int = TILE) -> DataFrame:
    """(row, col, features, light, layers) of the pixels that some splat lights: the splats of each tile blended front to back.

    tiled: a row for each splat and tile it touches, with u, v, conic c0 .. c2, opacity, depth, id, tile and features.
    Rows are sorted by tile and depth in ranges. A range holds whole tiles, or a stretch of depths of a very full one; such stretches first
    say how much light they let through, and start with what those in front leave. A task holds one stretch of one tile; no row is written for a pixel and a splat.
    """
    across = -(-width // tile)
    columns = ["tile", "depth", "id", "u", "v", "c0", "c1", "c2", "opacity", *(f for f in features if f != "depth")]
    number = [F.col(c).cast("double" if c not in ("tile", "id") else "long").alias(c) for c in columns]
    parts = stash(tiled.select(*number).repartitionByRange("tile", "depth", "id").withColumn("part", F.spark_partition_id().cast("long")), "raster-parts")
    split = parts.select("tile", "part").distinct().groupBy("tile").agg(F.count("*").alias("n")).where("n > 1").select("tile")  # fewer than parts

    def passed(rows: pa.Table) -> pa.Table:
        light = _blended(rows, np.ones(tile * tile), [], across, tile)[-1]
        return pa.table({"tile": rows["tile"][:1], "part": rows["part"][:1], "light": pa.array([light.tobytes()], pa.binary())})

    def left(stretches: pa.Table) -> pa.Table:
        t = stretches.sort_by("part")
        light = np.cumprod([np.ones(tile * tile), *(np.frombuffer(x) for x in t["light"].to_pylist()[:-1])], axis=0)
        return t.set_column(2, "light", pa.array([x.tobytes() for x in light], pa.binary()))

    kinds = "tile long, part long, light binary"
    full = parts.join(F.broadcast(split), "tile", "left_semi")
    starts = full.toDF(*full.columns).groupBy("tile", "part").applyInArrow(passed, kinds).groupBy("tile").applyInArrow(left, kinds)

    def run(rows: pa.Table, start: pa.Table) -> pa.Table:
        light = np.frombuffer(start["light"][0].as_py()) if len(start) else np.ones(tile * tile)
        (row, col), sums, least, layers, _ = _blended(rows, light, features, across, tile)
        seen = (layers > 0) & (row < height) & (col < width)
        names = ["row", "col", *features, "light", "layers"]
        return pa.table([pa.array(x[seen]) for x in (row.astype(np.int32), col.astype(np.int32), *sums, least, layers)], names)

    schema = "row int, col int, " + "".join(f"{f} double, " for f in features) + "light double, layers long"
    lit = parts.groupBy("tile", "part").cogroup(starts.groupBy("tile", "part")).applyInArrow(run, schema)
    sums = lit.groupBy("row", "col").agg(*(F.sum(f).alias(f) for f in features), F.min("light").alias("light"), F.sum("layers").alias("layers"))
    return sums.select("row", "col", *((F.col(f) + F.col("light") * background).alias(f) for f in features), "light", "layers")


def triangle_pixels(faces: DataFrame, width: int, height: int) -> DataFrame:
    """(row, col, fid, z, b0, b1, b2) of the nearest face at each pixel centre. faces: fid and au, av, az ... of the corners in pixels."""
    us, vs = ["au", "bu", "cu"], ["av", "bv", "cv"]
    first = lambda cs, most: F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.least(*cs)))).cast("int")
    last = lambda cs, most: F.greatest(F.lit(0), F.least(F.lit(most), F.ceil(F.greatest(*cs)))).cast("int")
    seen = faces.where((F.greatest(*us) >= 0) & (F.least(*us) <= width) & (F.greatest(*vs) >= 0) & (F.least(*vs) <= height))
    rows = seen.withColumn("row", F.explode(F.sequence(first(vs, height - 1), last(vs, height - 1)))).withColumn("col", F.explode(F.sequence(first(us, width - 1), last(us, width - 1))))
    x, y = F.col("col") + 0.5, F.col("row") + 0.5

    def side(p: str, q: str) -> Column:
        return (F.col(q + "u") - F.col(p + "u")) * (y - F.col(p + "v")) - (F.col(q + "v") - F.col(p + "v")) * (x - F.col(p + "u"))

    rows = rows.withColumn("e0", side("b", "c")).withColumn("e1", side("c", "a")).withColumn("e2", side("a", "b")).withColumn("e", F.col("e0") + F.col("e1") + F.col("e2"))
    inside = (F.col("e") != 0) & (F.col("e0") * F.col("e") >= 0) & (F.col("e1") * F.col("e") >= 0) & (F.col("e2") * F.col("e") >= 0)
    hit = rows.where(inside).select("row", "col", "fid", *((F.col(f"e{k}") / F.col("e")).alias(f"b{k}") for k in range(3)), "az", "bz", "cz")
    deep = hit.withColumn("z", F.col("b0") * F.col("az") + F.col("b1") * F.col("bz") + F.col("b2") * F.col("cz"))
    return deep.groupBy("row", "col").agg(F.min(F.struct("z", "fid", "b0", "b1", "b2")).alias("h")).select("row", "col", "h.fid", "h.z", "h.b0", "h.b1", "h.b2")


def central_differences(grid: DataFrame, value: str, by: list[str]) -> DataFrame:
    """grid (row, col, value) with d_row and d_col: half of next minus previous, 0 at the border."""
    def half(order: str, other: str) -> Column:
        w = Window.partitionBy(*by, other).orderBy(order)
        return F.coalesce((F.lead(value).over(w) - F.lag(value).over(w)) / 2, F.lit(0.0))

    return grid.withColumn("d_col", half("col", "row")).withColumn("d_row", half("row", "col"))


def valid_depth(grid: DataFrame, by: list[str], height: int, width: int, max_depth, border: int = 2, most_gradient: float = 0.05, background: float = 0.98, normal: str | None = None, least_normal: float = 0.1) -> DataFrame:
    """grid (row, col, depth) with ``valid``.

    A pixel is valid if it and its four neighbours lie nearer than ``background * max_depth``, the larger of both central
    differences is under ``most_gradient`` of its depth, it is no part of the ``border`` outer rings, and the length
    in column ``normal``, if given, is over ``least_normal``. max_depth: a number or a Column.
    """
    across, down = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")
    depth = F.col("depth")
    sides = [[f("depth").over(w) for f in (F.lag, F.lead)] for w in (across, down)]
    near = F.lit(background) * max_depth
    whole = (depth < near) & reduce(lambda a, b: a & F.coalesce(b < near, F.lit(False)), (x for pair in sides for x in pair), F.lit(True))
    steep = F.greatest(*(F.abs(b - a) / 2 for a, b in sides))
    ring = max(border, 1)
    inside = F.col("row").between(ring, height - 1 - ring) & F.col("col").between(ring, width - 1 - ring)
    valid = whole & inside & (steep < most_gradient * F.abs(depth))
    if normal:
        valid = valid & (F.col(normal) > least_normal)
    return grid.withColumn("valid", F.coalesce(valid, F.lit(False)))


def laplacian_variance(grid: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sharpness: population variance of the five-point Laplacian over inner pixels."""
    across, down = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")
    lap = F.lag(value).over(across) + F.lead(value).over(across) + F.lag(value).over(down) + F.lead(value).over(down) - 4 * F.col(value)
    return grid.withColumn("__lap", lap).where(F.col("__lap").isNotNull()).groupBy(*by).agg(F.var_pop("__lap").alias("sharpness"))


def image_errors(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """L1, MSE and PSNR (peak 1) of two images as pixel tables."""
    d = F.col("__a") - F.col("__b")
    pairs = a.select(*key, F.col(value).alias("__a")).join(b.select(*key, F.col(value).alias("__b")), key)
    return pairs.agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("mse")).withColumn("psnr", -10 * F.log10("mse"))


def ssim(a: DataFrame, b: DataFrame, value: str, size: int = 11, sigma: float = 1.5) -> DataFrame:
    """Mean structural similarity of two (row, col, value) images: Gaussian windows, zeros outside; by sums over shifted pixels."""
    import math

    half = size // 2
    raw = [math.exp(-((i - half) ** 2) / (2 * sigma**2)) for i in range(size)]
    taps = [(i - half, x / sum(raw)) for i, x in enumerate(raw)]
    pairs = a.select("row", "col", F.col(value).alias("x")).join(b.select("row", "col", F.col(value).alias("y")), ["row", "col"])
    pairs = pairs.select("row", "col", "x", "y", (F.col("x") ** 2).alias("xx"), (F.col("y") ** 2).alias("yy"), (F.col("x") * F.col("y")).alias("xy"))
    names = ("x", "y", "xx", "yy", "xy")

    def blurred(df: DataFrame, along: str, across: str) -> DataFrame:
        shifts = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in taps))
        moved = df.withColumn("t", F.explode(shifts)).select(across, (F.col(along) + F.col("t.d")).alias(along), *((F.col(n) * F.col("t.w")).alias(n) for n in names))
        return moved.groupBy(across, along).agg(*(F.sum(n).alias(n) for n in names))

    m = blurred(blurred(pairs, "row", "col"), "col", "row").join(pairs.select("row", "col"), ["row", "col"], "left_semi")
    mx, my = F.col("x"), F.col("y")
    vx, vy, vxy = F.col("xx") - mx * mx, F.col("yy") - my * my, F.col("xy") - mx * my
    c1, c2 = 0.01**2, 0.03**2
    value_at = ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    return m.agg(F.avg(value_at).alias("ssim"))


def texture_average(hits: DataFrame, texel: list[str], camera: str, pixel: list[str], channels: list[str]) -> DataFrame:
    """Mean over cameras of one pixel for each camera and texel: that of the smallest pixel."""
    one = hits.groupBy(*texel, camera).agg(F.min(F.struct(*pixel, *channels)).alias("p"))
    return one.groupBy(*texel).agg(*(F.avg(f"p.{c}").alias(c) for c in channels), F.count("*").alias("n"))


def texture_filled(texels: DataFrame, hits: DataFrame, faces: DataFrame, texel: list[str], camera: str, pixel: list[str], channels: list[str], face: str = "fid") -> DataFrame:
    """texels (texel, face) with the mean of what cameras saw there; else the mean of what they saw of the face; else the face's own colour.

    hits: texel, face, camera, pixel and channels; faces: face and channels. A camera counts once for a texel and once for a face.
    """
    seen = texture_average(hits, texel, camera, pixel, channels).select(*texel, *(F.col(c).alias(f"__t{c}") for c in channels))
    of_face = texture_average(hits, [face], camera, pixel, channels).select(face, *(F.col(c).alias(f"__f{c}") for c in channels))
    own = faces.select(face, *(F.col(c).alias(f"__o{c}") for c in channels))
    joined = texels.join(seen, texel, "left").join(of_face, face, "left").join(own, face, "left")
    return joined.select(*texel, face, *(F.coalesce(f"__t{c}", f"__f{c}", f"__o{c}").alias(c) for c in channels))


def bilinear(grid: DataFrame, lookups: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """lookups (id, u, v in pixels) with the value between the four pixels around, the border repeated."""
    u, v = F.least(F.greatest(F.col("u"), F.lit(0.0)), F.lit(width - 1.0)), F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(height - 1.0))
    base = lookups.select("id", u.alias("u"), v.alias("v"))
    corners = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)))
    at = base.withColumn("k", F.explode(corners)).withColumn("fu", F.col("u") - F.floor("u")).withColumn("fv", F.col("v") - F.floor("v"))
    weight = F.when(F.col("k.c") == 1, F.col("fu")).otherwise(1 - F.col("fu")) * F.when(F.col("k.r") == 1, F.col("fv")).otherwise(1 - F.col("fv"))
    rows = at.select("id", weight.alias("w"), F.least(F.floor("v") + F.col("k.r"), F.lit(height - 1)).cast("int").alias("row"), F.least(F.floor("u") + F.col("k.c"), F.lit(width - 1)).cast("int").alias("col"))
    return rows.join(grid, ["row", "col"]).groupBy("id").agg(F.sum(F.col("w") * F.col(value)).alias(value))
