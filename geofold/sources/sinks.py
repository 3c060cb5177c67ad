"""Writers: Parquet is the form of record; these are for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.sources import records


def splat_fields(degree: int = 3) -> list[str]:
    rest = 3 * (degree + 1) ** 2 - 3
    return ["x", "y", "z", "nx", "ny", "nz", *(f"f_dc_{i}" for i in range(3)), *(f"f_rest_{i}" for i in range(rest)), "opacity", *(f"scale_{i}" for i in range(3)), *(f"rot_{i}" for i in range(4))]


def _written(rows: DataFrame, kind: str, path: str, **options: str) -> None:
    records.register(rows.sparkSession)
    rows.write.format(kind).options(**options).mode("overwrite").save(path)


def write_splats(splats: DataFrame, path: str, degree: int = 3) -> None:
    """One PLY file of splats in order of id; normals are 0. Splats with other numbers of coefficients than the degree's are refused."""
    zero = F.lit(0.0)
    values = F.concat(F.array("x", "y", "z", zero, zero, zero), "f_dc", "f_rest", F.array("opacity_logit"), "log_scale", "quat")
    names = splat_fields(degree)
    whole = F.when(F.size("values") == len(names), F.col("values")).otherwise(F.raise_error(F.lit(f"a splat hasn't {len(names)} numbers")))
    rows = splats.select("id", values.alias("values")).select("id", whole.alias("values")).orderBy("id")
    _written(rows.select(*(F.col("values")[i].cast("float").alias(f) for i, f in enumerate(names))), "ply", path)


def write_points(points: DataFrame, path: str) -> None:
    """One PLY file of id, x, y, z, nx, ny, nz and colours r, g, b in 0..1 (those there are), in order of id."""
    colours = {"r": "red", "g": "green", "b": "blue"}
    floats = [F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "nx", "ny", "nz") if c in points.columns]
    bytes_ = [F.least(F.greatest(F.round(F.col(c) * 255), F.lit(0)), F.lit(255)).cast("int").alias(n) for c, n in colours.items() if c in points.columns]
    _written(points.orderBy("id").select(*floats, *bytes_), "ply", path, types=",".join(f"{n}:uchar" for c, n in colours.items() if c in points.columns))


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One PLY file of vertices(vid, x, y, z) and faces(fid, a, b, c); ids must be dense from 0."""
    parts = [f"{path}.{element}" for element in ("vertex", "face")]
    _written(vertices.orderBy("vid").select(*(F.col(c).cast("double").alias(c) for c in "xyz")), "ply", parts[0])
    _written(faces.orderBy("fid").select(F.array("a", "b", "c").cast("array<int>").alias("vertex_indices")), "ply", parts[1], element="face")
    records.join_ply(path, parts)
    for p in parts:
        store, at = records.store(p)
        store.delete_file(at)


def write_sparse_points(points: DataFrame, path: str) -> None:
    """A binary points file: point_id, x, y, z, r, g, b, error and track, in order of point_id."""
    _written(points.orderBy("point_id").select("point_id", *"xyz", *"rgb", "error", F.coalesce("track", F.array()).cast("array<struct<image_id:int,point_index:int>>").alias("track")), "sparse_points", path)


def write_dense_array(cells: DataFrame, path: str, width: int, height: int, channels: int = 1) -> None:
    """A "w&h&c&" array of (row, col, channel, value), one row for each cell."""
    _written(cells.orderBy("channel", "row", "col").select("row", "col", "channel", F.col("value").cast("float").alias("value")), "dense_array", path, width=str(width), height=str(height), channels=str(channels))


def write_cameras(cameras: DataFrame, path: str) -> None:
    """A binary intrinsics file of (camera_id, model, width, height, params), in order of camera_id."""
    _written(cameras.orderBy("camera_id").select("camera_id", "model", "width", "height", "params"), "cameras", path)


def write_images(images: DataFrame, path: str) -> None:
    """A binary extrinsics file of (image_id, qvec, tvec, camera_id, name, xys, point3d_ids), in order of image_id."""
    _written(images.orderBy("image_id").select("image_id", "qvec", "tvec", "camera_id", "name", "xys", "point3d_ids"), "images", path)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """A Wavefront text folder: vertices in order of vid, then faces with indices from 1; ids must be dense from 0."""
    v = vertices.select(F.lit(0).alias("k"), F.col("vid").alias("n"), F.concat_ws(" ", F.lit("v"), *(F.col(c).cast("string") for c in "xyz")).alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("fid").alias("n"), F.concat_ws(" ", F.lit("f"), *((F.col(c) + 1).cast("string") for c in "abc")).alias("value"))
    v.unionByName(f).orderBy("k", "n").select("value").write.text(path)


def markdown_lines(table: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a Markdown table, header first; null as NA."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in table.columns)), F.lit(" |"))
    head = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    lead = table.sparkSession.createDataFrame([(i - 2, h) for i, h in enumerate(head)], "k long, value string")
    from geofold.operators.ordering import numbered

    body = numbered(table, order, "k").select("k", cells.alias("value"))
    return lead.unionByName(body).orderBy("k").select("value")
