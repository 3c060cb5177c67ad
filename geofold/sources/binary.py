"""Binary files of reconstructions as tables, read by ranges of bytes (``records``); image heads by Spark's reader of whole files, a row each."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Camera models by number, with how many parameters each has.
CAMERA_MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}
#: Scalar types of PLY headers.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def _opened(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    from geofold.sources import records

    records.register(spark)
    records.files(path)  # raises where there is none
    return spark.read.format(kind).options(**options).load(path)


def sparse_points(spark: SparkSession, path: str) -> DataFrame:
    """point_id, place, colour, error and track length of each point."""
    return _opened(spark, "sparse_points", path).select("point_id", *"xyz", *"rgb", "error", F.size("track").cast("long").alias("track_length"))


def intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """camera_id, model, width, height and parameters."""
    return _opened(spark, "cameras", path)


def extrinsics(spark: SparkSession, path: str) -> DataFrame:
    """image_id, qvec, tvec, camera_id, name and the image's points."""
    return _opened(spark, "images", path)


def dense_array(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, channel, value) of "w&h&c&" arrays, stored column after column."""
    return _opened(spark, "dense_array", path)


def mesh_vertices(spark: SparkSession, path: str) -> DataFrame:
    return _opened(spark, "ply", path).select(F.col("n").alias("vid"), *(F.col(c).cast("double").alias(c) for c in "xyz"))


def mesh_faces(spark: SparkSession, path: str) -> DataFrame:
    rows = _opened(spark, "ply", path, element="face")
    corners = next(f.name for f in rows.schema if f.dataType.typeName() == "array")
    return rows.select(F.col("n").alias("fid"), *(F.col(corners)[i].alias(c) for i, c in enumerate("abc")))


def point_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Place, normal (0 if none) and colour in 0..1."""
    rows = _opened(spark, "ply", path)
    get = lambda c, k=1.0: F.col(c) / k if c in rows.columns else F.lit(0.0)
    return rows.select(F.col("n").alias("id"), *(get(c).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")), *(get(c, 255.0).alias(s) for s, c in (("r", "red"), ("g", "green"), ("b", "blue"))))


def splat_cloud(spark: SparkSession, path: str, degree: int | None = 3) -> DataFrame:
    """Splats; numbered columns are found by prefix and ordered by number. Checks the number of colour coefficients."""
    rows = _opened(spark, "ply", path)
    group = lambda p: sorted((c for c in rows.columns if c.startswith(p)), key=lambda c: int(c.rsplit("_", 1)[1]))
    rest = group("f_rest_")
    if degree is not None and len(rest) != 3 * (degree + 1) ** 2 - 3:
        raise ValueError(f"{len(rest)} coefficients don't fit degree {degree}")
    array = lambda names: F.array(*names).cast("array<double>")
    return rows.select(F.col("n").alias("id"), *"xyz", array(group("f_dc_")).alias("f_dc"), array(rest).alias("f_rest"), F.col("opacity").alias("opacity_logit"), array(group("scale_")).alias("log_scale"), array(group("rot")).alias("quat"))


def image_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, width and height of PNG, GIF, BMP and JPEG files from their first bytes; null kind for others."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [_image_size(c) for c in part["content"]]
            yield pd.DataFrame({"path": part["path"], "kind": [f[0] for f in found], "width": pd.array([f[1] for f in found], "Int64"), "height": pd.array([f[2] for f in found], "Int64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, kind string, width long, height long")


def _image_size(data: bytes) -> tuple:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("PNG", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("GIF", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return ("BMP", w, abs(h))
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return ("JPEG", w, h)
        at += 2 + size
    return (None, None, None)
