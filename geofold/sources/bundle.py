"""Bundle files: cameras and points with the views that see them, in one text of records of five and of three lines.

A file is read by ranges, as any text. Lines are numbered through all ranges (rows of a range apart, then shifted by the lines before it); a line's
number and the two counts in the head say which record it belongs to, so records meet by a grouping and no task reads the file from its start.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.operators.ordering import numbered

#: Lines of the head, of a camera and of a point.
HEAD, CAMERA, POINT = 2, 5, 3


@dataclass
class Bundle:
    """header: the first line; points_stated: how many points the head says there are (files may hold fewer).

    cameras: camera, focal, k1, k2, rotation (nine numbers, row by row), translation. points: point, x, y, z, r, g, b and views (camera, key, x, y).
    """

    header: str
    points_stated: int
    cameras: DataFrame
    points: DataFrame


def _numbers(line: str, kind: str = "double") -> Column:
    return F.split(F.trim(line), r"\s+").cast(f"array<{kind}>")


def read(spark: SparkSession, path: str) -> Bundle:
    """A bundle file, or a folder of its parts in the order of their names. A last point without all of its lines is left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = numbered(lines, ["file", "block", "at"], "n").select("n", "value")
    head = {r["n"]: r["value"].strip() for r in lines.where(F.col("n") < HEAD).collect()}
    cameras, stated = map(int, head[1].split())
    first_point = HEAD + CAMERA * cameras

    def records(first: int, size: int, own: Column, name: str) -> DataFrame:
        place = F.col("n") - first
        rows = lines.where(own).select(F.floor(place / size).alias(name), (place % size).alias("k"), "value")
        return rows.groupBy(name).agg(*(F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"l{k}") for k in range(size)))

    cams = records(HEAD, CAMERA, F.col("n").between(HEAD, first_point - 1), "camera")
    lens = _numbers("l0")
    cams = cams.select("camera", *(lens[i].alias(c) for i, c in enumerate(("focal", "k1", "k2"))), F.concat(*(_numbers(f"l{k}") for k in (1, 2, 3))).alias("rotation"), _numbers("l4").alias("translation"))
    pts = records(first_point, POINT, F.col("n") >= first_point, "point").where("l2 IS NOT NULL")
    token = F.split(F.trim("l2"), r"\s+")
    at = lambda i, k: F.get(token, 4 * i + k + 1)
    count = token[0].cast("int")
    view = lambda i: F.struct(at(i, 0).cast("long").alias("camera"), at(i, 1).cast("long").alias("key"), at(i, 2).cast("double").alias("x"), at(i, 3).cast("double").alias("y"))
    views = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), view)
    place, colour = _numbers("l0"), _numbers("l1", "int")
    pts = pts.select("point", *(place[i].alias(c) for i, c in enumerate("xyz")), *(colour[i].alias(c) for i, c in enumerate("rgb")), views.alias("views"))
    return Bundle(head[0], stated, cams, pts)


def scaled(bundle: Bundle, factor: float) -> Bundle:
    """All focal lengths times factor."""
    return Bundle(bundle.header, bundle.points_stated, bundle.cameras.withColumn("focal", F.col("focal") * factor), bundle.points)


def excluded(bundle: Bundle, removed: list[int]) -> Bundle:
    """Without some cameras and the views from them; the cameras behind them move up. A point that no camera sees any more stays, without views."""
    gone = F.array(*(F.lit(int(c)).cast("long") for c in sorted(set(removed)))).cast("array<long>")
    moved = lambda c: c - F.size(F.filter(gone, lambda g: g < c))
    cameras = bundle.cameras.where(~F.array_contains(gone, F.col("camera"))).withColumn("camera", moved(F.col("camera")))
    kept = F.filter("views", lambda v: ~F.array_contains(gone, v["camera"]))
    return Bundle(bundle.header, bundle.points_stated, cameras, bundle.points.withColumn("views", F.transform(kept, lambda v: v.withField("camera", moved(v["camera"])))))


def _written(parts):
    """Numbers as a bundle file has them: up to six digits, without trailing zeros."""
    for p in parts:
        yield pd.DataFrame({"k": p["k"], "n": p["n"], "value": ["\n".join(" ".join(f"{x:g}" for x in line) for line in lines) for lines in p["lines"]]})


def save(bundle: Bundle, path: str) -> None:
    """A folder of text parts, in order. Points without views aren't written; the head keeps the number it stated."""
    spark = bundle.cameras.sparkSession
    floats = lambda *c: F.array(*c).cast("array<double>")
    cams = bundle.cameras.select(F.lit(1).alias("k"), F.col("camera").alias("n"), F.array(floats("focal", "k1", "k2"), *(F.slice("rotation", 3 * r + 1, 3) for r in range(3)), F.col("translation")).alias("lines"))
    views = F.concat(floats(F.size("views")), F.flatten(F.transform("views", lambda v: floats(v["camera"], v["key"], v["x"], v["y"]))))
    points = bundle.points.where(F.size("views") > 0).select(F.lit(2).alias("k"), F.col("point").alias("n"), F.array(floats(*"xyz"), floats(*"rgb"), views).alias("lines"))
    body = cams.unionByName(points).mapInPandas(_written, "k int, n long, value string")
    head = spark.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"), F.lit(f"{bundle.header}\n{bundle.cameras.count()} {bundle.points_stated}").alias("value"))
    head.unionByName(body).orderBy("k", "n").select("value").write.text(path)
