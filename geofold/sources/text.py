"""Text files as tables: reconstructions, cameras, logs, settings and metric documents. Spark's readers only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofold.sources import binary


def _words(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return lines.select(F.split(F.trim("value"), r"\s+").alias("w"))


def sparse_points(spark: SparkSession, path: str) -> DataFrame:
    number = lambda i, kind="double": F.col("w")[i].cast(kind)
    return _words(spark, path).select(
        number(0, "long").alias("point_id"), *(number(1 + i).alias(c) for i, c in enumerate("xyz")), *(number(4 + i, "int").alias(c) for i, c in enumerate("rgb")),
        number(7).alias("error"), F.floor((F.size("w") - 8) / 2).cast("long").alias("track_length"),
    )


def intrinsics(spark: SparkSession, path: str) -> DataFrame:
    return _words(spark, path).select(F.col("w")[0].cast("int").alias("camera_id"), F.col("w")[1].alias("model"), F.col("w")[2].cast("long").alias("width"), F.col("w")[3].cast("long").alias("height"), F.slice("w", 5, F.greatest(F.size("w") - 4, F.lit(0))).cast("array<double>").alias("params"))


def extrinsics(spark: SparkSession, path: str) -> DataFrame:
    """Two lines for each image: the pose, then its points. A file is one partition's lines in order."""
    rows = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: ~F.startswith(x, F.lit("#"))).alias("lines"))
    heads = rows.select(F.posexplode("lines").alias("p", "head"), "lines").where("p % 2 = 0 AND trim(head) != ''").select(F.split(F.trim("head"), r"\s+").alias("w"), F.split(F.trim(F.coalesce(F.get("lines", F.col("p") + 1), F.lit(""))), r"\s+").alias("pts"))
    n = F.floor(F.size("pts") / 3).cast("int")
    at = lambda i, k: F.get("pts", 3 * i + k).try_cast("double")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return heads.select(
        F.col("w")[0].cast("int").alias("image_id"), F.slice("w", 2, 4).cast("array<double>").alias("qvec"), F.slice("w", 6, 3).cast("array<double>").alias("tvec"), F.col("w")[8].cast("int").alias("camera_id"), F.col("w")[9].alias("name"),
        F.transform(index, lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"))).alias("xys"), F.transform(index, lambda i: at(i, 2).cast("long")).alias("point3d_ids"),
    )


def with_fallback(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A reconstruction's table ("points3D", "cameras" or "images"): the binary file if it is there, else the text file."""
    readers = {"points3D": "sparse_points", "cameras": "intrinsics", "images": "extrinsics"}[name]
    try:
        return getattr(binary, readers)(spark, f"{folder}/{name}.bin")
    except (AnalysisException, FileNotFoundError):
        return globals()[readers](spark, f"{folder}/{name}.txt")


def scene_kind(spark: SparkSession, folder: str) -> str:
    """"sparse" or "frames", by what the folder holds."""
    jvm = spark._jvm
    fs = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    there = lambda p: fs(p).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs(p))
    if there(f"{folder}/sparse"):
        return "sparse"
    if there(f"{folder}/transforms_train.json"):
        return "frames"
    raise ValueError(f"no known scene in {folder}")


def posed_cameras(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Images with their camera's field of view; pinhole models only. Cameras are few beside images but not bounded: the join chooses."""
    from geofold.functions.geom import focal_to_fov

    pinhole = cameras.where(F.col("model").isin("PINHOLE", "SIMPLE_PINHOLE"))
    fy = F.when(F.col("model") == "PINHOLE", F.col("params")[1]).otherwise(F.col("params")[0])
    joined = images.join(pinhole, "camera_id")
    return joined.select("image_id", "name", "qvec", "tvec", "width", "height", focal_to_fov(F.col("params")[0], "width").alias("fov_x"), focal_to_fov(fy, "height").alias("fov_y"))


def camera_list(spark: SparkSession, path: str, removed: tuple[int, ...] = ()) -> DataFrame:
    """Cameras of a JSON list without those at the removed places; of equal names the last stays; sorted by name."""
    schema = "array<struct<id:int,img_name:string,width:int,height:int,position:array<double>,rotation:array<array<double>>,fx:double,fy:double>>"
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("at", "c"))
    kept = items.where(~F.col("at").isin(*removed)) if removed else items
    return kept.groupBy(F.col("c.img_name").alias("k")).agg(F.max_by("c", "at").alias("c")).select("c.*").orderBy("img_name")


def frame_transforms(spark: SparkSession, path: str) -> DataFrame:
    """(frame, file_path, fov_x, m): world-to-camera source matrices with the y and z axes turned."""
    doc = spark.read.schema("camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>").json(path, multiLine=True)
    turned = F.transform("f.transform_matrix", lambda r: F.transform(r, lambda v, i: F.when((i == 1) | (i == 2), -v).otherwise(v)))
    return doc.select("camera_angle_x", F.posexplode("frames").alias("frame", "f")).select("frame", F.col("f.file_path").alias("file_path"), F.col("camera_angle_x").alias("fov_x"), turned.alias("m"))


def scene_package(spark: SparkSession, path: str) -> DataFrame:
    """(mesh, vid, group, w): vertex-group weights above 0, normalised for each vertex."""
    schema = "meshes array<struct<name:string,groups:array<array<int>>,weights:array<array<double>>>>"
    m = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("meshes").alias("m"))
    v = m.select(F.col("m.name").alias("mesh"), F.posexplode(F.arrays_zip(F.col("m.groups").alias("groups"), F.col("m.weights").alias("weights"))).alias("vid", "z"))
    pairs = v.select("mesh", "vid", F.explode(F.arrays_zip(F.col("z.groups").alias("g"), F.col("z.weights").alias("w"))).alias("p")).select("mesh", "vid", F.col("p.g").alias("group"), F.col("p.w").alias("w")).where("w > 0")
    return pairs.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("mesh", "vid")))


def metric_documents(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """JSON metric files with kind and run taken from their names, as in render_<run>.json."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    docs = (reader.schema(schema) if schema else reader).json(pattern)
    name = F.col("_metadata.file_name")
    return docs.select(F.regexp_extract(name, r"^(render|geometry|meshvis|provenance)_", 1).alias("kind"), F.regexp_extract(name, r"^(?:render|geometry|meshvis|provenance)_(.*)\.json$", 1).alias("run"), F.col("_metadata.file_path").alias("path"), *docs.columns)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, iteration, total, loss, minutes) of lines like "loss: 0.12 [ 50/7000] computed in 0.4 minutes."."""
    number = r"([0-9.eE+-]+)"
    got = lambda p, i=1: F.nullif(F.regexp_extract("value", p, i), F.lit(""))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.select("path", got(r"\[\s*(\d+)/(\d+)\]", 1).try_cast("long").alias("iteration"), got(r"\[\s*(\d+)/(\d+)\]", 2).try_cast("long").alias("total"), got(rf"loss:\s*{number}").try_cast("double").alias("loss"), got(rf"computed in {number} minutes").try_cast("double").alias("minutes")).where("loss IS NOT NULL OR minutes IS NOT NULL")


def csv_rows(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV with a header; what isn't a number in the named columns is NaN, other columns stay text."""
    rows = spark.read.csv(path, header=True)
    return rows.select(*(F.coalesce(F.col(c).try_cast("double"), F.lit(float("nan"))).alias(c) if c in numbers else F.col(c) for c in rows.columns))


def grid_settings(spark: SparkSession, path: str) -> DataFrame:
    """(tag, gpu, checkpoint, extra) of "TAG|GPU|PATH|EXTRA" lines; comments and blank lines are skipped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    part = lambda i: F.trim(F.coalesce(F.get(F.split("value", r"\|"), F.lit(i)), F.lit("")))
    return lines.select(part(0).alias("tag"), part(1).alias("gpu"), part(2).alias("checkpoint"), part(3).alias("extra"))


def patch_counts(spark: SparkSession, path: str) -> DataFrame:
    """(patch, file, added, removed) of unified diffs; a patch's lines are taken in order."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("patch"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    file = F.last(F.nullif(F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1), F.lit("")), ignorenulls=True).over(Window.partitionBy("patch").orderBy("n"))
    rows = docs.withColumn("file", file).where("file IS NOT NULL")
    plus = F.startswith("line", F.lit("+")) & ~F.startswith("line", F.lit("+++"))
    minus = F.startswith("line", F.lit("-")) & ~F.startswith("line", F.lit("---"))
    return rows.groupBy("patch", "file").agg(F.sum(plus.cast("long")).alias("added"), F.sum(minus.cast("long")).alias("removed"))


def latest_iteration(names: DataFrame, column: str = "name") -> DataFrame:
    """The greatest number behind the last underscore."""
    return names.agg(F.max(F.regexp_extract(column, r"_(\d+)$", 1).try_cast("int")).alias("iteration"))
