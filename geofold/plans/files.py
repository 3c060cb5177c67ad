"""Files written from the test tables and read again by ranges of bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofold.functions.geom import r6
from geofold.operators import checkpoints
from geofold.operators.shared import shared_dir
from geofold.plans.book import Book, q6
from geofold.plans.fixtures import FACES, IMAGE, SPLATS, faces, image, splats, table, vertices
from geofold.sources import binary, bundle, records, sinks

BOOK = Book()
#: Bytes and records of a reading task: little, so that the small tables' files are cut.
LITTLE = {"bytes_per_task": "16384", "rows_per_task": "100"}


def _path(spark: SparkSession, name: str) -> str:
    """A new file in the shared folder."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    own, at = records.store(folder)
    own.create_dir(at, recursive=True)
    return f"{folder}/{name}"


def _read(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    records.register(spark)
    return spark.read.format(kind).options(**LITTLE, **options).load(path)


@BOOK.query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 5) + 0.0 AS {c}" for i, c in ((0, "x"), (1, "y"), (2, "z"), (6, "f_dc_0"), (53, "f_rest_44"), (54, "opacity"), (57, "scale_2"), (61, "rot_3"))) + ", 0.0::DOUBLE AS nx FROM embeddings")
def splat_file(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as a splat file, then its vertices."""
    e = lambda a, z: F.slice(F.col("embedding").cast("array<double>"), a + 1, z - a)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")), e(6, 9).alias("f_dc"), e(9, 54).alias("f_rest"), F.col("embedding")[54].cast("double").alias("opacity_logit"), e(55, 58).alias("log_scale"), e(58, 62).alias("quat"))
    path = _path(spark, "splats.ply")
    sinks.write_splats(rows, path)
    return _read(spark, "ply", path).select("n", *(r6(c, 5).alias(c) for c in ("x", "y", "z", "f_dc_0", "f_rest_44", "opacity", "scale_2", "rot_3", "nx")))


@BOOK.query(f"WITH {SPLATS} SELECT row_number() OVER (ORDER BY id) - 1 AS id, {q6('x', 'x')}, {q6('nz', 'nz')}, round(least(255, greatest(0, round(opacity * 255))) / 255, 6) AS r FROM splats")
def point_file(spark: SparkSession, d: str) -> DataFrame:
    """Splats' places, normals and opacities (as red) as a point cloud file."""
    path = _path(spark, "points.ply")
    sinks.write_points(splats(spark, d).select("id", *"xyz", "nx", "ny", "nz", F.col("opacity").alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b")), path)
    return binary.point_cloud(spark, path).select("id", r6("x").alias("x"), r6("nz").alias("nz"), r6("r").alias("r"))


@BOOK.query(f"WITH {FACES}, {SPLATS} SELECT fid, a, b, c, {q6('p.x', 'ax')}, {q6('r.z', 'cz')} FROM faces JOIN splats p ON p.id = a JOIN splats r ON r.id = c")
def mesh_file(spark: SparkSession, d: str) -> DataFrame:
    """The mesh as one file of vertices and faces; its faces with what its vertices say of their corners."""
    path = _path(spark, "mesh.ply")
    sinks.write_mesh(vertices(spark, d), faces(spark, d), path)
    f = _read(spark, "ply", path, element="face").select(F.col("n").alias("fid"), *(F.col("vertex_indices")[i].alias(c) for i, c in enumerate("abc")))
    v = _read(spark, "ply", path).withColumnRenamed("n", "vid")
    ends = [v.select(F.col("vid").alias(k), F.col(c).alias(f"{k}{c}")) for k, c in (("a", "x"), ("c", "z"))]
    return f.join(ends[0], "a").join(ends[1], "c").select("fid", "a", "b", "c", r6("ax").alias("ax"), r6("cz").alias("cz"))


_TRACKED = "points AS (SELECT user_id AS point_id, list({'image': event_id % 1000, 'point': row_number} ORDER BY event_id) AS track, avg(value) AS error FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row_number FROM events) GROUP BY user_id)"


@BOOK.query(f"WITH {_TRACKED} SELECT point_id, point_id / 7.0 AS x, CAST(point_id % 256 AS INTEGER) AS r, {q6('error', 'error')}, len(track) AS track_length, CAST(list_sum(list_transform(track, lambda t: t.image * t.point)) AS BIGINT) AS marks FROM points".replace("point_id / 7.0 AS x", "round(point_id / 7.0::DOUBLE, 6) AS x"))
def sparse_file(spark: SparkSession, d: str) -> DataFrame:
    """Users as points, their events as tracks of very different lengths."""
    own = table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    track = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "k"))), lambda t: F.struct((t["event_id"] % 1000).cast("int").alias("image_id"), t["k"].alias("point_index")))
    points = own.groupBy(F.col("user_id").alias("point_id")).agg(track.alias("track"), F.avg("value").alias("error"))
    shades = [(F.col("point_id") % 256).cast("int").alias(c) for c in "rgb"]
    path = _path(spark, "points3D.bin")
    sinks.write_sparse_points(points.select("point_id", *((F.col("point_id") / 7.0).alias(c) for c in "xyz"), *shades, "error", "track"), path)
    marks = F.aggregate("track", F.lit(0).cast("long"), lambda s, t: s + t["image_id"].cast("long") * t["point_index"])
    return _read(spark, "sparse_points", path).select("point_id", r6("x").alias("x"), "r", r6("error").alias("error"), F.size("track").cast("long").alias("track_length"), marks.alias("marks"))


@BOOK.query(f"WITH {IMAGE}, n AS (SELECT img, row_number() OVER (ORDER BY img) - 1 AS k FROM (SELECT DISTINCT img FROM image)) SELECT CAST(8 * k + row AS INTEGER) AS row, col, 0 AS channel, {q6('value', 'value')} FROM image JOIN n USING (img)")
def dense_file(spark: SparkSession, d: str) -> DataFrame:
    """All grey images below one another as one array."""
    from geofold.operators.ordering import numbered

    pixels = image(spark, d)
    place = numbered(pixels.select("img").distinct(), ["img"], "k")
    cells = pixels.join(place, "img").select((8 * F.col("k") + F.col("row")).cast("int").alias("row"), "col", F.lit(0).alias("channel"), "value")
    path = _path(spark, "depth.bin")
    sinks.write_dense_array(cells, path, 8, cells.count() // 8)
    return _read(spark, "dense_array", path).select("row", "col", "channel", r6("value").alias("value"))


@BOOK.query(
    f"WITH c AS (SELECT n_nationkey AS camera_id, CASE WHEN n_regionkey = 0 THEN 'SIMPLE_PINHOLE' ELSE 'PINHOLE' END AS model, 500.0::DOUBLE + n_nationkey AS f FROM nation) SELECT c_custkey AS image_id, c_name AS name, model, f, {q6('c_acctbal', 'tx')}, CAST(c_custkey % 3 AS INTEGER) AS points FROM customer JOIN c ON c_nationkey = camera_id"
)
def camera_files(spark: SparkSession, d: str) -> DataFrame:
    """Nations as cameras, customers as images, each as a file; images with their cameras."""
    simple = F.col("n_regionkey") == 0
    f = 500.0 + F.col("n_nationkey")
    cams = table(spark, d, "nation").select(F.col("n_nationkey").alias("camera_id"), F.when(simple, "SIMPLE_PINHOLE").otherwise("PINHOLE").alias("model"), F.lit(640).cast("long").alias("width"), F.lit(480).cast("long").alias("height"), F.when(simple, F.array(f, F.lit(320.0), F.lit(240.0))).otherwise(F.array(f, f, F.lit(320.0), F.lit(240.0))).alias("params"))
    n = (F.col("c_custkey") % 3).cast("int")
    each = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    images = table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("image_id"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))).alias("qvec"), F.array(F.col("c_acctbal"), F.lit(0.0), F.lit(1.0)).alias("tvec"), F.col("c_nationkey").alias("camera_id"), F.col("c_name").alias("name"), F.transform(each, lambda i: F.struct(i.cast("double").alias("x"), (i * 2).cast("double").alias("y"))).alias("xys"), F.transform(each, lambda i: i.cast("long")).alias("point3d_ids"))
    paths = [_path(spark, "cameras.bin"), _path(spark, "images.bin")]
    sinks.write_cameras(cams, paths[0])
    sinks.write_images(images, paths[1])
    back = binary.extrinsics(spark, paths[1]).join(F.broadcast(binary.intrinsics(spark, paths[0])), "camera_id")  # a camera for each of 25 nations
    return back.select(F.col("image_id").cast("long").alias("image_id"), "name", "model", F.col("params")[0].alias("f"), r6(F.col("tvec")[0]).alias("tx"), F.size("xys").alias("points"))


@BOOK.query(f"SELECT vec_id AS id, {q6('CAST(embedding[2] AS DOUBLE)', 'y')}, {q6('CAST(embedding[7] AS DOUBLE)', 'dc')}, {q6('list_sum(embedding[10:54]::DOUBLE[])', 'rest')}, {q6('CAST(embedding[62] AS DOUBLE)', 'q3')}, {q6('CAST(embedding[56] AS DOUBLE)', 's0')}, (SELECT count(*) FROM embeddings) AS stated FROM embeddings")
def stored_model(spark: SparkSession, d: str) -> DataFrame:
    """A model of an older form, stored with its settings and loaded in the present one."""
    e = lambda a, z: F.slice(F.col("embedding").cast("array<double>"), a + 1, z - a)
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e(0, 3).alias("points"), F.concat(e(6, 7), e(9, 54)).alias("sh_coordinates"), F.concat(e(58, 62), e(55, 58)).alias("radiuses"))
    path = _path(spark, "model")
    checkpoints.save(old, path, {"splats": old.count()})
    now, settings = checkpoints.load(spark, path)
    rest = F.aggregate("_sh_coordinates_rest", F.lit(0.0), lambda a, x: a + x)
    return now.select("id", r6(F.col("_points")[1]).alias("y"), r6(F.col("_sh_coordinates_dc")[0]).alias("dc"), r6(rest).alias("rest"), r6(F.col("_quaternions")[3]).alias("q3"), r6(F.col("_scales")[0]).alias("s0"), F.lit(settings["splats"]).cast("long").alias("stated"))


_GONE, _HALF = [3, 11], 0.5


@BOOK.query(
    f"""WITH v AS (SELECT o_custkey AS c, o_orderkey % 25 AS camera, min(o_orderkey % 1000) AS key FROM orders GROUP BY ALL), left_ AS (SELECT c, camera - (camera > {_GONE[0]})::INT - (camera > {_GONE[1]})::INT AS camera, key FROM v WHERE camera NOT IN ({_GONE[0]}, {_GONE[1]})),
    seen AS (SELECT c, n_nationkey, n_regionkey, l.camera, l.key FROM left_ l JOIN (SELECT n_nationkey, n_regionkey, n_nationkey - (n_nationkey > {_GONE[0]})::INT - (n_nationkey > {_GONE[1]})::INT AS camera FROM nation WHERE n_nationkey NOT IN ({_GONE[0]}, {_GONE[1]})) n USING (camera))
    SELECT dense_rank() OVER (ORDER BY c_custkey) - 1 AS point, x, r, views, marks, focals FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey % 256 AS INTEGER) AS r, count(camera) AS views, CAST(coalesce(sum(camera * 1000 + key), 0) AS BIGINT) AS marks, coalesce(sum({_HALF} * (500 + n_nationkey)), 0.0)::DOUBLE AS focals FROM customer JOIN (SELECT DISTINCT c FROM v) ever ON ever.c = c_custkey LEFT JOIN seen ON seen.c = c_custkey GROUP BY ALL)"""
)
def bundle_file(spark: SparkSession, d: str) -> DataFrame:
    """Nations as cameras, customers as points, orders as views; written, read, two cameras excluded, focal lengths halved. Points with the cameras that see them."""
    nations = table(spark, d, "nation")
    zero = F.lit(0.0)
    cams = nations.select(F.col("n_nationkey").cast("long").alias("camera"), (500.0 + F.col("n_nationkey")).alias("focal"), zero.alias("k1"), zero.alias("k2"), F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))).alias("rotation"), F.array(F.col("n_regionkey").cast("double"), zero, zero).alias("translation"))
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 25).alias("camera")).agg(F.min(F.col("o_orderkey") % 1000).alias("key"))
    views = seen.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("camera", "key", F.lit(0.5).alias("x"), F.lit(-1.5).alias("y")))).alias("views"))
    customers = table(spark, d, "customer").join(views, F.col("c") == F.col("c_custkey"))
    points = customers.select(F.col("c_custkey").alias("point"), F.col("c_nationkey").cast("double").alias("x"), zero.alias("y"), F.lit(1.0).alias("z"), *((F.col("c_custkey") % 256).cast("int").alias(c) for c in "rgb"), "views")
    path = _path(spark, "bundle")
    bundle.save(bundle.Bundle("# Bundle file v0.3", points.count(), cams, points), path)
    back = bundle.scaled(bundle.excluded(bundle.read(spark, path), _GONE), _HALF)
    each = back.points.select("point", F.explode("views").alias("v")).select("point", "v.camera", "v.key").join(back.cameras.select("camera", "focal"), "camera")
    sums = each.groupBy("point").agg(F.count("*").alias("views"), F.sum(F.col("camera") * 1000 + F.col("key")).alias("marks"), F.sum("focal").alias("focals"))
    return back.points.select("point", "x", "r").join(sums, "point", "left").na.fill(0, ["views", "marks"]).na.fill(0.0, ["focals"])
