"""Views of the test tables as splats, cameras, meshes, runs and logs, for Spark and for DuckDB.

A vector's numbers are a splat: place 0-2, normal 3-5, base colour 6-8, further colour 9-53,
opacity 54, scales 55-57 (log scale 2 e - 3), quaternion 58-61. Vectors of label 0 also serve as cameras.
Order lines serve as triangles over the vectors, orders as iteration logs, customers and suppliers as runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions.geom import sigmoid
from geofold.operators.ordering import numbered


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def splats(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "label",
        *(e(i).alias(c) for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz", "f0", "f1", "f2"))),
        *(e(9 + i).alias(f"r{i}") for i in range(15)),
        e(54).alias("opacity_logit"), sigmoid(e(54)).alias("opacity"),
        *(F.exp(2 * e(55 + k) - 3).alias(f"s{k}") for k in range(3)),
        *(e(58 + k).alias(f"q{k}") for k in range(4)),
    )


_E = lambda i: f"CAST(embedding[{i + 1}] AS DOUBLE)"
SPLATS = "splats AS (SELECT vec_id AS id, label, " + ", ".join(
    [f"{_E(i)} AS {c}" for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz", "f0", "f1", "f2"))]
    + [f"{_E(9 + i)} AS r{i}" for i in range(15)]
    + [f"{_E(54)} AS opacity_logit", f"1 / (1 + exp(-{_E(54)})) AS opacity"]
    + [f"exp(2 * {_E(55 + k)} - 3) AS s{k}" for k in range(3)]
    + [f"{_E(58 + k)} AS q{k}" for k in range(4)]
) + " FROM embeddings)"


def cameras(spark: SparkSession, d: str) -> DataFrame:
    return splats(spark, d).where("label = 0").select("id", F.lpad(F.col("id").cast("string"), 8, "0").alias("name"), "x", "y", "z")


CAMERAS = SPLATS + ", cameras AS (SELECT id, lpad(CAST(id AS VARCHAR), 8, '0') AS name, x, y, z FROM splats WHERE label = 0)"


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return splats(spark, d).select(F.col("id").alias("vid"), "x", "y", "z")


def corner_triples(spark: SparkSession, d: str) -> DataFrame:
    """All order lines as corners, repeats and degenerate ones included."""
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    return table(spark, d, "lineitem").join(F.broadcast(n)).select("l_orderkey", "l_linenumber", *((F.col(k) % F.col("n")).alias(c) for k, c in (("l_orderkey", "a"), ("l_partkey", "b"), ("l_suppkey", "c"))))


def faces(spark: SparkSession, d: str) -> DataFrame:
    proper = corner_triples(spark, d).where("a != b AND b != c AND a != c").select("a", "b", "c").distinct()
    return numbered(proper, ["a", "b", "c"], "fid").select("fid", "a", "b", "c")


TRIPLES = "triples AS (SELECT l_orderkey, l_linenumber, l_orderkey % n AS a, l_partkey % n AS b, l_suppkey % n AS c FROM lineitem, (SELECT count(*) AS n FROM embeddings))"
FACES = TRIPLES + ", faces AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS fid, a, b, c FROM (SELECT DISTINCT a, b, c FROM triples WHERE a <> b AND b <> c AND a <> c))"
EDGES = FACES + ", edges AS (SELECT fid, unnest([least(a, b), least(b, c), least(c, a)]) AS u, unnest([greatest(a, b), greatest(b, c), greatest(c, a)]) AS v FROM faces)"
CORNERED = SPLATS + ", " + FACES + ", cornered AS (SELECT f.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM faces f JOIN splats p ON p.id = a JOIN splats q ON q.id = b JOIN splats r ON r.id = c)"


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events as the iteration logs of their users' runs."""
    return table(spark, d, "events").select(F.concat(F.lit("run"), "user_id").alias("run"), "event_id", "ts", "event_type", "value", "props", F.row_number().over(_by_user()).alias("iteration"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


LOG = "log AS (SELECT 'run' || user_id AS run, event_id, ts, event_type, value, props, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS iteration FROM events)"


def records(spark: SparkSession, d: str) -> DataFrame:
    """A metric row for each user's run: one value for each kind of event, null where there is none."""
    return log(spark, d).groupBy("run").agg(*(F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "view", "purchase")))


RECORDS = LOG + ", records AS (SELECT run, " + ", ".join(f"avg(value) FILTER (event_type = '{k}') AS {k}" for k in ("click", "view", "purchase")) + " FROM log GROUP BY run)"


def image(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as grey images: 8 x 8 pixels each."""
    pixels = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("p", "v"))
    return pixels.select("img", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).cast("int").alias("col"), F.col("v").cast("double").alias("value"))


IMAGE = "image AS (SELECT img, CAST(p // 8 AS INTEGER) AS row, CAST(p % 8 AS INTEGER) AS col, value FROM (SELECT vec_id AS img, unnest(range(len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings))"
