"""Repeatable samples: random choices are hashes of ids and a seed, so any run and any partitioning gives the same rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofold.functions.geom import apply, from_spherical, quaternion_matrix
from geofold.operators.ordering import numbered, prefix_sum
from geofold.operators.shared import stash


def order_key(seed: int, *ids) -> Column:
    """MD5 of the ids and the seed, set apart by bars: an order that any engine can repeat."""
    return F.md5(F.concat_ws("|", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in ids), F.lit(str(seed))))


def uniform(seed: int, *ids) -> Column:
    """In (0, 1), by the ids: the first 52 bits of their key."""
    return (F.conv(F.substring(order_key(seed, *ids), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def normal(seed: int, *ids) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, *ids))) * F.cos(2 * math.pi * uniform(seed + 1, *ids))


def capped(df: DataFrame, by: list[str], ids: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most so many rows of each group, chosen at random."""
    w = Window.partitionBy(*by).orderBy(order_key(seed, *ids), *ids)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def subsample(df: DataFrame, ids: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(order_key(seed, *ids), *ids).limit(n)


def shuffled(df: DataFrame, ids: list[str], epoch: int = 0) -> DataFrame:
    """df with ``place``, its rows' order in an epoch, from 0; numbered without a single task."""
    return numbered(df.withColumn("__key", order_key(epoch, *ids)), ["__key", *ids], "place").drop("__key")


def stacked(objects: list[DataFrame], order: list[str]) -> DataFrame:
    """Objects' rows as one scene: columns of the objects, object (its place in the list) and row, numbered through the scene."""
    parts = [o.withColumn("object", F.lit(i)) for i, o in enumerate(objects)]
    return numbered(reduce(DataFrame.unionByName, parts), ["object", *order], "row")


def weighted(df: DataFrame, order: list[str], weight: str, n: int, seed: int = 0, slices: int = 4096) -> DataFrame:
    """n draws with replacement, chances in proportion to weight: (draw, columns of df).

    Weights form one line; draws and rows meet in equal slices of it, so the join is by equality.
    """
    line = stash(prefix_sum(df.where(F.col(weight) > 0), order, weight, "__upto"), "weights").withColumn("__from", F.col("__upto") - F.col(weight))
    total = line.agg(F.max("__upto")).first()[0]
    if not total:
        return line.select(F.lit(0).cast("long").alias("draw"), *df.columns).limit(0)
    slot = lambda c: F.least(F.floor(c / F.lit(total) * slices), F.lit(slices - 1))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform(seed, "id") * F.lit(total)).alias("__at")).withColumn("__slot", slot(F.col("__at")))
    rows = line.withColumn("__slot", F.explode(F.sequence(slot(F.col("__from")), slot(F.col("__upto")))))
    return draws.join(rows, "__slot").where("__at >= __from AND __at < __upto").select("draw", *df.columns)


def random_points(spark, n: int = 100_000, half: float = 1.3, seed: int = 0) -> DataFrame:
    """(id, x, y, z) uniform in a cube."""
    return spark.range(n).select("id", *(((2 * uniform(seed + k, "id") - 1) * half).alias(c) for k, c in enumerate("xyz")))


def densified(splats: DataFrame, small: Column, large: Column, parts: int = 2, shrink: float = 0.8, seed: int = 0) -> DataFrame:
    """Splats after one growth step: small ones of high gradient are cloned, large ones replaced by shrunk parts.

    splats: id, x, y, z, s0, s1, s2, q0..q3; new rows have ``part`` > 0 and keep the id they come from. A part's
    offset is drawn in the splat's own frame, each axis by its scale, and turned by its quaternion.
    """
    rest = splats.where(~F.coalesce(large, F.lit(False))).withColumn("part", F.lit(0))
    clones = splats.where(small).withColumn("part", F.lit(1))
    split = splats.where(large).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    split = split.withColumns({f"__o{k}": normal(seed + 10 * k, "id", "part") * F.col(f"s{k}") for k in range(3)})
    turned = apply(quaternion_matrix([f"q{k}" for k in range(4)]), ["__o0", "__o1", "__o2"])
    split = split.withColumns({c: F.col(c) + o for c, o in zip("xyz", turned, strict=True)}).drop("__o0", "__o1", "__o2")
    for k in range(3):
        split = split.withColumn(f"s{k}", F.col(f"s{k}") / (shrink * parts))
    return rest.unionByName(clones).unionByName(split)


def sphere_lattice(spark, elevations: int = 10, azimuths: int = 20, poles: bool = False) -> DataFrame:
    """(id, elevation, azimuth, x, y, z): a lattice of unit directions in degrees, y up; poles adds one point near each."""
    rows = spark.range(elevations * azimuths).select((F.col("id") + int(poles)).alias("id"), (-90 + (F.floor(F.col("id") / azimuths) + 1) / (elevations + 1) * 180.0).alias("elevation"), (360.0 * (F.col("id") % azimuths) / azimuths).alias("azimuth"))
    if poles:
        rows = rows.unionByName(spark.createDataFrame([(0, -89.9, 0.0), (elevations * azimuths + 1, 89.9, 0.0)], rows.schema))
    return rows.select("*", *(c.alias(n) for c, n in zip(from_spherical(F.radians("elevation"), F.radians("azimuth")), "xyz", strict=True)))
