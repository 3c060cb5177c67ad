"""Exact quantiles of several columns and groups in one run.

Equal values of a group are counted first, so copies are one row. The counted values of all columns and groups are sorted in ranges
by (group, column, value), and running counts give each row the places that its value holds in that order: a group's
quantiles are the values at known places. Rows and wanted places meet by blocks of places, so neither a large group nor a frequent
value is ever in one task, and no value comes to the driver.

Infinities are values like others; between the two infinities, and only there, a quantile is NaN. Nulls and NaN don't count. A null in a
group's column is a group of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofold.operators.ordering import prefix_sum
from geofold.operators.shared import stash

#: Blocks of places, about; rows of one value are in as many blocks as their places.
BLOCKS = 4096


def quantile_rows(df: DataFrame, values: dict[str, str | Column], qs: list[float], by: list[str] | tuple = ()) -> DataFrame:
    """(by, name, q, value): the q-quantiles, with linear interpolation, of named columns in each group that has a value."""
    cells = F.array(*(F.struct(F.lit(name).alias("name"), (F.col(x) if isinstance(x, str) else x).cast("double").alias("x")) for name, x in values.items()))
    keys = [f"__{i}" for i in range(len(by))] + ["__name"]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=False)), F.explode(cells).alias("__v")).select(*keys[:-1], F.col("__v.name").alias("__name"), F.col("__v.x").alias("__x"))
    counted = stash(rows.where(F.col("__x").isNotNull() & ~F.isnan("__x")).groupBy(*keys, "__x").agg(F.count("*").alias("__n")), "quantile-values")
    placed = stash(prefix_sum(counted, [*keys, "__x"], "__n", "__upto").withColumn("__from", F.col("__upto") - F.col("__n")), "quantile-places")
    total = placed.agg(F.max("__upto")).first()[0] or 0
    block = lambda place: F.floor(place / F.lit(max(1, total // BLOCKS)))

    groups = placed.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.min("__from").alias("__first"))
    each = groups.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs)))).withColumn("__p", F.col("q") * (F.col("__all") - 1))
    wanted = each.withColumn("__place", F.explode(F.array(F.col("__first") + F.floor("__p"), F.col("__first") + F.ceil("__p")))).withColumn("__block", block(F.col("__place")))
    held = placed.select("__from", "__upto", F.col("__x").alias("__at"), F.explode(F.sequence(block(F.col("__from")), block(F.col("__upto") - 1))).alias("__block"))
    found = wanted.join(held, "__block").where("__place >= __from AND __place < __upto")
    both = found.groupBy(*keys, "q").agg(F.first("__p").alias("__p"), F.min("__at").alias("__low"), F.max("__at").alias("__high"))
    part = F.col("__p") - F.floor("__p")
    value = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise((1 - part) * F.col("__low") + part * F.col("__high"))
    return both.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=False)), F.col("__name").alias("name"), "q", value.alias("value"))


def quantile_columns(df: DataFrame, wanted: dict[str, tuple[str | Column, float]], by: list[str] | tuple = ()) -> DataFrame:
    """(by, a column for each name of wanted): a quantile of a column for each name, null where a group has no value."""
    columns = list({str(x): x for x, _ in wanted.values()}.values())
    name = {str(x): str(i) for i, x in enumerate(columns)}
    rows = quantile_rows(df, {name[str(x)]: x for x in columns}, sorted({float(q) for _, q in wanted.values()}), by)
    pick = [F.max(F.when((F.col("name") == name[str(x)]) & (F.col("q") == float(q)), F.col("value"))).alias(k) for k, (x, q) in wanted.items()]
    return rows.groupBy(*by).agg(*pick)


def beside(groups: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """groups with the columns of found for the same group, null groups included; null without one."""
    own = found.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(by)})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)))
    return groups.join(own, same, "left").drop(*(f"__{i}" for i in range(len(by))))
