"""Summaries of distributions, series and experiment records."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofold.operators.quantiles import beside, quantile_columns, quantile_rows


def quantiles(df: DataFrame, value, qs: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, as numbers; nulls and NaN don't count, None without a value."""
    found = {r["q"]: r["value"] for r in quantile_rows(df, {"x": value}, qs).collect()}  # one row for each q
    return [found.get(float(q)) for q in qs]


def distribution(df: DataFrame, value: str, by: list[str] | tuple = ()) -> DataFrame:
    """Mean, median, p90, population deviation and count; quantiles are exact with linear interpolation."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    found = quantile_columns(df, {"median": (value, 0.5), "p90": (value, 0.9)}, by)
    both = beside(plain, found, list(by)) if by else plain.join(F.broadcast(found))
    return both.select(*by, "n", "mean", "median", "p90", "std")


def deciles(df: DataFrame, value: str, parts: int = 10) -> DataFrame:
    """(step, q): exact quantiles step / parts; without a value none."""
    return quantile_rows(df, {"x": value}, [i / parts for i in range(parts + 1)]).select(F.round(F.col("q") * parts).cast("int").alias("step"), F.col("value").alias("q"))


def with_each(points: DataFrame, few: DataFrame, most: int = 4096) -> DataFrame:
    """Every row of points beside every row of a small table; that is sent to all tasks in blocks of about ``most`` rows, whatever its size."""
    blocks = max(1, -(-few.count() // most))
    part = F.pmod(F.xxhash64(*few.columns), F.lit(blocks))
    return reduce(DataFrame.unionByName, (points.crossJoin(F.broadcast(few.where(part == b))) for b in range(blocks)))


def histogram(df: DataFrame, value: str, width: float, bins: int) -> DataFrame:
    """(bin, n) of all bins; the last one is closed above."""
    counts = df.where((F.col(value) >= 0) & (F.col(value) <= width * bins)).groupBy(F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def share_below(df: DataFrame, value: str, limit: float) -> DataFrame:
    return df.agg(F.avg((F.col(value) < limit).cast("double")).alias("share"))


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, window: int = 5) -> DataFrame:
    """df with the trailing mean; before the start, the first value is repeated. A series shorter than the window has one of its own length."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.least(F.lit(window), F.count(F.lit(1)).over(Window.partitionBy(*by)))
    recent = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(-(window - 1), 0))
    own = F.slice(recent, F.greatest(F.size(recent) - n + 1, F.lit(1)), n)
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x["v"])
    return df.withColumn("smooth", (total + (n - F.size(own)) * F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))) / n)


def ema(df: DataFrame, by: list[str], order: list[str], value: str, weight: float = 0.4, least: float = 1e-18) -> DataFrame:
    """df with weight * x + (1 - weight) * previous, from 0, as a trailing weighted sum.

    Terms that weigh less than ``least`` of the newest are left out: as many rows are looked back on as the weight asks for.
    """
    if not 0 < weight <= 1:
        raise ValueError("weight must be over 0 and at most 1")
    w = Window.partitionBy(*by).orderBy(*order)
    levels = 0 if weight == 1 else math.ceil(math.log(least) / math.log1p(-weight))
    recent = F.collect_list(value).over(w.rowsBetween(-levels, 0))
    return df.withColumn("ema", F.aggregate(recent, F.lit(0.0), lambda s, x: (1 - weight) * s + weight * x))


def trend_slope(df: DataFrame, by: list[str], x: str, y: str, factor: float = 1000.0, least: int = 3) -> DataFrame:
    """Least-squares slope times factor; null below ``least`` finite points."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return ok.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.regr_slope(y, x) * factor).alias("slope"))


def head_tail(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """First, middle and last value and the means of the first and last tenth (one row at least)."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    tenth = F.greatest(F.lit(1), F.floor(F.col("__n") / 10))
    pick = lambda cond: F.max(F.when(cond, F.col(value)))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        pick(F.col("__i") == 0).alias("first"),
        pick(F.col("__i") == F.floor(F.col("__n") / 2)).alias("middle"),
        pick(F.col("__i") == F.col("__n") - 1).alias("last"),
        F.avg(F.when(F.col("__i") < tenth, F.col(value))).alias("head"),
        F.avg(F.when(F.col("__i") >= F.col("__n") - tenth, F.col(value))).alias("tail"),
    )


def consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column whether it has a single value."""
    return df.agg(*((F.countDistinct(c) == 1).alias(c) for c in columns))


def relative_to(df: DataFrame, value: str, base: Column) -> DataFrame:
    """df with the difference to the base row's value in percent; null where the base is 0 or missing."""
    found = df.where(base).agg(F.first(value, ignorenulls=True).alias("__base"))
    return df.join(F.broadcast(found)).withColumn("percent", (F.col(value) - F.col("__base")) / F.nullif(F.col("__base"), F.lit(0.0)) * 100).drop("__base")


def masked_mean(df: DataFrame, value: Column, mask: Column) -> DataFrame:
    """Sum of masked values over the mask's size, 1 at least."""
    m = mask.cast("double")
    return df.agg((F.coalesce(F.sum(value * m), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(m), F.lit(0.0)), F.lit(1.0))).alias("loss"))


def robust_range(df: DataFrame, by: list[str], value: str, hit: Column, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(by, low, high): exact outer percentiles of the hit values of each group; 0 and 1 for a group without a hit."""
    only = F.when(hit, F.col(value))
    found = quantile_columns(df, {"low": (only, low), "high": (only, high)}, by)
    return beside(df.select(*by).distinct(), found, by).select(*by, F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"))
