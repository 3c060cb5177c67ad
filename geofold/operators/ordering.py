"""Row numbers, prefix sums and runs over whole tables without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofold.operators.shared import stash


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with consecutive numbers from 0 in the order of the columns: ranges are sorted apart, then shifted by the rows before."""
    rows = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    # one row for each partition of the sort
    before = counts.select("__part", F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + at).drop("__part", "__before", "__at")


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str, inclusive: bool = True) -> DataFrame:
    """df with running sums of a value in the order of the columns."""
    rows = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "prefix").withColumn("__part", F.shiftright("__at", 33))
    sums = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    total = F.col("__before") + own if inclusive else F.col("__before") + own - F.col(value)
    return rows.join(F.broadcast(before), "__part").withColumn(name, total).drop("__part", "__before", "__at", "__sum")


def run_ranges(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, first, last): numbers of the rows that each key spans when rows are sorted by key, then order."""
    return numbered(df.select(*dict.fromkeys([*key, *order])), [*key, *order]).groupBy(*key).agg(F.min("n").alias("first"), (F.max("n") + 1).alias("last"))


def around(df: DataFrame, order: list[str], reach: int, keep: list[str], others: list[str]) -> DataFrame:
    """Pairs of a row (columns keep) and each other row at most ``reach`` places away in order (columns others, with other_ in front)."""
    rows = numbered(df, order, "__place")
    left = rows.select("__place", *keep).withColumn("__at", F.explode(F.array(*(F.col("__place") + d for d in range(-reach, reach + 1) if d))))
    right = rows.select(F.col("__place").alias("__at"), *(F.col(c).alias(f"other_{c}") for c in others))
    return left.join(right, "__at").drop("__at", "__place")
