"""Predicates and splits over splat, point and camera tables. Masks always say what is KEPT."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofold.functions.geom import sigmoid
from geofold.operators.ordering import numbered
from geofold.operators.quantiles import quantile_columns
from geofold.operators.stats import quantiles

XYZ = ("x", "y", "z")


def inside_box(low: list, high: list, axes=XYZ) -> Column:
    """Strictly inside on all axes."""
    return reduce(lambda a, b: a & b, ((F.col(c) > lo) & (F.col(c) < hi) for c, lo, hi in zip(axes, low, high, strict=True)))


def in_shell(centre: list, radius: Column, axes=XYZ) -> Column:
    """Chebyshev distance to the centre below radius."""
    return F.greatest(*(F.abs(F.col(c) - m) for c, m in zip(axes, centre, strict=True))) < radius


def opaque(column: str = "opacity_logit", least: float = 0.5) -> Column:
    return sigmoid(column) > least


def dense_enough(least_opacity: float, max_radius: float | None, extent) -> Column:
    """Kept by the densifier: opaque enough and, if a size limit is set, neither large on screen nor in space."""
    keep = sigmoid("opacity_logit") >= least_opacity
    if max_radius is not None:
        keep = keep & ~((F.col("radius2d") > max_radius) | (F.col("max_scale") > 0.1 * extent))
    return keep


def visible(radius: str = "radius") -> Column:
    """Drawn with a radius on screen."""
    return F.coalesce(F.col(radius) > 0, F.lit(False))


#: What a step's condition may hold besides ``${name}``.
STEP_WORDS = ("not", "and", "or", "is", "in")


def step_runs(condition: str, settings: dict[str, bool]) -> bool:
    """Whether a pipeline step runs: a condition of names ``${name}`` and not, and, or; `is` and `in` compare two names.

    Raises ValueError on anything else, an unknown name included.
    """
    words = re.findall(r"\$\{\w+\}|\S+", condition)
    if not words or any(not re.fullmatch(r"\$\{\w+\}", w) and w not in STEP_WORDS for w in words):
        raise ValueError(f"not a step condition: {condition!r}")

    def operand():
        if not words:
            raise ValueError(f"not a step condition: {condition!r}")
        word = words.pop(0)
        if word in STEP_WORDS or word[2:-1] not in settings:
            raise ValueError(f"unknown in a step condition: {word!r}")
        return settings[word[2:-1]]

    def comparison():
        if words and words[0] == "not":
            words.pop(0)
            return not comparison()
        value = operand()
        if words and words[0] == "is":
            words.pop(0)
            turned = bool(words) and words[0] == "not" and bool(words.pop(0))
            return (value is operand()) != turned
        if words and (words[0] == "in" or words[:2] == ["not", "in"]):
            turned = words.pop(0) == "not" and bool(words.pop(0))
            return (value in operand()) != turned
        return value

    def conjunction():
        value = comparison()
        while words and words[0] == "and":
            words.pop(0)
            value = comparison() and value
        return value

    value = conjunction()
    while words and words[0] == "or":
        words.pop(0)
        value = conjunction() or value
    if words:
        raise ValueError(f"not a step condition: {condition!r}")
    return bool(value)


def finite(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns))


def split_by_rank(df: DataFrame, order: list[str], modulus: int = 8) -> DataFrame:
    """df with its position in order and the split it belongs to: every modulus-th row is for tests."""
    return numbered(df, order, "position").withColumn("split", F.when(F.col("position") % modulus == 0, "test").otherwise("train"))


def over_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """Rows not below the exact q-quantile; all rows if q is 0."""
    if q == 0:
        return df
    return df.where(F.col(value) >= F.lit(quantiles(df, value, [q])[0]))


def without_contention(df: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """Rows not over factor times the median."""
    limit = quantile_columns(df, {"__median": (value, 0.5)}).select((F.col("__median") * factor).alias("__limit"))
    return df.join(F.broadcast(limit)).where(F.col(value) <= F.col("__limit")).drop("__limit")


def lines_deleted(df: DataFrame, partition: list[str], order: list[str], match: Column, and_next: bool = True) -> DataFrame:
    """Lines that don't match and, with and_next, don't follow a match."""
    before = F.lag(match).over(Window.partitionBy(*partition).orderBy(*order))
    keep = ~match & ~F.coalesce(before, F.lit(False)) if and_next else ~match
    return df.withColumn("__keep", keep).where("__keep").drop("__keep")
