"""Stored models: a table of splats beside a JSON table of settings, and models of older forms brought to the present one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(splats: DataFrame, path: str, settings: dict) -> None:
    """Writes path/splats (Parquet, by the executors) and path/settings (one JSON line)."""
    splats.write.mode("overwrite").parquet(f"{path}/splats")
    splats.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The splats in the present form, and the settings."""
    return present_form(spark.read.parquet(f"{path}/splats")), json.loads(spark.read.text(f"{path}/settings").first()[0])


def present_form(splats: DataFrame) -> DataFrame:
    """Columns of older forms under their present names: points -> _points; sh_coordinates -> _sh_coordinates_dc, the first
    coefficient, and _sh_coordinates_rest; radiuses (quaternion, then scales) -> _quaternions and _scales. What has its present name already stays."""
    have, out = set(splats.columns), splats
    if "points" in have and "_points" not in have:
        out = out.withColumnRenamed("points", "_points")
    if "sh_coordinates" in have and "_sh_coordinates_dc" not in have:
        rest = F.slice("sh_coordinates", 2, F.greatest(F.size("sh_coordinates") - 1, F.lit(0)))
        out = out.withColumns({"_sh_coordinates_dc": F.slice("sh_coordinates", 1, 1), "_sh_coordinates_rest": rest}).drop("sh_coordinates")
    if "radiuses" in have and "_scales" not in have:
        out = out.withColumns({"_quaternions": F.slice("radiuses", 1, 4), "_scales": F.slice("radiuses", 5, F.greatest(F.size("radiuses") - 4, F.lit(0)))}).drop("radiuses")
    return out
