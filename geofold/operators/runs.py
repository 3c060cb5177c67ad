"""Merging and comparing the metric records of experiment runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = ("coarse_", "mesh_", "meshvis_")


def normalised_name(name, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """The first prefix that fits goes."""
    return F.regexp_replace(name, f"^({'|'.join(prefixes)})", "")


def outer_merged(parts: dict[str, DataFrame], key: str = "run") -> DataFrame:
    """All runs of any part; columns get the part's name in front."""
    named = [df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key)) for p, df in parts.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), named)


def inherited(runs: DataFrame, parents: DataFrame, groups: dict[str, list[str]], key: str = "run", parent: str = "parent") -> DataFrame:
    """What a run lacks comes from its parent run, each group of columns on its own: a group that is null throughout is the parent's,
    if the parent has any of it. ``<group>_source`` says where a group is from. Parents aren't followed further."""
    columns = [c for own in groups.values() for c in own]
    above = runs.select(F.col(key).alias(parent), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = runs.join(parents, key, "left").join(above, parent, "left")
    none = lambda names: reduce(lambda a, b: a & b, (F.col(c).isNull() for c in names))
    out = [F.col(c) for c in runs.columns if c not in columns]
    for name, own in groups.items():
        takes = none(own) & ~none([f"__{c}" for c in own])
        out += [F.when(takes, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in own]
        out.append(F.when(~none(own), F.lit("own")).when(takes, F.concat(F.lit("inherited:"), F.col(parent))).otherwise(F.lit("missing")).alias(f"{name}_source"))
    return joined.select(*out)


def first_present(*candidates: tuple[str, float]) -> Column:
    """First non-null candidate column, each times its unit's factor."""
    return F.coalesce(*(F.col(c) * k for c, k in candidates))


def shown(value, digits: int = 3, missing: str = "NA") -> Column:
    """Formatted; null and NaN are shown as missing, 0 is not."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.when(v.isNotNull() & ~F.isnan(v), F.format_string(f"%.{digits}f", v)), F.lit(missing))


def prefixed_value(m, prefix: str) -> Column:
    """Value of the map's first key (in key order) that starts with a prefix."""
    found = F.map_filter(m, lambda k, v: F.startswith(k, F.lit(prefix)))
    return F.element_at(found, F.array_min(F.map_keys(found)))


def preferred_order(name, preferred: list[str]) -> list[Column]:
    """Sort columns: names of the list in its order, then the rest alphabetically."""
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col(name))
    return [F.when(at == 0, len(preferred) + 1).otherwise(at), F.col(name)]


def reconciled(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, a, b, ok) of the keys of both tables."""
    a, b = left.select(key, F.col(value).alias("a")), right.select(key, F.col(value).alias("b"))
    return a.join(b, key).withColumn("ok", F.abs(F.col("a") - F.col("b")) <= tolerance)


def latest_by_path(files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """For each key the row of the last path."""
    return files.groupBy(key).agg(F.max_by(F.struct(*files.columns), path).alias("r")).select("r.*")
