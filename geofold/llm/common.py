"""Helpers shared by the corpus operators: shared-folder tables, table access, word splitting."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.operators.shared import stash, unstash

__all__ = ["JAVA_WORD", "doc_crc", "fresh", "mapped", "stash", "table", "text_bytes", "unstash"]

#: Words are maximal runs without ASCII white space; bytes.split() has exactly this rule on UTF-8.
JAVA_WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch that Python workers get, in sessions that don't say.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def mapped(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches bounded by bytes; a worker gives memory back at each task's end."""
    bounded(df.sparkSession)

    def run(batches):
        yield from f(batches)
        trim()

    return df.mapInArrow(run, schema)


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes in sessions that don't, so that very long texts don't add up."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def trim() -> None:
    """Hands free memory of this worker back to the machine: other workers and the JVM share its bound."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with marks in front until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def doc_crc(column="doc_id"):
    """crc32 of the decimal text of an id; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
