"""Quality rules: lines that many of a host's documents share are removed; documents left with little are rejected.

A line is normalised (ASCII lower case, single spaces, digits as 0) and hashed.
Over the distinct documents of a host (those with different texts: copies of one text are one, as which of
them stays is near-duplicate detection's to say; ``copies=True`` counts every row), each line is counted once for a document, and so over all hosts together. A line that more
than ``MIN_DOCS`` documents of a host hold is removed from that host's documents; one that more
than ``ALL_DOCS`` documents of all hosts hold, from every document. Limits are numbers of documents, the same for
small and large hosts. A document whose remaining words are fewer than ``MIN_LEFT`` of its words is depleted
and rejected. Base rules on the whole text come first. Near copies share most of their lines: a document that
would be depleted keeps the lines that it is the first (smallest id) to hold, if that leaves it enough,
so one of many near copies stays.

Counts are aggregated before they are shuffled, so a line that a third of all documents
hold is a few rows in each task.

Defined cases: null and empty texts have no words and fail the base rules; null
hosts are one host of their own; repeated rows are judged each on its own but
counted once; an empty table gives no rows; extra columns are passed on by ``clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm.common import fresh, mapped, stash, text_bytes

MIN_DOCS = 10
ALL_DOCS = 50
MIN_LEFT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_DIGIT = re.compile(rb"[0-9]")

_FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINES = "lines array<struct<line:long,words:int>>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def line_hash(line: bytes) -> int:
    """Signed XXH64 of the normalised line."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(_DIGIT.sub(b"0", b" ".join(line.lower().split())))
    return h - (1 << 64) if h >> 63 else h


def facts(data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split():
            seen.add(line)
    return len(words), chars, len(_SYMBOL.findall(data)), dup, repeated_words(words)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document: row_id, doc_id, host, text_hash, base facts and its lines' hashes with their words."""
    names = [x.split()[0] for x in _FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            found, lines = [], []
            for data in text_bytes(b.column(3)):
                found.append(facts(data))
                lines.append([{"line": line_hash(x), "words": len(x.split())} for x in data.split(b"\n") if x.split()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(b)), pa.int64()), b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(names))), pa.array(lines, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())])))],
                ["row_id", "doc_id", "host", "text_hash", *names, "lines"],
            )
            row += len(b)

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[host_col].cast("string").alias("host"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    return mapped(chosen, run, f"row_id long, doc_id long, host string, text_hash long, {_FACTS}, {_LINES}")


def frequent_lines(described: DataFrame, min_docs: int = MIN_DOCS, all_docs: int = ALL_DOCS, copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """(host_key, line) of the lines over the limit in a host, and (line) of those over the limit in all hosts; host_key: the host's hash."""
    document = F.col("row_id" if copies else "text_hash").alias("document")
    held = described.select(F.xxhash64("host").alias("host_key"), document, F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).distinct()
    per_line = stash(held.groupBy("host_key", "line").agg(F.count("*").alias("n")).groupBy("line").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > min_docs, F.col("host_key"))).alias("hosts")).where((F.col("n") > all_docs) | (F.size("hosts") > 0)), "line-counts")
    # a text that several hosts hold counts once: only lines that might be over the limit are counted again
    maybe = per_line.where(F.col("n") > all_docs).select("line")
    everywhere = stash(held.join(maybe, "line", "left_semi").select("document", "line").distinct().groupBy("line").count().where(F.col("count") > all_docs).select("line"), "lines-everywhere")
    return per_line.select(F.explode("hosts").alias("host_key"), "line").join(everywhere, "line", "left_anti").select("host_key", "line"), everywhere


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, all_docs: int = ALL_DOCS, min_left: float = MIN_LEFT, copies: bool = False) -> DataFrame:
    """Facts, base_failed, removed_words, removed_lines (hashes) and kept for every row of docs."""
    described = stash(describe(docs, id_col, text_col, host_col), "lines")
    of_host, everywhere = frequent_lines(described, min_docs, all_docs, copies)
    each = described.select("row_id", "doc_id", "text_hash", F.xxhash64("host").alias("host_key"), F.explode("lines").alias("x")).select("row_id", "doc_id", "text_hash", "host_key", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    # a line removed everywhere has one first holder; one of a host has one there
    over = each.join(everywhere, "line").withColumn("host_key", F.lit(None).cast("long")).unionByName(each.join(of_host, ["host_key", "line"]))
    found = stash(over.groupBy("row_id", "doc_id", "text_hash", "host_key", "line").agg(F.sum("words").alias("words")), "frequent-lines")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.groupBy("host_key", "line").agg(F.min(order)["text_hash"].alias("first_hash")).withColumnRenamed("host_key", "first_host").withColumnRenamed("line", "first_line")
    owned = found.join(first, found["host_key"].eqNullSafe(first["first_host"]) & (found["line"] == first["first_line"])).withColumn("own", F.col("text_hash") == F.col("first_hash"))
    removed = owned.groupBy("row_id").agg(F.sum("words").alias("all_words"), F.sum(F.when(F.col("own"), 0).otherwise(F.col("words"))).alias("other_words"), F.collect_list("line").alias("all_lines"), F.collect_list(F.when(~F.col("own"), F.col("line"))).alias("other_lines"))
    least = min_left * F.col("n_words")
    returned = (F.col("n_words") - F.col("all_words") < least) & (F.col("n_words") - F.col("other_words") >= least)
    joined = described.drop("lines").join(removed, "row_id", "left")
    joined = joined.withColumn("removed_words", F.coalesce(F.when(returned, F.col("other_words")).otherwise(F.col("all_words")), F.lit(0)).cast("long")).withColumn("removed_lines", F.when(returned, F.col("other_lines")).otherwise(F.col("all_lines"))).drop("all_words", "other_words", "all_lines", "other_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & (F.col("n_words") - F.col("removed_words") < least)
    return joined.withColumn("base_failed", failed).withColumn("depleted", depleted).withColumn("kept", ~failed & ~depleted).drop("row_id")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", length_col: str = "n_chars", **limits) -> DataFrame:
    """docs without rejected rows; removed lines are gone from the texts. Columns stay as they are."""
    id_, host, hash_, gone, text = fresh(docs, "__id", "__host", "__hash", "__gone", "__text")
    verdicts = judge(docs, id_col, text_col, host_col, **limits).where("kept").select(F.col("doc_id").alias(id_), F.col("host").alias(host), F.col("text_hash").alias(hash_), F.coalesce("removed_lines", F.array().cast("array<long>")).alias(gone)).dropDuplicates([id_, host, hash_])
    same = docs[id_col].cast("long").eqNullSafe(verdicts[id_]) & docs[host_col].cast("string").eqNullSafe(verdicts[host]) & (F.xxhash64(docs[text_col]) == verdicts[hash_])
    joined = docs.join(verdicts, same)

    @F.pandas_udf("string")
    def without(texts, gone):
        import pandas as pd

        out = []
        for t, g in zip(texts, gone, strict=True):
            hashes = set() if t is None or g is None else set(g)
            out.append("\n".join(x for x in t.split("\n") if not x.split() or line_hash(x.encode()) not in hashes) if hashes else t)
        return pd.Series(out, dtype=object)

    changed = joined.withColumn(text, F.when(F.size(gone) > 0, without(text_col, gone)).otherwise(F.col(text_col)))
    columns = [F.col(text).alias(c) if c == text_col else F.when(F.size(gone) > 0, F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(c) for c in docs.columns]
    return changed.select(*columns)
