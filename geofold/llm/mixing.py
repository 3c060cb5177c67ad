"""Mixing sources to target weights by blocks, multinomial shard counts and index permutations.

1. A source's words stand in one line, documents in the order of their ids' hashes.
   The line is packed into blocks of ``BLOCK_WORDS`` words.
2. Targets: sources, in order, weigh 5, 2, 1, repeating; their shares of the mix stop at
   ``MAX_EPOCHS`` times the source, and what is over goes to the others by weight.
3. Every output shard draws how many blocks it takes from each source from a
   multinomial whose chances are what the sources' targets still lack, so all shards
   together meet the targets.
4. A source's draws are numbered through all shards. Draw j of a source with n blocks
   takes block perm(j mod n), where perm is a keyed pseudorandom permutation of the
   indexes; no block comes up a second time before all have come up once.
5. Draws join the documents' pieces by (source, block index).

Places in a line are sums over groups of hash ranges of a source, then over ranges, then inside a range, so
a source with a third of all rows is spread over many tasks.

Defined cases: null texts have no words and are not taken; null sources are one
source, ordered last; equal rows are placed each on its own; a source without
words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofold.llm.common import JAVA_WORD, bounded, fresh, mapped, stash

BLOCK_WORDS = 256
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SHARDS = 256
SEED = 7
#: The table of sources is broadcast up to this many rows; beyond, its joins shuffle.
FEW_SOURCES = 50_000
#: Rows that one window orders, about.
RANGE_ROWS = 250
#: Draws that one task makes, about, until there is a task for each shard.
DRAWS_TOGETHER = 50_000
#: Ranges whose starts one window sums.
RANGES_TOGETHER = 1_000


def _sent(names: DataFrame, sources: list[dict]) -> DataFrame:
    return F.broadcast(names) if len(sources) <= FEW_SOURCES else names


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Words to take from each source (in the sources' order)."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total_share * sum(sizes)
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = {i for i in open_ if unit * w[i] >= max_epochs * sizes[i]}
        for i in over:
            out[i] = float(max_epochs * sizes[i])
            left -= out[i]
        open_ -= over
        if not over:
            for i in open_:
                out[i] = unit * w[i]
            break
    return out


def shard_counts(wanted: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Blocks that each shard (rows) draws from each source (columns); columns sum to what is wanted."""
    rng = np.random.default_rng(seed)
    left = np.array(wanted, np.int64)
    out = np.zeros((shards, len(wanted)), np.int64)
    for s in range(shards):
        n = left.sum() - left.sum() * (shards - s - 1) // (shards - s)
        drawn = rng.multinomial(n, left / left.sum()) if n else np.zeros(len(wanted), np.int64)
        drawn = np.minimum(drawn, left)
        while short := n - drawn.sum():  # a source that has too few left passes draws on
            rest = left - drawn
            drawn = np.minimum(drawn + rng.multinomial(short, rest / rest.sum()), left)
        out[s], left = drawn, left - drawn
    return out


def _network(n: int, key: int) -> tuple[np.uint64, np.ndarray]:
    """Bits of half a number and the rounds' keys of the permutation of 0..n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    return np.uint64(half), np.random.default_rng([key, n & 0xFFFFFFFF]).integers(1, 1 << 62, 4, dtype=np.uint64)


def _round(right: np.ndarray, k: np.uint64, mask: np.uint64) -> np.ndarray:
    mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)) & mask


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1 at the given indexes, or its inverse: a four-round Feistel network, walked until inside."""
    half, keys = _network(n, key)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & mask
        for k in keys[::-1] if back else keys:
            left, right = (right ^ _round(left, k, mask), left) if back else (right, left ^ _round(right, k, mask))
        x[todo] = (left << half) | right
        todo = x >= n
    return x.astype(np.int64)


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row_id, doc_id, source, size, start): every row's place in its source's line of words. A written table."""
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(JAVA_WORD)), F.lit(0)).cast("long")
    rows = stash(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), size.alias("size"), F.xxhash64(docs[id_col], docs[text_col]).alias("h"), F.xxhash64(docs[id_col].cast("string"), docs[source_col].cast("string"), docs[text_col]).alias("key"), F.monotonically_increasing_id().alias("row_id")), "mix-sizes")
    ranges = max(1, rows.count() // RANGE_ROWS)
    cut = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * ranges)
    rows = rows.withColumn("range", F.least(cut, F.lit(ranges - 1)).cast("long")).withColumn("s", F.xxhash64("source"))
    sums = rows.groupBy("s", "range").agg(F.sum("size").alias("words")).withColumn("many", F.floor(F.col("range") / RANGES_TOGETHER))
    earlier = lambda keys, order: F.coalesce(F.sum("words").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = sums.groupBy("s", "many").agg(F.sum("words").alias("words")).select("s", "many", earlier(["s"], "many").alias("base"))
    fine = sums.select("s", "many", "range", earlier(["s", "many"], "range").alias("from"))
    starts = fine.join(coarse, ["s", "many"]).select("s", "range", (F.col("base") + F.col("from")).alias("from"))
    inside = Window.partitionBy("s", "range").orderBy("h", "doc_id", "row_id")
    line = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return stash(line.join(starts, ["s", "range"]).select("row_id", "doc_id", "source", "size", "key", (F.col("from") + F.col("upto") - F.col("size")).alias("start")), "mix-places")


def plan(places: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, max_epochs=MAX_EPOCHS, block_words=BLOCK_WORDS) -> list[dict]:
    """For each source, in order: name, size, target, blocks and draws. The driver holds one row and SHARDS counts for each source."""
    found = places.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    out = []
    for r, target in zip(found, targets([r["size"] for r in found], weights, total_share, max_epochs), strict=True):
        blocks = -(-r["size"] // block_words)
        out.append({"source": r["source"], "size": r["size"], "target": target, "blocks": blocks, "draws": min(max_epochs * blocks, -(-int(target) // block_words) + 2) if target >= 1 else 0})
    return out


def draws(spark, sources: list[dict], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, source_no, draw, block): the block that each draw takes."""
    counts = shard_counts([s["draws"] for s in sources], shards, seed)
    first = np.cumsum(counts, axis=0) - counts
    rows = [(s, i, int(first[s, i]), int(counts[s, i])) for s in range(shards) for i in range(len(sources)) if counts[s, i]]
    blocks = [s["blocks"] for s in sources]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, source, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at in range(start, start + n, 100_000):
                    j = np.arange(at, min(at + 100_000, start + n))
                    block = permuted(j % blocks[source], blocks[source], seed * 1_000_003 + source)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), shard, np.int32)), pa.array(np.full(len(j), source, np.int32)), pa.array(j), pa.array(block)], ["shard", "source_no", "draw", "block"])

    given = spark.createDataFrame(rows, "shard int, source_no int, first long, n long").repartition(max(1, min(shards, sum(r[3] for r in rows) // DRAWS_TOGETHER)), "shard")
    return mapped(given, run, "shard int, source_no int, draw long, block long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Pieces of the mix, places of the documents, and the plan.

    Pieces: (shard, source_no, draw, block, row_id, doc_id, first_word, words): words of a document that
    a draw takes. A source's draws end at its target: the last ones are cut short.
    """
    spark = docs.sparkSession
    places = placed(docs, id_col, text_col, source_col)
    sources = plan(places, weights, total_share, max_epochs, block_words)
    if not any(s["draws"] for s in sources):
        none = places.where("false").select(F.lit(0).alias("shard"), F.lit(0).alias("source_no"), F.lit(0).cast("long").alias("draw"), F.lit(0).cast("long").alias("block"), "row_id", "doc_id", F.col("start").alias("first_word"), F.col("size").alias("words"))
        return none, places, sources
    names = spark.createDataFrame([(i, s["source"], s["blocks"], s["size"], int(s["target"]), _turn_of(s, i, seed)) for i, s in enumerate(sources)], "source_no int, name string, blocks long, source_words long, target_words long, last_at long")
    own = places.where("size > 0").join(_sent(names, sources), places["source"].eqNullSafe(names["name"]))
    spans = own.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))).select(
        "source_no", "block", "row_id", "doc_id", "start",
        F.greatest("start", F.col("block") * block_words).alias("from"),
        F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words).alias("to"),
    )
    taken = draws(spark, sources, shards, seed)
    # draw j of a source: words before it, if only the source's last block is short
    n = F.col("blocks")
    short = n * block_words - F.col("source_words")
    passed = F.floor(F.col("draw") / n) + (F.col("draw") % n > F.col("last_at")).cast("long")
    allowed = F.col("target_words") - (F.col("draw") * block_words - passed * short)
    room = taken.join(_sent(names.drop("name"), sources), "source_no").withColumn("allowed", allowed).where("allowed > 0").select("shard", "source_no", "draw", "block", "allowed")
    joined = room.join(spans, ["source_no", "block"])
    end = F.least(F.col("to"), F.col("block") * block_words + F.col("allowed"))
    pieces = joined.withColumn("words", end - F.col("from")).where("words > 0")
    return pieces.select("shard", "source_no", "draw", "block", "row_id", "doc_id", (F.col("from") - F.col("start")).alias("first_word"), "words"), places, sources


def _turn_of(source: dict, number: int, seed: int) -> int:
    """In which draw of a round the source's short last block comes up."""
    n = source["blocks"]
    return int(permuted(np.array([n - 1]), n, seed * 1_000_003 + number, back=True)[0]) if n else 0


def digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    pieces, places, sources = mix(docs, **options)
    spark = docs.sparkSession
    names = spark.createDataFrame([(s["source"], s["size"], s["target"]) for s in sources], "name string, source_size long, target double")
    taken = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"))
    joined = places.join(taken, "row_id", "left")
    return joined.join(_sent(names, sources), joined["source"].eqNullSafe(names["name"])).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **options) -> DataFrame:
    """The documents that the mix takes, in the columns of docs, each with the text it gives.

    A document taken whole and once keeps its text. Else its text is what is taken at least
    once, then what is taken a second time; words not taken are gone. Equal rows become one.
    """
    key = lambda a, b, c: F.xxhash64(a.cast("string"), b.cast("string"), c)
    own_key, mix_key, spans_of, text = fresh(docs, "__key", "__mix_key", "__spans", "__text")
    pieces, places, _ = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    own = docs.withColumn(own_key, key(docs[id_col], docs[source_col], docs[text_col])).dropDuplicates([own_key])
    text_of = places.select("row_id", F.col("key").alias(mix_key))
    spans = pieces.join(text_of, "row_id").groupBy(mix_key).agg(F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias(spans_of))
    joined = own.join(spans, own[own_key] == spans[mix_key])

    @F.pandas_udf("string")
    def cut(texts, all_spans):
        import pandas as pd

        return pd.Series([taken_text(t, [(x["first_word"], x["words"]) for x in s]) for t, s in zip(texts, all_spans, strict=True)], dtype=object)

    bounded(docs.sparkSession)
    changed = joined.withColumn(text, cut(text_col, spans_of))
    columns = [F.col(text).alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(c) for c in docs.columns]
    return changed.select(*columns)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def taken_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The runs of words that spans (first word, words) cover once, then those covered again and again."""
    at = [m.span() for m in _WORD.finditer(text)]
    cover = np.zeros(len(at) + 1, np.int64)
    for first, n in spans:
        cover[first] += 1
        cover[first + n] -= 1
    cover = np.cumsum(cover)[:-1]
    out = []
    for turn in range(1, int(cover.max(initial=0)) + 1):
        edges = np.flatnonzero(np.diff(np.r_[0, (cover >= turn).astype(np.int8), 0]))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            out.append(text if b - a == len(at) else text[at[a][0] : at[b - 1][1]])
    return "\n".join(out)
