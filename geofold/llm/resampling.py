"""Importance resampling towards a target corpus, by hashed n-grams that suffix arrays of word ids enumerate.

Features are all runs of 1 to ``max_n`` consecutive words of a text, each in a bucket by its CRC-32. How much more
often a bucket occurs in the target than in the corpus is its gain; a document's weight is the sum of gains over its
features, its score the weight and a Gumbel number drawn from its id, so that the highest scores are a sample without
replacement in proportion to exp(weight).

A partition is read in blocks of at most ``BLOCK`` words. A block's words get ids; its suffixes, sorted by their first
``max_n`` ids, are its suffix array. Neighbours with a common prefix of n words or more (their LCP) form a run, all
occurrences of one n-gram. A run is hashed once, from the checksum of its first n - 1 words' run, and its bucket is
scattered back to the places of its suffixes. Nothing is kept by n-gram: a first pass sums ``buckets`` counts, a second
one gives each document its sum of gains, and no text is shuffled. The one global order, by score, sorts ranges apart.

Defined cases: null texts have no words; texts without words have weight 0 and no rank, like all with fewer than
``least_words``; very long texts are cut between blocks, whose n-grams reach into the next one; a null id counts as the
empty text in the draw and comes after others in ties; repeated rows are counted, weighted and drawn each on their own;
without a target, or with an empty one, its counts are 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofold.llm import checksum
from geofold.llm.common import mapped, stash
from geofold.llm.words import LOWER, Words, fast_order, flat
from geofold.operators.ordering import numbered

BUCKETS, MAX_N, LEAST_WORDS, SEED = 10_000, 3, 20, 42
#: Drawn documents of those long enough: so many of so many.
SHARE = (5, 100)
#: Words of a block.
BLOCK = 1 << 19

#: Letters a to z, digits, and all beyond ASCII; A to Z are lower-cased first.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class SuffixArray:
    """Suffixes of a sequence of word ids in the order of their first ``depth`` ids; a suffix ends with its text.

    ``order`` are the places in this order; ``lcp`` are the ids, up to depth, that each has in common with the one before it;
    ``room`` are the ids from each place to its text's end, up to depth.
    """

    def __init__(self, ids: np.ndarray, left: np.ndarray, depth: int):
        n = len(ids)
        self.room = np.minimum(left, depth)
        after = [ids, *(np.where(left > k, np.r_[ids[k:], np.zeros(min(k, n), ids.dtype)], -1) for k in range(1, depth))]
        many = np.uint64(int(ids.max(initial=0)) + 2)
        rank = ids.astype(np.uint64)
        self.order = fast_order(rank) if depth == 1 else None
        for k in range(1, depth):  # ranks by k ids and the next id: ranks by k + 1
            key = rank * many + (after[k] + 1).astype(np.uint64)
            self.order = fast_order(key)
            own = key[self.order]
            rank = np.empty(n, np.uint64)
            rank[self.order] = np.cumsum(np.r_[False, own[1:] != own[:-1]][:n], dtype=np.uint64)
        self.lcp = np.zeros(n, np.int64)
        same = np.ones(max(0, n - 1), bool)
        for own in after:
            own = own[self.order]
            same &= (own[1:] == own[:-1]) & (own[1:] >= 0)
            self.lcp[1:] += same

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, run of each, first place of each run) of the suffixes of n ids or more."""
        has = self.room[self.order] >= n
        places, opens = self.order[has], (self.lcp < n)[has]
        return places, np.cumsum(opens) - 1, places[opens]


def buckets_of(words: Words, max_n: int, buckets: int, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first word, room, buckets by n) for each block of words: the bucket of the n-gram that starts at each word with room for it, 0 at others."""
    data = LOWER[words.data]
    raw, hashes = data.tobytes(), words.hashes(LOWER)
    left = np.repeat(words.upto[1:], words.counts) - np.arange(len(words))
    for a in range(0, len(words), block):
        z = min(a + block, len(words))
        reach = min(z + max_n - 1, len(words))
        distinct, example, ids = np.unique(hashes[a:reach], return_index=True, return_inverse=True)
        start, stop = words.start[a + example], words.stop[a + example]
        single, size = checksum.of_slices(raw, start, stop), stop - start + 1
        spaced = checksum.appended(np.full(len(single), crc32(b" "), np.uint32), single, size - 1)
        suffixes = SuffixArray(ids, np.minimum(left[a:reach], reach - a - np.arange(reach - a)), max_n)
        crc, out = single[ids], []
        for n in range(1, max_n + 1):
            places, run, first = suffixes.runs(n)
            if n > 1:
                last = ids[first + n - 1]
                now = checksum.appended(crc[first], spaced[last], size[last])
                crc[places] = now[run]
            bucket = np.zeros(reach - a, np.int64)
            bucket[places] = crc[places] % np.uint32(buckets)
            out.append(bucket[: z - a])
        yield a, suffixes.room[: z - a], out


def bucket_counts(docs: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts lie in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, room, parts in buckets_of(Words(*flat(b.column(0)), KINDS), max_n, buckets):
                for n, own in enumerate(parts, 1):
                    total += np.bincount(own[room >= n], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])

    return mapped(docs.select(docs[text_col].cast("string").alias("text")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from (bucket, n) of both: floor(1000 ln(share in the target / share in the corpus)), all counts one more."""
    own, other = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    rows = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left").join(other, "bucket", "left").na.fill(0, ["s", "t"])
    sums = rows.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * (F.col("all_s") + buckets)) / ((s + 1) * (F.col("all_t") + buckets))
    return rows.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_n: int = MAX_N) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; gain: of each bucket."""
    buckets = len(gain)
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in batches:
            words = Words(*flat(b.column(1)), KINDS)
            n = words.counts
            weight = np.zeros(len(n), np.int64)
            text = np.repeat(np.arange(len(n)), n)
            for a, room, parts in buckets_of(words, max_n, buckets):
                own = sum(np.where(room >= k, gain[x], 0) for k, x in enumerate(parts, 1))
                at = text[a : a + len(room)]
                heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                weight[at[heads]] += np.add.reduceat(own, heads)
            features = sum(np.maximum(n - k, 0) for k in range(max_n))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return mapped(chosen, run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(column: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for a u in (0, 1) from the hash of the seed and an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; rank, from 1, of the drawn ones only."""
    own, other = (stash(bucket_counts(d, c, max_n, buckets), "resampling-buckets") for d, c in ((docs, text_col), (target, target_text_col)))
    found = gains(own, other, buckets).toPandas()  # one row for each bucket
    gain = np.zeros(buckets, np.int64)
    gain[found["bucket"].to_numpy()] = found["gain"].to_numpy()
    rows = stash(weights(docs, gain, id_col, text_col, max_n).withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "resampling-weights")
    long = rows.where(F.col("n_words") >= least_words)
    draws = long.count() * share[0] // share[1]
    ranked = long.withColumns({"__last": F.col("doc_id").isNull(), "__down": -F.col("score")})
    ranked = numbered(ranked, ["__down", "__last", "doc_id", "n_features", "weight"], "__n").withColumn("rank", F.when(F.col("__n") < draws, F.col("__n") + 1))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(columns))
