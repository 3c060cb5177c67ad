"""SimHash near-duplicate groups, with candidates found by pigeonring filtering.

A fingerprint's 64 bits form a ring of five segments. If two fingerprints differ
in at most four bits, then from some segment on, the differences summed over the
first l segments stay within l * 4/5 for every l (budgets 0, 1, 2, 3, 4). So they
agree in that segment and differ in at most one bit of the next. A fingerprint is
dealt out under 15 keys: one segment with two thirds of the next one. Under a key,
a candidate must keep the whole chain of budgets before the full Hamming check.

Equal fingerprints are one node. A key's linked nodes are reported as a spanning
forest, never as all pairs, so rows stay linear in the documents. Keys with very
many nodes are split into pairs of blocks, which cover the same pairs.

Defined cases: null and empty texts have fingerprint zero and link like any other;
fewer words than a shingle give one shingle of all words; repeated rows keep their
rows and share a component; a null id never becomes a component's id unless
the component has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm.common import fresh, mapped, stash, text_bytes
from geofold.operators.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = (13, 13, 13, 13, 12)
#: Nodes under one key before the key is split into blocks.
BLOCK = 50_000


def shingle_hashes(data: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest

    w = data.lower().split()
    if not w:
        return np.zeros(0, "<u8")
    if len(w) <= words:
        return np.array([xxh64_intdigest(b" ".join(w), SEED)], "<u8")
    parts = zip(*(w[i:] for i in range(words)), strict=False)
    return np.fromiter((xxh64_intdigest(b" ".join(p), SEED) for p in parts), "<u8", len(w) - words + 1)


def fingerprint(data: bytes, words: int = SHINGLE_WORDS) -> int:
    h = shingle_hashes(data, words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_000):
        part = h[i : i + 65_000]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long, text_hash long) for each row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, words) for x in text_bytes(b.column(1))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], ["doc_id", "fp", "text_hash"])

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    return mapped(chosen, run, "doc_id long, fp long, text_hash long")


def _keys():
    """The 15 keys of column fp as an array; the upper bits tell segment and third."""
    out, at = [], 0
    for i, width in enumerate(SEGMENTS):
        following = SEGMENTS[(i + 1) % len(SEGMENTS)]
        turned = F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp")
        head = F.shiftrightunsigned(turned, 64 - width - following)
        cuts = [0, following // 3, 2 * following // 3, following]
        for t in range(3):
            hole = (1 << cuts[t + 1]) - (1 << cuts[t])
            kept = ((1 << (width + following)) - 1) & ~hole
            out.append(head.bitwiseAND(F.lit(kept).cast("long")).bitwiseOR(F.lit((3 * i + t) << 32).cast("long")))
        at += width
    return F.array(*out)


def chained(x: np.ndarray, segment: np.ndarray | int) -> np.ndarray:
    """Whether differences x keep the chain of budgets from a segment on, the whole ring's limit included."""
    starts = np.concatenate([[0], np.cumsum(SEGMENTS)[:-1]]).astype(np.uint64)
    at = starts[segment]
    r = (x << at) | np.where(at > 0, x >> ((np.uint64(64) - at) & np.uint64(63)), np.uint64(0))
    lengths = np.array([np.cumsum(np.roll(SEGMENTS, -i)) for i in range(len(SEGMENTS))], np.uint64)
    ok = np.ones(np.shape(x), bool)
    for step in range(len(SEGMENTS)):
        budget = (step + 1) * MAX_BITS // len(SEGMENTS)
        ok &= np.bitwise_count(r >> (np.uint64(64) - lengths[segment, step])) <= budget
    return ok


def forest(fps: np.ndarray, segment: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that join the fingerprints linked under a key; each node is reached once."""
    left, right = [], []
    while len(fps):
        frontier, fps = [fps[0]], fps[1:]
        while frontier and len(fps):
            f = frontier.pop()
            hit = chained(fps ^ f, segment)
            if hit.any():
                got = fps[hit]
                left.append(np.full(len(got), f, np.uint64))
                right.append(got)
                frontier += list(got)
                fps = fps[~hit]
    return left, right


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, cell): edges among those of equal key and cell."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def edges(key, cell, fp):
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        left, right = [], []
        segments = (key >> 32) // 3
        small = np.repeat(sizes <= 8, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        for d in range(1, min(8, int(sizes.max()))):
            i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
            i = i[chained(fp[i] ^ fp[i + d], segments[i])]
            left.append(fp[i])
            right.append(fp[i + d])
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            a, b = forest(fp[s : s + n], int(segments[s]))
            left += a
            right += b
        if not left:
            return None
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def joined():
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for batch in batches:
        if not len(batch):
            continue
        part = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        part = (part[0], part[1], part[2].astype(np.int64).view(np.uint64))
        if held and (part[0][-1], part[1][-1]) == (held[0][0][0], held[0][1][0]):
            held.append(part)
            continue
        held.append(part)
        key, cell, fp = joined()
        cut = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if (key[0], cell[0]) != (key[-1], cell[-1]) else 0
        held = [(key[cut:], cell[cut:], fp[cut:])]
        if cut and (out := edges(key[:cut], cell[:cut], fp[:cut])) is not None:
            yield out
    if held and (out := edges(*joined())) is not None:
        yield out


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` within 4 bits."""
    dealt = nodes.select("fp", F.explode(_keys()).alias("key"))
    hot = dealt.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (F.least(x, own) * F.col("blocks") + F.greatest(x, own)).cast("long"))
    )
    rows = dealt.join(hot, "key", "left").select("key", F.explode(cells).alias("cell"), "fp")
    return mapped(rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "fp"), _link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash) for each row of docs."""
    fp = stash(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    nodes = stash(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), block))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # written, so that a root with very many nodes is a skewed join's key that Spark can split
    ids = stash(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-ids")
    labels = stash(named.join(ids, "root").select(F.col("fp").alias("node_fp"), "component_id"), "simhash-labels")
    return fp.join(labels, fp["fp"] == labels["node_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest id, null ids last."""
    labels = near_duplicates(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    # a group without any id has a null component_id: its fingerprint tells it apart
    group = F.coalesce(F.col("component_id").cast("string"), "fingerprint")
    first = labels.groupBy(group.alias("group")).agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    same = docs[id_col].cast("long").eqNullSafe(first["kept_id"]) & (F.xxhash64(docs[text_col]) == first["kept_hash"])
    (text_hash,) = fresh(docs, "__text_hash")
    return docs.join(first, same, "left_semi").withColumn(text_hash, F.xxhash64(text_col)).dropDuplicates([id_col, text_hash]).drop(text_hash)
