"""Exact top-k inner products by vector-approximation files.

Every task turns the vectors it reads into an approximation file: each component's
range is cut into ``CELLS`` cells, and a vector is kept as its cells' numbers. For a
query, cells bound the score from above and below. Vectors whose upper bound is under
the k-th best lower bound are out; the others' exact scores are read in the order
of upper bounds until no bound can reach the k-th result. A task goes on with its best k of each query from
file to file, so what earlier files gave prunes later ones, and reports k rows for each query;
a grouping keeps the best k of them.

Queries are sent to the tasks in blocks of about ``QUERY_BLOCK`` vectors, so a broadcast and what the driver holds
are bounded whatever the number of queries; each block scans the table once and is written before the next is read.

Components are floor(256 * x). Bounds and scores are whole numbers below 2**53, so
double arithmetic is exact; vectors that could exceed this are scored in Python's integers.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; vectors of different lengths are not compared; equal scores
rank by smaller id; repeated ids are ranked each on its own, but never against their own id;
null ids take no part; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofold.llm.common import mapped, stash

SCALE = 256
CELLS = 64
QUERY_BLOCK = 8192
#: Vectors of one approximation file.
FILE_ROWS = 16_384
#: Queries whose bounds are held at a time.
STEP = 256
EXACT = 1 << 52


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.col("v").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    chosen = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v")).where(usable).where(finite)
    return chosen.select("vec_id", F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


class ApproximationFile:
    """Cells of a set of equally long integer vectors, and what they tell of scores."""

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        self.exact = vectors
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum(-(-(high - low + 1) // cells), 1)
        self.cell = ((vectors - low) // width).astype(np.uint8 if cells <= 256 else np.uint16)
        self.low, self.width = low.astype(float), width.astype(float)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores: a cell holds width whole numbers from its lowest one on."""
        scaled = queries * self.width
        base = scaled @ self.cell.T.astype(float) + (queries @ self.low)[:, None]
        reach = queries * (self.width - 1)
        return base + np.minimum(reach, 0).sum(axis=1)[:, None], base + np.maximum(reach, 0).sum(axis=1)[:, None]

    def top(self, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> None:
        """Puts each query's better vectors into its list in ``best``: (-score, vec_id) of the k best so far, sorted."""
        for at in range(0, len(queries), STEP):
            q, q_ids = queries[at : at + STEP], query_ids[at : at + STEP]
            lower, upper = self.bounds(q.astype(float))
            own = ids[None, :] == q_ids[:, None]
            lower[own], upper[own] = -np.inf, -np.inf
            n = min(k, len(ids))
            sure = np.partition(lower, len(ids) - n, axis=1)[:, len(ids) - n]
            held = np.array([-b[-1][0] if len(b) == k else -np.inf for b in best[at : at + STEP]])
            sure = np.maximum(sure, held)  # what earlier files gave prunes this one
            for i in range(len(q)):
                near = np.flatnonzero((upper[i] >= sure[i]) & (upper[i] > -np.inf))
                if len(near):
                    best[at + i] = self._read(ids, q[i], near[np.argsort(-upper[i][near], kind="stable")], upper[i], k, best[at + i])

    def _read(self, ids, query, order, upper, k, best) -> list[tuple[int, int]]:
        """Exact scores in the order of bounds, in growing steps, until the k-th is certain."""
        at, step = 0, 2 * k
        while at < len(order) and (len(best) < k or upper[order[at]] >= -best[-1][0]):
            part = order[at : at + step]
            scores = self.exact[part] @ query
            best = sorted([*best, *zip(map(int, -scores), map(int, ids[part]), strict=True)])[:k]
            at, step = at + step, 2 * step
        return best


def _plain_top(ids, vectors, query_ids, queries, k, best) -> None:
    """For numbers beyond double arithmetic; scores outside a long are held at its ends."""
    rows = [[int(x) for x in v] for v in vectors]
    for n, (q_id, q) in enumerate(zip(query_ids, queries, strict=True)):
        q = [int(x) for x in q]
        scored = ((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))), int(i)) for i, v in zip(ids, rows, strict=True) if i != q_id)
        best[n] = sorted([*best[n], *scored])[:k]


def _by_length(ids: list[int], vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        groups.setdefault(len(v), []).append(i)
    return {n: (np.array([ids[i] for i in at], np.int64), np.array([vectors[i] for i in at], np.int64)) for n, at in groups.items()}


def _scan(candidates: DataFrame, block, k: int) -> DataFrame:
    """Each task's best k for one block of queries. block: a broadcast of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: [[] for _ in q_ids] for n, (q_ids, _) in block.value.items()}

        def read(ids: list, vectors: list) -> None:
            for n, (own_ids, own) in _by_length(ids, vectors).items():
                if n in block.value:
                    q_ids, q = block.value[n]
                    most = max(int(abs(own).max()), 1) * max(int(abs(q).max()), 1) * n * 4
                    if most < EXACT and min(own.min(), q.min()) > -(1 << 62):
                        ApproximationFile(own).top(own_ids, q_ids, q, k, best[n])
                    else:
                        _plain_top(own_ids, own, q_ids, q, k, best[n])

        ids, vectors = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            lists = b.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(np.r_[0, np.cumsum([len(x) for x in lists])]).cumsum()
            vectors += np.split(flat, ends[:-1]) if len(ends) else []
            while len(ids) >= FILE_ROWS:
                read(ids[:FILE_ROWS], vectors[:FILE_ROWS])
                ids, vectors = ids[FILE_ROWS:], vectors[FILE_ROWS:]
        if ids:
            read(ids, vectors)
        for n, found in best.items():
            out = [(int(q), v, -s) for q, own in zip(block.value[n][0], found, strict=True) for s, v in own]
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return mapped(candidates, run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector where ``is_query`` holds (a Column over vec_id) the best k others."""
    rows = whole(vectors, id_col, vector_col)
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // query_block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = []
    for b in range(blocks):
        # hash blocks: about query_block rows each, one at a time on the driver
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        sent = vectors.sparkSession.sparkContext.broadcast(_by_length([r["vec_id"] for r in block], [r["v"] for r in block]))
        ranked = _scan(rows, sent, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if blocks > 1:
            ranked = stash(ranked, "topk")
            sent.destroy()
        found.append(ranked)
    return reduce(DataFrame.unionByName, found).select("query_id", "rank", "vec_id", "score")
