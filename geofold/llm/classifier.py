"""Quality classifier: random-indexing word vectors, pooled, then a small calibrated network.

Every document has a sparse random index vector (a few +1 and -1, drawn from its text's hash). A
word's vector is the sum of the index vectors of all documents that hold it, scaled to length 1. Words are runs of
letters and digits, and runs of punctuation, as they are written; they are hashed
into ``ROWS`` rows, so the table's size doesn't depend on the corpus, and rare words share rows. A document's
features are its word vectors pooled: their mean, their spread and the correlation of neighbouring ones, each by component. A
two-layer numpy network learns the labels from these alone; its logits are divided by a temperature fitted on labelled rows that it
wasn't trained on.

The table covers every document: tasks hand out compressed blocks of partial sums (whole
numbers of 64 bits, so any order gives the same), which are added in two levels. The network is fitted on
at most ``MAX_LABELLED`` labelled rows, those of the smallest hashes of ids. What the driver
holds is the table (8 MB as it is sent) and that sample's features.

Defined cases: null and empty texts have zero features and get a score; very long texts are pooled in steps; labels that are null or
repeat for a document are averaged (1 from one half on); without labels of both classes every score is
the share of label 1, or 0.5 without any label; repeated rows get equal scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm.common import doc_crc, mapped
from geofold.llm.words import LETTERS, Words, distinct_sorted, words_of

ROWS = 1 << 16
DIM = 32
ONES = 8
BLOCK = 4096
#: Labelled rows that the network is fitted on, at most.
MAX_LABELLED = 20_000
HIDDEN = 32
EPOCHS = 60
#: Tasks whose sums are added by one task of the first level.
FAN_IN = 64
#: Words pooled at a time.
STEP = 1 << 15
#: Keeps correlations of words that hardly differ near 0.
LEAST_SPREAD = 1e-4


def rows_of(words: Words) -> np.ndarray:
    """Table row of each word."""
    return (words.hashes() % np.uint64(ROWS)).astype(np.int64)


def index_vectors(words: Words) -> np.ndarray:
    """A sparse vector for each text, drawn from its bytes."""
    from xxhash import xxh64_intdigest

    data = memoryview(words.data.tobytes())
    n = len(words.ends) - 1
    h = np.array([xxh64_intdigest(data[a:z]) for a, z in zip(words.ends[:-1], words.ends[1:], strict=True)], np.uint64)
    out = np.zeros((n, DIM), np.int16)
    for i in range(ONES):
        np.add.at(out, (np.arange(n), ((h >> np.uint64(5 * i)) % np.uint64(DIM)).astype(np.int64)), 1 if i % 2 else -1)
    return out


def add_index_vectors(total: np.ndarray, words: Words) -> None:
    """Adds each text's index vector to the rows of its distinct words."""
    n = len(words.ends) - 1
    pairs = distinct_sorted(rows_of(words) * n + np.repeat(np.arange(n), words.counts))
    if not len(pairs):
        return
    vectors = index_vectors(words)
    for at in range(0, len(pairs), STEP):
        row, text = np.divmod(pairs[at : at + STEP], n)
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        total[row[heads]] += np.add.reduceat(vectors[text], heads, axis=0, dtype=np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """ROWS x DIM whole numbers over all documents."""
    schema = "block int, part int, sums binary"
    names = ["block", "part", "sums"]

    def blob(keys: list[tuple[int, int]], sums: list[np.ndarray]) -> pa.RecordBatch:
        data = [pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True) for x in sums]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(data, pa.binary())], names)

    def opened(data: bytes) -> np.ndarray:
        planes = np.frombuffer(pa.decompress(data, 8 * BLOCK * DIM, "zstd"), np.uint8).reshape(8, -1)
        return np.ascontiguousarray(planes.T).view("<i8")[:, 0].reshape(BLOCK, DIM)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((ROWS, DIM), np.int64)
        for b in batches:
            add_index_vectors(total, words_of(b.column(0), LETTERS))
        part = TaskContext.get().partitionId() // FAN_IN
        for i in range(ROWS // BLOCK):
            own = total[i * BLOCK : (i + 1) * BLOCK]
            if own.any():
                yield blob([(i, part)], [own])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for block, part, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums[block, part] = opened(data) + sums.get((block, part), 0)
        for key, x in sums.items():
            yield blob([key], [x])

    counted = mapped(docs.select(docs[text_col].alias("text")), count, schema)
    first = mapped(counted.repartition("block", "part"), add, schema)
    second = mapped(first.withColumn("part", F.lit(0)).repartition("block"), add, schema)
    table = np.zeros((ROWS, DIM), np.int64)
    for r in second.collect():  # one row for each of the table's ROWS / BLOCK blocks
        table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += opened(r["sums"])
    return table


def features(words: Words, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and neighbours' correlation of each text's word vectors. Sums of 64 bits, so steps don't show."""
    n = len(words.ends) - 1
    counts = words.counts
    text = np.repeat(np.arange(n), counts)
    rows = rows_of(words)
    one, two, both = (np.zeros((n, DIM)) for _ in range(3))
    for at in range(0, len(rows), STEP):
        v = vectors[rows[at : at + STEP + 1]]
        own = text[at : at + STEP + 1]
        step = min(STEP, len(rows) - at)
        heads = np.flatnonzero(np.r_[True, own[1:step] != own[: step - 1]])
        add = lambda x: np.add.reduceat(x, heads, axis=0, dtype=np.float64)  # noqa: B023, E731
        one[own[heads]] += add(v[:step])
        two[own[heads]] += add(v[:step] ** 2)
        next_ = np.zeros((step, DIM), np.float32)
        m = len(v) - 1
        next_[:m] = v[:m] * v[1:] * (own[1:] == own[:-1])[:, None]
        both[own[heads]] += add(next_)
    c = np.maximum(counts, 1)[:, None]
    mean = one / c
    spread = np.maximum(two / c - mean**2, 0)
    near = np.where(counts[:, None] > 1, (both / np.maximum(counts - 1, 1)[:, None] - mean**2) / (spread + LEAST_SPREAD), 0)
    return np.hstack([mean, np.sqrt(spread), near])


class Network:
    """One hidden layer of tanh units, one logit; Adam on the mean cross-entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 3):
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.default_rng(seed)
        held = rng.random(len(y)) < 0.2
        if not (0 < y[held].sum() < held.sum() and 0 < y[~held].sum() < (~held).sum()):
            held[:] = False
        d = x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        z, t = (x[~held] - self.mean) / self.dev, y[~held].astype(float)
        for _ in range(epochs):
            order = rng.permutation(len(t))
            for at in range(0, len(t), 128):
                i = order[at : at + 128]
                h = np.tanh(z[i] @ p[0] + p[1])
                slope = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t[i]) / len(i)
                back = np.outer(slope, p[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ slope + 1e-4 * p[2], slope.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, truth = self.logits(x[held] if held.any() else x), (y[held] if held.any() else y).astype(float)
        self.temperature = min(np.geomspace(0.25, 10, 80), key=lambda c: np.mean(np.logaddexp(0, logits / c) - truth * logits / c))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.dev @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fit(sample: DataFrame, vectors: np.ndarray):
    """sample: text and y of the labelled rows that may be learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [row.tobytes() for row in features(words_of(b.column(1), LETTERS), vectors).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], ["h", "y", "x"])

    rows = sorted(mapped(sample, run, "h long, y int, x binary").collect(), key=lambda r: (r["h"], r["x"]))
    if not rows:
        return Constant(0.5)
    y = np.array([r["y"] for r in rows])
    if y.min() == y.max():
        return Constant(float(y[0]))
    return Network(np.array([np.frombuffer(r["x"], np.float32) for r in rows], float), y)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", learn_from=None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs' ids and texts with held_out, score and predicted; ``learn_from``: Column over doc_id, where labels may be used."""
    usable = doc_crc() % 3 != 1 if learn_from is None else learn_from
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    vectors = word_vectors(own)
    norm = np.sqrt((vectors.astype(float) ** 2).sum(axis=1, keepdims=True))
    vectors = (vectors / np.maximum(norm, 1)).astype(np.float32)

    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(usable)
    chosen = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(max_labelled)
    sample = own.join(F.broadcast(chosen), "doc_id").select("h", "text", "y")
    model = fit(sample, vectors)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, network = sent.value
        for b in batches:
            x = features(words_of(b.column(1), LETTERS), table)
            yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array(network.score(x))], [*(f.name for f in b.schema if f.name != "text"), "score"])

    asked = own.select("doc_id", "text", (~usable).alias("held_out"), F.xxhash64("text").alias("text_hash"))
    scored = mapped(asked, run, "doc_id long, held_out boolean, text_hash long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """docs whose score reaches the threshold, columns as they are."""
    good = classify(docs, labels, id_col=id_col, text_col=text_col, **options).where(F.col("score") >= threshold).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(good, docs[id_col].cast("long").eqNullSafe(good["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == good["__hash"]), "left_semi")
